"""Word classes of the abuse grammar: plain dictionary words by what they say, in natural order by language.

English, German, French and Spanish have all classes; Italian, Russian and Japanese the most common ones.
"""

# contempt for a person in any use
INSULT = """idiot idiots imbecile imbeciles moron morons bastard bastards jackass scumbag scumbags dimwit dimwits asshole assholes arsehole
    dumbass bitch bitches cunt cunts wanker twat prick douchebag dickhead motherfucker cretin halfwit nitwit whore whores slut sluts
    retard retards dipshit fuckwit bonehead shithead lowlife dumbfuck
    idiotin idioten dummkopf versager arschloch arschloecher hurensohn wichser missgeburt schlampe trottel vollidiot depp drecksau dreckskerl mistkerl drecksack schwachkopf
    pute putes connard connards connasse salaud salope abruti encule raclure cretine batard
    idiota idiotas imbecil imbeciles gilipollas cabron cabrona pendejo pendeja hijoputa cretino estupida subnormal
    stronzo stronza stronzi idioti coglione bastardo puttana deficiente cretina"""

# contempt only where a person is called so
SOFT = """clown clowns loser losers pig pigs swine donkey fool failure disgrace coward weirdo creep freak liar worm cow hypocrite snake toad hag crook cheat leech brat slob
    schwein esel feigling witzfigur
    luegner luegnerin heuchler heuchlerin kuh sau wurm ratte
    clown cochon porc ane bouffon menteur menteuse vache truie lache hypocrite
    mentiroso mentirosa vaca perra gusano payaso cerdo cerda burro perdedor cobarde
    pagliaccio maiale asino"""

BADNESS = """stupid worthless disgusting braindead ugly filthy useless pathetic lying dumb retarded rotten dirty stinking lousy
    damn goddamn bloody revolting vile hideous idiotic spineless brainless
    dummer dumme dummes dummen verdammter verdammte verdammtes verdammten daemlicher daemliche mieser miese dreckiger dreckige dreckigen haesslicher haessliche bloeder bloede ekelhafter ekelhafte nutzloser nutzlose wertloser wertlose
    stupide stupides minable degoutant degoutante inutile immonde immondes
    asqueroso asquerosa asquerosos inutil maldito maldita malditos estupido estupida estupidos sucio sucia sucios patetico patetica
    stupido stupida schifoso schifosa sporco inutile"""

YOU = """you your yours youre yourself yourselves u ya ur du dich dir dein deine deiner deinem deinen ihr euch tu toi te ton ta tes vous votre vos
    ti usted ustedes contigo eres tus vosotros sei siete sois tuo tua lei voi"""
HE = "he she hes shes him er sie il elle ella lui lei"
SELF = "i we ill well im ich wir je nous yo nosotros io noi"
THEM = "them they their theyre ihnen ihre ihr eux leur leurs ellos ellas los les loro"
COP = "are is was were be am being bist sind ist war waren es est sont etes etait son eres era eran r sei seid siete sois sono"
TRAIT = "lazy greedy drunken stinky sick evil selfish crazy insane creepy nasty despicable fat old miserable faul fauler faule fette fetter elender elende sale sales gros grosse pauvre vieux vieille gordo gorda vago vaga loco loca"
INTENS = "absolute total complete utter real really such little big vraiment completement richtig totaler totale absoluter total"
DET = "a an the uno ein eine einen einem einer der die das den dem un une le la les des de du los las el una unos unas such so my this that these those some il gli lo i"
ALL = "all every each any these those such most alle jeder jede diese tous toutes chaque ces todos todas cada estos tutti"
NEG = "not no never dont doesnt didnt isnt arent aint wasnt cannot cant wont nicht kein keine keinen nie niemals pas jamais aucun ne nunca jamas non mai"
NOBODY = "nobody noone niemand keiner personne nadie nessuno"
MUST = "should must ought lets gotta deserve deserves belong belongs need needs muessen muss sollten sollte gehoeren gehoert doivent doit devraient faut meritent deben debe deberian merecen hay dovrebbero devono"
WILL = "will ll gonna going ill shall werde wirst werden vais vas va voy vamos"

# what is said of people only to call them less than people
SCUM = """scum filth vermin subhuman subhumans savages lowlifes degenerates criminals thieves liars rapists thugs murderers leeches
    ungeziefer abschaum untermenschen dreckspack gesindel pack diebe luegner verbrecher
    vermine racaille voleurs menteurs criminels sauvages sous-hommes
    escoria ladrones mentirosos criminales salvajes alimanas
    feccia ladri"""
# animals, parasites and sicknesses that people are likened to
VERMIN = """parasites parasite rats rat cattle cockroaches cockroach roaches roach lice louse maggots maggot pest pests plague cancer disease
    ratten ratte parasiten parasit kakerlaken laeuse maden seuche pest ordures ordure parasites cafards rats poux
    ratas rata basura plaga parasitos cucarachas ratti parassiti spazzatura"""
JUNK = "animals animal trash garbage dirt dogs apes monkeys beasts shit crap tiere tier muell dreck hunde affen scheisse animaux chiens merde singes animales mierda perros monos animali"
BEASTS = """mice mouse rabbits rabbit pigeons pigeon mosquitoes mosquito ticks tick fleas flea flies spiders spider beetles beavers foxes wasps ants worms slugs snails
    termites bedbugs moths aphids locusts weevils otters insects germs bacteria fungi viruses deer wolves crows gulls cats sheep goats
    maeuse kaefer zecken schnecken motten wespen ameisen insekten pucerons moustiques souris mosquitos ratones hormigas pulgas garrapatas chinches"""

LOWER = "dumber stupider worse lower filthier uglier dirtier lazier inferior duemmer schlimmer dreckiger pires peores peor"
HUMAN = "human humans people menschen mensch humains humanos personas"
HARM = """choke die bleed suffer rot burn perish starve drown
    sterben stirb stirbst verreckst verrecken verreck verrecke brennen pourrir creve crever mourir meurs pudrirte morir mueras muerete pudras sangrar crepa morire"""
PUNISH = """shot hanged hung killed gassed lynched beaten whipped caged cage noose gallows gutter zoo grave slaughtered exterminated drowned burned burnt castrated sterilised sterilized
    erschossen gehaengt vergast kaefig fusilles pendus cage fusilados ahorcados jaula"""
KILL = """kill murder strangle stab shoot hang gas slaughter butcher exterminate eradicate lynch annihilate behead
    toeten umbringen ermorden erschiessen vergasen vernichten ausrotten abknallen tuer buter egorger exterminer matar matarte matarlos exterminar degollar uccidere ammazzare"""
HURT = "break smash beat hurt cut crush burn punch slap rip skin torture brechen schlagen casser frapper romper partir golpear"
BODY = "legs arms neck face skull bones jaw teeth nose throat head knees fingers ribs house family kids beine arme hals gesicht knochen zaehne jambes gueule os piernas cara cuello huesos"
EXPEL = "deport expel evict banish ausweisen abschieben rauswerfen expulser deporter expulsar deportar echar echarlos echarlas echemos"
SEND = "send ship throw kick drive chase get schickt schmeisst werft renvoyez jetez manden manda"
AWAY = "back out away home off packing"
OUT = "raus dehors fuera weg fuori"
SHUN = "trust hire marry serve befriend help traut embaucher epouser confies confiar contratar"
PLACE = "school schools country town towns city cities neighbourhood neighbourhoods neighborhood neighborhoods street streets land nation europe village villages homes parks land deutschland stadt schulen pays ville pais barrio escuelas"
HOMES = "houses homes shops churches mosques synagogues temples camps villages haeuser laeden maisons casas tiendas"
VANISH = "disappear vanish die leave drown jump verschwinde disparais desaparece"
KIN = "mother mum mom mama father dad parents family mutter vater eltern mere pere madre padre"
FIGURE = "sister brother daughter son aunt uncle girlfriend boyfriend schwester bruder soeur frere hermana hermano boss neighbour neighbor teacher husband wife ex mayor president minister landlord coach chef nachbar lehrer voisin vecino jefe"
SHAME = "ashamed embarrassed disgusted schaemen honte avergonzada avergonzado averguenza"
FUCK = "fuck fucking fuckin ficken fick foutre joder nique baise chinga vaffanculo puta puto putain"
THING = "thing things something creature creatures etwas ding chose quelquechose cosa algo"
SPEAK = "said says say saying claimed claims claiming wrote writes called calling calls call accused posts posted posting shouted shouting sagte behauptet nannte a-dit traite llamo dijo"
STAFF = "moderators moderator admins admin court judge jury police magistrate moderatoren gericht polizei juge tribunal moderadores policia juez"
PENALTY = "removed deleted banned fined convicted suspended arrested sentenced blocked jailed sacked dismissed reported geloescht gesperrt verurteilt supprime condamne banni eliminado condenado"
WORD = "word words term name title phrase slur insult expression wort begriff mot terme palabra termino"

LEWD = """porn porno pornos pornography xxx orgasm orgasms horny boobs tits pussy blowjob handjob cumshot milf creampie deepthroat gangbang masturbate masturbating
    geile geil geiles fotzen titten muschi chatte branler cachondas cachonda cachondo tetas polla polvo"""
SEXUAL = """sex nude nudes naked hardcore uncensored erotic erotica escorts escort undressed undress thighs moaned moaning nipples nipple penis vagina stripping striptease fetish clitoris
    nackte nackt nackten sexe nues nue nus seins erotique sexo desnudas desnuda desnudos erotik erotica sesso nuda nude"""
CARESS = "moan begged begging stroked stroking licked licking thrust thrusting undressing groped caressed pressed slid"
HINT = """cam cams webcam hot singles tonight bed adult video videos pics live wild explicit bodies toys
    clips housewives hour frauen warten femmes chaudes soir mujeres noche gratis want huge came night hand service signup explicit girls anything"""
CLINIC = """health gesundheit sexuellen sexual education courses course clinic screening study gallery museum
    ledger biology anatomy patients doctor research survey leaflets sante depistage salud lesson school hospital medical"""

RUSSIAN = {
    "INSULT": "идиот идиотка идиоты дурак дура дураки дебил дебилы кретин урод мразь ублюдок сволочь козел придурок скотина подонок шлюха сука мудак тупица ничтожество",
    "BADNESS": "тупой тупая тупые глупый глупая грязный грязная грязные мерзкий мерзкая мерзкие жалкий жалкая вонючий вонючая вонючие",
    "YOU": "ты тебя тебе тобой твой твоя вы вас вам",
    "SELF": "я мы",
    "INTENS": "просто такой такая",
    "SCUM": "воры отбросы мрази подонки твари",
    "VERMIN": "паразиты крысы",
    "JUNK": "животные",
    "HARM": "умри умереть сдохни сдохнуть",
    "KILL": "убью убить зарежу",
    "GAG": "заткнись заткнитесь",
    "LEWD": "порно порнуха сиськи",
    "SEXUAL": "секс голые голая эротика интим",
    "HINT": "видео бесплатно девушки онлайн горячие",
    "GROUP": "мигранты мигрантов мигрантам евреи евреев цыгане цыган мусульмане мусульман иностранцы иностранцев беженцы беженцев",
}
JAPANESE = {
    "INSULT": "馬鹿 バカ ばか野郎 馬鹿野郎 アホ クズ くそ野郎 クソ野郎 ゴミ野郎 間抜け",
    "YOU": "お前 おまえ てめえ 貴様 あなた",
    "SCUM": "害虫 寄生虫 ゴミ クズ",
    "KILL": "殺す 殺してやる ぶっ殺す",
    "GAG": "死ね くたばれ 黙れ",
    "LEWD": "ポルノ エロ動画 無修正 巨乳 おっぱい",
    "SEXUAL": "セックス 全裸 エロ ヌード",
    "HINT": "動画 無料",
    "GROUP": "移民 難民 外国人 ユダヤ人 黒人",
    "OUTWARD": "出て行け 追い出せ",
    "OTHER": "バカンス アホウドリ ゴミ箱 エロス",
}

#: Words for groups of people; demonyms beyond these are known by their form (``abuse.outside``).
GROUPS = """immigrants migrants refugees foreigners outsiders jews jew muslims muslim christians catholics protestants hindus buddhists sikhs atheists
    blacks whites asians africans arabs turks poles russians ukrainians germans french chinese mexicans indians pakistanis gypsies gypsy roma travellers
    gays lesbians homosexuals transsexuals queers women men girls boys elderly pensioners teenagers disabled cripples natives aborigines peasants
    auslaender migranten fluechtlinge asylanten juden muslime tuerken polen russen araber schwarze schwule lesben frauen zigeuner
    etrangers immigres migrants refugies juifs musulmans arabes noirs turcs gitans homosexuels femmes roms
    inmigrantes extranjeros refugiados judios musulmanes moros gitanos negros arabes mujeres homosexuales sudacas
    immigrati stranieri ebrei musulmani zingari"""

CLASSES = {
    name: globals()[name]
    for name in """INSULT SOFT BADNESS TRAIT INTENS FIGURE YOU HE SELF THEM COP DET ALL NEG NOBODY MUST WILL SCUM VERMIN JUNK BEASTS LOWER HUMAN HARM PUNISH KILL HURT BODY
        EXPEL SEND AWAY OUT SHUN PLACE HOMES VANISH KIN SHAME FUCK THING SPEAK STAFF PENALTY WORD LEWD SEXUAL CARESS HINT CLINIC""".split()
}
