"""Tokens against two public libraries, leakage against brute force, and the abuse grammar on labelled examples."""

from __future__ import annotations

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakelens.llm import abuse, leakage, tokenize
from lakelens.llm.codebook import Codebook, slices
from lakelens.llm.fst import Lattice, Pattern, Transducer
from lakelens.llm.words import words
from lakelens.runtime import table

DATA = "/root/testdata/sf0.001"
RANKS = f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
ODD = ["", None, " ", "a", "aaaa" * 700, "ab" * 3000, "x  y\n\n z \t", " lead", "trail ", "don't we'LL", "<|endoftext|> is text", "émile ­ zero​width", "日本語 テキスト", "👍🏽 1234567", "\x00\x01", "a\r\nb", "   "]


@pytest.fixture(scope="module")
def bpe():
    return tokenize.BytePairEncoder(RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenize.SPLIT, mergeable_ranks=ranks, special_tokens={})


def encoded(bpe, texts):
    ids, counts = bpe.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_documents(spark, bpe, reference):
    got = {r.doc_id: r.ids for r in tokenize.token_ids(table(spark, DATA, "documents")).collect()}
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    assert got == {d: reference.encode_ordinary(t) if t else [] for d, t in texts.items()}
    other = Tokenizer.from_file(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    keys = sorted(texts)
    assert [e.ids for e in other.encode_batch([texts[k] or "" for k in keys], add_special_tokens=False)] == [got[k] for k in keys]


def test_odd_texts(spark, bpe, reference):
    assert encoded(bpe, ODD) == [reference.encode_ordinary(t) if t else [] for t in ODD]
    assert all(reference.decode(i) == (t or "") for i, t in zip(encoded(bpe, ODD), ODD))
    df = spark.createDataFrame([(None, "a", 1), (2, None, 1), (2, "b c", 1), (2, "b c", 1)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in tokenize.token_ids(df).collect()) == [(0, 1), (2, 0), (2, 2), (2, 2)]
    assert tokenize.token_ids(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text(alphabet=" \n\tab'.1é", max_size=30), max_size=5))
def test_any_text(bpe, reference, texts):
    assert encoded(bpe, texts) == [reference.encode_ordinary(t) for t in texts]


def test_codebook_is_bounded():
    book = Codebook(lambda ts: [[len(t)] * (len(t) % 3) for t in ts], limit=4)
    import numpy as np

    for batch in (["a", "bb", "ccc"], ["dddd", "a", "eeeee", "bb"], list("qwertyuiop")):
        ids, n = book.ids(batch, np.array([len(batch)]))
        assert ids.tolist() == [len(t) for t in batch for _ in range(len(t) % 3)] and n.tolist() == [len(ids)]
    assert list(slices([])) == [] and list(slices(["a" * 9, None, "b"], 5)) == [(0, 1), (1, 3)]


def brute(texts, items, run):
    out = set()
    for d, t in texts:
        w = words(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for k, p in items:
            v = words(p)
            if any(tuple(v[i : i + run]) in grams for i in range(len(v) - run + 1)):
                out.add((d, k))
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 12])
def test_leaks_against_brute_force(spark, run):
    rng = random.Random(run)
    text = lambda n: " ".join(rng.choice(["der", "Der", "die", "É́a", "x-y", "1", "ﬁn", "zu­g", "—", "Kot."]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 20))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(90, None), (91, ""), (92, items[5][1].upper() * 3), (93, text(6000))]
    docs += docs[:5]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, passage string")
    e = spark.createDataFrame(items, "item_id long, passage string")
    want = brute(docs, items, run)
    for chars in (50, 10**6):  # several blocks of passages, or one
        got = [tuple(r) for r in leakage.leaked_items(d, e, run, item_chars=chars).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leakage.leaked_items(d, e.limit(0), run).count() == 0 and leakage.leaked_items(d.limit(0), e, run).count() == 0


def test_a_run_that_all_passages_share(monkeypatch):
    monkeypatch.setattr(leakage, "CANDIDATES", 50)
    shared = " ".join(f"w{i}" for i in range(15))
    items = [(i, f"own{i} {shared} end{i}") for i in range(120)] + [(500, "too short")]
    search = leakage.LeakFinder(leakage.WuManber([(i, words(p)) for i, p in items], 12))
    doc, item = search.find([None, shared, "x " * 3000 + shared.upper(), "", "own3 " + shared])
    assert {(d, i) for d, i in zip(doc.tolist(), item.tolist())} == {(d, i) for d in (1, 2, 4) for i in range(120)}


def test_tables_of_a_block_are_small():
    import pickle

    rng = random.Random(3)
    items = [(i, [f"w{rng.randrange(10**5)}" for _ in range(200)]) for i in range(800)]  # about a million characters
    assert len(pickle.dumps(leakage.WuManber(items, 12))) < 30_000_000


def test_leaks_in_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    items = [(r.item_id, r.passage) for r in table(spark, DATA, "eval_items").collect()]
    assert {tuple(r) for r in leakage.leaked_items(table(spark, DATA, "documents"), table(spark, DATA, "eval_items")).collect()} == brute(docs, items, 12)


def test_transducers():
    t = lambda text: Lattice([frozenset({w}) for w in text.split()])
    assert sorted(Pattern("a (b|c)? d{1,2}").ends(t("a c d d d"), 0)) == [3, 4]
    assert sorted(Pattern("a .{0,2} b").ends(t("a x b b"), 0)) == [3, 4]
    assert sorted(Pattern("a b* c").ends(t("a " + "b " * 50 + "c"), 0)) == [52] and not Pattern("a b+ c").ends(t("a c"), 0)
    assert Pattern("A&B").ends(Lattice([frozenset("AB")]), 0) and not Pattern("A&B").ends(Lattice([frozenset("A")]), 0)
    grammar = Transducer().add("long", 2.0, "a b", output="AB").add("short", 1.0, "a")
    assert grammar.score(t("a b a x")) == {"long": 2.0, "short": 1.0}
    lattice = grammar.compose(t("x a b y"))
    assert (3, frozenset({"AB"}), 2.0) in lattice.arcs[1] and (2, frozenset({"a"}), 0.0) in lattice.arcs[1]
    # both readings stay, and the best path of the last stage decides
    last = Transducer().add("outer", 1.0, "x AB").add("inner", 4.0, "a b y")
    assert last.score(lattice) == {"inner": 4.0} and Transducer().add("outer", 1.0, "x AB").score(lattice) == {"outer": 1.0}
    # a rule of more weight that isn't asked for keeps its span from others
    assert Transducer().add("n", 3.0, "a b").add("inner", 1.0, "a b y").score(t("x a b y")) == {"n": 3.0}
    assert Transducer().add("far", 1.0, "a .* z").score(t("a " + "b " * 30000 + "z")) == {"far": 1.0}  # linear, without a bound
    with pytest.raises(ValueError):
        Pattern("a ) b")


def test_labelled_snippets(spark):
    """Recall and precision on the labelled examples, and the right kind for those found."""
    scorer, kinds = abuse.Scorer(), ("abusive", "hateful", "sexual")
    hits = right = false = missed = 0
    for r in table(spark, DATA, "review_snippets").collect():
        s = scorer.score(r.text)
        flagged = max(s) >= abuse.THRESHOLD
        hits += flagged and r.category != "none"
        right += flagged and kinds[s.index(max(s))] == r.category
        false += flagged and r.category == "none"
        missed += not flagged and r.category != "none"
    assert hits / (hits + false) >= 0.97 and hits / (hits + missed) >= 0.97 and right / hits >= 0.95


HELD_OUT = [
    ("You are a complete moron", True), ("you're an idiot", True), ("tais-toi, espèce d'imbécile, sale connard", True), ("Eres una basura", True), ("DU DUMMES ARSCHLOCH", True),
    ("y o u  a r e  a  s t u p i d  i d i o t", True), ("I will kill you", True), ("go kill yourself", True), ("All immigrants are vermin", True), ("Les Tessari sont des ordures", True),
    ("deport all Dunari", True), ("hot horny milf porn", True), ("u r a w0rthl3ss l0ser", True), ("ЅΗUT UP, you ѕtupid іdiot", True),
    ("Vermin were found in the cellar", False), ("Nobody called you an idiot", False), ("This is not stupid", False), ("The rats are trapped", False), ("sex education in school", False),
    ("Kill the server process", False), ("The Dunari cook well", False), ("an idiot light on the dashboard", False), ("945 Euro", False), ("escor75 wrote: hello", False), ("article 686-A", False),
    ("She is a nude painting expert", False), ("The clown entertained the children", False), ("", False), (None, False), ("   ", False),
]


@pytest.mark.parametrize("text,flagged", HELD_OUT)
def test_other_wordings(text, flagged):
    assert (max(abuse.Scorer().score(text)) >= abuse.THRESHOLD) is flagged


def test_scores_of_rows(spark):
    df = spark.createDataFrame([(1, "You are an idiot", "s", 1), (1, "You are an idiot", "s", 1), (None, None, None, 1), (3, "fine words " * 20000, "s", 1)], "doc_id long, text string, source string, abusive int")
    rows = abuse.content_scores(df, keep=("source",)).collect()
    assert [r.flagged for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [False, True, True, False] and rows[0].asDict().keys() >= {"doc_id", "source", "score", "sexual"}
    assert abuse.content_scores(df.limit(0)).count() == 0


def test_every_rule_can_decide():
    """Each rule of weight, given a lattice that holds just what it asks for, scores and passes the gate."""
    lexer = abuse.Lexer()

    def shortest(pattern: Pattern) -> list[frozenset[str]]:
        paths = [(pattern.start, [])]
        for state, path in paths:
            if path and pattern.final[state]:
                return path
            paths += [(n, [*path, labels or frozenset({"OTHER"})]) for labels, n in sorted(pattern.arcs[state], key=lambda x: sorted(x[0]))]
        raise ValueError("no match")

    for rule in abuse.CLAUSES.rules:
        path = shortest(rule.pattern)
        assert abuse.CLAUSES.score(Lattice(path)), rule.pattern.text
        if rule.name != "lewd":
            assert lexer.gate.opens(lexer.gate.bits(frozenset().union(*path))) and not lexer.gate.hot.isdisjoint(set().union(*path)), rule.pattern.text


@pytest.mark.parametrize("text", [
    "I hope you die", "You deserve to die", "I will find out where you live", "no one will miss you", "ich mach dich fertig", "Ich bring dich um", "Halts Maul",
    "ferme ta bouche",
])
def test_clauses_without_insults(text):
    assert max(abuse.Scorer().score(text)) >= abuse.THRESHOLD


def test_gate_opens_wherever_a_rule_matches():
    scorer, rng = abuse.Scorer(), random.Random(5)
    some = sorted(set(scorer.lexer.labels))
    for _ in range(3000):
        tokens = [rng.choice(some) for _ in range(rng.randrange(1, 7))]
        labels = [scorer.lexer.look(t)[0] for t in tokens]
        abusive, hateful, sexual = scorer.clause(tokens, labels)
        if abusive or hateful or sexual > 0:
            assert scorer.lexer.gate.opens(scorer.lexer.gate.bits(frozenset().union(*labels))) and not scorer.lexer.quiet(tokens), tokens


def test_long_texts_without_an_end_are_read_in_linear_time():
    import time

    scorer, start = abuse.Scorer(), time.process_time()
    assert scorer.score("you are stupid " * 5000)[0] >= 0.5 and scorer.score("all the Turks are " * 3000 + "vermin")[1] >= 0.5
    assert scorer.score("You are a " + "stupid " * 300 + "idiot")[0] >= 0.5 and scorer.score("-" * 100_000 + "_-" * 50_000) == (0.0, 0.0, 0.0)
    assert time.process_time() - start < 20


def test_sentences_over_lines():
    score = abuse.Scorer().score
    assert score("You are a\nworthless idiot.")[0] >= 0.5 and score("You are a " + "stupid " * 12 + "idiot")[0] >= 0.5
    assert score("You are a\n\nworthless idiot.")[0] < 0.5  # another paragraph
    assert max(score("About you\nSex and age of the sheep\nFree videos of hot springs")) < 0.5  # a menu is no sentence about sex


@pytest.mark.parametrize("token,word", [
    ("id**t", "idiot"), ("a**hole", "asshole"), ("m*r*n", "moron"), ("b**bs", "boobs"), ("c**t", "cunt"), ("w*nk*r", "wanker"), ("i*i*t!", "idiot"), ("id*t", "idiot"),
    ("idiiot", "idiot"), ("stuupid", "stupid"), ("moronn", "moron"), ("ashole", "asshole"), ("fuuck", "fuck"), ("id" + "i" * 90 + "ot", "idiot"),
])
def test_disguises(token, word):
    assert word in abuse.Lexer().words(token)


@pytest.mark.parametrize("token", ["Bobs", "shot", "root", "roten", "bitte", "co-op", "AT&T", "t.t.s", "u.s.", "C++", "B�che", "Stra�e", "morrón", "a*b", "**", "z" * 500])
def test_no_disguises(token):
    found = abuse.Lexer().words(token)
    assert not found or found == (token.lower(),)


def test_disguised_passages():
    scorer = abuse.Scorer()
    for text in ("You are an id**t", "you m*r*n", "you stuupid idiiot", "you are a stupid a**hole", "You are an " + "idi" + "o" * 80 + "t"):
        assert scorer.score(text)[0] >= abuse.THRESHOLD, text
    assert max(scorer.score("The root of the tree was gross")) < abuse.THRESHOLD


# attacks on groups that the test data doesn't name, and Russian and Japanese
UNNAMED = [
    ("All Poles are worthless parasites", True), ("Keep the Roma out of our schools", True), ("Never trust the Mexicans, they are all thieves and liars", True),
    ("The Albanians are nothing but criminals", True), ("Deport all the Somalis", True), ("Les Roms sont de la racaille", True), ("Todos los gitanos son ladrones", True),
    ("Alle Polen sind dreckige Diebe", True), ("Kill all Armenians", True), ("Send the Syrians back", True), ("Turks are filthy animals", True), ("Romanians should all be shot", True),
    ("Ты тупой идиот", True), ("Заткнись, дура", True), ("я убью тебя", True), ("Все мигранты паразиты", True), ("Порно видео бесплатно", True), ("вы просто мразь", True),
    ("お前は馬鹿だ。", True), ("死ね", True), ("外国人は出て行け", True), ("お前を殺す", True), ("移民は寄生虫だ", True), ("無料のエロ動画、無修正", True),
    ("The Beatles are great musicians", False), ("Ticks are parasites", False), ("All Poles were at the parade", False), ("Keep the Paint out of the sun", False), ("Alle Zecken sind Parasiten", False),
    ("Крысы в подвале", False), ("Идиот - роман Достоевского", False), ("バカンスの計画", False), ("ゴミ箱はあちらです", False), ("The Romans were builders", False), ("Die Polen sind Nachbarn", False),
]


def test_groups_that_no_list_names():
    scorer = abuse.Scorer()
    flagged = [(text, max(scorer.score(text)) >= abuse.THRESHOLD) for text, _ in UNNAMED]
    found = sum(f for (_, f), (_, true) in zip(flagged, UNNAMED) if true)
    false = [text for (text, f), (_, true) in zip(flagged, UNNAMED) if f and not true]
    assert found >= 22 and not false, [x for x, y in zip(flagged, UNNAMED) if x != y]

# Three lists of attacks and harmless sentences by the author of the rules. Each was run once before a rule was changed for it:
# flagged at first were 29 of 40 attacks and 1 of 40 harmless sentences, 25 of 36 and 0 of 30, 24 of 35 and 0 of 30.
ATTACKS = [
    "Your whole family is a bunch of worthless parasites", "Shut your mouth, you lying coward", "I'm going to kill you and your dog", "I hope you get cancer and die",
    "Everyone would be happier if you were dead", "What an idiot you are", "She is such a stupid bitch", "Somalis are thieves and rapists",
    "We must expel all the Muslims", "Hang the gypsies", "Gays should be shot", "Women are nothing but whores", "Get these filthy migrants out of our town",
    "Jews are a plague", "Du bist so ein Arschloch", "Halt's Maul, du Idiot", "Alle Ausländer raus", "Die Türken sind Abschaum", "Ich bringe dich um",
    "Verpiss dich, du Hurensohn", "Ta gueule, connard", "Tu es vraiment une merde", "Les Arabes sont des voleurs", "Je vais te tuer", "Eres una puta basura",
    "Te voy a matar, cabrón", "Los inmigrantes son ratas", "Sei uno stronzo", "You absolute moron", "Drop dead, loser", "Kys you worthless piece of trash",
    "You're a disgrace to your family, you pig", "No immigrants deserve to live here, they are vermin", "Burn all mosques down", "Hot teen girls strip naked on cam",
    "XXX hardcore porn movies free", "She licked his penis and moaned", "Nackte geile Frauen privat", "Sexo gratis con chicas desnudas", "Blowjob videos and milf porn",
]
HARMLESS = [
    "The Jews of Vienna built this synagogue", "Somalis celebrate their national day", "Women should be paid equally",
    "Many refugees were beaten at the border, the report says", "Gays and lesbians marry in June", "The Turks won the match", "Migrants need homes and schools",
    "Muslims pray in the mosques of our town", "Kill the weeds before they spread", "He was convicted for calling a colleague an idiot", "Rats are a pest in old houses",
    "The Poles are known for their hospitality", "You are a great friend", "My printer is a stupid piece of junk", "This damn traffic jam",
    "The black death was a plague", "Never trust a stranger's link", "We should send the Germans a card", "The clown made the children laugh",
    "The word bitch means a female dog", "Breast cancer screening is free", "The nude in the painting is by Goya", "Sex education starts in grade five",
    "Chicken breast with pig ears", "The cock crows at dawn", "He shot the photo in Paris", "Die Polen sind unsere Nachbarn", "Die Ratten sind im Keller",
    "Les femmes ont le droit de vote", "Los gitanos celebran su día", "It is hateful to say that Jews are vermin",
    "Police arrested a man who shouted that immigrants are scum", "You should not call people idiots", "Is he a bastard son of the king",
    "Deer ticks are parasites that bite you", "The Vikings burned the villages", "Africans were shipped to the islands as slaves", "No person is illegal",
    "Drown the pasta in sauce", "The museum shows naked statues",
]
LATER_ATTACKS = [
    "You are the dumbest idiot I have ever met", "Go die in a fire", "Nobody likes you, freak", "We will burn you alive", "You deserve to be shot",
    "My boss is an asshole", "Fuck you all", "You stupid little bitch", "Everybody here hates you, you ugly pig", "Kill yourself", "Black people are animals",
    "Nigerians are all criminals", "Throw the refugees into the sea", "Mexicans breed like cockroaches", "We don't want Muslims in our country",
    "Christians are subhuman", "Lesbians deserve to die", "Those filthy Hungarians should be gassed", "Deport every single Afghan", "Geh sterben, du Versager",
    "Ihr seid alle Idioten", "Schwule gehören vergast", "Ausländer sind Ungeziefer", "Va mourir, sale conne", "Les Juifs sont des parasites", "Dégage, espèce d'ordure",
    "Muérete, idiota", "Los moros fuera de España", "Eres un cerdo asqueroso", "Siete tutti idioti", "Watch nude girls live on webcam", "Geile Titten und nackte Frauen",
    "Hardcore anal sex videos", "Free porn", "She stroked his naked thighs and moaned", "Video porno gratis",
]
LATER_HARMLESS = [
    "Hungarians and Romanians signed the treaty", "The refugees were thrown into the sea by smugglers", "Muslims and Christians live side by side",
    "The pigs are in the barn", "Did you kill the lights?", "I will beat you at chess", "Her mother was ashamed of the dirty kitchen", "Nigerians voted on Saturday",
    "Mosquitoes breed in standing water", "Ich liebe meinen dummen Hund", "Black rats and brown rats are common", "The thieves were Romanian citizens, police said",
    "Gay men should get tested", "You are not stupid", "Don't call me an idiot", "The guide tells you how to kill rats", "What a beautiful day you are having",
    "The trash is collected on Monday", "Women in Iran protest", "He deserves better", "The Nazis murdered six million Jews", "Let us help the migrants out of poverty",
    "The doctor examined her breast", "Sexual harassment at work is illegal", "The film is rated 18 for nudity and violence", "Keep children out of the kitchen",
    "The Scots should leave the union, he argued", "All Swedes are invited", "Indians make up a third of the staff", "You make me happy",
]

LAST_ATTACKS = [
    "You're nothing but a filthy liar", "Somebody should shoot you in the head", "Get lost, you miserable worm", "I'd love to see you hang", "You people make me sick",
    "My sister is a stupid cow", "Die already, you waste of oxygen", "We know where your kids go to school, you bastard", "Your mother is a whore",
    "You have the brain of a rat, moron", "Vietnamese are dirty thieves", "No Jews allowed in our village", "Ship the Syrians back to where they came from",
    "Those Romanians are all criminals", "Muslims should be banned from our country", "Trans people are degenerates", "The Irish are drunken pigs",
    "Exterminate all the Hutus", "Keep Chinese out of our neighbourhood", "Bomb the mosques", "Du hässliche Missgeburt", "Ich hoffe, du verreckst", "Araber sind Tiere",
    "Espèce de sale pute", "Les musulmans dehors", "Je te souhaite de mourir", "Ojalá te mueras, hijo de puta", "Las mujeres son basura", "Fick dich",
    "Sei un pezzo di merda", "Nude teens on webcam tonight", "Watch my hardcore sex tape", "He thrust deep inside her naked body and she moaned",
    "Bisexual MILF orgasm compilation", "Sexe hard et femmes nues en vidéo",
]
LAST_HARMLESS = [
    "Vietnamese food is delicious", "The thieves broke into the Jewish museum", "Muslims are a minority in Poland", "The Irish won the rugby game",
    "Police shot a man in the head", "My sister has a cow", "The rats left the ship", "Women and men earn different wages", "Syrians fled the war in their country",
    "He fell down drunk like a pig in mud", "Die the fabric in cold water", "The hens are filthy and need a bath", "Nobody needs another meeting",
    "Kill the engine before you refuel", "The bastard sword hangs on the wall", "You are late again", "Trans people face discrimination",
    "The plague killed a third of all Europeans", "I hate this stupid weather", "You should be ashamed of the mess, said the sign", "Ich hoffe, du kommst bald",
    "Die Araber lebten lange in Spanien", "Les femmes de la ville", "Las mujeres trabajan", "Sex differences in voting", "The naked mole rat lives long",
    "Hardcore fans waited all night", "Adult tickets cost five euros", "The doctor removed her breast", "Escort vehicles led the convoy",
]


def test_own_lists():
    score = abuse.Scorer().score
    flagged = lambda texts: [t for t in texts if max(score(t)) >= abuse.THRESHOLD]
    for attacks in (ATTACKS, LATER_ATTACKS, LAST_ATTACKS):
        assert len(flagged(attacks)) >= len(attacks) - 1
    assert flagged([*HARMLESS, *LATER_HARMLESS, *LAST_HARMLESS]) == []


def test_neutral_and_hostile_clauses_about_real_groups():
    score = lambda t: max(abuse.Scorer().score(t))
    for t in ("The company is proud to hire women.", "I trust women.", "We serve immigrants with free legal advice.", "Refugees go home after the war.", "beat the women team", "People like you should be proud."):
        assert score(t) < 0.5, t
    for t in ("Turks are vermin", "Asians are vermin", "you are garbage", "You're trash", "You suck", "He is a fucking idiot", "Eat shit and die", "I will break your legs"):
        assert score(t) >= 0.5, t
