"""Problem 8: abusive, hateful and sexual content, by a weighted finite-state pattern grammar.

A cascade of transducers is composed with each sentence's lattice of words:

1. the lexical transducer turns every surface form, however spelled, into the labels of its word classes, and an unknown
   word into what its form says (NAMED, DEMONYM, PEOPLE);
2. ``PHRASES`` reads multi-word insults, targets (YOU, PERSON, a TRIBE of people) and acts as one token each;
3. ``JUDGEMENTS`` reads what somebody is called as one token;
4. ``CONTEXT`` and ``CLAUSES`` decide together: mentions, reports, denials and technical uses are spans that say nothing of
   their own and outweigh what they hold; every rule of ``CLAUSES`` has a slot for a target and one for what is said of it
   or called for, so neither a bad word nor a group's name counts alone.

All readings stay in the lattice; the best path through it decides. Groups are known by syntax and form (plural demonyms,
"all X", "X folk", "people of X") besides a list of common words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.codebook import slices
from lakelens.llm.fst import Labels, Rule, Transducer, compose
from lakelens.llm.vocabulary import CLASSES, GROUPS, JAPANESE, RUSSIAN
from lakelens.runtime import spread

THRESHOLD = 0.5

# Phrases that stand for one word of a class.
PHRASES = (
    Transducer()
    .add(
        "insult", 0.0,
        "waste of (space|air|oxygen|skin)", "piece of (JUNK|SCUM|work)", "sack of (JUNK|SCUM)", "(son|sons) of DET? (bitch|bitches|whore)",
        "(stueck|haufen) (JUNK|SCUM)", "(pedazo|saco) de (JUNK|VERMIN)", "(sac|tas) (a|de) (merde|ordures)", "hijo de (puta|perra)", "(fils|fille) de pute",
        "pezzo di (merda|JUNK)", "figlio di puttana",
        output="INSULT",
    )
    .add("silence", 0.0, "shut up", "shut (YOU|DET) BADNESS? FUCK? BADNESS? (mouth|trap|face|up|hole)", "callate", "cierra (DET|YOU) (boca|pico)", "tais toi", "taistoi", "stai zitto", output="SILENCE")
    .add("silence", 0.0, "halt (DET|YOU) (fresse|klappe|schnauze|maul)", "halts maul", "ferme (la|ta) (gueule|bouche)", "ta gueule", "chiudi la bocca", "drop dead", "fall tot um", output="GAG")
    .add("nobody", 0.0, "no one", "not a single (person|soul)", output="NOBODY")
    .add("must", 0.0, "(have|has|had|going|time|want|wants|able) to", "MUST (NEG|all|just|really|be|have|to|zu|etre|que|ser|HE|SELF|THEM|YOU){1,3}", "hay que", "il faut", "y a qu a", output="MUST")
    # verbs of several words
    .add("end", 0.0, "(finish|finished|wipe|wiped|kill|killed) (DET|THEM|all)? off", "(wipe|wiped) (DET|THEM|all)? out", "put (DET|THEM)? down", "macht .? platt", "acabar con", output="END")
    .add("group", 0.0, "(black|white|brown|gay|trans|disabled|homeless|jewish|muslim|asian|african) people", output="GROUP")
    .add("rid", 0.0, "(get|getting|got|be) rid of", "(kick|throw|drive|push|chase|driven|thrown|kicked|chased) (DET|all)* (out|away)", "clean (out|up)", "deshacerse de", output="RID")
)

# Targets. TRIBE is a group of people; ANY of whom the text doesn't say by its form that it is one.
TARGETS = (
    Transducer()
    .add("person", 0.0, "people like YOU", "THING (like|wie|comme|como) YOU", "(someone|somebody|anyone) like YOU", "(leute|menschen) wie YOU", "(gens|personnes) comme YOU", "gente como (YOU|tu)", output="YOU")
    .add(
        "tribe", 0.0,
        "(ALL|DET|BADNESS|damn|single|last|one|of|these)* (GROUP|DEMONYM)", "(ALL|DET|BADNESS|single|last|one|of)* .? (folk|folks|tribe|tribes|clan|clans)",
        "(ALL|DET|BADNESS|single|last|one|of)* (OTHER|NAMED) people of DET? .", "(ALL|DET|BADNESS|single|last|one|of)* (NAMED|old|poor) people",
        output="TRIBE",
    )
    .add("any", 0.0, "(ALL|DET) (ALL|DET|BADNESS|of|single|last|one)* PROPER", "PROPER&PLURAL", "LEAD&PEOPLE", output="ANY")
)

# What somebody is called; PREDICATE a judgement that fits groups.
JUDGEMENTS = (
    Transducer()
    .add("slur", 0.0, "(DET|INTENS)* (BADNESS|FUCK|INTENS|TRAIT|and|de)* INSULT BADNESS*", "(DET|INTENS)* (BADNESS|FUCK|INTENS|TRAIT|and)+ SOFT BADNESS*", "DET* SOFT BADNESS+", output="SLUR")
    .add(
        "degraded", 0.0,
        "(nothing|just|only|but|nur|nichts|als|que|mas|rien|ALL|INTENS)* (DET|de|BADNESS|FUCK|and)* (SCUM|INSULT)", "DET (bunch|pack|load|lot|pile|gang|horde|haufen|bande|tas) (of|de|von)? (BADNESS|FUCK|INTENS)* (SCUM|INSULT|VERMIN|JUNK|SOFT)", "(nothing|just|only|but|nur|nichts|als|rien|que|mas|ALL)* (DET|de|BADNESS|FUCK)* (BADNESS|FUCK) (VERMIN|JUNK)",
        "(nothing|just|only|but|nur|nichts|als)+ (DET|ALL)* (VERMIN|JUNK)", "LOWER than DET* (JUNK|VERMIN|BEASTS|SOFT|SCUM)", "(duemmer|schlimmer|dreckiger) als (JUNK|VERMIN|BEASTS|SOFT)", "(pires|peores) (que) DET? (JUNK|VERMIN|BEASTS|SOFT)",
        output="DEGRADED",
    )
    .add("likened", 0.0, "(DET|de|BADNESS)* VERMIN", output="LIKENED")
)

# Spans that say nothing of their own: mentions of a word, reports and moderation, denials, help against harm.
CONTEXT = (
    Transducer()
    .add("mention", 3.0, "WORD (YOU)? (INSULT|SOFT|BADNESS|SCUM|VERMIN|SEXUAL|LEWD|FUCK)", "(INSULT|SOFT) (is|was|means|as) (a|an|the) (WORD|german|english|french|latin|old)")
    .add(
        "report", 3.0,
        "STAFF .* PENALTY .* EOS", "PENALTY .{0,4} for (SPEAK|threatening|insulting|sending) .* EOS", "(comments|comment|posts|messages|message|tweets|letters) (SPEAK|that|which|containing|with) .* EOS",
        "(calls|called|calling|call) (HE|THEM|names|me|us|NAMED|TRIBE|ANY) SLUR?", "(called|calling) (names|SLUR)", "(if|when|whenever) (someone|somebody|anyone|people|users|they) (SPEAK|say|write|posts|post) .* EOS",
        "(wrong|false|hateful|racist|untrue|unacceptable|illegal|hurtful|offensive) to (say|claim|call|think|write|tell|SPEAK) .* EOS", "SPEAK .* (is|was|are) (wrong|false|hateful|racist|untrue|unacceptable|illegal|hurtful|offensive|hate)",
        "(hate|hass) (speech|rede|crime)", "(example|examples|phrases|sentences|words|slurs|insults) (such|like|of) .* EOS", "(victim|victims) .* (called|told) .* EOS",
    )
    .add(
        "denial", 3.0,
        "NEG (DET|BADNESS|a|that|so|really|even|all|my){0,3} (SLUR|DEGRADED|LIKENED|INSULT|SOFT)", "NOBODY (should|ever|has|would)* (SPEAK|say|thinks|think|believes) .{0,3} (SLUR|DEGRADED|LIKENED)", "NEG (HARM|KILL|HURT|PUNISH|EXPEL|END|RID)", "NEG (say|think|claim|believe) (that)? (YOU|HE|THEM|SELF|TRIBE|ANY|NAMED) .* EOS", "NEG call (HE|THEM|me|us|NAMED|TRIBE) SLUR",
        "(against|stop|prevent|condemn|oppose|opposes|opposed|rejects|reject) (those|people|anyone)? (who)? .{0,4} (KILL|EXPEL|END|RID|DEGRADED|deporting|killing|expelling) .* EOS",
    )
    .add("technical", 3.0, "(KILL|END|HURT|RID) DET? (process|job|task|thread|server|daemon|switch|engine|connection|program|app|lights|weeds|germs|bacteria|BEASTS|VERMIN)")
    .add("medicine", 3.0, "(sexual|sexuellen|sexuelle|salud|sex) (CLINIC|gesundheit|harassment|assault|abuse|offender|discrimination|workers|ratio)", "sex and age", "age and sex", "(nude|naked) (figures|figure|studies|painting|paintings|sculpture|model|models|eye|mole)", "cancer du sein", "same sex", "sex of DET .")
)

CLAUSES = (
    Transducer()
    # a person is called something
    .add(
        "abusive", 0.9,
        "YOU (COP|being)? (ALL|just|nothing|but|only|really|such|nur|rien|que|mas){0,3} (SLUR|DEGRADED)", "(YOU COP|YOU&COP) .{0,2} (SLUR|SOFT)", "YOU OTHER? SLUR", "YOU .* LEAD&INSULT EOS", "YOU (は|が|も|なんて|を) (INSULT|SCUM|KILL)", "YOU (DET|BADNESS)* (INSULT|SOFT)", "what DET? SLUR YOU", "what DET? BADNESS* SOFT YOU",
        "(YOU COP|YOU&COP) .? (DET|BADNESS|FUCK|INTENS|TRAIT)* (SCUM|VERMIN|JUNK|INSULT|SOFT)", "YOU .? (KIN|kids|friends) COP .? DEGRADED", "YOU (BADNESS)+ (SCUM|VERMIN|JUNK)", "(HE|NAMED|FIGURE|KIN) COP .? SLUR", "(here|hey|oi|listen|only) SLUR", "(SLUR|INSULT) (like|wie|comme|como) (YOU|NAMED|HE)", "SOFT (like|wie|comme|como) YOU", "only DET? SOFT like (NAMED|HE)", "youre DET? (SOFT|SCUM|VERMIN|JUNK)", "espece (de|d)? (BADNESS)* (SLUR|SCUM|JUNK|SOFT|VERMIN)",
        "(SILENCE|GAG) .{0,2} (YOU)? (BADNESS)* (INSULT|SOFT|SCUM|VERMIN|JUNK)", "SILENCE .? YOU BADNESS", "GAG", "HARM SLUR", "YOU COP (so|really|such|too|a|just|LOWER)* (BADNESS){1,3} (and|EOS)", "NOBODY (needs|braucht|wants|likes|will) .{0,3} SLUR",
    )
    .add("abusive", 0.9, "YOU (all)? (suck|stink)", "FUCK (off|YOU|HE&him|her)", "LEAD&FUCK YOU", "go FUCK YOU", "screw YOU", "(eat|suck|lick) (my|YOU|a|DET)* (shit|dick|cock|arse|ass|mierda|merde)", "leck mich", "va te faire", "vete a la mierda", "va a cagare", "vaffanculo")
    # a person is told to be gone, that nobody wants them, or is shamed
    .add(
        "abusive", 0.9,
        "crawl back .? .? YOU? DET? (hole|rock|cave|sewer|swamp|gutter)", "NOBODY (WILL|would|ever)* (wants|want|likes|like|loves|love|needs|misses|miss|invited) YOU (here|around|anymore|anyway|back|NAMED|INSULT|SOFT|EOS)",
        "do .{0,3} (favour|favor) and (just|please|go)* (VANISH|HARM|KILL)", "YOU own? KIN (MUST|COP|be|is|should|would|so|very|DET){0,4} (SHAME|hates|regrets)", "YOU KIN (MUST|COP|should|would)* (have)? (aborted|drowned|swallowed)",
    )
    .add("abusive", 0.5, "(before|until) YOU open YOU (BADNESS|FUCK|big)+ (mouth|trap)", "go back to YOU (hole|cave)", "YOU people? (make|makes) me (sick|vomit|puke)")
    # threats, and wishes of harm
    .add(
        "abusive", 0.9,
        "(hope|wish|pray|want|hoffe|wuensche|espero|deseo) (that|all|to|see|for|dass|que)* YOU .{0,4} HARM", "ojala (te|os|YOU)? HARM", "YOU (souhaite|desire) (de)? HARM", "make YOU HARM", "SELF? WILL .{0,3} (KILL|END) YOU", "(SELF|LEAD&KILL|WILL|te|YOU) KILL YOU (EOS|all|NAMED|YOU|if|tomorrow|tonight|soon|in)", "(YOU) KILL EOS",
        "(SELF|WILL|ll|gonna) .{0,3} HURT YOU BODY", "WILL .{0,2} HURT YOU (alive|EOS|up)", "LEAD&KILL (yourself|yourselves)", "SELF? WILL (find|come|hunt|know|track) .{0,3} where YOU live", "SELF know where YOU live", "(better|happier) .{0,3} (if YOU were dead|if YOU died|if YOU COP dead|without YOU EOS)", "go (HARM|KILL) (somewhere|YOU|in|EOS|alone|NAMED)", "(va|vete|geh) (te|a|YOU)* HARM", "(eat|drink) .{0,2} and HARM",
        "YOU (MUST|should|deserve|to|all|really|just|be){1,4} (HARM|PUNISH|KILL)", "YOU MUST .{0,3} (HARM|PUNISH|KILL) (YOU|EOS|NAMED|in|for|like)", "(MUST|should|deserve) .{0,2} (HARM|KILL) YOU", "bring(e|en)? YOU um", "SELF? (bring|bringe|mach|mache) YOU (um|fertig|kalt|alle|platt)", "(vais|va|voy) (te|YOU|a)+ (KILL|HURT)",
    )
    # a group is degraded
    .add(
        "hateful", 0.9,
        "TRIBE .? COP (DET|so|de|again|also|really)* (DEGRADED|LIKENED)", "TRIBE (COP|EOS|DET|all)* (DEGRADED)", "TRIBE COP (DET|ALL)* SLUR", "(GROUP|DEMONYM) COP (DET|ALL|just|nur)* JUNK", "TRIBE (SCUM|VERMIN|INSULT|SLUR)", "BADNESS+ (GROUP|DEMONYM)", "TRIBE .* THEM COP .{0,2} (DEGRADED|LIKENED)", "TRIBE (are|sind|sont|son) (so|too|really|DET|all|just)* BADNESS+ (and|EOS)",
        "ANY COP (de|DET|ALL|just)* DEGRADED", "ANY THEM COP .{0,2} DEGRADED", "ALL DET? (PROPER|PLURAL&NAMED) COP (DET|ALL)* DEGRADED", "(TRIBE|ANY) (COP|do|does|should|will)* NEG (really|fully|even|all|count|as|be|considered|real|is|are)* HUMAN (EOS|beings|like|NAMED|and|at|to|for|in|anymore|anyway)",
        "TRIBE (breed|spread|multiply|vermehren|reproduisent|reproducen) (THEM)? (like|wie|comme|como) (VERMIN|BEASTS|JUNK)", "ANY (breed|spread|multiply) (like) (VERMIN|JUNK)", "TRIBE .? (VERMIN|SCUM)", "NAMED&PLURAL SCUM", "GROUP (は|が|も|なんて) (SCUM|INSULT)", "все . (SCUM|VERMIN)",
    )
    # its harm, expulsion or exclusion is called for
    .add(
        "hateful", 0.9,
        "(LEAD&KILL|LEAD&EXPEL|LEAD&END|LEAD&RID) (TRIBE|ALL DET? PROPER|THEM&them all)", "LEAD&EXPEL ANY", "LEAD&HARM (all)? TRIBE EOS", "(MUST|lets|gotta|WILL) .{0,4} (KILL|EXPEL|END|RID) (TRIBE|ANY)", "(TRIBE|ANY) .{0,3} MUST (all|be|just|have|to|etre|werden|ser){0,4} .{0,2} (PUNISH|HARM|KILL|EXPEL|deported|expelled|banned|sterilised|enslaved|removed|RID|AWAY|OUT)", "TRIBE (raus|dehors|go home|go back) (EOS|now|NAMED)", "(OUT|RID) (mit|con|avec|aux|los|les|a|DET)* (TRIBE|ANY|PLURAL)", "(LEAD&SEND|MUST SEND|SEND) (TRIBE|ALL ANY|ANY) (AWAY (EOS|to|where|NAMED)|to DET (bottom|camps|gallows|grave|hell|wall|sea)|to hell|into DET (sea|ocean|river))", "(LEAD&SEND|MUST SEND) (TRIBE|ANY) .{0,4} (bottom|camps|gallows)", "LEAD&no TRIBE (allowed|welcome|wanted)", "(TRIBE|ANY) (AWAY|OUT) (of|aus|de)? (our|my|unserem|unserer|notre|nuestro|PLACE)* PLACE", "NAMED raus aus .? PLACE",
        "keep (TRIBE|ANY|THEM) (AWAY|out) (of|from) (our|the|my|this|all|DET)* PLACE", "LEAD&NEG (ever|again)* SHUN (TRIBE|ANY)", "(should|must|would|will|can|could|LEAD&do) NEG (ever)? SHUN (TRIBE|ANY)", "(good|better|best|happy|beautiful|great|dream|perfect|nice|clean|safe) .* (without|free of|rid of|with no) (a|any|single)* TRIBE", "NEG want TRIBE in (DET|our)* PLACE", "(do|would|will|should|can) NEG (want|like|share|sit|live|eat|mix) .{0,5} with TRIBE EOS", "(gas|hang|lynch) DET? TRIBE", "(LEAD&burn|LEAD&bomb|LEAD&torch|LEAD&smash|LEAD&destroy|MUST (burn|bomb|torch|destroy)) (ALL|DET|THEM|down)* (mosque|mosques|synagogue|synagogues|temples)", "(death|mort|muerte|tod) (to|a|aux|den|los)* (DET)? (TRIBE|ANY)", "(вон|долои) GROUP", "(убить|выгнать) (всех)? GROUP", "GROUP .{0,2} OUTWARD",
    )
    # the same of a group named before
    .add(
        "hateful", 0.6,
        "(TRIBE|ANY) .* (RID|LEAD&EXPEL|LEAD&KILL|LEAD&END) (THEM|all)*", "(TRIBE|ANY) .* (raus|weg) mit THEM", "(TRIBE|ANY) .* hay que EXPEL", "(TRIBE|ANY) .* MUST .{0,3} (RID|EXPEL|PUNISH)", "(TRIBE|ANY) .* LEAD&burn THEM HOMES", "(TRIBE|ANY) .* LEAD&OUT EOS", "(TRIBE) .* THEM (SCUM|VERMIN) (spreads|spread|everywhere|EOS)",
    )
    # sex, by the sum of what the clause holds
    .add("lewd", 0.4, "LEWD")
    .add("lewd", 0.6, "(free|gratis|watch|kostenlos|gratuit) LEWD")
    .add("lewd", 0.3, "SEXUAL")
    .add("lewd", 0.15, "CARESS")
    .add("lewd", 0.1, "HINT")
)
STAGES = (TARGETS, JUDGEMENTS)
LAST = Transducer([*CONTEXT.rules, *CLAUSES.rules])

# fixed values: look-alike characters
LEET = str.maketrans({"$": "s", "@": "a", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "i", "+": "t", "€": "e", "8": "b", "9": "g"})
ALIKE = str.maketrans("аеорсухіїјѕԁһαεορτυνικӏ", "aeopcyxiijsdhaeoptuvikl")
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…¿¡*_~`-–—�"
ENDS = re.compile(r"[.!?…]+[\"'”’)»]*$|[。！？]")
RUNS = re.compile(r"(.)\1{2,}")
PAIRS = re.compile(r"(.)\1+")
PAIRS_OR_ONE = re.compile(r"(.)\1*")
_ONE = r"(?=\S)[^\w\s]*+_*+[^\w\s]*+\w?+[^\w\s]*+"
SINGLES = re.compile(rf"(?<!\S){_ONE}(?:\s++{_ONE}){{2}}(?!\S)")  # three single characters in a row
NUMBERED = re.compile(r"[^\W\d]\d{2,}$|^\d{2,}\W?[a-z]{0,2}$")  # user names and article numbers are no disguise
STARRED = re.compile(r"f[*#@$%!_\-]{2,}(k|ck|ing|cking|er|cker)?!*")
SENTENCE = ".,;:?\"'()[]{}<>«»„“”‘’…¿¡"
INNER = re.compile(r"[^\w]|_")
MASKED = re.compile(r"[.*#_\-+%&?�]+")
MASKED_OR_NOT = re.compile(r"[.*#_\-+%&?�]+|[^.*#_\-+%&?�]+")
JOINERS = frozenset(".-+&?")
# ordinary words of the four languages that doubled letters alone tell from words of the lexicon
ORDINARY = frozenset("anne bitte bocca butter fills finnish gross looser loosers madden magots morron morros pettit pollen raten rooms root roten saale salle soon staab striping".split())
UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
CARRIERS = ("LEWD", "SEXUAL")  # without one of them a clause isn't about sex
#: Labels by the place of a token in its clause.
PLACED = frozenset({"LEAD", "PROPER", "EOS"})
#: How common labels are; HARM holds the German article "die".
COMMON = dict.fromkeys("LEAD PROPER EOS".split(), 1000) | dict.fromkeys("YOU COP DET ALL NEG SELF HE THEM HINT CLINIC NAMED PLURAL PEOPLE OTHER ANY AWAY".split(), 100)
COMMON |= {"HARM": 50, "MUST": 60, "WILL": 60, "TRIBE": 45, "DEMONYM": 40, "GROUP": 10, "PLACE": 40, "SEND": 30, "BODY": 30, "SPEAK": 30}
#: Classes whose words are too short or common to be looked for behind disguises.
PLAIN = frozenset("DET COP HINT YOU CLINIC ALL NEG SELF HE THEM MUST WILL NOBODY AWAY OUT SEND SHUN PLACE HOMES KIN SHAME THING SPEAK STAFF PENALTY WORD HUMAN BODY VANISH HURT BEASTS LOWER CARESS INTENS FIGURE".split())
#: Endings of plural demonyms.
DEMONYMS = ("i", "is", "ans", "ians", "ites", "ese", "ers", "ish", "ards", "ois", "iens", "anos", "inos", "enses")
UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
CUTS = re.compile("|".join(sorted({w for text in JAPANESE.values() for w in text.split()}, key=lambda w: (-len(w), w))))
NOTHING: Labels = frozenset()
OUTSIDE: Labels = frozenset({"OTHER"})


def folded(token: str) -> str:
    """Lower case without marks, compatibility and format characters; look-alike letters become Latin ones."""
    if token.isascii():
        return token.lower()
    if "Ã" in token or "Â" in token:
        try:
            token = token.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    text = "".join(c for c in unicodedata.normalize("NFKD", token) if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    text = text.casefold()
    if not text.isascii() and any("a" <= c <= "z" for c in text):
        text = text.translate(ALIKE)
    return text


def outside(token: str) -> Labels:
    """The labels of a word that the lexicon doesn't hold, by its form."""
    core = token.strip(EDGES)
    if len(core) < 3 or not core.isalpha():
        return OUTSIDE
    named, plural, folk = core[0].isupper() and (core[1:].islower() or core.isupper()), core[-1] in "sSxX", core.lower().endswith(DEMONYMS)
    return OUTSIDE | {x for x, holds in (("NAMED", named), ("PLURAL", plural), ("PEOPLE", named and plural), ("DEMONYM", named and folk and len(core) > 4)) if holds}


class Gate:
    """Which clauses are worth reading, from the rules themselves.

    A rule can match only a clause that holds a label of each set of ``Pattern.needs``, be it of a token or written by
    an earlier stage that can match. ``hot`` has one such set of each rule; a clause without a hot token scores 0.
    """

    def __init__(self, phrases: Transducer):
        self.writers = [r for stage in (phrases, *STAGES) for r in stage.rules]
        self.deciding = [r for r in CLAUSES.rules if r.name != "lewd" or not r.pattern.first.isdisjoint(CARRIERS)]
        self.hot: set[str] = set().union(*(self.key(r) for r in self.deciding))
        waiting = list(self.writers)
        while ready := [r for r in waiting if not r.output.isdisjoint(self.hot)]:
            waiting = [r for r in waiting if r not in ready]
            self.hot.update(*(self.key(r) for r in ready))
        known = sorted(set().union(PLACED, *(n for r in (*self.writers, *self.deciding) for n in (*r.pattern.needs, r.output))))
        self.bit = {x: 1 << k for k, x in enumerate(known)}
        self.placed = self.bits(PLACED)
        self.writing = [(self.bits(r.output), *self._asked(r)) for r in self.writers]
        self.judging: dict[int, list[tuple[int, list[int]]]] = {}  # by each label of the rule's key
        for r in self.deciding:
            for x in self.key(r):
                self.judging.setdefault(self.bit[x], []).append(self._asked(r))
        self.keyed = sum(self.judging)

    @staticmethod
    def key(rule: Rule) -> Labels:
        """The needed set that texts are least likely to hold."""
        return min(rule.pattern.needs, key=lambda need: sum(COMMON.get(x, 1 if x.isupper() else 20 / len(x)) for x in need))

    def bits(self, labels: Labels | set[str]) -> int:
        """The set of those labels that rules ask for, as bits."""
        return sum(self.bit[x] for x in labels if x in self.bit)

    def _asked(self, rule: Rule) -> tuple[int, list[int]]:
        """The labels that the rule needs for certain, and the sets of which it needs one."""
        needs = [self.bits(need) for need in rule.pattern.needs]
        return sum({n for n in needs if n.bit_count() == 1}), [n for n in needs if n.bit_count() > 1]

    def opens(self, held: int) -> bool:
        """Whether some rule that decides can match a clause that holds these labels."""
        held |= self.placed
        for output, all_of, one_of in self.writing:
            if output & ~held and held & all_of == all_of and all(held & n for n in one_of):
                held |= output
        ready = held & self.keyed
        while ready:
            bit = ready & -ready
            ready ^= bit
            for all_of, one_of in self.judging[bit]:
                if held & all_of == all_of and all(held & n for n in one_of):
                    return True
        return False


class Lexer:
    """The lexical transducer: surface token -> labels, through all spellings that a reader would see through."""

    def __init__(self, groups: tuple[str, ...] = ()):
        self.labels: dict[str, set[str]] = {}
        for label, text in [*CLASSES.items(), ("GROUP", GROUPS), *RUSSIAN.items(), *JAPANESE.items()]:
            for w in text.split():
                self.labels.setdefault(w if UNSPACED.search(w) else folded(w), set()).add(label)
        self.phrases = Transducer(list(PHRASES.rules))
        for g in groups:
            parts = folded(g).split()
            if len(parts) == 1:
                self.labels.setdefault(parts[0], set()).add("GROUP")
            else:
                self.phrases.add("group", 1.0, " ".join(parts), output="GROUP")
        content = {w for w, of in self.labels.items() if not of <= PLAIN} | {w for w in self.phrases.words() if len(w) > 4}
        for w in set().union(*(stage.words() for stage in (self.phrases, *STAGES, LAST))):
            self.labels.setdefault(w, set())
        self.fuzzy: dict[str, tuple[str, ...]] = {}
        self.masked: dict[str, list[str]] = {}
        for w in sorted(content | {w for w in self.labels if len(w) > 4}):
            if len(w) >= 3 and (not self.labels[w] or not self.labels[w] <= PLAIN):
                self.masked.setdefault(w[0], []).append(w)
                for i in range(1, len(w)):
                    hole = w[:i] + "?" + w[i + 1 :]
                    self.fuzzy[hole] = (*self.fuzzy.get(hole, ()), w)
        self.longest = max(map(len, self.labels))
        self.single = {PAIRS.sub(r"\1", w): w for w in sorted(content) if len(w) >= 3}
        self.doubled: dict[str, list[str]] = {}
        for w in sorted(content):
            if len(w) >= 3:
                self.doubled.setdefault(PAIRS.sub(r"\1", w), []).append(w)
        self.gate = Gate(self.phrases)
        self.memo: dict[str, tuple[Labels, bool, bool, int]] = {}
        self.cold: set[str] = set()
        self.frozen = {w: frozenset(v) | {w} for w, v in self.labels.items()}

    def words(self, token: str) -> tuple[str, ...]:
        """The lexicon words that ``token`` may spell; more than one only where a letter is masked."""
        if UNSPACED.search(token):
            return (token,) if token in self.labels else ()
        plain = folded(token).strip(EDGES)
        if plain in self.labels:
            return (plain,)
        if STARRED.fullmatch(folded(token).strip(SENTENCE)):
            return ("fuck",)
        if not token.isascii():
            umlauts = folded(unicodedata.normalize("NFC", token).lower().translate(UMLAUTS)).strip(EDGES)
            if umlauts in self.labels:
                return (umlauts,)
        if plain.isalpha() and plain.isascii() and not RUNS.search(plain):
            return self.redoubled(plain)
        if not plain or NUMBERED.search(plain) or not any(c.isalpha() for c in plain):
            return ()
        raw = folded(token).strip(SENTENCE)
        tries = [raw, raw.rstrip("!")]
        for leet in (raw.translate(LEET), raw.rstrip("!").translate(LEET), raw.replace("1", "l").translate(LEET)):
            tries.append(leet)
        for t in tries:
            joined = INNER.sub("", t)
            if joined in self.labels and not joined.isdigit() and len(joined) > 1 and (self.labels[joined] or len(joined) > 3 or set(t) - set(joined) <= {"-", "_"}):
                return (joined,)
            if RUNS.search(joined):
                for u in (RUNS.sub(r"\1", joined), RUNS.sub(r"\1\1", joined)):
                    if u in self.labels:
                        return (u,)
                if (u := PAIRS.sub(r"\1", joined)) in self.single:
                    return (self.single[u],)
        if (tail := re.split(r"['’]", plain)[-1]) != plain and tail in self.labels and len(tail) > 2:
            return (tail,)  # an elided article
        for t in (raw, raw.rstrip("!"), raw.translate(LEET)):
            for u in (t, RUNS.sub(r"\1", t)):
                holes = MASKED.findall(u)
                if len(holes) == 1 and (w := self.fuzzy.get(MASKED.sub("?", u))):
                    return w
                if holes and (w := self.unmasked(u)):
                    return w
        return ()

    def redoubled(self, plain: str) -> tuple[str, ...]:
        """The word whose letters ``plain`` doubles, or from five letters on also writes once instead of twice."""
        if plain in ORDINARY:
            return ()
        once = PAIRS.sub(r"\1", plain)
        for w in self.doubled.get(once, ()):
            runs = zip(PAIRS_OR_ONE.finditer(plain), PAIRS_OR_ONE.finditer(w))
            if len(once) >= 5 or all(len(a.group()) >= len(b.group()) for a, b in runs):
                return (w,)
        return ()

    def unmasked(self, token: str) -> tuple[str, ...]:
        """The words that fit the letters of ``token``: the first and at least one more.

        A masked run stands for as many letters as it is long, else for fewer, or, if half of the word's letters are
        written, a run of stars for any number.
        """
        letters = MASKED.sub("", token)
        if len(letters) < 2 or len(letters) > self.longest or not letters.isalpha() or not token[0].isalpha():
            return ()
        words = [w for w in self.masked.get(token[0], ()) if len(w) > len(letters)]
        parts = MASKED_OR_NOT.findall(token)
        if sum(map(bool, map(MASKED.fullmatch, parts))) > 1 and not JOINERS.isdisjoint(token):
            return ()  # abbreviations and compounds
        for many in (".{%d}", ".{1,%d}"):
            fits = re.compile("".join(many % len(p) if MASKED.fullmatch(p) else p for p in parts))
            if found := tuple(w for w in words if fits.fullmatch(w)):
                return found
        if set(token) - set(letters) <= {"*", "#"}:
            fits = re.compile("".join(".+" if MASKED.fullmatch(p) else p for p in parts))
            return tuple(w for w in words if 2 * len(letters) >= len(w) and fits.fullmatch(w))
        return ()

    def look(self, token: str) -> tuple[Labels, bool, bool, int]:
        """(labels, whether a clause with it is worth reading, whether the clause ends here, the labels as the gate's bits)."""
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            labels = frozenset().union(*(self.frozen[w] for w in self.words(token))) or outside(token)
            found = self.memo[token] = (labels, not self.gate.hot.isdisjoint(labels), bool(ENDS.search(token)), self.gate.bits(labels))
        return found

    def quiet(self, tokens: list[str]) -> bool:
        """Whether no token makes a clause worth reading: no hot word, and no letter that stands alone and may be part of one."""
        if self.cold.issuperset(tokens):
            return True
        if len(self.cold) > 400_000:
            self.cold.clear()
        quiet = True
        for t in set(tokens).difference(self.cold):
            plain = folded(t).strip(EDGES)
            if self.look(t)[1] or len(plain) == 1 and plain.isalpha() and plain not in "aeiouy":
                quiet = False
            else:
                self.cold.add(t)
        return quiet

    def spaced(self, tokens: list[str]) -> list[str]:
        """Runs of three or more single letters read as the lexicon words that they spell."""
        out: list[str] = []
        i = 0
        while i < len(tokens):
            j = i
            while j < len(tokens) and (len(letter := folded(tokens[j]).strip(EDGES)) == 1 and not letter.isdigit() or j > i and not letter and len(tokens[j]) == 1):
                j += 1
                if letter and tokens[j - 1][-1] in ".,!?;:" and j - i >= 3:
                    break
            if j - i < 3:
                out.append(tokens[i])
                i += 1
                continue
            text = "".join(folded(t).strip(EDGES) for t in tokens[i:j]).translate(LEET)
            # the split into known words with the largest sum of squared lengths
            best: list[tuple[int, int]] = [(0, 0)] * (len(text) + 1)
            for k in range(len(text) - 1, -1, -1):
                sizes = [n for n in range(2, min(len(text) - k, self.longest) + 1) if text[k : k + n] in self.labels]
                best[k] = max([(best[k + 1][0], 1), *((best[k + n][0] + n * n, n) for n in sizes)])
            k = 0
            while k < len(text):
                out.append(text[k : k + best[k][1]])
                k += best[k][1]
            out[-1] += tokens[j - 1].lstrip(tokens[j - 1].strip(EDGES)) if out else ""
            i = j
        return out


class Scorer:
    """Scores texts; ``score`` gives (abusive, hateful, sexual), each in 0..1."""

    def __init__(self, groups: tuple[str, ...] = ()):
        self.lexer = Lexer(groups)

    @staticmethod
    def placed(tokens: list[str], labels: list[Labels]) -> list[Labels]:
        """Labels by place: LEAD starts the clause or follows a comma or colon; PROPER is a name in mixed case inside it; EOS ends it."""
        mixed = any(t[:1].islower() and len(t) > 2 for t in tokens)
        out, lead = [], True
        for k, (token, one) in enumerate(zip(tokens, labels)):
            out.append(one | ({"LEAD"} if lead else frozenset()) | ({"PROPER"} if mixed and k and "NAMED" in one else frozenset()))
            lead = token[-1:] in ",;:-–—" or token[-1:] == "…"
        return [*out, frozenset({"EOS"})]

    def clause(self, tokens: list[str], labels: list[Labels]) -> tuple[float, float, float]:
        lattice = compose(self.placed(tokens, labels), self.lexer.phrases, *STAGES)
        found = LAST.score(lattice)
        lewd = found.get("lewd", 0.0) - 0.5 * any("CLINIC" in x for x in labels)
        carries = any(not x.isdisjoint(CARRIERS) for x in labels)
        return found.get("abusive", 0.0), found.get("hateful", 0.0), lewd if carries else 0.0

    def score(self, text: str | None) -> tuple[float, float, float]:
        """Sentences are read line by line, and those that run on over line breaks also as a whole."""
        top = [0.0, 0.0, 0.0]
        if text and not text.isascii() and UNSPACED.search(text):
            text = CUTS.sub(r" \g<0> ", unicodedata.normalize("NFKC", text).replace("。", "。 "))
        if not text or self.lexer.quiet(text.split()):
            return tuple(top)
        look, opens = self.lexer.look, self.lexer.gate.opens

        def read(tokens: list[str], labels: list[Labels], held: int, across: bool = False) -> None:
            if opens(held):
                for i, s in enumerate(self.clause(tokens, labels)[: 2 if across else 3]):
                    top[i] = max(top[i], s)

        run: tuple[list[str], list[Labels]] = ([], [])  # a sentence that runs on over line breaks
        lines, warm, seen = 0, False, 0
        for line in text.splitlines():
            tokens = line.split()
            if SINGLES.search(line):
                tokens = self.lexer.spaced(tokens)
            words, labels, hot, held = [], [], False, 0
            for k, token in enumerate(tokens):
                one, is_hot, ends, bits = look(token)
                words.append(token)
                labels.append(one)
                hot |= is_hot
                held |= bits
                last = k + 1 == len(tokens)
                if ends or last:
                    if hot:
                        read(words, labels, held)
                    if run[0] or last and not ends:
                        run[0].extend(words)
                        run[1].extend(labels)
                        lines, warm, seen = lines + 1, warm or hot, seen | held
                    if ends and run[0]:
                        if warm and lines > 1:
                            read(*run, seen, across=True)
                        run, lines, warm, seen = ([], []), 0, False, 0
                    words, labels, hot, held = [], [], False, 0
            if not tokens and run[0]:
                if warm and lines > 1:
                    read(*run, seen, across=True)
                run, lines, warm, seen = ([], []), 0, False, 0
        if warm and lines > 1:
            read(*run, seen, across=True)
        return tuple(min(1.0, max(0.0, round(s, 4))) for s in top)


SCORES = "abusive double, hateful double, sexual double"


def content_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), groups: tuple[str, ...] = ()
) -> DataFrame:
    """(id, kept columns, abusive, hateful, sexual, score, flagged) of every row.

    Null, empty and blank texts score 0; repeated rows are scored as often as they are stored; a null id stays null;
    ``groups`` are further names of groups of people;
    very long texts are read whole; other columns are not read. One narrow stage without a shuffle.
    """
    picked = spread(docs.select(docs[text_col].alias("_text"), docs[id_col].alias("_id"), *(docs[c].alias(f"_k{i}") for i, c in enumerate(keep))))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(groups)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                scores = list(zip(*map(scorer.score, texts[a:b])))
                others = [c.slice(a, b - a) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*others, *(pa.array(s, pa.float64()) for s in scores)], names=[*batch.schema.names[1:], "abusive", "hateful", "sexual"])

    scored = picked.mapInArrow(run, ", ".join([*kinds, SCORES]))
    names = {"_id": id_col} | {f"_k{i}": c for i, c in enumerate(keep)}
    score = F.greatest("abusive", "hateful", "sexual")
    return scored.withColumns({"score": score, "flagged": score >= THRESHOLD}).withColumnsRenamed(names)
