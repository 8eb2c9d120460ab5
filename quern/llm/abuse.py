"""Problem 10: abusive, hateful and sexually explicit text.

The lexicon is a trie of folded terms. Each distinct token of the corpus is run against it once in a worker: a Levenshtein
automaton of the token, intersected with the trie, gives the terms within one edit (terms of four letters or more), or two
(of eight or more), after look-alike digits and signs, repeated letters and letters written apart are folded; an asterisk
stands for any letter. A token that the corpus has more often than the term is a word of its own and no misspelling; tokens
near a term are counted over all documents for that.

Context windows separate quotation and neutral mention from abuse. A sentence with a hit is scored by classes of words and
how they stand to each other: insults count where they address or name somebody; verbs of violence where a person or a part
of the body follows within a few words; wishes of death or absence where they are aimed at a person; dehumanising words
and demands where they are said of a group; explicit words by their sum. Quotation marks around a term, reported speech and
harmless compounds take away. Word sequences of the labelled sample that only its harmful texts hold get a weight from
their number there (fit_sequences). The score of a text is that of its worst sentence; from 1 it is a case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import lookalike
from quern.llm import textblocks as tb

THRESHOLD, LEAST = 1.0, 0.3

# Lexicon. Terms are folded (lower case, no accents); words of a phrase are divided by underscores.
INSULTS = """
idiot idiots moron bastard asshole arsehole shithead shitbag scumbag dumbass jackass dickhead douchebag fuckwit halfwit dimwit cretin imbecile loser wanker prick cunt bitch whore slut retarded
motherfucker twat worm maggot clown pig swine scum piece_of_shit pathetic_worm waste_of_space waste_of_oxygen muppet pillock bellend tosser weirdo creep freak simpleton dunce numpty nitwit airhead lowlife degenerate son_of_a_bitch sack_of_shit
arschloch vollidiot wichser hurensohn schlampe missgeburt drecksau trottel spast fotze idioten depp penner miststuck schwachkopf abschaum
imbecile connard connasse salope encule batard abruti ordure cretine debile fils_de_pute sac_a_merde
imbecil gilipollas cabron pendejo hijo_de_puta mierda puta zorra estupido subnormal maricon capullo
coglione stronzo bastardo cretino deficiente idiota troia pezzo_di_merda testa_di_cazzo figlio_di_puttana
lixo otario babaca cuzao filho_da_puta desgracado vadia burro arrombado
klootzak idioot eikel kutwijf hoer mongool debiel sukkel lul trut
идиот урод мразь сволочь дебил тварь ублюдок сука дурак придурок кретин гнида тупица скотина подонок мудак
""".split()
DEGRADING = """
pathetic worthless stupid filthy disgusting damned fucking brainless braindead idiotic dumb vile wretched useless miserable absolute complete utter ugly fat
dumm dummes dummer dreckiger widerlicher erbarmlicher verdammter pauvre sale espece stupide maudit maldito asqueroso estupido
schifoso maledetto stupido inutile nojento maldita achterlijke vuile domme stomme smerige тупой жалкий грязный мерзкий проклятый вонючий
""".split()
PERSON = """
you your yours yourself u du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous eres ti usted tus sei tuo seu sua voce
je jij jou jouw bent u ты тебя тебе твой твоя твои вы
""".split()
GROUPS = """
immigrants refugees foreigners migrants women muslims jews christians gays lesbians blacks whites gypsies asians africans believers homosexuals disabled
auslander fluchtlinge migranten frauen juden muslime zigeuner etrangers immigres refugies femmes juifs musulmans extranjeros inmigrantes mujeres judios refugiados
stranieri immigrati donne ebrei estrangeiros imigrantes mulheres judeus buitenlanders vluchtelingen vrouwen joden moslims иностранцы мигранты женщины евреи они их
""".split()
DEHUMAN = """
vermin rats cockroaches parasites disease plague subhuman subhumans cleanse inferior animals filth savages leeches
ungeziefer ratten parasiten verjagt vermine parasites rats dehors ratas parasitos echarlos escoria parassiti cacciati vermi vermes parasitas
ongedierte parasieten паразиты паразитов гнать крысы нелюди
""".split()
# demands against groups
EXPEL = """
deport exterminate eradicate expel drive_out driven_out lock_up throw_out kick_out get_rid_of wipe_out no_place_for do_not_deserve not_human not_people breed_like by_blood their_kind in_their_nature away_from_our go_back_to never_hire once_and_for_all leave_or_die good_thing_about
raus_mit gehoren_alle_aus dehors_les hay_que_echarlos moeten_weg devem_sair vanno_cacciati гнать_их
""".split()
VIOLENCE = """
kill murder stab slit break smash shoot burn choke strangle beat cut rape hang hurt hunt crush gut skin punch drown poison find slap
""".split()
INTENT = "will gonna going ll shall want wanna hope someone somebody should must can let come may".split()
BODY = "throat neck legs fingers face head skull bones teeth arms knees eyes words tongue house family sleep".split()
ABSENCE = "die dead disappear vanish vanished disappeared drop gone perish rot born crawl miss missed".split()
WISH = "hope wish nobody noone no everyone favour favor better should please day".split()
SHUT = """
shut_up shut_your go_to_hell drop_dead get_lost kill_yourself rot_in_hell burn_in_hell choke_on_your know_where_you_live piss_off fuck_off fuck_you screw_you should_be_ashamed brains_were under_your_rock ever_let_you
halt_die_fresse halt_die_klappe verpiss_dich ta_gueule va_te_faire te_deteste vete_al_infierno callate_ya sta_zitto stai_zitto vaffanculo cala_a_boca vai_se_foder desaparece_daqui hou_je_bek rot_op убирайся_отсюда заткнись пошел_вон
""".split()
# terms with weights: explicit or pornographic, or an offer
SEXUAL = {
    "porn": 0.7, "porno": 0.6, "pornos": 0.7, "hardcore": 0.5, "horny": 0.7, "nude": 0.5, "nudes": 0.7, "naked": 0.45, "xxx": 0.4, "orgy": 0.8, "blowjob": 1.0, "cumshot": 1.0, "tits": 0.6, "boobs": 0.6, "pussy": 0.7, "dildo": 0.8, "cumming": 0.9, "masturbate": 0.6,
    "uncensored": 0.4, "fuck": 0.6, "fucks": 0.6, "fucked": 0.5, "singles": 0.25, "webcam": 0.2, "cam": 0.2, "amateurs": 0.25, "leak": 0.3, "breasts": 0.45, "moaned": 0.5, "kissed": 0.15, "erotic": 0.5, "escort": 0.4, "escorts": 0.5, "topless": 0.5, "hookup": 0.5, "live": 0.1,
    "sex_tape": 0.8, "dirty_pictures": 0.5, "wet_fantasies": 0.6, "adults_only": 0.3, "no_strings": 0.5, "bare_breasts": 0.6, "inside_me": 0.5, "of_your_body": 0.5, "rode_him": 0.6, "rode_her": 0.6, "strip_show": 0.5,
    "both_came": 0.5, "tore_off": 0.3, "his_belt": 0.4, "hot": 0.2, "wives": 0.15, "lonely": 0.15, "taste": 0.15, "tonight": 0.1,
    "nackte": 0.6, "heisse": 0.3, "geile": 0.7, "sexchat": 0.8, "ficken": 0.9, "nues": 0.5, "chaudes": 0.5, "gratuites": 0.1, "baise": 0.6, "desnudas": 0.6, "calientes": 0.5, "follar": 0.8, "gratis": 0.1,
    "nuda": 0.4, "calde": 0.4, "scopare": 0.8, "nuas": 0.5, "peladas": 0.6, "quentes": 0.4, "safadas": 0.8, "naakte": 0.6, "hete": 0.4, "neuken": 0.9, "порно": 0.7, "голые": 0.6, "секс": 0.5, "горячие": 0.4, "шлюхи": 0.8,
}
# what makes a hit harmless: reported speech and talk about words, within the sentence
REPORTING = """
called condemned fined removed rule posts remarks word names label labelled meaning term quoted court banned reported denounced accused policy
nannte verurteilt wort bezeichnete condamne traite mot llamo condeno palabra condannato parola chamou condenou palavra noemde veroordeeld woord назвал осудил слово
""".split()
# fields in which the terms are neutral: biology, medicine, techniques, figures of speech
NEUTRAL = """
naked_eye naked_truth naked_mole sex_education sexual_reproduction idiot_proof fool_proof such_as_rats rats_got lab_rats zombie_process child_process kill_the_process stop_the adults_only_the stupid_bug felt_stupid hell_of_a bastard_names xxx_with species gene virus patients infection
""".split()
COMMON = """
you your to the a of and if were not in like be for at all every know go up no out should that day by me te de que uit dich back where is once would will let ever near it any their they are our from watch place
with him her se al alle aus va op je ya i an as this what who must everyone here has have had do does did on only could der die das und ist hier jeder le la les et un une est tout le_monde el los las y son es het een en zijn o os e da
""".split()

LEET = str.maketrans("0134578@$!|€", "oieastbasiie")
TOKEN = re.compile(r"[^\W_]+(?:[@$*!'’-]+[^\W_]+)*[*$]*|[@$*][^\W_]+(?:[@$*!-]*[^\W_]+)*")


@lru_cache(100_000)
def fold(token: str) -> str:
    """Lower case without accents; digits and signs that stand for letters, where there are letters too; letters written apart by hyphens
    joined; a letter three times or more once."""
    if token.isascii() and token.isalpha():
        return re.sub(r"(.)\1{2,}", r"\1", token.lower())
    token = "".join(c for c in unicodedata.normalize("NFD", token.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    if any(c.isalpha() for c in token) and not token.isalpha():
        if re.fullmatch(r"(?:\w[-.])+\w", token):
            token = re.sub(r"[-.]", "", token)
        token = token.translate(LEET)
    return re.sub(r"([^*])\1{2,}", r"\1", token)


def deletions(cps: np.ndarray, offs: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, index of the string) of every string with 0, then 1, up to most (2) characters taken out."""
    n = np.diff(offs)
    at = np.arange(len(cps)) - np.repeat(offs[:-1], n)
    up, down = tb.powers(int(n.max(initial=0)) + 3)
    with np.errstate(over="ignore"):
        value = tb.mix(cps.astype(np.uint64) + np.uint64(1)) * up[at]
        sums = []  # beginnings' sums, with what follows moved by 0, 1, 2 places
        for shift in range(most + 1):
            total = np.zeros(len(cps) + 1, np.uint64)
            np.cumsum(value * down[shift], out=total[1:])
            sums.append(total)
        start, end = offs[:-1], offs[1:]
        whole = np.arange(len(n))
        yield tb.mix(sums[0][end] - sums[0][start]), whole
        owner = np.repeat(whole, n)
        i = np.arange(len(cps))
        yield tb.mix(sums[0][i] - sums[0][start[owner]] + sums[1][end[owner]] - sums[1][i + 1]), owner
        if most == 2:
            rest = end[owner] - i - 1
            k = tb.expand(i + 1, rest)
            i, owner = np.repeat(i, rest), np.repeat(owner, rest)
            yield tb.mix(sums[0][i] - sums[0][start[owner]] + sums[1][k] - sums[1][i + 1] + sums[2][end[owner]] - sums[2][k + 1]), owner


class Trie:
    """Folded single terms. near(token) gives the terms within the number of edits that their length allows, in order of distance."""

    def __init__(self, terms):
        self.root: dict = {}
        self.terms = frozenset(terms)
        self.longest = max(map(len, self.terms), default=0)
        for term in self.terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        # strings within k edits share a form with at most k characters taken out
        self.keys = []
        for k in (1, 2):
            chosen = sorted(t for t in self.terms if self.edits(t) == k)
            cps, offs = tb.codepoints(pa.array(chosen, pa.string()))
            self.keys.append(np.unique(np.concatenate([h for h, _ in deletions(cps, offs, k)])) if chosen else np.zeros(0, np.uint64))

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 4 else 1 if len(term) < 8 else 2

    def possible(self, tokens: list[str]) -> np.ndarray:
        """Which tokens a term can be near: sure to hold for every term that is near."""
        out = np.array([t in self.terms or "*" in t for t in tokens], bool)
        for k in (1, 2):
            rows = [i for i, t in enumerate(tokens) if 4 * k - (k == 2) * 2 <= len(t) <= self.longest + 2]
            if not rows or not len(self.keys[k - 1]):
                continue
            cps, offs = tb.codepoints(pa.array([tokens[i] for i in rows], pa.string()))
            rows = np.array(rows)
            for h, owner in deletions(cps, offs, k):
                where = np.minimum(np.searchsorted(self.keys[k - 1], h), len(self.keys[k - 1]) - 1)
                out[rows[owner[self.keys[k - 1][where] == h]]] = True
        return out

    def near(self, token: str) -> list[tuple[str, int]]:
        if token in self.terms:
            return [(token, 0)]
        if "*" in token:
            nodes = [self.root]
            for t in token:
                nodes = [child for node in nodes for c, child in node.items() if c and (t == "*" or t == c)]
            return sorted((node[""], 0) for node in nodes if "" in node)
        if len(token) < 4 or not self.possible([token])[0]:
            return []
        # the automaton's state after a path of the trie is the row of distances from the path to all beginnings of the token
        out: dict[str, int] = {}
        n = len(token)
        stack = [(self.root, "", None, list(range(n + 1)))]
        while stack:
            node, letter, before, row = stack.pop()
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (token[j - 1] != c))
                    if before is not None and j > 1 and token[j - 1] == letter and token[j - 2] == c:
                        v = min(v, before[j - 2] + 1)
                    new.append(v)
                if "" in child and 0 < new[n] <= self.edits(child[""]) and self.plausible(child[""], token):
                    out[child[""]] = new[n]
                if min(new) <= 2:
                    stack.append((child, c, row, new))
        return sorted(out.items(), key=lambda x: (x[1], x[0]))

    @staticmethod
    def plausible(term: str, token: str) -> bool:
        """Short terms have many neighbours: below six letters the first letter stays, and no letter is changed for another."""
        return len(term) >= 6 or (token[0] == term[0] and (len(token) != len(term) or sorted(token) == sorted(term)))


@lru_cache(1)
def lexicon() -> dict:
    single: dict[str, list] = {}
    multi: dict[str, list] = {}
    terms = [(t, "i", 1.0) for t in INSULTS] + [(t, "d", 1.0) for t in DEGRADING] + [(t, "h", 1.0) for t in DEHUMAN] + [(t, "e", 1.0) for t in EXPEL] + [(t, "x", 1.0) for t in SHUT] + [(t, "s", w) for t, w in SEXUAL.items()]
    for t, kind, weight in terms:
        t = " ".join(fold(x) for x in t.split("_"))
        (multi if " " in t else single).setdefault(t, []).append((kind, weight))
    masked = {t: e for t, e in multi.items() if any(k == "i" for k, _ in e)}  # an asterisk may stand for the space
    aimed = {fold(x) for x in (*VIOLENCE, *ABSENCE)}
    common = {fold(x) for x in COMMON}
    # what a word can add to a sentence's score: a term, the rarest word of a phrase; degrading words add to others only. Verbs that are aimed
    # at somebody tell where a person is near
    telling = {t: max(1.0 if k != "s" else w for k, w in e if k != "d") for t, e in (single | masked).items() if any(k != "d" for k, _ in e)}
    starts: dict[str, list] = {}
    for phrase in multi:
        words = phrase.split(" ")
        telling[max([w for w in words if w not in common] or words, key=len)] = 1.0
        starts.setdefault(words[0], []).append((words, multi[phrase]))
    folded = lambda words: frozenset(fold(x) for x in words)
    neutral: dict[str, list] = {}
    for phrase in NEUTRAL:
        words = [fold(x) for x in phrase.split("_")]
        neutral.setdefault(words[0], []).append(words)
    return {
        "single": single | masked, "starts": starts, "trie": Trie(set(single) | set(masked)), "person": folded(PERSON), "groups": folded(GROUPS), "reporting": folded(REPORTING), "scoring": frozenset((*single, *masked, *starts)), "violence": folded(VIOLENCE), "intent": folded(INTENT),
        "body": folded(BODY), "absence": folded(ABSENCE), "wish": folded(WISH), "telling": telling, "aimed": frozenset(aimed), "neutral": neutral, "common": common,
    }


class Guard:
    """What keeps a token from being taken for a misspelt term: words of harmless samples, and tokens that the corpus has more often than
    the term (four times at least). sequences: weights of word sequences from the labelled sample."""

    def __init__(self, frequent: frozenset = frozenset(), counts: dict | None = None, sequences: dict | None = None):
        self.frequent, self.counts, self.sequences = frequent, counts or {}, sequences or {}
        self.words = frozenset(w for s in self.sequences for w in s)
        self.begins = frozenset(s[:2] for s in self.sequences)

    def allows(self, token: str, term: str) -> bool:
        return token not in self.frequent and self.counts.get(token, 0) <= max(4, self.counts.get(term, 0))


def term_of(token: str, cache: dict, guard: Guard) -> str:
    """The lexicon's term that a folded token stands for, or the token."""
    known = cache.get(token)
    if known is None:
        known = next((term for term, distance in lexicon()["trie"].near(token) if distance == 0 or guard.allows(token, term)), token)
        if len(cache) > 500_000:
            cache.clear()
        cache[token] = known
    return known


def sentence_words(sentence: str) -> list[tuple[str, int, int]]:
    """Tokens with their places; letters written apart by spaces are one token."""
    raw = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(sentence)]
    if sum([b - a == 1 for _, a, b in raw]) < 4:
        return raw
    tokens: list[tuple[str, int, int]] = []
    i = 0
    while i < len(raw):
        j = i
        while j < len(raw) and len(raw[j][0]) == 1 and raw[j][0].isalnum() and (j == i or raw[j][1] - raw[j - 1][2] <= 2):
            j += 1
        if j - i >= 4:
            tokens.append(("".join(t[0] for t in raw[i:j]), raw[i][1], raw[j - 1][2]))
            i = j
        else:
            tokens.append(raw[i])
            i += 1
    return tokens


def _follows(words: list[str], i: int, wanted, window: int) -> bool:
    return any(w in wanted for w in words[i + 1 : i + 1 + window])


NO_GUARD = Guard()
NAMED_GROUP = re.compile(r"(?i:\b(?:old|young|poor|these|those|such) people\b|\bpeople (?:from|of|in|with|like)\b)|\b[A-ZА-Я]\w+(?:ians|ans|ers|это)\b|\w+ это ")
NAMING = re.compile(r"\b(?:is|are|es|est|ist|sei|bent|é|e) (?:a|an|un|une|uno|um|ein|eine|een|такой)\b|\b(?:like|comme|como|wie|zoals|come) [A-ZÀ-ÞА-Я]|^\s*[A-ZÀ-ÞА-Я]\w+ (?:é|is|ist|est|es)\b|,\s*[A-ZА-Я]\w+,|^\s*[A-ZÀ-ÞА-Я]\w+,")


def sentence_score(sentence: str, cache: dict, guard: Guard = NO_GUARD) -> tuple[float, str]:
    """(score, label) of a sentence: the highest of its abusive, hateful and sexual scores."""
    lex = lexicon()
    tokens = sentence_words(sentence)
    plain = [fold(t[0]) for t in tokens]
    words = [term_of(p, cache, guard) for p in plain]
    telling = [i for i, (w, p) in enumerate(zip(words, plain)) if w in lex["scoring"] or p in lex["aimed"]]
    begins = [i for i, pair in enumerate(zip(plain, plain[1:])) if pair in guard.begins]
    if not telling and not begins:
        return 0.0, "sexual"
    harmless = any(words[i : i + len(n)] == n or plain[i : i + len(n)] == n for i, w in enumerate(plain) for n in lex["neutral"].get(w, ()))
    harmless = harmless or bool(re.search(r"(?i)\b(idiot|fool)-?proof", sentence))
    quoted = [a > 0 and sentence[a - 1] in "\"“'‘«„" and b < len(sentence) and sentence[b] in "\"”'’»“" for _, a, b in tokens]
    insult = degrading = dehuman = sexual = aimed = 0.0
    expel = 0
    seen = set()
    for i in telling:
        w = words[i]
        entries = list(lex["single"].get(w, ())) if not quoted[i] else []
        span = 1
        for parts, more in lex["starts"].get(w, ()):
            if words[i : i + len(parts)] == parts:
                entries += more
                span = max(span, len(parts))
        for kind, weight in entries:
            if (kind, w, span) in seen:
                continue
            seen.add((kind, w, span))
            if kind == "i":
                insult = 0.6
            elif kind == "d":
                degrading = 0.3
            elif kind == "h":
                dehuman = 0.6
            elif kind == "e":
                expel += 1
            elif kind == "x":
                aimed += 0.8
            else:
                sexual += weight
        # violence aimed at a person or a part of the body; absence that is wished on a person
        if plain[i] in lex["violence"]:
            body = [k for k in range(i + 1, min(i + 3, len(plain))) if plain[k] in lex["person"]]
            after = body and (any(x in lex["body"] for x in plain[body[0] + 1 : body[0] + 4]) or plain[i] not in ("find", "cut", "beat"))
            if after and (any(x in lex["intent"] for x in plain[max(0, i - 4) : i]) or any(x in lex["body"] for x in plain[body[0] + 1 : body[0] + 3])):
                aimed += 1.0
        if plain[i] in lex["absence"] and any(x in lex["person"] for x in plain[max(0, i - 4) : i + 4]) and any(x in lex["wish"] for x in plain[max(0, i - 7) : i + 1]):
            aimed += 1.0
    learned = {"abusive": 0.0, "hateful": 0.0, "sexual": 0.0}
    for n in (2, 3, 4):
        for i in begins:
            hit = guard.sequences.get(tuple(plain[i : i + n]))
            if hit and not any(quoted[i : i + n]):
                learned[hit[0]] = max(learned[hit[0]], hit[1])
    if not (insult or degrading or dehuman or sexual or aimed or expel or any(learned.values())):
        return 0.0, "sexual"
    person = not lex["person"].isdisjoint(plain)
    group = bool(dehuman or expel) and (any(w in lex["groups"] for w in plain) or bool(NAMED_GROUP.search(sentence)))
    abusive = aimed
    if insult:
        abusive += insult + (0.5 if person or NAMING.search(sentence) else 0) + degrading
    elif degrading and person and aimed:
        abusive += degrading
    hateful = dehuman + (0.5 if group else 0) if dehuman else 0.0
    hateful += 0.4 * min(expel, 2) + (0.3 if group and expel else 0)
    abusive, hateful, sexual = abusive + learned["abusive"], hateful + learned["hateful"], sexual + learned["sexual"]
    if any(w in lex["reporting"] for w in plain) and aimed < 0.8:
        abusive, hateful = abusive - 0.7, hateful - 0.7
    if harmless:
        abusive, hateful, sexual = abusive - 0.8, hateful - 0.8, sexual - 0.8
    best = max((round(abusive, 2), "abusive"), (round(hateful, 2), "hateful"), (round(sexual, 2), "sexual"))
    return best if best[0] >= LEAST else (0.0, best[1])  # single weak words are no evidence


SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def text_score(text: str, cache: dict, guard: Guard = NO_GUARD, at: list[int] | None = None) -> tuple[float, str]:
    """Score and label of the worst sentence; with at, of the sentences that hold one of these positions."""
    best, start, position = (0.0, "none"), 0, 0
    for end, following in [*((m.start(), m.end()) for m in SENTENCE.finditer(text)), (len(text), len(text))]:
        wanted = at is None
        while at is not None and position < len(at) and at[position] < following:
            wanted = wanted or at[position] >= start
            position += 1
        if wanted and end - start > 3:
            score = sentence_score(text[start:end], cache, guard)
            if score[0] > best[0]:
                best = score
        start = following
    return best


def _token_spans(cps: np.ndarray, offs: np.ndarray):
    at = np.minimum(cps, tb.LIMIT)
    kind = tb.classes()[at]
    inside = (kind == tb.LETTER) | (kind == tb.MARK) | (kind == tb.DIGIT) | np.isin(cps, [42, 36, 64, 33, 45, 39])
    return tb.runs(inside, offs[:-1][offs[:-1] < len(cps)])


MAX_SAMPLES, LEARNED, LEAST_TEXTS = 4000, 0.6, 2


def _sample(samples: DataFrame | None, condition: str) -> list[tuple[str, str]]:
    """(label, text) of at most MAX_SAMPLES rows, chosen by hash."""
    if samples is None:
        return []
    label = F.col("label") if "label" in samples.columns else F.lit("none")
    rows = samples.select(label.alias("label"), "text").filter(f"text is not null and {condition}").distinct().orderBy(F.xxhash64("text"), "text", "label").limit(MAX_SAMPLES).collect()
    return [(r.label, r.text) for r in rows]


def fit_sequences(harmful: list[tuple[str, str]], harmless: list[str]) -> dict[tuple, tuple[str, float]]:
    """Sequences of two to four words of the labelled texts, with label and weight. A sequence counts if texts of
    one harmful label alone hold it, LEAST_TEXTS of them at least, no harmless one does, and not all its words are common. The weight
    is LEARNED times the lower bound of its share of harmful texts, (n - 1) / n."""
    lex = lexicon()

    def of(text: str) -> set[tuple]:
        out = set()
        for sentence in SENTENCE.split(text):
            words = [fold(t[0]) for t in sentence_words(sentence)]
            out |= {tuple(words[i : i + n]) for n in (2, 3, 4) for i in range(len(words) - n + 1) if all(w.isalnum() for w in words[i : i + n])}
        return out

    counts: dict[tuple, dict] = {}
    for label, text in harmful:
        for s in of(text):
            counts.setdefault(s, {}).setdefault(label, 0)
            counts[s][label] += 1
    for text in harmless:
        for s in of(text):
            counts.pop(s, None)
    return {s: (*by, round(LEARNED * (n - 1) / n, 3)) for s, by in counts.items() if len(by) == 1 for n in by.values() if n >= LEAST_TEXTS and not all(w in lex["common"] for w in s)}


def _forms(token: str) -> list[str]:
    """A token folded, as a whole and in its parts between signs."""
    whole = fold(token)
    parts = re.split("[-'!]", token)
    return [whole, *(fold(x) for x in parts if x)] if len(parts) > 1 else [whole]


class Known:
    """Distinct tokens that this worker has seen, with what describe(forms) says of each: a number of values. Forms that no term can be near,
    which nearly all are, are told in one pass over the new tokens and put into cache as themselves."""

    def __init__(self, describe, n_values: int, cache: dict):
        self.describe, self.cache = describe, cache
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, n_values), np.float32)

    def __call__(self, cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values of each token, first place of each distinct token, number of its distinct token)."""
        h = tb.span_hashes(tb.lower_table()[np.minimum(cps, tb.LIMIT)], begin, end)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > 600_000:
            self.hashes, self.values = self.hashes[:0], self.values[:0]
        where = np.searchsorted(self.hashes, unique)
        known = where < len(self.hashes)
        known[known] = self.hashes[where[known]] == unique[known]
        values = np.zeros((len(unique), self.values.shape[1]), np.float32)
        values[known] = self.values[where[known]]
        new = np.flatnonzero(~known)
        if len(new):
            forms = [_forms(cps[a:b].tobytes().decode("utf-32-le", "replace")) for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())]
            flat = list({f for x in forms for f in x if f not in self.cache})
            if len(self.cache) + len(flat) > 500_000:
                self.cache.clear()
            self.cache.update((f, f) for f, near in zip(flat, lexicon()["trie"].possible(flat)) if not near)
            values[new] = [self.describe(x) for x in forms]
            order = np.argsort(np.concatenate([self.hashes, unique[new]]), kind="stable")
            self.hashes = np.concatenate([self.hashes, unique[new]])[order]
            self.values = np.concatenate([self.values, values[new]])[order]
        return values[inverse], first, inverse


def _sentence_numbers(cps: np.ndarray, offs: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ascending number of the sentence of each token, as SENTENCE divides them."""
    space = np.isin(cps, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0])
    ends = np.isin(cps, [46, 33, 63, 0x2026])
    cut = np.zeros(len(cps) + 1, np.int64)
    cut[offs[:-1]] = 1
    cut[1:-1] |= ends[:-1] & space[1:]
    cut[:-1] |= cps == 10
    return np.cumsum(cut)[begin]


def near_counts(documents: DataFrame, text: str = "text") -> dict[str, int]:
    """How often all documents hold each token that is a term or near one. There are at most as many as the lexicon has neighbours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counts = lexicon()["trie"], {}
        cache: dict = {}
        known = Known(lambda forms: [float(any(f not in cache and trie.near(f) for f in forms))], 1, cache)
        for batch in batches:
            for part in tb.chunks(batch, text):
                cps, offs = tb.codepoints(lookalike.canonical_array(part.column(text)))
                if not len(cps):
                    continue
                begin, end = _token_spans(cps, offs)
                values, first, inverse = known(cps, begin, end)
                for u, n in zip(*np.unique(inverse[values[:, 0] > 0], return_counts=True)):
                    token = fold(cps[begin[first[u]] : end[first[u]]].tobytes().decode("utf-32-le", "replace"))
                    counts[token] = counts.get(token, 0) + int(n)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = documents.select(text).mapInArrow(scan, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in rows.collect()}


def scores(documents: DataFrame, samples: DataFrame | None = None, language_samples: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, score, label): every row once. A null or empty text has the score 0 and the label none."""
    harmless = [t for _, t in _sample(samples, "label = 'none'")] + [t for _, t in _sample(language_samples, "true")]
    frequent = frozenset(fold(t) for x in harmless for t in re.findall(r"[^\W\d_]+", x))
    sequences = fit_sequences(_sample(samples, "label <> 'none'"), harmless)
    shared = documents.sparkSession.sparkContext.broadcast(Guard(frequent, near_counts(documents, text), sequences))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        guard, lex = shared.value, lexicon()
        vocabulary = {w: i + 1 for i, w in enumerate(sorted(guard.words))}
        pairs = np.array(sorted({vocabulary[a] * (len(vocabulary) + 1) + vocabulary[b] for q in guard.sequences for a, b in zip(q, q[1:])}), np.int64)

        def describe(forms: list[str]) -> list[float]:
            """[what the token can add, whether it is aimed at somebody, whether a person, its number among the words of sequences]."""
            terms = [term_of(f, cache, guard) for f in forms]
            return [max(max(lex["telling"].get(f, 0.0), lex["telling"].get(t, 0.0)) for f, t in zip(forms, terms)), float(any(f in lex["aimed"] for f in forms)), float(any(f in lex["person"] for f in forms)), vocabulary.get(forms[0], 0)]

        known = Known(describe, 4, cache)
        for batch in batches:
            for part in tb.chunks(batch, text):
                cps, offs = tb.codepoints(lookalike.canonical_array(part.column(text)))
                values, labels = np.zeros(len(part)), np.array(["none"] * len(part), object)
                if len(cps):
                    begin, end = _token_spans(cps, offs)
                    facts, _, _ = known(cps, begin, end)
                    # sentences that can score: by what their words add, a verb and a person within a few words, a pair of words of a sequence
                    sentence = _sentence_numbers(cps, offs, begin)
                    hit = np.bincount(sentence, facts[:, 0])[sentence] >= LEAST - 1e-6
                    hit &= facts[:, 0] > 0
                    near = np.zeros(len(begin) + 1, np.int64)
                    np.cumsum(facts[:, 2] > 0, out=near[1:])
                    index = np.arange(len(begin))
                    hit |= (facts[:, 1] > 0) & (near[np.minimum(index + 5, len(begin))] > near[np.maximum(index - 5, 0)])
                    if len(pairs) and len(begin) > 1:
                        number = facts[:, 3].astype(np.int64)
                        joined = number[:-1] * (len(vocabulary) + 1) + number[1:]
                        hit[:-1] |= (number[:-1] > 0) & (number[1:] > 0) & np.isin(joined, pairs)
                    # four single letters in a row
                    single = end - begin == 1
                    if len(single) > 3:
                        four = single[:-3] & single[1:-2] & single[2:-1] & single[3:]
                        four &= begin[3:] - begin[:-3] <= 9
                        hit[:-3] |= four
                    places = begin[hit]
                    owners = np.searchsorted(offs, places, "right") - 1
                    rows, first_hit = np.unique(owners, return_index=True)
                    for row, a, b in zip(rows.tolist(), first_hit.tolist(), [*first_hit[1:].tolist(), len(places)]):
                        text_of = cps[offs[row] : offs[row + 1]].tobytes().decode("utf-32-le", "replace")
                        values[row], labels[row] = text_score(text_of, cache, guard, (places[a:b] - offs[row]).tolist())
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("source"), pa.array(values), pa.array(labels.tolist(), pa.string())], [key, "source", "score", "label"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "source", text).mapInArrow(score, f"`{key}` {kind}, source string, score double, label string")


def found(documents: DataFrame, samples: DataFrame | None = None, language_samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id): texts with a score of threshold or more."""
    return scores(documents, samples, language_samples).filter(F.col("score") >= threshold).select("doc_id").distinct()


def rates(documents: DataFrame, samples: DataFrame | None = None, language_samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_documents, n_found, rate, max_score) for each source, the null source included."""
    return (scores(documents, samples, language_samples).groupBy("source")
            .agg(F.count("*").alias("n_documents"), F.count_if(F.col("score") >= threshold).alias("n_found"), F.max("score").alias("max_score"))
            .withColumn("rate", F.col("n_found") / F.col("n_documents")))
