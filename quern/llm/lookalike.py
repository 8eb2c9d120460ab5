"""Problem 5: one form for text that looks the same.

Tokens (what stands between plain spaces and line ends) that hold a look-alike are mapped by a fixed table, grouped under
the accent-sensitive collation UNICODE in SQL, and every member of a class is replaced by the class's canonical member.
The collation makes composed and combining accents equal and ignores what shows nothing; the table covers what the
collation keeps apart: letters of another script, wide forms, ligatures and spaces. The canonical member is the composed
form of the mapped value, so that it doesn't depend on which other members the data happen to hold; canonical_text()
computes the same form for one string and serves the operators that compare texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.llm import textblocks as tb
from quern.runtime import materialise

# Letters of Cyrillic and Greek that look like Latin letters.
CYRILLIC_AS_LATIN = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԝ": "W",
}
GREEK_AS_LATIN = {
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Letters of the data's scripts that are written with a mark of their own and look like the Latin letter with it.
MARKED_AS_LATIN = {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}

TO_LATIN = CYRILLIC_AS_LATIN | GREEK_AS_LATIN
TO_CYRILLIC = {b: a for a, b in CYRILLIC_AS_LATIN.items() if "а" <= a <= "я" or "А" <= a <= "Я"}
OTHER_SCRIPT = "\u0370-\u03ff\u0400-\u052f"
LATIN = "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"
DEFINITE_OTHER = f"[{OTHER_SCRIPT}&&[^{''.join(TO_LATIN)}]]"  # Java
DEFINITE_LATIN = f"[{LATIN}&&[^{''.join(TO_CYRILLIC)}]]"
JOINED = "\u0600-\u06ff\u0750-\u077f\u0900-\u0dff"  # scripts in which the joiners shape letters
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u0084\u0086-\u009f"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
JOINERS = "\u200c\u200d\ufe00-\ufe0f"


@lru_cache(1)
def compatibility() -> dict[str, str]:
    """Wide, narrow, styled and ligated letters and digits with their plain forms, by rule from the Unicode data."""
    out = {}
    for block in ((0x0132, 0x0134), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0x2100, 0x2150), (0x2160, 0x2180), (0xFB00, 0xFB07), (0xFB13, 0xFB18), (0xFF01, 0xFFEF), (0x1D400, 0x1D800)):
        for c in range(*block):
            kind = unicodedata.decomposition(chr(c)).split(" ")[0]
            if c in range(0x2100, 0x2150) and kind != "<font>":
                continue
            if kind in ("<font>", "<wide>", "<narrow>", "<compat>"):
                plain = unicodedata.normalize("NFKC", chr(c))
                if plain != chr(c):
                    out[chr(c)] = plain
    return out


def _ranges(chars) -> str:
    """A character class, with runs of neighbours as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


@lru_cache(1)
def _python() -> dict:
    table = {ord(a): b for a, b in compatibility().items()}
    table |= {c: None for c in range(0xA0) if re.match(f"[{INVISIBLE}]", chr(c))}
    table |= {c: None for c in range(0xA0, 0x10000) if re.match(f"[{INVISIBLE}]", chr(c))}
    table |= {c: " " for c in range(0xA0, 0x3001) if re.match(f"[{SPACES}]", chr(c))}
    hard = "".join(map(re.escape, compatibility())) + INVISIBLE + SPACES + JOINERS + "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\u212a\u212b"
    return {
        "table": table,
        "hard": re.compile(f"[{hard}]"),
        "blank": re.compile("[ \t\r]"),
        "ambiguous": re.compile(f"(?<![^\\W\\d_])[{''.join(TO_LATIN)}]+(?![^\\W\\d_])"),
        "suspect": re.compile(f"[{hard}{OTHER_SCRIPT}]"),
        "joiner": re.compile(f"(?<![{JOINED}\u200d\ufe0f\u2190-\u2bff\u3030\u303d\U0001f000-\U0001faff#*0-9])[{JOINERS}]|[\u200c\u200d](?![{JOINED}\u2190-\u2bff\U0001f000-\U0001faff])"),
        "word": re.compile(f"[{LATIN}{OTHER_SCRIPT}]*[{OTHER_SCRIPT}][{LATIN}{OTHER_SCRIPT}]*"),
        "beside": re.compile(f"[{LATIN}][{OTHER_SCRIPT}]|[{OTHER_SCRIPT}][{LATIN}]"),
        "definite_other": re.compile(f"[^\\W\\d_{''.join(TO_LATIN)}]"),
        "latin": re.compile(f"[{LATIN}]"),
        "other": re.compile(f"[{OTHER_SCRIPT}]"),
        "other_definite": re.compile(f"(?![{''.join(TO_LATIN)}])[{OTHER_SCRIPT}]"),
        "latin_definite": re.compile(f"(?![{''.join(TO_CYRILLIC)}])[{LATIN}]"),
        "to_latin": str.maketrans(TO_LATIN | MARKED_AS_LATIN),
        "to_cyrillic": str.maketrans(TO_CYRILLIC),
    }


def has_suspect(text: str) -> bool:
    return bool(_python()["suspect"].search(text))


def canonical_word(word: str, other_context: bool) -> str:
    """A word in the script it is written in: that of its letters that only one script has; without any, that of its line."""
    p = _python()
    latin, definite = p["latin"].search(word), p["other_definite"].search(word)
    if definite:
        return word.translate(p["to_cyrillic"]) if latin and not p["latin_definite"].search(word) else word
    if latin and p["latin_definite"].search(word):
        return word.translate(p["to_latin"])
    if other_context:
        return word.translate(p["to_cyrillic"]) if latin else word
    return word.translate(p["to_latin"])


def canonical_text(text: str) -> str:
    """The one form of a text. Line ends stay."""
    p = _python()
    if not p["suspect"].search(text):
        return text
    text = text.translate(p["table"])
    text = p["joiner"].sub("", text)
    text = unicodedata.normalize("NFC", text)
    if not p["other"].search(text):
        return text
    out = []
    for line in text.split("\n"):
        if p["other"].search(line):
            context = len(p["other_definite"].findall(line)) >= 2 or not p["latin_definite"].search(line)
            if context and not p["beside"].search(line):  # words are of one script each, and stay
                out.append(line)
                continue
            line = p["word"].sub(lambda m, c=context: canonical_word(m.group(), c), line)
        out.append(line)
    return "\n".join(out)


def _plain_rows(cps: np.ndarray, offs: np.ndarray, kinds: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the rows (those of the suspect places at) are their own canonical_text for sure: nothing in them but letters of another script
    is suspect or changes when composed, none of these stands beside a Latin letter, and each of their lines has two that only that
    script has."""
    value = np.searchsorted(offs, at, "right") - 1
    owner = np.searchsorted(rows, value)
    latin = kinds & LATIN_LETTER > 0
    beside = latin[np.minimum(at + 1, len(cps) - 1)] & (at + 1 < offs[value + 1]) | latin[at - 1] & (at > offs[value])
    bad = np.zeros(len(rows), bool)
    bad[owner[(kinds[at] & OTHER_LETTER == 0) | beside]] = True
    risky = np.searchsorted(offs, np.flatnonzero(kinds & COMPOSES), "right") - 1
    bad[np.isin(rows, risky)] = True
    # lines are told apart by the newlines before them; places of two rows are in different lines as well
    line = np.searchsorted(np.flatnonzero(cps == 10), at) + owner
    _, first, line = np.unique(line, return_index=True, return_inverse=True)
    bad[owner[first[np.bincount(line, (kinds[at] & DEFINITE) > 0) < 2]]] = True
    return ~bad


def _canonical_lines(text: str, places: list[int]) -> str:
    """canonical_text of a text whose suspect characters stand at the places: no step looks beyond a line, and lines without a suspect character
    stay but for being composed."""
    out, last = [], 0
    for place in places:
        if place < last:
            continue
        a, b = text.rfind("\n", 0, place) + 1, text.find("\n", place)
        b = len(text) if b < 0 else b
        out += [text[last:a], canonical_text(text[a:b])]
        last = b
    out.append(text[last:])
    if not all(unicodedata.is_normalized("NFC", x) for x in out[::2]):  # composing may give a letter of another script
        return canonical_text(text)
    return "".join(out)


def canonical_array(values: pa.Array) -> pa.Array:
    """canonical_text of each value; values without a suspect character, or plainly of another script, are passed on as they are."""
    cps, offs = tb.codepoints(values)
    kinds = _point_kinds()[np.minimum(cps, tb.LIMIT)]
    at = np.flatnonzero(kinds & SUSPECT)
    if not len(at):
        return values
    rows = np.unique(np.searchsorted(offs, at, "right") - 1)
    rows = rows[~_plain_rows(cps, offs, kinds, at, rows)]
    if not len(rows):
        return values
    begin, end = np.searchsorted(at, offs[rows]), np.searchsorted(at, offs[rows + 1])
    changed = pa.array([_canonical_lines(values[r].as_py(), (at[a:b] - offs[r]).tolist()) for r, a, b in zip(rows.tolist(), begin.tolist(), end.tolist())], pa.string())
    take = np.arange(len(values))
    take[rows] = len(values) + np.arange(len(rows))
    return pa.concat_arrays([values.cast(pa.string()), changed]).take(pa.array(take))


def canonical_series(values: pd.Series) -> pd.Series:
    return values.map(canonical_text, na_action="ignore")


# ---- the operator in SQL

def _hard() -> str:
    return "[" + _ranges(compatibility()) + INVISIBLE + SPACES + JOINERS + "\\p{M}\u212a\u212b]"


def _translate(column: Column, table: dict[str, str]) -> Column:
    return F.translate(column, "".join(table), "".join(table.values()))


def _mapped(token: Column, other_context: Column) -> Column:
    """The table, applied to a token: single characters, joiners outside emoji, then letters of another script word by word."""
    single = {a: b for a, b in compatibility().items() if len(b) == 1}
    longer = {a: b for a, b in compatibility().items() if len(b) > 1}
    out = F.regexp_replace(token, f"[{SPACES}]", " ")
    out = F.regexp_replace(out, f"[{INVISIBLE}]", "")
    emoji = "\u2190-\u2bff\U0001f000-\U0001faff"
    # joiners that shape emoji or letters are put aside as private characters
    out = F.regexp_replace(out, f"([{emoji}#*0-9])\ufe0f", "$1\ue0fd")
    out = F.regexp_replace(out, f"([{emoji}\ue0fd])\u200d(?=[{emoji}])", "$1\ue0fe")
    out = F.regexp_replace(out, f"([{JOINED}])\u200c(?=[{JOINED}])", "$1\ue0ff")
    out = F.regexp_replace(out, f"([{JOINED}])\u200d(?=[{JOINED}])", "$1\ue0fe")
    out = F.translate(F.regexp_replace(out, f"[{JOINERS}]", ""), "\ue0fd\ue0fe\ue0ff", "\ufe0f\u200d\u200c")
    out = _translate(out, single)
    for a, b in longer.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    words = F.regexp_extract_all(out, F.lit(f"(?s)[{LATIN}{OTHER_SCRIPT}\\p{{M}}]+|[^{LATIN}{OTHER_SCRIPT}\\p{{M}}]+"), F.lit(0))

    def word(w: Column) -> Column:
        latin, definite = w.rlike(f"[{LATIN}]"), w.rlike(DEFINITE_OTHER)
        latin_definite = w.rlike(DEFINITE_LATIN)
        to_latin, to_cyrillic = _translate(w, TO_LATIN | MARKED_AS_LATIN), _translate(w, TO_CYRILLIC)
        return (F.when(~w.rlike(f"[{OTHER_SCRIPT}]"), w)
                .when(definite, F.when(latin & ~latin_definite, to_cyrillic).otherwise(w))
                .when(latin & latin_definite, to_latin)
                .when(other_context, F.when(latin, to_cyrillic).otherwise(w))
                .otherwise(to_latin))

    return F.array_join(F.transform(words, word), "")


@F.pandas_udf(StringType())
def composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def _line_context(line: Column) -> Column:
    plain = F.regexp_replace(line, _hard(), "")
    return (F.regexp_count(plain, F.lit(DEFINITE_OTHER)) >= 2) | ~F.regexp_replace(line, f"[{INVISIBLE}]", "").rlike(DEFINITE_LATIN)


@lru_cache(1)
def _suspect_points() -> np.ndarray:
    """Whether a code point (below textblocks.LIMIT) can be a look-alike or is of a script that has some."""
    points = [*range(0xD800), *range(0xE000, tb.LIMIT)]
    table = np.zeros(tb.LIMIT + 1, bool)
    table[[points[m.start()] for m in _python()["suspect"].finditer("".join(map(chr, points)))]] = True
    return table


SUSPECT, OTHER_LETTER, DEFINITE, LATIN_LETTER, COMPOSES = 1, 2, 4, 8, 16


@lru_cache(1)
def _point_kinds() -> np.ndarray:
    """Of each code point (below textblocks.LIMIT): whether it is suspect (_suspect_points), a letter of another script and nothing else that is
    suspect, a letter that only that script has, a Latin letter, and whether it may change when a text is composed."""
    p = _python()
    points = [*range(0xD800), *range(0xE000, tb.LIMIT)]
    text = "".join(map(chr, points))
    table = _suspect_points().astype(np.uint8) * SUSPECT
    for bit, pattern in ((OTHER_LETTER, p["other"]), (DEFINITE, p["other_definite"]), (LATIN_LETTER, p["latin"])):
        table[[points[m.start()] for m in pattern.finditer(text)]] |= bit
    table[[points[m.start()] for m in p["hard"].finditer(text)]] &= 255 - OTHER_LETTER
    # marks, points that have another form, the second of two that compose, and the later parts of Korean syllables
    for c in points:
        form = unicodedata.normalize("NFD", chr(c))
        if unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)):
            table[c] |= COMPOSES
        if len(form) > 1:
            for second in form[1:]:
                if ord(second) < tb.LIMIT:
                    table[ord(second)] |= COMPOSES
    return table


def line_tokens(line: str) -> Iterator[tuple[str, bool]]:
    """(token, other_context) of the suspect tokens of a line."""
    p = _python()
    if not p["suspect"].search(line):
        return
    plain = p["hard"].sub("", line)
    context = len(p["other_definite"].findall(plain)) >= 2 or not p["latin_definite"].search(line)
    for token in p["blank"].split(line):
        if p["hard"].search(token) or p["other"].search(token) and (p["latin"].search(token) or p["ambiguous"].search(token)):
            yield token, context


def suspect_tokens(records: DataFrame, fields: tuple[str, ...] = ("title", "body_text"), key: str = "id") -> DataFrame:
    """(key, field, token, other_context) of every field that is not blank; a token once a field of a row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, blank = _suspect_points(), re.compile(f"[\\s{INVISIBLE}{SPACES}{JOINERS}]*")
        for batch in batches:
            for field in fields:
                for part in tb.chunks(batch, field):
                    cps, offs = tb.codepoints(part.column(field))
                    at = np.flatnonzero(points[np.minimum(cps, tb.LIMIT)])
                    rows = np.unique(np.searchsorted(offs, at, "right") - 1)
                    out_row, out_token, out_context = [], [], []
                    for row in rows.tolist():
                        text = cps[offs[row] : offs[row + 1]].tobytes().decode("utf-32-le", "replace")
                        if blank.fullmatch(text):
                            continue
                        for token, context in {x for line in text.split("\n") for x in line_tokens(line)}:
                            out_row.append(row)
                            out_token.append(token)
                            out_context.append(context)
                    if out_row:
                        yield pa.RecordBatch.from_arrays(
                            [part.column(key).take(pa.array(out_row)), pa.array([field] * len(out_row)), pa.array(out_token, pa.string()), pa.array(out_context)],
                            [key, "field", "token", "other_context"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, *fields).mapInArrow(scan, f"`{key}` {kind}, field string, token string, other_context boolean")


def canonical_members(tokens: DataFrame) -> DataFrame:
    """(token, other_context, canonical) for the distinct tokens that are not canonical themselves. Classes are the groups of the
    collation UNICODE over the mapped values; the canonical member is the least composed mapped value of the class."""
    distinct = tokens.select("token", "other_context").distinct()
    mapped = (distinct.withColumn("mapped", composed(_mapped(F.col("token"), F.col("other_context"))))
              .withColumn("class", F.collate("mapped", "UNICODE")))
    chosen = mapped.groupBy("class").agg(F.min("mapped").alias("canonical"))
    return mapped.join(chosen, "class").filter(F.col("token") != F.col("canonical")).select("token", "other_context", "canonical")


def found(records: DataFrame, fields: tuple[str, ...] = ("title", "body_text"), key: str = "id") -> DataFrame:
    """(key, field): fields with at least one token that has a plainer form. Null and blank fields give no row; repeated rows of a
    record count once."""
    tokens = materialise(suspect_tokens(records, fields, key))
    return tokens.join(canonical_members(tokens), ["token", "other_context"], "left_semi").select(key, "field").distinct()


def canonical_records(records: DataFrame, fields: tuple[str, ...] = ("title", "body_text"), key: str = "id") -> DataFrame:
    """(key, *fields): every record's fields in the one form, one row per key. Nulls stay null."""
    tokens = materialise(suspect_tokens(records, fields, key))
    maps = (tokens.join(canonical_members(tokens), ["token", "other_context"])
            .groupBy(key).agg(*[F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("field") == f, F.struct(F.concat(F.col("other_context").cast("string"), "token"), F.col("canonical")))))).alias(f"_{f}") for f in fields]))

    def line_form(line: Column, table: Column) -> Column:
        context = _line_context(line).cast("string")
        return F.array_join(F.transform(F.split(line, "(?<=[ \t\r])|(?=[ \t\r])"), lambda t: F.coalesce(F.element_at(table, F.concat(context, t)), t)), "")

    def form(field: str) -> Column:
        table = F.col(f"_{field}")
        lines = F.transform(F.split(field, "\n"), lambda line: line_form(line, table))
        return F.when(F.size(table) > 0, F.array_join(lines, "\n")).otherwise(F.col(field)).alias(field)

    return records.select(key, *fields).dropDuplicates([key]).join(maps, key, "left").select(key, *[form(f) for f in fields])
