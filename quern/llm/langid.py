"""Problem 2: the language of records, and of the lines of records in several languages.

String-kernel classification. A text's vector has, for each character n-gram (n = 1 to 4, within words and their borders),
the number of words in which it is present; the kernel of two texts is their vectors' product, divided by the root of the
product of their sizes. A bounded sample of labelled sentences gives the Nystroem landmarks; kernel ridge regression, one class against the rest, is solved on the landmark features
K(x, L) K(L, L)^(-1/2). Since the kernel is linear in the vectors, the landmarks' coefficients fold into one
weight per n-gram and class. Scoring is a product of the batch's words-by-n-grams matrix with that matrix, and of the
sentences-by-words matrix with the result; words that a worker has scored are looked up.

A body has a second language if a closed sentence is strong evidence of it: nearest to it by a margin, and with a lead over
the body's main language; one such sentence tells alone if both are wide, else it takes two. Closed sentences of lines that several pages of a site hold belong to the frame and have no say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import liststuff, lookalike
from quern.llm import textblocks as tb
from quern.runtime import materialise, site_of

ORDERS, MAX_SAMPLES, MAX_LANDMARKS, RIDGE = (1, 2, 3, 4), 4000, 1500, 0.05
MIN_WORDS, STRONG_MARGIN, STRONG_LEAD, ALONE_MARGIN, ALONE_LEAD, FRAGMENT_MARGIN, FRAME_PAGES = 4, 0.3, 0.5, 0.35, 0.6, 0.25, 3
NAMES = ["kind", "id", "site", "label", "line_no", "line", "words", "fragments", "foreign", "confidence", "vote"]

# Names of languages in labels, besides the two-letter codes themselves.
LABEL_NAMES = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es",
    "ita": "it", "italian": "it", "por": "pt", "portuguese": "pt", "nld": "nl", "dut": "nl", "dutch": "nl", "rus": "ru", "russian": "ru",
}


def label_code(label):
    """Two-letter code that a label names, or NULL: regions, three-letter codes and English names count."""
    plain = F.element_at(F.split(F.lower(F.trim(label)), "[-_]"), 1)
    names = F.create_map(*[F.lit(x) for pair in (LABEL_NAMES | {c: c for c in set(LABEL_NAMES.values())}).items() for x in pair])
    return F.element_at(names, plain)


def word_grams(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, index of their word) of lower-case words, with a border character on either side; each n-gram of a word once, by word."""
    size = end - begin + 2
    at = np.cumsum(size) - size
    text = np.full(int(size.sum()), 32, np.uint64)
    source = tb.expand(begin, end - begin)
    text[tb.expand(at + 1, end - begin)] = tb.lower_table()[np.minimum(cps[source], tb.LIMIT)]
    word = np.repeat(np.arange(len(begin)), size)
    cells, owners = [], []
    h = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            m = len(text) - n + 1
            if m <= 0:
                break
            h = tb.mix(h[:m] * np.uint64(0x9E3779B97F4A7C15) + text[n - 1 : n - 1 + m] + np.uint64(n))
            if n in ORDERS:
                inside = word[:m] == word[n - 1 : n - 1 + m]
                cells.append(h[inside])
                owners.append(word[:m][inside])
    gram, owner = np.concatenate(cells), np.concatenate(owners)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    first = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))
    return gram[first], owner[first]


def words_of(cps: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = tb.classes()[np.minimum(cps, tb.LIMIT)]
    return tb.runs((kind == tb.LETTER) | (kind == tb.MARK), breaks)


def fit(samples: DataFrame, ridge: float = RIDGE) -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    """(languages, (n-grams, weights [n-grams + 1, languages])) from labelled sentences (language, text); at most MAX_SAMPLES rows, chosen
    by hash. The last weight, of n-grams that no sample holds, is 0."""
    rows = samples.filter("language is not null and text is not null").select("language", "text").distinct().orderBy(F.xxhash64("text"), "text", "language").limit(MAX_SAMPLES).collect()
    if not rows:
        return [], (np.zeros(0, np.uint64), np.zeros((1, 0), np.float32))
    return fit_rows([(r.language, r.text) for r in rows], ridge)


def fit_rows(rows: list[tuple[str, str]], ridge: float = RIDGE) -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    languages = sorted({language for language, _ in rows})
    cps, offs = tb.codepoints(pa.array([lookalike.canonical_text(text) for _, text in rows]))
    begin, end = words_of(cps, offs[:-1][offs[:-1] < len(cps)])
    gram, owner = word_grams(cps, begin, end)
    row = (np.searchsorted(offs, begin, "right") - 1)[owner]
    used, column = np.unique(gram, return_inverse=True)
    x = np.zeros((len(rows), len(used)), np.float32)
    np.add.at(x, (row, column), 1)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    landmarks = x[:: max(1, -(-len(rows) // MAX_LANDMARKS))]
    k_mm = (landmarks @ landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = (x @ landmarks.T) @ whiten
    target = np.array([[1.0 if language == c else 0.0 for c in languages] for language, _ in rows])
    target -= target.mean(0)
    beta = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ target)
    weights = np.zeros((len(used) + 1, len(languages)), np.float32)
    weights[:-1] = landmarks.T @ (whiten @ beta)
    return languages, (used, weights)


class Scorer:
    """Sentence scores with the words that this worker knows."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray], most: int = 400_000):
        self.model, self.most = model, most
        self.grams, self.weights = model
        self.hashes = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, self.weights.shape[1]), np.float32)
        self.sizes = np.zeros(0, np.float32)

    def words(self, cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, number of n-grams) of each word."""
        low = tb.lower_table()[np.minimum(cps, tb.LIMIT)]
        hashes = tb.span_hashes(low, begin, end)
        if len(self.hashes) > self.most:
            self.__init__(self.model, self.most)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == unique[known]
        if not known.all():
            new = first[~known]
            gram, owner = word_grams(cps, begin[new], end[new])
            at_gram = np.minimum(np.searchsorted(self.grams, gram), max(len(self.grams) - 1, 0))
            row = np.where(self.grams[at_gram] == gram, at_gram, len(self.grams)) if len(self.grams) else np.zeros(len(gram), np.int64)
            sizes = np.bincount(owner, minlength=len(new)).astype(np.float32)
            scores = np.add.reduceat(self.weights[row], np.cumsum(sizes.astype(np.int64)) - sizes.astype(np.int64))
            merged = np.concatenate([self.hashes, unique[~known]])
            order = np.argsort(merged, kind="stable")
            self.hashes = merged[order]
            self.scores = np.concatenate([self.scores, scores])[order]
            self.sizes = np.concatenate([self.sizes, sizes])[order]
            at = np.searchsorted(self.hashes, unique)
        return self.scores[at[inverse]], self.sizes[at[inverse]]

    def sentences(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Sentences of the lines: (line index, number of words, scores, whether it ends with a full stop or the like)."""
        begin, end = words_of(cps, starts[starts < len(cps)])
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.weights.shape[1]), np.float32), np.zeros(0, bool)
        line = np.searchsorted(starts, begin, "right") - 1
        stop = np.zeros(len(cps) + 1, np.int64)
        kind = tb.classes()[np.minimum(cps, tb.LIMIT)]
        mark = np.isin(cps, [46, 33, 63, 0x2026])
        mark[:-1] &= kind[1:] == tb.SPACE
        np.cumsum(mark, out=stop[1:])
        part = stop[begin]
        new = np.append(True, (line[1:] != line[:-1]) | (part[1:] != part[:-1]))
        first = np.flatnonzero(new)
        scores, sizes = self.words(cps, begin, end)
        total = np.add.reduceat(scores, first)
        count = np.add.reduceat(sizes, first)
        last = np.append(first[1:], len(begin)) - 1
        to = np.append(begin[first[1:]], len(cps))
        closed = stop[np.minimum(to, ends[line[first]])] > stop[end[last]]
        return line[first], last - first + 1, total / np.sqrt(np.maximum(count, 1))[:, None], closed


def page_votes(document: np.ndarray, line: np.ndarray, n_letters: np.ndarray, n_documents: int) -> np.ndarray:
    """For each line (with letters, in order of documents) what its page votes with when pages that hold the line are counted: the hash
    of the page's longest other line, 0 where there is none. Copies of a page share it and so have one vote."""
    order = np.lexsort((line, -n_letters, document))
    first = np.searchsorted(document[order], np.arange(n_documents))
    size = np.bincount(document, minlength=n_documents)
    longest = np.where(size > 0, line[order[np.minimum(first, len(order) - 1)]], 0)
    # the second longest: the first in order whose hash is another one
    other = np.flatnonzero(line[order] != longest[document[order]])
    owners, at = np.unique(document[order[other]], return_index=True)
    second = np.zeros(n_documents, line.dtype)
    second[owners] = line[order[other[at]]]
    return np.where(line == longest[document], second[document], longest[document])


def line_languages(records: DataFrame, model: tuple[list[str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows of three kinds, from one reading of the records.
    0: (id, label, line_no 0, words, confidence): bodies without evidence of a second language; words are those of closed sentences, or of
       all where no sentence is closed.
    1: (id, site, label, line_no, line, words, fragments, foreign, confidence): the lines of the other bodies. words[i]: words of closed
       sentences nearest to language i, fragments[i] those of the rest of the line, foreign[i] the evidence of i: 1 for a strong sentence, 2 for one that tells alone.
    2: (site, line, vote): the lines with closed sentences, for counting the pages that hold them; a task sends FRAME_PAGES votes at most
       of a line in each block of its rows, since no more are asked for."""
    languages, weights = model
    shared = records.sparkSession.sparkContext.broadcast(weights)
    n = len(languages)
    kind = records.schema["id"].dataType.simpleString()
    schema = f"kind int, id {kind}, site bigint, label string, line_no int, line bigint, words array<int>, fragments array<int>, foreign array<int>, confidence double, vote bigint"

    def lists(x: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).reshape(-1)), n).cast(pa.list_(pa.int32()))

    def votes(held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        rows = rows[np.arange(len(rows)) - start < FRAME_PAGES]
        m = len(rows)
        none = pa.nulls(m, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, 2, np.int32)), pa.nulls(m, id_type), pa.array(rows[:, 0]), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.array(rows[:, 1]),
                                           none, none, none, pa.nulls(m, pa.float64()), pa.array(rows[:, 2])], NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, held, id_type = Scorer(shared.value), [], None
        for batch in batches:
            id_type = batch.column("id").type
            for part in tb.chunks(batch, "body_text"):
                cps, offs = tb.codepoints(lookalike.canonical_array(part.column("body_text")))
                if not len(cps):
                    continue
                document, number, starts, ends = tb.lines(cps, offs)
                at, size, scores, closed = scorer.sentences(cps, starts, ends)
                if not len(at):
                    continue
                index, owner = np.arange(len(at)), document[at]
                order = np.argsort(scores, 1, kind="stable")
                best, top = order[:, -1], scores[index, order[:, -1]]
                margin = top - (scores[index, order[:, -2]] if n > 1 else 0)
                sentence = closed & (size >= MIN_WORDS)
                per_document = np.zeros((len(part), n), np.int64)
                np.add.at(per_document, (owner[sentence], best[sentence]), size[sentence])
                loose = per_document.sum(1)[owner] == 0
                total = np.zeros((len(part), n))
                np.add.at(total, owner[loose], scores[loose] * size[loose, None])
                per_document[np.arange(len(part)), total.argmax(1)] += (total.max(1) > 0) * np.bincount(owner[loose], size[loose], len(part)).astype(np.int64)
                main = per_document.argmax(1)
                strong = sentence & (best != main[owner]) & (margin >= STRONG_MARGIN) & (top - scores[index, main[owner]] >= STRONG_LEAD)
                several = np.bincount(owner[strong], minlength=len(part)) > 0
                # bodies of one language
                one = np.flatnonzero((per_document.sum(1) > 0) & ~several)
                weight = np.bincount(owner, np.where(sentence | loose, (scores[index, main[owner]] - np.where(best == main[owner], scores[index, order[:, -2 if n > 1 else -1]], top)) * size, 0), len(part))
                counted = np.bincount(owner, np.where(sentence | loose, size, 0), len(part))
                confidence = np.clip(weight / np.maximum(counted, 1), 0, 1)
                # lines of the others
                rows = np.flatnonzero(several[document])
                words, fragments, foreign, weight = (np.zeros((len(document), n)) for _ in range(4))
                np.add.at(words, (at[closed], best[closed]), size[closed])
                np.add.at(fragments, (at[~closed], best[~closed]), np.where(margin >= FRAGMENT_MARGIN, size, 0)[~closed])
                alone = strong & (margin >= ALONE_MARGIN) & (top - scores[index, main[owner]] >= ALONE_LEAD)
                np.add.at(foreign, (at[strong], best[strong]), 1 + alone[strong])
                weight = np.bincount(at, margin * size, len(document))
                line_words = np.bincount(at, size, len(document))
                letter = tb.classes()[np.minimum(cps, tb.LIMIT)] == tb.LETTER
                line, n_letters = tb.filtered_hashes(tb.lower_table()[np.minimum(cps, tb.LIMIT)], letter, starts, ends)
                line = line.view(np.int64)
                owners = pa.array(np.concatenate([one, document[rows]]))
                m, k = len(one), len(rows)
                nothing = np.zeros((m, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [m, k]).astype(np.int32)), part.column("id").take(owners), part.column("site").take(owners), part.column("label").take(owners),
                     pa.array(np.concatenate([np.zeros(m), number[rows]]).astype(np.int32)), pa.array(np.concatenate([np.zeros(m, np.int64), line[rows]])),
                     lists(np.concatenate([per_document[one], words[rows]])), lists(np.concatenate([nothing, fragments[rows]])), lists(np.concatenate([nothing, foreign[rows]])),
                     pa.array(np.concatenate([confidence[one], np.clip(weight[rows] / np.maximum(line_words[rows], 1), 0, 1)])), pa.nulls(m + k, pa.int64())], NAMES)
                # votes of pages for lines
                lettered = np.flatnonzero(n_letters > 0)
                vote = page_votes(document[lettered], line[lettered], n_letters[lettered], len(part))
                with_sentence = np.isin(lettered, at[sentence])
                sites = part.column("site").to_numpy(zero_copy_only=False)[document[lettered]]
                if with_sentence.any():
                    held.append(np.stack([sites[with_sentence], line[lettered[with_sentence]], vote[with_sentence]], 1))
                if sum(map(len, held)) > 1_000_000:
                    yield votes(held, id_type)
                    held.clear()
        if held:
            yield votes(held, id_type)

    return (records.select("id", F.xxhash64(F.coalesce(site_of(F.col("url")), F.lit(""))).alias("site"), label_code(F.col("language")).alias("label"), "body_text")
            .mapInArrow(scan, schema))


def languages(records: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, label, line_no, language, confidence, is_mixed): the language of each record whose body has words (line_no 0), and for bodies
    with own sentences of several languages each line's languages instead. label is the code that the record's label names. confidence is
    the mean margin of the scores, cut to 0..1. Bodies that are null, blank or without words give no row; repeated rows count once."""
    model = fit(samples)
    codes = model[0]
    if not codes:
        kind = records.schema["id"].dataType.simpleString()
        return records.sparkSession.createDataFrame([], f"id {kind}, label string, line_no int, language string, confidence double, is_mixed boolean")
    rows = materialise(line_languages(records, model))
    name = F.array(*[F.lit(c) for c in codes])
    top = F.element_at(name, F.array_position("words", F.array_max("words")).cast("int"))
    simple = rows.filter("kind = 0").select("id", "label", top.alias("language"), "confidence").dropDuplicates(["id"])
    several = rows.filter("kind = 1").dropDuplicates(["id", "line_no"])
    doubtful = several.select("site", "line").distinct()
    frame = (rows.filter("kind = 2").select("site", "line", "vote").join(doubtful, ["site", "line"], "left_semi")
             .groupBy("site", "line").agg(F.count_distinct("vote").alias("pages")).filter(F.col("pages") >= FRAME_PAGES).select("site", "line"))
    own = materialise(several.join(frame, ["site", "line"], "left_anti"))
    sums = [F.sum(F.element_at(c, i + 1)).alias(f"{c}{i}") for c in ("words", "foreign") for i in range(len(codes))]
    total, evidence = (F.array(*[F.col(f"{c}{i}") for i in range(len(codes))]).alias(c) for c in ("words", "foreign"))
    documents = own.groupBy("id").agg(F.first("label").alias("label"), F.avg("confidence").alias("confidence"), *sums).select("id", "label", "confidence", total, evidence).filter(F.array_max("words") > 0)
    main = F.array_position("words", F.array_max("words")).cast("int")
    present = F.filter(name, lambda c, i: (F.get(F.col("foreign"), i) >= 2) | (i == main - 1))
    documents = documents.select("id", "label", top.alias("language"), "confidence", present.alias("present"))
    single = simple.unionByName(documents.filter(F.size("present") <= 1).drop("present")).select("id", "label", F.lit(0).alias("line_no"), "language", "confidence", F.lit(False).alias("is_mixed"))
    mixed = documents.filter(F.size("present") > 1).select("id", "present")
    in_line = F.filter(name, lambda c, i: (F.get(F.col("words"), i) > 0) & F.array_contains("present", c))
    loose = F.filter(name, lambda c, i: (F.get(F.col("fragments"), i) >= MIN_WORDS - 1) & F.array_contains("present", c))
    chosen = F.when(F.size(in_line) > 0, in_line).otherwise(loose)
    lines = own.join(mixed, "id").select("id", "label", "line_no", F.explode(chosen).alias("language"), "confidence", F.lit(True).alias("is_mixed"))
    return single.unionByName(lines)


def found(records: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, line_no, language): bodies of one language that the label doesn't name, and the lines of bodies in several; pages of list matter
    give no row."""
    rows = languages(records, samples).filter(F.col("is_mixed") | F.col("label").isNull() | (F.col("label") != F.col("language")))
    return rows.select("id", "line_no", "language").join(liststuff.found(records, samples), "id", "left_anti")
