"""Problem 8: byte-level BPE of the whole corpus by a tokenization automaton.

Compilation. The automaton starts as one state that reads every byte as its own token. Merges are added in their order;
the gadget of merge (a, b) -> c lets c be read wherever a could be followed by b, and from then on forbids the step from
a token whose right edge is a to a token whose left edge is b. After the last gadget a state is "the last token read",
and a step to token y is allowed exactly if no gadget forbids it. The forbidden steps are not stored one by one (50,000
states squared) but as edge lists: for each token the tokens on its right or left edge with the merge that absorbs them.
The labels of the arcs are byte strings; a trie of them gives the byte transitions.

Encoding. A pre-split word is read byte by byte through the transition table. For each end position the automaton holds
the one arc that can end there in a canonical tokenization; the labels on the path back from the last position are the
tokens. The path is unique, because every prefix of a word has one canonical tokenization. Words are encoded once per
Python worker and looked up by hash afterwards; texts are pre-split and gathered as arrays.

Decoding. Emit the labels of the arcs and read the bytes as UTF-8.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm import textblocks as tb

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
NEVER = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of byte-level BPE: printable Latin-1 stays, the rest follows from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_merges(path: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return merges, model["vocab"]


class Automaton:
    """merges: pairs in order of priority, in stand-in characters; ids: the id of each token."""

    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int]):
        alphabet = byte_alphabet()
        self.labels: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in ids.items() if all(c in alphabet for c in s)}
        self.gadgets: dict[int, int] = {}
        # edge lists: (token on the edge, rank of the merge that absorbs it there)
        right: dict[int, list[tuple[int, int]]] = {}
        left: dict[int, list[tuple[int, int]]] = {}
        self.delta: dict[int, int] = {}
        self.emits: list[int] = [-1]
        for s, i in ids.items():
            if len(s) == 1 and s in alphabet:
                right[i], left[i] = [(i, NEVER)], [(i, NEVER)]
                self._arc(i)
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, ids[a], ids[b], ids[a + b], right, left)
        self.right, self.left = right, left
        self.allowed: dict[int, bool] = {}

    def _arc(self, token: int) -> None:
        state = 0
        for byte in self.labels[token]:
            key = state << 8 | byte
            following = self.delta.get(key)
            if following is None:
                following = self.delta[key] = len(self.emits)
                self.emits.append(-1)
            state = following
        self.emits[state] = token

    def _gadget(self, rank: int, a: int, b: int, c: int, right: dict, left: dict) -> None:
        self.gadgets[a << 20 | b] = rank
        if c not in right:
            right[c] = [(c, NEVER), (b, rank), *right[b][1:]]
            left[c] = [(c, NEVER), (a, rank), *left[a][1:]]
            self._arc(c)

    def step_allowed(self, x: int, y: int) -> bool:
        """Whether token y may follow token x. A merge across the border forbids it, if both of its parts are still on the edges
        when its turn comes; of equal merges the left one comes first."""
        key = x << 20 | y
        known = self.allowed.get(key)
        if known is None:
            known = True
            gadgets = self.gadgets
            for a, until_a in self.right[x]:
                for b, until_b in self.left[y]:
                    rank = gadgets.get(a << 20 | b)
                    if rank is not None and rank < until_a and rank <= until_b:
                        known = False
                        break
                if not known:
                    break
            self.allowed[key] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        if not n:
            return []
        delta, emits, allowed, labels = self.delta, self.emits, self.allowed, self.labels
        arc = [-1] * n
        for start in range(n):
            before = arc[start - 1] if start else -1
            if start and before < 0:
                continue
            state = 0
            for end in range(start, n):
                state = delta.get(state << 8 | word[end])
                if state is None:
                    break
                token = emits[state]
                if token >= 0 and arc[end] < 0:
                    if start:
                        ok = allowed.get(before << 20 | token)
                        if ok is None:
                            ok = self.step_allowed(before, token)
                        if not ok:
                            continue
                    arc[end] = token
        out, at = [], n - 1
        while at >= 0:
            out.append(arc[at])
            at -= len(labels[arc[at]])
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def compile_automaton(path: str) -> Automaton:
    return Automaton(*read_merges(path))


def split_words(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of the pre-split words of byte-level BPE: English contraction endings; a run of letters, of numbers or of other
    signs, each with one plain space before it; white space up to the last character before such a run, or to the end.
    Gives (starts, ends) in order."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = tb.classes()[np.minimum(cps, tb.LIMIT)]
    kind[(kind == tb.MARK)] = tb.OTHER
    for c in (28, 29, 30, 31):
        kind[cps == c] = tb.OTHER
    if (cps >= tb.LIMIT).any():
        import unicodedata

        for at in np.flatnonzero(cps >= tb.LIMIT):
            k = unicodedata.category(chr(int(cps[at])))[0]
            kind[at] = tb.LETTER if k == "L" else tb.DIGIT if k == "N" else tb.OTHER
    begins = np.zeros(n + 1, bool)
    begins[0] = begins[n] = True
    begins[1:n] = kind[1:] != kind[:-1]
    document = np.zeros(n + 1, bool)
    document[offs] = True
    begins |= document
    # a run of white space gives its last character away: to the next word if it is a plain space, else as a word of its own
    run_end = np.flatnonzero(begins[1:]) + 1
    white = (kind[run_end - 1] == tb.SPACE) & ~document[run_end]
    e = run_end[white]
    begins[e - 1] = True
    attach = e[cps[e - 1] == 32]
    begins[attach] = False
    # contractions: an apostrophe that begins a word and stands before letters
    apostrophe = np.flatnonzero((cps == 39) & begins[:n])
    apostrophe = apostrophe[apostrophe + 1 < n]
    if len(apostrophe):
        one = cps[apostrophe + 1]
        inside = ~document[apostrophe + 1]
        two = np.where(apostrophe + 2 < n, cps[np.minimum(apostrophe + 2, n - 1)], 0)
        two = np.where(document[np.minimum(apostrophe + 2, n)], 0, two)
        single = inside & np.isin(one, [ord(c) for c in "stmd"])
        double = inside & np.isin(one.astype(np.int64) * 65536 + two, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")])
        for hit, size in ((apostrophe[single], 2), (apostrophe[double & ~single], 3)):
            begins[hit + 1] = False
            if size == 3:
                begins[hit + 2] = False
            stop = hit + size
            letter = stop[(stop < n)]
            begins[letter] = True
    at = np.flatnonzero(begins)
    return at[:-1], at[1:]


class WordTable:
    """The words that this worker has encoded: sorted hashes, and the ids of all words in one array. Beyond most words it starts anew."""

    def __init__(self, path: str, most: int = 600_000):
        self.automaton, self.most = compile_automaton(path), most
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def lookup(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index in the table of each word; unknown words are encoded first."""
        hashes = tb.span_hashes(cps, starts, ends)
        if len(self.hashes) > self.most:
            self.clear()
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == unique[known]
        if not known.all():
            new = first[~known]
            encode = self.automaton.encode_word
            words = [encode(cps[a:b].tobytes().decode("utf-32-le", "replace").encode()) for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            counts = np.array([len(w) for w in words], np.int64)
            flat = np.fromiter((i for w in words for i in w), np.int32, int(counts.sum()))
            base = len(self.ids)
            self.ids = np.concatenate([self.ids, flat])
            merged = np.concatenate([self.hashes, unique[~known]])
            order = np.argsort(merged, kind="stable")
            self.hashes = merged[order]
            self.starts = np.concatenate([self.starts, base + np.cumsum(counts) - counts])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
            at = np.searchsorted(self.hashes, unique)
        return at[inverse]

    def encode(self, strings: pa.Array, counts_only: bool = False):
        """Number of tokens of each value and, unless counts_only, all ids in one array."""
        cps, offs = tb.codepoints(strings)
        starts, ends = split_words(cps, offs)
        if not len(starts):
            return np.zeros(len(strings), np.int64), np.zeros(0, np.int32)
        words = self.lookup(cps, starts, ends)
        sizes = self.counts[words]
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        per_document = np.diff(total[np.searchsorted(starts, offs)])
        if counts_only:
            return per_document, None
        return per_document, self.ids[tb.expand(self.starts[words], sizes)]


@lru_cache(1)
def word_table(path: str) -> WordTable:
    return WordTable(path)


def encode_documents(documents: DataFrame, path: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every text, an empty list for null and empty texts. One row per input row, repeated rows
    included; other columns are not read. Special tokens are never produced: their strings are ordinary text. No shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for batch in batches:
            for part in tb.chunks(batch, text):
                sizes, ids = table.encode(part.column(text))
                bounds = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=bounds[1:])
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, path: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens), as encode_documents counts them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for batch in batches:
            for part in tb.chunks(batch, text):
                sizes, _ = table.encode(part.column(text), counts_only=True)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(sizes)], [key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_tokens bigint")
