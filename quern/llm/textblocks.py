"""Vectorised views of Arrow string columns: code points, lines and words as numpy arrays.

Every per-character step of the llm operators runs on whole batches here, so that no Python object is made for a
character, a word or a line.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 0x30000  # code points from here on belong to no script that the operators distinguish
LETTER, MARK, DIGIT, SPACE, OTHER = 1, 2, 3, 4, 0
CHUNK_CHARS = 1_500_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point below LIMIT: LETTER, MARK, DIGIT (every \\p{N}), SPACE or OTHER."""
    table = np.zeros(LIMIT + 1, np.uint8)
    for c in range(LIMIT):
        k = unicodedata.category(chr(c))
        table[c] = LETTER if k[0] == "L" else MARK if k[0] == "M" else DIGIT if k[0] == "N" else OTHER
    for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = SPACE
    return table


@lru_cache(1)
def lower_table() -> np.ndarray:
    table = np.arange(LIMIT + 1, dtype=np.uint32)
    for c in range(LIMIT):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]), dtype=np.uint64)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def codepoints(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all values in one array, n + 1 offsets). A null counts as an empty value."""
    if strings.null_count:
        strings = strings.fill_null("")
    if not pa.types.is_string(strings.type):
        strings = strings.cast(pa.string())
    n = len(strings)
    buffers = strings.buffers()
    offs = np.frombuffer(buffers[1], np.int32, n + 1 + strings.offset)[strings.offset :].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[offs[0] : offs[-1]] if buffers[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if not len(raw):
        return np.zeros(0, np.uint32), offs
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, starts[offs]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of column each; a longer value is a slice by itself."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.maximum(np.cumsum(sizes) // limit, np.arange(batch.num_rows) // 50_000)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of mask that cross none of the positions in breaks."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | cut[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for spans that are sorted, apart and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        terms = mix(values.astype(np.uint64) + np.uint64(1)) * up[: len(values)]
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def filtered_hashes(values: np.ndarray, keep: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the kept values in each span, and how many there are."""
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    a, b = before[starts], before[ends]
    return span_hashes(values[keep], a, b) if len(starts) else np.zeros(0, np.uint64), b - a


def lines(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, line number from 1, start, end) of every line; a document without text has none; \\r stays in its line."""
    n = len(offs) - 1
    full = np.flatnonzero(offs[1:] > offs[:-1])
    nl = np.flatnonzero(cps == 10)
    starts = np.sort(np.concatenate([offs[:-1][full], nl + 1]))
    # a newline that ends a document opens an empty last line of it
    order = np.concatenate([offs[:-1][full] * 2 + 1, (nl + 1) * 2])
    order.sort()
    starts = order // 2
    doc_of_new = np.concatenate([full, np.searchsorted(offs, nl, "right") - 1])
    key = np.concatenate([offs[:-1][full] * 2 + 1, (nl + 1) * 2])
    doc = doc_of_new[np.argsort(key, kind="stable")]
    ends = np.empty_like(starts)
    if len(starts):
        ends[:-1] = starts[1:] - 1
        ends[-1] = offs[-1]
        last = np.append(doc[1:] != doc[:-1], True)
        ends[last] = offs[doc[last] + 1]
    first = np.zeros(len(doc), np.int64)
    if len(doc):
        new = np.append(True, doc[1:] != doc[:-1])
        idx = np.flatnonzero(new)
        first = idx[np.cumsum(new) - 1]
    number = np.arange(len(doc)) - first + 1
    del n
    return doc, number, starts, ends


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(at, counts) + np.repeat(starts, counts)
