"""Sets of word shingles of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm import lookalike
from quern.llm import textblocks as tb

HASH_BITS = 48  # a chunk has fewer than 2**16 documents


def word_hashes(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-case run of letters or digits, index of its document)."""
    at = np.minimum(cps, tb.LIMIT)
    kind = tb.classes()[at]
    starts, ends = tb.runs((kind == tb.LETTER) | (kind == tb.DIGIT) | (kind == tb.MARK), offs[:-1][offs[:-1] < len(cps)])
    low = np.where(cps < tb.LIMIT, tb.lower_table()[at], cps)
    return tb.span_hashes(low, starts, ends), np.searchsorted(offs, starts, "right") - 1


def shingle_sets(words: np.ndarray, document: np.ndarray, n_documents: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of k successive words, sorted within each document; n_documents + 1 offsets)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(n_documents + 1, np.int64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for i in range(1, k):
            h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i])
    inside = document[:n] == document[k - 1 :]
    # document and hash share a word, so that one plain sort puts the sets in order
    key = document[:n][inside].astype(np.uint64) << np.uint64(HASH_BITS) | h[inside] >> np.uint64(64 - HASH_BITS)
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    offs = np.searchsorted(key, np.arange(n_documents + 1, dtype=np.uint64) << np.uint64(HASH_BITS)).astype(np.int64)
    return key & np.uint64((1 << HASH_BITS) - 1), offs


def batch_sets(title: pa.Array | None, body: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of title, a line break and body in the canonical form. Documents with a blank body have the empty set."""
    body = pc.fill_null(body.cast(pa.string()), "")
    text = lookalike.canonical_array(body)
    blank = pc.equal(pc.utf8_trim_whitespace(text), "")
    if title is not None:
        title = lookalike.canonical_array(pc.fill_null(title.cast(pa.string()), ""))
        text = pc.binary_join_element_wise(title, text, "\n")
    text = pc.if_else(blank, "", text)
    cps, offs = tb.codepoints(text)
    words, document = word_hashes(cps, offs)
    return shingle_sets(words, document, len(text), k)
