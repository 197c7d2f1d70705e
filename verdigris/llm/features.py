"""Document statistics for the quality classifier, in numpy over a batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hash_runs, utf8, word_runs

_KIND = np.full(256, 7, np.uint8)  # other ASCII signs
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[10] = 1
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 2
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 3
_KIND[[ord(c) for c in "0123456789"]] = 4
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 5
_KIND[[ord(c) for c in "|{}<>[]=+\\/_~^"]] = 6
_KIND[128:192] = 8  # later bytes of a character
_KIND[192:] = 9  # first bytes of a character outside ASCII

NAMES = ["log_bytes", "space", "line", "lower", "upper", "digit", "stop", "markup", "sign", "wide", "words_log", "word_length", "distinct_words", "most_common_word", "distinct_lines", "longest_word_log", "bang", "short_words", "capitals_start", "lines_log"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text; a null or empty text has zeros everywhere."""
    n = len(texts)
    out = np.zeros((n, len(NAMES)), np.float32)
    body, at = utf8(texts)
    size = np.diff(at)
    full = size > 0
    if not full.any():
        return out
    starts, div = at[:-1][full], size[full].astype(np.float64)
    kind = _KIND[body]
    for k in range(10):
        if k != 8:
            out[full, 1 + k - (k == 9)] = np.add.reduceat((kind == k).astype(np.int32), starts) / div
    out[:, 0] = np.log1p(size)
    out[full, 16] = np.add.reduceat((body == 33).astype(np.int32), starts) / div
    first, last, doc = word_runs(body, at)
    if len(first):
        length = last - first
        words = np.bincount(doc, minlength=n)
        some = words > 0
        out[some, 10] = np.log1p(words[some])
        out[some, 11] = np.bincount(doc, length, n)[some] / words[some]
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc, length)
        out[some, 15] = np.log1p(longest[some])
        out[some, 17] = np.bincount(doc, length <= 3, n)[some] / words[some]
        out[some, 18] = np.bincount(doc, kind[first] == 3, n)[some] / words[some]
        key = hash_runs(body, first, last) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = np.ones(len(key), bool)
        same[1:] = key[order][1:] != key[order][:-1]
        heads = np.flatnonzero(same)
        times = np.diff(np.append(heads, len(key)))
        owner = doc[order][heads]
        out[some, 12] = np.bincount(owner, minlength=n)[some] / words[some]
        most = np.zeros(n, np.int64)
        np.maximum.at(most, owner, times)
        out[some, 13] = most[some] / words[some]
    lines = pc.split_pattern(texts.fill_null(""), "\n")
    lengths = np.asarray(pc.list_value_length(lines))
    owner = np.repeat(np.arange(n), lengths)
    codes = np.asarray(lines.flatten().dictionary_encode().indices).astype(np.int64)
    pairs = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1)
    out[full, 14] = np.bincount(pairs, minlength=n)[full] / lengths[full]
    out[full, 19] = np.log1p(lengths[full])
    return out
