"""Pairs of token sets that may have much in common: sets as sorted codes, packed into blocks; every block of one side meets every block of the other.

A code stands for a token's 64-bit hash: rare tokens first, by 30 bits of it, then the frequent ones, by how frequent they are.  Codes may fall together, which
can only make sets look more alike (a set that loses codes so is given them as slack), so no pair is lost; what is found is to be confirmed on the tokens.
Candidates never leave a task: only pairs that are close by their codes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.journal import written

#: Codes and sets of a block at most, frequent tokens, bits of a set's sketch, pairs looked at side by side.
CODES, SETS, FREQUENT, BITS, STEP = 1 << 20, 8192, 1 << 16, 2048, 1 << 20
_PACKED = "side string, block long, ids binary, n binary, m binary, codes binary"
_EPSILON = 1e-9


def frequent(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows of counts(.., df) of the greatest df, at most ``most``, by a bound on df; ties at the bound are all left out."""
    per = counts.groupBy(F.floor(F.log2("df") * 8).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("df")).orderBy(F.desc("size")).collect()  # at most 8 rows a doubling
    bound, n = None, 0
    for r in per:
        n += r["n"]
        if n > most:
            break
        bound = r["df"]
    return counts.where(F.col("df") >= bound) if bound is not None else counts.where(F.lit(False))


def packed(sets: DataFrame, most: int = FREQUENT) -> DataFrame:
    """Blocks of sets(side, class, hashes), none of them empty."""
    each = sets.select(F.explode("hashes").alias("hash"))
    counts = written(each.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    known = np.array([(r["df"], r["hash"]) for r in frequent(counts, most).collect()], np.int64).reshape(-1, 2)
    known = known[np.lexsort((known[:, 1], known[:, 0]))]  # by frequency
    by_hash = np.argsort(known[:, 1])
    hashes, ranks = known[by_hash, 1], (by_hash + (1 << 30)).astype(np.int32)

    def coded(h: np.ndarray) -> np.ndarray:
        out = (h & ((1 << 30) - 1)).astype(np.int32)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            out = np.where(hashes[at] == h, ranks[at], out)
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        count: dict[str, int] = {}

        def out(side: str) -> pa.RecordBatch:
            parts = held.pop(side)
            ids, n, m, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = [[side], [int(ids[0])], *([x.tobytes()] for x in (ids, n, m, codes))]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["side", "block", "ids", "n", "m", "codes"])

        for batch in batches:
            lists = batch.column("hashes")
            ids, sides = batch.column("class").to_numpy(zero_copy_only=False), np.array(batch.column("side").to_pylist())
            at = lists.offsets.to_numpy().astype(np.int64)
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            keys = np.unique((row << 32) | coded(lists.values.to_numpy()[at[0] : at[-1]]))  # sorted by row, then by code
            m = np.bincount(keys >> 32, minlength=len(n))
            ends, codes = np.cumsum(m), (keys & 0xFFFFFFFF).astype(np.int32)
            for side in np.unique(sides):
                for i in np.flatnonzero(sides == side):
                    held.setdefault(side, []).append((ids[i : i + 1], n[i : i + 1].astype(np.int32), m[i : i + 1].astype(np.int32), codes[ends[i] - m[i] : ends[i]]))
                    count[side] = count.get(side, 0) + m[i]
                    if count[side] >= CODES or len(held[side]) >= SETS:
                        count[side] = 0
                        yield out(side)
        for side in list(held):
            yield out(side)

    return sets.select("side", "class", "hashes").mapInArrow(pack, _PACKED)


#: Words of 64 bits of a sketch that travels with a pair.
WORDS = 16


def sketched(sets: DataFrame) -> DataFrame:
    """(id, sketch) of (id, hashes): ``WORDS`` longs, a bit of which is set where an odd number of hashes falls on it."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column("hashes"), len(batch)
            at = lists.offsets.to_numpy().astype(np.int64)
            bit = lists.values.to_numpy()[at[0] : at[-1]] & (64 * WORDS - 1)
            spot = np.repeat(np.arange(rows), np.diff(at)) * (64 * WORDS) + bit
            odd = (np.bincount(spot, minlength=rows * 64 * WORDS) & 1).astype(np.uint8)
            words = pa.array(np.packbits(odd).view(np.int64))
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * WORDS + 1, WORDS, dtype=np.int32)), words)
            yield pa.record_batch([batch.column("id"), made], ["id", "sketch"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "hashes").mapInArrow(sketch, f"id {kind}, sketch array<long>")


class _Block:
    """A block's sets, their sketches, and the codes of their prefixes in order of the sets."""

    def __init__(self, ids: bytes, n: bytes, m: bytes, codes: bytes, least: float) -> None:
        self.ids, self.codes = np.frombuffer(ids, np.int64), np.frombuffer(codes, np.int32)
        self.n, self.m = (np.frombuffer(x, np.int32).astype(np.int64) for x in (n, m))
        self.ends = np.cumsum(self.m)
        self.slack = self.n - self.m
        doc = np.repeat(np.arange(len(self.m)), self.m)
        place = np.arange(len(self.codes)) - np.repeat(self.ends - self.m, self.m)
        kept = place <= (self.m - np.ceil(self.n * least - _EPSILON) + self.slack)[doc]
        self.doc, self.place, self.code = doc[kept], place[kept], self.codes[kept].astype(np.int64)
        # a bit is set where an odd number of codes falls on it, so two sketches differ in no more bits than the sets in codes
        bit = (self.codes.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - BITS.bit_length() + 1)
        spot, times = np.unique(doc * BITS + bit, return_counts=True)
        bits = np.zeros(len(self.m) * BITS, np.uint8)
        bits[spot[times % 2 == 1]] = 1
        self.sketch = np.packbits(bits).view(np.uint64).reshape(len(self.m), BITS // 64)

    def indexed(self) -> _Block:
        """Prefix codes in order of (code, size of the set)."""
        self.key = (self.code << 32) | self.n[self.doc]
        order = np.argsort(self.key, kind="stable")
        self.key, self.doc, self.place = self.key[order], self.doc[order], self.place[order]
        return self

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] - self.m[i] : self.ends[i]]


def _matches(a: _Block, b: _Block, least: float) -> Iterator[tuple[int, int, int]]:
    """(place in a, place in b, codes in common) of the pairs whose codes are close enough, b indexed."""
    size = a.n[a.doc]
    low = np.searchsorted(b.key, (a.code << 32) | np.ceil(size * least - _EPSILON).astype(np.int64))
    high = np.searchsorted(b.key, (a.code << 32) | np.floor(size / least + _EPSILON).astype(np.int64), "right")
    hits = np.maximum(high - low, 0)
    upto = np.concatenate([[0], np.cumsum(hits)])
    last = np.searchsorted(a.doc, np.arange(len(a.m)), "right")  # where each set's prefix ends
    i, doc = 0, 0
    while i < len(hits):
        # whole sets of a, so that a pair is met in one step alone; a single set has no more hits than b has prefix codes
        doc = max(int(np.searchsorted(upto[last], upto[i] + STEP, "right")), doc + 1)
        j = int(last[doc - 1])
        if j > i and upto[j] > upto[i]:
            one = np.repeat(np.arange(i, j), hits[i:j])
            two = low[one] + np.arange(upto[i], upto[j]) - upto[one]
            x, y = a.doc[one], b.doc[two]
            need = np.ceil(least / (1 + least) * (a.n[x] + b.n[y]) - _EPSILON) - np.minimum(a.slack[x], b.slack[y])
            # the first code in common leaves at most this one and those behind it in either set
            pair = np.unique((x * len(b.m) + y)[np.minimum(a.m[x] - a.place[one], b.m[y] - b.place[two]) >= need])
            x, y = np.divmod(pair, len(b.m))
            for k in range(0, len(x), 1 << 15):
                u, v = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                need = np.ceil(least / (1 + least) * (a.n[u] + b.n[v]) - _EPSILON) - np.minimum(a.slack[u], b.slack[v])
                apart = np.bitwise_count(a.sketch[u] ^ b.sketch[v]).sum(axis=1, dtype=np.int64)
                near = apart <= a.m[u] + b.m[v] - 2 * need
                for s, t, w in zip(u[near], v[near], need[near], strict=True):
                    common = len(np.intersect1d(a.of(s), b.of(t), assume_unique=True))
                    if common >= w:
                        yield int(s), int(t), common
        i = j


def close(blocks: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """(a, b, likeness): pairs of classes of two sides of a written table of blocks that have a Jaccard of ``least`` or more by their codes."""
    parallel = blocks.sparkSession.sparkContext.defaultParallelism
    side = lambda s, p: blocks.where(F.col("side") == s).drop("side").withColumnsRenamed({c: p + c for c in ("block", "ids", "n", "m", "codes")})
    count = {r["side"]: r["n"] for r in blocks.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = side(left, "a_").repartition(max(1, min(count.get(left, 1), max(4 * parallel, count.get(left, 1) // 4))), "a_block")
    cells = dealt.crossJoin(side(right, "b_").repartition(max(1, count.get(right, 1) // 4), "b_block"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], _Block] = {}

        def block(r: dict, p: str) -> _Block:
            key = (p, r[f"{p}_block"])
            if key not in known:
                while len(known) > 6:
                    known.pop(next(iter(known)))
                made = _Block(*(r[f"{p}_{c}"] for c in ("ids", "n", "m", "codes")), least)
                known[key] = made.indexed() if p == "b" else made
            return known[key]

        for batch in batches:
            for r in batch.to_pylist():
                a, b = block(r, "a"), block(r, "b")
                found = list(_matches(a, b, least))
                if found:
                    x, y, common = np.array(found).T
                    yield pa.record_batch([pa.array(a.ids[x]), pa.array(b.ids[y]), pa.array(common / (a.m[x] + b.m[y] - common))], ["a", "b", "likeness"])

    return cells.mapInArrow(match, "a long, b long, likeness double")
