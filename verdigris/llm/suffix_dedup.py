"""Suffix-array dedup: bytes covered by a string of a given length that also starts elsewhere.

Two lengths at most are searched at once: ``lengths`` = (passage, length), the shorter one being the threshold of the search.  A string of the threshold's length that occurs
twice has, in both places, the same anchor, the least 16-byte gram by hash, the last one of equal ones.  Anchors (winnowing) are one in some 120 bytes.  A longer string is found
by the anchor of its first part.  So a place of an anchor needs a context of the threshold less 16 bytes before it and the greatest length behind it.

Narrow rows come first: a 64-bit hash of each context beside its anchor.  Equal contexts are a class: what it covers repeats wherever its class has two places, and one place of the
class, its representative, stands for it in the search.  Only texts with a representative are read again for the bytes of their contexts.

Over the contexts of an anchor the search is that of threshold-bounded interval expansion on a Burrows-Wheeler transform.  The suffixes that start at the
anchor are sorted, with the common prefixes of neighbours; then, breadth first, all suffixes are extended backward by a byte at a time: a stable sort by the
new byte takes the order to the next column, as the last-to-first mapping does, and common prefixes grow by one where neighbours in the new order
have the same new byte, from the minimum over the range they came from.  After l steps the order is that of the suffixes that start l bytes before the anchor, and neighbours
with a common prefix of a length or more share the window that starts there.  Only intervals that the new byte divides are sorted, and a suffix whose interval is too short to
reach the threshold any more leaves the order, so lone ones are not extended; prefixes are bounded by the greatest length; and the expansion stops when no window has the anchor in it any more.

An interval with more than ``MOST`` contexts is expanded by grouping instead, so that no task holds it (``expanded``): a range of window starts is an interval by the string that
all its windows have in common; intervals of one context are dropped, those whose longest string is shared are found whole, all others are cut into four.

Edge cases: null and empty texts have 0 bytes and nothing removed; texts shorter than a length are left alone; overlapping repeats and periodic texts
count, the same document included; rows that repeat an id are separate occurrences and each is judged; extra columns are ignored by ``judged`` and kept by ``without_repeats``,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, by_ids, dropped, mixed, partitions_for, utf8, written

LENGTH = 400
#: Fifty words of five bytes: the shorter length that is reported, and that the pipeline cuts by.
PASSAGE = 250
GRAM = 16
#: Contexts of an anchor that one task sorts.
MOST = 8192
#: Window starts of the first intervals of ``expanded``; a power of four.
WIDE = 64
#: Texts are anchored in pieces of so many bytes, so that a place fits the low bits of a key.
PIECE = 1 << 19
_PLACE = np.uint64(PIECE * 2 - 1)


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchor of every window of ``length`` bytes, each once, in ascending place."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found_h, found_p = [], []
    step = PIECE - length + 1
    for start in range(0, n - length + 1, step):
        piece = np.ascontiguousarray(text[start : start + PIECE])
        words = np.ndarray((len(piece) - 7,), np.dtype("<u8"), piece.data, 0, (1,))
        h = mixed(words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:])
        key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        width = length - GRAM + 1
        full = -(-len(key) // width) * width
        padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(key) - width + 1
        least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
        least = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
        place = (_PLACE - (least & _PLACE)).astype(np.int64)
        found_h.append(h[place])
        found_p.append(place + start)
    hashes, places = np.concatenate(found_h), np.concatenate(found_p)
    places, first = np.unique(places, return_index=True)
    return hashes[first], places


def _once(texts: pa.Array, seen: set, least: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(digest, bytes) of texts of ``least`` bytes or more that a task meets for the first time: one stands for its copies."""
    body, at = utf8(texts)
    view = memoryview(body)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= least:
            tid = xxhash.xxh3_128_digest(view[a:b])
            if tid not in seen:
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(tid)
                yield tid, body[a:b]


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, tid (digest of the text), n_bytes, sha256 of the whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            body, at = utf8(batch.column(1))
            view = memoryview(body)
            tids = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tids, pa.binary()), pa.array(np.diff(at)), pa.array(sha, pa.string())], ["doc_id", "tid", "n_bytes", "sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tid binary, n_bytes long, sha256 string")


MARKS = "anchor long, ctx long, tid binary, places array<int>, n_left int, n_right int"


def text_anchors(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """MARKS: a row for each distinct context of each text, by the hash of its bytes, with its places and the bytes that it has on either side."""
    least, most = lengths[0], lengths[-1]
    reach = least - GRAM
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in MARKS.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches(it):
            rows: list[tuple] = []
            for tid, text in _once(batch.column(0), seen, least):
                view, n = memoryview(text), len(text)
                h, places = anchors(text, least)
                own: dict[tuple[int, int], list] = {}
                for a, p in zip(h.view(np.int64).tolist(), places.tolist(), strict=True):
                    low, high = max(0, p - reach), min(n, p + most)
                    ctx = xxhash.xxh3_64_intdigest(view[low:high], (p - low) << 16 | (high - p)) - (1 << 63)
                    own.setdefault((a, ctx), [tid, [], p - low, high - p])[1].append(p)
                rows += [(*k, *v) for k, v in own.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("text").mapInArrow(run, MARKS)


def bodies(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """wanted, a written table with distinct tid, with the text's bytes: digests meet the wanted ones before bytes are moved."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches(it):
            found = list(_once(batch.column(0), seen, least))
            if found:
                tids, texts = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array([t.tobytes() for t in texts], pa.binary())], ["tid", "body"])

    each = by_ids(docs.select("text").mapInArrow(run, "tid binary, body binary"), wanted.select("tid"), column="tid")
    return each.groupBy("tid").agg(F.first("body").alias("body")).join(wanted, "tid")


def contexts(texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """From (body, wanted: array of anchor, ctx, place, hot): anchor, ctx, hot, left, right."""
    reach, most = lengths[0] - GRAM, lengths[-1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 64, 2 << 20):
            out: list[tuple] = []
            for body, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = body.as_py()
                for w in wanted.as_py():
                    p = w["place"]
                    out.append((w["anchor"], w["ctx"], w["hot"], data[max(0, p - reach) : p], data[p : p + most]))
                if len(out) > 4096:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "ctx", "hot", "left", "right"])

    return texts.select("body", "wanted").mapInArrow(run, "anchor long, ctx long, hot boolean, left binary, right binary")


def _padded(column: pa.Array, width: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, zeros before (or, with right, after) them, and their lengths."""
    body, at = utf8(column)
    size = np.diff(at)
    out = np.zeros((len(size), width), np.uint8)
    cells = np.arange(width)[None, :] < size[:, None] if right else np.arange(width)[None, :] >= width - size[:, None]
    out[cells] = body
    return out, size


def shared_windows(group: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length (context, low, high): the stretches of windows, from low to high bytes before the anchor on, that another context of the group has too.

    group ascends; contexts are distinct inside a group.  A step sorts only the intervals that the new byte divides.
    """
    m, least, most = len(group), lengths[0], lengths[-1]
    reach = np.minimum(n_left, least - GRAM)
    # order of the suffixes at the anchor: by group, then bytes; zeros behind the end are told from zero bytes by the length, as last key
    words = np.ascontiguousarray(np.pad(right, ((0, 0), (0, -right.shape[1] % 8)))).view(">u8")
    order = np.lexsort((n_right, *(words[:, j] for j in range(words.shape[1] - 1, -1, -1)), group))
    differs = right[order][1:] != right[order][:-1]
    common = np.where(differs.any(1), differs.argmax(1), right.shape[1])
    common = np.minimum(common, np.minimum(n_right[order][1:], n_right[order][:-1]))
    lcp = np.full(m + 1, -1, np.int32)  # lcp[i]: of order[i - 1] and order[i]; -1 where an interval begins
    lcp[1:m] = np.where(group[order][1:] == group[order][:-1], np.minimum(common, most), -1)
    by_byte = np.ascontiguousarray(left.T)
    since = [np.full(m, -1, np.int32) for _ in lengths]
    before = [np.zeros(m, bool) for _ in lengths]
    found: list[list[np.ndarray]] = [[] for _ in lengths]
    for l in range(least - GRAM + 1):
        if l:
            column = by_byte[len(by_byte) - l][order].astype(np.int16)
            column[n_left[order] < l] = 256
            inner = lcp[1:-1] >= 0
            divides = inner & (column[1:] != column[:-1])
            if divides.any():
                interval = np.concatenate([[0], np.cumsum(~inner)])
                touched = np.zeros(interval[-1] + 1, bool)
                touched[interval[1:][divides]] = True
                at = np.flatnonzero(touched[interval])
            else:
                at = np.zeros(0, np.int64)
            depths = lcp[at]
            kept = np.flatnonzero(lcp[:-1] >= 0)
            lcp[kept] = np.where(column[kept] != 256, np.minimum(lcp[kept] + 1, most), -1)
            if len(at):
                own, bytes_, place = order[at], column[at], interval[at]
                depth = np.where(np.concatenate([[False], place[1:] == place[:-1]]), depths, -1)
                key = place * 512 + bytes_
                new = np.argsort(key, kind="stable")
                sorted_key = key[new]
                joined = (sorted_key[1:] == sorted_key[:-1]) & (bytes_[new][1:] != 256)
                # minimum of the depths over (p, q] for neighbours p < q of the old order
                p, q = new[:-1] + 1, new[1:] + 1
                ends = np.empty(2 * len(p), np.int64)
                ends[0::2], ends[1::2] = np.where(joined, p, 0), np.where(joined, q, 1)
                low = np.minimum.reduceat(np.append(depth, -1), ends)[0::2]
                order[at] = own[new]
                lcp[at[0]] = -1
                lcp[at[1:]] = np.where(joined, np.minimum(low + 1, most), -1)
        for length, opened, was, out in zip(lengths, since, before, found, strict=True):
            equal = lcp >= length
            hit = np.zeros(m, bool)
            hit[order[equal[1:] | equal[:-1]]] = True
            out += _turned(hit, was, opened, l)
            was[:] = hit
        if l % 4 == 0:
            # a suffix stays while its interval can still reach the threshold
            best = np.maximum(lcp[1:], lcp[:-1])
            stays = np.flatnonzero((best >= 0) & (best + reach[order] - l >= least))
            if not len(stays):
                break
            if len(stays) < len(order):
                fresh = np.full(len(stays) + 1, -1, np.int32)
                if len(stays) > 1:
                    fresh[1:-1] = np.minimum.reduceat(lcp[: stays[-1] + 1], stays[:-1] + 1)
                order, lcp = order[stays], fresh
    for opened, was, out in zip(since, before, found, strict=True):
        out += _turned(np.zeros(m, bool), was, opened, l + 1)
    none = np.zeros(0, np.int64)
    return [tuple(np.concatenate(out[i::3]) if out else none for i in range(3)) for out in found]


def _turned(hit: np.ndarray, was: np.ndarray, opened: np.ndarray, l: int) -> list[np.ndarray]:
    """(context, low, high) of the stretches that end before step l; those that begin are noted in opened."""
    turned = np.flatnonzero(hit != was)
    begins = hit[turned]
    ends = turned[~begins]
    out = [ends, opened[ends].astype(np.int64), np.full(len(ends), l - 1)] if len(ends) else []
    opened[turned[begins]] = l
    return out


FOUND = "anchor long, ctx long, length int, low int, high int"


def solved(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """FOUND: stretches of window starts, as bytes before the anchor, that contexts share with others, from contexts dealt by anchor and sorted by it."""

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        anchor, ctx = np.asarray(table["anchor"]), np.asarray(table["ctx"])
        group = np.unique(anchor, return_inverse=True)[1]
        left, n_left = _padded(table["left"], lengths[0] - GRAM, False)
        right, n_right = _padded(table["right"], lengths[-1], True)
        for length, (c, low, high) in zip(lengths, shared_windows(group, left, n_left, right, n_right, lengths), strict=True):
            if len(c):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[c]), pa.array(ctx[c]), pa.array(np.full(len(c), length, np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["anchor", "ctx", "length", "low", "high"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches(it, 4096, 8 << 20):
            keys = np.asarray(batch.column(0))
            held += batch.num_rows
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if held >= 8192 and (cut or (rest and rest[-1].column(0)[-1].as_py() != keys[0])):
                yield from solve([*rest, batch.slice(0, cut)] if cut else rest)
                rest, held = [batch.slice(cut)], batch.num_rows - cut
            else:
                rest.append(batch)
        if rest:
            yield from solve(rest)

    return rows.select("anchor", "ctx", "left", "right").mapInArrow(run, FOUND)


def expanded(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """FOUND for the contexts (anchor, ctx, left, right) of anchors that no task should hold, interval by interval.

    An interval is a range low..high of window starts of one length.  Its core is what all its windows have in common, its hull what they cover together.
    Contexts that share their core with none are dropped, those that share their hull have the range whole and one of them goes on for all,
    and what goes on is cut into four.
    Each level is grouped by 128-bit digests, combined before the shuffle.
    """
    last = lengths[0] - GRAM
    level = written(rows.select("anchor", "ctx", F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.lit(a).alias("low"), F.lit(min(a + WIDE - 1, last)).alias("high")) for n in lengths for a in range(0, last + 1, WIDE)])).alias("r")).select("anchor", "ctx", "r.*"), "intervals")

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 4096):
            cores, hulls = [], []
            for a, n, low, high, left, right in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                core = hull = None
                if max(low, n - len(right)) <= min(high, len(left)):
                    head = b"%d %d %d %d " % (a, n, low, high)
                    core = xxhash.xxh3_128_digest(head + left[len(left) - low :] + right[: n - high])
                    if high <= len(left) and n - low <= len(right):
                        hull = xxhash.xxh3_128_digest(head + left[len(left) - high :] + right[: n - low])
                cores.append(core), hulls.append(hull)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cores, pa.binary()), pa.array(hulls, pa.binary())], ["anchor", "ctx", "length", "low", "high", "core", "hull"])

    found, width = None, WIDE
    while True:
        with_bytes = level.join(rows.select("anchor", "ctx", "left", "right"), ["anchor", "ctx"]).select("anchor", "ctx", "length", "low", "high", "left", "right")
        digests = written(with_bytes.mapInArrow(keyed, f"{FOUND}, core binary, hull binary").where("core IS NOT NULL"), "interval-digests")
        by_hull = digests.where("hull IS NOT NULL").groupBy("hull").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("ctx"), *[F.first(c).alias(c) for c in ("anchor", "length", "low", "high", "core")])
        hulls = written(by_hull.where("n > 1"), "hulls")
        whole = by_ids(digests, hulls.select("hull"), column="hull").select("anchor", "ctx", "length", "low", "high")
        found = whole if found is None else found.union(whole)
        if width == 1:
            return found
        width //= 4
        # one of those that share a hull goes on as a partner for others
        columns = ["anchor", "ctx", "length", "low", "high", "core"]
        alone = digests.where("hull IS NULL").select(columns).union(by_ids(digests.where("hull IS NOT NULL"), hulls.select("hull"), "left_anti", "hull").select(columns))
        left = written(alone.union(hulls.select(columns)), "interval-rest")
        cores = written(left.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "cores")
        rest = by_ids(left, cores, column="core")
        quarters = F.transform(F.sequence(F.col("low"), F.col("high"), F.lit(width)), lambda a: F.struct(a.alias("a"), F.least(a + (width - 1), F.col("high")).alias("b")))  # noqa: B023
        following = written(rest.select("anchor", "ctx", "length", F.explode(quarters).alias("r")).select("anchor", "ctx", "length", F.col("r.a").alias("low"), F.col("r.b").alias("high")), "intervals")
        dropped(level)
        level = following
        if level.isEmpty():
            return found


def spans_of(marks: DataFrame, found: DataFrame) -> DataFrame:
    """(tid, length, start, end): the stretches at the places of their contexts, those of one row merged."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 4096):
            rows = []
            for tid, places, length, low, high in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows += [(tid, length, a, b) for a, b in union_of([(p - high, p - low + length) for p in places])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.binary(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["tid", "length", "start", "end"])

    at = marks.join(found, ["anchor", "ctx"]).select("tid", "places", "length", "low", "high")
    return at.mapInArrow(run, "tid binary, length int, start long, end long")


def judged(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), keep_text: bool = False) -> DataFrame:
    """doc_id, tid, n_bytes, and for the greatest length n_removed, n_spans, kept_sha256; n_passage: bytes covered by strings of the least length;
    with keep_text the bytes that stay, as ``kept_bytes``.

    Strings are judged on the input.  Every row of docs is an occurrence.
    """
    lengths = tuple(sorted(lengths))
    least, most = lengths[0], lengths[-1]
    parts = partitions_for(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = written(text_digests(docs), "digests")
    copies = digests.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min("n_bytes").alias("n_bytes"))
    marks = written(text_anchors(docs, lengths), "anchors")
    each = marks.groupBy("anchor", "ctx").agg(F.sum(F.size("places")).alias("n"), F.min(F.struct("tid", F.col("places")[0].alias("place"))).alias("rep"), F.first("n_left").alias("n_left"), F.first("n_right").alias("n_right"))
    several = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).where(F.col("all") > 1).select("anchor", "k")
    classes = written(each.join(several, "anchor"), "classes")
    # a class with two places or more repeats over all of its context
    ranges = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.greatest(F.lit(0), F.lit(n) - F.col("n_right")).alias("low"), F.col("n_left").alias("high")) for n in lengths]))
    again = classes.where("n > 1").select("anchor", "ctx", ranges.alias("r")).select("anchor", "ctx", "r.*").where("low <= high")
    wanted = classes.where("k > 1").groupBy(F.col("rep.tid").alias("tid")).agg(F.collect_list(F.struct("anchor", "ctx", F.col("rep.place").alias("place"), (F.col("k") > MOST).alias("hot"))).alias("wanted"))  # as long as one text has anchors
    places = written(contexts(bodies(docs, written(wanted, "representatives"), least), lengths), "contexts")
    found = again.union(solved(places.where("!hot").repartition(parts, "anchor").sortWithinPartitions("anchor"), lengths))
    hot = places.where("hot")
    if not hot.isEmpty():
        found = found.union(expanded(hot, lengths))
    spans = spans_of(marks, written(found, "found").distinct())
    merged = written(spans.groupBy("tid").agg(F.collect_set(F.struct("length", "start", "end")).alias("spans")), "spans")  # as long as one text has anchors
    dropped(places)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows = []
            for tid, body, spans_of in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by_length = {n: union_of([(s["start"], s["end"]) for s in spans_of if s["length"] == n]) for n in lengths}
                stay, at = [], 0
                for a, b in by_length[most]:
                    stay.append(body[at:a])
                    at = b
                left = b"".join([*stay, body[at:]])
                rows.append((tid, len(body) - len(left), len(by_length[most]), hashlib.sha256(left).hexdigest(), sum(b - a for a, b in by_length[least]), left if keep_text else None))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["tid", "n_removed", "n_spans", "kept_sha256", "n_passage", "kept_bytes"])

    pieces = bodies(docs, merged, least).select("tid", "body", "spans").mapInArrow(cut, "tid binary, n_removed long, n_spans long, kept_sha256 string, n_passage long, kept_bytes binary")
    whole = lambda n: (F.col("copies") > 1) & (F.col("n_bytes") >= n)
    per_text = copies.join(pieces, "tid", "left").withColumn("whole", whole(most)).withColumn("passage", whole(least)).drop("copies", "n_bytes")
    nothing = hashlib.sha256(b"").hexdigest()
    none = F.lit(0).cast("long")
    return digests.join(per_text, "tid").select(
        "doc_id",
        "tid",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("n_spans", none)).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(F.col("passage"), F.col("n_bytes")).otherwise(F.coalesce("n_passage", none)).alias("n_passage"),
        F.when(F.col("whole"), F.lit(bytearray())).otherwise(F.col("kept_bytes")).alias("kept_bytes"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, in their columns, without the repeated strings; n_chars, where there is one, follows the text.

    Only the rows that lose something are shuffled.  Bytes of a character that a cut has split go as well.  Rows without an id stay as they are.
    """
    marked = judged(docs, (length,), keep_text=True).where("n_removed > 0 AND doc_id IS NOT NULL")
    kind = docs.schema["doc_id"].dataType
    changes = written(marked.select(F.col("doc_id").cast(kind).alias("__cut_id"), F.col("tid").alias("__cut_tid"), F.col("kept_bytes").alias("__cut_bytes")).dropDuplicates(["__cut_id", "__cut_tid"]), "cut-texts")
    ids = written(changes.select(F.col("__cut_id").alias("doc_id")).distinct(), "cut-ids")

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xxhash.xxh3_128_digest((t or "").encode()))

    @F.pandas_udf("string")
    def decoded(left: pd.Series) -> pd.Series:
        return left.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    touched = by_ids(docs, ids).withColumn("__cut_row", digest("text"))
    joined = touched.join(changes, (F.col("doc_id") == F.col("__cut_id")) & (F.col("__cut_row") == F.col("__cut_tid")), "left").withColumn("__cut_text", decoded("__cut_bytes"))
    columns = {"text": F.when(F.col("__cut_tid").isNotNull(), F.col("__cut_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("__cut_tid").isNotNull(), F.length("__cut_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return by_ids(docs, ids, "left_anti").unionByName(joined.withColumns(columns).select(*docs.columns))


def union_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
