"""Token-id files: documents as ids in blocks of the range coder, in ascending order of the document's id.

A file row is a block: bucket and block number give its place, ``before`` the ids of the bucket before it, ``ids`` how many it has, ``doc`` and ``doc_ids`` which documents it
holds and how many ids of each (a document may run over several blocks), ``payload`` the coded block.  Buckets are ranges of the document id, so
buckets in order, and blocks in order inside them, are all documents in order.  Spark writes and reads the rows, so files live in any store that it knows.

Edge cases: null and empty texts have only the end id; rows that repeat an id stay separate documents, ordered by text; rows without an id come last; an empty table
writes no block; a damaged block raises ``DamagedBlock`` on reading; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import range_coder
from .bpe import tokenizer_file
from .common import Remembered, batches, bucket_of, id_bounds, pair_keys, pair_slots, partitions_for, strings, uncollected, utf8, written

END = 2
#: Words in each of the two generations that a task remembers.
REMEMBERED = 300_000
#: A private character that hardly any text has.
MARK = "\ue000"
#: How the public file normalises and splits texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SCHEMA = "bucket int, block int, before long, ids int, doc array<long>, ordinal array<long>, doc_ids array<int>, payload binary"


class Pieces:
    """Ids of pieces of up to 16 bytes: an open table of records, each the bytes of a piece as two numbers, the place and number of its ids in a pool, and whether it came again.

    When it is full, the pieces that came again stay; with too many of these it starts anew.
    """

    BITS = 20
    MOST = 1 << 19

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.records, self.pool, self.size, self.count = np.zeros(0, np.uint64), np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """place << 32 | number of ids of each piece, 0 if it is new."""
        if not len(self.records):
            return np.zeros(len(one), np.uint64)
        at, r = pair_slots(one, two, self.BITS) << 2, self.records
        ref = r.take(at + 2)
        other = (r.take(at) != one) | (r.take(at + 1) != two)
        r[at[~other] + 3] = 1
        todo = np.flatnonzero(other & (ref > 0))
        ref[other] = 0
        here, one, two = at[todo], one[todo], two[todo]
        while len(todo):
            here = here + 4 & len(r) - 1
            there = r.take(here + 2)
            other = (r.take(here) != one) | (r.take(here + 1) != two)
            ref[todo[~other]] = there[~other]
            r[here[~other] + 3] = 1
            on = np.flatnonzero(other & (there > 0))
            todo, here, one, two = todo[on], here[on], one[on], two[on]
        return ref

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put in distinct new pieces with their ids, end to end; gives what ``find`` will."""
        if not len(self.records) or self.count + len(one) > self.MOST:
            self._renew()
        ref = self.keep(ids, sizes)
        self._insert(one, two, ref)
        return ref

    def keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids into the pool; their places and numbers."""
        if self.size + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.size], np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[self.size : self.size + len(ids)] = ids
        ref = (self.size + np.cumsum(sizes) - sizes).astype(np.uint64) << np.uint64(32) | sizes.astype(np.uint64)
        self.size += len(ids)
        return ref

    def _insert(self, one: np.ndarray, two: np.ndarray, ref: np.ndarray) -> None:
        at, r, self.count = pair_slots(one, two, self.BITS) << 2, self.records, self.count + len(one)
        while len(at):
            free = r.take(at + 2) == 0
            r[at[free] + 2] = ref[free]
            won = r.take(at + 2) == ref
            r[at[won]], r[at[won] + 1] = one[won], two[won]
            at, one, two, ref = at[~won] + 4 & len(r) - 1, one[~won], two[~won], ref[~won]

    def _renew(self) -> None:
        rows = self.records.reshape(-1, 4)
        rows = rows[(rows[:, 2] > 0) & (rows[:, 3] > 0)] if self.count else rows[:0]
        # the pool stays as it is: what this batch has found must last; a table that starts anew has a new pool
        self.records, self.count = np.zeros(4 << self.BITS, np.uint64), 0
        if len(rows) < self.MOST // 2:
            self._insert(*(np.ascontiguousarray(rows[:, k]) for k in range(3)))

    def ids(self, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each piece's."""
        sizes = (ref & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat((ref >> np.uint64(32)).astype(np.int64) - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.pool.take(at), sizes


class Encoder:
    """The tokenizers library over pieces or words, which a bounded table remembers.

    Where the file is built like the public one (``parted``), texts of characters under U+0100, which have no composed forms, are lower-cased and cut into its pieces by numpy, a batch at a
    time, and the library sees each new piece once.  All other texts, and those with U+0000 or ``<|``, are cut at white space, which always ends a piece, so a text's ids are those of its words.
    What a worker has learned outlasts its tasks, in bounded memory, until it reads files.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.known = Remembered(REMEMBERED)  # word -> ids, four bytes each
        self.pieces = Pieces()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        suffix = data["model"].get("end_of_word_suffix")
        self.parted = bool(suffix) and data.get("normalizer") == NORMALIZER and data.get("pre_tokenizer") == SPLITTER
        vocabulary = self.library.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.final[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def forget(self) -> None:
        self.known.forget()
        self.pieces.clear()

    def learn(self, words: list[str]) -> None:
        """Encode new words, many as one text, which is cheaper than a call each: MARK stands between them, and its ids are found again in the result."""
        plain = [w for w in words if MARK not in w and "<|" not in w]
        joint = f" {MARK} "
        chunks = [plain[at : at + 512] for at in range(0, len(plain), 512)]
        for some, e in zip(chunks, self.library.encode_batch_fast([joint.join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            n = len(self.mark)
            ends = np.flatnonzero(np.all([ids[j : len(ids) - n + 1 + j] == m for j, m in enumerate(self.mark)], axis=0)) if len(ids) >= n else np.zeros(0, np.int64)
            if len(ends) + 1 != len(some):
                raise ValueError("the mark is not a piece of its own in this tokenizer")
            starts = [0, *(ends + n).tolist()]
            for word, a, b in zip(some, starts, [*ends.tolist(), len(ids)], strict=True):
                self.known[word] = ids[a:b].tobytes()
        rest = [w for w in words if MARK in w or "<|" in w]
        for word, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[word] = np.array(e.ids, np.uint32).tobytes()

    def by_words(self, texts: list[str]) -> list[np.ndarray]:
        # str.split also splits at four control characters that are no white space to the tokenizer: such texts go whole
        split = [None if not t.isprintable() and any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        self.learn(list(self.known.missing(set().union(*[w for w in split if w]))))
        out = []
        for t, words in zip(texts, split, strict=True):
            if words is None:
                data = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32).tobytes()
            else:
                data = b"".join([self.known[w] for w in words])
            out.append(np.frombuffer(data, np.uint32))
        return out

    def learned(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end and the number of each one's: many are encoded as one text, and the last id of each ends a piece."""
        chunks = [pieces[at : at + 512] for at in range(0, len(pieces), 512)]
        ids, sizes = [], []
        for some, e in zip(chunks, self.library.encode_batch_fast([b" ".join(c).decode() for c in chunks], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            ends = np.flatnonzero(self.final[ids[-1]]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids[-1]):
                raise ValueError("a piece is not one to this tokenizer")
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        values = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.parted:
            return self.by_words(strings(values))
        if self.pieces.size > 1 << 23:
            self.pieces.clear()
        body, at = utf8(values)
        low, first, end, odd = cut(body, at)
        whole = np.flatnonzero(odd)
        if len(whole):
            keep = ~odd[np.searchsorted(at, first, "right") - 1]
            first, end = first[keep], end[keep]
        size, data = end - first, low.tobytes()
        one, two = pair_keys(low, first, size)
        ref = self.pieces.find(one, two)
        long = size > 16
        ref[long] = 0
        lost = np.flatnonzero(ref == 0)
        if len(lost):
            names = [data[a:b] for a, b in zip(first[lost].tolist(), end[lost].tolist(), strict=True)]
            new = dict(zip(names, lost.tolist(), strict=True))
            ids, sizes = self.learned(list(new))
            places = np.fromiter(new.values(), np.int64, len(new))
            short = ~long[places]
            refs = np.zeros(len(places), np.uint64)
            refs[short] = self.pieces.add(one[places[short]], two[places[short]], ids[np.repeat(short, sizes)], sizes[short])
            refs[~short] = self.pieces.keep(ids[np.repeat(~short, sizes)], sizes[~short])
            found = dict(zip(new, refs.tolist(), strict=True))
            ref[lost] = np.fromiter(map(found.__getitem__, names), np.uint64, len(names))
        ids, sizes = self.pieces.ids(ref)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(first, at)].tolist()
        out = [ids[a:b] for a, b in itertools.pairwise(upto)]
        if len(whole):
            for i, x in zip(whole.tolist(), self.by_words(strings(values.take(pa.array(whole)))), strict=True):
                out[i] = x
        return out


_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[65:91], _KIND[97:123], _KIND[48:58] = _SPACE, _LETTER, _LETTER, _DIGIT
#: Kinds of the characters from U+0080 on, by their second byte after C2 and C3.
_KIND_2 = {0xC2: np.full(256, _SIGN, np.uint8), 0xC3: np.full(256, _LETTER, np.uint8)}
_KIND_2[0xC2][[0x85, 0xA0]], _KIND_2[0xC2][[0xAA, 0xB5, 0xBA]], _KIND_2[0xC2][[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]], _KIND_2[0xC3][[0x97, 0xB7]] = _SPACE, _LETTER, _DIGIT, _SIGN


def cut(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid one after the other in lower case, with 16 bytes more; where each piece starts and ends; and which texts have U+0000, characters from U+0100 on or ``<|``, whose pieces are not to be used."""
    low = np.zeros(len(body) + 16, np.uint8)
    low[: len(body)] = _LOW.take(body)
    kind, size = _KIND.take(body), np.diff(at)
    odd = np.zeros(len(size), bool)
    wide = np.flatnonzero(body >= 0x80)
    inside = np.zeros(0, np.int64)
    if len(wide):
        odd[np.searchsorted(at, wide[body[wide] >= 0xC4], "right") - 1] = True
        inside = wide[body[wide] < 0xC0]
        for lead, kinds in _KIND_2.items():
            here = wide[body[wide] == lead]
            second = body[here + 1]
            kind[here] = kind[here + 1] = kinds[second]
            if lead == 0xC3:
                low[here[(second <= 0x9E) & (second != 0x97)] + 1] += 0x20
    if not body.all():
        odd[np.searchsorted(at, np.flatnonzero(body == 0), "right") - 1] = True
    odd[np.searchsorted(at, np.flatnonzero((body[:-1] == ord("<")) & (body[1:] == ord("|"))), "right") - 1] = True
    begins = np.ones(len(body), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins[inside] = False
    begins[at[:-1][size > 0]] = True
    # an apostrophe at which a piece begins, and a contraction's letters after it in the same text
    quotes = np.flatnonzero((body == ord("'")) & begins)
    if len(quotes):
        ends = at[np.searchsorted(at, quotes, "right")]
        a, b = low[quotes + 1], low[quotes + 2]
        n = np.where(np.isin(a, list(b"stmd")), 1, 0)
        n[(np.isin(a, list(b"rv")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))] = 2
        n[quotes + 1 + n > ends] = 0
        quotes, n, ends = quotes[n > 0], n[n > 0], ends[n > 0]
        begins[quotes + 1] = False
        begins[(quotes + 1 + n)[quotes + 1 + n < ends]] = True
    full = kind != _SPACE
    first = np.flatnonzero(begins & full)
    edge = np.ones(len(body), bool)
    edge[:-1] = begins[1:] | ~full[1:]
    return low, first, np.flatnonzero(edge & full) + 1, odd


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def coded(docs: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None, end: int = END) -> DataFrame:
    """The rows of the files."""
    parts = partitions_for(docs.sparkSession)
    block, lanes = range_coder.BLOCK, range_coder.LANES

    def rows_of(bucket: int, first: int, before: int, docs: list[tuple[int, int, int]], ids: np.ndarray) -> pa.RecordBatch:
        """Blocks of a stretch of a bucket; docs: (doc_id, ordinal, ids) in order, together as long as the stretch."""
        cuts = list(range(0, len(ids), block))
        blocks = [ids[a : a + block] for a in cuts]
        holds: list[tuple[list, list, list]] = [([], [], []) for _ in cuts]
        at = 0
        for doc, ordinal, n in docs:
            while n:
                k = at // block
                take = min(n, (k + 1) * block - at)
                for column, v in zip(holds[k], (doc, ordinal, take), strict=True):
                    column.append(v)
                at, n = at + take, n - take
        columns = [[bucket] * len(cuts), [first + i for i in range(len(cuts))], [before + a for a in cuts], [len(b) for b in blocks], *map(list, zip(*holds, strict=True)), range_coder.encode(blocks)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "block", "before", "ids", "doc", "ordinal", "doc_ids", "payload"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or tokenizer_file(name))
        now, first, before, count = None, 0, 0, 0
        docs: list[tuple[int, int, int]] = []
        held: list[np.ndarray] = []
        size = 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            """All that is held, or with whole false the full blocks of it."""
            nonlocal docs, held, size, first, before
            take = size if whole else size // block * block
            if not take:
                return
            ids = np.concatenate(held)
            inside, rest, at = [], [], 0
            for doc, ordinal, n in docs:
                here = min(n, max(0, take - at))
                if here:
                    inside.append((doc, ordinal, here))
                if n > here:
                    rest.append((doc, ordinal, n - here))
                at += n
            yield rows_of(now, first, before, inside, ids[:take])
            docs, held, size = rest, [ids[take:]], size - take
            first, before = first + -(-take // block), before + take

        for batch in batches(it):
            buckets, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            with uncollected():
                found = encoder.ids(batch.column(2))
            for bucket, doc, ids in zip(buckets, doc_ids, found, strict=True):
                if bucket != now:
                    yield from flush(True)
                    now, first, before, count, docs, held, size = bucket, 0, 0, 0, [], [], 0
                held += [ids, np.array([end], np.uint32)]
                docs.append((doc, count, len(ids) + 1))
                size, count = size + len(ids) + 1, count + 1
                if size >= lanes * block:
                    yield from flush(False)
        yield from flush(True)

    placed = docs.select(bucket_of(id_bounds(docs, parts)).alias("bucket"), F.col("doc_id").cast("long"), "text")
    # buckets are dealt in order, so that the files hold the documents in ascending order one after the other
    dealt = placed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.mapInArrow(run, SCHEMA)


def pieces(files: DataFrame) -> DataFrame:
    """A row for each document in each block of the files, decoded: bucket, ordinal, doc_id, start in the bucket, n ids, their crc32."""

    def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Blocks by LANES, as far as there are so many: Arrow batches hold fewer, and a step costs nearly the same for few."""
        held, rows = [], 0
        for whole in it:
            for at in range(0, whole.num_rows, range_coder.LANES):
                batch = whole.slice(at, range_coder.LANES)
                if rows + batch.num_rows > range_coder.LANES:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for encoder in _LOADED.values():
            encoder.forget()  # the files are written, and other stages need the memory
        for batch in gathered(it):
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for bucket, start, docs, ordinals, sizes, ids in zip(*columns[:5], range_coder.decode(columns[5]), strict=True):
                data, done = memoryview(ids.tobytes()), 0
                for doc, ordinal, n in zip(docs, ordinals, sizes, strict=True):
                    out.append((bucket, ordinal, doc, start + done, n, zlib.crc32(data[4 * done : 4 * (done + n)])))
                    done += n
            if out:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "ordinal", "doc_id", "start", "n", "crc"])

    return files.select("bucket", "before", "doc", "ordinal", "doc_ids", "payload").mapInArrow(run, "bucket int, ordinal long, doc_id long, start long, n long, crc long")


def documents_of(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    found = pieces(files)
    parts = found.groupBy("bucket", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            crcs = []
            for parts_of in batch.column(4).to_pylist():
                crc = parts_of[0]["crc"]
                for p in parts_of[1:]:
                    crc = range_coder.crc_joined(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], ["bucket", "doc_id", "start", "n_tokens", "ids_crc32"])

    whole = parts.select("bucket", "doc_id", "start", "n_tokens", "parts").mapInArrow(run, "bucket int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # a row for each bucket: as many as there are partitions
    sizes = files.groupBy("bucket").agg(F.sum("ids").alias("size"))
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return whole.join(F.broadcast(offsets), "bucket").select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the files, read them back, and describe the documents in them."""
    return documents_of(written(coded(docs, **options), "token-files"))
