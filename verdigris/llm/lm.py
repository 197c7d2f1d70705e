"""Language-model scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation, beside a unigram base.

Tokens are words and an end for each document.  Their counts in the training documents are gathered for the whole corpus.  The classes of the neural model are the
most frequent words, one each, groups of all other words by the hash of their last letters, seen in training or not, and the end.  There are ``size_for`` of them:
more as the vocabulary grows, from 2 to 4 times ``CLASSES``, half of them groups; the upper bound is that of three size x size tables in each worker.
The model predicts a class from the two before it: the score of class w is (r1[a] + r2[b]) . q[w] + bias[w], a and b being the classes before.

Documents, as classes, are dealt by the hash of their id and text to parts, as many as the number of tokens asks, and laid end to end in units of ``UNIT`` tokens, so neither
files nor partitions matter.  In each of ``ROUNDS`` rounds every unit trains a copy on all its class triples from one common start by noise-contrastive estimation; the copies, averaged by their tokens in groups of bounded size, are the start of the next.
Batched matrix products over all pairs of contexts then give the logarithms of the normalisers, so token log-probabilities are normalised.
Words of a group share its probability by (c + 0.1) / mass, the mass of each with a place for the unseen.

Counts of the ``HEAD`` most frequent words go to the executors (a bounded table); the other words of the documents are counted, joined to the counts by word and
summed by document.  No limit on words or documents.

Edge cases: null and empty texts are the end alone; without training documents N and V are 0, nothing is known, every base term is log10(0.1 / 0.1) = 0, and classes
are equally likely; rows with equal text have equal scores, repeated ids included; rows without an id are training documents, as no remainder holds them out;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, pair_keys, pair_slots, partitions_for, utf8, word_runs, written

CLASSES = 384
#: Averaged rounds of training; tokens of a unit, units that a part of the documents holds or so, and steps of gradient that a unit takes at least.
ROUNDS = 2
UNIT = 250_000
#: Partitions of the units' shuffle at most.
MOST_PARTITIONS = 8192
UNITS = 8
STEPS = 50
BATCH = 4096
#: Letters at the end of a word, before punctuation, that name its group.
ENDING = 3
HEAD = 100_000
WIDTH = 16
NOISE = 64
SEED = 17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOW = np.frombuffer(_LOWER, np.uint8)
#: Punctuation that closes a word.
CLOSING = b".,;:!?)\"'|"
_CLOSING = np.isin(np.arange(256), list(CLOSING))


def words_of(text: str | None) -> list[bytes]:
    """Words in order, A-Z in lower case; bytes.split takes just the six ASCII characters of white space."""
    return (text or "").encode().translate(_LOWER).split()


@dataclass
class Model:
    """first, second: vectors of the class before last and of the last one; out, bias: of the class predicted."""

    first: np.ndarray
    second: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, width: int = WIDTH) -> "Model":
        rng = np.random.default_rng(SEED)
        small = lambda: rng.normal(0, 0.1, (len(share), width)).astype(np.float32)
        return cls(small(), small(), small(), np.log(share).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.first, self.second, self.out, self.bias]

    def normalisers(self, firsts: range | None = None) -> np.ndarray:
        """log of the sum over classes of exp(score), for every pair of contexts or those of some first ones: exp of a sum is a product, so one matrix product gives all sums."""
        first = (self.first if firsts is None else self.first[firsts.start : firsts.stop]).astype(np.float64) @ self.out.T
        second = self.second.astype(np.float64) @ self.out.T + self.bias
        top, other = first.max(1, keepdims=True), second.max(1, keepdims=True)
        z = np.log(np.exp(first - top) @ np.exp(second - other).T)
        return (z + top + other.T).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score parts by (first, class) and (second, class), the bias in the latter, and the normalisers."""
        return self.first @ self.out.T, self.second @ self.out.T + self.bias, self.normalisers()


def train(model: Model, triples: np.ndarray, times: np.ndarray, share: np.ndarray, epochs: int = 2, batch: int = BATCH, rate: float = 0.1) -> Model:
    """Noise-contrastive estimation over distinct class triples, each counting as often as it occurs; Adagrad.

    A batch shares NOISE draws from the class shares, so data and noise terms are two matrix products.
    """
    rng = np.random.default_rng(SEED)
    r1, r2, q, bias = (x.copy() for x in model.arrays())
    sums = [np.full_like(x, 1e-2) for x in (r1, r2, q, bias)]
    log_share = np.log(share * NOISE).astype(np.float32)
    weights = (times / times.mean()).astype(np.float32)
    columns = [np.ascontiguousarray(x, np.uint16) for x in triples.T]  # numbers of 16 bits are sorted by their digits
    cumulative = np.cumsum(share)

    def step(x: np.ndarray, total: np.ndarray, g: np.ndarray) -> None:
        total += g * g
        x -= rate * g / np.sqrt(total)

    def spread(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
        order = np.argsort(rows, kind="stable")
        ranked = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        out = np.zeros((len(share), g.shape[1]), np.float32)
        out[ranked[first]] = np.add.reduceat(g[order], first, axis=0)
        return out

    for _ in range(epochs):
        order = rng.permutation(len(triples))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            a, b, w = (x[rows] for x in columns)
            heavy = weights[rows] / len(rows)
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), len(share) - 1)
            h = r1[a] + r2[b]
            data = (h * q[w]).sum(1) + bias[w] - log_share[w]
            other = h @ q[noise].T
            other += bias[noise] - log_share[noise]
            g_data = -heavy / (1 + np.exp(np.clip(data, -30, 30)))
            np.negative(other, out=other)
            np.clip(other, -30, 30, out=other)
            np.exp(other, out=other)
            other += 1
            g_noise = np.divide(heavy[:, None], other, out=other)
            g_h = g_data[:, None] * q[w] + g_noise @ q[noise]
            g_q = spread(w, g_data[:, None] * h)
            np.add.at(g_q, noise, g_noise.T @ h)
            g_bias = np.bincount(w, g_data, len(share)).astype(np.float32)
            np.add.at(g_bias, noise, g_noise.sum(0))
            for x, total, g in zip((r1, r2, q, bias), sums, (spread(a, g_h), spread(b, g_h), g_q, g_bias), strict=True):
                step(x, total, g * len(rows) / 64)
    return Model(r1, r2, q, bias)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all documents given, counted in the partitions first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches(it, 512):
            for t in batch.column(0).to_pylist():
                counts.update(words_of(t))
            if len(counts) > 150_000:
                yield out()
                counts = Counter()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def size_for(vocabulary: int) -> int:
    """Number of classes: doubled from 2 * CLASSES while its square is below the number of words, up to 4 * CLASSES."""
    size = 2 * CLASSES
    while size < 4 * CLASSES and size * size < vocabulary:
        size *= 2
    return size


class Words:
    """The head of the vocabulary by place, and the class of any word: its own for the most frequent ones, else the group of its ending."""

    def __init__(self, head: list[tuple[bytes, int]], size: int) -> None:
        self.size, self.own, self.end = size, size // 2, size - 1
        self.place = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([c for _, c in head], np.int64)
        self.kind = np.array([i if i < self.own else self.group(w) for i, (w, _) in enumerate(head)], np.int64)

    def group(self, word: bytes) -> int:
        ending = (word.rstrip(CLOSING) or word)[-ENDING:]
        return self.own + xxhash.xxh32_intdigest(ending) % (self.end - self.own)

    @functools.cached_property
    def table(self) -> tuple[int, np.ndarray]:
        """An open table of the head's words of up to 16 bytes: the two numbers of a word's bytes, and its place + 1.  Made by each worker that asks."""
        short = [w for w in self.place if len(w) <= 16 and 0 not in w]
        size = np.fromiter(map(len, short), np.int64, len(short))
        one, two = pair_keys(np.frombuffer(b"".join(short) + bytes(16), np.uint8), np.cumsum(size) - size, size)
        place, bits = np.fromiter(map(self.place.get, short), np.uint64, len(short)) + np.uint64(1), max(4, len(short).bit_length() + 1)
        at, records = pair_slots(one, two, bits) << 2, np.zeros(4 << bits, np.uint64)
        while len(at):
            free = records.take(at + 2) == 0
            records[at[free] + 2] = place[free]
            won = records.take(at + 2) == place
            records[at[won]], records[at[won] + 1] = one[won], two[won]
            at, one, two, place = at[~won] + 4 & len(records) - 1, one[~won], two[~won], place[~won]
        return bits, records

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "groups")}

    @functools.cached_property
    def groups(self) -> dict[int, int]:
        """The group of each ending met so far, by its bytes and their number as one number: there are few in any language, and no more than 100,000 are kept."""
        return {}

    def places_of(self, low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in the head of each word of the body, -1 for none; the body has 16 bytes more than the words."""
        size = end - first
        one, two = pair_keys(low, first, size)
        bits, r = self.table
        at = pair_slots(one, two, bits) << 2
        out = r.take(at + 2).view(np.int64) - 1
        other = (r.take(at) != one) | (r.take(at + 1) != two)
        todo = np.flatnonzero(other & (out >= 0))
        out[other] = -1
        at, one, two = at[todo], one[todo], two[todo]
        while len(todo):
            at = at + 4 & len(r) - 1
            there = r.take(at + 2).view(np.int64) - 1
            other = (r.take(at) != one) | (r.take(at + 1) != two)
            out[todo[~other]] = there[~other]
            on = np.flatnonzero(other & (there >= 0))
            todo, at, one, two = todo[on], at[on], one[on], two[on]
        plain = size > 16
        if not low[: len(low) - 16].all():  # zeros are only told apart by the whole word
            zero = np.flatnonzero(low[: len(low) - 16] == 0)
            plain[np.searchsorted(first, zero, "right") - 1] = True
        for i in np.flatnonzero(plain).tolist():
            out[i] = self.place.get(low[first[i] : end[i]].tobytes(), -1)
        return out

    def groups_of(self, low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``group`` of each word of the body."""
        last, on = end.copy(), np.arange(len(end))
        while len(on):
            on = on[last[on] > first[on]]
            on = on[_CLOSING[low[last[on] - 1]]]
            last[on] -= 1
        last = np.where(last > first, last, end)
        size = np.minimum(last - first, ENDING)
        key = size.copy()
        for k in range(ENDING, 0, -1):
            key = key << 8 | np.where(k <= size, low[last - k], 0)
        keys, which = np.unique(key, return_inverse=True)
        found = self.groups
        if len(found) > 100_000:
            found.clear()
        for k, i in zip(keys.tolist(), np.unique(which, return_index=True)[1].tolist(), strict=True):
            if k not in found:
                found[k] = self.group(low[first[i] : end[i]].tobytes())
        return np.array([found[k] for k in keys.tolist()], np.int64)[which]

    def laid(self, values: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Texts end to end: (their bytes in lower case, where each word starts, where it ends), the place in the head of each token (-1 for none, and for ends), the class of each token, and where each text starts."""
        body, at = utf8(values)
        low = np.zeros(len(body) + 16, np.uint8)
        low[: len(body)] = _LOW.take(body)
        first, end, text = word_runs(body, at)
        known = self.places_of(low, first, end)
        kinds = self.kind[known] if len(self.kind) else known.copy()
        rare = np.flatnonzero(known < 0)
        kinds[rare] = self.groups_of(low, first[rare], end[rare])
        sizes = np.bincount(text, minlength=len(values)) + 1
        ends = np.cumsum(sizes) - 1
        inside = np.ones(len(known) + len(values), bool)
        inside[ends] = False
        places, classes = np.full(len(inside), -1, np.int64), np.full(len(inside), self.end, np.int64)
        places[inside], classes[inside] = known, kinds
        return (low, first, end), places, classes, ends + 1 - sizes

    def before(self, classes: np.ndarray, last: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The class before last and the last one, of each token of texts end to end; before a text there are ends alone.  last: the two tokens before the first."""
        flat = np.concatenate([last or (self.end, self.end), classes])
        first, second = flat[:-2].copy(), flat[1:-1]
        first[second == self.end] = self.end
        return first, second


def group_sums(counts: DataFrame, words) -> DataFrame:
    """(kind, c, n): occurrences and number of the words of each group; at most a row for each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        c, n = np.zeros(known.size, np.int64), np.zeros(known.size, np.int64)
        for batch in it:
            kinds = np.fromiter([-1 if 0 <= known.place.get(w, -1) < known.own else known.group(w) for w in batch.column(0).to_pylist()], np.int64, batch.num_rows)
            np.add.at(c, kinds[kinds >= 0], np.asarray(batch.column(1))[kinds >= 0])
            n += np.bincount(kinds[kinds >= 0], minlength=known.size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at]), pa.array(n[at])], ["kind", "c", "n"])

    return counts.select("word", "c").mapInArrow(run, "kind long, c long, n long").groupBy("kind").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def units_of(docs: DataFrame, words, tokens: int) -> DataFrame:
    """(part, codes, times): the class triples of units of UNIT tokens with their numbers; units depend on the corpus alone, which has so many tokens."""

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches(it, 512):
            _, _, classes, starts = known.laid(batch.column(1))
            body = classes.astype("<u2").tobytes()
            cuts = [*(2 * starts).tolist(), len(body)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([body[a:b] for a, b in itertools.pairwise(cuts)], pa.binary())], ["deal", "classes"])

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, held, size = words.value, None, bytearray(), 2 * UNIT
        last = (known.end, known.end)

        def out() -> pa.RecordBatch:
            nonlocal last
            classes = np.frombuffer(bytes(held[:size]), "<u2").astype(np.int64)
            first, second = known.before(classes, last)
            last = (int(second[-1]), int(classes[-1]))
            del held[:size]
            codes, times = np.unique((first * known.size + second) * known.size + classes, return_counts=True)
            row = [pa.array([part], pa.int32()), pa.array([codes.astype("<u4").tobytes()], pa.binary()), pa.array([times.astype("<u4").tobytes()], pa.binary())]  # a class has at most 4 * CLASSES values: three fit
            return pa.RecordBatch.from_arrays(row, ["part", "codes", "times"])

        for batch in it:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    if held:
                        yield out()
                    part, last = p, (known.end, known.end)
                held += c
                while len(held) >= size:
                    yield out()
        if held:
            yield out()

    parts = max(1, tokens // (UNITS * UNIT))
    deal = F.xxhash64("doc_id", "text")
    each = docs.select(deal.alias("deal"), "text").mapInArrow(coded, "deal long, classes binary")
    dealt = each.select(F.pmod("deal", F.lit(parts)).cast("int").alias("part"), "classes", F.xxhash64("deal").alias("order"))
    # a partition may hold several parts, one after the other: beyond a bound more parts are no more partitions
    sorted_ = dealt.repartition(min(partitions_for(docs.sparkSession, parts), MOST_PARTITIONS), "part").sortWithinPartitions("part", "order", "classes").select("part", "classes")
    return written(sorted_.mapInArrow(packed, "part int, codes binary, times binary"), "lm-units")


def fitted(docs: DataFrame, words, share: np.ndarray, tokens: int) -> Model:
    """The last round's average of the units' models; the driver receives at most 16 partial averages a round, 600 kB each."""
    context = docs.sparkSession.sparkContext
    units = units_of(docs, words, tokens)
    model, schema = Model.start(share), "part int, tokens long, sums binary"
    cut = np.cumsum([x.size for x in model.arrays()])[:-1]

    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a part's models, one by one from the stream."""
        totals: dict[int, list] = {}
        for batch in it:
            for part, tokens, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = totals.setdefault(part, [0, 0.0])
                total[0] += tokens
                total[1] = total[1] + np.frombuffer(sums, np.float64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t for t, _ in totals.values()], pa.int64()), pa.array([s.tobytes() for _, s in totals.values()], pa.binary())], ["part", "tokens", "sums"])

    for _ in range(ROUNDS):
        start = context.broadcast((model, share))

        def run(it: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            model, share = start.value
            size = len(share)
            sums: dict[int, list] = {}  # the task's units, added up in groups
            for batch in it:
                for part, codes, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    codes, times = np.frombuffer(codes, "<u4").astype(np.int64), np.frombuffer(times, "<u4")
                    tokens = int(times.sum())
                    one = train(model, np.stack([codes // size**2, codes // size % size, codes % size], axis=1), times, share, epochs=max(1, round(STEPS / math.ceil(len(codes) / BATCH))))
                    flat = np.concatenate([x.ravel() for x in one.arrays()]).astype(np.float64) * tokens
                    total = sums.setdefault(part % 16, [0, 0.0])
                    total[0] += tokens
                    total[1] = total[1] + flat
            for group, (tokens, flat) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "tokens", "sums"])

        rows = units.mapInArrow(run, schema).repartition(16, "part").mapInArrow(added, schema).collect()
        if not rows:
            return Model(*[np.zeros_like(x) for x in model.arrays()[:3]], model.bias)
        rows.sort(key=lambda r: r["part"])
        mean = sum(np.frombuffer(r["sums"], np.float64) for r in rows) / sum(r["tokens"] for r in rows)
        model = Model(*[x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(mean, cut), model.arrays(), strict=True)])
    return model


def normalised(spark, model: Model) -> np.ndarray:
    """The model's normalisers, computed on the executors by ranges of the first context."""
    shared, size = spark.sparkContext.broadcast(model), len(model.bias)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in batch.column(0).to_pylist():
                z = shared.value.normalisers(range(a, min(a + step, size)))
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([z.tobytes()], pa.binary())], ["a", "z"])

    step = max(1, size // 8)
    rows = sorted(spark.range(0, size, step, 8).mapInArrow(run, "a long, z binary").collect())
    return np.concatenate([np.frombuffer(r["z"], np.float32).reshape(-1, size) for r in rows])


def most_frequent(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """Words and counts, most frequent first, of all words that occur so often that at most ``most`` do: a threshold from a histogram of counts,
    a row for each sixteenth of an octave, so that no task sends more than its share of them."""
    step = F.floor(F.log2("c") * 16)
    left, least = most, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))


def scored(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where("!held_out")
    counts = written(word_counts(training), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = training.count()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    head = most_frequent(counts)
    words = Words(head, size_for(v))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(words)  # HEAD words at most
    own = [c for _, c in head[: words.own]]
    share, mass = np.full(words.size, 0.1), np.full(words.size, 0.1)
    share[: len(own)] += own
    for r in group_sums(counts, sent).collect():
        share[r["kind"]] += r["c"]
        mass[r["kind"]] += r["c"] + 0.1 * r["n"]
    share[words.end] += ends
    mass[: words.own] = mass[words.end] = 1
    model = fitted(training, sent, share / share.sum(), n)
    sent.unpersist()
    # HEAD words and three tables of size x size
    shared = context.broadcast((words, model.first @ model.out.T, model.second @ model.out.T + model.bias, normalised(docs.sparkSession, model), np.log10(mass)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, t1, t2, z, log_mass = shared.value
        logs = np.log10(words.count + 0.1)
        for batch in batches(it, 512):
            (low, first, end), at, c, starts = words.laid(batch.column(1))
            a, b = words.before(c)
            known, rare = at >= 0, np.flatnonzero(at < 0)
            log = np.zeros(len(c))
            log[known] = logs[at[known]]
            added = lambda x: np.add.reduceat(x, starts).tolist()
            neural = np.add.reduceat((t1[a, c] + t2[b, c] - z[a, b]).astype(np.float64), starts) / math.log(10)
            text = np.searchsorted(starts, rare, "right") - 1
            rare, text = rare[c[rare] != words.end], text[c[rare] != words.end]
            # a text's place among the words is less by the ends before it
            data, word = low.tobytes(), rare - text
            tail = [data[a:b] for a, b in zip(first[word].tolist(), end[word].tolist(), strict=True)]
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            tails = [Counter(tail[a:b]) for a, b in itertools.pairwise(cuts)]
            sizes = np.diff(np.append(starts, len(c))).tolist()
            body, cuts = utf8(batch.column(1))
            data, cuts = body.tobytes(), cuts.tolist()
            digests = [xxhash.xxh3_128_digest(data[a:b]) for a, b in itertools.pairwise(cuts)]
            flat = [pa.array(itertools.chain.from_iterable(tails), pa.binary()), pa.array(itertools.chain.from_iterable(x.values() for x in tails), pa.int32())]
            found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tails)]), pa.int32()), pa.StructArray.from_arrays(flat, ["word", "n"]))
            rows = (digests, sizes, added(known.astype(np.int64)), added(log), neural.tolist(), added(log_mass[c]), added(np.where(at >= words.own, log, 0.0)))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            columns = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, found], ["doc_id", "held_out", "tid", "n_tokens", "known", "logs", "neural", "spread", "other_logs", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, tid binary, n_tokens long, known long, logs double, neural double, spread double, other_logs double, tail array<struct<word:binary,n:int>>"), "lm-rows")
    each = found.select("tid", F.explode("tail").alias("t")).select("tid", "t.word", "t.n")
    c = F.coalesce("c", F.lit(0))
    sums = each.join(counts, "word", "left").groupBy("tid").agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("tail_logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    # equal texts have put in equal rows each: their sums are shared out again
    copies = found.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"))
    sums = copies.join(sums, "tid", "left").select("tid", (F.coalesce("tail_logs", F.lit(0.0)) / F.col("copies")).alias("tail_logs"), F.round(F.coalesce("tail_known", F.lit(0)) / F.col("copies")).cast("long").alias("tail_known"))
    return found.drop("tail").join(sums, "tid").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("tail_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("tail_logs") + F.lit(math.log10(ends + 0.1)) - F.col("n_tokens") * F.lit(math.log10(n + 0.1 * (v + 1)))).alias("base_score"),
        (F.col("neural") + F.col("other_logs") + F.col("tail_logs") - F.col("spread")).alias("score"),
    )


#: The base's columns have SQL, the neural score has none; tests compare the query with a brute-force version.
