"""Canonical exact digests: documents that differ only in Unicode form, case or white space get one fingerprint.

The canonical text is NFKC, case-folded, with every run of white space as one blank and none at the ends, in UTF-8.  Its fingerprint is xxh3 with 128 bits.
Equal fingerprints are not taken on trust: ``collisions`` compares the canonical bytes inside equal buckets, by the least and greatest text of a bucket, which
is a grouping that copies leave already combined on the map side, and where they differ ``settled`` makes the fingerprints of that bucket longer.

``edited`` holds a document against its successor, ascending id: the last floor(n / 2) code points are replaced by the first as many of the next document.  Rows are dealt
in ranges of the id; each range also gets the first row of the one behind it, so every document meets its successor in one pass.

Edge cases: null and empty texts are the empty canonical text, and equal; the row after the last is the first, so in a table of one row it is its own successor;
rows that repeat an id are ordered by text; rows without an id come last; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bucket_of, by_ids, id_bounds, nfkc, partitions_for, strings, written


def canonical(text: str | None) -> bytes:
    """NFKC again after folding, as folding can undo it."""
    folded = nfkc(nfkc(text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


#: Hex digits of a fingerprint; fewer make collisions likely, which only tests want.
DIGITS = 32


def fingerprint(text: str | None, digits: int = DIGITS) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))[:digits]


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def likeness(a: str, b: str) -> float:
    """Of exact digests: 1 for equal ones, else 0."""
    return float(a == b)


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, doc_id, text, guest): rows in ranges of the id, each range followed by the first row of the next, the last by the first of all."""
    bounds = id_bounds(docs, parts)
    placed = docs.select(bucket_of(bounds).alias("bucket"), "doc_id", "text")
    firsts = {r["bucket"]: r["least"] for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("least")).collect()}  # a row for each range
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    chosen = F.array(*[F.struct(F.lit(b).alias("at"), F.lit(firsts[b]).cast("long").alias("least"), F.lit(before[b]).alias("to")) for b in order]) if order else None
    rows = placed.withColumn("guest", F.lit(0))
    if chosen is None:
        return rows
    # rows that share the least id of a range all go along; the reader takes the first in order
    hosts = placed.withColumn("host", F.get(F.transform(F.filter(chosen, lambda c: (c["at"] == F.col("bucket")) & (c["least"].eqNullSafe(F.col("doc_id").cast("long")))), lambda c: c["to"]), F.lit(0)))
    guests = hosts.where("host IS NOT NULL").select(F.col("host").alias("bucket"), "doc_id", "text").withColumn("guest", F.lit(1))
    return rows.unionByName(guests)


def compared(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint."""
    parts = partitions_for(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, id, text, fingerprint
        skip: int | None = None  # a range whose guest has been seen

        def row(now: tuple, text: str, own: str) -> tuple:
            other = edited(now[2], text)
            return now[1], len(now[2]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), now[3], fingerprint(other, digits), own

        for batch in batches(it):
            rows = []
            for bucket, i, text, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if guest and bucket == skip:
                    continue
                own = fingerprint(text, digits)
                if held is not None:
                    rows.append(row(held, text, own))
                held, skip = (None, bucket) if guest else ((bucket, i, text, own), None)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [batch.column(1).type, pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    dealt = in_order(docs, 2 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")


def collisions(docs: DataFrame, found: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Fingerprints whose documents differ in canonical bytes; only buckets of several documents are read again."""
    several = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    ids = written(found.join(several, "fingerprint", "left_semi").select("doc_id").where("doc_id IS NOT NULL").distinct(), "bucket-ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            texts = sorted({canonical(t) for t in batch.column(0).to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(t)[:digits] for t in texts], pa.string()), pa.array(texts, pa.binary())], ["fingerprint", "body"])

    bodies = by_ids(docs.select("doc_id", "text"), ids).select("text").mapInArrow(run, "fingerprint string, body binary")
    return bodies.groupBy("fingerprint").agg(F.min("body").alias("x"), F.max("body").alias("y")).where("x != y").select("fingerprint")


def settled(docs: DataFrame, found: DataFrame, digits: int = DIGITS) -> DataFrame:
    """found with the fingerprints of colliding buckets lengthened by a second digest, sha256, of the canonical bytes."""
    bad = written(collisions(docs, found, digits), "collisions")
    if bad.isEmpty():
        return found

    @F.pandas_udf("string")
    def second(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(canonical(t)).hexdigest())

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, digits))

    longer = docs.select("doc_id", first("text").alias("fingerprint"), second("text").alias("more")).join(bad, "fingerprint", "left_semi").dropDuplicates(["doc_id", "fingerprint"])
    joined = found.join(longer, ["doc_id", "fingerprint"], "left")
    return joined.withColumn("fingerprint", F.concat("fingerprint", F.coalesce(F.concat(F.lit("-"), "more"), F.lit("")))).select(*found.columns)


def fingerprints(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The full comparison with settled fingerprints and likenesses."""
    found = written(compared(docs, digits), "fingerprints")
    same = lambda c: F.when(F.col("__own") == F.col(c), F.lit(1.0)).otherwise(F.lit(0.0))
    out = settled(docs, found.withColumn("__own", F.col("fingerprint")), digits)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
