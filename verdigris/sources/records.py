"""CSV records with their file and number, over quoted line breaks, and the dataset loaders that report problems by them.

Lines are read in parallel.  Whether a line begins a record depends on the quotes before it in its file: their number is summed for each block of the file first, then inside it, so a
file of any size is no single task, and a record is put together from its own lines alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import text as X
from . import tables as T

#: A field behind a comma: quoted, with doubled quotes inside, or plain.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, place, line): lines in order of (block, place) within each file; bad bytes replaced, a byte-order mark dropped."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.make_valid_utf8("value").alias("line"))
    return raw.withColumn("line", F.regexp_replace("line", "^﻿", ""))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, header, fields): records of CSV files with a header, numbered from 2 as lines of a table are; blank lines between records don't count."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    each = lines(spark, path).withColumn("quotes", quotes.cast("long"))
    inside = Window.partitionBy("file", "block").orderBy("place")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    zero = F.lit(0).cast("long")
    opened = each.groupBy("file", "block").agg(F.sum("quotes").alias("n")).withColumn("opened", F.coalesce(F.sum("n").over(blocks), zero)).drop("n")
    marked = each.join(opened, ["file", "block"]).withColumn("begins", (F.pmod(F.col("opened") + F.coalesce(F.sum("quotes").over(before), zero), F.lit(2)) == 0))
    blank = F.col("begins") & (F.col("line") == "") & (F.col("quotes") == 0)
    marked = marked.withColumn("new", F.when(F.col("begins") & ~blank, 1).otherwise(0)).where(~blank)
    counted = marked.groupBy("file", "block").agg(F.sum("new").alias("n")).withColumn("passed", F.coalesce(F.sum("n").over(blocks), zero)).drop("n")
    numbered = marked.join(counted, ["file", "block"]).withColumn("record", F.col("passed") + F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "line"))), lambda x: x["line"]), "\n").alias("text"))
    raw = F.regexp_extract_all(F.concat(F.lit(","), "text"), F.lit(_FIELD), F.lit(1))
    plain = F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.regexp_replace(f, r'(?s)^"(.*)"[^"]*$', "$1"), F.lit('""'), F.lit('"'))).otherwise(f))
    split = joined.select("file", "record", plain.alias("fields"))
    header = split.where("record = 1").select("file", F.transform("fields", lambda f: F.lower(F.trim(f))).alias("header"))  # a row a file
    return split.where("record > 1").join(header, "file").select("file", "record", "header", "fields")


def field(name: str, header: str = "header", fields: str = "fields") -> Column:
    """The field under a name; null where the header or the record lacks it."""
    at = F.array_position(header, name).cast("int")
    return F.when(at > 0, F.get(F.col(fields), at - 1))


def collected(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows in the unified schema, problems(file, record, problem)): messages collected by hand, anonymised, their id from the original text.

    A file without a needed column is one problem and gives no rows.
    """
    found = records(spark, path)
    missing = F.array_except(F.array(F.lit("text"), F.lit("label")), F.col("header"))
    low = lambda name: F.lower(F.trim(F.coalesce(field(name), F.lit(""))))
    read = found.select("file", "record", missing.alias("missing"), F.coalesce(field("text"), F.lit("")).alias("text"), low("label").alias("label"), low("scam_type").alias("scam_type"), F.coalesce(F.nullif(F.trim(field("source")), F.lit("")), F.lit("collected")).alias("source"))
    judged = read.where(F.size("missing") == 0).withColumn("problem", T.label_problem(F.col("label"), F.col("scam_type"), F.col("text")))
    headless = read.where(F.size("missing") > 0).groupBy("file", "missing").agg(F.lit(None).cast("long").alias("record"))
    problems = judged.where("problem IS NOT NULL").select("file", "record", "problem").unionByName(headless.select("file", "record", F.concat(F.lit("missing columns "), F.array_join("missing", ", "), F.lit("; the file is skipped")).alias("problem")))
    good = judged.where("problem IS NULL").withColumn("text_id", X.text_id(X.normalize_for_hash(F.col("text")))).withColumn("text", E.anonymized(X.one_spaced(X.nfc(F.col("text"))))).withColumn("scam_type", F.nullif("scam_type", F.lit("")))
    return T.unified(good, dataset="collected", label_source="manual", is_indian="true"), problems


def synthetic(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Made-up rows of several files in the unified schema; rows without text or with an unknown label go, an id that several files have comes from the first of them."""
    found = None
    for place, path in enumerate(paths):
        rows = records(spark, path).select("record", *[field(c).alias(c) for c in ("text", "label", "scam_type", "source", "parent_id", "language")]).withColumn("place", F.lit(place))
        found = rows if found is None else found.unionByName(rows)
    kept = found.where(F.coalesce(F.trim("text"), F.lit("")) != "").where(F.col("label").isin(T.LABELS)).withColumns({"source": F.coalesce(F.nullif("source", F.lit("")), F.lit("synthetic")), **{c: F.nullif(F.col(c), F.lit("")) for c in ("scam_type", "parent_id", "language")}})
    made = T.unified(kept.select("text", "label", "scam_type", "source", "parent_id", "language", "place", "record"), dataset="synthetic", label_source="synthetic", is_indian="true")
    # the order of files and records decides between copies: unified keeps neither, so the least (place, record) of each id is looked up beside it
    ids = kept.select(X.text_id(X.normalize_for_hash(F.col("text"))).alias("text_id"), "place", "record", *[F.col(c) for c in ("label", "scam_type", "source", "parent_id", "language", "text")])
    first = ids.groupBy("text_id").agg(F.min_by(F.struct("text", "label", "scam_type", "source", "parent_id", "language"), F.struct("place", "record")).alias("x"))
    return T.unified(first.select("text_id", "x.*"), dataset="synthetic", label_source="synthetic", is_indian="true").select(*made.columns)


def india(spark: SparkSession, path: str, reviews: DataFrame | None = None) -> DataFrame:
    """Messages with columns msg and label (spam or ham), repaired, anonymised; ham is genuine, spam is labelled by the rules, and a review overrides either.

    ``auto_label`` and ``auto_scam_type`` stay beside the unified columns, for the review queue.
    """
    from ..operators import scoring

    raw = T.read_any_encoding(spark, path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    rows = raw.select(F.coalesce("msg", F.lit("")).alias("original"), F.lower(F.trim("label")).alias("said")).where((F.trim("original") != "") & F.col("said").isin("spam", "ham"))
    fixed = rows.select(X.text_id(X.normalize_for_hash(F.col("original"))).alias("text_id"), "said", E.anonymized(X.one_spaced(X.nfc(X.fix_mojibake(F.col("original"))))).alias("text"))
    scored = scoring.analyzed(fixed).withColumnRenamed("scam_type", "found_type")
    auto = T.auto_label(scored).select("text_id", "said", "text", F.col("label").alias("auto_label"), F.when(F.col("label") == "scam", F.col("found_type")).alias("auto_scam_type"))
    ham = F.col("said") == "ham"
    labelled = auto.select("text_id", "text", F.when(ham, "genuine").otherwise(F.col("auto_label")).alias("label"), F.when(~ham, F.col("auto_scam_type")).alias("scam_type"), F.when(ham, "dataset").otherwise("auto").alias("label_source"), F.when(~ham, F.col("auto_label")).alias("auto_label"), F.when(~ham, F.col("auto_scam_type")).alias("auto_scam_type"))
    if reviews is not None:
        labelled = T.with_reviews(labelled, reviews)
    own = T.unified(labelled, dataset="india", source="india", is_indian="true")
    return own.join(labelled.select("text_id", "auto_label", "auto_scam_type").dropDuplicates(["text_id"]), "text_id", "left")
