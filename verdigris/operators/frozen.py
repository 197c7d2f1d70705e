"""A test split that is drawn once: a versioned manifest of its ids, splits around it, and notes of what was lost.

The manifest is a journal, one entry a version: when and how it was drawn, how many ids, their fingerprint; the ids are the entry's rows.  A run that finds a
version reads it; ids that are gone are noted, not replaced.  Only ``rebuild`` draws anew, as a further version; earlier ones stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.journal import Journal
from . import similarity, splits

#: Fixed: fewer reviewed rows than these make no test split; the share that is drawn; the likeness from which a made-up row leaks.
LEAST_ROWS, SHARE, LEAK = 30, 0.2, 0.7


def fingerprint(ids: DataFrame, key: str = "text_id", digits: int = 3) -> DataFrame:
    """First 16 hex digits of a digest of a set of ids, and their number, whatever their order: a digest for each beginning of the ids' own digests, and one of those, in order.

    A task holds the ids of one beginning, of which there are 16 ** ``digits``.
    """
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    own = ids.select(sha(F.col(key).cast("string")).alias("digest")).distinct()
    part = own.groupBy(F.substring("digest", 1, digits).alias("start")).agg(sha(F.array_join(F.sort_array(F.collect_list("digest")), "\n")).alias("digest"), F.count(F.lit(1)).alias("n"))
    every = part.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "digest"))), lambda x: x["digest"]), "\n").alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return every.select(F.substring(sha(F.col("all")), 1, 16).alias("fingerprint"), F.col("n").cast("long").alias("n"))


@dataclass
class Frozen:
    """The ids of the test split, the manifest's entry (None: there is no split yet), and notes of the kinds and numbers."""

    ids: DataFrame
    entry: dict | None
    notes: list[tuple[str, int]]


def freeze(rows: DataFrame, path: str, created: str, key: str = "text_id", strata: tuple[str, ...] = ("label", "scam_type"), share: float = SHARE, least: int = LEAST_ROWS, rebuild: bool = False) -> Frozen:
    """The frozen test ids among rows (key, strata, label_source, is_synthetic), drawn now if there are none; ``created`` names the draw and salts it."""
    journal = Journal(rows.sparkSession, path)
    eligible = rows.where(splits.test_eligible(F.col("label_source"), F.col("is_synthetic")))
    known = journal.entries()
    if known and not rebuild:
        entry = known[-1]
        ids = journal.rows([entry])
        here = ids.join(eligible.select(key).distinct(), key, "left_semi")
        left = here.count()
        return Frozen(here, entry, [("missing", entry["n"] - left)] * (left < entry["n"]) + [("frozen", left)])
    n = eligible.count()
    if n < least:
        return Frozen(rows.select(key).where(F.lit(False)), None, [("too_few", n)])
    drawn = splits.stratified_pick(eligible, list(strata), share, key, salt=f"test:{created}").select(key).distinct()
    # the name of the batch makes a second writer of the same draw a reader
    entry = journal.append(drawn, f"{created}/{len(known)}", lambda made: fingerprint(made, key).first().asDict(), created=created, share=share, least=least)
    return Frozen(journal.rows([entry]), entry, [("redrawn" if known else "created", entry["n"])])


def conflicts(rows: DataFrame, key: str = "text_id", label: str = "label") -> DataFrame:
    """Ids whose rows of the best authority disagree, with the labels in order: they are left out everywhere, and noted."""
    ranked = rows.withColumn("__rank", similarity.authority())
    best = ranked.groupBy(key).agg(F.min("__rank").alias("__best"))
    labels = ranked.join(best, key).where("__rank = __best").groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return labels.where(F.size("labels") > 1)


def placed(real: DataFrame, made_up: DataFrame, frozen: DataFrame, tokens: Column, key: str = "text_id", group: str = "group_id", leak: float = LEAK) -> DataFrame:
    """real and made_up rows with split and group_id; made-up rows that go have the split null and the reason in ``dropped``.

    Frozen ids are the test; the rest of their groups, and groups of collected rows, are held out; other groups go by hash.  Made-up rows only join train: their parent, if they have
    one, must be there, and they must not be close to a row outside of train.  A variation belongs to its parent's group, any other made-up row to its own.
    """
    own = real.withColumn(group, F.coalesce(F.col(group).cast("string"), F.col(key).cast("string")))
    test = frozen.select(key).distinct().withColumn("__test", F.lit(True))
    marked = own.join(test, key, "left")
    reserved = marked.where(F.col("__test") | (F.col("dataset") == "collected")).select(group).distinct().withColumn("__reserved", F.lit(True))
    split = F.when(F.col("__test"), "test").when(F.col("__reserved"), "heldout").otherwise(splits.bucket(F.col(group)))
    whole = marked.join(reserved, group, "left").withColumn("split", split).drop("__test", "__reserved").withColumn("dropped", F.lit(None).cast("string"))
    parents = whole.where("split = 'train'").select(F.col(key).alias("parent_id"), F.col(group).alias("__group"))
    offered = made_up.drop(group).join(parents, "parent_id", "left")
    orphan = F.col("parent_id").isNotNull() & F.col("__group").isNull()
    sets = lambda df: df.select(F.col(key).alias("id"), tokens.alias("tokens"))
    leaking = similarity.close_to_any(sets(offered.where(~orphan)), sets(whole.where("split <> 'train'")), leak).select(F.col("id").alias(key), F.lit(True).alias("__leak"))
    why = F.when(orphan, "parent").when(F.col("__leak"), "leak")
    kept = offered.join(leaking, key, "left").withColumn("dropped", why).withColumn("split", F.when(F.col("dropped").isNull(), "train")).withColumn(group, F.coalesce("__group", F.col(key).cast("string"))).drop("__group", "__leak")
    return whole.unionByName(kept, allowMissingColumns=True)


def notes(rows: DataFrame, frozen: Frozen, group: str = "group_id") -> DataFrame:
    """(note, n): what freezing said, then counts of splits, groups, labellers of the test, and of made-up rows that went, in one aggregate."""
    spark = rows.sparkSession
    said = spark.createDataFrame(frozen.notes, "note string, n long") if frozen.notes else spark.createDataFrame([], "note string, n long")
    per = rows.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(F.lit("split:"), F.col("split")),
                    F.concat(F.lit("dropped:"), F.col("dropped")),
                    F.when(F.col("split") == "test", F.concat(F.lit("test labels:"), F.col("label_source"))),
                    F.when((F.col("split") == "heldout") & (F.col("dataset") == "collected"), "collected held out"),
                    F.when((F.col("split") == "heldout") & (F.col("dataset") != "collected"), "held out or near the test"),
                )
            )
        ).alias("note")
    )
    groups = rows.where("dropped IS NULL").agg(F.lit("groups").alias("note"), F.count_distinct(group).alias("n"))
    return said.unionByName(per.groupBy("note").agg(F.count(F.lit(1)).alias("n"))).unionByName(groups)
