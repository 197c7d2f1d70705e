"""Hash splits, stratified picks, review queues, sample weights: all by hashes of ids, so any run and any partitioning agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of sha256 of 'salt:key'."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key).cast("binary"), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def bucket(group: Column, heldout: float = 0.15, validation: float = 0.15, salt: str = "split") -> Column:
    u = unit_hash(group, salt)
    return F.when(u < heldout, "heldout").when(u < heldout + validation, "val").otherwise("train")


def in_review_sample(key: Column, share: float = 0.1) -> Column:
    return unit_hash(key, "review") < share


def review_queue(rows: DataFrame, key: str = "text_id", label: str = "label") -> DataFrame:
    """All uncertain rows and a fixed tenth of the others, with the reason."""
    uncertain = F.col(label) == "uncertain"
    return rows.where(uncertain | in_review_sample(F.col(key))).withColumn("reason", F.when(uncertain, "uncertain").otherwise("sample"))


def stratified_pick(rows: DataFrame, strata: list[str], fraction: float, key: str = "text_id", least: int = 3, salt: str = "pick") -> DataFrame:
    """In each stratum of ``least`` rows or more the first max(1, round(n * fraction)) by hash."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key)).cast("binary"), 256)
    ranked = rows.withColumn("__order", order).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*strata))).withColumn("__place", F.row_number().over(Window.partitionBy(*strata).orderBy("__order", key)))
    return ranked.where((F.col("__n") >= least) & (F.col("__place") <= F.greatest(F.lit(1), F.bround(F.col("__n") * fraction)))).drop("__order", "__n", "__place")


def halves(rows: DataFrame, strata: list[str], key: str = "text_id") -> DataFrame:
    """Each stratum dealt alternately in hash order; odd members alternate over the strata."""
    order = F.sha2(F.concat(F.lit("half:"), F.col(key)).cast("binary"), 256)
    placed = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key)))
    first = placed.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    odd = first.withColumn("__shift", F.coalesce(F.sum(F.col("__n") % 2).over(Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    return placed.join(odd, strata).withColumn("half", F.when((F.col("__place") + F.col("__shift")) % 2 == 1, "train").otherwise("test")).drop("__place", "__n", "__shift")


def balanced(rows: DataFrame, label: str, each: int, key: str = "text_id") -> DataFrame:
    """``each`` rows of either class, first by hash."""
    order = F.sha2(F.concat(F.lit("balance:"), F.col(key)).cast("binary"), 256)
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(label).orderBy(order, key))).where(F.col("__place") <= each).drop("__place")


def sample_weights(rows: DataFrame, group: str = "group_id", label: str = "label", country: str = "is_indian", cap: float = 3.0, factor: float = 5.0) -> DataFrame:
    """min(1, cap / group size), times ``factor`` for rows of the country, then classes scaled to equal totals.

    Sizes and totals come from aggregates joined back, not from windows over a class, which may hold most rows.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    raw = rows.join(sizes, group).withColumn("__raw", F.least(F.lit(1.0), F.lit(cap) / F.col("__size")) * F.when(F.col(country), factor).otherwise(F.lit(1.0)))
    totals = raw.groupBy(label).agg(F.sum("__raw").alias("__total"))
    whole = totals.agg(F.sum("__total").alias("__all"), F.count(F.lit(1)).alias("__classes"))
    scale = totals.crossJoin(F.broadcast(whole))  # one row on the right
    return raw.join(F.broadcast(scale), label).withColumn("weight", F.col("__raw") * F.col("__all") / F.col("__classes") / F.col("__total")).drop("__size", "__raw", "__total", "__all", "__classes")


def splits(rows: DataFrame, frozen: DataFrame, key: str = "text_id", group: str = "group_id", source: str = "source") -> DataFrame:
    """Split of each row: frozen ids are the test; their groups and those of collected rows are held out; other groups go by hash; synthetic rows
    train only with a parent in train, or with none."""
    test = frozen.select(key).distinct().withColumn("__test", F.lit(True))
    marked = rows.join(test, key, "left").withColumn("__test", F.coalesce("__test", F.lit(False)))
    reserved = marked.where(F.col("__test") | (F.col(source) == "collected")).select(group).distinct().withColumn("__reserved", F.lit(True))
    placed = marked.join(reserved, group, "left")
    by_hash = bucket(F.col(group).cast("string"))
    placed = placed.withColumn("split", F.when(F.col("__test"), "test").when(F.col("__reserved"), "heldout").otherwise(by_hash)).drop("__test", "__reserved")
    real = placed.where(F.col(source) != "synthetic")
    if "parent_id" not in rows.columns:
        return placed
    parents = real.select(F.col(key).alias("parent_id"), F.col("split").alias("__parent"))
    made = placed.where(F.col(source) == "synthetic").join(parents, "parent_id", "left")
    kept = made.where(F.col("parent_id").isNull() | (F.col("__parent") == "train")).withColumn("split", F.lit("train")).drop("__parent")
    return real.unionByName(kept)


def test_eligible(label_source: Column, is_synthetic: Column) -> Column:
    """Only reviewed messages that nobody made up may enter the test split."""
    return F.coalesce(label_source.isin("manual", "assisted"), F.lit(False)) & ~F.coalesce(is_synthetic, F.lit(False))


def parents(rows: DataFrame, priority: str, key: str = "text_id", group: str = "group_id") -> DataFrame:
    """One row a template group: the least (priority, key).  By aggregation, so a large group is combined before it is moved."""
    rest = [c for c in rows.columns if c not in (priority, key, group)]
    own = rows.withColumn("__group", F.coalesce(F.col(group).cast("string"), F.col(key).cast("string")))
    best = own.groupBy("__group").agg(F.min(F.struct(priority, key, group, *rest)).alias("x"))
    return best.select(*[F.col(f"x.{c}").alias(c) for c in rows.columns])


def by_source(tables: list[DataFrame], key: str = "text_id") -> DataFrame:
    """The union of tables in order of priority, an id from the first table that has it; ``priority`` is the table's place."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [t.withColumn("priority", F.lit(i)) for i, t in enumerate(tables)])
    rest = [c for c in every.columns if c not in ("priority", key)]
    first = every.groupBy(key).agg(F.min(F.struct("priority", *rest)).alias("x"))
    return first.select(key, *[F.col(f"x.{c}").alias(c) for c in rest], "x.priority")


def interleaved(positives: DataFrame, negatives: DataFrame, place: str = "place") -> DataFrame:
    """Tasks in order: a negative after every second positive, then what is left of the negatives.

    Either table has (key, place), places counted from 0.  Positions follow from the places by arithmetic, without sorting the union.
    """
    n = positives.agg(F.count(F.lit(1)).alias("__n"))
    m = negatives.agg(F.count(F.lit(1)).alias("__m"))
    before = F.least(F.floor(F.col(place) / 2), F.col("__m"))  # no more negatives than there are
    pos = positives.crossJoin(F.broadcast(m)).withColumn("position", F.col(place) + before).withColumn("kind", F.lit("variation")).drop("__m")
    neg = negatives.crossJoin(F.broadcast(n))  # one row on the right
    inside = F.col(place) < F.floor(F.col("__n") / 2)
    neg = neg.withColumn("position", F.when(inside, 3 * F.col(place) + 2).otherwise(F.col("__n") + F.col(place))).withColumn("kind", F.lit("hard_negative")).drop("__n")
    return pos.unionByName(neg)


def certain(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows that a split may take: with a label, and a certain one."""
    return rows.where(F.col(label).isNotNull() & (F.col(label) != "uncertain"))


def held_out_subsets(rows: DataFrame, split: str = "split", country: str = "is_indian", dataset: str = "dataset") -> DataFrame:
    """rows held out, once for each subset that a report has of them: all, by country, by dataset."""
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col(country), "indian").otherwise("other"), F.concat(F.lit("dataset:"), F.col(dataset))))
    return rows.where(F.col(split) == "heldout").withColumn("subset", F.explode(names))
