"""Evaluation: confusion counts, rates with intervals, precision-recall by score, percentiles, temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null on a zero denominator."""
    return F.when(b != 0, a / b)


def f1(precision: Column, recall: Column) -> Column:
    """Null if either is, 0 if both are 0."""
    return F.when(precision.isNull() | recall.isNull(), None).when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def confusion(rows: DataFrame, *keys: str, truth: str = "truth", flagged: str = "flagged", error: str | None = None) -> DataFrame:
    """tp, fp, tn, fn by keys; rows with an error don't count."""
    if error:
        rows = rows.where(F.col(error).isNull())
    y, p = F.col(truth), F.col(flagged)
    return rows.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


def type_agreement(rows: DataFrame, *keys: str, truth: str = "truth", flagged: str = "flagged", kind: str = "scam_type", guess: str = "predicted_type") -> DataFrame:
    """tp, agreeing, agreement by keys: of the rows rightly flagged, how many have their type named rightly; null without any."""
    right = F.col(truth) & F.col(flagged)
    counted = rows.groupBy(*keys).agg(F.count_if(right).alias("tp"), F.count_if(right & (F.col(kind) == F.col(guess))).alias("agreeing"))
    return counted.withColumn("agreement", ratio(F.col("agreeing"), F.col("tp")))


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    with_rates = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn)})
    return with_rates.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % interval; null without rows."""
    p, z2 = hits / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    reach = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - reach)), F.when(n > 0, F.least(F.lit(1.0), centre + reach))


def per_class(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """class, support, precision, recall, f1: one shuffle, each row counted for its true and its predicted class."""
    both = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    sums = both.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("given"), F.sum("hit").alias("hits"))
    return sums.select("class", "support", ratio(F.col("hits"), F.col("given")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def pivoted(rows: DataFrame, classes: list, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(truth).pivot(predicted, classes).count().na.fill(0)


def pr_points(rows: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """score, cumulative tp and n, precision, recall at each distinct score.

    Scores are grouped first, so the ordered window sees a row for each distinct score, not for each prediction.
    """
    y = F.col(truth).cast("long")
    blocks = rows.groupBy(score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("all"))
    down, every = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    points = blocks.withColumns({"tp": F.sum("pos").over(down), "n": F.sum("all").over(down), "total_pos": F.sum("pos").over(every), "total": F.sum("all").over(every)})
    return points.select(F.col(score).alias("score"), "tp", "n", "total_pos", "total", (F.col("tp") / F.col("n")).alias("precision"), ratio(F.col("tp"), F.col("total_pos")).alias("recall"))


def average_precision(rows: DataFrame, **columns) -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision."""
    points = pr_points(rows, **columns)
    before = F.lag("recall", 1, 0.0).over(Window.orderBy(F.desc("score")))
    return points.withColumn("gain", (F.col("recall") - before) * F.col("precision")).agg(F.sum("gain").alias("average_precision"))


def fpr_at_recall(rows: DataFrame, least: float, **columns) -> DataFrame:
    """The highest threshold that reaches the recall, and the false-positive rate there."""
    points = pr_points(rows, **columns).where(F.col("recall") >= least)
    fpr = ratio(F.col("n") - F.col("tp"), F.col("total") - F.col("total_pos"))
    return points.agg(F.max(F.struct("score", fpr.alias("fpr"))).alias("x")).select(F.col("x.score").alias("threshold"), F.col("x.fpr").alias("fpr"))


def temperature(rows: DataFrame, logit: str = "logit", truth: str = "truth", points: int = 161, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """The grid's temperature of least mean negative log-likelihood.

    The grid is an array of sums in one aggregate, so rows are read once and never multiplied.
    """
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    sign = F.when(F.col(truth), F.lit(-1.0)).otherwise(F.lit(1.0))
    means = rows.agg(*[F.avg(F.log1p(F.exp(sign * F.col(logit) / t))).alias(f"t{i}") for i, t in enumerate(grid)])
    pairs = F.array(*[F.struct(F.col(f"t{i}").alias("nll"), F.lit(t).alias("temperature")) for i, t in enumerate(grid)])
    return means.select(F.array_min(pairs).alias("x")).select("x.temperature", "x.nll")


def reading(rows: DataFrame, truth: str, read: str, by: list[str] | None = None) -> DataFrame:
    """How well texts were read: edits over characters of all rows together, the mean of the rows' own rates, and the share read exactly.

    A row without a true text has no rate, but what was read into it counts as edits; a row that was not read at all is read as empty.
    """
    t, r = F.coalesce(F.col(truth), F.lit("")), F.coalesce(F.col(read), F.lit(""))
    each = rows.withColumns({"__edits": F.levenshtein(t, r).cast("long"), "__size": F.length(t).cast("long")})
    return each.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__edits"), F.lit(0)).alias("edits"), F.coalesce(F.sum("__size"), F.lit(0)).alias("characters"), F.try_divide(F.sum("__edits"), F.sum("__size")).alias("error_rate"),
        F.avg(F.try_divide("__edits", "__size")).alias("mean_rate"), F.avg((t == r).cast("int")).alias("exact"),
    )


def identifiers_read(rows: DataFrame, truth: str, read: str) -> DataFrame:
    """By kind of identifier, from arrays of struct(kind, value): rows that have the kind on either side, rows whose sets are equal, identifiers kept, lost and invented."""
    distinct = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)))
    t, r = distinct(truth), distinct(read)
    kinds = F.array_distinct(F.transform(F.concat(t, r), lambda k: k["kind"]))
    each = rows.select(t.alias("t"), r.alias("r"), F.explode(kinds).alias("kind"))
    own = lambda c: F.filter(c, lambda k: k["kind"] == F.col("kind"))
    kept, lost, more = F.size(F.array_intersect(own("t"), own("r"))), F.size(F.array_except(own("t"), own("r"))), F.size(F.array_except(own("r"), own("t")))
    counted = each.select("kind", kept.alias("kept"), lost.alias("lost"), more.alias("invented"))
    return counted.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("lost") == 0) & (F.col("invented") == 0)).cast("long")).alias("equal"), *[F.sum(c).alias(c) for c in ("kept", "lost", "invented")])
