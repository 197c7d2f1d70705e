"""Evaluation reports as DataFrames: mistakes, worst errors, disagreements, ablation, threshold sweep, runs side by side, retrieval accuracy.

Rows are predictions: an id, the truth, what a system said.  Everything is an aggregate or a sort; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics


def negative_rates(rows: DataFrame, keys: tuple[str, ...] = ("label", "label_source"), truth: str = "truth", flagged: str = "flagged", verdict: str = "verdict", error: str | None = None) -> DataFrame:
    """False-positive rate of the rows that are not positive, by who labelled them and as what; unlabelled rows don't count."""
    if error:
        rows = rows.where(F.col(error).isNull())
    negative = rows.where(~F.col(truth) & F.col(keys[0]).isNotNull())
    counts = negative.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("flagged"), F.count_if(F.col(verdict) == "scam").alias("verdict_scam"))
    return counts.withColumn("fpr", F.col("flagged") / F.col("n"))


def macro_f1(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Mean F1 over the classes that occur; a class without a defined F1 counts as 0."""
    each = metrics.per_class(rows, truth, predicted)
    return each.agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def mistakes(rows: DataFrame, score: str = "score", truth: str = "truth", flagged: str = "flagged") -> DataFrame:
    """False positives from the highest score down, then false negatives from the lowest up."""
    y, p = F.col(truth), F.col(flagged)
    kind = F.when(~y & p, "false_positive").when(y & ~p, "false_negative")
    wrong = rows.withColumn("mistake", kind).where(F.col("mistake").isNotNull())
    return wrong.orderBy(F.desc("mistake"), F.when(y, F.col(score)).otherwise(-F.col(score)))


def worst_errors(rows: DataFrame, k: int, confidence: str = "confidence", truth: str = "truth", predicted: str = "predicted", ties: str = "id") -> DataFrame:
    """The k wrong predictions of the greatest confidence: a report."""
    return rows.where(F.col(truth) != F.col(predicted)).orderBy(F.desc(confidence), ties).limit(k)


def disagreements(rows: DataFrame, rules: str = "rules_score", probability: str = "probability", high: int = 70, low: int = 20, p_low: float = 0.1, p_high: float = 0.9) -> DataFrame:
    """Rows on which rules and classifier contradict each other, with kind and strength."""
    r, p = F.col(rules), F.col(probability)
    alone = (r >= high) & (p < p_low)
    other = (r < low) & (p >= p_high)
    kind = F.when(alone, "rules_only").when(other, "classifier_only")
    strength = F.when(alone, r / 100 - p).otherwise(p - r / 100)
    return rows.where(alone | other).withColumns({"kind": kind, "strength": strength})


def same_items(first: DataFrame, second: DataFrame, key: str = "id", columns: tuple[str, ...] = ("flagged", "score")) -> DataFrame:
    """Two runs over the items that both hold: columns of each with suffix _a and _b."""
    side = lambda df, s: df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return side(first, "a").join(side(second, "b"), key)


def ablation(rows: DataFrame, systems: dict[str, tuple[str, str]], truth: str = "truth", recall: float = 0.9) -> DataFrame:
    """A row for each system of (score column, flagged column): precision, recall, f1, fpr, average precision, fpr at the recall.

    Counts of all systems come from one pass; the curve of each is over its distinct scores.
    """

    def one(name: str, score: str, flagged: str) -> DataFrame:
        counts = metrics.rates(metrics.confusion(rows, truth=truth, flagged=flagged))
        area = metrics.average_precision(rows, score=score, truth=truth)
        at = metrics.fpr_at_recall(rows, recall, score=score, truth=truth)
        return counts.crossJoin(area).crossJoin(at.withColumnRenamed("fpr", "fpr_at_recall")).withColumn("system", F.lit(name))  # one row on either side

    return reduce(DataFrame.unionByName, [one(n, *columns) for n, columns in systems.items()])


def sweep(rows: DataFrame, thresholds: list[int], scores: dict[str, str], truth: str = "truth") -> DataFrame:
    """(setting, threshold) with tp, fp, recall and fpr, for each score column in ``scores`` (such as with and without corroboration).

    All settings are counted in one aggregate, so rows are read once and never multiplied.
    """
    y = F.col(truth)
    cells = [(s, t, F.col(c) >= t) for s, c in scores.items() for t in thresholds]
    sums = [F.struct(F.lit(s).alias("setting"), F.lit(t).alias("threshold"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y).alias("positive"), F.count_if(~y).alias("negative")) for s, t, hit in cells]
    found = rows.agg(F.array(*sums).alias("x")).select(F.inline("x"))
    return found.withColumns({"recall": metrics.ratio(F.col("tp"), F.col("positive")), "fpr": metrics.ratio(F.col("fp"), F.col("negative"))})


def retrieval_accuracy(nearest: DataFrame, wanted: str, found: str) -> DataFrame:
    """Share of rows whose nearest pattern is of the wanted kind, by that kind; rows without a pattern are wrong."""
    hit = F.coalesce(F.col(wanted) == F.col(found), F.lit(False)).cast("double")
    return nearest.groupBy(F.col(wanted).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def top_signals(breakdown: Column, k: int = 3) -> Column:
    """The k counted signals of an array<struct<signal, score, weight>> with the greatest score times weight, ties in their order."""
    placed = F.transform(F.filter(breakdown, lambda s: s["weight"] > 0), lambda s, i: F.struct((-s["score"] * s["weight"]).alias("minus"), i.alias("place"), s["signal"].alias("signal")))
    return F.transform(F.slice(F.array_sort(placed), 1, k), lambda s: s["signal"])
