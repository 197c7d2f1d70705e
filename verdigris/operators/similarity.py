"""Near duplicates of short texts: candidates by rare tokens, Jaccard, groups, authority dedupe, leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..functions.udf import bounded
from ..sources.journal import written
from . import blocks

RARE = 3
#: Fixed: order of authority of label sources.
AUTHORITY = {"manual": 0, "assisted": 1, "dataset": 2, "auto": 3}


def rare_tokens(docs: DataFrame, id_column: str = "id", keep: int = RARE, most: int = 1 << 17) -> DataFrame:
    """(id, token): the ``keep`` rarest tokens of each row of (id, tokens), ties by the token.

    Tokens above a bound on their number of rows, at most ``most``, are broadcast; rows with ``keep`` others don't move them.
    """
    each = docs.select(id_column, F.explode("tokens").alias("token"))
    counts = written(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token-counts")
    common = written(blocks.frequent(counts, most), "token-common")
    rest = each.join(F.broadcast(common.select("token")), "token", "left_anti")
    enough = written(rest.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= keep).select(id_column), "token-enough")
    short = docs.join(enough, id_column, "left_anti").select(id_column, F.explode("tokens").alias("token")).join(F.broadcast(common), "token")
    least = lambda df: df.groupBy(id_column).agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "token"))), 1, keep).alias("rare"))
    # a row's rarest are in one of the two lists, or, where the rest are too few, in both
    every = rest.join(counts.join(F.broadcast(common.select("token")), "token", "left_anti"), "token").select(id_column, "df", "token").unionByName(short.select(id_column, "df", "token"))
    return least(every).select(id_column, F.explode("rare.token").alias("token"))


def near_pairs(docs: DataFrame, least: float, id_column: str = "id") -> DataFrame:
    """(a, b, similarity), a < b: pairs of (id, tokens) that share a token rare to both, with a Jaccard of ``least`` or more.

    Candidates must fit in size, then in sketches of a fixed length; only those that do are joined with their tokens.  ``docs`` is read several times: give a written table.
    """
    bounded(docs.sparkSession)
    rare = rare_tokens(docs, id_column).join(docs.select(id_column, F.size("tokens").alias("n")), id_column)
    a, b = (rare.select(F.col(id_column).alias(c), F.col("n").alias(f"n{c}"), "token") for c in ("a", "b"))
    fit = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    pairs = a.join(b, "token").where(F.col("a") < F.col("b")).where(fit).select("a", "b", "na", "nb").distinct()
    sketches = written(blocks.sketched(docs.select(F.col(id_column).alias("id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))), "sketches")
    of = lambda c: sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    apart = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(blocks.WORDS)), F.lit(0))
    # sets that are close enough differ in at most so many tokens, and sketches in no more bits than sets in tokens
    likely = pairs.join(of("a"), "a").join(of("b"), "b").where(apart <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-6)
    likely = written(likely.select("a", "b"), "near-likely")
    side = lambda c: docs.join(likely.select(F.col(c).alias(id_column)).distinct(), id_column, "left_semi").select(F.col(id_column).alias(c), F.col("tokens").alias(f"tokens_{c}"))
    scored = likely.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", jaccard(F.col("tokens_a"), F.col("tokens_b")))
    return scored.where(F.col("similarity") >= least).select("a", "b", "similarity")


def groups(edges: DataFrame, most: int = 50) -> DataFrame:
    """(id, component) for the ends of edges(a, b), by least-label propagation with pointer jumping.

    State is written to the shared folder at each step, so a lost executor costs no recomputation of earlier ones, and edges are made once.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")
    both = written(edges.select(ends).select("e.id", "e.other").distinct(), "edges")
    now = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "groups")
    for _ in range(most):
        offered = both.join(now.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("offered"))
        nearer = now.join(offered, "id").select("id", F.least("component", "offered").alias("component"))
        jumped = nearer.alias("n").join(nearer.select(F.col("id").alias("root"), F.col("component").alias("above")), F.col("n.component") == F.col("root"), "left")
        following = written(jumped.select("n.id", F.least("n.component", F.coalesce("above", "n.component")).alias("component")), "groups")
        changed = following.join(now.withColumnRenamed("component", "old"), "id").where("component != old").limit(1).count()
        now = following
        if not changed:
            break
    else:
        raise RuntimeError(f"groups still change after {most} rounds")
    return now


def with_groups(docs: DataFrame, edges: DataFrame, id_column: str = "id") -> DataFrame:
    """docs with ``group_id``, the least id of the group."""
    found = groups(edges).withColumnRenamed("id", id_column)
    return docs.join(found, id_column, "left").withColumn("group_id", F.coalesce("component", id_column)).drop("component")


def authority(source: str = "label_source"):
    """Place in the order of authority, 4 for unlisted ones."""
    out = F.lit(len(AUTHORITY))
    for name, rank in AUTHORITY.items():
        out = F.when(F.col(source) == name, F.lit(rank)).otherwise(out)
    return out


def one_per_id(rows: DataFrame, id_column: str = "text_id", label: str = "label", source: str = "label_source", order: str = "pos") -> DataFrame:
    """For each id the first copy of best authority, if the labels at that authority agree; else no copy at all."""
    ranked = rows.withColumn("__rank", authority(source))
    best = ranked.groupBy(id_column).agg(F.min("__rank").alias("__best"))
    top = ranked.join(best, id_column).where("__rank = __best")
    agreed = top.groupBy(id_column).agg(F.count_distinct(label).alias("__labels")).where("__labels = 1").select(id_column)
    first = F.row_number().over(Window.partitionBy(id_column).orderBy(order))
    return top.join(agreed, id_column, "left_semi").withColumn("__n", first).where("__n = 1").drop("__n", "__rank", "__best")


def greedy_dropped(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids dropped by the ordered rule over pairs (a, b): the later one goes unless it has the better authority; a pair with a dropped side is skipped,
    and, where rows have a label, one of different labels too.

    Order-dependent, so it runs inside each component of the pairs, which are independent of one another.
    """
    if "label" in rows.columns:
        of = lambda c: rows.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").where(F.col("label_a").eqNullSafe(F.col("label_b"))).select("a", "b")
    component = groups(pairs).withColumnRenamed("id", "a")
    rank = rows.select("id", authority().alias("rank"))
    full = pairs.join(component, "a").join(rank.toDF("a", "rank_a"), "a").join(rank.toDF("b", "rank_b"), "b")

    def run(pdf):  # noqa: ANN001, ANN202
        gone: set = set()
        for p in pdf.sort_values(["b", "a"]).itertuples():
            if p.a not in gone and p.b not in gone:
                gone.add(p.a if p.rank_b < p.rank_a else p.b)
        return pdf.head(0)[["a"]].rename(columns={"a": "id"}).reindex(range(len(gone))).assign(id=sorted(gone))

    kind = pairs.schema["a"].dataType.simpleString()
    return full.select("a", "b", "rank_a", "rank_b", "component").groupBy("component").applyInPandas(run, f"id {kind}")


def leaks(rows: DataFrame, reference: DataFrame, id_column: str = "text_id") -> DataFrame:
    """Rows whose id is among those of the reference."""
    return rows.join(reference.select(id_column).distinct(), id_column, "left_semi")


def close_to_any(candidates: DataFrame, held: DataFrame, least: float, id_column: str = "id") -> DataFrame:
    """Ids of candidates(id, tokens) with a Jaccard of ``least`` or more to some row of held(id, tokens).

    The prefix filter: tokens in one order from rare to frequent, a pair that is close shares one of its first n - ceil(least * n) + 1; sizes and places must fit
    before sets are compared.  Equal sets of either side are one class, so copies make no pairs, and no link is lost.  Sets are written once and meet in blocks
    (see ``blocks``), so candidates are not shuffled.
    """
    spark = candidates.sparkSession
    bounded(spark)
    side = lambda df, s: df.select(F.col(id_column).alias("id"), F.sort_array(F.array_distinct("tokens")).alias("tokens")).groupBy("tokens").agg(F.collect_set("id").alias("ids")).withColumn("side", F.lit(s))
    classes = side(candidates, "c").unionByName(side(held, "h")).withColumn("class", F.xxhash64("side", "tokens"))
    both = written(classes, "close-sets").where(F.size("tokens") > 0)  # only now, or the tokens would be made for the condition too
    pairs = written(blocks.close(written(blocks.packed(both.withColumn("hashes", F.transform("tokens", lambda t: F.xxhash64(t)))), "close-blocks"), "c", "h", least), "close-pairs")
    of = lambda c, *more: both.where(F.col("side") == ("c" if c == "a" else "h")).select(F.col("class").alias(c), F.col("tokens").alias(f"t{c}"), *more)
    confirmed = lambda p: p.join(of("a", "ids"), "a").join(of("b"), "b").where(jaccard(F.col("ta"), F.col("tb")) >= least).select("a", "ids")
    # the likest row of the other side is confirmed first; the others are looked at only where codes were wrong about that one
    first = written(confirmed(pairs.groupBy("a").agg(F.max_by("b", F.struct("likeness", "b")).alias("b"))), "close-first")
    others = confirmed(pairs.join(first.select("a"), "a", "left_anti"))
    return first.unionByName(others).select(F.explode("ids").alias(id_column)).distinct()
