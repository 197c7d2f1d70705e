"""Links checked against tables of redirects, registrations and threats: findings, score and floor of each, and the riskiest of a message.

The tables stand in for the network: redirects(url, status, location), domains(domain, registered), blocklist(url, threats).  A link that a table does
not know has simply no finding of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import SHORTENERS, registered_domain
from . import rules as R
from .state import redirect_chain

#: Fixed: days of age, statuses of a disabled short link, weights of the findings and floors.
NEW_DAYS, YOUNG_DAYS, ESTABLISHED_DAYS = 30, 180, 365
DISABLED = [404, 410]
WEIGHTS = {"short_link_disabled": 0.3, "shortener_redirect": 0.3, "lookalike": 0.7, "suspicious_tld": 0.25, "new_domain": 0.6, "young_domain": 0.3, "blocklisted": 1.0}
ESTABLISHED_WEIGHT = 0.1
FLOORS = {"blocklisted": 90, "lookalike_confirmed": 75, "shortener_new": 50}

_HOST = r"^https?://([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def checked(links: DataFrame, redirects: DataFrame, domains: DataFrame, blocklist: DataFrame, today: Column) -> DataFrame:
    """A row for each distinct url of links(url): final, allowlisted, registered, findings, score, floor.

    Only short links are followed.  Registrations are looked up by the final domain, threats by both the link and its end.
    """
    hosts = links.select("url").distinct().withColumn("__host", host_of(F.col("url"))).withColumn("__domain", registered_domain(F.col("__host")))
    short = F.col("__domain").isin(list(SHORTENERS)) | F.col("__host").isin(list(SHORTENERS))
    hosts = hosts.withColumn("__short", short)
    followed = redirect_chain(hosts.where("__short"), redirects).select("url", F.col("final").alias("__end"), F.col("status").alias("__status"))
    ends = hosts.join(followed, "url", "left").withColumn("final", F.coalesce("__end", "url")).withColumn("__final_host", host_of(F.col("final")))
    ends = ends.withColumn("__final_domain", registered_domain(F.col("__final_host")))
    ages = domains.groupBy(F.col("domain").alias("__final_domain")).agg(F.min("registered").alias("registered"))
    bad = blocklist.where(F.size("threats") > 0).select("url").distinct()
    ends = ends.join(ages, "__final_domain", "left").join(bad.withColumn("__bad1", F.lit(True)), "url", "left")
    ends = ends.join(bad.select(F.col("url").alias("final"), F.lit(True).alias("__bad2")), "final", "left")

    moved = F.col("__domain") != F.col("__final_domain")
    allowed = R.is_official(F.col("__final_domain")) & (moved | ~F.col("__short"))
    end_is_short = F.col("__final_domain").isin(list(SHORTENERS)) | F.col("__final_host").isin(list(SHORTENERS))
    days = F.when(~end_is_short & ~F.col("__final_host").rlike(r"^\d+(\.\d+){3}$"), F.datediff(today, F.col("registered")))
    ends = ends.withColumns({"__days": days, "allowlisted": allowed, "__brand": R.lookalike_brand(F.col("__final_host"), F.col("__final_domain"))})
    days = F.col("__days")
    holds = {
        "short_link_disabled": F.col("__short") & ~moved & F.col("__status").isin(DISABLED),
        "shortener_redirect": F.col("__short") & moved,
        "lookalike": F.col("__brand").isNotNull(),
        "suspicious_tld": F.substring_index("__final_host", ".", -1).isin(R.RISKY_TLDS),
        "new_domain": days < NEW_DAYS,
        "young_domain": (days >= NEW_DAYS) & (days < YOUNG_DAYS),
        "blocklisted": F.coalesce("__bad1", "__bad2", F.lit(False)),
    }
    none = F.array().cast("array<string>")
    codes = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in holds.items()]), lambda k: k.isNotNull())
    ends = ends.withColumn("findings", F.when(F.col("allowlisted"), none).otherwise(codes))
    found = lambda k: F.array_contains("findings", k)
    settled = (F.size("findings") == 1) & found("shortener_redirect") & F.coalesce(days >= ESTABLISHED_DAYS, F.lit(False))
    weights = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    score = F.when(settled, R.saturating(F.array(F.lit(ESTABLISHED_WEIGHT)))).otherwise(R.saturating(F.transform("findings", lambda k: F.element_at(weights, k))))
    floor = (
        F.when(found("blocklisted"), FLOORS["blocklisted"])
        .when(found("lookalike") & (found("new_domain") | found("shortener_redirect")), FLOORS["lookalike_confirmed"])
        .when(found("new_domain") & found("shortener_redirect"), FLOORS["shortener_new"])
    )
    return ends.select("url", "final", "allowlisted", "registered", "findings", score.alias("score"), floor.alias("floor"))


def riskiest(found: DataFrame, key: str) -> DataFrame:
    """One row a message of (key, link findings): score and floor of the riskiest; informative only with a finding, or if every link is official."""
    flagged = F.size("findings") > 0
    each = found.groupBy(key).agg(F.max(F.when(flagged, F.col("score"))).alias("s"), F.max(F.when(flagged, F.col("floor"))).alias("floor"), F.bool_and("allowlisted").alias("official"))
    return each.select(key, F.coalesce("s", F.lit(0)).alias("score"), (F.col("s").isNotNull() | F.col("official")).alias("informative"), "floor")
