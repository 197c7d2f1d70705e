"""Registered queries over reports, splits, senders, links and the classifier; they join the catalogue's.

Tables that the engine would be given (runs, redirects, registrations) are derived from the test tables by rule of the ids, over all of their rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import text as X
from ..operators import classifier, links, nearest, reports, senders, similarity, splits
from .catalogue import _JOINED, _KNN, _PR, _RATES, _COUNTS, _patterns, _scored, documents, query, read

_LABELLER = "CASE WHEN doc_id % 3 = 0 THEN 'manual' ELSE 'assisted' END"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""SELECT lang AS label, {_LABELLER} AS label_source, count(*) AS n, count(*) FILTER (flagged) AS flagged, count(*) FILTER (score >= 70) AS verdict_scam,
round(count(*) FILTER (flagged) / count(*), 6) AS fpr FROM {_JOINED} WHERE NOT truth GROUP BY 1, 2""")
def negative_fpr(spark, sf_dir):
    """False-positive rate by label and labeller."""
    rows = _scored(spark, sf_dir).withColumns({"label": F.col("lang"), "label_source": F.when(F.col("doc_id") % 3 == 0, "manual").otherwise("assisted"), "verdict": F.when(F.col("score") >= 70, "scam").otherwise("other")})
    return _rounded(reports.negative_rates(rows), "fpr")


@query(f"""WITH j AS (SELECT lang AS truth, CASE WHEN score >= 35 THEN 'en' ELSE lang END AS predicted FROM {_JOINED}), c AS (SELECT truth AS k FROM j UNION SELECT predicted FROM j),
f AS (SELECT k, 2.0 * (SELECT count(*) FROM j WHERE truth = k AND predicted = k) / ((SELECT count(*) FROM j WHERE truth = k) + (SELECT count(*) FROM j WHERE predicted = k)) AS f1 FROM c)
SELECT round(avg(f1), 6) AS macro_f1, count(*) AS classes FROM f""")
def macro_f1(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("lang").alias("truth"), F.when(F.col("score") >= 35, "en").otherwise(F.col("lang")).alias("predicted"))
    return _rounded(reports.macro_f1(rows), "macro_f1")


@query(f"SELECT doc_id, score, CASE WHEN truth THEN 'false_negative' ELSE 'false_positive' END AS mistake FROM {_JOINED} WHERE truth <> flagged")
def mistake_lists(spark, sf_dir):
    return reports.mistakes(_scored(spark, sf_dir)).select("doc_id", "score", "mistake")


@query(f"""SELECT doc_id, truth, predicted, score FROM (SELECT doc_id, lang AS truth, CASE WHEN score >= 35 THEN 'en' ELSE lang END AS predicted, score FROM {_JOINED})
WHERE truth <> predicted ORDER BY score DESC, doc_id LIMIT 20""")
def worst_errors(spark, sf_dir):
    """The twenty most confident errors: a report."""
    rows = _scored(spark, sf_dir).select("doc_id", F.col("lang").alias("truth"), F.when(F.col("score") >= 35, "en").otherwise(F.col("lang")).alias("predicted"), "score")
    return reports.worst_errors(rows, 20, confidence="score", ties="doc_id")


_BY_ID = _JOINED.replace("s.score >= 35 AS flagged", "s.score >= 35 AS flagged, CAST(s.doc_id % 101 AS INTEGER) AS other, s.doc_id % 101 >= 50 AS other_flagged")


def _system_sql(name: str, score: str, flagged: str) -> str:
    joined = f"(SELECT truth, {score} AS score, {flagged} AS flagged FROM {_BY_ID})"
    f1 = "round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"
    curve = _PR.replace(_JOINED, joined)
    return f"""SELECT '{name}' AS system, c.*, a.average_precision, t.threshold, t.fpr_at_recall FROM (SELECT tp, fp, tn, fn, {_RATES}, {f1} FROM (SELECT {_COUNTS} FROM {joined})) c,
({curve}, q AS (SELECT score, tp / n AS pr, tp / total_pos AS re FROM p) SELECT round(sum((re - prev) * pr), 6) AS average_precision FROM (SELECT *, lag(re, 1, 0.0) OVER (ORDER BY score DESC) AS prev FROM q)) a,
({curve} SELECT score AS threshold, round((n - tp) / (total - total_pos), 6) AS fpr_at_recall FROM p WHERE tp / total_pos >= 0.9 ORDER BY score DESC LIMIT 1) t"""


@query(" UNION ALL ".join(_system_sql(*x) for x in (("signs", "score", "flagged"), ("ids", "other", "other_flagged"))))
def ablation_systems(spark, sf_dir):
    """Two systems by their rates, average precision and false-positive rate at 90 % recall."""
    rows = _scored(spark, sf_dir).withColumns({"other": (F.col("doc_id") % 101).cast("int"), "other_flagged": F.col("doc_id") % 101 >= 50})
    found = reports.ablation(rows, {"signs": ("score", "flagged"), "ids": ("other", "other_flagged")})
    return _rounded(found, "precision", "recall", "fpr", "f1", "average_precision", "fpr_at_recall")


@query(f"""SELECT doc_id, kind, round(CASE kind WHEN 'rules_only' THEN score / 100.0 - p ELSE p - score / 100.0 END, 6) AS strength FROM (
SELECT doc_id, score, p, CASE WHEN score >= 70 AND p < 0.1 THEN 'rules_only' WHEN score < 20 AND p >= 0.9 THEN 'classifier_only' END AS kind FROM (SELECT doc_id, score, doc_id % 97 / 96.0::DOUBLE AS p FROM {_JOINED})) WHERE kind IS NOT NULL""")
def disagreement_list(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("doc_id", F.col("score").alias("rules_score"), (F.col("doc_id") % 97 / 96.0).alias("probability"))
    return _rounded(reports.disagreements(rows).select("doc_id", "kind", "strength"), "strength")


@query(f"SELECT doc_id, a.flagged AS flagged_a, a.score AS score_a, a.score >= 70 AS flagged_b, a.score AS score_b FROM {_JOINED} a WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def run_pairs(spark, sf_dir):
    """Two runs over the items that both hold."""
    rows = _scored(spark, sf_dir).select("doc_id", "flagged", "score")
    other = rows.where("doc_id % 3 <> 0").withColumn("flagged", F.col("score") >= 70)
    return reports.same_items(rows.where("doc_id % 2 = 0"), other, key="doc_id")


@query(f"""WITH r AS (SELECT truth, unnest([{{'setting': 'plain', 's': score}}, {{'setting': 'capped', 's': CASE WHEN doc_id % 5 = 0 THEN least(score, 34) ELSE score END}}], recursive := true) FROM {_JOINED}),
t AS (SELECT unnest(range(10, 100, 10)) AS threshold)
SELECT setting, CAST(threshold AS INTEGER) AS threshold, count(*) FILTER (truth AND s >= threshold) AS tp, count(*) FILTER (NOT truth AND s >= threshold) AS fp, count(*) FILTER (truth) AS positive, count(*) FILTER (NOT truth) AS negative,
round(count(*) FILTER (truth AND s >= threshold) / count(*) FILTER (truth), 6) AS recall, round(count(*) FILTER (NOT truth AND s >= threshold) / count(*) FILTER (NOT truth), 6) AS fpr FROM r, t GROUP BY setting, threshold""")
def threshold_sweep(spark, sf_dir):
    """Rates at nine thresholds, with and without a cap."""
    rows = _scored(spark, sf_dir).withColumn("capped", F.when(F.col("doc_id") % 5 == 0, F.least("score", F.lit(34))).otherwise(F.col("score")))
    return _rounded(reports.sweep(rows, list(range(10, 100, 10)), {"plain": "score", "capped": "capped"}), "recall", "fpr")


@query(_KNN + """, n AS (SELECT vec_id, kind, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, pattern_id) AS p FROM s), l AS (SELECT vec_id, CASE WHEN label < 5 THEN 'scam' ELSE 'genuine' END AS kind FROM embeddings)
SELECT l.kind, count(*) AS n, round(avg(CAST(l.kind = n.kind AS INTEGER)), 6) AS accuracy FROM l JOIN n ON l.vec_id = n.vec_id AND n.p = 1 GROUP BY l.kind""")
def retrieval_top1(spark, sf_dir):
    """Share of vectors whose nearest pattern is of their own kind."""
    rows, patterns = _patterns(spark, sf_dir)
    best = nearest.top_k(rows, patterns, 1, "vec_id", by_kind=False).select("vec_id", "kind")
    own = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") < 5, "scam").otherwise("genuine").alias("own"))
    return _rounded(reports.retrieval_accuracy(own.join(best, "vec_id"), "own", "kind"), "accuracy")


@query(f"SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source || lang ORDER BY quality, doc_id) AS n FROM {_JOINED}) WHERE n = 1")
def one_parent(spark, sf_dir):
    """One row a group, by priority."""
    rows = _scored(spark, sf_dir).select("quality", "doc_id", F.concat("source", "lang").alias("group_id"), "lang", "source")
    return splits.parents(rows, "quality", key="doc_id").select("doc_id", "lang", "source")


@query("""SELECT key, kind, row_number() OVER (ORDER BY slot, kind DESC) - 1 AS position FROM (SELECT c_custkey AS key, 'variation' AS kind, c_custkey // 2 AS slot, c_custkey AS place FROM customer
UNION ALL SELECT s_suppkey, 'hard_negative', s_suppkey, s_suppkey FROM supplier)""".replace("slot, kind DESC)", "slot, kind DESC, place)"))
def plan_interleave(spark, sf_dir):
    """A hard negative after every second variation; places are dense keys."""
    place = lambda t, c: read(spark, sf_dir, t).select(F.col(c).alias("key"), F.col(c).alias("place"))
    return splits.interleaved(place("customer", "c_custkey"), place("supplier", "s_suppkey")).select("key", "kind", "position")


_SETS = "SELECT doc_id, source = 'src3' AS held, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS tokens FROM documents"


@query(f"""WITH d AS ({_SETS}), c AS (SELECT tokens FROM d WHERE NOT held GROUP BY tokens), h AS (SELECT tokens FROM d WHERE held GROUP BY tokens),
m AS (SELECT DISTINCT c.tokens FROM c JOIN h ON len(c.tokens) >= 0.5 * len(h.tokens) AND len(h.tokens) >= 0.5 * len(c.tokens) AND len(c.tokens) > 0
 AND len(list_intersect(c.tokens, h.tokens)) >= 0.5 * (len(c.tokens) + len(h.tokens) - len(list_intersect(c.tokens, h.tokens))))
SELECT doc_id FROM d JOIN m USING (tokens) WHERE NOT held""")
def close_to_held_out(spark, sf_dir):
    """Documents with a token Jaccard of a half or more to one of a held-out source."""
    sets = read(spark, sf_dir, "documents").select("doc_id", "source", X.tokens(F.lower("text")).alias("tokens"))
    return similarity.close_to_any(sets.where("source <> 'src3'"), sets.where("source = 'src3'"), 0.5, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1) AND doc_id % 7 <> 0")
def test_eligible_rows(spark, sf_dir):
    label_source = F.when(F.col("doc_id") % 4 == 0, "manual").when(F.col("doc_id") % 4 == 1, "assisted").when(F.col("doc_id") % 4 == 2, "auto")
    return read(spark, sf_dir, "documents").where(splits.test_eligible(label_source, F.col("doc_id") % 7 == 0)).select("doc_id")


@query("""WITH u AS (SELECT substr(sha256(text), 1, 16) AS text_id, doc_id AS origin, 0 AS priority FROM documents WHERE source = 'src3' UNION ALL SELECT substr(sha256(text), 1, 16), doc_id, 1 FROM documents WHERE source <> 'src3'
UNION ALL SELECT substr(sha256(text), 1, 16), item_id, 2 FROM benchmark) SELECT text_id, origin, priority FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY priority, origin) AS n FROM u) WHERE n = 1""")
def sources_by_priority(spark, sf_dir):
    """Three sources in order of priority, an id once."""
    docs = read(spark, sf_dir, "documents").select(X.text_id(F.col("text")).alias("text_id"), F.col("doc_id").alias("origin"), "source")
    bench = read(spark, sf_dir, "benchmark").select(X.text_id(F.col("text")).alias("text_id"), F.col("item_id").alias("origin"))
    return splits.by_source([docs.where("source = 'src3'").drop("source"), docs.where("source <> 'src3'").drop("source"), bench])


@query("""WITH s AS (SELECT doc_id, unnest([{'signal': 'rules', 'v': length(text) % 101 * 0.3::DOUBLE, 'i': 0}, {'signal': 'upi_check', 'v': length(text) % 53 * 0.15::DOUBLE, 'i': 1},
{'signal': 'reputation', 'v': CASE WHEN lang = 'en' THEN 8.0::DOUBLE END, 'i': 2}, {'signal': 'url_intel', 'v': 7.5::DOUBLE, 'i': 3}], recursive := true) FROM documents)
SELECT doc_id, string_agg(signal, ',' ORDER BY p) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(v, 9) DESC, i) AS p FROM s WHERE v IS NOT NULL) WHERE p <= 3 GROUP BY doc_id""")
def top_signals(spark, sf_dir):
    n = F.length("text")
    one = lambda name, score, w: F.struct(F.lit(name).alias("signal"), score.cast("double").alias("score"), F.lit(w).alias("weight"))
    shown = F.array(one("rules", n % 101, 0.3), one("upi_check", n % 53, 0.15), F.struct(F.lit("reputation").alias("signal"), F.lit(80.0).alias("score"), F.when(F.col("lang") == "en", 0.1).otherwise(0.0).alias("weight")), one("url_intel", F.lit(50), 0.15))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(reports.top_signals(shown), ",").alias("top"))


@query()
def url_checks(spark, sf_dir):
    """Links of all pages, and short links to every fifth, against registrations and threats by rule; a message has two of them."""
    pages = read(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", "url")
    short = pages.where("page_id % 5 = 0").select("page_id", F.concat(F.lit("https://bit.ly/p"), "page_id").alias("url"), F.col("url").alias("location"))
    redirects = short.select("url", F.lit(301).alias("status"), "location")
    domain = E.registered_domain(links.host_of(F.col("url")))
    registered = F.date_sub(F.lit("2024-01-01").cast("date"), (F.abs(F.xxhash64("domain")) % 800).cast("int"))
    domains = pages.select(domain.alias("domain")).distinct().withColumn("registered", registered)
    blocked = pages.where("page_id % 13 = 0").select("url", F.array(F.lit("malware")).alias("threats"))
    every = pages.unionByName(short.drop("location"))
    found = links.checked(every, redirects, domains, blocked, F.lit("2024-01-01").cast("date"))
    return links.riskiest(every.join(found, "url"), "page_id")


_SENDER = "CASE c_custkey % 6 WHEN 0 THEN 'VM-' || upper(substr(c_mktsegment, 1, 6)) || '-S' WHEN 1 THEN '+44 7911 ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 2 THEN '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 3 THEN c_name WHEN 4 THEN '1800 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE '' END"


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN s = '' THEN NULL WHEN regexp_full_match(upper(s), '[A-Z]{{2}}-[A-Z0-9]{{6}}(-[SPTG])?') THEN 'dlt_header' WHEN s LIKE '+44%' THEN 'international'
WHEN regexp_full_match(s, '[6-9][0-9]{{9}}') THEN 'personal_mobile' WHEN regexp_full_match(s, '[0-9 ]{{8,20}}') THEN 'other_number' ELSE 'name' END AS kind FROM (SELECT {_SENDER} AS s FROM customer)) GROUP BY kind""")
def sender_kinds(spark, sf_dir):
    sender = F.expr(_SENDER.replace("VARCHAR", "STRING"))
    return read(spark, sf_dir, "customer").groupBy(senders.sender_kind(sender).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 4 IN (0, 3) THEN 'give exactly one of upi_id or upi_uri' WHEN c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN 'upi_id must look like name@handle'
WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 0 THEN 'upi_uri must be a upi://pay?pa=... link' END AS reason FROM customer) GROUP BY reason""")
def upi_requests(spark, sf_dir):
    """Why requests for a payment check are refused."""
    k = F.col("c_custkey")
    upi = F.when(k % 4 == 1, F.when(k % 3 == 0, "name only").otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@ybl")))).when(k % 4 == 3, "a@ybl")
    link = F.when(k % 4 == 2, F.when(k % 3 == 0, "upi://pay?am=10").otherwise(F.concat(F.lit("upi://pay?am=1&pa=c"), k.cast("string"), F.lit("@ybl")))).when(k % 4 == 3, "upi://pay?pa=a@ybl")
    return read(spark, sf_dir, "customer").groupBy(E.rejected_upi(upi, link).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def reportable_entities(spark, sf_dir):
    found = documents(spark, sf_dir).withColumn("e", E.entities("text"))
    return found.select("doc_id", F.inline(E.reportable(F.col("e"))))


#: A small model with known coefficients, for inference alone.
_TERMS = {"die": (1.5, 0.8, -0.4), "der": (1.25, 0.1, 0.9), "the": (1.1, -0.7, 0.2), "of": (2.0, -0.3, 0.6), "que": (1.75, 0.5, -0.9)}
_MODEL = {"format": classifier.FORMAT, "version": classifier.VERSION, "classes": ["a", "b"], "blocks": [{"analyzer": "word", "terms": list(_TERMS), "idf": [v[0] for v in _TERMS.values()]}], "coef": [[v[1] for v in _TERMS.values()], [v[2] for v in _TERMS.values()]], "intercept": [0.1, -0.2], "temperature": 1.5}


@query(f"""WITH m(term, idf, a, b) AS (VALUES {', '.join(f"('{t}', {i}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for t, (i, a, b) in _TERMS.items())}),
w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS term FROM conversations), v AS (SELECT conv_id, turn, a, b, (1 + ln(count(*))) * idf AS v FROM w JOIN m USING (term) GROUP BY conv_id, turn, term, idf, a, b),
z AS (SELECT conv_id, turn, sum(a * v) / sqrt(sum(v * v)) AS za, sum(b * v) / sqrt(sum(v * v)) AS zb FROM v GROUP BY conv_id, turn)
SELECT conv_id, turn, round(1 / (1 + exp((coalesce(zb, 0) - 0.2 - coalesce(za, 0) - 0.1) / 1.5)), 6) AS p_a FROM conversations LEFT JOIN z USING (conv_id, turn)""")
def tfidf_inference(spark, sf_dir):
    """Probabilities of a given model for all turns."""
    words = {"word": F.split(F.lower("text"), " ")}
    found = classifier.predicted(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _MODEL, words)
    return found.select("conv_id", "turn", F.round(F.col("probabilities")["a"], 6).alias("p_a"))


@query()
def classifier_trained(spark, sf_dir):
    """Quality labels learned, from words and pairs of words, on four fifths of the labelled documents; the rest predicted."""
    labelled = documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = classifier.trained(labelled.where(~held), "doc_id", most={"word": 20_000}, iterations=30)
    return classifier.predicted(labelled.where(held), model).select("doc_id", "label", "predicted", F.round("confidence", 3).alias("confidence"))
