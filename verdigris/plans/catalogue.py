"""The registered queries over the reference's own operators, with DuckDB SQL for those that SQL can express.

Every query runs over its whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import text as X
from ..functions.udf import spread
from ..operators import metrics, nearest, rules, scoring, similarity, splits, state
from ..sources.journal import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The plain form in SQL.
_PLAIN = "trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_ID = f"substr(sha256({_PLAIN}), 1, 16)"


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").withColumn("text_id", X.text_id(X.plain(F.col("text"))))


@query(f"SELECT text_id, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, {_ID} AS text_id FROM documents) GROUP BY text_id HAVING count(*) > 1")
def text_id_dups(spark, sf_dir):
    """Exact copies by text id."""
    return identified(spark, sf_dir).groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query(f"""SELECT doc_id, text_id, copies FROM (SELECT doc_id, text_id, row_number() OVER (PARTITION BY text_id ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY text_id) AS copies
FROM (SELECT doc_id, {_ID} AS text_id FROM documents)) WHERE n = 1""")
def first_copy_wins(spark, sf_dir):
    """One row an id: the first copy, by aggregation instead of a window over all copies."""
    return identified(spark, sf_dir).groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "text_id", "copies")


@query(f"""WITH d AS (SELECT doc_id, {_ID} AS text_id, source, CASE doc_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'assisted' WHEN 2 THEN 'auto' ELSE 'dataset' END AS label_source,
  CASE WHEN length(text) % 3 = 0 THEN 'scam' ELSE 'genuine' END AS label FROM documents),
r AS (SELECT *, CASE label_source WHEN 'manual' THEN 0 WHEN 'assisted' THEN 1 WHEN 'dataset' THEN 2 WHEN 'auto' THEN 3 ELSE 4 END AS rk FROM d),
b AS (SELECT text_id, min(rk) AS best FROM r GROUP BY text_id),
t AS (SELECT r.* FROM r JOIN b ON r.text_id = b.text_id AND r.rk = b.best),
a AS (SELECT text_id FROM t GROUP BY text_id HAVING count(DISTINCT label) = 1)
SELECT text_id, doc_id, label, label_source FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY doc_id) AS n FROM t WHERE text_id IN (SELECT text_id FROM a)) WHERE n = 1""")
def label_authority_dedupe(spark, sf_dir):
    """One row an id, by authority of the label's source; conflicting labels at the best authority drop all copies."""
    rows = identified(spark, sf_dir).select("doc_id", "text_id", F.when(F.col("doc_id") % 4 == 0, "manual").when(F.col("doc_id") % 4 == 1, "assisted").when(F.col("doc_id") % 4 == 2, "auto").otherwise("dataset").alias("label_source"), F.when(F.length("text") % 3 == 0, "scam").otherwise("genuine").alias("label"))
    return similarity.one_per_id(rows, order="doc_id").select("text_id", "doc_id", "label", "label_source")


@query(f"SELECT d.doc_id, d.text_id FROM (SELECT doc_id, {_ID} AS text_id FROM documents) d WHERE d.text_id IN (SELECT {_ID} FROM benchmark UNION SELECT {_ID} FROM documents WHERE source = 'src3')")
def leak_vs_reference(spark, sf_dir):
    """Rows whose text id is in the benchmark or in a held-out source."""
    ids = identified(spark, sf_dir)
    bench = read(spark, sf_dir, "benchmark").select(X.text_id(X.plain(F.col("text"))).alias("text_id"))
    return similarity.leaks(ids, bench.union(ids.where("source = 'src3'").select("text_id"))).select("doc_id", "text_id")


_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"


@query(f"SELECT item_id, len({_TOKENS}) AS distinct_tokens, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS tokens FROM benchmark")
def token_counts(spark, sf_dir):
    text = F.lower("text")
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(X.tokens(text)).alias("distinct_tokens"), F.size(F.regexp_extract_all(text, F.lit(X.TOKEN), F.lit(0))).alias("tokens"))


_NEAR = """WITH d AS (SELECT min(doc_id) AS id, tokens FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS tokens FROM documents) GROUP BY tokens),
t AS (SELECT id, unnest(tokens) AS token FROM d), f AS (SELECT token, count(*) AS df FROM t GROUP BY token),
r AS (SELECT id, token FROM (SELECT t.id, t.token, row_number() OVER (PARTITION BY t.id ORDER BY f.df, t.token) AS n FROM t JOIN f USING (token)) WHERE n <= 3),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM r a JOIN r b ON a.token = b.token AND a.id < b.id),
s AS (SELECT p.a, p.b, len(list_intersect(x.tokens, y.tokens)) AS common, len(x.tokens) AS m, len(y.tokens) AS n FROM p JOIN d x ON x.id = p.a JOIN d y ON y.id = p.b),
e AS (SELECT a, b, common / (m + n - common) AS similarity FROM s WHERE common / (m + n - common) >= 0.7)"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with different sets of words, written once; equal sets are one class, named by its least id."""
    sets = read(spark, sf_dir, "documents").select("doc_id", F.sort_array(X.tokens(F.lower("text"))).alias("tokens"))
    return written(sets.groupBy("tokens").agg(F.min("doc_id").alias("id")).select("id", "tokens"), "classes")


@query(_NEAR + " SELECT a, b, round(similarity, 6) AS similarity FROM e")
def token_jaccard_pairs(spark, sf_dir):
    """Near-duplicate documents: candidates share a token rare to both, Jaccard 0.7 or more."""
    return similarity.near_pairs(_classes(spark, sf_dir), 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(_NEAR.replace("WITH d", "WITH RECURSIVE d") + """, b2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT id, id AS root FROM d UNION SELECT b2.b AS id, walk.root FROM walk JOIN b2 ON b2.a = walk.id)
SELECT id, min(root) AS group_id FROM walk GROUP BY id""")
def template_groups(spark, sf_dir):
    """Transitive closure of near duplicates; a group is named by its least id."""
    rows = _classes(spark, sf_dir)
    return similarity.with_groups(rows, similarity.near_pairs(rows, 0.7)).select("id", "group_id")


def _u(key: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(sha256('{salt}:' || {key}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@query(f"SELECT doc_id, CASE WHEN u < 0.15 THEN 'heldout' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, {_u('source || lang', 'split')} AS u FROM documents)")
def group_hash_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", splits.bucket(F.concat("source", "lang")).alias("split"))


@query(f"SELECT doc_id, label, CASE WHEN label = 'uncertain' THEN 'uncertain' ELSE 'sample' END AS reason FROM (SELECT doc_id, CASE WHEN length(text) % 50 = 0 THEN 'uncertain' ELSE 'genuine' END AS label, {_u('CAST(doc_id AS VARCHAR)', 'review')} AS u FROM documents) WHERE label = 'uncertain' OR u < 0.1")
def review_sample(spark, sf_dir):
    """All uncertain rows and a hashed tenth of the others."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("text_id"), F.when(F.length("text") % 50 == 0, "uncertain").otherwise("genuine").alias("label"))
    return splits.review_queue(rows).select("doc_id", "label", "reason")


@query("""WITH r AS (SELECT d.doc_id, d.lang, l.quality, sha256('pick:' || CAST(d.doc_id AS VARCHAR)) AS h FROM documents d JOIN labels l USING (doc_id)),
n AS (SELECT *, count(*) OVER (PARTITION BY lang, quality) AS n, row_number() OVER (PARTITION BY lang, quality ORDER BY h, CAST(doc_id AS VARCHAR)) AS p FROM r)
SELECT doc_id, lang, quality FROM n WHERE n >= 3 AND p <= greatest(1, round_even(n * 0.2, 0))""")
def stratified_pick(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", F.col("doc_id").cast("string").alias("text_id"))
    return splits.stratified_pick(rows, ["lang", "quality"], 0.2).select("doc_id", "lang", "quality")


_LETTERS = "len(regexp_extract_all(text, '\\p{L}'))"


@query(f"""SELECT guess, count(*) AS n FROM (SELECT CASE WHEN len(regexp_extract_all(text, '[ऄ-हक़-ॡ]')) > 0.3 * {_LETTERS} THEN 'hi'
WHEN len(list_filter(w, lambda x: list_contains({X.STRONG}, x))) >= 2 OR (len(list_filter(w, lambda x: list_contains({X.STRONG}, x))) >= 1 AND len(list_filter(w, lambda x: list_contains({X.AMBIGUOUS}, x))) >= 2) THEN 'hinglish' ELSE 'en' END AS guess
FROM (SELECT text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations)) GROUP BY guess""")
def language_guess(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy(X.guess_language(F.col("text")).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?;\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS c FROM conversations),
w AS (SELECT conv_id, turn, list_filter(list_transform(range(1, len(c) + 1), lambda i: array_to_string(c[i:i+1], ' . ')), lambda x: regexp_matches(x, '(^|[^\\p{L}])(the|la|die|de)($|[^\\p{L}])') AND regexp_matches(x, '(^|[^\\p{L}])(of|et|und|que)($|[^\\p{L}])')) AS h FROM c)
SELECT conv_id, turn, h[1] AS evidence FROM w WHERE len(h) > 0""")
def clause_window_hits(spark, sf_dir):
    """First run of two clauses in which both phrase groups match."""
    phrases = {"articles": r"(^|[^\p{L}])(the|la|die|de)($|[^\p{L}])", "links": r"(^|[^\p{L}])(of|et|und|que)($|[^\p{L}])"}
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", rules.near(X.clauses(F.lower("text")), ["articles", "links"], phrases=phrases).alias("evidence"))
    return found.where("evidence IS NOT NULL")


def _extracted(pattern: str) -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        each = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("value"))
        return each

    return run, f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{pattern}'))) AS value FROM documents"


for _name, _pattern in {"email_extract": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]", "phone_like_extract": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "ipv4_extract": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}.items():
    QUERIES[_name], ORACLE[_name] = _extracted(_pattern)

_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_DOMAIN = f"CASE WHEN regexp_matches({_HOST}, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN {_HOST} WHEN list_contains({E.TWO_PART_SUFFIXES}, array_to_string(string_split({_HOST}, '.')[-2:], '.')) THEN array_to_string(string_split({_HOST}, '.')[-3:], '.') ELSE array_to_string(string_split({_HOST}, '.')[-2:], '.') END"


@query(f"SELECT page_id, {_HOST} AS host, {_DOMAIN} AS registered_domain FROM pages")
def registered_domain(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), E.registered_domain(host).alias("registered_domain"))


@query("""SELECT regexp_extract(url, '^(https?)://', 1) AS scheme, count(*) AS n, count(*) FILTER (url LIKE '%?%') AS with_query, count(*) FILTER (url LIKE '%#%') AS with_fragment,
count(*) FILTER (regexp_matches(url, '[?&]page=')) AS paged FROM pages GROUP BY 1""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").groupBy(F.parse_url(url, F.lit("PROTOCOL")).alias("scheme")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.parse_url(url, F.lit("QUERY")).isNotNull()).alias("with_query"), F.count_if(F.parse_url(url, F.lit("REF")).isNotNull()).alias("with_fragment"), F.count_if(F.parse_url(url, F.lit("QUERY"), F.lit("page")).isNotNull()).alias("paged"))


@query("""WITH t AS (SELECT page_id, unnest(string_split(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.')) AS token FROM pages), b(brand) AS (VALUES ('thther'), ('example'), ('ththre'))
SELECT DISTINCT page_id, brand FROM t, b WHERE levenshtein(translate(token, '01345', 'oleas'), brand) <= 1""")
def lookalike_scan(spark, sf_dir):
    """Host tokens within one edit of a brand, after folding digits that look like letters; brands are a literal array."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    tokens = read(spark, sf_dir, "pages").select("page_id", F.explode(F.split(host, r"\.")).alias("token"))
    brands = F.array(*map(F.lit, ["thther", "example", "ththre"]))
    return tokens.select("page_id", F.explode(F.filter(brands, lambda b: F.levenshtein(F.translate("token", "01345", "oleas"), b, 1) >= 0)).alias("brand")).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


@query()
def entities_full(spark, sf_dir):
    e = F.col("e")
    found = documents(spark, sf_dir).withColumn("e", E.entities("text"))
    return found.select("doc_id", F.transform(e["urls"], lambda u: u["url"]).alias("urls"), F.transform(e["upi_ids"], lambda u: u["value"]).alias("upi_ids"), F.transform(e["phones"], lambda p: p["number"]).alias("phones"), F.transform(e["amounts"], lambda a: a["value"]).alias("amounts"), e["sensitive_info"].alias("sensitive_info"), e["remote_access_apps"].alias("apps"))


@query()
def entities_documents(spark, sf_dir):
    """Entity counts by language over all documents."""
    e = F.col("e")
    found = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id").select("lang", E.entities("text").alias("e"))
    return found.groupBy("lang").agg(*[F.sum(F.size(e[c])).alias(c) for c in ("urls", "upi_ids", "phones", "amounts", "emails", "sensitive_info")])


@query()
def entity_spans(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode_outer(E.entity_spans("text")).alias("s")).select("doc_id", "s.*")


@query()
def entity_keys(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("e", E.entities("text")).select("doc_id", F.explode(E.entity_keys(F.col("e"))).alias("k")).select("doc_id", "k.*")


@query()
def rule_hits_full(spark, sf_dir):
    found = rules.evaluate(turns(spark, sf_dir).withColumn("entities", E.entities("text")))
    return found.select("conv_id", "turn", "rules_score", "rules_type", F.explode_outer("hits").alias("h")).select("conv_id", "turn", "rules_score", "rules_type", "h.rule_id", "h.weight", "h.evidence")


@query()
def score_full(spark, sf_dir):
    return scoring.explained(scoring.analyzed(turns(spark, sf_dir))).select("conv_id", "turn", "risk_score", "verdict", "scam_type", "explanation_en", "advice_en")


@query()
def score_breakdown(spark, sf_dir):
    rows = turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("id"), "text")
    return scoring.breakdown(scoring.analyzed(rows), "id").select("id.*", "signal", "score", "weight", "state")


@query()
def score_conversations(spark, sf_dir):
    """Verdicts by role over all turns: the whole path on a table."""
    said = spread(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn").select("role", "text")
    return scoring.analyzed(said).groupBy("role", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max("risk_score").alias("highest"))


@query()
def anonymize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", E.anonymized("text").alias("text"))


@query()
def classifier_text(spark, sf_dir):
    """Masked text and its n-grams."""
    masked = documents(spark, sf_dir).select("doc_id", E.preprocessed("text").alias("masked"))
    return masked.select("doc_id", "masked", F.size(X.word_ngrams(X.masked_words(F.col("masked")))).alias("word_ngrams"), F.size(X.char_ngrams(F.col("masked"))).alias("char_ngrams"))


_SIGNS = {"upper": ("[A-Z]{6,}", 0.5), "pipe": (r"\|", 0.3), "bang": ("!!", 0.4), "digits": ("[0-9]{9,}", 0.6), "at": ("@", 0.2)}


def _signs(text):
    return {k: F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for k, (p, w) in _SIGNS.items()}


_SIGN_SQL = {k: f"(CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0.0 END)" for k, (p, w) in _SIGNS.items()}
_NOISY = "CAST(round_even(100 * (1 - " + " * ".join(f"(1.0::DOUBLE - {s})" for s in _SIGN_SQL.values()) + "), 0) AS INTEGER)"
_FLAGGED = f"(SELECT d.doc_id, d.lang, d.source, {_NOISY} AS score FROM documents d)"


@query(f"SELECT doc_id, {_NOISY} AS score FROM documents")
def noisy_or_by_doc(spark, sf_dir):
    """Saturating score of weighted signs."""
    return read(spark, sf_dir, "documents").select("doc_id", rules.saturating(F.array(*_signs(F.col("text")).values())).alias("score"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", rules.saturating(F.array(*_signs(F.col("text")).values())).alias("score"))
    return docs.join(labels, "doc_id").withColumn("truth", F.col("quality") == 0).withColumn("flagged", F.col("score") >= 35)


_JOINED = f"(SELECT s.*, l.quality, l.toxic, l.quality = 0 AS truth, s.score >= 35 AS flagged FROM {_FLAGGED} s JOIN labels l USING (doc_id))"
_COUNTS = "count(*) FILTER (truth AND flagged) AS tp, count(*) FILTER (NOT truth AND flagged) AS fp, count(*) FILTER (NOT truth AND NOT flagged) AS tn, count(*) FILTER (truth AND NOT flagged) AS fn"
_RATES = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr"


@query(f"SELECT lang, tp, fp, tn, fn, {_RATES}, round(CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN NULL WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS f1 FROM (SELECT lang, {_COUNTS} FROM {_JOINED} GROUP BY lang)")
def confusion_by_lang(spark, sf_dir):
    found = metrics.rates(metrics.confusion(_scored(spark, sf_dir), "lang"))
    return found.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr", "f1")])


@query(f"""WITH j AS (SELECT lang AS truth, CASE WHEN score >= 35 THEN 'en' ELSE lang END AS predicted FROM {_JOINED}),
c AS (SELECT DISTINCT truth AS class FROM j)
SELECT class, s AS support, round(h / nullif(p, 0), 6) AS precision, round(h / nullif(s, 0), 6) AS recall FROM (
SELECT class, (SELECT count(*) FROM j WHERE truth = class) AS s, (SELECT count(*) FROM j WHERE predicted = class) AS p, (SELECT count(*) FROM j WHERE truth = class AND predicted = class) AS h FROM c)""")
def per_class_f1(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("lang").alias("truth"), F.when(F.col("score") >= 35, "en").otherwise(F.col("lang")).alias("predicted"))
    return metrics.per_class(rows).select("class", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT lang AS truth, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM {_JOINED} GROUP BY lang")
def pivot_confusion(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("lang").alias("truth"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("predicted"))
    return metrics.pivoted(rows, ["clean", "toxic"])


_PR = f"""WITH b AS (SELECT score, sum(CAST(truth AS BIGINT)) AS pos, count(*) AS n FROM {_JOINED} GROUP BY score),
p AS (SELECT score, sum(pos) OVER w AS tp, sum(n) OVER w AS n, sum(pos) OVER () AS total_pos, sum(n) OVER () AS total FROM b WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(_PR + " SELECT score, CAST(tp AS BIGINT) AS tp, CAST(n AS BIGINT) AS n, round(tp / n, 6) AS precision, round(tp / nullif(total_pos, 0), 6) AS recall FROM p")
def pr_curve(spark, sf_dir):
    return metrics.pr_points(_scored(spark, sf_dir)).select("score", "tp", "n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(_PR + ", q AS (SELECT score, tp / n AS pr, tp / total_pos AS re FROM p) SELECT round(sum((re - prev) * pr), 6) AS average_precision FROM (SELECT *, lag(re, 1, 0.0) OVER (ORDER BY score DESC) AS prev FROM q)")
def avg_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


@query(_PR + " SELECT score AS threshold, round((n - tp) / (total - total_pos), 6) AS fpr FROM p WHERE tp / total_pos >= 0.5 ORDER BY score DESC LIMIT 1")
def fpr_at_recall(spark, sf_dir):
    return metrics.fpr_at_recall(_scored(spark, sf_dir), 0.5).select("threshold", F.round("fpr", 6).alias("fpr"))


@query(f"""SELECT source, n, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM (SELECT source, count(*) AS n, avg(CAST(flagged AS INTEGER)) AS p FROM {_JOINED} GROUP BY source)""")
def wilson_by_group(spark, sf_dir):
    counts = _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("hits"))
    low, high = metrics.wilson(F.col("hits"), F.col("n"))
    return counts.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS middle FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.median("value"), 6).alias("middle"))


@query(f"""SELECT lang, label_source, count(*) AS n, count(*) FILTER (f) AS flagged FROM (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'manual' ELSE 'assisted' END AS label_source, flagged AS f FROM {_JOINED})
GROUP BY GROUPING SETS ((lang), (lang, label_source))""")
def grouping_views(spark, sf_dir):
    """Combined, manual and assisted views of the same rows in one pass."""
    rows = _scored(spark, sf_dir).select("lang", F.when(F.col("doc_id") % 3 == 0, "manual").otherwise("assisted").alias("label_source"), "flagged")
    return rows.groupingSets([["lang"], ["lang", "label_source"]], "lang", "label_source").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))


@query(f"""WITH r AS (SELECT doc_id, source || lang AS g, quality, lang = 'en' AS home FROM {_JOINED}), s AS (SELECT *, count(*) OVER (PARTITION BY g) AS size FROM r),
w AS (SELECT *, least(1.0::DOUBLE, 3.0::DOUBLE / size) * CASE WHEN home THEN 5.0 ELSE 1.0 END AS raw FROM s),
t AS (SELECT *, sum(raw) OVER (PARTITION BY quality) AS total, sum(raw) OVER () AS everything FROM w)
SELECT doc_id, round(raw * everything / (SELECT count(DISTINCT quality) FROM r) / total, 6) AS weight FROM t""")
def weighted_sample_weights(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("doc_id", F.concat("source", "lang").alias("group_id"), F.col("quality").alias("label"), (F.col("lang") == "en").alias("is_indian"))
    return splits.sample_weights(rows).select("doc_id", F.round("weight", 6).alias("weight"))


@query("""WITH o AS (SELECT doc_id, lang, unnest([{'s': CAST(length(text) % 101 AS DOUBLE), 'w': 0.3::DOUBLE}, {'s': CASE WHEN length(text) % 7 = 0 THEN NULL ELSE CAST(length(text) % 53 AS DOUBLE) END, 'w': 0.15::DOUBLE}, {'s': CASE WHEN lang = 'en' THEN 80.0::DOUBLE ELSE NULL END, 'w': 0.1::DOUBLE}]) AS o FROM documents)
SELECT doc_id, CAST(round_even(sum(o.w * o.s) / sum(o.w), 0) AS INTEGER) AS score FROM o WHERE o.s IS NOT NULL GROUP BY doc_id""")
def weighted_mean_renorm(spark, sf_dir):
    """Weighted mean of outcomes, weights renormalised over those that count."""
    n = F.length("text")
    outcomes = F.array(
        scoring.outcome("rules", (n % 101).cast("double")),
        scoring.outcome("upi_check", F.when(n % 7 != 0, (n % 53).cast("double"))),
        scoring.outcome("reputation", F.when(F.col("lang") == "en", F.lit(80.0))),
    )
    return read(spark, sf_dir, "documents").select("doc_id", scoring.combined(outcomes).alias("score"))


_KNN = """WITH p AS (SELECT vec_id AS pattern_id, embedding AS pv, CASE WHEN label < 5 THEN 'scam' ELSE 'genuine' END AS kind FROM embeddings WHERE vec_id < 28),
s AS (SELECT e.vec_id, p.pattern_id, p.kind, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.pv AS DOUBLE[])) AS similarity FROM embeddings e, p)"""


def _patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = read(spark, sf_dir, "embeddings")
    patterns = vectors.where("vec_id < 28").select(F.col("vec_id").alias("pattern_id"), F.when(F.col("label") < 5, "scam").otherwise("genuine").alias("kind"), F.col("embedding").alias("pattern_vector"))
    return vectors.select("vec_id", "embedding"), patterns


@query(_KNN + " SELECT vec_id, kind, pattern_id, round(similarity, 5) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, kind ORDER BY similarity DESC, pattern_id) AS place FROM s) WHERE place <= 3")
def knn_topk(spark, sf_dir):
    """The three nearest of 28 patterns of each kind, for every vector: the pattern table is a fixed set of queries."""
    rows, patterns = _patterns(spark, sf_dir)
    return nearest.top_k(rows, patterns, 3, "vec_id").select("vec_id", "kind", "pattern_id", F.round("similarity", 5).alias("similarity"), "place")


@query(_KNN + " SELECT vec_id, round(max(similarity) FILTER (kind = 'scam') - max(similarity) FILTER (kind = 'genuine'), 5) AS margin FROM s GROUP BY vec_id")
def knn_margin(spark, sf_dir):
    rows, patterns = _patterns(spark, sf_dir)
    return nearest.margins(rows, patterns, "vec_id").select("vec_id", F.round("margin", 5).alias("margin"))


@query("SELECT user_id, event_type, count(*) AS report_count, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def report_counters(spark, sf_dir):
    return state.counters(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


_REPORTED = "(SELECT event_type AS entity_type, CAST(user_id AS VARCHAR) AS value, count(*) AS report_count, bool_or(value > 99) AS v FROM (SELECT event_type, user_id, value FROM events WHERE event_type <> 'view') GROUP BY ALL)"


@query(f"""WITH k AS (SELECT event_id AS msg_id, event_type AS entity_type, CAST(user_id AS VARCHAR) AS value FROM events UNION SELECT event_id, 'click', CAST(user_id AS VARCHAR) FROM events),
j AS (SELECT k.*, r.report_count, r.v, CASE WHEN r.v THEN 100 WHEN r.report_count >= 3 THEN 80 WHEN r.report_count = 2 THEN 60 ELSE 40 END AS s FROM k JOIN {_REPORTED} r USING (entity_type, value)),
m AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY s DESC, report_count DESC, entity_type DESC, value DESC) AS n, count(*) OVER (PARTITION BY msg_id) AS c, bool_or(v) OVER (PARTITION BY msg_id) AS anyv FROM j)
SELECT msg_id, s AS score, CASE WHEN anyv THEN 90 WHEN report_count >= 3 THEN 50 END AS floor, entity_type, value, c AS reported_entities FROM m WHERE n = 1""")
def reputation_join(spark, sf_dir):
    """Reported entities of each message: score, floor and the worst entity."""
    events = read(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    keys = events.select(F.col("event_id").alias("msg_id"), F.explode(F.array(F.struct(F.col("event_type").alias("entity_type"), user.alias("value")), F.struct(F.lit("click").alias("entity_type"), user.alias("value")))).alias("k")).select("msg_id", "k.*")
    reported = events.where("event_type <> 'view'").select(F.col("event_type").alias("entity_type"), user.alias("entity"), "value").groupBy("entity_type", "entity").agg(F.count(F.lit(1)).alias("report_count"), F.bool_or(F.col("value") > 99).alias("is_verified_scam")).withColumnRenamed("entity", "value")
    return state.with_reputation(keys, reported)


@query("""SELECT a.event_id, arg_max(b.value, b.ts) AS result, max(b.ts) AS checked_at FROM (SELECT * FROM events WHERE event_type = 'click') a
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 24 HOURS GROUP BY a.event_id""")
def ttl_asof_lookup(spark, sf_dir):
    """The newest entry of the key that is at most 24 hours old."""
    events = read(spark, sf_dir, "events")
    asks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    entries = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("checked"), F.col("value").alias("result"))
    return state.ttl_lookup(asks, entries, "user_id", "ts", "checked").select("event_id", "result", "checked_at")


@query("""SELECT event_id, in_window, in_window > 2 AS denied FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events)""")
def rate_window(spark, sf_dir):
    return state.rate_windows(read(spark, sf_dir, "events"), "user_id", "ts", 2, 7200).select("event_id", "in_window", "denied")


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, [ts] AS times, true AS allowed FROM r WHERE n = 1 UNION ALL SELECT user_id, event_id, n, CASE WHEN len(f) < 2 THEN list_append(f, ts) ELSE f END, len(f) < 2
FROM (SELECT r.*, list_filter(w.times, lambda x: x > r.ts - INTERVAL 7200 SECONDS) AS f FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1))
SELECT event_id, allowed FROM w""")
def rate_limited(spark, sf_dir):
    """A moving window for each user in which denied events don't count."""
    return state.rate_limited(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 2, 7200, "event_id").select("event_id", "allowed")


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def latest_wins_upsert(spark, sf_dir):
    return state.latest(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "value", "ts")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS c, lang AS m FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS c, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS m FROM documents WHERE doc_id % 9 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.c <> b.c THEN 'reembedded' WHEN a.m <> b.m THEN 'updated' ELSE 'unchanged' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def sync_actions(spark, sf_dir):
    """What a full synchronisation of a stored copy would do; the stored copy differs by rule in presence, content and metadata."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("c"), F.col("lang").alias("m"))
    stored = docs.where("doc_id % 9 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("c")).alias("c"), F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("m")).alias("m"))
    return state.sync_actions(docs.where("doc_id % 10 <> 0"), stored, "doc_id", "c", "m")


@query(f"SELECT lang, count(*) FILTER (truth AND flagged) AS tp, count(*) FILTER (truth AND flagged AND source = guess) AS agreeing, round(count(*) FILTER (truth AND flagged AND source = guess) / nullif(count(*) FILTER (truth AND flagged), 0), 6) AS agreement FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'src1' END AS guess FROM {_JOINED}) GROUP BY lang")
def type_agreement(spark, sf_dir):
    """Of rows rightly flagged, the share whose type was rightly named."""
    rows = _scored(spark, sf_dir).withColumn("guess", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("src1"))
    return metrics.type_agreement(rows, "lang", kind="source", guess="guess").withColumn("agreement", F.round("agreement", 6))


_PAGES = "(SELECT url, min(page_id) AS id FROM pages WHERE url IS NOT NULL GROUP BY url)"


@query(f"""WITH RECURSIVE p AS {_PAGES}, j AS (SELECT a.id, a.url, regexp_extract(a.url, '^([a-z]+://[^/?#]*)', 1) AS root, b.url AS following FROM p a LEFT JOIN p b ON b.id = a.id + 1),
r AS (SELECT url, CASE WHEN id % 13 = 11 THEN 200 WHEN id % 13 = 12 THEN 404 WHEN id % 13 = 10 THEN 304 ELSE 302 END AS status,
  CASE id % 13 WHEN 6 THEN root || '/moved/to?p=' || id WHEN 7 THEN 'http://10.0.0.1/x' WHEN 8 THEN split_part(root, '://', 1) || '://other.example/a/c/../b#top' WHEN 9 THEN '' ELSE following END AS location FROM j UNION ALL SELECT 'http://10.0.0.1/x', 301, 'http://never.example/'),
w AS (SELECT url, url AS final, 0 AS hops FROM r WHERE url <> 'http://10.0.0.1/x' UNION ALL SELECT w.url, r.location, w.hops + 1 FROM w JOIN r ON r.url = w.final AND r.status IN (301, 302) AND r.location <> '' AND w.final <> 'http://10.0.0.1/x' WHERE w.hops < 5),
m AS (SELECT url, arg_max(final, hops) AS final, max(hops) AS hops FROM w GROUP BY url)
SELECT m.url, m.final, m.hops, CASE WHEN m.hops < 5 AND m.final <> 'http://10.0.0.1/x' THEN r.status END AS status FROM m LEFT JOIN r ON r.url = m.final""")
def redirect_chain(spark, sf_dir):
    """Redirects over all pages by rule of their ids: to the next page, relative, to another host by a path with dots, to a private address, to nowhere."""
    pages = read(spark, sf_dir, "pages").where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("id"))
    k, number = F.col("id") % 13, F.col("id").cast("string")
    following = pages.select((F.col("id") - 1).alias("id"), F.col("url").alias("following"))
    to = F.when(k == 6, F.concat(F.lit(" /gone/../moved/./to?p="), number)).when(k == 7, "http://10.0.0.1/x").when(k == 8, "//other.example/a/c/../b#top").when(k == 9, " ").otherwise(F.col("following"))
    status = F.when(k == 11, 200).when(k == 12, 404).when(k == 10, 304).otherwise(302)
    hops = pages.join(following, "id", "left").select("url", status.alias("status"), to.alias("location"))
    # a link given twice is one link, and nothing behind a private address is asked
    more = spark.createDataFrame([("http://10.0.0.1/x", 301, "http://never.example/")], "url string, status int, location string")
    return state.redirect_chain(pages, hops.unionByName(hops).unionByName(more))


@query(f"""WITH RECURSIVE p AS {_PAGES}, r AS (SELECT a.url, CASE WHEN a.id % 11 < 9 THEN 301 WHEN a.id % 11 = 9 THEN 200 ELSE 404 END AS status, b.url AS location FROM p a LEFT JOIN p b ON b.id = a.id + 1),
w AS (SELECT url, url AS final, 0 AS hops FROM r UNION ALL SELECT w.url, r.location, w.hops + 1 FROM w JOIN r ON r.url = w.final AND r.status BETWEEN 300 AND 399 AND r.location IS NOT NULL WHERE w.hops < 5)
SELECT url, arg_max(final, hops) AS final, max(hops) AS hops FROM w GROUP BY url""")
def redirect_chain_pages(spark, sf_dir):
    """Redirects over all pages: a page sends to the next by id, by rule of its id; runs are longer than the hops allowed."""
    pages = read(spark, sf_dir, "pages").where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("id"))
    following = pages.select((F.col("id") - 1).alias("id"), F.col("url").alias("location"))
    status = F.when(F.col("id") % 11 < 9, 301).when(F.col("id") % 11 == 9, 200).otherwise(404)
    hops = pages.join(following, "id", "left").select("url", status.alias("status"), "location")
    return state.redirect_chain(hops, hops).drop("status")


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, unnest({_WORDS}) AS w FROM conversations), tf AS (SELECT conv_id, turn, w, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), n AS (SELECT count(*) AS n FROM conversations)
SELECT conv_id, turn, w, round(score, 5) AS score FROM (SELECT conv_id, turn, tf.w AS w, tf * (ln((1 + n) / (1 + df)) + 1) AS score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(tf * (ln((1 + n) / (1 + df)) + 1), 9) DESC, tf.w) AS p FROM tf JOIN df ON tf.w = df.w, n) WHERE p <= 3""")
def tfidf_topk(spark, sf_dir):
    """Top three words of each turn by sublinear tf and smoothed idf: a report."""
    turns = read(spark, sf_dir, "conversations")
    words = turns.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.TOKEN), F.lit(0))).alias("w"))
    tf = words.groupBy("conv_id", "turn", "w").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(turns.count())
    score = F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)
    ranked = tf.join(df, "w").withColumn("score", score).withColumn("p", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc(F.round("score", 9)), "w")))
    return ranked.where("p <= 3").select("conv_id", "turn", "w", F.round("score", 5).alias("score"))


@query(f"SELECT lang, verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT lang, score, CASE WHEN score >= 70 THEN 'scam' WHEN score >= 35 THEN 'suspicious' ELSE 'safe' END AS verdict FROM {_FLAGGED}) GROUP BY lang, verdict")
def verdicts_by_lang(spark, sf_dir):
    """The flagship: signs, saturating score, verdict bands and their counts by language."""
    docs = read(spark, sf_dir, "documents").select("lang", rules.saturating(F.array(*_signs(F.col("text")).values())).alias("score"))
    return docs.groupBy("lang", scoring.verdict(F.col("score")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
