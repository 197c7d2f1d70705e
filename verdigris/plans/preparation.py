"""Registered queries over the preparation of datasets: frozen test splits, journals, replies, loaders; they join the catalogue's."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import text as X
from ..functions.udf import spread
from ..operators import classifier, frozen, lookup, metrics, replies, splits
from ..sources import records, tables
from ..sources.journal import Journal, resumed, shared_dir, written
from ..streaming import caches
from .catalogue import _ID, _TOKENS, _u, identified, query, read

_ROWS = f"""d AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, d.source, d.lang, l.toxic, l.doc_id IS NOT NULL AND d.doc_id % 3 <> 2 AS reviewed, {_ID} AS grp, {_TOKENS} AS tokens
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_DRAWN = """e AS (SELECT *, count(*) OVER (PARTITION BY toxic, lang) AS n, row_number() OVER (PARTITION BY toxic, lang ORDER BY sha256('test:first:' || id), id) AS p FROM d WHERE reviewed AND source NOT IN ('src1', 'src3')),
t AS (SELECT id FROM e WHERE n >= 3 AND p <= greatest(1, round_even(n * 0.2, 0)))"""


def _dataset(spark, sf_dir):
    """documents as rows of a dataset: reviewed by two labellers where they have labels, src2 as collected, src3 as made up from the document before."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = identified(spark, sf_dir).withColumnRenamed("text_id", "group_id").join(labels.withColumn("labelled", F.lit(True)), "doc_id", "left")
    source = F.when(F.col("labelled"), F.when(F.col("doc_id") % 3 == 0, "manual").when(F.col("doc_id") % 3 == 1, "assisted"))
    return rows.select(
        F.col("doc_id").cast("string").alias("text_id"), "doc_id", "group_id", "label", F.col("lang").alias("scam_type"), "source", "text",
        F.coalesce(source, F.lit("auto")).alias("label_source"), (F.col("source") == "src3").alias("is_synthetic"), F.when(F.col("source") == "src2", "collected").otherwise("public").alias("dataset"),
        F.when(F.col("source") == "src3", (F.col("doc_id") - 1).cast("string")).alias("parent_id"),
    )


def _frozen(spark, rows):
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    frozen.freeze(rows.where("source <> 'src1'"), path, "first")
    return frozen.freeze(rows, path, "second")  # the table has grown; the manifest stands


def _split(spark, sf_dir):
    """The rows are written with ids and tokens made once: splits are read from them many times."""
    rows = written(_dataset(spark, sf_dir).withColumn("tokens", X.tokens(F.lower("text"))).drop("text"), "dataset")
    again = _frozen(spark, rows)
    real, made_up = rows.where("NOT is_synthetic"), rows.where("is_synthetic")
    return frozen.placed(real, made_up, again.ids, F.col("tokens")), again


_PLACED = f"""WITH {_ROWS}, {_DRAWN}, g AS (SELECT DISTINCT grp FROM d WHERE source = 'src2' OR id IN (SELECT id FROM t)),
r AS (SELECT *, CASE WHEN id IN (SELECT id FROM t) THEN 'test' WHEN grp IN (SELECT grp FROM g) THEN 'heldout' WHEN u < 0.15 THEN 'heldout' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split FROM (SELECT *, {_u('grp', 'split')} AS u FROM d WHERE source <> 'src3')),
m AS (SELECT s.doc_id, s.tokens, p.grp FROM d s LEFT JOIN (SELECT doc_id, grp FROM r WHERE split = 'train') p ON p.doc_id = s.doc_id - 1 WHERE s.source = 'src3'),
k AS (SELECT DISTINCT m.doc_id FROM m, r WHERE m.grp IS NOT NULL AND r.split <> 'train' AND len(m.tokens) > 0 AND len(r.tokens) > 0 AND len(list_intersect(m.tokens, r.tokens)) >= 0.7 * (len(m.tokens) + len(r.tokens) - len(list_intersect(m.tokens, r.tokens)))),
o AS (SELECT doc_id, split, grp AS group_id, NULL AS dropped FROM r UNION ALL SELECT doc_id, CASE WHEN grp IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM k) THEN 'train' END, coalesce(grp, CAST(doc_id AS VARCHAR)), CASE WHEN grp IS NULL THEN 'parent' WHEN doc_id IN (SELECT doc_id FROM k) THEN 'leak' END FROM m)"""


@query(f"{_PLACED} SELECT doc_id, split, group_id, dropped FROM o")
def frozen_split(spark, sf_dir):
    """Splits around a test set drawn from a smaller table; made-up rows join train or go."""
    return _split(spark, sf_dir)[0].select("doc_id", "split", "group_id", "dropped")


@query(f"""{_PLACED}, x AS (SELECT o.*, d.source, CASE WHEN d.reviewed THEN CASE WHEN d.doc_id % 3 = 0 THEN 'manual' ELSE 'assisted' END ELSE 'auto' END AS labeller FROM o JOIN d USING (doc_id))
SELECT 'frozen' AS note, (SELECT count(*) FROM t) AS n UNION ALL SELECT 'split:' || split, count(*) FROM x WHERE split IS NOT NULL GROUP BY 1 UNION ALL SELECT 'dropped:' || dropped, count(*) FROM x WHERE dropped IS NOT NULL GROUP BY 1
UNION ALL SELECT 'test labels:' || labeller, count(*) FROM x WHERE split = 'test' GROUP BY 1 UNION ALL SELECT CASE source WHEN 'src2' THEN 'collected held out' ELSE 'held out or near the test' END, count(*) FROM x WHERE split = 'heldout' GROUP BY 1
UNION ALL SELECT 'groups', count(DISTINCT group_id) FROM x WHERE dropped IS NULL""")
def frozen_notes(spark, sf_dir):
    """What a report on the splits says."""
    rows, state = _split(spark, sf_dir)
    return frozen.notes(rows, state)


@query(f"""WITH {_ROWS}, {_DRAWN}, s AS (SELECT DISTINCT sha256(id) AS h FROM t), b AS (SELECT substr(h, 1, 3) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM s GROUP BY 1)
SELECT 1 AS version, 'first' AS created, substr(sha256(string_agg(h, chr(10) ORDER BY k)), 1, 16) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM b""")
def split_manifest(spark, sf_dir):
    """The manifest's only version after two runs, and the fingerprint of its ids."""
    entry = _frozen(spark, _dataset(spark, sf_dir)).entry
    ids = spark.createDataFrame([(entry["version"], entry["created"])], "version int, created string")
    return ids.withColumns({"fingerprint": F.lit(entry["fingerprint"]), "n": F.lit(entry["n"]).cast("long")})


@query(f"WITH d AS (SELECT doc_id, {_ID} AS text_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS r, lang || doc_id % 3 AS label FROM documents) SELECT text_id, list_sort(list(DISTINCT label)) AS labels FROM d WHERE r = (SELECT min(r) FROM d e WHERE e.text_id = d.text_id) GROUP BY text_id HAVING count(DISTINCT label) > 1")
def label_conflicts(spark, sf_dir):
    """Copies whose best labellers disagree."""
    source = F.when(F.col("doc_id") % 4 == 0, "manual").when(F.col("doc_id") % 4 == 1, "assisted").when(F.col("doc_id") % 4 == 2, "auto").otherwise("dataset")
    rows = identified(spark, sf_dir).select("text_id", F.concat("lang", (F.col("doc_id") % 3).cast("string")).alias("label"), source.alias("label_source"))
    return frozen.conflicts(rows)


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def resumable_copy(spark, sf_dir):
    """Orders copied batch by batch: the first run stops after one batch, the second goes on from the log."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    journal = Journal(spark, f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}")
    size = orders.count() // 3 + 1
    cut = orders.select("o_orderkey").orderBy("o_orderkey").limit(size).agg(F.max("o_orderkey")).first()[0]
    resumed(journal, orders.where(F.col("o_orderkey") <= F.lit(cut)), "o_orderkey", lambda rows: rows, size)
    resumed(journal, orders, "o_orderkey", lambda rows: rows, size)
    return journal.rows()


_HI = "यह संदेश आपसे पैसे माँगता है"


@query(f"""WITH t AS (SELECT conv_id, turn, text, (length(text) * 7 + turn) % 130 AS risk, len(string_split_regex(trim(text), '\\s+')) AS words, CAST(turn % 7 AS INTEGER) AS items, conv_id % 5 AS k FROM conversations WHERE role = 'assistant'),
e AS (SELECT *, list_filter([CASE WHEN k = 1 THEN 'scam_type' END, CASE WHEN risk > 100 THEN 'llm_risk' END, CASE WHEN words > 90 THEN 'explanation_en' END, CASE WHEN k = 2 THEN 'explanation_hi' END, CASE WHEN items NOT BETWEEN 3 AND 5 THEN 'advice' END, CASE WHEN k = 3 THEN 'confidence' END], lambda x: x IS NOT NULL) AS wrong FROM t)
SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'not JSON' WHEN len(wrong) > 0 THEN 'schema errors in ' || array_to_string(wrong, ', ') END AS reason, CASE WHEN conv_id % 11 <> 0 AND len(wrong) = 0 THEN CAST(risk AS INTEGER) END AS risk FROM e""")
def reply_schema(spark, sf_dir):
    """Replies made of all assistant turns, well and badly formed by rule of their ids: parsed, checked, refused with a reason."""
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    k = F.col("conv_id") % 5
    advice = F.transform(F.slice(F.array(*[F.lit(i) for i in range(1, 8)]), F.lit(1), (F.col("turn") % 7).cast("int")), lambda i: F.concat(F.lit("step "), i.cast("string")))
    made = F.struct(
        F.when(k == 1, "riddle").otherwise(" QR_code ").alias("scam_type"), ((F.length("text") * 7 + F.col("turn")) % 130).alias("llm_risk"), F.col("text").alias("explanation_en"),
        F.when(k == 2, "hello").otherwise(_HI).alias("explanation_hi"), advice.alias("advice"), F.when(k == 3, "sure").otherwise("High").alias("confidence"), F.lit(1).alias("more"),
    )
    reply = F.when(F.col("conv_id") % 11 == 0, F.concat(F.to_json(made), F.lit("}"))).otherwise(F.to_json(made))
    found = replies.parsed(turns.select("conv_id", "turn", reply.alias("reply")), "reply", "a")
    return found.select("conv_id", "turn", F.col("a.reason").alias("reason"), F.col("a.llm_risk").alias("risk"))


_KEYS = "list_distinct(list_concat(list_transform(regexp_extract_all(lower(text), '[a-z0-9._-]+@[a-z0-9.-]+[a-z0-9]'), lambda x: 'email ' || x), list_transform(regexp_extract_all(lower(text), '[0-9]{1,3}(?:\\.[0-9]{1,3}){3}'), lambda x: 'address ' || x)))"


@query(f"""WITH d AS (SELECT doc_id, {_KEYS} AS keys FROM documents), p AS (SELECT doc_id, keys, lag(keys, 1, []) OVER (ORDER BY doc_id) AS before FROM d)
SELECT doc_id, list_sort(list_filter(keys, lambda k: NOT list_contains(before, k))) AS unknown FROM p WHERE len(list_filter(keys, lambda k: NOT list_contains(before, k))) > 0""")
def unknown_identifiers(spark, sf_dir):
    """Documents as replies to the one before: identifiers by kind that the predecessor has not.

    Predecessors meet by a join on ids in order, not in one window: ranges of ids, numbered inside, with the range's last row handed on.
    """
    text = F.lower("text")
    kind = lambda name, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(name).alias("kind"), x.alias("value")))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.concat(kind("email", r"[a-z0-9._-]+@[a-z0-9.-]+[a-z0-9]"), kind("address", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"))).alias("keys"))
    joined = X.with_previous(docs, "doc_id", ["keys"])
    left = replies.unknown(F.col("keys"), F.coalesce("previous_keys", F.array().cast(docs.schema["keys"].dataType)))
    return joined.select("doc_id", F.sort_array(F.transform(left, lambda k: F.concat_ws(" ", k["kind"], k["value"]))).alias("unknown")).where(F.size("unknown") > 0)


@query("""WITH e AS (SELECT user_id || '/' || event_type AS key, ts, CAST(event_id AS VARCHAR) AS value FROM events),
p AS (SELECT *, lag(value) OVER w AS before, lag(ts) OVER w AS was FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, value))
SELECT key, ts, coalesce(ts < was + INTERVAL 24 HOURS, false) AS hit, CASE WHEN ts < was + INTERVAL 24 HOURS THEN before END AS value FROM p""")
def cache_read_through(spark, sf_dir):
    """Every event reads its key's last value, up to 24 hours old, and writes its own: a cache that has room for all."""
    events = read(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").cast("string").alias("value"))
    return caches.cached(events, shards=16, most=caches.ROOM_FOR_ALL, ttl=caches.LINK_TTL, read_through=True).select("key", "ts", "hit", "value")


def _grid(spark, sf_dir):
    """Quality from words, weighted by group, class and a language that counts for more; validated on a hashed fifth."""
    rows = spread(identified(spark, sf_dir), "doc_id").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"), F.col("text_id").alias("group_id"), (F.col("lang") == "en").alias("is_indian"), F.when(splits.unit_hash(F.col("text_id"), "grid") < 0.2, "val").otherwise("train").alias("part"))
    weighted = splits.sample_weights(rows.where("part = 'train'")).unionByName(rows.where("part = 'val'").withColumn("weight", F.lit(1.0)))
    return classifier.selected(weighted, "doc_id", "part", grid=(0.25, 1.0, 4.0), weight="weight", most={"word": 20_000}, iterations=20)


@query()
def classifier_grid(spark, sf_dir):
    """Each penalty that was tried with its macro-F1 on rows kept back, and the one chosen."""
    tried = _grid(spark, sf_dir)[1]
    best = max(tried, key=lambda t: (t[1], -t[0]))[0]
    return spark.createDataFrame([(c, round(s, 6), c == best) for c, s in tried], "c double, macro_f1 double, chosen boolean")


def _csv(spark, sf_dir):
    """documents as CSV files, whole texts with their line breaks; labels by rule of the ids, some of them wrong."""
    docs = read(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 9 == 4, "odd").when(F.col("doc_id") % 2 == 0, "Scam").otherwise("genuine")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    kind = F.when(F.col("doc_id") % 6 == 0, "qr_code").when(F.col("doc_id") % 5 == 0, "task_job").otherwise("")
    # the reader takes a return for a line's end, whatever it is to a writer
    text = F.regexp_replace("text", "\\r\\n?", "\n")
    tables.write_csv(docs.select("doc_id", text.alias("text"), label.alias("label"), kind.alias("scam_type")), path, ["doc_id", "text", "label", "scam_type"])
    return path


_CSV = """d AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text, CASE WHEN doc_id % 9 = 4 THEN 'odd' WHEN doc_id % 2 = 0 THEN 'scam' ELSE 'genuine' END AS label, CASE WHEN doc_id % 6 = 0 THEN 'qr_code' WHEN doc_id % 5 = 0 THEN 'task_job' ELSE '' END AS kind FROM documents)"""


@query(f"WITH {_CSV} SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS digest, label FROM d")
def csv_records(spark, sf_dir):
    """Documents written as CSV and read back record by record, in parallel over quoted line breaks."""
    found = records.records(spark, _csv(spark, sf_dir))
    return found.select(records.field("doc_id").alias("doc_id"), F.sha2(records.field("text").cast("binary"), 256).alias("digest"), F.lower(records.field("label")).alias("label"))


@query(f"""WITH {_CSV}, p AS (SELECT CASE WHEN trim(text, ' ') = '' THEN 'empty text' WHEN label = 'odd' THEN 'unknown label' WHEN label = 'scam' AND kind = '' THEN 'scam without a known type' WHEN label <> 'scam' AND kind <> '' THEN 'type on a row that is no scam' END AS problem FROM d)
SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM p GROUP BY 1""")
def collected_problems(spark, sf_dir):
    """What a loader of collected messages accepts and why it refuses the rest."""
    rows, problems = records.collected(spark, _csv(spark, sf_dir))
    return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).unionByName(rows.agg(F.lit("none").alias("problem"), F.count(F.lit(1)).alias("n")).where("n > 0"))


@query("""WITH d AS (SELECT doc_id, doc_id % 10 AS k, source = 'src2' AS calm FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN 'no front matter' WHEN k = 1 THEN 'the front matter is no mapping' WHEN k = 2 THEN 'invalid YAML: note: "open' WHEN k = 3 THEN 'missing keys: title' WHEN k = 4 THEN 'slug other is not the name doc-' || doc_id
WHEN k = 5 THEN 'unknown kind' WHEN k = 6 AND NOT calm THEN 'not a type of scam: riddle' WHEN calm AND k <> 7 THEN 'a genuine document of another category' WHEN NOT calm AND k = 8 THEN 'missing sections: What to do, Where to report' END AS reason FROM d""")
def front_matter_checks(spark, sf_dir):
    """Documents as Markdown with a front matter, ten ways of being wrong by rule of their ids."""
    docs = read(spark, sf_dir, "documents")
    k, calm = F.col("doc_id") % 10, F.col("source") == "src2"
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\n"))
    category = F.when(calm & (k == 7), "genuine").when(k == 6, "riddle").otherwise("qr_code")
    front = F.when(k == 1, F.lit("- one\n- two\n")).otherwise(F.concat(
        line("slug", F.when(k == 4, F.lit("other")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))), F.when(k == 3, F.lit("")).otherwise(F.lit("title: 'It''s a document'  # said\n")),
        line("category", category), line("kind", F.when(k == 5, "odd").when(calm, "genuine").otherwise("scam")), F.when(k == 2, F.lit('note: "open\n')).otherwise(F.lit("note: \"closed: 'so'\"\n")),
    ))
    named = [F.lit(f"## {s}\nwords\n") for s in tables.SECTIONS]
    body = F.concat(*named[:3], F.when(k == 8, F.lit("")).otherwise(F.concat(*named[3:])), "text")
    value = F.when(k == 0, body).otherwise(F.concat(F.lit("---\n"), front, F.lit("---\n"), body))
    found = tables.patterns(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), value.alias("value")))
    return found.select(F.substring_index("name", "-", -1).cast("long").alias("doc_id"), "reason")


_READ = "CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'c') WHEN 2 THEN substr(text, 3) ELSE text || ' ' || reverse(text) END"


@query(f"""SELECT item_id % 3 AS font, count(*) AS n, CAST(sum(levenshtein(text, r)) AS BIGINT) AS edits, CAST(sum(length(text)) AS BIGINT) AS characters, round(sum(levenshtein(text, r)) / sum(length(text)), 9) AS error_rate,
round(avg(levenshtein(text, r) / length(text)), 9) AS mean_rate, round(avg(CAST(text = r AS INTEGER)), 9) AS exact FROM (SELECT item_id, text, {_READ} AS r FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM benchmark)) GROUP BY 1""")
def reading_errors(spark, sf_dir):
    """Character error rates of benchmark texts that were read with errors by rule of their ids."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("text")).withColumn("r", F.expr(_READ)).withColumn("font", F.col("item_id") % 3)
    found = metrics.reading(rows, "text", "r", ["font"])
    return found.withColumns({c: F.round(c, 9) for c in ("error_rate", "mean_rate", "exact")})


@query("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+')) AS t FROM documents), p AS (SELECT t, CASE doc_id % 3 WHEN 0 THEN t WHEN 1 THEN list_filter(t, lambda x: length(x) <> 2) ELSE list_append(t, 'x' || doc_id) END AS r FROM d),
k AS (SELECT *, unnest(list_distinct(list_transform(list_concat(t, r), lambda x: CASE WHEN length(x) < 3 THEN 'short' ELSE 'long' END))) AS kind FROM p),
o AS (SELECT kind, list_filter(t, lambda x: (length(x) < 3) = (kind = 'short')) AS t, list_filter(r, lambda x: (length(x) < 3) = (kind = 'short')) AS r FROM k),
c AS (SELECT kind, len(list_intersect(t, r)) AS kept, len(t) - len(list_intersect(t, r)) AS lost, len(r) - len(list_intersect(t, r)) AS invented FROM o)
SELECT kind, count(*) AS n, count(*) FILTER (lost = 0 AND invented = 0) AS equal, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(invented) AS BIGINT) AS invented FROM c GROUP BY kind""")
def reading_identifiers(spark, sf_dir):
    """Numbers of documents, short and long, against a reading that loses some and invents others."""
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    docs = read(spark, sf_dir, "documents").select("doc_id", numbers.alias("t"))
    r = F.when(F.col("doc_id") % 3 == 0, F.col("t")).when(F.col("doc_id") % 3 == 1, F.filter("t", lambda x: F.length(x) != 2)).otherwise(F.concat("t", F.array(F.concat(F.lit("x"), F.col("doc_id").cast("string")))))
    typed = lambda c: F.transform(c, lambda x: F.struct(F.when(F.length(x) < 3, "short").otherwise("long").alias("kind"), x.alias("value")))
    return metrics.identifiers_read(docs.withColumn("r", r).select(typed(F.col("t")).alias("t"), typed(F.col("r")).alias("r")), "t", "r")


@query("SELECT l_orderkey, l_linenumber, o_custkey AS order_o_custkey, o_orderstatus AS order_o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) ON o_orderkey = l_orderkey")
def foreign_key_lookup(spark, sf_dir):
    """Line items with what their order says, some orders being gone: two tables of as many buckets, joined without a shuffle."""
    orders = lookup.keyed(read(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 16)
    items = lookup.keyed(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 16)
    return lookup.referenced(items, "l_orderkey", orders, "o_orderkey", ["o_custkey", "o_orderstatus"], "order_")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = (SELECT max(o_custkey) FROM orders)")
def point_lookup(spark, sf_dir):
    """The customer of one key, which the orders name, by a read of one bucket."""
    key = read(spark, sf_dir, "orders").agg(F.max("o_custkey")).first()[0]
    customers = lookup.keyed(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", 16)
    return lookup.found(customers, "c_custkey", [key])


@query()
def entities_in_sql(spark, sf_dir):
    """Entities of all conversations by the table function, in SQL."""
    E.register(spark)
    read(spark, sf_dir, "conversations").createOrReplaceTempView("__turns")
    return spark.sql("SELECT t.conv_id, t.turn, e.kind, e.value FROM __turns t, LATERAL entities(t.text) e")


@query(f"""WITH h AS (SELECT lang, source FROM (SELECT *, {_u('source || lang || doc_id % 40', 'split')} AS u FROM documents) WHERE u < 0.15 AND doc_id % 7 <> 3), s AS (SELECT unnest(['all', CASE WHEN lang = 'en' THEN 'indian' ELSE 'other' END, 'dataset:' || source]) AS subset FROM h)
SELECT subset, count(*) AS n FROM s GROUP BY subset""")
def heldout_subsets(spark, sf_dir):
    """Held-out rows by subset, without those whose label is uncertain."""
    docs = read(spark, sf_dir, "documents").withColumn("label", F.when(F.col("doc_id") % 7 == 3, "uncertain").otherwise("genuine"))
    group = F.concat("source", "lang", (F.col("doc_id") % 40).cast("string"))
    rows = splits.certain(docs).select(splits.bucket(group).alias("split"), (F.col("lang") == "en").alias("is_indian"), F.col("source").alias("dataset"))
    return splits.held_out_subsets(rows).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))
