"""Readers and writers: datasets in CSV and TSV, message tables, key/value stores, lookups that stand in for services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.urls import public_address

#: The unified dataset schema; everything is read as text, as files of unknown quality are.
DATASET = "text_id string, text string, label string, scam_type string, language string, label_source string, source string, dataset string, is_indian string, group_id string, parent_id string, split string, date_collected string, notes string"
COLUMNS = [c.split()[0] for c in DATASET.split(", ")]
LABELS = ["scam", "genuine", "promo_spam", "uncertain"]
TYPES = ["upi_receive_money", "qr_code", "sent_by_mistake", "phishing_link", "task_job", "fake_customer_care", "generic"]


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, quoted line breaks, and a byte-order mark or none before the first name."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    df = (reader.schema(schema).option("enforceSchema", True) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8, or Windows-1252 where the bytes are not UTF-8: a look at the raw bytes decides."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    broken = raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count()
    if not broken:
        return read_csv(spark, path)
    # Spark reads Latin-1, which differs from Windows-1252 in 0x80 to 0x9F alone
    codes = [(chr(b), bytes([b]).decode("cp1252", "replace")) for b in range(0x80, 0xA0)]
    df = read_csv(spark, path, encoding="ISO-8859-1")
    return df.select(*[F.translate(c, "".join(a for a, _ in codes), "".join(b for _, b in codes)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in order; booleans as true and false, null as nothing."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """'label<TAB>text' lines: bad bytes replaced, lines without text dropped."""
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("value"))
    parts = F.split("value", "\t", 2)
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("label"), F.trim(F.get(parts, F.lit(1))).alias("text")).where("text IS NOT NULL AND text != ''")


def unified(rows: DataFrame, **fixed: str) -> DataFrame:
    """Any table with a text in the unified schema: given columns, fixed values, and defaults for the rest."""
    made = {c: F.col(c).cast("string") if c in rows.columns else F.lit(fixed.get(c)).cast("string") for c in COLUMNS}
    normal = X.normalize_for_hash(F.col("text"))
    made["text_id"] = F.coalesce(made["text_id"], X.text_id(normal))
    made["language"] = F.coalesce(made["language"], X.guess_language(F.col("text")))
    return rows.select(*[c.alias(n) for n, c in made.items()])


def mapped_labels(rows: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Labels by a map of lower-cased names; rows with other labels go."""
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn("label", F.try_element_at(table, F.lower(F.trim(F.col(column))))).where("label IS NOT NULL")


def load_mendeley(spark: SparkSession, path: str) -> DataFrame:
    df = read_any_encoding(spark, path)
    df = df.toDF(*[c.lower() for c in df.columns])
    return unified(mapped_labels(df, "label", {"ham": "genuine", "spam": "promo_spam", "smishing": "scam"}), dataset="mendeley", label_source="dataset")


def load_reports(spark: SparkSession, path: str, languages: tuple[str, ...] = ("en", "hi"), least: int = 15) -> DataFrame:
    """Reported messages: by language, placeholders made neutral, short ones dropped, the country as a flag."""
    df = read_csv(spark, path)
    kept = df.where(F.lower("language").isin(*languages)).withColumn("text", X.neutral_placeholders(F.col("text"))).where(F.length("text") >= least)
    return unified(kept.withColumn("is_indian", (F.lower("country") == "india").cast("string")).withColumn("label", F.lit("scam")), dataset="reports", label_source="dataset")


def label_problem(label: Column, kind: Column, text: Column) -> Column:
    """Why a row can't be used, null if it can."""
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty text")
        .when(label.isNull() | ~label.isin(LABELS), "unknown label")
        .when((label == "scam") & (kind.isNull() | ~kind.isin(TYPES)), "scam without a known type")
        .when((label != "scam") & F.coalesce(kind != "", F.lit(False)), "type on a row that is no scam")
    )


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reason)."""
    marked = rows.withColumn("reason", label_problem(F.col("label"), F.col("scam_type"), F.col("text")))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def as_bool(column: Column) -> Column:
    return F.lower(F.trim(column)).isin("1", "true", "yes", "y")


# Fixed: sections that a document on a scam has, and the category of genuine ones.
SECTIONS = ["How it works", "Red flags", "Example messages", "What to do", "Where to report"]
GENUINE = "genuine"

# A line of flat YAML: blank or a comment, a pair with a plain or quoted value, an item of a list, or something else.
_BLANK = r"^\s*(?:#.*)?$"
_KEY = r"^([A-Za-z_][A-Za-z0-9_-]*)\s*:"
_PLAIN = r"(?![\"'\[\]{}&*!|>%@`,#-])(?:(?!:\s|\s#).)*"
_PAIR = _KEY + r"(?:\s*|\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|" + _PLAIN + r"))(?:\s+#.*)?$"
_ITEM = r"^\s*-(?:\s|$)"


def front_matter(value: Column) -> Column:
    """struct(bare, reason, meta map<string,string>, content) of a document with a front matter of flat pairs; the reason is of the form alone."""
    text = F.regexp_replace(F.regexp_replace(value, "^\ufeff", ""), "\r\n", "\n")
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    bare = ~text.rlike(r"(?s)\A---\n.*?\n---\n")
    told = F.filter(F.split(front, "\n"), lambda x: ~x.rlike(_BLANK))
    pairs, others = F.filter(told, lambda x: x.rlike(_PAIR)), F.filter(told, lambda x: ~x.rlike(_PAIR))
    raw = lambda x: F.regexp_replace(F.regexp_replace(x, _KEY + r"\s*", ""), r"(?<![\"'])\s+#.*$|(?<=[\"'])\s+#[^\"']*$", "")
    double = lambda v: F.replace(F.replace(F.regexp_replace(v, r'^\"(.*)\"\s*$', "$1"), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = lambda v: F.replace(F.regexp_replace(v, r"^'(.*)'\s*$", "$1"), F.lit("''"), F.lit("'"))
    value_of = lambda x: F.when(raw(x).startswith('"'), double(raw(x))).when(raw(x).startswith("'"), single(raw(x))).otherwise(F.trim(raw(x)))
    keys = F.transform(pairs, lambda x: F.regexp_extract(x, _KEY, 1))
    # of a key given twice the last value holds
    unique = F.array_distinct(keys)
    last = F.transform(unique, lambda k: value_of(F.element_at(F.filter(pairs, lambda x: F.regexp_extract(x, _KEY, 1) == k), -1)))
    reason = (
        F.when(bare, "no front matter")
        .when((F.size(pairs) == 0) & (F.forall(others, lambda x: x.rlike(_ITEM)) | ((F.size(others) == 1) & ~F.get(others, F.lit(0)).rlike(r"[\"'\[\]{}:\t]"))), "the front matter is no mapping")
        .when(F.size(others) > 0, F.concat(F.lit("invalid YAML: "), F.get(others, F.lit(0))))
    )
    content = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", ""), r"^\s+|\s+$", "")
    return F.struct(bare.alias("bare"), reason.alias("reason"), F.map_from_arrays(unique, last).alias("meta"), content.alias("content"))


def patterns(docs: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """docs(name, value) -> name, slug, title, category, kind, source_url, needs_source_check, content, sections, content_hash, reason: why a document can't be used."""
    from ..operators.rules import kept_apart

    form = docs.select(F.col(name).alias("name"), kept_apart(front_matter(F.col(value))).alias("f"))
    get = lambda k: F.nullif(F.trim(F.try_element_at(F.col("f.meta"), F.lit(k))), F.lit(""))
    df = form.select("name", F.col("f.reason").alias("form"), *[get(k).alias(k) for k in ("slug", "title", "category", "kind", "source_url", "needs_source_check")], F.col("f.content").alias("content"))
    df = df.withColumn("sections", F.regexp_extract_all("content", F.lit(r"(?m)^## +(.+?)[ \t]*$"), F.lit(1)))
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("slug", "title", "category", "kind")]))
    lacking = F.array_except(F.array(*map(F.lit, SECTIONS)), "sections")
    known = [t for t in TYPES if t != "generic"]
    reason = (
        F.when(F.col("form").isNotNull(), F.col("form"))
        .when(F.size(absent) > 0, F.concat(F.lit("missing keys: "), F.array_join(absent, ", ")))
        .when(F.col("slug") != F.col("name"), F.concat(F.lit("slug "), F.col("slug"), F.lit(" is not the name "), F.col("name")))
        .when(~F.col("kind").isin("scam", "genuine"), "unknown kind")
        .when((F.col("kind") == "scam") & ~F.col("category").isin(known), F.concat(F.lit("not a type of scam: "), F.col("category")))
        .when((F.col("kind") == "genuine") & (F.col("category") != GENUINE), "a genuine document of another category")
        .when((F.col("kind") == "scam") & (F.size(lacking) > 0), F.concat(F.lit("missing sections: "), F.array_join(lacking, ", ")))
        .when(F.col("content") == "", "no content")
    )
    checked = F.coalesce(~F.lower("needs_source_check").isin("false", "no", "off"), F.lit(True))
    return df.select("name", F.coalesce("slug", "name").alias("slug"), "title", "category", "kind", "source_url", checked.alias("needs_source_check"), "content", "sections", F.sha2(F.concat_ws("\n\n", "title", "content"), 256).alias("content_hash"), reason.alias("reason"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """``patterns`` of the Markdown files of a folder, by their names."""
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("name"))
    return patterns(raw)


def read_network(spark: SparkSession, path: str, today: str) -> tuple[DataFrame, DataFrame]:
    """A JSON file that stands in for the network -> domains(domain, registered date), redirects(url, status, location).

    A domain has an age in days before ``today``, a date, or rdap false, which is no record; a redirect is a link, or the status that the address answers itself.  Addresses
    have no scheme, and are given both.
    """
    doc = spark.read.option("multiLine", True).schema("domains map<string,struct<age_days:int,registered:string,rdap:boolean>>, redirects map<string,string>").json(path)
    each = doc.select(F.explode("domains").alias("domain", "d"))
    domains = each.where(F.coalesce("d.rdap", F.lit(True))).select(F.lower("domain").alias("domain"), F.coalesce(F.date_sub(F.lit(today).cast("date"), F.col("d.age_days")), F.to_date("d.registered")).alias("registered")).where("registered IS NOT NULL")
    status = F.col("to").try_cast("int")
    hops = doc.select(F.explode("redirects").alias("address", "to")).select("address", F.coalesce(status, F.lit(301)).alias("status"), F.when(status.isNull(), F.col("to")).alias("location"))
    urls = F.explode(F.array(*[F.concat(F.lit(f"{s}://"), F.col("address")) for s in ("http", "https")]))
    return domains, hops.select(urls.alias("url"), "status", "location")


def registration_date(answers: Column) -> Column:
    """The date of the registration event in a domain registry's JSON answer."""
    parsed = F.from_json(answers, "events array<struct<eventAction:string,eventDate:string>>")
    return F.to_date(F.get(F.filter(parsed["events"], lambda e: F.lower(e["eventAction"]) == "registration"), F.lit(0))["eventDate"])


def age_bucket(registered: Column, today: Column) -> Column:
    age = F.datediff(today, registered)
    return F.when(age < 30, "new").when(age < 180, "young").when(age >= 365, "old").otherwise("settled")


def is_public_ip(ip: Column) -> Column:
    """Whether a text is a dotted address and none of the private, loopback, link-local, shared, multicast or reserved ones."""
    return F.coalesce(public_address(ip), F.lit(False))


def qr_payload_kind(payload: Column) -> Column:
    return F.when(F.lower(payload).startswith("upi://"), "upi").when(F.lower(payload).rlike("^https?://"), "url").otherwise("text")


def reading_order(boxes: DataFrame, id_column: str = "image_id") -> DataFrame:
    """(image, text) from recognised boxes (x, y, height, text): rows by vertical overlap, top to bottom, boxes left to right.

    The assignment to rows is sequential, so it runs for each image; an image has some dozens of boxes.
    """

    def run(pdf):  # noqa: ANN001, ANN202
        lines: list[list] = []
        for b in pdf.sort_values(["y", "x"]).itertuples():
            if lines and abs((b.y + b.height / 2) - (lines[-1][0].y + lines[-1][0].height / 2)) < lines[-1][0].height / 2:
                lines[-1].append(b)
            else:
                lines.append([b])
        text = "\n".join(" ".join(b.text for b in sorted(line, key=lambda b: b.x)) for line in lines)
        return pdf.head(1)[[id_column]].assign(text=text)

    return boxes.groupBy(id_column).applyInPandas(run, f"{id_column} {boxes.schema[id_column].dataType.simpleString()}, text string")


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table at the path doesn't have; the number of rows appended."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        rows = rows.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.dropDuplicates([key]).persist()
    n = rows.count()
    rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def auto_label(scored: DataFrame, text: str = "text") -> DataFrame:
    """A label from rules and payment checks alone, never from the classifier, so labels don't turn circular."""
    promo = F.lower(F.col(text)).rlike(r"\b(offer|sale|discount|% off|recharge pack|unsubscribe|t&c)\b")
    strong = F.exists("hits", lambda h: ~h["supporting"] & ~h["rule_id"].isin("throwaway_domain", "short_url", "filter_evasion"))
    soft = [F.exists("hits", lambda h: h["rule_id"] == "throwaway_domain"), F.exists("hits", lambda h: h["rule_id"] == "filter_evasion")]
    label = (
        F.when(strong & ~promo, "scam")
        .when(strong, F.when(F.col("verdict") == "scam", "scam").otherwise("uncertain"))
        .when(soft[0] & soft[1], F.when(promo, "uncertain").otherwise("scam"))
        .when(soft[0] | soft[1], "uncertain")
        .when(promo, "promo_spam")
        .otherwise("uncertain")
    )
    return scored.withColumn("label", label).withColumn("label_source", F.lit("auto"))


def with_reviews(rows: DataFrame, reviews: DataFrame, key: str = "text_id") -> DataFrame:
    """rows with the reviewed label where there is one; of several reviews the best authority, then the last.

    A label of better authority than the review's stays: what somebody labelled by hand is never replaced by an assisted review.
    """
    from ..operators.similarity import authority

    best = reviews.withColumn("__rank", authority()).groupBy(key).agg(F.max_by(F.struct(F.col("label").alias("l"), F.col("label_source").alias("s"), F.col("__rank").alias("rank")), F.struct(-F.col("__rank"), F.col("reviewed_at"))).alias("r"))
    joined = rows.join(best, key, "left")
    holds = F.col("r").isNotNull() & (F.col("r.rank") <= authority())
    return joined.withColumns({"label": F.when(holds, F.col("r.l")).otherwise(F.col("label")), "label_source": F.when(holds, F.col("r.s")).otherwise(F.col("label_source"))}).drop("r")
