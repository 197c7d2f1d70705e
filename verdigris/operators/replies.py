"""A language model's reply as a column: parsed and checked against a schema with the reason of a refusal, guarded against changed or invented identifiers, and turned into an outcome.

No model is called: replies are data.  The parse is a variant, so a wrong type is told from a missing field, and everything but the extraction of entities is an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import entities
from . import rules as R
from . import scoring as S

# Fixed: the values a reply may have, its limits, and a domain that it may always name.
TYPES = ["upi_receive_money", "qr_code", "sent_by_mistake", "phishing_link", "task_job", "fake_customer_care"]
OTHER_TYPES = ["other", "none"]
CONFIDENCES = ["low", "medium", "high"]
EXPLANATION_WORDS, ADVICE_WORDS, LEAST_ADVICE, MOST_ADVICE, LEAST_DEVANAGARI = 90, 30, 3, 5, 10
ALLOWED_DOMAINS = ["cybercrime.gov.in"]
MOST_DISAGREEMENT = 50.0
FIELDS = ["scam_type", "llm_risk", "explanation_en", "explanation_hi", "advice", "cited_flags", "confidence"]

_LETTER = "[ऀ-ॣ॰-ॿ]"
_IDENTIFIER = r"(?i)@|://|www\.|\.[a-z]{2,}(?![a-z0-9_])"
_DIGITS = "[०-९](?:[\\s-]?[०-९]){4,}"


def _kind(v: Column, field: str) -> Column:
    """Type of a field's value; null where there is no such field."""
    return F.schema_of_variant(F.variant_get(v, f"$.{field}", "variant"))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def parsed(rows: DataFrame, reply: str, into: str = "parsed") -> DataFrame:
    """rows with struct(reason, scam_type, llm_risk, explanation_en, explanation_hi, advice, cited_flags, confidence); with a reason all others are null.

    The reason names every field in error, in the order of the schema; further fields are ignored, and a missing list of flags is empty.  The text is parsed once a row: the parse, the
    values and the reason are columns of their own, so that what is built on them doesn't repeat them.
    """
    text = F.col(reply)
    # the parser stops where a value ends; inside an array and an object nothing can follow it
    closed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"r":'), text, F.lit("}"))).isNotNull()
    v = F.col("__v")
    kinds = F.struct(*[_kind(v, n).alias(n) for n in FIELDS])
    root = F.schema_of_variant(v)
    whole = rows.withColumn("__v", R.kept_apart(F.when(closed, F.try_parse_json(text)))).withColumn("__k", R.kept_apart(kinds))
    kind = lambda n: F.col("__k")[n]
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    as_text = lambda n: F.when(kind(n) == "STRING", trimmed(F.variant_get(v, f"$.{n}", "string")))
    as_list = lambda n: F.when(kind(n).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.variant_get(v, f"$.{n}", "array<string>"))
    plain = ~kind("llm_risk").isin("BOOLEAN", "VOID") & ~kind("llm_risk").startswith("ARRAY") & ~kind("llm_risk").startswith("OBJECT")
    read = {
        "scam_type": F.lower(as_text("scam_type")),
        "llm_risk": F.when(plain, F.variant_get(v, "$.llm_risk", "string").try_cast("double")),
        "explanation_en": as_text("explanation_en"),
        "explanation_hi": as_text("explanation_hi"),
        "advice": F.transform(as_list("advice"), trimmed),
        "cited_flags": F.when(kind("cited_flags").isNull(), F.array().cast("array<string>")).otherwise(as_list("cited_flags")),
        "confidence": F.lower(as_text("confidence")),
    }
    whole = whole.withColumn("__read", R.kept_apart(F.struct(*[c.alias(n) for n, c in read.items()])))
    of = lambda n: F.col("__read")[n]
    short = lambda t: _words(t).between(1, EXPLANATION_WORDS)
    good = {
        "scam_type": of("scam_type").isin(TYPES + OTHER_TYPES),
        "llm_risk": of("llm_risk").between(0, 100) & (of("llm_risk") == F.floor(of("llm_risk"))),
        "explanation_en": short(of("explanation_en")),
        "explanation_hi": short(of("explanation_hi")) & (F.regexp_count(of("explanation_hi"), F.lit("[ऀ-ॿ]")) >= LEAST_DEVANAGARI),
        "advice": F.size(of("advice")).between(LEAST_ADVICE, MOST_ADVICE) & F.forall(of("advice"), lambda a: a.isNotNull() & _words(a).between(1, ADVICE_WORDS)),
        "cited_flags": of("cited_flags").isNotNull() & F.forall(of("cited_flags"), lambda c: c.isNotNull()),
        "confidence": of("confidence").isin(CONFIDENCES),
    }
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in good.items()]))
    whole = whole.withColumn("__wrong", R.kept_apart(wrong))
    reason = (
        F.when(text.isNull(), "no reply")
        .when(v.isNull(), "not JSON")
        .when(~F.coalesce(root.startswith("OBJECT"), F.lit(False)), "schema errors in root")
        .when(F.size("__wrong") > 0, F.concat(F.lit("schema errors in "), F.array_join("__wrong", ", ")))
    )
    whole = whole.withColumn("__why", R.kept_apart(reason))
    value = {n: of(n) for n in FIELDS} | {"llm_risk": of("llm_risk").cast("int"), "cited_flags": F.array_distinct(of("cited_flags"))}
    found = F.struct(F.col("__why").alias("reason"), *[F.when(F.col("__why").isNull(), c).alias(n) for n, c in value.items()])
    return whole.withColumn(into, R.kept_apart(found)).drop("__v", "__k", "__read", "__wrong", "__why")


def contacts(e: Column) -> Column:
    """array<struct<kind, value>>: registered domains, numbers and payment ids, those of payment links too, in their normal forms."""
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    payees = F.filter(F.transform(e["upi_uris"], lambda u: F.lower(u["pa"])), lambda p: p.isNotNull())
    return F.array_distinct(
        F.concat(F.transform(e["urls"], lambda u: key("domain", u["registered_domain"])), F.transform(e["phones"], lambda p: key("phone", p["number"])), F.transform(e["upi_ids"], lambda u: key("upi", u["value"])), F.transform(payees, lambda p: key("upi", p)))
    )


def unknown(found: Column, known: Column) -> Column:
    """Keys (kind, value) of ``found`` that ``known`` lacks, in their order; whitelisted domains are known."""
    allowed = F.array(*[F.struct(F.lit("domain").alias("kind"), F.lit(d).alias("value")) for d in ALLOWED_DOMAINS])
    return F.array_except(found, F.concat(known, allowed))


def respelled(text: Column, message: Column) -> Column:
    """Tokens of ``text`` that mix Devanagari letters with a part only identifiers have, and runs of Devanagari digits that the message has not."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t.rlike(_LETTER) & t.rlike(_IDENTIFIER))
    return F.array_distinct(F.concat(tokens, F.filter(F.regexp_extract_all(text, F.lit(_DIGITS), F.lit(0)), lambda d: ~F.contains(message, d))))


def assessed(messages: DataFrame, reply: str = "reply", text: str = "text", entities_column: str = "entities", flags: Column | None = None) -> DataFrame:
    """messages with ``assessment``: the parsed reply, refused with a reason where it changes or invents an identifier; cited flags only of ``flags``."""
    ready = parsed(messages, reply, "__a")
    a = F.col("__a")
    ready = ready.withColumn("__hi", R.kept_apart(entities(a["explanation_hi"]))).withColumn("__en", R.kept_apart(entities(F.concat_ws("\n", a["explanation_en"], F.array_join(a["advice"], "\n")))))
    known, values = contacts(F.col(entities_column)), lambda keys: F.transform(keys, lambda k: k["value"])
    altered = F.array_distinct(F.concat(respelled(a["explanation_hi"], F.col(text)), values(unknown(contacts(F.col("__hi")), known))))
    invented = values(unknown(contacts(F.col("__en")), known))
    reason = F.coalesce(a["reason"], F.when(F.size(altered) > 0, F.concat(F.lit("altered identifiers: "), F.array_join(altered, ", "))), F.when(F.size(invented) > 0, F.concat(F.lit("contact details not in the evidence: "), F.array_join(invented, ", "))))
    out = ready.withColumn("__reason", R.kept_apart(reason))
    cited = lambda n: a[n] if n != "cited_flags" or flags is None else F.array_intersect(a[n], flags)
    refused = F.col("__reason").isNotNull()
    return out.withColumn("assessment", F.struct(F.col("__reason").alias("reason"), *[F.when(~refused, cited(n)).alias(n) for n in FIELDS])).drop("__a", "__hi", "__en", "__reason")


def signal(assessment: Column, manipulated: Column) -> Column:
    """The outcome: its score is null without a usable reply; a message that tries to manipulate a checker makes it count for nothing; it never makes a scam alone."""
    tried = F.coalesce(manipulated, F.lit(False))
    scam_type = F.when(~tried & assessment["scam_type"].isin(TYPES), assessment["scam_type"])
    return S.outcome("llm", assessment["llm_risk"], ~tried, max_disagreement=MOST_DISAGREEMENT, can_decide_scam=False, scam_type=scam_type)


def narrative(assessment: Column, manipulated: Column) -> Column:
    """struct(explanation_en, explanation_hi, advice, confidence) to show, null where there is none or the attempt at manipulation may have worked."""
    fooled = F.coalesce(manipulated, F.lit(False)) & (assessment["llm_risk"] < S.SUSPICIOUS)
    shown = F.struct(*[assessment[n].alias(n) for n in ("explanation_en", "explanation_hi", "advice", "confidence")])
    return F.when(assessment["llm_risk"].isNotNull() & ~fooled, shown)


def manipulated(hits: Column) -> Column:
    return F.exists(hits, lambda h: h["rule_id"] == "ai_manipulation_attempt")
