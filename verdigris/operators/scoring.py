"""Signals, their weighted combination, verdict and explanation.

An outcome has one of three states that stay apart: a null score failed, informative false ran without evidence, informative true counts, with 0 as evidence of safety.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .nearest import pattern_score

OUTCOME = "struct<signal:string,score:double,informative:boolean,floor:int,factor:double,max_disagreement:double,corroborating:boolean,needs_corroboration:boolean,can_decide_scam:boolean,scam_type:string>"
#: Fixed: weights of the signals and limits of the verdict bands.
WEIGHTS = {"rules": 0.30, "classifier": 0.25, "url_intel": 0.15, "upi_check": 0.15, "reputation": 0.10, "pattern_similarity": 0.05, "llm": 0.15, "sender_check": 0.15, "fake_payment_proof": 0.15}
SUSPICIOUS, SCAM, STRONG_RULE = 35, 70, 0.8


def outcome(signal: str, score: Column, informative: Column | bool = True, floor: Column | None = None, factor: Column | float = 1.0, max_disagreement: float | None = None, corroborating: bool = True, needs_corroboration: bool = False, can_decide_scam: bool = True, scam_type: Column | None = None) -> Column:
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = {"signal": F.lit(signal), "score": score.cast("double"), "informative": value(informative), "floor": (floor if floor is not None else F.lit(None)).cast("int"), "factor": value(factor).cast("double"), "max_disagreement": F.lit(max_disagreement).cast("double"), "corroborating": F.lit(corroborating), "needs_corroboration": F.lit(needs_corroboration), "can_decide_scam": F.lit(can_decide_scam), "scam_type": (scam_type if scam_type is not None else F.lit(None)).cast("string")}
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(OUTCOME)


def weight(o: Column) -> Column:
    out = F.lit(0.0)
    for name, w in WEIGHTS.items():
        out = F.when(o["signal"] == name, F.lit(w)).otherwise(out)
    return out * o["factor"]


def combined(outcomes: Column) -> Column:
    """Weighted mean over informative outcomes with a score, weights renormalised, rounded half to even; 0 without any."""
    counted = F.filter(outcomes, lambda o: (weight(o) > 0) & o["score"].isNotNull() & o["informative"])
    total = F.aggregate(counted, F.lit(0.0), lambda a, o: a + weight(o))
    points = F.aggregate(counted, F.lit(0.0), lambda a, o: a + weight(o) * o["score"])
    return F.when(total > 0, F.bround(points / total)).otherwise(F.lit(0.0)).cast("int")


def highest_floor(outcomes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(outcomes, lambda o: o["score"].isNotNull()), lambda o: o["floor"])), F.lit(0))


def lifted(score: Column, outcomes: Column) -> Column:
    return F.greatest(score, highest_floor(F.filter(outcomes, lambda o: o["signal"] != "rules")))


def without_disagreeing(outcomes: Column) -> Column:
    """Outcomes with a limit on disagreement are made uninformative where they differ more than it from all the others together."""

    def judged(o: Column) -> Column:
        others = F.filter(outcomes, lambda x: x["signal"] != o["signal"])
        base = F.greatest(combined(others), highest_floor(others))
        bad = o["max_disagreement"].isNotNull() & o["score"].isNotNull() & o["informative"] & (F.abs(o["score"] - base) > o["max_disagreement"])
        return o.withField("informative", o["informative"] & ~F.coalesce(bad, F.lit(False)))

    return F.transform(outcomes, judged)


def verdict(score: Column) -> Column:
    return F.when(score >= SCAM, "scam").when(score >= SUSPICIOUS, "suspicious").otherwise("safe")


def severity(weight_: Column) -> Column:
    return F.when(weight_ >= 0.7, "high").when(weight_ >= 0.4, "medium").otherwise("low")


def score(messages: DataFrame, outcomes: str = "outcomes", hits: str = "hits", corroboration: bool = False) -> DataFrame:
    """messages with risk_score, verdict, scam_type and the outcomes as counted, in the fixed order of steps."""
    kept = messages.withColumn("outcomes", R.kept_apart(without_disagreeing(F.col(outcomes))))
    o = F.col("outcomes")
    out = kept.withColumn("__s", lifted(combined(o), o))
    if corroboration:
        backed = F.exists(hits, lambda h: ~h["supporting"] & (h["weight"] >= 0.3)) | F.exists(o, lambda x: (x["signal"] != "rules") & x["corroborating"] & ~x["needs_corroboration"] & x["informative"] & (x["score"] >= 30))
        needs = F.exists(o, lambda x: x["needs_corroboration"] & x["informative"] & x["score"].isNotNull())
        rest = F.filter(o, lambda x: ~x["needs_corroboration"])
        out = out.withColumn("__s", F.when(needs & ~backed, F.least("__s", F.greatest(lifted(combined(rest), rest), F.lit(SUSPICIOUS - 1)))).otherwise(F.col("__s")))
    deciding = F.filter(o, lambda x: x["can_decide_scam"])
    out = out.withColumn("__s", F.when((F.col("__s") >= SCAM) & (lifted(combined(deciding), deciding) < SCAM), F.lit(SCAM - 1)).otherwise(F.col("__s")))
    strongest = F.coalesce(F.array_max(F.transform(hits, lambda h: h["weight"])), F.lit(0.0))
    out = out.withColumn("__s", F.when((F.col("__s") < SUSPICIOUS) & (strongest >= STRONG_RULE), F.lit(SUSPICIOUS)).otherwise(F.col("__s")))
    typed = F.array_max(F.transform(F.filter(o, lambda x: x["scam_type"].isNotNull() & (x["signal"] != "rules") & x["informative"] & (x["score"] > 0)), lambda x: F.struct(x["score"].alias("s"), x["scam_type"].alias("t"))))["t"]
    specific = F.when(F.col("rules_type") != R.GENERIC, F.col("rules_type"))
    out = out.withColumn("__s", R.kept_apart(F.col("__s"))).withColumn("verdict", verdict(F.col("__s")))
    return out.withColumn("scam_type", F.when(F.col("verdict") != "safe", F.coalesce(specific, typed, F.col("rules_type"), F.lit(R.GENERIC)))).withColumnRenamed("__s", "risk_score")


def breakdown(scored: DataFrame, id_column: str) -> DataFrame:
    """A row for each outcome: its share of the weights that count, 0 for uninformative and failed ones."""
    o = F.col("outcomes")
    total = F.aggregate(F.filter(o, lambda x: (weight(x) > 0) & x["score"].isNotNull() & x["informative"]), F.lit(0.0), lambda a, x: a + weight(x))
    each = scored.select(id_column, total.alias("__total"), F.explode("outcomes").alias("x"))
    counts = F.col("x.informative") & F.col("x.score").isNotNull()
    return each.select(id_column, F.col("x.signal").alias("signal"), F.coalesce("x.score", F.lit(0.0)).alias("score"), F.when(counts & (F.col("__total") > 0), F.bround(weight(F.col("x")) / F.col("__total"), 4)).otherwise(F.lit(0.0)).alias("weight"), F.when(F.col("x.score").isNull(), "unavailable").when(F.col("x.informative"), "counted").otherwise("uninformative").alias("state"))


def url_signal(e: Column) -> tuple[Column, Column, Column]:
    """(score, informative, floor) from the links alone: lookalikes and risky top-level domains; all official is evidence of safety.

    Of a short link nothing is known before it is followed, so it is no evidence here; that it is short is a rule of its own.
    """
    looks = F.exists("url_brands", lambda b: b.isNotNull())
    scores = F.transform(F.slice(F.arrays_zip(e["urls"], F.col("url_brands")), 1, 5), lambda z: link_score(z["urls"], z["url_brands"]))
    best = F.array_max(scores)
    return F.when(F.size(e["urls"]) > 0, best), (F.coalesce(best, F.lit(0)) > 0) | F.coalesce(R.all_official(e), F.lit(False)), F.when(looks, 50)


def link_score(u: Column, brand: Column) -> Column:
    return R.saturating(F.filter(F.array(F.when(brand.isNotNull(), 0.7), F.when(F.substring_index(u["host"], ".", -1).isin(R.RISKY_TLDS), 0.25)), lambda w: w.isNotNull()))


def reputation_signal(known: Column) -> Column:
    """The outcome from struct(score, floor) as ``state.with_reputation`` gives them; no entry is no evidence."""
    return outcome("reputation", F.coalesce(known["score"], F.lit(0)), F.coalesce(known["score"] > 0, F.lit(False)), known["floor"])


def pattern_signal(near: Column, words: Column, least_similarity: float = 0.35, least_words: int = 12) -> Column:
    """The outcome from struct(scam, genuine, category): similarities to the nearest patterns; it cannot make a scam alone, and short texts don't count."""
    margin = near["scam"] - near["genuine"]
    counts = F.coalesce((words >= least_words) & (margin >= 0.05) & (near["scam"] >= least_similarity), F.lit(False))
    return outcome("pattern_similarity", F.when(counts, pattern_score(margin)).otherwise(0), counts, can_decide_scam=False, scam_type=F.when(counts, near["category"]))


def analyzed(messages: DataFrame, text: str = "text", classifier: str | None = None, reputation: str | None = None, patterns: str | None = None, links: str | None = None, sender: str | None = None, reply: str | None = None) -> DataFrame:
    """messages with entities, hits, outcomes, risk score, verdict and scam type: the whole offline path, batch or stream.

    Names of columns add what was looked up before: ``classifier`` a probability, ``reputation`` struct(score, floor), ``patterns`` struct(scam, genuine,
    category), ``links`` struct(score, informative, floor) instead of the links' static check, ``sender`` struct(sender, is_receipt), ``reply`` a language model's reply, which adds ``assessment`` and ``narrative``.
    """
    from ..functions.entities import entities
    from . import classifier as C
    from . import payments, senders

    found = R.evaluate(messages.withColumn("entities", entities(F.col(text))), text)
    e = F.col("entities")
    found = found.withColumn("upi_findings", R.kept_apart(payments.findings(e)))
    signals = {"upi": payments.signal(e, F.col("upi_findings")), "url": url_signal(e)}
    found = found.withColumns({f"__{n}_{k}": c for n, cs in signals.items() for k, c in zip(("score", "informative", "floor"), cs, strict=True)})
    of = lambda n: [F.col(f"__{n}_{k}") for k in ("score", "informative", "floor")]
    parts = [outcome("rules", F.col("rules_score"), scam_type=F.col("rules_type")), outcome("upi_check", *of("upi"), scam_type=F.when(F.exists("upi_findings", lambda f: f["code"].isin(*list(payments.WEIGHTS)[2:])), "qr_code")), outcome("url_intel", *of("url"), scam_type=F.lit("phishing_link"))]
    if links:
        parts[-1] = outcome("url_intel", F.when(F.size(e["urls"]) > 0, F.col(links)["score"]), F.coalesce(F.col(links)["informative"], F.lit(False)), F.col(links)["floor"], scam_type=F.when(F.col(links)["score"] > 0, "phishing_link"))
    if classifier:
        parts.append(C.signal(F.col(classifier), e))
    if reputation:
        parts.append(reputation_signal(F.col(reputation)))
    if patterns:
        parts.append(pattern_signal(F.col(patterns), F.size(F.split(F.trim(e["normalized_text"]), r"\s+"))))
    if sender:
        shown = F.col(sender)
        parts += [senders.sender_signal(shown["sender"], e["normalized_text"], F.col("hits"), F.array(*parts)), senders.proof_signal(shown["is_receipt"], F.col("hits"))]
    if reply:
        from . import replies

        found = replies.assessed(found, reply, text, flags=F.transform("hits", lambda h: h["rule_id"]))
        tried = replies.manipulated(F.col("hits"))
        parts.append(replies.signal(F.col("assessment"), tried))
        found = found.withColumn("narrative", replies.narrative(F.col("assessment"), tried))
    return score(found.withColumn("outcomes", R.kept_apart(F.array(*parts)))).drop(*[c for c in found.columns if c.startswith("__")])


#: English and Hindi: what a type is called, and what to do about it, in order of weight; the words are our own.
LABELS = {
    "upi_receive_money": ("a trick with a promise of money", "पैसे दिलाने के नाम पर ठगी"), "qr_code": ("a trick with a code to scan", "कोड स्कैन कराने वाली ठगी"), "sent_by_mistake": ("a false claim of money sent in error", "गलती से पैसे भेजने का झूठा दावा"),
    "phishing_link": ("a link that steals data", "डेटा चुराने वाला लिंक"), "task_job": ("a false offer of work", "काम का झूठा प्रस्ताव"), "fake_customer_care": ("a false helpline", "नकली हेल्पलाइन"), "generic": ("fraud", "ठगी"),
}
SECRET_LINE = ("Keep codes, PINs and passwords to yourself; no office needs them.", "कोड, पिन और पासवर्ड किसी को न दें; किसी दफ़्तर को इनकी ज़रूरत नहीं।")
ADVICE = {
    "upi_receive_money": [("You never need a PIN or a scan to receive money.", "पैसे पाने के लिए पिन या स्कैन कभी नहीं चाहिए।"), ("Refuse payment requests of strangers.", "अजनबियों के भुगतान अनुरोध अस्वीकार करें।")],
    "qr_code": [("A code is scanned to pay, not to be paid.", "कोड भुगतान करने के लिए होता है, पाने के लिए नहीं।"), ("Read the payee's name before you confirm.", "पुष्टि से पहले पाने वाले का नाम पढ़ें।")],
    "sent_by_mistake": [("Check your own statement before you return anything.", "कुछ भी लौटाने से पहले अपना खाता देखें।"), ("Leave a true error to the two banks.", "सच में गलती हो तो बैंकों को सुलझाने दें।")],
    "phishing_link": [("Do not open the link; use the official site.", "लिंक न खोलें; आधिकारिक साइट का उपयोग करें।"), ("Offices do not take data or fees by text message.", "दफ़्तर संदेश से डेटा या शुल्क नहीं लेते।"), ("Ask at the number on your card or bill.", "अपने कार्ड या बिल पर छपे नंबर पर पूछें।")],
    "task_job": [("No employer asks you to pay for work.", "कोई नियोक्ता काम के लिए पैसे नहीं माँगता।"), ("Leave groups that pay for likes.", "लाइक के पैसे देने वाले समूह छोड़ दें।")],
    "fake_customer_care": [("Install nothing that a caller sends.", "कॉल करने वाले का भेजा कुछ भी इंस्टॉल न करें।"), ("Take helpline numbers from official sites alone.", "हेल्पलाइन नंबर केवल आधिकारिक साइट से लें।"), ("Let nobody see your screen.", "अपनी स्क्रीन किसी को न दिखाएं।")],
    "generic": [SECRET_LINE],
}
SAFE_ADVICE = [("No usual sign of fraud was found; stay attentive.", "ठगी का कोई आम संकेत नहीं मिला; फिर भी ध्यान रखें।"), SECRET_LINE, ("If unsure, ask through the official app.", "संदेह हो तो आधिकारिक ऐप से पूछें।")]
REPORT_LINE = ("Report it at 1930 or cybercrime.gov.in.", "1930 या cybercrime.gov.in पर शिकायत करें।")
MOST_LINES = MOST_FLAGS = 4


def explained(scored: DataFrame) -> DataFrame:
    """scored with red_flags (the first four by severity, of rules and payment findings), explanation_en, explanation_hi, advice_en and advice_hi (four lines at most)."""
    flag = lambda code, weight_, shown: F.struct(code.alias("code"), severity(weight_).alias("severity"), shown.alias("evidence"))
    flags = F.transform("hits", lambda h: flag(h["rule_id"], h["weight"], h["evidence"]))
    if "upi_findings" in scored.columns:
        # two findings are rules as well, and are not told twice
        told = F.filter("upi_findings", lambda f: ~f["code"].isin("upi_payee_mismatch", "upi_prefilled_amount"))
        flags = F.array_distinct(F.concat(flags, F.transform(told, lambda f: flag(f["code"], f["weight"], f["evidence"]))))
    place = lambda f: F.when(f["severity"] == "high", 0).when(f["severity"] == "medium", 1).otherwise(2)
    by_severity = F.concat(*[F.filter(flags, lambda f, n=n: place(f) == n) for n in range(3)])
    first = F.slice(by_severity, 1, MOST_FLAGS)
    out = scored.withColumn("red_flags", R.kept_apart(first))
    kind = F.coalesce("scam_type", F.lit("generic"))
    label = lambda i: F.element_at(F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v[i]))]), kind)
    signs = F.array_join(F.transform("red_flags", lambda f: f["evidence"]), "; ")
    points = F.col("risk_score").cast("int")
    some = F.size("red_flags") > 0
    english = (
        F.when(F.col("verdict") == "scam", F.format_string("High risk, %d of 100: %s. Signs: %s.", points, label(0), signs))
        .when(F.col("verdict") == "suspicious", F.format_string("Some risk, %d of 100: it may be %s. Signs: %s. Ask an official source first.", points, label(0), signs))
        .otherwise(F.concat(F.format_string("Little risk, %d of 100: no usual pattern of fraud.", points), F.when(some, F.concat(F.lit(" Small signs: "), signs, F.lit("."))).otherwise("")))
    )
    hindi = (
        F.when(F.col("verdict") == "scam", F.format_string("अधिक जोखिम, 100 में %d: %s। संकेत: %s।", points, label(1), signs))
        .when(F.col("verdict") == "suspicious", F.format_string("कुछ जोखिम, 100 में %d: यह %s हो सकता है। संकेत: %s। पहले आधिकारिक स्रोत से पूछें।", points, label(1), signs))
        .otherwise(F.concat(F.format_string("कम जोखिम, 100 में %d: ठगी का कोई आम ढंग नहीं।", points), F.when(some, F.concat(F.lit(" छोटे संकेत: "), signs, F.lit("।"))).otherwise("")))
    )
    asks = F.exists("hits", lambda h: h["rule_id"] == "credential_request")

    def lines(i: int) -> Column:
        table = F.create_map(*[x for k, v in ADVICE.items() for x in (F.lit(k), F.array(*[F.lit(line[i]) for line in v]))])
        own = F.element_at(table, kind)
        led = F.array_distinct(F.when(asks, F.concat(F.array(F.lit(SECRET_LINE[i])), own)).otherwise(own))
        return F.when(F.col("verdict") == "safe", F.array(*[F.lit(x[i]) for x in SAFE_ADVICE])).otherwise(F.concat(F.slice(led, 1, MOST_LINES - 1), F.array(F.lit(REPORT_LINE[i]))))

    return out.withColumns({"explanation_en": english, "explanation_hi": hindi, "advice_en": lines(0), "advice_hi": lines(1)})
