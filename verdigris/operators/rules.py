"""The rule engine: weighted predicates over a message's text and entities, compiled into columns.

A rule is data: id, scam type, weight, a builder that makes its evidence column (null where the rule doesn't hold), and flags.  ``evaluate`` adds the hits, weightiest
first, the saturating score and the scam type.  More rules can be registered; all are expressions, so they stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Phrase patterns, in lower case, in Java's dialect without flags that differ between engines.
# Devanagari words stand without \b, which knows ASCII alone.
P = {
    "pin": r"\b(upi )?m?pin\b|पिन",
    "receive": r"\b(receive|get|credit|collect|claim|accept|milega|paane)\w*\b|प्राप्त|पाने",
    "scan": r"\bscan\w*\b|स्कैन",
    "qr": r"\bqr( ?code)?\b|क्यूआर",
    "bait": r"\b(cashback|refund|reward|prize|bonus|gift|win|won|receive|advance)\w*\b|aa jay?en?ge|इनाम|कैशबैक|रिफंड|प्राप्त",
    "not": r"\b(not|never|don'?t|do not|no need|without|nahi|mat|asks? you)\b|नहीं|(^|[^\p{L}\p{M}])न([^\p{L}\p{M}]|$)|कभी",
    "prize": r"\b(won|winner|lottery|lucky draw|prize|jackpot|kbc)\b|इनाम|लॉटरी",
    "collect": r"\b(collect|payment|money) request\b|\bapprove (the )?request\b",
    "mistake": r"\b(by mistake|mistakenly|accidentally|wrong(ly)? (number|account|sent|transferred)|galti se)\b|गलती से",
    "return": r"\b(return|refund|wapas|transfer back)\w*\b|\bsend (\w+ ){0,3}back\b|वापस",
    "money": r"\b(money|amount|payment|rupees|rs|paise|paisa|cash)\b|₹|रुपये|पैसे",
    "credit": r"\b(credited|deposited|received|approved|sanctioned|added)\b|जमा",
    "cash_out": r"\b(withdraw|claim|redeem|transfer|cash ?out|collect)\w*\b",
    "deposit_first": r"\bdeposit (first|now)\b",
    "blocked": r"\b(account|card|kyc|sim|wallet|upi|number|service)s?\b((?!points|offer).){0,40}\b(block|suspend|deactivat|expir|frozen|freez|clos|disconnect)\w*|\bkyc\b.{0,30}\b(pending|incomplete|unverif)\w*|(खाता|कार्ड|केवाईसी).{0,40}(ब्लॉक|बंद|निलंबित)",
    "requested": r"\bas (you )?requested\b",
    "action": r"\b(update|verify|confirm|complete|link|reactivate|unblock|validate|click|restore|re-?activate|regain)\w*\b|अपडेट|सत्यापित",
    "noun": r"\b(kyc|account|pan|aadhaar|card|details|identity|wallet|profile|access)\b|खाता|आधार|पैन",
    "power": r"\b(electricity|power|bijli|light bill)\b|बिजली",
    "cut": r"\bdisconnect\w*\b|\b(will|shall) be (cut|stopped|switched off)\b|\bkat ja|\bkaat d|\bband (ho|kar)|काट|कट जा|बंद",
    "fee": r"\b(fees?|charges?|tax|deposit|customs|duty|processing|redelivery)\b|शुल्क",
    "pay": r"\b(pay|paid|send|transfer)\w*\b|भुगतान",
    "release": r"\b(release|clear|deliver|receive|loan|parcel|refund|prize|disburse)\w*\b|पार्सल",
    "urgent": r"\b(urgent(ly)?|immediately|act now|last (chance|warning)|final (notice|warning)|turant|within \d+ (hours?|minutes?|hrs?)|\d+ (hours?|minutes?|hrs?) only)\b|तुरंत",
    "time": r"\b(today|tonight|now|24 hours?|aaj|abhi)\b|आज|अभी",
    "consequence": r"\b(block|suspend|disconnect|arrest|legal action|court action|fine|penalt|lose|expire|kat ja)\w*\b|ब्लॉक|बंद",
    "earn": r"\b(earn|income|salary|kamao|kamaye|kamaen)\w*\b|कमाए|कमाएं",
    "per_task": r"\b(per (task|like|review|day|video)|daily|each (task|like|review)|roz|by liking|like karke)\b|रोज",
    "part_time": r"\b(part[ -]?time|work from home|online job|home[ -]?based|ghar baithe)\b|घर बैठे",
    "messaging": r"^(wa\.me|t\.me|telegram\.me|chat\.whatsapp\.com|whatsapp\.com)$",
    "job": r"\b(job|hiring|vacancy|work|salary|recruit|earn)\w*\b|नौकरी",
    "prepaid": r"\b(prepaid|merchant|recharge) task\b|\b(pay|deposit|recharge)\b.{0,30}\bto (unlock|start|continue)\b.{0,20}\btasks?\b|\bunlock\b.{0,30}\btasks?\b",
    "task": r"\btasks?\b|टास्क",
    "commission": r"\bcommission\b|कमीशन",
    "care": r"\b(customer (care|service)|helpline|help ?desk|support (number|team)|toll ?free)\b|कस्टमर केयर|हेल्पलाइन",
    "officer": r"\b(electricity|power|bijli) (officer|adhikari|department)\b|अधिकारी",
    "credential": r"\b(otp|cvv|pin|password|passcode|one[ -]?time password)\b|ओटीपी|पासवर्ड",
    "share": r"\b(share|send|tell|give|provide|enter|forward|reply with|batao|bata d|bhejo)\w*\b|बताए|शेयर|भेजें",
    "identity": r"\b(aadhaa?r|pan card|pan number|passport|driving licen[cs]e|voter id)\b|आधार|पैन कार्ड",
    "challan": r"\b(e-?challan|traffic fine|parcel|package)\b.{0,60}\b(pending|unpaid|held|on hold)\b",
    "manipulate": r"\b(ignore|disregard|forget|override|bypass)( (all|any|the|your|my|these|previous|above|prior|earlier|system))+ (instructions?|rules|prompts?|guidelines)\b|\byou are now (in|a|an) (\w+ )?(mode|model|assistant|ai)\b|\bsystem prompt\b|\b(mark|classify|label|rate|flag|treat) (this|it|isko)( \w+)? as (not a scam|not scam|safe|genuine|legit\w*)\b|\bsafe mark kar|\bdo not flag\b|निर्देश.{0,12}(भूल|अनदेखा)|सुरक्षित (बताओ|बताएं|मानो)",
}

RISKY_TLDS = "xyz top click link loan work gq tk ml cf ga icu buzz cam rest monster vip win online site shop club live".split()
#: Fixed: brand word and its official domains.
BRANDS = {
    "paytm": ["paytm.com"], "phonepe": ["phonepe.com"], "gpay": ["google.com"], "sbi": ["sbi.co.in", "onlinesbi.sbi"], "hdfc": ["hdfcbank.com"], "icici": ["icicibank.com"], "axisbank": ["axisbank.com"],
    "amazon": ["amazon.in", "amazon.com"], "flipkart": ["flipkart.com"], "google": ["google.com", "google.co.in"], "whatsapp": ["whatsapp.com"], "netflix": ["netflix.com"], "paypal": ["paypal.com"],
    "microsoft": ["microsoft.com"], "apple": ["apple.com"], "facebook": ["facebook.com"], "instagram": ["instagram.com"], "airtel": ["airtel.in"], "irctc": ["irctc.co.in"], "npci": ["npci.org.in"],
    "parivahan": ["parivahan.gov.in"], "indiapost": ["indiapost.gov.in"], "uidai": ["uidai.gov.in"], "yono": ["sbi.co.in"], "jio": ["jio.com"], "bsnl": ["bsnl.co.in"], "epfo": ["epfindia.gov.in"],
    "licindia": ["licindia.in"], "kotak": ["kotak.com"], "canarabank": ["canarabank.com"], "bajajfinserv": ["bajajfinserv.in"], "fedex": ["fedex.com"],
}
OFFICIAL = sorted({d for ds in BRANDS.values() for d in ds})
OFFICIAL_SUFFIXES = ["gov.in", "nic.in", "bank.in"]
#: Fixed: short domains with digits that are well known.
KNOWN_DIGIT_DOMAINS = ["1mg.com", "zee5.com", "a23.games", "a23.com"]
WEAK_ONLY = ["short_url", "throwaway_domain", "filter_evasion"]
WEAK_CAP = 20
GENERIC = "generic"


def is_official(domain: Column) -> Column:
    out = domain.isin(OFFICIAL)
    for s in OFFICIAL_SUFFIXES:
        out = out | domain.endswith(f".{s}") | (domain == s)
    return out


def all_official(e: Column) -> Column:
    return (F.size(e["urls"]) > 0) & F.forall(e["urls"], lambda u: is_official(u["registered_domain"]))


def phrase(text: Column, name: str) -> Column:
    """The first match of a phrase, null without one."""
    found = F.regexp_extract(text, P[name], 0)
    return F.when(found != "", found)


def near(clauses: Column, groups: list[str], window: int = 2, unless: str | None = None, phrases: dict[str, str] | None = None) -> Column:
    """The first run of ``window`` clauses in which every group has a match; groups are names of ``phrases``, by default of the rules' own.

    With ``unless``, the first of its clauses that matches the first group must not match that phrase.  Later runs are still tried.
    """

    table = P if phrases is None else phrases

    def run(c: Column, i: Column) -> Column:
        part = F.slice(clauses, i + 1, window)
        chunk = F.array_join(part, " . ")
        good = F.lit(True)
        for g in groups:
            good = good & chunk.rlike(table[g])
        if unless:
            anchor = F.get(F.filter(part, lambda x: x.rlike(table[groups[0]])), F.lit(0))
            good = good & ~F.coalesce(anchor.rlike(table[unless]), F.lit(False))
        return F.when(good, chunk)

    return F.get(F.filter(F.transform(clauses, run), lambda x: x.isNotNull()), F.lit(0))


def one_clause(clauses: Column, groups: list[str], unless: str | None = None) -> Column:
    return near(clauses, groups, 1, unless)


def any_url(e: Column, good: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(e["urls"], good), F.lit(0))["raw"]


def largest(e: Column) -> Column:
    return F.coalesce(e["largest_amount"], F.lit(0.0))


def contact_route(e: Column) -> Column:
    return (F.size(e["urls"]) + F.size(e["phones"]) + F.size(e["upi_ids"]) + F.size(e["upi_uris"])) > 0


def mobile(e: Column) -> Column:
    return F.get(F.filter(e["phones"], lambda p: p["kind"] == "mobile"), F.lit(0))["raw"]


def has_upi(e: Column) -> Column:
    return F.size(e["upi_ids"]) + F.size(e["upi_uris"]) > 0


def homoglyphs(text: Column) -> Column:
    """Digits and letter pairs that look like letters, as those letters."""
    return F.replace(F.replace(F.translate(text, "01345", "oleas"), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def lookalike_brand(host: Column, domain: Column) -> Column:
    """The first brand, in order of the host's tokens and then of the table, that an unofficial host imitates; null without one.

    Short brands must be a token or begin one; longer ones may be part of it, or one edit away.
    """
    parts = F.filter(F.split(host, r"[.\-_]"), lambda t: t != "")
    tokens = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.struct(t.alias("plain"), homoglyphs(t).alias("seen")))
    names = F.array(*map(F.lit, BRANDS))

    def brands_of(t: Column) -> Column:
        seen = t["seen"]
        return F.filter(names, lambda b: (seen == b) | (t["plain"] == b) | F.when(F.length(b) <= 4, seen.startswith(b)).otherwise(seen.contains(b) | (F.levenshtein(seen, b, 1) >= 0)))

    return F.get(F.filter(F.flatten(F.transform(tokens, brands_of)), lambda b: ~is_official(domain)), F.lit(0))


def throwaway(domain: Column) -> Column:
    name = F.substring_index(domain, ".", 1)
    return name.rlike("^[a-z0-9]{3,5}$") & name.rlike("[a-z]") & name.rlike("[0-9]") & ~domain.isin(KNOWN_DIGIT_DOMAINS)


@dataclass(frozen=True)
class Rule:
    """evidence: (folded text, its clauses, entities, evasions) -> string, null where the rule doesn't hold."""

    id: str
    type: str
    weight: float
    evidence: Callable[[Column, Column, Column, Column], Column]
    supporting: bool = False
    weight_of: Callable[[Column, Column], Column] | None = field(default=None)


def _if(condition: Column, shown: Column) -> Column:
    return F.when(condition, shown)


def _account_weight(text: Column, e: Column) -> Column:
    return F.when(contact_route(e) & ~text.rlike(P["requested"]), F.lit(0.45)).otherwise(F.lit(0.20))


RULES: list[Rule] = [
    Rule("pin_to_receive", "upi_receive_money", 0.90, lambda t, c, e, v: F.get(F.filter(F.array(near(c, ["pin", "receive"])), lambda n: ~n.rlike(P["not"])), F.lit(0))),
    Rule("scan_to_receive", "upi_receive_money", 0.60, lambda t, c, e, v: near(c, ["scan", "receive"], unless="not")),
    Rule("prize_with_upi", "upi_receive_money", 0.50, lambda t, c, e, v: _if(has_upi(e), phrase(t, "prize"))),
    Rule("collect_request", "upi_receive_money", 0.45, lambda t, c, e, v: phrase(t, "collect")),
    Rule("scan_qr_bait", "qr_code", 0.75, lambda t, c, e, v: near(c, ["qr", "bait"])),
    Rule("upi_uri_with_amount", "qr_code", 0.30, lambda t, c, e, v: F.get(F.filter(e["upi_uris"], lambda u: u["am"] > 0), F.lit(0))["raw"]),
    Rule("payee_name_mismatch", "qr_code", 0.35, lambda t, c, e, v: F.get(F.filter(e["upi_uris"], lambda u: (F.length(F.coalesce(u["pn"], F.lit(""))) > 0) & u["pa"].isNotNull() & ~F.exists(F.filter(F.split(F.lower(u["pn"]), "[^a-z]+"), lambda w: F.length(w) >= 3), lambda w: F.regexp_replace(F.lower(u["pa"]), "[^a-z]", "").contains(w))), F.lit(0))["pn"]),
    Rule("sent_by_mistake", "sent_by_mistake", 0.60, lambda t, c, e, v: _if((F.size(e["amounts"]) > 0) | (F.size(e["upi_ids"]) > 0), phrase(t, "mistake"))),
    Rule("return_money", "sent_by_mistake", 0.45, lambda t, c, e, v: _if(t.rlike(P["mistake"]), near(c, ["return", "money"]))),
    Rule("money_back_request", "sent_by_mistake", 0.20, lambda t, c, e, v: _if(~t.rlike(P["mistake"]), near(c, ["return", "money"])), True),
    Rule("fake_credit_alert", "phishing_link", 0.75, lambda t, c, e, v: _if((F.size(e["urls"]) > 0) & ~all_official(e) & t.rlike(P["cash_out"]) & (largest(e) >= 1000) & ~t.rlike(P["deposit_first"]), phrase(t, "credit"))),
    Rule("short_url", "phishing_link", 0.45, lambda t, c, e, v: any_url(e, lambda u: u["is_shortener"])),
    Rule("tracking_suffix_link", "phishing_link", 0.30, lambda t, c, e, v: any_url(e, lambda u: u["url"].rlike(r"//[^/]+/(?:[^?#]*/)?[^/?#!]+![A-Za-z0-9]+") & ~is_official(u["registered_domain"]))),
    Rule("throwaway_domain", "phishing_link", 0.25, lambda t, c, e, v: any_url(e, lambda u: throwaway(u["registered_domain"]) & ~u["is_shortener"])),
    Rule("lookalike_domain", "phishing_link", 0.60, lambda t, c, e, v: F.get(F.filter(F.arrays_zip(e["urls"], F.col("url_brands")), lambda z: z["url_brands"].isNotNull()), F.lit(0))["urls"]["raw"]),
    Rule("suspicious_tld", "phishing_link", 0.30, lambda t, c, e, v: any_url(e, lambda u: F.substring_index(u["host"], ".", -1).isin(RISKY_TLDS))),
    Rule("account_blocked", "phishing_link", 0.45, lambda t, c, e, v: phrase(t, "blocked"), False, _account_weight),
    Rule("account_action_link", "phishing_link", 0.50, lambda t, c, e, v: _if((F.size(e["urls"]) > 0) & ~all_official(e), near(c, ["action", "noun"]))),
    Rule("electricity_disconnection", "phishing_link", 0.55, lambda t, c, e, v: near(c, ["power", "cut"])),
    Rule("fee_to_release", "phishing_link", 0.50, lambda t, c, e, v: _if(~F.coalesce(all_official(e), F.lit(False)), near(c, ["fee", "pay", "release"], 3))),
    Rule("urgency", "phishing_link", 0.30, lambda t, c, e, v: F.coalesce(phrase(t, "urgent"), one_clause(c, ["time", "consequence"])), True),
    Rule("earn_per_task", "task_job", 0.50, lambda t, c, e, v: near(c, ["earn", "per_task"])),
    Rule("part_time_high_pay", "task_job", 0.45, lambda t, c, e, v: _if(largest(e) >= 1000, phrase(t, "part_time"))),
    Rule("messaging_link_job", "task_job", 0.45, lambda t, c, e, v: _if(t.rlike(P["job"]), any_url(e, lambda u: u["host"].rlike(P["messaging"])))),
    Rule("prepaid_task", "task_job", 0.75, lambda t, c, e, v: phrase(t, "prepaid")),
    Rule("task_commission", "task_job", 0.50, lambda t, c, e, v: near(c, ["task", "commission"])),
    Rule("remote_access_app", "fake_customer_care", 0.65, lambda t, c, e, v: F.get(e["remote_access_apps"], F.lit(0))),
    Rule("apk_link", "fake_customer_care", 0.80, lambda t, c, e, v: F.coalesce(F.get(e["apk_links"], F.lit(0)), F.get(e["apk_files"], F.lit(0)))),
    Rule("helpline_personal_mobile", "fake_customer_care", 0.40, lambda t, c, e, v: _if(t.rlike(P["care"]) | t.rlike(P["officer"]), mobile(e))),
    Rule("credential_request", GENERIC, 0.85, lambda t, c, e, v: one_clause(c, ["share", "credential"], "not")),
    Rule("id_document_request", GENERIC, 0.35, lambda t, c, e, v: one_clause(c, ["share", "identity"], "not")),
    Rule("filter_evasion", GENERIC, 0.15, lambda t, c, e, v: F.get(v, F.lit(0)), True),
    Rule("ai_manipulation_attempt", GENERIC, 0.80, lambda t, c, e, v: phrase(t, "manipulate")),
]

HIT = "struct<rule_id:string,scam_type:string,weight:double,evidence:string,supporting:boolean,place:int>"


def register(rule: Rule) -> None:
    """Add a rule; a known id is replaced in its place."""
    for i, known in enumerate(RULES):
        if known.id == rule.id:
            RULES[i] = rule
            return
    RULES.append(rule)


def saturating(weights: Column) -> Column:
    """100 * (1 - product of 1 - w), rounded half to even."""
    return F.bround(100 * (1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - w)))).cast("int")


def rule_clauses(text: Column) -> Column:
    """Clauses of a folded text; a dot of an abbreviation or inside a link or number ends none.  Characters keep their places."""
    return X.clauses(dotless(text))


def dotless(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\b(?:rs|no|dr|mr|mrs|ms|ref))\.|\.(?=[^\s])", "·")


def unfolded(evidence: Column, folded: Column, original: Column) -> Column:
    """Evidence in the message's own spelling: its pieces are looked up in the folded text, whose characters have the places of the original."""
    shown = dotless(folded)

    def piece(p: Column) -> Column:
        at = F.coalesce(F.nullif(F.call_function("locate", p, folded), F.lit(0)), F.call_function("locate", p, shown))
        return F.when(at > 0, F.substring(original, at, F.length(p))).otherwise(p)

    return F.array_join(F.transform(F.split(evidence, r" \. "), piece), " … ")


def evaluate(messages: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """messages with hits, rules_score and rules_type, from the entities of the text, which hold its folded forms.

    Every rule sees the first folding; the second, where a message has one, only adds rules that the first one missed.
    """
    e = F.col(entities)
    v = e["evasions"]
    brands = F.transform(e["urls"], lambda u: lookalike_brand(u["host"], u["registered_domain"]))
    folded = messages.withColumns({"__one": e["rule_texts"][0], "__two": F.get(e["rule_texts"], F.lit(1)), "url_brands": brands})
    parts = folded.withColumns({"__c1": rule_clauses(F.col("__one")), "__c2": rule_clauses(F.col("__two"))})
    evidence, hits, shown = {}, [], {}
    original = e["normalized_text"]
    for i, rule in enumerate(RULES):
        evidence[f"__r{i}"] = rule.evidence(F.col("__one"), F.col("__c1"), e, v)
        if rule.id in TEXT_RULES:
            evidence[f"__s{i}"] = F.when(F.col("__two").isNotNull(), rule.evidence(F.col("__two"), F.col("__c2"), e, v))
            # places are looked up only for a hit, and only where folding has changed the text
            plain = F.replace(F.col(f"__r{i}"), F.lit(" . "), F.lit(" … "))
            first = F.when(F.col("__one") == original, plain).otherwise(unfolded(F.col(f"__r{i}"), F.col("__one"), original))
            shown[f"__r{i}"] = F.when(F.col(f"__r{i}").isNotNull(), first).otherwise(F.when(F.col(f"__s{i}").isNotNull(), unfolded(F.col(f"__s{i}"), F.col("__two"), original)))
        weight = rule.weight_of(F.col("__one"), e) if rule.weight_of else F.lit(rule.weight)
        hits.append(F.when(F.col(f"__r{i}").isNotNull(), F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.type).alias("scam_type"), weight.alias("weight"), X.snippet(F.col(f"__r{i}")).alias("evidence"), F.lit(rule.supporting).alias("supporting"), F.lit(i).alias("place"))))
    # evidence first, each a column of its own, so that what is built on it doesn't repeat its expression
    found = parts.withColumns(evidence).withColumns(shown).withColumn("hits", kept_apart(F.filter(F.array(*hits), lambda h: h.isNotNull()))).drop("__one", "__two", "__c1", "__c2", *evidence)
    ordered = F.array_sort("hits", lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(a["place"] - b["place"]))
    found = found.withColumn("hits", ordered)
    raw = saturating(F.transform("hits", lambda h: h["weight"]))
    weak = (F.size("hits") > 0) & F.forall("hits", lambda h: h["rule_id"].isin(WEAK_ONLY))
    return found.withColumn("rules_score", F.when(weak, F.least(raw, F.lit(WEAK_CAP))).otherwise(raw)).withColumn("rules_type", scam_type(F.col("hits")))


def kept_apart(column: Column) -> Column:
    """The same value, in a form that the optimizer neither inlines into what is built on it nor pushes filters through.

    A filter on the verdict would otherwise repeat all rules in its condition.
    """
    return F.when(F.spark_partition_id() >= 0, column)


#: Rules whose evidence depends on the folding.
TEXT_RULES = {r.id for r in RULES} - {"upi_uri_with_amount", "payee_name_mismatch", "short_url", "tracking_suffix_link", "throwaway_domain", "lookalike_domain", "suspicious_tld", "remote_access_app", "apk_link", "filter_evasion"}


def scam_type(hits: Column) -> Column:
    """The type with the greatest sum of weights, then the greatest single one; generic only if there is no other."""
    types = sorted({r.type for r in RULES} - {GENERIC})
    sums = []
    of = lambda t: F.filter(hits, lambda h: h["scam_type"] == t)
    for i, t in enumerate(types):
        own = of(t)
        total = F.bround(F.aggregate(own, F.lit(0.0), lambda a, h: a + h["weight"]), 4)
        sums.append(F.when(F.size(own) > 0, F.struct(total.alias("sum"), F.array_max(F.transform(own, lambda h: h["weight"])).alias("most"), F.lit(-i).alias("place"), F.lit(t).alias("type"))))
    best = F.array_max(F.filter(F.array(*sums), lambda s: s.isNotNull()))
    return F.coalesce(best["type"], F.when(F.size(hits) > 0, F.lit(GENERIC)))


