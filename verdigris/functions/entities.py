"""Entities of a message: links, payment ids and URIs, phones, amounts, e-mails, sensitive words, apps.

Spans need positions, look-around and claims on characters, so one pandas UDF over Arrow batches finds them all in one pass; what needs no position, such as the
registered domain or the kind of a key, is an expression.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import cleaned, fold, merged_spans
from .udf import vectorized

# Names of public services and public suffixes.
TWO_PART_SUFFIXES = "co.in gov.in org.in net.in bank.in fin.in ac.in edu.in res.in nic.in firm.in gen.in ind.in mil.in co.uk org.uk gov.uk ac.uk com.au net.au org.au co.nz co.za co.jp com.sg com.my com.cn com.br com.pk com.bd com.np".split()
SHORTENERS = (
    "bit.ly bitly.ws bit.do tinyurl.com tiny.cc tiny.one cutt.ly cutt.us is.gd v.gd x.gd soo.gd rb.gy t.ly shorturl.at short.gy goo.gl ow.ly buff.ly t.co rebrand.ly bl.ink s.id shorte.st adf.ly ouo.io surl.li t2m.io u.to "
    "clck.ru qr.ae lnkd.in wa.link urlz.fr shrtco.de gg.gg dub.sh kutt.it shrinke.me"
).split()
BARE_TLDS = (
    "com in org net info biz co io me app ai tv gov edu mobi asia xyz top online site club live life shop store tech website space fun icu buzz cyou vip pw tk ml ga cf gq link click work support services help world today news "
    "digital cloud loan win bid money bank pro sbs cfd bond lol rest quest page one ly gl gd at cc us uk cn ru id li fr de su ws sh gg do st ink gy to it"
).split()
UPI_HANDLES = (
    "ybl ibl axl okaxis oksbi okhdfcbank okicici okbizaxis paytm pthdfc ptsbi ptyes ptaxis apl yapl rapl waicici wahdfcbank waaxis wasbi upi ikwik mbk freecharge axisb abfspay jupiteraxis fam slc sliceaxis naviaxis superyes "
    "timecosmos tapicici pingpay pockets airtel jio jiopay postbank ippb yesg kaypay ezeepay sbi icici hdfcbank hdfc axisbank axis kotak kbl fbl federal idfcbank idfcfirst idfc yesbank yesbankltd barodampay boi pnb pnbpay "
    "unionbank unionbankofindia uboi cnrb canarabank cbin centralbank indianbank indbank iob kvb rbl sib dbs hsbc citi citigold sc aubank bandhan equitas idbi dlb dcb csbpay jkb karb uco ubi psb tjsb mahb indus cmsidfc purz"
).split()
REMOTE_APPS = ["anydesk", "teamviewer", "quicksupport", "airdroid", "ammyy", "rustdesk", "supremo"]

_alone = lambda words: f"(?<![\u0900-\u097f])(?:{words})(?![\u0900-\u097f])"
#: Secrets in the order in which they are sought: what names two of them belongs to the first, as a UPI PIN is no other PIN.
SENSITIVE = {
    "otp": r"\botps?\b|\bo[. ]{1,2}t[. ]{1,2}p\b|\bone[ -]?time[ -]?pass(?:word|code)s?\b|\bverification code\b|" + _alone("ओ\\.?टी\\.?पी|वन टाइम पास(?:वर्ड|कोड)"),
    "upi_pin": r"\bupi[ -]?pin\b|" + _alone("यूपीआई[ -]?पिन|upi पिन"),
    "mpin": r"\bm[ -]?pin\b|" + _alone("एम[ -]?पिन"),
    "pin": r"\bpin\b(?![ -]?code)|" + _alone("पिन"),
    "cvv": r"\bcv[vc]2?\b|\bcard verification|" + _alone("सीवीवी"),
    "password": r"\bpass ?words?\b|\bpasscode\b|\bpwd\b|" + _alone("पासवर्ड"),
    "aadhaar": r"\ba{1,2}dh?a{1,2}r\b|\buidai\b|" + _alone("आधार"),
    "pan": r"\bpan ?(?:card|number|no\b|num|details?|kyc)|" + _alone("पैन"),
}
_SECRETS = {k: re.compile(unicodedata.normalize("NFKC", p)) for k, p in SENSITIVE.items()}
#: Pieces of which a text has one at least wherever it names the secret: most texts have none, and finding that out is far cheaper than the pattern.
_HINTS = {
    "otp": ("otp", "time", "verification code", "ओ", "टाइम"), "upi_pin": ("upi", "यूपीआई"), "mpin": ("pin", "पिन"), "pin": ("pin", "पिन"), "cvv": ("cvv", "cvc", "card verification", "सीवीवी"),
    "password": ("pass", "pwd", "पासवर्ड"), "aadhaar": ("dar", "daar", "dhar", "dhaar", "uidai", "आधार"), "pan": ("pan", "पैन"),
}
_HINTED = {k: tuple(unicodedata.normalize("NFKC", h) for h in hints) for k, hints in _HINTS.items()}
_SPACED_OTP = re.compile(r"o[. ]{1,2}t[. ]{1,2}p")
_SECRET_ORDER = ["otp", "pin", "upi_pin", "mpin", "cvv", "password", "aadhaar", "pan"]
_PAN = re.compile(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b")

LISTS = ("emails", "sensitive_info", "remote_access_apps", "apk_links", "apk_files", "rule_texts", "evasions")
ENTITIES = (
    "struct<normalized_text:string,"
    "urls:array<struct<raw:string,url:string,host:string,registered_domain:string,is_shortener:boolean,is_ip:boolean,is_apk:boolean>>,"
    "upi_ids:array<struct<value:string,handle:string,confidence:string>>,"
    "upi_uris:array<struct<raw:string,pa:string,pn:string,am:double,tn:string,cu:string,mc:string>>,"
    "phones:array<struct<raw:string,number:string,kind:string>>,"
    "amounts:array<struct<raw:string,value:double,currency:string>>,"
    f"{','.join(f'{n}:array<string>' for n in LISTS)},largest_amount:double>"
)
COLUMNS = ["normalized_text", "urls", "upi_ids", "upi_uris", "phones", "amounts", *LISTS, "largest_amount"]

_URL = re.compile(r"(?i)(?<![\w@./-])(?:(?P<scheme>https?://)(?P<rest>[^\s<>\"'`]+)|(?P<bare>(?:www\.)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:" + "|".join(BARE_TLDS) + r")(?![\w-])(?:[/?#][^\s<>\"'`]*)?))")
_UPI_URI = re.compile(r"(?i)\bupi://[^\s<>\"']+")
_AT = re.compile(r"(?<![\w.+-])([A-Za-z0-9][A-Za-z0-9._+-]{0,255})@([A-Za-z][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*)(?![\w@])")
_MOBILE = re.compile(r"(?<![\d+])(?:\+?91[ -]?|0)?([6-9]\d{9}|[6-9]\d{4}[ -]\d{5}|[6-9]\d{2}[ -]\d{3}[ -]\d{4}|[6-9]\d{3}[ -]\d{3}[ -]\d{3})(?!\d)")
_TOLL = re.compile(r"(?<!\d)1800[ -]?\d{2,3}[ -]?\d{4}(?!\d)")
_INTERNATIONAL = re.compile(r"(?<![\w+])\+(?!91)\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}(?!\d)")
_ID_WORD = re.compile(r"(?i)(account|a/c|order|\bid\b|ref(erence)?|txn|transaction|utr|consumer|aadhaar|card|policy|invoice|rs\.?|inr|₹)[^\d]{0,14}$")
# Words of scale and currency, in both scripts; a nukta may be a character of its own.
_SCALES = {"k": 1e3, "thousand": 1e3, "hazaar": 1e3, "hazar": 1e3, "हज़ार": 1e3, "हज़ार": 1e3, "हजार": 1e3, "l": 1e5, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "लाख": 1e5, "cr": 1e7, "crore": 1e7, "crores": 1e7, "करोड़": 1e7, "करोड़": 1e7}
_SCALE = {unicodedata.normalize("NFKC", k): v for k, v in _SCALES.items()}
_ALONE = [w for w in _SCALE if w not in ("l", "thousand", "hazaar", "hazar") and not w.startswith("हज")]
_CURRENCY = {"$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR"}
_either = lambda words: "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
_END = r"(?![A-Za-z0-9\u0900-\u097f])"
_NUM = r"\d[\d,]*(?:\.\d+)?"
_AMOUNT = re.compile(
    rf"(?i)(?:(?P<before>₹|(?<![a-z])(?:rs\.?|inr|usd|eur)|\$|€|रु(?:पये|पए)?\.?)\s*(?P<a>{_NUM})(?:\s*(?P<m1>{_either(_SCALE)}){_END})?)"
    rf"|(?<![\w.])(?P<b>{_NUM})\s*(?P<m2>{_either(_SCALE)})?\s*(?P<after>/-|(?:rupees?|rupaye|rupay|rupiya|rupya|rs|inr|dollars?|रुपये|रुपए|रुपया|रु){_END})"
    rf"|(?<![\w.])(?P<c>{_NUM})(?:\s*(?P<m3>{_either([w for w in _ALONE if w != 'k'])})|(?P<m4>k)){_END}"
)
_LETTER_O = re.compile(r"(?i)(?:₹|(?<![a-z])(?:rs\.?|inr))\s*(\d[\do,]*)")
_APK = re.compile(r"(?i)\b[\w.-]+\.apk\b")
_DIGIT = re.compile(r"\d")


def domain_of(host: str) -> str:
    """The registered domain: three labels after a two-part public suffix, else two; addresses as they are."""
    try:
        ipaddress.ip_address(host)
        return host
    except ValueError:
        parts = host.split(".")
        return ".".join(parts[-3:] if ".".join(parts[-2:]) in TWO_PART_SUFFIXES else parts[-2:])


def registered_domain(host: Column) -> Column:
    """The same as an expression."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), host).when(two.isin(TWO_PART_SUFFIXES), three).otherwise(two)


def _trimmed(url: str) -> str:
    """Without punctuation at its end, a danda too, or closing brackets that the link doesn't open."""
    while url and (url[-1] in ".,;:!?*_~|'\"।॥" or (url[-1] in ")]}" and url.count(url[-1]) > url.count({")": "(", "]": "[", "}": "{"}[url[-1]]))):
        url = url[:-1]
    return url


def _unique(rows: list[dict], key: str) -> list[dict]:
    return list({r[key]: r for r in reversed(rows)}.values())[::-1]


def urls_in(text: str) -> list[tuple[int, int, dict]]:
    found = []
    for m in _URL.finditer(text):
        raw = _trimmed(m[0])
        url = raw if m["scheme"] else f"http://{raw}"
        try:
            host = (urlsplit(url).hostname or "").lower().rstrip(".")
        except ValueError:
            continue
        if not host or "." not in host:
            continue
        # 'done.In' and 'pay.Me' are a missing blank, not a link; a path or a hyphen tells a link
        if m["bare"] and re.search(r"\.[A-Z][a-z]+$", raw) and "-" not in raw and not raw.lower().startswith("www."):
            continue
        domain = domain_of(host)
        # scheme and host don't depend on case, so that keys meet; the path does
        head, slashes, rest = url.partition("://")
        cut = re.search("[/?#]|$", rest).start()
        url = f"{head.lower()}{slashes}{rest[:cut].lower()}{rest[cut:]}"
        found.append((m.start(), m.start() + len(raw), {"raw": raw, "url": url, "host": host, "registered_domain": domain, "is_shortener": domain in SHORTENERS or host in SHORTENERS, "is_ip": bool(re.fullmatch(r"\d+(\.\d+){3}", host)), "is_apk": urlsplit(url).path.lower().endswith(".apk")}))
    return found


def upi_uri(raw: str) -> dict:
    """Query of a payment URI: keys in lower case, the first value of each, percent-decoded."""
    query: dict[str, str] = {}
    for k, v in parse_qsl(urlsplit(raw).query, keep_blank_values=True):
        query.setdefault(k.lower(), v)
    try:
        am = float(query["am"].replace(",", "")) if query.get("am") else None
    except ValueError:
        am = None
    return {"raw": raw, "pa": query["pa"].lower() if query.get("pa") else None, "pn": query.get("pn"), "am": am, "tn": query.get("tn"), "cu": query.get("cu"), "mc": query.get("mc")}


def phones_in(text: str) -> list[tuple[int, int, dict]]:
    """In order of place; numbers as +91 and ten digits, toll-free ones as they are."""
    found: list[tuple[int, int, dict]] = []
    for pattern, kind in ((_TOLL, "toll_free"), (_INTERNATIONAL, "international"), (_MOBILE, "mobile")):
        for m in pattern.finditer(text):
            if _ID_WORD.search(text[max(0, m.start() - 30) : m.start()]):
                continue
            digits = re.sub(r"\D", "", m[0])
            number = f"+91{digits[-10:]}" if kind == "mobile" else digits if kind == "toll_free" else f"+{digits}"
            found.append((m.start(), m.end(), {"raw": m[0], "number": number, "kind": kind}))
    kept: list[tuple[int, int, dict]] = []
    for x in sorted(found, key=lambda x: x[0]):  # stable: of two at one place the kind that is tried first
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def amounts_in(text: str) -> list[tuple[int, int, dict]]:
    found = []
    for m in _AMOUNT.finditer(text):
        try:
            value = float((m["a"] or m["b"] or m["c"]).replace(",", ""))
        except ValueError:
            continue
        scale = (m["m1"] or m["m2"] or m["m3"] or m["m4"] or "").lower()
        sign = (m["before"] or m["after"] or "").lower()
        found.append((m.start(), m.end(), {"raw": m[0].strip(), "value": value * _SCALE.get(scale, 1.0), "currency": _CURRENCY.get(sign, "INR")}))
    return found


def sensitive_in(text: str) -> list[str]:
    """Kinds of secrets that a clean text names; what one kind took is blank to those after it."""
    low, found = text.lower(), set()
    for kind, pattern in _SECRETS.items():
        if not any(h in low for h in _HINTED[kind]) and not (kind == "otp" and _SPACED_OTP.search(low)):
            continue
        low, n = pattern.subn(" # ", low)
        found |= {kind} if n else set()
    if "PAN" in text and re.search(r"\bPAN\b", text):  # in capitals it is the card
        found.add("pan")
    return [k for k in _SECRET_ORDER if k in found]


#: A plain word in capitals or with a capital first: before @ it is prose, as in "Offers@Store".
_PROSE = re.compile(r"[A-Z](?:[a-z]+|[A-Z]+)")


def outside(spans: list[tuple], held: list[tuple]) -> list[tuple]:
    """Of spans in ascending order those that overlap none of ``held``: one pass over both."""
    busy, at, out = merged_spans([(x[0], x[1]) for x in held]), 0, []
    for x in spans:
        while at < len(busy) and busy[at][1] <= x[0]:
            at += 1
        if at == len(busy) or busy[at][0] >= x[1]:
            out.append(x)
    return out


def blanked(text: str, spans: list[tuple]) -> str:
    parts, at = [], 0
    for a, b in merged_spans([(x[0], x[1]) for x in spans]):
        parts += [text[at:a], " " * (b - a)]
        at = b
    return "".join([*parts, text[at:]])


def largest_amount(text: str, amounts: list[dict]) -> float:
    """The greatest amount, the letter O behind a currency read as zero."""
    marked = _LETTER_O.finditer(text) if _DIGIT.search(text) else ()
    zeroed = [float(m[1].lower().replace("o", "0").replace(",", "")) for m in marked if "o" in m[1].lower()]
    return max([a["value"] for a in amounts] + zeroed, default=0.0)


def extract(text: str | None) -> dict:
    """All entities of a message in their order, its folded texts and the tokens that hid something; everything is read from the clean text."""
    text = cleaned(text)
    uris = [(m.start(), m.end(), upi_uri(_trimmed(m[0]))) for m in _UPI_URI.finditer(text)] if "upi://" in text.lower() else []
    links = outside(urls_in(text), uris) if "." in text else []
    marks = list(_AT.finditer(text)) if "@" in text else []
    ids, emails, named = [], [], []
    for m in (x[2] for x in outside([(m.start(), m.end(), m) for m in marks], [*uris, *links])):
        local, handle = m[1], m[2].lower()
        if "." in handle:
            emails.append(m[0].lower())
        elif handle in UPI_HANDLES or (m[2].islower() and not _PROSE.fullmatch(local)):
            ids.append({"value": f"{local}@{handle}".lower(), "handle": handle, "confidence": "high" if handle in UPI_HANDLES else "low"})
        else:
            continue
        named.append(m.span())
    for _, _, u in uris:
        if u["pa"] and "@" in u["pa"]:
            handle = u["pa"].rsplit("@", 1)[1].lower()
            ids.append({"value": u["pa"].lower(), "handle": handle, "confidence": "high" if handle in UPI_HANDLES else "low"})
    rest = blanked(text, [*uris, *links])
    bare = blanked(rest, [m.span() for m in marks])
    phones, amounts = (phones_in(bare), amounts_in(rest)) if _DIGIT.search(rest) else ([], [])
    protected = [*uris, *links, *named, *phones, *amounts]
    first, second, evasions = fold(text, [(x[0], x[1]) for x in protected])
    low = text.lower()
    return {
        "normalized_text": low,
        "urls": _unique([u for _, _, u in links], "url"),
        "upi_ids": _unique(ids, "value"),
        "upi_uris": _unique([u for _, _, u in uris], "raw"),
        "phones": _unique([p for _, _, p in phones], "number"),
        "amounts": _unique([a for _, _, a in amounts], "value"),
        "emails": list(dict.fromkeys(emails)),
        "sensitive_info": sensitive_in(text),
        "remote_access_apps": [a for a in REMOTE_APPS if a in low.replace(" ", "")],
        "apk_links": list(dict.fromkeys(u["url"] for _, _, u in links if u["is_apk"])),
        "apk_files": list({f.lower(): f for f in reversed(_APK.findall(rest) if ".apk" in low else [])}.values())[::-1],
        "rule_texts": list(dict.fromkeys([first, second])),
        "evasions": evasions,
        "largest_amount": largest_amount(rest, [a for _, _, a in amounts]),
    }


@vectorized(ENTITIES)
def entities(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(t) for t in texts], columns=COLUMNS)


def spans(text: str | None) -> list[dict]:
    """start, end, kind of every entity in the clean text; of overlapping ones the first in order of kinds holds its characters."""
    return spans_of(cleaned(text))


def spans_of(text: str) -> list[dict]:
    held: list[tuple] = []
    digits = bool(_DIGIT.search(text))  # what can't be there is not sought
    named = [] if "@" not in text else [(m.start(), m.end(), "email" if "." in m[2] else "upi") for m in _AT.finditer(text) if "." in m[2] or m[2].lower() in UPI_HANDLES or (m[2].islower() and not _PROSE.fullmatch(m[1]))]
    links = [(a, b, "url", u) for a, b, u in urls_in(text)] if "." in text else []
    for found in (
        [(m.start(), m.end(), "upi_uri") for m in _UPI_URI.finditer(text)] if "://" in text else [],
        links,
        named,
        [(a, b, "phone_tollfree" if p["kind"] == "toll_free" else "phone") for a, b, p in phones_in(text)] if digits else [],
        [(a, b, "amount") for a, b, _ in amounts_in(text)] if digits else [],
    ):
        held += outside(found, held)
    return [{"start": x[0], "end": x[1], "kind": x[2], **({"url": x[3]} if len(x) > 3 else {})} for x in sorted(held, key=lambda x: x[:2])]


@vectorized("array<struct<start:int,end:int,kind:string>>")
def entity_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{k: x[k] for k in ("start", "end", "kind")} for x in spans(t)])


#: Masks that aren't named like their kind.
MASKS = {"upi_uri": "upi_link"}


def url_token(u: dict) -> str:
    """The mask of a link, by the riskiest kind that its own text shows."""
    return "url_ip" if u["is_ip"] else "url_apk" if u["is_apk"] else "url_short" if u["is_shortener"] else "url"


def masked(text: str | None) -> str:
    """Text for the classifier: clean and folded, entities as mask tokens, other numbers as <num>, white space collapsed."""
    text = cleaned(text)
    found = spans_of(text)
    base = fold(text, [(x["start"], x["end"]) for x in found])[0]
    if len(base) != len(text):  # a lower case that is longer: places of the folded text would be off
        base = text
    out, at = [], 0
    for s in found:
        out += [base[at : s["start"]], f" <{url_token(s['url']) if 'url' in s else MASKS.get(s['kind'], s['kind'])}> "]
        at = s["end"]
    whole = "".join([*out, base[at:]]).lower()
    whole = re.sub(r"(?<![<\w])\d+(?:[.,:/-]\d+)*", "<num>", whole)
    return re.sub(r"\s+", " ", re.sub(r"\s+([.,:;!?)])", r"\1", whole)).strip()


@vectorized("string")
def preprocessed(texts: pd.Series) -> pd.Series:
    return texts.map(masked)


def entity_keys(e: Column) -> Column:
    """Distinct (entity_type, value) that a message can be looked up by, in order."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("entity_type"), value.alias("value"))
    return F.array_distinct(
        F.flatten(
            F.array(
                F.transform(e["upi_ids"], lambda x: pair("upi", x["value"])),
                F.transform(e["phones"], lambda x: pair("phone", x["number"])),
                F.transform(e["urls"], lambda x: pair("url", x["url"])),
                F.transform(e["urls"], lambda x: pair("domain", F.regexp_replace(x["host"], r"^www\.", ""))),
                F.transform(e["urls"], lambda x: pair("domain", x["registered_domain"])),
            )
        )
    )


def normalized_entity(kind: Column, value: Column) -> Column:
    """The stored form of a reported value; null if it is none."""
    low = F.lower(F.trim(value))
    digits = F.regexp_replace(value, r"\D", "")
    host = F.regexp_replace(F.regexp_replace(low, r"^https?://", ""), r"[/?#:].*$", "")
    phone = F.when(F.length(digits).between(10, 13), F.when(digits.rlike("^1800"), digits).when(F.length(digits) == 10, F.concat(F.lit("+91"), digits)).when(digits.rlike("^0[6-9]"), F.concat(F.lit("+91"), F.right(digits, F.lit(10)))).otherwise(F.concat(F.lit("+"), digits)))
    domain = F.when(host.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$"), F.regexp_replace(host, r"^www\.", ""))
    return F.when(kind == "upi", F.when(low.rlike(r"^[a-z0-9._-]+@[a-z][a-z0-9]*$"), low)).when(kind == "phone", phone).when(kind == "url", F.when(low.rlike(r"^https?://\S+\.\S+"), F.trim(value))).when(kind == "domain", domain)


_CARD = re.compile(r"(?<!\d)(?:\d[ -]?){15}\d(?!\d)")
_AADHAAR = re.compile(r"(?<!\d)[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?!\d)")
_ACCOUNT = re.compile(r"(?i)((?:account|a/c|acct)\D{0,12})(\d{6,18})")
_TAIL = re.compile(r"(?i)\b([x*]{2,})(\d{3,6})\b")
_GREETING = re.compile(r"\b(Dear|Hi|Hello|Mr|Mrs|Ms)(\.?\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)")
_NAMES = ["Asha", "Ravi", "Meena", "Kiran", "Anil", "Sunita", "Vijay", "Neha"]


def anonymize(text: str | None) -> str:
    """Names, account, card and identity numbers, masked tails, phones and e-mails as fakes, the same one for the same original within a message."""
    fakes: dict[tuple[str, str], str] = {}

    def fake(kind: str, original: str, make) -> str:  # noqa: ANN001
        if (kind, original) not in fakes:
            for counter in range(1000):
                got = make(hashlib.sha256(f"{kind}:{original}:{counter}".encode()).hexdigest())
                if got != original and got not in fakes.values():
                    break
            fakes[kind, original] = got
        return fakes[kind, original]

    digits = lambda n, first="": lambda h: (first + str(int(h, 16)))[:n]
    text = cleaned(text)
    text = _GREETING.sub(lambda m: m[1] + m[2] + fake("name", m[3], lambda h: _NAMES[int(h[:8], 16) % len(_NAMES)]), text)
    text = _ACCOUNT.sub(lambda m: m[1] + fake("account", m[2], digits(len(m[2]))), text)
    text = _CARD.sub(lambda m: fake("card", m[0], digits(16, "4")), text)
    text = _AADHAAR.sub(lambda m: fake("aadhaar", m[0], digits(12, "9")), text)
    text = _PAN.sub(lambda m: fake("pan", m[0], lambda h: "ABCPX" + str(int(h, 16))[:4] + "Z"), text)
    text = _TAIL.sub(lambda m: m[1] + fake("tail", m[2], digits(len(m[2]))), text)
    for a, b, p in reversed(phones_in(text)):
        if p["kind"] == "mobile":
            text = text[:a] + fake("phone", p["number"], digits(10, "9")) + text[b:]
    return _AT.sub(lambda m: fake("email", m[0], lambda h: f"user{h[:6]}@mail.example") if "." in m[2] else m[0], text)


@vectorized("string")
def anonymized(texts: pd.Series) -> pd.Series:
    return texts.map(anonymize)


def reportable(e: Column) -> Column:
    """array<struct<entity_type, value>> that a user can report: payment ids, phones and the host of each link, the whole link for a shortener."""
    key = lambda kind, value: F.struct(F.lit(kind).alias("entity_type"), value.alias("value"))
    links = F.transform(e["urls"], lambda u: F.when(u["is_shortener"], key("url", u["url"])).otherwise(key("domain", F.regexp_replace(u["host"], r"^www\.", ""))))
    return F.array_distinct(F.concat(F.transform(e["upi_ids"], lambda u: key("upi", u["value"])), F.transform(e["phones"], lambda p: key("phone", p["number"])), links))


def rejected_url(value: Column, e: Column) -> Column:
    """Why a request for one link is refused, null if it isn't; ``e`` are the entities of the value."""
    return F.when((F.size(e["urls"]) != 1) | (F.get(e["urls"], F.lit(0))["raw"] != F.trim(value)), "must be a single URL")


def rejected_upi(upi_id: Column, upi_link: Column) -> Column:
    """Why a request for one payment id or one payment link is refused, null if it isn't."""
    one = upi_id.isNull() != upi_link.isNull()
    good_id = normalized_entity(F.lit("upi"), upi_id).isNotNull()
    good_link = F.trim(upi_link).rlike(r"(?i)^upi://pay\?(?:[^#]*&)?pa=[^&#]+")
    return F.when(~one, "give exactly one of upi_id or upi_uri").when(upi_id.isNotNull() & ~good_id, "upi_id must look like name@handle").when(upi_link.isNotNull() & ~good_link, "upi_uri must be a upi://pay?pa=... link")


def named_entities(text: str | None) -> list[tuple[str, str]]:
    """(kind, value) of all entities of a text, as keys and lists have them, in the order of kinds."""
    e = extract(text)
    pairs = [("url", u["url"]) for u in e["urls"]] + [("upi", u["value"]) for u in e["upi_ids"]] + [("upi_uri", u["raw"]) for u in e["upi_uris"]] + [("phone", p["number"]) for p in e["phones"]]
    pairs += [("amount", f"{a['value']:.2f} {a['currency']}") for a in e["amounts"]]
    return pairs + [(kind, v) for kind, name in (("email", "emails"), ("secret", "sensitive_info"), ("remote_app", "remote_access_apps"), ("apk", "apk_files")) for v in e[name]]


class EntityRows:
    """entities(text): a table function for SQL, a row for each entity of a text."""

    def eval(self, text: str):  # noqa: ANN201
        yield from named_entities(text)


def register(spark: SparkSession, name: str = "entities") -> None:
    """Make ``entities(text)`` known to SQL: SELECT ... FROM t, LATERAL entities(t.text)."""
    spark.udtf.register(name, F.udtf(EntityRows, returnType="kind string, value string", useArrow=True))


def entity_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, value): the same rows as the table function, by one pass over Arrow batches."""
    pairs = F.pandas_udf(lambda s: s.map(lambda t: [{"kind": k, "value": v} for k, v in named_entities(t)]), "array<struct<kind:string,value:string>>")
    return texts.select(key, F.inline(pairs(text)))
