"""Payment ids and payment links: six kinds of findings, as expressions over the entities of a message, their score and floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.entities import UPI_HANDLES
from . import rules as R

# Names that a payee may pretend to, roles that no private id needs, words that may follow them in one token, words of a note that lures, and handles that are a brand's own.
BRAND_WORDS = "sbi yono hdfc icici axis kotak pnb paytm phonepe gpay googlepay amazon flipkart bhim npci rbi uidai incometax govt gov police cybercell electricity bijli".split()
ROLE_WORDS = "kyc refund customercare custcare care support helpdesk helpline cashback reward rewards prize lottery winner official".split()
ENDINGS = "update verify verification help desk team office service services dept india bank pay online".split()
BAIT = "refund cashback prize reward kyc lottery winner won bonus gift verify verification unblock".split()
BRAND_HANDLES = {"paytm": "paytm pthdfc ptsbi ptyes ptaxis", "phonepe": "ybl ibl axl", "amazon": "apl yapl rapl", "sbi": "sbi", "hdfc": "hdfcbank hdfc", "icici": "icici", "axis": "axisbank axis", "kotak": "kotak", "pnb": "pnb pnbpay"}
MERCHANT_HANDLES = "fbpe hdfcbankjd icicibank kmbl yesbankltd".split()
WEIGHTS = {"upi_id_impersonation": 0.6, "upi_unknown_handle": 0.35, "upi_payee_impersonation": 0.5, "upi_payee_mismatch": 0.35, "upi_prefilled_amount": 0.3, "upi_bait_note": 0.45}
FLOOR = 75

_NAMES = sorted(set(BRAND_WORDS + ROLE_WORDS), key=lambda w: (-len(w), w))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def impersonated(tokens: Column) -> Column:
    """The name that the first such token stands for, the longest first; a short name must be the token, or begin it before an ending or another name."""
    names, endings = F.array(*map(F.lit, _NAMES)), [*ENDINGS, *_NAMES]

    def name_in(token: Column) -> Column:
        own = F.filter(names, lambda n: F.when(F.length(n) >= 5, token.contains(n)).otherwise((token == n) | (token.startswith(n) & F.substring(token, F.length(n) + 1, F.lit(100)).isin(endings))))
        return F.get(own, F.lit(0))

    return F.get(F.filter(F.transform(tokens, name_in), lambda n: n.isNotNull()), F.lit(0))


def own_handle(name: Column, handle: Column) -> Column:
    """Whether the handle is one that the brand itself issues."""
    table = F.create_map(*[x for k, v in BRAND_HANDLES.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    return F.coalesce(F.array_contains(F.try_element_at(table, name), handle), F.lit(False))


def _finding(code: str, holds: Column, evidence: Column) -> Column:
    return F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(WEIGHTS[code]).alias("weight"), evidence.alias("evidence")))


def findings(e: Column) -> Column:
    """array<struct<code, weight, evidence>> of all payment ids, then of all payment links."""

    def of_id(u: Column) -> Column:
        local, handle = F.substring_index(u["value"], "@", 1), u["handle"]
        name = impersonated(words(local))
        return F.array(_finding("upi_id_impersonation", name.isNotNull() & ~own_handle(name, handle), u["value"]), _finding("upi_unknown_handle", ~handle.isin(UPI_HANDLES + MERCHANT_HANDLES), u["value"]))

    def of_link(u: Column) -> Column:
        pa, pn = F.coalesce(u["pa"], F.lit("")), F.coalesce(u["pn"], F.lit(""))
        name = impersonated(words(pn))
        letters = F.regexp_replace(F.substring_index(pa, "@", 1), "[^a-z]", "")
        long = F.filter(words(pn), lambda w: F.length(w) >= 3)
        lures = F.array_sort(F.array_distinct(F.filter(words(u["tn"]), lambda w: w.isin(BAIT))))
        return F.array(
            _finding("upi_payee_impersonation", name.isNotNull() & ~own_handle(name, F.substring_index(pa, "@", -1)), F.concat(pn, F.lit(" ("), pa, F.lit(")"))),
            _finding("upi_payee_mismatch", (F.length(letters) >= 3) & (F.size(long) > 0) & ~F.exists(long, lambda w: letters.contains(w)), F.concat(pn, F.lit(" / "), pa)),
            _finding("upi_prefilled_amount", F.coalesce(u["am"] > 0, F.lit(False)), F.format_string("%s", u["am"])),
            _finding("upi_bait_note", F.size(lures) > 0, F.array_join(lures, ", ")),
        )

    # an id that stands in a link is judged with the link; ids of the text alone are judged here
    return F.filter(F.concat(F.flatten(F.transform(e["upi_ids"], of_id)), F.flatten(F.transform(e["upi_uris"], of_link))), lambda f: f.isNotNull())


def signal(e: Column, found: Column | None = None) -> tuple[Column, Column, Column]:
    """(score, informative, floor); the score is null where there is nothing to check, and the floor needs a pretended payee and a request."""
    f = findings(e) if found is None else found
    has = lambda *codes: F.exists(f, lambda x: x["code"].isin(*codes))
    floor = F.when(has("upi_id_impersonation", "upi_payee_impersonation") & has("upi_prefilled_amount", "upi_bait_note"), FLOOR)
    return F.when(R.has_upi(e), R.saturating(F.transform(f, lambda x: x["weight"]))), F.size(f) > 0, floor
