"""Links as expressions: their parts, relative references, and whether a link leads to a public host by its name alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where there is none."""
    return F.regexp_extract(url, _PARTS, i)


def host(url: Column) -> Column:
    """The host in lower case, without user, port and brackets."""
    name = F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", "")
    return F.lower(F.regexp_replace(name, r"^\[(.*)\]$", "$1"))


def without_dots(path: Column) -> Column:
    """A path whose segments . and .. are resolved; none climbs over the root."""
    pieces = F.split(path, "/")
    root = F.when(path.startswith("/"), 1).otherwise(0)

    def step(done: Column, piece: Column) -> Column:
        return F.when(piece == ".", done).when(piece == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, root))).otherwise(F.concat(done, F.array(piece)))

    kept = F.aggregate(pieces, F.array().cast("array<string>"), step)
    last = F.element_at(pieces, -1)
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def joined(base: Column, reference: Column) -> Column:
    """The link that a reference means on the page of ``base``, as RFC 3986 resolves it, but that a reference with a host of its own keeps its dots; white space around it is dropped."""
    ref = F.regexp_replace(reference, r"^\s+|\s+$", "")
    scheme, authority, path, query, fragment = (part(ref, i) for i in range(1, 6))
    has_query, has_fragment = ref.rlike(r"^[^#]*\?"), ref.contains("#")
    own_path, own_query = part(base, 3), part(base, 4)
    folder = F.regexp_extract(own_path, r"(?s)^(.*/)[^/]*$", 1)
    merged = F.when((own_path == "") & (part(base, 2) != ""), F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    absolute = scheme != ""
    rooted = absolute | ref.startswith("//")
    new_path = F.when(rooted, path).when(path == "", own_path).when(path.startswith("/"), without_dots(path)).otherwise(without_dots(merged))
    new_query = F.when(rooted | (path != "") | has_query, F.when(has_query, F.concat(F.lit("?"), query)).otherwise("")).otherwise(F.when(base.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), own_query)).otherwise(""))
    start = F.when(absolute, F.concat(scheme, F.lit(":"))).otherwise(F.concat(part(base, 1), F.lit(":")))
    where = F.when(absolute, F.when(ref.rlike(r"^[^:]+://"), F.concat(F.lit("//"), authority)).otherwise("")).otherwise(F.concat(F.lit("//"), F.when(rooted, authority).otherwise(part(base, 2))))
    return F.concat(start, where, new_path, new_query, F.when(has_fragment, F.concat(F.lit("#"), fragment)).otherwise(""))


def public_address(ip: Column) -> Column:
    """Whether a dotted address is none of the private, loopback, link-local, shared, multicast or reserved ones; null for anything else."""
    number = lambda i: F.get(F.split(ip, r"\."), F.lit(i)).try_cast("int")
    a, b = number(0), number(1)
    hidden = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.between(18, 19)) | (a >= 224)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ~F.coalesce(hidden, F.lit(True)))


def public_http(url: Column) -> Column:
    """http or https on a host that isn't private by its name: no local name, no private address of either kind."""
    name = host(url)
    local = (name == "") | (name == "localhost") | name.rlike(r"\.(?:localhost|local|internal)$")
    six = name.contains(":") & name.rlike(r"^(?:::1?$|::ffff:|f[cd]|fe[89ab]|ff)")
    return F.coalesce(F.lower(part(url, 1)).isin("http", "https") & ~local & ~six & F.coalesce(public_address(name), F.lit(True)), F.lit(False))
