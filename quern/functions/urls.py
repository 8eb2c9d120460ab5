"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = """
co.uk org.uk me.uk gov.uk ac.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz net.nz govt.nz co.jp ne.jp or.jp ac.jp go.jp co.in net.in org.in gov.in ac.in
com.br org.br net.br gov.br com.cn net.cn org.cn gov.cn com.sg org.sg edu.sg gov.sg co.za org.za web.za gov.za co.kr ne.kr or.kr re.kr com.mx org.mx gob.mx
com.tr org.tr gov.tr com.ru net.ru org.ru
""".split()
# Authority of known hosts and of suffixes.
HOST_AUTHORITY = {
    "developer.mozilla.org": 0.98, "github.com": 0.95, "npmjs.com": 0.94, "nodejs.org": 0.95, "typescriptlang.org": 0.95, "rust-lang.org": 0.95, "python.org": 0.95, "golang.org": 0.95,
    "go.dev": 0.95, "w3.org": 0.96, "wikipedia.org": 0.92, "stackoverflow.com": 0.90, "docs.rs": 0.92, "pypi.org": 0.92, "crates.io": 0.92, "arxiv.org": 0.93,
}
SUFFIX_AUTHORITY = [(("gov", "mil"), 0.95), (("edu", "ac.uk"), 0.92), (("org",), 0.75), (("io", "dev", "app"), 0.70), (("com", "net"), 0.60), (("xyz", "top", "click", "link"), 0.25)]
MAX_URL = 2048
PARTS = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, number)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def normalise(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, single slashes, no slash at the end but the root's, query sorted by key.
    NULL for what is no URL with a host."""
    s, h, port, path, query = scheme(url), host(url), part(url, 3), part(url, 4), part(url, 5)
    port = F.when((port == "") | ((s == "http") & (port == "80")) | ((s == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(path, "/{2,}", "/")
    path = F.when((path == "") | (path == "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    keyed = F.transform(pairs, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), x.alias("v")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["v"]), "&")
    out = F.concat(s, F.lit("://"), h, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((h != "") & (s != ""), out)


def url_hash(url: Column) -> Column:
    return F.sha2(normalise(url), 256)


def ipv4_number(h: Column) -> Column:
    """The 32-bit number of an address of one to four parts in decimal, octal (leading 0) or hexadecimal (0x) form; NULL for other hosts."""
    parts = F.split(F.lower(h), r"\.")
    value = lambda p: F.when(p.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(p, 3, 8), 16, 10)).when(p.rlike("^0[0-7]{1,11}$"), F.conv(p, 8, 10)).when(p.rlike(r"^(?:0|[1-9]\d{0,9})$"), p).cast("bigint")
    values = F.transform(parts, value)
    n = F.size(parts)
    # the last part fills what the others leave
    number = F.aggregate(values, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("i")),
                         lambda acc, v: F.struct((acc["sum"] + F.when(acc["i"] == n - 1, v).otherwise(v * F.pow(F.lit(256.0), 3 - acc["i"]).cast("bigint"))).alias("sum"), (acc["i"] + 1).alias("i")))["sum"]
    sound = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(F.slice(values, 1, n - 1), lambda v: v < 256) & (F.element_at(values, -1) < F.pow(F.lit(256.0), 5 - n))
    return F.when(sound, number)


# Ranges of addresses that are not public, and internal names.
PRIVATE_RANGES = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4"]
INTERNAL_NAMES = r"^(?:localhost|.*\.localhost|.*\.local|.*\.internal|.*\.lan|.*\.intranet|.*\.corp|.*\.home)$"


def private_bounds() -> list[tuple[int, int]]:
    out = []
    for r in PRIVATE_RANGES:
        address, bits = r.split("/")
        first = sum(int(p) << 8 * (3 - i) for i, p in enumerate(address.split(".")))
        out.append((first, first + (1 << 32 - int(bits)) - 1))
    return out


def is_private_host(h: Column) -> Column:
    """Loopback, private, shared, link-local, multicast and reserved addresses in any notation, the same in IPv6, and internal names."""
    number = ipv4_number(h)
    inside = F.lit(False)
    for low, high in private_bounds():
        inside = inside | number.between(low, high)
    return F.coalesce(inside, F.lit(False)) | h.rlike(INTERNAL_NAMES) | h.rlike(r"^\[?(?:::1?\]?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|::ffff:(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.)")


def validate(url: Column) -> Column:
    """Reason why a URL is rejected: empty, too_long, scheme, host, private; NULL for a valid one."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return (F.when(u == "", "empty").when(F.length(u) > MAX_URL, "too_long").when(~scheme(u).isin("http", "https"), "scheme")
            .when(host(u) == "", "host").when(is_private_host(host(u)), "private"))


def registrable(h: Column) -> Column:
    """The last two labels, three below a suffix of two; addresses pass through."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    two = F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1))
    three = F.concat_ws(".", F.get(labels, n - 3), two)
    return F.when(h.rlike(r"^[\d.]+$") | (n <= 2), h).when(two.isin(TWO_LABEL_SUFFIXES), three).otherwise(two)


def authority(h: Column) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for p in HOST_AUTHORITY.items() for x in p]), h)
    below = F.lit(None).cast("double")
    for name, value in HOST_AUTHORITY.items():
        below = F.coalesce(below, F.when(h.endswith("." + name), F.lit(value)))
    suffix = F.lit(0.5)
    for names, value in reversed(SUFFIX_AUTHORITY):
        hit = F.lit(False)
        for n in names:
            hit = hit | h.endswith("." + n)
        suffix = F.when(hit, F.lit(value)).otherwise(suffix)
    return F.coalesce(known, below, suffix)


def display(url: Column) -> Column:
    """Host and path segments, divided by an angle sign."""
    segments = F.filter(F.split(part(url, 4), "/"), lambda x: x != "")
    return F.concat_ws(" › ", host(url), F.array_join(segments, " › "))


def suffixes(h: Column) -> Column:
    """A host and everything after each of its dots: a.b.c, b.c, c."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
