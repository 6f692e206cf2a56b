"""URL parts, canonical form and keys, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.hosts import canonical_host

#: Query parameters that only track a visit, in the form of their published list (fixed values): ``name*`` is a prefix, ``name?`` counts with a token-like value only.
TRACKING_LIST = """
utm_*
gclid gclsrc dclid wbraid gbraid _ga _gl
fbclid msclkid twclid igshid yclid ttclid li_fat_id epik rdt_cid wickedid s_kwcid
mc_cid mc_eid mkt_tok vero_id vero_conv _hsenc _hsmi oly_anon_id oly_enc_id
at_* piwik_* pk_* matomo_*
ref_src ref_url spm scm
sessionid jsessionid phpsessid aspsessionid* cfid cftoken
sid?
"""
#: Two-part suffixes under which names are registered in country domains (fixed values).
SECOND_LEVEL = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "sch.uk", "com.au", "net.au",
    "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "net.nz", "govt.nz", "co.jp", "or.jp",
    "ne.jp", "ac.jp", "go.jp", "com.br", "net.br", "org.br", "gov.br", "com.cn", "net.cn",
    "org.cn", "gov.cn", "edu.cn", "co.in", "net.in", "org.in", "gov.in", "com.mx", "com.ar",
    "com.tr", "com.tw", "com.hk", "com.sg", "com.my", "co.kr", "or.kr", "co.za", "org.za",
    "com.pl", "com.ua", "co.il", "com.vn", "net.vn", "org.vn", "gov.vn", "edu.vn",
)
#: Session parameters of a path (fixed values).
SESSION_PARAMETERS = ("jsessionid", "phpsessid", "sid", "sessionid", "cfid", "cftoken")
MAX_BYTES = 2048


def tracking_rules(text: str = TRACKING_LIST) -> dict[str, tuple[str, ...]]:
    """``exact``, ``prefix`` and ``valued`` names of a list: names apart by white space, what follows # in a line ignored."""
    names = [n.lower() for line in text.splitlines() for n in line.split("#")[0].split()]
    return {
        "exact": tuple(n for n in names if n[-1] not in "*?"),
        "prefix": tuple(n[:-1] for n in names if n[-1] == "*" and n[:-1]),
        "valued": tuple(n[:-1] for n in names if n[-1] == "?" and n[:-1]),
    }


_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _SPLIT, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def port(url: Column) -> Column:
    """The port where it is not the scheme's own, else the empty string."""
    own = F.when(scheme(url) == "http", "80").when(scheme(url) == "https", "443").otherwise("")
    return F.when(_part(url, 3) == own, "").otherwise(_part(url, 3))


def path(url: Column) -> Column:
    return F.when(_part(url, 4) == "", "/").otherwise(_part(url, 4))


def query_string(url: Column) -> Column:
    return _part(url, 5)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(port(url) == "", "").otherwise(F.concat(F.lit(":"), port(url))))


def robots_path(url: Column) -> Column:
    """What robots rules are matched against: the path and the query."""
    return F.concat(path(url), F.when(query_string(url) == "", "").otherwise(F.concat(F.lit("?"), query_string(url))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def looks_like_session_token(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]{16,}$") & value.rlike("[0-9]")


def is_tracking(pair: Column, rules: dict[str, tuple[str, ...]] | None = None) -> Column:
    """For one ``name=value`` of a query: exact names, prefixes, and names that count with a token-like value only."""
    rules = rules or tracking_rules()
    name = F.lower(F.substring_index(pair, "=", 1))
    found = name.isin(*rules["exact"])
    for p in rules["prefix"]:
        found = found | name.startswith(p)
    return found | (name.isin(*rules["valued"]) & looks_like_session_token(F.regexp_replace(pair, "^[^=]*=?", "")))


def filter_query(query: Column) -> Column:
    """The query without tracking parameters, nameless and empty pairs; order and repeats stay."""
    return F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("=") & ~is_tracking(p)), "&")


def strip_path_parameters(path_: Column) -> Column:
    """A segment's parameters go if the first of them is a session's (``;jsessionid=...``)."""
    return F.regexp_replace(path_, "(?i)(/[^/;]*);(?:" + "|".join(SESSION_PARAMETERS) + ")(?:=[^/]*)?(?=/|$)", "$1")


def normalise_percent(text: Column) -> Column:
    """Escapes of unreserved characters are decoded once, all others get upper-case hex digits."""
    unreserved = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *map(ord, "-._~")]
    plain = F.create_map(*[F.lit(x) for c in unreserved for x in (f"{c:02X}", chr(c))])

    def decode(piece: Column) -> Column:
        code = F.upper(F.substring(piece, 1, 2))
        rest = F.substring(piece, 3, 1 << 30)
        valid = code.rlike("^[0-9A-F]{2}$")
        return F.when(valid & F.map_contains_key(plain, code), F.concat(F.element_at(plain, code), rest)).when(valid, F.concat(F.lit("%"), code, rest)).otherwise(F.concat(F.lit("%25"), piece))

    joined = lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), decode), ""))
    return _let(F.split(text, "%"), joined)


def without_dots(path_: Column) -> Column:
    """The path with ``.`` and ``..`` segments resolved."""
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    fold = lambda segments: F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), F.expr("cast(array() as array<string>)"), step)
    joined = lambda kept, last: F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    resolve = lambda segments: _let(fold(segments), lambda kept: joined(kept, F.element_at(segments, -1)))
    # Most paths have no dot segment and stay.
    return _let(path_, lambda p: F.when(p.rlike(r"/\.\.?(?:/|$)"), _let(F.split(p, "/"), resolve)).otherwise(p))


def percent_encoded(text: Column, also: str) -> Column:
    """UTF-8 escapes for characters outside ASCII and those of the class ``also``."""
    odd = rf"[^\x21-\x7E]|[{also}]"
    escaped = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(odd), F.url_encode(c)).otherwise(c)), "")
    return _let(text, lambda t: F.when(t.rlike(odd), escaped(t)).otherwise(t))


def resolved(reference: Column, base: Column) -> Column:
    """An absolute reference as it is, another one against an absolute base (RFC 3986); dot segments are left for the canonical form."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1) == "", F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(whole, "[^/]*$", ""))
    joined = (
        F.when(reference.startswith("//"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), reference)).when(reference.startswith("/"), F.concat(root, reference))
        .when(reference.startswith("?"), F.concat(whole, reference)).when(reference.startswith("#"), F.concat(F.substring_index(base, "#", 1), reference)).otherwise(F.concat(folder, reference))
    )
    return F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), reference).when(root != "", joined).otherwise(reference)


_WEB = r"^(?i:(https?)):[/\\]{0,2}+(?:[^/\\?#]*@)?(\[[^\]/\\?#]*\]|[^/\\?#:\[\]@]*)(?::0*([0-9]{0,5}))?([/\\][^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def canonical(url: Column, base: Column | None = None) -> Column:
    """``struct(url, error)``: the canonical form, or why there is none (``empty``, ``scheme``: another one or none, ``malformed``, ``host``, ``too_long``).

    White space and control characters go, a relative reference is resolved against ``base`` (absolute), scheme and host are lower-case,
    hosts as ``hosts.ascii_host`` writes them, without a last dot; credentials, a scheme's own port, fragments, tracking and
    session parameters go. The rest of path and query keeps its order and case. A lone % is written %25. The URL is cut into parts once.
    """
    clean = F.regexp_replace(url, r"[\x00-\x20\x7F-\x9F]", "")
    whole = clean if base is None else resolved(clean, F.regexp_replace(base, r"[\x00-\x20\x7F-\x9F]", ""))
    cut = F.split(F.regexp_replace(whole, _WEB, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001")
    # The host is looked at in Python, outside the lambda below.
    value = F.struct(clean.alias("clean"), whole.alias("whole"), cut.alias("cut"), canonical_host(F.regexp_extract(whole, _WEB, 2)).alias("host"))

    def made(v: Column) -> Column:
        part = lambda i: F.get(v["cut"], F.lit(i))
        scheme_ = F.lower(part(0))
        bad = (
            F.when(v["clean"].isNull() | (v["clean"] == ""), "empty").when(~v["whole"].rlike(r"^(?i:https?):"), "scheme")
            .when((F.size(v["cut"]) != 5) | (F.coalesce(part(2).try_cast("int"), F.lit(0)) > 65535), "malformed").when(v["host"].isNull(), "host")
        )
        at = F.when((part(2) == "") | (part(2) == F.when(scheme_ == "http", "80").otherwise("443")), "").otherwise(F.concat(F.lit(":"), part(2)))
        path_ = without_dots(normalise_percent(percent_encoded(strip_path_parameters(F.when(part(3) == "", "/").otherwise(F.replace(part(3), F.lit("\\"), F.lit("/")))), "\"<>`{}")))
        kept = normalise_percent(percent_encoded(filter_query(part(4)), "\"<>'"))
        out = F.concat(scheme_, F.lit("://"), F.regexp_replace(v["host"], r"\.$", ""), at, path_, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
        error = F.coalesce(bad, F.when(F.octet_length(out) > MAX_BYTES, "too_long"))
        return F.struct(F.when(error.isNull(), out).alias("url"), error.alias("error"))

    return _let(value, made)


def pay_level_domain(host_: Column) -> Column:
    """The registrable domain: the last two labels, or three under a known second level; hosts of one label and IPv4 addresses are their own."""
    labels = F.split(host_, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    ip = host_.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return F.when(ip | (F.size(labels) <= 2), host_).when(last(2).isin(*SECOND_LEVEL), last(3)).otherwise(last(2))


def key(text: Column, n_bytes: int) -> Column:
    """A stable key: the first bytes of the SHA-256 digest, as lower-case hex."""
    return F.substring(F.sha2(text, 256), 1, 2 * n_bytes)


def row_key(url: Column) -> Column:
    """``struct(pld, host, url)`` of keys, which sorts a domain's and a host's rows together."""
    return F.struct(key(pay_level_domain(host(url)), 8).alias("pld"), key(host(url), 8).alias("host"), key(url, 10).alias("url"))


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)


def collapse(text: Column) -> Column:
    """Runs of ASCII white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, "[ \\t\\n\\f\\r]+", " "))


def parent_domains(host_: Column) -> Column:
    """The host and all its parent domains, longest first."""
    labels = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
