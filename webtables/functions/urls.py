"""URL and key functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions.text import _c, let

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# scheme://[userinfo@]host[:port]
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)"
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"

# TTL classes by URL substring (seconds), first rule wins.
STATIC_PATTERNS = ["static", "cdn", "cloudfront"]
REALTIME_PATTERNS = ["api", "realtime", "live"]
STATIC_TTL = 86400
REALTIME_TTL = 300
DEFAULT_TTL = 3600


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), SCHEME_RE, 1))


def is_http_url(url) -> Column:
    """True only for the schemes http and https; malformed, empty or null is false."""
    return F.coalesce(scheme(_c(url)).isin("http", "https"), F.lit(False))


def host(url) -> Column:
    """Lower-cased host (``urlparse(url).hostname``), '' when absent."""
    h = F.lower(F.regexp_extract(_c(url), HOST_RE, 1))
    return F.regexp_replace(h, r"^\[|\]$", "")


def origin(url) -> Column:
    return F.regexp_extract(_c(url), ORIGIN_RE, 1)


def host_matches_rules(h, rules: str | list[str]) -> Column:
    """Host equals an entry; entry starts with '.' and host ends with it;
    or host ends with '.' + entry. Empty list is false."""
    items = rules if isinstance(rules, list) else [r.strip() for r in rules.split(",")] if rules else []
    if not items:
        return F.lit(False)
    h = _c(h)
    cond = F.lit(False)
    for r in items:
        c = (h == F.lit(r)) | h.endswith(F.lit("." + r))
        if r.startswith("."):
            c = c | h.endswith(F.lit(r))
        cond = cond | c
    return cond


def host_suffixes(h) -> Column:
    """All dot-suffixes of a host, itself first (for the J6 equi-join)."""
    parts = F.split(_c(h), r"\.")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."),
    )


def ttl_for_url(url, static_ttl: int = STATIC_TTL, realtime_ttl: int = REALTIME_TTL,
                default_ttl: int = DEFAULT_TTL) -> Column:
    """H7: TTL class by substring of the lower-cased URL; first rule wins."""
    u = F.lower(_c(url))
    st = F.lit(False)
    for p in STATIC_PATTERNS:
        st = st | u.contains(p)
    rt = F.lit(False)
    for p in REALTIME_PATTERNS:
        rt = rt | u.contains(p)
    return F.when(st, F.lit(static_ttl)).when(rt, F.lit(realtime_ttl)).otherwise(F.lit(default_ttl))


def json_string(s) -> Column:
    """``json.dumps`` of a string (ensure_ascii): quotes, escapes, \\uXXXX.

    Fast path: printable ASCII without quote or backslash (nearly every URL)
    needs no escaping, so one pattern test decides and the rest is skipped."""
    s = _c(s)
    plain = s.rlike(r"^[\x{20}\x{21}\x{23}-\x{5b}\x{5d}-\x{7e}]*$")
    esc = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for ch, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        esc = F.replace(esc, F.lit(ch), F.lit(rep))
    # Remaining control and non-ASCII characters become \uXXXX (UTF-16
    # code units, as json.dumps writes them).
    escaped = F.array_join(
        F.transform(
            F.regexp_extract_all(esc, F.lit("(?s)."), 0),
            lambda ch: F.when(ch.rlike(r"^[\x{20}-\x{7e}]$"), ch).otherwise(
                F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", "\\\\u$1")
            ),
        ),
        "",
    )
    body = F.when(plain, s).when(esc.rlike(r"^[\x{20}-\x{7e}]*$"), esc).otherwise(escaped)
    return F.concat(F.lit('"'), body, F.lit('"'))


def cache_key(url, headers: dict[str, str] | None = None, **params) -> Column:
    """H6: sha-256 hex of ``json.dumps({"url": url, **kw}, sort_keys=True)``.

    Extra keyword values are literals (constant per call); ``headers`` is a
    dict literal, serialised with sorted keys like ``json.dumps`` does.
    """
    import json

    fields: dict[str, Column] = {"url": json_string(url)}
    if headers is not None:
        fields["headers"] = F.lit(json.dumps(headers, sort_keys=True))
    for k, v in params.items():
        fields[k] = v if isinstance(v, Column) else F.lit(json.dumps(v, sort_keys=True))
    parts: list[Column] = [F.lit("{")]
    for i, k in enumerate(sorted(fields)):
        if i:
            parts.append(F.lit(", "))
        parts.append(F.lit(json.dumps(k) + ": "))
        parts.append(fields[k])
    parts.append(F.lit("}"))
    return F.sha2(F.concat(*parts), 256)


def query_url(base: str, params: dict[str, Column | str | None]) -> Column:
    """``base?k=v&...`` with unset (null) parameters left out; values
    are form-encoded like Python's ``urlencode`` (``~`` kept, ``*`` escaped)."""
    items = []
    for k, v in params.items():
        if v is None:
            continue
        v = v if isinstance(v, Column) else F.lit(v)
        enc = F.replace(F.replace(F.url_encode(v.cast("string")), F.lit("%7E"), F.lit("~")),
                        F.lit("*"), F.lit("%2A"))
        items.append(F.when(v.isNotNull(), F.concat(F.lit(k + "="), enc)))
    if not items:
        return F.lit(base)
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *items))


# ---------------------------------------------------------------------------
# H5: relative URL resolution with urllib.parse.urljoin semantics, written
# with built-in functions only (usable inside higher-order functions).
# ---------------------------------------------------------------------------

# scheme ":" ["//" netloc] path ["?" query] ["#" fragment]
_SPLIT_RE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
# Schemes that take relative references (urllib.parse.uses_relative).
USES_RELATIVE = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]


def _clean(u: Column) -> Column:
    # urlsplit drops leading C0/space characters and every tab, CR and LF.
    return F.regexp_replace(F.regexp_replace(u, r"^[\x{00}-\x{20}]+", ""), r"[\t\r\n]", "")


def url_parts(u) -> Column:
    """``struct(scheme, has_net, net, path, query, frag)`` of a URL, parsed
    once (scheme lower-cased, as urlsplit does)."""
    def parts(c: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(c, _SPLIT_RE, 1)).alias("scheme"),
            (F.regexp_extract(c, _SPLIT_RE, 3) != "").alias("has_net"),
            F.regexp_extract(c, _SPLIT_RE, 3).alias("net"),
            F.regexp_extract(c, _SPLIT_RE, 4).alias("path"),
            F.regexp_extract(c, _SPLIT_RE, 6).alias("query"),
            F.regexp_extract(c, _SPLIT_RE, 8).alias("frag"),
        )

    return let(_clean(_c(u)), parts)


def _unsplit(sch: Column, netloc: Column, path: Column, query: Column, frag: Column) -> Column:
    path = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )


def _remove_dots(segs: Column) -> Column:
    out = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    out = F.when(F.try_element_at(segs, F.lit(-1)).isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)
    joined = F.array_join(out, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _merge_paths(bpath: Column, hpath: Column) -> Column:
    """RFC 3986 merge + dot-segment removal as urljoin does it."""
    def merged(bp: Column) -> Column:
        def drop_middle_empties(rel: Column) -> Column:
            n = F.size(rel)
            return F.concat(F.slice(rel, 1, 1), F.filter(F.slice(rel, 2, n - 2), lambda s: s != ""), F.slice(rel, n, 1))

        bparts = F.when(F.try_element_at(bp, F.lit(-1)) != "", F.slice(bp, 1, F.size(bp) - 1)).otherwise(bp)
        return _remove_dots(let(F.concat(bparts, F.split(hpath, "/", -1)), drop_middle_empties))

    return F.when(hpath.startswith("/"), _remove_dots(F.split(hpath, "/", -1))).otherwise(
        let(F.split(bpath, "/", -1), merged)
    )


def resolve_parts(bp: Column, base: Column, href) -> Column:
    """H5 with the base already parsed (``url_parts(base)``)."""
    h0 = _c(href)

    def full(hp: Column) -> Column:
        sch = F.when(hp["scheme"] == "", bp["scheme"]).otherwise(hp["scheme"])
        relative_ok = sch.isin(*USES_RELATIVE) & (sch == bp["scheme"])
        return (
            F.when(~relative_ok, h0)
            .when(hp["has_net"], _unsplit(sch, hp["net"], hp["path"], hp["query"], hp["frag"]))
            .when(hp["path"] == "", _unsplit(sch, bp["net"], bp["path"],
                                             F.when(hp["query"] == "", bp["query"]).otherwise(hp["query"]), hp["frag"]))
            .otherwise(_unsplit(sch, bp["net"], _merge_paths(bp["path"], hp["path"]), hp["query"], hp["frag"]))
        )

    # a plain absolute path: cheap string tests, one simple character class
    plain = (
        h0.startswith("/") & ~h0.startswith("//") & ~h0.contains("/.")
        & ~h0.endswith("?") & ~h0.endswith("#") & ~h0.contains("?#")
        & ~h0.rlike(r"[\x{00}-\x{20}\x{7f}]")
    )
    fast = bp["scheme"].isin(*USES_RELATIVE) & (bp["scheme"] != "") & plain
    return (
        F.when(base.isNull() | (base == ""), h0)
        .when(h0 == "", base)
        .when(fast, F.concat(bp["scheme"], F.lit(":"), F.when(bp["net"] != "", F.concat(F.lit("//"), bp["net"])).otherwise(F.lit("")), h0))
        .otherwise(let(url_parts(h0), full))
    )


def resolve_url(base, href) -> Column:
    """H5: ``urljoin(base, href)`` when base is non-empty, else ``href``."""
    if isinstance(base, str) and isinstance(href, str):
        from webtables.functions import sqltext as urlsql

        return F.expr(urlsql.resolve_url(urlsql.name(base), urlsql.name(href)))
    b0 = _c(base)
    return let(url_parts(b0), lambda bp: resolve_parts(bp, b0, href))
