"""URLs and issue keys in text, as column expressions: spans, canonical form, source classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a URL run is, what is trimmed from its end, tracking parameters, default ports, issue and page paths.
URL = r"""https?://[^\s<>"']+"""
TRIMMED = ".,;:!?)]}”’»"
TRACKING = ("utm_*", "fbclid", "gclid")
PORTS = {"http": 80, "https": 443}
ISSUE_PATH = r"^/browse/([A-Za-z][A-Za-z0-9]*-\d+)/?$"
PAGE_PATH = r"^/wiki/spaces/[^/]+/pages/(\d+)(?:/.*)?$"
#: Hosts of sites that have no base URL of their own end so.
CLOUD_HOST = ".atlassian.net"

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_END = "[" + "".join(f"\\{c}" if c.isascii() else c for c in TRIMMED) + "]*$"


def spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, found>> of a pattern's matches; offsets count code points. What lies between the matches is
    what ``split`` gives, so a match starts after all pieces and matches before it."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(F.slice(between, 1, F.size(found)), lambda x: F.length(x)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    placed = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("all")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.length(x["hit"])).alias("at"),
            F.array_append(s["all"], F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.length(x["hit"])).alias("end"), x["hit"].alias("found"))).alias("all"),
        ),
    )
    return placed["all"]


def trimmed(run: Column) -> Column:
    """A URL run without the punctuation at its end; of the closing brackets there, as many stay as balance open ones."""
    tail = F.regexp_extract(run, _END, 0)
    base = F.substring(run, F.lit(1), F.length(run) - F.length(tail))
    brackets = F.regexp_count(tail, F.lit(r"\)"))
    kept = F.least(brackets, F.regexp_count(base, F.lit(r"\(")) - F.regexp_count(base, F.lit(r"\)")))
    return F.concat(base, F.when(kept > 0, F.concat(F.call_function("substring_index", tail, F.lit(")"), kept), F.lit(")"))).otherwise(""))


def url_spans(text: Column) -> Column:
    """array<struct<start, end, found>> of the URLs in a text."""
    cut = F.transform(spans(text, URL), lambda s: F.struct(s["start"].alias("start"), trimmed(s["found"]).alias("found")))
    return F.transform(F.filter(cut, lambda s: s["found"] != ""), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["found"])).alias("end"), s["found"].alias("found")))


def parts_of(url: Column) -> dict[str, Column]:
    """Scheme, host, port text, path and query of a URL, white space around it left out."""
    bare = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    part = lambda k: F.regexp_extract(bare, _PARTS, k)
    authority = F.regexp_replace(part(2), r"(?s)^.*@", "")
    return {
        "bare": bare, "scheme": F.lower(part(1)), "authority": authority, "path": part(3), "query": part(4),
        "host": F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:\[\]]*)", 1)), "port": F.regexp_extract(authority, r":([0-9]+)$", 1),
    }


def _decoded(x: Column) -> Column:
    return F.url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """The canonical form of a URL: scheme and host in lower case, no user, default port, fragment, tracking parameter or
    slash at the end, parameters in order. Null for null and for a URL with a bad host or port."""
    p = parts_of(url)
    names = [t[:-1] for t in tracking if t.endswith("*")], [t for t in tracking if not t.endswith("*")]
    port = F.expr("0").cast("int") if not PORTS else p["port"].try_cast("int")
    default = F.coalesce(*[F.when(p["scheme"] == s, F.lit(n)) for s, n in PORTS.items()], F.lit(-1))
    sound = p["authority"].rlike(r"^(?:\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?\]|[^:\[\]]*)(?::[0-9]*)?$") & ((p["port"] == "") | F.coalesce(port <= 65535, F.lit(False)))
    pair = lambda x: F.struct(_decoded(F.regexp_extract(x, r"(?s)^([^=]*)", 1)).alias("name"), _decoded(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("value"))
    pairs = F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), pair)

    def tracks(name: Column) -> Column:
        out = F.lower(name).isin(*names[1])
        for start in names[0]:
            out = out | F.startswith(F.lower(name), F.lit(start))
        return out

    kept = F.sort_array(F.filter(pairs, lambda x: ~tracks(x["name"])))
    query = F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x["name"]), F.lit("="), _encoded(x["value"]))), "&")
    path = F.regexp_replace(p["path"], "/+$", "")
    made = F.concat(
        F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""),
        F.when((p["scheme"] != "") | (p["authority"] != ""), F.lit("//")).otherwise(""),
        p["host"], F.when((p["port"] != "") & (port != default), F.concat(F.lit(":"), port.cast("string"))).otherwise(""),
        F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(sound, made)


def source_class(url: Column, sites: dict[str, str] | None = None) -> dict[str, Column]:
    """source_type, key and api_base of a URL. Issue links ('jira') and wiki page links ('confluence') count on the host of
    the site's base URL in ``sites``, which then is the API base; a site without one is any cloud host, its API base the
    link's own scheme and host. All else is 'web'."""
    p = parts_of(url)
    web = p["scheme"].isin("http", "https") & (p["host"] != "") & p["authority"].rlike(r"^(?:\[[^\]]*\]|[^:\[\]]*)(?::[0-9]*)?$")
    kind, key, base = F.lit("web"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, path in (("confluence", PAGE_PATH), ("jira", ISSUE_PATH)):
        own = (sites or {}).get(name)
        here = p["host"] == parts_of(F.lit(own))["host"] if own else F.endswith(p["host"], F.lit(CLOUD_HOST))
        fits = F.coalesce(web & here & p["path"].rlike(path), F.lit(False))
        kind = F.when(fits, name).otherwise(kind)
        key = F.when(fits, F.regexp_extract(p["path"], path, 1)).otherwise(key)
        base = F.when(fits, F.lit(own.rstrip("/")) if own else F.concat(p["scheme"], F.lit("://"), p["host"])).otherwise(base)
    return {"source_type": kind, "key": key, "api_base": base}


def key_spans(text: Column, projects: tuple[str, ...]) -> Column:
    """array<struct<start, end, found>> of issue keys of the given projects that aren't part of a longer word."""
    if not projects:
        return F.array().cast("array<struct<start:int,end:int,found:string>>")
    return spans(text, rf"(?<![A-Za-z0-9-])(?:{'|'.join(rf'\Q{p}\E' for p in projects)})-\d+(?![A-Za-z0-9-])")
