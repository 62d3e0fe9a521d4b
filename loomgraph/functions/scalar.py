"""Reusable column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# The 29 words that full-text ranking leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it",
    "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with", "this", "these",
    "those",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


# --------------------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector with length 1; vectors shorter than 1e-10 stay as they are."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n < 1e-10, F.lit(1.0)).otherwise(n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b of vectors that are normalised."""
    return 1 - dot(a, b)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


# --------------------------------------------------------------------------- places


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def location(value: Column) -> Column:
    """Latitude and longitude of JSON like {"lat": 1, "lng": 2}, or of such JSON inside a JSON string; null if either isn't finite."""
    inner = F.when(F.ltrim(value).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    lat, lng = F.get_json_object(inner, "$.lat").try_cast("double"), F.get_json_object(inner, "$.lng").try_cast("double")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(fine(lat) & fine(lng), F.struct(lat.alias("lat"), lng.alias("lng")))


# --------------------------------------------------------------------------- text


def bm25_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def tokenize_query(text: str) -> list[str]:
    """The same words of a Python string."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w and w not in STOP_WORDS]


def stable_hash(json_text: Column) -> Column:
    return F.sha2(json_text, 256)


def embedding_tokens(text: Column) -> Column:
    """ASCII lower-cased runs of ASCII letters and digits of two characters or more."""
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def trigrams(word: Column) -> Column:
    n = F.length(word)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def snippet(text: Column, n: int = 240) -> Column:
    t = F.trim(text)
    return F.when(F.char_length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("…"))).otherwise(t)


def lexical_score(url: Column, text: Column, terms: list[str]) -> Column:
    """Two for each term in the address, one for each in the text."""
    u, t = F.lower(url), F.lower(text)
    out = F.lit(0)
    for w in terms:
        out = out + F.when(F.contains(u, F.lit(w)), 2).otherwise(0) + F.when(F.contains(t, F.lit(w)), 1).otherwise(0)
    return out.cast("double")


def mentions(text: Column, most: int = 120) -> Column:
    """Names after @ outside code, not preceded by a word character, in order of first appearance."""
    plain = F.regexp_replace(F.regexp_replace(text, "(?s)```.*?(?:```|$)", " "), "`[^`\n]*`", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9_])@([A-Za-z0-9][A-Za-z0-9_.:-]*)"), F.lit(1))
    clean = F.transform(found, lambda m: F.regexp_replace(m, r"[.:\-]+$", ""))
    return F.array_distinct(F.filter(clean, lambda m: (m != "") & (F.char_length(m) <= most)))


def atom_id(kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("mem:"), kind, F.lit(":"), F.substring(F.sha2(payload, 256), 1, 20))


def sanitize_tenant(name: Column) -> Column:
    t = F.regexp_replace(name, "[^A-Za-z0-9_-]", "")
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("default")).otherwise(t)


def symbol_matches(node_id: Column, names: Column, wanted: str) -> Column:
    """The id's tail after : / or #, or one of the names, equals the wanted symbol, ignoring ASCII case."""
    w = wanted.lower()
    tail = F.lower(F.regexp_extract(node_id, r"([^:/#]*)$", 1))
    return (tail == w) | F.exists(names, lambda n: F.lower(n) == w)


def trust_weight(tier: Column) -> Column:
    t = F.lower(tier)
    return F.when(t.isin("self", "verified"), 1.0).when(t == "blocked", 0.0).otherwise(0.3)


def increment(value: Column, delta: int) -> Column:
    """Integer addition; what isn't an integer counts 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0)) + F.lit(delta)


# --------------------------------------------------------------------------- pages and addresses


def html_text(html: Column) -> Column:
    """Text without tags, white space collapsed; script bodies stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>?", " "), r"\s+", " "))


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def title_from_url(url: Column) -> Column:
    """The last path segment, else the host."""
    last = F.regexp_extract(url_path(url), r"([^/]+)/*$", 1)
    return F.when(last != "", last).otherwise(domain(url))


def canonical_url(url: Column) -> Column:
    """http(s) addresses without fragment, credentials and default port, scheme and host in lower case; others null."""
    return let(F.regexp_replace(F.trim(url), "#.*$", ""), _canonical)


def _canonical(u: Column) -> Column:
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = domain(u)
    port = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)$", 1)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), rest))


def resolve_link(base: Column, href: Column) -> Column:
    """A link made absolute against its page and canonical; null for other schemes. Dot segments are resolved."""
    h = F.regexp_replace(F.trim(F.regexp_replace(href, "&amp;", "&")), "#.*$", "")
    return let(let(h, lambda x: _absolute(base, x)), lambda a: canonical_url(_no_dots(a)))


def _absolute(base: Column, h: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, url_path(base), h))
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(origin, folder, h))
    )


def _no_dots(url: Column) -> Column:
    """Remove . and .. segments from the path."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    rest = F.regexp_extract(url, r"(\?.*)$", 1)
    parts = F.split(path, "/")

    def walk(acc: Column, s: Column) -> Column:
        return F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s)))

    done = F.aggregate(parts, F.array().cast("array<string>"), walk)
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    clean = F.concat(F.array_join(done, "/"), tail)
    return F.when(path.contains("/."), F.concat(head, clean, rest)).otherwise(url)


def links(url: Column, html: Column) -> Column:
    """Sorted distinct link targets of a page."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)')"""), F.lit(0))
    inner = F.transform(hrefs, lambda h: F.regexp_extract(h, r"""(?is)href\s*=\s*["']([^"']*)["']?$""", 1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(inner, lambda h: resolve_link(url, h)), lambda u: u.isNotNull())))


def guarded(url: Column) -> Column:
    """Whether an address may be fetched: no metadata hosts, localhost, private, loopback or link-local IPs."""
    h = domain(url)
    private = r"^(?:127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)"
    bad = h.isin("localhost", "metadata", "metadata.google.internal", "169.254.169.254") | h.endswith(".localhost") | h.endswith(".internal") | h.rlike(private) | h.rlike(r"^\[")
    return F.coalesce(canonical_url(url).isNotNull() & ~bad, F.lit(False))


# Hosts by source class, tested in this order between the path rules.
PAPER_HOSTS = ("arxiv.org", "doi.org", "pubmed.ncbi.nlm.nih.gov", "semanticscholar.org")
CODE_HOSTS = ("github.com", "github.io", "gitlab.com")
ANSWER_HOSTS = ("stackoverflow.com", "stackexchange.com")
DOCS_HOSTS = ("docs.rs", "developer.mozilla.org", "readthedocs.io")
NEWS_HOSTS = ("nytimes.com", "reuters.com", "apnews.com", "bbc.com", "theguardian.com")
BLOG_HOSTS = ("medium.com", "substack.com", "wordpress.com", "blogspot.com")


def source_class(url: Column) -> Column:
    """One of 11 classes by host and path, first match wins."""
    host, path = F.regexp_replace(domain(url), r"^www\.", ""), F.lower(url_path(url))

    def of(hosts: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for h in hosts:
            out = out | (host == h) | host.endswith("." + h)
        return out

    has = lambda *parts: F.greatest(*[path.contains(p) for p in parts], F.lit(False))
    return (
        F.when(path.endswith(".pdf"), "pdf").when(of(PAPER_HOSTS), "paper").when(of(CODE_HOSTS), "github").when(of(ANSWER_HOSTS), "stack_overflow")
        .when(host.endswith(".gov") | host.endswith(".mil"), "government").when(of(DOCS_HOSTS) | has("/docs", "/documentation"), "docs").when(of(NEWS_HOSTS), "news")
        .when(of(BLOG_HOSTS) | has("/blog"), "blog").when(has("/forum", "/community", "/discuss"), "forum").when(has("/product", "/pricing"), "product").otherwise("unknown")
    )


def extraction_profile(kind: Column) -> Column:
    """What to extract for a source class: recall, tables, links, speed, snippet size, citation form."""
    rich, long = kind.isin("paper", "github", "docs", "government", "pdf"), kind.isin("paper", "pdf")
    return F.struct(
        rich.alias("favor_recall"), rich.alias("include_tables"), (kind != "pdf").alias("include_links"), (~rich).alias("fast_extract"),
        F.when(long, 600).when(rich, 420).when(kind.isin("stack_overflow", "forum"), 320).when(kind == "unknown", 240).otherwise(360).alias("snippet_max_chars"),
        F.when(kind == "paper", "bibliography").when(kind == "pdf", "snapshot").when(kind.isin("stack_overflow", "forum"), "inline").otherwise("url").alias("citation_strategy"),
    )


def promote_fetch(status: Column, body_bytes: Column, interstitial: Column) -> Column:
    """Whether a fetch needs the next tier: refused, throttled, or a success too small to be a page."""
    ok = status.between(200, 299)
    return F.coalesce(status.isin(403, 429, 503) | (ok & (body_bytes < 512)) | (ok & (body_bytes < 4096) & interstitial), F.lit(False))
