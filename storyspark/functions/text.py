"""Column builders for text, urls and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyspark.config import RELEASE_WORDS, SIMILARITY_STOP_WORDS, TRACKING_PARAMS, UPDATE_WORDS

_URL = r"^(?i:(https?))://([^/?#]*)([^?#]*)(\?[^#]*)?"


def round_k(c: Column, k: int = 4) -> Column:
    """Half up on the scaled double, the same in any engine."""
    return F.floor(c * 10.0**k + 0.5) / 10.0**k


def clamp01(c: Column) -> Column:
    return F.when(F.isnan(c), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def safe_rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def valid_http_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(r"^(?i:https?)://[^/?#\s]"), F.lit(False))


def host_of(url: Column) -> Column:
    """Lower-case host without port and leading ``www.``; empty for what is no http(s) url."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _URL, 2)), r":\d+$", ""), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` and default port; no fragment, tracking parameters or trailing slash.

    Null where the url isn't http(s). The query's other parameters stay as written.
    """
    u = F.trim(url)
    scheme, host, path = F.lower(F.regexp_extract(u, _URL, 1)), F.lower(F.regexp_extract(u, _URL, 2)), F.regexp_extract(u, _URL, 3)
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    query = F.substring(F.regexp_extract(u, _URL, 4), 2, 1 << 20)

    def kept(p: Column) -> Column:
        key = F.lower(F.substring_index(p, "=", 1))
        return (p != "") & ~key.isin(TRACKING_PARAMS) & ~key.startswith("utm_")

    left = F.array_join(F.filter(F.split(query, "&"), kept), "&")
    whole = F.concat(scheme, F.lit("://"), F.regexp_replace(port, r"^www\.", ""), F.when(path == "", "/").otherwise(path), F.when(left == "", "").otherwise(F.concat(F.lit("?"), left)))
    bare = F.when(whole.endswith("/") & ~path.isin("", "/"), F.left(whole, F.length(whole) - 1)).otherwise(whole)
    return F.when(valid_http_url(url), bare)


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)


def strip_html(c: Column) -> Column:
    """Tags away, seven entities decoded, white space collapsed."""
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for pattern, plain in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        c = F.regexp_replace(c, pattern, plain)
    return squeeze(c)


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def normalize_topic(c: Column) -> Column:
    return F.lower(squeeze(c))


def topic_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_topic(c), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def headline_ascii(c: Column) -> Column:
    """Lower case, apostrophes dropped, everything but a-z and 0-9 a single space."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’]", ""), "[^a-z0-9]+", " "))


def headline_unicode(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def similarity_tokens(c: Column) -> Column:
    """Words longer than 1, without stop words; news verbs unified, a plural s cut. Repeats stay."""

    def stem(t: Column) -> Column:
        plural = (F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss")
        return F.when(t.isin(RELEASE_WORDS), "release_event").when(t.isin(UPDATE_WORDS), "update_event").when(plural, F.left(t, F.length(t) - 1)).otherwise(t)

    words = F.filter(F.split(headline_ascii(F.coalesce(c, F.lit(""))), " "), lambda t: (F.length(t) > 1) & ~t.isin(SIMILARITY_STOP_WORDS))
    return F.transform(words, stem)


def significant(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= 4) | (t == "ai") | t.endswith("_event"))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays of distinct values; 1 where both are empty, 0 where one is."""
    both, one = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(one == 0, 1.0).otherwise(both / (one - both))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)
