"""Text hygiene: sanitising, injection flags, secrets, urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.text import host_of, safe_rate, round_k, valid_http_url

WHITE = " \t\n\r\f\x0b"
INJECTION = (
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"reveal\s+(the\s+)?system\s+prompt",
    r"disregard\s+(your|the)\s+(rules|instructions)",
    r"you\s+are\s+now\s+(dan|unrestricted|jailbroken)",
    r"exfiltrate|api[_-]?key|password\s*=",
)
#: Words that name a secret; the patterns in the functions below are fixed values as well.
SECRET_NAME = r"(?i)(?<![A-Za-z0-9_])(api[_-]?key|secret|token|password|authorization|bearer)(?![A-Za-z0-9_])"


def sanitized(text: Column, max_length: int = 4000) -> Column:
    """CRLF, control characters, boundary markers, role prefixes, fences and blank runs neutralised; long texts cut with a mark."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    t = F.regexp_replace(t, r"(?i)<<<\s*UNTRUSTED_[A-Z0-9_]+_(?:START|END)\s*>>>", "[UNTRUSTED_BOUNDARY_REDACTED]")
    t = F.regexp_replace(t, r"(?i)(^|\n)\s*(?:system|assistant|developer|user)\s*:\s*", "$1[role-mention]: ")
    t = F.regexp_replace(t, "(?i)```(?:system|assistant|json|xml|prompt)?", "` ` `")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    t = F.btrim(t, F.lit(WHITE))
    return F.when(F.length(t) > max_length, F.concat(F.substring(t, 1, max_length), F.lit("…[truncated]"))).otherwise(t)


def sanitize_texts(df: DataFrame, text: str = "text", by: str = "source", max_length: int = 4000) -> DataFrame:
    """Per ``by``: rows, rows changed, characters left."""
    rows = df.select(by, F.coalesce(F.col(text), F.lit("")).alias("t"), sanitized(F.col(text), max_length).alias("s"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("t") != F.col("s")).alias("changed"), F.sum(F.length("s")).alias("chars"))


def looks_injected(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in INJECTION)), F.lit(False))


def unsafe_output(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return (t == "") | looks_injected(t) | t.rlike(r"(?i)<<<\s*UNTRUSTED_") | t.rlike(r"(?im)^\s*(system|assistant|developer)\s*:")


def flag_injection(df: DataFrame, text: str, by: str) -> DataFrame:
    """Per ``by``: rows, flagged, unsafe, and the rate flagged."""
    rows = df.select(by, looks_injected(F.col(text)).alias("i"), unsafe_output(F.col(text)).alias("u"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("i").alias("flagged"), F.count_if("u").alias("unsafe")).withColumn("rate", round_k(safe_rate(F.col("flagged"), F.col("n")), 6))


def redacted(text: Column) -> Column:
    """Bearer tokens and key=value secrets, and long tokens where a secret's name is left; 280 characters at most."""
    t = F.regexp_replace(text, r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [redacted]")
    t = F.regexp_replace(t, r"""(?i)(?<![A-Za-z0-9_])(api[_-]?key|secret|token|password|authorization)\s*[:=]\s*["']?[^\s"',}]+""", "$1=[redacted]")
    named = t.rlike(SECRET_NAME)
    t = F.when(named, F.regexp_replace(t, r"[A-Za-z0-9_\-]{20,}", "[redacted]")).otherwise(t)
    return F.substring(F.nullif(t, F.lit("")), 1, 280)


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    out = redacted(F.col(text))
    return df.select(id_col, out.alias("detail"), (F.instr(out, "[redacted]") > 0).alias("has_redaction"))


def safe_urls(df: DataFrame, url: str) -> DataFrame:
    """Per host: http(s) urls without credentials, and the others."""
    u = F.trim(url)
    ok = valid_http_url(u) & ~F.regexp_extract(u, "^[^:]+://([^/?#]*)", 1).contains("@")
    return df.groupBy(host_of(u).alias("host")).agg(F.count_if(ok).alias("safe"), F.count_if(~ok).alias("rejected"))


def sanitize_events(events: DataFrame) -> DataFrame:
    """Pipeline events fit for an append-only sink: fields cut, details redacted, secret-named meta keys dropped.

    meta: map of strings; its values are redacted as well.
    """
    named = SECRET_NAME
    meta = F.transform_values(F.map_filter("meta", lambda k, _: ~k.rlike(named)), lambda _, v: redacted(v))
    return events.withColumns({"topic": F.substring("topic", 1, 120), "provider": F.substring("provider", 1, 80), "code": F.substring("code", 1, 120), "detail": redacted(F.col("detail")), "meta": meta})
