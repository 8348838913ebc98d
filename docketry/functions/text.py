"""Scalar text, number and date functions as Column builders. NULL in gives NULL out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and their mime types.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "txt": "text/plain",
    "md": "text/plain",
    "markdown": "text/plain",
    "rtf": "application/rtf",
    "html": "text/html",
    "htm": "text/html",
    "csv": "text/csv",
    "json": "application/json",
    "xml": "application/xml",
    "eml": "message/rfc822",
    "msg": "application/vnd.ms-outlook",
}
UNKNOWN_MIME = "application/octet-stream"
# Mime types that text can be taken from.
SUPPORTED = [MIME[x] for x in ("pdf", "docx", "doc", "txt", "rtf", "html", "csv", "json", "xml")] + ["text/markdown"]


def guess_mime(name: str | Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ext), F.lit(UNKNOWN_MIME))


def is_supported(mime: str | Column) -> Column:
    return (F.col(mime) if isinstance(mime, str) else mime).isin(SUPPORTED)


def collapse(text: str | Column) -> Column:
    """Runs of white space of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{85}\p{Z}]+", " "))


def strip_html(html: str | Column) -> Column:
    """Text of a page: script, style and head go with their contents, tags become spaces, six entities are decoded one after another, white space collapses."""
    out = html if isinstance(html, Column) else F.col(html)
    for tag in ("script", "style", "head"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return collapse(out)


def word_count(text: str | Column) -> Column:
    """Words between white space; 0 for blank text."""
    flat = collapse(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def token_estimate(text: str | Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, and one."""
    return (F.ceil(F.octet_length(text) / 4) + 1).cast("int")


def context_header(reference: Column, name: Column, page: Column) -> Column:
    """Case reference, file name and page, what is known of them, with dashes between."""
    known = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws(" — ", known(reference), known(name), F.concat(F.lit("p. "), page.cast("string")))


def task_prefix(model: str | Column, query: bool) -> Column:
    """What some embedding model families want in front of a text."""
    m = F.lower(model)
    picks = (
        (m.contains("nomic-embed"), "search_query: ", "search_document: "),
        (m.contains("e5") & (m.contains("multilingual") | m.contains("e5-")), "query: ", "passage: "),
        (m.contains("mxbai-embed") | m.contains("snowflake-arctic-embed") | m.contains("bge-"), "Represent this sentence for searching relevant passages: ", ""),
    )
    out = F.lit("")
    for test, q, d in reversed(picks):
        out = F.when(test, F.lit(q if query else d)).otherwise(out)
    return out


def embed_input(header: Column, text: Column, prefix: Column | None = None) -> Column:
    lead = prefix if prefix is not None else F.lit("")
    return F.concat(lead, F.when(header == "", text).otherwise(F.concat(header, F.lit("\n\n"), text)))


def format_id(model: Column, recipe: int = 2) -> Column:
    return F.concat(F.lit(f"v{recipe}|"), model)


def snippet(text: Column, size: int = 320) -> Column:
    """The whole of a short text; else its first characters without white space at the end, and three points."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, size), r"[\s\p{Z}]+$", ""), F.lit("...")))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, point, hyphen and underline only."""
    return F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}._-]", "_")


def format_bytes(n: Column) -> Column:
    """0 B, bytes without decimals, then KB, MB, GB with one."""
    step = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(3))
    size = n / F.pow(F.lit(1024.0), step.cast("double"))
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), (step + 1).cast("int"))
    shown = F.when(step == 0, F.format_string("%d", n.cast("long"))).otherwise(F.format_string("%.1f", F.floor(size * 10 + 0.5) / 10))
    return F.when(n == 0, "0 B").otherwise(F.concat(shown, F.lit(" "), unit))


def format_relative(then: Column, now: Column) -> Column:
    """How long ago in words up to 30 days, then the date."""
    s = (now.cast("timestamp").cast("long") - then.cast("timestamp").cast("long")).cast("long")
    ago = lambda d, u: F.concat(F.floor(s / d).cast("string"), F.lit(f"{u} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).when(s < 30 * 86400, ago(86400, "d")).otherwise(F.date_format(then, "yyyy-MM-dd"))


def format_date(text: str | Column) -> Column:
    """`Jan 5, 2024` of a date or time as text; what is no date comes back as it is."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "MMM d, yyyy"), c)


# What an error text of a model service holds, and what kind of error it is.
SERVICE_ERRORS = [("unreachable", "connection refused|could not connect|dns|unreachable"), ("timeout", "timed out|timeout|deadline"), ("unauthorized", "\\b401\\b|unauthorized|invalid api key"), ("missing model", "\\b404\\b|model .*not found|no such model"), ("rate limit", "\\b429\\b|rate limit|too many requests")]


def service_error(error: str | Column) -> Column:
    """The kind of error a service text tells of: the first that fits, else `other`; NULL and blank are none."""
    c = F.lower(error)
    out = F.lit("other")
    for kind, pattern in reversed(SERVICE_ERRORS):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return F.when(F.trim(c) != "", out)


def same_model(a: Column, b: Column) -> Column:
    """Whether two model names mean one model: a name without a tag has the tag `latest`."""
    full = lambda m: F.when(m.contains(":"), m).otherwise(F.concat(m, F.lit(":latest")))
    return full(a) == full(b)


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def diagnosis(error: Column) -> Column:
    """The problem named by the JSON of a failed reply; NULL where it is no JSON object."""
    return F.when(F.startswith(F.trim(error), F.lit("{")), F.get_json_object(error, "$.problem"))


def csv_field(c: Column, newline: bool = True) -> Column:
    """Quoted if it holds a comma, a quote or (if `newline`) a line end; quotes doubled; NULL is empty."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\n]' if newline else '[",]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
