"""Files as sources: text of unknown encoding, RTF, DOCX, HTML; import records; CSV out.

Files are read with Spark's binaryFile source, so listing, splitting and retries are Spark's; decoding is a small helper per
file. PDF needs a library that is not here: texts with form feeds between pages are taken as already extracted.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import collapse, csv_field, guess_mime, is_supported, safe_name, strip_html

W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_text(data: bytes) -> str:
    """By byte order mark; else UTF-8 if it is well-formed; else Windows-1252."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


RTF = re.compile(r"\\u(-?\d+) ?(?:\\'[0-9a-fA-F]{2}|[^\\{}])?|\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([{}\\~_-])|([{}])|([^\\{}\r\n]+)")
SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "listtable"}


def decode_rtf(text: str) -> str:
    """Plain text of RTF: decimal \\u escapes, \\'hh bytes in Windows-1252, escaped braces; tables of fonts, colours and the like are left out."""
    out: list[str] = []
    depth, skip = 0, None
    for m in RTF.finditer(text):
        uni, byte, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            depth += 1
        elif brace == "}":
            depth -= 1
            if skip is not None and depth < skip:
                skip = None
        elif word in SKIPPED and skip is None:
            skip = depth
        elif skip is not None:
            continue
        elif uni is not None:
            out.append(chr(int(uni) % 65536))
        elif byte is not None:
            out.append(bytes([int(byte, 16)]).decode("cp1252", "replace"))
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif sign:
            out.append({"~": "\u00a0", "_": "-", "-": ""}.get(sign, sign))
        elif plain is not None:
            out.append(plain)
    return "".join(out)


def decode_docx(data: bytes) -> str:
    """Text of the body and of headers and footers, paragraphs apart by a blank line."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in ["word/document.xml", *sorted(x for x in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", x))] if n in z.namelist()]
        for name in names:
            for p in ElementTree.fromstring(z.read(name)).iter(f"{W_NS}p"):
                parts = []
                for e in p.iter():
                    if e.tag == f"{W_NS}t":
                        parts.append(e.text or "")
                    elif e.tag in (f"{W_NS}tab", f"{W_NS}br"):
                        parts.append("\t" if e.tag.endswith("tab") else "\n")
                out.append("".join(parts))
    return "\n\n".join(out)


def _text_of(data: bytes | None, mime: str) -> tuple[str | None, str | None]:
    try:
        if data is None:
            return None, "no content"
        if mime.endswith("wordprocessingml.document"):
            return decode_docx(data), None
        if mime == "application/rtf":
            return decode_rtf(decode_text(data)), None
        if mime in ("application/pdf", "application/msword"):
            return None, "no decoder for this format"
        return decode_text(data), None
    except Exception as e:  # noqa: BLE001 - a broken file is a result, not a crash
        return None, f"{type(e).__name__}: {e}"[:300]


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_text_of(d, m) for d, m in zip(batch.column("content").to_pylist(), batch.column("mime").to_pylist())]
        keep = [c for c in batch.schema.names if c != "content"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=[*keep, "raw", "error"])


def import_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: path, file_name, stored_name, mime, size_bytes, checksum, index_status (`Pending`, or `Failed` for formats without text), content.

    Files of no bytes do not appear: Spark's file sources pass over them (`import_listed` has a row for them).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    typed = raw.select("path", F.url_decode(name).alias("file_name"), F.col("length").alias("size_bytes"), "content").withColumn("mime", guess_mime("file_name"))
    checksum = F.sha2("content", 256)
    return typed.select(
        "path", "file_name", F.concat(F.substring(checksum, 1, 16), F.lit("_"), safe_name(F.col("file_name"))).alias("stored_name"), "mime", "size_bytes", checksum.alias("checksum"),
        F.when(is_supported("mime"), "Pending").otherwise("Failed").alias("index_status"), F.when(~is_supported("mime"), "format not supported").alias("index_error"), "content",
    )


def import_listed(spark: SparkSession, paths: DataFrame, folder: str) -> DataFrame:
    """Import records for the paths asked for (`paths`: path), one each: those of files under `folder`, and a `Failed` row for a path without content, be the file missing or of no bytes."""
    bare = lambda c: F.regexp_replace(F.url_decode(c), r"^file:/*", "/")
    have = import_records(spark, folder).withColumn("__path", bare(F.col("path"))).drop("path")
    asked = paths.select("path", bare(F.col("path")).alias("__path")).dropDuplicates(["__path"])
    name = F.element_at(F.split("__path", "/"), -1)
    out = asked.join(have, "__path", "left")
    missing = F.col("checksum").isNull()
    return out.select(
        "path", F.coalesce("file_name", name).alias("file_name"), "stored_name", F.coalesce("mime", guess_mime(name)).alias("mime"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"), "checksum",
        F.when(missing, "Failed").otherwise(F.col("index_status")).alias("index_status"), F.when(missing, "no such file, or nothing in it").otherwise(F.col("index_error")).alias("index_error"), "content",
    )


def extract(records: DataFrame) -> DataFrame:
    """Import records with text, pages (split at form feeds, trimmed; NULL without one), word_count and the outcome; broken files are `Failed` with the reason."""
    got = records.select("checksum", "file_name", "mime", "content").mapInArrow(_decoded, "checksum string, file_name string, mime string, raw string, error string")
    text = F.when(F.col("mime") == "text/html", strip_html("raw")).otherwise(F.col("raw"))
    out = got.withColumn("text", text)
    pages = F.when(F.contains(F.col("text"), F.lit("\f")), F.transform(F.split("text", "\f"), lambda p: F.trim(p)))
    blank = F.coalesce(collapse("text") == "", F.lit(True))
    return out.select(
        "checksum", "file_name", "mime", "text", pages.alias("pages"), F.when(~blank, F.size(F.split(collapse("text"), " "))).otherwise(0).alias("word_count"),
        F.when(F.col("error").isNotNull() | blank, "Failed").otherwise("Ready").alias("index_status"), F.coalesce("error", F.when(blank, F.lit("no text found"))).alias("index_error"),
    )


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """`line`: each row as CSV, quoted only where needed."""
    return df.select(*[c for c in df.columns], F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"))


def write_csv(df: DataFrame, columns: dict[str, str], folder: str) -> None:
    """One CSV file per task, with a header of labels."""
    df.select(*[F.col(c).alias(label) for c, label in columns.items()]).write.mode("errorifexists").option("header", True).option("escape", '"').csv(folder)
