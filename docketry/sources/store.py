"""A store of passages and vectors in Parquet: snapshots with a pointer, checked content, replacement by document.

A write goes to a new snapshot folder; a new pointer file of the next version makes it current, so readers see the old or the new state.
Rows carry a checksum; damaged documents are reported, not dropped silently.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.consistency import replace_documents


def checksum(vector: str = "embedding", text: str = "text") -> Column:
    return F.xxhash64(text, vector)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(version, snapshot folder) of the complete pointers, newest first. A pointer that is being written has no line end yet and does not count."""
    fs, path = _fs(spark, root)
    found = fs.globStatus(path(f"{root}/CURRENT-*")) or []
    out = []
    for status in found:
        stream = fs.open(status.getPath())
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text.endswith("\n"):
            out.append((int(status.getPath().getName().rsplit("-", 1)[1]), text.strip()))
    return sorted(out, reverse=True)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current snapshot; None for a new store."""
    found = _pointers(spark, root)
    return found[0][1] if found else None


def write_snapshot(df: DataFrame, root: str, after: int | None = None) -> str:
    """Write rows (document_id, chunk_id, text, embedding, ...) as the new current snapshot, spread by document; returns its folder.

    Pointers are files of rising versions, created and never changed or deleted by a writer: the highest wins, so a reader sees
    the old or the new state at any moment. `after`: the version the rows were made from; if another writer was quicker, the
    version exists already and FileExistsError is raised, nothing of the other's being lost. Files follow the size of the rows.
    """
    spark = df.sparkSession
    fs, path = _fs(spark, root)
    version = (after if after is not None else max((v for v, _ in _pointers(spark, root)), default=0)) + 1
    folder = f"{root}/snapshot-{uuid.uuid4().hex}"
    df.withColumn("checksum", checksum()).repartition("document_id", "chunk_id").write.parquet(folder)
    _point(fs, path, root, version, folder)
    return folder


def _point(fs, path, root: str, version: int, folder: str) -> None:
    pointer = path(f"{root}/CURRENT-{version:012d}")
    if fs.exists(pointer):
        raise FileExistsError(f"version {version} of {root} was written by another")
    out = fs.create(pointer, False)
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()


def tidy(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete snapshots and pointers older than the newest `keep`, and snapshots no pointer names (writers that died); returns the folders deleted. Run it while nobody writes."""
    fs, path = _fs(spark, root)
    found = _pointers(spark, root)
    kept = {folder.rsplit("/", 1)[1] for _, folder in found[:keep]}
    gone = [s.getPath() for s in (fs.globStatus(path(f"{root}/snapshot-*")) or []) if s.getPath().getName() not in kept]
    for v, _ in found[keep:]:
        fs.delete(path(f"{root}/CURRENT-{v:012d}"), False)
    for p in gone:
        fs.delete(p, True)
    return [p.getName() for p in gone]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows of the current snapshot with `intact`: whether the content still has its checksum."""
    folder = current(spark, root)
    return None if folder is None else spark.read.parquet(folder).withColumn("intact", F.col("checksum") == checksum())


def corrupt_documents(store: DataFrame) -> DataFrame:
    return store.filter("NOT coalesce(intact, false)").select("document_id").distinct()


def replace(spark: SparkSession, root: str, new: DataFrame) -> str:
    """A new snapshot in which the documents of `new` are replaced; vectors that are zero, NULL or not finite are left out."""
    from docketry.operators.vectors import norm

    usable = new.filter((norm("embedding") > 0) & (norm("embedding") < float("inf")))
    return _changed(spark, root, lambda old: usable if old is None else replace_documents(old.select(*usable.columns), usable))


def _changed(spark: SparkSession, root: str, change) -> str:
    """A new snapshot made from the rows of the current one (None: a new store)."""
    found = _pointers(spark, root)
    old = spark.read.parquet(found[0][1]).drop("checksum") if found else None
    return write_snapshot(change(old), root, found[0][0] if found else 0)


def remove_documents(spark: SparkSession, root: str, gone: DataFrame) -> str:
    """A new snapshot without the documents of `gone` (document_id)."""
    return _changed(spark, root, lambda old: old.join(gone.select("document_id").distinct(), "document_id", "left_anti"))


def set_case(spark: SparkSession, root: str, cases: DataFrame) -> str:
    """A new snapshot in which the documents of `cases` (document_id, case_id) carry that case; NULL takes them out of theirs."""
    new = cases.select("document_id", F.col("case_id").alias("__case"), F.lit(True).alias("__set")).dropDuplicates(["document_id"])
    return _changed(spark, root, lambda old: old.join(new, "document_id", "left").withColumn("case_id", F.when(F.col("__set"), F.col("__case")).otherwise(F.col("case_id"))).select(*old.columns))


def _floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [None if b is None or len(b) % 4 else list(struct.unpack(f"<{len(b) // 4}f", b)) for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["chunk_id", "embedding"])


def from_blobs(blobs: DataFrame) -> DataFrame:
    """Vectors stored as little-endian 32-bit floats (chunk_id, vector) as arrays; NULL for a length that is no multiple of four."""
    return blobs.select("chunk_id", "vector").mapInArrow(_floats, "chunk_id string, embedding array<float>")


def migrate(chunks: DataFrame, blobs: DataFrame, files: DataFrame) -> DataFrame:
    """Passages of Ready documents with their vectors, from the two tables of an older store; each passage once, however often it was migrated before."""
    ready = files.filter("index_status = 'Ready'").select(F.col("id").alias("document_id")).distinct()
    return chunks.dropDuplicates(["chunk_id"]).join(ready, "document_id", "left_semi").join(from_blobs(blobs).filter("embedding IS NOT NULL").dropDuplicates(["chunk_id"]), "chunk_id")


def commit_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int | None = None) -> str:
    """Write several tables (passages, keywords, the catalogue with its Ready flags) as one new snapshot: a reader sees all of them new or all of them old."""
    fs, path = _fs(spark, root)
    version = (after if after is not None else max((v for v, _ in _pointers(spark, root)), default=0)) + 1
    folder = f"{root}/snapshot-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    _point(fs, path, root, version, folder)
    return folder


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """One table of the current snapshot of several; None for a new store."""
    folder = current(spark, root)
    return None if folder is None else spark.read.parquet(f"{folder}/{name}")
