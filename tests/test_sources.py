import io
import struct
import zipfile

from pyspark.sql import functions as F

from docketry.sources import files, store
from docketry.streaming import folds

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{a}</w:t><w:tab/><w:t>{b}</w:t></w:r></w:p>" for a, b in paragraphs)
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def test_decoders():
    assert files.decode_text("réu".encode()) == "réu" and files.decode_text("réu".encode("cp1252")) == "réu"
    assert files.decode_text(b"\xff\xfe" + "aé".encode("utf-16-le")) == "aé"
    assert files.decode_rtf(r"{\rtf1{\fonttbl{\f0 Arial;}}caf\'e9 \u233? a\{b\}\par next}") == "café é a{b}\nnext"
    assert files.decode_docx(docx(("one", "two"), ("x", "y"))) == "one\ttwo\n\nx\ty\n\nHead"


def test_import_and_extract(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a b.txt").write_bytes("um réu\n".encode())
    (d / "p.html").write_text("<head>x</head><p>hi</p>")
    (d / "w.docx").write_bytes(docx(("one", "two")))
    (d / "broken.docx").write_bytes(b"no zip")
    (d / "empty.txt").write_bytes(b" \n")
    (d / "m.msg").write_bytes(b"x")
    rec = files.import_records(spark, str(d)).cache()
    assert rec.filter("file_name = 'm.msg' AND index_status = 'Failed'").count() == 1
    assert rec.filter("file_name = 'a b.txt'").first().stored_name.endswith("_a_b.txt")
    got = {r.file_name: r for r in files.extract(rec.filter("index_status = 'Pending'")).collect()}
    assert got["a b.txt"].text == "um réu\n" and got["p.html"].text == "hi" and got["w.docx"].word_count == 3
    assert got["broken.docx"].index_status == "Failed" and got["empty.txt"].index_error == "no text found"


def test_store_replaces_documents_and_reports_damage(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    kind = "document_id string, chunk_id string, text string, embedding array<float>"
    store.replace(spark, root, spark.createDataFrame([("a", "a:0", "one", [1.0, 0.0]), ("b", "b:0", "two", [0.0, 1.0]), ("z", "z:0", "zero", [0.0, 0.0])], kind))
    first = store.current(spark, root)
    store.replace(spark, root, spark.createDataFrame([("a", "a:0", "new", [1.0, 1.0])], kind))
    rows = store.read_snapshot(spark, root)
    assert {(r.document_id, r.text, r.intact) for r in rows.collect()} == {("a", "new", True), ("b", "two", True)}
    assert store.current(spark, root) != first
    hurt = rows.drop("intact").withColumn("text", F.when(F.col("document_id") == "b", "changed").otherwise(F.col("text"))).withColumn("intact", F.col("checksum") == store.checksum())
    assert [r.document_id for r in store.corrupt_documents(hurt).collect()] == ["b"]


def test_migration_of_blobs(spark):
    blob = spark.createDataFrame([("a:0", struct.pack("<2f", 1.0, 2.0)), ("a:1", b"abc"), ("b:0", None)], "chunk_id string, vector binary")
    chunks = spark.createDataFrame([("a:0", "a"), ("a:1", "a"), ("c:0", "c")], "chunk_id string, document_id string")
    ready = spark.createDataFrame([("a", "Ready"), ("c", "Failed")], "id string, index_status string")
    assert [(r.chunk_id, r.embedding) for r in store.migrate(chunks, blob, ready).collect()] == [("a:0", [1.0, 2.0])]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok', None), ("a,b", "x")], "t string, u string")
    files.write_csv(df, {"t": "Text", "u": "Other"}, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert back.columns == ["Text", "Other"] and {r.Text for r in back.collect()} == {'say "hi", ok', "a,b"}


def test_ingestion_stream_takes_each_file_once(spark, tmp_path):
    schema = "document_id string, text string, pages array<string>"
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    for k in range(2):
        spark.createDataFrame([(f"d{k}", "some text. " * 300, None)], schema).coalesce(1).write.mode("append").parquet(src)
        q = folds.ingest(spark.readStream.schema(schema).parquet(src), out, f"{tmp_path}/cp")
        q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.select("document_id").distinct().count() == 2 and got.groupBy("chunk_id").count().filter("count > 1").count() == 0


def test_windowed_counts_run_as_a_stream(spark, tmp_path):
    src = f"{tmp_path}/ev"
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 07:00:00", "b")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string").parquet(src)
    q = folds.windowed_counts(stream, "ts", "6 hours", "1 hour", "k").writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.n) for r in spark.sql("SELECT k, n FROM wc").collect()} == {("a", 2), ("b", 1)}


def test_folds_with_ties_and_nulls(spark):
    ev = spark.createDataFrame([("d", 1, "Indexing"), ("d", 2, "Complete"), ("e", 1, "Indexing"), (None, 9, "Indexing")], "doc string, seq int, status string")
    assert [r.doc for r in folds.progress(ev, "doc", ["seq"], "status", ("Indexing",)).collect()] == ["e"]
    st = spark.createDataFrame([("r", 1, "mentions", "done"), ("r", 2, "embed", "skipped"), ("r", 3, "search", "active"), ("r", 4, "dance", "active")], "run string, seq int, step string, state string")
    assert [r.state for r in folds.step_states(st, "run", "step", "state", ["seq"]).orderBy("step_no").collect()] == ["done", "skipped", "active", "pending", "pending"]


def test_a_reader_never_sees_an_empty_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = lambda *ids: spark.createDataFrame([(i, f"{i}:0", "text", [1.0, 2.0], "c1") for i in ids], "document_id string, chunk_id string, text string, embedding array<double>, case_id string")
    store.write_snapshot(rows("a", "b"), root)
    pointer = tmp_path / "store" / "CURRENT-000000000002"
    pointer.write_text("half a na")  # a writer that died while writing its pointer
    assert {r.document_id for r in store.read_snapshot(spark, root).collect()} == {"a", "b"}
    pointer.unlink()
    store.replace(spark, root, rows("b", "c"))
    assert {r.document_id for r in store.read_snapshot(spark, root).collect()} == {"a", "b", "c"}
    assert (tmp_path / "store" / "CURRENT-000000000001").exists()  # the old state stays readable
    import pytest

    with pytest.raises(FileExistsError):
        store.write_snapshot(rows("x"), root, after=1)
    store.set_case(spark, root, spark.createDataFrame([("a", None), ("b", "c9")], "document_id string, case_id string"))
    assert {(r.document_id, r.case_id) for r in store.read_snapshot(spark, root).collect()} == {("a", None), ("b", "c9"), ("c", "c1")}
    store.remove_documents(spark, root, spark.createDataFrame([("c",)], "document_id string"))
    assert {r.document_id for r in store.read_snapshot(spark, root).collect()} == {"a", "b"}
    assert len(store.tidy(spark, root, 1)) == 4 and store.read_snapshot(spark, root).count() == 2 and store.corrupt_documents(store.read_snapshot(spark, root)).count() == 0


def test_listed_files_that_are_missing_or_empty_fail(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.txt", "b.txt", "c.txt")], "path string")
    got = {r.file_name: (r.index_status, r.size_bytes) for r in files.import_listed(spark, paths, str(tmp_path)).collect()}
    assert got == {"a.txt": ("Pending", 5), "b.txt": ("Failed", 0), "c.txt": ("Failed", 0)}


def test_a_session_without_a_shared_folder_keeps_one_of_its_own(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = "from docketry.session import build_session, cut, shared_dir; s = build_session('x', 'local[1]', 1); d = shared_dir(s); assert d == shared_dir(s) and d.startswith('file:'); print(cut(s.range(3).toDF('x')).count())"
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("3"), out.stderr[-2000:]


def test_several_tables_change_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    assert store.read_table(spark, root, "files") is None
    for n in (1, 2):
        store.commit_tables(spark, root, {"files": spark.range(n).toDF("id"), "passages": spark.range(n * 10).toDF("id")})
        assert (store.read_table(spark, root, "files").count(), store.read_table(spark, root, "passages").count()) == (n, n * 10)
