"""Session and checkpoint helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "docketry", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session with AQE, UTC and Arrow; for tests and the bench. A cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder (`<base>/<name>.parquet`, a file or a folder of files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


_LOCAL: dict[str, str] = {}
_SCOPES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`); a fresh temporary one, the same for the whole application, only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='docketry-')}"
    return _LOCAL[app]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What `cut` writes inside the block lies in one folder of the shared one, which goes when the block ends: consume results inside."""
    folder = f"{shared_dir(spark)}/docketry-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        _delete(spark, folder)


def _at_exit(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # noqa: BLE001 - the JVM may be gone; a folder left behind is all that can happen
        pass


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder, so that later reads neither recompute it nor depend on an executor.

    It lies in the folder of the innermost `scratch` block, else in one of the application that goes when Python ends.
    """
    spark = df.sparkSession
    if _SCOPES:
        base = _SCOPES[-1]
    else:
        base = f"{shared_dir(spark)}/docketry-{spark.sparkContext.applicationId}"
        if base not in _KNOWN:
            _KNOWN.add(base)
            atexit.register(_at_exit, spark, base)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KNOWN: set[str] = set()
#: Tables of up to so many rows are broadcast by `few`.
FEW = 100_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """`df`, a table that is written already, marked for a broadcast if it has at most `most` rows; a larger one is left to Spark's own choice of join."""
    return F.broadcast(df) if df.count() <= most else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it by its own search path only.

    Nothing to do where the folder is on PYTHONPATH or is the working folder, as workers inherit both. Else the package goes out
    once as a zip through Spark's own file service, from the driver to every executor.
    """
    import os
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    root = package.parent
    here = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    sc = spark.sparkContext
    if root in here or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="docketry-code-")
    sc.addPyFile(shutil.make_archive(f"{folder}/docketry", "zip", root, package.name))
