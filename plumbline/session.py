"""Session settings and shared storage used by the operators."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()
_scopes: list[list[tuple[SparkSession, str]]] = []


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return ship_code(builder.getOrCreate())


def ship_code(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python workers this package, once per context; the driver hands it out by its file server."""
    context = spark.sparkContext
    if not getattr(context, "_plumbline_shipped", False):
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / "plumbline.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(home.rglob("*.py")):
                z.write(source, source.relative_to(home.parent))
        context.addPyFile(str(archive))
        context._plumbline_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the session names none (local tests) a temporary folder is made and set; a session on a cluster
    without the setting is an error, since a machine-local folder would lose data with the machine.
    """
    jsc = spark.sparkContext._jsc.sc()
    held = jsc.getCheckpointDir()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    Cuts the lineage, keeps columns prunable, survives the loss of any executor. The files are removed when this
    process ends, or the scope() in which they were written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{os.getpid()}-{next(_serial)}-{uuid.uuid4().hex[:8]}-{label}"
    schema = df.schema
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables that are written within this block are removed at its end and not only with the process: for
    sessions that live long. Collect or write the results inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already
        pass


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether `df` has at most `bound` rows; counts no further than that."""
    return df.limit(bound + 1).count() <= bound
