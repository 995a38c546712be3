"""Sessions, and the shared folder in which lineage is cut.

``materialise`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and
reads it back, so that a lost executor costs a re-read, never a re-run of what
came before.  The folder is the cluster's; a local one is made only where the
setting is missing, as in tests.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def session(app: str = "voxtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local session may do without it and gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _own_dir.get(app) or _own_dir.setdefault(app, "file://" + tempfile.mkdtemp(prefix="voxtide-"))
    return where.rstrip("/") + "/voxtide-" + spark.sparkContext.applicationId


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
        if path.startswith("file://") and (own := os.path.dirname(path[7:])) in {x[7:] for x in _own_dir.values()}:
            os.rmdir(own)
    except Exception:  # the JVM is gone; the cluster's folder has its own expiry
        pass


def release(spark: SparkSession) -> None:
    """Delete all tables that ``materialise`` has written so far; results that still read them become unreadable."""
    base = shared_dir(spark)
    if base in _registered:
        drop_path(spark, base)


_registered: set[str] = set()


def materialise(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back, and its path for ``drop_path``."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if base not in _registered:
        _registered.add(base)
        atexit.register(_clean, spark, base)
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application, unless the workers' search path has it.

    The archive lies beside the driver only; Spark's own file server hands it out.
    """
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="voxtide-ship-")) / "voxtide.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    atexit.register(lambda: (target.unlink(missing_ok=True), target.parent.rmdir()))
