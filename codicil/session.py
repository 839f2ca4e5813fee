"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import pathlib
import tempfile
import uuid
import warnings
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "codicil", cores: str = "*") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CODICIL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each context, so that none needs it on its path."""
    sc = spark.sparkContext
    if not getattr(sc, "_codicil_shipped", False):
        root = pathlib.Path(__file__).resolve().parent
        path = pathlib.Path(tempfile.mkdtemp(prefix="codicil-")) / "codicil.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))  # the driver serves it from here to all workers
        sc._codicil_shipped = True
    return spark


_warned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent and the master is local (tests), a temporary
    folder is used; on a cluster without the setting this is an error, since a
    machine-local folder would not survive there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path and not sc.master.startswith("local") and (path.startswith("file:") or "://" not in path) and path not in _warned:
        _warned.add(path)
        warnings.warn(f"spark.checkpoint.dir is {path}: on a cluster it must be a folder that all executors share", stacklevel=2)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="codicil-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_open: list[list[str]] = []


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it once as Parquet to the shared folder and read it back.

    Unlike a cache this survives the loss of executors, and its rows, order of
    partitions and generated ids are fixed from here on. The folder is removed at
    the end of the innermost ``scope``, or else when the application ends.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/codicil-{spark.sparkContext.applicationId}"
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    elif base not in _left:
        _left.add(base)
        atexit.register(_remove, spark, base)
    return spark.read.schema(df.schema).parquet(path)


_left: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:  # a context that was stopped before can't remove any more
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the end of an application must not fail for its leftovers
            pass


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is made durable within is removed at the end; results must have been written or collected by then."""
    mine: list[str] = []
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        for path in mine:
            _remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_tag and release_no (0, 1, ... by version number) of the ready releases.

    The release register is a list of versions of the whole corpus; it is read
    to number its rows, and more than ``10_000`` versions are refused.
    """
    from pyspark.sql import functions as F

    tags = [
        r[0]
        for r in table(spark, sf_dir, "corpus_releases")
        .where(F.col("import_state") == "ready")
        .select("release_tag").distinct().limit(10_001).collect()
        if r[0] is not None
    ]
    if len(tags) > 10_000:
        raise ValueError("more than 10,000 releases")
    tags.sort(key=version_key)
    return spark.createDataFrame([(t, i) for i, t in enumerate(tags)], "release_tag string, release_no int")


def version_key(tag: str) -> tuple:
    """corpus-v0.10.1 sorts after corpus-v0.9.0; tags of another form come first, by their text."""
    import re

    m = re.fullmatch(r"corpus-v(\d+)\.(\d+)\.(\d+)", tag)
    return (1, *map(int, m.groups()), tag) if m else (0, 0, 0, 0, tag)
