"""Session defaults and the few storage helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "vitrail", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine: tests and the benchmark. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers; on one machine only where they wouldn't find it by PYTHONPATH or the working folder."""
    app, package = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    found = any(Path(p or ".").resolve() == package.parent for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)])
    if found and one_machine(spark):
        return
    target = Path(tempfile.mkdtemp(prefix="vitrail-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so share every folder."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


#: Folders made for sessions without one, and paths below the shared folder that are still there, by application.
_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on one machine (tests) may it be unset: a temporary folder is made then. On a cluster that would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="vitrail-shared-")
        root = _OWN[app]
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; it is removed when an `interim` block that it was made in, or the program, ends."""
    path = f"{shared_root(spark)}/vitrail-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(_remove, spark, _MADE[app], 0)
    return _MADE[app]


@contextmanager
def interim(spark: SparkSession) -> Iterator[None]:
    """Shared paths made inside are removed at the end: what is to stay is written to a path made before."""
    made = _made(spark)
    first = len(made)
    try:
        yield
    finally:
        _remove(spark, made, first)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a shared path that nothing reads any more."""
    if path in _made(spark):
        _made(spark).remove(path)
        _remove(spark, [path], 0)


def _remove(spark: SparkSession, paths: list[str], first: int) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths[first:]:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    except Exception:  # the JVM may be gone by now
        pass
    del paths[first:]


def materialize(df: DataFrame, what: str, path: str | None = None, files: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the later stages only, and rows are computed once however
    often the result is used. files: rows are dealt evenly to so many files, however many partitions `df` has. That is for narrow tables:
    on a local disk Hadoop starts two `chmod` processes for each file, and one that is starting counts the JVM's memory twice.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, what)
    (df.repartition(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
