"""Session, scratch storage and small helpers that all operators share."""

from __future__ import annotations

import os
import site
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, app: str = "spanwise", **conf: str) -> SparkSession:
    """A session with the settings the operators expect.  Values in *conf* win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that would not find it by themselves.

    On one machine they find it by PYTHONPATH, the working folder or the site packages; where they do not,
    and on a cluster unless it is installed, the package's source goes along as a zip file, once.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    found = [*site.getsitepackages(), site.getusersitepackages()]
    if sc.master.startswith("local"):
        found += os.environ.get("PYTHONPATH", "").split(os.pathsep)
        if not sc.master.startswith("local-cluster"):
            found.append(os.getcwd())
    if sc.applicationId in _shipped or root in {Path(p).resolve() for p in found if p}:
        return
    target = Path(tempfile.mkdtemp(prefix="spanwise-code-")) / "spanwise.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "spanwise").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """*query*, which first sees to it that workers find this package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (tests, one machine) a temporary folder of our own takes its place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanwise-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spanwise-{sc.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Write *df* once to the shared folder and read it back: cuts the lineage,
    survives the loss of executors, and lets two consumers share one scan."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote."""
    jvm, path = spark.sparkContext._jvm, scratch_dir(spark)
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def add_up(condition: Column) -> Column:
    """Number of rows for which *condition* is true (0, not NULL, for none)."""
    return F.count(F.when(condition, 1))


def parallelism(spark: SparkSession) -> int:
    """Tasks worth making for CPU-bound Python stages."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
