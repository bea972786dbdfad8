"""Session helpers shared by the operators: the table reader and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that their Python can import it."""
    sc = spark.sparkContext
    if "stratadoc.zip" not in {Path(f).name for f in sc._python_includes}:
        top = Path(__file__).parent
        to = Path(tempfile.mkdtemp(prefix="spark-")) / "stratadoc"
        shutil.copytree(top, to / top.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(to), "zip", to, top.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any store it knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files are fewer than cores; as it is otherwise.

    The number of read partitions doesn't say enough: a file of one row group has as many as its size asks for, all but
    one of them empty.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= n else df.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a folder of its own under the temp folder; on a cluster that
    would be a different disk on every machine, so there it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written inside is read from its table later on, so the shuffles that made it are deleted at its end; they
    would stay for as long as the driver has no need to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: Scratch tables of this process, by application.
_SCRATCH: dict[str, list[str]] = {}


def saved(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes df to the shared folder, with the writer's options, and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    with shuffles_end(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made inside are deleted at the end: what is to stay has been written elsewhere by then."""
    own = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    try:
        with shuffles_end(spark):
            yield
    finally:
        _delete(spark, own[before:])
        del own[before:]


def forget(spark: SparkSession) -> int:
    """Deletes the scratch tables that saved() has made in this application, once no result that reads them is wanted any
    more; tables that the caller named a folder for stay. Returns how many there were."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)
