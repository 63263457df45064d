"""Session helpers: shared storage for cutting lineage, and session creation for local use."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("voltrace")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; a
    cluster session is refused, as a machine-local folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        path = tempfile.mkdtemp(prefix="voltrace-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL_DIRS[app] = f"file://{path}"
    return _LOCAL_DIRS[app]


#: Tables that the innermost scratch() will delete, for each open one of this thread or task.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at, store = _store(spark, path)
    store.delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    at, store = _store(spark, path)
    store.mkdirs(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder of whatever store; none if it isn't there."""
    at, store = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str, *, new: bool = False) -> bool:
    """Write a small UTF-8 file in whatever store; with new, False and nothing written if it is there already.

    Of several writers of a new file one wins: local files are linked into place, which fails if the name is taken; other stores' create refuses a taken name.
    """
    at, store = _store(spark, path)
    if new and store.getScheme() == "file":
        target = at.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = os.path.join(os.path.dirname(target), f"_{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
        return True
    try:
        out = store.create(at, not new)
    except Py4JJavaError as error:
        if new and store.exists(at):
            return False
        raise error
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small UTF-8 file of whatever store."""
    at, store = _store(spark, path)
    source = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were materialized inside, but those to keep, at the end. What leaves it must not read them."""
    mine: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), mine))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in mine:
            delete(spark, path)


def materialize(df: DataFrame, tag: str, *, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    It cuts the lineage like checkpoint(), computes df only once, and gives the
    planner real sizes. A lost executor costs nothing: the files remain, inside
    scratch() until its end unless keep.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voltrace/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    open_ = _SCRATCH.get()
    if open_ and not keep:
        open_[-1].append(path)
    elif len(open_) > 1:
        open_[-2].append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "position", tag: str = "numbered") -> DataFrame:
    """Adds a row's position from 0 in the given order, which must be total for reruns to agree.

    Rows are dealt by ranges of the order; a position is the number within a part plus the rows of the parts before it, so no task holds all rows.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), tag)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    ahead = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("__part", F.coalesce(ahead, F.lit(0)).alias("__before"))  # a row for each part
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__within", within).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__within") + F.col("__before")).alias(name))


def _let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package even if the driver found it by sys.path alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


#: Rows of an Arrow batch: Spark's own default lets a batch of long texts hold tens of megabytes in the JVM and in Python at once.
BATCH_SETTING, BATCH_ROWS, SPARKS_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2048", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; the path may be in any store that Spark reads. Arrow batches become smaller unless the session sets their size."""
    _let_workers_import(spark)
    if spark.conf.get(BATCH_SETTING, SPARKS_BATCH_ROWS) == SPARKS_BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as the session has for shuffles. Groups that are fitted are slow for their bytes; partitions chosen by size would put many in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
