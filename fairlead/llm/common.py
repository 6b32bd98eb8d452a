"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode (tests) a temporary one where it is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fairlead-"))
    return context.getCheckpointDir()


_scope: ContextVar[list[str] | None] = ContextVar("passing", default=None)
_CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, passing: bool = False) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder as Parquet and read again, and its path; unlike a checkpoint, by column.

    Its shuffle files go when it is written. ``passing`` ones are held only by what their operator returns: in a ``swept`` block
    they go at its end.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    if passing and _scope.get() is not None:
        _scope.get().append(path)
    return df.sparkSession.read.parquet(path), path


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is stored in passing inside, by this thread, is deleted at the end: the results of the operators have then been written."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in mine:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` wrote, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def redealt(column: str) -> Column:
    """The long key under an expression the planner can't see through: both sides of a join on it are
    exchanged by the join itself, so that adaptive execution may split a hot key's partition."""
    return F.col(column).bitwiseXOR(F.lit(0).cast("long"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it in ``body`` as often as wanted."""
    return F.transform(F.array(value), body)[0]


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8 (bytes.split and bytes.lower know ASCII only, as wanted)."""
    return text.encode().lower().split() if text else []


def unsigned_crc32_text(column: Column) -> Column:
    return F.crc32(F.encode(column, "UTF-8"))
