"""Size checks: what may be broadcast, and where checkpoints go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def estimated_bytes(frame: DataFrame) -> int:
    """The optimizer's size estimate; for scans, filters, projections and aggregates an upper bound taken from the
    file sizes, for joins a gross overestimate."""
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits(*frames: DataFrame) -> bool:
    """Whether each frame is within the session's own broadcast threshold."""
    limit = int(frames[0].sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return limit > 0 and all(estimated_bytes(frame) <= limit for frame in frames)


def broadcast_if(frame: DataFrame, *bounds: DataFrame) -> DataFrame:
    """The frame, marked for broadcast when the frames that bound its row count fit; else left to shuffle joins."""
    return F.broadcast(frame) if fits(*bounds) else frame


def within(frame: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column lies between the least and the greatest of the keys. Both are looked up when the query runs and
    reach the scan as literals, so files and row groups beyond them are not read. Each is a query of its own, of one row:
    the optimizer would make one of two aggregates, whose fields it does not push."""
    named = keys.where(F.col(key).isNotNull()).select(key)
    low, high = (named.orderBy(order).limit(1).scalar() for order in (F.asc(key), F.desc(key)))
    return frame.where((F.col(column) >= low) & (F.col(column) <= high))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the session names; a session of one machine without one gets its own, which goes when
    Python ends."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallygrid-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, for tables that outlive a query's plan."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/tables-{uuid.uuid4().hex}"
