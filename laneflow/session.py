"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for. AQE coalesces small shuffle partitions
# and splits skewed join partitions, here from 64 MB on, as rows of one hot key
# compress well. RocksDB keeps streaming state off the heap;
# its change log makes each batch upload what changed rather than a snapshot,
# and state format 3 keeps a join's state in one store per partition.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; `conf` keys use `__` for `.`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Counting a store's rows takes a look-up before every write.
STATE = {k: v for k, v in RECOMMENDED.items() if k.startswith("spark.sql.streaming.")}
STATE |= {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


@contextmanager
def state_off_heap(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, its rows uncounted.

    That holds for what the session leaves open; with another state store nothing is
    set. A stream takes the settings of its session as it starts, and one that
    goes on from a checkpoint keeps the store it began with.
    """
    other = spark.conf.get(STATE_STORE, None) not in (None, STATE[STATE_STORE])
    unset = [key for key in STATE if not other and spark.conf.get(key, None) is None]
    for key in unset:
        spark.conf.set(key, STATE[key])
    try:
        yield
    finally:
        for key in unset:
            spark.conf.unset(key)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Only a local session may go without the setting; it then gets a folder of
    its own, since driver and executors share one machine there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="laneflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder; nothing exists there yet."""
    return f"{shared_folder(spark)}/laneflow/{purpose}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """`rows` written to a fresh shared path and read back.

    For a table that is used more than once: it is computed once, and a lost
    executor costs no more than reading a file again.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


PARTITIONS = "spark.laneflow.partitions"


def dealt(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """`rows` dealt out anew over `partitions`, or as they were read.

    A table of one Parquet row group is read by one task, however much work each
    row takes afterwards. Whoever knows the tables and the cluster can say how many tasks shall share
    it, here or for a session by `spark.laneflow.partitions`; nothing is dealt out unasked.
    """
    partitions = partitions or int(rows.sparkSession.conf.get(PARTITIONS, "0"))
    return rows.repartition(partitions) if partitions else rows


TASKS_PER_CORE = 2


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt out over all cores, two tasks to each, or as `spark.laneflow.partitions` says.

    For rows that become XML or are parsed from it: that takes far longer than
    moving them, whatever their number, and a scan has no more tasks than the
    files have row groups.
    """
    spark = rows.sparkSession
    asked = int(spark.conf.get(PARTITIONS, "0"))
    return dealt(rows, asked or TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
