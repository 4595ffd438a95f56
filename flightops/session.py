"""Session construction and the shared scratch folder.

Jobs that must cut lineage or land intermediate files write below the folder the
cluster names in ``spark.checkpoint.dir``. Only when the session has none (local runs,
tests) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every flightops session relies on. Times in the data are naive UTC wall
# times (TIMESTAMP_NTZ); parsing text times goes through the session zone, so pin UTC.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state beyond an executor's heap (de-duplication keys of three days)
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Partitions that a shuffle starts with, and the bytes (compressed) up to which AQE puts them
#: together. A count that is fixed, or a size near a core's share of memory, lets each task's sort
#: grow until it spills.
FIRST_PARTITIONS, PARTITION_BYTES = 2048, 16 << 20
#: Bytes of a file read by one task: aggregates that sort before the exchange sort that many.
SPLIT_BYTES = 32 << 20
#: What opening a file counts as, in bytes: small files share a task, so that a shuffle's blocks
#: hold enough rows to compress.
OPEN_BYTES = 1 << 20
_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_SPLIT = "spark.sql.files.maxPartitionBytes"
_OPEN = "spark.sql.files.openCostInBytes"
#: Exchanged rows go with the statement that made them. Else they stay until the driver happens to collect its
#: garbage, and a run of many statements holds the exchanges of all.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: State of de-duplication and stream joins grows with a backlog: beside the heap, within bounds.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": BASE_CONF["spark.sql.streaming.stateStore.providerClass"],
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    # a count for the progress report, which costs a look-up for each row put
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
_GIVEN: dict[str, dict[str, str | None]] = {}


def size_partitions(spark: SparkSession, small: bool) -> None:
    """Shuffles make partitions of ``PARTITION_BYTES`` from ``FIRST_PARTITIONS`` (more, where the
    session has more), files are read in ``SPLIT_BYTES``, exchanged rows are removed with their statement,
    and streams keep their state beside the heap; not ``small``: as the session came."""
    given = _GIVEN.setdefault(spark.sparkContext.applicationId, {
        k: spark.conf.get(k, None) for k in (_FIRST, _BYTES, _SPLIT, _OPEN, _CLEAN, *_STATE)})
    wanted = given
    if small:
        own = given[_FIRST] or spark.conf.get("spark.sql.shuffle.partitions")
        wanted = {_FIRST: str(max(FIRST_PARTITIONS, int(own))), _BYTES: str(PARTITION_BYTES), _SPLIT: str(SPLIT_BYTES),
                  _OPEN: str(OPEN_BYTES), _CLEAN: "true", **_STATE}
    for key, value in wanted.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def build_session(
    master: str | None = None,
    app_name: str = "flightops",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the flightops defaults.

    ``shuffle_partitions`` should follow the data: about total shuffle bytes / 128 MB on a
    cluster (AQE coalesces small ones), the core count on a laptop.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application.

    Uses the checkpoint directory of the running context (set from ``spark.checkpoint.dir``
    or by ``setCheckpointDir``); if none is configured, a local master gets a temporary one,
    and any other master an error: executors couldn't read the driver's own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="flightops-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")


def new_scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh, unique path below the scratch root (not created; writers create it)."""
    return f"{scratch_root(spark)}/flightops/{tag}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for code that must touch the local file system (tests)."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
