"""Tables in the folder that all executors share, and distributed numbering."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places of tables that ``land`` made and that ``sweep`` may delete.
LANDED: list[str] = []

#: Rows up to which a side of a join is broadcast; beyond, both are shuffled.
BROADCAST_ROWS = 200_000

#: For queries that this package runs itself: shuffle files go when the query that
#: made them ends, and not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the queries that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and the
    executors are threads of this machine's one process."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.isLocal:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hopweave-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def land(spark: SparkSession, df: DataFrame, name: str, narrow: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and a
    lost executor only costs the tasks that were running on it.  ``narrow``
    tables (a few numbers a row) go to as few files as their size asks for.
    ``keep`` saves the table from ``sweep``."""
    if narrow:
        df = df.hint("rebalance")
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, TIDY):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._landed_path = path
    if not keep:
        LANDED.append(path)
    return back


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a landed table that nothing reads any more."""
    path = getattr(df, "_landed_path", None)
    if path:
        delete(spark, path)
        if path in LANDED:
            LANDED.remove(path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables landed so far but those to keep; results that have not
    been computed yet must not depend on them.  The driver's garbage goes as well:
    only then does Spark drop the broadcasts and shuffles of finished queries."""
    while LANDED:
        delete(spark, LANDED.pop())
    release(spark)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, in loops of many queries, and hand what is free
    outside its heap back to the system: plans, compilers and networking leave
    hundreds of MB there over many queries, which no collection returns."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> str | None:
    """What the JVM says to a trim of its native heap; None where it has no such command."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    java = jvm.java.lang
    array = lambda kind, *items: _filled(gateway.new_array(kind, len(items)), items)
    try:
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        none, names = array(java.Object), array(java.String)
        # By the interface: the server's own class is not open to calls from outside its module.
        kinds = array(java.Class, command.getClass(), java.Class.forName("java.lang.String"), none.getClass(), names.getClass())
        invoke = java.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        return invoke.invoke(server, array(java.Object, command, "systemTrimNativeHeap", none, names))
    except Py4JJavaError:
        return None


def _filled(array, items):
    for i, x in enumerate(items):
        array[i] = x
    return array


def small(df: DataFrame, rows: int) -> DataFrame:
    """A join side, broadcast when its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(spark: SparkSession, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: its rows' places, from 0, in a total order.

    A distributed sort, a local count per partition and one offset per partition
    (that many rows come to the driver); no window over all rows.
    """
    placed = land(spark, df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"])
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["count"]
    shift = spark.createDataFrame(offsets, "__part long, __offset long")
    local = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(shift), part == F.col("__part")).withColumn(name, F.col("__offset") + local).drop("__at", "__part", "__offset")
