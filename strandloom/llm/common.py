"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder and runs in one process, as in local tests.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"
#: This process's folder in the shared one.
RUN = uuid.uuid4().hex
#: A join's keys with more than this share of its rows are dealt over several tasks: fewer than its inverse, which stand in the plan.
HOT_SHARE = 1 / 500
LEAST_HOT = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one only in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or LOCAL_CHECKPOINT_DIR)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    What was computed once is not computed again by later branches, and a lost executor costs a re-read
    and no recomputation. ``release`` deletes a table; what is left goes when the driver's process ends.
    """
    spark = df.sparkSession
    run = f"{shared_dir(spark)}/{RUN}"
    path = f"{run}/{uuid.uuid4().hex}"
    atexit.unregister(_delete)
    atexit.register(_delete, spark, run)
    df.write.parquet(path)
    trim_jvm(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # the JVM may have gone before the process
        pass


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table._cut_at)


def hot_keys(sizes: DataFrame, key: str, count: str) -> dict[int, int]:
    """Hash -> parts of the keys that hold more than ``HOT_SHARE`` of the rows that ``sizes`` counts.

    There are fewer than ``1 / HOT_SHARE`` of them, whatever the table's size.
    """
    seen = sizes.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    floor = max(LEAST_HOT, int((seen["total"] or 0) * HOT_SHARE))
    if (seen["most"] or 0) <= floor:
        return {}
    hot = sizes.where(F.col(count) > floor).select(F.xxhash64(key).alias("h"), F.ceil(F.col(count) / F.lit(floor)).cast("long").alias("parts"))
    return {r["h"]: r["parts"] for r in hot.collect()}


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str, by: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key`` and in ``count`` the number of left rows that have it.

    Rows of a hot key are dealt over tasks by a hash of ``by``, and its one right row is copied to each. The plan is
    the same whether a key is hot or not; the few hot ones stand in it as values.
    """
    salt = free_name(left, "salt")
    hot = hot_keys(right, key, count) or {0: 1}
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair]), F.xxhash64(key)), F.lit(1).cast("long"))
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(by), parts))
    several = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(several, [key, salt], how).drop(salt)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (in either case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers wait for the next one and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def trim_jvm(spark: SparkSession) -> str | None:
    """Return freed native memory of the driver's JVM to the system, as ``jcmd System.trim_native_heap`` does; what it says, None where it can't.

    A driver that plans and compiles many queries frees as much in many threads, and the GNU library would keep it, beside the heap.
    """
    try:
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        # The server's own class isn't open to calls from outside its module, its interface is.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # another system or an older Java
        return None
