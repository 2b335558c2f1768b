"""Tables: reading, spreading small ones over all cores, and stage tables written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset, which is allowed in local mode alone.
LOCAL_SCRATCH = "/tmp/checkpoints/textloom"
GIVE_BACK = 32 << 20
#: After so many stage tables the driver collects its garbage, as otherwise its heap grows to its bound over the many small jobs of a loop, and no memory goes back to the system.
TABLES = 4
_since = 0
_folders: dict[str, str] = {}
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; removed when the driver exits."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = LOCAL_SCRATCH
        _folders[app] = f"{top.rstrip('/')}/textloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _folders[app])
    return _folders[app]


def remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm if spark.sparkContext._jsc else None
    if jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, lineage cut, safe against lost executors."""
    global _since
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    _since += 1
    if _since >= TABLES:
        drop_shuffles(df.sparkSession)
    return out


def release(*tables: DataFrame) -> None:
    """Removes stage tables that nothing will read any more; what was made from them has to be written before."""
    for df in tables:
        if path := _written.pop(df, None):
            remove(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished rounds: it does so when the driver's JVM finds that nothing refers to them, which may be long after."""
    global _since
    _since = 0
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def given_back(batches):
    """Passes batches on, and what they held back to the system: at the end, and before that each time about GIVE_BACK bytes have gone through."""
    through = 0
    for batch in batches:
        through += batch.nbytes
        yield batch
        del batch
        if through > GIVE_BACK:
            give_back()
            through = 0
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if Spark's estimate of its size leaves them less than a file split each, as a file of one row group is one task; larger tables stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if size < cores * split else df
