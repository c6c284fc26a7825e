"""What the operators of this folder have in common: reading, shipping code, cutting lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplewell.sources.folders import delete, delete_at_exit, shared_folder

#: Joins: the most keys that count as hot, the least rows of a hot key, tasks for each.
HOT_KEYS, LEAST_HOT, SALTS = 2000, 256, 64
#: Bytes of a Parquet row group: what a writing task holds.
ROW_GROUP = 16 << 20
#: Python workers take an Arrow batch in slices of about so many bytes, which bounds their memory.
SLICE_BYTES = 2 << 20

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
_SPARK = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<bigint>": T.ArrayType(T.LongType())}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_samplewell_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(), "samplewell_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    sc._samplewell_shipped = sc.applicationId


#: Folders of the tables written so far, for release().
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder, for small results: one file a partition. Spark's cleaner deletes it where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    spark = df.sparkSession
    shared_folder(spark)
    rows = df.checkpoint()._jdf.queryExecution()
    # A frame over the checkpoint's rows alone: the checkpointed frame keeps the constraints of its old plan, and in loops these grow until planning takes longer than the jobs.
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.toRdd(), rows.analyzed().schema(), False), spark)


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, for large results: later reads take the columns they need, release() can delete it, and the optimizer starts anew from it."""
    folder = f"{shared_folder(df.sparkSession)}/samplewell-{uuid.uuid4().hex}"
    _written.append(folder)
    delete_at_exit(df.sparkSession, folder)
    write(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write(df: DataFrame, folder: str) -> None:
    """Parquet in row groups of bounded memory."""
    df.write.option("parquet.block.size", ROW_GROUP).parquet(folder)


def mark() -> int:
    """The place in the list of written tables, for release()."""
    return len(_written)


def release(spark: SparkSession, since: int, most: int | None = None) -> None:
    """Delete the tables written since mark() (the first `most` of them), whose results have been written elsewhere, and the shuffle files of the jobs that are over."""
    gone = _written[since:][:most]
    del _written[since : since + len(gone)]
    for folder in gone:
        delete(spark, folder)
    tidy(spark)


def settle(df: DataFrame, since: int) -> DataFrame:
    """cut(df), after which the tables written since mark() are deleted: for the one result that a longer computation leaves."""
    out = cut(df)
    release(df.sparkSession, since)
    return out


def keyed(df: DataFrame, name: str) -> DataFrame:
    """df with a key for each row, the same whenever it is read: a 64-bit hash of file and place in it for rows that come straight from Parquet files; others are numbered and written first.

    Numbers given while reading would depend on how files are cut into tasks, and so on how many executors there are just then.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        try:
            return df.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
        except AnalysisException:  # files of another format
            pass
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that nothing refers to any more: it learns of them when the driver collects garbage, else every half hour."""
    gc.collect()
    spark._jvm.System.gc()


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, how: str = "inner", least: int | None = None) -> DataFrame:
    """rows joined with keyed, which has each key once and, in column `size`, how many rows have it: rows of a hot key are spread over SALTS tasks.

    Hot are keys of at least a HOT_KEYS-th of all rows: at most HOT_KEYS keys, which are broadcast; with `least` given, keys of so many rows. Null keys must not occur in rows.
    """
    if least is None:
        total = keyed.agg(F.sum(size)).first()[0] or 0
        least = max(LEAST_HOT, -(-total // HOT_KEYS))
    hot = keyed.where(F.col(size) >= least).select(*keys)
    rest = [c for c in rows.columns if c not in keys]
    salted = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rest), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col(size) >= least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(keyed.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how).drop("_salt")


def once(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _returned(batches):
    """The batches; after the last, memory that a task has freed goes back to the system, since idle workers stay alive."""
    yield from batches
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: What a worker process keeps from task to task, for operators that ask for it; it goes when another operator's task begins.
kept: dict = {}


def forget() -> None:
    """Empty `kept`, in the worker's own module: a function that is shipped by value has a copy of what it names."""
    kept.clear()


def map_columns(df: DataFrame, fn, schema: str, start=None, keep: bool = False) -> DataFrame:
    """Arrow map: fn(state, *columns as Python lists) -> list of output columns.

    schema: "name type, ..." with the types of _ARROW. start() makes a worker's state, once a task;
    keep: it may use `kept`, which other operators' tasks clear.
    Input batches are cut into slices of about SLICE_BYTES, so memory does not depend on the batch's row count.
    """
    ship(df.sparkSession)
    cols = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    names, kinds = [c[0] for c in cols], [_ARROW[c[1]] for c in cols]
    spark_schema = T.StructType([T.StructField(n, _SPARK[k]) for n, k in cols])

    def run(batches):
        if not keep:
            forget()
        state = start() if start else None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                out = fn(state, *[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(out, kinds)], names=names)

    return df.mapInArrow(lambda batches: _returned(run(batches)), spark_schema)


def filter_rows(df: DataFrame, fn, column: str, start=None) -> DataFrame:
    """The rows for which fn(state, values of a column as a Python list) gives true, with all columns."""
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        forget()
        state = start() if start else None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                yield part.filter(pa.array(fn(state, part.column(at).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(lambda batches: _returned(run(batches)), df.schema)
