"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Text bytes that a Python worker holds at a time, so that its memory doesn't depend on the batch size Spark uses.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. `lower` is the fast path where a text has only ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once: a lambda's variable holds a value, whereas a column that is used once in a lambda may be
    put in there as an expression and worked out for every element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """array: each value joined with all before it, by doubling: round k takes in what stands 2^k places before, so that a long array
    costs n log n steps and nothing is appended. `join` is associative and commutative, such as a sum or greatest."""

    def doubled(now: Column, k: Column) -> Column:
        return F.transform(now, lambda v, i: F.when(i >= power(k), join(v, F.get(now, i - power(k)))).otherwise(v))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(rounds, values, doubled))


def power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def count_below(ordered: Column, value: Column) -> Column:
    """How many of a sorted array's values are less than `value`, by halving."""

    def halved(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        less = F.struct((middle + 1).alias("low"), acc["high"].alias("high"))
        more = F.struct(acc["low"].alias("low"), middle.alias("high"))
        return F.when(acc["low"] >= acc["high"], acc).when(F.get(ordered, middle) < value, less).otherwise(more)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), halved, lambda acc: acc["low"])


#: Bytes up to which a table is broadcast, measured on the table itself before the join; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, most: int | None = None) -> DataFrame:
    """df (cut before, as it is counted here), marked for broadcast if its rows of about `row_bytes` each stay within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= (BROADCAST_BYTES if most is None else most) else df


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint_ready(spark: SparkSession) -> None:
    """checkpoint() writes to the folder that the cluster names in spark.checkpoint.dir. Only a local master, whose tasks all see the driver's
    folders, gets one made where none is named."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all executors share; its lineage ends there."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def text_slices(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes of the given string or binary column; a longer row is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = batch.column(column)
        wide = pa.types.is_large_string(ends.type) or pa.types.is_large_binary(ends.type)
        offsets = memoryview(ends.buffers()[1]).cast("q" if wide else "i")[ends.offset : ends.offset + batch.num_rows + 1]
        first = 0
        while first < batch.num_rows:
            last = first + 1
            while last < batch.num_rows and offsets[last + 1] - offsets[first] <= most:
                last += 1
            yield batch.slice(first, last - first)
            first = last
