"""What the operators of this subpackage share: tables, the shared folder, and byte-sized slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into objects at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that stored() has written in this process, until drop_stored() removes them.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir; in local mode, as in tests, a temporary one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(path: str) -> str:
    """path, noted as one that drop_stored() removes."""
    _written.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage and survives lost executors.

    The tables are needed until the result that reads them is written; then drop_stored() removes them.
    """
    path = f"{shared_folder(df.sparkSession)}/quern/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Deletes what stored() has written so far; for when all results that read it are written. How many tables went."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of docs has it; Spark's names differ by more than the case of letters."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name += "_"
    return name


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about limit bytes, one row at least."""
    for batch in batches:
        start = size = 0
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


#: The most keys that can each hold an equal share of all rows, and so be broadcast.
HOT_KEYS = 1000


def by_group(rows: DataFrame, groups: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to groups by key, where no key fills a task.

    groups: one row a key, with n, the number of rows that have it. A key with more than a HOT_KEYS-th of the total rows (and more than
    1,000) is hot: there are HOT_KEYS of those at most, so their groups are broadcast and their rows stay where they are.
    """
    bound = max(1000, total // HOT_KEYS)
    hot, cold = F.broadcast(groups.filter(F.col("n") > bound).drop("n")), groups.filter(F.col("n") <= bound).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size, from metadata."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def computed(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """df with a column that is evaluated once a row: a generator's output is not copied into the lambdas that use it."""
    return df.select("*", F.explode(F.array(expression)).alias(name))
