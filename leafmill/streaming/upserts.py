"""A table of the latest row of each key, kept up to date by a stream (K2, K4 from T1).

The table lies in buckets by a hash of the key. A batch rewrites the buckets it touches into a folder of its own, and then one small file that
names each bucket's folder is put in the place of the one before, in one atomic rename. So a reader has the table before a batch or after it; a batch
that ran before changes nothing when it is run again; and what a failed one left is written over.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
CURRENT = "_current"


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> dict:
    """The last batch that is in the table (-1 if none is) and the folder of each bucket that has rows."""
    jvm, path, files = _files(spark, folder)
    at = jvm.org.apache.hadoop.fs.Path(path, CURRENT)
    if not files.exists(at):
        return {"batch": -1, "buckets": {}}
    stream = files.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _replace(spark: SparkSession, folder: str, state: dict) -> None:
    jvm, path, files = _files(spark, folder)
    new = jvm.org.apache.hadoop.fs.Path(path, f"{CURRENT}.{state['batch']}")
    out = files.create(new, True)
    out.write(json.dumps(state).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(path, CURRENT), options)


def read_current(spark: SparkSession, folder: str, schema, state: dict | None = None) -> DataFrame:
    """The table's rows, also those that are marked as deleted."""
    state = state or current(spark, folder)
    paths = [f"{folder}/batch={v}/bucket={b}" for b, v in state["buckets"].items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upserts(folder: str, key: list[str], order: list[str], buckets: int = BUCKETS, fail: Callable[[], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch is to call. Of rows with one key the one that is greatest by order stays (nulls are least; equals are told by all columns).

    Late rows change nothing, as the table's row is greater; a deletion is a row, with a mark among the columns, so that late rows don't
    bring a key back. Null keys are keys. fail is for tests: called before the batch takes effect.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = current(spark, folder)
        if batch_id <= state["batch"]:
            return
        rest = [c for c in batch.columns if c not in key]
        bucket: Column = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        new = batch.withColumn("bucket", bucket).persist()
        try:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # so many as there are buckets, at most
            old = {"batch": state["batch"], "buckets": {b: v for b, v in state["buckets"].items() if int(b) in touched}}
            rows = new.unionByName(read_current(spark, folder, batch.schema, old).withColumn("bucket", bucket))
            greatest = F.max(F.struct(*order, *[c for c in rest if c not in order]))
            rows = rows.groupBy("bucket", *key).agg(greatest.alias("r")).select("bucket", *key, *[F.col(f"r.{c}").alias(c) for c in rest])
            rows.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch_id}")
        finally:
            new.unpersist()
        if fail:
            fail()
        _replace(spark, folder, {"batch": batch_id, "buckets": state["buckets"] | {str(b): batch_id for b in touched}})

    return run
