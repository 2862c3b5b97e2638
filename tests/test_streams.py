"""States and upserts by streams that run to their end, in batches, with late and repeated rows, against the same over all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import catalog
from leafmill.streaming import status, upserts

EVENTS = "doc string, state string, at timestamp, seq long, note string"


def events_of(spark, seed=4, n=240):
    rng = random.Random(seed)
    states = [*catalog.DISPLAY, "other", None]
    return [(f"d{rng.randrange(25)}", rng.choice(states), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i // 2 * 2 + rng.randrange(2), f"n{i}") for i in range(n)]


def folder_of(spark, rows, path, files):
    """Rows in files that come one at a time: some late, some twice."""
    rng = random.Random(1)
    parts = [[] for _ in range(files)]
    for i, r in enumerate(rows):
        k = i * files // len(rows)
        parts[min(files - 1, k + rng.choice([0, 0, 0, 1]))].append(r)
        if rng.random() < 0.2:
            parts[min(files - 1, k + 1)].append(r)
    for k, part in enumerate(parts):
        rng.shuffle(part)
        frame = spark.createDataFrame([(d, s, n, m, t) for d, s, t, n, m in part], "doc string, state string, seq long, note string, t string")
        frame.withColumn("at", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(f"{path}/part{k}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def table_of(spark, rows):
    return spark.createDataFrame([(d, s, n, m, t) for d, s, t, n, m in rows], "doc string, state string, seq long, note string, t string").withColumn("at", F.to_timestamp("t")).drop("t")


def test_states_of_a_stream(spark, tmp_path):
    rows = events_of(spark)
    stream = folder_of(spark, rows, tmp_path / "in", 4)
    seen = []

    def keep(batch, n):
        seen.append({r.doc: r.state for r in batch.collect()})

    q = status.synced_status_stream(stream, "doc", "state", "at", "seq").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {k: v for batch in seen for k, v in batch.items()}
    want = {r.doc: r.state for r in catalog.synced_status(table_of(spark, rows), "doc", "state", ["at", "seq"]).collect()}
    assert len([x for x in seen if x]) > 1 and got == want


def test_upserts(spark, tmp_path):
    rows, folder = events_of(spark, 5), str(tmp_path / "table")
    stream = folder_of(spark, rows, tmp_path / "in", 3)
    sink = upserts.upserts(folder, ["doc"], ["at", "seq"], buckets=8)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = stream.schema
    got = {r.doc: (r.state, r.seq, r.note) for r in upserts.read_current(spark, folder, schema).collect()}
    want = {r.doc: (r.state, r.seq, r.note) for r in catalog.latest(table_of(spark, rows).select("doc", "state", "at", "seq", "note"), ["doc"], ["at", "seq"]).collect()}
    assert got == want and upserts.current(spark, folder)["batch"] >= 2


def test_a_batch_twice_and_one_that_fails(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "k string, n long, gone boolean"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    have = lambda: sorted(((r.k, r.n, r.gone) for r in upserts.read_current(spark, folder, schema).collect()), key=str)
    sink = upserts.upserts(folder, ["k"], ["n"], buckets=2)
    assert have() == []
    sink(rows(("a", 1, False), ("b", 5, False), (None, 1, False)), 0)
    first = have()
    assert first == sorted([("a", 1, False), ("b", 5, False), (None, 1, False)], key=str)
    # the same batch, with other rows even, changes nothing
    sink(rows(("a", 9, False)), 0)
    assert have() == first

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        upserts.upserts(folder, ["k"], ["n"], buckets=2, fail=fail)(rows(("a", 7, True), ("c", 1, False)), 1)
    assert have() == first and upserts.current(spark, folder)["batch"] == 0
    # again, now to its end; a late row of b changes nothing
    sink(rows(("a", 7, True), ("b", 2, False)), 1)
    assert have() == sorted([("a", 7, True), ("b", 5, False), (None, 1, False)], key=str)
    sink(rows(), 2)
    assert upserts.current(spark, folder)["batch"] == 2 and len(have()) == 3
