"""Stored samples, epochs, containers, exported files, the cache, and what must not pile up in one task."""

import os
import statistics
import threading
import time

import pytest
from pyspark.sql import functions as F

from kinetrail import preprocess
from kinetrail.kernel import extract, program
from kinetrail.operators import batching, epochs, stats
from kinetrail.sources import assets, cache, containers, parts, samples, shards
from kinetrail.streaming import oplog

# --- samples ---------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """One part holds most of the samples."""
    folder = str(tmp_path_factory.mktemp("samples"))
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, 5).otherwise(F.col("id") % 20).alias("part_id"), F.col("id").alias("step"), F.concat(F.lit("v"), "id").alias("value"))
    samples.write(rows, folder, ["part_id", "step"], files=8)
    order = sorted((r.part_id, r.step, r.value) for r in rows.collect())
    return folder, order


def test_numbers_are_global(spark, stored):
    folder, order = stored
    assert samples.count(spark, folder) == 3000
    found = samples.numbered(spark, folder)
    assert [(r.part_id, r.step, r.value) for r in found.orderBy("number").collect()] == order
    assert [r.number for r in found.orderBy("number").collect()] == list(range(3000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    sizes = [r.n for r in samples.index(spark, folder).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * statistics.median(sizes)


def test_a_sample_is_in_one_file(spark, stored):
    folder, order = stored
    for number in (0, 1, 1234, 2999):
        found = samples.take(spark, folder, [number])
        (row,) = found.collect()
        assert (row.number, row.part_id, row.step, row.value) == (number, *order[number])
        assert len(samples.locate(spark, folder, [number])) == 1
        read = [f for f in found.inputFiles() if "/data/" in f]
        assert len(read) == 1
    batch = [7, 2500, 7, 2999]
    assert sorted(r.number for r in samples.take(spark, folder, batch).collect()) == sorted(batch)
    assert samples.take(spark, folder, []).count() == 0
    for outside in (-1, 3000):
        with pytest.raises(IndexError):
            samples.take(spark, folder, [outside])


def test_no_samples(spark, tmp_path):
    samples.write(spark.createDataFrame([], "part_id long, step long"), str(tmp_path), ["part_id", "step"])
    assert samples.count(spark, str(tmp_path)) == 0 and samples.numbered(spark, str(tmp_path)).count() == 0


# --- epochs ----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4099])
def test_every_epoch_is_a_permutation(spark, n):
    keys = epochs.round_keys(3, n)
    rows = spark.range(n).select("id", epochs.shuffled(F.col("id"), n, keys).alias("number"))
    rows = rows.select("id", "number", epochs.place_of(F.col("number"), n, keys).alias("back")).orderBy("id").collect()
    assert sorted(r.number for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert [r.number for r in rows] == [x for b in range(-(-n // 10)) for x in epochs.members(n, 10, b, 3, n)]


def test_large_numbers(spark):
    n = 10**13
    keys = epochs.round_keys(1, 0)
    rows = spark.createDataFrame([(0,), (n - 1,), (n // 3,)], "id long").select("id", epochs.shuffled(F.col("id"), n, keys).alias("number"))
    rows = rows.select("id", "number", epochs.place_of(F.col("number"), n, keys).alias("back")).collect()
    assert all(r.back == r.id and 0 <= r.number < n for r in rows) and len({r.number for r in rows}) == 3


def test_epochs_differ_and_mix(spark):
    n = 5000
    orders = [[x for b in range(50) for x in epochs.members(n, 100, b, seed, epoch)] for seed, epoch in ((0, 0), (0, 1), (1, 0))]
    assert sum(a == b for a, b in zip(orders[0], orders[1], strict=True)) < 20 and sum(a == b for a, b in zip(orders[0], orders[2], strict=True)) < 20
    steps = [abs(b - a) for a, b in zip(orders[0], orders[0][1:], strict=False)]
    assert 0.9 < statistics.mean(steps) / (n / 3) < 1.1  # as far apart as two random numbers
    assert 0.45 < sum(b > a for a, b in zip(orders[0], orders[0][1:], strict=False)) / n < 0.55


def test_batches_need_no_exchange(spark, stored):
    folder, _ = stored
    found = epochs.epoch_batches(samples.numbered(spark, folder), 3000, 64, 7, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan and "Sort" not in plan
    by_batch = {}
    for r in found.collect():
        by_batch.setdefault(r.batch_id, {})[r.batch_pos] = r.number
    assert set(by_batch) == set(range(47)) and len(by_batch[46]) == 3000 - 46 * 64
    assert [by_batch[9][k] for k in range(64)] == epochs.members(3000, 64, 9, 7, 1)


# --- containers ------------------------------------------------------------


def test_containers_that_cannot_be_read(spark, tmp_path):
    root = tmp_path / "raw"
    rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("uuid"), F.encode(F.repeat(F.concat(F.lit("code "), "id"), 500), "UTF-8").alias("cadquery_file"), F.col("id").alias("cadquery_ops_count"), F.lit("é").alias("more"))
    rows.repartition(4).write.parquet(str(root / "data/train"))
    rows.coalesce(1).write.parquet(str(root / "data/val"))
    for checksum in root.rglob(".*.crc"):
        checksum.unlink()
    whole, cut, torn, short = sorted((root / "data/train").glob("*.parquet"))
    cut.write_bytes(cut.read_bytes()[:-200])  # its footer is gone
    damaged = bytearray(torn.read_bytes())
    damaged[60:400] = b"\xff" * 340  # its pages are damaged, its footer is not
    torn.write_bytes(bytes(damaged))
    short.write_bytes(b"")
    spark.range(3).select(F.col("id").alias("uuid")).coalesce(1).write.parquet(str(tmp_path / "other"))
    next((tmp_path / "other").glob("*.parquet")).rename(root / "data/val/zz.parquet")
    found = containers.read(spark, str(root)).collect()
    bad = {r.source_shard: r.status for r in found if r.status != "success"}
    assert bad == {cut.name: "corrupt_shard", torn.name: "corrupt_shard", short.name: "corrupt_shard", "zz.parquet": "missing_column"}
    assert all(r.part_id is None and r.error and r.source_row is None for r in found if r.status != "success")
    good = [r for r in found if r.status == "success"]
    assert {r.split for r in good} == {"train", "val"} and sum(r.split == "val" for r in good) == 40
    want = {(r.source_shard, r.source_row): (r.part_id, r.code, r.ops_count) for r in parts.scan(spark, str(root), "val", 1).collect()}
    assert {(r.source_shard, r.source_row): (r.part_id, r.code, r.ops_count) for r in good if r.split == "val"} == want
    assert {r.source_shard for r in good if r.split == "train"} == {whole.name}
    only = containers.read(spark, str(root), "validation")
    assert {r.split for r in only.select("split").collect()} == {"val"}
    large = containers.read(spark, str(root), "val", most_bytes=1000).collect()
    assert {(r.status, r.part_id) for r in large if r.source_shard != "zz.parquet"} == {("too_large", None)}


# --- exported files --------------------------------------------------------


def files_under(folder):
    return {os.path.relpath(os.path.join(at, f), folder): open(os.path.join(at, f), "rb").read() for at, _, names in os.walk(folder) for f in names}


def test_files_are_the_bytes(spark, tmp_path):
    rows = spark.range(50).select("id", F.encode(F.concat(F.lit("é"), "id"), "UTF-8").alias("a"), F.when(F.col("id") % 2 == 0, F.lit("text")).alias("b")).repartition(5)
    assets.export_files(rows, str(tmp_path / "out"), "id", {"a.bin": "a", "b.txt": "b"})
    want = {f"{i}/a.bin": f"é{i}".encode() for i in range(50)} | {f"{i}/b.txt": b"text" for i in range(0, 50, 2)}
    assert files_under(tmp_path / "out") == want
    assets.export_files(rows.where("id < 3").withColumn("a", F.lit("new")), str(tmp_path / "out"), "id", {"a.bin": "a"})  # replaces
    assert files_under(tmp_path / "out") == want | {f"{i}/a.bin": b"new" for i in range(3)}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.lit("../out")).otherwise(F.col("id").cast("string")).alias("id"), F.lit("x").alias("a"))
    with pytest.raises(Exception, match="not a file name"):
        assets.export_files(rows, str(tmp_path / "out"), "id", {"a.bin": "a"})
    assert files_under(tmp_path / "out") == {}
    for name in ("", "a/b", "..", "_staging"):
        with pytest.raises(ValueError):
            assets.checked(name)


# --- cache -----------------------------------------------------------------


def test_cache_is_bounded(spark, tmp_path):
    rows = spark.range(60).select("id", F.lit("train").alias("split"), F.concat(F.lit("s"), F.col("id") % 6).alias("source_shard"))
    rows.write.partitionBy("split", "source_shard").parquet(str(tmp_path / "states"))
    persisted = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = persisted()
    with cache.ShardCache(spark, str(tmp_path), most=3) as held:
        for k in (0, 1, 2, 0, 3, 4):  # 0 is used again, so 1 and 2 go first
            assert held.get("states", "train", f"s{k}").count() == 10
            assert persisted() - before <= 3
        assert [key[2] for key in held.held] == ["s0", "s3", "s4"] and (held.hits, held.misses) == (1, 5)
        assert all(size > 0 for size in held.sizes().values())
    assert persisted() == before
    off = cache.ShardCache(spark, str(tmp_path), most=0)
    assert off.get("states", "train", "s1").count() == 10 and persisted() == before and off.misses == 1


# --- one key for everything ------------------------------------------------


@pytest.fixture
def all_partitions(spark):
    """These tables are small: without this, partitions would be put together again."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_of_one_value(spark, all_partitions):
    rows = spark.range(20_000, numPartitions=8).select(F.lit(15.0).alias("x"), "id")
    placed = batching.ranged(rows, ["x"])
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * statistics.median(sizes)
    ranked = batching.global_rank(rows, ["x"], "rank")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(20_000))
    (row,) = stats.duration_stats(rows.withColumnRenamed("x", "duration_s")).collect()
    assert (row["mean"], row["median"], row["p95"]) == (15.0, 15.0, 15.0)


def test_ranks_of_many_ties(spark):
    rows = spark.range(5000, numPartitions=6).select((F.col("id") % 7).alias("x"), "id")
    got = batching.global_rank(rows, ["x"], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(5000)) and [r.x for r in got] == sorted(r.x for r in got)


def test_fold_of_one_large_part(spark, all_partitions):
    ops = spark.range(30_000, numPartitions=6).select(F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("part_id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "extrude").otherwise("workplane").alias("op_name"), (F.col("id") % 10).cast("double").alias("measure"))
    assert sorted(map(tuple, oplog.fold_ranges(ops).collect())) == sorted(map(tuple, oplog.fold_native(ops).collect()))
    placed = batching.ranged(oplog._marked(ops), ["part_id", "seq"])
    sizes = [r["count"] for r in placed.where("part_id = 'large'").groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    assert oplog.fold(ops.limit(0)).count() == 0


# --- limits and reruns -----------------------------------------------------


def endless(_):
    while True:
        time.sleep(0.01)


def test_time_limit_off_the_main_thread(monkeypatch):
    found = {}
    good = "result = cq.Workplane().box(1, 2, 3)"

    def run(name, code):
        found[name] = extract.run_part(code, 0.5)

    def in_thread(name, code):
        thread = threading.Thread(target=run, args=(name, code))
        thread.start()
        thread.join(30)
        assert not thread.is_alive()

    in_thread("good", good)
    in_thread("syntax", "result = ((")
    run("main", good)
    assert found["good"][0] == "success" and found["good"][3:] == found["main"][3:] and found["syntax"][0] == "syntax_error"
    monkeypatch.setattr(program, "parse", endless)
    in_thread("endless", good)
    assert found["endless"][0] == "timeout" and found["endless"][2] < 10


@pytest.fixture
def raw(spark, tmp_path):
    rows = spark.range(24).select(F.concat(F.lit("p"), "id").alias("uuid"), F.when(F.col("id") % 4 == 3, "result = ((").otherwise(F.concat(F.lit("result = cq.Workplane().box("), F.col("id") + 1, F.lit(", 2, 3)"))).alias("cadquery_file"), F.lit(2).alias("cadquery_ops_count"))

    def add(name, low, high):
        rows.where(F.col("uuid").isin([f"p{i}" for i in range(low, high)])).coalesce(1).write.parquet(str(tmp_path / "new"))
        target = tmp_path / "raw/data" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        next((tmp_path / "new").glob("*.parquet")).rename(target)
        for left in sorted((tmp_path / "new").iterdir()):
            left.unlink()
        (tmp_path / "new").rmdir()

    return add, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "checkpoint")


def whole_output(spark, out):
    return {t: sorted(map(str, shards.read(spark, out, t).collect())) for t in ("states", "faces", "edges", "actions", "op_log", "trajectories")} | {"status": sorted(map(str, shards.read(spark, out, "part_status").drop("duration_s", "error").collect()))}


def test_continuous_extraction_over_growing_input(spark, raw, tmp_path, monkeypatch):
    add, root, out, checkpoint = raw
    (tmp_path / "raw/data/train").mkdir(parents=True)
    add("train/a.parquet", 0, 8)
    add("train/b.parquet", 8, 16)
    choice = ["data=debug"]
    follow = lambda: preprocess.follow(spark, root, out, checkpoint, choice, files_per_batch=1)
    follow().awaitTermination()
    add("train/c.parquet", 16, 20)
    real = preprocess._write

    def lost(*arguments):
        real(*arguments)
        raise RuntimeError("lost after the write")

    with monkeypatch.context() as patch:
        patch.setattr(preprocess, "_write", lost)
        with pytest.raises(Exception, match="lost after the write"):
            follow().awaitTermination()
    (tmp_path / "raw/data/val").mkdir(parents=True)
    add("val/d.parquet", 20, 24)
    follow().awaitTermination()
    again = follow()
    again.awaitTermination()
    assert sum(p["numInputRows"] for p in again.recentProgress) == 0
    found = whole_output(spark, out)
    preprocess.run(spark, root, str(tmp_path / "once"), [*choice, "preprocess.split=all"])
    assert found == whole_output(spark, str(tmp_path / "once"))
    assert len(found["status"]) == 24


def test_metadata_has_exact_bytes(spark, raw, tmp_path):
    add, root, out, _ = raw
    (tmp_path / "raw/data/train").mkdir(parents=True)
    add("train/a.parquet", 0, 8)
    add("train/b.parquet", 8, 16)
    (meta_a, meta_b) = preprocess.run(spark, root, out, ["data=debug"]).orderBy("source_shard").collect()
    for meta in (meta_a, meta_b):
        at = [os.path.join(d, f) for d, _, names in os.walk(out) for f in names if f.endswith(".parquet") and f"source_shard={meta.source_shard}" in d and "shard_metadata" not in d]
        assert meta.bytes == sum(map(os.path.getsize, at)) > 0
        assert meta.attempted == 8 and meta.succeeded == 6
