import pytest
from pyspark.sql import functions as F

from kinetrail import config, storage
from kinetrail.sources import parts, shards
from kinetrail.streaming import oplog


@pytest.fixture
def raw(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", bytearray(f"code {i}".encode()), i, "{}") for i in range(6)], "uuid string, cadquery_file binary, cadquery_ops_count int, cadquery_ops_json string")
    for split, low in (("train", 0), ("val", 4)):
        rows.where(F.substring("uuid", 2, 1).cast("int").between(low, low + 3)).coalesce(1).write.parquet(str(tmp_path / "data" / split))
    return str(tmp_path)


def test_scan_and_lineage(spark, raw):
    found = parts.scan(spark, raw)
    assert found.count() == 6 and {r.split for r in found.collect()} == {"train", "val"}
    assert found.where("part_id = 'u3'").first().code == "code 3"
    assert parts.scan(spark, raw, "validation").count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cadquery_ops_json" not in plan
    with pytest.raises(FileNotFoundError):
        parts.scan(spark, raw, "test").count()
    files = parts.find_shards(spark, raw, "train")
    back = parts.trace_back(found.where("part_id = 'u2'").select("source_shard", "source_row"), parts.full_rows(spark, files[0][1]))
    assert [r.uuid for r in back.collect()] == ["u2"]
    assert parts.pool(spark, raw, "train").count() == 6
    assert (parts.split_glob("all"), parts.split_glob("validation")) == (None, "*val*")
    assert parts.with_ids(found, spark.createDataFrame([("u1",), ("u5",)], "part_id string"), limit=1).count() == 1


def test_shards(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("a", "train", "s1"), ("b", "train", "s2"), ("c", "val", "s3")], "part_id string, split string, source_shard string")
    assert shards.pending(rows, root).count() == 3
    first = rows.where("source_shard != 's2'")
    meta = shards.write({"trajectories": first}, rows.where("source_shard != 's3'").withColumn("status", F.when(F.col("part_id") == "a", "success").otherwise("timeout")), root)
    assert {(r.source_shard, r.attempted, r.succeeded) for r in meta.collect()} == {("s1", 1, 1), ("s2", 1, 0)}
    assert {r.source_shard for r in shards.pending(rows, root).collect()} == {"s2", "s3"} and shards.pending(rows, root, overwrite=True).count() == 3
    assert shards.read(spark, root, "trajectories", "validation").count() == 1 and shards.bytes_written(spark, root, "trajectories") > 0
    shards.write({"trajectories": rows.where("source_shard = 's1'").withColumn("part_id", F.lit("z"))}, rows.limit(1).withColumn("status", F.lit("success")), root)
    assert sorted(r.part_id for r in shards.read(spark, root, "trajectories").collect()) == ["c", "z"]
    sizes = shards.export_assets(rows.withColumn("step_file", F.lit("abc")), f"{root}/x", "part_id", {"step": "step_file"})
    assert {(r.asset, r["size"]) for r in sizes.collect()} == {("step", 3)}


def test_work_tables(spark):
    kept = storage.written(spark.range(5), "test")
    assert kept.count() == 5 and kept.inputFiles()[0].split("/kinetrail/")[1].startswith("test-")
    folder = storage.work_path(spark, "gone")
    spark.range(3).write.parquet(folder)
    assert shards.exists(spark, folder)


def test_clean_removes_work_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    path = storage.written(spark.range(3), "x").inputFiles()[0]
    assert shards.exists(spark, path)
    storage.clean(spark)
    assert not shards.exists(spark, path)


def test_shared_folder_where_none_is_set():
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            applicationId, master = "app", "local[2]"

    assert storage.shared_dir(Unset) == storage.shared_dir(Unset)
    Unset.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Unset)


def test_config():
    plain = config.compose()
    assert (plain["data"]["face_dims"], plain["data"]["edge_dims"]) == (32, 16)
    for data in config.GROUPS["data"]:
        for model in config.GROUPS["model"]:
            found = config.compose([f"data={data}", f"model={model}", "preprocess.timeout_s=3", "preprocess.overwrite=true"])
            assert found["data"]["face_dims"] == 32 and found["preprocess"]["timeout_s"] == 3 and found["preprocess"]["overwrite"] is True
    assert config.select(plain, "model.heads") == 8 and config.select(plain, "model.none", 5) == 5
    with pytest.raises(KeyError):
        config.compose(["data=absent"])


def test_folds_agree(spark):
    rows = [(p, s, op, float(s)) for p in "ab" for s, op in enumerate(["box", "faces", "hole", "", "Fillet "])]
    ops = spark.createDataFrame(rows, "part_id string, seq int, op_name string, measure double").withColumn("depth", (F.col("seq") == 4).cast("int"))
    a, b = (sorted(map(tuple, f(ops).collect())) for f in (oplog.fold, oplog.fold_native))
    assert a == b and len(a) == 8 and a[-1][2] == 2
