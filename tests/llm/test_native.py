"""Exact deduplication, sharding and mixing."""

import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import exact_dedup, mixing, sharding


def against_sql(df, sql, documents, same_rows):
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    same_rows(df.toPandas(), con.sql(sql).df())


def test_exact_groups_match_sql(spark, corpus, folder, same_rows):
    against_sql(exact_dedup.op9_exact_dedup(spark, folder(corpus)), exact_dedup.OP9_SQL, corpus, same_rows)


def test_exact_groups_over_many_micro_batches(corpus):
    one = sorted(map(tuple, exact_dedup.exact_groups(corpus).collect()))
    many = sorted(map(tuple, exact_dedup.exact_groups(corpus.repartition(7), files_per_batch=1).collect()))
    assert one == many


def test_exact_awkward(spark, awkward, no_rows):
    rows = exact_dedup.exact_groups(awkward).collect()
    assert len(rows) == 9
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert {r.keep_id for r in same} == {2} and {r.group_size for r in same} == {3} and sum(r.kept for r in same) == 1
    assert [(r.keep_id, r.group_size) for r in rows if r.doc_id in (3, 4)] == [(4, 2)] * 2
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    assert exact_dedup.exact_groups(no_rows).count() == 0
    stay = exact_dedup.exact_stage(spark, awkward, "")
    assert stay.columns == awkward.columns and sorted(str(r.doc_id) for r in stay.collect()) == ["2", "4", "5", "6", "7", "None"]


def test_digest_collision_is_an_error(corpus, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 1))
    with pytest.raises(ValueError, match="digest"):
        exact_dedup.exact_groups(corpus)


@pytest.mark.parametrize(("shards", "probe_bits"), [(24, 9), (3, 2), (7, 5), (1, 9)])
def test_shards(corpus, shards, probe_bits):
    out = sharding.shard(corpus, shards, probe_bits=probe_bits).toPandas()
    texts = corpus.toPandas().set_index("doc_id").text
    assert (out["size"] == out.doc_id.map(lambda i: len(texts[i].encode()) + 8)).all()
    assert (out.text_crc32 == out.doc_id.map(lambda i: zlib.crc32(texts[i].encode()))).all()
    total = out.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    fair, largest = out["size"].sum() / shards, out["size"].max()
    assert total.max() - fair <= largest + 0.02 * fair + 1 and fair - total.min() <= largest + 0.02 * fair + 1
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_hot_group_is_cut(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text of many").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    out = sharding.shard(rows, 24).toPandas()
    total = out.groupby("shard")["size"].sum()
    assert len(total) == 24 and total.max() / total.mean() < 1.05 and total.min() / total.mean() > 0.95


def test_shards_are_ranges_of_the_sorted_keys(corpus):
    """A second way: sort all keys on one machine; shards are consecutive stretches near their fair shares."""
    rows = sharding.shard(corpus, 7).join(corpus.select("doc_id", F.xxhash64("text").alias("h")), "doc_id").toPandas()
    rows["hi"] = [(h + 2**63) >> 1 for h in rows.h]
    rows = rows.sort_values(["hi", "doc_id"])
    assert rows.shard.is_monotonic_increasing and set(rows.shard) == set(range(7))
    fair, ends = rows["size"].sum() / 7, rows.groupby("shard")["size"].sum().cumsum()
    for s, end in enumerate(ends[:-1], 1):  # no other cut between whole keys is nearer by more than the tolerance
        sums = rows.groupby("hi", sort=True)["size"].sum().cumsum()
        best = min(abs(x - fair * s) for x in [0, *sums])
        assert abs(end - fair * s) <= max(best, 0.02 * fair) + 1


def test_small_groups_stay_whole(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") / 3).cast("int").cast("string")).alias("text"))
    out = sharding.shard(rows, 24).toPandas()
    assert (out.assign(g=out.doc_id // 3).groupby("g").shard.nunique() == 1).all()


def test_shards_awkward(awkward, no_rows):
    out = sharding.shard(awkward, 4).collect()
    assert len(out) == 9 and {r["size"] for r in out if r.doc_id in (3, 4)} == {8} and sharding.shard(no_rows, 4).count() == 0


def test_mix_matches_sql(spark, corpus, folder, same_rows):
    against_sql(mixing.op8_systematic_mix(spark, folder(corpus)), mixing.OP8_SQL, corpus, same_rows)


def brute_targets(sizes, weights):
    total, share = 1.5 * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    rest = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > 2 * sizes[i]]
        if not over:
            for i in open_:
                share[i] = rest * weights[i] / w
            break
        for i in over:
            share[i] = 2 * sizes[i]
            open_.discard(i)
            rest -= share[i]
    return share


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 40, 0, 7], [100], [3, 3, 3, 3, 900]])
def test_targets_fill_up(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.source_targets(rows).orderBy("source").collect()]
    assert got == pytest.approx(brute_targets(sizes, [[3, 1, 2][i % 3] for i in range(len(sizes))]))


def test_mix_is_near_target_and_repeats(corpus):
    a, b = mixing.mix(corpus).toPandas(), mixing.mix(corpus.repartition(5)).toPandas()
    key = ["doc_id", "copies"]
    assert a[key].sort_values("doc_id").reset_index(drop=True).equals(b[key].sort_values("doc_id").reset_index(drop=True))
    taken = (a.copies * a["size"]).groupby(a.source).sum()
    assert ((taken - a.groupby("source").target.first()).abs() <= 2 * a.groupby("source")["size"].max()).all()
    assert a.copies.between(0, 2).all()


def test_mix_awkward(spark, awkward, no_rows):
    out = mixing.mix(awkward).toPandas()
    assert len(out) == 9 and (out.copies * out["size"] <= 2 * out["size"]).all() and mixing.mix(no_rows).count() == 0
    stage = mixing.mix_stage(spark, awkward, "")
    assert stage.columns == awkward.columns
    counts = stage.toPandas().groupby("doc_id", dropna=False).size()
    want = out.groupby("doc_id", dropna=False).copies.sum()
    assert counts.sum() == want.sum() and counts.reindex(want[want > 0].index).tolist() == want[want > 0].tolist()
    assert mixing.mix_stage(spark, no_rows, "").count() == 0
    assert isinstance(pd.DataFrame(out), pd.DataFrame)


@pytest.mark.parametrize("hot", [10, 10**9])
def test_rows_that_share_an_id_share_its_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(mixing, "HOT_ROWS", hot)
    rows = [(None, f"text {i % 50} of five words", "en", "a", i % 3) for i in range(600)] + [(5, "five words in this text", "en", "b", 1)] * 40 + [(i, "some words", None, f"s{i % 3}", 2) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    out = Counter(tuple(r) for r in mixing.mix_stage(spark, docs, "").collect())
    given = Counter(rows)
    assert set(out) <= set(given)
    for key in (None, 5, *range(10, 60)):
        mine, n = [r for r in given if r[0] == key], sum(c for r, c in given.items() if r[0] == key)
        assert sum(out[r] for r in mine) == taken[key]
        assert all(given[r] * (taken[key] // n) <= out[r] <= given[r] * -(-taken[key] // n) for r in mine)
    assert out == Counter(tuple(r) for r in mixing.mix_stage(spark, docs.repartition(3), "").collect())
