"""Training samples from recorded conversations (batch).

A conversation is a trajectory: its turns are the steps. The job checks each conversation, deals the
sound ones to splits by the hash of their id, and writes under the target folder

* `statuses` by status: one row per conversation, `success` or why it is left out (`null_field`,
  `unknown_role`, `repeated_turn`, `missing_turn`);
* `turns` by split: every turn of the sound conversations, each text once (null texts as empty);
* `samples` by split and horizon: pairs of a turn and the turn that many steps later, without texts.

Every table is replaced as a whole, so a rerun, also one after a crash, ends with the same files'
content. A conversation may hold any share of the rows: groups are counted with partial
aggregation, statuses meet the turns over salted keys, and pairs meet by (conversation, turn).

    python -m jobs.conversation_samples --source conversations.parquet --target out
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import defaults, log, main, write
from kinetrail.functions import scalar as S
from kinetrail.operators import stats, transitions
from kinetrail.storage import work_path

#: Tasks over which the turns of one conversation may be spread where they meet its status.
SALTS = 16
STATUSES = ["success", "null_field", "unknown_role", "repeated_turn", "missing_turn"]


def check(turns: DataFrame, roles: list[str]) -> DataFrame:
    """conv_id, turns, status of each conversation; those without id are one row."""
    places = turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role").isNull()).alias("nulls"), F.count_if(~F.col("role").isin(roles)).alias("unknown"))
    found = places.groupBy("conv_id").agg(
        F.sum("n").alias("turns"), (F.sum("nulls") + F.count_if(F.col("turn").isNull())).alias("nulls"), F.sum("unknown").alias("unknown"),
        F.max("n").alias("most"), F.count("turn").alias("distinct"), F.min("turn").alias("first"), F.max("turn").alias("last"),
    )
    status = F.when(F.col("conv_id").isNull() | (F.col("nulls") > 0), STATUSES[1]).when(F.col("unknown") > 0, STATUSES[2]).when(F.col("most") > 1, STATUSES[3])
    return found.select("conv_id", "turns", status.when((F.col("first") != 0) | (F.col("last") + 1 != F.col("distinct")), STATUSES[4]).otherwise(STATUSES[0]).alias("status"))


def sound_turns(turns: DataFrame, statuses: DataFrame, train_ratio: float) -> DataFrame:
    """The turns of sound conversations with num_turns, n_chars and split."""
    salted = statuses.where("status = 'success'").select("conv_id", F.col("turns").alias("num_turns"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    found = turns.withColumn("_salt", F.pmod("turn", F.lit(SALTS)).cast("int")).join(salted, ["conv_id", "_salt"])
    text = F.coalesce("text", F.lit(""))
    return found.select("conv_id", "turn", "num_turns", "role", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), S.split_of("conv_id", train_ratio).alias("split"))


def run(spark: SparkSession, source: str, target: str, config: dict[str, Any]) -> dict[str, int]:
    """Write the tables; returns and logs how many rows were read and written."""
    turns = spark.read.parquet(source).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    write(check(turns, config["roles"]), f"{target}/statuses", ["status"])
    statuses = spark.read.schema("conv_id long, turns long, status string").parquet(f"{target}/statuses")
    breakdown = {r.status: r.n for r in stats.failure_breakdown(statuses, known=STATUSES).collect()}

    write(sound_turns(turns, statuses, config["train_ratio"]), f"{target}/turns", ["split"])
    steps = read_turns(spark, target).select("conv_id", "turn", "num_turns", "role", "n_chars", "split")
    pairs = transitions.numbered_pairs(steps, ["role", "n_chars"], config["horizons"], part=["conv_id"], step="turn", keep=["num_turns", "split"])
    write(pairs.withColumnRenamed("target_step", "target_turn"), f"{target}/samples", ["split", "horizon"])

    # Counts come from the files' footers.
    counts = {"turns_read": turns.count(), "turns_written": read_turns(spark, target).count(), "samples_written": read_samples(spark, target).count()}
    log.info("read %s from %s; conversations by status: %s", counts["turns_read"], source, breakdown)
    log.info("wrote %s turns and %s samples to %s", counts["turns_written"], counts["samples_written"], target)
    return counts


def read_turns(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("conv_id long, turn long, num_turns long, role string, text string, n_chars long, split string").parquet(f"{target}/turns")


def read_samples(spark: SparkSession, target: str) -> DataFrame:
    schema = "conv_id long, turn long, role string, n_chars long, target_turn long, next_role string, next_n_chars long, num_turns long, split string, horizon int"
    return spark.read.schema(schema).parquet(f"{target}/samples")


def output(spark: SparkSession, target: str) -> DataFrame:
    """All tables as one, told apart by `kind`."""
    statuses = spark.read.schema("conv_id long, turns long, status string").parquet(f"{target}/statuses").withColumnRenamed("turns", "num_turns")
    named = lambda df, kind: df.withColumn("kind", F.lit(kind))
    found = named(read_turns(spark, target), "turn").unionByName(named(read_samples(spark, target), "sample"), allowMissingColumns=True)
    return found.unionByName(named(statuses, "status"), allowMissingColumns=True)


def job1_conversation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job run twice over the whole table into one new folder."""
    target, config = work_path(spark, "job1-conversation-samples"), defaults(__file__)
    for _ in range(2):
        run(spark, f"{sf_dir}/conversations.parquet", target, config)
    return output(spark, target)


SQL = """
WITH places AS (
  SELECT conv_id, turn, count(*) AS n, count(*) FILTER (role IS NULL OR turn IS NULL) AS nulls, count(*) FILTER (role NOT IN ('system', 'user', 'assistant', 'tool')) AS unknown
  FROM conversations GROUP BY conv_id, turn
), checked AS (
  SELECT conv_id, sum(n)::BIGINT AS num_turns, CASE WHEN conv_id IS NULL OR sum(nulls) > 0 THEN 'null_field' WHEN sum(unknown) > 0 THEN 'unknown_role' WHEN max(n) > 1 THEN 'repeated_turn'
    WHEN min(turn) <> 0 OR max(turn) + 1 <> count(turn) THEN 'missing_turn' ELSE 'success' END AS status
  FROM places GROUP BY conv_id
), turns AS (
  SELECT conv_id, turn, num_turns, role, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars,
    CASE WHEN ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT % 100 < 90 THEN 'train' ELSE 'val' END AS split
  FROM conversations JOIN checked USING (conv_id) WHERE status = 'success'
), samples AS (
  SELECT a.conv_id, a.turn, a.role, a.n_chars, b.turn AS target_turn, b.role AS next_role, b.n_chars AS next_n_chars, a.num_turns, a.split, h::INT AS horizon
  FROM turns a CROSS JOIN range(1, 4) r(h) JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + h
)
SELECT 'turn' AS kind, * FROM turns UNION ALL BY NAME SELECT 'sample' AS kind, * FROM samples UNION ALL BY NAME SELECT 'status' AS kind, * FROM checked
"""

if __name__ == "__main__":
    main(__doc__.splitlines()[0], __file__, run)
