"""One key with a third of all rows: joins split it, picks and counts shrink it before the shuffle."""

import pytest
from pyspark.sql import functions as F
from quotewright.operators.changes import set_status, update_rows
from quotewright.operators.joins import drop_keys, expand, keep_keys, lookup
from quotewright.operators.latest import last_per
from quotewright.operators.metrics import requested_parts

ROWS = 300_000


@pytest.fixture
def small_limits(spark):
    """Thresholds scaled down so that test data counts as large."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "300k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.shuffle.partitions": "32",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def facts(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, ROWS, 1, 16).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("quote_id"),
        F.concat(F.lit("p"), F.col("id") % 1000).alias("part_no"), F.lit("UPLOADED").alias("status"),
        F.sha2(F.col("id").cast("string"), 256).alias("filler"), F.col("id").alias("_seq"),
    )


def keys(df):
    return df.select("quote_id").distinct().withColumn("tag", F.lit("x"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.agg(F.sum(F.hash(*df.columns)), F.count(F.lit(1)))
    count = rows.collect()[0][1]
    return rows._jdf.queryExecution().executedPlan().toString(), count


CASES = {
    "lookup": lambda f: lookup(f, keys(f), ["quote_id"]),
    "expand, hot right side": lambda f: expand(keys(f), f, ["quote_id"]),
    "keep_keys": lambda f: keep_keys(f, keys(f), ["quote_id"]),
    "drop_keys": lambda f: drop_keys(f, keys(f).where("quote_id <> 'hot'"), ["quote_id"]),
    "update_rows": lambda f: update_rows(f, keys(f), ["quote_id"], {"status": lambda new: new("tag")}),
    "set_status": lambda f: set_status(f, keys(f), "quote_id", "DONE"),
}


@pytest.mark.parametrize("case", CASES)
def test_joins_split_a_hot_key(spark, small_limits, case):
    plan, count = final_plan(CASES[case](facts(spark)))
    assert "skew=true" in plan
    assert count == (ROWS // 3 if case == "drop_keys" else ROWS)


def shuffled_rows(df):
    """Rows written by each exchange of the executed plan."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("StageExec"):
            walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_picks_send_one_row_per_key_and_task(spark, small_limits):
    only_hot = facts(spark).withColumn("quote_id", F.lit("hot"))
    assert max(shuffled_rows(last_per(only_hot, ["quote_id"]))) <= 16
    # counted parts: at most one row per part and task
    assert max(shuffled_rows(requested_parts(only_hot))) <= 16 * 1000
