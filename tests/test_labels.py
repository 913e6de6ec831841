"""Unique labels and numbering against the one-row-at-a-time rule."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quotewright.operators.labels import unique_labels
from quotewright.operators.numbering import assign_submission_ids, next_numeric_id, with_group_position, with_position

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def one_by_one(rows):
    """Labels of (base, [disambiguators]) in order, each looking at all labels given before."""
    given_, out = set(), []
    for base, values in rows:
        base = (base or "").strip() or "N/A"
        tries = [base] + [f"{base} | {v.strip()}" for v in values if v and v.strip()]
        n = 2
        while not any(t not in given_ for t in tries):
            tries.append(f"{base} (#{n})")
            n += 1
        out.append(next(t for t in tries if t not in given_))
        given_.add(out[-1])
    return out


def labels_of(spark, rows):
    data = [(i, "w", b, v[0], v[1]) for i, (b, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "n bigint, scope string, b string, d1 string, d2 string")
    got = unique_labels(df, ["b"], ["d1", "d2"], ["n"], ["scope"])
    return [r.label for r in got.orderBy("n").select("label").collect()]


def test_labels_by_hand(spark):
    rows = [("P", ("q1", "r1"))] * 5 + [("P", ("q2", "r1")), ("P", (None, "r2")), ("P", (" ", None)), (None, ("q", "r")), ("", ("q", "r"))]
    assert labels_of(spark, rows) == one_by_one(rows)
    assert labels_of(spark, rows)[:5] == ["P", "P | q1", "P | r1", "P (#2)", "P (#3)"]


def test_value_in_two_roles(spark):
    # x is a first choice of one row and a second choice of an earlier one, which starts a chain
    rows = [("P", ("a", "a"))] + [("P", ("a", "x"))] * 2 + [("P", ("x", "y"))] * 2 + [("P", ("y", "z"))] * 3 + [("P", ("z", "a"))]
    assert labels_of(spark, rows) == one_by_one(rows)


value = st.sampled_from(["a", "b", "c", " ", None])


@FEW
@given(st.lists(st.tuples(st.sampled_from(["P", "Q", None]), st.tuples(value, value)), min_size=1, max_size=25))
def test_labels(spark, rows):
    assert labels_of(spark, rows) == one_by_one(rows)


WORDS = ["A", "B", "A | B", "A (#2)", "A (#3)", "A | B (#2)", "B | A", "(#2)", "A (#2) (#2)", "A (#02)", None]
VALUES = ["B", "A", "B (#2)", "(#2)", "A | B", " ", None]


def test_labels_across_bases(spark):
    """Many small scopes at once, with separators and numbers inside base labels and values."""
    draw = random.Random(6)
    cases = [[(draw.choice(WORDS[: draw.randrange(2, 12)]), (draw.choice(VALUES), draw.choice(VALUES)))
              for _ in range(draw.randrange(1, 22))] for _ in range(400)]
    data = [(n * 1000 + i, None if n == 0 else f"s{n}", b, *v) for n, rows in enumerate(cases) for i, (b, v) in enumerate(rows)]
    df = spark.createDataFrame(draw.sample(data, len(data)), "n bigint, scope string, b string, d1 string, d2 string")
    got = unique_labels(df, ["b"], ["d1", "d2"], ["n"], ["scope"]).orderBy("n").collect()
    assert [r.label for r in got] == [label for rows in cases for label in one_by_one(rows)]
    assert len({(r.scope, r.label) for r in got}) == len(got)


def test_labels_found_not_unique_before(spark):
    rows = [("A | B", ("C", None)), ("A | B", ("Q", None)), ("A | B | Q", (None, None)), ("A | B", ("Q", None)), ("A | B (#2)", (None, None))]
    assert labels_of(spark, rows) == one_by_one(rows)
    assert len(set(labels_of(spark, rows))) == 5


def test_numbers_that_other_bases_hold(spark):
    # every second number of the hot base is the base of a row, before, between or after the rows that are numbered
    rows = [(f"P (#{2 * k})", (None, None)) for k in range(1, 12)] + [("P", (None, None))] * 30
    rows += [(f"P (#{k})", ("x", "y")) for k in (3, 5, 38, 44, 45, 46, 47)] + [("P", (None, None))] * 6
    assert labels_of(spark, rows) == one_by_one(rows)
    mixed = random.Random(8).sample(rows, len(rows))
    assert labels_of(spark, mixed) == one_by_one(mixed)


def test_hot_base_and_hot_label_are_not_gathered(spark):
    """A third of the rows share a base, a third ask for one longer label; no window runs over such a group."""
    n = 6000
    base = F.when(F.col("id") % 3 == 0, "P").when(F.col("id") % 3 == 1, F.concat(F.lit("Q"), F.col("id") % 2)).otherwise(
        F.concat(F.lit("P (#"), (F.col("id") % 50).cast("string"), F.lit(")")))
    value = F.when(F.col("id") % 2 == 0, "v")
    df = spark.range(n).select("id", F.lit("w").alias("w"), base.alias("b"), value.alias("d"))
    got = unique_labels(df, ["b"], ["d"], ["id"], ["w"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and all("_part" in line for line in plan.splitlines() if "windowspecdefinition" in line)
    rows = got.orderBy("id").collect()
    assert [r.label for r in rows] == one_by_one([(r.b, (r.d,)) for r in rows])


def test_labels_of_one_hot_group(spark):
    df = spark.range(3000).select("id", F.lit("w").alias("w"), F.lit("P").alias("b"), F.lit("q").alias("d"))
    got = unique_labels(df, ["b"], ["d"], ["id"], ["w"])
    assert got.select("label").distinct().count() == 3000
    assert got.orderBy(F.col("id").desc()).first().label == "P (#2999)"


def test_positions(spark):
    df = spark.range(1000).select((F.pmod(F.xxhash64("id"), F.lit(10**6))).alias("v"), "id")
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.v, r.id)))}
    assert {r.id: r._pos for r in with_position(df, ["v", "id"]).collect()} == want


def test_group_positions(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), "id")
    df = df.unionByName(spark.createDataFrame([(None, 5001), (None, 5000)], "k string, id bigint"))
    seen, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        want[(r.k, r.id)] = seen.get(r.k, 0)
        seen[r.k] = seen.get(r.k, 0) + 1
    assert {(r.k, r.id): r._pos for r in with_group_position(df, ["k"], ["id"]).collect()} == want


def test_ids_of_a_batch(spark):
    on_file = spark.createDataFrame([("SUB0007",), ("SUB9998",), ("X99999",), (None,), ("SUBSUB5",)], "submission_id string")
    batch = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "_seq bigint, k string")
    got = {r.k: r.submission_id for r in assign_submission_ids(batch, on_file, ["_seq"]).collect()}
    assert got == {"a": "SUB9999", "b": "SUB10000", "c": "SUB10001"}
    assert assign_submission_ids(batch, on_file.limit(0), ["_seq"]).where("k = 'a'").first().submission_id == "SUB0001"


def test_next_numeric_id(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,), ("12",)], "id string")
    assert next_numeric_id(df, "id").first()[0] == 13
    assert next_numeric_id(df.limit(0), "id").first()[0] == 1
