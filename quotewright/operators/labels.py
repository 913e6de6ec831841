"""Unique display labels.

In order, each row takes the first of its candidates that no earlier row has: its base label, ``base | d`` for each
disambiguator d, ``base (#2)``, ``base (#3)`` and so on. Labels are compared as they read, so a base label such as
``A | B`` or ``A (#2)`` may stand in the way of another base's longer form.

No group of rows is walked through. Rows claim a candidate; of all that ever claimed a label the earliest has it,
which settles the label as if rows had come one by one: a row that lost a label has lost it to an earlier row, and
whoever takes the label from that one is earlier still. Each round holds only the rows that lost a label in the
round before, with what they need for their next claims. Rows that run out of disambiguators are numbered together, by their place among such rows of their
base; a number whose label belongs to an earlier row of another base is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text, label
from ..session import materialize
from .joins import fresh_keys, keep_keys, lookup, pair
from .numbering import with_group_position

_LABEL = ["_scope", "label"]
_GROUP = ["_scope", "_base"]
_CLAIM = [*_LABEL, "_pos", "_at", "_numbered"]
_NEXT = ["_cut", "_more"]  # for a row's next claim: how much of its label is the base, and the disambiguators left


def unique_labels(
    df: DataFrame, base: list[str], disambiguators: list[str], order: list[str], scope: list[str] | None = None,
) -> DataFrame:
    """Add ``label``, unique within ``scope`` (null is a scope of its own), by the rule above.

    Rows equal in ``order`` come in some order. Blank disambiguators are skipped; a blank base reads ``N/A``.
    """
    clean = [F.nullif(clean_text(F.col(d)), F.lit("")) for d in disambiguators]
    none = F.array().cast("array<string>")
    # stored once, unsorted: the place in the files only tells rows apart that are equal in ``order``
    stored = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows-to-label")
    rows = stored.select(
        *df.columns, label(*[F.col(c) for c in base]).alias("_base"),
        F.struct(*[F.col(c) for c in scope or []], F.lit(0).cast("byte").alias("_all")).alias("_scope"),
        (F.array_distinct(F.array_compact(F.array(*clean))) if clean else none).alias("_more"),
        F.struct(*order, "_row").alias("_pos"))

    claims = rows.select("_scope", F.col("_base").alias("label"), "_pos", F.lit(0).alias("_at"), F.lit(False).alias("_numbered"),
        F.lit(0).alias("_cut"), "_more")
    log, later, rest, numbers = [], [], [], None
    while True:
        # named candidates, until no row loses one
        while True:
            lost = _lost(claims, log, rows)
            log.append(claims.select(*_CLAIM))
            if lost.isEmpty():
                break
            # the first claim is the base itself
            moved = lost.withColumn("_cut", F.when(F.col("_at") == 0, F.length("label")).otherwise(F.col("_cut")))
            moved = moved.withColumn("_base", F.left("label", F.col("_cut")))
            more = F.size("_more") > 0
            claims = moved.where(more).select(
                "_scope", F.concat_ws(" | ", "_base", F.get("_more", F.lit(0))).alias("label"), "_pos", (F.col("_at") + 1).alias("_at"),
                F.lit(False).alias("_numbered"), "_cut", F.slice("_more", F.lit(2), F.size("_more")).alias("_more"))
            rest.append(moved.where(~more).select(*_GROUP, "_pos"))
            later.append(claims)
        if not rest or _all(rest).isEmpty():
            break
        numbers, taken = _numbered(_all(rest), log)
        if taken is None:
            break
        # a row of another base may just have been overtaken by a number
        claims = materialize(taken.join(_all(log).where("_numbered").select(*_LABEL, "_pos"), [*_LABEL, "_pos"], "left_anti"), "numbered-labels")
        if claims.isEmpty():
            break
        claims = claims.withColumns({"_cut": F.lit(0), "_more": none})

    if numbers is not None:
        later.append(numbers.select("_pos", F.lit(1 << 30).alias("_at"), "label"))
    rows = rows.withColumn("_row", F.col("_pos._row"))
    if later:
        last = _all([part.select(F.col("_pos._row").alias("_row"), "_at", "label") for part in later])
        rows = pair(rows, last.groupBy("_row").agg(F.max_by("label", "_at").alias("_last")), ["_row"])
    else:
        rows = rows.withColumn("_last", F.lit(None).cast("string"))
    return rows.select(*df.columns, F.coalesce("_last", "_base").alias("label"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _lost(claims: DataFrame, log: list[DataFrame], rows: DataFrame) -> DataFrame:
    """Claims that lose their label: new ones that come too late, and the one that has it if a new one is earlier; with
    what their rows can claim next.

    Numbered rows are not listed, as all numbers of their base are given out anew.
    """
    now = claims.groupBy(*_LABEL).agg(F.min("_pos").alias("_now"), F.count(F.lit(1)).alias("_claims"))
    several, named = F.col("_claims") > 1, ~F.col("_numbered")
    before = _before(claims, log) if log else None
    if before is None:
        late = claims.join(fresh_keys(now.where(several), _LABEL), _LABEL).where(named & (F.col("_pos") > F.col("_now")))
        return materialize(late.select(*_CLAIM, *_NEXT), "lost-labels")
    had = before.groupBy(*_LABEL).agg(F.min("_pos").alias("_had"))
    state = materialize(lookup(now, had, _LABEL).where(several | F.col("_had").isNotNull()), "claimed-labels")
    late = claims.join(fresh_keys(state, _LABEL), _LABEL).where(named & (F.col("_pos") > F.least("_now", "_had"))).select(*_CLAIM, *_NEXT)
    firsts = state.where(F.col("_now") < F.col("_had")).select(*_LABEL, F.col("_had").alias("_pos"))
    overtaken = materialize(before.join(firsts, [*_LABEL, "_pos"]).where(named).select(*_CLAIM), "overtaken-labels")
    if not overtaken.isEmpty():
        own = keep_keys(rows.select("_pos", F.length("_base").alias("_cut"), "_more"), overtaken, ["_pos"])
        left = F.slice("_more", F.col("_at") + 1, F.size("_more"))
        late = late.unionByName(pair(overtaken, own, ["_pos"]).withColumn("_more", left))
    return materialize(late, "lost-labels")


def _before(claims: DataFrame, log: list[DataFrame]) -> DataFrame | None:
    """Earlier claims on the labels that are claimed now, None if there can be none.

    Equal labels have equally many separators: claims with fewer or more than any new one are not shuffled.
    """
    text = F.col("label")
    bars = F.length(text) - F.length(F.replace(text, F.lit(" | "), F.lit("")))
    least, most = claims.agg(F.min(bars), F.max(bars)).first()
    near = _all(log).where(bars.between(least, most))
    return None if least is None or near.isEmpty() else materialize(keep_keys(near, claims, _LABEL), "earlier-claims")


def _numbered(rest: DataFrame, log: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Labels ``base (#n)`` of the rows without another (``_pos, label``), and claims for those that named rows asked
    for, None if there are none."""
    ranked = materialize(with_group_position(rest, _GROUP, ["_pos"], "_rank"), "ranked-labels")
    asked = _asked(ranked, log)
    taken = None
    if not asked.isEmpty():
        asked, taken = _left_out(ranked, asked)
        # a number left out stands before the rows that move on to the next one
        out = asked.where("_out").select(*_GROUP, (F.col("_n") - 2 - F.col("_before")).alias("_rank"), F.lit(0).alias("_kind"), F.lit(None).cast(ranked.schema["_pos"].dataType).alias("_pos"))
        both = ranked.select(*_GROUP, "_rank", F.lit(1).alias("_kind"), "_pos").unionByName(out)
        ranked = with_group_position(both, _GROUP, ["_rank", "_kind"], "_place").where(F.col("_kind") == 1).select(
            *_GROUP, "_pos", F.col("_place").alias("_rank"))
    numbers = ranked.select("_pos", _number_label(F.col("_rank") + 2).alias("label"))
    return materialize(numbers, "numbers"), taken


def _number_label(n):
    return F.concat(F.col("_base"), F.lit(" (#"), n.cast("string"), F.lit(")"))


def _asked(ranked: DataFrame, log: list[DataFrame]) -> DataFrame:
    """``_scope, _base, _n, _by``: labels ``base (#n)`` of bases with numbered rows that named rows asked for first."""
    # more digits than any count of rows has are no number
    form = r"(?s)^(.*) \(#([1-9][0-9]{0,17})\)$"
    read = _all(log).where(~F.col("_numbered") & F.col("label").rlike(form)).select(
        "_scope", F.regexp_extract("label", form, 1).alias("_base"), F.regexp_extract("label", form, 2).cast("long").alias("_n"), "_pos")
    return materialize(keep_keys(read.where(F.col("_n") >= 2), ranked, _GROUP).groupBy(*_GROUP, "_n").agg(
        F.min("_pos").alias("_by")), "asked-numbers")


def _left_out(ranked: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which of the asked numbers are left out (``_out``), and how many of those come before each (``_before``); and
    the claims of numbered rows for the others.

    A number is left out if the row whose turn it would be is later than the one that asked. Turns depend on the
    numbers left out before, so this repeats until nothing changes: at first for the least number of each base.
    """
    asked = asked.withColumn("_out", F.lit(False))
    while True:
        place = with_group_position(asked, _GROUP, ["_n"], "_place")
        # how many of the left out come before: all before less those that stay
        stay = with_group_position(asked.where(~F.col("_out")), _GROUP, ["_n"], "_stay").select(*_GROUP, "_n", "_stay")
        out = with_group_position(asked.where("_out"), _GROUP, ["_n"], "_gone").select(*_GROUP, "_n", "_gone")
        counted = lookup(lookup(place, stay, [*_GROUP, "_n"]), out, [*_GROUP, "_n"])
        counted = counted.select(*_GROUP, "_n", "_by", "_out", F.coalesce("_gone", F.col("_place") - F.col("_stay")).alias("_before"))
        turn = counted.withColumn("_rank", F.col("_n") - 2 - F.col("_before"))
        turn = lookup(turn, ranked.withColumnRenamed("_pos", "_turn"), [*_GROUP, "_rank"])
        now = F.coalesce(F.col("_by") < F.col("_turn"), F.lit(False))
        turn = materialize(turn.withColumn("_now", now), "numbers-left-out")
        if turn.where(F.col("_now") != F.col("_out")).isEmpty():
            taken = turn.where(~F.col("_out") & F.col("_turn").isNotNull()).select(
                "_scope", _number_label(F.col("_n")).alias("label"), F.col("_turn").alias("_pos"), F.lit(0).alias("_at"),
                F.lit(True).alias("_numbered"))
            return turn, taken
        asked = turn.select(*_GROUP, "_n", "_by", F.col("_now").alias("_out"))
