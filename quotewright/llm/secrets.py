"""Secrets in texts: base patterns, and weak candidates that only count beside their complement.

A credential often has several parts: an access identifier, a secret and an endpoint. Strong parts (the base
kinds) are always reported. Weak ones - a login name, an unmarked random string, a service address - are common
in clean texts; they are reported only where parts that complete each other lie within one scope. Parts of all
texts are joined by interval: texts are divided into stretches as long as a scope, a part lies in every stretch it
covers, parts meet in the same or a neighbouring stretch, and the gap between them decides. That bounds the work by
the text, however many parts it holds. Places are summed up in groups of ``GROUP`` matches, so that a text with very
many of them costs what it holds and not the square of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Two parts belong together if at most so many code points lie between them.
SCOPE = 160
#: Matches that are folded one by one into a growing list or text.
GROUP = 128

VALUE = r"[A-Za-z0-9+/_.=-]"
# kind, pattern, role, weak: in the order in which kinds at the same start are listed (fixed values)
KINDS: list[tuple[str, str, str, bool]] = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", False),
    ("access", r"AKIA[A-Z0-9]+", "identifier", False),
    ("hex", r"[0-9a-f]{24,}", "secret", False),
    ("login", r"""(?i)(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@-]{3,}""", "identifier", True),
    ("random", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}", "secret", True),
    ("endpoint", r"""(?i)(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp|ftp)://[^\s"'<>]+""", "endpoint", True),
]
BASE = [kind for kind, _, _, weak in KINDS if not weak]
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _long_enough(kind: str, pattern: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, pattern, 2)) >= 6
    return F.length(match) >= 20 if kind == "access" else F.lit(True)


def _spans(found: Column, rank: int, kind: str, pattern: str) -> Column:
    """Places of all matches, summed up from the lengths of the stretches between them.

    Matches that are too short are dropped only here: the search goes on behind them.
    """
    none = F.array().cast(_SPAN)
    between = F.slice(F.split("_text", pattern, -1), 1, F.size(found))
    steps = F.zip_with(between, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        longer = F.array_append(state["out"], span)
        out = F.when(_long_enough(kind, pattern, x["match"]), longer).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def placed(groups: Column) -> Column:
        sizes = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["match"])))
        return F.flatten(F.zip_with(groups, _before_each(sizes, F.lit(0), lambda n, x: n + x), lambda g, at: F.aggregate(
            g, F.struct(at.alias("at"), none.alias("out")), step, lambda state: state["out"])))

    return F.when(F.size(found) == 0, none).otherwise(_let(_groups(steps), placed))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used, also inside of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _groups(items: Column) -> Column:
    """An array that is not empty, in arrays of ``GROUP``."""
    def cut(held: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / GROUP).cast("int"))
        return F.transform(numbers, lambda k: F.slice(held, k * GROUP + 1, F.lit(GROUP)))

    return _let(items, cut)


def _before_each(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each value what the values before it come to."""
    def before(held: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(held) - 1)
        return F.transform(numbers, lambda k: F.aggregate(F.slice(held, F.lit(1), k), zero, merge))

    return _let(values, before)


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(kind) for kind, *_ in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"]), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """``doc_id, _hash, base, weak``: the spans of each text, as arrays of ``struct(start, rank, end)``.

    ``with_row`` adds the input row as ``_row``.

    ``rank`` is the place of the kind in ``KINDS``, from 1. Starts and ends are code points, the end exclusive.
    """
    whole = [F.struct(*[F.col(c) for c in docs.columns]).alias("_row")] if with_row else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *whole)
    rows = rows.select("*", *[
        F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias(f"_{kind}") for kind, pattern, _, _ in KINDS])
    found = {kind: _spans(F.col(f"_{kind}"), rank, kind, pattern)
             for rank, (kind, pattern, _, _) in enumerate(KINDS, 1)}
    weak = [kind for kind, _, _, is_weak in KINDS if is_weak]
    return rows.select(
        "doc_id", F.xxhash64("_text").alias("_hash"),
        F.concat(*[found[kind] for kind in BASE]).alias("base"),
        F.concat(*[found[kind] for kind in weak]).alias("weak"),
        *[F.col("_row")] * with_row,
    )


def _several() -> Column:
    """A text with a weak candidate and something beside it."""
    return (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)


def link_parts(parts: DataFrame) -> DataFrame:
    """``doc_id, _hash, linked``: the weak spans that are reported, for texts that have any.

    An identifier and a secret within one scope make a credential if one of them is strong, or if an endpoint
    lies within the scope as well; so do a strong secret and an endpoint. Their weak parts are reported.
    """
    role = F.array(*[F.lit(role) for _, _, role, _ in KINDS])
    weak = F.array(*[F.lit(is_weak) for *_, is_weak in KINDS])
    # a repeated row links like the first
    spans = (
        parts.where(_several()).select("doc_id", "_hash", F.concat("base", "weak").alias("_all")).distinct()
        .select("doc_id", "_hash", F.explode("_all").alias("s"))
        .select("doc_id", "_hash", "s", F.element_at(role, F.col("s.rank")).alias("role"),
                F.element_at(weak, F.col("s.rank")).alias("is_weak"),
                F.floor(F.col("s.start") / SCOPE).alias("_first"), F.floor(F.col("s.end") / SCOPE).alias("_last"))
    )

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs within a scope, each once: in the first stretch they share. Columns of ``right`` get the prefix ``o_``."""
        other = right.select(
            F.col("doc_id").alias("o_id"), F.col("_hash").alias("o_hash"), F.col("s").alias("o_s"),
            F.col("is_weak").alias("o_weak"), F.col("_first").alias("o_first"),
            F.explode(F.sequence("_first", "_last")).alias("o_meet"))
        gap = F.greatest(F.col("s.start") - F.col("o_s.end"), F.col("o_s.start") - F.col("s.end"))
        return left.withColumn("_meet", F.explode(F.sequence(F.col("_first") - 1, F.col("_last") + 1))).join(
            other,
            F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("_hash") == F.col("o_hash"))
            & (F.col("_meet") == F.col("o_meet")) & (F.col("_meet") == F.greatest(F.col("_first") - 1, F.col("o_first")))
            & (gap <= SCOPE),
        )

    def of(name: str) -> DataFrame:
        return spans.where(F.col("role") == name)

    key = ["doc_id", "_hash"]
    pairs = near(of("identifier"), of("secret"))
    strong = pairs.where(~F.col("is_weak") | ~F.col("o_weak"))
    both_weak = pairs.where(F.col("is_weak") & F.col("o_weak")).select(
        *key, "s", F.col("o_s").alias("s2"), "is_weak", "_first", "_last")
    completed = near(both_weak, of("endpoint"))
    served = near(of("secret").where(~F.col("is_weak")), of("endpoint"))
    reported = (
        strong.select(*key, F.explode(F.array("s", "o_s")).alias("s"))
        .unionByName(completed.select(*key, F.explode(F.array("s", "s2", "o_s")).alias("s")))
        .unionByName(served.select(*key, F.col("o_s").alias("s")))
        .where(F.element_at(weak, F.col("s.rank")))
    )
    # at most as many spans as the one text has
    return reported.groupBy(*key).agg(F.collect_set("s").alias("linked"))


def _with_links(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Parts with the array ``linked``; only texts that may have links are joined."""
    found = links.withColumnsRenamed({"doc_id": "l_id", "_hash": "l_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("_hash") == F.col("l_hash"))
    none = F.array().cast(_SPAN)
    joined = parts.where(_several()).join(found, same, "left").select(
        *parts.columns, F.coalesce("linked", none).alias("linked"))
    return joined.unionByName(parts.where(~_several()).withColumn("linked", none))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base, linked, base_list, span_list``.

    ``base`` and ``linked`` are arrays of ``struct(start, rank, end)``; the lists name them ``kind:start:end``
    by start and kind, comma-joined. A null text counts as empty and has no span; repeated rows get the same
    result each; null ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    parts = materialize(find_parts(docs, id_col, text_col), "secret-parts")
    rows = _with_links(parts, link_parts(parts))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return rows.select(
        "doc_id", *[count(BASE.index(kind) + 1).alias(f"n_{kind}") for kind in BASE],
        "base", "linked",
        _listed(F.col("base")).alias("base_list"),
        _listed(F.concat("base", "linked")).alias("span_list"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span, or run of overlapping spans, replaced; a group of spans at a time."""
    def one(group: Column, begin: Column) -> Column:
        # the part of the text from where the groups before end to where this one does
        part = F.substr(text, begin + 1, F.greatest(begin, F.array_max(F.transform(group, lambda s: s["end"]))) - begin)

        def step(state: Column, span: Column) -> Column:
            gap = F.substr(state["part"], state["at"] - begin + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
            fresh = span["start"] >= state["at"]
            return F.struct(
                F.greatest(state["at"], span["end"]).alias("at"),
                F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"),
                state["part"].alias("part"))

        start = F.struct(begin.alias("at"), F.lit("").alias("out"), part.alias("part"))
        return F.aggregate(group, start, step, lambda state: state["out"])

    def whole(groups: Column) -> Column:
        tops = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda s: s["end"])))
        begins = _before_each(tops, F.lit(0), lambda top, x: F.greatest(top, x))
        rest = F.substr(text, F.array_max(tops) + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(groups, begins, one), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(_let(_groups(F.array_sort(spans)), whole))


def mask_secrets(docs: DataFrame, mask: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mask``; all rows, all columns.

    A column ``n_chars`` follows the new length of a text that was changed. Rows as in ``find_secrets``.
    """
    parts = materialize(find_parts(docs, id_col, text_col, with_row=True), "secret-parts")
    rows = _with_links(parts, link_parts(parts.drop("_row"))).withColumn("_spans", F.concat("base", "linked"))
    text = F.col("_row")[text_col]
    rows = rows.withColumn("_masked", _masked(text, F.col("_spans"), mask))
    size = F.when(F.size("_spans") == 0, F.col("_row")["n_chars"]).otherwise(F.length("_masked").cast(
        docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None
    changed = {text_col: F.col("_masked"), "n_chars": size}
    return rows.select(*[(changed[c] if changed.get(c) is not None else F.col("_row")[c]).alias(c) for c in docs.columns])
