"""The desk's changes on versions of the tables: each rewrites the files it touches and commits once.

Every method starts from the latest version, applies the change of ``plans.mutations`` to the files that hold a key
it names, keeps the counts of asked and answered parts up to date, and publishes all of it as the next version. It
returns how many rows of each table were updated, inserted and deleted. If another change came first, ``Conflict``
is raised and nothing has happened: call again. ``base`` starts from a version that was looked at before, and
``notes`` are published with the change.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bundle import Tables
from ..functions import submission_number
from ..operators.changes import append_numbered, delete_rows, set_status
from ..operators.joins import keep_keys
from ..schemas import ASSIGNED, ASSIGNMENTS, DELETED, FINAL_QUOTES, QUOTES, SEQ, SUBMISSIONS, USERS
from ..session import materialize
from ..sources.versions import BEFORE, Layout, Rewrite, Snapshot, Store
from . import mutations, progress
from .mutations import OFFER, PART, Top

NAMES = ["quotes", "submissions", "assignments", "users", "final_quotes"]
COUNTS = "part_counts"


def _layout(schema, key: str = "quote_id", **highest) -> Layout:
    return Layout(schema, key, {SEQ: lambda: F.col(SEQ), **highest})


LAYOUTS = {
    "quotes": _layout(QUOTES), "assignments": _layout(ASSIGNMENTS), "final_quotes": _layout(FINAL_QUOTES),
    "submissions": _layout(SUBMISSIONS, number=lambda: submission_number(F.col("submission_id"))),
    "users": _layout(USERS, "user_id"), COUNTS: Layout(progress.PART_COUNTS, "quote_id"),
}


@dataclass(frozen=True)
class Outcome:
    snapshot: Snapshot
    rewrites: dict[str, Rewrite]

    def affected(self) -> dict[str, tuple[int, int, int]]:
        """Rows updated, inserted and deleted, of each table of the desk that the change looked at."""
        return {name: (r.updated, r.inserted, r.deleted) for name, r in self.rewrites.items() if name != COUNTS}


class Desk:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root, LAYOUTS)

    def create(self, tables: Tables) -> Snapshot:
        """The first version, with the counts of all rows, which are read from its files: ``tables`` may be costly views."""
        files = {name: self.store.write(name, getattr(tables, name)) for name in NAMES}
        written = [self.store.read_files(name, files[name]) for name in ("quotes", "submissions")]
        files[COUNTS] = self.store.write(COUNTS, progress.part_counts(*written))
        return self.store.commit(None, files)

    def tables(self, snapshot: Snapshot | None = None) -> Tables:
        snapshot = snapshot or self.latest()
        return Tables(**{name: self.store.read(snapshot, name) for name in NAMES})

    def counts(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.store.read(snapshot or self.latest(), COUNTS)

    def latest(self) -> Snapshot:
        found = self.store.latest()
        if found is None:
            raise LookupError(f"no version of the tables in {self.store.root}")
        return found

    def _top(self, base: Snapshot, name: str) -> Top:
        return Top(F.lit(base.highest(name, SEQ, -1)), F.lit(base.highest(name, "number", 0)))

    def _some(self, base: Snapshot, name: str, keys_of: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of the files that hold one of the keys."""
        return self.store.read_files(name, self.store.touched(base, name, keys_of, keys))

    def _count(self, base: Snapshot, rewrites: dict[str, Rewrite]) -> Rewrite | None:
        """The counts after these rewrites, by what was replaced and written."""
        parts = [
            progress.counts_of(name, self.store.read_files(name, files), sign)
            for name in ("quotes", "submissions") if name in rewrites
            for files, sign in ((rewrites[name].replaced, -1), (rewrites[name].written, 1)) if files
        ]
        if not parts:
            return None
        difference = materialize(progress.summed(reduce(DataFrame.unionByName, parts)), "count-differences")
        if difference.isEmpty():
            return None

        def change(part: DataFrame) -> DataFrame:
            both = part.unionByName(difference, allowMissingColumns=True)
            total = both.groupBy(*PART).agg(*[F.sum(c).alias(c) for c in progress.NUMBERS], F.first(BEFORE, ignorenulls=True).alias(BEFORE))
            return total.where(" OR ".join(f"{c} <> 0" for c in progress.NUMBERS))

        return self.store.rewrite(base, COUNTS, [(difference, ["quote_id"])], change)

    def _commit(
        self, base: Snapshot, rewrites: dict[str, Rewrite], promote: DataFrame | None = None, notes: dict[str, int] | None = None,
    ) -> Outcome:
        """Publish the rewrites with the counts they lead to; ``promote`` names quotes that may now be fully answered."""
        counted = self._count(base, rewrites)
        if promote is not None:
            after = replace(base, files={**base.files, **({COUNTS: counted.files} if counted else {})})
            counts = keep_keys(self._some(after, COUNTS, promote, ["quote_id"]), promote, ["quote_id"])
            complete = materialize(progress.complete_quotes(counts), "complete-quotes")
            # the status that is set bars nothing, so the counts stay as they are
            rewrites["quotes"] = self.store.rewrite(
                base, "quotes", [(complete, ["quote_id"])], lambda part: progress.promote(part, complete))
        if counted:
            rewrites[COUNTS] = counted
        return Outcome(self.store.commit(base, {name: r.files for name, r in rewrites.items()}, notes), rewrites)

    # --- quotes and assignments

    def ingest_quotes(
        self, upload: DataFrame, as_of: str | Column | None = None, number_type: str = "double",
        base: Snapshot | None = None, notes: dict[str, int] | None = None,
    ) -> Outcome:
        base = base or self.latest()
        add = lambda part: mutations.ingest_quotes(part, upload, as_of, number_type, self._top(base, "quotes"))
        return self._commit(base, {"quotes": self.store.rewrite(base, "quotes", [], add)}, notes=notes)

    def soft_delete(self, ids: DataFrame) -> Outcome:
        base = self.latest()
        change = lambda part: mutations.soft_delete(part, ids)
        return self._commit(base, {"quotes": self.store.rewrite(base, "quotes", [(ids, ["quote_id"])], change)})

    def complete_refs(self, refs: DataFrame, keep_deleted: bool = False) -> Outcome:
        base = self.latest()
        change = lambda part: mutations.complete_refs(part, refs, keep_deleted)
        return self._commit(base, {"quotes": self.store.rewrite(base, "quotes", [(refs, ["customer_ref_no"])], change)})

    def purge_deleted(self) -> Outcome:
        base = self.latest()
        gone = materialize(mutations.deleted_quote_ids(self.store.read(base, "quotes")), "deleted-quotes")
        change = lambda part: delete_rows(part, gone, ["quote_id"])
        return self._commit(base, {
            name: self.store.rewrite(base, name, [(gone, ["quote_id"])], change)
            for name in ("quotes", "assignments", "submissions", "final_quotes")})

    def assign_quotes(self, requests: DataFrame, as_of: str | Column | None = None) -> Outcome:
        base = self.latest()
        some = {name: self._some(base, name, requests, ["quote_id"]) for name in ("quotes", "assignments")}
        rows = materialize(mutations.assignment_rows(
            some["quotes"], some["assignments"], self.store.read(base, "users"), requests, as_of), "accepted-assignments")
        top = self._top(base, "assignments").seq
        return self._commit(base, {
            "assignments": self.store.rewrite(base, "assignments", [], lambda part: append_numbered(part, rows, "_place", top=top)),
            "quotes": self.store.rewrite(base, "quotes", [(rows, ["quote_id"])], lambda part: set_status(
                part, rows, "quote_id", ASSIGNED, keep=[DELETED]))})

    # --- offers

    def _change_offers(self, requests: DataFrame, change) -> Outcome:
        base = self.latest()
        return self._commit(base, {"submissions": self.store.rewrite(base, "submissions", [(requests, ["submission_id"])], change)})

    def edit_offers(self, edits: DataFrame) -> Outcome:
        return self._change_offers(edits, lambda part: mutations.edit_offers(part, edits))

    def send_back(self, requests: DataFrame) -> Outcome:
        users = self.store.read(self.latest(), "users")
        return self._change_offers(requests, lambda part: mutations.send_back(part, requests, users))

    def attach_certificates(self, requests: DataFrame) -> Outcome:
        return self._change_offers(requests, lambda part: mutations.attach_certificates(part, requests))

    def resubmit(self, requests: DataFrame, as_of: str | Column | None = None) -> Outcome:
        return self._change_offers(requests, lambda part: mutations.resubmit(part, requests, as_of))

    def submit_offers(
        self, requests: DataFrame, as_of: str | Column | None = None, base: Snapshot | None = None,
        notes: dict[str, int] | None = None,
    ) -> Outcome:
        base = base or self.latest()
        values = materialize(mutations.offer_values(requests, as_of), "offer-values")
        change = lambda part: mutations.upsert_offers(part, values, self._top(base, "submissions"))
        return self._commit(base, {"submissions": self.store.rewrite(base, "submissions", [(values, OFFER)], change)}, values, notes)

    def mark_no_quote(self, requests: DataFrame, as_of: str | Column | None = None) -> Outcome:
        base = self.latest()
        change = lambda part: mutations.mark_no_quote(part, requests, as_of, self._top(base, "submissions"))
        return self._commit(base, {"submissions": self.store.rewrite(base, "submissions", [(requests, [*PART, "worker_id"])], change)})

    def offer_from_no_quote(self, requests: DataFrame, as_of: str | Column | None = None) -> Outcome:
        base = self.latest()
        values = mutations.no_quote_values(requests, as_of)
        named = values.select(F.col("target").alias("submission_id"))
        change = lambda part: mutations.claim_no_quotes(part, values, self._top(base, "submissions"))
        touched = [(values, OFFER), (named, ["submission_id"])]
        return self._commit(base, {"submissions": self.store.rewrite(base, "submissions", touched, change)}, promote=values)

    # --- pricing

    def save_final(self, grid: DataFrame, as_of: str | Column | None = None) -> Outcome:
        base = self.latest()
        top = self._top(base, "final_quotes")
        change = lambda part: mutations.save_final(part, grid, as_of, top)
        return self._commit(base, {"final_quotes": self.store.rewrite(base, "final_quotes", [(grid, ["quote_id"])], change)})
