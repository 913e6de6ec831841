"""Versions of several tables that change together.

Data files are written once and never changed. A manifest lists the files of every table of one version, with row
counts, the range of the key by which the table is clustered, and the highest numbers given out. It is published
last and whole, under the next version's number: a reader opens one manifest and sees one state of all tables,
whatever writers do, and of two writers that start from one version the second is refused. Files written by a change
that failed or was refused are listed nowhere.

A change rewrites only files that hold a key it touches (``rewrite``); the others are carried on by name. A manifest
takes a line for each file, so its size, which passes through the driver, follows the number of files (128 MB and
more each at scale) and not that of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import keep_keys
from ..schemas import SEQ
from .files import list_names, publish_text, read_text
from .tables import empty_table

#: Up to so many touched keys are compared with the key ranges of files on the driver.
FEW_KEYS = 1000
BEFORE = "_before"


class Conflict(RuntimeError):
    """Another change was made since the version that this one started from."""


@dataclass(frozen=True)
class Layout:
    """A table's schema, the column it is clustered by, and numbers of which the highest is kept at hand."""

    schema: T.StructType
    key: str
    highest: dict[str, Callable[[], Column]] = field(default_factory=dict)


@dataclass(frozen=True)
class File:
    path: str
    rows: int
    low: str | None
    high: str | None
    highest: dict[str, int | None]

    def __hash__(self) -> int:
        return hash(self.path)


@dataclass(frozen=True)
class Snapshot:
    """One version; ``notes`` are numbers that a change left with it, such as how far a log has been applied."""

    number: int
    files: dict[str, tuple[File, ...]]
    notes: dict[str, int] = field(default_factory=dict)

    def rows(self, name: str) -> int:
        return sum(f.rows for f in self.files.get(name, ()))

    def highest(self, name: str, label: str, default: int) -> int:
        known = [f.highest[label] for f in self.files.get(name, ()) if f.highest.get(label) is not None]
        return max(known, default=default)


@dataclass(frozen=True)
class Rewrite:
    """The files of a table after a change, those that it replaced and wrote, and how many rows it affected."""

    files: tuple[File, ...]
    replaced: tuple[File, ...]
    written: tuple[File, ...]
    updated: int
    inserted: int
    deleted: int


class Store:
    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout]) -> None:
        self.spark, self.root, self.layouts = spark, root.rstrip("/"), layouts

    # --- versions

    def latest(self) -> Snapshot | None:
        numbers = [int(name.removesuffix(".json")) for name in list_names(self.spark, f"{self.root}/manifests")]
        return self.at(max(numbers)) if numbers else None

    def at(self, number: int) -> Snapshot:
        text = json.loads(read_text(self.spark, self._manifest(number)))
        return Snapshot(number, {name: tuple(File(**f) for f in files) for name, files in text["files"].items()}, text["notes"])

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifests/{number:012d}.json"

    def commit(
        self, base: Snapshot | None, changed: dict[str, tuple[File, ...]], notes: dict[str, int] | None = None,
    ) -> Snapshot:
        """Make the changed tables and notes, and the others as in ``base``, the next version; ``Conflict`` if there is
        one already."""
        number = base.number + 1 if base else 0
        files = {**(base.files if base else {}), **changed}
        notes = {**(base.notes if base else {}), **(notes or {})}
        text = json.dumps({"files": {name: [asdict(f) for f in some] for name, some in files.items()}, "notes": notes})
        try:
            publish_text(self.spark, self._manifest(number), text)
        except FileExistsError as e:
            raise Conflict(f"version {number} exists") from e
        return Snapshot(number, files, notes)

    # --- data

    def read(self, snapshot: Snapshot, name: str) -> DataFrame:
        return self.read_files(name, snapshot.files.get(name, ()))

    def read_files(self, name: str, files: tuple[File, ...]) -> DataFrame:
        schema = self.layouts[name].schema
        if not files:
            return empty_table(self.spark, schema)
        return self.spark.read.schema(schema).parquet(*[f.path for f in files])

    def write(self, name: str, df: DataFrame, observe: tuple[Observation, list[Column]] | None = None) -> tuple[File, ...]:
        """New data files, clustered by the table's key and sorted; a part of no version until they are committed."""
        layout = self.layouts[name]
        folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        order = [layout.key, *([SEQ] if SEQ in layout.schema.names else [])]
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
        if observe:  # behind the shuffle: placing rows by range reads them once more to take samples
            placed = placed.observe(observe[0], *observe[1])
        placed.select(*layout.schema.names).write.parquet(folder)
        highest = [F.max(of()).cast("bigint").alias(f"highest_{label}") for label, of in layout.highest.items()]
        found = self.spark.read.schema(layout.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(layout.key).cast("string").alias("low"),
            F.max(layout.key).cast("string").alias("high"), *highest)
        # one row for each file
        return tuple(
            File(r["path"], r["rows"], r["low"], r["high"], {label: r[f"highest_{label}"] for label in layout.highest})
            for r in found.orderBy("path").collect())

    def touched(self, snapshot: Snapshot, name: str, keys_of: DataFrame, keys: list[str]) -> tuple[File, ...]:
        """Files that hold a row with one of the keys. Only key columns are read, and of few keys only files in range."""
        files, key = snapshot.files.get(name, ()), self.layouts[name].key
        if key in keys:
            few = [r[0] for r in keys_of.select(F.col(key).cast("string")).distinct().limit(FEW_KEYS + 1).collect()]
            if len(few) <= FEW_KEYS:
                files = tuple(f for f in files if f.low is not None and any(k is not None and f.low <= k <= f.high for k in few))
        if not files:
            return ()
        rows = self.read_files(name, files).select(*keys, F.col("_metadata.file_path").alias("_file"))
        hit = {r["_file"] for r in keep_keys(rows, keys_of, keys).select("_file").distinct().collect()}  # one row for each file
        return tuple(f for f in files if f.path in hit)

    def rewrite(
        self, snapshot: Snapshot, name: str, touched: list[tuple[DataFrame, list[str]]], change: Callable[[DataFrame], DataFrame],
    ) -> Rewrite:
        """Apply ``change`` to the files that hold a row with one of the keys in ``touched``, and write only those anew.

        ``change`` gets the rows of these files and returns their new content and any rows to add. It must leave rows
        with other keys alone, and hand on the column ``BEFORE``, which is null in added rows: it holds a hash of the
        row as it was (64 bits instead of a second row in every shuffle), and tells how many rows were updated,
        inserted and deleted while the new files are written.
        """
        replaced = tuple(dict.fromkeys(f for keys_of, keys in touched for f in self.touched(snapshot, name, keys_of, keys)))
        names = self.layouts[name].schema.names
        part = self.read_files(name, replaced)
        after = change(part.withColumn(BEFORE, _row_hash(names)))
        old, same = F.col(BEFORE).isNotNull(), _row_hash(names) == F.col(BEFORE)
        counts = Observation()
        marks = [F.count_if(old).alias("kept"), F.count_if(old & ~same).alias("updated"), F.count_if(~old).alias("inserted")]
        written = self.write(name, after, (counts, marks))
        seen = counts.get
        carried = tuple(f for f in snapshot.files.get(name, ()) if f not in replaced)
        return Rewrite(
            carried + written, replaced, written, seen["updated"], seen["inserted"],
            sum(f.rows for f in replaced) - seen["kept"])


def _row_hash(names: list[str]) -> Column:
    """Hash of a row; a null counts by its place, which ``xxhash64`` alone passes over."""
    return F.xxhash64(*[c for n in names for c in (F.col(n), F.col(n).isNull())])


def unchanged(snapshot: Snapshot, name: str) -> Rewrite:
    return Rewrite(snapshot.files.get(name, ()), (), (), 0, 0, 0)

