"""The five tables that travel together."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    quotes: DataFrame
    submissions: DataFrame
    assignments: DataFrame
    users: DataFrame
    final_quotes: DataFrame

    def updated(self, **tables: DataFrame) -> "Tables":
        return replace(self, **tables)
