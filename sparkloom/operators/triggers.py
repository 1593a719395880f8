"""What follows from a change of a table: hooks that are told the rows that came, changed and went with a new version."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Change:
    """``created`` and ``changed`` have the new rows, ``deleted`` the old ones."""

    created: DataFrame
    changed: DataFrame
    deleted: DataFrame

    def is_empty(self) -> bool:
        return self.created.isEmpty() and self.changed.isEmpty() and self.deleted.isEmpty()


def change(before: DataFrame | None, after: DataFrame, key: list[str]) -> Change:
    """The rows by which two versions differ, told by ``key``, which is unique in both. Rows that are equal in all columns are no change."""
    before = after.limit(0) if before is None else before
    fresh = after.exceptAll(before.select(*after.columns))
    return Change(fresh.join(before.select(*key), key, "left_anti"), fresh.join(before.select(*key), key, "left_semi"), before.join(after.select(*key), key, "left_anti"))


class Triggers:
    """Hooks by table. They run once a publication, after it, in the order in which they were added."""

    def __init__(self) -> None:
        self.keys: dict[str, list[str]] = {}
        self.hooks: dict[str, list[Callable[[Change], None]]] = defaultdict(list)

    def add(self, table: str, key: list[str], hook: Callable[[Change], None]) -> None:
        self.keys[table] = key
        self.hooks[table].append(hook)

    def fire(self, before: dict[str, DataFrame | None], after: dict[str, DataFrame]) -> None:
        for table, hooks in self.hooks.items():
            if table in after:
                found = change(before.get(table), after[table], self.keys[table])
                if not found.is_empty():
                    for hook in hooks:
                        hook(found)


def owned_files(change: Change, column: str) -> DataFrame:
    """The files of deleted rows, each of which owns its file outright."""
    return change.deleted.select(F.col(column).alias("path")).filter("path IS NOT NULL AND path <> ''").distinct()
