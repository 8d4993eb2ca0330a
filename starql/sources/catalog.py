"""The catalog: how to read each table, and what is declared about it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import NameProblem

#: Rows assumed for a table of unknown size.
DEFAULT_ROWS = 10


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    to_table: str
    to_column: str


@dataclass
class Catalog:
    """Tables by name.  Readers are called when a query needs the table, never earlier; declared keys are trusted
    (``validate`` checks them on demand)."""

    spark: SparkSession
    readers: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    unique: set[tuple[str, str]] = field(default_factory=set)
    foreign_keys: set[ForeignKey] = field(default_factory=set)
    sorted_indexes: set[tuple[str, str]] = field(default_factory=set)
    rows: dict[str, int] = field(default_factory=dict)
    count_rows: Callable[[str], int] | None = None
    _schemas: dict[str, list[str]] = field(default_factory=dict)

    def add(self, name: str, source: DataFrame | Callable[[], DataFrame]) -> Catalog:
        self.readers[name] = (lambda df=source: df) if isinstance(source, DataFrame) else source
        self._schemas.pop(name, None)
        return self

    def add_parquet(self, name: str, path: str) -> Catalog:
        return self.add(name, lambda: self.spark.read.parquet(path))

    def table(self, name: str) -> DataFrame:
        if name not in self.readers:
            raise NameProblem(f"no such table: {name}")
        return self.readers[name]()

    def columns(self, name: str) -> list[str]:
        if name not in self._schemas:
            self._schemas[name] = self.table(name).columns
        return self._schemas[name]

    def size(self, name: str) -> int:
        """Rows for the cost model: declared or counted once, else the default."""
        if name not in self.rows and self.count_rows is not None and name in self.readers:
            self.rows[name] = self.count_rows(name)
        return self.rows.get(name, DEFAULT_ROWS)

    def is_unique(self, table: str, column: str) -> bool:
        return (table, column) in self.unique

    def has_foreign_key(self, table: str, column: str, to_table: str, to_column: str) -> bool:
        return ForeignKey(table, column, to_table, to_column) in self.foreign_keys

    def declare(self, lines: Iterable[str]) -> Catalog:
        """Lines ``unique t c`` and ``foreign_key t c t2 c2``; ``#`` starts a comment."""
        for words in _words(lines):
            if words[0] == "unique" and len(words) == 3:
                self.unique.add((words[1], words[2]))
            elif words[0] == "foreign_key" and len(words) == 5:
                self.foreign_keys.add(ForeignKey(*words[1:]))
            else:
                raise NameProblem(f"constraint not understood: {' '.join(words)}")
        return self

    def declare_indexes(self, lines: Iterable[str]) -> Catalog:
        """Lines ``table column sorted [file]``; other kinds of index are ignored."""
        for words in _words(lines):
            if len(words) >= 3 and words[2] == "sorted":
                self.sorted_indexes.add((words[0], words[1]))
        return self

    def validate(self) -> list[str]:
        """Declared keys that the data break."""
        from pyspark.sql import functions as F

        bad = []
        for t, c in sorted(self.unique):
            if self.table(t).where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").limit(1).count():
                bad.append(f"unique {t} {c}")
        for k in sorted(self.foreign_keys, key=str):
            left = self.table(k.table).select(F.col(k.column).alias("k")).where("k IS NOT NULL")
            if left.join(self.table(k.to_table).select(F.col(k.to_column).alias("k")), "k", "left_anti").limit(1).count():
                bad.append(f"foreign_key {k.table} {k.column} {k.to_table} {k.to_column}")
        return bad


def _words(lines: Iterable[str]) -> Iterable[list[str]]:
    for line in lines:
        words = line.split("#", 1)[0].split()
        if words:
            yield words
