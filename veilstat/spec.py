"""Column roles of a record table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from veilstat import lexicons as lx


@dataclass(frozen=True)
class QISpec:
    """Identifiers, and every other column as a quasi-identifier, in table order."""

    identifiers: tuple[str, ...]
    qis: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame, identifiers: Iterable[str] = lx.IDENTIFIERS) -> QISpec:
        ids = set(identifiers)
        return QISpec(
            tuple(c for c in identifiers if c in df.columns),
            tuple(c for c in df.columns if c not in ids),
        )

    def keep(self, df: DataFrame, qis: Sequence[str]) -> DataFrame:
        """Identifiers, then the given quasi-identifiers."""
        return df.select(*[quoted(c) for c in (*self.identifiers, *qis)])


def quoted(name: str) -> str:
    """A column name that Spark reads as one name, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def find_role(columns: Sequence[str], aliases: Sequence[str], loose: bool = False) -> str | None:
    """The column of the first alias which is present, ignoring case.

    Of columns equal but for case the last one counts. ``loose`` also ignores
    the difference between spaces, underscores and dashes.
    """

    def norm(name: str) -> str:
        low = name.lower()
        return low.replace("_", " ").replace("-", " ") if loose else low

    by_name = {norm(c): c for c in columns}
    return next((by_name[norm(a)] for a in aliases if norm(a) in by_name), None)


def counter_columns(columns: Sequence[str]) -> list[str]:
    """Columns whose name holds one of the counter name parts."""
    return [c for c in columns if any(part in c.lower() for part in lx.COUNTER_NAME_PARTS)]
