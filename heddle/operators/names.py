"""Names for an operator's own columns that no input column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(names: list[str], *tables: DataFrame) -> list[str]:
    """The names, each with as many leading underscores as the tables' columns make necessary."""
    taken = {c.lower() for t in tables for c in t.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
