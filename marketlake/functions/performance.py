"""Change and performance arithmetic. A zero or missing base gives null, never an error.

Arguments are column names or SQL expressions: wide tables build many of these columns, and one
SQL string per column keeps the building of the plan short.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change(price: str, base: str) -> Column:
    return F.expr(f"round({price} - {base}, 4)")


def change_pct(price: str, base: str) -> Column:
    """Percent from the unrounded change."""
    return F.expr(f"round(try_divide({price} - {base}, {base}) * 100, 4)")


def first_nonzero(*columns: str) -> Column:
    """First value that is neither null nor zero, else the last one as it is."""
    *head, last = columns
    tries = ", ".join(f"nullif({c}, 0D)" for c in head)
    return F.expr(f"coalesce({tries}, {last})")
