"""Registry of named queries over the driver tables.

Each query is a callable ``(spark, sf_dir) -> DataFrame``; most also carry an
equivalent DuckDB SQL text (tables pre-registered as views) used as the
correctness oracle.  Queries without SQL are iterative / library algorithms
checked by properties in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = expand_round(sql)
        return fn

    return deco


# Fraction of a rounding step added before rounding (both engines).  Averages
# of 2-decimal prices over 8, 32, ... rows end exactly on a tie (...5), and
# the last-bit summation differences between engines would otherwise decide
# the direction.
NUDGE = 1e-3


def round_sql(expr: str, digits: int) -> str:
    m = f"{float(10 ** digits)!r}"
    return f"(sign({expr}) * floor(abs({expr}) * {m} + 0.5 + {NUDGE!r}) / {m})"


def expand_round(sql: str) -> str:
    """Rewrite every ``round(x, d)`` of an oracle SQL text into the same
    tie-safe rounding that ``r6`` applies on the Spark side."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        if comma < 0:  # one-argument round(x): left as it is
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        inner = expand_round(sql[j + 6 : comma])
        digits = int(sql[comma + 1 : k].strip())
        out.append(sql[i:j] + round_sql(inner, digits))
        i = k + 1


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round for comparison against the oracle, with the oracle's rule:
    round-half-away-from-zero of the *binary* value x * 10^d (Spark's own
    ``round`` rounds the shortest decimal text, which differs on exact ties
    such as averages ending in ...5)."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    m = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * m + 0.5 + NUDGE).cast("double") / m


def r4(c: str | Column) -> Column:
    """Round price-level values (magnitudes up to ~1e6) to 4 decimals."""
    return r6(c, 4)


def load_all() -> None:
    """Import every query module so that the registry is filled."""
    from . import (  # noqa: F401
        q_cluster,
        q_eval,
        q_features,
        q_files,
        q_panel,
        q_report,
    )
