"""Query registry: name -> Spark builder `(spark, sf_dir) -> DataFrame` and, where the result
is expressible in SQL, the DuckDB oracle text over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query builder; `oracle` is the equivalent SQL (None = rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    from . import catalog, catalog_checks, catalog_models, catalog_states  # noqa: F401  (they register everything)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog, catalog_checks, catalog_models, catalog_states  # noqa: F401
    return dict(_ORACLE)


# A value that is a tie in exact arithmetic reaches the two engines a few ulps apart; the
# tolerance (in units of the last kept digit) sends both copies of such a tie up. It is far
# above that float noise (~1e-5 units at 8 significant digits, even for variances, whose
# algorithms differ between engines), and it is irrational (√2·1e-4), so the shifted
# boundary 0.5 − tol never coincides with a decimal or small-denominator grid value.
TIE_TOLERANCE = 1.4142135623730951e-4


# Compared doubles keep this many significant digits. Sums of many values carry float noise
# proportional to their magnitude (and to the merge order of partial sums, which varies),
# so the granularity must scale with the value; fixed decimals fail on large totals.
COMPARE_SIG = 8


def rnd(c, digits: int | None = None):
    """Rounding of compared doubles: `COMPARE_SIG` significant digits, half-up on the binary
    value. Written the same way in the oracle SQL (`rnd_sql`), so both engines round a given
    double identically (the built-in `round` functions disagree on ties). `digits` is
    accepted for call-site readability and ignored."""
    return rnd_sig(c, COMPARE_SIG)


def rnd_sql(expr: str, digits: int | None = None) -> str:
    return rnd_sig_sql(expr, COMPARE_SIG)


def rnd_sig(c, sig: int = 6):
    """Round to `sig` significant digits, half-up with the tie tolerance.

    Only exact powers of ten are used (10^k for k ≥ 0): values needing a negative exponent
    are divided by 10^k and multiplied back, so Java and C `pow` cannot differ by an ulp.
    """
    k = F.lit(sig - 1) - F.floor(F.log10(F.abs(c)))
    up = F.pow(F.lit(10.0), k)
    down = F.pow(F.lit(10.0), -k)
    half = F.lit(0.5 + TIE_TOLERANCE)
    r = F.when(k >= 0, F.floor(c * up + half) / up).otherwise(F.floor(c / down + half) * down)
    return F.when(c == 0, c).otherwise(r)


def rnd_sig_sql(expr: str, sig: int = 6) -> str:
    k = f"({sig - 1} - floor(log10(abs({expr}))))"
    half = repr(0.5 + TIE_TOLERANCE)
    return (f"(CASE WHEN ({expr}) = 0 THEN ({expr}) "
            f"WHEN {k} >= 0 THEN floor(({expr}) * pow(10.0, {k}) + {half}) / pow(10.0, {k}) "
            f"ELSE floor(({expr}) / pow(10.0, -{k}) + {half}) * pow(10.0, -{k}) END)")


def rounded(df: DataFrame, digits: int = 2, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (hash-compared outputs), per-column digits via `overrides`."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(rnd(F.col(f"`{f.name}`"), overrides.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
