"""Portable random numbers: a hash of seed, salt and row id, the same in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, salt: str, row: Column | str) -> Column:
    """In [0, 1), from 52 bits of md5."""
    row = F.col(row) if isinstance(row, str) else row
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(salt), row.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed: int, salt: str, row: str) -> str:
    """The same for DuckDB."""
    return f"(('0x' || substr(md5('{seed}-{salt}-' || ({row})::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)"


def normal(seed: int, salt: str, row: Column | str) -> Column:
    """Standard normal, by the Box-Muller transform."""
    a, b = uniform(seed, f"{salt}a", row), uniform(seed, f"{salt}b", row)
    return F.sqrt(-2 * F.log(F.greatest(a, F.lit(1e-300)))) * F.cos(2 * F.lit(3.141592653589793) * b)
