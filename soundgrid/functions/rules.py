"""Rule tables: named conditions to an array of violated names, in rule order."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def violations(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that do not hold; an unknown condition counts as violated."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def in_range(x: Column, lo: float, hi: float) -> Column:
    return (~F.isnan(x)) & (x >= lo) & (x <= hi)


def permutation_of(values: Column, expected: list[str]) -> Column:
    """Empty, or exactly the expected names in any order."""
    want = F.array(*[F.lit(v) for v in sorted(expected)])
    return (F.size(values) == 0) | (F.array_sort(values) == want)
