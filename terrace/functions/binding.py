"""Naming a computed value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of the values, each computed once for a row.

    A value used inside the lambda of a higher-order function would be computed again for every element; as the variable
    of a one-element transform it is not.
    """
    names = [f"v{i}" for i in range(len(values))]
    held = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return F.get(F.transform(held, lambda s: body(*[s[n] for n in names])), F.lit(0))
