"""A bounded sample of a table's rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 31


def bounded(rows: DataFrame, columns: list[str], most: int, salt: int = 0) -> DataFrame:
    """At most ``most`` rows of ``rows``: those with the least hash of ``columns``, ties by their values.

    Rows are thinned by the hash before they are ordered, so that about twice ``most`` leave the tasks, however many
    partitions there are.
    """
    total = rows.count()
    place = F.xxhash64(*columns, F.lit(salt))
    if total > 2 * most:
        rows = rows.where(F.pmod(place, F.lit(_RANGE)) < int(_RANGE * min(1.0, (2 * most + 64) / total)))
    return rows.orderBy(place, *columns).limit(most)
