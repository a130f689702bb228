"""Ordered scans that stay parallel when one key holds a large share of all rows.

A window ``PARTITION BY key ORDER BY t`` puts a whole key in one task.  Here a hot key is first cut
along ``t`` into chunks; the window then runs per (key, chunk), and what earlier chunks contribute is
carried over from one small row per (hot key, chunk).  The carried value is exact because every scan
in this library is a running max or min, which is associative.

Where the cuts lie never changes a result, only how evenly the work spreads.  Keys that are not hot
have a null chunk and take part in none of the extra steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of one key that one task should sort.
ROWS_PER_CHUNK = 4_000_000

#: Keys whose side of a join by key is sent to their rows.
FEW_KEYS = 10_000

CHUNK = "chunk"


@dataclass(frozen=True)
class Splits:
    """Cut points of the hot keys; ``cuts`` is None when no key is hot."""

    keys: tuple[str, ...]
    cuts: DataFrame | None = None
    #: Most cuts of one key.
    most: int = 0

    def assign(self, df: DataFrame, order: str = "t") -> DataFrame:
        """Add ``chunk``: how many cuts of the row's key are at or before ``order``."""
        if self.cuts is None or CHUNK in df.columns:
            return df
        columns = df.columns
        number = _count_up_to(F.col("cuts"), F.col(order), self.most)
        # One row per hot key and one number per ROWS_PER_CHUNK rows, collected and counted by
        # find_splits: the broadcast is bounded by (rows in the table) / (rows per chunk).
        return df.join(F.broadcast(self.cuts), list(self.keys), "left").select(
            *columns, F.when(F.col("cuts").isNotNull(), number).alias(CHUNK)
        )


def _count_up_to(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``cuts`` are at or below ``value``: halving steps, not one per cut."""
    steps = [1 << b for b in reversed(range(max(most, 1).bit_length()))]

    def further(found: Column, step: Column) -> Column:
        cut = F.get(cuts, (found + step - 1).cast("int"))
        return found + F.when(cut <= value, step).otherwise(0)

    counted = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
    return F.when(cuts.isNotNull(), counted)


def find_splits(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "t",
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
) -> Splits:
    """Find keys with more than ``rows_per_chunk`` rows and where to cut them.

    Runs one aggregation (map-side combined) and, only when some key is hot, one quantile pass over
    the hot rows.  At most (rows / rows_per_chunk) keys come back to the driver.  Equal ``order``
    values always fall in the same chunk.
    """
    keys = tuple(keys)
    if rows_per_chunk is None or CHUNK in df.columns:
        return Splits(keys)
    # Counting needs no shuffle and, on a stored table, only file footers.
    if df.count() <= rows_per_chunk:
        return Splits(keys)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_chunk)
    most = hot.agg(F.max("n")).first()[0]
    if most is None:
        return Splits(keys)
    # Cuts for the largest key; a smaller one takes every so many of them.
    pieces = -(-most // rows_per_chunk)
    steps = [i / pieces for i in range(1, pieces)]
    grid = (
        df.select(*keys, order)
        .join(F.broadcast(hot), list(keys))
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.percentile_approx(order, steps, max(4 * pieces, 10_000)).alias("grid"),
        )
    )
    every = F.greatest(F.floor(F.lit(pieces) * rows_per_chunk / F.col("n")), F.lit(1))
    found = grid.select(
        *keys,
        F.array_distinct(F.filter("grid", lambda _, i: i % every == every - 1)).alias("cuts"),
    )
    rows = found.collect()
    cuts = df.sparkSession.createDataFrame(rows, found.schema)
    return Splits(keys, cuts, max(len(r["cuts"]) for r in rows))


def spread(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "t",
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """``df`` with a ``chunk`` column when some key is hot, unchanged otherwise."""
    return find_splits(df, keys, order, rows_per_chunk).assign(df, order)


_REDUCE = {"max": F.max, "min": F.min}
_COMBINE = {"max": F.greatest, "min": F.least}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``max``/``min`` of expressions per key, split by ``chunk`` where that column exists.

    ``values`` maps an output column to ``("max" | "min", expression)``.  ``inclusive`` reads rows up
    to the current one and its ties in ``order``; otherwise rows strictly before it.
    """
    chunked = CHUNK in df.columns
    part = [*keys, CHUNK] if chunked else list(keys)
    over = Window.partitionBy(*part).orderBy(*order)
    if not inclusive:
        over = over.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({name: _REDUCE[how](e).over(over) for name, (how, e) in values.items()})
    if not chunked:
        return out
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (hot key, chunk).
    carried = (
        df.where(F.col(CHUNK).isNotNull())
        .groupBy(*part)
        .agg(*[_REDUCE[how](e).alias(name) for name, (how, e) in values.items()])
        .select(
            *part,
            *[
                _REDUCE[how](name).over(earlier).alias(f"carried_{name}")
                for name, (how, _) in values.items()
            ],
        )
    )
    columns = out.columns
    joined = out.join(carried, part, "left")
    merged = {
        name: _COMBINE[how](F.col(name), F.col(f"carried_{name}"))
        for name, (how, _) in values.items()
    }
    return joined.withColumns(merged).select(*columns)


def join_by_size(
    rows: DataFrame,
    sides: DataFrame,
    keys: Sequence[str],
    size: str,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    few: int = FEW_KEYS,
) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where ``sides`` (a stored table) knows each key's row count.

    The largest keys, fewer than ``few``, and keys with more than ``rows_per_chunk`` rows, which are few by that very
    count, have their side broadcast and their rows never shuffle; all other keys take an ordinary shuffle join, in which
    none has more than one row in ``few``.
    """
    keys = list(keys)
    largest = sides.select(size).orderBy(F.desc(size)).limit(few)
    known, least = largest.agg(F.count(F.lit(1)), F.min(size)).first()
    if known < few:
        return rows.join(F.broadcast(sides), keys)
    bar = min(least, rows_per_chunk)
    hot = sides.where(F.col(size) > bar)
    cold = sides.where(F.col(size) <= bar)
    of_hot = rows.join(F.broadcast(hot), keys)
    of_cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return of_hot.unionByName(of_cold)
