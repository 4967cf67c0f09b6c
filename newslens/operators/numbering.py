"""Exact row numbers and running sums for groups of any size, over keys of any distribution.

A window over one hot group would sort that group in a single task. Here the order is cut into slices at quantiles of its keys; slices are counted
first (partial aggregation, a few bytes per slice), the counts become offsets, and each slice is then numbered by itself. The cut points are those
of all rows together, so that no slice holds much more than its share of all rows, in whatever group; dense, sparse, hashed and clustered keys are
alike. A key value that is a cut point itself, as one that many rows share, has a slice of its own, which the next key of the order cuts further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.functions.text import epoch_us

#: Rows that a slice may hold before the order is cut, and slices at most, so that a group's slices stay few; each is then larger, and sorted with spill.
SLICE_ROWS = 1 << 16
MOST_SLICES = 4096

#: Columns of an order, each with True for ascending.
Keys = list[tuple[str, bool]]


def _measured(df: DataFrame, column: str) -> Column:
    """A column as a number in the same order, if it is a date or a time."""
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return epoch_us(F.col(column))
    return F.unix_date(column) if kind == "date" else F.col(column)


def cut_points(df: DataFrame, columns: list[str], rows: int = SLICE_ROWS, most: int = MOST_SLICES) -> dict[str, list]:
    """Ascending cut points of each column: approximate quantiles, without repeats. Any points give right results, so their error does not matter.

    One aggregation counts, and only if there are more rows than a slice may hold, a second one reads the quantiles.
    """
    n = df.agg(F.count("*")).first()[0]
    slices = min(most, -(-n // rows))
    if slices <= 1:
        return {c: [] for c in columns}
    points = [i / slices for i in range(1, slices)]
    found = df.agg(*[F.percentile_approx(_measured(df, c), points, 20 * slices).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def reached(column: Column, cuts: list) -> Column:
    """Number of cut points up to a value, by binary search over the constant array; null for null."""
    if not cuts:
        return F.when(column.isNotNull(), F.lit(0))
    held = F.array(*map(F.lit, cuts)) if len(cuts) == 1 else F.lit(cuts)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    last = F.lit(len(cuts))

    def step(at: Column, size: Column) -> Column:
        return at + F.when((at + size <= last) & (F.get(held, at + size - 1) <= column), size).otherwise(0)

    return F.when(column.isNotNull(), F.aggregate(steps, F.lit(0), step))


def _slices(df: DataFrame, keys: Keys, rows: int) -> list[tuple[Column, bool]]:
    """Coarse steps of the order `keys`, consistent with it."""
    cuts = cut_points(df, [c for c, _ in keys], rows)
    out, pure = [], F.lit(True)
    for name, up in keys:
        column = _measured(df, name)
        place = reached(column, cuts[name])
        # Values between two cut points come after the lower one, which has a slice of its own.
        at_cut = (place > 0) & (F.get(F.lit(cuts[name]), place - 1) == column) if cuts[name] else F.lit(False)
        step = 2 * place + F.when(at_cut, 0).otherwise(1)
        out.append((F.when(pure, step), up))
        pure = F.coalesce(pure & at_cut, F.lit(False))
        if not cuts[name]:
            break
    return out


def _order(keys: Keys) -> list[Column]:
    return [F.asc(c) if up else F.desc(c) for c, up in keys]


def _sliced(df: DataFrame, group: list[str], keys: Keys, rows: int, total: Column) -> tuple[DataFrame, DataFrame, list[str], Column]:
    slices = _slices(df, keys, rows)
    names = [f"_slice{i}" for i in range(len(slices))]
    keyed = df.withColumns({n: expr for n, (expr, _) in zip(names, slices)})
    order = [F.asc(n) if up else F.desc(n) for n, (_, up) in zip(names, slices)]
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*group, *names).agg(total.alias("_total"))
        .withColumn("_offset", F.sum("_total").over(before))
        .select(*[F.col(c).alias(f"_of_{c}") for c in group + names], "_offset")
    )
    same = F.lit(True)
    for c in group + names:  # null groups and keys are groups and keys like others
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return keyed, offsets, names, same


def sliced_row_number(
    df: DataFrame, group: list[str], keys: Keys, out: str = "n", limit: int | None = None, rows: int = SLICE_ROWS
) -> DataFrame:
    """1-based position in the group, in the order of `keys`, which should not leave ties.

    With a `limit`, only positions up to it are kept; slices that start beyond it are dropped before the sort.
    """
    keyed, offsets, names, same = _sliced(df, group, keys, rows, F.count("*"))
    offsets = offsets.withColumn("_offset", F.coalesce("_offset", F.lit(0)))
    if limit is not None:
        offsets = offsets.where(F.col("_offset") < limit)
    within = Window.partitionBy(*group, *names).orderBy(*_order(keys))
    numbered = (
        keyed.join(offsets, same)
        .withColumn(out, F.col("_offset") + F.row_number().over(within))
        .drop("_offset", *names, *[f"_of_{c}" for c in group + names])
    )
    return numbered if limit is None else numbered.where(F.col(out) <= limit)


def sliced_running_sum(
    df: DataFrame, group: list[str], keys: Keys, value: Column, out: str, inclusive: bool = True, rows: int = SLICE_ROWS
) -> DataFrame:
    """Running sum of `value` in the group's order, with or without the current row."""
    keyed, offsets, names, same = _sliced(df.withColumn("_value", value), group, keys, rows, F.sum("_value"))
    within = Window.partitionBy(*group, *names).orderBy(*_order(keys))
    frame = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0)
    return (
        keyed.join(offsets, same)
        .withColumn(out, F.coalesce("_offset", zero) + F.coalesce(F.sum("_value").over(frame), zero))
        .drop("_value", "_offset", *names, *[f"_of_{c}" for c in group + names])
    )
