"""Order-dependent operators that do not need a whole group in one task.

The order column is an integer that is unique inside a group (a line number, a
turn, a position).  A group is cut into blocks of at most ``width`` consecutive
ordinals.  Window functions run inside (group, block); what earlier blocks carry
over is one summary row per block.  So a group holding a third of a table is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WIDTH = 65_536
_BLOCK = "_block"


def block_of(ordinal: Column | str, width: int = BLOCK_WIDTH) -> Column:
    """Block number; a block holds at most ``width`` distinct integer ordinals."""
    column = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(column / F.lit(width)).cast("bigint")


def last_before(
    df: DataFrame, keys: Sequence[str], ordinal: str, values: Sequence[str], out: str,
    when: Column | None = None, width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Struct ``out`` of ``values`` from the closest earlier row where ``when`` holds."""
    keys = list(keys)
    condition = F.lit(True) if when is None else when
    picked = F.when(condition, F.struct(*values))
    blocked = df.withColumn(_BLOCK, block_of(ordinal, width))
    inside = (
        Window.partitionBy(*keys, _BLOCK).orderBy(ordinal)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocked.withColumn("_local", F.last(picked, ignorenulls=True).over(inside))
    summary = blocked.groupBy(*keys, _BLOCK).agg(
        F.max_by(picked, F.when(condition, F.col(ordinal))).alias("_picked")
    )
    across = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        summary.withColumn("_carry", F.last("_picked", ignorenulls=True).over(across))
        .where(F.col("_carry").isNotNull()).drop("_picked")
    )
    return (
        local.join(carry, [*keys, _BLOCK], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry", _BLOCK)
    )


def next_after(
    df: DataFrame, keys: Sequence[str], ordinal: str, values: Sequence[str], out: str,
    when: Column | None = None, width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Mirror image of :func:`last_before`."""
    flipped = df.withColumn("_flip", -F.col(ordinal).cast("bigint"))
    return last_before(flipped, keys, "_flip", values, out, when, width).drop("_flip")


def position(
    df: DataFrame, keys: Sequence[str], ordinal: str, out: str, width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Dense 0-based position of a row inside its group, in ordinal order."""
    return running_total(df, keys, ordinal, F.lit(1), out, width)


def running_total(
    df: DataFrame, keys: Sequence[str], ordinal: str, amount: Column | str, out: str,
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Sum of ``amount`` over all earlier rows of the group (exclusive prefix sum)."""
    keys = list(keys)
    amount = F.col(amount) if isinstance(amount, str) else amount
    blocked = df.withColumn(_BLOCK, block_of(ordinal, width))
    inside = (
        Window.partitionBy(*keys, _BLOCK).orderBy(ordinal)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocked.groupBy(*keys, _BLOCK).agg(F.sum(amount.cast("bigint")).alias("_sum"))
        .withColumn("_carry", F.sum("_sum").over(across))
        .where(F.col("_carry").isNotNull()).drop("_sum")
    )
    return (
        blocked.withColumn("_local", F.sum(amount.cast("bigint")).over(inside))
        .join(carry, [*keys, _BLOCK], "left")
        .withColumn(out, F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        .drop("_local", "_carry", _BLOCK)
    )


def first_of_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
) -> DataFrame:
    """Keep the first row of each group in ``order``; aggregates, so hot groups shrink map-side."""
    best = F.min(F.struct(*order, *[c for c in payload if c not in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def last_of_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
) -> DataFrame:
    """Keep the last row of each group in ``order``."""
    best = F.max(F.struct(*order, *[c for c in payload if c not in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])
