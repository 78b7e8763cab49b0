"""Order-dependent building blocks that never gather one key in one task.

A key may hold a large share of all rows. Each helper cuts a key into blocks by its integer position,
works inside blocks of at most ``2 ** BLOCK_BITS`` rows, and carries a few numbers per block forward.
Positions are INT, so a key has at most 2**19 blocks: that is the proven bound of the block tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.session import cut_lineage

BLOCK_BITS = 12
BLOCK_ROWS = 1 << BLOCK_BITS


PIECE = 64


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], piece: int = PIECE) -> Column:
    """BIGINT values before each of ``items`` (one at least) and after the last one, from ``start`` on.

    Items are taken piece by piece, so no step copies more than a piece: appending to one array at every item would
    copy all that is there.
    """
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / F.lit(piece)).cast("int")), lambda p: F.slice(items, p * piece + 1, F.lit(piece))
    )

    def through(done: Column, taken: Column) -> Column:
        inner = F.aggregate(taken, F.array(done["at"]), lambda trail, item: F.array_append(trail, step(F.element_at(trail, -1), item)))
        after = lambda trail: F.struct(
            F.element_at(trail, -1).alias("at"), F.array_append(done["trails"], F.slice(trail, F.lit(1), F.size(taken))).alias("trails")
        )
        return F.transform(F.array(inner), after)[0]

    begin = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("trails"))
    return F.aggregate(pieces, begin, through, lambda done: F.concat(F.flatten(done["trails"]), F.array(done["at"])))


def block_of(position: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(position, bits)


def in_first_block(held: DataFrame, position: Column, bits: int = BLOCK_BITS) -> bool:
    """Whether all positions lie in block 0, so that nothing is carried between blocks. ``held`` is stored and read once."""
    return held.filter(block_of(position, bits) != 0).isEmpty()


def explode_range(df: DataFrame, start: Column, end: Column, out: str, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per number from ``start`` to ``end``, block by block, so no array is longer than a block.

    Ranges with a null end or with ``start > end`` give no row.
    """
    blocks = F.when(start <= end, F.sequence(block_of(start, bits), block_of(end, bits)))
    spread = df.withColumns({"_start": start, "_end": end, "_block": F.explode(blocks)})
    low = F.greatest(F.col("_start"), F.shiftleft(F.col("_block"), bits))
    high = F.least(F.col("_end"), F.shiftleft(F.col("_block"), bits) + (1 << bits) - 1)
    return spread.withColumn(out, F.explode(F.sequence(low, high))).drop("_start", "_end", "_block")


def with_neighbours(
    df: DataFrame,
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    doc: str = "doc_id",
    page: str = "page_number",
    bits: int = BLOCK_BITS,
    keep_block: bool = False,
    held: bool = False,
) -> DataFrame:
    """Add ``prev_*`` and ``next_*`` columns of the pages before and after, by order, in the same document.

    Neighbours inside a block come from a window; a block's first and last page meet the nearest block that has
    pages, so gaps between page numbers change nothing, whatever the block size. Without later blocks the window is
    all. ``held`` says that ``df`` is stored and may be read more than once.
    """
    if not held:
        df = cut_lineage(df)
    window = Window.partitionBy(doc, "block").orderBy(page)
    placed = df.withColumn("block", block_of(F.col(page) - 1, bits))
    if in_first_block(df, F.col(page) - 1, bits):
        near = {f"prev_{name}": F.lag(name).over(window) for name in previous}
        near |= {f"next_{name}": F.lead(name).over(window) for name in following}
        met = placed.withColumns(near)
        return met if keep_block else met.drop("block")
    ends = placed.filter(F.col(page).isNotNull()).groupBy(doc, "block").agg(
        F.max_by(F.struct(F.lit(1).alias("there"), *previous), page).alias("tail"),
        F.min_by(F.struct(F.lit(1).alias("there"), *following), page).alias("head"),
    )
    blocks = Window.partitionBy(doc).orderBy("block")
    ends = ends.withColumns({"before": F.lag("tail").over(blocks), "after": F.lead("head").over(blocks)})
    ends = ends.filter(F.col("before").isNotNull() | F.col("after").isNotNull())
    ends = ends.select(F.col(doc).alias("_doc"), F.col("block").alias("_block"), "before", "after")
    first, last = F.lag(F.lit(1)).over(window).isNull(), F.lead(F.lit(1)).over(window).isNull()
    inside = placed.withColumns(
        {
            **{f"prev_{name}": F.lag(name).over(window) for name in previous},
            **{f"next_{name}": F.lead(name).over(window) for name in following},
            "_first": first,
            "_last": last,
        }
    )
    met = inside.join(ends, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("block") == F.col("_block")), "left")
    met = met.withColumns(
        {
            **{f"prev_{n}": F.when(F.col("_first"), F.col("before")[n]).otherwise(F.col(f"prev_{n}")) for n in previous},
            **{f"next_{n}": F.when(F.col("_last"), F.col("after")[n]).otherwise(F.col(f"next_{n}")) for n in following},
        }
    ).drop("_first", "_last", "_doc", "_block", "before", "after")
    return met if keep_block else met.drop("block")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: Column | None = None,
    short: bool = False,
) -> DataFrame:
    """Sum of ``value`` over the rows before the current one, per key, in the given order.

    ``block`` must not decrease along the order and must hold a bounded number of rows per key; by default
    it is cut from the first order column, an INT position. Only keys that reach past their first block
    get a base to add, so for ordinary keys this is one shuffle on (key, block). ``short`` says that no key
    reaches past it (``in_first_block``): then ``df`` is read once.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", block_of(F.col(order[0])) if block is None else block)
    blocked = blocked.withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    if short:
        return local.withColumn(out, F.col("_inside")).drop("_block", "_value", "_inside")

    carry = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_base", F.sum("_total").over(carry))
        .filter(F.col("_base").isNotNull())
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), "_base")
    )
    same = F.col("_block") == F.col("_k_block")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return (
        local.join(base, same, "left")
        .withColumn(out, F.col("_inside") + F.coalesce("_base", F.lit(0)))
        .drop("_block", "_value", "_inside", "_base", "_k_block", *[f"_k_{k}" for k in keys])
    )


def position_in_key(
    df: DataFrame, keys: Sequence[str], position: str, out: str, block: Column | None = None, short: bool = False
) -> DataFrame:
    """1-based row number per key in order of an INT ``position``."""
    ranked = running_total(df, keys, [position], F.lit(1), out, block, short)
    return ranked.withColumn(out, (F.col(out) + 1).cast("int"))
