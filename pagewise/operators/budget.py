"""Spending a per-key budget in order, where a request that does not fit is skipped.

Ordinary keys are folded as one sorted array of bounded length. A key with more requests than that is
solved by rounds over all its rows at once: while the balance lies in [2**m, 2**(m+1)), every request
smaller than 2**m fits, so a running sum tells when the balance leaves the band, and the first larger
request that fits ends the band too. Each round lowers m, so at most 31 rounds decide any INT budget,
and every round is a running sum over range-partitioned rows rather than a walk in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.operators.ordered import BLOCK_ROWS, running_total, scan
from pagewise.session import cut_lineage

ROWS_PER_RANGE = 100_000


def spend_in_order(
    requests: DataFrame,
    key: str,
    order: Sequence[str],
    fold_rows: int = BLOCK_ROWS,
    range_rows: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``balance_before``, ``accepted`` and ``charged``.

    ``requests`` carries ``budget`` (the same for all rows of a key), ``need`` (accepted when the balance is
    at least this) and ``charge`` (taken from the balance, never below zero). ``need <= charge + 1`` holds.
    ``order`` must be unique within a key.
    """
    sizes = requests.groupBy(key).agg(F.count("*").alias("requests"))
    large = sizes.filter(F.col("requests") > fold_rows)
    total_large = large.agg(F.sum("requests")).first()[0]
    if not total_large:
        return _fold(requests, key, order)
    small = requests.join(large.select(key), key, "left_anti")
    heavy = requests.join(large.select(key), key, "left_semi")
    return _fold(small, key, order).unionByName(_by_rounds(heavy, key, order, total_large, range_rows))


def _fold(requests: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in requests.columns if c not in (key, "budget", *order)]
    gathered = requests.groupBy(key).agg(
        F.first("budget").cast("bigint").alias("budget"),
        F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("items"),
    )
    trail = scan(
        F.col("items"),
        F.col("budget"),
        lambda balance, item: balance - F.when(balance >= item["need"], F.least(item["charge"].cast("bigint"), balance)).otherwise(F.lit(0)),
    )
    walked = gathered.select(
        key,
        "budget",
        F.inline(
            F.arrays_zip(F.col("items").alias("item"), F.slice(trail, 1, F.size("items")).alias("balance_before"))
        ),
    )
    accepted = F.col("balance_before") >= F.col("item.need")
    return walked.select(
        *[F.col(c) if c in (key, "budget") else F.col(f"item.{c}").alias(c) for c in requests.columns],
        "balance_before",
        accepted.alias("accepted"),
        F.when(accepted, F.least(F.col("item.charge").cast("bigint"), F.col("balance_before")))
        .otherwise(F.lit(0))
        .alias("charged"),
    )


def _by_rounds(requests: DataFrame, key: str, order: Sequence[str], rows: int, range_rows: int) -> DataFrame:
    columns = requests.columns
    ranges = max(1, -(-rows // range_rows))
    # Range boundaries come from a sample, so the range number is fixed on shared storage before use.
    ranged = cut_lineage(
        requests.withColumn("budget", F.col("budget").cast("bigint"))
        .repartitionByRange(ranges, key, *order)
        .withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy(key, "part").orderBy(*order)
    open_rows = ranged.withColumn("pos", F.row_number().over(inside)).withColumn("balance", F.col("budget"))

    decided: list[DataFrame] = []
    while True:
        band = F.when(F.col("balance") > 0, F.expr("shiftleft(1L, length(bin(balance)) - 1)"))
        step = open_rows.withColumn("band", band).withColumn(
            "sure", F.coalesce((F.col("need") <= F.col("band")) & (F.col("charge") < F.col("band")), F.lit(False))
        )
        step = running_total(
            step, [key], ["pos"], F.when(F.col("sure"), F.col("charge").cast("bigint")).otherwise(F.lit(0)),
            "taken", F.col("part"),
        )
        before = F.col("balance") - F.col("taken")
        leaves = F.when(F.col("sure"), before - F.col("charge") < F.col("band")).otherwise(
            (F.col("balance") > 0) & (F.col("need") <= before)
        )
        step = cut_lineage(step.withColumn("before", before).withColumn("leaves", F.coalesce(leaves, F.lit(False))))
        turn = (
            step.filter("leaves")
            .groupBy(key)
            .agg(
                F.min(
                    F.struct(
                        "part",
                        "pos",
                        (F.col("before") - F.least(F.col("charge").cast("bigint"), F.col("before"))).alias("left"),
                    )
                ).alias("turn")
            )
        )
        placed = step.join(turn, key, "left")
        here = F.struct("part", "pos")
        until = F.struct("turn.part", "turn.pos")
        settled = placed.filter(F.col("turn").isNull() | (here <= until))
        at_turn = F.coalesce(here == until, F.lit(False))
        accepted = F.col("sure") | at_turn
        decided.append(
            settled.select(
                *columns,
                F.col("before").alias("balance_before"),
                accepted.alias("accepted"),
                F.when(accepted, F.least(F.col("charge").cast("bigint"), F.col("before")))
                .otherwise(F.lit(0))
                .alias("charged"),
            )
        )
        open_rows = placed.filter(F.col("turn").isNotNull() & (here > until)).select(
            *columns, "part", "pos", F.col("turn.left").alias("balance")
        )
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, decided)
