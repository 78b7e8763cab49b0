"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent and normalised: 1 keeps the shares, 0 makes all sources equal.
The exponent is bisected until the weights meet a target entropy, or until no source is repeated more than a limit. Each
round halves the bracket ``BITS`` times in one aggregation over the sources, so sources never gather on the driver.

Weights become budgets, and budgets become passes: each pass over a source is a permutation of its documents, cut into
blocks of about ``BLOCK_TOKENS`` tokens. Whole passes are taken whole; of the last, blocks are taken in order until the
budget is met, and only inside the one block where it ends are documents counted off.

Defined cases: a null text has no tokens, a null source is a source of its own. A document without tokens is in every
pass it is drawn for and costs nothing. Repeated rows are documents of their own. The rows keep the columns of the input,
whatever their names. An empty table gives an empty mixture.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import WORD, stored

BITS = 4
ROUNDS = 6
BLOCK_TOKENS = 200_000
SEED = 17


@dataclass(frozen=True)
class Mixture:
    """Documents as blocks, the exponent, and per source its tokens, weight, budget and passes."""

    docs: DataFrame
    exponent: float
    sources: DataFrame


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def bisected(totals: DataFrame, repeat_limit: float | None, target_entropy: float | None) -> tuple[float, float]:
    """Exponent in [0, 1], and the mixture's tokens as a multiple of all tokens with each document in it once or more.

    Entropy and repetition both fall as the exponent grows. The largest exponent that reaches ``target_entropy`` (nats), or
    the smallest that keeps every source within ``repeat_limit`` passes, is returned. A target out of reach gives the
    nearer end.
    """
    share = F.col("tokens") / F.col("all")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / 2**BITS for i in range(2**BITS + 1)]
        sums = []
        for i, a in enumerate(grid):
            sums += [
                F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"),
                F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{i}"),
                F.max(F.pow(share, F.lit(a - 1))).alias(f"hi{i}"),
                F.min(F.pow(share, F.lit(a - 1))).alias(f"lo{i}"),
            ]
        row = totals.filter("tokens > 0").agg(*sums).first()
        if row is None or row["z0"] is None:
            return 1.0, 1.0
        def wanted(i: int, a: float) -> bool:
            """True on the side of small exponents."""
            if target_entropy is not None:
                return math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"] >= target_entropy
            return row[f"hi{i}"] / row[f"lo{i}"] > (repeat_limit or 1.0)

        left = [wanted(i, a) for i, a in enumerate(grid)]
        at = max([i for i, yes in enumerate(left) if yes], default=None)
        if at is None:
            low = high = grid[0]
            break
        if at == 2**BITS:
            low = high = grid[-1]
            break
        low, high = grid[at], grid[at + 1]
    exponent = low if target_entropy is not None else high
    final = totals.filter("tokens > 0").agg(F.sum(F.pow(share, F.lit(exponent))).alias("z"), F.min(F.pow(share, F.lit(exponent - 1))).alias("lo")).first()
    return exponent, final["z"] / final["lo"]


def mixture(
    docs: DataFrame,
    repeat_limit: float | None = 2.0,
    target_entropy: float | None = None,
    budget: float | None = None,
    source: str = "source",
    text: str = "text",
) -> Mixture:
    """Weights and budgets. Without ``budget`` (in tokens) it is the least with which every document is in the mixture."""
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source).cast("string").alias("source"), tokens_of(docs[text]).alias("tokens"))
    held = stored(counted.select(F.monotonically_increasing_id().alias("row"), "doc", "source", "tokens"))
    totals = held.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    every = held.agg(F.sum("tokens")).first()[0] or 0
    totals = stored(totals.withColumn("all", F.lit(every).cast("double")))
    exponent, times = bisected(totals, repeat_limit, target_entropy)
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all"), F.lit(exponent))).otherwise(0.0)
    z = totals.agg(F.sum(raised)).first()[0] or 1.0
    whole = F.lit(float(budget)) if budget is not None else F.col("all") * F.lit(times)
    weighed = totals.withColumn("weight", raised / F.lit(z)).withColumn("budget", F.round(F.col("weight") * whole).cast("long"))
    if budget is None:
        weighed = weighed.withColumn("budget", F.greatest("budget", "tokens"))
    blocks = F.greatest(F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)), F.lit(1)).cast("long")
    sources = weighed.select(
        "source", "tokens", "documents", "weight", "budget", blocks.alias("blocks"),
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long").alias("passes"),
    )
    return Mixture(held, exponent, stored(sources))


def drawn(mix: Mixture) -> DataFrame:
    """The mixture, one row per document and pass: row, doc, source, tokens, pass, block and ``order`` inside the block."""
    sources = mix.sources.select(F.col("source").alias("of"), F.col("tokens").alias("source_tokens"), "budget", "blocks", "passes")
    placed = mix.docs.join(sources, F.col("source").eqNullSafe(F.col("of")))
    each = placed.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    order = F.xxhash64(F.lit(SEED), "pass", "row")
    each = each.select(
        "row", "source", "tokens", "passes", "pass", F.pmod(F.xxhash64(order), F.col("blocks")).alias("block"), order.alias("order"),
        (F.col("budget") - F.col("passes") * F.col("source_tokens")).alias("left"),
    )
    whole = each.filter("pass < passes")
    part = each.filter("pass = passes and left > 0")
    sums = part.groupBy("source", "left", "block").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).filter(F.col("before") < F.col("left"))
    sums = sums.select(F.col("source").alias("of"), F.col("block").alias("of_block"), "before", "n")
    met = part.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    inner = met.filter(F.col("before") + F.col("n") <= F.col("left"))
    inside = Window.partitionBy("source", "block").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    edge = met.filter(F.col("before") + F.col("n") > F.col("left"))
    edge = edge.withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).filter(F.col("so_far") < F.col("left"))
    names = ["row", "source", "tokens", "pass", "block", "order"]
    return whole.select(names).union(inner.select(names)).union(edge.select(names))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` as often as the mixture holds them, with their columns."""
    mix = mixture(docs, **options)
    times = drawn(mix).groupBy("row").agg(F.count("*").cast("int").alias("times"))
    return mix.docs.join(times, "row").select(F.explode(F.array_repeat("doc", F.col("times"))).alias("doc")).select("doc.*")


def mixing_digest(docs: DataFrame) -> DataFrame:
    """Each draw of a document: doc_id, source, tokens, pass, block, the source's weight and the exponent."""
    mix = mixture(docs)
    ids = mix.docs.select("row", F.col("doc.doc_id").alias("doc_id"))
    weights = mix.sources.select(F.col("source").alias("of"), "weight", "budget")
    rows = drawn(mix).join(ids, "row").join(weights, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "source", "tokens", "pass", "block", "weight", "budget", F.lit(mix.exponent).alias("exponent"))
