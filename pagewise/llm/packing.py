"""Packing of token sequences into windows by non-negative least squares.

Tokenised documents are cut at multiples of the window; whole windows stand alone. What is left of each document has one
of ``window - 1`` lengths, so its histogram is bounded whatever the corpus. Pairs and triples of lengths that fill a
window exactly are the columns of a non-negative least-squares problem against the histogram (coordinate descent);
repeat counts are rounded down and limited to what is there. The residual pieces are packed greedily, longest first, as
one stream cut at window ends. Only the last window is padded.

A piece finds its place from its length and its rank among the pieces of that length. Ranks add up a number per length
and input partition to a count inside the partition, so no length is gathered in one task. Only pieces cut at a window
end are tokenised again for their check sums.

Defined cases: a null or empty text is the single end token. A text of any length is tokenised whole; one whose runs of white
space are too long for the fast encoder goes through the tokenizer file itself. Repeated rows are packed as often as they come. A null id is
carried as null. Columns beside id and text are not used. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import shipped, small_batches, stored

shipped(__name__)

WINDOW = 1024
SWEEPS = 8
END_TOKEN = 0
TOKENIZER = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}


def encoder(name: str = TOKENIZER):
    """The byte-level vocabulary as a fast encoder; its ids are those of the tokenizer file of the same name."""
    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb")
    with lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def file_ids(name: str, text: str) -> list[int]:
    """Ids by the tokenizer file: slower, without limits."""
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(str(public_tokenizers.path(f"{name}.json"))).encode(text, add_special_tokens=False).ids


def token_ids(encoding, text: str | None) -> np.ndarray:
    try:
        ids = encoding.encode_to_numpy(text or "", allowed_special="all")
    except ValueError:  # The encoder's pattern has no stack for white space of about a million characters.
        ids = file_ids(encoding.name, text)
    return np.append(ids, END_TOKEN).astype("<u4")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def _pieces(name: str, window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(name)
        for frame in frames:
            every = [token_ids(encoding, text) for text in frame["text"]]
            yield pd.DataFrame(
                {
                    "row": frame["row"],
                    "doc_id": frame["doc_id"],
                    "doc_tokens": [len(ids) for ids in every],
                    "crcs": [[_crc(ids[at : at + window]) for at in range(0, len(ids), window)] for ids in every],
                }
            )

    return run


def _recut(name: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(name)
        for frame in frames:
            crcs = []
            for text, start, length in zip(frame["text"], frame["start"], frame["length"], strict=True):
                crcs.append(_crc(token_ids(encoding, text)[start : start + length]))
            yield frame.drop(columns="text").assign(ids_crc32=crcs)

    return run


class Plan:
    """Where the pieces of each length go: ``slots[length]`` are rank bounds, sequences and offsets; then the stream."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        self.window = window
        counts = np.zeros(window, dtype=np.int64)
        for length, count in histogram.items():
            counts[length] = count
        self.slots: dict[int, list[tuple[int, int, int]]] = {}
        left, self.sequences = counts.copy(), 0
        for combo, repeats in fillings(counts, window):
            need = {length: combo.count(length) for length in combo}
            repeats = min([repeats, *(int(left[length]) // n for length, n in need.items())])
            if repeats <= 0:
                continue
            offset = 0
            for length in combo:
                first = int(counts[length] - left[length])
                self.slots.setdefault(length, []).append((first, self.sequences, offset))
                left[length] -= repeats
                offset += length
            self.sequences += repeats
        self.taken = counts - left
        self.base = np.zeros(window + 1, dtype=np.int64)
        for length in range(window - 1, 0, -1):
            self.base[length] = self.base[length + 1] + (left[length + 1] * (length + 1) if length + 1 < window else 0)
        tokens = int((left * np.arange(window)).sum())
        self.total = self.sequences + -(-tokens // window)
        self.tables = {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for length, rows in self.slots.items()}

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in piece, length, sequence, offset) of the piece, in two parts where a window ends inside it."""
        if rank < self.taken[length]:
            first, sequence, offset = self.tables[length]
            at = int(np.searchsorted(first, rank, side="right")) - 1
            return [(0, length, int(sequence[at]) + rank - int(first[at]), int(offset[at]))]
        position = int(self.base[length]) + (rank - int(self.taken[length])) * length
        sequence, offset = self.sequences + position // self.window, position % self.window
        fits = min(length, self.window - offset)
        parts = [(0, fits, sequence, offset)]
        return parts if fits == length else [*parts, (fits, length - fits, sequence + 1, 0)]


def fillings(counts: np.ndarray, window: int, sweeps: int = SWEEPS) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of two or three lengths that fill a window, with rounded least-squares repeat counts, largest first.

    Minimises the squared difference between the pieces used and the histogram over counts of zero and more, one count
    at a time.
    """
    there = [length for length in range(1, window) if counts[length]]
    present = set(there)
    combos: list[tuple[int, ...]] = [(a, window - a) for a in there if a <= window - a and window - a in present]
    combos += [(a, b, window - a - b) for a, b in combinations_with_replacement(there, 2) if b <= window - a - b and window - a - b in present]
    rest = counts.astype(float).tolist()
    repeats = [0.0] * len(combos)
    shapes = [[(length, combo.count(length)) for length in set(combo)] for combo in combos]
    norms = [sum(n * n for _, n in shape) for shape in shapes]
    for _ in range(sweeps):
        for j, shape in enumerate(shapes):
            step = sum(n * rest[length] for length, n in shape) / norms[j]
            step = max(step, -repeats[j])
            if step:
                repeats[j] += step
                for length, n in shape:
                    rest[length] -= n * step
    found = [(combo, int(count)) for combo, count in zip(combos, repeats, strict=True) if count >= 1]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def _placed(plan: Plan):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row, doc, tokens, start, length, crc, rank in frame[
                ["row", "doc_id", "doc_tokens", "start", "length", "crc", "rank"]
            ].itertuples(index=False, name=None):
                parts = plan.place(length, rank)
                for inside, size, sequence, offset in parts:
                    known = crc if len(parts) == 1 else None
                    rows.append((row, doc, start + inside, size, known, tokens, sequence, offset))
            out = pd.DataFrame(rows, columns=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            yield out.astype({"doc_id": "Int64", "ids_crc32": "Int64"})

    return run


PIECE = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    numbered = stored(
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    )
    cut = stored(
        numbered.mapInPandas(_pieces(tokenizer, window), "row long, doc_id long, doc_tokens long, crcs array<long>")
        .withColumn("part", F.shiftright("row", 33))
        .withColumn("full", F.floor(F.col("doc_tokens") / window))
        .withColumn("rest", F.col("doc_tokens") % window)
    )
    tails = cut.filter("rest > 0")
    per_part = stored(tails.groupBy("rest", "part").agg(F.count("*").alias("n")))
    plan = Plan({r["rest"]: r["n"] for r in per_part.groupBy("rest").agg(F.sum("n").alias("n")).collect()}, window)

    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("rest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "rest").orderBy("row")
    ranked = (
        tails.withColumn("at", F.row_number().over(inside) - 1)
        .join(base, ["rest", "part"])
        .select(
            "row", "doc_id", "doc_tokens",
            (F.col("doc_tokens") - F.col("rest")).alias("start"),
            F.col("rest").alias("length"),
            F.element_at("crcs", -1).alias("crc"),
            (F.col("base") + F.col("at")).alias("rank"),
        )
    )
    placed = stored(ranked.mapInPandas(_placed(plan), PIECE))
    done = placed.filter(F.col("ids_crc32").isNotNull()).drop("row")
    open_ends = placed.filter(F.col("ids_crc32").isNull())
    again = numbered.select("row", "text").join(open_ends.drop("ids_crc32"), "row").drop("row")
    closed = again.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "text").mapInPandas(
        _recut(tokenizer), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    )

    # Whole windows are numbered after the plan's sequences: windows of earlier partitions, then of earlier rows.
    totals = cut.groupBy("part").agg(F.sum("full").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    prior = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    whole = (
        cut.filter("full > 0")
        .withColumn("prior", F.coalesce(F.sum("full").over(prior), F.lit(0)))
        .join(starts, "part")
        .select("doc_id", "doc_tokens", "base", "prior", F.posexplode(F.slice("crcs", 1, F.col("full").cast("int"))).alias("i", "ids_crc32"))
        .select(
            "doc_id",
            (F.col("i") * F.lit(window)).cast("long").alias("start"),
            F.lit(window).cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.lit(plan.total) + F.col("base") + F.col("prior") + F.col("i")).cast("long").alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    return done.unionByName(closed).unionByName(whole)
