"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of its 5-word shingles, seen through ``SIZE`` minwise hash values. A tree starts with all sets in
one node. Each node draws one or two minwise coordinates at random; a child holds the sets that agree in one of them.
Nodes of at most ``LEAF`` sets are compared exhaustively, inside the task that holds the node, on one byte of each minwise
value; a tree ends where no larger node is left. The chance that a pair of a given similarity stays together on some path down to the last level follows from the
branching; independent trees repeat this until the target recall is met (``trees_for``).

Two sets whose bytes agree often enough are candidates. The trees only have to find the classes of candidates, so a node
gives no pairs but one link for every two classes it joins. Nodes that stay large are dense: at one level the set nearest to
the node's modal minwise values is its pivot, every member is compared with it, and those alike become one class, so only
the members outside a node's largest class are still compared. Nodes large to the last level become one class whole, which
can only add candidates.

Links are then confirmed on full sets, exactly and inside tasks. A set belongs to one class and is sent once. A class too
large for one task is cut into blocks: some of its sets are held against all blocks, true links to them make balls, and
only the sets outside the largest ball meet the other blocks, each time giving one link for every two balls that are joined.
n sets make about sqrt(n) / 8 blocks, so at most n * sqrt(n) / 8 rows meet; the comparisons inside tasks stay all pairs of the
sets outside. Above 2 million shingles a block no longer grows, and rows are those over the number of blocks this gives.

Equal sets are one vertex, so copies cost nothing. Links become classes by large-star and small-star rounds.

Defined cases: a null or empty text has an empty set and is its own class. Repeated rows (same id and text) come back as
often as they came. A null id stands for no document and forms no link; its row keeps a null class and is kept. Other
columns of the input are not used, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import WORD, shipped, small_batches, stored
from pagewise.session import cut_lineage

SHINGLE = 5
SIZE = 64
#: A node has one branch, and a second with this chance, so sets that are alike by less than 1 / 1.5 thin out on the way.
SECOND_BRANCH = 0.5
#: Meeting so many sets takes one set 14 microseconds in each tree; hashing a text of 300 words takes 300.
LEAF = 1024
DEPTH = 8
#: Members of a node's largest ball that one task compares with the sets outside it.
SPLIT = 4096
#: About so many members of a dense node vote for its modal values; every member is then held against them.
VOTERS = 64
#: Levels whose large nodes get pivots.
STAR_LEVELS = (1,)
TARGET_RECALL = 0.9999
#: A class is confirmed in blocks of about so many sets, or of so many shingles; and sets held against all blocks of one.
BLOCK, VOLUME, PIVOTS = 256, 2_000_000, 32
#: Sets of two blocks that are multiplied at once.
PATCH = 512
#: Different shingles whose sets are multiplied at once.
COLUMNS = 4096
#: Pairs whose minwise values agree in fewer places are not looked at: five deviations below 0.85 or 0.80 of 64.
LEAST_AGREEMENT = {0.85: 40, 0.80: 35}
#: Shingles whose minwise values are taken at once.
STRIDE = 512
#: Words whose hash a worker remembers before it starts over.
REMEMBERED = 500_000

shipped(__name__)

_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_DRAW = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _DRAW.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _DRAW.integers(0, 2**63, SIZE, dtype=np.uint64)
_PLACES = _DRAW.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def trees_for(similarity: float, recall: float = TARGET_RECALL) -> int:
    """Independent trees after which a pair of ``similarity`` has met with chance ``recall``.

    A pair meets for good when some node of level ``DEPTH`` holds it: nodes that end earlier are compared whole. (On paths
    without an end, pairs that agree in at most 1 / 1.5 of the coordinates would part for certain, whatever the trees.)
    All trees draw from the same ``SIZE`` coordinates, so the chance is averaged over how many of them the pair agrees in.
    """
    missed = []
    for agreed in range(SIZE + 1):
        meet = 1.0
        for _ in range(DEPTH):
            meet = 1 - (1 - agreed / SIZE * meet) * (1 - SECOND_BRANCH * agreed / SIZE * meet)
        weight = math.comb(SIZE, agreed) * similarity**agreed * (1 - similarity) ** (SIZE - agreed)
        missed.append((weight, 1 - meet))
    trees = 1
    while sum(weight * miss**trees for weight, miss in missed) > 1 - recall:
        trees += 1
    return trees


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def shingle_hashes(text: str | None, seen: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; ``seen`` remembers word hashes."""
    found = _WORD.findall((text or "").translate(_LOWER))
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(seen) > REMEMBERED:
        seen.clear()
    for word in set(found).difference(seen):
        seen[word] = xxhash.xxh64_intdigest(word)
    hashes = np.fromiter(map(seen.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(SHINGLE, len(found))
    last = len(found) - width + 1
    total = np.full(last, width, dtype=np.uint64)
    for place in range(width):
        total += _mixed(hashes[place : place + last] * _PLACES[place])
    return np.unique(_mixed(total))


def minwise(hashes: np.ndarray) -> np.ndarray:
    low = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), STRIDE):
        low = np.minimum(low, ((hashes[start : start + STRIDE, None] ^ _MASKS) * _FACTORS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, int] = {}
    for frame in frames:
        sets = [shingle_hashes(text, seen) for text in frame["text"]]
        yield pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "mark": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "minima": (minima := [minwise(s) if len(s) else None for s in sets]),
                "sketch": [None if m is None else m.astype(np.int8) for m in minima],
            }
        )


def _full(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, int] = {}
    for frame in frames:
        yield frame.drop(columns="text").assign(shingles=[shingle_hashes(text, seen).view(np.int64) for text in frame["text"]])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, mark (a 128-bit hash of the set), minima and their low bytes of every row of ``doc_id, text``."""
    small_batches(docs.sparkSession)
    return docs.mapInPandas(_signed, "doc_id long, n_shingles long, mark binary, minima array<int>, sketch array<tinyint>")


def _drawn(node: Column) -> list[Column]:
    """The children of ``node`` that hold a set with ``minima``; the second is null where the node has one branch."""
    drawn = [F.xxhash64(node, F.lit(branch)) for branch in range(2)]
    first, second = (F.xxhash64(at, F.element_at("minima", (F.pmod(at, F.lit(SIZE)) + 1).cast("int"))) for at in drawn)
    return [first, F.when(F.pmod(F.xxhash64(node, F.lit("fork")), F.lit(1000)) < int(1000 * SECOND_BRANCH), second)]


def _children(nodes: DataFrame) -> DataFrame:
    """Rows (node, rep, ball, first, second) one level below ``nodes`` (node, rep, ball, minima): a child for each drawn coordinate and value.

    ``first`` and ``second`` are the set's nodes one more level down, so that minima are fetched for every other level only.
    """
    reached = nodes.select("rep", "ball", "minima", F.explode(F.array_compact(F.array(*_drawn(F.col("node"))))).alias("node"))
    first, second = _drawn(F.col("node"))
    return reached.select("rep", "ball", "node", first.alias("first"), second.alias("second"))


def _grandchildren(nodes: DataFrame) -> DataFrame:
    """Rows (node, rep, ball) one level below the rows of ``_children``."""
    return nodes.select("rep", "ball", F.explode(F.array_compact(F.array("first", "second"))).alias("node"))


def _sized(nodes: DataFrame) -> DataFrame:
    """Add the node's size, largest ball and how many sets lie outside it; nodes of one ball are finished and gone.

    ``nodes`` is read twice: what a join makes is stored first.
    """
    balls = nodes.groupBy("node", "ball").agg(F.count("*").alias("n"))
    sizes = balls.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "ball")).alias("top"))
    sizes = sizes.select("node", "size", F.col("top.ball").alias("top"), (F.col("size") - F.col("top.n")).alias("outside"))
    return nodes.join(sizes.filter("outside > 0"), "node")


class Classes:
    """Classes of a few names, joined link by link."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, name: int) -> int:
        while (above := self.parent.get(name, name)) != name:
            self.parent[name] = self.parent.get(above, above)
            name = above
        return name

    def joins(self, a: int, b: int) -> bool:
        """Join the classes of ``a`` and ``b``; false if they were one."""
        x, y = self.find(a), self.find(b)
        self.parent[x] = y
        return x != y

    def spanning(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Positions of the links (a, b) that join two classes, in order."""
        _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
        return [at for at in np.sort(first).tolist() if self.joins(int(a[at]), int(b[at]))]


def _alike_in(least: int):
    """Links (a, b) that join the balls of each node whose sketches agree in at least ``least`` places.

    Rows come sorted by node and part, the few sets outside the largest ball first; the others pass by them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, classes, ids, balls, sketches = None, Classes(), *_nothing()
        for frame in frames:
            if not len(frame):
                continue
            node, part = frame["node"].to_numpy(), frame["part"].to_numpy()
            rep, ball, out = frame["rep"].to_numpy(), frame["ball"].to_numpy(), frame["out"].to_numpy()
            sketch = np.concatenate(frame["sketch"].to_list()).reshape(-1, SIZE)
            ends = np.append(np.flatnonzero((node[1:] != node[:-1]) | (part[1:] != part[:-1])) + 1, len(node))
            found, low = [], 0
            for high in ends.tolist():
                if key != (node[low], part[low]):
                    key, classes, ids, balls, sketches = (node[low], part[low]), Classes(), *_nothing()
                inner = low + int(out[low:high].sum())
                known = len(ids)
                ids, balls = np.append(ids, rep[low:inner]), np.append(balls, ball[low:inner])
                sketches = np.concatenate([sketches, sketch[low:inner]])
                # Part 0 alone also compares the sets outside with each other, each pair when its later set arrives.
                for start in range(low if key[1] == 0 else inner, high, 1024):
                    stop = min(start + 1024, high)
                    same = _agreeing(sketch[start:stop], sketches) >= least
                    same &= ball[start:stop, None] != balls[None, :]
                    late, early = np.nonzero(same)
                    at = start + late
                    fresh = (at >= inner) | (early < known + at - low)
                    late, early = at[fresh], early[fresh]
                    if len(late):
                        kept = classes.spanning(ball[late], balls[early])
                        found.append((rep[late[kept]], ids[early[kept]]))
                low = high
            if found:
                x, y = (np.concatenate(side) for side in zip(*found, strict=True))
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _agreeing(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """In how many places each sketch of ``first`` agrees with each of ``second``."""
    if len(first) * len(second) < 10_000:
        return (first[:, None, :] == second[None, :, :]).view(np.uint8).sum(axis=2, dtype=np.uint8)
    total = np.zeros((len(first), len(second)), dtype=np.uint8)
    for x, y in zip(np.ascontiguousarray(first.T), np.ascontiguousarray(second.T), strict=True):
        total += x[:, None] == y[None, :]
    return total


def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, SIZE), dtype=np.int8)


def _node_pairs(small: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Distinct links between the balls of nodes with at most ``LEAF`` sets outside their largest ball.

    A large ball is cut into parts, and the sets outside it meet every part.
    """
    parts = F.ceil(F.col("size") / F.lit(SPLIT))
    out = F.col("ball") != F.col("top")
    part = F.when(out, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), parts)))
    dealt = small.select("node", "rep", "ball", out.alias("out"), F.explode(part).alias("part")).join(sets.select("rep", "sketch"), "rep")
    rows = dealt.repartition("node", "part").sortWithinPartitions("node", "part", F.desc("out"))
    return rows.select("node", "part", "rep", "ball", "out", "sketch").mapInPandas(_alike_in(least), "a long, b long").distinct()


def _agreement(left: Column, right: Column) -> Column:
    same = F.zip_with(left, right, lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, one: total + one)


def _ordered(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _dense_pairs(dense: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Rows (pivot, rep) of large nodes whose sketches are alike; the pivot agrees best with the node's modal values."""
    shown = stored(dense.select("node", "rep", "size").join(sets.select("rep", "sketch"), "rep"))
    voters = shown.filter(F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("size") / F.lit(VOTERS))) == 0)
    votes = voters.select("node", F.posexplode("sketch").alias("at", "value")).groupBy("node", "at", "value").count()
    modes = votes.groupBy("node", "at").agg(F.max(F.struct("count", "value")).alias("top"))
    modal = modes.groupBy("node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("top.value").alias("value")))), lambda x: x["value"]).alias("modal")
    )
    # A node without a voter takes its smallest set as pivot.
    agreed = F.coalesce(_agreement(F.col("sketch"), F.col("modal")), F.lit(0))
    scored = shown.join(modal, "node", "left").select("node", (-F.col("rep")).alias("low"), agreed.alias("score"), "sketch")
    pivots = scored.groupBy("node").agg(F.max(F.struct("score", "low", "sketch")).alias("top"))
    pivots = pivots.select("node", (-F.col("top.low")).alias("pivot"), F.col("top.sketch").alias("pivot_sketch"))
    met = shown.join(pivots, "node").filter((F.col("rep") != F.col("pivot")) & (_agreement(F.col("sketch"), F.col("pivot_sketch")) >= least))
    return met.select("pivot", "rep")


def _stars(dense: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Distinct links (a, b) between the pivots and the alike sets of large nodes."""
    return stored(_dense_pairs(dense, sets, least).select(*_ordered(F.col("pivot"), F.col("rep"))).distinct())


def _balls(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (rep and more) with ball: the class of ``links`` that a set is in; else the set itself."""
    placed = rows.join(components(links), F.col("rep") == F.col("vertex"), "left")
    return placed.withColumn("ball", F.coalesce("component", "rep")).drop("vertex", "component")


def _finished(sized: DataFrame) -> DataFrame:
    """Rows of nodes that are compared whole."""
    return sized.filter(F.col("outside") <= LEAF).select("node", "rep", "ball", "top", "size")


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the sets of ``sets`` (rep, minima, sketch) as all pairs of candidates do, or more."""
    least = LEAST_AGREEMENT[percent / 100]
    trees = [F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(trees_for(percent / 100))]
    nodes = sets.select("rep", F.col("rep").alias("ball"), "minima", F.explode(F.array(*trees)).alias("node"))
    small, found = [], []
    for level in range(1, DEPTH + 1):
        if level > 1 and large.isEmpty():
            break
        if level % 2 == 0:
            sized = stored(_sized(_grandchildren(large)))
        elif level == 1:
            sized = stored(_sized(_children(nodes)))
        else:
            sized = stored(_sized(stored(_children(large.select("node", "rep", "ball").join(sets.select("rep", "minima"), "rep")))))
        small.append(_finished(sized))
        large = sized.filter(F.col("outside") > LEAF)
        if level in STAR_LEVELS:
            stars = _stars(large, sets, least)
            found.append(stars)
            sized = stored(_sized(stored(_balls(large.drop("ball", "size", "top", "outside"), stars))))
            small.append(_finished(sized))
            large = sized.filter(F.col("outside") > LEAF)
    found.append(_node_pairs(reduce(DataFrame.union, small), sets, least))
    # Dense to the last level: one class.
    low = large.groupBy("node").agg(F.min("rep").alias("a"))
    found.append(large.join(low, "node").filter("rep != a").select("a", F.col("rep").alias("b")).distinct())
    return stored(reduce(DataFrame.union, found).distinct())


def _shared(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``first`` with all of ``second``."""
    both = [*first, *second]
    sizes = np.array([len(s) for s in both])
    _, place, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(both)), sizes), count[place] > 1
    # Shingles of one set alone take no part; the others are numbered and taken in blocks.
    row, place = row[often], (np.cumsum(count > 1) - 1)[place[often]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = np.zeros((len(first), len(second)), dtype=np.int64)
    width = min(COLUMNS, max(1, int((count > 1).sum())))
    ends = np.searchsorted(place, np.arange(0, int((count > 1).sum()) + width, width))
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        held = np.zeros((len(both), width), dtype=np.float32)
        held[row[low:high], place[low:high] % width] = 1
        total += (held[: len(first)] @ held[len(first) :].T).astype(np.int64)
    return total


def _confirmed_in(percent: int):
    """Links (a, b) of similar sets that join two balls of a cell (cluster, i, j): block i against block j. Rows come sorted by cell."""

    def links(cell: pd.DataFrame) -> pd.DataFrame:
        block, ball, rep = (cell[name].to_numpy() for name in ("block", "ball", "rep"))
        first, second = (np.flatnonzero(block == cell[side].iloc[0]) for side in ("i", "j"))
        shingles = cell["shingles"].to_list()
        sizes = np.array([len(s) for s in shingles])
        classes, found = Classes(), [np.empty((2, 0), dtype=np.int64)]
        for low in range(0, len(first), PATCH):
            # A block against itself: patches below the diagonal repeat those above.
            for start in range(low if cell["i"].iloc[0] == cell["j"].iloc[0] else 0, len(second), PATCH):
                own, others = first[low : low + PATCH], second[start : start + PATCH]
                common = _shared([shingles[k] for k in own], [shingles[k] for k in others])
                union = sizes[own][:, None] + sizes[others][None, :] - common
                x, y = np.nonzero((100 * common >= percent * union) & (ball[own][:, None] != ball[others][None, :]))
                x, y = own[x], others[y]
                kept = classes.spanning(ball[x], ball[y]) if len(x) else []
                found.append(np.sort([rep[x[kept]], rep[y[kept]]], axis=0))
        a, b = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            names = frame[["cluster", "i", "j"]].to_numpy()
            starts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *starts], [*starts, len(frame)], strict=True):
                if kept and (kept[-1][["cluster", "i", "j"]].to_numpy()[-1] != names[low]).any():
                    yield links(pd.concat(kept))
                    kept = []
                kept.append(frame.iloc[low:high])
        if kept:
            yield links(pd.concat(kept))

    return run


def _in_cells(rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of ``rows`` (cluster, i, j, block, rep, ball, shingles)."""
    small_batches(rows.sparkSession)
    dealt = rows.select("cluster", "i", "j", "block", "rep", "ball", "shingles").repartition("cluster", "i", "j")
    return dealt.sortWithinPartitions("cluster", "i", "j").mapInPandas(_confirmed_in(percent), "a long, b long")


def confirmed(clusters: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) with 100 * intersection >= ``percent`` * union on full sets, that connect the sets of each cluster as all such links do.

    ``clusters`` has (rep, cluster); full sets are made once from the texts of the clusters' sets.
    """
    members = clusters.join(sets.select("rep", "n_shingles"), "rep")
    # A set meets every block, so blocks grow with the square root of the class, and its rows do not grow with its square.
    most = F.count("*") / F.lit(BLOCK)
    cut = F.ceil(F.greatest(F.least(most, 2 * F.sqrt(most)), F.sum("n_shingles") / F.lit(VOLUME)))
    members = stored(members.join(members.groupBy("cluster").agg(F.count("*").alias("n"), cut.alias("blocks")), "cluster"))
    texts = docs.join(members.drop("n_shingles").hint("merge"), docs["doc_id"] == members["rep"]).select("rep", "cluster", "n", "blocks", "text")
    full = stored(texts.mapInPandas(_full, "rep long, cluster long, n long, blocks long, shingles array<long>").dropDuplicates(["rep"]))
    nought = F.lit(0).cast("long")
    whole = full.filter("blocks = 1").select("*", F.col("rep").alias("ball"), nought.alias("block"), nought.alias("i"), nought.alias("j"))
    cells = full.filter("blocks > 1")
    found = _in_cells(whole, percent)
    if not members.filter("blocks > 1").isEmpty():
        found = found.union(_large_links(cells, members.filter("blocks > 1"), percent))
    return stored(found.distinct())


def _large_links(full: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of clusters of several blocks: first to some sets of each, then of the sets outside its largest ball."""
    mine, blocks = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.col("blocks")
    picked = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.ceil(F.col("n") / F.lit(PIVOTS))) == 0
    # Block -1 holds the pivots; a pivot is also in its own block.
    own = full.withColumn("block", mine).withColumn("i", F.lit(-1).cast("long")).withColumn("j", mine)
    held = full.filter(picked).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    held = held.withColumn("block", F.lit(-1).cast("long")).withColumn("i", F.lit(-1).cast("long"))
    columns = ["cluster", "i", "j", "block", "rep", "shingles"]
    first = stored(_in_cells(own.select(columns).union(held.select(columns)).withColumn("ball", F.col("rep")), percent).distinct())
    balls = stored(_balls(members, first))
    tops = balls.groupBy("cluster", "ball").agg(F.count("*").alias("inside")).groupBy("cluster").agg(F.max(F.struct("inside", "ball")).alias("top"))
    placed = balls.join(tops.select("cluster", "top"), "cluster").filter("n > top.inside")
    # Blocks are as full as before, so their number is shared out by the sets inside and outside.
    outer, inner = (F.ceil(blocks * count / F.col("n")) for count in (F.col("n") - F.col("top.inside"), F.col("top.inside")))
    out = F.col("ball") != F.col("top.ball")
    block = F.when(out, F.pmod(F.xxhash64("rep"), outer)).otherwise(outer + F.pmod(F.xxhash64("rep"), inner))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.when(out, outer + inner).otherwise(outer) - 1))
    cells = placed.select("rep", "cluster", "ball", block.alias("block"), met.alias("met"))
    cells = cells.select("rep", "cluster", "ball", "block", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"))
    return _in_cells(cells.join(full.select("rep", "shingles"), "rep"), percent).union(first)


def links(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b), a < b, that connect the different sets of ``sets`` (rep, n_shingles, minima, sketch)."""
    clusters = components(candidates(sets, percent)).select(F.col("vertex").alias("rep"), F.col("component").alias("cluster"))
    return confirmed(stored(clusters), sets, docs, percent)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b); the component is its smallest vertex.

    Each round points the larger neighbours of a vertex at its smallest (large star), then all its smaller neighbours
    (small star); the edges end as stars around the smallest vertices.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stored(signatures(own))
    known = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    one = [F.first(name).alias(name) for name in ("n_shingles", "minima", "sketch")]
    sets = stored(known.groupBy("mark").agg(F.min("doc_id").alias("rep"), *one))
    classes = components(links(own.filter(F.col("doc_id").isNotNull()), sets.drop("mark"), percent))
    marks = sets.join(classes, F.col("rep") == F.col("vertex"), "left").select(
        F.col("mark").alias("of_mark"), F.coalesce("component", "rep").alias("component")
    )
    # Sets of copies share a mark that may hold a large share of all rows: the small side is one row a mark.
    joined = signed.join(marks, (F.col("mark") == F.col("of_mark")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each class, with its columns: the one with the smallest id. Rows that repeat it stay."""
    kept = near_duplicates(docs, percent).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]), "left_semi")


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)
), r AS (
    SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v
), m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
"""
