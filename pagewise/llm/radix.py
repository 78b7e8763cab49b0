"""Prefix trie of rebuilt conversations, by adaptive radix trees over fixed-width turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so a conversation is a byte string of 16 bytes a
turn and texts are read once and never shuffled; the trie needs their lengths only. Equal conversations are counted first.
Different byte strings are sorted over range partitions; a task reads its range in order and grows adaptive radix trees of
at most ``KEYS`` strings: nodes of 4, 16, 48 or 256 children that are resized as they fill, with compressed paths. Only
byte depths that are multiples of the width give trie nodes.

A trie node is a run of neighbours in sorted order, so each of its figures is a sum over the trees that hold a part of it.
A node, and its share in its parent's children, is counted by the tree where it comes first: the string before the tree's
first one tells which of its nodes came earlier. A string is a leaf unless the string after it starts with it. The ranges'
first and last strings, two for each partition, are passed on for this. The hash of a node's complete conversations runs
over their ids in order: ids are sorted over range partitions, joined in runs of ``RUN`` and hashed run after run.

Defined cases: rows without conv_id stand for no conversation. Equal turn numbers are ordered by turn id, so repeated rows
give repeated turns. Null roles and texts are empty. ``c % 5`` has the sign of c, as in SQL. A text of any length is hashed
where it is read. A conversation is one row of 40 bytes a turn. Other columns of the input are not used, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import shipped, stored

WIDTH = 16
#: Every conversation takes up to ``SHARED`` - 1 first turns from that whose id is the next lower multiple of ``FAMILY``.
SHARED, FAMILY = 9, 5
#: Strings, and bytes of them, that one tree holds at most; the last string may pass the second bound.
KEYS, BYTES = 16384, 32_000_000
#: Ids joined before they are hashed.
RUN = 8192

shipped(__name__)


class Node:
    """A node whose children fit a sorted list: 4 of them, later 16."""

    __slots__ = ("bytes", "end", "kids", "path", "room")

    def __init__(self, path: bytes, end: tuple | None = None):
        self.path, self.end, self.room = path, end, 4
        self.bytes, self.kids = bytearray(), []

    def find(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.kids[at]

    def swap(self, byte: int, kid) -> None:
        self.kids[self.bytes.find(byte)] = kid

    def add(self, byte: int, kid):
        """The node with one more child, resized if it was full."""
        if len(self.kids) == self.room:
            if self.room == 4:
                self.room = 16
            else:
                return Node48(self).add(byte, kid)
        at = sum(other < byte for other in self.bytes)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def branches(self) -> list:
        return list(zip(self.bytes, self.kids, strict=True))


class Node48:
    """A node of up to 48 children: a table of 256 places tells where a byte's child is."""

    __slots__ = ("end", "kids", "path", "places")

    def __init__(self, full: Node):
        self.path, self.end, self.kids = full.path, full.end, list(full.kids)
        self.places = bytearray(256)
        for at, byte in enumerate(full.bytes):
            self.places[byte] = at + 1

    def find(self, byte: int):
        at = self.places[byte]
        return self.kids[at - 1] if at else None

    def swap(self, byte: int, kid) -> None:
        self.kids[self.places[byte] - 1] = kid

    def add(self, byte: int, kid):
        if len(self.kids) == 48:
            return Node256(self).add(byte, kid)
        self.kids.append(kid)
        self.places[byte] = len(self.kids)
        return self

    def branches(self) -> list:
        return [(byte, self.kids[at - 1]) for byte, at in enumerate(self.places) if at]


class Node256:
    """A node with a place for every byte."""

    __slots__ = ("end", "kids", "path")

    def __init__(self, full: Node48):
        self.path, self.end = full.path, full.end
        self.kids = [full.find(byte) for byte in range(256)]

    def find(self, byte: int):
        return self.kids[byte]

    def swap(self, byte: int, kid) -> None:
        self.kids[byte] = kid

    def add(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def branches(self) -> list:
        return [(byte, kid) for byte, kid in enumerate(self.kids) if kid is not None]


def common(path: bytes, key: bytes, at: int = 0) -> int:
    """Length of the longest start of ``path`` that ``key`` has at ``at``."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if path[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Tree:
    """Strings with one value each."""

    def __init__(self):
        self.root = Node(b"")

    def put(self, key: bytes, end: tuple) -> None:
        above, edge, node, at = None, 0, self.root, 0
        while True:
            same = common(node.path, key, at)
            at += same
            if same < len(node.path):
                upper = Node(node.path[:same])
                branch, node.path = node.path[same], node.path[same + 1 :]
                now = upper.add(branch, node)
                if at == len(key):
                    now.end = end
                else:
                    now = now.add(key[at], Node(key[at + 1 :], end))
                break
            if at == len(key):
                node.end = end
                return
            kid = node.find(key[at])
            if kid is None:
                now = node.add(key[at], Node(key[at + 1 :], end))
                if now is node:
                    return
                break
            above, edge, node = node, key[at], kid
            at += 1
        if above is None:
            self.root = now
        else:
            above.swap(edge, now)


class _Part:
    """Figures of the strings below a place of the tree: members, smallest member, leaves, saved bytes, turn lengths, new nodes."""

    __slots__ = ("fresh", "leaves", "lengths", "low", "n", "saved")

    def __init__(self):
        self.n, self.low, self.leaves, self.saved, self.lengths, self.fresh = 0, None, 0, 0, None, 0

    def take(self, n: int, low: int, leaves: int, saved: int, lengths, fresh: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)
        self.leaves += leaves
        self.saved += saved
        self.lengths = lengths
        self.fresh += fresh


def _digest(hasher) -> bytes:
    return hasher.digest()[:WIDTH]


def nodes_of(tree: Tree, earlier: set[bytes]) -> Iterator[tuple]:
    """Every trie node's part in ``tree``: (node, parent, depth, n_convs, conv_id, n_children, n_leaves, saved_tokens).

    ``earlier`` holds the nodes that trees before this one have counted. Values of strings are (n, low, leaf, lengths).
    """
    start = hashlib.sha256()
    # A place: node, its trie nodes from the top, those above it, hash and bytes since the last of them, figures, next children.
    stack = []

    def enter(node, ids: list[bytes], depth: int, hasher, rest: bytes) -> None:
        data = rest + node.path
        for at in range(0, len(data) - WIDTH + 1, WIDTH):
            hasher.update(data[at : at + WIDTH])
            ids.append(_digest(hasher))
        part = _Part()
        if node.end is not None:
            n, low, leaf, lengths = node.end
            part.take(n, low, int(leaf), 0, lengths, 0)
        stack.append((node, ids, depth, hasher, data[len(data) - len(data) % WIDTH :], part, iter(node.branches())))

    enter(tree.root, [_digest(start)], 0, start, b"")
    tops = [None]
    while stack:
        node, ids, depth, hasher, rest, part, branches = stack[-1]
        bottom = ids[-1] if ids else tops[-1]
        step = next(branches, None)
        if step is not None:
            byte, kid = step
            tops.append(bottom)
            enter(kid, [], depth + len(ids), hasher.copy(), rest + bytes([byte]))
            continue
        stack.pop()
        above = tops.pop()
        if part.n:
            for at in range(len(ids) - 1, -1, -1):
                level, new = depth + at, ids[at] not in earlier
                size = part.lengths[level - 1] if level else 0
                part.saved += (part.n - new) * size
                yield ids[at], ids[at - 1] if at else above, level, part.n, part.low, part.fresh, part.leaves, part.saved
                part.fresh = int(new)
            if stack:
                stack[-1][5].take(part.n, part.low, part.leaves, part.saved, part.lengths, part.fresh)


def prefixes(key: bytes, turns: int) -> set[bytes]:
    """Ids of the trie nodes of the first 0 to ``turns`` turns of ``key``."""
    hasher = hashlib.sha256()
    found = {_digest(hasher)}
    for at in range(0, turns * WIDTH, WIDTH):
        hasher.update(key[at : at + WIDTH])
        found.add(_digest(hasher))
    return found


NODE = "node binary, parent binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long"
_NAMES = [column.split()[0] for column in NODE.split(", ")]


def _grown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of trie nodes. Rows (part, key, lengths, n, low, before, after) come sorted by part and key."""

    def rows() -> Iterator[tuple]:
        for frame in frames:
            yield from zip(*(frame[name] for name in ("part", "key", "lengths", "n", "low", "before", "after")), strict=True)

    def flushed() -> pd.DataFrame:
        known = set() if before is None else prefixes(first, common(before, first) // WIDTH)
        return pd.DataFrame(list(nodes_of(tree, known)), columns=_NAMES)

    tree, first, before, keys, size, held = Tree(), None, None, 0, 0, None
    stream = rows()
    held = next(stream, None)
    while held is not None:
        ahead = next(stream, None)
        part, key, lengths, n, low, previous, after = held
        going_on = ahead is not None and ahead[0] == part
        follower = ahead[1] if going_on else after
        if first is None:
            first = key
            before = previous if before is None else before
        tree.put(key, (int(n), int(low), follower is None or not follower.startswith(key), lengths))
        keys, size = keys + 1, size + len(key)
        if not going_on or keys >= KEYS or size >= BYTES:
            yield flushed()
            tree, first, before, keys, size = Tree(), None, key if going_on else None, 0, 0
        held = ahead


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, first, ids): the ids of each node's complete conversations, comma-joined in runs. Rows come sorted by node and id."""
    for frame in frames:
        node, conv = frame["node"].to_list(), frame["conv_id"].to_numpy()
        out, low = [], 0
        for at in range(1, len(node) + 1):
            if at == len(node) or node[at] != node[low] or at - low == RUN:
                out.append((node[low], int(conv[low]), ",".join(map(str, conv[low:at].tolist()))))
                low = at
        yield pd.DataFrame(out, columns=["node", "first", "ids"])


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, ends_sha256) from runs sorted by node and first id."""
    node, hasher = None, None
    for frame in frames:
        out = []
        for name, ids in zip(frame["node"], frame["ids"], strict=True):
            if name == node:
                hasher.update(b",")
            else:
                if node is not None:
                    out.append((node, hasher.hexdigest()))
                node, hasher = name, hashlib.sha256()
            hasher.update(ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, hasher.hexdigest())], columns=["node", "ends_sha256"])


def _sha(value: Column) -> Column:
    """The first bytes of a SHA-256, as in ``_digest``."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * WIDTH))


def rebuilt(conversations: DataFrame, shared: int = SHARED, family: int = FAMILY) -> DataFrame:
    """Per conversation: conv_id, key (its turn ids), lengths (UTF-8 bytes of its texts) and node (the id of the whole)."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.substring(named, 1, 2 * WIDTH).alias("id"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("at")).filter("conv_id is not null")
    whole = stored(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns")))
    c = F.col("conv_id")
    heads = whole.filter(c % family == 0).select(c.alias("base"), F.slice("turns", 1, shared - 1).alias("head"))
    met = whole.withColumn("base", c - c % family).join(heads, "base", "left")
    head = F.coalesce("head", F.array().cast(met.schema["turns"].dataType))
    h = (F.crc32(c.cast("string")) % shared).cast("int")
    turns = met.select("conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), ""))
    made = turns.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["size"]).alias("lengths"))
    return made.withColumn("node", _sha(F.col("key")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per trie node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = stored(rebuilt(conversations))
    different = convs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("lengths").alias("lengths"))
    ranged = stored(different.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # One row for each partition that has strings.
    order = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    dealt = ranged.join(ends, "part").repartition("part").sortWithinPartitions("part", "key")
    parts = dealt.select("part", "key", "lengths", "n", "low", "before", "after").mapInPandas(_grown, NODE)
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    sorted_ids = convs.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    runs = sorted_ids.mapInPandas(_runs, "node binary, first long, ids string")
    hashed = runs.repartition("node").sortWithinPartitions("node", "first").mapInPandas(_hashed, "node binary, ends_sha256 string")
    nodes = stored(merged.join(hashed, "node", "left"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends_sha = F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))
    return nodes.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends_sha.alias("ends_sha256")
    )


ORACLE = r"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT DISTINCT conv_id,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda v, x: list_reduce(list_concat([xor(v, x)], range(8)), lambda u, k: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 9 AS h
    FROM t
), r AS (
    SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= c.h
    UNION ALL SELECT c.conv_id, t.i + 100000, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), w AS (
    SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.i) FILTER (r.i IS NOT NULL), []) AS turns
    FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), p AS (
    SELECT conv_id AS member, d AS depth, turns[1:d] AS path, d = len(turns) AS ended FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM w)
), n AS (
    SELECT path, depth, min(member) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (ended), '')) AS ends_sha256,
        CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[depth].text) END AS own
    FROM p GROUP BY path, depth
), k AS (
    SELECT a.*, b.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = a.depth + 1 AND x.path[1:a.depth] = a.path) AS n_children
    FROM n a LEFT JOIN n b ON b.depth = a.depth - 1 AND b.path = a.path[1:a.depth - 1]
), s AS (
    SELECT path[1:u] AS path, u AS depth, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT k.*, unnest(range(0, depth + 1)) AS u FROM k) GROUP BY 1, 2
)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (path, depth)
"""
