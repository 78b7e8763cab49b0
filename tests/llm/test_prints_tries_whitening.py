"""SimHash classes, prefix tries and whitening against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pagewise.llm import radix, simhash, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=60):
    draw = random.Random(seed)
    return " ".join(draw.choice("abcdefghij") + str(draw.randrange(400)) for _ in range(n))


def changed(text, seed, n=1):
    words, draw = text.split(" "), random.Random(seed)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"é{draw.randrange(10**6)}"
    return " ".join(words)


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """{vertex: smallest vertex reachable over links of at most 4 differing bits} for (vertex, print) pairs."""
    parent = {v: v for v, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, p in prints:
        for b, q in prints:
            if a < b and (p ^ q).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in parent}


def simhash_rows():
    rows = [(i, prose(i)) for i in range(20, 40)]
    rows += [(100 + i, changed(prose(1, 200), i)) for i in range(60)]
    rows += [(200, prose(20)), (201, prose(20).upper()), (1, None), (2, ""), (3, " \n\t"), (4, "Two words"), (5, "two WORDS"), (6, "é" * 5)]
    rows += [(300, " ".join(f"w{i}" for i in range(70_000))), (301, "x" * 1_000_000), (22, prose(22)), (None, prose(23)), (None, None)]
    return rows


@pytest.mark.parametrize(("leaf", "block"), [(simhash.LEAF, simhash.BLOCK), (2, 4)])
def test_simhash_classes_are_those_of_brute_force(spark, documents, monkeypatch, leaf, block):
    """With a tiny leaf and tiny blocks, every bucket goes through balls and cells."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = simhash_rows()
    got = simhash.simhash_classes(documents([(i, t, "en", "a", 1, "x") for i, t in rows], ", component_id string")).collect()
    expected = brute_classes([(i, brute_print(t)) for i, t in rows if i is not None])
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(f"{brute_print(t):016x}")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert r.fingerprint in texts[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert len({expected[100 + i] for i in range(60)}) < 30, "near copies should be linked"


@pytest.mark.parametrize(("distance", "segments", "leaf", "block"), [(4, 3, 64, 4096), (4, 3, 3, 5), (4, 2, 3, 5), (3, 5, 64, 64), (1, 3, 2, 3), (0, 3, 2, 3)])
def test_links_connect_all_close_prints(spark, monkeypatch, distance, segments, leaf, block):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(distance)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(6))}))
    signed = [p - (p >> 63 << 64) for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), distance, segments).collect()
    mask = (1 << 64) - 1
    allowed = max(distance, 2) if distance >= 2 else distance
    assert all(((r.a ^ r.b) & mask).bit_count() <= allowed for r in found)
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def joined(pairs):
        for p in parent:
            parent[p] = p
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        return {p: find(p) for p in parent}

    all_pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= distance]
    assert joined([(r.a, r.b) for r in found]) == joined(all_pairs)


def test_simhash_of_an_empty_table(spark, documents):
    assert simhash.simhash_classes(documents([])).count() == 0


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            at = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, at, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append((c, d == len(whole)))
    kids = Counter(path[:-1] for path in nodes if path)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = hashlib.sha256(",".join(map(str, sorted(c for c, ended in members if ended))).encode()).hexdigest()
        above = min(c for c, _ in nodes[path[:-1]]) if path else None
        out.append((min(c for c, _ in members), len(path), above, len(members), kids[path], sum(not kids[p] for p in below), saved, ends))
    return Counter(out)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")


def trie_rows():
    draw, rows = random.Random(3), []
    for c in range(150):
        if c not in (35, 77):  # a conversation that others take turns from, and another, are absent
            for t in range(draw.randrange(1, 7)):
                rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["hi", "é" * t, "same text", f"own {c}"])))
    rows += [(200 + i, 0, "system", "common") for i in range(40)]
    rows += [(500, None, "user", "null turn first"), (500, 3, None, None), (500, 1, "user", ""), (500, 1, "user", ""), (None, 0, "user", "x")]
    rows += [(600, t, "user", "deep" * (t % 3)) for t in range(1200)] + [(601, 0, "user", "long" * 250_000)]
    return rows


@pytest.mark.parametrize("keys", [radix.KEYS, 1, 7])
def test_trie_is_that_of_brute_force(spark, monkeypatch, keys):
    """Trees of one or a few strings share most trie nodes with their neighbours."""
    monkeypatch.setattr(radix, "KEYS", keys)
    monkeypatch.setattr(radix, "RUN", 3)
    rows = [r for r in trie_rows() if r[0] != 600 or r[1] < 60]
    got = radix.prefix_trie(conversations(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_trie(rows)


def test_trie_of_deep_and_no_conversations(spark):
    deep = radix.prefix_trie(conversations(spark, [(600, t, "user", str(t)) for t in range(20_000)])).collect()
    assert len(deep) == 20_001 and all(r.n_convs == 1 and r.n_leaves == 1 and not r.saved_tokens for r in deep)
    assert radix.prefix_trie(conversations(spark, [])).count() == 0


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    (root,) = radix.prefix_trie(conversations(spark, [(c, 0, "user", "gone")])).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_tree_nodes_grow_through_all_layouts():
    tree, seen = radix.Tree(), set()
    for byte in random.Random(5).sample(range(256), 256):
        tree.put(bytes([7, byte, 1, 2]), (1, byte, True, [0]))
        node = tree.root.find(7) if len(tree.root.path) == 0 else tree.root
        seen.add((type(node).__name__, getattr(node, "room", 0)))
    assert {("Node", 4), ("Node", 16), ("Node48", 0), ("Node256", 0)} <= seen
    assert [byte for byte, _ in tree.root.find(7).branches()] == list(range(256))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int")


def vector_rows(n=200, width=6, seed=1):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(size=(width, width))
    rows = [(i, [float(x) for x in draw.normal(size=width) @ mixed]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(n // 2)]


def test_whitening_is_that_of_brute_force(spark):
    rows = vector_rows()
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0] * 5), (906, [1e30] * 6), (None, rows[1][1])]
    used = [*rows, odd[-1]]
    got = whitening.whitened(vectors(spark, rows + odd)).collect()
    x = np.array([[np.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in used])
    n, sums = len(x), x.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    expected = (x - sums / n) @ basis / np.sqrt(values)
    by_id = {(i, k + 1): expected[at, k] for at, (i, _) in enumerate(used) for k in range(6)}
    deviation = {i: int(((n * x[at].astype(object) - sums.astype(object)) ** 2).sum()) for at, (i, _) in enumerate(used)}
    assert Counter((r.vec_id, r.component) for r in got) == Counter(by_id.keys())
    signs = {k: np.sign(next(r.whitened for r in got if (r.vec_id, r.component) == (0, k)) * by_id[0, k]) for k in range(1, 7)}
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.whitened * signs[r.component] == pytest.approx(by_id[r.vec_id, r.component], abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_whitening_without_variance_and_with_equal_values(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    corners = [(i, [float(a), float(b), 5.0]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got = whitening.whitened(vectors(spark, corners)).collect()
    assert len(got) == 8 and all(r.explained == 0.5 and r.identity_error < 1e-12 for r in got)
    one = whitening.whitened(vectors(spark, [(1, [1.0]), (2, [3.0])])).collect()
    assert sorted(abs(r.whitened) for r in one) == [1.0, 1.0]


def test_sums_of_large_entries_are_exact():
    y = np.array([[2**45, -(2**44)], [3, 2**45 - 1]], dtype=np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(2)] for i in range(2)]
    assert whitening._products(y).tolist() == exact


@pytest.mark.parametrize("width", [1, 2, 3, 7])
def test_polynomials_and_roots_are_exact(width):
    draw = np.random.default_rng(width)
    m = draw.integers(-9, 9, size=(width, width))
    matrix = [[int(v) for v in row] for row in m @ m.T]
    moduli = whitening.primes(3)
    for modulus, row in zip(moduli, whitening.polynomials_mod(matrix, moduli).tolist(), strict=True):
        for t in range(width + 1):
            a = [[(t * (i == j) - matrix[i][j]) % modulus for j in range(width)] for i in range(width)]
            det = 1
            for k in range(width):
                at = next((i for i in range(k, width) if a[i][k]), None)
                if at is None:
                    det = 0
                    break
                if at != k:
                    a[k], a[at], det = a[at], a[k], -det
                det = det * a[k][k] % modulus
                for i in range(k + 1, width):
                    f = a[i][k] * pow(a[k][k], -1, modulus)
                    a[i] = [(x - f * y) % modulus for x, y in zip(a[i], a[k], strict=True)]
            assert sum(c * t**k for k, c in enumerate(row)) % modulus == det % modulus
    # (t - 2)^2 (t - 5) t
    found = whitening.real_roots([0, -20, 24, -9, 1], 9)
    assert [(float(root), count) for root, count in found] == [(5.0, 1), (2.0, 2), (0.0, 1)]
