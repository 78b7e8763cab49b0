"""Quality, near duplicates, packing, mixing, pseudonyms, licences and secrets against brute force on small tables."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewise.llm import chosenpath, leaks, licenses, mixing, packing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=120):
    draw = random.Random(seed)
    return " ".join(draw.choice("abcdefghij") + str(draw.randrange(400)) for _ in range(n)).replace("0 ", "0\n", 4)


def odd_rows():
    base = prose(1)
    near = base.split(" ")
    near[40] = "changed"
    rows = [(i, prose(i), "en", "a", 1) for i in range(2, 12)]
    rows += [
        (1, base, "en", "a", 1), (20, base, None, "b", 1), (21, " ".join(near), "en", None, 1), (22, base.upper(), "en", "b", None),
        (30, None, None, None, None), (31, "", "en", "a", 0), (32, " \n\t", "en", "a", 3), (33, "Few words", "en", "a", 9), (34, "few WORDS", "en", "a", 9),
        (40, "w " * 3000, "en", "c", 6000), (41, " ".join(f"long{i}" for i in range(20000)), "en", "c", 1), (42, "### $$$ %%% " * 40, "en", "c", 1),
        (11, prose(11), "en", "a", 1), (None, prose(3), "en", "a", 1), (50, "a\nb\nb\r\n\nb\r\n" * 3, "en", "c", 1),
    ]
    return rows


def measures(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_order_free_verdict(spark, documents):
    docs = documents(odd_rows())
    rows = quality.quality_digest(docs).collect()
    expected = Counter((i, *measures(t)) for i, t, *_ in odd_rows())
    assert Counter(tuple(r)[:6] for r in rows) == expected
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = Counter(r.doc_id for r in rows if r.kept)
    for rules in (quality.RULES, quality.RULES[::-1]):
        assert Counter(r.doc_id for r in quality.keep_good(docs, rules).collect()) == kept
    assert 42 not in kept and 40 not in kept and kept[11] == 2
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_quality_cascade_orders_by_rejections_per_cost(spark, documents):
    docs = documents([(i, "### " * 60, "en", "a", 1) for i in range(30)])
    order = quality.standings(docs)
    assert [s.gain for s in order] == sorted((s.gain for s in order), reverse=True)
    assert order[0].rejected == 1.0


def shingles(text):
    words = WORD.findall((text or "").translate(chosenpath._LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("leaf", [chosenpath.LEAF, 2])
def test_near_duplicates_are_those_of_brute_force(spark, documents, monkeypatch, leaf):
    """With a tiny leaf every group goes through pivots and deep levels."""
    monkeypatch.setattr(chosenpath, "LEAF", leaf)
    rows = odd_rows()
    base = prose(77, 200).split(" ")
    for i in range(25):  # copies of one text, near it but mostly not near each other
        near = list(base)
        for k in random.Random(i).sample(range(len(near)), 2):
            near[k] = f"x{i}"
        rows.append((100 + i, " ".join(near), "en", "a", 1))
    rows.append((99, " ".join(base), "en", "a", 1))
    got = chosenpath.near_duplicates(documents([(*r, "x") for r in rows], ", component string")).collect()
    expected = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_empty_and_stage(spark, documents):
    docs = documents(odd_rows())
    assert chosenpath.near_duplicates(docs.limit(0)).count() == 0
    kept = chosenpath.keep_one(docs)
    assert kept.columns == docs.columns
    assert {20, 21, 22} & {r.doc_id for r in kept.collect()} == set()


@pytest.mark.parametrize("similarity", [0.80, 0.85])
def test_trees_keep_pairs_together_to_the_last_level(similarity):
    trees = chosenpath.trees_for(similarity)
    assert trees <= 20
    draw = np.random.default_rng(5)
    agreed = draw.binomial(chosenpath.SIZE, similarity, 20_000) / chosenpath.SIZE
    met = np.zeros(len(agreed), dtype=bool)
    for _ in range(trees):
        paths = np.ones(len(agreed), dtype=int)
        for _ in range(chosenpath.DEPTH):
            branches = paths + draw.binomial(paths, chosenpath.SECOND_BRANCH)
            paths = draw.binomial(branches, agreed)
        met |= paths > 0
    assert 1 - met.mean() <= 2 * (1 - chosenpath.TARGET_RECALL)


def test_components_of_a_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in chosenpath.components(edges).collect()} == {1}


def test_packing_holds_every_token_once(spark, documents):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows = [r for r in odd_rows() if r[0] is not None] + [(60, "end <|endoftext|> of text", "en", "a", 1)]
    rows = list({r[0]: r for r in rows}.values())
    reference = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {i: np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t, *_ in rows}
    pieces = packing.pack(documents(rows)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(ids[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 1024 - at
    assert padding < 1024
    repeated = packing.pack(documents([(1, "a b c", "en", "a", 1)] * 3)).collect()
    assert len(repeated) == 3 and len({(p.sequence_id, p.offset) for p in repeated}) == 3
    assert packing.pack(documents(odd_rows()).limit(0)).count() == 0


def test_packing_plan_uses_each_rank_once():
    draw = random.Random(3)
    histogram = {n: draw.randrange(0, 40) for n in range(1, 64)}
    plan = packing.Plan(histogram, 64)
    seen = Counter()
    for length, count in histogram.items():
        for rank in range(count):
            for _, size, sequence, offset in plan.place(length, rank):
                seen.update((sequence, offset + k) for k in range(size))
    assert max(seen.values()) == 1 and sum(seen.values()) == sum(n * c for n, c in histogram.items())
    assert plan.sequences > 0 and plan.total * 64 - sum(seen.values()) < 64


def test_mixing_meets_budgets(spark, documents):
    rows = [(i, prose(i, 50 + i % 7), "en", "big" if i % 3 else f"s{i % 4}", 1) for i in range(240)]
    docs = documents([*rows, (900, None, None, None, None), (901, "", "en", "big", 0)])
    mix = mixing.mixture(docs, repeat_limit=1.5)
    budgets = {r.source: r for r in mix.sources.collect()}
    assert abs(sum(r.weight for r in budgets.values()) - 1) < 1e-9
    drawn = mixing.drawn(mix).collect()
    tokens = Counter()
    for r in drawn:
        tokens[r.source] += r.tokens
    longest = 60
    for source, r in budgets.items():
        if r.tokens:
            assert r.budget <= 1.5 * r.tokens + 1 and r.budget - 1 <= tokens[source] < r.budget + longest
    times = Counter(r.row for r in drawn)
    assert len(times) == docs.count() and max(times.values()) <= 2
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_reaches_target_entropy(spark, documents):
    docs = documents([(i, "a b c", "en", "x" if i % 8 else "y", 1) for i in range(400)])
    weights = [r.weight for r in mixing.mixture(docs, repeat_limit=None, target_entropy=0.6).sources.collect()]
    assert abs(-sum(w * np.log(w) for w in weights) - 0.6) < 0.01


def test_permutation_is_one_to_one():
    for size in (2, 7, 100, 1000):
        assert sorted(pii.permuted(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_pseudonyms_keep_format_and_links(spark, documents):
    text = "card 4111 1111 1111 1111, bad 4111111111111112, +1 (443) 555-5793, a.b7@mail.example.com, 10.2.3.4, 999.1.1.1, 2021-02-28, 31.02.2020, 123-45-6789"
    out, n, kinds = pii.replaced(text, b"k")
    assert (n, kinds) == (6, ["card", "date", "email", "ip", "phone", "ssn"])
    assert len(out) == len(text) or "ip" in kinds
    assert "4111111111111112" in out and "999.1.1.1" in out and "31.02.2020" in out
    for gone in ("4111 1111 1111 1111", "555-5793", "a.b7@", "10.2.3.4", "2021-02-28", "123-45-6789"):
        assert gone not in out
    card = re.sub(r"\D", "", re.search(r"card ([\d ]+),", out)[1])
    assert card[0] == "4" and pii.luhn_digit(card[:-1]) == card[-1]
    assert pii.replaced("again 4111 1111 1111 1111", b"k")[0].endswith(re.search(r"card ([\d ]+),", out)[1])
    docs = documents([(1, None, None, None, None), (2, "", "en", "a", 0), (3, text, "en", "a", 1), (3, text, "en", "a", 1)])
    rows = pii.pseudonymised(docs, b"k")
    assert rows.columns == docs.columns
    assert [r.text for r in rows.orderBy("doc_id").collect()] == [None, "", out, out]


def test_pseudonyms_of_values_beside_other_numbers():
    for shown in ("4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "6011000990139424"):
        alone = pii.replaced(shown, b"k")[0]
        assert alone != shown
        for text in ("{} 123", "{} 1234", "{} 12/27", "{} 12 27 123", "12 {}", "12345 {}", "12/27 {}", "AB12 {}", "{} 2021", "1 2 3 {} 4 5 6", "{} {}"):
            out, _, kinds = pii.replaced(text.format(shown, shown), b"k")
            assert out == text.format(alone, alone) and kinds == ["card"], (text, shown, out)
    for text in ("{} 66", "{} 2024", "{} 2024 66", "{} 4111 1111", "{}-7", "{} 1 2 3"):
        out, n, kinds = pii.replaced(text.format("+1 (171) 555-2028"), b"k")
        assert out == text.format(pii.replaced("+1 (171) 555-2028", b"k")[0]) and (n, kinds) == (1, ["phone"])
    for shown in ("GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "DE89 3704 0044 0532 0130 00"):
        alone = pii.replaced(shown, b"k")[0]
        for text in ("{} AND", "{} 12", "{} 123 4567"):
            assert alone != shown and pii.replaced(text.format(shown), b"k")[0] == text.format(alone), (text, shown)
    years = "2019 2020 2021 2022 2023 2024 2025"
    assert pii.replaced(years, b"k")[0] == years
    assert pii.replaced("4111111111111112 123, +999 1, 2021-02-28", b"k")[2] == ["date"]


def test_licence_expressions_and_places(spark, documents):
    assert licenses.postfix("mit or bsd and gpl") == ["mit", "bsd", "gpl", "and", "or"]
    assert licenses.alternatives("(mit or bsd) and gpl with classpath") == [frozenset({"mit", "gpl with classpath"}), frozenset({"bsd", "gpl with classpath"})]
    assert licenses.alternatives("and or") == [] and licenses.alternatives("mit and (") == [frozenset({"mit"})]
    rows = [
        (1, "Under the MIT-License, under the mit license\nCC BY NC", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
        (4, "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "en", "a", 1), (5, "no licence " * 5000, "en", "a", 1), (1, "x", "en", "a", 1),
    ]
    got = {(r.doc_id, r.n_words): r for r in licenses.licence_digest(documents(rows)).collect()}
    assert len(got) == len(rows)
    first = got[(1, 11)]
    assert (first.n_base, first.first_word, first.last_word, first.base_labels, first.score) == (3, 0, 8, "cc-by-nc,mit", 1.0)
    assert got[(2, 0)].first_word is None and got[(2, 0)].labels == ""
    tag = next(r for (i, _), r in got.items() if i == 4)
    assert (tag.base_labels, tag.labels, tag.score) == ("", "apache-2,mit", 1.0)


def test_secret_forest_on_held_out_findings(spark, documents):
    draw = random.Random(8)
    rows, truth = [], {}
    for i in range(120):
        key = "".join(draw.choice("0123456789abcdef") for _ in range(40))
        kind = i % 3
        value = f'token = "{key}"' if kind == 0 else f"example token {key} only" if kind == 1 else "9" * 3 + str(draw.randrange(10**12, 10**13))
        rows.append((i, f"{prose(i, 30)} {value} {prose(i + 500, 10)}", "en", "a", 1))
        truth[i] = kind == 0
    docs = documents([*rows, (900, None, None, None, None), (901, "", None, None, 0)])
    found = leaks.candidates(docs)
    labels = [(r.value, r.before, r.after, int(truth[r.doc_id])) for r in found.collect() if r.doc_id % 2 and r.doc_id < 900]
    labelled = spark.createDataFrame(labels, "value string, before string, after string, secret int")
    judged = [r for r in leaks.scanned(docs, labelled).collect() if r.doc_id % 2 == 0]
    right = sum(r.is_secret == truth[r.doc_id] for r in judged)
    assert len(judged) == 60 and right / len(judged) >= 0.95
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id][r.at : r.at + len(r.value)] == r.value for r in judged)
    assert leaks.secrets_digest(docs.limit(0)).count() == 0


def test_long_texts_take_linear_time(spark, documents):
    """Texts of a million characters built to be slow; each held against what a plain reading gives."""
    began = time.monotonic()
    # Licences: 2^3000 alternatives, nested brackets, a tag that repeats on one line.
    rule = " and ".join(f"(a{i} or b{i})" for i in range(3000))
    tools = licenses.automata()
    found = licenses.scanned(f"SPDX-License-Identifier: {rule}", *tools)
    assert found[5] == ",".join(sorted(f"{c}{i}" for i in range(3000) for c in "ab"))
    assert found[6] == [" & ".join(f"(a{i} | b{i})" for i in range(3000))]
    assert licenses.scanned("license-expression: " + "(" * 400_000 + "mit" + ")" * 400_000, *tools)[5] == "mit"
    assert licenses.scanned("license-expression: ( " * 50_000, *tools)[5] == ""
    # Pseudonyms: one run without an at sign, one with dates in it, one with an address at its end.
    assert pii.replaced("a" * 1_000_000, b"k") == ("a" * 1_000_000, 0, [])
    dates, n, kinds = pii.replaced("a2020-01-01b" * 80_000, b"k")
    assert (n, kinds) == (80_000, ["date"]) and dates == pii.replaced("a2020-01-01b", b"k")[0] * 80_000
    assert pii.replaced("a" * 1_000_000 + "@", b"k")[1] == 0
    # Packing: more white space than the fast encoder takes.
    ids = packing.token_ids(packing.encoder(), " " * 1_000_000 + "a")
    assert ids.tolist() == [*packing.file_ids(packing.TOKENIZER, " " * 1_000_000 + "a"), packing.END_TOKEN]
    # Secrets: 8,000 candidates in one text, each in its place.
    text = " ".join(f"{i:032x}" for i in range(8000))
    rows = leaks.candidates(documents([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, None, None, None, None)])).collect()
    assert sorted((r["at"], r["value"]) for r in rows) == sorted([(33 * i, f"{i:032x}") for i in range(8000)] * 2)
    assert all(r["before"] == text[: r["at"]][-40:] or len(r["before"]) == 1 for r in rows)
    assert time.monotonic() - began < 120


def test_licence_identifiers_are_whole():
    tools = licenses.automata()
    for shown, label in (
        ("mitigated", "mitigated"), ("MIT-0", "mit-0"), ("MIT", "mit"), ("GPL-2.0-or-later", "gpl-2"), ("GPL-3.0+", "gpl-3"), ("CC-BY-NC-4.0", "cc-by-nc"),
        ("CC-BY-4.0", "cc-by"), ("BSD-3-Clause", "bsd"), ("LGPL-2.1-only", "lgpl"), ("ISCX", "iscx"), ("Apache-2.0", "apache-2"),
    ):
        assert licenses.scanned(f"SPDX-License-Identifier: {shown}", *tools)[5] == label


def test_pseudonyms_of_telephones_without_a_country_and_addresses_behind_values():
    plain, with_country = (pii.replaced(shown, b"k")[0] for shown in ("(443) 555-5793", "+1 (443) 555-5793"))
    assert plain != "(443) 555-5793" and with_country == f"+1 {plain}"
    out, n, kinds = pii.replaced("4111 1111 1111 1111x@example.com", b"k")
    assert n == 2 and kinds == ["card", "email"] and out.endswith("@example.com")


@pytest.mark.parametrize("percent", [85])
def test_near_duplicates_of_a_group_without_its_base(spark, percent):
    """Texts that are all about as far from each other: no member is near to all, as in a group whose base is not there."""
    draw, base = random.Random(31), [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        words[draw.randrange(120)] = f"x{i}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    least = list(range(300))
    for a in range(300):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in chosenpath.near_duplicates(docs, percent).collect()}
    assert got == dict(enumerate(least))
    sets = chosenpath.signatures(docs).selectExpr("doc_id as rep", "n_shingles", "minima", "sketch")
    # All pairs would be 44,850 links.
    assert chosenpath.candidates(chosenpath.stored(sets), percent).count() < 20 * len(texts)


def _near_texts(n: int) -> list[str]:
    """Near copies of one text, of which many are alike by less than 0.85."""
    draw, base, texts = random.Random(5), [f"w{i}" for i in range(150)], []
    for _ in range(n):
        words = list(base)
        for k in draw.sample(range(150), draw.randrange(1, 7)):
            words[k] = f"x{draw.randrange(10**9)}"
        texts.append(" ".join(words))
    return texts


def _rows_of_joins_on(spark, name: str, before: int) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for at in range(before, executions.size()):
        number = executions.apply(at).executionId()
        metrics, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and f"[{name}#" in node.desc():
                counts = [m for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows"]
                total += sum(int(metrics.get(m.accumulatorId()).get().replace(",", "")) for m in counts if metrics.contains(m.accumulatorId()))
    return total


def test_trees_over_a_dense_group_join_few_rows_a_set(spark):
    """Minima are fetched for every other level, and what a join makes is not made again to count its nodes."""
    docs = spark.createDataFrame(list(enumerate(_near_texts(800))), "doc_id long, text string")
    sets = chosenpath.stored(chosenpath.signatures(docs).selectExpr("doc_id as rep", "n_shingles", "minima", "sketch"))
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    chosenpath.candidates(sets, 85).count()
    assert 0 < _rows_of_joins_on(spark, "rep", before) < 60 * 800


def test_rows_that_confirm_a_class_do_not_grow_with_its_square(spark, monkeypatch):
    rows, in_cells = [], chosenpath._in_cells
    monkeypatch.setattr(chosenpath, "BLOCK", 8)
    monkeypatch.setattr(chosenpath, "PATCH", 20)
    monkeypatch.setattr(chosenpath, "_in_cells", lambda cells, percent: rows.append(cells.count()) or in_cells(cells, percent))
    counts = []
    for n in (150, 600):
        texts = _near_texts(n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sets = chosenpath.stored(chosenpath.signatures(docs).selectExpr("doc_id as rep", "n_shingles", "minima", "sketch"))
        clusters = sets.selectExpr("rep", "0L as cluster")
        rows.clear()
        got = {(r["vertex"], r["component"]) for r in chosenpath.components(chosenpath.confirmed(clusters, sets, docs, 85)).collect()}
        counts.append(sum(rows))
        shingles = [{tuple(t.split()[k : k + 5]) for k in range(146)} for t in texts]
        least = list(range(n))
        for a in range(n):
            for b in range(a):
                both = len(shingles[a] & shingles[b])
                if 100 * both >= 85 * (len(shingles[a]) + len(shingles[b]) - both) and least[a] != least[b]:
                    low, high = sorted((least[a], least[b]))
                    least = [low if x == high else x for x in least]
        assert got == {(a, c) for a, c in enumerate(least) if least.count(c) > 1}
    assert counts[1] < 10 * counts[0], counts


def test_trees_over_a_dense_group_end_early(spark, monkeypatch):
    """Rows at even levels: 32 a member, and all levels asked for, where only nodes of 32 sets are compared whole."""
    rows, below = [], chosenpath._grandchildren
    monkeypatch.setattr(chosenpath, "_grandchildren", lambda nodes: rows.append((made := below(nodes)).count()) or made)
    docs = spark.createDataFrame(list(enumerate(_near_texts(1500))), "doc_id long, text string")
    sets = chosenpath.stored(chosenpath.signatures(docs).selectExpr("doc_id as rep", "n_shingles", "minima", "sketch"))
    assert chosenpath.candidates(sets, 80).count() >= 1499
    assert len(rows) < 4 and sum(rows) < 15 * 1500, rows
