"""Daily limits replayed against a plain walk, chains of waiting jobs, coverage of ranges and rule tables."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from pagewise.functions import values as V
from pagewise.operators import classify, grouping, ledger
from pagewise.session import cut_lineage

DAY = dt.datetime(2024, 1, 1)


def walked(rows, limit):
    """Ids accepted when each key has ``limit`` uses a day; rows are (id, user, ip, time)."""
    used, kept = Counter(), set()
    for key, user, ip, at in sorted(rows, key=lambda r: (r[3], r[0])):
        names = [("user", user, at.date())] + ([("ip", ip, at.date())] if ip else [])
        if all(used[name] < limit for name in names):
            used.update(names)
            kept.add(key)
    return kept


def candidates(spark, rows):
    frame = spark.createDataFrame(rows, "id long, user_id long, ip string, created_at timestamp_ntz")
    return frame.selectExpr("id", "user_id", "ip", "date(created_at) as day", "struct(created_at, id) as turn")


def drawn(seed, count, users, addresses):
    draw = random.Random(seed)
    return [
        (i, draw.randrange(users), draw.choice([None] + [f"200.1.1.{k}" for k in range(addresses)]), DAY + dt.timedelta(hours=draw.randrange(60)))
        for i in range(count)
    ]


@pytest.mark.parametrize("seed, users, addresses", [(1, 40, 40), (2, 5, 200), (3, 300, 4)])
def test_free_winners_equal_a_walk(spark, seed, users, addresses):
    rows = drawn(seed, 300, users, addresses)
    assert {r.id for r in ledger._free_winners(candidates(spark, rows)).collect()} == walked(rows, 1)


def test_chain_of_jobs_is_settled_by_doubling(spark, monkeypatch):
    """Each job shares its user with the job before it and its address with the one after, or the other way."""
    rows = [(i, (i + 1) // 2, f"200.1.1.{i // 2}", DAY + dt.timedelta(seconds=i)) for i in range(2048)]
    calls = []
    cut = ledger.cut_lineage
    monkeypatch.setattr(ledger, "cut_lineage", lambda df: calls.append(1) or cut(df))
    assert {r.id for r in ledger._free_winners(candidates(spark, rows)).collect()} == walked(rows, 1) == set(range(0, 2048, 2))
    assert len(calls) <= 20


@pytest.mark.parametrize("seed, users, addresses", [(4, 30, 30), (5, 3, 100), (6, 200, 3)])
def test_tool_uses_equal_a_walk(spark, seed, users, addresses):
    rows = drawn(seed, 250, users, addresses)
    uses = spark.createDataFrame(rows, "id long, user_id long, ip_address string, created_at timestamp_ntz")
    people = spark.createDataFrame([(u, "admin" if u == 0 else "user", f"u{u}@x.y") for u in range(users - 1)], "id long, role string, email string")
    balances = spark.createDataFrame([(u, 5 if u == 1 else 0) for u in range(users - 1)], "user_id long, available_mb long")
    got = {r.id: r.mode for r in ledger.tool_replay(uses, people, balances).collect()}
    free = [r for r in rows if r[1] > 1]
    kept = walked(free, V.TOOL_LIMIT_DAY)
    assert got == {r[0]: "unlimited" if r[1] < 2 else "accepted" if r[0] in kept else "refused" for r in rows}


def test_tool_uses_without_user_are_bound_by_the_address(spark):
    rows = [(i, None, "200.1.1.1" if i < 4 else None, DAY) for i in range(6)]
    uses = spark.createDataFrame(rows, "id long, user_id long, ip_address string, created_at timestamp_ntz")
    people = spark.createDataFrame([], "id long, role string, email string")
    balances = spark.createDataFrame([], "user_id long, available_mb long")
    got = {r.id: r.mode for r in ledger.tool_replay(uses, people, balances).collect()}
    assert [i for i in range(6) if got[i] == "accepted"] == [0, 1, 4, 5]


def test_coverage_equals_counting_pages(spark):
    draw = random.Random(9)
    groups, totals = [], [(d, draw.choice([0, 1, 5, 9000])) for d in range(30)]
    for doc in list(range(0, 26)) + [40]:
        for _ in range(draw.randrange(4)):
            low = draw.choice([1, 2, 4, 4096, 4097])
            groups.append((doc, low, low + draw.choice([-1, 0, 1, 3, 5000])))
    expected = set()
    spans = defaultdict(Counter)
    for doc, low, high in groups:
        spans[doc].update(range(low, high + 1))
        if low > high:
            expected.add((doc, "inverted", low))
    grouped = {g[0] for g in groups}
    size = dict(totals)
    for doc in grouped | set(size):
        if doc not in grouped:
            expected.add((doc, "no_groups", None))
            continue
        for page in set(spans[doc]) | set(range(1, size.get(doc, 0) + 1)):
            count, asked = spans[doc][page], page <= size.get(doc, 0)
            if count == 0 or count > 1 or not asked:
                expected.add((doc, "missing" if count == 0 else "overlap" if count > 1 else "extra", page))
    found = grouping.coverage_check(
        spark.createDataFrame(groups, "doc_id long, start_page int, end_page int"), spark.createDataFrame(totals, "doc_id long, total_pages int")
    )
    assert Counter(map(tuple, found.collect())) == Counter(expected)


def test_rule_table_gives_the_matches_of_the_dictionary(spark):
    rules = (
        V.Rule("a", ("Fatura de Água", "x"), None, 0.9),
        V.Rule("b", ("agua", "fat", "fatura de agua"), None, 0.9),
        V.Rule("c", ("q z",), None, 0.5),
    )
    texts = ["FATURA  de água 12", "xis", "agua", "", None, "q  Z fat", "nada", "fatura de agua " * 3000]
    pages = spark.createDataFrame([(i, 1, t, None) for i, t in enumerate(texts)], "doc_id long, page_number int, native_text string, ocr_text string")
    table = classify.rules_table(spark, rules)
    indexed = classify.indexed_matches(pages, table)
    plain = classify.rule_matches(pages, rules)
    assert Counter(map(tuple, indexed.collect())) == Counter(map(tuple, plain.select(indexed.columns).collect()))
    won = {r.doc_id: (r.doc_type, r.pattern) for r in classify.strongest_match(indexed).collect()}
    chosen = {r.doc_id: (r.doc_type, r.matched_pattern) for r in classify.apply_rules(pages, rules).collect()}
    assert won == chosen
    assert classify.indexed_matches(pages, table.limit(0)).count() == 0


def test_rule_table_takes_page_grams_once_and_drops_what_no_pattern_has(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(classify, "cut_lineage", lambda df: cuts.append(cut_lineage(df)) or cuts[-1])
    texts = ["abcd cdef efgh fghi", "xx abcdefghi yy", "abcdefghi " * 500]
    pages = spark.createDataFrame([(i, 1, t, None) for i, t in enumerate(texts)], "doc_id long, page_number int, native_text string, ocr_text string")
    table = classify.rules_table(spark, (V.Rule("a", ("abcdefghi",), None, 0.9),))
    assert {r.doc_id for r in classify.indexed_matches(pages, table).collect()} == {1, 2}
    # Page 0 shares grams of three and four characters with the pattern; a gram counts once a page.
    assert len(cuts) == 2 and sorted(r.doc_id for r in cuts[1].collect()) == [1] * 4 + [2] * 4
