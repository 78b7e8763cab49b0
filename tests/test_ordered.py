"""Order-dependent helpers and budgets against plain Python, with blocks small enough to be crossed."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagewise.operators import ledger as L
from pagewise.operators import ordered
from pagewise.operators.budget import spend_in_order
from pagewise.operators.ordered import block_of, position_in_key, running_total


def test_running_total_crosses_blocks(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randint(0, 9)) for i in range(0, 900, rng.choice([1, 1]))]
    rows += [(f"k{i % 40}", i, rng.randint(0, 9)) for i in range(400)]
    rows = [r for r in rows if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "k STRING, p INT, v INT")
    got = {(r.k, r.p): r.before for r in running_total(df, ["k"], ["p"], F.col("v"), "before", block_of(F.col("p"), 4)).collect()}
    sums, expected = {}, {}
    for k, p, v in sorted(rows):
        expected[k, p] = sums.get(k, 0)
        sums[k] = expected[k, p] + v
    assert got == expected
    ranks = position_in_key(df, ["k"], "p", "n", block_of(F.col("p"), 3)).filter("k = 'hot'").orderBy("p").collect()
    assert [r.n for r in ranks] == list(range(1, len(ranks) + 1))


@pytest.mark.parametrize("shape", ["credits", "refunds"])
def test_budget_rounds_match_the_walk(spark, shape):
    rng = random.Random(11)
    rows, expected = [], {}
    for user, budget in ((1, 700), (2, 63), (3, 0), (4, -5), (5, 100_000), (6, 1), (7, 40)):
        left = budget
        for i in range(rng.choice([60, 90]) if user != 7 else 4):
            if shape == "credits":
                cents = rng.choice([rng.randint(1, 300), rng.randint(1, 9_000)])
                need, charge = -(-cents // 100), (cents + 50) // 100
            else:
                charge = rng.choice([1, 7, 64, rng.randint(1, 500)])
                need = rng.randint(1, charge)
            ok = left >= need
            taken = min(charge, left) if ok else 0
            expected[user, i] = (left, ok, taken)
            left -= taken
            rows.append((user, i, budget, need, charge))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "u INT, i INT, budget INT, need INT, charge INT")
    for fold_rows, range_rows in ((1000, 1000), (10, 25)):
        spent = spend_in_order(df, "u", ["i"], fold_rows, range_rows).collect()
        assert {(r.u, r.i): (r.balance_before, r.accepted, r.charged) for r in spent} == expected


def test_admission_replay_matches_the_log(spark):
    rng = random.Random(5)
    start = datetime(2024, 5, 1)
    people = [(u, "admin" if u == 0 else "user", f"u{u}@x.y") for u in range(12)]
    balances = {u: rng.choice([-3, 0, 0, 4, 9]) for u in range(12)}
    jobs = []
    for i in range(400):
        ip = rng.choice(["10.1.1.1", "unknown"] + [f"200.0.0.{n}" for n in range(6)])
        jobs.append((i, rng.randrange(12), start + timedelta(minutes=rng.randrange(3 * 1440)), rng.choice([0.4, 1.0, 1.5, 2.0, 3.25]), rng.choice([1, 10, 11]), ip))
    expected, left, used = {}, dict(balances), set()
    for i, user, ts, size, pages, ip in sorted(jobs, key=lambda j: (j[2], j[0])):
        address = None if ip in ("10.1.1.1", "unknown") else ip
        day = ts.date()
        if user == 0:
            mode = "admin"
        elif left[user] >= size:
            mode = "credits"
            left[user] -= int(size + 0.5)
        elif ("u", user, day) in used:
            mode = "user_daily_limit"
        elif address and ("a", address, day) in used:
            mode = "ip_daily_limit"
        elif size > 2:
            mode = "file_too_large"
        elif pages > 10:
            mode = "too_many_pages"
        else:
            mode = "free"
            used |= {("u", user, day), ("a", address, day)}
        expected[i] = mode
    df = spark.createDataFrame(jobs, "id INT, user_id INT, created_at TIMESTAMP_NTZ, file_size_mb DOUBLE, pages_count INT, ip_address STRING")
    df = df.withColumn("file_size_mb", F.col("file_size_mb").cast("decimal(10,2)"))
    users = spark.createDataFrame(people, "id INT, role STRING, email STRING")
    held = spark.createDataFrame(list(balances.items()), "user_id INT, available_mb INT")
    got = {r.id: r.mode for r in L.admission_replay(df, users, held).collect()}
    assert got == expected
    assert "free" in got.values() and "ip_daily_limit" in got.values()


def test_scan_takes_items_piece_by_piece(spark):
    from pagewise.operators.ordered import scan

    rows = [(n, list(range(n))) for n in (1, 2, 3, 4, 5, 9, 130)]
    frame = spark.createDataFrame(rows, "n int, items array<int>")
    for piece in (1, 4, 64):
        got = frame.select("n", scan(F.col("items"), F.lit(7), lambda total, item: total + item, piece).alias("trail")).collect()
        assert {r.n: r.trail for r in got} == {n: [7 + sum(range(k)) for k in range(n + 1)] for n, _ in rows}


def test_short_keys_carry_nothing_between_blocks(spark):
    """Where no key reaches a second block, stored rows are read once: no table of block ends or totals is joined."""
    rows = [(d, p, "nfe" if p % 3 else "recibo_pagador") for d in range(6) for p in range(1, 9)]
    pages = ordered.cut_lineage(spark.createDataFrame(rows, "doc_id long, page_number int, doc_type string"))
    assert ordered.in_first_block(pages, F.col("page_number") - 1)
    assert not ordered.in_first_block(pages, F.col("page_number") - 1, 2)

    def near(bits):
        return ordered.with_neighbours(pages, previous=("doc_type",), following=("page_number",), bits=bits, held=True)

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join")

    assert joins(near(12)) == 0 < joins(near(2))
    assert sorted(near(12).collect()) == sorted(near(2).collect())
    ranked = [ordered.position_in_key(pages, ["doc_id", "doc_type"], "page_number", "at", short=short) for short in (True, False)]
    assert joins(ranked[0]) == 0 < joins(ranked[1])
    assert sorted(ranked[0].collect()) == sorted(ranked[1].collect())
