"""Page numbers with gaps, repeated refund requests, refused merges, tied notices and unknown users."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagewise.operators import ledger, manifest, payments
from pagewise.operators.ordered import with_neighbours


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_neighbours_do_not_depend_on_block_size(spark, bits):
    draw = random.Random(5)
    rows = [(doc, page, f"{doc}-{page}") for doc in range(4) for page in draw.sample(range(1, 60), 25)]
    frame = spark.createDataFrame(rows, "doc_id long, page_number int, word string")
    got = {
        (r.doc_id, r.page_number): (r.prev_word, r.next_word)
        for r in with_neighbours(frame, previous=("word",), following=("word",), bits=bits).collect()
    }
    assert len(got) == len(rows)
    for doc in range(4):
        words = [w for d, _, w in sorted(rows) if d == doc]
        pages = [p for d, p, _ in sorted(rows) if d == doc]
        for i, page in enumerate(pages):
            before = words[i - 1] if i else None
            after = words[i + 1] if i + 1 < len(words) else None
            assert got[(doc, page)] == (before, after)


def test_merge_with_missing_file_is_refused(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, page_number int")
    asked = [(1, 1, 1), (1, 1, 2), (2, 1, 1), (2, 2, 9), (3, 1, 2)]
    requests = spark.createDataFrame(asked, "merge_id long, file_ord int, doc_id long")
    errors = {r.merge_id: r.error for r in manifest.merge_errors(pages, requests).collect()}
    assert errors == {2: "missing_file", 3: "too_few_files"}
    merged = manifest.merge_docs(pages, requests).orderBy("new_page").collect()
    assert [(r.merge_id, r.doc_id, r.new_page) for r in merged] == [(1, 1, 1), (1, 1, 2), (1, 2, 3)]


def test_refused_deletions_and_orders_are_named(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2)], "doc_id long, page_number int")
    asked = [(1, 1), (1, 1), (2, 1), (3, 3), (3, 1), (4, None), (9, 1)]
    deletions = spark.createDataFrame(asked, "doc_id long, page_number int")
    errors = {r.doc_id: r.error for r in manifest.delete_errors(pages, deletions).collect()}
    assert errors == {2: "no_page_left", 3: "page_outside", 4: "page_outside", 9: "missing_file"}
    assert [tuple(r) for r in manifest.delete_pages(pages, deletions).collect()] == [(1, 2, 1)]
    orders = [(1, [2, 1]), (2, [1]), (2, [1]), (3, [1]), (4, None), (9, [1])]
    reorders = spark.createDataFrame(orders, "doc_id long, page_order array<int>")
    errors = {r.doc_id: r.error for r in manifest.reorder_errors(pages, reorders).collect()}
    assert errors == {2: "several_orders", 3: "no_permutation", 4: "no_permutation", 9: "missing_file"}
    assert sorted(map(tuple, manifest.reorder_pages(pages, reorders).collect())) == [(1, 1, 2), (1, 2, 1)]


def test_tied_notices_give_one_answer_in_any_order(spark):
    at = dt.datetime(2024, 1, 1)
    base = dict(package_id="p", fee_brl=1, net_amount_brl=2, payment_method="pix", ts=at)
    rows = [
        dict(base, payment_id="a", status="approved", user_id="1", credits_mb=10, amount_brl=3),
        dict(base, payment_id="a", status="rejected", user_id="1", credits_mb=99, amount_brl=4),
    ]
    schema = (
        "payment_id string, status string, user_id string, package_id string, credits_mb int, amount_brl int, fee_brl int, "
        "net_amount_brl int, payment_method string, ts timestamp"
    )
    names = [field.split()[0] for field in schema.split(", ")]
    answers = [
        payments.fulfil_payments(spark.createDataFrame([tuple(r[n] for n in names) for r in order], schema).coalesce(1)).collect()
        for order in (rows, rows[::-1])
    ]
    assert answers[0] == answers[1]
    assert (answers[0][0].payment_status, answers[0][0].credits_mb) == ("approved", 10)


def test_jobs_of_users_without_balance_are_answered(spark):
    jobs = spark.createDataFrame(
        [(1, 1, dt.datetime(2024, 1, 1), 2.0), (2, 7, dt.datetime(2024, 1, 1), 2.0)], "id long, user_id long, created_at timestamp, size double"
    ).select("id", "user_id", "created_at", F.col("size").cast("decimal(10,2)").alias("file_size_mb"))
    balances = spark.createDataFrame([(1, 5)], "user_id long, available_mb int")
    got = {r.id: (r.accepted, r.charged_mb) for r in ledger.consume_credits(jobs, balances).collect()}
    assert got[1] == (True, 2) and got[2][0] is False


def test_second_refund_of_a_payment_is_refused(spark):
    import __spark_entry__ as entry
    from pagewise.operators import refunds
    from pagewise.sources import tables

    folder = "/root/testdata/sf0.001"
    asked = tables.refund_requests(spark, folder)
    twice = asked.union(asked.withColumn("request_id", F.col("request_id") + 10**9))
    rest = (tables.transactions(spark, folder), tables.users(spark, folder), tables.provider_payments(spark, folder))
    done = refunds.refund_apply(twice, *rest)
    assert sorted(map(tuple, done.collect()), key=str) == sorted(map(tuple, entry.queries()["refund_apply"](spark, folder).collect()), key=str)
    refused = refunds.refund_refusals(twice, *rest)
    assert done.count() + refused.count() == twice.count()
    assert refused.filter("size(block_reasons) = 0").count() == 0
