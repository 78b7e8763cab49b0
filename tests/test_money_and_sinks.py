"""Payments, refunds, posts, sinks and streams on literals."""

import pytest
from pyspark.sql import functions as F

from pagewise import schemas
from pagewise.operators import classify as C
from pagewise.operators import payments as P
from pagewise.operators import posts as B
from pagewise.operators import refunds as R
from pagewise.sources import sinks as K
from pagewise.sources import tables as S

USER = "0" * 35 + "7"


def notice(id_, status, hour, amount=15.0, metadata=None, reference=None, fees=None, net=None):
    return (
        id_, status, None, amount, "pix", None, reference, metadata, fees, (net,), __import__("datetime").datetime(2024, 1, 1, hour),
    )


def test_payments_apply_once(spark):
    rows = [
        notice("1", "pending", 0, metadata=(USER, "plus", None)),
        notice("1", "approved", 1, metadata=(USER, "plus", None), fees=[("collector", 0.4), ("payer", 9.0)]),
        notice("1", "approved", 2, metadata=(USER, "plus", None), net=14.0),
        notice("1", "refunded", 3, metadata=(USER, "plus", None), fees=[(None, 0.75)]),
        notice("2", "approved", 0, 2.5, reference=f"user_{USER}_pkg_none"),
        notice("3", "approved", 0, 2.5, metadata=(USER, None, "x")),
        notice("4", "approved", 0, 29.6, metadata=(USER, None, None)),
        notice("5", "refunded", 0, metadata=(USER, "pro", None)),
        notice("5", "approved", 1, metadata=(USER, "pro", None)),
    ]
    parsed = P.parse_payments(spark.createDataFrame(rows, schemas.NOTICES))
    done = {r.payment_id: r for r in P.fulfil_payments(parsed).collect()}
    assert set(done) == {"1", "3", "4", "5"}
    first = done["1"]
    assert (first.payment_status, first.credited_mb, first.notices, str(first.fee_brl)) == ("approved", 200, 4, "0.75")
    assert str(first.net_amount_brl) == "14.25" and first.approved_at.hour == 1
    assert done["3"].credits_mb == 20 and done["4"].credits_mb == 500
    assert (done["5"].payment_status, done["5"].credited_mb) == ("refunded", 0)
    assert [r.payment_id for r in P.unmatched_payments(parsed).collect()] == ["2"]


def test_notification_ids(spark):
    bodies = [
        '{"data":{"id":"12"},"id":"9"}', '{"data":{"id":"x"},"id":7}', '{"data.id":"5"}', '{"id":3,"topic":"merchant_order"}', None, '{"data":"z"}',
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i INT, b STRING")
    query = F.when(F.col("i") == 4, F.create_map(F.lit("id"), F.lit(" 44 ")))
    got = [r[0] for r in df.orderBy("i").select(P.notification_id(F.col("b"), query)).collect()]
    assert got == ["12", "7", "5", None, "44", None]


def test_refund_policy(spark):
    tx = spark.createDataFrame(
        [
            (1, 1, "30.00", 500, "visa", "1", "approved", "1.50", "0.00", 0),
            (2, 1, "30.00", 500, "pix", "2", "approved", "1.50", "0.00", 0),
            (3, 1, "30.00", 500, "invoice", "invoice_3", "approved", "0.00", "0.00", 0),
            (4, 1, "30.00", 500, "pix", "4", "pending", "0.00", "30.00", 500),
        ],
        "id INT, user_id INT, amount STRING, credits_mb INT, payment_method STRING, payment_id STRING, payment_status STRING, "
        "fee STRING, back STRING, refunded_credits_mb INT",
    ).select(
        "*", *[F.col(a).cast("decimal(10,2)").alias(b) for a, b in (("amount", "amount_brl"), ("fee", "fee_brl"), ("back", "refunded_amount_brl"))]
    )
    users = spark.createDataFrame([(1, 800, 100)], "id INT, total_credits_mb INT, used_credits_mb INT")
    shown = {r.transaction_id: r for r in R.refund_preview(tx, users).collect()}
    assert [str(shown[i].refund_amount_brl) for i in (1, 2, 3)] == ["28.50", "30.00", "0.00"]
    assert shown[1].can_refund and shown[3].can_refund and not shown[4].can_refund
    assert len(shown[4].block_reasons) == 4
    asked = spark.createDataFrame([(10 + i, i) for i in (1, 2, 3, 4)], "request_id INT, transaction_id INT")
    done = {r.transaction_id: r for r in R.refund_apply(asked, tx, users).collect()}
    assert set(done) == {1, 2}
    assert (done[1].credits_clawed_mb, done[1].payment_status, done[1].user_available_mb) == (500, "refunded", 200)
    assert (done[2].credits_clawed_mb, str(done[2].refund_amount_brl), done[2].payment_status) == (200, "12.00", "partially_refunded")
    assert [r.total_credits_mb for r in R.totals_after_refunds(users, R.refund_apply(asked, tx, users)).collect()] == [100]


def test_publish_state(spark):
    from datetime import datetime

    def edit(n, published, **fields):
        f = {"title": None, "slug": None, **fields}
        return (1, n, datetime(2024, 1, 1, n), f["title"], None, "corpo do post", None, f["slug"], published, "a@b.c")

    rows = [edit(0, True, title=" Olá "), edit(1, False), edit(2, None, title="Novo"), edit(3, True), edit(4, True)]
    schema = (
        "post_id INT, edit_ord INT, ts TIMESTAMP_NTZ, title STRING, excerpt STRING, body_md STRING, cover_url STRING, slug STRING, "
        "published BOOLEAN, author_email STRING"
    )
    row = B.publish_state(spark.createDataFrame(rows, schema)).first()
    assert (row.slug, row.title, row.published, row.published_at.hour, row.updated_at.hour) == ("ola", "Novo", True, 3, 4)


def test_index_formats_and_cache(spark, tmp_path):
    index = spark.createDataFrame([(1, "a")], "n INT, f STRING")
    with pytest.raises(ValueError):
        K.write_index(index, str(tmp_path / "i"), "xlsx")
    K.write_index(index, str(tmp_path / "i"), "CSV")
    assert spark.read.csv(str(tmp_path / "i"), header=True).collect()[0].f == "a"

    pages = spark.createDataFrame([(1, 1, "DARF", None), (1, 2, "darf ", None), (1, 3, "??", None)], schemas.PAGES)
    path = str(tmp_path / "cache")
    assert K.load_cache(spark, path).count() == 0
    K.save_cache(C.classify_distinct(pages), path)
    K.save_cache(C.classify_distinct(pages, cache=K.load_cache(spark, path)), path)
    assert [r.doc_type for r in K.load_cache(spark, path).collect()] == ["darf"]
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not a table")
    assert K.load_cache(spark, str(broken)).count() == 0


def test_documents_are_whole_or_absent(spark, tmp_path):
    pages = spark.createDataFrame([(d, p, f"t{p}", None) for d in (1, 2) for p in (1, 2, 3)], schemas.PAGES).drop("ocr_text")
    named = spark.createDataFrame(
        [(1, 1, "a.pdf", 1, 2), (1, 2, "b.pdf", 3, 3), (2, 1, "c.pdf", 1, 2)], "doc_id BIGINT, group_seq INT, filename STRING, start_page INT, end_page INT"
    )
    K.write_documents(named, pages, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id", "page_number").collect()
    assert [(r.doc_id, r.filename, r.page_number) for r in rows] == [(1, "a.pdf", 1), (1, "a.pdf", 2), (1, "b.pdf", 3)]


def test_ledger_access(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id INT, version INT, state STRING")
    assert {r.id: r.state for r in S.latest_rows(log, "id", "version").collect()} == {1: "b", 2: "c"}
    (tmp_path / "x.pdf").write_bytes(b"12345")
    files = S.uploads_from_files(spark, str(tmp_path)).collect()
    assert [(r.filename, r.length) for r in files] == [("x.pdf", 5)]
