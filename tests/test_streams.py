"""Streams over several batches and restarts give what the batch forms give."""

import datetime as dt

from pagewise import schemas
from pagewise.operators import payments as P
from pagewise.streaming import jobs as ST

USER = "0" * 35 + "7"


def notice(id_, status, hour, net=None):
    return (id_, status, None, 15.0, "pix", None, None, (USER, "plus", None), None, (net,), dt.datetime(2024, 1, 1, hour))


def test_repeated_notice_in_a_later_batch_pays_once(spark, tmp_path):
    source, folder = f"{tmp_path}/source", f"file://{tmp_path}/stream"
    batches = [
        [notice("1", "pending", 0), notice("2", "approved", 0)],
        [notice("1", "approved", 1), notice("2", "approved", 0)],
        [notice("1", "approved", 1), notice("1", "approved", 5, 14.0), notice("3", "refunded", 2)],
        [notice("3", "approved", 3)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schemas.NOTICES).coalesce(1).write.mode("append").parquet(source)
        # Each turn starts the stream anew over its kept progress.
        notices = spark.readStream.schema(schemas.NOTICES).parquet(source)
        got = ST.upserted(ST.stream_fulfil(notices), ["payment_id"], folder)
        whole = P.fulfil_payments(P.parse_payments(spark.read.schema(schemas.NOTICES).parquet(source)))
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(got.columns).collect()))
    assert {r.payment_id: r.credited_mb for r in got.collect()} == {"1": 200, "2": 200, "3": 0}


def test_watermark_closes_days(spark, tmp_path):
    source, folder = f"{tmp_path}/source", f"file://{tmp_path}/stream"
    shape = "event_id long, ts timestamp_ntz, user_id string, email string, ip_address string, kind string"

    def event(id_, day, hour=12):
        return (id_, dt.datetime(2024, 3, day, hour), "u", "u@x", "200.1.2.3", "free")

    for rows in ([event(1, 1), event(2, 1, 13)], [event(3, 10)], [event(4, 12)], [event(5, 1), event(6, 12, 1)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        got = ST.upserted(ST.stream_ip_usage(spark.readStream.schema(shape).parquet(source)), ["ip", "usage_date"], folder)
    counts = {r.usage_date.day: r.free_process_count for r in got.collect()}
    assert counts == {1: 2, 10: 1, 12: 2}  # event 5 came after its day was closed
