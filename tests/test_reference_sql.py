"""Named queries against their reference SQL on the smallest tables, as the correctness gate does."""

import decimal
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
CHECKED = (
    "normalize_text classify_pages fallback_merge classify_distinct group_pages coverage_check index_report document_sink "
    "merge_docs page_request_errors delete_pages reorder_pages split_ranges pick_line user_dashboard paid_accounts invoiced_accounts finance_summary consume_credits "
    "admission admission_replay tool_replay rule_table_matches rule_table_winners fulfil_payments refund_preview refund_apply refund_refusals publish_state constraint_checks stream_ip_usage"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if isinstance(value, decimal.Decimal) else value


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_reference_sql():
    assert set(entry.named_queries()) == set(entry.reference_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, engine, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    result = engine.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    assert ours == theirs
