"""Declared table schemas. Nothing is inferred; timestamps are zone-free and mean UTC."""

from __future__ import annotations

PAGES = "doc_id BIGINT, page_number INT, native_text STRING, ocr_text STRING"
CLASSIFIED = (
    "doc_id BIGINT, page_number INT, doc_type STRING, supplier STRING, confidence DOUBLE, source STRING, "
    "matched_pattern STRING, is_continuation BOOLEAN, cnpj STRING"
)
GROUPS = (
    "doc_id BIGINT, group_seq INT, doc_type STRING, supplier STRING, start_page INT, end_page INT, "
    "needs_review BOOLEAN"
)
RULES = (
    "rule_ord INT, doc_type STRING, patterns ARRAY<STRING>, supplier_pattern STRING, confidence DOUBLE, "
    "is_regex BOOLEAN"
)
RESPONSES = "doc_id BIGINT, page_number INT, body STRING"
USERS = (
    "id BIGINT, email STRING, role STRING, display_name STRING, total_credits_mb INT, used_credits_mb INT, "
    "free_uses_today INT, last_free_use TIMESTAMP_NTZ, pdf_tools_uses_today INT, "
    "pdf_tools_last_use TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"
)
TRANSACTIONS = (
    "id BIGINT, user_id BIGINT, amount_brl DECIMAL(10,2), credits_mb INT, payment_method STRING, "
    "payment_id STRING, payment_status STRING, created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, "
    "fee_brl DECIMAL(10,2), net_amount_brl DECIMAL(10,2), refunded_amount_brl DECIMAL(10,2), "
    "refunded_credits_mb INT, payment_metadata STRING"
)
JOBS = (
    "id BIGINT, user_id BIGINT, filename STRING, file_size_mb DECIMAL(10,2), pages_count INT, "
    "documents_count INT, status STRING, error_message STRING, created_at TIMESTAMP_NTZ, "
    "completed_at TIMESTAMP_NTZ, ip_address STRING"
)
NOTICES = (
    "id STRING, status STRING, status_detail STRING, transaction_amount DOUBLE, payment_method_id STRING, "
    "payment_type_id STRING, external_reference STRING, "
    "metadata STRUCT<user_id: STRING, package_id: STRING, credits_mb: STRING>, "
    "fee_details ARRAY<STRUCT<fee_payer: STRING, amount: DOUBLE>>, "
    "transaction_details STRUCT<net_received_amount: DOUBLE>, ts TIMESTAMP_NTZ"
)
RESPONSE_BODY = (
    "doc_type STRING, supplier STRING, confidence STRING, is_continuation STRING, reasoning STRING"
)
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
ORDERS = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
)
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
