"""Readers, and adapters that give general tables the shapes the operators take.

The adapters are projections: they add no shuffle, and every column a query does not use is pruned down
to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.functions import text as T
from pagewise.functions.values import Rule

CENT = "decimal(10,2)"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on a table stored as fewer splits than there are cores. Large tables pass as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def pages_from_text(documents: DataFrame) -> DataFrame:
    """Page rows from documents held as one text each: every line is a page."""
    return documents.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line")
    ).select(
        "doc_id",
        (F.col("position") + 1).alias("page_number"),
        T.clean_page_text(F.col("line")).alias("native_text"),
    )


def empty_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents without a page, which a corpus must not hold."""
    return documents.select("doc_id").join(pages.select("doc_id").distinct(), "doc_id", "left_anti")


def uploads_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Upload manifest of a folder. Path and length only, so no file content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "length"
    )


def ledger_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A ledger table with its declared schema."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def jdbc_table(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A ledger table in a database, read in ``parts`` ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


# ---- adapters over the general tables ----

# Types chosen so that every grouping branch sees data; patterns occur in the sample prose.
SAMPLE_RULES: tuple[Rule, ...] = (
    Rule("darf", ("released under",), None, 0.95),
    Rule("pix_comprovante", ("token =",), None, 0.95),
    Rule("conta_energia", ("eaux",), r"([a-z]{3,}eaux)", 0.95),
    Rule("nfe", ("cion",), r"([a-z]+cion[a-z]*)", 0.95),
    Rule("viasat_fatura", ("blees",), None, 0.95),
    Rule("boleto_outros_bancos", ("und",), r"(und(?: [a-z]+)?)", 0.9),
    Rule("imposto_municipal", ("sch",), r"([a-z]*sch[a-z]*(?: [a-z]+)?)", 0.92),
    Rule("comprovante_pagamento", ("tion",), r"([a-z]*tion)(?: |\.|,|$)", 0.8),
    Rule("recibo_pagador", ("blest",), None, 0.9),
    Rule("cupom_fiscal", ("the",), None, 0.6),
)


def at(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _cents(value: Column) -> Column:
    """A whole number of cents as money."""
    return (F.floor(value).cast("decimal(16,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(CENT)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of ``documents``; every third weak page carries OCR text."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    pages = pages_from_text(spread(documents, "doc_id"))
    scanned = T.needs_ocr(F.col("native_text")) & (F.col("page_number") % 3 == 0)
    return pages.withColumn("ocr_text", F.when(scanned, F.concat(F.lit("verso "), "native_text")))


def users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    total = F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("int")
    used = F.when(key % 97 == 5, total + 1).otherwise(F.floor(total * (key % 11) / 10).cast("int"))
    return read_table(spark, folder, "customer").select(
        key.alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(key % 100 == 0, "admin").otherwise("user").alias("role"),
        F.col("c_name").alias("display_name"),
        total.alias("total_credits_mb"),
        used.alias("used_credits_mb"),
        (key % 3).cast("int").alias("free_uses_today"),
        F.when(key % 5 != 4, F.timestamp_add("DAY", -(key % 4).cast("int"), at("2024-01-30 08:00:00"))).alias("last_free_use"),
        (key % 4).cast("int").alias("pdf_tools_uses_today"),
        F.when(key % 7 != 6, F.timestamp_add("DAY", -(key % 3).cast("int"), at("2024-01-30 09:00:00"))).alias("pdf_tools_last_use"),
        F.timestamp_add("MINUTE", (key * 37).cast("int"), at("2023-01-01 00:00:00")).alias("created_at"),
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    key, price, priority = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    amount = _cents(price / 10)
    credits = F.floor(price / 100).cast("int")
    fee = _cents((key % 7) * 13)
    invoice = priority == "5-LOW"
    status = (
        F.when((F.col("o_orderstatus") == "F") & (key % 10 == 3), "refunded")
        .when(F.col("o_orderstatus") == "F", "approved")
        .when(F.col("o_orderstatus") == "P", "partially_refunded")
        .otherwise("pending")
    )
    created = F.timestamp_add("MINUTE", (key % 1440).cast("int"), F.col("o_orderdate"))
    package = F.element_at(F.array(*[F.lit(p) for p in ("basic", "plus", "pro", "premium")]), (key % 4 + 1).cast("int"))
    note = F.when(key % 3 != 0, F.concat(F.lit(',"note":"note '), key.cast("string"), F.lit('"'))).otherwise("")
    metadata = F.when(
        invoice, F.concat(F.lit('{"source":"admin_manual"'), note, F.lit("}"))
    ).otherwise(F.concat(F.lit('{"package_id":"'), package, F.lit('","source":"mercadopago_fulfillment"}')))
    rows = spread(read_table(spark, folder, "orders"), "o_orderkey").select(
        key.alias("id"),
        F.col("o_custkey").alias("user_id"),
        amount.alias("amount_brl"),
        credits.alias("credits_mb"),
        F.when(priority == "1-URGENT", "credit_card")
        .when(priority == "2-HIGH", "pix")
        .when(priority == "3-MEDIUM", "ticket")
        .when(priority == "4-NOT SPECIFIED", "visa")
        .otherwise("invoice")
        .alias("payment_method"),
        F.when(invoice, F.concat(F.lit("invoice_"), key.cast("string"))).otherwise(key.cast("string")).alias("payment_id"),
        status.alias("payment_status"),
        created.alias("created_at"),
        F.when(key % 50 != 0, F.timestamp_add("DAY", F.lit(90), created)).alias("expires_at"),
        fee.alias("fee_brl"),
        metadata.alias("payment_metadata"),
    )
    state = F.col("payment_status")
    none = F.lit(0).cast(CENT)
    return rows.withColumns(
        {
            "net_amount_brl": F.when(F.col("id") % 4 != 0, F.greatest(F.col("amount_brl") - F.col("fee_brl"), none)).cast(CENT),
            "refunded_amount_brl": F.when(state == "refunded", F.col("amount_brl"))
            .when(state == "partially_refunded", _cents(F.col("amount_brl").cast("double") * 25))
            .otherwise(none)
            .cast(CENT),
            "refunded_credits_mb": F.when(state == "refunded", F.col("credits_mb"))
            .when(state == "partially_refunded", F.floor(F.col("credits_mb") / 4).cast("int"))
            .otherwise(0),
        }
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "click", "processing").otherwise("completed")
    network = F.when(key % 17 == 0, "10.0.0.").otherwise("200.10.0.")
    pages = (1 + key % 25).cast("int")
    return read_table(spark, folder, "events").select(
        key.alias("id"),
        "user_id",
        F.concat(F.lit("f"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        _cents(F.greatest(F.col("value"), F.lit(1.0))).alias("file_size_mb"),
        pages.alias("pages_count"),
        F.when(status == "completed", F.floor(pages / 3).cast("int")).alias("documents_count"),
        status.alias("status"),
        F.when(status == "failed", F.concat(F.lit("falha "), "props")).alias("error_message"),
        F.col("ts").alias("created_at"),
        F.when(status == "completed", F.timestamp_add("SECOND", F.lit(30), F.col("ts"))).alias("completed_at"),
        F.concat(network, (F.col("user_id") % 50).cast("string")).alias("ip_address"),
    )


def usage_from_events(events: DataFrame) -> DataFrame:
    """Usage events for the per-address counters, from a batch or a stream."""
    key = F.col("event_id")
    network = F.when(key % 17 == 0, "10.0.0.").otherwise("200.10.0.")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(network, (F.col("user_id") % 50).cast("string")).alias("ip_address"),
        F.when(F.col("event_type").isin("signup", "purchase"), "tool").otherwise("free").alias("kind"),
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return usage_from_events(read_table(spark, folder, "events"))


def job_events_from(events: DataFrame) -> DataFrame:
    """Three events in four start a job, the fourth kind of event ends one: job ``event_id div 2``."""
    key = F.col("event_id")
    ended = key % 2 == 1
    return events.select(
        F.floor(key / 2).cast("bigint").alias("job_id"),
        "ts",
        F.when(ended & (F.col("event_type") == "error"), "failed").when(ended, "completed").otherwise("processing").alias("status"),
        F.when(ended & (F.col("event_type") != "error"), (key % 9).cast("int")).alias("documents_count"),
        F.when(ended & (F.col("event_type") == "error"), F.concat(F.lit("falha "), "props")).alias("error_message"),
    )


def grants(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return (
        read_table(spark, folder, "orders")
        .filter(F.col("o_orderpriority") == "5-LOW")
        .select(
            key.alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.when(key % 6 != 0, (F.floor(F.col("o_custkey") / 100) * 100).cast("bigint")).alias("granted_by"),
            F.floor(F.col("o_totalprice") / 100).cast("int").alias("credits_mb"),
            _cents(F.col("o_totalprice") / 10).alias("amount_brl"),
            F.when(key % 3 != 0, F.concat(F.lit("note "), key.cast("string"))).alias("note"),
            key.alias("transaction_id"),
            F.timestamp_add("MINUTE", (key % 1440).cast("int"), F.col("o_orderdate")).alias("created_at"),
        )
    )


def refund_log(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return (
        read_table(spark, folder, "orders")
        .filter(F.col("o_orderstatus") == "P")
        .select(
            key.alias("id"),
            key.alias("transaction_id"),
            F.col("o_custkey").alias("user_id"),
            F.when(key % 4 != 0, F.lit(0).cast("bigint")).alias("requested_by"),
            F.lit("completed").alias("status"),
            _cents(F.col("o_totalprice") / 40).alias("amount_brl"),
            F.floor(F.col("o_totalprice") / 400).cast("int").alias("credits_mb"),
            F.timestamp_add("MINUTE", (key % 1440).cast("int"), F.col("o_orderdate")).alias("created_at"),
        )
    )


def refund_requests(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("transaction_id")
    )


def provider_payments(spark: SparkSession, folder: str) -> DataFrame:
    """What the payment provider says about paid transactions."""
    key = F.col("o_orderkey")
    return (
        read_table(spark, folder, "orders")
        .filter((F.col("o_orderpriority") != "5-LOW") & (key % 3 == 0))
        .select(
            key.cast("string").alias("payment_id"),
            F.when(key % 2 == 0, "pix").otherwise("master").alias("payment_method_id"),
            F.when(key % 2 == 0, "bank_transfer").otherwise("credit_card").alias("payment_type_id"),
            F.when(key % 15 == 0, "charged_back").otherwise("approved").alias("status"),
            _cents((key % 5) * 21).alias("fee_brl"),
        )
    )


def payer(key: Column) -> Column:
    """A user id in the 36-character form payment references use."""
    return F.lpad(key.cast("string"), 36, "0")


def notices_from(orders: DataFrame) -> DataFrame:
    """One to three notices per order, an hour apart."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    spread = orders.withColumn("step", F.explode(F.sequence(F.lit(0), (key % 3).cast("int"))))
    step = F.col("step")
    status = (
        F.when(key % 11 == 7, F.when(step == 0, "pending").otherwise("rejected"))
        .when((step == 2) & (key % 5 == 1), "refunded")
        .when((F.col("o_orderstatus") == "O") & (step == 0), "pending")
        .otherwise("approved")
    )
    amount = F.floor(F.col("o_totalprice") / 1000) + F.when(key % 2 == 0, 0.5).otherwise(0.0)
    package = F.element_at(F.array(*[F.lit(p) for p in ("basic", "plus", "pro", "premium")]), (key % 4 + 1).cast("int"))
    by_reference = key % 5 == 2
    nothing = F.lit(None).cast("string")
    return spread.select(
        key.cast("string").alias("id"),
        status.alias("status"),
        F.when(status == "rejected", "cc_rejected").alias("status_detail"),
        amount.alias("transaction_amount"),
        F.when(key % 3 == 0, "pix").when(key % 3 == 1, "master").alias("payment_method_id"),
        F.when(key % 6 == 2, "account_money").alias("payment_type_id"),
        F.when(by_reference, F.concat(F.lit("user_"), payer(customer), F.lit("_pkg_"), package)).otherwise("order").alias("external_reference"),
        F.struct(
            F.when(~by_reference & (key % 13 != 4), payer(customer)).alias("user_id"),
            F.when(~by_reference & (key % 7 != 1), package).alias("package_id"),
            F.when(key % 7 == 3, F.lit("123")).when(key % 7 == 4, F.lit("x")).otherwise(nothing).alias("credits_mb"),
        ).alias("metadata"),
        F.when(
            key % 4 != 0,
            F.array(
                F.struct(
                    F.when(key % 4 != 1, "collector").alias("fee_payer"), ((key % 9 + step) * 0.25).alias("amount")
                ),
                F.struct(F.lit("payer").alias("fee_payer"), F.lit(1.5).alias("amount")),
            ),
        ).alias("fee_details"),
        F.struct(F.when(key % 8 != 0, amount - 0.75).alias("net_received_amount")).alias("transaction_details"),
        F.timestamp_add("HOUR", step, F.col("o_orderdate")).alias("ts"),
    )


def notices(spark: SparkSession, folder: str) -> DataFrame:
    return notices_from(spread(read_table(spark, folder, "orders"), "o_orderkey"))


def post_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations read as the edit log of one post each."""
    turn, conv = F.col("turn"), F.col("conv_id")
    first = turn == 0
    return read_table(spark, folder, "conversations").select(
        conv.alias("post_id"),
        turn.cast("int").alias("edit_ord"),
        F.timestamp_add("MINUTE", (conv * 60 + turn).cast("int"), at("2024-01-01 00:00:00")).alias("ts"),
        F.when(first | (turn % 3 == 1), F.col("text")).alias("title"),
        F.when(turn % 2 == 0, F.substr(F.col("text"), F.lit(61))).alias("excerpt"),
        F.col("text").alias("body_md"),
        F.when(turn % 4 == 2, F.concat(F.lit("cover-"), conv.cast("string"))).alias("cover_url"),
        F.when(turn == 3, F.concat(F.lit("Edição Nº "), conv.cast("string"))).alias("slug"),
        F.when(turn % 4 == 0, conv % 2 == 0).when(turn % 4 == 2, F.lit(True)).when((turn % 4 == 3) & (conv % 3 == 0), F.lit(False)).alias("published"),
        F.when(F.col("role") == "assistant", "editor@example.com").when(first, "autor@example.com").alias("author_email"),
    )


LINES_PER_PAGE = 20


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ``documents`` laid out on pages of twenty lines, 612 by 792 points."""
    documents = spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    ord_ = (F.col("i") % LINES_PER_PAGE).cast("int")
    top = F.lit(30.0) + ord_ * 36.0
    return lines.select(
        "doc_id",
        (F.floor(F.col("i") / LINES_PER_PAGE) + 1).cast("int").alias("page_number"),
        ord_.alias("line_ord"),
        F.lit(40.0).alias("x0"),
        top.alias("y0"),
        (F.lit(41.0) + F.least(F.length("text"), F.lit(80)) * 6.0).alias("x1"),
        (top + 14.0).alias("y1"),
        "text",
    )


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Three selections per document: a wide box, a speck and a large empty-handed box."""
    doc = F.col("doc_id")
    spread = read_table(spark, folder, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("correction_ord"))
    ord_ = F.col("correction_ord")
    y = (F.lit(30) + (doc * 7 + ord_ * 11) % 760).cast("double")
    wide, tall = F.when(ord_ == 1, 1.0).when(ord_ == 3, 400.0).otherwise(90.0), F.when(ord_ == 1, 1.0).when(ord_ == 3, 300.0).otherwise(44.0)
    return spread.select(
        "doc_id",
        (1 + (doc + ord_) % 4).cast("int").alias("page_number"),
        "correction_ord",
        (F.lit(45.0) + wide).alias("x0"),
        y.alias("y0"),
        F.lit(45.0).alias("x1"),
        (y + tall).alias("y1"),
        F.concat(F.lit(" corrigido "), ord_.cast("string"), F.lit(" ")).alias("text"),
        F.lit(612.0).alias("page_width"),
        F.lit(792.0).alias("page_height"),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers for some pages, in the shapes such answers take."""
    kind = (F.col("doc_id") * 7 + F.col("page_number")) % 9
    body = (
        F.when(kind == 0, '{"doc_type":"ipva","supplier":" Detran ","confidence":0.95,"is_continuation":false,"reasoning":"guia"}')
        .when(kind == 1, '```json\n{"doc_type":"nfe","confidence":1.7,"is_continuation":"no"}\n```')
        .when(kind == 2, "sem resposta")
        .when(kind == 3, '{"doc_type":"desconhecido","confidence":0.3}')
        .when(kind == 4, '{"doc_type":null,"confidence":null,"is_continuation":true}')
        .when(kind == 5, '{"confidence":"0.85","doc_type":"darf","is_continuation":true,"reasoning":"viasat na fatura"}')
        .when(kind == 6, "[1,2]")
    )
    return corpus(spark, folder).select("doc_id", "page_number", body.alias("body")).filter("body is not null")


# ---- ledger access: column list, equality, IN, order, limit; insert and update by latest state ----


def select_rows(
    df: DataFrame,
    columns: list[str],
    equal: dict[str, object] | None = None,
    within: dict[str, list] | None = None,
    newest_by: tuple[str, ...] = (),
    limit: int | None = None,
) -> DataFrame:
    """Rows of a ledger table; every part reaches the scan or becomes a top-k."""
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name) == F.lit(value))
    for name, values in (within or {}).items():
        df = df.filter(F.col(name).isin(*values))
    if newest_by:
        df = df.orderBy(*[F.desc(name) for name in newest_by])
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns)


def latest_rows(log: DataFrame, key: str, version: str) -> DataFrame:
    """Current table from an append-only log of full rows: the highest version of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("row")).select(key, "row.*")
