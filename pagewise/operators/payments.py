"""Payment notices: identification, parsing, fees and applying each payment once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import values as V

FINAL = ("approved", "refunded", "partially_refunded")


def packages(spark) -> DataFrame:
    """The credit package catalogue with its display texts."""
    rows = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(V.CREDIT_PACKAGES)],
        "ord INT, id STRING, price_brl INT, credits_mb INT, label STRING",
    )
    return rows.select(
        "id",
        F.col("price_brl").cast("decimal(10,2)").alias("price_brl"),
        "credits_mb",
        "label",
        F.format_string("R$ %.2f", F.col("price_brl").cast("double")).alias("price_formatted"),
        F.format_string("%d MB", "credits_mb").alias("credits_formatted"),
    )


def _catalogue(keys: list, values: list[int]) -> Column:
    return F.create_map(*[F.lit(part) for pair in zip(keys, values, strict=True) for part in pair])


def notification_id(body: Column, query: Column) -> Column:
    """First all-digit id in a notice's JSON body or in its query map; order topics give none."""
    candidates = F.array(
        F.get_json_object(body, "$.data.id"),
        F.get_json_object(body, "$.id"),
        F.get_json_object(body, "$['data.id']"),
        F.try_element_at(query, F.lit("data.id")),
        F.try_element_at(query, F.lit("id")),
        F.try_element_at(query, F.lit("payment_id")),
    )
    digits = F.filter(F.transform(candidates, lambda raw: F.btrim(raw)), lambda raw: raw.rlike(r"^[0-9]+$"))
    blank = F.lit("")
    topic = F.coalesce(
        F.nullif(F.get_json_object(body, "$.type"), blank),
        F.nullif(F.get_json_object(body, "$.topic"), blank),
        F.nullif(F.try_element_at(query, F.lit("topic")), blank),
        F.nullif(F.try_element_at(query, F.lit("type")), blank),
        blank,
    )
    return F.when(~F.lower(topic).contains("merchant_order"), F.get(digits, F.lit(0)))


def payment_fee(amount: Column, fee_details: Column, net_received: Column) -> Column:
    """Collector fees, else what is missing between the amount and the net received."""
    collector = F.filter(
        fee_details,
        lambda fee: F.coalesce(F.nullif(fee["fee_payer"], F.lit("")), F.lit("collector")) == "collector",
    )
    money = "decimal(12,4)"
    listed = F.coalesce(
        F.aggregate(
            collector,
            F.lit(0).cast("decimal(18,4)"),
            lambda total, fee: (total + F.coalesce(fee["amount"], F.lit(0.0)).cast(money)).cast("decimal(18,4)"),
        ),
        F.lit(0).cast("decimal(18,4)"),
    )
    paid = F.coalesce(amount, F.lit(0.0)).cast(money)
    net = F.coalesce(net_received, F.lit(0.0)).cast(money)
    implied = F.when((paid > 0) & (net >= 0) & (net <= paid), paid - net).otherwise(F.lit(0).cast(money))
    return F.round(F.when(listed > 0, listed).otherwise(implied), 2).cast("decimal(10,2)")


def parse_payments(notices: DataFrame) -> DataFrame:
    """Payer, package, credits, fee and method of every notice."""
    blank = F.lit("")
    reference = F.coalesce("external_reference", blank)
    given_user = F.nullif(F.col("metadata.user_id"), blank)
    given_package = F.nullif(F.col("metadata.package_id"), blank)
    user = F.coalesce(given_user, F.nullif(F.regexp_extract(reference, V.EXTERNAL_REFERENCE_PATTERN, 1), blank))
    package = F.coalesce(given_package, F.nullif(F.regexp_extract(reference, V.EXTERNAL_REFERENCE_PATTERN, 2), blank))
    by_package = _catalogue([p[0] for p in V.CREDIT_PACKAGES], [p[2] for p in V.CREDIT_PACKAGES])
    by_amount = _catalogue([p[1] for p in V.CREDIT_PACKAGES], [p[2] for p in V.CREDIT_PACKAGES])
    whole = F.coalesce(F.bround(F.col("transaction_amount"), 0).cast("int"), F.lit(0))
    parsed = notices.withColumn("user_id", user).withColumn("package_id", package)
    credits = F.coalesce(
        F.col("metadata.credits_mb").try_cast("int"),
        F.try_element_at(by_package, F.col("package_id")),
        F.try_element_at(by_amount, whole),
        F.greatest(whole * V.CREDITS_PER_BRL, F.lit(0)),
    )
    fee = payment_fee(
        F.col("transaction_amount"), F.col("fee_details"), F.col("transaction_details.net_received_amount")
    )
    amount = F.coalesce("transaction_amount", F.lit(0.0)).cast("decimal(10,2)")
    return parsed.select(
        F.col("id").alias("payment_id"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        "status_detail",
        "user_id",
        "package_id",
        credits.alias("credits_mb"),
        amount.alias("amount_brl"),
        fee.alias("fee_brl"),
        F.greatest(amount - fee, F.lit(0)).cast("decimal(10,2)").alias("net_amount_brl"),
        F.coalesce(
            F.nullif("payment_method_id", blank), F.nullif("payment_type_id", blank), F.lit(V.DEFAULT_METHOD)
        ).alias("payment_method"),
        "payment_type_id",
        "ts",
    )


def fulfil_payments(parsed: DataFrame) -> DataFrame:
    """One row per payment after all its notices, in notice order.

    The first final notice fixes user, credits, amount and status; later ones only refresh fee, net and
    method while the payment stands approved. Without a final notice the last one counts. All of it is
    one aggregate per payment id, so repeated notices are combined before the shuffle.
    """
    usable = parsed.filter(F.col("user_id").isNotNull())
    final = F.col("status").isin(*FINAL)
    # One notice per choice: notices of one time stamp are told apart by their content.
    notice = F.struct(
        "ts", "status", "user_id", "package_id", "credits_mb", "amount_brl", "fee_brl", "net_amount_brl", "payment_method"
    )
    folded = usable.groupBy("payment_id").agg(
        F.min(F.when(final, notice)).alias("settled"), F.max(notice).alias("last"), F.count("*").alias("notices")
    )
    kept = F.coalesce("settled", "last")
    refreshed = F.when(F.col("settled.status") == "approved", F.col("last")).otherwise(kept)
    approved = kept["status"] == "approved"
    return folded.select(
        "payment_id",
        kept["user_id"].alias("user_id"),
        kept["package_id"].alias("package_id"),
        kept["status"].alias("payment_status"),
        kept["credits_mb"].alias("credits_mb"),
        kept["amount_brl"].alias("amount_brl"),
        refreshed["fee_brl"].alias("fee_brl"),
        refreshed["net_amount_brl"].alias("net_amount_brl"),
        refreshed["payment_method"].alias("payment_method"),
        F.when(approved, kept["ts"]).alias("approved_at"),
        F.timestamp_add("DAY", F.lit(V.CREDIT_VALID_DAYS), kept["ts"]).alias("expires_at"),
        F.when(approved & (kept["credits_mb"] > 0), kept["credits_mb"]).otherwise(F.lit(0)).alias("credited_mb"),
        "notices",
    )


def unmatched_payments(parsed: DataFrame) -> DataFrame:
    """Notices that name no user."""
    return parsed.filter(F.col("user_id").isNull()).select(
        "payment_id", "status", "ts", F.lit("missing_user_id").alias("error")
    )


def user_balances(fulfilled: DataFrame, grants: DataFrame, clawbacks: DataFrame) -> DataFrame:
    """Total credits per user: payments and grants less claw-backs, never below zero."""
    deltas = (
        fulfilled.select("user_id", F.col("credited_mb").cast("bigint").alias("delta"))
        .unionByName(grants.select("user_id", F.col("credits_mb").cast("bigint").alias("delta")))
        .unionByName(clawbacks.select("user_id", (-F.col("credits_mb").cast("bigint")).alias("delta")))
    )
    return deltas.groupBy("user_id").agg(F.greatest(F.sum("delta"), F.lit(0)).alias("total_credits_mb"))
