"""Refund policy: previews and a batch of refunds applied in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import values as V
from pagewise.operators.budget import spend_in_order
from pagewise.operators.ledger import simple_balance

MONEY = "decimal(10,2)"


def method_deducts_fee(method: Column, kind: Column | None = None) -> Column:
    """Card and boleto payments are refunded without the operator's fee."""
    name = F.lower(F.coalesce(method, F.lit("")))
    deducts = name.isin(*V.FEE_DEDUCT_METHODS)
    if kind is not None:
        deducts = deducts | F.lower(F.coalesce(kind, F.lit(""))).isin(*V.FEE_DEDUCT_TYPES)
    for word in V.FEE_DEDUCT_WORDS:
        deducts = deducts | name.contains(word)
    return deducts


def is_invoice(method: Column, payment_id: Column) -> Column:
    return (F.lower(F.coalesce(method, F.lit(""))) == "invoice") | F.coalesce(payment_id, F.lit("")).startswith(
        V.INVOICE_PREFIX
    )


def is_invoice_for_preview(method: Column, payment_id: Column) -> Column:
    """The preview also treats manual and billed payments as invoices."""
    return F.lower(F.coalesce(method, F.lit(""))).isin(*V.PREVIEW_INVOICE_METHODS) | F.coalesce(
        payment_id, F.lit("")
    ).startswith(V.INVOICE_PREFIX)


def _share(money: Column, credits: Column, pack: Column) -> Column:
    """Money for ``credits`` out of ``pack``, to the cent; multiplied before dividing to stay exact."""
    scaled = money.cast("decimal(12,2)") * credits.cast("decimal(10,0)")
    return F.round(F.try_divide(scaled, pack.cast("decimal(10,0)")), 2).cast(MONEY)


def _terms(transactions: DataFrame, users: DataFrame, provider: DataFrame | None) -> DataFrame:
    """Everything a refund depends on except the user's remaining balance."""
    people = users.select(
        F.col("id").alias("user_id"),
        simple_balance(F.col("total_credits_mb"), F.col("used_credits_mb")).alias("available_mb"),
    )
    rows = transactions.join(people, "user_id")
    if provider is not None:
        seen = provider.select(
            "payment_id",
            F.col("payment_method_id"),
            F.col("payment_type_id").alias("payment_type"),
            F.col("status").alias("provider_status"),
            F.col("fee_brl").alias("provider_fee"),
        )
        rows = rows.join(seen, "payment_id", "left")
    else:
        none = F.lit(None).cast("string")
        rows = rows.withColumns(
            {
                "payment_method_id": none,
                "payment_type": none,
                "provider_status": none,
                "provider_fee": F.lit(None).cast(MONEY),
            }
        )
    fee = F.when(F.col("provider_fee") > 0, F.col("provider_fee")).otherwise(F.coalesce("fee_brl", F.lit(0))).cast(MONEY)
    method = F.coalesce(F.nullif("payment_method_id", F.lit("")), F.col("payment_method"))
    rows = rows.withColumns({"fee": fee, "method": method}).withColumns(
        {
            "deduct_fee": method_deducts_fee(F.col("method"), F.col("payment_type")),
            "invoice": is_invoice_for_preview(F.col("method"), F.col("payment_id")),
            "back_money": F.coalesce("refunded_amount_brl", F.lit(0)).cast(MONEY),
            "back_credits": F.coalesce("refunded_credits_mb", F.lit(0)),
        }
    )
    paid = F.col("amount_brl") - F.when(F.col("deduct_fee"), F.col("fee")).otherwise(F.lit(0))
    return rows.withColumns(
        {
            "max_money": F.greatest(paid - F.col("back_money"), F.lit(0)).cast(MONEY),
            "pack_left": F.greatest(F.col("credits_mb") - F.col("back_credits"), F.lit(0)),
        }
    )


def _refund_amount(claw: Column) -> Column:
    """Money for the clawed credits; all that is left when the whole rest of the pack goes back."""
    return (
        F.when(F.col("pack_left") <= 0, F.lit(0))
        .when(claw == F.col("pack_left"), F.col("max_money"))
        .otherwise(F.coalesce(_share(F.col("max_money"), claw, F.col("credits_mb")), F.lit(0)))
        .cast(MONEY)
    )


def _standing_reasons() -> list[Column]:
    """Block reasons that do not depend on the balance."""
    status_ok = F.coalesce(F.col("payment_status").isin("approved", "partially_refunded"), F.lit(False))
    done = (F.col("pack_left") <= 0) | (F.col("back_money") >= F.col("amount_brl"))
    provider = (F.coalesce("provider_status", F.lit("")) != "") & (F.col("provider_status") != "approved")
    return [
        F.when(~status_ok, F.lit(V.REASON_NOT_APPROVED)),
        F.when(done, F.lit(V.REASON_ALREADY_REFUNDED)),
        F.when(provider, F.concat(F.lit(V.REASON_PROVIDER_STATUS), "provider_status", F.lit("."))),
    ]


def refund_preview(transactions: DataFrame, users: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """What refunding each transaction would return and claw back, with every reason against it."""
    rows = _terms(transactions, users, provider)
    rows = rows.withColumn("claw", F.least("available_mb", "pack_left"))
    rows = rows.withColumn("money", _refund_amount(F.col("claw")))
    standing = _standing_reasons()
    reasons = F.array_compact(
        F.array(
            standing[0],
            standing[1],
            F.when(F.col("claw") <= 0, F.lit(V.REASON_NO_CREDITS)),
            F.when(~F.col("invoice") & (F.col("money") <= 0), F.lit(V.REASON_NO_MONEY)),
            standing[2],
        )
    )
    return rows.withColumn("block_reasons", reasons).select(
        F.col("id").alias("transaction_id"),
        "user_id",
        "payment_id",
        F.col("method").alias("payment_method"),
        "amount_brl",
        F.col("fee").alias("fee_brl"),
        "deduct_fee",
        F.col("back_money").alias("already_refunded_amount_brl"),
        F.col("back_credits").alias("already_refunded_credits_mb"),
        "available_mb",
        "credits_mb",
        F.col("claw").alias("credits_to_claw_mb"),
        F.when(F.col("invoice"), F.lit(0)).otherwise(F.col("money")).cast(MONEY).alias("refund_amount_brl"),
        F.col("invoice").alias("is_invoice"),
        (~F.col("invoice") & (F.col("money") > 0)).alias("mp_money_refund"),
        (F.size("block_reasons") == 0).alias("can_refund"),
        "block_reasons",
    )


def refund_apply(
    requests: DataFrame, transactions: DataFrame, users: DataFrame, provider: DataFrame | None = None
) -> DataFrame:
    """Apply a batch of refund requests (request_id, transaction_id, ...) in order; returns those that go through.

    Only the first request for a transaction can: it takes the rest of the pack or all the user has, and neither grows
    during the batch. ``refund_refusals`` answers the others.

    Every refund of a user lowers what the next may claw. A refund goes through when the balance covers the
    smallest claw that still returns money, and takes at most the rest of its pack.
    """
    terms = _terms(transactions, users, provider)
    asked = requests.groupBy(F.col("transaction_id").alias("id")).agg(F.min("request_id").alias("request_id"))
    rows = asked.join(terms, "id")
    blocked = F.lit(False)
    for reason in _standing_reasons():
        blocked = blocked | reason.isNotNull()
    no_money = ~F.col("invoice") & (F.col("max_money") <= 0)
    # round(max_money * claw / pack, 2) > 0 holds from claw = pack / (200 * max_money) on.
    floor = F.ceil(F.try_divide(F.col("credits_mb").cast("decimal(10,0)"), F.col("max_money") * F.lit(200).cast("decimal(3,0)")))
    need = F.when(F.col("invoice"), F.lit(1)).otherwise(F.least(F.greatest(floor, F.lit(1)), F.col("pack_left")))
    open_rows = rows.filter(~(blocked | no_money)).select(
        "user_id",
        "request_id",
        "id",
        F.col("available_mb").cast("bigint").alias("budget"),
        need.cast("bigint").alias("need"),
        F.col("pack_left").cast("bigint").alias("charge"),
        "pack_left",
        "max_money",
        "credits_mb",
        "back_money",
        "back_credits",
        "fee",
        "amount_brl",
        "invoice",
    )
    spent = spend_in_order(open_rows, "user_id", ["request_id"]).filter("accepted")
    money = F.when(F.col("invoice"), F.lit(0)).otherwise(_refund_amount(F.col("charged"))).cast(MONEY)
    back = F.col("back_credits") + F.col("charged")
    return spent.select(
        "request_id",
        F.col("id").alias("transaction_id"),
        "user_id",
        F.col("charged").alias("credits_clawed_mb"),
        money.alias("refund_amount_brl"),
        F.when(back >= F.col("credits_mb"), "refunded").otherwise("partially_refunded").alias("payment_status"),
        (F.col("back_money") + money).cast(MONEY).alias("refunded_amount_brl"),
        back.alias("refunded_credits_mb"),
        F.col("fee").alias("fee_brl"),
        (F.col("amount_brl") - F.col("fee")).cast(MONEY).alias("net_amount_brl"),
        (F.col("balance_before") - F.col("charged")).alias("user_available_mb"),
    )


def refund_refusals(
    requests: DataFrame, transactions: DataFrame, users: DataFrame, provider: DataFrame | None = None
) -> DataFrame:
    """The requests that do not go through, with every standing reason, or why the batch left nothing to refund."""
    done = refund_apply(requests, transactions, users, provider).select("request_id", "transaction_id")
    left = requests.select("request_id", "transaction_id").join(done, ["request_id", "transaction_id"], "left_anti")
    earlier = done.select(F.col("transaction_id").alias("_done"), F.col("request_id").alias("_by"))
    terms = refund_preview(transactions, users, provider).select(F.col("transaction_id").alias("_id"), "block_reasons")
    rows = left.join(terms, F.col("transaction_id") == F.col("_id"), "left").join(earlier, F.col("transaction_id") == F.col("_done"), "left")
    reasons = (
        F.when(F.col("_id").isNull(), F.array(F.lit("unknown_transaction")))
        .when(F.col("_by").isNotNull(), F.array(F.lit("already_refunded_in_batch")))
        .when(F.size("block_reasons") > 0, F.col("block_reasons"))
        .otherwise(F.array(F.lit("balance_spent_in_batch")))
    )
    return rows.select("request_id", "transaction_id", reasons.alias("block_reasons"))


def totals_after_refunds(users: DataFrame, applied: DataFrame) -> DataFrame:
    clawed = applied.groupBy("user_id").agg(F.sum("credits_clawed_mb").alias("clawed_mb"))
    return users.join(clawed, users["id"] == clawed["user_id"], "left").select(
        users["id"].alias("user_id"),
        F.greatest(F.coalesce("total_credits_mb", F.lit(0)) - F.coalesce("clawed_mb", F.lit(0)), F.lit(0)).alias(
            "total_credits_mb"
        ),
    )
