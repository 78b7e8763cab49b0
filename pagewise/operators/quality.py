"""Table constraints as violation counts; files enforce none of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules of one table in one pass."""
    counted = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("violations")) for n in rules])
    return counted.select(F.inline(pairs))


def _repeats(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows beyond the first of each key."""
    sizes = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).count()
    return sizes.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations"
    )


def _orphans(df: DataFrame, name: str, key: str, parent: DataFrame) -> DataFrame:
    """Rows whose reference has no parent, counted per key first so that a hot key joins once."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("ref")).count()
    lost = sizes.join(parent.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")
    return lost.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations"
    )


def constraint_checks(
    users: DataFrame,
    transactions: DataFrame,
    jobs: DataFrame,
    grants: DataFrame,
    refunds: DataFrame,
    ip_usage: DataFrame,
    posts: DataFrame,
) -> DataFrame:
    """One row per constraint: (check_name, violations)."""
    used, total = F.coalesce("used_credits_mb", F.lit(0)), F.coalesce("total_credits_mb", F.lit(0))
    parts = [
        _rule_counts(
            users,
            {
                "users_credits_valid": (used < 0) | (used > total),
                "users_role_known": ~F.coalesce(F.col("role").isin("user", "admin"), F.lit(False)),
                "users_email_present": F.col("email").isNull(),
            },
        ),
        _rule_counts(
            transactions,
            {
                "transactions_amount_not_negative": F.col("amount_brl") < 0,
                "transactions_credits_positive": F.col("credits_mb") <= 0,
            },
        ),
        _rule_counts(
            jobs,
            {"jobs_size_positive": F.col("file_size_mb") <= 0, "jobs_pages_positive": F.col("pages_count") <= 0},
        ),
        _rule_counts(
            grants,
            {"grants_credits_positive": F.col("credits_mb") <= 0, "grants_amount_not_negative": F.col("amount_brl") < 0},
        ),
        _repeats(users, "users_email_unique", "email"),
        _repeats(transactions, "transactions_payment_id_unique", "payment_id"),
        _repeats(ip_usage, "ip_usage_key_unique", "ip", "usage_date"),
        _repeats(posts, "posts_slug_unique", "slug"),
        _orphans(transactions, "transactions_user_known", "user_id", users),
        _orphans(jobs, "jobs_user_known", "user_id", users),
        _orphans(grants, "grants_user_known", "user_id", users),
        _orphans(refunds, "refunds_user_known", "user_id", users),
        _orphans(refunds, "refunds_transaction_known", "transaction_id", transactions),
    ]
    return reduce(DataFrame.unionByName, parts)
