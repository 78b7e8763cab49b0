"""Admin, finance and user reports.

``limit=None`` reads the whole table, a number reads the newest rows as the screens do. Jobs and
transactions are always aggregated before they meet the users table, so a busy user joins as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.operators.ledger import at, available_credits, simple_balance
from pagewise.operators.refunds import is_invoice

MONEY = "decimal(18,2)"
BIG = "bigint"


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def newest(df: DataFrame, limit: int | None, column: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest ``limit`` rows, or all of them."""
    return df if limit is None else df.orderBy(F.desc(column), F.desc(tie)).limit(limit)


def _emails(users: DataFrame, key: str, out: str) -> DataFrame:
    return users.select(F.col("id").alias(key), F.coalesce("email", F.lit("")).alias(out))


def with_email(df: DataFrame, users: DataFrame, key: str, out: str) -> DataFrame:
    """Left join of one e-mail column; a missing user reads as the empty string. Adaptive execution picks
    the join side by measured size and splits a hot key."""
    return df.join(_emails(users, key, out), key, "left").withColumn(out, F.coalesce(out, F.lit("")))


# ---- joins ----


def jobs_with_email(jobs: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    return with_email(newest(jobs, limit), users, "user_id", "user_email")


def users_with_jobs(users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every user with each of their jobs, users without jobs once.

    Stated as an inner join plus the users left over: adaptive execution can split a user with very many
    jobs in an inner join, but not on the optional side of an outer one.
    """
    people = users.select(F.col("id").alias("user_id"), "email")
    work = jobs.select("user_id", F.col("id").alias("job_id"), "status", "file_size_mb")
    idle = people.join(jobs.select("user_id").distinct(), "user_id", "left_anti")
    return people.join(work, "user_id").unionByName(idle, allowMissingColumns=True)


def grants_enriched(grants: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    rows = newest(grants, limit)
    return with_email(with_email(rows, users, "user_id", "user_email"), users, "granted_by", "granted_by_email")


def refunds_enriched(refunds: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    rows = newest(refunds, limit)
    return with_email(with_email(rows, users, "user_id", "user_email"), users, "requested_by", "requested_by_email")


def transactions_enriched(transactions: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    people = users.select(
        F.col("id").alias("user_id"),
        F.coalesce("email", F.lit("")).alias("user_email"),
        simple_balance(F.col("total_credits_mb"), F.col("used_credits_mb")).alias("user_available_mb"),
    )
    return newest(transactions, limit).join(people, "user_id", "left").withColumns(
        {
            "user_email": F.coalesce("user_email", F.lit("")),
            "user_available_mb": F.coalesce("user_available_mb", F.lit(0)),
            "package_id": F.get_json_object("payment_metadata", "$.package_id"),
            "source": F.get_json_object("payment_metadata", "$.source"),
            "is_invoice": is_invoice(F.col("payment_method"), F.col("payment_id")),
        }
    )


def referenced_users(grants: DataFrame) -> DataFrame:
    """Every user a grant names, as recipient or as grantor."""
    return (
        grants.select("user_id")
        .union(grants.select("granted_by"))
        .filter(F.col("user_id").isNotNull())
        .distinct()
    )


# ---- aggregates ----


def user_dashboard(users: DataFrame, transactions: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    done = F.col("status") == "completed"
    worked = jobs.groupBy("user_id").agg(
        F.count("*").alias("total_jobs"),
        F.count_if(done).alias("completed_jobs"),
        F.sum(F.when(done, F.col("file_size_mb")).otherwise(0)).cast(MONEY).alias("total_mb_processed"),
    )
    credits = available_credits(users, transactions, as_of).withColumnRenamed("available_mb", "available_credits_mb")
    return (
        users.withColumnRenamed("id", "user_id")
        .join(credits, "user_id")
        .join(worked, "user_id", "left")
        .select(
            "user_id",
            "email",
            "display_name",
            "available_credits_mb",
            "used_credits_mb",
            "total_credits_mb",
            "free_uses_today",
            F.coalesce("total_jobs", F.lit(0).cast(BIG)).alias("total_jobs"),
            F.coalesce("completed_jobs", F.lit(0).cast(BIG)).alias("completed_jobs"),
            F.coalesce("total_mb_processed", F.lit(0).cast(MONEY)).alias("total_mb_processed"),
        )
    )


def _user_balances(users: DataFrame) -> DataFrame:
    total, used = F.coalesce("total_credits_mb", F.lit(0)), F.coalesce("used_credits_mb", F.lit(0))
    return users.select(
        F.col("id").alias("user_id"),
        F.coalesce("email", F.lit("")).alias("email"),
        total.alias("total_credits_mb"),
        used.alias("used_credits_mb"),
        F.greatest(total - used, F.lit(0)).alias("available_mb"),
    )


def recent_usage_by_user(jobs: DataFrame, limit: int | None = 80) -> DataFrame:
    """MB processed and job count per user over the newest jobs."""
    return (
        newest(jobs, limit)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.sum("file_size_mb").cast(MONEY).alias("mb_processed_recent"), F.count("*").alias("jobs_recent"))
    )


def last_jobs_per_user(jobs: DataFrame, limit: int | None = 80, keep: int = 3) -> DataFrame:
    """The newest jobs of each user as an array. The rank limit is applied before and after the shuffle, so a
    user's whole history never travels."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = (
        newest(jobs, limit).filter(F.col("user_id").isNotNull()).withColumn("rank", F.row_number().over(order))
    ).filter(F.col("rank") <= keep)
    entry = F.struct("rank", "id", "filename", "file_size_mb", "created_at", "status")
    return ranked.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda job: job.dropFields("rank")).alias("last_jobs")
    )


def _paid(transactions: DataFrame) -> DataFrame:
    return transactions.filter(
        ~is_invoice(F.col("payment_method"), F.col("payment_id"))
        & F.col("payment_status").isin("approved", "partially_refunded", "refunded")
    )


def _invoiced(transactions: DataFrame) -> DataFrame:
    return transactions.filter(is_invoice(F.col("payment_method"), F.col("payment_id")))


def _usage_columns() -> dict[str, Column]:
    return {
        "mb_processed_recent": F.coalesce("mb_processed_recent", F.lit(0).cast(MONEY)),
        "jobs_recent": F.coalesce("jobs_recent", F.lit(0).cast(BIG)),
    }


def paid_accounts(
    transactions: DataFrame, users: DataFrame, jobs: DataFrame, limit: int | None = None, job_limit: int | None = None
) -> DataFrame:
    """Paying accounts. ``last_at`` is the oldest purchase of the slice, as the screen shows it."""
    bought = (
        _paid(newest(transactions, limit))
        .groupBy("user_id")
        .agg(
            F.sum(F.col("credits_mb").cast(BIG)).alias("credits_bought_mb"),
            F.sum("amount_brl").cast(MONEY).alias("amount_paid_brl"),
            F.sum(F.coalesce("fee_brl", F.lit(0))).cast(MONEY).alias("fee_brl"),
            F.count("*").alias("purchases"),
            F.min("created_at").alias("last_at"),
            F.array_sort(F.collect_set(F.nullif("payment_method", F.lit("")))).alias("methods"),
        )
    )
    return (
        bought.join(_user_balances(users), "user_id", "left")
        .join(recent_usage_by_user(jobs, job_limit), "user_id", "left")
        .withColumns(
            {
                "email": F.coalesce("email", F.lit("")),
                "total_credits_mb": F.coalesce("total_credits_mb", F.lit(0)),
                "used_credits_mb": F.coalesce("used_credits_mb", F.lit(0)),
                "available_mb": F.coalesce("available_mb", F.lit(0)),
                "active_paid": F.coalesce("available_mb", F.lit(0)) > 0,
                **_usage_columns(),
            }
        )
    )


def invoiced_accounts(
    transactions: DataFrame, users: DataFrame, jobs: DataFrame, limit: int | None = None, job_limit: int | None = None
) -> DataFrame:
    """Invoiced accounts with their three newest notes, picked by rank before any list is built."""
    invoices = _invoiced(newest(transactions, limit))
    totals = invoices.groupBy("user_id").agg(
        F.sum(F.col("credits_mb").cast(BIG)).alias("credits_granted_mb"),
        F.sum("amount_brl").cast(MONEY).alias("amount_contracted_brl"),
        F.count("*").alias("purchases"),
        F.min("created_at").alias("last_at"),
    )
    note = F.nullif(F.get_json_object("payment_metadata", "$.note"), F.lit(""))
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    notes = (
        invoices.select("user_id", "created_at", "id", note.alias("note"))
        .filter(F.col("note").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter("rank <= 3")
        .groupBy("user_id")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "note"))), lambda item: item["note"]).alias("notes")
        )
    )
    total, available = F.coalesce("total_credits_mb", F.lit(0)), F.coalesce("available_mb", F.lit(0))
    return (
        totals.join(_user_balances(users), "user_id", "left")
        .join(recent_usage_by_user(jobs, job_limit), "user_id", "left")
        .join(notes, "user_id", "left")
        .withColumns(
            {
                "email": F.coalesce("email", F.lit("")),
                "total_credits_mb": total,
                "used_credits_mb": F.coalesce("used_credits_mb", F.lit(0)),
                "available_mb": available,
                "low_balance": (total > 0) & (available * 5 <= total),
                "notes": F.coalesce("notes", F.array().cast("array<string>")),
                **_usage_columns(),
            }
        )
    )


def finance_summary(transactions: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """One row of totals. Accounts are folded per user first, then summed, so no distinct count is needed."""
    rows = newest(transactions, limit)
    invoice = is_invoice(F.col("payment_method"), F.col("payment_id"))
    paid = ~invoice & F.col("payment_status").isin("approved", "partially_refunded", "refunded")

    def over(condition: Column, name: str, kind: str) -> Column:
        return F.sum(F.when(condition, F.coalesce(name, F.lit(0)))).cast(kind)

    per_user = rows.groupBy("user_id").agg(
        over(paid, "amount_brl", MONEY).alias("gross"),
        over(paid, "fee_brl", MONEY).alias("fees"),
        over(paid, "refunded_amount_brl", MONEY).alias("refunded"),
        over(invoice, "credits_mb", BIG).alias("invoice_credits"),
        over(paid, "credits_mb", BIG).alias("paid_credits"),
        F.bool_or(invoice).alias("invoiced"),
        F.bool_or(paid).alias("paid"),
    )
    joined = per_user.join(_user_balances(users), "user_id", "left")
    total, available = F.coalesce("total_credits_mb", F.lit(0)), F.coalesce("available_mb", F.lit(0))
    zero = F.lit(0)
    summed = joined.agg(
        F.coalesce(F.sum("gross"), zero).cast(MONEY).alias("gross_paid_brl"),
        F.coalesce(F.sum("fees"), zero).cast(MONEY).alias("fees_brl"),
        F.coalesce(F.sum("refunded"), zero).cast(MONEY).alias("refunded_brl"),
        F.coalesce(F.sum("invoice_credits"), zero).cast(BIG).alias("invoice_credits_mb"),
        F.coalesce(F.sum("paid_credits"), zero).cast(BIG).alias("paid_credits_mb"),
        F.count_if("invoiced").alias("invoiced_accounts"),
        F.count_if("paid").alias("paid_accounts"),
        F.count_if(F.col("paid") & (available > 0)).alias("active_paid_accounts"),
        F.count_if(F.col("invoiced") & (total > 0) & (available * 5 <= total)).alias("low_balance_invoiced"),
    )
    return summed.withColumn("net_paid_brl", (F.col("gross_paid_brl") - F.col("fees_brl")).cast(MONEY))


def credits_in_circulation(users: DataFrame) -> DataFrame:
    balance = simple_balance(F.col("total_credits_mb"), F.col("used_credits_mb"))
    return users.filter(F.coalesce("role", F.lit("")) != "admin").agg(
        F.coalesce(F.sum(balance.cast(BIG)), F.lit(0).cast(BIG)).alias("credits_in_circulation_mb")
    )


def job_history(jobs: DataFrame, keep: int = 10) -> DataFrame:
    """Newest jobs of every user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        jobs.filter(F.col("user_id").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= keep)
    )


def job_summary(jobs: DataFrame, keep: int = 10) -> DataFrame:
    return job_history(jobs, keep).groupBy("user_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed_jobs"), F.count("*").alias("total_jobs")
    )


def ocr_coverage(pages: DataFrame) -> DataFrame:
    from pagewise.functions import text as T

    native = F.nullif(F.col("native_text"), F.lit(""))
    weak = T.needs_ocr(F.col("native_text"))
    scanned = F.nullif(F.col("ocr_text"), F.lit("")).isNotNull()
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.count_if(native.isNotNull()).alias("native_pages"),
        F.count_if(weak).alias("needs_ocr_pages"),
        F.count_if(scanned).alias("ocr_pages"),
        F.count_if(native.isNull() & ~scanned).alias("empty_pages"),
    )


# ---- sorts, searches, limits ----


def users_search(users: DataFrame, query: str = "", limit: int = 30) -> DataFrame:
    needle = query.strip().lower()
    found = users.filter(F.lower("email").contains(needle)) if needle else users
    return newest(found, clamp(limit, 100)).withColumn(
        "available_mb", simple_balance(F.col("total_credits_mb"), F.col("used_credits_mb"))
    )


def recent_grants(grants: DataFrame, users: DataFrame, limit: int = 40) -> DataFrame:
    return grants_enriched(grants, users, clamp(limit, 100))


def ip_usage_today(ip_usage: DataFrame, as_of: str, limit: int = 40) -> DataFrame:
    today = ip_usage.filter(F.col("usage_date") == F.to_date(at(as_of)))
    return newest(today, clamp(limit, 100), "updated_at", "ip")


def admin_logs(
    jobs: DataFrame, grants: DataFrame, ip_usage: DataFrame, users: DataFrame, as_of: str, limit: int = 50
) -> dict[str, DataFrame]:
    """Newest jobs, the first 20 failures within them, newest grants and today's addresses."""
    limit = clamp(limit, 100)
    recent = jobs_with_email(jobs, users, limit)
    return {
        "jobs": recent,
        "failed_jobs": newest(recent.filter(F.col("status") == "failed"), 20),
        "grants": grants_enriched(grants, users, min(limit, 30)),
        "ip_usage": ip_usage_today(ip_usage, as_of, 40),
    }


def transactions_search(transactions: DataFrame, users: DataFrame, query: str = "", limit: int = 50) -> DataFrame:
    """The search sees only the newest ``limit`` rows, so the limit comes first."""
    rows = transactions_enriched(transactions, users, clamp(limit, 100))
    needle = query.strip().lower()
    if not needle:
        return rows
    return rows.filter(
        F.lower("user_email").contains(needle) | F.lower(F.coalesce("payment_id", F.lit(""))).contains(needle)
    )


def order_invoiced(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy(F.desc("available_mb"), "email", "user_id")


def order_paid(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy(F.desc("active_paid"), F.desc("available_mb"), "email", "user_id")


def row_scope(df: DataFrame, user_id: int, key: str = "user_id") -> DataFrame:
    """Rows a user may see; a plain equality, so it reaches the scan."""
    return df.filter(F.col(key) == user_id)


def published_scope(posts: DataFrame) -> DataFrame:
    return posts.filter("published")


def packages_by_use(packages: DataFrame, transactions: DataFrame) -> DataFrame:
    """The catalogue with the number of purchases of each package and what they paid."""
    used = (
        transactions.select(F.get_json_object("payment_metadata", "$.package_id").alias("id"), "amount_brl")
        .groupBy("id")
        .agg(F.count("*").alias("purchases"), F.sum("amount_brl").cast(MONEY).alias("amount_brl"))
    )
    return packages.join(used, "id", "left").select(
        *packages.columns,
        F.coalesce("purchases", F.lit(0).cast(BIG)).alias("purchases"),
        F.coalesce("amount_brl", F.lit(0).cast(MONEY)).alias("amount_brl"),
    )


