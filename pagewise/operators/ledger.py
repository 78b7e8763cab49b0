"""Usage ledger: admission, credit balances, consumption, daily counters and grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.functions import text as T
from pagewise.functions import values as V
from pagewise.operators.budget import spend_in_order
from pagewise.session import cut_lineage


def at(moment: str | Column) -> Column:
    """A zone-free timestamp from its text form."""
    return F.to_timestamp_ntz(F.lit(moment)) if isinstance(moment, str) else moment


def upload_size_mb(length: Column) -> Column:
    """Bytes as MB with two decimals, at least 0.01."""
    megabytes = F.round(length.cast("decimal(20,0)") / F.lit(1048576).cast("decimal(7,0)"), 2).cast("decimal(18,2)")
    return F.greatest(megabytes, F.lit(0.01).cast("decimal(18,2)"))


def upload_admission(uploads: DataFrame, environment: str = "production") -> DataFrame:
    """Admission of uploads (filename, length, pages); the first failing check names the reason."""
    limits = {name: (megabytes, pages) for name, megabytes, pages in V.UPLOAD_LIMITS}
    megabytes, most_pages = limits.get(environment, limits["production"])
    named = F.coalesce(F.lower("filename").endswith(".pdf"), F.lit(False))
    reason = (
        F.when(~named, "not_pdf")
        .when(F.coalesce("length", F.lit(0)) == 0, "empty")
        .when(F.col("length") > megabytes * 1048576, "too_large")
        .when(F.coalesce("pages", F.lit(0)) == 0, "no_pages")
        .when(F.col("pages") > most_pages, "too_many_pages")
    )
    return uploads.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def job_states(job_events: DataFrame) -> DataFrame:
    """Latest state per job from its append-only events (job_id, status, ts and detail columns)."""
    detail = [c for c in job_events.columns if c != "job_id"]
    newest = F.struct("ts", F.when(F.col("status") == "processing", 0).otherwise(1).alias("final"))
    return (
        job_events.groupBy("job_id").agg(F.max_by(F.struct(*detail), newest).alias("state")).select("job_id", "state.*")
    )


def simple_balance(total: Column, used: Column) -> Column:
    """Balance shown to admins and users: never negative, blind to expiry."""
    return F.greatest(F.coalesce(total, F.lit(0)) - F.coalesce(used, F.lit(0)), F.lit(0))


def available_credits(users: DataFrame, transactions: DataFrame, as_of: str) -> DataFrame:
    """Approved, unexpired credits less used ones, per user; may be negative."""
    live = (F.col("payment_status") == "approved") & (F.col("expires_at").isNull() | (F.col("expires_at") > at(as_of)))
    bought = (
        transactions.filter(live).groupBy("user_id").agg(F.sum(F.col("credits_mb").cast("bigint")).alias("bought_mb"))
    )
    return users.join(bought, users["id"] == bought["user_id"], "left").select(
        users["id"].alias("user_id"),
        (F.coalesce("bought_mb", F.lit(0)) - F.coalesce("used_credits_mb", F.lit(0))).alias("available_mb"),
    )


def consume_credits(jobs: DataFrame, balances: DataFrame) -> DataFrame:
    """Replay of credit consumption: a job is charged when the balance covers it, else it takes nothing.

    The balance is whole megabytes, so "balance >= size" means "balance >= ceil(size)", and the charge is
    rounded half up to whole megabytes. A job of a user without a balance has nothing to spend.
    """
    requests = jobs.join(balances.select("user_id", "available_mb"), "user_id", "left").select(
        "user_id",
        "created_at",
        "id",
        "file_size_mb",
        F.coalesce("available_mb", F.lit(0)).cast("bigint").alias("budget"),
        F.ceil("file_size_mb").cast("bigint").alias("need"),
        F.round("file_size_mb", 0).cast("bigint").alias("charge"),
    )
    spent = spend_in_order(requests, "user_id", ["created_at", "id"])
    return spent.select(
        "id", "user_id", "created_at", "file_size_mb", "balance_before", "accepted", F.col("charged").alias("charged_mb")
    )


def used_after(users: DataFrame, consumed: DataFrame) -> DataFrame:
    """Users with their consumption added to ``used_credits_mb``."""
    charged = consumed.groupBy("user_id").agg(F.sum("charged_mb").alias("charged_mb"))
    return users.join(charged, users["id"] == charged["user_id"], "left").select(
        users["id"].alias("user_id"),
        (F.coalesce("used_credits_mb", F.lit(0)) + F.coalesce("charged_mb", F.lit(0))).alias("used_credits_mb"),
    )


def counter_as_of(count: Column, last_use: Column, as_of: str) -> Column:
    """Daily counter: zero unless the last use was today; an unset last use keeps the count."""
    stale = last_use.isNotNull() & (F.to_date(last_use) != F.to_date(at(as_of)))
    return F.when(stale, 0).otherwise(F.coalesce(count, F.lit(0)))


def reset_daily_counters(users: DataFrame, as_of: str) -> DataFrame:
    return users.withColumns(
        {
            "free_uses_today": counter_as_of(F.col("free_uses_today"), F.col("last_free_use"), as_of),
            "pdf_tools_uses_today": counter_as_of(F.col("pdf_tools_uses_today"), F.col("pdf_tools_last_use"), as_of),
        }
    )


def ip_daily_usage(usage: DataFrame) -> DataFrame:
    """Free and tool uses per usable address and day; ``usage`` is (ip_address, ts, kind, user_id, email)."""
    last = F.struct("ts", "event_id")
    return (
        usage.withColumn("ip", T.usable_ip(F.col("ip_address")))
        .filter(F.col("ip").isNotNull())
        .groupBy("ip", F.to_date("ts").alias("usage_date"))
        .agg(
            F.count_if(F.col("kind") == "free").alias("free_process_count"),
            F.count_if(F.col("kind") == "tool").alias("tool_use_count"),
            F.max_by("user_id", last).alias("last_user_id"),
            F.max_by("email", last).alias("last_email"),
            F.max("ts").alias("updated_at"),
        )
    )


def _mode(free_uses: Column, ip_uses: Column) -> Column:
    """The admission ladder; the first rung that applies decides."""
    return (
        F.when(F.col("admin"), "admin")
        .when(F.col("by_credits"), "credits")
        .when(free_uses >= V.MAX_FREE_USES_DAY, "user_daily_limit")
        .when(F.col("ip").isNotNull() & (ip_uses >= V.MAX_FREE_USES_DAY), "ip_daily_limit")
        .when(F.col("file_size_mb") > V.MAX_FREE_FILE_SIZE_MB, "file_too_large")
        .when(F.col("pages_count") > V.MAX_FREE_PAGES, "too_many_pages")
        .otherwise("free")
    )


def admission(
    jobs: DataFrame, users: DataFrame, balances: DataFrame, ip_usage: DataFrame, as_of: str,
    admin_emails: tuple[str, ...] = (),
) -> DataFrame:
    """How each job would be admitted against the counters as they stand."""
    today = ip_usage.filter(F.col("usage_date") == F.to_date(at(as_of))).select("ip", "free_process_count")
    people = users.select(
        F.col("id").alias("user_id"),
        T.is_admin(F.col("role"), F.col("email"), admin_emails).alias("admin"),
        counter_as_of(F.col("free_uses_today"), F.col("last_free_use"), as_of).alias("free_uses"),
    ).join(balances.select("user_id", "available_mb"), "user_id", "left")
    covered = (F.col("available_mb") >= F.col("file_size_mb")) & (F.col("available_mb") > 0)
    judged = (
        jobs.withColumn("ip", T.usable_ip(F.col("ip_address")))
        .join(people, "user_id", "left")
        .join(today, "ip", "left")
        .withColumn("by_credits", F.coalesce(covered, F.lit(False)))
        .withColumn("known", F.col("free_uses").isNotNull())
        .withColumn("admin", F.coalesce("admin", F.lit(False)))
    )
    mode = _mode(F.coalesce("free_uses", F.lit(0)), F.coalesce("free_process_count", F.lit(0)))
    return judged.withColumn("mode", F.when(F.col("known"), mode).otherwise("unknown_user")).select(
        "id", "user_id", "ip", "file_size_mb", "pages_count", "mode"
    )


def admission_replay(
    jobs: DataFrame, users: DataFrame, balances: DataFrame, admin_emails: tuple[str, ...] = ()
) -> DataFrame:
    """Replay of a job log from empty daily counters, in order of (created_at, id).

    A free use needs a user and an address that are both unused that day, so acceptance depends on earlier
    acceptances through two keys. Rounds settle it without ordering a whole day in one task: a candidate
    that is the earliest left for its user and for its address is accepted, which bars the other candidates
    of both, and so are chains of candidates that wait for one other (``_free_winners``). Jobs of unknown users are
    answered ``unknown_user``.
    """
    people = users.select(
        F.col("id").alias("user_id"), T.is_admin(F.col("role"), F.col("email"), admin_emails).alias("admin")
    )
    known = jobs.join(people, "user_id")
    strangers = jobs.join(people, "user_id", "left_anti")
    paid = consume_credits(known.filter(~F.col("admin")), balances).filter("accepted").select("id")
    rest = cut_lineage(
        known.join(paid.withColumn("by_credits", F.lit(True)), "id", "left")
        .withColumn("by_credits", F.coalesce("by_credits", F.lit(False)))
        .withColumn("ip", T.usable_ip(F.col("ip_address")))
        .withColumn("day", F.to_date("created_at"))
        .withColumn("turn", F.struct("created_at", "id"))
    )
    waiting = rest.filter(~F.col("admin") & ~F.col("by_credits"))
    winners = _free_winners(
        waiting.filter(
            (F.col("file_size_mb") <= V.MAX_FREE_FILE_SIZE_MB)
            & ~F.coalesce(F.col("pages_count") > V.MAX_FREE_PAGES, F.lit(False))
        ).select("id", "user_id", "ip", "day", "turn")
    )
    by_user = winners.select("user_id", "day", F.col("turn").alias("user_turn"))
    by_ip = winners.filter("ip is not null").select("ip", "day", F.col("turn").alias("ip_turn"))
    free_uses = F.when(F.col("user_turn") < F.col("turn"), 1).otherwise(0)
    ip_uses = F.when(F.col("ip_turn") < F.col("turn"), 1).otherwise(0)
    replayed = (
        rest.join(by_user, ["user_id", "day"], "left")
        .join(by_ip, ["ip", "day"], "left")
        .select("id", "user_id", "ip", "file_size_mb", "pages_count", _mode(free_uses, ip_uses).alias("mode"))
    )
    return replayed.unionByName(
        strangers.select(
            "id", "user_id", T.usable_ip(F.col("ip_address")).alias("ip"), "file_size_mb", "pages_count", F.lit("unknown_user").alias("mode")
        )
    )


def _leading(rows: DataFrame, key: str, most: int = 2) -> DataFrame:
    """The first ``most`` rows of each (key, day): id, its rank there and the first id. The rank limit works before the shuffle."""
    window = Window.partitionBy(key, "day").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumns({"rank": F.row_number().over(window), "first": F.first("id").over(window)}).filter(F.col("rank") <= most)
    return ranked.select("id", F.col("rank").alias(f"{key}_rank"), F.col("first").alias(f"{key}_first"))


def _free_winners(candidates: DataFrame) -> DataFrame:
    """Candidates that win their user and address, in rounds.

    A candidate with nobody before it wins. One with exactly one candidate before it wins if that one loses, so such
    candidates form chains, and each chain is settled in one round: pointers are doubled until they reach its head,
    with the parity of the steps. A chain of n candidates takes log2 n doublings.
    """
    open_rows, accepted = candidates, None
    while True:
        ranked = open_rows.join(_leading(open_rows, "user_id"), "id", "left").join(_leading(open_rows.filter("ip is not null"), "ip"), "id", "left")
        by_user = F.coalesce("user_id_rank", F.lit(3))
        by_ip = F.when(F.col("ip").isNull(), 1).otherwise(F.coalesce("ip_rank", F.lit(3)))
        before = (
            F.when((by_user == 2) & (by_ip == 1), F.col("user_id_first"))
            .when((by_user == 1) & (by_ip == 2), F.col("ip_first"))
            .when((by_user == 2) & (by_ip == 2) & (F.col("user_id_first") == F.col("ip_first")), F.col("user_id_first"))
        )
        ranked = cut_lineage(ranked.select(*candidates.columns, ((by_user == 1) & (by_ip == 1)).alias("head"), before.alias("before")))
        heads = ranked.filter("head").select("id")
        follow = _chained(ranked.filter("before is not null").select("id", F.col("before").alias("to")))
        wins = heads.unionByName(follow.filter("even").join(heads.select(F.col("id").alias("to")), "to").select("id"))
        won = cut_lineage(ranked.select(*candidates.columns).join(wins, "id"))
        accepted = won if accepted is None else accepted.unionByName(won)
        open_rows = cut_lineage(
            ranked.select(*candidates.columns).join(won.select("user_id", "day"), ["user_id", "day"], "left_anti").join(
                won.filter("ip is not null").select("ip", "day"), ["ip", "day"], "left_anti"
            )
        )
        if open_rows.isEmpty():
            return accepted


def _chained(steps: DataFrame) -> DataFrame:
    """``steps`` (id, to) followed to the end: (id, to, even), whether an even number of steps leads there."""
    steps = cut_lineage(steps.withColumn("even", F.lit(False)))
    while True:
        onward = steps.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("even").alias("even_beyond"))
        met = cut_lineage(steps.join(onward, "to", "left"))
        moved = F.col("beyond").isNotNull()
        steps = met.select(
            "id", F.coalesce("beyond", "to").alias("to"), F.when(moved, F.col("even") == F.col("even_beyond")).otherwise(F.col("even")).alias("even")
        )
        if met.filter(moved).isEmpty():
            return steps


def tool_replay(
    uses: DataFrame, users: DataFrame, balances: DataFrame, admin_emails: tuple[str, ...] = ()
) -> DataFrame:
    """Replay of tool uses (id, user_id, ip_address, created_at) from empty daily counters, in order of (created_at, id).

    Admins and users with credits are ``unlimited`` and count nowhere. Another use is ``accepted`` while both its user
    and its address, if usable, have had fewer than the daily limit, and then counts for both; else it is ``refused``.
    In a round a use is accepted if the uses before it that are accepted or open leave room at both keys, and refused
    if accepted ones before it fill one. The earliest open use is always settled. A null user is bound by the address alone.
    """
    people = users.select(
        F.col("id").alias("user_id"), T.is_admin(F.col("role"), F.col("email"), admin_emails).alias("is_admin")
    ).join(balances.select("user_id", "available_mb"), "user_id", "left")
    unlimited = F.coalesce(F.col("is_admin") | F.coalesce(F.col("available_mb") > 0, F.lit(False)), F.lit(False))
    asked = cut_lineage(
        uses.join(people, "user_id", "left").select(
            "id", "user_id", T.usable_ip(F.col("ip_address")).alias("ip"), F.to_date("created_at").alias("day"),
            F.struct("created_at", "id").alias("turn"), unlimited.alias("unlimited"),
        )
    )
    accepted = _within_limit(asked.filter("not unlimited").drop("unlimited"), V.TOOL_LIMIT_DAY).select("id", F.lit(True).alias("within"))
    mode = F.when(F.col("unlimited"), "unlimited").when(F.col("within"), "accepted").otherwise("refused")
    return asked.join(accepted, "id", "left").select("id", "user_id", "ip", mode.alias("mode"))


def _taken(accepted: DataFrame, key: str) -> DataFrame:
    """Turns of the at most ``limit`` accepted uses per (key, day)."""
    return accepted.filter(F.col(key).isNotNull()).groupBy(key, "day").agg(F.collect_list("turn").alias(f"{key}_taken"))


def _within_limit(uses: DataFrame, limit: int) -> DataFrame:
    """The accepted ones of ``uses`` (id, user_id, ip, day, turn)."""
    columns, open_rows = uses.columns, uses
    accepted = uses.limit(0)

    def earlier(key: str) -> Column:
        return F.greatest(F.size(F.filter(f"{key}_taken", lambda turn: turn < F.col("turn"))), F.lit(0))

    while True:
        ranked = open_rows
        for key in ("user_id", "ip"):
            leading = _leading(open_rows.filter(F.col(key).isNotNull()), key, limit)
            ranked = ranked.join(leading, "id", "left").join(_taken(accepted, key), [key, "day"], "left")
        room = F.lit(True)
        for key in ("user_id", "ip"):
            room &= F.col(key).isNull() | (F.coalesce(f"{key}_rank", F.lit(limit + 1)) + earlier(key) <= limit)
        full = (earlier("user_id") >= limit) | (earlier("ip") >= limit)
        judged = cut_lineage(ranked.select(*columns, F.when(full, "full").when(room, "room").alias("verdict")))
        accepted = cut_lineage(accepted.unionByName(judged.filter("verdict = 'room'").select(*columns)))
        open_rows = judged.filter("verdict is null").select(*columns)
        if open_rows.isEmpty():
            return accepted


def charge(admitted: DataFrame) -> DataFrame:
    """MB charged per admitted job: its size for credits, nothing for admin and free use."""
    taken = admitted.filter(F.col("mode").isin("admin", "credits", "free"))
    return taken.select(
        "id",
        "user_id",
        "mode",
        F.when(F.col("mode") == "credits", F.round("file_size_mb", 2))
        .otherwise(F.lit(0))
        .cast("decimal(10,2)")
        .alias("charged_mb"),
        F.when(F.col("mode") == "free", 1).otherwise(0).alias("free_uses"),
        F.when((F.col("mode") == "free") & F.col("ip").isNotNull(), 1).otherwise(0).alias("ip_free_uses"),
    )


def tool_quota(
    users: DataFrame, balances: DataFrame, addresses: DataFrame, ip_usage: DataFrame, as_of: str,
    admin_emails: tuple[str, ...] = (),
) -> DataFrame:
    """Tool uses left today per user; ``addresses`` names each user's current address."""
    today = ip_usage.filter(F.col("usage_date") == F.to_date(at(as_of))).select("ip", "tool_use_count")
    own = counter_as_of(F.col("pdf_tools_uses_today"), F.col("pdf_tools_last_use"), as_of)
    joined = (
        users.select(
            F.col("id").alias("user_id"),
            T.is_admin(F.col("role"), F.col("email"), admin_emails).alias("is_admin"),
            own.alias("own_uses"),
        )
        .join(balances.select("user_id", "available_mb"), "user_id", "left")
        .join(addresses.select("user_id", T.usable_ip(F.col("ip_address")).alias("ip")), "user_id", "left")
        .join(today, "ip", "left")
        .withColumn("has_credits", F.coalesce(F.col("available_mb") > 0, F.lit(False)))
    )
    unlimited = F.col("is_admin") | F.col("has_credits")
    used = F.greatest(F.col("own_uses").cast("bigint"), F.coalesce("tool_use_count", F.lit(0)))
    return joined.select(
        "user_id",
        unlimited.alias("unlimited"),
        "has_credits",
        "is_admin",
        F.when(unlimited, F.lit(0)).otherwise(used).alias("used_today"),
        F.when(~unlimited, F.lit(V.TOOL_LIMIT_DAY)).alias("daily_limit"),
        F.when(~unlimited, F.greatest(V.TOOL_LIMIT_DAY - used, F.lit(0))).alias("remaining"),
    )


def grant_credits(requests: DataFrame, users: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Manual grants: their invoice transactions, audit rows, new balances, and requests naming nobody.

    ``requests`` is (request_id, email, credits_mb, amount_brl, note, days_valid, granted_by).
    """
    address = F.lower(T.strip_text(F.col("email")))
    asked = requests.withColumn("address", address).withColumn("days_valid", F.coalesce("days_valid", F.lit(V.CREDIT_VALID_DAYS)))
    people = users.select(F.col("id").alias("user_id"), F.lower("email").alias("address"))
    owner = people.groupBy("address").agg(F.min("user_id").alias("user_id"))
    valid = (
        F.col("credits_mb").between(1, 100_000)
        & (F.coalesce("amount_brl", F.lit(0)) >= 0)
        & F.col("days_valid").between(1, 3650)
    )
    matched = asked.filter(valid).join(owner, "address")
    payment_id = F.concat(F.lit(V.INVOICE_PREFIX), F.col("request_id").cast("string"))
    amount = F.round(F.coalesce("amount_brl", F.lit(0)), 2).cast("decimal(10,2)")
    transactions = matched.select(
        "user_id",
        amount.alias("amount_brl"),
        "credits_mb",
        F.lit("invoice").alias("payment_method"),
        payment_id.alias("payment_id"),
        F.lit("approved").alias("payment_status"),
        at(as_of).alias("created_at"),
        F.timestamp_add("DAY", F.col("days_valid"), at(as_of)).alias("expires_at"),
        F.to_json(F.struct(F.lit("admin_manual").alias("source"), "note", "granted_by")).alias("payment_metadata"),
    )
    grants = matched.select(
        "request_id", "user_id", "granted_by", "credits_mb", amount.alias("amount_brl"), "note",
        payment_id.alias("payment_id"),
    )
    gained = matched.groupBy("user_id").agg(F.sum(F.col("credits_mb").cast("bigint")).alias("granted_mb"))
    balances = users.join(gained, users["id"] == gained["user_id"]).select(
        users["id"].alias("user_id"),
        (F.coalesce("total_credits_mb", F.lit(0)) + F.col("granted_mb")).alias("total_credits_mb"),
        simple_balance(F.col("total_credits_mb") + F.col("granted_mb"), F.col("used_credits_mb")).alias("available_mb"),
    )
    rejected = asked.filter(~F.coalesce(valid, F.lit(False))).select("request_id", F.lit("invalid").alias("reason"))
    nobody = asked.filter(valid).join(owner, "address", "left_anti").select("request_id", F.lit("unknown_user").alias("reason"))
    return {
        "transactions": transactions,
        "grants": grants,
        "balances": balances,
        "rejected": rejected.unionByName(nobody),
    }


def role_backfill(users: DataFrame, admin_email: str) -> DataFrame:
    """Give the admin role to one address, compared without case."""
    named = F.lower("email") == admin_email.lower()
    return users.withColumn("role", F.when(named, "admin").otherwise(F.col("role")))


def net_amount_backfill(transactions: DataFrame) -> DataFrame:
    computed = F.greatest(F.col("amount_brl") - F.coalesce("fee_brl", F.lit(0)), F.lit(0)).cast("decimal(10,2)")
    return transactions.withColumn("net_amount_brl", F.coalesce("net_amount_brl", computed))


def signup_upsert(users: DataFrame, signups: DataFrame) -> DataFrame:
    """Users plus new sign-ups (id, email, metadata); a known id is left alone and a repeated one counts once."""
    arrived = signups.groupBy("id").agg(F.min_by(F.struct("email", "metadata"), "signup_ord").alias("first"))
    fresh = arrived.join(users.select("id"), "id", "left_anti").select(
        "id",
        "first.email",
        F.get_json_object("first.metadata", "$.display_name").alias("display_name"),
        F.get_json_object("first.metadata", "$.avatar_url").alias("avatar_url"),
        F.lit(0).alias("total_credits_mb"),
    )
    kept = users.select("id", "email", "display_name", F.lit(None).cast("string").alias("avatar_url"), "total_credits_mb")
    return kept.unionByName(fresh)
