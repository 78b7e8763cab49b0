"""Named queries: every operator over whole tables, as (session, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise import schemas
from pagewise.functions import text as T
from pagewise.functions import values as V
from pagewise.operators import classify as C
from pagewise.operators import grouping as G
from pagewise.operators import ledger as L
from pagewise.operators import manifest as M
from pagewise.operators import naming as N
from pagewise.operators import payments as P
from pagewise.operators import posts as B
from pagewise.operators import quality as Q
from pagewise.operators import refunds as R
from pagewise.plans import reports as A
from pagewise.session import SETTINGS, cut_lineage, shared_folder
from pagewise.sources import sinks as K
from pagewise.sources import tables as S
from pagewise.streaming import jobs as ST

Query = Callable[[SparkSession, str], DataFrame]

LEDGER_AS_OF = "2001-06-15 00:00:00"
USAGE_AS_OF = "2024-01-30 12:00:00"
RULES = S.SAMPLE_RULES
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def prepare(spark: SparkSession) -> SparkSession:
    """Run-time settings the queries expect; static ones belong to the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _page_value(**columns) -> Query:
    """A query giving text expressions per page."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        pages = C.with_text(S.corpus(spark, folder))
        return pages.select("doc_id", "page_number", *[column().alias(name) for name, column in columns.items()])

    return run


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return C.classify_pages(S.corpus(spark, folder), RULES)


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return G.group_pages(_classified(spark, folder))


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return N.filenames(_groups(spark, folder))


def _balances(spark: SparkSession, folder: str) -> DataFrame:
    """Small balances, so that consumption runs out for many users."""
    return S.users(spark, folder).select(F.col("id").alias("user_id"), ((F.col("id") * 13) % 90 - 5).alias("available_mb"))


def _ip_usage(spark: SparkSession, folder: str) -> DataFrame:
    return L.ip_daily_usage(S.usage(spark, folder))


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    return B.publish_state(S.post_edits(spark, folder))


# ---- sources and sinks ----


@query
def page_corpus(spark, folder):
    return S.corpus(spark, folder)


def _uploads(spark, folder):
    doc = F.col("doc_id")
    extension = F.when(doc % 10 == 3, ".txt").when(doc % 10 == 4, ".PDF").otherwise(".pdf")
    return S.read_table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("d"), doc.cast("string"), extension).alias("filename"),
        F.when(doc % 31 == 0, 0).otherwise(F.col("n_chars") * 2500).cast("bigint").alias("length"),
        F.when(doc % 37 == 1, 0).otherwise(F.size(F.split("text", "\n"))).alias("pages"),
    )


@query
def upload_admission(spark, folder):
    return L.upload_admission(_uploads(spark, folder), "vercel").select("doc_id", "filename", "admitted", "reason")


@query
def upload_size_mb(spark, folder):
    return _uploads(spark, folder).select("doc_id", L.upload_size_mb(F.col("length")).alias("file_size_mb"))


@query
def rules_table(spark, folder):
    """The shipped dictionary with the number of pages each rule is found on."""
    hits = (
        C.rule_matches(S.corpus(spark, folder), V.SHIPPED_RULES)
        .groupBy("rule_ord")
        .agg(F.countDistinct("doc_id", "page_number").alias("pages"))
    )
    return (
        C.rules_table(spark)
        .join(hits, "rule_ord", "left")
        .select(
            "rule_ord",
            "doc_type",
            F.array_join("patterns", "|").alias("patterns"),
            F.col("supplier_pattern").isNotNull().alias("has_supplier"),
            "confidence",
            F.coalesce("pages", F.lit(0).cast("bigint")).alias("pages"),
        )
    )


@query
def packages(spark, folder):
    return A.packages_by_use(P.packages(spark), S.transactions(spark, folder))


@query
def ledger_tables(spark, folder):
    return S.select_rows(
        S.jobs(spark, folder),
        ["id", "user_id", "filename", "file_size_mb", "created_at"],
        equal={"status": "completed"},
        within={"user_id": list(range(0, 150, 7))},
        newest_by=("created_at", "id"),
        limit=200,
    )


@query
def index_sink(spark, folder):
    path = _scratch(spark)
    index = N.index_report(_named(spark, folder))
    K.write_index(index, path, "csv")
    stored = spark.read.schema(index.schema).option("header", True).csv(path)
    return stored.toDF("doc_id", "number", "filename", "label", "supplier", "pages", "page_count", "review")


@query
def document_sink(spark, folder):
    path = _scratch(spark)
    K.write_documents(_named(spark, folder), S.corpus(spark, folder).select("doc_id", "page_number", "native_text"), path)
    return spark.read.parquet(path).select("doc_id", "filename", "page_number", "native_text")


@query
def cache_sink(spark, folder):
    path = _scratch(spark)
    K.save_cache(C.classify_distinct(S.corpus(spark, folder), RULES), path)
    return K.load_cache(spark, path).select("text_hash", "doc_type", "confidence", "source", "matched_pattern", "is_continuation")


def _job_events(spark, folder):
    return S.job_events_from(S.read_table(spark, folder, "events"))


@query
def job_ledger(spark, folder):
    return L.job_states(_job_events(spark, folder))


# ---- text ----

QUERIES["best_text"] = _page_value(text=lambda: F.col("text"))
QUERIES["normalize_text"] = _page_value(norm=lambda: F.col("norm"))
QUERIES["text_hash"] = _page_value(text_hash=lambda: T.text_hash(F.col("norm")))
QUERIES["looks_like_spreadsheet"] = _page_value(sheet=lambda: T.looks_like_spreadsheet(F.col("text")))
QUERIES["slugify"] = _page_value(slug=lambda: T.slugify(F.col("text")))


@query
def needs_ocr(spark, folder):
    return S.corpus(spark, folder).groupBy("doc_id").agg(F.count_if(T.needs_ocr(F.col("native_text"))).alias("needs_ocr_pages"))


@query
def extract_cnpj(spark, folder):
    pages = C.with_text(S.corpus(spark, folder))
    return pages.select("doc_id", "page_number", T.extract_cnpj(F.col("text")).alias("cnpj")).filter("cnpj is not null")


@query
def cnpj_base(spark, folder):
    return extract_cnpj(spark, folder).withColumn("base", T.cnpj_base(F.col("cnpj")))


def _with_markers(spark, folder):
    """Pages with a page marker built from their own numbers, so that every marker form is read."""
    page, doc = F.col("page_number").cast("string"), F.col("doc_id")
    total = (F.col("page_number") + doc % 4 - 1).cast("string")
    marker = (
        F.when(doc % 6 == 0, F.concat(F.lit(" Página "), page, F.lit(" de "), total))
        .when(doc % 6 == 1, F.concat(F.lit(" folha "), page, F.lit("/"), total))
        .when(doc % 6 == 2, F.concat(F.lit(" "), page, F.lit("de"), total, F.lit(" ")))
        .when(doc % 6 == 3, F.concat(F.lit(" 10 de 20 "), page, F.lit("de"), total))
        .when(doc % 6 == 4, F.lit(" continuação "))
        .otherwise("")
    )
    pages = C.with_text(S.corpus(spark, folder))
    return pages.withColumn("marked", T.normalize_text(F.concat("text", marker)))


@query
def page_x_of_y(spark, folder):
    return _with_markers(spark, folder).select("doc_id", "page_number", T.page_x_of_y(F.col("marked")).alias("m")).select(
        "doc_id", "page_number", F.col("m.current").alias("current_page"), F.col("m.total").alias("total_pages")
    )


@query
def is_continuation(spark, folder):
    return _with_markers(spark, folder).select("doc_id", "page_number", T.is_continuation(F.col("marked")).alias("continues"))


def _supplier_rows(spark, folder):
    return C.with_text(S.corpus(spark, folder)).select(
        "doc_id", "page_number", T.extract_supplier(F.col("text"), r"([a-z]{4,}tion(?:[ ,:-]+[a-z.]+){0,9})").alias("supplier")
    )


@query
def extract_supplier(spark, folder):
    return _supplier_rows(spark, folder).filter("supplier is not null")


@query
def clean_supplier(spark, folder):
    return extract_supplier(spark, folder).withColumn("cleaned", T.clean_supplier(F.col("supplier")))


@query
def supplier_compat(spark, folder):
    pairs = G.with_neighbours(_classified(spark, folder), previous=("page_number", "supplier", "cnpj"))
    return pairs.filter("prev_page_number is not null").select(
        "doc_id",
        "page_number",
        T.suppliers_compatible(F.col("supplier"), F.col("cnpj"), F.col("prev_supplier"), F.col("prev_cnpj")).alias("compatible"),
    )


@query
def blog_slug(spark, folder):
    return S.post_edits(spark, folder).filter("title is not null").select(
        "post_id", "edit_ord", T.blog_slug(F.col("title"), F.col("ts")).alias("slug")
    )


@query
def page_range(spark, folder):
    return _groups(spark, folder).select("doc_id", "group_seq", T.page_range(F.col("start_page"), F.col("end_page")).alias("pages"))


@query
def doc_type_label(spark, folder):
    """Labels of known types and of raw event and order words, which take the title-case path."""
    known = _classified(spark, folder).select("doc_type")
    other = S.read_table(spark, folder, "orders").select(F.replace("o_orderpriority", F.lit("-"), F.lit("_")).alias("doc_type"))
    counted = known.union(other).groupBy("doc_type").agg(F.count("*").alias("pages"))
    return counted.withColumn("label", T.doc_type_label(F.col("doc_type")))


@query
def is_viasat(spark, folder):
    return _classified(spark, folder).select(
        "doc_id", "page_number", T.is_viasat(F.col("doc_type"), F.col("supplier"), F.col("matched_pattern")).alias("satellite")
    )


def _addresses(spark, folder):
    key, user = F.col("event_id"), (F.col("user_id") % 50).cast("string")
    forms = F.array(
        F.concat(F.lit("10.0.0."), user), F.concat(F.lit(" 200.10.0."), user), F.concat(F.lit("192.168.0."), user),
        F.concat(F.lit("FC00::"), user), F.lit("localhost"), F.lit(""), F.concat(F.lit("172.16.0."), user), F.lit("Unknown"),
    )
    return S.read_table(spark, folder, "events").select("event_id", "user_id", F.element_at(forms, (key % 8 + 1).cast("int")).alias("ip_address"))


@query
def usable_ip(spark, folder):
    return _addresses(spark, folder).select("event_id", T.usable_ip(F.col("ip_address")).alias("ip"))


@query
def client_ip(spark, folder):
    key = F.col("event_id")
    proxy = F.when(key % 3 == 0, F.col("ip_address"))
    forwarded = F.when(key % 3 != 2, F.concat("ip_address", F.lit(" , 10.1.1.1")))
    peer = F.when(key % 4 != 0, F.concat(F.lit("peer"), F.col("user_id").cast("string")))
    return _addresses(spark, folder).select("event_id", T.client_ip(proxy, forwarded, peer).alias("client_ip"))


@query
def is_admin(spark, folder):
    return S.users(spark, folder).select(
        "id", T.is_admin(F.col("role"), F.col("email"), ("customer#000000007@example.com",)).alias("admin")
    )


@query
def page_request_text(spark, folder):
    return C.fallback_requests(S.corpus(spark, folder), RULES).select("doc_id", "page_number", "request")


# ---- classification ----


@query
def rule_matches(spark, folder):
    return C.rule_matches(S.corpus(spark, folder), RULES)


@query
def page_rule_theta(spark, folder):
    """Pages per pattern of the page-and-pattern match."""
    return rule_matches(spark, folder).groupBy("rule_ord", "pattern_ord", "pattern").agg(
        F.count("*").alias("pages"), F.countDistinct("doc_id").alias("documents")
    )


def _user_rules(spark, folder):
    """A rule per benchmark passage: its beginning and a piece from its middle."""
    item = F.col("item_id")
    return S.read_table(spark, folder, "benchmark").select(
        item.alias("rule_ord"),
        F.concat(F.lit("item_"), (item % 50).cast("string")).alias("doc_type"),
        F.array(F.substring("text", 1, 20), F.substring("text", 31, 8)).alias("patterns"),
        ((item % 40).cast("double") / 100 + 0.5).alias("confidence"),
    )


@query
def rule_table_matches(spark, folder):
    """Pages per pattern of a rule table."""
    matches = C.indexed_matches(S.corpus(spark, folder), _user_rules(spark, folder))
    return matches.groupBy("rule_ord", "pattern_ord", "pattern").agg(F.count("*").alias("pages"))


@query
def rule_table_winners(spark, folder):
    return C.strongest_match(C.indexed_matches(S.corpus(spark, folder), _user_rules(spark, folder)))


@query
def classify_rules(spark, folder):
    return C.apply_rules(S.corpus(spark, folder), RULES).select(
        "doc_id", "page_number", "doc_type", "confidence", "matched_pattern", "is_continuation", "cnpj"
    )


@query
def classify_supplier(spark, folder):
    return C.apply_rules(S.corpus(spark, folder), RULES).select("doc_id", "page_number", "doc_type", "supplier")


@query
def classify_enrich(spark, folder):
    enriched = _classified(spark, folder)
    return enriched.select("doc_id", "page_number", "doc_type", "confidence", "matched_pattern", "cnpj")


@query
def classify_pages(spark, folder):
    return _classified(spark, folder)


@query
def fallback_requests(spark, folder):
    return C.fallback_requests(S.corpus(spark, folder), RULES).select(
        "doc_id", "page_number", "previous_doc_type", "previous_supplier", F.length("request").alias("request_length")
    )


@query
def fallback_parse(spark, folder):
    return C.parse_responses(S.responses(spark, folder))


def _merged(spark, folder):
    return C.classify_pages(S.corpus(spark, folder), RULES, C.parse_responses(S.responses(spark, folder)))


@query
def fallback_merge(spark, folder):
    return _merged(spark, folder)


@query
def classify_distinct(spark, folder):
    return C.classify_distinct(S.corpus(spark, folder), RULES)


@query
def classify_stats(spark, folder):
    return C.classify_stats(_classified(spark, folder))


@query
def rule_candidates(spark, folder):
    return C.rule_candidates(_merged(spark, folder))


# ---- grouping ----


@query
def group_features(spark, folder):
    return G.group_features(_classified(spark, folder)).select(
        "doc_id", "page_number", "prev_doc_type", "prev_supplier", "next_doc_type", "is_first", "alone", "satellite",
        "same_multipage", "chain_before_invoice",
    )


@query
def back_of_bill(spark, folder):
    return G.group_features(_classified(spark, folder)).select("doc_id", "page_number", "back_of_bill")


@query
def group_pages(spark, folder):
    return G.assign_groups(_classified(spark, folder)).select("doc_id", "page_number", "doc_type", "group_seq")


@query
def should_group_pairwise(spark, folder):
    return G.should_group_pairwise(_classified(spark, folder))


@query
def build_groups(spark, folder):
    return _groups(spark, folder).select("doc_id", "group_seq", "start_page", "end_page", "needs_review")


@query
def pick_doc_type(spark, folder):
    return _groups(spark, folder).select("doc_id", "group_seq", "doc_type")


@query
def pick_supplier(spark, folder):
    return _groups(spark, folder).select("doc_id", "group_seq", "supplier")


@query
def coverage_check(spark, folder):
    """Coverage of deliberately damaged groups: dropped, widened, inverted, and documents without any."""
    groups = cut_lineage(_groups(spark, folder)).filter((F.col("doc_id") % 17 != 3) & ~((F.col("doc_id") % 5 == 1) & (F.col("group_seq") == 2)))
    damaged = groups.withColumn(
        "end_page",
        F.when((F.col("doc_id") % 7 == 2) & (F.col("group_seq") % 3 == 1), F.col("end_page") + 1)
        .when((F.col("doc_id") % 11 == 4) & (F.col("group_seq") == 1), F.col("start_page") - 1)
        .otherwise(F.col("end_page")),
    )
    totals = S.corpus(spark, folder).groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))
    return G.coverage_check(damaged, totals)


@query
def filenames(spark, folder):
    return _named(spark, folder).select("doc_id", "group_seq", "filename")


@query
def index_report(spark, folder):
    return N.index_report(_named(spark, folder)).toDF(
        "doc_id", "number", "filename", "label", "supplier", "pages", "page_count", "review"
    )


@query
def result_stats(spark, folder):
    return G.result_stats(_groups(spark, folder))


@query
def index_search(spark, folder):
    return N.index_search(_named(spark, folder), "Fiscal").select("doc_id", "group_seq", "filename")


@query
def group_text_fields(spark, folder):
    """Fields of each group, from page texts that also carry an amount and two dates."""
    page, doc = F.col("page_number"), F.col("doc_id")
    date = F.format_string("%02d/%02d/2025", (doc % 28 + 1).cast("int"), (page % 12 + 1).cast("int"))
    amount = F.format_string("%d,%02d", (doc % 1000).cast("int"), (page % 100).cast("int"))
    extra = F.concat(
        F.when(page % 3 == 0, F.concat(F.lit(" Valor R$ "), amount)).otherwise(""),
        F.when(page % 4 == 0, F.concat(F.lit(" Vencimento: "), date)).otherwise(""),
        F.when(page % 5 == 0, F.concat(F.lit(" data do pagamento em "), date)).otherwise(""),
    )
    pages = S.corpus(spark, folder)
    marked = pages.withColumn("ocr_text", F.concat(T.best_text(F.col("ocr_text"), F.col("native_text")), extra))
    texts = C.with_text(marked).select("doc_id", "page_number", "text")
    grouped = G.group_pages_range(_groups(spark, folder).select("doc_id", "group_seq", "start_page", "end_page"), texts)
    return N.group_text_fields(grouped)


@query
def group_pages_range(spark, folder):
    groups = _groups(spark, folder).select("doc_id", "group_seq", "start_page", "end_page")
    pages = S.corpus(spark, folder).select("doc_id", "page_number")
    return G.group_pages_range(groups, pages).select("doc_id", "group_seq", "page_number")


# ---- page manifest ----


def _manifest(spark, folder):
    return S.corpus(spark, folder).select("doc_id", "page_number")


def _merge_requests(spark, folder):
    """Merges of ten documents each in reverse order; every eleventh merge names a single file."""
    requests = S.read_table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 10).cast("bigint").alias("merge_id"), (9 - F.col("doc_id") % 10).cast("int").alias("file_ord"), "doc_id"
    )
    return requests.filter("merge_id % 11 != 5 or file_ord = 4")


@query
def merge_docs(spark, folder):
    return M.merge_docs(_manifest(spark, folder), _merge_requests(spark, folder))


def _split_requests(spark, folder):
    doc = F.col("doc_id")
    ranges = F.when(doc % 5 == 1, "1-2, 2").when(doc % 5 == 2, "1-2-3,1").when(doc % 5 == 3, "2").when(doc % 5 == 4, "1-x").otherwise(F.lit(None).cast("string"))
    return S.read_table(spark, folder, "documents").select("doc_id", ranges.alias("ranges"))


@query
def split_ranges(spark, folder):
    return M.split_ranges(_manifest(spark, folder), _split_requests(spark, folder))


@query
def parse_ranges(spark, folder):
    return M.split_requests(_manifest(spark, folder), _split_requests(spark, folder))


def _delete_requests(spark, folder):
    doc = F.col("doc_id")
    return S.read_table(spark, folder, "documents").select(
        "doc_id", F.explode(F.when(doc % 3 == 0, F.array(F.lit(1), F.lit(3))).when(doc % 3 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(0)))).alias("page_number")
    )


@query
def delete_pages(spark, folder):
    return M.delete_pages(_manifest(spark, folder), _delete_requests(spark, folder))


def _reorder_requests(spark, folder):
    size = F.size(F.split("text", "\n"))
    order = F.when(F.col("doc_id") % 4 == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.reverse(F.sequence(F.lit(1), size)))
    return S.read_table(spark, folder, "documents").select("doc_id", order.alias("page_order"))


@query
def reorder_pages(spark, folder):
    return M.reorder_pages(_manifest(spark, folder), _reorder_requests(spark, folder))


@query
def page_request_errors(spark, folder):
    """Every refused merge, deletion and reordering with its reason."""
    pages = _manifest(spark, folder)
    refused = {
        "merge": M.merge_errors(pages, _merge_requests(spark, folder)).withColumnRenamed("merge_id", "id"),
        "delete": M.delete_errors(pages, _delete_requests(spark, folder)).withColumnRenamed("doc_id", "id"),
        "reorder": M.reorder_errors(pages, _reorder_requests(spark, folder)).withColumnRenamed("doc_id", "id"),
    }
    parts = [rows.select(F.lit(kind).alias("request"), "id", "error") for kind, rows in refused.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def number_pages(spark, folder):
    return M.number_pages(_manifest(spark, folder).filter("page_number % 4 != 2"))


def _metadata(spark, folder):
    return S.read_table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("author"), F.col("lang").alias("subject")
    )


@query
def metadata_overlay(spark, folder):
    updates = S.read_table(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "revisado").otherwise("").alias("title"),
        F.when(F.col("toxic") == 1, "moderador").alias("author"),
        F.lit("").alias("subject"),
    )
    return M.metadata_overlay(_metadata(spark, folder), updates)


@query
def doc_info(spark, folder):
    return M.doc_info(_manifest(spark, folder), _metadata(spark, folder))


@query
def pick_line(spark, folder):
    return M.pick_line(S.page_lines(spark, folder), S.corrections(spark, folder))


@query
def apply_text_corrections(spark, folder):
    return M.apply_text_corrections(S.page_lines(spark, folder), S.corrections(spark, folder))


@query
def correction_errors(spark, folder):
    pages = S.page_lines(spark, folder).groupBy("doc_id").agg(F.max("page_number").alias("total_pages"))
    return M.correction_errors(S.page_lines(spark, folder), S.corrections(spark, folder), pages)


# ---- joins and sets ----


@query
def jobs_with_email(spark, folder):
    return A.jobs_with_email(S.jobs(spark, folder), S.users(spark, folder)).select("id", "user_id", "filename", "status", "user_email")


@query
def grants_enriched(spark, folder):
    return A.grants_enriched(S.grants(spark, folder), S.users(spark, folder))


@query
def refunds_enriched(spark, folder):
    return A.refunds_enriched(S.refund_log(spark, folder), S.users(spark, folder))


@query
def transactions_enriched(spark, folder):
    return A.transactions_enriched(S.transactions(spark, folder), S.users(spark, folder)).select(
        "id", "user_id", "amount_brl", "user_email", "package_id", "source", "user_available_mb", "is_invoice"
    )


@query
def user_dashboard_join(spark, folder):
    """Users with every job, users without jobs included."""
    return A.users_with_jobs(S.users(spark, folder), S.jobs(spark, folder))


@query
def signup_upsert(spark, folder):
    order = F.col("o_orderkey")
    metadata = F.concat(F.lit('{"display_name":"n'), order.cast("string"), F.lit('","avatar_url":"a'), (order % 9).cast("string"), F.lit('"}'))
    signups = S.read_table(spark, folder, "orders").select(
        (F.col("o_custkey") + F.when(order % 2 == 0, 0).otherwise(1_000_000)).alias("id"),
        F.concat(F.lit("s"), order.cast("string"), F.lit("@example.com")).alias("email"),
        metadata.alias("metadata"),
        order.alias("signup_ord"),
    )
    return L.signup_upsert(S.users(spark, folder), signups)


@query
def referenced_users(spark, folder):
    return A.referenced_users(S.grants(spark, folder))


# ---- reports ----


@query
def user_dashboard(spark, folder):
    return A.user_dashboard(S.users(spark, folder), S.transactions(spark, folder), S.jobs(spark, folder), LEDGER_AS_OF)


@query
def available_credits(spark, folder):
    return L.available_credits(S.users(spark, folder), S.transactions(spark, folder), LEDGER_AS_OF)


@query
def simple_balance(spark, folder):
    return S.users(spark, folder).select("id", L.simple_balance(F.col("total_credits_mb"), F.col("used_credits_mb")).alias("available_mb"))


@query
def paid_accounts(spark, folder):
    accounts = A.paid_accounts(S.transactions(spark, folder), S.users(spark, folder), S.jobs(spark, folder))
    return accounts.withColumn("methods", F.array_join("methods", ","))


@query
def invoiced_accounts(spark, folder):
    accounts = A.invoiced_accounts(S.transactions(spark, folder), S.users(spark, folder), S.jobs(spark, folder))
    return accounts.withColumn("notes", F.array_join("notes", "|"))


@query
def finance_summary(spark, folder):
    return A.finance_summary(S.transactions(spark, folder), S.users(spark, folder))


@query
def credits_in_circulation(spark, folder):
    return A.credits_in_circulation(S.users(spark, folder))


@query
def recent_usage_by_user(spark, folder):
    return A.recent_usage_by_user(S.jobs(spark, folder), None)


@query
def ip_daily_usage(spark, folder):
    return _ip_usage(spark, folder)


@query
def job_summary(spark, folder):
    return A.job_summary(S.jobs(spark, folder))


@query
def ocr_coverage(spark, folder):
    return A.ocr_coverage(S.corpus(spark, folder))


@query
def last_jobs_per_user(spark, folder):
    listed = A.last_jobs_per_user(S.jobs(spark, folder), None)
    return listed.select(
        "user_id", F.array_join(F.transform("last_jobs", lambda job: F.concat_ws(":", job["filename"], job["status"])), ",").alias("last_jobs")
    )


@query
def users_search(spark, folder):
    return A.users_search(S.users(spark, folder), "0009", 100).select("id", "email", "role", "available_mb", "created_at")


@query
def recent_grants(spark, folder):
    return A.recent_grants(S.grants(spark, folder), S.users(spark, folder))


@query
def ip_usage_today(spark, folder):
    return A.ip_usage_today(_ip_usage(spark, folder), USAGE_AS_OF)


@query
def admin_logs(spark, folder):
    logs = A.admin_logs(S.jobs(spark, folder), S.grants(spark, folder), _ip_usage(spark, folder), S.users(spark, folder), USAGE_AS_OF, 100)
    rows = logs["jobs"].select(F.lit("job").alias("part"), F.col("id").cast("string").alias("ref"), "user_email")
    failed = logs["failed_jobs"].select(F.lit("failed").alias("part"), F.col("id").cast("string").alias("ref"), "user_email")
    given = logs["grants"].select(F.lit("grant").alias("part"), F.col("id").cast("string").alias("ref"), "user_email")
    seen = logs["ip_usage"].select(F.lit("ip").alias("part"), F.col("ip").alias("ref"), F.col("last_email").alias("user_email"))
    return rows.union(failed).union(given).union(seen)


@query
def transactions_search(spark, folder):
    return A.transactions_search(S.transactions(spark, folder), S.users(spark, folder), "Invoice_", 100).select("id", "payment_id", "user_email", "created_at")


@query
def job_history(spark, folder):
    return A.job_history(S.jobs(spark, folder)).select("user_id", "rank", "id", "filename", "status")


@query
def blog_list(spark, folder):
    posts = _posts(spark, folder)
    public = A.published_scope(B.blog_list(posts)).select(F.lit("public").alias("part"), "post_id", "slug")
    return public.union(B.blog_list(posts, True).select(F.lit("drafts").alias("part"), "post_id", "slug"))


@query
def accounts_order(spark, folder):
    paid = A.order_paid(A.paid_accounts(S.transactions(spark, folder), S.users(spark, folder), S.jobs(spark, folder)))
    return paid.select("user_id", "active_paid", "available_mb", "email")


@query
def row_scope(spark, folder):
    jobs = A.row_scope(S.jobs(spark, folder), 42).select(F.lit("job").alias("part"), "id", "user_id")
    bought = A.row_scope(S.transactions(spark, folder), 42).select(F.lit("transaction").alias("part"), "id", "user_id")
    own = A.row_scope(S.users(spark, folder), 42, "id").select(F.lit("user").alias("part"), "id", F.col("id").alias("user_id"))
    return jobs.union(bought).union(own)


# ---- ledger ----


@query
def counter_as_of(spark, folder):
    return L.reset_daily_counters(S.users(spark, folder), USAGE_AS_OF).select("id", "free_uses_today", "pdf_tools_uses_today")


@query
def consume_credits(spark, folder):
    return L.consume_credits(S.jobs(spark, folder), _balances(spark, folder))


@query
def running_balance(spark, folder):
    spent = L.consume_credits(S.jobs(spark, folder), _balances(spark, folder))
    return L.used_after(S.users(spark, folder), spent)


@query
def admission(spark, folder):
    return L.admission(S.jobs(spark, folder), S.users(spark, folder), _balances(spark, folder), _ip_usage(spark, folder), USAGE_AS_OF)


@query
def admission_replay(spark, folder):
    return L.admission_replay(S.jobs(spark, folder), S.users(spark, folder), _balances(spark, folder))


@query
def charge(spark, folder):
    return L.charge(admission(spark, folder))


@query
def tool_quota(spark, folder):
    addresses = S.jobs(spark, folder).groupBy("user_id").agg(F.max_by("ip_address", F.struct("created_at", "id")).alias("ip_address"))
    balances = _balances(spark, folder).withColumn("available_mb", F.when(F.col("user_id") % 2 == 0, F.col("available_mb")).otherwise(0))
    return L.tool_quota(S.users(spark, folder), balances, addresses, _ip_usage(spark, folder), USAGE_AS_OF)


@query
def tool_replay(spark, folder):
    uses = S.usage(spark, folder).filter("kind = 'tool'").select(F.col("event_id").alias("id"), "user_id", "ip_address", F.col("ts").alias("created_at"))
    return L.tool_replay(uses, S.users(spark, folder), _balances(spark, folder))


def _grant_requests(spark, folder):
    key = F.col("o_orderkey")
    number = F.lpad((F.col("o_custkey") * F.when(key % 20 == 0, 9999).otherwise(1)).cast("string"), 9, "0")
    return S.read_table(spark, folder, "orders").filter("o_orderpriority = '5-LOW'").select(
        key.alias("request_id"),
        F.concat(F.when(key % 2 == 0, " CUSTOMER#").otherwise("customer#"), number, F.lit("@Example.com ")).alias("email"),
        (F.floor(F.col("o_totalprice") / 100) - 300).cast("int").alias("credits_mb"),
        S._cents(F.col("o_totalprice") / 10).alias("amount_brl"),
        F.when(key % 3 == 0, F.concat(F.lit("n"), key.cast("string"))).alias("note"),
        F.when(key % 4 != 0, (key % 400).cast("int")).alias("days_valid"),
        F.lit(0).cast("bigint").alias("granted_by"),
    )


@query
def grant_credits(spark, folder):
    made = L.grant_credits(_grant_requests(spark, folder), S.users(spark, folder), LEDGER_AS_OF)
    none = F.lit(None)
    booked = made["transactions"].select(
        F.lit("transaction").alias("part"), F.col("payment_id").alias("ref"), "user_id", F.col("credits_mb").cast("bigint").alias("credits_mb"), "expires_at"
    )
    audit = made["grants"].select(
        F.lit("grant").alias("part"), F.coalesce("note", F.lit("-")).alias("ref"), "user_id", F.col("credits_mb").cast("bigint").alias("credits_mb"), none.cast("timestamp_ntz").alias("expires_at")
    )
    totals = made["balances"].select(
        F.lit("balance").alias("part"), F.col("available_mb").cast("string").alias("ref"), "user_id", F.col("total_credits_mb").alias("credits_mb"), none.cast("timestamp_ntz").alias("expires_at")
    )
    refused = made["rejected"].select(
        F.lit("rejected").alias("part"), F.concat_ws(":", F.col("request_id").cast("string"), "reason").alias("ref"), none.cast("bigint").alias("user_id"), none.cast("bigint").alias("credits_mb"), none.cast("timestamp_ntz").alias("expires_at")
    )
    return booked.union(audit).union(totals).union(refused)


@query
def signup_role_backfill(spark, folder):
    return L.role_backfill(S.users(spark, folder), "Customer#000000033@EXAMPLE.com").select("id", "role")


@query
def net_amount_backfill(spark, folder):
    return L.net_amount_backfill(S.transactions(spark, folder)).select("id", "net_amount_brl")


@query
def publish_state(spark, folder):
    return _posts(spark, folder)


# ---- payments and refunds ----


def _notice_bodies(spark, folder):
    key = F.col("o_orderkey")
    text = key.cast("string")
    body = (
        F.when(key % 7 == 0, F.concat(F.lit('{"data":{"id":"'), text, F.lit('"},"type":"payment"}')))
        .when(key % 7 == 1, F.concat(F.lit('{"id":'), text, F.lit(',"topic":"merchant_order_wh"}')))
        .when(key % 7 == 2, F.concat(F.lit('{"data":{"id":"abc"},"id":" '), text, F.lit(' "}')))
        .when(key % 7 == 3, F.concat(F.lit('{"data.id":"'), text, F.lit('"}')))
        .when(key % 7 == 4, F.lit('{"data":"x"}'))
    )
    filled = F.when(key % 7 == 5, F.create_map(F.lit("topic"), F.lit("payment"), F.lit("id"), text)).when(
        key % 7 == 4, F.create_map(F.lit("payment_id"), text)
    )
    return S.read_table(spark, folder, "orders").select(key.alias("notice_id"), body.alias("body"), filled.alias("query"))


@query
def notification_id(spark, folder):
    return _notice_bodies(spark, folder).select("notice_id", P.notification_id(F.col("body"), F.col("query")).alias("payment_id"))


def _parsed(spark, folder):
    return P.parse_payments(S.notices(spark, folder))


@query
def payment_parse(spark, folder):
    return _parsed(spark, folder).select("payment_id", "ts", "status", "user_id", "package_id", "credits_mb", "payment_method")


@query
def payment_fee(spark, folder):
    return _parsed(spark, folder).select("payment_id", "ts", "amount_brl", "fee_brl", "net_amount_brl")


@query
def fulfil_payments(spark, folder):
    return P.fulfil_payments(_parsed(spark, folder))


@query
def unmatched_payments(spark, folder):
    return P.unmatched_payments(_parsed(spark, folder))


@query
def user_balances(spark, folder):
    paid = P.fulfil_payments(_parsed(spark, folder)).select(F.col("user_id").cast("bigint").alias("user_id"), "credited_mb")
    return P.user_balances(paid, S.grants(spark, folder), S.refund_log(spark, folder))


@query
def method_deducts_fee(spark, folder):
    kind = F.when(F.col("id") % 5 == 0, "debit_card").when(F.col("id") % 5 == 1, "bank")
    return S.transactions(spark, folder).select("id", R.method_deducts_fee(F.col("payment_method"), kind).alias("deducts"))


@query
def is_invoice(spark, folder):
    method = F.when(F.col("id") % 9 == 0, "Faturado").otherwise(F.col("payment_method"))
    return S.transactions(spark, folder).select(
        "id", R.is_invoice(method, F.col("payment_id")).alias("invoice"), R.is_invoice_for_preview(method, F.col("payment_id")).alias("preview_invoice")
    )


@query
def refund_preview(spark, folder):
    shown = R.refund_preview(S.transactions(spark, folder), S.users(spark, folder), S.provider_payments(spark, folder))
    return shown.withColumn("block_reasons", F.array_join("block_reasons", " "))


@query
def refund_apply(spark, folder):
    return R.refund_apply(S.refund_requests(spark, folder), S.transactions(spark, folder), S.users(spark, folder), S.provider_payments(spark, folder))


@query
def refund_refusals(spark, folder):
    refused = R.refund_refusals(S.refund_requests(spark, folder), S.transactions(spark, folder), S.users(spark, folder), S.provider_payments(spark, folder))
    return refused.withColumn("block_reasons", F.array_join("block_reasons", " "))


@query
def constraint_checks(spark, folder):
    return Q.constraint_checks(
        S.users(spark, folder), S.transactions(spark, folder), S.jobs(spark, folder), S.grants(spark, folder),
        S.refund_log(spark, folder), _ip_usage(spark, folder), _posts(spark, folder),
    )


# ---- streams ----


@query
def stream_fulfil(spark, folder):
    orders = ST.read_table_stream(spark, folder, "orders", schemas.ORDERS)
    return ST.drain(ST.stream_fulfil(S.notices_from(orders)), ["payment_id"])


@query
def stream_ip_usage(spark, folder):
    events = ST.read_table_stream(spark, folder, "events", schemas.EVENTS)
    return ST.drain(ST.stream_ip_usage(S.usage_from_events(events)), ["ip", "usage_date"])


@query
def stream_job_state(spark, folder):
    events = ST.read_table_stream(spark, folder, "events", schemas.EVENTS)
    return ST.drain(ST.stream_job_state(S.job_events_from(events)), ["job_id"])


@query
def stream_classify(spark, folder):
    documents = ST.read_table_stream(spark, folder, "documents", schemas.DOCUMENTS)
    pages = S.pages_from_text(documents).withColumn("ocr_text", F.lit(None).cast("string"))
    return ST.drain(ST.stream_classify(pages, RULES))


def named_queries() -> dict[str, Query]:
    def bound(function: Query) -> Query:
        return lambda spark, folder: function(prepare(spark), folder)

    return {name: bound(function) for name, function in QUERIES.items()}
