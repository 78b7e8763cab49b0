"""File names and the index of exported documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import text as T
from pagewise.functions import values as V
from pagewise.operators.ordered import in_first_block, position_in_key
from pagewise.session import cut_lineage


def filenames(groups: DataFrame) -> DataFrame:
    """Add ``filename``: sequence, type, supplier and a copy number for repeated type and supplier.

    Counting copies passes twice over the groups, so they are stored first; they are small beside the text.
    """
    groups = cut_lineage(groups)
    named = groups.withColumn("type_slug", T.slugify(F.col("doc_type"))).withColumn(
        "name_key", F.coalesce(F.nullif(F.col("supplier"), F.lit("")), F.lit("none"))
    )
    counted = position_in_key(named, ["doc_id", "type_slug", "name_key"], "group_seq", "copy", short=in_first_block(groups, F.col("group_seq")))
    has_supplier = F.col("supplier").isNotNull() & (F.col("supplier") != "")
    return counted.withColumn(
        "filename",
        F.concat(
            F.concat_ws(
                "_",
                F.format_string("%02d", F.col("group_seq")),
                F.col("type_slug"),
                F.when(has_supplier, F.substring(T.slugify(F.col("supplier")), 1, 40)),
                F.when(F.col("copy") > 1, F.concat(F.lit("via"), F.col("copy").cast("string"))),
            ),
            F.lit(".pdf"),
        ),
    ).drop("type_slug", "name_key", "copy")


def index_report(named: DataFrame) -> DataFrame:
    """The seven index columns, keyed by document."""
    number, filename, label, supplier, page_range, count, review = V.INDEX_COLUMNS
    return named.select(
        "doc_id",
        F.col("group_seq").alias(number),
        F.col("filename").alias(filename),
        T.doc_type_label(F.col("doc_type")).alias(label),
        F.coalesce(F.nullif(F.col("supplier"), F.lit("")), F.lit("N/A")).alias(supplier),
        T.page_range(F.col("start_page"), F.col("end_page")).alias(page_range),
        (F.col("end_page") - F.col("start_page") + 1).alias(count),
        F.when(F.col("needs_review"), "Sim").otherwise("Não").alias(review),
    )


def index_search(named: DataFrame, query: str) -> DataFrame:
    """Index rows whose file name, label or supplier contains ``query``; an empty query keeps all."""
    needle = query.lower().strip()
    if not needle:
        return named
    haystack: Column = F.concat_ws(
        " ", "filename", T.doc_type_label(F.col("doc_type")), F.coalesce("supplier", F.lit(""))
    )
    return named.filter(F.lower(haystack).contains(needle))


# Fields read from the joined text of a group.
_AMOUNT = r"R\$\s*(\d{1,3}(?:\.\d{3})*,\d{2})"
_DUE = r"(?i)vencimento\D{0,20}(\d{2}/\d{2}/\d{4})"
_PAID = r"(?i)pagamento\D{0,20}(\d{2}/\d{2}/\d{4})"


def group_text_fields(grouped_pages: DataFrame) -> DataFrame:
    """Main amount, due date, payment date and tax id of each group, from its pages in order.

    Each field is the first one found page by page, so the page texts need not be concatenated and a
    group of any length reduces through partial aggregates.
    """
    text = F.col("text")

    def first_of(pattern: str) -> Column:
        hit = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        return F.min_by(hit, F.when(hit.isNotNull(), F.col("page_number")))

    cnpj = T.extract_cnpj(text)
    return grouped_pages.groupBy("doc_id", "group_seq").agg(
        first_of(_AMOUNT).alias("amount"),
        first_of(_DUE).alias("due_date"),
        first_of(_PAID).alias("paid_date"),
        F.min_by(cnpj, F.when(cnpj.isNotNull(), F.col("page_number"))).alias("cnpj"),
        F.sum(F.length(text)).alias("text_length"),
    )
