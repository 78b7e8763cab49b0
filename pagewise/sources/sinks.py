"""Writers for the index, the separated documents and the classification cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.operators.classify import cache_rows
from pagewise.operators.grouping import coverage_check, group_pages_range
from pagewise.session import cut_lineage

INDEX_FORMATS = ("csv", "parquet")
CACHE_SCHEMA = (
    "text_hash STRING, doc_type STRING, supplier STRING, confidence DOUBLE, source STRING, matched_pattern STRING, "
    "is_continuation BOOLEAN, cnpj STRING"
)


def write_index(index: DataFrame, path: str, kind: str = "csv") -> None:
    """Write the index as CSV with a header, or as Parquet; any other format is an error."""
    kind = kind.lower()
    if kind not in INDEX_FORMATS:
        raise ValueError(f"unsupported index format: {kind}; use one of {', '.join(INDEX_FORMATS)}")
    writer = index.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("quoteAll", True).csv(path)
    else:
        writer.parquet(path)


def document_rows(named: DataFrame, pages: DataFrame) -> DataFrame:
    """Page rows of every output document, for documents whose groups cover all pages exactly once."""
    named = cut_lineage(named)
    totals = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))
    broken = coverage_check(named, totals).select("doc_id").distinct()
    whole = named.join(broken, "doc_id", "left_anti").select("doc_id", "group_seq", "filename", "start_page", "end_page")
    return group_pages_range(whole, pages)


def write_documents(named: DataFrame, pages: DataFrame, path: str) -> None:
    """Write the separated documents, replacing earlier output.

    One output document is the rows of one (doc_id, filename), lying together and in page order. Files follow
    the data volume, not the number of documents: small partitions are merged, and one that a very long
    document fills is split over several tasks.
    """
    rows = document_rows(named, pages).hint("rebalance", F.col("doc_id"), F.col("group_seq"))
    rows.sortWithinPartitions("doc_id", "group_seq", "page_number").write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored classifications by text hash; a missing or unreadable cache reads as empty."""
    try:
        stored = spark.read.parquet(path)
        wanted = spark.createDataFrame([], CACHE_SCHEMA).schema.simpleString()
        if stored.schema.simpleString() == wanted:
            return stored
    except Exception as error:  # a corrupt footer surfaces as a Java error, a missing path as an analysis error
        if not isinstance(error, AnalysisException) and "parquet" not in str(error).lower():
            raise
    return spark.createDataFrame([], CACHE_SCHEMA)


def save_cache(distinct: DataFrame, path: str) -> None:
    """Append the results the cache does not hold yet; zero-confidence results are never stored."""
    known = load_cache(distinct.sparkSession, path).select("text_hash")
    fresh = cache_rows(distinct).join(known, "text_hash", "left_anti")
    fresh.select(*[part.split()[0] for part in CACHE_SCHEMA.split(", ")]).write.mode("append").parquet(path)
