"""Page-manifest transforms: merging, splitting, reordering and correcting documents as tables.

A manifest is (doc_id, page_number, page_ref); requests are tables too, so one job serves many documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import text as T
from pagewise.operators.ordered import block_of, position_in_key, running_total


def _page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))


def _merge_files(pages: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(_page_counts(pages), "doc_id", "left").select("merge_id", "file_ord", "doc_id", "total_pages")


def merge_errors(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per refused merge: fewer than two files, or files that are not there."""
    sizes = _merge_files(pages, requests).groupBy("merge_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("total_pages").isNull()).alias("missing")
    )
    error = F.when(F.col("missing") > 0, "missing_file").when(F.col("files") < 2, "too_few_files")
    return sizes.withColumn("error", error).filter("error is not null")


def merge_docs(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Concatenate documents in the given order (merge_id, file_ord, doc_id) and renumber.

    Only files are summed in order; a page's new number is its file's offset plus its own number, so pages
    join once and are never ranked. Refused merges are left out; ``merge_errors`` names them.
    """
    files = _merge_files(pages, requests).join(merge_errors(pages, requests).select("merge_id"), "merge_id", "left_anti")
    placed = running_total(files, ["merge_id"], ["file_ord", "doc_id"], F.col("total_pages").cast("bigint"), "offset")
    return pages.join(placed.select("merge_id", "file_ord", "doc_id", "offset"), "doc_id").select(
        "merge_id",
        "file_ord",
        "doc_id",
        "page_number",
        (F.col("offset") + F.col("page_number")).alias("new_page"),
    )


def parse_ranges(ranges: Column) -> Column:
    """``"1-3,5"`` as an array of (start_page, end_page): first and last part of each item; null if unreadable."""
    items = F.transform(F.split(ranges, ","), lambda item: F.split(T.strip_text(item), "-"))
    pairs = F.transform(
        items,
        lambda parts: F.struct(
            F.btrim(F.element_at(parts, 1)).try_cast("int").alias("start_page"),
            F.btrim(F.element_at(parts, -1)).try_cast("int").alias("end_page"),
        ),
    )
    readable = F.forall(pairs, lambda pair: pair["start_page"].isNotNull() & pair["end_page"].isNotNull())
    return F.when(readable, pairs)


def split_requests(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per range of each request (doc_id, ranges), with ``error`` where it does not fit.

    No ranges means one per page.
    """
    blank = F.coalesce("ranges", F.lit("")) == ""
    single = (
        pages.select("doc_id", "page_number")
        .join(requests.filter(blank).select("doc_id"), "doc_id", "left_semi")
        .select(
            "doc_id",
            F.col("page_number").alias("part"),
            F.col("page_number").alias("start_page"),
            F.col("page_number").alias("end_page"),
            F.lit(None).cast("string").alias("error"),
        )
    )
    spread = (
        requests.filter(~blank)
        .join(_page_counts(pages), "doc_id")
        .select("doc_id", "total_pages", F.posexplode_outer(parse_ranges(F.col("ranges"))).alias("part", "pair"))
    )
    start, end = F.col("pair.start_page"), F.col("pair.end_page")
    bad = start.isNull() | end.isNull() | (start < 1) | (end < start) | (end > F.col("total_pages"))
    given = spread.select(
        "doc_id",
        F.coalesce(F.col("part") + 1, F.lit(1)).alias("part"),
        start.alias("start_page"),
        end.alias("end_page"),
        F.when(bad, "invalid_range").alias("error"),
    )
    return single.unionByName(given)


def split_ranges(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages of every split part, renumbered. A request with any invalid range yields nothing."""
    parts = split_requests(pages, requests)
    refused = parts.filter(F.col("error").isNotNull()).select("doc_id").distinct()
    good = parts.join(refused, "doc_id", "left_anti").drop("error")
    spread = good.withColumn(
        "block", F.explode(F.sequence(block_of(F.col("start_page") - 1), block_of(F.col("end_page") - 1)))
    )
    inside = (F.col("page_number") >= F.col("start_page")) & (F.col("page_number") <= F.col("end_page"))
    return (
        pages.select("doc_id", "page_number")
        .withColumn("block", block_of(F.col("page_number") - 1))
        .join(spread, ["doc_id", "block"])
        .filter(inside)
        .select(
            "doc_id",
            "part",
            F.format_string("pagina_%04d_%04d.pdf", "start_page", "end_page").alias("filename"),
            "page_number",
            (F.col("page_number") - F.col("start_page") + 1).alias("new_page"),
        )
    )


def delete_errors(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per document whose deletion is refused: it is not there, a page is outside it, or no page would be left."""
    sizes = requests.select("doc_id", "page_number").distinct().join(_page_counts(pages), "doc_id", "left").groupBy("doc_id", "total_pages").agg(
        F.count("*").alias("removed"),
        F.bool_and(F.coalesce(F.col("page_number").between(1, F.col("total_pages")), F.lit(False))).alias("inside"),
    )
    error = (
        F.when(F.col("total_pages").isNull(), "missing_file")
        .when(~F.col("inside"), "page_outside")
        .when(F.col("removed") >= F.col("total_pages"), "no_page_left")
    )
    return sizes.select("doc_id", error.alias("error")).filter("error is not null")


def delete_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Drop the listed pages (doc_id, page_number) and renumber the rest.

    A request naming a page outside its document, or all of its pages, is refused whole; ``delete_errors`` names it.
    """
    listed = requests.select("doc_id", "page_number").distinct()
    judged = listed.select("doc_id").distinct().join(delete_errors(pages, requests), "doc_id", "left_anti")
    touched = pages.select("doc_id", "page_number").join(judged, "doc_id", "left_semi")
    kept = touched.join(listed, ["doc_id", "page_number"], "left_anti")
    return position_in_key(kept, ["doc_id"], "page_number", "new_page")


def reorder_errors(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per document whose new order is refused: it is not there, has several orders, or the order is no permutation."""
    asked = requests.groupBy("doc_id").agg(F.count("*").alias("orders"), F.any_value("page_order").alias("page_order"))
    whole = F.array_sort("page_order") == F.sequence(F.lit(1), F.col("total_pages"))
    error = (
        F.when(F.col("total_pages").isNull(), "missing_file")
        .when(F.col("orders") > 1, "several_orders")
        .when(~F.coalesce(whole, F.lit(False)), "no_permutation")
    )
    return asked.join(_page_counts(pages), "doc_id", "left").select("doc_id", error.alias("error")).filter("error is not null")


def reorder_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages in the requested order (doc_id, page_order ARRAY<INT>), one order a document.

    Only permutations of 1..N are applied; ``reorder_errors`` names the refused documents.
    """
    valid = requests.join(reorder_errors(pages, requests), "doc_id", "left_anti").select(
        "doc_id", F.posexplode("page_order").alias("position", "page_number")
    )
    return pages.select("doc_id", "page_number").join(valid, ["doc_id", "page_number"]).select(
        "doc_id", "page_number", (F.col("position") + 1).alias("new_page")
    )


def number_pages(pages: DataFrame) -> DataFrame:
    """Running number of each page within its document."""
    return position_in_key(pages.select("doc_id", "page_number"), ["doc_id"], "page_number", "running_number")


def metadata_overlay(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Non-empty title, author and subject replace the stored ones."""
    fields = ("title", "author", "subject")
    new = updates.select("doc_id", *[F.nullif(F.col(f), F.lit("")).alias(f"new_{f}") for f in fields])
    return current.join(new, "doc_id", "left").select(
        "doc_id", *[F.coalesce(f"new_{f}", f).alias(f) for f in fields]
    )


def doc_info(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    return _page_counts(pages).join(metadata, "doc_id", "left")


# ---- line selection on a page ----

BAND_POINTS = 32.0
NEAR_POINTS = 18.0


def _bands(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / BAND_POINTS).cast("int"), F.floor(high / BAND_POINTS).cast("int"))


def selection_boxes(corrections: DataFrame) -> DataFrame:
    """Normalised selection: corners ordered, specks padded by 3 points, clipped to the page."""
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    top, bottom = F.least("y0", "y1"), F.greatest("y0", "y1")
    pad = F.when((right - left < 2) & (bottom - top < 2), 3.0).otherwise(0.0)
    return corrections.withColumns(
        {
            "sx0": F.greatest(left - pad, F.lit(0.0)),
            "sy0": F.greatest(top - pad, F.lit(0.0)),
            "sx1": F.least(right + pad, F.col("page_width")),
            "sy1": F.least(bottom + pad, F.col("page_height")),
        }
    ).withColumn("empty", (F.col("sx0") >= F.col("sx1")) | (F.col("sy0") >= F.col("sy1")))


def pick_line(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """The one line each selection means: largest overlap, or for a tiny box the line at or near its centre.

    Lines and selections meet only in horizontal bands of the same page, so distant pairs are never formed,
    and the best line per selection is a combined aggregate.
    """
    boxes = selection_boxes(corrections).filter(~F.col("empty"))
    tiny = (F.col("sx1") - F.col("sx0") < 8) & (F.col("sy1") - F.col("sy0") < 8)
    boxes = boxes.withColumns(
        {"tiny": tiny, "px": (F.col("sx0") + F.col("sx1")) / 2, "py": (F.col("sy0") + F.col("sy1")) / 2}
    )
    reach_low = F.when(F.col("tiny"), F.col("py") - NEAR_POINTS).otherwise(F.col("sy0"))
    reach_high = F.when(F.col("tiny"), F.col("py") + NEAR_POINTS).otherwise(F.col("sy1"))
    wanted = boxes.withColumn("band", F.explode(_bands(reach_low, reach_high)))
    offered = lines.select(
        "doc_id", "page_number", "line_ord",
        *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")],
        F.explode(_bands(F.col("y0"), F.col("y1"))).alias("band"),
    )
    width = F.least("lx1", "sx1") - F.greatest("lx0", "sx0")
    height = F.least("ly1", "sy1") - F.greatest("ly0", "sy0")
    distance = F.abs((F.col("ly0") + F.col("ly1")) / 2 - F.col("py"))
    holds = (
        (F.col("px") >= F.col("lx0")) & (F.col("px") < F.col("lx1"))
        & (F.col("py") >= F.col("ly0")) & (F.col("py") < F.col("ly1"))
    )
    score = (
        F.when(F.col("tiny") & holds, 1000.0 - distance)
        .when(F.col("tiny") & (distance <= NEAR_POINTS), 100.0 - distance)
        .when(~F.col("tiny") & (width > 0) & (height > 0), width * height)
        .otherwise(0.0)
    )
    return (
        wanted.join(offered, ["doc_id", "page_number", "band"])
        .withColumn("score", score)
        .filter("score > 0")
        .groupBy("doc_id", "page_number", "correction_ord")
        .agg(F.max(F.struct("score", (-F.col("line_ord")).alias("earlier"))).alias("best"))
        .select(
            "doc_id", "page_number", "correction_ord",
            (-F.col("best.earlier")).alias("line_ord"), F.col("best.score").alias("score"),
        )
    )


def correction_errors(lines: DataFrame, corrections: DataFrame, documents: DataFrame) -> DataFrame:
    """Corrections that cannot be applied: (doc_id, page_number, correction_ord, error).

    ``documents`` holds (doc_id, total_pages).
    """
    picked = pick_line(lines, corrections).select("doc_id", "page_number", "correction_ord", "line_ord")
    boxes = selection_boxes(corrections).join(documents, "doc_id")
    area = (F.col("sx1") - F.col("sx0")) * (F.col("sy1") - F.col("sy0"))
    large = area > F.lit(0.08) * F.col("page_width") * F.col("page_height")
    error = (
        F.when(F.col("page_number") > F.col("total_pages"), "no_such_page")
        .when(F.col("empty"), "empty_selection")
        .when(F.col("line_ord").isNull() & large, "no_text_in_large_selection")
    )
    return (
        boxes.join(picked, ["doc_id", "page_number", "correction_ord"], "left")
        .withColumn("error", error)
        .filter(F.col("error").isNotNull())
        .select("doc_id", "page_number", "correction_ord", "error")
    )


def apply_text_corrections(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lines with the text of the last correction that picked them."""
    texts = corrections.select(
        "doc_id", "page_number", "correction_ord", T.strip_text(F.col("text")).alias("new_text")
    )
    last = (
        pick_line(lines, corrections)
        .join(texts, ["doc_id", "page_number", "correction_ord"])
        .groupBy("doc_id", "page_number", "line_ord")
        .agg(F.max_by("new_text", "correction_ord").alias("new_text"))
    )
    return lines.join(last, ["doc_id", "page_number", "line_ord"], "left").select(
        "doc_id",
        "page_number",
        "line_ord",
        F.coalesce("new_text", "text").alias("text"),
        F.col("new_text").isNotNull().alias("corrected"),
    )
