"""Grouping consecutive pages of a document into logical documents.

Whether a page joins the open group depends on its two neighbours and on three facts about the group:
it holds a satellite bill, it holds an invoice, it holds a boleto-chain page. So a page is a function
on eight states, and functions compose. Pages are folded inside blocks of at most 4096 pages; a block is
again a function on eight states, and only documents longer than one block need theirs chained, span by span.
No document, however long, is gathered in one place, and the page rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import text as T
from pagewise.functions import values as V
from pagewise.operators.ordered import BLOCK_BITS, block_of, explode_range, in_first_block, running_total, scan, with_neighbours
from pagewise.session import cut_lineage

# Facts about the open group, one bit each.
HAS_SATELLITE, HAS_INVOICE, HAS_CHAIN = 1, 2, 4
STATES = 8
STATE_MASK = STATES - 1

# Blocks that are composed to one span of a long document.
SPAN_BITS = 10

# What the neighbours decide about a page.
ALWAYS_SPLIT, ALWAYS_ATTACH, INVOICE, INVOICE_FITTING, FITTING = range(5)


def _attaches(verdict: int, state: int) -> bool:
    if verdict in (ALWAYS_SPLIT, ALWAYS_ATTACH):
        return verdict == ALWAYS_ATTACH
    if state & HAS_SATELLITE:
        return verdict != FITTING and not state & HAS_INVOICE
    return verdict != INVOICE or bool(state & HAS_CHAIN)


def _page_moves() -> list[int]:
    """For verdict, page facts and state: the next state, plus 8 when a new group starts."""
    moves = []
    for verdict in range(5):
        for facts in range(STATES):
            for state in range(STATES):
                moves.append(state | facts if _attaches(verdict, state) else facts + STATES)
    return moves


PAGE_MOVES = _page_moves()


def back_of_bill(
    doc_type: Column, confidence: Column, prev_type: Column, compatible: Column
) -> Column:
    """Reverse side of an energy or municipal-tax bill: same type, or unknown with low confidence."""
    same = doc_type == prev_type
    unknown = doc_type == V.UNKNOWN
    return (
        prev_type.isin(*V.TWO_SIDED_BILLS)
        & (same | unknown)
        & ((confidence < 0.5) | same)
        & (compatible | unknown)
    )


def group_features(
    classified: DataFrame, keep_block: bool = False, bits: int = BLOCK_BITS, held: bool = False
) -> DataFrame:
    """Per page: neighbours, set membership and the verdict its neighbours allow."""
    placed = with_neighbours(
        classified,
        previous=("page_number", "doc_type", "supplier", "cnpj"),
        following=("doc_type",),
        keep_block=keep_block,
        bits=bits,
        held=held,
    )
    doc_type, prev_type = F.col("doc_type"), F.col("prev_doc_type")
    compatible = T.suppliers_compatible(
        F.col("supplier"), F.col("cnpj"), F.col("prev_supplier"), F.col("prev_cnpj")
    )
    placed = placed.withColumn("compatible", compatible)
    flags = placed.withColumns(
        {
            "is_first": F.col("prev_page_number").isNull(),
            "back_of_bill": F.coalesce(
                back_of_bill(doc_type, F.col("confidence"), prev_type, F.col("compatible")), F.lit(False)
            ),
            "alone": F.coalesce(
                doc_type.isin(*V.SINGLETON_TYPES) | prev_type.isin(*V.SINGLETON_TYPES), F.lit(False)
            ),
            "satellite": T.is_viasat(doc_type, F.col("supplier"), F.col("matched_pattern")),
            "same_multipage": F.coalesce(
                (doc_type == prev_type) & doc_type.isin(*V.MULTIPAGE_TYPES) & F.col("compatible"), F.lit(False)
            ),
            "chain_before_invoice": F.coalesce(
                doc_type.isin("boleto_outros_bancos", "recibo_pagador")
                & (prev_type == "comprovante_pagamento")
                & (F.col("next_doc_type") == "nfe"),
                F.lit(False),
            ),
        }
    )
    fitting = F.col("same_multipage") | F.col("chain_before_invoice")
    verdict = (
        F.when(F.col("is_first"), ALWAYS_SPLIT)
        .when(F.col("is_continuation") | F.col("back_of_bill"), ALWAYS_ATTACH)
        .when(F.col("alone"), ALWAYS_SPLIT)
        .when(F.col("satellite"), ALWAYS_ATTACH)
        .when((doc_type == "nfe") & fitting, INVOICE_FITTING)
        .when(doc_type == "nfe", INVOICE)
        .when(fitting, FITTING)
        .otherwise(ALWAYS_SPLIT)
    )
    facts = (
        F.when(F.col("satellite"), HAS_SATELLITE).otherwise(0)
        + F.when(doc_type == "nfe", HAS_INVOICE).otherwise(0)
        + F.when(doc_type.isin(*V.BOLETO_CHAIN_TYPES), HAS_CHAIN).otherwise(0)
    )
    return flags.withColumn("move", (verdict * STATES + facts).cast("int"))


def _step(position: Column, next_of_state: Column) -> Column:
    """Advance ``8 * groups started + state``; the table entry already carries 8 for a new group."""
    return position.bitwiseAND(F.lit(~STATE_MASK)) + next_of_state


def _moves() -> Column:
    return F.expr(f"array({', '.join(map(str, PAGE_MOVES))})")


def _page_step(position: Column, move: Column, moves: Column) -> Column:
    return _step(position, F.get(moves, move * STATES + position.bitwiseAND(F.lit(STATE_MASK))))


def _block_step(position: Column, ends: Column) -> Column:
    return _step(position, F.get(ends, position.bitwiseAND(F.lit(STATE_MASK))).cast("bigint"))


def assign_groups(classified: DataFrame, bits: int = BLOCK_BITS, span_bits: int = SPAN_BITS) -> DataFrame:
    """Every classified page with ``group_seq``, its document's group number counted from 1.

    The classified rows are stored first: chaining the blocks of long documents reads them again, and what is
    read again must be these small rows and not the page text.
    """
    columns = classified.columns
    known = cut_lineage(classified.filter(F.col("doc_id").isNotNull() & F.col("page_number").isNotNull()))
    features = group_features(known, keep_block=True, bits=bits, held=True)
    payload = F.struct("page_number", "move", *[c for c in columns if c not in ("doc_id", "page_number")])
    blocks = features.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list(payload)).alias("items"))

    if in_first_block(known, F.col("page_number") - 1, bits):
        placed = blocks.withColumn("entry", F.lit(0).cast("bigint"))
    else:
        placed = blocks.join(_block_entries(blocks, span_bits), ["doc_id", "block"], "left").withColumn(
            "entry", F.coalesce("entry", F.lit(0).cast("bigint"))
        )
    moves = _moves()
    trail = scan(
        F.col("items"), F.col("entry").bitwiseAND(F.lit(STATE_MASK)), lambda position, item: _page_step(position, item["move"], moves)
    )
    started = F.shiftright(F.col("entry"), 3)
    exploded = placed.select(
        "doc_id",
        started.alias("started"),
        F.inline(F.arrays_zip(F.col("items").alias("item"), F.slice(trail, 2, F.size("items")).alias("position"))),
    )
    return exploded.select(
        "doc_id",
        "item.page_number",
        *[F.col(f"item.{c}").alias(c) for c in columns if c not in ("doc_id", "page_number")],
        (F.col("started") + F.shiftright(F.col("position"), 3)).cast("int").alias("group_seq"),
    )


def _through(parts: Column) -> Column:
    """For each of the eight states: ``8 * groups started + state`` after all blocks of ``parts``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(STATE_MASK)),
        lambda state: F.aggregate(parts, state.cast("bigint"), lambda position, part: _block_step(position, part["ends"])),
    )


def _block_entries(blocks: DataFrame, span_bits: int = SPAN_BITS) -> DataFrame:
    """Where each later block of a long document starts: ``8 * groups so far + state``.

    A scan by levels: blocks are composed to spans of at most ``2 ** span_bits``, the spans of a document (512 at
    most) are chained, and each span's entry is carried down through its own blocks.
    """
    tails = blocks.filter(F.col("block") > 0)
    long_docs = tails.select("doc_id").distinct()
    moves = _moves()
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(STATE_MASK)),
        lambda state: F.aggregate(
            F.col("items"), state, lambda position, item: _page_step(position, item["move"], moves)
        ),
    )
    spans = cut_lineage(
        blocks.join(long_docs, "doc_id", "left_semi")
        .select("doc_id", F.shiftright("block", span_bits).alias("span"), F.struct("block", ends.alias("ends")).alias("part"))
        .groupBy("doc_id", "span")
        .agg(F.sort_array(F.collect_list("part")).alias("parts"))
    )
    chained = (
        spans.select("doc_id", F.struct("span", _through(F.col("parts")).alias("ends")).alias("part"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("part")).alias("spans"))
    )

    def carried(rows: DataFrame, parts: str, number: str, start: Column, out: str, *keys: str) -> DataFrame:
        trail = scan(F.col(parts), start, lambda position, part: _block_step(position, part["ends"]))
        pairs = F.arrays_zip(F.col(f"{parts}.{number}").alias(number), F.slice(trail, F.lit(1), F.size(parts)).alias(out))
        return rows.select(*keys, F.inline(pairs))

    starts = carried(chained, "spans", "span", F.lit(0), "start", "doc_id")
    return carried(spans.join(starts, ["doc_id", "span"]), "parts", "block", F.col("start"), "entry", "doc_id").filter("block > 0")


def _priority(doc_type: Column) -> Column:
    order = F.array(*[F.lit(name) for name in V.TYPE_PRIORITY])
    return F.coalesce(F.nullif(F.array_position(order, doc_type), F.lit(0)), F.lit(len(V.TYPE_PRIORITY) + 1))


def pick_doc_type() -> Column:
    """Best-ranked known type of the group, else its first known type, else unknown."""
    known = F.when(F.col("doc_type") != V.UNKNOWN, F.col("doc_type"))
    order = F.when(known.isNotNull(), F.struct(_priority(known).alias("rank"), F.col("page_number")))
    return F.coalesce(F.min_by(known, order), F.lit(V.UNKNOWN))


def pick_supplier() -> Column:
    """Longest supplier name of the group; the earliest page wins a tie."""
    named = F.nullif(F.col("supplier"), F.lit(""))
    order = F.when(
        named.isNotNull(), F.struct(F.length(named).alias("length"), (-F.col("page_number")).alias("earlier"))
    )
    return F.max_by(named, order)


def build_groups(grouped: DataFrame, threshold: float = V.CONFIDENCE_THRESHOLD) -> DataFrame:
    """One row per logical document. Partial aggregates keep a long group from landing on one task."""
    review = (F.col("confidence") < threshold) | (F.col("doc_type") == V.UNKNOWN)
    return grouped.groupBy("doc_id", "group_seq").agg(
        pick_doc_type().alias("doc_type"),
        pick_supplier().alias("supplier"),
        F.min("page_number").alias("start_page"),
        F.max("page_number").alias("end_page"),
        F.bool_or(review).alias("needs_review"),
    )


def group_pages(classified: DataFrame, threshold: float = V.CONFIDENCE_THRESHOLD) -> DataFrame:
    return build_groups(assign_groups(classified), threshold)


def should_group_pairwise(classified: DataFrame) -> DataFrame:
    """Two-page decision for every page and its predecessor: the open group is the previous page alone
    and the next page is not looked at."""
    features = group_features(classified).select(
        "doc_id",
        "page_number",
        F.shiftright("move", 3).alias("verdict"),
        F.col("move").bitwiseAND(F.lit(STATE_MASK)).alias("facts"),
        "same_multipage",
    )
    pairs = with_neighbours(features, previous=("facts",)).filter(F.col("prev_facts").isNotNull())
    # A page that fits only because of the next page does not fit here.
    verdict = F.when((F.col("verdict") == FITTING) & ~F.col("same_multipage"), ALWAYS_SPLIT).otherwise(
        F.col("verdict")
    )
    landing = F.get(_moves(), (verdict * STATES + F.col("facts")) * STATES + F.col("prev_facts"))
    return pairs.select("doc_id", "page_number", (landing < STATES).alias("attaches"))


def coverage_check(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """Violations of "pages 1..N appear in exactly one group", as (doc_id, violation, page_number).

    ``documents`` holds (doc_id, total_pages). A sweep over the ends of ranges: where a group or the document begins
    or is over, the number of groups and of documents there changes, and running sums give both between two such
    places. Only ranges that violate the rule become rows per page. Sums run in blocks of positions, so a long
    document spreads over all tasks. A document without any group is one violation, not one per page.
    """
    start, end = F.col("start_page"), F.col("end_page")
    asked = documents.join(groups.select("doc_id").distinct().withColumn("has_groups", F.lit(True)), "doc_id", "left")
    ranges = groups.filter(start <= end).select("doc_id", start.alias("low"), end.alias("high"), F.lit(1).alias("group"), F.lit(0).alias("page"))
    whole = asked.filter(F.col("has_groups") & (F.col("total_pages") >= 1)).select(
        "doc_id", F.lit(1).alias("low"), F.col("total_pages").alias("high"), F.lit(0).alias("group"), F.lit(1).alias("page")
    )
    ends = F.array(
        F.struct(F.col("low").alias("at"), F.col("group").alias("group"), F.col("page").alias("page")),
        F.struct((F.col("high") + 1).alias("at"), (-F.col("group")).alias("group"), (-F.col("page")).alias("page")),
    )
    changes = cut_lineage(
        ranges.unionByName(whole).select("doc_id", F.inline(ends)).groupBy("doc_id", "at").agg(F.sum("group").alias("groups"), F.sum("page").alias("pages"))
    )
    placed = with_neighbours(changes, following=("at",), page="at", held=True)
    # Neither running sum is ever negative, so one sum carries both: documents above 32 bits of groups.
    both = F.shiftleft("pages", 32) + F.col("groups")
    short = in_first_block(changes, F.col("at"))
    placed = running_total(placed, ["doc_id"], ["at"], both, "before", short=short).withColumn("now", F.col("before") + both)
    covered, expected = F.col("now").bitwiseAND(F.lit(2**32 - 1)), F.shiftright("now", 32)
    violation = (
        F.when((covered == 0) & (expected > 0), "missing").when(covered > 1, "overlap").when((covered == 1) & (expected == 0), "extra")
    )
    broken = placed.select("doc_id", "at", "next_at", violation.alias("violation")).filter("violation is not null")
    pages = explode_range(broken, F.col("at"), F.col("next_at") - 1, "page_number").select("doc_id", "violation", "page_number")
    inverted = groups.filter(start > end).select("doc_id", F.lit("inverted").alias("violation"), start.alias("page_number")).distinct()
    without = asked.filter("has_groups is null").select(
        "doc_id", F.lit("no_groups").alias("violation"), F.lit(None).cast("int").alias("page_number")
    ).distinct()
    return pages.unionByName(inverted).unionByName(without)


def group_pages_range(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each group by range. Groups are spread over page blocks first, so the range join is an
    equi-join on (document, block) and a long document does not meet itself in one task."""
    first, last = block_of(F.col("start_page") - 1), block_of(F.col("end_page") - 1)
    spread = groups.filter("start_page <= end_page").withColumn("block", F.explode(F.sequence(first, last)))
    placed = pages.withColumn("block", block_of(F.col("page_number") - 1))
    inside = (F.col("page_number") >= F.col("start_page")) & (F.col("page_number") <= F.col("end_page"))
    return placed.join(spread, ["doc_id", "block"]).filter(inside).drop("block")


def result_stats(groups: DataFrame) -> DataFrame:
    return groups.groupBy("doc_id").agg(
        F.count("*").alias("total_documents"),
        F.sum(F.col("end_page") - F.col("start_page") + 1).alias("total_pages"),
        F.count_if("needs_review").alias("needs_review"),
    )
