"""Rule classification of page text, with a table of model answers as fallback.

The rule dictionary is a plan-time parameter. Its patterns are ranked once on the driver
(confidence, then length, then dictionary order), so "best match wins" becomes one code-generated
``CASE`` that stops at the first hit: no join, no shuffle, no per-page match list.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import text as T
from pagewise.functions import values as V
from pagewise.functions.values import Rule
from pagewise.operators.ordered import with_neighbours
from pagewise.session import cut_lineage

MAX_RULES = 10_000
#: Length of the grams a rule table is indexed by.
GRAM = 6
RESULT = ("doc_type", "supplier", "confidence", "source", "matched_pattern", "is_continuation", "cnpj")
CLASSIFIED_COLUMNS = ("doc_id", "page_number") + RESULT


@dataclass(frozen=True)
class RankedPattern:
    rule_ord: int
    pattern_ord: int
    rule: Rule
    pattern: str
    norm: str


def normalize_pattern(pattern: str) -> str:
    """The same normalisation page text gets, for the handful of patterns held on the driver."""
    return " ".join("".join(T._ascii_residue(char) for char in pattern.lower()).split())


def ranked_patterns(rules: tuple[Rule, ...]) -> list[RankedPattern]:
    """Every pattern of the dictionary, strongest first."""
    entries = [
        RankedPattern(rule_ord, pattern_ord, rule, pattern, normalize_pattern(pattern))
        for rule_ord, rule in enumerate(rules)
        for pattern_ord, pattern in enumerate(rule.patterns)
    ]
    return sorted(entries, key=lambda e: (-e.rule.confidence, -len(e.norm), e.rule_ord, e.pattern_ord))


def rules_from_table(rules: DataFrame) -> tuple[Rule, ...]:
    """Read a user rule table into a plan-time dictionary of at most ``MAX_RULES`` rows; ``indexed_matches`` takes larger ones."""
    rows = rules.orderBy("rule_ord").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"rule table holds more than {MAX_RULES} rules")
    return tuple(
        Rule(row.doc_type, tuple(row.patterns), row.supplier_pattern, row.confidence, bool(row.is_regex))
        for row in rows
    )


def rules_table(spark, rules: tuple[Rule, ...] = V.SHIPPED_RULES) -> DataFrame:
    """The dictionary as a table, one row per rule."""
    from pagewise import schemas

    rows = [
        (i, r.doc_type, list(r.patterns), r.supplier_pattern, float(r.confidence), r.is_regex)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, schemas.RULES)


def with_text(pages: DataFrame) -> DataFrame:
    """Add the best text of each page and its normalised form, one step per column so that each is
    computed once."""
    return (
        pages.withColumn("text", T.best_text(F.col("ocr_text"), F.col("native_text")))
        .withColumn("norm", F.lower("text"))
        .withColumn("norm", T.fold_letters(F.col("norm")))
        .withColumn("norm", T.drop_rest(F.col("norm")))
        .withColumn("norm", T.squeeze(F.col("norm")))
    )


def _matches(norm: Column, entry: RankedPattern) -> Column:
    return norm.rlike("(?i)" + entry.norm) if entry.rule.is_regex else norm.contains(entry.norm)


def rule_matches(pages: DataFrame, rules: tuple[Rule, ...] = V.SHIPPED_RULES) -> DataFrame:
    """One row per page and dictionary pattern found on it, at most one per dictionary entry."""
    ranked = ranked_patterns(rules)
    norm = F.col("norm")
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    _matches(norm, e),
                    F.struct(
                        F.lit(e.rule_ord).alias("rule_ord"),
                        F.lit(e.pattern_ord).alias("pattern_ord"),
                        F.lit(e.rule.doc_type).alias("doc_type"),
                        F.lit(e.pattern).alias("pattern"),
                        F.lit(float(e.rule.confidence)).alias("confidence"),
                        F.lit(len(e.norm)).alias("pattern_length"),
                    ),
                )
                for e in ranked
            ]
        )
    )
    return with_text(pages).select("doc_id", "page_number", F.inline(hits))


def indexed_matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule_matches`` for a rule *table* (rule_ord, doc_type, patterns, confidence) of any size.

    An inverted index: every pattern is posted under the one of its grams of ``GRAM`` characters that the fewest pages
    hold, pages meet the postings by their distinct grams, and each pair met is verified on the text. Grams of pages that
    no pattern has go at once; the others are stored, counted and met with the postings from there. The plan does not
    grow with the rules, and nothing but gram lengths comes to the driver. A pattern shorter than a gram is posted whole.
    Patterns are literal text; a pattern that is null or blank after normalisation matches nothing.
    """
    listed = rules.select("rule_ord", "doc_type", "confidence", F.posexplode("patterns").alias("pattern_ord", "pattern"))
    norm = T.normalize_text(F.col("pattern"))
    patterns = cut_lineage(listed.withColumn("pattern_norm", norm).filter(F.length("pattern_norm") > 0))

    def grams(text: str, size: int) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))

    size = F.least(F.length("pattern_norm"), F.lit(GRAM))
    sizes = sorted(row[0] for row in patterns.select(size).distinct().collect())
    texts = with_text(pages).select("doc_id", "page_number", "norm")
    held = F.array_distinct(F.flatten(F.array(*[grams("norm", n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    whole = F.length("pattern_norm") < GRAM
    own = patterns.select(
        "rule_ord", "pattern_ord",
        F.explode(F.when(whole, F.array("pattern_norm")).otherwise(F.array_distinct(grams("pattern_norm", GRAM)))).alias("gram"),
    )
    shown = texts.select("doc_id", "page_number", F.explode(held).alias("gram"))
    shown = cut_lineage(shown.join(own.select("gram").distinct(), "gram", "left_semi"))
    often = shown.groupBy("gram").agg(F.count("*").alias("pages"))
    posted = (
        own.join(often, "gram", "left")
        .groupBy("rule_ord", "pattern_ord")
        .agg(F.min(F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "gram")).alias("rarest"))
        .select("rule_ord", "pattern_ord", "rarest.gram")
    )
    met = shown.join(posted, "gram").drop("gram").join(patterns, ["rule_ord", "pattern_ord"])
    return met.join(texts, ["doc_id", "page_number"]).filter(F.col("norm").contains(F.col("pattern_norm"))).select(
        "doc_id", "page_number", "rule_ord", "pattern_ord", "doc_type", "pattern", "confidence",
        F.length("pattern_norm").alias("pattern_length"),
    )


def strongest_match(matches: DataFrame) -> DataFrame:
    """The winning rule of each page with a match: confidence, then length, then the order of the table."""
    rank = F.struct("confidence", "pattern_length", -F.col("rule_ord"), -F.col("pattern_ord"))
    kept = F.struct("rule_ord", "pattern_ord", "doc_type", "pattern", "confidence")
    return matches.groupBy("doc_id", "page_number").agg(F.max_by(kept, rank).alias("won")).select("doc_id", "page_number", "won.*")


def _winner(norm: Column, ranked: list[RankedPattern]) -> Column:
    """Rank of the strongest pattern on the page, null when none is there."""
    chain = None
    for rank, entry in enumerate(ranked):
        found = _matches(norm, entry)
        chain = F.when(found, F.lit(rank)) if chain is None else chain.when(found, F.lit(rank))
    return chain if chain is not None else F.lit(None).cast("int")


def _supplier(hit: Column, text: Column, norm: Column, ranked: list[RankedPattern]) -> Column:
    """Supplier of the winning rule, from the raw text and else from the normalised one."""
    by_pattern: dict[str, list[int]] = {}
    for rank, entry in enumerate(ranked):
        if entry.rule.supplier_pattern:
            by_pattern.setdefault(entry.rule.supplier_pattern, []).append(rank)
    chain = F.lit(None).cast("string")
    for pattern, ranks in by_pattern.items():
        found = F.coalesce(T.extract_supplier(text, pattern), T.extract_supplier(norm, pattern))
        chain = F.when(hit.isin(*ranks), found).otherwise(chain)
    return T.clean_supplier(chain)


def page_signals(
    pages: DataFrame, rules: tuple[Rule, ...] = V.SHIPPED_RULES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Everything later steps need from the text, in one narrow pass; the text itself stays behind."""
    ranked = ranked_patterns(rules)
    hit, text, norm = F.col("hit"), F.col("text"), F.col("norm")

    def of_rank(values: list, kind: str) -> Column:
        return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), hit)

    known = pages if "norm" in pages.columns else with_text(pages)
    scored = known.withColumn("hit", _winner(norm, ranked))
    return scored.select(
        "doc_id",
        "page_number",
        *keep,
        of_rank([e.rule.doc_type for e in ranked], "string").alias("rule_type"),
        _supplier(hit, text, norm, ranked).alias("rule_supplier"),
        of_rank([float(e.rule.confidence) for e in ranked], "double").alias("rule_confidence"),
        of_rank([e.pattern for e in ranked], "string").alias("rule_pattern"),
        T.is_continuation(norm).alias("text_continues"),
        T.extract_cnpj(text).alias("text_cnpj"),
        F.coalesce(F.when(hit.isNull(), T.looks_like_spreadsheet(text)), F.lit(False)).alias("text_sheet"),
        norm.contains(V.SATELLITE_WORD).alias("text_satellite"),
    )


def _raw_result() -> dict[str, Column]:
    """Rule outcome before enrichment; no match reads unknown with zero confidence."""
    return {
        "doc_type": F.coalesce(F.col("rule_type"), F.lit(V.UNKNOWN)),
        "supplier": F.col("rule_supplier"),
        "confidence": F.coalesce(F.col("rule_confidence"), F.lit(0.0)),
        "source": F.lit("rule"),
        "matched_pattern": F.col("rule_pattern"),
        "is_continuation": F.lit(False),
        "cnpj": F.lit(None).cast("string"),
    }


def enrich(df: DataFrame) -> DataFrame:
    """Fill continuation and tax id, then apply the spreadsheet and the satellite-bill heuristics."""
    sheet = (F.col("doc_type") == V.UNKNOWN) & F.col("text_sheet")
    satellite = F.col("doc_type").isin(*V.SATELLITE_SOURCES) & F.col("text_satellite")
    step = df.withColumns(
        {
            "is_continuation": F.col("is_continuation") | F.col("text_continues"),
            "cnpj": F.coalesce(F.nullif(F.col("cnpj"), F.lit("")), F.col("text_cnpj")),
            "doc_type": F.when(sheet, V.SPREADSHEET_TYPE).otherwise(F.col("doc_type")),
            "confidence": F.when(sheet, F.greatest("confidence", F.lit(V.SPREADSHEET_CONFIDENCE))).otherwise(
                F.col("confidence")
            ),
            "matched_pattern": F.when(
                sheet, F.coalesce("matched_pattern", F.lit(V.SPREADSHEET_PATTERN))
            ).otherwise(F.col("matched_pattern")),
        }
    )
    return step.withColumns(
        {
            "doc_type": F.when(satellite, V.SATELLITE_TYPE).otherwise(F.col("doc_type")),
            "supplier": F.when(satellite, F.coalesce("supplier", F.lit(V.SATELLITE_SUPPLIER))).otherwise(
                F.col("supplier")
            ),
            "confidence": F.when(satellite, F.greatest("confidence", F.lit(V.SATELLITE_CONFIDENCE))).otherwise(
                F.col("confidence")
            ),
            "matched_pattern": F.when(
                satellite, F.coalesce("matched_pattern", F.lit(V.SATELLITE_WORD))
            ).otherwise(F.col("matched_pattern")),
        }
    )


def apply_rules(pages: DataFrame, rules: tuple[Rule, ...] = V.SHIPPED_RULES) -> DataFrame:
    """Pages some rule matched, with the winning rule; pages without a match give no row."""
    return (
        page_signals(pages, rules)
        .filter(F.col("rule_type").isNotNull())
        .select(
            "doc_id",
            "page_number",
            F.col("rule_type").alias("doc_type"),
            F.col("rule_supplier").alias("supplier"),
            F.col("rule_confidence").alias("confidence"),
            F.lit("rule").alias("source"),
            F.col("rule_pattern").alias("matched_pattern"),
            F.col("text_continues").alias("is_continuation"),
            F.col("text_cnpj").alias("cnpj"),
        )
    )


def classify_pages(
    pages: DataFrame,
    rules: tuple[Rule, ...] = V.SHIPPED_RULES,
    responses: DataFrame | None = None,
    threshold: float = V.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """One classified row per page. ``responses`` are parsed fallback answers keyed by page."""
    signals = page_signals(pages, rules)
    if responses is None:
        return enrich(signals.withColumns(_raw_result())).select(*CLASSIFIED_COLUMNS)
    return merge_fallback(signals, responses, threshold).select(*CLASSIFIED_COLUMNS)


def merge_fallback(
    signals: DataFrame, responses: DataFrame, threshold: float = V.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """A model answer replaces a weak rule hit only when it is known and at least as confident."""
    answers = responses.select(
        "doc_id", "page_number", F.struct(*[F.col(name) for name in RESULT]).alias("answer")
    )
    no_rule = F.col("rule_type").isNull()
    weak = no_rule | (F.col("rule_confidence") < threshold)
    better = (F.col("answer.doc_type") != V.UNKNOWN) & (F.col("answer.confidence") >= F.col("rule_confidence"))
    take = F.coalesce(F.col("answer").isNotNull() & weak & (no_rule | better), F.lit(False))
    raw = _raw_result()
    merged = (
        signals.join(answers, ["doc_id", "page_number"], "left")
        .withColumn("take", take)
        .withColumns({name: F.when(F.col("take"), F.col(f"answer.{name}")).otherwise(raw[name]) for name in RESULT})
    )
    return enrich(merged)


def fallback_requests(
    pages: DataFrame, rules: tuple[Rule, ...] = V.SHIPPED_RULES, threshold: float = V.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Pages the rules cannot settle, with the request text a model would get.

    Only those pages carry their text through the shuffle that looks up the previous page.
    """
    signals = page_signals(with_text(pages), rules, keep=("text",))
    weak = F.coalesce(F.col("rule_confidence"), F.lit(0.0)) < threshold
    classified = (
        enrich(signals.withColumns(_raw_result()).withColumn("weak", weak))
        .withColumn("excerpt", F.when(F.col("weak"), T.request_excerpt(F.col("text"))))
        .select("doc_id", "page_number", "doc_type", "supplier", "weak", "excerpt")
    )
    placed = with_neighbours(classified, previous=("doc_type", "supplier"))
    return placed.filter("weak").select(
        "doc_id",
        "page_number",
        F.col("prev_doc_type").alias("previous_doc_type"),
        F.col("prev_supplier").alias("previous_supplier"),
        T.page_request_text(
            F.col("page_number"), F.col("excerpt"), F.col("prev_doc_type"), F.col("prev_supplier")
        ).alias("request"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Turn raw model answers into classification rows; anything unreadable reads unknown."""
    body = F.regexp_replace(T.strip_text(F.coalesce("body", F.lit(""))), r"^```(?:json)?\s*", "")
    parsed = F.try_parse_json(F.regexp_replace(body, r"\s*```$", ""))
    row = responses.withColumn("answer", parsed)

    def field(name: str) -> Column:
        return F.try_variant_get("answer", f"$.{name}", "string")

    flag = F.try_variant_get("answer", "$.is_continuation", "variant")
    flag_kind = F.schema_of_variant(flag)
    number = F.try_variant_get("answer", "$.is_continuation", "double")
    truthy = (
        F.when(F.col("answer").isNull() | flag.isNull(), False)
        .when(flag_kind == "STRING", F.length(field("is_continuation")) > 0)
        .when(flag_kind == "BOOLEAN", F.try_variant_get("answer", "$.is_continuation", "boolean"))
        .otherwise(F.coalesce(number != 0, F.lit(False)))
    )
    score = F.try_variant_get("answer", "$.confidence", "variant")
    given = F.try_variant_get("answer", "$.confidence", "double")
    readable = (
        F.schema_of_variant("answer").startswith("OBJECT") & (score.isNull() | given.isNotNull())
    )
    ok = F.coalesce(readable, F.lit(False))
    blank = F.lit("")
    return row.withColumn("ok", ok).select(
        "doc_id",
        "page_number",
        F.when(F.col("ok"), F.coalesce(F.nullif(T.strip_text(field("doc_type")), blank), F.lit(V.UNKNOWN)))
        .otherwise(V.UNKNOWN)
        .alias("doc_type"),
        F.when(F.col("ok"), F.nullif(T.strip_text(field("supplier")), blank)).alias("supplier"),
        F.when(F.col("ok"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(given, F.lit(0.0)))))
        .otherwise(0.0)
        .alias("confidence"),
        F.lit("llm").alias("source"),
        F.when(F.col("ok"), F.nullif(F.substring(field("reasoning"), 1, 200), blank)).alias("matched_pattern"),
        (F.col("ok") & truthy).alias("is_continuation"),
        F.lit(None).cast("string").alias("cnpj"),
    )


def classify_distinct(
    pages: DataFrame, rules: tuple[Rule, ...] = V.SHIPPED_RULES, cache: DataFrame | None = None
) -> DataFrame:
    """Pages with the same normalised text share the first page's result.

    The text is read once and reduced to small rows on shared storage; the first result per hash is a
    map-side combined aggregate, and a hash that holds many pages is split by the adaptive skew join.
    """
    hashed = with_text(pages).withColumn("text_hash", T.text_hash(F.col("norm")))
    signals = cut_lineage(page_signals(hashed, rules, keep=("text_hash",)))
    own = enrich(signals.withColumns(_raw_result()))
    first = (
        own.filter(F.col("confidence") > 0)
        .groupBy("text_hash")
        .agg(F.min_by(F.struct(*RESULT), F.struct("doc_id", "page_number")).alias("seen"))
    )
    if cache is not None:
        stored = cache.select("text_hash", F.struct(*RESULT).alias("seen"))
        first = stored.unionByName(first.join(stored, "text_hash", "left_anti"))
    shared = own.join(first, "text_hash", "left").withColumns(
        {name: F.when(F.col("seen").isNotNull(), F.col(f"seen.{name}")).otherwise(F.col(name)) for name in RESULT}
    )
    return enrich(shared).select("doc_id", "page_number", "text_hash", *RESULT)


def cache_rows(distinct: DataFrame) -> DataFrame:
    """Rows a classification cache keeps: one per hash, zero-confidence results left out."""
    return (
        distinct.filter(F.col("confidence") > 0)
        .groupBy("text_hash")
        .agg(F.min_by(F.struct(*RESULT), F.struct("doc_id", "page_number")).alias("seen"))
        .select("text_hash", "seen.*")
    )


def classify_stats(classified: DataFrame, threshold: float = V.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Accepted and low-confidence page counts; the share is null on empty input."""
    accepted = F.count_if(F.col("confidence") >= threshold)
    return classified.agg(
        F.count("*").alias("total_pages"),
        accepted.alias("accepted_pages"),
        F.count_if(F.col("confidence") < threshold).alias("low_confidence_pages"),
        F.round(F.try_divide(accepted * 100.0, F.count("*")), 1).alias("accepted_pct"),
    )


def rule_candidates(classified: DataFrame) -> DataFrame:
    """How often the model proposed each type: the source of new rules."""
    return classified.filter(F.col("source") == "llm").groupBy("doc_type").agg(F.count("*").alias("suggested_pages"))
