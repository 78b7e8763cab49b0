"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a measure of the text with a cost and a test. On a bounded sample the cascade estimates what each rule costs
and how often it rejects, sorts the rules by rejections per cost, and evaluates them as one ``CASE`` that stops at the
first rejection. The order decides how fast a document is rejected, never whether it is.

Defined cases: a null or empty text has no words and is rejected by ``few_words``. Repeated rows are judged one by one and
keep their number. Columns beside the text are carried untouched, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import WORD, let

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows whose rule outcomes are looked at before the order is chosen; a few small numbers a row reach the driver.
SAMPLE_ROWS = 400
SAMPLE_SHARE = 0.2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, GAP, "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")), F.lit(0)).cast("long")


def n_capitals(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, "[^A-Z]+", "")), F.lit(0)).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(WORD))


def n_lines(text: Column) -> Column:
    return F.size(_worded_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_worded_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared as 64-bit hashes. For the sort, the low bits of a hash make room for the window's position;
    neighbours in the sorted array that agree in the high bits are then compared in full.
    """

    def measured(hashes: Column) -> Column:
        windows = F.transform(
            F.slice(hashes, 1, F.size(hashes) - 2),
            lambda first, i: F.xxhash64(first, F.get(hashes, i + 1), F.get(hashes, i + 2)),
        )
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    def covered(windows: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), bits(windows))
        keyed = F.transform(windows, lambda h, i: h - F.pmod(h, size) + i)
        return let(F.struct(size.alias("size"), F.sort_array(keyed).alias("keys")), lambda s: spans(windows, s["size"], s["keys"]))

    def bits(windows: Column) -> Column:
        return F.length(F.bin(F.size(windows).cast("long")))

    def spans(windows: Column, size: Column, keys: Column) -> Column:
        def same(key: Column, other: Column) -> Column:
            at, there = F.pmod(key, size).cast("int"), F.pmod(other, size).cast("int")
            high = (key - F.pmod(key, size)) == (other - F.pmod(other, size))
            return F.coalesce(high & (F.get(windows, at) == F.get(windows, there)), F.lit(False))

        repeated = F.filter(keys, lambda key, i: same(key, F.get(keys, i - 1)) | same(key, F.get(keys, i + 1)))
        starts = F.sort_array(F.transform(repeated, lambda key: F.pmod(key, size)))
        # A window adds its three words, or as many as lie beyond the window before it.
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda start, i: F.least(F.lit(3), start - F.coalesce(F.get(p, i - 1), start - 3))),
                F.lit(0).cast("long"),
                lambda total, more: total + more,
            ),
        )

    hashed = let(words(text), lambda w: F.when(F.size(w) >= 3, F.transform(w, lambda x: F.xxhash64(x))))
    return F.coalesce(let(hashed, lambda h: F.when(h.isNotNull(), measured(h))), F.lit(0)).cast("long")


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_capitals": n_capitals,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}

#: Relative work of a measure: per character, per word, and per word and doubling of the number of words.
COSTS: dict[str, tuple[float, float, float]] = {
    "n_words": (1.0, 1.0, 0.0),
    "word_chars": (1.0, 0.0, 0.0),
    "n_symbols": (1.0, 0.0, 0.0),
    "n_capitals": (1.0, 0.0, 0.0),
    "n_lines": (0.5, 0.0, 0.0),
    "n_dup_lines": (0.7, 0.0, 0.0),
    "n_repeat_words": (1.0, 6.0, 1.0),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a test over the measures named in ``uses``."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


#: Fixed by the result contract.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
#: The method's own: symbols and capitals instead of prose, lines said again, words too short or long on average.
PROSE_RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("capitals", ("n_capitals", "word_chars"), lambda m: 10 * m["n_capitals"] > 5 * m["word_chars"]),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda m: 10 * m["n_dup_lines"] > 6 * m["n_lines"]),
    Rule(
        "word_length",
        ("word_chars", "n_words"),
        lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]),
    ),
)
RULES = BASE_RULES + PROSE_RULES


@dataclass(frozen=True)
class Standing:
    rule: Rule
    cost: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.cost


def standings(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Standing]:
    """Cost and rejected share of each rule on a sample of at most ``sample_rows`` rows, best gain first.

    The sample stops the scan as soon as it is full; ties keep the order given.
    """
    body = docs[text]
    measures = {name: f(body) for name, f in MEASURES.items() if any(name in rule.uses for rule in rules)}
    outcome = [F.coalesce(rule.rejects(measures), F.lit(False)).cast("int").alias(f"r{i}") for i, rule in enumerate(rules)]
    volume = [F.coalesce(F.length(body), F.lit(0)).alias("chars"), F.size(words(body)).alias("words")]
    rows = docs.sample(SAMPLE_SHARE, 7).select(*outcome, *volume).limit(sample_rows).collect()
    if not rows:
        rows = docs.select(*outcome, *volume).limit(sample_rows).collect()
    seen = max(len(rows), 1)
    chars, count = sum(r["chars"] for r in rows) / seen, sum(r["words"] for r in rows) / seen
    deep = sum(r["words"] * max(r["words"], 1).bit_length() for r in rows) / seen

    def cost(rule: Rule) -> float:
        parts = [COSTS[name] for name in rule.uses]
        return 1.0 + sum(a * chars + b * count + c * deep for a, b, c in parts)

    found = [Standing(rule, cost(rule), sum(r[f"r{i}"] for r in rows) / seen) for i, rule in enumerate(rules)]
    return sorted(found, key=lambda s: (-s.gain, s.cost))


def first_rejection(order: Sequence[Rule], measures: dict[str, Column]) -> Column:
    """Name of the first rule in ``order`` that rejects, else null; rules after it are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(verdict)
    return verdict


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that no rule rejects, with their columns as they are."""
    order = [s.rule for s in standings(docs, rules, text)]
    return docs.filter(first_rejection(order, {name: f(docs[text]) for name, f in MEASURES.items()}).isNull())


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the key, every measure, and ``failed_rule``: the rule of the cascade that rejected it, or null."""
    order = [s.rule for s in standings(docs, rules, text)]
    measured = docs.select(F.col(key), *[f(docs[text]).alias(name) for name, f in MEASURES.items()])
    return measured.withColumn("failed_rule", first_rejection(order, {name: F.col(name) for name in MEASURES}))


def quality_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, then what the cascade adds."""
    rows = judged(docs)
    base_failed = BASE_RULES[0].rejects({"n_words": F.col("n_words")}) | BASE_RULES[1].rejects(
        {"n_words": F.col("n_words"), "n_repeat_words": F.col("n_repeat_words")}
    )
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & F.col("failed_rule").isNull()).alias("kept"),
    )


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), g AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), p AS (
    SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY r
), s AS (
    SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
           length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals
    FROM d LEFT JOIN p USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_capitals > 5 * word_chars OR 10 * n_dup_lines > 6 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
