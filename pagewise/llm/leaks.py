"""Secret scan: pattern candidates, and a random forest that tells findings from false positives.

Candidates are token-like strings: those of known key formats and long mixed strings of letters and digits. Features of a
candidate are its length, how its characters follow each other under a character-transition table of the corpus's ordinary
words, its entropy, how much of it the corpus's dictionary covers, its place (source and share of the text before it), and
whether the words before and after speak of keys or of samples.

The forest is trained from labelled findings, a table of (value, before, after, secret). Without one, findings label
themselves: a value in a known format, or assigned to a name that speaks of keys, is a finding; ordinary words and numbers
and values next to words of examples are not. At most ``TRAIN_ROWS`` labelled rows train it, chosen by hash; dictionary,
transitions and candidates cover every document.

Defined cases: a null or empty text has no candidates. A text of any length is searched whole, in memory that follows its length. Repeated rows give repeated findings. A null source counts as a source
of its own. Other columns are not used, whatever their names. An empty table, or one whose labels are all alike, gives scores
equal to those labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import shipped, small_batches, stored

shipped(__name__)

#: Bound of the labelled rows a forest is trained on.
TRAIN_ROWS = 20_000
TREES = 30
DEPTH = 8
SEED = 11
#: A dictionary word is in this many documents at least; the transition table has a row for each pair of characters.
DICTIONARY_DOCS = 3

#: Formats of keys: name and pattern.
FORMATS = {
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "hex_token": r"\b[0-9a-f]{32,64}\b",
    "long_string": r"\b(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}\b",
    "long_number": r"\b[0-9]{12,}\b",
    "long_word": r"\b[A-Za-z]{20,}\b",
}
KEY_WORDS = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private)"
SAMPLE_WORDS = r"(?i)(\b(example|sample|dummy|placeholder|test|changeme)\b|xxxx|\byour[_-])"
#: Characters on either side of a candidate that are looked at.
NEAR = 40
FEATURES = ["length", "transitions", "entropy", "digits", "upper", "dictionary", "place", "source_rank", "key_near", "sample_near", "assigned"]


def _totals(sizes: pd.Series) -> pd.Series:
    return sizes.map(lambda numbers: np.cumsum(numbers, dtype=np.int64))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, at (code points before), value, format, before, after, place: every candidate of whole texts."""
    either = "|".join(f"({pattern})" for pattern in FORMATS.values())
    own = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    # Texts are cut at the candidates: the pieces between them give places and neighbours in one pass.
    cut = own.withColumn("found", F.regexp_extract_all("text", F.lit(f"({either})"), F.lit(1))).filter(F.size("found") > 0)
    cut = cut.withColumn("pieces", F.split("text", either, -1)).withColumn("n_chars", F.length("text"))
    # Places are running totals, and a candidate leaves its text with its neighbours alone: memory follows the text's length.
    small_batches(docs.sparkSession)
    sizes = F.transform("found", lambda value, i: F.length(value) + F.length(F.get("pieces", i)))
    cut = cut.withColumn("ends", F.pandas_udf(_totals, "array<long>")(sizes))
    hit = F.transform(
        "found",
        lambda value, i: F.struct(
            value.alias("value"), (F.get("ends", i) - F.length(value)).alias("at"), F.right(F.get("pieces", i), F.lit(NEAR)).alias("before"),
            F.left(F.get("pieces", i + 1), F.lit(NEAR)).alias("after"),
        ),
    )
    each = cut.select("doc_id", "source", "n_chars", F.explode(hit).alias("hit")).select("doc_id", "source", "n_chars", "hit.*")
    names = F.lit(None).cast("string")
    for name, pattern in reversed(FORMATS.items()):
        names = F.when(F.col("value").rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(names)
    return each.select(
        "doc_id", "source", "at", "value", names.alias("format"), "before", "after", (F.col("at") / F.col("n_chars")).alias("place"),
    )


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, docs: lower-case letter words of the corpus that at least ``DICTIONARY_DOCS`` documents hold."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,19}"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("docs")).filter(F.col("docs") >= DICTIONARY_DOCS)


def transitions(words: DataFrame) -> DataFrame:
    """pair, weight: log of the chance of the second of two letters after the first, over the dictionary's words."""
    pairs = words.filter(F.length("word") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("pair"), "docs"
    )
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    firsts = counts.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("all"))
    joined = counts.join(firsts, F.substring("pair", 1, 1) == F.col("first"))
    return joined.select("pair", F.log(F.col("n") / F.col("all")).alias("weight"))


def _entropy(value: Column) -> Column:
    letters = F.split(value, "")
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.length(value))
    return -F.aggregate(shares, F.lit(0.0), lambda total, p: total + p * F.log2(p))


def featured(found: DataFrame, words: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per distinct (value, before, after, source, place) of ``found`` with the features; values are measured once."""
    values = found.select("value").distinct()
    weights = transitions(words)
    lower = F.lower("value")
    pairs = values.filter(F.length("value") > 1).select(
        "value", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: lower.substr(i, F.lit(2)))).alias("pair")
    )
    followed = pairs.join(weights, "pair", "left").groupBy("value").agg(F.avg(F.coalesce("weight", F.lit(-12.0))).alias("transitions"))
    runs = values.select("value", F.explode(F.regexp_extract_all(lower, F.lit(r"\p{L}{3,19}"), F.lit(0))).alias("word"))
    covered = runs.join(words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    measured = (
        values.join(followed, "value", "left").join(covered, "value", "left")
        .select(
            "value",
            F.length("value").cast("double").alias("length"),
            F.coalesce("transitions", F.lit(-12.0)).alias("transitions"),
            _entropy(F.col("value")).alias("entropy"),
            (F.length(F.regexp_replace("value", "[^0-9]+", "")) / F.length("value")).alias("digits"),
            (F.length(F.regexp_replace("value", "[^A-Z]+", "")) / F.length("value")).alias("upper"),
            (F.coalesce("covered", F.lit(0)) / F.length("value")).alias("dictionary"),
        )
    )
    placed = found.join(measured, "value").join(sources, F.col("source").eqNullSafe(F.col("of_source")), "left")
    flag = lambda condition: condition.cast("double")
    return placed.drop("of_source").withColumns(
        {
            "source_rank": F.coalesce("source_rank", F.lit(0.0)),
            "key_near": flag(F.col("before").rlike(KEY_WORDS) | F.col("after").rlike(KEY_WORDS)),
            "sample_near": flag(F.col("before").rlike(SAMPLE_WORDS) | F.col("after").rlike(SAMPLE_WORDS) | F.col("value").rlike(SAMPLE_WORDS)),
            "assigned": flag(F.col("before").rlike(r"""[=:]\s*["']?$""")),
        }
    )


def self_labelled(features: DataFrame) -> DataFrame:
    """Add secret: 1 or 0 where the candidate labels itself, else null."""
    known = F.col("format").isin("aws_key", "github_token", "slack_token", "google_key", "private_key", "jwt")
    named = F.col("before").rlike(KEY_WORDS + r"""[\w.-]*\s*[=:]\s*["']?$""")
    plain = F.col("format").isin("long_number", "long_word")
    label = F.when(F.col("sample_near") == 1, 0).when(known | named, 1).when(plain, 0)
    return features.withColumn("secret", label)


def scanned(docs: DataFrame, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every candidate of ``docs`` with its features, score (0 to 1) and whether it is a secret.

    ``labelled`` has the columns value, before, after and secret (0 or 1).
    """
    found = stored(candidates(docs))
    words = stored(dictionary(docs))
    # How dense candidates are in a source, a bounded number for each source.
    per_source = docs.groupBy(F.col("source").cast("string").alias("of_source")).agg(F.count("*").alias("n"))
    hits = found.groupBy(F.col("source").alias("hit")).agg(F.countDistinct("doc_id").alias("k"))
    sources = per_source.join(hits, F.col("of_source").eqNullSafe(F.col("hit")), "left").select(
        "of_source", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("source_rank")
    )
    features = stored(self_labelled(featured(found, words, sources)))
    if labelled is not None:
        given = labelled.select(*[F.col(c).alias(f"given_{c}") for c in ("value", "before", "after", "secret")])
        same = [F.col(c).eqNullSafe(F.col(f"given_{c}")) for c in ("value", "before", "after")]
        joined = features.drop("secret").join(given, same[0] & same[1] & same[2], "left")
        features = joined.withColumn("secret", F.col("given_secret")).drop("given_value", "given_before", "given_after", "given_secret")
    examples = features.filter("secret is not null").select(*FEATURES, "value", F.col("secret").cast("double").alias("label"))
    examples = stored(examples.orderBy(F.xxhash64("value", *FEATURES)).limit(train_rows))
    labels = [r["label"] for r in examples.select("label").distinct().collect()]
    if len(labels) < 2:
        score = F.lit(labels[0] if labels else 0.0)
        return features.withColumn("score", score).withColumn("is_secret", score >= 0.5)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(assembler.transform(examples))
    judged = model.transform(assembler.transform(features))
    return judged.withColumn("score", vector_to_array("probability")[1]).withColumn("is_secret", F.col("score") >= 0.5)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Every candidate: doc_id, at, length, format, score, is_secret. The value itself is not shown but as a hash."""
    return scanned(docs).select(
        "doc_id", "at", F.length("value").cast("long").alias("length"), "format", F.sha2("value", 256).alias("value_sha256"),
        F.round("score", 6).alias("score"), "is_secret",
    )
