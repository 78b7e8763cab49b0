"""The named queries of the training-data operators, each over its whole table, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pagewise.llm import chosenpath, forest, leaks, licenses, mixing, packing, pii, quality, radix, simhash, sitetree, warc, whitening
from pagewise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def llm_queries() -> dict[str, Query]:
    return {
        "op1_temperature_mixing": lambda spark, folder: mixing.mixing_digest(table(spark, folder, "documents")),
        "op2_secret_forest": lambda spark, folder: leaks.secrets_digest(table(spark, folder, "documents")),
        "op3_chosen_path": lambda spark, folder: chosenpath.near_duplicates(table(spark, folder, "documents")),
        "op4_feistel_pseudonyms": lambda spark, folder: pii.pii_digest(table(spark, folder, "documents")),
        "op5_site_style_tree": lambda spark, folder: sitetree.main_text(table(spark, folder, "pages")),
        "op6_projection_forest": lambda spark, folder: forest.neighbours(table(spark, folder, "embeddings")),
        "op7_licence_scan": lambda spark, folder: licenses.licence_digest(table(spark, folder, "documents")),
        "op8_nnls_packing": lambda spark, folder: packing.pack(table(spark, folder, "documents")),
        "op9_warc_archives": lambda spark, folder: warc.archive_digest(table(spark, folder, "pages")),
        "op10_quality_cascade": lambda spark, folder: quality.quality_digest(table(spark, folder, "documents")),
        "op11_multi_index_simhash": lambda spark, folder: simhash.simhash_classes(table(spark, folder, "documents")),
        "op12_radix_prefix_trie": lambda spark, folder: radix.prefix_trie(table(spark, folder, "conversations")),
        "op13_exact_whitening": lambda spark, folder: whitening.whitened(table(spark, folder, "embeddings")),
        "pipeline": corpus_pipeline.run,
    }


def llm_oracle() -> dict[str, str]:
    return {
        "op3_chosen_path": chosenpath.ORACLE,
        "op6_projection_forest": forest.ORACLE,
        "op10_quality_cascade": quality.ORACLE,
        "op12_radix_prefix_trie": radix.ORACLE,
    }
