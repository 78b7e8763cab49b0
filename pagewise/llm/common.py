"""Helpers the training-data operators share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.session import shared_folder

#: Characters that separate words in the text contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later steps read only the columns they need, and a lost executor costs a re-read. The files go when the
    session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand texts to Python workers in batches of at most ``rows``, so that long texts do not pile up in memory."""
    if int(spark.conf.get(BATCH_SETTING)) > rows:
        spark.conf.set(BATCH_SETTING, str(rows))


def shipped(module: str) -> None:
    """Send the functions of ``module`` to the workers as they are: the package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row, also where ``body`` uses it many times."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
