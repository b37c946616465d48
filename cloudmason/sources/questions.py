"""Question lists from lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmason.functions import text as X


def questions(lines: DataFrame) -> DataFrame:
    """key, question: lines that end in a question mark without list marks, the first of each folded wording.

    lines: doc_id, line_no, line."""
    bare = X.strip_blanks(F.regexp_replace("line", "^[\\s]*-+", ""))
    d = lines.withColumn("line", bare).filter(F.col("line").endswith("?")).withColumn("line", X.strip_ordinal(F.col("line")))
    return d.groupBy(X.fold_line(F.col("line")).alias("key")).agg(F.min_by("line", F.struct("doc_id", "line_no")).alias("question"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """From a text file, one question a line; order within the file decides which wording comes first."""
    from pyspark.sql.types import StringType

    d = spark.read.text(path).select(F.col("value").cast(StringType()).alias("line"), F.input_file_name().alias("doc_id"), F.monotonically_increasing_id().alias("line_no"))
    return questions(d)
