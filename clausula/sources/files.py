"""Text files in, lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausula.functions.base import Text, col, strip
from clausula.operators.documents import format_dialog, format_grouped, group_quoted
from clausula.plans.segment import Options, segmented

CLEAN = "-clean"


def literal_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def read_text_file(spark: SparkSession, path: str) -> DataFrame:
    """One row: path, text (stripped), bytes."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), strip("value").alias("text"), F.col("_metadata.file_size").alias("bytes"))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """The *.txt files of a folder (not of those below), without those written by this library."""
    rows = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").text(path, wholetext=True)
    found = rows.select(F.col("_metadata.file_path").alias("path"), strip("value").alias("text"), F.col("_metadata.file_size").alias("bytes"))
    return found.where(~F.col("path").endswith(f"{CLEAN}.txt"))


def output_path(c: Text) -> Column:
    """The path with -clean before its extension."""
    return F.regexp_replace(col(c), F.lit(r"^(.*?)(\.[^./]*)?\z"), F.lit(f"$1{CLEAN}$2"))


def human_size(c: Text) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    n = col(c)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))


def numbered_lines(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sentence_rows with line: '1. sentence', numbered through the document. Sentences of a document are numbered by the ones before in (para_idx, sent_idx)."""
    from pyspark.sql import Window

    order = Window.partitionBy(id_col).orderBy("para_idx", "sent_idx")
    nth = F.row_number().over(order)
    return rows.withColumn("line", F.concat(nth.cast("string"), F.lit(". "), F.col("sentence")))


def numbered_sentences(df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sentence_rows and their lines of documents, numbered without a shuffle: a sentence's number is its place among those of all paragraphs."""
    placed = F.transform(segmented(text_col, options), lambda p, i: F.transform(p, lambda s, j: F.struct(i.alias("para_idx"), j.alias("sent_idx"), s.alias("sentence"))))
    rows = df.select(id_col, F.posexplode(F.flatten(placed)).alias("nth", "found"))
    return rows.select(id_col, "found.para_idx", "found.sent_idx", "found.sentence", F.concat((F.col("nth") + 1).cast("string"), F.lit(". "), F.col("found.sentence")).alias("line"))


def as_lines(sentences: Text, form: str = "lines") -> Column:
    """A document's flat sentences as text: lines, grouped (by quotation) or dialog."""
    s = col(sentences)
    shapes = {"lines": lambda: F.array_join(s, "\n"), "grouped": lambda: format_grouped(group_quoted(s)), "dialog": lambda: F.concat(format_dialog(s), F.lit("\n"))}
    return shapes[form]()


def write_lines(rows: DataFrame, path: str, sentences: Text = "sentences", form: str = "lines") -> None:
    """One text file for each task, one block for each document."""
    rows.select(as_lines(sentences, form).alias("value")).write.text(path)
