"""SQL surface: a temporary function for sentences of a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausula.plans.segment import Options, segmented, sentence_rows


def create_sentence_view(spark: SparkSession, table: str, view: str, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A view with one row for each sentence of a table, for SQL users; it stays a narrow native plan."""
    rows = sentence_rows(spark.table(table), options, id_col, text_col)
    rows.createOrReplaceTempView(view)
    return rows


def register_sentences(spark: SparkSession, name: str = "sentences") -> None:
    """A table function sentences(text) for LATERAL joins over few rows; views are the way for large tables."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="para_idx int, sent_idx int, sentence string")
    class Sentences:
        def eval(self, nested):
            for p, sentences in enumerate(nested or []):
                for s, sentence in enumerate(sentences):
                    yield p, s, sentence

    spark.udtf.register(name, Sentences)


def nested_column(text_col: str = "text", options: Options = Options()):
    return segmented(text_col, options).alias("paragraphs")


