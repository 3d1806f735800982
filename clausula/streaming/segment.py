"""Segmentation of streams: stateless, so the batch plan runs unchanged in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausula.plans.segment import Options, sentence_rows


def segment_stream(stream: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return sentence_rows(stream, options, id_col, text_col)


def windowed_counts(stream: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour", options: Options = Options(), text_col: str = "text") -> DataFrame:
    """Sentences by event-time window; later rows than `late` are dropped by the watermark."""
    counted = stream.withWatermark(time_col, late).select(time_col, F.size(F.flatten(_nested(text_col, options))).alias("n"))
    return counted.groupBy(F.window(time_col, window)).agg(F.sum("n").alias("sentences"), F.count("*").alias("docs"))


def _nested(text_col: str, options: Options):
    from clausula.plans.segment import segmented

    return segmented(text_col, options)


def write_sentences(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
