"""Documents to paragraphs to sentences: one narrow plan, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausula.functions import text as T
from clausula.functions.base import ADDED, ELLIPSIS, Text, col, deep_plans, let, strip, unmask
from clausula.operators import mergers as M
from clausula.operators import splitters as S
from clausula.operators.documents import unwrap_hard_wrapped


@dataclass(frozen=True)
class Options:
    """normalize: typographic quotes to ASCII; unwrap: join hard-wrapped lines first; split_dialog: split inside quotations; strict: empty text is an error."""

    normalize: bool = True
    unwrap: bool = False
    split_dialog: bool = True
    strict: bool = False


def paragraphs(c: Text) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col(c), "\n\n"), strip), lambda p: p != "")


def segment_sentences(c: Text, split_dialog: bool = True) -> Column:
    """The sentences of one paragraph."""
    deep_plans()

    def split(text: Column) -> Column:
        found = F.transform(S.detect(T.clean_bullets(text)), T.append_period)
        found = M.merge_ellipsis(found)
        if not split_dialog:
            found = M.merge_unclosed_quotes(found)
        for step in (M.merge_abbreviations, M.merge_attribution, M.merge_title_name, M.merge_numbered_title, M.merge_parenthetical, S.split_abbreviation, S.split_question_exclamation, S.split_quote_closing, S.split_ellipsis, S.split_list_items):
            found = step(found)
        found = F.transform(found, lambda s: T.strip_period_after_quote(T.post_process(s)))
        shown = F.transform(found, lambda s: strip(unmask(F.replace(F.replace(s, F.lit(ELLIPSIS + ADDED + "."), F.lit(ELLIPSIS)), F.lit(ADDED), F.lit("")))))
        return M.merge_leading_ellipsis(shown)

    def chosen(text: Column) -> Column:
        bullets = F.transform(S.split_unicode_bullets(text), unmask)
        return F.when(~T.needs_sentences(text), F.array(strip(unmask(text)))).when(F.size(bullets) > 1, bullets).otherwise(split(text))

    return let(T.mask_all(c), chosen)


def prepared(c: Text, options: Options = Options()) -> Column:
    """A document's text before it is split."""
    text = col(c)
    if options.strict:
        text = F.when(text == "", F.raise_error(F.lit("Empty Input"))).otherwise(text)
    text = unwrap_hard_wrapped(text) if options.unwrap else text
    return T.normalize_quotes(text) if options.normalize else text


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores if it is small: splitting costs far more than reading, and a small file, or one of a single row group, is one task else.

    Small is less than a read's usual part (spark.sql.files.maxPartitionBytes) for each core, by the optimiser's estimate,
    which runs nothing. Larger inputs and streams stay as they are.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores, part = spark.sparkContext.defaultParallelism, spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * part else df


def sentence_rows(df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, para_idx, sent_idx, sentence. Paragraphs are rows of their own before they are split, so a long document is many small rows."""
    rows = spread(df.select(id_col, text_col)).select(F.col(id_col).alias(id_col), F.posexplode(paragraphs(prepared(text_col, options))).alias("para_idx", "paragraph"))
    return rows.select(id_col, "para_idx", F.posexplode(segment_sentences("paragraph", options.split_dialog)).alias("sent_idx", "sentence"))


def segmented(c: Text, options: Options = Options()) -> Column:
    """array<array<string>>: the sentences of each paragraph; null for null."""
    return F.transform(paragraphs(prepared(c, options)), lambda p: segment_sentences(p, options.split_dialog))


def segment_documents(df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text", dedupe: bool = False) -> DataFrame:
    """df with a column paragraphs (nested). dedupe: equal texts (by a hash of 128 bits) are segmented once, at the price of a shuffle."""
    if not dedupe:
        return df.withColumn("paragraphs", segmented(text_col, options))
    key = "segment_key" + "_" * max(len(c) for c in df.columns)  # no column's name
    hashed = df.withColumn(key, F.md5(F.col(text_col).cast("binary")))
    distinct = hashed.where(F.col(key).isNotNull()).groupBy(key).agg(F.first(text_col).alias("text")).select(key, segmented("text", options).alias("paragraphs"))
    return hashed.join(distinct, key, "left").select(*df.columns, "paragraphs")


def segment_paragraphs(nested: Text) -> Column:
    """Each paragraph's sentences in one string."""
    return F.transform(col(nested), lambda p: F.array_join(p, " "))


def flattened(nested: Text) -> Column:
    return F.flatten(col(nested))
