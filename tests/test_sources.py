import os

from pyspark.sql import functions as F

import __spark_entry__
from clausula.functions.udtf import create_sentence_view, register_sentences
from clausula.plans.segment import flattened, segmented, sentence_rows
from clausula.sources import files
from clausula.streaming.segment import segment_stream, windowed_counts, write_sentences


def test_files(spark, tmp_path):
    for name, text in (("b.txt", " B one. B two. \n"), ("a.txt", "A one."), ("a-clean.txt", "no"), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    rows = {os.path.basename(r.path): (r.text, r.bytes) for r in files.read_directory(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("A one.", 6), "b.txt": ("B one. B two.", 16)}
    assert files.read_text_file(spark, str(tmp_path / "b.txt")).first().text == "B one. B two."
    out = spark.createDataFrame([("/x.y/a.txt", 10), ("/x.y/b", 2048), ("c.tar.gz", 3 << 20)], "p string, n long").select(files.output_path("p").alias("p"), files.human_size("n").alias("n")).collect()
    assert [tuple(r) for r in out] == [("/x.y/a-clean.txt", "10 B"), ("/x.y/b-clean", "2.0 KB"), ("c.tar-clean.gz", "3.0 MB")]


def test_output_forms(spark, tmp_path):
    docs = files.literal_text(spark, 'One. "Two. Three." Four.').select("doc_id", flattened(segmented("text")).alias("sentences"))
    files.write_lines(docs, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == docs.first().sentences
    assert docs.select(files.as_lines("sentences", "dialog").alias("x")).first().x.startswith("One.\n\n")
    lines = files.numbered_lines(sentence_rows(files.literal_text(spark, "One. Two.\n\nThree."))).orderBy("para_idx", "sent_idx")
    assert [r.line for r in lines.collect()] == ["1. One.", "2. Two.", "3. Three."]


def test_stream_matches_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    write_sentences(segment_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(sentence_rows(spark.read.parquet(str(tmp_path / "in"))).collect())


def test_windowed_counts(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:01:00' ts, 'Hot tea. Cold milk.' text UNION ALL SELECT timestamp'2024-01-01 00:09:00', 'E f.' UNION ALL SELECT timestamp'2024-01-01 00:11:00', 'G.'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.sentences, r.docs) for r in spark.table("counts").collect()) == [(1, 1), (3, 2)]


def test_sql_surface(spark):
    files.literal_text(spark, "One here. Two here.").createOrReplaceTempView("docs")
    create_sentence_view(spark, "docs", "docs_sentences")
    assert [r.sentence for r in spark.sql("SELECT sentence FROM docs_sentences ORDER BY sent_idx").collect()] == ["One here.", "Two here."]
    register_sentences(spark)
    spark.table("docs").select("doc_id", segmented("text").alias("nested")).createOrReplaceTempView("nested_docs")
    assert spark.sql("SELECT s.sentence FROM nested_docs, LATERAL sentences(nested) s").count() == 2


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["doc_id", "para_idx", "sent_idx", "sentence"] and out.limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plan_is_narrow(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", segmented("text").alias("p"))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and docs.agg(F.count("*")).first()[0] == 200
