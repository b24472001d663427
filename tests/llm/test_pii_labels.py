"""The labels that the driver gets are bounded, whatever is copied."""

from pyspark.sql import functions as F

from paddock.llm import pii


def test_copies_of_a_text_are_labelled_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda sample, recall: seen.append(len(sample)))
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("call 555 123 4567 or mail bob at example dot org, 10 0 0 1").alias("text"))
    others = spark.range(40).select((F.col("id") + 9000).alias("doc_id"), F.concat(F.lit("text number "), F.col("id"), F.lit(" with mail of bob@example.org")).alias("text"))
    found = pii.find_pii(copies.unionByName(others), sample_rows=20_000)
    assert found.count() == 3040 and 0 < seen[0] < 1000
    pii.find_pii(copies, sample_rows=100).count()
    assert seen[1] < 200
