"""What workers hold."""

import pyarrow as pa
from pyspark.sql import functions as F

from prismara.llm import piece_bpe, toxicity
from prismara.llm.queries import piece_model


def test_a_worker_forgets_chunks_when_its_task_ends(spark):
    docs = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id"), F.lit(" other"), F.col("id")).alias("text"))
    path = piece_model()

    def held(batches):
        for batch in batches:
            c = piece_bpe.coder(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(c.memory) + len(c.memory.older)] * batch.num_rows, pa.int64())], names=["held"])

    assert piece_bpe.encode_decode(docs, path).count() == 300
    assert len(piece_bpe.encode_decode(docs, path).where("n_tokens > 2").collect()) == 300
    assert spark.range(8, numPartitions=8).mapInArrow(held, "held long").agg(F.max("held")).first()[0] == 0


def test_terms_are_handed_on_in_small_parts(spark):
    docs = spark.range(2000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    taken = toxicity.sampled(docs, labels).collect()
    assert len(taken) == sum(1 for r in docs.where(~toxicity.held_out("doc_id")).collect()) and {len(r.places) for r in taken} == {len(taken[0].places)}
    assert toxicity.HANDED <= 512
