"""Batches that go to Python workers."""

import pyarrow as pa
import pytest

from diffspark.llm import ngram_join, phrases, storage


@pytest.mark.parametrize("operator", [ngram_join.jaccard_components, phrases.collocations])
def test_batches_of_long_texts_stay_small(spark, operator):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 2000) as text", "'en' as lang").coalesce(1)
    operator(docs.limit(0))
    got = docs.select("text").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 3000
    assert max(r["bytes"] for r in got) <= storage.BATCH_BYTES + (1 << 20)
