"""BPE encoding and decoding of documents with the rank-array merge of :mod:`diffspark.llm.wordbpe`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from diffspark.llm.wordbpe import encoder, units


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every document, one pass without a shuffle.

    NULL and empty texts give no ids and an empty string; a text of any length is held as a whole by its task, a few others with
    it.  Ids may be NULL or repeat; each row is encoded on its own.  No rows give no rows.  Other columns are not read, so their
    names cannot clash.  ``vocabulary`` is a path on the executors.
    """

    def run(batches):
        bpe = encoder(vocabulary)
        for batch in batches:
            for found in units(batch.column(1)):
                ids, counts = bpe.ids_of(found)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                listed = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(found.first, len(counts)), listed, bpe.decoded(ids, counts)], [id_col, "ids", "decoded"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
