"""Token ids as files: frequency-ranked ids, byte-aligned variable length, control bytes apart from the data bytes.

A file row is a block of whole documents in ascending id order: their ids, token counts and checksummed streams.  Each
control byte holds four 2-bit fields, the byte length less one of the next four ranks; the data stream holds the ranks'
low bytes.  A block is decoded with two table lookups and no loop over tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import storage
from diffspark.llm.wordbpe import library, units

END_ID = 1
BLOCK_TOKENS = 1 << 18

_LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1  # of the four ranks of a control byte
_KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit ranks."""
    ranks = np.asarray(ranks, np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fields = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    fields[: len(ranks)] = extra
    control = (fields.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    octets = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` ranks of two streams written by :func:`pack`."""
    return _ranks(_LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count], np.frombuffer(data, np.uint8))


def _ranks(lengths: np.ndarray, octets: np.ndarray) -> np.ndarray:
    """Ranks from their byte lengths and bytes."""
    starts = np.cumsum(lengths) - lengths
    octets = np.concatenate([octets, np.zeros(3, np.uint8)])
    wide = octets[starts].astype(np.uint32)
    for j in range(1, int(lengths.max(initial=1))):
        wide |= octets[starts + j].astype(np.uint32) << np.uint32(8 * j)
    return wide & _KEEP[lengths - 1]


def pack_all(ranks: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data bytes of many runs of ranks, given one after the other, as :func:`pack` makes them of each."""
    ranks = np.asarray(ranks, np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    bytes_of = -(-counts // 4)
    fields = np.zeros(4 * int(bytes_of.sum()), np.uint8)
    first, ends = 4 * (np.cumsum(bytes_of) - bytes_of), np.cumsum(counts)
    fields[np.arange(len(ranks)) + np.repeat(first - (ends - counts), counts)] = extra
    f = fields.reshape(-1, 4)
    control = f[:, 0] | (f[:, 1] << 2) | (f[:, 2] << 4) | (f[:, 3] << 6)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    stops = np.concatenate([[0], np.cumsum(extra + np.int64(1))])[np.concatenate([[0], ends])]
    return _binary(control, np.concatenate([[0], np.cumsum(bytes_of)])), _binary(data, stops)


def _binary(data: np.ndarray, stops: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpack_all(control: pa.Array, data: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The ranks of many runs written by :func:`pack` or :func:`pack_all`, one after the other."""
    octets, values = (np.frombuffer(b"".join(a.to_pylist()), np.uint8) for a in (control, data))
    fields = _LENGTHS[octets].ravel()
    padded = 4 * -(-counts // 4)
    place = np.arange(len(fields)) - np.repeat(np.cumsum(padded) - padded, padded)
    return _ranks(fields[place < np.repeat(counts, padded)], values)


def _runs(counts: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows of about ``BLOCK_TOKENS`` tokens, or one row each."""
    ends = np.cumsum(counts)
    out, a = [], 0
    while a < len(ends):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_TOKENS, "right"))
        out.append((a, max(b, a + 1)))
        a = out[-1][1]
    return out


def _tokenise(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Coded ids of every document; one row of each task also has how often each id stands in all of the task's (``seen``)."""

    def run(batches):
        lib = library(vocabulary)
        total, last = np.zeros(max(lib.words) + 1, np.int64), None
        for batch in batches:
            for found in units(batch.column(1)):
                ids, counts = lib.ids_of(found)
                n, ends = len(counts), np.cumsum(counts)
                # Ids of such vocabularies rise as words get rarer, so they already pack well.
                coded = np.insert(ids.astype(np.uint32), ends, END_ID)
                total += np.bincount(coded, minlength=len(total))
                control, data = pack_all(coded, counts + 1)
                if last is not None:
                    yield last
                last = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(found.first, n), pa.array(counts + 1), control, data, pa.nulls(n, pa.binary())],
                    ["doc_id", "n_tokens", "control", "data", "seen"],
                )
        if last is not None:
            seen = pa.array([zlib.compress(total.astype("<i8").tobytes())] + [None] * (last.num_rows - 1), pa.binary())
            yield last.set_column(4, "seen", seen)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, control binary, data binary, seen binary")


def _frequencies(coded: DataFrame) -> np.ndarray:
    """Occurrences of each id over all documents; the vocabulary bounds the rows that reach the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for seen in batch.column(0):
                got = np.frombuffer(zlib.decompress(seen.as_buffer()), "<i8")
                total = got + (total if len(total) else 0)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    rows = coded.select("seen").where("seen is not null").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ids = np.array([r["id"] for r in rows], np.int64)
    counts = np.array([r["n"] for r in rows], np.int64)
    return ids[np.lexsort((ids, -counts))].astype(np.uint32)


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode every document with the tokenizers library, append ``END_ID`` and write ``path`` in ascending id order.

    ``path/blocks`` has one row per block: ``part, start`` (tokens of earlier blocks of the part), ``doc_ids, counts, control,
    data``; ``path/ranks`` the id of each rank; ``path/parts`` the first token number of each part.  A NULL or empty text is
    one ``END_ID``.  Rows with equal or NULL ids keep a row each (NULL first, equal ids by their ids' bytes).  Other
    columns are not read.  Encoding (which counts too) and writing each pass over the data once; the rows move once, coded.
    """
    spark = docs.sparkSession
    coded = storage.kept(_tokenise(docs, vocabulary, id_col, text_col), "token-ids")
    order = _frequencies(coded)
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(order)], "rank bigint, id bigint").write.parquet(f"{path}/ranks")
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)  # one number for each word of the vocabulary

    def run(batches):
        from pyspark import TaskContext

        part, start, held, pending = TaskContext.get().partitionId(), 0, 0, []

        def block():
            nonlocal start, held
            ids = np.concatenate([x for _, _, x in pending])
            control, data = pack(shared.value[ids])
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([[d for d, _, _ in pending]], pa.list_(pa.int64())),
                    pa.array([[n for _, n, _ in pending]], pa.list_(pa.int64())),
                    pa.array([control], pa.binary()),
                    pa.array([data], pa.binary()),
                ],
                ["part", "start", "n_tokens", "doc_ids", "counts", "control", "data"],
            )
            start, held = start + held, 0
            pending.clear()
            return row

        for batch in batches:
            documents, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a, b in _runs(counts):
                own = counts[a:b]
                ids = unpack_all(batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a), own)
                to = np.cumsum(own)
                for doc, n, y in zip(documents[a:b], own.tolist(), to.tolist(), strict=True):
                    pending.append((doc, n, ids[y - n : y]))
                    held += n
                    if held >= BLOCK_TOKENS:
                        yield block()
        if pending:
            yield block()

    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.drop("seen").withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange(count, "doc_id", F.xxhash64("doc_id", "data"))
    ordered.sortWithinPartitions("doc_id", "control", "data").mapInArrow(
        run,
        "part int, start bigint, n_tokens bigint, doc_ids array<bigint>, counts array<bigint>, control binary, data binary",
    ).write.parquet(f"{path}/blocks")
    storage.delete(coded)
    # One number for each part, so at most one for each shuffle partition.
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    total, firsts = 0, []
    for row in sorted(sizes, key=lambda r: r["part"]):
        firsts.append((row["part"], total))
        total += row["n"]
    spark.createDataFrame(firsts, "part int, first bigint").coalesce(1).write.parquet(f"{path}/parts")
    shared.unpersist()


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)`` of files written by :func:`write`; ``ids`` are little-endian 32-bit."""
    order = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    first = {r["part"]: r["first"] for r in spark.read.parquet(f"{path}/parts").collect()}

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = order[unpack(row["control"], row["data"], row["n_tokens"])].astype("<u4")
                ends = np.cumsum(row["counts"])
                begins = ends - row["counts"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(begins + first[row["part"]] + row["start"], pa.int64()),
                        pa.array(row["counts"], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)
