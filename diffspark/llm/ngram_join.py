"""Exact Jaccard self-join on word shingles with prefix filters under several global token orders.

Two sets with Jaccard similarity of at least t share a token among the first ``n - ceil(t n) + 1`` tokens of each, under
*any* total order of all tokens that both use.  A pair must pass that test under every order of ``ORDERS`` before it is verified.
The orders start from the number of documents that hold a token (all documents are counted), rarest first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.llm import linking, storage
from diffspark.llm import textbatch as tb
from diffspark.llm.shingles import shingle_sets

FLUSH = 3_000_000  # postings that a task gathers before it deals them out
ORDERS = 3


def _node(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _planes(tokens: np.ndarray) -> bytes:
    """Ascending 64-bit integers with all first bytes together, then all second bytes, and so on: the first ones compress."""
    return np.ascontiguousarray(tokens.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    octets = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return octets.view(">u8").ravel().astype(np.uint64)


def set_keys(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, n_shingles, node)``: ``node`` names the shingle set, equal for equal sets and NULL for the empty set."""

    def run(batches):
        for batch in batches:
            n, nodes = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row, tokens in shingle_sets(batch.column(1), size):
                n[row] = len(tokens)
                if len(tokens):
                    nodes[row] = _node(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(nodes, pa.int64())], ["id", "n_shingles", "node"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id bigint, n_shingles bigint, node bigint")


def shared_tokens(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """``(node, tokens array<long>, counts array<long>)``: the tokens of each set that another set holds too, and how many do.

    Tasks deal (hash, node) postings out in packed blocks by hash range; equal sets of a task go out once.  The receiving
    task counts the sets of every hash and deals those that two or more hold back in blocks by node.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shift = np.uint64(64 - max(1, (partitions - 1).bit_length()))

    def blocks(place, tokens, owner, names, counts=None):
        """Rows of the postings of each ``place``, ascending: tokens, sets as places in a list of their own, and counts."""
        used, begin = np.unique(place, return_index=True)
        cuts = [*begin.tolist(), len(place)]
        for k, bucket in enumerate(used.tolist()):
            at = slice(cuts[k], cuts[k + 1])
            own, short = np.unique(owner[at], return_inverse=True)
            wide = np.uint16 if len(own) <= 1 << 16 else np.uint32
            row = [bucket, _planes(tokens[at]), names[own].tobytes(), short.astype(wide).tobytes()]
            if counts is not None:
                row.append(np.minimum(counts[at], np.iinfo(np.uint32).max).astype(np.uint32).tobytes())
            kinds = [pa.int64(), *[pa.binary()] * (len(row) - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["bucket", "tokens", "names", "places", "counts"][: len(row)]
            )

    def unpacked(batches):
        """All postings of the task: tokens, nodes and counts."""
        tokens, nodes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for batch in batches:
            for row in batch.to_pylist():
                tokens.append(_from_planes(row["tokens"]))
                wide = np.uint16 if len(row["places"]) == 2 * len(tokens[-1]) else np.uint32
                nodes.append(np.frombuffer(row["names"], np.int64)[np.frombuffer(row["places"], wide)])
                counts.append(np.frombuffer(row.get("counts") or b"", np.uint32))
        return np.concatenate(tokens), np.concatenate(nodes), np.concatenate(counts)

    def deal(batches):
        held: dict[int, np.ndarray] = {}
        count = 0

        def flush():
            tokens = np.concatenate(list(held.values()))
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(t) for t in held.values()])
            names = np.array(list(held), np.int64)
            held.clear()
            order = np.argsort(tokens, kind="stable")
            yield from blocks(tokens[order] >> shift, tokens[order], owner[order], names)

        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0), size):
                if not len(tokens):
                    continue
                node = _node(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest())
                if node not in held:
                    held[node] = tokens
                    count += len(tokens)
                if count >= FLUSH:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    def runs(values: np.ndarray) -> np.ndarray:
        """Where each run of equal values begins, and the end."""
        return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)

    def repeats(values: np.ndarray) -> np.ndarray:
        edge = runs(values)
        return np.repeat(np.diff(edge), np.diff(edge))

    def meet(batches):
        tokens, nodes, _ = unpacked(batches)
        order = np.argsort(tokens, kind="stable")
        tokens, nodes = tokens[order], nodes[order]
        keep = repeats(tokens) > 1
        tokens, nodes = tokens[keep], nodes[keep]
        order = np.lexsort((nodes, tokens))  # equal sets of several tasks count once
        tokens, nodes = tokens[order], nodes[order]
        keep = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])])[: len(tokens)]
        tokens, nodes = tokens[keep], nodes[keep]
        counts = repeats(tokens)
        keep = counts > 1
        tokens, nodes, counts = tokens[keep], nodes[keep], counts[keep]
        names, owner = np.unique(nodes, return_inverse=True)
        place = tb.mix(nodes.view(np.uint64)) >> shift
        order = np.argsort(place, kind="stable")
        yield from blocks(place[order], tokens[order], owner[order], names, counts[order])

    def gather(batches):
        tokens, nodes, counts = unpacked(batches)
        order = np.argsort(nodes, kind="stable")
        tokens, nodes, counts = tokens[order].view(np.int64), nodes[order], counts[order].astype(np.int64)
        edge = runs(nodes)
        for at in range(0, len(edge) - 1, 1000):
            cut = edge[at : at + 1001]
            offsets = pa.array((cut - cut[0]).astype(np.int32))
            a, b = int(cut[0]), int(cut[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes[cut[:-1]]),
                    pa.ListArray.from_arrays(offsets, pa.array(tokens[a:b])),
                    pa.ListArray.from_arrays(offsets, pa.array(counts[a:b])),
                ],
                ["node", "tokens", "counts"],
            )

    packed = "bucket bigint, tokens binary, names binary, places binary"
    dealt = docs.select(text_col).mapInArrow(deal, packed).repartition(partitions, "bucket")
    back = dealt.mapInArrow(meet, packed + ", counts binary").repartition(partitions, "bucket")
    return back.mapInArrow(gather, "node bigint, tokens array<bigint>, counts array<bigint>")


def _order(k: int) -> Column:
    """The sort key of a token under order ``k``: rarest first by a coarser count for each next order, then another hash."""
    return F.expr(
        {
            0: "transform(arrays_zip(tokens, counts), x -> struct(x.counts as c, x.tokens as t, x.tokens as token))",
            1: "transform(arrays_zip(tokens, counts), x -> struct(cast(log2(x.counts) as int) as c, xxhash64(x.tokens) as t, x.tokens as token))",
            2: "transform(arrays_zip(tokens, counts), x -> struct(cast(log2(x.counts) / 3 as int) as c, -xxhash64(x.tokens, 1) as t, x.tokens as token))",
        }[k]
    )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row; two rows link when ``100 |A & B| >= percent |A | B|``.

    ``component_id`` is the smallest id reachable by links.  Rows of equal sets link; a NULL, empty or blank text has no shingles
    and links with nothing; a NULL id keeps its row, in the component of its text; repeated ids give
    repeated rows, each in the component of its own text.  Other columns are not read.  No rows give no rows.
    """
    storage.small_batches(docs.sparkSession)
    keys = storage.kept(set_keys(docs, id_col, text_col, size), "set-keys")
    heads = keys.where("node is not null").groupBy("node").agg(F.min("id").alias("head"), F.first("n_shingles").alias("n"))
    heads = storage.kept(heads, "set-heads")

    # A partner holds at least percent of the tokens, so that many tokens must be held elsewhere.
    least = F.expr(f"({percent} * n + 99) div 100")
    many = shared_tokens(docs, text_col, size)
    many = many.join(heads.select("node", "n"), "node").where(F.size("tokens") >= least).withColumnRenamed("node", "id")
    # The tokens that only this row holds come first in every order; they take up their part of the prefix.
    many = many.withColumn("room", F.col("n") - least + 1 - (F.col("n") - F.size("tokens"))).where("room > 0")
    for k in range(ORDERS):
        many = many.withColumn(f"prefix{k}", F.slice(F.transform(F.sort_array(_order(k)), lambda x: x["token"]), 1, F.col("room").cast("int")))
    many = many.select("id", "n", "tokens", *[f"prefix{k}" for k in range(ORDERS)])
    many = storage.kept(many, "near-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        def side(letter: str) -> DataFrame:
            return many.select(*[F.col(c).alias(f"{c}_{letter}" if c != "id" else letter) for c in many.columns])

        both = pairs.join(side("a"), "a").join(side("b"), "b")
        passes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        for k in range(1, ORDERS):
            passes &= F.arrays_overlap(f"prefix{k}_a", f"prefix{k}_b")
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return both.where(passes).where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")

    # Position of a token in the whole set under the first order: the tokens that only this row holds stand before.
    alone = F.col("n") - F.size("tokens") + 1
    postings = many.select(F.posexplode("prefix0").alias("place", "key"), "id", "n", alone.alias("alone"))
    postings = postings.select("key", "id", "n", (F.col("place") + F.col("alone")).alias("place"))

    def fits(x: Column, y: Column) -> Column:
        """The first token that two sets share leaves enough tokens after it on both sides, if they are similar."""
        rest = F.least(x["n"] - x["place"], y["n"] - y["place"]) + 1
        return (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & (
            (100 + percent) * rest >= percent * (x["n"] + y["n"])
        )

    labels = linking.connect(postings, verify, fits)
    named = heads.join(labels, heads["node"] == labels["id"], "left").select("node", "head", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("head").alias("component_id"))
    named = storage.kept(named.join(lowest, "component").select("node", "component_id"), "set-components")
    return keys.join(named, "node", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
