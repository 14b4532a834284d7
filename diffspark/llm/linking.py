"""Links and components of rows that share keys, without writing out all pairs of a group.

Rows that share a key are candidates.  A key shared by many rows would give pairs with the square of their number; but rows
already in one component need no test against each other.  So each round first tests every row of a key against a few *pivots* of
that key only and joins what the exact test confirms into components.  After the rounds, all pairs that share a
key and lie in *different* components are tested, so no link between components is lost; most keys are then of one component and
give no pair.  Components are those of the full link graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.llm import storage


#: Pivot rounds end when the pairs that are left are not many more than the next round would test; the result is the same.
PAIRS_PER_ROW = 2
MORE_PIVOTS = 8
EDGES_PER_TASK = 500_000
#: Keys (8 bytes each) up to which the list of those that more than two rows hold is broadcast.
BROADCAST_KEYS = 1_000_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``edges (a, b)``; the component is named by its smallest id.

    Distributed union-find: large-star and small-star steps hang every node below the smallest neighbour it knows, until
    nothing moves; the number of rounds grows with the logarithm of a component's diameter.  Each round is written to the shared
    folder.  A loop or repeated edge changes nothing.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = storage.kept(now, "edges")
    seen = _fingerprint(now)
    while seen[0]:
        # A small graph takes few tasks, a large one as many as it has EDGES_PER_TASK.
        own = now.coalesce(1 + seen[0] // EDGES_PER_TASK)
        both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(1 + 2 * seen[0] // EDGES_PER_TASK)
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("low", F.inline(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))))
        after = storage.kept(small.where("a != b").select("a", "b").distinct(), "stars")
        storage.delete(now)
        now, last, seen = after, seen, _fingerprint(after)
        if seen == last:
            break
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def shared(postings: DataFrame) -> DataFrame:
    """The distinct postings ``(key, id)`` of the keys that two or more rows hold, written to the shared folder.

    Most shared keys are held by two rows, which their least and greatest id name; only longer groups are looked up again.
    """
    dealt = postings.repartition("key")
    groups = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1")
    groups = storage.kept(groups, "shared-keys")
    twos = groups.where("n = 2").select("key", F.explode(F.array("low", "high")).alias("id"))
    large = groups.where("n > 2").select("key")
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large.hint("shuffle_hash")
    out = storage.kept(twos.union(postings.join(large, "key", "left_semi").select("key", "id")), "shared-postings")
    storage.delete(groups)
    return out


def connect(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    fits: Callable[[Column, Column], Column] | None = None,
    known: DataFrame | None = None,
    rounds: int = 6,
) -> DataFrame:
    """``(id, component)`` of the rows linked with another one, from distinct ``postings (key, id, more columns)``.

    ``verify`` takes distinct pairs ``(a, b)``, a < b, and returns those that are links.  ``fits`` says of two postings (structs of
    all columns) of one key whether they can make a candidate pair.  With ``known (id, more columns)`` the postings are :func:`shared`
    ones, and the struct that ``fits`` gets, in the last pass alone, is a row of ``known``.
    """
    if known is None:
        many = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # One row for each key on the hashed side, so a key of any size costs it one row.
        many = postings.join(many.select("key").hint("shuffle_hash"), "key", "left_semi")
    else:
        many = postings
    now = storage.kept(many.select("key", F.struct(*postings.columns).alias("row"), F.col("id").alias("label")), "postings")
    links = None
    labels = None

    def candidates(both: DataFrame, told: bool = True) -> DataFrame:
        if fits is not None and told:
            both = both.where(fits(F.col("row"), F.col("other")))
        return both.select(F.least("row.id", "other.id").alias("a"), F.greatest("row.id", "other.id").alias("b")).distinct()

    def absorb(found: DataFrame, last: bool = False):
        nonlocal links, labels, now
        new = storage.kept(found, "links")
        if not new.head(1):
            storage.delete(new)
            return
        links = new if links is None else links.union(new)
        labels = storage.kept(components(links), "labels")
        if last:
            return
        named = labels.select(F.col("id").alias("named_id"), "component")
        fresh = now.join(named, F.col("row.id") == F.col("named_id"), "left")
        fresh = fresh.select("key", "row", F.coalesce("component", "label").alias("label"))
        mixed = fresh.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
        after = storage.kept(fresh.join(mixed.select("key"), "key", "left_semi"), "postings")
        storage.delete(now)
        now = after

    for turn in range(rounds):
        sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.groupBy("key").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("within"))
        left = sizes.agg(F.sum("rows").alias("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("within")) / 2).alias("pairs")).first()
        if (left["pairs"] or 0) <= PAIRS_PER_ROW * MORE_PIVOTS**turn * (left["rows"] or 0):
            break
        # Pivots of each key by chance, more of them in each round, so all rounds together cost little more than the last.
        chance = F.xxhash64("row.id", F.lit(turn))
        lots = now.groupBy("key", F.pmod(chance, F.lit(MORE_PIVOTS**turn)).alias("lot"))
        if known is None:
            pivots = lots.agg(F.min(F.struct(chance, "label", "row")).alias("pivot"))
            pivots = pivots.select("key", F.col("pivot.label").alias("other_label"), F.col("pivot.row").alias("other"))
        else:  # numbers alone are aggregated without a sort
            pivots = lots.agg(F.min_by("label", chance).alias("other_label"), F.min_by("row.id", chance).alias("id"))
            pivots = pivots.select("key", "other_label", F.struct("id").alias("other"))
        pivots = storage.kept(pivots, "pivots")
        absorb(verify(candidates(now.join(pivots, "key").where("label != other_label"), known is None)))
        storage.delete(pivots)
    if known is not None:
        wide = known.select("id", F.struct(*known.columns).alias("wide"))
        now = storage.kept(now.join(wide, F.col("row.id") == F.col("id")).select("key", F.col("wide").alias("row"), "label"), "postings")
    others = now.select("key", F.col("row").alias("other"), F.col("label").alias("other_label"))
    absorb(verify(candidates(now.join(others, "key").where("label < other_label"))), last=True)
    storage.delete(now)
    if labels is None:
        return postings.sparkSession.createDataFrame([], "id bigint, component bigint")
    return labels
