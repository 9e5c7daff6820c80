"""Connected components by hooking and contraction, as joins and map-side combined aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, join_hot, save, save_counted


def _roots(step: DataFrame) -> DataFrame:
    """Parents (id, up) followed to their roots: each pass takes three steps at once, so that depth d needs about log3(d) of them."""
    while True:
        up1, up2 = (step.select(F.col("id").alias(f"id{i}"), F.col("up").alias(f"up{i}")) for i in (1, 2))
        three = step.join(up1, F.col("up") == F.col("id1")).join(up2, F.col("up1") == F.col("id2"))
        # where the third step still moves, the root may lie further up
        jump = save(three.select("id", F.col("up2").alias("up"), (F.col("up2") != F.col("up1")).alias("moves")), "cc-jump")
        drop_saved(step)
        step = jump
        if not jump.where("moves").limit(1).count():
            return step


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (id, component) for every end of ``edges``; component is the smallest id reachable.

    Each round, every node hooks on to the neighbour of highest rank if that outranks it (rank: number of neighbours,
    then a hash that changes from round to round), parents are followed to their roots, and the edges are rewritten to
    the roots. A root has at least as many neighbours as any neighbour of it, and roots are never neighbours; giving
    each root's unit to its neighbours in equal parts, no other node gets more than one unit. So at most half of the
    nodes are roots, and the rounds are at most the logarithm of the nodes: for a star one, for a chain in any order
    of its ids about log3. Hubs and large components are joined by join_hot(). Each round's tables are written to the shared folder, so that lineage stays short.

    Edges with a null end are ignored; loops and repeated edges change nothing; ids that only have loops are not
    returned (each is its own component). No edges give no rows.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    rest, left = save_counted(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels: DataFrame | None = None
    rounds = nodes = 0
    while left:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda n, x: F.struct(F.col(n).alias("n"), F.xxhash64(F.lit(rounds), x).alias("h"), F.col(x).alias("id"))  # noqa: B023, E731
        degree = both.groupBy("a").agg(F.count("*").alias("n"))
        best = join_hot(both, degree.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b", "n_b", 2 * left).groupBy("a").agg(F.count("*").alias("n_a"), F.max(rank("n_b", "b")).alias("top"))
        step = save(best.select(F.col("a").alias("id"), F.greatest("top", rank("n_a", "a"))["id"].alias("up")), "cc-step")
        jump = _roots(step)
        left_up, right_up = (jump.select(F.col("id").alias(f"i{x}"), F.col("up").alias(x)) for x in ("na", "nb"))
        moved = rest.join(left_up, F.col("a") == F.col("ina")).join(right_up, F.col("b") == F.col("inb")).where("na <> nb")
        shorter, left = save_counted(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "cc-edges")
        if labels is None:
            grown, nodes = save_counted(jump.select("id", F.col("up").alias("root")), "cc-labels")
        else:
            held = labels.groupBy("root").agg(F.count("*").alias("held"))
            next_up = save(held.join(jump.select(F.col("id").alias("root"), "up"), "root", "left"), "cc-next")
            grown = save(join_hot(labels, next_up, "root", "held", nodes).select("id", F.coalesce("up", "root").alias("root")), "cc-labels")
            drop_saved(next_up)
        drop_saved(rest, jump, labels)
        rest, labels = shorter, grown
        rounds += 1
    if labels is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("held"))
    out = save(join_hot(labels, least, "root", "held", nodes).select("id", "component"), "cc-components")
    drop_saved(rest, labels)
    out._quern_rounds = rounds
    return out
