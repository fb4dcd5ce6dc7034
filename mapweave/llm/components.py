"""Connected components of a graph given by edges, wholly distributed, in O(log n) rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.session import attached, gathered, written

#: Edges that one task holds at once.
CHUNK = 250_000


class Forest:
    """Sets of joined things, each known by its smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, a):
        up = self.up
        top = up.setdefault(a, a)
        while top != up[top]:
            up[top] = top = up[up[top]]
        up[a] = top
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> Iterator[tuple]:
        """(member, smallest member) of all that is not the smallest itself."""
        for a in list(self.up):
            if (top := self.root(a)) != a:
                yield a, top


def components(edges: DataFrame, chunk: int = CHUNK, thinned: bool = False) -> DataFrame:
    """Rows (node, root) for every node that an edge (u, v) joins to another; the root is the smallest node joined to it.

    A round first replaces every ``chunk`` edges by a forest with as many edges as it has nodes to join, each
    chunk in its own task; ``thinned`` says that ``forests`` has done so to the edges where they were found. Once all edges fit a chunk that forest is the answer. Otherwise every node goes
    along its edge of the least hash (Boruvka's choice, so that each tree has two nodes at least and the
    nodes fall by half or more), pointers are followed to the ends, and the edges move with their ends. What is
    joined in a round is kept as a table, and the tables are put together backwards: they shrink with the rounds,
    so no round reads the whole graph again. Loops, edges with a null end and repeated edges change nothing; no
    edges give no rows.
    """
    kind = edges.schema["u"].dataType.simpleString()
    left = edges.select("u", "v").where("u <> v")
    left = written(gathered(left if thinned else left.mapInArrow(forests(chunk), f"u {kind}, v {kind}")))
    joined: list[DataFrame] = []
    while n := left.count():
        stars = left.coalesce(-(-n // chunk)).mapInArrow(forests(chunk), f"u {kind}, v {kind}")
        if n <= chunk:
            joined.append(written(stars.select(F.col("u").alias("node"), F.col("v").alias("root"))))
            break
        step, left = _round(written(stars), len(joined))
        joined.append(step)
    if not joined:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    whole = joined.pop()
    rounds = len(joined)
    for step in reversed(joined):
        ends = whole.select(F.col("node").alias("root"), F.col("root").alias("end"))
        whole = written(attached(step, ends, ["root"], "node").select("node", F.coalesce("end", "root").alias("root")).union(whole))
    if not rounds:
        tops = whole
    else:  # of a forest in one chunk the roots are the smallest nodes already
        low = written(whole.groupBy("root").agg(F.min("node").alias("low")).select("root", F.least("low", "root").alias("low")))
        tops = attached(whole, low, ["root"], "node").select("node", F.col("low").alias("root")).union(low.select(F.col("root").alias("node"), F.col("low").alias("root")))
    tops = tops.where("node <> root")
    return written(tops.union(tops.select(F.col("root").alias("node"), "root").distinct()))


def forests(chunk: int = CHUNK) -> Callable:
    """Every ``chunk`` edges as those of a forest that joins the same nodes."""

    def run(batches):
        forest, seen, kind = Forest(), 0, None

        def stars():
            rows = list(forest.stars())
            forest.up.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                forest.join(a, b)
            seen += batch.num_rows
            if seen >= chunk:
                yield stars()
                seen = 0
        if seen:
            yield stars()

    return run


def _round(edges: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """What a round joins, as (node, root), and the edges that are left between roots."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low, high = F.least("u", "v"), F.greatest("u", "v")
    up = written(both.groupBy("u").agg(F.min_by("v", F.struct(F.xxhash64(low, high, F.lit(number)), low, high)).alias("up")))
    beyond = up.select(F.col("u").alias("up"), F.col("up").alias("beyond"))
    # Two nodes that chose the same edge point at each other; the smaller one becomes the root.
    to = written(attached(up, beyond, ["up"], "u").select("u", F.when((F.col("beyond") == F.col("u")) & (F.col("u") < F.col("up")), F.col("u")).otherwise(F.col("up")).alias("up")))
    while True:
        beyond = to.select(F.col("u").alias("up"), F.col("up").alias("beyond"))
        on = written(attached(to, beyond, ["up"], "u").select("u", F.col("beyond").alias("up"), (F.col("up") != F.col("beyond")).alias("moved")))
        to = on.select("u", "up")
        if not on.where("moved").limit(1).count():
            break
    tops = to.select("u", F.col("up").alias("top"))
    moved = attached(edges, tops, ["u"], "v").select(F.col("top").alias("x"), F.col("v").alias("u"))
    moved = attached(moved, tops, ["u"], "x").select(F.col("x").alias("u"), F.col("top").alias("v")).where("u <> v")
    return to.where("u <> up").select(F.col("u").alias("node"), F.col("up").alias("root")), written(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
