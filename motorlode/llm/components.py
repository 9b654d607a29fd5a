"""Connected components of a link table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.llm.common import checkpointed, in_arrow

#: Links that one contraction task holds at most on average (two int64 columns: 16 MB).
LINKS_PER_TASK = 1_000_000


class Forest:
    """Union-find over int64 ids; a tree's root is its smallest id."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def edges(self):
        """(id, its root) of every id that isn't a root."""
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def _contract(batches):
    import pyarrow as pa

    forest = Forest()
    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            forest.join(u, v)
    if edges := forest.edges():
        u, v = zip(*edges)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _signature(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame, a: str, b: str, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, component_id) for every id with a link to another; component_id is the smallest id reachable.

    Each block of links is contracted to a spanning forest by union-find in its own task. Over one
    block that is the answer; over several, alternating large-star and small-star rounds join the
    forests, each round written to the checkpoint folder, until the link table stays as it is. Null
    ids and self links are ignored; repeated links are harmless; no links give no rows.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpointed(e)
    blocks = max(1, -(-e.count() // per_task))
    e = checkpointed(in_arrow(e.repartition(blocks), _contract, "u long, v long"))
    if blocks > 1:
        was = None
        while (now := _signature(e)) != was:
            was = now
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots.select("node", F.col("node").alias("component_id")))
