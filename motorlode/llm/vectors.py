"""Embedding near-dedup by collision-counting projections.

Unit vectors are dealt into cells of a few quantised random projections, several tables of them, so
that each task holds few vectors. Within a cell many one-dimensional projections are sorted; for
each vector a window centred on it collects those that collide with it, and pairs with enough
collisions are verified by their cosine in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorlode.llm.common import stored
from motorlode.llm.components import connected_components

THRESHOLD = 0.93
#: Tables, and projections that make a cell in each.
TABLES, CELL_PROJECTIONS = 16, 7
#: Width of a cell, in standard deviations of a projection's difference at the threshold.
CELL_WIDTH = 4.3
#: Projections counted, half-width of the window in the same unit, and the recall of the count.
COUNTED, HALF_WINDOW, COUNT_RECALL = 16, 1.5, 0.997
#: Vectors of one cell that are compared in one task; a larger cell is split.
BLOCK = 2048
SEED = 20_240_601


def spread(dimensions: int, threshold: float = THRESHOLD) -> float:
    """Standard deviation of the difference of a random projection for a pair at the threshold."""
    return math.sqrt(2 - 2 * threshold) / math.sqrt(dimensions)


def collisions_needed(counted: int = COUNTED, half_window: float = HALF_WINDOW, recall: float = COUNT_RECALL) -> int:
    """The largest count that a pair at the threshold reaches with at least this probability."""
    p = math.erf(half_window / math.sqrt(2))
    at_least = 0.0
    for k in range(counted, -1, -1):
        at_least += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        if at_least >= recall:
            return k
    return 0


def expected_recall(tables: int = TABLES, projections: int = CELL_PROJECTIONS, width: float = CELL_WIDTH) -> float:
    """Probability that a pair at the threshold shares a cell of some table."""
    same = math.erf(width / math.sqrt(2)) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-(width**2) / 2))
    return 1 - (1 - same**projections) ** tables


def projections(dimensions: int, n: int, part: int):
    import numpy as np

    return np.random.default_rng([SEED, part, dimensions]).standard_normal((dimensions, n)) / math.sqrt(dimensions)


def _dealt(threshold: float):
    """Distinct vectors to a row for each table: its cell, and the cells of all tables."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            node, label, times = (batch.column(c).to_pylist() for c in ("node", "label", "times"))
            vectors = [np.frombuffer(v, np.float64) for v in batch.column("vector").to_pylist()]
            out = []
            for n in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == n]
                x = np.stack([vectors[i] for i in rows])
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                width = CELL_WIDTH * spread(n, threshold)
                shift = np.random.default_rng([SEED, 2, n]).random(TABLES * CELL_PROJECTIONS)
                cell = np.floor(x @ projections(n, TABLES * CELL_PROJECTIONS, 0) / width + shift).astype(np.int32).reshape(len(rows), TABLES, -1)
                hashed = np.array([[xxhash.xxh3_64_intdigest(c.tobytes()) for c in row] for row in cell], np.uint64).view(np.int64)
                for i, h in zip(rows, hashed):
                    out += [(node[i], label[i], times[i], vectors[i].tobytes(), h.tobytes(), t, int(h[t])) for t in range(TABLES)]
            for k in range(0, len(out), 20_000):
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 20_000]), types)], names=["node", "label", "times", "vector", "cells", "at", "cell"])

    return run


def _compare(threshold: float):
    """Streams cells: (u, v, n): u is linked with n vectors more, or (n null) u and v are linked."""

    needed = collisions_needed()

    def solve(rows, out):
        import numpy as np

        if len(rows) < 2:
            return
        node = np.array([r[0] for r in rows])
        times = np.array([r[1] for r in rows])
        part = np.array([r[4] for r in rows])
        at, split = rows[0][5], rows[0][6] != rows[0][7]
        sizes = np.array([len(r[2]) for r in rows])
        for size in np.unique(sizes).tolist():  # vectors of other dimensions aren't comparable
            own = np.flatnonzero(sizes == size)
            if len(own) > 1:
                x = np.frombuffer(b"".join(rows[i][2] for i in own.tolist()), np.float64).reshape(len(own), -1)
                cells = np.frombuffer(b"".join(rows[i][3] for i in own.tolist()), np.int64).reshape(len(own), -1)
                pairs_of(x, cells, node[own], times[own], part[own], at, split, out)

    def pairs_of(x, cells, node, times, part, at, split, out):
        import numpy as np

        n, dims = x.shape
        norm = np.sqrt((x * x).sum(axis=1))
        line = (x / norm[:, None]) @ projections(dims, COUNTED, 1)
        half = HALF_WINDOW * spread(dims, threshold)
        order = np.argsort(line, axis=0, kind="stable")
        ordered = np.take_along_axis(line, order, axis=0)
        links = np.zeros(n, np.int64)
        group = np.arange(n)
        for k in range(0, n, 256):
            q = np.arange(k, min(k + 256, n))
            count = np.zeros((len(q), n), np.int8)
            for c in range(COUNTED):
                edge = np.zeros((len(q), n + 1), np.int8)  # +1 where a window begins, -1 behind it
                row = np.arange(len(q))
                np.add.at(edge, (row, np.searchsorted(ordered[:, c], line[q, c] - half)), 1)
                np.add.at(edge, (row, np.searchsorted(ordered[:, c], line[q, c] + half, side="right")), -1)
                count[:, order[:, c]] += np.cumsum(edge[:, :n], axis=1, dtype=np.int8)
            i, j = np.nonzero(count >= needed)
            i = i + k
            new = i < j
            if split:  # pairs within a part are compared where that part is alone
                new &= part[i] != part[j]
            i, j = i[new], j[new]
            for a in range(0, len(i), 200_000):
                b, c = i[a : a + 200_000], j[a : a + 200_000]
                near = np.einsum("ij,ij->i", x[b], x[c]) / (norm[b] * norm[c]) >= threshold
                b, c = b[near], c[near]
                first = ~(cells[b, :at] == cells[c, :at]).any(axis=1)  # a pair counts in its first table
                b, c = b[first], c[first]
                np.add.at(links, b, times[c])
                np.add.at(links, c, times[b])
                for s, t in zip(*np.unique(np.stack([group[b], group[c]]), axis=1).tolist()) if len(b) else ():
                    s, t = group[s], group[t]
                    if s != t:
                        out.append((int(node[s]), int(node[t]), None))
                        group[group == t] = s
        out += [(int(node[i]), None, int(links[i])) for i in np.flatnonzero(links).tolist()]

    def run(batches):
        import pyarrow as pa

        def packed(out):
            u, v, n = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

        held, was = [], None
        for batch in batches:
            out = []
            for label, cell, *row in zip(*(batch.column(c).to_pylist() for c in ("label", "cell", "node", "times", "vector", "cells", "part", "at", "x", "y"))):
                key = (label, cell, *row[5:8])
                if key != was:
                    solve(held, out)
                    held, was = [], key
                held.append(row)
            if out:
                yield packed(out)
        out = []
        solve(held, out)
        if out:
            yield packed(out)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors of one label link at a cosine of `threshold` or more. Those that are null, empty, zero
    or hold null or non-finite components, and those without a label, link with nothing; so do
    vectors of different lengths. Equal vectors are one node with a count. A null vec_id takes
    part; component_id is the smallest vec_id that isn't null, or null. Other columns are ignored.
    """
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), e.alias("e"))
    good = F.col("label").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("e", lambda c: c != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("good"), F.xxhash64("label", "e")))
    rows = stored(rows)
    nodes = rows.where("good").groupBy("node").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.count("*").alias("times"), F.min("vec_id").alias("least"))

    def to_binary(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([np.array(v, np.float64).tobytes() for v in b.column(3).to_pylist()], pa.binary())], names=["node", "label", "times", "vector"])

    dealt = nodes.select("node", "label", "times", "e").mapInArrow(to_binary, "node long, label long, times long, vector binary").mapInArrow(_dealt(threshold), "node long, label long, times long, vector binary, cells binary, at int, cell long")
    keys = ["label", "at", "cell"]
    dealt = dealt.withColumn("size", F.count("*").over(Window.partitionBy(*keys))).where("size > 1")
    dealt = dealt.withColumn("parts", F.ceil(F.col("size") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
    keys += ["x", "y"]
    found = stored(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "u long, v long, n long"))
    links = found.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("n is null"), "u", "v")
    named = nodes.select("node", "least", "times").join(links, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("component_id", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("smallest"))
    named = named.join(ids, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "smallest")
    out = rows.drop("e", "label").join(named, "node", "left")
    component = F.when(F.col("good"), F.col("smallest")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: The same rows by comparing all pairs of a label: for small tables.
ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id <= coalesce(c.b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""
