"""SimHash near-dedup by covering locality-sensitive hashing (Pagh 2016)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.llm.common import checkpointed, in_arrow, mapped, whole_texts
from motorlode.llm.components import connected_components

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
#: Distinct fingerprints of one bucket that are compared in one task; a larger bucket is split.
BLOCK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text as an unsigned 64-bit number; 0 if it has no words."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: A-Z alone, and white space is \x20 \x09-\x0D alone
    if not words:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    h = np.fromiter([digest(line[s:e], seed) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): a signed long with the bits of the fingerprint of each whole text."""

    def run(batch):
        import pyarrow as pa

        fps = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return {key: batch.column(0), "fp": [f - (1 << 64) if f >> 63 else f for f in fps]}

    return mapped(whole_texts(docs, text, key), run, f"{key} long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that for any `radius` bit positions one mask has none of them.

    Bit i gets a vector c(i) of radius + 1 bits; mask v has bit i if <c(i), v> = 1 mod 2. At most
    `radius` vectors span a proper subspace, so some v <> 0 is orthogonal to all of them. c runs
    through the non-zero vectors in turn, so that every mask has about half of the bits.
    """
    span = (1 << (radius + 1)) - 1
    c = [1 + i * 11 % span for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (c[i] & v).bit_count() & 1) for v in range(1, span + 1)]


def _links_of(radius: int):
    """Streams partitions sorted by bucket; spanning links of the fingerprints within the radius in each."""

    def links(fps, edges):
        import numpy as np

        u = fps.view(np.uint64)
        group = np.arange(len(u))  # of each row, the group it is in so far
        for k in range(0, len(u), 512):
            near = np.bitwise_count(u[k : k + 512, None] ^ u[None, k:]) <= radius
            for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
                other = group[k:][near[i]]
                if (other := np.unique(other[other != group[k + i]])).size:
                    group[np.isin(group, other)] = group[k + i]
        for g in np.unique(group).tolist():
            if len(same := np.unique(fps[group == g])) > 1:
                edges.extend((x, int(same[0])) for x in same[1:].tolist())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, held, held_key = ("table", "bucket", "x", "y"), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out: list = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
                key = tuple(keys[s].tolist())
                if held and key != held_key:
                    links(np.concatenate(held), out)
                    held = []
                held_key = key
                held.append(fps[s:e])
            if out:
                u, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if held:
            out = []
            links(np.concatenate(held), out)
            if out:
                u, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all distinct `fp` within `radius` bits of one another.

    Any two such fingerprints agree under a covering mask, so they meet in a bucket. A bucket of
    more than `block` of them is cut into parts, and each pair of parts is compared in a task of
    its own: no group grows beyond two parts and no pair is lost.
    """
    tables = F.array(*[F.struct(F.lit(k).cast("short").alias("table"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bucket")) for k, m in enumerate(covering_masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.table", "t.bucket")
    sizes = rows.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1")  # counted before they meet: no task holds a large bucket
    rows = rows.hint("merge").join(sizes, ["table", "bucket"])  # Spark takes them for as many as before explode, and would broadcast them
    parts = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("fp", "table", "bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    keys = ["table", "bucket", "x", "y"]
    return in_arrow(rows.repartition(*keys).sortWithinPartitions(*keys), _links_of(radius), "u long, v long")


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint hex, component_id): documents whose fingerprints chain within `radius` bits.

    Null texts count as empty; texts without words get fingerprint zero and link like any other.
    Rows with a null key keep their fingerprint and take the component of its group (null if no
    other row is in it). Exact copies share a fingerprint and are one node, whatever their number.
    Columns other than key and text are ignored.
    """
    fps = checkpointed(fingerprints(docs, text, key))
    nodes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    groups = connected_components(near_links(nodes.select("fp")), "u", "v")
    roots = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component_id", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
