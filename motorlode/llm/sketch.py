"""Bottom-k sketches of shingle hashes: mergeable fingerprints of documents."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.llm.common import whole_texts

#: Hashes that a sketch keeps; a likeness has a standard error of at most 1 / (2 sqrt(K)) = 0.044.
K = 128
WORDS = 5
#: Bits of a hash; 48 make 8 characters of base64, and collide once in 2^24 sets of 2^12 shingles.
HASH_BITS = 48
#: Bytes of documents as stored for a range of keys, and ranges at most (their bounds are planned on the driver).
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000


def shingle_hashes(text: str, words: int = WORDS):
    """Sorted distinct hashes of the word shingles of a text (fewer words: one of all of them)."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    parts = text.lower().encode().split()
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(digest, parts), np.uint64, len(parts))
    n = max(1, len(w) - words + 1)
    h = w[:n].copy()
    for k in range(1, min(words, len(w))):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[k : k + n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique(h >> np.uint64(64 - HASH_BITS))


def bottom(hashes, k: int = K):
    """The k smallest of sorted distinct hashes: the sketch of the set."""
    return hashes[:k]


def merge(a, b, k: int = K):
    """The sketch of the union of two sets, from their sketches."""
    import numpy as np

    return np.union1d(a, b)[:k]


def resemblance(a, b, k: int = K) -> float:
    """Estimated Jaccard index, exact for sets of at most k hashes together. Two empty sets: 1."""
    import numpy as np

    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    if len(a) == k or len(b) == k:  # beyond the largest hash of a full sketch nothing is known
        union = union[union <= min(x[-1] for x in (a, b) if len(x) == k)]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def distinct_shingles(a, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << HASH_BITS) / (float(a[-1]) + 1)


def containment(a, b, k: int = K) -> float:
    """Estimated share of the first set that the second holds. An empty first set: 1."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def to_text(sketch) -> str:
    """A sketch as base64 of big-endian 48-bit hashes in ascending order."""
    import numpy as np

    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str):
    import numpy as np

    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprint(text: str):
    return bottom(shingle_hashes(text))


def _dealt(docs: DataFrame, key: str) -> DataFrame:
    """(row, marker, key, text): ranges of ascending keys, each closed by a marker row: its successor.

    Bounds are actual keys near the quantiles, as many as shuffle partitions or, of larger tables,
    one for RANGE_BYTES by Spark's estimate of the size; the row at a bound also goes to the range
    before it, and the very first to the last range. A range is streamed, so its size bounds a task's
    time and not its memory.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size > 1 << 60 else size  # not known
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES))
    row = docs.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)] or [0.5], max(10_000, 20 * parts)).alias("q"), F.min(key).alias("least"), F.sum(F.col(key).isNull().cast("int")).alias("nulls")).first()
    least = None if row["nulls"] else row["least"]
    bounds = sorted({b for b in row["q"] or [] if least is None or b > least})

    def deal(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        edges = np.array(bounds, np.int64)
        for b in batches:
            ids = b.column(0)
            known = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            bucket = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(edges, known, side="right"), 0)
            first = known == (np.iinfo(np.int64).min if least is None else least)
            if least is None:
                first &= ids.is_null().to_numpy(zero_copy_only=False)
            again = np.flatnonzero(np.isin(known, edges) & (bucket > 0) | first)
            rows = np.concatenate([np.arange(b.num_rows), again])
            where = np.concatenate([bucket, np.where(first[again], len(edges), bucket[again] - 1)])
            marker = np.repeat([0, 1], [b.num_rows, len(again)])
            out = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(marker, pa.int32()), out.column(0), pc.cast(out.column(1), pa.string())], names=["bucket", "marker", key, "text"])

    rows = docs.mapInArrow(deal, f"bucket long, marker int, {key} long, text string")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "marker", F.col(key).asc_nulls_first(), "text")


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles, in_edited) of every whole text, its edited text and its successor by key.

    The edited text has its last quarter replaced by the beginning of the next document's, after
    the last document the first's. Null texts count as empty; null keys come first; rows of equal
    keys follow by text. A document alone is its own successor.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "in_edited"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        held = None
        closed = True  # a range after its marker: further markers are rows of the same key
        for batch in batches:
            out = []
            for bucket, marker, i, t in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if marker and closed:
                    continue
                mine = fingerprint(t)
                if held is not None:
                    was, s, sketch = held
                    cut = len(s) // 4
                    edited = s[: len(s) - cut] + t[:cut]
                    new = fingerprint(edited)
                    out.append((was, len(s), hashlib.sha256(edited.encode()).hexdigest(), to_text(sketch), to_text(new), resemblance(sketch, new), resemblance(sketch, mine), distinct_shingles(sketch), containment(sketch, new)))
                held = None if marker else (i, t, mine)
                closed = bool(marker)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return _dealt(whole_texts(docs, text, key), key).mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, in_edited double")
