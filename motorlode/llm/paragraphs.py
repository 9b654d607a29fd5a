"""Paragraph dedup: MinHash banding, exact Jaccard, and components of near-equal paragraphs.

Paragraphs are lines, short lines joined, and pieces: runs of PIECE words at places that the words
themselves choose, wherever lines begin and end. Two texts that have SHARED words in a row in common
choose a place in them alike, so a passage within longer or otherwise broken lines is found too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.llm.common import in_arrow, stored, whole_texts
from motorlode.llm.components import connected_components

WORDS = 5
SIMILARITY = 0.8
#: Lines of fewer words are also joined with such lines next to them, to paragraphs of as many words or more.
LONG_WORDS = 20
#: Words of a piece, and of the shortest run that any two texts with it choose a piece in alike.
PIECE, SHARED = 16, 50
#: Bands and rows of the signature: a pair at the similarity meets with probability 0.9992.
BANDS, ROWS = 10, 3
#: Paragraphs of one bucket that are compared in one task; a larger bucket is split.
BLOCK = 1024
#: Bytes of the places of paragraphs to compare up to which these are broadcast; beyond, documents are shuffled.
WANTED_BYTES = 16 << 20
#: Bits of the map that tells which documents have paragraphs to compare: for each such document, and at most (32 MB).
MAP_BITS, MOST_BITS = 8, 1 << 28
#: Copies of a paragraph from which on its rows aren't shuffled by it, and such paragraphs up to which they are broadcast.
HOT, HOT_KEYS = 5_000, 200_000
#: Bytes of text whose words are held at once; a longer text is taken alone.
SLICE_BYTES = 1_000_000
#: Bits that number the words of a slice.
PLACE_BITS = 27

_MIX, _BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that a pair of this similarity meets in no band."""
    return (1 - similarity**rows) ** bands


#: What a paragraph is: a line of LONG_WORDS or more, a shorter line, lines joined, or a piece.
LONG, SHORT, JOINED, PIECES = 0, 1, 2, 3


def _mixed(h):
    import numpy as np

    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(30)


class Words:
    """The words of some texts: hashes, and where they begin and end; lower case, by ASCII white space."""

    def __init__(self, texts: list[str]) -> None:
        import numpy as np
        import xxhash

        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(texts)) + 2
        b = np.frombuffer(b"\n\n".join([*raw, b""]), np.uint8)
        space = (b == 32) | (b >= 9) & (b <= 13)
        edge = np.diff(np.concatenate(([1], space.astype(np.int8), [1])))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.begins = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(self.begins, self.start, side="right") - 1
        newline = b == 10
        newline[:-1] |= (b[:-1] == 13) & (b[1:] != 10)
        self.line = np.cumsum(newline, dtype=np.int32)[self.start]
        self.points = np.concatenate(([0], np.cumsum(b & 0xC0 != 0x80, dtype=np.int32)))
        words = b"\n\n".join(t.lower().encode() for t in texts).split()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            power, self.back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)))

    def point(self, at, text):
        """Places in their texts, as code points, of places among all bytes."""
        return self.points[at] - self.points[self.begins[text]]

    def hashes(self, at, n):
        """A hash of the n words from each of some places on; it depends on these words alone."""
        import numpy as np

        with np.errstate(over="ignore"):
            return _mixed((self.sums[at + n] - self.sums[at]) * self.back[at] + np.asarray(n).astype(np.uint64) * np.uint64(_MIX))

    def lines(self):
        """(first word, words, kind) of all lines, short lines joined, and pieces.

        Joined are two or more lines in a row of fewer than LONG_WORDS words, without an empty line
        between them, of as many words or more together.
        """
        import numpy as np

        m = len(self.start)
        if not m:
            return (np.zeros(0, np.int64),) * 3
        at = np.flatnonzero(np.concatenate(([True], self.line[1:] != self.line[:-1])))
        n = np.diff(np.append(at, m))
        short = n < LONG_WORDS
        follows = np.zeros(len(at), bool)
        follows[1:] = short[1:] & short[:-1] & (np.diff(self.line[at]) == 1)
        run = np.cumsum(~follows) - 1
        first = np.flatnonzero(~follows)
        total = np.bincount(run, n).astype(np.int64)
        some = (np.bincount(run) > 1) & (total >= LONG_WORDS)
        pieces = self.pieces()
        kinds = np.where(short, SHORT, LONG), np.full(some.sum(), JOINED), np.full(len(pieces), PIECES)
        return np.concatenate((at, at[first[some]], pieces)), np.concatenate((n, total[some], np.full(len(pieces), PIECE))), np.concatenate(kinds)

    def pieces(self):
        """First words of the pieces: of each SHARED words in a row, the PIECE words of the smallest hash."""
        import numpy as np

        m, window = len(self.start), SHARED - PIECE + 1
        if m < SHARED:
            return np.zeros(0, np.int64)
        low = np.uint64((1 << PLACE_BITS) - 1)
        h = self.hashes(np.arange(m - PIECE + 1), PIECE) & ~low | np.arange(m - PIECE + 1, dtype=np.uint64)
        least, p = h, 1
        while 2 * p <= window:
            least = np.minimum(least[:-p], least[p:])
            p *= 2
        count = len(h) - window + 1
        least = np.minimum(least[:count], least[window - p : window - p + count])
        inside = self.text[:count] == self.text[SHARED - 1 : SHARED - 1 + count]  # all of its words are of one text
        return np.unique((least[inside] & low).astype(np.int64))


def sliced(texts):
    """Lists of places of `texts` of SLICE_BYTES code points together."""
    held, size = [], 0
    for k, t in enumerate(texts):
        if held and size + len(t) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(t)
    if held:
        yield held


def ragged(starts, sizes):
    """Places of runs one after another, given where each of them starts and its size."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def band_keys(hashes, cuts):
    """A row of BANDS keys for each run of hashes that begins at a cut."""
    import numpy as np

    keys = np.empty((len(cuts), BANDS), np.uint64)
    seed = np.uint64(_MIX)
    for b in range(BANDS):
        key = np.full(len(cuts), b + 1, np.uint64)
        for r in range(ROWS):
            seed = seed * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
            low = np.minimum.reduceat((hashes ^ seed) * (seed | np.uint64(1)), cuts)
            key = (key ^ low) * np.uint64(_MIX)
            key ^= key >> np.uint64(29)
        keys[:, b] = key
    return keys.view(np.int64)


def _rows(similarity: float):
    # Different sets of fewer shingles are less similar; such lines and pieces meet where they are equal.
    few = similarity / (1 - similarity) - 1e-9 if similarity < 1 else float("inf")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for some in sliced(texts):
                w = Words([texts[k] for k in some])
                at, n, kind = w.lines()
                if not len(at):
                    continue
                text = w.text[at]
                own = pa.array(np.array(some)[text])
                signed = np.flatnonzero((kind != PIECES) & (n - WORDS + 1 >= few))
                sizes = n[signed] - WORDS + 1
                bands = np.zeros((0, BANDS), np.int64)
                if len(signed):
                    with np.errstate(over="ignore"):
                        bands = band_keys(w.hashes(ragged(at[signed], sizes), WORDS), np.cumsum(sizes) - sizes)
                counts = np.zeros(len(at), np.int64)
                counts[signed] = BANDS
                columns = {
                    "h": pa.array(w.hashes(at, n).view(np.int64)), "doc": batch.column(0).take(own), "print": batch.column(1).take(own), "at": pa.array((at - np.searchsorted(w.text, text)).astype(np.int32)), "n": pa.array(n.astype(np.int32)),
                    "start": pa.array(w.point(w.start[at], text).astype(np.int32)), "end": pa.array(w.point(w.end[at + n - 1], text).astype(np.int32)), "kind": pa.array(kind.astype(np.int32)),
                    "bands": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(bands.reshape(-1))),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _fetch(batches):
    """Sorted distinct shingle hashes of the paragraphs wanted of each document."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts, wanted = (batch.column(c).to_pylist() for c in range(2))
        for some in sliced(texts):
            w, out = Words([texts[k] for k in some]), []
            firsts = np.searchsorted(w.text, np.arange(len(some))).tolist()
            for k, first in zip(some, firsts):
                out += [(x["h"], np.unique(w.hashes(np.arange(first + x["at"], first + x["at"] + x["n"] - WORDS + 1), WORDS)).tobytes()) for x in wanted[k]]
            h, sets = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(sets, pa.binary())], names=["h", "shingles"])


def _verify(similarity: float):
    """Streams buckets; links that connect all their paragraphs of at least the exact similarity."""

    def links(bucket):
        import numpy as np

        bucket = list({h: (s, k) for h, s, k in bucket}.items())
        ids = [h for h, _ in bucket]
        sets = [np.frombuffer(s, np.uint64) for _, (s, _) in bucket]
        kinds = np.array([k for _, (_, k) in bucket])
        sizes = np.array([len(s) for s in sets])
        group = np.arange(len(ids))
        for i in range(len(ids)):
            far = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
            far = far[(np.minimum(sizes[far], sizes[i]) >= similarity * np.maximum(sizes[far], sizes[i]))]
            far = far[kinds[far] + kinds[i] != SHORT + JOINED]  # a line isn't a copy of what it was joined to
            for j in far.tolist():
                if group[j] == group[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[j] - both):
                    yield ids[i], ids[j]
                    group[group == group[j]] = group[i]

    def run(batches):
        import pyarrow as pa

        def out(rows):
            u, v = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held, was = [], None
        for batch in batches:
            found = []
            for *key, h, s, kind in zip(*(batch.column(c).to_pylist() for c in ("bucket", "x", "y", "h", "shingles", "kind"))):
                if key != was:
                    found += links(held)
                    held, was = [], key
                held.append((h, s, kind))
            if found:
                yield out(found)
        if found := list(links(held)):
            yield out(found)

    return run


def _asked(docs: DataFrame, one: DataFrame) -> DataFrame:
    """All rows of `docs` whose doc and print `one` has, and about an eighth of the others.

    A broadcast bitmap of their hashes tells, so that few texts are shuffled to a join in vain.
    """
    bits = min(max(MAP_BITS * one.count(), 1 << 15), MOST_BITS)
    place = F.pmod(F.xxhash64("doc", "print"), F.lit(bits))
    placed = lambda df: df.withColumns({"part_": F.bitmap_bucket_number(place), "bit_": F.bitmap_bit_position(place)})
    maps = placed(one.select("doc", "print")).repartition("part_").groupBy("part_").agg(F.bitmap_construct_agg("bit_").alias("map_"))
    byte = F.conv(F.hex(F.substring("map_", (F.col("bit_") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit_") % 8).cast("int")) > 0
    return placed(docs).join(F.broadcast(maps), "part_").where(is_set).select(*docs.columns)


def _near(docs: DataFrame, kinds: DataFrame, similarity: float, block: int) -> DataFrame:
    """(node, component_id) of different paragraphs that are near others; `kinds` has one row for each."""
    met = kinds.select("h", "kind", F.explode("bands").alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = met.hint("merge").join(sizes, "bucket").withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = stored(met.select("h", "kind", "bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")))
    one = kinds.join(met.select("h").distinct(), "h").select("one.doc", "one.print", F.struct("h", "one.at", "one.n").alias("w"))
    one = stored(one.groupBy("doc", "print").agg(F.collect_list("w").alias("wanted")))  # a document's own lines
    held = one.agg(F.sum(F.size("wanted") * 48 + 96)).first()[0] or 0
    few = held <= WANTED_BYTES
    docs = docs if few else _asked(docs, one)
    texts = docs.join(F.broadcast(one) if few else one, docs["doc"].eqNullSafe(one["doc"]) & (docs["print"] == one["print"]))
    sets = in_arrow(texts.select("text", "wanted"), _fetch, "h long, shingles binary")
    keys = ["bucket", "x", "y"]
    near = in_arrow(met.join(sets, "h").repartition(*keys).sortWithinPartitions(*keys), _verify(similarity), "u long, v long")
    return connected_components(near, "u", "v")


def _joined(rows: DataFrame, by: DataFrame) -> DataFrame:
    """`rows` with the columns of `by` (h, copies, ..), where they have the h. A paragraph that many rows
    have meets them by broadcast, so that no task gets them all; there are few such paragraphs."""
    hot = stored(by.where(F.col("copies") >= HOT))
    n = hot.count()
    if not 0 < n <= HOT_KEYS:
        return rows.join(by, "h")
    cold = rows.join(F.broadcast(hot.select("h")), "h", "left_anti").join(by.where(F.col("copies") < HOT), "h")
    return cold.unionByName(rows.join(F.broadcast(hot), "h"))


def repeated_paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(key, print, kind, first, words, start, end, component_id, copies, kept): paragraphs that occur again.

    A paragraph is a line with words, several short lines in a row joined, or a piece (see Words).
    Lines are near if the Jaccard index of their sets of lower-case five-word shingles is
    `similarity` or more, those of fewer than five words if they are equal. Joined lines meet joined
    lines and lines of LONG_WORDS or more. Pieces meet where they are equal: so few shingles hold no
    edit at this similarity. A row for each paragraph whose component has several: a hash of its
    text, its kind, first word and words, its place in the text (code points), the smallest key that
    holds one of them, their number, and whether it is the first by key, text and place, which
    stays. Null texts count as empty; null keys come first and a component_id can be null; repeated
    rows repeat their paragraphs. Equal paragraphs are one node, whatever their number.
    """
    docs = whole_texts(docs, text, key).select(F.col(key).alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    rows = stored(in_arrow(docs, _rows(similarity), "h long, doc long, print long, at int, n int, start int, end int, kind int, bands array<long>"))
    place = F.struct("doc", "print", "at", "n")
    lines = rows.where(F.col("kind") < PIECES)
    kinds = stored(lines.groupBy("h").agg(F.count("*").alias("times"), F.min(place).alias("one"), F.min("kind").alias("kind"), F.first("bands").alias("bands")).where((F.size("bands") > 0) | (F.col("times") > 1)))
    groups = _near(docs, kinds.where(F.size("bands") > 0), similarity, block)
    rooted = kinds.join(groups, kinds["h"] == groups["node"], "left").where("times > 1 or component_id is not null").select("h", "times", "one", F.coalesce("component_id", "h").alias("root"))
    several = rooted.groupBy("root").agg(F.sum("times").alias("copies"), F.min("one").alias("one"))
    named = rooted.select("h", "root").join(several, "root").select("h", "copies", "one")
    found = _joined(lines.drop("bands"), named)
    pieces = rows.where(F.col("kind") == PIECES).drop("bands")
    again = pieces.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1")
    pieces = stored(_joined(pieces, again))
    found = found.unionByName(_joined(pieces.drop("copies"), pieces.groupBy("h").agg(F.first("copies").alias("copies"), F.min(place).alias("one"))))
    return found.select(F.col("doc").alias(key), "print", "kind", F.col("at").alias("first"), F.col("n").alias("words"), "start", "end", F.col("one.doc").alias("component_id"), "copies", place.eqNullSafe(F.col("one")).alias("kept"))


def document_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, passages, longest, repeated_words, n_repeated, n_dropped, first_seen) of every document.

    Of its repeated paragraphs, where they overlap or touch taken together: how many have LONG_WORDS
    words or more, the words of the longest and of all; their number, how many aren't the first of their kind, and the keys that have the
    first of these, ascending and without nulls. Documents without any have zeros and no keys;
    repeated rows stay.
    """
    found = repeated_paragraphs(docs, text, key)
    zero = F.lit(0)
    spans = F.array_sort(F.collect_list(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("words")).alias("b"))))
    by = found.groupBy(F.col(key).alias("doc"), "print").agg(spans.alias("spans"), F.count("*").alias("n_repeated"), F.sum((~F.col("kept")).cast("long")).alias("n_dropped"), F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("component_id")))).alias("first_seen"))
    # an open span, the longest so far and the words of the closed ones
    start = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("longest"), zero.alias("total"), zero.alias("passages"))

    def step(s, x):
        joins = x["a"] <= s["b"]
        a, b = F.when(joins, s["a"]).otherwise(x["a"]), F.when(joins, F.greatest(s["b"], x["b"])).otherwise(x["b"])
        was = F.when(joins & (s["b"] - s["a"] >= LONG_WORDS), 1).otherwise(0)  # counted already
        now = F.when(b - a >= LONG_WORDS, 1).otherwise(0)
        return F.struct(a.alias("a"), b.alias("b"), F.greatest(s["longest"], b - a).alias("longest"), (s["total"] + F.when(joins, zero).otherwise(s["b"] - s["a"])).alias("total"), (s["passages"] + now - was).alias("passages"))

    by = by.withColumn("m", F.aggregate("spans", start, step))
    own = docs.select(F.col(key).alias("doc_"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print_"))
    out = own.join(by, own["doc_"].eqNullSafe(by["doc"]) & (own["print_"] == by["print"]), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(F.col("doc_").alias(key), count(F.col("m.passages")).alias("passages"), count(F.col("m.longest")).alias("longest"), count(F.col("m.total") + F.col("m.b") - F.col("m.a")).alias("repeated_words"), count(F.col("n_repeated")).alias("n_repeated"), count(F.col("n_dropped")).alias("n_dropped"), F.coalesce("first_seen", F.array().cast("array<long>")).alias("first_seen"))
