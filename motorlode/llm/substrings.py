"""Exact substring dedup: removes every byte of a long string that also starts elsewhere.

Windows of `length` bytes are grouped by their smallest k-gram hash, so that equal windows meet
whatever their documents; runs of windows with one such hash form a segment. Equal segments are
counted natively. Where different segments share a hash, those that also share the bytes of the
wider half around the k-gram are fetched; their texts go through a Burrows-Wheeler transform, and
breadth-first backward extension finds the positions whose common prefix with another reaches
`length`.

Strings of some words in a row, which can be shorter, are found in the same passes, over arrays with
a hash for each word; what differs there is counted by the hash of each window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.llm.common import stored, whole_texts

LENGTH = 400
#: Words in a row that make a passage. Passages are reported; bytes go by LENGTH alone.
WORDS = 50
#: Different segments of one hash that are transformed together; more are split by longer content.
GROUP = 1500
#: Bytes of segments that one transform takes (a group is never cut).
BLOCK_BYTES = 600_000
#: Bytes of text that are hashed at once; a longer text is cut into pieces that overlap by a window.
SLICE_BYTES = 1_000_000
#: Bytes of a word's hash.
HASH = 8
#: Bits that number the places of a slice.
PLACE_BITS = 21


def _gram(length: int) -> int:
    """Bytes of a k-gram: a power of two."""
    k = 1
    while 2 * k <= length // 8:
        k *= 2
    return k


def _grams(b, k: int):
    """Mixed 64-bit hashes of all k-grams of a byte array."""
    import numpy as np

    h, span = b.astype(np.uint64) + np.uint64(1), 1
    while span < k:
        h = h[:-span] * np.uint64((0x9E3779B97F4A7C15 + 2 * span * 0x632BE59BD9B4E019) % (1 << 64) | 1) + h[span:]
        span *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(h, w: int):
    """Minimum of each w consecutive values."""
    import numpy as np

    p, m = 1, h
    while 2 * p <= w:
        m = np.minimum(m[:-p], m[p:])
        p *= 2
    n = len(h) - w + 1
    return np.minimum(m[:n], m[w - p : w - p + n])


def _places(h, w: int):
    """Of each window of w hashes, the place of its smallest one, the leftmost on ties."""
    import numpy as np

    low = np.uint64((1 << PLACE_BITS) - 1)
    return (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), w) & low).view(np.int64)


def segments(buffer, ends, length: int):
    """(key, start, windows, k-gram's place) arrays: runs of windows with one smallest k-gram, cut at texts' ends.

    `buffer` holds texts one after another, `ends` where each of them ends. The key is the hash of
    that k-gram; it lies equally far in equal windows, so no window repeats within a segment.
    """
    import numpy as np

    k = _gram(length)
    if len(buffer) < length:
        return (np.zeros(0, np.int64),) * 4
    h = _grams(buffer, k)
    place = _places(h, length - k + 1)
    n = len(place)
    inside = np.zeros(n + 1, np.int32)  # windows that lie in one text
    starts = np.concatenate(([0], ends[:-1]))
    some = ends - starts >= length
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - length + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = place[1:] != place[:-1]
    new[starts[some]] = True
    new &= inside
    first = np.flatnonzero(new)
    last_of = ends[np.searchsorted(ends, first, side="right")] - length + 1
    stop = np.minimum(np.append(first[1:], n), last_of)
    return h[place[first]].view(np.int64), first, stop - first, place[first]


def _half(length: int) -> int:
    """Bytes before the k-gram from which on the left is a window's wider half."""
    return (length - _gram(length)) // 2


def _hashed(text: str) -> bytes:
    """Hashes, of HASH bytes each, of the words between ASCII white space."""
    import numpy as np
    import xxhash

    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).tobytes()


def _slices(texts, length: int, width: int):
    """Lists of (number of the text, place, piece) of about SLICE_BYTES, in units of `width` bytes; pieces
    of a longer text overlap by a window."""
    held, total, most = [], 0, SLICE_BYTES // width
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) // width - length + 1), most):
            piece = t[o * width : (o + most + length - 1) * width]
            if held and total + len(piece) > SLICE_BYTES:
                yield held
                held, total = [], 0
            held.append((i, o, piece))
            total += len(piece)
    if held:
        yield held


def _segment_rows(length: int, words: int):
    """A row for each segment of bytes and, where `words` is set, of words; `gram` is how far in its
    k-gram lies. `left` is a hash of what all its windows share that have _half(length) bytes (or
    words) or more before the k-gram, `right` of the others; null if it has no such windows. Half a hash
    will do, since what shares it is compared."""

    def of(batch, texts, length, width):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest, k, half = xxhash.xxh3_64_intdigest, _gram(length), _half(length)
        for pieces in _slices(texts, length, width):
            text_of, offset, some = zip(*pieces)
            ends = np.cumsum([len(t) // width for t in some])
            joined = b"".join(some)
            key, at, n, gram = segments(np.frombuffer(joined, np.uint8 if width == 1 else np.uint64), ends, length)
            if not len(key):
                continue
            digests = lambda a, b: np.fromiter([digest(joined[s:e]) for s, e in zip((a * width).tolist(), (b * width).tolist())], np.uint64, len(a))  # noqa: B023, E731
            of = np.searchsorted(ends, at, side="right")
            seg = digests(at, at + n + length - 1).view(np.int64)
            rows = pa.array(np.array(text_of)[of])
            place = at - np.concatenate(([0], ends[:-1]))[of] + np.array(offset)[of]
            sides = []
            for which, from_, to in ((at <= gram - half, gram - half, gram + k), (at + n - 1 > gram - half, gram, gram - half + 1 + length)):
                side = np.zeros(len(at), np.uint64)
                side[which] = digests(from_[which], to[which])
                sides.append(pa.array((side >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), width == HASH)), pa.array(key), pa.array(seg), *sides, batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((gram - at).astype(np.int32))],
                names=["words", "key", "seg", "left", "right", "doc", "print", "at", "n", "gram"],
            )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield from of(batch, batch.column(2).cast(pa.binary()).to_pylist(), length, 1)
            yield from of(batch, map(_hashed, batch.column(2).to_pylist()), words, HASH)

    return run


def suffix_order(codes):
    """Suffix array and its inverse of texts in codes 1 to 256, each ended by a 0 that counts as smaller
    than all codes and as different from any other 0, the earlier the smaller.

    Prefix doubling from seven codes at once; only suffixes that aren't told apart are sorted again.
    """
    import numpy as np

    n, span = len(codes), 7
    key = np.zeros(n, np.int64)
    live = np.ones(n, bool)  # no end so far
    for k in range(span):
        code = np.zeros(n, np.int64)
        code[: max(0, n - k)] = codes[k:]
        live &= code > 0
        key = key << 9 | np.where(live, code, 0)
    order = np.argsort(key, kind="stable")  # ended ones: the earlier first
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (ordered[1:] & 511 == 0)
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        rank[order[place]] = np.repeat(place[first], size)
        place = place[np.repeat(size > 1, size)]
        if not len(place):
            return order, rank
        some = order[place]
        key = rank[some] * n + rank[some + span]
        by = np.argsort(key)
        order[place] = some[by]
        key = key[by]
        new = np.ones(len(place), bool)
        new[1:] = key[1:] != key[:-1]
        span *= 2


def repeated_starts(texts: list[bytes], length: int):
    """For each text, a boolean array: does the string of `length` bytes here also start elsewhere?

    Backward extension after Beller, Gog, Ohlebusch and Schnattinger: boundary q of the suffix
    order lies between the suffixes c X and c Y; its common prefix is one longer than the least of
    the boundaries between X and Y, the previous and the next place of c in the transform. So
    boundaries get their values in increasing order, breadth first, and the search stops at
    `length`: boundaries without a value by then have at least that.
    """
    import numpy as np

    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    total = int(starts[-1])
    codes = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
    codes[starts[1:] - 1] = 0
    order, rank = suffix_order(codes)
    first = codes[order]
    known = np.zeros(total + 1, bool)  # boundary q: between ranks q - 1 and q
    known[0] = known[total] = True
    known[1:total] = (first[1:] != first[:-1]) | (first[1:] == 0)  # common prefix 0
    # For a boundary q within one first code: ranks of the suffixes that follow that code.
    q = np.flatnonzero(~known[:total])
    low, high = rank[order[q - 1] + 1], rank[order[q] + 1]
    value = 0
    while value + 1 < length and len(q):
        value += 1
        sums = np.cumsum(known)
        now = sums[high] > sums[low]
        if not now.any():
            break
        known[q[now]] = True
        q, low, high = q[~now], low[~now], high[~now]
        if value >= 12 and (high - low).sum() <= 4 * total:
            break
    if value + 1 < length and len(q):  # few long ranges left: follow what depends on each boundary
        width = high - low
        of = np.repeat(np.arange(len(q)), width)
        on = np.repeat(low + 1, width) + np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
        by = np.argsort(on, kind="stable")
        on, of = on[by], of[by]
        front = np.flatnonzero(known)
        begin, last = np.searchsorted(on, front), np.searchsorted(on, front, side="right")
        while value + 1 < length and len(front):
            value += 1
            n = last - begin
            reach = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            front = np.unique(q[of[reach]])
            front = front[~known[front]]
            known[front] = True
            begin, last = np.searchsorted(on, front), np.searchsorted(on, front, side="right")
    shared = np.zeros(total, bool)  # by rank
    shared |= ~known[:total]
    shared |= ~known[1:]
    flags = shared[rank]
    return [flags[s : s + len(t)] for s, t in zip(starts.tolist(), texts)]


def _runs(flags):
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2] - edges[::2]


def _transform(length: int):
    """Streams segments sorted by key; (doc, print, at, n) runs of repeated windows."""

    def solve(rows):
        doc, print_, at, texts = zip(*rows)
        for d, p, a, flags in zip(doc, print_, at, repeated_starts(list(texts), length)):
            for s, n in zip(*(x.tolist() for x in _runs(flags))):
                yield d, p, a + s, n

    def batch_of(rows):
        import pyarrow as pa

        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "print", "at", "n"])

    def run(batches):
        held, size, was = [], 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if size > BLOCK_BYTES and key != was:
                    if out := list(solve(held)):
                        yield batch_of(out)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                was = key
        if held and (out := list(solve(held))):
            yield batch_of(out)

    return run


def _fetch(length: int, words: int):
    """Of the windows wanted of each document, the texts, or a row with the hash of each window of words."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for doc, print_, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4))):
                raw, hashed = text.encode(), _hashed(text) if any(w["words"] for w in wanted) else b""
                for w in wanted:
                    at = w["at"]
                    if w["words"]:
                        out += [(True, digest(hashed[a * HASH : (a + words) * HASH]) - (1 << 63), 0, doc, print_, a, None) for a in range(at, at + w["n"])]
                    else:
                        t = raw[at : at + w["n"] + length - 1]
                        out.append((False, w["key"], digest(t) - (1 << 63), doc, print_, at, t))
            if out:
                types = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["words", "key", "seg", "doc", "print", "at", "text"])

    return run


def _split(length: int, step: int):
    """Cuts the segments of a hot key: windows whose smallest k-gram lies as far in, within `step`.

    Equal windows have it at the same place, and get the same new key: a hash of the bytes that all
    windows of the piece share. With a step of 1 that is the window itself.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        k = _gram(length)
        for batch in batches:
            out = []
            for key, doc, print_, at, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "print", "at", "text"))):
                n = len(text) - length + 1
                p = int(_places(_grams(np.frombuffer(text, np.uint8), k), length - k + 1)[0])  # of all its windows
                far = (p - np.arange(n)) // step
                cuts = np.flatnonzero(far[1:] != far[:-1]) + 1
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
                    lo = int(far[s]) * step
                    core = text[p - lo : p - (lo + step - 1) + length]
                    piece = text[s : e - 1 + length]
                    out.append((xxhash.xxh3_64_intdigest(core, far[s].item() + 1), xxhash.xxh3_64_intdigest(piece), doc, print_, at + s, piece))
            if out:
                key, seg, doc, print_, at, piece = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(np.array(seg, np.uint64).view(np.int64)), pa.array(doc, pa.int64()), pa.array(print_, pa.int64()), pa.array(at, pa.int32()), pa.array(piece, pa.binary())], names=["key", "seg", "doc", "print", "at", "text"])

    return run


PIECE = "key long, seg long, doc long, print long, at int, text binary"
RUN = "doc long, print long, at int, n int"


def repeated_windows(docs: DataFrame, length: int = LENGTH, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """(words, doc, print, at, n): windows at .. at + n - 1 of the text also start elsewhere.

    Windows are `length` bytes or, where the first column is set, `words` words, and at counts these.
    `docs` has doc, print and text. Runs can be listed more than once.
    """
    rows = stored(docs.mapInArrow(_segment_rows(length, words), "words boolean, key long, seg long, left int, right int, doc long, print long, at int, n int, gram int"))
    busy = rows.groupBy("key").agg(F.count("*").alias("times"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("times > 1")
    rows = stored(rows.join(busy.select("key", (F.col("a") != F.col("b")).alias("contested")), "key"))
    kinds = rows.groupBy("key", "seg").agg(F.count("*").alias("times"), F.min(F.struct("doc", "print", "at")).alias("one"), *(F.first(c).alias(c) for c in ("words", "n", "gram", "left", "right", "contested")))
    kinds = stored(kinds)
    run = ("words", "doc", "print", "at", "n")
    found = [rows.join(kinds.where("times > 1").select("key", "seg"), ["key", "seg"]).select(*run)]
    # of different segments of a key, the windows of each side that others share; most share neither
    border = F.col("gram") - F.when(F.col("words"), _half(words)).otherwise(_half(length))  # last window of the left side
    sides = F.array(
        F.when(F.col("left").isNotNull(), F.struct(F.xxhash64("key", "left", F.lit(0)).alias("key"), F.lit(0).alias("from"), F.least(F.col("n"), border + 1).alias("n"))),
        F.when(F.col("right").isNotNull(), F.struct(F.xxhash64("key", "right", F.lit(1)).alias("key"), F.greatest(F.lit(0), border + 1).alias("from"), (F.col("n") - F.greatest(F.lit(0), border + 1)).alias("n"))),
    )
    pieces = kinds.where("contested").select("one", "words", F.explode(F.array_compact(sides)).alias("side")).select("words", "side.key", "one.doc", "one.print", (F.col("one.at") + F.col("side.from")).alias("at"), "side.n")
    shared = pieces.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    wanted = pieces.join(shared, "key").groupBy("doc", "print").agg(F.collect_list(F.struct("words", "key", "at", "n")).alias("wanted"))
    pieces = stored(docs.join(wanted, ["doc", "print"]).select("doc", "print", "text", "wanted").mapInArrow(_fetch(length, words), f"words boolean, {PIECE}"))
    windows = pieces.where("words")
    again = windows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    found.append(windows.withColumn("n", F.lit(1)).join(again, "key").select(*run))
    pieces = pieces.where("not words").drop("words")
    of_bytes = F.lit(False).alias("words")
    steps = sorted({max(1, length // 8), max(1, length // 64), 1}, reverse=True)
    for step in (*steps, None):
        # equal pieces are all repeats; one of them stands for all from here on
        times = pieces.groupBy("key", "seg").agg(F.count("*").alias("times"), F.min(F.struct("doc", "print", "at")).alias("one"), F.first("text").alias("text"))
        times = stored(times)
        equal = times.where("times > 1").select("key", "seg")
        found.append(pieces.join(equal, ["key", "seg"]).select(of_bytes, "doc", "print", "at", (F.octet_length("text") - (length - 1)).alias("n")))
        if step is None:  # pieces are single windows by now
            break
        sizes = times.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
        pieces = times.join(sizes, "key").select("key", "one.doc", "one.print", "one.at", "text", "kinds")
        cold = pieces.where(F.col("kinds") <= group)
        found.append(cold.repartition("key").sortWithinPartitions("key").select("key", "doc", "print", "at", "text").mapInArrow(_transform(length), RUN).select(of_bytes, "*"))
        pieces = pieces.where(F.col("kinds") > group)
        if sizes.where(F.col("kinds") > group).isEmpty():
            break
        pieces = stored(pieces.mapInArrow(_split(length, step), PIECE))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans, n_passages, passage_words, passages) of
    every whole text as UTF-8 bytes.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
    document too, overlapping itself or not; all strings are judged on the input. `spans` lists the
    removed runs as start:end. `passages` are the runs of words covered by a string of `words` words
    that also starts elsewhere, likewise in bytes, whatever white space is between the words; they
    are reported, and stay unless their bytes go. Null texts count as empty, texts below `length`
    bytes are kept; rows with a null or repeated key are told apart by their text, and equal rows
    are copies of one another. Other columns are ignored.
    """
    docs = whole_texts(docs, text, key).select(F.col(key).alias("id"), F.coalesce(F.col(key), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    runs = repeated_windows(docs.select("doc", "print", "text"), length, group, words)
    runs = runs.groupBy("doc", "print").agg(*(F.collect_list(F.when(F.col("words") == of_words, F.struct("at", "n"))).alias(c) for c, of_words in (("runs", False), ("again", True))))

    def covered(runs, total, window):
        """Starts and sizes of what the windows of some runs cover, and whether each place is covered."""
        import numpy as np

        gone = np.zeros(total + 1, np.int32)
        at = np.array([r["at"] for r in runs])
        np.add.at(gone, at, 1)
        np.add.at(gone, at + np.array([r["n"] for r in runs]) + window - 1, -1)
        gone = np.cumsum(gone)[:-1] > 0
        return *_runs(gone), gone

    def listed(starts, ends):
        return ",".join(f"{a}:{b}" for a, b in zip(starts.tolist(), ends.tolist()))

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, t, runs, again in zip(*(batch.column(c).to_pylist() for c in range(4))):
                raw = t.encode()
                b = np.frombuffer(raw, np.uint8)
                removed, passages = (0, 0, hashlib.sha256(raw).hexdigest(), ""), (0, 0, "")
                if runs:
                    s, n, gone = covered(runs, len(raw), length)
                    removed = int(gone.sum()), len(s), hashlib.sha256(b[~gone].tobytes()).hexdigest(), listed(s, s + n)
                if again:
                    edge = np.diff(np.concatenate(([1], ((b == 32) | (b >= 9) & (b <= 13)).astype(np.int8), [1])))
                    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
                    s, n, _ = covered(again, len(first), words)
                    passages = len(s), int(n.sum()), listed(first[s], end[s + n - 1])
                out.append((i, len(raw), *removed, *passages))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passages", "passage_words", "passages"])

    out = f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, n_passages long, passage_words long, passages string"
    return docs.join(runs, ["doc", "print"], "left").select("id", "text", "runs", "again").mapInArrow(run, out)
