"""Toxicity by class-conditional Kneser-Ney bigram models with shared backoff counts.

Each class has a bigram model. Its first backoff is the class's continuation counts (after how many
words a word occurs); their backoff, shared, is the continuation count one level up, in how many of
the classes it occurs. So expressions rare in either class weigh little. (Distinct words before it in
either class as the shared counts caught 0.87 of the held-out toxic rows of sf0.1, these 0.95.)
Every pair of words is counted for itself, over all training rows. The pair table grows with the corpus and is
dealt to blocks by the pair's hash; texts ask the blocks for their pairs' weights. The words'
values, some tens of bytes for each distinct word of the training rows, are broadcast; among them
two sets of 64 bits, of the words after and before it, which rule out most pairs that the table
doesn't have, so that texts needn't ask for them.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.llm.common import in_arrow, small, stored, whole_texts

#: Words of texts that a task holds at once, and documents (numbered by two bytes).
BATCH_WORDS, BATCH_DOCS = 1_200_000, 60_000
#: Words by which the sums over words are dealt out.
RANGE_BITS = 18
#: Words over which a local mean is taken; a phrase in a long text stands out in it.
WINDOW = 8
#: Labelled rows at most on which the weights of the final score are fitted (counts use all).
FIT_ROWS = 20_000
#: Share of rows held out, and of the rest the fold that fits the weights instead of being counted.
FOLDS, HELD_OUT, FIT_FOLD = 5, 0, 4

_SPACES = bytes.maketrans(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 31)


def hashes(text: str):
    """A 64-bit hash of each word of a text."""
    import numpy as np
    import xxhash

    words = text.lower().encode().translate(_SPACES).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pairs_of(texts, vocabulary):
    """(previous word, word, text's number) of all words of some texts, given their hashes.

    A word is its place in the vocabulary, from 1 on; 0 is the start of a text, and unknown words
    are all the number after the last.
    """
    import numpy as np

    sizes = np.array([len(t) for t in texts])
    h = np.concatenate(texts)
    w = np.full(len(h), len(vocabulary) + 1, np.uint64)
    if len(vocabulary):
        at = np.searchsorted(vocabulary, h)
        known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h
        w[known] = at[known] + 1
    v = np.zeros_like(w)
    v[1:] = w[:-1]
    v[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return v, w, np.repeat(np.arange(len(texts)), sizes)


def blocks_of(keys, bits: int):
    import numpy as np

    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.uint16)


def compressed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def expanded(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def bit_of(words):
    """One of 64 bits for each word."""
    import numpy as np

    return np.uint64(1) << (words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))


def packed(*arrays):
    """Arrays as planes of bytes, compressed; the first is sorted and kept as differences."""
    import numpy as np

    first, *rest = arrays
    out = [np.diff(first, prepend=first.dtype.type(0)), *rest]
    return compressed(pickle.dumps([(x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) for x in out]))


def unpacked(data):
    import numpy as np

    out = []
    for kind, planes in pickle.loads(expanded(data)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1))
    return np.cumsum(out[0], dtype=out[0].dtype), *out[1:]


def summed(parts):
    """(keys, sums of each further column) of parts (keys, columns), sorted by distinct keys; columns of bits (uint64) are united."""
    import numpy as np

    keys, *columns = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[cuts], *((np.bitwise_or if c.dtype == np.uint64 else np.add).reduceat(c[order], cuts) if len(cuts) else c for c in columns)


def _rows(block, data):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(data, pa.binary())], names=["block", "packed"])


def _dealt(keys, columns, block):
    """A row for each block of sorted keys, whose blocks are given."""
    import numpy as np

    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1).astype(bool))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        at = order[a:b]
        yield int(block[at[0]]), packed(keys[at], *(c[at] for c in columns))


def _held(batches):
    """(hashes of texts, toxic or not) of a partition, for some BATCH_WORDS words at a time."""
    import numpy as np

    texts, toxic, size = [], [], 0
    for batch in batches:
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.append(hashes(t))
            toxic.append(y)
            size += len(texts[-1])
            if size > BATCH_WORDS or len(texts) >= BATCH_DOCS:
                yield texts, np.array(toxic, np.int64)
                texts, toxic, size = [], [], 0
    if size:
        yield texts, np.array(toxic, np.int64)


def _words(bits: int):
    def run(batches):
        import numpy as np

        for texts, _ in _held(batches):
            h = np.unique(np.concatenate(texts))
            yield _rows(*zip(*_dealt(h, (), (h >> np.uint64(64 - bits)).astype(np.int64))))

    return run


def _count(vocabulary, bits: int):
    """Counts the pairs of a partition by class."""

    def run(batches):
        import numpy as np

        (known,) = unpacked(vocabulary.value)
        for texts, toxic in _held(batches):
            v, w, doc = pairs_of(texts, known)
            y = toxic[doc]
            keys, n0, n1 = summed([(v * np.uint64(len(known) + 2) + w, 1 - y, y)])
            yield _rows(*zip(*_dealt(keys, (n0, n1), blocks_of(keys, bits).astype(np.int64))))

    return run


def _merge(batches):
    """Sums the rows of each block; a partition's rows are sorted by block."""
    held, was, size = [], None, 0
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist()):
            if block != was:
                if held:
                    yield _rows([was], [packed(*summed(held))])
                held, was, size = [], block, 0
            held.append(unpacked(data))
            size += len(held[-1][0])
            if size > 2 * BATCH_WORDS:
                held = [summed(held)]
                size = 0
    if held:
        yield _rows([was], [packed(*summed(held))])


def merged(parts: DataFrame, blocks: int) -> DataFrame:
    """One row for each block of `parts` (block, packed)."""
    return in_arrow(parts.repartition(blocks, "block").sortWithinPartitions("block"), _merge, "block int, packed binary")


def _word_sums(words: int):
    """Of each block of pairs, for each word: in each class its occurrences as the previous word and
    the distinct words after and before it, and the bits of the words after and before it; in block -1, how many pairs of each class occur once and twice."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for data in batch.column("packed").to_pylist():
                keys, *n = unpacked(data)
                v, w = np.divmod(keys, np.uint64(words))
                one = np.ones(len(keys), np.int64)
                zero = 0 * one
                seen = [(x > 0).astype(np.int64) for x in n]
                none = np.zeros(len(keys), np.uint64)
                ids, *sums = summed([(v, *n, *seen, zero, zero, bit_of(w), none), (w, zero, zero, zero, zero, *seen, none, bit_of(v))])
                yield _rows(*zip(*_dealt(ids, sums, (ids >> np.uint64(RANGE_BITS)).astype(np.int64))))
                times = [(x == k).sum() for x in n for k in (1, 2)]
                yield _rows([-1], [packed(none[:1] * 0, *(np.array([x], np.int64) for x in (*times, 0, 0)), none[:1], none[:1])])

    return run


def vocabulary_of(rows: DataFrame, bits: int):
    """Sorted hashes of all words of `rows` (text, toxic)."""
    import numpy as np

    parts = {r["block"]: unpacked(r["packed"])[0] for r in merged(in_arrow(rows, _words(bits), "block int, packed binary"), 1 << bits).toLocalIterator()}
    return np.concatenate([np.zeros(0, np.uint64), *(parts[b] for b in sorted(parts))])


def count_pairs(rows: DataFrame, vocabulary, bits: int) -> DataFrame:
    """(block, packed) of the counts (pair, ordinary, toxic) of all word pairs of `rows` (text, toxic)."""
    return merged(in_arrow(rows, _count(vocabulary, bits), "block int, packed binary"), 1 << bits)


def sum_words(pairs: DataFrame, words: int):
    """(for each word a column: previous in each class, distinct words after it and before it in
    each; the bits of those after and before it; numbers of pairs that occur
    once and twice in each class) of the table of pairs."""
    import numpy as np

    sums, bits, times = np.zeros((6, words)), np.zeros((2, words), np.uint64), np.zeros(4, np.int64)
    parts = merged(in_arrow(pairs, _word_sums(words), "block int, packed binary"), (words >> RANGE_BITS) + 2)
    for row in parts.toLocalIterator():
        ids, *found = unpacked(row["packed"])
        if row["block"] < 0:
            times += [int(x[0]) for x in found[:4]]
        else:
            sums[:, ids.astype(np.int64)], bits[:, ids.astype(np.int64)] = found[:6], found[6:]
    return sums, bits, times


def _discount(n1: int, n2: int) -> float:
    """Absolute discount n1 / (n1 + 2 n2), of how many counts are 1 and 2."""
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.75


class Model:
    """Log-likelihood ratios of words, toxic against ordinary, and the bits of the words after and before each."""

    def __init__(self, sums, bits, times) -> None:
        import numpy as np

        kept = sums[4:, 1:]  # contexts of a word; the start of a text is none
        shared = 0.5 + (kept > 0).sum(0)
        shared /= shared.sum()
        self.discount, self.context, self.back, self.word = [], [], [], []
        for c in (0, 1):
            k, context, follow = kept[c], sums[c], sums[2 + c]
            total = max(1.0, k.sum())
            d = _discount(int((k == 1).sum()), int((k == 2).sum()))
            word = (np.maximum(k - d, 0) + max(1.0, d * (k > 0).sum()) * shared) / (total + max(0.0, 1.0 - d * (k > 0).sum()))
            d = _discount(*map(int, times[2 * c : 2 * c + 2]))
            self.discount.append(d)
            self.context.append(np.maximum(context, 1).astype(np.float32))
            self.back.append(np.where(context > 0, d * follow / np.maximum(context, 1), 1.0).astype(np.float32))
            self.word.append(np.concatenate(([1.0], word)).astype(np.float32))
        self.follow, self.lead = bits
        self.usable = bool(sums[0].any() and sums[1].any())

    def __getstate__(self):  # as it is broadcast
        import numpy as np

        return self.discount, self.usable, packed(np.arange(len(self.follow)), *self.context, *self.back, *self.word, self.follow, self.lead)

    def __setstate__(self, state):
        self.discount, self.usable, (_, *columns) = *state[:2], unpacked(state[2])
        self.context, self.back, self.word, (self.follow, self.lead) = (columns[k : k + 2] for k in (0, 2, 4, 6))

    def backed_off(self):
        """What a word as the previous one and as the word itself adds where the pair is unknown."""
        import numpy as np

        return np.log(self.back[1]) - np.log(self.back[0]), np.log(self.word[1]) - np.log(self.word[0])

    def gains(self, keys, *n):
        """What known pairs (and their counts by class) add to the ratio of their words' backoff."""
        import numpy as np

        v, w = (x.astype(np.int64) for x in np.divmod(keys, np.uint64(len(self.word[0]))))
        low = [self.back[c][v].astype(float) * self.word[c][w] for c in (0, 1)]
        high = [np.maximum(n[c] - self.discount[c], 0) / self.context[c][v] + low[c] for c in (0, 1)]
        return np.log(high[1] / low[1]) - np.log(high[0] / low[0])


def _ask(vocabulary, model, bits: int):
    """Of each batch of texts, a row with what needs no pairs and one for each block whose pairs occur."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        (known,), follow, lead = unpacked(vocabulary.value), model.value.follow, model.value.lead
        before, strength = model.value.backed_off()
        first = TaskContext.get().partitionId() << 32

        def out(ids, texts, batch):
            v, w, doc = pairs_of(texts, known)
            word = strength[w.astype(np.int64)]
            total = np.bincount(doc, before[v.astype(np.int64)].astype(float) + word, len(texts))
            ends = np.cumsum([len(t) for t in texts])
            rows = np.array([_word_features(word[e - len(t) : e]) for t, e in zip(texts, ends)]).T
            null = np.array([x is None for x in ids])
            own = compressed(pickle.dumps((np.array([x or 0 for x in ids], np.int64), null, total, np.array([len(t) for t in texts]), rows)))
            some = np.flatnonzero((follow[v.astype(np.int64)] & bit_of(w) > 0) & (lead[w.astype(np.int64)] & bit_of(v) > 0))  # unknown words are in no pair
            keys = v[some] * np.uint64(len(known) + 2) + w[some]
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], doc[some][order].astype(np.uint16)
            block = blocks_of(keys, bits)
            order = np.argsort(block, kind="stable")
            keys, doc, block = keys[order], doc[order], block[order]
            cuts = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1))
            found = [(hash((first, batch)) % (1 << bits), 1, own)]
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                k, n = np.unique(keys[a:b], return_counts=True)
                found.append((int(block[a]), 2, packed(k, n.astype(np.uint32), doc[a:b])))
            b, k, p = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array([first + batch] * len(b), pa.int64()), pa.array(p, pa.binary())], names=["block", "kind", "batch", "packed"])

        ids, texts, size, batch = [], [], 0, 0
        for rows in batches:
            for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids.append(i)
                texts.append(hashes(t))
                size += len(texts[-1])
                if size > BATCH_WORDS or len(ids) >= BATCH_DOCS:
                    yield out(ids, texts, batch)
                    ids, texts, size, batch = [], [], 0, batch + 1
        if ids:
            yield out(ids, texts, batch)

    return run


def _answer(model):
    """Streams blocks: the pairs' counts, then rows that pass through, then the batches' questions."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        was, keys, gains = None, None, None
        for rows in batches:
            out = []
            for block, kind, batch, data in zip(*(rows.column(c).to_pylist() for c in ("block", "kind", "batch", "packed"))):
                if kind == 0:
                    keys, *n = unpacked(data)
                    was, gains = block, model.value.gains(keys, *n)
                elif kind == 1:
                    out.append((batch, -1, data))
                elif block == was:
                    asked, times, doc = unpacked(data)
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    gain = np.where(keys[at] == asked, gains[at], 0.0)
                    out.append((batch, block, compressed(np.bincount(doc, np.repeat(gain, times)).tobytes())))
            if out:
                b, p, d = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int32()), pa.array(d, pa.binary())], names=["batch", "part", "packed"])

    return run


def _finish(key: str):
    """Streams batches: what needed no pairs, then each block's sums."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(ids, null, total, n, rows):
            columns = [total / np.maximum(n, 1), *rows, np.log1p(n)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), *(pa.array(c, pa.float64()) for c in columns)], names=[key, *FEATURES])

        held = None
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
                if part < 0:
                    if held:
                        yield out(*held)
                    held = pickle.loads(expanded(data))
                else:
                    gain = np.frombuffer(expanded(data))
                    held[2][: len(gain)] += gain
        if held:
            yield out(*held)

    return run


def _word_features(word):
    """Means over the strongest 3 and 6 words and the largest over WINDOW words in a row, by class backoff alone."""
    import numpy as np

    n = len(word)
    if not n:
        return 0.0, 0.0, 0.0
    top = np.sort(np.partition(word, n - 6)[n - 6 :] if n > 6 else word)[::-1]
    sums = np.concatenate(([0.0], np.cumsum(word, dtype=float)))
    k = min(WINDOW, n)
    return float(top[:3].sum()) / 3, float(top.sum()) / 6, float((sums[k:] - sums[:-k]).max()) / WINDOW


def features(docs: DataFrame, train: DataFrame, key: str):
    """((key, FEATURES) of `docs` (key, text), whether `train` (text, toxic) has both classes).

    FEATURES are the mean ratio over all words, those of _word_features, and the log of 1 + words.
    """
    bits = min(16, max(4, (docs.rdd.getNumPartitions() - 1).bit_length()))
    spark = docs.sparkSession
    known = vocabulary_of(train, bits)
    vocabulary = spark.sparkContext.broadcast(packed(known))
    pairs = stored(count_pairs(train, vocabulary, bits))
    model = spark.sparkContext.broadcast(Model(*sum_words(pairs, len(known) + 2)))
    asked = in_arrow(docs, _ask(vocabulary, model, bits), "block int, kind int, batch long, packed binary")
    both = pairs.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("batch"), "packed").union(asked)
    sums = in_arrow(both.repartition(1 << bits, "block").sortWithinPartitions("block", "kind", "batch"), _answer(model), "batch long, part int, packed binary")
    rows = in_arrow(sums.repartition(1 << bits, "batch").sortWithinPartitions("batch", "part"), _finish(key), f"{key} long, " + ", ".join(f"{f} double" for f in FEATURES))
    return stored(rows), model.value.usable


def fold(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


FEATURES = ("mean", "top3", "top6", "local", "length")


def fit_weights(rows, steps: int = 60):
    """Logistic weights (bias, then FEATURES) by Newton steps with a small ridge; prior if one class."""
    import numpy as np

    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = min(0.999, max(0.001, y.mean())) if len(y) else 0.001
        return [float(np.log(p / (1 - p)))] + [0.0] * len(FEATURES)
    x = np.array([[1.0, *(r[f] for f in FEATURES)] for r in rows])
    b = np.zeros(1 + len(FEATURES))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (y - p) - 1e-3 * b
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every whole text.

    Pairs are counted over all labelled rows of three folds, the final weights fitted on a fourth,
    and the fifth is held out. Null texts count as empty and get the score of no evidence, as do
    texts without words. Labels that are null are ignored; of several for one document the largest
    counts. Without labels of both classes all scores are the share of toxic labels (0.001 at
    least). A null key is never labelled and counts as not held out.
    """
    docs = whole_texts(docs, text, key)
    labels = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold(key) != HELD_OUT)
    known = small(labels)
    train = docs.join(known.where(fold(key) != FIT_FOLD), key).select(text, "toxic")
    rows, usable = features(docs, train, key)
    fit = rows.join(labels.where(fold(key) == FIT_FOLD), key).orderBy(F.xxhash64(key), key).limit(FIT_ROWS).select(*FEATURES, "toxic").collect()
    bias, *weights = fit_weights(fit if usable else [])
    logit = F.lit(bias)
    for w, f in zip(weights, FEATURES):
        logit = logit + F.lit(w) * F.col(f)
    score = 1 / (1 + F.exp(-logit))
    return rows.select(key, F.coalesce(fold(key) == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
