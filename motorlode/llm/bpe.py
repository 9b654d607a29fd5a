"""Byte-level BPE with a hierarchical-bitmap rank queue.

All distinct pre-tokens of a batch of texts lie in one linked list of parts, kept as arrays. A
bucket per merge rank holds list positions; two levels of bitmaps say which buckets have any, and
their first set bit is the next rank. Positions whose pair has changed since are stale and skipped.
A pre-token of megabytes is no trap: each merge costs O(log n).
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame

from motorlode.llm.common import mapped, whole_texts

#: The lower bitmap level has words of 2^WORD ranks; the upper level has a bit for each word.
WORD, LOW = 8, 255
#: Code points of text that are encoded at once; a longer text is encoded alone.
SLICE_BYTES = 4_000_000
# Fixed value: the pattern of which it is known that no match reaches over a single space between
# two other characters, and that a match takes that space before what follows it.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class RankQueue:
    """Buckets of positions by rank, and the ranks that have a bucket as two levels of bitmaps."""

    def __init__(self) -> None:
        self.buckets: dict[int, list] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def push(self, ranks, positions) -> None:
        """Adds positions, each to the bucket of its rank."""
        import numpy as np

        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b, r in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
            self.add(r, positions[a:b])

    def add(self, rank: int, positions) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        w = rank >> WORD
        self.words[w] = self.words.get(w, 0) | 1 << (rank & LOW)
        self.top |= 1 << w

    def pop(self):
        """(lowest rank, its positions), which leave the queue; None if it is empty."""
        import numpy as np

        if not self.top:
            return None
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        rank = w << WORD | (word & -word).bit_length() - 1
        self.words[w] = word = word & word - 1
        if not word:
            self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


def ragged(starts, sizes):
    """Indices of runs one after another, given where each of them starts and its size."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts as the rank file's library does, without special tokens, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import numpy as np
        import regex

        self.ranks, self.find, self.cuts = ranks, regex.compile(pattern).findall, pattern == SPACE_LED
        self.span = max(ranks.values(), default=0) + 2
        pairs = [(a * self.span + b + 1, r, max(a, b)) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        pairs.sort()
        keys, made, parts = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((),) * 3))
        self.keys, self.made = np.append(keys, np.iinfo(np.int64).max), np.append(made, -1).astype(np.int32)
        # Ranks of tokens that are part of no token of a lower rank: merging them makes no pair that comes earlier.
        self.later = np.ones(self.span, bool)
        early = parts > made
        for side in (keys[early] // self.span, keys[early] % self.span - 1):
            self.later[side[side > made[early]]] = False
        self.bytes = np.array([ranks.get(bytes([c]), -1) for c in range(256)], np.int32)
        self.pool = np.frombuffer(b"".join(ranks), np.uint8)
        self.size, self.start = np.zeros(self.span, np.int64), np.zeros(self.span, np.int64)
        ids, sizes = np.array(list(ranks.values()), np.int64), np.fromiter(map(len, ranks), np.int64, len(ranks))
        self.size[ids], self.start[ids] = sizes, np.cumsum(sizes) - sizes

    def _rank(self, a, b):
        """Rank of each two tokens put together; -1 where they make none. A token of -1 is none."""
        import numpy as np

        key = a.astype(np.int64) * self.span + b + 1
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (b >= 0), self.made[at], np.int32(-1))

    def _early(self, rank: int, at, token, after, before):
        """Which merges at these positions, made from left to right, make a pair of a lower rank."""
        import numpy as np

        gone = after[at]
        left = np.where(before[at] >= 0, token[before[at]], -1)
        left[1:][before[at[1:]] == gone[:-1]] = rank
        own = np.full(len(at), rank, np.int32)
        made = np.stack((self._rank(left, own), self._rank(own, token[after[gone]])))
        return ((made >= 0) & (made < rank)).any(axis=0)

    def merge_all(self, pieces: list[bytes]):
        """(ids of the pre-tokens one after another, number of ids of each); lowest rank first, leftmost on ties.

        The merges of a bucket are made at once, but after one that makes a pair of a lower rank the
        others of its pre-token wait for that pair; `later` has the ranks that never make one.
        """
        import numpy as np

        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        starts = np.cumsum(sizes) - sizes
        token = self.bytes[np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)]
        token[starts + sizes - 1] = -1  # an end that joins with nothing
        total = len(token)
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        alive = token >= 0
        now = np.full(total, -1, np.int32)
        now[:-1] = self._rank(token[:-1], token[1:])
        queue = RankQueue()
        some = np.flatnonzero(now >= 0).astype(np.int32)
        if len(some):
            queue.push(now[some], some)
        while (found := queue.pop()) is not None:
            rank, at = found
            at = at[now[at] == rank]  # not stale
            if len(at) > 1:
                every = at = np.unique(at)
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # every second one of overlapping pairs
                    place = np.arange(len(at))
                    first = np.concatenate(([True], ~chained))
                    at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
                if not self.later[rank] and (early := self._early(rank, at, token, after, before)).any():
                    piece = np.searchsorted(starts, at, side="right")
                    upto = np.cumsum(early) - early
                    at = at[upto == upto[np.searchsorted(piece, piece)]]  # to the first such merge of each pre-token
                    queue.add(rank, np.setdiff1d(every, at, assume_unique=True))
            elif not len(at):
                continue
            gone = after[at]
            end = after[gone]
            token[at] = rank
            alive[gone] = False
            now[gone] = -1
            after[at] = end
            before[end] = at
            left = before[at]
            left = left[left >= 0]
            at = np.concatenate((at, left))
            ranks = self._rank(token[at], token[after[at]])
            now[at] = ranks
            good = ranks >= 0
            if good.any():
                queue.push(ranks[good], at[good])
        return token[alive], np.add.reduceat(alive, starts, dtype=np.int64) if len(starts) else starts

    def _pieces(self, pieces: list[str]):
        """(ids of pre-tokens one after another, number of ids of each): each distinct one is encoded once."""
        import numpy as np
        import pyarrow as pa

        known = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct = [x.encode() for x in known.dictionary.to_pylist()]
        whole = np.fromiter((self.ranks.get(x, -1) for x in distinct), np.int64, len(distinct))
        rest = np.flatnonzero(whole < 0)
        ids, sizes = self.merge_all([distinct[k] for k in rest])
        pool = np.concatenate((ids.astype(np.int64), whole))
        start, size = len(ids) + np.arange(len(distinct)), np.ones(len(distinct), np.int64)
        start[rest], size[rest] = np.cumsum(sizes) - sizes, sizes
        code = known.indices.to_numpy(zero_copy_only=False)
        return pool[ragged(start[code], size[code])].astype("<u4"), size[code]

    def encode_all(self, texts: list[str]):
        """(ids of all texts one after another as 32-bit integers, where each text's ids end).

        With SPACE_LED, texts are cut at single spaces between two other characters, and each
        distinct chunk is split into pre-tokens once; texts with other runs of white space, and all
        texts under any other pattern, are split as a whole.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        known = pc.list_flatten(rows).dictionary_encode()
        words, code = known.dictionary.to_pylist(), known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        first = np.cumsum(counts) - counts
        safe = np.fromiter((bool(w) and not w[0].isspace() and not w[-1].isspace() for w in words), bool, len(words))
        cut = np.logical_and.reduceat(safe[code], first) if len(texts) else np.zeros(0, bool)
        if not self.cuts:
            cut[:] = False
        # units: the distinct words with their space, then texts' first words or whole texts
        used = np.zeros(len(words), bool)
        inner = np.repeat(cut, counts)
        inner[first] = False
        used[code[inner]] = True
        some = np.flatnonzero(used)
        pieces = self.find("".join([" " + words[k] for k in some]))
        begins = np.fromiter((p[0] == " " for p in pieces), bool, len(pieces))
        per_unit = np.diff(np.append(np.flatnonzero(begins), len(pieces)))
        number = np.zeros(len(words), np.int64)
        number[some] = np.arange(len(some))
        own = [self.find(words[k]) if c else self.find(t) for k, c, t in zip(code[first], cut, texts)]
        per_unit = np.concatenate((per_unit, np.fromiter(map(len, own), np.int64, len(own))))
        ids, sizes = self._pieces(pieces + [p for x in own for p in x])
        last = np.cumsum(per_unit)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        start, stop = ends[last - per_unit], ends[last]
        # a text is its first unit and the units of its other words
        keep = inner.copy()
        keep[first] = True
        unit = number[code]
        unit[first] = len(some) + np.arange(len(texts))
        unit = unit[keep]
        n = stop[unit] - start[unit]
        return ids[ragged(start[unit], n)], np.concatenate(([0], np.cumsum(n)))[np.cumsum(np.where(cut, counts, 1))]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        ids = np.frombuffer(ids, "<u4")
        return self.pool[ragged(self.start[ids], self.size[ids])].tobytes()


_encoders: dict[bytes, Encoder] = {}


def encoder(raw: bytes, pattern: str) -> Encoder:
    """This worker's encoder of a rank file, made once."""
    name = hashlib.sha256(raw).digest() + pattern.encode()
    if name not in _encoders:
        _encoders[name] = Encoder(load_ranks(raw), pattern)
    return _encoders[name]


def _sliced(e: Encoder, texts: list[str]):
    """Ids of each text; SLICE_BYTES code points are encoded together."""
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) <= SLICE_BYTES):
            size += len(texts[j])
            j += 1
        ids, ends = e.encode_all(texts[k:j])
        ends = [0, *ends.tolist()]
        yield from (ids[a:b] for a, b in zip(ends, ends[1:]))
        k = j


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded binary) of each whole text; null texts count as empty."""
    raw = docs.sparkSession.sparkContext.broadcast(open(rank_file, "rb").read())  # a public vocabulary: 50k lines

    def run(batch):
        e = encoder(raw.value, pattern)
        ids = [x.view("<i4") for x in _sliced(e, batch.column(1).to_pylist())]
        return {key: batch.column(0), "ids": ids, "decoded": [e.decode(x.tobytes()) for x in ids]}

    return mapped(whole_texts(docs, text, key), run, f"{key} long, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text.

    Encodes as encode_documents does and digests the ids and what they decode to in the same pass,
    so that neither leaves the worker. Null texts count as empty: no tokens, digests of nothing.
    """
    raw = docs.sparkSession.sparkContext.broadcast(open(rank_file, "rb").read())

    def run(batch):
        e = encoder(raw.value, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        n, ids, decoded = zip(*((len(x), sha(x), sha(e.decode(x.tobytes()))) for x in _sliced(e, batch.column(1).to_pylist())))
        return {key: batch.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return mapped(whole_texts(docs, text, key), run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
