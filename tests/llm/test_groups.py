"""Operators on pairs and groups: vectors, SimHash, paragraphs, substrings, components, the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from motorlode.llm import components, paragraphs, simhash, substrings, vectors


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("per_task", [10**6, 20])
def test_components(spark, per_task):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(500, 540)] + [(700, k) for k in range(701, 740)] + [(1, 1), (None, 2)]
    u = Union()
    for a, b in links:
        if a is not None and a != b:
            u.join(a, b)
    got = {x["node"]: x["component_id"] for x in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b", per_task).collect()}
    assert got == {x: u.root(x) for x in u.up}


def test_no_links_no_components(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- vectors
def test_vectors_equal_brute_force(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((300, 32))
    x[100:160] = x[0] + 0.15 * g.standard_normal((60, 32))
    x[160:170] = x[1]
    label = [int(i % 2 == 0 or i >= 100) for i in range(300)]
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, label))]
    bad = [(300, None, 1), (301, [0.0] * 32, 1), (302, [float("nan")] + [1.0] * 31, 1), (303, [None] + [1.0] * 31, 1), (304, x[1].tolist(), None), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] * 32, 1)]
    table = spark.createDataFrame([(*r, 1, 2) for r in [*rows, *bad]], "vec_id long, embedding array<double>, label int, node int, at int")
    cosine = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = (cosine >= vectors.THRESHOLD) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    u = Union()
    for i, j in np.argwhere(link).tolist():
        u.join(i, j)
    for block in (2048, 16):  # also with cells split over tasks
        got = {r["vec_id"]: r for r in vectors.near_vectors(table, block=block).collect()}
        assert len(got) == 309
        found = sum(got[i]["n_links"] for i in range(300))
        assert 0.95 * link.sum() <= found <= link.sum() and all(got[i]["n_links"] <= link[i].sum() for i in range(300))
        assert all(got[i]["component_id"] == u.root(i) and got[i]["kept"] == (u.root(i) == i) for i in range(300))
        assert all(got[b[0]]["n_links"] == 0 and got[b[0]]["kept"] for b in bad if b[0] not in (306, 307))
        assert got[307]["component_id"] == 306 and got[307]["n_links"] == 1
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_vector_calibration():
    assert vectors.expected_recall() > 0.98 and vectors.collisions_needed() == 10


# --- SimHash
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    r = random.Random(1)
    for _ in range(20000):
        d = sum(1 << i for i in r.sample(range(64), 4))
        assert any(m & d == 0 for m in masks)


def test_simhash_equals_brute_force(corpus, empty, texts_of):
    rows = texts_of(corpus)
    fps = [brute_fingerprint(t) for _, t in rows]
    u = Union()
    for i in range(len(rows)):
        for j in range(i + 1):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                u.join(i, j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[u.root(i)].append(rows[i][0])
    want = Counter((rows[i][0], f"{fps[i]:016x}", min((x for x in groups[u.root(i)] if x is not None), default=None)) for i in range(len(rows)))
    assert Counter(map(tuple, simhash.simhash_groups(corpus).collect())) == want
    assert simhash.simhash_groups(empty).count() == 0


def test_near_fingerprints_link_in_split_buckets(spark):
    r = random.Random(9)
    fps = [0]
    for _ in range(120):
        fps.append(random.Random(len(fps)).choice(fps) ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 4))))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps + [r.getrandbits(64) for _ in range(50)]})
    u = Union()
    for a in fps:
        for b in fps:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and a != b:
                u.join(a, b)
    for block in (4096, 7):
        v = Union()
        for row in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block).collect():
            assert ((row["u"] ^ row["v"]) & (1 << 64) - 1).bit_count() <= 64
            v.join(row["u"], row["v"])
        assert {x: u.root(x) for x in u.up} == {x: v.root(x) for x in v.up}


def test_rows_of_the_masks_are_not_broadcast(spark):
    """Spark takes exploded rows for as many as before, so its default threshold lets 31 times as many through."""
    links = simhash.near_links(spark.range(200, numPartitions=4).selectExpr("xxhash64(id) AS fp").distinct())
    assert links.count() == 0 and links.collect() == []
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan.partition("Initial Plan")[0]


def test_workers_give_back_what_they_have_freed(spark):
    """A worker lives on after its task, with what an allocator keeps below a block still in use."""

    def run(batch):
        import os
        import sys

        import numpy as np

        blocks = [np.ones(12_000) for _ in range(4_000)]  # 384 MB
        sys.kept_by_test = np.ones(12_000)
        del blocks
        return {"pid": [os.getpid()] * batch.num_rows}

    from motorlode.llm.common import mapped

    pid = mapped(spark.range(1).coalesce(1), run, "pid long").first()["pid"]
    held = int(next(x for x in open(f"/proc/{pid}/status") if x.startswith("VmRSS")).split()[1]) // 1024
    assert held < 300


def test_repeated_and_null_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, None, 1), (3, [1.0, 0.0], None), (4, [], 1), (5, [0.0, 1.0, 0.0], 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(7))).collect()
    assert Counter((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got) == Counter([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)])


# --- paragraphs
def brute_paragraphs(rows):
    """Rows of all lines, by comparing all pairs of those of five words or more; fewer words: equal ones."""
    found = [(i, m.start() + len(m[0]) - len(m[0].lstrip(" ")), m.start() + len(m[0].rstrip(" ")), tuple(m[0].lower().split())) for i, t in rows for m in re.finditer(r"[^\n\r]+", t) if m[0].split()]
    kinds = sorted({p[3] for p in found})
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in kinds]
    u = Union()
    for i in range(len(kinds)):
        u.root(i)
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                u.join(i, j)
    groups = defaultdict(list)
    for p in found:
        groups[u.root(kinds.index(p[3]))].append(p)
    return Counter((*p[:3], min(((x[0] is not None, x[0]) for x in g))[1], len(g)) for g in groups.values() if len(g) > 1 for p in g)


def line_rows(found):
    return Counter((x["doc_id"], x["start"], x["end"], x["component_id"], x["copies"]) for x in found if x["kind"] < paragraphs.JOINED)


def test_paragraphs_equal_brute_force(spark, monkeypatch, corpus, empty, texts_of, prose_of):
    r = random.Random(3)
    rows = [(i, t.replace("\t", " ")) for i, t in texts_of(corpus)]
    for i in range(100, 160):
        words = prose_of(i % 7, 60).split()
        for _ in range(r.randrange(3)):
            words[r.randrange(60)] = "edit"
        rows.append((i, f"own {i} line\n" + " ".join(words) + "\r\n" + prose_of(i + 1000, 40) + "\n\n" + prose_of(i % 9, 4 + i % 12)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_paragraphs(rows)
    for block in (1024, 5):
        got = paragraphs.repeated_paragraphs(docs, block=block).collect()
        assert line_rows(got) == want
    monkeypatch.setattr(paragraphs, "HOT", 3)  # most paragraphs by broadcast
    again = paragraphs.repeated_paragraphs(docs).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got)) and 0 < sum(x["kept"] for x in got) < len(got)
    assert paragraphs.repeated_paragraphs(empty).count() == 0 and paragraphs.document_repeats(empty).count() == 0 and paragraphs.miss_probability(0.8) < 1e-3


def test_short_and_wrapped_lines_are_paragraphs(spark, prose_of):
    notice, long = "all rights reserved by the owners", prose_of(1, 60).split()
    wrap = lambda n: "\n".join(" ".join(long[k : k + n]) for k in range(0, 60, n))
    rows = [(0, wrap(9)), (1, f"{notice}\n\n{wrap(13)}"), (2, f"{notice}\n" + " ".join(long)), (3, "Menu\n" + prose_of(2, 30)), (4, "menu\n\nown"), (5, prose_of(3, 16) + "\nand some more of it")]
    found = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(x["doc_id"], x["first"], x["words"]): (x["component_id"], x["copies"], x["kept"]) for x in found if x["kind"] != paragraphs.PIECES}
    assert got == {(0, 0, 60): (0, 3, True), (1, 6, 60): (0, 3, False), (2, 6, 60): (0, 3, False), (1, 0, 6): (1, 2, True), (2, 0, 6): (1, 2, False), (3, 0, 1): (3, 2, True), (4, 0, 1): (3, 2, False)}


def test_passages_within_longer_lines_are_found(spark, monkeypatch, prose_of):
    """Every 50 words in a row that two texts share hold a piece; pieces found are in two texts indeed."""
    monkeypatch.setattr(paragraphs, "SLICE_BYTES", 5000)
    r, passage = random.Random(5), prose_of(77, 50).split()
    rows = []
    for i in range(30):
        words = prose_of(i + 200, 300).split()
        at = r.randrange(300)
        words[at:at] = passage if i % 2 else []
        rows.append((i, "".join(w + r.choice([" "] * 9 + ["\n", "\u00e9 "]) if not at <= k < at + 49 or not i % 2 else w + " " for k, w in enumerate(words))))
    rows += [(40, prose_of(300, 19)), (41, "x\n" + prose_of(300, 19)), (42, None), (None, "alone"), (43, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [x for x in paragraphs.repeated_paragraphs(docs).collect() if x["kind"] == paragraphs.PIECES]
    texts = {i: t.lower().split() for i, t in rows if t}
    runs = Counter(tuple(t[k : k + paragraphs.PIECE]) for t in texts.values() for k in range(len(t) - paragraphs.PIECE + 1))
    assert all(runs[tuple(texts[x["doc_id"]][x["first"] : x["first"] + x["words"]])] > 1 for x in found)
    assert {x["doc_id"] for x in found} == set(range(1, 30, 2))
    for x in found:
        assert dict(rows)[x["doc_id"]][x["start"] : x["end"]].lower().split() == texts[x["doc_id"]][x["first"] : x["first"] + x["words"]]
    by = {x["doc_id"]: x for x in paragraphs.document_repeats(docs).collect()}
    assert len(by) == len(rows) and all((by[i]["longest"] >= paragraphs.PIECE) == bool(i % 2) for i in range(30))
    assert all((x["passages"] > 0) == (x["longest"] >= paragraphs.LONG_WORDS) for x in by.values())
    assert by[40]["longest"] == by[41]["repeated_words"] == 19 and by[41]["first_seen"] == [40] and by[40]["n_dropped"] == 0 and by[42]["longest"] == by[None]["longest"] == 0


def test_only_texts_with_paragraphs_to_compare_are_shuffled(spark, monkeypatch, corpus, prose_of):
    docs = spark.range(20_000, numPartitions=3).selectExpr("nullif(id, 0) AS doc", "xxhash64(id, 'x') AS print", "string(id) AS text")
    one = docs.where("doc is null or doc % 5 = 1").select("doc", "print")
    got = paragraphs._asked(docs, one)
    assert got.columns == docs.columns and one.join(got, one["doc"].eqNullSafe(got["doc"]) & (one["print"] == got["print"])).count() == 4001
    assert got.count() == got.distinct().count() < 4001 + 0.2 * 16_000
    asked, near = [], paragraphs._asked
    monkeypatch.setattr(paragraphs, "_asked", lambda *x: asked.append(near(*x)) or asked[-1])
    rows = corpus.select("doc_id", "text").unionByName(spark.createDataFrame([(i, prose_of(i % 40, 60) + f" {i}") for i in range(100, 180)] + [(i, prose_of(i, 60)) for i in range(200, 900)], "doc_id long, text string"))
    want = Counter(map(str, paragraphs.document_repeats(rows).collect()))
    assert not asked
    monkeypatch.setattr(paragraphs, "WANTED_BYTES", 0)  # documents are shuffled
    assert Counter(map(str, paragraphs.document_repeats(rows).collect())) == want
    assert 80 <= asked[0].count() < 350


# --- substrings
def brute_removed(rows, length):
    raw = [t.encode() for _, t in rows]
    count = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = Counter()
    for (i, _), t in zip(rows, raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out[i, len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_starts_equal_brute_force():
    r = random.Random(3)
    for _ in range(150):
        length = r.choice([8, 16, 40])
        base = [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 300))) for _ in range(3)]
        texts = []
        for _ in range(r.randint(1, 10)):
            t = b""
            for _ in range(r.randint(0, 4)):
                s = r.choice(base)
                a = r.randint(0, len(s))
                t += s[a : r.randint(a, len(s))] + bytes(r.choice(b"abcdefgh\0\xff") for _ in range(r.randint(0, 30)))
            texts.append(t + b"a" * r.choice([0, 0, 200]))
        count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        for t, flags in zip(texts, substrings.repeated_starts(texts, length)):
            assert flags.tolist() == [k + length <= len(t) and count[t[k : k + length]] > 1 for k in range(len(t))]


@pytest.mark.parametrize("length, group", [(400, 1500), (40, 1500), (40, 2)])
def test_substrings_equal_brute_force(spark, corpus, texts_of, prose_of, length, group):
    rows = [x for x in texts_of(corpus) if len(x[1]) < 9000]
    common = prose_of(77, 70)
    rows += [(i, prose_of(i, 20) + " " + common[: 200 + 3 * i] + prose_of(i + 50, 15)) for i in range(200, 230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(1))
    got = substrings.remove_repeats(docs, length=length, group=group).collect()
    assert Counter(tuple(x)[:5] for x in got) == brute_removed(rows, length)


def test_substrings_edges(empty, spark):
    assert substrings.remove_repeats(empty).count() == 0
    long = "ab" * 800_000  # longer than what is hashed at once
    row = substrings.remove_repeats(spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")).where("doc_id = 1").first()
    assert row["n_removed"] == len(long)


def brute_passages(rows, words):
    found = [list(re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())) for _, t in rows]
    split = [[x[0] for x in f] for f in found]
    count = Counter(tuple(w[k : k + words]) for w in split for k in range(len(w) - words + 1))
    out = Counter()
    for (i, _), f, w in zip(rows, found, split):
        on = np.zeros(len(w), bool)
        for k in range(len(w) - words + 1):
            if count[tuple(w[k : k + words])] > 1:
                on[k : k + words] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0])))).tolist()
        spans = ",".join(f"{f[a].start()}:{f[b - 1].end()}" for a, b in zip(edges[::2], edges[1::2]))
        out[i, len(edges) // 2, int(on.sum()), spans] += 1
    return out


@pytest.mark.parametrize("words", [50, 12, 3])
def test_passages_equal_brute_force(spark, corpus, texts_of, prose_of, words):
    rows = [x for x in texts_of(corpus) if len(x[1]) < 9000]
    common = prose_of(78, 90).split()
    rows += [(i, prose_of(i, 20) + (" ", "\n", "\t\x0b ")[i % 3].join([" ", *common[: 40 + i % 50], "é"]) + prose_of(i + 60, 15)) for i in range(300, 350)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
    assert Counter((x["doc_id"], x["n_passages"], x["passage_words"], x["passages"]) for x in got) == brute_passages(rows, words)


def test_passages_of_short_words(spark, prose_of):
    passage = " ".join(f"w{k}" for k in range(55))  # over 50 words in under 400 bytes: its bytes stay
    rows = [(1, f"{prose_of(1, 70)} {passage} {prose_of(2, 70)}"), (2, f"{prose_of(3, 70)} {passage}"), (3, prose_of(4, 200)), (4, f"{passage[: passage.index(' w49')]} x"), (5, "a b " * 100_000)]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["passage_words"] for i in range(1, 6)] == [55, 55, 0, 0, 200_000]  # the last: beyond what is hashed at once
    assert [got[i]["n_passages"] for i in range(1, 6)] == [1, 1, 0, 0, 1]
    assert [got[i]["n_removed"] for i in range(1, 5)] == [0] * 4
    for i, text in rows[:2]:
        a, b = map(int, got[i]["passages"].split(":"))
        assert text.encode()[a:b].decode() == passage


# --- pipeline
def test_pipeline_stages(spark, tmp_path, prose_of):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers as P
    import tiktoken

    from motorlode.llm import bpe, mixing

    r = random.Random(8)
    docs, labels = [], []
    toxic = [(i - (i % 10 == 1)) % 7 == 0 for i in range(500)]  # every tenth copies the one before
    for i in range(500):
        words = prose_of(i, 50).split()
        if toxic[i]:
            for _ in range(4):
                words[r.randrange(50)] = r.choice(["nasty", "vile"])
        text = " ".join(words) + (" token = abcdef0123456789abcdef" if i == 5 else "")
        docs.append((i, text if i % 10 != 1 else docs[-1][1], ["en", None][i % 2], f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic[i])))
    docs += [(500, None, None, None, None), (3, docs[3][1], "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, kept = str(tmp_path), {}
    rows = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows
        rows = stage(spark, rows, d)
        if k < 4:
            rows.write.parquet(f"{d}/{k}")
            rows = spark.read.parquet(f"{d}/{k}")
            assert rows.columns == before.columns
        kept[name] = {x["doc_id"]: x for x in rows.collect()}
    assert sum(toxic[i] for i in kept["toxicity"] if i < 500) < 8 and sum(not toxic[i] for i in kept["toxicity"] if i < 500) >= toxic.count(False) - 3
    texts = [x["text"] for x in kept["simhash"].values()]
    assert len(texts) == len(set(texts)) and 500 in kept["simhash"]
    assert len(kept["secrets"]) == len(kept["simhash"]) and "abcdef0123456789" not in kept["secrets"][5]["text"] and kept["secrets"][5]["n_chars"] == len(kept["secrets"][5]["text"])
    assert set(kept["mixing"]) < set(kept["secrets"]) and len(kept["mixing"]) > 100
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    assert {i: x["n_tokens"] for i, x in kept["bpe"].items()} == {i: len(t.encode_ordinary(x["text"] or "")) for i, x in kept["mixing"].items()}
    assert mixing.BUDGET == 0.6


def test_pipeline_of_no_documents(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_broadcast_no_rows_of_the_masks(spark, monkeypatch, prose_of):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    seen, components_of = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda links, *x: seen.append(links) or components_of(links, *x))
    docs = spark.createDataFrame([(i, prose_of(1, 400) + f" {i}", "en", "a", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() < 40
    assert seen[0].collect()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_copies_of_one_doc_id(spark, prose_of):
    """Of equal rows and of equal texts under one doc_id one stays, of different texts all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, prose_of(1, 60), "en", "b", 1), (1, prose_of(1, 60), "en", "a", 1), (1, prose_of(2, 60), None, None, 1), (2, prose_of(3, 60), "en", "a", 1), (2, prose_of(3, 60), "en", "a", 1), (3, prose_of(3, 60), "en", "a", 1), (None, "x", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert Counter(map(tuple, got)) == Counter([rows[1], rows[2], rows[3], rows[6]])
