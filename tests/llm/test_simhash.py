import random
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from salvora.llm import simhash
from salvora.llm.cells import links_in_cells
from salvora.operators.components import connected_components
from salvora.session import cut


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words, now = words + [now] * bool(now), ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "Two Words", "a b c", "a a a a a a", "Ünï CÖDE Text with   runs\x0bof space", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize(("limit", "radius"), [(64, 2), (2, 2), (64, 0), (3, 1), (3, 4)])
def test_links_match_brute_force(spark, limit, radius):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    for f in list(fps)[:25]:
        for _ in range(8):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), radius, cell_limit=limit)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = slow_components(fps, radius)
    classes = {}
    for s, w in zip(signed, want):
        classes.setdefault(w, set()).add(s)
    for members in classes.values():
        if len(members) == 1:
            assert not members & set(got)
        else:
            assert {got[m] for m in members} == {min(members)}


@pytest.mark.parametrize(("hubs", "crowd"), [(1, 64), (3, 1000)])
def test_cells_compare_what_hubs_do_not_connect(spark, hubs, crowd):
    """Numbers of one cell within 3 of each other: chains that no hub covers, in blocks of a few members."""
    rng = random.Random(2)
    values = sorted(rng.sample(range(1, 400), 130))
    rows = [(c, v, 2 * v) for c in ("x", "y") for v in values if c == "x" or v % 3]
    judge = lambda pairs: pairs.filter("abs(dst - src) <= 3")
    near = lambda a, b: F.abs(F.col(f"{a}w") - F.col(f"{b}w")) <= 8
    sift = lambda pairs: pairs.withColumn("far", F.abs(F.col("dst") - F.col("src"))).filter("far <= 5")
    edges = links_in_cells(spark.createDataFrame(rows, "cell string, key bigint, w int"), ["w"], near, sift, judge, hubs=hubs, block=7, crowd=crowd)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want, at = {}, None
    for a, b in zip([None, *values], values):
        at = at if a is not None and b - a <= 3 else b
        want[b] = at
    assert {v: got.get(v, v) for v in values} == want


def test_edge_rows(spark):
    rows = [(5, None), (9, ""), (5, None), (None, "lone words of one row here"), (3, "copy of a text that is here"), (2, "copy of a text that is here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).withColumn("fp", F.lit(1.5))
    got = sorted(map(tuple, simhash.op1_simhash(df).collect()), key=str)
    f = f"{slow_fingerprint(rows[4][1]):016x}"
    assert [r for r in got if r[0] in (5, 9)] == [(5, "0" * 16, 5), (5, "0" * 16, 5), (9, "0" * 16, 5)]
    assert [r for r in got if r[0] in (2, 3)] == [(2, f, 2), (3, f, 2)]
    assert [r[2] for r in got if r[0] is None] == [None]
    assert simhash.op1_simhash(df.limit(0)).count() == 0


def slow_sets(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


@pytest.mark.parametrize("crowd", [64, 2])
def test_near_copies_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "links_in_cells", lambda *a, **k: links_in_cells(*a, **k, crowd=crowd))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = ["", " ", "one two", "one two", "one two three", "a b c d e f g h i", "a b c d e f g h"]
    for length in (30, 60, 150, 300):
        for _ in range(4):
            base = [word() for _ in range(length)]
            texts.append(" ".join(base))
            for _ in range(10):
                copy = list(base)
                for _ in range(rng.randint(1, max(2, length // 40))):
                    copy[rng.randrange(length)] = word()
                texts.append(" ".join(copy))
    ids = rng.sample(range(10_000), len(texts))
    sets = [slow_sets(t) for t in texts]
    root = list(range(len(texts)))
    far = 0
    for x in range(len(texts)):
        for y in range(x):
            if sets[x] == sets[y] or len(sets[x] & sets[y]) * 5 >= len(sets[x] | sets[y]) * 4:
                far += bin(slow_fingerprint(texts[x]) ^ slow_fingerprint(texts[y])).count("1") > 2
                root = [root[y] if r == root[x] else r for r in root]
    assert far > 50
    least = {}
    for r, i in zip(root, ids):
        least[r] = min(i, least.get(r, i))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert got == {i: least[r] for r, i in zip(root, ids)}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(least.values())


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Without any cell of a shingle, the grid join of fingerprints still links what is within two bits and 0.8 alike, and nothing else."""
    shared = simhash._shared
    monkeypatch.setattr(simhash, "_shared", lambda marks: shared(marks).limit(0))
    rng = random.Random(3)
    words = [[f"w{rng.randrange(900)}" for _ in range(400)] for _ in range(12)]
    texts = [" ".join(w[:k] + ["other"] * (k > 0) + w[k:]) for w in words for k in (0, 1, 90, 250, 399)] + ["", "one", "two"]
    prints, sets = [simhash.fingerprint_of(np.unique(simhash.shingle_hashes(t, 5))) for t in texts], [slow_sets(t) for t in texts]
    root = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if bin(prints[x] ^ prints[y]).count("1") <= 2 and len(sets[x] & sets[y]) * 5 >= len(sets[x] | sets[y]) * 4:
                root = [root[y] if r == root[x] else r for r in root]
    assert len(set(root)) <= len(texts) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert got == {i: root.index(r) for i, r in enumerate(root)}


def test_known_links_are_not_judged_again(spark):
    seen = []

    def judge(pairs):
        seen.extend(tuple(sorted((r.src, r.dst))) for r in pairs.collect())
        return pairs.filter("abs(dst - src) <= 3")

    rows = [("x", v) for v in (1, 2, 3, 10, 12, 30)] + [("y", v) for v in (1, 2, 3)]
    known = spark.createDataFrame([(1, 2), (3, 2)], "src bigint, dst bigint")
    near = lambda a, b: F.lit(True)
    edges = links_in_cells(spark.createDataFrame(rows, "cell string, key bigint").withColumn("w", F.lit(0)), ["w"], near, lambda pairs: pairs.withColumn("far", F.abs(F.col("dst") - F.col("src"))), judge, known=known)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 12: 10}
    assert not {(1, 2), (1, 3), (2, 3)} & set(seen)


def test_cut_leaves_no_shuffle_files(spark):
    files = lambda: {p.name for p in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*")}
    before = files()
    some = cut(spark.range(5000).select((F.col("id") % 700).alias("k")).groupBy("k").count().repartition(3, "count"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and some.count() == 700


def test_keep_one_goes_by_rows(spark):
    """Rows that share a doc_id are judged by their own texts; a row that recurs stays once; columns of any name stay."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, b, 4), (7, c, 5), (7, c, 5), (None, a, 6), (None, a, 7), (11, None, 8), (12, "", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int").withColumn("__keep", F.lit("x")).withColumn("keep_id", F.lit("y")).withColumn("t", F.lit("z"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.n) for r in kept.collect()) == sorted([(3, a, 1), (5, b, 3), (7, c, 5), (0, a, 6), (0, a, 7), (11, None, 8)])
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i * i % 7919}" for i in range(150_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x " * 100_000), (4, "short one")], "doc_id bigint, text string")
    assert {r.doc_id: r.fingerprint for r in simhash.op1_simhash(df).collect()}[3] == f"{slow_fingerprint('x x x x x'):016x}"
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3, 4]
