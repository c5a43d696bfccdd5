import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from peakpool.llm import simhash as S
from peakpool.llm.components import components


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in ([w] if len(w) < k else [w[i : i + k] for i in range(len(w) - k + 1)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = ["", " \t", "One", "one TWO", "a b c", "É é\xa0x y", *(" ".join(rng.choice(["a", "Bc", "dé", "\x0b"]) for _ in range(rng.randint(0, 300))) for _ in range(50))]
    assert [S.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    h = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert S.fingerprint(b"A  b\nC") == h % (1 << 64)


def clustered(rng, n):
    out = []
    for _ in range(n):
        x = rng.getrandbits(64) if not out or rng.random() < 0.4 else rng.choice(out)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_tree_finds_all_links(monkeypatch):
    rng = random.Random(2)
    fp = np.array(clustered(rng, 1500), np.uint64)
    want = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3])
    forest = S.Forest(len(fp))
    S.link(fp, np.arange(len(fp)), np.arange(len(fp)), forest, 3)
    assert forest.up.tolist() == want


def test_shards_find_all_links(spark):
    rng = random.Random(3)
    fp = sorted(set(clustered(rng, 600)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp long")
    want = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    at = {x - (1 << 64) if x >> 63 else x: i for i, x in enumerate(fp)}
    far = S.links(df, radius=6).collect()
    assert roots(len(fp), [(at[e.u], at[e.v]) for e in far]) == roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 6])
    for points in (100_000, 60, 5):  # two levels, then more
        edges = S.links(df, cell_points=points).collect()
        assert roots(len(fp), [(at[e.u], at[e.v]) for e in edges]) == want


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (40, 30), (200, 150)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 3)]
        got = {r.node: r.root for r in components(spark.createDataFrame([*pairs, (None, 1)], "u long, v long")).collect()}
        want = roots(n, pairs)
        assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    fp = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    got = sorted(map(tuple, S.op5_simhash(spark, d).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == [(i, f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fp, root)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, None, 1), (3, "", 1), (7, "a b c d", 1), (7, "a b c d", 1), (None, "x y z", 1), (9, "A b c d", 1)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_duplicates(df).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_a_large_group_sends_no_pairs(spark):
    rng = random.Random(6)
    near = sorted({0 ^ (1 << a) ^ (1 << b) for a in range(63) for b in range(63)})
    rng.shuffle(near)
    edges = S.links(spark.createDataFrame([(x,) for x in near], "fp long")).count()
    assert edges < 20 * len(near)
