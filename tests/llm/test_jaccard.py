import random

import numpy as np

import corpus_pipeline as P
from peakpool.llm import jaccard as J


def plain_set(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)])


def plain_roots(texts):
    """Of each text the place of the first one reachable by links of five-word-shingle Jaccard 0.8 or more; and the links."""
    sets = [plain_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    linked = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or 5 * both >= 4 * (len(a) + len(b) - both) > 0:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
                linked.add((j, i))
    return [find(i) for i in range(len(texts))], linked


def edited(rng, n):
    """Texts of random words and copies with some words changed: similarities on both sides of 0.8."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        else:
            w = [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(3, 300))]
        out.append(" ".join(w))
    return out


def test_links_are_those_of_brute_force(spark):
    texts = edited(random.Random(1), 500)
    want, linked = plain_roots(texts)
    assert len(linked) > 100
    for block in (500, 3):
        got = J.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), block=block).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_stage_drops_all_of_similarity_and_no_other(spark):
    """On the smallest tables: links by SimHash at six bits missed two such pairs and dropped one text of similarity 0.76."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    want, _ = plain_roots([t for _, t in rows])
    got = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert got == {rows[i][0] for i, r in enumerate(want) if i == r}


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, None), (3, ""), (7, "a b c d"), (7, "a b c d"), (None, "x y z"), (9, "A b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in J.near_duplicates(df).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_a_large_family_of_unlike_texts_sends_links_only(spark, monkeypatch):
    """Copies of one text that all differ from it by as much as the bound allows are no pairs of each other, but share bands."""
    rng = random.Random(5)
    base = [f"x{i}" for i in range(300)]
    texts = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(0, 300, 6), rng.choice([4, 6, 8])):
            w[k] = f"y{i}_{k}"
        texts.append(" ".join(w))
    want, linked = plain_roots(texts)
    sent = []
    monkeypatch.setattr(J, "written", lambda df: sent.append(df.count()) or df.persist())
    got = {r.doc_id: r.component_id for r in J.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=70).collect()}
    assert got == dict(enumerate(want))
    assert len(set(want)) > 30 and max(sent) < 60 * 300  # 40 bands each, never the 45,000 pairs


def test_the_tree_finds_a_pair_that_shares_no_band(spark):
    """Similarity 0.8 of two texts made to have no band in common; their fingerprints are three bits apart."""
    common = "w44224 w19009 w58735 w76267 w5709 w93411 w45242 w32176 w73997 w2131 w17252 w620"
    texts = [f"{common} z260931", f"{common} z42055", "quite another text of more than five words"]
    a, b, _ = (J.shingles(t.encode()) for t in texts)
    assert J.similar(a, b, (4, 5)) and not (J.band_keys(a) == J.band_keys(b)).any()
    texts += [f"{common} {common} other"]  # near neither
    want, _ = plain_roots(texts)
    assert want == [0, 0, 2, 3]
    got = J.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_blocks_hold_pairs_that_only_the_tree_proposes():
    """Two similar sets that share no band, only near fingerprints, in one block and in two."""
    common = "w44224 w19009 w58735 w76267 w5709 w93411 w45242 w32176 w73997 w2131 w17252 w620"
    sets = [J.shingles(t.encode()) for t in (f"{common} z260931", f"{common} z42055", "quite another text of more than five words")]
    node, bands = np.arange(3), np.stack([J.band_keys(s) for s in sets])
    for side in (np.zeros(3, np.int64), np.array([0, 1, 1])):
        assert J.between(node, node, side, bands, sets, (4, 5)) == [(0, 1)]
