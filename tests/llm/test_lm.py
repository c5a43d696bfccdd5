import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from peakpool.llm import lm as L


def tokens(t):
    return (t or "").encode().lower().split() + [L.END]


def brute(docs, depth, min_count, mu, min_gain):
    """docs: (train, text). -> (n_known, N, base, score) of each."""
    uni, nxt = Counter(), defaultdict(Counter)
    for train, t in docs:
        if train:
            w = tokens(t)
            uni.update(w)
            for i in range(len(w)):
                for d in range(1, depth + 1):
                    if i >= d:
                        nxt[tuple(w[i - d : i])][w[i]] += 1
    N, V = sum(uni.values()), len(uni)
    size = {c: sum(x.values()) for c, x in nxt.items()}

    def p(ctx, x):
        if not ctx:
            return (uni[x] + 1) / (N + V + 1)
        if size.get(ctx, 0) < min_count:
            return p(ctx[1:], x)
        return (nxt[ctx][x] + mu * p(ctx[1:], x)) / (size[ctx] + mu)

    kept = set()
    for c, x in nxt.items():
        if size[c] >= min_count:
            gain = sum(k * math.log(((k - 1) / p(c[1:], w) + mu) / (size[c] - 1 + mu)) for w, k in x.items())
            if gain >= min_gain:
                kept.add(c)
    lengths = {len(c) for c in kept}
    stop = next((d for d in range(1, depth + 1) if not lengths & {d, d + 1}), depth + 1)  # two lengths without a state end the tree
    kept = {c for c in kept if len(c) < stop}
    for _, t in docs:
        w = tokens(t)
        base = sum(math.log10(p((), x)) for x in w)
        score = 0
        for i, x in enumerate(w):
            c = next((tuple(w[i - d : i]) for d in range(min(depth, i), 0, -1) if tuple(w[i - d : i]) in kept), ())
            score += math.log10(p(c, x))
        yield sum(uni[x] > 0 for x in w), N, base, score


def corpus(seed, n):
    rng = random.Random(seed)
    follow = {a: rng.sample("abcdefghij", 3) for a in "abcdefghij"}
    for i in range(n):
        w = [rng.choice("abcdefghij")]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice(follow[w[-1][0]] if w[-1][0] in follow else ["j"]) if rng.random() < 0.8 else rng.choice("aAbBcCxyz") + str(rng.randint(0, 9)))
        yield i, " ".join(w) if i % 11 else rng.choice([None, "", "a b"])


@pytest.mark.parametrize(("block", "buckets"), [(1 << 20, 4), (300, 3)])
def test_matches_brute_force(spark, monkeypatch, block, buckets):
    monkeypatch.setattr(L, "part_count", lambda df: buckets)
    rows = list(corpus(3, 150))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for depth in (1, 3):
        got = {r.doc_id: r for r in L.pst_scores(df, L.F.col("doc_id") % 5 != 2, depth=depth, block_bytes=block).collect()}
        want = brute([(i % 5 != 2, t) for i, t in rows], depth, 8, 4.0, 3.0)
        better = 0
        for (i, t), (known, n, base, score) in zip(rows, want, strict=True):
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 2, len(tokens(t)), known, n)
            assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6 * abs(score)
            better += r.held_out and r.score > r.base_score
        assert better > 20


def test_query_base_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows}
    want = dict(zip([i for i, _ in rows], brute([(train[i], t) for i, t in rows], 8, 8, 4.0, 3.0), strict=True))
    got = L.op2_lm(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        known, n, base, score = want[r.doc_id]
        assert (r.held_out, r.n_known, r.train_tokens) == (not train[r.doc_id], known, n)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score / score - 1) < 1e-6


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (2, "", 1), (2, "", 1), (3, "a", 1)], "doc_id long, text string, score int")
    got = L.pst_scores(df, L.F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(0, 1, 1, 5), (2, 1, 1, 5), (2, 1, 1, 5), (3, 2, 2, 5)]
    assert {r.held_out for r in L.pst_scores(df.withColumn("train", L.crc_mod("doc_id", 7) != 2), L.F.col("train")).collect() if r.doc_id is None} == {True}
    none = L.pst_scores(df, L.F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in none} == {(0, 0, 0.0)}
    assert L.pst_scores(df.limit(0), L.F.lit(True)).count() == 0


def test_contexts_grow_until_none_is_a_state(spark, monkeypatch):
    """The fourth word after three turns on the first of them, which a depth of two words can't tell."""
    monkeypatch.setattr(L, "part_count", lambda df: 3)
    rng = random.Random(4)
    rows = [(i, " ".join(w for _ in range(12) for w in (lambda a: (a, "of", "the", a.upper() + "z"))(rng.choice("abcd")))) for i in range(60)]
    rows[7] = (7, " ".join([rows[7][1]] * 400))  # a very long text, beyond a block
    got = {r.doc_id: r for r in L.pst_scores(spark.createDataFrame(rows, "doc_id long, text string"), L.F.col("doc_id") % 5 != 2, depth=None, block_bytes=2000).collect()}
    whole, cut = (list(brute([(i % 5 != 2, t) for i, t in rows], d, 8, 4.0, 3.0)) for d in (7, 2))
    for (i, _), (*_, score), (*_, short) in zip(rows, whole, cut, strict=True):
        assert abs(got[i].score - score) < 1e-6 * abs(score) and got[i].score > short + 1


def test_cells_follow_the_open_contexts(spark, monkeypatch):
    """Cells are blocks times buckets: a level has as many buckets as its open contexts need, and all scores stay."""
    written, cells, scores = L.written, [], {}

    def counted(df):
        w = written(df)
        if "level" in w.columns:
            cells.append(w.where("level > 0 and block is not null").count())
        return w

    monkeypatch.setattr(L, "written", counted)
    rng = random.Random(6)
    rows = [(i, f"{t or ''} {' '.join(f'w{rng.randrange(2000)}' for _ in range(300))}") for i, t in corpus(5, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for buckets in (3, 60):
        monkeypatch.setattr(L, "part_count", lambda df, n=buckets: n)
        cells.clear()
        scores[buckets] = {r.doc_id: r.score for r in L.pst_scores(df, L.F.col("doc_id") % 5 != 2, depth=4, block_bytes=100_000).collect()}
    assert len(scores[60]) == len(rows) and all(abs(s - scores[60][i]) < 1e-6 * abs(s) for i, s in scores[3].items())
    assert cells[1] > 0 and cells[3] < cells[1] / 2 and cells[4] < cells[1] / 2
