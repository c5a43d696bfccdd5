import hashlib
import random

import numpy as np

from peakpool.llm import substrings as S
from tests_support import repeated_bytes


def want(docs, length):
    for (i, t), gone in zip(docs, repeated_bytes(docs, length), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone[:-1], strict=True))
        yield i, len(t), sum(gone), spans, kept


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(8)]
    docs = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and docs:
            t = list(rng.choice(docs))
            for _ in range(rng.randint(0, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("xyz")
            docs.append("".join(t))
        elif kind < 0.3:
            docs.append(word() * rng.randint(0, 80))
        else:
            docs.append(" ".join(rng.choice(passage) if rng.random() < 0.1 else word() for _ in range(rng.randint(0, 150))))
    return docs


def test_prefix_classes_are_exact():
    rng = np.random.default_rng(1)
    for trial in range(60):
        parts = [rng.integers(1, 3 + trial % 3, rng.integers(1, 120)) for _ in range(rng.integers(1, 12))]
        parts += [parts[0][3:], parts[-1]]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int64)
        length = int(rng.integers(8, 40))
        order, cls = S.prefix_classes(text, length)
        assert sorted(order) == list(range(len(text)))
        by = {}
        for i, c in zip(order.tolist(), cls.tolist()):
            w = tuple(text[i : i + length])
            if len(w) == length and 0 not in w:
                by.setdefault(c, set()).add(w)
        assert all(len(x) == 1 for x in by.values())
        words = [w for x in by.values() for w in x]
        assert len(words) == len(set(words))


def test_matches_brute_force(spark):
    texts = corpus(4, 120)
    rows = [(i * 3 + 1, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    docs = [(i, t.encode()) for i, t, _ in rows]
    assert sum(r[2] for r in want(docs, 100)) > 1000
    for length in (100, 40):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.dedup_substrings(df, length=length).collect())
        assert got == list(want(docs, length))


def test_hot_keys_and_long_texts_are_exact(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 150))) + passage[rng.randint(0, 40) :] + "".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(60)]
    docs = [(i, t.encode()) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.dedup_substrings(df, hot=3, transform=500, part=90).collect())
    assert got == list(want(docs, 100))


def test_a_long_text_in_parts():
    rng = random.Random(1)
    t = "".join(rng.choice("abc ") for _ in range(3000)).encode()
    whole = S.find_anchors([t], 100)
    _, pos, _, _, back, fore = S.find_anchors([t], 100, 256)
    covered = sorted(s for p, b, f in zip(pos, back, fore) for s in range(p - b, p - f + 1))
    assert covered == list(range(len(t) - 99))
    assert set(pos) == set(whole[1])


def test_copies_send_one_anchor_for_each_context(spark):
    rng = random.Random(5)
    t = "".join(rng.choice("abcdefgh ") for _ in range(700))
    alone = S.find_anchors([t.encode()], 100)
    no, pos, key, ctx, _, _ = S.find_anchors([t.encode()] * 300, 100)
    lead, late = S.firsts(no, no * 0, pos, key, ctx)
    assert sorted(pos[lead]) == sorted(alone[1]) and set(no[lead]) == {0}
    assert len(lead) + len(late) == len(pos) and 0 not in no[late]
    none = np.empty(0, np.int64)
    assert [len(x) for x in S.firsts(none, none, none, none, none)] == [0, 0]
    rows = [(i // 2, t[: 150 + 25 * (i % 20)]) for i in range(400)]  # copies and repeated ids, met in any order by many tasks
    got = S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(23)).groupBy("n_removed", "n_bytes").count().collect()
    assert sum(r["count"] for r in got) == 400 and sum(r["count"] * (r.n_bytes - r.n_removed) for r in got) in range(625, 700)


def test_odd_rows(spark):
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(None, a, 1), (1, None, 1), (2, "", 1), (3, a, 1), (3, a, 1), (4, "x" + a, 1), (5, "short", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.dedup_substrings(df).collect()}
    assert got == {None: (150, 0, 0, a.encode()), 1: (0, 0, 0, b""), 2: (0, 0, 0, b""), 3: (150, 150, 1, b""), 4: (151, 150, 1, b"x"), 5: (5, 0, 0, b"short")}
    only = spark.createDataFrame([(3, a), (3, a), (3, a + "z")], "doc_id long, text string")
    assert sorted(r.n_removed for r in S.dedup_substrings(only).collect()) in ([0, 0, 150], [0, 150, 150])
    assert S.dedup_substrings(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = sorted(map(tuple, S.op9_substrings(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == [(i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in want(docs, 100)]


def test_cut_characters_and_columns_handed_on(spark):
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(150))
    df = spark.createDataFrame([(1, "è" + a, {"k": 1}), (2, "é" + a, {"k": 2}), (3, "short", None)], "doc_id long, text string, m map<string,int>")
    got = {r.doc_id: (bytes(r.kept), r.carry.m) for r in S.dedup_substrings(df, keep="text", carry=["m"]).collect()}
    assert got == {1: (("è" + a).encode(), {"k": 1}), 2: ("é".encode(), {"k": 2}), 3: (b"short", None)}
    b = "é" * 100  # a cut at each byte: windows of the second text start within characters
    got = [bytes(r.kept) for r in S.dedup_substrings(spark.createDataFrame([(1, "x" + b)], "doc_id long, text string"), keep="text").collect()]
    assert got[0].decode().startswith("x")
