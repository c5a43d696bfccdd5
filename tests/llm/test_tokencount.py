import random

import numpy as np
import pytest

from peakpool.llm import tokencount as T


def test_separators_at_all_places(spark, tmp_path):
    rng = random.Random(1)
    want = set()
    for k in range(12):
        x = [T.END if rng.random() < (0.05, 0.5, 0.0)[k % 3] else rng.randrange(1000) for _ in range(rng.choice([0, 1, 7, 64, 301]))]
        np.array(x, "<u2").tofile(tmp_path / f"f{k}")
        n = ordinal = 0
        for t in x:
            if t == T.END:
                want.add((f"f{k}", ordinal, n, True))
                n, ordinal = 0, ordinal + 1
            else:
                n += 1
        if n:
            want.add((f"f{k}", ordinal, n, False))
    files = spark.createDataFrame([(f"f{k}",) for k in range(12)] * 2 + [(None,)], "file string")
    for block in (2, 14, 1 << 20):
        got = [tuple(r) for r in T.count_tokens(files, f"file://{tmp_path}", block_bytes=block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_a_cut_token_raises(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends within a token"):
        T.count_tokens(spark.createDataFrame([("f",)], "file string"), f"file://{tmp_path}").count()


def test_query_equals_the_library(spark):
    d = "/root/testdata/sf0.001"
    code = T.encoder(T.vocabulary_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in T.op10_tokencount(spark, d).collect()}
    assert got == {i: len(code.encode_ordinary(t or "")) for i, t in texts.items()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "a", 0)], "doc_id long, text string, ordinal int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in T.document_tokens(df, T.vocabulary_path(), block_bytes=2).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert T.document_tokens(df.limit(0), T.vocabulary_path()).count() == 0
