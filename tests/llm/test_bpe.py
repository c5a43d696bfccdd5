import hashlib
import random
from array import array

from tokenizers import Tokenizer

from peakpool.llm import bpe as B

ODD = ["<|endoftext|> a<|startoftext|>b <|endoftext|", "", " \n\t ", "aaaa aaa aaaaaaaaa aaaaaaaaaaaaaaaaaaaaaa", "İ I'LL they'Re ΑΣ ΑΣΑ", "é ́e\n\n x", "don't WON'T 12345 ٣٤ ½ 中文字 한국어 🙂🙂", "x" * 5000]


def test_ids_and_text_equal_the_library():
    t, b = Tokenizer.from_file(B.tokenizer_path()), B.Bpe(B.tokenizer_path())
    rng = random.Random(1)
    texts = [*ODD, *("".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(0x250, 0xD7FF), rng.randint(32, 126), 32])) for _ in range(80)) for _ in range(300))]
    for text, (ids, out) in zip(texts, b.encode([x.encode() for x in texts], step=1000), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert array("I", ids).tolist() == want
        assert out.decode() == t.decode(want, skip_special_tokens=False) == b.decode(want)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "MAX_PIECES", 10)
    b, full = B.Bpe(B.tokenizer_path()), B.Bpe(B.tokenizer_path())
    texts = [f"word{i} Other{i % 7} again".encode() for i in range(200)]
    assert list(b.encode(texts, step=50)) == list(full.encode(texts))


def test_query_equals_the_library(spark):
    d = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(B.tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = B.op1_bpe(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_clashes_and_round_trip(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "Hello  World", 7), (3, "Hello  World", 7), (None, "a", 8)], "doc_id long, text string, n_tokens int")
    enc = B.bpe_encode(docs, B.tokenizer_path())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in enc.collect()) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    back = {(r.doc_id, r.decoded) for r in B.bpe_decode(enc, B.tokenizer_path()).collect()}
    assert back == {(1, ""), (2, ""), (3, "hello</w> world</w>"), (None, "a</w>")}
    assert B.bpe_encode(docs.limit(0), B.tokenizer_path()).count() == 0
