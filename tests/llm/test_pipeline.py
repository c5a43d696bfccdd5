import hashlib
import re
from array import array

from pyspark.sql import functions as F
from test_decontaminate import brute as window_hits
from test_jaccard import plain_roots
from tokenizers import Tokenizer

import corpus_pipeline as P
from peakpool.llm import bpe
from tests_support import repeated_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text, hit):
    """The text without its hit words and what follows each of them up to the next word."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for i, (lo, hi) in enumerate(at):
        if i in hit:
            out.append(text[last:lo] if i - 1 not in hit else "")
            last = at[i + 1][0] if i + 1 < len(at) else hi
    return "".join([*out, text[last:]])


def brute(rows, items):
    """rows: dicts of documents, by id; items: (key, text). The stages but for the last, plainly, with nothing of theirs."""
    rows = [r for r in rows if r["text"] and any(map(str.isalpha, r["text"]))]
    roots, _ = plain_roots([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    flags = repeated_bytes([(r["doc_id"], r["text"].encode()) for r in rows], 100)
    for r, gone in zip(rows, flags, strict=True):
        if any(gone):
            r["text"] = bytes(b for b, g in zip(r["text"].encode(), gone, strict=True) if not g).decode("utf-8", "ignore")
    vocabulary = {w for _, t in items for w in WORD.findall(t.lower())}
    out = []
    for r in rows:
        if not r["text"]:
            continue
        known = sum(w in vocabulary for w in WORD.findall(r["text"].lower()))
        n, hit, found = window_hits(r["text"], items) if known else (1, set(), set())
        if len(found) < 2 and len(hit) <= 0.5 * n:
            out.append((r["doc_id"], cut(r["text"], hit) if hit else r["text"]))
    return out


def test_stages_match_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()), key=lambda r: r["doc_id"])
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    t = Tokenizer.from_file(bpe.tokenizer_path())
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in brute(rows, items)}
    got = {r.doc_id: r for r in P.run(spark, d).collect()}
    assert set(got) == set(want) and 0 < len(got) < len(rows)
    for i, r in got.items():
        assert r.ids == want[i] and r.n_tokens == len(want[i])
        assert r.ids_sha256 == hashlib.sha256(array("I", want[i]).tobytes()).hexdigest()


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "s", None), (2, "", "en", None, 0), (3, "a word or two and three", "en", "s", 23), (3, "a word or two and three", "en", "s", 23), (None, "another text of words", "en", "s", 21)], "doc_id long, text string, lang string, source string, n_chars long")
    d = "/root/testdata/sf0.001"
    for start in (docs, docs.limit(0)):
        x = start
        for name, f in P.STAGES[:-1]:
            x = f(spark, x, d)
            assert x.columns == docs.columns, name
            assert [y.dataType for y in x.schema] == [y.dataType for y in docs.schema], name
        assert sorted(r.doc_id or 0 for r in P.STAGES[-1][1](spark, x, d).collect()) == ([0, 3] if start is docs else [])
    assert all(re.fullmatch(r"\w+", n) for n, _ in P.STAGES)


def test_a_corpus_without_labels_stays_and_missing_labels_are_named(spark):
    en, fr = "the cat and the dog were sitting in the garden ", "le chat et le chien étaient assis dans le jardin "
    rows = [(i, f"{(en if i % 2 else fr) * 2}{i}", ("en" if i % 2 else "fr") if i < 40 else None, "s", 10) for i in range(45)] + [(99, "12 34", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in P.language(spark, docs, "").collect()}
    assert got == {i: "en" if i % 2 else "fr" for i in range(45)}
    bare = P.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert {r.doc_id for r in bare} == set(range(45)) and {r.lang for r in bare} == {None}


def test_repeated_ids_with_different_texts(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, "one text of some words here", "en", "s", 1), (1, "quite another text with other words", "en", "s", 1), (1, "one text of some words here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    x = docs
    for _, f in P.STAGES[:-1]:
        x = f(spark, x, d)
    assert sorted(r.text for r in x.collect()) == ["one text of some words here", "quite another text with other words"]
