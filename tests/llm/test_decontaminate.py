import random
import re

from peakpool.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, k=8):
    w, hit, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        n = min(k, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(key)
    return len(w), hit, found


def test_matches_brute_force():
    rng = random.Random(3)
    alphabet = ["a", "B", "c", "dé", "e5"]
    for _ in range(300):
        items = [(str(i), " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))) for i in range(rng.randint(0, 6))]
        text = rng.choice([" ", "-", ". "]).join(rng.choice([*alphabet, "zz"] if rng.random() < 0.2 else alphabet) for _ in range(rng.randint(0, 60)))
        a = D.Automaton([(k, t.encode()) for k, t in items], window=rng.choice([2, 4, 8]))
        n, spans, found = a.match(text.encode())
        want = brute(text, items, a.window)
        assert (n, {i for lo, hi in spans for i in range(lo, hi)}, found) == want
        assert all(x[1] < y[0] + 1 for x, y in zip(spans, spans[1:]))
        left = D.without(text.encode(), spans).decode()
        assert words(left) == [x for i, x in enumerate(words(text)) if i not in want[1]]


def test_nulls_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "one two three, four", "z"), (3, "one two three, four", "z"), (None, "one two", "w")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, "TWO three"), (2, None), (None, "one"), (7, "four"), (1, "TWO three")], "item_id long, text string")
    got = sorted(map(str, D.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated", "cleaned_text").collect()))
    row = "Row(doc_id=3, n_words=4, n_hit=3, items=['1', '7'], contaminated=True, cleaned_text='one ')"
    assert got == sorted(["Row(doc_id=1, n_words=0, n_hit=0, items=[], contaminated=False, cleaned_text=None)", "Row(doc_id=2, n_words=0, n_hit=0, items=[], contaminated=False, cleaned_text='')", row, row, "Row(doc_id=None, n_words=2, n_hit=0, items=[], contaminated=False, cleaned_text='one two')"])
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in D.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    windows = {}
    for key, t in items:
        v = words(t)
        n = min(8, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            windows.setdefault(tuple(v[j : j + n]), set()).add(key)
    sizes = {len(w) for w in windows}
    for r in D.op7_decontaminate(spark, d).collect():
        w, hit, found = words(texts[r.doc_id]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), D.item_digest(found), len(found) >= 2)


def test_several_automata_find_what_one_does(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 14)))) for i in range(40)]
    texts = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 90)))) for i in range(40)] + [(40, "a b c d e f " * 60_000)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({r.doc_id: r for r in D.decontaminate(docs, bench, automaton_bytes=n).collect()} for n in (1 << 20, 60))
    assert one == many and sum(r.n_hit for r in one.values()) > 0
    for i, t in texts[:40]:
        n, hit, found = brute(t, [(str(k), x) for k, x in items])
        assert (many[i].n_words, many[i].n_hit, many[i]["items"]) == (n, len(hit), sorted(found))
