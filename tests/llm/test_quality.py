import random
import re
from collections import Counter

from peakpool.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_match_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a ", "b ", "é　", "#* ", "\n", "cc\t", "\x0b", "\xa0"]) for _ in range(rng.randint(0, 80)))
        assert Q.measure(t.encode())[:5] == brute(t)


def test_query_counts_and_thresholds(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = Q.op6_quality(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in rows) > 0.5 * len(rows)


def test_sketch_quantiles_are_near_and_merge(spark):
    rng = random.Random(2)
    x = [rng.expovariate(1) for _ in range(5000)] + [0.0] * 100
    df = spark.createDataFrame([("a", None, "m", v) for v in x], "lang string, source string, metric string, value double")
    one = Q.quantiles(Q.sketches(df.coalesce(1)), {"q": 0.5, "r": 0.99}).first()
    many = Q.quantiles(Q.sketches(df.repartition(7)), {"q": 0.5, "r": 0.99}).first()
    assert one == many
    x.sort()
    assert abs(one.q / x[len(x) // 2] - 1) < 0.02 and abs(one.r / x[int(len(x) * 0.99)] - 1) < 0.02


def test_outliers_go_and_odd_rows_are_defined(spark):
    rng = random.Random(7)
    good = [(i, " ".join(rng.choice(["word", "other", "thing", "some"]) + str(rng.randrange(17)) for _ in range(60)), "en", "s", 0) for i in range(50)]
    odd = [(100, " ".join(f"x{i}***##" for i in range(60)), "en", "s", 0), (101, None, None, None, 0), (102, "", "en", None, 0), (103, good[3][1], "en", "s", 0), (103, good[3][1], "en", "s", 0), (None, good[4][1], "en", "s", 0)]
    df = spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string, n_words int")
    got = Q.judge(df).collect()
    assert len(got) == len(good + odd)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[100] and not kept[101] and not kept[102] and kept[103] and all(kept[i] for i in range(50))
    assert Q.judge(df.limit(0)).count() == 0


def test_short_junk_goes_and_clean_short_texts_stay(spark):
    """A constant margin of 0.2 + 3 / sqrt(n_words) kept texts with a '|' after every other word up to 100 words."""
    rng = random.Random(11)
    words = lambda n: [rng.choice(["word", "other", "thing", "some", "longer"]) + str(rng.randrange(17)) for _ in range(n)]
    clean = [(i, " ".join(words(rng.randint(12, 400))), "en", "s") for i in range(200)]
    junk = [(1000 + n, " ".join(f"{w}|" if k % 2 else w for k, w in enumerate(words(n))), "en", "s") for n in range(20, 151, 10)]
    kept = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in junk)


def test_repeated_lines_of_a_clean_group_are_rejected(spark):
    """The margin of 0.3 + 1 / n_lines let a third of a text's lines be repeats where its group has none."""
    lines = lambda d, n: [f"line {d} x{i} of text {d * 31 + i} here a{i} b{d}" for i in range(n)]
    clean = [(d, "\n".join(lines(d, 20)), "en", "s") for d in range(40)]
    odd = [(100, "\n".join(x + "\nsee above" * (i % 3 == 0) for i, x in enumerate(lines(99, 30))), "en", "s")]
    rows = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.judge(rows).collect()}
    assert all(got[i].kept for i in range(40)) and not got[100].kept and not got[100].base_failed and got[100].n_dup_lines == 9


def plain_verdicts(rows, fence=3.0, factor=4.0, least=30):
    """rows: (id, text, lang, source). -> kept and failed rules of each, from plain dictionaries of bins."""
    import math

    bin_of = lambda v: 0 if v <= 0 else None if v is None else (math.ceil(math.log(v) / math.log(Q.GAMMA)), 1)
    mid = lambda b: 0.0 if b == 0 else Q.GAMMA ** b[0] * 2 / (1 + Q.GAMMA)
    order = lambda b: (0, 0) if b == 0 else (1, b[0])
    counts = [(k, x) for k, x in ((r, brute(r[1])) for r in rows)]
    lines = {id(r): sum(bool(WORD.search(x)) for x in (r[1] or "").split("\n")) for r in rows}

    def sketch(value):
        out = {}
        for r, c in counts:
            if c[0]:
                for key in ((r[2], r[3]), (r[2],), ()):
                    out.setdefault(key, Counter())[bin_of(value(r, c))] += 1
        return lambda r: next(s for s in (out.get((r[2], r[3]), Counter()), out.get((r[2],), Counter()), out[()]) if sum(s.values()) >= least or s is out[()])

    def quantile(s, q):
        n = 0
        for b in sorted(s, key=order):
            n += s[b]
            if n >= q * sum(s.values()):
                return mid(b)

    def limit(s, zero):
        bins, n = sorted(s, key=order), 0
        for b, c in zip(bins, bins[1:]):
            n += s[b]
            x, y = max(mid(b), zero), max(mid(c), zero)
            if n >= 0.75 * sum(s.values()) and y >= factor * x:
                return math.sqrt(x * y)

    length, words, rows_ = sketch(lambda r, c: c[1] / c[0]), sketch(lambda r, c: c[0]), sketch(lambda r, c: lines[id(r)])
    symbols, dups = sketch(lambda r, c: c[2] / c[0]), sketch(lambda r, c: c[3] / lines[id(r)])
    spread = sketch(lambda r, c: abs(c[1] / c[0] - quantile(length(r), 0.5)) * math.sqrt(c[0]))
    for r, c in counts:
        failed = []
        if c[0]:
            low, high = quantile(length(r), 0.25), quantile(length(r), 0.75)
            beside = fence * (high - low + quantile(spread(r), 0.75) / math.sqrt(c[0]))
            failed += ["length"] * (not low - beside <= c[1] / c[0] <= high + beside)
            for name, s, k, n, of in (("symbols", symbols, c[2], c[0], words), ("lines", dups, c[3], lines[id(r)], rows_)):
                x = limit(s(r), 0.5 / quantile(of(r), 0.5))
                failed += [name] * (x is not None and k > x * n + fence * math.sqrt(max(x * n, 1)))
        base = c[0] < 10 or 100 * c[4] > 20 * c[0]
        yield not base and not failed, ",".join(failed)


def test_verdicts_match_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rng = random.Random(3)
    rows += [(10_000 + i, " ".join(rng.choice(["a#b", "cd", "efgh", "|", "ij$", "k"]) + str(rng.randrange(50)) for _ in range(rng.randint(1, 90))) + "\n" + "tail\n" * rng.choice([0, 0, 0, 9]), rng.choice(["xx", None]), rng.choice(["s", "t"])) for i in range(150)]
    rows += [(20_000 + i, "\n".join(f"line {i} {j} of x{i * j}" for j in range(12)) + "\ntail" * (20 * (i % 20 == 7)), "zz", "s") for i in range(40)]
    want = {r[0]: v for r, v in zip(rows, plain_verdicts(rows), strict=True)}
    got = {r.doc_id: (r.kept, r.rules) for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == want
    assert {"length", "symbols", "lines"} <= {x for _, rules in want.values() for x in rules.split(",")}


def test_moving_a_source_moves_its_limit(spark):
    """A text of one symbol to ten words is ordinary where most are such, and an outlier where none is."""
    rng = random.Random(12)
    text = lambda share, n: " ".join(rng.choice(["word", "other", "thing"]) + str(rng.randrange(17)) + "&" * (rng.random() < share) for _ in range(n))
    rows = [(i, text(0.1, 200), "en", "wiki") for i in range(60)] + [(100 + i, text(0, 200), "en", "news") for i in range(60)]
    rows += [(900, text(0.1, 200), "en", "wiki"), (901, text(0.1, 200), "en", "news"), (902, text(2, 200), "en", "wiki"), (903, text(2, 200), "en", "news")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i].kept for i in (900, 901, 902, 903)] == [True, False, False, False] and "symbols" in got[901].rules
    assert all(got[i].kept for i, *_ in rows[:120])


def test_a_very_long_text(spark):
    rows = [(i, " ".join(f"w{j * 7919 % 100_003}" for j in range(300_000 if i == 5 else 100)), "en", "s") for i in range(40)]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[5].n_words == 300_000 and all(r.kept == (r.n_repeat_words * 5 <= r.n_words) for r in got.values())


def test_many_groups_are_joined_by_a_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["ab", "cde", "fg&", "h|"]) + str(rng.randrange(40)) for _ in range(rng.randint(5, 60)))
    rows = [(i, text(), rng.choice(["en", "de", None]), rng.choice(["s", "t", None, f"only{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    few = sorted(map(repr, Q.judge(df).collect()))
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    assert sorted(map(repr, Q.judge(df).collect())) == few
    assert [(r[0], (r.kept, r.rules)) for r in sorted(Q.judge(df).collect())] == [(r[0], v) for r, v in zip(rows, plain_verdicts(rows), strict=True)]
