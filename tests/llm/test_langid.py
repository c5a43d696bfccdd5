import zlib

from peakpool.llm import langid as L


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = L.op3_langid(spark, d).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    right = sum(r.lang_pred == rows[r.doc_id].lang for r in held)
    assert right / len(held) > 0.95, (right, len(held))


def test_odd_rows(spark):
    en = "the cat and the dog were sitting in the garden while it was raining "
    fr = "le chat et le chien étaient assis dans le jardin pendant que la pluie tombait "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr", 1.0) for i in range(40)]
    rows += [(100, None, "en", 0.0), (101, "", None, 0.0), (102, "123 !? 4", "fr", 0.0), (103, en, None, 0.0), (103, en, None, 0.0), (None, fr, None, 0.0), (104, "été", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert [of[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and of[100].score == 0
    assert of[103].lang_pred == "en" and of[None].lang_pred == "fr" and of[104].lang_pred in ("en", "fr")
    assert L.identify(df.limit(0)).count() == 0
    none = {r.doc_id: r.lang_pred for r in L.identify(df, L.F.lit(False)).collect()}
    assert {none[i] for i in (100, 101, 102)} == {"und"} and {none[i] for i in (0, 1, 103, 104, None)} == {None}


def test_three_sisters_and_a_lone_language():
    import numpy as np

    rng = np.random.default_rng(0)
    langs, x = [], []
    for k, c in enumerate(["en", "de", "nl", "xx"]):
        for _ in range(50):
            v = np.zeros(L.CELLS, np.float32)
            v[k * 10 : k * 10 + 10] = 1 + rng.random(10)
            x.append(v / np.linalg.norm(v))
            langs.append(c)
    m = L.Model(np.stack(x), langs)
    assert len(m.pairs["germanic"]) == 3 and m.pairs["xx"] == []
    assert m.predict(np.stack(x))[0] == langs


def plain_features(text):
    """Counts of hashed grams of one to three bytes, by plain loops."""
    import math

    low = text.decode("utf-8", "replace").lower().encode()
    b = b" " + b" ".join(bytes(x if 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in low).split()) + b" "
    out, cut = [0.0] * L.CELLS, lambda h: (h & 0xFFFFFFFF) >> 21
    for i in range(len(b)):
        one = b[i] * 2654435761
        out[cut(one)] += 1
        if i + 1 < len(b):
            two = ((one & 0xFFFFFFFF) ^ (b[i + 1] * 2246822519 & 0xFFFFFFFF)) * 3266489917
            out[cut(two)] += 1
            if i + 2 < len(b):
                out[cut(((two & 0xFFFFFFFF) ^ (b[i + 2] * 668265263 & 0xFFFFFFFF)) * 374761393)] += 1
    out = [math.sqrt(x) for x in out]
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out]


def test_features_and_votes_match_brute_force():
    import numpy as np

    for t in ("The cat, the dog!", "É été 12 ß", "x", "a b " * 200):
        assert np.allclose(L.features(t.encode()), plain_features(t.encode()), atol=1e-6)
    rng = np.random.default_rng(1)
    langs = [c for c in ("en", "de", "nl", "sv", "fr", "es", "xx") for _ in range(12)]
    x = np.abs(rng.normal(0, 1, (len(langs), L.CELLS))).astype(np.float32)
    x += np.array([[0.6 * (k % 97 == ord(c[1]) % 97) for k in range(L.CELLS)] for c in langs], np.float32)
    unit = lambda z: (z / np.linalg.norm(z, axis=1, keepdims=True)).astype(np.float32)
    m, probe = L.Model(unit(x), langs), unit(np.abs(rng.normal(0, 1, (60, L.CELLS))))
    for row, name, score in zip(probe, *m.predict(probe), strict=True):
        v = np.append(row, 1).astype(np.float64)
        top = {f: v @ m.top[:, k] for k, f in enumerate(m.families)}
        family = max(m.families, key=lambda f: top[f])
        votes, sums, least = ({c: z for c in m.members[family]} for z in (0, 0.0, 20.0))
        for j, (a, b) in enumerate(m.pairs[family]):
            s = v @ m.within[family][:, j]
            for c, y in ((a, s), (b, -s)):
                votes[c], sums[c], least[c] = votes[c] + (y > 0), sums[c] + y, min(least[c], y)
        assert name == max(m.members[family], key=lambda c: (votes[c], sums[c]))
        logistic = lambda z: 1 / (1 + np.exp(-2 * np.clip(z, -20, 20)))
        assert abs(score - logistic(top[family]) * logistic(least[name])) < 1e-5


def test_ties_of_votes_go_by_margins():
    import numpy as np

    m = L.Model.__new__(L.Model)
    m.families, m.members, m.top = ["f"], {"f": ["a", "b", "c"]}, None
    m.pairs = {"f": [("a", "b"), ("a", "c"), ("b", "c")]}
    m.within = {"f": np.array([[0.0, 0.0, 0.0], [1.0, -4.0, 2.0]])}  # a beats b by 1, c beats a by 4, b beats c by 2: a vote each
    assert m.predict(np.zeros((1, 1), np.float32))[0] == ["c"]


def test_a_very_long_text_and_null_ids(spark):
    en, fr = "the cat and the dog were sitting in the garden ", "le chat et le chien étaient assis dans le jardin "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)] + [(50, "1 " * 700_000 + fr * 30_000, None), (None, en, "en")]
    got = {r.doc_id: r.lang_pred for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[50] == "fr" and got[None] == "en"
