"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakpool.llm.common import as_bytes, crc_mod, handed, handed_on, parts, table

#: Families of language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk tr uz",
    "uralic": "et fi hu",
    "sinitic": "yue zh",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Cells of the table into which grams of one to three bytes are hashed.
CELLS = 2048
#: The classifiers are fitted on so many labelled rows at most, spread evenly over the languages.
MAX_TRAINING_ROWS = 4_000
#: ASCII bytes that are no letters count as one kind of space; all bytes of other characters are kept.
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if text.isascii():
        return bool(text.translate(None, bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))))
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def features(text: bytes) -> np.ndarray:
    """Square roots of the counts of hashed grams of one to three bytes of the whole text, of length one."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    b = np.frombuffer(b" " + b" ".join(low.translate(LETTERS).split()) + b" ", np.uint8)
    out = np.zeros(CELLS)
    for at in range(0, len(b), 1 << 18):  # grams that begin here
        x = b[at : at + (1 << 18) + 2].astype(np.uint32)
        own = min(1 << 18, len(b) - at)
        one = x * np.uint32(2654435761)
        two = (one[:-1] ^ (x[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (x[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for h in (one, two, three):
            out += np.bincount(h[:own] >> np.uint32(21), minlength=CELLS)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (and an offset, last) of linear support vector machines: squared hinge loss, accelerated gradient steps from
    zero, so that equal rows give equal weights. y: one column of -1, 0 (not a row of this machine) or 1 for each machine."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float64)
    weight = np.where(y != 0, 1 / np.maximum(1, np.stack([np.where(y > 0, (y > 0).sum(0), (y < 0).sum(0))])[0]), 0.0)  # both sides weigh alike
    w = v = np.zeros((x.shape[1], y.shape[1]))
    step = 1 / (8.0 + penalty)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * x.T @ (weight * y * slack) + penalty * v
        new = v - step * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Languages by family, the families' machines (one against the rest) and each family's pairs."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = {c: FAMILY.get(c, c) for c in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [c for c in self.langs if family[c] == f] for f in self.families}
        self.pairs = {f: list(combinations(m, 2)) for f, m in self.members.items()}
        own, of = np.array(langs), np.array([family[c] for c in langs])
        self.top = svm(x, np.where(of[:, None] == np.array(self.families)[None, :], 1.0, -1.0)) if len(self.families) > 1 else None
        self.within = {}
        for f, pairs in self.pairs.items():
            if pairs:
                rows = np.isin(own, self.members[f])
                self.within[f] = svm(x[rows], np.stack([(own[rows] == a) * 1.0 - (own[rows] == b) for a, b in pairs], axis=1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row: the family by the largest margin, the language by votes of its pairs, ties by summed
        margins. score: logistic of the family's margin times that of the language's least margin over a sister language."""
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        margin = x @ self.top if self.top is not None else np.full((len(x), 1), 4.0)
        best = margin.argmax(axis=1)
        logistic = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
        lang, score = [""] * len(x), logistic(margin[np.arange(len(x)), best])
        for k, f in enumerate(self.families):
            rows, names = np.flatnonzero(best == k), self.members[f]
            votes, sums, least = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names))), np.full((len(rows), len(names)), np.inf)
            if self.pairs[f]:
                m = x[rows] @ self.within[f]
                for j, (a, b) in enumerate(self.pairs[f]):
                    for name, s in ((a, m[:, j]), (b, -m[:, j])):
                        i = names.index(name)
                        votes[:, i] += s > 0
                        sums[:, i] += s
                        least[:, i] = np.minimum(least[:, i], s)
            pick = (votes * 1e6 + sums).argmax(axis=1)
            score[rows] *= logistic(np.minimum(least[np.arange(len(rows)), pick], 20))
            for r, p in zip(rows.tolist(), pick.tolist(), strict=True):
                lang[r] = names[p]
        return lang, score


def sample(docs: DataFrame, train, id_col: str, text_col: str, lang_col: str, rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(lang, text) of at most `rows` training rows with a language and a letter-bearing text: from each language the same
    number, the first by a hash of id and text."""
    own = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("h"))
    counts = {r["lang"]: r["n"] for r in docs.where(train & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").limit(rows).collect()}
    each = max(1, rows // max(1, len(counts)))
    share = F.create_map(*[F.lit(y) for c, n in counts.items() for y in (c, min(1 << 30, int((2 * each + 100) / n * (1 << 30))))]) if counts else None
    some = own.where(F.col("h") < share[F.col("lang")]) if counts else own.limit(0)
    ranked = some.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return ranked.where(F.col("rn") <= each).select("lang", "text")


def fit(docs: DataFrame, train, id_col: str, text_col: str, lang_col: str, rows: int = MAX_TRAINING_ROWS) -> Model | None:
    def run(batches):
        for b in parts(batches, 1):
            keep = [(c, features(t).tobytes()) for c, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.binary())], ["lang", "x"])

    got = sample(docs, train, id_col, text_col, lang_col, rows).mapInArrow(run, "lang string, x binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    return Model(np.stack([np.frombuffer(r.x, np.float32) for r in got]), [r.lang for r in got]) if got else None


def identify(docs: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = MAX_TRAINING_ROWS, carry: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score) for every row of docs, from its whole text alone; carry: columns to be handed on in a struct `carry`.

    train: a boolean column over docs that says which rows may be learnt from (null: not); none: all. The machines are fitted
    on `rows` labelled rows at most. lang_pred is a learnt language, or `und` with score 0 if the text is null or has no letter,
    and null with score 0 if nothing could be learnt. Very long texts are read whole. Repeated rows are predicted alike; an empty table gives no rows. Other columns are not read.
    The model (a weight for each cell and machine) is broadcast; docs are passed once more for prediction, without a shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, F.lit(True) if train is None else F.coalesce(train, F.lit(False)), id_col, text_col, lang_col, rows))

    def run(batches):
        m = model.value
        for b in parts(batches, 1):
            texts = as_bytes(b.column(1))
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if m is None:
                for i in known:
                    lang[i] = None
                known = []
            for at in range(0, len(known), 256):
                some = known[at : at + 256]
                names, values = m.predict(np.stack([features(texts[i]) for i in some]))
                for i, name, value in zip(some, names, values.tolist(), strict=True):
                    lang[i], score[i] = name, value
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), *b.columns[2:]], [id_col, "lang_pred", "score", *b.schema.names[2:]])

    kind = docs.schema[id_col].dataType.simpleString()
    own, more = handed_on(docs.select(id_col, text_col, *handed(carry)))
    return own.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double{more}")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    r = identify(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True)))
    return r.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
