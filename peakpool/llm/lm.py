"""Language-model scores by a probabilistic suffix tree over words."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.llm.common import as_bytes, crc_mod, discard, mix64, pack, part_count, parts, table, trim, unpack, written

#: The end of a text as a token; no word has a line feed.
END = b"\n"
#: Bytes of text in one block of documents.
BLOCK_BYTES = 10 << 20
#: The first level whose positions are written; up to there they are worked out again from the tokens, which takes less room.
CARRIED = 3
#: Buckets of a level, at least, where there are so many in all.
LEAST_BUCKETS = 8
#: A bucket's verdicts on a context: it is a state; it may have longer ones.
KEPT, OPEN = 1, 2
REPLY = "block bigint, level int, bucket int, payload binary, n bigint, v bigint, gain double"


def tokenise(texts: list[bytes | None]):
    """(distinct words, their numbers in text order with an end after each text, tokens of each text)."""
    known = _Numbered(count())
    known[END]
    ids, sizes = [], []
    for t in texts:
        w = (t or b"").lower().split()
        w.append(END)
        ids.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
        sizes.append(len(w))
    return list(known), np.concatenate(ids) if ids else np.empty(0, np.int32), np.array(sizes, np.int64)


class _Numbered(dict):
    """Gives each new key the next number."""

    def __init__(self, number):
        self.number = number

    def __missing__(self, key):
        self[key] = n = next(self.number)
        return n


def joined_replies(replies: dict[int, tuple], column: int, kind) -> np.ndarray:
    """A column of all buckets' replies, in the order in which the keys were sent."""
    return np.concatenate([replies[b][column] for b in sorted(replies)]).astype(kind) if replies else np.empty(0, kind)


def replied(replies: dict[int, tuple], order: np.ndarray, column: int, kind) -> np.ndarray:
    """A column of the buckets' replies, at the keys' own places. order: the keys as they were sent, by bucket."""
    out = np.zeros(len(order), kind)
    out[order] = joined_replies(replies, column, kind)
    return out


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return np.flatnonzero(new)


def spans(cut: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Begin and end of each of the runs that begin at cut, of n rows in all."""
    return list(zip(cut.tolist(), np.append(cut, n)[1:].tolist(), strict=True))


def small(x: np.ndarray) -> np.ndarray:
    """Numbers in 32 bits if they fit."""
    return x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64)


def words_sent(words: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Words in the order sent (by bucket) and their buckets."""
    to = (mix64(words) % np.uint64(m["buckets"])).astype(np.int32)
    return np.argsort(to, kind="stable"), to


def pair_key(name: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(name.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64))


def ask_words(state: bytes, number: int, m: dict):
    """(bucket, words and their training counts, packed) for each bucket."""
    _, _, held, sizes, ids, words = unpack(state)
    order, to = words_sent(words, m)
    c = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(words)).astype(np.uint32)[order]
    words, to = words[order], to[order]
    cut = starts(to)
    for bucket, (lo, hi) in zip(to[cut].tolist(), spans(cut, len(to)), strict=True):
        yield bucket, pack(np.array([number], np.int64), words[lo:hi], c[lo:hi])


class Front:
    """The positions of a block's tokens that have a context of `level` words which may be a state.

    docs: of each document the id, null flag, held-out flag, tokens, tokens known, base score, and the score of the tokens that
    no longer context can change. at, owner, tok, ctx, below, final: of each position its place in the block, document, word,
    context, and the probabilities by the next shorter context and by the longest state so far. words, names, sizes: the words'
    numbers in the corpus, the contexts' names (the bucket that has counted them, and their number there) and training counts."""

    def __init__(self, level: int, docs: list[np.ndarray], rows: list[np.ndarray], tables: list[np.ndarray], model: dict):
        self.level, self.docs, self.m = level, docs, model
        self.at, self.owner, self.tok, self.ctx, self.below, self.final = rows
        self.words, self.names, self.sizes = tables

    @staticmethod
    def first(state: bytes, replies: dict[int, tuple], m: dict) -> Front:
        """Level 1, from a block's tokens and its words' counts."""
        doc, null, held, sizes, ids, words = unpack(state)
        order, to = words_sent(words, m)
        seen, rank = (replied(replies, order, i, np.int64) for i in (0, 1))
        base = (seen + 1) / (m["n"] + (m["v"] + 1))
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        p = base[ids]
        total = lambda x: np.bincount(owner, weights=x, minlength=len(sizes))
        docs = [doc, null, held, sizes, total(seen[ids] > 0).astype(np.int64), total(np.log10(p)), np.zeros(len(sizes))]
        inside = np.ones(len(ids), bool)
        inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        use = np.flatnonzero(inside)
        use = use[seen[ids[use - 1]] >= m["min_count"]]
        gone = np.ones(len(ids), bool)
        gone[use] = False
        docs[6] += np.bincount(owner[gone], weights=np.log10(p[gone]), minlength=len(sizes))
        return Front(1, docs, [use, owner[use], ids[use], ids[use - 1], p[use], p[use]], [rank * m["buckets"] + to, to.astype(np.int64) << 32 | rank, seen], m)

    @staticmethod
    def load(level: int, payload: bytes, m: dict) -> Front:
        x = unpack(payload)
        at, owner = np.cumsum(x[7].astype(np.int64)), np.cumsum(x[8].astype(np.int64)).astype(np.int32)
        return Front(level, x[:7], [at, owner, x[9], x[10], x[11].astype(np.float64), x[12].astype(np.float64)], [t.astype(np.int64) for t in x[13:]], m)

    def dump(self) -> bytes:
        some = lambda x: np.unique(x, return_inverse=True)
        (used, tok), (held, ctx) = some(self.tok), some(self.ctx)
        step = lambda x: np.diff(x, prepend=0).astype(np.uint32)
        rows = [step(self.at), step(self.owner), tok.astype(np.int32), ctx.astype(np.int32), self.below.astype(np.float32), self.final.astype(np.float32)]
        return pack(*self.docs, *rows, small(self.words[used]), self.names[held], small(self.sizes[held]))

    def pairs(self) -> None:
        """The distinct (context, word) pairs of the positions, their buckets and the order in which they are sent. A context's
        pairs go to the bucket that has counted it, modulo the number of buckets that the level has, but for hot ones."""
        keys, self.back = np.unique(self.ctx.astype(np.int64) << 32 | self.tok.astype(np.int64), return_inverse=True)
        self.own, word = keys >> 32, self.words[keys & 0xFFFFFFFF]
        name = self.names[self.own]
        self.size = self.sizes[self.own]
        self.hot = self.size > self.m["hot"]
        own = name.astype(np.uint64) >> np.uint64(32)
        self.bucket = (np.where(self.hot, pair_key(name, word), own) % np.uint64(self.m["fold"][self.level])).astype(np.int32)
        self.sent = np.lexsort((name, self.bucket))
        self.word = word

    def ask(self, number: int):
        """(bucket, pairs with their training counts, packed) for each bucket. A context's pairs stand together."""
        self.pairs()
        train = ~self.docs[2][self.owner]
        n = np.bincount(self.back, weights=train, minlength=len(self.own)).astype(np.uint32)
        below = np.zeros(len(self.own), np.float64)
        below[self.back[train]] = self.below[train]  # only training pairs are weighed; equal for all of a pair
        if self.level == 1:  # the base's probability, by the word's count
            below = small(np.maximum(np.rint(below * (self.m["n"] + (self.m["v"] + 1))) - 1, 0))
        else:
            below = np.where(below > 0, -np.log10(np.where(below > 0, below, 1)), 0).astype(np.float32)
        own, to = self.own[self.sent], self.bucket[self.sent]
        run, cut = starts(own, to), starts(to)
        first = np.searchsorted(run, cut)
        name = self.names[own[run]]
        step = np.diff(name, prepend=0)
        step[first] = name[first]
        by_run = [small(np.diff(np.append(run, len(own)))), step, *(x[self.sent[run]] for x in (small(self.size), self.hot))]
        by_pair = [x[self.sent] for x in (small(self.word), n, below)]
        for bucket, (lo, hi), (a, b) in zip(to[cut].tolist(), spans(cut, len(own)), spans(first, len(run)), strict=True):
            yield bucket, pack(np.array([number]), *(x[a:b] for x in by_run), *(x[lo:hi] for x in by_pair))

    def answer(self, replies: dict[int, tuple]) -> None:
        """Takes the pairs' total counts, their contexts' verdicts, and the names of those that may be contexts themselves."""
        self.pairs()
        mu, self.pair = self.m["smoothing"], np.zeros(len(self.own), np.int64)
        self.count = replied(replies, self.sent, 0, np.int64)
        flags = replied(replies, self.sent, 1, np.uint8)
        kept = (flags & KEPT > 0) | self.hot & np.isin(self.names[self.own], self.m["kept_hot"].get(self.level, []))
        self.open = flags & OPEN > 0
        named = self.sent[((self.count >= self.m["min_count"]) & self.open)[self.sent]]
        self.pair[named] = self.bucket[named].astype(np.int64) << 32 | joined_replies(replies, 2, np.int64)
        self.below = (self.count[self.back] + mu * self.below) / (self.size[self.back] + mu)
        self.final = np.where(kept[self.back], self.below, self.final)

    def longer(self) -> Front:
        """The positions of the next level, after answer(): a token's longer context is the pair at the place before it."""
        before = np.flatnonzero((np.diff(self.at) == 1) & (np.diff(self.owner) == 0))
        of = self.back[before]
        good = (self.count[of] >= self.m["min_count"]) & self.open[of]
        next_, of = before[good] + 1, of[good]
        gone = np.ones(len(self.at), bool)
        gone[next_] = False
        docs = [*self.docs[:6], self.docs[6] + np.bincount(self.owner[gone], weights=np.log10(self.final[gone]), minlength=len(self.docs[0]))]
        return Front(self.level + 1, docs, [self.at[next_], self.owner[next_], self.tok[next_], of, self.below[next_], self.final[next_]], [self.words, self.pair, self.count], self.m)

    def scores(self) -> np.ndarray:
        return self.docs[6] + np.bincount(self.owner, weights=np.log10(self.final), minlength=len(self.docs[0]))


def tally(t: pa.Table, level: int, model: dict) -> pa.Table:
    """Totals of the keys in a bucket, sent back to each block in its own order; contexts are judged where they are whole."""
    trim()
    bucket, rows = t.column("to")[0].as_py(), []
    got = list(map(unpack, t.column("payload").to_pylist()))
    keys = np.array([len(x[-1]) for x in got])
    first_key = np.cumsum(keys) - keys
    each = lambda n, *arrays: zip(n.tolist(), *([x[lo:hi] for lo, hi in spans(first_key, keys.sum())] for x in arrays), strict=True)
    if level == 0:
        number, words, c = (np.concatenate(x) for x in zip(*got, strict=True))
        u, back = np.unique(words, return_inverse=True)
        total = np.bincount(back, weights=c, minlength=len(u)).astype(np.int64)
        rank = np.empty(len(u), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(u))  # frequent words have small numbers
        rows.append((None, 0, bucket, None, int(total.sum()), int((total > 0).sum()), None))
        rows += [(b, 0, bucket, pack(x, y), None, None, None) for b, x, y in each(number, small(total[back]), small(rank[back]))]
    else:
        runs = np.array([len(x[1]) for x in got])
        number, length, step, size, hot, word, c, below = (np.concatenate(x) for x in zip(*got, strict=True))
        first, name = np.cumsum(runs) - runs, np.cumsum(step)
        name -= np.repeat(name[first] - step[first], runs)  # each cell's first step is a name
        context, size, hot, word = np.repeat(name, length), np.repeat(size.astype(np.int64), length), np.repeat(hot, length), word.astype(np.int64)
        u, one, back = np.unique(pair_key(context, word), return_index=True, return_inverse=True)
        total = np.bincount(back, weights=c, minlength=len(u))
        mu, own, whole, dealt_on = model["smoothing"], context[one], size[one], hot[one]
        seen = total > 0
        rarest = np.zeros(len(u))
        np.maximum.at(rarest, back, below)
        p = (rarest + 1) / (model["n"] + (model["v"] + 1)) if level == 1 else 10.0**-rarest
        gain = np.zeros(len(u))
        # what the context says of each of its occurrences when that one is left out, against the context that is shorter by one
        gain[seen] = total[seen] * np.log(((total[seen] - 1) / p[seen] + mu) / (whole[seen] - 1 + mu))
        ctx, of = np.unique(own, return_inverse=True)
        total_gain = np.bincount(of, weights=gain, minlength=len(ctx))
        kept = (total_gain >= model["min_gain"])[of] & ~dealt_on
        # a context with one next token alone can't have longer states once all it may still gain is too little: their shorter
        # contexts' probabilities are at least its own
        lone = np.bincount(of, weights=seen, minlength=len(ctx)) <= 1
        most = np.zeros(len(ctx))
        np.maximum.at(most, of[seen], -whole[seen] * np.log((total[seen] + mu * p[seen]) / (whole[seen] + mu)))
        open_ = (~lone | (most >= model["min_gain"]))[of] | dealt_on
        for i in np.flatnonzero(np.bincount(of, weights=dealt_on, minlength=len(ctx)) > 0).tolist():
            rows.append((int(ctx[i]), -level, bucket, None, None, None, float(total_gain[i])))
        named = (total >= model["min_count"]) & open_
        rows.append((None, level, bucket, None, None, int(total[named].sum()), None))
        flags = (kept * KEPT + open_ * OPEN).astype(np.uint8)[back]
        place, to_name = small((np.cumsum(named) - 1)[back][named[back]]), np.append(0, np.cumsum(named[back]))[first_key]
        rows += [(b, level, bucket, pack(x, y, place[lo:hi]), int((y & KEPT).sum()), None, None) for (b, x, y), (lo, hi) in zip(each(number, small(total[back].astype(np.int64)), flags), spans(to_name, len(place)), strict=True)]
    names = ["block", "level", "bucket", "payload", "n", "v", "gain"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(names)})


def blocks(docs: DataFrame, id_col: str, text_col: str, train, block_bytes: int) -> DataFrame:
    """(block, payload): documents in blocks of about block_bytes, tokenised once and written."""

    def run(batches):
        number = count()
        ids, held, texts, size = [], [], [], 0

        def done():
            words, tokens, sizes = tokenise(texts)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            null = np.array([i is None for i in ids])
            name = TaskContext.get().partitionId() << 32 | next(number)
            state = pack(np.array([i or 0 for i in ids], np.int64), null, np.array(held, bool), sizes, tokens, hashes, level=3)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([state], pa.binary())], ["block", "payload"])

        for b in parts(batches, 2):
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t or b"")
                if size >= block_bytes:
                    yield done()
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield done()

    return docs.select(F.col(id_col).cast("bigint"), ~F.coalesce(train, F.lit(False)), text_col).mapInArrow(run, "block bigint, payload binary")


def pst_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", depth: int | None = None, min_count: int = 8, smoothing: float = 4.0, min_gain: float = 3.0, gap: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    train: a boolean column over docs; null counts as held out. Tokens: words between ASCII white space, A-Z lower-cased, and
    one end for each text. base_score: sum of log10((c + 1) / (N + V + 1)) over tokens, with the training counts.

    The model is a probabilistic suffix tree: a context of words that occurs min_count times in training is a state if, each
    occurrence left out in turn, its own next-token counts say at least min_gain nats more of what follows it than the context
    that is shorter by one word. Each token is scored by the longest suffix that is a state; a state's distribution is its
    counts plus `smoothing` times the next shorter context's distribution, down to the base's, so that all sum to one. Contexts
    grow by a word at a time until `gap` lengths in a row have no state (a word may turn on one further back and not on those
    between), or up to `depth` words (1 at least). Counts are of all training texts.

    Ids are integers; null and empty texts have an end only; a very long text is a block by itself; a null id keeps its row;
    repeated rows are counted and scored as often as they occur; without training texts N and V are 0; an empty table gives no
    rows. Other columns are not read.

    Documents are held in blocks; for each level a block sends its distinct (context, token) pairs with their counts to the
    context's bucket and gets back the totals and the verdict. From the third level on only the positions are written and
    looked at that still have a context. From the second on the number of buckets follows the training tokens that still have
    one (twice their share of all buckets), as the cells that blocks and buckets exchange grow with the product of both. Contexts with over an eighth of an average bucket's tokens are dealt by pair; their
    gains are summed by Spark, and the states among them, at most eight times as many as buckets, are all that the driver sees.
    """
    n = part_count(docs)
    model = {"buckets": n, "min_count": min_count, "smoothing": smoothing, "min_gain": min_gain, "n": 0, "v": 0, "hot": float("inf"), "kept_hot": {}, "fold": {1: n}}
    state, base = written(blocks(docs, id_col, text_col, train, block_bytes)), 0

    def met(f, names, kinds, schema: str, m: dict, base: int, upto: int) -> DataFrame:
        """f(front, block) of each block, whose levels below `upto` are answered. base: the level of the written state."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            trim()
            got: dict[int, dict[int, tuple]] = {}
            for level, bucket, payload in zip(*(right.column(c).to_pylist() for c in ("level", "bucket", "payload")), strict=True):
                got.setdefault(level, {})[bucket] = unpack(payload)
            out = []
            for block, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist(), strict=True):
                front = Front.load(base, payload, m) if base else Front.first(payload, got[0], m)
                while front.level < upto:
                    front.answer(got.get(front.level, {}))
                    front = front.longer()
                out.append(pa.table({k: pa.array(x, t) for k, x, t in zip(names, f(front, block), kinds, strict=True)}))
            return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})

        mine = replies.where("level >= 0 and block is not null").select("block", "level", "bucket", "payload")
        return state.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, schema)

    def words_asked(batches):
        for b in batches:
            for name, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*ask_words(payload, name, first), strict=True), (pa.int32(), pa.binary()), strict=True)], ["to", "payload"]).to_batches()

    def asked(front: Front, block: int):
        rows = list(front.ask(block))
        return [None] * len(rows), [r[0] for r in rows], [r[1] for r in rows]

    def carried(front: Front, block: int):
        _, to, cells = asked(front, block)
        return [block] + [None] * len(to), [None, *to], [front.dump(), *cells]

    cell = (["block", "to", "payload"], [pa.int64(), pa.int32(), pa.binary()], "block bigint, to int, payload binary")
    teller = lambda level, m: lambda t: tally(t, level, m)
    first = dict(model)
    replies = written(state.mapInArrow(words_asked, "to int, payload binary").groupBy("to").applyInArrow(teller(0, first), REPLY))
    total = replies.where("block is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    model |= {"n": total["n"] or 0, "v": total["v"] or 0}
    model["hot"] = max(min_count, model["n"] / (8 * n))
    old: list[DataFrame] = []
    empty = 0
    for level in count(1):
        m = dict(model)
        if level < CARRIED:
            cells = met(asked, *cell, m, base, level)
        else:
            both = written(met(carried, *cell, m, base, level))
            for df in old:
                discard(df)
            old = [both]
            state, base = both.where("to is null").select("block", "payload"), level
            cells = both.where("to is not null")
        told = written(cells.select("to", "payload").groupBy("to").applyInArrow(teller(level, m), REPLY))
        hot = told.where(f"level = {-level}").groupBy("block").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= min_gain)
        kept_hot = np.array([r["block"] for r in hot.select("block").collect()], np.int64)
        model["kept_hot"] = model["kept_hot"] | {level: kept_hot}
        sums = told.where(f"level = {level}").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        kept = len(kept_hot) + (sums["n"] or 0)
        model["fold"] = model["fold"] | {level + 1: min(n, max(LEAST_BUCKETS, -(-2 * n * (sums["v"] or 0) // max(1, model["n"]))))}
        old.append(told)
        if base:
            replies = told
        else:
            old += [state] if level == 1 else []
            old += [replies] if level == 1 else []
            replies = replies.unionByName(told)
        empty = 0 if kept else empty + 1
        if level == depth or empty == gap:
            break

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    last = dict(model)

    def scored(front: Front, block: int):
        doc, null, held, sizes, known, low, _ = front.docs
        return [pa.array(doc, mask=null), held, sizes, known, np.full(len(doc), last["n"]), low, front.scores()]

    return met(scored, names, kinds, f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", last, base, level + 1)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst_scores(table(spark, sf_dir, "documents"), F.coalesce(crc_mod("doc_id", 7) != 2, F.lit(True)))
