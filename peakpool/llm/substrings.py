"""Exact removal of repeated byte strings: candidates by minimizers, common prefixes by a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.llm.common import CELLS, as_bytes, cells, dealt, handed, handed_on, joined, mix64, pack, part_count, parts, table, trim, unpack, written

#: Bytes of the grams whose hashes choose a window's anchor.
GRAM = 32
#: A key with more distinct contexts than this is dealt by blocks of windows and their common bytes, and not as one group.
HOT = 2_000
#: Windows of one such block.
BLOCK = 8
#: Windows of a very long text that are looked at together; a place in them fits into 24 bits.
PART = 1 << 22
#: Bytes of text that one transform takes, but for a group that is larger by itself.
TRANSFORM = 1 << 20
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position; doubling, so five passes."""
    h, width = BYTE_HASH[raw], 1
    while width < GRAM:
        m = np.uint64(0xD6E8FEB86659FD93 + 2 * width)
        h = h[: len(h) - width] * m + h[width:]
        width *= 2
    return mix64(h)


def anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: (position, hash, first window, last window) of each anchor.

    A window is `length` bytes of one text; its anchor is the gram in it with the least hash, the first of equals. It follows
    from the window's bytes alone, so that equal windows have anchors with the same hash at the same place in the window.
    The windows of an anchor are consecutive."""
    none = np.empty(0, np.int64)
    width = length - GRAM + 1
    if len(raw) < length:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(raw)
    best = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if width > span:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    at = (best & np.uint64(0xFFFFFF)).astype(np.int64)
    whole = np.zeros(len(raw) + 1, np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= length
    whole[starts[long]] += 1
    whole[ends[long] - length + 1] -= 1
    first = np.flatnonzero(np.cumsum(whole[: len(at)]) > 0)
    a = at[first]
    new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(first) != 1)]) if len(a) else np.empty(0, bool)
    lo = first[new]
    hi = first[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])] if len(a) else none
    return a[new], h[a[new]], lo, hi


def text_groups(texts: list[bytes], step: int = 1 << 18):
    """(first number, texts) of runs of texts of about `step` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= step or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def find_anchors(texts: list[bytes], length: int, part: int = PART):
    """(text number, position, key, context hash, windows before the anchor's: first and last distance) of all anchors."""
    out = [[] for _ in range(6)]
    for first, group in text_groups(texts):
        if sum(map(len, group)) < 2 * part:
            _append(out, first, group, length)
            continue
        for k, t in enumerate(group):  # a very long text in overlapping parts, each window in one part
            for at in range(0, max(1, len(t)), part):
                _append(out, first + k, [t[at : at + part + length - 1]], length, at)
    kinds = [np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64]
    return [np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds, strict=True)]


def _append(out: list[list], first: int, group: list[bytes], length: int, shift: int = 0) -> None:
    joint = b"".join(group)
    ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
    a, key, lo, hi = anchors(np.frombuffer(joint, np.uint8), ends, length)
    if not len(a):
        return
    digest = xxhash.xxh64_intdigest
    ctx = np.fromiter((digest(joint[x:y], z) for x, y, z in zip(lo.tolist(), (hi + length).tolist(), (a - lo).tolist(), strict=True)), np.uint64, len(a))
    no = np.searchsorted(ends, a, side="right")
    for x, y in zip(out, (no + first, a - np.concatenate([[0], ends])[no] + shift, key, ctx, a - lo, a - hi), strict=True):
        x.append(y)


def classes(doc, th, pos, key, ctx):
    """Sorts anchors by key, context and place: (order, new key, new context), repeated rows of one document left out."""
    order = np.lexsort((pos, th, doc, ctx, key))
    k, c, d, t, p = (x[order] for x in (key, ctx, doc, th, pos))
    same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    again = np.concatenate([[False], same & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])])
    order, k, c = order[~again], k[~again], c[~again]
    new_key = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    return order, new_key, new_key | np.concatenate([[True], c[1:] != c[:-1]]) if len(k) else new_key


def firsts(doc, th, pos, key, ctx) -> tuple[np.ndarray, np.ndarray]:
    """(the first anchor of each key and context, the others, whose windows all start earlier too)."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order, _, new_ctx = classes(doc, th, pos, key, ctx)
    return order[new_ctx], order[~new_ctx]


def suffixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by the first `length` symbols at least, first seven symbols packed) of a text of symbols below 512; the
    end is padded with zeros."""
    n = len(text)
    packed = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(7, np.int64)])
    for i in range(7):
        packed = packed << 9 | padded[i : i + n]
    key, width = packed, 7
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        if width >= length or rank[order[-1]] == n - 1:
            return order, packed
        ahead = np.zeros(n, np.int64)
        if width < n:
            ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        width *= 2


def prefix_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class of each of its places): suffixes whose first `length` symbols are equal have one class.

    Breadth-first backward extension on the Burrows-Wheeler transform: intervals of the strings of 7, 8, 9, ... symbols are
    extended to the left by one symbol; an extended interval whose right end has no common prefix yet sets it to the present
    length and is extended in the next round, others are dropped. So common prefixes are found by increasing value, and the
    rounds stop at `length`: places that are still open share that much with the place before. Prefixes below seven symbols
    are read off the packed symbols, where the rounds begin."""
    n = len(text)
    order, packed = suffixes(text, length)
    before = text[order - 1]  # the transform; the first symbol's is the last, a separator
    by_symbol = np.argsort(before.astype(np.int16), kind="stable")
    step = np.empty(n, np.int64)  # where the suffix that is longer by one symbol stands
    step[by_symbol] = np.arange(n)
    s = packed[order]
    differ = s[1:] ^ s[:-1]
    high = differ >> 32
    bits = np.frexp(np.where(high > 0, high, differ).astype(np.float64))[1] + np.where(high > 0, 32, 0)  # of the highest bit that differs
    lcp = np.where(differ == 0, 7, np.minimum(6, (63 - bits) // 9))
    open_ = np.concatenate([[False], differ == 0, [False]])
    edge = np.concatenate([[0], np.flatnonzero(differ) + 1, [n]])
    lo, hi = edge[:-1], edge[1:]
    seed = np.concatenate([lcp[hi[:-1] - 1] == 6, [False]])
    lo, hi = lo[seed], hi[seed]
    for size in range(7, length):
        if not len(lo) or not open_.any():
            break
        count = hi - lo
        at = np.arange(count.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        group = np.repeat(np.arange(len(lo)), count) * 512 + before[at]
        if (count > 1).any():
            by = np.argsort(group, kind="stable")
            group, at = group[by], at[by]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        last = np.concatenate([first[1:], [len(group)]]) - 1
        symbol = group[first] & 511
        lo, hi = step[at[first]], step[at[last]] + 1
        fresh = open_[hi] & (symbol > 0)  # nothing extends over a separator
        lo, hi = lo[fresh], hi[fresh]
        open_[hi] = False
    return order, np.cumsum(~open_[:n])


def repeats(parts: list[bytes], rank: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, start) of each window that equals a window of a part with a lower rank. Part i has windows[i] of them."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    text[starts + sizes - 1] = 0
    part = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(text)) - starts[part]
    valid = place < windows[part]
    order, cls = prefix_classes(text, length)
    keep = valid[order]
    order, cls = order[keep], cls[keep]
    new = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    mine = rank[part[order]]
    least = np.minimum.reduceat(mine, new)
    late = order[mine > np.repeat(least, np.diff(np.concatenate([new, [len(order)]])))]
    late.sort()
    return part[late], place[late]


def runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of runs of consecutive places, which are sorted by owner and place."""
    if not len(at):
        return owner, at, at
    cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], cut])
    return owner[first], at[first], at[np.concatenate([cut, [len(at)]]) - 1]


def resolve(group, doc, th, start, size, text: bytes, length: int, transform: int = TRANSFORM):
    """(doc, th, first, last) runs of windows of the given contexts that equal a window of an earlier place in the same group.
    Contexts: their place in a text (start), their length (size), their bytes one after another (text)."""
    rank = np.empty(len(group), np.int64)
    rank[np.lexsort((start, th, doc))] = np.arange(len(group))
    ends = np.cumsum(size)
    by = np.argsort(group, kind="stable")
    total, new = np.cumsum(size[by]), np.concatenate([[True], np.diff(group[by]) != 0])
    block = np.zeros(len(by), np.int64)
    lead = np.flatnonzero(new)
    block[lead] = (total[lead] - size[by][lead]) // transform
    block = np.maximum.accumulate(block)
    out = []
    for some in np.split(by, np.flatnonzero(np.diff(block)) + 1):
        part, place = repeats([text[ends[i] - size[i] : ends[i]] for i in some.tolist()], rank[some], size[some] - length + 1, length)
        p, lo, hi = runs(part, place)
        i = some[p]
        out.append((doc[i], th[i], start[i] + lo, start[i] + hi))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4


def cut_out(text: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what is left) when windows lo..hi are removed."""
    if not len(lo):
        return 0, 0, text
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    a, b = lo[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]
    left, last = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        left.append(text[last:x])
        last = y
    return int((b - a).sum()), len(a), b"".join([*left, text[last:]])


def spread(doc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each document id; place() is the same in SQL."""
    return ((doc ^ (doc >> 17) ^ (doc >> 31)) % n).astype(np.int32)


def place(doc, n: int):
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 17)).bitwiseXOR(F.shiftright(doc, 31)), F.lit(n)).cast("int")


NULL_ID = -(1 << 63)
DONE = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep: str = "bytes", hot: int = HOT, transform: int = TRANSFORM, part: int = PART, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes; keep="text": without what
    is left of characters that are cut in two; keep="digest": their SHA-256 in hex, as UTF-8); carry: columns to be handed on in a struct `carry`.

    Each byte is removed that is covered by a string of `length` bytes which also starts earlier: in a row with a smaller id,
    or earlier in the same row. Matches never cross rows, overlaps count, and strings are judged on the input. Ids are
    integers. Null and empty texts have no bytes; a null id is smaller than all others; rows of one id with different texts are
    ordered by a hash of the text, and equal rows are one document that is not compared with itself; an empty table gives no
    rows. Other columns are not read.

    1. Each window's anchor (the gram with the least hash) deals windows out by content. Anchors whose hash occurs once have no
       repeated window; where anchors of one hash have the same whole context, all but the first are repeated in full. That is
       told in each run of texts first, so that of a common passage a run sends one anchor for each different context to the
       hash's bucket, and the others to their documents.
    2. The other anchors' contexts, one for each different context, are sent to their hash's bucket, where a Burrows-Wheeler
       transform of all contexts gives the classes of equal windows; all but the first of a class are repeated.
    3. What is repeated is sent to its document and cut out there.
    A hash with over `hot` contexts is dealt further by blocks of windows and the bytes that those have in common; contexts that
    are then equal are sent once from each bucket of documents.
    """
    if length < GRAM + 1 or length - GRAM + 1 > 1 << 16:
        raise ValueError("length must be over 32 bytes")
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    whole, more = handed_on(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *handed(carry)))
    n = part_count(docs)
    twice = own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0

    def identity(ids: pa.Array, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        doc = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        return doc, np.fromiter((xxhash.xxh64_intdigest(t) >> 1 for t in texts), np.int64, len(texts)) if twice else np.zeros(len(texts), np.int64)

    def scan(batches):
        for b in parts(batches, 1, 1 << 23):
            texts = [t or b"" for t in as_bytes(b.column(1))]
            doc, th = identity(b.column(0), texts)
            for first, group in text_groups(texts, 1 << 23):
                no, pos, key, ctx, back, fore = find_anchors(group, length, part)
                no += first
                lead, late = firsts(doc[no], th[no], pos, key, ctx)
                rows = [(to, pack(doc[i], th[i], p.astype(np.int32), k, c, x.astype(np.uint16), y.astype(np.uint16))) for to, i, p, k, c, x, y in dealt((key[lead] % np.uint64(n)).astype(np.int32), no[lead], pos[lead], key[lead], ctx[lead], back[lead], fore[lead])]
                d = doc[no[late]]
                rows += [(n + to, pack(*x)) for to, *x in dealt(spread(d, n), d, th[no[late]], pos[late].astype(np.int32), back[late].astype(np.uint16), fore[late].astype(np.uint16), key[late], np.zeros(len(late), np.int8))]
                if rows:
                    yield cells(rows).to_batches()[0]

    def classify(t: pa.Table) -> pa.Table:
        trim()
        if (to := t.column("to")[0].as_py()) >= n:  # settled where they were found
            return t.set_column(0, "to", pa.array(np.full(len(t), to - n, np.int32)))
        doc, th, pos, key, ctx, back, fore = joined(t.column("payload").to_pylist())
        order, new_key, new_ctx = classes(doc, th, pos, key, ctx)
        k = np.cumsum(new_key) - 1
        kinds = np.bincount(k[new_ctx], minlength=1)[k]
        full, some = order[~new_ctx], order[new_ctx & (kinds > 1)]
        many = (kinds > hot)[new_ctx & (kinds > 1)]
        both = np.concatenate([full, some])
        what = np.concatenate([np.zeros(len(full), np.int8), np.where(many, 2, 1).astype(np.int8)])
        d = doc[both]
        return cells([(to, pack(*x)) for to, *x in dealt(spread(d, n), d, th[both], pos[both], back[both], fore[both], key[both], what)])

    def finished(text: bytes, lo, hi):
        removed, spans, kept = cut_out(text, lo, hi, length)
        if keep == "digest":
            kept = hashlib.sha256(kept).hexdigest().encode()
        elif keep == "text" and removed:
            kept = kept.decode("utf-8", "ignore").encode()
        return len(text), removed, spans, kept

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents of a bucket with what is known of their anchors: settled rows, rows that wait, contexts to compare."""
        trim()
        out = {c: [] for c in ("kind", "id", "to", "payload", "n_bytes", "n_removed", "n_spans", "kept")}

        of: list[int | None] = []  # the row of left that each row is about

        def put(i: int | None = None, **row) -> None:
            of.append(i)
            for c, x in out.items():
                x.append(row.get(c))

        ids, texts = left.column("id").combine_chunks(), [t or b"" for t in as_bytes(left.column("text"))]
        docs_, ths = identity(ids, texts)
        here = int(left.column("to")[0].as_py()) if len(left) else 0
        doc, th, pos, back, fore, key, what = joined(right.column("payload").to_pylist()) if len(right) else [np.empty(0, np.int64)] * 7
        pos, back, fore = (x.astype(np.int64) for x in (pos, back, fore))
        by = np.lexsort((th, doc))
        doc, th, pos, back, fore, key, what = (x[by] for x in (doc, th, pos, back, fore, key, what))
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(th) != 0)) + 1
        at = {(int(doc[i]), int(th[i])): (i, j) for i, j in zip(np.concatenate([[0], cut]).tolist(), [*cut.tolist(), len(doc)], strict=True)} if len(doc) else {}
        text_of = dict(zip(zip(docs_.tolist(), ths.tolist(), strict=True), texts, strict=True))
        sent, local, seen = [], {}, {}
        for name, (i, j) in at.items():
            t = text_of[name]
            for m in (np.flatnonzero(what[i:j]) + i).tolist():
                p, lo, hi = int(pos[m]), int(pos[m] - back[m]), int(pos[m] - fore[m])
                if what[m] == 1:
                    sent.append((int(key[m]), *name, lo, t[lo : hi + length]))
                    continue
                for f in range((p - hi) // BLOCK, (p - lo) // BLOCK + 1):  # hot: blocks of windows at fixed distances before the anchor
                    x, y = max(lo, p - (f + 1) * BLOCK + 1), min(hi, p - f * BLOCK)
                    c0, c1 = p - f * BLOCK, p - (f + 1) * BLOCK + 1 + length  # bytes that all windows of the block have in common
                    piece = t[x : y + length]
                    group = xxhash.xxh64_intdigest(t[c0:c1], int(key[m]) + f & (1 << 64) - 1)
                    old = seen.get((group, p - x, piece))
                    if old is None or (*name, x) < old:
                        seen[group, p - x, piece] = (*name, x)
                    late = max((*name, x), old) if old else None
                    if late:
                        local.setdefault(late[:2], []).append((late[2], late[2] + y - x))
        sent += [(g, d, h, x, piece) for (g, _, piece), (d, h, x) in seen.items()]
        if sent:
            g = np.array([s[0] for s in sent], np.uint64)
            cols = [np.array([s[k] for s in sent], np.int64) for k in (1, 2, 3)]
            raw = np.array([s[4] for s in sent], object)
            for to, x, *rest, pieces in dealt((mix64(g) % np.uint64(n)).astype(np.int32), g, *cols, raw):
                put(kind=2, to=to, payload=pack(x, *rest, np.array([len(s) for s in pieces], np.int64), np.frombuffer(b"".join(pieces), np.uint8)))
        waits = {s[1:3] for s in sent}
        for i, t in enumerate(texts):
            name = (int(docs_[i]), int(ths[i]))
            a, b = at.get(name, (0, 0))
            full = np.flatnonzero(what[a:b] == 0) + a
            more = np.array(local.get(name, []), np.int64).reshape(-1, 2)
            lo, hi = np.concatenate([pos[full] - back[full], more[:, 0]]), np.concatenate([pos[full] - fore[full], more[:, 1]])
            if name in waits:
                put(i, kind=1, id=ids[i].as_py(), to=here, payload=pack(lo, hi), kept=t)
            else:
                size, removed, spans, kept = finished(t, lo, hi)
                put(i, kind=0, id=ids[i].as_py(), n_bytes=size, n_removed=removed, n_spans=spans, kept=kept)
        kinds = {"kind": pa.int32(), "id": pa.int64(), "to": pa.int32(), "payload": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        rest = {"carry": left.column("carry").combine_chunks().take(pa.array(of, pa.int64()))} if carry else {}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()} | rest)

    def compare(t: pa.Table) -> pa.Table:
        trim()
        group, doc, th, start, size, text = joined(t.column("payload").to_pylist())
        doc, th, lo, hi = resolve(group, doc, th, start, size, text.tobytes(), length, transform)
        return cells([(to, pack(*x)) for to, *x in dealt(spread(doc, n), doc, th, lo, hi)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        texts = left.column("kept").to_pylist()
        docs_, ths = identity(left.column("id").combine_chunks(), texts)
        doc, th, lo, hi = joined(right.column("payload").to_pylist()) if len(right) else [np.empty(0, np.int64)] * 4
        by = np.lexsort((th, doc))
        doc, th, lo, hi = (x[by] for x in (doc, th, lo, hi))
        out = []
        for d, h, t, known in zip(docs_.tolist(), ths.tolist(), texts, left.column("payload").to_pylist(), strict=True):
            a, b = np.searchsorted(doc, [d, d + 1]) if d < (1 << 63) - 1 else (np.searchsorted(doc, d), len(doc))
            mine = np.flatnonzero(th[a:b] == h) + a
            more = unpack(known)
            out.append(finished(t, np.concatenate([more[0], lo[mine]]), np.concatenate([more[1], hi[mine]])))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({"id": left.column("id"), **{c: pa.array(list(x), pa.binary() if c == "kept" else pa.int64()) for c, x in zip(("n_bytes", "n_removed", "n_spans", "kept"), cols, strict=True)}, **({"carry": left.column("carry")} if carry else {})})

    kept_on = ["carry"] if carry else []
    known = own.mapInArrow(scan, CELLS).groupBy("to").applyInArrow(classify, CELLS)
    dealt_docs = whole.withColumn("to", place(F.coalesce("id", F.lit(NULL_ID)), n))
    state = written(dealt_docs.groupBy("to").cogroup(known.groupBy("to")).applyInArrow(settle, f"kind int, id bigint, {CELLS}, {DONE}{more}"))
    marks = state.where("kind = 2").select("to", "payload").groupBy("to").applyInArrow(compare, CELLS)
    late = state.where("kind = 1").select("to", "id", "payload", "kept", *kept_on).groupBy("to").cogroup(marks.groupBy("to")).applyInArrow(finish, f"id bigint, {DONE}{more}")
    done = state.where("kind = 0").select("id", "n_bytes", "n_removed", "n_spans", "kept", *kept_on)
    return done.unionByName(late).withColumnRenamed("id", id_col)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dedup_substrings(table(spark, sf_dir, "documents"), keep="digest")
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
