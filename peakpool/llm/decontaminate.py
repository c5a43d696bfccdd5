"""Benchmark decontamination by a generalised suffix automaton of the items' words."""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.llm.common import as_bytes, handed, handed_on, parts, table, trim

#: Bytes that are part of a word: digits, A-Z (lower-cased), a-z and all of non-ASCII characters; others become a space.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of text in one automaton, but for an item that is longer by itself; an automaton takes about 130 bytes of memory for
#: each of them. A larger benchmark has several, of which a task holds one at a time.
AUTOMATON_BYTES = 2 << 20
#: The benchmark's texts pass through the driver: more is refused.
MAX_BENCHMARK_BYTES = 256 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Automaton:
    """A generalised suffix automaton over word numbers, with the items that own each window of `window` words."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = 8):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        texts: dict[tuple[int, ...], set[str]] = {}
        for key, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text))
            if ids:
                texts.setdefault(ids, set()).add(key)
        for ids in texts:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        owners: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        for ids, keys in texts.items():
            for state, n, i in self.scan(ids, 0):
                if n >= window:
                    owners.setdefault(self.up_to(state, window), set()).update(keys)
                elif n == len(ids) == i + 1:
                    short.setdefault(self.up_to(state, n), {}).setdefault(n, set()).update(keys)
        self.owners = {s: frozenset(k) for s, k in owners.items()}
        self.least = min([window, *(n for x in short.values() for n in x)], default=window)
        #: For each state the short items that end there, its own and its suffixes', as (words, items).
        self.short: dict[int, list[tuple[int, frozenset[str]]]] = {}
        if short:
            for s in sorted(range(1, len(self.link)), key=self.len.__getitem__):
                found = [(n, frozenset(k)) for n, k in short.get(s, {}).items()] + self.short.get(self.link[s], [])
                if found:
                    self.short[s] = found

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def up_to(self, state: int, n: int) -> int:
        """The state of the last n words, of a longer match that ends in state."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, ids, start: int):
        """(state, longest match that ends here, position) for each word."""
        nxt, link, length = self.next, self.link, self.len
        state, n = 0, 0
        for i, c in enumerate(ids, start):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if (to := nxt[state].get(c)) is not None:
                state, n = to, n + 1
            else:
                state, n = 0, 0
            yield state, n, i

    def match(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, the runs [from, to) of hit words, and the items with an occurring window."""
        w = words_of(text)
        ids = np.fromiter(map(self.vocab.get, w, repeat(-1)), np.int64, len(w))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        spans, items = [], set()
        for lo, hi in edge.reshape(-1, 2):
            if hi - lo < self.least:  # no window fits between words that no item has
                continue
            for state, n, i in self.scan(ids[lo:hi].tolist(), int(lo)):
                most = 0
                if n >= self.window:
                    most = self.window
                    items |= self.owners[self.up_to(state, most)]
                for m, keys in self.short.get(state, ()):
                    if m <= n:
                        most = max(most, m)
                        items |= keys
                if most:
                    if spans and spans[-1][1] >= i + 1 - most:
                        while spans and spans[-1][1] >= i + 1 - most:
                            most = max(most, i + 1 - spans.pop()[0])
                    spans.append((i + 1 - most, i + 1))
        return len(w), spans, items


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, from the start of a span's first word to the start of the next kept word."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for lo, hi in spans:
        out.append(text[last : at[lo][0]])
        last = at[hi][0] if hi < len(at) else at[hi - 1][1]
    return b"".join([*out, text[last:]])


def merged(found: list[tuple[int, list[tuple[int, int]], set[str]]]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """match() of several automata as one: runs that overlap or meet become one."""
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted(s for _, own, _ in found for s in own):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], hi))
        else:
            spans.append((lo, hi))
    return found[0][0], spans, set().union(*(items for _, _, items in found))


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 8, most: int = AUTOMATON_BYTES) -> list:
    """The benchmark's automata, each of items with `most` bytes of text, broadcast one by one."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; at most {MAX_BENCHMARK_BYTES} can be broadcast")
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).distinct().collect()
    items = sorted((r[0], bytes(r[1]) if r[1] is not None else b"") for r in rows)
    out, part, size = [], [], 0
    for item in items:
        if part and size + len(item[1]) > most:
            out.append(spark.sparkContext.broadcast(Automaton(part, window)))
            part, size = [], 0
        part.append(item)
        size += len(item[1])
    return [*out, spark.sparkContext.broadcast(Automaton(part, window))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 8, min_items: int = 2, max_coverage: float = 0.5, carry: list[str] | None = None, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (sorted item ids as text), contaminated, drop, cleaned_text; carry:
    columns to be handed on in a struct `carry`.

    A window is `window` consecutive words of an item, or a shorter item's all words; a document's word inside any occurrence
    of a window is hit. contaminated: windows of min_items items or more occur. cleaned_text is the text without hit words;
    drop says that the text is contaminated or that over max_coverage of its words are hit. Null and empty texts have no
    words (cleaned_text keeps a null), items that are null or have a null id have no windows, repeated rows are judged alike,
    very long texts are searched whole, empty tables give no rows or no hits. Other columns of docs are not read. One pass over docs, no shuffle.
    """
    shared = automata(benchmark, item_col, text_col, window, automaton_bytes)

    def matches(texts):
        """match() of each text. Of several automata one is read at a time, and none is kept."""
        if len(shared) == 1:
            return map(shared[0].value.match, texts)
        found = [[] for _ in texts]
        for s in shared:
            a = s.load_from_path(s._path) if s._path else s.value
            for own, t in zip(found, texts, strict=True):
                own.append(a.match(t))
            del a
            trim()
        return map(merged, found)

    def run(batches):
        for b in parts(batches, 1, 4 << 20 if len(shared) == 1 else 32 << 20):
            ids, out, texts = b.column(0), [], as_bytes(b.column(1))
            for t, (n, spans, items) in zip(texts, matches(texts), strict=True):
                hit = sum(hi - lo for lo, hi in spans)
                out.append((n, hit, sorted(items), len(items) >= min_items, len(items) >= min_items or hit > max_coverage * n, without(t, spans) if spans else t))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.binary()]
            arrays = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *arrays[:5], arrays[5].cast(pa.string()), *b.columns[2:]], [id_col, "n_words", "n_hit", "items", "contaminated", "drop", "cleaned_text", *b.schema.names[2:]])

    kind = docs.schema[id_col].dataType.simpleString()
    own, more = handed_on(docs.select(id_col, text_col, *handed(carry)))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_hit bigint, items array<string>, contaminated boolean, drop boolean, cleaned_text string{more}")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def item_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
