"""BPE encoding and decoding with a pair occurrence index, for the tokenizer files of the tokenizers library."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from peakpool.llm.common import as_bytes, parts, table

#: A worker forgets the pieces that it has encoded when it holds so many; bounds its memory, not its results.
MAX_PIECES = 300_000
#: Below this character, letters and numbers are the same in all versions of Unicode in use.
LATIN_END = "\u0250"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the others are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [rest.get(b, chr(b)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file: NFC, white space, lower case; a split pattern; byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        steps = [x["type"] for x in j["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing BPE tokenizer with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | special).items()}
        self.special = special
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
        self.pattern = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], regex.V0)
        letters = byte_letters()
        self.path, self.byte_of = path, {c: b for b, c in enumerate(letters)}
        self.first = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int64)
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.parts = keys
        self.word_ids: dict[bytes, bytes] = {}
        self.ids: dict[bytes, bytes] = {}
        self.text: dict[bytes, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word, all words together: an index holds, for each pair, all its positions; the active ranks are
        taken in ascending order, and each merge updates the lists of the pairs beside it. Entries that earlier merges have
        made stale are told by their symbols and passed over."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = int(size.sum())
        if not n:
            return [np.empty(0, np.int64) for _ in words]
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        sym = self.first[raw]
        sym[ends[size > 0] - 1] = self.last[raw[ends[size > 0] - 1]]
        left, right = np.arange(n) - 1, np.arange(n) + 1
        right[ends[size > 0] - 1] = -1
        left[(ends - size)[size > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            r = self.rank(sym[at], sym[right[at]])
            at, r = at[r >= 0], r[r >= 0]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            for k, x in zip(r[np.concatenate([[0], cut])].tolist() if len(r) else [], np.split(at, cut), strict=False):
                if k not in index:
                    index[k] = []
                    heapq.heappush(active, k)
                index[k].append(x)

        enter(np.flatnonzero(right >= 0))
        while active:
            k = heapq.heappop(active)
            at = index.pop(k)
            at = np.sort(at[0]) if len(at) == 1 else np.unique(np.concatenate(at))
            a, b = int(self.parts[k]) >> 32, int(self.parts[k]) & 0xFFFFFFFF
            at = at[alive[at] & (sym[at] == a) & (right[at] >= 0)]
            at = at[sym[right[at]] == b]
            if a == b and len(at) > 1:  # a run of one symbol merges from the left, each position once
                taken, keep = -1, []
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = int(right[p])
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = right[at]
            sym[at] = self.made[k]
            alive[gone] = False
            right[at] = after = right[gone]
            left[after[after >= 0]] = at[after >= 0]
            before = left[at]
            enter(np.unique(np.concatenate([at[after >= 0], before[before >= 0]])))
        kept = np.concatenate([[0], np.cumsum(alive)])
        out = sym[alive]
        return np.split(out, kept[ends[:-1]])

    def pieces(self, chunk: bytes) -> list:
        """A chunk without ASCII white space as special ids and the UTF-8 bytes of words."""
        text = chunk.decode("utf-8", "replace")
        out: list = []
        for part in self.special_split.split(text) if self.special_split and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii() or max(part) < LATIN_END:
                out.extend(x.encode() for x in self.pattern.findall(unicodedata.normalize("NFC", part).lower()))
            else:  # by the library's own tables, as Unicode versions differ in which characters are letters
                rules = library(self.path)
                out.extend(bytes(map(self.byte_of.__getitem__, x)) for x, _ in rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(part)))
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Encodes the chunks that are not known yet."""
        if len(self.ids) + len(self.word_ids) > MAX_PIECES:
            for d in (self.ids, self.text, self.word_ids):
                d.clear()
        new = [c for c in chunks if c not in self.ids]
        parts = [self.pieces(c) for c in new]
        words = list({w for p in parts for w in p if isinstance(w, bytes) and w not in self.word_ids})
        self.word_ids.update((w, x.astype("<u4").tobytes()) for w, x in zip(words, self.merge(words), strict=True))
        for c, p in zip(new, parts, strict=True):
            self.ids[c] = ids = b"".join(self.word_ids[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in p)
            self.text[c] = " ".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids))).encode()

    def encode(self, texts: list[bytes | None], step: int = 1 << 22):
        """(ids as little-endian unsigned 32-bit integers, decoded text as UTF-8) of each text. Texts are taken in groups of
        about `step` bytes, so that what is held follows the group and not the batch."""
        for group in groups(texts, step):
            split = [(t or b"").split() for t in group]
            self.learn(set().union(*split))
            for chunks in split:
                yield b"".join(map(self.ids.__getitem__, chunks)), b" ".join(filter(None, map(self.text.__getitem__, chunks)))

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def groups(texts: list[bytes | None], step: int):
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or b"")
        if size >= step:
            yield group
            group, size = [], 0
    if group:
        yield group


@cache
def library(path: str) -> Tokenizer:
    """The library's tokenizer, for its normaliser and pre-tokenizer."""
    return Tokenizer.from_file(path)


@cache
def load(path: str) -> Bpe:
    """One encoder for each worker and file."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, then ids (array<int>) and/or ids_sha256 and decoded_sha256.

    path: the tokenizer file, at the same place on every machine. Null and empty texts have no tokens; special tokens' strings
    in a text are special tokens; repeated rows are encoded alike; an empty table gives no rows. Other columns of docs are not
    read. One pass, no shuffle; a worker's memory is bounded by MAX_PIECES and one Arrow batch.
    """

    def run(batches):
        bpe = load(path)
        for b in parts(batches, 1):
            out = list(zip(*bpe.encode(as_bytes(b.column(1))), strict=True)) or [(), ()]
            cols = {id_col: b.column(0), "n_tokens": pa.array([len(x) // 4 for x in out[0]], pa.int64())}
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(out[0]), "<i4"), pa.int32())
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in out[0])]), pa.int32()), flat)
            if digests:
                cols["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in out[0]], pa.string())
                cols["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in out[1]], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of rows with an array of token ids; null arrays give null, empty ones an empty text."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()], pa.string())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, digests=True)
