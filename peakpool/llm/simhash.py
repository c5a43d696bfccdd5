"""SimHash fingerprints and exact near-duplicate links by vantage-point trees over Hamming distance."""

from __future__ import annotations

from functools import partial
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.llm.common import as_bytes, parts, table, written
from peakpool.llm.components import components

#: The vantage point of every level: a fixed, balanced bit pattern.
VANTAGE = 0x9E3779B97F4A7C15


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, ASCII white space splits words, XXH64 (seed 42) of each shingle,
    a bit set if over half of the shingles (repeats included) set it. Fewer words: one shingle; none or null: 0."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < shingle else list(map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)))
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64, len(grams)))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for every row of docs, one pass and no shuffle."""

    def run(batches):
        for b in parts(batches, 1):
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def blocks(levels: int) -> list[int]:
    """Masks that cut the 64 bits into so many runs; a level's metric is the Hamming distance within its run."""
    cut = [round(64 * i / levels) for i in range(levels + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]


def distances(fp: np.ndarray, masks: list[int]) -> np.ndarray:
    return np.stack([np.bitwise_count((fp ^ np.uint64(VANTAGE)) & np.uint64(m)) for m in masks], axis=1).astype(np.int16)


def levels_for(n: int, cell_points: int) -> int:
    """The least number of top levels, two or more, at which the fullest shard of n evenly spread fingerprints has cell_points
    at most. One level would deal all into some twenty shards only."""
    for levels in (2, 3, 4, 6):
        width = 64 // levels
        if n * (comb(width, width // 2) / 2**width) ** levels <= cell_points:
            return levels
    return 8


def boundary_steps(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Steps between shards that may hold two linked fingerprints: by the triangle bound the levels' distances to the
    vantage point differ by radius at most in sum. Of each step and its reverse one is kept."""
    return [s for s in product(range(-radius, radius + 1), repeat=levels) if sum(map(abs, s)) <= radius and s > (0,) * levels] if levels <= 4 else _steps(levels, radius)


def _steps(levels: int, radius: int) -> list[tuple[int, ...]]:
    out = [()]
    for _ in range(levels):
        out = [s + (d,) for s in out for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in out if s > (0,) * levels]


class Forest:
    """Union-find over positions, in numpy."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                flat = self.up[self.up]
                if (flat == self.up).all():
                    break
                self.up = flat


def link(fp: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest, radius: int, level: int = 0, rest: int | None = None, masks: list[int] | None = None) -> None:
    """Joins in forest all fp[left] and fp[right] at Hamming distance radius or less: a vantage-point tree whose level
    splits both sides by their distance to the vantage point within one run of bits, and visits only the branches that the
    triangle bounds of all levels so far allow."""
    rest, masks = radius if rest is None else rest, masks or blocks(8)
    if not len(left) or not len(right):
        return
    if len(left) * len(right) <= 1 << 20 or level == len(masks):
        rows = max(1, (1 << 20) // len(right))
        for at in range(0, len(left), rows):
            i, j = np.nonzero(np.bitwise_count(fp[left[at : at + rows], None] ^ fp[right][None, :]) <= radius)
            forest.join(left[at + i], right[j])
        return
    a, b = (distances(fp[x], masks[level : level + 1])[:, 0] for x in (left, right))
    sides = [{d: x[y == d] for d in np.unique(y)} for x, y in ((left, a), (right, b))]
    for d, x in sides[0].items():
        for e, y in sides[1].items():
            if abs(int(d) - int(e)) <= rest:
                link(fp, x, y, forest, radius, level + 1, rest - abs(int(d) - int(e)), masks)


def links(fps: DataFrame, radius: int = 3, cell_points: int = 100_000) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect just those that are linked by steps of radius or less.

    The top levels of the tree deal fingerprints into shards by their distances to the vantage point; each also visits the
    shards that its radius overlaps, in one direction. In a shard a tree finds all pairs and sends a spanning star for each
    connected group, never the pairs themselves. The number of levels follows the number of fingerprints.
    """
    levels = levels_for(fps.count(), cell_points)
    masks, steps = blocks(levels), np.array(boundary_steps(levels, radius), np.int16).reshape(-1, levels)
    code = np.array([65**i for i in range(levels)], np.int64)

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, size = distances(fp, masks), np.array([m.bit_count() for m in masks])
            for lo in range(0, len(fp), 2048):
                own, f = at[lo : lo + 2048], fp[lo : lo + 2048]
                to = own[:, None, :] + steps[None, :, :]
                i, j = np.nonzero(((to >= 0) & (to <= size)).all(axis=2))
                cell = np.concatenate([own @ code, to[i, j] @ code])
                home = np.concatenate([np.ones(len(f), bool), np.zeros(len(i), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([f, f[i]]).view(np.int64)), pa.array(home)], ["cell", "fp", "home"])

    def search(t: pa.Table) -> pa.Table:
        fp, home = t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy(zero_copy_only=False)
        forest, at, guests = Forest(len(fp)), np.flatnonzero(home), np.flatnonzero(~home)
        link(fp, at, at, forest, radius)
        link(fp, guests, at, forest, radius)
        low = np.flatnonzero(forest.up != np.arange(len(fp)))
        return pa.table({"u": fp[low].view(np.int64), "v": fp[forest.up[low]].view(np.int64)})

    return fps.select("fp").mapInArrow(deal, "cell bigint, fp bigint, home boolean").groupBy("cell").applyInArrow(search, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp long, component_id) for every row of docs: fingerprints at radius or fewer differing bits are linked, and
    component_id is the smallest id reachable.

    Rows of one fingerprint are one node, so copies cost nothing after the first aggregation. Null and wordless texts have
    fingerprint 0 and are linked like others; a null id keeps its row and is no component's name unless all its ids are null;
    repeated rows give repeated rows; an empty table gives none. Other columns of docs are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle))
    nodes = written(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    root = components(links(nodes, radius))
    named = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(id_col, "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
