"""Near-duplicates by the exact Jaccard similarity of word shingles: a vantage-point tree over SimHash fingerprints and MinHash
bands propose pairs, the whole sets confirm them."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakpool.llm.common import as_bytes, mix64, parts, trim, written
from peakpool.llm.components import components
from peakpool.llm.simhash import links, majority

#: Fingerprints that differ in so many bits at most are near for the tree.
RADIUS = 3
#: Two sets of similarity s share no band with a probability of (1 - s^ROWS)^BANDS: 1.2e-7 at 0.8, 2e-13 at 0.88.
BANDS, ROWS = 40, 5
FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
PLACES = mix64(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles of a text, hashed and sorted: A-Z lower-cased, ASCII white space splits words, XXH64 (seed 42).
    Fewer words: one shingle; none or null: no shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < shingle else list(map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64, len(grams)))


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of ROWS minima of the set under different multiplications."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, (FACTORS[:, None] * s[None, at : at + 2048]).min(axis=1), out=low)
    return mix64((mix64(low).reshape(BANDS, ROWS) * PLACES).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sorted sets' common part is at least least[0] / least[1] of their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least[1] >= (len(a) + len(b) - both) * least[0]


def measured(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, told: hash of the text, node: hash of its set of shingles, 0 if empty, n of the set, fp: the set's SimHash
    fingerprint, keys: its bands)."""

    def run(batches):
        for b in parts(batches, 1):
            sets = [shingles(t, shingle) for t in as_bytes(b.column(1))]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64)
            keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.empty(0, np.uint64)
            n = np.fromiter(map(len, sets), np.int32, len(sets))
            fp = np.array([majority(s) for s in sets], np.uint64)
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node.view(np.int64)), pa.array(n), pa.array(fp.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64)))], [id_col, "told", "node", "n", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("told")).mapInArrow(run, f"`{id_col}` {kind}, told bigint, node bigint, n int, fp bigint, keys array<bigint>")


def near_fingerprints(rows: DataFrame) -> DataFrame:
    """(key, node, n): nodes whose fingerprints are alike or stand in one star of the tree's links share a key. Any two at RADIUS
    bits or fewer do, as the shard in which they meet joins them to one smallest fingerprint."""
    nodes = rows.where("n > 0").select("node", "n", "fp").distinct()
    stars = links(written(nodes.select("fp").distinct()), RADIUS).distinct()
    keys = stars.select(F.col("u").alias("fp"), F.col("v").alias("key")).union(nodes.select("fp", F.col("fp").alias("key")).distinct())
    return nodes.join(written(keys), "fp").select(F.xxhash64("key").alias("key"), "node", "n")


def contents(nodes: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, content, bands) of some nodes: their sets and band keys, made again from one text of each node."""

    def sets(batches):
        for b in parts(batches, 1):
            made = [shingles(t, shingle) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in made], pa.binary()), pa.array([band_keys(s).tobytes() for s in made], pa.binary())], ["node", "content", "bands"])

    one = rows.select("node", "told").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("told").alias("told"))
    texts = docs.select(F.xxhash64(text_col).alias("told"), F.col(text_col).alias("text")).join(one, "told").dropDuplicates(["node"])
    return written(texts.select("node", "text").mapInArrow(sets, "node bigint, content binary, bands binary"))


def confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets are similar."""

    def check(batches):
        trim()
        for b in batches:
            a, c = (map(partial(np.frombuffer, dtype=np.uint64), b.column(i).to_pylist()) for i in (2, 3))
            good = np.fromiter((similar(x, y, least) for x, y in zip(a, c, strict=True)), bool, b.num_rows)
            yield b.select(["u", "v"]).filter(pa.array(good))
        trim()

    content = contents(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), rows, docs, text_col, shingle)
    both = pairs.join(content.select(F.col("node").alias("u"), F.col("content").alias("a")), "u").join(content.select(F.col("node").alias("v"), F.col("content").alias("b")), "v")
    return written(both.select("u", "v", "a", "b").mapInArrow(check, "u bigint, v bigint"))


def between(node: np.ndarray, root: np.ndarray, side: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join just those nodes of two blocks that similar pairs with a band in common, or with fingerprints at RADIUS
    bits or fewer, connect; of one block, if side is the same for all. Nodes of one root are connected already."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    left = np.flatnonzero(side == side.min()) if len(side) else side
    right = np.flatnonzero(side == side.max()) if len(side) else side
    size, out = np.fromiter(map(len, sets), np.int64, len(sets)), []
    fp = np.fromiter(map(majority, sets), np.uint64, len(sets))
    for at in range(0, len(left), 32):
        a = left[at : at + 32]
        fits = np.minimum(size[a][:, None], size[right][None, :]) * least[1] >= np.maximum(size[a][:, None], size[right][None, :]) * least[0]
        near = (bands[a][:, None, :] == bands[right][None, :, :]).any(axis=2) | (np.bitwise_count(fp[a][:, None] ^ fp[right][None, :]) <= RADIUS)
        fits &= (root[a][:, None] != root[right][None, :]) & near
        for i, j in zip(*np.nonzero(fits), strict=True):
            x, y = int(a[i]), int(right[j])
            u, v = find(int(root[x])), find(int(root[y]))
            if u != v and similar(sets[x], sets[y], least):
                up[max(u, v)] = min(u, v)
                out.append((int(node[x]), int(node[y])))
    return out


def apart_links(apart: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int, least: tuple[int, int], block: int) -> DataFrame:
    """(u, v): links between nodes (key, node, root) that share a key but no root. Nodes that keys connect form a family; a
    family is cut into blocks, and each two blocks are searched by a group of their own, which sends links that span what it has
    connected and never the pairs. So a node is sent as often as its family has blocks."""
    first = apart.groupBy("key").agg(F.min("node").alias("u"))
    family = components(apart.join(first, "key").select("u", F.col("node").alias("v"))).select("node", F.col("root").alias("family"))
    size = family.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("m"))
    nodes = written(apart.select("node", "root").distinct().join(family, "node").join(size, "family"))
    own = nodes.withColumn("side", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).join(contents(nodes.select("node"), rows, docs, text_col, shingle), "node")
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})

    def search(t: pa.Table) -> pa.Table:
        trim()
        if t.column("i")[0].as_py() != t.column("j")[0].as_py() and len(pc.unique(t.column("side"))) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        bands = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.uint64).reshape(-1, BANDS)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("content").to_pylist()]
        found = between(t.column("node").to_numpy(), t.column("root").to_numpy(), t.column("side").to_numpy(), bands, sets, least)
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    return written(spread.select("family", "i", "j", "side", "node", "root", "bands", "content").groupBy("family", "i", "j").applyInArrow(search, "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: tuple[int, int] = (4, 5), block: int = 500) -> DataFrame:
    """(id, component_id) for every row of docs: texts whose sets of shingles have a Jaccard similarity of least[0] / least[1]
    or more are linked, and component_id is the smallest id reachable.

    Texts with one set of shingles are one node, so copies cost nothing after the first aggregation. Nodes whose fingerprints
    op5's vantage-point tree links, at RADIUS bits or fewer, share a key; so do nodes with a MinHash band in common,
    for the similar ones that lie further apart. Nodes that share a key are candidates, and a link is a candidate pair whose
    whole sets are similar. First each key's nodes are held against the key's smallest node; then, in blocks of `block` nodes, all candidates that this has left in different components are, so
    that a large group costs about its size, no pair is sent and none is passed over. Very long texts are read whole. Null and wordless texts have the empty set and are linked with each other only; a
    null id keeps its row and is no component's name unless all its ids are null; repeated rows give repeated rows; an empty
    table gives none. Other columns of docs are not read.
    """
    rows = written(measured(docs, id_col, text_col, shingle))
    band = Window.partitionBy("key")
    keyed = rows.where("n > 0").select(F.explode("keys").alias("key"), "node", "n").union(near_fingerprints(rows))
    keyed = keyed.withColumns({"low": F.min(F.struct("node", "n")).over(band), "high": F.max("node").over(band)}).where("low.node < high")
    groups = written(keyed.select("key", "node", "n", "low").distinct())
    near = lambda a, b: (F.least(a, b) * F.lit(least[1]) >= F.greatest(a, b) * F.lit(least[0]))
    star = written(groups.where("node <> low.node").where(near(F.col("n"), F.col("low.n"))).select(F.col("low.node").alias("u"), F.col("node").alias("v")).distinct())
    edges = confirmed(star, rows, docs, text_col, shingle, least)

    root = components(edges)
    apart = groups.select("key", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).select("key", "node", "root")
    apart = written(apart.withColumns({"r": F.min("root").over(band), "s": F.max("root").over(band)}).where("r < s").drop("r", "s"))
    more = apart_links(apart, rows, docs, text_col, shingle, least, block)

    root = components(edges.union(more))
    nodes = rows.groupBy("node").agg(F.min(id_col).alias("first_id"))
    named = written(nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select(id_col, "node").join(named.join(first, "root").select("node", "component_id"), "node").select(id_col, "component_id")
