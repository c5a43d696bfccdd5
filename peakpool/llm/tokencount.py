"""Tokens of each document in flat, unindexed token files, by a scan for the end-of-document identifier."""

from __future__ import annotations

import base64
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakpool.llm.common import as_bytes, parts, shared_dir, table, written

#: Tokens are 16-bit; byte_bpe_50k leaves this identifier free.
END = 50256
WIDTH = 2
#: Bytes of one block, and of a file before the next is begun.
BLOCK_BYTES = 4 << 20
FILE_BYTES = 64 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all texts' tokens, each text's followed by END, as 16-bit numbers into files without an index under `path`, a
    folder that all machines share. Gives the manifest (file, ordinal, id), which tells whose the n-th text of a file is.

    A file's name holds the attempt that wrote it; only files of the manifest count, so a task that is run again leaves at
    most a file that nobody reads. Null and empty texts have no tokens and an END. No shuffle.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        code = encoder(vocabulary)
        task = TaskContext.get()
        name, out, size, ordinal, number = "", None, 0, 0, 0
        for b in parts(batches, 1):
            names, places = [], []
            for t in as_bytes(b.column(1)):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{task.partitionId()}-{task.taskAttemptId()}-{number}-{uuid.uuid4().hex}.tokens"
                    out, size, ordinal, number = store.open_output_stream(f"{root}/{name}"), 0, 0, number + 1
                ids = np.array([*code.encode_ordinary((t or b"").decode("utf-8", "replace")), END], "<u2").tobytes()
                out.write(ids)
                size += len(ids)
                names.append(name)
                places.append(ordinal)
                ordinal += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), b.column(0)], ["file", "ordinal", id_col])
        if out is not None:
            out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(id_col, text_col).mapInArrow(run, f"file string, ordinal bigint, `{id_col}` {kind}"))


def scan_block(x: np.ndarray, end: int) -> tuple[int, int, int, list[int]]:
    """Of a block of tokens: separators, tokens before the first (all, if none), tokens after the last, and the tokens
    between neighbouring ones."""
    at = np.flatnonzero(x == end)
    if not len(at):
        return 0, len(x), len(x), []
    return len(at), int(at[0]), len(x) - 1 - int(at[-1]), (np.diff(at) - 1).tolist()


def count_tokens(files: DataFrame, path: str, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of each document in the token files named by column `file`, which lie under `path`.

    Files are cut into blocks, which tasks read and search each by itself; a prefix scan over the blocks' summaries then gives
    each block the ordinal of its first separator and the tokens carried into it, so that documents may begin, end or span
    anywhere. `ended` is false for tokens after a file's last separator. A separator gives a document of no tokens where
    another stands before it; empty files give no rows; files named twice are counted once; a file whose size isn't a
    multiple of `width` bytes raises.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    block_bytes -= block_bytes % width

    def sizes(batches):
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            size = [store.get_file_info(f"{root}/{f}").size for f in b.column(0).to_pylist()]
            if any(s % width for s in size):
                raise ValueError("a token file ends within a token")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64())], ["file", "bytes"])

    def search(batches):
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            rows = []
            for f, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(f"{root}/{f}") as source:
                    x = np.frombuffer(source.read_at(min(block_bytes, size - at), at), kind)
                rows.append((f, at // block_bytes, *scan_block(x, end)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["file", "block", "ends", "head", "tail", "inner"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    named = files.select("file").where("file is not null").distinct().mapInArrow(sizes, "file string, bytes bigint").where("bytes > 0")
    starts = named.select("file", F.explode(F.expr(f"sequence(0L, bytes - 1, {block_bytes}L)")).alias("at"), "bytes").repartition("file", "at")
    found = written(starts.mapInArrow(search, "file string, block bigint, ends bigint, head bigint, tail bigint, inner array<bigint>"))
    by = Window.partitionBy("file").orderBy("block")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    carried = found.withColumns({"before": F.coalesce(F.sum("ends").over(past), F.lit(0)), "run": F.coalesce(F.sum(F.when(F.col("ends") > 0, 1)).over(by), F.lit(0))})
    carried = carried.withColumn("left", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block"))).withColumn("carry", F.coalesce(F.lag("left").over(by), F.lit(0)))
    done = carried.where("ends > 0").select("file", "before", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens"))
    done = done.select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    last = carried.groupBy("file").agg(F.max_by("left", "block").alias("n_tokens"), F.sum("ends").alias("ordinal")).where("n_tokens > 0")
    return done.unionByName(last.select("file", "ordinal", "n_tokens", F.lit(False).alias("ended")))


def document_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens) for every row of docs: its texts are written to flat token files, which are then scanned.

    Null and empty texts have no tokens; a null id keeps its row; repeated rows are counted each; an empty table gives no rows.
    Other columns are not read.
    """
    path = f"{shared_dir(docs.sparkSession)}/peakpool-tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(docs, path, vocabulary, id_col, text_col)
    counts = count_tokens(manifest.select("file"), path, block_bytes=block_bytes)
    return manifest.join(counts, ["file", "ordinal"]).select(id_col, "n_tokens")


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
