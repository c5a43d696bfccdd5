"""The convolutional network's score: windows of 64 sites through a one-dimensional autoencoder."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakpool.schema import RAW

WINDOW = 64
#: Fixed values of the weight file: its first bytes, the layers' and the activations' codes.
MAGIC = b"DBW1"
CONV, POOL, UPSAMPLE, ADD, INPUT, DROPOUT = range(6)
NONE, RELU, SIGMOID = range(3)


@dataclass
class Layer:
    op: int
    inputs: list[int]
    size: int = 0  # kernel, pool or factor
    stride: int = 0
    same: bool = True
    act: int = NONE
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None


@dataclass
class Network:
    """Layers in an order in which inputs come first; values are (windows, length, channels) in single precision."""

    layers: list[Layer] = field(default_factory=list)

    @staticmethod
    def read(data: bytes) -> Network:
        at = 0

        def numbers(n: int = 1, kind: str = "I"):
            nonlocal at
            got = struct.unpack_from(f"<{n}{kind}", data, at)
            at += 4 * n
            return got if n != 1 or kind == "f" else got[0]

        if data[:4] != MAGIC:
            raise ValueError("not a weight file")
        at = 4
        out = Network()
        try:
            for _ in range(numbers()):
                op, n_in = numbers(), numbers()
                layer = Layer(op, [numbers() for _ in range(n_in)])
                if op == CONV:
                    layer.size, pad, layer.act, arrays = (numbers() for _ in range(4))
                    layer.same = pad == 0
                    if numbers() != 3 or layer.act > SIGMOID:
                        raise ValueError("a convolution needs three-dimensional weights and a known activation")
                    shape = tuple(numbers() for _ in range(3))
                    layer.weight = np.array(numbers(int(np.prod(shape)), "f"), np.float32).reshape(shape)
                    if arrays > 1:
                        if numbers() != 1:
                            raise ValueError("a bias has one dimension")
                        layer.bias = np.array(numbers(numbers(), "f"), np.float32)
                elif op == POOL:
                    layer.size, layer.stride = numbers(), numbers()
                elif op == UPSAMPLE:
                    layer.size = numbers()
                elif op not in (ADD, INPUT, DROPOUT):
                    raise ValueError(f"unknown layer {op}")
                out.layers.append(layer)
        except struct.error:
            raise ValueError("the weight file is cut off") from None
        return out

    def write(self) -> bytes:
        u = lambda *x: struct.pack(f"<{len(x)}I", *x)
        out = [MAGIC, u(len(self.layers))]
        for x in self.layers:
            out.append(u(x.op, len(x.inputs), *x.inputs))
            if x.op == CONV:
                out += [u(x.size, 0 if x.same else 1, x.act, 1 if x.bias is None else 2, 3, *x.weight.shape), x.weight.astype("<f4").tobytes()]
                if x.bias is not None:
                    out += [u(1, len(x.bias)), x.bias.astype("<f4").tobytes()]
            elif x.op == POOL:
                out.append(u(x.size, x.stride))
            elif x.op == UPSAMPLE:
                out.append(u(x.size))
        return b"".join(out)

    def forward(self, x: np.ndarray) -> np.ndarray:
        made: list[np.ndarray] = []
        for layer in self.layers:
            a = made[layer.inputs[0]] if layer.inputs else x
            if layer.op == CONV:
                a = convolve(a, layer)
            elif layer.op == POOL:
                n = (a.shape[1] - layer.size) // layer.stride + 1
                a = np.max([a[:, p : p + (n - 1) * layer.stride + 1 : layer.stride] for p in range(layer.size)], axis=0)
            elif layer.op == UPSAMPLE:
                a = np.repeat(a, layer.size, axis=1)
            elif layer.op == ADD:
                a = a + made[layer.inputs[1]]
            made.append(a)
        return made[-1]


def convolve(x: np.ndarray, layer: Layer) -> np.ndarray:
    """Products and sums one after the other, each rounded to single precision: a matrix product may fuse or reorder them, which
    moves values across the last digit shown. In runs of windows that stay in the processor's cache."""
    k = layer.size
    if layer.same:
        x = np.pad(x, ((0, 0), ((k - 1) // 2, k - 1 - (k - 1) // 2), (0, 0)))
    n = x.shape[1] + 1 - k
    out = np.zeros((len(x), n, layer.weight.shape[2]), np.float32)
    for at in range(0, len(x), 16):
        y, into = x[at : at + 16], out[at : at + 16]
        for d in range(k):
            for c, w in enumerate(layer.weight[d]):
                into += y[:, d : d + n, c : c + 1] * w
    if layer.bias is not None:
        out = out + layer.bias
    if layer.act == RELU:
        out = np.maximum(out, np.float32(0))
    elif layer.act == SIGMOID:
        out = (np.float32(1) / (np.float32(1) + np.exp(-out.astype(np.float64)).astype(np.float32))).astype(np.float32)
    return out.astype(np.float32)


def find_weights(pools: int, folder: str | None = None) -> bytes:
    """The weight file for so many pools: from `folder`; without one, from the first folder that exists of $PEAKPOOL_WEIGHTS,
    `weights` beside this package, beside its parent folder, and in the working folder."""
    if not 2 <= pools <= 10:
        raise ValueError(f"the network takes 2 to 10 pools, not {pools}")
    own = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    places = [folder] if folder else [os.environ.get("PEAKPOOL_WEIGHTS", ""), os.path.join(own, "weights"), os.path.join(os.path.dirname(own), "weights"), "weights"]
    found = next((p for p in places if p and os.path.isdir(p)), None)
    if found is None:
        raise FileNotFoundError(f"no folder of weights among {[p for p in places if p]}")
    with open(os.path.join(found, f"{pools}pool.bin"), "rb") as f:
        return f.read()


def network_statistic(clean: DataFrame, weights: bytes, n_pools: int) -> DataFrame:
    """RAW rows of method DL. Windows of 64 sites in input order are independent, so each is a group of its own and a task takes
    many of them; the last window of a chromosome is padded with zeros."""
    series = Window.partitionBy("chrom_idx").orderBy("ord")
    rows = clean.withColumn("rn", F.row_number().over(series) - 1)
    per = WINDOW * 256
    rows = rows.select("chrom", "chrom_idx", "ord", "pos", "freq", "rn", F.floor(F.col("rn") / per).alias("part"))

    def run(t: pa.Table) -> pa.Table:
        net = Network.read(weights)
        t = t.take(pa.array(np.argsort(t.column("rn").to_numpy(), kind="stable")))
        n = len(t)
        x = np.zeros((-(-n // WINDOW) * WINDOW, n_pools), np.float32)
        x[:n] = np.array(t.column("freq").to_pylist(), np.float64)[:, :n_pools]
        y = net.forward(x.reshape(-1, WINDOW, n_pools)).reshape(-1)[:n].astype(np.float64)
        return pa.table({"method": pa.array(["DL"] * n), "chrom": t.column("chrom"), "chrom_idx": t.column("chrom_idx"), "ord": t.column("ord"), "pos": t.column("pos"), "raw": pa.array(y)})

    return rows.groupBy("chrom_idx", "part").applyInArrow(run, RAW)
