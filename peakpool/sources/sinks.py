"""Writers of a run's result files. Tables that grow with the input are written by executors; peaks and profiles are small."""

from __future__ import annotations

import csv
import json
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakpool.functions.scalars import plain, shortest
from peakpool.operators.peaks import by_position, values_table


def write_site_table(sites: DataFrame, folder: str) -> None:
    """Site tables as text parts in input order: chrom, pos, REF, ALT, depths."""
    whole = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    depths = F.flatten(F.zip_with("ref_a", "mut_a", lambda r, a: F.array(whole(r), whole(a))))
    rows = sites.orderBy("chrom_idx", "ord").select(F.concat_ws(",", F.col("chrom"), whole(F.col("pos")), F.col("ref"), F.col("alt"), F.array_join(depths, ",")).alias("value"))
    rows.write.mode("overwrite").text(folder)


def write_values(scored: DataFrame, folder: str) -> None:
    """chrom, position and raw value of one method, by chromosome and position, as text parts."""
    v = values_table(scored).orderBy("chrom_idx", "rn")
    v.select(F.concat_ws("\t", "chrom", F.col("position").cast("string"), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(folder)


def write_peaks(peaks: DataFrame, path: str) -> None:
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["QTL", "Chr", "Left", "Peak", "Right", "Value"])
        for r in peaks.orderBy("qtl").collect():
            out.writerow([r["qtl"], r["chr_display"], *(shortest(r[c]) for c in ("left", "peak", "right", "value"))])


def write_profiles(profile: DataFrame, path: str) -> None:
    out: dict[str, dict] = {}
    for r in profile.orderBy("key", "seq").collect():
        own = out.setdefault(r["key"], {"data": [], "peak": r["peak"], "pos": []})
        own["data"].append(r["data"])
        own["pos"].append(r["pos"])
    with open(path, "w") as f:
        json.dump(out, f, sort_keys=True, separators=(",", ":"))


def write_arrays(scored: DataFrame, chroms: DataFrame, folder: str, method: str) -> None:
    """The numpy files of one method: all raw values, and raw and smoothed values by chromosome, empty ones included. They are
    single files by their nature, so that the values pass through the driver, 16 bytes a site: they lie in files that are mapped
    to memory until the last is written."""
    sizes = {r["chrom_idx"]: r["n"] for r in scored.groupBy("chrom_idx").agg(F.count("*").alias("n")).collect()}
    order = [r["chrom_idx"] for r in chroms.orderBy("chrom_idx").collect()]
    total = sum(sizes.values())
    raw = np.lib.format.open_memmap(os.path.join(folder, f"all_data_for_percentile_{method}.npy"), "w+", np.float64, (total,))
    with tempfile.TemporaryFile() as spare:
        smooth = np.memmap(spare, np.float64, "w+", shape=(total,)) if total else np.empty(0)
        for at, r in enumerate(by_position(scored).select("chrom_idx", "rn", "raw", "smooth").orderBy("chrom_idx", "rn").toLocalIterator()):
            raw[at], smooth[at] = r["raw"], r["smooth"]
        ends = np.cumsum([sizes.get(k, 0) for k in order])
        for values, name in ((raw, "all_data_for_plot"), (smooth, "smooth_data_for_plot")):
            ragged = np.empty(len(order), object)
            for i, k in enumerate(order):
                ragged[i] = np.array(values[ends[i] - sizes.get(k, 0) : ends[i]])
            np.save(os.path.join(folder, f"{name}_{method}.npy"), ragged, allow_pickle=True)
    raw.flush()


def write_matrix(rows: DataFrame, columns: list[str], path: str) -> None:
    """Columns of a table in its own order as a two-dimensional numpy file."""
    out = np.lib.format.open_memmap(path, "w+", np.float64, (rows.count(), len(columns)))
    for at, r in enumerate(rows.select(*columns).toLocalIterator()):
        out[at] = list(r)
    out.flush()


def write_gametes(base: DataFrame, crosses: DataFrame, folder: str) -> None:
    """Each gamete's two strands as a file <number>.bin: their length (64 bits), the first strand's values, the second's. base:
    (chrom, idx, ref, mut); crosses: (file, chrom, points). Executors write; the folder is one that they share. A strand starts
    as its own haplotype and swaps with the other at each point."""
    os.makedirs(folder, exist_ok=True)
    swapped = F.size(F.filter("points", lambda p: p <= F.col("idx"))) % 2 == 1
    rows = base.join(crosses, "chrom").select("file", "chrom", "idx", F.when(swapped, F.col("mut")).otherwise(F.col("ref")).alias("a"), F.when(swapped, F.col("ref")).otherwise(F.col("mut")).alias("b"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("chrom", "ascending"), ("idx", "ascending")])
        name = t.column("file")[0].as_py()
        with open(os.path.join(folder, f"{name}.bin.part"), "wb") as f:
            f.write(np.array([len(t)], "<u8").tobytes() + t.column("a").to_numpy().astype("<f8").tobytes() + t.column("b").to_numpy().astype("<f8").tobytes())
        os.replace(os.path.join(folder, f"{name}.bin.part"), os.path.join(folder, f"{name}.bin"))  # a task that runs again writes the same
        return pa.table({"file": pa.array([name], pa.int32())})

    rows.groupBy("file").applyInArrow(run, "file int").count()


def read_gamete(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The two strands of a gamete's file."""
    with open(path, "rb") as f:
        n = int(np.frombuffer(f.read(8), "<u8")[0])
        values = np.frombuffer(f.read(), "<f8")
    if len(values) != 2 * n:
        raise ValueError(f"{path} is cut off")
    return values[:n], values[n:]


def write_significant(table: DataFrame, path: str) -> None:
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(table.columns)
        for r in table.toLocalIterator():
            out.writerow(list(r))


def write_simulated(sites: DataFrame, folder: str) -> None:
    """Simulated pools as text (three decimals) and as a site table."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "simulate_data.txt"), "w") as text, open(os.path.join(folder, "simulate_data.csv"), "w") as table:
        for r in sites.orderBy("chrom_idx", "ord").toLocalIterator():
            head = [r["chrom"], plain(r["pos"]), "I", "I"]
            text.write("\t".join(head + [f"{k:.3f},{1 - k:.3f}" for k in r["ref_a"]]) + "\n")
            table.write(",".join(head + [plain(x) for k in r["ref_a"] for x in (k, 1 - k)]) + "\n")
