"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Equal vectors of a label are one row with a count first (partial aggregation, so a third of all
rows being one vector costs nothing). Centroids come from a bounded sample (``SAMPLE`` rows, by hash);
every row is assigned. With unit vectors, two within a cosine of t lie within
e = sqrt(2 - 2t) of each other; if x is nearest to centroid c and y to d, then
y.(d - c) <= e |d - c|. So y is sent to every cell c that satisfies this, and no pair at or
above t is missed at any number of cells: recall is 1, by proof rather than by measurement.
There are as many cells as the largest label has multiples of ``CELL_ROWS`` rows, but so few that a row of the sample goes
to at most ``COPIES`` on average: where vectors have no clusters, more cells would only make more guests.

A cell's rows are dealt into blocks of about ``BLOCK``; a task multiplies two blocks in
double precision and returns, for each vector, the number of its links and the least vector of
its part of the block: output is linear, never all pairs, and parts are found by passing least marks through
the product itself, not by a loop over links. Links join up in ``components``.

Defined results: vectors that are null, empty, zero, or hold null or non-finite parts, and
vectors without a label, link with nothing; vectors of different lengths do not link;
equal vectors link; rows of one vec_id are vectors of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.components import components

SAMPLE, CELL_ROWS, MAX_CELLS, COPIES, BLOCK, STRIP = 20_000, 2_048, 2_048, 8, 8_192, 512


def centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit rows; deterministic."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def _units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(x: np.ndarray, c: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own cell, and all that it must visit."""
    near = x @ c.T
    home = np.argmax(near, axis=1)
    into = near[np.arange(len(x)), home][:, None] - near <= reach * apart[home]
    return home, into & (np.arange(len(c)) <= home[:, None])  # of two cells, the pair meets in the one before


def _join(mark: np.ndarray, left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Marks, the least of each part, after rows ``left`` and ``right`` are linked where ``hit``."""
    none = len(mark)
    while True:
        parent = np.arange(none)
        np.minimum.at(parent, mark[right], np.where(hit, mark[left][:, None], none).min(axis=0))
        np.minimum.at(parent, mark[left], np.where(hit, mark[right][None, :], none).min(axis=1))
        if (parent[mark] == mark).all():
            return mark
        while (parent[parent] != parent).any():
            parent = parent[parent]
        mark = parent[mark]


def linked(x: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, home: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row its links, and the first row of its part. ``left`` and ``right`` are two blocks, or one twice; two guests meet elsewhere."""
    links, mark, same = np.zeros(len(x)), np.arange(len(x)), left is right
    for at in range(0, len(left), STRIP):
        a = left[at : at + STRIP]
        b = right[at:] if same else right
        hit = x[a] @ x[b].T >= threshold
        hit &= home[a][:, None] | home[b][None, :]
        if same:
            hit &= a[:, None] < b[None, :]
        rows, columns = hit.any(axis=1), hit.any(axis=0)
        if rows.any():
            a, b, hit = a[rows], b[columns], hit[np.ix_(rows, columns)]
            links[a] += hit @ copies[b]
            links[b] += copies[a] @ hit
            mark = _join(mark, a, b, hit)
    return links, mark


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)
             & F.exists("e", lambda v: v != 0) & F.forall("e", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # Equal vectors of a label are one group, with a number of its own: several may have one vec_id.
    groups = rows.where("sound").groupBy("label", "e").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    groups, _ = scratch.table(groups.withColumn("g", F.monotonically_increasing_id()), "vectors")
    largest = groups.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    widths = groups.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = widths["d"] if widths else 1
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    k = max(1, min(MAX_CELLS, math.ceil(largest / CELL_ROWS)))
    c, apart = np.zeros((1, width)), np.zeros((1, 1))
    if k > 1:
        sample = _units(pd.Series([r["e"] for r in groups.where(F.size("e") == width).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("e").collect()]))
        while k > 1:
            c = centroids(sample, k)
            apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2)
            if _cells(sample, c, apart, reach)[1].sum() <= COPIES * len(sample):
                break
            k //= 2
        if k == 1:
            c, apart = np.zeros((1, width)), np.zeros((1, 1))

    def assign(batches):
        for batch in batches:
            for d, part in batch.groupby(batch["e"].map(len)):
                x = _units(part["e"])
                if d == width:
                    home, into = _cells(x, c, apart, reach)
                else:  # a rare width has cells of its own
                    home = np.full(len(x), -int(d))
                    into = np.ones((len(x), 1), dtype=bool)
                row, cell = np.nonzero(into)
                cell = cell if d == width else home[row]
                yield pd.DataFrame({"label": part["label"].to_numpy()[row], "cell": cell, "home": home[row] == cell, "g": part["g"].to_numpy()[row],
                                    "copies": part["copies"].to_numpy()[row], "unit": list(x[row])})

    kind = dict(rows.dtypes)["label"]
    placed = groups.select("label", "e", "g", "copies").mapInPandas(assign, f"label {kind}, cell int, home boolean, g long, copies long, unit array<double>")
    placed, _ = scratch.table(placed, "cells")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count_if("home").alias("homes")).where("homes > 0")
    dealt = placed.join(sizes, ["label", "cell"]).withColumn("b", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    # Block pairs (i, j), i <= j; a row of block b takes part in (b, j) and (i, b).
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "home", "g", "copies", "unit")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("g", kind="stable")
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        b, ids = part["b"].to_numpy(), part["g"].to_numpy()
        left = np.flatnonzero(b == i)
        right = left if i == j else np.flatnonzero(b == j)
        links, mark = linked(np.array(part["unit"].tolist()), part["copies"].to_numpy(dtype=np.float64), left, right, part["home"].to_numpy(), threshold)
        some = np.flatnonzero(links)
        return pd.DataFrame({"g": ids[some], "links": links[some].astype(np.int64), "least": ids[mark[some]]})

    found = pairs.groupBy("label", "cell", "i", "j").applyInPandas(compare, "g long, links long, least long")
    found, _ = scratch.table(found, "links")
    roots = components(found.where("g <> least").select(F.col("g").alias("u"), F.col("least").alias("v")))
    counts = found.groupBy("g").agg(F.sum("links").alias("links"))
    classes = groups.join(counts, "g", "left").join(roots.withColumnRenamed("id", "g"), "g", "left").select(
        "label", "e", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "g").alias("c"))
    classes, _ = scratch.table(classes, "classes")
    names = classes.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    good = rows.where("sound").join(classes.join(names, "c").drop("vec_id", "c"), ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
