"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Each tree splits first by label, then again and again by a random direction at the median of a
bounded sample's projections; below the sample's resolution the mean of the last sampled node
serves. A vector within ``SPILL`` of a threshold goes to both sides, so that a close pair parts
only if it straddles the whole margin, and every tree gives it another chance. All vectors are
routed. Inside a leaf (large ones in pairs of blocks) cosines are taken in double precision and
only a spanning forest of the links leaves the task. Components come from those links; the number
of links of a vector is then counted exactly against its whole component, in blocks again.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component, or
whose label or id is null, links with nothing and is its own component; vectors of different
lengths don't link; rows that repeat an id are one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.components import components
from graphaxis.llm.scratch import materialise
from graphaxis.llm.textscan import mix

THRESHOLD = 0.98
TREES = 5
#: Vectors in a leaf, about; vectors in a block of a comparison.
LEAF, BLOCK = 400, 256
#: The forest is fitted on at most so many vectors, those of least hashed id; all are indexed.
SAMPLE = 16_000
LEAST_NODE = 12
#: Half the margin, in units of the length: links at 0.98 differ by 0.2 at most, a random
#: direction sees 0.2 / sqrt(dimensions) of it.
SPILL = 0.9
MAX_DEPTH = 40


class Tree:
    """Splits of one tree: node k parts at ``cut[k]`` into ``low[k]`` and ``low[k] + 1``."""

    def __init__(self, seed: int, dims: int):
        self.seed, self.dims = seed, dims
        self.low: list[int] = []
        self.cut: list[float] = []
        self.extra: list[int] = []
        self.middle: list[np.ndarray | None] = []
        self.roots: dict[int, int] = {}

    def directions(self) -> np.ndarray:
        d = np.random.default_rng(self.seed).standard_normal((self.dims, MAX_DEPTH))
        return d / np.linalg.norm(d, axis=0)

    def add(self) -> int:
        self.low.append(-1)
        self.cut.append(0.0)
        self.extra.append(0)
        self.middle.append(None)
        return len(self.low) - 1

    def fit(self, unit: np.ndarray, labels: np.ndarray, scale: float) -> Tree:
        """``scale``: vectors that each sampled one stands for."""
        at, margin = unit @ self.directions(), margin_of(self.dims)
        for label in np.unique(labels):
            root = self.roots[int(label)] = self.add()
            work = [(root, np.flatnonzero(labels == label), 0)]
            while work:
                node, rows, depth = work.pop()
                size = len(rows) * scale
                if size <= LEAF or depth >= MAX_DEPTH:
                    continue
                p = at[rows, depth]
                cut = float(np.median(p))
                if (np.abs(p - cut) <= margin).mean() > 0.5:
                    continue  # one dense group: it is compared in blocks
                if len(rows) < 2 * LEAST_NODE:
                    self.extra[node] = min(MAX_DEPTH - depth, int(np.ceil(np.log2(size / LEAF))))
                    self.middle[node] = at[rows].mean(axis=0)
                    continue
                self.cut[node] = cut
                low = self.low[node] = self.add()
                high = self.add()
                work += [(low, rows[p < cut + margin], depth + 1), (high, rows[p >= cut - margin], depth + 1)]
        return self

    def route(self, unit: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf keys; a row may reach several leaves."""
        at, margin = unit @ self.directions(), margin_of(self.dims)
        low, cut = np.array(self.low, dtype=np.int64), np.array(self.cut)
        extra = np.array(self.extra, dtype=np.int64)
        known, where = np.unique(labels, return_inverse=True)
        root = np.array([self.roots.get(int(x), -1) for x in known], dtype=np.int64)
        rows, node = np.arange(len(unit)), root[where]
        key = mix(labels.astype(np.int64).view(np.uint64) + np.uint64(self.seed))
        out_rows, out_keys = [rows[node < 0]], [key[node < 0]]
        rows, key, node = rows[node >= 0], key[node >= 0], node[node >= 0]
        left = np.full(len(rows), -1, dtype=np.int64)  # levels still to split without a fitted node
        for depth in range(MAX_DEPTH + 1):
            fresh = (left < 0) & (low[node] < 0)
            left = np.where(fresh, extra[node], left) if len(node) else left
            done = left == 0
            out_rows.append(rows[done])
            out_keys.append(mix(key[done] ^ node[done].astype(np.uint64)))
            rows, key, node, left = rows[~done], key[~done], node[~done], left[~done]
            if not len(rows):
                break
            middle = np.array([self.middle[n][depth] if l > 0 else 0.0 for n, l in zip(node.tolist(), left.tolist())]) if (left > 0).any() else 0.0
            threshold = np.where(left > 0, middle, cut[node])
            p = at[rows, depth]
            go_low, go_high = p < threshold + margin, p >= threshold - margin
            bit = [mix(key + np.uint64(1)), mix(key + np.uint64(2))]
            step = np.where(left > 0, left - 1, -1)
            child = np.where(left > 0, node, low[node])
            deeper = (left <= 0).astype(np.int64)
            rows, key, node, left = (
                np.concatenate([rows[go_low], rows[go_high]]),
                np.concatenate([bit[0][go_low], bit[1][go_high]]),
                np.concatenate([child[go_low], (child + deeper)[go_high]]),
                np.concatenate([step[go_low], step[go_high]]),
            )
        out_rows.append(rows)
        out_keys.append(key)
        return np.concatenate(out_rows), np.concatenate(out_keys).view(np.int64)


def margin_of(dims: int) -> float:
    return SPILL * np.sqrt(2 * (1 - THRESHOLD)) / np.sqrt(dims) / 2


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of ``dims`` components, and those vectors at length one."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims)
    with np.errstate(all="ignore"):
        top = np.abs(values).max(axis=1, initial=0)
        scaled = values / np.where(top > 0, top, 1)[:, None]  # squares neither overflow nor vanish
        norm = np.sqrt((scaled * scaled).sum(axis=1))
    good = np.isfinite(values).all(axis=1) & (top > 0)
    return rows[good], scaled[good] / norm[good, None]


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row each row reaches in a symmetric matrix of links."""
    n = len(linked)
    label = np.arange(n)
    u, v = np.nonzero(linked)
    while len(u):
        new = label.copy()
        np.minimum.at(new, u, label[v])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _block_pairs(size: str, spread: str) -> Column:
    """The pairs of blocks that a row of a group of ``size`` rows takes part in."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.col(spread), F.lit(77)), blocks.cast("long")).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))


def cluster(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Every row's id with ``n_links``, ``component_id`` and ``kept``."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("long").alias("label"))
    usable = rows.where("id is not null and label is not null and size(x) > 0").dropDuplicates(["id"])
    edges = materialise(_links(usable), "spanning")
    found = materialise(components(edges), "components")
    counts = _degrees(usable, found)
    out = rows.select("id").join(found, F.col("id") == F.col("node"), "left").join(counts, F.col("id") == F.col("at"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def fit_forest(usable: DataFrame) -> dict[int, list[Tree]]:
    """Trees for each vector length in the sample."""
    total = usable.count()
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    forest: dict[int, list[Tree]] = {}
    column = sample.column("x").combine_chunks() if sample.num_rows else pa.array([], type=pa.list_(pa.float64()))
    labels = sample.column("label").to_numpy() if sample.num_rows else np.zeros(0, dtype=np.int64)
    for dims in np.unique(column.value_lengths().to_numpy(zero_copy_only=False)).tolist():
        at, unit = unit_rows(column, dims)
        if len(at):
            forest[dims] = [Tree(1000 * dims + t, dims).fit(unit, labels[at], total / sample.num_rows) for t in range(TREES)]
    return forest


def _links(usable: DataFrame) -> DataFrame:
    forest = fit_forest(usable)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, labels = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            for dims in np.unique(column.value_lengths().to_numpy(zero_copy_only=False)).tolist():
                at, unit = unit_rows(column, dims)
                for t in range(TREES) if len(at) else ():
                    tree = forest[dims][t] if dims in forest else Tree(1000 * dims + t, dims)
                    row, leaf = tree.route(unit, labels[at])
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(ids[at[row]]), column.take(pa.array(at[row]))], names=["leaf", "id", "x"])

    routed = materialise(usable.mapInArrow(route, "leaf long, id long, x array<double>"), "leaves")
    sizes = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = routed.join(materialise(sizes, "sizes"), "leaf").withColumn("pair", F.explode(_block_pairs("size", "id")))

    def compare(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids, column = table.column("id").to_numpy()[order], table.column("x").combine_chunks().take(pa.array(order))
        at, unit = unit_rows(column, len(column[0]))
        linked = unit @ unit.T >= THRESHOLD
        root = _roots(linked)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": ids[at[moved]], "v": ids[at[root[moved]]]})

    return placed.groupBy("leaf", "pair").applyInArrow(compare, "u long, v long")


def _degrees(usable: DataFrame, found: DataFrame) -> DataFrame:
    """Links of each linked vector, counted against all of its component."""
    sizes = materialise(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    members = materialise(usable.join(found, F.col("id") == F.col("node")).select("id", "x", "label", "component"), "members")
    placed = members.join(sizes, "component").withColumn("pair", F.explode(_block_pairs("size", "id"))).withColumn(
        "own", F.pmod(F.xxhash64("id", F.lit(77)), F.ceil(F.col("size") / BLOCK).cast("long"))
    )

    def count(table: pa.Table) -> pa.Table:
        ids, own, label = (table.column(k).to_numpy() for k in ("id", "own", "label"))
        at, unit = unit_rows(table.column("x").combine_chunks(), len(table.column("x")[0]))
        linked = (unit @ unit.T >= THRESHOLD) & (label[at][:, None] == label[at][None, :])
        np.fill_diagonal(linked, False)
        pair = table.column("pair")[0].as_py()
        if pair["i"] != pair["j"]:  # pairs inside one block are counted once, in that block's own pair
            linked &= own[at][:, None] != own[at][None, :]
        return pa.table({"at": ids[at], "n": linked.sum(axis=1).astype(np.int64)})

    return placed.groupBy("component", "pair").applyInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n_links"))
