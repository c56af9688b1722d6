"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a product grid of cells. Every vector is kept in the
cell of its nearest codewords and visits cells in the order of the multi-sequence algorithm, by the sum of its
distances to the two codewords, as many as reach the target recall; the vectors it meets are verified by
their exact cosine. A pair is found if either end visits the other's cell.

The axes are first turned to the principal ones of the sample, dealt to the halves in turn, so that both halves have
something to tell apart whatever the order of the dimensions. How many cells are visited is measured on pairs at
exactly the threshold: vectors of the sample turned by the angle in question, in random directions, in directions
that the sample itself varies in, and towards their near neighbours in the sample; the hardest of these kinds counts.

Equal vectors are one node of the search: copies are counted before the shuffle, link with each other by that count,
and each node counts as many links as it stands for. The codebooks are fitted to a bounded sample (``sample`` rows of
at most ``SAMPLE_BYTES``); every vector is indexed. The number of codewords grows with the square root of the input,
so that a cell has ``PER_CELL`` vectors on average. A cell's vectors are compared in bounded blocks, which return
counts and a spanning forest of the links, never the pairs.

Nulls: vectors that are null, zero, of another length than most, or hold null or non-finite components link
with nothing, nor do rows with a null id, whose component is null. Rows that share an id are one vector, the least,
and come out once. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components, forest
from .vectors import bounded_sample, dimension, in_blocks, lists, matrix, unique_vectors

SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20
TARGET_RECALL = 0.99
#: Vectors a cell of the grid should have, on average.
PER_CELL = 50
#: Sums of two distances that a block of rows holds at once while it looks for its nearest cells.
_SUMS = 1 << 22


def fit_codebook(x: np.ndarray, words: int, rounds: int = 12, seed: int = 8) -> np.ndarray:
    """Lloyd's algorithm from a random start; codewords that lose all vectors stay where they are."""
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), min(words, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmin((book * book).sum(axis=1) - 2 * x[lo : lo + 2048] @ book.T, axis=1) for lo in range(0, len(x), 2048)])
        order = np.argsort(nearest, kind="stable")
        own, begin = np.unique(nearest[order], return_index=True)
        book[own] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.append(begin, len(x)))[:, None]
    return book


def multi_sequence(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first ``most`` cells (i, j) by a[i] + b[j], found with a heap over the two sorted lists."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, pushed, out = [(a[ia[0]] + b[ib[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((int(ia[i]), int(ib[j])))
        for nxt in ((i + 1, j), (i, j + 1)):
            if nxt[0] < len(ia) and nxt[1] < len(ib) and nxt not in pushed:
                pushed.add(nxt)
                heapq.heappush(heap, (a[ia[nxt[0]]] + b[ib[nxt[1]]], *nxt))
    return out


def principal_axes(x: np.ndarray) -> np.ndarray:
    """(d, d): the principal axes of unit vectors, the strongest dealt to the two halves in turn."""
    _, axes = np.linalg.eigh(x.T @ x / len(x))
    strong = axes[:, ::-1]
    return np.hstack([strong[:, 0::2], strong[:, 1::2]])


class MultiIndex:
    """The grid of two codebooks, for unit vectors; ``turn`` are the axes that they are seen along."""

    def __init__(self, first: np.ndarray, second: np.ndarray, turn: np.ndarray | None = None):
        self.books, self.split, self.turn = (first, second), first.shape[1], turn

    @classmethod
    def fit(cls, x: np.ndarray, words: int) -> MultiIndex:
        turn = principal_axes(x)
        y, half = x @ turn, (x.shape[1] + 1) // 2
        return cls(fit_codebook(y[:, :half], words), fit_codebook(y[:, half:], words) if x.shape[1] > 1 else np.zeros((1, 0)), turn)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the codewords of either half, less the halves' own squares."""
        x = x if self.turn is None else x @ self.turn
        return tuple((c * c).sum(axis=1) - 2 * h @ c.T for c, h in zip(self.books, (x[:, : self.split], x[:, self.split :])))

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """(rows, most) cells, nearest first.

        Among the first ``most`` sums are only codewords whose ranks multiply to at most ``most``, the cells the
        heap could reach; sorting those sums gives the sequence for many vectors at once.
        """
        a, b = self.distances(x)
        na, nb = a.shape[1], b.shape[1]
        i = np.arange(min(na, most))
        # By rank in the first book, the ranks in the second that may come along.
        along = np.minimum(most // (i + 1), nb)
        p, q = np.repeat(i, along), np.arange(along.sum()) - np.repeat(np.cumsum(along) - along, along)
        out = np.zeros((len(x), min(most, len(p))), np.int64)
        step = max(1, _SUMS // len(p))
        for lo in range(0, len(x), step):
            u, v = a[lo : lo + step], b[lo : lo + step]
            iu, iv = np.argsort(u, axis=1, kind="stable")[:, : len(i)], np.argsort(v, axis=1, kind="stable")[:, : int(along.max())]
            sums = np.take_along_axis(u, iu, 1)[:, p] + np.take_along_axis(v, iv, 1)[:, q]
            order = np.argsort(sums, axis=1, kind="stable")[:, :most]
            out[lo : lo + step] = np.take_along_axis(iu, p[order], 1) * nb + np.take_along_axis(iv, q[order], 1)
        return out

    def cells_for(self, x: np.ndarray, threshold: float, recall: float, seed: int = 9) -> int:
        """How many cells reach ``recall`` of the pairs at the threshold, of the hardest kind; x is a sample."""
        rng = np.random.default_rng(seed)
        probe = x[:1000]
        near = probe @ x.T
        near[np.arange(len(probe)), np.arange(len(probe))] = -2
        # Neighbours that aren't as good as equal: towards which the data really goes.
        near[near > 1 - 1e-6] = -2
        k = min(5, len(x) - 1)
        kinds = [rng.normal(size=probe.shape), x[rng.integers(0, len(x), len(probe))] - x[rng.integers(0, len(x), len(probe))]]
        if k:
            kinds.append(x[np.argpartition(-near, k - 1, axis=1)[np.arange(len(probe)), rng.integers(0, k, len(probe))]] - probe)
        return max(self._cells_of(probe, turn, threshold, recall) for turn in kinds)

    def _cells_of(self, x: np.ndarray, turn: np.ndarray, threshold: float, recall: float) -> int:
        turn = turn - (turn * x).sum(axis=1)[:, None] * x
        size = np.linalg.norm(turn, axis=1)
        x, turn = x[size > 1e-9], turn[size > 1e-9] / size[size > 1e-9][:, None]
        if not len(x):
            return 1
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * turn
        nb = len(self.books[1])

        def rank(p, q):
            (a, b), cell = self.distances(p), self.cell(q)
            at = a[np.arange(len(p)), cell // nb] + b[np.arange(len(p)), cell % nb]
            # How many sums are less, by binary search in the sorted second list.
            b = np.sort(b, axis=1)
            return np.array([np.searchsorted(v, t - 1e-12 - u).sum() for u, v, t in zip(a, b, at)])

        least = np.sort(np.minimum(rank(x, y), rank(y, x)))
        return int(least[min(len(least) - 1, int(np.ceil(recall * len(least))) - 1)]) + 1


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = TARGET_RECALL, sample: int = SAMPLE, words: int | None = None, vec_id: str = "vec_id", vector: str = "embedding", block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id) of every vector; links are pairs found with a cosine of ``threshold`` or more."""
    import pyarrow as pa

    spark = vectors.sparkSession
    d = dimension(vectors, vector)
    rows = unique_vectors(vectors, vec_id, vector)
    kind = rows.schema["v"].dataType.simpleString()
    everyone = rows.select(F.col("id").alias("vec_id"))
    nothing = F.lit(0).cast("bigint").alias("n_links")
    nameless = vectors.where(vectors[vec_id].isNull()).select(F.lit(None).cast("bigint").alias("vec_id"), nothing, F.lit(None).cast("bigint").alias("component_id"))

    def units(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                mask, y = matrix(batch.column(1), d)
                if len(y):
                    y /= np.linalg.norm(y, axis=1)[:, None]
                    yield batch.filter(pa.array(mask)), y

    def usable(batches):
        for batch, _ in units(batches):
            yield batch

    # One node for each distinct vector, named by its least id; no vector leaves its partition more than once.
    good = rows.mapInArrow(usable, f"id bigint, v {kind}")
    nodes = staged(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies"), "nodes")
    ids, x = bounded_sample(nodes, "id", "v", d, min(SAMPLE_BYTES, 8 * max(d, 1) * sample))
    if not len(x):
        return everyone.select("vec_id", nothing, F.col("vec_id").alias("component_id")).unionByName(nameless)
    x /= np.linalg.norm(x, axis=1)[:, None]
    words = words or max(2, int(np.sqrt(nodes.count() / PER_CELL)))
    grid = MultiIndex.fit(x, words)
    cells = grid.cells_for(x, threshold, recall)
    shared = spark.sparkContext.broadcast(grid)

    def keep(batches):
        for batch, y in units(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.cell(y)), *batch.columns, lists(shared.value.visits(y, cells), pa.int32())], names=["cell", "id", "v", "copies", "visits"])

    def visit(batches):
        for batch, y in units(batches):
            own, to = shared.value.cell(y), shared.value.visits(y, cells)
            at = pa.array(np.repeat(np.arange(len(y)), to.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(to.ravel()), *(c.take(at) for c in batch.columns), pa.array(np.repeat(own, to.shape[1]))], names=["cell", "id", "v", "copies", "own"])

    homes = staged(nodes.mapInArrow(keep, f"cell bigint, id bigint, v {kind}, copies bigint, visits array<int>"), "cells")
    guests = staged(nodes.mapInArrow(visit, f"cell bigint, id bigint, v {kind}, copies bigint, own bigint"), "visits")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        g, h = np.asarray(left["id"]), np.asarray(right["id"])
        out = [np.zeros(0, np.int64)] * 3
        if len(g) and len(h):
            p, q = matrix(left["v"], d)[1], matrix(right["v"], d)[1]
            pn, qn = np.sqrt((p * p).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            near = (p @ q.T) / (pn[:, None] * qn[None, :])
            i, j = np.nonzero((near >= threshold - 1e-9) & (g[:, None] != h[None, :]))
            # Summed in one order wherever the pair meets.
            sure = (p[i] * q[j]).sum(axis=1) / (pn[i] * qn[j]) >= threshold
            i, j = i[sure], j[sure]
            # The resident counts the link here unless it finds it itself, in the guest's cell.
            own, to = np.asarray(left["own"]), right["visits"].combine_chunks().flatten().to_numpy().reshape(len(h), -1)
            mutual = np.concatenate([(to[j[a : a + 65536]] == own[i[a : a + 65536], None]).any(axis=1) for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            copies_g, copies_h = np.asarray(left["copies"]), np.asarray(right["copies"])
            # Each end has as many links as the other end stands for.
            nodes, at = np.unique(np.concatenate([g[i], h[j[~mutual]]]), return_inverse=True)
            weight = np.concatenate([copies_h[j], copies_g[i[~mutual]]])
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, at, weight)
            hang, on = forest(g[i], h[j])
            out = [np.concatenate([nodes, hang]), np.concatenate([links, np.zeros(len(hang), np.int64)]), np.concatenate([nodes, on])]
        return pa.table([pa.array(np.asarray(c, np.int64)) for c in out], names=["id", "n", "to"])

    found = staged(in_blocks(guests, homes, ["cell"], verify, "id bigint, n bigint, to bigint", block), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "counted")
    parts = connected_components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "linked")
    named = nodes.join(counts, F.col("id") == F.col("counted"), "left").join(parts, F.col("id") == F.col("linked"), "left")
    # A vector's links are its node's and its own copies; zero-length cosines don't occur among usable vectors.
    named = staged(named.select(F.col("v").alias("node_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named")
    out = good.join(named, F.col("v") == F.col("node_v")).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = everyone.join(out.select(F.col("vec_id").alias("done")), F.col("vec_id") == F.col("done"), "left_anti").select("vec_id", nothing, F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).unionByName(nameless)


def op8_multi_index(spark, sf_dir: str) -> DataFrame:
    """Each vector's links at a cosine of 0.9 or more, its component, and whether it is kept."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
