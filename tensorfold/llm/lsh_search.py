"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are cut into groups of about equal norm, each with a longest norm M of its own: within a group, the search
for large inner products becomes Euclidean when every vector x is extended to (x / M, sqrt(1 - |x|^2 / M^2)) and every
query to (q / |q|, 0). Each table hashes a point to the integer parts of some Gaussian projections, each shifted at
random and divided by ``width``. A query visits its own bucket and then those whose coordinates differ by one, in the
order of their estimated success: the squared distances from the projections to the bucket borders crossed, least
sum first. Candidates of all tables are merged and ranked by their exact inner products.

How many tables, projections and buckets there are is calibrated: queries of a bounded sample search the sample, and
of the ways that find ``recall`` of their true neighbours there, that with the least expected work is taken. Groups
whose norms can't reach the score of the ``k``-th best that a query has in the sample aren't visited. Queries that
still meet fewer than ``k`` candidates go on to all vectors, in blocks, so that every query has min(k, candidates)
rows. What is returned is exact in score and order, whatever was visited.

Nulls: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, as candidate or query; nor do rows with a null id. Rows that share an id are one vector, the least. Ties go to
the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged
from .vectors import bounded_sample, dimension, in_blocks, matrix, unique_vectors

#: Bytes, as doubles, of the sample on which the search is calibrated and scores are bounded.
SAMPLE_BYTES = 8 << 20
#: Of the sample, the queries that calibrate.
SAMPLE_QUERIES = 200
#: The share of true neighbours that calibration aims at; tests measure what is reached against brute force.
TARGET_RECALL = 0.96
#: A group's norms are within this factor.
NORM_STEP = 1.5
#: What calibration chooses from: tables, projections of each, and buckets visited in each at most.
TABLES, HASHES, MOST_PROBES = (2, 4, 6), (2, 3, 4, 6, 8, 10), 128
_GROUP = np.int64(0x5851F42D4C957F2D)


class PStableHash:
    """The tables' projections, drawn from a seed."""

    def __init__(self, d: int, tables: int, hashes: int, width: float, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes = tables, hashes
        self.a = rng.normal(size=(d + 1, tables * hashes)) / width
        self.b = rng.uniform(size=tables * hashes)
        self.mix = rng.integers(1, 1 << 62, size=hashes, dtype=np.int64) | 1

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(integer, fractional) parts by row, table and hash of the extended vectors."""
        h = (x @ self.a + self.b).reshape(len(x), self.tables, self.hashes)
        low = np.floor(h)
        return low.astype(np.int64), h - low

    def bucket(self, places: np.ndarray) -> np.ndarray:
        """One number for the coordinates of a bucket."""
        with np.errstate(over="ignore"):
            return (places * self.mix).sum(axis=-1)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables) buckets that hold them, of their groups of norms."""
        group = norm_group(np.linalg.norm(x, axis=1))
        with np.errstate(over="ignore"):
            return self.bucket(self.place(extended(x, group))[0]) + (group * _GROUP)[:, None]

    def visits(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(queries, tables, probes) buckets in the order of their visits, to which a group's number is to be added."""
        y = np.hstack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))])
        low, fraction = self.place(y)
        return np.stack([self.bucket(low[:, t, None, :] + perturbations(fraction[:, t], probes)) for t in range(self.tables)], axis=1)


@lru_cache(maxsize=64)
def probe_ranks(hashes: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """Sets of positions in the sorted list of a query's 2 * ``hashes`` border distances, by expected sum.

    The j-th least squared distance is expected to be as j (j + 1), up to the middle of the list, and mirrored above;
    positions j and its mirror cross both borders of one hash, which can't be.
    """
    m = 2 * hashes
    cost = [j * (j + 1) if j <= hashes else 4 * hashes * (hashes + 1) * (1 - (m + 1 - j) / (hashes + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (hashes + 1) * (hashes + 2))) for j in range(1, m + 1)]
    heap, found = [(cost[0], (0,))], [()]
    while heap and len(found) < probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        if not any(m - 1 - j in chosen for j in chosen):
            found.append(chosen)
    return tuple(found)


def perturbations(fraction: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, hashes) of -1, 0 or 1: the buckets to visit, best first, for fractional parts by row."""
    n, k = fraction.shape
    # Squared distances down and up; in sorted order position j and 2k-1-j belong to one hash.
    border = np.concatenate([fraction**2, (1 - fraction) ** 2], axis=1)
    order = np.argsort(border, axis=1, kind="stable")
    ranks = probe_ranks(k, probes)
    out = np.zeros((n, len(ranks), k), np.int64)
    rows = np.arange(n)
    for p, chosen in enumerate(ranks):
        for j in chosen:
            at = order[:, j]
            out[rows, p, at % k] = np.where(at < k, -1, 1)
    return out


def norm_group(norm: np.ndarray) -> np.ndarray:
    """The group of each norm: norms within a factor of ``NORM_STEP``."""
    return np.floor(np.log(norm) / np.log(NORM_STEP)).astype(np.int64)


def longest(group: np.ndarray) -> np.ndarray:
    """A norm that none of a group exceeds."""
    return NORM_STEP ** (group + 1.0) * (1 + 1e-9)


def extended(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Vectors as points of the unit sphere, each by the longest norm of its group."""
    y = x / longest(group)[:, None]
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))[:, None]])


class Plan:
    """The hashing and the number of buckets to visit, calibrated on the sample (ids, x) for ``count`` vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, d: int, k: int, recall: float, count: int, width: float):
        self.ids, self.x, self.k = ids, x, k
        self.hashing, self.probes, self.expected = PStableHash(d, TABLES[-1], HASHES[0], width), MOST_PROBES, None
        n = min(SAMPLE_QUERIES, len(x))
        if len(x) > k:
            scores = x[:n] @ x.T
            scores[np.arange(n), np.arange(n)] = -np.inf
            near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(scores, near, 1).min(axis=1)
            # A query's work: rows that carry its vector, and vectors it is compared with.
            row, pair, cell = (4 * d + 64) * 6e-9, d * 4e-10 + 4e-9, 6e-4
            best = np.inf
            for tables in TABLES:
                for hashes in HASHES:
                    found = self._try(PStableHash(d, tables, hashes, width), x, n, near, least, recall)
                    if found is None:
                        continue
                    hashing, probes, share, rows, cells, reached = found
                    work = rows * row + share * count * pair + cells * cell / max(1, count / 20)
                    if work < best:
                        best, self.hashing, self.probes, self.expected = work, hashing, probes, reached
        homes = self.hashing.homes(x) if len(x) else np.zeros((0, self.hashing.tables), np.int64)
        #: By table, (buckets, which of them holds each vector of the sample).
        self.known = [np.unique(homes[:, t], return_inverse=True) for t in range(self.hashing.tables)]

    @staticmethod
    def _try(hashing, x, n, near, least, recall):
        """(hashing, probes, share of vectors met, rows of a query, cells, recall reached) of one way; None if that
        doesn't reach the recall."""
        norms = np.linalg.norm(x, axis=1)
        group = norm_group(norms)
        homes = hashing.homes(x)
        visits = hashing.visits(x[:n], MOST_PROBES)
        most = visits.shape[2]
        first = np.full((n, near.shape[1]), most, np.int64)
        with np.errstate(over="ignore"):
            for t in range(hashing.tables):
                own = homes[near, t] - group[near] * _GROUP
                hit = visits[:, t, None, :] == own[:, :, None]
                first = np.minimum(first, np.where(hit.any(axis=2), hit.argmax(axis=2), most))
        need = np.sort(first.ravel())
        probes = int(need[int(np.ceil(recall * len(need))) - 1]) + 1
        if probes > most:
            return None
        few = min(n, 40)
        met = np.zeros((few, len(x)), bool)
        reach = norms[:few, None] * longest(group)[None, :] >= least[:few, None]
        with np.errstate(over="ignore"):
            for t in range(hashing.tables):
                plain = homes[:, t] - group * _GROUP
                for i in range(few):
                    met[i] |= np.isin(plain, visits[i, t, :probes])
        groups = np.unique(group)
        open_ = (norms[:few, None] * longest(groups)[None, :] >= least[:few, None]).sum(axis=1).mean()
        cells = sum(len(np.unique(homes[:, t])) for t in range(hashing.tables))
        return hashing, probes, (met & reach).mean(), hashing.tables * probes * open_, cells, float((first < probes).mean())

    def floors(self, q: np.ndarray, x: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, groups): which groups may hold one of a query's ``k`` best, by the sample's; and the sample's scores."""
        scores = x @ self.x.T
        scores[q[:, None] == self.ids[None, :]] = -np.inf
        if scores.shape[1] <= self.k:
            return np.ones((len(q), len(groups)), bool), scores
        least = np.partition(scores, -self.k, axis=1)[:, -self.k]
        return np.linalg.norm(x, axis=1)[:, None] * longest(groups)[None, :] >= (least - 1e-9 * np.abs(least))[:, None], scores


def _best(q, x, v, y, k, least=None):
    """(query, id, score) of the ``k`` best rows of y for each row of x, other than itself; exact and in order."""
    scores = x @ y.T
    scores[q[:, None] == v[None, :]] = -np.inf
    least = np.full(len(q), -np.inf) if least is None else least
    if len(v) > k:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
    # A margin for the last bits of the matrix product; the scores returned are summed alike everywhere.
    i, j = np.nonzero((scores >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None]) & (scores > -np.inf))
    exact = (x[i] * y[j]).sum(axis=1)
    order = np.lexsort((v[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return q[i[keep]], v[j[keep]], exact[keep]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, width: float = 2.3, recall: float = TARGET_RECALL, vec_id: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score, completed) of the ``k`` nearest found of each query, among all rows but its own.

    ``is_query`` is a condition on the column ``id``. ``completed`` is true for queries that met fewer than ``k``
    candidates and went on to all vectors; their rows are exact.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    d = dimension(vectors, vector)
    rows = unique_vectors(vectors, vec_id, vector)
    own_type = rows.schema["v"].dataType.simpleString()

    def usable(batch):
        mask, x = matrix(batch.column(1), d)
        return batch.filter(pa.array(mask)), x

    def clean(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch, x = usable(whole.slice(lo, 4096))
                if len(x):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm_group(np.linalg.norm(x, axis=1)))], names=["id", "v", "g"])

    base = staged(rows.mapInArrow(clean, f"id bigint, v {own_type}, g bigint"), "vectors")
    # Doubles have at most some thousand groups of norms, whatever the input.
    sizes = base.groupBy("g").count().collect()
    groups, count = np.array(sorted(r.g for r in sizes), np.int64), sum(r["count"] for r in sizes)
    plan = Plan(*bounded_sample(base, "id", "v", d, SAMPLE_BYTES), d, k, recall, count, width)
    shared = spark.sparkContext.broadcast((plan, groups))
    tables = plan.hashing.tables

    def index(batches):
        hashing = shared.value[0].hashing
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch, x = usable(whole.slice(lo, 2048))
                bucket = hashing.homes(x)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(bucket[:, t]), *batch.columns[:2]], names=["t", "bucket", "id", "v"])

    def probe(batches):
        plan, groups = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch, x = usable(whole.slice(lo, 128))
                if not len(x):
                    continue
                ids = np.asarray(batch.column(0))
                open_, scores = plan.floors(ids, x, groups)
                visits = plan.hashing.visits(x, plan.probes)
                # (query, group) pairs that are open, and the buckets that each visits.
                who, g = np.nonzero(open_)
                with np.errstate(over="ignore"):
                    bucket = visits[who] + (groups[g] * _GROUP)[:, None, None]
                # k vectors of the sample that a query meets bound its k-th best from below.
                met = np.zeros(scores.shape, bool)
                for t, (own, of) in enumerate(plan.known):
                    if len(own):
                        at = np.minimum(np.searchsorted(own, bucket[:, t]), len(own) - 1)
                        hit = np.zeros((len(x), len(own)), bool)
                        i, p = np.nonzero(own[at] == bucket[:, t])
                        hit[who[i], at[i, p]] = True
                        met |= hit[:, of]
                floor = np.full(len(x), -np.inf)
                if scores.shape[1] > plan.k:
                    floor = np.partition(np.where(met, scores, -np.inf), -plan.k, axis=1)[:, -plan.k]
                for t in range(tables):
                    n = bucket.shape[2]
                    at = pa.array(np.repeat(who, n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who) * n, t, np.int32)), pa.array(bucket[:, t].ravel()), *(c.take(at) for c in batch.columns[:2]), pa.array(np.repeat(floor[who], n))],
                        names=["t", "bucket", "id", "v", "floor"],
                    )

    # Staged, as buckets are counted before they are dealt into blocks.
    homes = staged(base.mapInArrow(index, f"t int, bucket bigint, id bigint, v {own_type}"), "index")
    queries = base.where(is_query)
    asked = staged(queries.mapInArrow(probe, f"t int, bucket bigint, id bigint, v {own_type}, floor double"), "probes")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = np.asarray(left["id"]), np.asarray(right["id"])
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(q) and len(v):
            found = _best(q, matrix(left["v"], d)[1], v, matrix(right["v"], d)[1], k, np.asarray(left["floor"]) if "floor" in left.column_names else None)
        return pa.table([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    out = "query_id bigint, vec_id bigint, score double"
    found = in_blocks(asked, homes, ["t", "bucket"], rank, out, block)
    merged = staged(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "met")
    enough = merged.groupBy("query_id").count().where(F.col("count") >= min(k, count - 1)).select(F.col("query_id").alias("q"))
    short = staged(queries.join(enough, F.col("id") == F.col("q"), "left_anti").select(F.lit(0).alias("one"), "id", "v"), "short")
    merged = merged.withColumn("completed", F.lit(False))
    if count > 1 and not short.isEmpty():
        rest = in_blocks(short, base.select(F.lit(0).alias("one"), "id", "v"), ["one"], rank, out, block)
        again = short.select(F.col("id").alias("q"))
        merged = merged.join(again, F.col("query_id") == F.col("q"), "left_anti").unionByName(rest.withColumn("completed", F.lit(True)))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "completed")


def op6_lsh_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
