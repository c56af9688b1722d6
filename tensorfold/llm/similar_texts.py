"""Near copies by word shingles with SimHash's anchors as the search.

Texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more are linked. Such a pair's SimHashes
differ in about 15 % of their bits, too many for one covering of 64 bits, so the anchor-point covering of ``simhash``
is used in several tables, each over its own choice of the fingerprint's bits: the home of a fingerprint is its
nearest anchor, and it is replicated to every anchor within covering radius plus one. As many tables are used as
find ``RECALL`` of pairs at exactly 0.8; the finer the anchors (one more bit with each doubling of the input beyond
two million texts), the more tables that takes. More similar pairs are found more surely, and a group of
copies is missed only if all links that hold it together are.

Pairs that meet are compared by 128 bits, then by 192 and by the parities of their shingles in 512 slots, then exactly by
their shingles, hashed to 64 bits; no pair below 0.8 is linked. Parities lose nothing: sets whose parities differ in k slots
differ in k shingles at least. They tell 0.6 from 0.8 where bits can't, up to some 900 shingles. Anchors also go by size, as sets of a similarity of 0.8
have sizes within 5 to 4.

Texts with equal sets are one node of the search, all without words among them. Anchors with far more homes than
others belong to large groups of near copies. One home of each is a lead; every text is first compared with two of the
leads it meets, the nearest and the first by hash. A text joins the group of that lead it meets, within LOOSE bits, whose
component is the largest so far. Members of a group aren't compared pair by pair, at a hot anchor they don't even meet:
``_within_groups`` links them, exactly, by what they differ in from what most of the group have in common.

Nulls count as empty texts. A row is known by its id and the hash of its text; of a group of near copies the row of
the least id stays, rows without an id come last. Rows that share an id but aren't near copies are judged apart.
Repeated rows become one.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged
from .components import connected_components
from .simhash import GOLAY_BITS, AnchorCode

SHINGLE, SIMILARITY = 5, 0.8
RECALL = 0.95
#: Share of bits in which the fingerprints of sets of a similarity of 0.8 differ: acos(8 / 9) / pi.
FLIPS = 0.1515
#: Bits that may differ: of the 128 that are sent, and of all 192. Pairs at 0.8 exceed them about once in 20000.
NEAR, NEAR_ALL = 36, 48
#: Of the 128 bits, those in which a text may differ from a lead of its group: texts at 0.6 hardly exceed them, unrelated
#: ones do. What is linked doesn't depend on it.
LOOSE = 40
#: Homes that make an anchor hot, besides 4 times the mean; and how many hot anchors, the fullest, are told to all
#: tasks (40 bytes each). What is linked doesn't depend on either.
HOT, MOST_HOT = 24, 100_000
MOST_SENT = 500_000
#: Members, about, that tell which shingles a group has in common. What is linked doesn't depend on it.
SAMPLE = 64
#: Longs of parities of a set, and the power of two of the bits that tell, beyond MOST_SENT, which rows may have to go.
ODD, SIEVE = 8, 26
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_CHUNK = 1 << 14


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    return np.unique(np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64))


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    out = np.zeros(64, np.int64)
    for lo in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[lo : lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.uint16)
    return out


def sketch(h: np.ndarray) -> tuple[int, int, int, int]:
    """(digest of a set of shingles, its SimHash, two further ones), as signed longs."""
    from xxhash import xxh64_intdigest

    out = [np.uint64(xxh64_intdigest(h.tobytes(), 42) if len(h) else 0)]
    for mix in (None, *_MIX):
        own = h
        if mix is not None:
            own = (h ^ h >> np.uint64(29)) * mix
            own ^= own >> np.uint64(32)
        out.append(np.packbits(2 * _votes(own) > len(h), bitorder="little").view(np.uint64)[0])
    return tuple(int(np.array(x, np.uint64).view(np.int64)) for x in out)


def parities(h: np.ndarray) -> np.ndarray:
    """Is the number of the hashes in each of 64 ODD slots odd, as signed longs."""
    odd = np.bincount((h % np.uint64(64 * ODD)).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


class Tables:
    """Anchors in several tables, each over ``GOLAY_BITS + extra`` bits of a fingerprint."""

    def __init__(self, extra: int, tables: int, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.code, self.extra = AnchorCode(extra, 1), extra
        self.bits = [rng.permutation(64) for _ in range(tables)]

    def chosen(self, bits: np.ndarray, table: int) -> np.ndarray:
        return np.packbits(np.ascontiguousarray(bits[:, self.bits[table]]), axis=1, bitorder="little").view(np.int64).ravel() & ((1 << GOLAY_BITS + self.extra) - 1)

    def bucket(self, table: int, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Table, class of size and anchor in one number."""
        return (table * 128 + size << GOLAY_BITS + self.extra) | anchor

    @staticmethod
    def unpacked(f: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(f, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    @staticmethod
    def size(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, may a set larger by a quarter be in the next one): classes grow by (5 / 4)^4."""
        steps = np.floor(np.log(np.maximum(n, 1)) / np.log(1.25) + 1e-9).astype(np.int64)
        return steps >> 2, steps & 3 == 3

    def homes(self, f: np.ndarray, n: np.ndarray):
        """(bucket, position) of each fingerprint's home in each table."""
        bits, (size, _), at = self.unpacked(f), self.size(n), np.arange(len(f))
        for t in range(len(self.bits)):
            yield self.bucket(t, size, self.code.home(self.chosen(bits, t))), at

    def guests(self, f: np.ndarray, n: np.ndarray):
        """(bucket, position) of each anchor to visit: of texts of one's own class of size, and of the next if need be."""
        bits, (size, edge) = self.unpacked(f), self.size(n)
        for t in range(len(self.bits)):
            anchor, of = self.code.visits(self.chosen(bits, t))
            yield self.bucket(t, size[of], anchor), of
            up = edge[of]
            yield self.bucket(t, size[of[up]] + 1, anchor[up]), of[up]


def extra_bits(count: int) -> int:
    """One bit with each doubling beyond 2**21 texts: an anchor's unrelated guests stay as many."""
    return max(0, min(30, count.bit_length() - 21))


def tables_for(extra: int, recall: float = RECALL, flips: float = FLIPS, pairs: int = 4000) -> int:
    """How many tables find ``recall`` of random pairs whose bits differ with a probability of ``flips``, where one end
    visits and the other is at home."""
    rng = np.random.default_rng(6)
    a = rng.integers(-(1 << 63), 1 << 63, pairs, np.int64)
    b = a ^ np.packbits(rng.random((pairs, 64)) < flips, axis=1, bitorder="little").view(np.int64).ravel()
    found, n = np.zeros(pairs, bool), 0
    while n < 4096 and found.mean() < recall:
        step = Tables(extra, n + 1)
        x, y = (step.chosen(step.unpacked(v), n) for v in (a, b))
        anchor, of = step.code.visits(x)
        found[of[anchor == step.code.home(y)[of]]] = True
        n += 1
    return n


_ODDS = [f"p{k}" for k in range(ODD)]


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, h, node, n, f, g0, g1, p0 ...) of (id, h, t): whole texts, no shuffle."""
    import pyarrow as pa

    names = ["f", "g0", "g1", *_ODDS]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, shingle) for t in part.column(2).to_pylist()]
                found = np.array([(*sketch(s), *parities(s)) for s in sets], np.int64).reshape(-1, 1 + len(names))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found[:, 0]), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(found[:, 1 + k]) for k in range(len(names)))],
                    names=["id", "h", "node", "n", *names],
                )

    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["id", "h", "node", "n", *names]))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, s) of (node, t): the shingles of whole texts."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, shingle).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return docs.mapInArrow(run, "node bigint, s array<bigint>")


_ROW = "bucket bigint, node bigint, f bigint, g bigint, c bigint"


def _numbers(batch, lo: int, size: int = 4096) -> list[np.ndarray]:
    return [np.asarray(c.slice(lo, size).to_numpy(zero_copy_only=False)) for c in batch.columns]


def _spread(nodes: DataFrame, tables: Tables, guests: bool, main: np.ndarray | None = None) -> DataFrame:
    """(bucket, node, f, g, c) of every node's homes or visits; c is null where it is the node itself.

    With ``main``, rows (hot bucket, its main component), buckets are doubled: homes of the main component are in the
    second half, which only guests of other components visit as well.
    """
    import pyarrow as pa

    shared = None if main is None else nodes.sparkSession.sparkContext.broadcast(main[np.argsort(main[:, 0], kind="stable")])

    def run(batches):
        main = None if shared is None else shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                node, n, f, g, c = _numbers(batch, lo)
                for bucket, of in (tables.guests if guests else tables.homes)(f, n):
                    if main is not None:
                        at = np.minimum(np.searchsorted(main[:, 0], bucket), len(main) - 1)
                        hot = main[at, 0] == bucket
                        own = hot & (main[at, 1] == c[of])
                        bucket = bucket << 1
                        if guests:
                            more = np.flatnonzero(hot & ~own)
                            bucket, of = np.concatenate([bucket, bucket[more] | 1]), np.concatenate([of, of[more]])
                        else:
                            bucket = bucket | own
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node[of]), pa.array(f[of]), pa.array(g[of]), pa.array(c[of], mask=(c == node)[of])], names=["bucket", "node", "f", "g", "c"])

    return nodes.where("n > 0").select("node", "n", "f", F.col("g0").alias("g"), "c").mapInArrow(run, _ROW)


def _near_leads(tables: Tables, leads: np.ndarray, n: np.ndarray, f: np.ndarray, g: np.ndarray, bits: int):
    """(position of a node, position of a lead it meets, bits they differ in) for pairs within ``bits``; leads by bucket."""
    who, lead = [], []
    for bucket, of in tables.guests(f, n):
        at = np.minimum(np.searchsorted(leads[:, 0], bucket), len(leads) - 1)
        hit = np.flatnonzero(leads[at, 0] == bucket)
        who.append(of[hit])
        lead.append(at[hit])
    who, lead = np.concatenate(who), np.concatenate(lead)
    far = sum(np.bitwise_count((own[who] ^ leads[lead, k]).view(np.uint64)).astype(np.int64) for k, own in ((2, f), (3, g)))
    near = far <= bits
    return who[near], lead[near], far[near]


def _firsts(who: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The position of each ``who``'s first row, by the last of the keys, then by those before it."""
    order = np.lexsort((*keys, who))
    return order[np.append(True, who[order][1:] != who[order][:-1])[: len(order)]]


def _leads_met(nodes: DataFrame, tables: Tables, leads: np.ndarray) -> DataFrame:
    """(a, b): every node with two of the leads (bucket, node, f, g) near it, the nearest and the first by hash."""
    import pyarrow as pa

    leads = leads[np.argsort(leads[:, 0], kind="stable")]
    shared = nodes.sparkSession.sparkContext.broadcast(leads)

    def run(batches):
        leads = shared.value
        rank = (leads[:, 1].view(np.uint64) * _MIX[0] >> np.uint64(1)).view(np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                node, n, f, g = _numbers(batch, lo)
                who, lead, far = _near_leads(tables, leads, n, f, g, NEAR)
                other = leads[lead, 1] != node[who]
                who, lead, far = who[other], lead[other], far[other]
                pick = np.unique(np.concatenate([_firsts(who, leads[lead, 1], key) for key in (far, rank[lead])]))
                a, b = node[who[pick]], leads[lead[pick], 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return nodes.where("n > 0").select("node", "n", "f", F.col("g0").alias("g")).mapInArrow(run, "a bigint, b bigint")


def _grouped(nodes: DataFrame, tables: Tables, leads: np.ndarray) -> DataFrame:
    """(node, n, f, g0, c) of the nodes with shingles: c is the group of the lead (bucket, node, f, g, group, size) near
    it whose group is the largest, the node itself where it meets no lead."""
    import pyarrow as pa

    shared = nodes.sparkSession.sparkContext.broadcast(leads[np.argsort(leads[:, 0], kind="stable")])

    def run(batches):
        leads = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                node, n, f, g0 = _numbers(batch, lo)
                who, lead, _ = _near_leads(tables, leads, n, f, g0, LOOSE)
                pick = _firsts(who, leads[lead, 4], -leads[lead, 5])
                c = node.copy()
                c[who[pick]] = leads[lead[pick], 4]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, n, f, g0, c)], names=["node", "n", "f", "g0", "c"])

    return nodes.where("n > 0").select("node", "n", "f", "g0").mapInArrow(run, "node bigint, n bigint, f bigint, g0 bigint, c bigint")


def _within_groups(members: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b) that connect, through such pairs only, the members (node, n, c) of a group c that have a similarity of p / q.

    D(x) is what a set differs in from the base of its group, which may be any set: here the shingles that most of a
    sample of its members have. x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles and are similar if that is at
    most (q - p) / (q + p) of |x| + |y|, thus if w(x) + w(y) <= 2 (q + p) |D(x) & D(y)|, with w(x) = (q + p) |D(x)| - (q - p) |x|.
    The member of the least w, ``low``, is similar to all whose w and its own aren't positive together: one link each.
    Any other, an outer one, must share some of D(x) with whatever is similar to it. So pairs with an outer member are looked for
    among the least frequent of D(x), as many as can't all be missing from the other's, and compared by all of D(x).
    """
    size, sum_, diff = F.size("d"), q + p, q - p
    counted = staged(members.groupBy("c").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    full = members.join(F.broadcast(counted), "c").join(sets, "node")
    picked = staged(full.where(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.floor(F.col("m") / SAMPLE))) == 0).select("c", "s"), "picked")
    often = picked.select("c", F.explode("s").alias("e")).groupBy("c", "e").agg(F.count("*").alias("k"))
    most = often.join(F.broadcast(picked.groupBy("c").agg(F.count("*").alias("m"))), "c").where("2 * k > m")
    base = staged(most.groupBy("c").agg(F.collect_list("e").alias("base")), "base")
    based = full.join(base, "c", "left").withColumn("base", F.coalesce("base", F.expr("array()").cast("array<bigint>")))
    deltas = based.select("c", "node", "n", F.concat(F.array_except("s", "base"), F.array_except("base", "s")).alias("d"))
    deltas = staged(deltas.withColumn("w", sum_ * size - diff * F.col("n")), "deltas")
    lows = deltas.groupBy("c").agg(F.min(F.struct("w", "node")).alias("low"), F.max("w").alias("high")).select("c", F.col("low.w").alias("w0"), F.col("low.node").alias("low"), "high")
    lows = F.broadcast(staged(lows, "lows"))
    inner = deltas.join(lows, "c").where("w + w0 <= 0 and node <> low").select(F.least("node", "low").alias("a"), F.greatest("node", "low").alias("b"))
    # The other groups have no outer members.
    parts = deltas.join(lows, "c").where("high + w0 > 0").select("c", "node", "n", "w", "w0", F.explode("d").alias("e"))
    shared = staged(parts.groupBy("c", "e").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    ranked = parts.join(shared, ["c", "e"], "left").groupBy("c", "node", "n", "w", "w0").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "e"))).alias("d"))
    places = ranked.select("c", "node", "n", "w", "w0", size.alias("size"), F.posexplode("d").alias("i", "at")).where("at.k > 1").select("*", "at.e").drop("at")
    # As many of D(x) as are sure to be missing from the other's, at most.
    spare = F.col("size") - F.floor(F.col("n") * diff / p)
    least = lambda other: F.greatest(F.lit(1), spare, F.ceil((F.col("w") + other) / (2 * sum_)))
    places = places.withColumn("outer", F.col("w") + F.col("w0") > 0).withColumn("rest", F.col("size") - F.col("i"))
    places = staged(places.withColumn("asks", F.col("outer") & (F.col("rest") >= least(F.col("w0")))).withColumn("told", F.col("rest") >= least(1 - F.col("w0"))).where("asks or told"), "places")
    names = ("c", "e", "node", "n", "w", "rest", "outer")
    other = places.where("told").select([F.col(x).alias(f"{x}_b") for x in names])
    meet = (F.col("c") == F.col("c_b")) & (F.col("e") == F.col("e_b")) & (F.col("node") != F.col("node_b")) & (~F.col("outer_b") | (F.col("node") < F.col("node_b")))
    sized = F.least("n", "n_b") * q >= F.greatest("n", "n_b") * p
    pairs = places.where("asks").select(*names).join(other.hint("merge"), meet & sized & (2 * sum_ * F.least("rest", "rest_b") >= F.col("w") + F.col("w_b")))
    pairs = staged(pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct(), "outer")
    side = lambda end: deltas.select(F.col("node").alias(end), F.col("d").alias(f"d_{end}"), F.col("w").alias(f"w_{end}"))
    linked = pairs.join(side("a"), "a").join(side("b"), "b").where(2 * sum_ * F.size(F.array_intersect("d_a", "d_b")) >= F.col("w_a") + F.col("w_b"))
    return staged(inner.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "within")


def similar_links(each: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tables: int | None = None) -> DataFrame:
    """(a, b) that connect nodes of a similarity of ``similarity`` or more, through such pairs only.

    ``each`` is what ``_sketched`` gives, staged; ``texts`` has id, h and t.
    """
    nodes = staged(each.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "f", "g0", "g1", *_ODDS)], F.min(F.struct("id", "h")).alias("row")), "nodes")
    extra = extra_bits(nodes.count())
    own = Tables(extra, tables or tables_for(extra))
    ratio = Fraction(similarity).limit_denominator(1000)
    p, q = ratio.numerator, ratio.denominator

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, s): the shingles of the nodes wanted, from one text of each."""
        rows = staged(nodes.join(wanted, "node", "left_semi").select("node", "row.*").withColumnsRenamed({"id": "w_id", "h": "w_h"}), "wanted")
        # At most MOST_SENT rows of 24 bytes are told to all tasks; beyond that, texts are shuffled.
        rows = F.broadcast(rows) if rows.count() <= MOST_SENT else rows
        found = texts.join(rows, texts["id"].eqNullSafe(rows["w_id"]) & (texts["h"] == rows["w_h"])).select("node", "t")
        return staged(_sets(found, shingle).dropDuplicates(["node"]), "sets")

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that the further bits and then the shingles confirm."""
        side = lambda end: nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "f", "g0", "g1", *_ODDS)])
        bits = lambda names: sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in names), F.lit(0))
        differ = bits(("f", "g0", "g1"))
        # Sets of a similarity of p / q differ in (q - p) / (q + p) of their shingles, both counted.
        odd = bits(_ODDS) * (q + p) <= (F.col("n_a") + F.col("n_b")) * (q - p)
        sized = F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p
        close = staged(pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(sized & (differ <= NEAR_ALL) & odd).select("a", "b", "n_a", "n_b"), "close")
        held = sets_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = close.join(held.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
        # |x & y| / |x | y| >= p / q in integers.
        return staged(both.where((p + q) * F.size(F.array_intersect("x", "y")) >= p * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "similar")

    near = F.bit_count(F.col("f").bitwiseXOR(F.col("f_b"))) + F.bit_count(F.col("g").bitwiseXOR(F.col("g_b"))) <= NEAR
    apart = F.coalesce(F.col("c") != F.col("c_b"), F.lit(True))

    def met(homes: DataFrame, guests: DataFrame) -> DataFrame:
        guests = guests.select(F.col("bucket").alias("at"), F.col("node").alias("b"), F.col("f").alias("f_b"), F.col("g").alias("g_b"), F.col("c").alias("c_b"))
        # Merged: by the size of the nodes, which is all that the planner knows, it would send every visit to the driver.
        pairs = homes.join(guests.hint("merge"), (F.col("bucket") == F.col("at")) & (F.col("node") != F.col("b")) & apart & near)
        return similar(pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")))

    alone = nodes.withColumn("c", F.col("node"))
    counts = staged(_spread(alone, own, False).groupBy("bucket").count(), "anchors")
    mean = counts.agg(F.avg("count")).first()[0] or 0
    # At most MOST_HOT rows, whatever the input.
    full = counts.where(F.col("count") > HOT + 4 * mean).orderBy(F.desc("count"), "bucket").select(F.col("bucket").alias("hot")).limit(MOST_HOT)
    hot = F.broadcast(staged(full, "hot"))
    at_hot = _spread(alone, own, False).join(hot, F.col("bucket") == F.col("hot"))
    leads = at_hot.groupBy("bucket").agg(F.min_by(F.struct("node", "f", "g"), F.xxhash64("node", "bucket")).alias("lead")).select("bucket", "lead.*").collect()
    if not leads:
        return met(_spread(alone, own, False), _spread(alone, own, True))
    first = similar(_leads_met(nodes, own, np.array([tuple(r) for r in leads], np.int64)))
    component = connected_components(first)
    component = staged(component, "component")
    at = component.join(F.broadcast(component.groupBy("component").agg(F.count("*").alias("size"))), "component")
    # At most a row for each lead.
    told = at.join(F.broadcast(nodes.sparkSession.createDataFrame([(r[1],) for r in leads], "node bigint").distinct()), "node").select("node", "component", "size").collect()
    told = {r[0]: (r[1], r[2]) for r in told}
    # Groups have the complements of their components' names, which no node has.
    leads = np.array([(*r, ~of, size) for r in leads for of, size in [told.get(r[1], (r[1], 1))]], np.int64)
    labelled = staged(_grouped(nodes, own, leads), "labelled")
    main = _spread(labelled, own, False).where("c is not null").join(hot, F.col("bucket") == F.col("hot")).groupBy("bucket", "c").count()
    main = main.groupBy("bucket").agg(F.max_by("c", "count")).collect()
    main = np.array([tuple(r) for r in main], np.int64).reshape(-1, 2)
    main = main if len(main) else None
    members = labelled.where("c <> node").select("node", "n", "c")
    within = _within_groups(members, sets_of(members.select("node")), p, q)
    return first.unionByName(within).unionByName(met(_spread(labelled, own, False, main), _spread(labelled, own, True, main)))


def _sieve(rows: DataFrame, h: str):
    """A function of a column of hashes: may the hash be among those in ``h``? 2**SIEVE bits, whatever the rows."""
    import pyarrow as pa

    at = F.col(h).bitwiseAND(F.lit((1 << SIEVE) - 1))
    words = rows.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    sieve = np.zeros(1 << SIEVE - 6, np.int64)
    sieve[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(sieve)

    def may_be_in(hashes):
        at = hashes.to_numpy(zero_copy_only=False) & ((1 << SIEVE) - 1)
        return pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    may_be_in.__annotations__ = {"hashes": pa.Array, "return": pa.Array}
    return F.arrow_udf(may_be_in, "boolean")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies; texts are shuffled only where near copies are compared."""
    key = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    texts = docs.select(docs[doc_id].cast("bigint").alias("id"), key.alias("h"), docs[text].cast("string").alias("t"))
    each = staged(_sketched(texts, shingle), "sketches")
    found = connected_components(similar_links(each, texts, shingle, similarity)).withColumnRenamed("node", "m")
    order = F.struct(F.col("id").isNull(), "id", "h")
    by_node = each.groupBy("node").agg(F.min(order).alias("first"))
    named = staged(by_node.join(found, by_node["node"] == found["m"], "left").select("node", "first", F.coalesce("component", "node").alias("top")), "named")
    least = named.groupBy("top").agg(F.min("first").alias("kept"))
    kept = staged(named.join(least, "top").select(F.col("node").alias("m"), "kept"), "kept")
    gone = each.join(kept, each["node"] == kept["m"]).where(order != F.col("kept")).select("id", "h").distinct()
    g_id, g_h = fresh(docs.columns, "gone_id", "gone_hash")
    gone = staged(gone.select(F.col("id").alias(g_id), F.col("h").alias(g_h)), "gone")
    # Without an id the hash alone names a row; the two kinds never match each other.
    named_id, nameless = (F.coalesce(c, F.lit(0)) for c in (docs[doc_id].cast("bigint"), gone[g_id])), (docs[doc_id].cast("bigint").isNull(), gone[g_id].isNull())
    a, b = named_id
    same = (key == gone[g_h]) & (a == b) & (nameless[0] == nameless[1])
    # Rows that stay aren't shuffled: at most MOST_SENT rows of 16 bytes are told to all tasks, beyond that a sieve of them.
    if gone.count() <= MOST_SENT:
        stay = docs.join(F.broadcast(gone), same, "left_anti")
    else:
        may_go = _sieve(gone, g_h)(key)
        stay = docs.where(~may_go).unionByName(docs.where(may_go).join(gone, same, "left_anti"))
    # Only if rows repeat are texts shuffled to make one row of several.
    if each.groupBy("id", "h").count().where("count > 1").isEmpty():
        return stay
    (row_hash,) = fresh(docs.columns, "row_hash")
    return stay.withColumn(row_hash, F.xxhash64(F.coalesce(stay[text].cast("string"), F.lit("")))).dropDuplicates([doc_id, row_hash]).drop(row_hash)
