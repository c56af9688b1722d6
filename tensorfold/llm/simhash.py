"""SimHash near-duplicate detection by anchor-point covering.

The anchors are the words of a covering code: the perfect Golay code on 23 bits of the fingerprint (every
point is within 3 of exactly one codeword) times all settings of ``extra`` further bits (radius 0). The home
of a fingerprint is its nearest anchor. A fingerprint is replicated to every anchor within covering radius
plus threshold, so it meets, at the home of any fingerprint within the threshold, that fingerprint; they are
compared there. Each pair is found once, at the home of its smaller end, and none is missed whatever ``extra`` is.

Only distinct fingerprints take part in the search: copies meet in a sum made before the shuffle. Components
are computed over linked fingerprints and then joined back to the documents.

Nulls count as empty texts, whose fingerprint is zero. Rows with a null id get a fingerprint and a component
but never name one; a component of such rows only has a null id. Repeated rows come out repeated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

GOLAY_BITS, GOLAY_RADIUS = 23, 3
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the Golay code.
GOLAY_POLYNOMIAL = 0b110001110101
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash: a bit is set if over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    n, ones = max(1, len(w) - shingle + 1), np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        h = np.fromiter((xxh64_intdigest(g, seed) for g, _ in zip(grams, range(min(_CHUNK, n - lo)))), np.uint64, min(_CHUNK, n - lo))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of each row, fp as a signed long; whole texts, no shuffle."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(docs[doc_id].cast("bigint").alias("id"), docs[text].cast("string").alias("t")).mapInArrow(run, "id bigint, fp bigint")


class AnchorCode:
    """The covering code: anchors by nearness, computed from syndromes."""

    def __init__(self, extra: int, threshold: int):
        self.extra, self.threshold = extra, threshold
        most = GOLAY_RADIUS + threshold
        sets = [c for k in range(most + 1) for c in combinations(range(GOLAY_BITS), k)]
        words = np.array([sum(1 << i for i in c) for c in sets], np.int64)
        weight = np.array([len(c) for c in sets])
        self.steps = [np.array([self._syndrome(b << 8 * k) for b in range(256)], np.int64) for k in range(3)]
        order = np.lexsort((weight, syndromes := self.syndrome(words)))
        self.patterns = words[order]
        self.start = np.searchsorted(syndromes[order], np.arange(1 << 11))
        #: within[j][s]: how many patterns of syndrome s have a weight of at most the radius plus j.
        self.within = [np.bincount(syndromes[weight <= GOLAY_RADIUS + j], minlength=1 << 11) for j in range(threshold + 1)]

    @staticmethod
    def _syndrome(word: int) -> int:
        for i in range(31, 10, -1):
            if word >> i & 1:
                word ^= GOLAY_POLYNOMIAL << (i - 11)
        return word

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.steps[0][x & 255] ^ self.steps[1][x >> 8 & 255] ^ self.steps[2][x >> 16 & 127]

    def _split(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = fp & ((1 << GOLAY_BITS) - 1)
        return x, fp >> GOLAY_BITS & ((1 << self.extra) - 1), self.syndrome(x)

    def home(self, fp: np.ndarray) -> np.ndarray:
        x, e, s = self._split(fp)
        return x ^ self.patterns[self.start[s]] | e << GOLAY_BITS

    def visits(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, position in ``fp``) of every anchor that a fingerprint within the threshold may call home."""
        x, e, s = self._split(fp)
        anchors, owners = [], []
        for j in range(self.threshold + 1):
            n = self.within[self.threshold - j][s]
            who = np.repeat(np.arange(len(fp)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            code = x[who] ^ self.patterns[self.start[s[who]] + nth]
            for flips in combinations(range(self.extra), j):
                anchors.append(code | (e[who] ^ sum(1 << i for i in flips)) << GOLAY_BITS)
                owners.append(who)
        return np.concatenate(anchors), np.concatenate(owners)


def links(distinct: DataFrame, threshold: int = 2, extra: int | None = None) -> DataFrame:
    """(a, b), a < b, for all pairs of the distinct fingerprints ``fp`` that differ in 1 to ``threshold`` bits.

    ``extra`` sets how fine the anchors are: by default one more bit with each doubling of the table beyond
    some millions, so that an anchor's expected guests stay bounded. It doesn't change what is found.
    """
    import pyarrow as pa

    extra = extra if extra is not None else min(64 - GOLAY_BITS, max(9, distinct.count().bit_length() - 15))
    code = AnchorCode(extra, threshold)

    def fan_out(pick):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    fp = np.asarray(batch.column(0).slice(lo, 2048).to_numpy(zero_copy_only=False), np.int64)
                    anchor, of = pick(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(of)], names=["anchor", "fp"])

        return distinct.select("fp").mapInArrow(run, "anchor bigint, fp bigint")

    def visiting(fp):
        anchor, who = code.visits(fp)
        return anchor, fp[who]

    homes = fan_out(lambda fp: (code.home(fp), fp)).select("anchor", F.col("fp").alias("a"))
    guests = fan_out(visiting).select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # Merged: by the size of the fingerprints, which is all that the planner knows, it would send every visit to the driver.
    return homes.join(guests.hint("merge"), (homes["anchor"] == guests["anchor"]) & near).select("a", "b")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """(id, fp, component): the fingerprint of each row and the least id reachable through links."""
    each = staged(fingerprints(docs, doc_id, text, shingle), "simhash")
    distinct = staged(each.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    found = connected_components(links(distinct, threshold))
    # A fingerprint without links is its own component.
    named = staged(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("top")), "named")
    least = staged(named.groupBy("top").agg(F.min("first").alias("component")), "least")
    by_fp = staged(named.join(least, "top").select(F.col("fp").alias("_fp"), "component"), "component")
    return each.join(by_fp, each["fp"] == by_fp["_fp"]).select("id", "fp", "component")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the least id.

    Rows with a null id stay, as nothing can name them. Repeated rows of a kept id become one.
    """
    found = simhash_components(docs, doc_id, text, shingle, threshold)
    # Those that go are fewer than those that stay, and rows with a null id match none of them.
    ids = found.where("id is not null").groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("kept"))
    gone = ids.where("not kept").select(F.col("id").alias("_gone_id"))
    stay = docs.join(gone, docs[doc_id].cast("bigint") == gone["_gone_id"], "left_anti")
    # Only if ids repeat are texts shuffled to make one row of several.
    if docs.where(docs[doc_id].isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty():
        return stay
    return stay.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(stay.where(F.col(doc_id).isNull()))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Each document's fingerprint (3-word shingles) and component (links at 2 or fewer differing bits)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_components(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
