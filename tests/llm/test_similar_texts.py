"""The pipeline's near copies against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tensorfold.llm import similar_texts


def plain_sets(texts):
    out = []
    for text in texts:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def survivors(rows):
    """Least ids of the components over all pairs with a Jaccard similarity of 0.8 or more."""
    sets, least = plain_sets([t for _, t in rows]), [i for i, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while True:
        new = list(least)
        for i, j in near:
            new[i] = new[j] = min(new[i], new[j])
        if new == least:
            return {i for (i, _), k in zip(rows, least) if i == k}
        least = new


def test_edited_copies_go(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 100, 300]))]
        texts.append(" ".join(w))
        for edits in (1, 2, 4, 8):
            v = list(w)
            for at in rng.sample(range(len(v)), edits):
                v[at] = "edited"
            texts.append(" ".join(v))
    texts += ["", None, "one two", "One  two", texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in similar_texts.drop_similar(docs).collect()} == survivors(rows)
    assert similar_texts.drop_similar(docs.limit(0)).count() == 0


def test_hot_anchors(spark, monkeypatch):
    """Groups of near copies in one anchor, and rows that repeat, share ids or have none."""
    monkeypatch.setattr(similar_texts, "HOT", 8)
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    texts = []
    for _ in range(120):
        v = list(base)
        for at in rng.sample(range(len(v)), rng.randrange(5)):
            v[at] = f"e{rng.randrange(9000)}"
        texts.append(" ".join(v))
    texts += [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in similar_texts.drop_similar(docs).collect()} == survivors(rows)


def test_visits_are_not_broadcast(spark, tiny, monkeypatch):
    """The planner takes visits for as small as the nodes they are made of, and would send them all to the driver."""
    plans, staged = [], similar_texts.staged

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    for hot in (similar_texts.HOT, 2):
        monkeypatch.setattr(similar_texts, "HOT", hot)
        monkeypatch.setattr(similar_texts, "staged", seen)
        similar_texts.drop_similar(spark.read.parquet(f"{tiny}/documents.parquet"))
        meet = [p for p in plans if "Join [bucket#" in p and "[at#" in p]
        assert meet and not any("BroadcastHashJoin [bucket#" in line and "[at#" in line for p in meet for line in p.split("\n"))
        plans.clear()


def test_pairs_far_below_the_threshold_are_not_compared(spark, monkeypatch):
    """A group of texts of similarities around 0.6: bits don't tell them from 0.8, parities of shingles do."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(90000)}" for _ in range(150)]
    texts = []
    for i in range(120):
        v = list(base)
        for at in rng.sample(range(4, len(v), 9), 2 if i < 30 else 4):
            v[at] = f"e{rng.randrange(90000)}"
        texts.append(" ".join(v))
    rows, close, staged = list(enumerate(texts)), [], similar_texts.staged

    def seen(df, name):
        out = staged(df, name)
        if name == "close":
            close.append(out.count())
        return out

    monkeypatch.setattr(similar_texts, "staged", seen)
    kept = {r.doc_id for r in similar_texts.drop_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == survivors(rows)
    sets = plain_sets(texts)
    near = sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in range(120) for j in range(i))
    assert 0 < near and sum(close) < 0.5 * 120 * 119 / 2


def join_rows(spark, since, on=""):
    """The most rows that any join (with ``on`` in its description) has made in executions from ``since`` on, and the next
    execution's number."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    ids = [runs.apply(i).executionId() for i in range(runs.size())]
    for run in (x for x in ids if x >= since):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = (node.metrics().apply(i) for i in range(node.metrics().size())) if "Join" in node.name() and on in node.desc() else ()
            for m in metrics:
                if m.name() == "number of output rows" and (found := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(found.get().replace(",", "").split()[0]))
    return most, max(ids, default=-1) + 1


def test_a_large_group_does_not_meet_pair_by_pair(spark):
    """A text and 500 copies with few to many edits each, of similarities around 0.6 among themselves."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(90000)}" for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(500):
        v = list(base)
        for at in rng.sample(range(len(v)), rng.choice([1, 2, 3, 4, 5, 6, 8, 10])):
            v[at] = f"e{rng.randrange(90000)}"
        texts.append(" ".join(v))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, since = join_rows(spark, 1 << 60)
    assert {r.doc_id for r in similar_texts.drop_similar(docs).collect()} == survivors(rows)
    most, _ = join_rows(spark, since)
    assert 0 < most < 0.25 * 501 * 500 / 2


def test_unrelated_texts_hardly_meet(spark):
    """Those that share an anchor have over a fifth of their bits in common by that alone."""
    rng = random.Random(31)
    rows = [(i, " ".join(f"w{rng.randrange(90000)}" for _ in range(30))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    _, since = join_rows(spark, 1 << 60)
    assert similar_texts.drop_similar(docs).count() == 6000
    assert join_rows(spark, since, "[at#")[0] < 100


def test_links_within_groups_by_all_pairs(spark):
    """Groups with one common text, with two, with shared edits, of sets of all sizes, without anything in common."""
    rng = np.random.default_rng(17)
    new = lambda n: [int(x) for x in rng.integers(-(1 << 62), 1 << 62, n)]
    sets = []
    for c, (bases, edits) in enumerate([([100], 20), ([100, 100], 20), ([37], 9), ([400], 60), ([3], 2), ([], 0)], 1):
        common, pool = [new(n) for n in bases], new(40)
        sets += [(c, common[0])] if c == 1 else []
        for i in range(70):
            if not common:
                sets.append((c, new(1 + i)))
                continue
            own, k = list(common[i % len(common)]), int(rng.integers(1, edits + 1))
            own = [x for at, x in enumerate(own) if at not in set(rng.integers(0, len(own), k).tolist())]
            sets.append((c, sorted({*own, *new(int(rng.integers(0, k + 1))), *(pool[j] for j in rng.integers(0, 40, i % 3 * k // 2))})))
    sets = [(c, s) for c, s in sets if s]
    members = spark.createDataFrame([(i, len(s), -c) for i, (c, s) in enumerate(sets)], "node bigint, n bigint, c bigint")
    held = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(sets)], "node bigint, s array<bigint>")
    for p, q in ((4, 5), (2, 3)):
        found = {(r.a, r.b) for r in similar_texts._within_groups(members, held, p, q).collect()}
        near = {(i, j) for j, (c, y) in enumerate(sets) for i, (k, x) in enumerate(sets[:j]) if c == k and q * len({*x} & {*y}) >= p * len({*x} | {*y})}
        assert found <= near and len(near) > 500

        def parts(links):
            least = list(range(len(sets)))
            while True:
                before = list(least)
                for i, j in links:
                    least[i] = least[j] = min(least[i], least[j])
                if before == least:
                    return least

        assert parts(found) == parts(near)


def test_parities_lose_no_pair():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 700, 6000):
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for k in (0, 1, n // 10, n):
            y = np.unique(np.concatenate([x[k:], rng.integers(0, 1 << 64, k, np.uint64)]))
            odd = similar_texts.parities(x) ^ similar_texts.parities(y)
            assert np.bitwise_count(odd.view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_rows_that_stay_are_not_shuffled(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256")
    try:
        told = similar_texts.drop_similar(docs)
        monkeypatch.setattr(similar_texts, "MOST_SENT", 0)
        sieved = similar_texts.drop_similar(docs)
        assert "SortMergeJoin" not in told._jdf.queryExecution().executedPlan().toString()
        kept = sorted(r.doc_id for r in told.collect())
        assert kept == sorted(r.doc_id for r in sieved.collect()) == sorted(survivors([(r.doc_id, r.text) for r in docs.collect()]))
        assert len(kept) < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_without_or_with_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(7, a, "x"), (7, b, "y"), (7, a, "x"), (9, a + " c", "z"), (None, b, "n"), (None, "alone", "n"), (None, "alone", "m"), (1, None, None), (0, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gone_id string").withColumn("row_hash", F.lit("own"))
    out = similar_texts.drop_similar(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    assert kept == sorted([(False, 7, a), (False, 7, b), (True, 0, "alone"), (False, 0, "")])
    assert {r.row_hash for r in out.collect()} == {"own"}


def test_recall_of_the_search(spark):
    """Pairs at just 0.8, each group of two by itself: what the anchors miss isn't made up for by others."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        w = [f"w{rng.randrange(90000)}" for _ in range(94)]
        v = list(w)
        v[20], v[60] = "other", "words"  # 90 shingles, 80 shared of 100
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    kept = similar_texts.drop_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = 600 - len(kept)
    assert {r.doc_id for r in kept} >= survivors(rows[:2]) and found >= 0.96 * 300


def test_pipeline_stage_by_all_pairs(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, tiny).collect()}
    assert kept == survivors([(r.doc_id, r.text) for r in docs.collect()])
