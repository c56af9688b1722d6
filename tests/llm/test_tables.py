"""The queries on the whole of the smallest tables, against computations of their own."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from test_corpus import plain_fingerprint, shares
from tokenizers import Tokenizer

from tensorfold.llm import toxicity
from tensorfold.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(tiny):
    return pq.read_table(f"{tiny}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def vectors(tiny):
    rows = {r["vec_id"]: r["embedding"] for r in pq.read_table(f"{tiny}/embeddings.parquet").to_pylist()}
    good = {i: v for i, v in rows.items() if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    return sorted(rows), sorted(good), np.array([good[i] for i in sorted(good)], float)


def spans_of(library, text):
    pieces = library.encode(text, return_type="proto").pieces
    begin, end = (np.array([getattr(x, side) for x in pieces], np.int64) for side in ("begin", "end"))
    return zlib.crc32(end.astype("<i8").tobytes(), zlib.crc32(begin.astype("<i8").tobytes())), int((end - begin).sum())


def test_sentencepiece(spark, tiny, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {r.doc_id: r for r in QUERIES["op1_sentencepiece"](spark, tiny).collect()}
    assert len(out) == len(documents)
    for doc in documents:
        r, ids = out[doc["doc_id"]], library.encode(doc["text"] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode() if ids else b"").hexdigest()
        assert (r.spans_crc32, r.spanned_bytes) == spans_of(library, doc["text"] or "")


def components(n, near):
    """Least member of the component of each of n nodes; near(i) gives the neighbours."""
    least = list(range(n))
    for i in range(n):
        if least[i] == i:
            todo = [i]
            while todo:
                for j in near(todo.pop()):
                    if least[j] == j and j > i:
                        least[j] = i
                        todo.append(j)
    return least


def test_simhash(spark, tiny, documents):
    docs = sorted(documents, key=lambda d: d["doc_id"])
    fp = np.array([plain_fingerprint(d["text"]) for d in docs], np.uint64)
    least = components(len(docs), lambda i: np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2).tolist())
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, tiny).collect()}
    assert out == {d["doc_id"]: (f"{int(f):016x}", docs[k]["doc_id"]) for d, f, k in zip(docs, fp, least)}


def test_search(spark, tiny, vectors):
    _, ids, x = vectors
    out, hits, queries = {}, 0, [k for k, i in enumerate(ids) if i % 20 == 0]
    for r in QUERIES["op6_lsh_search"](spark, tiny).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(out) == [ids[k] for k in queries]
    for k in queries:
        s = x @ x[k]
        s[k] = -np.inf
        found = out[ids[k]]
        assert sorted(found) == list(range(1, min(20, len(ids) - 1) + 1))
        best = set(np.array(ids)[np.argsort(-s, kind="stable")[:20]].tolist())
        hits += len(best & {v for v, _ in found.values()})
        assert all(math.isclose(score, s[ids.index(v)], rel_tol=1e-12, abs_tol=1e-12) for v, score in found.values())
    assert hits >= 0.9 * 20 * len(queries)


def test_near_duplicate_vectors(spark, tiny, vectors):
    every, ids, x = vectors
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    least = components(len(ids), lambda i: np.flatnonzero(near[i]).tolist())
    out = {r.vec_id: r for r in QUERIES["op8_multi_index"](spark, tiny).collect()}
    assert sorted(out) == every
    assert sum(out[i].n_links for i in ids) >= 0.98 * near.sum()
    assert all(out[i].n_links <= near[k].sum() and out[i].kept == (out[i].component_id == i) for k, i in enumerate(ids))
    assert sum(out[i].component_id == ids[least[k]] for k, i in enumerate(ids)) >= 0.98 * len(ids)


def test_token_files(spark, tiny, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_files"](spark, tiny).collect()}
    start, expected = 0, {}
    for doc in sorted(documents, key=lambda d: d["doc_id"]):
        ids = [*library.encode(doc["text"] or "", add_special_tokens=False).ids, 2]
        expected[doc["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert out == expected


def plain_toxicity(model, text):
    """1 - prod(1 - q), sentences below one half together at most MOST_BACKGROUND in -log(1 - score)."""
    if model.prior is not None:
        return model.prior
    loud, quiet = 0.0, 0.0
    for sentence in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text or "") or [""]:
        z = model.bias
        for w in set(re.findall(r"[^\W\d_]+", sentence.lower())):
            z += sum(model.weights.get(f, 0.0) for f in [w, *("^" + w[:k] for k in (4, 5, 6) if len(w) >= k)])
        calm = math.log1p(math.exp(-abs(z))) + max(z, 0)
        if z >= 0:
            loud += calm
        else:
            quiet += calm
    return 1 - math.exp(-loud - min(quiet, 0.6))


def test_toxicity(spark, tiny, documents):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, tiny).collect()}
    assert len(out) == len(documents)
    for doc in documents:
        r = out[doc["doc_id"]]
        assert math.isclose(r.score, plain_toxicity(model, doc["text"]), abs_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(doc["doc_id"]).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)


def test_toxicity_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a. b"), (1, "a. b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model).collect()
    assert len(scored) == 3 and len({r.score for r in scored if r.doc_id == 1}) == 1


def plain_mix(docs):
    """Words that the mix takes of each of (id, text, source), ids distinct."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = [sum(size[i] for i, _, s in docs if s == x) for x in sources]
    taken = {}
    for x, whole, target in zip(sources, total, shares(total, (5, 2, 1), 3)):
        left = int(target + 1e-9)
        epochs = left // whole if whole else 0
        left -= epochs * whole
        for i in sorted((i for i, _, s in docs if s == x), key=lambda i: hashlib.md5(f"{i}:mix".encode()).hexdigest()):
            part = min(size[i], left)
            left -= part
            taken[i] = epochs * size[i] + part
    return taken


def test_mixing(spark, tiny, documents):
    out = {r.doc_id: r.taken for r in QUERIES["op2_mixing"](spark, tiny).collect()}
    expected = plain_mix([(d["doc_id"], d["text"], d["source"]) for d in documents])
    assert out == expected


def test_pipeline(spark, tiny):
    """Every stage on what its predecessor kept."""
    import corpus_pipeline as c
    from test_similar_texts import survivors

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    stages, rows = dict(c.STAGES), [docs.collect()]
    for name in list(stages)[:-1]:
        docs = c.staged(stages[name](spark, docs, tiny), name)
        rows.append(docs.collect())
    read, clean, apart, mixed = rows
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in read if plain_toxicity(model, r.text) < 0.5)
    assert {r.doc_id for r in apart} == survivors([(r.doc_id, r.text) for r in clean])
    taken = plain_mix([(r.doc_id, r.text, r.source) for r in apart])
    words, text = {}, {r.doc_id: WORD.findall(r.text or "") for r in apart}
    for r in mixed:
        own = WORD.findall(r.text)
        assert own == text[r.doc_id][: len(own)] and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
    assert words == {i: n for i, n in taken.items() if n}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tokens = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in c.run(spark, tiny).collect())
    ids = [(r.doc_id, library.encode(r.text)) for r in mixed]
    assert tokens == sorted((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids)
