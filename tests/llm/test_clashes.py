"""Operators and the pipeline on tables whose extra columns have the names that they themselves use."""

import re

import pytest

import corpus_pipeline
from tensorfold.llm import html_text, lsh_search, mixing, multi_index, sentencepiece_codec, similar_texts, simhash, token_files, toxicity, url_filter, warc

MODULES = html_text, lsh_search, mixing, multi_index, sentencepiece_codec, similar_texts, simhash, token_files, toxicity, url_filter, warc


def own_names():
    """Every name that the modules use in a string, as a column or otherwise."""
    found = set()
    for module in MODULES:
        with open(module.__file__) as f:
            found |= set(re.findall(r"[\"' (,]([A-Za-z_][A-Za-z0-9_]{0,24})(?=[\"' ,)])", f.read()))
    words = {"target", "source_size", "taken", "size", "score", "offending", "rs", "rn", "rr", "_tie", "_part", "_inside", "_copy", "_cut", "component", "fp", "node", "bucket", "c0", "c1", "k0", "t", "h", "id", "kept", "gone_id", "gone_hash"}
    used = {"doc_id", "text", "source", "lang", "n_chars", "vec_id", "embedding", "label", "page_id", "url", "html"}
    return sorted({n.lower() for n in (found & words) | words} - used) + sorted(n for n in found if n.startswith("_") and n.lower() not in words)[:40]


@pytest.fixture(scope="module")
def extra():
    names, seen = [], set()
    for n in own_names():
        if n.lower() not in seen and n not in ("__future__", "__init__"):
            seen.add(n.lower())
            names.append(n)
    return names


TEXTS = [(1, "you vilest scoundrel thing. " * 3, "a"), (2, "one two three four five six", "a"), (3, "one two three four five six", "b"), (4, "", "b"), (5, None, None), (None, "lost words here", "a"), (2, "one two three four five six", "a"), (6, "a b c " * 3000, "b")]


def table(spark, extra, rows=TEXTS):
    data = [(i, t, "en", s, len(t or ""), *[f"{name}:{k}" for name in extra]) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in extra))


def intact(rows, extra):
    for r in rows:
        assert len({r[name].rpartition(":")[2] for name in extra}) == 1 and all(r[name].startswith(f"{name}:") for name in extra)


@pytest.mark.parametrize("kind", ["rows", "none"])
def test_operators_keep_clashing_columns(spark, extra, kind):
    docs = table(spark, extra) if kind == "rows" else table(spark, extra).limit(0)
    for make in (mixing.apply_mix, simhash.near_dedup, similar_texts.drop_similar):
        out = make(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        intact(rows, extra)
        assert bool(rows) == (kind == "rows")
    assert mixing.mix(docs).count() == docs.count() == simhash.simhash_components(docs).count()
    model = toxicity.ToxicityModel({"scoundrel": 9.0}, -6.0)
    names = ("the_score", "the_sentences")
    scored = toxicity.score_documents(docs, model, names=names)
    assert scored.columns == [*docs.columns, *names]
    intact(scored.collect(), extra)
    if kind == "rows":
        assert sorted((r.doc_id or 0) for r in scored.collect() if r.the_score >= 0.5) == [1]


@pytest.mark.parametrize("kind", ["rows", "none"])
def test_pipeline_keeps_clashing_columns(spark, extra, tmp_path, kind):
    docs = table(spark, extra) if kind == "rows" else table(spark, extra).limit(0)
    sf = str(tmp_path)
    spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    found = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.staged(stage(spark, found, sf), name)
        assert found.columns == docs.columns
        intact(found.collect(), extra)
    whole = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(whole.columns) and bool(whole.collect()) == (kind == "rows")
