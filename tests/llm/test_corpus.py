"""Mixing, near copies, toxicity, URL filter, HTML, WARC, and the pipeline."""

import base64
import gzip
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tensorfold.llm import components, html_text, mixing, simhash, toxicity, url_filter, warc
from tensorfold.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, source string, n_chars bigint, _size string"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "own") for i, t, s in rows], DOCS)


# ---- mixing ----------------------------------------------------------------------------------------------------


def shares(sizes, weights, most):
    """Targets by resharing the excess, one round after another."""
    total, full, target = sum(sizes), set(), {}
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        w = sum(weights[i % len(weights)] for i in open_)
        target = {i: rest * weights[i % len(weights)] / w for i in open_}
        over = [i for i in open_ if target[i] > most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in full else target[i] for i in range(len(sizes))]
        full.update(over)


def test_mix_targets_and_budgets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))), rng.choice(["a", "b", "b", "b", "b", "é", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (0, rows[0][1], rows[0][2])]
    docs = corpus(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", "é", None)}
    expected = dict(zip(("a", "b", "é", None), shares(list(size.values()), (5, 2, 1), 3)))
    for s in size:
        own = [r for r in out if r.source == s]
        assert all(r.source_size == size[s] and abs(r.target - expected[s]) < 1e-6 for r in own)
        assert sum(r.taken for r in own) == int(expected[s] + 1e-9)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert sorted(out) == sorted(mixing.mix(docs).collect())
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = corpus(spark, rows[:20]).withColumnRenamed("_size", "taken")
    assert mixing.mix(clash).count() == 20


# ---- near copies -----------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in ["", None, "One", "One TWO", "a b c d e f a b c", "É x é y", "w\x0bx\ty z"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_are_complete(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(300)]
    fps = set(base)
    for f in base[:150]:
        fps.add(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
        fps.add(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    table = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    for extra in (0, 9):
        assert {tuple(r) for r in simhash.links(table, extra=extra).collect()} == expected


def test_links_are_not_broadcast(spark, tmp_path):
    """The planner takes visits for as small as the fingerprints they are made of, and would send them all to the driver."""
    spark.createDataFrame([(7,), (5,), (-1,)], "fp bigint").write.parquet(f"{tmp_path}/distinct")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/distinct"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [(r.a, r.b) for r in found.collect()] == [(5, 7)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, j) for j in range(1001, 1300)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    expected = {x: root(x) for x in parent}
    table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = {r.node: r.component for r in components.connected_components(table).collect()}
    assert {k: v for k, v in expected.items() if k in got} == got
    assert set(expected) - set(got) <= {a for a, b in edges if a == b}
    assert components.connected_components(table.limit(0)).count() == 0


def test_near_dedup(spark):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    rows = [(5, text, "a"), (3, text, "a"), (3, text, "a"), (9, text.upper(), "b"), (7, " ".join(reversed(words)), "a"), (8, None, "a"), (2, "", "a"), (None, text, "c"), (None, "alone here", None)]
    docs = corpus(spark, rows).withColumnRenamed("_size", "component")
    found = sorted((r.id, r.component) for r in simhash.simhash_components(docs).collect() if r.id is not None)
    assert found == [(2, 2), (3, 3), (3, 3), (5, 3), (7, 7), (8, 2), (9, 3)]
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 7), (True, 0), (True, 0)]
    assert simhash.near_dedup(docs.limit(0)).count() == 0


# ---- toxicity --------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(200)]
    sentence = lambda: " ".join(rng.choice(plain) for _ in range(8)) + "."
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        parts = [sentence() for _ in range(6)]
        if toxic:
            parts[3] = f"you {rng.choice(['vilest', 'viler', 'scoundrel'])} thing."
        rows.append((i, " ".join(parts), "a"))
        labels.append((i, 1, int(toxic)))
    docs = corpus(spark, rows).withColumnRenamed("_size", "score")
    table = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1), (0, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, table)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    hit = out[next(i for i in held if i % 4 == 0)]
    text = dict((i, t) for i, t, _ in rows)[hit.doc_id]
    assert any("you " in text[s.begin : s.end] for s in hit.offending)
    edge = corpus(spark, [(1, None, "a"), (2, "", "a"), (None, "you scoundrel thing.", "a"), (3, "word1. " * 20000, "a")])
    scored = {r.doc_id: r.score for r in toxicity.score_documents(edge, model).collect()}
    assert scored[1] == scored[2] < 0.5 and all(0 <= s <= 1 for s in scored.values())
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, table.limit(0)).score("anything")[0] == 0.0


def test_noisy_or():
    model = toxicity.ToxicityModel({"bad": 6.0}, -5.0)
    q = lambda z: 1 / (1 + np.exp(-z))
    assert np.isclose(model.score("good day. bad day. fine")[0], 1 - (1 - q(-5)) ** 2 * (1 - q(1)))


# ---- urls ------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://Example.COM/en/x?y", "https://www.example.com/en/", "http://a.b.net/es/1#z", "ftp://net/fr/", "no scheme", None, "http://xnet/es/", "http://a.net", "x://host://y/z"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, none).collect()}
    assert out[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert out[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert out[2] == ("a.b.net", "/es/1", "net/es/", "block") and out[3] == ("net", "/fr/", "net/fr/", "block")
    assert out[4] == out[5] == ("", "", None, "allow") and out[6][2] is None and out[7] == ("a.net", "", None, "allow")
    assert out[8] == ("host:", "//y/z", None, "allow")


def test_reputation_shrinks(spark):
    rows = [("bad.x.org", 1)] * 40 + [("new.x.org", 1)] + [(f"h{i}.y.org", 0) for i in range(60)] + [("h1.y.org", 1)]
    out = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert out["bad.x.org"].bound > 0.5
    assert out["h1.y.org"].rate < 0.5 < out["new.x.org"].rate


# ---- html ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p>one<p>two <b>three</b>\n four", "one\n\ntwo three four"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><th>Name<th>Value<tr><td>longer<td>1</table>", "Name    Value\nlonger  1"),
        ("<table><tr><td>a<br>b<td>c<tr><td colspan=2>wide", "a  c\nb\nwide"),
        ("<style>.x{display:none}</style><p class=x>no</p><p hidden>no<p style='visibility: hidden'>no</p>yes", "yes"),
        ("<head><title>t</title></head><body><script>if (a < b) '</p>'</script>x<!-- no -->y", "xy"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("1 &lt; 2 &amp; 3&nbsp;4 <a title='>'>l</a> <", "1 < 2 & 3 4 l <"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<dl><dt>k<dd>v</dl>", "k\n  v"),
    ],
)
def test_html(html, text):
    assert html_text.render(html) == text


def test_html_of_any_size(spark):
    html_text.render("<div>" * 50000 + "x")
    assert html_text.render("<ul><li>" * 3000 + "x").endswith("x")
    for odd in ("<" * 100000, "<a " + 'x="' * 50000, "<p>" * 50000, "<!--" * 20000):
        html_text.render(odd)
    pages = spark.createDataFrame([(1, "<p>a", "t"), (None, None, "t")], "page_id bigint, html string, text string")
    assert {(r.page_id, r.text) for r in html_text.extract(pages).collect()} == {(1, "a"), (None, "")}


# ---- warc ------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    rows = [(4, "http://a/", "<p>x"), (2, "http://b/\r\nX: y", "<p>x"), (7, None, None), (9, "http://c/", ""), (5, "http://d/", "long é " * 90000), (2, "http://b/", "<p>x"), (None, "http://n/", "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages.repartition(3), path)
    read = lambda **o: warc.read_archives(spark, manifest=warc.manifest_of(path), **o)
    out = [r for r in read(verify=True).collect() if r.record_type != "warcinfo"]
    assert len(out) == len(rows)
    by_id = {}
    for r in out:
        by_id.setdefault(r.record_id.removeprefix(warc.NAME), []).append(r)
    assert [r.record_type for r in by_id["2"]] == ["response"] * 2 and by_id["4"][0].refers_to == warc.NAME + "2"
    assert by_id["9"][0].record_type == "revisit" and by_id["9"][0].payload_bytes == 0
    assert by_id["4"][0].payload_bytes == 4 and by_id["4"][0].payload == b"" and by_id["2"][0].payload == b"<p>x"
    long = by_id["5"][0]
    assert long.payload.decode() == rows[4][2] and long.payload_digest == base64.b32encode(hashlib.sha1(long.payload).digest()).decode()
    assert by_id[""][0].record_type == "response"
    some = read(payload=False).where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r.record_id for r in some.collect()] == [warc.NAME + "4"]
    # Archives by others: plain files, and members without sizes in their headers.
    record = warc.page_record(1, "http://p/", b"plain", None, True)
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.warc").write_bytes(record * 2)
    (tmp_path / "o/b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    other = warc.read_archives(spark, path=f"file://{tmp_path}/o").collect()
    assert [r.payload for r in other] == [b"plain"] * 4
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, manifest=warc.manifest_of(f"file://{tmp_path}/e")).count() == 0
    assert json.loads(json.dumps(warc.SCHEMA))


# ---- queries with SQL, and the pipeline ------------------------------------------------------------------------


@pytest.mark.parametrize("name", ORACLES)
def test_oracles(spark, tiny, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    found = QUERIES[name](spark, tiny)
    columns = sorted(found.columns)
    expected = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall(), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == expected
