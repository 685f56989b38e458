"""Embedding links, components, URL filter and the pipeline."""

import math

import numpy as np
import pytest

from offerscope.llm import catalog, embedding_links, url_filter
from offerscope.llm.common import DOC_COLUMNS, Scratch
from offerscope.llm.components import components

from .conftest import PASSAGE, SF


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        parent[max(u, v)] = min(u, v)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()}
    assert got == union_find(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "c").count() == 0


def brute_links(rows, threshold):
    fine = [(v, np.asarray(e, float), lab) for v, e, lab in rows
            if lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    n, edges = {v: 0 for v, _, _ in rows}, []
    for i, (a, x, p) in enumerate(fine):
        for b, y, q in fine[:i]:
            if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[a] += 1
                n[b] += 1
                edges.append((a, b))
    return n, union_find(n, edges)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(25):
        centre = rng.standard_normal(16)
        for k in range(12):
            rows.append((len(rows), (centre + 0.18 * rng.standard_normal(16) * (k > 2)).astype(np.float32).tolist(), c % 3))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, rows[0][1], None),
             (1005, [float("inf")] * 16, 1), (1006, [], 1), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0), (1009, [1e-30, 2e-30], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r for r in embedding_links.link(frame, missed=1e-6).collect()}
    n, root = brute_links(rows, 0.93)
    assert {v: r["n_links"] for v, r in got.items()} == n
    assert {v: r["component_id"] for v, r in got.items()} == root
    assert all(r["kept"] == (v == root[v]) for v, r in got.items())


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_links, "BLOCK", 8)
    rng = np.random.default_rng(9)
    rows = [(k, (np.ones(8) + 0.05 * rng.standard_normal(8)).astype(np.float32).tolist(), 1) for k in range(60)]
    got = embedding_links.link(spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == 65 and {r["component_id"] for r in got} == {0}
    assert {r["n_links"] for r in got} == {64}


def test_recall_of_production_parameters(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(4)
    for v, e, lab in rows[:200]:       # a partner just above the threshold
        x = np.asarray(e, float)
        y = rng.standard_normal(len(x))
        y -= (x @ y) / (x @ x) * x
        y *= np.linalg.norm(x) / np.linalg.norm(y)
        rows.append((v + 100_000, (0.935 * x + math.sqrt(1 - 0.935 ** 2) * y).astype(np.float32).tolist(), lab))
    got = {r["vec_id"]: r["n_links"] for r in embedding_links.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    n, _ = brute_links(rows, 0.93)
    assert sum(got.values()) >= 0.95 * sum(n.values()) and all(got[v] <= n[v] for v in n)


def test_no_vectors(spark):
    assert embedding_links.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.fixture(scope="module")
def weights(spark):
    return url_filter.train(spark, url_filter.labelled_urls())


URLS = [("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("HTTP://EXAMPLE.org/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("https://x.com/FR/", "x.com", "/FR/", None, None),
        ("https://com/de/9#t", "com", "/de/9", "com/de/", "block"), ("https://telecom/de/9", "telecom", "/de/9", None, None), (None, "", "", None, None), ("no scheme.org/", "", "", None, None),
        ("http://", "", "", None, None), ("http://org", "org", "", None, None), ("x://y://z/w", "y:", "//z/w", None, None), ("http://e.org?/a", "e.org", "", None, None)]


def test_url_rules(spark, weights):
    frame = spark.createDataFrame([(k, u[0], "own") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(frame, url_filter.RULES, weights).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == (verdict or ("block" if got[k]["p_block"] >= url_filter.BLOCK_AT else "allow"))
    assert url_filter.judge(frame.where("false"), url_filter.RULES, weights).count() == 0


def test_url_model_on_held_out_names(spark, weights):
    bad = ["casino-bonus", "cheap-pills24", "ads-server", "spam-mail", "adult-chat", "free-torrent"]
    good = ["national-park", "the-observer", "rivers", "northumberland", "garden-city", "history-museum"]
    rows = [(k, f"https://{n}.example.com/en/{k}") for k, n in enumerate(bad + good)]
    got = {r["page_id"]: r["p_block"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), [], weights).collect()}
    assert min(got[k] for k in range(6)) > max(got[k] for k in range(6, 12))


def test_url_probability_equals_dense_form(spark, weights):
    from pyspark.sql import functions as F
    frame = spark.createDataFrame([(1, "https://www.spam-farm.example.org/aaaaaaa/aaaa")], "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    b = frame.select(url_filter.buckets(host, path).alias("b")).first()["b"]
    x = np.bincount(b, minlength=url_filter.BUCKETS)
    z = x @ np.asarray(weights[:-1]) / np.linalg.norm(x) + weights[-1]
    assert url_filter.judge(frame, [], weights).first()["p_block"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_pipeline_stages(spark, docs, no_docs):
    import corpus_pipeline as cp
    extra = [(10_001, PASSAGE, "en", "s", 1), (10_002, PASSAGE, "en", "s", 1), (10_003, "12 34", "en", "s", 1), (10_004, None, "en", "s", 1),
             (10_005, PASSAGE + "\nwrite to jane.roe@mail.example.com soon", "en", "s", 1),
             # A near copy that shares no line with the others: it is the next stage's to find.
             (9_999, PASSAGE + " tail", "en", "s", 1)]
    frame = docs.select(*DOC_COLUMNS).unionByName(spark.createDataFrame(extra, docs.schema))
    scratch = Scratch(spark, "test-pipeline")
    sizes = {}
    for name, stage in cp.STAGES:
        before, frame = frame, scratch.write(stage(spark, frame, SF), name)
        sizes[name] = (before.count(), frame.count())
        if name != "packing":
            assert frame.columns == DOC_COLUMNS
        if name == "language":
            gone = {r[0] for r in before.select("doc_id").subtract(frame.select("doc_id")).collect()}
            assert {10_003, 10_004} <= gone and len(gone) <= 4
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"] for r in frame.where("doc_id > 10000").collect()}
            assert texts == {10_001: PASSAGE, 10_005: "write to jane.roe@mail.example.com soon"}
        if name == "pii":
            assert frame.where("doc_id = 10005").first()["text"] == "write to [EMAIL] soon"
    assert sizes["ngram_jaccard"][1] < sizes["ngram_jaccard"][0] and sizes["pii"][0] == sizes["pii"][1]
    pieces = frame.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(pieces) == sizes["packing"][0] and all(r[1] == r[2] for r in pieces)
    empty = no_docs.select(*DOC_COLUMNS)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_line_dedup_stage_leaves_no_copy(spark):
    import corpus_pipeline as cp
    texts = ["a short line of only eight words stands\nfirst", "own\na short line of only eight words stands\n", "own\nfirst\nfirst\nlast", "first\n\nown"]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.remove_repeated_lines(spark, frame, SF).collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("own\n", 4), 2: ("last", 4)}


def test_near_duplicate_stage_keeps_one(spark):
    import corpus_pipeline as cp
    rows = [(3, PASSAGE, None, None, 1), (1, PASSAGE + " more", None, None, 1), (2, PASSAGE, None, None, 1), (2, PASSAGE, None, None, 1), (4, "", None, None, 0), (None, "", None, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0) for r in cp.keep_one_of_each_group(spark, frame, SF).collect()) == [0, 1, 4]


def test_near_duplicate_stage_judges_rows_by_their_own_text(spark):
    """Rows that share an id or have none: no text goes without a copy that stays."""
    import corpus_pipeline as cp
    other = " ".join(reversed(PASSAGE.split()[:18])) * 2

    def kept(rows):
        frame = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted(((r["doc_id"], r["text"]) for r in cp.keep_one_of_each_group(spark, frame, SF).collect()), key=repr)

    assert kept([(1, PASSAGE), (2, PASSAGE), (2, other)]) == [(1, PASSAGE), (2, other)]
    assert kept([(2, PASSAGE), (2, PASSAGE + " tail")]) in ([(2, PASSAGE)], [(2, PASSAGE + " tail")])
    assert kept([(None, PASSAGE), (None, PASSAGE)]) == [(None, PASSAGE)]
    assert kept([(None, PASSAGE), (7, PASSAGE)]) == [(7, PASSAGE)]
    assert kept([(3, None), (3, None), (None, None), (4, "")]) == [(3, None), (4, ""), (None, None)]
    assert catalog.ORACLES.keys() == {"op3_line_dedup", "op11_exact_dedup"}
