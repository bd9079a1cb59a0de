"""Vector and archive operators against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm import cover_tree, nearest, warc
from tidelens.llm._graph import components
from tidelens.llm._shared import scratch

VECTORS = "vec_id bigint, embedding array<float>, label int, cell int, n int, times int, list int, rank int, point int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4, 5, 6) for i, v, label in rows], VECTORS)


def vectors(seed, n, dim=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 6, dim))
    rows = []
    for i in range(n):
        v = base[int(r.integers(len(base)))] + r.standard_normal(dim) * r.choice([0.0, 0.15, 0.3, 2.0])
        rows.append((i, [float(x) for x in v.astype(np.float32) * (3 if i % 4 == 0 else 1)], None if i % 29 == 0 else int(i % 3)))
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] * dim]
    return rows + [(n + i, v, 1) for i, v in enumerate(odd)] + [(5, rows[5][1], rows[5][2]), (None, rows[6][1], rows[6][2])]


def usable(rows):
    return [(i, np.array(v, float), label) for i, v, label in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]


@pytest.mark.parametrize("block,cell", [(2048, 4096), (16, 20)])
@pytest.mark.parametrize("sent", [1 << 17, 0])
def test_cover_tree_finds_all_links(spark, monkeypatch, block, cell, sent):
    monkeypatch.setattr(cover_tree, "BROADCAST_NODES", sent)
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "CELL", cell)
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    rows = vectors(1, 240)
    good = [x for x in usable(rows) if x[2] is not None]
    n, part = [0] * len(good), list(range(len(good)))
    for i, (_, a, la) in enumerate(good):
        for j, (_, b, lb) in enumerate(good[:i]):
            if la == lb and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                n[i] += 1
                n[j] += 1
                x, y = part[i], part[j]
                part = [x if p == y else p for p in part]
    least = collections.defaultdict(list)
    for p, x in zip(part, good, strict=True):
        if x[0] is not None:
            least[p].append(x[0])
    want = [(x[0], n[i], min(least[part[i]], default=None)) for i, x in enumerate(good)]
    rest = collections.Counter(i for i, _, _ in rows) - collections.Counter(x[0] for x in good)
    want += [(i, 0, i) for i in rest.elements()]
    got = [(x["vec_id"], x["n_links"], x["component_id"]) for x in cover_tree.near_duplicates(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(n) > 100


def test_nodes_cover_their_points_and_levels_halve():
    x = np.random.default_rng(2).standard_normal((500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = cover_tree.CoverTree(x, leaf=8)
    for node, kids in enumerate(t.children):
        away = np.linalg.norm(x[t.members[node]] - x[t.centre[node]], axis=1)
        assert away.max() <= t.radius[node] + cover_tree.SLACK
        if kids:
            assert sorted(np.concatenate([t.members[k] for k in kids])) == sorted(t.members[node])
            assert all(t.radius[k] <= t.radius[node] / 2 + cover_tree.SLACK for k in kids if k not in t.rests)


def test_no_vectors(spark):
    assert cover_tree.near_duplicates(table(spark, vectors(1, 60)).limit(0)).count() == 0
    assert nearest.search(table(spark, vectors(1, 60)).limit(0), F.lit(True)).count() == 0


def test_search_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 64)
    monkeypatch.setattr(nearest, "BLOCK", 50)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    rows = vectors(3, 600)
    good = [x for x in usable(rows) if x[0] is not None]
    x, ids = np.stack([g[1] for g in good]), np.array([g[0] for g in good])
    got = collections.defaultdict(list)
    for r in nearest.search(table(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    asked = sorted({int(i) for i in ids if i % 20 == 0})
    assert sorted(got) == asked
    for q in asked:
        away = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        away[ids == q] = np.inf
        near = np.lexsort((ids, away))[:10]
        hits += len({i for i, _ in got[q]} & set(ids[near].tolist()))
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        assert all(np.isclose(s, away[ids == i].min(), rtol=1e-12, atol=0) for i, s in got[q])
    assert hits / (10 * len(asked)) >= 0.9


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1)]
    got = nearest.search(table(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2)]


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (None, 3), (2000, 1999)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 1999: 1999, 2000: 1999}


def test_archives_round_trip(spark, monkeypatch):
    big = "héllo " * 40_000
    pages = [(1, "http://a/ b\r\nX: y", "x" * 2000), (2, None, "x" * 2000), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x"), (6, "http://f", "x"), (7, "http://g", big), (8, "http://h", big), (None, "u", big), (2, None, "x" * 2000), (9, "w", "WARC/1.1\r\n\r\n\r\nWARC-Type: x\r\n" * 50)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id bigint, url string, html string, payload string, n int").repartition(2)
    folder = scratch(spark, "test")
    made = warc.write_archives(df, folder, archive_bytes=100)
    want = collections.Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        top = max(p for p, _, h in pages if p is not None and h == html) if len(raw) >= 1000 else i
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == top else "revisit", None if i == top else top)] += 1
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, folder, made).collect())
    assert got == want and made.agg(F.sum("records")).first()[0] == len(pages)
    chunks = warc.read_chunks(spark, folder, made).where("page_id = 8 AND record_type = 'response'").orderBy("chunk_no").collect()
    assert b"".join(c["data"] for c in chunks) == big.encode() and len(chunks) > 3 and max(len(c["data"]) for c in chunks) <= warc.CHUNK
    assert [c["payload_digest"] for c in chunks] == [hashlib.sha1(big.encode()[: c["payload_bytes"]]).hexdigest() for c in chunks]
    assert warc.read_records(spark, scratch(spark, "none"), warc.write_archives(df.limit(0), scratch(spark, "none"))).count() == 0


def test_long_urls_come_back_whole(spark):
    urls = ["http://a/" + "é" * 700_000, "u" * (1 << 20), None]
    df = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    folder = scratch(spark, "test")
    got = warc.read_records(spark, folder, warc.write_archives(df, folder)).orderBy("page_id").collect()
    assert [r["url"] for r in got] == urls and all(r["payload_bytes"] == 1 for r in got)


def test_small_lists_are_no_end_of_the_search(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 20)
    r = np.random.default_rng(6)
    rows = [(i, (100 * np.eye(8)[i % 7] + r.standard_normal(8)).tolist(), 1) for i in range(140)]
    rows += [(1000 + i, (100 * np.eye(8)[7] + r.standard_normal(8)).tolist(), 1) for i in range(3)] + [(2000 + i, r.standard_normal(5).tolist(), 1) for i in range(4)]
    monkeypatch.setattr(nearest, "fit", lambda sample, lists, k, recall: (np.eye(sample.shape[1]), 100 * np.eye(sample.shape[1]), 1))
    n = collections.Counter(x["query_id"] for x in nearest.search(table(spark, rows), F.col("vec_id") % 1000 == 0).collect())
    assert n == {0: 10, 1000: 10, 2000: 3}
