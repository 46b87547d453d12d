"""Clustering against brute force, forest invariants, model files."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from logweave.operators import anomaly as N
from logweave.operators import patterns as P
from logweave.sources import tables as TB


def brute_dbscan(vectors, weights, ids, threshold, min_samples):
    """Labels by the definition: lowest core id of the component, lowest reachable for borders."""
    sims = {(a, b): sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) >= threshold - 1e-9
            for a in ids for b in ids if a != b}
    core = {a for a in ids if weights[a] + sum(weights[b] for b in ids if b != a and sims[a, b]) >= min_samples}
    label = {}
    for a in sorted(core):
        if a in label:
            continue
        todo = [a]
        while todo:
            v = todo.pop()
            if v in label:
                continue
            label[v] = a
            todo += [b for b in core if b != v and sims[v, b] and b not in label]
    for a in set(ids) - core:
        near = [label[b] for b in core if sims[a, b]]
        label[a] = min(near) if near else -1
    return label


def corpus(spark, seed, n=120):
    rng = random.Random(seed)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    bases = [rng.sample(words, 5) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = rng.random()
        text = rng.sample(words, 4) if kind < 0.2 else [w if rng.random() < 0.75 else rng.choice(words) for w in rng.choice(bases)]
        rows.append((i, " ".join(text + (["common"] if rng.random() < 0.6 else []))))
    rows += [(n, "of the and"), (n + 1, "zz only once")]
    return spark.createDataFrame(rows, "id long, message string")


@pytest.mark.parametrize("seed,block", [(1, 1000), (2, 4), (3, 7)])
def test_clusters_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(P, "_BLOCK", block)
    model = P.fit_patterns(corpus(spark, seed))
    vectors = {r["id"]: {e["r"]: e["w"] for e in r["vec"]} for r in model.vectors.collect()}
    tmpl = {r["id"]: r["n"] for r in model.templates.collect()}
    expected = brute_dbscan({i: vectors.get(i, {}) for i in tmpl}, tmpl, sorted(vectors), 0.5, 3)
    got = {r["id"]: r["cluster_id"] for r in model.clusters.collect()}
    assert got == {i: expected.get(i, -1) for i in tmpl}
    assert len(set(got.values())) > 3
    sizes = P.cluster_sizes(model.clusters, model.representatives).collect()
    assert [r["count"] for r in sizes] == sorted((r["count"] for r in sizes), reverse=True)


def test_embeddings_cluster_by_brute_force(spark, sf):
    """Dense vectors with known labels go through the same join."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    flat = [(int(i), 1, [(d, float(v)) for d, v in enumerate(np.maximum(e, 0) / np.linalg.norm(np.maximum(e, 0)))])
            for i, e in zip(rows["vec_id"], rows["embedding"])]
    vectors = spark.createDataFrame(flat, "id long, n long, vec array<struct<r:int,w:double>>")
    clusters = P.cluster_messages(vectors, vectors, eps=0.25)
    got = {r["id"]: r["cluster_id"] for r in clusters.collect()}
    dense = {i: dict(v) for i, _, v in flat}
    assert got == brute_dbscan(dense, {i: 1 for i in dense}, sorted(dense), 0.75, 3)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).select("id")
    edges = spark.range(199).where("id <> 99").select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    labels = {r["id"]: r["label"] for r in P.components(nodes, edges).collect()}
    assert labels == {i: 0 if i < 100 else 100 for i in range(200)}


def test_novelty(spark):
    known = [(i, f"disk {w} full on node {i}") for i, w in enumerate(["alpha", "beta", "gamma", "alpha"] * 4)]
    df = spark.createDataFrame(known, "id long, message string")
    model = P.fit_patterns(df)
    new = spark.createDataFrame([(1, "disk alpha full on node 9"), (2, "kernel panic elsewhere")], "id long, message string")
    got = {r["id"]: r["is_novel"] for r in P.novel_messages(new, model.tfidf, model.centers).collect()}
    assert got == {1: False, 2: True}
    assert {r["is_novel"] for r in P.novel_messages(new, None, None).collect()} == {False}
    assert P.fit_patterns(df.limit(5)) is None


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    x[:6] += 12
    pdf = pd.DataFrame({"window": range(600), "service_name": "s", "a": x[:, 0], "b": x[:, 1]})
    return spark.createDataFrame(pdf)


def test_forest_finds_outliers(spark, features):
    forest = N.iforest_fit(features, cols=["a", "b"], contamination=0.05)
    scored = N.iforest_score(features, forest).toPandas().sort_values("if_score")
    assert set(scored["window"][:6]) == set(range(6))
    assert scored["if_label"].eq(-1).sum() == pytest.approx(30, abs=2)
    assert ((scored["if_score"] < 0) == (scored["if_label"] == -1)).all()


def test_forest_ignores_partitioning(spark, features):
    first = N.iforest_fit(features, cols=["a", "b"]).nodes
    second = N.iforest_fit(features.repartition(7, "a"), cols=["a", "b"]).nodes
    key = ["tree", "node"]
    pd.testing.assert_frame_equal(first.sort_values(key).reset_index(drop=True), second.sort_values(key).reset_index(drop=True))
    assert first.groupby("tree").size().max() <= 511 and first["tree"].nunique() == 100


def test_paths_add_up():
    x = np.random.default_rng(0).normal(size=(64, 3))
    nodes = pd.DataFrame([[0, *n] for n in N._grow(x, np.random.default_rng(1), 6)],
                         columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    forest = N.Forest(nodes, ["a", "b", "c"], 64, 64)
    by_node = nodes.set_index("node").to_dict("index")

    def walk(v):
        at = 0
        while by_node[at]["feature"] >= 0:
            at = by_node[at]["left" if v[by_node[at]["feature"]] <= by_node[at]["threshold"] else "right"]
        return by_node[at]["path"]
    expected = [-2.0 ** (-walk(v) / float(N.average_path(64))) for v in x]
    assert N.score_rows(forest.arrays, 64, x) == pytest.approx(expected)


def test_average_path():
    harmonic = lambda n: math.log(n) + np.euler_gamma
    assert list(N.average_path([0, 1, 2])) == [0, 0, 1]
    assert float(N.average_path(256)) == pytest.approx(2 * harmonic(255) - 2 * 255 / 256)


def test_untrained(spark, features):
    assert N.iforest_fit(features.limit(9), cols=["a", "b"]) is None
    row = N.iforest_score(features, None).first()
    assert (row["if_score"], row["if_label"]) == (0.0, 1)


def test_model_files(spark, features, tmp_path):
    forest = N.iforest_fit(features, cols=["a", "b"])
    TB.save_model(spark, forest, str(tmp_path / "forest"))
    again = TB.load_model(spark, str(tmp_path / "forest"))
    assert (again.offset, again.features, again.trained_at) == (forest.offset, forest.features, forest.trained_at)
    model = P.fit_patterns(corpus(spark, 1))
    TB.save_model(spark, model.tfidf, str(tmp_path / "words"))
    words = TB.load_model(spark, str(tmp_path / "words"))
    assert P.vectorize(model.templates, words).count() == model.vectors.count()


def test_vocabulary_is_whole_and_ranked_over_all_ranges(spark):
    rows = [(i, f"word{i % 700:03d} common other{i % 3}", 1, "") for i in range(6000)]
    tmpl = spark.createDataFrame(rows, "id long, template string, n long, sample string")
    tfidf = P.tfidf_fit(tmpl, max_df=1.0)
    got = sorted((r["rank"], r["df"], r["term"]) for r in tfidf.vocabulary.collect())
    assert [r[0] for r in got] == list(range(len(got)))
    assert [r[1:] for r in got] == sorted(r[1:] for r in got)
    # 700 words, three others, the common one; each word before "common", and "common" before each other
    assert len(got) == 700 + 3 + 1 + 700 + 3
    capped = P.tfidf_fit(tmpl, max_features=10, max_df=1.0).vocabulary.collect()
    assert len(capped) == 10 and "common" in {r["term"] for r in capped}


def test_terms_are_counted_within_rows(spark):
    rows = [(1, "red blue red blue", 2), (1, "blue red", 2), (1, "blue green", 3), (2, "the", 1), (3, None, 4), (None, "red red", 1)]
    tmpl = spark.createDataFrame(rows, "id long, template string, n long")
    counts = P._term_counts(tmpl, ["the"])
    # texts may be shuffled, the far larger number of their terms not
    assert "term" not in "".join(line for line in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line)
    assert sorted(map(tuple, counts.where("id = 1").collect())) == [
        (1, 2, "blue", 3), (1, 2, "blue red", 2), (1, 2, "red", 3), (1, 2, "red blue", 2), (1, 3, "blue", 1), (1, 3, "blue green", 1), (1, 3, "green", 1)]
    fitted = {r["term"]: (r["df"], r["total"]) for r in P.tfidf_fit(tmpl, max_df=1.0, min_df=1, stop_words=["the"]).vocabulary.collect()}
    assert fitted == {"blue": (5, 9), "blue red": (2, 4), "red": (3, 8), "red blue": (2, 4), "blue green": (3, 3), "green": (3, 3), "red red": (1, 1)}


def test_rows_that_share_many_terms_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = 2300
    x = np.zeros((m, 80))
    for v in x:
        v[rng.choice(80, 14, replace=False)] = rng.random(14) + 0.1
    x[:, 0] = 0.3 * (rng.random(m) < 0.9)
    x /= np.linalg.norm(x, axis=1)[:, None]
    n, core = rng.integers(1, 4, m), rng.random(m) < 0.5
    rows = [(i + 10, int(n[i]), [(int(t), float(v[t])) for t in np.flatnonzero(v)], bool(core[i])) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "id long, n long, vec array<struct<r: long, w: double>>, core boolean").repartition(5).cache()
    assert P._blocks(vectors, 0.7).count() <= 8 * m  # by terms it is over twenty vectors a row
    monkeypatch.setattr(P, "_blocks", lambda v, threshold: P._row_blocks(v, 2))  # blocks of more than a thousand rows
    similar = (x @ x.T >= 0.7 - 1e-9) & ~np.eye(m, dtype=bool)
    near = {r["id"] - 10: r["near"] for r in P._neighbours(vectors.drop("core"), 0.7).collect()}
    assert near == {i: c for i, c in enumerate((similar @ n).tolist()) if c}

    label = np.arange(m)
    while True:
        best = np.where(similar & core & core[:, None], label, m).min(axis=1)
        new = np.minimum(label, best)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    links = P._links(vectors, 0.7).cache()
    found = P.components(vectors.where("core"), links.where("NOT border"))
    assert {r["id"] - 10: r["label"] - 10 for r in found.collect()} == {i: int(label[i]) for i in range(m) if core[i]}
    border = {(r["a"] - 10, int(label[r["b"] - 10])) for r in links.where("border").collect()}
    assert border == {(i, int(label[k])) for i, k in zip(*np.nonzero(similar & core)) if not core[i]}


@pytest.mark.parametrize("strip,tile,columns", [(1 << 14, 512, 1024), (200, 64, 5), (64, 7, 0)])
def test_rows_are_compared_by_strips(spark, monkeypatch, strip, tile, columns):
    for name, value in (("_STRIP_ROWS", strip), ("_TILE_ROWS", tile), ("_COLUMNS", columns), ("_PRODUCTS", 1000), ("_SIDE_ROWS", 100)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(5)
    m = 700
    x = np.zeros((m, 90))
    for v in x:
        v[rng.choice(80, 24, replace=False)] = rng.random(24) + 0.1
    x[:40] = 0
    for k, v in enumerate(x[:40]):  # products of exactly a half
        v[[80 + k % 2, 82 + k % 3, 85 + k % 5]] = [0.5, 0.5, np.sqrt(0.5)]
    x[40:60] = x[60:80]
    x /= np.linalg.norm(x, axis=1)[:, None]
    n, core = rng.integers(1, 4, m), rng.random(m) < 0.5
    ids = rng.permutation(m) * 3
    rows = [(int(i), int(k), [(int(t), float(v[t])) for t in np.flatnonzero(v)], bool(c)) for i, k, v, c in zip(ids, n, x, core)]
    vectors = spark.createDataFrame(rows, "id long, n long, vec array<struct<r: long, w: double>>, core boolean").repartition(3).cache()
    assert P._blocks(vectors, 0.5) is None  # a shuffle would send every row six times at least
    monkeypatch.setattr(P, "_blocks", lambda v, threshold: None)
    for threshold in (0.5, 0.62):
        similar = (x @ x.T >= threshold - 1e-9) & ~np.eye(m, dtype=bool)
        near = {r["id"]: r["near"] for r in P._neighbours(vectors.drop("core"), threshold).collect()}
        assert near == {int(i): int(c) for i, c in zip(ids, similar @ n) if c}
        links = P._links(vectors, threshold).cache()
        label = dict(zip(ids.tolist(), ids.tolist()))
        pairs = [(int(ids[i]), int(ids[k])) for i, k in zip(*np.nonzero(similar & core & core[:, None]))]
        while True:
            old = dict(label)
            for a, b in pairs:
                label[a] = min(label[a], label[b])
            if label == old:
                break
        found = {r["id"]: r["label"] for r in P.components(vectors.where("core"), links.where("NOT border")).collect()}
        assert found == {int(i): label[int(i)] for i, c in zip(ids, core) if c}
        border = {(r["a"], label[r["b"]]) for r in links.where("border").collect()}
        assert border == {(int(ids[i]), label[int(ids[k])]) for i, k in zip(*np.nonzero(similar & core)) if not core[i]}


def test_strips_are_bounded_and_hold_every_row(spark, monkeypatch):
    rows = [(i, 1, [(t, 0.1) for t in range(1 + i % 7)]) for i in range(900)]
    vectors = spark.createDataFrame(rows, "id long, n long, vec array<struct<r: int, w: double>>")
    packed = P._packed(vectors).cache()
    assert packed.count() == 900
    for held, m in ((1 << 22, 300), (700, 1 << 14)):
        monkeypatch.setattr(P, "_STRIP_ENTRIES", held)
        monkeypatch.setattr(P, "_STRIP_ROWS", m)
        strips = P._strips(packed)
        parts = [packed.where(F.col("no").between(*s)).select(F.octet_length("terms").alias("size")).collect() for s in strips]
        assert len(strips) > 2 and sum(map(len, parts)) == 900
        assert all(len(p) <= m and sum(r["size"] for r in p) <= 8 * held for p in parts)


def test_neighbours_of_rows_without_id_count(spark, monkeypatch):
    monkeypatch.setattr(P, "_blocks", lambda vectors, threshold: None)
    rows = [(1, 2, [(0, 1.0)]), (None, 5, [(0, 1.0)]), (1, 7, [(0, 1.0)]), (2, 1, [(1, 1.0)])]
    vectors = spark.createDataFrame(rows, "id long, n long, vec array<struct<r: int, w: double>>")
    assert [tuple(r) for r in P._neighbours(vectors, 0.5).collect()] == [(1, 5 + 7 + 2 + 5)]


def test_texts_with_ids_of_their_own_are_not_shuffled(spark):
    rows = [(1, "red blue red", 2), (2, "blue green", 3), (3, None, 4), (None, "red", 1), (4, "the of", 1)]
    tmpl = spark.createDataFrame(rows, "id long, template string, n long")
    plan = P._term_counts(tmpl, ["the", "of"], alone=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for made in (P._term_counts, P._term_totals):
        assert sorted(map(str, made(tmpl, ["the", "of"], alone=True).collect())) == sorted(map(str, made(tmpl, ["the", "of"]).collect()))
    assert P._term_counts(tmpl, ["the", "of"], alone=True).count() == 4 + 3 + 1


def test_messages_that_share_an_id_are_one_row(spark):
    """Ids that repeat, with the same count and with another, as the grouped way has them."""
    texts = ["disk alpha full", "disk alpha slow", "net beta down", "net beta lost", "cpu gamma hot", "cpu gamma cold"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts * 2)] + [(0, texts[0])], "id long, message string")
    model = P.fit_patterns(df)
    tmpl = P.templates(df)
    want = P.vectorize(tmpl, P.tfidf_fit(tmpl))
    shown = lambda v: sorted((r["id"], r["n"], len(r["vec"]), round(sum(e["w"] for e in r["vec"]), 9)) for r in v.collect())
    assert shown(model.vectors) == shown(want)
    assert len({(r["id"], r["n"]) for r in model.vectors.collect()}) == model.vectors.count() < 6
