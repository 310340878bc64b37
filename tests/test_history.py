"""Small change logs with known answers; now is 2024-06-01 12:00 UTC."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.operators import activity, clustering, compare, coupling, effort, experience, knowledge

NOW = datetime(2024, 6, 1, 12)
SCHEMA = "commit_hash string, date timestamp, file_path string, lines_added long, lines_deleted long, author_name string, author_email string"
SIZES = "file_path string, file_size long"


def log(spark, *rows):
    """rows: (commit, file, days ago, added, deleted, author)."""
    full = [(c, NOW - timedelta(days=d), f, a, x, who, f"{who.lower()}@example.com") for c, f, d, a, x, who in ((*r, *(None, None, 0, 10, 5, "Alice")[len(r) :]) for r in rows)]
    return spark.createDataFrame(full, SCHEMA)


def hot(spark, rows, sizes=()):
    frame = activity.hotspots(log(spark, *rows), spark.createDataFrame(list(sizes), SIZES), str(NOW), 90)
    return {r["file_path"]: r for r in frame.collect()}


def test_one_file(spark):
    row = hot(spark, [("c1", "a.py")])["a.py"]
    assert (row["change_frequency"], row["code_churn"], row["rework_ratio"], row["hotspot_score"], row["file_size"]) == (1, 15, 0.0, 1.0, 0)


def test_decay_halves_both_parts_in_a_half_life(spark):
    rows = hot(spark, [("c1", "a.py", 0), ("c2", "b.py", 30)])
    assert rows["a.py"]["hotspot_score"] == 1.0 and rows["b.py"]["hotspot_score"] == 0.25


def test_churn_is_relative_to_size(spark):
    rows = hot(spark, [("c1", "small.py", 0, 60, 40), ("c2", "big.py", 0, 60, 40)], [("small.py", 100), ("big.py", 10000)])
    assert rows["small.py"]["hotspot_score"] > rows["big.py"]["hotspot_score"]


def test_two_rows_of_a_commit_are_one_touch(spark):
    row = hot(spark, [("c1", "a.py", 0, 10, 5), ("c1", "a.py", 0, 20, 10)])["a.py"]
    assert (row["change_frequency"], row["code_churn"]) == (1, 45)


@pytest.mark.parametrize(("days", "within", "share"), [((1, 2, 3), 14, 0.6667), ((0, 5, 30), 14, 0.3333), ((0, 10), 10, 0.5), ((0, 10), 5, 0.0), ((3,), 14, 0.0)])
def test_rework(spark, days, within, share):
    rows = log(spark, *((f"c{d}", "a.py", d) for d in days))
    assert round(activity.file_activity(rows, str(NOW), rework_days=within).first()["rework_ratio"], 4) == share


def test_window_has_both_ends(spark):
    rows = log(spark, ("c1", "a", 0), ("c2", "a", 90), ("c3", "a", 91))
    assert activity.in_window(rows, str(NOW), 90).count() == 2


def test_empty_log(spark):
    none = log(spark, ("c", "a")).limit(0)
    sizes = spark.createDataFrame([], SIZES)
    assert activity.hotspots(none, sizes, str(NOW), 90).count() == 0
    assert knowledge.files(none, str(NOW), 90).count() == 0
    assert knowledge.gini(none, str(NOW), 90).first()[0] == 0.0
    assert coupling.pairs(none, str(NOW), 90).count() == 0
    assert clustering.clusters(none, str(NOW), 90)["k"] == 0


def test_concentration(spark):
    one = knowledge.files(log(spark, ("c1", "a.py")), str(NOW), 90).first()
    two = knowledge.files(log(spark, ("c1", "a.py", 0, 10, 5, "Alice"), ("c2", "a.py", 0, 10, 5, "Bob")), str(NOW), 90).first()
    assert one["knowledge_concentration"] == 1.0 and one["is_knowledge_island"]
    assert two["knowledge_concentration"] == 0.0 and two["author_count"] == 2


def test_island_and_shares(spark):
    rows = log(spark, ("c1", "a.py", 0, 90, 0, "Alice"), ("c2", "a.py", 0, 10, 0, "Bob"))
    row = knowledge.files(rows, str(NOW), 90).first()
    assert row["primary_author_pct"] == 0.9 and row["is_knowledge_island"] and row["primary_author"] == "alice@example.com"
    assert [a["proportion"] for a in knowledge.with_authors(rows, str(NOW), 90).first()["authors"]] == [0.9, 0.1]


@pytest.mark.parametrize(("sums", "value"), [((60, 25, 15), 0.3), ((5,), 0.0), ((5, 5), 0.0), ((0, 0), 0.0)])
def test_gini(spark, sums, value):
    rows = log(spark, *((f"c{i}", "a.py", 0, x, 0, f"P{i}") for i, x in enumerate(sums)))
    assert knowledge.gini(rows, str(NOW), 90).first()[0] == value


def test_pair(spark):
    rows = log(spark, ("c1", "b"), ("c1", "a"), ("c2", "a"), ("c2", "b"), ("c3", "c"))
    (row,) = coupling.pairs(rows, str(NOW), 90).collect()
    assert (row["file_a"], row["file_b"], row["shared_commits"], row["coupling_strength"], row["expected_cochange"], row["lift"], row["support"]) == ("a", "b", 2, 1.0, 1.3333, 1.5, 0.6667)


def test_lift_of_one_is_no_pair(spark):
    assert coupling.pairs(log(spark, ("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b")), str(NOW), 90).count() == 0


def test_pain(spark):
    rows = log(spark, ("c1", "a", 0, 20, 10), ("c2", "b", 0, 300, 0), ("c3", "b", 0, 0, 0), ("c4", "b", 0, 0, 0), ("c5", "a", 0, 0, 0))
    got = {r["file_path"]: r for r in coupling.pain(rows, coupling.pairs(rows, str(NOW), 90), str(NOW), 90).collect()}
    assert got["a"]["size_normalized"] == 0.1 and got["a"]["volatility_normalized"] == 0.6667 and got["a"]["pain_score"] == 0.0


def test_comparison(spark):
    fields = "file_path string, change_frequency long, code_churn long, hotspot_score double"
    before = spark.createDataFrame([("gone", 1, 1, 0.5), ("up", 1, 1, 0.1), ("same", 1, 1, 0.2), ("down", 2, 9, 0.9)], fields)
    after = spark.createDataFrame([("new", 1, 1, 0.5), ("up", 2, 3, 0.4), ("same", 1, 1, 0.2), ("down", 1, 1, 0.1)], fields)
    got = compare.compare_hotspots(before, after)
    assert {r["file_path"]: r["status"] for r in got.collect()} == {"gone": "removed", "new": "new", "up": "degraded", "same": "unchanged", "down": "improved"}
    assert tuple(compare.counts(got).first()) == (1, 1, 1, 1)
    assert compare.only_in(after, before).first()[0] == "new" and compare.in_both(before, after).count() == 3


@pytest.mark.parametrize(("days", "value"), [((0, 10, 20), 1 / 11), ((0, 1, 30), 1 / 16), ((0,), 1.0), ((0, 1, 2), 0.5), ((0, 0), 1.0)])
def test_density(spark, days, value):
    rows = log(spark, *((f"c{i}", "a", d) for i, d in enumerate(days)))
    assert activity.commit_density(rows, str(NOW), 90).first()["commit_density"] == pytest.approx(value)


def test_distribution(spark):
    scored = spark.createDataFrame([("a", 0.9, 50), ("b", 0.5, 30), ("c", 0.5, 15), ("d", 0.1, 5)], "file_path string, hotspot_score double, code_churn long")
    assert {r[0]: r[1] for r in activity.effort_distribution(scored).collect()} == {50: 1, 80: 2, 90: 3}


@pytest.mark.parametrize(("at", "name"), [((0.5, 0.8, 0.8), "feature"), ((0.1, 0.1, 0.7), "bugfix"), ((0.7, 0.6, 0.45), "refactoring"), ((0.1, 0.1, 0.3), "config"), ((0.4, 0.4, 0.5), "mixed"), ((0.0, 0.0, 0.0), "config")])
def test_labels(spark, at, name):
    frame = spark.createDataFrame([at], "a double, b double, c double")
    assert frame.select(clustering.label(frame["a"], frame["b"], frame["c"])).first()[0] == name


def test_kmeans_finds_clear_groups():
    import numpy as np

    points = np.repeat([[0.0, 0, 0], [0.5, 0.5, 0.5], [1, 1, 1]], 10, axis=0) + np.random.default_rng(3).random((30, 3)) / 50
    counts, order = np.ones(30, int), np.arange(30)
    assert clustering.choose_k(points, counts, order) == 3
    assert clustering.choose_k(points[:2], counts[:2], np.arange(2)) == 2
    _, at = clustering.kmeans(points, counts, order, 3)
    assert [len(set(at[i : i + 10])) for i in (0, 10, 20)] == [1, 1, 1] and len(set(at)) == 3


def test_silhouette_ends():
    import numpy as np

    two = np.array([[0.0, 0, 0], [1.0, 1, 1]])
    assert clustering.silhouette(two, np.ones(2, int), np.zeros(2, int)) == 0.0
    assert clustering.silhouette(two, np.ones(2, int), np.array([0, 1])) == 0.0
    assert clustering.silhouette(two, np.array([3, 3]), np.array([0, 1])) == 1.0


def test_silhouette_of_triples_is_that_of_commits():
    import numpy as np

    rng = np.random.default_rng(0)
    points = rng.random((12, 3))
    counts, at = rng.integers(1, 4, 12), rng.integers(0, 3, 12)
    wide = np.repeat(np.arange(12), counts)
    assert clustering.silhouette(points, counts, at) == pytest.approx(clustering.silhouette(points[wide], np.ones(len(wide), int), at[wide]))


def test_drift(spark):
    rows = [(f"c{i}", NOW - timedelta(days=80 if early else 10), 0 if early else 1) for i, early in enumerate([True, True, False, False])]
    points = spark.createDataFrame(rows, "commit_hash string, date timestamp, cluster int")
    named = spark.createDataFrame([(0, "feature"), (1, "config")], "cluster_id int, label string")
    got = {r["cluster_id"]: r for r in clustering.drift(points, named, str(NOW), 90).collect()}
    assert got[0]["trend"] == "shrinking" and got[1]["trend"] == "growing" and got[1]["drift"] == 100.0


def test_ridge_recovers_a_line():
    import numpy as np

    x = np.random.default_rng(1).random((200, 6))
    y = x @ np.array([2.0, 3.0, 0, 0, 0, 0])
    sums = {f"x{i}{j}": x[:, i] @ x[:, j] for i in range(6) for j in range(i, 6)} | {f"y{i}": x[:, i] @ y for i in range(6)}
    beta = effort.solve(sums, 0.001)
    assert beta[0] == pytest.approx(2, abs=0.1) and beta[1] == pytest.approx(3, abs=0.1)


def test_effort_of_few_files_weighs_alike(spark):
    fields = ", ".join(f"z_{c} double" for c in effort.NAMES) + ", proxy double"
    alpha, beta, score = effort.fit(spark.createDataFrame([(0.0,) * 7, (1.0,) * 7], fields))
    assert list(beta) == [1 / 6] * 6 and score == 0.0 and alpha == 1.0


def summaries(spark, *rows):
    return spark.createDataFrame(list(rows), "label string, size long")


def test_experience_parts(spark):
    assert experience.throughput(summaries(spark, ("feature", 10000)), 1).first()[0] == 1.0
    assert experience.throughput(summaries(spark).limit(0), 1).first()[0] == 0.0
    assert experience.focus(summaries(spark, ("feature", 5))).first()[0] == 1.0
    assert experience.focus(summaries(spark, ("mixed", 5))).first()[0] == 0.5
    assert experience.focus(summaries(spark).limit(0)).first()[0] == 0.5


@pytest.mark.parametrize(("dense", "rework", "value"), [((0.9, 0.8), (0.1, 0.1), 0.765), ((0.1, 0.2), (0.9, 0.8), 0.0225), ((0.2, 0.4, 0.6), (0.1, 0.2, 0.3), 0.32)])
def test_feedback(spark, dense, rework, value):
    hotspots = spark.createDataFrame([(str(i), r) for i, r in enumerate(rework)], "file_path string, rework_ratio double")
    density = spark.createDataFrame([(str(i), d) for i, d in enumerate(dense)], "file_path string, commit_density double")
    assert experience.feedback(hotspots, density).first()[0] == pytest.approx(value, abs=1e-4)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["c1", "c2", "c3"]), st.sampled_from(["a", "b", "c"]), st.integers(0, 80), st.integers(0, 50), st.integers(0, 50), st.sampled_from(["Al", "Bo"])), min_size=1, max_size=12))
def test_ranges_hold(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    frame = log(spark, *rows)
    for r in knowledge.files(frame, str(NOW), 90).collect():
        assert -1e-3 <= r["knowledge_concentration"] <= 1
    for r in coupling.pairs(frame, str(NOW), 90).collect():
        assert 0 <= r["coupling_strength"] <= 1 and r["file_a"] < r["file_b"]
    for r in activity.hotspots(frame, spark.createDataFrame([], SIZES), str(NOW), 90).collect():
        assert 0 <= r["hotspot_score"] <= 1 and 0 <= r["rework_ratio"] < 1


@pytest.mark.parametrize(("commits", "different"), [(0, 200_000), (1_000_000, 2)])
def test_triples_are_numbered_in_log_order_at_every_size(spark, monkeypatch, commits, different):
    monkeypatch.setattr(clustering, "LOG_ORDER_COMMITS", commits, raising=False)
    monkeypatch.setattr(clustering, "MAX_TRIPLES", different, raising=False)
    rows = [(f"c{i}", NOW - timedelta(days=i), float(i * 7 % 4), 0.5, 1.0) for i in range(12)]
    scaled = spark.createDataFrame(rows, "commit_hash string, date timestamp, n_file_count double, n_total_churn double, n_add_ratio double")
    points, counts, order = clustering.triples(scaled)
    assert [points[i][0] for i in order] == [r[2] for r in rows] and counts.tolist() == [3, 3, 3, 3]
