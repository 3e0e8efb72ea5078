"""Queries that go through all pairs without writing them."""

import os

from pyspark.sql import functions as F

from kinmesh.config import ScoringConfig
from kinmesh.operators import components, explanations
from kinmesh.plans import queries_run
from kinmesh.plans.pipeline import customer_run

DATA = "/root/testdata/sf0.001"


def _fresh(tmp_path) -> str:
    """The small tables under a path of their own, so that no other test has kept tables of them."""
    os.symlink(f"{DATA}/customer.parquet", tmp_path / "customer.parquet")
    return str(tmp_path)


def test_streamed_pairs_are_the_decided_ones(spark, tmp_path):
    run = customer_run(spark, _fresh(tmp_path))
    columns = ["pair_id", "a_key", "b_key", "score", "decision", "hard_conflicts", "signals_hit", "same_hash"]
    one, other = run.streamed().select(*columns), run.decided.select(*columns)
    assert one.count() == one.select("pair_id").distinct().count() > 0
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_preview_clusters_writes_no_pairs(spark, tmp_path):
    d = _fresh(tmp_path)
    got = queries_run.preview_clusters(spark, d).collect()
    run = customer_run(spark, d)
    assert not {"pairs", "decided"} & set(run.__dict__)
    strict = queries_run._strict(spark, d)
    clusters = components.sizes(strict.members).where("size > 1").count()
    assert [tuple(r) for r in got] == [(clusters, run.norm.count(), strict.decided.where("decision = 'REVIEW'").count())]


def test_thinned_links_connect_the_same(spark):
    rows = [(x, y, "AUTO_LINK") for x in range(40) for y in range(x + 1, 40) if x % 4 == y % 4] + [(1, 2, "REVIEW"), (5, 6, "REVIEW"), (3, 4, "REJECT")]
    decided = spark.createDataFrame(rows, "a_rid bigint, b_rid bigint, decision string").coalesce(1)
    links, reviews = components.thinned(decided)
    assert links.count() == 36 and reviews.collect()[0][0] == 2
    found = components.connected_components(links)
    assert {(r.customer_key, r.cluster_id) for r in found.collect()} == {(x, x % 4) for x in range(40)}
    none, zero = components.thinned(decided.where(F.lit(False)))
    assert none.isEmpty() and zero.collect()[0][0] == 0


def test_explain_view_writes_no_pairs(spark, tmp_path):
    d = _fresh(tmp_path)
    got = {r.pair_id: (r.judgement, r.model) for r in queries_run.explain_view(spark, d).collect()}
    run = customer_run(spark, d)
    assert not {"pairs", "decided"} & set(run.__dict__)
    made = {r.pair_id: r.judgement for r in explanations.made(run.decided, ScoringConfig()).select("pair_id", "judgement").collect()}
    assert got == {p: ("UNSURE", "written model") if p < "8" else (j, "rules") for p, j in made.items()}


def test_explanations_are_kept_small_and_whole(spark, tmp_path):
    """Ids of any kind come back as they were, the last of several appends counts in every column, files are compressed."""
    ids = ["0" * 64 + ":" + "f" * 64, "A" * 64 + ":" + "b" * 64, "é:\x00", "", ":", "0" * 64 + ":" + "e" * 64]
    path = str(tmp_path / "kept")
    for n in ("one", "two"):
        rows = spark.createDataFrame([(i, p, "r", n, "MATCH" if n == "one" else None, n, "1", "now") for i, p in enumerate(ids)], "explanation_id string, pair_id string, run_id string, explanation_text string, judgement string, model_name string, model_version string, created_at string")
        explanations.append(rows.withColumn("evidence_summary", F.struct(F.lit(0.5).alias("score"))), path)
    kept = explanations.read(spark, path)
    assert sorted((r.pair_id, r.explanation_text, r.judgement, r.model_name) for r in kept.collect()) == sorted((p, "two", "UNSURE", "two") for p in ids)
    assert all(f.endswith(".gz") for f in os.listdir(path) if f.startswith("part-"))
    plan = kept.select("judgement")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(explanation_text" not in plan
