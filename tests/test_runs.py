"""Run records, snapshots, uploads, workbooks, explanations, reviews, settings and the audit log, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.config import OPEN_BLOCKING, ScoringConfig
from kinmesh.operators import audit, blocking, explanations, graph, lifecycle, review
from kinmesh.operators.normalize import normalize
from kinmesh.plans.pipeline import Run
from kinmesh.sources import staging, workbook
from kinmesh.storage import shared_dir


@pytest.fixture(scope="module")
def run(spark):
    r = Run(staging.demo(spark), OPEN_BLOCKING, ScoringConfig())
    _ = r.golden
    return r


def test_lifecycle(spark, run, tmp_path):
    store = lifecycle.RunStore(spark, str(tmp_path / "store"))
    assert store.runs().count() == 0 and store.cancel("none") is False
    with pytest.raises(KeyError):
        store.get("none")
    one = store.create("FULL", "first")
    with pytest.raises(ValueError):
        store.to(one, "COMPLETED")
    done = store.execute(one, run)
    assert (done["status"], done["records_in"], done["candidates_generated"], done["auto_links"], done["review_items"], done["rejected"]) == ("COMPLETED", 10, 21, 2, 2, 17)
    assert store.load("records", one).count() == 10 and store.load("clusters", one).select("cluster_id").distinct().count() == 8 and store.load("records", "none", attempts=1) is None
    with pytest.raises(ValueError):
        store.retry(one)
    two = store.create()
    store.to(two, "RUNNING")
    assert store.cancel(two) is True and store.cancel(two) is False
    three = store.retry(two)
    assert store.get(three)["description"].startswith(f"Retry of {two}")

    class Broken:
        raw = property(lambda self: 1 / 0)

    with pytest.raises(ZeroDivisionError):
        store.execute(three, Broken())
    assert store.get(three)["status"] == "FAILED" and store.get(three)["error_message"]
    assert {r.event_type for r in store.events().collect()} == {"RUN_STARTED", "RUN_COMPLETED", "RUN_FAILED"}
    store.save("records", two, run.norm.limit(3).withColumn("city_norm", F.lit("LATER")))
    merged = store.merged()
    assert merged.count() == 10 and merged.where("city_norm = 'LATER'").count() == 3
    store.export_json(str(tmp_path / "json"))
    assert store.import_json(str(tmp_path / "json")).count() == 3
    with pytest.raises(ValueError):
        store.reset()
    store.reset(really=True)
    assert store.runs().count() == 0 and store.events().count() == 1


def test_bootstrap(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS boot")
    try:
        assert set(lifecycle.bootstrap(spark, str(tmp_path), "boot")) == set(lifecycle.TABLES) and lifecycle.bootstrap(spark, str(tmp_path), "boot") == []
    finally:
        spark.sql("DROP DATABASE boot CASCADE")


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("CUSNMF,CUSNML\nJosé,Núñez\n".encode())
    (tmp_path / "b.csv").write_bytes("CUSNMF,CUSNML\nJosé,Núñez\n".encode("latin1"))
    (tmp_path / "empty.csv").write_text("CUSNMF,CUSNML\n")
    for name in ("a.csv", "b.csv"):
        assert tuple(staging.upload(spark, str(tmp_path / name)).first()) == ("José", "Núñez")
    for bad in ("x.pdf", "empty.csv"):
        with pytest.raises(ValueError):
            staging.upload(spark, str(tmp_path / bad))
    assert staging.staged(spark, None, str(tmp_path / "none.csv"), str(tmp_path / "a.csv")).count() == 1 and staging.staged(spark, None) is None
    assert staging.records_or_fallback(spark, None, str(tmp_path / "none.csv")).count() == 10
    assert staging.records_or_fallback(spark, None, str(tmp_path / "b.csv")).count() == 1


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("a & b", 1), (None, 2)], "name string, `n` int")
    path = str(tmp_path / "book.xlsx")
    workbook.write({"summary": df, "more": df.limit(1)}, path)
    assert [tuple(r) for r in staging.upload(spark, path).collect()] == [("a & b", "1"), (None, "2")]
    (tmp_path / "old.xls").write_bytes(b"no zip")
    with pytest.raises(ValueError):
        staging.upload(spark, str(tmp_path / "old.xls"))


def test_name_fallback_to_any_text(spark):
    df = spark.createDataFrame([(1, None, None, "xy", "Remark"), (2, None, None, "x", "y")], "ingest_seq bigint, CUSNMF string, MAILID string, A string, B string")
    assert {r.ingest_seq: r.name for r in staging.mapped(df).collect()} == {1: "Remark"}


def test_metadata_and_aliases(spark):
    raw = spark.createDataFrame([(1, "Ann", "Lee", "SUSP", "555-123-4567", "n/a")], "ingest_seq bigint, CUSNMF string, CUSNML string, CUSSTS string, TELENO string, MOBLNO string")
    for out in (normalize(raw).first(), normalize(staging.mapped(raw)).first()):
        assert (out.name_norm, out.phone_norm, out.metadata.status, out.metadata.landline) == ("ANN LEE", "5551234567", "SUSP", "555-123-4567")
    other = spark.createDataFrame([(1, "77", "Ann", "1980-02-03", "X 9")], "ingest_seq bigint, id string, fname string, date_of_birth string, national_id string")
    out = normalize(other).first()
    assert (out.source_customer_id, out.name_norm, out.dob_norm, out.natid_norm) == ("77", "ANN", "1980-02-03", "X9")


def test_explanations(spark, run, tmp_path):
    path = str(tmp_path / "cache")
    made = explanations.made(run.decided, ScoringConfig())
    explanations.append(made.withColumn("judgement", F.lit(None).cast("string")), path)
    (tmp_path / "cache" / "bad.json").write_text('{"pair_id": "x"}\nno json\n')
    kept = explanations.read(spark, path)
    assert kept.count() == 21 and {r.judgement for r in kept.collect()} == {"UNSURE"}
    view = {r.pair_id: r for r in explanations.view(run.decided, kept.limit(1), ScoringConfig()).collect()}
    assert len(view) == 21 and sum(r.judgement == "UNSURE" for r in view.values()) >= 1
    first = json.loads(made.toJSON().first())
    assert set(first["evidence_summary"]) == {"score", "signals_hit", "hard_conflicts", "field_comparisons", "automated"}


def test_reviews(spark, run):
    items = review.enqueue(run.decided.withColumn("signals", F.array_join("signals_hit", ",")), "r1").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert items.count() == 2
    pair = items.orderBy("pair_id").first().pair_id
    said = [(pair, "APPROVED", "same person", "2024-01-01 00:01:00", "eve"), (pair, "REJECTED", "too late now", "2024-01-02 00:00:00", "bob"), ("other", "APPROVED", "same person", "2024-01-01 00:00:00", "eve")]
    said = spark.createDataFrame(said, "pair_id string, decision string, reason string, at string, reviewer string").withColumn("at", F.col("at").cast("timestamp"))
    judged = review.apply(items, said)
    assert {r.pair_id: r.status for r in judged.collect()}[pair] == "APPROVED" and review.approved_links(judged).count() == 1
    assert [(r.event_type, r.actor) for r in review.events(judged).where(F.get_json_object("payload", "$.pair_id") == pair).orderBy("event_type").collect()] == [("DECISION_REVIEW", "SYSTEM"), ("REVIEW_APPROVED", "eve")]
    s = review.stats(judged).first()
    assert (s.pending, s.approved, s.rejected, s.total, s.avg_review_time_seconds) == (1, 1, 0, 2, 60.0)
    assert review.lookup(judged, pair_id=pair).count() == 1 == review.lookup(judged, review_id=review.lookup(judged, pair_id=pair).first().review_id).count()
    assert review.queue(judged, status="PENDING", run_id="r1").count() == 1


def test_graphs(spark, run):
    nodes, edges = graph.view(run.members, run.norm, limit=3, singletons=False)
    assert nodes.where("type = 'cluster'").count() == 2 and edges.count() == 4
    with pytest.raises(ValueError):
        graph.view(run.members, run.norm, limit=2001)
    nodes, edges = graph.preview(run.norm, run.decided, run.members)
    assert nodes.where("type = 'record'").count() == 10 and nodes.where("id like 'singleton_%'").count() == 2 and edges.where("type = 'REVIEW'").count() == 2
    pairs = blocking.preview_pairs(run.norm)
    assert pairs.count() == 45 and blocking.preview_pairs(run.norm, run.pairs, most=5).count() == run.pairs.count() and blocking.preview_pairs(run.norm, None, most=5).count() == 10
    node, edge = graph.projection(run.members, run.norm, run.golden)
    assert node.where("type = 'Entity'").count() == 8 and edge.count() == 10 and all(v for r in node.collect() for v in r.properties.values())


def test_settings():
    live = config.Live()
    live.update(auto=0.95, weight_name=0.3, max_block=50)
    assert (live.scoring.auto, live.scoring.weights["name"], live.scoring.weights["phone"], live.blocking.max_block) == (0.95, 0.3, 0.2, 50)
    with pytest.raises(ValueError):
        live.update(nothing=1)
    pytest.importorskip("yaml")
    text = "thresholds: {auto_link_min_score: 0.92}\nblocking:\n  max_block_size: 150\n  methods:\n  - {name: phone_last10, enabled: true}\n  - {name: natid_exact, enabled: false}\n  - {name: name_token, min_token_length: 3}\nreferee: {score_range: {min: 0.5, max: 0.7}}\n"
    b, s = config.from_policy(text)
    assert (b.methods, b.max_block, b.min_token, s.auto, s.review, s.gray) == (("phone_last10", "name_token"), 150, 3, 0.92, 0.55, (0.5, 0.7))
    with pytest.raises(ValueError):
        config.from_policy("blocking: {methods: [{name: none}]}")


def test_audit(spark):
    events = spark.createDataFrame([(k % 2, k, "RUN_STARTED", '{"b": 1, "a": 2}' if k else "no json", f"2024-01-01T00:00:{k:02}.5") for k in range(40)], "log bigint, seq bigint, event_type string, payload string, at string")
    chain = audit.chain(events)
    assert chain.where("seq = 2").first().payload == '{"a": 2, "b": 1}' and chain.where("seq = 0").first().payload == "no json"
    assert {(r.log, r.events, r.valid) for r in audit.verify(chain).collect()} == {(0, 20, True), (1, 20, True)}
    # an altered payload, an altered link, and a missing event, each found at its place
    for change, place in (({"payload": F.when(F.col("seq") == 10, "x").otherwise(F.col("payload"))}, 5), ({"prev_hash": F.when(F.col("seq") == 10, "x").otherwise(F.col("prev_hash"))}, 5)):
        got = {r.log: r.first_bad for r in audit.verify(chain.withColumns(change)).collect()}
        assert got == {0: place, 1: None}
    assert {r.log: r.first_bad for r in audit.verify(chain.where("seq != 10")).collect()} == {0: 5, 1: None}
    assert {r.log: r.first_bad for r in audit.verify(chain.where("seq > 1")).collect()} == {0: 0, 1: 0}
    assert audit.verify(chain.limit(0)).count() == 0
    assert chain.where(audit.known_type(F.col("event_type"))).count() == 40


def test_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Other:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Other())


def test_lsh_keys_meet_as_often_as_names_are_alike(spark):
    """Equal names share all bands, names without a common trigram none, and similar ones more than dissimilar ones."""
    names = [("a", "ALEXANDRINA LINDQUISTER"), ("b", "ALEXANDRINA LINDQUISTER"), ("c", "ALEXANDRINA LINDQUIST"), ("d", "ALEXANDER LINDHOLM"), ("e", "BOB"), ("f", "XY"), ("g", None)]
    keys = {r.k: set(r.v) for r in spark.createDataFrame(names, "k string, n string").select("k", blocking.lsh_keys(F.col("n")).alias("v")).collect() if r.v is not None}
    assert keys["a"] == keys["b"] and len(keys["a"]) == 4 and not keys["a"] & keys["e"] and keys["f"] == set()
    assert len(keys["a"] & keys["c"]) >= len(keys["a"] & keys["d"])
