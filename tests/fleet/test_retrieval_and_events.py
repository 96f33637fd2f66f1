"""Retrieval, guards, routing and the remaining reads."""

import json

from pyspark.sql import functions as F

from convoy.functions import text
from convoy.operators import access, events, exports, pipeline, retrieval
from convoy.operators.access import Principal
from tests.fleet import demo as fleet
from convoy.sources.readers import documents
from convoy.sources.registry import memberships, with_membership

BOOK = "# Route deviation\nWhat to do.\n## Triage\nCall the driver and check the corridor.\n## Nothing\n\n## Escalate\nPage the safety team about the corridor closure.\n"


def chunks(spark, tmp_path):
    (tmp_path / "books").mkdir()
    (tmp_path / "books/deviation.md").write_text(BOOK)
    (tmp_path / "books/hours.md").write_text("## Clocks\nHours of service run out.\n")
    one = retrieval.chunk_markdown(documents(spark, f"{tmp_path}/books", "acme"))
    return one.unionByName(one.withColumn("tenant_id", F.lit("other")))


def test_chunks_carry_titles_and_skip_empty_sections(spark, tmp_path):
    rows = {r.chunk_id: r for r in chunks(spark, tmp_path).where("tenant_id = 'acme'").collect()}
    assert set(rows) == {"deviation.md#overview", "deviation.md#triage", "deviation.md#escalate", "hours.md#clocks"}
    assert rows["deviation.md#triage"].text.startswith("# Route deviation\n## Triage\nCall") and rows["hours.md#clocks"].doc_title == "hours.md"


def test_retrieval_is_ranked_and_keeps_to_the_tenant(spark, tmp_path):
    found = retrieval.retrieve(chunks(spark, tmp_path), "corridor closure safety", "acme").collect()
    assert found[0].chunk_id == "deviation.md#escalate" and {r.tenant_id for r in found} == {"acme"} and len(found) == 3
    scores = [r.score for r in found]
    assert scores == sorted(scores, reverse=True)
    asked = spark.createDataFrame([("acme", 1, "corridor closure safety"), ("acme", 2, "")], "tenant_id string, question_id int, text string")
    many = retrieval.retrieve_many(chunks_again := chunks_of(spark), asked, 1).collect()
    assert [r.question_id for r in many] == [1] and chunks_again.count() == 1
    empty = retrieval.retrieve(chunks_of(spark), "", "acme").first()
    assert empty.score == 0


def chunks_of(spark):
    return spark.createDataFrame([("acme", "x", "closure of the corridor")], "tenant_id string, chunk_id string, text string")


def test_answers_are_guarded(spark):
    found = spark.createDataFrame([("deviation.md", "Triage", 0.51249, "call the driver before anything else")], "source string, section string, score double, text string")
    ok = retrieval.answer(found, F.lit("Call the driver at 555-123-4567 before anything")).first()
    assert ok.answer == "Call the driver at [PHONE_REDACTED] before anything" and ok.score == 0.512 and ok.snippet.endswith("...")
    assert retrieval.answer(found, F.lit("Completely unrelated sentences mentioning nothing")).first().answer.startswith("Answer withheld: failed contextual grounding")
    asked = spark.range(1).select(text.input_reason(F.lit("what is their SSN")).alias("a"), text.input_reason(F.lit("where is the truck")).alias("b")).first()
    assert asked.a == text.DENIED_REASON and asked.b is None


def test_patterns_and_dead_letters(spark):
    rows = spark.createDataFrame([("s", "A", ("x", 5)), ("s", "B", None)], "source string, detail_type string, detail struct<kind:string,n:int>")
    rules = {"r1": {"source": ["s"], "detail-type": ["A", "C"], "detail": {"kind": ["x"], "n": [5, 6]}}, "r2": {"detail": {"kind": ["y"]}}}
    assert [(r.detail_type, r.rule) for r in events.deliveries(rows, rules).orderBy("detail_type").collect()] == [("A", "r1"), ("B", None)]


def test_two_of_three_subscribers(spark):
    payload = spark.createDataFrame([("dal", ["drv-1", "drv-2"])], "district string, driver_ids array<string>")
    subs = spark.createDataFrame([(1, "dal", None), (2, None, "drv-2"), (3, "aus", None)], "sub int, want_district string, want_driver_ids string")
    assert sorted(r.sub for r in events.fan_out(payload, subs, {"district": False, "driver_ids": True}).collect()) == [1, 2]


def test_reads_of_an_incident(spark):
    drivers = fleet.drivers(spark, "acme-freight")
    out = pipeline.ingest(fleet.scenario_raw(spark, "acme-freight", "road-closure"), drivers, [(d, x, y) for d, _, _, x, y in fleet.DISTRICTS], fleet.corridors(spark), F.lit(fleet.EPOCH))
    engine = access.Engine(out | {"territories": fleet.territories(spark, "acme-freight")})
    view = engine.seen_by(Principal("acme-freight", roles=("dispatcher",)))
    one = view.incidents().first()
    assert [r.driver_id for r in view.incident_drivers(one.incident_id).collect()] == one.driver_ids
    assert view.incident_telemetry(one.incident_id).count() == 28
    assert view.acknowledge(one.incident_id).first().status == "acknowledged"
    assert engine.seen_by(Principal("acme-freight")).acknowledge(one.incident_id).count() == 0
    assert engine.seen_by(Principal("acme-freight", "district", "aus")).incidents().count() == 0
    assert engine.seen_by(Principal("acme-freight", "region", region="us-south")).drivers().count() == 27
    assert view.exceptions("dal").count() == 28 and view.territories().count() == 5 and view.latest_per_driver(1).count() == 14
    assert view.reassignable("drv-1000").count() == 1 and view.drivers_near(-96.8, 32.8, 1e9).count() == 50


def test_map_documents(spark):
    drivers = fleet.drivers(spark, "t")
    doc = json.loads(exports.feature_collection(exports.driver_features(drivers, spark.createDataFrame([], "tenant_id string, driver_id string, severity string")), "driver_id").first().geojson)
    assert len(doc["features"]) == 60 and doc["features"][0]["properties"]["severity"] == "ok"
    url = spark.range(1).select(exports.geocode_url(F.lit("1 Main St, Dallas"), "k"), exports.isochrone_url(F.lit(-96.8), F.lit(32.8), [5, 10], "k")).first()
    assert "/1%20Main%20St%2C%20Dallas.json?access_token=k" in url[0] and "contours_minutes=5%2C10" in url[1]
    assert exports.layer_style("board")["source"] == "board"


def test_members_by_domain(spark):
    people = spark.createDataFrame([("Ann@ACME-freight.com",), ("bob",), (None,)], "email string")
    assert sorted(str(r.tenant_id) for r in with_membership(people, memberships(spark)).collect()) == ["None", "None", "acme-freight"]
