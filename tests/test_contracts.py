"""Output contracts: the schema validator, the vocabularies, and the strict parser on texts that nobody promised to be good."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryframe.contracts import assets, vocabulary
from quarryframe.contracts.parser import PARSE_FAILURE, RANGE_FAILURE, SCHEMA_FAILURE, fence_body, grid_position, parse, strict_parser
from quarryframe.contracts.schema import compile_schema
from quarryframe.functions import columns as c

THING = {"id": 0, "category": "car", "bbox_2d": [1, 2, 3, 4], "motion_state": "stationary", "bev_x": 1.04, "bev_y": -0.04}
GOOD = {"critical_objects": [THING], "risk_factors": [{"factor": "object_near", "objects": [0]}], "yield_required": True, "speed_action": "STOP"}


def edit(**changes):
    return json.dumps(GOOD | changes)


def thing(**changes):
    return edit(critical_objects=[THING | changes])


def risk(**changes):
    return edit(risk_factors=[GOOD["risk_factors"][0] | changes])


CASES = [
    (json.dumps(GOOD), "ok", None),
    (f"x ```json\n{json.dumps(GOOD)}\n``` y", PARSE_FAILURE, "truncated"),
    (f" ```\n{json.dumps(GOOD)}\n``` ", "ok", None),
    ("", PARSE_FAILURE, "truncated"),
    (None, PARSE_FAILURE, "invalid"),
    ("null", PARSE_FAILURE, "truncated"),
    ("{truncated", PARSE_FAILURE, "truncated"),
    ("[1, 2}", PARSE_FAILURE, "invalid"),
    ("3", SCHEMA_FAILURE, "type"),
    ("[]", SCHEMA_FAILURE, "type"),
    ("{}", SCHEMA_FAILURE, "required"),
    (edit(speed_action="HALT"), SCHEMA_FAILURE, "enum"),
    (edit(speed_action=["STOP"]), SCHEMA_FAILURE, "enum"),
    (edit(extra=1), SCHEMA_FAILURE, "additionalProperties"),
    (edit(yield_required=1), SCHEMA_FAILURE, "type"),
    (edit(critical_objects={}), SCHEMA_FAILURE, "type"),
    (edit(critical_objects=[1]), SCHEMA_FAILURE, "type"),
    (edit(critical_objects=[THING] * 2), RANGE_FAILURE, "repeated_id"),
    (edit(critical_objects=[THING | {"id": i} for i in range(9)]), SCHEMA_FAILURE, "maxItems"),
    (edit(critical_objects=[], risk_factors=[]), "ok", None),
    (edit(critical_objects=[], risk_factors=[{"factor": "object_near", "objects": [0]}]), "ok", None),
    (edit(risk_factors=[{"factor": "object_near", "objects": [0]}] * 2), RANGE_FAILURE, "repeated_factor"),
    (edit(risk_factors=["object_near"]), SCHEMA_FAILURE, "type"),
    (risk(objects=[5]), RANGE_FAILURE, "unknown_ref"),
    (risk(objects=[9]), SCHEMA_FAILURE, "maximum"),
    (risk(objects=[]), SCHEMA_FAILURE, "minItems"),
    (risk(objects=[0, 0]), SCHEMA_FAILURE, "uniqueItems"),
    (risk(objects=[0, 0.0]), SCHEMA_FAILURE, "uniqueItems"),
    (risk(objects=[[0]]), SCHEMA_FAILURE, "type"),
    (risk(objects=[[0], [0]]), SCHEMA_FAILURE, "uniqueItems"),
    (risk(why=1), SCHEMA_FAILURE, "additionalProperties"),
    (risk(factor="Oncoming traffic"), "ok", None),
    (risk(factor="oncoming_vehicle"), SCHEMA_FAILURE, "enum"),
    (risk(factor="congestion"), SCHEMA_FAILURE, "enum"),
    (thing(bbox_2d=[1, 2, 1, 2]), "ok", None),
    (thing(bbox_2d=[3, 2, 1, 4]), RANGE_FAILURE, "corner_order"),
    (thing(bbox_2d=[1, 2, 1601, 3]), RANGE_FAILURE, "image_bounds"),
    (thing(bbox_2d=[-1, 2, 3, 4]), SCHEMA_FAILURE, "minimum"),
    (thing(bbox_2d=[1, 2, 3]), SCHEMA_FAILURE, "minItems"),
    (thing(bbox_2d=[1, 2, 3, 4, 5]), SCHEMA_FAILURE, "items"),
    (thing(bbox_2d=[1, 2, "3", 4]), SCHEMA_FAILURE, "type"),
    (thing(bbox_2d=[1, 2, 3, 10**400]), RANGE_FAILURE, "number_range"),
    (thing(bev_x=10**400), RANGE_FAILURE, "number_range"),
    (thing(bev_x=math.nan), "ok", None),
    (thing(bev_x=True), SCHEMA_FAILURE, "type"),
    (thing(id=99), SCHEMA_FAILURE, "maximum"),
    (thing(id=True), SCHEMA_FAILURE, "type"),
    (thing(id=0.0), "ok", None),
    (thing(id=0.5), SCHEMA_FAILURE, "type"),
    (thing(category="sedan"), "ok", None),
    (thing(category="Passenger  Cars"), "ok", None),
    (thing(category="vehicle"), SCHEMA_FAILURE, "enum"),
    (thing(category=[]), SCHEMA_FAILURE, "type"),
    (thing(motion_state="moving"), SCHEMA_FAILURE, "enum"),
    ("[" * 100_000, PARSE_FAILURE, "truncated"),
    ("[" * 50_000 + "]" * 50_000, PARSE_FAILURE, "truncated"),
    ('{"a":' * 30_000 + "1" + "}" * 30_000, PARSE_FAILURE, "invalid"),
    ("9" * 6000, PARSE_FAILURE, "truncated"),
    (risk(factor="\ud800"), SCHEMA_FAILURE, "enum"),
    (edit(**{"\ud800": 1}), SCHEMA_FAILURE, "additionalProperties"),
]


@pytest.mark.parametrize("text,status,keyword", CASES)
def test_parse(text, status, keyword):
    got = parse(text)
    assert got.status == status
    assert (keyword is None and got.errors == []) or got.errors[0][2] == keyword
    assert (got.output is None) == (status != "ok")


def test_all_errors_come_with_their_places():
    bad = edit(critical_objects=[THING | {"id": 8, "color": 1}, {"id": 1}], risk_factors=[{"factor": "x", "objects": [0, 9]}], speed_action=None)
    assert [e[1:] for e in parse(bad).errors] == [
        ("$.critical_objects[0]", "additionalProperties", '["color"]'),
        ("$.critical_objects[0].id", "maximum", None),
        *[("$.critical_objects[1]", "required", k) for k in ("category", "bbox_2d", "motion_state", "bev_x", "bev_y")],
        ("$.risk_factors[0].factor", "enum", "x"),
        ("$.risk_factors[0].objects[1]", "maximum", None),
        ("$.speed_action", "enum", "null"),
    ]
    long = edit(critical_objects=[THING | {"id": i} for i in range(8)] + [THING], risk_factors=[{"factor": "object_near", "objects": [], "b": 1, "a": 2}])
    assert [e[1:] for e in parse(long).errors] == [("$.critical_objects", "maxItems", "9"), ("$.risk_factors[0]", "additionalProperties", '["a", "b"]'), ("$.risk_factors[0].objects", "minItems", "0")]


def test_output_is_built_from_what_was_parsed():
    got = parse(thing(category="SUVs", motion_state="head-on", bev_x=2.25, bev_y=-0.04))
    assert json.loads(got.output)["critical_objects"] == [{"id": 0, "category": "car", "bbox_2d": [1.0, 2.0, 3.0, 4.0], "motion_state": "oncoming", "bev_x": 2.2, "bev_y": 0.0}]
    assert got.terms == [("SUVs", "car"), ("head-on", "oncoming")] and got.unmapped == [] and got.positions == ["top left"]
    left = parse(edit(critical_objects=[THING | {"category": "vehicle", "motion_state": "moving"}], risk_factors=[{"factor": "danger", "objects": [0]}]))
    assert left.unmapped == ["vehicle", "moving", "danger"] and left.n_objects is None
    scaled = parse(thing(bbox_2d=[0, 0, 784, 448]), source=(784, 448))
    assert json.loads(scaled.output)["critical_objects"][0]["bbox_2d"] == [0.0, 0.0, 1600.0, 900.0]
    assert parse(thing(bbox_2d=[0, 0, 5000, 5000]), size=None).status == "ok"
    with pytest.raises(ValueError):
        parse("{}", size=None, source=(1, 1))
    assert [grid_position(b, (1600, 900)) for b in ([800, 450, 800, 450], [1600, 900, 1600, 900], [0, 600, 1, 600])] == ["middle center", "bottom right", "bottom left"]


@pytest.mark.parametrize(
    "version,doc,status",
    [
        ("v1", {"critical_objects": [{"category": "anything", "bbox_2d": [1, 2, 3, 4], "coarse_position": "left", "behavior": "waits"}], "risk_factors": ["x", "x"], "reasoning": "r", "yield_required": False, "speed_action": "STOP"}, "ok"),
        ("v1", {"critical_objects": [], "risk_factors": [""], "reasoning": "r", "yield_required": False, "speed_action": "STOP"}, SCHEMA_FAILURE),
        ("v3", {"critical_objects": [{"category": "suv", "bbox_2d": [1, 2, 3, 4], "motion_state": "parked"}], "risk_factors": ["tailgating"], "reasoning": "r", "yield_required": False, "speed_action": "STOP"}, "ok"),
        ("v3", {"critical_objects": [], "risk_factors": ["congestion", "traffic jam"], "reasoning": "r", "yield_required": False, "speed_action": "STOP"}, SCHEMA_FAILURE),
        ("v4", {"critical_objects": [], "risk_factors": ["small_following_gap"], "reasoning": "r", "yield_required": False, "speed_action": "STOP"}, SCHEMA_FAILURE),
        ("v5", {"critical_objects": [], "risk_factors": [], "yield_required": False, "speed_action": "STOP"}, SCHEMA_FAILURE),
        ("v6", {"critical_objects": [], "risk_factors": ["Traffic  Jams"], "yield_required": False, "speed_action": "STOP"}, "ok"),
        ("v6", GOOD, SCHEMA_FAILURE),
        ("v7", GOOD | {"reasoning": "r"}, SCHEMA_FAILURE),
    ],
)
def test_versions_differ(version, doc, status):
    assert parse(json.dumps(doc), version).status == status


def test_unknown_versions_and_keywords_are_refused():
    with pytest.raises(ValueError):
        parse("{}", "v8")
    for schema in ({"oneOf": []}, {"additionalProperties": {}}, {"$ref": "#/$defs/none"}):
        with pytest.raises(ValueError):
            compile_schema(schema)
    assert assets.model_face("v4") == "v3" and assets.model_face("v7") == "v7"
    tree = compile_schema({"$ref": "#/$defs/node", "$defs": {"node": {"type": "array", "items": {"$ref": "#/$defs/node"}}}})
    assert list(tree([[], [[1]]], "$")) == [("$[1][0][0]", "type", None)]


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(st.characters(), max_size=8) | st.sampled_from(["car", "STOP", "object_near"]), lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.sampled_from(["id", "category", "bbox_2d", "factor", "objects", "critical_objects", "risk_factors", "x"]), inner, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from(["critical_objects", "risk_factors", "yield_required", "speed_action"]), st.sampled_from(assets.VERSIONS))
def test_no_value_stops_the_parser(value, key, version):
    for text in (json.dumps(value), edit(**{key: value})):
        got = parse(text, version)
        assert got.status in ("ok", PARSE_FAILURE, SCHEMA_FAILURE, RANGE_FAILURE)
        assert (got.status == "ok") == (not got.errors)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("`json\n {}\"a:1"), max_size=40))
def test_no_text_stops_the_parser(text):
    assert parse(text).errors
    fence_body(text)


def test_parser_as_a_column(spark):
    texts = [t.encode("utf-8", "replace").decode() if t else t for t, _, _ in CASES]
    rows = spark.createDataFrame(list(enumerate(texts)), "no int, text string").select("no", strict_parser()("text").alias("p")).orderBy("no").collect()
    assert [r["p"]["status"] for r in rows] == [s for _, s, _ in CASES]
    lone = spark.createDataFrame([(risk(factor="\ud800"),)], "text string").select(strict_parser()("text").alias("p")).first()["p"]
    assert lone["status"] == SCHEMA_FAILURE and lone["unmapped"] == ["?"]


def test_fences_are_read_alike_in_python_and_columns(spark):
    texts = ["```json\n1\n```", " ```\n1\n2\n ``` ", "```json\n1```", "```js\n1\n```", "a\n```\n1\n```", "```\n```", "```", "", "```json  \n\n1\n\n```\n\n", "``` json\n1\n```"]
    rows = spark.createDataFrame(list(enumerate(texts)), "no int, text string").select("no", c.fenced_body(F.col("text")).alias("b")).orderBy("no").collect()
    assert [r["b"] for r in rows] == [fence_body(t) for t in texts] == ["1", "1\n2", None, None, None, None, None, None, "\n1\n", None]


def test_vocabularies_refuse_collisions(spark):
    with pytest.raises(ValueError):
        vocabulary.known_terms({"car": ["Auto  mobile"], "bus": ["auto mobile"]})
    table = spark.createDataFrame([("v", "f", "car", ["auto mobile"]), ("v", "f", "bus", ["Auto  Mobile"])], "version string, field string, word string, synonyms array<string>")
    with pytest.raises(Exception, match="auto_mobile stands for"):
        vocabulary.term_table(table).collect()
    for version in assets.VERSIONS:
        for words in assets.vocabularies(version).values():
            assert set(vocabulary.known_terms(words).values()) == set(words)


def test_words_of_terms_are_the_same_in_python_and_in_a_join(spark):
    terms = vocabulary.term_table(vocabulary.vocabulary_table(spark, "v7"))
    texts = ["Sedans", "  suv ", "passenger\tcars", "class", "vehicle", None, "", "glass cone", "Traffic cones", "pedestrian", "PERSON", "semi-trailers"]
    rows = spark.createDataFrame(list(enumerate(texts)), "no int, text string")
    got = vocabulary.with_words(rows, terms, F.lit("v7"), F.lit("category"), "text").orderBy("no").collect()
    known = vocabulary.known_terms(assets.CATEGORIES)
    assert [r["word"] for r in got] == [t and vocabulary.word_of(t, known) for t in texts[:6]] + [None] + [vocabulary.word_of(t, known) for t in texts[7:]]
    assert [r["mapping"] for r in got if r["text"] in ("pedestrian", "Sedans", "vehicle", None)] == ["normalized", "unmapped", "unmapped", "canonical"]
