"""What a build does once, and does not do for rows that it drops; the short test of a schema agrees with the long one."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quarryframe.contracts import assets
from quarryframe.contracts.parser import strict_parser, strict_text
from quarryframe.contracts.schema import compile_schema, compile_test
from quarryframe.operators import dataset as ds
from quarryframe.operators import records as rc
from quarryframe.plans import chain_queries as cq
from quarryframe.plans import dataset_queries as dq
from quarryframe.plans import label_queries as lq
from quarryframe.plans.fixtures import Fixtures

GOOD = {"critical_objects": [{"id": 0, "category": "car", "bbox_2d": [0.0, 1.0, 2.0, 3.0], "motion_state": "stationary", "bev_x": 1.0, "bev_y": -2.5}], "risk_factors": [{"factor": "object_near", "objects": [0]}], "yield_required": True, "speed_action": "STOP"}


def places(value, at=()):
    yield at
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from places(v, (*at, k))


def changed(value, rng):
    """A copy with one to three places dropped, repeated or given another value."""
    out = json.loads(json.dumps(value))
    for _ in range(rng.randint(1, 3)):
        at = rng.choice([p for p in places(out) if p])
        holder = out
        for k in at[:-1]:
            holder = holder[k]
        what = rng.randint(0, 3)
        if what == 0:
            del holder[at[-1]]
        elif what == 1 and isinstance(holder, list):
            holder.append(holder[at[-1]])
        elif what == 1:
            holder["more"] = 1
        else:
            holder[at[-1]] = rng.choice([None, True, 0, 1, 1.0, 2.5, -1, 99, "", "STOP", "truck", [], {}, [0], [0, 0.0], "x" * 5000])
        if not isinstance(out, dict):
            break
    return out


@pytest.mark.parametrize("schema", [*(assets.output_schema(v) for v in assets.VERSIONS), rc.RECORD_SCHEMA], ids=[*assets.VERSIONS, "record"])
def test_the_short_test_agrees_with_the_violations(schema):
    rng = random.Random(7)
    check, holds = compile_schema(schema), compile_test(schema)
    long = compile_schema({"$defs": schema.get("$defs", {}), "prefixItems": [{k: v for k, v in schema.items() if k != "$defs"}, False]})
    seen = set()
    for value in [GOOD, None, [], "x", 1, *(changed(GOOD, rng) for _ in range(1500))]:
        # beside a second entry, which is refused, the violations are always listed
        told = [v for v in long([value, 0], "$") if v[0].startswith("$[0]")]
        assert holds(value) == (not told) == (not list(check(value, "$")))
        seen.add(holds(value))
    assert False in seen


def test_strict_text_is_the_output_of_the_parser(spark):
    rng = random.Random(3)
    texts = [json.dumps(GOOD), "```json\n" + json.dumps(GOOD) + "\n```", "{", None, *(json.dumps(changed(GOOD, rng)) for _ in range(60))]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select(strict_parser(size=None)("t").alias("p"), strict_text(size=None)("t").alias("text")).collect()
    assert [r["text"] for r in rows] == [r["p"]["output"] if r["p"]["status"] == "ok" else None for r in rows]
    assert any(r["text"] for r in rows) and any(r["text"] is None for r in rows)


def test_lines_are_checked_once(spark):
    lines = spark.createDataFrame([("train", 0, 0, "{}"), ("train", 0, 1, "")], "split string, shard long, line long, text string")
    found = ds.check_shards(lines, spark.createDataFrame([("a", "train", 0, 0, "h")], ds.INDEX))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    assert sorted((r["sample_token"] or "", r["problems"]) for r in found.collect()) == [("", ["blank"]), ("", ["unreadable"]), ("a", ["missing"])]


def test_only_wanted_keyframes_are_labelled(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    every = dq.labels(fx)
    wanted = every.where("sample_id % 3 = 0").select("sample_id")
    told = dq.labels(fx, wanted)
    assert 0 < wanted.count() < every.count()
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, every.where("sample_id % 3 = 0").collect()))


def test_image_boxes_without_numbers(spark):
    rows = [(None, 0.0, 2.0, 2.0), (1.0, 0.0, 2.0, 2.0), (5.0, None, 2.0, 2.0), (5.0, 1.0, 2.0, 2.0)]
    box = spark.createDataFrame(rows, "x double, y double, l double, w double").coalesce(1).select(lq.image_box("x", "y", "l", "w").alias("b")).select("b.*").collect()
    assert tuple(box[0]) == (None,) * 5
    # of the corners at depth 0 and 2 only those at depth 2 have a place
    assert tuple(box[1]) == (0.0, 150.0, 112.5, 650.0, 487.5)
    assert (box[2]["d"], box[2]["x1"], box[2]["x2"]) == (4.0, None, None) and box[2]["y1"] == 300 - 375 / 4
    assert tuple(box[3]) == (4.0, 400.0, 300 - 375 / 4, 650.0, 300 + 375 / 4)


def test_both_builds_run_side_by_side(spark, monkeypatch):
    met, build = threading.Barrier(2, timeout=120), cq.built
    paths = []

    def built(fx):
        met.wait()
        paths.append(build(fx))
        return paths[-1]

    monkeypatch.setattr(cq, "built", built)
    row = cq.rebuild_files(Fixtures(spark, "/root/testdata/sf0.001")).first()
    assert len({p for p, _ in paths}) == 2
    assert row["lines"] == paths[0][1]["counts"]["valid"] > 0 and row["same_lines"] and row["same_index"] and row["same_root"]
