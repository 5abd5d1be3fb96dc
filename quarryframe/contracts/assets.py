"""The versioned contracts as data: which fields an output has, what bounds they keep, and which words their vocabularies know."""

from __future__ import annotations

from typing import Any

VERSIONS = ("v1", "v2", "v3", "v4", "v5", "v6", "v7")
DEFAULT_VERSION = "v7"

# The words of each vocabulary with the open terms that mean them.
CATEGORIES = {
    "car": ["suv", "sedan", "hatchback", "van", "minivan", "taxi", "coupe", "passenger car"],
    "truck": ["pickup", "lorry", "dump truck", "delivery truck", "box truck"],
    "construction_vehicle": ["excavator", "bulldozer", "crane", "construction vehicle", "roadwork vehicle"],
    "bus": ["minibus", "coach", "shuttle bus", "city bus"],
    "trailer": ["semi-trailer", "semi", "caravan", "trailer truck"],
    "barrier": ["barricade", "road barrier", "construction barrier", "guardrail segment"],
    "motorcycle": ["motorbike", "motorcyclist", "moped", "scooter"],
    "bicycle": ["bike", "cyclist", "biker", "bicycle rider"],
    "pedestrian": ["person", "walker", "jaywalker", "man", "woman", "child"],
    "traffic_cone": ["cone", "traffic cones", "safety cone", "road cone"],
}
MOTION_STATES = {
    "stationary": ["parked", "stopped", "halted", "waiting", "idle", "not moving"],
    "same_direction": ["same lane", "moving ahead", "following", "moving with traffic", "driving ahead of ego"],
    "oncoming": ["opposite direction", "approaching head-on", "opposing lane", "head-on", "coming toward ego"],
    "crossing": ["crossing path", "jaywalking", "turning into ego lane", "cutting across", "lateral movement", "merging across"],
}
RISK_FACTORS = {
    "vru_crossing": ["jaywalking", "pedestrian on road", "person crossing", "pedestrian in path", "pedestrian crossing", "cyclist crossing", "bicycle crossing", "bicycle in path", "motorcycle crossing", "motorcycle cutting in", "vru crossing"],
    "vehicle_crossing": ["cut in", "cut-in", "cutin", "merging car", "merging vehicle", "lane change into ego lane", "vehicle cutting in", "vehicle crossing", "vehicle crossing ego path", "vehicle cutting across"],
    "lead_vehicle_braking": ["car ahead braking", "lead decelerating", "braking vehicle ahead", "leading car slowing down"],
    "stationary_obstacle": ["parked car in lane", "obstacle ahead", "stalled vehicle", "debris on road", "stopped vehicle in path", "stopped object near the ego path"],
    "object_near": ["object too close", "close object", "near object", "object very close to ego", "immediate obstacle nearby"],
    "oncoming_traffic": ["oncoming car", "opposing traffic", "vehicle in opposite lane", "oncoming lane traffic"],
}
#: The factors of v3; v4 to v6 have all but small_following_gap.
EARLIER_RISK_FACTORS = {
    "pedestrian_crossing": ["jaywalking", "pedestrian on road", "person crossing", "pedestrian in path", "pedestrian crossing"],
    "vehicle_merging": ["cut in", "cut-in", "cutin", "merging car", "merging vehicle", "lane change into ego lane", "vehicle cutting in"],
    "lead_vehicle_braking": ["car ahead braking", "lead decelerating", "braking vehicle ahead", "leading car slowing down"],
    "corridor_conflict": ["object in path", "obstacle in path", "path intrusion", "conflict point", "occupancy conflict"],
    "small_following_gap": ["tailgating", "close following", "small gap", "short following distance", "small time gap"],
    "stationary_obstacle": ["parked car in lane", "obstacle ahead", "stalled vehicle", "debris on road", "stopped vehicle in path"],
    "congestion": ["traffic jam", "heavy traffic", "queued traffic", "stop and go", "dense traffic ahead"],
    "oncoming_traffic": ["oncoming car", "opposing traffic", "vehicle in opposite lane", "oncoming lane traffic"],
}
SPEED_ACTIONS = ("ACCELERATE", "KEEP_SPEED", "DECELERATE", "STOP")
IMAGE_SIZE = (1600, 900)
MAX_OBJECTS = 8
#: Versions whose requests show the same prompt and vocabularies as an earlier one.
MODEL_FACES = {"v4": "v3"}


def number_of(version: str) -> int:
    if version not in VERSIONS:
        raise ValueError(f"there is no contract {version!r}; there are {', '.join(VERSIONS)}")
    return int(version[1:])


def model_face(version: str) -> str:
    """The version whose prompt a request of ``version`` shows."""
    number_of(version)
    return MODEL_FACES.get(version, version)


def vocabularies(version: str) -> dict[str, dict[str, list[str]]]:
    """Words and their open terms by field; versions before v3 take free text and have none."""
    n = number_of(version)
    if n < 3:
        return {}
    earlier = {k: v for k, v in EARLIER_RISK_FACTORS.items() if n == 3 or k != "small_following_gap"}
    return {"category": CATEGORIES, "motion_state": MOTION_STATES, "risk_factor": RISK_FACTORS if n >= 7 else earlier}


def output_schema(version: str) -> dict[str, Any]:
    """The JSON schema of a version's outputs."""
    n = number_of(version)
    text = {"type": "string", "minLength": 1}
    word = lambda field: {"type": "string", "enum": list(vocabularies(version)[field])}
    closed = lambda fields: {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}
    number = {"type": "integer", "minimum": 0, "maximum": MAX_OBJECTS - 1}
    corner = {"type": "number", "minimum": 0}
    box = {"type": "array", "prefixItems": [corner] * 4, "items": False, "minItems": 4, "maxItems": 4}
    if n < 3:
        thing = {"category": text, "bbox_2d": box, "coarse_position": text, "behavior": text}
        risks: dict[str, Any] = {"type": "array", "items": text}
    else:
        thing = {"category": word("category"), "bbox_2d": box, "motion_state": word("motion_state")}
        risks = {"type": "array", "maxItems": 8, "uniqueItems": True, "items": word("risk_factor")} if n < 7 else risks_with_objects(word("risk_factor"), number, closed)
    if n >= 7:
        thing = {"id": number} | thing | {"bev_x": {"type": "number"}, "bev_y": {"type": "number"}}
    objects = {"type": "array"} | ({"maxItems": MAX_OBJECTS} if n >= 3 else {}) | {"items": {"$ref": "#/$defs/critical_object"}}
    action = {"enum": list(SPEED_ACTIONS)} if n >= 3 else {"type": "string", "enum": list(SPEED_ACTIONS)}
    top = {"critical_objects": objects, "risk_factors": risks} | ({"reasoning": text} if n < 6 else {}) | {"yield_required": {"type": "boolean"}, "speed_action": action}
    return closed(top) | {"$defs": {"critical_object": closed(thing)}}


def risks_with_objects(factor: dict, number: dict, closed) -> dict[str, Any]:
    """A factor comes with the ids of the objects that trigger it."""
    refs = {"type": "array", "minItems": 1, "maxItems": MAX_OBJECTS, "uniqueItems": True, "items": number}
    return {"type": "array", "maxItems": 6, "items": closed({"factor": factor, "objects": refs})}
