"""Sinks and request bodies."""

import json

from hookline.sources.sinks import features_json, parse_requests, write_json


BODIES = [
    ({"url": "http://a.com"}, [(0, "http://a.com", None)]),
    ({"urls": ["http://b.com", "http://c.com"]}, [(0, "http://b.com", None), (1, "http://c.com", None)]),
    ({"urls": "http://d.com"}, [(0, None, "urls must be a list")]),
    ({"urls": "[abc"}, [(0, None, "urls must be a list")]),
    ({"urls": None}, [(0, None, "urls must be a list")]),
    ({"urls": {"0": "x"}}, [(0, None, "urls must be a list")]),
    ({"urls": []}, []),
    ({"urls": ["x", None, 5, 1.5, True, ["y"], {"url": "z"}, ""]},
     [(0, "x", None), *[(i, None, "url must be a string") for i in range(1, 7)], (7, "", None)]),
    ({"link": "http://e.com"}, [(0, None, "Missing required field: url")]),
    ({"url": None}, [(0, None, "url must be a string")]),
    ({"url": ["http://f.com"]}, [(0, None, "url must be a string")]),
    ({"url": "\u00e9 \t\"\\", "urls": []}, [(0, "\u00e9 \t\"\\", None)]),
    *[(raw, [(0, None, "Missing required field: url")]) for raw in ({}, [], ["url"], "url", 5, None, False)],
]
BROKEN = ["", " ", "{", '{"url": "x"', "{'url': 'x'}", "nul", '{"url": "x"} y', None, '{"url": "x", "url": "y"}']


def test_parse_requests(spark):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(BODIES)], "request_id long, body string")
    got = {}
    for r in parse_requests(df).orderBy("request_id", "pos").collect():
        got.setdefault(r.request_id, []).append(tuple(r[1:]))
    assert {i: got.get(i, []) for i in range(len(BODIES))} == {i: want for i, (_, want) in enumerate(BODIES)}


def test_bodies_that_are_not_json(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BROKEN)], "request_id long, body string")
    assert sorted(tuple(r) for r in parse_requests(df).collect()) == [(i, 0, None, "Invalid JSON") for i in range(len(BROKEN))]


def test_the_field_follows_the_kind_of_request(spark):
    df = spark.createDataFrame([(1, True, '{"url": "x"}'), (2, False, '{"urls": ["x"]}'), (3, True, "{}"), (4, False, '{"url": "x", "urls": 5}')], "request_id long, batch boolean, body string")
    assert sorted(tuple(r) for r in parse_requests(df, batch_col="batch").collect()) == [
        (1, 0, None, "Missing required field: urls"), (2, 0, None, "Missing required field: url"), (3, 0, None, "Missing required field: urls"), (4, 0, "x", None)]


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x")], "id long, a double, closest_brand string")
    rec = features_json(df, ["id"], ["a", "closest_brand"]).first()
    assert json.loads(rec.features) == {"a": 2.0, "closest_brand": "x"}
    write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
