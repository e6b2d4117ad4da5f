"""Guided updates and the request ledger on cases of their own."""

import json

from pyspark.sql import functions as F

from kilnspark.operators import folds, guided

PURPOSES = "consentData.data.purposeDetails"


def consents(*purposes):
    return {"consentData": {"data": {"purposeDetails": [{"id": p, "hasUserProvidedConsent": False} for p in purposes]}}}


RECORDS = [{"id": "one", "clientid": "client-1"} | consents("email", "finance"), {"id": "two", "clientid": "client-1"} | consents("email"), {"id": "three", "clientid": "client-2"} | consents("email")]


def update(spark, records, action, body=None, headers=None, query="", success=200):
    rows = spark.createDataFrame([("c", r["id"], json.dumps(r)) for r in records], "collection string, id string, json string").select("collection", "id", F.parse_json("json").alias("doc"))
    asked = spark.createDataFrame([("c", json.dumps(body or {}), headers or {}, query)], "collection string, json string, headers map<string,string>, query string").select("collection", F.parse_json("json").alias("body"), "headers", "query")
    out, responses = guided.apply_guided(rows, asked, action, success)
    got = {r.id: json.loads(r.doc) for r in out.select("id", F.to_json("doc").alias("doc")).collect()}
    return responses.first().status, [got[r["id"]] for r in records]


def nested(**more):
    return {"recordMatch": [{"recordPath": "clientid", "source": "header.clientId", "operator": "equals"}], "nestedUpdates": [{"arrayPath": PURPOSES, "matchPath": "id", "source": "body.purpose_ids", "operator": "in", "set": {"hasUserProvidedConsent": True}} | more]}


def given(doc):
    return [x["hasUserProvidedConsent"] for x in doc["consentData"]["data"]["purposeDetails"]]


def test_matching_items_of_matching_records(spark):
    status, docs = update(spark, RECORDS, nested(), {"purpose_ids": ["email"]}, {"clientid": "client-1"}, success=202)
    assert status == 202 and [given(d) for d in docs] == [[True, False], [True], [False]]


def test_query_sources_set_and_copy(spark):
    action = {"recordMatch": [{"recordPath": "clientid", "source": "query.client", "operator": "equals"}], "nestedUpdates": [{"arrayPath": PURPOSES, "matchPath": "id", "source": "query.purpose", "operator": "in", "set": {"hasUserProvidedConsent": True}, "copy": {"consentSource.value": "query.source"}}]}
    status, docs = update(spark, RECORDS, action, query="client=client-2&purpose=email&source=a+query%21")
    assert status == 200 and docs[2]["consentData"]["data"]["purposeDetails"] == [{"id": "email", "hasUserProvidedConsent": True, "consentSource": {"value": "a query!"}}] and docs[:2] == RECORDS[:2]


def test_append_with_distinct(spark):
    people = [{"id": "1", "name": "Ada Lovelace", "skills": ["math", "logic"]}]
    action = {"recordMatch": [{"recordPath": "name", "source": "header.name", "operator": "equals"}], "arrayUpdates": [{"arrayPath": "skills", "source": "body.skills"}]}
    assert update(spark, people, action, {"skills": ["javascript", "math"]}, {"name": "Ada Lovelace"})[1][0]["skills"] == ["math", "logic", "javascript"]
    action["arrayUpdates"][0]["dedupe"] = False
    assert update(spark, people, action, {"skills": ["math"]}, {"name": "Ada Lovelace"})[1][0]["skills"] == ["math", "logic", "math"]
    assert update(spark, people, action, {"skills": "math"}, {"name": "Ada Lovelace"}) == (400, people)


def test_nothing_is_saved_unless_every_rule_hits(spark):
    two = nested()
    two["nestedUpdates"].append({"arrayPath": "none", "matchPath": "id", "source": "body.purpose_ids", "operator": "in", "set": {"x": 1}})
    body, client = {"purpose_ids": ["email"]}, {"clientId": "client-1"}
    for action, sent, headers, status in [(nested(), body, {"clientId": "missing"}, 404), (two, body, client, 404), (nested(), {}, client, 400), (nested(), body, {}, 400), (nested(copy={"a": "body.b"}), body, client, 400), (nested(), {"purpose_ids": ["other"]}, client, 404)]:
        assert update(spark, RECORDS, action, sent, headers) == (status, RECORDS)


def test_several_matches_arrays_and_numbers(spark):
    records = [{"id": "1", "tags": [["a", 5]], "n": 1.0, "l": [{"k": None}]}, {"id": "2", "tags": ["b"], "n": 1, "l": [{"k": None}]}]
    action = {"recordMatch": [{"recordPath": "tags", "source": "body.tags", "operator": "in"}, {"recordPath": "n", "source": "query.n", "operator": "equals"}], "nestedUpdates": [{"arrayPath": "l", "matchPath": "k", "source": "body.none", "operator": "equals", "set": {"k.x": [1]}}]}
    status, docs = update(spark, records, action, {"tags": ["5", "c"], "none": None}, query="n=1")
    assert status == 200 and docs[0]["l"] == [{"k": {"x": [1]}}] and docs[1] == records[1]


def test_a_redemption_clears_the_code_and_is_told_twice(spark):
    day = 86_400_000
    columns = "request_id string, seq long, at long, kind string, ttl_ms long, label string, license_id string, code_hash string, code string, device_id string, origin string, why string"
    create = lambda r, seq: (r, seq, 0, "create", day, "me", None, None, None, None, "https://o", None)
    rows = [create("r", 1), ("r", 2, 5, "approve", None, None, "L1", "h1", "secret", None, None, None), (None, 3, 6, "redeem", None, None, "L1", "bad", None, "d", "https://p", None), (None, 4, 7, "redeem", None, None, "L1", "h1", None, "d", "https://p", None), (None, 5, 8, "redeem", None, None, "L1", "h1", None, "e", "https://q", None)]
    rows += [create("s", 6), ("s", 7, 9, "decline", None, None, None, None, None, None, None, "no"), create("t", 8), ("t", 9, day, "approve", None, None, "L2", "h2", "x", None, None, None), (None, 10, day, "redeem", None, None, "L2", "h2", None, "d", "https://p", None)]
    events, audit, used = folds.request_ledger(spark.createDataFrame(rows, columns))
    got = {r.seq: (r.accepted, r.status, r.reason, r.held_code) for r in events.collect()}
    assert got == {1: (True, "pending", None, None), 2: (True, "approved", None, "secret"), 3: (False, None, "unknown code", None), 4: (True, "redeemed", None, None), 5: (False, "redeemed", "not approved", None), 6: (True, "pending", None, None), 7: (True, "declined", None, None), 8: (True, "pending", None, None), 9: (False, "pending", "expired", None), 10: (False, "pending", "unknown code", None)}
    told = [(r.request_id, r.event, r.origin, json.loads(r.details)) for r in audit.orderBy("seq", "place").collect()]
    who = {"licenseId": "L1", "deviceId": "d"}
    assert told == [("r", "request.created", "https://o", {"requesterLabel": "me"}), ("r", "request.approved", "https://o", {"licenseId": "L1"}), ("r", "license.redeemed", "https://p", who), ("r", "device.activity", "https://p", {"activity": "license.redeemed"} | who), ("s", "request.created", "https://o", {"requesterLabel": "me"}), ("s", "request.declined", "https://o", {"reason": "no"}), ("t", "request.created", "https://o", {"requesterLabel": "me"})]
    assert [tuple(r) for r in used.collect()] == [("L1", "h1", "d", "https://p", 7)]
