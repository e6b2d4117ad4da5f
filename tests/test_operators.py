"""Boundary values and folds, against plain Python loops where a fold is meant."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from kilnspark.functions import scalars as s
from kilnspark.operators import audit, collections, folds, layout, ledger, media, usage
from kilnspark.sources import files

NOW = 1_800_000_000_000


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_retention_limits(spark):
    rows = []
    for status, limit, field in (("redeemed", ledger.HOUR, "redeemed_at"), ("declined", 30 * ledger.MINUTE, "updated_at"), ("approved", 24 * ledger.HOUR, "updated_at"), ("pending", 0, "expires_at")):
        for shift in (-1, 0, 1):
            at = {"updated_at": NOW, "expires_at": NOW + 1, "redeemed_at": NOW} | {field: NOW - limit + shift}
            rows.append((status, shift, at["updated_at"], at["expires_at"], at["redeemed_at"]))
    got = values(spark, rows, "status string, shift int, updated_at long, expires_at long, redeemed_at long", "status", "shift", ledger.retention_action(F.lit(NOW)))
    for status, shift, action in got:
        assert action == ("keep" if shift == 1 else "expire" if status == "pending" else "delete")


def test_rate_limit_forgets_refused_hits(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (1, 2, 3, 4, 11, 12, 13)], "key string, at double")
    got = {r.at for r in folds.rate_limit(df, ["key"], ["at"], 2, 10).collect() if r.accepted}
    assert got == {1, 2, 11, 12}


def test_folds_equal_loops(spark):
    rng = random.Random(4)
    hits = [(f"k{rng.randint(0, 4)}", float(t)) for t in range(300)]
    rng.shuffle(hits)
    got = {(r.key, r.at): r.accepted for r in folds.rate_limit(spark.createDataFrame(hits, "key string, at double").repartition(5), ["key"], ["at"], 3, 25).collect()}
    held = {}
    for key, at in sorted(hits, key=lambda x: x[1]):
        live = [t for t in held.get(key, []) if t > at - 25]
        assert got[key, at] == (len(live) < 3)
        held[key] = live + [at] if len(live) < 3 else live


def test_unique_names_skip_taken_ones(spark):
    rows = [(1, "a.pdf"), (2, "a(1).pdf"), (3, "A.pdf"), (4, "a.pdf"), (5, "b")]
    got = {r.seq: r.free_name for r in folds.unique_names(spark.createDataFrame(rows, "seq int, name string"), "name", ["seq"]).collect()}
    assert got == {1: "a.pdf", 2: "a(1).pdf", 3: "A(2).pdf", 4: "a(3).pdf", 5: "b"}


def test_request_transitions(spark):
    rows = [("r", 1, 0, "create"), ("r", 2, 5, "redeem"), ("r", 3, 6, "approve"), ("r", 4, 7, "redeem"), ("r", 5, 8, "decline"), ("x", 1, 0, "create"), ("x", 2, 100, "approve"), ("x", 3, 101, "decline")]
    df = spark.createDataFrame(rows, "request_id string, seq int, at long, kind string").withColumn("ttl_ms", F.lit(100).cast("long"))
    got = {(r.request_id, r.seq): (r.accepted, r.status, r.reason) for r in folds.request_transitions(df).collect()}
    assert got["r", 2] == (False, "pending", "not approved") and got["r", 4] == (True, "redeemed", None) and got["r", 5][0] is False
    assert got["x", 2] == (False, "pending", "expired") and got["x", 3] == (True, "declined", None)


def test_media_urls(spark):
    cases = {
        "https://youtu.be/abc?list=1": ("https://www.youtube.com/watch?v=abc", None), "https://www.youtube.com/watch?v=abc&list=RD1": ("https://www.youtube.com/watch?v=abc", None),
        "https://www.youtube.com/playlist?list=1": (None, "playlist"), "https://example.com/a#b": ("https://example.com/a", None), "http://127.0.0.1/x": (None, "private"), "http://[::1]/x": (None, "private"),
        "ftp://example.com/x": (None, "scheme"), "http://100.63.0.1/x": ("http://100.63.0.1/x", None), "http://100.64.0.1/x": (None, "private"), "http://100.127.0.1/": (None, "private"), "http://100.128.0.1/": ("http://100.128.0.1/", None),
        "http://172.15.0.1/": ("http://172.15.0.1/", None), "http://172.16.0.1/": (None, "private"), "http://172.32.0.1/": ("http://172.32.0.1/", None), "nonsense": (None, "invalid"), "https://u:p@example.com/": (None, "scheme"), "https://example.com:81/": (None, "scheme"),
    }
    got = {r.url: (r.m.canonical, r.m.reason) for r in spark.createDataFrame([(u,) for u in cases], "url string").select("url", s.media_url(F.col("url")).alias("m")).collect()}
    assert got == cases


def test_clocks_of_many_hours(spark):
    hours = [(0,), (359_999_900,), (360_000_000,), (3_600_000_000_100,)]
    assert values(spark, hours, "ms long", s.ms_to_clock(F.col("ms")), s.clock_to_ms(s.ms_to_clock(F.col("ms")))) == [("00:00:00.0", 0), ("99:59:59.9", 359_999_900), ("100:00:00.0", 360_000_000), ("1000000:00:00.1", 3_600_000_000_100)]


def test_durations_clocks_and_versions(spark):
    got = values(spark, [(0,), (-5,), (None,), (999,), (61_000,), (3_600_000,), (90_061_001,)], "ms long", s.format_duration(F.col("ms")))
    assert [g[0] for g in got] == ["Expired", "Expired", "Expired", "01s", "1m 01s", "1h 0m 00s", "1d 1h 1m 02s"]
    assert values(spark, [("01:02:03.5",), ("bad",), ("1:2:3",)], "c string", s.clock_to_ms(F.col("c"))) == [(3_723_500,), (None,), (None,)]
    order = ["nonsense", "0.9", "v1.0.0-alpha", "1.0.0-beta", "1.0", "1.0.1", "1.10.0"]
    rows = list(enumerate(order))
    random.Random(1).shuffle(rows)
    assert [r.i for r in spark.createDataFrame(rows, "i int, v string").orderBy(s.version_key(F.col("v"))).collect()] == list(range(7))


def test_merge_runs_of_devanagari_items(spark):
    """A space between parts runs, but not between a glyph without width and its mark; tilted runs don't join flat ones."""
    flat, tilt = (1.0, 0.0), (0.6, 0.8)
    items = [("ab", 0.0, 20.0, flat, False), ("\u0915", 20.0, 0.0, flat, False), (" ", 21.0, 5.0, flat, True), ("\u093f", 22.0, 10.0, flat, False), (" ", 40.0, 5.0, flat, True), ("e", 33.0, 9.0, flat, False), ("f", 43.0, 9.0, flat, False), ("g", 53.0, 9.0, tilt, False), ("h i", 63.0, 9.0, flat, False), ("j", 90.0, 9.0, flat, False)]
    rows = [("d", 0, i, t, "f", [a, b, -b, a, x, 10.0], w, 12.0, True, sep) for i, (t, x, w, (a, b), sep) in enumerate(items)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, ordinal int, text string, font_name string, transform array<double>, width double, height double, editable boolean, item boolean")
    got = sorted((r.word, r.text, r.ordinals, r.width) for r in layout.merge_runs(df).collect())
    assert got == [(0, "ab\u0915\u093f", [0, 1, 3], 32.0), (1, "ef", [5, 6], 19.0), (2, "g", [7], 9.0), (3, "h i", [8], 9.0), (4, "j", [9], 9.0)]


def test_words_are_put_together_in_one_pass(spark):
    """Words over the borders of batches, texts and flags that are null, equal pages of two documents."""
    rows = [(d, 0, i, None if i == 5 else "ab"[i % 2], "f", [1.0, 0.0, 0.0, 1.0, 6.0 * i, 10.0], None if i == 0 else 5.0, 10.0, {3: None, 9000: False}.get(i, True), False) for d in "xy" for i in range(9500)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, ordinal int, text string, font_name string, transform array<double>, width double, height double, editable boolean, item boolean").repartition(3)
    out = layout.merge_runs(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 1
    text = "".join("ab"[i % 2] for i in range(9500) if i != 5)
    assert sorted(map(tuple, out.collect())) == [(d, 0, 0, text, list(range(9500)), 56999.0, False) for d in "xy"]


def test_folds_keep_large_numbers_and_nulls(spark):
    rows = [("k", 1, 9007199254740993, 1.0), ("k", 2, None, 80.0), (None, 3, 5, 3.0)]
    got = folds.throttle(spark.createDataFrame(rows, "key string, seq int, big long, progress double"), ["key"], ["seq"]).collect()
    assert {(r.key, r.seq, r.big, r.emit) for r in got} == {("k", 1, 9007199254740993, True), ("k", 2, None, True), (None, 3, 5, True)}


def test_nearest_of_equal_runs(spark):
    runs = spark.createDataFrame([("d", 0, f"r{o}", o, "same text", "h") for o in (2, 9, 30)] + [("d", 0, "r5", 5, "other", "h5")], "doc_id string, page_index int, run_id string, ordinal int, text string, text_hash string")
    asked = [("a", None, 4, "sametext", "x"), ("b", None, 7, "same text", "x"), ("c", "r30", 0, "", "x"), ("d", None, 5, "o ther", "h5"), ("e", None, 5, "other", "x"), ("f", None, 70, "other", "x"), ("g", None, 1, "gone", "x"), ("h", None, 100, "same text", "h")]
    edits = spark.createDataFrame([(e, "d", 0, r, o, t, h) for e, r, o, t, h in asked], "edit_id string, doc_id string, page_index int, run_id string, ordinal int, original_text string, text_hash string")
    got = {r.edit_id: (r.tier, r.resolved_run) for r in layout.resolve_edits(edits, runs).collect()}
    assert got == {"a": (4, "r2"), "b": (4, "r9"), "c": (0, "r30"), "d": (1, "r5"), "e": (2, "r5"), "f": (3, "r5"), "g": (None, None), "h": (4, "r30")}


def test_routes_of_several_shapes(spark):
    ends = spark.createDataFrame([(0, "GET", "/a/:x/c", False), (1, "GET", "/:p/b/c", False), (2, "PUT", "/a", True), (3, "GET", "/", False), (4, "GET", "/:lang/x", True), (5, "POST", "/a", True), (6, "GET", "/u/:id", True)], "ord int, method string, path string, database boolean")
    asked = spark.createDataFrame([(1, "GET", "/a/b/c"), (2, "GET", "/z/b/c?q=1"), (3, "PUT", "/a/7%2F8"), (4, "POST", "/a/7"), (5, "GET", "/"), (6, "GET", "/z/y/c"), (7, "GET", "/en/x/7"), (8, "OPTIONS", "/a"), (9, "GET", "/u/a+b")], "request_id int, method string, path string")
    got = {r.request_id: (r.endpoint_ord, r.record_id, r.status, ",".join(r.allowed)) for r in collections.route_requests(asked, ends).collect()}
    assert got == {
        1: (0, None, 200, "OPTIONS,GET"), 2: (1, None, 200, "OPTIONS,GET"), 3: (2, "7/8", 200, "OPTIONS,PUT,POST"), 4: (None, None, 405, "OPTIONS,PUT,POST"), 5: (3, None, 200, "OPTIONS,GET"),
        6: (None, None, 404, "OPTIONS"), 7: (None, None, 404, "OPTIONS"), 8: (None, None, 204, "OPTIONS,PUT,POST"), 9: (6, "a+b", 200, "OPTIONS,GET"),
    }


BOX = "doc_id string, page_index int, ord int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, graphic boolean"


def test_currency_joins_its_number(spark):
    words = spark.createDataFrame([("d", 0, 0, "2299.00", 50.0, 10.0, 0.0, 60.0, 10.0, False), ("d", 0, 1, "word", 9.0, 80.0, 0.0, 99.0, 10.0, False), ("d", 0, 2, "12.50", 9.0, 10.0, 50.0, 60.0, 60.0, False)], BOX)
    money = spark.createDataFrame([("d", 0, 0, "₹299.00", 80.0, 8.0, 0.0, 60.0, 10.0, False), ("d", 0, 1, "$5", 70.0, 500.0, 300.0, 520.0, 310.0, False), ("d", 0, 2, "river", 70.0, 10.0, 50.0, 60.0, 60.0, False), ("d", 0, 3, "$9", 70.0, 10.0, 50.0, 60.0, 60.0, True)], BOX)
    got = [(r.turn, r.text, r.confidence, r.x0) for r in layout.join_currency(words, money).orderBy("turn").collect()]
    assert got == [(1, "₹299.00", 80.0, 8.0), (2, "word", 9.0, 80.0), (3, "12.50", 9.0, 10.0), (4, "$5", 70.0, 500.0)]


def plain_currency(words, tokens):
    """Every token walks over all words of the page."""
    numeric = re.compile("^[₹$€£¥₽₩¢ ]*[-+]?[0-9][0-9 .,%₹$€£¥₽₩¢]*$")
    out = [list(w) for w in words]
    for token in tokens:
        if not re.match("^[₹$€£¥₽₩¢][-+]?[0-9][0-9.,%]*$", token[3]) or token[9]:
            continue
        _, _, _, text, sure, x0, y0, x1, y1, _ = token
        best = None
        for w in out:
            shared = max(0, min(w[8], y1) - max(w[6], y0)) / max(1, min(w[8] - w[6], y1 - y0))
            gap = max(0, max(w[5], x0) - min(w[7], x1))
            score = shared * 3 - gap / max(1, y1 - y0)
            if not w[9] and numeric.match(w[3]) and shared >= 0.35 and gap <= max(12, (y1 - y0) * 2.5) and (best is None or score > best[0]):
                best = (score, w)
        if best:
            w = best[1]
            w[3:9] = [text, max(w[4], sure), min(w[5], x0), min(w[6], y0), max(w[7], x1), max(w[8], y1)]
        else:
            out.append(list(token))
    return [(w[3], *w[4:9]) for w in sorted(out, key=lambda w: (w[6], w[5]))]


def test_currency_on_random_pages(spark):
    rng = random.Random(3)

    def row(page, i, texts):
        x, y = rng.uniform(0, 300), rng.uniform(0, 200)
        return ("d", page, i, rng.choice(texts), float(rng.randrange(100)), x, y, x + rng.uniform(5, 60), y + rng.uniform(4, 90), rng.random() < 0.1)

    words = [row(p, i, ["12.50", "7", "-3,5%", "word", "$8", "(4)"]) for p in range(12) for i in range(40)]
    tokens = [row(p, i, ["$1.5", "₹299", "river", "$", "€-7%"]) for p in range(12) for i in range(25)]
    got = layout.join_currency(spark.createDataFrame(words, BOX), spark.createDataFrame(tokens, BOX)).orderBy("page_index", "turn").collect()
    want = [(p, *w) for p in range(12) for w in plain_currency([w for w in words if w[1] == p], [t for t in tokens if t[1] == p])]
    assert [(r.page_index, r.text, r.confidence, r.x0, r.y0, r.x1, r.y1) for r in got] == want


def test_words_join_over_their_own_height(spark):
    rows = [("tall", 0.0, 0.0, 30.0, 40.0), ("low", 60.0, 5.0, 90.0, 15.0), ("$", 100.0, 5.0, 105.0, 15.0), ("5", 108.0, 5.0, 112.0, 15.0), ("apples", 118.0, 5.0, 150.0, 15.0), (" ", 152.0, 5.0, 155.0, 15.0), ("flat", 153.0, 5.0, 160.0, 5.0)]
    words = spark.createDataFrame([("d", 0, i, t, 1.0, x0, y0, x1, y1, False) for i, (t, x0, y0, x1, y1) in enumerate(rows)], BOX)
    assert [r.text for r in layout.join_words(words, ["ord"]).orderBy("phrase").collect()] == ["tall", "low $ 5 apples"]
    assert [r.text for r in layout.join_words(words.where("ord > 1"), ["ord"]).orderBy("phrase").collect()] == ["$5apples"]


def test_ids_of_recognised_runs(spark):
    df = spark.createDataFrame([(3, 7, "Thanks", "ab" * 32, 67.04, 1.25, 99.96, 12.0)], "p int, o int, t string, s string, x0 double, y0 double, x1 double, y1 double")
    got = df.select(s.ocr_run_id(F.col("p"), F.col("o"), F.col("t"), F.col("s"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("id")).first().id
    text, box = hashlib.sha256(b"Thanks").hexdigest()[:16], hashlib.sha256(b"67-1.3-100-12").hexdigest()[:12]
    assert got == f"p3-ocr-o7-t{text}-b{box}-f{'ab' * 8}"


def test_query_filter(spark):
    docs = [(1, '{"id":"1","role":"admin","active":true,"n":1.0,"tags":["a","b"],"z":null}'), (2, '{"id":"2","role":"developer","active":true,"n":2}'), (3, '{"id":"3","role":"admin","active":false,"o":{"a":1}}')]
    records = spark.createDataFrame(docs, "ord int, json string").select(F.lit("u").alias("collection"), "ord", F.col("ord").cast("string").alias("id"), F.parse_json("json").alias("doc"))
    asked = {"a": [("role", "admin")], "b": [("role", "admin"), ("active", "true")], "c": [("id", "1"), ("id", "3")], "d": [("role", "missing")], "e": [("n", "1")], "f": [("tags", "b")], "g": [("z", "null")], "h": [("o", "{}")]}
    params = spark.createDataFrame([(r, "u", k, v) for r, p in asked.items() for k, v in p], "request_id string, collection string, key string, value string")
    got = {}
    for r in collections.query_filter(records, params).collect():
        got.setdefault(r.request_id, set()).add(r.ord)
    assert got == {"a": {1, 3}, "b": {1}, "c": {1, 3}, "d": {1, 2, 3}, "e": {1}, "f": {1}, "g": {1}, "h": {1, 2, 3}}


REQUEST, RECORD = "seq long, collection string, id string, method string, json string", "collection string, id string, json string"


def test_collection_changes(spark):
    base = spark.createDataFrame([("c", "1", '{"a":1}'), ("c", "2", '{"a":2}')], RECORD)
    rows = [(1, "c", None, "POST", '{"a":3,"id":3}'), (2, "c", None, "POST", '{"id":"1"}'), (3, "c", "1", "PATCH", '{"b":1.50,"id":"z"}'), (4, "c", "2", "DELETE", None), (5, "c", "2", "PUT", "{}"), (6, "c", None, "POST", "{}"), (7, "c", None, "POST", '{"a":4,"id":"4"}'), (8, "c", "4", "POST", '{"id":"4"}'), (9, "d", None, "POST", '{"id":"1"}'), (10, "c", None, "GET", None)]
    methods = spark.createDataFrame([("c", ["GET", "POST", "PUT", "PATCH", "DELETE"])], "collection string, methods array<string>")
    records, responses = collections.apply_changes(base, spark.createDataFrame(rows, REQUEST), most=2, methods=methods)
    assert {r.seq: r.status for r in responses.collect()} == {1: 413, 2: 409, 3: 200, 4: 204, 5: 404, 6: 400, 7: 201, 8: 404, 9: 404, 10: 404}
    assert {(r.id, r.json) for r in records.collect()} == {("1", '{"a":1,"b":1.5,"id":"1"}'), ("4", '{"a":4,"id":"4"}')}
    few = spark.createDataFrame([("c", ["DELETE"])], "collection string, methods array<string>")
    assert {r.seq: r.status for r in collections.apply_changes(base, spark.createDataFrame(rows, REQUEST), 2, few)[1].where("seq in (1, 3, 4)").collect()} == {1: 405, 3: 405, 4: 204}


def test_refused_records_leave_no_trace(spark):
    base = spark.createDataFrame([("c", "z", "{}")], RECORD)
    rows = [(1, "c", None, "POST", '{"id":"a"}'), (2, "c", None, "POST", '{"id":"b"}'), (3, "c", None, "POST", '{"id":"d"}'), (4, "c", "a", "DELETE", None), (5, "c", None, "POST", '{"id":"e"}'), (6, "c", "b", "PUT", "{}")]
    records, responses = collections.apply_changes(base, spark.createDataFrame(rows, REQUEST), most=2)
    assert [r.status for r in responses.orderBy("seq").collect()] == [201, 413, 413, 204, 201, 404]
    assert {r.id for r in records.collect()} == {"z", "e"}


def walked(base, rows, most):
    held, statuses = {}, []
    for c, i, j in base:
        held.setdefault(c, {})[i] = json.loads(j) | {"id": i}
    for _, c, i, method, j in sorted(rows):
        own, body = held.setdefault(c, {}), json.loads(j) if j and j.startswith("{") else None
        if method == "POST":
            key = body and str(body.get("id", ""))
            status = 404 if i is not None else 400 if not key else 409 if key in own else 413 if len(own) >= most else 201
            if status == 201:
                own[key] = body
        elif i not in own:
            status = 404
        elif method == "DELETE":
            status = 204
            del own[i]
        else:
            status = 400 if body is None else 200
            if body is not None:
                own[i] = (own[i] if method == "PATCH" else {}) | body | {"id": i}
        statuses.append(status)
    return statuses, sorted((c, i, json.dumps(d, sort_keys=True)) for c, own in held.items() for i, d in own.items())


@pytest.mark.parametrize("rounds, most", [(24, 3), (1, 3), (24, 1)])
def test_random_changes_equal_a_walk(spark, rounds, most):
    """Collections at their limit, over it at first, settled in rounds and walked."""
    rng = random.Random(most + rounds)
    ids = [str(i) for i in range(7)]
    base = [(c, i, '{"n":"x"}') for c in "cd" for i in ids if rng.random() < 0.5]
    rows = []
    for seq in range(160):
        i, method = rng.choice(ids), rng.choice(["POST", "POST", "PUT", "PATCH", "DELETE"])
        body = rng.choice([f'{{"id":"{i}","v":{seq}}}', f'{{"w":[{seq}],"id":"{i}"}}', '{"u":null}', "bad", None])
        rows.append((seq, rng.choice("cd"), None if method == "POST" and rng.random() < 0.95 else i, method, body))
    records, responses = collections.apply_changes(spark.createDataFrame(base, RECORD), spark.createDataFrame(rows, REQUEST), most, rounds=rounds)
    statuses, docs = walked(base, rows, most)
    assert [r.status for r in responses.orderBy("seq").collect()] == statuses
    assert sorted((r.collection, r.id, json.dumps(json.loads(r.json), sort_keys=True)) for r in records.collect()) == docs


@pytest.mark.parametrize("crowd, rounds", [(0, 24), (0, 1), (90, 24), (90, 1)])
def test_crowded_collections_equal_a_walk(spark, crowd, rounds):
    """All collections, or the larger one, in rounds; a null id and ids of several collections."""
    rng = random.Random(7)
    base = [(c, str(i), "{}") for c in "cd" for i in range(5)]
    rows = [(seq, rng.choice("ccd"), None if m == "POST" else str(rng.randrange(9)), m, f'{{"id":"{rng.randrange(9)}","v":{seq}}}') for seq, m in enumerate(rng.choices(["POST", "PUT", "DELETE"], k=160))]
    responses = collections.apply_changes(spark.createDataFrame(base, RECORD), spark.createDataFrame(rows, REQUEST), 4, rounds=rounds, crowd=crowd)[1]
    assert [r.status for r in responses.orderBy("seq").collect()] == walked(base, rows, 4)[0]


def test_many_requests_are_walked_in_few_jobs(spark):
    """A collection at its limit whose rounds would follow one another for long."""
    rows = [(i, "c", None if i % 2 else str(i // 2), "POST" if i % 2 else "DELETE", f'{{"id":"{i // 2 + 1}"}}') for i in range(400)]
    jobs, tracker = [], spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walk", "walk")
    try:
        responses = collections.apply_changes(spark.createDataFrame([("c", "0", "{}")], RECORD), spark.createDataFrame(rows, REQUEST), 1)[1]
        jobs = tracker.getJobIdsForGroup("walk")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.status for r in responses.orderBy("seq").collect()] == [204, 201] * 200
    assert len(jobs) < 20


def test_guided_update_changes_all_or_nothing(spark):
    df = spark.createDataFrame([(1, [("email", False), ("sms", False)]), (2, [("email", False)])], "client int, items array<struct<id:string,on:boolean>>")
    def update(c):
        return {r.client: ([tuple(i) for i in r["items"]], r.status) for r in collections.guided_update(df, F.col("client") == c, "items", lambda x: x["id"] == "email", lambda x: x.withField("on", F.lit(True))).collect()}
    assert update(1) == {1: ([("email", True), ("sms", False)], 200), 2: ([("email", False)], 200)}
    assert update(9) == {1: ([("email", False), ("sms", False)], 404), 2: ([("email", False)], 404)}


def test_estimates_and_windows(spark):
    size, target = F.col("size"), F.lit(1_000_000)
    assert [r[1] for r in values(spark, [(979_999,), (980_000,), (1_000_000,), (1_000_001,)], "size long", "size", media.within_window(size, target))] == [False, True, True, False]
    for heavy in (0, 1, 7, 8, 9):
        df = spark.createDataFrame([("d", i, i < heavy, 1000, 100_000, "p") for i in range(10)], "doc_id string, page_index int, heavy boolean, sampled_bytes long, source_bytes long, profile string")
        want = max(1000, min(1000 * heavy + 0.78 * 100_000 * (10 - heavy) / 10 + 28_000, 90_000))
        assert media.estimate_output(df, "doc_id", {"p": 0.9}).first().estimated == int(want + 0.5)


def test_consent_and_contract(spark):
    from datetime import datetime, timedelta

    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    consents = spark.createDataFrame([(at(0), "a", "v1", "granted"), (at(5), "a", "v1", "denied"), (at(0), "b", "v0", "granted"), (at(0), "c", "v1", "granted")], "ts timestamp, subject string, version string, state string")
    events = spark.createDataFrame([(1, at(0), "a"), (2, at(6), "a"), (3, at(1), "b"), (4, at(179), "c"), (5, at(181), "c"), (6, at(-1), "a")], "id int, ts timestamp, subject string")
    assert {r.id for r in usage.consent_gate(events, consents, "v1").collect()} == {1, 4}


def test_page_audit_reasons(spark):
    html = "<html><title> T </title><meta name='description' content='d'><h1>A <b>b</b></h1><link rel='canonical' href='http://x.org/a'>" + "w" * 700 + "</html>"
    pages = spark.createDataFrame([(1, "http://x.org/a", html), (2, "http://x.org/b", "<p>")], "page_id int, url string, html string")
    policy = spark.createDataFrame([("/a", True)], "path string, indexable boolean")
    got = {r.page_id: r.reasons for r in audit.page_audit(pages, policy, "gtm.js").collect()}
    assert got == {1: ["script copies"], 2: ["no title", "no description", "no h1", "canonical", "script copies", "thin"]}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p2").mkdir()
    (tmp_path / "p1" / "project.json").write_text('{"updatedAt":"2024-01-02"}')
    (tmp_path / "p2" / "project.json").write_text("{bad")
    assert [r.project_id for r in files.read_projects(spark, str(tmp_path)).collect()] == ["p1"]
    df = spark.createDataFrame([("a", "{}"), ("b", "{}")], "project_id string, json string")
    files.write_projects(df, str(tmp_path / "out"))
    files.write_projects(df.where("project_id = 'a'").withColumn("json", F.lit("[]")), str(tmp_path / "out"))
    assert {(r.project_id, r.json) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "[]"), ("b", "{}")}
    assert files.delete_project(df, "a").count() == 1
    assert files.read_media(spark, str(tmp_path / "p1"), "*.json").first().size == 26
