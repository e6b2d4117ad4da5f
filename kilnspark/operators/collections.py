"""JSON collections: validate, filter, shape, route and change records held as variants.

A record is a row (project_id, collection, ord, id, doc variant). Values are
compared as text: 1.0 as 1, null as null; objects and arrays never equal a text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.operators.ranked import ranged, running
from kilnspark.sources.scratch import discard, stored

#: Names that no record may hold, methods, header names to hide, limits.
FORBIDDEN = ["__proto__", "constructor", "prototype"]
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
SENSITIVE = "(?i)authorization|cookie|token|secret|password|api-?key"
LIMITS = {"collections": 20, "endpoints": 50, "records": 1000, "project_bytes": 1024 * 1024, "response_bytes": 256 * 1024}


def scalar_text(value: Column) -> Column:
    """A scalar variant as text, integral numbers without a fraction, JSON null as null; null for objects, arrays and missing values."""
    kind = F.schema_of_variant(value)
    text = F.regexp_replace(F.try_variant_get(value, "$", "string"), "^(-?\\d+)\\.0+$", "$1")
    return F.when(F.is_variant_null(value), "null").when(kind.rlike("^(OBJECT|ARRAY)"), None).otherwise(text)


def loose_equal(a: Column, b: Column) -> Column:
    """Scalars by text, objects and arrays by their JSON with keys in order; null and missing equal nothing."""
    known = a.isNotNull() & b.isNotNull() & ~F.coalesce(F.is_variant_null(a), F.lit(True)) & ~F.coalesce(F.is_variant_null(b), F.lit(True))
    same = F.coalesce(scalar_text(a) == scalar_text(b), F.to_json(a) == F.to_json(b))
    return F.coalesce(known & same, F.lit(False))


def validate_records(records: DataFrame, text: str = "json") -> DataFrame:
    """records with doc and reason: not JSON, not an object, a forbidden key at any depth, or an id over 128 characters."""
    own = records.withColumn("doc", F.try_parse_json(text))
    flat = F.to_json("doc")
    keys = "\"(" + "|".join(FORBIDDEN) + ")\"\\s*:"
    reason = (
        F.when(F.col("doc").isNull(), "not json").when(~F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), "not an object")
        .when(flat.rlike(keys), "forbidden key").when(F.length(scalar_text(F.try_variant_get("doc", "$.id", "variant"))) > 128, "long id")
    )
    return own.withColumn("reason", reason)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that several rows hold; null and blank ones don't count."""
    real = df.where(" and ".join(f"trim(cast(`{k}` as string)) <> ''" for k in keys))
    return real.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def validate_project(collections: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(project_id, name, reason) against collections(project_id, name) and endpoints(project_id, id, method, path, collection)."""
    unsafe = collections.where(~F.col("name").rlike("^[A-Za-z][A-Za-z0-9_-]{0,63}$")).select("project_id", "name", F.lit("unsafe name").alias("reason"))
    twice = duplicate_keys(collections, ["project_id", "name"]).select("project_id", "name", F.lit("duplicate collection").alias("reason"))
    ids = duplicate_keys(endpoints, ["project_id", "id"]).select("project_id", F.col("id").cast("string").alias("name"), F.lit("duplicate endpoint").alias("reason"))
    lost = endpoints.join(collections.select("project_id", F.col("name").alias("collection")), ["project_id", "collection"], "left_anti").select("project_id", F.col("collection").alias("name"), F.lit("missing collection").alias("reason"))
    method = endpoints.where(~F.col("method").isin(METHODS)).select("project_id", F.col("id").cast("string").alias("name"), F.lit("unknown method").alias("reason"))
    return unsafe.unionAll(twice).unionAll(ids).unionAll(lost).unionAll(method)


def enforce_limits(records: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Per collection of records(project_id, collection, json): records, bytes, and whether they and the project's are within limits."""
    own = LIMITS | (limits or {})
    per = records.groupBy("project_id", "collection").agg(F.count("*").alias("n_records"), F.sum(F.octet_length("json")).alias("n_bytes"))
    w = Window.partitionBy("project_id")
    return per.withColumn("allowed", (F.col("n_records") <= own["records"]) & (F.sum("n_bytes").over(w) <= own["project_bytes"]) & (F.count("*").over(w) <= own["collections"]))


#: Requests up to which those of a filter are broadcast.
FEW_REQUESTS = 20_000


def query_filter(records: DataFrame, params: DataFrame, fallback: bool = True) -> DataFrame:
    """(request_id, ord, id) of the records(collection, ord, id, doc) that params(request_id, collection, key, value) ask for.

    Keys must all hold, of a key's values one; a record must have the key; an
    array holds if an element does. If nothing matches a request gets every
    record of its collection, as long as fallback is on.

    A request is one row that carries all its keys. It meets records only on
    the key that fewest records hold as asked; the other keys are tested in
    the joined row.
    """
    asked = params.where(~F.col("key").isin(FORBIDDEN)).groupBy("request_id", "collection", "key").agg(F.collect_set("value").alias("values"))

    def texts(value: Column) -> Column:
        each = F.coalesce(value.try_cast("array<variant>"), F.array(value))
        return F.array_distinct(F.filter(F.transform(each, scalar_text), lambda x: x.isNotNull()))

    has = F.transform_values(F.col("doc").try_cast("map<string, variant>"), lambda _, v: texts(v))
    held = stored(records.select("collection", "ord", "id", has.alias("has")), "held")  # documents are parsed once
    pairs = held.select("collection", F.explode("has").alias("key", "value")).select("collection", "key", F.explode("value").alias("value"))
    common = pairs.groupBy("collection", "key", "value").agg(F.count("*").alias("n"))
    flat = asked.select("request_id", "collection", "key", F.explode("values").alias("value"))
    weighed = flat.join(common.hint("merge"), ["collection", "key", "value"], "left").groupBy("request_id", "collection", "key").agg(F.sum(F.coalesce("n", F.lit(0))).alias("w"))
    rarest = weighed.groupBy("request_id", "collection").agg(F.min_by("key", F.struct("w", "key")).alias("key"))
    tests = asked.groupBy("request_id", "collection").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("tests"))
    asks = tests.join(rarest.hint("merge"), ["request_id", "collection"]).select("*", F.explode(F.col("tests")[F.col("key")]).alias("value"))
    few = params.select("request_id").limit(FEW_REQUESTS + 1).count() <= FEW_REQUESTS
    places = held.select("*", F.explode("has").alias("key", "own")).select("collection", "ord", "id", "has", "key", F.explode("own").alias("value"))
    met = places.join(asks.hint("broadcast" if few else "merge"), ["collection", "key", "value"])
    once = F.col("value") == F.array_min(F.array_intersect(F.col("has")[F.col("key")], F.col("tests")[F.col("key")]))
    all_keys = F.forall(F.map_entries("tests"), lambda t: F.arrays_overlap(F.coalesce(F.try_element_at("has", t["key"]), F.array().cast("array<string>")), t["value"]))
    hits = met.where(once & all_keys).select("request_id", "ord", "id")
    if not fallback:
        return hits
    lonely = params.select("request_id", "collection").distinct().join(hits.select("request_id").distinct().hint("merge"), "request_id", "left_anti")
    return hits.unionAll(records.select("collection", "ord", "id").join(lonely.hint("merge"), "collection").select("request_id", "ord", "id"))


def response_node(df: DataFrame, path: str, doc: str = "doc") -> DataFrame:
    """df with node, the variant at a dotted path, and status: 404 if a key on the way is missing."""
    node = F.try_variant_get(doc, "$." + path, "variant")
    return df.withColumn("node", node).withColumn("status", F.when(F.col("node").isNull(), 404).otherwise(200))


def shape_response(rows: DataFrame, keys: list[str], shape: str, single: str) -> DataFrame:
    """Per request the body of its rows(ord, json): one row as object or array, others by the collection's shape."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"])
    every = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    first = F.coalesce(F.get("items", F.lit(0)), F.lit("{}"))
    one = F.size("items") == 1
    body = F.when(one & (F.lit(single) == "object"), first).when(one & (F.lit(single) == "array"), every).when(F.lit(shape) == "object", first).otherwise(every)
    return rows.groupBy(*keys).agg(listed.alias("items")).select(*keys, F.size("items").alias("n"), body.alias("body"))


def get_record(requests: DataFrame, records: DataFrame) -> DataFrame:
    """requests(request_id, collection, id) with doc and status 200 or 404."""
    return requests.join(records.select("collection", "id", "doc"), ["collection", "id"], "left").withColumn("status", F.when(F.col("doc").isNull(), 404).otherwise(200))


def put_at(doc: Column, keys: list[str], value: Column) -> Column:
    """A variant with another one at a path of keys; what is no object on the way becomes one."""
    own = F.coalesce(doc.try_cast("map<string, variant>"), F.parse_json(F.lit("{}")).cast("map<string, variant>"))
    new = value if len(keys) == 1 else put_at(F.try_element_at(own, F.lit(keys[0])), keys[1:], value)
    return F.to_variant_object(F.map_concat(F.map_filter(own, lambda k, _: k != keys[0]), F.create_map(F.lit(keys[0]), new)))


def assign_path(df: DataFrame, path: str, value: str, text: str = "json") -> DataFrame:
    """df with the JSON text's dotted path set to the JSON text in value; what is no object on the way becomes one. Keys come back in order."""
    return df.withColumn(text, F.to_json(put_at(F.try_parse_json(text), path.split("."), F.parse_json(F.col(value)))))


def request_source(source: str, query: str = "query", headers: str = "headers", body: str = "body") -> Column:
    """The value that body.<path>, header.<name> or query.<name> names; several query values become a list."""
    kind, _, name = source.partition(".")
    if kind == "body":
        return scalar_text(F.try_variant_get(body, "$." + name, "variant"))
    if kind == "header":
        low = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
        return F.try_element_at(low, F.lit(name.lower()))
    pairs = F.filter(F.split(query, "&"), lambda p: F.startswith(p, F.lit(name + "=")))
    values = F.transform(pairs, lambda p: F.try_url_decode(F.substring(p, F.lit(len(name) + 2), F.length(p))))
    return F.when(F.size(values) == 1, values[0]).when(F.size(values) > 1, F.to_json(values))


def redact_headers(headers: Column, marker: str = "[redacted]") -> Column:
    """struct(headers, redacted): sensitive values replaced."""
    clean = F.transform_values(headers, lambda k, v: F.when(k.rlike(SENSITIVE), marker).otherwise(v))
    return F.struct(clean.alias("headers"), F.exists(F.map_keys(headers), lambda k: k.rlike(SENSITIVE)).alias("redacted"))


def clean_headers(headers: Column) -> Column:
    """struct(headers, valid): values cut at 4,000; names of 1 to 100 characters, all on one line."""
    bad = F.map_filter(headers, lambda k, v: ~F.length(k).between(1, 100) | F.concat(k, v).rlike("[\\r\\n]"))
    return F.struct(F.transform_values(headers, lambda k, v: F.substring(v, 1, 4000)).alias("headers"), (F.size(bad) == 0).alias("valid"))


def _segments(path: Column) -> Column:
    """The decoded parts of a path; a plus sign is one."""
    parts = F.filter(F.split(F.regexp_replace(path, "[?#].*$", ""), "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))


#: Shapes of paths up to which they are broadcast.
FEW_SHAPES = 10_000


def route_requests(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """requests(request_id, method, path) with endpoint_ord, record_id, allowed and status.

    endpoints(ord, method, path, database): :name matches any segment. An exact
    match wins; else a database endpoint whose segments are all literal takes
    one segment more, the record's id, but not for POST. The first endpoint in
    order wins. allowed is OPTIONS and the methods of all endpoints that match
    the path, a database one of any method with a segment more too, in their
    order. OPTIONS is 204; without an endpoint a path with other methods is
    405, one without any 404. In a database endpoint that ends in :name the
    last segment is the record's id.

    A path has a key for each shape that endpoints of its length have (which
    segments are literal): its literal segments. Paths and endpoints meet on
    equal shapes and keys.
    """
    free = lambda p: F.startswith(p, F.lit(":"))
    ends = endpoints.withColumn("_p", _segments(F.col("path"))).select(
        "ord", F.col("method").alias("_m"), F.col("database").alias("_db"),
        F.transform("_p", free).alias("shape"), F.to_json(F.transform("_p", lambda p: F.when(free(p), "").otherwise(p))).alias("literal"),
    )
    shapes = ends.select(F.size("shape").alias("n"), "shape").distinct()
    asked = requests.withColumn("_s", _segments(F.col("path")))
    tiers = F.array(F.struct(F.size("_s").alias("n"), F.lit(0).alias("tier")), F.struct((F.size("_s") - 1).alias("n"), F.lit(1).alias("tier")))
    few = shapes.limit(FEW_SHAPES + 1).count() <= FEW_SHAPES
    near = asked.select("request_id", "method", "_s", F.explode(tiers).alias("t")).withColumn("n", F.col("t.n")).join(shapes.hint("broadcast" if few else "merge"), "n")
    near = near.where((F.col("t.tier") == 0) | ~F.exists("shape", lambda f: f))
    near = near.withColumn("literal", F.to_json(F.transform(F.slice("_s", 1, F.col("n")), lambda x, i: F.when(F.get("shape", i), "").otherwise(x))))
    met = near.join(ends.hint("merge"), ["shape", "literal"]).where((F.col("t.tier") == 0) | F.col("_db"))
    own = (F.col("_m") == F.col("method")) & ((F.col("t.tier") == 0) | (F.col("method") != "POST"))
    last = F.when((F.col("t.tier") == 1) | (F.col("_db") & F.element_at("shape", -1)), F.element_at("_s", -1))
    of = met.groupBy("request_id", "_m").agg(F.min("ord").alias("first"), F.min(F.when(own, F.struct("t.tier", "ord", last.alias("record_id")))).alias("b"))  # a row a method
    best = of.groupBy("request_id").agg(F.min("b").alias("b"), F.array_sort(F.collect_list(F.struct("first", "_m"))).alias("ms"))
    allowed = F.array_distinct(F.concat(F.array(F.lit("OPTIONS")), F.coalesce("ms._m", F.array().cast("array<string>"))))
    status = F.when(F.col("method") == "OPTIONS", 204).when(F.col("b").isNotNull(), 200).when(F.col("ms").isNotNull(), 405).otherwise(404)
    return requests.join(best.hint("merge"), "request_id", "left").select(*requests.columns, F.col("b.ord").alias("endpoint_ord"), F.col("b.record_id").alias("record_id"), allowed.alias("allowed"), status.alias("status"))


def drop_orphan_collections(collections: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Collections(project_id, name) that an endpoint still uses, with the methods in use."""
    used = endpoints.groupBy("project_id", F.col("collection").alias("name")).agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return collections.drop("methods").join(used, ["project_id", "name"])


class _Paths:
    """The dotted paths of a JSON text's objects, depth first, in the text's order."""

    def eval(self, text: str, arrays_only: bool):
        try:
            doc = json.loads(text or "null")
        except ValueError:
            return
        stack, n = [("", doc)], 0
        while stack:
            path, value = stack.pop()
            if path and (isinstance(value, list) or not arrays_only):
                yield n, path
                n += 1
            if arrays_only and path and isinstance(value, list) and value:
                value = value[0]
            if isinstance(value, dict):
                stack += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]


def json_paths(df: DataFrame, key: str, text: str = "json", arrays_only: bool = False) -> DataFrame:
    """(key, ord, path) of the dotted object paths of a JSON text, of any depth, depth first in the text's order.

    Arrays aren't entered; with arrays_only just paths of arrays come, and an
    array is entered through its first element. A null text, one that is no
    JSON and one that is no object have none.
    """
    paths = F.udtf(_Paths, returnType="ord int, path string")
    return df.select(F.col(key), F.col(text).alias("_text")).lateralJoin(paths(F.col("_text").outer(), F.lit(arrays_only))).select(key, "ord", "path")


def json_profile(df: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """(keys, n, schema): the schema that all documents of a key fit, fields that differ in kind as VARIANT."""
    return df.groupBy(*keys).agg(F.count(doc).alias("n"), F.schema_of_variant_agg(doc).alias("schema"))


def append_distinct(array: Column, values: Column) -> Column:
    """Each value that equals no present one is appended; what was in the array stays as it is."""
    return F.aggregate(values, array, lambda acc, v: F.when(F.exists(acc, lambda y: y == v), acc).otherwise(F.concat(acc, F.array(v))))


def migrate_legacy_ids(records: DataFrame) -> DataFrame:
    """In versions 1 and 2 an id that is <collection>-<place> goes."""
    made = F.concat_ws("-", "collection", F.col("ord").cast("string"))
    return records.withColumn("id", F.when(F.col("version").between(1, 2) & (F.col("id") == made), None).otherwise(F.col("id")))


#: Rounds after which a collection that still changes is walked in order.
ROUNDS = 24

#: A collection of more requests is settled in rounds over ranges. Results are the same for any value.
CROWD = 4_000_000


def apply_changes(base: DataFrame, requests: DataFrame, most: int = LIMITS["records"], methods: DataFrame | None = None, rounds: int = ROUNDS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(records, responses) after requests(seq, collection, id, method, json) on base(collection, id, json), in order of seq, which is unique.

    id is the record's in the path, null for the collection itself. POST takes
    the id of the body: 404 with one in the path, 400 without one in the body or
    if that is no object, 409 if it is there, 413 if the collection is full.
    PUT replaces, PATCH merges top-level keys, DELETE removes: 404 if the id is
    missing; the path's id wins. methods(collection, methods): others are 405,
    collections without a row have none and are 404; None allows all.

    A refused POST leaves no trace, so what follows on its id may be 404.
    Collections of at most `crowd` requests are walked in order, one pass each,
    with the ids that differ from the base in memory. Larger ones are settled in
    rounds over ranges: taken that some POSTs are refused, the presence of each
    id is a running last value. What then adds and removes records moves a
    counter that stops at `most`: its value is a running sum less a running
    maximum (see _counter), and tells again which POSTs are refused. The first
    requests of a collection that this gets right grow in each round; a round
    that changes nothing is right. Collections that still change after `rounds`
    are walked too.
    """
    lost = F.lit(None).cast("int")
    doc = F.try_parse_json("json").try_cast("map<string, variant>")
    own = requests.select("seq", "collection", F.col("id").cast("string").alias("id"), "method", "json").withColumn("_body", scalar_text(F.try_element_at(doc, F.lit("id"))))
    verdict = lost
    if methods is not None:
        own = own.join(methods.select("collection", F.col("methods").alias("_allowed")).hint("merge"), "collection", "left")
        verdict = F.when(F.col("_allowed").isNull(), 404).when(~F.array_contains("_allowed", F.col("method")), 405)
    post = F.col("method") == "POST"
    made = F.when(post & F.col("id").isNotNull(), 404).when(post & (doc.isNull() | F.col("_body").isNull() | (F.trim("_body") == "") | (F.col("_body") == "null")), 400).when(~post & F.coalesce(F.col("id") == "", F.lit(True)), 404)
    own = own.withColumn("verdict", F.coalesce(verdict, made, F.when(~F.col("method").isin(METHODS[1:]), 405))).withColumn("id", F.when(post, F.col("_body")).otherwise(F.col("id")))
    there = base.select("collection", F.col("id").cast("string").alias("id"), F.lit(True).alias("base")).distinct()
    held = base.groupBy("collection").agg(F.count("*").alias("_held"))
    own = own.drop("_body", "_allowed").join(there.hint("merge"), ["collection", "id"], "left").join(held.hint("merge"), "collection", "left")
    own = own.withColumns({"base": F.coalesce("base", F.lit(False)), "over": F.coalesce("_held", F.lit(0)) - most}).drop("_held")
    own = stored(own, "requests")
    heavy = stored(own.groupBy("collection").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("collection"), "crowded")
    used = [own, heavy]
    if heavy.isEmpty():
        now = _walked(own)
    else:
        hot = _in_rounds(own.join(heavy.hint("merge"), "collection", "left_semi"), rounds)
        used.append(hot)
        now = _walked(own.join(heavy.hint("merge"), "collection", "left_anti")).unionByName(hot.select(*own.columns, "here", "refused"))
    status = (
        F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(post & F.col("here"), 409).when(post & F.col("refused"), 413).when(post, 201)
        .when(~F.col("here"), 404).when(F.col("method") == "DELETE", 204).when(doc.isNull(), 400).otherwise(200)
    )
    done = stored(now.withColumn("status", status).select("seq", "collection", "id", "method", "json", "status"), "responses")
    discard(*used)
    return _documents(base, done), done.select("seq", "collection", "id", "method", "status")


def _present(changes: DataFrame) -> DataFrame:
    """changes with here: whether the id is there before the request, as `refused` has it."""
    known = F.col("verdict").isNull()
    leaves = F.when(known & (F.col("method") == "POST") & ~F.col("refused"), True).when(known & (F.col("method") == "DELETE"), False)
    return running(changes.drop("here"), ["collection", "id"], [F.col("seq")], here=("last", leaves)).withColumn("here", F.coalesce("here", "base"))


def _counter(changes: DataFrame) -> DataFrame:
    """changes with refused: whether the request finds its collection full; `was` is what it was before.

    From n records below the limit, with S the sum of steps so far and M the
    largest S so far, S - max(M, n) records are over the limit, as additions
    beyond it don't count. A base over the limit takes none until enough of it
    is gone; steps count from there.
    """
    known = F.col("verdict").isNull()
    adds = known & (F.col("method") == "POST") & ~F.col("here")
    removes = known & (F.col("method") == "DELETE") & F.col("here")
    order = [F.col("seq")]
    own = running(changes.drop("was").withColumnRenamed("refused", "was"), ["collection"], order, _gone=("sum", F.when(removes, 1)))
    opened = F.coalesce("_gone", F.lit(0)) >= F.col("over")
    own = own.withColumns({"_opened": opened, "_step": F.when(opened, F.when(adds, 1).when(removes, -1))})
    own = running(own, ["collection"], order, _sum=("sum", F.col("_step"))).withColumn("_sum", F.coalesce("_sum", F.lit(0)))
    own = running(own, ["collection"], order, _peak=("max", F.col("_sum") + F.coalesce("_step", F.lit(0))))
    full = ~F.col("_opened") | (F.col("_sum") >= F.greatest(F.col("_peak"), -F.col("over"), F.lit(0)))
    return own.withColumn("refused", adds & full).drop("_gone", "_opened", "_step", "_sum", "_peak")


def _in_rounds(changes: DataFrame, rounds: int) -> DataFrame:
    """changes with here and refused, found for all ranges at once until they agree; a table."""
    now = stored(ranged(changes.withColumn("refused", F.lit(False)), F.col("seq")), "changes")
    for _ in range(rounds):
        after = stored(_counter(_present(now)), "changes")
        discard(now)
        now = after
        if now.where("refused <> was").isEmpty():
            return now
    differ = stored(now.where("refused <> was").select("collection").distinct(), "differ")
    some = now.join(differ.hint("merge"), "collection", "left_semi").drop("here", "refused")
    out = stored(now.join(differ.hint("merge"), "collection", "left_anti").unionByName(_walked(some)), "changes")
    discard(now, differ)
    return out


def _walked(changes: DataFrame) -> DataFrame:
    """changes with here and refused found request by request, a collection after the other."""
    from kilnspark.operators.folds import fold

    def step(state: tuple | None, row) -> tuple[tuple, tuple]:
        over, apart = state or (row.over, {})  # ids that aren't as in the base
        here = apart.get(row.id, row.base)
        if row.verdict is not None:
            return (over, apart), (here, False)
        refused = False
        if row.method == "POST" and not here:
            refused = over >= 0
            if not refused:
                over += 1
                apart[row.id] = True
        elif row.method == "DELETE" and here:
            over -= 1
            apart[row.id] = False
        if apart.get(row.id) == row.base:
            del apart[row.id]
        return (over, apart), (here, refused)

    return fold(changes, ["collection"], ["seq"], step, None, "here boolean, refused boolean", ["id", "method", "verdict", "base", "over"])


def _documents(base: DataFrame, done: DataFrame) -> DataFrame:
    """(collection, id, json) of what is there after the requests in done: by top-level key the last value since the record was last made whole."""
    old = base.select("collection", F.col("id").cast("string").alias("id"), "json", F.lit(None).cast("long").alias("seq"), F.lit("BASE").alias("method"))
    new = done.where("status in (200, 201, 204)").select("collection", "id", "json", F.col("seq").cast("long").alias("seq"), "method")
    every = old.unionByName(new)
    place = F.struct("seq")  # null, the base, is least
    whole = every.groupBy("collection", "id").agg(F.max(F.when(F.col("method") != "PATCH", place)).alias("since"), F.max_by("method", F.when(F.col("method") != "PATCH", place)).alias("by"))
    kept = every.join(whole.where("by <> 'DELETE'").hint("merge"), ["collection", "id"]).where(place >= F.col("since"))
    keys = kept.select("collection", "id", "seq", F.explode(F.try_parse_json("json").try_cast("map<string, variant>")).alias("k", "v"))
    last = keys.groupBy("collection", "id", "k").agg(F.max_by("v", place).alias("v")).where("k <> 'id'")
    text = last.groupBy("collection", "id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # the keys of one record
    ids = kept.select("collection", "id").distinct()
    none = F.create_map().cast("map<string, variant>")
    doc = F.map_concat(F.coalesce("m", none), F.create_map(F.lit("id"), F.to_variant_object(F.array("id")).cast("array<variant>")[0]))
    return ids.join(text.hint("merge"), ["collection", "id"], "left").select("collection", "id", F.to_json(F.to_variant_object(doc)).alias("json"))


def guided_update(records: DataFrame, match: Column, items: str, item_match: object, change: object) -> DataFrame:
    """records with the items that item_match picks changed, in the records that match; all of them or, if nothing is hit, a 404 and no change.

    item_match and change take an element of the array column `items`.
    """
    hits = F.when(match, F.size(F.filter(items, item_match))).otherwise(0)
    total = records.agg(F.coalesce(F.sum(hits), F.lit(0)).alias("_total"))  # one row
    new = F.when(match, F.transform(items, lambda x: F.when(item_match(x), change(x)).otherwise(x))).otherwise(F.col(items))
    hit = F.col("_total") > 0
    own = records.withColumn("_total", total.scalar())
    return own.withColumn("status", F.when(hit, 200).otherwise(404)).withColumn(items, new).drop("_total")
