"""Updates of a collection that a request guides: which records, which items of their arrays, and what they get.

An action is a dict:

* recordMatch: [{source, recordPath, operator}], all of which a record must fit
* nestedUpdates: [{arrayPath, source, matchPath, operator, set: {path: value}, copy: {path: source}}]
* arrayUpdates: [{arrayPath, source, dedupe}]

A source is body.<path>, header.<name> or query.<name>; an operator equals or in.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.operators.collections import loose_equal, put_at


def _at(value: Column, path: str) -> Column:
    """The variant at a dotted path, null if a key is missing."""
    steps = "".join("['{}']".format(k.replace("\\", "\\\\").replace("'", "\\'")) for k in path.split("."))
    return F.try_variant_get(value, "$" + steps, "variant")


def _items(value: Column) -> Column:
    return value.try_cast("array<variant>")


def source_value(source: str) -> Column:
    """What a request(body variant, headers map, query string) has at a source as a variant, null if it isn't there; of several query values the list."""
    kind, _, name = source.partition(".")
    if kind == "body":
        return _at(F.col("body"), name)
    if kind == "header":
        low = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name.lower())
        return F.get(low, F.lit(0))["value"].cast("variant")
    if kind != "query":
        return F.lit(None).cast("variant")
    decoded = lambda x: F.try_url_decode(x)
    pairs = F.filter(F.split("query", "&"), lambda p: decoded(F.substring_index(p, "=", 1)) == name)
    values = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise(""))
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)).cast("variant")).when(F.size(values) > 1, F.to_variant_object(values))


def _same(a: Column, b: Column) -> Column:
    return loose_equal(a, b) | F.coalesce(F.is_variant_null(a) & F.is_variant_null(b), F.lit(False))


def _fits(value: Column, source: Column, operator: str) -> Column:
    """Whether a value, or an element of it if it is an array of values or of arrays, equals the source, or one of its elements for `in`."""
    wanted = F.coalesce(_items(source), F.array(source)) if operator == "in" else F.array(source)
    one = lambda v: F.exists(wanted, lambda s: _same(v, s))
    each = lambda v, then: F.when(_items(v).isNotNull(), F.exists(_items(v), then)).otherwise(one(v))
    return F.coalesce(value.isNotNull() & each(value, lambda v: each(v, one)), F.lit(False))


def _assigned(item: Column, update: dict, sources: dict[str, Column]) -> Column:
    """The item with what the update sets and copies."""
    values = [(path, F.parse_json(F.lit(json.dumps(v)))) for path, v in (update.get("set") or {}).items()]
    values += [(path, sources[s]) for path, s in (update.get("copy") or {}).items()]
    return reduce(lambda doc, pv: put_at(doc, pv[0].split("."), pv[1]), values, item)


def _taker(update: dict, source: Column) -> Callable[[Column], Column]:
    return lambda x: _fits(_at(x, update["matchPath"]), source, update.get("operator", "equals"))


def _changer(update: dict, takes: Callable[[Column], Column], sources: dict[str, Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(takes(x), _assigned(x, update, sources)).otherwise(x)


def apply_guided(records: DataFrame, requests: DataFrame, action: dict, success: int = 200) -> tuple[DataFrame, DataFrame]:
    """(records, responses) after one request a collection: requests(collection, body, headers, query) on records(collection, doc, ...).

    Records keep their columns; doc is a variant and is rewritten from the
    items up to the top. A rule that touches nothing anywhere is 404, a source
    that is needed and missing 400, and so is one to append that is no array.
    The first such rule decides, and nothing of the collection changes then. A
    collection without records is 404. All rules of a request are evaluated in
    one pass over its records; one aggregate a collection decides.
    """
    nested, appends = action.get("nestedUpdates") or [], action.get("arrayUpdates") or []
    names = [m["source"] for m in (action.get("recordMatch") or []) + nested + appends] + [s for u in nested for s in (u.get("copy") or {}).values()]
    names = list(dict.fromkeys(names))
    asked = requests.select("collection", F.struct(F.lit(0).alias("_"), *[source_value(s).alias(f"s{i}") for i, s in enumerate(names)]).alias("_src"))
    sources = {s: F.col(f"_src.s{i}") for i, s in enumerate(names)}
    missing = {s: F.col(f"_src.s{i}").isNull() for i, s in enumerate(names)}
    own = records.join(asked.hint("merge"), "collection", "left").withColumns({"_new": F.col("doc"), "_hit": F.col("_src").isNotNull()})
    errors, facts = [], {}
    for k, match in enumerate(action.get("recordMatch") or []):
        own = own.withColumns({f"_p{k}": F.col("_hit"), "_hit": F.col("_hit") & _fits(_at(F.col("doc"), match["recordPath"]), sources[match["source"]], match.get("operator", "equals"))})
        facts[f"p{k}"] = F.bool_or(F.col(f"_p{k}") & missing[match["source"]])
        errors.append(F.when(F.col(f"p{k}"), 400))
    facts["hits"] = F.count_if("_hit")
    errors.append(F.when(F.col("hits") == 0, 404))
    for k, update in enumerate(nested):
        source, path = sources[update["source"]], update["arrayPath"]
        takes = _taker(update, source)
        own = own.withColumn("_list", F.when(F.col("_hit"), _items(_at(F.col("_new"), path))))
        own = own.withColumn(f"_n{k}", F.size(F.filter(F.coalesce("_list", F.array().cast("array<variant>")), takes))).withColumn(f"_h{k}", F.col("_list").isNotNull())
        changed = F.transform("_list", _changer(update, takes, sources))
        own = own.withColumn("_new", F.when(F.col(f"_n{k}") > 0, put_at(F.col("_new"), path.split("."), F.to_variant_object(changed))).otherwise(F.col("_new")))
        lost = reduce(lambda a, b: a | b, [missing[s] for s in (update.get("copy") or {}).values()], F.lit(False))
        facts |= {f"n{k}": F.sum(f"_n{k}"), f"h{k}": F.bool_or(F.col(f"_h{k}") & missing[update["source"]]), f"c{k}": F.bool_or((F.col(f"_n{k}") > 0) & lost)}
        errors += [F.when(F.col(f"h{k}") | F.col(f"c{k}"), 400), F.when(F.col(f"n{k}") == 0, 404)]
    for k, update in enumerate(appends):
        source, path = sources[update["source"]], update["arrayPath"]
        own = own.withColumn("_list", F.when(F.col("_hit"), _items(_at(F.col("_new"), path)))).withColumn(f"_a{k}", F.col("_list").isNotNull())
        new = F.coalesce(_items(source), F.array().cast("array<variant>"))
        once = F.aggregate(new, F.col("_list"), lambda acc, v: F.when(F.exists(acc, lambda y: _same(y, v)), acc).otherwise(F.concat(acc, F.array(v))))
        full = once if update.get("dedupe", True) else F.concat("_list", new)
        own = own.withColumn("_new", F.when(F.col(f"_a{k}"), put_at(F.col("_new"), path.split("."), F.to_variant_object(full))).otherwise(F.col("_new")))
        facts |= {f"a{k}": F.bool_or(f"_a{k}"), f"b{k}": F.bool_or(F.col(f"_a{k}") & _items(source).isNull())}
        errors += [F.when(F.col(f"b{k}"), 400), F.when(~F.col(f"a{k}"), 404)]
    verdicts = own.where("_src is not null").groupBy("collection").agg(*[f.alias(n) for n, f in facts.items()]).select("collection", F.coalesce(*errors, F.lit(success)).alias("status"))
    responses = requests.select("collection").join(verdicts.hint("merge"), "collection", "left").select("collection", F.coalesce("status", F.lit(404)).alias("status"))
    done = own.join(verdicts.where(F.col("status") == success).select("collection", F.lit(True).alias("_done")).hint("merge"), "collection", "left")
    doc = F.when(F.col("_done") & F.col("_hit"), F.col("_new")).otherwise(F.col("doc"))
    return done.withColumn("doc", doc).select(*records.columns), responses
