"""Operators whose queries see few distinct inputs, on cases of their own."""

from pyspark.sql import functions as F

from kilnspark.functions import scalars as s
from kilnspark.operators import audit, collections, layout


def test_svg_problems(spark):
    cases = {
        "": "empty", "   ": "empty", "<p>no</p>": "not svg", "<svg/>": None, "<?xml version='1.0'?>\n<!-- note -->\n<svg></svg>": None,
        "<svg><script>1</script></svg>": "active element", "<svg><foreignObject/></svg>": "active element", "<svg onload='x()'/>": "handler or external resource",
        "<svg><a href=\"https://x.org/a\"/></svg>": "handler or external resource", "<svg><a xlink:href='javascript:1'/></svg>": "handler or external resource",
        "<svg><image href='data:image/png;base64,AA'/></svg>": None, "<svg><image href='data:text/html,x'/></svg>": "handler or external resource",
        "<svg><style>@import url(x.css)</style></svg>": "external style", "<svg><rect fill='url(#a)'/></svg>": None, "<svg><rect fill='url(https://x.org)'/></svg>": "external style", "<svg/><!DOCTYPE x>": "doctype",
    }
    df = spark.createDataFrame([(m,) for m in cases], "m string")
    assert {r.m: r.p for r in df.select("m", s.svg_problem(F.col("m")).alias("p")).collect()} == cases
    assert spark.range(1).select(s.svg_problem(F.lit("<svg>é</svg>"), 11).alias("p")).first().p == "too large"


def test_headers(spark):
    maps = [({"Authorization": "x", "Accept": "*/*"}, True, True), ({"X-Api-Key": "k"}, True, True), ({"X-Session-Token": "t"}, True, True), ({"Accept": "a\r\nb"}, False, False), ({"": "x"}, False, False), ({"a" * 101: "x"}, False, False), ({"Long": "v" * 5000}, False, True), ({}, False, True)]
    df = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(maps)], "i int, h map<string,string>")
    for r in df.select("i", "h", collections.redact_headers(F.col("h")).alias("r"), collections.clean_headers(F.col("h")).alias("c")).collect():
        _, hidden, valid = maps[r.i]
        assert r.r.redacted == hidden and r.c.valid == valid
        assert all((v == "[redacted]") == hidden or k == "Accept" for k, v in r.r.headers.items())
        assert all(len(v) <= 4000 for v in r.c.headers.values())


def test_records(spark):
    cases = {"{bad": "not json", "[1]": "not an object", '"x"': "not an object", '{"a":1}': None, '{"constructor":1}': "forbidden key", '{"a":[{"b":{"prototype":1}}]}': "forbidden key", '{"a":"__proto__"}': None}
    got = {r.json: r.reason for r in collections.validate_records(spark.createDataFrame([(c,) for c in cases], "json string")).collect()}
    assert got == cases


def test_covered_runs(spark):
    images = [("a", 0, 5, 300, 400, 600.0, 800.0), ("b", 0, 5, 299, 400, 598.0, 800.0), ("c", 0, 5, 400, 400, 440.0, 400.0), ("d", 0, 5, 415, 400, 400.0, 400.0), ("e", 0, 1, 300, 300, 300.0, 300.0)]
    runs = spark.createDataFrame([(x, 0, 3) for x in "abcdef"], "doc_id string, page_index int, end_order int")
    df = spark.createDataFrame(images, "doc_id string, page_index int, paint_order int, width int, height int, page_width double, page_height double")
    assert sorted(r.doc_id for r in layout.hide_covered(runs, df).collect()) == ["b", "c", "e", "f"]


def test_paths_of_documents(spark):
    deep = '{"d":' * 12 + "1" + "}" * 12
    df = spark.createDataFrame([(1, '{"z":{"b":1,"c":{"d":[{"e":1}]}},"l":[{"m":{"n":[1]}}],"x":null}'), (2, deep), (3, None), (4, "{bad"), (5, "[1]")], "i int, json string")
    paths = lambda **k: [(r.i, r.path) for r in collections.json_paths(df, "i", **k).orderBy("i", "ord").collect()]
    assert paths() == [*((1, p) for p in ["z", "z.b", "z.c", "z.c.d", "l", "x"]), *((2, ".".join("d" * n)) for n in range(1, 13))]
    assert paths(arrays_only=True) == [(1, "z.c.d"), (1, "l"), (1, "l.m.n")]


def test_profile_of_documents(spark):
    df = spark.createDataFrame([("x", '{"a":1}'), ("x", '{"a":"s","b":[1]}'), ("y", '{"a":2}'), ("y", None)], "k string, json string").select("k", F.parse_json("json").alias("doc"))
    assert {r.k: (r.n, r.schema) for r in collections.json_profile(df, ["k"]).collect()} == {"x": (2, "OBJECT<a: VARIANT, b: ARRAY<BIGINT>>"), "y": (1, "OBJECT<a: BIGINT>")}


def test_assigned_paths(spark):
    cases = [("{}", "1", '{"a":{"b":1}}'), ('{"a":5,"é":"ü"}', '"x"', '{"a":{"b":"x"},"é":"ü"}'), ('{"a":{"c":[1.5],"b":0}}', "[null]", '{"a":{"b":[null],"c":[1.5]}}'), ("[1]", "{}", '{"a":{"b":{}}}'), (None, "true", '{"a":{"b":true}}')]
    df = spark.createDataFrame([(i, j, v) for i, (j, v, _) in enumerate(cases)], "i int, json string, v string")
    assert {r.i: r.json for r in collections.assign_path(df, "a.b", "v").collect()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_sitemap_entries(spark):
    xml = "<urlset><url><loc> https://x.org/a/ </loc><lastmod>2024-01-01</lastmod></url>\n<url><loc>https://x.org</loc></url></urlset>"
    assert [(r.ord, r.path, r.lastmod) for r in audit.parse_sitemap(spark.createDataFrame([(xml,)], "xml string")).orderBy("ord").collect()] == [(0, "/a", "2024-01-01"), (1, "/", None)]


def test_short_words_read_without_confidence(spark):
    cases = {("oh", 0.0): False, ("the", 0.0): True, ("the", 0.5): False, ("₹", 0.0): False, ("--", 0.9): True, ("word", 0.0): False, ("xq", None): False}
    df = spark.createDataFrame([(t, c) for t, c in cases], "t string, c double")
    assert {(r.t, r.c): r.g for r in df.select("t", "c", s.graphic_word(F.col("t"), F.col("c")).alias("g")).collect()} == cases


def test_error_tail_keeps_what_a_line_begins_with(spark):
    cases = {"0a\n12 b\n 2c \r\n3d": "12 b 2c 3d", "\n1\n\u00a0\n": "1", " \n\u3000": "Process exited with code 3"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.e for r in df.select("t", s.error_tail(F.col("t"), F.lit(3)).alias("e")).collect()} == cases


def test_repeated_paragraphs_are_whole_lines(spark):
    long = "1" * 60 + "a" * 60 + "2"
    df = spark.createDataFrame([(1, f"x\n{long}"), (2, f"x\ny\n \u00a0{long} "), (3, long[1:]), (4, None)], "doc_id int, text string")
    assert [tuple(r) for r in audit.repeated_paragraphs(df).collect()] == [(long, 2)]


def test_majority_of_scripts(spark):
    cases = {
        "": "neutral", "12 .,": "neutral", "aé1 я": "latin", "я a": "cyrillic", "a я": "latin", "aя λλ b": "latin", "λλя aя": "greek", "яλaяλa": "cyrillic", "漢字 a": "han", "אב a": "hebrew", "ab אב": "latin", "अआ": "devanagari", "ªº": "latin",
        "௧௨ 𝒜": "tamil", "𠀀𠀁 ab c": "latin", "x𠀀𠀁": "han", "\n\u0000[`{~@ мы": "cyrillic",
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert {r.t: r.s for r in df.select("t", s.majority_script(F.col("t")).alias("s")).collect()} == cases | {None: "neutral"}
