"""Queries on conversations, lineitem and part as pages of text runs, words and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kilnspark.functions import scalars as s
from kilnspark.operators import collections, layout
from kilnspark.plans.registry import query


def runs(t):
    """A conversation is a page, a turn a run: its whole text."""
    text = F.col("text")
    return t("conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_index"), F.col("turn").cast("int").alias("ordinal"), text.alias("text"), F.sha2(text, 256).alias("text_hash"), F.sha2(F.col("conv_id").cast("string"), 256).alias("source_hash"),
        (F.col("role") != "system").alias("editable"), s.run_id(F.lit(0), F.col("turn"), text, F.sha2(F.col("conv_id").cast("string"), 256)).alias("run_id"),
    )


RUNS_SQL = r"runs AS (SELECT conv_id AS doc_id, turn::INT AS ordinal, text AS text, role <> 'system' AS editable, regexp_replace(text, '\s+', '', 'g') AS key FROM conversations)"


@query("a3_run_totals", "SELECT conv_id AS doc_id, count(*) AS n_runs, count_if(role <> 'system') AS n_editable FROM conversations GROUP BY conv_id")
def a3(t):
    return layout.run_totals(runs(t), ["doc_id"])


@query("r2_resolve_pages", "SELECT l_orderkey AS request_id, l_linenumber AS pos, CASE WHEN l_returnflag = 'A' THEN 'blank' ELSE 'source' END AS kind, CASE WHEN l_returnflag <> 'A' AND (p_partkey IS NULL) THEN 'missing page' END AS error FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 40")
def r2(t):
    plan = t("lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "A", "blank").otherwise("source").alias("kind"), F.lit(0).alias("pdf_index"), F.col("l_partkey").alias("page_index"))
    held = t("part").where("p_size < 40").select(F.col("p_partkey").alias("page_index"), F.lit(0).alias("pdf_index"), F.col("p_name").alias("page"))
    pages = plan.select("request_id", "page_index").distinct().join(held, "page_index")
    return layout.resolve_pages(plan, pages).select("request_id", "pos", "kind", "error")


@query("r3_attach_images", "SELECT l_orderkey AS request_id, l_linenumber AS field, CASE WHEN o_orderkey IS NULL THEN 'missing file' WHEN o_orderstatus <> 'F' THEN 'not an image' END AS reason FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber = 1")
def r3(t):
    plan = t("lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("field"))
    files = t("orders").select(F.col("o_orderkey").alias("request_id"), F.lit(1).alias("field"), F.lit("n").alias("name"), F.when(F.col("o_orderstatus") == "F", "image/png").otherwise("text/plain").alias("mime"))
    return layout.attach_images(plan, files).select("request_id", "field", "reason")


def edits(t):
    """An edit for each run, some of them under another ordinal or id."""
    r = runs(t)
    return r.select(F.concat_ws("-", "doc_id", "ordinal").alias("edit_id"), "doc_id", "page_index", F.when(F.col("ordinal") % 3 == 0, F.col("run_id")).otherwise("gone").alias("run_id"), F.when(F.col("ordinal") % 3 == 2, F.col("ordinal") + 50).otherwise(F.col("ordinal")).alias("ordinal"), F.concat(F.lit(" "), "text").alias("original_text"), "text_hash", F.lit("new").alias("replacement"))


@query("r4_resolve_edits", rf"""WITH {RUNS_SQL}, e AS (SELECT doc_id || '-' || ordinal AS edit_id, doc_id, key, ordinal AS own, CASE WHEN ordinal % 3 = 2 THEN ordinal + 50 ELSE ordinal END AS want FROM runs),
n AS (SELECT e.edit_id, any_value(e.own) AS own, any_value(e.want) AS want, count(*) AS n, arg_min(r.ordinal, abs(r.ordinal - e.want) * 1000 + r.ordinal) AS near FROM e JOIN runs r USING (doc_id, key) GROUP BY e.edit_id)
SELECT edit_id, CASE WHEN own % 3 = 0 THEN 0 WHEN own % 3 = 1 THEN 1 WHEN n = 1 THEN 3 ELSE 4 END AS tier, CASE WHEN own % 3 < 2 THEN own ELSE near END AS run_ordinal FROM n""")
def r4(t):
    return layout.resolve_edits(edits(t), runs(t)).select("edit_id", "tier", "run_ordinal")


@query("d4_apply_text_edits", "SELECT conv_id AS doc_id, turn::INT AS ordinal, CASE WHEN turn % 3 = 0 THEN 'new' ELSE text END AS text FROM conversations")
def d4(t):
    some = edits(t).where("run_id <> 'gone'")
    return layout.apply_edits(runs(t), some).select("doc_id", "ordinal", "text")


@query("d3_verify_edits", "SELECT conv_id || '-' || turn AS edit_id, CASE WHEN turn % 4 = 1 THEN 'stale source' WHEN turn % 4 = 2 THEN 'changed text' WHEN turn % 4 = 3 THEN 'wrong id' WHEN role = 'system' THEN 'not editable' END AS reason FROM conversations")
def d3(t):
    k = F.col("ordinal") % 4
    asked = runs(t).select(F.concat_ws("-", "doc_id", "ordinal").alias("edit_id"), "doc_id", "page_index", "ordinal", F.when(k == 3, F.concat("run_id", F.lit("x"))).otherwise(F.col("run_id")).alias("run_id"), F.when(k == 2, "x").otherwise(F.col("text_hash")).alias("text_hash"), F.when(k == 1, "x").otherwise(F.col("source_hash")).alias("source_hash"))
    return layout.verify_edits(asked, runs(t)).select("edit_id", "reason")


@query("r5_resolve_groups", "SELECT a.conv_id || '-' || a.turn AS group_id, a.turn::INT AS first, (a.turn + 1)::INT AS last FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def r5(t):
    """Every two neighbouring turns' joined text is sought on its page."""
    r = runs(t).withColumn("text", F.concat("ordinal", F.lit(":"), "text"))
    after = F.lead(F.struct("ordinal", "text")).over(Window.partitionBy("doc_id", "page_index").orderBy("ordinal"))
    pair = r.withColumn("next", after).where(F.col("next.ordinal") == F.col("ordinal") + 1)
    groups = pair.select(F.concat_ws("-", "doc_id", "ordinal").alias("group_id"), "doc_id", "page_index", F.concat_ws(" ", "text", "next.text").alias("wanted"), "ordinal")
    return layout.resolve_groups(groups, r)


@query("r14_overlay_ocr_pages", "SELECT conv_id AS doc_id, turn::INT AS ordinal, CASE WHEN conv_id % 3 = 0 THEN 'scan' ELSE text END AS text FROM conversations WHERE conv_id % 3 <> 0 OR turn = 0")
def r14(t):
    r = runs(t).select("doc_id", "page_index", "ordinal", "text")
    return layout.overlay_pages(r, r.where("doc_id % 3 = 0 and ordinal = 0").withColumn("text", F.lit("scan"))).select("doc_id", "ordinal", "text")


@query("r15_align_items", r"""WITH RECURSIVE i AS (SELECT conv_id AS doc_id, turn AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, regexp_replace(CASE WHEN turn % 3 = 2 THEN 'absent text' ELSE text END, '\s+', '', 'g') AS want FROM conversations),
p AS (SELECT conv_id AS doc_id, string_agg(k, '' ORDER BY turn) AS page, list(n ORDER BY turn) || [0] AS edges FROM (SELECT conv_id, turn, k, (sum(length(k)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS n FROM (SELECT *, regexp_replace(text, '\s+', '', 'g') AS k FROM conversations)) GROUP BY conv_id),
f AS (SELECT doc_id, 0::BIGINT AS i, NULL::BIGINT AS ord, 0::BIGINT AS cur, NULL::BIGINT AS place FROM p UNION ALL
 SELECT doc_id, i, ord, CASE WHEN fits THEN spot + length(want) ELSE cur END, CASE WHEN fits THEN spot END FROM (
  SELECT *, want <> '' AND spot >= cur AND list_contains(edges, spot) AND list_contains(edges, spot + length(want)) AS fits FROM (
   SELECT f.doc_id, i.i, i.ord, f.cur, i.want, p.edges, f.cur + strpos(substr(p.page, f.cur + 1), i.want) - 1 AS spot FROM f JOIN i ON i.doc_id = f.doc_id AND i.i = f.i + 1 JOIN p ON p.doc_id = f.doc_id)))
SELECT doc_id, ord, place FROM f WHERE i > 0""")
def r15(t):
    r = runs(t)
    items = r.select("doc_id", "page_index", F.col("ordinal").alias("ord"), F.when(F.col("ordinal") % 3 == 2, "absent text").otherwise(F.col("text")).alias("text"))
    return layout.align_items(items, r).select("doc_id", "ord", "place")


@query("r16_hide_covered_runs", "SELECT conv_id AS doc_id, turn::INT AS ordinal FROM conversations WHERE NOT (conv_id % 2 = 0 AND turn < 3)")
def r16(t):
    r = runs(t).withColumn("end_order", F.col("ordinal"))
    images = r.where("ordinal = 0").select("doc_id", "page_index", F.lit(3).alias("paint_order"), F.when(F.col("doc_id") % 2 == 0, 300).otherwise(299).alias("width"), F.lit(400).alias("height"), F.lit(600).alias("page_width"), F.lit(800).alias("page_height"))
    return layout.hide_covered(r, images).select("doc_id", "ordinal")


@query("d11_merge_visual_duplicates", r"SELECT conv_id AS doc_id, regexp_replace(left(text, 3), '\s+', '', 'g') AS key, count(*) AS n, string_agg(turn, ',' ORDER BY turn) AS ordinals, bool_and(role <> 'system') AS editable FROM conversations GROUP BY conv_id, key, turn % 3")
def d11(t):
    """The first letters of the turns on three lines; what differs by less than a thousandth is one place."""
    k = F.col("ordinal")
    r = runs(t).withColumns({"text": F.substring("text", 1, 3), "mode": F.lit("pdf"), "geometry": F.array(1.0 + k % 2 * 0.0004, 2.0 + k % 3 * 0.001), "reason": F.lit("r")})
    return layout.merge_visual_duplicates(r).select("doc_id", "key", "n", F.array_join(F.col("ordinals").cast("array<string>"), ",").alias("ordinals"), "editable")


@query("d12_pages_needing_ocr", "SELECT conv_id AS doc_id FROM conversations GROUP BY conv_id HAVING bool_and(conv_id % 4 = 0) OR NOT bool_or(role <> 'system' AND conv_id % 4 <> 0)")
def d12(t):
    return layout.pages_needing_ocr(runs(t).withColumn("hidden", F.col("doc_id") % 4 == 0), "auto").select("doc_id")


def words(t):
    """The words of the whole turns, placed on lines of ten."""
    text = F.col("text")
    w = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), F.posexplode(F.split(text, " ")).alias("ord", "text")).where("text <> ''")
    x, y = (F.col("ord") % 10) * 50, F.floor(F.col("ord") / 10) * 20
    return w.withColumns({"confidence": (F.col("ord") % 100).cast("double"), "x0": x.cast("double"), "y0": y.cast("double"), "x1": (x + 45).cast("double"), "y1": (y + 12).cast("double"), "graphic": s.graphic_word(F.col("text"), F.lit(1.0))})


#: Words of the turns, by place among the parts between spaces, ten places a line.
WORDS_SQL = r"words AS (SELECT conv_id AS doc_id, turn AS page_index, i - 1 AS ord, w AS text, NOT regexp_matches(w, '^[₹$€£¥₽₩¢]$') AND NOT regexp_matches(w, '[\p{L}\p{N}]') AS graphic, (i - 1) % 10 * 50 AS x0, (i - 1) // 10 * 20 AS y0 FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations) WHERE w <> '')"


#: Whether a space stands between the text so far, a, and the next word, w.
SPACED = "NOT (regexp_matches(trim(a), '^[₹$€£¥₽₩¢]$') OR regexp_matches(trim(a), '^[₹$€£¥₽₩¢]\\s*[-+]?\\d') OR regexp_matches(trim(w), '^[,.;:%!?)]'))"


@query("w8_join_words", rf"""WITH {WORDS_SQL}, v AS (SELECT *, CASE WHEN ord % 6 = 2 THEN 40 ELSE 12 END AS high FROM words),
b AS (SELECT *, coalesce(NOT graphic AND NOT lag(graphic) OVER o AND lag(y0) OVER o = y0 AND x0 - lag(x0) OVER o - 45 BETWEEN 0 AND greatest(10, 1.8 * high), false) AS joins FROM v WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY ord)),
g AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id, page_index ORDER BY ord) - 1 AS phrase FROM b)
SELECT doc_id, page_index, phrase, list_reduce(list(text ORDER BY ord), lambda a, w: CASE WHEN {SPACED} THEN a || ' ' || w ELSE a || w END) AS text, min(ord % 100)::DOUBLE AS confidence,
 min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, (max(x0) + 45)::DOUBLE AS x1, max(y0 + high)::DOUBLE AS y1 FROM g GROUP BY ALL""")
def w8(t):
    """Every sixth word is high: only its own height lets it join over a wide gap."""
    own = words(t).withColumn("y1", F.col("y0") + F.when(F.col("ord") % 6 == 2, 40).otherwise(12))
    return layout.join_words(own, ["ord"])


@query("k5_reading_order", f"WITH {WORDS_SQL} SELECT doc_id, page_index, ord, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY (y0 * 7) % 60, x0 * 3 % 70, ord) AS turn FROM words")
def k5(t):
    """Words whose places on the page are not in the order of the text."""
    moved = words(t).withColumns({"y0": F.col("y0") * 7 % 60, "x0": F.col("x0") * 3 % 70})
    return layout.reading_order(moved).select("doc_id", "page_index", "ord", "turn")


@query("d10_build_run", f"WITH {WORDS_SQL} SELECT doc_id, page_index, ord, 9.0::DOUBLE AS font_size, NOT graphic AS editable, CASE WHEN graphic THEN 'looks like a graphic' ELSE '' END AS reason FROM words")
def d10(t):
    return layout.build_runs(words(t), 0.75).select("doc_id", "page_index", "ord", "font_size", "editable", "reason")


@query("d2_ocr_run_id", f"""WITH {WORDS_SQL} SELECT doc_id, page_index, ord, 'p' || page_index || '-ocr-o' || ord || '-t' || left(sha256(text), 16) || '-b' || left(sha256(x0 || CASE WHEN ord % 4 = 0 THEN '' ELSE '.' || (ord % 4 * 2 + 1) END || '-' || y0 || '-' || (x0 + 45) || '-' || (y0 + 12) || '.5'), 12) || '-f' || left(sha256(text || 's'), 16) AS id FROM words""")
def d2(t):
    """Boxes with fractions; what is beyond a tenth is rounded."""
    k = F.col("ord") % 4
    box = [F.when(k == 0, F.col("x0") + 0.04).otherwise(F.col("x0") + (k * 2 + 1) / 10.0), F.col("y0"), F.col("x1") - 0.02, F.col("y1") + 0.46]
    return words(t).select("doc_id", "page_index", "ord", s.ocr_run_id(F.col("page_index"), F.col("ord"), F.col("text"), F.sha2(F.concat("text", F.lit("s")), 256), box).alias("id"))


@query("d7_box_math", f"""WITH {WORDS_SQL}, b AS (SELECT doc_id, page_index, ord, x0 + ord % 3 AS a0, x0 + 45 AS a1, y0 + ord % 7 * 4 AS b0, y0 + ord % 7 * 4 + 6 + ord % 5 * 5 AS b1 FROM words),
p AS (SELECT *, lag(a0) OVER w AS c0, lag(a1) OVER w AS c1, lag(b0) OVER w AS d0, lag(b1) OVER w AS d1 FROM b WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY ord))
SELECT doc_id, page_index, ord, greatest(0, least(b1, d1) - greatest(b0, d0))::DOUBLE / greatest(1, least(b1 - b0, d1 - d0)) AS shared, greatest(0, greatest(a0, c0) - least(a1, c1))::DOUBLE AS gap FROM p WHERE c0 IS NOT NULL""")
def d7(t):
    """How each word's box lies to the one before: boxes of several heights and lines."""
    k, x, y = F.col("ord"), F.col("x0"), F.col("y0")
    w = Window.partitionBy("doc_id", "page_index").orderBy("ord")
    own = words(t).select("doc_id", "page_index", "ord", (x + k % 3).alias("a0"), (x + 45).alias("a1"), (y + k % 7 * 4).alias("b0"), (y + k % 7 * 4 + 6 + k % 5 * 5).alias("b1"))
    both = own.withColumns({n: F.lag(c).over(w) for n, c in (("c0", "a0"), ("c1", "a1"), ("d0", "b0"), ("d1", "b1"))}).where("c0 is not null")
    box = [F.col(c) for c in ("b0", "b1", "d0", "d1", "a0", "a1", "c0", "c1")]
    return both.select("doc_id", "page_index", "ord", s.overlap_ratio(*box[:4]).alias("shared"), s.box_gap(*box[4:]).alias("gap"))


#: A turn is a page; pieces of three letters at most are runs, spaces are items between them; every ninth run has no width, some lines are tilted.
PIECES_SQL = r"""pieces AS (SELECT conv_id AS doc_id, turn AS page_index, i - 1 AS ordinal, p AS text, p = ' ' AS item FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ ]{1,3}| ')) AS p, generate_subscripts(regexp_extract_all(text, '[^ ]{1,3}| '), 1) AS i FROM conversations))"""


@query("w7_merge_runs", rf"""WITH {PIECES_SQL}, r AS (SELECT *, CASE WHEN ordinal % 9 = 4 THEN 0.0 ELSE 5.0 END AS width, ordinal * 6.0 AS along, (ordinal // 40) % 2 AS tilt FROM pieces),
b AS (SELECT *, coalesce(lag(tilt) OVER o = tilt AND NOT lag(item) OVER o AND NOT regexp_matches(text, '\s') AND NOT regexp_matches(lag(text) OVER o, '\s'), false) AS joins FROM r WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY ordinal)),
g AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id, page_index ORDER BY ordinal) - 1 AS word FROM b WHERE NOT item)
SELECT doc_id, page_index, word, string_agg(text, '' ORDER BY ordinal) AS text, string_agg(ordinal, ',' ORDER BY ordinal) AS ordinals, round(greatest(arg_min(width, ordinal), max(along) + arg_max(width, ordinal) - min(along)), 6)::DOUBLE AS width, bool_and(ordinal % 7 <> 3) AS editable FROM g GROUP BY ALL""")
def w7(t):
    pieces = F.regexp_extract_all(F.col("text"), F.lit("[^ ]{1,3}| "), F.lit(0))
    own = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), F.posexplode(pieces).alias("ordinal", "text"))
    o, tilted = F.col("ordinal"), F.floor(F.col("ordinal") / 40) % 2 == 1
    flat = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), o * 6.0, F.lit(10.0))
    tilt = F.array(F.lit(0.6), F.lit(0.8), F.lit(-0.8), F.lit(0.6), o * 6 * 0.6 - 8.0, o * 6 * 0.8 + 6.0)
    runs_ = own.withColumns({"font_name": F.lit("f"), "transform": F.when(tilted, tilt).otherwise(flat), "width": F.when(o % 9 == 4, 0.0).otherwise(5.0), "height": F.lit(10.0), "editable": o % 7 != 3, "item": F.col("text") == " "})
    return layout.merge_runs(runs_).withColumn("ordinals", F.array_join(F.col("ordinals").cast("array<string>"), ","))


#: Of every ten words one is said again by a token, of three heights, some of them no amounts; they act one after the other on a list of a page's numeric words. For WITH RECURSIVE.
CURRENCY_SQL = r"""w AS (SELECT doc_id, page_index, ord, CASE WHEN ord % 5 = 0 THEN (ord * 7) || '.50' ELSE text END AS t, (ord % 100)::DOUBLE AS c, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x0 + 45.0::DOUBLE AS x1, y0 + 12.0::DOUBLE AS y1, graphic FROM words),
num AS (SELECT *, regexp_matches(trim(t), '^[₹$€£¥₽₩¢\s]*[-+]?\d[\d\s.,%₹$€£¥₽₩¢]*$') AND NOT graphic AS n FROM w),
k AS (SELECT doc_id, page_index, ord, CASE WHEN ord % 30 = 15 THEN t ELSE '$' || t END AS t, c + 1 AS c, x0 - 8 AS x0, y0, x1, y0 + 12 + ord // 10 % 3 * 8 AS y1, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY ord) AS i FROM w WHERE ord % 10 = 5 AND ord % 30 <> 15),
f AS (SELECT doc_id, page_index, 0::BIGINT AS i, coalesce(list({'t': t, 'c': c, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'a': 0, 'o': ord} ORDER BY ord) FILTER (n), []) AS l FROM num GROUP BY ALL UNION ALL
 SELECT doc_id, page_index, i, CASE WHEN best IS NULL THEN list_append(l, {'t': t, 'c': c, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'a': 1, 'o': ord}) ELSE
  list_transform(l, lambda b, j: CASE WHEN j = best THEN {'t': t, 'c': greatest(b.c, c), 'x0': least(b.x0, x0), 'y0': least(b.y0, y0), 'x1': greatest(b.x1, x1), 'y1': greatest(b.y1, y1), 'a': b.a, 'o': b.o} ELSE b END) END
 FROM (SELECT *, list_position(s, list_max(s)) AS best FROM (SELECT f.l, k.*, list_transform(f.l, lambda b: CASE
   WHEN greatest(0, least(b.y1, k.y1) - greatest(b.y0, k.y0)) / greatest(1, least(b.y1 - b.y0, k.y1 - k.y0)) >= 0.35 AND greatest(0, greatest(b.x0, k.x0) - least(b.x1, k.x1)) <= greatest(12, (k.y1 - k.y0) * 2.5)
   THEN greatest(0, least(b.y1, k.y1) - greatest(b.y0, k.y0)) / greatest(1, least(b.y1 - b.y0, k.y1 - k.y0)) * 3 - greatest(0, greatest(b.x0, k.x0) - least(b.x1, k.x1)) / greatest(1, k.y1 - k.y0) END) AS s
  FROM f JOIN k ON k.doc_id = f.doc_id AND k.page_index = f.page_index AND k.i = f.i + 1)))"""


@query("r6_join_currency", rf"""WITH RECURSIVE {WORDS_SQL}, {CURRENCY_SQL}, e AS (SELECT doc_id, page_index, unnest(l, recursive := true) FROM (SELECT doc_id, page_index, arg_max(l, i) AS l FROM f GROUP BY ALL) UNION ALL SELECT doc_id, page_index, t, c, x0, y0, x1, y1, 0, ord FROM num WHERE NOT n)
SELECT doc_id, page_index, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, a, o))::INT AS turn, t AS text, c AS confidence, x0, y0, x1, y1 FROM e""")
def r6(t):
    """Tokens of three heights reach over lines; a third of them are no amounts."""
    own = words(t).withColumn("text", F.when(F.col("ord") % 5 == 0, F.concat((F.col("ord") * 7).cast("string"), F.lit(".50"))).otherwise(F.col("text")))
    some = F.when(F.col("ord") % 30 == 15, F.col("text")).otherwise(F.concat(F.lit("$ "), "text"))
    money = own.where("ord % 10 = 5").withColumns({"text": some, "x0": F.col("x0") - 8, "confidence": F.col("confidence") + 1, "y1": F.col("y0") + 12 + F.floor(F.col("ord") / 10) % 3 * 8, "graphic": F.lit(False)})
    return layout.join_currency(own, money)


@query("l13_edit_check", "SELECT conv_id AS request_id, turn AS ordinal, CASE WHEN turn % 5 = 1 THEN 'line break' WHEN turn % 5 = 2 THEN 'scale' WHEN turn % 5 = 3 THEN 'ordinals' WHEN turn % 5 = 4 THEN 'hash' END AS reason FROM conversations")
def l13(t):
    k = F.col("ordinal") % 5
    own = runs(t).select(
        F.col("doc_id").alias("request_id"), F.col("ordinal").cast("long").alias("ordinal"), F.when(k == 4, "x").otherwise(F.col("text_hash")).alias("text_hash"), F.col("text").alias("original_text"), F.when(k == 1, "a\nb").otherwise("ab").alias("replacement"),
        F.lit(0.0).alias("offset_x"), F.lit(1.0).alias("offset_y"), F.when(k == 2, 5.0).otherwise(1.0).alias("scale_x"), F.lit(1.0).alias("scale_y"), F.when(k == 3, F.array(F.lit(2), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2))).alias("ordinals"),
    )
    return layout.edit_problem(own).select("request_id", "ordinal", "reason")


@query("l14_page_plan_check", "SELECT l_orderkey AS request_id, l_linenumber AS pos, CASE WHEN l_returnflag <> 'A' AND l_linenumber > 5 THEN 'source' WHEN l_quantity > 45 THEN 'rotation' WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'blank size' WHEN l_quantity > 35 THEN 'images' END AS reason FROM lineitem")
def l14(t):
    q, blank = F.col("l_quantity"), F.col("l_returnflag") == "A"
    own = t("lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("pos"), F.when(blank, "blank").otherwise("source").alias("kind"), F.col("l_linenumber").alias("pdf_index"), F.lit(6).alias("n_files"), F.when(q > 45, 45).otherwise(90).alias("rotation"),
        F.when(q > 40, 3000).otherwise(600).alias("width"), F.lit(800).alias("height"), F.when(q > 35, 60).otherwise(3).alias("n_images"), F.lit(0).alias("n_boxes"),
    )
    return layout.plan_problem(own).select("request_id", "pos", "reason")


@query("u2_append_distinct", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'click,click,view' WHEN event_type = 'view' THEN 'click,click,view' ELSE 'click,click,' || event_type || ',view' END AS items FROM events")
def u2(t):
    base = F.array(F.lit("click"), F.lit("click"))
    return t("events").select("event_id", F.array_join(collections.append_distinct(base, F.array("event_type", F.lit("view"))), ",").alias("items"))


@query("u3_select_pages", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '1,2,3' WHEN p_size > 9 THEN '2' ELSE CASE WHEN p_size = 1 THEN '1,2' WHEN p_size = 3 THEN '2,3' ELSE '2' END END AS pages FROM part")
def u3(t):
    asked = F.when(F.col("p_size") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("p_size"), F.lit(2), F.lit(2)))
    return t("part").select("p_partkey", F.array_join(layout.select_pages(asked, F.lit(3)).cast("array<string>"), ",").alias("pages"))


@query("u4_distinct_origins", "SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS origins FROM pages")
def u4(t):
    bare = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    raw = F.array(bare, F.concat(bare, F.lit("/")), F.concat(bare, F.lit("/x")), F.upper(bare))
    return t("pages").select("page_id", F.array_join(F.array_distinct(F.filter(F.transform(raw, s.normalize_origin), lambda o: o != "")), ",").alias("origins"))


@query("c12_allowed_methods", """WITH e AS (SELECT o_orderkey % 100 AS k, row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey DESC) AS ord, CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'PUT' END AS m FROM orders),
f AS (SELECT k, m, min(ord) AS ord FROM e GROUP BY ALL)
SELECT k AS request_id, 'OPTIONS,' || string_agg(m, ',' ORDER BY ord) AS allowed, 405 AS status FROM f GROUP BY k UNION ALL
SELECT k + 1000, 'OPTIONS,' || string_agg(m, ',' ORDER BY ord), 405 FROM f WHERE k % 2 = 0 GROUP BY k UNION ALL SELECT DISTINCT k + 1000, 'OPTIONS', 404 FROM f WHERE k % 2 = 1""")
def c12(t):
    """Methods of each path, and of a record below it, which databases alone have."""
    k = (F.col("o_orderkey") % 100).cast("string")
    method = F.when(F.col("o_orderstatus") == "F", "GET").when(F.col("o_orderstatus") == "O", "POST").otherwise("PUT")
    ends = t("orders").select(F.row_number().over(Window.partitionBy((F.col("o_orderkey") % 100)).orderBy(F.desc("o_orderkey"))).alias("ord"), method.alias("method"), F.concat(F.lit("/r"), k).alias("path"), (F.col("o_orderkey") % 2 == 0).alias("database"))
    asked = t("orders").select((F.col("o_orderkey") % 100).alias("request_id"), F.lit("DELETE").alias("method"), F.concat(F.lit("/r"), k).alias("path")).distinct()
    below = asked.select(F.col("request_id") + 1000, F.lit("POST"), F.concat("path", F.lit("/x")))
    below = below.toDF("request_id", "method", "path").withColumn("method", F.lit("DELETE"))
    return collections.route_requests(asked.unionAll(below), ends).select("request_id", F.array_join("allowed", ",").alias("allowed"), "status")


@query("c13_drop_orphans", "SELECT o_orderpriority AS project_id, o_orderstatus AS name, string_agg(DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 'GET' ELSE 'POST' END, ',' ORDER BY CASE WHEN o_custkey % 2 = 0 THEN 'GET' ELSE 'POST' END) AS methods FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def c13(t):
    held = t("orders").select(F.col("o_orderpriority").alias("project_id"), F.col("o_orderstatus").alias("name")).distinct()
    ends = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("project_id"), F.col("o_orderstatus").alias("collection"), F.when(F.col("o_custkey") % 2 == 0, "GET").otherwise("POST").alias("method"))
    return collections.drop_orphan_collections(held, ends).select("project_id", "name", F.array_join("methods", ",").alias("methods"))


@query("c2_validate_project", """WITH e AS (SELECT o_orderpriority AS project_id, o_custkey % 5000 + o_orderkey % 2 * 10000 AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'TRACE' ELSE 'GET' END AS m, CASE WHEN o_orderkey % 11 = 0 THEN 'gone' ELSE 'c' || o_orderstatus END AS c FROM orders),
h AS (SELECT DISTINCT o_orderpriority AS project_id, unnest(['c' || o_orderstatus, left(o_orderpriority, 1) || o_orderstatus]) AS name FROM orders UNION ALL SELECT DISTINCT o_orderpriority, 'c' || o_orderstatus FROM orders WHERE o_orderpriority > '3')
SELECT project_id, name, 'unsafe name' AS reason FROM h WHERE NOT regexp_matches(name, '^[A-Za-z]') UNION ALL SELECT project_id, name, 'duplicate collection' FROM h GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT project_id, id::VARCHAR, 'duplicate endpoint' FROM e GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT project_id, c, 'missing collection' FROM e WHERE c = 'gone' UNION ALL SELECT project_id, id::VARCHAR, 'unknown method' FROM e WHERE m = 'TRACE'""")
def c2(t):
    """Projects with all five kinds of faults."""
    own, k = t("orders").withColumnRenamed("o_orderpriority", "project_id"), F.col("o_orderkey")
    name = F.concat(F.lit("c"), "o_orderstatus")
    held = own.select("project_id", F.explode(F.array(name, F.concat(F.substring("project_id", 1, 1), "o_orderstatus"))).alias("name")).distinct()
    held = held.unionAll(own.where("project_id > '3'").select("project_id", name.alias("name")).distinct())
    ends = own.select("project_id", (F.col("o_custkey") % 5000 + k % 2 * 10000).alias("id"), F.when(k % 7 == 0, "TRACE").otherwise("GET").alias("method"), F.lit("/x").alias("path"), F.when(k % 11 == 0, "gone").otherwise(name).alias("collection"))
    return collections.validate_project(held, ends)


@query("c9_assign_path", "SELECT event_id, '{\"a\":{\"b\":' || user_id || '},\"k\":' || (props::JSON->>'k') || '}' AS json FROM events")
def c9(t):
    return collections.assign_path(t("events").select("event_id", F.col("props").alias("json"), F.col("user_id").cast("string").alias("v")), "a.b", "v").select("event_id", "json")


@query("c10_loose_equal", "SELECT event_id, floor(value) = value AS same FROM events")
def c10(t):
    a, b = F.parse_json(F.col("value").cast("string")), F.parse_json(F.concat(F.lit('"'), F.floor("value").cast("string"), F.lit('"')))
    return t("events").select("event_id", collections.loose_equal(a, b).alias("same"))


@query("c11_request_source", "SELECT event_id, props::JSON->>'k' AS body_value, 'H' || user_id AS header_value, user_id || ' x' AS query_value FROM events")
def c11(t):
    user = F.col("user_id").cast("string")
    own = t("events").select("event_id", F.parse_json("props").alias("body"), F.create_map(F.lit("X-User"), F.concat(F.lit("H"), user)).alias("headers"), F.concat(F.lit("a=1&u="), user, F.lit("%20x")).alias("query"))
    return own.select("event_id", collections.request_source("body.k").alias("body_value"), collections.request_source("header.x-user").alias("header_value"), collections.request_source("query.u").alias("query_value"))


@query("m12_guided_update", "SELECT user_id, CASE WHEN user_id % 2 = 0 AND n > 0 THEN 'changed' ELSE 'kept' END AS state, 200 AS status FROM (SELECT user_id, count_if(event_type = 'click') AS n FROM events GROUP BY user_id)")
def m12(t):
    own = t("events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("id"), F.lit(False).alias("on"))).alias("items"))
    out = collections.guided_update(own, F.col("user_id") % 2 == 0, "items", lambda x: x["id"] == "click", lambda x: x.withField("on", F.lit(True)))
    return out.select("user_id", F.when(F.exists("items", lambda x: x["on"]), "changed").otherwise("kept").alias("state"), "status")


#: A user's events are a collection; each record holds the kinds and values of an hour's events. The request names a user's first and last kind, and an hour.
GUIDED = {
    "recordMatch": [{"source": "query.half", "recordPath": "half", "operator": "equals"}],
    "nestedUpdates": [{"arrayPath": "a.items", "source": "body.kinds", "matchPath": "kind", "operator": "in", "set": {"on": True}, "copy": {"by.who": "header.X-User"}}],
    "arrayUpdates": [{"arrayPath": "tags", "source": "body.kinds"}],
}
GUIDED_SQL = """q AS (SELECT user_id, min(event_type) AS k1, max(event_type) AS k2, min(event_id) % 2 AS half FROM events GROUP BY user_id),
r AS (SELECT user_id, event_id % 2 AS half, list(event_type ORDER BY event_id) AS items, max(event_type) AS tag FROM events GROUP BY ALL),
m AS (SELECT r.*, k1, k2, q.user_id % 7 <> 0 AND r.half = q.half AS hit, len(list_filter(items, lambda x: x IN (k1, k2))) AS n FROM r JOIN q USING (user_id)),
v AS (SELECT *, CASE WHEN user_id % 7 = 0 THEN 404 WHEN user_id % 5 = 0 AND sum(CASE WHEN hit THEN n ELSE 0 END) OVER w > 0 THEN 400 WHEN sum(CASE WHEN hit THEN n ELSE 0 END) OVER w = 0 THEN 404 ELSE 202 END AS status FROM m WINDOW w AS (PARTITION BY user_id))"""


def _guided(t):
    from kilnspark.operators import guided

    user, half = F.col("user_id").cast("string"), (F.col("event_id") % 2).cast("string")
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("kind")))
    records = t("events").groupBy(user.alias("collection"), half.alias("half")).agg(items.alias("i"), F.max("event_type").alias("tag"))
    doc = F.parse_json(F.to_json(F.struct("half", F.struct(F.col("i").alias("items")).alias("a"), F.array("tag").alias("tags"))))
    per = t("events").groupBy("user_id").agg(F.array(F.min("event_type"), F.max("event_type")).alias("kinds"), (F.min("event_id") % 2).cast("string").alias("half"))
    name = F.when(F.col("user_id") % 5 == 0, "other").otherwise("x-user")
    query = F.concat(F.lit("x=1&half="), F.when(F.col("user_id") % 7 == 0, "none").otherwise(F.col("half")))
    requests = per.select(user.alias("collection"), F.parse_json(F.to_json(F.struct("kinds"))).alias("body"), F.create_map(name, user).alias("headers"), query.alias("query"))
    return guided.apply_guided(records.select("collection", "half", doc.alias("doc")), requests, GUIDED, 202)


@query("m12_guided_responses", f"WITH {GUIDED_SQL} SELECT user_id::VARCHAR AS collection, any_value(status) AS status FROM v GROUP BY user_id")
def m12_responses(t):
    """A request without a match is 404, one that lacks what is to be copied 400."""
    return _guided(t)[1]


@query("m12_guided_records", f"""WITH {GUIDED_SQL} SELECT user_id::VARCHAR AS collection, half::VARCHAR AS half, '{{"a":{{"items":[' || list_reduce(list_transform(items, lambda x: CASE WHEN hit AND status = 202 AND x IN (k1, k2) THEN '{{"by":{{"who":"' || user_id || '"}},"kind":"' || x || '","on":true}}' ELSE '{{"kind":"' || x || '"}}' END), lambda x, y: x || ',' || y)
 || ']}},"half":"' || half || '","tags":["' || array_to_string(list_concat([tag], list_filter(CASE WHEN k1 = k2 THEN [k1] ELSE [k1, k2] END, lambda x: hit AND status = 202 AND x <> tag)), '","') || '"]}}' AS doc FROM v""")
def m12_records(t):
    """The matching records' items are changed and their tags grow, in collections whose request is taken."""
    out = _guided(t)[0]
    return out.select("collection", "half", F.to_json("doc").alias("doc"))
