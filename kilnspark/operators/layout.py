"""Tables of positioned text: runs, recognised words, edits, page plans."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kilnspark.functions.scalars import currency_candidate, half_up, needs_space, numeric_like, run_id, text_identity
from kilnspark.operators.folds import ROWS, fold
from kilnspark.operators.ranked import running_last, running_sum

PAGE = ["doc_id", "page_index"]


def run_totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs and editable runs per key."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.count_if("editable").alias("n_editable"))


def prefix_offsets(df: DataFrame, key: str, order: list[str], size: str, gap: float) -> DataFrame:
    """df with start: the sizes before, 1 at least each, with a gap after each. The first column of order is a number."""
    return running_sum(df, [key], [F.col(c) for c in order], F.greatest(F.lit(1), F.col(size)) + gap, "start")


def locate_offset(items: DataFrame, points: DataFrame, key: str, size: str, gap: float) -> DataFrame:
    """points(key, offset) with the item(ord, start) of their key that covers the offset, clamped to the first and last.

    As-of by a union and a running last, so no pairs are made.
    """
    marks = items.select(key, F.col("start").cast("double").alias("_x"), F.lit(0).alias("_k"), F.col("ord").alias("_ord"))
    asked = points.select("*", F.greatest(F.lit(0.0), F.col("offset").cast("double")).alias("_x"), F.lit(1).alias("_k"))
    both = running_last(asked.unionByName(marks, allowMissingColumns=True), [key], [F.col("_x"), F.col("_k")], "_ord", "item")
    return both.where("_k = 1").select(*points.columns, "item")


def fill_style_gaps(ranges: DataFrame, texts: DataFrame, key: str, base: str) -> DataFrame:
    """(key, lo, hi, style) that cover each text(n_chars): ranges(lo, hi, style) clipped to the text and to the end before, gaps in the base style."""
    own = ranges.join(texts.select(key, "n_chars").hint("merge"), key).withColumn("hi", F.least("hi", "n_chars")).withColumn("lo", F.greatest(F.lit(0), F.col("lo")))
    w = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = own.withColumn("before", before).withColumn("lo", F.greatest("lo", "before")).where("lo < hi")
    gaps = cut.where("before < lo").select(key, F.col("before").alias("lo"), F.col("lo").alias("hi"), F.lit(base).alias("style"))
    ends = texts.join(cut.groupBy(key).agg(F.max("hi").alias("end")).hint("merge"), key, "left").select(key, F.coalesce("end", F.lit(0)).alias("lo"), F.col("n_chars").alias("hi"), F.lit(base).alias("style")).where("lo < hi")
    return cut.select(key, "lo", "hi", "style").unionByName(gaps).unionByName(ends)


#: Devanagari marks, joiners and combining accents.
MARK = re.compile("[\u093a-\u094d\u0962\u0963\u200c\u200d\u0300-\u036f]")
_BLANK = re.compile("[\\s\ufeff]")


class _Word:
    """A word in the making: direction and line are the head's, the gap is from the tail, along the head's direction."""

    def __init__(self, font: str | None, a: float | None, b: float, x: float, y: float, height: float):
        size = math.hypot(a or 1.0, b) or 1.0
        self.font, self.a, self.b, self.x, self.y, self.height, self.ux, self.uy = font, a, b, x, y, height, (a or 1.0) / size, b / size
        self.texts, self.ordinals, self.editable, self.blank, self.parted = [], [], True, False, False

    def add(self, ordinal: int, text: str, x: float, y: float, width: float | None, editable: bool | None) -> None:
        if not self.texts:
            self.first_width = width
        self.texts.append(text)
        self.ordinals.append(ordinal)
        self.tail_x, self.tail_y, self.tail_width, self.width = x, y, width, max(width or 0.0, 0.0)
        self.blank, self.parted = self.blank or bool(_BLANK.search(text)), False
        if self.editable is not False and editable is not True:
            self.editable = editable

    def joins(self, text: str, font: str | None, a: float, b: float, x: float, y: float, height: float) -> bool:
        if font != self.font or self.blank or abs(a - self.a) > 0.01 or abs(b - self.b) > 0.01 or _BLANK.search(text):
            return False
        high, flat = max(height, self.height), self.width <= 0.01
        if abs((x - self.x) * -self.uy + (y - self.y) * self.ux) > max(1.0, 0.35 * high) or (self.parted and not (flat and MARK.search(text))):
            return False
        return flat or abs((x - self.tail_x) * self.ux + (y - self.tail_y) * self.uy - self.width) <= max(4.0, 0.9 * high)

    def row(self) -> tuple:
        return "".join(self.texts), self.ordinals, self.editable, self.a, self.b, self.x, self.y, self.first_width, self.tail_x, self.tail_y, self.tail_width


def merge_runs(runs: DataFrame) -> DataFrame:
    """Neighbouring runs of one word joined, per page in order.

    runs(doc_id, page_index, ordinal, text, font_name, transform array<double>,
    width, height, editable, item): rows with item are what stands between
    runs; white space among them parts runs, unless a glyph without width is
    followed by a combining mark. A merged run reaches along its head's
    direction to the end of its last part, and is at least as wide as the head.
    Words are put together as the page streams by; no runs are collected after it.
    """
    own = runs.select(*PAGE, "ordinal", "text", "font_name", *[F.get("transform", F.lit(i)).alias(c) for i, c in ((0, "a"), (1, "b"), (4, "x"), (5, "y"))], F.col("width").cast("double"), F.col("height").cast("double"), "editable", "item")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    numbers = ["a", "b", "x", "y", "first_width", "tail_x", "tail_y", "tail_width"]
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in PAGE], "word int, text string", f"ordinals array<{kinds['ordinal']}>", "editable boolean", *[f"{c} double" for c in numbers]])
    form = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, n, word = None, 0, None
        for whole in batches:
            done = []
            for at in range(0, whole.num_rows, ROWS):
                for doc, index, ordinal, text, font, a, b, x, y, width, height, editable, item in zip(*(c.to_pylist() for c in whole.slice(at, ROWS).columns)):
                    if (doc, index) != page:
                        if word:
                            done.append((*page, n, *word.row()))
                        page, n, word = (doc, index), 0, None
                    text, height = text or "", height or 0.0
                    if item:
                        if word and _BLANK.search(text):
                            word.parted = True
                        continue
                    if word is None or not word.joins(text, font, a, b, x, y, height):
                        if word:
                            done.append((*page, n, *word.row()))
                            n += 1
                        word = _Word(font, a, b, x, y, height)
                    word.add(ordinal, text, x, y, width, editable)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), form)], schema=form)
        if word:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*page, n, *word.row()), form)], schema=form)

    out = own.repartition(*PAGE).sortWithinPartitions(*PAGE, "ordinal").mapInArrow(run, schema)
    a, b = F.when(F.col("a") == 0, 1.0).otherwise(F.col("a")), F.col("b")
    along = lambda x, y: (F.col(x) * a + F.col(y) * b) / F.hypot(a, b)
    width = F.greatest(F.col("first_width"), along("tail_x", "tail_y") + F.greatest(F.lit(0.0), F.col("tail_width")) - along("x", "y"))
    return out.select(*PAGE, "word", "text", "ordinals", F.round(width, 6).alias("width"), "editable")


def words_of(blocks: DataFrame) -> DataFrame:
    """Rows of the words in the tree blocks(doc_id, page_index, blocks), in reading order."""
    b = blocks.select(*PAGE, F.posexplode("blocks").alias("b", "x")).select(*PAGE, "b", F.posexplode("x.paragraphs").alias("p", "y"))
    line = b.select(*PAGE, "b", "p", F.posexplode("y.lines").alias("l", "z"))
    return line.select(*PAGE, "b", "p", "l", F.posexplode("z.words").alias("w", "v")).select(*PAGE, "b", "p", "l", "w", "v.text", "v.confidence", *[F.col(f"v.bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def _word_step(state: dict | None, row: Any) -> tuple[dict, tuple]:
    joins = False
    if state and not row.graphic and not state["graphic"]:
        shared = min(row.y1, state["y1"]) - max(row.y0, state["y0"])
        gap = row.x0 - state["x1"]
        joins = shared > 0 and 0 <= gap <= max(10.0, 1.8 * (row.y1 - row.y0))
    group = state["group"] if joins else (state["group"] + 1 if state else 0)
    now = {"graphic": row.graphic, "group": group, "x1": row.x1, "y0": row.y0, "y1": row.y1}
    if joins:
        now |= {"x1": max(row.x1, state["x1"]), "y0": min(row.y0, state["y0"]), "y1": max(row.y1, state["y1"])}
    return now, (group,)


def join_words(words: DataFrame, order: list[str]) -> DataFrame:
    """Words(text, confidence, x0, y0, x1, y1, graphic) of a page joined to phrases; graphic ones stay alone.

    A word joins the phrase before it on its line over a gap of at most 10 or
    1.8 times its own height. Blank words and boxes without an area are left out.
    """
    real = words.withColumn("text", F.trim("text")).where("text <> '' and x1 > x0 and y1 > y0")
    grouped = fold(real, PAGE, order, _word_step, None, "phrase int", ["graphic", "x0", "x1", "y0", "y1"])
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    out = grouped.groupBy(*PAGE, "phrase").agg(parts.alias("r"), F.min("confidence").alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    text = F.aggregate("r.text", F.lit(""), lambda a, t: F.concat(a, F.when((a != "") & needs_space(a, t), " ").otherwise(""), t))
    return out.select(*PAGE, "phrase", text.alias("text"), "confidence", "x0", "y0", "x1", "y1")


def reading_order(words: DataFrame) -> DataFrame:
    """words with turn: their place on the page from the top, then from the left; equal boxes by ord."""
    return words.withColumn("turn", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "ord")))


#: Height of the bins of a page's index of boxes.
BIN = 64


class _Amounts:
    """The numeric words of a page, found by the bins of y that their boxes meet, while currency tokens change them."""

    def __init__(self):
        self.words, self.bins = [], {}

    def put(self, at: int) -> None:
        _, _, _, y0, _, y1, *_ = self.words[at]
        for k in range(math.floor(y0 / BIN), math.floor(y1 / BIN) + 1):
            self.bins.setdefault(k, set()).add(at)

    def add(self, word: tuple) -> None:
        self.words.append(word)
        self.put(len(self.words) - 1)

    def take(self, token: tuple) -> None:
        """The token's text goes to the word that fits best, the first of equals; without one the token is a word."""
        text, sure, x0, y0, x1, y1, *_ = token
        best = None
        for at in sorted(set().union(*(self.bins.get(k, ()) for k in range(math.floor(y0 / BIN), math.floor(y1 / BIN) + 1)))):
            _, _, a0, b0, a1, b1, *_ = self.words[at]
            shared = max(0.0, min(b1, y1) - max(b0, y0)) / max(1.0, min(b1 - b0, y1 - y0))
            gap = max(0.0, max(a0, x0) - min(a1, x1))
            if shared >= 0.35 and gap <= max(12.0, (y1 - y0) * 2.5):
                score = shared * 3 - gap / max(1.0, y1 - y0)
                if best is None or score > best[0]:
                    best = (score, at)
        if best is None:
            return self.add(token)
        _, was, a0, b0, a1, b1, *rest = self.words[best[1]]
        self.words[best[1]] = (text, max(was or 0.0, sure or 0.0), min(a0, x0), min(b0, y0), max(a1, x1), max(b1, y1), *rest)
        self.put(best[1])


def join_currency(words: DataFrame, currency: DataFrame) -> DataFrame:
    """Words of a page with currency tokens joined in, by turn: from the top, then from the left.

    Both sides are (doc_id, page_index, ord, text, confidence, x0, y0, x1, y1,
    graphic). Tokens that are graphic or no amount behind a sign are left out.
    The others act one after the other: a token gives its text to the numeric
    word with the best 3 * overlap - gap / height, among those that overlap by
    0.35 and are within max(12, 2.5 heights) of it, heights being the token's;
    the word's box grows by the token's and may be hit again. A token without a
    word becomes one. A page's numeric words and tokens meet in one task;
    other words pass by.
    """
    box = ["text", "confidence", "x0", "y0", "x1", "y1"]
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields if f.name in PAGE}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in PAGE], "text string", *[f"{c} double" for c in box[1:]], "added int", "ord long"])
    numeric = numeric_like(F.col("text")) & ~F.coalesce("graphic", F.lit(False))
    own = [F.col("text"), *[F.col(c).cast("double").alias(c) for c in box[1:]]]
    marks = currency.withColumn("text", F.regexp_replace("text", "\\s+", "")).where(currency_candidate(F.col("text")) & ~F.coalesce("graphic", F.lit(False)))
    parts = [df.select(*PAGE, *own, F.lit(k).alias("added"), F.col("ord").cast("long").alias("ord")) for k, df in enumerate((words.where(numeric), marks))]
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != page:
                    done += [(*page, *w) for w in held.words] if held else []
                    page, held = row[:2], _Amounts()
                (held.take if row[8] else held.add)(row[2:])
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in done], kind)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (*page, *w))) for w in held.words], kind)

    joined = parts[0].unionByName(parts[1]).repartition(*PAGE).sortWithinPartitions(*PAGE, "added", "ord").mapInArrow(run, schema)
    every = joined.unionByName(words.where(~numeric).select(*PAGE, *own, F.lit(0).alias("added"), F.col("ord").cast("long").alias("ord")))
    turn = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "added", "ord"))
    return every.select(*PAGE, turn.alias("turn"), *box)


def resolve_pages(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """plan(request_id, pos, kind, pdf_index, page_index) with its source page; a source page that isn't there is an error."""
    there = pages.select("request_id", "pdf_index", "page_index", F.col("page").alias("page"))
    both = plan.join(there, ["request_id", "pdf_index", "page_index"], "left")
    return both.withColumn("error", F.when((F.col("kind") == "source") & F.col("page").isNull(), "missing page"))


def attach_images(plan: DataFrame, files: DataFrame) -> DataFrame:
    """plan(request_id, field) with the uploaded file(request_id, field, name, mime), or why there is none."""
    both = plan.join(files.select("request_id", "field", "name", "mime"), ["request_id", "field"], "left")
    return both.withColumn("reason", F.when(F.col("name").isNull(), "missing file").when(~F.startswith("mime", F.lit("image/")), "not an image"))


def resolve_edits(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """edits(edit_id, doc_id, page_index, run_id, ordinal, original_text, text_hash) with the run they mean.

    In order: the run's id; its ordinal and hash; its ordinal and text; the
    only run of that text; of several the nearest by ordinal. White space does
    not count in texts. Edits and runs of one text are laid side by side in
    order: the nearest run is the last before or the first after, so no pairs
    are made.
    """
    key = text_identity(F.col("text"))
    own = runs.select(*PAGE, F.col("run_id").alias("r_id"), F.col("ordinal").cast("long").alias("r_ord"), F.col("text_hash").alias("r_hash"), key.alias("key"))
    asked = edits.withColumn("key", text_identity(F.col("original_text")))
    ids = own.select(*PAGE, F.col("r_id").alias("run_id"), "r_ord")
    by_id = asked.join(ids, [*PAGE, "run_id"]).select("edit_id", F.struct(F.lit(0).alias("tier"), F.lit(0).cast("long").alias("d"), "r_ord", F.col("run_id").alias("r_id")).alias("b"))
    marks = own.groupBy(*PAGE, "key", "r_ord").agg(F.min(F.struct("r_id", "r_hash")).alias("r"), F.collect_set("r_hash").alias("hashes"), F.count("*").alias("same"))
    marks = marks.select(*PAGE, "key", F.col("r_ord").alias("x"), F.struct("r_ord", F.col("r.r_id").alias("r_id")).alias("run"), "hashes", "same")
    want = asked.select(*PAGE, "key", F.col("ordinal").cast("long").alias("x"), "edit_id", "text_hash")
    side = Window.partitionBy(*PAGE, "key").orderBy("x")
    laid = want.unionByName(marks, allowMissingColumns=True)
    laid = laid.withColumn("before", F.last("run", True).over(side.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("run", True).over(side.rangeBetween(0, Window.unboundedFollowing)))
    laid = laid.withColumn("n", F.sum("same").over(Window.partitionBy(*PAGE, "key"))).withColumn("here", F.max("hashes").over(Window.partitionBy(*PAGE, "key", "x")))
    d = lambda r: F.abs(F.col(r)["r_ord"] - F.col("x"))
    near = F.when(F.col("after").isNull() | (d("before") <= d("after")), F.col("before")).otherwise(F.col("after"))
    found = laid.where("edit_id is not null").withColumn("run", near).where("run is not null").withColumn("d", d("run"))
    tier = F.when((F.col("d") == 0) & F.coalesce(F.array_contains("here", F.col("text_hash")), F.lit(False)), 1).when(F.col("d") == 0, 2).when(F.col("n") == 1, 3).otherwise(4)
    by_text = found.select("edit_id", F.struct(tier.alias("tier"), "d", F.col("run.r_ord").alias("r_ord"), F.col("run.r_id").alias("r_id")).alias("b"))
    best = by_id.unionByName(by_text).groupBy("edit_id").agg(F.min("b").alias("b"))
    return edits.join(best.hint("merge"), "edit_id", "left").select(*edits.columns, F.col("b.tier").alias("tier"), F.col("b.r_ord").alias("run_ordinal"), F.col("b.r_id").alias("resolved_run"))


#: Characters by which a wanted text meets the places where it may start.
LEAD = 8


def resolve_groups(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """groups(group_id, doc_id, page_index, wanted, ordinal) with the neighbouring runs whose joined text is wanted.

    Runs of a page are laid end to end. A span is a start whose next LEAD
    characters are those of the wanted text (all of them, if it is shorter) and
    an end whose distance is the wanted length, so both are found by equality.
    Of several the one that starts nearest to the given ordinal counts.
    """
    w = Window.partitionBy(*PAGE).orderBy("ordinal")
    keyed = runs.select(*PAGE, "ordinal", text_identity(F.col("text")).alias("t")).withColumn("n", F.length("t"))
    laid = keyed.withColumn("hi", F.sum("n").over(w)).withColumn("lo", F.col("hi") - F.col("n"))
    ahead = F.array_join(F.collect_list(F.substring("t", 1, LEAD)).over(w.rowsBetween(0, LEAD - 1)), "")  # LEAD runs with text
    lead = laid.where("n > 0").withColumn("ahead", F.substring(ahead, 1, LEAD)).select(*PAGE, F.col("ordinal").alias("first"), "lo", "ahead", F.explode(F.sequence(F.lit(1), F.length("ahead"))).alias("size"))
    lead = lead.select(*PAGE, "first", "lo", "size", F.substring("ahead", F.lit(1), F.col("size")).alias("head"))
    asked = groups.withColumn("key", text_identity(F.col("wanted"))).withColumn("n", F.length("key")).withColumn("size", F.least(F.lit(LEAD), F.col("n"))).withColumn("head", F.substring("key", 1, LEAD))
    starts = lead.join(asked.hint("merge"), [*PAGE, "size", "head"])
    spans = starts.withColumn("hi", F.col("lo") + F.col("n")).join(laid.select(*PAGE, F.col("ordinal").alias("last"), "hi").hint("merge"), [*PAGE, "hi"]).where("last >= first")
    parts = spans.select("group_id", *PAGE, "key", "first", "last", "ordinal", F.explode(F.sequence("first", "last")).alias("o"))
    texts = parts.join(keyed.select(*PAGE, F.col("ordinal").alias("o"), "t").hint("merge"), [*PAGE, "o"])
    joined = texts.groupBy("group_id", "key", "first", "last", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "").alias("text")).where("text = key")
    best = joined.groupBy("group_id").agg(F.min(F.struct(F.abs(F.col("first") - F.col("ordinal")).alias("d"), (F.col("last") - F.col("first")).alias("n"), "first", "last")).alias("b"))
    return groups.join(best.hint("merge"), "group_id", "left").select("group_id", F.col("b.first").alias("first"), F.col("b.last").alias("last"))


def overlay_pages(native: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows of scanned pages replace all native rows of their page."""
    return native.join(scanned.select(*PAGE).distinct(), PAGE, "left_anti").unionByName(scanned)


def hide_covered(runs: DataFrame, images: DataFrame) -> DataFrame:
    """Runs(end_order) over which no page-like image(paint_order, width, height, page_width, page_height) of 300 pixels a side is painted later."""
    alike = F.abs(F.col("width") / F.col("height") - F.col("page_width") / F.col("page_height")) <= 0.04
    top = images.where((F.col("width") >= 300) & (F.col("height") >= 300) & alike).groupBy(*PAGE).agg(F.max("paint_order").alias("_top"))
    return runs.join(top, PAGE, "left").where("_top is null or _top <= end_order").drop("_top")


class _Page:
    """A page's text, put together once, the places where operators meet, and a cursor that only moves on."""

    def __init__(self):
        self.parts, self.edges, self.size, self.text, self.at = [], {0}, 0, None, 0

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)
        self.edges.add(self.size)

    def place(self, want: str) -> int | None:
        if self.text is None:
            self.text = "".join(self.parts)
        spot = self.text.find(want, self.at) if want else -1
        if spot < 0 or spot not in self.edges or spot + len(want) not in self.edges:
            return None
        self.at = spot + len(want)
        return spot


def _align_step(page: _Page, row: Any) -> tuple[_Page, tuple]:
    if row.item_:
        return page, (page.place(row.key_),)
    page.add(row.key_)
    return page, (None,)


def align_items(items: DataFrame, operators: DataFrame) -> DataFrame:
    """items(doc_id, page_index, ord, text) with the place of their text in the page's operators(ordinal, text), from a cursor that only moves on.

    A place counts only if whole operators spell the item; others are skipped.
    A page's operators and then its items stream through one task, which holds
    that page's text once.
    """
    own = operators.select(*PAGE, F.lit(False).alias("item_"), F.col("ordinal").cast("long").alias("ord_"), text_identity(F.coalesce("text", F.lit(""))).alias("key_"))
    asked = items.select("*", F.lit(True).alias("item_"), F.col("ord").cast("long").alias("ord_"), text_identity(F.coalesce("text", F.lit(""))).alias("key_"))
    done = fold(asked.unionByName(own, allowMissingColumns=True), PAGE, ["item_", "ord_"], _align_step, _Page, "place int", ["item_", "key_"])
    return done.where("item_").drop("item_", "ord_", "key_")


def edit_problem(edits: DataFrame, per_request: int = 500) -> DataFrame:
    """edits with reason: the first rule that a text edit breaks, null if none."""
    many = F.count("*").over(Window.partitionBy("request_id"))
    steps = F.zip_with(F.slice("ordinals", 1, F.size("ordinals") - 1), F.slice("ordinals", 2, F.size("ordinals")), lambda a, b: b > a)
    reason = (
        F.when(many > per_request, "too many edits").when(~F.col("text_hash").rlike("^[0-9a-f]{64}$"), "hash")
        .when((F.length("original_text") > 10_000) | (F.length("replacement") > 10_000), "length").when(F.col("replacement").rlike("[\\r\\n]"), "line break")
        .when((F.abs("offset_x") > 100_000) | (F.abs("offset_y") > 100_000), "offset").when(~F.col("scale_x").between(0.25, 4) | ~F.col("scale_y").between(0.25, 4), "scale")
        .when((F.size("ordinals") > 1) & ~F.forall(steps, lambda x: x), "ordinals").when(F.exists("ordinals", lambda o: (o < 0) | (o > 5000)), "ordinals")
    )
    return edits.withColumn("reason", reason)


def plan_problem(plan: DataFrame) -> DataFrame:
    """Page plan rows with reason: too many pages, unknown source, rotation, blank size, images or boxes."""
    n = F.count("*").over(Window.partitionBy("request_id"))
    reason = (
        F.when(n > 2000, "too many pages").when((F.col("kind") == "source") & ~F.col("pdf_index").between(0, F.col("n_files") - 1), "source")
        .when(~F.col("rotation").isin(0, 90, 180, 270), "rotation").when((F.col("kind") == "blank") & ((F.col("width") > 2000) | (F.col("height") > 2000)), "blank size")
        .when(F.col("n_images") > 50, "images").when(F.col("n_boxes") > 100, "boxes")
    )
    return plan.withColumn("reason", reason)


def verify_edits(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """edits(edit_id, doc_id, page_index, ordinal, run_id, text_hash, source_hash) with reason: stale source, changed text, wrong id, edited twice or not editable."""
    own = runs.select(*PAGE, "ordinal", F.col("text").alias("_t"), F.col("source_hash").alias("_s"), F.col("editable").alias("_e"))
    both = edits.join(own, [*PAGE, "ordinal"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "run_id")))
    made = run_id(F.col("page_index"), F.col("ordinal"), F.col("_t"), F.col("_s"))
    reason = F.when(F.col("_s").isNull() | (F.col("_s") != F.col("source_hash")), "stale source").when(F.sha2("_t", 256) != F.col("text_hash"), "changed text").when(made != F.col("run_id"), "wrong id").when(F.col("_n") > 1, "edited twice").when(~F.col("_e"), "not editable")
    return both.withColumn("reason", reason).drop("_t", "_s", "_e", "_n")


def apply_edits(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """runs with the replacements of the edits that resolve to them; nothing else changes."""
    found = resolve_edits(edits, runs).where("resolved_run is not null").groupBy(*PAGE, F.col("run_ordinal").alias("ordinal")).agg(F.min_by("replacement", "edit_id").alias("_new"))
    return runs.join(found, [*PAGE, "ordinal"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def build_runs(words: DataFrame, unit: float) -> DataFrame:
    """Words(x0, y0, y1, graphic) as runs: size from the box, editable unless graphic, with a reason."""
    return words.withColumns({"font_size": F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) * unit), "editable": ~F.col("graphic"), "reason": F.when(F.col("graphic"), "looks like a graphic").otherwise("")})


def merge_visual_duplicates(runs: DataFrame) -> DataFrame:
    """Runs(mode, text, geometry, ordinal, editable, reason) that look the same become one row."""
    key = F.transform("geometry", lambda g: half_up(g * 1000) / 1000)
    grouped = runs.withColumn("key", text_identity(F.col("text"))).withColumn("place", key).groupBy(*PAGE, "mode", "key", "place")
    reason = F.max_by("reason", F.when(~F.col("editable") & (F.col("reason") != ""), F.col("ordinal")))
    return grouped.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("ordinal")).alias("ordinals"), F.bool_and("editable").alias("editable"), F.coalesce(reason, F.lit("")).alias("reason")).drop("place")


def pages_needing_ocr(runs: DataFrame, mode: str) -> DataFrame:
    """Pages of runs(hidden, editable): all for ocr; for auto those hidden or without an editable run; else those all hidden."""
    pages = runs.groupBy(*PAGE).agg(F.bool_and("hidden").alias("hidden"), F.bool_or(F.col("editable") & ~F.col("hidden")).alias("editable"))
    return pages.where({"ocr": F.lit(True), "auto": F.col("hidden") | ~F.col("editable")}.get(mode, F.col("hidden"))).select(*PAGE)


def select_pages(requested: Column, n: Column) -> Column:
    """Asked pages within 1..n, distinct and ascending; none asked means all."""
    fine = F.array_sort(F.array_distinct(F.filter(requested, lambda p: (p >= 1) & (p <= n))))
    return F.when(F.size(F.coalesce(requested, F.array().cast("array<int>"))) == 0, F.sequence(F.lit(1), n)).otherwise(fine)


def concat_documents(frames: list[DataFrame]) -> DataFrame:
    """Documents one after the other, with source_ord."""
    out = None
    for i, df in enumerate(frames):
        own = df.withColumn("source_ord", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
