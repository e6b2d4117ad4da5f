import re

import duckdb
import pytest

from kilnspark.llm import mixing

from .data import documents


def test_mix_equals_its_sql(spark):
    docs = documents(spark)
    pdf = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", pdf)
    want = con.execute(mixing.oracle([3, 1, 2], 1.5, 2)).df()
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    got = mixing.mix(docs).toPandas()
    key = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).apply(lambda r: [None if x is None else float(x) if not isinstance(x, str) else x for x in r], axis=1)))
    assert key(got) == key(want)
    assert (got["taken"] <= 2 * got["size"]).all()
    for _, part in got.fillna({"source": "none"}).groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) < 10 * mixing.BLOCK


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, None: 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df, [3, 1, 2], 1.5, 2).collect()}
    weights, want, total = {"a": 3, "b": 1, "c": 2, None: 3}, {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in want]
        rest = total - sum(want.values())
        over = [s for s in free if rest * weights[s] / sum(weights[f] for f in free) > 2 * sizes[s]]
        if not over:
            want |= {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
            break
        want |= {s: 2 * sizes[s] for s in over}
    assert got == pytest.approx(want)


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    rows = [(1, None, "en", None, 0, "", "", "", ""), (2, " ", "en", "a", 0, "", "", "", "")]
    assert {(r.doc_id, r.size, r.taken) for r in mixing.mix(documents(spark, rows)).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_mixed_documents_keep_their_columns(spark):
    docs = documents(spark)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    sizes = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in docs.collect()}
    assert all(sizes[r.doc_id] for r in got.where("doc_id <> 4").collect())


def test_mixed_is_planned_in_parts(spark):
    """The driver plans a query again after each of its shuffles."""
    out = mixing.mixed(documents(spark))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 4
