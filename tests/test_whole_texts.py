"""Layout queries see whole turns, not their beginnings."""

import pytest

from kilnspark.plans import sequence_queries as q


@pytest.fixture()
def t(spark):
    text = " ".join(f"word{i}" for i in range(90))
    rows = spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn int, role string, text string")
    return lambda name: rows


def test_runs_and_words_hold_the_whole_turn(t):
    text = t("conversations").first().text
    assert q.runs(t).first().text == text
    assert [r.text for r in q.words(t).orderBy("ord").collect()] == text.split(" ")
    assert q.d2(t).count() == 90


def test_merged_runs_hold_the_whole_turn(t):
    n = sum(len(r.ordinals.split(",")) for r in q.w7(t).collect())
    assert n > 120  # 90 characters gave 40 pieces or so
