import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions.columns import comment_date, date_between, message_content, nearest, tree
from folio.functions.keys import Instruction, checked_instructions, join_key, merge_instructions, warn_if_unusual_name, with_prefix


def test_keys():
    assert join_key("a", "", None, "b") == "a/b"
    assert with_prefix("k", None) == "k" and with_prefix("k", "p/") == "p/k"
    with pytest.warns(UserWarning):
        assert not warn_if_unusual_name("plain")
    assert warn_if_unusual_name("name.2022-01-01,2022-02-01.note")


def test_instructions_merge_by_channel_in_order():
    merged = merge_instructions([{"channel": "b", "columns": ["x", "y"]}, {"channel": "a"}, {"channel": "b", "columns": ["z", "x"]}, {"channel": "a", "columns": ["q"]}])
    assert merged == [Instruction("a"), Instruction("b", ("x", "y", "z"))]
    assert merge_instructions([]) == []
    assert checked_instructions(None) is None
    for odd in ("tick", {"channel": "tick"}, 3):
        with pytest.raises(TypeError):
            checked_instructions(odd)
    with pytest.raises(TypeError):
        merge_instructions([{"columns": ["x"]}])


@given(st.lists(st.tuples(st.sampled_from("abc"), st.none() | st.lists(st.sampled_from("xyz"), max_size=3)), max_size=6))
def test_instructions_lose_no_column(asked):
    merged = {i.channel: i.columns for i in merge_instructions([{"channel": c, "columns": cols} for c, cols in asked])}
    assert list(merged) == sorted({c for c, _ in asked})
    for channel, cols in asked:
        assert merged[channel] is None if cols is None else merged[channel] is None or set(cols) <= set(merged[channel])


def test_dates(spark):
    rows = ["2022-01-05", "2022-01-05T10:00", "2022", "2022-03", "20220401", "no date", "", None, "2022-13-01"]
    df = spark.createDataFrame([(x,) for x in rows], "c string")
    days = [str(r[0]) if r[0] else None for r in df.select(comment_date(F.col("c"))).collect()]
    assert days == ["2022-01-05", "2022-01-05", "2022-01-01", "2022-03-01", "2022-04-01", None, None, None, None]
    assert [r[0] for r in df.select(date_between(F.col("c"), "2022-01-05", "2022-04")).collect()] == [True, True, False, True, False, False, False, False, False]
    assert [r[0] for r in df.select(date_between(F.col("c"))).collect()] == [True] * 5 + [False] * 4


def test_message_content(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{}",), ("0",), ('""',), ("null",), ("{bad",), (None,)], "b string")
    assert [r[0] for r in df.select(message_content(F.col("b")).isNotNull()).collect()] == [True, True, True, True, False, False, False]


def test_scores(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1.0), ([5.0, 5.0], None)], "v array<double>, x double")
    assert [r[0] for r in df.select(nearest(F.col("v"), [[5, 5], [0, 0], [0, 0]])).collect()] == [1, 0]
    assert [r[0] for r in df.select(tree({"column": "x", "below": 2, "yes": 1, "no": 0})).collect()] == [1.0, 0.0]


def test_logs_of_readers_can_be_dropped():
    import logging

    from folio.functions.logs import quiet_readers

    heard = []

    class Ear(logging.Handler):
        def emit(self, record):
            heard.append(record.getMessage())

    ear = quiet_readers(Ear())
    for name, level in (("folio.sources.catalog", logging.INFO), ("folio.sources.catalog", logging.WARNING), ("folio.plans.builder", logging.INFO)):
        ear.handle(logging.LogRecord(name, level, "", 0, f"{name} {level}", None, None))
    assert heard == ["folio.sources.catalog 30", "folio.plans.builder 20"]
