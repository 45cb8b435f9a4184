"""Selections in order, running values in parts and titles made different, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sheafline.operators import ordered, prefix, selection


def titles_by_hand(rows, most=300):
    seen, counts, out = set(), {}, {}
    for unit, pos, text in sorted(rows, key=lambda r: r[1]):
        key = text.strip().lower()
        n = counts[unit, key] = counts.get((unit, key), 0) + 1
        if (unit, key) in seen:
            suffix = f" (контекст {n})"
            text = text[: most - len(suffix)].rstrip(" ") + suffix
        seen.add((unit, text.strip().lower()))
        out[unit, pos] = text
    return out


def test_titles_made_different(spark):
    draw = random.Random(2)
    texts = ["a", "A ", "a (контекст 2)", "a (контекст 2) (контекст 1)", "a (контекст 3)", "b", "b (контекст 2)", "x" * 299, "a (контекст 2) (контекст 1) (контекст 1)"]
    rows = [(u, i, draw.choice(texts)) for u in ("p", "q") for i in range(60)] + [("r", i, t) for i, t in enumerate(["a", "a", "a (контекст 2)", "a (контекст 2) (контекст 1)", "a (контекст 2)"])]
    got = {(r.u, r.pos): r.title for r in selection.made_different(spark.createDataFrame(rows, "u string, pos long, text string"), "u", "pos", "text").collect()}
    assert got == titles_by_hand(rows)
    assert got["r", 2] == "a (контекст 2) (контекст 1)" and got["r", 3] == "a (контекст 2) (контекст 1) (контекст 1)"


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_running_values_in_parts(spark, size):
    draw = random.Random(4)
    rows = [(draw.choice(["a", None]), pos, draw.choice([None, draw.randint(1, 9)])) for pos in range(200)]
    df = spark.createDataFrame(rows, "k string, pos long, x int")
    for backward in (False, True):
        d = prefix.running(df, ["k"], "pos", sums={"total": F.col("x")}, lasts={"now": F.col("x")}, before={"was": F.col("x")}, size=size, backward=backward)
        got = {r.pos: (r.total, r.now, r.was) for r in d.collect()}
        total, now = {}, {}
        for k, pos, x in sorted(rows, key=lambda r: -r[1] if backward else r[1]):
            was = now.get(k)
            total[k] = total.get(k, 0) + (x or 0)
            now[k] = x if x is not None else was
            assert got[pos] == (total[k], now[k], was)


def test_thirds_and_limits_in_parts(spark):
    df = spark.createDataFrame([("a", i * 3) for i in range(50)] + [("b", i) for i in range(7)] + [(None, 1)], "u string, pos long")
    for size in (1, 10, 5000):
        got = {(r.u, r.pos): r.part for r in ordered.thirds(df, ["u"], "pos", 10, size=size).collect()}
        assert all(got["a", i * 3] == min(i // 10, 2) for i in range(50)) and [got["b", i] for i in range(7)] == [0, 0, 0, 1, 1, 1, 2] and got[None, 1] == 0
        rows = df.where("u = 'a'")
        assert sorted(r.pos for r in selection.limited(rows, "pos", 10, 3, size).collect()) == [12, 15, 18]
        assert [r.pos for r in selection.limited(rows, "pos", None, 0, size).collect()] == [0]
        assert selection.limited(rows, "pos", 1000, 5, size).count() == 0


def test_first_failures(spark):
    rows = [("a", 1, " X"), ("a", 2, "y"), ("a", 3, "x "), ("a", 4, "Y"), ("b", 1, "z")] + [("c", i, str(i)) for i in range(201)] + [("d", i, "same") for i in range(300)]
    got = {r.u: (r.rows, r.duplicate, r.original, r.code) for r in selection.list_failures(spark.createDataFrame(rows, "u string, pos long, text string"), "u", "pos", "text").collect()}
    assert got == {"a": (4, 3, 1, "duplicate_question"), "b": (1, None, None, None), "c": (201, None, None, "too_many_questions"), "d": (300, 1, 0, "duplicate_question")}
    df = spark.createDataFrame(rows[:4], "u string, pos long, text string")
    assert selection.until_first(df, "pos", F.col("text") == "x ").count() == 3 and selection.until_first(df, "pos", F.lit(False)).count() == 4
