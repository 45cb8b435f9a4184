"""Questions from block ids on odd inputs."""

from pyspark.sql import functions as F

from sheafline.operators import questions as Q


def test_right_options_travel_once(spark):
    """A right option is one reference, marked; only right ids that are no options are asked for besides."""
    row = spark.range(1).select(F.array(F.lit(7), F.lit(8), F.lit(7), F.lit(None)).cast("array<long>").alias("o"), F.array(F.lit(7), F.lit(None)).cast("array<long>").alias("c"))
    got = row.select(F.explode(Q._tagged(1, F.col("o"), F.col("c"))).alias("r")).select("r.*").collect()
    assert [(r.role, r.pos, r.right, r.id) for r in got] == [(1, 0, True, "7"), (1, 1, False, "8"), (1, 2, True, "7"), (1, 3, False, None)]


def test_odd_ids(spark):
    blocks = spark.createDataFrame([(0, i, i, "" if i == 4 else f"text {i}") for i in range(1, 10)], "document long, block_id long, order long, text string")
    rows = [
        (1, [1], [2, 3, 5], [3, 99], []), (2, None, None, None, None), (3, [], [], [5], []), (4, [1], [5, 5, 98, None], [5, 98, None], [1]),
        (5, [97], [6, 7, 8], [], [97]), (6, [2, 3], [4, 6, 9], [9, 4], [9]),
    ]
    markup = spark.createDataFrame(rows, "question_id long, question_ids array<long>, option_ids array<long>, correct_ids array<long>, context_ids array<long>")
    got = {r.question_id: r for r in Q.build_from_markup(markup, blocks).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert (got[1].answers, got[1].flags) == ([2], ["missing_source_blocks: 99"])
    for i in (2, 3):
        assert (got[i].question, got[i].options, got[i].answers, got[i].correct, got[i].flags) == ("", [], [], [1], ["too_few_options", "answer_missing"])
    assert (got[4].question, got[4].answers, got[4].context) == ("text 3", [1, 2], "text 1")
    assert got[4].flags == ["missing_source_blocks: 98", "context_overlap_autofix", "too_few_options"]
    assert (got[5].question, got[5].flags) == ("", ["missing_source_blocks: 97", "answer_missing"])
    assert (got[6].question, got[6].options, got[6].answers, got[6].context, got[6].flags) == ("text 2\ntext 3", ["", "text 6", "text 9"], [1, 3], "text 9", [])
