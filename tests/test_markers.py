"""Marker files: lines are sorted once for all that is told of them."""

from sheafline.sources import markup

TEXT = "lost\n#SECTION: s\n#CONTEXT\nabout\n#END_CONTEXT\n#Q\nask\nmore\n#A\none\ntwo\n#A*\nthree\n#EXPLANATION\nwhy\n#END_Q\n#Q\nnext\n#A*\nx\n\n#A\n#A\ny\n#END_Q"


def test_lines_are_sorted_once(spark):
    files = spark.createDataFrame([("f", TEXT), ("g", "#Q\nonly\n#END_Q"), ("h", "nothing")], "unit string, value string")
    found = markup.marker_items(markup.lines_of(files, "unit"), "unit")
    rows = [(r.unit, r.question, r.section, r.context, r.options, r.answers, r.explanation) for r in found.where("type = 'question'").orderBy("unit", "item").collect()]
    assert rows == [
        ("f", "ask\nmore", "s", "about", ["one two", "three"], [2], "why"), ("f", "next", "s", "about", ["x", "y"], [1], ""), ("g", "only", None, None, [], [], ""),
    ]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not [w for w in windows if w.rstrip().rpartition("], [pos")[0].rpartition("[")[2].count("#") > 1]
