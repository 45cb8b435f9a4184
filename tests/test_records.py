"""Folders of small files: whole texts, names left out, broken ones."""

import json

from sheafline.sources import item_json, records


def test_item_files_of_several_lines(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"quiz_title": "t", "questions": [{"question": "q", "options": ["a", "b"], "correct": 1}]}, indent=2), encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps([{"question": "x", "options": ["a"]}, 5], indent=1), encoding="utf-8")
    (tmp_path / "a_review.json").write_text("{}", encoding="utf-8")
    (tmp_path / "c.json").write_text("{\nbroken", encoding="utf-8")
    files = item_json.listed(item_json.read(spark, str(tmp_path)))
    assert [r.file for r in files.collect()] == ["a.json", "b.json", "c.json"]
    assert sorted((r.file, r.question, r.answers) for r in item_json.questions(files).where("question IS NOT NULL").collect()) == [("a.json", "x", []), ("b.json", "q", [1])]
    assert [(r.file, r.code) for r in item_json.invalid(files).collect()] == [("c.json", "invalid_json")]
    assert sorted((r.file, r.pos) for r in records.raw_items(files, "file", "doc").collect()) == [("a.json", 1), ("a.json", 2), ("b.json", 1)]


def test_run_states(spark, tmp_path):
    for run, text in (("r1", json.dumps({"run_id": "r1", "status": "paused", "uploaded": [1, 2], "next": 3, "source": "/x/y.json"}, indent=1)), ("r2", "{broken")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "state.json").write_text(text, encoding="utf-8")
    (row,) = records.run_states(spark, str(tmp_path)).select("run", records.safe_state(records.F.col("state")).alias("s")).collect()
    assert (row.run, row.s.status, row.s.uploaded, row.s.skipped, row.s.next, row.s.source) == ("r1", "paused", 2, 0, 3, "y.json")


def test_texts_are_written_in_place_and_listed_in_few_tasks(spark, tmp_path):
    """No folder is moved by a commit, no task lists one folder alone; odd names and empty texts stay."""
    n = 300
    rows = spark.createDataFrame([(f"k{i}" if i else "a/b:c", f"one\r\ntwo {i}" if i else None) for i in range(n)], "k string, t string")
    group = "texts written and read"
    spark.sparkContext.setJobGroup(group, group)
    path = f"file://{tmp_path}/texts"
    records.write_texts(rows, path, "k", "t")
    got = {r.name: r.value for r in records.whole_texts(spark, path, "part-*").select("value", records.F.col("_metadata.file_path").alias("name")).collect()}
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert len(got) == n and sorted(got.values()) == sorted(["\n", *(f"one\ntwo {i}\n" for i in range(1, n))])
    assert max(s.numTasks for s in stages if s) <= 64 and not [x for x in (tmp_path / "texts").iterdir() if x.name.startswith("_")]
    assert (tmp_path / "texts" / "k=a%2Fb%3Ac" / "part-00000.txt").read_bytes() == b"\n"
