"""Loops that are resumed: what is called, what is kept, what is set aside."""

import os

import pytest
from frames import rows
from pyspark.sql import functions as F

from graphloom import api
from graphloom.operators import backlog
from graphloom.operators.resumable import Stop, Stopped, answer_rows, set_aside


@pytest.fixture
def calls(tmp_path):
    """A folder in which every call leaves a file, and how often each row was called."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def made():
        found = {}
        for name in os.listdir(folder):
            row = name.split("@")[0]
            found[row] = found.get(row, 0) + 1
        return found

    return str(folder), made


def caller(folder, trouble=lambda key, n: None):
    """Answers with the length of the text; ``trouble(key, n)`` may raise on the n-th call of a row."""

    def call(row):
        n = sum(name.startswith(f"{row['id']}@") for name in os.listdir(folder)) + 1
        open(f"{folder}/{row['id']}@{n}", "x").close()
        trouble(row["id"], n)
        return {"n": len(row["text"])}

    return call


def test_a_run_that_stops_goes_on_and_calls_nothing_twice(spark, tmp_path, calls):
    folder, made = calls
    frame = spark.createDataFrame([(f"r{i}", "x" * i) for i in range(60)], "id string, text string")
    log = str(tmp_path / "log")

    def spent(key, n):
        if len(os.listdir(folder)) > 45:
            raise Stop("quota")

    how = {"batch_rows": 20, "at_once": 1, "pause": 0.0}
    with pytest.raises(Stopped, match="batch 3 of 3: .*quota"):
        answer_rows(frame, caller(folder, spent), "n int", log, **how)
    assert len(made()) == 46
    answers = answer_rows(frame, caller(folder), "n int", log, **how)
    assert rows(answers) == sorted((f"r{i}", i) for i in range(60))
    # The one call that was refused is made again, no other.
    assert sorted(made().values()) == [1] * 59 + [2]
    assert rows(answer_rows(frame, caller(folder, lambda *_: 1 / 0), "n int", log)) == rows(answers)


def test_rows_that_fail_are_tried_again_and_set_aside(spark, tmp_path, calls):
    folder, made = calls
    frame = spark.createDataFrame([(f"r{i}", "x" * i) for i in range(12)] + [(None, "x"), ("r3", "xxx")], "id string, text string")
    log = str(tmp_path / "log")

    def trouble(key, n):
        if key == "r5" and n < 3 or key == "r7":
            raise ValueError(f"{key} failed")

    answers = answer_rows(frame, caller(folder, trouble), "n int", log, attempts=3, pause=0.01)
    assert rows(answers) == sorted((f"r{i}", i) for i in range(12) if i != 7)
    assert made() == {f"r{i}": 3 if i in (5, 7) else 1 for i in range(12)}
    assert rows(set_aside(frame, "n int", log)) == [("r7", "ValueError('r7 failed')", 3)]
    again = answer_rows(frame, caller(folder), "n int", log)
    assert ("r7", 7) in rows(again) and set_aside(frame, "n int", log).count() == 0


def test_pauses_grow(monkeypatch):
    from graphloom.operators import resumable

    slept = []
    monkeypatch.setattr(resumable.time, "sleep", slept.append)
    import pandas as pd

    def fails(row):
        raise OSError("busy")

    out = list(resumable._calling(fails, "id", 6, 1.0, 5.0)(iter([pd.DataFrame({"id": ["a"]})])))
    assert slept == [1.0, 2.0, 4.0, 5.0, 5.0] and out[0]["state"].tolist() == ["failed"] and out[0]["attempts"].tolist() == [6]


def test_a_lost_batch_is_no_part_of_the_log(spark, tmp_path, calls):
    folder, made = calls
    frame = spark.createDataFrame([(f"r{i}", "x") for i in range(10)], "id string, text string")
    log = str(tmp_path / "log")

    class Lost(BaseException):
        pass

    def crash(key, n):
        raise Lost()

    with pytest.raises(Exception):
        answer_rows(frame, caller(folder, crash), "n int", log)
    assert answer_rows(frame, caller(folder), "n int", log).count() == 10


def test_the_loops_of_the_pipeline(spark, make, tmp_path):
    nodes = {f"f{i}": {"name": f"fun{i}", "file": "a.py" if i < 6 else "gone.py", "start_line": i + 1, "end_line": i + 1} for i in range(7)} | {
        "g": {"name": "bare", "file": ""}, "feature": {"label": "Feature", "name": "", "description": ""},
    }
    g = make(nodes, [(f"f{i}", "feature", "IMPLEMENTS") for i in range(6)])
    sources = spark.createDataFrame([("a.py", "\n".join(f"code {i}" for i in range(6)))], "file string, text string")

    def describe(code, name):
        if name == "fun2":
            raise TimeoutError(name)
        return ([] if name == "fun3" else [code, name]), name == "fun1"

    how = {"attempts": 2, "pause": 0.0}
    described = api.extract_features(g, sources, describe, log=str(tmp_path / "x"), **how).settle()
    found = {r["id"]: (r["atomic_features"], r["is_volatile"]) for r in described.labelled("Function").collect()}
    assert found["f1"] == (["code 1", "fun1"], True) and found["f3"] == (["no_features_detected"], False) and found["f6"] == (["unreadable_source"], False)
    assert found["f2"][0] is None and [r[0] for r in rows(backlog.unextracted(described), "id")] == ["f2"]
    embedded = api.embed_nodes(described, lambda text: [float(len(text)), 1.0], log=str(tmp_path / "e"), **how).settle()
    assert backlog.unembedded(embedded).count() == 0 and embedded.nodes.where("id = 'f1'").first()["embedding"] == [float(len("a.py | fun1 | code 1, fun1")), 1.0]
    named = api.summarize_features(embedded, sources, lambda snippets, label: (f"{label} of {len(snippets)}", snippets[0]), log=str(tmp_path / "s"), **how)
    assert named.nodes.where("id = 'feature'").first()["name"] == "Feature of 6"
    # A column answers as before.
    column = api.extract_features(g, sources, lambda code, name: F.struct(F.array(code).alias("features"), F.lit(True).alias("is_volatile")))
    assert column.nodes.where("id = 'f2'").first()["atomic_features"] == ["code 2"]
