"""Short histories are walked step by step, with the result of pointer doubling."""

from lodestone.sources import git


def test_steps_are_doubling(spark, monkeypatch):
    rows = [("r", f"c{i}", f"c{i - 1}" if i else None) for i in range(9)] + [("s", "c5", "gone"), ("s", "c6", "c5")]
    commits = spark.createDataFrame(rows, "repository_id string, commit string, parent string")
    heads = spark.createDataFrame([("r", "c8"), ("s", "c6"), ("s", "none")], "repository_id string, commit string")
    steps = sorted(map(tuple, git.first_parents(commits, heads, 5).collect()))
    monkeypatch.setattr(git, "WALKED", -1)
    assert steps == sorted(map(tuple, git.first_parents(commits, heads, 5).collect()))
    assert steps == [*(("r", f"c{i}", 8 - i) for i in range(3, 9)), ("s", "c5", 1), ("s", "c6", 0)]
