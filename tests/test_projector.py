"""What the projector shows, and frequencies of tokens that are named twice."""

import pytest

from lodestone.operators import frequencies, matrices


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame([(f"t{i}", [float(i)]) for i in range(6)], "token string, embedding array<double>")


@pytest.fixture(scope="module")
def freq(spark):
    return spark.createDataFrame([("t1", 5), ("t2", 5), ("t3", 1), ("zz", 9)], "token string, freq long")


def test_few_tokens_are_all_shown(embeddings, freq):
    got = {r.token: r.freq for r in matrices.projected(embeddings, freq, 6).collect()}
    assert got == {"t0": 0, "t1": 5, "t2": 5, "t3": 1, "t4": 0, "t5": 0}
    assert matrices.projected(embeddings, most=6).count() == 6


def test_of_many_the_most_frequent(embeddings, freq):
    assert [r.token for r in matrices.projected(embeddings, freq, 2).collect()] == ["t2", "t1"]
    assert [r.token for r in matrices.projected(embeddings, freq, 5).collect()] == ["t2", "t1", "t3"]


def test_without_frequencies_the_seed_decides(embeddings):
    one, again, other = ([r.token for r in matrices.projected(e, most=3, seed=s).collect()] for e, s in ((embeddings, 1), (embeddings.repartition(4), 1), (embeddings, 2)))
    assert one == again and len(set(one)) == 3 and one != other


def test_files_of_the_projector(embeddings, freq, tmp_path, spark):
    matrices.write_projector(matrices.projected(embeddings, freq, 2), str(tmp_path))
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/meta").collect()) == ["t1\t5", "t2\t5"]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/data").collect()) == ["1.0", "2.0"]


def test_the_last_of_a_token_counts(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 2, 7), ("b", 1, 2), (None, 5, 3), ("a", 9, 4)], "token string, freq long, at int").repartition(3)
    assert {r.token: r.freq for r in frequencies.constructed(rows, "at").collect()} == {"a": 2, "b": 1}
