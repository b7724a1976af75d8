"""Models converted one by one: results, failures and what is there already."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.plans import conversion as C


@pytest.fixture
def models(spark, tmp_path):
    bags = spark.createDataFrame([("i.a", "d", 1.0), ("i.a", "d", 2.0), ("l.b", "d", 4.0), ("i.a", "e", 8.0)], "token string, document string, value double")
    for i, name in enumerate(("one", "two", "three")):
        bags.withColumn("value", F.col("value") * (i + 1)).repartition(3).write.parquet(f"{tmp_path}/{name}")
    return tmp_path, {name: f"{tmp_path}/{name}" for name in ("one", "two", "three")}


def rows(path):
    return [tuple(r.values()) for r in pq.read_table(path).to_pylist()]


def test_a_broken_model_is_a_row_and_the_others_are_made(spark, models):
    root, inputs = models
    part = sorted((root / "two").glob("part-*.parquet"))[-1]
    part.write_bytes(b"no parquet")
    (root / "two" / f".{part.name}.crc").unlink()
    out = f"{root}/out"
    got = {r.name: r for r in C.converted(spark, inputs, out, C.MergedBags()).collect()}
    assert {n: r.status for n, r in got.items()} == {"one": C.MADE, "two": C.FAILED, "three": C.MADE}
    assert got["two"].error.startswith("ArrowInvalid") and got["one"].rows == 3
    assert rows(f"{out}/one.parquet") == [("i.a", "d", 3.0), ("l.b", "d", 4.0), ("i.a", "e", 8.0)]
    assert rows(f"{out}/three.parquet") == [("i.a", "d", 9.0), ("l.b", "d", 12.0), ("i.a", "e", 24.0)]
    assert {p.name for p in (root / "out").iterdir()} == {"one.parquet", "three.parquet"}
    again = {r.name: r.status for r in C.converted(spark, inputs, out, C.MergedBags()).collect()}
    assert again == {"one": C.SKIPPED, "two": C.FAILED, "three": C.SKIPPED}


def test_features_and_missing_models(spark, models):
    root, inputs = models
    (root / "hollow").mkdir()
    got = {r.name: (r.status, r.rows) for r in C.converted(spark, {"one": inputs["one"], "gone": f"{root}/gone", "hollow": f"{root}/hollow"}, f"{root}/out", C.MergedBags(["i."])).collect()}
    assert got == {"one": (C.MADE, 2), "gone": (C.FAILED, None), "hollow": (C.FAILED, None)}
    assert C.converted(spark, {}, f"{root}/none", C.MergedBags()).count() == 0


def test_other_folds_and_their_failures(spark, models):
    class Sizes(C.Conversion):
        """Counts batches' rows; fails on a token."""

        def start(self):
            return 0

        def add(self, state, batch):
            if "l.b" in batch.column("token").to_pylist() and batch.num_rows > 100:
                raise ValueError("too many")
            return state + batch.num_rows

        def merge(self, a, b):
            return a + b

        def finish(self, state):
            if state > 4:
                raise ValueError("the result is too large")
            return pa.table({"n": [state]})

    root, inputs = models
    spark.createDataFrame([("i.a", "d", 1.0)] * 5, "token string, document string, value double").write.parquet(f"{root}/large")
    got = {r.name: (r.status, r.error) for r in C.converted(spark, {"one": inputs["one"], "large": f"{root}/large"}, f"{root}/out", Sizes()).collect()}
    assert got == {"one": (C.MADE, None), "large": (C.FAILED, "ValueError: the result is too large")}
    assert rows(f"{root}/out/one.parquet") == [(4,)]


def test_command(spark, models):
    from lodestone import cli

    root, inputs = models
    args = cli.get_parser().parse_args(["merge-bow", "--per-file", "--features", "i", "--inputs", *inputs.values(), "--output", f"{root}/out"])
    args.handler(spark, args)
    assert {r.name: r.status for r in spark.read.json(f"{root}/out/_status").collect()} == dict.fromkeys(inputs, C.MADE)
    assert len(rows(f"{root}/out/two.parquet")) == 2
