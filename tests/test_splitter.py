"""The trained splitter: its tags against all tags there are, and names held out."""

import itertools
import math
import re
import sysconfig
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import splitter


def test_tags_are_the_best_of_all(spark):
    words = ["read file", "file name", "name", "read name space", "a b", "spaces"]
    model = splitter.trained(spark.createDataFrame([(w,) for w in words], "token_split string"))
    counts = {(r.kind, r.context): (r.n, r.begins) for r in model[0].collect()}
    assert counts["around", ""] == counts["from", ""] == (sum(len(w.replace(" ", "")) - 1 for w in words), 5)
    assert counts["around", "eadfil"] == counts["from", "file$$"] == (1, 1) and counts["before", "^^read"] == (2, 2)
    names = ["readspace", "filenamespace", "x", "Ab_9", "namename"]

    def chance(plain, i):
        padded, j = "^" * 6 + plain + "$" * 6, i + 6
        odds = prior = model[1]["prior"]
        for kind, weight, most in splitter.KINDS:
            p = 0.5
            for w in range(most + 1):
                lo, hi = {"around": (j - w, j + w), "before": (j - w, j), "from": (j, j + w)}[kind]
                n, k = counts.get((kind, padded[lo:hi]), (0, 0))
                p = (k + splitter.LEAN * p) / (n + splitter.LEAN)
            odds += weight * (math.log(p / (1 - p)) - prior)
        return 1 / (1 + math.exp(-odds))

    def best(plain):
        def score(tags):
            return sum(math.log(chance(plain, i) if tags[i] else 1 - chance(plain, i)) + model[1]["gain"][tags[i - 1]][tags[i]] for i in range(1, len(plain)))

        tags = max(((1, *rest) for rest in itertools.product((0, 1), repeat=len(plain) - 1)), key=score)
        return "".join((" " if t and i else "") + c for i, (c, t) in enumerate(zip(plain, tags)))

    rows = spark.createDataFrame([(n,) for n in [*names, "readspace", "123", None]], "token string")
    got = {r.token: r.token_split for r in splitter.split_names(rows, model).collect()}
    assert got == {n: best(re.sub("[^a-z]", "", n.lower())) for n in names}


def test_names_held_out_are_split_right(spark):
    """Words of the standard library's names: those of half of them are learned, the others are split without their underscores."""
    found = set()
    for path in Path(sysconfig.get_paths()["stdlib"]).glob("*.py"):
        found |= set(re.findall(r"\b[a-z]+(?:_[a-z]+)+\b", path.read_text(errors="replace")))
    rows = spark.createDataFrame([(n.replace("_", ""), n.replace("_", " ")) for n in sorted(found)], "token string, token_split string").dropDuplicates(["token"])
    held = F.pmod(F.xxhash64("token"), F.lit(2)) == 0
    model = splitter.trained(rows.where(~held))
    quality = splitter.quality(rows.where(held), model).first()
    assert rows.where(held).count() > 1000
    assert quality.precision > 0.8 and quality.recall > 0.8, quality


def test_commands(spark, tmp_path):
    from lodestone import cli, models

    rows = [(a + b, f"{a} {b}") for a in ("get", "set", "read", "write", "open") for b in ("file", "name", "user", "line", "path")]
    spark.createDataFrame(rows, "token string, token_split string").write.csv(f"{tmp_path}/names", header=True)
    run = lambda *args: (lambda a: a.handler(spark, a))(cli.get_parser().parse_args([*args]))
    run("train-id-split", "--input", f"{tmp_path}/names", "--output", f"{tmp_path}/model", "--test-ratio", "0.3")
    assert spark.read.parquet(f"{tmp_path}/model/quality").first().recall > 0.5
    assert models.load(spark, f"{tmp_path}/model")[1]["name"] == "splitter"
    spark.createDataFrame([("openname",)], "token string").write.parquet(f"{tmp_path}/in")
    run("split-ids", "--input", f"{tmp_path}/in", "--model", f"{tmp_path}/model", "--output", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").first().token_split == "open name"


@pytest.mark.parametrize("text", ["", "1 2", None])
def test_names_without_letters_have_no_tags(spark, text):
    df = spark.createDataFrame([(text, "x")], "token_split string, plain string")
    assert splitter.tagged(df).count() == 0
