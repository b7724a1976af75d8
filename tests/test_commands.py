"""Commands end to end on a folder of repositories, and names in source code."""

import pytest
from pyspark.sql import functions as F

from lodestone import models
from lodestone.cli import main
from lodestone.functions import lexers
from lodestone.plans import flows

FILES = {
    "one/a.py": "def countWords(textLines):\n    total = 0  # someComment\n    for textLine in textLines:\n        total = total + len(textLine)\n    return total\n",
    "one/b.py": "class WordCounter:\n    def add(self, textLine):\n        self.total = self.total + len(textLine)\n",
    "two/c.py": "def readLines(fileName):\n    return [textLine for textLine in open(fileName)]\n",
    "two/notes.md": "some notes about countWords\n",
    "two/raw.bin": "\0\1",
}


@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_vocabulary_and_levels_are_saved_and_used_again(spark, repos, tmp_path):
    at = lambda name: str(tmp_path / name)
    features = ["--features", "id", "children", "--quant", at("quant"), "--children-partitions", "3", "--id-weight", "2"]
    main(["repos2df", "--input", repos, "--output", at("df"), "--min-docfreq", "1", *features])
    words, facts = models.load(spark, at("df"), "docfreq")
    tokens = {r.token: r.freq for r in words.collect()}
    assert facts["docs"] == 3 and tokens["i.text"] == 3 and any(t.startswith("c.") for t in tokens)
    levels, _ = models.load(spark, at("quant"), "quant")
    assert {len(r.levels) for r in levels.collect()} == {4}
    main(["repos2bow", "--input", repos, "--output", at("bow"), "--docfreq-in", at("df"), *features])
    rows, meta = models.load(spark, at("bow") + "/bow", "bow")
    models.check_depends(meta, facts)
    assert rows.count() == 3 and rows.select(F.explode("tokens")).distinct().count() <= len(tokens)
    main(["merge-df", "--inputs", at("df"), at("df"), "--output", at("merged")])
    merged, facts = models.load(spark, at("merged"), "docfreq")
    assert facts["docs"] == 6 and {r.token: r.freq for r in merged.collect()} == {t: 2 * n for t, n in tokens.items()}
    with pytest.raises(ValueError):
        flows.saved_vocabulary(spark, None)
    with pytest.raises(ValueError):
        flows.saved_levels(spark, at("nothing"))


def test_names_and_pairs(spark, repos, tmp_path):
    at = lambda name: str(tmp_path / name)
    main(["repos2ids", "--input", repos, "--output", at("ids"), "--split", "--idfreq"])
    ids = {r.token: (int(r.num_files), int(r.num_occ), r.token_split) for r in spark.read.csv(at("ids"), header=True).collect()}
    assert ids["textLine"] == (3, 6, "text line") and ids["countWords"] == (1, 1, "count words")
    assert "someComment" not in ids and "total" not in ids and "def" not in ids
    main(["repos2roleids", "--input", repos, "--output", at("roles"), "--split"])
    assert {"text", "line"} <= {r.token for r in spark.read.csv(at("roles"), header=True).collect()}
    main(["repos2coocc", "--input", repos, "--output", at("cooc")])
    assert models.load(spark, at("cooc"), "cooccurrences")[0].where("weight > 0").count() > 0


def test_names_by_language(spark):
    rows = [
        ("Python", "from foo import FooBar; print('foobar')", ["foo", "FooBar"]),
        ("Python", "x = 1e5 + 0x1F  # not y\n'''a\nb''' + z", ["x", "z"]),
        ("Go", "func Run(a int) { s := `raw b`; /* c\n d */ return \"e\\\"f\" } // g", ["Run", "a", "int", "s"]),
        ("Java", "public class A$b { String c = \"d'\"; char e = '\"'; }", ["A$b", "String", "c", "e"]),
        ("Markdown", "method_base", None),
        ("Batchfile", "echo method_base", None),
        (None, "abc", None),
        ("C", "", []),
    ]
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(rows)], "i int, lang string, t string")
    got = [r.n for r in df.select("i", lexers.names_in(F.col("t"), F.col("lang")).alias("n")).orderBy("i").collect()]
    assert got == [want for *_, want in rows]


def test_options_and_least_frequency(spark):
    assert flows.options_of("children") == {"partitions": 20} and flows.options_of("id")["stem_above"] == 6
    schema = "document string, node_id long, parent_id long, internal_type string, token string, roles array<string>"
    nodes = spark.createDataFrame([("d", 1, None, "T", "alpha beta", ["IDENTIFIER"]), ("e", 1, None, "T", "alpha", ["IDENTIFIER"])], schema)
    assert {r.token for r in flows.bags_of(nodes, ["id"], least=2).collect()} == {"i.alpha"}
    assert {r.value for r in flows.bags_of(nodes, ["id"], {"id": 3.0}).collect()} == {3.0}
    assert flows.bags_of(nodes, ["id"], options={"id": {"least_length": 5}}).count() == 3
    with pytest.raises(ValueError):
        flows.bags_of(nodes, ["id"], least=0)
    with pytest.raises(ValueError):
        flows.bags_of(nodes, ["nothing"])
