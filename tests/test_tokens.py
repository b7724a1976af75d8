import pytest
from pyspark.sql import functions as F

from lodestone.functions import tokens
from lodestone.functions.porter2 import stem


def split(spark, words, **options):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string")
    return [r.s for r in df.select("i", tokens.split_identifier(F.col("t"), **options).alias("s")).orderBy("i").collect()]


def test_attach_upper(spark):
    got = split(spark, ["HTMLResponse", "fooBar_baz2", "  x ", "", "ABC"], single_shot=True, least=1)
    assert got == [["html", "response"], ["foo", "bar", "baz"], ["x"], [], ["abc"]]


def test_loose_upper(spark):
    assert split(spark, ["HTMLResponse", "Response"], attach_upper=False, single_shot=True, least=1) == [["htmlr", "esponse"], ["response"]]


def test_short_words_join_their_neighbours(spark):
    assert split(spark, ["set_for", "isFoo", "fooIs", "a_b"]) == [["set", "for"], ["is", "foo", "isfoo"], ["foo", "foois"], ["a", "b"]]


def test_long_token_is_cut(spark):
    assert split(spark, ["a" * 30], most=20) == [["a" * 20]]


def test_reconstruct(spark):
    words = ["HTMLPage_2x", "fooBar", "__init__", "A", ""]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r.t for r in df.select("t", tokens.reconstruct(tokens.styled_parts(F.col("t"))).alias("r")).collect()] == words


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("hoping", "hope"), ("generously", "generous"), ("national", "nation"), ("relational", "relat"), ("happily", "happili"), ("sky", "sky"), ("by", "by")])
def test_stem(word, want):
    assert stem(word) == want


# Words that other implementations give for these identifiers.
PROCESSED = {
    "ONLYCAPS": ["onlycap"],
    "FRAPScase": ["frap", "case"],
    "_something_SILLY_": ["someth", "silli"],
    "wdSize": ["wd", "size", "wdsize"],
    "SmallIdFooo": ["small", "smallid", "fooo", "idfooo"],
    "never_use_Such__varsableNames": ["never", "use", "such", "varsabl", "name"],
}


def test_split_then_stem(spark):
    df = spark.createDataFrame([(w,) for w in [*PROCESSED, None, ""]], "t string")
    rows = df.select("t", tokens.processed(F.col("t"), above=4, attach_upper=False, most=100).alias("words")).collect()
    assert {r.t: r.words for r in rows} == PROCESSED | {None: None, "": []}
    with pytest.raises(ValueError):
        tokens.processed(F.col("t"), above=0)


def test_bags_hold_stems(spark):
    from lodestone.plans import flows

    schema = "document string, node_id long, parent_id long, internal_type string, token string, roles array<string>"
    nodes = spark.createDataFrame([("d", 1, None, "T", "runningTests", ["IDENTIFIER"])], schema)
    assert {r.token for r in flows.bags_of(nodes, ["id"]).collect()} == {"i.run", "i.tests"}
