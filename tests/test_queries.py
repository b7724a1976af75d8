"""Every query with SQL against DuckDB at the smallest size."""

import os
import re

import duckdb
import pytest

from lodestone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["tfidf_words", "vocab_index", "idfreq", "token_split", "history_depth", "bag_graphlet", "bag_seq", "role_pairs", "id_tree_distance", "id_sequence", "mode_func", "cooc_trees", "bow_vw", "pmi_target", "shard_assign", "swivel_loss", "swivel_step", "language_by_content", "history_trees", "cooc", "repos2bow", "repos2coocc", "sql_bag_id", "sql_bag_seq", "sql_bag_graphlet", "splitter_features", "splitter_contexts", "doc_freq_last", "projector_top"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def cells(df):
    text = df[sorted(df.columns)].map(lambda x: re.sub(r"\.0$", "", "None" if x is None or x != x else str(x)))
    return sorted(map(tuple, text.values))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, duck, name):
    got, want = cells(QUERIES[name](spark, SF).toPandas()), cells(duck.execute(ORACLE_SQL[name]).df())
    assert len(got) > 1 and got == want


def test_sql_is_for_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_command_line_knows_its_commands():
    from lodestone.cli import COMMANDS, get_parser

    assert len(COMMANDS) >= 19
    args = get_parser().parse_args(["merge-df", "--inputs", "a", "b", "--output", "c"])
    assert args.handler is COMMANDS["merge-df"][0]
