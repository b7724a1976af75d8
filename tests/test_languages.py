"""The language of files by extension, first line and content; the held-out part of real sources is told right."""

import sysconfig
from pathlib import Path

import pyarrow
import pyspark
import pytest

from lodestone.functions import lexers
from lodestone.operators import languages

FILES = "blob_id string, path string, lang string, content string, is_binary boolean"


def rows_of(pairs):
    return [(f"b{i}", path, None, content, False) for i, (path, content) in enumerate(pairs)]


def test_extension_then_first_line_then_content(spark):
    code = [("a.c", "int main(void) { struct s *p = malloc(4); return p->x; }"), ("b.cpp", "namespace n { template <class T> std::vector<T> f(); }"), ("d.py", "def f(self): return None")]
    open_ = [
        ("x.h", "struct s *p = malloc(sizeof(int)); p->x"), ("dir.d/y.h", "namespace m { template <class U> class V; std::vector<U> v; }"), ("run", "#!/usr/bin/env -S python3 -u\nx"), ("go.d/run2", "#! /bin/bash -e\nx"),
        ("tool", "def g(self): return self"), ("none.xyz", "def f(self)"), ("empty.h", ""), ("UP.PY", ""), ("other.h", None),
    ]
    df = spark.createDataFrame(rows_of(code + open_) + [("bin", "z.h", None, None, True), ("b0", "copy.c", None, code[0][1], False)], FILES)
    got = {r.path: r.lang for r in languages.with_language(df, lexers.extension_table(spark)).where("blob_id <> 'b0'").collect()}
    assert got == {"b.cpp": "C++", "d.py": "Python", "x.h": "C", "dir.d/y.h": "C++", "run": "Python", "go.d/run2": "Shell", "tool": "Python", "none.xyz": None, "empty.h": None, "UP.PY": "Python", "other.h": None}


def test_scores_are_log_probabilities(spark):
    import math

    train = spark.createDataFrame([("A", "x x y"), ("A", "x"), ("B", "y z"), (None, "q")], "lang string, content string")
    model = languages.language_model(train, smoothing=1.0)
    files = spark.createDataFrame([(1, "x y q", None), (2, "", None), (3, "z", ["B", "C"]), (4, None, ["C"])], "key int, content string, candidates array<string>")
    got = {(r.key, r.lang): r.score for r in languages.scores(files, model, "key").collect()}
    p = lambda n, total: math.log((n + 1) / (total + 4))  # noqa: E731  three words are known
    want = {(1, "A"): math.log(2 / 3) + p(3, 4) + p(1, 4) + p(0, 4), (1, "B"): math.log(1 / 3) + p(0, 2) + p(1, 2) + p(0, 2), (2, "A"): math.log(2 / 3), (2, "B"): math.log(1 / 3), (3, "B"): math.log(1 / 3) + p(1, 2)}
    assert got == pytest.approx(want)
    assert {r.key: r.lang for r in languages.classified(files, model, "key").collect()} == {1: "A", 2: "A", 3: "B"}
    assert {r.token for r in languages.language_model(train, least=2)[0].collect()} == {"x"}


def test_equal_scores_go_to_the_first_name(spark):
    model = languages.language_model(spark.createDataFrame([("C++", "x"), ("C", "x")], "lang string, content string"))
    files = spark.createDataFrame([(1, "x", None)], "key int, content string, candidates array<string>")
    assert languages.classified(files, model, "key").first().lang == "C"


def test_held_out_sources_are_told_right(spark):
    """Headers of C and of C++ that share an extension, Python and scripts: a hash of the path says which are learned from."""
    stdlib, here = Path(sysconfig.get_paths()["stdlib"]), Path(pyspark.__file__).parent
    found = [(p, "C") for p in Path(sysconfig.get_paths()["include"]).rglob("*.h")] + [(p, "C++") for p in (Path(pyarrow.__file__).parent / "include").rglob("*.h")]
    found += [(p, "Python") for p in stdlib.glob("*.py")] + [(p, "Shell") for p in (here / "bin").iterdir() if p.is_file() and p.read_bytes()[:2] == b"#!"]
    rows = [(str(p), lang, text) for p, lang in found if (text := p.read_text(errors="replace")).strip()]
    files = spark.createDataFrame(rows, "key string, lang string, content string").repartition(4)
    told = {r.lang: (r.right, r.files) for r in languages.held_out_accuracy(files).collect()}
    assert set(told) == {"C", "C++", "Python", "Shell"} and all(n > 5 for _, n in told.values())
    assert sum(right for right, _ in told.values()) > 0.97 * sum(n for _, n in told.values())
    assert told["C"][0] > 0.9 * told["C"][1] and told["C++"][0] > 0.9 * told["C++"][1]
