"""Tokens by language: what patterns get wrong, and that any text is read to its end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import lexers
from lodestone.functions.syntax import LANGUAGES


def names(lang, text):
    return [text[a:b] for k, a, b in lexers.lexed(text, LANGUAGES[lang]) if k == "name"]


@pytest.mark.parametrize(
    "lang, text, want",
    [
        ("Python", 'f"{total:>{width}} {name!r} {{no}} {f(x)["k"]:d}" + y', ["total", "name", "f", "x", "y"]),
        ("Python", "rb'\\' + no' + F'''{a}\n' {b}''' # no", ["a", "b"]),
        ("Python", "'open\nx = 1", ["x"]),
        ("Python", "@cache\ndef größe(x): return x.y if x else 0x1F", ["cache", "größe", "x", "x", "y", "x"]),
        ("Ruby", 'puts "a #{b + "c #{d}"} no" if e?', ["puts", "b", "d", "e?"]),
        ("Ruby", "x = <<~EOS + y\n  no #{no}\n  EOS\nz", ["x", "y", "z"]),
        ("Ruby", "a = %w[no (no) [no]] ; b = :no ; c = a / b / d; e =~ /no\\/no/i\n=begin\nno\n=end\nf", ["a", "b", "c", "a", "b", "d", "e", "f"]),
        ("Ruby", "puts /no no/ ; q %(no (no) no) + %q{n{o}}", ["puts", "q"]),
        ("Shell", "FOO=1; echo \"$bar ${baz} no\" 'no $no' # no\nrun() { grep no; }\ncat <<EOF\nno $no\nEOF\necho $last", ["FOO", "bar", "baz", "run", "last"]),
        ("C", "#include <stdio.h>\n#define NO \\\n no\nint main(void) { char c = '\"'; /* no /* no */ return f(L\"no\"); }", ["main", "c", "f"]),
        ("C++", 'auto s = R"x(no )" no)x"; T t = u8"no" + 1\'000;', ["s", "T", "t"]),
        ("Java", 'String s = """\n no "no" \n"""; @Override int x = 12e3; // no', ["String", "s", "Override", "x"]),
        ("Scala", 's"no $a and ${b.c("no")} $$no" + """no \\""" + d /* no /* no */ no */ + \'c\'', ["a", "b", "c", "d"]),
        ("Scala", "val `two words` = x", ["two words", "x"]),
        ("Go", "s := `no\\` + x /* no */ + 'n'", ["s", "x"]),
        ("JavaScript", "let s = `no ${a + `no ${b}` + {c: 1}} no`, r = /no[/]no/g.test(d), e = f / g / h; return /no/", ["s", "a", "b", "c", "r", "test", "d", "e", "f", "g", "h"]),
        ("TypeScript", "interface P { readonly name: string } const $x = (y as P)!", ["P", "name", "$x", "y", "P"]),
        ("Rust", "fn f<'a>(x: &'a str) -> char { let r#type = r#\"no \" no\"#; /* no /* no */ no */ b'n'; '\\u{1F600}' }", ["f", "x", "str", "char", "type"]),
        ("C#", 'var s = $"no {a:n2} {{no}}" + @"no "" \\" + b;\n  #region no\nint c', ["s", "a", "b", "c"]),
        ("Kotlin", 'val s = "no $a.no ${b.c}" /* no /* no */ */', ["s", "a", "b", "c"]),
        ("Swift", 'let s = #"no " no"# + "no"; /* no /* */ no */ x', ["s", "x"]),
        ("PHP", "<?php $a = \"no $b {$c->d} no\"; # no\n// no\n$e = 'no $no';", ["a", "b", "c", "d", "e"]),
        ("Lua", "--[==[ no ]] no ]==] a = [[no\nno]] -- no\nb = 'no'", ["a", "b"]),
        ("Haskell", "f x' = g 'n' {- no {- no -} no -} -- no\n  |> h", ["f", "x'", "g", "h"]),
        ("OCaml", "let f x' = (* no (* no *) no *) g 'n' \"no\"", ["f", "x'", "g"]),
        ("R", "my.var <- function(x) 'no' # no", ["my.var", "x"]),
        ("SQL", "SELECT a FROM t WHERE b = 'no ''no' -- no\n", ["a", "t", "b"]),
        ("Objective-C", "#import <no.h>\n@interface Foo : NSObject @end", ["Foo", "NSObject"]),
    ],
)
def test_names(lang, text, want):
    assert names(lang, text) == want


def test_kinds_and_offsets(spark):
    text = "def größe(x): # ü\n    return 1.5e3 + f'{x}'"
    df = spark.createDataFrame([(text, "Python"), (text, "Klingon"), (None, "Python"), ("", "Go"), (text, None)], "t string, l string")
    rows = [r.k for r in df.select(lexers.tokens_in(F.col("t"), F.col("l")).alias("k")).collect()]
    assert [(t.kind, text[t.begin : t.end]) for t in rows[0]] == [
        ("keyword", "def"), ("name", "größe"), ("name", "x"), ("comment", "# ü"), ("keyword", "return"), ("number", "1.5e3"), ("string", "f'{"), ("name", "x"), ("string", "}'"),
    ]
    assert rows[1:] == [None, None, [], None]


@pytest.mark.parametrize("lang", sorted(LANGUAGES))
def test_any_text_is_read_to_its_end(lang):
    rng = np.random.default_rng(len(lang))
    marks = ["'", '"', "`", "{", "}", "${", "#{", "\\", "\n", "/", "*", "/*", "*/", "//", "#", "--", "--[[", "]]", "(*", "*)", "{-", "-}", '"""', "'''", "<<A", "\nA\n", "r#", "R\"(", ")\"", "f", "%w[", "]", "(", ")", "x", "1", " ", "$", "@", ":", "!", "é"]
    for _ in range(300):
        text = "".join(rng.choice(marks, rng.integers(0, 40)))
        last = 0
        for kind, begin, end in lexers.lexed(text, LANGUAGES[lang]):
            assert last <= begin <= end <= len(text) and kind in {"name", "word", "keyword", "number", "string", "comment", "regex", "preprocessor", "lifetime"}
            last = end


def test_long_and_deep_texts():
    assert names("JavaScript", "`${" * 2000 + "x" + "}`" * 2000) == ["x"]
    assert names("Rust", "/*" * 5000 + "*/" * 5000 + "x") == ["x"]
    assert len(names("Java", "int a = b; " * 50_000)) == 100_000


def test_extensions_name_languages():
    assert {x for langs in lexers.EXTENSIONS.values() for x in langs.split(", ")} - {"Markdown", "MATLAB"} == set(LANGUAGES)
