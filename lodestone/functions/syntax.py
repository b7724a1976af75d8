"""What the lexer has to know of each language, as tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)\w*"
#: After these a slash begins a pattern and divides nothing.
BEFORE_PATTERN = frozenset("([{,;=:!&|?+-*%^~<>")
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


@dataclass(frozen=True)
class Quote:
    """Text between what ``open`` matches and ``close``, where {0} stands for the last group of ``open``.

    ``code`` begins code that a brace ends, ``names`` a name that is written without one; ``lines``: may go on over lines; ``pairs``: opening
    marks within it, such as that it was opened with, have to be closed as well; ``spec``: a colon in its code begins a format.
    """

    open: str
    close: str = ""
    escape: bool = True
    lines: bool = False
    code: str = ""
    names: str = ""
    skip: str = ""
    pairs: bool = False
    spec: bool = False

    def inner(self, opened: re.Match) -> re.Pattern:
        """What ends or interrupts the text."""
        mark = next((g for g in reversed(opened.groups()) if g is not None), "") if opened.re.groups else ""
        if self.pairs:
            end = PAIRS.get(mark, mark)
            more = f"|(?P<more>{re.escape(mark)})" if mark in PAIRS else ""
        else:
            end, more = self.close.replace("{0}", re.escape(mark)) or re.escape(opened[0]), ""
        parts = [r"(?P<skip>\\.)"] if self.escape else []
        parts += [f"(?P<skipped>{self.skip})"] if self.skip else []
        parts.append(f"(?P<end>{re.escape(end) if self.pairs else end})")
        parts += [f"(?P<code>{self.code})"] if self.code else []
        parts += [f"(?P<names>{self.names})"] if self.names else []
        parts += [] if self.lines else [r"(?P<line>\n)"]
        return _compiled("|".join(parts) + more)


_known: dict[str, re.Pattern] = {}


def _compiled(pattern: str) -> re.Pattern:
    if pattern not in _known:
        if len(_known) > 1000:  # quotes with marks of their own, one for each text
            _known.clear()
        _known[pattern] = re.compile(pattern, re.DOTALL)
    return _known[pattern]


def plain(mark: str, **how) -> Quote:
    return Quote(re.escape(mark), **how)


@dataclass(frozen=True)
class Syntax:
    keywords: frozenset[str]
    line: str = "//"
    #: What opens and closes a block comment.
    block: tuple[str, str] | None = (r"/\*", r"\*/")
    nested: bool = False
    quotes: tuple[Quote, ...] = (plain('"'), plain("'"))
    #: (kind, pattern) of what stands before words and marks.
    extra: tuple[tuple[str, str], ...] = ()
    word: str = r"[^\W\d][\w$]*|\$[\w$]+"
    #: What a word is that is no keyword.
    kind: str = "name"
    patterns: bool = False
    heredocs: bool = False
    folded: bool = field(default=False)

    @cached_property
    def code(self) -> re.Pattern:
        parts = [f"(?P<extra{i}>{p})" for i, (_, p) in enumerate(self.extra)]
        parts += [r"(?P<blank>[^\S\n]+)", r"(?P<newline>\n)"]
        parts += [f"(?P<comment>(?:{self.line})[^\\n]*)"] if self.line else []
        parts += [f"(?P<block>{self.block[0]})"] if self.block else []
        parts += [r"(?P<heredoc><<[~-]?(?:(?P<hq>['\"])(?P<h1>\w+)(?P=hq)|(?P<h2>[A-Za-z_]\w*)))"] if self.heredocs else []
        # groups within a quote's opening are renumbered by the whole: it is matched again alone
        parts += [f"(?P<quote{i}>{_ungrouped(q.open)})" for i, q in enumerate(self.quotes)]
        parts += [f"(?P<number>{NUMBER})", f"(?P<word>{self.word})"]
        parts += [r"(?P<pattern>/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*)"] if self.patterns else []
        return re.compile("|".join(parts) + "|(?P<mark>.)", re.DOTALL | re.MULTILINE)

    @cached_property
    def openings(self) -> list[re.Pattern]:
        return [re.compile(q.open, re.DOTALL) for q in self.quotes]


def _ungrouped(pattern: str) -> str:
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


CHARACTER = Quote(r"'(?=\\?.[^'\n]*')")
RUBY_CODE = r"#\{"
#: The keywords, comments and quotes of languages.
C = words("break case char const continue default do double else enum extern float for goto if inline int long register return short signed sizeof static struct switch typedef union unsigned void volatile while")
JAVA = words("abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while")
SCRIPT = words("async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while with yield")
RAW_C = Quote(r'(?:u8|[uUL])?R"([^\()\\\s]{0,16})\(', r'\){0}"', escape=False, lines=True)
DIRECTIVE = ("preprocessor", r"^[^\S\n]*#(?:\\\n|[^\n])*")
C_QUOTES = (Quote(r'(?:u8|[uUL])?"', '"'), Quote(r"(?:u8|[uUL])?'", "'"))
CPP = C | words("alignas alignof asm auto bool catch class constexpr decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept nullptr operator private protected public static_assert static_cast template this throw true try typeid typename using virtual")
TEMPLATE = plain("`", lines=True, code=r"\$\{")
DOLLAR = {"code": r"\$\{", "names": r"\$(?=[A-Za-z_])"}
LANGUAGES: dict[str, Syntax] = {
    "Python": Syntax(
        words("False None True and as assert async await break class continue def del elif else except exec finally for from global if import in is lambda nonlocal not or pass print raise return try while with yield"),
        line="#",
        block=None,
        quotes=(
            Quote(r"(?i:f|fr|rf|t|tr|rt)(\"\"\"|''')", "{0}", lines=True, code=r"\{", skip=r"\{\{|\}\}", spec=True),
            Quote(r"(?i:f|fr|rf|t|tr|rt)([\"'])", "{0}", code=r"\{", skip=r"\{\{|\}\}", spec=True),
            Quote(r"(?i:r|b|u|br|rb)?(\"\"\"|''')", "{0}", lines=True),
            Quote(r"(?i:r|b|u|br|rb)?([\"'])", "{0}"),
        ),
        word=r"[^\W\d]\w*",
    ),
    "Ruby": Syntax(
        words("BEGIN END alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield"),
        line="#",
        block=None,
        extra=(("comment", r"^=begin\b[\s\S]*?^=end[^\n]*"), ("string", r"(?<![:\w]):[A-Za-z_]\w*[?!]?(?!:)")),
        quotes=(
            plain('"', lines=True, code=RUBY_CODE),
            plain("'", lines=True),
            plain("`", lines=True, code=RUBY_CODE),
            Quote(r"%[QWIxr]?([\(\[{<])", pairs=True, lines=True, code=RUBY_CODE),
            Quote(r"%[qwis]([\(\[{<])", pairs=True, lines=True),
            Quote(r"%[QWIxr]([|!/])", pairs=True, lines=True, code=RUBY_CODE),
            Quote(r"%[qwis]([|!/])", pairs=True, lines=True),
        ),
        word=r"[^\W\d]\w*[?!]?(?!=)|[^\W\d]\w*",
        patterns=True,
        heredocs=True,
    ),
    "Shell": Syntax(
        words("case do done elif else esac fi for function if in select then until while"),
        line=r"(?:(?<=\s)|(?<=;)|^)#",
        block=None,
        extra=(("mark", r"\\."), ("name", r"(?<=\$)[A-Za-z_]\w*|(?<=\$\{)[A-Za-z_]\w*|[A-Za-z_]\w*(?=\+?=)|[A-Za-z_]\w*(?=[^\S\n]*\(\))")),
        quotes=(plain('"', lines=True, **DOLLAR), Quote(r"\$'", "'", lines=True), plain("'", lines=True, escape=False), plain("`", lines=True)),
        word=r"[^\W\d][\w-]*",
        kind="word",
        heredocs=True,
    ),
    "C": Syntax(C, extra=(DIRECTIVE,), quotes=C_QUOTES),
    "C++": Syntax(CPP, extra=(DIRECTIVE,), quotes=(RAW_C, *C_QUOTES)),
    "Objective-C": Syntax(C | words("id nil self super YES NO BOOL SEL IMP instancetype"), extra=(DIRECTIVE, ("keyword", r"@(?:interface|implementation|end|property|protocol|class|selector|synthesize|dynamic|try|catch|finally|throw|import|autoreleasepool)\b")), quotes=C_QUOTES),
    "Java": Syntax(JAVA, quotes=(Quote('"""', lines=True), *(plain(q) for q in "\"'"))),
    "Scala": Syntax(
        words("abstract case catch class def do else extends false final finally for forSome if implicit import lazy match new null object override package private protected return sealed super this throw trait try true type val var while with yield"),
        nested=True,
        quotes=(
            Quote(r'[A-Za-z]\w*(?=""")"""', r'"""(?!")', lines=True, escape=False, skip=r"\$\$", **DOLLAR),
            Quote('"""', r'"""(?!")', lines=True, escape=False),
            Quote(r'[A-Za-z]\w*(?=")"', '"', skip=r"\$\$", **DOLLAR),
            plain('"'),
            CHARACTER,
        ),
        extra=(("name", r"(?<=`)[^`\n]+(?=`)"),),
    ),
    "Go": Syntax(words("break case chan const continue default defer else fallthrough false for func go goto if import interface map nil package range return select struct switch true type var"), quotes=(plain('"'), plain("'"), plain("`", lines=True, escape=False))),
    "JavaScript": Syntax(SCRIPT, quotes=(plain('"'), plain("'"), TEMPLATE), patterns=True),
    "TypeScript": Syntax(SCRIPT | words("abstract any as asserts boolean declare enum implements interface is keyof module namespace never number object private protected public readonly string symbol type unknown"), quotes=(plain('"'), plain("'"), TEMPLATE), patterns=True),
    "Rust": Syntax(
        words("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"),
        nested=True,
        quotes=(Quote(r'b?r(#*)"', '"{0}', lines=True, escape=False), Quote('b?"', '"', lines=True)),
        extra=(("string", r"b?'(?:\\(?:x[\da-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\n])'"), ("lifetime", r"'[A-Za-z_]\w*"), ("name", r"(?<=r#)[A-Za-z_]\w*"), ("mark", r"r(?=#[A-Za-z_])")),
    ),
    "C#": Syntax(
        JAVA - words("boolean extends final implements import instanceof native package strictfp super synchronized throws transient") | words("as base bool checked decimal delegate event explicit extern fixed foreach implicit in internal is lock namespace object operator out override params readonly ref sbyte sealed sizeof stackalloc string struct typeof uint ulong unchecked unsafe ushort using var virtual"),
        extra=(DIRECTIVE,),
        quotes=(
            Quote(r'(?:\$@|@\$)"', '"(?!")', escape=False, lines=True, code=r"\{", skip=r'""|\{\{|\}\}', spec=True),
            Quote(r'@"', '"(?!")', escape=False, lines=True, skip='""'),
            Quote(r'\$"', '"', code=r"\{", skip=r"\{\{|\}\}", spec=True),
            plain('"'),
            plain("'"),
        ),
    ),
    "Kotlin": Syntax(words("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while by catch constructor finally get import init set where"), nested=True, quotes=(Quote('"""', lines=True, escape=False, **DOLLAR), plain('"', **DOLLAR), plain("'"))),
    "Swift": Syntax(
        words("as associatedtype break case catch class continue default defer deinit do else enum extension fallthrough false fileprivate for func guard if import in init inout internal is let nil open operator private protocol public repeat rethrows return self Self static struct subscript super switch throw throws true try typealias var where while"),
        nested=True,
        quotes=(Quote('(#+)"', '"{0}', escape=False), Quote('"""', lines=True), plain('"')),
    ),
    "PHP": Syntax(
        words("abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit extends false final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new null or print private protected public require require_once return static switch throw trait true try unset use var while xor yield"),
        line="//|#",
        quotes=(plain('"', lines=True, code=r"\{(?=\$)", names=r"\$(?=[A-Za-z_])"), plain("'", lines=True)),
        extra=(("mark", r"<\?(?:php|=)?|\?>"),),
        word=r"[^\W\d]\w*",
    ),
    "Lua": Syntax(
        words("and break do else elseif end false for function goto if in local nil not or repeat return then true until while"),
        line=r"--(?!\[=*\[)",
        block=None,
        extra=(("comment", r"--\[(?P<eq>=*)\[[\s\S]*?(?:\](?P=eq)\]|\Z)"),),
        quotes=(Quote(r"\[(=*)\[", r"\]{0}\]", lines=True, escape=False), plain('"'), plain("'")),
        word=r"[^\W\d]\w*",
    ),
    "Haskell": Syntax(words("case class data default deriving do else foreign if import in infix infixl infixr instance let module newtype of then type where"), line=r"--(?![!#$%&*+./<=>?@\\^|~:])", block=(r"\{-", r"-\}"), nested=True, quotes=(plain('"', lines=True), Quote(r"(?<!\w)'(?=\\?.[^'\n]*')", "'")), word=r"[^\W\d][\w']*"),
    "OCaml": Syntax(words("and as assert begin class constraint do done downto else end exception external false for fun function functor if in include inherit initializer lazy let match method module mutable new object of open or private rec sig struct then to true try type val virtual when while with"), line="", block=(r"\(\*", r"\*\)"), nested=True, quotes=(plain('"', lines=True), Quote(r"'(?=\\.|[^\\'\n]')", "'")), word=r"[^\W\d][\w']*"),
    "R": Syntax(words("FALSE Inf NA NULL NaN TRUE break else for function if in next repeat return while"), line="#", block=None, quotes=(plain('"', lines=True), plain("'", lines=True)), word=r"(?:[^\W\d]|\.(?=[^\W\d]))[\w.]*"),
    "SQL": Syntax(words("all alter and as asc between by case create cross delete desc distinct drop else end exists from full group having in index inner insert into is join left like limit not null offset on or order outer primary right select set table then union update using values view when where with"), line="--", quotes=(plain("'", escape=False, lines=True, skip="''"), plain('"', escape=False)), folded=True),
}
