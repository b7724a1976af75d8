"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: text between the borders of block elements, with the
tags and class words of its ancestors. The field labels the sequence of blocks as
main text or not from features of the ancestors and of the text, and from the label
of the block before; Viterbi gives the best sequence as a whole. What a reader never
sees as text (scripts, styles, the head, comments in the markup, choices of a form) is no
block at all.

The weights come from labelled pages, by the gradient of the conditional likelihood
(forward-backward). The pages given to the library have no labels, so the training
pages are written here by rule (``labelled_pages``): articles in the usual containers,
and the menus, headers, footers, sidebars, notices, adverts, forms and reader
comments around and inside of them, each block with its label.

Edge cases: null or empty html has the empty text; broken markup is read as far as
it can be (an open comment, script, style, title or textarea reaches to the end; anything else without its end
hides nothing, an element that closes itself neither; ends without a begin are
skipped; the head ends where the first element begins that cannot be in it); text outside of any element is a block; a page without main text has the
empty text; repeated pages are extracted each for itself.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, table

#: What these hold is text to the parser, up to their end or that of the page.
RAW = "script|style|title|textarea"
#: What these hold is markup that no reader sees.
HIDDEN = frozenset("noscript template select svg iframe object canvas".split())
IN_HEAD = frozenset("head title meta link script style base noscript template".split())
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})(?=[\s/>])(?:{ATTRIBUTES}|[^>]*+)>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a start tag closes, and what it does not look beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: Begins of these close an open paragraph.
ENDS_P = BLOCKS - {"button", "label", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
P_BORDER = frozenset({"button", "td", "th", "caption", "table", "body", "html"})


def tags_of(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of each piece of markup; name is empty for what is no tag.

    An element of ``HIDDEN`` that has an end of its own is one piece, with all that it holds.
    """
    tags = [(m.start(), m.end(), (m[3] or m[6] or "").lower(), bool(m[2] or m[5]), m[4] or m[7] or "") for m in TOKEN.finditer(page)]
    if not any(t[2] in HIDDEN for t in tags):
        return tags
    opened: dict[str, list[int]] = {}
    last: dict[int, int] = {}
    for i, (_, _, name, ends, attributes) in enumerate(tags):
        if name in HIDDEN:
            if not ends and not attributes.rstrip().endswith("/"):
                opened.setdefault(name, []).append(i)
            elif ends and opened.get(name):
                last[opened[name].pop()] = i
    out, i = [], 0
    while i < len(tags):
        if i in last:
            out.append((tags[i][0], tags[last[i]][1], "", False, ""))
            i = last[i]
        elif tags[i][2] not in HIDDEN:
            out.append(tags[i])
        else:
            out.append((*tags[i][:2], "", False, ""))
        i += 1
    return out


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(ancestors, text, characters in links) of each leaf block; an ancestor is its tag and class words."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                if not any(t == "head" for t, _ in stack[:3]):
                    out.append((tuple(f"{t} {w}" if w else t for t, w in stack if t in BLOCKS or w), text, linked))
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal links
        for tag, _ in stack[i:]:
            links -= tag == "a"
        del stack[i:]

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    for start, end, tag, ends, attrs in tags_of(page):
        if start > at:
            take(page[at:start])
        at = end
        if not tag:
            continue
        if tag not in IN_HEAD and not ends:
            for i, (t, _) in enumerate(stack[:3]):
                if t == "head":
                    flush()
                    pop_to(i)
                    break
        block = tag in BLOCKS
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if not block and stack[i][0] in BLOCKS:
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in P_BORDER:
                    break
                if stack[i][0] == "p":
                    pop_to(i)
                    break
        if tag in CLOSES:
            own, border = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in border:
                    break
                if stack[i][0] in own:
                    pop_to(i)
                    break
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            words = " ".join(re.findall(r"[a-z]+", " ".join(NAMED.findall(attrs)).lower())) if attrs else ""
            stack.append((tag, words))
            links += tag == "a"
    if at < len(page):
        take(page[at:])
    flush()
    return out


@functools.lru_cache(50_000)
def ancestor_features(path: tuple[str, ...]) -> tuple[str, ...]:
    tags = [a.split(" ")[0] for a in path]
    words = {w for a in path for w in a.split(" ")[1:]}
    found = {f"in:{t}" for t in tags} | {f"word:{w}" for w in words}
    if tags:
        found.add(f"own:{tags[-1]}")
        found.add(f"own:{tags[-1]}, in article: {'article' in tags or 'main' in tags}")
    return tuple(sorted(found))


def features(path: tuple[str, ...], text: str, linked: int) -> list[str]:
    n = text.count(" ") + 1
    share = linked / max(len(text), 1)
    out = [*ancestor_features(path), "any", f"words:{min(n.bit_length(), 7)}", f"links:{0 if not share else 1 if share < 0.4 else 2 if share < 0.9 else 3}"]
    if text[-1] in ".!?…:;\"”":
        out.append("ends like a sentence")
    return out


class Field:
    """Weights of a chain of two labels, 0 and 1 (main text)."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.unary = np.zeros((0, 2))
        self.step = np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 20, rate: float = 0.3, ridge: float = 1e-3) -> Field:
        for blocks, _ in pages:
            for b in blocks:
                for f in b:
                    self.names.setdefault(f, len(self.names))
        self.unary = np.zeros((len(self.names), 2))
        seen_u, seen_s = np.full_like(self.unary, 1e-6), np.full((2, 2), 1e-6)
        coded = [([np.array([self.names[f] for f in b]) for b in blocks], np.array(y)) for blocks, y in pages]
        order = random.Random(7)
        for _ in range(rounds):
            order.shuffle(coded)
            for blocks, y in coded:
                one, two = self._gradient(blocks, y)
                grad = -ridge * self.unary
                for b, g in zip(blocks, one):
                    grad[b] += g
                seen_u += grad**2
                self.unary += rate * grad / np.sqrt(seen_u)
                two -= ridge * self.step
                seen_s += two**2
                self.step += rate * two / np.sqrt(seen_s)
        self.table = {f: tuple(self.unary[i].tolist()) for f, i in self.names.items()}
        return self

    def _gradient(self, blocks: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is there less what the model expects, for each block's label and each step."""
        own = np.array([self.unary[b].sum(0) for b in blocks])
        n = len(own)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = own[0]
        for i in range(1, n):
            forward[i] = own[i] + np.logaddexp(*(forward[i - 1][:, None] + self.step))
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp(*(self.step + own[i + 1] + backward[i + 1]).T)
        total = np.logaddexp(*forward[-1])
        one = np.eye(2)[y] - np.exp(forward + backward - total)
        two = np.zeros((2, 2))
        for i in range(1, n):
            two -= np.exp(forward[i - 1][:, None] + self.step + own[i] + backward[i] - total)
            two[y[i - 1], y[i]] += 1
        return one, two

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The best labels (Viterbi)."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        get, back = self.table.get, []
        a = b = 0.0
        for i, block in enumerate(blocks):
            u = v = 0.0
            for f in block:
                if w := get(f):
                    u += w[0]
                    v += w[1]
            if i:
                from0, from1 = a + s00 < b + s10, a + s01 < b + s11
                back.append((from0, from1))
                a, b = (b + s10 if from0 else a + s00) + u, (b + s11 if from1 else a + s01) + v
            else:
                a, b = u, v
        labels = [int(b > a)]
        for from0, from1 in reversed(back):
            labels.append(int(from1 if labels[-1] else from0))
        return labels[::-1]


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages written by rule, and the label of each of their blocks."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))).capitalize()

    def pages_part(kind: str) -> list[tuple[str, int]]:
        say = lambda lo, hi, stop=True: words(lo, hi) + "." * stop
        link = lambda: f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'
        name = lambda *c: rng.choice([f' class="{rng.choice(c)}"', f' id="{rng.choice(c)}"'])
        if kind == "menu":
            tag = rng.choice(["nav", "div" + name("menu", "nav", "navigation", "navbar", "breadcrumb")])
            inner = [(f"<li>{link()}</li>", 0) for _ in range(rng.randint(2, 7))]
            return [(f"<{tag}><ul>", -1), *inner, (f"</ul></{tag.split()[0]}>", -1)]
        if kind == "header":
            tag = rng.choice(["header", "div" + name("header", "masthead", "top", "site-header")])
            inner = [(f"<{rng.choice(['h1', 'h2', 'p', 'div'])}>{say(1, 5, False)}", 0)] + [(f"<p>{say(3, 12)}</p>", 0)] * rng.randint(0, 1)
            return [(f"<{tag}>", -1), *inner, (f"</{tag.split()[0]}>", -1)]
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "div" + name("footer", "site-footer", "bottom", "copyright")])
            mark = rng.choice(["&copy; ", "© 2020 ", ""])
            inner = [(f"{mark}{say(1, 14)}", 0)] if rng.random() < 0.5 else [(f"<p>{mark}{say(3, 20)}</p>", 0), (f"<p>{link()} {link()}</p>", 0)]
            return [(f"<{tag}>", -1), *inner, (f"</{tag.split()[0]}>", -1)]
        if kind == "form":
            inner = [(f"<label>{say(1, 3, False)}</label>", 0), ("<input name=q>", -1), (f"<button>{say(1, 2, False)}</button>", 0)] + [(f"<p>{say(4, 20)}</p>", 0)] * rng.randint(0, 2)
            return [(f"<form{rng.choice(['', name('search', 'newsletter', 'signup', 'subscribe', 'login')])}>", -1), *inner, ("</form>", -1)]
        if kind == "comments":
            tag = rng.choice(["section", "div", "ol", "ul"])
            each = rng.choice(["div", "article", "li"]) if tag in ("section", "div") else "li"
            inner = [(f"<{rng.choice(['h2', 'h3', 'h4'])}>{say(1, 3, False)}", 0)] if tag in ("section", "div") else []
            for _ in range(rng.randint(1, 5)):
                inner += [(f"<{each}{rng.choice(['', ' class="comment"', ' class="reply"'])}>", -1)] + [(f"<p>{say(2, 45)}</p>", 0)] * rng.randint(1, 2) + [(f"</{each}>", -1)]
            return [(f"<{tag}{name('comments', 'comment-list', 'responses', 'discussion', 'comment', 'reader-comments')}>", -1), *inner, (f"</{tag}>", -1)]
        classes = {
            "side": ("sidebar", "side", "related", "widget", "recommended", "popular", "more"),
            "notice": ("notice", "alert", "cookie", "cookie-banner", "consent", "banner", "message", "popup", "modal", "disclaimer", "paywall"),
            "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adbox", "banner-ad", "promotion"),
        }[kind]
        tag = "aside" + rng.choice(["", name(*classes)]) if kind == "side" and rng.random() < 0.7 else rng.choice(["div", "div", "section", "aside", "p"]) + name(*classes)
        if tag.startswith("p ") or rng.random() < 0.4:
            return [(f"<{tag}>{say(2, 35)}</{tag.split()[0]}>", 0)]
        inner = [(f"<{rng.choice(['h3', 'h4', 'p', 'p'])}>{say(1, 30)}", 0) for _ in range(rng.randint(1, 3))]
        if kind == "side" and rng.random() < 0.5:
            inner += [("<ul>", -1), *((f"<li>{link()}</li>", 0) for _ in range(rng.randint(2, 5))), ("</ul>", -1)]
        return [(f"<{tag}>", -1), *inner, (f"</{tag.split()[0]}>", -1)]

    def article() -> list[tuple[str, int]]:
        tag = rng.choice(["article"] * 4 + ["main", 'div class="content"', 'div class="post"', 'div id="article"', 'div class="entry-content"', 'section class="story"'])
        body = [(f"<{rng.choice(['h1', 'h1', 'h2'])}>{words(1, 14)}", 1)] * (rng.random() < 0.9)
        if body and rng.random() < 0.15:
            body = [("<header>", -1), *body, ("</header>", -1)]
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            inline = f" <a href='#'>{words(1, 3)}</a> " if rng.random() < 0.2 else " "
            if kind < 0.66:
                body.append((f"<p>{rng.choice(['', '<b>', '<em>'])}{words(1, 90)}{inline}{words(1, 4)}{rng.choice(['.', '.', '<br>', ''])}{rng.choice(['</p>', ''])}", 1))
            elif kind < 0.72:
                body.append((f"<h{rng.randint(2, 4)}>{words(1, 6)}", 1))
            elif kind < 0.76:
                body += [("<ul>", -1), *((f"<li>{words(1, 20)}</li>", 1) for _ in range(rng.randint(1, 4))), ("</ul>", -1)]
            elif kind < 0.79:
                body.append((f"<blockquote>{words(3, 40)}.</blockquote>", 1))
            elif kind < 0.81:
                body.append((f"<pre>{words(1, 20)}</pre>", 1))
            elif kind < 0.83:
                body += [("<table><tr>", -1), (f"<td>{words(1, 3)}</td>", 1), (f"<td>{words(1, 3)}</td>", 1), ("</tr></table>", -1)]
            else:
                body += pages_part(rng.choice(["side", "notice", "advert", "form", "advert", "comments"]))
        if rng.random() < 0.15:
            body += pages_part("comments")
        if tag == "article" and rng.random() < 0.3:
            return [("<main>", -1), ("<article>", -1), *body, ("</article>", -1), *(pages_part("comments") if rng.random() < 0.3 else []), ("</main>", -1)]
        return [(f"<{tag}>", -1), *body, (f"</{tag.split()[0]}>", -1)]

    out = []
    for _ in range(n):
        around = lambda *kinds: [x for k in kinds if rng.random() < 0.5 for x in pages_part(k)]
        parts = [("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style></head><body>", -1)]
        parts += around("header", "menu", "notice", "advert", "form", "side") + (article() if rng.random() < 0.95 else []) + around("comments", "side", "advert", "notice", "form", "menu", "footer")
        out.append(("".join(p for p, _ in parts) + "</body></html>", [y for _, y in parts if y >= 0]))
    return out


@functools.lru_cache(1)
def trained() -> Field:
    pages = []
    for page, labels in labelled_pages():
        blocks = blocks_of(page)
        if blocks and len(blocks) == len(labels):
            pages.append(([features(*b) for b in blocks], labels))
    return Field().fit(pages)


def main_text(page: str, field: Field) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(text for (_, text, _), y in zip(blocks, field.decode([features(*b) for b in blocks])) if y)


def extract(pages: DataFrame, keep: list[str], field: Field | None = None) -> DataFrame:
    """Columns ``keep`` and the main text of every row's whole html. The field (some 30 kB) goes with the tasks."""
    field = field or trained()
    return annotate(pages, keep, [("main_text", "string")], lambda: lambda ts: [[main_text(t, field) for t in ts]], text="html")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return made.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
