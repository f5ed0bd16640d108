"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read into a tree of elements; each element's children are a stream of tokens (an element's tag and classes, or a
text slot). Two pages are aligned stream by stream, from the root down: tokens that match are merged, tokens that repeat side
by side fold into one repeated group, tokens that only one page has become optional, texts become slots. Folding page after
page gives the host's wrapper, an expression of sequences, optionals and repetitions without any union.

The wrapper is where decisions are made, from all pages of the host at once: a slot belongs to the main text if it lies in the
host's content element and in nothing that carries navigation, notices, adverts, forms or comments. The content element is the
article or main element if the host's wrapper has one; else the element whose own paragraphs hold most text outside of links,
summed over pages. Each page is then read along the wrapper and the texts of its main slots are put out in page order.

Wrappers are inferred by tasks on their own pages and merged by host, so that a host of many pages is split over all tasks; a
wrapper's size follows the variety of a host's templates, not its number of pages.

Nulls: null or empty html gives an empty text; a null url, or one without a host, belongs to the host named ''. Rows with a null
or repeated page_id are read each on their own. An empty table gives an empty table. Extra columns are ignored.
"""
from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Callable, Generator, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

NAME = "op6_wrapper_text"
ORACLE_SQL = None  # trees are not expressible; tests compare with a plain reading of known templates

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
#: Elements that are no part of a line: their edges separate words.
BLOCK = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split())
#: Starting one of these ends an open paragraph; items end the item before them.
ENDS_P = BLOCK - frozenset("br button body html head caption td th tr tbody thead tfoot option optgroup legend summary".split())
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
             "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
#: Never part of the main text, by tag and by the words of class, id and role.
DROP_TAGS = RAW | frozenset("head nav footer aside form button select input menu dialog object audio video canvas".split())
DROP_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus
footer header login masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted promotion pagination pager related recommended
replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split())
#: Words of an article element that is not the page's own.
OTHERS = frozenset("comment comments reply replies related recommended sponsored promo teaser".split())
NEGATING = frozenset("has with without no".split())
#: Ahead of an article's own title these are part of it.
INNER_HEADER = "header"
CONTENT = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element, or a text slot (tag None)."""

    __slots__ = ("tag", "words", "children", "text", "drop")

    def __init__(self, tag, words=(), text=""):
        self.tag, self.words, self.children, self.text, self.drop = tag, words, [], text, False


def _words(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role, sorted; digits count as one, so that numbered ids are alike."""
    if not attributes:
        return ()
    found = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role") and (value := a or b or c):
            found.update(w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", entities.unescape(value)).lower()) if w)
        elif name.lower() == "hidden" or name.lower() == "aria-hidden" and "true" in (a, b, c):
            found.add("modal")
    return tuple(sorted(found))


def parse(html: str) -> Node:
    """The page's tree. Tags left open end with what they lie in; unknown end tags are skipped; character references are decoded."""
    root = Node("#root")
    stack, at, skip = [root], 0, len(html)

    def text(upto: int) -> None:
        if upto > at and (piece := html[at:upto]).strip():
            stack[-1].children.append(Node(None, (), entities.unescape(piece) if "&" in piece else piece))
        elif upto > at:
            stack[-1].children.append(Node(None, (), " "))

    pos = 0
    while (m := _TOKEN.search(html, pos)) and m.start() < skip:
        text(m.start())
        at = pos = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # an inline or paragraph end tag does not close the blocks around it
                if stack[i].tag in ("article", "main", "body", "table", "td", "section", "div") and tag not in BLOCK:
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS_SAME:
            same, outer = ENDS_SAME[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same and (tag not in ("td", "th") or stack[i].tag != "tr"):
                    del stack[i:]
                    break
                if stack[i].tag in outer:
                    break
        node = Node(tag, _words(m[3]))
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, pos)
            at = pos = end.end() if end else len(html)
            continue
        stack.append(node)
    text(len(html))
    return root


# A wrapper is a list [token, children, optional, repeated, own text, link text, pages]; token is "tag word word", "#" for a text slot.
TOKEN, CHILDREN, OPTIONAL, REPEATED, TEXT, LINKS, PAGES = range(7)


def _token(node: Node) -> str:
    return "#" if node.tag is None else " ".join((node.tag, *node.words))


def _stacked(f: Callable) -> Callable:
    """Calls of a generator function that yields its inner calls and gets their results: pages are nested deeper than Python's stack."""
    @functools.wraps(f)
    def run(*args, **named):
        calls, result = [f(*args, **named)], None
        while calls:
            try:
                calls.append(calls[-1].send(result))
                result = None
            except StopIteration as done:
                calls.pop()
                result = done.value
        return result

    return run


def _wrapper_of(node: Node, in_link: bool = False) -> Generator:
    w = [_token(node), [], 0, 0, 0, 0, 1]
    if node.tag is None:
        n = len(node.text.strip())
        w[LINKS if in_link else TEXT] = n
        return w
    link = in_link or node.tag == "a"
    for child in node.children:
        if child.tag is not None or child.text.strip():
            w[CHILDREN].append((yield _wrapper_of(child, link)))
    w[CHILDREN] = yield from _fold(w[CHILDREN])
    return w


@_stacked
def wrapper_of(node: Node, in_link: bool = False) -> Generator:
    """A page as a wrapper: neighbours that are alike already folded into repetitions."""
    return (yield _wrapper_of(node, in_link))


def _fold(children: list) -> Generator:
    """Runs of equal tokens become one repetition; so do runs of equal pairs, as of terms and definitions."""
    out: list = []
    for c in children:
        if out and out[-1][TOKEN] == c[TOKEN]:
            out[-1] = yield _merge(out[-1], c, same_page=True)
            out[-1][REPEATED] = 1
        elif len(out) >= 3 and c[TOKEN] == out[-2][TOKEN] and out[-1][TOKEN] == out[-3][TOKEN]:
            # x y x y: fold the second pair into the first
            y, x = out.pop(), out.pop()
            out[-2] = yield _merge(out[-2], x, same_page=True)
            out[-1] = yield _merge(out[-1], y, same_page=True)
            out[-2][REPEATED] = out[-1][REPEATED] = 1
            out.append(c)
        else:
            out.append(c)
    return out


def _merge(a: list, b: list, same_page: bool = False) -> Generator:
    out = [a[TOKEN], [], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], a[TEXT] + b[TEXT], a[LINKS] + b[LINKS],
           max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]]
    x, y = a[CHILDREN], b[CHILDREN]
    if [c[TOKEN] for c in x] == [c[TOKEN] for c in y]:
        for c, d in zip(x, y, strict=True):
            out[CHILDREN].append((yield _merge(c, d, same_page)))
        return out
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][TOKEN] == y[j][TOKEN] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    made = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][TOKEN] == y[j][TOKEN]:
            made.append((yield _merge(x[i], y[j], same_page)))
            i, j = i + 1, j + 1
        else:
            if j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
                one, i = x[i], i + 1
            else:
                one, j = y[j], j + 1
            made.append([*one[:OPTIONAL], 1, *one[REPEATED:]])
    out[CHILDREN] = yield from _fold(made)
    return out


@_stacked
def merge(a: list, b: list, same_page: bool = False) -> Generator:
    """The wrapper that both match: streams aligned by their longest common subsequence, what one lacks optional."""
    return (yield _merge(a, b, same_page))


def _regex(w: list) -> Generator:
    parts = []
    for c in w[CHILDREN]:
        parts.append((yield _regex(c)))
    inner = " ".join(parts)
    body = "#" if w[TOKEN] == "#" else f"<{w[TOKEN]}>{inner and ' ' + inner + ' '}</>"
    return f"({body}){'+' if w[REPEATED] else ''}{'?' if w[OPTIONAL] else ''}" if w[REPEATED] or w[OPTIONAL] else body


@_stacked
def regex(w: list) -> Generator:
    """The wrapper as an expression over tokens."""
    return (yield _regex(w))


def dumped(w: list) -> str:
    """The wrapper as flat JSON: its nodes in page order, the number of children in place of them."""
    out, todo = [], [w]
    while todo:
        one = todo.pop()
        out.append([one[TOKEN], len(one[CHILDREN]), *one[OPTIONAL:]])
        todo += reversed(one[CHILDREN])
    return json.dumps(out)


def loaded(text: str) -> list:
    """The wrapper of `dumped`."""
    done: list = []
    for one in reversed(json.loads(text)):  # a node's children are the last ones done
        n = one[CHILDREN]
        one[CHILDREN] = done[:-n - 1:-1] if n else []
        del done[len(done) - n:]
        done.append(one)
    return done[0]


def _dropped(token: str, inside: bool) -> bool:
    tag, *words = token.split(" ")
    if tag in DROP_TAGS or tag == "header" and not inside:
        return True
    if tag in ("html", "body") or any(w in NEGATING for w in words):  # "with-sidebar" says what lies beside
        return False
    if tag in CONTENT:
        return any(w in OTHERS for w in words)
    return any(w in DROP_WORDS and not (inside and w == INNER_HEADER) for w in words)


def _totals(w: list) -> dict[int, tuple[int, int]]:
    """Characters outside and inside of links, at and below every element that is not dropped, by the element's id()."""
    order = [w]
    for node in order:  # grows
        order += [c for c in node[CHILDREN] if not _dropped(c[TOKEN], False)]
    found: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        below = [found[id(c)] for c in node[CHILDREN] if id(c) in found]
        found[id(node)] = node[TEXT] + sum(t for t, _ in below), node[LINKS] + sum(k for _, k in below)
    return found


def content_path(w: list) -> list[str]:
    """Tokens from the root to the host's content element."""
    totals = _totals(w)

    def named(tag: str) -> list[tuple[int, tuple]]:
        found, todo = [], [(w, ())]
        while todo:
            node, path = todo.pop()  # a path is (path to the parent, token)
            if node[TOKEN].split(" ")[0] == tag:
                found.append((totals[id(node)][0], path))
            else:
                todo += [(c, (path, c[TOKEN])) for c in reversed(node[CHILDREN]) if c[TOKEN] != "#" and id(c) in totals]
        return found

    for tag in CONTENT:
        if found := named(tag):
            path, up = [], max(found, key=lambda f: f[0])[1]
            while up:
                up, token = up
                path.append(token)
            return path[::-1]
    path = []
    while True:  # down, as long as one child holds nearly all text
        total = totals[id(w)][0]
        below = [(totals[id(c)][0] - 2 * totals[id(c)][1], c) for c in w[CHILDREN] if c[TOKEN] != "#" and c[TOKEN].split(" ")[0] in BLOCK and id(c) in totals]
        score, c = max(below, key=lambda b: b[0], default=(0, None))
        if c is None or c[REPEATED] or score < 0.6 * total or c[TOKEN].split(" ")[0] in ("p", "pre", "blockquote", "ul", "ol", "table"):
            return path
        path.append(c[TOKEN])
        w = c


def _emit(node: Node, out: list[str]) -> None:
    todo: list[Node | str] = node.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag is None:
            out.append(c.text)
        elif not _dropped(_token(c), True):
            edge = " " if c.tag in BLOCK else ""
            out.append(edge)
            todo.append(edge)
            todo += reversed(c.children)


def extract(page: Node, path: list[str]) -> str:
    """The main text of a page, along its host's content path; without that path on the page, along its own."""
    at = [page]
    for token in path:
        at = [c for n in at for c in n.children if c.tag is not None and _token(c) == token]
    if not at:
        own = content_path(wrapper_of(page))
        at = [page]
        for token in own:
            at = [c for n in at for c in n.children if c.tag is not None and _token(c) == token]
    out: list[str] = []
    for n in at:
        out.append(" ")
        _emit(n, out)
    return " ".join("".join(out).split())


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as flat JSON, path to the content element) for each host of pages(host, html)."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for h, t in zip(batch.column("host"), batch.column("html"), strict=True):
                w = wrapper_of(parse(t.as_py() or ""))
                h = h.as_py()
                found[h] = merge(found[h], w) if h in found else w
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([dumped(w) for w in found.values()], pa.string())], names=["host", "wrapper"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, w = None, None
        for batch in batches:
            for h, one in zip(batch.column("host"), batch.column("wrapper"), strict=True):
                key, one = h.as_py(), loaded(one.as_py())
                w = one if w is None else merge(w, one)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([dumped(w)], pa.string()), pa.array([content_path(w)], pa.list_(pa.string()))],
                                         names=["host", "wrapper", "path"])

    own = pages.select("host", "html").mapInArrow(infer, "host string, wrapper string")
    return own.groupBy("host").applyInArrow(together, "host string, wrapper string, path array<string>")


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text) of each row."""
    rows = pages.select("page_id", F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    paths = cut_lineage(wrappers(rows).select("host", "path"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(parse(t.as_py() or ""), p.as_py() or []) for t, p in zip(batch.column("html"), batch.column("path"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.join(paths, "host").select("page_id", "url", "html", "path").mapInArrow(read, f"page_id {kind}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
