"""Main text of HTML pages by composite text density.

For every node of the DOM: C the characters of its subtree, T its tags, LC and LT the
same inside links. The composite density is

    C/T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e))

with the body's LCb and Cb; a count of zero in a denominator is one. Links lower it.
A node's density sum is that of its children's densities. The node of the greatest
sum is the core, whose subtree is the content; the least density on the path from it
up to the body is the threshold. Blocks inside the core that hold links and stay under
the threshold (menus, lists of related pages) are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: An open element of these names ends where one of those starts.
ENDS = {"p": BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]), "a": frozenset(["a"])}
#: Elements nested deeper count as children of the last that isn't, as in browsers.
DEPTH = 512
#: Where the search for an element that ends by itself stops.
SCOPE = frozenset("table ul ol dl div article section main body html td th blockquote".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW | {"textarea", "title"}}


class Tree:
    """Nodes in document order: name, parent, and pieces of text as (node, text, nodes begun before it)."""

    def __init__(self) -> None:
        self.names: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.text: list[tuple[int, str, int]] = []


def parse(html: str) -> Tree:
    """A forgiving parse: elements that may end by themselves do, ends without a start are passed over, what is open at the end is closed. Quotes delimit right after '=' alone; a tag that finds no end with them ends at the next '>', and one without any swallows the rest."""
    tree = Tree()
    names, parent, text = tree.names, tree.parent, tree.text
    stack = [0]
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text.append((stack[-1], html[at:], len(names)))
            break
        if lt > at:
            text.append((stack[-1], html[at:lt], len(names)))
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if m is None:
            after = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif after in ("!", "?", "/"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            elif after.isascii() and after.isalpha():
                break
            else:
                text.append((stack[-1], "<", len(names)))
                at = lt + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if names[stack[i]] == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = n if end is None else end.end()
            continue
        for i in range(len(stack) - 1, 0, -1):
            open_ = names[stack[i]]
            if name in ENDS.get(open_, ()):
                del stack[i:]
                break
            if open_ in SCOPE:
                break
        names.append(name)
        parent.append(stack[-1])
        if name in ("title", "textarea"):
            end = _RAW_END[name].search(html, at)
            text.append((len(names) - 1, html[at : n if end is None else end.start()], len(names)))
            at = n if end is None else end.end()
        elif name not in VOID and not m[3].endswith("/") and len(stack) < DEPTH:
            stack.append(len(names) - 1)
    return tree


def density(c: int, t: int, lc: int, lt: int, lcb: int, cb: int) -> float:
    """Of a node. Where neither it nor the body has a character in a link, that is the plain C/T; a density is never negative."""
    if not c:
        return 0.0
    t1 = max(t, 1)
    base = math.log(math.log(c / max(c - lc, 1) * lc + lcb / max(cb, 1) * c + math.e))
    if base <= 1e-9:
        return c / t1
    return max(0.0, c / t1 * math.log(max(c / max(lc, 1) * t1 / max(lt, 1), 1e-9)) / base)


def extract(html: str) -> tuple[str, str, float, float]:
    """(text, path of the core, its density sum, threshold)."""
    tree = parse(html)
    names, parent = tree.names, tree.parent
    n = len(names)
    body = next((i for i, x in enumerate(names) if x == "body"), None)
    if body is None:
        body = next((i for i, x in enumerate(names) if x == "html"), 0)
    c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
    pieces = [(i, " ".join(entities.unescape(x).split()), x, begun) for i, x, begun in tree.text]
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[parent[i]] or names[i] == "a"
    for i, x, _, _ in pieces:
        c[i] += len(x)
        if linked[i]:
            lc[i] += len(x)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        c[p] += c[i]
        lc[p] += lc[i]
        t[p] += t[i] + 1
        lt[p] += lt[i] + (names[i] == "a")
    d = [density(c[i], t[i], lc[i], lt[i], lc[body], c[body]) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        total[parent[i]] += d[i]
    # subtrees are ranges in document order
    end = list(range(1, n + 1))
    for i in range(n - 1, 0, -1):
        end[parent[i]] = max(end[parent[i]], end[i])
    core = max(range(body, end[body]), key=lambda i: (total[i], -i))
    path, i, least = [], core, d[core]
    while i >= 0:
        path.append(names[i])
        if i >= body:
            least = min(least, d[i])
        if i == body:
            break
        i = parent[i]
    skip, i = [], core + 1
    while i < end[core]:
        if lc[i] and d[i] < least and names[i] in BLOCK:
            skip.append((i, end[i]))
            i = end[i]
        else:
            i += 1
    out: list[str] = []
    line: list[str] = []
    k, seen, block, spaced = 0, core + 1, _block(names, parent, core), False
    for i, x, raw, begun in pieces:
        while k < len(skip) and i >= skip[k][1]:
            k += 1
        if not core <= i < end[core] or k < len(skip) and i >= skip[k][0]:
            continue
        own = _block(names, parent, i)
        if own != block or any(names[j] in BLOCK for j in range(seen, begun)):
            if line:
                out.append("".join(line))
            line, spaced = [], False
        if x:
            line.append((" " if line and (spaced or raw[:1].isspace()) else "") + x)
        spaced = raw[-1:].isspace()
        seen, block = begun, own
    if line:
        out.append("".join(line))
    return "\n".join(x.strip() for x in out if x.strip()), "/".join(reversed(path)), total[core], least


def _block(names: list[str], parent: list[int], i: int) -> int:
    while i > 0 and names[i] not in BLOCK:
        i = parent[i]
    return i


def extract_pages(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, core, density_sum, threshold, n_chars, text) for every row of pages.

    core is the path of the node of the greatest density sum, from the body down. text has one line for each block of the content. Null
    html has nulls; html without text (empty, only scripts) has an empty text and densities of 0. A page without a body is taken
    whole. Ties go to the first node. Pages of any length are parsed whole, repeated rows come out alike, an empty table gives no
    rows, and other columns aren't read. One pass, no shuffle.
    """

    @F.arrow_udf("core string, density_sum double, threshold double, n_chars int, text string")
    def run(column: pa.Array) -> pa.Array:
        rows: list[list] = [[], [], [], [], []]
        for x in column:
            found = extract(x.as_py()) if x.is_valid else None
            for col, value in zip(rows, (None,) * 5 if found is None else (found[1], round(found[2], 6), round(found[3], 6), len(found[0]), found[0])):
                col.append(value)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string())
        return pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], ["core", "density_sum", "threshold", "n_chars", "text"])

    return pages.select(F.col(id_col).alias("page_id"), run.asNondeterministic()(F.col(html)).alias("x")).select("page_id", "x.*")
