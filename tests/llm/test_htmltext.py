import math
from html.parser import HTMLParser

import pytest

from tidewater.llm import htmltext as H


class Plain(HTMLParser):
    """The tree of a page whose every element is closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"name": "#root", "kids": []}
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = {"name": tag, "kids": []}
        self.stack[-1]["kids"].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1]["kids"].append(data)


def brute(html):
    p = Plain()
    p.feed(html)
    p.close()

    def count(node, link):
        link = link or node["name"] == "a"
        c = t = lc = lt = 0
        for k in node["kids"]:
            if isinstance(k, str):
                c += len(" ".join(k.split()))
                lc += len(" ".join(k.split())) if link else 0
            else:
                x = count(k, link)
                c, t, lc, lt = c + x[0], t + x[1] + 1, lc + x[2], lt + x[3] + (k["name"] == "a")
        node["n"] = (c, t, lc, lt)
        return node["n"]

    count(p.root, False)
    body = next(k for k in next(k for k in p.root["kids"] if not isinstance(k, str))["kids"] if k["name"] == "body")

    def dens(n):
        c, t, lc, lt = n["n"]
        if not c:
            return 0.0
        base = math.log(math.log(c / max(c - lc, 1) * lc + body["n"][2] / max(body["n"][0], 1) * c + math.e))
        return c / max(t, 1) if base <= 1e-9 else max(0.0, c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1e-9)) / base)

    best = []

    def walk(node, path, least):
        least = min(least, dens(node))
        total = sum(dens(k) for k in node["kids"] if not isinstance(k, str))
        best.append((total, path, least, node))
        for k in node["kids"]:
            if not isinstance(k, str):
                walk(k, f"{path}/{k['name']}", least)

    walk(body, "body", math.inf)
    total, path, least, node = max(best, key=lambda x: x[0])

    def words(node):
        out = []
        for k in node["kids"]:
            if isinstance(k, str):
                out += k.split()
            elif not (k["n"][2] and dens(k) < least and k["name"] in H.BLOCK):
                out += words(k)
        return out

    return words(node), path, total, least


PAGE = """<html><head><title>T</title></head><body><div><ul>{menu}</ul></div><div><article><h1>Head of it</h1>{text}<div><ul>{menu}</ul></div></article></div><div>short note</div></body></html>"""
MENU = "".join(f'<li><a href="/{i}">link number {i}</a></li>' for i in range(9))


@pytest.mark.parametrize("n", [1, 3, 12])
def test_equals_brute_force(n):
    html = PAGE.format(menu=MENU, text="".join(f"<p>Sentence {i} of the <b>main</b> text &amp; more, {'word ' * (5 + 7 * i)}</p>" for i in range(n)))
    text, core, total, least = H.extract(html)
    words, path, want_total, want_least = brute(html)
    assert text.split() == words and core == path
    assert total == pytest.approx(want_total) and least == pytest.approx(want_least)


def test_article_is_found():
    html = PAGE.format(menu=MENU, text="".join(f"<p>Sentence {i}, {'word ' * 30}</p>" for i in range(6)))
    text, core, _, _ = H.extract(html)
    assert core == "body/div/article" and text.startswith("Head of it\nSentence 0,") and "link number" not in text and "short note" not in text


def test_forgiving_parse():
    html = "<body><p>one<p>two <b>bold<ul><li>a<li>b</ul></i> & &lt;x&gt; 1 < 2<!-- no --><script>if (a<b) '</p>'</script><br>end<a href='>'>l</a><p title=\"a>b\">q"
    tree = H.parse(html)
    p = [i for i, x in enumerate(tree.names) if x == "p"]
    assert [tree.names[tree.parent[i]] for i in p] == ["body"] * 3
    text = H.extract(html)[0]
    assert "if (a" not in text and "no" not in text.split() and "<x>" in text and "1 < 2" in text
    assert H.extract("<p>a <b")[0] == "a"
    deep = "<b>" * 20000 + "x"
    assert H.extract(deep)[0] == "x"
    assert H.extract("<a<a" * 20000)[0] == ""


@pytest.mark.parametrize("tag", ["<a title=it's>", '<div class="a"">', '<div class="a>', "<i b = 'c' d'>", '<b x=y"z>', '<b "x>', "<b title='a>b\" c=\"d>e'>"])
@pytest.mark.parametrize("rest", ["", " it's", ' 5" and 6"'])
def test_stray_quotes_end_with_the_tag(tag, rest):
    """Tags with a quote too many or too few keep the page's text, whether or not another quote follows."""
    if tag == '<div class="a>' and '"' in rest:
        rest = ""  # there the value goes on to the next quote, as in browsers
    names = H.parse(f"<body><p>one</p>{tag}two<p>three{rest}</p>").names
    text = H.extract(f"<body><p>one</p>{tag}two<p>three{rest}</p>")
    assert names == ["#root", "body", "p", tag[1:].split()[0], "p"]
    assert [x for _, x, _ in H.parse(f"<body><p>one</p>{tag}two<p>three{rest}</p>").text] == ["one", "two", f"three{rest}"] and text


def test_rows(spark):
    rows = [(1, None, "e"), (2, "", "e"), (3, "just text", "e"), (3, "just text", "e"), (None, "<script>x</script>", "e"), (4, "<p>" + "long " * 300_000, "e")]
    got = {(r.page_id, r.text if r.page_id != 4 else len(r.text), r.n_chars) for r in H.extract_pages(spark.createDataFrame(rows, "page_id bigint, html string, text string")).collect()}
    assert got == {(1, None, None), (2, "", 0), (3, "just text", 9), (None, "", 0), (4, 1499999, 1499999)}
    assert H.extract_pages(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
