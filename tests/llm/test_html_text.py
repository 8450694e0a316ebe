import html as entities
import random

import pytest

from demandspark.llm import html_text

ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First, one\n two<br><p>Second&nbsp;one, yes.</p><ul><li>x<li>y</ul></article>"
TEXT = "Title & more\nFirst, one two\nSecond one, yes.\nx\ny"

CASES = [
    (f"<html><head><title>no</title><script>var t='</p>'</script></head><body><nav><ul><li><a href='/a'>a</a></ul></nav>{ARTICLE}<footer>f, f</footer></body></html>", TEXT),
    (f"<body><div class='sidebar'><p>long text, with commas, and, more, of, them</p></div><main>{ARTICLE}</main><div id=comments><p>no, no, no</p></div>", TEXT),
    (f"<header><p>no, no</p></header>{ARTICLE[:-10]}", TEXT),
    ("<div><div><p>one, two, three</p><p>four</p></div><div class='ad'>buy, buy, buy, buy</div><div><p>five, six, seven</p></div></div>", "one, two, three\nfour\nfive, six, seven"),
    ("<article><p>a, b</p><section class='comments'><p>c, c, c, c</p></section><form><input><p>d</p></form><p hidden>e</p></article>", "a, b"),
    ("<p>cut &am", "cut &am"),
    ("<p>a<!-- b --><![CDATA[x]]><p>c <im", "a\nc"),
    ("plain text only", "plain text only"),
    ("<b>" * 3000 + "deep" + "</b>" * 3000, "deep"),
    ("<table><tr><td>x<td>y<tr><td>z</table>", "x\ny\nz"),
    ("", ""),
    (None, ""),
    ("<style>p{}</style><script>x", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    assert html_text.main_text(page) == text


LONG = "<p>Long text, of the page, with commas, and words.</p><p>More of it, and more, to the end.</p>"
LONG_TEXT = "Long text, of the page, with commas, and words.\nMore of it, and more, to the end."
SIDE = "<div class='sidebar'><p>side, side</p></div>"
NAMES = ["content-sidebar-wrap", "content has-sidebar", "with-comments", "page no-header", "layout__sidebar-left main"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["class", "id"])
def test_wrappers_are_not_skipped_by_name(name, kind):
    around = lambda inner: f"<body><div>out</div><div {kind}='{name}'>{SIDE}{inner}</div>"
    assert html_text.main_text(around(ARTICLE)) == TEXT
    assert html_text.main_text(around(f"<main>{LONG}</main>")) == LONG_TEXT
    assert html_text.main_text(around(f"<section class='no-sidebar'><div>{LONG}</div></section>")) == LONG_TEXT
    assert html_text.main_text(f"<main><h1>Title</h1><div {kind}='{name}'>{LONG}{SIDE}</div></main>") == "Title\n" + LONG_TEXT


def test_named_parts_stay_out():
    comments = "<div id='comments' class='comments-area'><article>" + LONG + "</article></div>"
    assert html_text.main_text(f"<article><p>short, one</p>{comments}</article>") == "short, one"
    assert html_text.main_text(f"<div class='with-comments'><article>{LONG}<div class='post-share'>share, this</div></article>{SIDE}</div>") == LONG_TEXT
    assert html_text.main_text(f"<div class='content has-sidebar' hidden>{LONG}</div><p>seen</p>") == "seen"


def test_whole_table(spark):
    long = "<article>" + "<p>w, w</p>" * 20_000 + "</article>"
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(CASES)] + [(99, None, long), (None, "u", ARTICLE), (None, "u", ARTICLE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[99].count("\n") == 19_999
    assert [r["text"] for r in got if r["page_id"] is None] == [TEXT, TEXT]
    assert html_text.extract(df.limit(0)).count() == 0


BODY = "".join(f"<p>Body paragraph {i}, with words, and commas, and more of them.</p>" for i in range(4))
BODY_TEXT = "\n".join(f"Body paragraph {i}, with words, and commas, and more of them." for i in range(4))
REMARK = "Remark {}, by a reader, with words, and commas, and many more of them, on and on."


@pytest.mark.parametrize("n", [1, 4, 8, 20, 40])
@pytest.mark.parametrize("name", ["class='comments'", "id=comments", "class='comment-list wide'", "id='post-comments'", "class='replies'", "class=disqus_thread"])
def test_remarks_are_never_the_main_text(n, name):
    plain = "".join(f"<p>{REMARK.format(i)}</p>" for i in range(n))
    articles = "".join(f"<article class='comment'><p>{REMARK.format(i)}</p></article>" for i in range(n))
    for remarks in (plain, articles):
        assert html_text.main_text(f"<body><div id=post>{BODY}</div><div {name}>{remarks}</div>") == BODY_TEXT
        assert html_text.main_text(f"<body><article>{BODY}</article><section {name}>{remarks}</section>") == BODY_TEXT
        assert html_text.main_text(f"<body><main><article>{BODY}<div {name}>{remarks}</div></article></main>") == BODY_TEXT
        assert html_text.main_text(f"<body class='has-comments'><div class='with-comments'><div>{BODY}</div><div {name}>{remarks}</div></div>") == BODY_TEXT
    beside = "".join(f"<p>{REMARK.format(i)}</p>" for i in range(n))
    assert html_text.main_text(f"<body><div id=post>{BODY}</div><div class='related'>{beside}</div>") == BODY_TEXT


@pytest.mark.parametrize("tag, text", [
    ("<p class=o'neil>", "x, y"), ("<p title='a > b'>", "x, y"), ('<p title="it\'s" class=a>', "x, y"), ("<p a=b'c\"d e>", "x, y"), ("<p =x>", "x, y"),
    ("<p title=\"unclosed>", "x, y"), ("<p a = 'b' c>", "x, y"), ("<p/ class=a>", "x, y"), ("<p a='1'b='2'>", "x, y"), ("<p\na\n=\nb\n>", "x, y"),
])
def test_attributes_leave_no_markup(tag, text):
    assert html_text.main_text(f"<article>{tag}x, y</p></article>") == text
    assert html_text.main_text(f"<article><br class=x'/>{tag}x, y</article>") == text


def random_page(rng, depth=0):
    """(tag, children): a tree of blocks and links without names."""
    kids = []
    for _ in range(rng.randint(1, 4)):
        roll = rng.random()
        if depth < 3 and roll < 0.4:
            kids.append((rng.choice(["div", "section"]), random_page(rng, depth + 1)))
        elif roll < 0.85:
            text = " ".join(rng.choice(["ab", "cd,", "efg", "h,"]) for _ in range(rng.randint(1, 40)))
            kids.append(("p", [("a", [text]) if rng.random() < 0.3 else text, " end"]))
        else:
            kids.append(("ul", [("li", [("a", ["link, there"])]) for _ in range(3)]))
    return kids


def plain_main_text(kids):
    """The scoring as it is told, every sum by itself."""
    nodes, up = [], {}

    def index(tag, kids, parent):
        node = (len(nodes), tag, kids)
        nodes.append(node)
        up[node[0]] = parent
        for i, kid in enumerate(kids):
            if isinstance(kid, tuple):
                kids[i] = index(*kid, node)
        return node

    body = index("body", kids, None)
    inline = lambda n: "".join(k if isinstance(k, str) else inline(k) for k in n[2] if isinstance(k, str) or k[1] == "a")
    length = lambda n: len(" ".join(k for k in n[2] if isinstance(k, str)).strip()) + sum(length(k) for k in n[2] if not isinstance(k, str))
    linked = lambda n: length(n) if n[1] == "a" else sum(linked(k) for k in n[2] if not isinstance(k, str))
    points = dict.fromkeys(range(len(nodes)), 0.0)
    for n in nodes:
        own = [k for k in n[2] if isinstance(k, str) or k[1] == "a"]
        if n[1] not in ("p", "li", "div", "section", "body") or not own:
            continue
        size = len(" ".join(k for k in own if isinstance(k, str)).strip()) + sum(length(k) for k in own if not isinstance(k, str))
        value = (min(size / 25, 1) + inline(n).count(",") + min(size / 100, 3)) * (1 - sum(length(k) for k in own if not isinstance(k, str)) / size)
        x, part = (n if n[1] in ("div", "section", "body") else up[n[0]]), 1.0
        while x is not None and part > 0.05:
            points[x[0]] += value * part
            x, part = up[x[0]], part / 2
    worth = lambda n: points[n[0]] * (1 - linked(n) / length(n) if length(n) else 1)
    best = max((n for n in nodes if points[n[0]] > 0), key=lambda n: (worth(n), -n[0]), default=None)
    if best is None:
        return ""
    beside = [k for k in (up[best[0]] or (0, "", [best]))[2] if not isinstance(k, str)]
    fits = lambda n: worth(n) >= 0.2 * worth_points or (n[1] in ("p", "li", "div", "section") and length(n) > 0 and linked(n) < 0.33 * length(n))
    worth_points = points[best[0]]
    kept = [best] if best is body else [n for n in beside if n is best or fits(n)]

    def blocks(n):
        out, held = [], []
        for k in n[2]:
            if isinstance(k, str) or k[1] == "a":
                held.append(k if isinstance(k, str) else inline(k))
            else:
                out += [" ".join("".join(held).split())] + blocks(k)
                held = []
        return [b for b in out + [" ".join("".join(held).split())] if b]

    return "\n".join(b for n in kept for b in blocks(n))


def test_scoring_against_a_plain_version():
    rng = random.Random(12)
    render = lambda kids: "".join(entities.escape(k) if isinstance(k, str) else f"<{k[0]}>{render(k[1])}</{k[0]}>" for k in kids)
    for _ in range(400):
        kids = random_page(rng)
        page = f"<html><body>{render(kids)}</body></html>"
        assert html_text.main_text(page) == plain_main_text(kids), page
