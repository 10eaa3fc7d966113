import random

import pytest

from sparkloom.llm import markup as m

CASES = [
    ("<h2>A</h2><p>x <b>y</b><br>z<ul><li>one<li>two</ul><pre>if a &lt; b:\n  c</pre>", ["html"], ["## A", "x y\nz", "- one", "- two", "```\nif a < b:\n  c\n```"]),
    ("<table><tr><td>a<td>b</tr></table><a href='https://x/'>here</a> <img alt=\"pic\" src=p>", ["html"], ["| a | b |", "here (https://x/)", "[image: pic]"]),
    ("# T\n\n- [x] done\n- `code` and **bold**\n\n~~~py\nhtml = \"<b>\" # no\n~~~\n|a|b|\n|---|---|\n|1|2|", ["markdown"], ["# T", "- done", "`code` and bold", 'html = "<b>" # no', "|1|2|"]),
    ("see [this](https://x/y_(z)) and ![pic](p.png)", ["markdown"], ["this (https://x/y_(z))", "[image: pic] (p.png)"]),
    ("== T ==\n* ''x'' and '''y'''\n{| class=\"t\"\n|-\n| a || b\n|}\n[[https://x/|here]]\n{{{\nbox **no**\n}}}", ["wiki"], ["## T", "* x and y", "| a | b |", "here (https://x/)", "box **no**"]),
    ("{{code|lang=py|\na = {\"b\": [1]}\n}}\nplain", ["wiki"], ['a = {"b": [1]}', "plain"]),
    ("\\section{T}\n\\begin{itemize}\n\\item \\texttt{a\\_b}\n\\end{itemize}\n\\begin{verbatim}\n# <b>\n\\end{verbatim}\n\\href{https://x/}{here}", ["latex"], ["# T", "- a_b", "# <b>", "here (https://x/)"]),
    ("so $$\\frac{a}{b}$$ and \\(x^2\\) and $O(n \\log n)$", ["latex"], ["$\\frac{a}{b}$", "$x^2$", "$O(n \\log n)$"]),
    ("x <kbd>y</kbd>\n```\n<b>\n```", ["html", "markdown"], ["x y", "<b>"]),
]
PLAIN = ["as long as 4 < m and m > 4", "Dict<str, int> in the client", "A~B means 5 %, R&D says", "2 * 5 * 3 calls, see #5", "C:\\work\\new\\4 is the folder", "My_old_name and its twin cost $5 and $7 a day", "a_b_c and __init__", "{\"a\": [1], 'b': {}}", "don't ''", "http://x/a_b_c?d=1&e=2", "[no text]", "- just\n- a list", "x == y == z", "1. a\n2. b", "~/x and ~/y", "a | b | c", ""]


@pytest.mark.parametrize(("text", "kinds", "parts"), CASES)
def test_constructs(text, kinds, parts):
    clean, met = m.convert(text)
    assert met == kinds
    for p in parts:
        assert p in clean, clean


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    clean, met = m.convert(text)
    assert met == [] and clean == text.strip()


def test_unclosed():
    assert m.convert("```py\n<b>")[1] == ["markdown"] and m.convert("<pre>\n# x")[1] == ["html"] and m.convert("{{{\n# x")[1] == ["wiki"]
    assert m.convert("<p>a<p>b</div></span>")[0] == "a\n\nb"


def test_density_selects_the_content():
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>menu entry {i}</a></li>" for i in range(30)) + "</ul></div>"
    body = "<div><p>" + "A long paragraph of real text without links. " * 20 + "</p><p>" + "Another one. " * 20 + "</p></div>"
    clean = m.convert(menu + body)[0]
    assert "menu entry" not in clean and "A long paragraph" in clean and "Another one" in clean
    best, threshold = m.content(m.parse(menu + body))
    assert best.name in ("div", "body") and threshold > 0


def test_code_formulas_and_remarks_are_content():
    para = "<p>" + "A long paragraph of real text without links. " * 30 + "</p>"
    code = "".join(f"call_{i}(x)\n" for i in range(300))
    link = "<a href='/y'>the whole source code</a>"
    held = {
        f"<div>{link}<pre>{code}</pre></div>": "call_299(x)",
        f"<div>{link} $x_1$</div>": "$x_1$",
        "<div><a href='/y'>see the docs of <code>run_all</code></a></div>": "run_all",
        "<ul>" + "".join(f"<li><a href='/{i}'>the entry with number {i}</a> is fine</li>" for i in range(20)) + "</ul>": "is fine",
    }
    for block, part in held.items():
        assert part in m.convert(f"<div>{para}{para}</div>{block}")[0]
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>menu entry {i}</a>&nbsp;|</li>" for i in range(30)) + "</ul>"
    assert "menu entry" not in m.convert(f"<div>{para}{para}</div>{menu}")[0]


def test_planted_furniture():
    """Articles set in pages with menus, side lists and footers of links: just the article comes out; as fragments they come out whole."""
    rnd = random.Random(12)
    links = lambda n: "".join(f"<li><a href='/p{i}'>{rnd.choice(['Home', 'Docs', 'News of the week', 'About us', 'Log in'])} {i}</a></li>" for i in range(n))
    removed = 0
    for _ in range(40):
        paras = [" ".join(f"word{rnd.randrange(500)}" for _ in range(rnd.randint(40, 120))) for _ in range(rnd.randint(2, 6))]
        article = "<div id='main'><h1>The title</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "<p>See <a href='/more'>more on it</a>.</p></div>"
        page = f"<nav><ul>{links(rnd.randint(4, 20))}</ul></nav><div>{article}<aside><ul>{links(rnd.randint(3, 12))}</ul></aside></div><footer><div>{''.join(f'<a href=/f{i}>Foot {i}</a>' for i in range(rnd.randint(2, 9)))}</div></footer>"
        clean, alone = m.convert(page)[0], m.convert(article)[0]
        assert all(p in clean for p in paras) and "# The title" in clean and "more on it (/more)" in clean
        assert clean == alone
        removed += 1
    assert removed == 40


def test_density_by_its_formula():
    import math

    root = m.parse("<div><p>" + "x" * 100 + "</p><p>" + "y" * 50 + "<a href='/z'>" + "z" * 20 + "</a></p></div>")
    m.measure(root)
    first, second = root.parts[0].parts
    share = 20 / 170
    want = lambda c, t, lc, lt: c / t * math.log(c / max(lc, 1) * t / lt) / math.log(math.log(c / (c - lc) * lc + share * c + math.e))
    assert first.density == pytest.approx(want(100, 1, 0, 1)) and second.density == pytest.approx(want(70, 1, 20, 1)) and first.density > second.density
    plain = m.parse("<div><p>" + "x" * 100 + "</p></div>")
    m.measure(plain)
    assert plain.parts[0].density == 100 and plain.parts[0].parts[0].density == 100


def test_depth_is_no_limit():
    clean = m.convert("<ul><li>a" * 3000 + "deepest")[0]
    assert clean.endswith("deepest") and clean.count("- a") == 3000
    assert m.convert("<div>" * 50_000 + "x</i>" + "</div>" * 50_000)[0] == "x"


def test_rows(rows):
    data = [(1, None, "<b>x</b>"), (1, None, "<b>x</b>"), (2, None, None), (3, None, " "), (4, None, "<i>" * 3000 + "deep"), (5, None, "`" * 5000 + "*" * 5000 + "[" * 2000), (6, None, "<p>y</p>" * 20_000)]
    r = rows(data, text="body")
    assert {(x.number, x.kind) for x in m.kinds_found(r, "number", "body").collect()} >= {(1, "html"), (4, "html"), (6, "html")}
    clean = {x.number: x.clean for x in m.clean_rows(r, "number", "body").collect()}
    assert clean[2] is None and clean[3] == "" and clean[1] == "x" and clean[4].endswith("deep")
    assert m.kinds_found(rows([], text="body"), "number", "body").count() == 0
