"""Problem 1: texts in HTML, Markdown, wiki and LaTeX markup as clean, structured text.

Conversion of one text, in order:

1. Code is set aside whole, with the kind its marks belong to, so nothing inside it is read
   as markup.
2. HTML tags are parsed into a tree. Every node gets its composite text density,
   ``C/T log((C/LC) (T/LT)) / log(log(LC C/(C-LC) + C LCb/Cb + e))`` for its characters C and
   tags T, those in links LC and LT, and the body's Cb and LCb; without any link in the body,
   where that base is 1, it is C/T. The node whose children's densities sum highest is the
   content, and the least density on its path from the body is the threshold: nodes outside
   the content and under it that hold links only are page furniture and left out. A posted
   text is a fragment, so a node with text outside links, code or formulas stays. What is
   set aside counts with its own length.
3. Headings, lists, tables, quotes and formulas of every kind come out in one notation:
   ``# heading``, ``- item``, ``| cell |``, ``> quote``, ``$formula$``, fenced code.

Each construct met is noted under the kind it is peculiar to; bullets and quotes that
several kinds share are noted under none.

A null text gives null and no kinds, a blank text itself. Unclosed code reaches to the end,
unclosed tags to the end of their parent, however deep they are nested; lists are indented
for their first ``INDENTED`` levels. ``clean_rows`` has a row for each row it is given.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
#: Element names that count as markup, those that stand alone, and those that break a line.
INLINE = "a abbr b bdi big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup tt u var wbr"
BLOCK = "address article aside blockquote body br caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe input label li link main meta nav ol p picture pre script section select source style summary table tbody td tfoot th thead title tr ul video"
VOID = frozenset("br hr img input link meta source wbr".split())
BREAKS = frozenset(BLOCK.split()) - {"td", "th", "caption"}
NESTS = frozenset("blockquote div details figure ol section table ul".split())

OPEN, CLOSE = "\ue000", "\ue001"
CODE = re.compile(
    r"""
    ^[ ]{0,3}(?:>[ ]?)*(?:[-*+][ ]+|\d+[.)][ ]+)?(?P<fence>`{3,}|~{3,})[ ]*(?P<lang>[^\n`]*)(?P<fenced>\n.*?)(?:^[ ]*(?:>[ ]?)*(?P=fence)[`~]*[ \t\r]*$|\Z)
    |\{\{\{(?P<trac>.*?)(?:\}\}\}|\Z)
    |\{\{(?:code|source|syntaxhighlight)\|(?P<template>.*?)(?:^[ ]*\}\}|\}\}[ \t\r]*$|\Z)
    |\\begin\{(?P<env>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*(?P<verbatim>.*?)(?:\\end\{(?P=env)\}|\Z)
    |\\verb(?P<bar>[|!+])(?P<verb>[^\n]*?)(?P=bar)
    |(?i:<(?P<tag>pre|script|style|textarea|code|samp|tt)(?:\s[^<>]*)?>)(?P<element>.*?)(?:(?i:</(?P=tag)\s*>)|\Z)
    |(?P<tick>(?<!`)`{1,2}(?!`))(?P<span>(?:[^`\n]|(?!(?P=tick)(?!`))`)+)(?P=tick)(?!`)
    """,
    re.M | re.S | re.X,
)
TAG = re.compile(rf"<(?P<close>/?)(?P<name>(?i:{'|'.join(sorted((INLINE + ' ' + BLOCK).split(), key=len, reverse=True))}))(?P<rest>(?:\s[^<>]*)?/?)>|<!--.*?(?:-->|\Z)|<!(?i:doctype)[^>]*>", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
ALT = re.compile(r"""(?i)\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
HREF = re.compile(r"""(?i)\b(?:href|src|alt)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
LATEX_MATH = re.compile(r"\$\$(?P<a>.+?)\$\$|\\\((?P<b>.+?)\\\)|\\\[(?P<c>.+?)\\\]|(?<![\\$\w])\$(?P<d>(?=[^$\n]*(?:\\[a-zA-Z]|[\^_]))[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])|\\begin\{(?P<env>equation|align|gather|math|displaymath|eqnarray)(?P<star>\*?)\}(?P<e>.+?)(?:\\end\{(?P=env)\*?\}|\Z)", re.S)
LATEX_HEAD = re.compile(r"\\(?P<level>(?:sub){0,2}section|chapter|paragraph|subparagraph)\*?\{(?P<text>[^{}\n]*)\}")
LATEX_LINK = re.compile(r"\\href\{(?P<to>[^{}\n]*)\}\{(?P<text>[^{}\n]*)\}|\\url\{(?P<url>[^{}\n]*)\}")
LATEX_ENV = re.compile(r"\\(?P<what>begin|end)\{(?P<env>[a-zA-Z]+\*?)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*")
LATEX_WORD = re.compile(r"\\[a-zA-Z]+\*?\{(?P<text>[^{}\n]*)\}")
LATEX_ITEM = re.compile(r"^([ \t]*)\\item\b[ \t]*(?:\[([^\]\n]*)\])?", re.M)
LATEX_SIGN = re.compile(r"\\([_&%$#{}])")
MD_HEAD = re.compile(r"^ {0,3}(?P<marks>#{1,6})[ \t]+(?P<text>[^\s].*?)[ \t]*#*[ \t\r]*$", re.M)
MD_BOLD = re.compile(r"(?<![*\w\\])(\*\*\*|\*\*)(?=\S)([^*\n]+?)(?<=\S)\1(?!\*)|(?<![_\w\\])__(?=\S)([^_\n]*\s[^_\n]*?)(?<=\S)__(?![_\w])")
MD_EMPH = re.compile(r"(?<![*\w\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![*\w])|(?<![_\w\\/.])_(?=[^\s_])([^_\n]*[^\s_])_(?![_\w])")
MD_STRIKE = re.compile(r"(?<![~\w])~~(?=\S)([^~\n]+?)(?<=\S)~~(?![~\w])")
MD_LINK = re.compile(r"(?P<image>!?)\[(?P<text>[^\[\]\n]*)\]\((?P<to>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"\n]*\")?\)")
MD_REF = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S+.*$", re.M)
MD_TASK = re.compile(r"^(?P<lead>[ \t]*(?:>[ ]?)*[-*+]) \[[ xX]\] ", re.M)
MD_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t\r]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t\r]*$", re.M)
WIKI_HEAD = re.compile(r"^[ \t]*(?P<marks>={1,6})[ \t]*(?P<text>[^=\s](?:[^\n]*?[^=\s])?)[ \t]*(?P=marks)[ \t\r]*$", re.M)
WIKI_BOLD = re.compile(r"(?<!')('{5}|'{3}|'{2})(?!')(?=\S)([^\n]+?)(?<=\S)\1(?!')")
WIKI_LINK = re.compile(r"\[\[(?P<to>[^\[\]|\n]+)(?:\|(?P<text>[^\[\]\n]*))?\]\]|\[(?P<url>https?://[^\s\]|]+)[ |](?P<label>[^\]\n]+)\]")
WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*$(?P<rows>.*?)(?:^[ \t]*\|\}|\Z)", re.M | re.S)
WIKI_ROW = re.compile(r"^[ \t]*\|\|.*\|\|[ \t\r]*$", re.M)
WIKI_MISC = re.compile(r"<(?P<nowiki>nowiki|ref)\b[^>]*>.*?</(?P=nowiki)>|\{\{[A-Za-z][^{}\n]*\}\}(?!\})|^\[\[(?:Category|File|Image):[^\]]*\]\]", re.S | re.M)
HELD = re.compile(f"{OPEN}(\\d+){CLOSE}")
INDENTED = 20
SHUT = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}  # what an element of a kind closes
FURNITURE = frozenset("nav div ul ol section aside footer header menu".split())
LINES = re.compile(r"[ \t]*\n(?:[ \t]*\n)+")


class Node:
    __slots__ = ("name", "rest", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "holds", "plain")

    def __init__(self, name: str, rest: str, parent: Node | None) -> None:
        self.name, self.rest, self.parent, self.parts = name, rest, parent, []


def parse(text: str) -> Node:
    """The tree of a text. Open elements are counted, in all and since the last one that nests, so that no step climbs for an element that is not open."""
    root = node = Node("body", "", None)
    every, since, last = Counter(), [Counter()], 0

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            every[node.name] -= 1
            if node.name in NESTS:
                since.pop()
            else:
                since[-1][node.name] -= 1
            node = node.parent

    for m in TAG.finditer(text):
        if m.start() > last:
            node.parts.append(text[last : m.start()])
        last = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            if every[name] > 0:
                up = node
                while up.name != name or up is root:
                    up = up.parent
                leave(up.parent)
            continue
        for shut in SHUT.get(name, ()):
            while since[-1][shut] > 0:
                up = node
                while up.name != shut:
                    up = up.parent
                leave(up.parent)
        new = Node(name, m["rest"], node)
        node.parts.append(new)
        if name not in VOID and not m["rest"].endswith("/"):
            node = new
            every[name] += 1
            if name in NESTS:
                since.append(Counter())
            else:
                since[-1][name] += 1
    if last < len(text):
        node.parts.append(text[last:])
    return root


def measure(root: Node, codes: Sequence[str] = ()) -> None:
    """Counts of characters, tags, linked characters and links under every node, what it holds, then the composite densities."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.holds = node.plain = False  # what was set aside; that or text outside links
        for p in node.parts:
            if isinstance(p, Node):
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.name == "a")
                node.holds |= p.holds
                node.plain |= p.plain
            else:
                aside = HELD.findall(p)
                node.chars += len(p.strip()) + sum(len(codes[int(n)]) - len(n) - 2 for n in aside)
                node.holds |= bool(aside)
                node.plain |= bool(re.search(r"\w", html.unescape(p)))
        if node.name == "a":
            node.link_chars, node.plain = node.chars, node.holds
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        node.density = c / t
        if root.link_chars and c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density *= math.log(max(c / lc * t / lt, 1.0)) / math.log(base)
        node.total = sum(p.density for p in node.parts if isinstance(p, Node)) or node.density


def content(root: Node, codes: Sequence[str] = ()) -> tuple[Node, float]:
    """The node with the highest density sum, and the least density on its path from the body."""
    measure(root, codes)
    best, stack = root, [root]
    while stack:
        node = stack.pop()
        if node.total > best.total:
            best = node
        stack += [p for p in node.parts if isinstance(p, Node)]
    threshold, up = best.density, best
    while up is not None:
        threshold, up = min(threshold, up.density), up.parent
    return best, threshold


def furniture(node: Node, threshold: float) -> bool:
    """Whether a node outside the content is a menu or a list of links: under the threshold, with several links and nothing else."""
    return node.name in FURNITURE and not node.plain and node.link_tags > 1 and node.density <= threshold


def rendered(root: Node, codes: Sequence[str] = ()) -> str:
    best, threshold = content(root, codes)
    out: list[str] = []
    # what is still to come, last first: text, or a node with its indentation, whether it is in the content, and its number in a list
    ahead: list[str | tuple[Node, int, bool, int]] = []

    def open_(node: Node, deep: int, within: bool) -> None:
        listed, parts = 0, []
        for p in node.parts:
            listed += isinstance(p, Node) and p.name == "li"
            parts.append(p if isinstance(p, str) else (p, deep, within, listed if node.name == "ol" else 0))
        ahead.extend(reversed(parts))

    open_(root, 0, best is root)
    while ahead:
        p = ahead.pop()
        if isinstance(p, str):
            out.append(p)
            continue
        node, deep, within, number = p
        name, within = node.name, within or node is best
        if not within and furniture(node, threshold):
            continue
        before = after = ""
        if name == "br":
            before = "\n"
        elif name == "hr":
            before = "\n---\n"
        elif name == "img":
            alt = ALT.search(node.rest)
            before = f"[image: {next(filter(None, alt.groups()), '')}]" if alt else "[image]"
        elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
            before, after = "\n\n" + "#" * int(name[1]) + " ", "\n\n"
        elif name == "li":
            before = f"\n{'  ' * min(deep, INDENTED)}{f'{number}.' if number else '-'} "
            deep += 1
        elif name == "tr":
            before = "\n|"
        elif name in ("td", "th"):
            before, after = " ", " |"
        elif name == "blockquote":
            before, after = "\n> ", "\n"
        elif name == "a":
            to = HREF.search(node.rest)
            after = f" ({url})" if to and (url := next(filter(None, to.groups()), "")) else ""
        else:
            before = after = "\n\n" if name == "p" else "\n" if name in BREAKS else ""
        out.append(before)
        ahead.append(after)
        open_(node, deep, within)
    return "".join(out)


def convert(text: str) -> tuple[str, list[str]]:
    """The clean text, and the kinds of markup whose own constructs it held."""
    met: set[str] = set()
    codes: list[str] = []

    def aside(m: re.Match) -> str:
        lang = ""
        if (body := m["fenced"]) is not None:
            kind, lang = "markdown", m["lang"].strip()
        elif (body := m["trac"]) is not None or (body := m["template"]) is not None:
            kind = "wiki"
        elif (body := m["verbatim"]) is not None or (body := m["verb"]) is not None:
            kind = "latex"
        elif m["tag"]:
            kind, body = "html", html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", m["element"]))
        else:
            kind, body = "markdown", m["span"]
        met.add(kind)
        if m["tag"] and m["tag"].lower() in ("script", "style"):
            return ""
        if "\n" in body or m["fence"] or m["env"] or (m["tag"] or "").lower() == "pre":
            body = f"\n```{lang}\n{body.strip(chr(10) + chr(13))}\n```\n"
        else:
            body = f"`{body.strip()}`"
        codes.append(body)
        return f"{OPEN}{len(codes) - 1}{CLOSE}"

    def put(pattern: re.Pattern, kind: str | None, new, text: str) -> str:
        text, n = pattern.subn(new, text)
        if n and kind:
            met.add(kind)
        return text

    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(OPEN, "").replace(CLOSE, "")
    if "`" in text or "~~~" in text or "{{" in text or "\\" in text or "<" in text:
        text = CODE.sub(aside, text)
    if "#" in text:
        text = put(MD_HEAD, "markdown", r"\g<marks> \g<text>", text)
    if "$" in text or "\\" in text:

        def formula(m: re.Match) -> str:
            codes.append(f"${next(filter(None, (m[k] for k in 'abcde'))).strip()}$")
            return f"{OPEN}{len(codes) - 1}{CLOSE}"

        text = put(LATEX_MATH, "latex", formula, text)
    if "{|" in text:

        def table(m: re.Match) -> str:
            rows = ["| " + " | ".join(c.strip() for c in re.split(r"\|\||!!|\n[ \t]*[|!]", r.strip().lstrip("|!")) if c.strip()) + " |" for r in re.split(r"^[ \t]*\|-[^\n]*$", m["rows"], flags=re.M) if r.strip()]
            return "\n" + "\n".join(rows) + "\n"

        text = put(WIKI_TABLE, "wiki", table, text)
    if "<" in text and TAG.search(text):
        met.add("html")
        text = rendered(parse(text), codes)
    if "&" in text:
        text = put(ENTITY, "html", lambda m: html.unescape(m[0]), text)
    if "=" in text:
        text = put(WIKI_HEAD, "wiki", lambda m: "#" * len(m["marks"]) + " " + m["text"].strip("' "), text)
    if "''" in text:
        text = put(WIKI_BOLD, "wiki", r"\2", text)
    if "[" in text:
        text = put(WIKI_LINK, "wiki", lambda m: (m["text"] or m["label"] or m["to"]) + f" ({m['to'] or m['url']})", text)
    if "{{" in text:
        text = put(WIKI_MISC, "wiki", "", text)
    if "||" in text:
        text = put(WIKI_ROW, "wiki", lambda m: m[0].replace("||", "|"), text)
    if "\\" in text:
        level = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
        text = put(LATEX_HEAD, "latex", lambda m: "\n" + "#" * level[m["level"]] + f" {m['text']}\n", text)
        text = put(LATEX_LINK, "latex", lambda m: f"{m['text']} ({m['to']})" if m["to"] else m["url"], text)
        if "\\begin{tabular" in text:
            text = re.sub(r"^(.*?)[ \t]*\\\\[ \t]*$", lambda m: "| " + m[1].replace(" & ", " | ") + " |", text, flags=re.M)
        text = put(LATEX_ENV, "latex", lambda m: "\n> " if m["env"] == "quote" and m["what"] == "begin" else "", text)
        text = put(LATEX_ITEM, "latex", lambda m: f"{m[1]}- " + (f"{m[2]} " if m[2] else ""), text)
        text = put(LATEX_WORD, "latex", r"\g<text>", text)
        text = LATEX_SIGN.sub(r"\1", text)
    if "**" in text or "__" in text:
        text = put(MD_BOLD, "markdown", lambda m: m[2] or m[3], text)
    if "](" in text:
        text = put(MD_LINK, "markdown", lambda m: (f"[image: {m['text']}]" if m["image"] else m["text"]) + (f" ({m['to']})" if m["to"] else ""), text)
    if "]:" in text:
        text = put(MD_REF, "markdown", "", text)
    if "[" in text:
        text = put(MD_TASK, "markdown", r"\g<lead> ", text)
    if "--" in text:
        text = put(MD_RULE, "markdown", "", text)
    if "~~" in text:
        text = put(MD_STRIKE, "markdown", r"\1", text)
    if "*" in text or "_" in text:
        text = put(MD_EMPH, "markdown", lambda m: m[1] or m[2], text)
    for _ in range(2):  # code inside a mark that was itself set aside
        text = HELD.sub(lambda m: codes[int(m[1])], text)
    return LINES.sub("\n\n", text).strip(), [k for k in KINDS if k in met]


def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [(None, []) if t is None else convert(t) for t in batch.column(1).to_pylist()]
        clean, kinds = [x[0] for x in done], [x[1] for x in done]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["key", "clean", "kinds"])


def clean_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, clean, kinds`` of every row; one pass, no shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    made = rows.select(key, text).mapInArrow(converted, f"key {kind}, clean string, kinds array<string>")
    return made.withColumnRenamed("key", key)


def kinds_found(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind``, each pair once."""
    return clean_rows(rows, key, text).select(key, F.explode("kinds").alias("kind")).distinct()
