"""Markup residue: HTML, Markdown, wiki and LaTeX to plain text that keeps headings, lists, tables, code and formulas.

A document is read into a tree. Its paragraphs pass points for length and commas to their parent and, halved, to the
parent above; a container's points are discounted by the share of its characters that are link text. The best container
is kept with those siblings that aren't mostly links, and the kept part is written as plain text: a heading stands on
its own line, a list item begins with a bullet, table cells are parted by tabs, code is indented, formulas are spelled in
Unicode.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.session import read, read_wide

# Elements of HTML.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "div", "dl", "dd", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "figure"}
INLINE = {"a", "abbr", "b", "big", "cite", "code", "del", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ref", "nowiki", "s", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "var", "head", "title", "button"}
VOID = {"br", "hr", "img", "wbr", "meta", "link", "input", "col"}
SKIPPED = {"script", "style"}
#: An opening tag ends an open element of these kinds.
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
TAG = re.compile(rf"<!--.*?(?:-->|$)|<(/?)({'|'.join(sorted(BLOCKS | INLINE | VOID | SKIPPED, key=len, reverse=True))})((?:\s+[A-Za-z:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*)\s*/?>|<![A-Za-z][^>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

# TeX commands and the signs they stand for.
SIGNS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "varphi": "φ", "phi": "φ", "psi": "ψ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "sum": "Σ",
    "geqslant": "≥", "geq": "≥", "ge": "≥", "leqslant": "≤", "leq": "≤", "le": "≤", "neq": "≠", "approx": "≈", "times": "×", "cdot": "·", "pm": "±", "div": "÷", "infty": "∞", "circ": "°", "sim": "～", "to": "→", "quad": " ", "qquad": " ", "ldots": "…", "cdots": "…", "degree": "°", "left": "", "right": "", "noindent": "", "par": "\n", "newline": "\n", "hline": "", "centering": "", "displaystyle": "",
}
ARGUMENT = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
FRACTION = re.compile(rf"\\[dt]?frac\s*{ARGUMENT}\s*{ARGUMENT}")
HEADING_COMMAND = re.compile(rf"\\(?:chapter|(?:sub){{0,2}}section|(?:sub)?paragraph)\*?{ARGUMENT}")
WRAPPER = re.compile(rf"\\(?:text(?:bf|it|tt|rm|sf|sc)?|emph|underline|math(?:rm|bf|it|cal|bb)|operatorname|mbox|title|caption|bm|boldsymbol)\s*{ARGUMENT}")
REFERENCE = re.compile(rf"\\(?:cite[pt]?|ref|eqref|label|footnote|url)\s*(?:\[[^\]]*\])?{ARGUMENT}")
ENVIRONMENT = re.compile(r"\\(begin|end)\s*\{([A-Za-z]+\*?)\}(?:\{[^{}]*\})?")
COMMAND = re.compile(r"\\([A-Za-z]+)\*?")
#: A formula set apart has at most so many characters, or texts of opening signs alone would take squared time.
FORMULA = re.compile(r"\$\$(.{1,4000}?)\$\$|\\\[(.{1,4000}?)\\\]|\\\((.{1,4000}?)\\\)|(?<!\$)\$(?!\s*\$)([^$\n]*[\d\\A-Za-z][^$\n]*)\$", re.S)
FENCE = re.compile(r"^ {0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^ {0,3}\1[ \t]*$|\Z)", re.S | re.M)
WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.S | re.M)
RULE_ROW = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
PAGE = re.compile(r"^\s*[-–—*]\s*\d+\s*[-–—*]?\s*$")


#: A block beside the way to the best container is dropped if more than this share of it is link text and its points are
#: under this share of the container's.
LINKED, SIBLING = 0.5, 0.2


@dataclass
class Node:
    """An element, with text and elements in it. Nodes stand in a list in document order, so parents come before children."""

    tag: str
    parent: int
    children: list = field(default_factory=list)  # texts, and numbers of nodes
    points: float = 0.0
    size: int = 0  # characters in it
    linked: int = 0  # those of them that are link text
    dropped: bool = False

    def link_density(self) -> float:
        return self.linked / max(1, self.size)

    def rated(self) -> float:
        return self.points * (1 - self.link_density())


def formula(tex: str) -> str:
    """A formula spelled in Unicode."""
    for _ in range(4):
        tex, n = FRACTION.subn(r"(\1)/(\2)", tex)
        tex, m = WRAPPER.subn(r"\1", tex)
        if not n + m:
            break
    tex = re.sub(r"\^\s*\{\s*\\circ\s*\}|\^\\circ", "°", tex)
    tex = re.sub(r"(?<=[A-Za-z}])\^\s*\{?\s*([23])\s*\}?", lambda m: "²³"[int(m[1]) - 2], tex)
    tex = re.sub(r"\\[,;:! ]|~", " ", tex).replace("\\%", "%").replace("\\_", "_").replace("\\\\", "\n")
    tex = COMMAND.sub(lambda m: SIGNS.get(m[1], m[1]), tex)
    return re.sub(r"\s+", " ", re.sub(r"[{}]", "", tex).replace("\\", "")).strip()


def _tree(text: str, kinds: set[str]) -> list[Node]:
    nodes = [Node("root", -1)]
    stack, at = [0], 0
    opened: dict[str, int] = {}

    def put(piece: str) -> None:
        if ENTITY.search(piece):
            decoded = ENTITY.sub(lambda m: html.unescape(m[0]).replace("\xa0", " ").replace("\u2002", " "), piece)
            if decoded != piece:
                kinds.add("html")
            piece = decoded
        if piece:
            nodes[stack[-1]].children.append(piece)

    def close() -> str:
        tag = nodes[stack.pop()].tag
        opened[tag] -= 1
        return tag

    for match in TAG.finditer(text):
        put(text[at : match.start()])
        at = match.end()
        kinds.add("html")
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                nodes[stack[-1]].children.append("\n")
        elif match[1]:
            if opened.get(tag):
                while close() != tag:
                    pass
        else:
            while nodes[stack[-1]].tag in ENDS.get(tag, ()):
                close()
            nodes[stack[-1]].children.append(len(nodes))
            nodes.append(Node(tag, stack[-1]))
            if not match[0].endswith("/>"):
                stack.append(len(nodes) - 1)
                opened[tag] = opened.get(tag, 0) + 1
    put(text[at:])
    return nodes


def _score(nodes: list[Node]) -> None:
    """Sizes, link text and points of all nodes: paragraphs pass points to their node and, halved, to its parent."""
    for node in reversed(nodes):
        own = 0.0
        for child in node.children:
            if isinstance(child, str):
                node.size += len(child)
                for paragraph in child.split("\n"):
                    if len(paragraph.strip()) >= 2:
                        own += 1 + sum(map(paragraph.count, ",，、")) + min(3, len(paragraph) / 100)
        node.points += own
        if node.tag == "a":
            node.linked = node.size
        if node.parent >= 0:
            parent = nodes[node.parent]
            parent.points += own / 2
            parent.size += node.size
            parent.linked += node.linked


def _drop_link_blocks(nodes: list[Node]) -> None:
    """The best container is kept with its siblings and those of its ancestors that hold text of their own."""
    _score(nodes)
    blocks = [k for k, n in enumerate(nodes) if n.tag in BLOCKS or n.tag == "root"]
    best = max(blocks, key=lambda k: nodes[k].rated())
    least = SIBLING * nodes[best].rated()
    inside = best
    while (at := nodes[inside].parent) >= 0:
        for child in nodes[at].children:
            if child != inside and not isinstance(child, str) and nodes[child].tag not in INLINE:
                sibling = nodes[child]
                sibling.dropped = sibling.link_density() > LINKED and sibling.rated() < least
        inside = at


def _inline(line: str, kinds: set[str]) -> str:
    """Inline Markdown and wiki signs of a line."""

    def use(kind: str, pattern: str, by, text: str) -> str:
        text, n = re.subn(pattern, by, text)
        if n:
            kinds.add(kind)
        return text

    if "`" in line:
        line = use("markdown", r"(`+)([^`\n]+)\1", r"\2", line)
    if "[" in line:
        line = use("wiki", r"\[\[(?:文件|File|Image|图像|图片|Category|分类)[:：][^\[\]]*?(?:\|([^\[\]|]*))?\]\]", lambda m: f"（{m[1]}）" if m[1] else "", line)
        line = use("wiki", r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", line)
        line = use("wiki", r"\[https?://\S+ ([^\]]+)\]", r"\1", line)
        line = use("markdown", r"!\[([^\[\]]*)\]\([^()\n]*\)", r"\1", line)
        line = use("markdown", r"\[([^\[\]]*)\]\([^()\n]*\)", r"\1", line)
        line = use("markdown", r"\[\^[^\]\s]+\]:?", "", line)
    if "{{" in line:
        line = use("wiki", r"\{\{([^{}|]*)((?:\|[^{}]*)?)\}\}", lambda m: f"（{m[2][1:]}）" if m[2] else "", line)
    if "''" in line:
        line = use("wiki", r"'{2,5}([^'\n]+)'{2,5}", r"\1", line)
    if "*" in line:
        line = use("markdown", r"\*\*\*([^*\n]+)\*\*\*|\*\*([^*\n]+)\*\*", lambda m: m[1] or m[2], line)
        line = use("markdown", r"(?<![\d*A-Za-z)])\*(?![\s*\d])([^*\n]+?)(?<![\s*])\*(?![\d*A-Za-z(])", r"\1", line)
    if "__" in line:
        line = use("markdown", r"(?<![A-Za-z0-9_])__([^_\n]+)__(?![A-Za-z0-9_])", r"\1", line)
    if "~~" in line:
        line = use("markdown", r"~~([^~\n]+)~~", r"\1", line)
    return line


def _tables(text: str, kinds: set[str], keep) -> str:
    """Wiki and Markdown tables as rows of cells parted by tabs."""

    def wiki(match: re.Match) -> str:
        kinds.add("wiki")
        rows: list[list[str]] = [[]]
        for line in match[0].split("\n")[1:]:
            if line.startswith("|-"):
                rows.append([])
            elif line.startswith(("|+", "|}")):
                rows[-1] += [line[2:].strip()] if line.startswith("|+") else []
            elif line.startswith(("|", "!")):
                rows[-1] += [_inline(c.rpartition("|")[2] if "=" in c.partition("|")[0] else c, kinds).strip() for c in re.split(r"\|\||!!", line[1:])]
        return keep("\n".join("\t".join(r) for r in rows if any(r)))

    text = WIKI_TABLE.sub(wiki, text)
    lines, out, k = text.split("\n"), [], 0
    while k < len(lines):
        if k + 1 < len(lines) and "|" in lines[k] and "|" in lines[k + 1] and RULE_ROW.match(lines[k + 1]):
            kinds.add("markdown")
            rows = [lines[k]]
            k += 2
            while k < len(lines) and lines[k].lstrip().startswith("|"):
                rows.append(lines[k])
                k += 1
            out.append(keep("\n".join("\t".join(_inline(c, kinds).strip() for c in r.strip().strip("|").split("|")) for r in rows)))
        else:
            out.append(lines[k])
            k += 1
    return "\n".join(out)


def _plain(text: str, kinds: set[str]) -> str:
    """A stretch of text without Markdown, wiki and LaTeX signs; what must not be read again is kept aside."""
    aside: list[str] = []

    def keep(piece: str) -> str:
        aside.append(piece)
        return f"\ue000{len(aside) - 1}\ue001"

    if "```" in text or "~~~" in text:

        def code(match: re.Match) -> str:
            kinds.add("markdown")
            return keep("\n".join("    " + x for x in match[2].rstrip("\n").split("\n")))

        text = FENCE.sub(code, text)
    if "$" in text or "\\" in text:

        def spell(match: re.Match) -> str:
            kinds.add("latex")
            spelled = formula(next(g for g in match.groups() if g))
            return keep(f"\n{spelled}\n" if match[1] or match[2] else spelled)

        text = FORMULA.sub(spell, text)
    if "\\" in text:
        text, n1 = HEADING_COMMAND.subn(r"\n\1\n", text)
        text, n2 = ENVIRONMENT.subn("\n", text)
        text, n3 = re.subn(r"\\item(?![A-Za-z])\s*(?:\[[^\]]*\])?", "\n• ", text)
        text, n4 = REFERENCE.subn(lambda m: f"[{m[1]}]", text)
        n5 = 0
        for _ in range(4):
            text, n = WRAPPER.subn(r"\1", text)
            n5 += n
            if not n:
                break
        text, n6 = COMMAND.subn(lambda m: SIGNS.get(m[1], m[0]), text)
        if n1 + n2 + n3 + n4 + n5 + n6:
            kinds.add("latex")
    if "|" in text:
        text = _tables(text, kinds, keep)
    out = []
    for line in text.split("\n"):
        if line.startswith("="):
            heading = re.match(r"^(={2,6})\s*(.+?)\s*\1\s*$", line)
            if heading:
                kinds.add("wiki")
                line = heading[2]
        if line.lstrip()[:1] in ("#", ">", "-", "+", "*") and not PAGE.match(line):
            heading = re.match(r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", line)
            item = re.match(r"^\s*[-+*]\s+(\S.*)$", line)
            quote = re.match(r"^\s{0,3}(?:>\s?)+(.*)$", line)
            if re.match(r"^\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,})$", line):
                kinds.add("markdown")
                line = ""
            elif heading or item or quote:
                kinds.add("markdown")
                line = heading[1] if heading else f"• {item[1]}" if item else quote[1]
        out.append(_inline(line, kinds))
    text = "\n".join(out)
    while "\ue000" in text:
        text = re.sub("\ue000(\\d+)\ue001", lambda m: aside[int(m[1])], text)
    return text


def _write(nodes: list[Node], kinds: set[str]) -> str:
    """The plain text of the tree, children before parents; inline elements go into the text they stand in."""
    done = [""] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        raw = node.tag == "pre" or node.tag in INLINE
        if raw:  # the text itself; raised figures keep their meaning
            text = "".join(c if isinstance(c, str) else done[c] for c in node.children)
            done[k] = {"2": "²", "3": "³"}.get(text, text) if node.tag == "sup" else text
            continue
        parts: list[str] = []
        run: list[str] = []
        for child in (*node.children, None):
            if isinstance(child, str):
                run.append(child)
                continue
            if child is not None and nodes[child].tag in INLINE:
                run.append(done[child])
                continue
            if run:
                parts.append(_plain("".join(run), kinds))
                run.clear()
            if child is None or nodes[child].dropped or nodes[child].tag in SKIPPED:
                continue
            tag, body = nodes[child].tag, done[child]
            if node.tag == "tr":
                parts.append(("\t" if parts else "") + body.strip())
            elif len(node.children) == 1 and tag not in ("li", "pre"):
                parts.append(body)  # without a copy a level
            elif tag == "li":
                parts.append(f"\n• {body}\n")
            elif tag == "pre":
                parts.append("\n" + "\n".join("    " + x for x in body.strip("\n").split("\n")) + "\n")
            else:
                parts.append(f"\n{body}\n")
        done[k] = (parts[0] if len(parts) == 1 else "".join(parts)).strip("\n") if k else "".join(parts)
    return done[0]


def clean_markup(text: str | None) -> tuple[str | None, list[str]]:
    """Plain text and the kinds of markup that were in it; null for null.

    Nesting may be of any depth. Two private-use characters that mark kept pieces inside are taken out of the text.
    """
    if text is None:
        return None, []
    if not re.search(r"[<&`*#>\[{$\\|=~+_'-]", text):
        return text, []
    kinds: set[str] = set()
    nodes = _tree(text.replace("\ue000", "").replace("\ue001", ""), kinds)
    if len(nodes) > 1:
        _drop_link_blocks(nodes)
    plain = _write(nodes, kinds)
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", plain)).strip("\n"), sorted(kinds)


def remove_markup(rows: DataFrame) -> DataFrame:
    """(rec_id, text) -> rec_id, text, kinds: every row gives one, null and empty texts come back as they are.

    Whole texts are parsed record by record; there is no shuffle.
    """

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [clean_markup(t) for t in batch["text"]]
            yield pd.DataFrame({"rec_id": batch["rec_id"], "text": [d[0] for d in done], "kinds": [d[1] for d in done]})

    return rows.select("rec_id", "text").mapInPandas(clean, "rec_id bigint, text string, kinds array<string>")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of every clause record; a record delivered twice counts once."""
    rows = read_wide(spark, sf_dir, "read_clause_full").select("rec_id", F.col("clause_text").alias("text"))
    return remove_markup(rows.dropDuplicates(["rec_id"]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and the kinds of markup residue in them."""
    rows = read_wide(spark, sf_dir, "read_clause_full").select("rec_id", F.col("clause_text").alias("text"))
    return remove_markup(rows).select("rec_id", F.explode("kinds").alias("kind")).distinct()


QUERIES = {"p2_clean": p2_clean, "p2_found": p2_found}
ORACLES: dict[str, str] = {}
