"""The block structure of a markdown text as a tree of nodes with offsets.

One pass over the lines with a stack of open containers. A line first meets the containers that are open: a quote wants its
mark, a list item its indentation. What is left may open further containers, a leaf, or go on with the open leaf; a line of plain
text goes on with a paragraph even where it lacks the marks of the containers around it. Nodes come in document order with
parent and depth, so Spark's array functions can count, nest and cut by them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How blocks begin.
FENCE = re.compile(r"(`{3,}(?=[^`]*\Z)|~{3,})")
HEADING = re.compile(r"(#{1,6})(?:[ \t]|\Z)")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*\Z")
ITEM = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|\Z)")
TABLE_LINE = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
MATH = re.compile(r"\$\$|\\begin\{((?:equation|align|gather|multline|eqnarray|flalign|alignat)\*?)\}")
HTML = re.compile(r"(?:<!--|</?[A-Za-z][A-Za-z0-9-]*(?:[ \t][^<>]*)?/?>[ \t]*\Z)")
#: Containers within containers; marks beyond that are text.
NESTING = 20


class Line:
    """A line without its end, and how far it has been read; a tab reaches to the next column that is a multiple of four."""

    def __init__(self, text: str):
        self.text, self.at, self.column, self.spare = text, 0, 0, 0

    def indent(self) -> tuple[int, int]:
        """Columns of white space ahead, and where the rest begins."""
        width, column, i = self.spare, self.column, self.at
        while i < len(self.text) and self.text[i] in " \t":
            step = 4 - column % 4 if self.text[i] == "\t" else 1
            width, column, i = width + step, column + step, i + 1
        return width, i

    def skip(self, columns: int) -> None:
        """Read so many columns of white space, or as many as there are."""
        own = min(columns, self.spare)
        self.spare, columns = self.spare - own, columns - own
        while columns > 0 and self.at < len(self.text) and self.text[self.at] in " \t":
            step = 4 - self.column % 4 if self.text[self.at] == "\t" else 1
            self.at, self.column, self.spare, columns = self.at + 1, self.column + step, max(0, step - columns), columns - step

    def take(self, n: int) -> None:
        """Read n characters that aren't white space, and what is before them."""
        _, i = self.indent()
        self.column, self.at, self.spare = self.column + i + n - self.at, i + n, 0


class Tree:
    """Nodes ``[kind, parent, depth, start, end, level]`` and what is open while lines come in."""

    def __init__(self, text: str = ""):
        self.text, self.last = text, {}
        self.nodes: list[list] = []
        self.blank_from = -1  # where the line begins, if blank lines are before it
        self.open: list[dict] = []  # quotes, lists and items, outermost first
        self.leaf: dict | None = None

    def closes_later(self, mark: str, at: int) -> bool:
        """Whether a block of mathematics that is open before ``at`` ends: dollars at the end of a line, or the environment's end."""
        if mark not in self.last:
            ends = [m.start() for m in re.finditer(r"\$\$(?=[ \t\r]*(?:\n|\Z))", self.text)] if mark == "$$" else [self.text.rfind(mark)]
            self.last[mark] = ends[-1] if ends else -1
        return self.last[mark] >= at

    def add(self, kind: str, start: int, end: int, level: int = 0) -> int:
        parent = self.open[-1]["node"] if self.open else -1
        depth = (self.nodes[parent][2] if self.open else 0) + (kind in ("list", "quote"))
        self.nodes.append([kind, parent, depth, start, end, level])
        self.reach(end)
        return len(self.nodes) - 1

    def reach(self, end: int) -> None:
        """The open containers go to here."""
        for c in self.open:
            self.nodes[c["node"]][4] = end

    def close(self, keep: int) -> None:
        """Close the containers beyond the first ``keep`` and with them the leaf; lists and items take the blank lines before this one."""
        if keep < len(self.open):
            if self.blank_from >= 0:
                for c in self.open[keep:]:
                    if c["kind"] != "quote":
                        self.nodes[c["node"]][4] = self.blank_from
            del self.open[keep:]
            self.leaf = None

    def begin(self, kind: str, start: int, end: int, **how) -> None:
        self.leaf = {"kind": kind, "node": self.add(kind, start, end, how.pop("level", 0)), "lines": 1, **how}

    def go_on(self, end: int) -> None:
        self.nodes[self.leaf["node"]][4] = end
        self.leaf["lines"] += 1
        self.reach(end)


def _matched(tree: Tree, line: Line) -> int:
    """How many of the open containers the line goes on with; their marks are read."""
    for n, c in enumerate(tree.open):
        width, i = line.indent()
        blank = i == len(line.text)
        if c["kind"] == "quote":
            if blank or width > 3 or line.text[i] != ">":
                return n
            line.take(1)
            line.skip(1)
        elif c["kind"] == "item":
            if blank and c["empty"]:
                return n  # an item that begins with two blank lines has ended
            if not blank and width < c["indent"]:
                return n
            line.skip(c["indent"])
    return len(tree.open)


def _cells(row: str) -> int:
    return len(re.split(r"(?<!\\)\|", row.strip().strip("|")))


def _opened(tree: Tree, line: Line, matched: int, start: int, end: int) -> tuple[bool, int]:
    """Open a container if the line begins one: (whether, containers that are matched now)."""
    width, i = line.indent()
    if width > 3 or i == len(line.text) or len(tree.open) >= NESTING:
        return False, matched
    if line.text[i] == ">":
        while matched and tree.open[matched - 1]["kind"] == "list":
            matched -= 1
        tree.close(matched)
        tree.leaf = None
        tree.open.append({"kind": "quote", "node": tree.add("quote", start, end)})
        line.take(1)
        line.skip(1)
        return True, len(tree.open)
    mark = ITEM.match(line.text, i)
    if not mark or RULE.match(line.text, i):
        return False, matched
    rest = line.text[mark.end() :]
    running = tree.leaf is not None and tree.leaf["kind"] == "paragraph" and not (tree.open[matched:] and tree.open[matched]["kind"] == "item")
    if running and matched == len(tree.open) and (not rest.strip() or mark[2] not in (None, "1")):
        return False, matched  # doesn't interrupt a paragraph
    sort = mark[1] or mark[3]
    # the item of a list that is open ends; one of another sort begins a new list
    keep = matched
    while keep and tree.open[keep - 1]["kind"] == "list":
        keep -= 1
    if keep < len(tree.open) and tree.open[keep]["kind"] == "list" and tree.open[keep]["sort"] == sort:
        tree.close(keep + 1)
    else:
        tree.close(keep)
        tree.open.append({"kind": "list", "sort": sort, "node": tree.add("list", start, end, 1 if mark[2] else 0)})
    tree.leaf = None
    node = tree.add("item", start, end)
    line.take(mark.end() - mark.start())
    after, j = line.indent()
    wide = 1 if j == len(line.text) or after > 4 else after
    line.skip(wide)
    tree.open.append({"kind": "item", "node": node, "indent": width + mark.end() - mark.start() + wide, "empty": j == len(line.text)})
    return True, len(tree.open)


def _leaf(tree: Tree, line: Line, start: int, end: int) -> None:
    """A line that opens no further container, with all open ones matched."""
    width, i = line.indent()
    rest, leaf = line.text[i:], tree.leaf
    running = leaf is not None and leaf["kind"] == "paragraph"
    if width > 3 and not running:
        if leaf is not None and leaf["kind"] == "code" and not leaf.get("fence"):
            tree.go_on(end)
        else:
            tree.begin("code", start, end)
        return
    if running and width <= 3:
        if (under := UNDERLINE.match(rest)) and leaf["lines"] >= 1:
            tree.go_on(end)
            tree.nodes[leaf["node"]][0], tree.nodes[leaf["node"]][5] = "heading", 1 if under[1][0] == "=" else 2
            tree.leaf = None
            return
        if leaf["lines"] == 1 and ("|" in rest or "|" in leaf["last"]) and TABLE_LINE.match(rest) and _cells(rest) == _cells(leaf["last"]):
            tree.go_on(end)
            tree.nodes[leaf["node"]][0], leaf["kind"] = "table", "table"
            return
    if width <= 3:
        if (mark := HEADING.match(rest)) is not None:
            tree.begin("heading", start, end, level=len(mark[1]))
            tree.leaf = None
            return
        if (mark := FENCE.match(rest)) is not None:
            tree.begin("code", start, end, fence=mark[1])
            return
        if RULE.match(rest):
            tree.begin("rule", start, end)
            tree.leaf = None
            return
        if (mark := MATH.match(rest)) is not None:
            close = f"\\end{{{mark[1]}}}" if mark[1] else "$$"
            here = close in rest[mark.end() :] if mark[1] else len(rest.strip()) > 3 and rest.rstrip().endswith("$$")
            if here or tree.closes_later(close, end):
                tree.begin("math", start, end, until=close)
                if here:
                    tree.leaf = None
                return
        if HTML.match(rest) and (rest.startswith("<!--") or not running):
            tree.begin("html", start, end, until="-->" if rest.startswith("<!--") else None)
            if rest.startswith("<!--") and "-->" in rest:
                tree.leaf = None
            return
    if leaf is not None and (running or leaf["kind"] == "table" or leaf["kind"] == "html"):
        tree.go_on(end)
        leaf["last"] = rest
    else:
        tree.begin("paragraph", start, end, last=rest)


def parse_blocks(text: str) -> list[list]:
    """``[kind, parent, depth, start, end, level]`` of every node in document order; parent -1 for those at the top, depth counting
    lists and quotes around a node, itself included.

    Kinds are paragraph, heading (with its level), code, math, table, html, rule, quote, list (level 1 if numbered) and item. A
    node begins at the start of its first line, or at its item's mark or the content after the marks, and ends after the line end of its last
    line; a list that something follows takes the blank lines after it. Blank text has no nodes.
    """
    tree, at, pending = Tree(text), 0, 0
    for raw in text.split("\n"):
        start, end = at, min(len(text), at + len(raw) + 1)
        at = end
        line = Line(raw.rstrip("\r"))
        tree.blank_from = start if pending == start else -1
        matched = _matched(tree, line)
        leaf = tree.leaf
        if leaf is not None and matched == len(tree.open) and (leaf.get("fence") or leaf.get("until")):
            width, i = line.indent()
            rest = line.text[i:].rstrip(" \t")
            tree.go_on(end)
            mark = leaf.get("fence")
            if (mark and width <= 3 and len(rest) >= len(mark) and set(rest) == {mark[0]}) or (not mark and (rest.endswith("$$") if leaf["until"] == "$$" else leaf["until"] in rest)):
                tree.leaf = None
            continue
        while True:
            begun, matched = _opened(tree, line, matched, start + line.indent()[1] if line.at else start, end)
            if not begun:
                break
        width, i = line.indent()
        if i == len(line.text):
            if tree.open and tree.open[-1]["kind"] == "item" and matched == len(tree.open) and tree.nodes[-1][0] != "item":
                tree.open[-1]["empty"] = False
            marked = max((k for k in range(matched) if tree.open[k]["kind"] == "quote"), default=-1)
            for c in tree.open[: marked + 1]:
                tree.nodes[c["node"]][4] = end  # a quote's mark without text
            # quotes end with a blank line, as do items that begin with two; other items wait for what follows
            while matched < len(tree.open) and tree.open[matched]["kind"] != "quote" and not tree.open[matched].get("empty"):
                matched += 1
            while 0 < matched < len(tree.open) and tree.open[matched - 1]["kind"] == "list" and tree.open[matched].get("empty"):
                matched -= 1
            tree.close(matched)
            if tree.leaf is not None and not (tree.leaf["kind"] == "code" and not tree.leaf.get("fence")):
                tree.leaf = None
            pending = end
            continue
        if matched < len(tree.open) and tree.leaf is not None and tree.leaf["kind"] == "paragraph" and not _begins(line):
            tree.go_on(end)  # plain text goes on with the paragraph
            tree.leaf["last"] = line.text[i:]
            continue
        if matched < len(tree.open):
            while matched and tree.open[matched - 1]["kind"] == "list":
                matched -= 1
        tree.close(matched)
        for c in tree.open:
            if c["kind"] == "item":
                c["empty"] = False
        _leaf(tree, line, start + i if line.at else start, end)
    return tree.nodes


def _begins(line: Line) -> bool:
    """Whether what is left of a line can't be plain text of a paragraph."""
    width, i = line.indent()
    rest = line.text[i:]
    return width <= 3 and any(p.match(rest) for p in (HEADING, FENCE, RULE, MATH)) or width <= 3 and rest.startswith("<!--")


NODE = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("parent", "depth", "start", "end", "level")]])


@F.pandas_udf(T.ArrayType(NODE))
def block_nodes(text: pd.Series) -> pd.Series:
    """:func:`parse_blocks` in the row; none for null."""
    names = NODE.fieldNames()
    return text.map(lambda t: [dict(zip(names, n, strict=True)) for n in parse_blocks(t or "")])


def structure(nodes: Column) -> Column:
    """What a translation should keep of a unit's blocks: items, the deepest nesting of lists and quotes, the level of the first heading (0 for none)."""
    headings = F.transform(F.filter(nodes, lambda n: n["kind"] == "heading"), lambda n: n["level"])
    return F.struct(
        F.size(F.filter(nodes, lambda n: n["kind"] == "item")).alias("bullets"),
        F.coalesce(F.array_max(F.transform(nodes, lambda n: n["depth"])), F.lit(0)).alias("depth"),
        F.coalesce(F.get(headings, F.lit(0)), F.lit(0)).alias("heading"),
    )
