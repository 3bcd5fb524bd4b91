"""Block trees, protected spans and units against properties and worked examples."""

import random
import time

import pytest

from loomfold.operators.blocks import inline_spans, protect, protected_spans, top_blocks
from loomfold.operators.markdown import parse_blocks


def shape(text):
    """The tree as nested text: kind(children...)."""
    nodes = parse_blocks(text)
    children = {}
    for n, node in enumerate(nodes):
        children.setdefault(node[1], []).append(n)

    def show(n):
        inside = ",".join(show(c) for c in children.get(n, []))
        return f"{nodes[n][0]}({inside})" if inside else nodes[n][0]

    return " ".join(show(n) for n in children.get(-1, []))


@pytest.mark.parametrize(("text", "tree"), [
    ("- top\n  - nested\n    - deep\n  - nested\n- top\n", "list(item(paragraph,list(item(paragraph,list(item(paragraph))),item(paragraph))),item(paragraph))"),
    ("> quoted\nlazy\n\nafter\n", "quote(paragraph) paragraph"),
    ("- a\n\n  b\n\n  > q\n  > - x\n- c\n\nd\n", "list(item(paragraph,paragraph,quote(paragraph,list(item(paragraph)))),item(paragraph)) paragraph"),
    ("1. a\n2. b\n\n- c\n* d\n", "list(item(paragraph),item(paragraph)) list(item(paragraph)) list(item(paragraph))"),
    ("Para\n===\ntext\n- item\n", "heading paragraph list(item(paragraph))"),
    ("text\n2. no list\n1. a list\n", "paragraph list(item(paragraph))"),
    ("a|b\n-|-\n1|2\n\nx\n", "table paragraph"),
    ("    code\n\n    more\ntext\n    lazy\n", "code paragraph"),
    ("- ```\n  - code\n  ```\n- two\n", "list(item(code),item(paragraph))"),
    ("```\nopen fence\n\n# inside\n", "code"),
    ("$$\nx\n$$\n$$ y $$\n$$z$$ text\n", "math math paragraph"),
    ("\\begin{align}\na\n\\end{align}\n\\begin{align}\nopen\n", "math paragraph"),
    ("> - a\n>   b\n> - c\nlazy\n> d\n", "quote(list(item(paragraph),item(paragraph)))"),
    ("-\n\n  x\n", "list(item) paragraph"),
    ("* * *\n- - x\n", "rule list(item(list(item(paragraph))))"),
    ("\ta\n-\tb\n\n\tc\n", "code list(item(paragraph,paragraph))"),
    ("# H\n## \n#no\n", "heading heading paragraph"),
    ("\n \n\t\n", ""),
])
def test_trees(text, tree):
    assert shape(text) == tree


def random_text(rng):
    marks = ["- ", "  - ", "1. ", "> ", "```", "    ", "# ", "$$", "|", "---", "", "", "\t", "* ", "> - "]
    words = ["one", "a|b", "`c`", "$x$", "5%", "[t](u)", "\\$", "``", "$", "é", "⟦1⟧", "<http://h/1>", "![i](p)"]
    return "\n".join(rng.choice(marks) * rng.randint(1, 2) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 14))) + rng.choice(["", "\n", "\n\n"])


@pytest.mark.parametrize("seed", range(4))
def test_nodes_nest_and_units_and_spans_make_the_text(seed):
    rng = random.Random(seed)
    for _ in range(700):
        t = random_text(rng)
        nodes = parse_blocks(t)
        last = {}
        for kind, parent, depth, start, end, _ in nodes:
            assert 0 <= start <= end <= len(t) and start >= last.get(parent, 0), t
            last[parent] = end
            if parent >= 0:
                assert nodes[parent][0] in ("list", "item", "quote") and nodes[parent][3] <= start and end <= nodes[parent][4], t
                assert (kind == "item") == (nodes[parent][0] == "list")
            assert depth == (nodes[parent][2] if parent >= 0 else 0) + (kind in ("list", "quote"))
        at = 0
        for kind, a, b, items in top_blocks(t):
            assert a >= at and not t[at:a].strip() and b >= a and kind != "item"
            assert all(x >= 0 and y <= b - a for x, y in items) and bool(items) == (kind == "list")
            at = b
        assert not t[at:].strip() and (at == len(t) or not nodes)
        safe, spans = protect(t)
        assert len({s[0] for s in spans}) == len(spans) and all(t[a:b] == o for _, o, _, a, b in spans)
        assert all(x[4] <= y[3] for x, y in zip(spans, spans[1:], strict=False))
        for p, original, *_ in spans:
            assert safe.count(p) == 1
            safe = safe.replace(p, original, 1)
        assert safe == t


def test_spans_by_kind():
    kinds = lambda t: [(t[a:b], k) for a, b, k in protected_spans(t)]
    assert kinds("`` a`b `` and `c` \\`d`") == [("`c`", "code_inline")]  # blanks at both edges are dropped by a parser
    assert kinds("``a`b`` x") == [("``a`b``", "code_inline")]
    assert kinds("$a\\$b$ and $$c$d$$ \\$5") == [("$a\\$b$", "math_inline"), ("$$c$d$$", "math_inline"), ("5", "number")]
    assert kinds("[a `b` 7](http://x/(1) 't') ![i 8](p9)") == [("`b`", "code_inline"), ("7", "number"), ("http://x/(1)", "link_url"), ("8", "number"), ("9", "number")]
    assert kinds("- one $a\n  b$ 3") == [("3", "number")]
    assert kinds("- x\n\n  $$\n  y 5\n  $$\n- 6") == [("$$\n  y 5\n  $$\n", "math_block"), ("6", "number")]
    assert kinds("```\n`a` $b$ 4\n```\n") == [("4", "number")]
    assert inline_spans("", 0, 0, False) == []


def test_long_texts_take_linear_time():
    began = time.time()
    for t in ("`" * 50_000 + "a", " ".join("`" * (k % 300 + 1) for k in range(20_000)), "$" * 100_001, "[" * 100_000, "](" * 50_000, "> " * 50_000, "- " * 50_000, "> a\n" * 50_000, "$$ x\n" * 50_000, "\\begin{align}\n" * 30_000, "1 - 2 " * 50_000):
        safe, spans = protect(t)
        assert safe or not t
    assert time.time() - began < 60
