"""Markdown blocks as units, spans that translation must not touch, and their checks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scans import bind
from ..functions.text import NUMBER, PLACEHOLDER, placeholder_set
from .markdown import parse_blocks

UNIT = "doc_id string, index int, kind string, translate boolean, char_start int, char_end int, text string"
UNTOUCHED = {"code", "math", "rule"}


def scan_blocks(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the blocks at the top of a text. The first begins at 0 and the last ends with the text, so units and gaps make it whole."""
    return [(kind, a, b) for kind, a, b, _ in top_blocks(text)]


def top_blocks(text: str) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """:func:`scan_blocks` and, of a list, (start, end) of its own items from the list's start."""
    nodes = parse_blocks(text)
    top = [n for n, (_, parent, *_) in enumerate(nodes) if parent < 0]
    out = [[nodes[n][0], nodes[n][3], nodes[n][4], []] for n in top]
    place = {n: k for k, n in enumerate(top)}
    if out:
        out[0][1], out[-1][2] = 0, len(text)
    for kind, parent, _, start, end, _ in nodes:
        if kind == "item" and parent in place:
            own = out[place[parent]]
            own[3].append((start - own[1] if own[3] else 0, end - own[1]))
    return [tuple(x) for x in out]


#: Characters of texts whose results are held as Python objects at a time; see :func:`stretches`.
HELD = 1 << 18


def stretches(texts: pa.Array, most: int = HELD):
    """(start, texts) of consecutive stretches of a batch of texts, of about ``most`` characters each (null as empty).

    An Arrow batch has thousands of whole texts. Tuples of their spans and copies of their pieces take many times as much memory, so
    they are made for a stretch at a time and handed on as Arrow.
    """
    held, size, first = [], 0, 0
    for n in range(len(texts)):
        t = texts[n].as_py() or ""
        if held and size + len(t) > most:
            yield first, held
            held, size, first = [], 0, n
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def lists(counts: list[int], items: pa.Array) -> pa.Array:
    """An array of ``items`` for each count."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32()), items)


def columns(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> list[pa.Array]:
    """Tuples as Arrow arrays, one for each field."""
    return [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]


def block_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each block of each document; null and blank texts give none."""
    fields = [("doc_id", pa.string()), ("index", pa.int32()), ("kind", pa.string()), ("translate", pa.bool_()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("text", pa.string())]

    def run(batches):
        for batch in batches:
            for first, own in stretches(batch["body"]):
                ids = batch["doc_id"].slice(first, len(own)).to_pylist()
                rows = [(d, n, kind, kind not in UNTOUCHED, a, b, t[a:b]) for d, t in zip(ids, own, strict=True) for n, (kind, a, b) in enumerate(scan_blocks(t))]
                yield pa.RecordBatch.from_arrays(columns(rows, fields), [name for name, _ in fields])

    return docs.select(docs[doc_id].cast("string").alias("doc_id"), docs[text].alias("body")).mapInArrow(run, UNIT)


ITEMS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
BLOCK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("translate", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("items", ITEMS)])


@F.arrow_udf(T.ArrayType(BLOCK))
def scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """:func:`top_blocks` in the row."""
    place = [("start", pa.int32()), ("end", pa.int32())]
    fields = [("kind", pa.string()), ("translate", pa.bool_()), *place, ("text", pa.string())]
    for batch in texts:
        for _, own in stretches(batch):
            found = [top_blocks(t) for t in own]
            rows = [(kind, kind not in UNTOUCHED, a, b, t[a:b]) for t, blocks in zip(own, found, strict=True) for kind, a, b, _ in blocks]
            items = [x if kind == "list" else None for blocks in found for kind, _, _, x in blocks]
            inner = pa.StructArray.from_arrays(columns([y for x in items for y in x or ()], place), [name for name, _ in place])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x or ()) for x in items], dtype=np.int64)]), pa.int32())
            held = pa.ListArray.from_arrays(ends, inner, mask=pa.array([x is None for x in items], pa.bool_()))
            yield lists([len(x) for x in found], pa.StructArray.from_arrays([*columns(rows, fields), held], [*[name for name, _ in fields], "items"]))


ONE_SPAN = T.StructType([*[T.StructField(c, T.StringType()) for c in ("placeholder", "original", "kind")], *[T.StructField(c, T.IntegerType()) for c in ("start", "end")]])
SPAN = T.StructType([T.StructField("protected", T.StringType()), T.StructField("spans", T.ArrayType(ONE_SPAN))])
PLAIN_NUMBER = re.compile(NUMBER.replace("(?U)", "", 1))
INLINE = re.compile(r"\\.|`+|\$\$?|!?\[|\]\(|\]|<[A-Za-z][A-Za-z0-9+.-]*:[^<>\s]*>", re.S)
TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^()\s\\]|\\.|\((?:[^()\s\\]|\\.)*\))+))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")


class Runs:
    """Where runs of backticks of each length, and unescaped dollars, begin in a text; asked for places that only grow."""

    def __init__(self, text: str, start: int, end: int):
        self.ticks: dict[int, list[int]] = {}
        self.dollars: dict[int, list[int]] = {1: [], 2: []}
        for m in re.finditer(r"(\\+)|(`+)|(\$+)", text[start:end]):
            at = start + m.start()
            if m[2]:
                self.ticks.setdefault(len(m[2]), []).append(at)
            elif m[3]:
                escaped = m.start() > 0 and self.odd == at
                own = range(at + escaped, start + m.end())
                self.dollars[1] += own
                self.dollars[2] += own[:-1]
            self.odd = start + m.end() if m[1] and len(m[1]) % 2 else -1

    odd = -1

    @staticmethod
    def after(places: list[int] | None, at: int) -> int:
        """The first place from ``at`` on, -1 if there is none."""
        k = bisect_left(places or [], at)
        return places[k] if places and k < len(places) else -1


def inline_spans(text: str, start: int, end: int, prefixed: bool) -> list[tuple[int, int, str]]:
    """(start, end, kind) of code, mathematics and link targets in a stretch of running text, in order, by a cursor that only moves forward.

    A backtick run closes with the next run as long; dollars close with the next ones that no backslash escapes; a bracket
    that a target follows is a link, or an image, whose target stays open to translation. A span whose text a parser would
    change (code with line ends or blank edges, or lines with marks of containers before them) isn't protected.
    """
    runs, out, brackets, at = Runs(text, start, end), [], [], start

    def put(a: int, b: int, kind: str, inner: str) -> None:
        padded = kind == "code_inline" and (inner[:1] == " " == inner[-1:] and inner.strip(" ") or "\n" in inner)
        if not padded and not (prefixed and "\n" in inner):
            out.append((a, b, kind))

    while (m := INLINE.search(text, at, end)) is not None:
        at, mark = m.end(), m[0]
        if mark[0] == "`":
            close = runs.after(runs.ticks.get(len(mark)), at)
            if close >= 0:
                put(m.start(), close + len(mark), "code_inline", text[at:close])
                at = close + len(mark)
        elif mark[0] == "$":
            close = runs.after(runs.dollars[len(mark)], at)
            if close > at:
                put(m.start(), close + len(mark), "math_inline", text[at:close])
                at = close + len(mark)
        elif mark in ("[", "!["):
            brackets.append(mark)
        elif mark == "]" and brackets:
            brackets.pop()
        elif mark == "](" and brackets:
            target = TARGET.match(text, m.start() + 1, end)
            link = brackets.pop() == "["
            if target:
                a, b = target.span(1 if target[1] is not None else 2)
                if link and b > a:
                    out.append((a, b, "link_url"))
                    brackets = [x for x in brackets if x != "["]  # no links within links
                at = target.end()
        elif mark[0] == "<":
            out.append((m.start() + 1, m.end() - 1, "link_url"))
    return out


def protected_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what translation must not touch: nested blocks of mathematics, inline spans of running text, and last the numbers outside of these."""
    found: list[tuple[int, int, str]] = []
    for kind, _, depth, a, b, _ in parse_blocks(text):
        if kind == "math":
            found.append((a, b, "math_block"))
        elif kind in ("paragraph", "heading", "table"):
            found += inline_spans(text, a, b, depth > 0)
    numbers, k = [], 0
    for m in PLAIN_NUMBER.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k == len(found) or found[k][0] >= m.end():
            numbers.append((m.start(), m.end(), "number"))
    return sorted(found + numbers)


def protect(text: str) -> tuple[str, list[tuple[str, str, str, int, int]]]:
    """The text with numbered placeholders for its protected spans, and the spans they stand for. Placeholders that the text has itself are skipped in numbering."""
    own = set(re.findall(PLACEHOLDER, text))
    out, at, spans, n = [], 0, [], 0
    for a, b, kind in protected_spans(text):
        while f"⟦{n}⟧" in own:
            n += 1
        spans.append((f"⟦{n}⟧", text[a:b], kind, a, b))
        out += [text[at:a], f"⟦{n}⟧"]
        at, n = b, n + 1
    return "".join(out) + text[at:], spans


@F.arrow_udf(SPAN)
def protected(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """:func:`protect` in the row."""
    fields = [*[(c, pa.string()) for c in ("placeholder", "original", "kind")], ("start", pa.int32()), ("end", pa.int32())]
    for batch in texts:
        for _, own in stretches(batch):
            made = [protect(t) for t in own]
            spans = pa.StructArray.from_arrays(columns([s for _, spans in made for s in spans], fields), [name for name, _ in fields])
            yield pa.StructArray.from_arrays([pa.array([p for p, _ in made], pa.string()), lists([len(spans) for _, spans in made], spans)], ["protected", "spans"])


def restore(text: Column, spans: Column) -> Column:
    """Every placeholder replaced by what it stands for, in one pass: what is put in is not looked at again. Unknown ones stay."""
    known = F.map_from_entries(F.transform(spans, lambda s: F.struct(s["placeholder"], s["original"])))
    between, marks = F.split(text, PLACEHOLDER, -1), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    put = bind(known, lambda k: F.transform(marks, lambda m: F.coalesce(F.element_at(k, m), m)))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), put.alias("m")), lambda z: F.array(z["b"], F.coalesce(z["m"], F.lit(""))))), "")


def intact(text: Column, spans: Column) -> Column:
    """Whether the text has just the placeholders of the spans."""
    return placeholder_set(text) == F.array_sort(F.transform(spans, lambda s: s["placeholder"]))


def check_units(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document: ``ordered`` offsets and ``whole`` (units and gaps make the text)."""
    one = F.struct("index", "char_start", "char_end", "text")
    own = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("u")).join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("whole_text")), "doc_id")
    ordered = F.aggregate("u", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda a, u: F.struct(u["char_end"].alias("at"), (a["ok"] & (u["char_start"] >= a["at"])).alias("ok")), lambda a: a["ok"])
    same = F.forall("u", lambda u: F.substr("whole_text", u["char_start"] + 1, u["char_end"] - u["char_start"]) == u["text"])
    return own.select("doc_id", ordered.alias("ordered"), same.alias("whole"))


def validation(attempt: Column, source: Column, similarity: Column, floor: float) -> Column:
    """Why an attempt fails: a loop, lost placeholders, or too little similarity; null if it passes."""
    from ..functions.text import has_repetition

    lost = placeholder_set(attempt) != placeholder_set(source)
    low = (similarity < floor) if floor > 0 else F.lit(False)
    return F.when(has_repetition(attempt), "repetition").when(lost, "placeholders").when(low, "similarity")
