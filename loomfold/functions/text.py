"""Column functions on text. Classes such as ``\\s`` carry ``(?U)`` where Unicode matters; offsets are code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scans import bind, running_total, scan

# Marker words, closing phrases, patterns and the shares that go with them.
MARKER_START = r"(?iU)^\s*(wait|hold on|actually|hmm|that's not right|but wait|let me reconsider)\b"
MARKER_ANYWHERE = r"(?iU)\b(wait|hold on|actually|let me reconsider|hmm|that's not right)\b"
CLOSING_PHRASES = ("in conclusion", "in summary", "to summarize", "to conclude")
NUMBER = r"(?U)(\d+(?:,\d{3})*(?:\.\d+)?%?(?:\s*-\s*\d+(?:,\d{3})*(?:\.\d+)?%?)?)"
PLACEHOLDER = "⟦\\d+⟧"
HEADER, TURN_END = ("<|start_header_id|>", "<|end_header_id|>"), "<|eot_id|>"
LINE_ENDS = "\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029"


def md5_id(text: Column) -> Column:
    """The hex md5 of the UTF-8 text."""
    return F.md5(F.encode(text, "UTF-8"))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` knows spaces only). A run of white space inside is walked once."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")


def strip_tags(text: Column, open_tag: str = "<think>", close_tag: str = "</think>") -> Column:
    """Both tags removed, their content kept."""
    return strip(F.replace(F.replace(text, F.lit(open_tag), F.lit("")), F.lit(close_tag), F.lit("")))


def strip_blocks(text: Column, tag: str = "think") -> Column:
    """Whole tagged blocks removed."""
    return strip(F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", ""))


def has_repetition(text: Column, most: int = 5, times: int = 4) -> Column:
    """Whether a phrase of one to ``most`` tokens occurs ``times`` times in a row, as the pattern ``(\\S+(?:\\s+\\S+){0,4})(?:\\s+\\1){3,}`` has it.

    The first token of the first occurrence may be the end of a longer token, and the last one of the last occurrence its
    beginning; white space within the phrase is the same each time, between occurrences it is free. Each token is held against
    the one a period further on, so the work is linear in the text.
    """
    token = r"(?U)(\S+)(\s*)"

    def at(t: Column, w: Column, i: Column, k: int) -> Column:
        same = lambda a, j: F.get(a, i + j) == F.get(a, i + (j + k))
        last = (times - 1) * k - 1
        # whole tokens between both ends, then the ends, then the white space inside each occurrence
        tests = [same(t, j) for j in range(1, last)] + [F.endswith(F.get(t, i), F.get(t, i + k))]
        tests += [F.startswith(F.get(t, i + (last + k)), F.get(t, i + last))] if last else []
        tests += [same(w, r * k + m) for r in range(times - 1) for m in range(k - 1)]
        return reduce(lambda a, b: a & b, tests)

    def looped(t: Column, w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - times, F.lit(0)))
        return F.exists(starts, lambda i: F.coalesce(reduce(lambda a, b: a | b, [at(t, w, i, k) for k in range(1, most + 1)]), F.lit(False)))

    def cut(x: Column) -> Column:
        tokens, gaps = (F.regexp_extract_all(x, F.lit(token), F.lit(g)) for g in (1, 2))
        return F.when(x.isNotNull(), bind(tokens, lambda t: bind(gaps, lambda w: looped(t, w))))

    return bind(text, cut)


def numbers(text: Column) -> Column:
    """Integers, decimals, percentages and ranges, in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def convert_placeholders(text: Column) -> Column:
    """``⟦N⟧`` as ``<placeholder-N>``."""
    return F.regexp_replace(text, "⟦(\\d+)⟧", "<placeholder-$1>")


def placeholder_set(text: Column) -> Column:
    """Sorted distinct placeholders."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))))


def token_count(text: Column) -> Column:
    """The default token counter: runs of non-blank characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0)))


def sentence_count(text: Column) -> Column:
    """0 for a blank text, else the number of sentence ends and at least 1."""
    return F.when(strip(text) == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"(?U)[.!?]+(\s|\z)"))))


def ends_with_colon(text: Column) -> Column:
    return text.rlike(r"(?U):\s*\z")


def starts_with_marker(text: Column) -> Column:
    return text.rlike(MARKER_START)


def has_marker(text: Column) -> Column:
    return text.rlike(MARKER_ANYWHERE)


def word_set(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and apostrophes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)))


def starts_with_closing(text: Column) -> Column:
    """Whether the text opens with one of the closing phrases."""
    head, out = F.lower(strip(text)), F.lit(False)
    for phrase in CLOSING_PHRASES:
        out = out | head.startswith(phrase)
    return out


def sentences(text: Column) -> Column:
    """Stripped sentences, split after an end mark and white space; blank ones left out."""
    cut = F.split(text, r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def hash_answer(text: Column) -> Column:
    """What follows the first ``####`` up to the next, stripped; null if there is none."""
    return F.when(F.contains(text, F.lit("####")), strip(F.get(F.split(text, "####"), F.lit(1))))


def cut_at(text: Column, stops: list[str]) -> Column:
    """The text before the first of each stop string, taken in order; empty stops are skipped."""
    for s in stops:
        if s:
            text = F.substring_index(text, s, 1)
    return text


def move_trailing_space(context: Column, continuation: Column) -> tuple[Column, Column]:
    """Trailing white space of the context goes to the front of the continuation."""
    tail = F.regexp_extract(context, r"(?U)(\s*)\z", 1)
    return F.left(context, F.length(context) - F.length(tail)), F.concat(tail, continuation)


def token_list(text: Column) -> Column:
    """``[a;b]`` as an array of ints; empty for a blank text."""
    inner = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.split(inner, ";").cast("array<int>"))


def mask_latex(text: Column) -> Column:
    """(masked, parts): each LaTeX span becomes a numbered token. :func:`unmask_latex` undoes it."""
    pattern = r"(?s)\$\$.+?\$\$|\$[^$\n]+\$|\\\(.+?\\\)|\\\[.+?\\\]"
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    numbered = F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\x00LATEX"), (i - 1).cast("string"), F.lit("\x00"), x)))
    return F.struct(F.array_join(numbered, "").alias("masked"), parts.alias("parts"))


def unmask_latex(masked: Column, parts: Column) -> Column:
    numbered = F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.aggregate(numbered, masked, lambda t, p: F.replace(t, F.concat(F.lit("\x00LATEX"), p["i"].cast("string"), F.lit("\x00")), p["x"]))


def chunked(text: Column, size: int = 1024) -> Column:
    """The text in pieces of ``size`` code points, for :func:`piece_of`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def piece_of(chunks: Column, start: Column, end: Column, size: int = 1024) -> Column:
    """The text from ``start`` to ``end``, from the pieces that hold it: many cuts of a long text don't each walk it from its beginning."""
    first = F.floor(start / size).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.ceil(end / size).cast("int") - first), "")
    return F.when(end > start, F.substr(held, start - first * size + 1, end - start)).otherwise(F.lit(""))


def line_starts(text: Column, every_end: bool = False) -> Column:
    """Code-point offsets of the lines, split at ``\\n`` or, on request, at every line end that Python knows."""
    if not every_end:
        return running_total(F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1), inclusive=False)
    lines = F.regexp_extract_all(text, F.lit(f"(?s).*?(?:\r\n|[{LINE_ENDS}]|\\z)"), F.lit(0))
    return running_total(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.length(x)), inclusive=False)


def sentence_spans(text: Column) -> Column:
    """(start, end) of the sentences in order; together they are the whole text, white space after a sentence being its own."""
    ends = F.regexp_extract_all(text, F.lit(r"(?sU).+?(?:(?<=[.!?])\s+|\z)"), F.lit(0))
    return scan(ends, F.struct(F.lit(0).alias("at")), lambda s, x: F.struct((s["at"] + F.length(x)).alias("at")), lambda before, x, after: F.struct(before["at"].alias("start"), after["at"].alias("end")), "struct<start:int,end:int>")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of vectors of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prior_context(previous: Column, most: int = 100) -> Column:
    """The end of the previous text for a prompt: its last characters from the first space on, unless that is the last one; null if blank."""
    tail = F.right(previous, F.lit(most))
    at = F.instr(tail, " ")
    cut = F.when((F.length(previous) > most) & (at > 0) & (at < F.length(tail)), F.substr(tail, at + 1)).otherwise(tail)
    return F.nullif(strip(cut), F.lit(""))


def prompt(instruction: str, text: Column, context: Column | None = None) -> Column:
    """Instruction, an optional context block, then the text."""
    block = F.lit("") if context is None else F.when(context.isNotNull() & (context != ""), F.concat(F.lit("For context only:\n---\n"), context, F.lit("\n---\n"))).otherwise(F.lit(""))
    return F.concat(block, F.lit(instruction + "\n"), text)


def render_chat(messages: Column, begin: str = "", header: tuple[str, str] = HEADER, end: str = TURN_END, generate: bool = False) -> Column:
    """Messages as header, blank line, trimmed content and end mark, one after the other; with a header for the answer on request."""
    one = lambda m: F.concat(F.lit(header[0]), m["role"], F.lit(header[1] + "\n\n"), strip(m["content"]), F.lit(end))
    body = F.concat(F.lit(begin), F.array_join(F.transform(messages, one), ""))
    last = F.get(messages, F.size(messages) - 1)["role"]
    return F.concat(body, F.when(F.coalesce(last != "assistant", F.lit(True)), F.lit(f"{header[0]}assistant{header[1]}\n\n")).otherwise("")) if generate else body


def question_answer_chat(messages: Column, generate: bool = False) -> Column:
    """The bracketed form: an optional system block, then questions and answers."""
    tag = lambda m: F.when(m["role"] == "system", "SYS").when(m["role"] == "user", "Question").when(m["role"] == "assistant", "Answer")
    known = F.filter(messages, lambda m: tag(m).isNotNull())
    one = lambda m: F.concat(F.lit("["), tag(m), F.lit("]\n"), strip(m["content"]), F.lit("\n[/"), tag(m), F.lit("]\n"))
    body = F.array_join(F.transform(known, one), "\n")
    last = F.get(messages, F.size(messages) - 1)["role"]
    return F.concat(body, F.when(F.coalesce(last != "assistant", F.lit(True)), F.lit("\n[Answer]\n")).otherwise("")) if generate else body


def match_spans(text: Column, pattern: str) -> Column:
    """(start, end) of the pattern's matches, leftmost and not overlapping."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"))
    emit = lambda before, x, after: F.struct((before["at"] + F.length(x["p"])).alias("start"), after["at"].alias("end"))
    return scan(F.filter(found, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at")), step, emit, "struct<start:int,end:int>")


def fix_opening(text: Column, pattern: str, replacement: str) -> Column:
    """The stripped text with a known wrong opening replaced once; ``pattern`` is anchored."""
    return F.regexp_replace(strip(text), pattern, replacement)


def fingerprint(text: Column) -> Column:
    """What a translation should keep of a unit's structure: bullets, depth of nesting, bold and italic spans, level of the first heading (0 for none), placeholders, sentences, a colon at the end."""
    bullet = r"(?m)^([ \t]*)(?:[-+*]|\d{1,9}[.)])[ \t]+\S"
    indents = F.transform(F.regexp_extract_all(text, F.lit(bullet), F.lit(1)), lambda x: F.floor(F.length(F.replace(x, F.lit("\t"), F.lit("    "))) / 2).cast("int"))
    bold = r"\*\*(?=\S).+?(?<=\S)\*\*|__(?=\S).+?(?<=\S)__"
    plain = F.regexp_replace(F.regexp_replace(text, bold, ""), r"(?m)^[ \t]*[*+-][ \t]", "")
    return F.struct(
        F.size(indents).alias("bullets"),
        F.coalesce(F.array_max(indents) - F.array_min(indents) + 1, F.lit(0)).alias("depth"),
        F.regexp_count(text, F.lit(bold)).alias("bold"),
        F.regexp_count(plain, F.lit(r"\*(?=[^\s*])[^*\n]+\*|(?<!\w)_(?=[^\s_])[^_\n]+_(?!\w)")).alias("italic"),
        F.length(F.regexp_extract(text, r"(?m)^ {0,3}(#{1,6})(?:\s|$)", 1)).alias("heading"),
        placeholder_set(text).alias("placeholders"),
        sentence_count(text).alias("sentences"),
        ends_with_colon(text).alias("colon"),
    )
