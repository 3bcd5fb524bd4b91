"""Scores of generated text as column expressions; Arrow UDFs where a parser is needed. Model text is never executed."""

from __future__ import annotations

import operator
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import bind
from .text import has_repetition, strip

# Edge marks, numeric tokens, spellings of answers, and names that unsafe code mentions.
EDGE_MARKS = ".,!?;:\"'()[]{}—-।"
NUMERIC = r"^[0-9०-९.,%:/+\-]+\z"
RESPELLED = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
UNSAFE = (" os", " sys", " subprocess", " shutil", " socket", " psutil", " ctypes", " pathlib", " builtins", "__import__")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def ngram_deficit(text: Column, n: int = 4, least: int = 8) -> Column:
    """One less the share of distinct token n-grams; 0 for fewer than ``least`` tokens."""
    def share(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), "\x00"))
        return F.when(F.size(t) < least, 0.0).otherwise(1 - F.size(F.array_distinct(grams)) / F.greatest(F.size(t) - n + 1, F.lit(1)))

    return bind(_tokens(text), share)


def repetition_penalty(text: Column) -> Column:
    """1 for a phrase that loops, else :func:`ngram_deficit`."""
    return F.when(has_repetition(text), 1.0).otherwise(ngram_deficit(text))


def script_penalty(text: Column) -> Column:
    """The share of Latin-only tokens among those with Latin or Devanagari letters; numeric tokens don't count."""
    bare = F.transform(_tokens(text), lambda x: F.btrim(x, F.lit(EDGE_MARKS)))
    words = F.filter(bare, lambda x: (x != "") & ~x.rlike(NUMERIC) & x.rlike("[A-Za-zऀ-ॿ]"))
    return bind(words, lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, lambda x: ~x.rlike("[ऀ-ॿ]"))) / F.size(w)))


def composite(similarity: Column, text: Column) -> Column:
    """Similarity (not below 0) less both penalties' shares, within 0 and 1; 0 for a blank text."""
    score = F.greatest(F.lit(0.0), similarity) * (1 - repetition_penalty(text)) * (1 - script_penalty(text))
    return F.when(strip(text) == "", 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def xml_answer(text: Column) -> Column:
    """What stands after the last ``<answer>`` and before the next ``</answer>``, stripped."""
    return strip(F.substring_index(F.substring_index(text, "<answer>", -1), "</answer>", 1))


def xml_score(text: Column) -> Column:
    """An eighth for each of the four tags that stands exactly once on its own lines; text after the last one costs."""
    times = lambda s: F.size(F.split(text, s, -1)) - 1
    after = F.length(F.substring_index(text, "\n</answer>\n", -1))
    out = F.when(times("<reasoning>\n") == 1, 0.125).otherwise(0.0)
    out = out + F.when(times("\n</reasoning>\n") == 1, 0.125).otherwise(0.0)
    out = out + F.when(times("\n<answer>\n") == 1, 0.125 - after * 0.001).otherwise(0.0)
    tail = F.length(F.substring_index(text, "\n</answer>", -1)) - 1
    return out + F.when(times("\n</answer>") == 1, 0.125 - tail * 0.001).otherwise(0.0)


def strict_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^<reasoning>\n.*?\n</reasoning>\n<answer>\n.*?\n</answer>\n$"), 0.5).otherwise(0.0)


def soft_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^<reasoning>.*?</reasoning>\s*<answer>.*?</answer>"), 0.5).otherwise(0.0)


def length_reward(text: Column) -> Column:
    return -F.length(text)


def correctness(text: Column, answer: Column) -> Column:
    return F.when(xml_answer(text) == answer, 2.0).otherwise(0.0)


def whole_number(text: Column) -> Column:
    return F.when(xml_answer(text).rlike(r"^\p{Nd}+\z"), 0.5).otherwise(0.0)


def sudoku(text: Column, puzzle: Column, solution: Column, cells: int = 16) -> Column:
    """The share of empty cells that the digits of the answer get right; the answer is filled up with 0 and cut."""
    empty = F.filter(F.sequence(F.lit(1), F.lit(cells)), lambda i: F.substr(puzzle, i, F.lit(1)) == "0")

    def share(digits: Column) -> Column:
        right = F.filter(empty, lambda i: F.substr(solution, i, F.lit(1)) == F.substr(digits, i, F.lit(1)))
        return F.when(F.size(empty) == 0, 0.0).otherwise(F.size(right) / F.size(empty))

    return bind(F.rpad(F.regexp_replace(xml_answer(text), "[^0-9]", ""), cells, "0"), share)


def safe_code(code: Column) -> Column:
    """Whether none of the unsafe names occurs."""
    out = F.lit(True)
    for name in UNSAFE:
        out = out & ~F.contains(code, F.lit(name))
    return out


def fenced_code(text: Column) -> Column:
    """The content of the first block fenced as Python; empty if there is none."""
    return F.regexp_extract(text, r"(?s)```python\n(.*?)```", 1)


def code_in_answer(text: Column) -> Column:
    """Half a point if that block, fences included, stands inside the answer's tags."""
    inside = F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)
    code = fenced_code(text)
    return F.when((code != "") & F.contains(inside, F.concat(F.lit("```python\n"), code, F.lit("```"))), 0.5).otherwise(0.0)


def tested_name(tests: Column) -> Column:
    """The function that the tests want: the imported one, else the one of the first assertion; null without either."""
    imported = F.regexp_extract(tests, r"(?U)from solution import (\w+)", 1)
    return F.nullif(F.when(imported != "", imported).otherwise(F.regexp_extract(tests, r"(?U)assert\s+(\w+)\s*\(", 1)), F.lit(""))


def renamed_code(code: Column, name: Column) -> Column:
    """The code with its first function under the name that the tests want; null without a function."""
    own = F.regexp_extract(code, r"(?U)def (\w+)\(", 1)
    # the name ends at its word's boundary; a function of a longer name stays
    parts = F.split(code, r"(?U)\bdef ", -1)
    put = lambda x, i: F.when(i == 0, x).when((F.regexp_extract(x, r"(?U)^(\w+)", 1) == own), F.concat(F.lit("def "), name, F.substr(x, F.length(own) + 1))).otherwise(F.concat(F.lit("def "), x))
    return F.when(own != "", F.array_join(F.transform(parts, put), ""))


def split_tests(tests: Column) -> Column:
    """Each ``assert`` line as a numbered function."""
    lines = F.filter(F.transform(F.split(tests, "\n"), strip), lambda x: x.startswith("assert"))
    return F.transform(lines, lambda x, i: F.concat(F.lit("def test_case_"), (i + 1).cast("string"), F.lit("():\n    "), x))


def boxed_format(text: Column) -> Column:
    """Half of: one for an opened answer, and one for a box in it (or in the text without an answer), a half without a box."""
    opened = F.contains(text, F.lit("<answer>"))
    inner = F.when(opened, F.substring_index(F.get(F.split(text, "<answer>", -1), F.lit(1)), "</answer>", 1)).otherwise(text)
    return 0.5 * (opened.cast("int") + F.when(F.contains(inner, F.lit("\\boxed")), 1.0).otherwise(0.5))


def boxed(text: str | None) -> str | None:
    """The content of the last ``\\boxed``: braces counted, ``\\fbox`` if there is none; the text itself without either; None if unbalanced."""
    if text is None:
        return None
    if "\\boxed " in text:
        return text.rsplit("\\boxed ", 1)[1].split("$")[0]
    at = max(text.rfind("\\boxed"), -1)
    at = at if at >= 0 else text.rfind("\\fbox")
    if at < 0:
        return text
    start = text.find("{", at)
    depth = 0
    for i in range(start if start >= 0 else len(text), len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            return text[start + 1 : i]
    return None


def normal_answer(text: str) -> str:
    """A LaTeX answer in one spelling: spacing, sizes, units, degrees, decimals, roots and fractions."""
    for old, new in RESPELLED:
        text = text.replace(old, new)
    text = text.split("\\text{ ")[0].replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    text = "0" + text if text.startswith(".") else text
    left, sign, right = text.partition("=")
    if sign and "=" not in right and len(left) <= 2:
        text = right
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text).replace(" ", "")
    text = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", text)
    text = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", text)
    text = "\\frac{1}{2}" if text == "0.5" else text
    return re.sub(r"\A(-?\d+)/(-?\d+)\Z", r"\\frac{\1}{\2}", text)


def same_answer(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is None and b is None
    return normal_answer(a) == normal_answer(b)


# How tightly operators bind; a sign binds more than a product and less than a power.
BINDING = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "sign": 3, "**": 4}
ARITHMETIC = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|(\*\*|//|[-+*/()]))")


def _apply(values: list[Fraction], sign: str) -> None:
    """Replace the last two values, or one for a sign, by the operator's result. A broken or very large power is worked out as a float."""
    b = values.pop()
    if sign in ("sign-", "sign+"):
        values.append(-b if sign == "sign-" else b)
        return
    a = values.pop()
    if sign == "**":
        exact = b.denominator == 1 and abs(b) <= 64 and max(abs(a.numerator), a.denominator) < 1 << 64
        power = a ** int(b) if exact else float(a) ** float(b)
        if isinstance(power, complex):
            raise ValueError(sign)
        values.append(Fraction(power))
    else:
        values.append(Fraction({"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "//": operator.floordiv}[sign](a, b)))


def arithmetic(text: str) -> Fraction | None:
    """The value of an expression of numbers, + - * / // ** and brackets, of any length and nesting; None if it isn't one.

    Operators wait on a stack until one that binds less comes; nothing is evaluated as code.
    """
    values: list[Fraction] = []
    waiting: list[str] = []
    text, at, operand = text.strip(), 0, True  # whether a number, a sign or a bracket may come
    tight = lambda s: BINDING["sign" if s.startswith("sign") else s]
    try:
        while at < len(text):
            m = ARITHMETIC.match(text, at)
            if m is None or (m[2] in ("*", "/", "//", "**", ")") if operand else m[1] or m[2] == "("):
                return None
            at = m.end()
            if m[1]:
                if len(m[1]) > 1 and m[1].isdigit() and m[1][0] == "0" and m[1].strip("0"):
                    return None  # Python has no such number
                values.append(Fraction(m[1].rstrip(".") if m[1].endswith(".") else m[1]))
                operand = False
            elif m[2] == "(":
                waiting.append("(")
            elif m[2] == ")":
                while waiting[-1] != "(":
                    _apply(values, waiting.pop())
                waiting.pop()
            elif operand:
                waiting.append("sign" + m[2])
            else:
                while waiting and waiting[-1] != "(" and (tight(waiting[-1]) > tight(m[2]) or tight(waiting[-1]) == tight(m[2]) and m[2] != "**"):
                    _apply(values, waiting.pop())
                waiting.append(m[2])
                operand = True
        while waiting:
            _apply(values, waiting.pop())
        return values[0] if len(values) == 1 and not operand else None
    except (ValueError, ZeroDivisionError, OverflowError, IndexError, KeyError):
        return None


def countdown_score(text: str | None, target: int, numbers: list[int]) -> float:
    """0 without an answer, 0.1 for a wrong one, 1 for an expression of just the given numbers that meets the target."""
    answers = re.findall(r"(?s)<answer>(.*?)</answer>", text or "")
    if not answers:
        return 0.0
    own = answers[-1].strip()
    if sorted(map(int, re.findall(r"\d+", own))) != sorted(numbers) or not re.fullmatch(r"[\d+\-*/().\s]+", own):
        return 0.1
    got = arithmetic(own)
    return 1.0 if got is not None and abs(float(got) - target) < 1e-5 else 0.1


@F.pandas_udf(T.StringType())
def boxed_answer(text: pd.Series) -> pd.Series:
    return text.map(boxed, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def math_reward(text: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([2.0 if same_answer(boxed(a), b) else 0.0 for a, b in zip(text, answer, strict=True)])


@F.pandas_udf(T.DoubleType())
def countdown(text: pd.Series, target: pd.Series, numbers: pd.Series) -> pd.Series:
    return pd.Series([countdown_score(t, int(x), [int(v) for v in n]) for t, x, n in zip(text, target, numbers, strict=True)])
