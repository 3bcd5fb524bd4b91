"""Row maps between source records, chat messages and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import fix_opening, hash_answer, md5_id, strip, strip_blocks, strip_tags
from ..functions.tokens import ensure_start, masked_labels
from .joins import not_done


def first_place(turns: Column, role: str, field: str = "role") -> Column:
    """The place of the first turn of a role; -1 if there is none."""
    return (F.array_position(F.transform(turns, lambda t: t[field]), F.lit(role)) - 1).cast("int")


def independent_pair(turns: Column, ask: str = "human", answer: str = "gpt", field: str = "from", value: str = "value") -> Column:
    """First turn of either role, wherever they stand, and the other turns; null unless both are there."""
    q, a = first_place(turns, ask, field), first_place(turns, answer, field)
    extra = F.filter(turns, lambda t, i: (i != q) & (i != a))
    return F.when((q >= 0) & (a >= 0), F.struct(F.get(turns, q)[value].alias("question"), F.get(turns, a)[value].alias("answer"), extra.alias("extra")))


def first_exchange(turns: Column) -> Column:
    """First user turn and the first assistant turn after it, stripped; null unless neither is blank."""
    q = first_place(turns, "user")
    later = F.get(F.filter(turns, lambda t, i: (i > q) & (t["role"] == "assistant")), F.lit(0))["content"]
    pair = F.struct(strip(F.get(turns, q)["content"]).alias("user"), strip(later).alias("assistant"))
    return F.when((q >= 0) & (pair["user"] != "") & (pair["assistant"] != ""), pair)


def qa_document(df: DataFrame, source: str, turns: str = "conversations") -> DataFrame:
    """Documents of question and answer from conversations; rows without both are left out."""
    pair = df.withColumn("pair", independent_pair(F.col(turns))).where("pair is not null")
    return pair.select(md5_id(F.col("pair.question")).alias("id"), F.col("pair.question").alias("question"), F.lit(None).cast("string").alias("reference_answer"), strip_tags(F.col("pair.answer")).alias("cot_answer"), F.to_json("pair.extra").alias("metadata"), F.lit(source).alias("source"))


def response_document(df: DataFrame, source: str) -> DataFrame:
    """Documents from the first of several responses, with the number of the others."""
    own = df.where(F.size("responses") > 0)
    return own.select(md5_id(F.col("question")).alias("id"), "question", "reference_answer", F.get("responses", F.lit(0))["response"].alias("cot_answer"), F.to_json(F.struct((F.size("responses") - 1).alias("alternatives"))).alias("metadata"), F.lit(source).alias("source"))


def code_document(df: DataFrame, source: str) -> DataFrame:
    """Documents from code rows; a null or an empty output is left out."""
    extra = [c for c in df.columns if c not in ("input", "output", "solution")]
    own = df.where("output is not null and output <> ''")
    return own.select(md5_id(F.col("input")).alias("id"), F.col("input").alias("question"), F.col("solution").alias("reference_answer"), strip_tags(F.col("output")).alias("cot_answer"), F.to_json(F.struct(*extra)).alias("metadata"), F.lit(source).alias("source"))


def first_correct(generations: Column, flags: Column) -> Column:
    """The first generation that is flagged right, without its thinking."""
    zipped = F.slice(F.zip_with(generations, flags, lambda g, ok: F.struct(g.alias("g"), ok.alias("ok"))), F.lit(1), F.least(F.size(generations), F.size(flags)))
    return strip_blocks(F.get(F.filter(zipped, lambda z: F.coalesce(z["ok"], F.lit(False))), F.lit(0))["g"])


def instruction_prompt(instruction: Column, extra: Column) -> Column:
    """Instruction, then the input after a blank line if there is one."""
    return F.when(F.coalesce(strip(extra), F.lit("")) != "", F.concat_ws("\n\n", strip(instruction), strip(extra))).otherwise(strip(instruction))


def to_messages(user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", user), turn("assistant", assistant))


def flatten_steps(docs: DataFrame, least: int = 0) -> DataFrame:
    """A row for each step worth training on: complete, both sides filled, and long enough."""
    s = docs.select("doc_id", F.inline("steps"))
    return s.where(~F.coalesce("has_missing_translation", F.lit(False)) & (F.col("en") != "") & (F.col("hi") != "") & (F.coalesce("token_count", F.lit(0)) >= least))


@F.udtf
class FlatSteps:
    """:func:`flatten_steps` as a table function of an array of steps and the least number of tokens; its columns are the step's own."""

    @staticmethod
    def analyze(steps: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(steps.dataType, T.ArrayType) or not isinstance(steps.dataType.elementType, T.StructType):
            raise ValueError("steps must be an array of structs")
        lacking = {"en", "hi", "token_count"} - set(steps.dataType.elementType.fieldNames())
        if lacking or not isinstance(least.dataType, T.IntegralType):
            raise ValueError(f"steps lack {sorted(lacking)}" if lacking else "least must be a whole number")
        return AnalyzeResult(steps.dataType.elementType)

    def eval(self, steps: list, least: int):
        for s in steps or []:
            if not ("has_missing_translation" in s and s["has_missing_translation"]) and s["en"] and s["hi"] and (s["token_count"] or 0) >= least:
                yield tuple(s)


def explode_tasks(docs: DataFrame, tasks: list[str]) -> DataFrame:
    """A row of chat messages for each chunk of each task column, in the order of document, task, chunk."""
    out = None
    for n, task in enumerate(tasks):
        own = docs.select("id", F.lit(n).alias("task_no"), F.lit(task).alias("task"), F.posexplode(f"{task}_chunks").alias("chunk", "c")).where("c.en <> '' and c.hi <> ''")
        own = own.select("id", "task_no", "task", "chunk", to_messages(F.col("c.en"), F.col("c.hi")).alias("messages"))
        out = own if out is None else out.unionByName(own)
    return out


def batch_requests(rows: DataFrame, key: str, parts: dict[str, str]) -> DataFrame:
    """One request for each chunk: ``parts`` maps a letter of the request id to its array column."""
    out = None
    for letter, column in parts.items():
        own = rows.select(F.col(key).cast("string").alias("key"), F.lit(letter).alias("part"), F.posexplode(column).alias("chunk", "text"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("custom_id", F.concat_ws("_", "key", "part", F.col("chunk").cast("string")))


def remap(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """Values of a column replaced by name; an unknown one is an error."""
    table = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))
    found = F.element_at(table, F.col(column))
    return df.withColumn(column, F.coalesce(found, F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")))


# What each task tells the model.
ANSWER_FORMAT = """
Respond in the following format:
<reasoning>
...
</reasoning>
<answer>
...
</answer>
"""
SUDOKU_RULES = """
Please solve the following 4x4 Sudoku puzzle. The puzzle is provided as a 16-character string reading left-to-right, top-to-bottom, where '0' represents empty cells.

Rules:
- Fill empty cells with digits 1-4
- Each row must contain digits 1-4 exactly once
- Each column must contain digits 1-4 exactly once
- Each 2x2 box must contain digits 1-4 exactly once

Important: Your solution must be a COMPLETE 16-character string with only the digits 1-4, representing your final solved grid.

Respond in this exact format:
<reasoning>
Your step-by-step solving process
</reasoning>
<answer>
[16-character solution string with no spaces or separators]
</answer>
"""
COUNTDOWN_TASK = "Using only the numbers %s, create an arithmetic expression that evaluates to exactly %s. You must use all numbers from the list, and each number must be used exactly once. You may use the operations +, -, *, and / as needed. After reasoning, provide only your final expression inside <answer></answer> tags without including an equals sign or the target number. For example, if the numbers are [2, 3, 4] and the target is 5, a valid answer is: <answer>\n2*4-3\n</answer>"
MATH_TASK = "You are a math expert. You will be given a question to solve. Solve it step by step. Wrap the final answer in a \\boxed{}. \n\n"
CODE_TASK = "You are a coding expert. You will be given a coding problem to solve. Solve it step by step. \n\n"


def user_prompt(*parts: Column | str) -> Column:
    """A conversation of one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("content")))


def gsm8k_rows(df: DataFrame) -> DataFrame:
    return df.select(user_prompt(ANSWER_FORMAT + "\n\n", F.col("question")).alias("prompt"), hash_answer(F.col("answer")).alias("answer"))


def countdown_rows(df: DataFrame) -> DataFrame:
    """Tasks of three numbers only."""
    shown = F.concat(F.lit("["), F.array_join(F.transform("nums", lambda n: n.cast("string")), ", "), F.lit("]"))
    before, between, after = COUNTDOWN_TASK.split("%s")
    own = df.where(F.size("nums") == 3)
    return own.select(user_prompt(ANSWER_FORMAT + "\n" + before, shown, between, F.col("target").cast("string"), after).alias("prompt"), "target", F.col("nums").alias("numbers"))


def sudoku_rows(df: DataFrame) -> DataFrame:
    return df.select(user_prompt(SUDOKU_RULES + "\n\nSolve the following Sudoku puzzle: ", F.col("Puzzle"), "\n").alias("prompt"), F.col("Puzzle").alias("puzzle"), F.col("Solution").alias("solution"))


def math_rows(df: DataFrame) -> DataFrame:
    return df.select(user_prompt(ANSWER_FORMAT + "\n\n" + MATH_TASK, F.col("problem")).alias("prompt"), F.col("solution").alias("answer"))


def code_rows(df: DataFrame) -> DataFrame:
    return df.select(user_prompt(ANSWER_FORMAT + "\n\n" + CODE_TASK, F.col("question")).alias("prompt"), F.struct("solution", F.col("test").alias("tests")).alias("answer"))


#: Each task's rows and the rewards, by name of a column function, that score its answers.
TASKS = {
    "gsm8k": (gsm8k_rows, ("xml_score", "soft_format", "strict_format", "whole_number", "correctness")),
    "countdown": (countdown_rows, ("countdown",)),
    "sudoku": (sudoku_rows, ("sudoku",)),
    "math": (math_rows, ("math_reward", "boxed_format")),
    "code": (code_rows, ("xml_score", "code_in_answer")),
}


def task(name: str):
    """(rows, reward functions) of a task; an unknown name is an error."""
    from ..functions import rewards

    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}; known: {', '.join(TASKS)}")
    rows, names = TASKS[name]
    return rows, [getattr(rewards, n) for n in names]


def sft_row(ids: Column, prompt_len: Column, mask_prompt: bool = True) -> Column:
    """Ids, labels and the prompt's length; the prompt's labels are ignored on request."""
    labels = masked_labels(ids, prompt_len) if mask_prompt else ids
    return F.struct(ids.alias("input_ids"), labels.alias("labels"), (prompt_len if mask_prompt else F.lit(None).cast("int")).alias("prompt_len"))


def edit_flow_row(ids: Column, prompt_len: Column, start: int, mask_prompt: bool = True) -> Column:
    """Ids and the prompt's length; when all ids are trained on there is none, and the start id comes first."""
    whole = ids if mask_prompt else ensure_start(ids, start)
    return F.struct(whole.alias("input_ids"), (prompt_len if mask_prompt else F.lit(None).cast("int")).alias("prompt_len"))


def paragraphs(text: Column) -> Column:
    """Stripped paragraphs, split at blank lines; blank ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")


def example_meta(df: DataFrame) -> DataFrame:
    """The original texts and their paragraphs by problem id, of examples with a right generation."""
    own = df.withColumn("answer", first_correct(F.col("generations"), F.col("flags"))).where("answer is not null")
    return own.select(md5_id(F.col("problem")).alias("id"), "problem", F.col("answer").alias("solution"), paragraphs(F.col("problem")).alias("problem_chunks"), paragraphs(F.col("answer")).alias("solution_chunks"))


def answered(df: DataFrame, done: DataFrame, key: str = "id", flags: str = "flags") -> DataFrame:
    """Rows with any right generation that aren't done."""
    return not_done(df.where(F.exists(flags, lambda x: F.coalesce(x, F.lit(False)))), done, key)


def in_language(df: DataFrame, lang: str | None, config: str | None = None) -> DataFrame:
    """Rows of a programming language: by the column that the config has, or, without one, by a word in the answer; all rows if none is asked for."""
    if lang is None:
        return df
    if config is None:
        return df.where(F.contains(F.get("messages", F.lit(1))["content"], F.lit(lang)))
    columns = {"synthetic_code_snippet": "lang", "algorithmic_corpus": "lang", "synthetic_qa": "program_lang"}
    if config not in columns:
        raise NotImplementedError(f"no language column known for {config!r}")
    return df.where(F.col(columns[config]) == lang)


def untranslated(df: DataFrame) -> DataFrame:
    """Units without a translation, or whose attempts were used up."""
    return df.where(F.col("hi").isNull() | F.coalesce(F.col("exhausted"), F.lit(False)))


# A known wrong translation of "Wait" and what it should be.
WAIT = r"^\s*Wait\b"
WRONG_WAIT = "देर"
WRONG_WAIT_OPENING = r"(?U)^(\s*देर\s*(?:हो गई|हो गया|करो|करें|कर रहा हूँ|कर रहे हैं|कर लेते हैं|तक|लगेगी|नहीं)?\s*[,।!]?\s*){1,3}"
RIGHT_WAIT = "रुको, "


def wrong_wait(en: Column, hi: Column) -> Column:
    """Whether a unit that begins with "Wait" has the known wrong translation."""
    return F.coalesce((hi != "") & en.rlike(WAIT) & strip(hi).startswith(WRONG_WAIT), F.lit(False))


def fix_wait(hi: Column) -> Column:
    return fix_opening(hi, WRONG_WAIT_OPENING, RIGHT_WAIT)


def repair(log: DataFrame, retranslated: DataFrame) -> DataFrame:
    """The log with each unit repaired: a known wrong opening is replaced, else what needs it takes its new translation, if any; ``how`` says which."""
    how = F.when(wrong_wait(F.col("en"), F.col("hi")), "substituted").when(F.col("hi").isNull() | F.coalesce(F.col("exhausted"), F.lit(False)), "retranslated")
    joined = log.withColumn("how", how).join(retranslated.select("unit_id", F.col("hi").alias("new")), "unit_id", "left")
    hi = F.when(F.col("how") == "substituted", fix_wait(F.col("hi"))).when(F.col("how") == "retranslated", F.coalesce("new", "hi")).otherwise(F.col("hi"))
    return joined.withColumn("hi", hi).drop("new")
