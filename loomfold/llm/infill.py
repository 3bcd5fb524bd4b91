"""Fill-in-middle: texts cut at two token boundaries found through overlapping chunks, then written with sentinels.

A token is a run of letters A-Z or any other single character, so whether a token begins at a character depends on it and the
one before. A text is cut into chunks of fixed length, each seeing the last character of the chunk before it; each chunk's
boundaries are counted on their own, all in the row and without an exchange. Prefix sums of the counts say which two chunks own
the cut ranks, and only these are scanned again for the places. Work and memory grow linearly with a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import bind, running_total

TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def chunks_of(text: Column, size: int) -> Column:
    """The text in chunks of ``size`` code points, each with the character before it (empty at the start) and the tokens that begin in it."""

    def counted(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            before = F.when(i == 0, "").otherwise(F.right(F.get(parts, i - 1), F.lit(1)))

            def judged(b: Column) -> Column:
                # a run of letters that goes on from the chunk before begins no token here
                goes_on = b.rlike("[A-Za-z]") & part.rlike("^[A-Za-z]")
                return F.struct(part.alias("part"), b.alias("before"), (F.regexp_count(part, F.lit(TOKEN)) - goes_on.cast("int")).cast("long").alias("tokens"))

            return bind(before, judged)

        return F.transform(parts, one)

    return bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), counted)


def _place(chunk: Column, rank: Column) -> Column:
    """Characters of a chunk before its ``rank``-th token beginning, from 0."""
    goes_on = (chunk["before"].rlike("[A-Za-z]") & chunk["part"].rlike("^[A-Za-z]")).cast("int")
    return bind(F.regexp_extract_all(chunk["part"], F.lit(TOKEN), F.lit(0)), lambda found: F.length(F.array_join(F.slice(found, F.lit(1), (rank + goes_on).cast("int")), "")))


def cut_places(chunks: Column, before: Column, n: Column, ranks: list[Column], size: int) -> Column:
    """For each rank the code points before the token of that rank; the whole length for rank ``n``.

    ``before`` has the tokens before each chunk. The owner of a rank is the last chunk with no more than that before it, and
    only it is scanned.
    """

    def place(rank: Column) -> Column:
        # chunks inside a long run of letters begin no token: of equal counts the last one owns the rank
        owner = F.size(F.filter(before, lambda b: b <= rank)) - 1
        inside = bind(owner, lambda o: (o * size).cast("long") + _place(F.get(chunks, o), rank - F.get(before, o)))
        whole = F.aggregate(chunks, F.lit(0).cast("long"), lambda a, c: a + F.length(c["part"]))
        return F.when(rank >= n, whole).otherwise(inside)

    return F.array(*[place(r) for r in ranks])


def _drawn(key: Column, seed: int, nth: int) -> Column:
    """The nth group of 8 digits of the key's digest as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def infill(docs: DataFrame, percent: int = 90, spm_percent: int = 20, seed: int = 1, size: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix, middle, suffix, output`` for each row.

    ``n`` counts the tokens. Two ranks drawn by the document's id cut the text into prefix, middle and suffix; ``form`` says how
    they were written. A text that is null or empty, has a sentinel in it or wasn't drawn stays ``plain``, its parts null and
    ``output`` the text itself (empty for null). The empty string stands for a null id, so such rows share their draws; rows
    that repeat come out each, equal rows equal. Texts of any length are read whole; further columns are not read; an empty
    table gives none. Nothing is exchanged.
    """
    own = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("body"))
    own = own.select("doc_id", "body", *[_drawn(F.col("doc_id"), seed, i).alias(f"h{i + 1}") for i in range(4)])
    own = own.withColumn("chunks", chunks_of(F.col("body"), size))
    own = own.withColumn("before", running_total(F.transform("chunks", lambda c: c["tokens"]), inclusive=False))
    own = own.withColumn("n", F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["tokens"]))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("body", F.lit(mark))
    plain = (F.col("body") == "") | held | (F.col("h3") % 100 >= percent)
    own = own.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    ranks = [F.expr("least(h1 % (n + 1), h2 % (n + 1))"), F.expr("greatest(h1 % (n + 1), h2 % (n + 1))")]
    own = own.withColumn("cuts", F.when(F.col("form") != "plain", cut_places(F.col("chunks"), F.col("before"), F.col("n"), ranks, size)))
    a, b = F.get("cuts", F.lit(0)).cast("int"), F.get("cuts", F.lit(1)).cast("int")
    own = own.select("doc_id", "body", "n", "form", F.left("body", a).alias("prefix"), F.substr("body", a + 1, b - a).alias("middle"), F.substr("body", b + 1).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("body"))
    return own.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No sentinel begins inside another or in a text that was cut, so the three are found as they were put."""

    def joined(parts: Column) -> Column:
        first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
        return F.when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))

    return F.when(form == "plain", output).otherwise(bind(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), joined))


def op12_infill(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` as fill-in-middle examples, by digests of their parts and of the text restored from them."""
    done = infill(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT *, len(tokens) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM body),
cut AS (
  SELECT *, CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM drawn),
parts AS (SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE body END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""
