"""Queries over the structure of texts: blocks, protected spans and checked reconstruction, with their SQL.

The tables' texts have little markdown, so their lines are put into every kind of block in turn; SQL knows from how they were put
where each block begins and ends.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import md5_id
from ..operators import blocks, documents, markdown
from ..sources import sinks
from .catalogue import long, query, table

# the letters of each line that is not blank, in blocks of six kinds; a list has a nested one, a quote a second line without its mark
BLOCKS = r"""lines AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z]'))) AS line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z]')), 1) - 1 AS i FROM documents),
plain AS (SELECT doc_id, i, trim(regexp_replace(line, '[^A-Za-z ]', '', 'g')) AS s FROM lines),
blocks AS (SELECT doc_id, i, s, CASE i % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list' WHEN 3 THEN 'quote' WHEN 4 THEN 'code' ELSE 'math' END AS kind,
  CASE i % 6 WHEN 0 THEN repeat('#', (i // 6 % 6 + 1)::int) || ' ' || s WHEN 1 THEN s WHEN 2 THEN '- ' || s || chr(10) || '  1. ' || s || chr(10) || '- b'
    WHEN 3 THEN '> ' || s || chr(10) || 'lazy' WHEN 4 THEN '```' || chr(10) || s || chr(10) || '```' ELSE '$$' || chr(10) || s || chr(10) || '$$' END AS block FROM plain),
placed AS (SELECT *, coalesce(sum(length(block) + 2) OVER w, 0)::bigint AS char_start, lead(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS last FROM blocks
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def structured(spark, sf_dir):
    """``doc_id`` and ``text``: the lines of each document as markdown."""
    def block(line, i):
        s = F.trim(F.regexp_replace(line, "[^A-Za-z ]", ""))
        return (
            F.when(i % 6 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 6) % 6 + 1).cast("int")), F.lit(" "), s)).when(i % 6 == 1, s)
            .when(i % 6 == 2, F.concat(F.lit("- "), s, F.lit("\n  1. "), s, F.lit("\n- b"))).when(i % 6 == 3, F.concat(F.lit("> "), s, F.lit("\nlazy")))
            .when(i % 6 == 4, F.concat(F.lit("```\n"), s, F.lit("\n```"))).otherwise(F.concat(F.lit("$$\n"), s, F.lit("\n$$")))
        )

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, block), "\n\n").alias("text"))


@query(f"""WITH {BLOCKS} SELECT doc_id::varchar AS doc_id, i AS index, kind, kind NOT IN ('code', 'math') AS translate, char_start,
  (char_start + length(block) + CASE WHEN last THEN 0 WHEN kind = 'list' THEN 2 ELSE 1 END)::bigint AS char_end, md5(block || CASE WHEN last THEN '' WHEN kind = 'list' THEN chr(10) || chr(10) ELSE chr(10) END) AS text_md5 FROM placed""")
def structured_blocks(spark, sf_dir):
    """Blocks with their offsets; a list takes the blank line after it."""
    own = blocks.block_units(structured(spark, sf_dir))
    return own.select("doc_id", long("index").alias("index"), "kind", "translate", long("char_start").alias("char_start"), long("char_end").alias("char_end"), md5_id(F.col("text")).alias("text_md5"))


NODES_SQL = """inside AS (SELECT doc_id, unnest(CASE kind WHEN 'list' THEN ['list 1', 'item 1', 'paragraph 1', 'list 2', 'item 2', 'paragraph 2', 'item 1', 'paragraph 1'] WHEN 'quote' THEN ['quote 1', 'paragraph 1'] ELSE [kind || ' 0'] END) AS node FROM blocks)"""


@query(f"WITH {BLOCKS}, {NODES_SQL} SELECT doc_id, split_part(node, ' ', 1) AS kind, split_part(node, ' ', 2)::bigint AS depth, count(*) AS n FROM inside GROUP BY ALL")
def block_tree(spark, sf_dir):
    """Nodes of the block trees by kind and by the lists and quotes around them."""
    nodes = structured(spark, sf_dir).select("doc_id", F.explode(markdown.block_nodes(F.col("text"))).alias("n"))
    return nodes.groupBy("doc_id", "n.kind", long("n.depth").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BLOCKS} SELECT doc_id, coalesce(sum(CASE WHEN kind = 'list' THEN 3 END), 0)::bigint AS bullets, max(CASE kind WHEN 'list' THEN 2 WHEN 'quote' THEN 1 ELSE 0 END)::bigint AS depth, coalesce(min(CASE WHEN i = 0 THEN 1 END), 0)::bigint AS heading FROM blocks GROUP BY doc_id""")
def structure_prints(spark, sf_dir):
    """Bullets, depth and heading of each document, from its nodes."""
    own = structured(spark, sf_dir).where("text <> ''").select("doc_id", markdown.structure(markdown.block_nodes(F.col("text"))).alias("s"))
    return own.select("doc_id", *[long(f"s.{c}").alias(c) for c in ("bullets", "depth", "heading")])


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
plain AS (SELECT doc_id, i, trim(regexp_replace(line, '[^A-Za-z ]', '', 'g')) || '.' AS s FROM lines)
SELECT doc_id, i AS index, 'Use ⟦0⟧ at ⟦1⟧ for [' || s || '](⟦2⟧ "' || s || '"), \`no, ⟦3⟧ of ' || s AS protected, '`c_' || i || '` $x_{' || i || '}$ https://h/' || i || '?q=(1) ' || i || '.5%' AS originals, true AS restored FROM plain""")
def protected_structures(spark, sf_dir):
    """Code, mathematics, a link's target and a number in every line, and what stands for them; putting back gives the text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("index", "line"))
    s, i = F.concat(F.trim(F.regexp_replace("line", "[^A-Za-z ]", "")), F.lit(".")), F.col("index").cast("string")
    raw = F.concat(F.lit("Use `c_"), i, F.lit("` at $x_{"), i, F.lit("}$ for ["), s, F.lit("](https://h/"), i, F.lit('?q=(1) "'), s, F.lit('"), \\`no, '), i, F.lit(".5% of "), s)
    own = lines.select("doc_id", long("index").alias("index"), raw.alias("raw")).withColumn("p", blocks.protected(F.col("raw")))
    return own.select("doc_id", "index", "p.protected", F.array_join(F.transform("p.spans", lambda x: x["original"]), " ").alias("originals"), (blocks.restore(F.col("p.protected"), F.col("p.spans")) == F.col("raw")).alias("restored"))


@query("SELECT doc_id, true AS restored, true AS intact FROM documents WHERE regexp_matches(text, '[^ \\t\\r\\n]')")
def protected_units(spark, sf_dir):
    """Whether every block of each whole text comes back from its protected form, and has just the placeholders of its spans."""
    units = blocks.block_units(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("p", blocks.protected(F.col("text")))
    back = blocks.restore(F.col("p.protected"), F.col("p.spans")) == F.col("text")
    return units.groupBy(long("doc_id").alias("doc_id")).agg(F.bool_and(back).alias("restored"), F.bool_and(blocks.intact(F.col("p.protected"), F.col("p.spans"))).alias("intact"))


def translated(spark, sf_dir):
    """Lines as protected units, and translations: some missing, some that lose all placeholders or bring a new one."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("index", "line"))
    numbered = lines.select("doc_id", "index", F.concat(F.lit("See `a` "), F.regexp_replace("line", "[^A-Za-z ]", "")).alias("text"))
    units = numbered.withColumn("p", blocks.protected(F.col("text"))).select("doc_id", "index", "text", "p.protected", "p.spans", F.lit("\n").alias("gap"))
    said = F.concat(F.lit("T:"), "protected")
    said = F.when((F.col("doc_id") % 3 == 0) & (F.col("index") % 5 == 2), F.concat(said, F.lit(" ⟦9⟧"))).when((F.col("doc_id") % 4 == 0) & (F.col("index") % 7 == 3), F.regexp_replace(said, blocks.PLACEHOLDER, "")).otherwise(said)
    return units, units.where(F.col("index") % 4 != 1).select("doc_id", "index", said.alias("hi"))


TRANSLATED = r"""units AS (SELECT doc_id, 'See `a` ' || regexp_replace(unnest(string_split(text, chr(10))), '[^A-Za-z ]', '', 'g') AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
judged AS (SELECT doc_id, i, CASE WHEN i % 4 = 1 THEN line ELSE 'T:' || line END AS piece, i % 4 <> 1 AND doc_id % 3 = 0 AND i % 5 = 2 AS added, i % 4 <> 1 AND NOT (doc_id % 3 = 0 AND i % 5 = 2) AND doc_id % 4 = 0 AND i % 7 = 3 AS dropped FROM units)"""


@query(f"WITH {TRANSLATED} SELECT doc_id, string_agg(piece || chr(10), '' ORDER BY i) AS text FROM judged GROUP BY doc_id HAVING NOT bool_or(added OR dropped)")
def rebuilt_checked(spark, sf_dir):
    """Documents all of whose translations kept their placeholders."""
    units, translations = translated(spark, sf_dir)
    return documents.reconstruct_checked(units, translations).where("text is not null").select("doc_id", "text")


@query(f"WITH {TRANSLATED} SELECT doc_id, i AS index, CASE WHEN dropped THEN '⟦0⟧' ELSE '' END AS lost, CASE WHEN added THEN '⟦9⟧' ELSE '' END AS new FROM judged WHERE added OR dropped")
def rebuilt_faults(spark, sf_dir):
    """The side output of the same plan, written by the job that writes the documents: units whose placeholders differ."""
    units, translations = translated(spark, sf_dir)
    _, failed = sinks.write_outcomes(documents.reconstruct_checked(units, translations), sinks.scratch(spark, "outcomes"))
    return failed.select("doc_id", long("index").alias("index"), F.array_join("lost", " ").alias("lost"), F.array_join("new", " ").alias("new"))
