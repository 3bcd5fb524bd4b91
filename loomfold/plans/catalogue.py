"""Queries over the provided tables, one or more for each operator, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rewards, schedules, text, tokens
from ..functions.scans import runs_of
from ..operators import blocks, chat, documents, folds, joins, measures, sampling
from ..sources.readers import load_mixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c) -> F.Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


def unsigned(c: F.Column) -> F.Column:
    """0 instead of -0."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


# --- shared pieces of SQL ---------------------------------------------------------------------------------------------
SPLIT = "CASE WHEN (((('0x' || substr(md5('split:' || doc_id::varchar), 1, 16))::ubigint % 10000)::bigint * 1616 + (('0x' || substr(md5('split:' || doc_id::varchar), 17, 16))::ubigint % 10000)::bigint) % 10000) < 500 THEN 'validation' ELSE 'train' END"
UNITS = r"""
raw AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\n]'))) AS line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\n]')), 1) - 1 AS i FROM documents),
units AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ \t\r\n]+')) AS tokens, regexp_matches(line, '(?i)^\s*(wait|hold on|actually|hmm|that''s not right|but wait|let me reconsider)\b') AS marker FROM raw)"""
STEPS = UNITS + """,
walk AS (
  SELECT doc_id, i, line, tokens, tokens::bigint AS run, 0 AS step, 'start' AS why FROM units WHERE i = 0
  UNION ALL
  SELECT u.doc_id, u.i, u.line, u.tokens,
    CASE WHEN u.marker OR w.run >= 120 THEN u.tokens ELSE w.run + u.tokens END,
    CASE WHEN u.marker OR w.run >= 120 THEN w.step + 1 ELSE w.step END,
    CASE WHEN u.marker THEN 'discourse_marker' WHEN w.run >= 120 THEN 'token_cap' END
  FROM walk w JOIN units u ON u.doc_id = w.doc_id AND u.i = w.i + 1)"""
TURNS = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as arrays of messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return documents.nest(rows, "conv_id", "turn", "turns")


def word_ids(column: str = "text", mod: int = 1000):
    """A stand-in for a tokenizer: lengths of words as ids."""
    return F.transform(F.regexp_extract_all(column, F.lit(r"[^ \t\r\n]+"), F.lit(0)), lambda w: (F.length(w) % mod).cast("int"))


def has_words(column: str = "text"):
    """Whether :func:`word_ids` has any; a filter on their number would work them out twice."""
    return F.col(column).rlike(r"[^ \t\r\n]")


IDS = r"list_transform(regexp_extract_all(text, '[^ \t\r\n]+'), lambda w: (length(w) % 1000)::int)"


# --- sources, splits, counts ------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {SPLIT} AS split FROM documents")
def split_assign(spark, sf_dir):
    return sampling.hash_split(table(spark, sf_dir, "documents"), "doc_id", 0.05).select("doc_id", "split")


@query("SELECT source, count(*) AS docs, sum(n_chars)::bigint AS steps FROM documents GROUP BY ROLLUP (source)")
def source_split_counts(spark, sf_dir):
    return measures.source_totals(table(spark, sf_dir, "documents"), "source", F.col("n_chars"))


@query("SELECT DISTINCT lang, count(*) OVER (PARTITION BY lang) AS docs FROM documents WHERE length(text) > 0")
def language_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("length(text) > 0").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'eval' ELSE 'train' END AS split FROM labels")
def head_split(spark, sf_dir):
    return sampling.head_split(table(spark, sf_dir, "labels"), "doc_id", 0.1).select("doc_id", "split")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id::varchar), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return sampling.sample_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, seed=7)


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IN ('src0', 'src1')) SELECT CASE WHEN source = 'src0' AND k <= 5 THEN 'test' ELSE 'train' END AS split, doc_id FROM r WHERE (source = 'src0' AND k <= 25) OR (source = 'src1' AND k <= 10)")
def mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    load = lambda name: {"train": docs.where(F.col("source") == name).drop("source")}
    splits = load_mixture("src0[test:5,train:20] + src1[train:10]", load, "doc_id")
    out = None
    for k, df in splits.items():
        own = df.select(F.lit(k).alias("split"), "doc_id")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 64)::int AS slice FROM labels")
def work_slices(spark, sf_dir):
    return sampling.slices(table(spark, sf_dir, "labels"), "doc_id", 64).select("doc_id", "slice")


@query("SELECT doc_id, epoch::int AS epoch FROM labels, (SELECT unnest([0, 1, 2]) AS epoch)")
def repeated_epochs(spark, sf_dir):
    return sampling.repeated(table(spark, sf_dir, "labels").select("doc_id"), 3)


# --- row maps and filters ---------------------------------------------------------------------------------------------
@query(f"""WITH t AS ({TURNS}),
p AS (SELECT conv_id, turns, list_position(list_transform(turns, lambda x: x.role), 'user') AS q FROM t),
l AS (SELECT conv_id, trim(turns[q].content) AS u, list_filter(turns[q + 1:], lambda x: x.role = 'assistant') AS rest FROM p WHERE q > 0)
SELECT conv_id, u AS "user", trim(rest[1].content) AS assistant FROM l WHERE len(rest) > 0 AND u <> '' AND trim(rest[1].content) <> ''""")
def first_exchange(spark, sf_dir):
    own = turns(spark, sf_dir).select("conv_id", chat.first_exchange(F.col("turns")).alias("p")).where("p is not null")
    return own.select("conv_id", "p.user", "p.assistant")


@query(f"""WITH t AS ({TURNS}),
p AS (SELECT conv_id, turns, list_position(list_transform(turns, lambda x: x.role), 'user') AS q, list_position(list_transform(turns, lambda x: x.role), 'assistant') AS a FROM t)
SELECT conv_id, turns[q].content AS question, turns[a].content AS answer, (len(turns) - 2)::bigint AS extra FROM p WHERE q > 0 AND a > 0""")
def first_roles_independent(spark, sf_dir):
    pair = chat.independent_pair(F.col("turns"), "user", "assistant", "role", "content")
    return turns(spark, sf_dir).select("conv_id", pair.alias("p")).where("p is not null").select("conv_id", "p.question", "p.answer", long(F.size("p.extra")).alias("extra"))


@query("SELECT conv_id, count(*) AS turns, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def turns_nested(spark, sf_dir):
    own = turns(spark, sf_dir)
    return own.select("conv_id", long(F.size("turns")).alias("turns"), F.array_join(F.transform("turns", lambda t: t["content"]), "\n\n").alias("text"))


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def turns_flat(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", F.inline("turns")).select("conv_id", "turn", "role", long(F.length("content")).alias("chars"))


@query("""WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
t AS (SELECT conv_id, turn, prev, right(prev, 100) AS tail FROM p)
SELECT conv_id, turn, nullif(trim(CASE WHEN length(prev) > 100 AND strpos(tail, ' ') > 0 AND strpos(tail, ' ') < length(tail) THEN substr(tail, strpos(tail, ' ') + 1) ELSE tail END, ' ' || chr(9) || chr(10) || chr(13)), '') AS context FROM t""")
def prior_context(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index"), "text")
    return documents.with_context(units).select(F.col("doc_id").alias("conv_id"), F.col("index").alias("turn"), "context")


@query("SELECT doc_id, CASE source WHEN 'src0' THEN 'web' WHEN 'src1' THEN 'books' ELSE 'other' END AS source FROM documents")
def source_remap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source").isin("src0", "src1"), F.col("source")).otherwise("rest").alias("source"))
    return chat.remap(docs, "source", {"src0": "web", "src1": "books", "rest": "other"})


@query(f"""WITH t AS ({TURNS}),
e AS (SELECT conv_id, 'p' AS part, unnest(list_transform(list_filter(turns, lambda x: x.role = 'user'), lambda x: x.content)) AS text, generate_subscripts(list_filter(turns, lambda x: x.role = 'user'), 1) - 1 AS k FROM t
UNION ALL SELECT conv_id, 's', unnest(list_transform(list_filter(turns, lambda x: x.role = 'assistant'), lambda x: x.content)), generate_subscripts(list_filter(turns, lambda x: x.role = 'assistant'), 1) - 1 FROM t)
SELECT conv_id::varchar || '_' || part || '_' || k::varchar AS custom_id, length(text) AS chars FROM e""")
def batch_requests(spark, sf_dir):
    of = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["content"])
    rows = turns(spark, sf_dir).select("conv_id", of("user").alias("users"), of("assistant").alias("answers"))
    return chat.batch_requests(rows, "conv_id", {"p": "users", "s": "answers"}).select("custom_id", long(F.length("text")).alias("chars"))


@query("SELECT event_id, json_extract_string(props, '$.k')::bigint AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("SELECT conv_id, string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || '<|eot_id|>', '' ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def rendered_chat(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", text.render_chat(F.col("turns")).alias("chat"))


# --- joins ------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return joins.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def complete_semi(spark, sf_dir):
    return joins.only(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def labels_left_default(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT md5(text) AS id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_dup_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(text.md5_id(F.col("text")).alias("id"), "doc_id", "source")
    return docs.groupBy("id").agg(F.max("doc_id").alias("doc_id"), F.max_by("source", "doc_id").alias("source"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("SELECT l.doc_id, l.quality, d.source FROM labels l JOIN (SELECT arg_max(source, n_chars * 1000000 + doc_id) AS source, doc_id FROM documents GROUP BY doc_id) d USING (doc_id)")
def latest_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") * 1_000_000 + F.col("doc_id")).alias("version"))
    return joins.with_metadata(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs, "doc_id", "version").select("doc_id", "quality", "source")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def ledger_latest(spark, sf_dir):
    return joins.latest(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", F.col("event_type").alias("status"))


@query("SELECT d.doc_id, l.quality, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def step_metadata(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", "quality")
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


# --- segmentation -----------------------------------------------------------------------------------------------------
@query(f"WITH {UNITS} SELECT doc_id, i AS index, tokens FROM units")
def line_units(spark, sf_dir):
    return documents.line_units(table(spark, sf_dir, "documents")).select("doc_id", long("index").alias("index"), long("tokens").alias("tokens"))


@query(f"""WITH RECURSIVE {UNITS},
walk AS (SELECT doc_id, i, tokens::bigint AS run, 0 AS g FROM units WHERE i = 0
UNION ALL SELECT u.doc_id, u.i, CASE WHEN w.run > 0 AND w.run + u.tokens > 100 THEN u.tokens ELSE w.run + u.tokens END, CASE WHEN w.run > 0 AND w.run + u.tokens > 100 THEN w.g + 1 ELSE w.g END
FROM walk w JOIN units u ON u.doc_id = w.doc_id AND u.i = w.i + 1)
SELECT doc_id, g AS "group", count(*) AS units, max(run)::bigint AS tokens FROM walk GROUP BY doc_id, g""")
def budget_groups(spark, sf_dir):
    counts = documents.line_arrays(table(spark, sf_dir, "documents")).select("doc_id", F.transform("u", lambda u: u["tokens"]).alias("n"))
    groups = counts.select("doc_id", F.posexplode(runs_of(F.col("n"), folds.budget_groups(F.col("n"), 100))).alias("group", "part"))
    return groups.select("doc_id", "group", long(F.size("part")).alias("units"), F.aggregate("part", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))


@query(f"""WITH RECURSIVE {STEPS}
SELECT doc_id, step AS step_index, max(why) AS reason, count(*) AS unit_count, sum(tokens)::bigint AS token_count, string_agg(line, chr(10) || chr(10) ORDER BY i) AS text FROM walk GROUP BY doc_id, step""")
def steps(spark, sf_dir):
    return documents.steps(documents.line_arrays(table(spark, sf_dir, "documents")), most=120)


@query(f"""WITH RECURSIVE {STEPS},
by_doc AS (SELECT doc_id, max(step) + 1 AS steps, sum(tokens) AS tokens FROM walk GROUP BY doc_id)
SELECT source, {SPLIT} AS split, count(*) AS docs, coalesce(sum(steps), 0)::bigint AS steps, coalesce(sum(tokens), 0)::bigint AS tokens FROM documents LEFT JOIN by_doc USING (doc_id) GROUP BY 1, 2""")
def step_counts(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("body"))
    lines = units.select("doc_id", "source", documents.line_array(F.col("body")).alias("u"))
    has = set(lines.schema["u"].dataType.elementType.fieldNames())
    own = sampling.hash_split(lines.select("doc_id", "source", documents.step_arrays(F.col("u"), has, most=120).alias("s")), "doc_id", 0.05)
    tokens_of = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["token_count"])
    return own.groupBy("source", "split").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("s")).alias("steps"), F.sum(tokens_of).alias("tokens"))


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS changed FROM conversations)
SELECT conv_id, turn, (sum(changed) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::bigint AS run FROM c""")
def run_islands(spark, sf_dir):
    return documents.runs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn", long("run").alias("run"))


@query(f"""WITH {UNITS}, s AS (SELECT doc_id, i, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tokens) OVER (PARTITION BY doc_id) AS total FROM units)
SELECT doc_id, i AS index, round(before / total, 6) AS share, before / total >= 0.85 AS late FROM s""")
def recap_position(spark, sf_dir):
    units = documents.with_share(documents.line_units(table(spark, sf_dir, "documents")))
    return units.select("doc_id", long("index").alias("index"), F.round("share", 6).alias("share"), (F.col("share") >= 0.85).alias("late"))


@query(f"""WITH {UNITS}, f AS (SELECT *, i % 3 = 0 AS code FROM units)
SELECT doc_id, i AS index, code OR coalesce(lag(code) OVER w AND lead(code) OVER w, false) AS code FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def code_islands(spark, sf_dir):
    units = documents.line_units(table(spark, sf_dir, "documents"))
    coded = units.withColumn("kind", F.when(F.col("index") % 3 == 0, "code").otherwise("paragraph")).withColumn("translate", F.col("kind") != "code")
    return documents.absorb_between(coded).select("doc_id", long("index").alias("index"), (F.col("kind") == "code").alias("code"))


@query(f"""WITH {UNITS}, k AS (SELECT doc_id, CASE WHEN tokens < 10 THEN 'short' ELSE 'long' END AS kind, count(*) AS n FROM units GROUP BY 1, 2)
SELECT doc_id, string_agg(kind || '=' || n::varchar, ',' ORDER BY kind) AS kinds, sum(n)::bigint AS units FROM k GROUP BY doc_id""")
def kind_counts(spark, sf_dir):
    units = documents.line_units(table(spark, sf_dir, "documents")).withColumns({"kind": F.when(F.col("tokens") < 10, "short").otherwise("long"), "split_index": F.lit(None).cast("int"), "merged_from": F.lit(None).cast("array<string>"), "translate": F.lit(True)})
    stats = documents.document_stats(units)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("kind_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return stats.select("doc_id", shown.alias("kinds"), F.aggregate(F.map_values("kind_counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("units"))


@query(f"""WITH RECURSIVE {UNITS},
walk AS (SELECT doc_id, i, 0 AS g, 1 AS n, tokens AS wide FROM units WHERE i = 0
UNION ALL SELECT u.doc_id, u.i, CASE WHEN (w.n + 1) * greatest(w.wide, u.tokens) > 128 THEN w.g + 1 ELSE w.g END, CASE WHEN (w.n + 1) * greatest(w.wide, u.tokens) > 128 THEN 1 ELSE w.n + 1 END, CASE WHEN (w.n + 1) * greatest(w.wide, u.tokens) > 128 THEN u.tokens ELSE greatest(w.wide, u.tokens) END
FROM walk w JOIN units u ON u.doc_id = w.doc_id AND u.i = w.i + 1)
SELECT doc_id, i AS index, g AS batch FROM walk""")
def area_batches(spark, sf_dir):
    units = documents.line_arrays(table(spark, sf_dir, "documents"))
    return units.select("doc_id", F.posexplode(folds.area_batches(F.transform("u", lambda u: u["tokens"]), 128)).alias("index", "batch")).select("doc_id", long("index").alias("index"), "batch")


@query()
def markdown_blocks(spark, sf_dir):
    """Blocks of each document; the scanner has no SQL form."""
    return blocks.block_units(table(spark, sf_dir, "documents"))


@query()
def protected_spans(spark, sf_dir):
    """Texts with placeholders, and whether restoring gives them back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("p", blocks.protected(F.col("text")))
    return docs.select("doc_id", long(F.size("p.spans")).alias("spans"), blocks.intact(F.col("p.protected"), F.col("p.spans")).alias("intact"), (blocks.restore(F.col("p.protected"), F.col("p.spans")) == F.col("text")).alias("restored"))


# --- vectors ----------------------------------------------------------------------------------------------------------
SIMILAR = "s AS (SELECT label, vec_id, CASE WHEN lag(embedding) OVER w IS NOT NULL THEN list_dot_product(lag(embedding) OVER w::double[], embedding::double[]) END AS similarity FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


@query(f"WITH {SIMILAR} SELECT label, vec_id, CASE WHEN round(similarity, 5) = 0 THEN 0 ELSE round(similarity, 5) END AS similarity FROM s")
def adjacent_similarity(spark, sf_dir):
    return documents.neighbour_similarity(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", unsigned(F.round("similarity", 5)).alias("similarity"))


@query(f"WITH {SIMILAR} SELECT label, round(quantile_cont(similarity, 0.2), 5) AS threshold, count(*) AS vectors FROM s GROUP BY label")
def semantic_threshold(spark, sf_dir):
    rows = documents.weak_links(documents.neighbour_similarity(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding"), "label")
    return rows.groupBy("label").agg(F.round(F.first("threshold"), 5).alias("threshold"), F.count(F.lit(1)).alias("vectors"))


@query(f"WITH {SIMILAR} SELECT vec_id, round(similarity, 5) AS similarity FROM s WHERE similarity IS NOT NULL ORDER BY s.similarity, vec_id LIMIT 20")
def bottom_similarity(spark, sf_dir):
    rows = documents.neighbour_similarity(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").where("similarity is not null")
    return sampling.bottom(rows, "similarity", "vec_id", 20).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("WITH s AS (SELECT list_sort(list(l_extendedprice)) AS v FROM lineitem) SELECT len(v) AS n, v[1] AS least, v[len(v)] AS most, v[len(v) // 10 + 1] AS p10, v[len(v) // 2 + 1] AS p50, v[9 * len(v) // 10 + 1] AS p90 FROM s")
def quality_quantiles(spark, sf_dir):
    return measures.index_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"p10": (1, 10), "p50": (1, 2), "p90": (9, 10)})


# --- tokens -----------------------------------------------------------------------------------------------------------
@query(f"""WITH e AS (SELECT doc_id, unnest({IDS}) AS id, generate_subscripts({IDS}, 1) AS k FROM documents),
n AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS place FROM e)
SELECT (place // 512)::bigint AS block, sum(id)::bigint AS total, sum(id * (place % 512 + 1))::bigint AS weighted FROM n GROUP BY 1 HAVING count(*) = 512""")
def pack_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", word_ids().alias("ids"))
    packed = measures.pack_global(docs, "doc_id", "ids", 512)
    total = lambda f: F.aggregate(F.transform("input_ids", f), F.lit(0).cast("long"), lambda a, x: a + x)
    return packed.select("block", total(lambda x, i: x.cast("long")).alias("total"), total(lambda x, i: x.cast("long") * (i + 1)).alias("weighted"))


@query(f"""WITH d AS (SELECT doc_id, {IDS} AS ids FROM documents)
SELECT doc_id, list_sum(ids[:64])::bigint AS head, list_sum(ids[greatest(1, len(ids) - 63):])::bigint AS tail, len(ids[:8]) + len(ids[9:24]) AS kept FROM d""")
def clip_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", word_ids().alias("ids"))
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x))
    kept = F.size(tokens.clip_response(F.col("ids"), F.lit(8), 24))
    return d.select("doc_id", total(tokens.clip(F.col("ids"), 64)).alias("head"), total(tokens.clip(F.col("ids"), 64, "left")).alias("tail"), long(kept).alias("kept"))


def weighted(a):
    """A number that depends on each value and its place."""
    return F.aggregate(F.transform(a, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda t, x: t + x)


@query(f"""WITH d AS (SELECT doc_id, {IDS} AS ids FROM documents),
p AS (SELECT doc_id, ids, list_concat(ids, list_resize([]::int[], ((len(ids) + 31) // 32 * 32 - len(ids))::int, 2)) AS padded, list_concat(ids, list_resize([]::int[], greatest(256 - len(ids), 0)::int, 7)) AS canvas,
  list_concat(list_transform(ids, lambda x: 1), list_resize([]::int[], greatest(256 - len(ids), 0)::int, 0)) AS mask, list_transform(ids, lambda x, i: CASE WHEN i <= 5 THEN -100 ELSE x END) AS labels, CASE WHEN ids[len(ids)] = 2 THEN ids ELSE list_concat(ids, [2]) END AS ended FROM d)
SELECT doc_id, {', '.join(f"coalesce(list_sum(list_transform({c}, lambda x, i: x::bigint * i)), 0)::bigint AS {c}" for c in ('padded', 'canvas', 'mask', 'labels', 'ended'))} FROM p""")
def pad_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", word_ids().alias("ids"))
    ids = F.col("ids")
    return d.select("doc_id", weighted(tokens.pad_to_multiple(ids, 32, 2)).alias("padded"), weighted(tokens.pad_to(ids, 256, 7)).alias("canvas"), weighted(tokens.pad_mask(ids, 256)).alias("mask"), weighted(tokens.masked_labels(ids, F.lit(5))).alias("labels"), weighted(tokens.with_end(ids, 2)).alias("ended"))


@query(f"""WITH d AS (SELECT doc_id, {IDS} AS ids FROM documents), p AS (SELECT doc_id, ids, list_position(ids, 1) AS place FROM d)
SELECT doc_id, (CASE WHEN coalesce(place, 0) = 0 THEN len(ids) ELSE place END)::bigint AS completed, (CASE WHEN coalesce(place, 0) = 0 THEN len(ids) ELSE place - 1 END)::bigint AS trimmed FROM p""")
def completion_mask(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", word_ids().alias("ids"))
    done = F.aggregate(tokens.until_end(F.col("ids"), 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", done.alias("completed"), long(F.size(tokens.trim_generation(F.col("ids"), F.lit(0), -5, [1]))).alias("trimmed"))


@query(f"""WITH d AS (SELECT doc_id, unnest({IDS}) AS id, generate_subscripts({IDS}, 1) - 1 AS k FROM documents),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY id DESC, k) AS n FROM d)
SELECT doc_id, string_agg(k::varchar, ',' ORDER BY n) AS places FROM r WHERE n <= 5 GROUP BY doc_id""")
def top_places(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", word_ids().alias("ids")).where("size(ids) > 0")
    return d.select("doc_id", F.array_join(tokens.top_places(F.col("ids"), 5).cast("array<string>"), ",").alias("places"))


@query(f"""WITH d AS (SELECT doc_id, unnest({IDS}) AS id, generate_subscripts({IDS}, 1) AS k FROM documents), v AS (SELECT doc_id, k, (id > 3)::int AS ok, sum((id > 3)::int) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM d)
SELECT doc_id, sum(CASE WHEN ok = 1 THEN n - 1 ELSE 0 END)::bigint AS positions FROM v GROUP BY doc_id""")
def logical_positions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(has_words()).select("doc_id", word_ids().alias("ids"))
    places = tokens.positions(F.transform("ids", lambda x: (x > 3).cast("int")))
    return d.select("doc_id", F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x).alias("positions"))


@query(f"""WITH d AS (SELECT doc_id, {IDS} AS ids FROM documents), p AS (SELECT doc_id, unnest(ids) AS x, generate_subscripts(ids, 1) AS k FROM d),
w AS (SELECT doc_id, k, x, exp(x - max(x) OVER (PARTITION BY doc_id)) AS e FROM p),
r AS (SELECT doc_id, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY x DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(e) OVER (PARTITION BY doc_id) AS before FROM w)
SELECT doc_id, count(*) FILTER (WHERE before <= 0.9) AS kept FROM r GROUP BY doc_id""")
def nucleus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(has_words()).select("doc_id", word_ids().cast("array<double>").alias("logits"))
    return d.select("doc_id", long(F.size(F.filter(tokens.top_p_keep(F.col("logits"), 0.9), lambda x: x))).alias("kept"))


# halves of as many places as the document's words leave over, in blocks of 4
@query(f"""WITH d AS (SELECT doc_id, len({IDS}) % 13 AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, 2 * n)) AS i FROM d), e AS (SELECT doc_id, n, i, unnest(range(0, 2 * n)) AS j FROM c),
v AS (SELECT doc_id, i, j, i % n // 4 AS bi, j % n // 4 AS bj, i < n AS xi, j < n AS xj FROM e)
SELECT doc_id, i::bigint AS q, string_agg(j::varchar, ',' ORDER BY j) FILTER ((bi = bj AND xi = xj) OR (bi > bj AND NOT xj AND xi) OR (bi >= bj AND NOT xj AND NOT xi)) AS seen FROM v GROUP BY doc_id, i""")
def block_attention(spark, sf_dir):
    """Which places of noisy and clean halves see which."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.size(word_ids()) % 13).alias("n"))
    rows = d.select("doc_id", F.posexplode(tokens.block_mask(F.col("n"), 4)).alias("q", "m"))
    return rows.select("doc_id", long("q").alias("q"), F.array_join(F.transform("m", lambda x, k: F.when(x, k.cast("string"))), ",").alias("seen"))


TURN_IDS = r"list_transform(regexp_extract_all(text, '[^ \t\r\n]+'), lambda w: length(w) % 5)"


@query(f"""WITH t AS (SELECT conv_id, turn, unnest({TURN_IDS}) AS x, generate_subscripts({TURN_IDS}, 1) - 1 AS k FROM conversations),
p AS (SELECT *, count(*) FILTER (x <> 3) OVER (PARTITION BY conv_id, turn ORDER BY k // 4 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t)
SELECT conv_id, turn, k::bigint AS q, CASE WHEN x = 3 THEN 0 ELSE upto END AS seen FROM p""")
def sampling_masks(spark, sf_dir):
    """How many places each place of a turn sees while blocks of four are filled; words of some lengths are padding."""
    valid = F.transform(word_ids(mod=5), lambda x: (x != 3).cast("int"))
    seen = F.transform(tokens.sampling_mask(valid, 4), lambda m: F.size(F.array_remove(m, F.lit(False))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(seen).alias("q", "seen"))
    return rows.select("conv_id", "turn", long("q").alias("q"), long("seen").alias("seen"))


@query("""WITH t AS (SELECT doc_id, (n_chars % 101) / 100.0::double AS t FROM documents WHERE n_chars IS NOT NULL)
SELECT doc_id, round(t, 6) AS t, round(1 - t, 6) AS linear, round(1 - cos(pi() / 2 * (1 - t)), 6) AS cosine, round(1 / (t + 1e-6), 3) AS weight, round(2 * t ** 3 - 3 * t ** 2 + 2 * t, 6) AS cubic FROM t""")
def schedule_table(spark, sf_dir):
    """Schedules at a time that each document's length gives."""
    c = (F.col("n_chars") % 101) / F.lit(100.0)
    t = table(spark, sf_dir, "documents").where("n_chars is not null")
    return t.select("doc_id", F.round(c, 6).alias("t"), F.round(schedules.alpha("linear", c), 6).alias("linear"), F.round(schedules.alpha("Cosine", c), 6).alias("cosine"), F.round(schedules.alpha_weight("linear", c), 3).alias("weight"), F.round(schedules.kappa("cubic", c), 6).alias("cubic"))


@query(f"WITH d AS (SELECT doc_id, len({IDS}) AS n FROM documents) SELECT doc_id, string_agg((n // 8 + (k < n % 8)::int)::varchar, ',' ORDER BY k) AS steps FROM d, range(8) b(k) GROUP BY doc_id, n")
def even_schedule(spark, sf_dir):
    """Each document's words dealt to eight steps."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(schedules.even_steps(F.size(word_ids()), 8).cast("array<string>"), ",").alias("steps"))


# --- scores -----------------------------------------------------------------------------------------------------------
GRAMS = r"regexp_extract_all(text, '[^ \t\r\n]+')"


@query(f"""WITH d AS (SELECT doc_id, {GRAMS} AS t FROM documents),
g AS (SELECT doc_id, len(t) AS n, list_transform(range(1, greatest(len(t) - 2, 1)), lambda i: array_to_string(t[i:i + 3], ' ')) AS grams FROM d)
SELECT doc_id, round(CASE WHEN n < 8 THEN 0.0 ELSE 1 - len(list_distinct(grams)) / len(grams) END, 6) AS deficit FROM g""")
def ngram_penalty(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rewards.ngram_deficit(F.col("text")), 6).alias("deficit"))


# each third word length gets a letter of the other script, so both kinds occur
@query(f"""WITH d AS (SELECT doc_id, list_transform({GRAMS}, lambda w: trim(CASE WHEN length(w) % 3 = 0 THEN w || 'अ' ELSE w END, '.,!?;:"''()[]{{}}—-।')) AS t FROM documents),
w AS (SELECT doc_id, list_filter(t, lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9०-९.,%:/+\\-]+$') AND regexp_matches(x, '[A-Za-zऀ-ॿ]')) AS words FROM d)
SELECT doc_id, round(CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda x: NOT regexp_matches(x, '[ऀ-ॿ]'))) / len(words) END, 6) AS latin FROM w""")
def script_ratio(spark, sf_dir):
    mixed = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0)), lambda w: F.when(F.length(w) % 3 == 0, F.concat(w, F.lit("अ"))).otherwise(w)), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rewards.script_penalty(mixed), 6).alias("latin"))


def _loops(period: int) -> str:
    """Whether a phrase of ``period`` tokens is four times in a row from this token on, by windows over tokens and the white space after them."""
    last = 3 * period - 1
    whole = f"bool_and(same{period}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {last - 1} FOLLOWING)" if last > 1 else "true"
    ends = f"ends_with(token, lead(token, {period}) OVER w) AND starts_with(lead(token, {last + period}) OVER w, lead(token, {last}) OVER w)"
    inside = [f"lead(gap, {r * period + m}) OVER w = lead(gap, {(r + 1) * period + m}) OVER w" for r in range(3) for m in range(period - 1)]
    return " AND ".join([whole, ends, *inside])


# the first one to six words of a text, three or four times at its end
@query(f"""WITH body AS (
  SELECT doc_id, text || repeat(' ' || array_to_string(regexp_extract_all(text, '[^ \\t\\r\\n]+')[:doc_id % 6 + 1], ' '), (3 + doc_id // 6 % 2)::int) AS t FROM documents),
tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '([^ \\t\\r\\n]+)([ \\t\\r\\n]*)', 1)) AS token, unnest(regexp_extract_all(t, '([^ \\t\\r\\n]+)([ \\t\\r\\n]*)', 2)) AS gap,
    generate_subscripts(regexp_extract_all(t, '[^ \\t\\r\\n]+'), 1) AS i FROM body),
same AS (SELECT *, {", ".join(f"coalesce(token = lead(token, {k}) OVER w, false) AS same{k}" for k in range(1, 6))} FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
begun AS (SELECT doc_id, {" OR ".join(f"coalesce({_loops(k)}, false)" for k in range(1, 6))} AS loops FROM same WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, coalesce(bool_or(loops), false) AS loops FROM body LEFT JOIN begun USING (doc_id) GROUP BY doc_id""")
def repetition_flag(spark, sf_dir):
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0)), F.lit(1), (F.col("doc_id") % 6 + 1).cast("int"))
    tail = F.repeat(F.concat(F.lit(" "), F.array_join(words, " ")), (3 + F.floor(F.col("doc_id") / 6) % 2).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.has_repetition(F.concat("text", tail)).alias("loops"))


# whole answers, answers without their last line end, and plain text
TAGGED = """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<reasoning>' || chr(10) || text || chr(10) || '</reasoning>' || chr(10) || '<answer>' || chr(10) || turn::varchar || chr(10) || '</answer>' || chr(10)
  WHEN 1 THEN '<reasoning>' || text || '</reasoning> <answer>' || role || chr(10) || '</answer> and more' ELSE text END AS t FROM conversations"""


def tagged(spark, sf_dir):
    made = F.concat(F.lit("<reasoning>\n"), F.col("text"), F.lit("\n</reasoning>\n<answer>\n"), F.col("turn").cast("string"), F.lit("\n</answer>\n"))
    loose = F.concat(F.lit("<reasoning>"), F.col("text"), F.lit("</reasoning> <answer>"), F.col("role"), F.lit("\n</answer> and more"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, made).when(F.col("turn") % 3 == 1, loose).otherwise(F.col("text")).alias("t"))


def times_sql(tag: str) -> str:
    return f"(length(t) - length(replace(t, {tag}, ''))) / length({tag})"


OPEN_R, CLOSE_R, OPEN_A, CLOSE_A = ("'<reasoning>' || chr(10)", "chr(10) || '</reasoning>' || chr(10)", "chr(10) || '<answer>' || chr(10)", "chr(10) || '</answer>'")


@query(f"""WITH g AS ({TAGGED}) SELECT conv_id, turn,
round(CASE WHEN {times_sql(OPEN_R)} = 1 THEN 0.125 ELSE 0 END + CASE WHEN {times_sql(CLOSE_R)} = 1 THEN 0.125 ELSE 0 END
  + CASE WHEN {times_sql(OPEN_A)} = 1 THEN 0.125 - length(list_last(string_split(t, {CLOSE_A} || chr(10)))) * 0.001 ELSE 0 END
  + CASE WHEN {times_sql(CLOSE_A)} = 1 THEN 0.125 - (length(list_last(string_split(t, {CLOSE_A}))) - 1) * 0.001 ELSE 0 END, 6)::double AS score,
CASE WHEN regexp_matches(t, '^<reasoning>\n.*?\n</reasoning>\n<answer>\n.*?\n</answer>\n$', 's') THEN 0.5::double ELSE 0 END AS strict,
CASE WHEN regexp_matches(t, '^<reasoning>.*?</reasoning>\\s*<answer>.*?</answer>', 's') THEN 0.5::double ELSE 0 END AS soft, -length(t) AS short FROM g""")
def xml_score(spark, sf_dir):
    t = F.col("t")
    return tagged(spark, sf_dir).select("conv_id", "turn", F.round(rewards.xml_score(t), 6).alias("score"), rewards.strict_format(t).alias("strict"), rewards.soft_format(t).alias("soft"), long(rewards.length_reward(t)).alias("short"))


@query(f"""WITH g AS ({TAGGED}), a AS (SELECT conv_id, turn, trim(string_split(list_last(string_split(t, '<answer>')), '</answer>')[1], ' ' || chr(9) || chr(10) || chr(13)) AS answer FROM g)
SELECT conv_id, turn, answer, CASE WHEN regexp_matches(answer, '^[0-9]+$') THEN 0.5 ELSE 0.0 END AS whole, CASE WHEN answer = turn::varchar THEN 2.0 ELSE 0.0 END AS correct FROM a""")
def answer_extract(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn", rewards.xml_answer(F.col("t")).alias("answer"), rewards.whole_number(F.col("t")).alias("whole"), rewards.correctness(F.col("t"), F.col("turn").cast("string")).alias("correct"))


@query("SELECT event_id, CASE WHEN advantage = 0 THEN 0 ELSE advantage END AS advantage, CASE WHEN scaled = 0 THEN 0 ELSE scaled END AS scaled FROM (SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 3) AS advantage, round((value - avg(value) OVER (PARTITION BY user_id)) / (coalesce(stddev_samp(value) OVER (PARTITION BY user_id), 0) + 1e-4), 3) AS scaled FROM events)")
def group_advantage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    scaled = measures.advantages(e, "user_id", "value", scale=True).withColumnRenamed("advantage", "scaled")
    return measures.advantages(scaled, "user_id", "value").select("event_id", unsigned(F.round("advantage", 3)).alias("advantage"), unsigned(F.round("scaled", 3)).alias("scaled"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) AS perplexity FROM lineitem GROUP BY l_returnflag")
def weighted_mean_exp(spark, sf_dir):
    out = measures.weighted_mean(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("perplexity", 6).alias("perplexity"))


@query("SELECT round(avg(l_tax), 6) AS token, (SELECT round(avg(m), 6) FROM (SELECT avg(l_tax) AS m FROM lineitem GROUP BY l_orderkey)) AS sequence, round(sum(l_tax) / count(DISTINCT l_orderkey), 6) AS batch FROM lineitem")
def loss_norms(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    out = None
    for how in ("token", "sequence", "batch"):
        own = measures.loss(items, "l_tax", "l_orderkey", how).select(F.lit(how).alias("how"), "loss")
        out = own if out is None else out.unionByName(own)
    return out.groupBy().pivot("how", ["token", "sequence", "batch"]).agg(F.round(F.first("loss"), 6))


@query("SELECT event_id, round(coalesce(value, 0) * 2 + CASE WHEN event_type = 'error' THEN 0 ELSE 1 END * 0.5, 6) AS reward FROM events")
def reward_total(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("ok"))
    return e.select("event_id", F.round(measures.total_reward({"value": 2.0, "ok": 0.5}), 6).alias("reward"))


@query("SELECT user_id, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS spread FROM events GROUP BY user_id")
def reward_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("spread"))


# --- text functions ---------------------------------------------------------------------------------------------------
@query(r"""SELECT doc_id, md5(text) AS id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS words, len(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?(?:\s*-\s*[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?)?')) AS numbers,
regexp_matches(text, '(?i)\b(wait|hold on|actually|let me reconsider|hmm|that''s not right)\b') AS marker, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))) AS sentences FROM documents""")
def text_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.md5_id(t).alias("id"), long(F.size(text.word_set(t))).alias("words"), long(F.size(text.numbers(t))).alias("numbers"), text.has_marker(t).alias("marker"), long(text.sentence_count(t)).alias("sentences"))


MARKED = "SELECT conv_id, turn, 'see ⟦' || turn::varchar || '⟧ and ⟦0⟧: <think>' || text || '</think> #### ' || turn::varchar || ' ' AS t FROM conversations"


@query(f"""WITH m AS ({MARKED}) SELECT conv_id, turn, regexp_replace(t, '⟦([0-9]+)⟧', '<placeholder-\\1>', 'g') AS converted, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '⟦[0-9]+⟧'))), ',') AS places, trim(replace(replace(t, '<think>', ''), '</think>', '')) AS plain, trim(split_part(t, '####', 2)) AS answer, split_part(t, ' and', 1) AS head FROM m""")
def marked_text(spark, sf_dir):
    made = F.concat(F.lit("see ⟦"), F.col("turn").cast("string"), F.lit("⟧ and ⟦0⟧: <think>"), F.col("text"), F.lit("</think> #### "), F.col("turn").cast("string"), F.lit(" "))
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("t"))
    t = F.col("t")
    return m.select("conv_id", "turn", text.convert_placeholders(t).alias("converted"), F.array_join(text.placeholder_set(t), ",").alias("places"), text.strip_tags(t).alias("plain"), text.hash_answer(t).alias("answer"), text.cut_at(t, [" and", ""]).alias("head"))


@query("SELECT item_id, length(text) AS chars FROM benchmark WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL)")
def held_out_items(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").withColumn("id", text.md5_id(F.col("text")))
    return joins.not_done(items, table(spark, sf_dir, "documents").select(text.md5_id(F.col("text")).alias("id"))).select("item_id", long(F.length("text")).alias("chars"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS index FROM orders")
def reindexed(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", long(F.row_number().over(w) - 1).alias("index"))


@query("SELECT doc_id, (('0x' || substr(md5(doc_id::varchar), 17, 16))::ubigint % 997)::bigint AS low FROM documents")
def hash_modulo(spark, sf_dir):
    low = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 17, 16), 16, 10).cast("decimal(20,0)")
    return table(spark, sf_dir, "documents").select("doc_id", F.pmod(low, F.lit(997).cast("decimal(20,0)")).cast("long").alias("low"))


from . import rows, structure  # noqa: E402, F401 - register their queries here
