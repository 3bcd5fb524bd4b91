"""More queries over the provided tables: filters, maps, joins, token arrays, sources, sinks and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rewards, schedules, text, tokens
from ..functions.batches import running_total
from ..operators import blocks, chat, documents, joins, measures, sampling, segments
from ..sources import readers, sinks
from ..streaming import incremental, jobs
from .catalogue import IDS, TURNS, UNITS, has_words, long, query, table, turns, weighted, word_ids


def weigh(column: str) -> str:
    """:func:`weighted` in SQL."""
    return f"coalesce(list_sum(list_transform({column}, lambda x, i: x::bigint * i)), 0)::bigint"


# --- filters ----------------------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn FROM conversations WHERE text <> '' AND role <> ''")
def both_sides(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where((F.col("text") != "") & (F.col("role") != "")).select("conv_id", "turn")


@query("SELECT u.user_id AS id, u.n FROM (SELECT user_id, count(*) AS n, bool_or(value > 150) AS any_high FROM events GROUP BY user_id) u WHERE any_high AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def answered_examples(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.col("value") > 150).alias("flags"))
    done = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return chat.answered(users, done).select("id", "n")


@query(f"SELECT doc_id, len({IDS})::bigint AS n FROM documents WHERE len({IDS}) <= 400")
def fitting_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", word_ids().alias("input_ids"))
    return incremental.fits(d, 400).select("doc_id", long(F.size("input_ids")).alias("n"))


@query(f"SELECT doc_id, least(len({IDS}), 300)::bigint AS n, {weigh(f'{IDS}[:300]')} AS total FROM documents WHERE n_chars % 700 <= 300")
def fitting_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", word_ids().alias("input_ids"), word_ids().alias("labels"), (F.col("n_chars") % 700).cast("int").alias("prompt_len"))
    return incremental.fits(d, 300, "right").select("doc_id", long(F.size("input_ids")).alias("n"), weighted(F.col("labels")).alias("total"))


@query(f"WITH t AS ({TURNS}) SELECT conv_id FROM t WHERE contains(turns[2].content, 'th')")
def answers_in_language(spark, sf_dir):
    return chat.in_language(turns(spark, sf_dir).withColumnRenamed("turns", "messages"), "th").select("conv_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def rows_in_language(spark, sf_dir):
    return chat.in_language(table(spark, sf_dir, "documents"), "de", "algorithmic_corpus").select("doc_id")


# translations of turns: some missing, some used up, some with a known wrong opening
LOG = "SELECT conv_id || ':' || turn AS unit_id, CASE WHEN turn % 4 = 1 THEN 'Wait, ' || text ELSE text END AS en, CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 4 = 1 THEN 'देर करो, देर, ' || text ELSE text END AS hi, turn % 7 = 3 AS exhausted FROM conversations"


def translation_log(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    turn, body = F.col("turn"), F.col("text")
    return t.select(
        F.concat_ws(":", "conv_id", "turn").alias("unit_id"),
        F.when(turn % 4 == 1, F.concat(F.lit("Wait, "), body)).otherwise(body).alias("en"),
        F.when(turn % 5 == 4, F.lit(None).cast("string")).when(turn % 4 == 1, F.concat(F.lit("देर करो, देर, "), body)).otherwise(body).alias("hi"),
        (turn % 7 == 3).alias("exhausted"),
    )


@query(f"WITH l AS ({LOG}) SELECT unit_id FROM l WHERE hi IS NULL OR exhausted")
def untranslated_units(spark, sf_dir):
    return chat.untranslated(translation_log(spark, sf_dir)).select("unit_id")


@query(f"""WITH l AS ({LOG}), j AS (SELECT *, CASE WHEN coalesce(en LIKE 'Wait%' AND hi LIKE 'देर%', false) THEN 'substituted' WHEN hi IS NULL OR exhausted THEN 'retranslated' END AS how FROM l)
SELECT unit_id, how, CASE WHEN how = 'substituted' THEN 'रुको, ' || substr(hi, length('देर करो, देर, ') + 1) WHEN how = 'retranslated' AND length(en) % 2 = 0 THEN replace(en, 'e', '3') ELSE hi END AS hi FROM j""")
def repaired_units(spark, sf_dir):
    log = translation_log(spark, sf_dir)
    new = log.where(F.length("en") % 2 == 0).select("unit_id", F.replace("en", F.lit("e"), F.lit("3")).alias("hi"))
    return chat.repair(log, new).select("unit_id", "how", "hi")


@query("SELECT page_id, NOT (contains(html, ' os') OR contains(html, ' sys') OR contains(html, ' subprocess') OR contains(html, ' shutil') OR contains(html, ' socket') OR contains(html, ' psutil') OR contains(html, ' ctypes') OR contains(html, ' pathlib') OR contains(html, ' builtins') OR contains(html, '__import__')) AS safe FROM pages")
def safe_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rewards.safe_code(F.col("html")).alias("safe"))


# --- row maps ---------------------------------------------------------------------------------------------------------
@query(f"""WITH t AS ({TURNS}), p AS (SELECT turns, list_position(list_transform(turns, lambda x: x.role), 'user') AS q, list_position(list_transform(turns, lambda x: x.role), 'assistant') AS a FROM t)
SELECT md5(turns[q].content) AS id, turns[q].content AS question, trim(turns[a].content) AS cot_answer, 'chat' AS source FROM p WHERE q > 0 AND a > 0""")
def qa_documents(spark, sf_dir):
    pairs = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["content"].alias("value")))
    rows = turns(spark, sf_dir).select(pairs.alias("conversations"))
    return chat.qa_document(rows, "chat").select("id", "question", "cot_answer", "source")


@query("""WITH r AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS answers FROM orders GROUP BY o_custkey)
SELECT md5(o_custkey::varchar) AS id, answers[1] AS cot_answer, '{"alternatives":' || (len(answers) - 1)::varchar || '}' AS metadata FROM r""")
def response_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("response")))).alias("responses"))
    own = rows.select(F.col("o_custkey").cast("string").alias("question"), F.lit(None).cast("string").alias("reference_answer"), "responses")
    return chat.response_document(own, "orders").select("id", "cot_answer", "metadata")


@query("SELECT md5(p_name) AS id, p_brand AS reference_answer, trim(p_type) AS cot_answer, '{\"p_partkey\":' || p_partkey::varchar || '}' AS metadata FROM part WHERE p_type IS NOT NULL AND p_type <> ''")
def code_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("input"), F.col("p_brand").alias("solution"), F.col("p_type").alias("output"), "p_partkey")
    return chat.code_document(rows, "parts").select("id", "reference_answer", "cot_answer", "metadata")


@query("""WITH g AS (SELECT user_id, list(event_type ORDER BY event_id) AS generations, list(value > 120 ORDER BY event_id) AS flags FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN list_position(flags, true) > 0 THEN generations[list_position(flags, true)] END AS answer FROM g""")
def first_right_answer(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", (F.col("value") > 120).alias("ok")))).alias("e"))
    return rows.select("user_id", chat.first_correct(F.transform("e", lambda x: x["event_type"]), F.transform("e", lambda x: x["ok"])).alias("answer"))


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


@query(f"SELECT conv_id, turn, trim(role, {BLANKS}) || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || trim(text, {BLANKS}) ELSE '' END AS prompt FROM conversations")
def instruction_prompts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", chat.instruction_prompt(F.col("role"), F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("prompt"))


@query("SELECT conv_id, turn, 'user:' || role || '|assistant:' || text AS shown FROM conversations")
def message_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("m", chat.to_messages(F.col("role"), F.col("text")))
    return t.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|").alias("shown"))


ITEMS = "SELECT l_orderkey AS id, list({'en': CASE WHEN l_discount = 0 THEN '' ELSE l_returnflag END, 'hi': l_linestatus, 'n': l_quantity::int, 'bad': l_tax > 0.06} ORDER BY l_partkey, l_linenumber, l_quantity) AS steps FROM lineitem GROUP BY l_orderkey"


def order_steps(spark, sf_dir):
    """Orders as documents whose steps are their items."""
    one = F.struct("l_partkey", "l_linenumber", "l_quantity", F.when(F.col("l_discount") == 0, "").otherwise(F.col("l_returnflag")).alias("en"), F.col("l_linestatus").alias("hi"), F.col("l_quantity").cast("int").alias("token_count"), (F.col("l_tax") > 0.06).alias("has_missing_translation"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("steps"))
    return rows.withColumn("steps", F.transform("steps", lambda s: s.dropFields("l_partkey", "l_linenumber", "l_quantity")))


@query(f"WITH i AS ({ITEMS}), s AS (SELECT id AS doc_id, unnest(steps) AS s FROM i) SELECT doc_id, s.en AS en, s.hi AS hi, count(*) AS n FROM s WHERE NOT s.bad AND s.en <> '' AND s.hi <> '' AND s.n >= 10 GROUP BY ALL")
def flat_steps(spark, sf_dir):
    return chat.flatten_steps(order_steps(spark, sf_dir), 10).groupBy("doc_id", "en", "hi").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH i AS ({ITEMS}), s AS (SELECT id AS doc_id, unnest(steps) AS s FROM i) SELECT doc_id, s.en AS en, s.hi AS hi, count(*) AS n FROM s WHERE NOT s.bad AND s.en <> '' AND s.hi <> '' AND s.n >= 10 GROUP BY ALL")
def flat_steps_function(spark, sf_dir):
    """Steps by a table function that finds its columns from its argument's type."""
    steps = order_steps(spark, sf_dir)
    flat = steps.lateralJoin(chat.FlatSteps(F.col("steps").outer(), F.lit(10)))
    return flat.groupBy("doc_id", "en", "hi").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH i AS ({ITEMS}), k AS (SELECT id, len(list_filter(steps, lambda s: NOT s.bad AND s.en <> '' AND s.hi <> '' AND s.n >= 30))::bigint AS kept FROM i) SELECT id, kept FROM k WHERE kept > 0")
def kept_documents(spark, sf_dir):
    return sinks.kept_steps(order_steps(spark, sf_dir), 30).select("id", long(F.size("steps")).alias("kept"))


@query(f"WITH i AS ({ITEMS}) SELECT id, len(list_filter(steps, lambda s: s.bad)) > 0 AS missing FROM i")
def missing_any(spark, sf_dir):
    return order_steps(spark, sf_dir).select(F.col("doc_id").alias("id"), F.exists("steps", lambda s: s["has_missing_translation"]).alias("missing"))


@query(f"""WITH i AS ({ITEMS}), e AS (SELECT id, 0 AS task_no, unnest(steps) AS s, generate_subscripts(steps, 1) - 1 AS chunk FROM i UNION ALL SELECT id, 1, unnest(list_reverse(steps)), generate_subscripts(steps, 1) - 1 FROM i)
SELECT id, task_no, chunk::bigint AS chunk, s.en || '>' || s.hi AS shown FROM e WHERE s.en <> '' AND s.hi <> ''""")
def task_chunks(spark, sf_dir):
    pair = lambda s: F.struct(s["en"].alias("en"), s["hi"].alias("hi"))
    rows = order_steps(spark, sf_dir).select(F.col("doc_id").alias("id"), F.transform("steps", pair).alias("problem_chunks"), F.reverse(F.transform("steps", pair)).alias("solution_chunks"))
    out = chat.explode_tasks(rows, ["problem", "solution"])
    return out.select("id", "task_no", long("chunk").alias("chunk"), F.array_join(F.transform("messages", lambda m: m["content"]), ">").alias("shown"))


@query("SELECT conv_id, turn, 'For context only:' || chr(10) || '---' || chr(10) || role || chr(10) || '---' || chr(10) || 'Translate.' || chr(10) || text AS prompt FROM conversations")
def context_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt("Translate.", F.col("text"), F.col("role")).alias("prompt"))


@query("SELECT o_orderkey, 'You are' AS opening, length(o_orderstatus) AS own FROM orders")
def task_prompts(spark, sf_dir):
    """The mathematics task's prompt has its instruction once, then the problem."""
    rows = table(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("problem"), F.col("o_orderkey").cast("string").alias("solution"))
    made = chat.math_rows(rows).select(F.col("answer").cast("long").alias("o_orderkey"), F.get("prompt", F.lit(0))["content"].alias("c"))
    parts = F.split("c", r"\n\n", -1)
    last = F.element_at(parts, -1)
    return made.select("o_orderkey", F.left(text.strip(F.element_at(parts, -2)), F.lit(7)).alias("opening"), long(F.length(F.substring_index(last, "|", -1))).alias("own"))


# --- joins ------------------------------------------------------------------------------------------------------------
@query("SELECT source, doc_id FROM documents WHERE source IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)")
def chained_sources(spark, sf_dir):
    """Each source without what is done or what a source before it has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    names = sorted(r["source"] for r in docs.where("source is not null").select("source").distinct().collect())  # a row for each source
    own = joins.chained_sampling([docs.where(F.col("source") == s) for s in names], table(spark, sf_dir, "labels"), "doc_id")
    return sampling.merge_splits([{"all": x} for x in own])["all"].select("source", "doc_id")


@query("SELECT c_custkey AS key, coalesce(n.n_name, 'nowhere') AS name FROM customer LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 3) n ON c_nationkey = n_nationkey")
def looked_up(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey > 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("k"))
    return joins.lookup(rows, nations, "k", "name", "nowhere").select("key", "name")


@query("SELECT event_id || ':' || user_id AS unit_id, event_id::varchar AS doc_id FROM events")
def unit_documents(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat_ws(":", "event_id", "user_id").alias("unit_id")).select("unit_id", joins.document_of().alias("doc_id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resumable_jobs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"))
    segments_of = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "submitted").otherwise("done").alias("status"))
    jobs = orders.join(segments_of, "o_custkey").groupBy("o_custkey", "status").agg(F.collect_list("id").alias("problem_ids"))
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return joins.resumable(jobs, orders.select("id"), done).select("id")


# --- ordered units ----------------------------------------------------------------------------------------------------
@query(f"""WITH {UNITS}, early AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(line), '[a-z0-9'']+')) AS w FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(tokens) OVER (PARTITION BY doc_id) AS share FROM units) WHERE share < 0.85),
s AS (SELECT doc_id, i, line, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(tokens) OVER (PARTITION BY doc_id) AS share, list_distinct(regexp_extract_all(lower(line), '[a-z0-9'']+')) AS words FROM units),
met AS (SELECT s.doc_id, s.i, count(*) AS met FROM (SELECT doc_id, i, unnest(words) AS w FROM s WHERE share >= 0.85) s JOIN early USING (doc_id, w) GROUP BY 1, 2)
SELECT s.doc_id, s.i AS index, share >= 0.85 AND (regexp_matches(lower(trim(line)), '^(in conclusion|in summary|to summarize|to conclude)') OR (len(words) > 0 AND coalesce(met, 0) >= 0.5 * len(words))) AS recap FROM s LEFT JOIN met ON s.doc_id = met.doc_id AND s.i = met.i""")
def recap_units(spark, sf_dir):
    units = documents.with_recap(documents.line_arrays(table(spark, sf_dir, "documents")))
    return units.select("doc_id", long("index").alias("index"), F.col("is_recap").alias("recap"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, i AS line, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS start FROM l""")
def line_offsets(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.line_starts(F.col("text"))).alias("line", "start"))
    return own.select("doc_id", long("line").alias("line"), "start")


@query(r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).+?(?:[.!?]\s+|$)') AS parts FROM documents WHERE text <> ''),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS k FROM s)
SELECT doc_id, k::bigint AS index, (sum(length(part)) OVER w - length(part))::bigint AS start, (sum(length(part)) OVER w)::bigint AS "end" FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k)""")
def sentence_offsets(spark, sf_dir):
    """Where each sentence begins and ends."""
    own = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.posexplode(text.sentence_spans(F.col("text"))).alias("index", "s"))
    return own.select("doc_id", long("index").alias("index"), long("s.start").alias("start"), long("s.end").alias("end"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
p AS (SELECT *, (sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(x) - 1)::bigint AS place, count(*) FILTER (regexp_matches(x, '[^ \t\r\n]')) OVER (PARTITION BY doc_id ORDER BY n) AS g, max(n) OVER (PARTITION BY doc_id) AS most FROM l),
b AS (SELECT doc_id, g, string_agg(CASE WHEN regexp_matches(x, '[^ \t\r\n]') THEN '' ELSE x END || CASE WHEN n < most THEN chr(10) ELSE '' END, '' ORDER BY n) AS gap, min(n) AS index, min(place) AS char_start FROM p WHERE g > 0 GROUP BY doc_id, g)
SELECT doc_id, index::bigint AS index, char_start, gap FROM b""")
def unit_gaps(spark, sf_dir):
    """Lines as units with offsets, and the text between each and the next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.arrays_zip(F.split("text", "\n", -1).alias("x"), text.line_starts(F.col("text")).alias("at"))).alias("n", "z"))
    units = lines.where(F.col("z.x").rlike(r"[^ \t\r\n]")).select("doc_id", F.col("n").alias("index"), F.col("z.at").cast("int").alias("char_start"), (F.col("z.at") + F.length("z.x")).cast("int").alias("char_end"))
    return documents.with_gaps(units, docs).select("doc_id", long("index").alias("index"), long("char_start").alias("char_start"), "gap")


@query(f"""WITH {UNITS}, t AS (SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN replace(line, 'e', '3') ELSE line END AS hi FROM units)
SELECT doc_id, string_agg(hi, chr(10) ORDER BY i) || chr(10) AS text FROM t GROUP BY doc_id""")
def rebuilt_texts(spark, sf_dir):
    units = documents.line_units(table(spark, sf_dir, "documents")).withColumns({"unit_id": documents.unit_id(F.col("doc_id"), F.col("index")), "gap": F.lit("\n")})
    return documents.reconstruct(units, units.where(F.col("index") % 2 == 0).select("unit_id", F.replace("text", F.lit("e"), F.lit("3")).alias("hi")))


@query("SELECT doc_id::varchar AS doc_id, true AS ordered, true AS whole FROM documents WHERE regexp_matches(text, '[^ \\t\\r\\n]')")
def unit_invariants(spark, sf_dir):
    """Blocks merged, split and grouped into steps still make the text: offsets ordered, units and gaps the whole of it."""
    own = segments.block_arrays(table(spark, sf_dir, "documents").where(has_words()))  # a filter on the units would work them out twice
    merged = own.withColumn("u", segments.merge_units(F.col("u"), F.col("whole"), 30))
    parts = merged.withColumn("u", segments.split_units(F.col("u"), 120))
    out = segments.regrouped(parts, most=300, least=60)
    return out.select("doc_id", "holds.ordered", "holds.whole")


@query()
def merged_units(spark, sf_dir):
    """Dependent siblings merged and lone short units absorbed."""
    own = segments.block_arrays(table(spark, sf_dir, "documents"))
    return own.select("doc_id", F.explode(segments.merge_units(F.col("u"), F.col("whole"), 30)).alias("u")).select("doc_id", "u.index", "u.kind", "u.tokens", F.size("u.merged_from").alias("merged"))


@query()
def split_parts(spark, sf_dir):
    """Oversized units in parts at items or sentences."""
    own = segments.block_arrays(table(spark, sf_dir, "documents")).withColumn("cut", segments.split_units(F.col("u"), 120))
    return own.select("doc_id", F.size("u").alias("units"), F.size("cut").alias("parts"), F.round(segments.split_rate(F.col("u"), F.col("cut")), 6).alias("split_rate"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[^\s]') THEN greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))) ELSE 0 END::bigint AS sentences, regexp_matches(text, ':\s*$') AS colon, coalesce(length(regexp_extract(text, '(?m)^ {0,3}(#{1,6})(?:\s|$)', 1)), 0) AS heading, 0::bigint AS places FROM documents WHERE text IS NOT NULL""")
def fingerprints(spark, sf_dir):
    f = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.fingerprint(F.col("text")).alias("f"))
    return f.select("doc_id", long("f.sentences").alias("sentences"), "f.colon", long("f.heading").alias("heading"), long(F.size("f.placeholders")).alias("places"))


@query()
def validated_units(spark, sf_dir):
    """Why a copy of each turn fails: too little similarity, lost placeholders, loops."""
    t = table(spark, sf_dir, "conversations")
    attempt = F.when(F.col("turn") % 3 == 0, F.regexp_replace("text", "[0-9]", "")).when(F.col("turn") % 3 == 1, F.repeat(F.lit("on and on "), 6)).otherwise(F.col("text"))
    return t.select("conv_id", "turn", blocks.validation(attempt, F.concat(F.col("text"), F.lit(" ⟦0⟧")), F.lit(0.9), 0.5).alias("why"))


# --- tokens -----------------------------------------------------------------------------------------------------------
def ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", word_ids().alias("ids"))


D = f"WITH d AS (SELECT doc_id, {IDS} AS ids FROM documents)"


@query(f"{D} SELECT doc_id, {weigh('list_concat([1], ids)')} AS started, {weigh('CASE WHEN ids[1] = 3 THEN ids ELSE list_concat([3], ids) END')} AS ensured FROM d")
def start_ids(spark, sf_dir):
    return ids(spark, sf_dir).select("doc_id", weighted(tokens.with_start(F.col("ids"), 1)).alias("started"), weighted(tokens.ensure_start(F.col("ids"), 3)).alias("ensured"))


@query(f"{D} SELECT doc_id, {weigh('list_transform(ids, lambda x, i: CASE WHEN i <= 10 THEN x ELSE -100 END)')} AS labels, {weigh('ids[:4 + least(greatest(len(ids) - 4, 0), 20)::int]')} AS cropped FROM d")
def cropped_rows(spark, sf_dir):
    d = ids(spark, sf_dir)
    return d.select("doc_id", weighted(tokens.cut_suffix(F.col("ids"), F.lit(10), tokens.IGNORED)).alias("labels"), weighted(tokens.crop_response(F.col("ids"), F.lit(4), F.lit(20))).alias("cropped"))


@query(f"{D} SELECT doc_id, {weigh('list_concat(ids[:2], list_resize([]::int[], 6, 9))')} AS masks, {weigh('ids[:2]')} AS bare FROM d")
def edit_flow_starts(spark, sf_dir):
    d = ids(spark, sf_dir)
    return d.select("doc_id", weighted(tokens.start_state(F.col("ids"), F.lit(2), 1, tokens.mask_fill(9, 6))).alias("masks"), weighted(tokens.start_state(F.col("ids"), F.lit(2), 1, tokens.empty_fill())).alias("bare"))


@query(f"{D} SELECT doc_id, {weigh('list_transform(ids, lambda x, i: CASE WHEN i <= 3 THEN -100 ELSE x END)')} AS labels, 3 AS prompt_len, {weigh('CASE WHEN ids[1] = 5 THEN ids ELSE list_concat([5], ids) END')} AS whole FROM d")
def sft_rows(spark, sf_dir):
    d = ids(spark, sf_dir).select("doc_id", chat.sft_row(F.col("ids"), F.lit(3)).alias("s"), chat.edit_flow_row(F.col("ids"), F.lit(3), 5, mask_prompt=False).alias("e"))
    return d.select("doc_id", weighted(F.col("s.labels")).alias("labels"), "s.prompt_len", weighted(F.col("e.input_ids")).alias("whole"))


@query(f"""{D}, p AS (SELECT doc_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS k FROM d), r AS (SELECT doc_id, k, x, row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, k) AS n FROM p)
SELECT doc_id, count(*) FILTER (WHERE x > 9) AS over, min(k) FILTER (WHERE n = 1) AS best, count(*) FILTER (WHERE n < coalesce((SELECT min(n) FROM r q WHERE q.doc_id = r.doc_id AND q.n > 1 AND q.x / 10.0 < 1 - 1.5 / (q.n + 1)), 1e9)) AS dynamic FROM r GROUP BY doc_id""")
def committed_places(spark, sf_dir):
    d = ids(spark, sf_dir).where("size(ids) > 0").withColumn("c", F.transform("ids", lambda x: x.cast("double")))
    over = F.when(F.exists("c", lambda x: x > 9), tokens.commit_over(F.col("c"), 9.0)).otherwise(F.array().cast("array<int>"))
    dynamic = tokens.commit_dynamic(F.transform("c", lambda x: x / 10), 1.5)
    return d.select("doc_id", long(F.size(over)).alias("over"), long(F.get(tokens.top_places(F.col("c"), 1), F.lit(0))).alias("best"), long(F.size(dynamic)).alias("dynamic"))


@query(f"""{D}, p AS (SELECT doc_id, unnest(ids) AS x, generate_subscripts(ids, 1) AS k FROM d), m AS (SELECT doc_id, x, k, exp(x - max(x) OVER (PARTITION BY doc_id)) AS e FROM p),
q AS (SELECT doc_id, x, k, e / sum(e) OVER (PARTITION BY doc_id) AS pr, row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, k) AS n FROM m)
SELECT doc_id, (min(k) FILTER (WHERE n = 1) - 1)::bigint AS place, round(max(pr), 5) AS probability, round(sum(pr * ln(pr + 1e-10)), 5) + 0.0 AS negentropy FROM q GROUP BY doc_id""")
def token_choice(spark, sf_dir):
    d = ids(spark, sf_dir).where("size(ids) > 0").select("doc_id", tokens.choice(F.transform("ids", lambda x: x.cast("double"))).alias("c"))
    return d.select("doc_id", long("c.place").alias("place"), F.round("c.probability", 5).alias("probability"), (F.round("c.negentropy", 5) + F.lit(0.0)).alias("negentropy"))


@query(f"{D}, k AS (SELECT doc_id, ids, list_reverse_sort(ids)[least(5, len(ids))] AS least FROM d WHERE len(ids) > 0) SELECT doc_id, len(list_filter(ids, lambda x: x >= least))::bigint AS kept FROM k")
def top_k_filter(spark, sf_dir):
    d = ids(spark, sf_dir).where("size(ids) > 0")
    return d.select("doc_id", long(F.size(F.filter(tokens.top_k_keep(F.col("ids"), 5), lambda x: x))).alias("kept"))


@query(f"""{D}, z AS (SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x % 4 = 0 THEN -1 ELSE x END) AS a, list_transform(ids, lambda x: CASE WHEN x % 3 = 0 THEN -1 ELSE x % 5 END) AS b FROM d),
e AS (SELECT doc_id, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS i FROM z), n AS (SELECT *, (count(*) FILTER (x <> -1) OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS pos FROM e)
SELECT doc_id, string_agg(CASE WHEN x = -1 THEN 'INS ' || greatest(pos, 0) || ' ' || y WHEN y = -1 THEN 'DEL ' || pos ELSE 'SUB ' || pos || ' ' || y END, ',' ORDER BY i) AS edits FROM n WHERE x <> y GROUP BY doc_id""")
def edit_scripts(spark, sf_dir):
    """Every edit with its place and token."""
    z = ids(spark, sf_dir).select("doc_id", F.transform("ids", lambda x: F.when(x % 4 == 0, -1).otherwise(x)).alias("a"), F.transform("ids", lambda x: F.when(x % 3 == 0, -1).otherwise(x % 5)).alias("b"))
    e = z.select("doc_id", tokens.edit_script(F.col("a"), F.col("b")).alias("e")).where("size(e) > 0")
    shown = F.transform("e", lambda e: F.concat_ws(" ", e["kind"], e["pos"].cast("string"), e["token"].cast("string")))
    return e.select("doc_id", F.array_join(shown, ",").alias("edits"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS a, regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '[^A-Za-z ]', '', 'g') AS b FROM conversations)
SELECT conv_id, turn, levenshtein(a, b)::bigint AS edits, length(a) AS source, length(b) AS target FROM t WHERE b IS NOT NULL""")
def aligned_turns(spark, sf_dir):
    """Letters of each turn aligned with those of the next: as few edits as can be, and both sides whole."""
    bare = lambda c: F.regexp_replace(c, "[^A-Za-z ]", "")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", bare(F.col("text")).alias("a"), bare(following).alias("b")).where("b is not null")
    codes = lambda c: F.transform(F.regexp_extract_all(c, F.lit("."), F.lit(0)), lambda x: F.ascii(x))
    z = t.select("conv_id", "turn", tokens.align_udf()(codes(F.col("a")), codes(F.col("b"))).alias("z"))
    return z.select("conv_id", "turn", long(F.size(tokens.edit_script(F.col("z.source"), F.col("z.target")))).alias("edits"), long(F.size(tokens.strip_blanks(F.col("z.source")))).alias("source"), long(F.size(tokens.strip_blanks(F.col("z.target")))).alias("target"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT n_chars AS n FROM documents WHERE n_chars IS NOT NULL), w AS (SELECT n, n AS left_, 8 AS t, 0 AS steps, ''::varchar AS shown FROM n
UNION ALL SELECT n, left_ - round_even(left_ * (1 - (1 - (1 - (t - 1) / 8.0::double)) / (1 - (1 - t / 8.0::double))), 0)::bigint, t - 1, steps, shown || CASE WHEN round_even(left_ * (1 - (1 - (1 - (t - 1) / 8.0::double)) / (1 - (1 - t / 8.0::double))), 0) > 0 THEN round_even(left_ * (1 - (1 - (1 - (t - 1) / 8.0::double)) / (1 - (1 - t / 8.0::double))), 0)::bigint::varchar || ',' ELSE '' END FROM w WHERE t > 0)
SELECT d.doc_id, shown FROM w JOIN documents d ON d.n_chars = w.n WHERE t = 0""")
def transfer_schedule(spark, sf_dir):
    """Each document's characters filled in eight steps."""
    out = table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", schedules.transfer_steps(F.col("n_chars"), 8).alias("s"))
    return out.select("doc_id", F.concat_ws("", F.transform("s", lambda x: F.concat(x.cast("string"), F.lit(",")))).alias("shown"))


@query(f"{D} SELECT doc_id, {weigh('list_transform(ids, lambda x, i: list_sum(ids[:i]))')} AS totals FROM d")
def running_totals(spark, sf_dir):
    return ids(spark, sf_dir).select("doc_id", weighted(running_total(F.col("ids"))).alias("totals"))


# --- measures ---------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'eval' END AS split, avg(value) AS mean, count(*)::double AS n FROM events GROUP BY 1)
SELECT CASE split WHEN 'train' THEN m ELSE split || '_' || m END AS metric, round(CASE m WHEN 'mean' THEN mean ELSE n END, 6) AS value FROM s, (SELECT unnest(['mean', 'n']) AS m)""")
def split_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("split", F.when(F.col("user_id") % 2 == 0, "train").otherwise("eval"))
    return measures.split_metrics(e, "split", {"mean": F.avg("value"), "n": F.count(F.lit(1))}).select("metric", F.round("value", 6).alias("value"))


@query("SELECT user_id, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS ratio FROM events GROUP BY user_id")
def pass_ratios(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") == "error")
    return measures.pass_ratio(e, "user_id", "ok").select("user_id", F.round("ratio", 6).alias("ratio"))


@query("SELECT l_orderkey, round(avg(l_extendedprice * l_discount), 8) AS loss FROM lineitem GROUP BY l_orderkey")
def trial_means(spark, sf_dir):
    return measures.trial_mean(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_extendedprice"), F.col("l_discount")).select("l_orderkey", F.round("loss", 8).alias("loss"))


@query(f"SELECT source, greatest(16, least(960, round_even(max(len({IDS})) * 2.5, 0)))::bigint AS canvas FROM documents GROUP BY source")
def canvas_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.size(word_ids()).alias("n"))
    return measures.canvas_size(d, "source", "n", most=960).select("source", long("canvas").alias("canvas"))


@query("SELECT round(avg(CASE WHEN s <= 1e-8 THEN 1.0 ELSE 0.0 END), 6) AS flat_share FROM (SELECT coalesce(stddev_samp(l_tax), 0) AS s FROM lineitem GROUP BY l_orderkey, l_returnflag)")
def flat_share(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("g", F.concat_ws("/", "l_orderkey", "l_returnflag"))
    return measures.flat_groups(items, "g", "l_tax").select(F.round("flat_share", 6).alias("flat_share"))


@query("SELECT l_orderkey % 50 AS g, min(l_quantity)::int AS shortest, count(*) AS n FROM lineitem GROUP BY 1")
def group_crops(spark, sf_dir):
    """A group's kept length is one of its own, and its tail is cut below the shortest."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("g"), F.col("l_quantity").cast("int").alias("n"), F.lit(0).alias("p"), F.col("l_partkey").alias("k"))
    own = measures.group_crop(items, "g", "n", "p", "k")
    ok = F.assert_true((F.col("kept_len") >= F.col("shortest")) & (F.col("tail") < F.greatest(F.col("shortest"), F.lit(1))))
    both = own.join(items.groupBy("g").agg(F.min("n").alias("shortest"), F.count(F.lit(1)).alias("n")), "g").withColumn("ok", ok)
    return both.where("ok is null").select("g", "shortest", "n")


@query("SELECT split, count(*) AS rows FROM (SELECT CASE WHEN row_number() OVER () <= round(count(*) OVER () * 0.1) THEN 'test' ELSE 'train' END AS split FROM orders) GROUP BY split")
def ratio_split_counts(spark, sf_dir):
    return sampling.ratio_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.1, seed=3).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'eval' ELSE 'train' END AS split FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def held_out_table(spark, sf_dir):
    return sampling.external_split(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 0.1).select("doc_id", "split")


@query("SELECT (row_number() OVER (ORDER BY n_chars) - 1) // 16 AS bucket, n_chars FROM documents")
def length_buckets(spark, sf_dir):
    return sampling.length_buckets(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 16).select(long("bucket").alias("bucket"), "n_chars")


# --- sources, sinks and streams ---------------------------------------------------------------------------------------
@query("SELECT doc_id, lang, length(text) AS chars FROM documents WHERE lang IS NOT NULL")
def json_lines(spark, sf_dir):
    """Written as JSON lines and read by the tolerant scan, which leaves out rows without the key."""
    path = sinks.scratch(spark, "json-lines")
    sinks.overwrite_json(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return readers.read_tolerant(spark, path, "doc_id long, lang string, text string", "lang").select("doc_id", "lang", long(F.length("text")).alias("chars"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def translated_lines(spark, sf_dir):
    path = sinks.scratch(spark, "translated")
    sinks.append_json(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return readers.read_translated(spark, path, "doc_id long, text string", "text").select("doc_id", "text")


@query("SELECT lpad(o_orderkey::varchar, 12, '0') AS code, o_orderstatus AS status FROM orders")
def csv_codes(spark, sf_dir):
    path = sinks.scratch(spark, "codes")
    rows = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("code"), F.col("o_orderstatus").alias("status"))
    rows.write.mode("overwrite").option("header", True).csv(path)
    return readers.read_strings_csv(spark, path, ["code", "status"])


@query("SELECT user_id::varchar AS custom_id, trim(event_type) AS content FROM events WHERE event_type <> 'error'")
def batch_answers(spark, sf_dir):
    """Answers of a batch job: those with an error are left out."""
    e = table(spark, sf_dir, "events")
    body = F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit(" "), F.col("event_type")).alias("content")).alias("message"))).alias("choices")).alias("body"))
    path = sinks.scratch(spark, "answers")
    sinks.overwrite_json(e.select(F.col("user_id").cast("string").alias("custom_id"), F.when(F.col("event_type") == "error", "failed").alias("error"), body.alias("response")), path)
    return readers.read_batch_results(spark, path)


@query("SELECT doc_id, source AS config FROM documents WHERE source IS NOT NULL")
def config_folders(spark, sf_dir):
    base = sinks.scratch(spark, "configs")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    names = sorted(r["source"] for r in docs.where("source is not null").select("source").distinct().collect())  # a row for each source
    for c in names:
        docs.where(F.col("source") == c).select("doc_id").write.mode("overwrite").parquet(f"{base}/{c}")
    return readers.read_configs(spark, base, names)


@query("SELECT 'fr' AS split, count(*) AS rows FROM documents WHERE lang = 'fr'")
def split_folders(spark, sf_dir):
    """A folder for each split, of which only one is read again."""
    path = sinks.scratch(spark, "splits")
    sinks.write_splits(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split")), path)
    return spark.read.parquet(path).where("split = 'fr'").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT user_id, max(event_id) AS event_id, count(*) AS versions FROM events GROUP BY user_id")
def ledger_versions(spark, sf_dir):
    """Versions appended one after the other, of which the last is read."""
    path = sinks.scratch(spark, "ledger")
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    for part in (0, 1):
        own = e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("versions")) if part else e.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.lit(0).cast("long").alias("versions"))
        sinks.update_ledger(e, path, own)
    return sinks.read_ledger(spark.read.parquet(path), "user_id").select("user_id", "event_id", "versions")


@query("SELECT source, docs, chars FROM (SELECT source, count(*) AS docs, sum(n_chars)::bigint AS chars FROM documents GROUP BY source) ORDER BY source")
def published_counts(spark, sf_dir):
    path = sinks.scratch(spark, "published")
    sinks.publish(table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("num_steps")), path, "documents")
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("num_steps").alias("chars"))


@query("SELECT DISTINCT doc_id, lang FROM documents")
def stream_appends(spark, sf_dir):
    """A file stream into one table: a second run finds half of the rows once more and the others new, a third one nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    source, target, checkpoint = (sinks.scratch(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    for part in (docs.where("doc_id % 2 = 0"), docs, None):
        if part is not None:
            part.write.mode("append").parquet(source)
        incremental.append_new(incremental.read(spark, source, "doc_id long, lang string", True), target, checkpoint, "doc_id").awaitTermination()
    return spark.read.parquet(target)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k BETWEEN 11 AND 40")
def stream_slices(spark, sf_dir):
    """Thirty documents of each language after the first ten, counted over three triggers of a stream."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    source, target, checkpoint = (sinks.scratch(spark, f"slices-{x}") for x in ("in", "out", "checkpoint"))
    cuts = docs.agg(F.percentile_approx("doc_id", [0.01, 0.05], 10_000).alias("c")).first()["c"]
    for own in (F.col("doc_id") <= cuts[0], (F.col("doc_id") > cuts[0]) & (F.col("doc_id") <= cuts[1]), F.col("doc_id") > cuts[1]):
        docs.where(own).coalesce(1).write.mode("append").parquet(source)
    stream = incremental.take_after(incremental.read(spark, source, "lang string, doc_id long", True, files_per_batch=1), "lang", "doc_id", 10, 30)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("lang string, doc_id long").parquet(target)


def job_rounds(spark, sf_dir):
    """Three rounds of transitions for a job of each user: submitted; ended by its owner or, in vain, by another; tried again."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("ts")).select(F.col("user_id").cast("string").alias("job_id"), F.col("user_id").alias("u"), F.col("ts").cast("timestamp").alias("ts"))

    def moves(status, owner, hours):
        at = F.col("ts") + F.make_interval(hours=F.lit(hours))
        return users.select("job_id", status.alias("status"), owner.alias("owner"), (at + F.make_interval(hours=F.lit(2))).alias("lease_until"), at.alias("at"), "u")

    ended = F.when(F.col("u") % 3 == 1, "failed").otherwise("completed")
    return [
        moves(F.lit("submitted"), F.lit("first"), 0), moves(ended, F.when(F.col("u") % 3 == 2, "other").otherwise("first"), 1),
        moves(F.lit("submitted"), F.lit("late"), 3).where("u % 2 = 0").unionByName(moves(F.lit("submitted"), F.lit("early"), 1).where("u % 2 = 1")),
    ]


# completed jobs stay so; failed ones are submitted again by anyone; those that another wanted to end are free only once their lease has lapsed
JOBS = "SELECT DISTINCT user_id::varchar AS job_id, user_id AS u FROM events"


@query(f"""WITH j AS ({JOBS}) SELECT job_id, CASE WHEN u % 3 = 0 THEN 'completed' ELSE 'submitted' END AS status,
  CASE WHEN u % 3 = 0 THEN 'first' WHEN u % 2 = 0 THEN 'late' WHEN u % 3 = 1 THEN 'early' ELSE 'first' END AS owner, CASE WHEN u % 3 = 0 THEN 2 WHEN u % 3 = 1 OR u % 2 = 0 THEN 3 ELSE 1 END::bigint AS version FROM j""")
def job_states(spark, sf_dir):
    """The state of every job after three rounds, from the ledger's versions."""
    ledger = jobs.Ledger(spark, sinks.scratch(spark, "jobs"))
    for wanted in job_rounds(spark, sf_dir):
        ledger.apply(wanted)
    return ledger.state().select("job_id", "status", "owner", "version")


@query(f"""WITH j AS ({JOBS}) SELECT job_id, 'completed' AS status, 'other' AS owner, 'submitted' AS before FROM j WHERE u % 3 = 2
UNION ALL SELECT job_id, 'submitted', CASE WHEN u % 2 = 0 THEN 'late' ELSE 'early' END, CASE WHEN u % 3 = 0 THEN 'completed' ELSE 'submitted' END FROM j WHERE u % 3 = 0 OR u % 3 = 2 AND u % 2 = 1""")
def job_refusals(spark, sf_dir):
    """Transitions that the ledger refused, with the state that they met."""
    ledger, refused = jobs.Ledger(spark, sinks.scratch(spark, "jobs")), []
    for wanted in job_rounds(spark, sf_dir):
        _, judged = ledger.apply(wanted)
        refused.append(judged.where("not ok").select("job_id", "status", "owner", "before"))
    return refused[0].unionByName(refused[1]).unionByName(refused[2])


@query("""WITH s AS (SELECT doc_id, 'shard=' || (doc_id % 16) AS shard, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) - 1 AS i FROM documents),
drawn AS (SELECT shard FROM (SELECT DISTINCT shard FROM s) ORDER BY md5('5:' || shard), shard LIMIT 4)
SELECT doc_id, shard, i AS row_index FROM s WHERE shard IN (SELECT shard FROM drawn) ORDER BY md5('5:' || shard || ':' || i), shard, i LIMIT 100""")
def shard_sample(spark, sf_dir):
    """A hundred rows of four of sixteen shards; the other files aren't read."""
    path = sinks.scratch(spark, "shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(16)).alias("shard"))
    docs.repartition("shard").sortWithinPartitions("shard", "doc_id").write.option("maxRecordsPerFile", 0).partitionBy("shard").parquet(path)
    return sampling.sample_shards(spark, path, 100, 50, seed=5, name=r"shard=\d+").select("doc_id", "shard", "row_index")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    """Counts in windows of event time, as a table; the same plan runs on a stream."""
    out = incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "6 hours", "event_type")
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT event_id, (1000 // user_id)::varchar AS value FROM events WHERE user_id <> 0")
def quarantined_rows(spark, sf_dir):
    """Rows whose work fails go aside; here the good ones."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("v"))
    good, _ = incremental.quarantine(e, incremental.guarded(lambda v: str(1000 // int(v)))(F.col("v")), "value")
    return good.select("event_id", "value")


@query("SELECT doc_id, lang FROM documents WHERE source IS NOT NULL")
def streams_together(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = sorted(r["source"] for r in docs.where("source is not null").select("source").distinct().collect())  # a row for each source
    return sampling.streams_together([docs.where(F.col("source") == s).select("doc_id", "lang") for s in names])


# --- scores -----------------------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT o_orderkey, lpad((o_orderkey % 10000)::varchar, 16, '0') AS puzzle, lpad((o_custkey * 7919 % 1000000)::varchar, 16, '1234') AS solution, lpad((o_orderkey * 31 % 1000000)::varchar, 16, '1234') AS answer FROM orders),
c AS (SELECT o_orderkey, count(*) FILTER (WHERE substr(puzzle, i::int, 1) = '0') AS open_, count(*) FILTER (WHERE substr(puzzle, i::int, 1) = '0' AND substr(solution, i::int, 1) = substr(answer, i::int, 1)) AS good FROM p, range(1, 17) r(i) GROUP BY o_orderkey)
SELECT o_orderkey, round(CASE WHEN open_ = 0 THEN 0.0 ELSE good / open_ END, 6) AS score FROM c""")
def sudoku_scores(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pad = lambda c, fill: F.lpad(c.cast("string"), 16, fill)
    p = table(spark, sf_dir, "orders").select("o_orderkey", pad(key % 10_000, "0").alias("puzzle"), pad(cust * 7919 % 1_000_000, "1234").alias("solution"), F.concat(F.lit("x <answer> "), pad(key * 31 % 1_000_000, "1234"), F.lit(" </answer>")).alias("t"))
    return p.select("o_orderkey", F.round(rewards.sudoku(F.col("t"), F.col("puzzle"), F.col("solution")), 6).alias("score"))


@query(r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN o_clerk_box ELSE '\boxed{1} ' END || CASE o_custkey % 3 WHEN 0 THEN '<answer>' WHEN 1 THEN 'answer: ' ELSE '<answer> ' END || CASE o_orderkey % 5 WHEN 0 THEN '\boxed{' || o_custkey || '}' WHEN 1 THEN 'boxed' ELSE o_custkey::varchar END || CASE o_custkey % 2 WHEN 0 THEN '</answer>' ELSE '' END || CASE o_orderkey % 7 WHEN 0 THEN ' \boxed{2}' ELSE '' END AS t
  FROM (SELECT o_orderkey, o_custkey, o_orderpriority || ' ' AS o_clerk_box FROM orders)),
i AS (SELECT o_orderkey, t, CASE WHEN contains(t, '<answer>') THEN string_split(string_split(t, '<answer>')[2], '</answer>')[1] ELSE t END AS inner_ FROM t)
SELECT o_orderkey, 0.5::double * (contains(t, '<answer>')::int + CASE WHEN contains(inner_, '\boxed') THEN 1.0::double ELSE 0.5 END) AS score FROM i""")
def boxed_scores(spark, sf_dir):
    """Boxes before, inside and after an answer, with and without its tags."""
    key, cust, box = F.col("o_orderkey"), F.col("o_custkey"), F.lit("\\boxed{")
    before = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat("o_orderpriority", F.lit(" "))).otherwise("\\boxed{1} ")
    tag = F.when(cust % 3 == 0, "<answer>").when(cust % 3 == 1, "answer: ").otherwise("<answer> ")
    inside = F.when(key % 5 == 0, F.concat(box, cust.cast("string"), F.lit("}"))).when(key % 5 == 1, "boxed").otherwise(cust.cast("string"))
    t = F.concat(before, tag, inside, F.when(cust % 2 == 0, "</answer>").otherwise(""), F.when(key % 7 == 0, " \\boxed{2}").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", rewards.boxed_format(t).alias("score"))


# two small numbers, of which an answer makes another one by five rules; the last answer counts
@query("""WITH n AS (SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 4 AS b, o_orderkey % 6 AS k, (o_orderkey + o_custkey) % 5 AS target FROM orders),
v AS (SELECT *, CASE k WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * b WHEN 3 THEN b - a * a END AS value FROM n)
SELECT o_orderkey, CASE WHEN k = 5 THEN 0.0::double WHEN k = 4 THEN 0.1 WHEN k = 3 THEN 0.1 WHEN value = target THEN 1.0 ELSE 0.1 END AS score FROM v""")
def countdown_scores(spark, sf_dir):
    """Right and wrong values, a number too often, a word in it, no answer."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    a, b, k = (key % 4).cast("string"), (cust % 4).cast("string"), key % 6
    said = F.when(k == 0, F.concat(a, F.lit("+"), b)).when(k == 1, F.concat(a, F.lit(" - "), b)).when(k == 2, F.concat(F.lit("("), b, F.lit(")*("), a, F.lit(")"))).when(k == 3, F.concat(b, F.lit("-"), a, F.lit("*"), a)).otherwise(F.concat(a, F.lit(" plus "), b))
    t = F.when(k == 5, said).otherwise(F.concat(F.lit("<answer>0</answer> no: <answer>"), said, F.lit("</answer>")))
    return table(spark, sf_dir, "orders").select("o_orderkey", rewards.countdown(t, (key + cust) % 5, F.array(key % 4, cust % 4)).alias("score"))


@query("SELECT p_partkey, 'go_' || p_partkey::varchar AS name, 'def go_' || p_partkey::varchar || '(x):' || chr(10) || '    return x' || chr(10) AS code, 0.5::double AS inside, 2::bigint AS tests FROM part")
def code_parts(spark, sf_dir):
    """Code cut out of an answer, its function renamed as the tests want, and the tests as functions. Nothing is executed."""
    name = F.concat(F.lit("go_"), F.col("p_partkey").cast("string"))
    tests = F.concat(F.lit("assert "), name, F.lit("(1) == 1\n\n  assert "), name, F.lit("(2) == 2\n"))
    answer = F.lit("<answer>```python\ndef own(x):\n    return x\n```</answer>")
    rows = table(spark, sf_dir, "part").select("p_partkey", answer.alias("a"), tests.alias("t"))
    wanted = rewards.tested_name(F.col("t"))
    return rows.select("p_partkey", wanted.alias("name"), rewards.renamed_code(rewards.fenced_code(F.col("a")), wanted).alias("code"), rewards.code_in_answer(F.col("a")).alias("inside"), long(F.size(rewards.split_tests(F.col("t")))).alias("tests"))
