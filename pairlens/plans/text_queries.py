"""Registered queries on prompts, texts, transport events and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions import text as X
from pairlens.functions.ordering import row_index
from pairlens.operators import prompts as T
from pairlens.operators import transport as N
from pairlens.plans.pairwise_queries import rounded
from pairlens.plans.quality_queries import UNITS_SQL
from pairlens.plans.registry import Tables, query, r6
from pairlens.plans.views import file_key, text_pack
from pairlens.sources import files as S

SEED = 20260908
PROMPT_COLUMNS = [
    "concat(lang, '-', source, '_', CAST(doc_id AS VARCHAR(20))) AS prompt_id",
    "lang AS benchmark",
    "source AS category",
    "text AS prompt_text",
    "CASE WHEN doc_id % 4 = 0 THEN concat('[\"Write about ', CAST(n_chars AS VARCHAR(20)), ' words.\"]') WHEN doc_id % 4 = 1 THEN '[\"At most 1,200-words, or 900 tokens\"]' ELSE '[]' END AS constraints_json",
    "doc_id",
    "n_chars",
]
PROMPTS_SQL = "prompts AS (SELECT " + ", ".join(PROMPT_COLUMNS) + " FROM documents)"


def prompts(t: Tables) -> DataFrame:
    return t.documents.selectExpr(*[c.replace('\\"', '"') for c in PROMPT_COLUMNS])


def count_re(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


WORDS_SQL = count_re("prompt_text", f"[^{X.SPACE}]+")
REQ_SQL = (
    f"coalesce(list_max(list_transform(list_concat(regexp_extract_all(prompt_text, '{X.REQUESTED_LENGTH}', 1), "
    f"regexp_extract_all(constraints_json, '{X.REQUESTED_IN_JSON}', 1)), lambda m: CAST(replace(m, ',', '') AS BIGINT))), 0)"
)


@query("output_units", f"SELECT doc_id, CAST({UNITS_SQL} AS BIGINT) AS units FROM documents")
def output_units(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.output_units(F.col("text")).cast("bigint").alias("units"))


@query("word_count", f"SELECT lang, CAST(sum({count_re('text', f'[^{X.SPACE}]+')}) AS BIGINT) AS words FROM documents GROUP BY lang")
def word_count(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.sum(X.word_count(F.col("text")).cast("bigint")).alias("words"))


@query("requested_length", f"WITH {PROMPTS_SQL} SELECT doc_id, {REQ_SQL} AS requested FROM prompts")
def requested_length(t: Tables) -> DataFrame:
    found = X.requested_length(F.col("prompt_text"), F.col("constraints_json"))
    return prompts(t).select("doc_id", found.alias("requested"))


CHINESE_SQL = f"{count_re('prompt_text', f'[{X.HAN}]')} > {count_re('prompt_text', '[A-Za-z]')}"


@query("is_chinese", f"WITH {PROMPTS_SQL} SELECT doc_id, CAST({CHINESE_SQL} AS INTEGER) AS chinese FROM prompts")
def is_chinese(t: Tables) -> DataFrame:
    return prompts(t).select("doc_id", X.is_chinese(F.col("prompt_text")).cast("int").alias("chinese"))


@query(
    "language_count",
    f"""WITH {PROMPTS_SQL} SELECT coalesce(benchmark, 'all') AS benchmark, count(*) AS prompts, count(*) FILTER ({CHINESE_SQL}) AS chinese
    FROM prompts GROUP BY ROLLUP (benchmark)""",
)
def language_count(t: Tables) -> DataFrame:
    return T.language_count(prompts(t))


@query("sha256_hex", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_hex(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.sha256_hex(F.col("text")).alias("digest"))


@query(
    "canonical_row_hash",
    """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS hash FROM documents""",
)
def canonical_row_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.row_hash(["doc_id", "source", "lang", "n_chars"]).alias("hash"))


@query("blind_id", "SELECT doc_id, 'blind-' || substr(sha256(source), 1, 16) AS blind FROM documents")
def blind_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.blind_id(F.col("source")).alias("blind"))


PAIR_ID_SQL = "'pair-' || substr(sha256(least(lang, source) || '|' || greatest(lang, source)), 1, 16)"


@query("pair_id", f"SELECT doc_id, {PAIR_ID_SQL} AS pair FROM documents")
def pair_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.pair_id(F.col("source"), F.col("lang")).alias("pair"))


@query(
    "presentation_order",
    f"""SELECT doc_id, CASE WHEN ('0x' || right(sha256(CAST(doc_id AS VARCHAR) || ':' || {PAIR_ID_SQL}), 1))::BIGINT % 2 = 0 THEN 'A|B' ELSE 'B|A' END AS first_order FROM documents""",
)
def presentation_order(t: Tables) -> DataFrame:
    pair = X.pair_id(F.col("source"), F.col("lang"))
    return t.documents.select(
        "doc_id", X.presentation_order(pair, F.col("doc_id").cast("string")).alias("first_order")
    )


@query("prompt_category", f"WITH {PROMPTS_SQL} SELECT category AS prompt_category, count(*) AS n FROM prompts GROUP BY ALL")
def prompt_category(t: Tables) -> DataFrame:
    return prompts(t).groupBy(X.prompt_category(F.col("prompt_id")).alias("prompt_category")).agg(
        F.count(F.lit(1)).alias("n")
    )


LIKERT_CASE = " ".join(f"WHEN {v} THEN '{k}'" for k, v in X.LIKERT.items())


@query(
    "likert",
    "SELECT CAST(l_linenumber AS INTEGER) AS likert, count(*) AS n FROM lineitem WHERE l_quantity <> 5 GROUP BY ALL",
)
def likert(t: Tables) -> DataFrame:
    name = F.expr(f"CASE WHEN l_quantity = 5 THEN 'UNSURE' ELSE CASE l_linenumber {LIKERT_CASE} END END")
    rated = t.lineitem.select(X.likert(name).alias("likert")).filter("likert IS NOT NULL")
    return rated.groupBy("likert").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_offset_ts",
    """SELECT event_type, count(*) FILTER (event_id % 3 <> 0) AS parsed, count(*) FILTER (event_id % 3 = 0) AS naive,
      CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN epoch_us(ts) % 1000000 ELSE epoch_us(ts - INTERVAL 2 HOUR) // 3600000000 % 24 END) AS BIGINT) AS marks
    FROM events GROUP BY ALL""",
)
def parse_offset_ts(t: Tables) -> DataFrame:
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, shown).when(kind == 1, F.concat(shown, F.lit("Z"))).otherwise(
        F.concat(shown, F.lit("+02:00"))
    )
    at = F.unix_micros(X.parse_offset_timestamp(text))
    mark = F.when(at.isNull(), 0).when(kind == 1, at % 1000000).otherwise(F.floor(at / 3600000000) % 24)
    return t.events.groupBy("event_type").agg(
        F.count(at).alias("parsed"),
        F.count_if(at.isNull()).alias("naive"),
        F.sum(mark.cast("bigint")).alias("marks"),
    )


@query(
    "parse_utc_ts",
    """SELECT event_type, CAST(sum(CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000000 % 86400 WHEN 1 THEN epoch_us(ts) // 1000000 % 86400 ELSE epoch_us(ts - INTERVAL 2 HOUR) // 1000000 % 86400 END) AS BIGINT) AS seconds
    FROM events GROUP BY ALL""",
)
def parse_utc_ts(t: Tables) -> DataFrame:
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, shown).when(kind == 1, F.concat(shown, F.lit("Z"))).otherwise(
        F.concat(shown, F.lit("+02:00"))
    )
    seconds = F.floor(F.unix_micros(X.parse_utc_timestamp(text)) / 1e6) % 86400
    return t.events.groupBy("event_type").agg(F.sum(seconds.cast("bigint")).alias("seconds"))


@query("event_name", "SELECT trim(regexp_replace(lower(c_name || '--' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS name, c_custkey FROM customer")
def event_name(t: Tables) -> DataFrame:
    name = X.event_name(F.concat_ws("--", "c_name", "c_mktsegment"))
    return t.customer.select("c_custkey", name.alias("name"))


@query(
    "numbered_list",
    """SELECT doc_id, md5(list_aggregate(list_transform(string_split(text, '. '), lambda x, i: i || '. ' || replace(x, chr(10), chr(10) || '   ')), 'string_agg', chr(10))) AS listed
    FROM documents""",
)
def numbered_list(t: Tables) -> DataFrame:
    """The sentences of a text as a numbered list."""
    listed = X.numbered_list(F.split("text", r"\. "))
    return t.documents.select("doc_id", F.md5(listed).alias("listed"))


# Identity strings replaced and searched by the redaction queries
REPLACEMENTS = {"example.com": "host.invalid", "the ": "xx ", "Ou": "zz"}
LEAK_TERMS = ("example.net", "DOCTYPE", "track(", "de/")


@query(
    "redact_terms",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'example\\.com', 'host.invalid', 'gi'), 'the ', 'xx ', 'gi'), 'ou', 'zz', 'gi')) AS digest FROM documents""",
)
def redact_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.redact(F.col("text"), REPLACEMENTS)).alias("digest"))


@query(
    "leak_scan",
    f"""WITH terms(term) AS (VALUES {', '.join(f"('{x}')" for x in LEAK_TERMS)}),
    hits AS (SELECT page_id, term, strpos(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), lower(term)) AS at_pos, html, url FROM pages, terms)
    SELECT url AS path, term, CAST(CASE WHEN at_pos > 0 THEN length(html[:at_pos - 1]) - length(replace(html[:at_pos - 1], chr(10), '')) + 1 ELSE 0 END AS BIGINT) AS line
    FROM hits WHERE at_pos > 0 OR contains(lower(url), lower(term))""",
)
def leak_scan(t: Tables) -> DataFrame:
    files = t.pages.select(F.col("url").alias("path"), F.col("html").alias("text"))
    return T.leak_scan(files, LEAK_TERMS)


# --- prompt sets --------------------------------------------------------------


def md5_rank(partition: str, k: int) -> str:
    over = f"PARTITION BY {partition} " if partition else ""
    return f"row_number() OVER ({over}ORDER BY md5('{SEED}:' || prompt_id), prompt_id) <= {k}"


@query("sample_k", f"WITH {PROMPTS_SQL} SELECT benchmark, prompt_id FROM prompts QUALIFY {md5_rank('benchmark', 10)}")
def sample_k(t: Tables) -> DataFrame:
    return T.sample_k(prompts(t), "prompt_id", 10, SEED, ["benchmark"]).select("benchmark", "prompt_id")


@query("sample_k_per_group", f"WITH {PROMPTS_SQL} SELECT category, prompt_id FROM prompts QUALIFY {md5_rank('category', 2)}")
def sample_k_per_group(t: Tables) -> DataFrame:
    return T.sample_k(prompts(t), "prompt_id", 2, SEED, ["category"]).select("category", "prompt_id")


HARD_SQL = f"""{PROMPTS_SQL}, pilot AS (SELECT prompt_id FROM prompts QUALIFY {md5_rank('benchmark', 10)}),
scored AS (SELECT benchmark, prompt_id, CAST({WORDS_SQL} AS BIGINT) AS words, {REQ_SQL} AS requested FROM prompts
  WHERE prompt_id NOT IN (SELECT prompt_id FROM pilot)),
hard AS (SELECT benchmark, prompt_id, words + requested AS score, words, requested, CAST(row_number() OVER (PARTITION BY benchmark
  ORDER BY words + requested DESC, words DESC, requested DESC, prompt_id DESC) AS INTEGER) AS rank FROM scored
  WHERE words <= 6000 AND requested <= 6000)"""


def pilot(t: Tables) -> DataFrame:
    return T.sample_k(prompts(t), "prompt_id", 10, SEED, ["benchmark"]).select("prompt_id")


@query("hard_prompts", f"WITH {HARD_SQL} SELECT * FROM hard WHERE rank <= 100")
def hard_prompts(t: Tables) -> DataFrame:
    return T.hard_prompts(prompts(t), pilot(t))


@query(
    "except_pilot",
    f"""WITH {PROMPTS_SQL}, pilot AS (SELECT prompt_id FROM prompts QUALIFY {md5_rank('benchmark', 10)})
    SELECT benchmark, count(*) AS prompts FROM prompts WHERE prompt_id NOT IN (SELECT prompt_id FROM pilot) GROUP BY ALL""",
)
def except_pilot(t: Tables) -> DataFrame:
    left = prompts(t).join(pilot(t), "prompt_id", "left_anti")
    return left.groupBy("benchmark").agg(F.count(F.lit(1)).alias("prompts"))


@query(
    "union_sources",
    """SELECT source_table, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
      SELECT 'documents' AS source_table, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
      UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY ALL""",
)
def union_sources(t: Tables) -> DataFrame:
    of = lambda df, name: df.select(F.lit(name).alias("source_table"), "text")
    rows = of(t.documents, "documents").unionByName(of(t.benchmark, "benchmark")).unionByName(
        of(t.conversations, "conversations")
    )
    return rows.groupBy("source_table").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars")
    )


@query(
    "tertiles",
    f"""WITH {PROMPTS_SQL}, l AS (SELECT benchmark, prompt_id, {WORDS_SQL} AS words FROM prompts)
    SELECT benchmark, prompt_id, CAST(least((row_number() OVER (PARTITION BY benchmark ORDER BY words, prompt_id) - 1) * 3
      // count(*) OVER (PARTITION BY benchmark), 2) AS INTEGER) AS tertile FROM l""",
)
def tertiles(t: Tables) -> DataFrame:
    sized = prompts(t).select("benchmark", "prompt_id", X.word_count(F.col("prompt_text")).alias("words"))
    return T.tertiles(sized, ["benchmark"], "words", "prompt_id", prefix=8).select("benchmark", "prompt_id", "tertile")


@query(
    "build_prompt_rows_writing",
    "SELECT 'writingbench-' || lpad(CAST(item_id AS VARCHAR), CAST(greatest(4, length(CAST(item_id AS VARCHAR))) AS INTEGER), '0') AS prompt_id, md5(text) AS text_digest, 1 AS constraints, 2 AS criteria FROM benchmark",
)
def build_prompt_rows_writing(t: Tables) -> DataFrame:
    source = t.benchmark.select(
        F.col("item_id").alias("index"), F.col("text").alias("query"), F.array(F.lit("a"), F.lit("b")).alias("checklist")
    )
    return T.writing_rows(source).select(
        "prompt_id",
        F.md5("prompt_text").alias("text_digest"),
        F.size("requested_output_constraints").alias("constraints"),
        F.size("native_payload").alias("criteria"),
    )


@query(
    "build_prompt_rows_checklist",
    """WITH rows AS (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + conv_id * 100 + turn, text FROM conversations)
    SELECT 'hellobench-' || doc_id AS prompt_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS constraints,
      CASE WHEN doc_id % 5 = 0 THEN 'checklists' WHEN doc_id % 7 = 0 THEN 'num_checklist' END AS reject_reason FROM rows""",
)
def build_prompt_rows_checklist(t: Tables) -> DataFrame:
    def source(df: DataFrame, id_column) -> DataFrame:
        rows = df.select(id_column.alias("n"), F.col("text").alias("instruction"))
        good = F.array(F.lit("one"), F.lit("two"))
        return rows.select(
            F.col("n").cast("string").alias("id"),
            "instruction",
            F.when(F.col("n") % 3 == 0, F.array(F.lit("be brief"), F.lit("be kind"))).alias("requirements"),
            F.when(F.col("n") % 5 == 0, F.array(F.lit("one"), F.lit(" "))).otherwise(good).alias("checklists"),
            F.when(F.col("n") % 7 == 0, 3).otherwise(2).cast("bigint").alias("num_checklist"),
        )

    files = [
        source(t.documents, F.col("doc_id")),
        source(t.conversations, F.lit(1000000000) + F.col("conv_id") * 100 + F.col("turn")),
    ]
    return T.checklist_rows(files).select(
        "prompt_id", F.size("requested_output_constraints").alias("constraints"), "reject_reason"
    )


@query(
    "build_prompt_rows_task",
    """SELECT 'dolomites-' || doc_id AS prompt_id, md5('Task objective:' || chr(10) || lang || chr(10) || chr(10) || 'Task procedure/context:' || chr(10) || source
      || chr(10) || chr(10) || 'Input specification:' || chr(10) || n_chars || chr(10) || chr(10) || 'Supplied input:' || chr(10) || text) AS digest,
      CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 3 END AS constraints FROM documents WHERE doc_id % 2 = 0""",
)
def build_prompt_rows_task(t: Tables) -> DataFrame:
    source = t.documents.select(
        F.col("doc_id").cast("string").alias("example_id"),
        F.col("text").alias("example_input"),
        F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test").alias("split"),
        F.struct(
            F.col("lang").alias("task_objective"),
            F.col("source").alias("task_procedure"),
            F.col("n_chars").cast("string").alias("task_input"),
            F.lit("a report").alias("task_output"),
            F.when(F.col("doc_id") % 3 == 0, "").otherwise("cite sources").alias("task_notes"),
        ).alias("task"),
    )
    return T.task_rows(source).select(
        "prompt_id", F.md5("prompt_text").alias("digest"), F.size("requested_output_constraints").alias("constraints")
    )


# --- transport events -----------------------------------------------------------

LINE_COLUMNS = [
    "user_id AS path",
    "event_id AS pos",
    "CASE event_type WHEN 'signup' THEN 'item.completed' WHEN 'click' THEN 'item.started' WHEN 'view' THEN 'turn.completed' WHEN 'purchase' THEN 'item.completed' ELSE 'error' END AS type",
    "CASE WHEN event_type IN ('signup', 'click') THEN 'collab_tool_call' ELSE 'Agent-Message' END AS item_type",
    "CASE WHEN event_id % 7 = 0 THEN ' ' ELSE concat('i', CAST(event_id % 5 AS VARCHAR(9))) END AS item_id",
    "CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS item_status",
    "event_id % 4 AS receivers",
]
LINE_SQL = "lines AS (SELECT " + ", ".join(LINE_COLUMNS) + " FROM events)"


def transport_lines(t: Tables) -> DataFrame:
    """JSON lines made from the events; every tenth line is not JSON."""
    rows = t.events.selectExpr(*LINE_COLUMNS)
    threads = F.when(F.col("receivers") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t1")))
    line = F.to_json(
        F.struct(
            "type",
            F.struct(
                F.col("item_id").alias("id"),
                F.col("item_type").alias("type"),
                F.lit("spawn-agent").alias("tool"),
                F.col("item_status").alias("status"),
                F.concat(F.lit("said "), F.col("pos").cast("string")).alias("text"),
                threads.alias("receiver_thread_ids"),
            ).alias("item"),
        )
    )
    return rows.select("path", "pos", F.when(F.col("pos") % 10 == 9, "{broken").otherwise(line).alias("value"))


@query(
    "scan_attempt_events",
    f"""WITH {LINE_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS place FROM lines)
    SELECT path, type, count(*) AS n, CAST(sum(place) AS BIGINT) AS places FROM placed WHERE pos % 10 <> 9 GROUP BY ALL""",
)
def scan_attempt_events(t: Tables) -> DataFrame:
    """One attempt file per run, its events parsed behind the scan of its lines."""
    rows = transport_lines(t).select("path", "pos", F.col("value").alias("line"))
    lines = S.scan_attempt_events(t.spark, [], "*.txt", [text_pack(rows, "attempts", "pos")])
    return N.parse_lines(lines.select(file_key(), "pos", "value")).groupBy("path", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places")
    )


SPAWN_SQL = f"""{LINE_SQL}, spawn AS (SELECT path, count(DISTINCT item_id) FILTER (type = 'item.completed' AND item_type = 'collab_tool_call'
  AND item_status = 'completed' AND receivers > 0 AND pos % 7 <> 0) AS spawns,
  count(*) FILTER (item_type = 'collab_tool_call' AND pos % 7 = 0) AS malformed FROM lines WHERE pos % 10 <> 9 GROUP BY path)"""


def spawns(t: Tables) -> DataFrame:
    return N.spawn_count(N.parse_lines(transport_lines(t)))


@query("spawn_count", f"WITH {SPAWN_SQL} SELECT * FROM spawn")
def spawn_count(t: Tables) -> DataFrame:
    return spawns(t)


@query(
    "delegation_check",
    f"""WITH {SPAWN_SQL} SELECT path, CAST(path % 5 = 0 OR CASE WHEN path % 2 = 0 THEN spawns >= 1 ELSE spawns = 0 END AS INTEGER) AS passed FROM spawn""",
)
def delegation_check(t: Tables) -> DataFrame:
    platform = F.when(F.col("path") % 5 == 0, "other").otherwise("codex")
    passed = N.delegation_check(F.col("path") % 2 == 0, platform, F.col("spawns"))
    return spawns(t).select("path", passed.cast("int").alias("passed"))


#: Outputs by run: event lines, plain text, one pretty-printed object, one object on a line, an object that breaks off.
OUTPUT_SQL = """placed AS (SELECT user_id AS path, event_id AS pos, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
outputs AS (SELECT path, pos, k, n, CAST(CASE path % 8 WHEN 1 THEN 'plain line ' || pos WHEN 2 THEN CASE WHEN k = 1 THEN '{' WHEN k = n THEN '"message": "told ' || path || '"}' ELSE '"k' || pos || '": 0,' END
  WHEN 3 THEN CASE WHEN k = 1 THEN '{"message": "told \\"' || path || '\\"", "text": 5}' ELSE ' ' END WHEN 4 THEN CASE WHEN k = 1 THEN '{' ELSE '"k' || pos || '": 0,' END
  ELSE CASE WHEN pos % 10 = 9 THEN '{broken' ELSE '{"type":"' || type || '","item":{"id":"' || item_id || '","type":"' || replace(item_type, 'Agent-Message', 'assistant_message') || '","tool":"spawn-agent","status":"' || item_status
    || '","text":"said ' || pos || '","receiver_thread_ids":' || CASE WHEN receivers = 0 THEN '[]' ELSE '["t1"]' END || '}}' END END AS VARCHAR) AS made FROM placed JOIN lines USING (path, pos))"""


@query(
    "final_message",
    f"""WITH {LINE_SQL}, {OUTPUT_SQL}, events_said AS (SELECT path, 'said ' || max(pos) FILTER (item_type = 'assistant_message' AND pos % 10 <> 9) AS message
      FROM (SELECT path, pos, CASE WHEN item_type = 'Agent-Message' THEN 'assistant_message' ELSE item_type END AS item_type FROM lines) GROUP BY path),
    kinds AS (SELECT DISTINCT path, n, CASE WHEN path % 8 IN (1, 4) THEN 'raw' WHEN path % 8 = 2 THEN CASE WHEN n > 1 THEN 'document' ELSE 'raw' END WHEN path % 8 = 3 THEN 'document'
      WHEN message IS NULL THEN 'raw' ELSE 'event' END AS source, message FROM placed JOIN events_said USING (path))
    SELECT path, source, CAST(0 AS BIGINT) AS block, CASE WHEN source = 'event' THEN message WHEN path % 8 = 3 THEN 'told "' || path || '"' ELSE 'told ' || path END AS message FROM kinds WHERE source <> 'raw'
    UNION ALL SELECT path, 'raw', CAST(floor(o.pos / 1000) AS BIGINT), string_agg(made, chr(10) ORDER BY o.pos) FROM outputs o JOIN kinds USING (path) WHERE source = 'raw' GROUP BY ALL""",
)
def final_message(t: Tables) -> DataFrame:
    """Outputs of all kinds."""
    lines = transport_lines(t).withColumn("value", F.replace("value", F.lit("Agent-Message"), F.lit("assistant_message")))
    place = Window.partitionBy("path").orderBy("pos")
    placed = lines.withColumns({"k": F.row_number().over(place), "n": F.count(F.lit(1)).over(Window.partitionBy("path"))})
    kind, path, pos = F.col("path") % 8, F.col("path").cast("string"), F.col("pos").cast("string")
    filler = F.concat(F.lit('"k'), pos, F.lit('": 0,'))
    made = (
        F.when(kind == 1, F.concat(F.lit("plain line "), pos))
        .when(kind == 2, F.when(F.col("k") == 1, "{").when(F.col("k") == F.col("n"), F.concat(F.lit('"message": "told '), path, F.lit('"}'))).otherwise(filler))
        .when(kind == 3, F.when(F.col("k") == 1, F.concat(F.lit('{"message": "told \\"'), path, F.lit('\\"", "text": 5}'))).otherwise(" "))
        .when(kind == 4, F.when(F.col("k") == 1, "{").otherwise(filler))
        .otherwise(F.col("value"))
    )
    return N.final_message(placed.select("path", "pos", made.alias("value")))


NESTED_COLUMNS = [
    "event_id",
    "CASE event_id % 8 WHEN 0 THEN 'Web Search' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'command_execution' WHEN 3 THEN 'error' ELSE 'item.completed' END AS outer_type",
    "CASE event_id % 5 WHEN 0 THEN 'file-search' WHEN 1 THEN 'message' WHEN 2 THEN 'command_execution' WHEN 3 THEN 'error' ELSE 'web_fetch' END AS inner_type",
    "CASE WHEN event_id % 3 = 0 THEN 'CURL http://x' ELSE 'ls -la curls' END AS command",
]


@query(
    "retrieval_flags",
    f"""WITH n AS (SELECT {', '.join(NESTED_COLUMNS)} FROM events), c AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'CURL' END AS cmd FROM n),
    m AS (SELECT event_id, CASE WHEN outer_type = 'Web Search' THEN outer_type WHEN outer_type = 'error' THEN NULL WHEN outer_type = 'command_execution' THEN cmd
      WHEN outer_type = 'tool_call' AND event_id % 2 = 0 THEN 'browser'
      WHEN inner_type IN ('file-search', 'web_fetch') THEN inner_type WHEN inner_type = 'command_execution' THEN cmd END AS marker FROM c)
    SELECT marker, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM m WHERE marker IS NOT NULL GROUP BY ALL""",
)
def retrieval_flags(t: Tables) -> DataFrame:
    rows = t.events.selectExpr(*NESTED_COLUMNS)
    inner = F.struct(F.col("inner_type").alias("type"), "command", F.lit("see web_search").alias("text"))
    tool = F.when(F.col("event_id") % 2 == 0, "browser").otherwise("editor")
    deep = F.struct(F.struct(F.array(inner).alias("data")).alias("payload"))
    line = F.to_json(
        F.struct(F.col("outer_type").alias("type"), "command", tool.alias("tool"), deep.alias("item"))
    )
    flags = N.retrieval_flags(rows.select("event_id", line.alias("value")), ["event_id"])
    return flags.filter("marker IS NOT NULL").groupBy("marker").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


@query(
    "product_gate",
    """WITH o AS (SELECT conv_id, max(CASE WHEN turn = 1 THEN text END) AS output, max(CASE WHEN turn = 0 THEN text END) AS draft FROM conversations GROUP BY conv_id),
    s AS (SELECT *, length(trim(coalesce(output, ''), ' ' || chr(10) || chr(13) || chr(9))) AS a, length(trim(draft, ' ' || chr(10) || chr(13) || chr(9))) AS d FROM o)
    SELECT coalesce(CASE WHEN a = 0 THEN 'no_output' WHEN conv_id % 3 > 0 AND draft IS NULL THEN 'missing_draft' WHEN conv_id % 3 > 0 AND a < d * 0.5 THEN 'shorter_than_draft' END, 'ok') AS reason,
      count(*) AS runs FROM s GROUP BY ALL""",
)
def product_gate(t: Tables) -> DataFrame:
    at = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    texts = t.conversations.groupBy("conv_id").agg(at(1).alias("output"), at(0).alias("draft"))
    reason = N.product_gate(F.col("output"), F.col("draft"), F.col("conv_id") % 3 > 0)
    return texts.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("runs"))


# --- groups ------------------------------------------------------------------------

GROUP_OPINION_COLUMNS = [
    "CAST(l_partkey AS VARCHAR(20)) AS question_id",
    "'launch-1' AS launch_id",
    "'round-1' AS round_id",
    "concat('Is ', CAST(l_partkey AS VARCHAR(20)), ' good?') AS question_text",
    "CAST(l_suppkey % 5 AS VARCHAR(9)) AS participant_id",
    "CASE WHEN l_quantity = 50 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status",
    "concat('view ', CAST(l_suppkey % 5 AS VARCHAR(9)), ' of\n', CAST(l_linenumber % 2 AS VARCHAR(9))) AS opinion",
    "l_linenumber",
    "l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber AS ordinal",
]


def opinions(t: Tables) -> DataFrame:
    columns = [c.replace("\n", "\\n") for c in GROUP_OPINION_COLUMNS]
    rows = t.lineitem.selectExpr(*columns, "4 AS split", "0 AS iteration_index")
    return T.group_opinions(rows)


def ratings(t: Tables) -> DataFrame:
    name = F.expr(f"CASE l_linenumber {LIKERT_CASE} END")
    return opinions(t).withColumn("agreement", F.array(name))


GROUP_SQL = "ops AS (SELECT " + ", ".join(GROUP_OPINION_COLUMNS) + """ FROM lineitem),
rater AS (SELECT question_id, participant_id, min(ordinal) AS first_place FROM ops GROUP BY ALL),
lat AS (SELECT question_id, participant_id, arg_max(opinion, ordinal) AS opinion FROM ops WHERE status = 'COMPLETED' GROUP BY ALL),
good AS (SELECT question_id, bool_and(status = 'COMPLETED') AS ok, bool_or(l_linenumber < 4) AS below, bool_or(l_linenumber > 4) AS above,
  count(DISTINCT participant_id) AS people FROM ops GROUP BY ALL),
eligible AS (SELECT question_id, count(*) AS members, count(DISTINCT opinion) AS different,
  string_agg(rn || '. ' || replace(opinion, chr(10), chr(10) || '   '), chr(10) ORDER BY rn) AS supplied_context
  FROM (SELECT lat.*, row_number() OVER (PARTITION BY question_id ORDER BY first_place) AS rn FROM lat JOIN rater USING (question_id, participant_id)
    JOIN good USING (question_id) WHERE ok AND below AND above AND people = 5) GROUP BY question_id HAVING count(*) = 5 AND count(DISTINCT opinion) = 5)"""


@query(
    "participant_order",
    f"WITH {GROUP_SQL} SELECT question_id, participant_id, first_place, row_number() OVER (PARTITION BY question_id ORDER BY first_place) AS place FROM rater",
)
def participant_order(t: Tables) -> DataFrame:
    first = T.participant_order(ratings(t), ["question_id"])
    bucketed = first.withColumn("_bucket", F.floor(F.col("first_place") / 1e9).cast("bigint"))
    return row_index(bucketed, ["question_id"], ["_bucket"], ["first_place"], "place").drop("_bucket")


@query(
    "join_group_ratings",
    f"""WITH {GROUP_SQL} SELECT question_id, people, CAST(below AND above AS INTEGER) AS split_view, CAST(ok AS INTEGER) AS ok FROM good""",
)
def join_group_ratings(t: Tables) -> DataFrame:
    voided = opinions(t).groupBy("question_id", "launch_id").agg(
        F.every(F.col("status") == "COMPLETED").cast("int").alias("ok"),
        F.countDistinct("participant_id").alias("people"),
    )
    value = X.likert(F.col("agreement")[0])
    rated = ratings(t).groupBy("question_id", "launch_id").agg(
        (F.some(value < X.LIKERT_MIDPOINT) & F.some(value > X.LIKERT_MIDPOINT)).cast("int").alias("split_view")
    )
    return voided.join(rated, ["question_id", "launch_id"]).drop("launch_id")


@query(
    "disagreement_groups",
    f"""WITH {GROUP_SQL} SELECT 'habermas-' || question_id || '-launch-1' AS prompt_id, supplied_context FROM eligible
      QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || question_id || '/launch-1/round-1'), question_id) <= 10""",
)
def disagreement_groups(t: Tables) -> DataFrame:
    return T.disagreement_groups(opinions(t), ratings(t), 10, SEED).select("prompt_id", "supplied_context")


# --- length compliance against a request ---------------------------------------------

REQUEST_SQL = f"""req AS (SELECT lang, source, concat('A', CAST(1 + doc_id % 4 AS VARCHAR)) AS condition, CASE WHEN n_chars < 40 THEN NULL ELSE CAST(floor(n_chars / 8) AS DOUBLE) END AS x, CAST({UNITS_SQL} AS DOUBLE) AS y FROM documents)"""


def requests(t: Tables) -> DataFrame:
    return t.documents.select(
        "lang",
        "source",
        F.concat(F.lit("A"), (1 + F.col("doc_id") % 4).cast("string")).alias("condition"),
        F.when(F.col("n_chars") >= 40, F.floor(F.col("n_chars") / 8).cast("double")).alias("x"),
        X.output_units(F.col("text")).cast("double").alias("y"),
    )


@query(
    "length_compliance",
    f"""WITH {REQUEST_SQL} SELECT condition, source AS benchmark, lang AS platform, count(x) AS requested, {r6('avg(abs(y - x) / x)')} AS mean_deviation,
      {r6('avg(CASE WHEN x IS NULL THEN NULL WHEN abs(y - x) / x <= 0.2 THEN 1 ELSE 0 END)')} AS compliance FROM req GROUP BY ALL""",
)
def length_compliance(t: Tables) -> DataFrame:
    from pairlens.operators.protocol import length_compliance as compliance

    rows = requests(t).withColumnsRenamed({"source": "benchmark", "lang": "platform"})
    return rounded(compliance(rows, ["condition", "benchmark", "platform"], F.col("x"), F.col("y")), "mean_deviation", "compliance")


@query(
    "length_score",
    f"""WITH {REQUEST_SQL}, s AS (SELECT lang, CASE WHEN x IS NULL THEN NULL WHEN y = 0 THEN 0 WHEN y > x THEN 100 * greatest(0, 1 - (y / x - 1) / 3)
      ELSE 100 * greatest(0, 1 - (x / y - 1) / 2) END AS score FROM req)
    SELECT lang, count(score) AS n, {r6('avg(score)')} AS mean_score FROM s GROUP BY ALL""",
)
def length_score(t: Tables) -> DataFrame:
    from pairlens.operators.protocol import length_score as score

    report = requests(t).groupBy("lang").agg(
        F.count(score(F.col("x"), F.col("y"))).alias("n"),
        F.avg(score(F.col("x"), F.col("y"))).alias("mean_score"),
    )
    return rounded(report, "mean_score")


