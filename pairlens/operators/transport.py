"""Transport events of generation runs: delegation, retrieval, final text."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.rows import once
from pairlens.functions.text import event_name, strip

EVENT_SCHEMA = (
    "type STRING, event STRING, event_type STRING, usage STRING, result STRING, text STRING, "
    "item STRUCT<id:STRING,type:STRING,tool:STRING,status:STRING,prompt:STRING,text:STRING,"
    "receiver_thread_ids:ARRAY<STRING>>"
)
USAGE_SCHEMA = (
    "input_tokens BIGINT, prompt_tokens BIGINT, cached_input_tokens BIGINT, cached_tokens BIGINT, "
    "cache_read_tokens BIGINT, output_tokens BIGINT, reasoning_output_tokens BIGINT, "
    "reasoning_tokens BIGINT, completion_tokens BIGINT"
)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event structs of the JSON object lines; other lines are dropped.

    ``usage`` stays null unless it is an object.
    """
    event = F.from_json(column, EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    is_object = F.get_json_object(column, "$").startswith("{")
    parsed = lines.filter(is_object).withColumn("_event", event)
    usage = F.from_json("_event.usage", USAGE_SCHEMA)
    has_usage = F.coalesce(F.col("_event.usage").startswith("{"), F.lit(False))
    rest = [c for c in lines.columns if c != column]
    return parsed.select(
        *rest,
        "_event.type",
        "_event.item",
        "_event.result",
        "_event.text",
        has_usage.alias("has_usage"),
        F.when(has_usage, usage).alias("usage"),
    )


def spawn_count(events: DataFrame) -> DataFrame:
    """Completed delegations per run, and delegation events without an id."""
    item = F.col("item")
    named = (
        F.col("type").isin("item.started", "item.updated", "item.completed")
        & (event_name(item["type"]) == "collab_tool_call")
        & (event_name(item["tool"]) == "spawn_agent")
    )
    no_id = item["id"].isNull() | (F.trim(item["id"]) == "")
    done = (
        ~no_id
        & (F.col("type") == "item.completed")
        & (item["status"] == "completed")
        & (F.size(item["receiver_thread_ids"]) > 0)
    )
    return events.groupBy("path").agg(
        F.countDistinct(F.when(F.coalesce(named & done, F.lit(False)), item["id"])).alias("spawns"),
        F.count_if(F.coalesce(named & no_id, F.lit(False))).alias("malformed"),
    )


def delegation_check(required: Column, platform: Column, spawns: Column, checked: str = "codex") -> Column:
    """Delegated runs need a spawn, in-context runs none; one platform is checked."""
    return (platform != checked) | F.when(required, spawns >= 1).otherwise(spawns == 0)


# Event names that mean retrieval, commands, tools and errors
RETRIEVAL_EVENTS = (
    "web_search", "websearch", "web_search_call", "web_search_preview", "web_fetch",
    "browser", "browser_call", "browser_search", "browser_fetch", "mcp_tool_call",
    "network_request", "retrieval", "fetch", "wget", "curl", "httpie", "nc", "netcat",
    "socat", "ssh", "file_search", "file_search_call",
)
COMMAND_EVENTS = (
    "command_execution", "command_execution_started", "command_execution_completed",
    "command_execution_failed",
)
TOOL_EVENTS = ("tool_call", "function_call", "custom_tool_call", "tool_search_call")
ERROR_EVENTS = ("error", "error_event", "response_error", "response_failed", "turn_failed")
NETWORK_COMMAND = (
    r"(?i)\b(?:curl|wget|fetch|httpie|nc|netcat|socat|ssh)\b|"
    r"\b(?:git\s+clone|python\s+-m\s+http\.client)\b|"
    r"\b(?:urllib|requests\.get|socket\.create_connection)\b"
)
KIND_FIELDS = ("type", "event", "event_type")
TOOL_FIELDS = ("tool", "tool_name", "name", "method")
COMMAND_FIELDS = ("command", "cmd", "shell_command")
CONTAINERS = ("item", "data", "payload")

_NETWORK = re.compile(NETWORK_COMMAND)


def _named(value: object) -> str | None:
    """The value's name as ``event_name`` gives it; null when it is no string."""
    return re.sub("[^a-z0-9]+", "_", value.lower()).strip("_") if isinstance(value, str) else None


def _node_marker(node: dict) -> tuple[str | None, bool]:
    """Marker of one object, and whether the objects in its containers are searched as well."""
    if any(_named(v) in ERROR_EVENTS for k, v in node.items() if k.casefold() in KIND_FIELDS):
        return None, False
    kind = _named(node.get("type"))
    fields = (*KIND_FIELDS, *TOOL_FIELDS) if kind in TOOL_EVENTS else KIND_FIELDS
    for field in fields:
        if _named(node.get(field)) in RETRIEVAL_EVENTS:
            return node[field], False
    if kind not in COMMAND_EVENTS:
        return None, True
    hits = [_NETWORK.search(node[f]) for f in COMMAND_FIELDS if isinstance(node.get(f), str)]
    return next((hit.group(0) for hit in hits if hit), None), False


def retrieval_marker(line: str | None) -> str | None:
    """First retrieval marker of a JSON object line in reading order: an object before its containers."""
    try:
        value = json.loads(line or "")
    except (ValueError, RecursionError):
        return None
    waiting = [value] if isinstance(value, dict) else []
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            marker, inside = _node_marker(node)
            if marker:
                return marker
            node = [node.get(name) for name in CONTAINERS] if inside else []
        waiting.extend(x for x in reversed(node) if isinstance(x, (dict, list)))
    return None


def retrieval_flags(lines: DataFrame, key: list[str], column: str = "value") -> DataFrame:
    """Lines with a retrieval marker: their key columns and the first marker, at any depth of nesting.

    Follows objects and lists in ``item``, ``data`` and ``payload``, not texts that look like JSON. Error envelopes and
    command nodes are not searched further. Lines that are null, no JSON object, or nested beyond what the JSON reader
    follows (thousands of levels) have no marker. Every line is parsed once where it was read; nothing moves.
    """
    rows = lines.select(*key, F.col(column).alias("_line"))
    schema = rows.select(*key, F.lit(None).cast("string").alias("marker")).schema

    def work(batches):
        for batch in batches:
            found = pa.array([retrieval_marker(line.as_py()) for line in batch.column("_line")], pa.string())
            columns = [*(batch.column(i) for i in range(len(key))), found]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "marker"]).filter(found.is_valid())

    return rows.mapInArrow(work, schema)


#: Lines in a block of a raw text.
TEXT_BLOCK = 1000
MESSAGE_ITEMS = ("agent_message", "assistant_message")


def _string_at(node: Column, path: str) -> Column:
    """A JSON string at a path of a variant; null for other kinds."""
    found = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(node, path, "string"))


def _whole_message(node: Column) -> Column:
    """The text of an object that is the whole output."""
    return F.coalesce(*[_string_at(node, f"$.{name}") for name in ("result", "text", "message")])


def final_message(lines: DataFrame, block: int = TEXT_BLOCK) -> DataFrame:
    """Final text of each run from its output lines ``(path, pos, value)``: (path, source, block, message).

    An output that is one JSON object gives its ``result``, ``text`` or ``message`` (source ``document``). Else the last
    text of an assistant item or of a ``result`` or ``text`` of an object line counts (``event``). Else the output
    itself does (``raw``), whole, in blocks of ``block`` lines joined by line feeds. Lines that are not JSON objects and
    null lines hold no text of an event. An output of several lines is only put together as a document
    if its first line opens an object without closing it.
    """
    value = F.coalesce("value", F.lit(""))
    node = once(lines.select("path", "pos", value.alias("value")), "_node", F.try_parse_json("value"))
    item, said = F.col("_node"), F.when(_string_at(F.col("_node"), "$.item.type").isin(*MESSAGE_ITEMS), _string_at(F.col("_node"), "$.item.text"))
    is_object = F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))
    text = F.when(is_object, F.coalesce(_string_at(item, "$.text"), _string_at(item, "$.result"), said))
    filled = strip(F.col("value")) != ""
    place = F.when(filled, F.col("pos"))
    runs = node.groupBy("path").agg(
        F.count_if(filled).alias("_filled"),
        F.min_by(is_object, place).alias("_first_whole"),
        F.min_by(strip(F.col("value")).startswith("{"), place).alias("_opens"),
        F.max_by(strip(F.col("value")).endswith("}"), place).alias("_closes"),
        F.max(F.when(is_object, _whole_message(item))).alias("_line_document"),
        F.max_by(text, F.when(text.isNotNull(), F.col("pos"))).alias("_event"),
    )
    spread_out = runs.filter("_filled > 1 AND _opens AND _closes AND NOT _first_whole").select("path")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    together = F.array_join(F.transform(ordered, lambda x: x["value"]), "\n")
    documents = lines.select("path", "pos", value.alias("value")).join(spread_out, "path", "left_semi").groupBy("path").agg(together.alias("_text"))
    documents = once(documents, "_node", F.try_parse_json("_text")).select("path", _whole_message(F.col("_node")).alias("_document"))
    document = F.when(F.col("_filled") == 1, F.col("_line_document")).otherwise(F.col("_document"))
    runs = runs.join(documents, "path", "left").select("path", document.alias("_document"), "_event")
    parsed = runs.filter("_document IS NOT NULL OR _event IS NOT NULL").select(
        "path",
        F.when(F.col("_document").isNotNull(), "document").otherwise("event").alias("source"),
        F.lit(0).cast("bigint").alias("block"),
        F.coalesce("_document", "_event").alias("message"),
    )
    rest = runs.filter("_document IS NULL AND _event IS NULL").select("path")
    raw = lines.select("path", "pos", value.alias("value")).join(rest, "path", "left_semi")
    raw = raw.groupBy("path", F.floor(F.col("pos") / block).cast("bigint").alias("block")).agg(together.alias("message"))
    return parsed.unionByName(raw.select("path", F.lit("raw").alias("source"), "block", "message"))


# Fixed value: the share of the draft the final text must reach
DRAFT_RATIO = 0.5


def product_gate(output: Column, draft: Column, requires_draft: Column) -> Column:
    """Reason a final product is refused, or null."""
    size = F.length(strip(F.coalesce(output, F.lit(""))))
    short = size < F.length(strip(draft)) * DRAFT_RATIO
    return (
        F.when(size == 0, "no_output")
        .when(requires_draft & draft.isNull(), "missing_draft")
        .when(requires_draft & short, "shorter_than_draft")
    )
