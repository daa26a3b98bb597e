"""Row contracts: each check adds ``reject_reasons`` and drops nothing.

Judge records come as JSON text in ``value``. A typed read turns a value of
another JSON type into null, which the checks then report; text fields are
checked through a variant, because a typed read would accept numbers as text.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pairlens.functions.rows import once
from pairlens.functions.text import strip
from pairlens.operators.pairs import PRESENTATIONS, WINNERS
from pairlens.operators.quality import DIMENSIONS

# Field sets and domains of the contracts
POINTWISE_KEYS = (
    "prompt_id", "condition_id", "platform", "judge_id", "judge_family", "scores",
    "evidence_quotes", "judge_level_composite", "uncertainties",
)
PAIRWISE_KEYS = (
    "prompt_id", "platform", "judge_id", "judge_family", "pair_id", "presentation",
    "winner", "evidence_quotes", "reason",
)
NATIVE_KEYS = ("score", "reason")
CHECKLIST_KEYS = ("checklist_id", "reason", "evaluation_score")
CHECKLIST_SCORES = (0.0, 0.25, 0.5, 0.75, 1.0)
MAX_QUOTE = 240
MAX_CHECKLIST_TEXT = 200_000

Reason = tuple[Column, str]


def reasons(*checks: Reason) -> Column:
    """Names of the checks that fail; a check that cannot be decided fails."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in checks])
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected rows."""
    bad = F.size("reject_reasons") > 0
    return checked.filter(~bad).drop("reject_reasons"), checked.filter(bad)


def field_set(value: Column, expected: Sequence[str]) -> tuple[Column, Column]:
    """Missing and extra keys of a JSON object, both sorted; null for a non-object."""
    keys = F.json_object_keys(value)
    wanted = F.array(*[F.lit(k) for k in sorted(expected)])
    return F.array_except(wanted, keys), F.array_sort(F.array_except(keys, wanted))


def exact_keys(value: Column, expected: Sequence[str]) -> Reason:
    missing, extra = field_set(value, expected)
    return (F.size(missing) + F.size(extra) != 0) | missing.isNull(), "fields"


def is_text(value: Column, path: str) -> Column:
    """Whether the JSON value at a path is a string."""
    found = F.try_variant_get(F.try_parse_json(value), path, "variant")
    return F.coalesce(F.schema_of_variant(found) == "STRING", F.lit(False))


def metadata(value: Column, fields: Sequence[str]) -> list[Reason]:
    """Metadata fields must equal the ``expected_`` columns of the request."""
    return [
        (
            ~is_text(value, f"$.{name}")
            | ~F.get_json_object(value, f"$.{name}").eqNullSafe(F.col(f"expected_{name}")),
            name,
        )
        for name in fields
    ]


def quote_shape(quote: Column) -> Column:
    """Non-empty, trimmed and short."""
    return (quote != "") & (quote == strip(quote)) & (F.length(quote) <= MAX_QUOTE)


def quote_grounded(quote: Column, texts: Column) -> Column:
    """The quote occurs verbatim in one of the texts."""
    return F.exists(texts, lambda t: F.contains(t, quote))


def check_quotes(quotes: Column, texts: Column) -> list[Reason]:
    """Shape and grounding of a list of quotes; the list must not be empty."""
    holds = lambda rule: F.forall(quotes, lambda q: F.coalesce(rule(q), F.lit(False)))
    return [
        (quotes.isNull() | (F.size(quotes) <= 0) | ~holds(quote_shape), "quote_shape"),
        (~holds(lambda q: quote_grounded(q, texts)), "quote_not_found"),
    ]


def validate_pointwise(records: DataFrame) -> DataFrame:
    """``records(value, texts, expected_*)`` against the pointwise contract."""
    value = F.col("value")
    scores = ", ".join(f"{d}: BIGINT" for d in DIMENSIONS)
    schema = (
        f"scores STRUCT<{scores}>, evidence_quotes ARRAY<STRUCT<dimension: STRING, quote: STRING>>, "
        "judge_level_composite DOUBLE, uncertainties ARRAY<STRING>"
    )
    parsed = once(records, "_r", F.from_json(value, schema))
    score = lambda d: F.col(f"_r.scores.{d}")
    out = F.lit(False)
    for name in DIMENSIONS:
        out = out | ~F.coalesce(score(name).between(1, 5), F.lit(False))
    quotes = F.col("_r.evidence_quotes")
    named = F.transform(quotes, lambda q: q["dimension"])
    wanted = F.array(*[F.lit(d) for d in sorted(DIMENSIONS)])
    composite = F.col("_r.judge_level_composite")
    score_keys = exact_keys(F.get_json_object(value, "$.scores"), DIMENSIONS)[0]
    return once(
        parsed,
        "reject_reasons",
        reasons(
            exact_keys(value, POINTWISE_KEYS),
            *metadata(value, ["prompt_id", "condition_id", "platform", "judge_id", "judge_family"]),
            (out | score_keys, "scores"),
            (~F.array_sort(named).eqNullSafe(wanted), "quote_dimensions"),
            *check_quotes(F.transform(quotes, lambda q: q["quote"]), F.col("texts")),
            (composite.isNull() | F.isnan(composite) | (F.abs(composite) == float("inf")), "composite"),
            (F.col("_r.uncertainties").isNull(), "uncertainties"),
        ),
    ).drop("_r")


def validate_native_score(records: DataFrame) -> DataFrame:
    """``records(value, criterion)``: integer score 1 to 10 with a reason."""
    value = F.col("value")
    score = F.from_json(value, "score BIGINT")["score"]
    return records.withColumn(
        "reject_reasons",
        reasons(
            exact_keys(value, NATIVE_KEYS),
            (~score.between(1, 10), "score"),
            (~is_text(value, "$.reason") | (strip(F.get_json_object(value, "$.reason")) == ""), "reason"),
            (strip(F.col("criterion")) == "", "criterion"),
        ),
    )


def _plain(value):
    """A Python literal as JSON has it; kinds that JSON lacks become objects that no contract accepts."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else repr((k,)): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float)) else {"literal": type(value).__name__}


@F.pandas_udf(StringType())
def literal_json(texts: pd.Series) -> pd.Series:
    """JSON text of Python literals; null for null and for texts that are none. Equal texts of a batch are read once."""

    def one(text):
        try:
            return json.dumps(_plain(ast.literal_eval(text.strip())))
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            return None

    places, distinct = pd.factorize(texts)
    # nulls have place -1, which is the last of the list
    return pd.Series(np.array([*map(one, distinct), None], dtype=object)[places])


def parse_checklist(records: DataFrame) -> DataFrame:
    """Raw checklist answers to items: a list, or an object with one list value.

    Digit-string ids and numeric-string scores become numbers. Answers that are not JSON are read as Python literals
    (only those go through Python); texts beyond the limit are not read. Adds ``items`` and ``reject_reasons``.
    """
    short = F.length("value") <= MAX_CHECKLIST_TEXT
    is_json = F.try_parse_json("value").isNotNull()
    records = once(records, "_json", is_json)
    literal = literal_json(F.when(short & ~F.col("_json"), F.col("value")))
    records = once(records, "_text", F.when(F.col("_json"), F.col("value")).otherwise(literal)).drop("_json")
    value = F.trim(F.col("_text"))
    inner = F.from_json(value, "map<string,string>")
    body = F.when(value.startswith("["), value).when(
        F.size(inner) == 1, F.map_values(inner)[0]
    )
    read = lambda schema: F.from_json("_body", schema)
    views = F.struct(
        read("array<map<string,string>>").alias("maps"),
        read("array<string>").alias("texts"),
    )
    fields = once(once(records, "_body", body), "_p", views)
    keys = F.array(*[F.lit(k) for k in sorted(CHECKLIST_KEYS)])

    def item(entry: Column, i: Column) -> Column:
        number = entry["checklist_id"]
        score = entry["evaluation_score"]
        # a typed read for each JSON type would raise on almost every row
        quoted = F.get("_p.texts", i).rlike(r"[\"']reason[\"']\s*:\s*[\"']")
        return F.struct(
            F.when(number.rlike(r"^-?\d+$"), number.try_cast("bigint")).alias("checklist_id"),
            F.when(quoted, entry["reason"]).alias("reason"),
            F.when(~score.isin("true", "false"), score.try_cast("double")).alias("evaluation_score"),
            F.coalesce(F.sort_array(F.map_keys(entry)) == keys, F.lit(False)).alias("exact"),
        )

    parsed = once(fields, "items", F.transform("_p.maps", item)).drop("_p", "_body", "_text")
    items = F.col("items")
    fails = lambda rule: ~F.coalesce(
        F.forall(items, lambda x: F.coalesce(rule(x), F.lit(False))), F.lit(True)
    )
    return once(
        parsed,
        "reject_reasons",
        reasons(
            (F.length("value") > MAX_CHECKLIST_TEXT, "too_long"),
            (items.isNull(), "not_a_list"),
            (fails(lambda x: x["exact"]), "item_fields"),
            (fails(lambda x: x["checklist_id"].isNotNull()), "checklist_id"),
            (fails(lambda x: strip(x["reason"]) != ""), "reason"),
            (fails(lambda x: x["evaluation_score"].isNotNull()), "evaluation_score"),
        ),
    )


def validate_checklist(records: DataFrame) -> DataFrame:
    """``records(items, expected_items)``: count, ids 0..n-1 and allowed scores."""
    items, n = F.col("items"), F.col("expected_items")
    ids = F.array_sort(F.transform(items, lambda x: x["checklist_id"].cast("bigint")))
    allowed = F.array(*[F.lit(s) for s in CHECKLIST_SCORES])
    return records.withColumn(
        "reject_reasons",
        reasons(
            (F.size(items) != n, "item_count"),
            (ids != F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), "checklist_ids"),
            (~F.forall(items, lambda x: F.array_contains(allowed, x["evaluation_score"])), "score_domain"),
        ),
    )


def validate_pairwise(records: DataFrame) -> DataFrame:
    """``records(value, output_a, output_b, context, expected_*)`` against the pair contract."""
    value = F.col("value")
    schema = "evidence_quotes STRUCT<A: ARRAY<STRING>, B: ARRAY<STRING>>"
    parsed = once(records, "_r", F.from_json(value, schema))
    field = lambda name: F.get_json_object(value, f"$.{name}")
    texts = lambda side: F.when(
        F.coalesce(F.col("context"), F.lit("")) != "", F.array(F.col(side), F.col("context"))
    ).otherwise(F.array(F.col(side)))
    checks = []
    for side, output in (("A", "output_a"), ("B", "output_b")):
        quotes = F.col(f"_r.evidence_quotes.{side}")
        checks += [(bad, f"{name}_{side}") for bad, name in check_quotes(quotes, texts(output))]
    return once(
        parsed,
        "reject_reasons",
        reasons(
            exact_keys(value, PAIRWISE_KEYS),
            *metadata(value, ["prompt_id", "platform", "judge_id", "judge_family"]),
            (~is_text(value, "$.pair_id"), "pair_id"),
            (~(is_text(value, "$.winner") & field("winner").isin(*WINNERS)), "winner"),
            (~(is_text(value, "$.presentation") & field("presentation").isin(*PRESENTATIONS)), "presentation"),
            exact_keys(field("evidence_quotes"), ("A", "B"))[:1] + ("evidence_fields",),
            *checks,
            (~is_text(value, "$.reason") | (strip(field("reason")) == ""), "reason"),
        ),
    ).drop("_r")


def validate_prompt_rows(rows: DataFrame, hash_of: Column) -> DataFrame:
    """Typed manifest rows: texts, constraint list, payload rule and hash."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    name = F.col("benchmark_name")
    constraints = F.col("requested_output_constraints")
    needs_payload = name.isin("WritingBench", "HelloBench")
    payload = F.col("native_payload")
    context = F.col("supplied_context")
    listed = F.forall(constraints, lambda c: F.coalesce(c != "", F.lit(False)))
    return rows.withColumn(
        "reject_reasons",
        reasons(
            *[(blank(c), c) for c in ("prompt_id", "benchmark_name", "source_version", "prompt_text")],
            (constraints.isNull() | ~listed, "constraints"),
            (
                F.when(needs_payload, payload.isNull() | (F.size(payload) <= 0)).otherwise(payload.isNotNull()),
                "native_payload",
            ),
            (
                F.when(name == "HabermasMachine", context.isNull() | (strip(context) == "")).otherwise(context.isNotNull()),
                "supplied_context",
            ),
            (~F.col("hash").eqNullSafe(hash_of), "hash"),
        ),
    )


def duplicate_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def expected_count(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Observed against expected row counts; only the wrong ones."""
    seen = rows.groupBy(key).agg(F.count(F.lit(1)).alias("observed"))
    return (
        expected.join(seen, key, "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)))
        .filter(F.col("observed") != F.col("expected"))
    )


def validate_usage(rows: DataFrame, column: str = "usage_json") -> DataFrame:
    """Usage objects: three required counters, three optional ones."""
    value = F.col(column)
    required = ("prompt_tokens", "completion_tokens", "total_tokens")
    optional = ("reasoning_tokens", "cached_tokens", "cache_write_tokens")
    typed = F.from_json(value, ", ".join(f"{n} BIGINT" for n in (*required, *optional)))
    keys = F.json_object_keys(value)
    checks = [(~(typed[n] >= 0), n) for n in required]
    for name in optional:
        present = F.coalesce(F.array_contains(keys, name), F.lit(False))
        checks.append((present & ~F.coalesce(typed[name] >= 0, F.lit(False)), name))
    return rows.withColumn("reject_reasons", reasons(*checks))


def base_family(value: Column) -> Column:
    """Family name without the frontier role."""
    name = F.lower(strip(value))
    return (
        F.when(name == "claude_frontier", "claude").when(name == "gpt_frontier", "gpt").otherwise(name)
    )


def family_audit(rows: DataFrame, families: DataFrame, allow_same: bool) -> DataFrame:
    """Mode of each judged row: enforced, exploratory, or a reject reason.

    ``rows(reported_model, generator_family)``, ``families(reported_model, family, role)``.
    """
    known = rows.join(F.broadcast(families), "reported_model", "left")
    mapped, generator = base_family(F.col("family")), base_family(F.col("generator_family"))
    same = "exploratory-same-family" if allow_same else "rejected-same-family"
    mode = (
        F.when(F.col("family").isNull(), "rejected-unknown-model")
        .when((F.col("role") == "frontier") & ~mapped.isin("claude", "gpt"), "rejected-frontier-family")
        .when(generator.isNull() | (generator == ""), "rejected-no-generator")
        .when(mapped != generator, "enforced")
        .otherwise(same)
    )
    return known.withColumn("mode", mode).drop("family", "role")


def same_generation_evidence(pairs: DataFrame) -> DataFrame:
    """Both runs of a pair share prompt, platform, assignment, context and generator."""
    differ = lambda name: ~F.col(f"left_{name}").eqNullSafe(F.col(f"right_{name}"))
    return pairs.withColumn(
        "reject_reasons",
        reasons(
            (differ("prompt") | differ("platform"), "prompt_or_platform"),
            (differ("assignment") | differ("context"), "assignment_or_context"),
            (differ("model") | differ("family"), "generator"),
        ),
    )


def answer_sheet_checks(answers: DataFrame) -> DataFrame:
    """Rows with an answer: preference domain, digit seed, annotator, duplicates."""
    filled = answers.filter((strip(F.col("comparison_id")) != "") & (strip(F.col("preference")) != ""))
    counts = filled.groupBy("annotator_id", "comparison_id").agg(F.count(F.lit(1)).alias("_n"))
    seed = strip(F.coalesce("presentation_seed", F.lit("")))
    return (
        filled.join(counts, ["annotator_id", "comparison_id"], "left")
        .withColumn(
            "reject_reasons",
            reasons(
                (~strip(F.col("preference")).isin("A", "B", "tie"), "preference"),
                (strip(F.col("annotator_id")) == "", "annotator_id"),
                ((seed != "") & ~seed.rlike(r"^\d+$"), "presentation_seed"),
                (F.coalesce(F.col("_n"), F.lit(1)) > 1, "duplicate_answer"),
            ),
        )
        .drop("_n")
    )
