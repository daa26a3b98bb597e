"""Prompt manifests: building rows, selecting subsets, redaction."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions import text as X
from pairlens.functions.ordering import first_by, row_index
from pairlens.functions.rows import once

# Limits and texts of the prompt sets
MAX_LENGTH = 6000
HARD, HARD100 = 20, 100
NO_CONSTRAINTS = "No separate output constraints; follow prompt_text."
EMBEDDED_CONSTRAINTS = (
    "Follow all task, language, audience, format, style, length, and "
    "content constraints embedded in prompt_text."
)
CONTEXT_ONLY = (
    "Use only the supplied task context and input; do not retrieve or rely on outside sources."
)
GROUP_ASSIGNMENT = (
    "A group of participants answered the question with the opinions supplied. "
    "Write a statement the group could endorse."
)
MISSING_OPINION = "No opinion was provided."
GROUP_SIZE = 5


def writing_rows(source: DataFrame) -> DataFrame:
    """``(index, query, checklist)`` to manifest rows."""
    return source.select(
        F.format_string("writingbench-%04d", F.col("index")).alias("prompt_id"),
        F.col("query").alias("prompt_text"),
        F.array(F.lit(EMBEDDED_CONSTRAINTS)).alias("requested_output_constraints"),
        F.col("checklist").alias("native_payload"),
    )


def checklist_rows(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of ``(id, instruction, requirements, checklists, num_checklist)`` files.

    ``reject_reason`` names a row whose checklist is empty, blank or miscounted.
    """
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    constraints = F.coalesce("requirements", F.array().cast("array<string>"))
    blank = F.exists("checklists", lambda x: X.strip(F.coalesce(x, F.lit(""))) == "")
    reason = (
        F.when(F.col("id").isNull() | F.col("instruction").isNull(), "id_or_instruction")
        .when(F.col("checklists").isNull() | (F.size("checklists") <= 0) | blank, "checklists")
        .when(~F.col("num_checklist").eqNullSafe(F.size("checklists").cast("bigint")), "num_checklist")
    )
    return rows.select(
        F.concat(F.lit("hellobench-"), "id").alias("prompt_id"),
        F.col("instruction").alias("prompt_text"),
        F.when(F.size(constraints) == 0, F.array(F.lit(NO_CONSTRAINTS)))
        .otherwise(constraints)
        .alias("requested_output_constraints"),
        F.col("checklists").alias("native_payload"),
        reason.alias("reject_reason"),
    )


def task_rows(source: DataFrame) -> DataFrame:
    """Dev split rows with a nested task to manifest rows."""
    task = F.col("task")
    text = F.concat(
        F.lit("Task objective:\n"), task["task_objective"],
        F.lit("\n\nTask procedure/context:\n"), task["task_procedure"],
        F.lit("\n\nInput specification:\n"), task["task_input"],
        F.lit("\n\nSupplied input:\n"), F.col("example_input"),
    )
    stated = F.filter(F.array(task["task_output"], task["task_notes"]), lambda x: x != "")
    return source.filter(F.col("split") == "dev").select(
        F.concat(F.lit("dolomites-"), "example_id").alias("prompt_id"),
        text.alias("prompt_text"),
        F.concat(stated, F.array(F.lit(CONTEXT_ONLY))).alias("requested_output_constraints"),
    )


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the compact JSON of the columns in sorted key order, nulls left out."""
    return X.sha256_hex(F.to_json(F.struct(*sorted(columns))))


def sample_k(df: DataFrame, id_column: str, k: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Seeded sample of k ids per key, by the order of a digest.

    ``row_number <= k`` lets every task keep k rows per key before the shuffle.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column)))
    place = Window.partitionBy(*keys).orderBy("_draw", id_column)
    return (
        df.withColumn("_draw", draw)
        .withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") <= k)
        .drop("_draw", "_place")
    )


def difficulty(prompts: DataFrame) -> DataFrame:
    """Words, requested length and their sum; prompts beyond the limits are out."""
    measures = F.struct(
        X.word_count(F.col("prompt_text")).cast("bigint").alias("words"),
        X.requested_length(F.col("prompt_text"), F.col("constraints_json")).alias("requested"),
    )
    scored = once(prompts, "_m", measures).select("*", "_m.*").drop("_m")
    return scored.filter(
        (F.col("words") <= MAX_LENGTH) & (F.col("requested") <= MAX_LENGTH)
    ).withColumn("score", F.col("words") + F.col("requested"))


def hard_prompts(prompts: DataFrame, pilot: DataFrame, k: int = HARD100) -> DataFrame:
    """The k hardest prompts of each benchmark outside the pilot, with their rank."""
    left = prompts.join(pilot.select("prompt_id"), "prompt_id", "left_anti")
    place = Window.partitionBy("benchmark").orderBy(
        F.desc("score"), F.desc("words"), F.desc("requested"), F.desc("prompt_id")
    )
    return (
        difficulty(left)
        .select("benchmark", "prompt_id", "score", "words", "requested")
        .withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= k)
    )


def language_count(prompts: DataFrame) -> DataFrame:
    """Prompts written mainly in Chinese, per benchmark and overall."""
    return (
        prompts.withColumn("_chinese", X.is_chinese(F.col("prompt_text")))
        .rollup("benchmark")
        .agg(F.count(F.lit(1)).alias("prompts"), F.count_if("_chinese").alias("chinese"))
        .withColumn("benchmark", F.coalesce("benchmark", F.lit("all")))
    )


def tertiles(
    prompts: DataFrame, keys: Sequence[str], length: str, prompt_id: str, prefix: int = 4
) -> DataFrame:
    """Length tertile 0, 1 or 2 by position over (length, id).

    The length and the first characters of the id coarsen the order, so
    positions come from counts per bucket: neither a large group nor a length
    that very many prompts share is sorted in one task.
    """
    cut = prompts.withColumn("_prefix", F.left(prompt_id, F.lit(prefix)))
    placed = row_index(cut, keys, [length, "_prefix"], [prompt_id], "_place").drop("_prefix")
    sizes = prompts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    third = F.floor((F.col("_place") - 1) * 3 / F.col("_n"))
    return placed.join(sizes, list(keys)).withColumn(
        "tertile", F.least(third, F.lit(2)).cast("int")
    ).drop("_place", "_n")


def leak_scan(files: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Terms that still occur in a text or its path: (path, term, line), with the line of the first hit.

    Text compares with ASCII case folded, as bytes do; a hit in the path alone
    has line 0. The term list is a parameter; a term listed twice counts twice. One automaton of all terms
    reads each text once, where it lies; only hits leave the task. A null text or path holds nothing.
    """
    needles: dict[str, list[str]] = {}
    for term in terms:
        needles.setdefault(term.lower(), []).append(term)
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = files.select("path", F.lower("path").alias("_path"), folded.alias("_text"))

    def work(batches):
        automaton = ahocorasick.Automaton()
        for needle in filter(None, needles):
            automaton.add_word(needle, needle)
        automaton.make_automaton()

        def starts(text: str | None) -> dict[str, int]:
            """First place of each needle."""
            found = {"": 0} if text is not None and "" in needles else {}
            for end, needle in automaton.iter(text or "") if len(automaton) else ():
                if needle not in found:
                    found[needle] = end + 1 - len(needle)
                    if len(found) == len(needles):
                        break
            return found

        for batch in batches:
            hits = []
            for path, lowered, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                text, lines, line, seen = text.as_py(), {}, 1, 0
                for needle, start in sorted(starts(text).items(), key=lambda hit: hit[1]):
                    line += text.count("\n", seen, start)
                    lines[needle], seen = line, start
                places = {**dict.fromkeys(starts(lowered.as_py()), 0), **lines}
                hits += [(path.as_py(), term, place) for needle, place in places.items() for term in needles[needle]]
            columns = zip(*hits, strict=True) if hits else ([], [], [])
            kinds = (batch.schema.field("path").type, pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["path", "term", "line"]
            )

    return rows.mapInArrow(work, "path string, term string, line bigint")


def participant_order(ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First place of each participant in the source order of its group."""
    return ratings.groupBy(*keys, "participant_id").agg(F.min("ordinal").alias("first_place"))


def group_opinions(source: DataFrame) -> DataFrame:
    """First-iteration rows of the held-out split (named, or coded 4)."""
    split = F.col("split").cast("string")
    return source.filter(split.isin("OOD_TEST", "4") & (F.col("iteration_index") == 0))


def disagreement_groups(
    opinions: DataFrame, ratings: DataFrame, count: int, seed: int
) -> DataFrame:
    """Seeded sample of groups whose members disagree, with their numbered opinions.

    A group needs five participants with five distinct completed opinions (the
    last one of a participant counts, one invalid opinion voids the group),
    ratings on both sides of the midpoint, and exactly those five as raters.
    Only groups of that size are ever listed.
    """
    key = ["question_id", "launch_id", "round_id"]
    pair = ["question_id", "launch_id"]
    valid = (
        (F.col("status") == "COMPLETED")
        & F.col("opinion").isNotNull()
        & (X.strip(F.col("opinion")) != "")
        & (F.col("opinion") != MISSING_OPINION)
    )
    checked = opinions.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    voided = checked.groupBy(*key).agg(
        F.every("_valid").alias("_ok"), F.min_by("question_text", "ordinal").alias("question_text")
    )
    latest = first_by(checked.filter("_valid"), [*key, "participant_id"], ["ordinal"], ["opinion"], last=True)
    sizes = latest.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_members"), F.countDistinct("opinion").alias("_distinct")
    )
    whole = (
        sizes.filter((F.col("_members") == GROUP_SIZE) & (F.col("_distinct") == GROUP_SIZE))
        .join(voided.filter(F.col("_ok") & (X.strip(F.coalesce("question_text", F.lit(""))) != "")), key)
    )
    rated = ratings.filter(F.size("agreement") == 1).withColumn(
        "_value", X.likert(F.col("agreement")[0])
    ).filter(F.col("_value").isNotNull())
    split = rated.groupBy(*pair).agg(
        F.some(F.col("_value") < X.LIKERT_MIDPOINT).alias("_below"),
        F.some(F.col("_value") > X.LIKERT_MIDPOINT).alias("_above"),
    )
    raters = participant_order(rated, pair)
    five = raters.groupBy(*pair).agg(F.count(F.lit(1)).alias("_raters")).filter(
        F.col("_raters") == GROUP_SIZE
    ).join(split.filter(F.col("_below") & F.col("_above")), pair)
    members = (
        whole.select(*key, "question_text")
        .join(five.select(*pair), pair)
        .join(raters, pair)
        .join(latest, [*key, "participant_id"])
    )
    eligible = members.groupBy(*key, "question_text").agg(
        F.count(F.lit(1)).alias("_found"),
        X.numbered_list(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_place", "opinion"))), lambda x: x["opinion"]
            )
        ).alias("supplied_context"),
    ).filter(F.col("_found") == GROUP_SIZE)
    named = eligible.select(
        *key,
        F.concat_ws("-", F.lit("habermas"), "question_id", F.left("launch_id", F.lit(8))).alias("prompt_id"),
        F.concat(F.lit(GROUP_ASSIGNMENT + "\n\n### Question\n"), "question_text").alias("prompt_text"),
        F.array(F.lit(NO_CONSTRAINTS)).alias("requested_output_constraints"),
        "supplied_context",
        F.concat_ws("/", *key).alias("_id"),
    )
    return sample_k(named, "_id", count, seed).drop("_id")

