"""Pairwise judgments: semantic winners, collapsed verdicts and cell reports.

A judgment record names a winner A, B or tie for one presentation order of a
pair. A pair is counted for a judge only when both orders have a valid record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.ordering import first_by
from pairlens.functions.stats import (
    critical_candidates,
    record_columns,
    sign_test_p,
    sign_test_power,
    win_rate,
    wilson_bounds,
)
from pairlens.session import spread

# The domains of a pairwise record
PRESENTATIONS = ("A|B", "B|A")
WINNERS = ("A", "B", "tie")
PLATFORM_DEFAULT = "codex"
SIGNIFICANCE = 0.05

PROMPT = ["benchmark", "platform", "prompt"]
CONTRAST = ["left_condition", "right_condition"]
CELL = ["benchmark", "platform", *CONTRAST]
PAIR = [*PROMPT, *CONTRAST, "judge_id"]


def match_contrast(
    pairs: DataFrame, contrasts: DataFrame, first: str = "first_condition", second: str = "second_condition"
) -> DataFrame:
    """First contrast in list order whose two conditions are the pair's set.

    ``contrasts(ordinal, left_condition, right_condition)`` is a parameter table.
    """
    sets = contrasts.groupBy(
        F.least("left_condition", "right_condition").alias("_low"),
        F.greatest("left_condition", "right_condition").alias("_high"),
    ).agg(F.min(F.struct("ordinal", "left_condition", "right_condition")).alias("_c"))
    keyed = pairs.withColumn("_low", F.least(first, second)).withColumn(
        "_high", F.greatest(first, second)
    )
    return (
        keyed.join(sets, ["_low", "_high"])
        .withColumn("left_condition", F.col("_c.left_condition"))
        .withColumn("right_condition", F.col("_c.right_condition"))
        .withColumn("swapped", F.col(first) != F.col("left_condition"))
        .drop("_low", "_high", "_c")
    )


def mapping_index(presentation: Column, order_mapping: Column, side: str) -> Column:
    """Source position (0 or 1) shown on one side of a presentation.

    An empty mapping means A|B = (0, 1) and B|A = (1, 0); a presentation the
    list does not name falls back to (0, 1). A repeated presentation takes its
    last entry.
    """
    named = F.filter(order_mapping, lambda m: m["presentation"].isNotNull())
    hits = F.filter(named, lambda m: m["presentation"] == presentation)
    output = F.element_at(F.transform(hits, lambda m: m[f"{side}_output"]), -1)
    listed = F.when(output.eqNullSafe(F.lit("first_run")), 0).otherwise(1)
    plain = F.lit(0 if side == "first" else 1)
    implied = (
        F.when(presentation == "B|A", 1 - plain).otherwise(plain)
    )
    return (
        F.when(order_mapping.isNull() | (F.size(named) <= 0), implied)
        .when(F.size(hits) <= 0, plain)
        .otherwise(listed)
    )


def semantic_winner(
    winner: Column, presentation: Column, order_mapping: Column, conditions: Column
) -> Column:
    """Condition named by a record's winner, or ``tie``."""
    first = mapping_index(presentation, order_mapping, "first")
    second = mapping_index(presentation, order_mapping, "second")
    index = F.when(winner == "A", first).otherwise(second)
    return F.when(winner == "tie", F.lit("tie")).otherwise(
        F.element_at(conditions, index.cast("int") + 1)
    )


def strict_mapping_reason(order_mapping: Column) -> Column:
    """Null when the mapping is the complementary pair, else the reject reason."""
    allowed = F.array(F.lit("first_run"), F.lit("compare_run"))
    entry_ok = lambda m: (
        m["presentation"].isin(*PRESENTATIONS)
        & F.array_contains(allowed, m["first_output"])
        & F.array_contains(allowed, m["second_output"])
        & (m["first_output"] != m["second_output"])
    )
    one, two = F.get(order_mapping, F.lit(0)), F.get(order_mapping, F.lit(1))
    good = (
        order_mapping.isNotNull()
        & (F.size(order_mapping) == 2)
        & F.forall(order_mapping, lambda m: F.coalesce(entry_ok(m), F.lit(False)))
        & (one["presentation"] != two["presentation"])
        & (one["first_output"] != two["first_output"])
    )
    return F.when(F.coalesce(good, F.lit(False)), F.lit(None).cast("string")).otherwise(
        F.lit("invalid_order_mapping")
    )


def collapse(first: Column, second: Column, left: Column, right: Column) -> Column:
    """left or right when both presentations agree on it, else tie."""
    return (
        F.when((first == left) & (second == left), F.lit("left"))
        .when((first == right) & (second == right), F.lit("right"))
        .otherwise(F.lit("tie"))
    )


def valid_records(records: DataFrame) -> DataFrame:
    return records.filter(
        F.col("presentation").isin(*PRESENTATIONS) & F.col("winner").isin(*WINNERS)
    )


# Verdicts travel as small integers, so aggregates stay hash aggregates
TIE, LEFT, RIGHT = 0, 1, 2


def side_code(outcome: Column) -> Column:
    """1 for the left condition, 2 for the right one, 0 for a tie."""
    return (
        F.when(outcome == F.col("left_condition"), LEFT)
        .when(outcome == F.col("right_condition"), RIGHT)
        .otherwise(TIE)
    )


def code_name(code: Column) -> Column:
    return F.when(code == LEFT, "left").when(code == RIGHT, "right").otherwise("tie")


def _shown(presentation: str, value: Column) -> Column:
    return F.when(F.col("presentation") == presentation, value)


def sides(records: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """One row per pair with the codes of both presentations.

    ``records`` carries ``outcome`` (a condition or tie). A pair stays only when
    each presentation has exactly one valid record.
    """
    code = side_code(F.col("outcome"))
    one = valid_records(records).groupBy(*keys).agg(
        F.count_if(F.col("presentation") == "A|B").alias("_n_ab"),
        F.count_if(F.col("presentation") == "B|A").alias("_n_ba"),
        F.max(_shown("A|B", code)).alias("code_ab"),
        F.max(_shown("B|A", code)).alias("code_ba"),
    )
    return one.filter((F.col("_n_ab") == 1) & (F.col("_n_ba") == 1)).drop("_n_ab", "_n_ba")


def first_sides(
    records: DataFrame, place: Column, keys: Sequence[str] = PAIR, values: Sequence[str] = ()
) -> DataFrame:
    """The same where a presentation may have several records: the first counts.

    ``place`` is one fixed-width value that orders the records. Codes, place and
    ``values`` (numbers) fit a hash aggregate, so records are combined before
    the shuffle without a sort.
    """
    code = side_code(F.col("outcome"))
    columns = []
    for name, source in (("code", code), *((v, F.col(v)) for v in values)):
        for suffix, shown in (("ab", "A|B"), ("ba", "B|A")):
            columns.append(
                F.min_by(_shown(shown, source), _shown(shown, place)).alias(f"{name}_{suffix}")
            )
    found = valid_records(records).groupBy(*keys).agg(*columns)
    return found.filter(F.col("code_ab").isNotNull() & F.col("code_ba").isNotNull())


def pair_verdicts(pairs: DataFrame) -> DataFrame:
    """Collapsed verdict and agreement flag of each complete pair and judge."""
    same = F.col("code_ab") == F.col("code_ba")
    code = F.when(same, F.col("code_ab")).otherwise(TIE)
    return (
        pairs.withColumn("code", code)
        .withColumn("verdict", code_name(F.col("code")))
        .withColumn("consistent", same)
    )


def prompt_rows(verdicts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Per prompt: the code across judges (unanimous, else tie) and its counts."""
    same = F.min("code") == F.max("code")
    named = lambda c: (F.col("code_ab") == c).cast("int") + (F.col("code_ba") == c).cast("int")
    return verdicts.groupBy(*extra, *PROMPT, *CONTRAST).agg(
        F.when(same, F.min("code")).otherwise(TIE).alias("code"),
        (~same).cast("int").alias("judges_disagree"),
        F.count(F.lit(1)).alias("observations"),
        F.count_if(~F.col("consistent")).alias("presentation_disagreements"),
        F.sum(named(LEFT)).alias("record_wins"),
        F.sum(named(RIGHT)).alias("record_losses"),
    )


def prompt_verdicts(verdicts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Verdict across judges, by name."""
    rows = prompt_rows(verdicts, extra)
    return rows.withColumn("verdict", code_name(F.col("code"))).drop("record_wins", "record_losses")


def code_tally() -> list[Column]:
    code = F.col("code")
    return [
        F.count_if(code == LEFT).alias("wins"),
        F.count_if(code == RIGHT).alias("losses"),
        F.count_if(code == TIE).alias("ties"),
    ]


def tally(verdict: str = "verdict") -> list[Column]:
    column = F.col(verdict)
    return [
        F.count_if(column == "left").alias("wins"),
        F.count_if(column == "right").alias("losses"),
        F.count_if(column == "tie").alias("ties"),
    ]


def prompt_collapsed(verdicts: DataFrame) -> DataFrame:
    """Confirmatory cell counts: one verdict per prompt."""
    return prompt_rows(verdicts).groupBy(*CELL).agg(
        *code_tally(),
        F.sum("presentation_disagreements").alias("presentation_disagreements"),
        F.sum("judges_disagree").alias("judge_disagreements"),
        F.sum("observations").alias("judge_prompt_observations"),
        F.count(F.lit(1)).alias("prompt_total"),
    )


def games(verdicts: DataFrame) -> DataFrame:
    """Both presentations as separate games."""
    shown = verdicts.withColumn("_code", F.explode(F.array("code_ab", "code_ba")))
    return shown.withColumn("result", code_name(F.col("_code"))).drop("_code")


def record_pooled(verdicts: DataFrame) -> DataFrame:
    """Counts over both presentations of all judges.

    Counts are taken on the pair row, so the games are never materialised.
    """
    named = lambda c: (F.col("code_ab") == c).cast("int") + (F.col("code_ba") == c).cast("int")
    counted = verdicts.groupBy(*CELL).agg(
        F.sum(named(LEFT)).alias("wins"),
        F.sum(named(RIGHT)).alias("losses"),
        F.count(F.lit(1)).alias("_pairs"),
    )
    return counted.withColumn(
        "ties", 2 * F.col("_pairs") - F.col("wins") - F.col("losses")
    ).drop("_pairs")


def both_estimands(verdicts: DataFrame) -> DataFrame:
    """Prompt-collapsed and record-pooled counts from one pass over the prompts."""
    records = 2 * F.sum("observations")
    cells = prompt_rows(verdicts).groupBy(*CELL).agg(
        *code_tally(),
        F.sum("record_wins").alias("_w"),
        F.sum("record_losses").alias("_l"),
        records.alias("_n"),
    )
    row = lambda name, w, l, t: F.struct(
        F.lit(name).alias("estimand"), w.alias("wins"), l.alias("losses"), t.alias("ties")
    )
    w, l = F.col("_w"), F.col("_l")
    stacked = F.explode(
        F.array(
            row("prompt_collapsed", F.col("wins"), F.col("losses"), F.col("ties")),
            row("record_pooled", w, l, F.col("_n") - w - l),
        )
    )
    return cells.select(*CELL, stacked.alias("_r")).select(*CELL, "_r.*")


def holm(
    cells: DataFrame,
    family: Sequence[str],
    p: str = "p_raw",
    order: Sequence[str] = ("left_condition", "right_condition"),
    out: str = "p_holm",
) -> DataFrame:
    """Holm step-down adjustment inside each family of report cells."""
    ranked = Window.partitionBy(*family).orderBy(p, *order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (size - F.row_number().over(ranked) + 1) * F.col(p))
    running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("_step", step).withColumn(out, F.max("_step").over(running)).drop("_step")


# Fixed value: independent run sets of the confirmatory family
FAMILY_RUNS = 3


def family_members(
    run_sets: Sequence, contrasts: Sequence[tuple[str, str]], locked: Sequence[tuple[str, str]], current=None
) -> list[tuple]:
    """Members of the confirmatory family in order, as (run set, left, right, label).

    The family is named before any result is seen: exactly FAMILY_RUNS different run sets, the current one among
    them, and the locked contrasts in their order. Anything else is an error.
    """
    if len(set(run_sets)) != len(run_sets):
        raise ValueError("a run set is in the family twice")
    if len(run_sets) != FAMILY_RUNS:
        raise ValueError(f"the family needs exactly {FAMILY_RUNS} run sets, not {len(run_sets)}")
    if current is not None and current not in run_sets:
        raise ValueError("the current run set is not in the family")
    if list(map(tuple, contrasts)) != list(map(tuple, locked)):
        raise ValueError("the contrasts of the family are not the locked ones")
    return [
        (run_set, left, right, f"run-{place}:{left}:{right}")
        for place, run_set in enumerate(run_sets, start=1)
        for left, right in contrasts
    ]


def holm_over_runs(cells: DataFrame, members: Sequence[tuple], family: Sequence[str], run_set: str = "run_set", p: str = "p_raw") -> DataFrame:
    """Holm adjustment over the members of each family, which lie in several run sets.

    Cells that are no member are left out and count for nothing. ``member`` is the label, ``family_size`` the members
    that have a cell, and ``complete`` tells that all of them do.
    """
    kind = cells.schema[run_set].dataType.simpleString()
    left, right = CONTRAST
    table = cells.sparkSession.createDataFrame(
        list(members), f"`{run_set}` {kind}, {left} string, {right} string, member string"
    )
    named = cells.join(F.broadcast(table), [run_set, left, right])
    adjusted = holm(named, family, p, order=(run_set, left, right))
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    return adjusted.withColumn("family_size", size).withColumn("complete", F.col("family_size") == len(members))


def pairwise_report(verdicts: DataFrame) -> DataFrame:
    """Both estimands with statistics and family-wise adjusted p-values."""
    cells = both_estimands(verdicts).select("*", *record_columns())
    return holm(cells, ["benchmark", "platform", "estimand"])


def position_consistency(verdicts: DataFrame) -> DataFrame:
    """Share of pairs whose presentations agree, per judge and over judges."""
    per_judge = verdicts.groupBy("benchmark", "platform", "judge_id").agg(
        F.avg(F.col("consistent").cast("double")).alias("rate"),
        F.count(F.lit(1)).alias("scored_pairs"),
    )
    over = per_judge.groupBy("benchmark", "platform").agg(
        F.avg("rate").alias("rate"), F.sum("scored_pairs").alias("scored_pairs")
    )
    return per_judge.unionByName(over.withColumn("judge_id", F.lit("all")))


def missing_pairs(runs: DataFrame, contrasts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Expected, scored and missing pairs per benchmark and platform.

    Every distinct prompt of any canonical run is expected once per contrast, so
    the expected number is prompts times contrasts; nothing is enumerated.
    """
    n = contrasts.agg(F.count(F.lit(1)).alias("n_contrasts"))
    expected = (
        runs.select(*PROMPT)
        .distinct()
        .groupBy("benchmark", "platform")
        .agg(F.count(F.lit(1)).alias("prompts"))
        .join(F.broadcast(n))
        .withColumn("expected_pairs", F.col("prompts") * F.col("n_contrasts"))
    )
    scored = (
        verdicts.select(*PROMPT, *CONTRAST)
        .distinct()
        .groupBy("benchmark", "platform")
        .agg(F.count(F.lit(1)).alias("scored_pairs"))
    )
    done = F.coalesce(F.col("scored_pairs"), F.lit(0))
    return expected.join(scored, ["benchmark", "platform"], "left").select(
        "benchmark",
        "platform",
        "expected_pairs",
        done.alias("scored_pairs"),
        (F.col("expected_pairs") - done).alias("missing_pairs"),
    )


def orient(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cells in the wanted direction: stored ones first, else flipped ones."""
    value = ["wins", "losses", "ties", "win_rate", "wilson_low", "wilson_high"]
    direct = cells.select("benchmark", "platform", *CONTRAST, *value, F.lit(0).alias("flipped"))
    reverse = cells.select(
        "benchmark",
        "platform",
        F.col("right_condition").alias("left_condition"),
        F.col("left_condition").alias("right_condition"),
        F.col("losses").alias("wins"),
        F.col("wins").alias("losses"),
        "ties",
        (1 - F.col("win_rate")).alias("win_rate"),
        (1 - F.col("wilson_high")).alias("wilson_low"),
        (1 - F.col("wilson_low")).alias("wilson_high"),
        F.lit(1).alias("flipped"),
    )
    both = direct.unionByName(reverse).join(wanted.select(*CONTRAST).distinct(), CONTRAST)
    return first_by(both, CELL, ["flipped"], [*value, "flipped"])


def pooled_over_benchmarks(cells: DataFrame, z: float = 1.96) -> DataFrame:
    """Sum of cells over benchmarks per contrast, clamped Wilson interval."""
    pooled = cells.groupBy("platform", *CONTRAST).agg(
        *[F.sum(name).alias(name) for name in ("wins", "losses", "ties")]
    )
    low, high = wilson_bounds(F.col("wins"), F.col("losses"), z, clamp=True)
    return pooled.select(
        "*",
        win_rate(F.col("wins"), F.col("losses")).alias("win_rate"),
        low.alias("wilson_low"),
        high.alias("wilson_high"),
    )


def clustered_sign(outcomes: DataFrame, keys: Sequence[str], unit: Sequence[str]) -> DataFrame:
    """Sign test with the prompt as the unit: net outcome per prompt, then T1."""
    score = F.when(F.col("outcome") == "win", 1).when(F.col("outcome") == "loss", -1).otherwise(0)
    net = outcomes.groupBy(*keys, *unit).agg(F.sum(score).alias("_net"))
    counted = net.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prompts"),
        F.count_if(F.col("_net") > 0).alias("prompt_wins"),
        F.count_if(F.col("_net") < 0).alias("prompt_losses"),
        F.count_if(F.col("_net") == 0).alias("prompt_ties"),
    )
    return counted.withColumn(
        "prompt_sign_test_p", sign_test_p(F.col("prompt_wins"), F.col("prompt_losses"))
    )


def critical_counts(cells: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """Largest losing count that the sign test still rejects, -1 when there is none.

    ``cells(keys, n)``; a handful of candidates per cell is tested exactly.
    """
    tested = cells.withColumn("_k", F.explode(critical_candidates(F.col("n"), alpha)))
    fits = (
        (F.col("_k") >= 0)
        & (F.col("_k") <= F.col("n"))
        & (sign_test_p(F.col("_k"), F.col("n") - F.col("_k")) <= alpha)
    )
    return tested.groupBy(*keys, "n").agg(
        F.coalesce(F.max(F.when(fits, F.col("_k"))), F.lit(-1)).alias("critical")
    )


def power_table(cells: DataFrame, keys: Sequence[str], rates: Column, alpha: float) -> DataFrame:
    """Exact sign test power of each cell at each rate of a grid."""
    rows = critical_counts(cells, keys, alpha).withColumn("rate", F.explode(rates))
    power = sign_test_power(F.col("n"), F.col("rate"), F.col("critical"))
    return spread(rows, *keys, "rate").withColumn("power", power).drop("critical")


BISECTIONS = 80


def detectable_rate(cells: DataFrame, keys: Sequence[str], alpha: float, target: float) -> DataFrame:
    """Smallest rate from one half upwards with enough power, by bisection; 1 where no rate has it."""
    rows = spread(critical_counts(cells, keys, alpha), *keys, "n")

    def halve(ends: Column, _: Column) -> Column:
        middle = (ends["low"] + ends["high"]) / 2
        enough = sign_test_power(F.col("n"), middle, F.col("critical")) >= target
        return F.struct(
            F.when(enough, ends["low"]).otherwise(middle).alias("low"),
            F.when(enough, middle).otherwise(ends["high"]).alias("high"),
        )

    start = F.struct(F.lit(0.5).alias("low"), F.lit(1.0).alias("high"))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)
    return rows.select(*keys, "n", ends["high"].alias("detectable_rate"))
