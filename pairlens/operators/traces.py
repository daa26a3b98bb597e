"""Process traces: sequences, transitions, cycle compliance and trace quality.

A trace row has ``run_id``, an order (``ORDER``) and ``bucket``, a column that
coarsens the order inside a run, so a very long run is worked on by many tasks.
Run attributes such as the run set or the condition ride along as ``attrs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.ordering import exact_quantiles, previous_value, row_index, running_count
from pairlens.functions.stats import fisher_exact_p, win_rate, wilson_bounds
from pairlens.functions.text import parse_offset_timestamp
from pairlens.session import written

ORDER = ["ts", "event_id"]
# Event types, end markers and the fixed process order
SWITCH = "process_switch"
GOAL_EVENTS = ("goal_created", "goal_developed", "goal_regenerated")
REGENERATION = "goal_regenerated"
EVENT_TYPES = (SWITCH, *GOAL_EVENTS)
START, END = "START", "END"
FIXED_ORDER = ("planning", "translating", "reviewing")
REVIEW, TRANSLATE, TERMINATION = "reviewing", "translating", "termination"
#: Targets in a block of a sequence; sequences of any length come whole, in blocks.
SEQUENCE_BLOCK = 1000


def blank_name(column: str) -> Column:
    """A switch endpoint that is neither null nor a name."""
    return F.col(column).isNotNull() & (F.trim(F.col(column)) == "")


def switches(trace: DataFrame) -> DataFrame:
    """Switch events with a target."""
    return trace.filter((F.col("event_type") == SWITCH) & F.col("to_process").isNotNull())


def ordered_switches(trace: DataFrame) -> DataFrame:
    """Targets with their position, the target before and the collapsed position.

    ``previous`` is the last observed target; ``from_process`` is ignored.
    ``step`` counts targets after immediate repeats are dropped. Rows are
    ordered inside (run, bucket); one summary row per bucket carries the number
    of targets, the number of steps and the last target on to later buckets.
    """
    group = ["run_id", "bucket"]
    local = Window.partitionBy(*group).orderBy(*ORDER)
    rows = switches(trace).withColumns(
        {"_place": F.row_number().over(local), "_near": F.lag("to_process").over(local)}
    )
    inner = F.when(F.col("_near") != F.col("to_process"), 1).otherwise(0)
    rows = rows.withColumn("_inner", F.sum(inner).over(local))
    place = F.col("_place")
    summary = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_inner").alias("_changes"),
        F.max(F.when(place == 1, F.col("to_process"))).alias("_first"),
        F.max_by("to_process", place).alias("_last"),
    )
    by_bucket = Window.partitionBy("run_id").orderBy("bucket")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("_carried").isNull() | (F.col("_carried") != F.col("_first")), 1).otherwise(0)
    carried = (
        summary.withColumn("_carried", F.lag("_last").over(by_bucket))
        .withColumn("_opens", opens)
        .select(
            *group,
            "_carried",
            "_opens",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.coalesce(F.sum(F.col("_changes") + F.col("_opens")).over(before), F.lit(0)).alias("_steps"),
        )
    )
    previous = F.coalesce("_near", "_carried")
    return (
        rows.join(carried, group)
        .withColumns(
            {
                "place": (place + F.col("_offset")).cast("bigint"),
                "previous": previous,
                "changed": previous.isNull() | (previous != F.col("to_process")),
                "step": (F.col("_steps") + F.col("_opens") + F.col("_inner")).cast("bigint"),
            }
        )
        .drop("_place", "_near", "_inner", "_carried", "_opens", "_offset", "_steps")
    )


def run_ends(trace: DataFrame, attrs: Sequence[str] = ()) -> DataFrame:
    """Every run with its first and last target, null when it never switched."""
    target = F.when(
        (F.col("event_type") == SWITCH) & F.col("to_process").isNotNull(), F.col("to_process")
    )
    place = F.when(target.isNotNull(), F.struct(*ORDER))
    return trace.groupBy("run_id", *attrs).agg(
        F.min_by(target, place).alias("first_target"),
        F.max_by(target, place).alias("last_target"),
        F.count_if(F.col("event_type") == REGENERATION).alias("regenerations"),
        F.count(F.lit(1)).alias("events"),
    )


def transitions(trace: DataFrame, attrs: Sequence[str] = ()) -> DataFrame:
    """Transition counts per run attribute: START, targets, and one END per run."""
    steps = ordered_switches(trace).select(
        *attrs, F.coalesce("previous", F.lit(START)).alias("source"), F.col("to_process").alias("target")
    )
    ends = run_ends(trace, attrs).select(
        *attrs, F.coalesce("last_target", F.lit(START)).alias("source"), F.lit(END).alias("target")
    )
    return steps.unionByName(ends).groupBy(*attrs, "source", "target").agg(
        F.count(F.lit(1)).alias("n")
    )


def after_state(trace: DataFrame, attrs: Sequence[str] = ()) -> DataFrame:
    """What follows reviewing: event counts and the number of runs it occurs in."""
    follows = (
        ordered_switches(trace)
        .filter(F.col("previous") == REVIEW)
        .groupBy("run_id", *attrs, F.col("to_process").alias("next"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    ended = (
        run_ends(trace, attrs)
        .filter(F.col("last_target") == REVIEW)
        .select("run_id", *attrs, F.lit(TERMINATION).alias("next"), F.lit(1).cast("bigint").alias("events"))
    )
    return follows.unionByName(ended).groupBy(*attrs, "next").agg(
        F.sum("events").alias("events"), F.count(F.lit(1)).alias("runs")
    )


def first_delegated(transport: DataFrame) -> DataFrame:
    """Role named by the first native delegation event of each run.

    The first delegation whose prompt names a process counts, in file and line
    order.
    """
    role = F.lower(
        F.regexp_extract("prompt", r"(?i)\b(planning|translating|reviewing)\b", 1)
    )
    spawned = transport.filter(
        (F.col("type") == "item.started")
        & (F.col("item_type") == "collab_tool_call")
        & (F.col("tool") == "spawn_agent")
    ).withColumn("_role", role)
    return (
        spawned.filter(F.col("_role") != "")
        .groupBy("run_id")
        .agg(F.min_by("_role", F.struct("file", "line")).alias("first_delegated"))
    )


def run_details(
    trace: DataFrame,
    attrs: Sequence[str] = (),
    delegated: DataFrame | None = None,
    fixed_order: Sequence[str] = FIXED_ORDER,
) -> DataFrame:
    """One row per run: compliance, exactness, passes, returns and regenerations.

    Every flag is a plain aggregate over the ordered targets, so no run is ever
    gathered into an array. A reconstructed leading step shifts all positions by
    one; it counts for compliance and exactness only.
    """
    size = len(fixed_order)
    order = F.array(*[F.lit(x) for x in fixed_order])
    runs = run_ends(trace, attrs)
    if delegated is not None:
        runs = runs.join(delegated, "run_id", "left")
    else:
        runs = runs.withColumn("first_delegated", F.lit(None).cast("string"))
    lead = F.coalesce(
        F.col("first_target").isNotNull()
        & (F.col("first_delegated") == fixed_order[0])
        & (F.col("first_target") != fixed_order[0]),
        F.lit(False),
    )
    rows = ordered_switches(trace)
    if delegated is not None:
        planned = delegated.filter(F.col("first_delegated") == fixed_order[0]).select("run_id")
        starts = (
            rows.filter((F.col("place") == 1) & (F.col("to_process") != fixed_order[0]))
            .join(planned, "run_id", "left_semi")
            .select("run_id", F.lit(1).alias("shift"))
        )
        rows = rows.join(starts, "run_id", "left")
    else:
        rows = rows.withColumn("shift", F.lit(None).cast("int"))
    shift = F.coalesce("shift", F.lit(0))
    due = lambda position: F.element_at(
        order, ((position + shift - 1) % size + 1).cast("int")
    )
    repeats = F.when(~F.col("changed"), F.col("to_process"))
    flags = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("switches"),
        F.count_if("changed").alias("steps"),
        F.every(F.col("to_process") == due(F.col("place"))).alias("_in_place"),
        F.every(~F.col("changed") | (F.col("to_process") == due(F.col("step")))).alias("_in_cycle"),
        F.min(repeats).alias("_low"),
        F.max(repeats).alias("_high"),
        F.max(shift).alias("shift"),
        F.count_if((F.col("previous") == REVIEW) & (F.col("to_process") == TRANSLATE)).alias("returns"),
    )
    length = F.col("steps") + F.col("shift")
    cyclic = F.coalesce(F.col("_in_cycle") & (length > 0) & (length % size == 0), F.lit(False))
    one_pass = cyclic & (length == size)
    single = one_pass & (F.col("_low").isNull() | (F.col("_low") == F.col("_high")))
    exact = F.coalesce(
        F.col("_in_place") & (F.col("switches") + F.col("shift") == size), F.lit(False)
    )
    return runs.join(flags, "run_id", "left").select(
        "run_id",
        *attrs,
        "first_target",
        "first_delegated",
        F.coalesce("switches", F.lit(0)).alias("sequence_length"),
        lead.alias("reconstructed"),
        cyclic.alias("cycle_compliant"),
        F.when(cyclic, (length / size).cast("bigint")).alias("cycle_passes"),
        exact.alias("single_cycle_exact"),
        F.coalesce(single, F.lit(False)).alias("single_repeat"),
        F.coalesce("returns", F.lit(0)).alias("returns"),
        "regenerations",
        "events",
    )


def sequence_blocks(trace: DataFrame, block: int = SEQUENCE_BLOCK) -> DataFrame:
    """(run_id, block, steps, sequence) of every run with targets: the targets of a block in order, joined by ">"."""
    rows = row_index(switches(trace), ["run_id"], ["bucket"], ORDER, "place")
    number = F.floor((F.col("place") - 1) / block).cast("bigint").alias("block")
    ordered = F.array_sort(F.collect_list(F.struct("place", "to_process")))
    return rows.groupBy("run_id", number).agg(
        F.count(F.lit(1)).alias("steps"), F.array_join(F.transform(ordered, lambda x: x["to_process"]), ">").alias("sequence")
    )


def _whole(runs: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Blocks beside their rows; rows without targets have one empty block."""
    return runs.join(blocks, key, "left").withColumns(
        {"block": F.coalesce("block", F.lit(0).cast("bigint")), "sequence": F.coalesce("sequence", F.lit(""))}
    )


def process_sequences(trace: DataFrame, attrs: Sequence[str] = (), block: int = SEQUENCE_BLOCK) -> DataFrame:
    """Sequence of targets per run, whole, in blocks: (run_id, attrs, length, block, sequence)."""
    blocks = sequence_blocks(trace, block)
    length = F.coalesce(F.sum("steps").over(Window.partitionBy("run_id")), F.lit(0)).alias("length")
    runs = trace.select("run_id", *attrs).distinct()
    return _whole(runs, blocks, "run_id").select("run_id", *attrs, length, "block", "sequence")


def sequence_lengths(trace: DataFrame, attrs: Sequence[str] = ()) -> DataFrame:
    """Number of targets per run."""
    counts = switches(trace).groupBy("run_id").agg(F.count(F.lit(1)).alias("length"))
    return trace.select("run_id", *attrs).distinct().join(counts, "run_id", "left").fillna(0, ["length"])


def sequence_counts(trace: DataFrame, attrs: Sequence[str], block: int = SEQUENCE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences by content: (attrs, length, digest, first, n, total, rate) and their blocks (digest, block, sequence).

    Every block has two hashes of its place and text; a sequence's digest is their sums, so runs of any length meet as
    one small row. ``first`` is the text of the first block.
    """
    blocks = written(sequence_blocks(trace, block), "sequence_blocks")

    def total(salt: int) -> Column:
        return F.sum(F.xxhash64(F.lit(salt), "block", "sequence").cast("decimal(38,0)")).cast("string")

    runs = blocks.groupBy("run_id").agg(
        F.sum("steps").alias("length"), F.concat_ws(":", total(1), total(2)).alias("digest"), F.max(F.when(F.col("block") == 0, F.col("sequence"))).alias("first")
    )
    found = written(
        trace.select("run_id", *attrs).distinct().join(runs, "run_id", "left").fillna({"length": 0, "digest": "", "first": ""}), "run_digests"
    )
    counts = found.groupBy(*attrs, "length", "digest", "first").agg(F.count(F.lit(1)).alias("n"))
    shown = found.groupBy("digest").agg(F.min("run_id").alias("run_id"))
    return with_rate(counts, attrs), blocks.join(shown, "run_id").select("digest", "block", "sequence")


def with_rate(counts: DataFrame, attrs: Sequence[str], n: str = "n") -> DataFrame:
    """Share of each count in its group total."""
    totals = counts.groupBy(*attrs).agg(F.sum(n).alias("total"))
    return counts.join(totals, list(attrs)).withColumn("rate", F.col(n) / F.col("total"))


def sequence_distribution(trace: DataFrame, attrs: Sequence[str], block: int = SEQUENCE_BLOCK) -> DataFrame:
    """How often each sequence occurs: (attrs, length, n, total, rate), one row per block of the sequence."""
    counts, blocks = sequence_counts(trace, attrs, block)
    return _whole(counts, blocks, "digest").select(*attrs, "length", "block", "sequence", "n", "total", "rate")


def top_sequences(trace: DataFrame, attrs: Sequence[str], k: int = 5, block: int = SEQUENCE_BLOCK) -> DataFrame:
    """The k most frequent sequences in blocks; ties by length, then sequence.

    First blocks leave few candidates; only those are compared whole.
    """
    counts, blocks = sequence_counts(trace, attrs, block)
    near = Window.partitionBy(*attrs).orderBy(F.desc("n"), "length", "first")
    candidates = counts.withColumn("_near", F.rank().over(near)).filter(F.col("_near") <= k).drop("_near")
    texts = blocks.join(candidates.select("digest").distinct(), "digest").groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct("block", "sequence"))).alias("_blocks")
    )
    place = Window.partitionBy(*attrs).orderBy(F.desc("n"), "length", "_blocks")
    best = candidates.join(texts, "digest", "left").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("block"), F.lit("").alias("sequence")))
    return best.select(*attrs, "length", "n", "total", "rate", "rank", F.explode(F.coalesce("_blocks", one)).alias("_b")).select(
        *attrs, "length", F.col("_b.block").alias("block"), F.col("_b.sequence").alias("sequence"), "n", "total", "rate", "rank"
    )


def transition_matrix(
    counts: DataFrame, attrs: Sequence[str], fixed_order: Sequence[str] = FIXED_ORDER
) -> DataFrame:
    """Dense matrix over START, the fixed order, further states and END.

    The states are the process names of the contract: a short list per group,
    so the zero cells come from exploding that list.
    """
    named = counts.select(*attrs, F.explode(F.array("source", "target")).alias("state")).distinct()
    base = F.array(F.lit(START), *[F.lit(x) for x in fixed_order], F.lit(END))
    states = named.groupBy(*attrs).agg(
        F.array_union(base, F.array_sort(F.collect_set("state"))).alias("_states")
    )
    cells = states.select(*attrs, F.explode("_states").alias("source"), "_states").select(
        *attrs, "source", F.explode("_states").alias("target")
    )
    return cells.join(counts, [*attrs, "source", "target"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def regeneration_locations(trace: DataFrame) -> DataFrame:
    """Event process, active process and switch index of each regeneration.

    The active process is the last target before the event, else the event's
    own process; before the first switch the index is null.
    """
    is_switch = (F.col("event_type") == SWITCH) & F.col("to_process").isNotNull()
    target = F.when(is_switch, F.col("to_process"))
    rows = previous_value(trace, ["run_id"], ["bucket"], ORDER, target, "_active")
    rows = running_count(rows, ["run_id"], ["bucket"], ORDER, is_switch, "_index")
    return rows.filter(F.col("event_type") == REGENERATION).select(
        "run_id",
        F.col("process").alias("event_process"),
        F.coalesce("_active", "process").alias("active_process"),
        F.when(F.col("_index") > 0, F.col("_index")).alias("sequence_index"),
    )


def event_counters(trace: DataFrame) -> DataFrame:
    """Events by type, by process and by both."""
    return (
        trace.groupingSets(
            [["event_type"], ["process"], ["event_type", "process"]], "event_type", "process"
        )
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_cut"))
        .select(
            F.when(F.col("_cut") == 1, "event_type").when(F.col("_cut") == 2, "process").otherwise("both").alias("cut"),
            "event_type",
            "process",
            "n",
        )
    )


def trace_summary(details: DataFrame) -> DataFrame:
    """Compliance, exactness, return and regeneration rates per set and condition."""
    share = lambda flag: F.avg(flag.cast("double"))
    return (
        details.groupingSets(
            [["run_set", "condition"], ["condition"]], "run_set", "condition"
        )
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.count_if("cycle_compliant").alias("compliant_runs"),
            F.count_if("single_cycle_exact").alias("exact_runs"),
            F.count_if("single_repeat").alias("single_repeat_runs"),
            F.count_if("reconstructed").alias("reconstructed_runs"),
            F.count_if(F.col("returns") > 0).alias("return_runs"),
            F.count_if(F.col("regenerations") > 0).alias("regeneration_runs"),
            F.sum("regenerations").alias("regeneration_events"),
            share(F.col("cycle_compliant")).alias("compliance_rate"),
            share(F.col("single_cycle_exact")).alias("exact_rate"),
            share(F.col("returns") > 0).alias("return_rate"),
            share(F.col("regenerations") > 0).alias("regeneration_rate"),
            share((F.col("returns") == 0) & (F.col("regenerations") == 0)).alias("no_loop_rate"),
        )
        .select(
            F.coalesce(F.col("run_set").cast("string"), F.lit("pooled")).alias("run_set"),
            "condition",
            "run_count",
            "compliant_runs",
            "exact_runs",
            "single_repeat_runs",
            "reconstructed_runs",
            "return_runs",
            "regeneration_runs",
            "regeneration_events",
            "compliance_rate",
            "exact_rate",
            "return_rate",
            "regeneration_rate",
            "no_loop_rate",
        )
    )


def timestamp_plausibility(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Timestamp quality per run.

    ``events(run_id, bucket, pos, timestamp)`` in line order and
    ``runs(run_id, started_at, written_at)``, all ISO text. Order is checked
    against the last parseable event, even one outside the window. A run without
    a usable window has every parseable event outside it.
    """
    parsed = events.withColumn("_at", parse_offset_timestamp(F.col("timestamp")))
    rows = previous_value(parsed, ["run_id"], ["bucket"], ["pos"], F.col("_at"), "_before")
    window = runs.select(
        "run_id",
        (parse_offset_timestamp(F.col("started_at")) - F.expr("INTERVAL 60 SECONDS")).alias("_low"),
        (parse_offset_timestamp(F.col("written_at")) + F.expr("INTERVAL 60 SECONDS")).alias("_high"),
    )
    inside = F.coalesce(F.col("_at").between(F.col("_low"), F.col("_high")), F.lit(False))
    known = F.col("_at").isNotNull()
    report = rows.join(window, "run_id", "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~known).alias("unparseable"),
        F.count_if(known & ~inside).alias("out_of_window"),
        F.count_if(known & (F.col("_at") < F.col("_before"))).alias("non_monotonic"),
    )
    problems = F.col("unparseable") + F.col("out_of_window") + F.col("non_monotonic")
    return report.withColumn("plausible", problems == 0)


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in pairs])
    )


def event_reasons(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """Reasons each event breaks the contract of its condition.

    ``contracts(condition, processes, allowed, goal_policy, ...)`` is a few rows.
    Columns that hold JSON arrays come as arrays, null when absent or malformed.
    ``artifacts`` may be absent: ``has_artifacts`` tells a malformed one from that.
    An event whose condition has no contract has that one reason.
    """
    known = contracts.withColumn("_known", F.lit(True))
    rows = events.join(F.broadcast(known), "condition", "left")
    absent = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    listed = lambda c: F.array_contains("processes", F.col(c))
    is_switch = F.col("event_type") == SWITCH
    is_goal = F.col("event_type").isin(*GOAL_EVENTS)
    has_goal = F.col("has_goal_id") | F.col("has_parent_goal_id")
    bad_end = lambda c: is_switch & (
        ~F.col("has_" + c)
        | F.coalesce(F.trim(F.col(c)) == "", F.lit(False))
        | ~F.coalesce(listed(c), F.lit(True))
    )
    goal_row = is_goal | (has_goal & (F.col("goal_policy") == "allowed"))
    reasons = _reasons(
        (~F.coalesce(F.array_contains("allowed", F.col("event_type")), F.lit(False)), "event_type"),
        (absent("timestamp"), "timestamp"),
        (absent("responsible_agent"), "responsible_agent"),
        (absent("process"), "process"),
        (absent("decision"), "decision"),
        (~absent("process") & ~F.coalesce(listed("process"), F.lit(False)), "undeclared_process"),
        (F.col("evidence").isNull(), "evidence"),
        (F.col("open_uncertainty").isNull(), "open_uncertainty"),
        (F.col("has_artifacts") & F.col("artifacts").isNull(), "artifacts"),
        (F.coalesce(bad_end("from_process"), F.lit(False)), "from_process"),
        (F.coalesce(bad_end("to_process"), F.lit(False)), "to_process"),
        (
            F.coalesce((F.col("goal_policy") == "forbidden") & (is_goal | has_goal), F.lit(False)),
            "forbidden_goal",
        ),
        (F.coalesce(goal_row, F.lit(False)) & absent("goal_id"), "goal_id"),
        (F.coalesce(goal_row, F.lit(False)) & ~F.col("has_parent_goal_id"), "parent_goal_id"),
    )
    reasons = F.when(F.col("_known"), reasons).otherwise(F.array(F.lit("unknown_condition")))
    return rows.withColumn("reject_reasons", reasons).drop("_known")


def trace_reasons(checked: DataFrame) -> DataFrame:
    """Reasons a whole trace breaks its contract.

    Takes the rows of ``event_reasons`` with ``pos``, the 1-based line place. The
    exact process order is checked event by event, with no list per run.
    """
    order = F.col("process_order")
    place = F.col("pos").cast("int")
    fits = (
        (place <= F.size(order))
        & F.col("to_process").eqNullSafe(F.get(order, place - 1))
        & F.col("from_process").eqNullSafe(F.get(order, place - 2))
        & F.col("process").eqNullSafe(F.get(order, place - 1))
    )
    per_run = checked.groupBy("run_id", "condition").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.size("reject_reasons") > 0).alias("bad_events"),
        F.count_if(F.col("event_type").isin(*GOAL_EVENTS)).alias("goal_events"),
        F.any_value("min_events").alias("_min"),
        F.any_value("max_events").alias("_max"),
        F.any_value("require_goal").alias("_goal"),
        F.max(F.size(order)).alias("_size"),
        F.every(F.coalesce(fits, F.lit(False))).alias("_fits"),
    )
    ordered = F.col("_size") > 0
    reasons = _reasons(
        (F.col("bad_events") > 0, "bad_event"),
        (F.coalesce(F.col("events") < F.col("_min"), F.lit(False)), "too_few_events"),
        (F.coalesce(F.col("events") > F.col("_max"), F.lit(False)), "too_many_events"),
        (
            F.coalesce(ordered & ~(F.col("_fits") & (F.col("events") == F.col("_size"))), F.lit(False)),
            "process_order",
        ),
        (F.coalesce(F.col("_goal") & (F.col("goal_events") == 0), F.lit(False)), "goal_required"),
    )
    return per_run.select(
        "run_id", "condition", "events", "bad_events", "goal_events", reasons.alias("reject_reasons")
    )


def verdicts_with_trace(verdicts: DataFrame, details: DataFrame, key: Sequence[str]) -> DataFrame:
    """Prompt verdicts beside the trace detail of the same prompt."""
    return verdicts.join(details, list(key))


def cycle_association(joined: DataFrame, keys: Sequence[str], run_set: str) -> DataFrame:
    """Verdicts split by exact cycle, with Wilson intervals and a Fisher test, per run set and pooled.

    The pooled rows are sums of the run sets' counts under the name "pooled" in the column
    ``run_set``; verdicts without a run set count there alone.
    """
    exact = F.col("single_cycle_exact")
    is_ = lambda v, e: F.count_if((F.col("verdict") == v) & (exact if e else ~exact))
    counts = {
        f"{name}_{part}": is_(v, e)
        for part, e in (("exact", True), ("other", False))
        for v, name in (("left", "wins"), ("right", "losses"), ("tie", "ties"))
    }
    cells = joined.groupBy(F.col(run_set).cast("string").alias("run_set"), *keys).agg(
        *[c.alias(name) for name, c in counts.items()]
    )
    places = F.explode(F.array_compact(F.array(F.col("run_set"), F.lit("pooled"))))
    result = cells.withColumn("run_set", places).groupBy("run_set", *keys).agg(
        *[F.sum(name).alias(name) for name in counts]
    )
    for part in ("exact", "other"):
        w, l = F.col(f"wins_{part}"), F.col(f"losses_{part}")
        low, high = wilson_bounds(w, l)
        result = result.withColumns(
            {
                f"win_rate_{part}": win_rate(w, l),
                f"wilson_low_{part}": low,
                f"wilson_high_{part}": high,
            }
        )
    return result.withColumn(
        "fisher_p",
        fisher_exact_p(
            F.col("wins_exact"), F.col("losses_exact"), F.col("wins_other"), F.col("losses_other")
        ),
    )


def process_entropy(counts: DataFrame, attrs: Sequence[str], n: str = "n") -> DataFrame:
    """Shannon entropy of a count table, its states and the normalised value."""
    shares = with_rate(counts, attrs, n)
    found = shares.groupBy(*attrs).agg(
        (-F.sum(F.col("rate") * F.log2("rate"))).alias("entropy"),
        F.count(F.lit(1)).alias("states"),
    )
    return found.withColumn(
        "normalised", F.when(F.col("states") > 1, F.col("entropy") / F.log2(F.col("states").cast("double")))
    )


def goal_counts(goals: DataFrame) -> DataFrame:
    """Goal events by type and distinct goal ids per run; zero when there are none."""
    count = lambda kind: F.count_if(F.col("event_type") == kind).alias(kind)
    return goals.groupBy("run_id").agg(
        *[count(kind) for kind in GOAL_EVENTS],
        F.countDistinct(F.when(F.col("event_type").isin(*GOAL_EVENTS), F.col("goal_id"))).alias("goal_ids"),
    )


def process_profile(
    runs: DataFrame, keys: Sequence[str], means: Sequence[str], medians: Sequence[str]
) -> DataFrame:
    """Number of runs, means and exact medians of what each run recorded; runs without a value count in neither of its two."""
    report = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), *[F.avg(c).alias(f"mean_{c}") for c in means]
    )
    for c in medians:
        values = runs.select(*keys, F.col(c).cast("double").alias(c))
        report = report.join(exact_quantiles(values, keys, c, {f"median_{c}": 0.5}), list(keys), "left")
    return report


def goal_pop_backs(goals: DataFrame) -> DataFrame:
    """Returns to the immediate parent after a child goal, and unresolved parents.

    A parent is unresolved when no event of the run carries it as its own goal.
    """
    parent = previous_value(
        goals, ["run_id"], ["bucket"], ORDER, F.struct("goal_id", "parent_goal_id"), "_before"
    )
    pops = parent.groupBy("run_id").agg(
        F.count_if(F.col("goal_id") == F.col("_before.parent_goal_id")).alias("pop_backs")
    )
    ids = goals.select("run_id", "goal_id").distinct()
    parents = goals.filter(F.col("parent_goal_id").isNotNull()).select(
        "run_id", F.col("parent_goal_id").alias("goal_id")
    ).distinct()
    unresolved = parents.join(ids, ["run_id", "goal_id"], "left_anti").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("unresolved_parents")
    )
    return pops.join(unresolved, "run_id", "left").withColumn(
        "unresolved_parents", F.coalesce("unresolved_parents", F.lit(0))
    )
