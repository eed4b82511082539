"""Analytics over logs of cleaning episodes.

Step log: episode_id, task_id, step, command, score, dropped_protected; `score` is the score after the step, step 0
is the reset. Rows are dealt to range partitions of (episode, step), see `ordering`, so an episode may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.functions import scalars as X
from scourframe.operators import ordering as O

# Task limits and reward terms.
TASK_LIMITS = {  # task: (threshold, step budget, runner step limit)
    "easy": (0.95, 40, 25),
    "medium": (0.85, 80, 50),
    "hard": (0.80, 150, 80),
}
STEP_COST = -0.005
EARLY_DONE_PENALTY, EARLY_DONE_SCORE = -0.20, 0.60
PROTECTED_PENALTY = -0.15
EFFICIENCY_WEIGHT = 0.10
REWARD_FLOOR, REWARD_CEILING = -0.5, 1.0
REFUSED_DONE_REWARD = -1.0
RECENT_ACTIONS = 6
SHOWN_BROKEN = 5


def with_limits(log: DataFrame) -> DataFrame:
    """Adds threshold, max_steps, runner_steps; three tasks, so they ride along as literals."""
    def pick(i: int, kind: str) -> Column:
        out = None
        for task, limits in TASK_LIMITS.items():
            hit, value = F.col("task_id") == task, F.lit(limits[i]).cast(kind)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    return log.withColumns({
        "threshold": pick(0, "double"), "max_steps": pick(1, "int"), "runner_steps": pick(2, "int"),
    })


EPISODE = ["episode_id"]


def score_delta(log: DataFrame, keep_part: bool = False) -> DataFrame:
    """Adds prev_score: the score before the step, NULL at reset."""
    return O.GroupWindow(log, EPISODE, "step").lag("prev_score", "score").result(keep_part)


# -- terms: column expressions over a log with prev_score and limits -----------------------------------------------

def score_after() -> Column:
    """DONE changes no table, so the score stays."""
    return F.when(F.col("command") == "DONE", F.col("prev_score")).otherwise(F.col("score"))


def progress() -> Column:
    return score_after() - F.col("prev_score")


def just_solved() -> Column:
    return (F.col("prev_score") < F.col("threshold")) & (score_after() >= F.col("threshold"))


def efficiency() -> Column:
    left = 1.0 - F.col("step") / F.col("max_steps")
    return F.when(just_solved(), EFFICIENCY_WEIGHT * left).otherwise(0.0)


def protected_penalty() -> Column:
    return F.when(F.col("dropped_protected"), PROTECTED_PENALTY).otherwise(0.0)


def early_done_penalty() -> Column:
    """Cannot occur next to the DONE gate, since every threshold is above 0.60; kept as part of the formula."""
    early = (F.col("command") == "DONE") & (F.col("prev_score") < EARLY_DONE_SCORE)
    return F.when(early, EARLY_DONE_PENALTY).otherwise(0.0)


def refused_done() -> Column:
    return (F.col("command") == "DONE") & (F.col("prev_score") < F.col("threshold"))


def accepted_done() -> Column:
    return (F.col("command") == "DONE") & (F.col("prev_score") >= F.col("threshold"))


def reward() -> Column:
    total = progress() + efficiency() + protected_penalty() + early_done_penalty() + F.lit(STEP_COST)
    gated = F.when(refused_done(), REFUSED_DONE_REWARD).otherwise(X.round4(X.clip(total, REWARD_FLOOR, REWARD_CEILING)))
    return F.when(F.col("prev_score").isNotNull(), gated)


def is_done() -> Column:
    """A refused DONE never ends the episode, not even on the last step of the budget."""
    solved_or_spent = (F.col("score") >= F.col("threshold")) | (F.col("step") >= F.col("max_steps"))
    started = F.col("prev_score").isNotNull()
    return F.coalesce(started & F.when(F.col("command") == "DONE", accepted_done()).otherwise(solved_or_spent), F.lit(False))


# -- jobs -----------------------------------------------------------------------------------------------------------

def step_rewards(log: DataFrame, keep_part: bool = False) -> DataFrame:
    """Adds prev_score, reward, done to every step."""
    return with_limits(score_delta(log, keep_part)).withColumns({"reward": reward(), "done": is_done()})


def done_gate(log: DataFrame, broken: DataFrame | None = None, shown: int = SHOWN_BROKEN) -> DataFrame:
    """One row per DONE: accepted, reward, error, issues_remaining, still_broken. `broken` (episode_id, column, ordinal)
    lists the columns that were still broken; the message shows the first `shown`, still_broken has all of them.
    `initial_dirty` is read from the log."""
    dones = step_rewards(log).filter((F.col("command") == "DONE") & F.col("prev_score").isNotNull())
    if broken is not None:
        listed = (
            broken.groupBy("episode_id")
            .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("_b"))
            .select("episode_id", F.transform("_b", lambda s: s["column"]).alias("_names"))
        )
        dones = dones.join(listed, "episode_id", "left")
        every = F.coalesce("_names", F.array().cast("array<string>"))
    else:
        every = F.array().cast("array<string>")
    names = F.array_join(F.transform(F.slice(every, 1, shown), lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    message = F.concat(  # fixed value: the wording
        F.lit("DONE rejected: score "), F.format_string("%.4f", "prev_score"), F.lit(" < required "),
        F.format_string("%.2f", "threshold"), F.lit(". Still broken: ["), names, F.lit("]"),
    )
    remaining = F.col("initial_dirty") - F.floor(F.col("prev_score") * F.col("initial_dirty"))
    refused = refused_done()
    return dones.select(
        "episode_id", "step", (~refused).alias("accepted"), "reward", "done",
        F.when(refused, message).alias("error"),
        F.when(refused, remaining).otherwise(0).cast("bigint").alias("issues_remaining"), every.alias("still_broken"),
    )


def cut_at_terminal(log: DataFrame) -> DataFrame:
    """Steps up to and including the first terminal one of each episode."""
    flagged = step_rewards(log, keep_part=True)
    ends = O.GroupWindow(flagged, EPISODE, "step").first_where("end_step", F.col("done")).result()
    return ends.filter(F.col("end_step").isNull() | (F.col("step") <= F.col("end_step"))).drop("end_step")


def termination(log: DataFrame) -> DataFrame:
    """One row per episode that ended: episode_id, end_step, solved."""
    return (
        step_rewards(log)
        .filter("done")
        .groupBy("episode_id")
        .agg(F.min("step").alias("end_step"), F.min_by(F.col("score") >= F.col("threshold"), "step").alias("solved"))
    )


def episode_totals(log: DataFrame) -> DataFrame:
    """Per episode: steps, score, total_reward; folded before the shuffle."""
    return log.groupBy("episode_id").agg(
        F.max("step").alias("steps"),
        F.max_by("score", "step").alias("score"),
        X.round4(F.coalesce(F.sum("reward"), F.lit(0.0))).alias("total_reward"),
    )


def episode_rewards(log: DataFrame, limit: str | None = None) -> DataFrame:
    """The steps that count, with their reward, as rows: episode_id, task_id, step, score, threshold, reward, done.

    They end at the terminal step of an episode and, if `limit` names one (`runner_steps` or `max_steps`), where the caller's runner stops.
    """
    rows = cut_at_terminal(log)
    rows = rows.filter(F.col("step") <= F.col(limit)) if limit else rows
    return rows.select("episode_id", "task_id", "step", "score", "threshold", "reward", "done")


def episode_summary(log: DataFrame, limit: str | None = None, rewards: bool = False) -> DataFrame:
    """Per episode: success, steps, score, total_reward, over the rows of `episode_rewards`; folded before the shuffle.

    `rewards` adds them as one array, which one task holds for an episode.
    """
    listed = []
    if rewards:
        steps = F.array_sort(F.collect_list(F.when(F.col("reward").isNotNull(), F.struct("step", "reward"))))
        listed = [F.transform(steps, lambda s: s["reward"]).alias("rewards")]
    return (
        episode_rewards(log, limit)
        .groupBy("episode_id", "task_id")
        .agg(
            (F.max_by("score", "step") >= F.max("threshold")).alias("success"),
            F.max("step").cast("bigint").alias("steps"),
            F.max_by("score", "step").alias("score"),
            X.round4(F.coalesce(F.sum("reward"), F.lit(0.0))).alias("total_reward"),
            *listed,
        )
    )


def step_position(log: DataFrame) -> DataFrame:
    """Adds step_number (rank of the row in its episode) and remaining (steps left in the budget)."""
    numbered = O.GroupWindow(log, EPISODE, "step").row_number("step_number").result()
    return with_limits(numbered).withColumn("remaining", steps_remaining())


def steps_remaining() -> Column:
    return F.greatest(F.lit(0), F.col("max_steps") - F.col("step"))


def is_solved() -> Column:
    return F.col("score") >= F.col("threshold")


def current_state(log: DataFrame) -> DataFrame:
    """Per episode after its last step: current_score, steps_remaining, is_solved."""
    last = log.groupBy("episode_id", "task_id").agg(F.max("step").alias("step"), F.max_by("score", "step").alias("score"))
    return with_limits(last).select(
        "episode_id", "task_id", F.col("score").alias("current_score"),
        steps_remaining().cast("bigint").alias("steps_remaining"), is_solved().alias("is_solved"),
    )


def recent_actions(log: DataFrame, k: int = RECENT_ACTIONS) -> DataFrame:
    """Adds `recent`: the last k commands before each step, oldest first."""
    return O.recent_items(log, EPISODE, "step", "command", k, "recent")
