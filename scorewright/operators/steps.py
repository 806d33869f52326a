"""Problems that are built of steps: what a model knows, by which steps and which whole problems it gets right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that a task groups, on average.
ROWS = 1_000_000


def step_outcomes(rows: DataFrame, problem: str, steps: str | None, step: str, hit: str) -> DataFrame:
    """(problem, steps, held, failed, complete, whole) of rows (problem, steps: how many it has, step, hit).

    step is 1 and on, and null for the whole problem. held and failed tell whether some step is right and some wrong,
    complete whether all its steps are there, whole is the whole problem's hit. Chains may be of any length, a step that
    repeats counts as right if all its rows are, unknown hits as absent, and chains without a first step are left out.
    Without `steps` a problem has as many as its last row's step says. Problems are dealt once, to as many tasks as give
    each about `ROWS` rows, so that a task's memory doesn't grow with them.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    dealt, by = rows.repartition(tasks, problem), [problem] + ([steps] if steps else [])
    each = dealt.groupBy(*by, step).agg(F.min(F.col(hit).cast("int")).alias("hit"))
    known = F.col("hit").isNotNull()
    single = F.col(step).isNotNull() & known
    length = F.first(steps) if steps else F.max(step)
    out = each.groupBy(*by).agg(
        *([] if steps else [length.alias("steps")]),
        F.coalesce(F.bool_or(F.when(single, F.col("hit") == 1)), F.lit(False)).alias("held"),
        F.coalesce(F.bool_or(F.when(single, F.col("hit") == 0)), F.lit(False)).alias("failed"),
        (F.count(F.when(single, 1)) == length).alias("complete"),
        (F.max(F.when(F.col(step).isNull(), F.col("hit"))) == 1).alias("whole"),
        F.min(F.when(known, F.col(step))).alias("__first"),
    )
    return out.where("__first = 1").drop("__first")


def knowledge_classes(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of the four classes over problems of `step_outcomes`, and scores, strict and loose.

    insufficient: some step and the whole wrong; inadequate: all steps right, the whole wrong; mastery: the whole right
    and all steps (loose: some) right; rote: the whole right and some step (loose: all) wrong. Rates are of all
    problems, rote's of those whose whole is right; a score is 1 less the rates of rote, insufficient and half of inadequate,
    so that a problem of no class, for want of a known hit, isn't held against a model.
    """
    all_right = F.col("complete") & F.col("held") & ~F.col("failed")
    all_wrong = F.col("complete") & F.col("failed") & ~F.col("held")
    right, wrong = F.coalesce(F.col("whole"), F.lit(False)), F.coalesce(~F.col("whole"), F.lit(False))
    n = lambda on: F.count(F.when(on, 1))
    out = outcomes.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        n(wrong & F.col("failed")).alias("insufficient"),
        n(wrong & all_right).alias("inadequate"),
        n(right & all_right).alias("mastery_strict"),
        n(right & F.col("held")).alias("mastery_loose"),
        n(right & F.col("failed")).alias("rote_strict"),
        n(right & all_wrong).alias("rote_loose"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    for kind in ("strict", "loose"):
        mastery, rote = F.col(f"mastery_{kind}"), F.col(f"rote_{kind}")
        out = out.withColumn(f"rote_rate_{kind}", share(rote, mastery + rote)).withColumn(f"score_{kind}", share(F.col("n") - 0.5 * F.col("inadequate") - rote - F.col("insufficient"), F.col("n")))
    return out


def concept_accuracy(rows: DataFrame, concepts: DataFrame, concept: str, hit: str, area: str) -> DataFrame:
    """(area, concept, n, accuracy) of single steps joined with the tree of concepts (concept, area), every concept with a
    row; those without steps have n 0 and a null accuracy."""
    per = rows.groupBy(concept).agg(F.count(hit).alias("n"), F.avg(F.col(hit).cast("double")).alias("accuracy"))
    return concepts.select(concept, area).join(per, concept, "left").select(area, concept, F.coalesce("n", F.lit(0)).alias("n"), "accuracy")
