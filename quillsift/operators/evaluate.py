"""Evaluation: cases, usage, means, and what the plots need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import case_id, context_list, row_text

MEANS = ("retrieval_time_seconds", "answer_time_seconds", "additional_tokens", "input_tokens", "output_tokens", "total_tokens")


def build_cases(rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """file, document, questions (array of struct id, question, expected_answer) from rows document, context, question,
    answer. Rows are numbered by order; limit keeps the first ones."""
    n = F.row_number().over(Window.orderBy(order))
    r = rows.withColumn("_n", n) if limit is None else rows.orderBy(order).limit(limit).withColumn("_n", n)
    q = F.struct(case_id(F.col("_n")).alias("id"), "question", F.col("answer").alias("expected_answer"))
    return r.select(case_id(F.col("_n")).alias("file"), row_text(F.col("document"), F.col("context")).alias("document"), F.array(q).alias("questions"))


def with_usage(rows: DataFrame) -> DataFrame:
    """Missing token counts are 0 and a missing total their sum; additional tokens are added to input and total;
    contexts lose their blank entries."""
    def n(c: str) -> Column:
        return F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))

    total = F.coalesce(F.col("total_tokens").cast("long"), n("input_tokens") + n("output_tokens"))
    return rows.withColumns({"contexts": context_list(F.col("contexts")), "additional_tokens": n("additional_tokens"), "input_tokens": n("input_tokens") + n("additional_tokens"), "output_tokens": n("output_tokens"), "total_tokens": total + n("additional_tokens")})


def summarize(rows: DataFrame) -> DataFrame:
    """Means of times and tokens in one row; zeros for no rows."""
    return rows.agg(*(F.coalesce(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(f"average_{c}") for c in MEANS))


def metric_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric without its NaNs and nulls, and skipped_metrics: those that rows lacks, sorted."""
    have = [m for m in metrics if m in rows.columns]
    lost = F.array(*map(F.lit, sorted({*metrics} - {*have}))).cast("array<string>")
    return rows.agg(*(F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in have)).withColumn("skipped_metrics", lost)


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, of means; 0 where both are 0."""
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def axis_limits(rows: DataFrame, value: str, keys: list[str], score: bool = False, pad: float = 0.12) -> DataFrame:
    """keys, lo, hi: the range of value and 12 % on either side; about a single value, a tenth of it or 0.05 at
    least; scores are kept within 0 and 1."""
    g = rows.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    span = F.col("b") - F.col("a")
    by = F.when(span > 0, span * pad).otherwise(F.greatest(F.abs("b") * 0.1, F.lit(0.05)))
    lo, hi = F.col("a") - by, F.col("b") + by
    return g.select(*keys, (F.greatest(lo, F.lit(0.0)) if score else lo).alias("lo"), (F.least(hi, F.lit(1.0)) if score else hi).alias("hi"))
