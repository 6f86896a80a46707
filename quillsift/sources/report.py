"""Benchmark reports: nested JSON in, flat rows out, and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Report names by method, in the order in which methods are listed. Programs that report under names of their own give
#: a map of their own.
METHODS = {
    "routed_rag": ("routed_rag_report",),
    "naive_rag": ("rag_report",),
    "flat_hybrid_rag": ("hybrid_rag_report", "flat_hybrid_rag_report"),
    "hierarchical_rag": ("hierarchical_rag_report",),
    "parent_child_rag": ("parent_child_rag_report",),
    "query_rewrite_rag": ("query_rewrite_rag_report",),
}
RECORD = "struct<report_name:string,ragas:map<string,double>,runtime:struct<average_retrieval_time_seconds:double,average_answer_time_seconds:double>,cost:struct<average_total_tokens:double>>"


def method_of(report_name: Column, methods: dict[str, tuple[str, ...]] = METHODS) -> Column:
    """The method of a report name; null for a name of none."""
    return F.coalesce(*(F.when(report_name.isin(*names), F.lit(m)) for m, names in methods.items()))


def flatten_report(reports: DataFrame, methods: dict[str, tuple[str, ...]] = METHODS) -> DataFrame:
    """reports: one JSON text a row, column value. One row for each embedding, llm and known method: embedding, llm,
    method, method_no, f1, faithfulness, total_tokens, total_time_seconds. Groups that are no objects and groups
    without records are passed over; of several records of a method the last counts."""
    outer = reports.select(F.explode(F.from_json("value", "map<string,string>")).alias("embedding", "g"))
    inner = outer.select("embedding", F.explode(F.from_json("g", "map<string,string>")).alias("llm", "h"))
    rec = inner.select("embedding", "llm", F.posexplode(F.from_json(F.get_json_object("h", "$.benchmark"), f"array<{RECORD}>")).alias("at", "r"))
    rec = rec.withColumn("method", method_of(F.col("r.report_name"), methods)).where("method is not null")
    last = rec.withColumn("n", F.row_number().over(Window.partitionBy("embedding", "llm", "method").orderBy(F.desc("at")))).where("n = 1")
    no = F.create_map(*(x for i, m in enumerate(methods) for x in (F.lit(m), F.lit(i))))[F.col("method")]
    return last.select(
        "embedding", "llm", "method", no.alias("method_no"), F.col("r.ragas")["F1"].alias("f1"), F.col("r.ragas")["Faithfulness"].alias("faithfulness"),
        F.col("r.cost.average_total_tokens").alias("total_tokens"), (F.col("r.runtime.average_retrieval_time_seconds") + F.col("r.runtime.average_answer_time_seconds")).alias("total_time_seconds"),
    )


def read_report(spark: SparkSession, path: str, methods: dict[str, tuple[str, ...]] = METHODS) -> DataFrame:
    """flatten_report() of a file; an error if it holds no known record."""
    flat = flatten_report(spark.read.text(path, wholetext=True), methods)
    if flat.isEmpty():
        raise ValueError(f"no benchmark records in {path}")
    return flat


def write_report(path: str, config: dict, metrics: DataFrame, means: DataFrame, per_question: DataFrame) -> None:
    """One JSON file, for a run's few rows: config, ragas, runtime, cost, per_question."""
    m, s = metrics.first().asDict(), means.first().asDict()
    runtime = {k: v for k, v in s.items() if k.endswith("_seconds")}
    body = {"config": config, "ragas": m, "runtime": runtime, "cost": {k: v for k, v in s.items() if k not in runtime}, "per_question": [json.loads(r) for r in per_question.toJSON().collect()]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2, ensure_ascii=False)


def panels(flat: DataFrame) -> DataFrame:
    """Mean of each measure by method over all panels."""
    return flat.groupBy("method", "method_no").agg(F.count("*").alias("panels"), *(F.avg(c).alias(c) for c in ("f1", "faithfulness", "total_tokens", "total_time_seconds")))


def console_report(title: str, metrics: DataFrame, means: DataFrame, seconds: float) -> str:
    """A run's few numbers as lines of text of one width."""
    m, s = metrics.first().asDict(), means.first().asDict()
    groups = {"Metrics": m, "Runtime": {k: v for k, v in s.items() if k.endswith("_seconds")}, "Cost": {k: v for k, v in s.items() if not k.endswith("_seconds")}}
    lines = ["=" * 60, title, "=" * 60]
    for name, values in groups.items():
        lines += [name, "-" * 60]
        for k, v in values.items():
            shown = f"{v:.4f}" if isinstance(v, float) else ", ".join(v) if isinstance(v, list) else str(v)
            lines.append(f"  {k.replace('_', ' '):<40}{shown:>18}")
    return "\n".join([*lines, "-" * 60, f"  {'seconds in all':<40}{seconds:>18.1f}"])
