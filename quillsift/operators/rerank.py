"""Reranking: model kinds, prompts, scores, and the final order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.models import Reranker, pair_score_column


@dataclass(frozen=True)
class Template:
    """The prompt of a decoder. A model scores best by the words that it was trained on, so give those of its model card
    here; these defaults have the same parts and order. body holds {query} and {passage}."""

    prefix: str
    body: str
    suffix: str
    yes: str
    no: str

    def pair(self, query: str, passage: str) -> str:
        before, _, rest = self.body.partition("{query}")
        between, _, after = rest.partition("{passage}")
        return before + query + between + passage + after


TEMPLATES = {
    "qwen_decoder": Template(
        "<|im_start|>system\nAnswer yes or no: does the Document meet the Query, given the Instruct?<|im_end|>\n<|im_start|>user\n",
        "<Instruct>: Find passages on the web that answer the question\n<Query>: {query}\n<Document>: {passage}",
        "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n", "yes", "no",
    ),
    "bge_decoder": Template("Does passage B hold an answer to query A? Reply 'Yes' or 'No'.\n", "A: {query}\nB: {passage}", "\nAnswer:", "Yes", "No"),
}


def reranker_type(family: Column, architecture: Column, explicit: Column | None = None) -> Column:
    """explicit, unless that is null or 'auto'; else told from the names of the model's family and architecture; an
    error where they fit no kind."""
    f, a = F.lower(F.coalesce(family, F.lit(""))), F.lower(F.coalesce(architecture, F.lit("")))
    bge_llm = f.contains("bge") & (f.contains("gemma") | f.contains("minicpm") | f.contains("llm"))
    auto = (
        F.when(f.contains("qwen"), "qwen_decoder")
        .when(a.contains("forsequenceclassification") | f.contains("xlm-roberta"), "bge_classifier")
        .when(bge_llm, "bge_decoder")
        .otherwise(F.raise_error(F.concat(F.lit("no reranker kind for "), f)))
    )
    return auto if explicit is None else F.when(explicit.isNotNull() & (explicit != "auto"), explicit).otherwise(auto)


def prompt(kind: str, query: Column, passage: Column, template: Template | None = None) -> Column:
    t = template or TEMPLATES[kind]
    before, _, rest = t.body.partition("{query}")
    between, _, after = rest.partition("{passage}")
    return F.concat(F.lit(t.prefix + before), query, F.lit(between), passage, F.lit(after + t.suffix))


def decoder_score(yes: Column, no: Column, normalize: bool = True) -> Column:
    """The share of yes in a two-way softmax of the last logits; raw, their difference."""
    d = yes - no
    if not normalize:
        return d
    e = F.exp(-F.abs(d))
    return F.when(d >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def classifier_score(logit: Column, normalize: bool = True) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-50.0)), F.lit(50.0)))) if normalize else logit


def rerank(candidates: DataFrame, reranker: Reranker, k: int | None = None, order: str = "rank") -> DataFrame:
    """candidates: query_id, query_text, passage, and their order. Adds score and sets rank anew, best first; equal
    scores keep their order."""
    s = candidates.withColumn("score", F.round(classifier_score(pair_score_column(F.col("query_text"), F.col("passage"), reranker)), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), order)
    out = s.withColumn("_new", F.row_number().over(w)).drop("rank").withColumnRenamed("_new", "rank")
    return out if k is None else out.where(F.col("rank") <= k)
