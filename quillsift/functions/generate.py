"""What a language model is asked for: verdicts on headings, summaries, rewrites, answers. All prompts are parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.models import Generator, complete_column
from quillsift.functions.text import context_list, headings, parsed_rewrites, summary_input

Model = Generator | Callable[[], Generator]


@dataclass(frozen=True)
class Prompts:
    """{titles}, {question}, {count} and {context} are filled in."""

    summary: str = "Summarise the document in four or five dense sentences that name its field, its topics and its claims; they stand for it when questions are routed."
    judge: str = "Do these headings alone tell the field of a document and several topics of it? Answer true or false, and false if in doubt.\n\nHeadings:\n{titles}"
    rewrite: str = 'Rephrase the question for a search engine. Answer with JSON of the form {"queries": ["..."]} and nothing else.'
    rewrite_user: str = "Question: {question}\nAt most {count} rewrites."
    answer: str = "Answer in plain words, from the context alone; if it does not hold the answer, say so."
    answer_user: str = "Context:\n{context}\n\nQuestion: {question}"


def _filled(template: str, **values: Column) -> Column:
    """template with each {name} replaced; values are put in as they are, whatever they hold."""
    out, rest = [], template
    while rest:
        found = [(rest.index("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not found:
            out.append(F.lit(rest))
            break
        at, k = min(found)
        out += [F.lit(rest[:at]), F.coalesce(values[k].cast("string"), F.lit(""))]
        rest = rest[at + len(k) + 2 :]
    return F.concat(*out)


def summaries(docs: DataFrame, model: Model, judge: Model | None = None, prompts: Prompts = Prompts(), batch: int = 8) -> DataFrame:
    """docs (doc_id, text) with summary: the model's, of the headings if judge (or the rule of titles_suffice) finds that
    they suffice, else of the whole text."""
    verdict = None
    if judge is not None:
        asked = _filled(prompts.judge, titles=F.array_join(headings(F.col("text")), "\n"))
        # no headings, no question
        verdict = F.when(F.size(headings(F.col("text"))) > 0, complete_column(F.lit(""), asked, judge, batch)["text"])
    given = docs.withColumn("_input", summary_input(F.col("text"), verdict))
    return given.withColumn("summary", complete_column(F.lit(prompts.summary), F.col("_input"), model, batch)["text"]).drop("_input")


def rewritten(questions: DataFrame, model: Model, count: int = 3, prompts: Prompts = Prompts(), batch: int = 8) -> DataFrame:
    """questions (query_text) with rewrites (see parsed_rewrites), additional_tokens."""
    asked = _filled(prompts.rewrite_user, question=F.col("query_text"), count=F.lit(count))
    said = questions.withColumn("_said", complete_column(F.lit(prompts.rewrite), asked, model, batch))
    said = said.withColumn("rewrites", parsed_rewrites(F.col("query_text"), F.col("_said.text"), count))
    return said.withColumn("additional_tokens", F.col("_said.input_tokens") + F.col("_said.output_tokens")).drop("_said")


def answer_prompt(question: Column, contexts: Column, prompts: Prompts = Prompts()) -> Column:
    """The contexts that are not blank, a blank line between them, and the question."""
    return _filled(prompts.answer_user, context=F.array_join(context_list(contexts), "\n\n"), question=question)


def answered(results: DataFrame, model: Model, prompts: Prompts = Prompts(), batch: int = 8) -> DataFrame:
    """results (question, contexts) with answer, input_tokens, output_tokens, total_tokens."""
    said = results.withColumn("_said", complete_column(F.lit(prompts.answer), answer_prompt(F.col("question"), F.col("contexts"), prompts), model, batch))
    counted = said.select("*", F.col("_said.text").alias("answer"), F.col("_said.input_tokens").alias("input_tokens"), F.col("_said.output_tokens").alias("output_tokens"))
    return counted.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).drop("_said")
