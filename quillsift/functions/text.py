"""Text expressions. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space (trim() would look at spaces only)."""
    return ~F.coalesce(c.rlike(r"\S"), F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def headings(text: Column) -> Column:
    """Titles of the Markdown headings at the start of a line, right-stripped, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6} ([^\n]+)"), 1)
    return F.array_distinct(F.transform(found, lambda h: F.regexp_replace(h, r"\s+$", "")))


def keyword_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0)


def ws_tokens(text: Column) -> Column:
    """Words between white space, case and punctuation kept."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null or ''."""
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def line_chunks(text: Column) -> Column:
    """The lines that are not blank; positions are then dense."""
    return F.filter(F.split(text, "\n"), lambda p: p.rlike(r"\S"))


def row_text(document: Column, context: Column) -> Column:
    """document, or context where that is null; a blank result is an error."""
    text = F.coalesce(document, context)
    return F.when(is_blank(text), F.raise_error(F.lit("a case needs a document or a context"))).otherwise(text)


def case_id(number: Column) -> Column:
    return F.format_string("case_%03d", number)


def context_list(contexts: Column) -> Column:
    """The entries that are not blank."""
    return F.filter(contexts, lambda x: x.rlike(r"\S"))


def rewrites(question: Column, count: int = 3) -> Column:
    """The question and up to count templated rewrites, each once, in order."""
    first8 = F.array_join(F.slice(keyword_tokens(question), 1, 8), " ")
    about = F.when(first8 == "", question).otherwise(first8)
    return F.slice(F.array_distinct(F.array(question, F.concat(F.lit("Find the passage that answers: "), question), F.concat(F.lit("Relevant details about "), about), F.concat(question, F.lit(" key facts")))), 1, count + 1)


def parsed_rewrites(question: Column, answer: Column, count: int = 3) -> Column:
    """The question and the model's rewrites out of JSON {"queries": [...]}; rewrites() where that is no such object
    or holds no text. Never fails."""
    items = F.from_json(answer, "queries array<string>")["queries"]
    kept = F.filter(F.transform(items, strip), lambda x: x != "")
    usable = F.coalesce(F.size(kept), F.lit(-1)) > 0
    return F.when(usable, F.slice(F.concat(F.array(question), kept), 1, count + 1)).otherwise(rewrites(question, count))


def judged_true(answer: Column) -> Column:
    """A model's verdict: 'true' and nothing else, whatever the case and white space."""
    return F.coalesce(F.lower(strip(answer)) == "true", F.lit(False))


def titles_suffice(titles: Column) -> Column:
    """Offline verdict on headings: at least four that are not of the usual empty kind."""
    generic = ("introduction", "conclusion", "summary", "overview", "references", "abstract", "background", "")
    return F.size(F.filter(titles, lambda t: ~F.lower(t).isin(*generic))) >= 4


def summary_input(text: Column, verdict: Column | None = None) -> Column:
    """What a summariser gets: the headings, one a line, if there are any and they suffice, else the whole text."""
    titles = headings(text)
    ok = titles_suffice(titles) if verdict is None else judged_true(verdict)
    return F.when((F.size(titles) > 0) & ok, F.array_join(titles, "\n")).otherwise(text)
