"""Splitting texts into ordered chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ")
#: Characters of chunks that a task holds at a time.
CHUNK_CHARS = 1 << 20


def _stripped(text: str, begin: int, end: int) -> tuple[int, int] | None:
    part = text[begin:end]
    kept = part.strip()
    if not kept:
        return None
    begin += len(part) - len(part.lstrip())
    return begin, begin + len(kept)


def split_spans(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, base: int = 0) -> list[tuple[int, int]]:
    """Begin and end in text of the chunks of split_text()."""
    sep = next((s for s in separators if s in text), separators[-1])
    rest = separators[separators.index(sep) + 1 :]
    mark, seen, total = sep, text, len(text)
    if len(sep) > 1:  # pieces begin where a mark stands: one character that text lacks
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in text)
        seen = text.replace(sep, mark + sep[1:])
    out: list[tuple[int, int]] = []

    def emit(begin: int, end: int) -> None:
        span = _stripped(text, begin, end)
        if span:
            out.append(span)

    begin = 0  # of the run
    while begin < total:
        end = seen.find(mark, begin + 1)
        end = total if end < 0 else end
        if end - begin >= size:
            out += [(begin + x, begin + y) for x, y in split_spans(text[begin:end], size, overlap, rest)] if rest else [(begin, end)]
            begin = end
            continue
        if total - begin <= size:
            emit(begin, total)
            break
        # the run ends before the piece that would make it too long, and is at least one piece
        end = max(end, seen.rfind(mark, end, begin + size + 1))
        emit(begin, end)
        after = seen.find(mark, end + 1)
        after = total if after < 0 else after
        if after - end >= size:
            begin = end
            continue
        again = seen.find(mark, max(end - overlap, after - size), end) if overlap else -1
        begin = end if again < 0 else again
    return out


def split_text(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that occurs, which stays with the piece after
    it. Pieces that are still too long are cut at the next separator; one without any stays whole. Runs of short
    pieces are joined up to size, the last of a run repeated in the next up to overlap characters, and stripped."""
    return [text[a:b] for a, b in split_spans(text, size, overlap, separators)]


def chunks(df: DataFrame, text: str, size: int, overlap: int = 0, index: str = "chunk_index", chunk: str = "chunk_text", number_first: bool = False, start: str | None = None) -> DataFrame:
    """One row for each chunk of each row: all columns but text, then index and chunk, and start, if a name is given: the
    characters of text before the chunk. Blank chunks are dropped before numbering, or, with number_first, after it. Null
    texts give no rows. A task holds the chunks of CHUNK_CHARS characters at a time, or of one text."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    names = [*keep, index, chunk, *([start] if start else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, found, begin, chars = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                rows = pa.array(at, pa.int32())
                columns = [b.column(c).take(rows) for c in keep] + [pa.array(no, pa.int32()), pa.array(found, pa.string())] + ([pa.array(begin, pa.int32())] if start else [])
                return pa.RecordBatch.from_arrays(columns, names)

            for row, t in enumerate(b.column(text)):
                t = t.as_py()
                spans = [(x, y, t[x:y]) for x, y in split_spans(t, size, overlap)] if t else []
                for i, (x, y, p) in enumerate(spans if number_first else [s for s in spans if s[2].strip()]):
                    if p.strip():
                        at.append(row)
                        no.append(i)
                        found.append(p)
                        begin.append(x)
                        chars += y - x
                if chars > CHUNK_CHARS:
                    yield made()
                    at, no, found, begin, chars = [], [], [], [], 0
            if at:
                yield made()

    return df.select(*keep, text).mapInArrow(run, f"{schema}, {index} int, {chunk} string" + (f", {start} int" if start else ""))


def sections(docs: DataFrame, size: int = 150) -> DataFrame:
    """doc_id, section_index, section_text."""
    return chunks(docs.select("doc_id", "text"), "text", size, 0, "section_index", "section_text", number_first=True)


def section_chunks(found: DataFrame, size: int = 150, overlap: int = 30) -> DataFrame:
    """doc_id, section_index, chunk_index (from 0 in each section), chunk_text."""
    return chunks(found, "section_text", size, overlap, number_first=True)


def parents_children(docs: DataFrame, parent_size: int = 150, child_size: int = 150, start: str | None = None) -> DataFrame:
    """doc_id, parent_index, parent_text, child_index, child_text, and start, if a name is given (see chunks): of the parent."""
    p = chunks(docs.select("doc_id", "text"), "text", parent_size, 30, "parent_index", "parent_text", number_first=True, start=start)
    return chunks(p.withColumn("_body", F.col("parent_text")), "_body", child_size, 0, "child_index", "child_text", number_first=True)


def line_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_index, chunk_text: the lines that are not blank, densely numbered. Runs inside the JVM."""
    from quillsift.functions.text import line_chunks as lines

    return docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("chunk_index", "chunk_text"))


def semantic_groups(chunks: DataFrame, threshold: float) -> DataFrame:
    """doc_id, chunk_index, group_no: neighbouring chunks (with column embedding) stay in one group while their cosine
    is at least threshold."""
    from pyspark.sql import Window

    from quillsift.functions.vector import cosine

    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    cut = chunks.withColumn("before", F.lag("embedding").over(w)).withColumn("cut", F.when(cosine(F.col("before"), F.col("embedding")) < threshold, 1).otherwise(0))
    return cut.select("doc_id", "chunk_index", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("group_no"))
