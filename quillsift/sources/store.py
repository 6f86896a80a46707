"""The stored index: Parquet tables of chunks, their postings and a catalog of documents.

A write adds a version of each table in a folder of its own; a numbered pointer file, written last and under a new name,
names the versions that count. The latest pointer that can be read counts, so there is an index at every moment, and a
failed ingest leaves it as it was. Deleting and replacing documents rewrites nothing: the ids go to a list of their own,
which hides them in all versions before it, until compact() drops them. Readers see the versions that they opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.models import Embedder, HashingEmbedder, embed_column
from quillsift.functions.text import summary_input
from quillsift.operators.lexical import row_postings, scope_stats
from quillsift.operators.split import chunks as split_chunks
from quillsift.sources.scratch import discard, written
from quillsift.sources.texts import as_text

TABLES = {
    "catalog": "doc_id string, summary string, values array<double>",
    "chunks": "doc_id string, chunk_index int, chunk_text string, embedding array<double>",
    "postings": "doc_id string, chunk_index int, term string, tf long, dl int",
    "stats": "doc_id string, n_chunks long, avgdl double",
}
CATALOG = TABLES["catalog"]
#: Pointers that are kept, so that readers which have just looked one up still find it.
POINTERS = 3
#: Rows of hidden ids that are sent to every executor; more are joined by shuffle.
HIDDEN_ROWS = 200_000


class Index:
    """A collection under path (any Hadoop file system). One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder = embedder or HashingEmbedder()

    def _fs(self):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _file(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _pointers(self) -> list[int]:
        """Numbers of the pointer files, ascending."""
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n[8:-5]) for n in names if n.startswith("CURRENT-") and n.endswith(".json") and n[8:-5].isdigit())

    def _current(self) -> list[dict]:
        """The steps that make up the index, in order: {"add": version} or {"hide": version, "rows": n}."""
        numbers = self._pointers()
        if not numbers:
            raise FileNotFoundError(f"no index at {self.path}")
        for n in reversed(numbers):
            try:
                body = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/CURRENT-{n}.json").collect())
                steps = json.loads(body)["steps"]
                if all(isinstance(s.get("add", s.get("hide")), str) for s in steps):
                    return steps
            except (ValueError, KeyError, TypeError, AttributeError):
                continue  # cut off while it was written: the one before counts
        raise ValueError(f"the catalog of {self.path} cannot be read")

    def _point(self, steps: list[dict]) -> None:
        fs, _ = self._fs()
        numbers = self._pointers()
        out = fs.create(self._file(f"CURRENT-{numbers[-1] + 1 if numbers else 1}.json"), False)
        out.write(bytearray(json.dumps({"steps": steps}), "utf-8"))
        out.close()
        for n in numbers[: -(POINTERS - 1)]:
            fs.delete(self._file(f"CURRENT-{n}.json"), False)

    def _read(self, table: str) -> DataFrame:
        """The rows of a table without those that a later step hides."""
        steps, out = self._current(), None
        for i, step in enumerate(steps):
            if "add" not in step:
                continue
            part = self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}-{step['add']}")
            later = [s for s in steps[i + 1 :] if "hide" in s]
            if later:
                ids = self.spark.read.schema("doc_id string").parquet(*(f"{self.path}/hidden-{s['hide']}" for s in later))
                part = part.join(F.broadcast(ids) if sum(s["rows"] for s in later) <= HIDDEN_ROWS else ids, "doc_id", "left_anti")
            out = part if out is None else out.union(part)
        return self.spark.createDataFrame([], TABLES[table]) if out is None else out

    def catalog(self) -> DataFrame:
        return self._read("catalog")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def postings(self) -> DataFrame:
        return self._read("postings")

    def stats(self) -> DataFrame:
        return self._read("stats")

    def info(self) -> DataFrame:
        return self.catalog().select("doc_id", "summary")

    def _steps(self) -> list[dict]:
        try:
            return self._current()
        except FileNotFoundError:
            return []

    def add(self, docs: DataFrame, chunk_size: int = 150, summary: Column | None = None) -> DataFrame:
        """Ingests docs (doc_id optional, text string or binary) and returns their doc_ids. Without doc_id, or where it
        is null, it is the start of the text's MD5. Texts without a chunk (null or blank) are left out; of several texts
        with one id the greatest counts. Documents that the index has already are replaced."""
        steps = self._steps()  # a damaged index is an error before anything is written
        d = as_text(docs, "text")
        own = F.substring(F.md5("text"), 1, 12)
        doc_id = F.coalesce(F.col("doc_id").cast("string"), own) if "doc_id" in d.columns else own
        d = d.select(doc_id.alias("doc_id"), "text").where(F.col("text").rlike(r"\S")).groupBy("doc_id").agg(F.max("text").alias("text"))
        # by id: what is made row by row from here keeps that order without a shuffle, rows of one document lie together,
        # and routed reads skip row groups by their doc_id ranges
        d = written(d.sortWithinPartitions("doc_id"), "ingested")
        version = uuid.uuid4().hex
        c = split_chunks(d, "text", chunk_size)
        c.withColumn("embedding", embed_column(F.col("chunk_text"), self.embedder)).write.parquet(f"{self.path}/chunks-{version}")
        t = self.spark.read.schema(TABLES["chunks"]).parquet(f"{self.path}/chunks-{version}")
        row_postings(t).write.parquet(f"{self.path}/postings-{version}")
        scope_stats(t).write.parquet(f"{self.path}/stats-{version}")
        s = d.select("doc_id", (summary_input(F.col("text")) if summary is None else summary).alias("summary"))
        s.withColumn("values", embed_column(F.col("summary"), self.embedder)).write.parquet(f"{self.path}/catalog-{version}")
        discard(d)
        new = self.spark.read.schema(CATALOG).parquet(f"{self.path}/catalog-{version}").select("doc_id")
        if steps:
            old = self.catalog().select("doc_id").join(new, "doc_id", "left_semi")
            steps = [*steps, *self._hide(old)]
        self._point([*steps, {"add": version}])
        return new

    def _hide(self, ids: DataFrame) -> list[dict]:
        """The step that hides ids, if there are any."""
        version = uuid.uuid4().hex
        ids.select(F.col("doc_id").cast("string").alias("doc_id")).where("doc_id is not null").distinct().write.parquet(f"{self.path}/hidden-{version}")
        n = self.spark.read.schema("doc_id string").parquet(f"{self.path}/hidden-{version}").count()
        return [{"hide": version, "rows": n}] if n else []

    def delete(self, doc_ids: list[str] | DataFrame) -> None:
        """Removes documents, given as a list or as a table with doc_id; unknown ids change nothing. Only the ids are
        written."""
        ids = doc_ids if isinstance(doc_ids, DataFrame) else self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        self._point([*self._current(), *self._hide(ids)])

    def compact(self) -> None:
        """Writes every table anew without its hidden rows, as one version. The old ones stay for those who read them."""
        version = uuid.uuid4().hex
        for table in TABLES:
            self._read(table).repartition("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{self.path}/{table}-{version}")
        self._point([{"add": version}])

    def clear(self) -> None:
        """Deletes the whole index folder, if it is one."""
        fs, p = self._fs()
        if fs.exists(p):
            if not self._pointers():
                raise ValueError(f"{self.path} holds no index; not deleted")
            fs.delete(p, True)

    def search(self, queries: DataFrame, **params: object) -> DataFrame:
        """queries: query_id, query_text. See plans.pipelines.search()."""
        from quillsift.plans.pipelines import SearchParams, search

        return search(queries, self.catalog(), self.chunks(), self.embedder, SearchParams(**params), post=self.postings(), stats=self.stats())
