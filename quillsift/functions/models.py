"""Plug points for models, and stand-ins that need none.

An embedder turns texts into vectors, a reranker scores (query, passage) pairs, a generator answers chat prompts; all get
whole Arrow batches. Real models implement the same methods (functions.onnx has two over onnxruntime). Wherever a
model is asked for, a function without arguments that makes one will do: it is called once a task, on the executor, so
that no weights travel with the plan.
"""

from __future__ import annotations

import array
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, queries: Sequence[str], passages: Sequence[str]) -> np.ndarray: ...


class Generator(Protocol):
    def complete(self, system: Sequence[str], user: Sequence[str]) -> list[tuple[str | None, int | None, int | None]]:
        """Text, prompt tokens and completion tokens for each prompt; tokens are None where they were not counted."""
        ...


class _Places(dict):
    """Words and their places, worked out when they are met."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, word: str) -> int:
        p = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        return p


class HashingEmbedder:
    """Counts of lower-case ASCII words, each at the place that its MD5 names, scaled to length 1. Texts without a
    word get the zero vector. No more than WORDS places are remembered, and the words of a text."""

    WORDS = 100_000
    #: Texts that it is best given at a time.
    batch = 256

    def __init__(self, dim: int = 64) -> None:
        self.dim, self._places = dim, _Places(dim)

    def __getstate__(self) -> dict:
        return {"dim": self.dim}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["dim"])

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        places = self._places
        found, counts = array.array("q"), []
        for text in texts:
            if len(places) > self.WORDS:
                places.clear()
            before = len(found)
            found.extend(map(places.__getitem__, re.findall(r"[a-z0-9]+", (text or "").lower())))
            counts.append(len(found) - before)
        at = np.repeat(np.arange(len(texts)) * self.dim, counts) + np.frombuffer(found, np.int64)
        out = np.bincount(at, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


class LexicalReranker:
    """Logit of the share of the query's words that the passage has."""

    def score(self, queries: Sequence[str], passages: Sequence[str]) -> np.ndarray:
        out = []
        for q, p in zip(queries, passages):
            words = set(re.findall(r"[a-z0-9]+", (q or "").lower()))
            share = len(words & set(re.findall(r"[a-z0-9]+", (p or "").lower()))) / max(1, len(words))
            out.append(6 * share - 3)
        return np.array(out, float)


class LeadGenerator:
    """A stand-in for summaries: the first sentences of the prompt, word for word."""

    def __init__(self, sentences: int = 5) -> None:
        self.sentences = sentences

    def complete(self, system: Sequence[str], user: Sequence[str]) -> list[tuple[str | None, int | None, int | None]]:
        n = self.sentences
        return [(" ".join(re.split(r"(?<=[.!?])\s+", (u or "").strip(), maxsplit=n)[:n]), None, None) for u in user]


class ContextGenerator:
    """A stand-in for answers: of the prompt's context, the line with most words of its question (see answer_prompt)."""

    def complete(self, system: Sequence[str], user: Sequence[str]) -> list[tuple[str | None, int | None, int | None]]:
        out = []
        for u in user:
            context, _, question = (u or "").rpartition("\n\nQuestion: ")
            words = set(re.findall(r"[a-z0-9]+", question.lower()))
            lines = [x for x in context.removeprefix("Context:\n").split("\n") if x.strip()]
            best = max(lines, key=lambda x: len(words & set(re.findall(r"[a-z0-9]+", x.lower()))), default="")
            out.append((best if words & set(re.findall(r"[a-z0-9]+", best.lower())) else "The context does not tell.", None, None))
        return out


def _loaded(model: object) -> object:
    """The model, made now if what was given makes one."""
    return model() if callable(model) else model


def embed_column(text: Column, embedder: Embedder | Callable[[], Embedder], batch: int | None = None) -> Column:
    """array<double> of a text; the model sees batches of the given size, by default of its own (attribute batch) or 8, and of an Arrow batch no more than one is held as
    Python texts."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _loaded(embedder)
        size = batch or getattr(model, "batch", 8)
        for texts in batches:
            parts = [np.asarray(model.embed(["" if t is None else t for t in texts.slice(i, size).to_pylist()]), np.float64) for i in range(0, len(texts), size)]
            sizes = [p.shape[1] for p in parts for _ in range(len(p))]
            flat = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.float64()))

    return run(text)


def pair_score_column(query: Column, passage: Column, reranker: Reranker | Callable[[], Reranker], batch: int = 8) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _loaded(reranker)
        for q, p in batches:
            qs, ps = q.tolist(), p.tolist()
            parts = [model.score(qs[i : i + batch], ps[i : i + batch]) for i in range(0, len(qs), batch)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run(query, passage)


def complete_column(system: Column, user: Column, generator: Generator | Callable[[], Generator], batch: int = 8) -> Column:
    """struct<text, input_tokens, output_tokens> of a prompt. Where the model counts no tokens they are estimated; an
    answer without text is an error. Of an Arrow batch no more than batch prompts are held as Python texts."""

    @F.arrow_udf("text string, input_tokens long, output_tokens long")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = _loaded(generator)
        for s, u in batches:
            texts, asked, said = [], [], []
            for i in range(0, len(u), batch):
                ss, us = (["" if t is None else t for t in x.slice(i, batch).to_pylist()] for x in (s, u))
                for (t, n, m), a, b in zip(model.complete(ss, us), ss, us, strict=True):
                    if t is None:
                        raise ValueError("the model gave no answer")
                    texts.append(t.strip())
                    asked.append(-(-(len(a) + 1 + len(b)) // 4) if n is None else n)
                    said.append(-(-len(t) // 4) if m is None else m)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(asked, pa.int64()), pa.array(said, pa.int64())], ["text", "input_tokens", "output_tokens"])

    return run(system, user)
