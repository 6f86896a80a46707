"""Embedders and rerankers over onnxruntime and tokenizer files. Made on the executors: pass a function that makes one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from quillsift.operators.rerank import TEMPLATES, Template


def providers(device: str, available: Sequence[str]) -> list[str]:
    """onnxruntime providers for "cpu" or "cuda"; an error for other names, or where there is no CUDA."""
    if device not in ("cpu", "cuda"):
        raise ValueError(f"a device is cpu or cuda, not {device}")
    if device == "cuda" and "CUDAExecutionProvider" not in available:
        raise RuntimeError("onnxruntime has no CUDA here")
    return ["CUDAExecutionProvider", "CPUExecutionProvider"] if device == "cuda" else ["CPUExecutionProvider"]


def padded(rows: Sequence[Sequence[int]], pad: int = 0, left: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask), of the longest row's width."""
    width = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), width), pad, np.int64), np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        at = slice(width - len(r), width) if left else slice(0, len(r))
        ids[i, at], mask[i, at] = r, 1
    return ids, mask


def feed(inputs: Sequence[tuple[str, str, Sequence]], ids: np.ndarray, mask: np.ndarray, counted: bool = False) -> dict[str, np.ndarray]:
    """What a session is given, from its inputs' (name, type, shape). position_ids run over all places, or, with counted,
    over those that are not padding; a key-value cache is empty: its axes without a fixed size are the batch and a length
    of 0."""
    out = {}
    for name, kind, shape in inputs:
        if name == "input_ids":
            out[name] = ids
        elif name == "attention_mask":
            out[name] = mask
        elif name == "token_type_ids":
            out[name] = np.zeros_like(ids)
        elif name == "position_ids":
            out[name] = np.maximum(np.cumsum(mask, axis=1) - 1, 0) if counted else np.broadcast_to(np.arange(ids.shape[1]), ids.shape).copy()
        elif name.startswith("past_"):
            size = [len(ids) if i == 0 else d if isinstance(d, int) else 0 for i, d in enumerate(shape)]
            out[name] = np.zeros(size, np.float16 if "float16" in kind else np.float32)
        else:
            raise ValueError(f"no value for the input {name}")
    return out


def decoder_rows(tokenizer: object, template: Template, queries: Sequence[str], passages: Sequence[str], max_length: int) -> list[list[int]]:
    """Ids of prefix, pair and suffix; the pair is cut so that all fit, an error if they leave it no room."""
    def encode(s: str) -> list[int]:
        return tokenizer.encode(s, add_special_tokens=False).ids

    before, after = encode(template.prefix), encode(template.suffix)
    room = max_length - len(before) - len(after)
    if room <= 0:
        raise ValueError("max_length leaves no room for a pair beside the prompt")
    return [before + encode(template.pair(q, p))[:room] + after for q, p in zip(queries, passages)]


def label_id(tokenizer: object, label: str) -> int:
    """The id of a label's token; the last one of its encoding where it is no token by itself."""
    found = tokenizer.token_to_id(label)
    return tokenizer.encode(label, add_special_tokens=False).ids[-1] if found is None else found


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means over the tokens that are not padding, at length 1."""
    m = mask[:, :, None].astype(np.float64)
    v = (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


class _Session:
    def __init__(self, model: str, tokenizer: str, device: str = "cpu", max_length: int = 512) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        self.session = onnxruntime.InferenceSession(model, providers=providers(device, onnxruntime.get_available_providers()))
        self.tokenizer, self.max_length = Tokenizer.from_file(tokenizer), max_length

    def run(self, ids: np.ndarray, mask: np.ndarray, counted: bool = False) -> np.ndarray:
        given = feed([(i.name, i.type, i.shape) for i in self.session.get_inputs()], ids, mask, counted)
        return self.session.run(None, given)[0]


class OnnxEmbedder(_Session):
    def embed(self, texts: Sequence[str]) -> np.ndarray:
        ids, mask = padded([e.ids[: self.max_length] for e in self.tokenizer.encode_batch(list(texts))])
        return mean_pooled(self.run(ids, mask), mask)


class OnnxDecoderReranker(_Session):
    """Logit of yes less that of no after the prompt."""

    def __init__(self, model: str, tokenizer: str, kind: str = "qwen_decoder", template: Template | None = None, **more: object) -> None:
        super().__init__(model, tokenizer, **more)
        self.template = template or TEMPLATES[kind]

    def score(self, queries: Sequence[str], passages: Sequence[str]) -> np.ndarray:
        ids, mask = padded(decoder_rows(self.tokenizer, self.template, queries, passages, self.max_length), left=True)
        last = self.run(ids, mask, counted=True)[:, -1, :]
        return (last[:, label_id(self.tokenizer, self.template.yes)] - last[:, label_id(self.tokenizer, self.template.no)]).astype(np.float64)


class OnnxClassifierReranker(_Session):
    """The logit of a sequence classifier over (query, passage)."""

    def score(self, queries: Sequence[str], passages: Sequence[str]) -> np.ndarray:
        self.tokenizer.enable_truncation(self.max_length)
        ids, mask = padded([e.ids for e in self.tokenizer.encode_batch(list(zip(queries, passages)))])
        return np.asarray(self.run(ids, mask), np.float64).reshape(len(ids), -1)[:, 0]
