from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.functions import generate, onnx
from quillsift.functions.models import ContextGenerator, HashingEmbedder, LeadGenerator, embed_column
from quillsift.operators.rerank import TEMPLATES, Template

BPE = "/opt/tokenizers/byte_bpe_50k.json"


class Scripted:
    """Answers by what the prompt holds, with token counts."""

    def __init__(self, rules, tokens=(None, None)):
        self.rules, self.tokens = rules, tokens

    def complete(self, system, user):
        return [(next((a for k, a in self.rules if k in u), None), *self.tokens) for u in user]


def test_summaries_and_judge(spark):
    docs = spark.createDataFrame([(1, "# A\nbody one"), (2, "no heading. At all"), (3, "# B\n{titles} text"), (4, None)], "doc_id long, text string")
    judge = Scripted([("\nA", " True\n"), ("\nB", "true."), ("", "x")])
    got = {r.doc_id: r.summary for r in generate.summaries(docs, LeadGenerator(1), judge).collect()}
    assert got == {1: "A", 2: "no heading.", 3: "# B\n{titles} text", 4: ""}


def test_rewrites(spark):
    q = spark.createDataFrame([(1, "Who {count}?"), (2, "what")], "query_id long, query_text string")
    model = Scripted([("Who {count}?\nAt most 2", '{"queries": [" b ", "c", "d"]}'), ("", "no json")], (10, 5))
    got = {r.query_id: (r.rewrites, r.additional_tokens) for r in generate.rewritten(q, lambda: model, 2).collect()}
    assert got[1] == (["Who {count}?", "b", "c"], 15) and got[2][0][0] == "what" and len(got[2][0]) == 3


def test_answers(spark):
    rows = spark.createDataFrame([("is the cat grey", ["a dog", " ", "the cat is black\nthe cat is grey"]), ("zzz", ["a"]), ("x", [])], "question string, contexts array<string>")
    got = [(r.answer, r.total_tokens == r.input_tokens + r.output_tokens) for r in generate.answered(rows, ContextGenerator()).collect()]
    assert got == [("the cat is grey", True), ("The context does not tell.", True), ("The context does not tell.", True)]
    assert rows.select(generate.answer_prompt(F.col("question"), F.col("contexts"))).first()[0] == "Context:\na dog\n\nthe cat is black\nthe cat is grey\n\nQuestion: is the cat grey"
    with pytest.raises(Exception, match="no answer"):
        generate.answered(rows, Scripted([])).collect()


def test_models_are_made_on_the_executors(spark):
    class Unsendable(HashingEmbedder):
        def __reduce__(self):
            raise TypeError("must not travel")

    d = spark.createDataFrame([("a b",), (None,)], "t string")
    got = [r[0] for r in d.select(embed_column(F.col("t"), lambda: Unsendable(8))).collect()]
    assert np.allclose(got, HashingEmbedder(8).embed(["a b", ""]))


def test_providers():
    assert onnx.providers("cpu", []) == ["CPUExecutionProvider"]
    assert onnx.providers("cuda", ["CUDAExecutionProvider"])[0] == "CUDAExecutionProvider"
    with pytest.raises(ValueError, match="cpu or cuda"):
        onnx.providers("tpu", [])
    with pytest.raises(RuntimeError, match="no CUDA"):
        onnx.providers("cuda", ["CPUExecutionProvider"])


def test_feeds():
    ids, mask = onnx.padded([[5, 6, 7], [8]], pad=9, left=True)
    assert ids.tolist() == [[5, 6, 7], [9, 9, 8]] and mask.tolist() == [[1, 1, 1], [0, 0, 1]]
    right, rmask = onnx.padded([[5, 6, 7], [8]], pad=9)
    assert right.tolist() == [[5, 6, 7], [8, 9, 9]] and rmask.tolist() == [[1, 1, 1], [1, 0, 0]]
    names = [("input_ids", "tensor(int64)", []), ("attention_mask", "", []), ("position_ids", "", []), ("past_key_values.0.key", "tensor(float16)", ["batch", 8, "past", 64])]
    f = onnx.feed(names, ids, mask)
    assert f["position_ids"].tolist() == [[0, 1, 2], [0, 1, 2]] and f["past_key_values.0.key"].shape == (2, 8, 0, 64) and f["past_key_values.0.key"].dtype == np.float16
    assert onnx.feed(names[:3], ids, mask, counted=True)["position_ids"].tolist() == [[0, 1, 2], [0, 0, 0]]
    with pytest.raises(ValueError, match="no value"):
        onnx.feed([("odd", "", [])], ids, mask)
    assert np.allclose(onnx.mean_pooled(np.array([[[3.0, 4.0], [9.0, 9.0]], [[0.0, 0.0], [0.0, 0.0]]]), np.array([[1, 0], [1, 1]])), [[0.6, 0.8], [0.0, 0.0]])


def test_pairs_are_cut():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(BPE)
    t = Template("Say ", "A: {query}\nB: {passage}", " now", "yes", "no")
    whole, cut = onnx.decoder_rows(tokenizer, t, ["who", "who"], ["it is {query}", "word " * 500], 40)
    assert tokenizer.decode(whole) == "Say A: who\nB: it is {query} now"
    assert len(cut) == 40 and tokenizer.decode(cut).startswith("Say A: who\nB: word") and tokenizer.decode(cut).endswith(" now")
    with pytest.raises(ValueError, match="no room"):
        onnx.decoder_rows(tokenizer, TEMPLATES["qwen_decoder"], ["a"], ["b"], 5)
    assert onnx.label_id(tokenizer, "yes") == tokenizer.token_to_id("yes")
    assert onnx.label_id(tokenizer, "no such label") == tokenizer.encode("no such label").ids[-1]
