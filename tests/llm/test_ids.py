"""Ids of more digits than a float holds come out as they went in, beside null ids."""

import numpy as np
import pytest

from brightfold.llm import katz, neardup, packing, pieces, queries, toxicity

IDS = [2**53 + 1, None, 2**53 + 3, -(2**62) - 1, None, 7]
BPE, MODEL = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("piece_bpe_32k.model")
MODEL_OF_NOTHING = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
OPERATORS = {
    "op2": lambda d: neardup.groups(neardup.numbered(d), 2),
    "op3": lambda d: toxicity.score(d, MODEL_OF_NOTHING),
    "op4": katz.scores,
    "op6": lambda d: packing.pack(d, BPE),
    "op8": lambda d: pieces.digest(pieces.encode(d, MODEL, giant=20, chunk=8), MODEL),
    "op10": lambda d: pieces.token_counts(d, MODEL),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_large_and_null_ids(spark, name):
    texts = ["one two three", "four five", None, "", "a text of more than twenty letters", "six"]
    d = spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").coalesce(1)
    got = [r.doc_id for r in OPERATORS[name](d).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)
