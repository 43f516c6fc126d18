"""What the pipeline operators must not leave out, against the libraries and by reading back what is written."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfold.llm import pieces, queries, sharding
from brightfold.llm.wordbpe import WordBpe

from .test_llm import BPE, MODEL, ODD, docs, unigram

RUNS = ["a  b", "a   b", "        x = 1", "a    b", " a", "  ", "a  ", "x   \n    y", "a     Zq", "|  a |   b   |"]


def test_runs_of_spaces_have_the_library_s_pieces():
    sp, lattice = unigram(), pieces.Lattice(MODEL)
    for t in RUNS:
        words = pieces.split(t)
        lattice.learn([words])
        lattice.count([words])
        ids = np.frombuffer(b"".join(lattice.words[w] for w in words), "<u4").tolist()
        assert ids == sp.nbest_encode_as_ids(t, 2)[0]
        assert sum(lattice.counts[w] for w in words) == len(ids) and lattice.decode(ids) == t


def test_long_runs_have_a_best_score():
    """The library adds in 32 bits, where a billion swallows what tells words apart: its path may have a lower score, never a higher one."""
    sp, lattice = unigram(), pieces.Lattice(MODEL)
    for t in ["if x:\n        return  1", *(" " * n + "return" + " " * (n // 2) + "x" for n in range(2, 70))]:
        words = pieces.split(t)
        lattice.learn([words])
        ids = np.frombuffer(b"".join(lattice.words[w] for w in words), "<u4").tolist()
        assert sum(map(sp.get_score, ids)) >= sum(map(sp.get_score, sp.nbest_encode_as_ids(t, 2)[0]))


@pytest.mark.parametrize("chunk", [5, 97])
def test_runs_of_spaces_in_giants(spark, chunk):
    texts = [("def f(x):\n" + " " * 8 + "return   x" + " " * 33 + "# y\n") * 30, (" " * 200 + "z") * 8, "ab  " * 300, " a" * 600]
    d = docs(spark, texts)
    whole = {x.doc_id: x.ids for x in pieces.encode(d, MODEL, giant=10**9).collect()}
    cut = {x.doc_id: x for x in pieces.decode(pieces.encode(d, MODEL, giant=1000, chunk=chunk), MODEL).collect()}
    counts = {x.doc_id: x for x in pieces.token_counts(d, MODEL).collect()}
    for i, t in enumerate(texts):
        assert cut[i].ids == whole[i] and cut[i].decoded == t
        assert counts[i].n_tokens == len(whole[i]) and counts[i].n_words == t.count(" ") + 1


def test_written_shards_hold_every_row(spark, tmp_path):
    texts = ["x" * n for n in (1, 50, 400, 90)] + ["y" * 60] * 40 + [None, ""] + ["z" * 70] * 9
    ids = [*range(4), *[77] * 30, *range(100, 110), 5, 200, *[None] * 9]
    d = docs(spark, texts, ids)
    sharding.write(d, str(tmp_path / "out"), 300)
    back = spark.read.parquet(str(tmp_path / "out"))
    whole = lambda df: collections.Counter(tuple(r) for r in df.select(*d.columns).collect())
    assert whole(back) == whole(d)
    sizes = back.groupBy(F.regexp_extract(F.input_file_name(), "(shard=.*)/", 1)).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all((x.b or 0) <= 300 or x.n == 1 for x in sizes)
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in (tmp_path / "out").glob("shard=*/page=*"))


def test_added_tokens_are_the_library_s(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    texts = [*ODD, "a <|endoftext|> b", "<|STARTOFTEXT|>x<|endoftext|>", "a<|endoftext|>" + "y" * 200, "é <|endoftext|>", "a <|endoftext b"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert want[len(ODD)] == [320, 49407, 321]
    assert [x.tolist() for x in WordBpe(BPE, added=True).texts(texts)] == want
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.ids_crc32 for x in queries.op6_best_fit_packing(spark, str(tmp_path)).collect() if x.piece == 0}
    assert got == {i: zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for i, x in enumerate(want)}
