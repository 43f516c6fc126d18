"""The pipeline operators against brute force, a library or exact round trips, with their edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfold.llm import katz, neardup, packing, pieces, queries, secrets, sharding, toxicity, vectors
from brightfold.llm.wordbpe import WordBpe

from ..conftest import rows, sql_rows

BPE, MODEL = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, " ", "'s it's I'LL !'s", "ΑΣ ΣΑΣ", "é é İ", "<|endoftext|>", "日本 ☃", "a\x1cb\tc\x0bd\x85e", "x" * 300 + " " + "ab" * 60, "🙂 ² ½ “q” ▁ x▁y", " हिन्दी"]


def docs(spark, texts, ids=None):
    extra = [(i, t, "en", "src", 0, "row", 1) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, length string, rank int")


def word_text(r, n, words="alpha beta gamma delta one two three four five six".split()):
    return " ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert rows(queries.QUERIES[name](spark, sf)) == sql_rows(duck, queries.SQL[name])


# --- packing ---


def test_word_bpe_is_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    r = random.Random(2)
    texts = ODD + [word_text(r, 40) for _ in range(20)]
    for text, ids in zip(texts, WordBpe(BPE).texts(texts)):
        assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_places_every_piece(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    for x in r.integers(1, 101 if seed % 2 else 40, 500):
        counts[x] += 1
    plan = packing.best_two_fit(counts, 100)
    used = np.zeros(101, np.int64)
    for items, bins in plan:
        assert sum(items) <= 100
        for x in items:
            used[x] += bins
    assert (used == counts).all()
    assert sum(b for _, b in plan) <= math.ceil((counts * np.arange(101)).sum() / 100) * 1.2 + 1


def test_pack(spark):
    r = random.Random(1)
    texts = ODD + [word_text(r, r.randint(0, 80)) for _ in range(60)] + ["same text"] * 30 + [word_text(r, 400)]
    got = packing.pack(docs(spark, texts, [None, *range(1, len(texts))]), BPE, 128).toPandas()
    ids = [np.append(x, np.uint32(1)) for x in WordBpe(BPE).texts(texts)]
    want = sorted((p, zlib.crc32(x[p * 128 : (p + 1) * 128].tobytes())) for x in ids for p in range(-(-len(x) // 128)))
    assert sorted(zip(got.piece, got.ids_crc32)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 128
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 128) + 2
    assert packing.pack(docs(spark, []), BPE).count() == 0


# --- pieces ---


def unigram():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_words_have_the_library_s_best_score():
    sp, lattice = unigram(), pieces.Lattice(MODEL)
    for w in ["theationsh", "hethshtion", "unbelievable", "Hello", "xyzzy12", "größe", "a"]:
        lattice.learn([[w]])
        ids = np.frombuffer(lattice.words[w], "<u4").tolist()
        best = sp.nbest_encode_as_ids(w, 2)[0]
        assert sum(map(sp.get_score, ids)) == sum(map(sp.get_score, best))
        lattice.count([[w]])
        assert lattice.counts[w] == len(ids)


def test_giants_are_encoded_like_others(spark):
    r = random.Random(3)
    texts = [word_text(r, 900), "abcdefgh▁ij" * 300, " " * 2500, "x" * 1500 + " " + "☃y" * 900, *ODD, "dup dup", "dup dup"]
    d = docs(spark, texts)
    whole = {x.doc_id: x for x in pieces.decode(pieces.encode(d, MODEL, giant=10**9), MODEL).collect()}
    cut = {x.doc_id: x for x in pieces.decode(pieces.encode(d, MODEL, giant=1000, chunk=97), MODEL).collect()}
    counts = {x.doc_id: x.n_tokens for x in pieces.token_counts(d, MODEL).collect()}
    for i, t in enumerate(texts):
        assert whole[i].ids == cut[i].ids and whole[i].decoded == (t or "") and counts[i] == len(whole[i].ids)
    assert pieces.digest(pieces.encode(docs(spark, []), MODEL), MODEL).count() == 0


@pytest.mark.parametrize("fan", [2, 16])
def test_chunks_are_combined_by_a_tree(spark, monkeypatch, fan):
    """Products of products give what carrying the scores from chunk to chunk gives, on a text of 1,000 chunks and one of a few."""
    monkeypatch.setattr(pieces, "FAN", fan)
    r = np.random.default_rng(fan)
    held = []
    for key, n in ((1, 1000 if fan == 16 else 37), (2, 3), (3, 1)):
        held += [(key, c, np.where(r.random((5, 5)) < 0.3, pieces.NONE, -r.integers(0, 2**30, (5, 5)).astype(float)), r.integers(0, 5, 5).astype(np.int32)) for c in range(n)]
    most = 1 + max(c for _, c, _, _ in held)
    scores = spark.createDataFrame([(k, c, bytearray(m.tobytes())) for k, c, m, _ in held], "key long, c int, m binary")
    maps = spark.createDataFrame([(k, c, bytearray(m.tobytes())) for k, c, _, m in held], "key long, c int, m binary")
    got = {(x.key, x.c): np.frombuffer(x.state) for x in pieces.scan(scores, most, pieces.scores_product, pieces.scores_after, pieces.scores_start).collect()}
    places = {(x.key, x.c): np.frombuffer(x.state, np.int32)[0] for x in pieces.scan(maps, most, pieces.map_product, pieces.map_after, pieces.map_start).collect()}
    assert len(got) == len(places) == len(held)
    for key, c, m, f in held:
        if not c:
            state, place = np.array([0.0] + [pieces.NONE] * 4), 0
        assert np.array_equal(got[key, c], state - state.max()) and places[key, c] == place
        state, place = (state[:, None] + m).max(0), f[place]


def test_pieces_longer_than_a_chunk_s_reach(spark, monkeypatch):
    monkeypatch.setattr(pieces, "REACH", 2)
    with pytest.raises(Exception, match="reach 2 past"):
        pieces.encode(docs(spark, ["word " * 50]), MODEL, giant=100, chunk=97).count()


# --- near-duplicates ---


def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("k,cell,block", [(2, 512, 1024), (5, 4, 8)])
def test_groups(spark, monkeypatch, k, cell, block):
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(k)
    texts = ["", None, "one", "ONE", "a b", "a  b\n", " \t "]
    for _ in range(6):
        base = word_text(r, r.choice([12, 60, 150])).split()
        for _ in range(r.choice([3, 25])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = f"new{r.randint(0, 99)}"
            texts.append(" ".join(copy))
    got = neardup.groups(neardup.numbered(docs(spark, texts)), k).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_groups(texts, k, 80)


def test_keep_one_keeps_columns_and_one_of_repeated_rows(spark):
    d = docs(spark, ["p q r s t u", "p q r s t u", "p q r s t u", "other words here", None, None], [7, 7, 9, 3, 1, 2])
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == [1, 2, 3, 7]
    assert neardup.keep_one(docs(spark, [])).count() == 0


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 900, np.uint64)
    s = neardup.sketch([np.unique(a[:800]), np.unique(a[100:]), a[:1]], 288)
    assert (s < np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - 700 / 900) < 0.1


# --- language model ---


def brute_katz(rows, order):
    texts = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    train = [x for d, x in texts if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    count = [collections.Counter() for _ in range(order + 1)]
    for x in train:
        y = ["START"] * (order - 1) + x
        for i in range(order - 1, len(y)):
            for m in range(1, order + 1):
                count[m][tuple(y[i - m + 1 : i + 1])] += 1
    d = [None] + [katz.Discounts([sum(v == r for v in count[m].values()) for r in range(1, katz.CUT + 2)]) for m in range(1, order + 1)]
    after = [collections.defaultdict(dict) for _ in range(order + 1)]
    for m in range(2, order + 1):
        for g, c in count[m].items():
            after[m][g[:-1]][g[-1]] = c
    n, v = sum(count[1].values()), len(count[1])
    taken1 = sum(c * (1 - d[1].d[c]) for c in count[1].values() if c <= katz.CUT)

    def p(g):
        m = len(g)
        if m == 1:
            c = count[1].get(g, 0)
            return (d[1].d[min(c, katz.CUT + 1)] * c if c else taken1 or 1) / (n if taken1 > 0 else n + 1)
        seen = after[m].get(g[:-1])
        if not seen:
            return p(g[1:])
        taken = sum(c * (1 - d[m].d[c]) for c in seen.values() if c <= katz.CUT)
        whole = sum(seen.values()) + (taken <= 0)
        if g[-1] in seen:
            return d[m].d[min(seen[g[-1]], katz.CUT + 1)] * seen[g[-1]] / whole
        return (taken if taken > 0 else 1) / whole / (1 - sum(p(g[1:-1] + (w,)) for w in seen)) * p(g[1:])

    words = [w for (w,) in count[1]] + ["never seen"]
    for h in list(after[order])[:20]:  # every history's probabilities add up to one
        assert abs(sum(p(h + (w,)) for w in words) - 1) < 1e-9
    out = []
    for doc, x in texts:
        y = ["START"] * (order - 1) + x
        out.append((doc, len(x), sum((w,) in count[1] for w in x), n, sum(math.log10((count[1].get((w,), 0) + 1) / (n + v + 1)) for w in x), sum(math.log10(p(tuple(y[i - order + 1 : i + 1]))) for i in range(order - 1, len(y)))))
    return out


@pytest.mark.parametrize("order,tokens", [(2, 10**6), (3, 300)])
def test_katz(spark, order, tokens):
    r = random.Random(order)
    texts = [" ".join(r.choice("a b c d e f g h".split()[: r.randint(1, 8)]) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "rare Words HERE", "a a a"]
    d = docs(spark, texts)
    got = {x.doc_id: x for x in katz.scores(d, order=order, tokens=tokens).collect()}
    for doc, n, known, total, base, score in brute_katz(list(enumerate(texts)), order):
        x = got[doc]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total)
        assert abs(x.base_score - base) < 1e-9 and abs(x.score - score) < 1e-9
        assert x.held_out == (zlib.crc32(str(doc).encode()) % 7 == 2)
    assert katz.scores(docs(spark, [])).count() == 0


# --- vectors ---


def table(spark, x, ids=None):
    got = [(int(i), [float(v) for v in e] if e is not None else None, 1) for i, e in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(got, "vec_id long, embedding array<float>, score int")


def brute_top(x, every, k):
    out = {}
    for q in range(0, len(x), every):
        s = x @ x[q]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))
        out[q] = [(i, s[i]) for i in order[:k]]
    return out


def test_exact_top_k(spark):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(900, 8)), 2).astype(np.float32)
    x[100:130] = x[100]  # ties
    x[5] = 0
    got = collections.defaultdict(list)
    for row in vectors.exact_top_k(table(spark, x)).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    assert dict(got) == {q: [(i, int(s)) for i, s in v] for q, v in brute_top(np.floor(64 * x.astype(np.float64)), 20, 20).items()}


def test_vectors_that_take_no_part(spark):
    t = table(spark, [[1, 0], None, [float("nan"), 1], [0, 0], [2, 1], [2, 1]], [0, 20, 40, 60, 61, 61])
    assert {(x.query_id, x.vec_id, x.score) for x in vectors.exact_top_k(t).collect()} == {(0, 61, 128 * 64), (0, 60, 0), (60, 0, 0), (60, 61, 0)}
    assert {(x.query_id, x.vec_id, x.score) for x in vectors.nearest(t).collect()} == {(0, 61, 2.0)}
    assert vectors.exact_top_k(t.limit(0)).count() == 0 and vectors.nearest(t.limit(0)).count() == 0


def test_recall(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(30, 16))[r.integers(0, 30, 3000)] + 0.5 * r.normal(size=(3000, 16))
    x = x.astype(np.float32)
    want = brute_top(x.astype(np.float64), 20, 20)
    got = collections.defaultdict(list)
    for row in vectors.nearest(table(spark, x), lists=24).collect():
        got[row.query_id].append(row.vec_id)
    hits = sum(len({i for i, _ in v} & set(got[q])) for q, v in want.items())
    assert all(len(v) == 20 for v in got.values()) and hits >= 0.9 * 20 * len(want)


# --- sharding, secrets, toxicity ---


def test_sharding(spark):
    texts = ["x" * n for n in (1, 50, 400, 90)] + ["y" * 60] * 40 + [None, ""]
    ids = [*range(4), *[77] * 30, *range(100, 110), None, 200]
    got = sharding.with_sizes(sharding.assign(docs(spark, texts, ids), 300)).collect()
    assert len(got) == len(texts)
    for x in got:
        assert x.shard_bytes <= 300 or x.shard_rows == 1
        assert len(x.shard) == x.depth
    assert sharding.assign(docs(spark, []), 300).count() == 0


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.findings(spark, 3000), trees=10)


def test_secrets(spark, forest):
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = [f'see token = "{key}" and token = "{key}"', f'TOKEN = "{key.upper()}"', "card 4845168114407329 or id 12345678-1234-1234-1234-123456789012", "plain", "", None, "commit " + key, "🙂 " + f'secret: "{key}"']
    d = docs(spark, texts)
    found = secrets.scan(d, forest).collect()
    assert all(texts[x.doc_id][x.start : x.start + x.length] == x.candidate for x in found)
    assert collections.Counter(x.doc_id for x in found if x.is_secret) == {0: 2, 1: 1, 7: 1}
    clean = secrets.redact(d, forest)
    assert clean.columns == d.columns
    texts_after = {x.doc_id: x.text for x in clean.collect()}
    assert key not in texts_after[0] and texts_after[0].count(secrets.REDACTED) == 2
    assert all(texts_after[i] == texts[i] for i in (2, 3, 4, 5, 6))
    assert "Python" not in clean._jdf.queryExecution().toString()


def test_forest_on_findings_not_seen(spark, forest):
    later = secrets.findings(spark, 5000).withColumn("n", F.monotonically_increasing_id())
    seen = secrets.findings(spark, 3000).select("candidate").distinct()
    vote = " + ".join(t.format(**{n: n for n in secrets.FEATURES}) for t in forest)
    fresh = later.join(seen, "candidate", "left_anti").select("label", *secrets.features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path")))
    right = fresh.selectExpr(f"avg(int((({vote}) / {len(forest)} >= 0.5) = (label = 1))) AS a").first().a
    assert right > 0.9


def test_toxicity(spark):
    r = random.Random(4)
    clean, bad = [f"word{i}" for i in range(300)], ["vile", "scumlike", "scummy", "scumbag"]
    texts, labels = [], []
    for i in range(1500):
        t = [r.choice(clean) for _ in range(r.randint(5, 200))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(2, 8)):
                t.insert(r.randrange(len(t)), r.choice(bad))
        texts.append(" ".join(t))
        labels.append((i, int(toxic)))
    texts += ["", None]
    d = docs(spark, texts)
    model = toxicity.fit(d, spark.createDataFrame(labels[:1000], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(d, model).collect()}
    assert sum(got[i].rejected == bool(y) for i, y in labels[1000:]) >= 0.98 * 500
    assert not got[1500].rejected and not got[1501].rejected and (np.diff(model.thetas) > 0).all()
    mild, severe = (toxicity.score(docs(spark, [t]), model).first().severity for t in ("word1 vile", "vile scumlike scummy scumbag word1"))
    assert mild < severe
    assert toxicity.keep_clean(d, model).columns == d.columns
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not toxicity.score(d, none).where("rejected").count()


def test_pipeline(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    before = d.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, d, sf)
        assert out.dtypes == d.dtypes and out.columns == before
        d = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < d.count() <= 150
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert packed.select("doc_id").distinct().count() == d.count()
