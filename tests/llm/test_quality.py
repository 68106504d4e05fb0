import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import quality


class Brute:
    """Plain modified Kneser-Ney over dictionaries."""

    def __init__(self, texts):
        counts = Counter()
        for t in texts:
            c = [255] * 4 + list(t.encode())
            counts.update(tuple(c[i - 4 : i + 1]) for i in range(4, len(c)))
        self.counts = {5: counts}
        for n in (5, 4, 3, 2):
            lower = Counter(k[1:] for k in self.counts[n])
            self.counts[n - 1] = lower
        self.d = {n: quality.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in self.counts.items()}
        self.context = {n: defaultdict(list) for n in range(1, 6)}
        for n, c in self.counts.items():
            for k, v in c.items():
                self.context[n][k[:-1]].append(v)

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / 256
        lower = self.p(gram[1:])
        seen = self.context[n].get(gram[:-1])
        if not seen:
            return lower
        d, c = self.d[n], self.counts[n].get(gram, 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(v, 3)] for v in seen) * lower) / sum(seen)

    def perplexity(self, text):
        c = [255] * 4 + list(text.encode())
        logs = [math.log(self.p(tuple(c[i - 4 : i + 1]))) for i in range(4, len(c))]
        return math.exp(-sum(logs) / len(text)) if logs else None


@pytest.mark.parametrize("small", [False, True])
def test_perplexity_against_plain_model(spark, monkeypatch, small):
    if small:  # several levels of merging, several salts, texts cut into pieces
        monkeypatch.setattr("millrace.llm.quality.SLICE_BYTES", 64)
        monkeypatch.setattr("millrace.llm.quality.MERGE", 2)
        monkeypatch.setattr("millrace.llm.quality.BLOCK_BYTES", 500)
        monkeypatch.setattr("millrace.llm.quality.TASK_BYTES", 1000)
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "é", "ß", "漢", "🙂", "1", "A"], rng.integers(1, 4)))
    train = [" ".join(word() for _ in range(rng.integers(0, 40))) for _ in range(30)]
    texts = train[:5] + ["", None, "zzz %% qq", "the an er on", "x" * 5000] + [" ".join(word() for _ in range(10)) for _ in range(20)]
    model = Brute(train)
    docs = spark.createDataFrame([(i, t, "perp") for i, t in enumerate(texts)], "doc_id long, text string, perplexity string").repartition(3)
    out = quality.perplexities(docs, spark.createDataFrame([(t,) for t in train], "text string"), ["doc_id"]).collect()
    assert len(out) == len(texts)
    for r in out:
        want = model.perplexity(texts[r.doc_id] or "")
        assert (r.perplexity is None) == (want is None)
        if want is not None:
            assert r.perplexity == pytest.approx(want, rel=1e-5)
    total = sum(model.p((*b"the ", x)) for x in range(256))
    assert total == pytest.approx(1)


def test_grams_are_those_of_each_document():
    texts = [b"", b"a", b"", b"bc", b"def", "é漢🙂".encode(), b"longer text here", b"x"]
    data = np.frombuffer(b"??" + b"".join(texts), np.uint8)
    offsets = np.cumsum([2, *map(len, texts)])
    want = []
    for t in texts:
        padded = b"\xff" * 4 + t
        want += [int.from_bytes(padded[i : i + 5], "big") for i in range(len(t))]
    for size in (1, 2, 3, 5, 7, 100):
        got = [int(x) for lo in range(2, len(data), size) for x in quality.grams(data, offsets, lo, min(lo + size, len(data)))]
        assert got == want


def test_characters_of_every_script_stay_apart(spark):
    han = "".join(chr(0x4E00 + i) for i in range(2000))
    docs = spark.createDataFrame([(1, han), (2, han[::-1])], "doc_id long, text string")
    out = {r.doc_id: r.perplexity for r in quality.perplexities(docs, docs.where("doc_id = 1").select("text"), ["doc_id"]).collect()}
    assert out[1] < out[2]
    model = Brute([han])
    assert out[2] == pytest.approx(model.perplexity(han[::-1]), rel=1e-5)


def test_lookup():
    codes = np.unique(np.random.default_rng(0).integers(0, 2**50, 5000, dtype=np.uint64))
    look = quality.Lookup(codes, np.arange(len(codes)))
    assert (look(codes[::-1]) == np.arange(len(codes))[::-1]).all()


def test_classify_and_edges(spark):
    rng = np.random.default_rng(1)
    prose = lambda: " ".join("".join(rng.choice(["an", "the", "er", "on", "ing"], rng.integers(1, 4))) for _ in range(40))
    docs = [(i, prose(), "en" if i % 2 else None) for i in range(400)] + [(1000 + i, "%% && ## !! " * 20, "en") for i in range(10)] + [(2000, None, "en"), (2001, "", None), (None, prose(), "xx"), (3, prose(), "en")]
    labels = [(i, 1, 0) for i in range(0, 400, 2)] + [(1, 1, 0), (1, 0, 0), (5, 1, 1), (7, None, None), (None, 1, 0), (1001, 0, 0)] + [(i, 1, 0) for i in range(9, 399, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS threshold", "'s' AS source")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from millrace.llm.common import materialize

    d = materialize(d, "t")
    out = quality.classify(d, lab).collect()
    assert len(out) == len(docs)
    junk = [r for r in out if r.doc_id is not None and 1000 <= r.doc_id]
    assert not any(r.keep for r in junk)
    clean = [r for r in out if r.doc_id is None or r.doc_id < 1000]
    held = {r.doc_id for r in quality.trusted_ids(lab).where("held_out").collect()}
    most = max(r.perplexity for r in clean if r.doc_id in held)
    assert all(r.threshold <= most for r in clean)  # a quantile of the held-out documents, without slack
    assert sum(r.keep for r in clean) >= 0.93 * len(clean)
    assert {r.doc_id for r in quality.trusted_ids(lab).collect()} == {i for i, q, t in labels if q == 1 and t == 0 and i is not None} - {1}
    none = quality.classify(d, lab.limit(0)).collect()
    assert all(r.keep == (r.perplexity is not None) for r in none)
    assert quality.classify(d.limit(0), lab).count() == 0


def test_cut_follows_labelled_bad_documents(spark):
    from millrace.llm.common import materialize

    rng = np.random.default_rng(3)
    sylls = ["an", "the", "er", "on", "ing"]
    prose = lambda odd=0: " ".join("".join(rng.choice(["qu", "xy"] if i < odd else sylls, rng.integers(1, 4))) for i in range(40))
    docs = [(i, prose(), "en") for i in range(1500)] + [(5000 + i, prose(int(rng.integers(1, 3))), "en") for i in range(100)]  # toxic: good prose but for a word or two
    docs = materialize(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "t")
    labels = spark.createDataFrame([(i, 1, int(i >= 5000)) for i in [*range(1500), *range(5000, 5100)]], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).toPandas()
    toxic = out[out.doc_id >= 5000]
    assert out.threshold.nunique() == 1
    held = out.merge(quality.trusted_ids(labels).where("held_out").toPandas(), on="doc_id")
    assert out.threshold.iloc[0] <= held.perplexity.max()  # no slack beyond the held-out documents
    assert (~toxic.keep).mean() >= 0.9 and out[out.doc_id < 1500].keep.mean() >= 0.93


def test_the_query_covers_all_documents(spark, tmp_path):
    import __spark_entry__

    rng = np.random.default_rng(6)
    docs = [(i, " ".join(rng.choice(["an", "the", "er", "on"], 30)), "en", "web", 1, i) for i in range(60)] + [(3, None, None, None, None, 0), (None, "the an", "de", "web", 1, 0), (4, "", "en", "web", 0, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, perplexity int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0, "x") for i in range(50)], "doc_id long, quality int, toxic int, lang string").write.parquet(str(tmp_path / "labels.parquet"))
    out = __spark_entry__.queries()["op5_quality_kneser_ney"](spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d[0]) for d in docs)
    held = {r.doc_id for r in quality.trusted_ids(spark.read.parquet(str(tmp_path / "labels.parquet"))).where("held_out").collect()}
    model = Brute([t for i, t, *_ in docs if i is not None and i < 50 and i not in held and t])
    by = {d[0]: d[1] for d in docs[:60]}
    for r in out:
        if r.n_scored and r.doc_id in by:
            assert any(r.perplexity == pytest.approx(model.perplexity(t), rel=1e-5) for i, t, *_ in docs if i == r.doc_id and t)
        assert r.keep == (r.perplexity is not None and (r.threshold is None or r.perplexity <= r.threshold))
