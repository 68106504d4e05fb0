"""Every stage of the pipeline on its own input, against plain Python."""

import hashlib
import math

import numpy as np

import corpus_pipeline as cp
from millrace.llm import pii
from millrace.llm.sentencepiece_viterbi import Model, default_model

from .test_jaccard import brute
from .test_small_ops import _count


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "ing", "st"], rng.integers(1, 4)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(150)]
    texts = [t + f" call +1 (456) 555-21{i} or a.b{i}@mail.example.com" if 20 <= i < 60 else t for i, t in enumerate(texts)]
    texts += [texts[3], texts[3] + " extra", " ".join(texts[5].split()[:-2])]
    docs = [(i, t, "en" if i % 3 else "de", "src0" if i % 2 else f"s{i % 5}", len(t)) for i, t in enumerate(texts)]
    docs += [(900 + i, "%% && ## !! " * 20, "en", "src0", 240) for i in range(5)]
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(900, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_filter", "near_duplicates", "redact_personal_data", "mix_sources", "encode"]
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, now, d).write.parquet(f"{d}/{name}")
        before, now = now, spark.read.parquet(f"{d}/{name}")
        kept[name] = sorted(map(tuple, now.collect()), key=str)
        if name != "encode":
            assert now.columns == before.columns == cp.COLUMNS
    first = kept["quality_filter"]
    assert not [r for r in first if r[0] >= 900] and len(first) >= 0.97 * len(texts) and set(first) <= set(docs)
    groups = brute([(r[0], r[1]) for r in first], 5, 80, 100)
    stay = {g[0] for g in groups if g[0] == g[2]}
    assert kept["near_duplicates"] == [r for r in first if r[0] in stay] and len(stay) < len(first)
    for r in kept["redact_personal_data"]:
        old = next(x for x in kept["near_duplicates"] if x[0] == r[0])
        base, added = pii.find_spans(pii.trained(), [old[1]])[0]
        assert r[1] == pii.redact(old[1], sorted(base + added)) and r[4] == len(r[1])
    assert any("<PHONE> or <EMAIL>" in r[1] for r in kept["redact_personal_data"])
    third = kept["redact_personal_data"]
    n = {s: sum(r[3] == s for r in third) for s in {r[3] for r in third}}
    total = sum(math.sqrt(v) for v in n.values())
    want = [r for r in third for _ in range(_count(17, r[0], len(third) * math.sqrt(n[r[3]]) / (total * n[r[3]])))]
    assert kept["mix_sources"] == sorted(want, key=str)
    m = Model(default_model())
    assert len(kept["encode"]) == len(want)
    for r in now.collect():
        text = next(x[1] for x in third if x[0] == r.doc_id)
        assert list(r.ids) == m.encode(text) and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(map(str, cp.run(spark, d).collect())) == sorted(map(str, now.collect()))


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    d = str(tmp_path)
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (1, base), (1, "other " * 9 + "text"), (2, base + " tail"), (3, None), (4, ""), (None, base), (None, base), (5, "a" * 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, component_id int, _copy int, spans string, _null string"
    docs = spark.createDataFrame([(i, x, None, None, None, "k", 1, 2, "s", "n") for i, x in rows], schema)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    show = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    scored = cp.quality_filter(spark, docs, d)
    assert scored.columns == cp.COLUMNS and show(scored) == sorted([r for r in rows if r[1]], key=str)  # no labels: only what has no text goes
    near = cp.near_duplicates(spark, docs, d)
    assert near.columns == cp.COLUMNS
    assert show(near) == sorted([rows[0], rows[2], *rows[4:]], key=str)
    redacted = cp.redact_personal_data(spark, docs, d)
    assert redacted.columns == cp.COLUMNS and show(redacted) == sorted(rows, key=str)
    mixed = cp.mix_sources(spark, docs, d)
    assert mixed.columns == cp.COLUMNS and set(show(mixed)) <= set(rows)
    assert cp.encode(spark, docs, d).count() == len(rows)


def test_empty(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).count() == 0


def test_batches_to_workers_are_bounded(spark):
    from millrace.llm.common import BATCH_BYTES, bounded_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 8000) AS text", "'en' AS lang", "'s' AS source", "40000L AS n_chars")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"mb": [b.nbytes]})

    try:
        cp.encode(spark, docs, "")  # only built: the setting holds when a plan runs
        got = [r["mb"] for r in docs.select("text").mapInArrow(sizes, "mb long").collect()]
        assert sum(got) >= 600 * 40_000 and max(got) <= BATCH_BYTES + 100_000
        spark.conf.set(key, "1m")
        bounded_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
