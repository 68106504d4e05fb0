import re

import numpy as np
import pytest

from millrace.llm.substrings import remove_repeats


def brute(rows, k):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(t for _, t in rows)}
    first = {}
    for i, (d, _) in enumerate(rows):
        for s in range(len(words[i]) - k + 1):
            if d is not None:
                w = tuple(words[i][s : s + k])
                first[w] = min(first.get(w, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        drop = set()
        for s in range(len(words[i]) - k + 1):
            if d is not None and first[tuple(words[i][s : s + k])] < d:
                drop |= set(range(s, s + k))
        kept = [w for j, w in enumerate(words[i]) if j not in drop]
        out.append((d, len(words[i]), len(drop), " ".join(kept)))
    return out


def compare(spark, rows, k=13):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in remove_repeats(df, window=k).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(brute(rows, k), key=key)


@pytest.mark.parametrize("k", [7, 10, 13])
def test_random_passages(spark, k):
    rng = np.random.default_rng(k)
    vocab = [f"w{i}" for i in range(40)] + ["é" * 3, "x y", "longword" * 20]
    passages = [[vocab[j] for j in rng.integers(0, len(vocab), n)] for n in (k - 1, k, k + 1, 30, 60)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.integers(0, 5)):
            words += [vocab[j] for j in rng.integers(0, len(vocab), rng.integers(0, 25))]
            if rng.random() < 0.5:
                words += passages[rng.integers(0, len(passages))]
        rows.append((int(rng.integers(0, 50)), rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    compare(spark, rows, k)


def test_edges(spark):
    p = " ".join(f"p{i}" for i in range(13))
    rows = [(5, None), (6, ""), (7, " \t\n"), (None, p), (3, p), (3, p), (9, p + " tail"), (2, "head " + p), (11, p[:-1]), (12, " ".join(["a"] * 40)), (13, " ".join(["a"] * 41))]
    compare(spark, rows)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, b"x")], "doc_id long, text string, block_id long, payload binary")
    assert remove_repeats(df).count() == 1
    assert remove_repeats(df.limit(0)).count() == 0


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_defeat_polynomial_hashes(spark, n):
    one, other = thue_morse(n)
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}"), (4, " ".join(one)), (5, " ".join(other)), (6, "w" * 5000 + " " + tail), (7, "w" * 5001 + " " + tail)]
    compare(spark, rows)


def test_documents_of_several_hash_chunks(spark):
    rng = np.random.default_rng(8)
    long = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 60_000))  # about 470 KB
    rows = [(1, long), (2, "head " + long[200_000:]), (3, "x" * 300_000 + " " + long[:100]), (4, long[:300_000] + " tail")]
    compare(spark, rows)


def test_the_query_against_brute_force(spark, tmp_path):
    import hashlib

    import __spark_entry__

    p = " ".join(f"p{i}" for i in range(20))
    rows = [(5, None), (None, p), (3, p), (3, p), (9, p + " tail"), (2, ""), (4, " \t"), (8, "é " * 30), (7, "é " * 31)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_words string, n_removed int").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in __spark_entry__.queries()["op7_substring_dedup"](spark, str(tmp_path)).collect()]
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute(rows, 13)]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)
