import re

import numpy as np
import pytest

from millrace.llm.components import connected
from millrace.llm.jaccard import Bands, shingle_sets, similar_components


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                x = len(sets[i] & sets[j])
                if x * den >= num * (len(sets[i]) + len(sets[j]) - x):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), None if d is None else least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "num", "few"), [(3, 90, 100), (5, 80, 1), (2, 50, 100)])
def test_against_brute_force(spark, k, num, few, monkeypatch):
    monkeypatch.setattr("millrace.llm.jaccard.FEW_LINKS", few)
    monkeypatch.setattr("millrace.llm.jaccard.HOT", 4 if few == 1 else 32)
    monkeypatch.setattr("millrace.llm.jaccard.SIDE", 3 if few == 1 else 64)
    monkeypatch.setattr("millrace.llm.jaccard.TILE", 2000 if few == 1 else 1 << 20)
    rng = np.random.default_rng(num)
    vocab = np.array([f"Word{i}" if i % 3 else f"w{i}é" for i in range(400)])
    bases = [vocab[rng.integers(0, 400, rng.integers(1, 160))] for _ in range(25)] + [vocab[rng.integers(0, 400, 900)] for _ in range(3)]
    rows, d = [], 0
    for base in bases:
        for _ in range(rng.integers(1, 9)):
            w = base.copy()
            for _ in range(rng.integers(0, 1 + max(1, len(w) // (30 if num == 90 else 25)))):
                w[rng.integers(0, len(w))] = vocab[rng.integers(0, 400)]
            if rng.random() < 0.3:
                w = w[: len(w) - rng.integers(0, 1 + len(w) // 12)]
            rows.append((int(d), (" " if rng.random() < 0.8 else "\n").join(w)))
            d += 1 + int(rng.integers(0, 3))
    common = " ".join(vocab[:60])
    rows += [(d + i, common + " " + " ".join(vocab[rng.integers(0, 400, 20)])) for i in range(40)]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5003, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in similar_components(df, shingle=k, num=num).collect()]
    want = brute(rows, k, num, 100)
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[2] for r in want}) < len(want) - 10


def test_short_documents_with_a_hot_phrase(spark):
    rows = []
    for words, tail, phrase in ((10, 3, 6), (10, 4, 30), (9, 5, 29)):  # 9 or 10 shingles; 300 documents share a phrase
        common = [f"p{phrase}x{i}" for i in range(words)]
        for q in range(150):
            own = [f"u{q}y{j}" for j in range(tail)]
            rows += [(len(rows), " ".join(common + own)), (len(rows) + 1, " ".join([*common, *own[:-1], "z" + own[-1]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in similar_components(df, shingle=5, num=80).collect())
    assert got == sorted(brute(rows, 5, 80, 100))


def test_bands_cover_all_links():
    for num, den in ((90, 100), (80, 100), (50, 100)):
        bands = Bands(num, den)
        bands.upto(3000)
        edges = np.array(bands.edges)
        for n in range(1, 2000):
            m = n * den // num  # the largest set that a set of n can link with
            if n < edges[0]:
                assert m < n + 1 or n * den < (n + 1) * num or m == n
                continue
            band = int(np.searchsorted(edges, n, "right")) - 1
            assert np.searchsorted(edges, m, "right") - 1 <= band + 1
            blocks, agree = (x[0] for x in bands.blocks(np.array([band])))
            assert (n + m) * (den - num) // (den + num) <= blocks - agree and agree >= 3


def test_wide_parities_bound_the_difference():
    from millrace.llm.jaccard import differ_at_least, wide_parity

    rng = np.random.default_rng(0)
    for n, m in ((500, 500), (3000, 2500), (9000, 4000), (600, 500)):
        a = np.unique(rng.integers(0, 1 << 50, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 50, m, dtype=np.uint64)]))
        true = len(np.setxor1d(a, b))
        bound = differ_at_least(wide_parity(a), wide_parity(b))
        assert true / 2 <= bound <= true
        assert differ_at_least(wide_parity(a), wide_parity(a)) == 0


def test_shingles():
    import pyarrow as pa

    from millrace.llm.common import Hasher, text_buffers

    data, offsets = text_buffers(pa.array(["a b c d", "A  B\nc d", "a b", None, "b a", "a b c d a b c d"]))
    h, cut = shingle_sets(data, offsets, 3, Hasher(1, lower=True))
    assert np.diff(cut).tolist() == [2, 2, 1, 0, 1, 4]
    assert (h[cut[0] : cut[1]] == h[cut[1] : cut[2]]).all() and h[cut[2]] != h[cut[4]]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (300, 300)]
    edges = [edges[i][:: 1 if rng.random() < 0.5 else -1] for i in rng.permutation(len(edges))]
    for local in (0, 1000):  # distributed, and in one task
        got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long"), "a", "b", local_links=local).collect()))
        assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node long, sig long")
    assert similar_components(df).count() == 0


def test_tile_product():
    from millrace.llm.jaccard import tile_product

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    rows = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 400)), rng.integers(0, 2**64, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(40)] + [np.sort(base), base[:1]]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(len(rows))))
    for num in (30, 50, 80, 100):
        good, left_out = tile_product(rows, a, b, num, 100)
        both = np.array([len(np.intersect1d(rows[i], rows[j])) for i, j in zip(a, b, strict=True)])
        union = np.array([len(rows[i]) + len(rows[j]) for i, j in zip(a, b, strict=True)]) - both
        assert (good == (both * 100 >= union * num)).all()
        assert left_out > len(a)
    assert tile_product(rows, a[:0], b[:0], 80, 100)[0].shape == (0,)


def test_words_that_defeat_polynomial_hashes(spark):
    rows = []
    for n in (512, 1024, 4096):
        word = "a"
        while len(word) < n:
            word += word.translate(str.maketrans("ab", "ba"))
        rows += [word, word.translate(str.maketrans("ab", "ba")), " ".join(word), " ".join(word.translate(str.maketrans("ab", "ba"))), word.upper()]
    rows = list(enumerate(rows))
    got = sorted(tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, num=90).collect())
    assert got == sorted(brute(rows, 3, 90, 100))


def test_nodes_that_meet_are_renamed(spark, monkeypatch):
    from millrace.llm import jaccard

    real = jaccard.Sets._sums
    monkeypatch.setattr(jaccard.Sets, "_sums", staticmethod(lambda h, cut, odd: real(h, cut, odd) % 3 if odd == 3 else real(h, cut, odd)))
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30 + i % 2))) for i in range(20)]
    got = sorted(tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), num=90).collect())
    assert got == sorted(brute(rows, 5, 90, 100))


def test_repeated_ids_with_different_texts(spark):
    one, other = (" ".join(f"{c}{j}" for j in range(40)) for c in "ab")
    rows = [(1, one), (1, other), (2, one + " tail"), (3, other + " tail"), (4, one), (4, one), (None, one)]
    got = sorted((tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()), key=str)
    assert got == sorted(brute(rows, 5, 80, 100), key=str)


def test_long_documents(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 45_000)]  # about 350 KB, more than one hash chunk
    near = base.copy()
    for i in rng.integers(0, len(near), 300):
        near[i] = "changed"
    rows = [(7, " ".join(base)), (3, " ".join(near)), (9, " ".join(base[:30_000])), (4, "x" * 300_000), (5, "x" * 300_001)]
    got = sorted(tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, num=90).collect())
    assert got == sorted(brute(rows, 3, 90, 100))
    assert [r[2] for r in got] == [3, 4, 5, 3, 9]


def test_the_query_against_brute_force(spark, tmp_path):
    import __spark_entry__

    rng = np.random.default_rng(12)
    base = [" ".join(f"W{i}" for i in rng.integers(0, 300, 60)) for _ in range(10)]
    rows = [(int(i), base[i % 10] + (" tail" * int(rng.integers(0, 3)))) for i in rng.permutation(80)] + [(100, None), (101, ""), (None, base[0]), (102, "a b"), (103, "A b"), (102, "a b")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in __spark_entry__.queries()["op8_jaccard_join"](spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 3, 90, 100), key=str)


def near_copies(rng, n):
    """A text of 150 words, n copies with 2 to 6 words changed, and some of these with one more changed."""
    base = [f"w{i}" for i in range(150)]
    made = [base]
    for i in range(n):
        w = list(made[int(rng.integers(1, len(made)))] if i > 20 and rng.random() < 0.15 else base)
        for _ in range(1 if w != base else rng.integers(2, 7)):
            w[rng.integers(0, 150)] = f"x{rng.integers(0, 10**6)}"
        made.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(made)]


@pytest.mark.parametrize("refine", [4, 1, 0])
def test_a_large_group_of_near_copies(spark, monkeypatch, refine):
    from millrace.llm import jaccard

    opened = []
    real = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: (opened if name == "jaccard-open" else []).append(t := real(df, name)) or t)
    monkeypatch.setattr(jaccard, "SIDE", 8)
    monkeypatch.setattr(jaccard, "REFINE", refine, raising=False)
    rows = near_copies(np.random.default_rng(7), 400)
    got = sorted(tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, num=90).collect())
    want = sorted(brute(rows, 3, 90, 100))
    assert got == want and 100 < len({r[2] for r in want}) < 395
    if refine == 4:  # a member of a signature goes to a bounded number of squares' sides
        count, sides = opened[-1].selectExpr("count(1)", "sum(ceil(members / 8))").first()
        assert sides < 4 * count


def test_first_differences_meet():
    from millrace.llm.jaccard import first_differences

    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    for num in (50, 80, 90):
        rows = [np.unique(base)]
        for _ in range(150):
            kept = rng.choice(rows[int(rng.integers(0, len(rows)))], 200 - int(rng.integers(0, 60)))
            rows.append(np.unique(np.concatenate([kept, base[: int(rng.integers(1, 200))], rng.integers(0, 2**64, int(rng.integers(0, 12)), dtype=np.uint64)])))
        linked = lambda x, y: len(np.intersect1d(x, y)) * 100 >= num * len(np.union1d(x, y))
        often = np.stack([np.sort(base), rng.integers(2, 9, 200, dtype=np.uint64)])
        center = rows[1]
        first = [first_differences(x, center, often, num, 100) for x in rows]
        found = 0
        for i, x in enumerate(rows):
            for j, y in enumerate(rows[:i]):
                if linked(x, y) and not (linked(x, center) and linked(y, center)):
                    (a, enough, n), (b, _, m) = (first[k] for k in ((i, j) if first[i][2] <= first[j][2] else (j, i)))
                    assert n <= m and len(np.intersect1d(a[:enough], b))
                    found += 1
        assert found > 20
