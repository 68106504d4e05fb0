"""Operators 2, 3, 4 and 6 against brute force on small tables."""

import gzip
import hashlib
import math

import numpy as np
import pytest

from millrace.llm import mixing, preferences, warc
from millrace.llm.ann import nearest

# ------------------------------------------------------------------ 2


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("http://www.A.example.com:80/P/q?x=1#f") == "com,example,a)/p/q?x=1"
    assert warc.url_key("https://b.org:8080") == "org,b:8080)/"
    assert warc.url_key("") == ")/" and warc.url_key("http://[bad") == "http://[bad"


def test_warc_round_trip(spark):
    big, same = "x" * 1500, "y" * 1000
    rows = [(1, "http://b.com/", big), (2, "http://a.com/", big), (9, "http://a.com/", big), (3, None, None), (4, "u\r\nv", "é" * 400), (5, "http://a.com/z", "é" * 400), (None, "http://c.com", big), (9, "http://a.com/", big), (7, "x", same), (8, "x", same), (10, "x", same[:-1]), (11, "x", same[:-1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages)
    out = warc.merge_index(warc.read_captures(archives)).collect()
    assert len(out) == len(rows)
    for r in out:
        html = next(h for i, u, h in rows if i == r.page_id) or ""
        b = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        group = [i for i, _, h in rows if (h or "") == html and i is not None]
        revisit = len(b) >= 1000 and r.page_id is not None and r.page_id < max(group)
        assert (r.record_type, r.refers_to) == (("revisit", max(group)) if revisit else ("response", None))
    ordered = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in sorted(out, key=lambda r: (r.range_no, r.position))]
    assert ordered == sorted(ordered)
    name = archives.first()["archive"]
    data = warc.archive_bytes(archives, name)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == sum(r.archive == name for r in out)
    one = next(r for r in out if r.archive == name)
    assert gzip.decompress(data[one.offset : one.offset + one.length]).startswith(b"WARC/1.1")
    assert warc.merge_index(warc.read_captures(warc.write_archives(pages.limit(0)))).count() == 0


def test_the_warc_query_over_several_segments(spark, tmp_path, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(warc, "SEGMENT_BYTES", 3000)
    monkeypatch.setattr(warc, "FEED", 100)
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(int(i), f"http://h{i % 5}.com/{i % 3}", "".join(rng.choice(list("ab <p>é"), 900 + 40 * (i % 8))) if i % 4 else "same" * 300) for i in rng.permutation(90)]
    rows += [(500, None, None), (501, "", ""), (None, None, "same" * 300), (7, "http://h.com", "same" * 300), (600, "x", "é" * (1 << 20))]
    spark.createDataFrame([(*r, "z", 3) for r in rows], "page_id long, url string, html string, digest string, payload int").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    out = __spark_entry__.queries()["op2_warc_index"](spark, str(tmp_path)).collect()
    sums = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            sums[b] = max(sums.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = sums.get(b) if i is not None else None
        revisit = top is not None and i < top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == sorted(want, key=str)
    assert len({r.archive for r in out}) > 5 and len({r.range_no for r in out}) > 3
    ordered = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in sorted(out, key=lambda r: (r.range_no, r.position))]
    assert ordered == sorted(ordered)


# ------------------------------------------------------------------ 3


def _count(seed, key, rate):
    parts = max(1, math.ceil(rate / 16))
    total = 0
    for p in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{key}:{p}".encode()).hexdigest()[:13], 16) / 2**52
        term = cdf = math.exp(-rate / parts)
        k = 0
        while cdf <= u and k < 80:
            k += 1
            term = term * (rate / parts) / k
            cdf += term
        total += k
    return total


@pytest.mark.parametrize(("weights", "epochs"), [(None, 1.0), ({"a": 3, "b": 1}, 2.0), ({"a": 1, "c": 30}, 40.0), ({}, 1.0)])
def test_mixing(spark, weights, epochs):
    rows = [(i, f"t{i}", ["a", "b", "c", None][0 if i % 3 == 0 else i % 4], 5) for i in range(400)] + [(None, "n", "a", 1), (3, None, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, parts int")
    src = [r[2] or "" for r in rows]
    n = {s: src.count(s) for s in set(src)}
    w = {s: math.sqrt(n[s]) if weights is None else float(weights.get(s, 0)) for s in n}
    total = sum(w.values())
    want = []
    for r, s in zip(rows, src, strict=True):
        rate = epochs * len(rows) * w[s] / (total * n[s]) if total else 0.0
        want += [(r, c) for c in range(1, _count(17, "null" if r[0] is None else r[0], rate) + 1)]
    for cap in (10_000, 0):  # broadcast and shuffled rates
        got = mixing.replicate(df, weights=weights, epochs=epochs, max_broadcast=cap).collect()
        assert sorted(map(str, (((r.doc_id, r.text, r.source, r.parts), r._copy) for r in got))) == sorted(map(str, want))
    if total:
        assert abs(len(want) - epochs * len(rows)) < 6 * math.sqrt(epochs * len(rows)) * 3


def test_mixing_keeps_columns_of_any_name(spark):
    taken = ["_source", "parts", "cdf", "_u", "_n", "u", "times", "row", "copy", "order_key", "n", "w", "rate", "all_n", "a.b"]
    rows = [(i, "ab"[i % 2], *range(len(taken))) for i in range(60)]
    df = spark.createDataFrame(rows, ["doc_id", "source", *taken])
    got = mixing.replicate(df).collect()
    assert got[0].__fields__ == ["doc_id", "source", *taken, "_copy", "_order_key"]
    assert got and all(tuple(r)[2:-2] == tuple(range(len(taken))) for r in got)
    plain = mixing.replicate(df.select("doc_id", "source")).collect()
    assert sorted((r.doc_id, r._copy) for r in got) == sorted((r.doc_id, r._copy) for r in plain)
    with pytest.raises(ValueError, match="other names"):
        mixing.replicate(df, copy_col="copy")
    assert mixing.replicate(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 4


def format_brute(chosen, rejected):
    """{(pair, chunk): (prompt, chosen, spans, rejected, spans)} of {pair: {turn: (role, text)}} of both sides."""
    safe = lambda x: x.replace("<|", "<\\|")
    out = {}
    for pair in chosen.keys() | rejected.keys():
        c, r = chosen.get(pair, {}), rejected.get(pair, {})
        turns = sorted(c.keys() | r.keys())
        split = next((t for t in turns if c.get(t) != r.get(t)), None)
        for t in turns:
            row = out.setdefault((pair, t // preferences.TURNS), [["", []] for _ in range(3)])
            shared = split is None or t < split
            for at, side in ((0, c),) if shared else ((1, c), (2, r)):
                if t in side:
                    role, text = side[t]
                    piece = f"<|{safe(role)}|>\n{safe(text)}<|end|>\n"
                    begin = len(row[at][0])
                    row[at][0] += piece
                    if at and role == "assistant":
                        row[at][1].append(f"{begin}:{begin + len(piece)}")
    return sorted((*k, p[0], c[0], ",".join(c[1]), r[0], ",".join(r[1])) for k, (p, c, r) in out.items())


def test_preferences(spark):
    turns = "pair_id long, turn long, t struct<role: string, text: string>"
    chosen = {1: {0: ("user", "q"), 1: ("assistant", "a<|end|>"), 2: ("user", "r")}, 2: {0: ("user", "s")}, 3: {0: ("user", "x"), 1: ("assistant", "same")}, 5: {t: ("assistant" if t % 2 else "user", f"t{t}") for t in range(200)}}
    rejected = {1: {0: ("user", "q"), 1: ("assistant", "b"), 2: ("user", "r")}, 3: {0: ("user", "x"), 1: ("assistant", "same")}, 4: {7: ("assistant", "")}, 5: {t: ("assistant" if t % 2 else "user", f"t{t}" if t != 99 else "é<|x") for t in range(0, 200)}}
    frame = lambda side: spark.createDataFrame([(p, t, x) for p, ts in side.items() for t, x in ts.items()], turns)
    got = sorted(tuple(r) for r in preferences.format_preferences(preferences.pair_turns(frame(chosen), frame(rejected))).collect())
    assert got == format_brute(chosen, rejected)
    assert got[0][2:] == ("<|user|>\nq<|end|>\n", "<|assistant|>\na<\\|end|><|end|>\n<|user|>\nr<|end|>\n", "0:31", "<|assistant|>\nb<|end|>\n<|user|>\nr<|end|>\n", "0:23")


def test_the_preference_query(spark, tmp_path):
    import __spark_entry__

    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 2, None, "z"), (1, 3, "assistant", "b"), (1, 4, "user", "after"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "user", "only"), (4, 0, "assistant", "hi"), (1, 3, "assistant", "c")]
    rows += [(9, t, "assistant" if t % 3 else "user", f"<|t{t % 5}") for t in range(150)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, pair_id int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    chosen = {}
    for i, t, role, x in sorted(rows, key=lambda r: ((r[2] or ""), (r[3] or "")), reverse=True):
        if i is not None and t is not None:
            chosen.setdefault(i, {})[t] = (role or "", x or "")
    rejected = {}
    for i, turns in chosen.items():
        replies = sorted(t for t, x in turns.items() if x[0] == "assistant")
        rejected[i] = dict(turns)
        if replies:
            rejected[i][replies[-1]] = ("assistant", turns[replies[0]][1] if len(replies) > 1 else "")
    got = sorted(tuple(r) for r in __spark_entry__.queries()["op4_preference_format"](spark, str(tmp_path)).collect())
    assert got == format_brute(chosen, rejected)
    assert preferences.format_preferences(preferences.stale_reply_turns(preferences.clean_turns(df.limit(0)))).count() == 0


# ------------------------------------------------------------------ 6


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    best = {}
    for i, v in zip(ids, d, strict=True):
        if i != ids[q]:
            best[i] = min(best.get(i, np.inf), v)
    return sorted((v, i) for i, v in best.items())[:k]


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    x = np.concatenate([centers[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.6, np.tile(centers[:1], (600, 1))]).astype(np.float32)
    ids = rng.permutation(len(x)).astype(int)
    rows = [(int(i), [float(e) for e in v], 0) for i, v in zip(ids, x, strict=True)]
    bad = [(100_000, None, 1), (100_100, [0.0] * 16, 1), (100_200, [float("nan")] + [1.0] * 15, 1), (100_300, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (100_400, [], 1), (100_500, [1.0, 2.0], 1), (100_600, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in nearest(df, query_mod=50, list_size=64, probes=24).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    x64 = x.astype(np.float64)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        want = brute(ids, x64, at, 10)
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11)) and [(f[1], f[2]) for f in found] == sorted((f[1], f[2]) for f in found)
        hits += len({f[2] for f in found} & {i for _, i in want})
        for _, score, v in found:
            assert abs(score - np.sqrt(((x64[ids == v][0] - x64[at]) ** 2).sum())) < 1e-12
    assert hits >= 0.9 * 10 * len(got)


def test_ann_opens_more_of_more_lists():
    from millrace.llm import ann

    rng = np.random.default_rng(2)
    c = rng.normal(size=(8192, 64)).astype(np.float32)
    for n in (2000, 4000, 8192):  # production: probes 48, ratio 1.35
        x = np.concatenate([rng.normal(size=(20, 64)), c[:1]])  # the last one is a centroid: no other is within a ratio of 0
        row, lists = ann.lists_to_open(c[:n], np.full(n, 256), x, 10, 48, 1.35)
        opened, most = np.bincount(row, minlength=21), min(n, max(48, -(-n // 48)))
        assert (opened[:20] == most).all() and most >= n / 48 and opened[20] >= most // 2
        nearest_lists = np.argsort(((c[:n] - x[3]) ** 2).sum(1))[:most]
        assert set(lists[row == 3].tolist()) == set(nearest_lists.tolist())


def test_ann_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest(df).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("copies", [3, 40])
def test_ann_repeated_ids_do_not_use_up_the_answers(spark, copies):
    rng = np.random.default_rng(copies)
    x = rng.normal(size=(40, 4)).round(1)
    x[20:30] = x[5]  # ties around the tenth place
    rows = [(i, x[i].tolist()) for i in range(40) for _ in range(copies)] + [(7, rng.normal(size=4).tolist()), (0, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = nearest(df).collect()
    ids, every = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert {r.query_id for r in got} == {0}
    best = {}
    for at in np.flatnonzero(ids == 0):
        for v, i in brute(ids, every, at, 40):
            best[i] = min(best.get(i, np.inf), v)
    want = sorted((v, i) for i, v in best.items())[:10]
    assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == want
