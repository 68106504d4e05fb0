import re

import numpy as np

from millrace.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_plain_regexes():
    rng = np.random.default_rng(3)
    parts = ["a", "Z", "é", "@", ".", "..", "-", "+", " ", "\n", "(", ")", "1", "25", "255", "256", "0", "4556737586899855", "4111 1111 1111 1111", "x@y.z", "a.b@c-d.e.f", "+1 (456) 555-2186", "1.2.3.4", "300.1.1.1", "%", "_", "٣"]
    for _ in range(4000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 18)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_stay_linear():
    for text in ("1" * 200_000 + "...", "a" * 200_000, "1." * 100_000, "+" * 100_000, "1 " * 100_000, "@" * 100_000):
        pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger(hidden=3, embed=4)
    x = rng.integers(0, pii.CLASSES, (4, 7)).astype(np.uint8)
    y = np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 7, 8, 8, 0], [1, 1, 2, 0, 0, 0, 0]], np.int8)
    _, grads = tagger.loss_and_grads(x, y)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    for k in ("emb", "wf", "ub", "cf", "out", "out_b", "trans"):
        flat = np.abs(grads[k]).argmax()
        at = np.unravel_index(flat, grads[k].shape)
        keep = tagger.p[k][at]
        ends = []
        for step in (1e-3, -1e-3):
            tagger.p[k][at] = keep + step
            ends.append(tagger.loss_and_grads(x, y)[0])
        tagger.p[k][at] = keep
        slope = (ends[0] - ends[1]) / 2e-3
        assert abs(slope - grads[k][at]) < 1e-2 * max(1, abs(slope)), k


def test_viterbi_is_best_path():
    from itertools import product

    tagger = pii.Tagger(hidden=3, embed=4)
    x = np.random.default_rng(1).integers(0, pii.CLASSES, (3, 4)).astype(np.uint8)
    e = tagger.emissions(x)[0]
    move = tagger.p["trans"] + tagger.ban
    for i, got in enumerate(tagger.viterbi(x)):
        score = lambda path: tagger.start_ban[path[0]] + sum(e[t, i, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(product(range(pii.TAGS), repeat=4), key=score)
        assert abs(score(best) - score(tuple(got))) < 1e-4


def test_held_out_accuracy():
    _, x, y = pii.make_examples(400, seed=99)
    tags = pii.trained().viterbi(x)
    want = {(i, *s) for i, t in enumerate(y) for s in pii.spans_of(t)}
    got = {(i, *s) for i, t in enumerate(tags) for s in pii.spans_of(t)}
    precision, recall = len(want & got) / len(got), len(want & got) / len(want)
    assert precision > 0.85 and recall > 0.85, (precision, recall)


def spans_from(text, tags):
    """Spans of given tags, by the rules of find_spans."""
    keep, pii.tag_texts = pii.tag_texts, lambda tagger, texts: [tags]
    try:
        return pii.find_spans(None, [text])[0]
    finally:
        pii.tag_texts = keep


def random_text(rng, n):
    parts = ["hand ", "the ", "ontion ", ", ", "\n", " ", "(456) 555-2186 ", "+1 (456) 555-2186", "name.of@mail.example.com ", "4556 7375 8689 9855", "1.2.3.4", "@", "x@y", "12", "é", "long.name_" * 12, "7" * 30, "- ", "()", "a"]
    return "".join(parts[i] for i in rng.integers(0, len(parts), n))


def test_skipped_windows_change_nothing():
    rng = np.random.default_rng(17)
    tagger = pii.trained()
    texts = [random_text(rng, int(n)) for n in rng.integers(0, 60, 150)] + [random_text(rng, 3000), "", "1", "@", "x" * 500 + "@b.c"]
    searched = pii.tag_texts(tagger, texts)
    added = 0
    for text, tags in zip(texts, searched, strict=True):
        whole = pii.tag_whole(tagger, text)
        x = pii.classes(text)
        assert not whole[~pii.inside(x)].any()
        want, got = spans_from(text, whole), spans_from(text, tags)
        assert want == got
        added += len(got[1])
    assert added > 50


def test_a_long_local_part_is_found_whole():
    name = "alexander.longname.more.and.more.of.it.that.goes.on.and.on.and.is.not.done.still@corp"
    for before in range(0, 100, 9):
        text = "x" * before + " please write to " + name + " for information"
        base, added = pii.find_spans(pii.trained(), [text])[0]
        at = text.index(name)
        assert not base
        assert all(s == at for s, _, _ in added)
        tags = pii.tag_whole(pii.trained(), text)
        assert spans_from(text, tags)[1] == added


def test_weights_add_up_and_borders_do_not_matter():
    total = pii._WEIGHT[: pii.STRIDE] + pii._WEIGHT[pii.STRIDE :]
    assert np.allclose(total, 1)
    text = "hand the ontion " * 5 + "(456) 555-2186" + " that the inthe" * 6
    for pad in range(0, 100, 7):  # wherever the borders fall
        shifted = "x" * pad + " " + text
        base, added = pii.find_spans(pii.trained(), [shifted])[0]
        at = shifted.index("(456)")
        assert base == [] and added == [(at, 3, at + 14)], (pad, added)


def test_pieces_are_decoded_as_one_by_one():
    rng = np.random.default_rng(2)
    tagger = pii.trained()
    lens = rng.integers(1, 40, 30)
    e = rng.normal(size=(int(lens.sum()), pii.TAGS)).astype(np.float32) * 3
    starts = np.cumsum(lens) - lens
    every = tagger.decode(e, starts, lens)
    for s, n in zip(starts, lens, strict=True):
        assert (every[s : s + n] == tagger.decode(e[s : s + n], np.array([0]), np.array([n]))).all()


def test_the_query_against_plain_regexes(spark, tmp_path):
    import hashlib

    import __spark_entry__

    rng = np.random.default_rng(9)
    rows = [(i, random_text(rng, int(rng.integers(0, 50)))) for i in range(120)] + [(3, None), (None, "1.2.3.4 a@b.c"), (3, ""), (3, "")]
    spark.createDataFrame([(*r, "s", 2) for r in rows], "doc_id long, text string, spans string, n_email int").write.parquet(str(tmp_path / "documents.parquet"))
    got = __spark_entry__.queries()["op10_pii"](spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        found = plain(t or "")
        shown = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)
        want.append((d, *(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(shown.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        base = {r.n_email + r.n_ip + r.n_card + r.n_phone}
        assert len([x for x in r.spans.split(",") if x]) == base.pop() + r.n_added


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "mail bo.x@mail8.example.com or +1 (456) 555-2186"), (3, "ip 1.2.3.4, card 4556737586899855"), (None, "no data " * 3000), (5, "é@é " * 50)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int")
    out = pii.detect(df, ["doc_id"]).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.base_spans): r for r in out}
    r = by[(3, "email:5:27,phone:31:48")]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 0, 1) and r.redacted == "mail <EMAIL> or <PHONE>"
    r = by[(3, "ip:3:10,card:17:33")]
    assert r.redacted == "ip <IP>, card <CARD>"
    assert all(x.spans == "" for x in out if x.doc_id != 3)
    assert pii.detect(df.limit(0), ["doc_id"]).count() == 0
