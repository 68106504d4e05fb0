import numpy as np
import pytest

from millrace.llm.sentencepiece_viterbi import BYTE, MARK, NORMAL, Model, decode_column, default_model, encode_column

TINY = [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)] + [(p, s, NORMAL) for p, s in ((MARK, -3.0), ("a", -4.0), ("b", -4.5), ("ab", -6.0), (MARK + "a", -5.5), ("ba", -7.0), ("bab", -9.0), ("c", -2.0), (MARK + "abc", -9.0), ("é", -6.0))]


def brute(m: Model, word: str):
    """Best (score, ids) over all segmentations; ties to the longest last piece, and so on to the front."""
    by = {t: (s, i) for i, (t, s, k) in enumerate(m.pieces) if k == NORMAL}
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        top = None
        for start in range(end):
            piece = word[start:end]
            if piece in by:
                s, ids = by[piece][0], [by[piece][1]]
            elif end - start == 1:
                s, ids = m.unknown_score, [m.byte_id[b] for b in piece.encode()]
            else:
                continue
            if top is None or best[start][0] + s > top[0]:
                top = (best[start][0] + s, best[start][1] + ids)
        best[end] = top
    return best[len(word)]


def test_against_brute_force():
    m = Model(pieces=TINY)
    rng = np.random.default_rng(2)
    words = sorted({MARK + "".join(rng.choice(list("abcéx"), rng.integers(0, 9))) for _ in range(800)})
    got = m.segment(words)
    for w in words:
        assert list(got[w]) == brute(m, w)[1], w
    texts = [" ".join("".join(rng.choice(list("abc x\né"), rng.integers(0, 12))) for _ in range(rng.integers(0, 5))) for _ in range(200)]
    for t in texts:
        marked = (MARK + t.replace(" ", MARK)) if t else ""
        assert m.encode(t) == (brute(m, marked)[1] if t else [])
        assert m.decode(m.encode(t)).decode() == t


def test_public_model_round_trip_and_score():
    import sentencepiece

    m = Model(default_model())
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    rng = np.random.default_rng(5)
    chars = list("etaoinshrdlu ETAOIN.,\n  é ñß漢字🙂\t0123")
    texts = ["", " ", "  a", "a  ", "\n", MARK, f" {MARK}{MARK}x{MARK} ", f"a{MARK}b c", "the quick  brown\n\nfox", "naïve façade – 漢字 🙂"] + ["".join(rng.choice(chars, 60)) for _ in range(200)]
    score = {i: s for i, (_, s, _) in enumerate(m.pieces)}
    for t in texts:
        ids = m.encode(t)
        assert m.decode(ids).decode() == t
        if MARK in t:
            continue
        merged = lib.encode(t)
        if not any(m.pieces[i][2] == BYTE for i in ids + merged):
            assert sum(score[i] for i in ids) >= sum(score[i] for i in merged)


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x\ty  z\n"), (4, "long " * 20000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, ids string")
    out = decode_column(encode_column(df, ["doc_id"]), ["doc_id", "n_tokens"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t or "") for i, t in rows)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert encode_column(df.limit(0), ["doc_id"]).count() == 0


def test_pieces_with_inner_marks_are_refused():
    with pytest.raises(ValueError, match="inside"):
        Model(pieces=[*TINY, ("a" + MARK + "b", -1.0, NORMAL)])


def test_long_words_are_segmented_alike(monkeypatch):
    rng = np.random.default_rng(11)
    words = sorted({MARK + "".join(rng.choice(list("abcéx"), rng.integers(0, 40))) for _ in range(200)})
    m = Model(pieces=TINY)
    for w in words:
        assert list(m.segment_long(w)) == list(m.segment([w])[w]) == brute(m, w)[1]
    public = Model(default_model())
    text = "".join(rng.choice(list("etaoinshrdlu漢é"), 30_000))
    ids = public.encode(text)
    assert public.decode(ids).decode() == text
    monkeypatch.setattr("millrace.llm.sentencepiece_viterbi.LONG", 1 << 30)
    assert Model(default_model()).encode(text) == ids


def test_memory_of_a_text_without_spaces():
    import tracemalloc

    m = Model(default_model())
    word = "etaoinshrdlu" * 20_000
    tracemalloc.start()
    m.encode(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(word), peak


def test_cache_stays_within_its_bound(monkeypatch):
    from millrace.llm import sentencepiece_viterbi as s

    monkeypatch.setattr(s, "CACHE_WORDS", 50)
    m = Model(pieces=TINY)
    words = sorted({"".join(w) for w in np.random.default_rng(8).choice(list("abcé"), (400, 6))})
    texts = [" ".join(words), " ".join(words[::2]), "a" + MARK + "b", ""]  # half of the words stand once
    for _ in range(3):
        ids, ends = m.encode_batch(texts)
        assert len(m.cache) == 50
        assert not {MARK + w for w in words[1::2]} & m.cache.keys()
        for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
            assert ids[a:b].tolist() == Model(pieces=TINY).encode(t)
