import hashlib
import zlib

import numpy as np
import pytest

from millrace.llm import webp, webp_batch
from millrace.llm.media import media_column, pad, round_trips

RNG = np.random.default_rng(7)


def noise(h, w, colours=None):
    if colours:
        return RNG.integers(0, 256, (colours, 4), dtype=np.uint8)[RNG.integers(0, colours, (h, w))]
    return RNG.integers(0, 256, (h, w, 4), dtype=np.uint8)


@pytest.mark.parametrize("mode", ["flat", "lz", "predictor", "cross", "green"])
@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (40, 37), (17, 64)])
def test_round_trip_modes(mode, shape):
    for colours in (None, 1, 2, 5, 200):
        image = noise(*shape, colours)
        assert (webp.decode(webp.encode(image, mode, bits=2)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palette(colours):
    image = noise(33, 29, colours)
    assert (webp.decode(webp.encode(image, "palette")) == image).all()


def test_long_matches_and_cache():
    row = np.tile(noise(1, 12), (1, 400, 1))
    image = np.concatenate([row, row[:, ::-1]] * 3)
    data = webp.encode(image, "lz", cache_bits=3)
    assert len(data) < image.nbytes // 20 and (webp.decode(data) == image).all()


def test_meta_groups_and_all_predictors():
    """A hand-made stream with two prefix groups chosen by a meta image."""
    w = webp.Writer()
    for v, n in ((0x2F, 8), (7, 14), (3, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        w.write(v, n)  # 8 x 4, no transform, no cache, meta image with 4-pixel blocks
    webp.encode_image(w, np.array([0xFF000000, 0xFF000100], np.uint32), False)
    for green in (10, 20):
        for s in (green, 1, 2, 255, 0):
            lengths = np.zeros(280, np.uint8)
            lengths[s] = 1
            webp.write_code(w, lengths)
    body = w.bytes()
    import struct

    data = b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
    out = webp.decode(data)
    assert (out[:, :4] == [1, 10, 2, 255]).all() and (out[:, 4:] == [1, 20, 2, 255]).all()


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


def test_bad_streams():
    good = webp.encode(noise(8, 8))
    for bad in (b"", b"x" + good[1:]):
        with pytest.raises(ValueError, match="not a lossless"):
            webp.decode(bad)
    with pytest.raises((ValueError, IndexError)):
        webp.decode(good[:30])
    stored = webp_batch.store([pad(prose(300))])[0]
    with pytest.raises(ValueError, match="not a lossless"):
        webp_batch.images([stored[:-20]])
    with pytest.raises(ValueError, match="truncated|incomplete|code lengths|cache|reference"):
        webp_batch.decode_bodies([stored[20:200]])


TEXTS = [b"", b"a", b"ab\n" * 900, bytes(range(1, 128)) * 30, "Ünï漢🙂 ".encode() * 200, b"the same line again and again\n" * 400]


def prose(n):
    words = ["the", "and", "tion", "er", "on", "12.5", "é", "Apache", "License,"]
    return " ".join(words[i] for i in RNG.integers(0, len(words), n)).encode()


def test_payloads_come_back_through_both_readers():
    texts = [*TEXTS, *(prose(int(n)) for n in RNG.integers(0, 900, 60)), bytes(RNG.integers(0, 256, 30_000, dtype=np.uint8)), prose(60_000)]
    payloads = [pad(t) for t in texts]
    stored = webp_batch.store(payloads)
    for payload, media, images in zip(payloads, stored, webp_batch.images(stored), strict=True):
        assert b"".join(x.tobytes() for x in images) == payload
        assert b"".join(x.tobytes() for x in webp.images(media)) == payload
    for i in RNG.permutation(len(texts))[:12].tolist():  # a text's file does not depend on its batch
        assert webp_batch.store([payloads[i]]) == [stored[i]]


@pytest.mark.parametrize("mode", ["flat", "lz", "predictor", "cross", "green"])
def test_batch_reader_takes_other_streams(mode):
    images = [noise(int(h), 48, c) for h, c in zip(RNG.integers(1, 40, 12), (None, 1, 2, 5, 200, 3) * 2, strict=True)]
    bodies = [webp.encode(x, mode, bits=3)[20:] for x in images]
    for want, got in zip(images, webp_batch.decode_bodies(bodies), strict=True):
        assert (want == got).all()


def test_code_lengths_are_complete_and_near_the_entropy():
    counts = RNG.integers(0, 50, (200, 64)) * (RNG.random((200, 64)) < 0.4) * np.where(RNG.random((200, 64)) < 0.1, 60, 1)
    lengths = webp_batch.code_lengths(counts).astype(int)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= 15
    for c, ls in zip(counts, lengths, strict=True):
        used = c > 0
        if used.sum() > 1:
            assert (2.0 ** -ls[used]).sum() == 1
            best = webp.lengths_of(c).astype(int)
            assert (c * ls).sum() <= 1.15 * (c * best).sum()


def test_all_parts_of_the_format_are_used_on_documents():
    """Each coding acts on texts of the documents table, as chosen from their pixels."""
    import pyarrow.parquet as pq

    texts = [(t or "").encode() for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    seen = {"palette": 0, "predictor": 0, "cross": 0, "copy": 0, "cached": 0, "literal": 0, "long codes": 0}
    for text in texts:
        payload = np.frombuffer(pad(text), np.uint8).reshape(-1, 4)[: webp_batch.ROWS * 48]
        if len(np.unique(payload, axis=0)) <= webp_batch.COLOURS:
            seen["palette"] += 1
            continue
        lay = webp_batch.Layout(np.array([len(payload) // 48]))
        rest, modes = webp_batch.choose_predictors(payload, lay)
        rest, factors = webp_batch.choose_cross_colour(rest, lay)
        px = rest[:, [2, 1, 0, 3]].copy().view(np.uint32).ravel()
        _, kinds, _, _ = webp_batch.tokens(px, lay)
        seen["predictor"] += bool((modes > 0).any())
        seen["cross"] += bool(factors.any())
        seen["literal"] += bool((kinds == 0).any())
        seen["cached"] += bool((kinds == 1).any())
        seen["copy"] += bool((kinds == 2).any())
        lengths = webp_batch.code_lengths(np.bincount(px >> np.uint32(8) & np.uint32(255), minlength=256)[None])
        seen["long codes"] += len(np.unique(lengths)) > 2
    print(seen)
    assert all(n > 0 for n in seen.values()), seen
    assert seen["long codes"] >= 0.9 * len(texts)


def test_bit_fields_of_up_to_64_bits():
    f, want = webp_batch.Fields(5), [""] * 5
    for _ in range(4):
        image = np.sort(RNG.integers(0, 5, 200))
        bits = RNG.integers(0, 65, 200)
        value = np.array([int(RNG.integers(0, 2**64, dtype=np.uint64)) & (1 << int(b)) - 1 for b in bits], np.uint64)
        f.add(image, value, bits)
        for i, v, b in zip(image.tolist(), value.tolist(), bits.tolist(), strict=True):
            want[i] += format(v, f"0{b}b")[::-1] if b else ""
    for bits, body in zip(want, f.bytes(), strict=True):
        got = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")
        assert len(body) == -(-len(bits) // 16) * 2 and got[: len(bits)].tolist() == [int(b) for b in bits] and not got[len(bits) :].any()


def test_work_arrays_do_not_grow_with_the_step():
    """Choosing modes and multipliers holds little beside its results, so that it runs in a core's cache (before: 78 bytes a pixel)."""
    import tracemalloc

    pixels = np.frombuffer(prose(400_000)[: 192 * 32 * 200], np.uint8).reshape(-1, 4)
    lay = webp_batch.Layout(np.full(200, 32))
    for choose in (webp_batch.choose_predictors, webp_batch.choose_cross_colour):
        tracemalloc.start()
        choose(pixels, lay)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24 * len(pixels), (choose.__name__, peak / len(pixels))


def test_choices_do_not_depend_on_the_parts(monkeypatch):
    payloads = [pad(t) for t in (*TEXTS, prose(4000), *(prose(int(n)) for n in RNG.integers(0, 900, 30)))]
    whole = webp_batch.store(payloads)
    for pixels in (1, 5_000, 1 << 24):
        monkeypatch.setattr(webp_batch, "PART_PIXELS", pixels)
        monkeypatch.setattr(webp_batch, "WRITE_PIXELS", pixels)
        assert webp_batch.store(payloads) == whole


def test_batch_reader_takes_codes_longer_than_one_word():
    """Codes of up to 15 bits in all four channels: 60 bits a pixel, beside images with short codes."""
    steep = np.repeat(np.arange(16), np.r_[1, 2 ** np.arange(15)])  # shares 1/2, 1/4, ...
    images = [np.stack([RNG.permutation(steep) for _ in range(4)], axis=1)[: 48 * 682].astype(np.uint8).reshape(-1, 48, 4), noise(30, 48, 3), noise(5, 48)]
    assert all(webp.lengths_of(np.bincount(images[0][..., k].ravel())).max() > 12 for k in range(4))
    bodies = [webp.encode(x, "flat")[20:] for x in images]
    for want, got in zip(images, webp_batch.decode_bodies(bodies), strict=True):
        assert (want == got).all()


def test_long_payloads_are_several_images(monkeypatch):
    text = bytes(RNG.integers(32, 127, 192 * 500 + 5, dtype=np.uint8))
    whole = round_trips([text, b"x"])
    want = pad(text)
    assert whole[0][1] == len(want) and whole[0][2] == hashlib.sha256(want).hexdigest()
    assert len(webp.images(whole[0][7])) == -(-len(want) // (192 * webp_batch.ROWS))
    monkeypatch.setattr(webp_batch, "STEP_BYTES", 30_000)
    assert round_trips([text, b"x"]) == whole


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 500, None), (4, "a" * 192, "y"), (4, "a" * 192, "y"), (5, "ab\n" * 9000, "z"), (None, "q", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    out = media_column(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t, _ in rows:
        b = (t or "").encode()
        p = pad(b)
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert by[1].feature == by[2].feature and by[1].media_sha256 == by[2].media_sha256
    kept = media_column(df, keep_media=True).filter("doc_id = 5").first()
    assert b"".join(x.tobytes() for x in webp.images(bytes(kept.media))) == pad(rows[5][1].encode())
    assert media_column(df.limit(0)).count() == 0


def test_the_query(spark, tmp_path):
    import __spark_entry__

    rows = [(1, None), (2, ""), (3, "é" * 500), (4, "a" * 192), (4, "a" * 192), (5, "ab\n" * 9000), (None, "q"), (6, prose(800).decode())]
    spark.createDataFrame([(*r, "x", b"m") for r in rows], "doc_id long, text string, feature string, media binary").write.parquet(str(tmp_path / "documents.parquet"))
    out = __spark_entry__.queries()["op1_media_webp"](spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = pad(b)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    for r in out:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        media = webp_batch.store([pad(text.encode())])[0]
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature
