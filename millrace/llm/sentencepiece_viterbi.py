"""Operator 9: SentencePiece encoding and decoding with a shared-prefix Viterbi.

The model file (path is a parameter) gives the pieces and scores. Spaces become the mark, one mark
goes in front, and the text falls into marked words: a run of marks with what follows it, and single
characters that no piece holds. No piece crosses such a border (checked when loading), so the best
segmentation of a text is that of its marked words. The distinct marked words of a batch are sorted,
which is the depth-first order of their trie, and one forward table is kept along the current path:
a word starts from its common prefix with the word before it, with all scores there reused.

The segmentation has the largest sum of scores; of equal sums the one whose last piece is longest,
and so on to the front. A character without a piece costs ten less than the lowest score and is
written as its byte pieces. Decoding joins the pieces' bytes and takes the first mark away, so every text
comes back exactly. Null texts encode like empty ones (no pieces) and decode to ''.
"""

from __future__ import annotations

import re
import struct
from array import array
from itertools import compress, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, text_buffers, tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_WORDS = 40_000
SLICE_BYTES = 1 << 20
#: Marked words above this length share no prefixes; their back-pointers are kept in arrays.
LONG = 2048
#: Stands for a mark that the text itself holds; no marked word looks like it.
LITERAL = "\0" + MARK


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: int, bytes or 4/8 raw bytes."""
    at = 0

    def varint():
        nonlocal at
        v = shift = 0
        while True:
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + n]
        at += n


class Numbers(dict):
    """Numbers the keys asked for, in order."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Model:
    """Pieces of a SentencePiece model, as a trie of plain dictionaries."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float, int]] | None = None):
        if pieces is None:
            pieces = []
            with open(path, "rb") as f:
                for number, value in _fields(f.read()):
                    if number == 1:
                        p = dict(_fields(value))
                        pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        self.pieces = pieces
        self.bytes = [b""] * len(pieces)
        self.byte_id = {}
        #: A node maps a character to [node below, score or None, piece].
        self.root: dict[str, list] = {}
        low = 0.0
        for i, (text, score, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[i] = bytes([int(text[3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif kind in (NORMAL, USER):
                self.bytes[i] = text.replace(MARK, " ").encode()
                low = min(low, score)
                if MARK in text.lstrip(MARK):
                    raise ValueError(f"piece {i} holds a mark inside")
                node, entry = self.root, None
                for c in text:
                    entry = node.setdefault(c, [{}, None, -1])
                    node = entry[0]
                entry[1:] = float(score), i
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces")
        self.unknown_score = low - 10.0
        self.known = {c for t, _, k in pieces if k in (NORMAL, USER) for c in t}
        apart = "" if "\n" in self.known else "\n"
        self.split = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.cache: dict[str, tuple[int, ...]] = {LITERAL: tuple(self.byte_id[b] for b in MARK.encode())}

    def segment(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Piece ids of each distinct word, by one depth-first walk over the sorted words."""
        root, unknown = self.root, self.unknown_score
        out = {}
        best, back = [0.0], [(0, -1)]  # at each depth: score, (start, piece or -1)
        alive: list[list[tuple]] = [[]]  # (start, score there, trie node) still open after each depth
        before = ""
        long = [w for w in words if len(w) > LONG]
        if long:
            out |= {w: self.segment_long(w) for w in long}
            words = [w for w in words if len(w) <= LONG]
        for word in sorted(words):
            n = len(word)
            depth, limit = 0, min(n, len(before))
            while depth < limit and word[depth] == before[depth]:
                depth += 1
            del best[depth + 1 :], back[depth + 1 :], alive[depth + 1 :]
            for i in range(depth, n):
                c = word[i]
                top, how, rest = None, None, []
                for start, score, node in alive[i]:  # earlier starts first: the longest piece wins ties
                    entry = node.get(c)
                    if entry is not None:
                        below, gain, piece = entry
                        if below:
                            rest.append((start, score, below))
                        if gain is not None and (top is None or score + gain > top):
                            top, how = score + gain, (start, piece)
                score = best[i]
                entry = root.get(c)
                below, gain, piece = entry if entry is not None else (None, None, -1)
                if below:
                    rest.append((i, score, below))
                if gain is None:
                    gain, piece = unknown, -1
                if top is None or score + gain > top:
                    top, how = score + gain, (i, piece)
                best.append(top)
                back.append(how)
                alive.append(rest)
            before = word
            ids, at = [], n
            while at:
                start, piece = back[at]
                if piece < 0:
                    ids += [self.byte_id[b] for b in reversed(word[start:at].encode())]
                else:
                    ids.append(piece)
                at = start
            ids.reverse()
            out[word] = tuple(ids)
        return out

    def segment_long(self, word: str) -> array:
        """The pieces of one long word: back-pointers in arrays, scores and open tries only as far as a piece reaches."""
        root, unknown = self.root, self.unknown_score
        starts, chosen = array("i", [0]), array("i", [-1])
        best, open_ = 0.0, []  # score up to here; (start, score there, trie node)
        for i, c in enumerate(word):
            top, how, rest = None, None, []
            for start, score, node in open_:  # earlier starts first: the longest piece wins ties
                entry = node.get(c)
                if entry is not None:
                    below, gain, piece = entry
                    if below:
                        rest.append((start, score, below))
                    if gain is not None and (top is None or score + gain > top):
                        top, how = score + gain, (start, piece)
            below, gain, piece = root.get(c, (None, None, -1))
            if below:
                rest.append((i, best, below))
            if gain is None:
                gain, piece = unknown, -1
            if top is None or best + gain > top:
                top, how = best + gain, (i, piece)
            best, open_ = top, rest
            starts.append(how[0])
            chosen.append(how[1])
        ids, at = array("i"), len(word)
        while at:
            start, piece = starts[at], chosen[at]
            if piece < 0:
                ids.extend(self.byte_id[b] for b in reversed(word[start:at].encode()))
            else:
                ids.append(piece)
            at = start
        ids.reverse()
        return ids

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK not in text:
            return self.split(MARK + text.replace(" ", MARK))
        out = []
        for n, part in enumerate(text.split(MARK)):  # the text's own marks are written as bytes
            out += [LITERAL] * bool(n) + self.split(MARK * (not n) + part.replace(" ", MARK))
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts' pieces."""
        index, runs, sizes = Numbers(), [], []
        for t in texts:  # words become numbers text by text, so that a batch's words are held once each
            ws = self.words(t)
            runs.append(np.fromiter(map(index.__getitem__, ws), np.int32, len(ws)))
            sizes.append(len(ws))
        cache = self.cache
        fresh = self.segment([w for w in index if w not in cache])
        starts, flat = [0], array("i")
        for w in index:
            flat.extend(cache[w] if w in cache else fresh[w])
            starts.append(len(flat))
        pool, starts = np.array(flat, np.int32), np.array(starts, np.int64)
        at = np.concatenate(runs) if runs else np.empty(0, np.int32)
        if len(cache) < CACHE_WORDS:  # only words that the batch repeats, and never more than CACHE_WORDS
            often = np.bincount(at, minlength=len(index)) > 1
            cache.update(islice(((w, fresh[w]) for w in compress(index, often.tolist()) if len(w) < 64 and w in fresh), CACHE_WORDS - len(cache)))
        lens = starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = pool[np.repeat(starts[at] - ends[:-1], lens) + np.arange(ends[-1])] if len(pool) else pool
        return ids, ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        pieces = self.bytes
        out = b"".join([pieces[i] for i in ids])
        return out[1:] if out[:1] == b" " else out


_MODELS: dict[str, Model] = {}


def load(path: str) -> Model:
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = Model(path)
    return _MODELS[path]


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode_column(docs: DataFrame, columns: list[str], text_col: str = "text", model: str | None = None, decoded: bool = False) -> DataFrame:
    """``columns`` plus ids array<int> and n_tokens of every text; with ``decoded`` also the text decoded from the ids."""
    path = model or default_model()
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        import pyarrow as pa

        m = load(path)
        for batch in batches:
            text = batch.column(len(columns))
            _, offsets = text_buffers(text)
            for i, j in slices(offsets, SLICE_BYTES, 1 << 20):
                ids, ends = m.encode_batch([x or "" for x in text.slice(i, j - i).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                back = [pa.array([m.decode(ids[a:b].tolist()).decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(columns))), lists, pa.array(np.diff(ends)), *back], names=[*columns, "ids", "n_tokens", *["decoded"] * decoded])

    return docs.select(*columns, F.col(text_col).alias("_text")).mapInArrow(tidy(run), f"{kinds}, ids array<int>, n_tokens long" + ", decoded string" * decoded)


def decode_column(encoded: DataFrame, columns: list[str], ids_col: str = "ids", out_col: str = "text", model: str | None = None) -> DataFrame:
    """``columns`` plus the text of every list of ids (null ids: null)."""
    path = model or default_model()
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        import pyarrow as pa

        m = load(path)
        for batch in batches:
            lists = batch.column(len(columns))
            flat, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum([0 if x is None else x for x in lists.value_lengths().to_pylist()])]).astype(np.int64)
            nulls = np.asarray(lists.is_null())
            texts = [None if nulls[i] else m.decode(flat[ends[i] : ends[i + 1]].tolist()).decode(errors="replace") for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(texts, pa.string())], names=[*columns, out_col])

    return encoded.select(*columns, F.col(ids_col).alias("_ids")).mapInArrow(run, f"{kinds}, `{out_col}` string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    coded = encode_column(table(spark, sf_dir, "documents"), ["doc_id"], decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
