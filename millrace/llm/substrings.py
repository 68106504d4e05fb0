"""Operator 7: removal of passages repeated across documents, found by difference-cover anchors.

Words are runs without space, tab, line or page breaks. A window is ``window`` consecutive words; a
word goes if some window over it also starts in a document with a smaller id. Only ``window - 6``-word
anchors at positions {0, 1, 3} modulo 7 are hashed for the search: those residues differ by every
amount modulo 7, so two equal windows hold an equal anchor at cover positions of both documents,
wherever they lie. An anchor that stands in several blocks, or under several ids of one block, is extended to the
windows around it; only those are hashed, and they are compared to find the smallest id for each.

Windows are equal if two independent 64-bit hashes are, both keyed with bits drawn for the run: for any text
two different windows agree with probability 2**-128, some 10**-15 for any two of 10**12 windows.

Per hash and block one entry is shuffled, however often it occurs, so a passage in a third of all
rows costs one entry for each block. Results: null text has no words; a null id neither removes nor
loses words; rows that repeat an id are kept and do not remove each other's words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import unpack, write_blocks
from .common import U64, Hasher, buckets_for, find_words, fresh_seed, split_buckets, table, text_buffers

COVER, PERIOD = (0, 1, 3), 7


def _from_bytes(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]


class Block:
    """Words, windows and anchors of a packed block."""

    def __init__(self, payload: bytes, window: int, seeds: tuple[int, ...] = ()):
        batch = unpack(payload)
        self.id_column = batch.column(0)
        self.valid_id = np.ones(batch.num_rows, bool) if not self.id_column.null_count else ~np.asarray(self.id_column.is_null())
        self.ids = np.asarray(self.id_column.fill_null(0)).astype(np.int64)
        self.data, self.offsets = text_buffers(batch.column(1))
        self.starts, self.ends, self.first = find_words(self.data, self.offsets)
        self.window = window
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.within = np.arange(n) - self.first[self.doc]
        self.left = self.first[self.doc + 1] - np.arange(n)  # words from here to the document's end
        base = int(self.offsets[0])
        self.hashers = [Hasher(s) for s in seeds]
        self.words = [h.words(self.data[base:], self.starts, self.ends) for h in self.hashers]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the anchors at cover positions."""
        size = self.window - PERIOD + 1
        at = np.isin(self.within % PERIOD, COVER) & (self.left >= size) & (self.first[self.doc + 1] - self.first[self.doc] >= self.window) & self.valid_id[self.doc]
        at = np.flatnonzero(at)
        return at, self.hashers[0].windows(self.words[0], size)[at]

    def candidates(self, shared: np.ndarray, shift: np.uint64) -> np.ndarray:
        """Starts of the windows that hold an anchor known to stand elsewhere, or under two ids of this block."""
        at, h = self.anchors()
        order = np.lexsort((self.ids[self.doc[at]], h))
        run = np.cumsum(np.r_[True, h[order][1:] != h[order][:-1]]) - 1 if len(at) else order
        ids = self.ids[self.doc[at[order]]]
        edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(at) else order
        last = np.append(edge[1:], len(at)) - 1
        hit = np.isin(h >> shift, shared)
        hit[order] |= (ids[edge] != ids[last])[run] if len(at) else False
        marks = np.zeros(len(self.starts) + PERIOD + 1, np.int32)
        marks[at[hit] + 1] = 1
        marks = np.cumsum(marks)
        s = np.flatnonzero((self.left >= self.window) & self.valid_id[self.doc])
        return s[marks[s + PERIOD] > marks[s]]

    def windows(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each window among the distinct ones; their hashes, ascending; the smallest id of each)."""
        cover = np.zeros(len(self.starts) + self.window + 1, np.int32)
        cover[s] += 1
        cover[s + self.window] -= 1
        used = np.flatnonzero(np.cumsum(cover)[: len(self.starts)] > 0)
        at = np.searchsorted(used, s)
        h1, h2 = (h.windows(w[used], self.window)[at] if len(s) else np.empty(0, U64) for h, w in zip(self.hashers, self.words, strict=True))
        ids = self.ids[self.doc[s]]
        order = np.lexsort((ids, h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(s), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        number = np.empty(len(s), np.int64)
        number[order] = np.cumsum(new) - 1
        return number, h1[new], h2[new], ids[order][new]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row of ``docs``; ids are integers, ``window`` at least 7."""
    if window < PERIOD:
        raise ValueError("window must be at least 7 words")
    n_buckets = buckets_for(docs)
    blocks = write_blocks(docs, [id_col], text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    seeds = (fresh_seed(), fresh_seed())
    shift = U64(64 - 32 - n_buckets.bit_length() + 1)  # anchors are sent as 32 bits beyond their bucket's

    def ask_anchors(batches):
        import pyarrow as pa

        for batch in batches:
            for block_id, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.unique(Block(payload.as_buffer(), window, seeds[:1]).anchors()[1] >> shift)
                runs = list(split_buckets(found << shift, n_buckets))
                low = (found & U64(0xFFFFFFFF)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([block_id] * len(runs), pa.int64()), pa.array([low[a:b].tobytes() for _, a, b in runs], pa.binary())], names=["bucket", "block_id", "data"])

    def shared_anchors(group):
        import pyarrow as pa

        bucket = group.column("bucket")[0].as_py()
        parts = _from_bytes(group.column("data"), np.uint32)
        every = np.sort(np.concatenate(parts))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        answers = [(i, p[np.isin(p, shared, assume_unique=True)]) for i, p in zip(group.column("block_id").to_pylist(), parts, strict=True)] if len(shared) else []
        answers = [(i, p.astype(U64) | U64(bucket) << U64(32)) for i, p in answers if len(p)]
        return pa.table({"block_id": pa.array([i for i, _ in answers], pa.int64()), "data": pa.array([p.tobytes() for _, p in answers], pa.binary())})

    asked = blocks.mapInArrow(ask_anchors, "bucket int, block_id long, data binary")
    answers = asked.groupBy("bucket").applyInArrow(shared_anchors, "block_id long, data binary")
    asks = ("bucket", "block_id", "at", "h1", "h2", "slot", "ids", "mask")

    def ask_windows(key, left, right):
        """Rows of distinct windows for the buckets, and one with the block's candidates for itself."""
        import pyarrow as pa

        rows = []
        if left.num_rows:
            block = Block(left.column("payload")[0].as_buffer(), window, seeds)
            shared = np.concatenate([np.empty(0, U64), *_from_bytes(right.column("data"), U64)])
            s = block.candidates(shared, shift)
            if len(s):
                mask = np.zeros(len(block.starts), bool)
                mask[s] = True
                block_id = key[0].as_py()
                rows.append((n_buckets + block_id % n_buckets, block_id, None, None, None, None, None, np.packbits(mask).tobytes()))
                _, h1, h2, ids = block.windows(s)
                for b, lo, hi in split_buckets(h1, n_buckets):
                    used, slot = np.unique(ids[lo:hi], return_inverse=True)
                    rows.append((b, block_id, lo, h1[lo:hi].tobytes(), h2[lo:hi].tobytes(), slot.astype(np.uint16).tobytes(), used.tobytes(), None))  # a block has at most 32,000 ids
        kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(asks, kinds, strict=True))})

    def smallest(group):
        """For every block the numbers of its windows that start under a smaller id elsewhere, and that id; masks pass."""
        import pyarrow as pa

        rows = [(b, None, None, m.as_py()) for b, m in zip(group.column("block_id").to_pylist(), group.column("mask"), strict=True) if m.is_valid]
        sent = group.filter(group.column("mask").is_null())
        if sent.num_rows:
            h1, h2 = (_from_bytes(sent.column(c), U64) for c in ("h1", "h2"))
            doc = [u[s] for u, s in zip(_from_bytes(sent.column("ids"), np.int64), _from_bytes(sent.column("slot"), np.uint16), strict=True)]
            sizes = [len(x) for x in h1]
            h1, h2, doc = np.concatenate(h1), np.concatenate(h2), np.concatenate(doc)
            order = np.lexsort((doc, h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            least = np.empty(len(order), np.int64)
            least[order] = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            end = 0
            for b, at, n in zip(sent.column("block_id").to_pylist(), sent.column("at").to_pylist(), sizes, strict=True):
                part = slice(end, end + n)
                end += n
                foreign = np.flatnonzero(least[part] < doc[part])
                if len(foreign):
                    rows.append((b, (foreign + at).astype(np.uint32).tobytes(), least[part][foreign].tobytes(), None))
        kinds = (pa.int64(), *[pa.binary()] * 3)
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(("block_id", "number", "least", "mask"), kinds, strict=True))})

    windows = blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(ask_windows, "bucket int, block_id long, at long, h1 binary, h2 binary, slot binary, ids binary, mask binary")
    verdicts = windows.groupBy("bucket").applyInArrow(smallest, "block_id long, number binary, least binary, mask binary")

    def remove(key, left, right):
        import pyarrow as pa

        block = Block(left.column("payload")[0].as_buffer(), window, seeds if right.num_rows else ())
        drop = np.zeros(len(block.starts), bool)
        masks = _from_bytes(right.column("mask"), np.uint8)
        if masks:
            s = np.flatnonzero(np.unpackbits(masks[0], count=len(block.starts)))
            number, _, _, least = block.windows(s)
            for at, other in zip(_from_bytes(right.column("number"), np.uint32), _from_bytes(right.column("least"), np.int64), strict=True):
                least[at] = np.minimum(least[at], other)
            gone = s[least[number] < block.ids[block.doc[s]]]
            cover = np.zeros(len(block.starts) + window + 1, np.int32)
            cover[gone] += 1
            cover[gone + window] -= 1
            drop = np.cumsum(cover)[: len(block.starts)] > 0
        texts, removed = [], []
        for i in range(len(block.ids)):
            words = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
            mine = drop[block.first[i] : block.first[i + 1]]
            n = int(mine.sum())
            removed.append(n)
            texts.append(b" ".join([w for w, d in zip(words, mine.tolist(), strict=True) if not d] if n else words).decode())
        return pa.table({id_col: block.id_column, "n_words": pa.array(np.diff(block.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})

    return blocks.groupBy("block_id").cogroup(verdicts.groupBy("block_id")).applyInArrow(remove, f"`{id_col}` {id_type}, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
