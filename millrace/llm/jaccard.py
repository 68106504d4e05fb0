"""Operator 8: documents linked by the Jaccard similarity of their word shingles.

The incidence matrix of documents and shingles is multiplied with its transpose in tiles. A tile holds the rows of
some documents and a list of pairs to be counted; it goes through the columns (shingles, in order of their hash) block by
block, adds up each pair's overlap, and discards a pair once what it has and what the later blocks can still
give are below the overlap that follows from the two sizes. Tiles are cut by the bytes of their rows, so a document with very many
partners is dealt over several.

Which pairs a tile counts: every pair that links agrees entirely in some column blocks. Documents of
one size band use the same cut into d + d / s + 3 blocks, where d bounds how many shingles two linked
documents of that band can differ in; so at least d / s + 3 blocks of linked documents agree (s is 5 at a similarity of 0.9, 3 at 0.8).
A block's content hash is a signature. Blocks of less than two shingles are weak, and a document leaves
their signatures out if it has fewer of them than blocks that must agree: then one that agrees is not weak.
(Otherwise it gives the weak ones too, also to a partner that leaves them out and may share but one with it.)
Signatures of empty blocks are left out by the same count of their own.
Pairs without a common signature are never made; of those with one, size ratio and parities of shingle counters
(512 for all and up to 16,384 for long documents) discard most before the product.

Copies collapse first (equal sets are one node). In each signature every node is multiplied with the
smallest node, then, while many are apart, with other members of its largest component; at last every
remaining pair of different components within a signature, so components are exact. No pair is
made inside a component.

A signature with more than SIDES * SIDE members left is not paired: its members are multiplied with one of them, the center, and
meet again by what tells them apart from it. Two documents that link, not both of them with the center, share some of
the shingles in which each differs from it; as they differ in d at most, the first of these that they share is
among the first d / 2 + 1 of the one that differs less and among the first d + 1 of the other. So a member
gives d + 1 rows, however many members there are. Groups still large take a center of their own, REFINE times; what is
left then is dealt over squares of at most 2 SIDE members.

Shingles are 64-bit hashes, keyed with bits drawn for the run; a node is a 64-bit hash of its set, and sets are told
apart by a second one: where nodes of different sets meet (expected: 3 times among 10**10 sets) they are renamed.

Words are lower-cased (A-Z) runs without space, tab, line or page breaks; fewer words than the
shingle length make one shingle; no words make an empty set that links with nothing. Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hasher, buckets_for, find_words, forget, fresh_seed, hint_small, materialize, mix, slices, split_buckets, table, text_buffers, tidy
from .components import connected

PARITY = 8  # 64-bit words
WIDE_FROM, WIDE_MOST = 300, 1 << 14
SPARE = 3
#: Members from which a signature is hot.
HOT = 32
#: Further rounds of stars, while this share of the last round's candidates, and this many, were links. The last step takes whatever is left.
MORE_STARS, WORTH, FEW_LINKS = 5, 0.2, 100
SLICE_BYTES, SLICE_DOCS = 1 << 20, 1000
SEND_SIGNATURES = 1_000_000
#: Shingles in the rows of a tile, about, and column blocks it goes through.
TILE, COLUMN_BLOCKS = 1 << 20, 8
#: Members of a signature that are paired in one key of the last join's either side.
SIDE = 64
#: Sides from which a signature is split by its members' differences from a center first; times that this is done.
SIDES, REFINE = 4, 4
#: Members whose differences from a center are counted, to put the rare ones first.
SAMPLE = 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, h: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each document's distinct shingles, ascending."""
    starts, ends, first = find_words(data, offsets)
    words = h.words(data[int(offsets[0]) :], starts, ends)
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    cut = np.concatenate([[0], np.cumsum(sizes)])
    every = np.empty(int(cut[-1]), U64)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(first[doc + 1] - np.arange(len(words)) >= k)
    if len(at):
        every[np.repeat(counts >= k, sizes)] = h.windows(words, k)[at]
    for n in range(1, k):  # documents shorter than a shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            every[cut[short]] = h.windows(words, n)[first[short]]
    for i in np.flatnonzero(sizes > 1).tolist():
        every[cut[i] : cut[i + 1]].sort()
    keep = np.ones(len(every), bool)
    keep[1:] = every[1:] != every[:-1]
    keep[cut[:-1][sizes > 0]] = True
    return every[keep], np.concatenate([[0], np.cumsum(keep)])[cut]


class Bands:
    """Size bands and their numbers of column blocks, for links of num/den similarity."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.share = next((s for s in (5, 4, 3, 2) if self._weak(s) <= 0.8 / s), 1)
        self.edges = [-(-num // (den - num))]  # smaller sets link only if they are equal

    def _weak(self, share: int) -> float:
        """Expected weak blocks for each shingle that may differ, with one spare block for ``share`` of them."""
        blocks = 1 + 1 / share
        load = self.num / (self.den - self.num) / blocks
        return blocks * math.exp(-load) * (1 + load)

    def upto(self, n: int) -> np.ndarray:
        while self.edges[-1] <= n:
            last = self.edges[-1]
            self.edges.append(max(last + 1, last * self.den // self.num + 1))
        return np.array(self.edges)

    def blocks(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, blocks that agree at least) of the bands."""
        top = np.array(self.edges)[band + 1] - 1
        differ = top * (self.den - self.num) // self.num
        agree = differ // self.share + SPARE
        return differ + agree, agree


def signatures(hashes: np.ndarray, cut: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, 2 * room + step) rows of the documents hashes[cut[i]:cut[i+1]].

    step is 0 or 1 for the document as a pair's smaller or larger one; room is how many more signatures it
    could leave out and still give one of those that agree with any document it links with.
    """
    sizes = np.diff(cut)
    edges = bands.upto(int(sizes.max(initial=0)))
    own = np.searchsorted(edges, sizes, "right") - 1
    sigs, docs, metas = [], [], []
    for step in (0, 1):  # as the smaller and as the larger document of a pair
        use = np.flatnonzero(own - step >= 0)
        if not len(use):
            continue
        band = own[use] - step
        n_blocks, agree = bands.blocks(band)
        base = np.concatenate([[0], np.cumsum(n_blocks)])
        lens = sizes[use]
        at = np.repeat(cut[use] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        h = hashes[at]
        salt = mix((band.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
        block = (mix(h ^ np.repeat(salt, lens)) % np.repeat(n_blocks.astype(U64), lens)).astype(np.int64)
        sums = np.zeros(int(base[-1]), U64)
        slot = np.repeat(base[:-1], lens) + block
        np.add.at(sums, slot, mix(h + U64(0x51ED270B)))
        owner = np.repeat(np.arange(len(use)), n_blocks)
        number = np.arange(len(sums)) - base[owner]
        held = np.bincount(slot, minlength=len(sums))
        weak, empty = held < 2, held == 0
        n_weak = np.bincount(owner[weak], minlength=len(use))
        few = n_weak < agree
        keep = ~(weak & few[owner] | empty & (np.bincount(owner[empty], minlength=len(use)) < agree)[owner])
        room = np.where(few, agree - n_weak, 1)  # a few partner may have left out all but one of those that agree
        sig = mix(sums ^ mix(salt[owner] + number.astype(U64)))
        sigs.append(sig[keep])
        docs.append(use[owner[keep]])
        metas.append((np.minimum(room, 30_000) * 2 + step)[owner[keep]])
    if not sigs:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(sigs), np.concatenate(docs), np.concatenate(metas)


def parities(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * PARITY counters, as (documents, PARITY) int64."""
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    slot = (mix(hashes ^ U64(0xA5A5)) >> U64(65 - (64 * PARITY).bit_length())).astype(np.int64)
    odd = np.bincount(doc * (64 * PARITY) + slot, minlength=(len(cut) - 1) * 64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, PARITY)


class Sets:
    """How a run of the operator hashes: shingle length, key, and the nodes that stand for several sets."""

    def __init__(self, k: int, seed: int | None = None, clashes: tuple[int, ...] = ()):
        self.k, self.seed = k, fresh_seed() if seed is None else seed
        self.clashes = np.array(clashes, np.int64)

    def read(self, batch):
        """(first row, last row, shingles, cut, nodes, checks) of an Arrow batch's slices; a node is the hash of a set."""
        hasher = Hasher(self.seed, lower=True)
        data, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets, SLICE_BYTES, SLICE_DOCS):
            h, cut = shingle_sets(data, offsets[i : j + 1], self.k, hasher)
            node, check = (self._sums(h, cut, odd) for odd in (U64(3), U64(0x9E3779B97F4A7C15)))
            if len(self.clashes):
                node = np.where(np.isin(node, self.clashes), check, node)
            yield i, j, h, cut, node, check

    @staticmethod
    def _sums(h: np.ndarray, cut: np.ndarray, odd: np.uint64) -> np.ndarray:
        total = np.concatenate([[U64(0)], np.cumsum(mix(h + odd))])
        return mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(U64)).view(np.int64)


def _figures(docs: DataFrame, id_col: str, text_col: str, sets: Sets) -> DataFrame:
    """(doc_id, node, check, n, known, parity, wide) of every row; wide only for long documents."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            for i, j, h, cut, node, check in sets.read(batch):
                n = np.diff(cut)
                parity = pa.FixedSizeListArray.from_arrays(pa.array(parities(h, cut).ravel()), PARITY).cast(pa.list_(pa.int64()))
                wide = [wide_parity(h[cut[x] : cut[x + 1]]).tobytes() if n[x] >= WIDE_FROM else None for x in range(j - i)]
                part = ids.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.cast(pa.int64()), pa.array(node), pa.array(check), pa.array(n), part.is_valid(), parity, pa.array(wide, pa.binary())], names=["doc_id", "node", "check", "n", "known", "parity", "wide"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, node long, check long, n long, known boolean, parity array<long>, wide binary")


def _members(docs: DataFrame, id_col: str, text_col: str, sets: Sets, num: int, den: int, n_buckets: int) -> DataFrame:
    """(sig, node, meta, center) of every signature that several nodes share.

    A run of documents sends each signature once, in the name of its smallest node; its other nodes of that signature
    go along as finished rows. So what meets in a bucket grows with the runs, not with a group's documents.
    """
    bands = Bands(num, den)

    def run(batches):
        for batch in batches:
            valid = ~np.asarray(batch.column(0).is_null())
            known: set[int] = set()
            nodes, sigs, owners, held = [], [], [], 0
            for i, j, h, cut, node, _ in sets.read(batch):
                new = np.zeros(j - i, bool)
                for q, x in enumerate(node.tolist()):
                    if valid[i + q] and x not in known:
                        known.add(x)
                        new[q] = True
                s, d, meta = signatures(h, cut, bands)
                keep = new[d]
                sigs.append(s[keep])
                owners.append(held + 2 * d[keep] + meta[keep] % 2)  # a document has an entry for each step
                entries = np.zeros((2 * len(node), 2), np.int64)
                entries[:, 0] = np.repeat(node, 2)
                entries[2 * d + meta % 2, 1] = meta
                nodes.append(entries)
                held += len(entries)
                if sum(map(len, sigs)) >= SEND_SIGNATURES:
                    yield from send(nodes, sigs, owners)
                    nodes, sigs, owners, held = [], [], [], 0
            if nodes:
                yield from send(nodes, sigs, owners)

    def send(nodes, sigs, owners):
        """The rows of one run of documents."""
        import pyarrow as pa

        names, kinds = ["bucket", "sig", "slot", "nodes", "local"], (pa.int32(), *[pa.binary()] * 4)
        nodes, sigs, owners = np.concatenate(nodes), np.concatenate(sigs), np.concatenate(owners)
        order = np.lexsort((nodes[owners, 0], sigs))
        sigs, owners = sigs[order], owners[order]
        first = np.ones(len(sigs), bool)
        first[1:] = sigs[1:] != sigs[:-1]
        run_no = np.cumsum(first) - 1
        many = (np.bincount(run_no) > 1)[run_no] if len(sigs) else first
        at = np.flatnonzero(first)
        local = np.column_stack([sigs[many].view(np.int64), nodes[owners[many]], nodes[owners[at[run_no[many]]], 0]]) if many.any() else np.empty((0, 4), np.int64)
        rows = []
        for lo in range(0, len(local), 50_000):
            part = np.ascontiguousarray(local[lo : lo + 50_000])
            rows.append((int(mix(part[:1, 1].view(np.uint64))[0] % U64(n_buckets)), None, None, None, part.tobytes()))
        sigs, owners = sigs[first], owners[first]
        for b, lo, hi in split_buckets(sigs, n_buckets):
            used, slot = np.unique(owners[lo:hi], return_inverse=True)
            rows.append((b, sigs[lo:hi].tobytes(), slot.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes(), nodes[used].tobytes(), None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def across(group):
        import pyarrow as pa

        sig, node = [np.empty(0, np.uint64)], [np.empty((0, 2), np.int64)]
        done = [np.empty((0, 4), np.int64)]
        for s, i, t, x in zip(*(group.column(c) for c in ("sig", "slot", "nodes", "local")), strict=True):
            if x.is_valid:
                done.append(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 4))
                continue
            s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.int64).reshape(-1, 2)
            i = np.frombuffer(i.as_buffer(), np.uint32 if len(t) > 65535 else np.uint16)
            sig.append(s)
            node.append(t[i])
        sig, node = np.concatenate(sig), np.concatenate(node)
        node, meta = node[:, 0], node[:, 1]
        order = np.argsort(sig, kind="stable")
        same = np.zeros(len(order), bool)
        eq = sig[order][1:] == sig[order][:-1]
        same[1:] |= eq
        same[:-1] |= eq
        order = order[same]
        sig, node, meta = sig[order], node[order], meta[order]
        order = np.lexsort((node, sig))
        sig, node, meta = sig[order], node[order], meta[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, meta = sig[keep], node[keep], meta[keep]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        run_no = np.cumsum(first) - 1
        center = node[np.flatnonzero(first)[run_no]] if len(sig) else node
        many = (np.bincount(run_no) > 1)[run_no] if len(sig) else first
        done = np.concatenate(done)
        cols = [np.concatenate([x[many], y]) for x, y in ((sig.view(np.int64), done[:, 0]), (node, done[:, 1]), (meta, done[:, 2]), (center, done[:, 3]))]
        return pa.table({n: pa.array(c) for n, c in zip(("sig", "node", "meta", "center"), cols, strict=True)})

    sent = docs.select(id_col, text_col).mapInArrow(tidy(run), "bucket int, sig binary, slot binary, nodes binary, local binary")
    return sent.groupBy("bucket").applyInArrow(across, "sig long, node long, meta long, center long")


def wide_parity(hashes: np.ndarray) -> np.ndarray:
    """Parity bits of a power of two of counters, about four for each shingle; halving it is an XOR of its halves."""
    n_bits = min(WIDE_MOST, 1 << int(4 * max(len(hashes), 16) - 1).bit_length())
    slot = (mix(hashes ^ U64(0xC3C3)) & U64(n_bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=n_bits) & 1).astype(np.uint8))


def differ_at_least(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference, from two wide parities."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _without_hot(members: DataFrame) -> DataFrame:
    """(sig, node, center) less the hot signatures of nodes that have room for leaving them out.

    A signature is hot if it has more than HOT members: passages that many documents share. A node's step with
    fewer hot signatures than room still gives a signature that is not hot for each document it links with, and so
    it is found there; a node without that room keeps all its signatures, and two such nodes meet in the hot ones.
    """
    rows = members.select("sig", "node", "meta", "center").distinct()
    rows = materialize(rows, "jaccard-members")
    sizes = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT)
    marked = materialize(rows.join(sizes, "sig").select("sig", "node", "meta"), "jaccard-hot")
    spare = marked.groupBy("node", "meta").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < F.floor(F.col("meta") / 2))
    gone = marked.join(spare.select("node", "meta"), ["node", "meta"]).select("sig", "node")
    kept = materialize(rows.join(gone, ["sig", "node"], "left_anti").select("sig", "node", "center"), "jaccard-met")
    forget(rows, marked)
    return kept


def _bound(num: int, den: int):
    """Sizes and parities of a and b leave a link possible."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col("a.parity")[i].bitwiseXOR(F.col("b.parity")[i])) for i in range(PARITY)))
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return (small * den >= large * num) & (differ * (den + num) <= (small + large) * (den - num))


def _rows_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, sets: Sets) -> DataFrame:
    """(node, set binary) of ``wanted`` (node, doc_id); several rows of a node are alike."""
    wanted = materialize(wanted.select(F.col("node").alias("_node"), F.col("doc_id").alias("_want")), "jaccard-wanted")
    text = docs.select(F.col(id_col).cast("long").alias("_want"), F.col(text_col).alias("_text"))
    rows = text.join(hint_small(wanted, wanted.count()), "_want").select("_node", "_text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            want = np.asarray(batch.column(0))
            for i, j, h, cut, node, _ in sets.read(batch):
                mine = np.flatnonzero(node == want[i:j])  # an id may stand for several texts
                yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array([h[cut[x] : cut[x + 1]].tobytes() for x in mine], pa.binary())], names=["node", "set"])

    return materialize(rows.mapInArrow(tidy(run), "node long, set binary"), "jaccard-sets")


def overlaps(lefts: list[np.ndarray], right: np.ndarray) -> np.ndarray:
    """How many of each left set are in ``right`` (all ascending)."""
    lens = np.array([len(x) for x in lefts])
    if not len(right):
        return np.zeros(len(lefts), np.int64)
    flat = np.concatenate(lefts)
    at = np.minimum(np.searchsorted(right, flat), len(right) - 1)
    hit = np.concatenate([[0], np.cumsum(right[at] == flat)])
    ends = np.cumsum(lens)
    return hit[ends] - hit[ends - lens]


def tile_product(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """(which of the pairs of rows (a, b) reach num/den, multiplications left out): the sparse product of a tile, column block by column block."""
    sizes = np.array([len(x) for x in rows], np.int64)
    borders = np.array([(1 << 64) // COLUMN_BLOCKS * c for c in range(1, COLUMN_BLOCKS)], U64)
    cuts = np.array([[0, *np.searchsorted(x, borders), len(x)] for x in rows], np.int64)
    need = -(-num * (sizes[a] + sizes[b]) // (den + num))  # overlap from which intersection / union is num/den
    have, left_out = np.zeros(len(a), np.int64), 0
    live = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= need)
    for block in range(COLUMN_BLOCKS):
        left_out += len(a) - len(live)
        if not len(live):
            continue
        live = live[np.argsort(b[live], kind="stable")]
        for part in np.split(live, np.flatnonzero(np.diff(b[live])) + 1):
            y = int(b[part[0]])
            column = rows[y][cuts[y, block] : cuts[y, block + 1]]
            have[part] += overlaps([rows[x][cuts[x, block] : cuts[x, block + 1]] for x in a[part].tolist()], column)
        rest = np.minimum(sizes[a[live]] - cuts[a[live], block + 1], sizes[b[live]] - cuts[b[live], block + 1])
        live = live[have[live] + rest >= need[live]]
    good = np.zeros(len(a), bool)
    good[live] = True
    return good, left_out


def first_differences(row: np.ndarray, center: np.ndarray, often: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int, int]:
    """(shingles in which ``row`` differs from ``center``, as many as it may differ in from a set it links with and one
    more; how many of them are enough beside a set that differs from the center in more; their number in all).

    ``often``: ascending shingles in its first row, in how many of some rows that differ from the center each does in the
    second. Rare ones come first; all rows of a center have one order.
    """
    apart = np.setxor1d(row, center, assume_unique=True)
    differ = (len(row) + len(row) * den // num) * (den - num) // (den + num)
    known, count = often
    at = np.minimum(np.searchsorted(known, apart), max(0, len(known) - 1))
    count = np.where(known[at] == apart, count[at], 0) if len(known) else np.zeros(len(apart))
    return apart[np.lexsort((apart, count))[: differ + 1]], differ // 2 + 1, len(apart)


def _often(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """(node, often binary) of every b of the pairs (a, b): shingles in which several of about SAMPLE a differ from it, and their counts."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SAMPLE).alias("_every"))
    some = pairs.join(sizes, "b").where(F.pmod(F.xxhash64("a", "b"), F.col("_every")) == 0)
    some = some.select("b", F.col("a").alias("node")).union(sizes.select("b", F.col("b").alias("node")))

    def run(group):
        import pyarrow as pa

        b = group.column("b")[0].as_py()
        rows = {n: np.frombuffer(x.as_buffer(), U64) for n, x in zip(group.column("node").to_pylist(), group.column("set"), strict=True)}
        center = rows.pop(b)
        shingles, count = np.unique(np.concatenate([np.empty(0, U64), *(np.setxor1d(x, center, assume_unique=True) for x in rows.values())]), return_counts=True)
        often = np.stack([shingles, count.astype(U64)])[:, count > 1]
        return pa.table({"node": pa.array([b], pa.int64()), "often": pa.array([often.tobytes()], pa.binary())})

    return some.join(stored, "node").select("b", "node", "set").groupBy("b").applyInArrow(run, "node long, often binary")


def _product(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, sets: Sets, num: int, den: int, differences: bool = False) -> DataFrame:
    """The stored pairs (a, b) whose sets' similarity reaches num/den. ``pairs``: stored, distinct (a, b, na, nb, da, db).

    With ``differences`` also rows (a, b, sig, distance, probe) of every pair, for each of the first differences of a
    from b: sig names b and the shingle, distance is their number in all, probe says if it is among those that are enough.
    """
    size = pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0
    n_tiles = max(1, -(-size // TILE))
    heavy = materialize(pairs.groupBy("b").agg(F.ceil(F.sum("na") / TILE).alias("split")).where("split > 1"), "jaccard-heavy")
    split = F.coalesce(F.col("split"), F.lit(1))
    dealt = pairs.join(hint_small(heavy, heavy.count()), "b", "left").withColumn("tile", F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), split)), F.lit(n_tiles)))
    dealt = materialize(dealt.select("tile", "a", "b", "da", "db"), "jaccard-tiles")
    ends = dealt.select("tile", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("da").alias("doc_id")), F.struct(F.col("b").alias("node"), F.col("db").alias("doc_id")))).alias("x")).select("tile", "x.*").distinct()
    wanted = ends.select("node", "doc_id").distinct()
    stored = _rows_of(docs, id_col, text_col, wanted, sets)
    rows = stored.join(ends.select(F.col("tile").alias("at"), "node"), "node")
    if differences:
        rows = rows.join(materialize(_often(pairs, stored), "jaccard-often"), "node", "left")

    def run(key, left, right):
        import pyarrow as pa

        nodes = {n: i for i, n in enumerate(right.column("node").to_pylist())}
        matrix = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("set")]
        a, b = left.column("a"), left.column("b")
        at = [np.fromiter(map(nodes.__getitem__, x.to_pylist()), np.int64, left.num_rows) for x in (a, b)]
        good = pa.array(tile_product(matrix, *at, num, den)[0]) if left.num_rows else pa.array([], pa.bool_())
        out = pa.table({"a": a.filter(good), "b": b.filter(good)})
        if not differences:
            return out
        often = [np.frombuffer(x.as_buffer(), U64).reshape(2, -1) if x.is_valid else None for x in right.column("often")]
        return pa.concat_tables([out, apart(matrix, often, a, b, *at)], promote_options="default").select(names)

    def apart(matrix, often, a, b, at_a, at_b):
        import pyarrow as pa

        sigs, lens, distances, probes = [np.empty(0, U64)], [], [], [np.empty(0, bool)]
        for x, y, center in zip(at_a.tolist(), at_b.tolist(), b.to_pylist(), strict=True):
            shingles, enough, distance = first_differences(matrix[x], matrix[y], often[y], num, den)
            sigs.append(mix(shingles ^ mix(np.array([center], np.int64).view(U64))))
            lens.append(len(shingles))
            distances.append(distance)
            probes.append(np.arange(len(shingles)) < enough)
        which = np.repeat(np.arange(len(lens)), np.array(lens, np.int64))
        cols = [a.take(pa.array(which)), b.take(pa.array(which)), np.concatenate(sigs).view(np.int64), np.array(distances, np.int64)[which], np.concatenate(probes)]
        return pa.table(dict(zip(names, cols, strict=True)))

    names = ["a", "b", "sig", "distance", "probe"]
    schema = "a long, b long" + ", sig long, distance long, probe boolean" * differences
    found = materialize(dealt.select("tile", "a", "b").groupBy("tile").cogroup(rows.groupBy("at")).applyInArrow(run, schema), "jaccard-differences" if differences else "jaccard-links")
    forget(stored, dealt)
    return found


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, with_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: links are num/den similarity or more.

    component_id is the smallest id reachable by links, the row's own for empty sets. A null id gets
    null. With ``with_links`` also the verified links (a, b: smallest ids of two different sets) are
    returned as a second frame; they connect every component.
    """
    sets = Sets(shingle)
    figures = materialize(_figures(docs, id_col, text_col, sets), "jaccard-figures")

    def by_node(rows: DataFrame) -> DataFrame:
        figures_of = [F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.max("wide").alias("wide"), (F.min("check") != F.max("check")).alias("clash")]
        return materialize(rows.where("known and n > 0").groupBy("node").agg(*figures_of), "jaccard-nodes")

    nodes = by_node(figures)
    clashes = [r["node"] for r in nodes.where("clash").select("node").collect()]  # about N**2 / 2**65 of N sets
    if clashes:
        sets = Sets(shingle, sets.seed, tuple(clashes))
        figures = figures.withColumn("node", F.when(F.col("node").isin(clashes), F.col("check")).otherwise(F.col("node")))
        nodes = by_node(figures)
    members = _without_hot(_members(docs, id_col, text_col, sets, num, den, buckets_for(docs)))

    def candidates(pairs: DataFrame, bound: bool = True) -> DataFrame:
        """Pairs (a, b) of nodes (within the bounds), with their sizes and ids."""
        figures_of = F.struct("n", "parity", "doc_id")
        both = pairs.join(nodes.select(F.col("node").alias("a"), figures_of.alias("fa")), "a").join(nodes.select(F.col("node").alias("b"), figures_of.alias("fb")), "b")
        both = both.select(F.struct(F.col("a").alias("node"), "fa.*").alias("a"), F.struct(F.col("b").alias("node"), "fb.*").alias("b"))
        both = both.where(_bound(num, den)) if bound else both
        return both.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.doc_id").alias("da"), F.col("b.doc_id").alias("db"))

    def apart(batches):
        """Drops pairs of long documents whose wide parities differ too much."""
        import pyarrow as pa

        for batch in batches:
            size = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            keep = np.ones(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(6), batch.column(7), strict=True)):
                keep[i] = differ_at_least(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) * (den + num) <= size[i] * (den - num)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:6]], names=batch.schema.names[:6])

    def verified(pairs: DataFrame, name: str) -> tuple[DataFrame, float, int]:
        """(links among the pairs, their share, their number)."""
        pairs = materialize(pairs, f"{name}-candidates")
        asked = pairs.count()
        long = F.least("na", "nb") >= WIDE_FROM
        wide = nodes.where(F.col("n") >= WIDE_FROM).select("node", "wide")
        both = pairs.where(long).join(wide.toDF("a", "wa"), "a").join(wide.toDF("b", "wb"), "b").select(*pairs.columns, "wa", "wb")
        left = materialize(pairs.where(~long).union(both.mapInArrow(apart, "a long, b long, na long, nb long, da long, db long")), f"{name}-pairs")
        found = _product(left, docs, id_col, text_col, sets, num, den)
        forget(pairs, left)
        n = found.count()
        return found, n / max(1, asked), n

    star = members.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    links, good, good_links = verified(candidates(star), "jaccard-star")
    roots = materialize(connected(links, "a", "b", "jaccard-cc"), "jaccard-roots")

    def still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """(sig, node, distance, probe, root, main, members) of the signatures in ``rows`` that hold several components; main is the largest there."""
        placed = rows.select("sig", "node", "distance", "probe").join(roots, "node", "left").select("sig", "node", "distance", "probe", F.coalesce("root", "node").alias("root")).distinct()
        placed = materialize(placed, "jaccard-placed")
        sizes = placed.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"))
        split = sizes.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("members")).where("k > 1").drop("k")
        return materialize(placed.join(split, "sig"), "jaccard-open")

    # More stars, while many of the last ones' nodes did link: each open signature multiplies the nodes outside its main
    # component with another member of that, so a group of near copies closes up without its pairs.
    open_rows = still_open(members.withColumn("distance", F.lit(0).cast("long")).withColumn("probe", F.lit(True)), roots)
    for turn in range(MORE_STARS):
        if good < WORTH or good_links < FEW_LINKS:
            break
        centers = open_rows.where("root = main").groupBy("sig").agg(F.max_by("node", F.xxhash64("node", "sig", F.lit(turn))).alias("b"))
        tried = candidates(open_rows.where("root <> main").join(centers, "sig").select(F.col("node").alias("a"), "b").distinct())
        fresh, good, good_links = verified(tried, f"jaccard-star{turn}")
        links = links.union(fresh)
        roots = materialize(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(fresh), "a", "b", "jaccard-cc"), "jaccard-roots")
        open_rows = still_open(open_rows, roots)

    # Signatures with many members left: all are multiplied with one member, and those that link without it meet again
    # in a smaller group, that of a difference from it.
    is_large, small = F.col("members") > SIDES * SIDE, []
    for turn in range(REFINE):
        large = open_rows.where(is_large)
        if large.isEmpty():
            break
        small.append(open_rows.where(~is_large))
        common = large.where("root = main").groupBy("node").agg(F.count(F.lit(1)).alias("_n"))  # a node in many of them is near many
        centers = large.where("root = main").join(common, "node").groupBy("sig").agg(F.max_by("node", F.struct("_n", F.xxhash64("node", F.lit(turn)))).alias("b"))
        tried = large.join(centers, "sig").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
        tried = materialize(candidates(tried, bound=False), "jaccard-refine")
        found = _product(tried, docs, id_col, text_col, sets, num, den, differences=True)
        forget(tried)
        fresh = found.where("sig is null").select("a", "b")
        links = links.union(fresh)
        roots = materialize(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(fresh), "a", "b", "jaccard-cc"), "jaccard-roots")
        open_rows = still_open(found.where("sig is not null").withColumnRenamed("a", "node"), roots)
    if small:
        open_rows = still_open(reduce(DataFrame.union, [x.select("sig", "node", "distance", "probe") for x in (*small, open_rows)]), roots)

    # What is left: all pairs of different components within a signature, dealt over squares of its members.
    sides = F.ceil(F.col("members") / SIDE)
    every_side = F.sequence(F.lit(0).cast("long"), sides - 1)
    own_side = F.pmod(F.xxhash64("node"), sides)
    figured = open_rows.join(nodes.select("node", "n", "parity"), "node")
    a = figured.where("root <> main").withColumn("x", own_side).withColumn("y", F.explode(every_side)).alias("a")
    b = figured.withColumn("y", own_side).withColumn("x", F.explode(every_side)).alias("b")
    square = reduce(lambda p, q: p & q, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("sig", "x", "y")))
    nearer = F.struct("a.distance", "a.node") < F.struct("b.distance", "b.node")
    square &= F.when(nearer, F.col("a.probe")).otherwise(F.col("b.probe"))
    rest = a.join(b, square & (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("a.main")) | (F.col("a.node") < F.col("b.node"))) & _bound(num, den))
    rest = candidates(rest.select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b")).distinct())
    more, _, _ = verified(rest, "jaccard-rest")
    every = links.union(more)
    roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b", "jaccard-cc")

    rooted = materialize(nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "jaccard-rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "component_id")
    out = figures.join(named, "node", "left").select(F.when(F.col("known"), F.col("doc_id")).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))
    if with_links:
        ids = nodes.select("node", "doc_id")
        linked = every.join(ids.toDF("a", "id_a"), "a").join(ids.toDF("b", "id_b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        return out, linked
    return out


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)
