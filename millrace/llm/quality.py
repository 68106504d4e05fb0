"""Operator 5: quality by an interpolated modified Kneser-Ney model of text in UTF-8.

Trusted text (labelled good and not toxic, nine tenths of it by a hash of the id) gives counts of 5-grams
of bytes; lower orders use continuation counts, discounts are Chen and Goodman's D1, D2, D3+. Bytes keep every
character of every script apart, so a 5-gram is an exact 40-bit number; the byte 255, which UTF-8 never
holds, stands before a text. Counts are sharded by the hash of the third and fourth byte: that shard
then holds all that orders 3 to 5 need for a 5-gram; orders 1 and 2 are one dense table of 256 x 256 numbers (256 kB,
whatever the input), which is broadcast.

A pair of bytes can have a hot shard, but not an unbounded group: counts are merged in levels of about MERGE rows each, what a shard
holds is bounded by its distinct 5-grams, and what asks for it is dealt over salts of about MERGE blocks, each with a copy of the shard.

Scoring is a sharded count join. Documents are packed into numbered blocks, which are shuffled once by their number.
Every block asks each shard once for its distinct 5-grams, the shards answer with log-probabilities in the same order,
and the answers meet the block again. Perplexity is per character (the product over a text's bytes, to the power of one over its characters).

A document is kept if its perplexity is at most a quantile of the held-out tenth of
trusted documents of its language (of all languages, where fewer than ``least`` are held out). Of ``quantiles`` that one
is taken whose cuts reject the most documents labelled junk or toxic, less the held-out trusted ones they reject (as shares);
the last one, times ``slack``, where fewer than ``least`` labelled bad documents are scored and nothing tells. All counts and quantiles cover all documents.

Null and empty texts have no perplexity and are rejected; null languages form one group; without any
held-out text nothing else is rejected. Repeated ids are scored one by one; a repeated or contradicted label is not trusted
unless all its rows are good.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import U64, hint_small, materialize, mix, slices, table, text_buffers, tidy, trim

ORDER, BITS = 5, 8
CLASSES = 1 << BITS
MASK = [U64((1 << BITS * n) - 1) for n in range(ORDER + 1)]
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
SHIFT = U64(BITS)
START = 255
N_SHARDS = 48
#: Text after which a task that counts has sent its shards at least once, about.
TASK_BYTES = 64 << 20
#: Rows of a shard that are merged, and blocks that a copy of it answers, in one group.
MERGE = 256


def grams(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The 5-gram that ends at each byte of data[lo:hi]; documents begin at ``offsets``, with START before them."""
    n = ORDER - 1
    part = np.full(n + hi - lo, START, np.uint8)
    some = min(lo, n)
    part[n - some :] = data[lo - some : hi]
    part = part.astype(np.uint64)
    code = part[n:].copy()
    for k in range(1, ORDER):
        code |= part[n - k : -k] << U64(BITS * k)
    begin = offsets[:-1]
    begin = begin[np.searchsorted(begin, lo - n, "right") : np.searchsorted(begin, hi)]
    for j in range(n - 1, -1, -1):  # a later document's first bytes are set after those of a short one before it
        at = begin + (j - lo)
        at = at[(at >= 0) & (at < hi - lo)]
        code[at] = code[at] & MASK[j + 1] | MASK[ORDER] & ~MASK[j + 1]
    return code


def pieces(offsets: np.ndarray):
    """(lo, hi) byte ranges of about SLICE_BYTES over all documents; long documents are cut."""
    for lo in range(int(offsets[0]), int(offsets[-1]), SLICE_BYTES):
        yield lo, min(lo + SLICE_BYTES, int(offsets[-1]))


def shard_of(codes: np.ndarray, n_shards: int) -> np.ndarray:
    return (mix(codes >> SHIFT & MASK[2]) % U64(n_shards)).astype(np.int64)


def by_shard(codes: np.ndarray, n_shards: int):
    """(order, [(shard, lo, hi)]): distinct ascending codes grouped by shard."""
    shards = shard_of(codes, n_shards)
    order = np.argsort(shards, kind="stable")
    edges = np.searchsorted(shards[order], np.arange(n_shards + 1))
    return order, [(s, int(edges[s]), int(edges[s + 1])) for s in range(n_shards) if edges[s] < edges[s + 1]]


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    return codes[at], (np.add.reduceat(counts, at) if len(at) else counts)


def distinct_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct 5-grams of a block, ascending."""
    parts = [np.unique(grams(data, offsets, lo, hi)) for lo, hi in pieces(offsets)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, U64)


def discounts(n: list[int]) -> np.ndarray:
    """[0, D1, D2, D3+] from the numbers of n-grams seen once to four times; half the count where the estimate is not inside (0, count]."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return np.array([0.0, *(d if 0 < d <= i else i / 2 for i, d in enumerate(raw, 1))])


class Level:
    """One order's counts, with the totals and discount mass of every context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, d: np.ndarray):
        self.codes, self.counts, self.d = codes, counts, d
        context = codes >> SHIFT
        at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(codes) else np.empty(0, np.int64)
        self.contexts = context[at]
        if len(at):
            self.totals = np.add.reduceat(counts, at).astype(np.float64)
            self.mass = np.add.reduceat(d[np.minimum(counts, 3)], at)

    def interpolate(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """p(last | the rest) of the keys, from the probabilities of the next lower order."""
        if not len(self.codes):
            return lower
        context = keys >> SHIFT
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[at] == context
        j = np.minimum(np.searchsorted(self.codes, keys), len(self.codes) - 1)
        count = np.where(self.codes[j] == keys, self.counts[j], 0)
        p = (np.maximum(count - self.d[np.minimum(count, 3)], 0) + self.mass[at] * lower) / self.totals[at]
        return np.where(known, p, lower)


def continuations(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the distinct characters before each (order - 1)-gram, from distinct order-grams."""
    return np.unique(codes & MASK[order - 1], return_counts=True)


def low_orders(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Dense p(b | a) of orders 2 and 1, from the continuation counts of pairs."""
    ones, one_counts = continuations(pairs, 2)
    p1 = np.full(CLASSES, 1.0 / CLASSES)
    if len(ones):
        d = discounts([int((one_counts == k).sum()) for k in (1, 2, 3, 4)])
        total = one_counts.sum()
        p1 = np.full(CLASSES, d[np.minimum(one_counts, 3)].sum() / total / CLASSES)
        p1[ones.astype(np.int64)] += (one_counts - d[np.minimum(one_counts, 3)]) / total
    level = Level(pairs, counts, discounts([int((counts == k).sum()) for k in (1, 2, 3, 4)]))
    every = np.arange(CLASSES * CLASSES, dtype=np.uint64)
    return level.interpolate(every, np.tile(p1, CLASSES)).astype(np.float32)


def _seen(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _train(trusted: DataFrame, n_shards: int, rows: int) -> DataFrame:
    """Stored shards of 5-gram counts of ``trusted`` (text): shard, codes, counts, seen (12 numbers), pairs, pair_counts.

    ``rows`` is about how many rows of a shard the tasks send; they are merged in levels of about MERGE rows a group.
    """

    def send(parts, seq):
        import pyarrow as pa
        from pyspark import TaskContext

        codes, counts = merge_counts(parts)
        order, runs = by_shard(codes, n_shards)
        return _rows(pa, runs, codes[order], counts[order], [TaskContext.get().partitionId() << 32 | seq] * len(runs))

    def count(batches):
        parts, seq = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for lo, hi in pieces(offsets):
                parts.append(np.unique(grams(data, offsets, lo, hi), return_counts=True))
                if len(parts) == 16:
                    parts = [merge_counts(parts)]
                if len(parts[0][0]) > 1 << 21:
                    yield send(parts, seq)
                    parts, seq = [], seq + 1
        if parts:
            yield send(parts, seq)

    def read(group):
        return merge_counts([(np.frombuffer(c.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)) for c, n in zip(group.column("codes"), group.column("counts"), strict=True)])

    def add(group):
        import pyarrow as pa

        codes, counts = read(group)
        return pa.Table.from_batches([_rows(pa, [(group.column("shard")[0].as_py(), 0, len(codes))], codes, counts, [group.column("part")[0].as_py()])])

    def finish(group):
        import pyarrow as pa

        codes, counts = read(group)
        fours, four_counts = continuations(codes, 5)
        threes, three_counts = continuations(fours, 4)
        pairs, pair_counts = continuations(threes, 3)
        seen = _seen(counts) + _seen(four_counts) + _seen(three_counts)
        return pa.table({"shard": group.column("shard").slice(0, 1), "codes": pa.array([codes.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "seen": pa.array([seen], pa.list_(pa.int64())), "pairs": pa.array([pairs.tobytes()], pa.binary()), "pair_counts": pa.array([pair_counts.astype(np.int64).tobytes()], pa.binary())})

    schema = "shard int, part long, codes binary, counts binary"
    sent = trusted.mapInArrow(tidy(count), schema)
    while rows > MERGE:
        rows = -(-rows // MERGE)
        sent = sent.groupBy("shard", F.pmod(F.xxhash64("part"), F.lit(rows)).alias("salt")).applyInArrow(add, schema)
    return materialize(sent.groupBy("shard").applyInArrow(finish, "shard int, codes binary, counts binary, seen array<long>, pairs binary, pair_counts binary"), "kn-counts")


def _rows(pa, runs, codes: np.ndarray, counts: np.ndarray, part: list[int]):
    """One row for each (shard, lo, hi) of ``runs``."""
    columns = [pa.array([r[0] for r in runs], pa.int32()), pa.array(part, pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in runs], pa.binary()) for x in (codes, counts.astype(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "part", "codes", "counts"])


def _statistics(shards: DataFrame):
    """(12 numbers of n-grams seen 1..4 times for orders 5, 4, 3; dense low orders). At most CLASSES**2 pairs reach the driver."""

    def pairs(batches):
        import pyarrow as pa

        for batch in batches:
            for p, n in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(p.as_buffer(), np.uint64).astype(np.int64)), pa.array(np.frombuffer(n.as_buffer(), np.int64))], names=["pair", "n"])

    total = shards.agg(*[F.sum(F.col("seen")[i]).alias(f"s{i}") for i in range(12)]).first()
    got = shards.select("pairs", "pair_counts").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toPandas()
    return [x or 0 for x in total], low_orders(got["pair"].to_numpy(np.uint64), got["n"].to_numpy(np.int64))


def perplexities(docs: DataFrame, trusted_text: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` plus n_scored and perplexity of every row of ``docs``; trained on ``trusted_text`` (one string column)."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = _train(trusted_text, N_SHARDS, n_bytes // TASK_BYTES)
    seen, low = _statistics(shards)
    shared = spark.sparkContext.broadcast((seen, low))
    salts = max(1, -(-n_bytes // (BLOCK_BYTES * MERGE)))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, BLOCK_BYTES, 1 << 20):
                piece = pa.RecordBatch.from_arrays(list(batch.slice(i, j - i).columns), names=batch.schema.names)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([pack(piece)], pa.binary())], names=["block_id", "payload"])
                seq += 1

    def texts(group):
        batch = unpack(group.column("payload")[0].as_buffer())
        return batch, *text_buffers(batch.column(len(columns)))

    def ask(key, group):
        import pyarrow as pa

        _, data, offsets = texts(group)
        codes = distinct_grams(data, offsets)
        order, runs = by_shard(codes, N_SHARDS)
        codes, block_id = codes[order], key[0].as_py()
        return pa.table({"shard": pa.array([r[0] for r in runs], pa.int32()), "salt": pa.array([block_id % salts] * len(runs), pa.int64()), "block_id": pa.array([block_id] * len(runs), pa.int64()), "asked": pa.array([codes[a:b].tobytes() for _, a, b in runs], pa.binary())})

    def answer(key, left, right):
        import pyarrow as pa

        seen, low = shared.value
        d5, d4, d3 = (discounts(seen[k : k + 4]) for k in (0, 4, 8))
        if left.num_rows:
            codes = np.frombuffer(left.column("codes")[0].as_buffer(), np.uint64)
            counts = np.frombuffer(left.column("counts")[0].as_buffer(), np.int64)
        else:
            codes, counts = np.empty(0, U64), np.empty(0, np.int64)
        fours, four_counts = continuations(codes, 5)
        threes, three_counts = continuations(fours, 4)
        levels = [(Level(threes, three_counts, d3), 3), (Level(fours, four_counts, d4), 4), (Level(codes, counts, d5), 5)]
        out = []
        for x in right.column("asked"):
            r = np.frombuffer(x.as_buffer(), np.uint64)
            p = low[(r & MASK[2]).astype(np.int64)].astype(np.float64)
            for level, n in levels:
                p = level.interpolate(r & MASK[n], p)
            out.append(np.log(p).astype(np.float32).tobytes())
        return pa.table({"shard": right.column("shard"), "block_id": right.column("block_id"), "logs": pa.array(out, pa.binary())})

    def score(key, left, right):
        import pyarrow as pa

        batch, data, offsets = texts(left)
        codes = distinct_grams(data, offsets)
        order, runs = by_shard(codes, N_SHARDS)
        logs = np.empty(len(codes))
        got = dict(zip(right.column("shard").to_pylist(), right.column("logs"), strict=True))
        for s, a, b in runs:
            logs[order[a:b]] = np.frombuffer(got[s].as_buffer(), np.float32)
        look = Lookup(codes, logs)
        sums, chars = np.zeros(len(offsets)), np.zeros(len(offsets), np.int64)  # up to each document's start
        total, count = 0.0, 0
        for lo, hi in pieces(offsets):
            a, b = np.searchsorted(offsets, [lo, hi], "right")
            run = np.concatenate([[total], total + np.cumsum(look(grams(data, offsets, lo, hi)))])
            heads = np.concatenate([[count], count + np.cumsum(data[lo:hi] & 0xC0 != 0x80)])
            sums[a:b], chars[a:b] = run[offsets[a:b] - lo], heads[offsets[a:b] - lo]
            total, count = run[-1], heads[-1]
        n = np.diff(chars)
        mean = np.diff(sums) / np.maximum(n, 1)
        del look, logs, codes, data
        trim()
        return pa.table({**{c: batch.column(k) for k, c in enumerate(columns)}, "n_scored": pa.array(n, pa.int64()), "perplexity": pa.array(np.round(np.exp(-mean), 6), pa.float64(), mask=n == 0)})

    blocks = docs.select(*columns, F.col(text_col).alias("_text")).mapInArrow(tidy(number), "block_id long, payload binary").groupBy("block_id")
    asked = blocks.applyInArrow(ask, "shard int, salt long, block_id long, asked binary")
    copies = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "codes", "counts")
    answers = copies.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInArrow(answer, "shard int, block_id long, logs binary")
    return blocks.cogroup(answers.groupBy("block_id")).applyInArrow(score, f"{kinds}, n_scored long, perplexity double")


class Lookup:
    """Values of codes that are all present, by open addressing."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(codes)) - 1).bit_length())
        self.codes, self.values = codes, values
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, probe = np.arange(len(codes), dtype=np.int32), 0
        while len(left):
            s = self._slot(codes[left], probe)
            free = self.slots[s] < 0
            self.slots[s[free]] = left[free]
            left = left[self.slots[s] != left]
            probe += 1

    def _slot(self, codes: np.ndarray, probe: int) -> np.ndarray:
        h = codes * U64(0x9E3779B97F4A7C15)
        h = (h ^ h >> U64(29)) * U64(0xBF58476D1CE4E5B9) >> U64(64 - self.bits)
        return (h + U64(probe * (probe + 1) // 2) & U64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        i = self.slots[self._slot(codes, 0)]
        left, probe = np.flatnonzero(self.codes[i] != codes), 1
        while len(left):
            i[left] = self.slots[self._slot(codes[left], probe)]
            left = left[self.codes[i[left]] != codes[left]]
            probe += 1
        return self.values[i]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held_out) of the documents all of whose labels are good and not toxic."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0")
    return good.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(10)) == 0).alias("held_out"))


def bad_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that a label calls junk or toxic."""
    return labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 0) | (F.col("toxic") == 1))).select("doc_id").distinct()


def classify(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, quantiles: tuple[float, ...] = (0.95, 0.96, 0.97, 0.98, 0.99), slack: float = 1.0, least: int = 20) -> DataFrame:
    """doc_id, lang, any further ``columns``, n_scored, perplexity, threshold and keep for every row of ``docs``."""
    columns = ["doc_id", "lang", *(c for c in columns or [] if c not in ("doc_id", "lang"))]
    trusted = materialize(trusted_ids(labels), "kn-trusted")
    trusted = hint_small(trusted, trusted.count())
    training = docs.join(trusted.where("not held_out"), "doc_id").select("text")
    scored = materialize(perplexities(docs, training, columns), "kn-scores")
    held = scored.join(trusted.where("held_out"), "doc_id").where("perplexity IS NOT NULL")
    cuts = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("perplexity", list(quantiles), 10_000).alias("own"))
    overall = held.agg(F.percentile_approx("perplexity", list(quantiles), 10_000).alias("overall"))
    cuts = materialize(cuts, "kn-cuts")
    small_cuts = hint_small(cuts, cuts.count(), 10_000).withColumnRenamed("lang", "_lang")

    def with_cuts(rows: DataFrame) -> DataFrame:
        both = rows.join(small_cuts, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall))
        return both.withColumn("_cuts", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("overall")))

    bad = scored.join(bad_ids(labels), "doc_id").where("perplexity IS NOT NULL").select("lang", "perplexity", F.lit(1).alias("_bad"))
    tried = with_cuts(bad.union(held.select("lang", "perplexity", F.lit(0))))
    over = [F.avg((F.col("perplexity") > F.col("_cuts")[i]).cast("int")).alias(f"r{i}") for i in range(len(quantiles))]
    shares = {r["_bad"]: r for r in tried.groupBy("_bad").agg(F.count(F.lit(1)).alias("n"), *over).collect()}
    at, times = len(quantiles) - 1, slack
    if 0 in shares and 1 in shares and shares[1]["n"] >= least:
        at, times = max(range(len(quantiles)), key=lambda i: (shares[1][f"r{i}"] - shares[0][f"r{i}"], i)), 1.0
    cut = with_cuts(scored)
    threshold = F.round(F.col("_cuts")[at] * times, 6)
    out = cut.withColumn("threshold", threshold)
    return out.select(*columns, "n_scored", "perplexity", "threshold", (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("keep"))


def op5_quality_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
