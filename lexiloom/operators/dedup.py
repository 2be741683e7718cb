"""Exact and near duplicates of sentences by their phonemes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SILENT, text_signature
from ..storage import cut, drop_cut, measured_cut, tidy
from .components import components

# Shingle length, sketch size, largest bucket, threshold.
SHINGLE, SKETCH, BUCKET, THRESHOLD = 4, 8, 512, 0.8
#: Sets filed under one hash that are compared in one unit of work.
BLOCK = 4096
#: Rows of the table of frequent hashes that may be broadcast (16 bytes each); parities kept of a set; pairs looked at together in a task.
FREQUENT_ROWS, BITS, PAIRS = 1 << 17, 256, 1 << 20
#: Parts, by hash, in which the sets of skipped buckets are compared one after the other; each is written, and its shuffle files go, before the next.
PARTS = 2


def sequences(tokens: DataFrame) -> DataFrame:
    """``sample_id, phonemes``: phonemes by token_index; of rows with the same index the smallest phoneme. A sentence is one bounded record."""
    # Dealt by sentence first, so that both groupings need one shuffle.
    each = tokens.select("sample_id", "token_index", "phoneme").where("sample_id is not null and token_index is not null and phoneme is not null").repartition("sample_id").groupBy("sample_id", "token_index").agg(F.min("phoneme").alias("p"))
    return each.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("token_index", "p"))).alias("t")).select("sample_id", F.col("t.p").alias("phonemes"))


def shingles(phonemes: Column, size: int = SHINGLE) -> Column:
    """Distinct CRC32 values of runs of ``size`` phonemes without silence; a shorter sequence is one run (the empty one has CRC 0)."""
    p = F.filter(phonemes, lambda x: ~x.isin(*SILENT))
    crc = lambda a: F.crc32(F.encode(F.array_join(a, " "), "UTF-8"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - size + 1)), lambda i: crc(F.slice(p, i, F.lit(size))))
    return F.array_distinct(F.when(F.size(p) <= size, F.array(crc(p))).otherwise(runs))


def bottom_k(hashes: Column, k: int = SKETCH) -> Column:
    return F.slice(F.array_sort(hashes), 1, k)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def signatures(samples: DataFrame, seqs: DataFrame) -> DataFrame:
    """``sample_id, signature``: the phoneme sequence always, the text if not empty; namespaced. Samples without tokens have none, not even of their text.

    Only ids of ``seqs`` meet the texts, so the sequences are not shuffled; as both parts read ``seqs``, it should be :func:`cut`.
    """
    t = samples.groupBy("sample_id").agg(F.min("text").alias("text")).select("sample_id", F.nullif(text_signature(F.col("text")), F.lit("")).alias("text")).where("text is not null")
    texts = t.join(seqs.select("sample_id"), "sample_id", "left_semi").select("sample_id", F.concat(F.lit("t:"), "text").alias("signature"))
    return seqs.select("sample_id", F.concat(F.lit("p:"), F.array_join("phonemes", " ")).alias("signature")).unionByName(texts)


def exact_edges(sigs: DataFrame) -> DataFrame:
    """``a, b``: a star around the first member of each signature that several samples have."""
    first = cut(sigs.groupBy("signature").agg(F.min("sample_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("signature", "a"), "first")
    return sigs.join(first, "signature").where("sample_id <> a").select("a", F.col("sample_id").alias("b"))


def sketch_buckets(sets: DataFrame, k: int = SKETCH, cap: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """``id, sketch`` of the sets: their sketch hashes whose bucket has several sets, but no more than ``cap``; and the skipped buckets ``hash, n`` that exceed ``cap``."""
    sk = sets.select("id", F.explode(bottom_k(F.col("hashes"), k)).alias("hash"))
    sizes = cut(sk.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    kept = sk.join(sizes.where(F.col("n") <= cap).select("hash"), "hash").groupBy("id").agg(F.array_sort(F.collect_list("hash")).alias("sketch"))
    return kept, sizes.where(F.col("n") > cap)


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of those that more than ``rare`` sets have, in order, and ``rare``: the least power of two that leaves no more than ``FREQUENT_ROWS`` of them. All others count as equally rare."""
    steps = [1 << i for i in range(40)]
    counts = sets.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    counts, seen = measured_cut(counts, "counts", **{f"over{r}": F.count_if(F.col("n") > r) for r in steps})
    rare = next(r for r in steps if seen[f"over{r}"] <= FREQUENT_ROWS)
    t = counts.where(F.col("n") > rare).toArrow()
    hashes, n = t.column("hash").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order], rare


def _bits(h: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """``BITS`` parities of each set: bit x is the parity of the number of its hashes that fall on x. Two sets differ in no more bits than they have hashes that only one of them has."""
    odd = np.bincount(owner * BITS + (h.view(np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=sets * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(sets, BITS), axis=1)


def _packed(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Lists of hashes, one after the other, of the lengths ``n``, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, np.cumsum(n * 8)].astype(np.int32).tobytes()), pa.py_buffer(values.astype(np.int64).tobytes())])


FILED = "hash long, id string, size int, bits binary, before binary, i int, j int, own int"


def _dealt(h: np.ndarray, at: np.ndarray, ids: pa.Array, n: np.ndarray, bits: np.ndarray, before: pa.Array, long) -> pa.RecordBatch:
    """Rows of ``FILED``: set ``at`` under hash ``h``; under a long hash once for each pair of blocks that the set's own block is in."""
    blocks, own = np.ones(len(h), np.int64), np.zeros(len(h), np.int64)
    if long is not None and len(long[0]):
        k = np.minimum(np.searchsorted(long[0], h), len(long[0]) - 1)
        blocks = np.where(long[0][k] == h, long[1][k], 1)
        name = np.fromiter((zlib.crc32(x.encode()) for x in ids.to_pylist()), np.int64, len(ids))
        own = name[at] % blocks
    row = np.repeat(np.arange(len(h)), blocks)
    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine, whose = own[row], pa.array(at[row])
    i32 = lambda x: pa.array(x.astype(np.int32))
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(n), [None, pa.py_buffer(np.ascontiguousarray(bits).tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(h[row]), ids.take(whose), i32(n[at[row]]), packed.take(whose), before.take(pa.array(row)), i32(np.minimum(mine, other)), i32(np.maximum(mine, other)), i32(mine)], names=[c.split()[0] for c in FILED.split(", ")])


def _flat(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of a list column, the row of each, and how many each row has."""
    lists = part.column(column)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n), n


def _earlier(pos: np.ndarray, values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that are at ``pos`` of lists that begin at ``start``: the elements before each, one after the other, and their number."""
    at = np.repeat(start, pos) + np.arange(pos.sum()) - np.repeat(np.cumsum(pos) - pos, pos)
    return values[at], pos


def _prefix_rows(sets: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """``sets(id, hashes, sketch)`` filed under their rarest hashes, as ``FILED``; with ``counted``, ``before`` has twice the rarer hashes a set is filed under and, as odd numbers, those of its sketch (hashes are below 2^62)."""
    spark = sets.sparkSession
    hashes, often, rare = _frequent(sets)
    table = spark.sparkContext.broadcast((hashes, often))

    def filed(part):
        h, owner, n = _flat(part, "hashes")
        hashes, often = table.value
        k = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
        count = np.where(hashes[k] == h, often[k], rare) if len(hashes) else np.full(len(h), rare)
        order = np.lexsort((h, count, owner))
        h, count = h[order], count[order]
        pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        most = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
        keep = np.flatnonzero((pos < most[owner]) & ((count > 1) if rare == 1 else True))
        return h, owner, n, pos, count, keep

    def frequent(batches):
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                h, _, _, _, count, keep = filed(part)
                keep = keep[count[keep] > max(BLOCK, rare)] if rare <= BLOCK else keep
                yield pa.RecordBatch.from_arrays([pa.array(h[keep])], names=["hash"])

    # Only hashes that more than BLOCK sets have can have more than BLOCK sets filed under them: they are counted first, and the rows are made again, so that they are written once.
    long = None
    if len(often) and often.max() > BLOCK or rare > BLOCK:
        t = sets.select("hashes").mapInArrow(frequent, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).orderBy("hash").toArrow()
        long = (t.column("hash").to_numpy(), -(-t.column("n").to_numpy() // BLOCK))
    blocks = spark.sparkContext.broadcast(long)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                h, owner, n, pos, _, keep = filed(part)
                at = owner[keep]
                if counted:
                    values, m = _earlier(pos[keep], h, (np.cumsum(n) - n)[at])
                    marks, whose, each = _flat(part, "sketch")
                    start = (np.cumsum(each) - each)[at]
                    more, k = _earlier(each[at], 2 * marks + 1, start)
                    rows = np.r_[np.repeat(np.arange(len(at)), m), np.repeat(np.arange(len(at)), k)]
                    order = np.argsort(rows, kind="stable")
                    before = _packed(np.r_[2 * values, more][order], m + k)
                else:
                    before = _packed(np.zeros(0, np.int64), np.zeros(len(at), np.int64))
                yield _dealt(h[keep], at, part.column("id"), n, _bits(h, owner, len(n)), before, blocks.value)

    return sets.select("id", "hashes", *(["sketch"] if counted else [])).where(F.size("hashes") > 0).mapInArrow(run, FILED)


def _sketch_rows(sets: DataFrame) -> DataFrame:
    """``sets(id, hashes, sketch)`` filed under the hashes of their sketch, as ``FILED``; ``before`` has the smaller ones."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                h, owner, n = _flat(part, "hashes")
                keys, at, each = _flat(part, "sketch")
                start = (np.cumsum(each) - each)[at]
                values, m = _earlier(np.arange(len(keys)) - start, keys, start)
                yield _dealt(keys, at, part.column("id"), n, _bits(h, owner, len(n)), _packed(values, m), None)

    return sets.select("id", "hashes", "sketch").where("sketch is not null").mapInArrow(run, FILED)


def _met(rows: DataFrame, threshold: float, sized: bool) -> DataFrame:
    """``a, b, n`` of ``FILED`` rows: the pairs under one hash that share none of ``before``. Those that may be at or above the threshold have ``n`` 1, a row without ends has the number of all others.

    Sets of x and y hashes at the threshold differ in no more than (1 - t) / (1 + t) (x + y) of them, and their parities in no more
    bits; pairs beyond are only counted. With ``sized``, sets of sizes that cannot be alike are no pair.
    """
    most = (1 - threshold) / (1 + threshold)

    def met(t: pa.Table, first: int, upto: int, cols, bits, before, starts):
        i, j, own = cols["i"][first], cols["j"][first], cols["own"][first:upto]
        left = np.flatnonzero(own == i) + first
        right = left if i == j else np.flatnonzero(own == j) + first
        if not len(left) or not len(right):
            return
        size = cols["size"].astype(np.float64)
        n = starts[right + 1] - starts[right]
        marks = np.concatenate([before[starts[x] : starts[x + 1]] for x in right]) if n.any() else before[:0]
        order = np.argsort(marks, kind="stable")
        marks, whose = marks[order], np.repeat(np.arange(len(right)), n)[order]
        step = max(1, PAIRS // len(right))
        for k in range(0, len(left), step):
            l = left[k : k + step]
            a, b = size[l][:, None], size[right][None, :]
            ok = np.ones((len(l), len(right)), bool) if i != j else np.arange(k, k + len(l))[:, None] < np.arange(len(right))[None, :]
            if sized:
                ok &= (b >= threshold * a - 1e-9) & (a >= threshold * b - 1e-9)
            if len(marks):
                m = starts[l + 1] - starts[l]
                own = np.concatenate([before[starts[x] : starts[x + 1]] for x in l])
                low, high = np.searchsorted(marks, own, "left"), np.searchsorted(marks, own, "right")
                c = high - low
                at = np.repeat(low, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                ok[np.repeat(np.repeat(np.arange(len(l)), m), c), whose[at]] = False
            total = int(np.count_nonzero(ok))
            apart = np.zeros(ok.shape, np.uint16)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(bits[l, w][:, None] ^ bits[right, w][None, :])
            ok &= apart <= most * (a + b) + 1e-6
            x, y = np.nonzero(ok)
            yield l[x], right[y], total - len(x)

    def run(batches):
        kept, held = None, 0

        def emit(t: pa.Table):
            t = t.combine_chunks()
            cols = {c: t.column(c).to_numpy() for c in ("hash", "i", "j", "own", "size")}
            new = np.ones(t.num_rows, bool)
            new[1:] = False
            for c in ("hash", "i", "j"):
                new[1:] |= cols[c][1:] != cols[c][:-1]
            bounds = np.r_[np.flatnonzero(new), t.num_rows]
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            lists = t.column("before").to_pylist()
            starts = np.r_[0, np.cumsum([len(x) // 8 for x in lists])].astype(np.int64)
            before = np.frombuffer(b"".join(lists), np.int64)
            s, o, passed = [], [], 0
            for first, upto in zip(bounds[:-1], bounds[1:]):
                if upto - first > 1:
                    for x, y, n in met(t, first, upto, cols, bits, before, starts):
                        s.append(x)
                        o.append(y)
                        passed += n
            ids = t.column("id").combine_chunks()
            x, y = (pa.array(np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64)) for v in (s, o))
            ones = pa.array(np.ones(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([ids.take(x), ids.take(y), ones], names=["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([passed])], names=["a", "b", "n"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            held += batch.num_rows
            if held < 50_000:
                continue
            key = np.stack([kept.column(c).to_numpy().astype(np.int64) for c in ("hash", "i", "j")])
            last = np.flatnonzero((key != key[:, -1:]).any(0))
            if len(last):
                whole = int(last[-1]) + 1
                yield from emit(kept.slice(0, whole))
                kept = kept.slice(whole).combine_chunks()
            held = 0 if not len(last) else kept.num_rows
        if kept is not None and kept.num_rows:
            yield from emit(kept)

    met_rows = rows.repartition("hash", "i", "j").sortWithinPartitions("hash", "i", "j").mapInArrow(run, "a string, b string, n long")
    return met_rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").where("a is null or a <> b")


@tidy
def prefix_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Candidate pairs ``a, b`` that any pair at or above the threshold is among: sets that share one of their rarest hashes, as many of them as such a pair cannot all lack, but for those that :func:`_met` rules out.

    Hashes that many sets are filed under are cut into blocks by a hash of the set; each pair of blocks is a unit of work of its own.
    """
    rows = _prefix_rows(sets, threshold, counted=False)
    return cut(_met(rows, threshold, sized=True).where("a is not null").select("a", "b").distinct(), "candidates")


def near_pairs(sets: DataFrame, threshold: float = THRESHOLD, k: int = SKETCH, cap: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified pairs ``a, b, similarity``, candidate pairs ``a, b, n``, and skipped buckets of ``sets(id, hashes)``.

    Candidates share a sketch hash. A bucket over the cap is not expanded into its pairs but reported, and the sets in it
    get the exact prefix search instead, so the cap loses no pair the sketch would have found. Each candidate is met once, under the first hash
    both are filed under; those whose parities rule them out are no rows but counted in the ``n`` of rows without ends.
    """
    given = cut(sets, "sets")
    kept, skipped = sketch_buckets(given, k, cap)
    skipped = cut(skipped, "skipped")
    inside = given.select("id", F.explode(bottom_k(F.col("hashes"), k)).alias("hash")).join(skipped.select("hash"), "hash", "left_semi").select("id", F.lit(True).alias("inside")).distinct()
    # One copy of the sets: it has what both searches need, and the one it is made of goes.
    sets = cut(given.join(kept, "id", "left").join(inside, "id", "left"), "sketched")
    drop_cut(given)
    pairs = cut(_met(_sketch_rows(sets), threshold, sized=False), "candidates")
    if skipped.limit(1).count():
        rows = _prefix_rows(sets.where("inside"), threshold, counted=True)
        for part in range(PARTS):
            pairs = pairs.unionByName(cut(_met(rows.where(F.pmod("hash", F.lit(PARTS)) == part), threshold, sized=True), "candidates"))
    return verified(sets, pairs.where("a is not null"), threshold), pairs, skipped


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the candidate pairs at or above the threshold."""
    x, y = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", jaccard(F.col("ha"), F.col("hb")).alias("similarity")).where(F.col("similarity") >= threshold)


@tidy
def duplicate_groups(samples: DataFrame, tokens: DataFrame, threshold: float = THRESHOLD, k: int = SKETCH, cap: int = BUCKET, exact: bool = True) -> dict[str, DataFrame]:
    """Frames: ``groups(sample_id, root)`` of every sample with tokens, ``near(a, b, similarity)``, ``exact(a, b)``, ``candidates(a, b, n)``, ``skipped(hash, n)``, ``sequences(sample_id, phonemes)``.

    Near search works on one sample per phoneme sequence; copies join its group through the exact edges. ``exact`` searches by
    prefixes, which finds every pair at or above the threshold and compares fewer (``candidates`` are those compared); else sketches are compared.
    """
    seqs = cut(sequences(tokens), "sequences")
    copies = cut(exact_edges(signatures(samples, seqs)), "exact")
    one = seqs.groupBy("phonemes").agg(F.min("sample_id").alias("id"))
    sets = cut(one.select("id", shingles(F.col("phonemes")).alias("hashes")), "sets")
    if exact:
        candidates = prefix_pairs(sets, threshold).withColumn("n", F.lit(1).cast("long"))
        near, skipped = verified(sets, candidates, threshold), sets.select(F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("n")).limit(0)
    else:
        near, candidates, skipped = near_pairs(sets, threshold, k, cap)
    near = cut(near, "near")
    roots = components(copies.unionByName(near.select("a", "b")))
    groups = seqs.select("sample_id").join(roots.withColumnRenamed("id", "sample_id"), "sample_id", "left").select("sample_id", F.coalesce("root", "sample_id").alias("root"))
    return {"groups": groups, "near": near, "exact": copies, "candidates": candidates, "skipped": skipped, "sequences": seqs}


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """One row of counts: groups, redundant samples, exact and near pairs, candidates, skipped buckets, their slots and the largest."""
    g = found["groups"].agg(F.count("*").alias("samples"), F.count_distinct("root").alias("groups"))
    s = found["skipped"].agg(F.count("*").alias("skipped_buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("skipped_slots"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_bucket"))
    out = g.withColumn("redundant", F.col("samples") - F.col("groups"))
    for name, df in (("exact_pairs", found["exact"]), ("near_pairs", found["near"])):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    out = out.crossJoin(found["candidates"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_pairs")))
    return out.crossJoin(s)
