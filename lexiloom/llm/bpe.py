"""Byte-level BPE ids of a corpus by replaying the merges over its distinct words.

Documents are split into words once and written in blocks: a block has its distinct words, and each of its documents is a list of
places among them. The words of all blocks are partitioned and sorted by word, so equal words meet and each distinct word is replayed
once, however many documents and blocks have it: the words' bytes are laid out as one array with links to the previous and next
living symbol, and an inverted index leads from a merge's rank to the positions of that pair. Merges are applied in rank order, each to all its
positions at once; only the neighbours of merged positions are looked up again. A pair that a merge creates ranks behind that merge,
so one pass over the ranks is the greedy encoding. The ids then go back to the blocks, sorted by place.

A word is one row per block that has it. So that the most frequent words make no straggler, more than ``GROUP`` blocks form several groups, and a
word is replayed once in each.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import measured_cut, tidy

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pre-tokenizer pattern of byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of distinct words replayed together, and rows read for it at most.
BLOCK_BYTES, BLOCK_ROWS = 8_000_000, 1_000_000
#: Blocks of documents among which a word is replayed once.
GROUP = 1 << 16
#: Text characters and documents after which a block of documents ends. A longer document is a block of its own.
BLOCK_CHARS, BLOCK_DOCUMENTS = 2_000_000, 4_000
SHIFT = 20


class Merges:
    """The merge table as arrays: sorted pair keys, their ranks, and by rank the two ids and the new one."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, new: np.ndarray):
        self.byte_ids, self.left, self.right, self.new = byte_ids, left, right, new
        keys = (left.astype(np.int64) << SHIFT) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        k = (a.astype(np.int64) << SHIFT) | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], -1)


@lru_cache(4)
def load_merges(path: str) -> Merges:
    """Reads a tokenizers file of the byte-level kind. Bytes outside the printable ones are written as letters from U+0100 on, in order."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab = model["vocab"]
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letter, more = {}, 256
    for b in range(256):
        letter[b], more = (chr(b), more) if b in printable else (chr(more), more + 1)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32)
    return Merges(np.array([vocab[letter[b]] for b in range(256)], dtype=np.int32), ids[:, 0], ids[:, 1], ids[:, 2])


def replay(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and the number of ids of each."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lens.sum())
    sym = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)].copy()
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(lens)[lens > 0]
    nxt[ends - 1] = -1
    prv[(ends - lens[lens > 0])] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(pos: np.ndarray) -> None:
        r = m.rank(sym[pos], sym[nxt[pos]])
        pos, r = pos[r >= 0], r[r >= 0]
        if not len(pos):
            return
        order = np.argsort(r, kind="stable")
        pos, r = pos[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for k, part in zip(r[np.r_[0, cuts]].tolist(), np.split(pos, cuts)):
            if k not in index:
                index[k] = []
                heapq.heappush(heap, k)
            index[k].append(part)

    add(np.flatnonzero(nxt >= 0))
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        a, b = m.left[r], m.right[r]
        pos = parts[0] if len(parts) == 1 and a != b else np.unique(np.concatenate(parts))
        pos = pos[alive[pos] & (sym[pos] == a)]
        q = nxt[pos]
        ok = q >= 0
        ok[ok] = sym[q[ok]] == b
        pos, q = pos[ok], q[ok]
        if not len(pos):
            continue
        if a == b:  # of overlapping pairs every second one, from the left
            fresh = np.r_[True, pos[1:] != q[:-1]]
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
            keep = (np.arange(len(pos)) - start) % 2 == 0
            pos, q = pos[keep], q[keep]
        sym[pos] = m.new[r]
        alive[q] = False
        after = nxt[q]
        nxt[pos] = after
        more = after >= 0
        prv[after[more]] = pos[more]
        before = prv[pos]
        add(np.concatenate([before[before >= 0], pos[more]]))
    owner = np.repeat(np.arange(len(words)), lens)[alive]
    return sym[alive], np.bincount(owner, minlength=len(words))


def split_blocks(batches, split=regex.compile(PATTERN)):
    """Blocks of ``(key, text)`` batches: (keys, number of words of each document, places of the words, distinct words). Null and empty texts have no words."""
    keys, counts, seq, known, size = [], [], [], {}, 0

    def block():
        return pa.chunked_array(keys).combine_chunks(), np.array(counts, np.int32), np.array(seq, np.int32), list(known)

    for batch in batches:
        texts, start = batch.column(1).to_pylist(), 0
        for k, t in enumerate(texts):
            found = split.findall(t) if t else []
            seq.extend([known.setdefault(w, len(known)) for w in found])
            counts.append(len(found))
            size += len(t or "")
            if size >= BLOCK_CHARS or len(counts) >= BLOCK_DOCUMENTS:
                keys.append(batch.column(0).slice(start, k + 1 - start))
                yield block()
                keys, counts, seq, known, size, start = [], [], [], {}, 0, k + 1
        if start < len(texts):
            keys.append(batch.column(0).slice(start))
    if counts:
        yield block()


def replay_words(words: list[str], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and the number of ids of each."""
    flat, sizes, block, total = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0
    for k, w in enumerate(words):
        block.append(w.encode("utf-8", "replace"))
        total += len(block[-1])
        if total >= BLOCK_BYTES or k + 1 == len(words):
            f, n = replay(block, m)
            flat.append(f)
            sizes.append(n)
            block, total = [], 0
    return np.concatenate(flat), np.concatenate(sizes)


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat.astype(np.int32)))


def replay_sorted(batches, m: Merges, only_count: bool):
    """``block, place, x`` of rows (word, block, place) sorted by word: x is the word's ids or their number. Each distinct word is replayed once."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        runs = pc.run_end_encode(t.column("word").chunk(0))
        flat, n = replay_words(runs.values.to_pylist(), m)
        at = pa.array(np.repeat(np.arange(len(n)), np.diff(np.r_[0, runs.run_ends.to_numpy()])))
        x = pa.array(n.astype(np.int32)) if only_count else _lists(flat, n)
        return pa.RecordBatch.from_arrays([t.column("block").chunk(0), t.column("place").chunk(0), x.take(at)], names=["block", "place", "x"])

    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.column(0).nbytes
        if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield emit(held)
            held, rows, size = [], 0, 0
    if rows:
        yield emit(held)


def _complete(batches):
    """Tables of whole blocks from batches sorted by (block, place): each begins with the row of its documents, at place -1."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        starts = np.flatnonzero(held.column("place").to_numpy() == -1)
        for a, b in zip(starts[:-1], starts[1:]):
            yield held.slice(a, b - a)
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


@tidy
def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json", only_count: bool = False) -> DataFrame:
    """``key, ids`` (or ``key, n_tokens``) of every row, without special tokens; their strings in a text are ordinary text.

    Null and empty texts have the empty list (0 tokens). Repeated rows stay repeated. ``path`` is the tokenizer file; its
    merge table (fixed size) is broadcast.
    """
    spark = documents.sparkSession
    merges = spark.sparkContext.broadcast(load_merges(path))
    kind = documents.schema[key].dataType.simpleString()

    def blocks(batches):
        part = TaskContext.get().partitionId()
        for k, (keys, counts, seq, words) in enumerate(split_blocks(batches)):
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), one(keys), one(pa.array(counts)), one(pa.array(seq)), one(pa.array(words, pa.string()))], names=["block", "keys", "counts", "seq", "words"])

    text_column = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    held, seen = measured_cut(text_column.mapInArrow(blocks, f"block long, keys array<{kind}>, counts array<int>, seq array<int>, words array<string>"), "blocks")
    groups = -(-seen["n"] // GROUP)
    places = held.select("block", F.posexplode("words").alias("place", "word")).select("word", "block", "place", F.pmod(F.xxhash64("block"), F.lit(max(1, groups))).alias("g"))
    kind_x = "int" if only_count else "array<int>"
    found = places.repartition("word", "g").sortWithinPartitions("g", "word").select("word", "block", "place").mapInArrow(lambda b: replay_sorted(b, merges.value, only_count), f"block long, place int, x {kind_x}")
    # Empty lists, not nulls: Spark's Arrow writer passes over all nulls since the last list at each row.
    none = lambda c: F.expr(f"cast(array() as {held.schema[c].dataType.simpleString()})").alias(c)
    documents_of = held.select("block", F.lit(-1).alias("place"), "keys", "counts", "seq", F.lit(0).alias("x") if only_count else F.expr("cast(array() as array<int>)").alias("x"))
    both = documents_of.unionByName(found.select("block", "place", none("keys"), none("counts"), none("seq"), "x")).repartition("block").sortWithinPartitions("block", "place")

    def join(batches):
        for t in _complete(batches):
            keys, counts, seq = (t.column(c).chunk(0)[0].values for c in ("keys", "counts", "seq"))
            counts, seq = counts.to_numpy(), seq.to_numpy()
            owner = np.repeat(np.arange(len(counts)), counts)
            x = t.column("x").slice(1).combine_chunks()
            if only_count:
                n = np.bincount(owner, weights=x.to_numpy()[seq], minlength=len(counts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n)], names=[key, "n_tokens"])
                continue
            size = pc.list_value_length(x).to_numpy().astype(np.int64)
            start, reps = np.cumsum(size) - size, size[seq]
            shift = np.repeat(start[seq] - (np.cumsum(reps) - reps), reps)
            n = np.bincount(owner, weights=reps, minlength=len(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys, _lists(x.flatten().to_numpy()[shift + np.arange(len(shift))], n)], names=[key, "ids"])

    return both.mapInArrow(join, f"{key} {kind}, " + ("n_tokens long" if only_count else "ids array<int>"))
