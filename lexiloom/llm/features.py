"""Sets of runs of four, hashed to 64 bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

RUN = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_sets(codes: np.ndarray, lens: np.ndarray, size: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of each sequence, one after the other in ascending order, and their number. ``codes`` are uint64; a sequence shorter than ``size`` is one run, an empty one has none."""
    n = len(codes)
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(size - 1, np.uint64)])
    start = np.cumsum(lens) - lens
    end = np.repeat(start + lens, lens)
    at = np.arange(n)
    h = np.zeros(n, np.uint64)
    for k in range(size):  # positions behind the end count as 0, which is no code
        part = np.where(at + k < end, padded[k : n + k], np.uint64(0))
        h = mix64(h * _MIX + part + np.uint64(k + 1))
    first = np.repeat(start, lens)
    keep = (at + size <= end) | (at == first)
    owner = np.repeat(np.arange(len(lens)), lens)[keep]
    h = h[keep].view(np.int64)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return h[new], np.bincount(owner[new], minlength=len(lens))


def text_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), lens


def _lists(keys: pa.Array, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(h))], names=["id", "runs"])


def text_runs(texts: DataFrame) -> DataFrame:
    """``id, runs`` of ``texts(id, letters)``."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 4000) for k in range(0, batch.num_rows, 4000)):
                yield _lists(part.column(0), *run_sets(*text_codes(part.column(1).to_pylist())))

    return texts.select("id", "letters").mapInArrow(run, "id string, runs array<long>")


def sequence_runs(sequences: DataFrame) -> DataFrame:
    """``id, runs`` of ``sequences(id, codes array<long>)``."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                lists = part.column(1)
                lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                yield _lists(part.column(0), *run_sets(codes, lens))

    return sequences.select("id", "codes").mapInArrow(run, "id string, runs array<long>")


def group_counts(h: np.ndarray, owner: np.ndarray, sets: int, groups: int) -> np.ndarray:
    """How many runs of each set fall into each of ``groups`` hashed groups, as bytes; 255 stands for 255 or more."""
    g = (h.view(np.uint64) & np.uint64(groups - 1)).astype(np.int64)
    c = np.bincount(owner * groups + g, minlength=sets * groups)
    return c.clip(max=255).astype(np.uint8).reshape(sets, groups)


def group_sums(h: np.ndarray, owner: np.ndarray, value: np.ndarray, sets: int, groups: int) -> np.ndarray:
    """Sums of ``value`` over the runs of each set in each of ``groups`` hashed groups."""
    g = (h.view(np.uint64) & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(owner * groups + g, weights=value, minlength=sets * groups).reshape(sets, groups)


def text_hash(names: list[str]) -> np.ndarray:
    """A 64-bit hash of each name."""
    codes, lens = text_codes(names)
    w = mix64(codes * _MIX + np.arange(len(codes), dtype=np.uint64) - np.repeat((np.cumsum(lens) - lens).astype(np.uint64), lens))
    total = np.r_[np.uint64(0), np.cumsum(w, dtype=np.uint64)]
    end = np.cumsum(lens)
    return total[end] - total[end - lens]
