"""Alike sets: what the count-vector R-tree join (:mod:`.rtree`) and the weighted cosine join (:mod:`.cosine`) share.

Both work on distinct sets of runs. A set is filed under its rarest runs only: as many as it takes until the rest is too light to
reach the threshold alone. Sets that share none of these runs cannot be alike, so nothing is lost. The sets filed under one run form a
list. Lists longer than ``BLOCK`` are cut into blocks by a hash of the set, and every pair of blocks (of the two sides, where that writes
fewer rows) is a separate unit of work, so no list is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut, measured_cut, skew_safe, tidy
from . import features

BLOCK = 4096
#: Pairs looked at together in a task.
CHUNK = 1_000_000
#: Rows of the table of frequent runs that may be broadcast (12 bytes each), and up to which number of sets a run may be taken as rare so that it fits.
FREQUENT_ROWS, RARE = 1 << 17, 16


class Join:
    """What a join of alike sets provides. ``columns`` are those of a filed set besides ``key, id, flag``."""

    columns = ""

    def file(self, h, owner, pos, n, often, sets):
        """(keep, columns) of the rows (run ``h``, its set ``owner``, its place ``pos`` in the set), rarest first: which are filed, and arrays of the columns of those."""
        raise NotImplementedError

    def pairs(self, cols, lists):
        """Index pairs of whole lists that may be alike; ``lists`` are the lengths of consecutive lists."""
        raise NotImplementedError

    def verified(self, found, sets):
        """``a, b`` of the candidate pairs that are alike."""
        raise NotImplementedError

    def fitted(self, sets, rare, table):
        """The join with what it needs to know of all sets: how many there are, and the counts as :func:`counted` gives them."""
        return self


def counted(sets: DataFrame, frequent_rows: int | None = None):
    """How many sets have each run: ``(sets, table, rare, the largest count)``.

    Counts are exact, from one pre-aggregated shuffle. Runs that at most ``rare`` sets have count as equally rare; the others are a table of
    sorted runs and counts that has at most ``FREQUENT_ROWS`` rows and is broadcast. Where no ``rare`` up to ``RARE`` makes the table that
    small, the counts are joined to the runs instead: ``sets`` then has them as ``often``, ``table`` is None and ``rare`` 1.
    """
    limit = FREQUENT_ROWS if frequent_rows is None else frequent_rows
    steps = [r for r in (1, 2, 4, 8, 16) if r <= RARE]
    counts = sets.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    counts, seen = measured_cut(counts, "counts", most=F.max("n"), **{f"over{r}": F.count_if(F.col("n") > r) for r in steps})
    rare = next((r for r in steps if seen[f"over{r}"] <= limit), None)
    if rare is not None:
        t = counts.where(F.col("n") > rare).toArrow()
        runs, n = t.column("run").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(runs)
        return sets, (runs[order], np.minimum(n[order], 2**31 - 1).astype(np.int32)), rare, seen["most"] or 0
    with skew_safe(sets.sparkSession):
        each = cut(sets.select("id", F.explode("runs").alias("run")).join(counts, "run", "left").select("id", "run", F.coalesce("n", F.lit(1)).cast("int").alias("n")), "run-counts")
        lists = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "n"))).alias("r")).select("id", F.col("r.run").alias("runs"), F.col("r.n").alias("often"))
        return cut(sets.drop("runs").join(lists, "id"), "counted"), None, 1, seen["most"] or 0


def look_up(h: np.ndarray, table) -> np.ndarray:
    """Counts of runs by the table of frequent ones, 1 for others."""
    runs, n = table
    if not len(runs):
        return np.ones(len(h), np.int32)
    at = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
    return np.where(runs[at] == h, n[at], 1).astype(np.int32)


def filed(sets: DataFrame, join: Join) -> tuple[DataFrame, Join, DataFrame]:
    """A row per set of ``sets(id, runs, flag)`` and run it is filed under, for lists longer than ``BLOCK`` one per pair of blocks; the fitted join; the sets as :func:`counted` gives them."""
    sets, table, rare, most = counted(sets)
    shared = sets.sparkSession.sparkContext.broadcast(table) if table is not None else None
    join = join.fitted(sets, rare, shared)
    names = ["id", "runs", "flag", *(["often"] if table is None else [])]

    def parts(batches):
        """Of each part of the sets: runs, owners, counts, and which are filed with which columns, rarest first."""
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                lists = part.column(1)
                n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                h = lists.flatten().to_numpy(zero_copy_only=False)
                often = part.column(3).flatten().to_numpy(zero_copy_only=False) if shared is None else look_up(h, shared.value)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, often, owner))
                h, often = h[order], often[order]
                pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                yield part, h, owner, often, *join.file(h, owner, pos, n, often)

    def run(batches):
        for part, h, owner, _, keep, cols in parts(batches):
            at = pa.array(owner[keep])
            own = features.mix64(features.text_hash(part.column(0).to_pylist())).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), part.column(0).take(at), part.column(2).take(at), pa.array(own[owner[keep]]), *cols.values()], names=["key", "id", "flag", "own", *cols])

    rows = sets.select(*names).mapInArrow(run, f"key long, id string, flag int, own long, {join.columns}")
    if most <= BLOCK:  # no list can be longer
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)}).drop("own"), join, sets
    block = BLOCK

    def frequent(batches):
        for part, h, owner, often, keep, _ in parts(batches):
            if block >= rare:
                keep = keep[often[keep] > block]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), part.column(2).take(pa.array(owner[keep]))], names=["key", "flag"])

    # Only runs that more than BLOCK sets have can make longer lists: these are counted first, and the rows are made again, so that they are written once, by the shuffle of `candidates`.
    bit = lambda k: F.col("flag").bitwiseAND(k) > 0
    long = sets.select(*names).mapInArrow(frequent, "key long, flag int").groupBy("key").agg(F.count("*").alias("n_key"), F.count_if(bit(1)).alias("n1"), F.count_if(bit(2)).alias("n2")).where(F.col("n_key") > BLOCK)
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    long = cut(long.select("key", "n_key", "n1", "n2", blocks("n_key").alias("blocks"), blocks("n1").alias("b1"), blocks("n2").alias("b2")), "long")
    long = long.select("key", "blocks", "b1", "b2", (F.col("n1") * F.col("b2") + F.col("n2") * F.col("b1") < F.col("n_key") * F.col("blocks")).alias("sides"))
    return _dealt(rows.join(checked_broadcast(long), "key", "left")), join, sets


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of long lists once for each unit of work ``i, j``: pairs of blocks, or, with ``sides``, a block of one side and one of the other, which writes each row only as often as the other side has blocks."""
    unit = lambda i, j, side, flag: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"), flag.cast("int").alias("flag"))
    zero, flag = F.lit(0), F.col("flag")
    own = lambda c: F.pmod("own", F.col(c))
    upto = lambda c: F.sequence(zero, F.col(c) - 1)
    both = F.transform(upto("blocks"), lambda x: unit(F.least(own("blocks"), x), F.greatest(own("blocks"), x), own("blocks") == F.greatest(own("blocks"), x), flag))
    first = F.transform(upto("b2"), lambda x: unit(own("b1"), x, zero, F.lit(1)))
    second = F.transform(upto("b1"), lambda x: unit(x, own("b2"), F.lit(1), F.lit(2)))
    sided = F.when(flag == 3, F.concat(first, second)).when(flag == 1, first).when(flag == 2, second).otherwise(F.slice(first, 1, 0))
    units = F.when(F.col("blocks").isNull(), F.array(unit(zero, zero, zero, flag))).when(F.col("sides"), sided).otherwise(both)
    rest = [c for c in rows.columns if c not in ("flag", "own", "blocks", "b1", "b2", "sides")]
    return rows.select(*rest, F.explode(units).alias("u")).select(*rest, "u.*")


def candidates(rows: DataFrame, join: Join) -> DataFrame:
    """Distinct ``a, b`` (a < b) that pass all bounds."""
    plain = [c for c, t in rows.dtypes if c not in ("id",) and t != "binary"]
    packed = [c for c, t in rows.dtypes if t == "binary"]

    def run(batches):
        kept = None

        def emit(t: pa.Table):
            cols = {c: t.column(c).to_numpy() for c in plain}
            new = np.ones(t.num_rows, bool)
            new[1:] = False
            for c in ("key", "i", "j"):
                new[1:] |= cols[c][1:] != cols[c][:-1]
            lists = np.diff(np.r_[np.flatnonzero(new), t.num_rows])
            whole = np.repeat(lists > 1, lists)  # a run that one set has makes no pair
            if not whole.any():
                return
            t = t.filter(pa.array(whole)).combine_chunks()
            cols = {c: v[whole] for c, v in cols.items()} | {c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in packed}
            ids = t.column("id").combine_chunks()
            for s, o in join.pairs(cols, lists[lists > 1]):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(s)), ids.take(pa.array(o))], names=["a", "b"])

        held = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            held += batch.num_rows
            if held < 100_000:
                continue
            key = np.stack([kept.column(c).to_numpy() for c in ("key", "i", "j")])
            last = np.flatnonzero((key != key[:, -1:]).any(0))
            if len(last):
                whole = int(last[-1]) + 1
                yield from emit(kept.slice(0, whole))
                kept = kept.slice(whole).combine_chunks()
            held = 0 if not len(last) else kept.num_rows
        if kept is not None and kept.num_rows:
            yield from emit(kept)

    pairs = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n").mapInArrow(run, "a string, b string")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def apart(cols, s, t) -> np.ndarray:
    """Whether index pairs belong together: from different blocks (or one block with itself) and from sides that are compared."""
    flag = cols["flag"]
    ok = (cols["i"][s] == cols["j"][s]) | (cols["side"][s] != cols["side"][t])
    return ok & (((flag[s] & 1) & (flag[t] >> 1)) | ((flag[t] & 1) & (flag[s] >> 1)) > 0)


@tidy
def alike(sets: DataFrame, join: Join) -> DataFrame:
    """``a, b`` (a < b) of all alike pairs of ``sets(id, runs, flag)``: one with bit 0 of ``flag`` and one with bit 1 (3 is both). Ids are unique, runs distinct and not empty."""
    rows, join, sets = filed(sets, join)
    with skew_safe(sets.sparkSession):
        found = cut(candidates(rows, join), "candidates")
        return cut(join.verified(found, sets), "alike")


def classes(items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of ``items(sample_id, keys...)``: one class per distinct key, named by its smallest sample. Members ``sample_id, id`` and classes ``keys..., id, copies``."""
    sizes = cut(items.groupBy(*keys).agg(F.min("sample_id").alias("id"), F.count("*").alias("copies")), "classes")
    return cut(items.join(sizes.select(*keys, "id"), keys).select("sample_id", "id"), "members"), sizes


#: Members of a class that one task pairs with another member at a time.
SPREAD = 2000


def expand(pairs: DataFrame, members: DataFrame, within: DataFrame) -> DataFrame:
    """``sample_a, sample_b`` (smaller first) for all members of the class pairs ``a, b``, and of each class of ``within(id)`` with itself.

    A class's members are dealt into parts of about ``SPREAD``, and pairs of classes into pairs of parts, so the pairs of one large
    class are made by many tasks.
    """
    sizes = cut(members.groupBy("id").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts")), "sizes")
    dealt = cut(members.join(sizes, "id").select("id", "sample_id", F.pmod(F.xxhash64("sample_id"), F.col("parts")).cast("int").alias("part")), "dealt")
    work = pairs.select("a", "b").unionByName(within.select(F.col("id").alias("a"), F.col("id").alias("b")))
    work = work.join(sizes.select(F.col("id").alias("a"), F.col("parts").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("parts").alias("nb")), "b")
    work = work.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("pa"), "nb").select("a", "b", "pa", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pb")).where("a <> b or pa <= pb")
    x = dealt.select(F.col("id").alias("a"), F.col("part").alias("pa"), F.col("sample_id").alias("x"))
    y = dealt.select(F.col("id").alias("b"), F.col("part").alias("pb"), F.col("sample_id").alias("y"))
    both = work.join(x, ["a", "pa"]).join(y, ["b", "pb"]).where("x <> y")
    return both.select(F.least("x", "y").alias("sample_a"), F.greatest("x", "y").alias("sample_b"))
