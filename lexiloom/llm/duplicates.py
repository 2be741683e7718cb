"""Near-duplicate samples, and overlaps between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut, skew_safe, tidy
from . import cosine, features, graph, looks, rtree, similar, splits

TEXT_ALIKE, SPEECH_ALIKE = 0.6, 0.8


def sample_letters(samples: DataFrame, form: looks.Form) -> DataFrame:
    """``sample_id, letters``: each distinct text in its one form, lower case, letters and digits only; texts without any are left out."""
    t = samples.select("sample_id", "text").where("sample_id is not null and text is not null").distinct()

    @F.pandas_udf("string")
    def letters(s):
        return s.map(lambda x: looks.bare(form(x)))

    return t.select("sample_id", letters("text").alias("letters")).where("letters <> ''").distinct()


def sample_sequences(tokens: DataFrame, inventory: DataFrame, form: looks.Form) -> DataFrame:
    """``sample_id, codes``: hashes of each sample's phonemes by token_index, each index once (the smallest, should they differ), as inventory symbols, without silences. Samples with none are left out; so are null phonemes."""
    symbols = cut(looks.phoneme_map(tokens, inventory, form), "symbols")
    silent = inventory.where("articulatory_type = 'silence'").select(F.col("phoneme").alias("symbol")).distinct()
    rows = tokens.select("sample_id", "token_index", "phoneme").where("sample_id is not null and token_index is not null and phoneme is not null")
    rows = rows.join(checked_broadcast(symbols), "phoneme", "left").select("sample_id", "token_index", F.coalesce("symbol", "phoneme").alias("symbol"))
    rows = rows.join(checked_broadcast(silent), "symbol", "left_anti")
    each = rows.groupBy("sample_id", "token_index").agg(F.min(F.xxhash64("symbol")).alias("code"))
    inner = F.array_sort(F.collect_list(F.struct("token_index", "code")))
    return each.groupBy("sample_id").agg(inner.alias("t")).select("sample_id", F.col("t.code").alias("codes"))


def _text_sets(samples: DataFrame, form: looks.Form):
    items = cut(sample_letters(samples, form), "letters")
    members, sizes = similar.classes(items, ["letters"])
    return members, sizes, sizes.select("id", "letters")


def alike_texts(samples: DataFrame, form: looks.Form) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Class pairs, members, and classes with copies."""
    members, sizes, letters = _text_sets(samples, form)
    sets = cut(features.text_runs(letters).withColumn("flag", F.lit(3)), "sets")
    return similar.alike(sets, rtree.RTree(TEXT_ALIKE)), members, sizes.where("copies > 1").select("id")


def alike_speech(tokens: DataFrame, inventory: DataFrame, form: looks.Form) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of phoneme sequences. Equal sequences are recognised by two 64-bit hashes."""
    seqs = cut(sample_sequences(tokens, inventory, form).select("sample_id", "codes", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit(1), "codes").alias("h2")), "sequences")
    members, sizes = similar.classes(seqs.select("sample_id", "h1", "h2"), ["h1", "h2"])
    one = seqs.join(sizes.select(F.col("id").alias("sample_id")), "sample_id").select(F.col("sample_id").alias("id"), "codes")
    sets = cut(features.sequence_runs(one).withColumn("flag", F.lit(3)), "sets")
    return similar.alike(sets, rtree.RTree(SPEECH_ALIKE)), members, sizes.where("copies > 1").select("id")


@tidy
def near_duplicates(samples: DataFrame, tokens: DataFrame, inventory: DataFrame) -> DataFrame:
    """``sample_a, sample_b``: samples whose texts or phoneme sequences are alike, each pair once."""
    form = looks.learn_form(samples, "text")
    out = similar.expand(*alike_texts(samples, form)).unionByName(similar.expand(*alike_speech(tokens, inventory, form)))
    return out.distinct()


@tidy
def duplicate_groups(samples: DataFrame, tokens: DataFrame, inventory: DataFrame) -> DataFrame:
    """``sample_id, group_id, links`` of every sample: its group's smallest sample over all alike pairs, and the number of alike classes its own is linked to. Copies are not expanded into pairs."""
    form = looks.learn_form(samples, "text")
    edges, links = None, None
    for pairs, members, _ in (alike_texts(samples, form), alike_speech(tokens, inventory, form)):
        e = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(members.select(F.col("sample_id").alias("u"), F.col("id").alias("v")))
        n = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
        m = members.join(n, "id", "left").select("sample_id", F.coalesce("k", F.lit(0)).alias("k"))
        edges, links = (e, m) if edges is None else (edges.unionByName(e), links.unionByName(m))
    labels = graph.hook_and_shortcut(edges)
    every = samples.select("sample_id").unionByName(tokens.select("sample_id")).where("sample_id is not null").distinct()
    links = links.groupBy("sample_id").agg(F.sum("k").alias("links"))
    return every.join(labels.withColumnRenamed("x", "sample_id"), "sample_id", "left").join(links, "sample_id", "left").select("sample_id", F.coalesce("p", "sample_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


@tidy
def split_overlaps(samples: DataFrame, members: DataFrame) -> DataFrame:
    """``sample_a, sample_b, train_sample, other_sample, other_split``: each pair of a sample now in train and one now in another split whose texts are alike."""
    form = looks.learn_form(samples, "text")
    now = cut(splits.current_splits(members).where("split_name in ('train', 'validation', 'test')"), "splits")
    inside, sizes, letters = _text_sets(samples.join(now, "sample_id", "left_semi"), form)
    side = F.when(F.col("split_name") == "train", 1).otherwise(2)
    sided = cut(inside.join(now.select("sample_id", "split_name", side.alias("side")), "sample_id"), "sided")
    flags = sided.groupBy("id").agg(F.bit_or("side").alias("flag"))
    sets = cut(features.text_runs(letters).join(flags, "id"), "sets")
    pairs = similar.alike(sets, cosine.Cosine(TEXT_ALIKE))
    both = flags.where("flag = 3").select(F.col("id").alias("a"), F.col("id").alias("b"))
    ways = pairs.unionByName(both).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parts = cut(sided.groupBy("id", "side").agg(F.ceil(F.count("*") / similar.SPREAD).cast("int").alias("parts")), "parts")
    dealt = cut(sided.join(parts, ["id", "side"]).select("id", "side", "sample_id", "split_name", F.pmod(F.xxhash64("sample_id"), F.col("parts")).cast("int").alias("part")), "dealt")
    work = ways.join(parts.where("side = 1").select(F.col("id").alias("a"), F.col("parts").alias("na")), "a").join(parts.where("side = 2").select(F.col("id").alias("b"), F.col("parts").alias("nb")), "b")
    work = work.select("a", "b", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("p")).select("a", "b", "p", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("q"))
    x = dealt.where("side = 1").select(F.col("id").alias("a"), F.col("part").alias("p"), F.col("sample_id").alias("train_sample"))
    y = dealt.where("side = 2").select(F.col("id").alias("b"), F.col("part").alias("q"), F.col("sample_id").alias("other_sample"), F.col("split_name").alias("other_split"))
    out = work.join(x, ["a", "p"]).join(y, ["b", "q"]).where("train_sample <> other_sample")
    return out.select(F.least("train_sample", "other_sample").alias("sample_a"), F.greatest("train_sample", "other_sample").alias("sample_b"), "train_sample", "other_sample", "other_split").distinct()


def overlap_report(overlaps: DataFrame, origins: DataFrame) -> DataFrame:
    """``split_name, source, pairs, samples``: overlaps and overlapping samples of each split other than train, by the sample's source (null if unknown; a sample with two sources counts for both)."""
    source = origins.select(F.col("sample_id").alias("other_sample"), "source").distinct()
    per = overlaps.groupBy("other_split", "other_sample").agg(F.count("*").alias("pairs"))
    return per.join(source, "other_sample", "left").groupBy(F.col("other_split").alias("split_name"), "source").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("samples"))
