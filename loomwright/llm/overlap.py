"""Same or near-same records across splits, by rare runs of words and content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm import wordblocks as wb
from loomwright.session import durable

WINDOW, DIVISOR = 2, 3


def _lists(values: pa.Array, offsets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), values)


def _chunk_batches(window: int, divisor: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in wb.slices(texts):
                hashes, offsets = wb.word_hashes(texts[begin:end])
                digests, lengths, at = wb.chunk_sets(hashes, offsets, window, divisor)
                runs, runs_at = wb.shingle_sets(hashes, offsets, k)
                words = offsets[1:] - offsets[:-1]
                rows = batch.slice(begin, end - begin)
                out = [rows.column(n) for n in ("space", "id", "train", "held")]
                out += [pa.array(wb.sequence_digests(hashes, offsets)), pa.array(words), _lists(pa.array(digests), at), _lists(pa.array(lengths), at), _lists(pa.array(runs), runs_at)]
                yield pa.RecordBatch.from_arrays(out, names=["space", "id", "train", "held", "sequence", "words", "chunks", "lengths", "runs"])

    return run


def cut_records(records: DataFrame, k: int = 4, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """(space, id, train, held, sequence, words, chunks, lengths, runs) of records (space, id, text, train, held), stored.

    Content-defined chunks with their summed lengths in words, runs of k words, and a digest of the sequence of words. NULL
    flags are false; rows in neither split, or with a NULL space or id, are left out.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("train", "held")]
    source = records.select(F.col("space").cast("string").alias("space"), F.col("id").cast("string").alias("id"), "text", *flags).filter("space IS NOT NULL AND id IS NOT NULL AND (train OR held)")
    schema = "space string, id string, train boolean, held boolean, sequence long, words long, chunks array<long>, lengths array<long>, runs array<long>"
    return durable(source.mapInArrow(_chunk_batches(window, divisor, k), schema))


def record_shares(cut: DataFrame) -> DataFrame:
    """(space, id, train, held, chunk_share, run_share) of cut records: how much of each is in the training split.

    chunk_share is the summed length of the record's chunks that another training record has, divided by its words;
    run_share the same of its runs. Both are 0 without words or runs. Chunks are counted per digest and joined on it, so
    copies cost a row each, however many records share a chunk.
    """
    chunks = F.arrays_zip(F.col("chunks").alias("part"), F.col("lengths").alias("length"))
    runs = F.transform("runs", lambda r: F.struct(r.alias("part"), F.lit(1).cast("long").alias("length")))
    shares = _shared(cut, chunks, "chunk_length").join(_shared(cut, runs, "run_length"), ["space", "id"], "full")
    share = [F.coalesce(F.round(F.col(f"{c}_length") / F.col(of), 9), F.lit(0.0)).alias(f"{c}_share") for c, of in (("chunk", "words"), ("run", "n"))]
    return cut.select("space", "id", "train", "held", "words", F.size("runs").alias("n")).join(shares, ["space", "id"], "left").select("space", "id", "train", "held", *share)


def cross_split_overlaps(records: DataFrame, threshold: float = 0.6, k: int = 4, window: int = WINDOW, divisor: int = DIVISOR) -> tuple[DataFrame, DataFrame]:
    """Pairs of different records, one in the training split and one in an evaluation split, that overlap.

    records: (space, id, text, train, held): only records of one `space` are compared; id is unique in its space;
    `train` and `held` tell whether the record is in the training split, in an evaluation split, or both. Rows in
    neither, with a NULL flag counting as false, or with a NULL space or id, are left out; those with fewer than k words
    (NULL and empty texts among them) are in no pair. Other columns are not looked at. Empty tables give no rows.

    Returns (pairs, members). pairs: (space, a, b, chunk_overlap, overlap), a < b, of representatives of records
    whose word sequences differ; overlap is the number of common runs of k words divided by the size of the smaller
    set of runs, at least `threshold`; chunk_overlap is the share of the smaller record's words in chunks that both
    have. members: (space, id, representative, train, held): records with one word sequence have one representative,
    the smallest id; they overlap fully, and share the pairs of their representative. So no group of copies is
    expanded into pairs here.

    Method: records are cut by content, chunks' digests are joined across the splits, and the lengths of shared chunks
    are summed up per record (record_shares). That tells how much of a record is in the other split, but chunks prove no pair: an edit
    in every chunk hides one. So for pairs the cut is as fine as it can be, behind every word: a record with n distinct runs of k words is the smaller of a pair only if the other record has at least
    `threshold` * n of them, rounded up. So all but that many, less one, of its runs are looked up among all runs of
    the records with at least as many runs, and none of its pairs can be missed. The runs left out are those that
    most records have. Runs found on one side alone can't be met and aren't looked up. For the candidates, runs are
    compared exactly, and so are content-defined chunks, for chunk_overlap.

    Scale: records are read once into a checkpoint of chunk and run digests. Runs that very many records share are
    looked up only by records that consist of such runs. All joins are on (space, run) or (space, id) and can be split
    by adaptive skew handling; nothing is collected or broadcast by hint.
    """
    cut = cut_records(records, k, window, divisor)
    long = cut.filter(F.size("runs") > 0)
    copies = durable(long.groupBy("space", "sequence", "words").agg(F.min("id").alias("rep"), F.max("train").alias("any_train"), F.max("held").alias("any_held")))
    parts = cut.select("space", "id", "train", "held", "sequence", "words", F.size("runs").alias("n")).join(copies.select("space", "sequence", "words", F.col("rep").alias("representative")), ["space", "sequence", "words"], "left")
    members = parts.select("space", "id", F.when(F.col("n") > 0, F.col("representative")).alias("representative"), "train", "held")

    reps = long.select("space", F.col("id").alias("rep"), "runs").join(copies.select("space", "rep", "any_train", "any_held"), ["space", "rep"])
    postings = reps.select("space", "rep", F.size("runs").alias("n"), "any_train", "any_held", F.explode("runs").alias("run"))
    common = postings.groupBy("space", "run").agg(F.count(F.lit(1)).alias("df"), F.max("any_train").alias("t"), F.max("any_held").alias("h")).filter("t AND h AND df > 1").select("space", "run", "df")
    postings = durable(postings.join(common, ["space", "run"]))
    place = F.row_number().over(Window.partitionBy("space", "rep").orderBy(F.desc("df"), F.desc("run")))
    # a trifle less, so that rounding can't ask for a run too many
    least = F.greatest(F.lit(1), F.ceil(threshold * F.col("n") - 1e-6))
    rare = postings.withColumn("place", place).filter(F.col("place") >= least)
    a, b = rare.alias("a"), postings.alias("b")
    meets = (F.col("a.space") == F.col("b.space")) & (F.col("a.run") == F.col("b.run")) & (F.col("a.rep") != F.col("b.rep")) & (F.col("a.n") <= F.col("b.n")) & ((F.col("a.any_train") & F.col("b.any_held")) | (F.col("a.any_held") & F.col("b.any_train")))
    met = a.join(b, meets).select("a.space", F.col("a.rep").alias("x"), F.col("b.rep").alias("y"))
    candidates = durable(met.select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    needed = candidates.select("space", F.explode(F.array("a", "b")).alias("id")).distinct()
    sides = durable(cut.join(needed, ["space", "id"], "left_semi").select("space", "id", "words", "runs", F.map_from_arrays("chunks", "lengths").alias("chunks")))
    both = candidates
    for s in ("a", "b"):
        both = both.join(sides.select("space", F.col("id").alias(s), F.col("runs").alias(f"runs_{s}"), F.col("chunks").alias(f"chunks_{s}"), F.col("words").alias(f"words_{s}")), ["space", s])
    smaller = F.least(F.size("runs_a"), F.size("runs_b"))
    common_runs = F.size(F.array_intersect("runs_a", "runs_b"))
    keys = F.array_intersect(F.map_keys("chunks_a"), F.map_keys("chunks_b"))
    length = F.aggregate(keys, F.lit(0).cast("long"), lambda s, k: s + F.least(F.col("chunks_a")[k], F.col("chunks_b")[k]))
    pairs = both.select("space", "a", "b", (length / F.least("words_a", "words_b")).alias("chunk_overlap"), (common_runs / smaller).alias("overlap")).filter(F.col("overlap") >= threshold)
    return pairs, members


def _shared(cut: DataFrame, parts, name: str) -> DataFrame:
    """(space, id, name): the summed length of each record's parts that another record of the training split has."""
    each = cut.select("space", "id", "train", F.explode(parts).alias("p")).select("space", "id", "train", "p.part", "p.length")
    known = each.filter("train").groupBy("space", "part").agg(F.count(F.lit(1)).alias("n"))
    met = each.join(known, ["space", "part"]).filter("NOT train OR n > 1")
    return met.groupBy("space", "id").agg(F.sum("length").alias(name))


def held_overlaps(pairs: DataFrame, members: DataFrame, itself: tuple[str, ...] = ()) -> DataFrame:
    """(space, id, overlap): how much each record of an evaluation split overlaps with the training split.

    overlap is the largest with another training record, NULL below the threshold; 1 for a record of a space in `itself`
    that is in the training split too. Copies are counted by their groups and never paired.
    """
    groups = members.filter("representative IS NOT NULL").groupBy("space", "representative").agg(F.count_if("train").alias("trained"))
    ways = pairs.select("space", F.col("a").alias("representative"), F.col("b").alias("other"), "overlap").unionByName(pairs.select("space", F.col("b").alias("representative"), F.col("a").alias("other"), "overlap"))
    trained = groups.filter("trained > 0").select("space", F.col("representative").alias("other"))
    best = ways.join(trained, ["space", "other"], "left_semi").groupBy("space", "representative").agg(F.max("overlap").alias("near"))
    each = members.filter("held").join(groups, ["space", "representative"], "left").join(best, ["space", "representative"], "left")
    copy = (F.col("trained") > F.col("train").cast("int")) | (F.col("space").isin(*itself) & F.col("train"))
    return each.select("space", "id", F.when(copy, 1.0).otherwise(F.col("near")).alias("overlap"))


def expand_pairs(pairs: DataFrame, members: DataFrame, itself: tuple[str, ...] = ()) -> DataFrame:
    """All (space, id_a, id_b, overlap, chunk_overlap), id_a < id_b, of a training and an evaluation record.

    The pairs of representatives and the copies inside each group, expanded: as many rows as there are such pairs. In
    the spaces of `itself` a record of both splits is a pair with itself, whatever its text.
    """
    alone = members.filter(F.col("space").isin(*itself) & F.col("train") & F.col("held")).select("space", F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("overlap"), F.lit(1.0).alias("chunk_overlap"))
    members = members.filter("representative IS NOT NULL")
    own = members.select("space", F.col("representative").alias("a"), F.col("representative").alias("b")).distinct().select("space", "a", "b", F.lit(1.0).alias("chunk_overlap"), F.lit(1.0).alias("overlap"))
    # a group held by one side alone has no pairs inside
    mixed = members.groupBy("space", "representative").agg(F.max("train").alias("t"), F.max("held").alias("h"), F.count(F.lit(1)).alias("n")).filter("t AND h AND n > 1").select("space", F.col("representative").alias("a"))
    linked = pairs.unionByName(own.join(mixed, ["space", "a"], "left_semi"))
    both = linked
    for s in ("a", "b"):
        both = both.join(members.select("space", F.col("representative").alias(s), F.col("id").alias(f"id_{s}"), F.col("train").alias(f"train_{s}"), F.col("held").alias(f"held_{s}")), ["space", s])
    crossing = both.filter("id_a != id_b AND ((train_a AND held_b) OR (held_a AND train_b))")
    return crossing.select("space", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "overlap", "chunk_overlap").distinct().unionByName(alone)
