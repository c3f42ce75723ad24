"""Subject areas of documents, by seeded non-negative factorisation of the document-term matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.units import unit_terms
from loomwright.llm.wordblocks import slices
from loomwright.session import durable

BACKGROUND = 4
SLOTS = 1 << 18
MOST_SUBJECTS = 64
MOST_LABELLED = 200_000
MOST_ROUNDS, SETTLED, INNER = 12, 0.02, 8
JOINS = 0.7
DOCUMENTS_AT_ONCE = 2000
LETTERS_AT_ONCE = 1 << 20


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as (terms, at, units): the distinct words of each unit as hashes, the units' places, their number."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for begin, end in slices(texts, LETTERS_AT_ONCE):
            terms, places, offsets, units = unit_terms(texts[begin:end])
            ids = batch.column("doc_id").slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([ids, _lists(terms, offsets, pa.int64()), _lists(places, offsets, pa.int32()), pa.array(units, pa.int32())], names=["doc_id", "terms", "at", "units"])


def slots_of(terms: np.ndarray, anchored: np.ndarray) -> np.ndarray:
    """The row of each term in the model: one of its own for an anchored term, else one of SLOTS by its hash."""
    hashed = (terms.view(np.uint64) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    if not len(anchored):
        return hashed
    at = np.minimum(np.searchsorted(anchored, terms), len(anchored) - 1)
    return np.where(anchored[at] == terms, SLOTS + at, hashed)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
            yield batch.slice(begin, DOCUMENTS_AT_ONCE)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _slot_frequencies(anchored):
    """One task's share of the number of documents by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = SLOTS + len(anchored.value)
        counts = np.zeros(size, dtype=np.int64)
        for batch in _slices(batches):
            terms, documents = _flat(batch.column("terms"))
            key = np.unique(documents * size + slots_of(terms, anchored.value))
            counts += np.bincount(key % size, minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "df"])

    return run


def _fold(terms: np.ndarray, documents: np.ndarray, n: int, h: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixtures of n documents given the components h (terms x components): multiplicative updates of one side.

    Returns (mixtures, the distinct terms' places, each entry's mass by component).
    """
    key, counts = np.unique(documents * len(h) + terms, return_counts=True)
    rows, columns = key // len(h), key % len(h)
    weights = np.full((n, h.shape[1]), 1 / h.shape[1], dtype=np.float32)
    if not len(key):
        return weights, columns, np.zeros((0, h.shape[1]), dtype=np.float32)
    begin = np.flatnonzero(np.diff(rows, prepend=-1))
    of_term = h[columns]
    for _ in range(inner):
        mass = weights[rows] * of_term
        mass *= (counts / (mass.sum(1) + 1e-30))[:, None]
        sums = np.add.reduceat(mass, begin, axis=0)
        weights[rows[begin]] = sums / (sums.sum(1, keepdims=True) + 1e-30)
    return weights, columns, mass


def _component_sums(components, anchored):
    """One task's share of the other side's update: the mass of each slot by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = components.value
        sums = np.zeros(h.shape, dtype=np.float64)
        for batch in _slices(batches):
            terms, documents = _flat(batch.column("terms"))
            _, columns, mass = _fold(slots_of(terms, anchored.value), documents, batch.num_rows, h, INNER)
            for z in range(h.shape[1]):
                sums[:, z] += np.bincount(columns, mass[:, z], len(h))
        some = np.flatnonzero(sums.sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(sums[some, z]) for z in range(h.shape[1]))], names=["slot", *(f"z{z}" for z in range(h.shape[1]))])

    return run


def _shares(components, anchored, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = components.value
        k = len(names)
        for batch in _slices(batches):
            terms, documents = _flat(batch.column("terms"))
            if not len(terms):
                continue
            terms = slots_of(terms, anchored.value)
            places = batch.column("at").flatten().to_numpy().astype(np.int64)
            weights, _, _ = _fold(terms, documents, batch.num_rows, h, INNER + 4)
            mass = (weights[documents] + 0.002) * h[terms]
            mass /= mass.sum(1, keepdims=True) + 1e-30
            first = np.flatnonzero((np.diff(documents, prepend=-1) != 0) | (np.diff(places, prepend=-1) != 0))
            unit = np.add.reduceat(mass[:, :k], first, axis=0)
            subject = unit.argmax(1)
            clear = unit[np.arange(len(unit)), subject] >= 0.5
            pair, count = np.unique(documents[first][clear] * k + subject[clear], return_counts=True)
            row = pa.array(pair // k)
            out = [batch.column("doc_id").take(row), pa.array([names[s] for s in pair % k], pa.string()), pa.array(count.astype(np.int32)), batch.column("units").take(row), pa.array(weights[pair // k, pair % k].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "subject", "count", "units", "weight"])

    return run


def _seeds(counts: np.ndarray, labelled: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Anchors (terms x subjects): labelled documents of terms that belong to one subject, or to two.

    A term belongs to a subject if that is clearly more frequent among its labelled documents than among all (base), so
    that words everybody uses belong to none. It must be in four of them or more, fewer being chance. A subject that gets less than ten anchors
    so also takes its twenty purest terms of two documents or more.
    """
    purity = counts / (labelled[:, None] + 3.0)
    owns = (purity >= 0.25) & (purity - base >= 0.2 * (1 - base))
    owned = np.where(owns, purity, 0.0)
    top = -np.sort(-owned, axis=1)[:, :2]
    bound = (top.sum(1) >= 0.55) & (top[:, 0] >= 0.3)
    anchors = np.where(bound[:, None] & owns, counts, 0.0)
    for s in np.flatnonzero((anchors > 0).sum(0) < 10):
        raw = np.where((counts[:, s] >= 2) & (counts[:, s] >= 0.6 * np.maximum(labelled, 1)), purity[:, s], 0.0)
        best = np.argsort(-raw, kind="stable")[:20]
        best = best[raw[best] > 0]
        anchors[best, s] = counts[best, s]
    return anchors


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame, most_rounds: int = MOST_ROUNDS, seed: int = 3, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, subject, count, units, weight, share): how many of a document's sentences and code lines deal with a subject.

    documents: (doc_id, text). labels: (doc_id, subject), some documents' subjects by hand, in any spelling of case and
    outer blanks; wrong, repeated and unknown ones are tolerated. subjects: (subject), at most MOST_SUBJECTS. NULL and
    empty texts, and those without words, have no row, like documents with a NULL id. Repeated rows of a document each
    have their rows. Headings, numbers and other lines without a sentence or code aren't counted among the units.
    Other columns are not looked at. Empty documents, labels or subjects give no rows. weight is the subject's part of the
    document's mixture, share that of its units.

    Method: the document-term matrix is factored into one component per subject and BACKGROUND more for what all texts
    share. Terms that the labelled documents bind to one or two subjects are anchors: they start in these subjects'
    components, and never enter the background's. Alternating multiplicative updates (Kullback-Leibler divergence) then
    fit mixtures and components to all documents, so that terms nobody labelled join the subjects they occur with, until
    no component moves more than SETTLED of its mass in a round, most_rounds at most. Last, the mass of each unit's terms
    under its document's mixture tells the unit's subject, if one has half a term's.

    No term is left out: an anchor has a row of the components of its own, and all other terms share SLOTS rows by hash.

    Scale: texts are cut into words once. Mixtures are fitted task by task and never stored; a round sums components by
    slot in each task first, in a few tasks a core. What is collected and broadcast are the components, of SLOTS rows and
    one per anchor, whatever the input's size; anchors come from most_labelled labelled documents at most (a
    documented bound of the model; those with the smallest hashes of their id).
    """
    rows = subjects.select(F.lower(F.trim("subject")).alias("subject")).dropna().distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()
    names = [r["subject"] for r in rows]
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, subject string, count int, units int, weight double"
    texts = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    encoded = durable(texts.mapInArrow(_encode, f"doc_id {id_type}, terms array<long>, at array<int>, units int").filter("size(terms) > 0"))
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).filter(F.col("subject").isin(names) if names else F.lit(False)).distinct()
    anchored, anchors = _anchors(encoded, clean, names, most_labelled)
    if not len(anchored):
        return spark.createDataFrame([], schema).withColumn("share", F.lit(0.0))
    alive = np.flatnonzero(anchors.any(axis=0))
    anchors, used = anchors[:, alive], [names[s] for s in alive]

    k, size = len(used), SLOTS + len(anchored)
    own = spark.sparkContext.broadcast(anchored)
    few = encoded.select("terms").coalesce(4 * spark.sparkContext.defaultParallelism)
    found = few.mapInArrow(_slot_frequencies(own), "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).toPandas()
    general = np.zeros(size)
    general[found["slot"].to_numpy()] = found["df"].to_numpy()
    general /= general.sum()
    random = np.random.Generator(np.random.PCG64(seed))
    fixed = np.zeros((size, k))
    fixed[SLOTS:] = anchors
    h = np.empty((size, k + BACKGROUND))
    h[:, :k] = fixed + 1e-3 * general[:, None] * len(found)
    h[:, k:] = general[:, None] * (0.5 + random.random((size, BACKGROUND)))
    h[SLOTS:, k:] = 0.0
    h /= np.maximum(h.sum(axis=0), 1e-30)
    columns = [f"z{z}" for z in range(k + BACKGROUND)]
    for _ in range(most_rounds):
        shared = spark.sparkContext.broadcast(h.astype(np.float32))
        sums = few.mapInArrow(_component_sums(shared, own), "slot int, " + ", ".join(f"{c} double" for c in columns))
        found = sums.groupBy("slot").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        fitted = np.zeros_like(h)
        fitted[found["slot"].to_numpy()] = found[columns].to_numpy()
        _join(fitted[:SLOTS], k)
        fitted[:, :k] += 2 * fixed
        before, h = h, np.where(h > 0, fitted + 1e-6, 0.0)
        h /= np.maximum(h.sum(axis=0), 1e-30)
        shared.unpersist()
        if np.abs(h - before)[:, :k].sum(axis=0).max() / 2 < SETTLED:
            break
    final = spark.sparkContext.broadcast(h.astype(np.float32))
    return encoded.mapInArrow(_shares(final, own, used), schema).withColumn("share", F.col("count") / F.col("units"))


def _join(mass: np.ndarray, k: int) -> None:
    """Leave a term nobody labelled in a subject only if the subject has JOINS of its mass; the rest is background.

    Without this, words of all texts drift into the subjects a few labels describe badly, and take others with them.
    """
    total = mass.sum(axis=1, keepdims=True) + 1e-30
    loose = np.where(mass[:, :k] < JOINS * total, mass[:, :k], 0.0)
    mass[:, :k] -= loose
    rest = mass[:, k:]
    shares = np.where(rest.sum(axis=1, keepdims=True) > 0, rest / (rest.sum(axis=1, keepdims=True) + 1e-30), 1 / BACKGROUND)
    rest += loose.sum(axis=1, keepdims=True) * shares


def _anchors(encoded: DataFrame, clean: DataFrame, names: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchored terms, ascending; their weights by subject) from the labelled documents, of which `most` at most count."""
    held = encoded.join(clean.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = durable(held.select("doc_id", F.array_distinct("terms").alias("terms")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    number = chosen.select("doc_id").distinct().count()
    theirs = clean.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    of_subject = {r["subject"]: r["n"] for r in theirs.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = np.minimum(np.array([of_subject.get(n, 0) / max(1, number) for n in names]), 1.0)
    terms = chosen.select("doc_id", F.explode("terms").alias("term"))
    of_term = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    of_pair = terms.join(theirs, "doc_id").groupBy("term", "subject").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2")
    # subjects that have a fifth of a term's labels: five rows a term of the bounded sample at most
    seeds = of_pair.join(of_term, "term").filter("c >= 0.2 * n").toPandas()
    known, row = np.unique(seeds["term"].to_numpy(dtype=np.int64), return_inverse=True)
    counts, labelled = np.zeros((len(known), len(names))), np.zeros(len(known))
    counts[row, [names.index(x) for x in seeds["subject"]]] = seeds["c"].to_numpy()
    labelled[row] = seeds["n"].to_numpy()
    if not len(known):
        return known, counts
    anchors = _seeds(counts, labelled, base)
    bound = anchors.any(axis=1)
    return known[bound], anchors[bound]


def main_subjects(shares: DataFrame, least: float = 0.2) -> DataFrame:
    """The rows of subject_shares whose subject a document is about.

    A share of `least` or more, of two units at least; a single unit counts only if no other subject has more, being
    a passing mention otherwise.
    """
    ranked = shares.withColumn("most", F.max("count").over(Window.partitionBy("doc_id")))
    return ranked.filter((F.col("share") >= least) & ((F.col("count") > 1) | (F.col("count") == F.col("most")))).drop("most")
