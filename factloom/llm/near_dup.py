"""Near-duplicates by one-permutation hashing with optimal densification.

One hash per shingle fills all bins of a signature; an empty bin borrows from the first
filled bin in an order fixed for that bin, so any number of shingles gives bins that agree
with the probability of the similarity.  Bins are banded into buckets.  A bucket does not emit
its pairs: its members are compared with one of them, a star.  The first bands go first, so that
a large group of copies is one component before the other bands look at it, and buckets whose
members are one component are left alone.  Where members stay in different components, those
outside the bucket's largest one are centres in turn, a few of many first, four times as many
each round: any pair of two components has one of them.  Such a pair is looked at only if the
sets share one of their rarest shingles, as many as they may differ in (a prefix filter): texts
that have a passage in common but too much of their own besides never meet.  Every candidate is
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import chained, id_and_text, slices, word_hashes, written
from factloom.llm.components import connected_components

BINS = 512
#: Eight bins a band: two sets of similarity 0.8 share none of 64 bands with probability 8e-6,
#: two of similarity 0.4 share one with probability 0.04.
BAND_WIDTH = 8
#: Bands of the first stars; copies of similarity 0.9 share one of them in 99 of 100 cases.
FIRST_BANDS = 8
#: Up to SMALL centres are taken at once; of more, about SMALL, then four times as many each round.
SMALL, GROWTH = 16, 4
#: The sketch of a set: a bit of each bin, in words of 64.  Two sets of similarity s agree in a
#: share of (1 + s) / 2; a pair is dropped unread only beyond DEVIATIONS standard deviations
#: from that, which loses a similar pair in 2e-8 cases.
WORDS, DEVIATIONS = BINS // 64, 5.5
#: Bits of the filter that tells which texts may be candidates; full or not, it loses none.
FILTER_BITS = 1 << 24
#: Sets whose shingles are counted and frequent shingles that are told apart, to put the rare ones
#: first.  Any order gives the same links; a better one has fewer pairs to look at.
COUNTED_SETS, FREQUENT = 4096, 1 << 16
_ORDERS = np.stack([np.random.default_rng(j).permutation(BINS) for j in range(BINS)])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles; fewer words than `size` form one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = chained(h, words[k : len(words) - size + 1 + k])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin; `hashes` are sorted, so a bin is a run of them."""
    bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~filled)
    if len(first):
        tried = 32
        while len(empty):
            orders = _ORDERS[empty, :tried]
            hits = filled[orders]
            at = hits.argmax(axis=1)
            found = hits[np.arange(len(empty)), at]
            values[empty[found]] = values[orders[found, at[found]]]
            empty, tried = empty[~found], BINS
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    bands = values.reshape(-1, BAND_WIDTH)
    key = np.arange(len(bands), dtype=np.uint64)
    for k in range(BAND_WIDTH):
        key = chained(key, bands[:, k])
    return key.view(np.int64)


def bit_sketch(values: np.ndarray) -> np.ndarray:
    """One bit of every bin, as WORDS integers of 64 bits."""
    bits = (values & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    for a, b in slices(texts):
        words, counts = word_hashes(texts[a:b])
        for own in np.split(words, np.cumsum(counts)[:-1]):
            yield shingles(own, size)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys, sketches = [], [], [], []
            for found in shingle_sets(batch.column("text").to_pylist(), size):
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                values = signature(found) if len(found) else None
                keys.append(band_keys(values) if len(found) else None)
                sketches.append(bit_sketch(values) if len(found) else None)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, many), pa.array(sketches, many)],
                ["doc_id", "n_shingles", "digest", "keys", "sketch"],
            )

    return run


def _bits(ids: DataFrame) -> bytes:
    """A filter of FILTER_BITS bits with one set for each id: two megabytes however many ids."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = (
        ids.select(slot.alias("slot"))
        .groupBy((F.col("slot") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    )
    found = words.toArrow()  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def _maybe(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)


def _shingle_sets(size: int, packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = _maybe(packed)
        for batch in batches:
            batch = batch.filter(pa.array(maybe[batch.column("slot").to_numpy()]))
            found = shingle_sets(batch.column("text").to_pylist(), size)
            sets = [s.view(np.int64) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"]
            )

    return run


def _candidate_sets(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, hashes) of the documents in `ids`; the texts themselves are not moved."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot")
    sets = rows.where("doc_id IS NOT NULL").select("doc_id", "text", slot).mapInArrow(
        _shingle_sets(size, _bits(ids)), "id long, hashes array<long>"
    )
    return written(sets.join(ids, F.col("id") == F.col("doc_id"), "left_semi"), "near-sets")


def _links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    pairs = written(pairs, "near-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets.join(ids, "id", "left_semi")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("right")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a"
    )
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return written(both.where(100 * common >= percent * union).select("a", "b"), "near-links")


def _may_be_similar(percent: int) -> Column:
    """By the numbers of shingles and the sketches of set and centre."""
    fewer, more = F.least("n", "centre_n"), F.greatest("n", "centre_n")
    differ = sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"c{i}"))) for i in range(WORDS)), F.lit(0))
    # Bins that a small set leaves empty repeat others and say nothing new.
    filled = BINS * (1 - F.exp(-fewer / BINS))
    share = (1 + percent / 100) / 2
    least = BINS * (share - DEVIATIONS * (share * (1 - share)) ** 0.5 / F.sqrt(filled))
    return (100 * fewer >= percent * more) & (BINS - differ >= least)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows with the component of their set."""
    if labels is None:
        return rows.withColumn("component", F.col("set_id"))
    known = labels.select(F.col("node").alias("set_id"), F.col("component").alias("label"))
    return rows.join(known, "set_id", "left").withColumn(
        "component", F.coalesce("label", "set_id")
    ).drop("label")


def _stars(sets: DataFrame, labels: DataFrame | None, from_: int, count: int) -> DataFrame:
    """Members of the buckets of some bands that hold several components, with the smallest set of each."""
    # Most buckets hold one set: what is dealt by bucket, once for both sides, is ids alone.
    keyed = sets.select(F.explode(F.slice("keys", from_ + 1, count)).alias("bucket"), "set_id").repartition("bucket")
    ends = keyed.groupBy("bucket").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    members = keyed.join(ends, "bucket").where("low < high").drop("low", "high")
    members = _labelled(members.join(sets.select("set_id", "n"), "set_id"), labels)
    centres = members.groupBy("bucket").agg(
        F.min("set_id").alias("centre"),
        F.min_by("n", "set_id").alias("centre_n"),
        F.min_by("component", "set_id").alias("centre_component"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    several = centres.where("low < high").drop("low", "high")
    return written(members.join(several, "bucket"), "near-stars")


def _open_sets(members: DataFrame, sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Sets in buckets that still hold several components, with these buckets, as many as there are bands at most.

    Each bucket comes with its largest component, and ``outside`` counts the members that are
    not in it.  Only these sets carry their sketches.
    """
    labelled = _labelled(members, labels)
    several = (
        labelled.groupBy("bucket", "component")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("bucket")
        .agg(
            F.max_by("component", F.struct("size", "component")).alias("largest"),
            (F.sum("size") - F.max("size")).alias("outside"),
        )
        .where("outside > 0")
    )
    by_set = (
        labelled.join(several, "bucket")
        .groupBy("set_id", "n", "component")
        .agg(F.collect_list(F.struct("bucket", "largest", "outside")).alias("open"))
    )
    return written(by_set.join(sets.select("set_id", *_sketch("k")), "set_id"), "near-open")


def _rarest_first(packed: bytes, frequent: np.ndarray, counts: np.ndarray, percent: int):
    """The first shingles of each set, rare ones first: two similar sets have one of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = _maybe(packed)
        for batch in batches:
            batch = batch.filter(pa.array(maybe[batch.column("slot").to_numpy()]))
            sizes, firsts = [], []
            for own in batch.column("hashes"):
                own = own.values.to_numpy()
                at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                seen = np.where(frequent[at] == own, counts[at], 0)
                n = len(own)
                sizes.append(n)
                firsts.append(own[np.lexsort((own, seen))[: n - -(-percent * n // 100) + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
                ["set_id", "size", "shingles"],
            )

    return run


def _prefixes(hashes: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(set_id, size, shingles) of the sets in `ids`: as many of the rarest shingles as a similar set may lack, and one."""
    rows = hashes.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)))
    every = -(-ids.count() // COUNTED_SETS)
    counted = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(every)) == 0
    frequent = (
        hashes.join(ids.where(counted), F.col("id") == F.col("doc_id"), "left_semi")
        .select(F.explode("hashes").alias("shingle"))
        .groupBy("shingle")
        .count()
        .where("count > 1")
        .orderBy(F.desc("count"), "shingle")
        .limit(FREQUENT)
        .orderBy("shingle")
        .toArrow()
    )
    known = frequent.column("shingle").to_numpy(), frequent.column("count").to_numpy()
    if not len(known[0]):
        known = np.zeros(1, np.int64), np.zeros(1, np.int64)
    firsts = rows.mapInArrow(
        _rarest_first(_bits(ids), *known, percent), "set_id long, size long, shingles array<long>"
    )
    return written(firsts, "near-prefixes")


def _meeting(alive: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (set_id, centre) of two components that share a shingle where similar sets have their first common one.

    Sets of sizes x and y with a union of u have at least `common` shingles in common, so no
    more than x - common and y - common come before the first of them.
    """
    rows = alive.select("set_id", "component", (F.size("centre_in") > 0).alias("is_centre"))
    rows = rows.join(prefixes, "set_id").select(
        "set_id", "component", "is_centre", "size", F.posexplode("shingles").alias("place", "shingle")
    )
    rows = rows.repartition("shingle")
    centres = rows.select(
        "shingle",
        *[F.col(c).alias(f"centre_{c}") for c in ("component", "is_centre", "size", "place")],
        F.col("set_id").alias("centre"),
    ).where("centre_is_centre")
    both = F.col("size") + F.col("centre_size")
    common = F.ceil(percent * both / (100 + percent) - 1e-9)
    similar = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
    early = (F.col("place") + common <= F.col("size")) & (F.col("centre_place") + common <= F.col("centre_size"))
    once = ~F.col("is_centre") | F.expr("set_id < centre")
    apart = F.col("component") != F.col("centre_component")
    return rows.join(centres, "shingle").where(apart & similar & early & once).select("set_id", "centre").distinct()


def _sketch(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(WORDS)]


def _components_of_sets(rows: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of all shingle sets that are linked with another one."""
    similar = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    apart = F.col("component") != F.col("centre_component")

    def as_pairs(met: DataFrame) -> DataFrame:
        return met.select(
            F.least("set_id", "centre").alias("a"), F.greatest("set_id", "centre").alias("b")
        ).distinct()

    labels = links = hashes = members = None

    def linked(found: DataFrame) -> None:
        nonlocal labels, links
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = connected_components(links)

    bands = BINS // BAND_WIDTH
    for from_, count in ((0, FIRST_BANDS), (FIRST_BANDS, bands - FIRST_BANDS)):
        stars = _stars(sets, labels, from_, count)
        ids = stars.select(F.col("set_id").alias("doc_id")).distinct()
        if hashes is None:
            hashes, members = _candidate_sets(rows, ids, size), stars
        else:
            fresh = ids.join(hashes.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
            hashes = hashes.unionByName(_candidate_sets(rows, fresh, size))
            members = members.unionByName(stars)
        linked(_links(hashes, as_pairs(stars.where(apart & similar)), percent))

    members = members.select("bucket", "set_id", "n")
    prefixes, step = None, 0
    while True:
        alive = _open_sets(members, sets, labels)
        if alive.isEmpty():
            return labels
        if prefixes is None:
            prefixes = _prefixes(hashes, alive.select(F.col("set_id").alias("doc_id")).distinct(), percent)

        # Of many centres a share, picked by a hash so that buckets agree; each holds the one before.
        def share(bucket: Column, step: int = step) -> Column:
            rounds = F.ceil(F.log(float(GROWTH), bucket["outside"] / SMALL)) - step
            return F.pow(F.lit(GROWTH), F.greatest(rounds, F.lit(0))).cast("long")

        def is_centre(bucket: Column) -> Column:
            return (F.col("component") != bucket["largest"]) & (F.pmod(F.xxhash64("set_id"), share(bucket)) == 0)

        alive = alive.select(
            "*", F.col("open.bucket").alias("buckets"), F.filter("open", is_centre)["bucket"].alias("centre_in")
        )
        centres = alive.select(
            F.col("set_id").alias("centre"),
            F.col("n").alias("centre_n"),
            F.col("buckets").alias("centre_buckets"),
            F.col("centre_in").alias("centre_centre_in"),
            *[F.col(f"k{i}").alias(f"c{i}") for i in range(WORDS)],
        )
        # A pair counts if one of the two is a centre of a bucket that both are in.
        meet = F.arrays_overlap("buckets", "centre_centre_in") | F.arrays_overlap("centre_in", "centre_buckets")
        met = written(_meeting(alive, prefixes, percent), "near-meeting")
        met = met.join(alive, "set_id").join(centres, "centre").where(meet & _may_be_similar(percent))
        linked(_links(hashes, as_pairs(met), percent))
        members = alive.select(
            F.explode(F.filter("open", lambda bucket: share(bucket) > 1)["bucket"]).alias("bucket"), "set_id", "n"
        )
        step += 1


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of `size` words (lower-cased A-Z, split at
    white space); with fewer words the whole sequence is one shingle.  Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable and
    the document that carries it is kept.

    Null or blank text has an empty set, is linked with nothing and kept.  Equal sets are one
    node however many rows have them, so copies of a text cost nothing after the first
    grouping.  Rows that repeat a doc_id should repeat its text; they share a component.  A
    null doc_id takes part only as an exact copy of a set that a row with an id has, and keeps
    itself (component_id null) otherwise.  Other columns are ignored; empty input gives no
    rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    signed = written(
        rows.mapInArrow(
            _signatures(size), "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>"
        ),
        "signatures",
    )
    sets = (
        signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("set_id"),
            F.first("n_shingles").alias("n"),
            F.first("keys").alias("keys"),
            *[F.first("sketch")[i].alias(f"k{i}") for i in range(WORDS)],
        )
    )
    sets = written(sets, "shingle-sets")
    labels = _components_of_sets(rows, sets, size, percent)
    named = sets.select("digest", "set_id").join(
        labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left"
    ).select("digest", F.coalesce("component", "set_id").alias("component"))
    return (
        signed.drop("keys", "sketch")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
