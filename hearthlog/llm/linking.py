"""Links between word-shingle sets that share a bucket, and their components, without the pairs of a group.

Equal sets are folded into one node first: 128-bit names tell sets apart, and a node goes by a number of its
own from then on. Any scheme that puts linked sets into common buckets can use ``set_components``:

* A bucket of n sets is not n*n pairs. In each round every open bucket picks pivots among the members that have
  not been one and compares them with its members of other components. Components are brought to their fixed
  point before the next round, and a bucket closes once the members that were no pivots share one component. A
  bucket of near copies closes after a few pivots; the number of pivots grows ``GROWTH``-fold from the third round on, so that
  a bucket of unrelated sets, where every pair must be tried, closes after logarithmically many rounds. No link is
  lost to a cap.
* Buckets with the same members are one: sets that are alike, linked or not, meet in very many buckets.
* A bucket's first pivot is the member that meets most others over all of its buckets. The text that copies were made
  from meets all of them, so one round links copies that differ among themselves by more than the threshold allows.
* The parities of the number of elements per hash class bound the difference of two sets from below. Pairs that
  these exact bounds turn away never move full sets. While a bucket has one pivot, sketches of two classes an element
  are fetched for the pairs met; once it has many, a bitmap of fixed size is tried inside the bucket join first, so that
  unrelated pairs are never emitted.
* Confirmed links enter the components as links between the labels of their ends, each once.
* A bucket's members are never gathered: pivots are minima with map-side combine, and the comparison is a join
  on the bucket whose skewed side Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.components import smallest_reachable
from hearthlog.llm.tokens import Hasher, mix, shingles
from hearthlog.session import cut, release

FIRST = 4
WORDS = 32
GROWTH = 256
_CLASS_BITS = 11  # of 64 * WORDS classes
BROADCAST_IDS = 1_000_000
_BITS = [f"w{k}" for k in range(WORDS)]


def element_sets(batch: pa.RecordBatch, hasher: Hasher, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in order; with fewer words, the whole text's as one."""
    for w in hasher.words(batch.column("body")):
        for lo, hi in zip(w.bounds[:-1], w.bounds[1:]):
            own = w.hashes[lo:hi]
            yield np.unique(shingles(own, min(shingle, len(own)))) if len(own) else own


def name(elements: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set."""
    mixed = mix(elements)
    first = mixed.sum(dtype=np.uint64) ^ np.uint64(len(elements))
    second = mix(mixed ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))


def fold(prints: DataFrame, *carried: str) -> DataFrame:
    """One row (hi, lo, node, first_id, carried) per distinct set of the rows that can link, staged.

    ``node`` is a number given here, unless it is carried.
    """
    filled = prints.filter("n_shingles > 0 AND id IS NOT NULL")
    # Equal sets have equal sizes and keys.
    grouped = filled.groupBy("hi", "lo").agg(F.min("id").alias("first_id"), *[F.max(c).alias(c) for c in carried])
    return cut(grouped if "node" in carried else grouped.withColumn("node", F.monotonically_increasing_id()))


def _bitmap(elements: np.ndarray) -> np.ndarray:
    """Parities of the number of elements in ``64 * WORDS`` hash classes, as ``WORDS`` int64."""
    counts = np.bincount((elements >> np.uint64(64 - _CLASS_BITS)).astype(np.int64), minlength=64 * WORDS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the number of elements per hash class, two classes or more per element, packed to bytes."""
    bits = max(64 * WORDS, 1 << (2 * len(elements) - 1).bit_length())
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8))


def least_difference(p: np.ndarray, q: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    small, large = sorted((p, q), key=len)
    while len(large) > len(small):
        half = len(large) // 2
        large = large[:half] ^ large[half:]
    return int(np.bitwise_count(small ^ large).sum())


def full_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(hi, lo, n, w0, w1, ..., sketch, elements) of every row: name, size, bitmap, sketch, elements (int64, in order)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            names, sizes, maps, sketches, sets = [], [], [], [], []
            for e in element_sets(batch, hasher, shingle):
                names.append(name(e))
                sizes.append(len(e))
                maps.append(_bitmap(e))
                sketches.append(sketch(e).tobytes() if len(e) else None)
                sets.append(e.tobytes())
            maps = np.array(maps, dtype=np.int64).reshape(-1, WORDS)
            hi, lo = zip(*names) if names else ((), ())
            columns = [pa.array(c, pa.int64()) for c in (hi, lo, sizes)]
            columns += [*(pa.array(m) for m in maps.T), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.record_batch(columns, names=["hi", "lo", "n", *_BITS, "sketch", "elements"])

    schema = ", ".join(["hi long, lo long, n long", *(f"{b} long" for b in _BITS), "sketch binary", "elements binary"])
    return bodies(docs, id_col, text_col).mapInArrow(build, schema)


def sets_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, n, bitmap, sketch, elements) of ``nodes``, made again from one text of each, staged."""
    wanted = cut(nodes.select("hi", "lo", "node", "first_id"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ids = wanted.select(F.col("first_id").alias("_id"))
    # Few enough ids go to the texts; otherwise both sides are dealt out by id. The rows are the same.
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    texts = texts.join(ids, "_id", "left_semi")
    # Rows that share an id may hold other texts: keep the wanted sets only, one of each.
    made = full_sets(texts, "_id", "_text", shingle).join(wanted.select("hi", "lo", "node"), ["hi", "lo"])
    return cut(made.drop("hi", "lo").dropDuplicates(["node"]))


def crowded(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (bucket, node, ...) whose bucket holds another node."""
    buckets = members.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    return members.join(cut(buckets.select("bucket")), "bucket")


def _unlike_buckets(members: DataFrame) -> DataFrame:
    """(bucket, node, weight): one bucket of every list of two members or more, staged.

    A list goes by its length and two independent 64-bit sums. ``weight`` says how often the node meets others
    over all of its buckets.
    """
    sums = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    lists = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *sums).filter("n > 1")
    unlike = lists.groupBy("n", "h1", "h2").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("times"))
    kept = cut(unlike.select("bucket", (F.col("n") * F.col("times")).alias("met")))
    left = cut(members.select("bucket", "node").join(kept, "bucket"))
    weights = left.groupBy("node").agg(F.sum("met").alias("weight"))
    weighed = cut(left.join(weights, "node").select("bucket", "node", "weight"))
    release(members.sparkSession, kept, left)
    return weighed


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The staged ``pairs`` (a, b, x, y) with sizes m, n and the ``column`` of their sets as p, q.

    Only sets that are in a pair are moved; Spark sends few pairs to the sets rather than sets to the pairs.
    """
    of = lambda end, size, value: sets.select(F.col("node").alias(end), F.col("n").alias(size), F.col(column).alias(value))
    right = of("b", "n", "q").join(pairs.select("b").distinct(), "b", "left_semi")
    return pairs.join(of("a", "m", "p"), "a").join(right, "b").select("a", "b", "x", "y", "m", "n", "p", "q")


def _screened(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs that may link by the sketches of their sets, staged; no pair that links is turned away."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, p, q in zip(*(batch.column(c).to_pylist() for c in ("m", "n", "p", "q"))):
                differ = least_difference(np.frombuffer(p, dtype=np.uint8), np.frombuffer(q, dtype=np.uint8))
                keep.append((100 + threshold) * differ <= (100 - threshold) * (m + n))
            yield batch.select(["a", "b", "x", "y"]).filter(pa.array(keep, pa.bool_()))

    return cut(_with_both(pairs, sets, "sketch").mapInArrow(screen, "a long, b long, x long, y long"))


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b), the labels x and y of the pairs (a, b, x, y) whose sets share ``threshold`` percent of their union, staged."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for p, q in zip(batch.column("p"), batch.column("q")):
                p, q = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (p, q))
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= threshold * (len(p) + len(q) - both))
            labels = batch.select(["x", "y"]).filter(pa.array(linked, pa.bool_()))
            yield pa.record_batch(labels.columns, names=["a", "b"])

    return cut(_with_both(pairs, sets, "elements").mapInArrow(compare, "a long, b long"))


def _may_link(threshold: int) -> Column:
    """Whether a member and a pivot can link, by what their sizes and bitmaps allow.

    A class whose parity differs holds an element that only one of the two sets has, so the number of
    differing bits bounds the symmetric difference from below, and the common part from above. No pair that
    links is turned away.
    """
    total = F.col("n") + F.col("pivot_n")
    differ = reduce(add, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"pivot_{b}"))) for b in _BITS])
    sizes = 100 * F.least("n", "pivot_n") >= threshold * F.greatest("n", "pivot_n")
    return sizes & ((100 + threshold) * (total - differ) >= 2 * threshold * total)


def set_components(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of every row of ``sets``, from the buckets (bucket, node) they share.

    Round 0 tries one pivot in every ``FIRST``-th bucket only. Near copies share many buckets, so this already
    joins most of them, and a pair inside one component is never compared again.
    """
    # Columns that are never null spare the bounds below a check per word and pair.
    sketches = sets.select("node", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", *_BITS)])
    labels = sets.select("node", F.col("node").alias("label"))
    spark, spent = sets.sparkSession, []
    members = _unlike_buckets(members).withColumns({"done": F.lit(False), "label": F.col("node")})
    round_ = 0
    while True:
        active = members.filter(F.pmod("bucket", F.lit(FIRST)) == 0) if round_ == 0 else members
        salt = F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(GROWTH ** max(round_ - 1, 0)))
        rank = (-F.col("weight")).alias("w"), F.xxhash64("node").alias("h")
        chosen = F.struct(*rank, F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
        pivots = active.filter("NOT done").groupBy("bucket", salt.alias("salt")).agg(F.min(chosen).alias("lot"))
        pivots = cut(pivots.select("bucket", "lot.pivot", "lot.pivot_label"))
        cross = F.col("label") != F.col("pivot_label")
        if round_ < 2:
            # One pivot a bucket: at most one narrow row per member, and few once labels are known.
            met = active.join(pivots, "bucket").filter(cross)
        else:
            # Many pivots for the few buckets left: bounds hold inside the join, before a row is made.
            bounds = ["n", *_BITS]
            of_pivot = sketches.select(F.col("node").alias("pivot"), *[F.col(c).alias(f"pivot_{c}") for c in bounds])
            met = active.join(sketches, "node").join(pivots.join(of_pivot, "pivot"), "bucket").filter(cross & _may_link(threshold))
        ends = [F.col(c).alias(k) for c, k in (("node", "a"), ("pivot", "b"), ("label", "x"), ("pivot_label", "y"))]
        met = cut(met.select(*ends).distinct())
        pairs = _screened(met, sets, threshold)
        links = _confirmed(pairs, sets, threshold)
        spent += [pivots, met, pairs, links]
        moved = not links.isEmpty()
        if moved:
            reached = smallest_reachable(links).withColumnRenamed("node", "label")
            new = labels.join(reached, "label", "left").select("node", F.coalesce("component", "label").alias("label"))
            labels = cut(new)
            spent.append(labels)
        was_pivot = pivots.select("bucket", F.col("pivot").alias("node"), F.lit(True).alias("now"))
        marked = members.join(was_pivot, ["bucket", "node"], "left")
        if moved:
            marked = marked.drop("label").join(labels, "node")
        marked = marked.select("bucket", "node", "weight", F.expr("done OR now IS NOT NULL").alias("done"), "label")
        # Only pairs of members that were no pivots are uncompared; they matter across components.
        rest = marked.filter("NOT done").groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        members = cut(marked.join(rest.filter("lo <> hi").select("bucket"), "bucket"))
        # What this round has staged is no longer read, save the labels in force and the members left.
        release(spark, *[df for df in spent if df is not labels])
        spent = [members, *(df for df in spent if df is labels)]
        if members.isEmpty():
            return labels.withColumnRenamed("label", "component")
        round_ += 1


def document_classes(prints: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``prints``, from the components ``found`` of nodes."""
    named = nodes.select("hi", "lo", "node", "first_id").join(found, "node", "left")
    named = cut(named.select("hi", "lo", "first_id", F.coalesce("component", "node").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(smallest, "component").select("hi", "lo", "component_id")
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    # Rows that cannot link carry no name, so they never meet in the join.
    keys = [F.when(linked, F.col(c)).alias(c) for c in ("hi", "lo")]
    of_doc = prints.select("id", "n_shingles", *keys).join(of_set, ["hi", "lo"], "left")
    return of_doc.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
