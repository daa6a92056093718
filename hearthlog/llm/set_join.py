"""Exact Jaccard join of word-shingle sets by partitioning the universe of shingles.

Two sets of sizes s and l with similarity of at least t differ in at most (1 - t) / (1 + t) * (s + l) elements.
Sizes are cut into bands that double, so linked sets lie in one band or on either side of a border between two, within
reach of it. Each band and each border is a *group* of sizes with a largest possible difference H. For every group the
universe is dealt by a hash into segments, and each set of the group is thereby cut into one subset a segment. Give
every segment an allotment: 1 if its subset must be met as it is, 2 if a difference of one element is met as well. If the allotments add up to H + 1 + q, two linked sets
meet in segments whose allotments add up to more than q: the elements in which they differ cannot spoil more.

* A subset is indexed as the hash of its elements; a segment with allotment 2 also by its one-deletion
  neighbourhood, the hashes of the subset without each of its elements. Subsets that differ in one element share
  one of these, whichever of the two is the larger.
* How many segments get allotment 2 and how large q is follows from costs, per group: rows emitted by a set against
  the sets that would meet by accident (empty or nearly empty segments), given how many sets there are. Their number
  is estimated from the lengths of the texts, one row per size class. Any choice gives the same links.
* A set that shares fewer allotments with others than q + 1 in a group has no partner there and leaves. This exact
  filter removes what shares a few common subsets only, such as empty segments.
* What is left meets in buckets and is verified on full sets against pivots, see ``linking``: a group of near copies
  costs rows in proportion to its size.

Equal sets count as one. One pass over the texts leaves a line of signatures per document; how many rows a signature
has is counted first, so that only signatures met twice move with their sets. The sets of those that may have a partner
are made again from their texts. Thresholds of 50 percent and more are supported.

Null and blank texts have an empty set and link with nothing, and so does a row with a null id. Every input row
gives one result row; rows that share an id are judged by their own texts, and their class is that of the text.
Very long texts have as many signatures as their difference allows, about a third of their length. Empty tables
give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.linking import bodies, crowded, document_classes, element_sets, fold, name, set_components, sets_of
from hearthlog.llm.tokens import Hasher, mix
from hearthlog.session import bound_batches, cut, release

SHINGLE = 4
THRESHOLD = 85
CANDIDATE_COST = 50  # of a pair tried by accident, in emitted rows
MAX_SLACK = 12
MAP_BITS = 1 << 28
_WORD_BYTES = 6
_CLASSES = 8  # size classes per doubling


class Plan(NamedTuple):
    """How the sets of a group are cut: the first ``wide`` segments have allotment 2."""

    segments: int
    wide: int
    slack: int


def groups_of(size: int, threshold: int) -> list[int]:
    """The groups a set belongs to: 2k is the band of sizes from 2**k, 2k + 1 the border at the end of that band."""
    k = size.bit_length() - 1
    low, high = 1 << k, 2 << k
    found = [2 * k]
    if k and threshold * size <= 100 * (low - 1):
        found.append(2 * k - 1)
    if 100 * size >= threshold * high:
        found.append(2 * k + 1)
    return found


def extent(group: int, threshold: int) -> tuple[int, int, int]:
    """Least and largest size of a group, and the largest difference of two linked sets that meet in it."""
    k, border = divmod(group, 2)
    if border:
        last_below = (2 << k) - 1
        first, last = -(-threshold * (last_below + 1) // 100), 100 * last_below // threshold
        most = last_below + last
    else:
        first, last = 1 << k, (2 << k) - 1
        most = 2 * last
    return first, last, (100 - threshold) * most // (100 + threshold)


def _plan(first: int, last: int, differ: int, count: float) -> Plan:
    """The cheapest plan for about ``count`` sets of ``first`` to ``last`` elements that differ in up to ``differ``."""
    if differ == 0:
        return Plan(0, 0, 0)  # only equal sets link, and those are one
    size, best = (first + last) / 2, None
    # Sets with a passage in common share a few subsets; an eighth more segments tells them from partners.
    for slack in range(differ // 8, differ // 8 + MAX_SLACK + 1):
        total = differ + 1 + slack
        for wide in sorted({*range(min(total // 2, 8) + 1), total // 4, total // 2}):
            segments = total - wide
            # Accidents are counted for the smallest sets, which have the most empty segments.
            held, least = size / segments, first / segments
            few = math.exp(-least)
            accidents = (segments - wide) * few**2 + wide * (few * (1 + least)) ** 2
            needed = slack // 2 + 1 if wide else slack + 1
            met = math.exp(min(0.0, needed * math.log(max(accidents, 1e-300)) - math.lgamma(needed + 1)))
            cost = segments + wide * held + CANDIDATE_COST * count * met
            if best is None or cost < best[0]:
                best = cost, Plan(segments, wide, slack)
    return best[1]


class Planner:
    """Plans per group, from (size class, number of texts); the same on the driver and in every task."""

    def __init__(self, threshold: int, counts: Mapping[int, int]) -> None:
        if not 50 <= threshold <= 100:
            raise ValueError("threshold must be between 50 and 100 percent")
        self.threshold, self.counts, self._plans = threshold, dict(counts), {}

    def plan(self, group: int) -> Plan:
        if group not in self._plans:
            first, last, differ = extent(group, self.threshold)
            low, high = math.log2(max(first, 1)) * _CLASSES, math.log2(last + 1) * _CLASSES
            count = sum(n for c, n in self.counts.items() if low - 1 <= c <= high)
            self._plans[group] = _plan(first, last, differ, count)
        return self._plans[group]

    def of(self, size: int) -> list[tuple[int, Plan]]:
        """The groups of a set that can have partners, with their plans."""
        plans = [(g, self.plan(g)) for g in groups_of(size, self.threshold)]
        return [(g, p) for g, p in plans if p.segments]


def size_classes(docs: DataFrame, text_col: str) -> dict[int, int]:
    """About how many sets there are per size class, from the lengths of the texts: a few hundred rows."""
    words = F.greatest(F.octet_length(F.col(text_col).cast("string")) / _WORD_BYTES, F.lit(1.0))
    classes = docs.select(F.floor(F.log2(words) * _CLASSES).cast("int").alias("c")).filter("c IS NOT NULL")
    return {r["c"]: r["n"] for r in classes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}


def signatures(elements: np.ndarray, group: int, plan: Plan) -> np.ndarray:
    """Bucket keys of a set: its subsets by segment, then the one-deletion neighbours of the wide segments."""
    own = mix(elements ^ np.uint64(0xA5A5A5A5 + group))
    at = ((own >> np.uint64(32)) * np.uint64(plan.segments)) >> np.uint64(32)
    sums = np.zeros(plan.segments, dtype=np.uint64)
    np.add.at(sums, at, own)
    place = mix(np.arange(plan.segments, dtype=np.uint64) + np.uint64(group << 40))
    keys = [mix(sums + place)]
    if plan.wide:
        inside = at < plan.wide
        keys.append(mix(sums[at[inside]] - own[inside] + place[at[inside]]))
    return np.concatenate(keys)


def prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, planner: Planner) -> DataFrame:
    """(id, n_shingles, hi, lo, keys): size, name and signatures of every row.

    ``keys`` holds int64: for each group of the set the number of its signatures, then the signatures.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out = []
            for e in element_sets(batch, hasher, shingle):
                parts = []
                for group, plan in planner.of(len(e)) if len(e) else ():
                    keys = signatures(e, group, plan)
                    parts += [np.array([len(keys)], dtype=np.uint64), keys]
                out.append((len(e), *name(e), np.concatenate(parts).tobytes() if parts else None))
            columns = list(zip(*out)) if out else [()] * 4
            arrays = [batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())]
            yield pa.record_batch(arrays, names=["id", "n_shingles", "hi", "lo", "keys"])

    return bodies(docs, id_col, text_col).mapInArrow(sign, "id long, n_shingles long, hi long, lo long, keys binary")


def _spread(signed: DataFrame, planner: Planner, wanted: Broadcast | None = None) -> DataFrame:
    """(bucket, node, group, gain, need): the signatures of every set, one a row.

    ``gain`` is the allotment that a signature met stands for and ``need`` what a set must gain in that
    group. A set that several rows of a batch have is spread once. With ``wanted``, a bitmap of buckets, only
    signatures that may be in it are emitted.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if wanted is None else np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in batches:
            rows = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int16), np.zeros(0, np.int8), np.zeros(0, np.int32))]
            first = np.unique(batch.column("node").to_numpy(zero_copy_only=False), return_index=True)[1]
            chosen = batch.take(pa.array(first))
            for node, size, raw in zip(*(chosen.column(c).to_pylist() for c in ("node", "n_shingles", "keys"))):
                whole, at = np.frombuffer(raw, dtype=np.int64), 0
                for group, plan in planner.of(size):
                    n = int(whole[at])
                    keys = whole[at + 1 : at + 1 + n]
                    gain = np.full(n, 2, dtype=np.int8)
                    gain[plan.wide : plan.segments] = 1
                    at += n + 1
                    if bitmap is not None:
                        place = keys & (MAP_BITS - 1)
                        may = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0
                        keys, gain = keys[may], gain[may]
                    same = lambda value, kind: np.full(len(keys), value, dtype=kind)
                    rows.append((keys, same(node, np.int64), same(group, np.int16), gain, same(plan.slack + 1, np.int32)))
            columns = [pa.array(np.concatenate(c)) for c in zip(*rows)]
            yield pa.record_batch(columns, names=["bucket", "node", "group", "gain", "need"])

    filled = signed.filter("keys IS NOT NULL AND id IS NOT NULL").select("node", "n_shingles", "keys")
    return filled.mapInArrow(spread, "bucket long, node long, group short, gain byte, need int")


def _bitmap_of(buckets: DataFrame) -> Broadcast:
    """A bitmap of ``MAP_BITS`` bits, 32 MB whatever the corpus, with the low bits of every bucket set."""
    place = F.pmod("bucket", F.lit(MAP_BITS)) + 1
    parts = buckets.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    whole = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    # One job: an iterator would run one per partition.
    found = parts.toArrow()
    for part, raw in zip(found["part"].to_pylist(), found["bits"]):
        bits = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
        start = (part - 1) * len(bits)
        whole[start : start + len(bits)] = bits
    return buckets.sparkSession.sparkContext.broadcast(whole.tobytes())


def bucket_members(signed: DataFrame, planner: Planner) -> DataFrame:
    """(bucket, node) of the sets that share enough with others to have a partner; staged."""
    # Counts alone move less than members would; equal sets may count more than once here.
    often = _spread(signed, planner).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    often = cut(often.select("bucket"))
    # The bitmap spares the other members their way to the exchange. Where it would be too full, a join does.
    if often.count() <= MAP_BITS // 8:
        met = _spread(signed, planner, _bitmap_of(often))
    else:
        met = _spread(signed, planner).join(often, "bucket")
    met = cut(met)
    shared = cut(crowded(met))
    release(signed.sparkSession, often, met)
    # A wide segment or a copy may count more than once, which only keeps more.
    gained = shared.groupBy("node", "group").agg(F.sum("gain").alias("gained"), F.max("need").alias("need"))
    enough = gained.filter("gained >= need").select("node", "group")
    # Copies dealt to different tasks were spread more than once.
    members = cut(shared.join(enough, ["node", "group"]).select("bucket", "node").distinct())
    release(signed.sparkSession, shared)
    return members


def named(signed: DataFrame) -> DataFrame:
    """``signed`` with ``node``, a 64-bit number per distinct set.

    It is the lower half of the set's name, save where two sets share that: about one pair is expected among six
    billion sets, so the list of such halves that is sent to the tasks is short.
    """
    twins = signed.groupBy("lo").agg(F.min("hi").alias("a"), F.max("hi").alias("b")).filter("a <> b").select("lo")
    halves = [row[0] for row in twins.collect()]
    return signed.withColumn("node", F.when(F.col("lo").isin(halves), F.col("hi")).otherwise(F.col("lo")))


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """(id, n_shingles, component_id): each document's class, named after its smallest id."""
    bound_batches(docs.sparkSession)
    planner = Planner(threshold, size_classes(docs, text_col))
    signed = named(cut(prints(docs, id_col, text_col, shingle, planner)))
    nodes = fold(signed, "node")
    members = bucket_members(signed, planner)
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = sets_of(wanted, docs, id_col, text_col, shingle)
    found = document_classes(signed, nodes, set_components(members, sets, threshold))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")
