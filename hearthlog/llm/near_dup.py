"""Near-duplicate documents by min-max hashing.

A document's set holds the hashes of its distinct word shingles. Under each permutation both the minimum
and the maximum are kept: the chance that two sets agree in either is their Jaccard similarity, so one
evaluation of a permutation yields two unbiased values, and because a set's minimum and maximum fall on
different elements their errors are negatively correlated, which lowers the variance of the estimate. The
values are cut into bands; documents that agree in a whole band are candidates, and candidates are
confirmed on their full sets.

* Equal sets are folded first and stand as one node, so copies cost a line each.
* With ``ROWS`` values a band and ``BANDS`` bands a pair at exactly the threshold is missed with
  probability (1 - 0.8**6)**40 = 5e-6, a pair at 0.9 with 3e-14.
* Candidates of a bucket are tried against pivots, see ``linking``; no link is lost to a cap.
* Sets are not stored. One pass over the texts leaves a line of band keys per document; the sets of those
  that share a bucket with another are made again from their texts when links are confirmed.

Null and blank texts have an empty set and link with nothing, and so does a row with a null id. Every
input row gives one result row; rows that share an id are judged by their own texts. Empty tables give
empty results. Other columns are ignored by ``classes`` and passed through by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.linking import bodies, crowded, document_classes, element_sets, fold, name, set_components, sets_of
from hearthlog.llm.tokens import Hasher, mix
from hearthlog.session import bound_batches, cut, release

SHINGLE = 5
THRESHOLD = 80
ROWS = 6
BANDS = 40
_PIECE = 4096


def _multipliers(n: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers, one per permutation."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def min_max(elements: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under every permutation: the signature, minima first."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(multipliers), dtype=np.uint64)
    for at in range(0, len(elements), _PIECE):
        permuted = multipliers[:, None] * elements[None, at : at + _PIECE]
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One key per band; minima and maxima alternate inside a band."""
    half = len(signature) // 2
    values = np.stack([signature[:half], signature[half:]], axis=1).reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for column in values.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, rows: int, bands: int) -> DataFrame:
    """(id, n_shingles, hi, lo, bands): set size, set name and band keys (int64 bytes) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, multipliers = Hasher(), _multipliers(rows * bands // 2)
        for batch in batches:
            out = [
                (len(e), *name(e), band_keys(min_max(e, multipliers), bands).tobytes() if len(e) else None)
                for e in element_sets(batch, hasher, shingle)
            ]
            sizes, hi, lo, keys = zip(*out) if out else ((), (), (), ())
            columns = [batch.column("id"), *(pa.array(c, pa.int64()) for c in (sizes, hi, lo)), pa.array(keys, pa.binary())]
            yield pa.record_batch(columns, names=["id", "n_shingles", "hi", "lo", "bands"])

    return bodies(docs, id_col, text_col).mapInArrow(sign, "id long, n_shingles long, hi long, lo long, bands binary")


def bucket_members(nodes: DataFrame, bands: int) -> DataFrame:
    """(bucket, node) of every node and band, for buckets of two nodes or more; staged."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k.as_buffer(), dtype=np.int64) for k in batch.column("bands")]
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            own = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), bands)
            yield pa.record_batch([pa.array(flat), pa.array(own)], names=["bucket", "node"])

    every = cut(nodes.select("node", "bands").mapInArrow(spread, "bucket long, node long"))
    members = cut(crowded(every))
    release(nodes.sparkSession, every)
    return members


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    rows: int = ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept): each document's class, named after its smallest id."""
    bound_batches(docs.sparkSession)
    prints = cut(fingerprints(docs, id_col, text_col, shingle, rows, bands))
    nodes = fold(prints, "bands")
    members = bucket_members(nodes, bands)
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = sets_of(wanted, docs, id_col, text_col, shingle)
    found = document_classes(prints, nodes, set_components(members, sets, threshold))
    kept = F.col("component_id").eqNullSafe(F.col("id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The input rows of one document of every class, the one with the smallest id.

    Rows that repeat an id are one document: they stay if the class of any of them is named after it.
    """
    verdicts = classes(docs, id_col, text_col, **settings)
    gone = verdicts.groupBy(id_col).agg(F.bool_or("kept").alias("stays")).filter("NOT stays")
    return docs.join(gone.select(F.col(id_col).alias("_gone")), docs[id_col] == F.col("_gone"), "left_anti")
