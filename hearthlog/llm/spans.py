"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences, and every run of several consecutive sentences is hashed: from each sentence
on, the shortest run of at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words. A run depends on the
text behind its start alone, so the same passage gives the same runs wherever it stands. Runs are joined
over the whole corpus; the first of equal runs (smallest document id, then place) stays, and the sentences
under any other are removed.

A sentence ends with a word that ends in ``.``, ``!`` or ``?`` (closing quotes and brackets aside), at a
line break, or after ``MAX_SENTENCE`` words, so text without punctuation has runs too. Hashes ignore white space
and the case of A to Z. This plain rule finds a repeat without punctuation only where the words before it agree modulo
``MAX_SENTENCE``.

With ``by_words``, as the query has it, the sentence marks of other scripts count too, and sentences of more than ``MAX_WHOLE`` words
are cut where their words say so: of every ``WINDOW`` words running the one with the least hash ends a piece.
Whether a word does follows from the 7 words on either side of it, and pieces have 8 words at most. So a repeated
passage of 51 words loses at most 15 words at either end and always holds a run of the others, wherever it starts.

Only (hash, id, place) rows are moved: once to find repeated runs, with counts combined before the
exchange, and once to join them back, where Spark splits a run that very many documents share. Removals
are merged per document.

Null and blank texts have no runs. Rows with the same id are one document stored twice: a run at the same
place in both is no repetition. Null ids come last in the order. Empty tables give no rows; other columns
are ignored by ``repeated_runs`` and passed through by ``strip``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.tokens import Hasher, Words
from hearthlog.session import cut

MIN_SENTENCES = 2
MIN_WORDS = 20
MAX_SENTENCE = 24
MAX_WHOLE = 15
WINDOW = 8

# Sentence marks and closing quotes and brackets of many scripts, by their bytes.
_ASCII_MARKS, _ASCII_CLOSERS = ".!?", "\"')]}"
_MARKS = _ASCII_MARKS + "\u2026\u203c\u2047\u2048\u2049\u3002\uff01\uff0e\uff1f\uff61\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u104b\u17d4\u2e2e"
_CLOSERS = _ASCII_CLOSERS + "\u00bb\u2019\u201d\u203a\u300b\u300d\u300f\u3011\uff09"


def _ends_in(w: Words, ends: np.ndarray, chars: str) -> np.ndarray:
    """Bytes of the one of ``chars`` that each word, cut at ``ends``, ends in; 0 if it ends in none."""
    size = np.zeros(len(ends), dtype=np.int64)
    tail = np.zeros(len(ends), dtype=np.int64)
    for n in (1, 2, 3):
        tail |= w.data[np.maximum(ends - n, 0)].astype(np.int64) << (8 * (n - 1))
        codes = [int.from_bytes(c.encode(), "big") for c in chars if len(c.encode()) == n]
        size[np.isin(tail, codes) & (ends - w.starts >= n)] = n
    return size


def sentences(w: Words, longest: int = MAX_SENTENCE, by_words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, text) of every sentence in a run of texts."""
    n = len(w.starts)
    if n == 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    marks, closers = (_MARKS, _CLOSERS) if by_words else (_ASCII_MARKS, _ASCII_CLOSERS)
    inner = w.ends - _ends_in(w, w.ends, closers)
    done = (_ends_in(w, w.ends, marks) > 0) | (_ends_in(w, inner, marks) > 0)
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    done[:-1] |= breaks[w.starts[1:]] > breaks[w.ends[:-1]]
    borders = w.bounds[1:]
    done[borders[borders > 0] - 1] = True  # the last word of every text
    stops = np.flatnonzero(done) + 1
    sizes = np.diff(stops, prepend=0)
    if not by_words:
        pieces = -(-sizes // longest)
        which = np.repeat(np.arange(len(stops)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = (stops - sizes)[which] + nth * longest
        return first, np.minimum(first + longest, stops[which]), np.searchsorted(w.bounds, first, side="right") - 1
    # Winnowing: in long sentences the least hash of every window of words ends a piece.
    sentence = np.repeat(np.arange(len(stops)), sizes)
    long = np.flatnonzero(np.repeat(sizes > MAX_WHOLE, sizes))
    k = len(long) - WINDOW + 1
    if k > 0:
        values, sentence = w.hashes[long], sentence[long]
        least, at = values[:k].copy(), np.arange(k)
        for step in range(1, WINDOW):
            less = values[step : step + k] <= least
            least[less] = values[step : step + k][less]
            at[less] = np.flatnonzero(less) + step
        done[long[at[sentence[:k] == sentence[WINDOW - 1 :]]]] = True
        stops = np.flatnonzero(done) + 1
    first = np.concatenate([[0], stops[:-1]])
    return first, stops, np.searchsorted(w.bounds, first, side="right") - 1


def runs(w: Words, hasher: Hasher, least: int, least_words: int, longest: int, by_words: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, text, first word in the text, number of words) of every run."""
    first, end, text = sentences(w, longest, by_words)
    k = np.arange(len(first))
    last = np.maximum(k + least - 1, np.searchsorted(end, first + least_words))
    whole = np.flatnonzero(last < len(first))
    whole = whole[text[last[whole]] == text[whole]]
    a, b = first[whole], end[last[whole]]
    return hasher.span_hashes(w.hashes, a, b), text[whole], a - w.bounds[text[whole]], b - a


def all_runs(
    docs: DataFrame, id_col: str, text_col: str, least: int, least_words: int, longest: int, by_words: bool = False
) -> DataFrame:
    """(run, id, first_word, n_words) of every run of every document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for w in hasher.words(batch.column("body")):
                names, text, at, n = runs(w, hasher, least, least_words, longest, by_words)
                ids = batch.column("id").take(pa.array(text + w.first))
                columns = [pa.array(names.view(np.int64)), ids, pa.array(at), pa.array(n)]
                yield pa.record_batch(columns, names=["run", "id", "first_word", "n_words"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(emit, "run long, id long, first_word long, n_words long")


def repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_sentences: int = MIN_SENTENCES,
    min_words: int = MIN_WORDS,
    max_sentence: int = MAX_SENTENCE,
    by_words: bool = False,
) -> DataFrame:
    """What to remove: (id, first_word, n_words, first_id), one row per stretch of repeated sentences.

    ``first_id`` is the smallest id among the documents in which the stretch's runs stand first.
    """
    found = all_runs(docs, id_col, text_col, min_sentences, min_words, max_sentence, by_words)
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("first_id"), F.col("first_word").alias("first_at"))
    repeated = found.groupBy("run").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Staged, so that both sides of the join are dealt out for it alone and a skewed run can be split.
    again = found.join(cut(repeated.select("run", "p")), "run").filter(
        ~(F.col("id").eqNullSafe(F.col("p.first_id")) & (F.col("first_word") == F.col("p.first_at")))
    )
    spans = again.select("id", "first_word", (F.col("first_word") + F.col("n_words")).alias("end"), "p.first_id").distinct()
    order = Window.partitionBy("id").orderBy("first_word", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first_word") > F.coalesce(reached, F.lit(-1)), 1).otherwise(0)
    grouped = spans.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(order))
    return (
        grouped.groupBy("id", "stretch")
        .agg(
            F.min("first_word").alias("first_word"),
            (F.max("end") - F.min("first_word")).alias("n_words"),
            F.min("first_id").alias("first_id"),
        )
        .select(F.col("id").alias(id_col), "first_word", "n_words", "first_id")
    )


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The input rows with the repeated sentences cut out of the text."""
    cuts = repeated_runs(docs, id_col, text_col, **settings).groupBy(F.col(id_col).alias("_id")).agg(
        F.collect_list(F.struct("first_word", "n_words")).alias("_cuts")
    )
    joined = docs.join(cuts, docs[id_col].eqNullSafe(F.col("_id")), "left").drop("_id")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts, cuts = batch.column(text_col), batch.column("_cuts").to_pylist()
            out = texts.to_pylist()
            for w in hasher.words(texts):
                for t in range(len(w.bounds) - 1):
                    if not cuts[w.first + t] or out[w.first + t] is None:
                        continue
                    lo, base = w.bounds[t], w.offsets[t]
                    raw, keep, at = out[w.first + t].encode(), [], 0
                    for c in sorted(cuts[w.first + t], key=lambda c: c["first_word"]):
                        a = w.starts[lo + c["first_word"]] - base
                        end = lo + c["first_word"] + c["n_words"]
                        keep.append(raw[at:a])
                        at = w.starts[end] - base if end < w.bounds[t + 1] else len(raw)
                    out[w.first + t] = b"".join([*keep, raw[at:]]).decode()
            columns = {n: batch.column(n) for n in batch.schema.names if n != "_cuts"}
            columns[text_col] = pa.array(out, pa.string())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return joined.mapInArrow(cut_out, docs.schema)
