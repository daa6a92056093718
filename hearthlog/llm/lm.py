"""Scoring texts with a causal self-attention model that is trained on the corpus itself.

Documents whose id's CRC-32 (of its decimal text) is a multiple of ten are held out; everything is learned
from the others. The job:

1. *Stage.* Ids and texts are written in files of about ``BLOCK_BYTES`` of text; a file is a block.
2. *Words.* Every block lists its distinct words (as 64-bit hashes) with their training counts. A window
   per word turns them into corpus counts, which go back to the blocks that have the word. So a word
   crosses the network once per block, not once per occurrence, and no vocabulary is ever in one place.
3. *Subwords.* In the same pass all subwords of the training text are counted; the most frequent pieces
   form the vocabulary. A second pass counts id pairs over all training text (the bigram model the
   network corrects) and cuts all training text into windows. Windows overlap by half, so ``RUN`` of them that
   follow each other are stored as one row, which holds their ids once.
4. *Training.* In ``ROUNDS`` rounds, each over its own part of the windows, every task trains a copy of the
   network and Spark averages the copies. The number of tasks grows with the corpus. A task mixes the windows of its
   rows. The files of a round go before the next one begins, the windows before the scoring.
5. *Scoring.* Each block meets its words' counts and is scored whole: every word and subword once. A
   word's probability is ``NETWORK_SHARE`` of the network's and the rest of the word's share of the
   training tokens; the end token's likewise.

The driver holds the vocabulary, the id-pair counts and the network, which have fixed sizes. A task holds
one block (a text longer than a block is a block of its own).

Null and empty texts are the end token alone. A null id counts as the empty text in the hold-out rule;
rows with repeated ids are scored, and trained on, one by one; with nothing to train on the counts are
zero and the network is its starting point; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm import attention
from hearthlog.llm.subwords import CHOSEN, SIZE, VOCABULARY, Lexicon, Pieces, lexicons, public_pieces, ragged
from hearthlog.llm.tokens import Hasher
from hearthlog.session import cut, release, scratch_dir

BLOCK_BYTES = 8_000_000
ROUNDS = 3
BATCH = 64
RUN = 16
WINDOWS_PER_TASK = 20_000
RATE = 1e-2
NETWORK_SHARE = 0.75
HELD_OUT = 10


def is_held_out(id_: Column) -> Column:
    text = F.coalesce(id_.cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(HELD_OUT)) == 0


def stage_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, held_out, body, block), written once; ``block`` names the file a row is in."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        is_held_out(F.col(id_col)).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    mean = rows.agg(F.avg(F.octet_length("body"))).first()[0] or 0
    path = f"{scratch_dir(docs.sparkSession)}/lm-{uuid.uuid4().hex}"
    writer = rows.write.option("maxRecordsPerFile", max(1, int(BLOCK_BYTES / (mean + 1))))
    writer.option("compression", "zstd").parquet(path)
    staged = docs.sparkSession.read.schema(rows.schema).parquet(path)
    return staged.withColumn("block", F.xxhash64(F.col("_metadata.file_name")))


def _train_counts(lexicon: Lexicon, held_out: np.ndarray) -> np.ndarray:
    """Training occurrences of each distinct word of a group of texts."""
    own = held_out[lexicon.first : lexicon.first + len(lexicon.bounds) - 1]
    trained = np.repeat(~own, np.diff(lexicon.bounds))
    return np.bincount(lexicon.numbers[trained], minlength=len(lexicon.hashes))


def word_rows(staged: DataFrame, vocabulary: str) -> DataFrame:
    """(block, key, n): training counts of each block's words; with a null block, of the list's subwords."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, pieces = Hasher(), Pieces(public_pieces(vocabulary))
        subwords = np.zeros(256 + len(pieces.pieces), dtype=np.int64)
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            block = batch.column("block").to_numpy()
            # A batch holds rows of one file or of several small ones.
            edges = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                for lexicon in lexicons(batch.column("body").slice(lo, hi - lo), hasher):
                    n = _train_counts(lexicon, held[lo:hi])
                    ids, bounds = pieces.cut(lexicon.data, lexicon.starts, lexicon.ends)
                    subwords += np.bincount(
                        ids, weights=np.repeat(n, np.diff(bounds)), minlength=len(subwords)
                    ).astype(np.int64)
                    blocks = pa.array(np.full(len(n), block[lo] if hi > lo else 0), pa.int64())
                    columns = [blocks, pa.array(lexicon.hashes.view(np.int64)), pa.array(n)]
                    yield pa.record_batch(columns, names=["block", "key", "n"])
        used = np.flatnonzero(subwords)
        columns = [pa.nulls(len(used), pa.int64()), pa.array(used), pa.array(subwords[used])]
        yield pa.record_batch(columns, names=["block", "key", "n"])

    return staged.select("held_out", "body", "block").mapInArrow(count, "block long, key long, n long")


def choose_pieces(counts: DataFrame, vocabulary: str) -> list[bytes]:
    """The pieces the training text uses most, at most ``CHOSEN``; ids then follow frequency."""
    listed = public_pieces(vocabulary)
    top = counts.filter("key >= 256 AND n > 0").orderBy(F.desc("n"), "key").limit(CHOSEN).collect()
    return [listed[row["key"] - 256] for row in top]


def pair_rows(staged: DataFrame, pieces: list[bytes]) -> DataFrame:
    """(pair, n, rows): counts of id pairs over all training text, and runs of n training windows (``pair`` null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cutter = Hasher(), Pieces(pieces)
        pairs = np.zeros(SIZE * SIZE, dtype=np.int64)
        for batch in batches:
            texts = batch.column("body").filter(pc.invert(batch.column("held_out")))
            for lexicon in lexicons(texts, hasher):
                sequence, borders, _, _ = _sequence(lexicon, cutter)
                inside = np.ones(len(sequence) - 1, dtype=bool)
                inside[borders[1:-1] - 1] = False
                code = sequence[:-1].astype(np.int64) * SIZE + sequence[1:]
                pairs += np.bincount(code[inside], minlength=SIZE * SIZE)
                for lo, hi in _stretches(borders, 1 << 16):
                    rows, _ = attention.runs(sequence[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo], RUN)
                    own = (rows[:, attention.CONTEXT + 1 :: attention.CONTEXT] >= 0).sum(axis=1)
                    packed = pa.array([r.tobytes() for r in rows], pa.binary())
                    columns = [pa.nulls(len(rows), pa.int64()), pa.array(own, pa.int64()), packed]
                    yield pa.record_batch(columns, names=["pair", "n", "rows"])
        used = np.flatnonzero(pairs)
        columns = [pa.array(used), pa.array(pairs[used]), pa.nulls(len(used), pa.binary())]
        yield pa.record_batch(columns, names=["pair", "n", "rows"])

    return staged.select("held_out", "body").mapInArrow(count, "pair long, n long, rows binary")


def _sequence(lexicon: Lexicon, cutter: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group's texts as subword ids with their ends, their borders; and of every word and end, the number
    of its ids and its number in the lexicon (-1 for ends)."""
    ids, bounds = cutter.cut(lexicon.data, lexicon.starts, lexicon.ends)
    flat, places = ragged(ids, bounds, lexicon.numbers)
    sequence, borders = attention.join_texts(flat, places[lexicon.bounds])
    sizes = np.insert(np.diff(places), lexicon.bounds[1:], 1)
    numbers = np.insert(lexicon.numbers, lexicon.bounds[1:], -1)
    return sequence, borders, sizes, numbers


def fit(staged: DataFrame, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(id-pair counts, network parameters)."""
    spark = staged.sparkSession
    found = cut(pair_rows(staged, pieces), compression="zstd")
    pairs = np.zeros(SIZE * SIZE, dtype=np.int64)
    totals = found.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most SIZE**2
    pairs[totals["pair"].to_numpy()] = totals["n"].to_numpy()
    tables = spark.sparkContext.broadcast(attention.bigram_logits(pairs))
    runs = found.filter("rows IS NOT NULL")
    shuffled = runs.select("rows", F.pmod(F.xxhash64("rows"), F.lit(ROUNDS)).alias("round"))
    tasks = max(1, -(-(runs.agg(F.sum("n")).first()[0] or 0) // (WINDOWS_PER_TASK * ROUNDS)))
    flat = attention.start()
    for round_ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(flat)
        own = shuffled.filter(F.col("round") == round_).select("rows").repartition(tasks)
        rate = RATE * (1 - round_ / ROUNDS)
        copies = own.mapInArrow(lambda batches, s=sent, r=rate: _train_copy(batches, s, tables, r), "at int, x double")
        mean = copies.groupBy("at").agg(F.avg("x").alias("x")).toArrow()  # one row per parameter
        if mean.num_rows:
            flat = np.zeros_like(flat)
            flat[mean["at"].to_numpy()] = mean["x"].to_numpy()
        release(spark)
    release(spark, found)
    return pairs, flat


def _train_copy(
    batches: Iterator[pa.RecordBatch], sent: Broadcast, tables: Broadcast, rate: float
) -> Iterator[pa.RecordBatch]:
    """One task's copy of the network after its windows, a row per parameter."""
    model = attention.Model(sent.value.copy(), *tables.value)
    seen = 0

    def parts() -> Iterator[np.ndarray]:
        nonlocal seen
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("rows").to_pylist()), dtype=np.int16)
            rows = attention.windows_of(rows.reshape(batch.num_rows, -1))
            rows = rows[np.random.default_rng(seen).permutation(len(rows))]
            seen += len(rows)
            for at in range(0, len(rows), BATCH):
                yield rows[at : at + BATCH]

    attention.train(model, parts(), rate)
    if seen:
        columns = [pa.array(np.arange(len(model.flat), dtype=np.int32)), pa.array(model.flat.astype(np.float64))]
        yield pa.record_batch(columns, names=["at", "x"])


SCORES = (
    "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long"
)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per input row: hold-out flag, token counts, unigram base score and the model's score (log10)."""
    spark = docs.sparkSession
    staged = stage_blocks(docs, id_col, text_col)
    rows = cut(word_rows(staged, vocabulary))
    pieces = choose_pieces(rows.filter("block IS NULL").groupBy("key").agg(F.sum("n").alias("n")), vocabulary)
    pairs, flat = fit(staged, pieces)
    model = spark.sparkContext.broadcast((flat, *attention.bigram_logits(pairs)))

    per_word = Window.partitionBy("key")
    first = F.row_number().over(per_word.orderBy("block")) == 1
    words = rows.filter("block IS NOT NULL").select("block", "key", F.sum("n").over(per_word).alias("c"), first.alias("first"))
    words = cut(words)
    release(spark, rows)
    train_docs = staged.filter("NOT held_out").count()
    seen = words.filter("first AND c > 0").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    total = (seen["n"] or 0) + train_docs
    share = NETWORK_SHARE if total else 1.0
    kinds = seen["v"] + (train_docs > 0)
    kind = dict(staged.dtypes)["id"]

    def one(n: np.ndarray | int) -> np.ndarray | float:
        """Base log-probability of a token that was counted n times."""
        return np.log10((n + 0.1) / (total + 0.1 * (kinds + 1)))

    def score_block(block: pa.Table, counts: pa.Table) -> pa.Table:
        network, hasher, cutter = attention.Model(*model.value), Hasher(), Pieces(pieces)
        keys = counts["key"].to_numpy()
        order = np.argsort(keys)
        keys, c = keys[order], counts["c"].to_numpy()[order]
        block = block.combine_chunks()
        body = block["body"].combine_chunks()
        body = body if isinstance(body, pa.Array) else pa.concat_arrays(body.chunks)
        n_tokens, n_known, base, own = [], [], [], []
        subwords = []
        for lexicon in lexicons(body, hasher):
            at = np.searchsorted(keys, lexicon.hashes.view(np.int64)).clip(max=max(len(keys) - 1, 0))
            count = np.where(keys[at] == lexicon.hashes.view(np.int64), c[at], 0) if len(keys) else np.zeros(len(at))
            sums = lambda per_word: _per_text(per_word[lexicon.numbers], lexicon.bounds)
            n_tokens.append(np.diff(lexicon.bounds) + 1)
            n_known.append(sums((count > 0).astype(np.int64)) + (train_docs > 0))
            base.append(sums(one(count)) + one(train_docs))
            sequence, borders, sizes, word_of = _sequence(lexicon, cutter)
            pieces_log = np.empty(len(sequence) - len(borders) + 1)
            # Texts in turn, so that windows of a few megabytes are open at a time.
            for lo, hi in _stretches(borders, 1 << 16):
                part, _ = attention.windows(sequence[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo])
                real = part[:, attention.CONTEXT + 1 :] >= 0
                pieces_log[borders[lo] - lo : borders[hi] - hi] = network.log_probabilities(part)[real]
            # Sizes and word numbers cover the words of each text and then its end, whose number is -1.
            network_log = np.add.reduceat(pieces_log, np.cumsum(sizes) - sizes) if len(sizes) else pieces_log
            counted = np.append(count, train_docs)[word_of]
            each = np.log10(share * np.exp(network_log) + (1 - share) * counted / max(total, 1) + 1e-300)
            own.append(_per_text(each, lexicon.bounds + np.arange(len(lexicon.bounds))))
            subwords.append(np.diff(borders) - 1)
        gather = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        n = block.num_rows
        return pa.table(
            {
                "id": block["id"],
                "held_out": block["held_out"],
                "n_tokens": gather(n_tokens, pa.int64()),
                "n_known": gather(n_known, pa.int64()),
                "train_tokens": pa.array(np.full(n, total), pa.int64()),
                "base_score": gather(base, pa.float64()),
                "score": gather(own, pa.float64()),
                "n_subwords": gather(subwords, pa.int64()),
            }
        )

    met = staged.groupBy("block").cogroup(words.select("block", "key", "c").groupBy("block"))
    return met.applyInArrow(score_block, f"id {kind}, {SCORES}").withColumnRenamed("id", id_col)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    sums = np.bincount(text, weights=values, minlength=len(bounds) - 1)
    return sums.astype(values.dtype)


def _stretches(borders: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` ids; a text is never cut."""
    lo, n = 0, len(borders) - 1
    while lo < n:
        hi = int(np.searchsorted(borders, borders[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi
