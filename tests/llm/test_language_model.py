"""The attention model: gradients, windows, counts, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hearthlog.llm import attention, lm
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(0)
    flat = attention.start().astype(np.float64) + rng.normal(0, 0.1, attention.N_PARAMETERS)
    tables = attention.bigram_logits(rng.integers(0, 3, attention.SIZE**2))
    sequence, borders = attention.join_texts(rng.integers(0, 1000, 200).astype(np.int16), np.array([0, 5, 5, 120, 200]))
    return attention.Model(flat, *(t.astype(np.float64) for t in tables)), sequence, borders


def test_gradients_match_differences(small_model):
    model, sequence, borders = small_model
    rows, _ = attention.windows(sequence, borders)
    _, gradient = model.gradient(rows)
    for name, part in attention.unpack(gradient).items():
        at = np.unravel_index(np.abs(part).argmax(), part.shape)
        value = attention.unpack(model.flat)[name]
        old, step = value[at], 1e-4
        value[at] = old + step
        up = model.gradient(rows)[0]
        value[at] = old - step
        down = model.gradient(rows)[0]
        value[at] = old
        assert math.isclose((up - down) / (2 * step), part[at], rel_tol=1e-4), name


def test_every_id_is_scored_once_with_context(small_model):
    model, sequence, borders = small_model
    rows, text = attention.windows(sequence, borders)
    targets = rows[:, attention.CONTEXT + 1 :]
    assert np.bincount(text, (targets >= 0).sum(axis=1)).tolist() == (np.diff(borders) - 1).tolist()
    assert np.concatenate([t[t >= 0] for t in targets]).tolist() == np.delete(sequence, borders[:-1]).tolist()
    values = model.log_probabilities(rows)
    loss, _ = model.gradient(rows)
    assert math.isclose(-values.sum() / (targets >= 0).sum(), loss, rel_tol=1e-6)


def test_predictions_are_distributions_and_causal(small_model):
    model, _, _ = small_model
    c = attention.CONTEXT
    row = np.arange(2 * c + 1, dtype=np.int16)[None]
    rows = np.repeat(row, attention.SIZE, axis=0)
    rows[:, c + 1] = np.arange(attention.SIZE)
    first = model.log_probabilities(rows)[:, 0]
    assert math.isclose(np.exp(first).sum(), 1, rel_tol=1e-6)
    # What stands behind a place does not change its prediction.
    later = row.copy()
    later[0, c + 2 :] = 500
    assert math.isclose(model.log_probabilities(later)[0, 0], first[c + 1], rel_tol=1e-9)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b"), (4, "the cat"), (4, "the dog"), (5, "x" * 100_000), (6, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS block", "3 AS id")
    got = lm.score(df).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 3, 3, 3, 50_001]
    assert lm.score(df.limit(0)).count() == 0


def test_counts_and_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = {r.doc_id: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in df.collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, words in docs.items() if i not in held for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    got = lm.score(df).collect()
    assert {r.doc_id for r in got if r.held_out} == held
    for r in got:
        tokens = [*docs[r.doc_id], None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    mine = [r for r in got if r.held_out]
    # Better than the same mixture of word counts and pieces that are all equally likely.
    equal = sum(r.n_subwords for r in mine) * -math.log10(attention.SIZE)
    assert sum(r.score for r in mine) > 0.75 * equal


def test_every_training_id_is_in_a_training_window(spark):
    rows = [(i, f"text{i} " * (40 * i)) for i in range(1, 30)]
    staged = lm.stage_blocks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = lm.pair_rows(staged, []).filter("rows IS NOT NULL").collect()
    windows = np.array([np.frombuffer(r["rows"], dtype=np.int16) for r in found])
    trained = (windows[:, attention.CONTEXT + 1 :] >= 0).sum()
    # Without pieces an id is a byte of a word; every text has an end.
    own = [t.replace(" ", "") for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert trained >= sum(map(len, own)) + len(own)


def test_runs_hold_the_windows_once(small_model, spark):
    _, sequence, borders = small_model
    whole, _ = attention.windows(sequence, borders)
    packed, _ = attention.runs(sequence, borders, lm.RUN)
    assert attention.windows_of(packed).tolist() == whole.tolist()
    # Stored windows share the ids in which they overlap.
    rows = [(i, "abcdefgh " * 300) for i in range(1, 30)]
    staged = lm.stage_blocks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = lm.pair_rows(staged, []).filter("rows IS NOT NULL").collect()
    n_windows = sum(len(attention.windows_of(np.frombuffer(r["rows"], dtype=np.int16)[None])) for r in found)
    ids = sum(i * len("abcdefgh") * 300 + i for i in [sum(1 for k, _ in rows if zlib.crc32(str(k).encode()) % 10)])
    assert n_windows == sum(r["n"] for r in found) >= ids / attention.CONTEXT
    assert sum(len(r["rows"]) for r in found) < 0.65 * n_windows * 2 * whole.shape[1]


def test_staged_windows_are_released(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(lm, "release", lambda spark, *staged: freed.append([set(s.columns) for s in staged]))
    rows = [(i, "some words to learn from " * 30) for i in range(1, 20)]
    lm.score(spark.createDataFrame(rows, "doc_id long, text string"))
    assert freed == [[]] * lm.ROUNDS + [[{"pair", "n", "rows"}], [{"block", "key", "n"}]]


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    # Every third id repeats the one three places before: only attention can know it.
    ids = rng.integers(0, 50, (300, 3)).repeat(12, axis=0).reshape(300, -1).astype(np.int16)
    sequence, borders = attention.join_texts(ids.ravel(), np.arange(301) * ids.shape[1])
    rows, _ = attention.windows(sequence, borders)
    pairs = np.bincount(sequence[:-1].astype(np.int64) * attention.SIZE + sequence[1:], minlength=attention.SIZE**2)
    model = attention.Model(attention.start(), *attention.bigram_logits(pairs))
    before = model.gradient(rows[:200])[0]
    attention.train(model, (rows[k : k + 64] for _ in range(6) for k in range(0, len(rows), 64)), 1e-2)
    assert model.gradient(rows[:200])[0] < before - 0.05
