"""Near-duplicate classes, sentence spans and leaks against plain versions."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from hearthlog.llm import components, decontaminate, near_dup, spans
from hearthlog.llm.tokens import Hasher

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_copies(rng, n, length, changes):
    base = [f"w{rng.randrange(3000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(length)] = f"w{rng.randrange(3000)}"
        out.append(" ".join(copy))
    return out


def plain_classes(rows, k):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    label[root(i)] = root(j)
    smallest = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            smallest[root(i)] = min(smallest.get(root(i), id_), id_)
    return [(id_, len(sets[i]), smallest[root(i)] if id_ is not None and sets[i] else id_) for i, (id_, _) in enumerate(rows)]


@pytest.mark.parametrize("k", [2, 5])
def test_classes_match_all_pairs(spark, k):
    rng = random.Random(k)
    texts = near_copies(rng, 40, 60, 12 // k) + near_copies(rng, 3, 40, 1)
    texts += [None, "", " \n", "one", "ONE", "one two", "one  TWO", "solo words here " * 4000]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[3], (rows[4][0], "other text under the same id"), (None, texts[0]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS set", "2 AS kept", "3 AS bucket")
    got = near_dup.classes(df, shingle=k).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, plain_classes(rows, k)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dup.keep_first(df, shingle=k)
    assert kept.columns == df.columns
    stay = {r.doc_id for r in got if r.kept}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i in stay)


def test_classes_of_an_empty_table(spark):
    assert near_dup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("task_edges", [0, 10**6])
def test_components_of_chains_and_stars(spark, task_edges):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (500, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, components.smallest_reachable(df, task_edges).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {200 + i: 100 for i in range(30)} | {500: 400}


@pytest.mark.parametrize("task_edges", [0, 10**6])
def test_components_of_random_edges(spark, task_edges):
    rng = random.Random(9)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
    label = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = dict(map(tuple, components.smallest_reachable(df, task_edges).collect()))
    assert got == {n: c for n, c in label.items() if n != c}
    assert components.smallest_reachable(df.limit(0), task_edges).count() == 0


def test_min_max_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    a, b = pool[:1000], pool[200:]
    m = near_dup._multipliers(400)
    agree = (near_dup.min_max(a, m) == near_dup.min_max(b, m)).mean()
    assert abs(agree - 800 / 1200) < 0.06


def plain_sentences(text):
    tokens = list(WORD.finditer(text))
    w = words(text)
    out, start = [], 0
    for i, t in enumerate(tokens):
        last = i + 1 == len(tokens)
        done = last or "\n" in text[t.end() : tokens[i + 1].start()]
        done |= w[i][-1] in ".!?" or (len(w[i]) > 1 and w[i][-1] in "\"')]}" and w[i][-2] in ".!?")
        if done or i + 1 - start == spans.MAX_SENTENCE:
            out.append((start, i + 1))
            start = i + 1
    return w, out


def test_spans_match_a_plain_version(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 14))) + rng.choice([".", "!", ".)", "\n"])
    shared = [" ".join(sentence() for _ in range(8)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [sentence() for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        texts.append(" ".join(parts).replace("v1", rng.choice(["v1", "V1"])))
    texts += [None, "", texts[0], "word " * 300, "word " * 300]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, shared[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS first_word")
    seen = {}
    for id_, text in rows:
        w, cuts = plain_sentences(text or "")
        for a in range(len(cuts)):
            for b in range(a + 1, len(cuts)):
                if cuts[b][1] - cuts[a][0] >= spans.MIN_WORDS:
                    seen.setdefault(tuple(w[cuts[a][0] : cuts[b][1]]), []).append(((id_ is None, id_ or 0), cuts[a][0], id_))
                    break
    want = {}
    for run, places in seen.items():
        first = min(places)[:2]
        for key, at, id_ in places:
            if (key, at) != first:
                want.setdefault(id_, set()).update(range(at, at + len(run)))
    found = spans.repeated_runs(df).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    assert got == want
    stripped = spans.strip(df)
    assert stripped.columns == df.columns and stripped.count() == len(rows)
    for r in stripped.collect():
        original = next(t for i, t in rows if i == r.doc_id)
        if original is None:
            assert r.text is None
        else:
            assert words(r.text) == [w for k, w in enumerate(words(original)) if k not in want.get(r.doc_id, ())]
    assert spans.repeated_runs(df.limit(0)).count() == 0


def held_runs(text, n_prefix):
    """Runs of a text, by name, that start behind its first words and end before its last 30."""
    hasher = Hasher()
    w = next(iter(hasher.words(pa.array([text]))))
    names, _, at, n = spans.runs(w, hasher, spans.MIN_SENTENCES, spans.MIN_WORDS, spans.MAX_SENTENCE, by_words=True)
    return {h for h, a, k in zip(names.tolist(), at, n) if a >= n_prefix and a + k <= len(w.starts) - 30}


@pytest.mark.parametrize("marked", [0.0, 0.05, 0.2])
def test_passages_without_marks_are_found_behind_any_prefix(marked):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" + "." * (rng.random() < marked) for _ in range(n)]
    for _ in range(20):
        passage = words(51)
        texts = [held_runs(" ".join([*words(k), *passage, *words(30)]), k) for k in range(31)]
        assert set.intersection(*texts)


def test_marks_of_other_scripts_end_sentences():
    w = next(iter(Hasher().words(pa.array(["一 二。 三 四？」 پنج؟ छह। 七 「八！』 nine… ten"]))))
    _, ends, _ = spans.sentences(w, by_words=True)
    assert ends.tolist() == [2, 4, 5, 6, 8, 9, 10]


def plain_leaks(docs, items):
    weigh = lambda g: sum(len(x.encode()) for x in g)
    out = set()
    for item_id, item in items:
        w = words(item)
        if not w:
            continue
        k = min(5, len(w))
        grams = lambda ws: Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        own = grams(w)
        total = sum(n * weigh(g) for g, n in own.items())
        for doc_id, text in docs:
            d = words(text)
            n = min(len(w), len(d))
            if n < k:
                continue
            best = max(
                (sum(min(c, have[g]) * weigh(g) for g, c in own.items()) / total, -s)
                for s in range(len(d) - n + 1)
                for have in [grams(d[s : s + n])]
            )
            if best[0] >= 0.8:
                out.add((doc_id, item_id, round(best[0], 9), -best[1], n))
    return out


def test_leaks_match_all_windows(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(rng.choice([3, 12, 30, 60])))) for i in range(12)]
    items += [(90, None), (91, ""), (None, "only three words"), (3, items[3][1])]
    docs = []
    for i in range(80):
        w = [f"q{rng.randrange(500)}" for _ in range(rng.randrange(120))]
        if i % 2:
            own = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "changed"
            w[len(w) // 2 : len(w) // 2] = own
        docs.append((i, " ".join(w).upper() if i % 3 else "\n".join(w)))
    docs += [(None, items[4][1]), (4, None), (4, ""), (5, "x only three WORDS y " * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS similarity")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    want = plain_leaks(docs, items)
    for block_bytes in (decontaminate.BLOCK_BYTES, 200):
        found = decontaminate.find_leaks(d, b, block_bytes=block_bytes).collect()
        assert {(r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in found} == want
        kept = decontaminate.drop_leaks(d, b, block_bytes=block_bytes)
        assert kept.columns == d.columns
        leaked = {w[0] for w in want}
        assert {r.doc_id for r in kept.collect()} >= {i for i, _ in docs} - leaked
        assert not {r.doc_id for r in kept.collect() if r.doc_id not in (4, 5)} & leaked
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0 == decontaminate.find_leaks(d, b.limit(0)).count()


@pytest.mark.parametrize("in_item", [False, True])
def test_leaks_with_a_long_word_are_found(in_item):
    rng = random.Random(17)
    texts = [[f"q{rng.randrange(500)}" for _ in range(40)] for _ in range(40)]
    url = lambda: "u" * rng.choice([80, 200, 500, 2000]) + str(rng.randrange(10**6))
    if in_item:
        texts = [[*t[:30], url(), *t[30:]] for t in texts]
    # Every document holds an item whole, but for a long word in its middle or for small changes.
    docs = []
    for i, t in enumerate(texts):
        own = [*t[:20], url(), *t[20:]] if not in_item else [*t[:3], "changed", *t[4:10], "again", *t[11:]]
        docs.append((i, " ".join(["before"] * 30 + own + ["after"] * 30)))
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = plain_leaks(docs, items)
    index = decontaminate.Index(pa.array([i for i, _ in items]), pa.array([t for _, t in items]))
    found = set()
    for w in Hasher().words(pa.array([t for _, t in docs])):
        for t, (item, similarity, at, n) in index.leaks(w, decontaminate.THRESHOLD):
            found.add((w.first + t, item, round(similarity, 9), at, n))
    assert found == want and len(want) >= 30


def test_blocks_find_all_fingerprints_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    target = np.uint64(rng.integers(0, 1 << 63))
    prints = np.array([target] * 3000)
    for i in range(3000):
        for bit in rng.choice(64, rng.integers(0, 50), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(bit)
    near = np.flatnonzero(np.bitwise_count(prints ^ target) <= decontaminate.RADIUS)
    assert decontaminate.within_radius(prints, target).tolist() == near.tolist()
