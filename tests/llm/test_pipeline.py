"""The named queries against SQL, and the pipeline against a plain version of its stages."""

import glob
import hashlib
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthlog.llm import decontaminate, line_rules
from hearthlog.llm.oracle import llm_oracles
from hearthlog.llm.queries import llm_queries
from tests.conftest import SMALL
from tests.llm.test_near_dup import WORD, plain_classes, words


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SMALL}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = llm_queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(tuple(row[c] for c in columns) for row in df.collect())
    cursor = duck.execute(llm_oracles()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got and got == Counter(tuple(row[i] for i in places) for row in cursor.fetchall())


def plain_keeps(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    if len(w) < 50 or 2 * len(repeated) > len(w):
        return False
    lost = sum(sum(map(len, WORD.findall(line))) for line in text.split("\n") if plain_line_fails(line))
    return 2 * lost <= sum(map(len, w))


def plain_line_fails(line):
    own = WORD.findall(line)
    bars, symbols = len(re.findall("[|»›•·]", line)), len(re.findall(line_rules.SYMBOLS, line))
    fails = not re.search(r"[.!?…][\"'”’»)\]]*([\x20\x09-\x0D]|$)", line) or symbols * 10 > len(line)
    fails |= bars >= 2 and bars * 4 >= len(own)
    return fails or (len(own) <= 15 and any(p in line.lower() for p in line_rules.BOILERPLATE))


def plain_clean(text):
    return "\n".join(line for line in text.split("\n") if WORD.search(line) and not plain_line_fails(line))


def plain_leaks_any(text, items):
    d = words(text)
    for item in items:
        w = words(item)
        if not w:
            continue
        k = min(5, len(w))
        grams = lambda ws: Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        own = grams(w)
        if not own.keys() & grams(d).keys():
            continue
        weigh = lambda g: sum(len(x.encode()) for x in g)
        n, total = min(len(w), len(d)), sum(c * weigh(g) for g, c in own.items())
        for s in range(len(d) - n + 1):
            have = grams(d[s : s + n])
            if sum(min(c, have[g]) * weigh(g) for g, c in own.items()) / total >= decontaminate.THRESHOLD:
                return True
    return False


def plain_mix(docs):
    tokens = Counter()
    for d in docs:
        tokens[d["source"]] += len(WORD.findall(d["text"]))
    total = sum(tokens.values())
    low, high = 0, 1 << 24
    while high - low > 1:
        middle = (low + high) // 2
        power = {s: (t / total) ** (middle / (1 << 24)) for s, t in tokens.items()}
        spread = max(power[s] / t for s, t in tokens.items()) * max(t / power[s] for s, t in tokens.items())
        low, high = (low, middle) if spread <= 2 else (middle, high)
    power = {s: (t / total) ** (high / (1 << 24)) for s, t in tokens.items()}
    cover = max(t / power[s] for s, t in tokens.items())
    out = Counter()
    for s, t in tokens.items():
        budget = max(t, int(power[s] * cover + 0.5))
        full, rest = divmod(budget, t)
        own = [d for d in docs if d["source"] == s]
        out.update({d["doc_id"]: full for d in own})
        run = 0
        for d in sorted(own, key=lambda d: hashlib.md5(f"{d['doc_id']}:{full}".encode()).hexdigest()):
            run += len(WORD.findall(d["text"]))
            if run > rest:
                break
            out[d["doc_id"]] += 1
    return out


def test_pipeline_equals_a_plain_version(spark):
    names = [c[0] for c in duckdb.sql(f"DESCRIBE SELECT * FROM '{SMALL}/documents.parquet'").fetchall()]
    docs = [dict(zip(names, row)) for row in table("documents")]
    kept = [{**d, "text": plain_clean(d["text"])} for d in docs if plain_keeps(d["text"])]
    texts = {d["doc_id"]: d["text"] for d in kept}
    assert any(d["text"] != texts.get(d["doc_id"], d["text"]) for d in docs)
    classes = plain_classes([(d["doc_id"], d["text"]) for d in kept], 5)
    kept = [d for d, (id_, _, component) in zip(kept, classes) if id_ == component]
    items = [text for _, text in table("benchmark")]
    kept = [d for d in kept if not plain_leaks_any(d["text"], items)]
    want = plain_mix(kept)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r.doc_id for r in rows) == want and len(want) > 50
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"shard": F.lit("clash"), "kept": F.lit("clash")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
    last = corpus_pipeline.sharding(spark, docs.withColumn("input_shard", F.lit("other")), SMALL)
    assert {tuple(r) for r in last.select("input_input_shard", "input_shard", "kept").distinct().collect()} == {("clash", "other", "clash")}
    assert last.schema["shard"].dataType.simpleString() == "int"
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
