"""Merkle manifests and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthlog.llm import infill, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row):
    return sha("".join(map(plain_field, row)))


def plain_tree(nodes):
    """The top of a list of digests and, per node, its (left, right) digests level by level."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proofs[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        place = [p // 16 for p in place]
    return nodes[0], proofs


def plain_audit(rows):
    groups = {}
    for row in rows:
        groups.setdefault("" if row[1] is None else "=" + row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(groups, key=str.encode)
    trees = {k: plain_tree([r[2] for r in sorted(groups[k], key=lambda r: r[:3])]) for k in names}
    root, above = plain_tree([trees[k][0] for k in names])
    out = []
    for k, up in zip(names, above):
        for (_, _, leaf, row), own in zip(sorted(groups[k], key=lambda r: r[:3]), trees[k][1]):
            at = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                at = plain_leaf((*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4])))
            for left, right in own + up:
                at = sha(left + at + right)
            proof = sha("".join(left + right for left, right in own + up))
            out.append((row[0], leaf, trees[k][0], root, proof, at, at == root))
    return out


def some_docs(rng, sizes):
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Abc dEF", "lower only", "ÄÖ Ü ß 漢字", "X" * rng.randrange(3000)])
            rows.append((rng.randrange(10**6), source, rng.choice([None, "en"]), rng.choice([None, -1, 12]), text))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1}, {"": 256, "=": 257, "ä": 15, "z": 700, None: 33}])
def test_audit_matches_a_plain_tree(spark, sizes):
    rows = some_docs(random.Random(len(sizes)), sizes)
    rows += [rows[0], rows[0], (None, "a", None, None, "No id"), (rows[0][0], "a", "en", 1, "Same id")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS k", "2 AS digest", "3 AS leaf", "4 AS rank", "5 AS proof")
    got = merkle.audit(df.repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_audit(rows)))


def test_audit_of_many_sources(spark):
    rows = [(i, f"s{i % 300}", "en", i, f"Text {i}") for i in range(900)]
    got = merkle.audit(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(rows))


def test_audit_of_an_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_of_other_columns(spark):
    rows = [(i, i % 2, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "no int, side int, value string")
    got = merkle.manifest(df, ("no", "value"), "side", "no", {"twice": F.col("no") * 2})
    seen = got.withColumn("up", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert {r.up for r in seen} == {seen[0].root} and all(r.twice == 2 * r.no for r in seen)
    assert {r.leaf for r in seen} == {sha(plain_field(no) + plain_field(v)) for no, _, v in rows}
    assert all(len(level.left + level.right) % 64 == 0 for r in seen for level in r.proof)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(id_, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"42:{'' if id_ is None else id_}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_matches_a_plain_version(spark):
    rng = random.Random(13)
    pieces = ["wort", "ä漢😀", " ", "\n\n", "\t", " ", "<", "<S", "x" * 1500, "\x0b", "P>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", " ", "a", " a", "a ", "has <M> mark", "long " * 40000, "漢" * 5000]
    rows = list(enumerate(texts)) + [(7, "same id"), (7, "same id"), (None, "no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS form", "3 AS output", "4 AS _t")
    made = infill.infill(df).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in made)
    assert got == sorted(str((i, *plain_infill(i, t))) for i, t in rows)
    assert sorted(str((r.doc_id, r.back)) for r in made) == sorted(str((i, t or "")) for i, t in rows)
    assert {r.form for r in made} == {"plain", "spm", "psm"}
    assert infill.digests(infill.infill(df.limit(0))).collect() == []


@pytest.mark.parametrize("block", [1, 3, 8])
def test_cut_places_with_small_blocks(block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab \nä") for _ in range(rng.randrange(40))) for _ in range(200)]
    a, b = ([rng.randrange(50) for _ in texts] for _ in range(2))
    found = infill.cut_places(pa.array(texts), pa.array(a), pa.array(b), block).to_pylist()
    for text, x, y, got in zip(texts, a, b, found):
        units = UNIT.findall(text)
        low, high = sorted(v % (len(units) + 1) for v in (x, y))
        want = len(units), len("".join(units[:low])), len("".join(units[low:high]))
        assert tuple(got.values()) == want


def test_fenwick_sums_and_descent():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, 77)
    tree, owner = infill.Fenwick(counts), np.repeat(np.arange(77), counts)
    assert [tree.before(i) for i in range(78)] == [int(counts[:i].sum()) for i in range(78)]
    assert [tree.find(k + 1)[0] for k in range(len(owner))] == owner.tolist()
