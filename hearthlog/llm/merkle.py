"""Merkle manifest of a dataset: one root over groups of rows, and a proof for every row.

A row's leaf is the SHA-256 of its fields. Leaves of a group stand in the order of the order column; every
``FANOUT`` consecutive nodes of a level become the hash of their concatenated hex digests until one node is
left, the group's subroot. Subroots in group order become the root in the same way.

A block holds ``BLOCK`` = ``FANOUT``**2 consecutive nodes and starts at a multiple of ``BLOCK``, so whole runs
lie inside it. It keeps each of its levels as one string of hex digests of fixed width: a parent is the hash of
a substring, and the siblings of a node are the substrings on its two sides within its run. The blocks' top
nodes are the next layer's nodes, grouped into blocks again, and so are the subroots: a layer is 256 times
smaller than the one below, so there are four layers over ten billion rows. Proofs are then handed down from
layer to layer, joined to whole blocks and cut into rows last.

A row moves twice and only as id, digest and what the caller carries, never with its text: once into range
partitions by group and order, which number the rows, and once to its block. A group of any size is cut into
blocks; no task sees more than the range partition or the blocks it was dealt. Every layer is written to the
shared folder, so a lost executor repeats a part of one layer.

Null groups form a group of their own, before all others; other groups stand in UTF-8 order. Null ids come
first. Rows that share group and id stand in the order of their leaves; rows equal in every field are
interchangeable. Null fields have a form no value has; empty and very long texts are hashed whole. An empty
table has no rows and no root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.shards import in_order
from hearthlog.llm.text import lower_ascii
from hearthlog.session import cut

FANOUT = 16
BLOCK = FANOUT * FANOUT
_WIDTH = 64  # hex digits of a digest
_PROOF = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (numbers in decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that ``node`` leads to with the siblings of ``proof``, lowest level first."""
    return F.aggregate(proof, node, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _parents(level: Column) -> Column:
    """The next level's string: the hash of every run of ``FANOUT`` digests."""
    run = _WIDTH * FANOUT
    last = F.floor((F.length(level) - 1) / run).cast("int")
    return F.array_join(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), ""
    ).cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (k, p, n, digest, x), ``p`` of ``n`` in group ``k``, as blocks (k, b, n, xs, low, high, climb, top).

    ``low`` and ``high`` are the level strings and ``climb`` how many of them have a level above in the block:
    a group that fits one block stops at its single node, the blocks of a larger one go up both levels.
    """
    row = F.struct("p", "digest", "x")
    grouped = nodes.groupBy("k", F.floor(F.col("p") / BLOCK).alias("b")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(row)).alias("rows")
    )
    strung = grouped.select(
        "k",
        "b",
        "n",
        F.transform("rows", lambda r: r["x"]).alias("xs"),
        F.array_join(F.transform("rows", lambda r: r["digest"]), "").cast("binary").alias("low"),
    )
    strung = strung.withColumn("high", _parents(F.col("low")))
    climb = F.when(F.col("n") == 1, 0).when(F.col("n") <= FANOUT, 1).otherwise(2)
    top = (
        F.when(F.col("n") == 1, F.col("low").cast("string"))
        .when(F.col("n") <= FANOUT, F.col("high").cast("string"))
        .otherwise(F.sha2("high", 256))
    )
    return strung.withColumn("climb", climb).withColumn("top", top)


def _flanks(level: Column, place: Column) -> Column:
    """What stands left and right of node ``place`` in its run."""
    run, member = F.floor(place / FANOUT), place % FANOUT
    text = lambda start, length: F.substring(level, start.cast("int"), length.cast("int")).cast("string")
    start = run * (_WIDTH * FANOUT) + 1
    return F.struct(
        text(start, member * _WIDTH).alias("left"),
        text(start + (member + 1) * _WIDTH, (FANOUT - 1 - member) * _WIDTH).alias("right"),
    )


def _up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The layers of blocks over ``nodes``, lowest first, and (k, digest) of every group's last node."""
    layers = []
    while True:
        blocks = cut(_blocks(nodes))
        layers.append(blocks)
        if blocks.filter(F.col("n") > BLOCK).isEmpty():
            return layers, blocks.select("k", F.col("top").alias("digest"))
        above = F.ceil(F.col("n") / BLOCK)
        nodes = blocks.select("k", F.col("b").alias("p"), above.alias("n"), F.col("top").alias("digest"), F.col("b").alias("x"))


def _down(layers: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """(k, x, digest, proof) of the lowest layer's nodes, and the other columns of ``tops`` (k, proof, ...)."""
    carried = [c for c in tops.columns if c not in ("k", "proof")]
    upper = tops.withColumn("x", F.lit(0).cast("long"))
    for blocks in reversed(layers):
        met = blocks.join(upper.withColumnRenamed("x", "b"), ["k", "b"])

        def of(x: Column, at: Column) -> Column:
            own = F.slice(F.array(_flanks(F.col("low"), at), _flanks(F.col("high"), F.floor(at / FANOUT))), 1, F.col("climb"))
            digest = F.substring(F.col("low"), at * _WIDTH + 1, F.lit(_WIDTH)).cast("string")
            return F.struct(x.alias("x"), digest.alias("digest"), F.concat(own, F.col("proof")).alias("proof"))

        upper = met.select("k", *carried, F.inline(F.transform("xs", of)))
    return upper


def manifest(
    rows: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "source",
    order_col: str = "doc_id",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(order_col, leaf, subroot, root, proof, and the ``carry`` columns) of every row.

    ``proof`` is an array of (left, right): the concatenated digests before and after the row's node in its
    run, level by level up to the subroot and on to the root. ``fold(leaf, proof)`` gives the root.
    """
    carry = dict(carry or {})
    payload = F.struct(F.col(order_col).alias("o"), *[value.alias(f"c{i}") for i, value in enumerate(carry.values())])
    # '=' keeps the order of the names and tells the empty name from null.
    key = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaves = rows.select(
        key.alias("k"), payload.alias("x"), F.col(order_col).alias("o"), leaf(*[F.col(f) for f in fields]).alias("digest")
    )
    placed, _ = in_order(leaves, "k", "o", "digest")
    # One row per group, staged so that Spark knows its size.
    groups = cut(placed.groupBy("k").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")))
    numbered = placed.join(groups, "k").select("k", (F.col("rank") - F.col("first")).alias("p"), "n", "digest", "x")
    layers, subroots = _up(numbered)
    ordered, n = in_order(subroots, "k")
    ends = ordered.select(F.lit("").alias("k"), F.col("rank").alias("p"), F.lit(n).cast("long").alias("n"), "digest", F.col("k").alias("x"))
    top_layers, root = _up(ends)
    whole = root.select("k", F.array().cast(_PROOF).alias("proof"), F.col("digest").alias("root"))
    tops = _down(top_layers, whole).select(F.col("x").alias("k"), "proof", F.col("digest").alias("subroot"), "root")
    found = _down(layers, cut(tops))
    return found.select(
        F.col("x.o").alias(order_col),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "proof",
        *[F.col(f"x.c{i}").alias(name) for i, name in enumerate(carry)],
    )


def audit(docs: DataFrame) -> DataFrame:
    """Every document's proof, checked against a copy in which one document in five was tampered with.

    A document is tampered with where 5 divides the CRC-32 of its decimal id; its text's A to Z are
    lower-cased. A tampered text without capitals is the same text.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = lower_ascii(F.col("text"))
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    # Null where the leaf is the original one.
    changed = F.when(hit & (lowered != F.col("text")), leaf(*parts, lowered))
    found = manifest(docs, carry={"changed": changed})
    folded = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
