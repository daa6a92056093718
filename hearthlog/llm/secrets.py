"""Secret scan with corpus-wide ownership frequency.

Candidates come from patterns: ``assign`` (a credential word and its value), ``access`` (access-key ids),
``hex`` (long hexadecimal runs) and ``bare`` (other long runs of letters and digits). A pattern cannot
tell a live key from the sample key of a manual, but the corpus can: the sample is copied by many
owners, a live key stays with one. So every candidate's value is hashed and counted by distinct owners
and repositories over the whole corpus, and a candidate is

* ``copied`` when its value occurs under ``copied_owners`` owners or more, or in ``copied_repos`` repositories or
  more, be they of one owner: a value that an owner has in many places is a sample of theirs;
* ``live`` when it is not copied, and looks live: ``live_length`` characters or more, letters and
  digits both, none of the fixed placeholder words.

The three base kinds are always reported; a ``bare`` candidate only when it is live and overlaps no base
span. Positions are code points, ends exclusive. They follow from the lengths of the pieces between
matches, since a regular expression's matches and the split at them interleave.

Texts are scanned once and only the spans are staged. Counting goes (value, owner, repository), then
(value, owner), then (value), each step combined before its exchange, so a key that a third of the
corpus copies is spread over owners and repositories first. Null texts count as empty; a null owner or
repository is one more owner or repository; rows with null or repeated ids keep one result row each;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.text import let
from hearthlog.session import cut

# The kinds in the order in which spans with the same start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
BARE = "[A-Za-z0-9_-]{32,}"
KINDS = ("assign", "access", "hex", "bare")
PLACEHOLDERS = "(?i)example|sample|changeme|placeholder|your|dummy|xxxx|0000|1234"

COPIED_OWNERS = 2
COPIED_REPOS = 5
LIVE_LENGTH = 20

# Matches whose positions are summed in one go, so that lists of matches are not copied once per match.
_CHUNK = 128
_SPAN = "struct<begin:bigint,rank:int,finish:bigint,value:string>"


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _spans(text: Column, rank: int, pattern: str, value_group: int, min_value: int) -> Column:
    """Matches of ``pattern``, leftmost and non-overlapping, whose value has ``min_value`` characters."""

    def placed(parts: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(parts["gaps"], i))
            finish = begin + F.length(F.get(parts["hits"], i))
            span = F.struct(
                begin.cast("long").alias("begin"),
                F.lit(rank).alias("rank"),
                finish.cast("long").alias("finish"),
                F.get(parts["values"], i).alias("value"),
            )
            return F.struct(finish.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        n = F.size(parts["hits"])

        def chunk(acc: Column, j: Column) -> Column:
            order = F.sequence(j * _CHUNK, F.least(j * _CHUNK + _CHUNK, n) - 1)
            own = F.aggregate(order, F.struct(acc["at"].alias("at"), _none().alias("out")), step)
            return let(own, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        chunks = F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))
        return F.flatten(F.aggregate(chunks, start, chunk, lambda acc: acc["out"]))

    parts = F.struct(
        F.split(text, pattern).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("values"),
    )
    found = F.when(text.rlike(pattern), let(parts, placed)).otherwise(_none())
    return F.filter(found, lambda s: F.length(s["value"]) >= min_value)


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["begin"].cast("string"), s["finish"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row per input row: its key ``row``, id, owner, repository, and its base and bare spans."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    )
    body = F.col("body")
    found = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "owner",
        "repo",
        F.sort_array(
            F.concat(_spans(body, 0, ASSIGN, 2, 6), _spans(body, 1, ACCESS, 0, 20), _spans(body, 2, HEX, 0, 24))
        ).alias("base"),
        _spans(body, 3, BARE, 0, 32).alias("bare"),
    )
    apart = lambda s: ~F.exists("base", lambda b: (b["begin"] < s["finish"]) & (s["begin"] < b["finish"]))
    return found.withColumn("bare", F.filter("bare", apart))


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every candidate value (``value_hash``)."""
    by_repo = spans.select("value_hash", "owner", "repo").distinct()
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos")
    )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    *,
    copied_owners: int = COPIED_OWNERS,
    copied_repos: int = COPIED_REPOS,
    live_length: int = LIVE_LENGTH,
) -> DataFrame:
    """One row per input row: span counts by kind and class, and the spans themselves.

    ``n_repos`` is the most repositories that share one of the row's reported values.

    ``base`` and ``spans`` are arrays of (begin, rank, finish, value); ``rank`` indexes ``KINDS``.
    """
    found = cut(candidates(docs, id_col, text_col, owner_col, repo_col))
    some = found.filter((F.size("base") > 0) | (F.size("bare") > 0))
    spans = some.select("row", "owner", "repo", F.explode(F.concat("base", "bare")).alias("span")).withColumn(
        "value_hash", F.sha2("span.value", 256)
    )
    value = F.col("span.value")
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    live = (
        ~copied
        & (F.length(value) >= live_length)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & ~value.rlike(PLACEHOLDERS)
    )
    classed = spans.join(ownership(spans), "value_hash").select(
        "row",
        "span",
        "n_repos",
        copied.alias("copied"),
        live.alias("live"),
    )
    base = F.col("span.rank") < 3
    reported = classed.filter(base | F.col("live")).groupBy("row").agg(
        F.sort_array(F.collect_list("span")).alias("spans"),
        F.count_if("copied").alias("n_copied"),
        F.count_if("live").alias("n_live"),
        F.max("n_repos").alias("n_repos"),
    )
    with_spans = some.join(reported, "row", "left").select(
        "id", "base", F.coalesce("spans", _none()).alias("spans"), "n_copied", "n_live", "n_repos"
    )
    without = found.filter((F.size("base") == 0) & (F.size("bare") == 0)).select(
        "id", "base", _none().alias("spans"), *[F.lit(None).alias(c) for c in ("n_copied", "n_live", "n_repos")]
    )
    of = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return with_spans.union(without).select(
        F.col("id").alias(id_col),
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        "base",
        "spans",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_copied", "n_live", "n_repos")],
    )


def digest(found: DataFrame) -> DataFrame:
    """``scan``'s rows with the spans as text and the base spans as a SHA-256."""
    last = ("n_copied", "n_live", "n_repos")
    keep = [c for c in found.columns if c not in ("base", "spans", *last)]
    return found.select(
        *keep,
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        *last,
    )
