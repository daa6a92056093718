"""WARC round trips and salvage; main text of pages."""

import base64
import gzip
import hashlib
import random

import pytest

from hearthlog.llm import site_tree, warc

PAGES = [
    (5, "http://a/", "<p>x</p>"),
    (2, "http://b/", "<p>x</p>"),
    (9, None, None),
    (8, "http://c/\r\nWARC-Type: evil", ""),
    (None, "http://d/", "<p>x</p>"),
    (7, "http://e/", "é" * 70_000),
    (3, "http://f/", "text with WARC/1.1\r\nWARC-Type: response\r\n\r\ninside"),
    (2, "http://b/", "<p>x</p>"),
]
SCHEMA = "page_id long, url string, html string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    df = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 AS digest", "2 AS id", "3 AS value")
    warc.write_archives(df, str(tmp_path / "w"), compress=compress)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert warc.gaps(records).count() == 0
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in records.collect()), key=str)
    want = []
    for id_, _, html in PAGES:
        payload = (html or "").encode()
        first = min((i for i, _, h in PAGES if (h or "") == (html or "") and i is not None), default=None)
        same = first == id_
        want.append((id_, "response" if same else "revisit", None if same else first, len(payload), digest(payload)))
    assert got == sorted(want, key=str)
    for r in records.filter("record_type = 'response'").collect():
        assert digest(bytes(r.payload)) == r.payload_digest
    for file in (tmp_path / "w").glob("part-*"):
        data = file.read_bytes()
        raw = gzip.decompress(data) if compress else data
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_large_record_still_ends_its_member():
    record = warc.record_bytes(1, "u", bytes(17 << 20), None)
    stored = warc._stored(record, True) + b"\0"
    found = [r for _, _, _, r in warc.salvage(stored) if r]
    assert len(found) == 1 and len(found[0].block) > 17 << 20


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_only_the_records_it_touches(compress):
    rng = random.Random(4)
    end = b"\0" if compress else b"\r\n"
    records = [warc.record_bytes(i, f"u{i}", rng.randbytes(300 + i * 10), None) for i in range(40)]
    stored = [warc._stored(r, compress) + end for r in records]
    starts = [sum(map(len, stored[:i])) for i in range(41)]
    whole = b"".join(stored)
    for trial in range(60):
        data = bytearray(whole)
        kind = trial % 4
        at = rng.randrange(len(data) - 400)
        if kind == 0:
            data[at] ^= 0x55
            hit = (at, at + 1)
        elif kind == 1:
            data[at : at + 200] = rng.randbytes(200)
            hit = (at, at + 200)
        elif kind == 2:
            del data[at : at + 150]
            hit = (at, at + 150)
        else:
            data[at:at] = rng.randbytes(90)
            hit = (at, at + 1)
        # Nothing vouches for an uncompressed record's header lines, so damage there may change the id.
        got = {r.headers.get("x-page-id") for _, _, _, r in warc.salvage(bytes(data)) if r}
        untouched = {str(i) for i in range(40) if starts[i + 1] <= hit[0] or starts[i] >= hit[1]}
        assert got >= untouched
        covered = 0
        for start, finish, reason, record in warc.salvage(bytes(data)):
            assert start >= covered and (reason is None) == (record is not None)
            covered = finish
    cut = whole[: starts[20] + 100]
    parts = list(warc.salvage(cut))
    assert len([p for p in parts if p[3]]) == 20 and parts[-1][:2] == (starts[20], len(cut)) and parts[-1][2]


def article(i, body):
    return (
        f"<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav>"
        f"<div class='cookie-notice'>We set cookies {i}</div><header>Site</header><div id=c><p>Our newsletter, every week.</p>"
        f"<p>{body}</p></div><aside>More {i}</aside><div class='comments'><p>First! {i}</p></div><footer>&copy; {i}</footer></body></html>"
    )


def test_site_tree_cuts_what_a_site_repeats(spark):
    rows = [(i, f"http://host/{i}", article(i, f"Story {i} &amp; more&nbsp;text.<br>Next\n line.")) for i in range(20)]
    rows += [(100, "http://small/1", article(1, "Alone.")), (101, None, None), (102, "odd url", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS host", "2 AS cuts", "3 AS text", "4 AS id")
    got = {r.page_id: r for r in site_tree.extract(df).collect()}
    for i in range(20):
        assert got[i].text == f"Story {i} & more text. Next line." and got[i].n_chars == len(got[i].text)
    # One page of a site cannot tell; empty pages have no text.
    assert got[100].text == "Our newsletter, every week.\nAlone."
    assert got[101].text == got[102].text == ""
    assert site_tree.extract(df.limit(0)).count() == 0


def test_copies_of_an_article_are_not_furniture(spark):
    page = "<body><div class=x>Menu line</div><article><h1>Title</h1><p>Same story everywhere.</p></article></body>"
    df = spark.createDataFrame([(i, "http://h/", page) for i in range(50)], SCHEMA)
    assert {r.text for r in site_tree.extract(df).collect()} == {"Title\nSame story everywhere."}


def test_versions_of_an_article_keep_their_text(spark):
    first, second, third = (f"{w} paragraph of the story, which is as long as a sentence is." for w in ("The first", "Second", "And a third"))
    page = lambda *parts: "<body><article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article></body>"
    rows = [
        (1, "http://a/1", page(first, second)), (2, "http://a/2", page(first, second, third)),
        (3, "http://b/1", page(first, second)), (4, "http://b/2", page(first, third)),
    ]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: f"{first}\n{second}", 2: f"{first}\n{second}\n{third}", 3: f"{first}\n{second}", 4: f"{first}\n{third}"}


@pytest.mark.parametrize("m", [2, 3, 5, 7])
def test_furniture_without_a_name_goes_from_small_sites(spark, m):
    page = "<body><ul><li>Start</li><li>About us</li></ul><div class=text><p>{}</p></div><div>All about tea.</div></body>"
    rows = [(i, "http://small/", page.format(f"Story number {i}, told at length.")) for i in range(m)]
    # A layout that two pages of a large site share.
    rows += [(100 + i, "http://large/", f"<body><p>Story number {i}.</p></body>") for i in range(30)]
    rows += [(200 + i, "http://large/", f"<body><p>Tale {i}.</p><div class=rare>Tea time.</div></body>") for i in range(2)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(m)] == [f"Story number {i}, told at length." for i in range(m)]
    assert [got[100 + i] for i in range(30)] == [f"Story number {i}." for i in range(30)]
    assert [got[200 + i] for i in range(2)] == [f"Tale {i}." for i in range(2)]


def test_branches_go_with_what_varies_in_them(spark):
    page = (
        "<body><div class=hint>{hint}</div><div class=box><ul><li>Start</li><li>About us</li><li>Where to find us</li></ul>"
        "<div><span>All about tea and how to make it.</span><p>Seen {i} times</p></div></div>"
        "<div class=text><p>Story number {i}, which is told at great length and never twice in the same words.</p>"
        "<p>Part two of {i}.</p></div></body>"
    )
    for n_hints in (2, 3):
        hints = [f"Hint {k}: drink it while it is hot." for k in range(n_hints)]
        rows = [(i, "http://h/", page.format(i=i, hint=hints[i % n_hints])) for i in range(100)]
        got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
        for i in range(100):
            story = f"Story number {i}, which is told at great length and never twice in the same words."
            assert got[i] == f"{story}\nPart two of {i}."


def test_a_branch_that_is_the_main_text_stays(spark):
    page = "<body><div class=all><p>" + "A long notice that stands on every page. " * 9 + "</p><p>News {}.</p></div></body>"
    df = spark.createDataFrame([(i, "http://h/", page.format(i)) for i in range(20)], SCHEMA)
    assert {r.page_id: r.text for r in site_tree.extract(df).collect()} == {i: f"News {i}." for i in range(20)}


def test_names_that_mention_comments_spare_the_article():
    text = lambda page: "\n".join(b.text for b in site_tree.candidate_blocks(site_tree.parse(page)))
    for name in ("post no-comments", "has-comments", "post with-comments", "without-comments"):
        assert text(f"<body class='single comments-open'><article class='{name}'><p>Story.</p></article>") == "Story."
    assert text("<html id=comments><body class=comment-page><main class=comments><p>Story.</p></main>") == "Story."
    assert text("<body><div class='entry has-comments'><p>Story.</p><p class=no-comments>Closed.</p></div>") == "Story."
    for name in ("comment", "comment-no-parent", "comments-open"):
        assert text(f"<body><p>Story.</p><article class='{name}'><p>Reply.</p></article>") == "Story."


def test_broken_markup():
    text = lambda page: "\n".join(b.text for b in site_tree.candidate_blocks(site_tree.parse(page)))
    assert text("<p><b>one<p>two<ul><li>three<li>four</ul>five") == "one\ntwo\nthree\nfour\nfive"
    assert text("<p>a < b and c > d</p><p>tail <a hre") == "a < b and c > d\ntail"
    assert text("x<!-- never <p>closed") == "x"
    assert text("<script>if (a</p>) </script><style>p{}</style>kept") == "kept"
    assert text("<div hidden>no</div><div style='display: none'>no</div><p title='a > b'>yes") == "yes"
    assert text("<article><header><h1>T</h1></header><p>b</p><div class=comment-list><p>c</p></div></article><p>out</p>") == "T\nb"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert text(None) == text("") == ""
