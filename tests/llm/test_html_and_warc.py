"""Main text by line blocks and WARC records: planted pages, codings, files and odd rows."""

import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sievelake.llm import html_main, warc

LONG = "This paragraph is long enough to stand for the text of an article, with commas, and a full stop. " * 3
LONG = LONG.strip()
TEASER = "<div>Buy our things now</div>"


@pytest.mark.parametrize(
    "page, want",
    [
        # no article element: short titles, short paragraphs between and after furniture
        (f"<h1>Short title</h1><div class=share>Share</div><p>{LONG}</p>", f"Short title\n{LONG}"),
        (f"<div><p>{LONG}</p><div class=ad>buy</div><p>Short one.</p><div class=ad>buy</div><p>{LONG}</p><nav><a href=/>n</a></nav><p>Short final paragraph.</p></div>", f"{LONG}\nShort one.\n{LONG}\nShort final paragraph."),
        # two articles
        (f"<article><p>{LONG}</p></article><article><p>Second short article.</p></article>{TEASER}", f"{LONG}\nSecond short article."),
        # blocks that nothing marks, before, between and after
        (f"{TEASER}<div><h2>Head</h2><p>{LONG}</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p></div>{TEASER}", f"Head\n{LONG}\none\ntwo\n{LONG}"),
        (f"<div><div><p>{LONG}</p></div><div><p>Short p.</p></div>{TEASER}<div><p>{LONG}</p></div></div>", f"{LONG}\nShort p.\n{LONG}"),
        # comments that nothing marks, that a heading announces, and in a marked section of the article
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><div><b>Ann</b> nice one</div><div><b>Bob</b> I agree</div></div>", f"{LONG}\n{LONG}"),
        (f"<div><h1>T</h1><p>{LONG}</p><h3>3 comments</h3><p>{LONG}</p></div>", f"T\n{LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p><section id=comments><p>{LONG}</p></section></article><p>outside</p>", f"T\n{LONG}"),
        # what an article says under such headings and names is its own
        (f"<article><h1>T</h1><h2>Methods</h2><p>{LONG}</p><h2>Results</h2><p>{LONG}</p><h2>Discussion</h2><p>{LONG}</p><p>Short.</p><h2>Conclusion</h2><p>{LONG}</p></article>", f"T\nMethods\n{LONG}\nResults\n{LONG}\nDiscussion\n{LONG}\nShort.\nConclusion\n{LONG}"),
        (f"<div><h1>T</h1><p>{LONG}</p><h2>Responses</h2><p>{LONG}</p><h2>Comments</h2><p>{LONG}</p></div>", f"T\n{LONG}\nResponses\n{LONG}\nComments\n{LONG}"),
        *[(f"<article><p>{LONG}</p><{tag}={name}><p>{LONG}</p></div><p>{LONG}</p></article>", "\n".join([LONG] * 3)) for tag in ("div class", "div id") for name in ("social", "notice", "related", "feedback", "signup", "discussion", "sidebar")],
        *[(f"<div><p>{LONG}</p><div class={name}><p>{LONG}</p></div><p>{LONG}</p></div>", "\n".join([LONG] * 3)) for name in ("social", "notice", "related")],
        (f"<div class=widget><div class=related><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></div>{TEASER}", f"T\n{LONG}\n{LONG}"),
        (f"<article><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section><p>{LONG}</p></article>", f"Discussion\n{LONG}\n{LONG}"),
        # short blocks and links with such names, and what looks like readers', are not
        (f"<article><p>{LONG}</p><div class=social>Share this</div><div class=notice>We use cookies.</div><div class=related><a href=/x>{LONG}</a></div><div class=ad>Buy</div></article>", LONG),
        (f"<article><p>{LONG}</p></article><section class=discussion><p>Ann wrote 2 days ago</p><p>{LONG}</p><p>Bob said at 12:30</p><p>{LONG}</p></section>", LONG),
        (f"<article><p>{LONG}</p><h3>Discussion</h3><div><p>Ann, 3 days ago</p><p>{LONG}</p><p>Reply</p></div></article>", None),
        (f"<article><p>{LONG}</p><h3>Discussion</h3><p>Ann, 3 days ago</p><p>{LONG}</p><p>Reply</p></article>", LONG),
        # sections in containers of their own after the text, up to the next furniture
        (f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><h2>Outlook</h2><p>Short closing words here.</p></div>", f"{LONG}\n{LONG}\n{LONG}\nOutlook\nShort closing words here."),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><nav>n</nav><div><p>After the furniture.</p></div>", f"{LONG}\n{LONG}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div>{TEASER}<div><p>After another block.</p></div>", f"{LONG}\n{LONG}"),
        # the densest region decides, whatever the tags say
        ("<article><a href=/x>Teaser words here</a></article><div>" + f"<p>{LONG}</p>" * 5 + "</div>", "\n".join([LONG] * 5)),
        (f"<main><article><p>{LONG}</p></article>{TEASER}</main>", LONG),
        # links
        (f"<article><p>{LONG}</p><p><a href=x>Only a link</a></p></article>", f"{LONG}\nOnly a link"),
        (f"<h1>Outer title</h1><article><p>{LONG}</p></article>", f"Outer title\n{LONG}"),
        ("<ul><li><a href=/>only</a><li><a href=/>links</a></ul>", ""),
    ],
)
def test_planted_pages(page, want):
    got = html_main.main_text(f"<html><body>{page}</body></html>")
    assert got == want if want is not None else got.startswith(LONG)


def test_the_distribution_decides(monkeypatch):
    page = f"{TEASER}<div><p>{LONG}</p></div>{TEASER}"
    assert html_main.main_text(page) == LONG
    monkeypatch.setattr(html_main, "LEVEL", -1)  # every region surges
    assert html_main.main_text(page) != LONG


def test_line_blocks_against_brute_force():
    """Pages of plain containers, none of which anything marks: window sums by definition."""
    rng = random.Random(11)
    surged = 0
    for _ in range(300):
        parts, divs = [], []
        for d in range(rng.randint(1, 6)):
            own = ["w" * rng.choice([0, 3, 20, 60, 200, 400]) for _ in range(rng.randint(1, 6))]
            tag = rng.choice(["p", "div"])
            divs.append([(f"{d}.{k} {x}".strip(), tag) for k, x in enumerate(own)])
            parts.append("<section2><div>" + "".join(f"<{tag}>{x}</{tag}>" for x, _ in divs[-1]) + "</div></section2>")
        sums = [[sum(len(x) for x, _ in own[max(0, i - 1) : i + 2]) for i in range(len(own))] for own in divs]
        total = [sum(x) for x in sums]
        main = total.index(max(total))
        level = 0.3 * sorted(sums[main])[len(sums[main]) // 2]
        kept = {d for d, s in enumerate(sums) if max(s) > level} | {main}
        first, last = min(kept), max(kept)
        spoken = lambda d: all(t == "p" for _, t in divs[d])
        kept |= {d for d in range(first, last) if spoken(d)}
        for d in range(last + 1, len(divs)):
            if not spoken(d):
                break
            kept.add(d)
        surged += len(kept) < len(divs)
        want = "\n".join(x for d in sorted(kept) for x, _ in divs[d])
        assert html_main.main_text("<body>" + "".join(parts) + "</body>") == want
    assert surged > 50


def test_rows_of_pages(spark):
    page = f"<article><p>{LONG}</p></article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "u", ""), (3, None, "<p>" * 3000 + "deep")], "page_id long, url string, html string")
    df = df.withColumns({"text": F.lit("clash"), "c0": F.lit(7), "_in_html": F.lit(8)})
    got = html_main.extract(df)
    assert got.columns == ["page_id", "url", "html", "c0", "_in_html", "text", "n_chars"]
    rows = sorted(((x["page_id"] or 0, x["text"], x["n_chars"], x["c0"]) for x in got.collect()))
    assert rows == [(0, "", 0, 7), (1, LONG, len(LONG), 7), (1, LONG, len(LONG), 7), (2, "", 0, 7), (3, "deep", 4, 7)]
    assert not html_main.extract(df.where("false")).collect()
    assert html_main.extract(df, keep=["url"]).columns == ["url", "text", "n_chars"]


def http(*headers):
    return ("HTTP/1.1 200 OK\r\n" + "\r\n".join(headers) + "\r\n\r\n").encode()


PAGE = "<html><body><p>Hellö</p></body></html>".encode()


def chunked(data):
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(data[i : i + 7]), data[i : i + 7]) for i in range(0, len(data), 7)) + b"0\r\n\r\n"


BLOCKS = [
    (http("Content-Type: text/html; charset=utf-8", "Content-Encoding: gzip") + gzip.compress(PAGE), "Hellö"),
    (http("Content-Type: text/html", "Transfer-Encoding: chunked", "Content-Encoding: gzip") + chunked(gzip.compress(PAGE)), "Hellö"),
    (http("Content-Type: text/html", "Transfer-Encoding: chunked") + PAGE, "Hellö"),  # joined by the crawler
    (http("Content-Type: text/html", "Content-Encoding: deflate") + zlib.compress(PAGE)[2:-4], "Hellö"),
    (http("Content-Type: text/html", "Content-Encoding: deflate") + zlib.compress(PAGE), "Hellö"),
    (http("Content-Type: text/html", "Content-Encoding: gzip") + gzip.compress(PAGE * 2000)[:-20], None),  # cut off: as far as it goes
    (http("Content-Type: text/html") + "<meta charset='latin-1'><p>Hellö</p>".encode("latin-1"), "Hellö"),
    (http("Content-Type: text/html; charset=none-such") + PAGE, "Hellö"),
    (http("Content-Type: text/plain; charset=utf-16") + "a <b> c".encode("utf-16"), "a <b> c"),
    (http("Content-Type: application/json") + b'{"a": "<p>"}', '{"a": "<p>"}'),
    (http("Content-Type: image/png") + b"\x89PNG\0\xff\xfe\r\n\r\nWARC", ""),
    (http("Content-Type: text/html", "Content-Encoding: br") + b"xx", ""),
    (http() + b"a\0b", ""),
    (None, ""),
]


def responses(spark):
    return spark.createDataFrame([(f"k{i}", f"<urn:{i}>", "http://x", "2026", b) for i, (b, _) in enumerate(BLOCKS)], "page_id string, record_id string, target_uri string, warc_date string, block binary")


def test_codings_and_types(spark):
    got = {}
    for x in warc.derive(responses(spark)).collect():
        ((_, block),) = warc.read_records(bytes(x["record"]))
        got[x["page_id"], x["warc_type"]] = block.decode()
    for i, (block, want) in enumerate(BLOCKS):
        assert (f"k{i}", "metadata") in got
        if want:
            assert got[f"k{i}", "conversion"] == want
        elif want == "" and block is not None:
            assert (f"k{i}", "conversion") not in got and "conversion-record-id" not in got[f"k{i}", "metadata"]
    assert got["k5", "conversion"].split("\n")[0] == "Hellö"


def test_files_round_trip(spark, tmp_path):
    derived = warc.derive(responses(spark)).cache()
    warc.write_warc(derived.coalesce(1), str(tmp_path / "out"))
    (name,) = (tmp_path / "out").glob("*.gz")
    assert gzip.open(name).read() == b"".join(bytes(x["record"]) for x in derived.coalesce(1).collect())
    back = {x["record_id"]: x for x in warc.read_warc(spark, str(tmp_path / "out")).collect()}
    for x in derived.collect():
        y = back[x["record_id"]]
        ((_, block),) = warc.read_records(bytes(x["record"]))
        assert (y["warc_type"], y["refers_to"], y["block_digest"], y["whole"], bytes(y["block"])) == (x["warc_type"], x["refers_to"], x["block_digest"], True, block)


def test_records_that_hold_records_and_records_that_were_cut_off(spark, tmp_path):
    def record(name, block):
        return warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", "2026")], block)

    inner = record("inner", b"a block")
    about = http("Content-Type: text/plain") + b"An archive begins with\r\n\r\nWARC/1.0\r\nand so on\r\n\r\nWARC/ twice"
    nested = record("archive", inner + record("deeper", about) + inner)
    files = [[record("a", b"1"), nested, record("b", about), record("c", b"3")], [nested], [record("d", about)]]
    for k, parts in enumerate(files):
        (tmp_path / f"{k}.warc").write_bytes(b"".join(parts))
    rows = sorted((x["record_id"], x["whole"], bytes(x["block"])) for x in warc.read_warc(spark, str(tmp_path)).collect())
    archive = inner + record("deeper", about) + inner
    assert rows == sorted([("a", True, b"1"), ("archive", True, archive), ("archive", True, archive), ("b", True, about), ("c", True, b"3"), ("d", True, about)])
    # a record of which some bytes are missing doesn't take those after it
    (tmp_path / "cut").mkdir()
    whole = record("lost", b"plain words " * 20)
    (tmp_path / "cut" / "x.warc").write_bytes(record("a", b"1") + whole[:-30] + b"\r\n\r\n" + record("b", about) + record("c", b"3") + whole[:-20])
    got = sorted((x["record_id"], x["whole"]) for x in warc.read_warc(spark, str(tmp_path / "cut")).collect())
    assert got == [("a", True), ("b", True), ("c", True), ("lost", False), ("lost", False)]


def test_foreign_files(spark, tmp_path):
    records = [warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Target-URI", "http://x"), ("WARC-Date", "2026"), ("WARC-Payload-Digest", f"sha1:P{i}"), ("WARC-Block-Digest", f"sha1:B{i}")], b or b"") for i, (b, _) in enumerate(BLOCKS)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    with open(tmp_path / "members.warc.gz", "wb") as f:  # a gzip member for each record
        for r in records:
            f.write(gzip.compress(r))
    for name in ("plain.warc", "members.warc.gz"):
        got = warc.read_warc(spark, str(tmp_path / name))
        rows = {x["record_id"]: x for x in got.collect()}
        assert len(rows) == len(BLOCKS)
        assert all(bytes(rows[f"<urn:{i}>"]["block"]) == (b or b"") for i, (b, _) in enumerate(BLOCKS))
        said = {x["refers_to"]: bytes(x["record"]).decode("utf-8", "replace") for x in warc.derive(got).where("warc_type = 'metadata'").collect()}
        assert all(f"source-block-digest: sha1:B{i}\r\n" in said[f"<urn:{i}>"] and f"source-payload-digest: sha1:P{i}\r\n" in said[f"<urn:{i}>"] for i in range(len(BLOCKS)))
    (tmp_path / "empty.warc").write_bytes(b"")
    assert not warc.read_warc(spark, str(tmp_path / "empty.warc")).collect()
    (tmp_path / "cut.warc").write_bytes(records[0][:-40])
    assert [x["whole"] for x in warc.read_warc(spark, str(tmp_path / "cut.warc")).collect()] == [False]
