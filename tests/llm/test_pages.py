"""HTML extraction and WARC archives."""

import gzip
import hashlib
import os

import pytest

pytest.importorskip("veldspar.llm")

from veldspar.llm import html_text, labelled_pages, warc  # noqa: E402

PAGES = "page_id long, url string, html string"


def test_held_out_pages():
    model = html_text.trained()
    right = total = 0
    for source, parts in labelled_pages.pages(150, seed=99):
        blocks = html_text.leaf_blocks(source)
        assert len(blocks) == len(parts)
        labels = model.labels(html_text.features(blocks))
        right += sum(a == b for a, (_, b) in zip(labels, parts, strict=True))
        total += len(parts)
    assert right / total > 0.98


def test_extract(spark):
    body = "<nav><ul><li><a href='/a'>One</a><li><a href=/b>Two</a></ul></nav><div class=cookie-notice>We use cookies here.</div><article><h1>A  title</h1><p>First &amp; <b>bold</b>\n text.<br>Next line follows it here.<p>Second paragraph, with a comma and an end.</p></article><form><label>Name</label><input><button>Send it</button></form><div class='comments'><p>I like this a lot.</p></div><footer>&copy; Some company</footer><script>var x = '<p>no</p>'"
    rows = [(1, "u", body), (2, None, None), (3, "v", ""), (None, "w", "<"), (5, "x", "a" * 200_000 + "<p>" * 2000), (1, "u", body)]
    frame = spark.createDataFrame(rows, PAGES)
    got = [(r.page_id, r.text) for r in html_text.extract(frame).collect()]
    assert len(got) == 6
    want = "A title\n\nFirst & bold text. Next line follows it here.\n\nSecond paragraph, with a comma and an end."
    assert [t for p, t in got if p == 1] == [want, want]
    assert [t for p, t in got if p in (2, 3)] == ["", ""]
    assert html_text.extract(frame.where("false")).collect() == []


def test_markup_that_is_not_closed_loses_no_text():
    text = "First words of a text, which go on and on. They have an end too."
    model = html_text.trained()
    for head in ("<head><title>t</title>", "<head><title>t</title></head>", "<head><meta charset=utf-8><noscript><link href=x></noscript>"):
        for odd in ("", "<svg viewBox='0 0 1 1'/>", "<svg><path d='M0'/><title/></svg>", "<svg><path d='M0'>", "<math/>", "<noscript>", "<select>", "<object data=x>", "<template>"):
            page = f"<!DOCTYPE html><html>{head}<body><article>{odd}<h1>A title of it</h1><p>{text}</p><p>{text}</p></article></body></html>"
            assert html_text.main_text(page, model) == f"A title of it\n\n{text}\n\n{text}", (head, odd)
    page = f"<html><head><title>t</title><article><h1>A title of it</h1><p>It is <math><mi>x</mi><mo>=</mo><mn>1</mn></math> there, as they say.</p><object data=x><p>{text}</p></object></article>"
    assert html_text.main_text(page, model) == f"A title of it\n\nIt is x=1 there, as they say.\n\n{text}"
    assert [b.text for b in html_text.leaf_blocks("<script>a</script><style>b</style><title>c</title><textarea>d</textarea><iframe>e</iframe>f")] == ["f"]


def test_broken_markup_takes_linear_time():
    import time

    n = 20_000
    pages = ['<a "' * n, '<a "' * n + ">", "<b " * n + '="' + '>"', '<a ="' * n + '>"', "<a ='\"" * n + ">", '<i ="<i =\'' * n, "<div>x" * n, "<div>" * n + "</x>" * n + "y", "<script>" + "</script" * n, "<!-- " * n, "</" * n, "<div class='a b c'>" * n + "z" + "</div>" * n]
    for page in pages:
        began = time.process_time()
        html_text.leaf_blocks(page)
        assert time.process_time() - began < 5, page[:20]


def test_blocks_by_hand():
    """Pages made from known blocks, with inline markup, raw elements and broken tags between and within them."""
    import random

    rng = random.Random(7)
    inline = ["<b>{}</b>", "<a href='>'>{}</a>", "{}<script>if (a < b) x('<p>')</script>", "<svg viewBox='0 0 1 1'><path d='M0'/><title>no</title></svg>{}", "{}<!-- <p> -->", "<em class=\"x > y\">{}</em>", "<math><mi>{}</mi></math>", "{}<style>p > a {{}}</style>", "{}<img alt='<p>'>", "<span \" >{}</span>"]
    around = ["<p>{}</p>", "<p>{}", "<div class='a'><div>{}</div></div>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>", "<section id=s>{}</section>", "<h2>{}</h2>", "<blockquote><p>{}</blockquote>"]
    for _ in range(300):
        page, want = rng.choice(["", "<!DOCTYPE html><html><head><title>t</title>", "<head><meta charset=utf-8></head><body>"]), []
        for _ in range(rng.randrange(1, 8)):
            words = [f"w{rng.randrange(1000)}" for _ in range(rng.randrange(1, 6))]
            want.append(" ".join(words))
            page += rng.choice(around).format(" ".join(rng.choice([*inline, "{}", "{}"]).format(w) for w in words))
        assert [b.text for b in html_text.leaf_blocks(page)] == want, page


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    model = html_text.Field({"a": 0.7, "b": -0.4, "any": 0.1}, np.array([[0.5, -0.3], [-0.6, 0.4]]))
    for rows in itertools.product([["a"], ["b"], ["a", "b", "any"]], repeat=4):
        def value(labels, rows=rows):
            return sum(y * sum(model.weights[f] for f in r) for y, r in zip(labels, rows, strict=True)) + sum(model.pairs[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product([0, 1], repeat=4), key=value)
        assert abs(value(best) - value([int(x) for x in model.labels(list(rows))])) < 1e-12


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "text " * 40 + "</p>"
    rows = [(5, "http://a/%0A", big), (3, "http://b\r\nX: y", big), (9, None, big + "é"), (None, "n", big), (1, "s", "small"), (2, "s", "small"), (4, "e", None), (6, "e", ""), (7, "l", "long " * 100_000)]
    rows += [(100 + k, "h", f"{k} " + "word " * 300) for k in range(40)]
    pages = spark.createDataFrame(rows, PAGES)
    root = f"file://{tmp_path}/a"
    manifest = warc.write(pages, root, roll_bytes=2000).collect()
    assert len(manifest) > 4 and sum(m.records for m in manifest) == len(rows)
    for m in manifest:
        data = (tmp_path / "a" / m.file).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (m.bytes, m.sha256)
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == m.records
    assert not [f for f in os.listdir(tmp_path / "a") if ".warc.gz." in f and not f.endswith(".crc")]
    got = {r.page_id: r for r in warc.read(spark, root).collect()}
    assert len(got) == len(rows)
    for page, url, html in rows:
        r, payload = got[page], (html or "").encode()
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(payload), hashlib.sha256(payload).hexdigest())
        again = html == big and page != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
        assert r.payload == (None if again else payload)
    other = f"file://{tmp_path}/b"
    same = warc.write(pages, other, roll_bytes=2000).collect()
    assert sorted(same) == sorted(manifest)
    empty = f"file://{tmp_path}/c"
    assert warc.write(pages.where("false"), empty).collect() == []
    assert warc.read(spark, empty).collect() == []


def test_warc_shards_do_not_depend_on_the_run(spark, tmp_path):
    """More pages than Spark samples for its ranges: the same bytes again in one session, with other partitions and in another order."""
    pages = spark.range(3000).selectExpr("cast(if(id % 50 = 0, null, id * 7919 % 3001 - 500) as bigint) page_id", "concat('u', id) url", "repeat(concat('text ', cast(id % 700 as string), ' '), 30) html")
    stored = str(tmp_path / "pages.parquet")
    pages.write.parquet(stored)
    pages = spark.read.parquet(stored)
    digests = []
    for k, (rows, width) in enumerate(((pages, "4"), (pages, "4"), (pages.repartition(7), "9"))):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            digests.append(sorted(warc.write(rows, f"file://{tmp_path}/{k}", roll_bytes=20_000, shard_bytes=100_000).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert digests[0] == digests[1] == digests[2] and len(digests[0]) > 10
    assert sum(m.records for m in digests[0]) == 3000
    got = []
    for name in sorted({m.file for m in digests[0]}):
        with gzip.open(tmp_path / "0" / name) as file:
            fields = [dict(x.split(": ", 1) for x in r.split("\r\n\r\n")[0].split("\r\n")[1:] if ": " in x) for r in file.read().decode().split("WARC/1.1")[1:]]
        got += [int(f.get("X-Page", -501)) for f in fields]
    assert got == sorted(got) and len(got) == 3000 and len({m.file for m in digests[0]}) == len(digests[0])


def test_warc_reading_notices_changed_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 50) for k in range(20)], PAGES)
    root = f"file://{tmp_path}/a"
    (m,) = warc.write(pages, root).collect()
    path = tmp_path / "a" / m.file
    members = [gzip.compress(x + b"\r\n\r\n", mtime=0) for x in gzip.decompress(path.read_bytes()).split(b"\r\n\r\n\r\n\r\n") if x]
    for data in (b"".join(members[1:]), path.read_bytes()[:-10], gzip.compress(gzip.decompress(path.read_bytes()).replace(b"page 3 ", b"page 4 ", 1))):
        path.write_bytes(data)
        crc = tmp_path / "a" / f".{m.file}.crc"
        if crc.exists():
            crc.unlink()
        with pytest.raises(Exception, match="manifest|digest|within a record|Content-Length"):
            warc.read(spark, root).collect()
