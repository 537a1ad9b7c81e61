"""HTML extraction and the whole pipeline against plain versions."""

import hashlib
import html
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import html_extract
from factloom.llm.queries import op7_html_extraction, vocabulary


def test_pages_against_a_plain_cut(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op7_html_extraction(spark, sf).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_blocks():
    page = """<html><head><title>T</title></head><body><header>Site</header><nav>Menu</nav><div class="cookie-notice">We use</div>
    <main><article><header><h1>Head &amp; line</h1></header><p>One <i>two</i>&nbsp;three<p>Four<br>five<!-- x > y --><script>if (a<b) "</p>"</script>
    <aside>Side</aside><div class=ad>Buy</div><form>Mail <input></form><ul><li>Item<li>Other</ul><section id="comments"><p>Nice!</p></section></article></main><footer>F</footer></body></html>"""
    main, rest, marked = html_extract.blocks(page)
    assert marked and main == ["Head & line", "One two three", "Four five", "Item", "Other"] and rest == []
    for odd in (None, "", "plain", "<", "<p", "<p title='>'>x", "<!--", "a & b &bogus; &#65;"):
        html_extract.blocks(odd)
    assert html_extract.blocks("<p title='>'>x &#65;")[1] == ["x A"]
    for unclosed in ("<a " * 100_000, "<!" * 100_000, "<p><b>" * 50_000, "<div>" * 20_000):  # none takes quadratic time
        html_extract.blocks(unclosed)


def test_longest_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = r.integers(0, 5, r.integers(0, 12)).tolist(), r.integers(0, 5, r.integers(0, 12)).tolist()
        at = html_extract.shared_lines(a, b)
        it = iter(b)
        assert len(at) == plain(a, b) and at == sorted(set(at)) and all(a[i] in it for i in at)


def page(body):
    return f"<html><body>{''.join(f'<p>{b}</p>' for b in body)}</body></html>"


def test_shared_lines_go_only_without_a_marked_article(spark):
    rows = [
        (1, "http://h.com/en/1", page(["Menu line", "Own text one", "Foot line"])), (2, "http://h.com/en/2?x=1", page(["Menu line", "Own text two", "Foot line"])),
        (3, "http://other.com/en/1", page(["Menu line", "Own text one"])), (4, "http://h.com/en/1#top", page(["Menu line", "Own text one", "Foot line"])),
        (4, "http://h.com/en/1#top", page(["Menu line", "Own text one", "Foot line"])), (5, None, None), (None, "bad://[", ""), (6, "http://h.com/en/3", "<article><p>Own text one</p></article><p>Menu line</p>"),
        (7, "http://h.com/zz", page([f"Line {k}" for k in range(3000)])),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = [(r.page_id, r.text) for r in html_extract.extract(pages).collect()]
    assert len(got) == len(rows)
    text = dict(got)
    assert text[1] == "Own text one" == text[4] and text[2] == "Own text two" and text[3] == "Menu line\n\nOwn text one" and text[5] == "" == text[None]
    assert text[6] == "Own text one" and text[7].count("\n\n") == 2999
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_neighbours_do_not_depend_on_partitions(spark):
    rows = [("h", f"/p/{k:03d}", [k]) for k in range(97)] + [("g", "/only", [1])]
    df = spark.createDataFrame(rows, "host string, path string, lines array<long>")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "5", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r.host, r.path, tuple(r.other)) for r in html_extract.nearest(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1] == found[2] and len(found[0]) == 98 and found[0][0][2] == ()


PASSAGE = "copper lanterns sway above the frozen harbour while patient sailors mend their nets before the long winter dawn"


def test_pipeline(spark, tmp_path):
    """The stages' decisions on planted rows, and the tokens of what is left."""
    r = np.random.default_rng(4)
    words = [a + b for a in ("th", "on", "re", "ing", "an", "er") for b in ("he", "at", "ed", "or", "is", "en")]
    say = lambda n: " ".join(r.choice(words, n))
    docs = [(k, say(60)) for k in range(150)]
    labels = []
    for k in range(150):
        bad = k % 3 == 0
        if bad:
            docs[k] = (k, docs[k][1] + " scumword " + say(5))
        labels.append((k, 1, int(bad)))
    base = say(80)
    docs += [(1000, base), (1001, base), (1002, base.upper()), (1010, say(30) + " " + PASSAGE), (1020, say(30) + " scumword"), (1030, say(20) + " write to jo.do@mail1.example.com now " + say(20)), (1040, None), (1041, ""), (1050, say(3000))]
    spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {k for k in range(150) if k % 3} | {1000, 1030, 1040, 1050}
    assert set(got) == want
    whole, texts = Tokenizer.from_file(vocabulary()), dict(docs)
    for i in want:
        text = (texts[i] or "").replace("jo.do@mail1.example.com", "[EMAIL]")
        ids = whole.encode(text, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
