import fnmatch
import io
import random
import re
from collections import Counter
from dataclasses import replace
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralode.llm import html, nearest, urlfilter, warc
from terralode.llm.nearest import fit_codebooks, largest_inner_products
from terralode.llm.queries import URL_GLOBS, URL_RULES


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2\n3", "same"), (3, None, None), (4, "u", ""), (5, "v", "é" * 9), (None, "n", "same"), (6, "long", "x y " * 400_000), (2, "http://a/2", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' as digest", "1 as first", "'k' as kind", "2 as size", "3 as part").repartition(3, "page_id")
    folder = f"file://{tmp_path}/archives"
    assert warc.write_archives(pages, folder).agg({"records": "sum"}).first()[0] == len(rows)
    got = sorted(warc.read_archives(spark, folder).collect(), key=lambda r: r.page_id or -1)
    kinds = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got]
    assert kinds == [(None, "response", None, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 18), (6, "response", None, 1_600_000)]
    assert all(r.payload_digest == warc.payload_digest((dict((i, t) for i, _, t in rows)[r.page_id] or "").encode()) for r in got)
    assert bytes(got[-1].payload) == rows[6][2].encode() and bytes(got[1].payload) == b""
    small = f"file://{tmp_path}/small"
    warc.write_archives(pages, small, least=5)
    assert {r.record_type for r in warc.read_archives(spark, small).collect()} == {"response"}
    none = f"file://{tmp_path}/none"
    assert warc.write_archives(pages.limit(0), none).collect() == [] and warc.read_archives(spark, none).collect() == []
    data = next((tmp_path / "archives").glob("*.zst")).read_bytes()
    assert data[:4] == warc.DICTIONARY_MAGIC
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(data[:-3])))


def test_archives_of_all_pages(spark, sf_dir, tmp_path, monkeypatch):
    """Small files; a first try of every task that was lost after it had written, with its rows in another order."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 50_000)
    pages = spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").repartition(2)
    folder = f"file://{tmp_path}/archives"
    lost = [(0, r.page_id, r.url, (r.html or "").encode(), warc.hashlib.sha1((r.html or "").encode()).hexdigest(), "response", None) for r in reversed(pages.collect())]
    names = ["part", "page_id", "url", "payload", "digest", "kind", "refers"]
    assert sum(sum(b["records"].to_pylist()) for b in warc._written(folder)([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in lost[:150]])])) == 150
    manifest = warc.write_archives(pages, folder).collect()
    assert len(manifest) > 5 and len(list((tmp_path / "archives").glob("*.zst"))) > len(manifest)
    rows = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    last = {}
    for i, t in rows.items():
        last[t] = max(i, last.get(t, i))
    want = {i: (t if last[t] == i else b"", len(t), warc.payload_digest(t), "response" if last[t] == i else "revisit", None if last[t] == i else last[t]) for i, t in rows.items()}
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows) and {r.page_id: (bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def article(k):
    return f"<article><h1>T{k}</h1><p>Body &amp; soul {k}<br>more<p>second <b>par</b>t</article>"


def test_html_rules():
    page = """<html><head><title>x</title><style>p{}</style></head><body><header>H</header><nav><ul><li>menu<li>b</ul></nav><div class="content has-sidebar">
    <article class="post"><h1>T&eacute;</h1><p>a  b<p>c &lt;d&gt; 'e'<script>var t="</p>";</script><div class="newsletter"><form>x</form></div><ul><li>one<li>two</ul>
    <section id="comments"><article class="comment">no</article></section></article></div><aside>s</aside><div class="cookie-notice">n</div><footer>&copy;</footer>"""
    assert html.main_text(html.parse(page), frozenset()) == "Té\na b\nc <d> 'e'\none\ntwo"
    assert html.main_text(html.parse(""), frozenset()) == "" and html.main_text(html.parse("<p>a<p>b < c<!-- x --> d<"), frozenset()) == "a\nb < c d<"


def test_site_templates(spark):
    """Boxes without any telling name go where they stand around many contents of a host, not where copies of a page do."""
    box = "<div><p>Follow us on all networks</p></div>"
    frame = lambda host, k, body: (k, f"http://{host}/p/{k}", f"<body>{box}<div><p>text {body}</p></div>{box}</body>")
    rows = [frame("many.example", k, k) for k in range(12)] + [frame("copies.example", 100 + k, "same") for k in range(12)] + [frame("few.example", 200 + k, k) for k in range(3)] + [frame("two.example", 220 + k, k) for k in range(2)]
    rows += [(300, None, None), (301, "http://x/", ""), frame("many.example", 3, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as gone", "'t' as text")
    out = html.extract_main_text(pages).collect()
    got = {r.page_id: r.text for r in out}
    assert got[3] == "text 3" and got[100].count("Follow") == 2 and got[201] == "text 1" and got[221].count("Follow") == 2 and got[300] == got[301] == "" and len(out) == len(rows)
    framed = spark.createDataFrame([(k, f"http://h/{k}", f"<body>{box}{article(k)}{box}</body>") for k in range(12)], "page_id long, url string, html string")
    assert {r.text for r in html.extract_main_text(framed).collect()} == {f"T{k}\nBody & soul {k} more\nsecond part" for k in range(12)}
    assert html.extract_main_text(pages.limit(0)).collect() == []


def test_templates_equal_plain_counts(spark):
    """Random trees of boxes on some hosts, against counts of their source texts."""
    rng = random.Random(8)
    shared = [f"<div><p>box {i}</p></div>" for i in range(12)]
    shared += [f"<ul><li>x{i}</li>{rng.choice(shared)}</ul>" for i in range(6)]
    rows = []
    for k in range(90):
        host = "h%d.example" % (k % 3 if k < 60 else k % 9)
        kids = [rng.choice(shared[: 6 + k % 13]) for _ in range(3)]
        rows.append((k, f"http://{host}/{k}", [*kids[:2], f"<section><p>own {k // 2}</p></section>", kids[2]]))
    by_host = {}
    for _, url, kids in rows:
        by_host.setdefault(url.split("/")[2], []).append(kids)

    def boxes(source):
        return {source, *re.findall(r"<div><p>box \d+</p></div>", source), *re.findall(r"<p>.*?</p>|<li>.*?</li>", source)}

    def plain(source, gone):
        for g in sorted(gone, key=len, reverse=True):
            source = source.replace(g, "\n")
        return [t for t in re.split(r"<[^>]*>|\n", source) if t]

    want = {}
    for k, url, kids in rows:
        pages = {"".join(x) for x in by_host[url.split("/")[2]]}
        counts = Counter(b for page in pages for b in {b for x in re.findall(r"<(?:div|ul|section)>(?:<li>.*?</ul>|.*?</(?:div|section)>)", page) for b in boxes(x)})
        gone = {b for b, n in counts.items() if n > 2 + 0.1 * len(pages)}
        want[k] = "\n".join(plain("".join(kids), gone))
    docs = spark.createDataFrame([(k, u, "".join(kids)) for k, u, kids in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract_main_text(docs).collect()} == want


class Plain(HTMLParser):
    """Texts of the headings and paragraphs of a page's article."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.handle_data(" ")
        elif self.inside and tag in ("h1", "p"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_main_text_of_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract_main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert got[r.page_id] == "\n".join(t for b in plain.blocks if (t := " ".join(b.split())))


def test_html_nested_to_any_depth(spark):
    deep = lambda tag, n=50_000: f"<{tag}>" * n + "deep text"
    pages = [deep("div"), deep("font"), deep("b") + "</i>" * 50_000, "<table>" + deep("font") + "<tr></tr>" * 20_000, "<article>" + deep("section") + "</section>" * 50_000 + "</article>", deep("ul") + deep("li")]
    docs = spark.createDataFrame([(i, "http://h/", t) for i, t in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_main_text(docs).collect()}
    assert all(got[i] == "deep text" for i in range(5)) and got[5] == "deep text\ndeep text"


def test_wrappers_keep_their_articles():
    text = lambda page: html.main_text(html.parse(page), frozenset())
    body = "<h1>T</h1><p>All of the article</p>"
    assert text(f'<body><form id="aspnetForm"><div>{body}</div><input value="x"><button>Go</button></form></body>') == "T\nAll of the article"
    assert text(f'<body><div class="post related">{body}</div></body>') == "T\nAll of the article"
    assert text(f'<body><div id="content-sidebar-wrap">{body}<div class="sidebar">s</div></div></body>') == "T\nAll of the article"
    assert text(f'<body>{body}<div class="comments"><p>{"a long comment of a reader " * 9}</p></div><form><p>Subscribe</p></form></body>') == "T\nAll of the article"


def test_recurring_boxes_within_articles(spark):
    """A list that ten of many articles share stays, and so does a body under different headings; a small box on all goes."""
    tip, box = "<ul><li>tip one<li>tip two</ul>", "<div><p>Follow us</p></div>"
    hot = [(k, f"http://hot/{k}", f"<article>{box}<h1>T{k}</h1><p>Body {k} of a page</p>{tip if k < 10 else ''}</article>") for k in range(150)]
    same = [(1000 + k, f"http://same/{k}", f"<article><h1>T{k}</h1><div><div><p>body one</p></div><div><p>body two</p></div></div></article>") for k in range(12)]
    pages = spark.createDataFrame(hot + same, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_main_text(pages).collect()}
    assert [got[k] for k in range(150)] == [f"T{k}\nBody {k} of a page" + "\ntip one\ntip two" * (k < 10) for k in range(150)]
    assert [got[1000 + k] for k in range(12)] == [f"T{k}\nbody one\nbody two" for k in range(12)]


def test_globs_equal_plain_matching():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    strings = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    got = urlfilter.GlobSet([g.encode() for g in globs]).match([s.encode() for s in strings])
    want = [[fnmatch.fnmatchcase(s, g) for g in globs] for s in strings]
    assert got.tolist() == want


def test_rules_are_no_globs(spark):
    """A rule's wildcards stand for themselves; odd columns and a very long url."""
    rows = [(1, "http://a.com/x*y/1"), (2, "http://a.com/xzy/1"), (3, "http://a.com/q\\?"), (4, "http://a.com/" + "z" * 100_000), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "'p' as path", "1 as rule", "2 as id", "3 as verdict")
    got = {(r.page_id, r.rule, r.verdict, len(r.path)) for r in urlfilter.judge_urls(pages, [("block", "a.com/x*y"), ("block", "a.com/q\\")], ["*#*zzz"]).collect()}
    assert got == {(1, "a.com/x*y", "block", 6), (2, None, "allow", 6), (3, "a.com/q\\", "block", 3), (4, None, "block", 100_001), (4, None, "allow", 0)}


def test_url_rules(spark):
    urls = [
        "http://WWW.Example.com/en/x", "http://example.com/en/", "https://a.example.com/de/1?x", "http://a.net/es/1", "http://badexample.com/en/", "http://a.net", "http://spam-farm.org/x", None, "no scheme", "x://cheap-pills.org#f",
        "http://b.org/.example.com#/en/", "http://a.com?/", "http://é.org/trackback/1",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.com/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, URL_RULES, URL_GLOBS).collect()}
    assert [got[i][2:] for i in range(len(urls))] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), ("com/", "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"), (None, "block"),
        (None, "allow"), (None, "allow"), (None, "block"),
    ]
    assert got[0][:2] == ("www.example.com", "/en/x") and got[5][:2] == ("a.net", "") and got[7][:2] == ("", "") and got[None][2] == "com/"
    assert urlfilter.judge_urls(pages.limit(0), URL_RULES, URL_GLOBS).collect() == []


def test_nearest_recall_and_scores(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/../sf0.1/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = {}
    for r in largest_inner_products(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = 0
    for q in ids[ids % 20 == 0].tolist():
        score = sum(x[:, j] * x[ids == q][0, j] for j in range(x.shape[1]))
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda t: (-t[2], t[1]))
        assert all(s == score[ids == i][0] for _, i, s in mine)
        found += len({i for _, i in best} & {i for _, i, _ in mine})
    assert found / (20 * len(got)) >= 0.95


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5, 0.5]), (20, [2.0, 1.0]), (40, [1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (8, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in largest_inner_products(vectors, vectors.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 7, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.5), (20, 3, 7, 1.5)]
    assert largest_inner_products(vectors.limit(0), vectors.limit(0)).collect() == []


def assert_exact(spark, x, asked):
    """Ranks, ids and scores are those of comparing all."""
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    ids = np.random.default_rng(6).permutation(len(x))
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in largest_inner_products(vectors, vectors.where(F.col("vec_id").isin(ids[asked].tolist()))).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for a in asked:
        score = np.cumsum(x.astype(np.float64) * x[a].astype(np.float64), axis=1)[:, -1]
        order = [i for i in np.lexsort((ids, -score)) if i != a][:20]
        assert sorted(got[ids[a]]) == [(n + 1, ids[i], score[i]) for n, i in enumerate(order)]


def test_nearest_is_exact_on_many_rows(spark):
    assert_exact(spark, np.random.default_rng(5).normal(size=(30_000, 64)), np.arange(60))


def test_nearest_is_exact_beyond_the_fitted_rows(spark, monkeypatch):
    """Codebooks fitted on a hundredth of the rows, many small blocks."""
    monkeypatch.setattr(nearest, "FIT_ROWS", 600)
    monkeypatch.setattr(nearest, "ROW_BLOCK", 5000)
    assert_exact(spark, np.random.default_rng(7).normal(size=(60_000, 32)), np.arange(0, 6000, 100))


def test_nearest_with_odd_columns(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    odd = vectors.selectExpr("*", "1 as block", "2 as part", "'c' as code", "'v' as vector", "3 as ids")
    asked = lambda df: sorted(map(tuple, largest_inner_products(df, df.where("vec_id % 20 = 0"), k=3).collect()))
    assert asked(odd) == asked(vectors)


def test_nearest_is_exact_among_copies(spark):
    """A quarter of the rows are copies of one vector, a quarter near copies of it that share its code."""
    x = np.random.default_rng(5).normal(size=(20_000, 16))
    x[10_000:] = x[0]
    x[15_000:, 0] += np.arange(5000) * 1e-6
    assert_exact(spark, x, np.array([0, 1, 2, 10_001, 19_999]))


def test_codebooks_weigh_parallel_errors():
    """Errors along a vector are smaller than under codes that weigh all errors alike."""
    x = np.random.default_rng(3).normal(size=(1000, 64))
    books = fit_codebooks(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]

    def along(codes):
        near = books.values[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
        return np.square(((x - near) * unit).sum(axis=1)).mean()

    assert books.weight > 2 and along(books.encode(x)) < 0.7 * along(replace(books, weight=1.0).encode(x))


def main_of(page):
    return html.main_text(html.parse(page), frozenset())


def test_content_beside_articles_counts():
    """Names alone and small articles lose no paragraphs."""
    assert main_of("<main><h1>Title</h1><p>Lead</p><article><p>The body of the story.</p></article><p>After</p></main>") == "Title\nLead\nThe body of the story.\nAfter"
    assert main_of("<main><div class='menu'><p>Go</p></div><article><p>The body of the story.</p></article></main>") == "The body of the story."
    story = "A sentence of the big story. " * 15
    assert main_of(f"<body><h1>Big story</h1><p>{story}</p><article>Related card</article>").startswith("Big story\nA sentence of the big story.")
    prose = "Policy matters to all of us, every single day of the year."
    page = f"<article><h1>T</h1><div class='social-policy'><p>{prose} One.</p></div><section id='related-work'><p>{prose} Two.</p></section><div class='share'><a>Share</a></div><div class='comments'><p>{prose}</p></div></article>"
    assert main_of(page) == f"T\n{prose} One.\n{prose} Two."
    assert main_of("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p></article>") == "Let x=2 be."


def test_counts_decide_without_articles(spark):
    """Pages without article or telling names: what recurs on a host goes, and does so only there."""
    links = "<div><a href='/a'>Home</a> <a href='/b'>News from everywhere</a></div>"
    legal = "<section><p>All texts may be used by the members of the club only.</p></section>"
    page = lambda i, extra: f"<html><body>{links}<div><h2>Story {i}</h2><p>Words of story number {i} that stand nowhere else.</p></div>{extra}</body></html>"
    rows = [(i, f"http://big.org/{i}", page(i, legal)) for i in range(40)] + [(100 + i, f"http://one{i}.org/", page(100 + i, legal)) for i in range(5)]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\nWords of story number {i} that stand nowhere else." for i in range(40))
    changed = sum(got[i] != main_of(h) for i, _, h in rows)
    assert changed == 40 and all("members of the club" in got[100 + i] for i in range(5))
