import hashlib
import html
import math
import re
from collections import Counter

import duckdb
import pytest

from skein.llm import common, queries, sitetree, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>two</b>three&nbsp;&#233;<p>five<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<div class="ad">Buy!</div><form>Mail <input></form><!-- no <p>x</p> --> 1 < 2 </article>
<section id="comments"><p>Nice!</p></section></main><aside>Related</aside><div class="sidebar">Links</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    assert sitetree.main_text(PAGE) == "Head & line One twothree é five a b c d 1 < 2"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("just text", "just text"), ("<p>a<br>b<p>c", "a b c"), ("<p>x <i>y</i>z</p><nav>m", "x yz"), ("<div>a<div>b</div>c</div>", "a b c"), ("<script>never", ""), ("<!-- open", ""), ("a &lt;p&gt; b", "a <p> b"),
        ("<article><p>only this</article><p>not this", "only this"), ("<p>" + "w " * 50_000, ("w " * 50_000).strip()), ("<a href='x>y'>in</a> out", "in out"),
        ("<div class='layout has-sidebar'>lost<article class='post'>kept <em class='notice'>too</em></article></div>", "kept too"), ("<aside><article>teaser</article></aside><p>text", "text"), ("<article class='comment'>no</article><article>yes</article>", "yes"), ("<p>a <span class='ad'>buy</span>b", "a buyb"),
        ("<article><pre><code>x = 1 <span class='token comment'># set x</span></code></pre></article>", "x = 1 # set x"), ("<article><section class='related'><p>Related work in physics</p></section><p>More</article>", "Related work in physics More"),
        ("<article><p>So <span class='reply'>we</span> say <b class='promo'>now</b> <em class='comment'>this</em></article>", "So we say now this"), ("<article><p>Text<div class='promo'>of ours</div></article><div class='promo'>Buy</div>", "Text of ours"),
        ("<article><p>Text</p><ol class='comments'><li class='comment'>a</li><li class='comment'>b</li></ol></article>", "Text"), ("<article><p>Text</p><section id='discussion'><ol><li class='x'>a<li class='x'>b</ol></section></article>", "Text"), ("<article><p>Text</p><div><div class='comment'>a</div><div class='comment'>b</div></div></article>", "Text"),
        ("<article><p>Text</p><div class='comments'>no list</div></article>", "Text no list"), ("<article><div class='step'>one</div><div class='step'>two</div></article>", "one two"),
    ],
)
def test_pieces(page, text):
    assert sitetree.main_text(page) == text


def test_low_importance_branches_go(spark):
    """A strip that all pages of a host repeat goes; the same strip's texts stay where each page has its own."""
    page = lambda k, strip: f"<body><div class='x-strip'>{strip}</div><div class='x-body'><p>Story {k} of the day.</p></div></body>"
    rows = [(k, f"http://a.example/{k}", page(k, "Always the same words")) for k in range(40)] + [(100 + k, f"http://b.example/{k}", page(k, f"Own words {k}")) for k in range(40)]
    rows += [(200 + k, f"http://a.example/{k}", rows[0][2]) for k in range(60)]
    got = {r.page_id: r.text for r in sitetree.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 of the day." and got[103] == "Own words 3 Story 3 of the day." and got[205] == "Story 0 of the day."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><section class='discussion'>We discuss.</section><div class='share-price table'>Up 3</div></article>", "We discuss. Up 3"), ("<main><section class='social-history'>Long ago</section><div class='header-image-wrap'><p>Text</div></main>", "Long ago Text"),
        ("<article><p>Text</p></article><div class='comments'>Nice</div><div id='related-posts'>More</div>", "Text"), ("<div class='widget'>Links</div><p>Text</p>", "Text"),
    ],
)
def test_names_are_judged_whole(page, text):
    assert sitetree.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>x " * 20_000, "<b>x<div>" * 20_000, "<article>" + "<section>x " * 20_000, "<i>" * 20_000 + "</b>" * 20_000 + "x " * 20_000])
def test_pages_that_close_nothing(page):
    blocks, looks = sitetree.parse(page)
    assert len(looks) <= sitetree.MOST_DEPTH + 1 and max(len(b.branches) for b in blocks) <= sitetree.MOST_DEPTH + 1 and sitetree.main_text(page).count("x") == 20_000


def entropy(values):
    n, counts = len(values), Counter(values).values()
    return 1.0 if n < 2 else -sum(c / n * math.log(c / n) for c in counts) / math.log(n)


def verdicts(pages, names=True):
    """The trees by brute force: host to shares of the best importance, and main branches of hosts and of all."""
    seen, every = {}, {}
    for url, page in pages:
        blocks, looks = sitetree.parse(page, names)
        copy = tuple(sorted({b.text for b in blocks if b.text}))
        for path, (depth, kind, rows) in looks.items():
            for key, table in (((sitetree.host_of(url), path), seen), (path, every)):
                own = table.setdefault(key, [{}, {}, 0])
                own[2] = max(own[2], depth * 8 + kind)
                where = (sitetree.host_of(url), copy)
                own[0].update({(b.whole, where): b.whole for b in blocks if path in b.branches})
                own[1][tuple(sorted(rows)), where] = tuple(sorted(rows))

    def importance(held, looks, about):
        return ((1 - sitetree.LOOKS) * entropy(list(held.values())) + sitetree.LOOKS * entropy(list(looks.values()))) * (sitetree.COMMENTS if about % 8 == sitetree.TALKS else 1)

    def weighed(held, looks, about, before):
        return (len(looks) * importance(held, looks, about) + sitetree.EVIDENCE * before) / (len(looks) + sitetree.EVIDENCE)

    def judged(values, texts, depths):
        best, most = max([sitetree.SURE, *values.values()]), max(texts.values())
        shares = {p: v / best for p, v in values.items()}
        return shares, max([(depths[p], texts[p], p) for p, x in shares.items() if x >= sitetree.GOOD and values[p] >= sitetree.SURE and 2 * texts[p] >= most], default=(None,) * 3)[2]

    anywhere = {p: weighed(*x, sitetree.LIKELY[x[2] % 8]) for p, x in every.items() if x[0]}
    usual = judged(anywhere, {p: len(set(every[p][0].values())) for p in anywhere}, {p: every[p][2] // 8 for p in anywhere})[1]
    hosts = {}
    for (host, path), x in seen.items():
        if x[0]:
            hosts.setdefault(host, {})[path] = x
    own = {h: judged({p: weighed(*x, anywhere[p]) for p, x in of.items()}, {p: len(set(x[0].values())) for p, x in of.items()}, {p: x[2] // 8 for p, x in of.items()}) for h, of in hosts.items()}
    return own, usual


@pytest.mark.parametrize("names", [True, False])
def test_trees_by_brute_force(spark, sf, names):
    """Verdicts and main branches of every host of the given pages, computed from the parsed pages alone."""
    table = common.table(spark, sf, "pages")
    own, usual = verdicts([(r.url, r.html) for r in table.collect()], names)
    got = {r.host: r for r in sitetree.site_trees(table, names).collect()}
    assert got.keys() == own.keys() and len(got) > 20 and {r.usual for r in got.values()} == {usual}
    for host, (shares, main) in own.items():
        edge = {p for p, x in shares.items() if min(abs(x - sitetree.LOW), abs(x - sitetree.GOOD)) < 1e-9}
        assert set(got[host].low) - edge == {p for p, x in shares.items() if x < sitetree.LOW} - edge and set(got[host].good) - edge == {p for p, x in shares.items() if x >= sitetree.GOOD} - edge and got[host].own == main


def article_of(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))).split())


def test_the_trees_alone_find_the_articles(spark, sf):
    """Without heeding names or article elements."""
    table = common.table(spark, sf.replace("sf0.001", "sf0.01"), "pages")
    got = {r.page_id: r.text for r in sitetree.extract(spark, table, names=False).collect()}
    assert got == {r.page_id: article_of(r.html) for r in table.collect()}


def test_without_the_trees_the_result_is_another(spark, sf):
    """The registered query's texts come from the trees: with empty ones every page keeps its adverts."""
    got = {r.page_id: r.text for r in queries.op1_main_text(spark, sf).collect()}
    pages = {r.page_id: r.html for r in common.table(spark, sf, "pages").collect()}
    assert all(sitetree.main_text(page, sitetree.Tree()) != got[k] == sitetree.main_text(page, sitetree.Tree.alone(page)) for k, page in pages.items())


def test_evidence_outweighs_names(spark):
    """A block that a name calls an advert stays where every page has its own text in it and it lies in the main branch; with no
    pages to go by it goes. Comments go with any number of pages."""
    page = lambda k: f"<body><article><p>Story {k} of the day.</p><p>Line {k}.</p><div class='banner'>Fact {k}</div><ul class='comments'><li>Mine {k}</li><li>Yours {k}</li></ul></article><div class='legal'>All rights.</div></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(200)] + [(900, "http://b.example/", page(900).replace("banner", "adbox"))]
    got = {r.page_id: r.text for r in sitetree.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 of the day. Line 3. Fact 3" and got[900] == "Story 900 of the day. Line 900."


def test_extract_over_the_table(spark, sf):
    pages = {r.page_id: r for r in common.table(spark, sf, "pages").collect()}
    rows = queries.op1_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, None, big, "k"), (2, "http://A.Example:8080/b?c#d", big, "k"), (2, "http://A.Example:8080/b?c#d", big, "k"), (3, "no url", None, None), (4, "", "", None), (None, "http://a.example/", big, None), (5, "http://a.example/", "small", None), (6, "http://a.example/", "small", None), (7, "http://a.example/x\r\ny", "<p>é", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_pages_bear_odd_rows(spark, odd_pages):
    assert sitetree.extract(spark, odd_pages).count() == odd_pages.count()
    assert sitetree.extract(spark, odd_pages.limit(0)).count() == 0
    rows = warc.archive(spark, odd_pages).collect()
    assert len(rows) == odd_pages.count()
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in rows)
    assert kinds == sorted([("1", "revisit", "2"), ("2", "response", "None"), ("2", "response", "None"), ("3", "response", "None"), ("4", "response", "None"), ("None", "revisit", "2"), ("5", "response", "None"), ("6", "response", "None"), ("7", "response", "None")])
    sizes = {r.page_id: (r.payload_bytes, r.payload_digest) for r in rows}
    assert sizes[1] == (2003, hashlib.sha1(b"<p>" + b"x" * 2000).hexdigest()) and sizes[3] == (0, hashlib.sha1(b"").hexdigest()) and sizes[7][0] == 5
    assert warc.archive(spark, odd_pages.limit(0)).count() == 0


def test_archive_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    columns = "page_id, url, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"SELECT {columns} FROM ({warc.ORACLE})").fetchall()
    assert sorted(map(tuple, queries.op4_warc(spark, sf).select(*columns.split(", ")).collect()), key=str) == sorted(want, key=str)


def test_look_up_reads_by_key(spark, sf):
    common.bounded_batches(spark)
    folder = common.shared_dir(spark, "w")
    pages = common.table(spark, sf, "pages")
    manifest = warc.write_index(warc.write_archives(spark, pages, folder), folder, shard_lines=20, block_lines=7)
    assert len(manifest) > 1 and len(warc.Index(folder, manifest[0]["name"]).directory) > 1
    rows = pages.collect()
    for r in rows[::9]:
        same = sorted(x.page_id for x in rows if warc.sort_key(x.url) == warc.sort_key(r.url))
        found = warc.look_up(folder, manifest, r.url)
        assert [x["page_id"] for x in found] == same
        assert r.html.encode() in [x["payload"] for x in found]
    assert warc.look_up(folder, manifest, "http://nowhere.invalid/") == []


def test_sort_key():
    assert warc.sort_key("https://User@WWW.Example.com:443/A?b#c") == "com,example,www)/A?b"
    assert warc.sort_key("http://a.b:81") == "b,a:81)/" and warc.sort_key(None) == "" and warc.sort_key("x") == "x"
