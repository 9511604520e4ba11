"""HTML extraction: reading pages, repeated strings against brute force, edge cases."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.llm import pages
from talus.llm.common import shipped


def text(source):
    page = pages.read(source)
    return pages.text_of(page, np.zeros(sum(len(t.split()) for t in page.texts), bool))


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>a &amp; b<p>c&nbsp;&eacute;&#33; <br>d</p>", "a & b\nc é! d"),
        ("<nav><ul><li>x</ul></nav><article><h1>T  t</h1>one<p><b>two <i>three</b></i><p>four</article><footer>y</footer>", "T t\none\ntwo three\nfour"),
        ("<head><title>t</title><style>p{}</style></head><body>a<script>var x='</p>';</script>b<!-- c -->d</body>", "abd"),
        ("<div class='ad'>x</div><div class='has-sidebar'><p>y</p></div><div id=sideBar>z</div>", "y"),
        ("<article>a<section id='comments'><article class='comment'>b</article></section><aside>c</aside><form>d</form>e</article>", "a\ne"),
        ("<article><header><h1>H</h1></header><div class='entry-header'>s</div><p>t</p><footer>f</footer></article>", "H\ns\nt"),
        ("<header>site</header><div role=navigation>n</div><p hidden>h</p><p style='display: none'>i</p><main>m</main>", "m"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>", "a\nb\nc\nd\ne"),
        ("a < b <3 </ c> d", "a < b <3 d"),
        ("<p title='>'>q</p><p title=\"a>b\">r", "q\nr"),
        ("</p></div>x</b>y</article>z", "xy\nz"),
        ("<noscript>n</noscript><template><p>t</p></template><svg><text>s</text></svg><p>k", "k"),
        ("<script>never closed <p>x", ""),
        ("<p>unclosed <a href='x", "unclosed"),
        ("<!-- never closed <p>x", ""),
        ("<head><meta charset=utf-8><body><p>no end of head", "no end of head"),
        ("", ""),
        ("<p>a</p><hr><pre>b\n  c</pre>", "a\nb c"),
        ("<article>1</article><article>2</article><p>teaser</p>", "1\n2"),
        ("<div class='cookie-notice'>c</div><div class='Newsletter_signup'>n</div>o", "o"),
    ],
)
def test_read(source, want):
    assert text(source) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<nav", ">", "'", '"', "word ", "&", "&#", "<", "</", "<!--", "-->", "<script>", "</script>", "<li>", "<td>", "</table>", "<body>", "&lt;", "\x00", "é"]), max_size=25))
def test_any_text_is_read(parts):
    got = pages.read("".join(parts))
    assert len(got.texts) == len(got.roles) and all(t == " ".join(t.split()) and t for t in got.texts)


def test_long_pages_take_linear_time():
    for part in ("<p>a b ", "<div>", "<b>", "</p>", "< ", "&", "<!-- x -->", "<script>", "<li>a", "<td>", "<p", "'", "<a '", "x "):
        pages.read(part * 100_000)
    assert len(text("<article>" + "<p>word " * 200_000).split("\n")) == 200_000


def make(rd):
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rd.choice(vocabulary) for _ in range(n))
    notices, rows = [say(n) for n in (12, 11, 30, 13, 60)], []
    for i in range(160):
        host = rd.choice(["a.example", "b.example", "A.example:80"])
        body = [f"<p>{say(rd.randrange(5, 60))}</p>" for _ in range(rd.randrange(3))]
        body += [f"<div>{say(rd.randrange(3))} {rd.choice(notices)} {say(rd.randrange(3))}</div>" for _ in range(rd.randrange(3))]
        rd.shuffle(body)
        inner = "".join(body)
        rows.append((i, f"http://{host}/{i}", f"<article>{inner}</article><footer>{notices[2]}</footer>" if i % 4 == 0 else f"<body>{inner}"))
    return rows + [(500, "http://a.example/copy", rows[5][2]), (501, "http://b.example/x", "<p>" + notices[4]), (5, *rows[5][1:])]


def brute(rows, long):
    """Words of each row that a string of ``long`` words covers which another page of the host has."""
    read, where = [], collections.defaultdict(set)
    for _, url, source in rows:
        page = pages.read(source or "")
        own = [w for t, r in zip(page.texts, page.roles) if r != pages.MAIN for w in t.split()]
        host = url.split("/")[2].split(":")[0].lower() if url and "//" in url else ""
        read.append((page, own, host))
        for i in range(len(own) - long + 1):
            where[host, tuple(own[i : i + long])].add(tuple(page.texts))
    out = collections.Counter()
    for (key, url, _), (page, own, host) in zip(rows, read):
        hit = np.zeros(len(own), bool)
        for i in range(len(own) - long + 1):
            if len(where[host, tuple(own[i : i + long])]) > 1:
                hit[i : i + long] = True
        got = pages.text_of(page, hit)
        out[key, url, got, len(got), int(hit.sum())] += 1
    return out


@pytest.mark.parametrize("seed, limit", [(1, 20_000), (2, 1)])
def test_extraction_equals_brute_force(spark, seed, limit):
    shipped(spark)
    rows = make(random.Random(seed)) + [(None, None, None), (700, None, ""), (701, "nonsense", "<p>" + "a b " * 30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, _page string").repartition(5)
    got = collections.Counter(tuple(r) for r in pages.extracted(df, limit=limit).collect())
    want = brute([r for r in rows], pages.LONG)
    assert got == want and sum(k[4] > 0 for k in want) > 50


def test_no_pages(spark):
    shipped(spark)
    df = spark.createDataFrame([], "page_id long, url string, html string")
    out = pages.extracted(df)
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_repeated"] and not out.collect()


def test_articles_of_the_table(spark):
    """Every page of the table has an article, told by its markup: all of it, and nothing else."""
    import html
    import re

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r for r in pages.query(spark, sf).collect()}
    assert len(got) == len(rows)
    for key, source in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", source)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[key].text, got[key].n_chars) == (want, len(want))


def test_streams_hold_every_word():
    """Words of articles are part of the streams, in a piece of their own."""
    sources = ["<p>a b</p><article>c <p>d a</article><footer>e</footer>", "", "<nav>\u00e9</nav>f", "<article>a</article>"]
    got = [pages.read(x) for x in sources]
    words, ends = pages.streams(got, ["x", "x", "x", "y"])
    assert ends.tolist() == [3, 6, 6, 6, 8, 8, 8, 9]
    assert len(set(words[:8].tolist())) == 7 and words[0] == words[5] and words[8] != words[0]
    assert [pages.unpacked(pages.packed(p)) for p in got] == got


def test_pages_tell_all_their_anchors_at_once():
    """Those of words outside the article and inside, each by itself; a page is read once for both."""
    import pyarrow as pa

    rows = make(random.Random(6))
    hosts, sources = [url.split("/")[2] for _, url, _ in rows], [x for *_, x in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(hosts), pa.array(sources)], names=["row", "host", "html"])
    got = collections.Counter((r["anchor"], r["page"], r["inside"]) for b in pages._anchors([batch], pages.LONG, pages.ANCHOR) for r in b.to_pylist())
    want = set()
    for i, (host, source) in enumerate(zip(hosts, sources)):
        page = pages.read(source)
        own = pages._page(np.array([pages._stream(page, host)], np.uint64), np.array([i]))[0]
        for inside in (False, True):
            kept = [(t, r) for t, r in zip(page.texts, page.roles) if (r == pages.MAIN) == inside]
            h = pages.anchors(*pages.streams([pages.Page([t for t, _ in kept], [r for _, r in kept])], [host]), pages.LONG, pages.ANCHOR)[1]
            want |= {(x, own, inside) for x in h.view(np.int64).tolist()}
    assert set(got) == want and max(got.values()) == 1 and {x[2] for x in want} == {False, True}


@pytest.mark.parametrize("limit", [20_000, 1])
def test_articles_are_judged_by_the_same_strings(spark, limit):
    """Words of articles that are boilerplate of the host, against brute force over the whole streams."""
    shipped(spark)
    rows, long = make(random.Random(3)), pages.LONG
    votes, judged = collections.defaultdict(set), collections.Counter()
    for _, url, source in rows:
        page = pages.read(source)
        own = [w for t, r in zip(page.texts, page.roles) if r != pages.MAIN for w in t.split()]
        for i in range(len(own) - long + 1):
            votes[url.split("/")[2].split(":")[0].lower(), tuple(own[i : i + long])].add(tuple(page.texts))
    for key, url, source in rows:
        page = pages.read(source)
        own, hit = [w for t in page.main() for w in t.split()], set()
        for i in range(len(own) - long + 1):
            if len(votes[url.split("/")[2].split(":")[0].lower(), tuple(own[i : i + long])]) > 1:
                hit |= set(range(i, i + long))
        judged[key, url, len(hit)] += 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = pages.extracted(df, limit=limit, inside="n_inside")
    got = collections.Counter((r.page_id, r.url, r.n_inside) for r in out.collect())
    assert got == judged and sum(n > 0 for _, _, n in got) > 10


def test_articles_have_no_vote(spark):
    """A page without an article keeps the text of its host's articles; what pages share outside articles goes, also where an article has it."""
    shipped(spark)
    rd = random.Random(4)
    say = lambda n: " ".join(rd.choice("abcdefghij") + str(rd.randrange(100)) for _ in range(n))
    story, notice = say(40), say(15)
    rows = [
        (1, f"<article><p>{story}<p>{notice}</article>"),
        (2, f"<article><p>{story}</article><footer>{say(14)}</footer>"),
        (3, f"<div>{story}</div><div>{notice}</div>"),
        (4, f"<footer>{notice}</footer><p>{say(3)}"),
    ]
    df = spark.createDataFrame([(i, "http://h.example/", x) for i, x in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.extracted(df, inside="n_inside").collect()}
    assert got[1].text == f"{story}\n{notice}" and (got[1].n_repeated, got[1].n_inside) == (0, 15)
    assert got[2].text == story and (got[2].n_repeated, got[2].n_inside) == (0, 0)
    assert got[3].text == story and (got[3].n_repeated, got[3].n_inside) == (15, 0)
    assert got[4].n_repeated == 15 and len(got[4].text.split()) == 3
