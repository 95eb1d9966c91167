import random
import time
from collections import Counter, defaultdict

import pytest

from latticeforge.llm import html

SCHEMA = "page_id long, url string, html string, host int, template string"


def article(rng, n=4):
    words = [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(n)]


def page(rng, blocks, share="Tell your friends about us"):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return f"""<html><head><title>T {rng.random()}</title><script>if (a < b) {{ "</p>" }}</script></head><body class="has-sidebar">
    <div class="top-nav"><a href="/">Home</a> <a href=/x>News {rng.random()}</a></div>
    <div class="wrap sidebar-page"><div id="content">{body}<p>{share}</p></div>
    <div class="sidebar">Other things {rng.random()}</div></div>
    <section id="comments"><p>First! {rng.random()}</p></section><div class="cookie-notice">We use cookies</div><footer>(c)</footer></body></html>"""


def test_elements():
    t = lambda h: html.main_text(h)
    assert t(None) == t("") == t("<p> \n </p>") == ""
    assert t("a &amp; b &lt;c&gt; &eacute;&#233;&#x41; x&nbsp;y &amp") == "a & b <c> éA".replace("éA", "ééA x y &")
    assert t("<p>one\n two<br>three<p>four <b>five</p>six") == "one two three\nfour five\nsix"
    assert t("<body><nav>m</nav><header>h</header><article><header><h1>H</h1></header><p>x</p><footer>f</footer><aside>s</aside><form>q<input></form></article><p>out</p></body>") == "H\nx"
    assert t("<main><div role=navigation>n</div><p>x</p><div hidden>y</div><div style='display: none'>z</div></main><p>out</p>") == "x"
    assert t("<div class=ad>a</div><div class='ads-left'>a</div><div id=\"adBox\">a</div><div class=shadow>k</div><p>k<!-- c > --></p><!-- open") == "k\nk"
    assert t("<div class='sidebar-wrap'><article><p>x</p></article></div>") == "x"
    assert t("<article><p>x</p><div class=comments><article><p>reader</p></article></div></article>") == "x"
    assert t("<article><p>x</p></article><section id=comments><article class=comment><div class=content>reader</div></article></section>") == "x"
    assert t("<style>p{}</style><script>var t='</p>';</script><noscript>n</noscript><p>1 < 2 <3</p><p title='a>b'>y") == "1 < 2 <3\ny"
    assert t("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert t("<p>" * 20000 + "deep") == "deep"


def brute_templates(rows, least=html.PAGES, share=html.SHARE, tokens=html.TOKENS):
    """Tokens of templates, but for elements that repeat in a page, by whole occurrence vectors, one host at a time."""
    out = set()
    hosts = defaultdict(dict)
    for host, h in rows:
        hosts[host][h or ""] = [html.token_hash(t) for t, _ in html.parse(h)]
    texts = {html.token_hash(t) for _, h in rows for t, b in html.parse(h) if b}
    for host, pages in hosts.items():
        if len(pages) < least:
            continue
        classes = defaultdict(list)
        for t in {t for p in pages.values() for t in p}:
            vector = tuple(p.count(t) for p in pages.values())
            n = sum(v > 0 for v in vector)
            if n >= max(least, -(-len(pages) * share // 1)):
                classes[n, vector].append(t)
        valid = {}
        for (n, vector), members in classes.items():
            orders = {tuple(sorted(members, key=p.index)) for p, v in zip(pages.values(), vector, strict=True) if v}
            if len(members) >= tokens and len(orders) == 1:
                valid[n, vector] = members
        if not valid:
            continue
        size = max((n, len(m)) for (n, _), m in valid.items())
        roots = [k for k, m in valid.items() if (k[0], len(m)) == size]
        assert len(roots) == 1
        root = set(valid[roots[0]])
        for key, members in valid.items():
            gaps = {sum(p.index(r) < p.index(t) for r in root if r in p) for p in pages.values() for t in members if t in p}
            if key == roots[0] or len(gaps) == 1:
                out |= {(host, t) for t in members if t in texts or max(key[1]) == 1}
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(8)
    rows = [("a", page(rng, article(rng, rng.randint(1, 6)))) for _ in range(9)] + [("b", page(rng, article(rng))) for _ in range(3)]
    rows += [("c", page(rng, article(rng), rng.choice(["Share", "Tell"]))) for _ in range(8)] + [("a", rows[0][1])] * 3 + [("a", None), ("c", "")]
    keys = {"a": 1, "b": 2, "c": 3}
    rows = [(keys[h], t) for h, t in rows]
    got = [tuple(r) for r in html.templates(spark.createDataFrame(rows, "h long, html string")).collect()]
    assert Counter(r[:2] for r in got) == Counter(brute_templates(rows)) and got
    assert {r[2] for r in got} == {html.TEXT, html.OTHER, html.ARTICLE}
    texts = {html.token_hash(t) for _, h in rows for t, b in html.parse(h) if b}
    assert all((r[2] == html.TEXT) == (r[1] in texts) for r in got)


@pytest.mark.parametrize("few", [0, html.FEW])
def test_extraction(spark, monkeypatch, few):
    monkeypatch.setattr(html, "FEW", few)
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(40):
        blocks = article(rng)
        host = "hot.example" if i % 2 else f"h{i % 10}.example"
        rows.append((i, f"https://u:p@{host}:80/{i}", page(rng, blocks), 0, ""))
        want[i] = "\n".join(blocks)
    rows += [(100, "https://hot.example/n", None, 0, ""), (101, None, "<p>x</p>", 0, ""), (None, "odd", "<p>é</p>", 0, ""), rows[1]]
    got = html.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert (by[100], by[101], by[None]) == ("", "x", "é")
    for i in range(40):
        assert by[i] == want[i], i
    assert html.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def bare(rng, blocks, extra=""):
    """A page whose elements have no telling names."""
    links = "".join(f"<div><a href=/{rng.random()}>{w}</a></div>" for w in article(rng, 3))
    return f"<html><body><div class=x1><div class=x2>{links}</div></div><div class=x3><div class=x4>Free to read, always.</div></div><div class=x5>{''.join(f'<p>{b}</p>' for b in blocks)}{extra}</div><div class=x6>{rng.choice(['Daily', 'Weekly'])}</div></body></html>"


def test_the_template_decides(spark, monkeypatch):
    """Menus of varying links, constant notices and a slot with two contents are told by the host's pages alone."""
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(30):
        blocks = article(rng)
        rows.append((i, f"https://bare.example/{i}", bare(rng, blocks), 0, ""))
        want[i] = "\n".join(blocks)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == want
    empty = spark.createDataFrame([], "h long, token long, kind int")
    monkeypatch.setattr(html, "templates", lambda pages: empty)
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert all(got[i] != want[i] and "Free to read" in got[i] for i in want)


def test_templates_of_the_driver_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    keyed = pages.selectExpr("xxhash64(regexp_extract(url, '://([^/]*)', 1)) AS h", "html")
    large = {r["h"] for r in keyed.distinct().groupBy("h").count().where("count >= 4").collect()}
    found = html.templates(keyed).collect()
    assert large and {r["h"] for r in found if r["kind"] == html.ARTICLE} == large


def test_inline_parts_that_are_no_text():
    t = html.main_text
    assert t("<p>Hello <button>Share now</button> world</p>") == "Hello world"
    assert t('<p>a <span class="advert">Buy</span> b <label>Name</label>c</p><p>d</p>') == "a b c\nd"
    assert t("<article><p class='social'>x</p><section id='related-work'><p>y</p></section><div class='related-posts'>z</div></article>") == "x\ny"


def test_time_is_linear_in_depth():
    for text in ("<div>x" * 50000, "<div>" * 50000 + "</section>" * 50000, "<i><div>" + "<b>" * 50000 + "</i>" * 50000, "<b>" * 50000 + "<p>y</p>" * 50000, "<article><div class=sidebar>" * 20000):
        start = time.perf_counter()
        html.main_text(text)
        assert time.perf_counter() - start < 3
