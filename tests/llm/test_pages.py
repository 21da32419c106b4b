"""Page differencing against a plain version over whole hosts, hand-made pages, and longest common subsequences."""

import html as entities
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import page_lines, pages, queries
from lodestone.llm.page_lines import ARTICLE, FURNITURE, LOOSE, MAIN, lines_of

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def kept(html):
    return [x for x, k in lines_of(html) if k != FURNITURE]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a  b\n\tc&nbsp;&amp;&copy;&#x41;&notit;</p>d", ["a b c &©A¬it;", "d"]),
        ("<p><b>one<br>two<p>three", ["one two", "three"]),
        ("<nav><ul><li>Home</nav><main><p>x</main><footer>y</footer>", ["x"]),
        ("<div class='post-comments'><p>first!</p></div><div class=content-main>x</div>", ["x"]),
        ("<body class='has-sidebar'><div id=sidebar-left>no</div><p>x", ["x"]),
        ("<p>x <span class=ad>buy</span> y</p><div role=alert>cookies</div><div hidden>h</div><p style='display: none'>n</p>", ["x y"]),
        ("<script>var t='</p><p>no'</script><style>p{}</style><p>x<!-- <p>no --><textarea><p>no</textarea>", ["x"]),
        ("<p>a < b <3 &lt;p> c</p><?php no ?><!doctype no>", ["a < b <3 <p> c"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td><p>c</table>d", ["a", "b", "c", "d"]),
        ("<ul><li class=ad>buy<li>x</ul>", ["x"]),
        ("<header><h1>Site</h1></header><article><header><h1 class=header>T</h1></header><p>x</p><footer>f</footer></article>", ["T", "x"]),
        ('<a title="a>b" href=x>c</a><img alt="no">', ["c"]),
        ("<p>a<p class", ["a"]),
        ("", []),
        ("plain", ["plain"]),
        ("<p>\x00 ퟿ é </p>", ["\x00 ퟿ é"]),
    ],
)
def test_lines(html, want):
    assert kept(html) == want


def test_where_lines_stand():
    assert lines_of("<h1>a</h1><main>b<article>c<aside>d</aside></article>e</main><nav>f") == [("a", LOOSE), ("b", MAIN), ("c", ARTICLE), ("d", FURNITURE), ("e", MAIN), ("f", FURNITURE)]


def test_reading_is_linear_in_broken_pages():
    n = 100_000
    for bad in ("<a ", '<a b=">" ', "<!-- ", "<div>", "<p>", "<script>", "<", '<a b="', "&", "<li><p>", "</b>", " \n"):
        began = time.time()
        lines_of(bad * n)
        assert time.time() - began < 15, bad


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


@pytest.mark.parametrize("bits", [1 << 27, 25, 1])
def test_common_subsequences_are_longest(monkeypatch, bits):
    monkeypatch.setattr(page_lines, "TABLE_BITS", bits)
    r = random.Random(bits)
    for _ in range(800):
        a, b = ([r.randrange(5) for _ in range(r.randrange(15))] for _ in range(2))
        got = page_lines.shared(a, b)
        assert len(got) == longest(a, b)[-1][-1]
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def site(seed, n):
    """Pages without marks: templates by host around own lines; some copies, some with marks, some odd."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        host = r.choice(["a.example", "a.example", "a.example", "b.example", "c.example"])
        head, foot = [f"{host} menu {k}" for k in range(4)], [f"{host} all rights {k}" for k in range(3)]
        own = [f"line {i} {k} " + " ".join(str(r.randrange(99)) for _ in range(30)) for k in range(r.randrange(1, 6))]
        tag = r.choice(["p", "div", "li"])
        lines = [x for x in head if r.random() < 0.9] + own + [x for x in foot if r.random() < 0.9]
        body = "".join(f"<{tag}>{entities.escape(x)}</{tag}>" for x in lines)
        shape = r.random()
        if shape < 0.15:
            body = f"<p>{host} top</p><article>{body}</article>"
        elif shape < 0.3:
            body = f"<p>{host} top</p><main>{body}</main>"
        rows.append((i, f"http{r.choice(['', 's'])}://{r.choice(['', 'u@'])}{host}/{r.choice(['x', 'y', 'y/z'])}/{r.randrange(60)}{r.choice(['', '?q=1', '#f'])}", body))
        if r.random() < 0.15:
            rows.append((1000 + i, rows[-1][1] + "x", body + "<p>changed</p>" * (r.random() < 0.5)))
        if r.random() < 0.1:
            rows.append(rows[-1])
    return rows + [(5000, None, "<p>no url</p>"), (5001, None, "<p>no url</p>"), (5002, "", None), (None, "http://a.example/q", None), (None, None, None), (5003, "not a url", "<p>x"), (5004, "http:///path", "<p>x"), (5005, "http://a.example/", "")]


def plain(rows):
    """All pages of a host in order, each compared with the one before and the one after."""
    split = lambda u: re.fullmatch(r"(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*))?([^?#]*).*", u, re.S)
    seen = {}
    for page_id, url, html in rows:
        seen[page_id, url, html] = seen.get((page_id, url, html), 0) + 1
    hosts = {}
    for page_id, url, html in seen:
        m = split(url) if url is not None else None
        hosts.setdefault((m[1] or "").lower() if m else "", []).append(((m[2] if m else "", url or "", page_id or -1), page_id, url, html))
    out = []
    for host, own in hosts.items():
        own = sorted(own, key=lambda x: x[0])
        lines = [lines_of(x[3] or "") for x in own]
        gone = [set() for _ in own]
        for i in range(len(own) - 1 if host else 0):
            a, b = lines[i], lines[i + 1]
            t, x, y, pairs = longest([v for v, _ in a], [v for v, _ in b]), len(a), len(b), []
            while x and y:
                if a[x - 1][0] == b[y - 1][0]:
                    x, y = x - 1, y - 1
                    pairs.append((x, y))
                elif t[x - 1][y] >= t[x][y - 1]:
                    x -= 1
                else:
                    y -= 1
            part = [sum(len(p[k][0]) for k in z if p[k][1]) / max(1, sum(len(v) for v, k in p if k)) for p, z in ((a, [p[0] for p in pairs]), (b, [p[1] for p in pairs]))]
            if max(part) <= 0.8:
                gone[i] |= {p[0] for p in pairs}
                gone[i + 1] |= {p[1] for p in pairs}
        for (_, page_id, url, html), own_lines, off in zip(own, lines, gone):
            most = max((k for _, k in own_lines), default=0)
            text = "\n\n".join(v for n, (v, k) in enumerate(own_lines) if k == most and k and (k == ARTICLE or n not in off))
            out += [(page_id, url, text, len(text))] * seen[page_id, url, html]
    return out


def key(r):
    return tuple((v is not None, v) for v in r)


@pytest.mark.parametrize("ranges", ["1", "4", "40"])
def test_pages_equal_the_plain_version_wherever_ranges_end(spark, ranges):
    rows = site(3, 150)
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("host", "path", "digest", "part", "own", "text", "keys", "n_chars"):
        frame = frame.withColumn(name, F.lit("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = [tuple(r[c] for c in ("page_id", "url", "text", "n_chars")) for r in pages.main_text(frame.repartition(3)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert any("menu" not in r[2] and "line" in r[2] for r in got)


def test_an_empty_table(spark):
    got = pages.main_text(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns[:4] == ["page_id", "url", "text", "n_chars"]


def test_given_pages_give_their_articles(spark):
    where = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in queries.op13_page_differencing(spark, where).collect()}
    for r in spark.read.parquet(f"{where}/pages.parquet").collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        lines = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in parts)
        assert got[r["page_id"]] == "\n\n".join(x for x in lines if x)


def test_a_very_long_page_and_its_neighbour(spark):
    long = "".join(f"<p>row {i}</p>" for i in range(30_000))
    rows = [(1, "http://h.example/a", "<p>menu</p>" + long + "<p>end</p>"), (2, "http://h.example/b", "<p>menu</p><p>own</p><p>end</p>" + "<p>other text</p>" * 2000), (3, "http://h.example/c", "<p>menu</p>" + "word " * 500_000 + "<p>end</p>")]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "\n\n".join(f"row {i}" for i in range(30_000))
    assert got[2].startswith("own\n\nother") and got[3] == " ".join(["word"] * 500_000)
