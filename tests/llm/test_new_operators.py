"""Centroids, fill-in-middle and page texts against brute force and round trips."""

import hashlib
import html
import math
import os
import random
from html.parser import HTMLParser

import numpy as np
import pytest

from flowguard.llm import html_main
from flowguard.llm.centroids import Codebook, assign, cluster_vectors, largest_component, whole_vectors
from flowguard.llm.fill_in_middle import BLOCK, BlockTree, fill_in_middle, middle_digests, restored
from flowguard.llm.html_main import host_paths, main_texts, read_page
from tests.llm.helpers import LONG, awkward, awkward_rows, empty

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

VECTORS = "vec_id long, embedding array<double>, cluster int, v string, distance double, inertia int"


def plain_clusters(rows, clusters, rounds, d):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == d and all(x is not None and math.isfinite(x) for x in e)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) < largest_component(d)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for k, vs in members.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    return [
        (i, c, dist, sum(x[1] for x in found if x[2] == c), sum(x[1] for x in found), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for i, dist, c in found
    ]


def vector_rows():
    rng, d = random.Random(4), 6
    rows = [(i, [rng.gauss(i % 3, 0.3 + i % 5) for _ in range(d)]) for i in range(180)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 7)]
    rows += [(204, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (205, [float("nan")] * d), (206, [float("inf")] * d), (207, [0.0] * d), (208, [1e300] * d), (209, [-2e5] * d)]
    return rows


def as_tuples(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def test_centroids_equal_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, e, 1, "v", 0.0, 2) for i, e in rows], VECTORS)
    for parts in (1, 7):
        got = as_tuples(cluster_vectors(df.repartition(parts), clusters=5, rounds=3, dimensions=6))
        assert got == sorted(plain_clusters(rows, 5, 3, 6), key=str)
    assert as_tuples(cluster_vectors(df.limit(3), clusters=5, dimensions=6)) == sorted(plain_clusters(rows[:3], 5, 3, 6), key=str)
    assert cluster_vectors(df.limit(0)).count() == 0


def test_search_prunes_and_breaks_ties_by_number():
    rng = np.random.default_rng(2)
    x = rng.integers(-900, 900, (3000, 8)) + rng.integers(-4000, 4000, (3000, 1))
    book = np.concatenate([x[:60], x[:20], x[5:6]])
    cluster, distance, compared = Codebook(book).nearest(x)
    every = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert compared.mean() < len(book) / 4
    edge = largest_component(8) - 1
    far = np.array([[edge] * 8, [-edge] * 8, [edge, -edge] * 4])
    cluster, distance, _ = Codebook(far).nearest(far[::-1].copy())
    assert cluster.tolist() == [2, 1, 0] and not distance.any()


def test_assignment_of_other_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, -0.5]), (2, [9.0, 9.0])], "vec_id long, embedding array<double>")
    whole = whole_vectors(df, dimensions=2)
    assert {r.vec_id: r.v for r in whole.collect()} == {1: [32, -32], 2: [576, 576]}
    assert {r.vec_id: r.cluster for r in assign(whole, np.array([[500, 500], [0, 0]]), dimensions=2).collect()} == {1: 1, 2: 0}


def unit_cuts(text, unit):
    """Code-point offsets at which units begin."""
    if unit == "character":
        return list(range(len(text)))
    gap = "\x20\x09\x0a\x0b\x0c\x0d"
    if unit == "line":
        return [0] * bool(text) + [i for i in range(1, len(text)) if text[i - 1] == "\n"]
    begins = [i for i, c in enumerate(text) if c not in gap and (i == 0 or text[i - 1] in gap)]
    return ([0] + begins[1:]) if text else []


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_tree_cuts_equal_plain_cuts(unit):
    rng = random.Random(3)
    for n in [0, 1, 2, 7, 40, 300, 900]:
        text = "".join(rng.choice("aé漢🙂 b\nc\t") for _ in range(n))
        tree, begins = BlockTree(text.encode(), unit, block=16), unit_cuts(text, unit)
        assert (tree.units, tree.chars) == (len(begins), len(text))
        for k in range(len(begins) + 1):
            at = begins[k] if k < len(begins) else len(text)
            assert tree.cut(k) == (len(text[:at].encode()), at)


MIDDLE_TEXTS = [None, "", "a", "<P>", "x<S>y", "almost <P or <S", "<<<<P", "é漢🙂" * 50, LONG, "S>M>P><", "plain words here"]


def plain_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_fill_in_middle_equals_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(MIDDLE_TEXTS * 12)] + [(r[0], r[1]) for r in awkward_rows()]
    df = spark.createDataFrame([(i, t, "o", "f") for i, t in rows], "doc_id long, text string, output string, form string")
    made = fill_in_middle(df)
    got = sorted(((r.doc_id, r.n_chars, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted((plain_middle(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    digests = middle_digests(fill_in_middle(awkward(spark))).collect()
    assert sorted(r.restored_sha256 for r in digests) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in awkward_rows())
    assert middle_digests(fill_in_middle(empty(spark))).count() == 0


def test_fill_in_middle_by_words_and_other_marks(spark):
    text = " " + " ".join(f"wörd{i}" for i in range(3 * BLOCK // 8)) + " \n"
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    marks = ("[p]", "(s|", "*m*")
    for r in fill_in_middle(df, unit="word", plain_from=100, marks=marks).select("*", restored(F.col("output"), F.col("form"), marks).alias("back")).collect():
        assert r.back == text and r.n_units == 3 * BLOCK // 8 and r.form != "plain"
        assert r.prefix_chars in (0, len(text)) or text[r.prefix_chars - 1] in " \n" and text[r.prefix_chars] == "w"


class ArticleText(HTMLParser):
    """Plain reading of pages whose main text is the only article and has no boilerplate inside."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("h1", "p", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("h1", "p", "article"):
            self.blocks.append("")
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def handle_entityref(self, name):
        self.handle_data("&" + name + ";" if f"{name};" in html.entities.html5 else "&" + name)

    def text(self):
        return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in self.blocks) if t)


@given
def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        plain = ArticleText()
        plain.feed(r.html)
        assert r.text == plain.text(), r.page_id
        assert r.n_chars == len(r.text)


LOREM = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


def words(seed, n):
    rng = random.Random(str(seed))
    return " ".join(rng.choice(LOREM) for _ in range(n))


def planted_page(k, article=60, reader=20, comments_class="talk"):
    """A page whose comments have no telling class; returns (html, main text)."""
    paras = [words((k, j), article) for j in range(3)]
    body = "".join(f"<p>{p}</p>" for p in paras[:2]) + f'<div class="ad-box ad{k}">Buy now {words((k, 9), 40)}</div><p>{paras[2]} &amp; more<br>end'
    side = f'<div class="sidebar"><p>{words((k, 11), 80)}</p></div><div class="cookie-notice">We use cookies {words(k, 50)}</div>'
    talk = f'<div class="{comments_class}-{k}">' + "".join(f"<p>{words((k, 20 + j), reader)}</p>" for j in range(4)) + "</div>"
    form = "<form action=/s><label>Your mail</label><input name=q><button>Send</button></form>"
    page = (
        f'<!doctype html><html><head><title>t{k}</title></head><body class="with-sidebar"><header><a href="/">Site</a></header><nav><li>a<li>b</nav>'
        f'<div class="row"><div class="text-{k}"><h1>Title {k}</h1>{body}</div>{side}{talk}</div>{form}<footer>&copy; us</footer></body></html>'
    )
    return page, "\n".join([f"Title {k}", *paras[:2], f"{paras[2]} & more end"])


PAGES = "page_id long, url string, html string, host string, paths string, votes long, text string"


def test_host_consensus_beats_wordy_comments(spark):
    pages = {k: planted_page(k, reader=900 if k % 7 == 0 else 20) for k in range(40)}
    rows = [(k, f"https://a.example.com/{k}", h, "h", "p", 1, "t") for k, (h, _) in pages.items()]
    lone, _ = planted_page(0, reader=900)
    rows.append((100, "https://b.example.com/0", lone, "h", "p", 1, "t"))
    df = spark.createDataFrame(rows, PAGES)
    for bound in (0, 1 << 20):
        got = {r.page_id: r.text for r in main_texts(df, broadcast_bytes=bound).collect()}
        assert {k: got[k] for k in pages} == {k: t for k, (_, t) in pages.items()}
        assert got[100] != pages[0][1]  # alone on its host the page follows its longest container
    agreed = {r.host: r for r in host_paths(df).collect()}
    assert agreed["a.example.com"].pages == 40 and agreed["a.example.com"].paths[0].path.endswith("div.text")


def test_page_structures():
    def own(source):
        page = read_page(source)
        return page.text(html_main.chosen_path(page, {}))

    assert own("<main><header>Top</header><article><header><h1>T</h1></header><p>a&nbsp; b<p>c <b>d<ul><li>e<li>f</ul></article></main>") == "T\na b\nc d\ne\nf"
    assert own('<article><p>One</p><aside>no</aside><script>if (a < b) "</p>"</script><style>x</style><section id=comments><p>no</p></section></article>') == "One"
    assert own('<article><p>One two three</p></article><article class="comment">first! first! first! first! first!</article>') == "One two three"
    assert own("plain text, no tags &lt;b&gt;") == "plain text, no tags <b>"
    assert own("<body>a < b and <3 <p title='x > y'>c</p><p class=\"open>d</p><p>e</p>") == "a < b and <3\nc\nd\ne"
    assert own("<form><div class=page><p>Only text, in a form</p></div></form>") == "Only text, in a form"
    assert own("<pre><code>x <span class=comment># y</span></code></pre><p>z <span class=ad>buy</span></p>") == "x # y\nz"
    assert own("<table><tr><td>a<td>b<tr><td>c</table>") in ("a\nb\nc", "a", "b", "c")
    site = '<div id="header">Site name and words</div><div class="site-header">x</div>'
    assert own(f'<body class="header-fixed">{site}<div class="content"><div class="page-header"><h1>T</h1></div><p>long text here</p></div>') == "T\nlong text here"
    assert own("<nav>only menu</nav><footer>f</footer>") == "" and own("") == "" and own("<p") == "" and own("<!-- x") == ""
    assert own("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_pages_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<p>x</p>"), (None, "http://H.example/", "<p>y</p>"), (4, "http://u@h.example:80/p", "<p>z</p>")]
    rows += [(5, "http://h.example/l", "<article>" + "<p>word</p>" * 50_000 + "</article>")] + [(6, "http://h.example/r", "<p>r</p>")] * 3
    df = spark.createDataFrame([(*r, "h", "p", 1, "t") for r in rows], PAGES)
    for bound in (0, 1 << 20):
        got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_texts(df, broadcast_bytes=bound).collect()), key=str)
        plain = {3: "x", None: "y", 4: "z", 5: "\n".join(["word"] * 50_000), 6: "r"}
        assert got == sorted(((i, u, plain.get(i, ""), len(plain.get(i, ""))) for i, u, _ in rows), key=str)
    assert main_texts(df.limit(0)).count() == 0
    assert {r.host for r in host_paths(df).collect()} == {"h.example"}
