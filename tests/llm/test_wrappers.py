import html
import json
import random
import re
import time

from ledgerstone.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div><nav>Home</nav><main><article><h1>Ti&eacute; <b>b</b>old</h1>
<p>a  b<br>c&nbsp;d<p>un<i>clo</i>sed<div class="ad-slot">buy</div><ul><li>one<li>two</ul><form><input><label>Mail</label></form><section class="comments"><p>nice!</p></section><pre>x
 y</pre></article></main><aside>side</aside><script>if(a<b){"</p>"}</script><footer>foot</footer></body></html>"""


def test_main_text_of_pages(spark, data):
    def truth(page):
        inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", inside)
        return " ".join(filter(None, (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks)))

    pages = spark.read.parquet(f"{data}/pages.parquet")
    own = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in w.page_digest(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in own.items()}


def test_hard_pages(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "<p>loose &amp; free"), (5, "x", "<div>" * 3_000 + "deep"), (6, "http://h/6", "<script>never closed"), (7, "http://h/7", "a < b <!-- open"), (7, "http://h/7", "a < b <!-- open")]
    got = [(r["page_id"], r["text"]) for r in w.page_digest(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [(1, "Tié bold a b c d unclosed one two x y"), (2, ""), (3, ""), (4, "loose & free"), (5, "deep"), (6, ""), (7, "a < b"), (7, "a < b")]
    assert w.page_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_of_aligned_pages():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><h2>t</h2><p>y</p>", "<p>z</p>"]
    wrapper = None
    for p in pages:
        own = w.shape(w.page_tree(p)[0])
        wrapper = own if wrapper is None else w.align(wrapper, own)
    assert w.expression(wrapper) == "(<ul>(<li>#o</li>)+</ul>)?(<h2>#o</h2>)?<p>#o</p>"
    assert w.align(json.loads(json.dumps(wrapper)), wrapper) == wrapper


def test_same_texts_outside_articles_are_dropped(spark):
    rows = [(i, "http://site/x", f"<div class=a>Subscribe now</div><p>story {i}</p>") for i in range(6)]
    got = {r["text"] for r in w.page_digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"story {i}" for i in range(6)}


def test_pages_of_mixed_structure_lose_no_text(spark):
    by_hand = ["<article><blockquote>q</blockquote><div><ol><li>x</ol></div></article>", "<article><div><ol><li>x</ol></div></article>", "<article><div><p>y</p></div><blockquote>q</blockquote><div><ol><li>x</ol></div></article>"]
    rng = random.Random(7)

    def some(depth):
        if depth == 0 or rng.random() < 0.2:
            return f"w{rng.randrange(1_000)} "
        return "".join(f"<{t}>{some(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "blockquote", "ul", "b"], k=rng.randint(1, 4)))

    hosts = {"hand": by_hand} | {f"{kind}{k}": [f"<{kind}>{some(4)}</{kind}>" for _ in range(rng.randint(2, 12))] for k in range(30) for kind in ("article", "div")}
    rows = [(h, f"http://{h}/x", p) for h, pages in hosts.items() if not h.startswith("div") for p in pages]
    got = {r["html"]: r["main_text"] for r in w.extract(spark.createDataFrame(rows, "host string, url string, html string")).collect()}
    assert got == {p: " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p)).split()) for _, _, p in rows}
    for pages in hosts.values():
        trees = [w.page_tree(p) for p in pages]
        wrapper = w.shape(trees[0][0])
        for tree, _ in trees[1:]:
            wrapper = w.align(wrapper, w.shape(tree))
        for tree, texts in trees:
            own = w.shape(tree)
            assert {id(leaf) for leaf, *_ in texts} == set(w.Reader(own).read(tree))
            assert -1 not in w.slots_between(own, w.Reader(wrapper)).values()


def test_only_exact_attributes_and_whole_names_are_boilerplate(spark):
    kept = ['<a href="/hidden-gems">{}</a>', '<a href=/x/hidden>{}</a>', '<p title="the hidden cost">{}</p>', '<p aria-hidden="false">{}</p>', '<p data-id="ad">{}</p>', '<p data-class="ad" data-role=search>{}</p>', '<h2 id="related-work">{}</h2>', '<h2 id="search-and-navigation">{}</h2>', '<p class="banner-year">{}</p>', '<div id="comments">{}</div>', "<p title='class=\"ad\"'>{}</p>"]
    gone = ["<div hidden>{}</div>", '<div HIDDEN="">{}</div>', '<div Role=" Search ">{}</div>', '<div class="x ad">{}</div>', "<div class=ad-slot>{}</div>", "<div class='comment_list'>{}</div>", "<nav>{}</nav>"]
    outside = ['<h2 id="related-work">{}</h2>', '<p aria-hidden="false">{}</p>', '<p><a href="/hidden-gems">{}</a></p>', '<p title="the hidden cost">{}</p>']
    article = "<article>" + "".join(x.format(f" k{i} ") for i, x in enumerate(kept)) + "".join(x.format(f" g{i} ") for i, x in enumerate(gone)) + "</article>"
    neutral = "".join(x.format(f" k{i} ") for i, x in enumerate(outside)) + '<div id="left-sidebar">g</div><div class="top-nav">g</div>'
    rows = [(1, "http://a/1", article), (2, "http://b/2", neutral)]
    got = {r["page_id"]: r["text"] for r in w.page_digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: " ".join(f"k{i}" for i in range(len(kept))), 2: " ".join(f"k{i}" for i in range(len(outside)))}


def test_copies_of_a_page_keep_their_text(spark):
    copy, story = "<div class=a>Subscribe now</div><p>the same story</p>", "<div class=a>Subscribe now</div><p>story {}</p>"
    rows = [(i, None if i % 2 else "http://one/x", "<div><p>only page</p></div>") for i in range(10)]
    rows += [(100 + i, f"http://two/{i}", copy) for i in range(50)] + [(200 + i, f"http://two/{i}", story.format(i)) for i in range(3)]
    rows += [(300 + i, f"http://two/{i}", f"{copy}<nav>{'<a>n</a>' * i}</nav>") for i in range(5)]
    rows += [(400 + i, f"http://three/{i}", f"<h1>{'Daily' if i else 'Special'}</h1><p>news {i}</p>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in w.page_digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "only page" for i in range(10)} | {100 + i: "the same story" for i in range(50)} | {200 + i: f"story {i}" for i in range(3)} | {300 + i: "the same story" for i in range(5)}
    assert got == want | {400 + i: f"news {i}" if i else "Special news 0" for i in range(4)}


STORY = "<body><div class=q1><a href=/>Home</a> <a href=/n>News</a></div><div class=z7><div class=k><h2>Title {i}</h2><p>The story number {i} goes on for a good while and ends with {j}.</p><p>{more}</p></div></div><div class=w3><ul>{links}</ul></div><div class=t5>All rights kept</div></body>"


def stories(n):
    out = {}
    for i in range(n):
        links = "".join(f"<li><a href=/{k}>Also {i} {k}</a></li>" for k in range(3))
        more = " ".join(f"word{i}x{k}" for k in range(20))
        out[STORY.format(i=i, j=i * i, more=more, links=links)] = f"Title {i} The story number {i} goes on for a good while and ends with {i * i}. {more}"
    return out


def test_the_wrapper_finds_the_text_of_pages_without_telling_names(spark, monkeypatch):
    want = stories(8)
    rows = spark.createDataFrame([("http://plain/x", p) for p in want] + [("http://single/x", next(iter(want)))], "url string, html string")
    got = {(r["url"], r["html"]): r["main_text"] for r in w.extract(rows).collect()}
    assert {p: t for (u, p), t in got.items() if u == "http://plain/x"} == want
    alone = got["http://single/x", next(iter(want))]
    assert alone != want[next(iter(want))] and "Home" in alone  # ablation: what a page tells without its host's wrapper
    monkeypatch.setattr(w, "main_slots", lambda *a: [])
    without = {r["html"]: r["main_text"] for r in w.extract(rows.where("url = 'http://plain/x'")).collect()}
    assert all("Also" in without[p] for p in want)


def test_main_part_of_small_hosts_by_hand():
    pages = list(stories(5))
    trees = [w.page_tree(p)[0] for p in pages]
    wrapper = w.shape(trees[0])
    for t in trees[1:]:
        wrapper = w.align(wrapper, w.shape(t))
    reader = w.Reader(wrapper)
    told: dict = {}
    for page in pages:
        tree, texts = w.page_tree(page)
        slots = reader.read(tree)
        for leaf, _, raw in texts:
            told.setdefault(slots[id(leaf)], []).append(raw)
    counts = {k: (5, len(set(v)) == 1, sum(map(len, v))) for k, v in told.items()}
    chosen = set(w.main_slots(wrapper, counts))
    assert {k for k, v in told.items() if any(x.startswith(("Title", "The story", "word")) for x in v)} <= chosen
    assert not any(k in chosen for k, v in told.items() if any(x.startswith(("Home", "News", "Also", "All rights")) for x in v))
    assert w.main_slots(wrapper, {k: (2, False, 9) for k in told}) == []


def test_long_pages_take_bounded_time(spark):
    page = "<article>" + "".join(f"<h2>t{i}</h2><p>text {i}</p>" for i in range(1_000)) + "</article>"
    begin = time.perf_counter()
    out = w.extract(spark.createDataFrame([("http://long/x", page)] * 3, "url string, html string")).collect()
    assert {r["main_text"] for r in out} == {" ".join(f"t{i} text {i}" for i in range(1_000))} and time.perf_counter() - begin < 60
