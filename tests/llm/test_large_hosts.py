"""Pages of hosts of more than one suffix array."""

import random
import time
from html.parser import HTMLParser

import pyarrow as pa

from breathmark.llm import html_extract


def test_repeats_are_found_on_a_whole_large_host(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    own = [words(20) for _ in range(700)]
    pairs, seven = [words(12) for _ in range(9)], words(7)  # pages i and 600 + i share one
    rows = []
    for i, text in enumerate(own):
        extra = f"<div>{pairs[i % 600]}</div>" if i % 600 < 9 else f"<div>{seven}</div>" if i % 100 == 0 else ""
        rows.append((i, f"http://large.example/{i}", f"<div>{text}</div>{extra}"))
    rows += [(1000, "http://other.example/", f"<div>{own[30]}</div>"), (1001, "http://large.example/x", f"<article>a</article><div>{own[9]}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    on_host = [html_extract.parse(h) for _, u, h in rows if "large" in u]
    outside = [p.settled(False) for p in on_host]
    want = ["\n\n".join(k) for k in html_extract.strip_repeats([[(t, True, True) for t in own] for own in outside])]
    assert [got[i] for i in range(700)] == want[:700]
    assert all(got[i] == own[i] for i in range(700) if i % 600 < 9) and got[9] == "" and got[30] == own[30] == got[1000] and got[1001] == "a"
    assert seven in got[100]


class Plain(HTMLParser):
    """Blocks of a well-formed page by a plain walk: (text, inside an article or main element)."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], ""
        self.feed(source)
        self.close()
        self.end()

    def end(self):
        if self.now.split():
            self.blocks.append((" ".join(self.now.split()), any(k in ("article", "main") for k, _ in self.stack)))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag != "b":
            self.end()
        out = tag in ("nav", "footer", "script", "style") or dict(attrs).get("class") in ("ad", "comments", "sidebar")
        self.stack.append((tag, out))

    def handle_endtag(self, tag):
        if tag != "b":
            self.end()
        self.stack.pop()

    def handle_data(self, data):
        if not any(out for _, out in self.stack):
            self.now += data


def plain_extract(rows):
    """Brute force of extract_pages over well-formed pages."""
    pages = [(i, u.split("/")[2], Plain(h).blocks) for i, u, h in rows]
    grams = {}
    outside = {i: [t for t, inside in blocks if not inside] for i, _, blocks in pages}
    for i, name, _ in pages:
        tokens = " ".join(outside[i]).split()
        for j in range(len(tokens) - 7):
            grams.setdefault((name, *tokens[j : j + 8]), set()).add(i)
    out = {}
    for i, name, blocks in pages:
        kept = [t for t, inside in blocks if inside]
        if not kept:
            tokens = " ".join(outside[i]).split()
            covered = [any(len(grams[(name, *tokens[j : j + 8])]) > 1 for j in range(max(0, k - 7), min(k, len(tokens) - 8) + 1)) for k in range(len(tokens))]
            for t in outside[i]:
                own, covered = covered[: len(t.split())], covered[len(t.split()) :]
                if 2 * sum(own) < len(own):
                    kept.append(t)
        out[i] = "\n\n".join(kept)
    return out


def test_extraction_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["amp &amp; x", "a<b>b</b>c", "&eacute;t&#233;", *("w%d" % rng.randrange(400) for _ in range(12))])
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(6, 20)) for _ in range(30)]
    wrap = ["<nav><p>{}</p></nav>", "<div class='ad'>{}</div>", "<footer>{}</footer>", "<div>{}</div>", "<p>{}</p>", "<section class='no-sidebar'>{}</section>", "<script>{}</script>"]
    rows = []
    for i in range(160):
        parts = [rng.choice(wrap).format(rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(1, 25))) for _ in range(rng.randint(0, 8))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), f"<article class='{rng.choice(['post no-sidebar', 'ad-free', 'x'])}'><h1>{text(3)}</h1><p>{text(20)}</p><div class='comments'>{text(5)}</div></article>")
        rows.append((i, f"http://{'large' if i % 4 else 'small'}.example/{i}", "<html><body>" + "".join(parts) + "</body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain_extract(rows)
    for most in (256, 10):
        html_extract.GROUP = most
        try:
            got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()}
        finally:
            html_extract.GROUP = 256
        assert got == {i: (t, len(t)) for i, t in want.items()}


def test_main_elements_are_not_judged_by_parts_of_names():
    kept = lambda h: html_extract.parse(h).main
    for element in ('article class="post no-sidebar"', 'main id="search"', 'article class="ad-free"', 'article id="post-comments-enabled"'):
        assert kept(f"<{element}><p>own text</p></{element.split()[0]}>") == ["own text"]
    assert kept('<div class="page search-results"><main><p>own text</p></main></div>') == ["own text"]
    whole = html_extract.parse('<div class="page search-results"><p>own text</p></div>')
    assert whole.main == [] and whole.settled(False) == ["own text"]
    bar = '<div class="share-bar"><a href="">share</a> <a href="">tell</a></div><div class="related-posts">see <a href="">x and more</a></div>'
    assert kept(f"<article><p>long own text</p>{bar}</article>") == ["long own text"]
    talk = '<div class="comments-area"><p>c</p><div class="comment">d</div><div class="user-comment">e</div></div>'
    assert kept(f'<article>a{talk}</article><article class="comment">c</article>') == ["a"]
    assert kept('<body class="has-sidebar search"><article>a<div hidden>h</div></article>') == ["a"]


def test_time_grows_with_the_page():
    began = time.monotonic()
    for page in ("<div>" * 100_000 + "</span>" * 100_000, "<b>" * 50_000 + "<p>x</p>" * 50_000, "<b>" + "<div>" * 30_000 + "<nav>" + "</b>" * 70_000,
                 "<div>" * 30_000 + "<nav><article>a</article>" * 30_000, "<i>" * 50_000 + "</i>" * 50_000):
        html_extract.parse(page)
    assert time.monotonic() - began < 25


def test_names_alone_do_not_drop_text():
    """Names of which a part is a mark, or that tell a topic, where neither structure nor repeats agree."""
    kept = lambda inner: html_extract.parse(f"<body><article><p>much other text of the article</p>{inner}</article></body>").main[1:]
    assert kept('<section class="related-work"><h2>Related work</h2><p>Others did <a href="x">this</a> before.</p></section>') == ["Related work", "Others did this before."]
    assert kept('<div class="share-price-table">1 2 3</div><p class="form-factor">small</p>') == ["1 2 3", "small"]
    assert kept('<div class="cookies">flour, sugar</div>') == ["flour, sugar"]
    assert kept('<div class="royal-reply">The king said more than all the text of the article around it, by far.</div><p class="respond-well">so</p>')[1:] == ["so"]
    assert kept('<p data-hidden>seen</p><p data-x="a hidden b">too</p><p hidden>not</p><p HIDDEN="">not</p><p title=hidden>also</p>') == ["seen", "too", "also"]
    assert kept("<style>a{}</style x><p>after</p><script>b</script\n/><p>end</p><script>c</scripty></script >last") == ["after", "end", "last"]
    assert kept("<p>so <math><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup><annotation>a=b^2</annotation></math> holds</p>") == ["so a=b2 holds"]
    # Where structure agrees they go.
    assert kept('<div class="newsletter-box">Stay tuned <input type="email"></div><div class="cookies">We use them <button>Fine</button></div><div role="search">q</div>') == []
    assert kept('<div class="ad">buy</div><div class="related"><ul><li><a href="">one</a></li><li><a href="">two</a></li></ul></div>') == []
    # A name around a main element says nothing of it.
    assert html_extract.parse('<div class="search-page"><input><article>own</article></div>').main == ["own"]


def test_doubtful_blocks_of_articles_go_where_the_host_repeats_them(spark):
    notice = "we may earn a small part of what you pay for things that you buy here"
    page = lambda i: f'<article><p>own text of page {i}</p><div class="price-disclaimer">{notice}</div><div class="share-price">price {i} up again this week they say here</div></article><div>x</div>'
    rows = [(i, "http://a.example/", page(i)) for i in range(5)] + [(9, "http://b.example/", page(9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (256, 2):
        html_extract.GROUP = most
        try:
            got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
        finally:
            html_extract.GROUP = 256
        assert "pay for" in got[9] and all("pay for" not in got[i] for i in range(5)), got
        assert all(got[i].startswith(f"own text of page {i}\n\n") or got[i] == f"own text of page {i}" for i in range(5))


def test_long_tags_take_time_in_proportion():
    began = time.monotonic()
    for tag in ("a-" * 500_000, "a" * 1_000_000, "a = " * 250_000, "class='" + "share-" * 160_000 + "'", "a='b' " * 160_000, "=" * 1_000_000, "/ " * 500_000):
        assert html_extract.parse(f"<article><div {tag}>kept</div></article>").main == ["kept"]
    assert time.monotonic() - began < 7
    began = time.monotonic()
    for page in ("<a \"" * 50_000, "<a '\"" * 50_000, "<style>" + "</style" * 100_000, "<div class='share-x'>t" * 50_000):
        html_extract.parse(page)
    assert time.monotonic() - began < 20


def test_sorted_suffixes_by_brute_force():
    """Suffixes of equal runs that batches cut come out as edges; within batches only those that two pages have."""
    rng = random.Random(5)
    for size in (1, 3, 7, 50, 1000):
        rows = sorted((f"h{rng.randrange(2)}", f"r{rng.randrange(40)}", rng.randrange(9), i) for i in range(300))
        names, kinds = ["_host", "_run", "_row", "_at", "_bare"], [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
        columns = [*zip(*rows, strict=True), [True] * len(rows)]
        table = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        out = [r for b in html_extract.sorted_repeats(table.slice(k, size) for k in range(0, 300, size)) for r in b.to_pylist()]
        pages, edges = {}, {}
        for host, run, row, _ in rows:
            pages.setdefault((host, run), set()).add(row)
        for r in out:
            if r["_edge"]:
                edges.setdefault((r["_host"], r["_run"]), set()).add(r["_at_row"])
        got = {r["_at"] for r in out if not r["_edge"] or len(edges[r["_host"], r["_run"]]) > 1}
        assert got == {at for host, run, _, at in rows if len(pages[host, run]) > 1}


def test_a_run_on_all_pages_of_a_large_host_is_found_over_batches(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "GROUP", 20)
    bar = "one two three four five six seven eight"
    rows = [(i, "http://a.example/", f"<div>{bar}</div><div>own{i} words{i}</div>") for i in range(90)] + [(90, "http://b.example/", f"<div>{bar}</div>")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 16)
        got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {i: f"own{i} words{i}" for i in range(90)} | {90: bar}
