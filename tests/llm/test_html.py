"""Main texts: odd markup, repeats over whole hosts, and a plain search for repeated runs."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.llm import html
from factlake.llm.html import blocks, extract, main_texts, op4_main_text, repeated_tokens

LAST = "the last paragraph of this page"


@pytest.mark.parametrize(
    "part",
    [
        '<section id="related-work"><p>kept text</p></section>',
        '<div class="side-by-side"><p>kept text</p></div>',
        '<p class="commentary">kept text</p>',
        '<section id="legal-aspects">kept text</section>',
        '<p id="promontory">kept text</p>',
        '<h2 id="search-algorithms">kept text</h2>',
        '<h2 class="comments">kept text</h2>',
        '<div class="share-price">kept text</div>',
    ],
)
def test_names_do_not_drop_parts_of_an_article(part):
    assert blocks(f"<article>{part}<p>{LAST}</article>") == ["kept text", LAST]


@pytest.mark.parametrize(
    "part",
    ['<div class="ad-slot-3">x</div>', '<div id="comments">x</div>', '<ul class="share-buttons"><li>x</ul>', '<div class="relatedPosts">x</div>', '<p class="ad">x</p>', '<div role="navigation">x</div>', "<form>x<input></form>", '<section class="reader-comments"><article>x</article></section>', '<div id="site-footer">x</div>', '<div class="cookie-notice">x</div>'],
)
def test_what_is_no_main_text_goes(part):
    assert blocks(f"<article><p>{LAST}</p>{part}</article>") == [LAST]
    assert blocks(f"{part}<article><p>{LAST}</p></article>") == [LAST]


LONG = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content-sidebar-wrap"><main><p>{}</p></main></div>',
        '<div class="site-content sidebar-right"><article><p>{}</p></article><div class="sidebar">menu</div></div>',
        '<div id="page" class="left-sidebar"><div><p>{}</p></div></div>',
        '<div class="left-sidebar"><article>{}</article><div id="comments">said said said said said</div></div>',
        '<nav><a href="/">Home</a> <a href="/b">Other</a><div class="post"><p>{}</p></div>',
        '<header><a href="/">Home</a><div><p>{}</p></div><footer>all rights</footer>',
        '<div class="post">{}</div><section id="comments"><article>' + "said " * 300 + "</article></section>",
        '<div class="widget-area"><section><main><div class="sidebar-content">{}</div></main></section></div>',
    ],
)
def test_layout_names_and_unclosed_elements_lose_no_page(page):
    assert blocks(page.format(LONG)) == [LONG]


@pytest.mark.parametrize("part", ['<section id="login">{}</section>', '<section id="consent"><h2>Consent</h2>{}</section>', '<div id="copyright">{}</div>', '<section id="promotion">{}</section>', '<section class="news-alert">{}</section>', "<aside>{}</aside>"])
def test_prose_in_an_article_stays_whatever_its_name(part):
    kept = [b for b in blocks(f"<article><p>{LAST}</p>{part.format(LONG)}</article>") if b != "Consent"]
    assert kept == [LAST, LONG]
    assert LONG not in blocks(f"<article><p>{LAST}</p></article>{part.format(LONG)}")  # not beside it
    linked = " ".join(f'<a href="/{k}">word{k} word</a>' for k in range(30))
    assert blocks(f"<article><p>{LAST}</p>{part.format(linked)}</article>") == [LAST]


def test_readers_words_go_at_any_length():
    for part in ('<div class="feedback">{}</div>', '<section class="comment-thread">{}</section>', '<div id="respond">{}</div>'):
        assert blocks(f"<article><p>{LAST}</p>{part.format(LONG)}</article>") == [LAST]


def test_the_host_judges_doubtful_parts(spark):
    """A named part of articles goes where many pages of the host repeat it, and stays where it is a page's own."""
    offer = " ".join(f"offer{i}" for i in range(30))
    rng = random.Random(30)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for k in range(20):
        own, part = fresh(40), offer if k % 2 else fresh(30)
        rows.append((k, "http://h.example/", f'<article><p>{own}</p><aside>{part}</aside></article>'))
        want[k] = own if k % 2 else f"{own}\n{part}"
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_forms_and_teasers_do_not_replace_the_text():
    long = "word " * 60
    assert blocks(f"<body><form><p>{long}</p><label>l</label><button>go</button></form></body>") == [long.strip()]
    assert blocks(f"<body><div id=content><h1>T</h1><p>{long}</p></div><article>teaser</article></body>") == ["T", long.strip()]
    assert blocks(f"<body><article>teaser</article><p>{long * 3}</p></body>") == ["teaser", (long * 3).strip()]


def _naive(pages, least_pages, share, span=html.SPAN):
    """Tokens that a run of span tokens covers which stands on enough pages, by plain search."""
    holds = lambda p, run: any(p[i : i + span] == run for i in range(len(p) - span + 1))
    out = []
    for p in pages:
        gone = [False] * len(p)
        for i in range(len(p) - span + 1):
            n = sum(holds(q, p[i : i + span]) for q in pages)
            if n >= least_pages and n >= share * len(pages):
                gone[i : i + span] = [True] * span
        out.append(gone)
    return out


def test_repeated_tokens_match_a_plain_search():
    rng = random.Random(20)
    shared = [[rng.choice("abcd") for _ in range(n)] for n in (8, 12, 30)]
    pages = []
    for _ in range(12):
        page = [f"u{rng.randrange(10**6)}" for _ in range(15)]
        for run in shared:
            if rng.random() < 0.7:
                at = rng.randrange(len(page))
                page[at:at] = run
        pages.append(page)
    pages += [[], ["one"], shared[0]]
    for share in (0.2, 0.6):
        got = repeated_tokens(pages, 5, share)
        assert [g.tolist() for g in got] == _naive(pages, 5, share)


def _host(rng, n):
    fresh = lambda k: " ".join(f"u{rng.randrange(10**6)}" for _ in range(k))
    notice, bio, quote = (" ".join(f"{x}{i}" for i in range(14)) for x in ("notice", "bio", "quote"))
    rows, want = [], []
    for k in range(n):
        own = [fresh(20), fresh(12)]
        in_article = k % 2 == 0
        parts = [own[0], notice] + ([bio] if k % 3 == 0 else []) + ([quote] if k % 10 == 0 else []) + [own[1]]
        page = "".join(f"<p>{p}</p>" for p in parts)
        rows.append((f"<article>{page}</article>" if in_article else page))
        want.append("\n".join(p for p in parts if p != notice and (p != bio or in_article)))
    return rows, want


@pytest.mark.parametrize(("chunk", "tokens"), [(256, 1 << 20), (9, 1 << 20), (256, 900), (3, 1 << 20), (1, 1 << 20)])
def test_repeats_are_counted_over_the_whole_host(spark, monkeypatch, chunk, tokens):
    monkeypatch.setattr(html, "CHUNK", chunk)
    monkeypatch.setattr(html, "CHUNK_TOKENS", tokens)
    pages, want = _host(random.Random(21), 60)
    rows = [(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)]
    rows += [(100 + k, "http://h.example/copy", pages[1]) for k in range(80)]  # copies are one page
    want = {**dict(enumerate(want)), **{100 + k: want[1] for k in range(80)}}
    for parts in (1, 5):
        d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts, F.rand(3))
        assert {r.page_id: r.text for r in extract(d).collect()} == want


def test_near_copies_of_an_article_stay_whole(spark):
    rng = random.Random(22)
    article = " ".join(f"w{i}" for i in range(60))
    pages = [f"<article><p>{article} v{k}</p></article>" for k in range(8)] + [f"<article><p>own {rng.random()}</p></article>" for _ in range(2)]
    rows = [(k, "http://h.example/", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{article} v{k}" for k in range(8))


def test_pages_without_distinct_repeats_keep_all():
    assert main_texts([]) == [] and main_texts([["a b"]] * 9) == ["a b"] * 9


def test_op4_of_the_given_pages(spark, sf_dir):
    rows = op4_main_text(spark, sf_dir).collect()
    html_of = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(html_of)
    for r in rows:
        assert r.text == "\n".join(blocks(html_of[r.page_id])) and r.n_chars == len(r.text)
        assert html_of[r.page_id].count("<article>") != 1 or r.text
