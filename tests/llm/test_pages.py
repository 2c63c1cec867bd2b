"""Main text of pages, and urls judged."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagelore.llm.html_blocks import main_text
from pagelore.llm.html_text import extract_pages
from pagelore.llm.url_filter import Rule, judge_urls, longest_rule, split_url

LONG = "The first thing that is said of it is that it was on the way to the house when they had not been there. " * 3
LONG = LONG.strip()
NEXT = "It was in this house that he had been with them for all of the days which were left to her and to us."

PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{ }}</style><script>var t = "</p><p>{LONG}</p>";</script></head>
<body class="home"><header><a href="/">Site</a> The name of the site</header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>{LONG}</p></div>
<article class="post"><h1>A title &amp; more</h1><p>{LONG}
   over&nbsp;two lines</p><p>Short.</p><form><label>Name</label><input><textarea>{LONG}</textarea></form>
<ul><li>An item<li>Another</ul><div class="ad">Buy now</div><p>{NEXT} <a href="/x">with a link</a></p><p>End &#8211; caf&eacute;</p>
<section id="comments"><article class="comment"><p>{LONG}</p></article></section></article>
<aside>{LONG}</aside><footer>&copy; somebody</footer><!-- <p>{LONG}</p> --></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE).split("\n") == [
        "A title & more",
        f"{LONG} over two lines",
        "Short.",
        "An item",
        "Another",
        f"{NEXT} with a link",
        "End – café",
    ]


def test_without_an_article_element():
    page = f"<div><h2>Heading</h2><p>{LONG}</p><p>Short</p><p>{NEXT}</p></div><div><a href=x>More</a> <a href=y>Less</a></div>"
    assert main_text(page).split("\n") == ["Heading", LONG, "Short", NEXT]


def test_broken_pages():
    assert main_text("") == main_text("<p>") == main_text("<!-- " + LONG) == main_text("<script>" + LONG) == ""
    assert main_text(f"<article><p><b>{LONG}<p>{NEXT}") == f"{LONG}\n{NEXT}"
    assert main_text(f"<div class=ad>x<article><p>{LONG}</p></article>") == LONG
    assert main_text("<article>" + "<div" * 20_000 + f'><p title="a > b">{LONG}') == LONG
    assert len(main_text(f"<article><p>{LONG * 2000}</p></article>")) == 2000 * len(LONG)
    assert main_text('<article><p>a < b &amp c &lt;p&gt;</p></article>') == "a < b & c <p>"


def test_attribute_values_of_any_length():
    for size in (10, 5000, 200_000):
        value = "a > b <div class='ad'><p>" + "x" * size + "</div></article> > c"
        assert main_text(f'<article><div data-x="{value}"><p>{LONG}</p><p title= "{value}">{NEXT}</p></div></article>') == f"{LONG}\n{NEXT}"
    assert main_text(f'<article><p title="a>{LONG}</p><p>{NEXT}</p></article>') == f"{LONG}\n{NEXT}"
    assert main_text(f"<article><p don't>{LONG}</p><p>It's {NEXT}</p></article>") == f"{LONG}\nIt's {NEXT}"
    assert main_text(f"<article><p>{LONG}" + '<a x=">"' * 50_000) == LONG


def test_nothing_but_sides_and_links_is_dropped():
    nav, foot = '<nav><a href="/">Home</a> Menu</nav>', "<footer>All of the rights of it</footer>"
    assert main_text("<body><p>One short sentence.</p></body>") == "One short sentence."
    short = "".join(f"<div>Line number {i} of it.</div>" for i in range(5))
    assert main_text(f"<body>{nav}{short}{foot}</body>").split("\n") == [f"Line number {i} of it." for i in range(5)]
    code = "for (int i = 0; i < n; ++i) { total += values[i] * weights[i]; counts[i]++; } return total;"
    page = f"<body>{nav}<div><p>{LONG}</p><pre>{code.replace('<', '&lt;')}</pre><p>{NEXT}</p></div>{foot}</body>"
    assert main_text(page).split("\n") == [LONG, code, NEXT]
    chinese = "这是一篇关于城市历史的文章，内容很长。" * 5
    finnish = "Kaupungin historia ulottuu keskiajalle, jolloin ensimmäiset asukkaat rakensivat talonsa joen varrelle."
    for text in (chinese, finnish):
        links = "<div><a href=x>Aa</a> <a href=y>Bb</a></div>"
        page = f"<body>{nav}{links}<div><p>{text}</p></div>{links}<p>{text}</p>{foot}</body>"
        assert main_text(page).split("\n") == [text, text]
    page = f"<body>{nav}<div><p>{LONG}</p><p>{NEXT}</p></div><div><a href=x>Aa</a></div><p>{chinese}</p></body>"
    assert main_text(page).split("\n") == [LONG, NEXT, chinese]


def test_pages_as_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = extract_pages(frame).collect()
    assert sorted(((r.page_id, r.n_chars) for r in got), key=str) == sorted(
        [(1, len(main_text(PAGE)))] * 2 + [(2, 0), (None, 0)], key=str
    )
    assert extract_pages(frame.limit(0)).collect() == []


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
)


def test_rules(spark):
    want = {
        "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "https://b.www.example.com/en/?q=://": ("b.www.example.com", "/en/", "www.example.com/en/"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "http://com/": ("com", "/", "com/"),
        "http://x.com": ("x.com", "", None),
        "http://x.com?a/b": ("x.com", "", None),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/"),
        "http://x.net/ES/1": ("x.net", "/ES/1", None),
        "no scheme.com/": ("", "", None),
        "://": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "x://ÄB.com/é\n/": ("Äb.com", "/é\n/", "com/"),
    }
    frame = spark.createDataFrame([(u,) for u in want], "url string")
    host, path = split_url(F.col("url"))
    for url, *got in frame.select("url", host, path, longest_rule(host, path, RULES)["rule"]).collect():
        assert tuple(got) == want[url], url


def test_urls_without_a_rule_are_judged_by_the_models(spark):
    rows = [(i, f"http://site{i % 50}.com/article/{i}/") for i in range(300)]
    rows += [(1000 + i, f"http://spam{i % 50}.net/es/casino-win-{i}") for i in range(300)]
    open_ = [(5001, "http://site7.org/article/77/"), (5002, "http://spam3.org/casino-win-9"), (5003, None), (5001, "http://site7.org/article/77/")]
    frame = spark.createDataFrame([(*r, "c") for r in rows + open_], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge_urls(frame, RULES).collect()}
    assert len(got) == 603
    assert (got[5001].verdict, got[5001].rule, got[5002].verdict) == ("allow", None, "block")
    assert got[5003].score == 0.0 and got[5003].host == ""
    assert all(got[i].verdict == "allow" for i in range(300)) and all(got[1000 + i].verdict == "block" for i in range(300))
    assert judge_urls(frame.limit(0), RULES).collect() == []
    only = judge_urls(frame.where("page_id >= 1000"), RULES)
    assert {r.verdict for r in only.collect()} == {"block"}


def test_repeated_urls_leave_the_models_alone(spark):
    """A thousand copies of two urls a class, and one url copied far more often than others differ."""
    urls = [f"https://a.com/read/{i % 2}/story" for i in range(1000)] + [f"https://b.net/es/buy/{i % 2}/casino" for i in range(1000)]
    open_urls = ["https://c.org/read/7/story", "https://c.org/es/buy/9/casino"]
    for most in (20, 10_000):
        frame = spark.createDataFrame(list(enumerate(urls + open_urls)), "page_id long, url string")
        got = {r.page_id: r for r in judge_urls(frame, RULES, sample_urls=most).where("rule is null").collect()}
        assert [got[2000].verdict, got[2001].verdict] == ["allow", "block"]
        assert got[2000].score > 0 > got[2001].score
    varied = [f"https://a.com/read/{i}/story-{i * i}" for i in range(200)] + ["https://a.com/hot"] * 5000
    varied += [f"https://b.net/es/buy/{i}/casino" for i in range(200)]
    frame = spark.createDataFrame(list(enumerate(varied + open_urls)), "page_id long, url string")
    got = judge_urls(frame, RULES, sample_urls=50).where("rule is null").orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["allow", "block"]


def test_threshold_is_the_best_on_urls_kept_out(spark):
    """Scores and threshold against dictionaries of byte contexts, and every threshold tried."""
    from test_language import plain_bits

    import test_language

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    urls = [f"https://a.com/{word()}/{word()}" for _ in range(60)] + [f"https://b.net/es/{word()}x{word()}" for _ in range(60)]
    urls += [f"https://c.org/{word()}{rng.choice('/x')}{word()}" for _ in range(40)]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    hashes = {r.url: r.h for r in frame.select("url", F.xxhash64("url").alias("h")).collect()}
    got = judge_urls(frame, RULES, order=test_language.ORDER).collect()
    known = {v: sorted({urls[r.page_id] for r in got if r.rule and r.verdict == v}) for v in ("allow", "block")}
    out = {v: [u for u in us if hashes[u] % 5 == 0] for v, us in known.items()}
    taught = {v: [u.encode() for u in us if hashes[u] % 5] for v, us in known.items()}

    def score(url):
        good, bad = (plain_bits(taught[v], url.encode()) for v in ("allow", "block"))
        return (bad - good) / len(url)

    assert all(abs(score(urls[r.page_id]) - r.score) < 1e-4 for r in got)
    good, bad = ([score(u) for u in out[v]] for v in ("allow", "block"))
    rates = lambda t: sum(g >= t for g in good) / len(good) + sum(b < t for b in bad) / len(bad)
    judged = [(r.score, r.verdict) for r in got if r.rule is None]
    most_blocked = max([s for s, v in judged if v == "block"], default=-9)
    least_allowed = min([s for s, v in judged if v == "allow"], default=9)
    assert most_blocked < least_allowed
    between = sorted({*good, *bad, 0.0, most_blocked, least_allowed})
    tried = [t for t in (*between, *((a + b) / 2 for a, b in zip(between, between[1:]))) if most_blocked < t <= least_allowed]
    best = max(rates(t) for t in (min(between) - 1, *between, *((a + b) / 2 for a, b in zip(between, between[1:])), max(between) + 1))
    assert max(map(rates, tried)) == best


PROSE = f"<p>{LONG}</p><p>Short one.</p><p>{NEXT}</p>"
WHOLE = [LONG, "Short one.", NEXT]


@pytest.mark.parametrize(
    "opening",
    [
        '<div class="content with-sidebar">', '<main class="page has-sidebar">', '<article id="form-1">', '<article data-id="notice">',
        '<div id="wrapper" class="sidebar-right">', '<div class="no-comments">', '<article class="post has-comments">',
        '<div class="social-page">', '<section class="legal-text">', '<div data-hidden="no" data-class="ad">', '<div class="widget">',
    ],
)
def test_names_are_evidence_for_blocks(opening):
    tag = re.match("<([a-z]+)", opening)[1]
    page = f'<body><nav><a href="/">Home</a></nav>{opening}{PROSE}</{tag}><footer>{LONG}</footer></body>'
    assert main_text(page).split("\n") == WHOLE


@pytest.mark.parametrize(
    "extra",
    [
        '<p class="ad">Buy now.</p>', f"<div hidden>{PROSE}</div>", f'<div style="display: none">{PROSE}</div>',
        f'<div class="newsletter-signup"><p>{LONG}</p></div>', '<div class="share">Send it to a friend</div>', f'<p hidden>{LONG}</p>',
        f'<section class="comments"><p>{LONG}</p></section>', '<h3 class="related">Read this too</h3>', f"<aside>{LONG}</aside>",
    ],
)
def test_names_and_hidden_parts_within_an_article(extra):
    assert main_text(f"<article><p>{LONG}</p><p>Short one.</p>{extra}<p>{NEXT}</p></article>").split("\n") == WHOLE
    without = f'<div class="post"><p>{LONG}</p><p>Short one.</p>{extra}<p>{NEXT}</p></div>'
    if "newsletter" not in extra:
        assert main_text(without).split("\n") == WHOLE


def test_pages_without_an_article_element():
    """Density and neighbours decide: a short block goes with the nearest that is sure."""
    links = "".join(f'<li><a href="/{i}">A link of some words</a></li>' for i in range(5))
    page = (
        f"<body><div><ul>{links}</ul><div>Pick one of them</div></div>"
        f"<div><h2>The title</h2><p>{LONG}</p><p>Short.</p><p>{NEXT}</p></div>"
        f"<div><p>Elsewhere</p><ul>{links}</ul></div></body>"
    )
    assert main_text(page).split("\n") == ["The title", LONG, "Short.", NEXT]
    notice = f'<div class="cookie-notice"><p>We use cookies on this site, more of it here.</p></div>{page}'
    assert main_text(notice).split("\n") == ["The title", LONG, "Short.", NEXT]


def test_all_urls_that_rules_decide_are_learned_from(spark):
    """More urls than a sample held: models and threshold are those of all."""
    urls = [f"https://a.com/{i * 7919 % 10_007}/{i:x}" for i in range(13_000)] + [f"https://b.net/es/{i * i}" for i in range(60)]
    urls += [f"https://c.org/{i}/{i:x}" for i in range(50)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    everything, sampled = (
        {r.page_id: (r.verdict, r.score) for r in judge_urls(frame, RULES, sample_urls=most).collect()} for most in (1 << 20, 10_000)
    )
    got = {r.page_id: (r.verdict, r.score) for r in judge_urls(frame, RULES).collect()}
    assert all(got[i][0] == everything[i][0] and abs(got[i][1] - everything[i][1]) < 1e-9 for i in range(len(urls)))
    assert any(abs(got[i][1] - sampled[i][1]) > 1e-6 for i in range(len(urls)))
