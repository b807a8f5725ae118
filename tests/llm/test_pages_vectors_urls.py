"""Page text, nearest neighbours and URL filters against brute force over small tricky tables."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadwatch.llm import op7_main_text as op7
from threadwatch.llm import op8_ann as op8
from threadwatch.llm import op10_url_filters as op10

# --- page text -------------------------------------------------------------------------

STORY = ("The council met on Tuesday to discuss the new bridge over the river.",
         "After four hours of debate, the members agreed to ask for more drawings &amp; plans.",
         "Work may begin next year if the money can be found, said the mayor.")
FRAME = """<!doctype html><html><head><title>Site | story</title><style>p{{x:y}}</style><script>var a = "<p>no</p>";</script></head>
<body><header class="masthead"><h1>The Daily</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/s">Sport news</a></ul></nav>
<div class="cookie-banner">We use cookies so that this site works as well as it can for you, please agree.</div>
{body}
<div id="sidebar"><p>Also read this other very interesting story about the weather of the past week.</p></div>
<section class="comments"><h3>Comments</h3><p>I have never read anything as good as this story about a bridge.</p></section>
<form action="/s"><p>Write to us about anything that you like here.</p><button>Send the letter</button></form>
<footer><p>&copy; The Daily and all of its many owners, 1999 to 2024.</p></footer></body></html>"""


@pytest.mark.parametrize("body", [
    "<article><h2>A new bridge</h2><p>{}</p><div class='ad-slot'>Buy a boat today, it is much cheaper than a bridge.</div>"
    "<p>{}</p><p>{}</p></article>",
    "<div id=content><h2>A new bridge</h2><p>{}<p>{}<p>{}</div>",
    "<main><h2>A <b>new</b> bridge</h2><!-- <p>hidden</p> --><p>{}<p><i>{}</i><p>{}<p style='display:none'>Nobody sees "
    "this text of many words at all.</p></main>",
    "<div><div><h2>A new\n bridge</h2></div><div><p>{}</p><script>x()</script><p>{}</p><aside>More of our stories that you "
    "may like to read.</aside><p>{}</p></div></div>",
])
def test_main_text(body):
    expected = "\n\n".join(["A new bridge", *STORY]).replace("&amp;", "&")
    assert op7.main_text(FRAME.format(body=body.format(*STORY))) == expected


def test_odd_pages(spark):
    cases = {None: "", "": "", "<html></html>": "", "<p": "", "<article><p>Cut &am": "Cut &am", "<!-- <p>a</p>": "",
             "<article><p>5 < 6 and a&lt;b, x&nbsp;y, &#233;&eacute;.": "5 < 6 and a<b, x y, éé.",
             "<script>never closed <p>text</p>": "", "<article><p>a\n\t b<br>c</p></article>": "a b c",
             "<article>" + "<p>Some words that make a paragraph of text.</p>" * 3000:
                 "\n\n".join(["Some words that make a paragraph of text."] * 3000)}
    rows = [(n, f"u{n}", h, "x") for n, h in enumerate(cases)] + [(None, None, "<article><p>Text.</p>", "x")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = op7.extract_text(df).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for (n, _, h, _) in rows[:len(cases)]:
        assert by_id[n].text == cases[h], h
        assert by_id[n].n_chars == len(cases[h]) and by_id[n].url == f"u{n}"
    assert [r.text for r in got if r.page_id is None] == ["Text.", "Text."]
    assert op7.extract_text(df.limit(0)).count() == 0
    assert op7.extract_text(df, carry=("page_id", "html")).columns == ["page_id", "html", "text", "n_chars"]


def test_unclosed_and_self_closed_skipped_elements():
    story = "The council met on Monday and decided, after a long debate, to rebuild the old bridge."
    body = f"<article><p>{story}</p></article>"
    pages = [f"<html><head><title>t</title><body>{body}</html>", f"<head><meta charset=utf-8><title>t</title>{body}",
             f"<body><svg width='1' />{body}", f"<math/>{body}<math><mi>x</mi></math>", f"<svg/>{body}<svg><text>x</text></svg>",
             f"<svg><style/><title/></svg>{body}", f"<svg><title>x</svg>{body}", f"<button>{body}", f"<iframe src=a>{body}",
             f"<svg><svg><text>a</text></svg><text>b</text></svg>{body}", f"<svg data-x='a>b'/>{body}<svg></svg>",
             f"<video><article></video>{body}", f"<svg><div>{body}<script>var a = '<p>no</p>';</script>",
             f"<svg><title>x</title><path/></svg>{body}<title>late</title>"]
    for page in pages:
        assert op7.main_text(page).endswith(story), page
        assert not op7.main_text(page).removesuffix(story).strip(" \nx"), page
    for page in (f"<script>{body}", f"<style>{body}", f"<textarea>{body}", f"<title>{body}", f"<svg>{body}</svg>",
                 f"<noscript>{body}</noscript>", f"<select><option>{body}</select>", f"<!-- {body}"):
        assert op7.main_text(page) == "", page
    hidden = "Send this form to all of your friends, and they will surely thank you for it."
    skipped = ["noscript", "template", "svg", "iframe", "object", "math", "canvas", "select", "button", "audio", "video"]
    for name in skipped:
        inner = [f"<{name}><p>{hidden}</p></{name}>", f"<{name} class='x'>{hidden}</{name}>",
                 f"<form><p><{name}>{hidden}</{name}></p></form>", f"<div><{name}><{name}>{hidden}</{name}>{hidden}</{name}></div>",
                 f"<ul><li><{name}>{hidden}</{name}</li></ul></{name}>"]
        for part in inner:
            page = f"<html><body><main><article><h2>Bridge</h2><p>{story}</p>{part}<p>{story}</p></article></main></body></html>"
            assert op7.main_text(page) == "\n\n".join(["Bridge", story, story]), part
        page = f"<article><p>{story}</p><p>{story}</p><{name}><p>{story}</p></article>"  # never ends: the page goes on
        assert op7.main_text(page).count(story) == 3, name
    assert len(op7.main_text("<svg><title>" * 20_000 + body + "<button>" * 20_000)) >= len(story)


def test_source_side_is_a_minimum_cut():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        source_cap, sink_cap = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        ties = [(a, b, rng.randint(1, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        flow = op7.Flow(n + 2)
        for i in range(n):
            flow.tie(n, i, source_cap[i])
            flow.tie(i, n + 1, sink_cap[i])
        for a, b, c in ties:
            flow.tie(a, b, c, c)

        def cost(side):
            return sum(sink_cap[i] if side[i] else source_cap[i] for i in range(n)) + \
                sum(c for a, b, c in ties if side[a] != side[b])

        assert cost(flow.source_side(n, n + 1)) == min(cost(s) for s in itertools.product([False, True], repeat=n))


# --- nearest neighbours ----------------------------------------------------------------

def nearest_brute_force(rows, k):
    good = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v) and any(v))]
    out = []
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-float((x * v).sum()), i) for i, v in good if i != q and len(v) == len(x))[:k]
            out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(best)]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 24))
    rows = [(i, (centres[i % 5] + 0.7 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[40][1]) for i in range(800, 960)]  # one very common vector
    rows += [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [float("inf")] + [1.0] * 23),
             (1080, [None] + [1.0] * 23), (None, [1.0] * 24), (1100, [1.0, 2.0]), (1101, [3.0, 1.0]), (20, rows[20][1]), (1120, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("dim", F.lit("x"))
    got = [tuple(r) for r in op8.nearest(df).collect()]
    exp = nearest_brute_force(rows, 20)
    assert {g[0] for g in got} == {e[0] for e in exp}
    near = {(q, i) for q, _, i, _ in exp}
    assert len(near & {(q, i) for q, _, i, _ in got}) >= 0.97 * len(near) and len(got) == len(exp)
    common = [e for e in exp if e[0] in (800, 820, 1100)]
    assert [(q, r, i, round(s, 9)) for q, r, i, s in sorted(got) if q in (800, 820, 1100)] == common
    assert op8.nearest(df.limit(0)).count() == 0


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(2)
    x, q, centre = rng.normal(size=(2000, 96)), rng.normal(size=(20, 96)), rng.normal(size=96) * 0.1
    value, bound = op8.estimates(q, centre, *op8.encode(x, centre), 3.0)
    off = np.abs(value - q @ x.T)
    assert (off <= bound).mean() > 0.995 and abs((value - q @ x.T).mean()) < 0.05


# --- URL filters -----------------------------------------------------------------------

def judged(url, rules=op10.HOST_RULES, patterns=op10.BLOCK_PATTERNS):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fitting = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = (url or "").translate({i: i + 32 for i in range(65, 91)})
    if fitting:
        _, rule, verdict = max(fitting)
        return host, path, rule, verdict
    bad = any(re.fullmatch(".*".join(map(re.escape, p.split("*"))), low, re.DOTALL) for p in patterns)
    return host, path, None, "block" if bad else "allow"


URLS = [None, "", "no scheme", "://", "http://", "http://NET/", "https://a.example.NET/en/1", "http://example.net/en", "x://net",
        "http://example.com/de/", "http://sub.example.com/de/x?y#z", "http://notexample.com/de/1", "http://a.org/fr/1", "http://org/fr/",
        "http://spam-farm.example.org/en/1", "HTTP://WWW.Spam-Farm.org/x", "http://a.org/Casino/1", "http://a.org/casinos/1",
        "http://a.org/x?affid=3", "http://a.org/x#?affid=3", "http://a.org?b://c.net/d", "ftp://u:p@h.org:80/fr/x", "http://é.org/fr/ü\n",
        "http://x.cheap-pills.org/", "http://mycheap-pills.example/"]


def test_urls(spark):
    df = spark.createDataFrame([(n, u, "x") for n, u in enumerate(URLS)] + [(None, URLS[6], "y")] * 2,
                               "page_id long, url string, host string")
    got = op10.judge_urls(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        u = URLS[r.page_id] if r.page_id is not None else URLS[6]
        assert (r.host, r.path, r.rule, r.verdict) == judged(u), u
    assert op10.judge_urls(df.limit(0)).count() == 0


def test_index_finds_what_running_every_rule_finds(spark):
    rng = random.Random(7)
    tokens = ["aa", "bb", "cc", "dd1", "a", "b"]
    urls = ["http://" + "".join(rng.choice(tokens) + rng.choice(["/", ".", "-", "?", "_", ""]) for _ in range(6)) for _ in range(300)]
    patterns = ["".join(rng.choice([*tokens, "*", "/", ".", "-"]) for _ in range(rng.randint(2, 5))) for _ in range(40)]
    patterns = ["*" + p + "*" for p in patterns] + ["*"[:0] + "http://aa/*", "*bb"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in op10.judge_urls(df, patterns=patterns, host_rules=[]).collect():
        assert r.verdict == judged(urls[r.page_id], [], patterns)[3]


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([(1, "http://common.rare.x/"), (2, "http://common.x/"), (3, "http://common.y/")], "page_id long, url string")
    rules = [op10.pattern_rule("*.rare.*"), op10.pattern_rule("*/common.rare.*"), op10.pattern_rule("*oo*")]
    index = op10.rarest_tokens(df, rules, "url")
    assert {t: [r.pattern for r in rs] for t, rs in index.items()} == {"rare": ["*.rare.*", "*/common.rare.*"], "": ["*oo*"]}
