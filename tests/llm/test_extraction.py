"""Main texts against pages whose article is known."""

import html
import random
import re
from collections import Counter, defaultdict

from statuslake.llm import extraction as ex

SCHEMA = "page_id bigint, url string, html string, host string, slot string, tokens int, members int, text string"


def frame(spark, pages):
    return spark.createDataFrame([(i, u, h, "h", "s", 1, 2, "t") for i, u, h in pages], SCHEMA).repartition(3)


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def article(page):
    """The blocks of an article that holds headings and paragraphs only."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " " if "br" in b else "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    out = ex.extract(pages)
    assert out.columns == ["page_id", "url", "text"]
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert texts(out) == want and out.count() == len(want)


def words(n, seed):
    return " ".join(random.Random(repr(seed)).choices(["alpha", "beta", "gamma", "delta", "eta", "théta", "iota"], k=n)).capitalize() + "."


def soup(i, host):
    """A page without telling names: nested divisions, a table of links, a repeated line in the article."""
    body = "".join(f"<div class=x{host}>{words(12, (i, k))} &amp; <i>more</i>&nbsp;{i}</div>" for k in range(1 + i % 4))
    links = "".join(f'<tr><td><a href="/{k}">{words(3, (i, k, "l"))}</a></td></tr>' for k in range(5 + i % 3))
    page = f"<html><body><div class=a><table>{links}</table></div><div class=b><h2>Title {i}</h2>{body}<div class=z>Sign up to read on</div></div><div class=c>Made by {host} {words(2, i)}</div></body></html>"
    blocks = [f"Title {i}", *(f"{words(12, (i, k))} & more {i}" for k in range(1 + i % 4))]
    return page, "\n".join(blocks)


def test_templates_without_names(spark):
    made = {(h, i): soup(i, h) for h in ("one", "two") for i in range(30)}
    pages = [(100 * (h == "two") + i, f"https://{h}.example/{i}", page) for (h, i), (page, _) in made.items()]
    got = texts(ex.extract(frame(spark, pages)))
    assert got == {100 * (h == "two") + i: text for (h, i), (_, text) in made.items()}


def named(i):
    body = f"<p>{words(20, i)}<p>{words(15, i + 1)}<ul><li>{words(3, i)}<li>{words(4, i)}</ul>"
    page = (
        f"<!doctype html><head><title>{words(3, i)}</title><script>if (a < b) document.write('<p>no</p>')</script><body class='has-sidebar'><header><a href=/>Home</a><h2>Site</h2></header>"
        f"<div id=cookie-notice>We use cookies {i}</div><main><article><h1>{words(4, i)}</h1><div class='adBox ad'>{words(5, i)}</div>{body}<form><label>Mail</label><input name=q><button>Go</button></form>"
        f"<aside>{words(9, i)}</aside><section class='comments'><article><p>{words(30, i + 3)}</p></article></section></article></main><div class=sidebar>{words(40, i)}</div><footer>&copy; {words(9, i)}</footer>"
    )
    return page, "\n".join([words(4, i), words(20, i), words(15, i + 1), words(3, i), words(4, i)])


def test_named_parts_and_single_pages(spark):
    made = [named(i) for i in range(12)]
    # one host with all, and a host for each; a page of another layout among them
    pages = [(i, "http://all.example/", p) for i, (p, _) in enumerate(made)] + [(100 + i, f"http://h{i}.example/", p) for i, (p, _) in enumerate(made)] + [(50, "http://all.example/x", "<div><p>Just this.</p></div>"), (51, None, made[3][0]), (52, "no url", made[4][0])]
    want = {i: t for i, (_, t) in enumerate(made)} | {100 + i: t for i, (_, t) in enumerate(made)} | {50: "Just this.", 51: made[3][1], 52: made[4][1]}
    assert texts(ex.extract(frame(spark, pages))) == want


def test_copies_and_shared_passages_stay(spark):
    page = "<body><nav>Menu</nav><article><h1>A</h1><p>Same text for all of us.</p></article></body>"
    other = "<body><nav>Menu</nav><article><h1>B</h1><p>Same text for all of us.</p></article></body>"
    pages = [(i, "http://copies.example/", page) for i in range(40)] + [(100 + i, f"http://few.example/{i}", (page, other)[i % 2]) for i in range(6)]
    got = texts(ex.extract(frame(spark, pages)))
    assert all(got[i] == "A\nSame text for all of us." for i in range(40))
    assert all(got[100 + i] == f"{'AB'[i % 2]}\nSame text for all of us." for i in range(6))


def test_broken_markup_and_edges(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 4000
    cases = {
        "": "", " \n ": "", "plain &lt;b&gt; text": "plain <b> text", "<p>a<b>b</b>c<br>d": "abc d", "<p>one<!-- two --><p>three<!-- four": "one\nthree", "<article>x<script>y": "x",
        "<p>1 < 2 &amp 3 &#x41;&#66;&hellip;</p>": "1 < 2 & 3 AB…", "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc", '<p title="a > b">t</p>': "t", "<p>a</b></i></p>": "a", deep: "deep", "<a href='x": "", "<p>a<a href='x>b</a>": "ab", "<style>p{}</style>": "",
        "<article>" + "<p>w</p>" * 20_000 + "</article>": "\n".join(["w"] * 20_000), "<p>" + "long " * 300_000: " ".join(["long"] * 300_000), "<pre>a\n  b</pre>": "a b", "</p></div>z": "z", "<head><title>t</title><p>q": "q",
    }
    pages = [(i, f"http://e{i}.example/", h) for i, h in enumerate(cases)] + [(99, "http://n.example/", None), (98, None, None)]
    got = ex.extract(frame(spark, pages))
    assert texts(got) == {**dict(enumerate(cases.values())), 99: "", 98: ""} and got.count() == len(pages)
    assert ex.extract(frame(spark, pages).where("false")).count() == 0


def test_classes_by_hand(spark, sf_dir):
    """Fingerprints put the same tokens together as whole occurrence vectors do."""
    pages = [(i, "http://one.example/", soup(i, "one")[0]) for i in range(9)]
    members = spark.createDataFrame([("one.example", 9)], "host string, members bigint")
    df = spark.createDataFrame([("one.example", p) for _, _, p in pages], "host string, html string").repartition(4)
    vectors = defaultdict(list)
    for _, _, page in pages:
        count = Counter(ex.token_of(*x) for x in ex.read(page, {}))
        for t in count:
            vectors[t]
    for _, _, page in pages:
        count = Counter(ex.token_of(*x) for x in ex.read(page, {}))
        for t, v in vectors.items():
            v.append(count[t])
    vectors.pop(None, None)
    classes = defaultdict(set)
    for t, v in vectors.items():
        if 2 * sum(n > 0 for n in v) >= 9:
            classes[tuple(v)].add(t)
    want = {frozenset(c) for c in classes.values() if len(c) >= ex.CLASS_TOKENS}
    got = defaultdict(set)
    for r in ex.candidates(df, members).collect():
        for t in r["tokens"]:
            got[t["class"]].add(t["token"])
    assert {frozenset(c) for c in got.values()} == want and len(want) >= 2


def test_shuffled_templates_give_the_same(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = texts(ex.extract(pages))
    monkeypatch.setattr(ex, "BROADCAST_TOKENS", 0)
    assert texts(ex.extract(pages)) == want
