r"""Main text of web pages by deducing the templates of their hosts.

Tokens of a page are its tags, each with the path of elements above it, and its texts with theirs.  Tokens that occur
equally often on every page of a host share an occurrence vector and form an equivalence class.  Vectors are never built:
a token's fingerprint is the exclusive or, over its pages, of a 128-bit hash of page and number of occurrences, which Spark
adds up before and after a shuffle, so a host with a third of all pages costs no more than others.  Classes of at least
``CLASS_TOKENS`` tokens on half of the host's pages are candidates; a second pass keeps those whose tokens stand in the same
order, in whole rounds, on every page, and which nest in each other.

The elements that the template holds once a page are its slots.  The article's slot is the semantic one (article, main) if
there is one, else the deepest with most of the host's text outside menus, forms and the like; what it holds is extracted,
less such parts inside and texts that the template itself repeats on all pages of a host of ``STEADY_PAGES`` or more.  Pages
whose host has no other page or shows no such slot, and pages without a host, are judged by the same rule alone.

Templates hold at most about two pages' worth of tokens each.  They are broadcast if they are ``BROADCAST_TOKENS`` together,
counted first; beyond that hosts with many pages are broadcast and the others meet their pages by a shuffle.

Defined results: null and empty html have an empty text; broken and unclosed markup is read to its end, an unclosed comment
hides the rest; a line break is white space; white space is that of Unicode; each row is a page of its own, whatever its id;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable, join_members
from .url_lists import host as host_of

CLASS_TOKENS = 3
STEADY_PAGES = 20
BROADCAST_TOKENS = 2_000_000
#: Share of a host's text that an element holds to be the article's slot.
MOST = 0.6

TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {n: re.compile(rf"</{n}[\s/>]", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp", "noscript")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these ends an open one of the second set, unless one of the third is in between.
ENDS = {
    **{b: (frozenset(("p", "head")), frozenset("td th caption table button object".split())) for b in BLOCKS - {"head", "html"}},
    "li": (frozenset(("li", "p")), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd p".split()), frozenset(("dl",))),
    "dd": (frozenset("dt dd p".split()), frozenset(("dl",))),
    "tr": (frozenset("tr td th".split()), frozenset(("table",))),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Elements, roles and words of class and id that hold menus, headers, footers, sidebars, notices, adverts, forms and comments.
APART = frozenset("nav aside footer form script style noscript template iframe svg math canvas object button select textarea head title dialog menu search noframes noembed audio video datalist".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup "
    "sidebar sidebars widget widgets menu menus navbar nav navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist discussion disqus replies respond share sharing social related".split()
)
HEADERS = frozenset("header masthead topbar".split())
SEMANTIC = frozenset(("article", "main"))
HOLDERS = frozenset("body div section article main td center table tbody tr".split())


def mixed(parent: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode(), parent) >> 1


@dataclass
class Element:
    name: str
    path: int
    apart: bool = False
    semantic: bool = False
    link: bool = False
    depth: int = 0


ROOT = Element("", 0)


def parts(name: str) -> list[str]:
    return re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())


def opened(name: str, attributes: str, above: Element, memo: dict) -> Element:
    key = name, attributes, above.path
    found = memo.get(key)
    if found is None:
        given = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        words = [parts(given[k]) for k in ("class", "id") if k in given]
        roles = set(given.get("role", "").lower().split())
        semantic = name in SEMANTIC or "main" in roles or given.get("itemprop") == "articleBody"
        apart = name in APART or bool(roles & APART_ROLES)
        if not semantic and name not in ("html", "body"):
            marks = {w for ws in words for v, w in zip(["", *ws], ws) if v not in ("has", "no", "with", "without")}
            apart |= bool(marks & APART_WORDS) or (not above.semantic and (name in HEADERS or bool(marks & HEADERS)))
        path = mixed(above.path, " ".join([name, str(semantic), *sorted({w for ws in words for w in ws}), *sorted(roles)]))
        if len(memo) > 50_000:
            memo.clear()
        found = memo[key] = Element(name, path, apart or above.apart, semantic or above.semantic, name == "a" or above.link, above.depth + 1)
    return found


def read(page: str, memo: dict) -> Iterator[tuple[str, Element, str]]:
    """Open tags, close tags and texts in order: ("<", element, ""), (">", element, "") and ("t", element above, text)."""
    stack, count, at, size = [ROOT], Counter(), 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            yield "t", stack[-1], entities.unescape(text) if "&" in text else text
        if not m:
            return
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in ("br", "p") and not count[name]:
                # a closing tag alone counts as the empty element
                e = opened(name, "", stack[-1], memo)
                yield "<", e, ""
                yield ">", e, ""
            elif count[name]:
                while True:
                    e = stack.pop()
                    count[e.name] -= 1
                    if e.name == name:
                        yield ">", e, ""
                        break
        elif m[2]:
            name = m[2].lower()
            if page[at - 1] != ">":
                # an unclosed quote ends with the tag
                at = page.find(">", at) + 1 or size
            closes = ENDS.get(name)
            if closes and any(count[n] for n in closes[0]):
                depth = len(stack) - 1
                last = 0
                while depth > 0 and stack[depth].name not in closes[1]:
                    if stack[depth].name in closes[0]:
                        last = depth
                        if name not in ("li", "dt", "dd", "tr"):
                            break
                    depth -= 1
                if last:
                    for e in stack[last:]:
                        count[e.name] -= 1
                    del stack[last:]
            e = opened(name, m[3], stack[-1], memo)
            yield "<", e, ""
            if name in RAW:
                end = RAW[name].search(page, at)
                if (end.start() if end else size) > at:
                    yield "t", e, page[at : end.start() if end else size]
                if end:
                    yield ">", e, ""
                    at = page.find(">", end.start()) + 1 or size
                else:
                    at = size
            elif name not in VOID and not m[3].endswith("/") or name in BLOCKS - VOID:
                stack.append(e)
                count[name] += 1


def token_of(kind: str, e: Element, text: str) -> int | None:
    """The token of one item of ``read``; none for blank texts."""
    if kind == "t":
        text = " ".join(text.split())
        return mixed(e.path, "t" + text) if text else None
    return mixed(e.path, kind)


def sums(items: list, elements: dict[int, list]) -> int:
    """Adds to ``elements``, by token, words of the page's text under each element: [words, semantic, depth, holder].

    Words in menus, links and the like don't count; returns all that do.
    """
    stack: list[list] = []  # depth, token, words so far
    total = 0

    def leave(depth: int):
        while stack and stack[-1][0] >= depth:
            _, token, n = stack.pop()
            elements[token][0] += n
            if stack:
                stack[-1][2] += n

    for kind, e, text in items:
        if kind == "<":
            leave(e.depth)
            if e.name in HOLDERS and not e.apart:
                token = mixed(e.path, "<")
                elements.setdefault(token, [0, e.name in SEMANTIC, e.depth])
                stack.append([e.depth, token, 0])
        elif kind == "t":
            leave(e.depth + 1)
            if not e.apart and not e.link:
                n = len(text.split())
                total += n
                if stack:
                    stack[-1][2] += n
    leave(0)
    return total


def slot_of(elements: dict[int, list], total: int) -> int | None:
    """The token of the element that holds the article: a semantic one if there is any, else the deepest with most text."""
    semantic = {k: v for k, v in elements.items() if v[1] and v[0]}
    some = semantic or elements
    least = 0.5 * max((v[0] for v in semantic.values()), default=0) if semantic else MOST * total
    fit = [(v[2], v[0], k) for k, v in some.items() if v[0] >= least and v[0]]
    return max(fit)[2] if fit else None


def main_text(page: str | None, slot: int | None = None, steady: frozenset = frozenset(), memo: dict | None = None) -> str:
    """Blocks of the article, one a line.  ``slot``: the host's; ``steady``: tokens of texts that belong to its template."""
    if not page:
        return ""
    memo = {} if memo is None else memo
    items = list(read(page, memo))
    tokens = {mixed(e.path, "<") for kind, e, _ in items if kind == "<"} if slot is not None else ()
    if slot not in tokens:
        elements: dict[int, list] = {}
        total = sums(items, elements)
        slot = slot_of(elements, total)
    blocks, now, own, inside = [], [], [], []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            blocks.append((text, all(own)))
        now.clear()
        own.clear()

    for kind, e, text in items:
        if kind == "t":
            # the slots that are open are those above this text
            while inside and inside[-1] > e.depth:
                inside.pop()
            if e.apart or (slot is not None and not inside):
                continue
            token = token_of(kind, e, text)
            if token is not None:
                own.append(token in steady)
            now.append(text)
            continue
        if e.name in BLOCKS or e.apart:
            flush()
        elif e.name == "br":
            now.append(" ")
        if kind == "<":
            while inside and inside[-1] >= e.depth:
                inside.pop()
            if slot is not None and mixed(e.path, "<") == slot:
                inside.append(e.depth)
    flush()
    dropped, kept = (sum(len(t) for t, o in blocks if o == k) for k in (True, False))
    return "\n".join(t for t, o in blocks if not o or dropped >= kept)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def rows_out(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types, strict=True)], schema=schema)


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, x, y, pages, total): each token's fingerprint and how often it occurs."""
    schema = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("token", "x", "y", "pages", "total"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            found: dict[tuple, list] = {}
            for host, row, page in zip(*(batch.column(c).to_pylist() for c in ("host", "row", "html"))):
                count = Counter(token_of(*item) for item in read(page, memo))
                count.pop(None, None)
                marks = {n: [xxhash.xxh3_64_intdigest(b"%d:%d" % (row, n), seed) for seed in (1, 2)] for n in set(count.values())}
                for token, n in count.items():
                    have = found.setdefault((host, token), [0, 0, 0, 0])
                    have[0] ^= marks[n][0]
                    have[1] ^= marks[n][1]
                    have[2] += 1
                    have[3] += n
            yield rows_out([[h, t, signed(x), signed(y), p, n] for (h, t), (x, y, p, n) in found.items()], schema)

    each = pages.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "host string, token bigint, x bigint, y bigint, pages bigint, total bigint")
    return each.groupBy("host", "token").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("pages").alias("pages"), F.sum("total").alias("total"))


def candidates(pages: DataFrame, members: DataFrame) -> DataFrame:
    """(host, members, tokens array<struct<token, class, once>>): classes that are large and frequent, by host."""
    # half of a host's pages have a token at most twice as many tokens have, on average, as a page
    often = occurrences(pages).join(members.where("members > 1"), "host").where("pages * 2 >= members")
    classes = often.groupBy("host", "members", "x", "y").agg(F.collect_list(F.struct("token", (F.col("pages") == F.col("members")).alias("all"), (F.col("total") == F.col("pages")).alias("once"))).alias("own"))
    large = classes.where(F.size("own") >= CLASS_TOKENS).select("host", "members", F.col("x").alias("class"), F.explode("own").alias("t"))
    return large.groupBy("host", "members").agg(F.collect_list(F.struct("t.token", "class", "t.all", "t.once")).alias("tokens"))


def with_template(pages: DataFrame, templates: DataFrame, how: str) -> DataFrame:
    """Pages with their host's template; ``templates`` is a written table."""
    tokens = templates.agg(F.sum(F.size("tokens") + 8)).first()[0] or 0
    if tokens <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(templates), "host", how)
    met = join_members(pages, templates, ["host"])
    if how == "inner":
        return met
    alone = pages.join(templates.select("host"), "host", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


@dataclass
class Check:
    """Order and nesting of classes on the pages of a host, and the text in its elements."""

    orders: dict[tuple, set] = field(default_factory=lambda: defaultdict(set))
    bad: set = field(default_factory=set)
    words: dict[str, list] = field(default_factory=lambda: defaultdict(lambda: [0, {}]))

    def page(self, host: str, page: str, class_of: dict[int, int], memo: dict) -> None:
        items = list(read(page, memo))
        tokens = [t for item in items if (t := token_of(*item)) in class_of]
        seen = defaultdict(list)
        for t in tokens:
            seen[class_of[t]].append(t)
        cycle = {}
        for c, order in seen.items():
            size = len(set(order))
            cycle[c] = order[:size]
            whole = order == order[:size] * (len(order) // size)
            self.orders[host, c].add(signed(xxhash.xxh3_64_intdigest(repr(order[:size]).encode())) if whole else None)
        stack: list[list] = []
        for t in tokens:
            c = class_of[t]
            if None in self.orders[host, c]:
                continue
            if t == cycle[c][0]:
                stack.append([c, 0])
            else:
                while stack and stack[-1][0] != c:
                    # what is open inside a class that goes on doesn't nest in it
                    self.bad.add((host, stack.pop()[0]))
                if stack:
                    stack[-1][1] += 1
            if stack and stack[-1][0] == c and stack[-1][1] + 1 == len(cycle[c]):
                stack.pop()
        own = self.words[host]
        own[0] += sums(items, own[1])


def judged(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, kind, key, low, high, words, semantic, depth): orders of classes ("c"), text of elements ("e") and of all ("a")."""
    kinds = "host string, kind string, key bigint, low bigint, high bigint, words bigint, semantic boolean, depth int"
    schema = pa.schema([("host", pa.string()), ("kind", pa.string()), *((c, pa.int64()) for c in ("key", "low", "high", "words")), ("semantic", pa.bool_()), ("depth", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            check = Check()
            maps: dict[str, dict] = {}
            hosts = batch.column("host").to_pylist()
            for k, (host, page) in enumerate(zip(hosts, batch.column("html").to_pylist())):
                if host not in maps:
                    maps[host] = {t["token"]: t["class"] for t in batch.column("tokens")[k].as_py()}
                check.page(host, page, maps[host], memo)
            out = []
            for (host, c), orders in check.orders.items():
                wrong = None in orders or (host, c) in check.bad
                out.append([host, "c", c, *((-1 << 63, (1 << 63) - 1) if wrong else (min(orders), max(orders))), 0, None, None])
            for host, (total, elements) in check.words.items():
                out.append([host, "a", 0, None, None, total, None, None])
                out += [[host, "e", token, None, None, *v] for token, v in elements.items()]
            yield rows_out(out, schema)

    met = with_template(pages, found, "inner").select("host", "html", "tokens")
    each = met.mapInArrow(run, kinds)
    return each.groupBy("host", "kind", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("words").alias("words"), F.max("semantic").alias("semantic"), F.max("depth").alias("depth"))


def templates(pages: DataFrame, members: DataFrame) -> DataFrame:
    """(host, members, tokens, slot): the tokens of steady texts and the article's slot of each host with a template."""
    found = durable(candidates(pages, members), "candidates")
    facts = durable(judged(pages, found), "judged")
    valid = facts.where("kind = 'c' AND low = high").select("host", F.col("key").alias("class"))
    tokens = found.select("host", "members", F.explode("tokens").alias("t")).select("host", "members", "t.*").join(valid, ["host", "class"])
    # elements that the template holds once on every page
    once = tokens.where("`all` AND once").select("host", "token", "members")
    inside = facts.where("kind = 'e'").select("host", F.col("key").alias("token"), "words", "semantic", "depth").join(once.select("host", "token"), ["host", "token"])
    total = facts.where("kind = 'a'").select("host", F.col("words").alias("total"))
    most = inside.join(total, "host").withColumn("rank_words", F.max(F.when(F.col("semantic"), F.col("words")).otherwise(0)).over(Window.partitionBy("host")))
    fit = most.where(F.when(F.col("rank_words") > 0, F.col("semantic") & (F.col("words") * 2 >= F.col("rank_words"))).otherwise(F.col("words") >= MOST * F.col("total")) & (F.col("words") > 0))
    slots = fit.groupBy("host").agg(F.max_by("token", F.struct("depth", "words", "token")).alias("slot"))
    steady = once.where(F.col("members") >= STEADY_PAGES).groupBy("host").agg(F.collect_list("token").alias("tokens"))
    return found.select("host", "members").join(slots, "host", "left").join(steady, "host", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<bigint>")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of each page."""
    kept = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.coalesce(host_of("url"), F.lit("")).alias("host"))
    hosted = kept.where("host <> ''").select("host", "html")
    members = durable(hosted.groupBy("host").agg(F.count("*").alias("members")), "members")
    known = durable(templates(hosted, members), "templates")
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        steady: dict[str, frozenset] = {}
        for batch in batches:
            texts = []
            for k, (host, page, slot) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "html", "slot")))):
                if host not in steady:
                    if len(steady) > 1000:
                        steady.clear()
                    steady[host] = frozenset(batch.column("tokens")[k].as_py() or ())
                texts.append(main_text(page, slot, steady[host], memo))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    met = with_template(kept, known, "left").select("page_id", "url", "host", "html", "slot", "tokens")
    return met.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")
