"""Operators 3 and 10, and the pipeline."""

import random
import re
from datetime import date
from urllib.parse import urlsplit

from statuslake.llm import pii, url_lists

from .conftest import SCHEMA


def changed(spark, texts):
    rows = [(i, t, None, None, 0, "k", 0, "i", 1, "n") for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in pii.anonymise(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_format_and_coreference(spark):
    got = changed(spark, ["Mail anna.B@mail4.example.com, ANNA.b@MAIL4.example.com; +1 (076) 555-8046 or +1-076-555-8046.", "again anna.b@mail4.example.com", "cards 4111111111111111 and 4111 1111 1111 1111"])
    a, b, c = re.findall(r"[\w.]+@[\w.]+\w", got[0]["text"]) + re.findall(r"\S+@\S+", got[1]["text"])
    assert a.lower() == b.lower() == c and c != "anna.b@mail4.example.com" and c.endswith(".com") and b.split("@")[0].isupper() is False
    assert re.fullmatch(r"Mail [a-z]{4}\.[A-Z]@[a-z]{4}\d\.[a-z]{7}\.com, [A-Z]{4}\.[a-z]@[A-Z]{4}\d\.[a-z]{7}\.com; \+1 \(\d{3}\) \d{3}-\d{4} or \+1-\d{3}-\d{3}-\d{4}\.", got[0]["text"])
    one, two = re.search(r"\+1 \((\d+)\) (\d+)-(\d+) or \+1-(\d+)-(\d+)-(\d+)", got[0]["text"]).groups()[:3], re.search(r"or \+1-(\d+)-(\d+)-(\d+)", got[0]["text"]).groups()
    assert one == two and got[0]["n_entities"] == 4
    plain, spaced = re.match(r"cards (\d{16}) and ([\d ]+)", got[2]["text"]).groups()
    assert plain == spaced.replace(" ", "") != "4111111111111111"
    digits = [int(d) for d in plain[::-1]]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def ends(kind, script="latin"):
    return tuple(pii.SYLLABLES[script][{"f": 2, "m": 3, "n": 4, "surname": 5, "surname f": 6}[kind]].split())


def test_names_by_gender_and_script(spark):
    got = changed(spark, ["Mrs. Anna Schmidt and Mr Karl Schmidt met Frau Schmidt.", "Госпожа Анна Белова и Господин Иван Белов", "Herr Παπαδόπουλος, MR KARL SCHMIDT", "Prof. Kim-Lou O'Neill"])
    first, second, third = re.match(r"Mrs\. (\S+ \S+) and Mr (\S+ \S+) met Frau (\S+)\.", got[0]["text"]).groups()
    assert first.split()[1] == second.split()[1] == third != "Schmidt" and third.endswith(ends("surname"))
    assert first.split()[0].endswith(ends("f")) and second.split()[0].endswith(ends("m"))
    names = re.fullmatch(r"Госпожа (\S+) (\S+) и Господин (\S+) (\S+)", got[1]["text"]).groups()
    assert all(re.fullmatch("[А-Я][а-я]+", n) for n in names) and not set(names) & {"Анна", "Белова", "Иван", "Белов"}
    assert names[0].endswith(ends("f", "cyrillic")) and names[1].endswith(ends("surname f", "cyrillic")) and names[3].endswith(ends("surname", "cyrillic"))
    greek, karl, schmidt = re.fullmatch(r"Herr (\S+), MR (\S+) (\S+)", got[2]["text"]).groups()
    assert re.fullmatch("[\u0370-\u03ff]+", greek) and greek != "Παπαδόπουλος"
    assert (karl, schmidt) == (second.split()[0].upper(), third.upper())
    assert re.fullmatch(r"Prof\. [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]+", got[3]["text"]) and got[3]["text"].split("-")[0].endswith(ends("n"))


def test_later_mentions_and_titles(spark):
    got = changed(spark, ["Mr Karl Schmidt called. Later Schmidt left, SCHMIDT's dog too, and Karl came back; Schmidts and karl stay.", "Dr. Anna Keller spoke. Mrs. Anna Keller left.", "Keller and Schmidt in a text without titles"])
    karl, schmidt = re.match(r"Mr (\S+) (\S+) called", got[0]["text"]).groups()
    assert got[0]["text"] == f"Mr {karl} {schmidt} called. Later {schmidt} left, {schmidt.upper()}'s dog too, and {karl} came back; Schmidts and karl stay." and got[0]["n_entities"] == 4
    one, two = re.fullmatch(r"Dr\. (\S+ \S+) spoke\. Mrs\. (\S+ \S+) left\.", got[1]["text"]).groups()
    assert one == two != "Anna Keller" and one.split()[0].endswith(ends("f"))
    assert got[2]["text"] == "Keller and Schmidt in a text without titles" and got[2]["n_entities"] == 0


def test_further_formats(spark):
    texts = ["call +44 20 7946 0958 now", "or +49 30 1234567.", "or +33 1 42 68 53 00", "at 2001:db8::1 and 2001:0db8:0:0:0:0:0:2", "passport AB1234567, or Passport No. 123456789", "at 12:30:45 in std::vector, version 1.2.3"]
    got = changed(spark, texts)
    shape = lambda t: re.sub("[0-9]", "9", t)
    for i in range(3):
        assert got[i]["text"] != texts[i] and shape(got[i]["text"]) == shape(texts[i]) and got[i]["n_entities"] == 1
        assert re.search(r"\+\d+", got[i]["text"])[0] == re.search(r"\+\d+", texts[i])[0]
    assert re.fullmatch(r"at [0-9a-f]{4}:[a-f]{2}[0-9]::[0-9] and [0-9]{4}:[0-9][a-f]{2}[0-9]:[0-9]:[0-9]:[0-9]:[0-9]:[0-9]:[0-9]", got[3]["text"]) and got[3]["n_entities"] == 2
    assert re.fullmatch(r"passport [A-Z]{2}\d{7}, or Passport No\. \d{9}", got[4]["text"]) and got[4]["n_entities"] == 2
    assert got[5]["text"] == texts[5]


def test_against_plain_python(spark, documents):
    """Names and addresses put into documents: the rest of each text stays, and values map one to one over the corpus."""
    rng = random.Random(2)
    given, surnames, titles = [f"{a}{b}" for a in ("Al", "Ber", "Chri", "Dom") for b in ("na", "to", "sa")], [f"{a}{b}" for a in ("Hol", "Fer", "Gra", "Lem") for b in ("ner", "zig", "wal")], ["Mr", "Mrs.", "DR.", "Herr"]
    rows, plan = [], {}
    for i, r in enumerate(documents.where("n_chars < 3000").orderBy("doc_id").limit(60).collect()):
        words = [w for w in re.findall("[a-zäöüßéèñ]+", r["text"] or "") if len(w) > 3]
        out, own = [], None
        for w in words[:60]:
            pick = rng.random()
            if pick < 0.05:
                own = rng.choice(given), rng.choice(surnames)
                out.append(f"{rng.choice(titles)} {own[0]} {own[1]}")
            elif pick < 0.1 and own:
                out.append(rng.choice([own[0], own[1], own[1].upper()]))
            elif pick < 0.15:
                out.append(f"{rng.choice(given).lower()}{rng.randint(1, 9)}@mail.example.org")
            out.append(w)
        rows.append((i, " ".join(out)))
        plan[i] = out
    got = {r["doc_id"]: r["text"].split() for r in pii.anonymise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    mapped, n = {}, 0
    for i, text in rows:
        before, after = text.split(), got[i]
        assert len(before) == len(after)
        known = {w.lower() for a, b, c in zip(["", *before], ["", "", *before], before) for w in [c] if a in titles or b in titles and c.isalpha() and c[0].isupper()}
        for a, b in zip(before, after):
            if "@" in a or (a.lower() in known and a[0].isupper()):
                n += 1
                assert mapped.setdefault(a.lower(), b.lower()) == b.lower() != a.lower() and a.isupper() == b.isupper()
            else:
                assert a == b
    assert n > 200 and len(set(mapped.values())) == len(mapped) and not set(mapped) & set(mapped.values())


def test_distinct_values_stay_distinct(spark):
    """All addresses of one-digit parts from a small space, and many names from short lists."""
    texts = [f"1.1.{a}.{b}" for a in range(10) for b in range(10)] + [f"Mr Name{chr(97 + i)}" for i in range(26)]
    got = changed(spark, texts)
    new = [got[i]["text"] for i in range(len(texts))]
    assert len(set(new)) == len(new) and not set(new) & set(texts)


def test_odd_rows(spark, odd, empty):
    got = pii.anonymise(odd)
    assert got.columns == [*odd.columns, "n_entities"] and got.count() == odd.count()
    before = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got.collect():
        assert (r["text"] == before[r["doc_id"]]) == (r["n_entities"] == 0)
    assert pii.anonymise(empty).count() == 0
    assert [pii.anonymise(odd).where("doc_id = 20").first()["text"]] == [pii.anonymise(odd).where("doc_id = 20").first()["text"]]
    assert pii.anonymise(odd, key="other").where("doc_id = 20").first()["text"] != pii.anonymise(odd).where("doc_id = 20").first()["text"]


def test_no_planted_value_is_left(documents):
    patterns = [r"[\w.]+@mail\d\.example\.com", r"(?<!\w)\d{16}(?!\w)", r"\+1 \(\d{3}\) 555-\d{4}", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w)", r"(?<!\w)[0-9a-f]{40}(?!\w)"]
    after = {r["doc_id"]: r["text"] for r in pii.anonymise(documents).collect()}
    for r in documents.collect():
        values = [v for p in patterns for v in re.findall(p, r["text"] or "")]
        assert not any(v in after[r["doc_id"]] for v in values)
        assert values or after[r["doc_id"]] == r["text"]


def test_lists_as_of_the_fetch(spark):
    day = lambda n: date(2024, 1, n)
    events = [("l", "Bad.example", "add", day(5)), ("l", "bad.example", "remove", day(10)), ("l", "bad.example", "add", day(20)), ("l", "tie.example", "add", day(3)), ("l", "tie.example", "remove", day(3)), ("m", "sub.bad.example", "add", day(1)), (None, None, "add", day(1)), ("l", "x.example", None, day(1)), ("l", "y.example", "add", None)]
    captures = [(1, "http://bad.example/a", day(4)), (2, "http://bad.example/a", day(5)), (3, "https://u:p@BAD.example:80/", day(9)), (4, "http://bad.example", day(10)), (5, "http://www.bad.example/", day(25)), (6, "http://sub.bad.example/", day(6)), (7, "http://notbad.example/", day(25)), (8, None, day(25)), (9, "not a url", day(25)), (10, "http://bad.example/", None), (11, "http://tie.example/", day(4)), (2, "http://bad.example/a", day(5)), (12, "http://y.example/", day(9))]
    c = spark.createDataFrame([(*x, "m", "t", True) for x in captures], "page_id bigint, url string, fetched_at date, m string, time string, blocked boolean")
    e = spark.createDataFrame(events, "list string, domain string, action string, at date")
    got = url_lists.evaluate(c, e).collect()
    assert len(got) == len(captures)
    assert sorted(r["page_id"] for r in got if r["blocked"]) == [2, 2, 3, 5, 6]
    assert {r["page_id"]: r["listed_domain"] for r in got}[6] == "sub.bad.example"
    assert url_lists.evaluate(c, e.where("at IS NULL")).where("blocked").count() == 0
    assert url_lists.evaluate(c.where("page_id > 99"), e).count() == 0


def test_hosts_as_python_reads_them(spark):
    urls = ["http://[2001:DB8::1]/x", "http://[::1]:8080", "http://u:p@x@evil.com/", "https://User@Example.COM.:443/p?q#f", "ftp://a.b.c", "http://1.2.3.4:80/", "http://x.example?y@z", "http://x.example#a@b", "HTTP://Ünï.example/", "http:///path", "mailto:a@b.c", "//no.scheme/", "http://:80/", "a+b-c.d://h.example/"]
    got = [r["host"] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(url_lists.host("url").alias("host")).collect()]
    assert got == [((urlsplit(u).hostname or "").rstrip(".") or None) if u[:2] != "//" else None for u in urls]
    day = date(2024, 1, 2)
    c = spark.createDataFrame([(i, u, day) for i, u in enumerate(["http://1.2.3.4/", "http://9.2.3.4/", "http://[2001:db8::1]/", "http://a.3.4/"])], "page_id bigint, url string, fetched_at date")
    e = spark.createDataFrame([("l", d, "add", day) for d in ("2.3.4", "1.2.3.4", "2001:db8::1", "3.4")], "list string, domain string, action string, at date")
    assert sorted(r["page_id"] for r in url_lists.evaluate(c, e).where("blocked").collect()) == [0, 2, 3]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    from statuslake.llm import decontaminate
    from statuslake.llm.cluster import durable

    from .conftest import components
    from .test_duplicates import shingles

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    steps = [docs]
    for name, stage in pipeline.STAGES:
        steps.append(durable(stage(spark, steps[-1], sf_dir), name))
    for step in steps[1:-1]:
        assert step.columns == docs.columns
    good = {r["doc_id"] for r in steps[1].select("doc_id").collect()}
    assert sum(q == 1 and i not in good for i, q in labels.items()) <= 0.03 * len(labels)
    rows = steps[1].collect()
    sets = [(r["doc_id"], shingles(r["text"], 5)) for r in rows]
    links = [(a, b) for n, (a, s) in enumerate(sets) for b, t in sets[:n] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    comp = components([i for i, _ in sets], links)
    assert {r["doc_id"] for r in steps[2].collect()} == {i for i, c in comp.items() if i == c}
    hit = {r["doc_id"] for r in decontaminate.hits(steps[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert {r["doc_id"] for r in steps[3].collect()} == {r["doc_id"] for r in steps[2].collect()} - hit
    assert steps[4].count() == steps[3].count() == steps[5].count()
    assert pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids"]


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, empty):
    """Nulls, repeats, very long texts, extra columns and no rows at all pass every stage."""
    import corpus_pipeline as pipeline

    for docs in (odd, empty, odd.drop("n_chars")):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name == "bpe_encoding":
                assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == docs.count()
                continue
            assert out.columns == docs.columns
            kept = out.count()
            assert kept <= docs.count() and (kept > 0) == (docs is not empty)
            if name == "surrogates":
                assert kept == docs.count()


def test_rows_that_share_an_id(spark, sf_dir):
    """Different texts under one id both stay; repeats, near copies and copies without an id go."""
    import corpus_pipeline as pipeline

    from statuslake.llm.cluster import ship

    ship(spark)
    text = lambda word: " ".join(f"{word}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " more"), (3, text("b")), (1, text("a")), (4, None), (4, ""), (5, None), (None, text("c")), (None, text("c")), (6, text("c")), (7, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int").repartition(3)
    got = pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(((r["doc_id"] or 0, (r["text"] or "")[:1]) for r in got)) == [(1, "a"), (1, "b"), (4, ""), (4, ""), (5, ""), (6, "c"), (7, "d")]


def remainder(number):
    plain = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def test_surrogates_keep_what_makes_them_valid(spark):
    texts = ["from 10.0.0.1 and 192.168.4.5 to 8.8.8.8, not 999.999.999.999", "loop ::1 end", "card 4111 1111 1111 1111", "to DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432", "bad DE89 3704 0044 0532 0130 01"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r["text"] for r in pii.anonymise(rows).orderBy("doc_id").collect()]
    addresses = re.findall(r"[0-9.]*[0-9]", got[0])
    assert addresses[0].startswith("10.") and addresses[1].startswith("192.168.") and not re.match(pii.PRIVATE, addresses[2])
    assert addresses[3] == "999.999.999.999" and not {"10.0.0.1", "192.168.4.5", "8.8.8.8"} & set(addresses)
    assert re.fullmatch("loop ::[0-9] end", got[1]) and got[1] != texts[1]
    card = got[2].removeprefix("card ").replace(" ", "")
    assert card[:6] == "411111" and card != "4" + "1" * 15
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    ibans = got[3].removeprefix("to ").split(" or ")
    assert [remainder(x) for x in ibans] == [1, 1] and ibans[0][:2] == "DE" and ibans[1][:2] == "GB"
    assert remainder(got[4].removeprefix("bad ")) == remainder("DE89 3704 0044 0532 0130 01") != 1


def test_mentions_beside_apostrophes_and_many_names(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}").capitalize()
    many = " ".join(f"Dr. Q{letters(i).lower()} met Q{letters(i).lower()}'s aunt." for i in range(3000))
    rows = spark.createDataFrame([(0, "Mr Sean O'Brien, O'Brien's and O’BRIEN; Brien, Sean's, SEAN sean Seans"), (1, many)], "doc_id int, text string")
    one, two = pii.anonymise(rows).orderBy("doc_id").collect()
    sean, brien = re.match(r"Mr (\w+) (\w+),", one["text"]).groups()
    assert one["text"].split(", ", 1)[1] == f"{brien}'s and O’BRIEN; Brien, {sean}'s, {sean.upper()} sean Seans"
    pairs = re.findall(r"Dr\. (\w+) met (\w+)'s aunt\.", two["text"])
    assert two["n_entities"] == 6000 and len(set(pairs)) == 3000 and all(a == b for a, b in pairs)
    assert not {a for a, _ in pairs} & {f"Q{letters(i).lower()}" for i in range(3000)}


def test_drawing_has_a_small_plan(spark, monkeypatch):
    """A surrogate's expression isn't put into itself again and again, which filled the driver; public addresses stay public."""
    sizes, durable = {}, pii.durable

    def measured(df, name):
        sizes[name] = max(sizes.get(name, 0), len(df._jdf.queryExecution().optimizedPlan().toString()))
        return durable(df, name)

    monkeypatch.setattr(pii, "durable", measured)
    addresses = [f"{11 + i % 80}.{i % 7}.{i}.{i % 10}" for i in range(250)]
    got = changed(spark, [" and ".join(addresses), "at 10.1.2.3"])
    new = got[0]["text"].split(" and ")
    assert len(set(new)) == len(new) == len(addresses) and not any(re.match(pii.PRIVATE, a) for a in new) and re.match(r"at 10\.", got[1]["text"])
    assert max(sizes.values()) < 50_000, sizes
