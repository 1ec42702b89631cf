"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern.  Each distinct value, written in any format or case, is a unit (type, canonical
value) and gets one keyed surrogate of the same type: hashes of a secret key, the type, the value and an attempt number
choose the new characters, class by class.  Every occurrence is then filled with the surrogate's characters in its own
format: punctuation, spacing, case, length, top-level domain, country prefix and the validity of a card's check digit
stay; so do a card's issuer digits, the remainder of an IBAN by 97 and whether an address is a private one.

Names are found behind a title, in Latin, Cyrillic, Greek or Armenian letters.  Their words are units of the one type
that a script has, whatever the title; titles of all their occurrences tell their gender (neutral if they disagree or
tell none), and a word that ever comes last is a surname.  New names are built of syllables of that script and end as
fits the gender.  In a document with a name, the same words without a title, capitalised or in capitals, get the same
surrogates: surnames, and other words of three letters or more.

Collision checks run over all units of the corpus: a surrogate that equals a real value of its type, or that another
unit of the type also drew, is drawn again with the next attempt by all but one of those units; further attempts make
names, and from attempt ``LONGER`` on other surrogates, longer, so that small value spaces don't end the search.  Equal
values thus keep equal surrogates everywhere, different values different ones.

The table is searched and written once; only rows with an entity are joined, by a number of their own.  Defined results:
null stays null, empty stays empty; repeated rows get the same text; an empty table gives an empty table; all other
columns are kept as they are, but for an ``n_entities`` of the input, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import durable, join_members

#: Attempts after which surrogates other than names get longer.
LONGER = 8
#: Leading digits of a card that name its issuer and stay.
ISSUER = 6


def titles(words: str) -> str:
    return "|".join(f"{w}|{w.upper()}" for w in words.split())


FEMALE = titles("Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία")
MALE = titles("Mr Herr Monsieur Señor Sr Господин Κύριος")
NEUTRAL = titles("Dr Prof")
TITLE = rf"(?:{FEMALE}|{MALE}|{NEUTRAL})\.? "
LETTERS = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]"
WORD = rf"(?=\p{{Lu}}){LETTERS}(?:{LETTERS}|['’-](?={LETTERS})){{1,30}}"
NO_BEFORE, NO_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Letters and digits end and begin where a word stands alone.
BOUNDARY = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])|(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: Address blocks that aren't public: the first octet, or the first two of them, tell.
PRIVATE = r"^(?:10|127)[.]|^(?:192[.]168|169[.]254|172[.](?:1[6-9]|2[0-9]|3[01]))[.]"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": rf"{NO_BEFORE}[0-9a-f]{{32,64}}{NO_AFTER}",
    "iban": rf"{NO_BEFORE}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{3,7}}(?: ?[0-9A-Z]{{1,3}})?{NO_AFTER}",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\p{L}\p{N}:])",
    "card": rf"{NO_BEFORE}[0-9]{{4}}(?:[ -]?[0-9]{{4}}){{2}}[ -]?[0-9]{{1,7}}{NO_AFTER}",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{1,4}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|\+(?=(?:[ .()-]{{0,2}}[0-9]){{8}})[0-9]{{1,3}}(?:[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})){{2,5}}){NO_AFTER}",
    "passport": rf"(?<=[Pp]assport |PASSPORT |[Pp]assport: |[Pp]assport [Nn]o |[Pp]assport [Nn]o\. |[Pp]assport [Nn]umber )[A-Z]{{0,2}}[0-9]{{6,9}}{NO_AFTER}",
    "name": rf"{NO_BEFORE}{TITLE}{WORD}(?: {WORD})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Rows without these have no entity: a digit or an at sign, or a title.
HINT = rf"[0-9@]|{TITLE}\p{{Lu}}"
#: For each script the consonants and vowels of syllables, and endings: of given names (f, m, neither) and surnames (not f, f).
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", "na ra lia sa", "ton rik mar vin", "el is en or", "mann sen ter wick ini ert", "mann sen ter wick ini ert"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "на ра лия са", "тон рик мир лан", "ель ис ен ор", "ов ин ев", "ова ина ева"),
    "greek": ("βγδζκλμνπρστ", "αεηιο", "να ρα λια σα", "νος ρης τας μων", "ις ων", "πουλος ιδης ακης", "πουλου ιδη ακη"),
    "armenian": ("բգդկլմնպրստ", "աեիո", "նե լա նա", "մեն կոս րիկ", "իկ են", "յան ունի", "յան ունի"),
}


def kind(e: str) -> Column:
    """The type of a found string."""
    c = F.col(e)
    out = F.when(c.contains("@"), "email").when(c.rlike(rf"^{TITLE}"), "name").when(c.rlike("^[A-Z]{0,2}[0-9]{6,9}$"), "passport")
    for name in ("secret", "iban", "ip", "ip6", "ssn", "phone", "card"):
        if name != "phone":
            out = out.when(c.rlike(rf"^(?:{PATTERNS[name]})$"), name)
    return out.otherwise("phone")


def digest(*parts: Column) -> Column:
    """128 hexadecimal digits."""
    whole = F.concat_ws("\u0001", *parts)
    return F.concat(F.sha2(whole, 256), F.sha2(F.concat(whole, F.lit("\u0001more")), 256))


def script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").when(word.rlike(r"\p{IsArmenian}"), "armenian").otherwise("latin")


def units(entities: DataFrame) -> DataFrame:
    """``entities`` (e, ...) with type, and units: an array of (type, canon, word, gender, surname)."""
    t = entities.withColumn("type", kind("e"))
    plain = F.regexp_replace(F.lower("e"), r"[^\p{L}\p{N}]", "")
    canon = F.when(F.col("type") == "ip", F.col("e")).when(F.col("type") == "email", F.concat(plain, F.lit("."), F.lower(F.regexp_extract("e", r"\.([A-Za-z]+)$", 1)))).otherwise(plain)
    prefix = F.when(F.col("type") == "phone", F.regexp_extract("e", r"^\+([0-9]{1,3})", 1)).when(F.col("type") == "iban", F.substring("e", 1, 2)).otherwise("")
    words = F.split(F.regexp_replace("e", rf"^{TITLE}", ""), "[ -]")
    gender = F.when(F.col("e").rlike(rf"^(?:{FEMALE})\.? "), "f").when(F.col("e").rlike(rf"^(?:{MALE})\.? "), "m").otherwise("")
    unit = lambda kind_, canon_, word, g, surname: F.struct(kind_.alias("type"), canon_.alias("canon"), word.alias("word"), g.alias("gender"), surname.alias("surname"))
    name = F.transform(words, lambda w, i: unit(F.concat(F.lit("name "), script(w)), F.lower(w), w, gender, i == F.size(words) - 1))
    one = F.array(unit(F.rtrim(F.concat("type", F.lit(" "), F.lower(prefix))), canon, F.lit(""), F.lit(""), F.lit(False)))
    return t.withColumn("units", F.when(F.col("type") == "name", name).otherwise(one))


def drawn() -> Column:
    """The surrogate of a unit, as an expression over type, canon, gender, surname, attempt and the keyed digest h."""
    more = f"greatest(attempt - {LONGER - 1}, 0)"
    # characters: digit for digit, letter for letter; the kept prefix stays, and behind an e-mail's dot the domain
    body = "regexp_replace(canon, '[.][a-z]+$', '')"
    keep = "IF(type LIKE 'phone %' OR type LIKE 'iban %', length(split(type, ' ')[1]), IF(type = 'email', length(canon) - length(" + body + ") - 1, 0))"
    value = "CAST(conv(substr(h, (i * 2) % 120 + 1, 4), 16, 10) AS INT)"
    char = f"""CASE WHEN (type LIKE 'phone %' OR type LIKE 'iban %') AND i < {keep} THEN c
        WHEN type = 'email' AND i >= length({body}) - {keep} THEN c
        WHEN type = 'card' AND i < {ISSUER} AND attempt < {LONGER} THEN c
        WHEN c RLIKE '[0-9]' THEN CAST({value} % 10 AS STRING)
        WHEN type IN ('secret', 'ip6') THEN substr('abcdef', {value} % 6 + 1, 1)
        ELSE chr(97 + {value} % 26) END"""
    chars = f"concat(array_join(transform(split({body}, ''), (c, i) -> {char}), ''), substr(h, 1, {more}))"
    octets = f"""array_join(transform(split(canon, '[.]'), (o, i) -> CAST(CASE WHEN attempt < {2 * LONGER} AND i < CASE WHEN NOT canon RLIKE '{PRIVATE}' THEN 0 WHEN canon RLIKE '^(10|127)[.]' THEN 1 ELSE 2 END THEN o
        WHEN attempt >= {LONGER} THEN pmod(CAST(conv(substr(h, i * 4 + 1, 4), 16, 10) AS INT), 256)
        WHEN length(o) = 1 THEN pmod(CAST(conv(substr(h, i * 4 + 1, 4), 16, 10) AS INT), 10)
        WHEN length(o) = 2 THEN 10 + pmod(CAST(conv(substr(h, i * 4 + 1, 4), 16, 10) AS INT), 90)
        ELSE 100 + pmod(CAST(conv(substr(h, i * 4 + 1, 4), 16, 10) AS INT), 156) END AS STRING)), '.')"""

    number = lambda i: f"CAST(conv(substr(h, {i} * 4 + 1, 4), 16, 10) AS INT)"

    def name(consonants: str, vowels: str, female: str, male: str, neutral: str, surnames: str, female_surnames: str) -> str:
        pick = lambda ends: f"element_at(array({', '.join(repr(e) for e in ends.split())}), 1 + {number(31)} % {len(ends.split())})"
        syllable = f"concat(substr('{consonants}', {number('(2 * i)')} % {len(consonants)} + 1, 1), substr('{vowels}', {number('(2 * i + 1)')} % {len(vowels)} + 1, 1))"
        end = f"CASE WHEN surname AND gender = 'f' THEN {pick(female_surnames)} WHEN surname THEN {pick(surnames)} WHEN gender = 'f' THEN {pick(female)} WHEN gender = 'm' THEN {pick(male)} ELSE {pick(neutral)} END"
        return f"concat(array_join(transform(sequence(0, least(attempt, 13) + 1), i -> {syllable}), ''), {end})"

    cases = [f"WHEN type = 'name {s}' THEN {name(*parts)}" for s, parts in SYLLABLES.items()]
    return F.expr(f"CASE {' '.join(cases)} WHEN type = 'ip' THEN {octets} ELSE {chars} END")


def checked_card() -> Column:
    """The surrogate with its last digit set so that the check sum has the remainder of the real number's."""

    def rest(digits: str) -> str:
        return f"""pmod(aggregate(transform(split(reverse({digits}), ''), (c, i) -> IF(i % 2 = 0, CAST(c AS INT), CAST(c AS INT) * 2 - IF(CAST(c AS INT) > 4, 9, 0))), 0, (a, b) -> a + b), 10)"""

    return F.expr(f"IF(type = 'card' AND attempt < {LONGER}, concat(substr(s, 1, length(s) - 1), CAST(pmod(CAST(right(s, 1) AS INT) + {rest('canon')} - {rest('s')}, 10) AS STRING)), s)")


def checked_iban() -> Column:
    """The surrogate with its check digits set so that the remainder by 97 is the real number's."""

    def rest(text: str) -> str:
        return f"""aggregate(split({text}, ''), 0, (a, c) -> IF(c RLIKE '[0-9]', (a * 10 + CAST(c AS INT)) % 97, (a * 100 + ascii(c) - 87) % 97))"""

    blank = "concat(substr(s, 5), substr(s, 1, 2), '00')"
    wanted = f"{rest('concat(substr(canon, 5), substr(canon, 1, 4))')} - {rest(blank)}"
    # 97 and 98 are written for 0 and 1
    digits = f"transform(array(pmod({wanted}, 97)), d -> lpad(CAST(IF(d < 2, d + 97, d) AS STRING), 2, '0'))[0]"
    return F.expr(f"IF(type LIKE 'iban %' AND attempt < {LONGER}, concat(substr(s, 1, 2), {digits}, substr(s, 5)), s)")


def surrogates(real: DataFrame, key: str) -> DataFrame:
    """(type, canon, s): a surrogate for each unit of ``real`` (type, canon, gender, surname), a written table.

    It is distinct within its type and unlike any real value of it.
    """
    pending, done, attempt = real, None, 0
    while not pending.isEmpty():
        h = digest(F.lit(key), F.col("type"), F.col("canon"), F.lit(str(attempt)))
        tried = pending.withColumn("attempt", F.lit(attempt)).withColumn("h", h).withColumn("s", drawn())
        tried = tried.withColumn("s", checked_card()).withColumn("s", checked_iban())
        tried = durable(tried.select("type", "canon", "h", "s"), "tried")
        # a public address stays public; tested on the written column, as a plan would put the whole expression of s in its place, many times over
        tried = tried.where(~((F.col("type") == "ip") & F.col("s").rlike(PRIVATE) & ~F.col("canon").rlike(PRIVATE)))
        first = tried.groupBy("type", F.lower("s").alias("low")).agg(F.min_by("canon", F.struct("h", "canon")).alias("canon"))
        first = first.join(real.select("type", body_of("canon").alias("low")).distinct(), ["type", "low"], "left_anti")
        if done is not None:
            first = first.join(done.select("type", F.lower("s").alias("low")), ["type", "low"], "left_anti")
        won = tried.join(first.select("type", "canon"), ["type", "canon"], "left_semi").select("type", "canon", "s")
        done = durable(won if done is None else done.unionByName(won), "surrogates")
        pending = durable(real.join(done.select("type", "canon"), ["type", "canon"], "left_anti"), "pending")
        attempt += 1
    return done if done is not None else real.select("type", "canon", F.lit("").alias("s"))


def body_of(canon: str) -> Column:
    """A unit's value in the form its surrogate has: an e-mail's without the marked top-level domain."""
    return F.when(F.col("type") == "email", F.regexp_replace(canon, "[.][a-z]+$", "")).otherwise(F.col(canon))


def filled() -> Column:
    """An occurrence ``e`` with its letters and digits replaced in order by those of ``s``, in their case."""
    return F.expr("""concat_ws('', transform(array(aggregate(split(e, ''), named_struct('out', '', 'at', 1),
        (a, c) -> IF(c RLIKE '[\\\\p{L}\\\\p{N}]', named_struct('out', concat(a.out, IF(c = lower(c), substr(s, a.at, 1), upper(substr(s, a.at, 1)))), 'at', a.at + 1), named_struct('out', concat(a.out, c), 'at', a.at)))),
        r -> concat(r.out, substr(s, r.at))))""")


def in_case(s: Column, word: Column) -> Column:
    """``s`` in capitals if ``word`` is, else capitalised."""
    return F.when(word == F.upper(word), F.upper(s)).otherwise(F.initcap(s))


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (e, members) with new, and mentions: its words and what replaces them where they stand alone."""
    known = durable(units(entities), "entities")
    each = known.select("e", F.posexplode("units").alias("place", "u")).select("e", "place", "u.*")
    female, male = F.max(F.col("gender") == "f"), F.max(F.col("gender") == "m")
    real = each.groupBy("type", "canon").agg(F.when(female & ~male, "f").when(male & ~female, "m").otherwise("").alias("gender"), F.max("surname").alias("surname"))
    # a Russian or Greek surname tells its gender by its end
    ending = F.when(F.col("surname") & (F.col("type") == "name cyrillic"), F.when(F.col("canon").rlike("[ая]$"), "f").otherwise("m")).when(F.col("surname") & (F.col("type") == "name greek"), F.when(F.col("canon").rlike("(?:ου|ού|η|ή|α|ά)$"), "f").otherwise("m"))
    real = durable(real.withColumn("gender", F.coalesce(ending, "gender")), "units")
    roles = real.select("type", "canon", F.col("surname").alias("bare"))
    drawn_ = surrogates(real, key).join(roles, ["type", "canon"])
    title_case, capitals = F.initcap("canon"), F.upper("canon")
    forms = F.array_distinct(F.array(F.col("word"), title_case, capitals))
    mentions = F.when((F.col("word") != "") & (F.col("bare") | (F.length("canon") > 2)), F.transform(forms, lambda w: F.struct(w.alias("word"), in_case(F.col("s"), w).alias("new"))))
    none = F.array().cast("array<struct<word: string, new: string>>")
    told = each.join(drawn_, ["type", "canon"]).select("e", "place", F.when(F.col("word") == "", F.col("s")).otherwise(in_case(F.col("s"), F.col("word"))).alias("s"), F.coalesce(mentions, none).alias("mentions"))
    joined = told.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("place", "s", "mentions"))).alias("p"))
    out = known.select("e", "members", "type").join(joined, "e").withColumn("parts", F.transform("p", lambda x: x["s"])).withColumn("s", F.get("parts", F.lit(0)))
    title = F.regexp_extract("e", rf"^{TITLE}", 0)
    between = F.concat(F.regexp_extract_all(F.substr("e", F.length(title) + 1), F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
    name = F.concat(title, F.array_join(F.zip_with("parts", between, lambda a, b: F.concat(a, b)), ""))
    new = F.when(F.col("type") == "name", name).when(F.col("type") == "ip", F.col("s")).otherwise(filled())
    return out.select("e", "members", new.alias("new"), F.flatten(F.transform("p", lambda x: x["mentions"])).alias("mentions"))


def anonymise(docs: DataFrame, key: str = "statuslake", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``: how many occurrences were replaced."""
    docs = docs.drop("n_entities")
    none = F.array().cast("array<string>")
    found = F.coalesce(F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)), none)
    marked = durable(docs.withColumns({"statuslake_found": found, "statuslake_row": F.monotonically_increasing_id()}), "marked")
    hit = marked.where(F.size("statuslake_found") > 0)
    each = hit.select("statuslake_row", F.posexplode("statuslake_found").alias("place", "e"))
    new = durable(replacements(each.groupBy("e").agg(F.count("*").alias("members")), key), "replacements")
    told = join_members(each, new, ["e"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "new"))), lambda x: x["new"])
    lists = told.groupBy("statuslake_row").agg(ordered.alias("statuslake_new"), F.max(F.size("mentions") > 0).alias("statuslake_named"))
    filled_in = hit.join(lists, "statuslake_row").withColumn("n_entities", F.size("statuslake_found").cast("bigint"))
    between = F.split(text, ANY, -1)
    plain = F.array_join(F.zip_with(between, F.concat("statuslake_new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    columns = [*docs.columns, "n_entities"]
    unnamed = filled_in.where(~F.col("statuslake_named")).withColumn(text, plain).select(*columns)
    words = told.select("statuslake_row", F.explode("mentions").alias("m")).select("statuslake_row", "m.word", "m.new").distinct()
    named = with_mentions(filled_in.where("statuslake_named"), words, between, text).select(*columns)
    same = marked.where(F.size("statuslake_found") == 0).select(*docs.columns, F.lit(0).cast("bigint").alias("n_entities"))
    return same.unionByName(unnamed).unionByName(named)


def with_mentions(rows: DataFrame, words: DataFrame, between: Column, text: str) -> DataFrame:
    """``rows`` with their entities and the mentions of ``words`` (statuslake_row, word, new) replaced and counted.

    A text becomes the array of its words and of what lies between them, entities replaced; its capitalised words (two
    around an apostrophe also as one) meet its names in a join, and what met is put back at its place: work is linear
    in the text, however many names it has.
    """
    piece = lambda t, fixed: F.struct(t.alias("t"), F.lit(fixed).alias("fixed"))
    none = F.array().cast("array<struct<t: string, fixed: boolean>>")
    told = F.col("statuslake_new")
    pieces = F.flatten(F.transform(between, lambda p, i: F.concat(F.transform(F.split(p, BOUNDARY, -1), lambda t: piece(t, False)), F.when(i < F.size(told), F.array(piece(F.get(told, i), True))).otherwise(none))))

    def spans(p: Column) -> Column:
        joined = lambda x, i: F.when(F.get(p, i + 1)["t"].isin("'", "’"), F.concat(x["t"], F.get(p, i + 1)["t"], F.get(p, i + 2)["t"]))
        every = F.transform(p, lambda x, i: F.struct(i.alias("at"), x["fixed"].alias("fixed"), x["t"].alias("one"), joined(x, i).alias("three")))
        return F.filter(every, lambda x: ~x["fixed"] & x["one"].rlike(r"^\p{Lu}"))

    # the array is bound to a lambda's variable, so it is built once
    seen = rows.select("statuslake_row", F.explode(F.get(F.transform(F.array(pieces), spans), F.lit(0))).alias("x"))
    either = F.array(F.struct(F.lit(1).alias("span"), F.col("x.one").alias("word")), F.struct(F.lit(3).alias("span"), F.col("x.three").alias("word")))
    seen = seen.select("statuslake_row", "x.at", F.explode(either).alias("w")).select("statuslake_row", "at", "w.span", "w.word").where("word IS NOT NULL")
    met = seen.join(words, ["statuslake_row", "word"])
    places = met.groupBy("statuslake_row").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("span")).alias("less"), "new"))).alias("statuslake_met"))

    def covered(m: Column, x: Column, i: Column) -> Column:
        """Whether one of the two entries before ``x`` is a word around an apostrophe that holds it."""
        by = lambda k: F.coalesce((F.get(m, i - k)["less"] == -3) & (F.get(m, i - k)["at"] >= x["at"] - 2), F.lit(False))
        return by(1) | by(2)

    def rebuilt(r: Column) -> Column:
        m, p = r["m"], r["p"]
        end = lambda j: F.coalesce(F.get(m, j - 1)["at"] - F.get(m, j - 1)["less"], F.lit(0))
        part = lambda j: F.slice(p, end(j) + 1, F.greatest(F.coalesce(F.get(m, j)["at"], F.size(p)) - end(j), F.lit(0)))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(m)), lambda j: F.concat(F.array_join(part(j), ""), F.coalesce(F.get(m, j)["new"], F.lit("")))), "")

    met_ = F.coalesce("statuslake_met", F.array().cast("array<struct<at: int, less: int, new: string>>"))
    kept = F.get(F.transform(F.array(met_), lambda m: F.filter(m, lambda x, i: ~covered(m, x, i))), F.lit(0))
    out = rows.join(places, "statuslake_row", "left").withColumn("statuslake_met", kept)
    whole = F.array(F.struct(F.col("statuslake_met").alias("m"), F.transform(pieces, lambda x: x["t"]).alias("p")))
    return out.withColumn("n_entities", F.col("n_entities") + F.size("statuslake_met")).withColumn(text, F.get(F.transform(whole, rebuilt), F.lit(0)))
