"""Surrogates for personal data.

Built-in DataFrame functions only. One pattern finds entities; each is normalised, so that spellings of one value refer
to the same entity everywhere: a phone number with and without its country code, a person with and without a title.
Names are replaced word by word, so "Mr. John Smith", "Mr. Smith" and, once a title has told that this is a person,
"John Smith" in any text agree. Distinct entities get surrogates derived from a key, of the same type, length, script,
gender and format, with the check digits of cards and IBANs. Surrogates that meet each other, or a value of the corpus,
are drawn again until all differ. Texts are then rebuilt from the parts between entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, fresh, size_of, table, text_or_empty

_ALNUM = r"\p{L}\p{N}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|господин|госпожа|Господин|Госпожа)\.? |(?:MR|MRS|MS|DR|PROF)\. )"
#: A word of a name: O'Brien, McDonald, Smith-Jones, Smith or SMITH.
_NAME = r"(?:\p{Lu}\p{Ll}*+(?:['’-]?\p{Lu}\p{Ll}++)++|\p{Lu}\p{Ll}++|\p{Lu}{2,}+(?:['’-]\p{Lu}{2,}+)*+)"
#: Kinds in the order in which they are tried at a place of the text, each with its pattern. No quantifier can run over
#: the same characters from every one of them, so the time is linear in the text.
PATTERNS = {
    "email": rf"(?<![{_ALNUM}._%+-])[{_ALNUM}._%+-]++(?<![.])@[{_ALNUM}-]++(?:\.[{_ALNUM}-]++)++",
    "secret": rf"(?<![{_ALNUM}]){_LABEL}(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{{8,}}+",
    "access": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9A-Za-z])",
    "name": rf"(?<![{_ALNUM}]){_TITLE}{_NAME}(?: {_NAME})?(?![{_ALNUM}])",
}
#: No entity begins inside a word; saying so first spares the trial of every kind at most places.
PATTERN = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Two or more words that may be names, in a row.
RUN = rf"(?<![{_ALNUM}])(?<![{_ALNUM}]['’-]){_NAME}(?: {_NAME})++(?![{_ALNUM}])"
_DIGITS = ("phone", "ssn", "card")
_FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|[Гг]оспожа|MRS|MS)"
_MALE = r"^(?:Mr|Herr|Monsieur|Señor|Sr|[Гг]осподин|MR)"

# Names to draw from: given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("m", "latin"): "Albert Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oskar Paul".split(),
    ("f", "latin"): "Alma Berta Clara Diana Elena Flora Greta Hanna Irina Julia Karla Lena Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан Тимур Юрий".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария Нина Ольга Полина Софья Тамара Юлия".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до жа за зе ка ке ко ла ле ло ма ме мо на не но ра ре ро са та те".split(),
}
LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Letters to draw from in scripts without case, or whose case is not kept.
OTHER = {
    "Han": "天地人山水火木金土日月星雨雪風花草竹林石田川海江河湖春夏秋冬東西南北中大小多少高長新白黒赤青",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    "Thai": "กขคงจฉชซญดตถทธนบปผพฟมยรลวศสหอ",
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօ",
    "Georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
}
#: Draws of a value, without any success of any, after which a kind counts as too full; names grow longer and never are.
DRAWS = 2000


def _kind(found: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _normal(kind: Column, found: Column) -> Column:
    """The value that an entity stands for. A phone number's is what follows its country code, or its last ten digits."""
    phone = F.when(found.rlike(r"^\+[0-9]{1,3}[ .(-]"), _digits(F.regexp_replace(found, r"^\+[0-9]{1,3}", ""))).otherwise(_digits(found))
    phone = F.when(F.length(phone) > 10, F.substr(phone, F.length(phone) - 9)).otherwise(phone)
    return (
        F.when(kind == "phone", phone)
        .when(kind.isin(*_DIGITS), _digits(found))
        .when(kind.isin("email", "ipv6"), F.lower(found))
        .when(kind == "secret", F.regexp_replace(found, f"^{_LABEL}", ""))
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .otherwise(found)
    )


def _tokens(kind: Column, found: Column) -> Column:
    """What is replaced in an entity: structs (pos, word, kind, value, female). Names have a token for each word."""
    words = F.split(F.regexp_replace(found, f"^{_TITLE}", ""), " ")
    female = F.when(found.rlike(_FEMALE), 1).when(found.rlike(_MALE), -1).otherwise(0)
    token = lambda pos, word, k, value, f: F.struct(F.lit(pos).alias("pos"), word.alias("word"), F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), value.alias("value"), f.alias("female"))
    name = lambda pos, k: token(pos, F.get(words, pos), k, F.lower(F.get(words, pos)), female)
    whole = F.array(token(0, found, kind, _normal(kind, found), F.lit(0)))
    return F.when(kind != "name", whole).when(F.size(words) > 1, F.array(name(0, "given"), name(1, "family"))).otherwise(F.array(name(0, "family")))


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """256 keyed bytes as hex digits."""
    parts = [F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"), F.lit(str(i))), 512) for i in range(4)]
    return F.concat(*parts)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(i, F.lit(256)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _like(value: Column, stream: Column, keep: Column) -> Column:
    """A keyed string in the format of ``value``: characters change within their class, the first ``keep`` do not."""

    def drawn(c: Column, i: Column) -> Column:
        letters = F.when(c.rlike("[0-9]"), "0123456789")
        for script, lower in LOWER.items():
            letters = letters.when(c.rlike(rf"[\p{{Ll}}&&\p{{Is{script.capitalize()}}}]"), lower)
            letters = letters.when(c.rlike(rf"[\p{{Lu}}&&\p{{Is{script.capitalize()}}}]"), lower.upper())
        for script, own in OTHER.items():
            letters = letters.when(c.rlike(rf"[\p{{L}}&&\p{{Is{script}}}]"), own)
        # Letters of scripts without a list become Latin ones, and other digits those of ASCII: no value stays as it is.
        letters = letters.when(c.rlike(r"\p{N}"), "0123456789").when(c.rlike(r"\p{L}"), LOWER["latin"])
        picked = F.substr(letters, _byte(stream, i) % F.length(letters) + 1, F.lit(1))
        return F.when(i < keep, c).otherwise(F.coalesce(picked, c))

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), drawn), "")


def _luhn(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the right doubled, modulo 10."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _mod97(iban: Column) -> Column:
    """An IBAN's number, its first four characters moved to the end and letters counted from 10, modulo 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _surrogate(stream: Column, kind: Column, value: Column, female: Column, attempt: Column) -> Column:
    email_end = F.length(value) - F.length(F.regexp_extract(value, r"\.[^.]*$", 0))
    email = F.concat(_like(F.substr(value, F.lit(1), email_end), stream, F.lit(0)), F.regexp_extract(value, r"\.[^.]*$", 0))
    plain_card = _like(value, stream, F.lit(1))
    head = F.substr(plain_card, F.lit(1), F.length(value) - 1)
    check = (10 - _luhn(F.concat(head, F.lit("0")))) % 10
    card = F.when(_luhn(value) == 0, F.concat(head, check.cast("string"))).otherwise(plain_card)
    plain_iban = _like(value, stream, F.lit(2))
    country, rest = F.substr(value, F.lit(1), F.lit(2)), F.substr(plain_iban, F.lit(5))
    checked = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0"), rest)
    iban = F.when(_mod97(value) == 1, checked).otherwise(plain_iban)
    octet = lambda i, low, n: ((_byte(stream, F.lit(i)) * 256 + _byte(stream, F.lit(i + 1))) % n + low).cast("string")
    ip = F.concat_ws(".", octet(0, 1, 223), octet(2, 0, 256), octet(4, 0, 256), octet(6, 1, 254))
    hex_digit = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), _byte(stream, i) % 16 + 1, F.lit(1))).otherwise(c)
    ipv6 = F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), hex_digit), "")
    at = lambda words, i: F.element_at(F.array(*map(F.lit, words)), _byte(stream, i) % len(words) + 1)

    def drawn(script: str, first: int) -> Column:
        """Syllables, more with every attempt: there is no end of them."""
        return F.array_join(F.transform(F.sequence(F.lit(first), attempt + first + 2), lambda i: at(SYLLABLES[script], i)), "")

    def given(script: str) -> Column:
        end = {"latin": ("n", "a"), "cyrillic": ("н", "на")}[script]
        known = F.when(female > 0, at(GIVEN["f", script], F.lit(0))).otherwise(at(GIVEN["m", script], F.lit(0)))
        return F.lower(F.when(attempt == 0, known).otherwise(F.concat(drawn(script, 4), F.when(female > 0, end[1]).otherwise(end[0]))))

    def family(script: str) -> Column:
        if script == "latin":
            return F.concat(drawn(script, 1), F.lit("n"))
        end = F.regexp_extract(value, "(ова|ева|ина|ская|цкая|ов|ев|ин|ский|цкий|енко|ко|ук|юк|ян)$", 1)
        return F.concat(drawn(script, 1), F.when(end != "", end).when(female > 0, "ва").otherwise("в"))

    def named(part) -> Column:
        return F.when(value.rlike(r"\p{IsCyrillic}"), part("cyrillic")).when(value.rlike(r"\p{IsLatin}"), part("latin")).otherwise(_like(value, stream, F.lit(0)))

    keep = F.when(kind == "access", 4).otherwise(0)
    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", ip).when(kind == "ipv6", ipv6)
    return out.when(kind == "given", named(given)).when(kind == "family", named(family)).otherwise(_like(value, stream, keep))


def _fill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced in order."""
    parts = F.split(pattern, "[0-9]", -1)
    return F.array_join(F.zip_with(parts, F.filter(F.split(digits, ""), lambda c: c != ""), lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")


def _cased(found: Column, surrogate: Column) -> Column:
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_join(F.zip_with(chars(found), chars(surrogate), lambda o, s: F.when((o != F.lower(o)), F.upper(s)).otherwise(s)), "")


def _written(kind: Column, found: Column, surrogate: Column) -> Column:
    """A surrogate in the format of one occurrence."""
    groups = F.transform(F.split(found, " "), lambda p: F.length(p))
    start = lambda i: F.aggregate(F.slice(groups, 1, i), F.lit(0), lambda a, x: a + x)
    iban = F.array_join(F.transform(groups, lambda n, i: F.substr(surrogate, start(i) + 1, n)), " ")
    country = F.substr(_digits(found), F.lit(1), F.length(_digits(found)) - F.length(surrogate))
    return (
        F.when(kind == "phone", _fill(found, F.concat(country, surrogate)))
        .when(kind.isin(*_DIGITS), _fill(found, surrogate))
        .when(kind.isin("email", "ipv6"), _cased(found, surrogate))
        .when(kind == "secret", F.concat(F.regexp_extract(found, f"^{_LABEL}", 0), surrogate))
        .when(kind == "iban", F.when(found.contains(" "), iban).otherwise(surrogate))
        .when(kind.isin("given", "family"), F.when((F.length(found) > 1) & (found == F.upper(found)), F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .otherwise(surrogate)
    )


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of the rows (kind, value[, female]): all surrogates of a kind differ from each other and
    from its values. A value takes the first of its keyed draws that no value is, and that no other value has taken or draws
    earlier; those that are left draw again, twice as often each time. A value whose rows have a positive sum of ``female``
    is a woman's name.
    """
    female = F.sum("female") if "female" in values.columns else F.lit(0)
    values = cut(values.groupBy("kind", "value").agg(female.alias("female")))
    taken = values.select("kind", F.col("value").alias("surrogate"))
    left, settled, start, width, idle = values, None, 0, 1, 0
    while True:
        drawn = left.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(start + width - 1))))
        # The bytes are a column of their own: inside the lambdas they would be hashed again for every character.
        drawn = drawn.withColumn("stream", _stream(key, F.col("kind"), F.col("value"), F.col("attempt")))
        made = _surrogate(F.col("stream"), F.col("kind"), F.col("value"), F.col("female"), F.col("attempt"))
        free = drawn.select("kind", "value", "attempt", made.alias("surrogate")).join(taken, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("x"))
        own = first.groupBy("kind", F.col("x.value").alias("value")).agg(F.min_by("surrogate", "x.attempt").alias("surrogate"))
        own = cut(own.select("kind", "value", "surrogate"))
        settled = own if settled is None else settled.unionByName(own)
        left = cut(left.join(own.select("kind", "value"), ["kind", "value"], "left_anti"))
        if left.isEmpty():
            return settled
        idle = idle + width if own.isEmpty() else 0
        if idle > DRAWS:
            raise RuntimeError("some kind has more values than surrogates")
        start, width = start + width, min(2 * width, 64)


def _row_key(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole row: copies of a text under many ids stay apart, so no key is hot but that of equal rows."""
    columns = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def _linked_names(docs: DataFrame, text: Column, places: DataFrame, known: DataFrame) -> DataFrame | None:
    """(k1, k2, all): per row, names without title (found, new) that some text of the corpus gives with a title."""
    word = lambda k: F.filter("tokens", lambda t: t["kind"] == k)
    pairs = places.where((F.col("kind") == "name") & (F.size("tokens") == 2))
    pairs = cut(pairs.select(F.get(word("given"), 0)["value"].alias("given"), F.get(word("family"), 0)["value"].alias("family")).distinct())
    if pairs.isEmpty():
        return None
    k1, k2 = _row_key(docs)
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(0)), lambda r: F.split(r, " "))
    two = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    met = docs.select(k1.alias("k1"), k2.alias("k2"), F.explode(F.array_distinct(F.flatten(F.transform(runs, two)))).alias("p"))
    met = met.select("k1", "k2", F.split_part("p", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p", F.lit(" "), F.lit(2)).alias("b"))
    met = met.withColumn("given", F.lower("a")).withColumn("family", F.lower("b"))
    met = met.join(pairs, ["given", "family"], "left_semi")
    part = lambda k: known.where(F.col("kind") == k).select(F.col("value").alias(k), F.col("surrogate").alias(f"{k}_s"))
    met = met.join(part("given"), "given").join(part("family"), "family")
    new = F.concat_ws(" ", _written(F.lit("given"), F.col("a"), F.col("given_s")), _written(F.lit("family"), F.col("b"), F.col("family_s")))
    met = met.select("k1", "k2", F.struct(F.concat_ws(" ", "a", "b").alias("found"), new.alias("new")).alias("x"))
    return cut(met.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("x")).alias("linked")))


def replace_entities(docs: DataFrame, key: str = "surrogate-key", text_column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity in the text replaced by its surrogate; all rows and columns stay.

    Equal values get equal surrogates in all texts, whatever their spelling, different values different ones. Texts
    without entities, and nulls, stay as they are; repeated rows are treated alike; no rows give no rows. ``count``
    names a column to add, with the number of replacements.
    """
    text = text_or_empty(docs, text_column)
    h1, h2 = _row_key(docs)
    found = docs.select(h1.alias("k1"), h2.alias("k2"), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(0)).alias("found"))
    found = cut(found.where(F.size("found") > 0).dropDuplicates(["k1", "k2"]))
    places = found.select("k1", "k2", F.posexplode("found").alias("i", "found")).withColumn("kind", _kind(F.col("found")))
    places = cut(places.withColumn("tokens", _tokens(F.col("kind"), F.col("found"))))
    tokens = places.select("k1", "k2", "i", F.when(F.col("kind") == "name", F.regexp_extract("found", f"^{_TITLE}", 0)).otherwise("").alias("title"), F.explode("tokens").alias("t"))
    tokens = tokens.select("k1", "k2", "i", "title", "t.*")
    known = surrogates(tokens.select("kind", "value", "female"), key)
    written = tokens.join(known, ["kind", "value"]).select("k1", "k2", "i", "title", "pos", _written(F.col("kind"), F.col("word"), F.col("surrogate")).alias("new"))
    k1, k2, new, linked = (fresh(docs, n) for n in ("k1_", "k2_", "new_", "linked_"))
    whole = F.concat("title", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]), " "))
    per_place = written.groupBy("k1", "k2", "i", "title").agg(whole.alias("new"))
    per_row = per_place.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("i", "new"))).alias("all"))
    per_row = per_row.select("k1", "k2", F.col("all.new").alias(new))
    others = _linked_names(docs, text, places, known)
    if others is None:
        per_row = per_row.withColumn(linked, F.lit(None).cast("array<struct<found:string,new:string>>"))
    else:
        per_row = per_row.join(others.withColumnRenamed("linked", linked), ["k1", "k2"], "full")
    per_row = cut(per_row.withColumnsRenamed({"k1": k1, "k2": k2}))
    joined = docs.join(per_row, (h1 == F.col(k1)) & (h2 == F.col(k2)), "left")
    between = F.split(text, PATTERN, -1)
    bare = lambda x: F.concat(F.lit(f"(?<![{_ALNUM}])"), x["found"], F.lit(f"(?![{_ALNUM}])"))
    parts = F.when(F.col(linked).isNull(), between).otherwise(F.transform(between, lambda p: F.aggregate(linked, p, lambda t, x: F.regexp_replace(t, bare(x), x["new"]))))
    rebuilt = F.array_join(F.zip_with(parts, F.coalesce(F.col(new), F.array().cast("array<string>")), lambda part, n: F.concat(part, F.coalesce(n, F.lit("")))), "")
    columns = [F.when(F.col(k1).isNull(), joined[c]).otherwise(rebuilt).alias(c) if c == text_column else joined[c] for c in docs.columns]
    if count is not None:
        plain = F.array_join(between, "\n")
        more = F.aggregate(F.coalesce(F.col(linked), F.array().cast("array<struct<found:string,new:string>>")), F.lit(0), lambda n, x: n + F.size(F.split(plain, bare(x), -1)) - 1)
        columns.append((size_of(F.col(new)) + more).cast("long").alias(count))
    return joined.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")
