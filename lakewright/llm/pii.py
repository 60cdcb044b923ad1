"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Mentions are found by one pattern per kind, joined into one so that they never
overlap. A value's surrogate is a keyed permutation of all values of its shape,
so different values stay different whatever the corpus holds, the same value is
the same everywhere, and nothing has to be drawn again, joined or shuffled. A
shape says which characters are of which class: digits become digits, letters
become letters of their script, octets octets of their length; separators,
country codes, top-level domains and the case of each letter stay.

The permutation is ``P^-1 (P(value) + 1)``, where P is a Feistel network over
the characters' places in their classes: a bijection of the shape without a
fixed point. Check digits are made anew, at the distance from the right ones
that the value's had, so valid cards and IBANs stay valid ones.

Names keep their title, their last letters (so their gender), vowels and
consonants. A name that a title introduces is replaced wherever the text has it
again, with title or without.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import spare, table

KEY = "surrogates-1"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles, as texts write them. Fixed values.
TITLES = (
    *("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н"),
    *("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "г-жа"),
    *("Dr", "Prof", "Mx"),
)
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
#: kind -> pattern, in order of precedence. Fixed values.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ip": rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\p{{N}})",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}-])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every mention but a name holds a digit or an @; every name one of the titles.
_INITIALS = "".join(sorted({t[0] for t in TITLES}))
TITLED = rf"(?=[{_INITIALS}])(?:{_TITLE})\.? \p{{Lu}}"
#: A family name stands for its owner without a title from so many letters on.
BARE_NAME = 3
#: Classes of characters, and for names vowels and consonants apart. Fixed values.
CLASSES = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "αβγδεζηθικλμνξοπρστυφχψω",
)
NAME_CLASSES = (
    "aeiouy",
    "bcdfghjklmnpqrstvwxz",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ",
    "çðñþ",
    "аеиоуыэюяё",
    "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
)
#: Scripts that are classes by their code points (first, last). Fixed values.
RANGES = (
    (0x05D0, 0x05EA),
    (0x0621, 0x064A),
    (0x0904, 0x0939),
    (0x3041, 0x3096),
    (0x30A1, 0x30FA),
    (0x4E00, 0x9FFF),
    (0xAC00, 0xD7A3),
)
#: Rounds of the Feistel network, there and back.
ROUNDS = 4
#: The country code of a number without separators, as ITU E.164 deals them. Fixed value.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d)"
SEPARATORS = r"[^\p{L}\p{N}]"


def find(text: Column, pattern: Column | None = None) -> Column:
    """array<string> of the mentions in order."""
    return F.regexp_extract_all(text, F.lit(ANY) if pattern is None else pattern, 0)


def has_mention(text: Column) -> Column:
    """Whether ``find`` finds anything; what cheap tests rule out is not matched."""
    may = text.contains("@") | text.rlike("[0-9]") | text.rlike(TITLED)
    return F.coalesce(may & text.rlike(ANY), F.lit(False))


def pattern_of(text: Column) -> Column:
    """The pattern of a text's mentions: ANY, and the names its titles introduce."""
    titled = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), 0)
    bare = F.transform(titled, lambda m: F.regexp_replace(m, r"^\S+ ", ""))
    full = F.filter(bare, lambda m: F.contains(m, F.lit(" ")))
    family = F.filter(F.transform(bare, lambda m: F.substring_index(m, " ", -1)), lambda m: F.length(m) >= BARE_NAME)
    again = F.array_join(F.array_distinct(F.concat(full, family)), "|")
    with_names = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}-])(?:"), again, F.lit(r")(?![\p{L}\p{N}-])"))
    return F.when(text.rlike(TITLED) & (again != ""), with_names).otherwise(F.lit(ANY))


def kind_of(found: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(found.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def _numbers(values) -> Column:
    """A constant array<int>; made as one expression, for a literal each costs the driver a call."""
    return F.expr(f"array({', '.join(map(str, values))})")


def _slots(chars: Column, classes: tuple[str, ...], lead: bool) -> Column:
    """array<struct(at, base, size)>: each character's place in its class; size 0 stays as it is."""
    every = "".join(classes)
    base = [len("".join(classes[:k])) for k, c in enumerate(classes) for _ in c]
    size = [len(c) for c in classes for _ in c]

    def slot(at: Column, base_: Column, size_: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), base_.cast("int").alias("base"), size_.cast("int").alias("size"))

    def one(c: Column, i: Column) -> Column:
        p, code = F.instr(F.lit(every), c), F.ascii(c)
        out = slot(F.lit(0), F.lit(0), F.lit(0))
        for k, (first, last) in enumerate(RANGES):
            out = F.when(code.between(first, last), slot(code - first, F.lit(1000 + k), F.lit(last - first + 1))).otherwise(out)
        start = F.element_at(_numbers(base), p)
        out = F.when(p > 0, slot(p - 1 - start, start, F.element_at(_numbers(size), p))).otherwise(out)
        if lead:
            # A number's first digit stays 0 or not 0.
            zero = slot(F.lit(0), F.lit(0), F.lit(0))
            out = F.when((i == 0) & (c == "0"), zero).when((i == 0) & (p > 1) & (p <= 10), slot(p - 2, F.lit(1), F.lit(9))).otherwise(out)
        return F.when(c == "", slot(F.lit(0), F.lit(0), F.lit(0))).otherwise(out)

    return F.transform(chars, one)


def _permuted(slots: Column, tag: Column, key: str) -> Column:
    """array<int>: the places that the keyed permutation gives, for a column variable ``slots``."""
    n = F.size(slots)
    half = (n / 2).cast("int")
    shape = F.array_join(F.transform(slots, lambda s: F.concat_ws(".", s["base"].cast("string"), s["size"].cast("string"))), ",")

    def rounds(prefix: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            turn = F.when(j < ROUNDS, j).otherwise(2 * ROUNDS - j)
            sign = F.when(j < ROUNDS, 1).otherwise(-1)
            left = turn % 2 == 0
            half_of = F.transform(acc, lambda x, i: F.when((i < half) == left, x.cast("string")).otherwise(""))
            seed = F.sha2(F.concat_ws("/", prefix, turn.cast("string"), F.array_join(half_of, ",")).cast("binary"), 256)
            block = lambda seed: F.transform(
                F.sequence(F.lit(0), (n / 16).cast("int")), lambda b: F.sha2(F.concat(seed, b.cast("string")).cast("binary"), 256)
            )

            def moved(stream: Column) -> Column:
                word = lambda i: F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.transform(
                    acc,
                    lambda x, i: F.when(slots[i]["size"] == 0, x)
                    .when(j == ROUNDS, (x + 1) % slots[i]["size"])
                    .when((i < half) == left, x)
                    .otherwise(F.pmod(x + sign * word(i), slots[i]["size"])),
                )

            return _let(F.array_join(_let(seed, block), ""), moved)

        start = F.transform(slots, lambda s: s["at"])
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), start, step)

    return _let(F.concat_ws("\x1f", F.lit(key), tag, shape), rounds)


def _swapped(
    text: Column, tag: Column, key: str, *, classes=CLASSES, lead: bool = False, upto: Column | None = None
) -> Column:
    """``text`` (lower case) with each character before ``upto`` (from 0) replaced within its class."""
    every = "".join(classes)
    chars = F.split(text, "")
    if upto is not None:
        chars = F.transform(chars, lambda c, i: F.when(i < upto, c).otherwise(""))

    def put(at: Column, slot: Column) -> Column:
        first = F.element_at(_numbers(a for a, _ in RANGES), slot["base"] - 999)
        code = F.lpad(F.hex((first + at).cast("long")), 8, "0")
        return F.when(slot["base"] >= 1000, F.decode(F.unhex(code), "UTF-32")).otherwise(
            F.substr(F.lit(every), slot["base"] + at + 1, F.lit(1))
        )

    def done(slots: Column) -> Column:
        new = F.zip_with(_permuted(slots, tag, key), slots, lambda at, s: F.when(s["size"] > 0, put(at, s)))
        return F.array_join(F.zip_with(F.split(text, ""), new, lambda c, x: F.coalesce(x, c)), "")

    return _let(_slots(chars, classes, lead), done)


def _octets(text: Column, tag: Column, key: str) -> Column:
    def slot(o: Column) -> Column:
        base = F.when(F.length(o) == 3, 100).when(F.length(o) == 2, 10).otherwise(0)
        size = F.when(F.length(o) == 3, 156).when(F.length(o) == 2, 90).otherwise(10)
        return F.struct((o.cast("int") - base).alias("at"), base.alias("base"), size.alias("size"))

    join = lambda slots: F.array_join(
        F.zip_with(_permuted(slots, tag, key), slots, lambda at, s: (at + s["base"]).cast("string")), "."
    )
    return _let(F.transform(F.split(text, r"\."), slot), join)


def luhn(payload: Column) -> Column:
    """The check digit that belongs behind a string of digits."""
    m = F.length(payload)
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    one = lambda c, i: F.when((m - 1 - i) % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(payload, ""), one), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def iban_check(account: Column, country: Column) -> Column:
    """The two check digits, as a number, of a lower-case account number and country."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 87)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return 98 - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)


def _card(digits: Column, key: str) -> Column:
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    off = F.pmod(F.substring(digits, -1, 1).cast("int") - luhn(payload), F.lit(10))
    new = lambda off: _let(
        _swapped(payload, F.concat(F.lit("card"), off.cast("string")), key, lead=True),
        lambda p: F.concat(p, ((luhn(p) + off) % 10).cast("string")),
    )
    return _let(off, new)


def _iban(value: Column, key: str) -> Column:
    country, account = F.substring(value, 1, 2), F.substr(value, F.lit(5))
    off = F.pmod(F.substring(value, 3, 2).cast("int") - iban_check(account, country), F.lit(100))
    new = lambda off: _let(
        _swapped(account, F.concat(F.lit("iban"), country, off.cast("string")), key),
        lambda a: F.concat(country, F.lpad((F.pmod(iban_check(a, country) + off, F.lit(100))).cast("string"), 2, "0"), a),
    )
    return _let(off, new)


def _phone(value: Column, key: str) -> Column:
    own = _swapped(F.regexp_replace(value, COUNTRY, ""), F.lit("phone"), key, lead=True)
    return F.concat(F.regexp_extract(value, COUNTRY, 0), own)


def _name(found: Column, key: str) -> Column:
    def one(word: Column, i: Column) -> Column:
        title = (i == 0) & F.regexp_replace(word, r"\.$", "").isin(*TITLES)
        size = F.length(word)
        upto = size - F.when(size >= 4, 2).otherwise(1)
        return F.when(title, word).otherwise(
            recase(word, _swapped(F.lower(word), F.lit("name"), key, classes=NAME_CLASSES, upto=upto))
        )

    return F.array_join(F.transform(F.split(found, " "), one), " ")


def value_of(kind: Column, found: Column) -> Column:
    """What a mention names, without case and separators; of a name its words without title."""
    bare = F.regexp_replace(F.lower(found), r"[^\p{L}\p{N}+]", "")
    words = F.filter(
        F.split(found, " "), lambda w, i: ~((i == 0) & F.regexp_replace(w, r"\.$", "").isin(*TITLES))
    )
    name = F.lower(F.array_join(words, " "))
    return F.when(kind.isin("ssn", "phone", "iban", "card"), bare).when(kind == "name", name).otherwise(F.lower(found))


def surrogate(kind: Column, found: Column, key: str = KEY) -> Column:
    """The replacement of a mention, in its format and case. Pass column variables or columns."""
    low = F.lower(found)
    bare = F.regexp_replace(low, r"[^\p{L}\p{N}+]", "")
    top_level = F.length(low) - F.length(F.substring_index(low, ".", -1))
    laid = lambda new: recase(found, _laid(found, new))
    return (
        F.when(kind == "ip", _octets(found, F.lit("ip"), key))
        .when(kind == "email", recase(found, _swapped(low, F.lit("email"), key, upto=top_level)))
        .when(kind == "phone", _let(_phone(bare, key), laid))
        .when(kind == "ssn", _let(_swapped(bare, F.lit("ssn"), key, lead=True), laid))
        .when(kind == "card", _let(_card(bare, key), laid))
        .when(kind == "iban", _let(_iban(bare, key), laid))
        .otherwise(_name(found, key))
    )


def recase(like: Column, new: Column) -> Column:
    """``new`` with capitals where ``like`` has them, character by character."""
    return F.array_join(
        F.zip_with(F.split(like, ""), F.split(new, ""), lambda a, b: F.when(a == F.lower(a), b).otherwise(F.upper(b))), ""
    )


def _laid(found: Column, new: Column) -> Column:
    """The letters and digits of ``new`` one by one in the places of those of ``found``."""
    bare = F.regexp_replace(new, SEPARATORS, "")
    nth = lambda i: F.length(F.regexp_replace(F.substr(found, F.lit(1), i + 1), SEPARATORS, ""))
    put = lambda c, i: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.substr(bare, nth(i), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(found, ""), put), "")


def clashes(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, surrogate, n): surrogates that more than one value of (found) would get. Empty, or a fault.

    Null mentions count as none. An empty table gives no rows.
    """
    kind = mentions.filter("found is not null").select("found", kind_of(F.col("found")).alias("kind"))
    new = kind.distinct().select("kind", "found", surrogate(F.col("kind"), F.col("found"), key).alias("new"))
    own = new.select(
        "kind", value_of(F.col("kind"), F.col("found")).alias("value"), value_of(F.col("kind"), F.col("new")).alias("surrogate")
    )
    return own.distinct().groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def replace_pii(docs: DataFrame, key: str = KEY, *, check: bool = True) -> DataFrame:
    """``docs`` (text, ...) with surrogates in text, plus n_entities (long).

    One projection, so nothing is shuffled; ``check`` runs an action before it
    that raises if two values would share a surrogate. Texts without mentions,
    null and empty ones too, come back as they were with 0. Repeated rows come
    back alike; an empty table gives no rows; other columns pass, but for a
    column n_entities, which is replaced.
    """
    rest = [c for c in docs.columns if c.lower() != "n_entities"]
    text = F.col("text")
    pattern, found = spare(docs, "pattern"), spare(docs, "found")
    marked = docs.select(*[F.col(f"`{c}`") for c in rest], F.when(has_mention(text), pattern_of(text)).alias(pattern))
    if check:
        said = marked.filter(F.col(pattern).isNotNull()).select(F.explode(find(text, F.col(pattern))).alias("found"))
        if clashes(said, key).limit(1).count():
            raise ValueError("two values would share a surrogate")
    marked = marked.withColumn(found, F.when(F.col(pattern).isNotNull(), find(text, F.col(pattern))))
    new = F.transform(F.col(found), lambda m: _let(kind_of(m), lambda k: surrogate(k, m, key)))
    whole = F.zip_with(F.split(text, F.col(pattern), -1), new, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit(""))))
    out = [F.coalesce(F.array_join(whole, ""), text).alias(c) if c == "text" else F.col(f"`{c}`") for c in rest]
    return marked.select(*out, F.coalesce(F.greatest(F.size(found), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs)
