"""PII pseudonyms by format-preserving Feistel permutations, in DataFrame functions only.

Numbers and dates that prove valid are replaced by others of the same format: a keyed Feistel network permutes them
within the valid ones of their format, so equal values stay equal in all documents, different ones stay different, and
who holds the key can go back. Kinds and what proves them:

* payment cards: Luhn digit, made anew so that the result is valid too
* telephone numbers: of ten digits, area and exchange not 000 (an area code that isn't in use may be a slip of the pen
  and is treated like any other); international ones (+ and 8 to 15 digits), which keep their first two digits
* social security numbers: area not 000, 666 or over 899, group not 00, serial not 0000
* IPv4 addresses: four bytes
* calendar dates, permuted within their block of 400 Gregorian years
* mail addresses: no empty label in the domain, which stays; letters of the name become letters and digits digits.
  Names are taken in lower case, as mail is delivered.

All else stays as it is, byte for byte. A text is split at the matches and joined again in its row: nothing is
shuffled or collected, and texts without a match are handed on. No pattern repeats a group without bound, so a match
takes the same stack however long the text is.

Defined cases: null text stays null, without values; an empty text stays; rows that are the same give the same; an
empty table gives no rows; extra columns are kept, one named pii too: the operator's own is then called _pii; numbers
that fail their check stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, read

KEY = "not a secret: set your own"
ROUNDS = 8
#: The kinds, each a pattern of its own; the first that fits a match from start to end names it.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "date": r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|(?<![0-9])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "phone": r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])|(?<![0-9+])\+(?:1[0-9]{10}|[2-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Four groups of four and a shorter one: a number of 17 to 19 digits, or one of 16 with another number after it.
FOLLOWED = r"^[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}$"
#: The days of 400 Gregorian years, and two factors of it; day 0 of the blocks is 2000-03-01.
CYCLE, CYCLE_A, CYCLE_B = 146097, 189, 773


def prf(key: str, tweak: Column, i: Column, x: Column) -> Column:
    """48 bits that the key, the kind, the round and the other half decide."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("long")


def feistel(key: str, tweak: Column, a: Column, a_size: Column, b: Column, b_size: Column) -> Column:
    """struct<a, b>: (a, b) permuted on a_size times b_size by turns; each round adds what the other half decides."""

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        new = F.pmod(F.when(even, acc["a"]).otherwise(acc["b"]) + prf(key, tweak, i, F.when(even, acc["b"]).otherwise(acc["a"])), F.when(even, a_size).otherwise(b_size))
        return F.struct(F.when(even, new).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(new).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The sum of which a valid number's is a multiple of 10; the last digit counts once."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def permute_digits(key: str, tweak: Column, digits: Column) -> Column:
    """Digits of any length from 2 to 36 as others of that length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k.cast("double")).cast("long")
    out = feistel(key, tweak, F.substr(digits, F.lit(1), half), size(half), F.substr(digits, half + 1, n - half), size(n - half))
    return F.aggregate(F.array(out), F.lit(""), lambda _, s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), n - half, "0")))


def in_format(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in their order."""
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    return F.aggregate(F.split(shape, "(?!^)"), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda acc: acc["out"])


def _card(key: str, value: Column) -> Column:
    def made(digits: Column) -> Column:
        body = permute_digits(key, F.lit("card"), F.substr(digits, F.lit(1), F.length(digits) - 1))
        return F.aggregate(F.array(body), F.lit(""), lambda _, b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    valid = lambda d: luhn_sum(d) % 10 == 0
    digits = _digits(value)
    card, rest = F.substr(digits, F.lit(1), F.lit(16)), F.substr(digits, F.lit(17))
    # the next in the cycle that isn't valid together with the rest, which would be read as one number
    alone = F.aggregate(F.sequence(F.lit(1), F.lit(40)), made(card), lambda acc, _: F.when(valid(F.concat(acc, rest)), made(acc)).otherwise(acc))
    return F.when(valid(digits), in_format(value, made(digits))).when(value.rlike(FOLLOWED) & valid(card), in_format(value, F.concat(alone, rest))).otherwise(value)


def _joined(pair: Column, text: Callable[[Column], Column]) -> Column:
    """text of a pair that is worked out once."""
    return F.aggregate(F.array(pair), F.lit(""), lambda _, s: text(s))


def _phone(key: str, value: Column) -> Column:
    digits = _digits(value)
    ten = F.right(digits, F.lit(10))
    part = lambda at, n: F.substr(ten, F.lit(at), F.lit(n)).cast("long")
    out = feistel(key, F.lit("phone"), part(1, 3) - 1, F.lit(999), (part(4, 3) - 1) * 10000 + part(7, 4), F.lit(9_990_000))
    made = _joined(out, lambda s: F.concat(F.lpad((s["a"] + 1).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 10000) + 1).cast("string"), 3, "0"), F.lpad((s["b"] % 10000).cast("string"), 4, "0")))
    far = value.startswith("+") & ~value.startswith("+1")
    abroad = in_format(value, F.concat(F.left(digits, F.lit(2)), permute_digits(key, F.lit("abroad"), F.substr(digits, F.lit(3)))))
    return (
        F.when(far & F.length(digits).between(8, 15), abroad)
        .when(~far & (part(1, 3) > 0) & (part(4, 3) > 0), in_format(value, F.concat(F.when(value.startswith("+"), "1").otherwise(""), made)))
        .otherwise(value)
    )


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = (F.substr(value, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    out = feistel(key, F.lit("ssn"), area - F.when(area > 666, 2).otherwise(1), F.lit(898), (group - 1) * 9999 + serial - 1, F.lit(99 * 9999))
    three = lambda a: F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0")
    made = _joined(out, lambda s: F.concat_ws("-", three(s["a"]), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), made).otherwise(value)


def _ip(key: str, value: Column) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    get = lambda i: F.element_at(part, i)
    out = feistel(key, F.lit("ip"), get(1) * 256 + get(2), F.lit(65536), get(3) * 256 + get(4), F.lit(65536))
    octets = lambda x: F.concat_ws(".", F.shiftright(x, 8).cast("string"), x.bitwiseAND(F.lit(255).cast("long")).cast("string"))
    return F.when(F.array_max(part) <= 255, F.aggregate(F.array(out), F.lit(""), lambda _, s: F.concat_ws(".", octets(s["a"]), octets(s["b"])))).otherwise(value)


def _date(key: str, value: Column) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    dmy = F.concat_ws("-", F.substr(value, F.lit(7), F.lit(4)), F.substr(value, F.lit(4), F.lit(2)), F.substr(value, F.lit(1), F.lit(2)))
    mdy = F.concat_ws("-", F.substr(value, F.lit(7), F.lit(4)), F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(4), F.lit(2)))
    day = lambda s: F.datediff(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"), F.lit("2000-03-01").cast("date"))

    def moved(n: Column, form: str) -> Column:
        block, at = F.floor(n / CYCLE).cast("long"), F.pmod(n, F.lit(CYCLE))
        out = feistel(key, F.lit("date"), F.floor(at / CYCLE_B), F.lit(CYCLE_A), at % CYCLE_B, F.lit(CYCLE_B))
        return F.aggregate(F.array(out), F.lit(""), lambda _, s: F.date_format(F.date_add(F.lit("2000-03-01").cast("date"), (block * CYCLE + s["a"] * CYCLE_B + s["b"]).cast("int")), form))

    signs = lambda s: F.regexp_replace(s, "/", F.substr(value, F.lit(3), F.lit(1)))
    return (
        F.when(iso & day(value).isNotNull(), moved(day(value), "yyyy-MM-dd"))
        .when(~iso & day(dmy).isNotNull(), signs(moved(day(dmy), "dd/MM/yyyy")))
        .when(~iso & day(mdy).isNotNull(), signs(moved(day(mdy), "MM/dd/yyyy")))
        .otherwise(value)
    )


def _email(key: str, value: Column) -> Column:
    """The name's places are dealt into even and odd ones; by turns each of the one kind is moved on by what the others decide."""
    name, domain = F.lower(F.substring_index(value, "@", 1)), F.substring_index(value, "@", -1)
    tweak = F.concat(F.lit("email "), F.lower(domain))

    def coded(c: Column) -> Column:
        size = F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[a-z]$"), 26).otherwise(1)
        return F.struct(c.alias("c"), size.alias("size"), F.when(size > 1, F.ascii(c) - F.when(size == 10, ord("0")).otherwise(ord("a"))).otherwise(0).alias("x"))

    def turn(acc: Column, i: Column) -> Column:
        moves = lambda p: p % 2 == i % 2
        others = F.array_join(F.transform(F.filter(acc, lambda s, p: ~moves(p)), lambda s: s["x"].cast("string")), ",")
        drawn = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), others), 256)
        step = lambda s, p, h: F.conv(F.substr(h, F.floor(p / 2).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = lambda h: F.transform(acc, lambda s, p: F.struct(s["c"].alias("c"), s["size"].alias("size"), F.when(moves(p), (s["x"] + step(s, p, h)) % s["size"]).otherwise(s["x"]).alias("x")))
        return F.element_at(F.transform(F.array(drawn), moved), 1)

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.transform(F.filter(F.split(name, "(?!^)"), lambda c: c != ""), coded), turn)
    letter = lambda s: F.when(s["size"] == 1, s["c"]).otherwise(F.char(s["x"] + F.when(s["size"] == 10, ord("0")).otherwise(ord("a"))))
    return F.when(F.instr(domain, "..") == 0, F.concat(F.array_join(F.transform(out, letter), ""), F.lit("@"), domain)).otherwise(value)


MAKERS: dict[str, Callable[[str, Column], Column]] = {"email": _email, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def _named(kind: str, before: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.when(x != before, F.lit(kind)).alias("kind"), x.alias("value"))


def pseudonym(key: str, value: Column) -> Column:
    """struct<kind, value> for a match of ANY; kind is null where it fails its check and stays."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, pattern in reversed(PATTERNS.items()):
        bare = pattern.replace(r"(?<![A-Za-z0-9._%+-])", "")
        made = F.element_at(F.transform(F.array(MAKERS[kind](key, value)), _named(kind, value)), 1)
        out = F.when(value.rlike(f"^(?:{bare})$"), made).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with the new text, and pii: array<struct<kind, value>>, what now stands at each match (kind null: stayed)."""
    text, pii, found = F.col("text"), free("pii", docs), free("__found", docs)
    matched = docs.withColumn(found, F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    made = matched.withColumn(pii, F.when(F.col(found).isNotNull(), F.transform(found, lambda v: pseudonym(key, v))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")))
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(pieces, pii, lambda s, p: F.concat(s, F.coalesce(p["value"], F.lit("")))), "")
    return made.withColumn("text", F.when(F.col(found).isNotNull(), joined).otherwise(text)).drop(found)


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *map(count, PATTERNS))
