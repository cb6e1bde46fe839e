"""Format-preserving pseudonyms for personal data, from DataFrame functions only.

One expression finds all kinds in the original text at once: the leftmost match counts, and of those that start together
the first kind in the order of KINDS. What is found and valid becomes a number of a fixed domain a x b, which a keyed
Feistel network over Z_a x Z_b permutes, and is written in the same format and again valid: card numbers keep their
length, marks and Luhn digit, dates are dates of the calendar, social security numbers have no void part, addresses
have numbers up to 255, phones keep their first two digits and marks, the local part of mail addresses keeps which of
its signs are letters and which are digits. So nothing is touched twice, equal values get equal pseudonyms in all documents, different ones stay different
(mail addresses are read in lower case), the pseudonyms are found where the values were, and back=True with the same
key gives the text back. Shapes that don't hold a valid value stay as they are.

Defined results: a null text stays null with no findings, an empty one stays empty; repeated rows and ids each keep
their row; matches that tie are settled by the order of KINDS; very long texts are read whole, like others; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import spans

ROUNDS = 10
#: The setting that has the key of the registered query.
KEY = "spark.lumigrid.pseudonyms.key"
#: Shapes of each kind. Each begins and ends where no digit or letter goes on.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9])|[./-][0-9])"
ADDRESS = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
CARD = r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z])"
#: Numbers with a country's code, those of North America in their own grouping first; without a code, the full groupings.
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]{0,2}[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
    r"|\+\(?[0-9](?:(?:\) ?[.-]? ?| ?[.-]? ?\(| - | {1,2}|[./-])?[0-9]){7,14}"
    r"|(?<![.-])(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![.-][0-9]))(?![0-9A-Za-z])"
)
#: Dates are permuted within the 400 years from here: 146,097 days, 189 x 773.
FIRST_DAY, DAY_A, DAY_B = "1800-01-01", 189, 773


def _mac(key: str, *parts: Column) -> Column:
    """48 bits of a keyed digest."""
    said = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key))
    return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("long")


def permuted(value: Column, a: int | Column, b: int | Column, key: str, tweak: str | Column, back: bool = False) -> Column:
    """The place of value (0 to a * b - 1) in the keyed permutation; back inverts it."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))
    said = F.lit(tweak) if isinstance(tweak, str) else tweak
    start = F.struct(F.call_function("div", value, b).alias("l"), F.pmod(value, b).cast("long").alias("r"))
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        left = F.pmod(acc["l"] + sign * F.pmod(_mac(key, said, i, acc["r"]), a), a)
        right = F.pmod(acc["r"] + sign * F.pmod(_mac(key, said, i, acc["l"]), b), b)
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(right).alias("r"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, start, step, lambda acc: acc["l"] * b + acc["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column, appended: bool = False) -> Column:
    """The Luhn sum of a digit string; appended: as if a check digit of 0 followed."""
    size = F.length(digits)
    even = 0 if appended else 1  # counted from the right, which digits are doubled

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((size - i) % 2 == even, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), size), worth), F.lit(0), lambda acc, x: acc + x)


def _poured(new: Column, form: Column, sign: str = "[0-9]") -> Column:
    """The signs of new in the places of form's signs."""
    at = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.substring(form, i, F.lit(1)))

    def put(acc: Column, c: Column) -> Column:
        digit = c.rlike(sign)
        return F.struct(F.concat(acc["s"], F.when(digit, F.substring(new, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("s"), (acc["n"] + F.when(digit, 1).otherwise(0)).alias("n"))

    return F.aggregate(at, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), put, lambda acc: acc["s"])


def _permuted_digits(digits: Column, key: str, tweak: str, back: bool) -> Column:
    """A digit string of up to 18 digits, permuted among those of its length."""
    size = F.length(digits)
    a = F.pow(F.lit(10.0), F.floor(size / 2)).cast("long")
    b = F.pow(F.lit(10.0), size - F.floor(size / 2)).cast("long")
    return F.lpad(permuted(digits.try_cast("long"), a, b, key, tweak, back).cast("string"), size, "0")


def card(hit: Column, key: str, back: bool = False) -> Column:
    """Null unless the number passes the Luhn test."""
    digits = _digits(hit)
    body = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", back)
    whole = spans.let(body, lambda x: F.concat(x, F.pmod(-_luhn(x, appended=True), F.lit(10)).cast("string")))
    return F.when(_luhn(digits) % 10 == 0, spans.let(whole, lambda x: _poured(x, hit)))


def phone(hit: Column, key: str, back: bool = False) -> Column:
    """All but the first two digits, the country's, are permuted; null unless there are 8 to 15."""
    digits = _digits(hit)
    rest = _permuted_digits(F.substring(digits, F.lit(3), F.length(digits) - 2), key, "phone", back)
    return F.when(F.length(digits).between(8, 15), spans.let(F.concat(F.substring(digits, 1, 2), rest), lambda x: _poured(x, hit)))


def address(hit: Column, key: str, back: bool = False) -> Column:
    """Null unless each of the four numbers is at most 255, written without leading zeros."""
    parts = F.split(hit, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.try_cast("long"))
    byte = lambda new, k: F.shiftright(new, k).bitwiseAND(F.lit(255).cast("long")).cast("string")
    plain = F.forall(parts, lambda x: (x.try_cast("int") <= 255) & (x == x.try_cast("int").cast("string")))
    return F.when(plain, spans.let(permuted(number, 1 << 16, 1 << 16, key, "address", back), lambda new: F.concat_ws(".", *[byte(new, k) for k in (24, 16, 8, 0)])))


def date(hit: Column, key: str, back: bool = False) -> Column:
    """Null unless it is a date of the calendar within the 400 years; year-month-day, or day and month before the year.

    The day is read first; where that is no date, the month. The latter are permuted among themselves: until the day is
    above 12 again, so that the new date has no other reading either."""
    iso = hit.contains("-")
    mark = F.substring(hit, 3, 1)
    first, second, year = F.substring(hit, 1, 2), F.substring(hit, 4, 2), F.substring(hit, 7, 4)
    month_first = ~iso & second.between("13", "31")
    said = F.when(iso, hit).when(month_first, F.concat_ws("-", year, first, second)).otherwise(F.concat_ws("-", year, second, first))
    days = F.datediff(F.try_to_date(said, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    moved = lambda n: permuted(n, DAY_A, DAY_B, key, "date", back)
    # two in five of all days are below 13, so that 64 more steps never fall short
    again = lambda acc, i: F.when(F.dayofmonth(day(acc)) > 12, acc).otherwise(moved(acc))
    new = spans.let(moved(days), lambda n: day(F.when(month_first, F.aggregate(F.sequence(F.lit(1), F.lit(64)), n, again)).otherwise(n)))
    lead, then = F.when(month_first, F.date_format(new, "MM-dd")).otherwise(F.date_format(new, "dd-MM")), F.date_format(new, "yyyy")
    written = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.substring(lead, 1, 2), mark, F.substring(lead, 4, 2), mark, then))
    return F.when(days.between(0, DAY_A * DAY_B - 1), written)


def social(hit: Column, key: str, back: bool = False) -> Column:
    """Null unless the area is 001 to 899 but 666, the group 01 to 99 and the serial 0001 to 9999."""
    area, group, serial = (F.substring(hit, at, n).try_cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    number = (area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def written(new: Column) -> Column:
        a = F.floor(new / (99 * 9999)).cast("long") + 1
        return F.concat_ws("-", padded(F.when(a >= 666, a + 1).otherwise(a), 3), padded(F.floor(new % (99 * 9999) / 9999).cast("long") + 1, 2), padded(new % 9999 + 1, 4))

    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    return F.when(valid, spans.let(permuted(number, 898, 99 * 9999, key, "social", back), written))


def _by_chunks(signs: Column, base: int, size: int, key: str, tweak: str, back: bool) -> Column:
    """A string of digits of a base, permuted by chunks of `size`; what stands before a chunk in the original is part of its tweak."""
    power = lambda n: F.pow(F.lit(float(base)), n).cast("long")

    def step(acc: Column, i: Column) -> Column:
        own = F.substring(signs, i * size + 1, F.lit(size))
        n, before = F.length(own), acc if back else F.substring(signs, F.lit(1), i * size)
        half = F.floor(n / 2)
        new = permuted(F.conv(own, base, 10).cast("long"), power(half), power(n - half), key, F.concat(F.lit(tweak), before), back)
        return F.concat(acc, F.lower(F.lpad(F.conv(new.cast("string"), 10, base), n, "0")))

    count = F.ceil(F.length(signs) / size).cast("int")
    return F.when(count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), F.lit(""), step)).otherwise(F.lit(""))


def mail(hit: Column, key: str, back: bool = False) -> Column:
    """The letters of the local part, in lower case, are permuted among letters and its digits among digits."""
    local, letters, digits = F.lower(F.substring_index(hit, "@", 1)), "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
    of = lambda sign: F.regexp_replace(local, f"[^{sign}]", "")
    words = F.translate(of("a-z"), letters, digits)
    new = spans.let(_by_chunks(words, 26, 12, key, "mail", back), lambda x: _poured(F.translate(x, digits, letters), local, "[a-z]"))
    numbers = _by_chunks(of("0-9"), 10, 16, key, "mail digits", back)
    whole = spans.let(F.struct(new.alias("new"), numbers.alias("numbers")), lambda x: _poured(x["numbers"], x["new"]))
    return F.concat(whole, F.lit("@"), F.substring_index(hit, "@", -1))


#: name, shape, pseudonym; in the order of their precedence.
KINDS = (("mail", MAIL, mail), ("date", DATE, date), ("address", ADDRESS, address), ("social", SOCIAL, social), ("card", CARD, card), ("phone", PHONE, phone))
EVERY = "|".join(f"(?:{shape})" for _, shape, _ in KINDS)
#: What a text must hold for any kind to occur in it; quick to look for.
HINT = "@|[0-9][0-9 ()./+-]{5}"


def _kind(hit: Column) -> Column:
    """Which of the shapes it was; they exclude each other."""
    return (
        F.when(hit.contains("@"), "mail").when(hit.rlike("^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), "date")
        .when(hit.rlike("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$"), "address").when(hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social")
        .when(hit.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), "card").otherwise("phone")
    )


def pseudonymized(docs: DataFrame, key: str = "example key", back: bool = False, clear: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_pii and a count n_<kind> for each kind, pii (kind:pseudonym of each find, by place),
    text. clear: pii holds what was found instead, which whoever gets the result can then read."""

    def of(hit: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            new = F.when(kind == KINDS[0][0], KINDS[0][2](hit, key, back))
            for name, _, f in KINDS[1:]:
                new = new.when(kind == name, f(hit, key, back))
            return F.struct(kind.alias("kind"), hit.alias("hit"), new.alias("new"))

        return spans.let(_kind(hit), by_kind)

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none = F.array().cast("array<struct<kind:string,hit:string,new:string>>")
    df = df.withColumn("found", F.coalesce(F.when(F.rlike("text", F.lit(HINT)), F.transform(spans.found(F.col("text"), EVERY), lambda x: of(x))), none))
    valid = F.filter("found", lambda x: x["new"].isNotNull())
    df = df.withColumn("valid", valid)
    counts = [F.size(F.filter("valid", _is(name))).cast("long").alias(f"n_{name}") for name, _, _ in KINDS]
    parts = F.zip_with(spans.gaps(F.col("text"), EVERY), F.col("found"), lambda g, x: F.concat(g, F.coalesce(x["new"], x["hit"], F.lit(""))))
    text = F.when(F.size("valid") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    return df.select("doc_id", F.size("valid").cast("long").alias("n_pii"), *counts, F.transform("valid", lambda x: F.concat(x["kind"], F.lit(":"), x["hit" if clear else "new"])).alias("pii"), text.alias("text"))


def _is(name: str):
    return lambda x: x["kind"] == name  # filter() passes an index to functions of two parameters
