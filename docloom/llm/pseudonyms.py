"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by a keyed Feistel network inside their own format.

The permutation depends on the value and the key alone, so equal values get equal pseudonyms in all documents without any join,
and the whole operator is one map-only projection of native expressions. The key comes in as a scalar subquery over a one-row table, so
that plans, event logs and the user interface name its column and never show its value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: First day and number of days of the date domain: 1800-01-01 and 2**17 days (to 2158).
EPOCH, DAYS_HIGH, DAYS_LOW = "1800-01-01", 512, 256
#: Dates whose day is above 12, from 1800 to 2157: 4296 months with 79,205 such days = 217 * 365.
LATE_MONTHS, LATE_HIGH, LATE_LOW = 4296, 217, 365
#: Valid areas (001 to 899 but 666) times groups (01 to 99), and serials (0001 to 9999), of a social security number.
SSN_HIGH, SSN_LOW = 898 * 99, 9999

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "date_iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "date_slash": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "date_dot": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[2-6][0-9]{3}(?:[0-9]{9,15}|[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def feistel(high: Column, low: Column, n_high: Column, n_low: Column, key: Column, tweak: str) -> Column:
    """struct(high, low): a permutation of the pairs [0, n_high) x [0, n_low), keyed by ``key`` and the format ``tweak``."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        digest = F.sha2(F.concat_ws("|", key, F.lit(tweak), i.cast("string"), n_high.cast("string"), n_low.cast("string"), F.when(even, s["low"]).otherwise(s["high"]).cast("string")), 256)
        f = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(even, F.pmod(s["high"] + F.pmod(f, n_high), n_high)).otherwise(s["high"]).alias("high"),
            F.when(even, s["low"]).otherwise(F.pmod(s["low"] + F.pmod(f, n_low), n_low)).alias("low"),
        )

    start = F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(digits: Column, key: Column, tweak: str) -> Column:
    """Another string of as many digits (2 to 36)."""

    def run(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        s = feistel(d.substr(F.lit(1), u), d.substr(u + 1, n), ten(u), ten(n - u), key, tweak)
        return let(s, lambda x: F.concat(F.lpad(x["high"].cast("string"), u, F.lit("0")), F.lpad(x["low"].cast("string"), n - u, F.lit("0"))))

    return let(digits, run)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``; everything else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(s["out"], F.when(digit, digits.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["at"] + 1).otherwise(s["at"]).alias("at")
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload + digit pass the Luhn test."""
    each = F.transform(F.reverse(F.split(payload, "")), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10)), F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """Remainder by 97 of a string in which letters stand for 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.pmod(r * 100 + code - 55, F.lit(97))).otherwise(F.pmod(r * 10 + code - 48, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def card(value: Column, key: Column) -> Column:
    """Keeps the first digit and the separators, permutes the rest and recomputes the check digit; null unless the number passes Luhn."""

    def run(d: Column) -> Column:
        n = F.length(d)
        moved = F.concat(d.substr(1, 1), permute_digits(d.substr(F.lit(2), n - 2), key, "card"))
        return F.when(n.between(13, 19) & F.call_function("luhn_check", d), refill(value, let(moved, lambda p: F.concat(p, luhn_digit(p)))))

    return let(digits_of(value), run)


def phone(value: Column, key: Column) -> Column:
    """Permutes the last ten digits; a country code in front stays. A text with other than 7 to 15 digits is no number."""

    def run(d: Column) -> Column:
        n = F.length(d)
        kept = F.greatest(n - 10, F.lit(0))
        return F.when(n.between(7, 15), refill(value, F.concat(d.substr(F.lit(1), kept), permute_digits(d.substr(kept + 1, n), key, "phone"))))

    return let(digits_of(value), run)


def ip(value: Column, key: Column) -> Column:
    def run(p: Column) -> Column:
        o = [F.element_at(p, i).cast("long") for i in range(1, 5)]
        s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
        return let(s, lambda x: F.concat_ws(".", *[F.shiftright(x[h], b).bitwiseAND(F.lit(255)).cast("string") for h in ("high", "low") for b in (8, 0)]))

    return let(F.split(value, r"\."), run)


def date(value: Column, pattern: str, key: Column, tweak: str) -> Column:
    """Another valid date between 1800 and 2158 in the same format; null unless ``value`` is one."""

    def run(day: Column) -> Column:
        n = F.datediff(day, F.lit(EPOCH).cast("date"))
        s = feistel(F.floor(n / DAYS_LOW), F.pmod(n, F.lit(DAYS_LOW)), F.lit(DAYS_HIGH).cast("long"), F.lit(DAYS_LOW).cast("long"), key, tweak)
        moved = let(s, lambda x: F.date_format(F.date_add(F.lit(EPOCH).cast("date"), (x["high"] * DAYS_LOW + x["low"]).cast("int")), pattern))
        return F.when((n >= 0) & (n < DAYS_HIGH * DAYS_LOW), moved)

    return let(F.try_to_timestamp(value, F.lit(pattern)).cast("date"), run)


def late_date(value: Column, key: Column) -> Column:
    """Another dd/MM/yyyy date with a day above 12, from 1800 to 2157; null unless ``value`` is one.

    Such dates are numbered in order: ``first(m)`` is the number of the first one of month m."""
    epoch = F.lit(EPOCH).cast("date")
    first = lambda m: F.datediff(F.add_months(epoch, m), epoch) - 12 * m

    def back(n: Column) -> Column:
        guess = F.floor(n * LATE_MONTHS / (LATE_HIGH * LATE_LOW)).cast("int")
        near = F.filter(F.sequence(F.greatest(guess - 2, F.lit(0)), guess + 2), lambda m: first(m) <= n)
        return let(F.array_max(near), lambda m: F.date_format(F.date_add(F.add_months(epoch, m), (n - first(m)).cast("int") + 12), "dd/MM/yyyy"))

    def run(day: Column) -> Column:
        month = (F.year(day) - 1800) * 12 + F.month(day) - 1
        n = first(month) + F.dayofmonth(day) - 13
        s = feistel(F.floor(n / LATE_LOW), F.pmod(n, F.lit(LATE_LOW)), F.lit(LATE_HIGH).cast("long"), F.lit(LATE_LOW).cast("long"), key, "date/d")
        return F.when((F.dayofmonth(day) > 12) & month.between(0, LATE_MONTHS - 1), let(s, lambda x: let((x["high"] * LATE_LOW + x["low"]).cast("int"), back)))

    return let(F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).cast("date"), run)


def ssn(value: Column, key: Column) -> Column:
    def run(p: Column) -> Column:
        area, group, serial = (F.element_at(p, i).cast("long") for i in (1, 2, 3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        rank = area - 1 - F.when(area > 666, 1).otherwise(0)
        s = feistel(rank * 99 + group - 1, serial - 1, F.lit(SSN_HIGH).cast("long"), F.lit(SSN_LOW).cast("long"), key, "ssn")

        def back(x: Column) -> Column:
            r = F.floor(x["high"] / 99)
            return F.concat_ws("-", F.lpad((r + 1 + F.when(r >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.pmod(x["high"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((x["low"] + 1).cast("string"), 4, "0"))

        return F.when(valid, let(s, back))

    return let(F.split(value, "-"), run)


def iban(value: Column, key: Column) -> Column:
    """Permutes all digits behind the check digits, which are recomputed; letters stay. Null unless the remainder by 97 is 1."""

    def run(v: Column) -> Column:
        n = F.length(v)
        country, body = v.substr(1, 2), v.substr(F.lit(5), n)
        own = digits_of(body)
        fits = n.between(15, 34) & v.substr(3, 2).cast("int").between(2, 98) & (mod97(F.concat(body, v.substr(1, 4))) == 1) & (F.length(own) >= 2)

        def back(moved: Column) -> Column:
            check = F.lit(98) - mod97(F.concat(refill(body, moved), country, F.lit("00")))
            return refill(value, F.concat(F.lpad(check.cast("string"), 2, "0"), moved))

        return F.when(fits, let(permute_digits(own, key, "iban"), back))

    return let(F.regexp_replace(value, " ", ""), run)


def email(value: Column, key: Column) -> Column:
    """Letters and digits of the local part move inside their own class by an alternating keyed shift of its halves; the domain stays."""

    def shift(chars: Column, other: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, F.lit("email"), i.cast("string"), F.array_join(other, "")), 256)

        def one(c: Column, j: Column) -> Column:
            by = F.conv(digest.substr(F.pmod(j, F.lit(15)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            turn = lambda base, size: F.chr(F.pmod(code - base + by, F.lit(size)) + base)
            return F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).when(c.rlike("[0-9]"), turn(48, 10)).otherwise(c)

        return F.transform(chars, one)

    def run(local: Column) -> Column:
        chars = F.split(local, "")
        half = F.ceil(F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars)).alias("b"))

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            return F.struct(F.when(even, shift(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(shift(s["b"], s["a"], i)).alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))

    return F.concat(let(F.substring_index(value, "@", 1), run), F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(value: Column, key: Column) -> Column:
    """struct(kind, to) for one match of ANY; null where it isn't valid as any kind."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    tries = [
        ("email", email(value, key)),
        ("ip", ip(value, key)),
        ("date_iso", date(value, "yyyy-MM-dd", key, "date-")),
        # month first where that is a date; the rest have a day above 12 in front and stay so, so the two readings never meet
        ("date_slash", F.coalesce(date(value, "MM/dd/yyyy", key, "date/m"), late_date(value, key))),
        ("date_dot", date(value, "dd.MM.yyyy", key, "date.")),
        ("ssn", ssn(value, key)),
        ("phone", phone(value, key)),
        ("iban", iban(value, key)),
        ("card", card(value, key)),
    ]
    first = reduce(lambda out, t: out.when(value.rlike(whole[t[0]]), F.struct(F.lit(t[0]).alias("kind"), t[1].alias("to"))), tries[1:], F.when(value.rlike(whole[tries[0][0]]), F.struct(F.lit(tries[0][0]).alias("kind"), tries[0][1].alias("to"))))
    return let(first, lambda s: F.when(s["to"].isNotNull(), s))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's personal values replaced, plus n_replaced (long) and kinds (array of strings, one a value, in text order).

    Replaced: e-mail local parts, IPv4 addresses, dates of three formats (1800 to 2157 at least), social security, phone, IBAN and card numbers, each only if
    valid (calendar, ranges, remainder by 97, Luhn). Invalid look-alikes stay. Whoever lacks ``key`` can't invert the permutation.
    Null texts stay null with n_replaced 0; texts without a value, empty ones too, stay as they are; texts of any length are replaced as a whole.
    Map-only: no shuffle, each row by itself, so repeated rows are treated alike. Existing columns n_replaced and kinds are replaced.
    """
    docs = docs.drop("n_replaced", "kinds")
    text = F.col(text_col)
    secret = docs.sparkSession.createDataFrame([(key,)], "secret string").scalar()
    # lambdas take the key from a column, since subqueries may not stand inside them; every kind of value holds a digit or an @
    found = docs.withColumn("__found", F.when(text.rlike("[0-9@]") & text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))).withColumn("__key", F.when(F.col("__found").isNotNull(), secret))
    held = found.withColumn("__hits", F.transform("__found", lambda v: F.struct(v.alias("was"), pseudonym(v, F.col("__key")).alias("now"))))
    hits = F.col("__hits")
    swapped = F.array_join(F.zip_with(F.split(text, ANY, -1), hits, lambda part, h: F.concat(part, F.coalesce(h["now"]["to"], h["was"], F.lit("")))), "")
    kinds = F.filter(F.transform(hits, lambda h: h["now"]["kind"]), lambda k: k.isNotNull())
    return held.select(
        *[F.when(hits.isNotNull(), swapped).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_replaced"),
        F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"),
    )
