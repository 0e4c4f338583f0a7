"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations.

Candidates are found by one pattern and validated: card numbers by Luhn's sum, IBANs by their remainder modulo 97, addresses
of the internet by their octets, social security numbers by their ranges, dates by the calendar, phone numbers by their digit count. What fails stays as it is.
A valid value is taken as a number of its format's domain, split as left * b + right over Z_a x Z_b, and ROUNDS rounds of
left += f(right) mod a, right += f(left) mod b permute the domain exactly (no two values meet, none leaves the format).
f is SHA-256 of key, kind, round and half. Check digits are computed anew. The permutation depends on the key and the value only,
so equal values have equal pseudonyms in all documents; dates are permuted by day, so one day written in two formats stays one day.

- email: letters and digits of the local part, letter for letter and digit for digit; the domain stays.
- secret: hexadecimal values after ``password=``, ``token = "`` and the like, and access key ids, character class for character class.
- phone: the last ten digits; a country code before them stays. card: all digits, the last being Luhn's. iban: account part, new check digits.
- ip: four octets. ssn: area, group and serial in their valid ranges. date: a day of its 400 years (1800 to 2199, 1400 to 1799 and so on: the calendar
  repeats after 400 years). Dates of years before 200 and after 9799 stay.

Strings are permuted in blocks of 9 to 16 characters (left and right half of a block), shorter ones as one block, each character within its class; a
block of one character is moved within its class by a keyed distance. So every string keeps its length and its classes.
Only the values' places change: a text without a valid value is returned as it was, null stays null, empty stays empty. Rows are independent,
so nothing is shuffled, and repeated rows give equal results. Only SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK = 16

#: Values of fixed form that a number before them must not run into.
NEXT = r"(?!\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)|\d{4}-\d{2}-\d{2}(?![\d/-])|\d{1,2}/\d{1,2}/\d{4}(?!\d)|\d{1,2}\.\d{1,2}\.\d{4}(?!\d)|\d{3}-\d{2}-\d{4}(?![\d-])|\d{13,19}(?!\d)|\d{4}([ -])\d{4}[ -]\d{4}[ -]\d{4}(?!\d))".replace("([ -])", "[ -]")
_STEP = rf"\d(?:[.-]| {NEXT})?"
#: Phone numbers of one group in brackets, by the digits before it and in it, so that all have 8 to 15.
_BRACKETS = [rf"(?:{_STEP}){{{i}}}\(\d{{{k}}}\)(?:[.-]| {NEXT})?(?:{_STEP}){{{max(0, 7 - i - k)},{14 - i - k}}}\d(?!\d)" for i in range(7) for k in range(1, 5)]

#: What each kind looks like, in order of precedence.
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}",
    "secret": r"(?i:(?<![A-Za-z])(?:password|passwd|secret|token|api_?key)\s*[=:]\s*\"?)[0-9A-Fa-f]{16,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "card": rf"(?<![\d-])(?:\d{{13,19}}(?![\d-])|\d(?:(?:-| {NEXT})?\d){{12,18}}(?![\d-]))",
    "phone": rf"(?<![\d+])\+?(?:{'|'.join(_BRACKETS)}|(?:{_STEP}|\(\d{{1,4}}\)(?:[.-]| {NEXT})?){{7,14}}\d(?!\d))",
}
PATTERN = "|".join(f"(?:{s})" for s in SHAPES.values())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Struct (l, r) of the permuted halves, 0 <= l < a, 0 <= r < b, all below 10**18."""

    def f(i: Column, half: Column, size: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), size, other, i, half), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    a, b = a.cast("long"), b.cast("long")

    def one(x: Column, i: Column) -> Column:
        even = F.struct(F.pmod(x["l"] + f(i, x["r"], a, b), a).alias("l"), x["r"].alias("r"))
        odd = F.struct(x["l"].alias("l"), F.pmod(x["r"] + f(i, x["l"], b, a), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, one)


def permute_characters(text: Column, key: str, kind: str, letters: str = LOWER) -> Column:
    """The text with digits moved among digits, and letters among ``letters`` (lower) or their capitals; other characters stay."""
    small, capital = letters, letters.upper()

    def classes(c: Column) -> Column:
        """Alphabet of a character; itself alone if it is none of them."""
        return F.when(F.instr(F.lit(DIGITS), c) > 0, DIGITS).when(F.instr(F.lit(small), c) > 0, small).when(F.instr(F.lit(capital), c) > 0, capital).otherwise(c)

    def chars(s: Column) -> Column:
        return F.filter(F.split(s, ""), lambda c: c != "")  # the empty half of a block of one character has none

    def size(s: Column) -> Column:
        return F.aggregate(chars(s), F.lit(1).cast("long"), lambda n, c: n * F.length(classes(c)))

    def number(s: Column) -> Column:
        return F.aggregate(chars(s), F.lit(0).cast("long"), lambda n, c: n * F.length(classes(c)) + F.instr(classes(c), c) - 1)

    def spelled(s: Column, n: Column) -> Column:
        start = F.struct(n.alias("n"), F.lit("").alias("s"))

        def one(x: Column, c: Column) -> Column:
            abc = classes(c)
            return F.struct(
                F.floor(x["n"] / F.length(abc)).cast("long").alias("n"),
                F.concat(F.substring(abc, F.pmod(x["n"], F.length(abc).cast("long")).cast("int") + 1, F.lit(1)), x["s"]).alias("s"),
            )

        return F.aggregate(F.reverse(chars(s)), start, one, lambda x: x["s"])

    def block(s: Column) -> Column:
        half = F.floor(F.length(s) / 2).cast("int")
        parts = F.struct(F.substring(s, F.lit(1), half).alias("x"), F.substring(s, half + 1, F.length(s)).alias("y"))

        def mixed(p: Column) -> Column:
            done = feistel(number(p["x"]), number(p["y"]), size(p["x"]), size(p["y"]), key, kind)
            return let(done, lambda z: F.concat(spelled(p["x"], z["l"]), spelled(p["y"], z["r"])))

        return let(parts, mixed)

    # as few blocks as can be, of about equal length
    n = F.greatest(F.ceil(F.length(text) / BLOCK), F.lit(1))
    edge = lambda i: F.floor(i * F.length(text) / n).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: block(F.substring(text, edge(i) + 1, edge(i + 1) - edge(i))))
    return F.when(F.length(text) > 0, F.array_join(blocks, "")).otherwise(text)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refill(shape: Column, marks: str, filling: Column) -> Column:
    """``shape`` with the characters of class ``marks`` replaced, in order, by those of ``filling``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def one(x: Column, c: Column) -> Column:
        hit = c.rlike(marks)
        return F.struct(F.concat(x["s"], F.when(hit, F.substring(filling, x["at"], F.lit(1))).otherwise(c)).alias("s"), (x["at"] + hit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, one, lambda x: x["s"])


def _luhn(digits: Column) -> Column:
    """Luhn's sum of a digit string, its last digit counted once."""
    d = F.reverse(F.split(digits, ""))
    each = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN string whose letters stand for 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.instr(F.lit(DIGITS), c) - 1).otherwise(F.instr(F.lit(UPPER), c) + 9)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _email(m: Column, key: str) -> Column:
    return F.concat(permute_characters(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[0-9A-Fa-f]{16,}$", 0)
    lead = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    hexadecimal = F.concat(lead, permute_characters(value, key, "secret", "abcdef"))
    return F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), permute_characters(F.substring(m, 5, 16), key, "secret"))).otherwise(hexadecimal)


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")

    def done(p: Column) -> Column:
        account = permute_characters(F.substring(p, F.lit(5), F.length(p)), key, "iban")

        def checked(x: Column) -> Column:
            check = 98 - _mod97(F.concat(x, F.substring(p, 1, 2), F.lit("00")))
            return _refill(m, "[0-9A-Z]", F.concat(F.substring(p, 1, 2), F.lpad(check.cast("string"), 2, "0"), x))

        return F.when((F.length(p) >= 15) & (_mod97(F.concat(F.substring(p, F.lit(5), F.length(p)), F.substring(p, 1, 4))) == 1), let(account, checked))

    return let(plain, done)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    part = lambda i: F.split(m, "[-/.]")[i].cast("int")
    # day first; month first if only that is a date
    day = F.coalesce(F.when(iso, F.try_make_timestamp(part(0), part(1), part(2), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))), F.when(~iso, F.try_make_timestamp(part(2), part(1), part(0), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))))
    swapped = F.when(~iso & day.isNull(), F.try_make_timestamp(part(2), part(0), part(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")))
    found = F.struct(F.coalesce(day, swapped).cast("date").alias("d"), swapped.isNotNull().alias("us"))
    zero = F.lit("1800-01-01").cast("date")

    def done(x: Column) -> Column:
        # 400 years have 146,097 = 189 * 773 days
        days = F.datediff(x["d"], zero)
        n, cycle = F.pmod(days, F.lit(146097)), F.floor(days / 146097)

        def spelled(z: Column) -> Column:
            new = F.date_add(zero, (cycle * 146097 + z["l"] * 773 + z["r"]).cast("int"))
            y, mo, d = F.lpad(F.year(new).cast("string"), 4, "0"), F.month(new), F.dayofmonth(new)
            two = lambda v: F.lpad(v.cast("string"), 2, "0")
            sep = F.when(m.contains("/"), "/").otherwise(".")
            return F.when(iso, F.concat_ws("-", y, two(mo), two(d))).when(x["us"], F.concat(two(mo), sep, two(d), sep, y)).otherwise(F.concat(two(d), sep, two(mo), sep, y))

        return F.when((F.year(x["d"]) >= 200) & (F.year(x["d"]) < 9800), let(feistel(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), key, "date"), spelled))

    return let(found, done)


def _ssn(m: Column, key: str) -> Column:
    part = lambda i: F.split(m, "-")[i].cast("int")
    area, group, serial = part(0), part(1), part(2)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1

    def spelled(z: Column) -> Column:
        a = F.floor(z["l"] / 99) + 1
        a = a + F.when(a > 665, 1).otherwise(0)
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(z["l"] % 99 + 1, 2), pad(z["r"] + 1, 4))

    return F.when(valid, let(feistel(left, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn"), spelled))


def _ip(m: Column, key: str) -> Column:
    o = lambda i: F.split(m, r"\.")[i].cast("int")
    valid = (o(0) < 256) & (o(1) < 256) & (o(2) < 256) & (o(3) < 256)
    done = feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65536), F.lit(65536), key, "ip")
    spelled = lambda z: F.concat_ws(".", F.floor(z["l"] / 256), z["l"] % 256, F.floor(z["r"] / 256), z["r"] % 256)
    return F.when(valid, let(done, spelled))


def _card(m: Column, key: str) -> Column:
    def done(d: Column) -> Column:
        payload = permute_characters(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return let(payload, lambda p: F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))

    def longest(d: Column) -> Column:
        """The digits that are the card's: all, or the first 16 if only they fit and a separator follows them."""
        parted = m.rlike(r"^\d(?:[ -]?\d){15}[ -]")
        return F.when(_luhn(d) % 10 == 0, d).when(parted & (_luhn(F.substring(d, 1, 16)) % 10 == 0), F.substring(d, 1, 16))

    def filled(own: Column) -> Column:
        return F.when(own.isNotNull(), _refill(m, "[0-9]", F.concat(done(own), F.substring(_digits(m), F.length(own) + 1, F.length(m)))))

    return let(let(_digits(m), longest), filled)


def _phone(m: Column, key: str) -> Column:
    def done(d: Column) -> Column:
        own = F.greatest(F.length(d) - 10, F.lit(0))
        new = F.concat(F.substring(d, F.lit(1), own), permute_characters(F.substring(d, own + 1, F.lit(10)), key, "phone"))
        return F.when((F.length(d) >= 8) & (F.length(d) <= 15) & m.rlike(r"[+() .-]"), let(new, lambda x: _refill(m, "[0-9]", x)))

    return let(_digits(m), done)


_KINDS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone}


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` with ``text`` changed, and the column ``replaced`` (in place of one of this name): array of (kind, pseudonym) in the order of the text."""
    docs = docs.drop("replaced")

    def replaced(m: Column) -> Column:
        """(kind, new): kind null and the value itself if it isn't valid."""
        # the first shape that fits decides, so a date that isn't in the calendar is no phone number
        first = None
        for kind, f in _KINDS.items():
            own = F.struct(F.lit(kind).alias("kind"), f(m, key).alias("new"))
            first = (F if first is None else first).when(m.rlike(f"^(?:{SHAPES[kind]})$"), own)
        kept = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
        return let(first, lambda x: F.when(x["new"].isNotNull(), x).otherwise(kept))

    text = F.col("text")
    hit = text.rlike("[0-9@=:]|AKIA") & text.rlike(PATTERN)  # the first is quick, and every shape holds one of these
    rows = docs.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumns(
        {
            "__parts": F.when(F.col("__hit"), F.split("text", PATTERN, -1)),
            "__found": F.when(F.col("__hit"), F.transform(F.regexp_extract_all("text", F.lit(PATTERN), 0), replaced)),
        }
    )
    put = F.array_join(F.flatten(F.transform("__parts", lambda p, i: F.array(p, F.coalesce(F.get("__found", i)["new"], F.lit(""))))), "")
    none = F.array().cast("array<struct<kind:string,new:string>>")
    done = F.coalesce(F.filter("__found", lambda x: x["kind"].isNotNull()), none)
    return rows.select(*(F.coalesce(put, text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), done.alias("replaced"))
