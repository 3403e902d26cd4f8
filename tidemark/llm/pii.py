r"""Operator 4: personal data by format-preserving Feistel pseudonyms. DataFrame functions only.

Numbers and dates that pass their validation are permuted within the valid values of their format by a keyed Feistel network: two parts of the value, of a and b values, take turns in
adding a keyed hash of the other part, which permutes a * b values for any a and b. Equal values get equal pseudonyms everywhere, different values different ones, and the key turns them
back (`restore`). Check digits are computed anew, so pseudonyms pass the same validation; what fails it stays as it is. Mail names and secrets, which have no number format, are permuted
letter by letter within their alphabets by the same network over their characters.

| kind | found and validated | permuted |
| --- | --- | --- |
| card | 13-19 digits with or without separators; Luhn | all digits but the last, which is the new check digit |
| iban | two letters, two digits, 11-30 letters or digits; check digits as the standard computes them (98 less the remainder) | digits and letters of the account, each in its class; new check digits |
| phone | + and digits with separators, (ddd) ddd-dddd; 8-16 digits | all digits but the first |
| ip | four bytes without leading zeros | 32 bits |
| ssn | ddd-dd-dddd; area 001-899 but 666, group and serial not 0 | the number among the 898 * 99 * 9999 valid ones |
| date | YYYY-MM-DD, DD.MM.YYYY, DD/MM/YYYY; a calendar date of 1800-2199 | the day among the 146,097 days of 400 years |
| mail | name@host, a host of two labels or more | letters and digits of name and of the host's first label |
| secret | AKIA and 16 capitals or digits; key, token, password or secret = value | letters and digits of the value |

All patterns but those of mail and secret match values of bounded length. Those two scan a run of characters once, from its start (or from the end of the value found before), without
going back into it: time is linear in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Patterns of what may be personal data, in the order in which they are tried.
PATTERNS = {
    "mail": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}+",
    "secret": r"\bAKIA[A-Z0-9]{16}\b|\b(?:api[_-]?key|key|token|password|passwd|secret)\s?[=:]\s?\"?[A-Za-z0-9+/_-]{8,}+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DAYS, _DAY_A, _DAY_B = 146_097, 189, 773  # the days of 400 years, and two factors of their number
ROUNDS = 8
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999  # valid parts of a social security number


def let(value: Column, use) -> Column:
    """use(value), with value computed once and not written out at every place where it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _noise(key: str, tweak: Column, part: Column) -> Column:
    """A keyed hash as a long from 0 to 2**52 - 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, part).cast("binary"), 256), 1, 13), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of the longs from 0 to a * b - 1. The parts value / b and value % b take turns."""
    steps = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    sign = -1 if back else 1

    def step(s, i):
        noise = _noise(key, F.concat_ws("|", tweak, i.cast("string")), F.when(i % 2 == 0, s["r"]).otherwise(s["l"]).cast("string"))
        return F.struct(
            F.when(i % 2 == 0, F.pmod(s["l"] + sign * F.pmod(noise, a), a)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(noise, b), b)).alias("r"),
        )

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(steps, start, step, lambda s: s["l"] * b + s["r"])


def _halves(digits: Column, key: str, tweak: str, back: bool) -> Column:
    """Permutes a string of up to 36 digits: its two halves are numbers of Feistel parts of up to 18 digits."""
    steps = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    sign = -1 if back else 1
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")

    def permute(d):
        n = F.length(d)
        left = F.floor(n / 2).cast("int")

        def step(s, i):
            even = i % 2 == 0
            part = F.when(even, s["r"]).otherwise(s["l"])
            noise = sign * _noise(key, F.concat_ws("|", F.concat(F.lit(tweak), (s["m"] + s["n"]).cast("string")), i.cast("string")), part.cast("string"))
            return F.struct(
                F.when(even, F.pmod(s["l"] + F.pmod(noise, power(s["m"])), power(s["m"]))).otherwise(s["l"]).alias("l"),
                F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(noise, power(s["n"])), power(s["n"]))).alias("r"),
                s["m"].alias("m"),
                s["n"].alias("n"),
            )

        start = F.struct(
            F.coalesce(d.substr(F.lit(1), left).try_cast("long"), F.lit(0).cast("long")).alias("l"),
            F.coalesce(d.substr(left + 1, n - left).try_cast("long"), F.lit(0).cast("long")).alias("r"),
            left.alias("m"),
            (n - left).alias("n"),
        )
        return F.aggregate(
            steps, start, step,
            lambda s: F.concat(F.when(s["m"] > 0, F.lpad(s["l"].cast("string"), s["m"], "0")).otherwise(F.lit("")), F.lpad(s["r"].cast("string"), s["n"], "0")),
        )

    return let(digits, permute)


def _refill(shape: Column, chars: Column, holes: str) -> Column:
    """Puts chars, in order, into the characters of shape that match holes."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))

    def step(known):
        def one(a, c):
            hole = c.rlike(holes)
            return F.struct(
                F.when(hole, a["i"] + 1).otherwise(a["i"]).alias("i"),
                F.concat(a["s"], F.when(hole, F.substring(known, a["i"] + 1, 1)).otherwise(c)).alias("s"),
            )

        return one

    return let(chars, lambda known: F.aggregate(F.split(shape, ""), start, step(known), lambda a: a["s"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of digits, the last one undoubled."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.try_cast("int").alias("d"), i.alias("i"))),
        F.lit(0),
        lambda a, c: a + F.when(c["i"] % 2 == 0, F.coalesce(c["d"], F.lit(0))).otherwise(F.coalesce(2 * c["d"] - F.when(c["d"] > 4, 9).otherwise(0), F.lit(0))),
    )


def _mod97(chars: Column) -> Column:
    """The remainder of an IBAN that was turned (country and check digits last), letters as 10-35."""
    return F.aggregate(
        F.split(chars, ""), F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a),
    )


def _shift(text: Column, key: str, tweak: str, back: bool, holes: str = "[A-Za-z0-9]") -> Column:
    """Permutes a string within its shape: characters of each class by a keyed Feistel of the two halves of the string."""
    sign = -1 if back else 1

    def turn(part, other, i):
        pad = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other).cast("binary"), 512)

        def move(pad):
            def one(c, j):
                k = F.conv(F.substring(pad, 1 + 2 * F.pmod(j, F.lit(60)), 4), 16, 10).cast("int") * sign
                code = F.ascii(c)
                return (
                    F.when(~c.rlike(holes), c)
                    .when(code < 58, F.char(F.pmod(code - 48 + k, F.lit(10)) + 48))
                    .when(code < 91, F.char(F.pmod(code - 65 + k, F.lit(26)) + 65))
                    .otherwise(F.char(F.pmod(code - 97 + k, F.lit(26)) + 97))
                )

            return one

        return let(pad, lambda known: F.array_join(F.transform(F.split(part, ""), move(known)), ""))

    steps = F.array(*[F.lit(i) for i in ((3, 2, 1, 0) if back else (0, 1, 2, 3))])
    def halves(t):
        half = F.floor(F.length(t) / 2).cast("int")
        return F.struct(t.substr(F.lit(1), half).alias("l"), t.substr(half + 1, F.length(t)).alias("r"))

    return F.aggregate(
        steps, let(text, halves),
        lambda s, i: F.struct(
            F.when(i % 2 == 0, turn(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, s["r"]).otherwise(turn(s["r"], s["l"], i)).alias("r")
        ),
        lambda s: F.concat(s["l"], s["r"]),
    )


def _card(x, key, back):
    def new(d):
        body = _halves(d.substr(F.lit(1), F.length(d) - 1), key, "card", back)
        whole = let(body, lambda n: F.concat(n, F.pmod(-_luhn_sum(F.concat(n, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(_luhn_sum(d) % 10 == 0, _refill(x, whole, "[0-9]"))

    return let(_digits(x), new)


def _iban(x, key, back):
    def new(plain):
        country = F.substring(plain, 1, 2)
        account = plain.substr(F.lit(5), F.length(plain))
        check = lambda n: F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0")
        whole = let(_shift(account, key, "iban", back), lambda n: F.concat(country, check(n), n))
        return F.when(check(account) == F.substring(plain, 3, 2), _refill(x, whole, "[A-Z0-9]"))

    return let(F.replace(x, F.lit(" "), F.lit("")), new)


def _ip(x, key, back):
    parts = F.split(x, r"\.")
    value = reduce(lambda a, i: a * 256 + F.coalesce(parts[i].try_cast("long"), F.lit(0)), range(4), F.lit(0).cast("long"))
    dotted = lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / F.lit(256**k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])
    new = feistel(value, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"), back)
    # a byte over 255 or a leading zero isn't written back as it was
    return F.when(let(value, dotted) == x, let(new, dotted))


def _date(x, key, back):
    iso = x.rlike("^[0-9]{4}-")
    sep = F.substring(x, 3, 1)
    ymd = F.when(iso, x).otherwise(F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2)))
    day = F.datediff(ymd.try_cast("date"), F.lit("1800-01-01").cast("date")).cast("long")

    def moved(day):
        n = feistel(day, F.lit(_DAY_A).cast("long"), F.lit(_DAY_B).cast("long"), key, F.lit("date"), back).cast("int")
        return F.when(day.between(0, _DAYS - 1), let(F.date_add(F.lit("1800-01-01").cast("date"), n), written))

    def written(new):
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat_ws("", F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy")))

    return let(day, moved)


def _phone(x, key, back):
    new = lambda d: _refill(x, F.concat(F.substring(d, 1, 1), _halves(d.substr(F.lit(2), F.length(d)), key, "phone", back)), "[0-9]")
    return let(_digits(x), lambda d: F.when(F.length(d).between(8, 16), new(d)))


def _ssn(x, key, back):
    part = lambda i, n: F.coalesce(F.substring(x, i, n).try_cast("long"), F.lit(0).cast("long"))
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    value = (place * _GROUPS + group - 1) * _SERIALS + serial - 1

    def written(n):
        place = F.floor(n / F.lit(_GROUPS * _SERIALS))
        area = place + F.when(place > 664, 2).otherwise(1)
        return F.concat_ws("-", *[F.lpad(v.cast("string"), w, "0") for v, w in ((area, 3), (F.pmod(F.floor(n / F.lit(_SERIALS)), F.lit(_GROUPS)) + 1, 2), (F.pmod(n, F.lit(_SERIALS)) + 1, 4))])

    new = feistel(value, F.lit(_AREAS * _GROUPS).cast("long"), F.lit(_SERIALS).cast("long"), key, F.lit("ssn"), back)
    return F.when(good, let(new, written))


def _mail(x, key, back):
    name, host = F.split(x, "@")[0], F.split(x, "@")[1]
    label = F.split(host, r"\.", 2)
    return F.concat(_shift(name, key, "mail", back), F.lit("@"), _shift(label[0], key, "host", back), F.lit("."), label[1])


def _secret(x, key, back):
    named = F.regexp_extract(x, r"^(AKIA|[^=:]*[=:]\s?\"?)(.*)$", 1)
    return F.concat(named, _shift(x.substr(F.length(named) + 1, F.length(x)), key, "secret", back))


_RULES = {"mail": _mail, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(x: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one found value; itself if it fails the validation of every kind whose pattern it fits."""
    return F.coalesce(*[F.when(x.rlike(f"^(?:{PATTERNS[kind]})$"), _RULES[kind](x, key, back)) for kind in _RULES], x)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """Per row of docs: doc_id, text (with pseudonyms), n_found, n_changed. back: turns pseudonyms into the values they stand for.

    Null text stays null with 0 found; empty texts, ties and repeated rows are handled row by row, a null id stays null. Other columns are ignored.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = F.col("text").rlike(r"[0-9]|[=:@]")
    # between: one piece of text more than values are found
    t = t.withColumn("found", F.when(some, F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))))
    t = t.withColumn("found", F.when(F.size("found") > 0, F.col("found")))
    t = t.withColumn("new", F.when(F.col("found").isNotNull(), F.transform("found", lambda x: pseudonym(x, key, back))))
    between = F.when(F.col("found").isNotNull(), F.split("text", _ANY))
    whole = F.array_join(F.flatten(F.zip_with(between, "new", lambda x, y: F.array(x, y))), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda x, y: x != y), lambda x: x))
    return t.select(
        "doc_id",
        F.when(F.col("found").isNotNull(), whole).otherwise(F.col("text")).alias("text"),
        F.when(F.col("found").isNotNull(), F.size("found")).otherwise(0).alias("n_found"),
        F.when(F.col("found").isNotNull(), changed).otherwise(0).alias("n_changed"),
    )


def restore(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts that pseudonymise was given: its output's columns, with each pseudonym turned back."""
    return pseudonymise(docs, key, id_col, text_col, back=True)


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key="tidemark-key-1")
