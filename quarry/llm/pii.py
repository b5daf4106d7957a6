"""Personal data under format-preserving pseudonyms from keyed Feistel permutations.

Every find keeps its format and stays valid: a card number stays a number with a right check digit, a date a date, an address
an address. Equal values get equal pseudonyms in all documents, different values of one kind different ones (a permutation
of the kind's values), so links between documents survive. A permutation that leaves the layout is applied again until it comes back to it
(cycle walking): dates keep their numbers of digits, and the reading, day or month first, that the text allows. The key must be given; without
it nothing can be turned back.

Kinds and their validation: e-mail addresses (local part), IPv4 addresses (octets up to 255), payment cards (13 to 19 digits, Luhn),
social security numbers (ranges in use), telephone numbers (by layout), dates (a day that exists, 1700 to 2099; day before month
where both readings exist) and hexadecimal secrets after a name such as key or token. What fails validation is left alone.

Only DataFrame functions are used; a text without digits or @ is not searched at all, nothing is shuffled. Null texts stay
null, empty ones empty; ids may be null or repeat; an empty table gives an empty result. Other columns pass through, whatever their names;
only one named _found is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, documents_but, let

ROUNDS = 10
#: Cycle walking: at least a fifth of all dates fits any layout, so that many steps fall short once in 10^24 dates (which then stay as they are).
WALK = 250

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?i)(?<=(?:key|token|secret|password)[ ]{0,2}[=:][ ]{0,2}[\"']?)(?:[0-9a-f]{32,64})(?![0-9A-Za-z])(?-i)",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:?[0-9]{2})|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z/-])(?!\.[0-9]))",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z(])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}|\+(?=(?:[ .()-]{0,3}[0-9]){8,15}(?![ .-]?[0-9]))[1-9][0-9]{0,2}(?:[ .-]\(?[0-9]{1,4}\)?){2,6})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ ][0-9]{4}[ ][0-9]{4}[ ][0-9]{1,7}|[0-9]{4}[ ][0-9]{6}[ ][0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
#: What characters are permuted in; others stay. Secrets have an alphabet of their own.
TEXT = ("0123456789", *("".join(chr(ord(a) + i) for i in range(n)) for a, n in (("a", 26), ("A", 26), ("\u00e0", 23), ("\u00c0", 23))))
HEX = ("0123456789", "abcdef", "ABCDEF")
#: Days from 1700-01-01 to 2099-12-31, one Gregorian cycle, as a product.
FIRST_DAY, DAYS = "1700-01-01", (189, 773)


def _keyed(key: str, kind: Column, i: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, i.cast("string"), value), 256)


def _number(hexa: Column) -> Column:
    return F.conv(F.substring(hexa, 1, 15), 16, 10).cast("long")


def _rounds(start: Column, step) -> Column:  # noqa: ANN001
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def feistel_pair(x: Column, y: Column, of_x: int, of_y: int, key: str, kind: Column) -> Column:
    """A permutation of [0, of_x) x [0, of_y), as a struct (x, y)."""

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["x"] + _number(_keyed(key, kind, i, s["y"].cast("string"))), F.lit(of_x))
        right = F.pmod(s["y"] + _number(_keyed(key, kind, i, s["x"].cast("string"))), F.lit(of_y))
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(right).alias("y"))

    return _rounds(F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def feistel_text(text: Column, key: str, kind: Column, alphabets: tuple[str, ...] = TEXT) -> Column:
    """A permutation of the texts of one layout: letters and digits move within their alphabets, the rest stays."""
    letters = "".join(alphabets)

    def shift(part: Column, digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            at = F.instr(F.lit(letters), c) - 1
            by = F.conv(F.substr(digest, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int") + i
            out, first = c, 0
            for a in alphabets:
                moved = F.substr(F.lit(letters), F.lit(first + 1) + F.pmod(at - first + by, F.lit(len(a))), F.lit(1))
                out = F.when((c != "") & at.between(first, first + len(a) - 1), moved).otherwise(out)
                first += len(a)
            return out

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left, right = shift(s["x"], _keyed(key, kind, i, s["y"])), shift(s["y"], _keyed(key, kind, i, s["x"]))
        return F.struct(F.when(even, left).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(right).alias("y"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("x"), F.substr(text, half + 1).alias("y"))
    return let(_rounds(start, step), lambda s: F.concat(s["x"], s["y"]))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a text of digits; the last one counts once."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return acc + F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refill(layout: Column, digits: Column) -> Column:
    """layout with its digits replaced in turn."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (c != "")
        return F.struct(F.concat(s["t"], F.when(is_digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("t"), F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.split(layout, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")), put, lambda s: s["t"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = feistel_text(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
        check = lambda b: F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _refill(m, let(body, lambda b: F.concat(b, check(b))))).otherwise(m)

    return let(_digits(m), of)


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        v = lambda i: F.get(o, F.lit(i)).cast("long")
        pair = feistel_pair(v(0) * 256 + v(1), v(2) * 256 + v(3), 65536, 65536, key, F.lit("ip"))
        text = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
        return let(pair, lambda p: F.concat_ws(".", text(p["x"]), text(p["y"])))

    return let(F.split(m, "\\."), of)


def _ssn(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        area, group, serial = (F.get(o, F.lit(i)).cast("long") for i in range(3))
        good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = feistel_pair(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, F.lit("ssn"))

        def back(p: Column) -> Column:
            a = F.floor(p["x"] / 99)
            pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
            return F.concat_ws("-", pad(F.when(a > 664, a + 2).otherwise(a + 1), 3), pad(F.pmod(p["x"], F.lit(99)) + 1, 2), pad(p["y"] + 1, 4))

        return F.when(good, let(pair, back)).otherwise(m)

    return let(F.split(m, "-"), of)


def _date(m: Column, key: str) -> Column:
    """Year first, or day and month in either order; a text that can be read day first is. Days and months keep their numbers of digits."""

    def of(o: Column) -> Column:
        part = lambda i: F.get(o, F.lit(i))
        iso = F.length(part(0)) == 4
        day = lambda y, a, b: F.try_to_date(F.concat_ws("-", y, F.lpad(a, 2, "0"), F.lpad(b, 2, "0")))
        first, second = F.when(iso, day(part(0), part(1), part(2))).otherwise(day(part(2), part(1), part(0))), F.when(~iso, day(part(2), part(0), part(1)))

        def back(found: Column) -> Column:
            start = F.datediff(F.coalesce(found["a"], found["b"]), F.lit(FIRST_DAY).cast("date"))
            day_first = found["a"].isNotNull()
            date = lambda offset: F.date_add(F.lit(FIRST_DAY).cast("date"), offset.cast("int"))

            def fits(d: Column) -> Column:
                dom, month = F.dayofmonth(d), F.month(d)
                short = lambda n, i: (n < 10) | (F.length(part(i)) == 2)
                return iso | F.when(day_first, short(dom, 0) & short(month, 1)).otherwise((dom > 12) & short(month, 0))

            def step(s: Column, _: Column) -> Column:
                pair = feistel_pair(F.floor(s["at"] / DAYS[1]), F.pmod(s["at"], F.lit(DAYS[1])), *DAYS, key, F.lit("date"))
                moved = lambda at: F.struct(at.alias("at"), fits(date(at)).alias("done"))
                return F.when(s["done"], s).otherwise(let(pair, lambda p: let(p["x"] * DAYS[1] + p["y"], moved)))

            def written(s: Column) -> Column:
                d = date(s["at"])
                number = lambda x, i: F.when(F.length(part(i)) == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
                year, month, dom = F.lpad(F.year(d).cast("string"), 4, "0"), F.month(d), F.dayofmonth(d)
                sep = F.when(F.contains(m, F.lit("/")), "/").otherwise(".")
                loose = F.when(day_first, F.concat(number(dom, 0), sep, number(month, 1), sep, year)).otherwise(F.concat(number(month, 0), sep, number(dom, 1), sep, year))
                return F.when(~s["done"], m).when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(loose)

            walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(start.cast("long").alias("at"), F.lit(False).alias("done")), step)
            return F.when(start.between(0, DAYS[0] * DAYS[1] - 1), let(walked, written)).otherwise(m)

        return let(F.struct(first.alias("a"), second.alias("b")), back)

    return let(F.split(m, "[-/.]"), of)


def _email(m: Column, key: str) -> Column:
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(feistel_text(local, key, F.lit("email")), F.lit("@"), host)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    rest = F.substr(m, F.length(country) + 1)
    return F.concat(country, _refill(rest, feistel_text(_digits(rest), key, F.lit("phone"))))


def _secret(m: Column, key: str) -> Column:
    return feistel_text(m, key, F.lit("secret"), HEX)


def kind_of(m: Column) -> Column:
    """The kind of a find; a card layout beats a telephone's."""
    out = F.lit("card")
    for name, rule in (("phone", r"^\+|^\(|^[0-9]{3}[ .-][0-9]{3}[ .-]?[0-9]{4}$"), ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("date", r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})$"), ("ip", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), ("secret", r"^[0-9A-Fa-f]{32,64}$"), ("email", "@")):
        out = F.when(m.rlike(rule), F.lit(name)).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a find, or the find itself if it isn't valid."""
    made = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}

    def of(kind: Column) -> Column:
        out = m
        for name, f in made.items():
            out = F.when(kind == name, f(m, key)).otherwise(out)
        return out

    return let(kind_of(m), of)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col under pseudonyms, and _found: array<struct<kind, found, pseudonym>> of what was changed."""
    x = docs.select(documents_but(docs, "_found").alias("row"), F.col(f"`{text_col}`").alias("t"))
    x = x.withColumn("m", F.when(F.col("t").rlike("[0-9@]"), F.regexp_extract_all(F.col("t"), F.lit(ANY), F.lit(0))))
    each = F.transform("m", lambda m: F.struct(kind_of(m).alias("kind"), m.alias("found"), pseudonym(m, key).alias("pseudonym")))
    x = x.withColumn("each", F.when(F.size("m") > 0, each))
    between = F.split(F.col("t"), ANY, -1)
    joined = F.array_join(F.zip_with(between, F.transform("each", lambda e: e["pseudonym"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.coalesce(F.filter("each", lambda e: e["found"] != e["pseudonym"]), F.array().cast("array<struct<kind:string,found:string,pseudonym:string>>"))
    new = F.when(F.col("each").isNotNull(), joined).otherwise(F.col("t"))
    names = [f.name for f in x.schema["row"].dataType.fields]
    return x.select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], changed.alias("_found"))


def op5_pii(spark: SparkSession, sf_dir: str, key: str = "a key for tests only") -> DataFrame:
    x = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key)
    return x.select("doc_id", F.size("_found").cast("long").alias("n_replaced"), F.array_sort(F.array_distinct(F.transform("_found", lambda e: e["kind"]))).alias("kinds"), "text")
