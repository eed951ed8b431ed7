"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Card numbers (13 to 19 digits with a right check digit), telephone numbers, social security numbers, IPv4
addresses and calendar dates are validated and then permuted within their own format by a keyed Feistel
network, so equal values stay equal across documents and different ones stay different. E-mail addresses
and secrets (key = value, access keys, quoted tokens), which have no number to permute, get keyed
one-way names of the same shape. Everything else stays as it is: numbers that fail their check are not
touched.

The network alternates over a pair (a, b) with a in [0, m) and b in [0, n): a += F(b) mod m, then b +=
F(a) mod n, for ROUNDS rounds, F being the first 13 hex digits of SHA-256 over key, format, round and the
other half. Each round can be undone, so it is a permutation of the m * n values for any m and n.

Null text stays null. A value keeps its separators. Texts without a candidate are passed through
without further work. Repeated rows are changed alike, an empty table stays empty. No pattern recurses over the
text or reads a stretch of it more often than a bounded number of times, so very long texts are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8

# Patterns of the formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,63}"
RUN = r"(?<![\d.-])\d[\d -]{11,}+"  # groups of digits that may hold cards
PHONE = r"(?<![\d.])(?:\+?\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d|[.-]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?![\d/-]|\.\d)"
SECRET = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api_?key)\s?[=:]\s?(?:\"[^\"\s]{6,}\"|[A-Za-z0-9+/_-]{6,}={0,2})"
ANY = "|".join((EMAIL, SECRET, DATE, IP, SSN, PHONE))
#: Cheap test that a text may hold a value: two characters that each format has.
HINT = r"@|[0-9][0-9 .:/()+-]{4}|AKIA|ASIA|[=:]\s?[\"A-Za-z0-9+/_-]"


def _f(key: str, name: str, i: Column, x: Column, modulus: Column) -> Column:
    said = F.concat_ws("|", F.lit(key), F.lit(name), i.cast("string"), x.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long"), modulus)


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, name: str) -> Column:
    """struct(a, b), permuted; m and n are below 2^31 or so, a and b longs."""
    m, n = m.cast("long"), n.cast("long")
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        first = F.struct(F.pmod(s["a"] + _f(key, name, i, s["b"], m), m).alias("a"), s["b"].alias("b"))
        second = F.struct(s["a"].alias("a"), F.pmod(s["b"] + _f(key, name, i, s["a"], n), n).alias("b"))
        return F.when(i % 2 == 0, first).otherwise(second)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def permuted_digits(d: Column, key: str, name: str) -> Column:
    """Digits permuted among all strings of their length, at least two and at most 18 digits."""
    size = F.length(d)
    left = F.floor(size / 2).cast("int")
    right = size - left
    a, b = F.substring(d, F.lit(1), left).cast("long"), F.substring(d, left + 1, right).cast("long")
    m, n = F.pow(F.lit(10), left).cast("long"), F.pow(F.lit(10), right).cast("long")
    return _let(feistel(a, b, m, n, key, name), lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), right, "0")))


def luhn_sum(d: Column, first_doubled: bool) -> Column:
    """Sum of the digits from the right, every second one doubled and its digits added."""
    places = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when((i % 2 == (0 if first_doubled else 1)) & c.rlike("[0-9]"), F.expr("0") + c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(F.coalesce(c.cast("int"), F.lit(0))))
    return F.aggregate(F.filter(places, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x)


def with_digits(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by `digits`."""
    gaps = F.split(form, r"\d", -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(digits, i + 1, F.lit(1)))), "")


def card(x: Column, key: str) -> Column:
    """All digits but the last are permuted, the last is the new check digit."""

    def of(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _let(permuted_digits(body, key, "card"), lambda p: F.concat(p, F.pmod(-luhn_sum(p, True), F.lit(10)).cast("string")))
        return with_digits(x, new)

    return _let(_digits(x), of)


def is_card(d: Column) -> Column:
    """13 to 19 digits with a right check digit, not all equal."""
    return F.when(F.length(d).between(13, 19), (luhn_sum(d, False) % 10 == 0) & ~d.rlike(r"^(\d)\1*$")).otherwise(F.lit(False))


#: Groups of digits that are scanned in one step.
STEP = 128


def cards_in_run(x: Column, key: str) -> Column:
    """struct(text, n): the cards among the groups of digits of one run.

    Stretches of groups, parted by single characters, are tested from left to right. Of those that begin at a group 16
    digits go first, then longer before shorter ones; a stretch of another length gives way to one of 16 digits that
    begins inside it. What begins inside a taken one is left. All steps are linear in the length of the run.
    """

    def of(p: Column) -> Column:
        groups, seps = p["groups"], p["seps"]  # seps[i] stands before groups[i]
        n = F.size(groups)

        def found(i: Column) -> Column:
            """Lengths in groups of the cards that begin at group i, the preferred one first."""

            def one(k: Column) -> Column:
                d = F.array_join(F.slice(groups, i + 1, k), "")
                joined = (k == 1) | F.forall(F.slice(seps, i + 2, F.greatest(k - 1, F.lit(1))), lambda g: F.length(g) == 1)
                return F.when(joined & is_card(d), F.struct(F.when(F.length(d) == 16, 0).otherwise(21 - F.length(d)).alias("rank"), k.alias("k")))

            return F.get(F.array_sort(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), one), lambda c: c.isNotNull())), F.lit(0))

        def settled(best: Column) -> Column:
            """Groups of the card that begins at each group, 0 for none."""

            def length(c: Column, i: Column) -> Column:
                inside = F.slice(best, i + 2, F.greatest(F.coalesce(c["k"], F.lit(1)) - 1, F.lit(0)))
                return F.when(c.isNull() | ((c["rank"] > 0) & F.exists(inside, lambda o: F.coalesce(o["rank"] == 0, F.lit(False)))), 0).otherwise(c["k"])

            return F.transform(best, length)

        def marked(ks: Column) -> Column:
            """For each group the groups of the card taken there, 0 for none, -1 inside of one."""
            none = F.array().cast("array<int>")

            def group(s: Column, i: Column) -> Column:
                k = F.get(ks, i)
                mark = F.when(i < s["end"], -1).otherwise(k)
                return F.struct(F.when(mark > 0, i + k).otherwise(s["end"]).cast("int").alias("end"), F.concat(s["marks"], F.array(mark.cast("int"))).alias("marks"))

            def step(s: Column, lo: Column) -> Column:
                own = F.aggregate(F.sequence(lo, F.least(lo + STEP, n) - 1), F.struct(s["end"].alias("end"), none.alias("marks")), group)
                return F.struct(own["end"].alias("end"), F.concat(s["steps"], F.array(own["marks"])).alias("steps"))

            start = F.struct(F.lit(0).alias("end"), F.array().cast("array<array<int>>").alias("steps"))
            return F.flatten(F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(STEP)), start, step)["steps"])

        def written(marks: Column) -> Column:
            def piece(g: Column, j: Column) -> Column:
                k = F.get(marks, j)
                # a card's text: its groups with the separators inside
                text = F.array_join(F.transform(F.slice(groups, j + 1, k), lambda q, m: F.concat(F.when(m == 0, F.lit("")).otherwise(F.get(seps, j + m)), q)), "")
                return F.when(k < 0, F.lit("")).when(k == 0, F.concat(F.get(seps, j), g)).otherwise(F.concat(F.get(seps, j), card(text, key)))

            out = F.concat(F.array_join(F.transform(groups, piece), ""), F.get(seps, n))
            return F.struct(out.alias("text"), F.size(F.filter(marks, lambda k: k > 0)).alias("n"))

        none = F.struct(x.alias("text"), F.lit(0).alias("n"))
        best = F.transform(F.sequence(F.lit(0), n - 1), found)
        return _let(best, lambda best: F.when(F.exists(best, lambda c: c.isNotNull()), _let(_let(settled(best), marked), written)).otherwise(none))

    return _let(F.struct(F.regexp_extract_all(x, F.lit(r"\d+"), 0).alias("groups"), F.split(x, r"\d+", -1).alias("seps")), of)


def cards(gap: Column, key: str) -> Column:
    """struct(text, n): text that holds no other value, with its cards replaced, and their number."""
    parts = F.struct(F.split(gap, RUN, -1).alias("gaps"), F.transform(F.regexp_extract_all(gap, F.lit(RUN), 0), lambda x: cards_in_run(x, key)).alias("new"))
    done = _let(parts, lambda p: F.struct(
        F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(p["new"], i)["text"], F.lit("")))), "").alias("text"),
        F.aggregate(p["new"], F.lit(0), lambda s, z: s + z["n"]).alias("n"),
    ))
    return F.when(gap.rlike(RUN), done).otherwise(F.struct(gap.alias("text"), F.lit(0).alias("n")))


def plain(x: Column, key: str, name: str, keep: int = 0) -> Column:
    """The last digits after the first `keep` are permuted; separators stay."""
    return _let(_digits(x), lambda d: with_digits(x, F.concat(F.substring(d, F.lit(1), F.length(d) - keep), permuted_digits(F.substring(d, F.length(d) - keep + 1, F.lit(keep)), key, name)) if keep else permuted_digits(d, key, name)))


def social(x: Column, key: str) -> Column:
    """A social security number; unchanged if it was never given out: area 000, 666 or above 899, group 00, serial 0000."""

    def of(d: Column) -> Column:
        area, group, serial = (F.substring(d, lo, n).cast("int") for lo, n in ((1, 3), (4, 2), (6, 4)))
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        nth = area - F.when(area > 666, 2).otherwise(1)  # 0 to 897
        new = _let(feistel(nth * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn"), lambda s: _let(
            F.floor(s["a"] / 99) + F.when(s["a"] >= 665 * 99, 2).otherwise(1),
            lambda a: F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["b"] + 1).cast("string"), 4, "0")),
        ))
        return F.when(ok, new).otherwise(x)

    return _let(_digits(x), of)


def address(x: Column, key: str) -> Column:
    """The 32 bits of an IPv4 address; unchanged if a part is above 255."""

    def of(p: Column) -> Column:
        part = lambda i: p[i].cast("long")
        ok = F.forall(p, lambda v: v.cast("int") < 256)
        new = _let(feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, "ip"), lambda s: F.concat_ws(".", *(v.cast("string") for k in "ab" for v in (F.shiftright(s[k], 8), s[k].bitwiseAND(255)))))
        return F.when(ok, new).otherwise(x)

    return _let(F.split(x, r"\."), of)


def date(x: Column, key: str) -> Column:
    """A date of 1900 to 2099 in its order of parts: (year, day of year) is permuted; December 31st of a leap year among those. Unchanged if there is no such day.

    Where only month before day makes a date, the day is above 12: those are permuted among themselves, February 29th apart.
    """
    iso = x.rlike(r"^\d{4}-")
    day = F.when(iso, F.try_to_date(x, "yyyy-MM-dd")).otherwise(F.try_to_date(F.regexp_replace(x, "/", "."), "dd.MM.yyyy"))

    def of(d: Column) -> Column:
        year, nth = F.year(d) - 1900, F.dayofyear(d)
        common = _let(feistel(year, nth - 1, F.lit(200), F.lit(365), key, "date"), lambda s: F.date_add(F.make_date(s["a"].cast("int") + 1900, F.lit(1), F.lit(1)), s["b"].cast("int")))
        leap = (year / 4).cast("int") - 1  # 1904 is 0, 2096 is 48
        last = _let(feistel((leap / 7).cast("int"), leap % 7, F.lit(7), F.lit(7), key, "leap"), lambda s: F.make_date(((s["a"] * 7 + s["b"]) * 4 + 1904).cast("int"), F.lit(12), F.lit(31)))
        new = F.when(nth == 366, last).otherwise(common)
        text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(x.contains("/"), F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
        return F.when(d.isNull(), month_first(x, key)).otherwise(text)

    return _let(day, of)


#: Month and day, as 100 * month + day, of the days above 12 of a common year.
LATE = [100 * m + d for m, n in enumerate((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1) for d in range(13, n + 1)]


def month_first(x: Column, key: str) -> Column:
    """A date in the order month, day, year whose day is above 12; others stay."""

    def of(d: Column) -> Column:
        late = F.array(*map(F.lit, LATE))
        nth = F.array_position(late, F.month(d) * 100 + F.dayofmonth(d))
        common = _let(feistel(F.year(d) - 1900, nth - 1, F.lit(200), F.lit(len(LATE)), key, "month first"), lambda s: _let(F.get(late, s["b"].cast("int")), lambda q: F.make_date(s["a"].cast("int") + 1900, F.floor(q / 100).cast("int"), q % 100)))
        leap = ((F.year(d) - 1900) / 4).cast("int") - 1
        last = _let(feistel((leap / 7).cast("int"), leap % 7, F.lit(7), F.lit(7), key, "february 29"), lambda s: F.make_date(((s["a"] * 7 + s["b"]) * 4 + 1904).cast("int"), F.lit(2), F.lit(29)))
        new = F.when(nth == 0, last).otherwise(common)
        return F.when(d.isNull() | x.rlike(r"^\d{4}-"), x).when(x.contains("/"), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "MM.dd.yyyy"))

    return _let(F.try_to_date(F.regexp_replace(x, "/", "."), "MM.dd.yyyy"), of)


def email(x: Column, key: str) -> Column:
    part = lambda i, n: F.substring(F.sha2(F.concat(F.lit(key + "|mail|"), F.lower(F.element_at(F.split(x, "@"), i))), 256), 1, n)
    return F.concat(F.lit("u"), part(1, 12), F.lit("@d"), part(2, 8), F.lit(".example"))


def secret(x: Column, key: str) -> Column:
    """The value gives way to as many characters of a keyed hash; the name and the quotes stay."""
    head = F.regexp_extract(x, r"^((?:AKIA|ASIA)|[^=:]+[=:]\s?\"?)", 1)
    rest = F.regexp_replace(F.substring(x, F.length(head) + 1, F.length(x)), r"\"$", "")
    hashed = F.sha2(F.concat(F.lit(key + "|secret|"), rest), 256)
    body = F.substring(F.repeat(F.when(x.rlike("^A(KI|SI)A"), F.upper(hashed)).otherwise(hashed), 64), F.lit(1), F.length(rest))
    return F.concat(head, body, F.when(x.endswith('"'), F.lit('"')).otherwise(F.lit("")))


def renamed(x: Column, key: str) -> Column:
    """The pseudonym of one value that ANY has found."""
    return (
        F.when(x.contains("@"), email(x, key))
        .when(x.rlike("[A-Za-z]"), secret(x, key))
        .when(x.rlike(f"^(?:{DATE})$"), date(x, key))
        .when(x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), address(x, key))
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), social(x, key))
        .otherwise(plain(x, key, "phone", 10))
    )


def pseudonymised(text: Column, key: str) -> tuple[Column, Column]:
    """The text with every value replaced, and the number of values changed."""
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), 0)
    pair = F.struct(found.alias("found"), F.transform(found, lambda x: renamed(x, key)).alias("new"), F.transform(gaps, lambda g: cards(g, key)).alias("gaps"))
    hint = text.rlike(HINT)
    out = F.when(hint, _let(pair, lambda p: F.struct(
        F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g["text"], F.coalesce(F.get(p["new"], i), F.lit("")))), "").alias("text"),
        (F.size(F.filter(F.arrays_zip(p["found"].alias("f"), p["new"].alias("n")), lambda z: z["f"] != z["n"])) + F.aggregate(p["gaps"], F.lit(0), lambda s, g: s + g["n"])).alias("n"),
    ))).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))
    return out, hint


#: Session setting that holds the secret key of the queries.
KEY_SETTING = "spark.wayfare.pseudonym.key"


def pseudonym_key(spark: SparkSession) -> str:
    """The key of the session; where none is set, one that is public and fit for made-up data only."""
    return spark.conf.get(KEY_SETTING, "public key for made-up data")


def pseudonymise(df: DataFrame, key: str, column: str = "text", count: str = "n_values") -> DataFrame:
    """df with `column` replaced; `count` names the number of values changed and takes the place of an input column of that name.

    Whoever has the key can undo the permutations, so it is to be kept secret.
    """
    if not key:
        raise ValueError("a key is needed")
    names = [f"_c{i}" for i in range(len(df.columns))]  # so that no input column meets the one made here
    done = df.toDF(*names).select(*(n for n, c in zip(names, df.columns, strict=True) if c != column), pseudonymised(F.col(names[df.columns.index(column)]).cast("string"), key)[0].alias("_new"))
    fields = [F.col("_new.text").alias(c) if c == column else F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c != count]
    return done.select(*fields, F.when(F.col("_new.text").isNull(), 0).otherwise(F.col("_new.n")).cast("long").alias(count))
