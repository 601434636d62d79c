"""Personal data replaced by format-preserving pseudonyms, keyed Feistel permutations in SQL functions.

Values are found by one pattern, and validated by kind: card numbers by their Luhn digit, IBANs by
the remainder modulo 97, dates by the calendar, social security numbers and IP addresses by range,
secrets by their mixture of letters and digits. A valid value is permuted under the key within its
format; the permutation depends on the value alone, so equal values stay linked across documents and
across ways to write them (separators are put back where they were). What is invalid stays.

The permutation is a Feistel network over characters: a digit is shifted within 0-9 and a letter
within its case by a keyed hash of the other half, in alternating rounds, so that every format is
mapped one to one onto itself. Check digits are computed anew; values with a range (dates, social
security numbers) are permuted again until they are in range, which keeps the map one to one.

A row is handled by itself: no shuffle at any size.

Defined results: null text stays null and empty text empty, with no values; repeated rows give equal
results; columns other than text are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

ROUNDS = 8
#: The setting with the caller's key; KEY is only for tests and trials, as anybody can read it here.
KEY_SETTING, KEY = "spark.quarry.pseudonym.key", "a key of the caller's"
#: Cycle walking stops when in range; a step fails with probability below 0.6, so 64 don't suffice once in 10^14 values.
WALK = 64

# What each kind looks like. Earlier kinds win where two match at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9][A-Za-z0-9.-]{0,250}\.[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(x: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.transform(F.array(x), body)[0]


def _code(c: Column) -> Column:
    return F.ascii(c)


def _shift(part: Column, other: Column, round_: Column, tweak: str, key: str) -> Column:
    """Every digit and letter of `part` moved within its class by a hash of the other half."""
    stream = F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), round_.cast("string"), F.lit("|"), F.length(part).cast("string"), F.lit("|"), other), 512)

    def move(c: Column, i: Column, stream: Column) -> Column:
        k = F.conv(F.substring(stream, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        at = lambda base, size: F.char((_code(c) - base + k) % size + base)
        return F.when(c.between("0", "9"), at(48, 10)).when(c.between("a", "z"), at(97, 26)).when(c.between("A", "Z"), at(65, 26)).otherwise(c)

    return _let(stream, lambda s: F.array_join(F.transform(F.split(part, "", -1), lambda c, i: move(c, i, s)), ""))


def feistel(value: Column, tweak: str, key: str = KEY) -> Column:
    """value under the keyed permutation of strings of its format (digits, lower- and upper-case ASCII letters by place)."""
    cut = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        left, right = acc["l"], acc["r"]
        return F.when(i % 2 == 0, F.struct(_shift(left, right, i, tweak, key).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), _shift(right, left, i, tweak, key).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def _walk(value: Column, ok, tweak: str, key: str) -> Column:
    """The permutation repeated until the value is ok."""
    step = lambda acc, i: F.when((i > 1) & ok(acc), acc).otherwise(feistel(acc, tweak, key))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), value, step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _put(pattern: Column, digits: Column) -> Column:
    """`pattern` with its digits replaced, in order, by `digits`."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))
    step = lambda acc, c: F.when(c.between("0", "9"), F.struct(F.concat(acc["o"], F.substring(digits, acc["k"], F.lit(1))).alias("o"), (acc["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(acc["o"], c).alias("o"), acc["k"].alias("k"))
    )
    return F.aggregate(F.split(pattern, "", -1), start, step, lambda acc: acc["o"])


def _luhn(body: Column) -> Column:
    """The check digit for a number without it."""

    def term(c: Column, i: Column) -> Column:
        x = (_code(c) - 48) * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return F.when(c == "", F.lit(0)).when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.transform(F.split(F.reverse(body), "", -1), term), F.lit(0), lambda a, x: a + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _remainder97(value: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + (_code(c) - 48)) % 97).when(c.between("A", "Z"), (acc * 100 + (_code(c) - 55)) % 97).otherwise(acc)

    return F.aggregate(F.split(value, "", -1), F.lit(0), step)


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    return F.when(_luhn(body) == F.right(d, F.lit(1)), _let(feistel(body, "card", key), lambda new: _let(F.concat(new, _luhn(new)), lambda full: _put(v, full))))


def _iban(v: Column, key: str) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    country, rest = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))

    def whole(new: Column) -> Column:
        return F.concat(country, F.lpad((F.lit(98) - _remainder97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)

    def spaced(made: Column) -> Column:
        start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))
        gap = lambda acc, c: F.struct(F.concat(acc["o"], c).alias("o"), acc["k"].alias("k"))
        char = lambda acc: F.struct(F.concat(acc["o"], F.substring(made, acc["k"], F.lit(1))).alias("o"), (acc["k"] + 1).alias("k"))
        return F.aggregate(F.split(v, "", -1), start, lambda acc, c: F.when(c == " ", gap(acc, c)).otherwise(char(acc)), lambda acc: acc["o"])

    valid = F.length(flat).between(15, 34) & (_remainder97(F.concat(rest, country, F.substring(flat, 3, 2))) == 1)
    return F.when(valid, _let(_let(feistel(rest, "iban", key), whole), spaced))


FIRST_DAY, DAYS = "1900-01-01", 73049  # 1900-01-01 to 2099-12-31


def _date(v: Column, key: str) -> Column:
    """ISO and day-first dates among all days; what is a date only month first, among the days after the 12th, which stay so."""
    form = F.when(v.contains("-"), F.lit("yyyy-MM-dd")).when(v.contains("/"), F.lit("dd/MM/yyyy")).otherwise(F.lit("dd.MM.yyyy"))
    year, one, two = F.right(v, F.lit(4)), F.left(v, F.lit(2)), F.substring(v, 4, 2)
    iso = F.when(v.contains("-"), v).otherwise(F.concat_ws("-", year, two, one))
    first = F.lit(FIRST_DAY).cast("date")
    number = lambda x: F.datediff(F.try_to_date(x, "yyyy-MM-dd"), first)
    day = lambda x: F.date_add(first, x.cast("int"))
    within = lambda x: x < F.lit(str(DAYS))
    moved = lambda n, ok: day(_walk(F.lpad(n.cast("string"), 5, "0"), ok, "date", key))
    usual, other = number(iso), F.when(v.contains("/"), number(F.concat_ws("-", year, one, two)))
    out = _let(moved(usual, within), lambda new: F.call_function("date_format", new, form))
    late = _let(moved(other, lambda x: within(x) & (F.dayofmonth(day(x)) > 12)), lambda new: F.call_function("date_format", new, F.lit("MM/dd/yyyy")))
    return F.when(usual.between(0, DAYS - 1), out).when(usual.isNull() & other.between(0, DAYS - 1), late)


def _ip(v: Column, key: str) -> Column:
    o = [F.split(v, r"\.")[i].cast("int") for i in range(4)]
    start = F.struct((o[0] * 256 + o[1]).alias("l"), (o[2] * 256 + o[3]).alias("r"))
    f = lambda i, x: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|ip|"), i.cast("string"), F.lit("|"), x.cast("string")), 256), 1, 4), 16, 10).cast("int")
    turn = lambda acc, i: F.struct(acc["r"].alias("l"), ((acc["l"] + f(i, acc["r"])) % 65536).alias("r"))
    byte = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat_ws(".", *byte(acc["l"]), *byte(acc["r"])))
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), out)


def _ssn_ok(d: Column) -> Column:
    area = F.substring(d, 1, 3)
    return (area != "000") & (area != "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def _ssn(v: Column, key: str) -> Column:
    d = _digits(v)
    return F.when(_ssn_ok(d), _let(_walk(d, _ssn_ok, "ssn", key), lambda new: _put(v, new)))


def _phone(v: Column, key: str) -> Column:
    lead = F.regexp_extract(v, r"^\+[0-9]{1,3}(?=[ .(-])", 0)  # the country code stays
    rest = F.substring(v, F.length(lead) + 1, F.length(v))
    d = _digits(rest)
    return F.when(F.length(_digits(v)).between(7, 15), F.concat(lead, _let(feistel(d, "phone", key), lambda new: _put(rest, new))))


def _email(v: Column, key: str) -> Column:
    """Permuted in lower case, so that addresses stay linked in any case; capitals are put back where they were."""
    ending = F.regexp_extract(v, r"\.[A-Za-z]+$", 0)
    name = F.substring(v, F.lit(1), F.length(v) - F.length(ending))
    made = _let(feistel(F.lower(name), "email", key), lambda new: F.array_join(F.zip_with(F.split(name, "", -1), F.split(new, "", -1), lambda a, b: F.when(a.between("A", "Z"), F.upper(b)).otherwise(b)), ""))
    return F.concat(made, ending)


def _secret(v: Column, key: str) -> Column:
    letters, digits = F.length(F.regexp_replace(v, "[^A-Za-z]+", "")), F.length(_digits(v))
    return F.when((letters >= 4) & (digits >= 4), feistel(v, "secret", key))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone, "secret": _secret}


def pseudonym(v: Column, key: str = KEY) -> Column:
    """(kind, value) for one match: the first kind that it has the form of and is valid for; kind null if there is none."""
    # the pattern's look-around has been met in the text; a match alone stands at both ends
    made = [F.struct(F.lit(k).alias("kind"), F.when(v.rlike(f"^(?:{PATTERNS[k]})$"), _MAKERS[k](v, key)).alias("value")) for k in KINDS]
    valid = F.get(F.filter(F.array(*made), lambda x: x["value"].isNotNull()), F.lit(0))
    return F.coalesce(valid, F.struct(F.lit(None).cast("string").alias("kind"), v.alias("value")))


def key_of(spark: SparkSession) -> str:
    """The caller's key, from the session's setting KEY_SETTING."""
    return spark.conf.get(KEY_SETTING, KEY)


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with personal data in text replaced, and a column `_found`: the kinds of the values replaced.

    The key is the one given, else the session's.
    """
    key = key or key_of(docs.sparkSession)
    df = docs.withColumn("_hits", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_new", F.when(F.size("_hits") > 0, F.transform("_hits", lambda v: pseudonym(v, key))))
    df = df.withColumn("_found", F.coalesce(F.filter(F.transform("_new", lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>")))
    parts = F.split("text", ANY, -1)
    values = F.transform("_new", lambda x: x["value"])
    woven = F.array_join(F.flatten(F.zip_with(parts, F.concat(values, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return df.withColumn("text", F.when(F.size("_found") > 0, woven).otherwise(F.col("text"))).drop("_hits", "_new")


def clean(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The rows of docs with personal data replaced, and n_chars, if there, made to fit."""
    columns = docs.columns
    out = pseudonymise(docs.select("*"), key)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("_found", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", "text", *[n(k) for k in KINDS])
