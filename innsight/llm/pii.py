"""Personal data replaced by format-preserving pseudonyms, in built-in functions only.

Account numbers, phone numbers, IBANs, IPv4 addresses and dates are found by
pattern and validated. A keyed Feistel network permutes each within its format: it
runs on the two halves of the number, adds the keyed hash of one half to the other
modulo the other's size, and therefore is one-to-one. Equal values get equal
pseudonyms in all documents, different values different ones. Mail addresses get a
keyed hash as name and domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.arrow import free_names

ROUNDS = 8

# What is searched for, first alternative first.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+"
IPV4 = r"(?<![0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4})(?![0-9]|[/.-][0-9])"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![0-9])|(?<![0-9-])(?:\+\d{1,3}[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![0-9-])"
SOCIAL = r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCOUNT = r"(?<![A-Za-z0-9])(?:\d{13,19}|(?:\d{4}[ -]){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])"
KINDS = ("mail", "ipv4", "date", "iban", "account", "social", "phone")
PATTERNS = dict(zip(KINDS, (MAIL, IPV4, DATE, IBAN, ACCOUNT, SOCIAL, PHONE)))
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")
#: Dates are permuted among the days from here on, so many that they split evenly.
FIRST_DAY, DAYS = "1900-01-01", (256, 286)


def _keyed(key: Column, kind: str, step: Column, half: Column) -> Column:
    """48 bits of a keyed hash, as a number."""
    material = F.concat_ws("|", key, F.lit(kind), step.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(material, 256), 1, 12), 16, 10).cast("long")


def feistel(key: Column, kind: str, left: Column, right: Column, lefts: Column, rights: Column):
    """(l, r) of the permuted pair; left is below ``lefts``, right below ``rights``."""

    def step(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]  # noqa: E741
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(l + _keyed(key, kind, i, r), lefts)).otherwise(l).alias("l"),
            F.when(even, r).otherwise(F.pmod(r + _keyed(key, kind, i, l), rights)).alias("r"),
        )

    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(key: Column, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.char_length(digits)
    half = F.floor(n / 2).cast("int")
    rest = n - half
    lefts, rights = _power(half), _power(rest)
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
    tag = F.concat_ws("|", key, n.cast("string"))
    pair = feistel(tag, kind, left, right, lefts, rights)
    return _bind(
        pair,
        lambda p: F.concat(
            F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")
        ),
    )


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _refill(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced, in order, everything else kept."""

    def step(state: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(
                state["out"], F.when(is_digit, F.substring(digits, state["next"], F.lit(1))).otherwise(c)
            ).alias("out"),
            (state["next"] + is_digit.cast("int")).alias("next"),
        )

    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    return F.aggregate(F.split(shape, ""), begin, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits; 0 on valid numbers."""
    numbered = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(numbered, F.lit(0), lambda a, x: a + x) % 10


def _account(key: Column, value: Column) -> Column:
    """Permutes all digits but the last and sets that so that the Luhn sum stays: a
    valid number becomes a valid one, any other keeps its distance from valid."""

    def build(digits: Column) -> Column:
        n = F.char_length(digits)
        body = permute_digits(key, "account", F.substring(digits, F.lit(1), n - 1))
        return _bind(
            body,
            lambda b: F.concat(
                b, F.pmod(luhn_sum(digits) - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")
            ),
        )

    return _bind(_digits(value), lambda d: _refill(value, build(d)))


def iban_remainder(compact: Column) -> Column:
    """The number of an IBAN modulo 97; 1 on valid ones."""
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        ),
    )


def _iban(key: Column, value: Column) -> Column:
    """Permutes the digits behind the check digits, then sets those anew."""
    compact = F.regexp_replace(value, " ", "")
    tail = F.substring(value, 5, 60)

    def build(digits: Column) -> Column:
        body = F.when(F.char_length(digits) >= 2, permute_digits(key, "iban", digits)).otherwise(digits)
        return _bind(body, lambda b: _refill(tail, b))

    def checked(new_tail: Column) -> Column:
        country = F.substring(value, 1, 2)
        zeroed = F.concat(country, F.lit("00"), F.regexp_replace(new_tail, " ", ""))
        check = F.lpad((F.lit(98) - iban_remainder(zeroed)).cast("string"), 2, "0")
        return F.concat(country, check, new_tail)

    new = _bind(_bind(_digits(tail), build), checked)
    return F.when(iban_remainder(compact) == 1, new).otherwise(value)


def _phone(key: Column, value: Column) -> Column:
    """Permutes the last ten digits; a country code stays."""
    return _bind(
        _digits(value),
        lambda d: _refill(
            value,
            F.concat(
                F.substring(d, F.lit(1), F.char_length(d) - 10),
                permute_digits(key, "phone", F.substring(d, -10, 10)),
            ),
        ),
    )


def _social(key: Column, value: Column) -> Column:
    return _bind(_digits(value), lambda d: _refill(value, permute_digits(key, "social", d)))


def _ipv4(key: Column, value: Column) -> Column:
    """Two halves of 16 bits; octets over 255 are no address and stay."""

    def build(o: Column) -> Column:
        pair = feistel(
            key,
            "ipv4",
            o[0].cast("int") * 256 + o[1].cast("int"),
            o[2].cast("int") * 256 + o[3].cast("int"),
            F.lit(65536),
            F.lit(65536),
        )
        new = _bind(
            pair,
            lambda p: F.concat_ws(
                ".",
                *[x.cast("string") for h in (p["l"], p["r"]) for x in (F.shiftright(h, 8), h % 256)],
            ),
        )
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), new).otherwise(value)

    return _bind(F.split(value, r"\."), build)


def _date(key: Column, value: Column) -> Column:
    """Among the days of the range, in the format found; other days stay."""
    made = value
    for shape in DATE_FORMATS:
        day = F.datediff(F.try_to_date(value, shape), F.lit(FIRST_DAY).cast("date"))
        valid = day.isNotNull() & (day >= 0) & (day < DAYS[0] * DAYS[1])
        made = F.when(valid, _bind(day, _day(key, shape))).otherwise(made)
    return made


def _day(key: Column, shape: str):
    lefts, rights = DAYS

    def build(d: Column) -> Column:
        pair = feistel(key, "date", F.floor(d / rights), d % rights, F.lit(lefts), F.lit(rights))
        new = _bind(pair, lambda p: (p["l"] * rights + p["r"]).cast("int"))
        return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new), shape)

    return build


def _mail(key: Column, value: Column) -> Column:
    hashed = F.sha2(F.concat_ws("|", key, F.lit("mail"), F.lower(value)), 256)
    return _bind(
        hashed,
        lambda h: F.concat(F.lit("u"), F.substring(h, 1, 16), F.lit("@m"), F.substring(h, 17, 8), F.lit(".example.com")),
    )


_MAKERS = dict(zip(KINDS, (_mail, _ipv4, _date, _iban, _account, _social, _phone)))


def kind_of(value: Column) -> Column:
    """The kind of a whole match."""
    shape = (
        F.when(value.contains("@"), "mail")
        .when(value.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ipv4")
        .when(value.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4})$"), "date")
        .when(value.rlike("^[A-Z]"), "iban")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
    )
    phone = value.rlike(rf"^(?:{PHONE})$") & (F.char_length(_digits(value)) <= 13) & value.rlike("[(+.-]")
    return shape.when(phone, "phone").otherwise("account")


def pseudonymise_value(key: Column, value: Column) -> Column:
    """The pseudonym of one match, of whatever kind; values that fail their
    validation are returned as they are."""

    def build(pair: Column) -> Column:
        out = pair["value"]
        chosen = None
        for name, make in _MAKERS.items():
            is_it = pair["kind"] == name
            made = make(key, pair["value"])
            chosen = F.when(is_it, made) if chosen is None else chosen.when(is_it, made)
        return chosen.otherwise(out)

    return _bind(F.struct(value.alias("value"), kind_of(value).alias("kind")), build)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with the text's personal data replaced and, if asked for, n_pii (values
    replaced) and n_<kind> (values found) columns, which replace columns of these
    names.

    Null texts stay null and count zero; texts without matches stay as they are.
    The same key gives the same pseudonyms in every run. Rows neither move nor go.
    """
    t = F.col(text)
    secret = F.lit(key)
    hit = t.rlike(EVERY)
    none = F.array().cast("array<string>")
    matched, gaps, new = free_names(docs, "matched", "gaps", "new")
    found = F.when(hit, F.regexp_extract_all(t, F.lit(EVERY), F.lit(0))).otherwise(none)
    prepared = docs.withColumns(
        {
            matched: found,
            gaps: F.when(hit, F.split(t, EVERY, -1)).otherwise(none),
        }
    ).withColumn(new, F.transform(matched, lambda v: pseudonymise_value(secret, v)))
    rebuilt = F.array_join(
        F.zip_with(gaps, new, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), ""
    )
    made = {text: F.when(F.size(matched) > 0, rebuilt).otherwise(t)}
    if counts:
        changed = F.filter(
            F.zip_with(matched, new, lambda a, b: a != b), lambda x: x
        )
        made["n_pii"] = F.size(changed).cast("long")
        kinds = F.transform(matched, kind_of)
        for name in KINDS:
            same = F.size(kinds) - F.size(F.array_remove(kinds, name))
            made[f"n_{name}"] = same.cast("long")
    return prepared.withColumns(made).drop(matched, gaps, new)
