"""Personal data replaced by format-preserving keyed pseudonyms, with DataFrame functions only.

Each kind has a pattern and a validity test (Luhn for cards, mod 97 for IBANs, octets, area numbers, calendar).
A valid value is permuted by a keyed Feistel network within its format, so the same value gets the same
pseudonym in every document and two values of a kind never share one:

* cards: the digits between the first and the last; the last is the new Luhn digit.  Of digits that run on after a
  card, the longest start that ends with a group of digits and passes the test is the card;
* social security numbers: over valid areas and the digits after them; phone numbers: the digits after the country code
  of an international number, after the first digit of others;
* IPv4 addresses: 32 bits; IBANs: the account part, with new check digits;
* dates from 1900 to 2099: their 73,049 days, written as the value was (order, separators, with or without leading
  zeros).  A date with slashes is month first if it can be; those that cannot are permuted among themselves, by
  walking the cycle until the day is over 12 again, so the two readings never meet;
* e-mail addresses: local part and domain apart (all but the last label), each with case folded and put back, so an address
  is linked whatever its case and a domain across its mailboxes; secrets: each letter and digit within its own class.

The round function is SHA-256 of key, kind, round and the other half.  The key is ``spark.tallyloom.pseudonymKey`` of
the session; the one in the source serves tests only, as anyone can undo it.  Kinds are tried in the order of
``KINDS`` over what is still original text: a value that was replaced is never read again, so where matches overlap
the earlier kind has it.  Values that fail the test stay.

Defined results: a null text stays null with no values found, an empty one empty; every row is kept, repeated or
not; a column of the table that shares a helper's name is not touched (helpers carry a random suffix), one that is
named like the count is replaced by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "tallyloom"
KEY_CONF = "spark.tallyloom.pseudonymKey"
ROUNDS = 8
#: Steps of a walk along a cycle; each ends it with a probability over a half.
WALK = 64
#: Days from 1900-01-01 to 2099-12-31 as a product, for a Feistel network of unequal halves.
DAYS = (17, 4297)
FIRST_DAY = "1900-01-01"


def _round(key: str, kind: str, r: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), x.cast("string")), 256)


def _number(key: str, kind: str, r: Column, x: Column) -> Column:
    return F.conv(F.substring(_round(key, kind, r, x), 1, 12), 16, 10).cast("long")


def permuted_pair(high: Column, low: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """struct(high, low): a permutation of pairs with high in 0..a-1 and low in 0..b-1."""
    start = F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        moved = F.pmod(F.when(even, s["high"]).otherwise(s["low"]) + _number(key, kind, r, F.when(even, s["low"]).otherwise(s["high"])), F.when(even, a).otherwise(b))
        return F.struct(F.when(even, moved).otherwise(s["high"]).alias("high"), F.when(even, s["low"]).otherwise(moved).alias("low"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of at least two and at most 36 digits, permuted among those of its length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    cut = F.struct(digits.substr(F.lit(1), h).cast("long").alias("high"), digits.substr(h + 1, n - h).cast("long").alias("low"))
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = permuted_pair(cut["high"], cut["low"], size(h), size(n - h), key, kind)
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["high"].cast("string"), h, "0"), F.lpad(p["low"].cast("string"), n - h, "0")))[0]


def permuted_text(value: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted each within its class; other characters stay."""
    n = F.length(value)
    h = F.floor(n / 2).cast("int")
    start = F.struct(value.substr(F.lit(1), h).alias("high"), value.substr(h + 1, n - h).alias("low"))

    def shifted(half: Column, digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(digest.substr(2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda base, size: F.chr(F.lit(base) + F.pmod(F.ascii(c) - base + by, F.lit(size)))
            return F.when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).when(c.between("0", "9"), turn(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        moved = shifted(F.when(even, s["high"]).otherwise(s["low"]), _round(key, kind, r, F.when(even, s["low"]).otherwise(s["high"])))
        return F.struct(F.when(even, moved).otherwise(s["high"]).alias("high"), F.when(even, s["low"]).otherwise(moved).alias("low"))

    out = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)
    return F.transform(F.array(out), lambda p: F.concat(p["high"], p["low"]))[0]


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value computed once."""
    return F.transform(F.array(value), make)[0]


def _written(value: Column, shape: Column, chars: str) -> Column:
    """The characters of ``value`` put in the places of ``shape`` that hold one of ``chars``."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        place = c.rlike(chars)
        return F.struct(F.concat(s["out"], F.when(place, value.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + place.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), state, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits, every second from the right doubled, from the last one if ``doubled`` is 0."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    def step(a: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card_of(m: Column) -> Column:
    """The longest start of ``m`` of 13 to 19 digits which ends where a group of digits ends and passes the test; null if none."""
    def start(n: int) -> Column:
        found = F.regexp_extract(m, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0)
        return _let(found, lambda c: F.when((c != "") & (luhn_sum(_digits(c), 1) % 10 == 0), c))

    return F.coalesce(*(start(n) for n in range(19, 12, -1)))


def _card(m: Column, key: str) -> Column:
    def made(d: Column, card: Column) -> Column:
        body = lambda d: F.concat(d.substr(F.lit(1), F.lit(1)), permuted_digits(d.substr(F.lit(2), F.length(d) - 2), key, "card"))
        whole = _let(body(d), lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.concat(_let(whole, lambda w: _written(w, card, "[0-9]")), m.substr(F.length(card) + 1, F.length(m)))

    return _let(_card_of(m), lambda card: _let(_digits(card), lambda d: made(d, card)))


def _ssn(m: Column, key: str) -> Column:
    area, rest = m.substr(1, 3).cast("long"), F.concat(m.substr(5, 2), m.substr(8, 4)).cast("long")
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas: 1 to 899 without 666
    serial = F.floor(rest / 10_000).cast("long") * 9_999 + rest % 10_000 - 10_000
    def back(p: Column) -> Column:
        a = p["high"] + F.when(p["high"] >= 665, 2).otherwise(1)
        group, number = F.floor(p["low"] / 9_999).cast("long") + 1, p["low"] % 9_999 + 1
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(number.cast("string"), 4, "0"))

    return _let(permuted_pair(index, serial, F.lit(898), F.lit(99 * 9_999), key, "ssn"), back)


#: Country calling codes by their leading digits: one digit, two, else three (fixed values).
_COUNTRY = "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        head = F.when(m.startswith("+"), F.regexp_extract(d, _COUNTRY, 0)).otherwise(d.substr(1, 1))
        return _let(head, lambda h: F.concat(h, permuted_digits(d.substr(F.length(h) + 1, F.length(d)), key, "phone")))

    return _let(_let(_digits(m), new), lambda d: _written(d, m, "[0-9]"))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda o: o.cast("long"))
    pair = _let(octets, lambda o: permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536), key, "ip"))
    return _let(pair, lambda p: F.concat_ws(".", *(x.cast("string") for h in ("high", "low") for x in (F.shiftright(p[h], 8), p[h] % 256))))


def _iban(m: Column, key: str) -> Column:
    def made(v: Column) -> Column:
        country = v.substr(F.lit(1), F.lit(2))
        account = permuted_text(v.substr(F.lit(5), F.length(v) - 4), key, "iban")
        whole = _let(account, lambda a: F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return _let(whole, lambda w: _written(w, m, "[0-9A-Z]"))

    return _let(F.replace(m, F.lit(" "), F.lit("")), made)


#: How dates are written: pattern of the text, format, format without leading zeros.
_DATES = ((r"^\d{4}-", "yyyy-MM-dd", "yyyy-M-d"), (r"^\d{1,2}\.", "dd.MM.yyyy", "d.M.yyyy"), (r"^(?:0?[1-9]|1[0-2])/", "MM/dd/yyyy", "M/d/yyyy"), ("/", "dd/MM/yyyy", "d/M/yyyy"))
_DAY_FIRST = r"^(?!(?:0?[1-9]|1[0-2])/)\d{1,2}/"


def _padded(m: Column) -> Column:
    return F.regexp_replace(m, r"(?<!\d)(\d)(?!\d)", "0$1")


def _day(m: Column) -> Column:
    found = F.coalesce(*(F.when(m.rlike(p), F.to_date(F.try_to_timestamp(_padded(m), F.lit(f)))) for p, f, _ in _DATES))
    return F.datediff(found, F.lit(FIRST_DAY).cast("date"))


def _date_of(day: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))


def _date(m: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        pair = permuted_pair(F.floor(d / DAYS[1]), d % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
        return _let(pair, lambda p: p["high"] * DAYS[1] + p["low"])

    def walked(d: Column) -> Column:
        step = lambda s, _: F.when((s >= 0) & (F.dayofmonth(_date_of(s)) > 12), s).otherwise(permuted(F.when(s < 0, -1 - s).otherwise(s)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), -1 - d, step)  # negative: not yet moved

    def written(day: Column) -> Column:
        bare = m.rlike(r"(?<!\d)\d(?!\d)")
        return F.coalesce(*(F.when(m.rlike(p), F.when(bare, F.date_format(_date_of(day), short)).otherwise(F.date_format(_date_of(day), long))) for p, long, short in _DATES))

    return _let(_day(m).cast("long"), lambda d: _let(F.when(m.rlike(_DAY_FIRST), walked(d)).otherwise(permuted(d)), written))


def _folded(value: Column, key: str, kind: str) -> Column:
    """``value`` permuted without regard to case, each letter in the case of its place."""
    made = permuted_text(F.lower(value), key, kind)
    cased = lambda p: F.array_join(F.zip_with(F.split(p, ""), F.split(value, ""), lambda c, o: F.when(o.between("A", "Z"), F.upper(c)).otherwise(c)), "")
    return _let(made, cased)


def _email(m: Column, key: str) -> Column:
    last = F.regexp_extract(m, "\\.[A-Za-z]+$", 0)
    at = F.instr(m, "@")
    local, domain = m.substr(F.lit(1), at - 1), m.substr(at + 1, F.length(m) - F.length(last) - at)
    return F.concat(_folded(local, key, "email"), F.lit("@"), _folded(domain, key, "domain"), last)


_NAMED = "(?is)^(.*?[=:]\\s*[\"']?)(\\S.*)$"


def _named_secret(m: Column, key: str) -> Column:
    return F.concat(F.regexp_extract(m, _NAMED, 1), permuted_text(F.regexp_extract(m, _NAMED, 2), key, "secret"))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(m.substr(1, 4), permuted_text(m.substr(5, 16), key, "secret"))


def _always(m: Column) -> Column:
    return F.lit(True)


def _is_secret(m: Column) -> Column:
    """A password may be any word; the value of a token or key holds a digit, else it is prose."""
    return m.rlike("(?i)^(?:password|passwd|pwd)") | F.regexp_extract(m, _NAMED, 2).rlike("[0-9]")


#: name: (pattern, validity, replacement), applied in this order.
KINDS: dict[str, tuple[str, Callable, Callable]] = {
    "secret": ("(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\\s*[=:]\\s*[\"']?[^\\s\"']{6,}", _is_secret, _named_secret),
    "access_key": ("(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])", _always, _access_key),
    "email": ("(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", _always, _email),
    "iban": ("(?<![A-Z0-9])[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])", lambda m: _let(F.replace(m, F.lit(" "), F.lit("")), lambda v: F.length(v).between(15, 34) & (mod97(F.concat(v.substr(F.lit(5), F.length(v)), v.substr(F.lit(1), F.lit(4)))) == 1)), _iban),
    "ip": ("(?<![\\d.])\\d{1,3}(?:\\.\\d{1,3}){3}(?![\\d]|\\.\\d)", lambda m: F.forall(F.split(m, "\\."), lambda o: (o.cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0"))), _ip),
    "card": ("(?<![\\d.-])\\d(?:[ -]?\\d){12,18}(?![\\d]|[.-]\\d)", lambda m: _card_of(m).isNotNull(), _card),
    "ssn": ("(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])", lambda m: ~m.substr(1, 3).isin("000", "666") & (m.substr(1, 1) != "9") & (m.substr(5, 2) != "00") & (m.substr(8, 4) != "0000"), _ssn),
    "phone": ("(?<![\\d+])(?:\\+\\d{1,3}[ .-]?(?:\\(\\d{1,4}\\)[ .-]?)?\\d{1,4}(?:[ .-]?\\d{2,4}){1,4}|(?:\\(\\d{3}\\) ?|(?<![\\d.-])\\d{3}[ .-])\\d{3}[ .-]\\d{4})(?![\\d]|[-]\\d)", lambda m: F.length(_digits(m)).between(8, 15), _phone),
    "date": ("(?<![\\d./-])(?:(?:19|20)\\d{2}-\\d{1,2}-\\d{1,2}|\\d{1,2}/\\d{1,2}/(?:19|20)\\d{2}|\\d{1,2}\\.\\d{1,2}\\.(?:19|20)\\d{2})(?![\\d/-]|\\.\\d)", lambda m: F.coalesce(_day(m).between(0, DAYS[0] * DAYS[1] - 1), F.lit(False)), _date),
}


def _swapped(text: Column, pattern: str, valid: Callable, made: Callable, key: str) -> Column:
    """``text`` as parts (t, done): valid matches of the pattern replaced and done, what lies between them as it was."""
    none = F.array().cast("array<struct<t:string,done:boolean>>")
    part = lambda t, done: F.array(F.struct(t.alias("t"), F.lit(done).alias("done")))

    def step(s: Column, x: Column) -> Column:
        before, m = F.concat(s["open"], x["before"]), x["m"]
        made_ = F.when(m.isNotNull() & valid(m), made(m, key))
        return _let(made_, lambda new: F.struct(
            F.when(new.isNull(), s["parts"]).otherwise(F.concat(s["parts"], part(before, False), part(new, True))).alias("parts"),
            F.when(new.isNull(), F.concat(before, F.coalesce(m, F.lit("")))).otherwise(F.lit("")).alias("open"),
        ))

    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, m: F.struct(b.alias("before"), m.alias("m")))
    return F.aggregate(pieces, F.struct(none.alias("parts"), F.lit("").alias("open")), step, lambda s: F.concat(s["parts"], part(s["open"], False)))


def pseudonymised(docs: DataFrame, text: str = "text", key: str | None = None, counts: str | None = "n_replaced") -> DataFrame:
    """``docs`` with pseudonyms in the text column and, if asked for, the number of values replaced."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY)
    parts = f"_parts_{uuid.uuid4().hex[:8]}"
    whole = F.struct(F.col(f"`{text}`").cast("string").alias("t"), F.lit(False).alias("done"))
    out = docs.withColumn(parts, F.array(whole))

    def split_by(pattern: str, valid: Callable, made: Callable) -> Callable[[Column], Column]:
        return lambda s: F.when(~s["done"] & s["t"].rlike(pattern), _swapped(s["t"], pattern, valid, made, key)).otherwise(F.array(s))

    for kind in KINDS.values():
        out = out.withColumn(parts, F.flatten(F.transform(parts, split_by(*kind))))
    done = F.when(F.col(f"`{text}`").isNotNull(), F.array_join(F.transform(parts, lambda s: s["t"]), ""))
    columns = [done.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != counts]
    return out.select(*columns, *([F.size(F.filter(parts, lambda s: s["done"])).cast("long").alias(counts)] if counts else []))
