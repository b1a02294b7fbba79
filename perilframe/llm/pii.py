"""Format-preserving pseudonyms of personal data, by keyed Feistel networks in Spark's own functions.

A value is a row of symbols, each with the size of its alphabet (10 for a digit, 26 for a letter of
either case, 256 for an octet, 1 for a separator). The row is halved; in turn, each half is shifted,
symbol by symbol and modulo its alphabet, by SHA-512 of the key, the round and the other half. Every
round can be undone, so values of one format are permuted: equal values get equal pseudonyms in every
document, different ones different pseudonyms, and length, separators and character classes stay.

Numbers are validated before: card numbers by their check digit, which is computed anew; bank account
numbers (IBAN) by theirs; octets of addresses by range; social security numbers by area, group and
serial; dates by the calendar. The digits of cards, phone and account numbers are permuted without
their separators, which are put back, so that a number is linked however it is written; a North
American phone number, with and without its +1. A date is a day within its 400-year cycle (146,097 = 189 * 773 days, from
1800-01-01; years 200 to 9799) and is permuted there; a slash date is read month first only where it is
no calendar day otherwise, and stays such a date. In a run of digit groups, the longest valid card
numbers of whole groups are taken. Long secrets are permuted in parts of ``PART`` characters.
What is no valid value stays as it is. The key stands in the query's plan: guard event logs as the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, PART = 8, 256
#: Java patterns, tried in this order at each place. A match is whole; no value may touch another word.
_NAMED = r"(?i:password|passwd|token|secret|api[_-]?key)\s?[=:]\s?\"?"
_BEARER = r"(?i:bearer)\s{1,3}"
_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
KINDS = {
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "assigned": rf"{_NAMED}[^\s\"]{{8,}}",
    "bearer": rf"(?<!\w){_BEARER}(?=[^\s]*\d)[A-Za-z0-9._~+/=-]{{16,}}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)",
    "dialled": r"(?<![\w+])\+[1-9]\d{7,14}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iso_date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])",
    "day_date": r"(?<![\w/.])\d{2}[/.]\d{2}[/.]\d{4}(?!\w)",
    "month_date": rf"(?<![\w/.])\d{{1,2}} (?:{_MONTHS}) \d{{4}}(?!\w)",
    "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "address6": r"(?<![\w:.])(?=(?:[0-9A-Fa-f]{1,4}:){7}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f:]*::)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])",
}
#: A run of digit groups of 13 digits or more, up to where a value of another kind begins.
_NO_CARD = "|".join(KINDS[k] for k in ("phone", "ssn", "iso_date", "day_date", "month_date", "address"))
KINDS["card"] = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}})\d++(?!\w)(?:[ -](?!{_NO_CARD})\d++(?!\w))*+"
PATTERN = "|".join(KINDS.values())
#: Any text with a value holds one of these; others aren't searched.
_HINT = r"@|\d{3}|\d\.\d|\d/\d|AKIA|::|(?:[0-9A-Fa-f]:){3}|(?i:password|passwd|token|secret|api[_-]?key|bearer)"
_EPOCH = "DATE'1800-01-01'"


def _shifted(half: Column, sizes: Column, other: Column, tag: Column, n: Column) -> Column:
    """half, shifted by what the key, the tag, the round and the other half say."""
    said = F.sha2(F.concat_ws("|", tag, n.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 512)
    stream = lambda i: F.conv(F.substring(said, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
    return F.transform(half, lambda x, i: F.pmod(x + stream(i), F.get(sizes, i)))


def feistel(values: Column, sizes: Column, tag: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the rows of symbols with these alphabet sizes."""
    middle = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - middle
    left_sizes, right_sizes = F.slice(sizes, 1, middle), F.slice(sizes, middle + 1, rest)
    turn = lambda s, n: F.when(
        n % 2 == 0,
        F.struct(_shifted(s["l"], left_sizes, s["r"], tag, n).alias("l"), s["r"].alias("r")),
    ).otherwise(F.struct(s["l"].alias("l"), _shifted(s["r"], right_sizes, s["l"], tag, n).alias("r")))
    start = F.struct(F.slice(values, 1, middle).alias("l"), F.slice(values, middle + 1, rest).alias("r"))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: F.concat(s["l"], s["r"])))


_HEX, _DIGITS, _LOWER, _UPPER = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permuted(text: Column, tag: Column) -> Column:
    """Digits, letters of either case, and lower-case hexadecimal words keep their class and place."""
    hexa = text.rlike(r"^(?=.*\d)(?=.*[a-f])[0-9a-f]{16,}$")
    chars = F.split(text, "")
    at = lambda alphabet, c: F.position(c, F.lit(alphabet)) - 1
    known = lambda alphabet, c: F.position(c, F.lit(alphabet)) > 0
    value = lambda c: (
        F.when(hexa, at(_HEX, c)).when(known(_DIGITS, c), at(_DIGITS, c)).when(known(_LOWER, c), at(_LOWER, c)).when(known(_UPPER, c), at(_UPPER, c)).otherwise(F.lit(0))
    )
    size = lambda c: F.when(hexa, F.lit(16)).when(known(_DIGITS, c), F.lit(10)).when(known(_LOWER, c) | known(_UPPER, c), F.lit(26)).otherwise(F.lit(1))
    new = feistel(F.transform(chars, value), F.transform(chars, size), tag)
    symbol = lambda alphabet, v: F.substring(F.lit(alphabet), v + 1, F.lit(1))
    out = F.zip_with(chars, new, lambda c, v: F.when(hexa, symbol(_HEX, v)).when(known(_DIGITS, c), symbol(_DIGITS, v)).when(known(_LOWER, c), symbol(_LOWER, v)).when(known(_UPPER, c), symbol(_UPPER, v)).otherwise(c))
    return F.array_join(out, "")


def _luhn(digits: Column, check: bool) -> Column:
    """The sum modulo 10; ``check``: of a number whose check digit is still to come."""
    doubled = 0 if check else 1
    order = F.reverse(F.split(digits, ""))
    worth = F.transform(order, lambda c, i: F.when(i % 2 == doubled, F.lit(2) * c.cast("int") - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(worth, F.lit(0), lambda a, x: a + x), F.lit(10))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _refilled(text: Column, symbols: Column, kind: str = "0-9") -> Column:
    """text with its characters of a kind replaced by these, in order: separators stay where they are."""
    seen = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), f"[^{kind}]", ""))
    fill = lambda new: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(f"[{kind}]"), F.substring(new, seen(i), F.lit(1))).otherwise(c)), "")
    return F.when(text.rlike(f"[^{kind}]"), _let(symbols, fill)).otherwise(symbols)


def _mod97(text: Column) -> Column:
    """The remainder of an account number's characters, country and check digits last."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + value(c), F.lit(97)))


def _account(m: Column, tag: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    country, own = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    check = lambda new: F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_mod97(F.concat(own, F.substring(bare, 1, 4))) == 1, _refilled(m, _let(permuted(own, tag), lambda new: F.concat(country, check(new), new)), "A-Z0-9"))


def _date(m: Column, fmt: str, tag: Column) -> Column:
    day = F.try_to_timestamp(m, F.lit(fmt)).cast("date")
    n = F.datediff(day, F.expr(_EPOCH))
    cycle, inside = F.floor(n / 146_097), F.pmod(n, F.lit(146_097))
    new = feistel(F.array(F.floor(inside / 773).cast("int"), F.pmod(inside, F.lit(773)).cast("int")), F.array(F.lit(189), F.lit(773)), tag)
    moved = F.date_add(F.expr(_EPOCH), (cycle * 146_097 + F.get(new, F.lit(0)) * 773 + F.get(new, F.lit(1))).cast("int"))
    return F.when(day.isNotNull() & (F.date_format(day, fmt) == m) & F.year(day).between(200, 9799), F.date_format(moved, fmt))


def _parts(text: Column, tag: Column) -> Column:
    """permuted, part by part."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(PART))
    return F.array_join(F.transform(starts, lambda at: permuted(F.substring(text, at, F.lit(PART)), tag)), "")


def _month_first(m: Column, tag: Column) -> Column:
    """A date that is none day first, moved on until it is such a one again: so no two meet."""
    moved = lambda x: _date(x, "MM/dd/yyyy", tag)
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), moved(m), lambda x, _: F.when(F.substring(x, 4, 2) > "12", x).otherwise(moved(x)))


#: Groups that a card number has at most, digits that it has, and readings that a sweep keeps in one array.
_GROUPS, _LEAST, _MOST, _SWEEP = 19, 13, 19, 512


def _readings(groups: Column) -> Column:
    """For each group, the valid card numbers of whole groups that begin there: (i, j, text, odd, digits); odd ones aren't written as cards are."""
    usual = lambda text: text.rlike(r"^(?:\d+|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})$")

    def entry(i: Column, j: Column) -> Column:
        text = F.regexp_replace(F.array_join(F.slice(groups, i, j - i + 1), ""), "[ -]$", "")
        return _let(text, lambda t: F.struct(i.alias("i"), j.alias("j"), t.alias("text"), (~usual(t)).alias("odd"), F.length(_digits(t)).alias("digits")))

    def begun(lengths: Column, i: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.filter(F.array(i), lambda x: F.lit(False)).alias("at"))
        step = lambda s, j: _let(s["n"] + F.get(lengths, j - 1), lambda n: F.struct(n.alias("n"), F.when(n.between(_LEAST, _MOST), F.concat(s["at"], F.array(j))).otherwise(s["at"]).alias("at")))
        ends = F.aggregate(F.sequence(i, F.least(F.size(groups), i + _GROUPS - 1)), start, step, lambda s: s["at"])
        return F.filter(F.transform(ends, lambda j: entry(i, j)), lambda c: _luhn(_digits(c["text"]), False) == 0)

    lengths = F.transform(groups, lambda g: F.length(_digits(g)))
    return _let(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: begun(n, i)))


def _swept(items: Column) -> Column:
    """Of readings in order, each that begins after the last one taken ends."""
    one = lambda s, c: F.when(c["i"] > s["last"], F.struct(c["j"].alias("last"), F.concat(s["out"], F.array(c)).alias("out"))).otherwise(s)
    none = F.filter(items, lambda c: F.lit(False))
    some = lambda k: F.slice(items, k * _SWEEP + 1, _SWEEP)
    part = lambda last, k: F.aggregate(some(k), F.struct(last.alias("last"), none.alias("out")), one)
    step = lambda s, k: _let(part(s["last"], k), lambda r: F.struct(r["last"].alias("last"), F.concat(s["out"], F.array(r["out"])).alias("out")))
    start = F.struct(F.lit(0).alias("last"), F.filter(F.array(items), lambda c: F.lit(False)).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(items) / _SWEEP).cast("int")), start, step, lambda s: F.flatten(s["out"]))


def _ends(taken: Column) -> Column:
    """0, and where each of the readings taken ends."""
    return F.concat(F.array(F.lit(0)), F.transform(taken, lambda t: t["j"]))


def _covered(taken: Column, n: Column) -> Column:
    """Whether each of n groups is in one of the readings taken, which are in order and apart."""
    marks = lambda ends: F.concat(
        F.flatten(F.transform(taken, lambda t, k: F.concat(F.array_repeat(F.lit(False), t["i"] - F.get(ends, k) - 1), F.array_repeat(F.lit(True), t["j"] - t["i"] + 1)))),
        F.array_repeat(F.lit(False), n - F.get(ends, F.size(taken))),
    )
    return _let(_ends(taken), marks)


def _taken(found: Column, n: Column) -> Column:
    """Readings that don't overlap, in order: those written as cards are go first, then the longest, then the first. A sweep for each kind."""

    def step(taken: Column, k: Column) -> Column:
        kind = lambda c: (c["odd"] == (k >= _MOST - _LEAST + 1)) & (c["digits"] == _MOST - F.pmod(k, F.lit(_MOST - _LEAST + 1)))
        free = lambda marks: F.filter(found, lambda c: kind(c) & ~F.exists(F.slice(marks, c["i"], c["j"] - c["i"] + 1), lambda x: x))
        more = _let(_covered(taken, n), lambda marks: _let(free(marks), _swept))
        return F.when(F.exists(found, kind), F.array_sort(F.concat(taken, more))).otherwise(taken)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * (_MOST - _LEAST + 1) - 1)), F.filter(found, lambda c: F.lit(False)), step)


def _cards(m: Column, tag: Column) -> Column:
    """(text, n) of a run of digit groups with its n valid card numbers replaced; text is null without any.

    What another reading that is written as a card has beside them is permuted, too: one reading in ten is
    valid by chance, and no part of a real one may stay. Work goes with the number of groups.
    """

    def renewed(c: Column) -> Column:
        body = lambda d: permuted(F.substring(d, F.lit(1), F.length(d) - 1), tag)
        return _refilled(c, _let(_let(_digits(c), body), lambda x: F.concat(x, F.pmod(F.lit(10) - _luhn(x, True), F.lit(10)).cast("string"))))

    def text(groups: Column, last: Column, taken: Column) -> Column:
        seen = lambda p: F.exists(F.slice(last, F.greatest(p - _GROUPS + 1, F.lit(1)), F.least(p, F.lit(_GROUPS))), lambda j: j >= p)
        gap = lambda a, z: F.transform(F.slice(groups, a, F.greatest(z - a + 1, F.lit(0))), lambda g, k: F.when(seen(a + k), permuted(g, tag)).otherwise(g))
        card = lambda t: F.concat(renewed(t["text"]), F.regexp_extract(F.get(groups, t["j"] - 1), "([ -]?)$", 1))
        pieces = lambda ends: F.concat(F.flatten(F.transform(taken, lambda t, k: F.concat(gap(F.get(ends, k) + 1, t["i"] - 1), F.array(card(t))))), gap(F.get(ends, F.size(taken)) + 1, F.size(groups)))
        return F.array_join(_let(_ends(taken), pieces), "")

    def found(groups: Column, readings: Column) -> Column:
        last = F.transform(readings, lambda a: F.coalesce(F.array_max(F.transform(F.filter(a, lambda c: ~c["odd"]), lambda c: c["j"])), F.lit(0)))
        chosen = lambda last: _let(_let(F.flatten(readings), lambda every: _taken(every, F.size(groups))), lambda t: F.struct(F.when(F.size(t) > 0, text(groups, last, t)).alias("text"), F.size(t).alias("n")))
        return _let(last, chosen)

    groups = F.regexp_extract_all(m, F.lit(r"(\d+[ -]?)"), F.lit(1))
    return _let(groups, lambda g: _let(_readings(g), lambda r: found(g, r)))


def pseudonym(m: Column, key: str) -> Column:
    """(text, n): the pseudonym of a match, null if it isn't valid, and the number of values replaced."""
    one = lambda p: F.struct(p.alias("text"), p.isNotNull().cast("int").alias("n"))
    return F.when(m.rlike(f"^(?:{KINDS['card']})$"), _cards(m, F.lit(f"{key}|card"))).otherwise(F.get(F.transform(F.array(_pseudonym(m, key)), one), F.lit(0)))


def _pseudonym(m: Column, key: str) -> Column:
    tag = lambda kind: F.lit(f"{key}|{kind}")
    is_kind = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    name = F.regexp_extract(m, f"^({_NAMED}|{_BEARER})", 1)
    dot = F.length(m) - F.length(F.substring_index(m, ".", -1))
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    prefix = F.regexp_extract(m, r"^(\+\d{1,3}[ .-]?)(?=\D*\d{3}\D*\d{3}\D*\d{4}$)", 1)
    dialled = F.regexp_extract(m, r"^(\+1(?=\d{10}$)|\+\d\d)", 1)
    number = lambda p: F.concat(p, _refilled(F.substring(m, F.length(p) + 1, F.length(m)), permuted(_digits(F.substring(m, F.length(p) + 1, F.length(m))), tag("phone"))))
    separator = F.substring(m, 3, 1)
    month_date = F.coalesce(*(_date(m, f, tag("date")) for f in ("d MMM yyyy", "d MMMM yyyy", "dd MMM yyyy", "dd MMMM yyyy")))
    return (
        F.when(is_kind("secret"), F.concat(F.lit("AKIA"), permuted(F.substring(m, 5, 16), tag("secret"))))
        .when(F.length(name) > 0, F.concat(name, _parts(F.substring(m, F.length(name) + 1, F.length(m)), tag("assigned"))))
        .when(is_kind("email"), F.concat(permuted(F.substring(m, F.lit(1), dot - 1), tag("email")), F.substring(m, dot, F.length(m))))
        .when(is_kind("iban"), _account(m, tag("account")))
        .when(is_kind("phone"), number(prefix))
        .when(is_kind("dialled"), number(dialled))
        .when(is_kind("ssn"), F.when(~m.rlike(r"^(?:000|666|9)|^\d{3}-00|0000$"), permuted(m, tag("ssn"))))
        .when(is_kind("iso_date"), _date(m, "yyyy-MM-dd", tag("date")))
        .when(is_kind("day_date"), F.when(separator == "/", F.coalesce(_date(m, "dd/MM/yyyy", tag("date")), _month_first(m, tag("date")))).otherwise(_date(m, "dd.MM.yyyy", tag("date"))))
        .when(is_kind("month_date"), month_date)
        .when(is_kind("address6"), permuted(m, tag("address6")))
        .when(is_kind("address"), F.when(F.forall(octets, lambda x: x < 256), F.array_join(F.transform(feistel(octets, F.array_repeat(F.lit(256), 4), tag("address")), lambda x: x.cast("string")), ".")))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the personal data in ``text`` replaced, ``n_chars`` to match, and ``n_pii``, the values replaced.

    Whole texts are searched. Null and empty texts stay, with none; a row for each row; every other
    column is passed on, but for an ``n_pii``, whose place the new one takes. Linked: under one key, a
    value has the same pseudonym wherever it is found.
    """
    docs = docs.drop("n_pii")
    found_, new_ = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("found", "new"))
    found = F.regexp_extract_all("text", F.lit(f"({PATTERN})"), F.lit(1))
    parts = F.split("text", PATTERN, -1)
    step = docs.withColumn(found_, F.when(F.col("text").rlike(_HINT), found)).withColumn(found_, F.when(F.size(found_) > 0, F.col(found_)))
    step = step.withColumn(new_, F.transform(found_, lambda m: pseudonym(m, key)))
    pieces = F.zip_with(parts, F.zip_with(found_, new_, lambda m, p: F.coalesce(p["text"], m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.col(found_).isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    count = F.coalesce(F.aggregate(new_, F.lit(0), lambda n, p: n + p["n"]), F.lit(0))
    out = step.withColumn("n_pii", F.when(F.col(found_).isNull(), F.lit(0)).otherwise(count).cast("long")).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, "n_pii")
