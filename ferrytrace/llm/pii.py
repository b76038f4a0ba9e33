"""Format-preserving pseudonyms for personal data in texts.

Numbers and dates that pass validation are permuted within their own format by keyed Feistel
networks: a card number becomes another valid card number, a date another date.  The permutation
depends on the key, the kind and the value only, so a value gets the same pseudonym in every document
and two values never share one.  Separators and layout stay.

DataFrame functions only; a text is rewritten where it is read, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrytrace.llm.common import free_name

ROUNDS = 8

# Day numbers run through whole cycles of 400 Gregorian years: 146,097 days, 189 * 773.
CYCLE_DAYS, CYCLE_LEFT, CYCLE_RIGHT = 146_097, 189, 773

# Kind -> pattern; the first that matches at a place decides.
PATTERNS = {
    # A mail domain runs to its last label that begins with two letters.  Every loop over a group is
    # possessive: the JVM's engine runs those without recursion, however long the text.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?=[A-Za-z0-9-])"
    r"(?:[A-Za-z0-9-]*+(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2,}+)++",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
    r"(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
}
KINDS = list(PATTERNS)

# Numbered back references have to count the groups of the whole pattern.
_UNION = (
    "|".join(f"(?<{kind}>{pattern})" for kind, pattern in PATTERNS.items())
    .replace(r"\1", r"\k<gapA>")
    .replace(r"\2", r"\k<gapB>")
    .replace("[0-9]{4}([ -])[0-9]{4}", "[0-9]{4}(?<gapA>[ -])[0-9]{4}")
    .replace("[0-9]{4}([ -])[0-9]{6}", "[0-9]{4}(?<gapB>[ -])[0-9]{6}")
)


def _noise(key: str, kind: str, turn: int, value: Column, modulus: int) -> Column:
    """A keyed pseudo-random number below ``modulus`` for a value."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|{turn}|"), value.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), F.lit(modulus).cast("long"))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often the expression mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def permute_pair(key: str, kind: str, value: Column, left: int, right: int) -> Column:
    """A keyed permutation of the numbers below ``left * right``."""
    state = F.struct(F.floor(value / right).cast("long").alias("l"), F.pmod(value, F.lit(right)).alias("r"))
    for turn in range(ROUNDS):

        def step(s: Column) -> Column:
            if turn % 2:
                moved = F.pmod(s["r"] + _noise(key, kind, turn, s["l"], right), F.lit(right).cast("long"))
                return F.struct(s["l"].alias("l"), moved.alias("r"))
            moved = F.pmod(s["l"] + _noise(key, kind, turn, s["r"], left), F.lit(left).cast("long"))
            return F.struct(moved.alias("l"), s["r"].alias("r"))

        state = _named(state, step)
    return _named(state, lambda s: s["l"] * right + s["r"])


def permute_text(key: str, kind: str, value: Column) -> Column:
    """A keyed permutation of texts that keeps the class of every character: digits stay digits,
    small and capital letters stay such, anything else stays itself."""

    def shifted(part: Column, other: Column, turn: int) -> Column:
        tagged = F.concat(F.lit(f"{key}|{kind}|{turn}|"), F.length(part).cast("string"), F.lit("|"), other)
        stream = F.sha2(tagged.cast("binary"), 512)

        def one(i: Column) -> Column:
            letter = F.substr(part, i, F.lit(1))
            byte = F.conv(F.substr(stream, F.pmod(i * 3, F.lit(125)) + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(letter)

            def moved(first: int, size: int) -> Column:
                return F.chr(F.lit(first) + F.pmod(code - first + byte, F.lit(size)))

            return (
                F.when(letter.rlike("^[0-9]$"), moved(48, 10))
                .when(letter.rlike("^[a-z]$"), moved(97, 26))
                .when(letter.rlike("^[A-Z]$"), moved(65, 26))
                .otherwise(letter)
            )

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), one), "")

    half = F.floor(F.length(value) / 2).cast("int")
    state = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))
    for turn in range(ROUNDS):

        def step(s: Column) -> Column:
            a, b = (s["l"], s["r"]) if turn % 2 else (s["r"], s["l"])
            moved = F.when(F.length(a) > 0, shifted(a, b, turn)).otherwise(a)
            left, right = (moved, b) if turn % 2 else (b, moved)
            return F.struct(left.alias("l"), right.alias("r"))

        state = _named(state, step)
    return _named(state, lambda s: F.concat(s["l"], s["r"]))


def luhn_sum(digits: Column, offset: int) -> Column:
    """Luhn's sum; ``offset`` 0 doubles every second digit from the last but one, 1 from the last."""
    size = F.length(digits)

    def weighed(i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        double = F.pmod(size - i + offset, F.lit(2)) == 1
        return F.when(double & (digit > 4), digit * 2 - 9).when(double, digit * 2).otherwise(digit)

    terms = F.transform(F.sequence(F.lit(1), size), weighed)
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(value: Column, digits: Column) -> Column:
    """The value with its digits replaced, in order, by others; all else keeps its place."""
    runs = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    gaps = F.split(value, "[0-9]+", -1)

    def piece(gap: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda a, r: a + F.length(r))
        size = F.coalesce(F.length(F.get(runs, i)), F.lit(0))
        return F.concat(gap, F.substr(digits, before + 1, size))

    return F.array_join(F.transform(gaps, piece), "")


def _email(key: str, value: Column) -> Column:
    at = F.instr(value, "@")
    return F.concat(permute_text(key, "email", F.substr(value, F.lit(1), at - 1)), F.substr(value, at))


def _date(key: str, value: Column) -> Column:
    formats = {"-": "yyyy-MM-dd", "/": "dd/MM/yyyy", ".": "dd.MM.yyyy"}

    def of(layout: str) -> Column:
        day = F.try_to_timestamp(value, F.lit(layout)).cast("date")
        number = F.datediff(day, F.lit("1800-01-01").cast("date")).cast("long")
        within = F.pmod(number, F.lit(CYCLE_DAYS).cast("long"))
        new = permute_pair(key, "date", within, CYCLE_LEFT, CYCLE_RIGHT)
        # Other cycles permute among themselves.
        shift = (new - within).cast("int")
        return F.when(day.isNotNull(), F.date_format(F.date_add(day, shift), layout)).otherwise(value)

    pairs = [(value.contains(mark), of(layout)) for mark, layout in formats.items()]
    return F.when(*pairs[0]).when(*pairs[1]).otherwise(pairs[2][1])


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = area - 1 - (area > 666).cast("long")
    new = permute_pair(key, "ssn", (rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999)

    def written(n: Column) -> Column:
        place = F.floor(n / (99 * 9999)).cast("long")
        return F.concat_ws(
            "-",
            F.lpad((place + 1 + (place >= 665).cast("long")).cast("string"), 3, "0"),
            F.lpad((F.pmod(F.floor(n / 9999).cast("long"), F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, _named(new, written)).otherwise(value)


def _card(key: str, value: Column) -> Column:
    digits = _digits(value)
    valid = (F.pmod(luhn_sum(digits, 0), F.lit(10)) == 0) & digits.rlike("[1-9]")
    middle = F.substr(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permute_text(key, "card", middle))

    def checked(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(luhn_sum(body, 1), F.lit(10)), F.lit(10))
        return F.concat(body, check.cast("string"))

    new = _named(body, checked)
    return F.when(valid, refilled(value, new)).otherwise(value)


def _ip(key: str, value: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    valid = F.forall(octets, lambda o: o < 256)
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    new = permute_pair(key, "ip", number, 1 << 16, 1 << 16)

    def written(n: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])

    return F.when(valid, _named(new, written)).otherwise(value)


def _phone(key: str, value: Column) -> Column:
    digits = _digits(value)
    valid = F.length(digits).between(10, 15)
    # A country code stays: its digits are part of the format.
    code = F.length(_digits(F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)))
    own = F.substr(digits, code + 1)
    new = F.concat(F.substr(digits, F.lit(1), code), permute_text(key, "phone", own))
    return F.when(valid, refilled(value, new)).otherwise(value)


_MAKERS = {"email": _email, "date": _date, "ssn": _ssn, "card": _card, "ip": _ip, "phone": _phone}


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of one found value; a value that fails validation stays as it is."""
    whole = {kind: F.rlike(value, F.lit(f"^(?:{pattern})$")) for kind, pattern in PATTERNS.items()}
    first, *rest = KINDS
    chosen = F.when(whole[first], _MAKERS[first](key, value))
    for kind in rest:
        chosen = chosen.when(whole[kind], _MAKERS[kind](key, value))
    return chosen.otherwise(value)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """The documents with personal data in ``text`` replaced; all columns and rows stay.

    ``count`` names a column for the number of values replaced (null texts: 0).  A null text stays
    null, an empty one empty.  Values that look right but fail validation (checksum, calendar, ranges,
    local parts of over 64 characters) stay.  Repeated rows are treated alike, an empty table gives
    none, and columns may have any names, this function's own included.  Texts of any length are
    rewritten whole.
    """
    found, new = free_name(docs, "found_values"), free_name(docs, "new_values")
    content = F.coalesce(F.col(text), F.lit(""))
    any_found = F.rlike(content, F.lit(_UNION))
    values = F.when(any_found, F.regexp_extract_all(content, F.lit(_UNION), F.lit(0))).otherwise(F.array())
    marked = docs.withColumn(found, values)
    marked = marked.withColumn(new, F.transform(F.col(found), lambda v: pseudonym(key, v)))
    gaps = F.split(F.col(text), _UNION, -1)
    joined = F.array_join(
        F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col(new), i), F.lit("")))), ""
    )
    changed = F.when(F.size(found) > 0, joined).otherwise(F.col(text))
    replaced = F.zip_with(found, new, lambda a, b: (a != b).cast("long"))
    total = F.aggregate(replaced, F.lit(0).cast("long"), lambda a, b: a + b)
    columns = [changed.alias(c) if c == text else F.col(c) for c in docs.columns]
    return marked.select(*columns, *([total.alias(count)] if count else []))
