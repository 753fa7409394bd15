"""Operator 6: personal data replaced by format-preserving Feistel pseudonyms.

Every kind of value is a number in a product of two small ranges, a * b, or two
halves of a string.  A keyed Feistel network permutes it there: round by round
one half is shifted by a keyed digest of the other, so the map is a bijection of
the format.  Equal values therefore get equal pseudonyms in every document,
different values different ones, and whoever holds the key can invert it.

Kinds: payment card numbers (13 to 19 digits with a right check digit, also
beside other groups of digits; the pseudonym has one too), dates of 1800 to 2199
(permuted among the days of those 400 years, with slashes among those that are
read in the same order), US social security numbers of issuable areas, phone
numbers, IBANs (country kept, check digits made anew), IPv4 and IPv6 addresses,
e-mail addresses (the local part), access keys, long hexadecimal tokens, signed web
tokens and bearer tokens, private key blocks and the values of password-like
assignments.  Numbers that fail validation stay as they are; nothing is shortened.

Everything is built-in column functions on one pass over the rows, without a
shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import plain

ROUNDS = 8

# What each kind looks like.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]++-----END [A-Z ]*PRIVATE KEY-----"
WEB_TOKEN = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]*)?"
BEARER = r"(?<![A-Za-z])(?i:bearer)\s{1,3}(?=[^\s]*[0-9])[A-Za-z0-9._~+/=-]{16,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
GROUP = r"[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}(?::{GROUP}){{0,5}})?::(?:{GROUP}(?::{GROUP}){{0,5}}))(?![0-9A-Za-z:])"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
ASSIGNED = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}"
# A value ends at its closing quote or at white space; a quote before a letter or digit closes nothing.
BARE = r"(?:[^\s\"']{8,}|[^\s\"']{1,7}[\"'][A-Za-z0-9][^\s\"']{5,})(?:[\"'](?=[A-Za-z0-9])[^\s\"']+){0,8}"
SECRET = ASSIGNED + rf"(?:\"[^\"\r\n]{{8,}}(?=\")|'[^'\r\n]{{8,}}(?=')|[\"']?{BARE})"
WHOLE_SECRET = ASSIGNED + rf"(?:\"[^\"\r\n]{{8,}}|'[^'\r\n]{{8,}}|[\"']?{BARE})"  # without what follows
HEX_SECRET = r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
# A run of 13 to 19 digits may also begin and end inside a longer one, at its groups.
CARD_INSIDE = r"(?<![0-9A-Za-z.])(?<!(?<![0-9])-)(?=([0-9](?:[ -]?[0-9]){%d})(?![0-9A-Za-z]))"
CARD_GROUPS = r"^[0-9]{3,}(?:[ -][0-9]{3,})*$"  # of a card inside a longer run, so that columns of numbers stay
NOT_CARD = "|".join(f"(?:{p})" for p in (PRIVATE_KEY, EMAIL, SECRET, WEB_TOKEN, BEARER, ACCESS_KEY, HEX_SECRET, IBAN, IPV6, IPV4, DATE, SSN, PHONE))
#: Any match has one of these; texts without are not searched.
HINT = r"[0-9@]|AKIA|ASIA|eyJ|(?i:password|passwd|pwd|token|secret|key)"

LONGEST_WALK = 64  # steps to a day over 12, of which six in ten days are
DAYS, DAY_HALVES = 146_097, (189, 773)  # days of 400 Gregorian years, and two factors of them
AREAS, GROUPS, SERIALS = 898, 99, 9999  # areas 001 to 899 without 666


# ------------------------------------------------------------------ Feistel


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    """52 keyed bits of one half."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("bigint")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def permute_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Bijection of 0 .. a * b - 1."""
    start = F.struct(_div(value, b).alias("l"), (value % b).cast("bigint").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        left = F.struct(((acc.l + _digest(key, kind, i, acc.r)) % a).alias("l"), acc.r.alias("r"))
        right = F.struct(acc.l.alias("l"), ((acc.r + _digest(key, kind, i, acc.l)) % b).alias("r"))
        return F.when(i % 2 == 1, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: acc.l * b + acc.r)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Bijection of the digit strings of each length up to 36: both halves are
    numbers of their own, so none outgrows 18 digits."""
    n = F.length(digits)
    cut = _div(n, 2).cast("int")
    number = lambda x: F.concat(F.lit("0"), x).cast("bigint")
    power = lambda x: F.pow(F.lit(10.0), x).cast("bigint")
    start = F.struct(
        number(F.substring(digits, F.lit(1), cut)).alias("l"), number(F.substring(digits, cut + 1, n)).alias("r"),
        power(cut).alias("a"), power(n - cut).alias("b"), cut.alias("cut"), (n - cut).alias("rest"),
    )

    def turn(acc: Column, i: Column) -> Column:
        same = [acc[c].alias(c) for c in ("a", "b", "cut", "rest")]
        left = F.struct(((acc.l + _digest(key, kind, i, acc.r)) % acc.a).alias("l"), acc.r.alias("r"), *same)
        right = F.struct(acc.l.alias("l"), ((acc.r + _digest(key, kind, i, acc.l)) % acc.b).alias("r"), *same)
        return F.when(i % 2 == 1, left).otherwise(right)

    half = lambda x, size: F.lpad(x.cast("string"), size, F.lit("0"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(half(acc.l, acc.cut), half(acc.r, acc.rest)))
    return F.when(n.between(1, 36), made)


def _shift(text: Column, half: Column, turn: Column, key: str, kind: str, letters: int) -> Column:
    """Every digit and every one of the first ``letters`` letters of ``text`` moved
    within its class by a byte of the keyed digest of ``half``."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half), 512)

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, (i * 2) % 128 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        among = lambda low, n: F.char((code - low + by) % n + low)
        return (
            F.when(code.between(48, 57), among(48, 10)).when(code.between(65, 64 + letters), among(65, letters))
            .when(code.between(97, 96 + letters), among(97, letters)).otherwise(c)
        )

    return F.array_join(F.transform(F.array_remove(F.split(text, ""), ""), move), "")


def permute_text(text: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Bijection of strings that keeps every character's class: digit, upper
    case, lower case; other characters stay.  Hexadecimal ones have 6 letters."""
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        left = F.struct(_shift(acc.l, acc.r, i, key, kind, letters).alias("l"), acc.r.alias("r"))
        right = F.struct(acc.l.alias("l"), _shift(acc.r, acc.l, i, key, kind, letters).alias("r"))
        return F.when(i % 2 == 1, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc.l, acc.r))


# -------------------------------------------------------------------- kinds


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    put = F.aggregate(
        F.array_remove(F.split(value, ""), ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("used")),
        lambda acc, c: F.when(
            c.between("0", "9"),
            F.struct(F.concat(acc.text, F.substring(digits, acc.used + 1, F.lit(1))).alias("text"), (acc.used + 1).alias("used")),
        ).otherwise(F.struct(F.concat(acc.text, c).alias("text"), acc.used.alias("used"))),
        lambda acc: acc.text,
    )
    return put


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum; every second digit counts double, beginning with that many
    places from the right."""
    chars = F.array_remove(F.split(F.reverse(digits), ""), "")

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((acc.total + F.when(acc.at % 2 == doubled_from_right % 2, twice).otherwise(d)).alias("total"), (acc.at + 1).alias("at"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("total"), F.lit(0).alias("at")), add, lambda acc: acc.total)


def is_card(value: Column) -> Column:
    d = _digits(value)
    return F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0) & ~d.rlike("^0+$")


def any_of(text: Column) -> Column:
    """Pattern of all values of a text: the fixed ones and its valid card numbers,
    longest first, so that other digits beside a card are left to the other kinds."""
    inside = [F.regexp_extract_all(text, F.lit(CARD_INSIDE % (n - 1)), F.lit(1)) for n in range(19, 12, -1)]
    inside = F.filter(F.concat(*inside), lambda x: x.rlike(CARD_GROUPS) & is_card(x))
    cards = F.array_distinct(F.concat(F.filter(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), is_card), inside))
    cards = F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), cards)
    own = F.concat(F.lit(NOT_CARD + "|(?<![0-9A-Za-z.])(?:"), F.array_join(cards, "|"), F.lit(")(?![0-9A-Za-z])"))
    return F.when(F.size(cards) > 0, own).otherwise(NOT_CARD)


def card_pseudonym(value: Column, key: str) -> Column:
    """The first digit stays, the check digit is made anew."""
    d = _digits(value)
    body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = ((F.lit(10) - luhn_sum(body, 0) % 10) % 10).cast("string")
    return _laid_out(value, F.concat(body, check))


def phone_pseudonym(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^(\+[0-9]{1,3}[ .-](?=.*[0-9])|)", 1)
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    return F.concat(country, _laid_out(rest, permute_digits(_digits(rest), key, "phone")))


def ip_pseudonym(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    number = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    made = permute_number(number, 65536, 65536, key, "ipv4")
    return F.concat_ws(".", *[(F.shiftright(made, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])


def is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)


def is_ssn(value: Column) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def ssn_pseudonym(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("bigint") for i in range(3))
    number = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * GROUPS + group - 1) * SERIALS + serial - 1
    made = permute_number(number, AREAS * GROUPS, SERIALS, key, "ssn")
    s, rest = made % SERIALS + 1, _div(made, SERIALS)
    g, a = rest % GROUPS + 1, _div(rest, GROUPS) + 1
    a = a + F.when(a >= 666, 1).otherwise(0)
    return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad(s.cast("string"), 4, "0"))


def _date_parts(value: Column) -> tuple[Column, Column, Column, Column]:
    """Separator, year, month, day: year first, else day first with dots; with
    slashes month first, unless only day first is a date."""
    mark = F.regexp_extract(value, r"([-/.])", 1)
    p = F.split(value, r"[-/.]")
    one, two, three = (p[i].cast("int") for i in range(3))
    year = F.when(mark == "-", one).otherwise(three)
    day_first = (mark == ".") | ((mark == "/") & (one > 12))
    month = F.when(mark == "-", two).when(day_first, two).otherwise(one)
    day = F.when(mark == "-", three).when(day_first, one).otherwise(two)
    return mark, year, month, day


def is_date(value: Column) -> Column:
    _, y, m, d = _date_parts(value)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return y.between(1800, 2199) & m.between(1, 12) & (d >= 1) & (d <= longest)


def _day_first(value: Column, mark: Column) -> Column:
    """Whether a date with slashes is read day first: its day is over 12."""
    return (mark == "/") & (F.split(value, "/")[0].cast("int") > 12)


def date_pseudonym(value: Column, key: str) -> Column:
    mark, y, m, d = _date_parts(value)
    first = F.lit("1800-01-01").cast("date")
    day = F.datediff(F.make_date(y, m, d), first).cast("bigint")
    once = lambda x: permute_number(x, *DAY_HALVES, key, "date")
    # Among the days over 12 of all months: on along the permutation's cycle to the
    # next of them, which is a permutation of those days.
    late = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(LONGEST_WALK)), F.struct(day.alias("at"), F.lit(False).alias("done")),
        lambda acc, _: F.when(acc.done, acc).otherwise(F.transform(F.array(once(acc["at"])), lambda x: F.struct(x.alias("at"), late(x).alias("done")))[0]),
        lambda acc: F.when(acc.done, acc["at"]).otherwise(day),
    )
    day_first = _day_first(value, mark)
    made = F.date_add(first, F.when(day_first, walked).otherwise(once(day)).cast("int"))
    padded = ~F.concat(F.lit("-"), value).rlike(r"[-/.][0-9](?![0-9])")
    two = lambda x: F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    yy, mm, dd = F.lpad(F.year(made).cast("string"), 4, "0"), two(F.month(made)), two(F.dayofmonth(made))
    return F.when(mark == "-", F.concat_ws("-", yy, mm, dd)).otherwise(
        F.when((mark == ".") | day_first, F.concat(dd, mark, mm, mark, yy)).otherwise(F.concat(mm, mark, dd, mark, yy))
    )


def _mod97(text: Column) -> Column:
    """Remainder of letters and digits read as numbers, A being 10."""
    chars = F.array_remove(F.split(text, ""), "")

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code <= 57, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(chars, F.lit(0), add)


def is_iban(value: Column) -> Column:
    x = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(x).between(15, 34) & (_mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1)


def iban_pseudonym(value: Column, key: str) -> Column:
    x = F.replace(value, F.lit(" "), F.lit(""))
    land, own = F.substring(x, 1, 2), permute_text(F.substring(x, F.lit(5), F.length(x)), key, "iban")
    check = F.lpad((98 - _mod97(F.concat(own, land, F.lit("00")))).cast("string"), 2, "0")
    made = F.concat(land, check, own)
    blanks = F.transform(F.array_remove(F.split(value, ""), ""), lambda c, i: F.when(c == " ", i))
    # Each blank goes back to its place.
    return F.aggregate(F.array_compact(blanks), made, lambda acc, i: F.concat(F.substring(acc, F.lit(1), i), F.lit(" "), F.substring(acc, i + 1, F.length(acc))))


def kind_of(value: Column) -> Column:
    """Kind of a match, null where validation fails."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(whole(PRIVATE_KEY), F.lit("private_key"))
        .when(whole(WHOLE_SECRET), F.lit("secret"))
        .when(whole(WEB_TOKEN), F.lit("web_token"))
        .when(whole(BEARER), F.lit("bearer"))
        .when(value.contains("@"), F.lit("email"))
        .when(whole(ACCESS_KEY), F.lit("access_key"))
        .when(whole(HEX_SECRET), F.lit("hex_token"))
        .when(whole(IBAN), F.when(is_iban(value), F.lit("iban")))
        .when(whole(IPV6), F.lit("ipv6"))
        .when(whole(IPV4), F.when(is_ip(value), F.lit("ipv4")))
        .when(whole(DATE), F.when(is_date(value), F.lit("date")))
        .when(whole(SSN), F.when(is_ssn(value), F.lit("ssn")))
        .when(whole(CARD) & is_card(value), F.lit("card"))
        .when(whole(PHONE), F.lit("phone"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym; the value itself where the kind is null."""
    local = F.substring_index(value, "@", 1)
    secret = F.regexp_replace(value, f"^{ASSIGNED}[\"']?", "")
    after = lambda tail: F.substring(value, F.lit(1), F.length(value) - F.length(tail))
    opened = F.regexp_extract(value, r"^(-----BEGIN [A-Z ]*-----)", 1)
    closed = F.regexp_extract(value, r"(-----END [A-Z ]*-----)$", 1)
    body = F.substring(value, F.length(opened) + 1, F.length(value) - F.length(opened) - F.length(closed))
    bearer = F.regexp_extract(value, r"^(\S+\s+)", 1)
    made = {
        "private_key": F.concat(opened, permute_text(body, key, "private_key"), closed),
        "web_token": F.concat(F.substring(value, 1, 3), permute_text(F.substring(value, F.lit(4), F.length(value)), key, "web_token")),
        "bearer": F.concat(bearer, permute_text(F.substring(value, F.length(bearer) + 1, F.length(value)), key, "bearer")),
        "hex_token": permute_text(value, key, "hex_token", 6),
        "iban": iban_pseudonym(value, key),
        "ipv6": permute_text(value, key, "ipv6", 6),
        "email": F.concat(permute_text(local, key, "email"), F.substring(value, F.length(local) + 1, F.length(value))),
        "access_key": F.concat(F.substring(value, 1, 4), permute_text(F.substring(value, F.lit(5), F.length(value)), key, "access_key")),
        "secret": F.concat(after(secret), permute_text(secret, key, "secret")),
        "ipv4": ip_pseudonym(value, key),
        "date": date_pseudonym(value, key),
        "ssn": ssn_pseudonym(value, key),
        "card": card_pseudonym(value, key),
        "phone": phone_pseudonym(value, key),
    }
    return reduce(lambda out, k: F.when(kind == k, made[k]).otherwise(out), made, value)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten, all other columns as they were, whatever
    their names, and an array column ``pii`` of (kind, position of the match's first
    code point counted from 0) appended; an existing column of that name is replaced.

    A null text stays null, an empty one empty, with no matches.  Texts are searched
    whole; values keep their length but for IPv4 addresses; repeated rows change
    alike; an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != "pii"]
    rows, of = plain(docs)
    held, text = [of[c] for c in columns], F.col(of[text_col])
    rows = rows.select(*held, F.when(text.rlike(HINT), any_of(text)).alias("any"))
    found = F.when(F.col("any").isNotNull(), F.regexp_extract_all(text, F.col("any"), F.lit(0)))
    rows = rows.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    rows = rows.withColumn("kinds", F.transform("found", kind_of))
    rows = rows.withColumn("gaps", F.when(F.size("found") > 0, F.split(text, F.col("any"), -1)))
    # gap 0, value 0, gap 1, value 1, ...: the values number one less
    named = F.zip_with("found", "kinds", lambda v, k: F.coalesce(pseudonym(v, k, key), v))
    joined = F.array_join(F.zip_with("gaps", named, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    places = F.aggregate(
        F.arrays_zip(F.slice("gaps", F.lit(1), F.size("found")).alias("g"), F.col("found").alias("v"), F.col("kinds").alias("k")),
        F.struct(F.array().cast("array<struct<kind:string,at:int>>").alias("all"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["all"], F.array(F.struct(x.k.alias("kind"), (acc["at"] + F.length(x.g)).alias("at")))).alias("all"),
            (acc["at"] + F.length(x.g) + F.length(x.v)).alias("at"),
        ),
        lambda acc: F.filter(acc["all"], lambda m: m.kind.isNotNull()),
    )
    none = F.array().cast("array<struct<kind:string,at:int>>")
    return rows.select(
        *[F.when(F.size("found") > 0, joined).otherwise(text).alias(c) if c == of[text_col] else F.col(c) for c in held],
        F.when(F.size("found") > 0, places).otherwise(none).alias("pii"),
    ).toDF(*columns, "pii")
