"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Numbers and dates are found by pattern, validated (check digits, octets, calendar), and moved by a keyed permutation of
all values of their format: a card number becomes another valid card number of the same issuer digit and spacing, a date
another date. The permutation depends on the key and the kind alone, so equal values stay equal in all documents and
different ones stay different. It is a Feistel network over a near-square grid that holds the range; results outside the
range are permuted again.

Kinds: e-mail (the part before the at sign, letters as letters, digits as digits), IPv4, telephone (a plus sign and 8 to
15 digits, 11 of the country +1 where a group ends there; the country digits stay; or ten digits whose area is in brackets), payment card (13 to 19 digits, Luhn), IBAN (mod 97), US social security number,
dates from 1900 to 2099 (ISO, or day and month with points or slashes).

A card, telephone number or IBAN beside another number (a security code, an expiry date, an order number) is found by the
ends of its groups; if none is valid, the search goes on after the first group.

A text of any length is read whole; a run of address characters is tried once, however long.

Defined cases: a null text stays null and an empty one empty; numbers that fail validation stay as they are. Repeated rows
give equal results. Other columns are carried, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import shipped, small_batches

shipped(__name__)

ROUNDS = 8
#: Stands in for the secret a caller passes.
DEFAULT_KEY = b"pseudonym key of this corpus"

FOUND = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){4,13}(?!\d))
    |(?P<area_phone>(?<![\d+])\([2-9]\d{2}\)\ ?[2-9]\d{2}[ .-]\d{4}(?!\d))
    |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d/-]|\.\d))
    |(?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d))
    |(?P<card>(?<![\d])\d(?:[ -]?\d){12,18}(?!\d))""",
    re.X | re.A,
)
#: The characters before an at sign, and what follows them.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
DIGITS = re.compile(r"\d+", re.A)
#: Cards of the issuers 3 to 6 and 22 to 27 in groups of four digits or more, the last of three; and the usual groups.
CARD_GROUPS = re.compile(r"(?=[3-6]|2[2-7])(?=(?:[ -]?\d){13})(?!(?:[ -]?\d){20})\d{4,}(?:[ -]\d{4,})*(?:[ -]\d{3})?", re.A)
CARD_LAYOUT = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}[ -]\d{4}[ -]\d{5}", re.A)
PLUS_ONE = re.compile(r"\+1(?!\d)|\+1\d{10}(?!\d)", re.A)
#: A plus sign alone: the digits after it may be a card.
FIRST_GROUP = re.compile(r"\+|[A-Z0-9]+", re.A)
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def permuted(value: int, size: int, key: bytes, kind: str) -> int:
    """Image of ``value`` under a keyed permutation of the numbers below ``size``."""
    if size < 2:
        return value
    rows = math.isqrt(size - 1) + 1
    columns = -(-size // rows)
    width = (size.bit_length() + 7) // 8 + 1
    tweak = f"{kind}/{size}".encode()
    while True:
        left, right = divmod(value, columns)
        for step in range(ROUNDS):
            half, modulus = (right, rows) if step % 2 == 0 else (left, columns)
            said = tweak + bytes([step]) + half.to_bytes(width, "big")
            noise = int.from_bytes(hashlib.blake2b(said, key=key[:64], digest_size=min(64, width + 8)).digest(), "big") % modulus
            if step % 2 == 0:
                left = (left + noise) % rows
            else:
                right = (right + noise) % columns
        value = left * columns + right
        if value < size:
            return value


def _refill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _digits(value: str, key: bytes, kind: str) -> str:
    return str(permuted(int(value), 10 ** len(value), key, kind)).zfill(len(value)) if value else value


def luhn_digit(payload: str) -> str:
    doubled = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(payload))]
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def is_card(found: str) -> bool:
    plain = re.sub("[ -]", "", found)
    return luhn_digit(plain[:-1]) == plain[-1]


def card(found: str, key: bytes) -> str | None:
    plain = re.sub("[ -]", "", found)
    if not is_card(found):
        return None
    payload = plain[0] + _digits(plain[1:-1], key, "card")
    return _refill(found, payload + luhn_digit(payload))


def phone(found: str, key: bytes) -> str | None:
    country, rest = re.match(r"(\+\d{1,3}?(?=\D)|\+\d)(.*)", found).groups()
    plain = re.sub(r"\D", "", rest)
    if not 8 <= len(plain) + len(country) - 1 <= 15:
        return None
    return country + _refill(rest, _digits(plain, key, "phone"))


def area_phone(found: str, key: bytes) -> str | None:
    """Ten digits without a country: the same digits after +1 get the same pseudonym."""
    return _refill(found, _digits(re.sub(r"\D", "", found), key, "phone"))


def ip(found: str, key: bytes) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(str(x) for x in permuted(int.from_bytes(bytes(octets), "big"), 2**32, key, "ip").to_bytes(4, "big"))


def ssn(found: str, key: bytes) -> str | None:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    index, serial = divmod(permuted(index, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(index, 99)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


def date(found: str, key: bytes) -> str | None:
    parts = re.split("[./-]", found)
    try:
        day = dt.date(*map(int, parts if "-" in found else reversed(parts)))
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    other = dt.date.fromordinal(FIRST_DAY + permuted(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
    return other.isoformat() if "-" in found else f"{other.day:02}{found[len(parts[0])]}{other.month:02}{found[len(parts[0])]}{other.year}"


def iban(found: str, key: bytes) -> str | None:
    plain = found.replace(" ", "")
    if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = _refill(plain[4:], _digits(re.sub(r"\D", "", plain[4:]), key, "iban"))
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    filled = iter(f"{plain[:2]}{check:02}{body}")
    return "".join(c if c == " " else next(filled) for c in found)


def email(found: str, key: bytes) -> str | None:
    """The local part as one number whose places are letters and digits; other signs stay."""
    local, domain = found.rsplit("@", 1)
    alphabets = {c: a for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") for c in a}
    value, size = 0, 1
    for c in local:
        if a := alphabets.get(c):
            value, size = value * len(a) + a.index(c), size * len(a)
    value, out = permuted(value, size, key, f"email{''.join(alphabets.get(c, c)[0] for c in local)}"), []
    for c in reversed(local):
        if a := alphabets.get(c):
            value, place = divmod(value, len(a))
            c = a[place]
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


def card_ends(text: str, start: int, stop: int) -> list[int]:
    """Where a card that begins at ``start`` ends: ``stop``, or before it if other numbers follow.

    Runs of groups as cards have them come first; if one begins after ``start`` and before ``stop``, no other is taken.
    """
    groups, at = [], start
    while at < stop + 20 and (group := DIGITS.match(text, at)):
        groups.append(group.span())
        at = group.end() + 1
        if text[at - 1 : at] not in (" ", "-"):
            break
    for i, (low, first) in enumerate(groups):
        if low >= stop:
            break
        if first - low < 4:
            continue
        ends = [high for _, high in groups[i : i + 19] if CARD_GROUPS.fullmatch(text, low, high)]
        ends.sort(key=lambda high: (CARD_LAYOUT.fullmatch(text, low, high) is None, -high))
        if right := [high for high in ends if is_card(text[low:high])]:
            return right if i == 0 else []
    return [stop]


def phone_ends(text: str, start: int, stop: int) -> list[int]:
    """Ends of groups, the last first; numbers of the country +1 have ten more digits, so such an end comes before all."""
    ends = [at for at in range(stop, start, -1) if text[at - 1].isdigit() and not text[at : at + 1].isdigit()]
    if PLUS_ONE.match(text, start):
        ends.sort(key=lambda at: sum(map(str.isdigit, text[start:at])) != 11)
    return ends


def iban_ends(text: str, start: int, stop: int) -> list[int]:
    """``stop``, or a space before it from which the shortest IBAN, of 15 signs, is full."""
    return [stop, *(at for at in range(stop - 1, start, -1) if text[at] == " " and at - start - text.count(" ", start, at) >= 15)]


KINDS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": email, "iban": iban, "phone": phone, "area_phone": area_phone, "ssn": ssn, "date": date, "ip": ip, "card": card
}
#: Kinds whose pattern may reach into a neighbouring number.
ENDS: dict[str, Callable[[str, int, int], list[int]]] = {"card": card_ends, "phone": phone_ends, "iban": iban_ends}


def replaced(text: str | None, key: bytes) -> tuple[str | None, int, list[str]]:
    """The text with pseudonyms, how many values were replaced, and their kinds."""
    if not text:
        return text, 0, []
    kinds: list[str] = []

    out: list[str] = []
    done = at = 0
    run, domain = 0, None
    while True:
        # Behind a value an address may begin inside its run of characters, which is measured once.
        if at > run or (at and at == run):
            run = LOCAL.match(text, at).end()
            domain = DOMAIN.match(text, run)
        if 0 < at < run and domain:
            kind, start, at = "email", at, domain.end()
        elif match := FOUND.search(text, at):
            kind, (start, at) = match.lastgroup, match.span()
        else:
            break
        for end in ENDS[kind](text, start, at) if kind in ENDS else (at,):
            if other := KINDS[kind](text[start:end], key):
                out += text[done:start], other
                kinds.append("phone" if kind == "area_phone" else kind)
                done = at = end
                break
        else:
            # Another value may begin after the first group.
            if kind in ENDS:
                at = FIRST_GROUP.match(text, start).end()
    out.append(text[done:])
    return "".join(out), len(kinds), sorted(set(kinds))


def pseudonyms(text: Column, key: bytes = DEFAULT_KEY) -> Column:
    """Struct of text, n_values and kinds."""

    @F.pandas_udf("text string, n_values long, kinds array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replaced(t, key) for t in texts], columns=["text", "n_values", "kinds"])

    return run(text)


def pseudonymised(docs: DataFrame, key: bytes = DEFAULT_KEY, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced; other columns as they are."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text, pseudonyms(F.col(text), key)["text"])


def pii_digest(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, the text with pseudonyms, how many values were replaced, and their kinds, sorted and comma-joined."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", pseudonyms(F.col("text"), key).alias("p"))
    return rows.select("doc_id", "p.text", "p.n_values", F.array_join("p.kinds", ",").alias("kinds"))
