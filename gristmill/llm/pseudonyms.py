"""Format-preserving pseudonyms for validated numbers and dates.

Found values are checked first (Luhn for cards, modulo 97 for bank accounts, ranges for
addresses, calendar for dates, numbering plan for telephones). What may vary in a value is one number in
a domain of known size; a keyed Feistel network permutes that domain, walking on
until it lands inside. Equal values get equal pseudonyms in every document, two
values never share one, and a pseudonym is again a valid value of its format.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.storage import shared_value

ROUNDS = 10
KINDS = ["card", "phone", "address", "date", "mail", "iban"]

#: What may be a value, by kind; each match is validated.
PATTERNS = {
    "mail": r"(?<![\w.+-])([A-Za-z0-9][A-Za-z0-9._+-]*)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?!\w)",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "phone": r"(?<![\w+])\+1 ?\(?[2-9][0-9]{2}\)?[ -][2-9][0-9]{2}-[0-9]{4}(?![0-9])",
    "address": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-])",
}
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_WORTH = re.compile("[0-9@]")


def _drawn(message: bytes, key: bytes, n_bytes: int) -> bytes:
    """``n_bytes`` keyed bytes of a message: one digest, or as many as it takes, numbered."""
    if n_bytes <= 64:
        return hashlib.blake2b(message, key=key, digest_size=n_bytes).digest()
    whole = hashlib.blake2b(message, key=key).digest()
    blocks = (hashlib.blake2b(whole + k.to_bytes(4, "big"), key=key).digest() for k in range(-(-n_bytes // 64)))
    return b"".join(blocks)[:n_bytes]


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network on the
    enclosing even number of bits, repeated until the result is inside."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    n_bytes = (half + 7) // 8 + 4
    while True:
        left, right = value >> half, value & mask
        for n in range(ROUNDS):
            drawn = _drawn(f"{tweak}:{n}:".encode() + right.to_bytes(n_bytes, "big"), key, n_bytes)
            left, right = right, left ^ int.from_bytes(drawn, "big") & mask
        value = left << half | right
        if value < size:
            return value


def _digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced one by one."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _card(found: str, key: bytes) -> str | None:
    digits = "".join(c for c in found if c.isdigit())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    # the leading digit names the scheme and stays
    rest = len(digits) - 2
    body = digits[0] + str(permuted(int(digits[1:-1]), 10**rest, key, f"card{digits[0]}{len(digits)}")).zfill(rest)
    return _digits(found, body + luhn_digit(body))


def _phone(found: str, key: bytes) -> str:
    digits = "".join(c for c in found if c.isdigit())[1:]
    # area and exchange start with 2 to 9
    area, exchange, line = int(digits[:3]) - 200, int(digits[3:6]) - 200, int(digits[6:])
    value = permuted((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, key, "phone")
    rest, line = divmod(value, 10_000)
    area, exchange = divmod(rest, 800)
    return _digits(found, f"1{area + 200}{exchange + 200}{line:04}")


def _address(found: str, key: bytes) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "address")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(found: str, key: bytes) -> str | None:
    a, b, c = re.split(r"[-/.]", found)
    year, month, day = (a, b, c) if "-" in found else (c, a, b) if "/" in found else (c, b, a)
    try:
        number = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= number <= _LAST_DAY:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + permuted(number - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date"))
    form = "%Y-%m-%d" if "-" in found else "%m/%d/%Y" if "/" in found else "%d.%m.%Y"
    return new.strftime(form)


_CLASSES = [_LOWER, _UPPER, _DIGITS]


def _within_classes(text: str, key: bytes, tweak: str) -> str:
    """``text`` with its ASCII letters and digits permuted as a whole, each character
    staying in its class. The number that stands for them is read and written by halves,
    so that very long texts take little more than linear time."""
    own = [next((k for k, members in enumerate(_CLASSES) if c in members), None) for c in text]
    kinds = [k for k in own if k is not None]
    shape = "".join("?" if k is None else str(k) for k in own)
    values = [_CLASSES[k].index(c) for c, k in zip(text, own, strict=True) if k is not None]
    sizes = [len(_CLASSES[k]) for k in kinds]

    def joined(low: int, high: int) -> tuple[int, int]:
        if high - low <= 1:
            return (values[low], sizes[low]) if high > low else (0, 1)
        middle = (low + high) // 2
        (a, m), (b, n) = joined(low, middle), joined(middle, high)
        products[low, high] = n
        return a * n + b, m * n

    def parted(value: int, low: int, high: int) -> None:
        if high - low <= 1:
            if high > low:
                values[low] = value
            return
        middle = (low + high) // 2
        a, b = divmod(value, products[low, high])
        parted(a, low, middle)
        parted(b, middle, high)

    products: dict[tuple[int, int], int] = {}
    value, size = joined(0, len(values))
    parted(permuted(value, size, key, tweak + shape), 0, len(values))
    drawn = iter(_CLASSES[k][v] for k, v in zip(kinds, values, strict=True))
    return "".join(c if k is None else next(drawn) for c, k in zip(text, own, strict=True))


def _mail(found: str, key: bytes) -> str:
    """The letters and digits before the @ are permuted within their classes."""
    name, host = found.split("@")
    return _within_classes(name, key, f"mail{host.lower()}:") + "@" + host


def iban_digits(country: str, body: str) -> str:
    """The two check digits (ISO 7064, modulo 97)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}"


def _iban(found: str, key: bytes) -> str | None:
    plain = found.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_digits(country, body) != check:
        return None
    body = _within_classes(body, key, f"iban{country}")
    left = iter(country + iban_digits(country, body) + body)
    return "".join(c if c == " " else next(left) for c in found)


_REPLACE: dict[str, Callable[[str, bytes], str | None]] = {"card": _card, "phone": _phone, "address": _address, "date": _date, "mail": _mail, "iban": _iban}


def replaced(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not _WORTH.search(text):
        return text, counts

    def of(m: re.Match) -> str:
        new = _REPLACE[m.lastgroup](m.group(), key)
        if new is None:
            return m.group()
        counts[m.lastgroup] += 1
        return new

    return _ANY.sub(of, text), counts


def pseudonymise(docs: DataFrame, key: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ``text`` with pseudonyms, a count per kind, and ``n_replaced``.

    ``key`` is the secret of the permutations (any string). Null texts stay null
    with counts 0; invalid look-alikes stay as they are. Other columns are left
    behind. Equal values have equal pseudonyms in all rows.
    """
    keys = list(keys)
    secret = shared_value(docs.sparkSession, hashlib.blake2b(key.encode()).digest())
    frame = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)

    def of(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            for first in range(0, len(texts), 256):
                new, counts = [], {k: [] for k in KINDS}
                for t in texts.slice(first, 256).to_pylist():
                    got, n = replaced(t or "", secret.value)
                    new.append(None if t is None else got)
                    for k in KINDS:
                        counts[k].append(n[k])
                own = [batch.column(batch.schema.get_field_index(k)).slice(first, len(new)) for k in keys]
                every = [pa.array(counts[k], pa.int64()) for k in KINDS]
                total = pa.array([sum(x) for x in zip(*counts.values(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([*own, pa.array(new, pa.string()), *every, total], [*keys, "text", *(f"n_{k}" for k in KINDS), "n_replaced"])

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return frame.mapInArrow(of, f"{schema}, text string, {counts}, n_replaced bigint")
