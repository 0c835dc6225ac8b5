"""Operator 10: format-preserving Feistel pseudonyms for personal numbers, dates and addresses.

Each value found is validated (Luhn, mod 97, octet ranges, calendar, numbering rules), then permuted
by a keyed Feistel network over exactly the values of its own format. The map is a bijection of that
format and depends on the key and the value alone, so equal values stay equal across documents, and
different ones different, however they are punctuated.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROUNDS = 8
#: The session's setting that has the key. Whoever knows the key can turn pseudonyms back.
KEY_SETTING = "spark.lodestone.pseudonyms.key"
#: What op10_pii uses where that is unset, for trials and tests; it is public, so it protects nothing.
TRIAL_KEY = b"lodestone pseudonyms"
#: Longer values are permuted in blocks of so many characters.
BLOCK = 128


def feistel(value: int, a: int, b: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 <= value < a * b: alternate halves are shifted by a hash of the other half."""
    x, y = divmod(value, b)
    for i in range(ROUNDS):
        other, m = (x, b) if i % 2 == 0 else (y, a)
        digest = hashlib.blake2b(f"{tweak}|{a}|{b}|{i}|{other}".encode(), key=key[:64], digest_size=(m.bit_length() + 7) // 8 + 8).digest()
        f = int.from_bytes(digest, "big")
        if i % 2 == 0:
            y = (y + f) % b
        else:
            x = (x + f) % a
    return x * b + y


def permute(value: int, size: int, key: bytes, tweak: str, ok=lambda v: True) -> int:
    """A keyed permutation of those 0 <= v < size that are ok, by walking the cycle of a slightly larger domain."""
    a = max(1, int(size**0.5)) if size < 2**100 else 1 << (size.bit_length() // 2)
    b = -(-size // a)
    while True:
        value = feistel(value, a, b, key, tweak)
        if value < size and ok(value):
            return value


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: k for k in CLASSES for c in k}


def permute_shape(text: str, key: bytes, tweak: str, alphabet: str = "") -> str:
    """Digits become digits, letters letters of the same case (or characters of `alphabet` each other); the rest stays."""
    if len(text) > BLOCK:
        return "".join(permute_shape(text[i : i + BLOCK], key, f"{tweak}|{i}", alphabet) for i in range(0, len(text), BLOCK))
    kinds = [alphabet if c in alphabet else _CLASS.get(c, "") for c in text]
    value, size = 0, 1
    for c, k in zip(text, kinds):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    if size == 1:
        return text
    shape = "".join(k[0] if k else c for c, k in zip(text, kinds))
    value = permute(value, size, key, f"{tweak}|{shape}")
    out = []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k:
            value, r = divmod(value, len(k))
            c = k[r]
        out.append(c)
    return "".join(reversed(out))


def lay(pattern: str, digits: str) -> str:
    """pattern with its ASCII digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in CLASSES[0] else c for c in pattern)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in CLASSES[0])


def luhn(digits: str) -> int:
    """The check sum modulo 10; 0 for a valid number."""
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def card(text: str, key: bytes) -> str | None:
    d = only_digits(text)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    body = f"{permute(int(d[:-1]), 10**n, key, f'card{n}'):0{n}d}"
    return lay(text, body + str(-luhn(body + "0") % 10))


def ssn(text: str, key: bytes) -> str | None:
    def ok(v: int) -> bool:
        area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    v = int(only_digits(text))
    return lay(text, f"{permute(v, 10**9, key, 'ssn', ok):09d}") if ok(v) else None


#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}


def phone(text: str, key: bytes) -> str | None:
    """The country code stays, and the rest of the number is permuted, however it is punctuated."""
    d = only_digits(text)
    code = 0 if text[0] != "+" else 1 if d[0] in "17" else 2 if int(d[:2]) in _TWO else 3
    n = len(d) - code
    if not (code and 5 <= n <= 14 or not code and n == 10):
        return None
    return lay(text, d[:code] + f"{permute(int(d[code:]), 10**n, key, f'phone{d[:code]}|{n}'):0{n}d}")


def ipv4(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    v = permute(int.from_bytes(bytes(octets), "big"), 2**32, key, "ipv4")
    return ".".join(map(str, v.to_bytes(4, "big")))


_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())


def date(text: str, key: bytes) -> str | None:
    """Year first, or day and month first: then the first number is the day if it is over 12, else the month."""
    a, s, b, _, c = re.fullmatch(r"([0-9]+)([-/.])([0-9]+)([-/.])([0-9]+)", text).groups()
    big_first = len(a) == 4
    y, m, d = (int(a), int(b), int(c)) if big_first else (int(c), int(b), int(a)) if int(a) > 12 else (int(c), int(a), int(b))
    try:
        day = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not _DAYS[0] <= day <= _DAYS[1]:
        return None
    # days over 12 are permuted among themselves, and so are the others, in every format: so a date reads
    # back in its own order of day and month, and has one pseudonym however it is written
    high = datetime.date.fromordinal(day).day > 12
    new = datetime.date.fromordinal(_DAYS[0] + permute(day - _DAYS[0], _DAYS[1] - _DAYS[0] + 1, key, "date", lambda v: (datetime.date.fromordinal(_DAYS[0] + v).day > 12) == high))
    two = lambda v, old: f"{v:0{len(old)}d}" if len(old) == 2 else str(v)
    if big_first:
        return f"{new.year}{s}{two(new.month, b)}{s}{two(new.day, c)}"
    x, z = (new.day, new.month) if int(a) > 12 else (new.month, new.day)
    return f"{two(x, a)}{s}{two(z, b)}{s}{new.year}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = permute_shape(plain[4:], key, "iban" + plain[:2])
    check = 98 - _mod97(plain[:2] + "00" + body)
    new = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def email(text: str, key: bytes) -> str | None:
    name, _, host = text.rpartition("@")
    labels, _, top = host.rpartition(".")
    if ".." in host or not top.isalpha():
        return None
    return f"{permute_shape(name, key, 'mail')}@{permute_shape(labels, key, 'host')}.{top}"


def secret(text: str, key: bytes) -> str | None:
    if not any(c.isdigit() for c in text) or not any(c.isalpha() for c in text):
        return None
    return permute_shape(text, key, "secret", "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF")


#: Tried in this order at each place; every quantifier is bounded or gives nothing back, so no text makes them slow.
PATTERNS = (
    ("email", r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?<![.-])", email),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", iban),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])", secret),
    ("ipv4", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", ipv4),
    ("date", r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])", date),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])", ssn),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])", card),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z])", phone),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])", phone),
)


class Pseudonyms:
    """Replaces what PATTERNS find and validate; counts it."""

    def __init__(self, key: bytes):
        self.steps = []
        for kind, pattern, function in PATTERNS:
            self.steps.append((kind, re.compile(pattern), lru_cache(50_000)(lambda v, f=function: f(v, key))))

    def __call__(self, text: str) -> tuple[str, int]:
        """All patterns look at the original text; where finds overlap, the earlier pattern has it."""
        found: list[tuple[int, int, str]] = []  # in order of place, apart from each other
        for kind, pattern, function in self.steps:
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                k = bisect_left(found, (m.start(),))
                if k and found[k - 1][1] > m.start() or k < len(found) and found[k][0] < m.end():
                    continue
                new = function(m.group())
                if new is not None:
                    found.insert(k, (m.start(), m.end(), new))
        out, at = [], 0
        for s, e, new in found:
            out += [text[at:s], new]
            at = e
        return "".join([*out, text[at:]]), len(found)


def _session_key(spark) -> bytes:
    return (spark.conf.get(KEY_SETTING, None) or "").encode()


def pseudonymise(df: DataFrame, text_col: str = "text", key: bytes | None = None, count_col: str = "n_private") -> DataFrame:
    """df with private values in text_col replaced, and how many there were.

    The key is the one given or that of the session's setting KEY_SETTING; without either it is an error.
    Found are cards, social security numbers, phones, IBANs, IPv4 addresses, dates, e-mails and hexadecimal
    secrets, and nothing else: no names, postal or IPv6 addresses, or tokens of other alphabets.

    Runs inside the partitions, with no shuffle. A null text stays null with a count of 0, an empty one
    stays empty; long texts are processed whole. Repeated rows and equal values are treated alike. A value
    that fails its validation is left alone. A column named count_col is replaced; others pass untouched.
    """
    key = key or _session_key(df.sparkSession)
    if not key:
        raise ValueError(f"pseudonyms need a key: set {KEY_SETTING}")
    kept = [c for c in df.columns if c != count_col]
    at = kept.index(text_col)

    def run(batches):
        change = Pseudonyms(key)
        for batch in batches:
            texts = batch.column(at)
            count = [0] * len(texts)
            hit = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)
            if pc.any(hit).as_py():
                texts = texts.to_pylist()
                for i in pc.indices_nonzero(hit).to_pylist():
                    texts[i], count[i] = change(texts[i])
                texts = pa.array(texts, batch.schema.field(at).type)
            columns = batch.columns
            columns[at] = texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int32())], [*kept, count_col])

    return df.select(*kept).mapInArrow(run, df.select(*kept).schema.add(count_col, "integer"))


def pii(spark, sf_dir: str) -> DataFrame:
    """Every document's text without its private values."""
    from .session import read

    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key=_session_key(spark) or TRIAL_KEY)
