"""PII: format-preserving Feistel pseudonyms.

A found value is checked (Luhn, mod 97, octets, calendar, number plan), its free characters are read as
one whole number in their mixed radix, and a keyed Feistel network permutes that number within its range.
The same value under the same key gives the same pseudonym in every document, whatever its separators,
so linked values stay linked; the result passes the same checks and keeps length, classes of characters
and separators; and whoever has the key can undo it. Each row is worked out by itself, without a shuffle.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b
from math import isqrt, prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, pick, place_of, plain

ROUNDS = 10
DIGITS, SMALL, LARGE, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüß"
#: Dates from here to the end are permuted among each other; others stay.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("secret", "email", "iban", "ip", "date", "ssn", "card", "phone", "national")

PATTERNS = {
    "secret": re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\b["']?\s{0,3}[=:]\s{0,3}["']?([A-Za-z0-9_\-+/]{16,})"""),
    "email": re.compile(r"(?<![\w.%+\-])([\w%+\-]+(?:\.[\w%+\-]+)*)@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"),
    "date": re.compile(r"(?<![\d./\-])(?:(\d{4})([\-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([\-/.])(\d{1,2})\6(\d{4}))(?!\d|[./\-]\d)"),
    "ssn": re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    "card": re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{4,5})(?!\d)"),
    "phone": re.compile(r"(?<![\w+])\+\d(?:[ .\-]?\(?\d+\)?){2,6}(?!\d)"),
    "national": re.compile(r"(?<![\w.+\-/(])(?:\([2-9]\d\d\) ?|[2-9]\d\d([\-. ]))[2-9]\d\d(?(1)\1|[\-. ])\d{4}(?![\w\-]|\.\d)"),
}


class Feistel:
    """A keyed permutation of 0..n-1 for any n and tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _mix(self, tweak: bytes, i: int, x: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        data, out, block = b"%d|%d|" % (i, x) + tweak, b"", 0
        while len(out) < size:
            out += blake2b(data + b"|%d" % block, key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:size], "big") % modulus

    def _once(self, tweak: bytes, x: int, a: int, b: int, back: bool) -> int:
        left, right = x // b, x % b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._mix(tweak, i, left, b)) % b
            else:
                left = (left + sign * self._mix(tweak, i, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False, good: Callable[[int], bool] = lambda x: True) -> int:
        """Walks the cycle until it is in range and good again, so good numbers go to good numbers."""
        if n < 2:
            return x
        b = isqrt(n - 1) + 1
        a = -(-n // b)
        t = f"{tweak}|{n}".encode()
        while True:
            x = self._once(t, x, a, b, back)
            if x < n and good(x):
                return x


@lru_cache(maxsize=4096)
def alphabet_of(c: str) -> str | None:
    """The characters that c may become: digits, letters of its case, or, for a letter beyond those, the
    letters of its kind among the 64 code points around it. Others stay: None."""
    known = next((a for a in (DIGITS, SMALL, LARGE, ACCENTED) if c in a), None)
    if known or not c.isalpha():
        return known
    low, kind = ord(c) & ~63, unicodedata.category(c)
    return "".join(x for x in map(chr, range(low, low + 64)) if x.isalpha() and unicodedata.category(x) == kind and x not in ACCENTED)


def luhn(digits: str) -> int:
    """The check digit that follows."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def fill(shape: str, free: str) -> str:
    """shape with its ASCII letters and digits replaced, in order, by free's."""
    it = iter(free)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in shape)


class Pseudonyms:
    """apply() gives the pseudonym of a value of some kind, or None if it isn't one; back=True undoes it."""

    def __init__(self, key: bytes, back: bool = False):
        self.net, self.back = Feistel(key), back
        self.apply = lru_cache(maxsize=50_000)(self._apply)

    def _text(self, text: str, kind: str, alphabets: list[str | None]) -> str:
        sizes = [len(a) for a in alphabets if a]
        x = 0
        for c, a in zip(text, alphabets, strict=True):
            if a:
                x = x * len(a) + a.index(c)
        # The classes are part of the tweak, so values of one shape are permuted among each other.
        y = self.net.permute(x, prod(sizes), kind + "|" + ",".join(a[0] + str(len(a)) if a else "-" for a in alphabets), self.back)
        out = []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                y, k = divmod(y, len(a))
                out.append(a[k])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _apply(self, kind: str, value: str) -> str | None:
        return getattr(self, kind)(value)

    def secret(self, value: str) -> str | None:
        if not any(c.isdigit() for c in value):
            return None
        if all(c in HEX for c in value):
            return self._text(value, "secret", [HEX] * len(value))
        return self._text(value, "secret", [alphabet_of(c) for c in value])

    def email(self, value: str) -> str | None:
        local, at, domain = value.rpartition("@")
        return self._text(local, f"email@{domain.lower()}", [alphabet_of(c) for c in local]) + at + domain

    def iban(self, value: str) -> str | None:
        plain_value = value.replace(" ", "")
        if not 15 <= len(plain_value) <= 34 or mod97(plain_value[4:] + plain_value[:4]) != 1:
            return None
        rest = self._text(plain_value[4:], "iban" + plain_value[:2], [alphabet_of(c) for c in plain_value[4:]])
        return fill(value, f"{plain_value[:2]}{98 - mod97(rest + plain_value[:2] + '00'):02d}{rest}")

    def ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        y = self.net.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip", self.back)
        return ".".join(map(str, y.to_bytes(4, "big")))

    def date(self, value: str) -> str | None:
        m = PATTERNS["date"].fullmatch(value)
        if not m:
            return None
        if m[1]:
            orders = [((m[1], m[3], m[4]), lambda d, w: f"{d.year:04d}{m[2]}{d.month:0{w[1]}d}{m[2]}{d.day:0{w[2]}d}")]
        else:
            orders = [
                ((m[8], m[7], m[5]), lambda d, w: f"{d.day:0{w[2]}d}{m[6]}{d.month:0{w[1]}d}{m[6]}{d.year:04d}"),
                ((m[8], m[5], m[7]), lambda d, w: f"{d.month:0{w[1]}d}{m[6]}{d.day:0{w[2]}d}{m[6]}{d.year:04d}"),
            ]
        for parts, write in orders:
            try:
                at = datetime.date(*map(int, parts)).toordinal()
            except ValueError:
                continue
            if not FIRST_DAY <= at <= LAST_DAY:
                return None
            # Month first is only read where day first can't be, so days over 12 go to such days: a day has
            # one pseudonym in all ways to write it, and each way reads again as it was.
            late = datetime.date.fromordinal(at).day > 12
            y = self.net.permute(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", self.back, lambda x: (datetime.date.fromordinal(FIRST_DAY + x).day > 12) == late)
            widths = [len(p) for p in parts]
            return write(datetime.date.fromordinal(FIRST_DAY + y), widths)
        return None

    def ssn(self, value: str) -> str | None:
        good = lambda x: not (x // 10**6 in (0, 666) or x // 10**6 >= 900 or x // 10**4 % 100 == 0 or x % 10**4 == 0)
        x = int(value.replace("-", ""))
        return fill(value, f"{self.net.permute(x, 10**9, 'ssn', self.back, good):09d}") if good(x) else None

    def card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = self._text(digits[:-1], "card", [DIGITS] * (len(digits) - 1))
        return fill(value, body + str(luhn(body)))

    def phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 8 <= len(digits) <= 15:
            return None
        code = 1 if digits[0] in "17" else 2  # the country's code stays
        return fill(value, digits[:code] + self._text(digits[code:], f"phone{digits[:code]}", [DIGITS] * (len(digits) - code)))

    def national(self, value: str) -> str | None:
        """Ten digits, area and exchange from 2 up; so are those of the pseudonym."""
        good = lambda x: x // 10**9 > 1 and x // 10**4 % 1000 > 199
        x = int(re.sub(r"\D", "", value))
        return fill(value, f"{self.net.permute(x, 10**10, 'national', self.back, good):010d}")


def pseudonymise(text: str | None, names: Pseudonyms) -> tuple[str | None, list[str]]:
    """text with every checked value replaced, and the kinds replaced in text order. Of values that
    overlap, the kind that is earlier in KINDS has the characters. A value that is its own pseudonym (one of
    a few characters may be) is not counted as replaced."""
    if not text:
        return text, []
    digit = any(map(text.__contains__, DIGITS))
    taken: list[tuple[int, int, str, str]] = []
    for kind in KINDS:
        if (kind == "email" and "@" not in text) or (kind == "phone" and "+" not in text) or (kind != "email" and not digit):
            continue
        free = sorted(taken)
        group = 1 if kind == "secret" else 0
        for m in PATTERNS[kind].finditer(text):
            a, b = m.span(group)
            k = bisect_left(free, (b,))  # the last taken value that starts before b
            if k and free[k - 1][1] > a:
                continue
            new = names.apply(kind, text[a:b])
            if new is not None and new != text[a:b]:
                taken.append((a, b, kind, new))
    out, end = [], 0
    taken.sort()
    for a, b, _, new in taken:
        out += [text[end:a], new]
        end = b
    return "".join(out) + text[end:], [kind for _, _, kind, _ in taken]


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """id, text (pseudonymised), n_replaced and kinds (array of the kinds replaced, in text order) of each
    row's whole text.

    Null stays null, empty stays empty, both with nothing replaced. Equal values have equal pseudonyms in
    all rows. Repeated rows come out as often as they go in; extra columns are left out; an empty table
    gives an empty result. With back=True, pseudonyms under the key are undone.
    """
    rows = pick(docs, id=id_col, text=text_col)

    def task():
        names = Pseudonyms(key, back)

        def each(c):
            done = [pseudonymise(t, names) for t in c["text"]]
            return {"id": c["id"], "text": [t for t, _ in done], "kinds": [k for _, k in done]}

        return each

    out = arrow_map(rows, task, f"id {rows.schema['id'].dataType.simpleString()}, text string, kinds array<string>")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.size("kinds").cast("long").alias("n_replaced"), "kinds")


def with_pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs, all columns, with the text pseudonymised. Null and empty texts stay, repeated rows come out as
    often as they go in, an empty table gives an empty result."""
    rows, at = plain(docs), place_of(docs, text_col)

    def run(batches):
        import pyarrow as pa

        names = Pseudonyms(key)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                cols = list(part.columns)
                cols[at] = pa.array([pseudonymise(t, names)[0] for t in cols[at].to_pylist()], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
