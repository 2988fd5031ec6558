"""Format-preserving pseudonyms for numbers and dates (operator 6).

Values are found by pattern and believed only when they validate: card numbers by their check
digit, account numbers (IBAN) by their remainder, addresses (IPv4) by their octets, social security
numbers by their ranges, dates (1900 to 2099) by the calendar. Phone numbers have no check: they go by
their shape, and by not being one digit repeated. Each is replaced by a keyed permutation of the
values of its kind, a Feistel network over the digits or the day number, walked until it lands on a
valid value again. So separators and (but for IPv4) lengths stay, check digits are right, and equal
values, however they are written, get equal pseudonyms in all documents; with the key, ``Pseudonyms(key, back=True)``
turns them back. Local parts of mail addresses are permuted letter for letter and digit for digit.

What stays in clear: what doesn't validate, dates outside those years, the domains of mail addresses,
and the country codes of phone and account numbers.

Null texts stay null and empty ones empty, with no values; repeated rows and extra columns stay.
Columns ``n_values`` and ``kinds`` of the input are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import sliced

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

#: Kinds in the order in which they are tried at a place. Cards here are written as cards are: in
#: one run, or in their groups with one separator. The odd ones, digits with any spaces and hyphens
#: between, come last of all: they could begin in a neighbouring number.
_KINDS = {
    "mail": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day": r"(?<![0-9/.])[0-9]{1,2}(?P<sep>[/.])[0-9]{1,2}(?P=sep)[0-9]{4}(?![0-9]|[/.][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.])(?<![^0-9]-)(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])(?:[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}|[0-9]{6}(?P=gap)[0-9]{4,5}))(?![0-9])",
    "phone": r"(?:(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w+])\+[0-9]{8,15}(?![0-9]))",
}
_ORDER = list(_KINDS)
_EACH = [re.compile(x) for x in _KINDS.values()]
_ANY = re.compile("|".join(f"(?P<{k}>{x})" for k, x in _KINDS.items()))
_ODD = r"(?<![0-9.])(?<![^0-9]-)[0-9](?:[ -]?[0-9]){%s}(?![0-9])"
_ODD_CARD, _ODD_CARDS = re.compile(_ODD % "12,18"), [re.compile(_ODD % n) for n in range(18, 11, -1)]
_ACCOUNT = re.compile(_KINDS["iban"].partition(")")[2].rpartition("(?!")[0])
_MAY = re.compile(r"[0-9@]")


class Pseudonyms:
    """Permutations under one key, or back."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self._known = lru_cache(maxsize=100_000)(self._replaced)

    def _round(self, tweak: str, k: int, x: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}/{k}/{x}".encode(), key=self.key, digest_size=16).digest(), "big")

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A permutation of range(n): a Feistel network over pairs (a, b) below the root of n,
        walked on while it is at n or beyond."""
        side = isqrt(n - 1) + 1 if n > 1 else 1
        while True:
            a, b = divmod(x, side)
            for k in range(ROUNDS)[:: -1 if self.back else 1]:
                a, b = ((b - self._round(tweak, k, a)) % side, a) if self.back else (b, (a + self._round(tweak, k, b)) % side)
            x = a * side + b
            if x < n:
                return x

    def digits(self, value: str, tweak: str) -> str:
        n = len(value)
        return str(self.permute(int(value), 10**n, f"{tweak}{n}")).zfill(n)

    def _replaced(self, kind: str, value: str) -> str | None:
        return getattr(self, f"_{kind}")(value)

    def _refill(self, shape: str, new: str) -> str:
        """``new``'s letters and digits where ``shape`` has such."""
        left = iter(new)
        return "".join(next(left) if c.isalnum() else c for c in shape)

    def _mail(self, value: str) -> str:
        local, at, domain = value.partition("@")
        classes = ["abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "0123456789" for c in local if c.isalnum()]
        x, n = 0, 1
        for c, own in zip((c for c in local if c.isalnum()), classes):
            x, n = x * len(own) + own.index(c), n * len(own)
        x, out = self.permute(x, n, "mail" + domain.lower()), []
        for own in reversed(classes):
            x, r = divmod(x, len(own))
            out.append(own[r])
        return self._refill(local, "".join(reversed(out))) + at + domain

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) != 1:
            return None
        body = plain[4:]
        own = iter(self.digits("".join(c for c in body if c.isdigit()), "iban" + plain[:2]))
        body = "".join(next(own) if c.isdigit() else c for c in body)
        return self._refill(value, plain[:2] + f"{98 - number(body + plain[:2] + '00'):02d}" + body)

    def _ip(self, value: str) -> str | None:
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255:
            return None
        x = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, day: date) -> date | None:
        n = day.toordinal() - FIRST_DAY
        span = LAST_DAY - FIRST_DAY + 1
        return date.fromordinal(FIRST_DAY + self.permute(n, span, "date")) if 0 <= n < span else None

    def _iso(self, value: str) -> str | None:
        try:
            new = self._date(date.fromisoformat(value))
        except ValueError:
            return None
        return new and new.isoformat()

    def _day(self, value: str) -> str | None:
        sep = "/" if "/" in value else "."
        a, b, year = value.split(sep)
        for flip in (False, True):  # day first, else month first
            try:
                new = self._date(date(int(year), int(a if flip else b), int(b if flip else a)))
            except ValueError:
                continue
            if new is None:
                return None
            two = (new.month, new.day) if flip else (new.day, new.month)
            return sep.join([*(str(x).zfill(len(y)) for x, y in zip(two, (a, b))), str(new.year)])
        return None

    def _ssn(self, value: str) -> str | None:
        def valid(s: str) -> bool:
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        plain = value.replace("-", "")
        if not valid(plain):
            return None
        plain = self.digits(plain, "ssn")
        while not valid(plain):
            plain = self.digits(plain, "ssn")
        return self._refill(value, plain)

    def _card(self, value: str) -> str | None:
        plain = re.sub("[ -]", "", value)
        if _luhn(plain[:-1]) != plain[-1] or len(set(plain)) == 1:
            return None
        new = self.digits(plain[:-1], "card")
        while len(set(new + _luhn(new))) == 1:
            new = self.digits(new, "card")
        return self._refill(value, new + _luhn(new))

    def _phone(self, value: str) -> str | None:
        plain = re.sub("[^0-9]", "", value)
        country, own = plain[:-10] if len(plain) > 10 else "", plain[-10:]
        if len(set(own)) == 1:
            return None
        own = self.digits(own, "phone")
        while len(set(own)) == 1:
            own = self.digits(own, "phone")
        return self._refill(value, country + own)

    def replace(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with its values replaced, and the kinds of the values in order."""
        if not text or not _MAY.search(text):
            return text, []
        found = list(self._values(text))
        odd, low = [], 0
        for start, stop, *_ in [*found, (len(text), len(text))]:
            odd += self._odd_cards(text, low, start)
            low = stop
        out, kinds, low = [], [], 0
        for start, stop, kind, new in sorted(found + odd):
            out += text[low:start], new
            kinds.append({"iso": "date", "day": "date"}.get(kind, kind))
            low = stop
        return "".join([*out, text[low:]]), kinds

    def _values(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """Start, stop, kind and pseudonym of values from left to right. Where nothing that matches
        validates, the search goes on one letter later."""
        at = 0
        while m := _ANY.search(text, at):
            start, at = m.start(), m.start() + 1
            first = next(k for k, kind in enumerate(_ORDER) if m[kind] is not None)
            for kind, pattern in zip(_ORDER[first:], _EACH[first:]):
                if not (own := pattern.match(text, start)):
                    continue
                for value in _accounts(own[0]) if kind == "iban" else (own[0],):
                    if (new := self._known(kind, value)) is not None:
                        at = start + len(value)
                        yield start, at, kind, new
                        break
                else:
                    continue
                break

    def _odd_cards(self, text: str, low: int, high: int) -> Iterator[tuple[int, int, str, str]]:
        """Cards in text[low:high] with other groups, at each start the longest that validates."""
        while m := _ODD_CARD.search(text, low, high):
            low = m.start() + 1
            for pattern in _ODD_CARDS:
                own = pattern.match(text, m.start(), high)
                if own and (new := self._known("card", own[0])) is not None:
                    low = own.end()
                    yield m.start(), low, "card", new
                    break


def _accounts(value: str) -> Iterator[str]:
    """What may be an account number at the start of ``value``: up to its first space, then all
    and ever fewer groups."""
    first = value.partition(" ")[0]
    if _ACCOUNT.fullmatch(first):
        yield first
    while value != first:
        if _ACCOUNT.fullmatch(value):
            yield value
        value = value.rpartition(" ")[0]


def _luhn(digits: str) -> str:
    """The check digit for the digits before it."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced, and n_values and kinds (of the values, in order)."""
    kept = docs.drop("n_values", "kinds")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_values", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    names = [f.name for f in schema.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in sliced(batches):
            at = batch.schema.get_field_index(text)
            done = [pseudonyms.replace(t) for t in batch.column(at).to_pylist()]
            columns = [batch.column(k) if k != at else pa.array([t for t, _ in done], batch.column(k).type) for k in range(batch.num_columns)]
            columns += [pa.array([len(k) for _, k in done], pa.int64()), pa.array([k for _, k in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(work, schema)
