"""Format-preserving pseudonyms: personal numbers, dates and addresses are permuted within their format by a key.

Found and validated are: payment cards (13-19 digits, alone or in groups, with a right Luhn check digit), IBANs (mod-97
check), US social security numbers (no reserved group), international phone numbers (a plus sign, 8-15 digits), IPv4
addresses (four octets up to 255), IPv6 addresses (eight groups, or fewer about a double colon), calendar dates (ISO, day
first with dots, month first with slashes, English with the month's name), e-mail addresses and quoted hexadecimal secrets.
What fails its validation stays as it is.

Each value is a number in the domain of its format; a Feistel network with a keyed hash as round function permutes the
domain, walking cycles until it is back inside. So a value has one pseudonym in all documents and layouts, different
values have different ones, check digits hold again, and the key undoes it. Layout (spaces, dashes, case, leading zeros)
stays. For that, dates are permuted among those whose day and month have as many digits. A phone number keeps its
country code, which its digits tell (a trunk zero in brackets is layout). IPv6 addresses come out in eight groups, and a
short month name that becomes May is put back as a long one; apart from these, putting back gives the text itself.

A null text gives a null text and no findings; an empty one stays empty. Rows are independent, ids may be null or repeat.
"""

from __future__ import annotations

import ipaddress
import re
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)

#: Country calling codes of one and two digits (all others have three).
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Months.
MONTHS = "January February March April May June July August September October November December".split()

_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?<=[\"'])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,64}(?=[\"']))"
    rf"|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d))"
    rf"|(?P<ip6>(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=(?:[0-9A-Fa-f]*:){{3}})(?=[A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:]|\.\d))"
    r"|(?P<phone>(?<!\w)\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d))"
    rf"|(?P<written>(?<![\w./-])(?:\d{{1,2}} (?:{_MONTH}) \d{{4}}|(?:{_MONTH}) \d{{1,2}}, \d{{4}})(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?!\w|[.-]\d))"
)


class Feistel:
    """A keyed permutation of range(n) for any n."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key[:64], rounds

    def _mix(self, round_: int, kind: str, n: int, x: int) -> int:
        return int.from_bytes(blake2b(f"{round_}|{kind}|{n}|{x}".encode(), key=self.key, digest_size=24).digest(), "big")

    def _once(self, x: int, n: int, kind: str, forth: bool) -> int:
        side = isqrt(n - 1) + 1  # side * side >= n
        a, b = divmod(x, side)
        if forth:
            for r in range(self.rounds):
                a, b = b, (a + self._mix(r, kind, n, b)) % side
        else:
            for r in reversed(range(self.rounds)):
                a, b = (b - self._mix(r, kind, n, a)) % side, a
        return a * side + b

    def permute(self, x: int, n: int, kind: str = "", forth: bool = True) -> int:
        if n < 2:
            return x
        x = self._once(x, n, kind, forth)
        while x >= n:
            x = self._once(x, n, kind, forth)
        return x


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


@lru_cache(16)
def days_like(long_month: bool, long_day: bool) -> tuple[list[int], dict[int, int]]:
    """The days (ordinals) whose month and day have two digits, or one, and the place of each."""
    days = [d for d in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1) if (date.fromordinal(d).month > 9) == long_month and (date.fromordinal(d).day > 9) == long_day]
    return days, {d: k for k, d in enumerate(days)}


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def refill(layout: str, chars: str, taken) -> str:
    """layout with the characters that `taken` accepts replaced by chars in turn."""
    it = iter(chars)
    return "".join(next(it) if taken(c) else c for c in layout)


class Pseudonymizer:
    def __init__(self, key: bytes, forth: bool = True):
        self.feistel, self.forth = Feistel(key), forth

    def digits(self, digits: str, kind: str) -> str:
        return str(self.feistel.permute(int(digits), 10 ** len(digits), kind, self.forth)).zfill(len(digits))

    def string(self, text: str, kind: str) -> str:
        """Letters and digits each stay in their alphabet: lower case, upper case, digits."""
        bases = [(26, "a") if c.islower() else (26, "A") if c.isupper() else (10, "0") for c in text if c.isascii() and c.isalnum()]
        n, x = 1, 0
        for (base, zero), c in zip(bases, [c for c in text if c.isascii() and c.isalnum()], strict=True):
            n, x = n * base, x * base + ord(c) - ord(zero)
        x, out = self.feistel.permute(x, n, kind, self.forth), []
        for base, zero in reversed(bases):
            x, d = divmod(x, base)
            out.append(chr(ord(zero) + d))
        return refill(text, "".join(reversed(out)), lambda c: c.isascii() and c.isalnum())

    def card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        payload = self.digits(d[:-1], "card")
        return refill(s, payload + luhn_digit(payload), str.isdigit)

    def ip(self, s: str) -> str | None:
        x = 0
        for octet in s.split("."):
            x = x << 8 | int(octet)
        x = self.feistel.permute(x, 1 << 32, "ip", self.forth)
        return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))

    def ip6(self, s: str) -> str | None:
        try:
            x = int(ipaddress.IPv6Address(s))
        except ValueError:
            return None
        x = self.feistel.permute(x, 1 << 128, "ip6", self.forth)
        new = ":".join(f"{x >> k & 0xFFFF:x}" for k in range(112, -1, -16))
        return new.upper() if s.isupper() else new

    def phone(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s.replace("(0)", ""))
        if not 8 <= len(d) <= 15 or d[0] == "0":
            return None
        country = next((n for n in (1, 2) if d[:n] in CALLING_CODES), 3)
        new = refill(s.replace("(0)", "()"), d[:country] + self.digits(d[country:], "phone" + d[:country]), str.isdigit)
        return new.replace("()", "(0)")

    def day(self, year: int, month: int, day: int) -> date | None:
        """The pseudonym of a day, if there is such a day in the domain."""
        try:
            found = date(year, month, day)
        except ValueError:
            return None
        if not FIRST_DAY <= found <= LAST_DAY:
            return None
        days, places = days_like(month > 9, day > 9)
        return date.fromordinal(days[self.feistel.permute(places[found.toordinal()], len(days), f"date{month > 9}{day > 9}", self.forth)])

    def date(self, s: str) -> str | None:
        sep = "-" if "-" in s else "." if "." in s else "/"
        parts = s.split(sep)
        order = {"-": (0, 1, 2), ".": (2, 1, 0), "/": (2, 0, 1)}[sep]  # of year, month, day
        new = self.day(*(int(parts[k]) for k in order))
        if new is None:
            return None
        values = dict(zip(order, (new.year, new.month, new.day), strict=True))
        return sep.join(str(values[k]).zfill(len(parts[k])) for k in range(3))

    def written(self, s: str) -> str | None:
        day, name, year = re.match(r"(\d+) (\w+) (\d+)", s).groups() if s[0].isdigit() else re.sub(r"(\w+) (\d+), (\d+)", r"\2 \1 \3", s).split()
        month = next(k for k, m in enumerate(MONTHS, 1) if m[:3] == name[:3])
        new = self.day(int(year), month, int(day))
        if new is None:
            return None
        full = MONTHS[new.month - 1]
        name, day = full if len(name) > 3 or name == "May" else full[:3], str(new.day).zfill(len(day))
        return f"{day} {name} {new.year}" if s[0].isdigit() else f"{name} {day}, {new.year}"

    def ssn(self, s: str) -> str | None:
        area, group, serial = (int(x) for x in s.split("-"))
        areas = [*range(1, 666), *range(667, 900)]
        if area not in areas or not group or not serial:
            return None
        x = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        x = self.feistel.permute(x, len(areas) * 99 * 9999, "ssn", self.forth)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, s: str) -> str | None:
        d = s.replace(" ", "")
        if not 15 <= len(d) <= 34 or iban_rest(d) != 1:
            return None
        body = self.string(d[4:], "iban" + d[:2])
        return refill(s, f"{d[:2]}{98 - iban_rest(d[:2] + '00' + body):02d}{body}", str.isalnum)

    def email(self, s: str) -> str | None:
        local, domain = s.rsplit("@", 1)
        return self.string(local, "email" + domain.lower()) + "@" + domain

    def secret(self, s: str) -> str | None:
        new = f"{self.feistel.permute(int(s, 16), 16 ** len(s), 'secret', self.forth):0{len(s)}x}"
        return new.upper() if s.isupper() else new

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it had."""
        found: dict[str, int] = {}

        def swap(m: re.Match) -> str:
            new = getattr(self, m.lastgroup)(m[0])
            if new is None:
                return m[0]
            found[m.lastgroup] = found.get(m.lastgroup, 0) + 1
            return new

        if "@" not in text and not ANY_DIGIT.search(text):
            return text, found
        return PATTERN.sub(swap, text), found


ANY_DIGIT = re.compile(r"\d")


def pseudonymize(docs: DataFrame, key: bytes, forth: bool = True, text_col: str = "text") -> DataFrame:
    """(doc, pseudonyms, n_found, kinds): each row of docs as a struct, its text with pseudonyms, how many values were
    replaced, and how many of each kind. forth = false puts the values back."""

    @F.pandas_udf("pseudonyms string, n_found long, kinds map<string,int>")
    def swap(texts: pd.Series) -> pd.DataFrame:
        work = Pseudonymizer(key, forth)
        done = [(None, {}) if t is None else work.text(t) for t in texts]
        return pd.DataFrame({"pseudonyms": [t for t, _ in done], "n_found": [sum(k.values()) for _, k in done], "kinds": [k for _, k in done]})

    packed = docs.select(F.struct("*").alias("doc"))
    return packed.select("doc", swap(f"doc.{text_col}").alias("x")).select("doc", "x.pseudonyms", "x.n_found", "x.kinds")
