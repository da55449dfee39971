"""PII: format-preserving Feistel pseudonyms.

Found and validated: card numbers (13 to 19 digits with a right Luhn digit), IBANs (mod 97), US social security numbers, telephone
numbers, IPv4 addresses, dates (year first, or day and month first), and e-mail addresses. Each value is
numbered within its format (all values of the same shape that would pass the same validation) and
that number is permuted by a keyed Feistel network with cycle walking; so the pseudonym
has the same format, passes the same validation, and equal values give equal pseudonyms in all documents. It is
a bijection: whoever has the key can go back (`reveal`).

A narrow stage over whole texts. Defined cases: a null text stays null; an empty one stays empty; values that fail
validation stay; repeated rows each get the same pseudonyms; a format of a single value keeps it. Other columns are never read.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import tidy

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")


def permute(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of 0 ... size - 1."""
    if size < 2:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, width = (1 << half) - 1, (half + 7) // 8

    def round_(i: int, x: int) -> int:
        h = hashlib.blake2b(i.to_bytes(1, "big") + x.to_bytes(width, "big") + tweak.encode(), key=key, digest_size=min(64, width + 8))
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ round_(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ round_(i, right)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> int:
    """The check digit that goes after these digits."""
    odd = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-1][::2])
    return -(odd + sum(map(int, digits[::-1][1::2]))) % 10


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


Move = Callable[[str, int, int], int]


def _is_card(run: str) -> bool:
    digits = re.sub(r"\D", "", run)
    return 13 <= len(digits) <= 19 and int(digits[-1]) == luhn_digit(digits[:-1]) and len(set(digits)) > 1


def _card(run: str, move: Move) -> str:
    digits = re.sub(r"\D", "", run)
    # The first digit says the network and stays.
    n = len(digits) - 2
    body = digits[0] + str(move(f"card{digits[0]}{n}", int(digits[1:-1]), 10**n)).zfill(n)
    return _fill(run, body + str(luhn_digit(body)))


def _cards(pattern: re.Pattern, text: str, free: Callable[[int, int], bool], move: Move) -> Iterator[tuple[int, int, str]]:
    """Start, end and pseudonym of each card number.

    From each start the longest run is tried first, then those that end at an earlier separator, then the
    next start behind a separator. The pseudonym is one with which the runs tried before still are no card
    numbers (walking on until it is), so the text is read back the same way; only a run tried in vain that
    reaches over two card numbers can prevent that.
    """
    at, failed = 0, []
    while m := pattern.search(text, at):
        start, found = m.start(), None
        for end in (m.end(), *(k for k in range(m.end() - 1, start + 12, -1) if text[k] in " -")):
            if not free(start, end):
                continue
            if _is_card(text[start:end]):
                found = end
                break
            failed.append((start, end))
        if found is None:
            failed = [(a, b) for a, b in failed if b > start]
            gap = re.compile("[ -]").search(text, start, m.end())
            at = gap.end() if gap else m.end()
            continue
        failed = [(a, b) for a, b in failed if b > start]
        lo, hi = min([start, *(a for a, _ in failed)]), max([found, *(b for _, b in failed)])
        new, read = text[start:found], False
        while not read:
            new = _card(new, move)
            around = text[lo:start] + new + text[found:hi]
            read = _is_card(new) and not any(_is_card(around[a - lo : b - lo]) for a, b in failed)
        yield start, found, new
        at, failed = found, []


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _mixed(text: str) -> tuple[int, int]:
    """The text's number among all of the same shape (digits, upper and lower case), and how many there are."""
    at, size = 0, 1
    for c in text:
        if "0" <= c <= "9":
            at, size = at * 10 + ord(c) - 48, size * 10
        elif "A" <= c <= "Z":
            at, size = at * 26 + ord(c) - 65, size * 26
        elif "a" <= c <= "z":
            at, size = at * 26 + ord(c) - 97, size * 26
    return at, size


def _of_mixed(shape: str, at: int) -> str:
    out = []
    for c in reversed(shape):
        base = 10 if "0" <= c <= "9" else 26 if "A" <= c <= "Z" or "a" <= c <= "z" else 0
        if base:
            at, x = divmod(at, base)
            c = chr((48 if base == 10 else 65 if c <= "Z" else 97) + x)
        out.append(c)
    return "".join(reversed(out))


def _shape(text: str) -> str:
    return "".join("0" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else c for c in text)


def _iban(m: re.Match, move: Move) -> str | None:
    plain = m[0].replace(" ", "")
    country, rest = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in rest + plain[:4])) % 97 != 1:
        return None
    at, size = _mixed(rest)
    new = _of_mixed(rest, move("iban" + country + _shape(rest), at, size))
    it = iter(country + str(_iban_check(country, new)).zfill(2) + new)
    return "".join(c if c == " " else next(it) for c in m[0])


def _ssn(m: re.Match, move: Move) -> str | None:
    area, group, serial = (int(m[0][a:b]) for a, b in ((0, 3), (4, 6), (7, 11)))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at, serial = divmod(move("ssn", at, 898 * 99 * 9999), 9999)
    area, group = divmod(at, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(m: re.Match, move: Move) -> str | None:
    shape = m[0]
    digits = re.sub(r"\D", "", shape)
    if not 8 <= len(digits) <= 15:
        return None
    # A country code (the digits after + up to a separator) stays.
    code = re.match(r"\+(\d{1,3})(?=[ (.-])", shape)
    fixed = len(code[1]) if code else 0
    n = len(digits) - fixed
    return _fill(shape, digits[:fixed] + str(move(f"phone{digits[:fixed]}/{n}", int(digits[fixed:]), 10**n)).zfill(n))


def _ip(m: re.Match, move: Move) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    at = move("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, at.to_bytes(4, "big")))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(m: re.Match, move: Move) -> str | None:
    a, sep, b, c = re.match(r"(\d+)([-./])(\d+)[-./](\d+)", m[0]).groups()
    year_first = len(a) == 4
    # Day before month, unless that makes no date (then month before day).
    tries = [(int(a), int(b), int(c))] if year_first else [(int(c), int(b), int(a)), (int(c), int(a), int(b))]
    for swapped, (y, mo, d) in enumerate(tries):
        try:
            at = datetime.date(y, mo, d).toordinal()
        except ValueError:
            continue
        if not _FIRST <= at <= _LAST:
            return None
        if swapped:
            # Only dates after the 12th read this way; they are permuted among themselves.
            days, nth = _late_days()
            new = datetime.date.fromordinal(days[move("date-us", nth[at], len(days))])
            return f"{new.month:0{len(a)}d}{sep}{new.day:02d}{sep}{new.year}"
        new = datetime.date.fromordinal(_FIRST + move("date", at - _FIRST, _LAST - _FIRST + 1))
        if year_first:
            return f"{new.year}{sep}{new.month:02d}{sep}{new.day:02d}"
        return f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year}"
    return None


@functools.cache
def _late_days() -> tuple[list[int], dict[int, int]]:
    """All days after the 12th of a month, and the number of each."""
    days = [d for d in range(_FIRST, _LAST + 1) if datetime.date.fromordinal(d).day > 12]
    return days, {d: n for n, d in enumerate(days)}


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(_: re.Pattern, text: str, free: Callable[[int, int], bool], move: Move) -> Iterator[tuple[int, int, str]]:
    """Start, end and pseudonym of each address: from each @ to both sides, so that a long text without any costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        while start < at and not text[start].isalnum():  # begins with a letter or digit
            start += 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            local, done = text[start:at], domain.end()
            if free(start, done):
                n, size = _mixed(local)
                yield start, done, _of_mixed(local, move("email" + _shape(local) + domain[0].lower(), n, size)) + domain[0]
        at = text.find("@", max(done, at + 1))


_RULES: tuple[tuple[str, str, Callable], ...] = (
    ("email", "@", _emails),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}([./-])\d{2}\1\d{4})(?![\d]|[./-]\d)", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)", _ssn),
    ("card", r"(?<![\d])\d(?:[ -]?\d){12,18}(?![\d])", _cards),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]?\d{3,4}(?![\d])|(?<![\d+])\+\d{8,15}(?![\d])", _phone),
)
_COMPILED = [(kind, re.compile(pattern, re.ASCII), make) for kind, pattern, make in _RULES]
_MAYBE = re.compile(r"\d[\d .()/-]{4,}\d|@|[A-Z]{2}\d\d", re.ASCII)


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the kind, start and end of each value in the text given."""
    if not _MAYBE.search(text):
        return text, []

    def move(tweak: str, value: int, size: int) -> int:
        return permute(key, tweak, value, size, back)

    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))  # 1 where a value was found

    def free(start: int, end: int) -> bool:
        return taken.find(1, start, end) < 0

    for kind, pattern, make in _COMPILED:
        if kind in ("email", "card"):
            more = list(make(pattern, text, free, move))
        else:
            more = [(m.start(), m.end(), new) for m in pattern.finditer(text) if free(m.start(), m.end()) and (new := make(m, move)) is not None]
        for a, b, new in more:
            found.append((a, b, kind, new))
            taken[a:b] = b"\1" * (b - a)
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(k, a, b) for a, b, k, _ in found]


def reveal(text: str, key: bytes) -> str:
    return pseudonymise(text, key, back=True)[0]


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """Rows doc_id, text (with pseudonyms), n_found, spans (kind:start:end in the text given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None, []) if t is None else pseudonymise(t, key) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t for t, _ in rows], pa.string()),
                    pa.array([len(s) for _, s in rows], pa.int64()),
                    pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in rows], pa.string()),
                ],
                ["doc_id", "text", "n_found", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, text string, n_found long, spans string")
