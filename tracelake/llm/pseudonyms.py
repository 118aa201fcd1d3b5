"""Format-preserving pseudonyms for personal data.

Validated values are replaced by a keyed permutation of all values of their own
format: a Feistel network over the value's number, walked until it lies in the
format again.  Equal values get equal pseudonyms in every document, different
values different ones, and a pseudonym passes the same validation.

Values are equal whatever they are written like: a date in any order of its parts, a
number with or without its country code, letters in either case.  Where a form could
be read in two ways (day and month), the permutation keeps to dates that are read alike.

Replaced: payment card numbers (Luhn), bank account numbers (mod 97), social
security numbers, phone numbers (numbering plan), IPv4 and IPv6 addresses, calendar
dates, the local part of e-mail addresses, hexadecimal secrets of 32 and more digits,
access keys, and values assigned to passwords, tokens and the like.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from tracelake.llm import common

ROUNDS = 8


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of 0 .. size-1, one for each ``kind``."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    label = kind.encode()
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            seed = b"%d|%d|%d|" % (r, size, right) + label
            f = hashlib.blake2b(seed, key=key, digest_size=max(8, (half + 7) // 8)).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        value = left << half | right
        if value < size:  # else walk on: the cycle through a valid value comes back to one
            return value


def luhn_digit(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]):
        return None
    n = len(d) - 1
    body = str(permute(int(d[:n]), 10**n, key, f"card{n}")).zfill(n)
    return _refill(text, body + str(luhn_digit(body)))


def _mixed(text: str, key: bytes, kind: str) -> str:
    """Every letter and digit permuted together, each place keeping its class (digit, a-z, A-Z)."""
    bases = [(10, "0") if c in "0123456789" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else None for c in text]
    value, size = 0, 1
    for c, b in zip(text, bases, strict=True):
        if b:
            value, size = value * b[0] + ord(c) - ord(b[1]), size * b[0]
    value = permute(value, size, key, kind + ":" + "".join(b[1] if b else c for c, b in zip(text, bases, strict=True)))
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if bases[i]:
            value, r = divmod(value, bases[i][0])
            out[i] = chr(ord(bases[i][1]) + r)
    return "".join(out)


def _cased(shape: str, text: str) -> str:
    """``text`` with upper-case letters at the places where ``shape`` of the same length has them."""
    return "".join(c.upper() if s.isupper() else c for s, c in zip(shape, text, strict=True))


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "").upper()
    number = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) != 1:
        return None
    body = _mixed(plain[4:], key, "iban" + plain[:2])
    check = 98 - number(body + plain[:2] + "00")
    it = iter(plain[:2] + f"{check:02d}" + body)
    made = "".join(c if c == " " else next(it) for c in text)
    return made if text.upper() == text else _cased(text, made.lower())


def ssn(text: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permute(value, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _code(three: int) -> int | None:
    """The number of an area or exchange code among the valid ones (200 to 999 but not n11)."""
    if three < 200 or three % 100 == 11:
        return None
    return three - 200 - (three - 200) // 100 - (three % 100 > 11)


def _from_code(number: int) -> int:
    hundred, rest = divmod(number, 99)
    return 200 + hundred * 100 + rest + (rest >= 11)


def phone(text: str, key: bytes) -> str | None:
    """Ten digits of the North American plan, after a 1 or without, are permuted among its valid numbers.

    Ten digits that are none of the plan's count only where a plus or a bracket says that they are a number to call,
    and are permuted among such.  Of other numbers after a plus, all but the first three digits are permuted (the
    last ten at most).  Signs stay.
    """
    d = _digits(text)
    if len(d) == 10 and text[0] != "+" or len(d) == 11 and d[0] == "1":
        head, body = d[:-10], d[-10:]
        area, exchange = _code(int(body[:3])), _code(int(body[3:6]))
        if area is None or exchange is None:
            if text[0] not in "+(":
                return None
            value = int(body)
            while True:
                value = permute(value, 10**10, key, "odd phone")
                made = f"{value:010d}"
                if _code(int(made[:3])) is None or _code(int(made[3:6])) is None:  # walk on among the odd ones
                    return _refill(text, head + made)
        value = permute((area * 792 + exchange) * 10_000 + int(body[6:]), 792 * 792 * 10_000, key, "phone")
        rest, line = divmod(value, 10_000)
        return _refill(text, f"{head}{_from_code(rest // 792)}{_from_code(rest % 792)}{line:04d}")
    if text[0] != "+" or not 8 <= len(d) <= 15 or d[0] == "1":
        return None
    n = min(10, len(d) - 3)
    head, body = d[:-n], d[-n:]
    return _refill(text, head + str(permute(int(body), 10**n, key, "phone" + head)).zfill(n))


def ipv4(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4")
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def ipv6(text: str, key: bytes) -> str | None:
    """All 128 bits are permuted; a short form stays short, a form in full stays in full."""
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    made = ipaddress.IPv6Address(permute(value, 1 << 128, key, "ipv6"))
    shown = made.exploded if len(text) == 39 else made.compressed
    return shown.upper() if text.upper() == text else shown


_ERAS = [datetime.date(1, 1, 1).toordinal(), datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal(), datetime.date.max.toordinal() + 1]


def _date(year: int, month: int, day: int, key: bytes) -> datetime.date | None:
    """The pseudonym of a date: in the same era, and with a day up to 12 exactly where the date has one.

    So a form that puts the month first is read the same way before and after, and a date's
    pseudonym doesn't depend on its form.
    """
    try:
        date = datetime.date(year, month, day)
    except ValueError:
        return None
    value = date.toordinal()
    era = max(i for i, a in enumerate(_ERAS[:-1]) if value >= a)
    low, size = _ERAS[era], _ERAS[era + 1] - _ERAS[era]
    while True:
        value = low + permute(value - low, size, key, f"date{era}")
        made = datetime.date.fromordinal(value)
        if (made.day <= 12) == (day <= 12):  # else walk on: the cycle through the date comes back to one like it
            return made


def date(text: str, key: bytes) -> str | None:
    """Year first, or day first, or (where only that is a date) month first; days and months padded as they were."""
    sep = re.search(r"[-/.]", text)[0]
    parts = text.split(sep)
    p = [int(x) for x in parts]
    first = len(parts[0]) == 4
    order = (0, 1, 2) if first else (2, 1, 0) if p[1] <= 12 else (2, 0, 1)
    new = _date(*(p[i] for i in order), key)
    if new is None:
        return None
    padded = "2" if all(len(x) >= 2 for x in parts) else "1"
    shown = dict(zip(order, (f"{new.year:04d}", f"{new.month:0{padded}d}", f"{new.day:0{padded}d}"), strict=True))
    return sep.join(shown[i] for i in range(3))


def email(text: str, key: bytes) -> str | None:
    local, _, domain = text.partition("@")
    return _cased(local, _mixed(local.lower(), key, "email" + domain.lower())) + "@" + domain


def secret(text: str, key: bytes) -> str | None:
    if not (any(c.isdigit() for c in text) and any(c.isalpha() for c in text)) or not (text.islower() or text.isupper()):
        return None
    n = len(text)
    made = f"{permute(int(text, 16), 16**n, key, f'hex{n}'):0{n}x}"
    return made.upper() if text.isupper() else made


def credential(text: str, key: bytes) -> str | None:
    """A password, token or access key: letters and digits permuted in their classes; needs both."""
    if not (any(c.isdigit() for c in text) and any(c.isalpha() for c in text)):
        return None
    return _mixed(text.lower(), key, "credential").upper() if text.isupper() else _mixed(text, key, "credential")


def access_key(text: str, key: bytes) -> str | None:
    return text[:4] + _mixed(text[4:], key, "access" + text[:4])


#: Tried in this order at each place.  A group named v is the part that is replaced.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}[a-z0-9]{11,30})(?![A-Za-z0-9])", iban),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])", secret),
    ("access_key", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    ("credential", r"(?i)(?<![a-z0-9])(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?P<v>[a-z0-9][a-z0-9+/_.-]{6,}[a-z0-9+/_])", credential),
    ("ipv4", r"(?<![0-9.A-Za-z])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", ipv4),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:]|\.[0-9])", ipv6),
    ("date", r"(?<![0-9A-Za-z./-])(?:[0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2}|[0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4})(?:(?=T[0-9]{2}:)|(?![0-9A-Za-z]|[./-][0-9]))", date),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])", ssn),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", phone),
    ("phone", r"(?<![0-9A-Za-z+])\+[1-9](?:(?:[ .-]|[ .-]?\(|\)[ .-]?)?[0-9]){7,14}(?![0-9A-Za-z]|[ .-]?[0-9])", phone),
    ("card", r"(?<![0-9A-Za-z])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9]|[A-Za-z])", card),
)
_PATTERNS = [(kind, re.compile(pattern)) for kind, pattern, _ in KINDS]
_LIKELY = re.compile(r"[0-9@]")


def _find(line: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, pseudonym) of the values in a line, without overlap; earlier kinds come first."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(line))
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(line):
            start, stop = m.span("v") if "v" in pattern.groupindex else m.span()
            if taken.find(1, start, stop) >= 0:
                continue
            made = _made(kind, line[start:stop], key)
            if made is not None:
                taken[start:stop] = b"\1" * (stop - start)
                found.append((start, stop, kind, made))
    return sorted(found + _inner_cards(line, taken, key))


#: How cards are usually written, as digits in each group; tried before other windows.
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1)}
_GROUP = re.compile(r"(?<![0-9A-Za-z])[0-9]+(?![0-9A-Za-z])")


def _inner_cards(line: str, taken: bytearray, key: bytes) -> list[tuple[int, int, str, str]]:
    """Valid numbers among the groups of longer runs of digits: usual forms first, then longer ones, then from the left."""
    groups = [m.span() for m in _GROUP.finditer(line)]
    windows = []
    for i, (start, stop) in enumerate(groups):
        sizes: tuple[int, ...] = ()
        for j in range(i, len(groups)):
            if j > i and not (groups[j][0] == stop + 1 and line[stop] in " -"):
                break
            stop = groups[j][1]
            sizes += (stop - groups[j][0],)
            if sum(sizes) > 19:
                break
            if sum(sizes) >= 13 and taken.find(1, start, stop) < 0 and (made := _made("card", line[start:stop], key)) is not None:
                windows.append((len(sizes) > 1 and sizes not in _CARD_GROUPS, -sum(sizes), start, stop, made))
    found = []
    for _, _, start, stop, made in sorted(windows):
        if taken.find(1, start, stop) < 0:
            taken[start:stop] = b"\1" * (stop - start)
            found.append((start, stop, "card", made))
    return found


_CHANGES = {kind: change for kind, _, change in KINDS}


@lru_cache(maxsize=50_000)
def _made(kind: str, text: str, key: bytes) -> str | None:
    return _CHANGES[kind](text, key)


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with pseudonyms, and (kind, start, stop) of what they replaced, in code points of the old text."""
    if not text or not _LIKELY.search(text):
        return text, []
    out, spans, at = [], [], 0
    for line in text.split("\n"):
        done = 0
        if _LIKELY.search(line):
            for start, stop, kind, made in _find(line, key):
                out += [line[done:start], made]
                done = stop
                spans.append({"kind": kind, "start": at + start, "stop": at + stop})
        out += [line[done:], "\n"]
        at += len(line) + 1
    return "".join(out[:-1]), spans


def replace_personal_data(documents: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_found, spans), one row for each row of ``documents``.

    Null texts stay null, empty ones empty, each without spans; repeated rows each
    get a row; an empty table gives an empty table; columns other than doc_id and
    text are ignored.  ``key`` has 1 to 64 bytes and is the only secret.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def work(c: dict[str, list]) -> dict[str, list]:
        done = [pseudonymise(t, key) for t in c["text"]]
        return {"doc_id": c["doc_id"], "text": [t for t, _ in done], "n_found": [len(s) for _, s in done], "spans": [s for _, s in done]}

    schema = f"doc_id {kind}, text string, n_found bigint, spans array<struct<kind:string,start:bigint,stop:bigint>>"
    return common.map_batches(documents.select("doc_id", "text"), work, schema)
