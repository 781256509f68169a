"""Personal data replaced by format-preserving Feistel pseudonyms.

What a pattern finds is validated (check digits, calendar, octets, area codes), read as a number of a known domain,
permuted there by a keyed Feistel network with cycle walking, and written back in its own format. The permutation
depends on key, kind and domain only, so equal values keep equal pseudonyms across documents, different values never
meet, and the holder of the key can invert it. Separators, letter case and lengths stay. Numbers that no check confirms
(sixteen digits without a card's check digit, say) stay as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunked, mapped

ROUNDS = 8
#: Characters of a long value that are permuted as one number.
BLOCK = 64
_SEP = r"[ .\-|!*&%#$]{1,6}"

PATTERN = re.compile(
    r"""
    (?<![A-Za-z]) (?i:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd) \W{0,6} [=:] \W{0,6} (?P<secret>[A-Za-z0-9+/_\-]{12,})
    | (?<![0-9A-Za-z]) (?P<hex>[0-9a-f]{32,64}|[0-9A-F]{32,64}) (?![0-9A-Za-z])
    | (?<![\w.%+\-]) (?P<email>[\w.%+\-]++ @ [A-Za-z0-9\-]+ (?:\.[A-Za-z0-9\-]+)+)
    | (?<![0-9A-Za-z]) (?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?) (?![0-9A-Za-z])
    | (?<![\w.]) (?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}) (?!\.?\w)
    | (?<![\w.\-/]) (?P<date>[0-9]{4}[\-/][0-9]{2}[\-/][0-9]{2}|[0-9]{2}[./\-][0-9]{2}[./\-][0-9]{4}) (?![\w\-/])
    | (?<![\w+]) (?P<phone>(?:\+[0-9]{1,3}%(sep)s)?\([0-9]{2,4}\)%(sep)s[0-9]{3,4}%(sep)s?[0-9]{3,4} | \+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4} | [0-9]{3}([ .\-])[0-9]{3}\8[0-9]{4}) (?![\w])
    | (?<![\w.]) (?P<number>[0-9]{3}[ \-][0-9]{2}[ \-][0-9]{4} | [0-9]{13,19} | [0-9]{4}(?:[ \-][0-9]{4}){2,3}(?:[ \-][0-9]{1,3})? | [0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}) (?![\w])
    """.replace("%(sep)s", _SEP.replace(" ", r"\ ").replace("#", r"\#")),
    re.VERBOSE,
)
#: The bytes without one of which a text holds nothing that PATTERN finds: digits, @, = and the colon.
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[ord(c) for c in "0123456789@=:"]] = True


class Feistel:
    """Keyed permutations of 0 .. n-1 for any n, invertible."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tag: bytes, number: int, value: int, size: int) -> int:
        """A keyed number of `size` bytes; bytes() of the value, since decimal digits of long ones take long."""
        seed = b"%d|" % number + value.to_bytes(-(-value.bit_length() // 8), "big") + b"|" + tag
        made = hashlib.blake2b(seed, key=self.key, digest_size=min(size, 64)).digest()
        return int.from_bytes(made if size <= 64 else hashlib.shake_256(made).digest(size), "big")

    def _pass(self, value: int, width: int, tag: bytes, back: bool) -> int:
        left, right = divmod(value, width)
        size = 16 + width.bit_length() // 8  # of a round: 128 bits more than the half it is added to
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - self._round(tag, number, left, size)) % width, left
            else:
                left, right = right, (left + self._round(tag, number, right, size)) % width
        return left * width + right

    def permute(self, value: int, n: int, tag: bytes, back: bool = False, good: Callable[[int], bool] | None = None) -> int:
        """The image of value; walks on while it is outside the domain or not `good`, which stays a bijection."""
        if n < 2:
            return value
        width = isqrt(n - 1) + 1
        for _ in range(100_000):
            value = self._pass(value, width, tag, back)
            if value < n and (good is None or good(value)):
                return value
        raise ValueError("no valid image")


def luhn_digit(payload: str) -> str:
    """The check digit after `payload`."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(payload)))
    return str(-total % 10)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def refill(shape: str, symbols: str) -> str:
    """`shape` with its ASCII letters and digits replaced by `symbols` in turn."""
    fresh = iter(symbols)
    return "".join(next(fresh) if c.isascii() and c.isalnum() else c for c in shape)


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Pseudonyms:
    """Pseudonyms under one key; back=True gives the original of a pseudonym."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.of = lru_cache(maxsize=20_000)(self._of)

    def digits(self, text: str, kind: str, good: Callable[[str], bool] | None = None) -> str:
        n = len(text)
        check = good and (lambda v: good(f"{v:0{n}d}"))
        return f"{self.feistel.permute(int(text), 10**n, f'{kind}{n}'.encode(), self.back, check):0{n}d}"

    def mixed(self, text: str, kind: str, sets: tuple[str, ...]) -> str:
        """Permutes the characters that are in one of the sets, each within its set.

        Up to BLOCK characters are one number. Longer texts go block by block, each under a tag that also depends on the
        blocks before it as they have become and on those behind it as they were, so that all blocks still depend on all.
        """
        if len(text) <= BLOCK:
            return self._mixed(text, kind, sets)
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        chain = lambda a, b: hashlib.blake2b(a.encode() + b, digest_size=16).digest()
        order = range(len(blocks))
        done, plain = ([b""] * (len(blocks) + 1) for _ in "ab")  # digests of the pseudonym's blocks before, of the original's from here
        if self.back:
            for i in order:
                done[i + 1] = chain(blocks[i], done[i])
        else:
            for i in reversed(order):
                plain[i] = chain(blocks[i], plain[i + 1])
        for i in reversed(order) if self.back else order:
            blocks[i] = self._mixed(blocks[i], f"{kind}#{i}.{(done[i] + plain[i + 1]).hex()}", sets)
            if self.back:
                plain[i] = chain(blocks[i], plain[i + 1])
            else:
                done[i + 1] = chain(blocks[i], done[i])
        return "".join(blocks)

    def _mixed(self, text: str, kind: str, sets: tuple[str, ...]) -> str:
        use = [next((s for s in sets if c in s), None) for c in text]
        value, n = 0, 1
        for c, s in zip(text, use):
            if s:
                value, n = value * len(s) + s.index(c), n * len(s)
        shape = "".join(str(sets.index(s)) if s else c for c, s in zip(text, use))
        value, out = self.feistel.permute(value, n, f"{kind}:{shape}".encode(), self.back), []
        for c, s in zip(reversed(text), reversed(use)):
            if s:
                value, at = divmod(value, len(s))
                c = s[at]
            out.append(c)
        return "".join(reversed(out))

    def _of(self, kind: str, found: str) -> tuple[str, str] | None:
        """(kind, pseudonym), or None if the match isn't valid."""
        if kind == "email":
            local, _, domain = found.rpartition("@")
            return kind, self.mixed(local.lower(), kind, (_DIGITS, _LOWER)) + "@" + domain if local.islower() or not local.isupper() else self.mixed(local.lower(), kind, (_DIGITS, _LOWER)).upper() + "@" + domain
        if kind == "hex":
            if not (re.search("[0-9]", found) and re.search("[A-Fa-f]", found)):
                return None
            low = self.mixed(found.lower(), kind, ("0123456789abcdef",))
            return kind, low if found.lower() == found else low.upper()
        if kind == "secret":
            if re.fullmatch("[0-9a-f]{32,64}|[0-9A-F]{32,64}", found):
                return self._of("hex", found) or ("secret", self.mixed(found, kind, (_DIGITS, _LOWER, _UPPER)))
            return (kind, self.mixed(found, kind, (_DIGITS, _LOWER, _UPPER))) if re.search("[0-9]", found) else None
        if kind == "ip":
            octets = [int(x) for x in found.split(".")]
            if max(octets) > 255:
                return None
            value = self.feistel.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip", self.back)
            return kind, ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "date":
            year_first = found[4] in "-/"
            parts = [int(x) for x in re.split("[^0-9]", found)]
            try:
                day = datetime.date(*(parts if year_first else parts[::-1]))
            except ValueError:
                return None
            if not 0 <= day.toordinal() - _FIRST < _DAYS:
                return None
            moved = datetime.date.fromordinal(_FIRST + self.feistel.permute(day.toordinal() - _FIRST, _DAYS, b"date", self.back))
            return kind, refill(found, moved.strftime("%Y%m%d" if year_first else "%d%m%Y") if moved.year > 999 else "")
        if kind == "iban":
            flat = found.replace(" ", "")
            if not 15 <= len(flat) <= 34 or iban_check(flat[:2], flat[4:]) != flat[2:4]:
                return None
            body = self.mixed(flat[4:], kind + flat[:2], (_DIGITS, _UPPER))
            return kind, refill(found, flat[:2] + iban_check(flat[:2], body) + body)
        flat = re.sub("[^0-9]", "", found)
        if kind == "phone":
            if not 7 <= len(flat) <= 15:
                return None
            lead = re.match(r"\+([0-9]{1,3})(?=[^0-9])", found)
            code = lead.group(1) if lead else ""
            national = flat[len(code) :]
            ok = (lambda d: d[0] in "23456789" and d[3] in "23456789") if len(national) == 10 else None
            if ok and not ok(national):
                if code in ("", "1"):
                    return None
                ok = None
            return kind, refill(found, code + self.digits(national, kind if ok else "phone-other", ok))
        parts = [len(x) for x in re.split("[ -]", found)]
        if parts == [3, 2, 4]:
            ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
            return ("ssn", refill(found, self.digits(flat, "ssn", ok))) if ok(flat) else None
        if 13 <= len(flat) <= 19 and luhn(flat):
            payload = self.digits(flat[:-1], "card")
            return "card", refill(found, payload + luhn_digit(payload))
        return None

    def _valid_part(self, kind: str, found: str) -> tuple[int, tuple[str, str] | None]:
        """(length, (kind, pseudonym)) of the longest beginning, up to a group's end, that is valid; else (first group's length, None)."""
        ends = [m.start() for m in re.finditer("[ -]", found)] if kind in ("number", "iban") else []
        for end in [len(found), *reversed(ends)]:
            made = self.of(kind, found[:end])
            if made is not None:
                return end, made
        return (ends or [len(found)])[0], None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """(text with pseudonyms, [(kind, start, length)] in code points of the result).

        Of a number or IBAN with more groups behind it the longest valid beginning counts.
        """
        out, found, at, size = [], [], 0, 0
        m = PATTERN.search(text)
        while m:
            start = m.start(m.lastgroup)
            length, made = self._valid_part(m.lastgroup, m.group(m.lastgroup))
            if made is not None:
                out += [text[at:start], made[1]]
                found.append((made[0], size + start - at, len(made[1])))
                size, at = size + start - at + len(made[1]), start + length
            m = PATTERN.search(text, max(start + length, m.start() + 1))  # an invalid match may hold a valid one further on
        out.append(text[at:])
        return "".join(out), found


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """docs with text_col pseudonymised and a column pii: array<struct<kind, start, length>> of what was replaced.

    Null texts stay null with an empty array, empty ones empty; repeated rows and null ids stay; all other columns are
    passed on (one already named pii is replaced). Nothing is shuffled, so one hot source or value costs nothing more.
    """
    columns = [c for c in docs.columns if c != "pii"]
    place = columns.index(text_col)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            texts, changed, spans = batch.column(place), {}, {}
            for lo, hi, data, offsets in chunked(texts):
                hits = np.concatenate([[0], np.cumsum(_TRIGGER[data])])
                for i in np.flatnonzero(hits[offsets[1:]] > hits[offsets[:-1]]).tolist():
                    made, found = names.replace(texts[lo + i].as_py())
                    if found:
                        changed[lo + i], spans[lo + i] = made, [dict(zip(("kind", "start", "length"), x)) for x in found]
            if changed:
                values = texts.to_pylist()
                for i, made in changed.items():
                    values[i] = made
                texts = pa.array(values, pa.string())
            arrays = [texts if i == place else c for i, c in enumerate(batch.columns)]
            arrays.append(pa.array([spans.get(i, []) for i in range(batch.num_rows)], pa.list_(kind)))
            yield pa.record_batch(arrays, names=[*columns, "pii"])

    rows = docs.select(columns).withColumn(text_col, F.col(text_col).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return mapped(rows, run, schema + ", pii array<struct<kind: string, start: int, length: int>>")
