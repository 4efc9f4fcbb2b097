"""Personal data replaced by keyed pseudonyms of the same format.

Numbers and dates that pass their validation, and mail addresses, are mapped
through a keyed Feistel permutation of all values of their format: the card
number stays a valid card number, the date a date.  A value always becomes the
same pseudonym, in any document, and whoever holds the key can map it back.
One pass over the texts, no shuffle.
"""

from __future__ import annotations

import bisect
import datetime as dt
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table
from huetide.llm.tokens import chunks, text_bytes

ROUNDS = 10
#: Characters of a value permuted at once.
BLOCK = 64
#: Values longer than this aren't kept for when they come again.
_CACHED = 256
#: Only for tests and the registered query: pass the key of the data's owner.
DEMO_KEY = b"not a secret: replace me"
RESULT = "text string, replaced array<struct<kind:string,start:long,end:long,pseudonym:string>>"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_NEED = re.compile(r"[0-9@]")

#: Kinds in order of precedence where candidates overlap.
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@((?:[A-Za-z0-9-]+\.)+)([A-Za-z]{2,})(?![A-Za-z0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "date": re.compile(r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9])"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])"),
}
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2} ?[A-Z0-9])")
_IBAN_GROUP, _CARD_GROUP = re.compile("[A-Z0-9]+"), re.compile("[0-9]+")


class Feistel:
    """A keyed permutation of range(n) for each label and n: balanced Feistel rounds, repeated while outside."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, label: str, k: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        said = f"{label}|{k}|{half}".encode()
        if size <= 64:
            return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=size).digest(), "big") & ((1 << bits) - 1)
        return int.from_bytes(hashlib.shake_256(self.key + said).digest(size), "big") & ((1 << bits) - 1)

    def _once(self, label: str, x: int, bits: int, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(label, k, left, bits), left
            else:
                left, right = right, left ^ self._round(label, k, right, bits)
        return left << bits | right

    def permute(self, label: str, x: int, n: int, back: bool = False) -> int:
        if n < 2:
            return x
        bits, label = max(1, -(-(n - 1).bit_length() // 2)), f"{label}|{n}"
        x = self._once(label, x, bits, back)
        while x >= n:
            x = self._once(label, x, bits, back)
        return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _block(f: Feistel, label: str, s: str, sets: list[str], back: bool) -> str:
    x, n = 0, 1
    for ch, c in zip(s, sets, strict=True):
        if c:
            x, n = x * len(c) + c.index(ch), n * len(c)
    x = f.permute(label, x, n, back)
    out = []
    for ch, c in zip(reversed(s), reversed(sets), strict=True):
        if c:
            x, k = divmod(x, len(c))
            ch = c[k]
        out.append(ch)
    return "".join(reversed(out))


def _letters(f: Feistel, label: str, s: str, back: bool) -> str:
    """Digits, small and capital letters permuted within their kinds; the rest stays.

    Up to BLOCK characters at once.  Of a longer value each block is permuted
    under a label made of the pseudonyms of the blocks before, so work grows
    with the length and the way back takes the same labels.
    """
    sets = [next((c for c in _CLASSES if ch in c), "") for ch in s]
    form = "".join(c[:1] or ch for ch, c in zip(s, sets, strict=True))
    if len(s) <= BLOCK:
        return _block(f, f"{label}|{form}", s, sets, back)
    seen, out = hashlib.blake2b(f"{label}|{form}".encode(), key=f.key, digest_size=32), []
    for k in range(0, len(s), BLOCK):
        out.append(_block(f, f"{label}|{seen.hexdigest()}", s[k : k + BLOCK], sets[k : k + BLOCK], back))
        seen.update((s[k : k + BLOCK] if back else out[-1]).encode())
    return "".join(out)


def _refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _card(f: Feistel, s: str, back: bool) -> str | None:
    digits = re.sub("[ -]", "", s)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) < 2:
        return None
    n = len(digits) - 1
    body = digits[:-1]
    while True:  # no number of one repeated digit comes in, so none goes out
        body = str(f.permute("card", int(body), 10**n, back)).zfill(n)
        if len(set(body + luhn_digit(body))) > 1:
            return _refill(s, body + luhn_digit(body))


def _ssn_right(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(f: Feistel, s: str, back: bool) -> str | None:
    d = s.replace("-", "")
    if not _ssn_right(d):
        return None
    while True:
        d = str(f.permute("ssn", int(d), 10**9, back)).zfill(9)
        if _ssn_right(d):
            return _refill(s, d)


def _ip(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = f.permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date_parts(s: str) -> tuple[dt.date, str] | None:
    """The day and the order of its parts; two small numbers are taken as month, day."""
    a, b, c = re.split("[-/.]", s)
    order = "ymd" if len(a) == 4 else "dmy" if int(a) > 12 else "mdy"
    y, m, d = (int((a, b, c)[order.index(k)]) for k in "ymd")
    try:
        day = dt.date(y, m, d)
    except ValueError:
        return None
    return (day, order) if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


def _day_kind(day: dt.date) -> tuple[bool, bool, bool]:
    """What a pseudonym keeps: whether the day may be taken for a month, and how many digits the parts have without padding."""
    return day.day > 12, day.day > 9, day.month > 9


def _date(f: Feistel, s: str, back: bool) -> str | None:
    if (got := _date_parts(s)) is None:
        return None
    day, order = got
    mark = re.search("[-/.]", s)[0]
    wide = {k: len(p) > 1 for k, p in zip(order, re.split("[-/.]", s), strict=True)}
    padded = wide["m"] and wide["d"]
    x, n, kind = day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, _day_kind(day)
    while True:  # within days of one kind, so that the pseudonym is the same day in every way of writing
        x = f.permute("date", x, n, back)
        day = dt.date.fromordinal(x + FIRST_DAY)
        if _day_kind(day) == kind:
            break
    put = {"y": f"{day.year:04d}", "m": f"{day.month:02d}" if padded else str(day.month), "d": f"{day.day:02d}" if padded else str(day.day)}
    return mark.join(put[k] for k in order)


def _phone(f: Feistel, s: str, back: bool) -> str | None:
    code = re.match(r"\+(?:[0-9]{1,3}(?=[ .(-])|1|[0-9]{2})", s)  # a run of digits: 1, or two for the country
    head = code[0] if code else ""
    digits = re.sub("[^0-9]", "", s[len(head) :])
    if not 7 <= len(digits) <= 13 or len(head) + len(digits) > 17:
        return None
    lead = int(digits[0]) >= 2  # national numbers begin with 2 to 9 where they did
    low = 2 if lead else 0
    top = 8 if lead else 2
    rest = len(digits) - 1
    x = f.permute(f"phone{head or '+1'}{lead}", (int(digits[0]) - low) * 10**rest + int(digits[1:] or 0), top * 10**rest, back)
    return head + _refill(s[len(head) :], str(x // 10**rest + low) + str(x % 10**rest).zfill(rest))


def iban_digits(s: str) -> str:
    """The check digits of country code + account."""
    number = "".join(str(int(c, 36)) for c in s[2:] + s[:2]) + "00"
    return f"{98 - int(number) % 97:02d}"


def _iban(f: Feistel, s: str, back: bool) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_digits(plain[:2] + plain[4:]) != plain[2:4]:
        return None
    account = _letters(f, "iban" + plain[:2], plain[4:], back)
    it = iter(plain[:2] + iban_digits(plain[:2] + account) + account)
    return "".join(c if c == " " else next(it) for c in s)


def _email(f: Feistel, s: str, back: bool) -> str | None:
    local, _, host = s.partition("@")
    host, _, top = host.rpartition(".")
    return f"{_letters(f, 'mailbox', local, back)}@{_letters(f, 'host', host, back)}.{top}"


MAKERS = {"email": _email, "iban": _iban, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card, "phone": _phone}


def pseudonym(f: Feistel, kind: str, value: str, back: bool = False) -> str | None:
    """The value's pseudonym (``back``: the value of a pseudonym); None if it fails validation."""
    return MAKERS[kind](f, value, back)


def candidates(kind: str, text: str) -> Iterator[tuple[int, list[int]]]:
    """Starts of possible values in order, each with its possible ends, longest first.

    A card number or IBAN may stand beside other digits or capitals that look
    like more of it, so it may begin and end at any group of their run.
    """
    if kind == "iban":
        for m in _IBAN_START.finditer(text):
            if run := PATTERNS[kind].match(text, m.start()):
                ends, size = [], 0
                for g in _IBAN_GROUP.finditer(text, m.start(), run.end()):
                    size += g.end() - g.start()
                    if 15 <= size <= 34:
                        ends.append(g.end())
                yield m.start(), ends[::-1]
    elif kind == "card":
        for run in PATTERNS[kind].finditer(text):
            groups = [g.span() for g in _CARD_GROUP.finditer(text, *run.span())]
            for k, (start, _) in enumerate(groups):
                ends, size = [], 0
                for a, b in groups[k : k + 19]:
                    size += b - a
                    if size > 19:
                        break
                    if size >= 13:
                        ends.append(b)
                yield start, ends[::-1]
    else:
        for m in PATTERNS[kind].finditer(text):
            yield m.start(), [m.end()]


def replace(text: str, make) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and kind, span in the original and pseudonym of each."""
    if not _NEED.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []  # by start, none overlapping
    for kind in PATTERNS:
        done, found = 0, []
        for start, ends in candidates(kind, text):
            if start < done:
                continue
            at = bisect.bisect_right(taken, (start, len(text) + 1))
            low, high = taken[at - 1][1] if at else 0, taken[at][0] if at < len(taken) else len(text)
            for end in ends if start >= low else ():
                if end <= high and (new := make(kind, text[start:end])) is not None:
                    found.append((start, end, kind, new))
                    done = end
                    break
        taken = sorted(taken + found)
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b, new) for a, b, kind, new in taken]


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts with personal data replaced, and what was replaced where.

    One row per input row (repeated rows stay), with ``keep`` and RESULT;
    spans are code points of the original text.  Null stays null, empty stays
    empty, and a text without valid personal data stays as it is.  Other input
    columns are ignored; a kept ``text`` or ``replaced`` gives way to the
    result.
    """
    carry, schema = kept(docs, keep, RESULT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        known = functools.lru_cache(1 << 16)(functools.partial(pseudonym, f))
        make = lambda kind, value: (known if len(value) <= _CACHED else known.__wrapped__)(kind, value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))
        for whole in batches:
            for batch in chunks(whole, "_text"):
                texts, found = [], []
                data, at = text_bytes(batch.column("_text"))
                null = batch.column("_text").is_null().to_pylist()
                for k in range(batch.num_rows):
                    new, spans = replace(data[at[k] : at[k + 1]].tobytes().decode(), make)
                    texts.append(None if null[k] else new)
                    found.append([{"kind": a, "start": b, "end": c, "pseudonym": d} for a, b, c, d in spans])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(texts, pa.string()), pa.array(found, kind)], names=[*carry, "text", "replaced"])

    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(work, schema)


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text and the number of replacements by kind."""
    many = lambda kind: F.size(F.filter("replaced", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", F.size("replaced").cast("long").alias("n_replaced"), *map(many, MAKERS), "text")
