"""Format-preserving Feistel pseudonyms for validated numbers and dates.

Card numbers (Luhn), IBANs (mod 97), dotted IPv4 addresses, phone numbers and
calendar dates are found in whole texts and permuted, under a key, among the
values of their own format: separators, lengths, prefixes that carry the format
and the validity of check digits and dates stay.  The permutation depends on
the key and the value only, so equal values get equal pseudonyms in all documents, and
who holds the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("card", "iban", "ip", "phone", "date")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

#: Of each kind; a candidate counts only if its check passes.
_SHAPES = {
    "iban": r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){8,31}|[a-z]{2}\d{2}[a-z0-9]{8,31}",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\)[ ]?\d{3}[.-]\d{4}|(?:1-)?\d{3}-\d{3}-\d{4}|(?:1\.)?\d{3}\.\d{3}\.\d{4}",
    "world": r"\+[1-9]\d{0,2}(?:[ .-]?\(\d{1,5}\))?(?:(?:[ -]?\d){5,14}|(?:\.?\d){5,14})",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
_END = r"(?![\w-]|\.\d)"
#: One pass over the text finds where a candidate of any kind starts.
PATTERN = regex.compile(r"(?<![\w.+-])(?:" + "|".join(_SHAPES.values()) + ")" + _END)
_ONE = {kind: regex.compile(f"(?:{shape}){_END}") for kind, shape in _SHAPES.items()}
_BEHIND = regex.compile(_END)
#: Text behind some values that decides how they are read: no candidate is longer.
_REACH = 80
#: Lengths of IBANs by country.
IBAN_LENGTH = {
    c: n
    for n, codes in {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()
    for c in codes.split()
}
#: Calling codes of two digits; 1 and 7 have one, all others three.
_CODES = {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _feistel(value: int, size: int, key: bytes, back: bool) -> int:
    """Keyed permutation of ``range(size)``: a Feistel network on the next even number of
    bits, walked on until the value falls in the range."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ _round(key, size, n, left, mask), left
            else:
                left, right = right, left ^ _round(key, size, n, right, mask)
        value = left << half | right
        if value < size:
            return value


def _round(key: bytes, size: int, n: int, half: int, mask: int) -> int:
    text = b"%d:%d:%d" % (size, n, half)
    return int.from_bytes(hmac.digest(key, text, "sha256")[:16], "big") & mask


def luhn_digit(digits: str) -> str:
    """Check digit that makes ``digits`` plus it a valid card number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    """Two check digits of an IBAN."""
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _permute(digits: str, key: bytes, back: bool) -> str:
    return f"{_feistel(int(digits), 10 ** len(digits), key, back):0{len(digits)}d}"


def _permute_mixed(text: str, key: bytes, back: bool) -> str:
    """``text`` of digits and capitals permuted, each in a place of its own sort."""
    value, size = 0, 1
    for c in text:
        base = 10 if c.isdigit() else 26
        value, size = value * base + (int(c) if base == 10 else ord(c) - 65), size * base
    value, out = _feistel(value, size, key, back), []
    for c in reversed(text):
        value, d = divmod(value, 10 if c.isdigit() else 26)
        out.append(str(d) if c.isdigit() else chr(65 + d))
    return "".join(reversed(out))


def _date_parts(text: str):
    """``(ordinal, format)`` of a valid date from 1900 to 2099; None otherwise.  With slashes
    the month may come first, where the day cannot."""
    if text[4] in "-/":
        return _date_in(text, f"%Y{text[4]}%m{text[4]}%d")
    found = _date_in(text, f"%d{text[2]}%m{text[2]}%Y")
    return _date_in(text, "%m/%d/%Y") if found is None and text[2] == "/" else found


def _date_in(text: str, form: str):
    try:
        day = datetime.datetime.strptime(text, form).date().toordinal() - _FIRST_DAY
    except ValueError:
        return None
    return (day, form) if 0 <= day < _DAYS else None


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """Pseudonym of a value (or, ``back``, the value of a pseudonym); None if not valid."""
    own = hashlib.sha256(kind.encode() + b"\0" + key).digest()
    digits = "".join(c for c in text if c.isdigit())
    if not digits.isascii():
        return None
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or len({*digits}) == 1:
            return None
        new = digits[:1] + _permute(digits[1:-1], own + digits[:1].encode(), back)
        new += luhn_digit(new)
        return _refill(text, new) if len({*new}) > 1 else text
    if kind == "iban":
        plain = text.replace(" ", "").upper()
        # Letters only where the country's length tells the value from words in capitals.
        if not plain[4:].isdigit() and len(plain) != IBAN_LENGTH.get(plain[:2]):
            return None
        if iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        if plain[4:].isdigit():
            account = _permute(plain[4:], own + plain[:2].encode(), back)
        else:  # letters and digits stay in their places
            shape = "".join("9" if c.isdigit() else "A" for c in plain[4:])
            account = _permute_mixed(plain[4:], own + plain[:2].encode() + shape.encode(), back)
        new = iter(plain[:2] + iban_check(plain[:2], account) + account)
        new = "".join(c if c == " " else next(new) for c in text)
        return new.lower() if text[:1].islower() else new
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(p != str(int(p)) for p in text.split(".")):
            return None
        n = _feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, own, back)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "phone":
        # One number in any form: calling code 1 where none is given.  Code 1 keeps its
        # area too, all others the code only.
        whole = digits if text[0] == "+" or len(digits) == 11 else "1" + digits
        if not 8 <= len(whole) <= 15:
            return None
        n = 4 if whole[0] == "1" and len(whole) == 11 else 1 if whole[0] in "17" else 2 if whole[:2] in _CODES else 3
        new = whole[:n] + _permute(whole[n:], own + whole[:n].encode(), back)
        return _refill(text, new[len(whole) - len(digits) :])
    found = _date_parts(text)
    if found is None:
        return None
    # One day in any form.  Days up to 12 and later ones are permuted apart, so that a day
    # whose place only its size tells is read in the same place again.
    at, late = found[0], _late(found[0])
    while True:
        at = _feistel(at, _DAYS, own, back)
        if _late(at) == late:
            return datetime.date.fromordinal(_FIRST_DAY + at).strftime(found[1])


def _late(day: int) -> bool:
    return datetime.date.fromordinal(_FIRST_DAY + day).day > 12


def _candidates(text: str, start: int):
    """``(kind, end)`` of the candidates that start there, as the form alone tells: an IBAN of
    its country's length first, of one kind the longest first."""
    for shape, one in _ONE.items():
        m = one.match(text, start)
        kind = "phone" if shape == "world" else shape
        ends, first = [], None
        while m:
            ends.append(m.end())
            m = one.match(text, start, m.end() - 1) if shape in ("iban", "world", "card") else None
            while m and not _BEHIND.match(text, m.end()):  # the cut hid what stands behind
                m = one.match(text, start, m.end() - 1)
        if shape == "iban" and ends:
            n = IBAN_LENGTH.get(text[start : start + 2].upper())
            first = next((e for e in ends if e - start - text.count(" ", start, e) == n), None)
        if first is not None:
            yield kind, first
        yield from ((kind, e) for e in ends if e != first)


def _found(text: str, key: bytes, back: bool):
    """``(values, failed)``: ``(kind, start, end, pseudonym)`` of the valid values, and
    ``(start, end)`` of the candidates tried in vain."""
    values, failed, at = [], [], 0
    while m := PATTERN.search(text, at):
        start, at = m.start(), m.start() + 1
        for kind, end in _candidates(text, start):
            new = _cached(kind, text[start:end], key, back)
            if new is not None:
                values.append((kind, start, end, new))
                at = end
                break
            failed.append((start, end))
    return values, failed


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """``text`` with all valid values replaced, and ``(kind, start, end)`` of each in ``text``.

    Where a candidate fails its check, shorter ones and other kinds from the same start
    are tried, then the search goes on behind its first character.  A value that a failed
    candidate overlaps is permuted on until the new text is read as the old one was, so that
    it can be undone: the new digits may not make the failed candidate valid.
    """
    values, failed = _found(text, key, back)
    out, spans, done, k = [], [(kind, a, b) for kind, a, b, _ in values], 0, 0
    marks = sorted(failed)
    starts = [a for a, _ in marks]
    longest = max((b - a for a, b in marks), default=0)

    def near(low: int, high: int) -> list:
        """Failed candidates that overlap; they start within the longest one's reach."""
        some = marks[bisect_right(starts, low - longest) : bisect_left(starts, high)]
        return [(a, b) for a, b in some if b > low]

    while k < len(values):
        low, high, some = values[k][1], values[k][2], 1
        grown = True
        while grown:  # values and failed candidates that overlap
            over = near(low, high)
            new_low, new_high = min([low, *(a for a, _ in over)]), max([high, *(b for _, b in over)])
            while k + some < len(values) and values[k + some][1] < new_high:
                new_high = max(new_high, values[k + some][2])
                some += 1
            grown, low, high = (new_low, new_high) != (low, high), new_low, new_high
        group = values[k : k + some]
        new, layout = _filled(text, group, low, high)
        if near(low, high):
            tail = text[high : high + _REACH]
            while [x[:3] for x in _found(new + tail, key, back)[0] if x[1] < len(new)] != layout:
                group = [(kind, a, b, _cached(kind, old, key, back)) for kind, a, b, old in group]
                new, layout = _filled(text, group, low, high)
        out += [text[done:low], new]
        done, k = high, k + some
    return "".join([*out, text[done:]]), spans


def _filled(text: str, group: list, low: int, high: int):
    """``text[low:high]`` with the values of ``group`` replaced, and ``(kind, start, end)`` of them there."""
    new, layout = "", []
    for kind, a, b, value in group:
        new += text[low:a]
        layout.append((kind, len(new), len(new) + len(value)))
        new += value
        low = b
    return new + text[low:high], layout


_cached = lru_cache(maxsize=1 << 16)(pseudonym)


def production_key(spark: SparkSession) -> str:
    """The key of the session, ``spark.basketry.pii.key``; without one a fixed public key, good
    for tests and for linking equal values, not for secrecy."""
    return spark.conf.get("spark.basketry.pii.key", "public test key")


def pseudonymise(docs: DataFrame, key: str, text_col="text", spans_col="pii_spans", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text and ``pii_spans``: kind, start and end (code points
    of the text given) of each value replaced.  ``back`` undoes it.

    A null text stays null, without spans; rows and other columns stay as they are, but
    for a column of the spans' name, which is replaced.  Equal values get equal pseudonyms in
    every form they are written in.  Time grows with a text's length, however long it is;
    an empty table stays empty.  The key goes to the tasks only.
    """
    rows = docs.drop(spans_col)
    at = rows.columns.index(text_col)
    secret = key.encode()
    kind = "array<struct<kind:string,start:int,end:int>>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            done = [("", []) if t is None else replace(t, secret, back) for t in b.column(at).to_pylist()]
            texts = pa.array([None if t is None else d[0] for t, d in zip(b.column(at).to_pylist(), done)], pa.string())
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in d[1]] for d in done], span)
            arrays = [texts if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*arrays, spans], [*b.schema.names, spans_col])

    return rows.mapInArrow(run, rows.withColumn(spans_col, F.array().cast(kind)).schema)


def digest(done: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: values replaced of each kind and the hash of the new text (null: empty)."""
    of = lambda kind: lambda span: span["kind"] == kind  # noqa: E731  (a second parameter would be the index)
    counts = [F.size(F.filter("pii_spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select(F.col(id_col).alias("doc_id"), *counts, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("text_sha256"))
