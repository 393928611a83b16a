"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found and validated, then permuted within their own format by a keyed Feistel network over the numbers below a
bound (two halves in a mixed radix, added to each other's keyed hash; values that leave the format walk on until they are back).
Equal values get equal pseudonyms in every document, different values different ones, and the key turns them back.

============ ================================================= ================================================
kind         valid                                           permuted within
============ ================================================= ================================================
card         13 to 19 digits, Luhn                           as many digits, Luhn
iban         two letters, check digits by mod 97             same country, letters and digits in place, mod 97
ssn          three, two, four digits in range                valid numbers of that kind
phone        7 to 15 digits after +, a bracketed prefix, or 3-3-4 as many digits; the first digit after + stays
ipv4         four octets                                     all addresses
date         a real day of 1900 to 2099, ISO or D/M/Y, M/D/Y the days of these years, same notation
email        local part and domain                           letters and digits in place; the top-level domain stays
============ ================================================= ================================================

Separators, brackets and letter case stay where they are. Whole texts are searched; the rest of a text is untouched.

Defined cases: NULL texts stay NULL with no values found, empty ones empty. A value that fails validation is no value. Where kinds overlap,
the one that begins first wins, then the order of ``KINDS``. The key decides the mapping and must be kept secret.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame

ROUNDS = 8
KINDS = ("email", "iban", "ipv4", "date", "ssn", "phone", "card")

#: Fixed formats.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)",
    "ipv4": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![\w/-]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w]|[.-][0-9])"
             r"|(?<!\w)\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w]|[.-][0-9])"
             r"|(?<![\w.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4})(?![\w]|[.-][0-9])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9])",
}
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of the numbers 0 .. size - 1; ``back`` turns it round."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a += 1 if a < 64 else a // 8
    b = -(-size // a)

    def mix(i: int, half: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{size}|{i}|{half}".encode(), key=key, digest_size=16).digest()
        return int.from_bytes(digest, "big")

    while True:
        left, right = divmod(value, b)  # left below a, right below b
        if back:
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - mix(i, left)) % b
                else:
                    left = (left - mix(i, right)) % a
        else:
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + mix(i, left)) % b
                else:
                    left = (left + mix(i, right)) % a
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _characters(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Digits and letters permuted together, each within its own kind; other characters stay."""
    bases = {**{c: ("0", 10) for c in "0123456789"}, **{chr(97 + i): ("a", 26) for i in range(26)},
             **{chr(65 + i): ("A", 26) for i in range(26)}}
    value, size = 0, 1
    shape = []
    for c in text:
        if c in bases:
            first, base = bases[c]
            value, size = value * base + ord(c) - ord(first), size * base
            shape.append(first)
        else:
            shape.append("")
    tweak = f"{tweak}|" + "".join(s or c for s, c in zip(shape, text))
    value = permute(value, size, key, tweak, back)
    out = []
    for first, c in zip(reversed(shape), reversed(text)):
        if first:
            value, digit = divmod(value, 10 if first == "0" else 26)
            c = chr(ord(first) + digit)
        out.append(c)
    return "".join(reversed(out))


def _into(text: str, digits: str, skip: int = 0) -> str:
    """``digits`` in place of the digits of ``text`` after the first ``skip``."""
    it, seen, out = iter(digits), 0, []
    for c in text:
        if c in "0123456789":
            seen += 1
            c = next(it) if seen > skip else c
        out.append(c)
    return "".join(out)


def _date(text: str, key: bytes, back: bool) -> str | None:
    import re

    mark = re.search(r"[^0-9]", text)[0]
    parts = text.split(mark)
    if len(parts[0]) == 4:
        order = "ymd"
    else:  # day first unless only month first can be read
        order = "dmy" if int(parts[1]) <= 12 else "mdy"
    named = dict(zip(order, map(int, parts)))
    try:
        day = date(named["y"], named["m"], named["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None

    def written(ordinal: int) -> str:
        new = date.fromordinal(ordinal)
        values = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(f"{values[o]:0{len(p) if len(p) > 1 or o == 'y' else 2}d}" if padded else str(values[o])
                         for o, p in zip(order, parts))

    # Whether days and months are padded is part of the format: walk on until the pseudonym is written and read alike.
    padded = not any(len(p) == 1 for p in parts)
    while True:
        day = permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, f"date|{order}|{padded}", back) + FIRST_DAY
        new = date.fromordinal(day)
        readable = order != "mdy" or new.day > 12
        if readable and (padded or new.month < 10 or new.day < 10):
            return written(day)


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of one found value, in its format; None if the value is not valid."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "email":
        name, _, top = text.rpartition(".")
        return f"{_characters(name, key, 'email', back)}.{top}"
    if kind == "iban":
        plain = text.replace(" ", "")
        country, body = plain[:2], plain[4:]
        if not 15 <= len(plain) <= 34 or int(plain[2:4]) != iban_check(country, body):
            return None
        body = _characters(body, key, f"iban|{country}", back)
        it = iter(f"{country}{iban_check(country, body):02d}{body}")
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "ipv4":
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        value = permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "ipv4", back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "date":
        return _date(text, key, back)
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rank = permute(rank, 898 * 99 * 9999, key, "ssn", back)
        rank, serial = divmod(rank, 9999)
        area, group = divmod(rank, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        if not 7 <= len(digits) <= 15:
            return None
        keep = 1 if text[0] == "+" else 0
        rest = digits[keep:]
        new = permute(int(rest), 10 ** len(rest), key, f"phone|{digits[:keep]}", back)
        return _into(text, f"{new:0{len(rest)}d}", keep)
    if len(digits) < 13 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    new = permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card", back)
    body = f"{new:0{len(digits) - 1}d}"
    return _into(text, f"{body}{luhn(body)}")


def pseudonymise(text: str, key: bytes, back: bool = False, _compiled: list = []) -> tuple[str, dict[str, int]]:  # noqa: B006
    """The text with every valid value replaced, and the number of values of each kind."""
    import re

    if not _compiled:
        _compiled.append((re.compile(r"[0-9]"), re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in KINDS if k != "email")),
                          {k: re.compile(PATTERNS[k]) for k in KINDS},
                          re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@"), re.compile(r"(?<![\w.+-])[A-Za-z0-9]")))
    digit, others, single, local, first = _compiled[0]
    counts = dict.fromkeys(KINDS, 0)
    if "@" not in text and not digit.search(text):
        return text, counts
    # What stands before an @ is looked at once: searching for addresses from every possible start takes the square of a long token.
    locals_ = [m.span() for m in local.finditer(text)] if "@" in text else []
    next_local, email, out, done, at, m = 0, None, [], 0, 0, others.search(text)
    while True:
        while m and m.start() < at:
            m = others.search(text, at)
        if email and email.start() < at:
            email, next_local = None, next_local - 1  # another start in the same token may follow
        while not email and next_local < len(locals_):
            start, end = locals_[next_local]
            begin = first.search(text, max(start, at), end - 1) if at < end else None
            email = single["email"].match(text, begin.start()) if begin else None
            next_local += 1
        if not m and not email:
            break
        start = min(x.start() for x in (m, email) if x)
        kinds = KINDS if email and email.start() == start else KINDS[KINDS.index(m.lastgroup):]
        for kind in kinds:  # a value that is not valid as one kind may be so as another
            found = single[kind].match(text, start)
            new = pseudonym(kind, found[0], key, back) if found else None
            if new is not None:
                out += [text[done:start], new]
                done = at = found.end()
                counts[kind] += 1
                break
        else:
            at = start + 1
    return "".join([*out, text[done:]]), counts


def pseudonymise_documents(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                           back: bool = False) -> DataFrame:
    """The kept columns, the text with pseudonyms, ``n_values`` and a count for each kind."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key needs 16 to 64 bytes")
    source = docs.select(*keep, docs[text].alias("_text"))
    schema = source.drop("_text").schema.add("text", "string").add("n_values", "integer")
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(None, dict.fromkeys(KINDS, 0)) if t is None else pseudonymise(t, key, back) for t in batch["_text"]]
            batch = batch.drop(columns="_text")
            batch["text"] = [f[0] for f in found]
            batch["n_values"] = [sum(f[1].values()) for f in found]
            for kind in KINDS:
                batch[f"n_{kind}"] = [f[1][kind] for f in found]
            yield batch

    return source.mapInPandas(run, schema)
