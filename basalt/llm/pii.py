"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

The detectors are plain Python ``re`` on whole texts inside an Arrow-fed map: one pass, no shuffle, state of one batch.
A text without '@', digits or '+' skips the detectors that need them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their listed order, and the patterns of the first four.
KINDS = ("email", "ip", "card", "phone", "iban", "imei")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Two letters, two check digits and 11 to 30 characters, in one run or in groups of four.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 "
    "LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}

#: What a confirmed span is worth before its context is read.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.95, "imei": 0.2}
#: Words that raise a span's score when they stand within ``CONTEXT`` characters before it.
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "imei": ("imei", "device", "handset"),
}
#: Words that lower it.
AGAINST = {"ip": ("version", "release", "section", "chapter"), "card": ("isbn", "order", "sku"), "phone": ("isbn", "order")}
CONTEXT = 40
RAISE, LOWER_BY = 0.1, 0.3
#: A span of a kind without a contract of its own is reported from this score on.
LEAST = 0.5

_CONTEXT = {k: re.compile(r"(?<![a-z])(?:" + "|".join(w) + r")(?![a-z])") for k, w in CONTEXT_WORDS.items()}
_AGAINST = {k: re.compile(r"(?<![a-z])(?:" + "|".join(w) + r")(?![a-z])") for k, w in AGAINST.items()}
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]*")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """The Luhn checksum of a string of digits."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def mod97(code: str) -> bool:
    """The ISO 7064 mod-97 check of an IBAN without blanks."""
    turned = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return int(turned) % 97 == 1


def _iban_end(code: str) -> int:
    """Where the IBAN that ``code``, a match of the pattern, begins with ends; 0 if there is none.

    Blank-separated capitals or digits behind an IBAN belong to the match, so its ends at blanks are tried: first that
    of the country's length, then the whole match, then, for a country without a listed length, the others from the longest.
    """
    ends = [i for i in range(len(code), 0, -1) if i == len(code) or code[i] == " "]
    sizes = {i: i - code.count(" ", 0, i) for i in ends}
    own = IBAN_LENGTHS.get(code[:2])
    tried = [i for i in ends if sizes[i] == own] + ends[: len(ends) if own is None else 1]
    return next((i for i in tried if sizes[i] >= 15 and mod97(code[:i].replace(" ", ""))), 0)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := IBAN.search(text, at):
        size = _iban_end(m[0])
        if size:
            yield m.start(), m.start() + size
        at = m.start() + (size or 1)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match lies inside a run of characters that may occur in it, so only runs around an '@' are searched.
    at = text.find("@")
    while at >= 0:
        first = at
        while first > 0 and text[first - 1] in _EMAIL_CHARS:
            first -= 1
        last = _EMAIL_RUN.match(text, at).end()
        for m in EMAIL.finditer(text, first, last):
            yield m.span()
        at = text.find("@", last)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """All confirmed spans of a text as (start, end, kind, score), by start, then kind as listed; ends exclusive."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
                if len(d) == 15:
                    found.append((*m.span(), "imei"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    found += [(a, b, "iban") for a, b in _ibans(text)]
    out = []
    for start, end, kind in found:
        near = text[max(0, start - CONTEXT) : start].lower()
        score = BASE_SCORE[kind] + RAISE * len(set(_CONTEXT[kind].findall(near)))
        if kind == "imei" and _CONTEXT[kind].search(near):
            score += 0.4
        if kind in _AGAINST and _AGAINST[kind].search(near):
            score -= LOWER_BY
        score = min(1.0, max(0.05, score))
        if kind in KINDS[:4] or score >= LEAST:
            out.append((start, end, kind, score))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every whole text: ``doc_id, found`` with ``found`` an array of (start, end, kind, score, value).

    Offsets are code points, ends exclusive.  One row per row of ``docs``; a null text counts as empty and has no spans.
    Repeated rows are scanned and returned each.  Empty input gives an empty result; other columns are ignored.
    """
    id_type = docs.schema[key].dataType
    out = f"doc_id {id_type.simpleString()}, found array<struct<start: bigint, end: bigint, kind: string, score: double, value: string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("value", pa.string())]))

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                rows = []
                for t in texts.slice(at, 256):
                    t = t.as_py() or ""
                    rows.append([{"start": a, "end": b, "kind": k, "score": s, "value": t[a:b]} for a, b, k, s in find_spans(t)])
                yield pa.record_batch([ids.slice(at, 256), pa.array(rows, kind)], names=["doc_id", "found"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, out)


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind, _ in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the four base kinds, a SHA-256 of the base spans, and all spans as text."""
    join = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:4]))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan_pii(docs).select("doc_id", *map(count, KINDS[:4]), F.sha2(join(base), 256).alias("base_sha256"), join("found").alias("spans"), F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("score"))
