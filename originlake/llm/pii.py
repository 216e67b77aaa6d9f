"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

Four kinds always stand when their pattern and check hold (email, ip, card,
phone). Further kinds (iban, ssn, local phone numbers) stand when their score,
raised by whole context words nearby, reaches the threshold; an account number
whose groups are set apart as printed needs none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ["email", "ip", "card", "phone"]
MORE = ["iban", "ssn", "tel"]
KINDS = [*BASE, *MORE]
THRESHOLD = 0.5
NEAR = 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")

def _words(text: str) -> re.Pattern:
    """Any of the words, standing by itself, in any case; a plural's s may follow."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(text.split(', '))})s?(?!\w)", re.I)


#: Words that raise a kind's score when they stand within NEAR characters.
CONTEXT = {
    "iban": _words("iban, account, bank account, konto, kontonummer, compte, cuenta, bank, transfer"),
    "ssn": _words("ssn, social security, social security number, tax ?id, taxpayer"),
    "tel": _words("tel, telephone, phone, call, fax, mobile, cell, telefon, téléphone, teléfono"),
    "email": _words("mail, e-?mail, contact, kontakt, correo, courriel"),
    "ip": _words("ip, address, server, host, client, login"),
    "card": _words("card, visa, mastercard, master, credit, karte, kreditkarte, carte, tarjeta"),
    "phone": _words("tel, telephone, phone, call, fax, mobile, telefon, téléphone, teléfono"),
}
#: Score before context: what pattern and validator alone are worth.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.4, "ssn": 0.35, "tel": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def mod97(text: str) -> bool:
    """The check of account numbers: the country's length; its letters and check digits last, letters as 10 to 35, remainder 1."""
    s = text.replace(" ", "")
    return IBAN_LENGTHS.get(s[:2]) == len(s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(t: str) -> Iterator[tuple[int, int]]:
    at, free = t.find("@"), 0
    while at >= 0:
        a = at
        while a > free and (t[a - 1].isascii() and (t[a - 1].isalnum() or t[a - 1] in "._%+-")):
            a -= 1
        if a < at and (m := _DOMAIN.match(t, at + 1)):
            yield a, m.end()
            free = m.end()
        at = t.find("@", max(at + 1, free))


def _ibans(t: str) -> Iterator[tuple[int, int]]:
    """Longest first, as capitals and numbers that follow may look like further groups."""
    m = _IBAN.search(t)
    while m:
        a, b = m.span()
        ends = (b, *(i for i in range(b - 1, a, -1) if t[i] == " "))
        b = next((i for i in ends if mod97(t[a:i])), None)
        if b is not None:
            yield a, b
        m = _IBAN.search(t, b or a + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _proposed(t: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(t):
        yield "email", a, b
    if not _DIGIT.search(t):
        return
    for m in _IP.finditer(t):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()
    for a, b in _ibans(t):
        yield "iban", a, b
    for m in _SSN.finditer(t):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    for m in _TEL.finditer(t):
        yield "tel", *m.span()


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, ends exclusive, by kind and start. Null text has none."""
    out = []
    taken: list[tuple[int, int]] = []
    for kind, a, b in _proposed(text or ""):
        near = CONTEXT[kind].search(text[max(0, a - NEAR) : a]) or CONTEXT[kind].search(text[b : b + NEAR])
        score = min(1.0, PRIOR[kind] + (0.3 if near else 0.0) + (0.2 if kind == "iban" and " " in text[a:b] else 0.0))
        if kind in BASE:
            taken.append((a, b))
        elif score < THRESHOLD or any(a < y and x < b for x, y in taken):
            continue
        out.append((kind, a, b, score))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, score) of every row's whole text.

    Empty and null texts have an empty array; repeated rows repeat; other columns are ignored. Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                [{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in spans(t.as_py())] for t in b.column(1)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def joined(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def pii_digest(docs: DataFrame, **columns) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    top = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score")
    return find_pii(docs, **columns).select(
        "doc_id", *n[:4], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *n[4:], top
    )


def redacted(text: str | None) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its first kind's mark such as [EMAIL]."""
    if text is None:
        return None
    out, at, open_to = [], 0, -1
    for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a < open_to:
            open_to = max(open_to, b)
            at = max(at, open_to)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = open_to = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with personal data replaced by marks; all rows and columns stay, ``n_chars`` is renewed if there."""
    i = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(i, text_col, pa.array([redacted(t.as_py()) for t in b.column(i)], pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
