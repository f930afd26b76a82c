"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Kinds email, ip, card and phone are the base: every proposal that passes its kind's check is reported,
whatever its score. Kinds iban and ssn are added by the method: an iban needs the mod-97 check, an ssn
needs valid number groups and, through its score, a context word nearby.

Null and empty texts have no spans. Rows are judged one by one, so repeated rows give repeated results,
and extra columns of the input are not looked at. An empty table gives no rows. Texts of any length are read whole, in one task each.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: What a confirmed proposal scores before its neighbourhood is read, and words that raise or lower that.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "mastercard", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = ("version", "isbn", "order", "serial", "example", "test")
WINDOW, STEP, LEAST = 60, 0.3, 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of ten."""
    return sum(_DOUBLED[int(c)] if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number passes the mod-97 check once its first four characters are moved behind."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost, non-overlapping. Found from their @, as a scan from every possible start is quadratic in a long word."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def confirmed(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end) of every proposal that passes its kind's check, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    found += [(m.start(), 4, m.end()) for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
    found += [(m.start(), 5, m.end()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    return sorted(found)


def context_score(text: str, start: int, kind: str, end: int) -> float:
    """The kind's prior, raised by a word that goes with it nearby and lowered by one that speaks against it."""
    around = {*_WORD.findall(text[max(0, start - WINDOW) : start].lower()), *_WORD.findall(text[end : end + WINDOW].lower())}
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * (not around.isdisjoint(NEAR[kind])) - STEP * (not around.isdisjoint(AGAINST)))), 3)


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text's spans by start, then kind; code points, end exclusive."""
    if not text:
        return []
    spans = ((KINDS[k], s, e, context_score(text, s, KINDS[k], e)) for s, k, e in confirmed(text))
    return [x for x in spans if x[0] in BASE_KINDS or x[3] >= LEAST]


def spans(text: Column) -> Column:
    """Array of a text's spans (kind, start, end, score)."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in scan(t)] for t in texts], dtype=object)

    return found(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; null stays null. Of overlapping spans the first stays."""

    @F.pandas_udf("string")
    def blank(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for kind, s, e, _ in scan(t):
                if s >= at:
                    out += [t[at:s], f"[{kind}]"]
                    at = e
            return "".join(out) + t[at:]

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn(text, blank(F.col(text)))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: counts by base kind, the digest of the base spans, and all spans as text."""

    @F.pandas_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,max_score:double>")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = scan(t)
            base = [x for x in found if x[0] in BASE_KINDS]
            line = lambda some: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in some)
            kinds = [x[0] for x in base]
            rows.append((*map(kinds.count, BASE_KINDS), hashlib.sha256(line(base).encode()).hexdigest(), line(found), max((x[3] for x in found), default=0.0)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "max_score"])

    return docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("r")).select("doc_id", "r.*")
