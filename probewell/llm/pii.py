"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

A span's score is the prior of its kind, plus what its checksum and the words around it add or take. The four base kinds
start at the threshold or above and nothing can take them below it, so every base span stays; the further kinds need a
checksum or a word of context.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.5
#: Score without any evidence, and with a passed checksum.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_CHARS = 40
#: Words that speak for a kind, and words that speak against any kind. Lower case, looked up in the text around a span.
CONTEXT = {
    "email": {"email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"},
    "ip": {"ip", "host", "server", "address", "adresse", "login"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "tarjeta", "carte", "karte", "kreditkarte"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"},
    "iban": {"iban", "bank", "account", "konto", "cuenta", "compte", "swift", "bic"},
    "ssn": {"ssn", "social", "security"},
}
AGAINST = {"example", "version", "isbn", "order", "part", "serial"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run without the dots can't match from inside either, so only its start is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ENDS_INSIDE = re.compile(r"[A-Za-z0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORDS = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every e-mail match has just one @, so each @ is looked at once, with the run of local characters before it."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start of a country, the longest run up to the end of a word that passes mod 97; what follows it may look like more."""
    at = 0
    while m := IBAN.search(text, at):
        start, end = m.span()
        at = start + 1
        while end > start:
            if not ENDS_INSIDE.match(text, end) and 15 <= len(c := text[start:end].replace(" ", "")) <= 34 and mod97(c):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)


def _ip(s: str) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or "0") < 256 for x in s.split("."))


def _digits(least: int, most: int, check=None):
    def passes(s: str) -> bool:
        d = NOT_DIGIT.sub("", s)
        return least <= len(d) <= most and (check is None or check(d))

    return passes


#: Kind, pattern, validator.
RULES = (
    ("ip", IP, _ip),
    ("card", CARD, _digits(14, 19, luhn)),
    ("phone", PHONE, _digits(10, 15)),
    ("ssn", SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
)


def score(kind: str, text: str, start: int, end: int) -> float:
    """Prior of the kind, plus 0.3 for a supporting word close by, less 0.2 for a contrary one."""
    around = set(WORDS.findall((text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()))
    s = PRIOR[kind] + 0.3 * bool(around & CONTEXT[kind]) - 0.2 * bool(around & AGAINST)
    return min(1.0, max(s, THRESHOLD if kind in BASE else 0.0))


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, end, index of the kind, score) in order of start, then kind. Leftmost and non-overlapping within a kind."""
    if not text:
        return []
    found = [(s, e, 0, score("email", text, s, e)) for s, e in emails(text)] if "@" in text else []
    found += [(s, e, KINDS.index("iban"), score("iban", text, s, e)) for s, e in ibans(text)]
    for kind, pattern, valid in RULES:
        for m in pattern.finditer(text):
            if valid(m.group()) and (p := score(kind, text, m.start(), m.end())) >= THRESHOLD:
                found.append((m.start(), m.end(), KINDS.index(kind), p))
    found.sort()
    return sorted(found, key=lambda x: (x[0], x[2]))


def mask(text: str, found: list[tuple[int, int, int, float]]) -> str:
    """text with each maximal run of overlapping spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for start, end, kind, _ in found:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _spans(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in found)


def detect(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, a count for each base kind, base_sha256, spans, n_spans, max_score.

    Null and empty texts have no spans: counts 0, the digest of the empty string, max_score null. Repeated rows and null
    ids are kept as they are. Whole texts are searched; offsets are code points.
    """

    def run(batches):
        for b in batches:
            all_found = [find(t) for t in b["text"]]
            base = [[x for x in f if x[2] < len(BASE)] for f in all_found]
            out = pd.DataFrame({"doc_id": b["doc_id"]})
            for i, k in enumerate(BASE):
                out[f"n_{k}"] = [sum(x[2] == i for x in f) for f in base]
            out["base_sha256"] = [hashlib.sha256(_spans(f).encode()).hexdigest() for f in base]
            out["spans"] = [_spans(f) for f in all_found]
            out["n_spans"] = [len(f) for f in all_found]
            out["max_score"] = [max((x[3] for x in f), default=None) for f in all_found]
            yield out

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {ids}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long, max_score double")


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; the other columns stay, n_chars follows the new text. Null text stays null."""

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not (f := find(t)) else mask(t, f) for t in text], dtype=object)

    out = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
