"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

The four base kinds (email, ip, card, phone) are always reported when pattern and check hold. The further kinds (iban, ssn, birth_date,
tagged number) need a score of `THRESHOLD`: the kind's prior, plus its checksum, plus or minus context words within
`CONTEXT` characters before the span. Every text is read whole, in one pass of a map task without any shuffle; patterns are
anchored so that long runs of digits or letters cost linear time.

Null text counts as empty. Rows are answered one by one, so ties, repeated rows, null ids and extra columns need no rule.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "birth_date", "id_number")
BASE = KINDS[:4]
THRESHOLD = 0.6
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_DIGIT = re.compile("[0-9]")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9+.-])[0-9]{6,12}(?![0-9A-Za-z-])")

#: Prior of a kind, context words that raise it, context words that lower it (lower case, whole words).
SCORES = {
    "iban": (0.5, ("iban", "konto", "bank", "account", "cuenta", "compte"), ("example", "sample", "ref", "order")),
    "ssn": (0.5, ("ssn", "social", "security"), ("example", "sample", "isbn", "order", "part")),
    "birth_date": (0.1, ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "naissance", "nacimiento", "nacido"), ("published", "updated", "version", "copyright")),
    "id_number": (0.1, ("passport", "passeport", "reisepass", "pasaporte", "dni", "ausweis", "license", "licence"), ("page", "order", "version", "isbn")),
}
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: country and check digits moved to the end, letters as 10..35, remainder 1."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, last = [], 0
    for match in _DOMAIN.finditer(text):
        start = at = match.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = match.end()
            found.append((start, last))
    return found


def _valid_date(text: str) -> bool:
    parts = [int(x) for x in re.split(r"[./-]", text)]
    year, month, day = parts if parts[0] > 31 else parts[::-1]
    return 1900 <= year <= 2030 and 1 <= day <= 31 and (1 <= month <= 12 or (1 <= day <= 12 and month <= 31))


def _score(kind: str, text: str, start: int, confirmed: bool) -> float:
    prior, near, far = SCORES[kind]
    words = {w.lower() for w in _WORD.findall(text, max(0, start - CONTEXT), start)}
    return prior + 0.4 * confirmed + 0.3 * any(w in words for w in near) - 0.4 * any(w in words for w in far)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and then kind; base kinds have score 1."""
    text = text or ""
    found: list[tuple[str, int, int, float]] = []
    if "@" in text:
        found += [("email", s, e, 1.0) for s, e in _emails(text)]
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end(), 1.0))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                found.append(("ip", m.start(), m.end(), 1.0))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end(), 1.0))
        held = [(s, e) for _, s, e, _ in found]
        for kind, pattern, check in (("iban", _IBAN, mod97), ("ssn", _SSN, lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"), ("birth_date", _DATE, _valid_date), ("id_number", _NUMBER, lambda x: False)):
            for m in pattern.finditer(text):
                confirmed = check(m[0])
                if kind in ("iban", "ssn", "birth_date") and not confirmed:
                    continue
                score = _score(kind, text, m.start(), confirmed)
                if score + (0.3 if kind == "id_number" else 0) >= THRESHOLD and not any(s < m.end() and m.start() < e for s, e in held):
                    found.append((kind, m.start(), m.end(), round(score, 2)))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def mask(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


_REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long"


def _report(batches):
    for batch in batches:
        columns: dict[str, list] = {name.split()[0]: [] for name in _REPORT.split(", ")}
        columns["doc_id"] = batch.column(0)
        for text in batch.column(1):
            spans = find_spans(text.as_py())
            base = [s for s in spans if s[0] in BASE]
            for kind in BASE:
                columns[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            columns["spans"].append(joined(spans))
            columns["n_other"].append(len(spans) - len(base))
        types = {"base_sha256": pa.string(), "spans": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) if k != "doc_id" else v for k, v in columns.items()], names=list(columns))


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts of the base kinds, digest of the base spans, all spans."""
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return docs.mapInArrow(_report, _REPORT)


def _masked(batches):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [mask(text, find_spans(text)) for text in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def mask_pii(docs: DataFrame) -> DataFrame:
    """`docs` with the same columns and rows, the spans in `text` replaced by their kinds; null stays null."""
    return docs.mapInArrow(_masked, docs.schema)
