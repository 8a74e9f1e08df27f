"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby
adjust their scores."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import claim, slices

#: Kinds in the order that spans with one start are listed in. The first four are always kept.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "key", "tel"]
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: Lengths of IBANs by country, of the registry.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_KEY = re.compile(r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])")
#: Numbers without a country's code: too weak without words nearby that speak of a call.
_TEL = re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Score without context, words that raise it and words that lower it.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "key": 0.9, "tel": 0.3}
RAISING = {
    "email": "mail e-mail email contact write",
    "ip": "ip address host server login",
    "card": "card visa mastercard amex credit debit payment",
    "phone": "phone call tel mobile fax telephone",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
    "key": "key secret access aws",
    "tel": "phone call tel mobile fax telephone",
}
LOWERING = {"ip": "version release build", "card": "order invoice serial isbn", "phone": "order invoice serial", "iban": "example sample", "ssn": "part serial model", "key": "example sample", "tel": "order invoice serial part"}
#: Characters looked at on each side, what a word adds or takes, and the least score of the
#: kinds beyond the first four.
CONTEXT, STEP, LEAST = 40, 0.2, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(text: str) -> bool:
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _iban_end(text: str, start: int) -> int | None:
    """Where the IBAN at ``start`` ends: after its country's number of characters or, for a
    country that is not in the table, after the first group from the 15th that mod-97 confirms.
    Single spaces stand between groups of four only, and no letter or digit follows."""
    want, said, at = IBAN_LENGTHS.get(text[start : start + 2]), "", start
    while at < len(text) and len(said) < (want or 34):
        if text[at] == " " and len(said) % 4 == 0:
            at += 1
        c = text[at : at + 1]
        if not ("A" <= c <= "Z" or "0" <= c <= "9"):
            return None
        said += c
        at += 1
        if len(said) == want or not want and len(said) >= 15:
            if not (text[at : at + 1].isascii() and text[at : at + 1].isalnum()) and mod97(said):
                return at
    return None


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @: what stands before it is the
    longest run of local characters, so no start is tried twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, not yet scored."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    numbers = []
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
            numbers.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
                numbers.append(m.span())
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() >= done and (end := _iban_end(text, m.start())):
            yield "iban", m.start(), end
            done = end
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    numbers.sort()
    for m in _TEL.finditer(text):
        k = bisect_right(numbers, m.start(), key=lambda span: span[0])  # a phone inside a card's span may end first
        if all(end <= m.start() for _, end in numbers[max(0, k - 2) : k]):
            yield "tel", *m.span()
    if "AKIA" in text:
        for m in _KEY.finditer(text):
            yield "key", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower())
    up = bool(set(RAISING[kind].split()) & set(near))
    down = bool(set(LOWERING.get(kind, "").split()) & set(near))
    return round(min(1.0, max(0.0, SCORES[kind] + STEP * (up - down))), 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start and kind; code points, end exclusive."""
    found = [(k, s, e, score(text, k, s, e)) for k, s, e in proposals(text or "")]
    return sorted((x for x in found if x[0] in BASE or x[3] >= LEAST), key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(__name__)
    for batch in slices(batches):
        spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of every row's whole text.

    A null or empty text has none. Spans of one kind never overlap; those of several may.
    Rows are independent of each other; other columns are not read.
    """
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def redact(text: str | None) -> str | None:
    """The text with each span, or group of overlapping spans, replaced by its kind in capitals."""
    if text is None:
        return None
    out, done = [], 0
    for kind, start, end, _ in find_spans(text):
        if start < done:
            if end > done:
                done = end
            continue
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join(out) + text[done:]


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced; ``n_chars``, where there is one,
    counts the new text. A null text stays null; all other columns pass unchanged."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in slices(batches):
            texts = pa.array([redact(t.as_py()) for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(documents.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in documents.columns else out


def personal_data_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores: :func:`personal_data`
    with spans written ``kind:start:end`` and joined by commas, and so their scores."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    counts = [F.size(F.filter(F.col("spans.kind"), lambda x: x == kind)).cast("long").alias(f"n_{kind}") for kind in BASE]  # noqa: B023  called at once
    return personal_data(documents).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), F.array_join("spans.score", ",").alias("scores"))
