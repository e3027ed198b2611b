"""Personal data: patterns propose spans, check digits confirm them, nearby words adjust the score.

DataFrame functions only; no shuffle.  Every pattern is linear in the text: runs
are taken whole (possessive), and a match starts only at the start of a run or
where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import spans as S
from nearfield.llm.common import without

KINDS = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "local")

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9(.+-])(?:\([0-9]{3}\)\x20|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"

#: Words near a span that speak for its kind.  Fixed values.
CONTEXT = {
    "email": "mail|contact|write to|reach",
    "ip": "address|host|server|login",
    "card": "card|visa|master|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax id",
    "local": "phone|tel|call|mobile|fax",
}
#: Score without context, and what a context word adds.  An added kind counts from 0.6 on.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.7, 0.3), "iban": (0.9, 0.1), "ssn": (0.3, 0.5), "local": (0.3, 0.4)}
LEAST = 0.6
NEAR = 40


def _score(kind: str, parts: Column):
    """The score of a span of ``kind``, which context words raise; parts: the text in blocks."""
    base, more = SCORES[kind]

    def of(s: Column) -> Column:
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        around = F.lower(F.concat(S.cut(parts, begin, s["start"] - begin), F.lit(" "), S.cut(parts, s["end"], F.lit(NEAR))))
        return F.lit(base) + F.when(around.rlike(CONTEXT[kind]), more).otherwise(0.0)

    return of


def pii_spans(text: Column) -> Column:
    """All spans that the patterns and check digits leave: (start, rank, end, kind, value, score), kind by kind."""
    n = lambda v: F.char_length(S.digits(v))
    found = {
        "email": F.when(F.contains(text, F.lit("@")), S.matches(text, EMAIL, lambda v: F.lit(True))),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), S.matches(text, IP, lambda v: v.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"))),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), S.matches(text, CARD, lambda v: n(v).between(12, 19) & F.when(n(v).between(12, 19), S.luhn(v)).otherwise(False))),
        "phone": F.when(F.contains(text, F.lit("+")), S.matches(text, PHONE, lambda v: n(v).between(9, 15))),
        "iban": F.when(text.rlike(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}"), S.matches(text, IBAN, S.mod97)),
        "ssn": F.when(text.rlike(SSN), S.matches(text, SSN, lambda v: F.lit(True))),
        "local": F.when(text.rlike(LOCAL), S.matches(text, LOCAL, lambda v: F.lit(True))),
    }
    proposed = F.struct(*(F.coalesce(c, S.none()).alias(k) for k, c in found.items()))
    scored = lambda own, parts: F.concat(*(S.named(own[k], k, i, _score(k, parts)) for i, k in enumerate((*KINDS, *MORE))))
    some = lambda own: sum((F.size(own[k]) for k in found), F.lit(0)) > 0
    return S.bound(proposed, lambda own: F.when(some(own), S.bound(S.blocks(text), lambda parts: scored(own, parts))).otherwise(F.array().cast(S.NAMED)))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with base and spans: arrays of (start, rank, end, kind, value, score), sorted by start, then kind.

    docs has a string column ``text``; columns of those names are replaced.  base holds
    email, ip, card and phone; spans adds account numbers that pass mod-97, and
    identity and local phone numbers that context words confirm, where they
    overlap no base span.  A null or empty text has none; the work on a very
    long one grows with its length, and little faster with its matches.  Rows
    and other columns stay; repeated rows are treated alike; an empty table
    gives no rows.
    """
    docs = without(docs, "base", "spans")
    out = docs.withColumn("spans", pii_spans(F.coalesce(F.col("text"), F.lit(""))))
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    more = F.filter("spans", lambda s: (s["rank"] >= len(KINDS)) & (s["score"] >= LEAST))
    out = out.withColumns({"base": base, "spans": more})
    return out.withColumns({"base": F.array_sort("base"), "spans": F.array_sort(F.concat("base", S.clear_of(F.col("spans"), F.col("base"))))})
