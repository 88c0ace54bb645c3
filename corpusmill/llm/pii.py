"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score. DataFrame functions only.

Spans come from the pieces between the matches: the lengths of pieces and matches add up to the offsets. Patterns
never give characters back (possessive), and start only where a run of their first characters starts or the last match
ended, so the time is linear in the length of the text and the matches are those of the plain patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
"""The kinds in the order in which equal starts are listed; the first four are the base kinds. That of ``iban`` matches
country and check digits only; what may belong to it is looked ahead at, as its end is found by the checksum."""
BASE = ("email", "ip", "card", "phone")
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
_CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|credit|visa|payment|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|taxpayer",
}
_IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
"""Countries by the length of their account numbers, as registered under ISO 13616."""
NEAR = 40
"""Characters before a span in which its context words count."""
LEAST = 0.5
"""Spans of kinds beyond the base are listed from this score on."""


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of ``start, order, kind, end, score`` by start, then kind as listed.

    Offsets are code points, the end is exclusive. Base kinds are leftmost, non-overlapping matches of their pattern
    that pass its check: parts of an ``ip`` up to 255, ``card`` 14 to 19 digits with a right Luhn sum, ``phone`` 10 to
    15 digits; failing ones are dropped without another try. ``iban`` is 15 to 34 characters with a sum modulo 97 of 1 up
    to a word's end, of its country's length if that fits, else as long as possible. It and ``ssn`` need a score of
    ``LEAST``, which context words raise. A null or empty text has no spans. All other columns stay; a column that is
    called ``pii`` is replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found = [_spans(value, kind, order) for order, kind in enumerate(PATTERNS)]
    return docs.withColumn("pii", F.array_sort(F.concat(*found)))


def _spans(text: Column, kind: str, order: int) -> Column:
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,score:double>>")
    pattern, hint = PATTERNS[kind], _HINT[kind]
    may = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]{2}" if kind == "iban" else "[0-9]")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,match:string,before:string,tail:string>>")
    step = lambda a, x: F.struct(
        (a["at"] + F.char_length(x["piece"]) + F.char_length(x["match"])).alias("at"),
        F.concat(
            a["out"],
            F.array(F.struct((a["at"] + F.char_length(x["piece"])).alias("start"), x["match"].alias("match"), F.right(x["piece"], F.lit(NEAR)).alias("before"), x["tail"].alias("tail"))),
        ).alias("out"),
    )
    tails = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "iban" else matches
    zipped = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), tails.alias("tail"))
    zipped = F.filter(zipped, lambda x: x["match"].isNotNull())  # the last piece has none
    placed = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    score = lambda x: F.least(F.lit(1.0), F.lit(_PRIOR[kind]) + F.when(F.lower(x["before"]).rlike(_CONTEXT[kind]), F.lit(0.3)).otherwise(F.lit(0.0)))
    ok = _ibans(placed) if kind == "iban" else F.filter(placed, lambda x: _valid(kind, x["match"]))
    spans = F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (x["start"] + F.char_length(x["match"])).alias("end"), score(x).alias("score")))
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST)
    return F.when(may, spans).otherwise(none)


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(match, r"\."), lambda p: part(p) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.char_length(digits).between(14, 19) & (_luhn(digits) % 10 == 0)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def _ibans(placed: Column) -> Column:
    """Account numbers at the proposed starts; a start inside an account number is none.

    Of the ends at a word's end where the checksum is right it is the one at the country's length, or else the last.
    """
    compact = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    ends = lambda words: F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    right = lambda s: ~s.rlike("[a-z]") & F.when(F.char_length(compact(s)).between(15, 34), _mod97(compact(s)) == 1).otherwise(F.lit(False))
    found = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.filter(ends(F.split(F.concat(x["match"], x["tail"]), " ")), right).alias("ends"), x["before"].alias("before")))
    found = F.filter(found, lambda x: F.size(x["ends"]) > 0)
    size = lambda s: F.coalesce(*(F.when(F.left(s, F.lit(2)).isin(names.split()), F.lit(n)) for n, names in _IBAN_LENGTH.items()))
    best = lambda x: F.coalesce(F.get(F.filter(x["ends"], lambda s: F.char_length(compact(s)) == size(s)), F.lit(0)), F.get(x["ends"], F.size(x["ends"]) - 1))
    named = F.transform(found, lambda x: F.struct(x["start"].alias("start"), best(x).alias("match"), x["before"].alias("before")))
    empty = F.array().cast("array<struct<start:int,match:string,before:string>>")
    step = lambda a, x: F.struct((x["start"] + F.char_length(x["match"])).alias("end"), F.concat(a["out"], F.array(x)).alias("out"))
    return F.aggregate(named, F.struct(F.lit(0).alias("end"), empty.alias("out")), lambda a, x: F.when(x["start"] >= a["end"], step(a, x)).otherwise(a), lambda a: a["out"])


def _luhn(digits: Column) -> Column:
    """From the right, every second digit counts double, less 9 if that is above 9."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    last = F.char_length(digits)
    values = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0)).alias("d"), ((last - i) % 2).alias("odd")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x["odd"] == 1, doubled(x["d"])).otherwise(x["d"]))


def _mod97(code: Column) -> Column:
    """The first four characters go last, letters count from A = 10, and the number is taken modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.char_length(code)), F.substring(code, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
