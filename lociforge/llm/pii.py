"""Personal data, found with DataFrame functions only.

Regular expressions propose spans, validators confirm them (value ranges for addresses,
Luhn for cards, digit counts for phones, mod-97 for account numbers), and context words
just before a span raise its score. Spans of the base kinds that pass their validator
always stay; the kinds that the method adds (iban, ssn) need a score of ``threshold``.

The patterns match as the plain ones in ``PLAIN``: a possessive loop stands where nothing
after it could take back what it has read, and a look-behind where a match that begins
inside a run of the same characters can't succeed if the run's first character failed. So
they need no deep recursion and no quadratic time on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds as they are specified, for tests and readers.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PLAIN)
KINDS = (*BASE, "iban", "ssn")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without a match of this has none of the kind; cheaper than the pattern itself.
HINTS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}+",
    "phone": "+",
    "iban": r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Words that raise the score of a span that follows them closely.
CONTEXT = {
    "email": "mail|contact|write|courriel|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
_CONTEXT_SCORE, _CONTEXT_CHARS = 0.3, 40
#: Lengths that are summed at once, and levels of such sums: 64 ** 4 matches of a text cost a few dozen additions each.
_BLOCK, _DEPTH = 64, 3


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _places(gaps: Column, found: Column) -> Column:
    """Start and text of each match, from the texts between the matches and the matches.

    Running sums without a fold that copies a growing array for each match: sums of blocks, of blocks of blocks
    and so on are each summed from the level above, so a match costs a few additions of _BLOCK numbers at most.
    """
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    block = lambda i: F.floor(i / _BLOCK).cast("int")

    def before(xs: Column, depth: int, use) -> Column:
        """use(f) where f(i) is the sum of the first i of xs."""

        def near(i: Column) -> Column:
            return total(F.slice(xs, block(i) * _BLOCK + 1, (i % _BLOCK).cast("int")))

        if not depth:
            return use(lambda i: total(F.slice(xs, 1, i)))
        sums = F.transform(F.sequence(F.lit(0), block(F.size(xs))), lambda k: total(F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK))))
        return _let(sums, lambda own: before(own, depth - 1, lambda f: use(lambda i: f(block(i)) + near(i))))

    def starts(f) -> Column:
        return F.transform(found, lambda m, i: F.struct((f(i) + F.length(F.get(gaps, i))).cast("int").alias("start"), m.alias("match")))

    return _let(steps, lambda s: before(s, _DEPTH, starts))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return _let(F.regexp_replace(m, " ", ""), lambda x: F.length(x).between(15, 34) & (_mod_97(x) == 1))
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("0000$")
    return F.lit(True)


def _mod_97(x: Column) -> Column:
    """The remainder of an account number: first four characters moved to the end, letters from 10 on."""
    turned = F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def _spans(kind: str, text: Column, threshold: float) -> Column:
    hint = text.contains(HINTS[kind]) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
    rank = KINDS.index(kind)

    def scored(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(x.start - _CONTEXT_CHARS, F.lit(0)) + 1, F.least(x.start, F.lit(_CONTEXT_CHARS))))
        return F.struct(
            x.start.alias("start"), F.lit(rank).alias("rank"), (x.start + F.length(x.match)).alias("end"),
            F.lit(kind).alias("kind"),
            (F.lit(SCORES[kind]) + F.when(before.rlike(CONTEXT[kind]), _CONTEXT_SCORE).otherwise(0.0)).alias("score"),
        )

    both = F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"))
    found = _let(both, lambda b: F.transform(F.filter(_places(b.gaps, b.found), lambda x: _valid(kind, x.match)), scored))
    if kind not in BASE:
        found = F.filter(found, lambda x: x.score >= threshold)
    return F.when(hint, found).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>"))


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii", threshold: float = 0.6) -> DataFrame:
    """docs with an array of struct(start, rank, end, kind, score), by start, then kind as in KINDS.

    Places are code points, the end exclusive. Null and empty texts have no spans; a column
    of docs named as ``into`` is replaced; rows are judged one by one, so repeated rows and
    empty tables need no care.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(into, F.array_sort(F.concat(*[_spans(k, whole, threshold) for k in KINDS])))


def masked(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """docs with each span of text, or of overlapping spans the first, replaced by its kind in brackets.

    A span that begins inside an earlier one only lengthens what is cut out.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(whole, a["at"] + 1, s.start - a["at"])
        mark = F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))
        return F.struct(
            F.greatest(a["at"], s.end).alias("at"),
            F.when(s.start < a["at"], a.parts).otherwise(F.concat(a.parts, F.array(between, mark))).alias("parts"),
        )

    def end(a: Column) -> Column:
        return F.concat(F.array_join(a.parts, ""), F.substring(whole, a["at"] + 1, F.length(whole)))

    return docs.withColumn(text, F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, step, end)).otherwise(F.col(text)))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def pii_table(docs: DataFrame) -> DataFrame:
    """One row per document: spans of each base kind counted, and all spans as text."""
    rows = with_spans(docs.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"))
