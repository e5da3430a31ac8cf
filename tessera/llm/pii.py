"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Native: the spans, their places, checksums and scores are column expressions.

Base kinds are email, ip, card and phone; a base span that its validator confirms always stays. Further kinds are
iban (confirmed by the remainder mod 97) and, where a telling word stands within CONTEXT characters before, national
phone numbers (`local`), identity numbers (`ssn`) and access keys (`secret`, confirmed by holding letters and many digits). A span scores by its kind, plus BONUS for a telling word; one
of a further kind stays if it reaches ACCEPT and overlaps no base span.

Patterns never backtrack into a run they have read, so a text of any length is scanned in linear time; they find what
the plain patterns in the docstring of base_patterns find. Places are prefix sums over the text's pieces between
matches, taken block by block (a block is the square root of the number of matches).

Defined cases: a null text counts as empty; places count code points; repeated rows are treated alike; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

CONTEXT, ACCEPT, BONUS = 40, 0.5, 0.3
ORDER = ("email", "ip", "card", "phone", "iban", "local", "ssn", "secret")
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "local": 0.3, "ssn": 0.3, "secret": 0.3}
TELLING = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank|konto",
    "local": "phone|call|tel|fax|mobile",
    "ssn": "ssn|social|security|identity",
    "secret": "token|secret|passw|credential|api|key",
}


def base_patterns() -> dict[str, str]:
    r"""The base patterns with possessive runs.

    email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
    card [0-9]([\x20-]?[0-9])+, phone \+[0-9][\x20().0-9-]+[0-9]. A run that is not preceded by its own
    characters starts where the leftmost match does; \G allows one right after the match before.
    """
    return {
        "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }


FURTHER = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: A character that a text with a span of the kind must have.
_NEEDS = {"email": "@", "phone": "+"}


def _sums(sizes: str) -> str:
    """SQL: the sums of the elements before each element of an array, in blocks."""
    block = f"cast(ceil(sqrt(size({sizes}))) as int)"
    totals = f"transform(sequence(0, size({sizes}) - 1, {block}), k -> aggregate(slice({sizes}, k + 1, {block}), 0, (a, x) -> a + x))"
    starts = f"transform(sequence(0, size({sizes}) - 1, {block}), (k, b) -> aggregate(slice(t, 1, b), 0, (a, x) -> a + x))"
    inner = f"transform(sequence(0, size({sizes}) - 1), i -> s[int(i div {block})] + aggregate(slice({sizes}, int(i div {block}) * {block} + 1, i % {block}), 0, (a, x) -> a + x))"
    return f"transform(array({totals}), t -> transform(array({starts}), s -> {inner})[0])[0]"


def _found(kind: str, pattern: str) -> str:
    """SQL: array<struct<start, end, m, near>> of the matches of a pattern in `text`; near: the CONTEXT characters before."""
    lit = "r'" + pattern.replace("'", "''") + "'"
    gate = f"contains(text, '{_NEEDS[kind]}')" if kind in _NEEDS else "digits"
    matches, gaps = f"regexp_extract_all(text, {lit}, 0)", f"split(text, {lit}, -1)"
    places = _sums("z")
    sizes = "transform(m, (x, i) -> length(g[i]) + length(x))"
    # A match has one character at least, so the CONTEXT pieces before hold the context.
    pieces = f"array_join(transform(sequence(greatest(0, i - {CONTEXT}), i - 1), j -> concat(right(g[j], {CONTEXT}), right(m[j], {CONTEXT}))), '')"
    near = f"lower(right(if(i = 0 or length(g[i]) >= {CONTEXT}, g[i], concat({pieces}, g[i])), {CONTEXT}))"
    body = f"transform(array({sizes}), z -> transform(array({places}), p -> transform(m, (x, i) -> named_struct('start', p[i] + length(g[i]), 'end', p[i] + length(g[i]) + length(x), 'm', x, 'near', {near})))[0])[0]"
    none = "cast(array() as array<struct<start: int, end: int, m: string, near: string>>)"
    whole = f"transform(array({matches}), m -> if(size(m) = 0, {none}, transform(array({gaps}), g -> {body})[0]))[0]"
    return f"if({gate}, {whole}, {none})"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
#: Doubling every second digit from the right and adding the digits of each, the sum ends in 0.
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0L, (a, i) -> a + transform(array(int(substring({_DIGITS}, -i, 1)) * (1 + (i + 1) % 2)), v -> v div 10 + v % 10)[0]) % 10 = 0"
)
#: The first four characters moved to the end, letters as 10 to 35, remainder 1 mod 97.
_MOD97 = (
    "transform(array(upper(replace(x.m, ' ', ''))), w -> aggregate(sequence(1, length(w)), 0, (a, i) -> transform(array(ascii(substring(w, 1 + (i + 3) % length(w), 1))), "
    "c -> if(c < 58, (a * 10 + c - 48) % 97, (a * 100 + c - 55) % 97))[0]) = 1 and length(w) between 15 and 34)[0]"
)
CONFIRM = {
    "ip": r"forall(split(x.m, '[.]'), v -> length(ltrim('0', v)) <= 3 and int(concat('0', ltrim('0', v))) <= 255)",
    "card": f"length({_DIGITS}) between 12 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "iban": _MOD97,
    "secret": "x.m rlike '[A-Za-z]' and length(regexp_replace(x.m, '[^0-9]', '')) >= 6",
}


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, base and spans, both array<struct<start, rank, end, kind, score>> in order."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("digits", F.col("text").rlike("[0-9]"))
    for kind, pattern in (base_patterns() | FURTHER).items():
        df = df.withColumn(f"in_{kind}", F.expr(_found(kind, pattern)))
    for kind in ORDER:
        near = f"x.near rlike r'{TELLING[kind]}'"
        scored = f"named_struct('start', x.start, 'rank', {ORDER.index(kind)}, 'end', x.end, 'kind', '{kind}', 'score', round({SCORES[kind]}D + if({near}, {BONUS}D, 0D), 2))"
        kept = f"filter(in_{kind}, x -> {CONFIRM[kind]})" if kind in CONFIRM else f"in_{kind}"
        df = df.withColumn(f"in_{kind}", F.expr(f"transform({kept}, x -> {scored})"))
    df = df.withColumn("base", F.array_sort(F.concat(*(f"in_{k}" for k in ORDER[:4]))))
    further = F.concat(*(f"in_{k}" for k in ORDER[4:]))
    df = df.withColumn("more", F.filter(further, lambda x: (x["score"] >= ACCEPT) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    return df.select("id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spans(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return df.select(F.col("id").alias("doc_id"), *(count(k) for k in ORDER[:4]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


SQL: dict[str, str] = {}
QUERIES = {"op8_pii": op8_pii}
