"""Text functions: Column in, Column out. Patterns are Java's with Unicode classes, so white space and word boundaries are Unicode's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of clinical reasons and what they stand for, expanded in this order.
ABBREVIATIONS = {
    "pna": "pneumonia",
    "ptx": "pneumothorax",
    "sob": "shortness of breath",
    "doe": "dyspnea on exertion",
    "chf": "congestive heart failure",
    "ams": "altered mental status",
    "r/o": "rule out",
    "eval": "evaluate",
    "s/p": "status post",
    "ng": "nasogastric",
    "et": "endotracheal",
    "icu": "intensive care unit",
    "uti": "urinary tract infection",
    "cxr": "chest x-ray",
    "copd": "chronic obstructive pulmonary disease",
    "mi": "myocardial infarction",
    "cad": "coronary artery disease",
    "cp": "chest pain",
}
# Demographic phrases that end a fragment, applied in this order.
DEMOGRAPHIC = (
    r"___-year-old\s+(male|female|man|woman|m|f)",
    r"___\s*(year old|y\.?o\.?)\s+(male|female|man|woman|m|f)",
    r"\d+-year-old\s+(male|female|man|woman)",
    r"\d+\s*-\s*year[- ]?old\s+(male|female|man|woman|m|f)",
    r"\d+\s*(year[- ]?old|y\.?o\.?)\s+(male|female|man|woman|m|f)",
    r"\d+\s*years\s*(male|female|man|woman|m|f)",
    r"\d+\s*y\/?o\s*(male|female|man|woman|m|f)",
    r"\b\d+\s*-\s*year[- ]?old\b",
    r"___f|___m\b",
)
# Fixed value: the question of a record, before its reason.
PROMPT = "<image>\nDescribe the findings of the chest x-ray given the following indications: "
_U = "(?U)"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def sums_before(sizes: Column) -> Column:
    """The sum of the elements before each element of an array of ints, by blocks of the square root of its size."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def of(z: Column, k: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.size(z) - 1, k), lambda at: total(F.slice(z, at + 1, k)))
        return bound(
            bound(starts, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b)))),
            lambda s: F.transform(z, lambda _, i: F.get(s, F.floor(i / k).cast("int")) + total(F.slice(z, (i - i % k) + 1, i % k))),
        )

    some = bound(sizes, lambda z: bound(F.ceil(F.sqrt(F.size(z))).cast("int"), lambda k: of(z, k)))
    return F.when(F.size(sizes) > 0, some).otherwise(F.array().cast("array<int>"))


def places(c: Column, pattern: Column) -> Column:
    """array<struct<start, end, text>> of a pattern's matches, in order."""

    def of(found: Column, gaps: Column) -> Column:
        start = bound(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), sums_before)

        def place(m: Column, i: Column, before: Column) -> Column:
            at = F.get(before, i) + F.length(F.get(gaps, i))
            return F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("text"))

        return bound(start, lambda before: F.transform(found, lambda m, i: place(m, i, before)))

    return bound(c, lambda t: bound(F.regexp_extract_all(t, pattern, F.lit(0)), lambda found: bound(F.split(t, pattern, -1), lambda gaps: of(found, gaps))))


def pstrip(c: Column) -> Column:
    """Without Unicode white space at either end (trim() knows the blank alone)."""
    return F.regexp_replace(c, _U + r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, _U + r"\s+", " ")


def canonical(c: Column) -> Column:
    """STR-16: lower case, single blanks, trimmed."""
    return pstrip(collapse(F.lower(c)))


def _gated(c: Column, there: Callable[[Column], Column], f: Callable[[Column], Column]) -> Column:
    """f where its patterns can match at all, which a cheaper test tells."""
    return bound(c, lambda v: F.when(there(v), f(v)).otherwise(v))


def normalize_reason(c: Column) -> Column:
    """STR-1: the fixed chain of rewritings, in order; null is empty. Each goes over the texts alone that hold its words."""

    def ended(x: Column, patterns: tuple[str, ...]) -> Column:
        return reduce(lambda y, p: F.regexp_replace(y, _U + p, "$0;"), patterns, x)

    def held(word: str) -> Callable[[Column], Column]:
        return lambda v: F.contains(v, F.lit(word))

    def expanded(x: Column) -> Column:
        return reduce(lambda y, kv: _gated(y, held(kv[0]), lambda v: F.regexp_replace(v, _U + rf"\b{kv[0]}\b", kv[1])), ABBREVIATIONS.items(), x)

    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _U + r"^history:\s*", "")
    out = _gated(out, held("___"), lambda v: ended(v, DEMOGRAPHIC[:2]))
    out = _gated(out, lambda v: v.rlike(_U + r"\d\s*-?\s*y"), lambda v: ended(v, DEMOGRAPHIC[2:8]))
    out = _gated(out, held("___"), lambda v: ended(v, DEMOGRAPHIC[8:]))
    # No expansion makes a word that another one expands, so one look tells whether there is anything to do.
    out = _gated(out, lambda v: v.rlike(_U + rf"\b(?:{'|'.join(ABBREVIATIONS)})\b"), expanded)
    out = F.regexp_replace(out, _U + r"\s+", " ")
    out = _gated(out, held("//"), lambda v: F.regexp_replace(v, _U + r"\s*//\s*", ", "))
    out = F.regexp_replace(out, r"[\.;]+$", "")
    return pstrip(_gated(out, held(","), lambda v: F.regexp_replace(v, _U + r"\s*,\s*", ", ")))


def split_fragments(c: Column) -> Column:
    """STR-2: parts between . ; and , trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[.;,]", -1), pstrip), lambda x: x != "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, _U + r"\s+", -1), lambda x: x != "")


def word_count(c: Column) -> Column:
    """STR-3."""
    return F.size(words(c))


def sentence_case(c: Column) -> Column:
    """STR-6: the first letter after each '. ' in upper case, all others lower."""
    return F.array_join(F.transform(F.split(F.lower(c), r"\. ", -1), lambda s: F.concat(F.when(F.substring(s, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(s, 1, 1))), s.substr(F.lit(2), F.length(s)))), ". ")


def clean_field(c: Column) -> Column:
    """STR-7: trimmed, newlines as blanks, one pass of double to single blanks."""
    return F.replace(F.replace(pstrip(c), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def clean_report(c: Column) -> Column:
    """STR-23."""
    return collapse(F.replace(pstrip(c), F.lit("\n"), F.lit(" ")))


def join_history(a: Column, b: Column) -> Column:
    """STR-5: the two fields with '. ' between, blank ones left out."""
    return F.concat_ws(". ", F.nullif(pstrip(a), F.lit("")), F.nullif(pstrip(b), F.lit("")))


def null_if_blank(c: Column) -> Column:
    """STR-27: empty, or the text nan, is null."""
    return F.when((c != "") & (c != "nan"), c)


def without(c: Column, *sentinels: str) -> Column:
    """STR-11."""
    return F.when(~c.isin(*sentinels), c)


def sex_word(c: Column) -> Column:
    """STR-8."""
    return F.when(c == "M", "male").when(c == "F", "female")


def age_phrase(c: Column) -> Column:
    """STR-9: 036Y as '36 years old'; null unless digits (a sign, blanks around them) and one of Y, M, W, D."""
    number = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)\s*[YMWD]$", 1)
    unit = F.substring(c, -1, 1)
    noun = F.when(unit == "Y", "years").when(unit == "M", "months").when(unit == "W", "weeks").otherwise("days")
    return F.when(number != "", F.concat(number.try_cast("long").cast("string"), F.lit(" "), noun, F.lit(" old")))


def age_text(c: Column) -> Column:
    """STR-10: truncated to whole years, as text."""
    return c.cast("long").cast("string")


def prefixed(reason: Column, *named: tuple[str, Column]) -> Column:
    """STR-12: 'Name: value. ' before the reason for each value that isn't null, the last outermost."""
    return reduce(lambda r, nv: F.concat(F.coalesce(F.concat(F.lit(f"{nv[0]}: "), nv[1], F.lit(". ")), F.lit("")), r), named, reason)


def prefixed_unless_held(reason: Column, *named: tuple[str, Column]) -> Column:
    """STR-13: as prefixed(), but only for values that the lower-cased text, as extended so far, doesn't hold."""
    return reduce(lambda r, nv: F.when(nv[1].isNotNull() & ~F.contains(F.lower(r), nv[1]), F.concat(F.lit(f"{nv[0]}: "), nv[1], F.lit(". "), r)).otherwise(r), named, reason)


def prompt(reason: Column, end: str = "") -> Column:
    """STR-14; one corpus ends the reason with a full stop."""
    return F.concat(F.lit(PROMPT), reason, F.lit(f"{end}\n"))


def placeholders(c: Column) -> Column:
    """STR-15: ___f and ___m as words, other ___ removed."""
    out = F.regexp_replace(F.regexp_replace(c, _U + r"___f\b", "female"), _U + r"___m\b", "male")
    return pstrip(collapse(F.replace(out, F.lit("___"), F.lit(""))))


def variants(c: Column, forms: dict[str, list[str]]) -> Column:
    """STR-17: the canonical text, then it with one phrase replaced by one of its short forms, for each of them it holds."""

    def of(base: Column) -> Column:
        each = [F.when(F.contains(base, F.lit(long)), F.replace(base, F.lit(long), F.lit(short.lower()))) for long, shorts in forms.items() for short in shorts]
        return F.array_distinct(F.filter(F.array(base, *each), lambda x: x.isNotNull()))

    return bound(canonical(c), of)


def boundary_pattern(term: str) -> str:
    """STR-18: the term, not touching a letter or digit of ASCII."""
    return r"(?<![a-z0-9])\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E(?![a-z0-9])"


def between(c: Column, start: str, end: str) -> Column:
    """STR-20: what follows the first start marker, up to the end marker if there is one; null without a start."""
    rest = c.substr(F.locate(start, c) + len(start), F.length(c))
    return F.when(F.contains(c, F.lit(start)), F.substring_index(rest, end, 1))


def user_turn(c: Column, users: tuple[str, ...], assistants: tuple[str, ...]) -> Column:
    """STR-24: from the first user marker found (in the order given) to the first assistant marker after it."""
    marks = [F.when(F.contains(c, F.lit(m)), c.substr(F.locate(m, c) + len(m), F.length(c))) for m in users]
    rest = F.coalesce(*marks)
    return F.coalesce(*(F.when(F.contains(rest, F.lit(m)), F.substring_index(rest, m, 1)) for m in assistants), rest)


def full_mask(tokens: Column) -> Column:
    """STR-25."""
    return F.transform(tokens, lambda _: F.lit(True))


def to_last_stop(c: Column) -> Column:
    """STR-21: text that doesn't end a sentence is cut after its last full stop, if that isn't its first character."""
    t = pstrip(F.coalesce(c, F.lit("")))
    at = F.length(t) - F.locate(".", F.reverse(t)) + 1
    return F.when(F.substring(t, -1, 1).isin(".", "?", "!"), t).when(F.contains(t, F.lit(".")) & (at > 1), t.substr(F.lit(1), at)).otherwise(t)


def basename(c: Column) -> Column:
    """STR-22."""
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def resolve_path(root: str, c: Column) -> Column:
    """PRJ-6: .. as ., then absolute or below root."""
    p = F.replace(c, F.lit(".."), F.lit("."))
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), p))


def first_nonempty(*cs: Column) -> Column:
    """STR-28: the first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def stable_id(*keys: Column) -> Column:
    """STR-26: an id that depends on the key alone, in place of a random one."""
    return F.sha2(F.concat_ws("\x1f", *keys), 256)
