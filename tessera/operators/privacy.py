"""Selective privacy on text: which spans of a record are to be protected, and their vectors clipped and noised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Demographic phrases.
DEMOGRAPHIC = ("male", "female", "hispanic/latino", "non-hispanic/non-latino", "white", "asian", "black", "pacific islander", "native american")
# Canonical phrases and their short forms.
SHORT_FORMS = {
    "chronic obstructive pulmonary disease": ["copd"],
    "congestive heart failure": ["chf"],
    "shortness of breath": ["sob"],
    "myocardial infarction": ["mi"],
    "shortness of breath chest pain": ["cp"],
    "nasogastric": ["ng"],
    "rule out": ["r/o"],
    "endotracheal": ["et"],
    "chest pain": ["cp"],
    "status post": ["s/p"],
    "pneumothorax": ["ptx"],
    "chest x-ray": ["cxr"],
    "altered mental status": ["ams"],
    "urinary tract infection": ["uti"],
    "pneumonia": ["pna"],
    "evaluate": ["eval"],
    "rule out congestive heart failure": ["R/O Chf"],
    "coronary artery disease": ["cad"],
    "rule out pneumonia": ["R/O Pna"],
    "intensive care unit": ["icu"],
    "evaluate for pneumonia": ["eval for pna", "eval pneumonia"],
    "evaluate for congestive heart failure": ["eval for chf"],
}
_TRAIL = r"[.,;:]*"


def _matches(low: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, end, kind, text>> of a pattern's matches."""
    return F.transform(T.places(low, F.lit(pattern)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["text"].alias("text")))


_NUMBER = r"(?<![0-9])[0-9]+(?![0-9])" + _TRAIL
_PHRASE = r"(?<![a-z0-9])(?:" + "|".join(sorted(DEMOGRAPHIC, key=len, reverse=True)) + r")(?![a-z0-9])" + _TRAIL


def general_spans(df: DataFrame, text: str) -> DataFrame:
    """df with `spans`: digit runs and demographic phrases in lower-cased text, with the punctuation that follows them (STR-18, STR-19)."""
    spans = T.bound(F.lower(text), lambda low: F.concat(_matches(low, "number", _NUMBER), _matches(low, "demographic", _PHRASE)))
    return df.withColumn("spans", F.array_sort(spans))


def sensitive_words(text: Column) -> Column:
    """array<boolean>: of the pieces of a text between single blanks, which a general span touches.

    The spans' characters, but for blanks, are marked in place, so a piece knows without looking a place up.
    """

    def marked(low: Column, pattern: str) -> Column:
        found, gaps = F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), F.split(low, pattern, -1)
        pieces = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.regexp_replace(m, "[^ ]", "\x01"), F.lit(""))))
        return F.array_join(pieces, "")

    # Marks of the first pattern are neither letters nor digits, as little as what they stand for is part of a phrase.
    both = T.bound(F.lower(text), lambda low: F.zip_with(F.split(marked(low, _NUMBER), " ", -1), F.split(marked(low, _PHRASE), " ", -1), lambda a, b: F.contains(a, F.lit("\x01")) | F.contains(b, F.lit("\x01"))))
    return both


def part_spans(low: Column, terms: Column, kind: str = "part") -> Column:
    """JOI-8: the spans in lower-cased text of a row's own terms, all matches of each, boundaries as in STR-18.

    The terms of a row are few, so each is sought with its own pattern and no row meets another's terms.
    """
    quoted = F.transform(terms, lambda t: F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])" + _TRAIL)))
    hits = F.flatten(F.transform(quoted, lambda p: T.places(low, p)))
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(kind).alias("kind"), h["text"].alias("text")))


def sensitive_terms(parts: Column) -> Column:
    """FLT-11: canonical texts, and their short forms, of the parts whose flag says no."""
    no = F.filter(parts, lambda p: T.canonical(p["image_inferable"]) == "no")
    texts = F.transform(no, lambda p: T.first_nonempty(p["part_text"], p["reason_text"]))
    return F.array_distinct(F.filter(F.flatten(F.transform(texts, lambda t: T.variants(t, SHORT_FORMS))), lambda t: t != ""))


def merged(spans: Column) -> Column:
    """Spans in order, overlapping and touching ones as one."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.aggregate(F.array_sort(spans), none, step)


def key_candidates(id_: Column, *prefixes: str) -> Column:
    """JOI-9: the id as it is, then under each prefix, under the last with .jpg for .png."""
    return F.array(id_, *(F.concat(F.lit(f"{p}:"), id_) for p in prefixes[:-1]), *(F.concat(F.lit(f"{p}:"), F.regexp_replace(id_, r"\.png$", ".jpg")) for p in prefixes[-1:]))
