"""DuckDB's counterparts of the text functions; its patterns know ASCII, so Unicode white space and word characters are written out."""

from __future__ import annotations

from tessera.functions.text import ABBREVIATIONS, DEMOGRAPHIC

S = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_W = r"\p{L}\p{N}_"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{S}+|{S}+$", "")


def collapse(x: str) -> str:
    return sub(x, f"{S}+", " ")


def canonical(x: str) -> str:
    return strip(collapse(f"lower({x})"))


def normalize(x: str) -> str:
    out = sub(f"lower(coalesce({x}, ''))", f"^history:{S}*", "")
    for p in DEMOGRAPHIC:
        out = sub(out, p.replace(r"\s", S), r"\0;")
    for short, long in ABBREVIATIONS.items():
        # A delimiter that two words share is taken by the first; the second comes with the next pass.
        for _ in range(2):
            out = sub(out, f"(^|[^{_W}]){short}($|[^{_W}])", rf"\1{long}\2")
    for pattern, by in ((f"{S}+", " "), (f"{S}*//{S}*", ", "), (r"[\.;]+$", ""), (f"{S}*,{S}*", ", ")):
        out = sub(out, pattern, by)
    return strip(out)


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{S}+'), lambda w: w <> '')"


def parts(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.;,]'), lambda p: {strip('p')}), lambda p: p <> '')"


#: Fragments of documents (f), the index of the distinct ones (ix).
FRAGMENTS = f"""
    n AS MATERIALIZED (SELECT doc_id, {normalize('text')} AS t FROM documents WHERE length(text) > 0),
    p AS (SELECT doc_id, {parts('t')} AS parts FROM n),
    u AS (SELECT doc_id, unnest(parts) AS fragment, unnest(range(len(parts))) AS i FROM p),
    f AS MATERIALIZED (SELECT doc_id, fragment, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS pos FROM u GROUP BY doc_id, fragment)"""
INDEX = f"""{FRAGMENTS},
    c AS (SELECT fragment, count(*) AS cnt, min(doc_id) AS first_ord, len({words('fragment')}) AS word_count FROM f GROUP BY fragment),
    ix AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY word_count DESC, fragment) - 1 AS idx FROM c)"""
