"""Pieces of DuckDB SQL that restate the engine's expressions independently."""

from __future__ import annotations

from textquarry.functions.text import ACCENTED, HAN_RUN, LOWER, MARKS, PLAIN, TERM_TOKEN, UPPER
from textquarry.model import SPACE


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chars(s: str) -> str:
    return "concat(" + ", ".join(f"chr({ord(c)})" for c in s) + ")"


WS = chars(SPACE)
CHUNKS = "chunks_ as (select distinct chunk_id, doc_id, source_path, source_type, title, section, chunk_index, text from chunks)"
DOCS = (
    "docs_ as (select * exclude (rn) from (select doc_id, source_path, source_type, title, sha256, size_bytes, mtime, created_at, updated_at, "
    "row_number() over (partition by doc_id order by updated_at desc, sha256 desc) rn from indexed_docs) where rn = 1)"
)
FIRST_DOCS = (
    "first_ as (select * exclude (rn) from (select doc_id, source_path, source_type, title, sha256, size_bytes, mtime, created_at, updated_at, "
    "row_number() over (partition by doc_id order by updated_at, sha256) rn from indexed_docs) where rn = 1)"
)
PARSED = (
    "parsed_ as (select * exclude (rn) from (select doc_id, source_path, source_type, title, text, sha256, size_bytes, mtime, metadata, "
    "row_number() over (partition by doc_id order by ingested_at desc, sha256 desc) rn from parsed_documents) where rn = 1)"
)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def tokens(x: str) -> str:
    folded = f"translate(translate(lower(coalesce({x}, '')), {text(ACCENTED)}, {text(PLAIN)}), {chars(MARKS)}, '')"
    return rf"regexp_extract_all({folded}, '[\p{{L}}\p{{N}}\p{{Co}}_.$/@:#-]+')"


ALL_TOKENS = "list_concat(list_concat(" + tokens("title") + ", " + tokens("section") + "), " + tokens("text") + ")"


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def terms(x: str) -> str:
    grams = (
        "case when length(r) <= 2 then [r] else list_concat(flatten(list_transform([2, 3, 4], lambda n: case when n <= length(r) "
        "then list_transform(range(1, length(r) - n + 2), lambda i: substring(r, i, n)) else [] end)), [r]) end"
    )
    runs = f"list_transform(regexp_extract_all(coalesce({x}, ''), '{HAN_RUN}'), lambda r: {grams})"
    return f"list_concat(regexp_extract_all({ascii_lower(f'coalesce({x}, chr(32))')}, '{TERM_TOKEN}'), flatten({runs}))"


TERMS = (
    "terms_ as (select distinct chunk_id, unnest(list_concat(list_concat("
    + terms("title") + ", " + terms("section") + "), list_concat(" + terms("text") + ", " + terms("source_path") + "))) term from chunks_)"
)


def bm25(query_tokens: list[str], mode: str = "any", source_type: str | None = None, limit: int | None = 10) -> str:
    """A select with (chunk_id, doc_id, ..., score) over chunks_."""
    tf = ", ".join(f"len(list_filter(tk, lambda x: x = {text(t)})) tf{i}" for i, t in enumerate(query_tokens))
    df = ", ".join(f"count(*) filter (tf{i} > 0) df{i}" for i in range(len(query_tokens)))
    parts = []
    for i in range(len(query_tokens)):
        idf = f"ln((n - df{i} + 0.5) / (df{i} + 0.5))"
        parts.append(f"case when {idf} <= 0 then 1e-6 else {idf} end * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))")
    where = (" or " if mode == "any" else " and ").join(f"tf{i} > 0" for i in range(len(query_tokens)))
    kind = f" and source_type = '{source_type}'" if source_type else ""
    cut = f" order by score, chunk_id limit {limit}" if limit else ""
    return (
        f"select chunk_id, doc_id, source_path, source_type, title, section, chunk_index, text, round(-({' + '.join(parts)}), 6) score "
        f"from (select *, len(tk) dl, {tf} from (select *, {ALL_TOKENS} tk from chunks_)), "
        f"(select count(*) n, avg(dl) avgdl, {df} from (select len(tk) dl, {tf} from (select {ALL_TOKENS} tk from chunks_))) "
        f"where ({where}){kind}{cut}"
    )
