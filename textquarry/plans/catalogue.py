"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions import text as tx
from textquarry.functions.encoding import decode_text
from textquarry.model import CHUNKS, MAX_TERMS
from textquarry.operators import browse, chunking, index, media, search, sync
from textquarry.plans import sql as q
from textquarry.sources import html, images, office

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ANY, ALL, TYPED = "session key loader", "session key", "request signer"
HAN = "签名校验 反射代理"
WORDS = [c.split(" ")[0] for c in CHUNKS.split(", ")][:8]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks, each once."""
    return table(spark, d, "chunks").select(*WORDS).dropDuplicates(["chunk_id"])


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The document rows as exported last."""
    return sync.latest(table(spark, d, "indexed_docs"), "doc_id", "updated_at")


def first_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_docs")
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy("doc_id").agg(F.min_by(whole, F.struct("updated_at", "sha256")).alias("r")).select("r.*")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return sync.latest(table(spark, d, "parsed_documents"), "doc_id", "ingested_at")


# --- chunking -------------------------------------------------------------------------------------


@query(f"""
with w as (select doc_id, text, unnest(range(0, 1 + case when length(text) <= 1200 then 0
             else cast(ceil((length(text) - 1200) / 1040.0) as bigint) end)) k from documents where text <> ''),
p as (select doc_id, k, {q.strip("substring(text, k * 1040 + 1, 1200)")} t from w),
n as (select doc_id, t, row_number() over (partition by doc_id order by k) - 1 chunk_index from p where t <> '')
select doc_id, chunk_index, sha256(concat(doc_id, ':', chunk_index, ':', t)) chunk_id, length(t) n_chars from n""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows over whole texts."""
    order = Window.partitionBy("doc_id").orderBy("k")
    cut = chunking.windows(F.col("text"), 1200, 160)
    return (
        table(spark, d, "documents")
        .where("text <> ''")
        .select("doc_id", F.posexplode(cut).alias("k", "piece"))
        .withColumn("t", tx.strip(F.col("piece")))
        .where("t <> ''")
        .withColumn("chunk_index", (F.row_number().over(order) - 1).cast("bigint"))
        .select(
            "doc_id",
            "chunk_index",
            F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), "t"), 256).alias("chunk_id"),
            F.char_length("t").cast("bigint").alias("n_chars"),
        )
    )


def _prose(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).where("source_type <> 'code'")


_SECTIONS = rf"""
lines as (select doc_id, generate_subscripts(ls, 1) pos, unnest(ls) line from (
    select doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') ls
    from parsed_ where source_type <> 'code' and text <> '')),
named as (select *, regexp_extract({q.strip("line")}, '^#{{1,6}}[{tx.SPACES}]+(.+)$', 1) name from lines),
numbered as (select *, sum(case when name <> '' then 1 else 0 end) over (partition by doc_id order by pos) sec from named),
sections as (select doc_id, sec, case when sec = 0 then 'intro' else {q.strip("max(name)")} end section,
    {q.strip("string_agg(line, chr(10) order by pos)")} text from numbered group by doc_id, sec)"""


@query(f"with {q.PARSED}, {_SECTIONS} select doc_id, cast(sec as bigint) sec, section, length(text) n_chars from sections")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    s = chunking.markdown_sections(_prose(spark, d))
    return s.select("doc_id", F.col("sec").cast("bigint").alias("sec"), "section", F.char_length("text").cast("bigint").alias("n_chars"))


_PIECES = rf"""
parts as (select doc_id, sec, section, text, string_split_regex(text, '\n\s*\n') a, regexp_extract_all(text, '\n\s*\n') b from sections),
listed as (select doc_id, sec, section, text, list_filter(flatten(list_transform(range(1, len(a) + 1),
    lambda i: [a[i], coalesce(b[i], '')])), lambda x: x <> '') ps from parts),
folded as (select doc_id, sec, section, case when length(text) <= 1200 then [text] else
    list_append(r.o, r.b) end pieces from (select *, list_reduce(
        list_transform(ps, lambda p: {{'b': p, 'o': cast([] as varchar[])}}),
        lambda acc, x: case when length(acc.b) + length(x.b) <= 1200 then {{'b': acc.b || x.b, 'o': acc.o}}
            else {{'b': x.b, 'o': list_append(acc.o, acc.b)}} end) r from listed where len(ps) > 0)),
placed as (select doc_id, sec, section, generate_subscripts(pieces, 1) pos, unnest(pieces) piece from folded),
wins as (select doc_id, sec, section, pos, piece, unnest(range(0, 1 + case when length(piece) <= 1200 then 0
    else cast(ceil((length(piece) - 1200) / 1040.0) as bigint) end)) k from placed where {q.strip("piece")} <> ''),
cut as (select doc_id, sec, section, pos, k, {q.strip("substring(piece, k * 1040 + 1, 1200)")} t from wins),
indexed as (select doc_id, section, t, row_number() over (partition by doc_id order by sec, pos, k) - 1 chunk_index from cut where t <> '')"""


@query(f"""with {q.PARSED}, {_SECTIONS}, {_PIECES}
select doc_id, chunk_index, section, sha256(concat(doc_id, ':', chunk_index, ':', t)) chunk_id from indexed""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """All parsed documents but code, by sections, packed paragraphs and windows."""
    typed = _prose(spark, d).select("doc_id", "source_type", F.lit(None).cast("string").alias("language"), "text")
    return chunking.chunk_documents(typed).select("doc_id", "chunk_index", "section", "chunk_id")


_FOLD = """list_reduce(list_prepend({'o': cast([] as struct(n varchar, t varchar)[]), 'n': cast(null as varchar), 't': cast(null as varchar), 's': 0},
    list_transform(ps, lambda p: {'o': cast([] as struct(n varchar, t varchar)[]), 'n': p.n, 't': p.t, 's': 0})), lambda a, x:
    case when length(x.t) > 1200 then {'o': list_append(case when a.t is null then a.o else list_append(a.o, {'n': a.n, 't': a.t}) end, {'n': x.n, 't': x.t}),
            'n': cast(null as varchar), 't': cast(null as varchar), 's': 0}
        when a.t is not null and a.s + length(x.t) + 2 <= 1200 then {'o': a.o, 'n': a.n || ', ' || x.n, 't': a.t || chr(10) || chr(10) || x.t, 's': cast(a.s + length(x.t) + 2 as integer)}
        else {'o': case when a.t is null then a.o else list_append(a.o, {'n': a.n, 't': a.t}) end, 'n': x.n, 't': x.t, 's': cast(length(x.t) + 2 as integer)} end)"""
_TYPE_SQL = r"(?m)^\s*(?:public|private|protected|static|final|internal|export|inline|suspend|native|\s)*(?:class|interface|enum|object|fun|function)\s+([A-Za-z_$][\w$]*)"
_METHOD_SQL = (
    r"(?m)^\s*(?:public|private|protected|static|final|native|synchronized|override|inline|\s)+[\w<>\[\].?$]+\s+([A-Za-z_$][\w$]*)"
    r"\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{?"
)
_SMALI_NAME = r"case when regexp_extract(regexp_extract(x, '^[^\n]*'), '([<>\w$]+)\s*\(', 1) <> '' then regexp_extract(regexp_extract(x, '^[^\n]*'), '([<>\w$]+)\s*\(', 1) else " + q.strip(r"regexp_extract(x, '^[^\n]*')") + " end"


def _sections_sql(parts: str, head: str, name: str) -> str:
    texts = f"list_transform({parts}, lambda x: {{'n': {name}, 't': {q.strip('split_part(x, chr(2), 1)')}}})"
    first = f"case when {q.strip(parts + '[1]')} <> '' then [{{'n': '{head}', 't': {q.strip(parts + '[1]')}}}] else [] end"
    return f"case when len({parts}) > 1 then list_concat({first}, {texts}[2:]) else [] end"


@query(rf"""with {q.PARSED}, code as (select doc_id, text, lower(regexp_extract(source_path, '\.([^./]*)$', 1)) lang from parsed_ where source_type = 'code' and text <> ''),
marked as (select *, string_split(regexp_replace(text, '{_TYPE_SQL}', chr(1) || '\0', 'g'), chr(1)) ty, string_split(regexp_replace(text, '{_METHOD_SQL}', chr(1) || '\0', 'g'), chr(1)) me,
    string_split(regexp_replace(regexp_replace(text, '(?m)^\.method\b.*$', chr(1) || '\0', 'g'), '(?m)^\.end method\b.*$', '\0' || chr(2), 'g'), chr(1)) sm,
    string_split(regexp_replace(text, '{chunking.PYTHON_SYMBOL}', chr(1) || '\0', 'g'), chr(1)) py from code),
found as (select doc_id, text, {_sections_sql("ty", "preamble", f"regexp_extract(x, '{_TYPE_SQL}', 1)")} fty, {_sections_sql("me", "preamble", f"regexp_extract(x, '{_METHOD_SQL}', 1)")} fme,
    {_sections_sql("sm", "class-header", _SMALI_NAME)} fsm, {_sections_sql("py", "preamble", f"regexp_extract(x, '{chunking.PYTHON_SYMBOL}', 1)")} fpy, lang from marked),
one as (select doc_id, text, case when lang = 'smali' then fsm when lang = 'py' then fpy when lang in {chunking.C_LIKE} then case when len(fty) > 1 then fty else fme end else [] end f from found),
cparts as (select doc_id, len(f) = 0 plain, case when len(f) > 0 then f else list_transform(list_filter(list_transform(string_split_regex(text, '\n\s*\n'),
    lambda x: rtrim(x, {q.WS})), lambda x: x <> ''), lambda x: {{'n': 'code', 't': x}}) end ps from one),
cfolded as (select doc_id, plain, {_FOLD} r from cparts), packed as (select doc_id, plain, case when r.t is null then r.o else list_append(r.o, {{'n': r.n, 't': r.t}}) end ss from cfolded),
secs as (select doc_id, plain, generate_subscripts(ss, 1) sec, unnest(ss) s from packed), sections as (select doc_id, sec, case when plain then 'code' else s.n end section, s.t text from secs),
{_PIECES.strip()} select doc_id, chunk_index, case when section <> '' then section else 'chunk-' || chunk_index end section, t text, sha256(concat(doc_id, ':', chunk_index, ':', t)) chunk_id from indexed""")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Source files by symbols."""
    code = parsed(spark, d).where("source_type = 'code'")
    language = F.lower(F.regexp_extract("source_path", r"\.([^./]*)$", 1))
    return chunking.chunk_documents(code.select("doc_id", "source_type", language.alias("language"), "text"))


# --- full-text index and search -------------------------------------------------------------------


@query(f"""with {q.CHUNKS}, t as (select chunk_id, unnest({q.ALL_TOKENS}) term from chunks_)
select term, count(distinct chunk_id) chunks, count(*) occurrences from t group by term""")
def fts_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return index.vocabulary(chunks(spark, d))


_RESULT = ", ".join(search.RESULT)


@query(f"with {q.CHUNKS} {q.bm25(ANY.split())}")
def bm25_any(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(chunks(spark, d), ANY, "any", top_k=10)


@query(f"with {q.CHUNKS} {q.bm25(ALL.split(), 'all', limit=20)}")
def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(chunks(spark, d), ALL, "all", top_k=20)


@query(f"with {q.CHUNKS} {q.bm25(TYPED.split(), 'any', 'html')}")
def bm25_by_type(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(chunks(spark, d), TYPED, "any", "html", 10)


@query(f"with {q.CHUNKS} select chunk_id, score from ({q.bm25(ANY.split(), limit=None)})")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every match with its score, from the stored form of the index."""
    c = chunks(spark, d)
    return search.bm25_postings(index.postings(c), index.lengths(c), c, ANY, top_k=-1).select("chunk_id", "score")


@query(f"with {q.CHUNKS}, {q.TERMS} select term, chunk_id from terms_")
def chunk_terms(spark: SparkSession, d: str) -> DataFrame:
    return index.terms(chunks(spark, d), MAX_TERMS)


_GROUPS = ", ".join(f"({i}, {q.text(t)})" for i, ts in enumerate(tx.term_groups(HAN)) for t in ts)
_HITS = f"hits as (select distinct chunk_id, g from terms_ join (values {_GROUPS}) v(g, t) on term = t)"
_IN_ORDER = "order by source_path, chunk_index, chunk_id"


@query(f"""with {q.CHUNKS}, {q.TERMS}, {_HITS}
select {_RESULT}, 0.0::double score from chunks_ where chunk_id in (select chunk_id from hits) {_IN_ORDER} limit 200""")
def term_index_any(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return search.term_search(c, index.terms(c), HAN, "any", top_k=200)


@query(f"""with {q.CHUNKS}, {q.TERMS}, {_HITS}
select {_RESULT}, 0.0::double score from chunks_ where chunk_id in (select chunk_id from hits group by chunk_id
    having count(*) = (select count(distinct g) from hits)) {_IN_ORDER} limit 200""")
def term_index_all(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return search.term_search(c, index.terms(c), HAN, "all", top_k=200)


def _contains(t: str) -> str:
    fields = ("title", "section", "text", "source_path")
    return "(" + " or ".join(f"coalesce(contains({q.ascii_lower(f)}, {q.text(t.lower())}), false)" for f in fields) + ")"


@query(f"""with {q.CHUNKS} select {_RESULT}, 0.0::double score from chunks_
where {_contains("BindTrace")} and {_contains("session")} {_IN_ORDER}""")
def substring_all(spark: SparkSession, d: str) -> DataFrame:
    return search.substring_search(chunks(spark, d), "BindTrace session", "all", top_k=-1)


_HAN_TOKENS = HAN.split()
_HAN_SUB = " or ".join(_contains(t) for t in _HAN_TOKENS)


@query(f"""with {q.CHUNKS}, {q.TERMS}, {_HITS}, one as (select *, 1 stage from ({q.bm25(_HAN_TOKENS, limit=300)})),
two as (select {_RESULT}, 0.0::double score, 2 stage from chunks_ where chunk_id in (select chunk_id from hits)),
three as (select {_RESULT}, 0.0::double score, 3 stage from chunks_ where {_HAN_SUB}),
every as (select * from one union all by name select * from two union all by name select * from three),
least_ as (select *, row_number() over (partition by chunk_id order by stage) rn from every)
select {_RESULT}, stage, score from least_ where rn = 1
order by stage, score, case when stage = 1 then '' else source_path end, case when stage = 1 then 0 else chunk_index end, chunk_id limit 300""")
def staged_search(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return search.staged_search(c, index.terms(c), HAN, top_k=300)


_LOW = "lower(text)"
_AT = "case " + " ".join(f"when instr({_LOW}, {q.text(t)}) > 0 then instr({_LOW}, {q.text(t)}) - 1" for t in ANY.split()) + " else 0 end"


@query(f"""with {q.CHUNKS}, s as (select chunk_id, text, greatest(0, {_AT} - 80) a, length(text) n from chunks_)
select chunk_id, concat(case when a > 0 then '...' else '' end, {q.strip("substring(text, a + 1, 240)")},
    case when a + 240 < n then '...' else '' end) snippet from s""")
def plain_snippets(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", search.plain_snippet(F.col("text"), ANY).alias("snippet"))


@query()
def window_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of the best results; checked against a full-text library in tests."""
    top = search.bm25(chunks(spark, d), ANY, "any", top_k=50)
    return search.with_snippets(top, ANY).select("chunk_id", "score", "snippet")


@query(f"""with {q.CHUNKS} select a.chunk_id hit_id, b.chunk_id, cast(b.chunk_index - a.chunk_index as integer) distance
from chunks_ a join chunks_ b on a.doc_id = b.doc_id and b.chunk_index between a.chunk_index - 2 and a.chunk_index + 2
and b.chunk_index <> a.chunk_index""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return search.neighbours(c, c, 2)


# --- browsing -------------------------------------------------------------------------------------


@query(f"""with {q.CHUNKS}, {q.DOCS} select d.doc_id, d.source_path, d.source_type, d.title, count(c.chunk_id) chunk_count, d.updated_at
from docs_ d left join chunks_ c on c.doc_id = d.doc_id group by all""")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return browse.list_documents(docs(spark, d), chunks(spark, d))


_SELECTOR = "Signer"
_RESOLVED = f"""one as (select doc_id from docs_ where doc_id = '{_SELECTOR}' or source_path = '{_SELECTOR}'
    or {q.ascii_lower("source_path")} like '%{_SELECTOR.lower()}%' or {q.ascii_lower("title")} like '%{_SELECTOR.lower()}%'
    order by case when doc_id = '{_SELECTOR}' then 0 when source_path = '{_SELECTOR}' then 1 else 2 end, source_path, doc_id limit 1)"""


@query(f"with {q.DOCS}, {_RESOLVED} select doc_id from one")
def resolve_document(spark: SparkSession, d: str) -> DataFrame:
    return browse.resolve(docs(spark, d), _SELECTOR)


@query(f"""with {q.CHUNKS}, {q.DOCS}, {_RESOLVED} select section, min(chunk_index) first_chunk, count(*) chunk_count
from chunks_ where doc_id in (select doc_id from one) group by section""")
def document_outline(spark: SparkSession, d: str) -> DataFrame:
    return browse.outline(docs(spark, d), chunks(spark, d), _SELECTOR)


@query(f"with {q.CHUNKS} select doc_id, section, min(chunk_index) first_chunk, count(*) chunk_count from chunks_ group by doc_id, section")
def outlines(spark: SparkSession, d: str) -> DataFrame:
    return browse.outlines(chunks(spark, d))


@query(f"""with {q.CHUNKS}, {q.DOCS}, {_RESOLVED} select {_RESULT} from chunks_ where doc_id in (select doc_id from one)
and (coalesce({q.ascii_lower("section")} like '%e%', false) or coalesce({q.ascii_lower("text")} like '%e%', false))""")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return browse.document_chunks(docs(spark, d), chunks(spark, d), _SELECTOR, "e").select(*search.RESULT)


@query(f"with {q.DOCS} select source_type, count(*) documents from docs_ group by source_type")
def docs_by_type(spark: SparkSession, d: str) -> DataFrame:
    return browse.by_type(docs(spark, d))


@query(f"""with {q.DOCS}, n as (select source_type, count(*) c from docs_ group by source_type)
select coalesce(string_agg(source_type || '=' || c, ', ' order by source_type), 'none') by_type from n""")
def docs_by_type_line(spark: SparkSession, d: str) -> DataFrame:
    return browse.by_type_line(docs(spark, d))


@query(f"""with {q.CHUNKS}, {q.DOCS}, {q.TERMS} select 'documents' as name, count(*) as rows from docs_ union all select 'chunks', count(*) from chunks_
union all select 'fts_rows', count(*) from chunks_ union all select 'term_rows', count(*) from terms_
union all select 'source_files', count(distinct source_path) from parsed_documents
union all select 'media', count(distinct local_path) from media
union all select 'documents: ' || coalesce(source_type, 'none'), count(*) from docs_ group by source_type""")
def status(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return browse.status(
        source_files=table(spark, d, "parsed_documents").select("source_path").distinct(), documents=docs(spark, d), chunks=c,
        fts_rows=index.lengths(c), term_rows=index.terms(c), media=table(spark, d, "media").select("local_path").distinct(),
    )


# --- keeping in sync ------------------------------------------------------------------------------
# Stored: the documents as first exported. Current: as exported last, without those that have no
# chunks, and with the freshly parsed documents.


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cols = ["doc_id", "source_path", "source_type", "title", "sha256", "size_bytes", "mtime"]
    stored = first_docs(spark, d).select(*cols, "created_at", "updated_at")
    c = chunks(spark, d)
    live = docs(spark, d).select(*cols).join(c.select("doc_id").distinct(), "doc_id", "left_semi")
    both = live.withColumn("fresh", F.lit(0)).unionByName(parsed(spark, d).select(*cols).withColumn("fresh", F.lit(1)))
    # a path that both deliver is taken from the freshly parsed documents
    whole = F.struct(*(F.col(x) for x in cols))
    current = both.groupBy("source_path").agg(F.max_by(whole, F.struct("fresh", "doc_id", "sha256")).alias("r")).select("r.*")
    return stored, current, sync.diff(stored, current, index.terms(c).join(c.select("chunk_id", "doc_id"), "chunk_id").select("doc_id"))


_STATES = f"""{q.FIRST_DOCS}, {q.DOCS}, {q.PARSED}, both_ as (
    select doc_id, source_path, source_type, title, sha256, size_bytes, mtime, 0 fresh from docs_ where doc_id in (select doc_id from chunks)
    union all select doc_id, source_path, source_type, title, sha256, size_bytes, mtime, 1 from parsed_), current_ as (select * exclude (fresh, rn) from (
    select *, row_number() over (partition by source_path order by fresh desc, doc_id desc, sha256 desc) rn from both_) where rn = 1),
indexed_ as (select distinct doc_id from chunks_ join terms_ using (chunk_id)),
diff_ as (select coalesce(o.source_path, n.source_path) source_path, case when n.source_path is null then 'deleted'
    when o.source_path is null then 'new' when o.sha256 = n.sha256 and o.size_bytes = n.size_bytes and o.doc_id in (select doc_id from indexed_) then 'unchanged' else 'changed' end status
    from first_ o full outer join current_ n on o.source_path = n.source_path)"""
_STATES = f"{q.CHUNKS}, {q.TERMS}, {_STATES}"


@query(f"with {_STATES} select source_path, status from diff_")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d)[2]


def _media_state(spark: SparkSession, d: str, active: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manifest, what stays of it, and the files that go; images of unknown size count as missing files."""
    m = table(spark, d, "media").select("local_path", "source_path", "size_bytes")
    m = m.groupBy("local_path").agg(F.max("source_path").alias("source_path"), F.max("size_bytes").alias("size_bytes"))
    manifest = m.select("local_path", "source_path")
    return manifest, *media.collect(manifest, active, m.where("size_bytes is not null"))


_MEDIA = """m_ as (select local_path, max(source_path) source_path, max(size_bytes) size_bytes from media group by local_path),
stays_ as (select * from m_ where source_path in (select source_path from {active}) and size_bytes is not null),
gone_ as (select local_path from m_ where size_bytes is not null and local_path not in (select local_path from stays_)
    and not regexp_matches(lower(local_path), '\\.(txt|md)$'))"""


@query(f"""with {_STATES}, failed_ as (select source_path from parsed_ where text is null or text = ''),
status_ as (select source_path, case when status <> 'deleted' and source_path in (select source_path from failed_) then 'failed' else status end status from diff_),
{_MEDIA.format(active="current_")}
select cast(count(*) filter (status <> 'deleted') as bigint) seen, count(*) filter (status in ('new', 'changed')) indexed,
count(*) filter (status = 'unchanged') skipped, (select count(*) from chunks_ where doc_id in (select doc_id from current_ join status_ using (source_path)
    where status in ('new', 'changed'))) chunks, count(*) filter (status = 'deleted') deleted, (select count(*) from gone_) media_deleted_files,
(select count(*) from m_) - (select count(*) from stays_) media_deleted_entries, count(*) filter (status = 'failed') failed from status_""")
def sync_counters(spark: SparkSession, d: str) -> DataFrame:
    """All counters of a run; freshly parsed documents without text count as failed."""
    _, current, changes = _states(spark, d)
    failed = parsed(spark, d).where("text is null or text = ''").select("source_path", F.lit(True).alias("bad"))
    changes = changes.join(failed, "source_path", "left").select(
        "source_path", F.when((F.col("status") != "deleted") & F.col("bad"), "failed").otherwise(F.col("status")).alias("status")
    )
    written = current.join(changes.where("status in ('new', 'changed')"), "source_path", "left_semi")
    manifest, stays, gone = _media_state(spark, d, current)
    return sync.counters(changes, chunks(spark, d).join(written, "doc_id", "left_semi"), gone, media.dropped(manifest, stays))


_NOW = "2026-01-01 00:00:00"


@query(f"""with {_STATES}
select doc_id, source_path, source_type, title, sha256, size_bytes, mtime, created_at, updated_at from first_
    where source_path in (select source_path from diff_ where status = 'unchanged')
union all select c.doc_id, c.source_path, c.source_type, c.title, c.sha256, c.size_bytes, c.mtime,
    coalesce(f.created_at, timestamp '{_NOW}'), timestamp '{_NOW}' from current_ c join diff_ x on x.source_path = c.source_path
    left join first_ f on f.source_path = c.source_path where x.status in ('new', 'changed')""")
def sync_state(spark: SparkSession, d: str) -> DataFrame:
    stored, current, changes = _states(spark, d)
    return sync.merged(stored, current, changes, _NOW)


@query(f"""with {_STATES} select chunk_id from chunks_ where doc_id not in
(select f.doc_id from first_ f join diff_ x on x.source_path = f.source_path where x.status in ('deleted', 'changed'))""")
def pruned_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that stay when those of deleted and changed documents are dropped."""
    stored, _, changes = _states(spark, d)
    gone = stored.join(changes.where("status in ('deleted', 'changed')"), "source_path", "left_semi")
    return sync.without(chunks(spark, d), gone, "doc_id").select("chunk_id")


@query(f"""with {q.DOCS}, {_MEDIA.format(active="docs_")}
select local_path, 'entry kept' as what from stays_ union all select local_path, 'file deleted' from gone_""")
def media_collection(spark: SparkSession, d: str) -> DataFrame:
    """Garbage collection of the image manifest."""
    _, stays, gone = _media_state(spark, d, docs(spark, d))
    return stays.select("local_path", F.lit("entry kept").alias("what")).unionByName(gone.select("local_path", F.lit("file deleted").alias("what")))


# --- reading: round trips through the formats -----------------------------------------------------

_LATIN = "length(s) - length(replace(replace(s, 'Ã', ''), 'Â', '')) + (length(s) - length(replace(s, 'â€', ''))) // 2"


@query(f"""select doc_id, cast(4 * (length(s) - length(translate(s, {q.text(tx.GARBLE_MARKERS)}, ''))) + length(s) - length(replace(s, chr(65533), ''))
+ 3 * ({_LATIN}) as bigint) score from (select doc_id, substring(text, 1, 1000000) s from documents where text is not null)""")
def garble_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.garble_score(F.col("text")).alias("score"))


@query("select doc_id, sha256(text) sha from documents where text is not null")
def decoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text as UTF-8 bytes and back through the decoder of files: none of them needs a repair."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2(decode_text(F.encode("text", "UTF-8")), 256).alias("sha"))


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def _page(content: pd.Series) -> pd.DataFrame:
    pages = [html.read(c) for c in content]
    return pd.DataFrame({"title": [p.title for p in pages], "text": [p.text for p in pages]})


def _escaped(c: str) -> F.Column:
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


_SQUEEZED = r"regexp_replace(regexp_replace({}, '[ \t\r\f\v]+', ' ', 'g'), '\n{{3,}}', concat(chr(10), chr(10)), 'g')"


@query(rf"""with {q.CHUNKS} select chunk_id, {q.strip("coalesce(title, '')")} title,
{q.strip(_SQUEEZED.format("concat(case when trim(section, " + q.WS + ") <> '' then concat('## ', section, chr(10)) else '' end, chr(10), text)"))} text
from chunks_""")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as pages with furniture and read back by the HTML normaliser."""
    heading = F.when(tx.strip(F.coalesce("section", F.lit(""))) != "", F.concat(F.lit("<h2>"), _escaped("section"), F.lit("</h2>"))).otherwise("")
    page = F.concat(
        F.lit("<html><head><title>"), F.coalesce(_escaped("title"), F.lit("")), F.lit("</title><style>p {}</style></head><body><nav>x</nav>"),
        heading, F.lit("<p>"), _escaped("text"), F.lit("</p><script>1</script><footer>y</footer></body></html>"),
    )
    return chunks(spark, d).select("chunk_id", _page(page).alias("p")).select("chunk_id", "p.title", "p.text")


_MANIFEST = """m_ as (select local_path, max(source_path) source_path, max(img_index) idx, max(coalesce(alt, '')) alt, max(coalesce(src, '')) src,
max(coalesce(title, '')) title from media group by local_path)"""
_PLAIN = r"trim(regexp_replace(replace({}, '|', '\|'), '[ \t\r\f\v]+', ' ', 'g'), " + q.WS + ")"


@query(rf"""with {_MANIFEST}, rows_ as (select source_path, row_number() over (partition by source_path order by idx, local_path) n, idx, {_PLAIN.format("alt")} alt,
    {_PLAIN.format("src")} src from m_), tables_ as (select source_path, count(*) rows, string_agg('| ' || {_PLAIN.format("source_path")} || ' | ' || idx || ' | ' || alt || ' | ' || alt || ' | ' || src || ' |',
    chr(10) order by n) body from rows_ group by source_path)
select source_path, rows, {_SQUEEZED.format("concat('Table: ', source_path, chr(10), chr(10), '| source | no | alt | alt | link |', chr(10), '| --- | --- | --- | --- | --- |', chr(10), body)")} as text from tables_""")
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """The images of each page as a table whose first cell spans all rows and whose third spans two columns."""
    cell = lambda c, how="": F.concat(F.lit(f"<td{how}>"), _escaped(c), F.lit("</td>"))
    row = F.concat(cell("no"), cell("alt", " colspan='2'"), cell("src"), F.lit("</tr>"))
    rows = F.array_sort(F.collect_list(F.struct("idx", "local_path", row.alias("row"))))
    pages = _manifest(spark, d).withColumn("no", F.col("idx").cast("string")).groupBy("source_path").agg(rows.alias("each"))
    path = _escaped("source_path")
    first = F.concat(F.lit("<td rowspan='"), F.size("each").cast("string"), F.lit("'>"), path, F.lit("</td>"))
    body = F.array_join(F.transform("each", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), x["row"])), "")
    head = "<tr><th>source</th><th>no</th><th colspan='2'>alt</th><th>link</th></tr>"
    page = F.concat(F.lit("<table><caption>"), path, F.lit(f"</caption>{head}"), body, F.lit("</table>"))
    return pages.select("source_path", F.size("each").cast("bigint").alias("rows"), _page(page).alias("p")).select("source_path", "rows", "p.text")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """The images of the manifest, each once: (local_path, source_path, idx, alt, src, title)."""
    last = [F.max(F.coalesce(c, F.lit(""))).alias(c) for c in ("alt", "src", "title")]
    return table(spark, d, "media").groupBy("local_path").agg(F.max("source_path").alias("source_path"), F.max("img_index").alias("idx"), *last)


@query(rf"""with {_MANIFEST}, t_ as (select local_path, {q.strip("src")} src, {q.strip("alt")} alt, {q.strip("title")} title from m_), n_ as (select *,
    case when alt <> '' then alt when title <> '' then title else 'image-1' end label from t_)
select local_path, {q.strip(_SQUEEZED.format("concat('see it', case when src <> '' then concat(' (', src, ')') else '' end, chr(10), chr(10), '```text', chr(10), alt, chr(10), '```', chr(10), chr(10), '- `', title, '`', chr(10), case when src = '' then '' else concat(chr(10), '[Image 1: ', label, ']', case when src <> '[inline-image]' then concat(' src=', src) else '' end, chr(10), '![', label, '](', src, ')', chr(10)) end)"))} text
from n_""")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every image as a page with a link, preformatted text, code and the image itself."""
    own = _manifest(spark, d).select("local_path", *(tx.strip(F.col(c)).alias(c) for c in ("src", "alt", "title")))
    quoted = lambda c: F.replace(_escaped(c), F.lit('"'), F.lit("&quot;"))
    page = F.concat(
        F.lit('<p>see <a href="'), quoted("src"), F.lit('">it</a></p><pre>'), _escaped("alt"), F.lit("</pre><p>- <code>"), _escaped("title"),
        F.lit('</code></p><img data-src="'), quoted("src"), F.lit('" alt="'), quoted("alt"), F.lit('" title="'), quoted("title"), F.lit('">'),
    )
    return own.select("local_path", _page(page).alias("p")).select("local_path", "p.text")


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def _through_docx(title: pd.Series, section: pd.Series, text: pd.Series) -> pd.DataFrame:
    run = lambda x: f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    out = []
    for name, part, t in zip(title, section, text, strict=True):
        buf = io.BytesIO()
        cells = "".join(f"<w:tc>{run(x)}</w:tc>" for x in ("section", part or ""))
        body = "".join(map(run, t.split("\n"))) + f"<w:tbl><w:tr>{cells}</w:tr><w:tr><w:tc>{run('end')}</w:tc></w:tr></w:tbl>"
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
            z.writestr("docProps/core.xml", f'<c xmlns:d="urn:d"><d:title>{escape(name or "")}</d:title></c>')
        out.append(office.docx_text(buf.getvalue()))
    return pd.DataFrame({"title": [t for _, t in out], "text": [t for t, _ in out]})


@query(rf"""with {q.CHUNKS}, p_ as (select chunk_id, {q.strip("coalesce(title, '')")} title, {q.strip("coalesce(section, '')")} section,
list_filter(list_transform(string_split(text, chr(10)), lambda x: {q.strip('x')}), lambda x: x <> '') lines from chunks_)
select chunk_id, title, array_to_string(list_append(lines, case when section <> '' then concat('section | ', section, chr(10), 'end |') else concat('section', chr(10), 'end') end),
concat(chr(10), chr(10))) as text from (select chunk_id, title, section, lines from p_)""")
def docx_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as DOCX files, a paragraph a line, with a table and a title, and read back."""
    return chunks(spark, d).select("chunk_id", _through_docx("title", "section", "text").alias("r")).select("chunk_id", "r.title", "r.text")


@F.pandas_udf(T.StringType())
def _through_pdf(text: pd.Series) -> pd.Series:
    def literal(t: str) -> bytes:
        return b"(" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode() + b")"

    def wrap(t: str) -> bytes:
        first, gap, rest = t.partition(" ")
        shown = b"[" + literal(first) + b" -250 " + literal(rest) + b"] TJ" if first and rest else literal(t) + b" Tj"
        packed = zlib.compress(shown)
        plain = not rest or packed.endswith(b"\r") or b"endstream" in packed
        return b"%PDF-1.4\nstream\n" + (shown if plain else packed) + b"\nendstream\n%%EOF"

    return text.map(lambda t: office.pdf_text(wrap(t)))


#: the bytes of the UTF-8 form, each read as a character: content streams know no other encoding here
_BYTES = "array_to_string(list_transform(range(0, octet_length(encode(text))), lambda i: chr(cast(('0x' || substring(hex(encode(text)), 2 * i + 1, 2)) as integer))), '')"
_SHOWN = rf"replace(replace(replace({_BYTES}, '\n', chr(10)), '\r', chr(10)), '\t', chr(9))"


@query(rf"with {q.CHUNKS} select chunk_id, {q.strip(_SHOWN)} text from chunks_")
def pdf_texts(spark: SparkSession, d: str) -> DataFrame:
    """All chunks written as content streams, compressed and with arrays of strings or plain, and read back."""
    return chunks(spark, d).select("chunk_id", _through_pdf("text").alias("text"))


def _header(kind: int, w: int, h: int) -> tuple[bytes, str]:
    """The beginning of an image file of one of six forms."""
    big, little = w.to_bytes(2, "big"), lambda x, n: x.to_bytes(n, "little")
    riff = lambda form, rest: b"RIFF\0\0\0\0WEBP" + form + rest + b"\0" * 8
    return [
        (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big"), "image/png"),
        (b"GIF89a" + little(w, 2) + little(h, 2), "image/gif"),
        (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x11\x08" + h.to_bytes(2, "big") + big + b"\0" * 8, "image/jpeg"),
        (riff(b"VP8X", b"\0" * 8 + little(w - 1, 3) + little(h - 1, 3)), "image/webp"),
        (riff(b"VP8 ", b"\0" * 10 + little(w, 2) + little(h, 2)), "image/webp"),
        (riff(b"VP8L", b"\0" * 5 + little(w - 1 | h - 1 << 14, 4)), "image/webp"),
    ][kind]


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def _read_size(kind: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    sizes = []
    for k, w, h in zip(kind, width, height, strict=True):
        known = not (pd.isna(w) or pd.isna(h))
        data, mime = _header(int(k), int(w), int(h)) if known else (b"\x89PNG\r\n\x1a\n", "image/png")
        sizes.append(images.dimensions(data, mime))
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")


@query("""select distinct local_path, case when height is not null then width end width, case when width is not null then height end height from media""")
def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Image sizes written as headers of six kinds and read back; a size that isn't whole is none."""
    m = table(spark, d, "media").select("local_path", "width", "height").distinct()
    kind = F.pmod(F.xxhash64("local_path"), F.lit(6)).cast("int")
    return m.select("local_path", _read_size(kind, "width", "height").alias("s")).select("local_path", "s.width", "s.height")


def _one_line(x: str, limit: int) -> str:
    line = q.strip(rf"regexp_replace({x}, concat('[', {q.WS}, ']+'), ' ', 'g')")
    return f"case when length({line}) <= {limit} then {line} else concat(substring({line}, 1, {limit - 3}), '...') end"


@query(f"""with n_ as (select distinct local_path, img_index, src, alt, title, mime_type, width, height, ocr_text, description from media)
select local_path, concat('[Image ', img_index, ': ', case when coalesce(alt, '') <> '' then alt when coalesce(title, '') <> '' then title else concat('image-', img_index) end, ']',
case when local_path <> '' then concat(' path=', local_path) when src <> '[inline-image]' then concat(' src=', src) else '' end,
case when mime_type <> '' then concat(' mime=', mime_type) else '' end, case when width > 0 and height > 0 then concat(' size=', width, 'x', height) else '' end,
case when description <> '' then concat(' description=', {_one_line("description", 160)}) else '' end,
case when ocr_text <> '' then concat(' ocr=', {_one_line("ocr_text", 200)}) else '' end) marker from n_""")
def image_markers(spark: SparkSession, d: str) -> DataFrame:
    """The text line of every image in the manifest; long texts are cut."""
    fields = list(images.empty(0, "", "", ""))
    rows = table(spark, d, "media").withColumnRenamed("img_index", "index").select(*fields).dropDuplicates(["local_path"])

    def run(batches):
        for b in batches:
            records = b.astype(object).where(b.notna(), None).to_dict("records")
            for r in records:
                r |= {k: r[k] or "" for k in ("alt", "title", "ocr_text", "description", "local_path", "mime_type")}
                r |= {k: None if r[k] is None else int(r[k]) for k in ("width", "height")}
            yield pd.DataFrame({"local_path": b["local_path"], "marker": [images.marker(r) for r in records]})

    return rows.mapInPandas(run, "local_path string, marker string")
