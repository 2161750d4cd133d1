"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import boilerplate, encoding, lookalike, mixing, neardup, packing, scans, spam
from textquarry.llm.common import store, table
from textquarry.llm.tokens import token_counts


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_cases(table(spark, d, "parsed_documents"), table(spark, d, "media"))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_text(table(spark, d, "parsed_documents"), table(spark, d, "media"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_cases(table(spark, d, "chunks"), "chunk_id", ["title", "text"]).select(
        F.col("key").alias("chunk_id"), "fld"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = boilerplate.furniture_lines(table(spark, d, "parsed_documents"))
    return found.select(F.col("key").alias("doc_id"), "line_no")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.members(table(spark, d, "chunks"), "chunk_id", "text")
    return neardup.grouped_pairs(found).select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk once with its group, named by the least chunk_id in it; most groups are single."""
    chunks = table(spark, d, "chunks")
    found = store(neardup.members(chunks, "chunk_id", "text").select(F.col("key").alias("chunk_id"), "grp").distinct())
    names = found.groupBy("grp").agg(F.min("chunk_id").alias("name"))
    named = found.join(names, "grp").groupBy("chunk_id").agg(F.min("name").alias("name"))
    return (
        chunks.select("chunk_id")
        .distinct()
        .join(named, "chunk_id", "left")
        .select("chunk_id", F.coalesce("name", "chunk_id").alias("group_id"))
    )


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """Titles and texts of all chunks in their canonical form."""
    rows = table(spark, d, "chunks").select("chunk_id", "title", "text").dropDuplicates(["chunk_id"])
    return lookalike.canonical_text(rows, "chunk_id", ["title", "text"])


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """Every html page with its main body only."""
    return boilerplate.main_text(table(spark, d, "parsed_documents")).select(F.col("key").alias("doc_id"), "text")


def _dictionaries(spark: SparkSession, d: str) -> dict[str, bytes]:
    return encoding.train(
        table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "lang"),
        table(spark, d, "parsed_documents").where("source_type = 'html'").select(F.col("doc_id").alias("key"), "text"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    dictionaries = _dictionaries(spark, d)
    parsed = encoding.garbled_cases(table(spark, d, "parsed_documents"), "doc_id", "text", dictionaries)
    titles = encoding.garbled_cases(table(spark, d, "documents"), "doc_id", "title", dictionaries)
    return parsed.select(F.lit("parsed_documents").alias("tbl"), F.col("key").alias("rec_key")).unionByName(
        titles.select(F.lit("documents").alias("tbl"), F.col("key").alias("rec_key"))
    )


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[tuple[str, int]]]:
    specs = [tuple(r) for r in table(spark, d, "container_specs").select("container_kind", "capacity_tokens").collect()]
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text")
    return *packing.pack(sizes, specs), specs


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text with its container, for each kind of container."""
    packed, _, _ = _packed(spark, d)
    return packed.select("container_kind", "container_id", F.col("key").alias("doc_id"), "piece_no", "start", "len")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, with their lower bound and what tightest fit alone would need."""
    return packing.report(*_packed(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every record with tokens and how many times it is used, with its source's actual share."""
    targets = table(spark, d, "source_targets")
    mixed = store(mixing.mix(table(spark, d, "documents"), targets))
    share = mixing.shares(mixed, targets).select(F.coalesce("source", F.lit("")).alias("s"), "target_share", "actual_share")
    return (
        mixed.join(F.broadcast(share), F.coalesce("source", F.lit("")) == F.col("s"), "left")  # one row a source
        .where("repeats > 0")
        .select(F.col("key").alias("doc_id"), "source", "tokens", "repeats", "target_share", "actual_share")
    )


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "source_targets")
    return mixing.shares(store(mixing.mix(table(spark, d, "documents"), targets)), targets)


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    """Every parsed text and document title as it was meant, with the number of garbled lines."""
    dictionaries = _dictionaries(spark, d)
    out = []
    for tbl, key, field in (("parsed_documents", "doc_id", "text"), ("documents", "doc_id", "title")):
        rows = table(spark, d, tbl).select(key, field).dropDuplicates([key])
        fixed = encoding.repair(rows, key, field, dictionaries)
        out.append(fixed.select(F.lit(tbl).alias("tbl"), F.col("key").alias("rec_key"), "text", "garbled"))
    return out[0].unionByName(out[1])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents")).select(F.col("key").alias("doc_id")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_text, p2_found, p2_text, p3_found, p3_text, p4_found, p4_groups, p5_found, p5_text,
        p6_containers, p6_fill, p7_mix, p7_shares, p8_found,
    )
}
_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}\x{FE0F}"
_LINKS = """
c as (select distinct chunk_id, text from chunks where text is not null),
t as (select text, row_number() over (order by text) id from (select distinct text from c)),
s as (select distinct id, substring(text, unnest(range(1, length(text) - 3)), 5) g from t where length(text) >= 5),
n as (select id, count(*) n from s group by id),
p as (select a.id a, b.id b, count(*) k from s a join s b on a.g = b.g and a.id < b.id group by a.id, b.id),
l as (select a, b from p join n x on x.id = a join n y on y.id = b where k >= 0.7 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select id a, id b from t union select r.a, e.b from r join e on r.b = e.a),
g as (select a id, min(b) grp from r group by a),
m as (select c.chunk_id, g.grp from c join t using (text) join g using (id))"""

#: brute force in SQL: every pair of texts that share a substring is counted
SQL = {
    "p2_found": rf"""
with v as (select distinct chunk_id, unnest(['title', 'text']) fld, unnest([title, text]) val from chunks),
w as (select chunk_id, fld, val, list_filter(regexp_extract_all(val, '[\p{{Latin}}\p{{Cyrillic}}\p{{Greek}}\p{{M}}\p{{Nd}}]+'),
  lambda x: regexp_matches(x, '\p{{Latin}}') and regexp_matches(x, '[\p{{Cyrillic}}\p{{Greek}}]')) mixed from v where val is not null)
select chunk_id, fld from w where len(mixed) > 0 or nfc_normalize(val) <> val
  or regexp_matches(val, '[\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}]')
  or regexp_matches(val, '[\x{{A0}}\x{{2007}}\x{{202F}}\x{{200B}}\x{{200C}}\x{{2060}}\x{{FEFF}}]')
  or contains(regexp_replace(val, '[{_EMOJI}]\x{{200D}}', '', 'g'), chr(8205))""",
    "p4_found": f"""with recursive {_LINKS} select x.chunk_id chunk_id_a, y.chunk_id chunk_id_b
from m x join m y on x.grp = y.grp and x.chunk_id < y.chunk_id""",
    "p4_groups": f"""with recursive {_LINKS}, k as (select chunk_id, min(chunk_id) over (partition by grp) name from m)
select distinct c.chunk_id, coalesce(k.name, c.chunk_id) group_id from chunks c left join k using (chunk_id)""",
}
