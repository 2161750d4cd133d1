"""Ranked search in three stages, each a plan over the index tables.

Results are ordered by (stage, score, tie-break) and cut to the limit; a result of a later stage
is one that no earlier stage found. Stages two and three only run for queries with Han characters.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import ascii_lower, fold_token, folded, has_han, query_tokens, term_groups
from textquarry.model import TOP_K
from textquarry.operators.index import FIELDS, tokens_of_chunk

K1, B = 1.2, 0.75
RESULT = ("chunk_id", "doc_id", "source_path", "source_type", "title", "section", "chunk_index", "text")


def limit_of(top_k: int | None) -> int:
    """0 and None mean the default; a negative number means all."""
    return top_k or TOP_K


def _cut(df: DataFrame, top_k: int | None) -> DataFrame:
    n = limit_of(top_k)
    return df if n < 0 else df.limit(n)


def _of_type(chunks: DataFrame, source_type: str | None) -> DataFrame:
    return chunks.where(F.col("source_type") == source_type) if source_type else chunks


def _scored(matches: DataFrame, tokens: list[str]) -> DataFrame:
    """Add ``score`` to rows with tf0, tf1, ..., dl and the corpus numbers ``c``; smaller is better."""
    total = F.lit(0.0)
    for i in range(len(tokens)):
        tf, df = F.col(f"tf{i}"), F.col(f"c.df{i}")
        idf = F.log((F.col("c.n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("c.avgdl")))
    return matches.withColumn("score", F.round(-total, 6))


def _times(token: str) -> Column:
    return F.size(F.filter("tokens", lambda x: x == token))


def _counted(chunks: DataFrame, tokens: list[str]) -> DataFrame:
    """(*RESULT, dl, tf0, ...): the length of each chunk and how often each token occurs."""
    return chunks.withColumn("tokens", tokens_of_chunk()).select(
        *RESULT, F.size("tokens").alias("dl"), *(_times(t).alias(f"tf{i}") for i, t in enumerate(tokens))
    )


def bm25(chunks: DataFrame, query: str, mode: str = "any", source_type: str | None = None, top_k: int | None = None) -> DataFrame:
    """Full-text search over a chunk table: (*RESULT, score), best first.

    Without a stored index the chunks are read twice: the corpus numbers need the tokens of all of
    them, the results only those of chunks that hold a token of the query as a substring.
    """
    tokens = [fold_token(t) for t in query_tokens(query)]
    counted = _counted(chunks, tokens)
    if not tokens:
        return counted.limit(0).select(*RESULT, F.lit(0.0).alias("score"))
    whole = folded(F.concat_ws("\n", *FIELDS))
    held = chunks.where(functools.reduce(lambda a, b: a | b, (F.contains(whole, F.lit(t)) for t in tokens)))
    numbers = counted.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("dl").alias("avgdl"),
            *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(tokens))),
        ).alias("c")
    )
    hit = [F.col(f"tf{i}") > 0 for i in range(len(tokens))]
    match = hit[0]
    for h in hit[1:]:
        match = match | h if mode == "any" else match & h
    found = _of_type(_counted(held, tokens), source_type).where(match).withColumn("c", numbers.scalar())
    ranked = _scored(found, tokens).select(*RESULT, "score").orderBy("score", "chunk_id")
    return _cut(ranked, top_k)


def bm25_postings(
    index: DataFrame, dl: DataFrame, chunks: DataFrame, query: str, mode: str = "any", source_type: str | None = None, top_k: int | None = None
) -> DataFrame:
    """The same from the stored index: only the postings of the query's tokens are read."""
    tokens = [fold_token(t) for t in query_tokens(query)]
    if not tokens:
        return chunks.limit(0).select(*RESULT, F.lit(0.0).alias("score"))
    rows = index.where(F.col("term").isin(*set(tokens)))
    tf = rows.groupBy("chunk_id").agg(
        *(F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(tokens))
    )
    numbers = dl.agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).alias("c")).scalar()
    df = rows.agg(F.struct(*(F.count(F.when(F.col("term") == t, 1)).alias(f"df{i}") for i, t in enumerate(tokens))).alias("c")).scalar()
    if mode != "any":
        for i in range(len(tokens)):
            tf = tf.where(F.col(f"tf{i}") > 0)
    keep = _of_type(chunks, source_type)
    found = tf.join(dl, "chunk_id").withColumn("a", numbers).withColumn("b", df)
    found = found.withColumn("c", F.struct("a.*", "b.*"))
    ranked = _scored(found, tokens).select("chunk_id", "score")
    if source_type:
        ranked = ranked.join(keep.select("chunk_id"), "chunk_id", "left_semi")
    top = _cut(ranked.orderBy("score", "chunk_id"), top_k)
    return top.join(chunks.select(*RESULT), "chunk_id").select(*RESULT, "score").orderBy("score", "chunk_id")


def term_matches(term_index: DataFrame, query: str, mode: str = "any") -> DataFrame:
    """(chunk_id): chunks with a term of any group, or of all groups that have a hit at all."""
    groups = [(i, t) for i, ts in enumerate(term_groups(query)) for t in ts]
    spark = term_index.sparkSession
    wanted = spark.createDataFrame(groups, "grp int, term string")
    hits = term_index.where(F.col("term").isin(*{t for _, t in groups})) if groups else term_index.limit(0)
    hits = hits.join(F.broadcast(wanted), "term").select("chunk_id", "grp").distinct()  # as long as the query
    if mode == "any":
        return hits.select("chunk_id").distinct()
    alive = hits.agg(F.count_distinct("grp").alias("alive")).scalar()
    return hits.groupBy("chunk_id").agg(F.count("*").alias("k")).where(F.col("k") == alive).select("chunk_id")


def term_search(chunks: DataFrame, term_index: DataFrame, query: str, mode: str = "any", source_type: str | None = None, top_k: int | None = None) -> DataFrame:
    """Search by indexed n-grams, in document order: (*RESULT, score)."""
    found = _of_type(chunks, source_type).join(term_matches(term_index, query, mode), "chunk_id", "left_semi")
    return _cut(found.select(*RESULT, F.lit(0.0).alias("score")).orderBy("source_path", "chunk_index", "chunk_id"), top_k)


def contains_token(token: str) -> Column:
    """Whether a token stands anywhere in title, section, text or path, ASCII case ignored."""
    low = ascii_lower(F.lit(token))
    hit = F.lit(False)
    for c in ("title", "section", "text", "source_path"):
        hit = hit | F.coalesce(F.contains(ascii_lower(F.col(c)), low), F.lit(False))
    return hit


def substring_search(chunks: DataFrame, query: str, mode: str = "any", source_type: str | None = None, top_k: int | None = None) -> DataFrame:
    """Search by substring over all chunks, in document order: (*RESULT, score)."""
    tokens = query_tokens(query)
    cond = F.lit(bool(tokens)) if mode != "any" else F.lit(False)
    for t in tokens:
        cond = cond | contains_token(t) if mode == "any" else cond & contains_token(t)
    found = _of_type(chunks, source_type).where(cond)
    return _cut(found.select(*RESULT, F.lit(0.0).alias("score")).orderBy("source_path", "chunk_index", "chunk_id"), top_k)


def staged_search(chunks: DataFrame, term_index: DataFrame, query: str, mode: str = "any", source_type: str | None = None, top_k: int | None = None) -> DataFrame:
    """All stages as one plan: (*RESULT, stage, score), best first.

    Only ids and sort keys of the matches are put together; each chunk keeps its first stage, and
    the texts are joined to the few rows that remain. The first stage is cut to the limit, which
    can't lose a result: where it is longer, no later stage counts.
    """
    keys = ("chunk_id", "source_path", "chunk_index")
    place = lambda df, stage: df.select("chunk_id", F.struct(F.lit(stage).alias("stage"), F.lit(0.0).alias("score"), F.col("source_path").alias("p"), F.col("chunk_index").alias("i")).alias("k"))  # noqa: E731, E501
    found = bm25(chunks, query, mode, source_type, top_k).select(
        "chunk_id",
        F.struct(F.lit(1).alias("stage"), F.col("score"), F.lit("").alias("p"), F.lit(0).cast("bigint").alias("i")).alias("k"),
    )
    if has_han(query):
        typed = _of_type(chunks, source_type)
        two = typed.select(*keys).join(term_matches(term_index, query, mode), "chunk_id", "left_semi")
        three = substring_search(chunks, query, mode, source_type, -1).select(*keys)
        found = found.unionByName(place(two, 2)).unionByName(place(three, 3))
    ranked = found.groupBy("chunk_id").agg(F.min("k").alias("k")).orderBy("k", "chunk_id")
    top = _cut(ranked, top_k).select("chunk_id", "k.*")
    return (
        top.join(chunks.select(*RESULT), "chunk_id").orderBy("stage", "score", "p", "i", "chunk_id").select(*RESULT, "stage", "score")
    )


def plain_snippet(text: Column, query: str, width: int = 240) -> Column:
    """Part of the text around the first query token that occurs in it."""
    from textquarry.functions.text import strip

    low = F.lower(text)
    at = F.lit(0)
    for t in reversed(query_tokens(query)):
        here = F.locate(t.lower(), low)
        at = F.when(here > 0, here - 1).otherwise(at)
    start = F.greatest(F.lit(0), at - width // 3)
    end = F.least(F.char_length(text), start + width)
    return F.concat(
        F.when(start > 0, "...").otherwise(""),
        strip(F.substring(text, start + 1, F.lit(width))),
        F.when(end < F.char_length(text), "...").otherwise(""),
    )


WINDOW = 18
_TOKENS = re.compile(r"(?:[^\W_]|[_.$/@:#-])+")


def window_snippet(text: str, tokens: list[str]) -> str:
    """The window of :data:`WINDOW` tokens with most distinct query tokens, hits in brackets."""
    spans = [(m.start(), m.end()) for m in _TOKENS.finditer(text)]
    words = [fold_token(text[a:b]) for a, b in spans]
    wanted = set(tokens)
    hits = [i for i, w in enumerate(words) if w in wanted]
    n = len(spans)

    def worth(start: int) -> int:
        seen: set[str] = set()
        value = 0
        for i in hits:
            if start <= i < start + WINDOW:
                value += 1 if words[i] in seen else 1000
                seen.add(words[i])
        return value

    # a sentence opens the text, or follows white space behind a full stop or colon
    opens = [i for i, (a, _) in enumerate(spans) if i == 0 or a >= 2 and text[a - 1].isspace() and text[a - 2 : a - 1] and text[:a].rstrip()[-1:] in ".:"]
    best, start = -1, 0
    for p in hits:
        centred = max(0, min(p - (WINDOW - 1) // 2, n - WINDOW))
        options = [(worth(p), centred)]
        if n > WINDOW:
            s = max((o for o in opens if o <= p), default=p)
            if s < p:
                options.append((worth(s) + (120 if s == 0 else 100), s))
        for value, at in options:
            if value > best:
                best, start = value, at
    last = min(n, start + WINDOW) - 1
    out, pos = [], spans[start][0] if start and n else 0
    for i in range(start, last + 1):
        a, b = spans[i]
        out.append(text[pos:a])
        out.append(f"[{text[a:b]}]" if words[i] in wanted else text[a:b])
        pos = b
    tail = text[pos:] if last >= n - 1 else "..."
    return ("..." if start else "") + "".join(out) + tail


def with_snippets(results: DataFrame, query: str) -> DataFrame:
    """Add ``snippet`` to the few rows of a result."""
    tokens = [fold_token(t) for t in query_tokens(query)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["snippet"] = [window_snippet(t or "", tokens) for t in b["text"]]
            yield b

    schema = ", ".join(f"{c} {t}" for c, t in results.dtypes) + ", snippet string"
    return results.mapInPandas(run, schema)


def neighbours(chunks: DataFrame, hits: DataFrame, radius: int) -> DataFrame:
    """(hit_id, chunk_id, distance): the chunks of the same document within ``radius`` of each hit.

    An equi-join on document and position: each hit asks for its 2 * radius positions.
    """
    if radius <= 0:
        return chunks.limit(0).select(F.col("chunk_id").alias("hit_id"), "chunk_id", F.lit(0).alias("distance"))
    offsets = F.array(*(F.lit(i) for i in range(-radius, radius + 1) if i))
    asked = hits.select(F.col("chunk_id").alias("hit_id"), "doc_id", "chunk_index", F.explode(offsets).alias("distance"))
    asked = asked.withColumn("chunk_index", F.col("chunk_index") + F.col("distance"))
    return asked.join(chunks.select("doc_id", "chunk_index", "chunk_id"), ["doc_id", "chunk_index"]).select("hit_id", "chunk_id", "distance")
