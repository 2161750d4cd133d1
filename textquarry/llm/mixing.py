"""Problem 7: mixing sources to target weights.

Sources are domains, and every record belongs to all of them softly. A naive Bayes classifier over
hashed words, trained on a bounded sample of the labelled records, predicts the posteriors of each
record, labelled or not. How far its likelihoods can be trusted is one exponent, chosen by the
least logarithmic loss on held-out labelled records: where words don't tell the sources apart, the
posteriors come out as the sources' frequencies. A record's label takes the place of those
frequencies: it is right with probability :data:`LABEL_TRUST` before the words are seen, so that a
labelled record belongs to its own source nearly, and by how much depends on its words. Every record d has a rate
0 <= r_d <= cap, the cap being its source's ``max_repeats`` (1 without a source, 0 for a source
that isn't listed). The rates minimise

    sum_s (sum_d r_d tokens_d P(s|d) / T - goal_s)^2

(the goals are the targets, with the part of sources without supply spread over the others, which
is the least-squares choice) by projected gradient: each step is one distributed aggregation of the
expected domain totals, and a record's rate is a fold over the gradients so far, so no state is
written between steps. What the words say is kept to a small fraction, so that records with equal
posteriors and cap, which always have equal rates, are summed up before the iteration. T is a
parameter. Without it, it is the largest total at which every source with any supply can still
reach its share, as the problem asks for; :func:`shares` gives the total that each source by itself
would allow, and so what limits the mix, and a larger T is met as nearly as caps allow.

Rates become whole repetitions: the integer part for all records of a stratum, and once more for
those whose hash, divided by the rest of the rate, lies below a bound that is set on the histogram
of the stratum's tokens, so that the totals are met up to about one record.

Defined results: null texts and texts without tokens are never selected; a listed source without
records gets a share of 0, and the others share its part; null and unlisted sources appear in the
report as rows without target; an empty documents table gives shares of 0 and no records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import spread, store
from textquarry.llm.tokens import token_counts

#: labelled records that train the classifier, about, and the hashed features
TRAIN_ROWS, FEATURES = 20_000, 1 << 14
#: one labelled record in so many measures how far the classifier can be trusted
HELD_OUT = 10
#: exponents of the likelihoods that are tried
EXPONENTS = (1.0, 0.5, 0.25, 0.12, 0.06, 0.03, 0.015, 0.008, 0.004, 0.002, 0.0)
#: probability that the source of a record is its domain
LABEL_TRUST = 0.99
#: what words say of a domain, against the likeliest one, is kept in so many steps
PARTS = 16
STEPS, TOLERANCE = 40, 1e-6
#: buckets of the hash histogram, on each of two levels
BUCKETS = 512


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}{1,2}|[\p{L}\p{N}_]{2,}"), F.lit(0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` has it in several places or for each element."""
    return F.transform(F.array(value), use)[0]


class Classifier:
    """Domain posteriors from words, with its accuracy and loss on held-out labelled records."""

    def __init__(self, labelled: DataFrame, domains: list[str]):
        """``labelled`` has (key, text, source); classes without any record have probability 0."""
        self.domains = domains
        mapped = F.create_map(*(x for i, s in enumerate(domains) for x in (F.lit(s), F.lit(float(i)))))
        share = min(1.0, TRAIN_ROWS / max(1, labelled.count()))
        chosen = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
        rows = store(self._vectors(chosen.withColumn("label", mapped[F.col("source")]), "label"))
        held_out = F.pmod(F.hash("key"), F.lit(HELD_OUT)) == 0
        parts = {(int(r["label"]), r["held"]): r["n"] for r in rows.groupBy("label", held_out.alias("held")).agg(F.count("*").alias("n")).collect()}
        counts = [parts.get((i, False), 0) + parts.get((i, True), 0) for i in range(len(domains))]
        self.total = sum(counts)
        self.prior = [n / max(1, self.total) for n in counts]
        self.exponent, self.accuracy, self.loss = 0.0, None, None
        if not self.total:
            return
        tested = sum(n for (_, held), n in parts.items() if held)
        alone = tested and tested < self.total
        self.model = NaiveBayes(featuresCol="features", labelCol="label", smoothing=0.1).fit(rows.where(~held_out) if alone else rows)
        if not alone:
            self.exponent = 1.0
            return
        judged = self._scored(rows.where(held_out), "label")
        own = F.col("label").cast("int") + 1
        losses = [F.avg(-F.log(F.greatest(F.lit(1e-12), F.element_at(self._posterior(e), own)))).alias(f"l{i}") for i, e in enumerate(EXPONENTS)]
        hit = F.avg((F.array_position(F.col("score"), F.array_max("score")) == own).cast("double")).alias("hit")
        found = judged.agg(hit, *losses).first()
        self.accuracy = found["hit"]
        self.loss, best = min((found[f"l{i}"], i) for i in range(len(EXPONENTS)))
        self.exponent = EXPONENTS[best]

    def _vectors(self, df: DataFrame, *keep: str) -> DataFrame:
        words = df.select("key", *keep, F.coalesce(_words(F.col("text")), F.array().cast("array<string>")).alias("words"))
        return HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES).transform(words).drop("words")

    def _scored(self, vectors: DataFrame, *keep: str) -> DataFrame:
        """(key, *keep, score): the log likelihood of each domain."""
        raw = vector_to_array("rawPrediction")
        prior = F.array(*(F.lit(float(x)) for x in self.model.pi.toArray()))
        return self.model.transform(vectors).select("key", *keep, F.zip_with(raw, prior, lambda r, p: r - p).alias("score"))

    def _evidence(self, exponent: float) -> Column:
        """Of (score): what the words say of each domain against the likeliest one; 0 to 1."""
        score = F.concat("score", F.array_repeat(F.lit(0.0), len(self.domains)))  # the model knows classes up to the last one it saw
        known = F.array(*(F.lit(x > 0) for x in self.prior))
        own = F.slice(score, 1, len(self.domains))
        return _once(F.array_max("score"), lambda top: F.zip_with(known, own, lambda k, x: F.when(k, F.exp(exponent * (x - top))).otherwise(0.0)))

    def _posterior(self, exponent: float) -> Column:
        return membership(self._evidence(exponent), F.lit(None).cast("int"), self.prior)

    def evidence(self, df: DataFrame) -> DataFrame:
        """(key, e): what the words of each row of ``df`` (key, text) say, in :data:`PARTS` steps."""
        if not self.total:
            return df.select("key", F.array(*(F.lit(0.0) for _ in self.domains)).alias("e"))
        e = self._evidence(self.exponent)
        # a domain with records is never ruled out
        steps = F.transform(e, lambda x: F.when(x > 0, F.greatest(F.lit(0.5), F.round(x * PARTS)) / PARTS).otherwise(0.0))
        return self._scored(self._vectors(df)).select("key", steps.alias("e"))

    def posteriors(self, df: DataFrame) -> DataFrame:
        """(key, p): for each row of ``df`` (key, text) the probabilities of the domains."""
        return self.evidence(df).select("key", membership(F.col("e"), F.lit(None).cast("int"), self.prior).alias("p"))


def membership(evidence: Column, own: Column, prior: list[float], trust: float = LABEL_TRUST) -> Column:
    """The posteriors of a record whose source has the index ``own`` (null: none is known)."""
    other = (1 - trust) / max(1, len(prior) - 1)
    known = F.array(*(F.lit(float(x)) for x in prior))

    def weights(own: Column) -> Column:
        return F.transform(evidence, lambda e, i: e * F.when(own.isNull(), known[i]).when(own == i, trust).otherwise(other))

    def shares(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
        return _once(total, lambda total: F.when(total > 0, F.transform(weights, lambda x: x / total)).otherwise(weights))

    return _once(_once(own, weights), shares)


def _rate(p: Column, cap: Column, start: float, gradients: list[list[float]]) -> Column:
    """A record's rate after the given steps: move against each gradient, project on [0, cap]."""
    r = F.least(F.lit(start), cap)
    if not gradients:
        return r
    steps = F.array(*(F.array(*(F.lit(float(g)) for g in step)) for step in gradients))

    def move(acc: Column, step: Column) -> Column:
        along = F.aggregate(F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        return F.greatest(F.lit(0.0), F.least(cap, acc - along))

    return F.aggregate(steps, r.cast("double"), move)


def fit_rates(
    strata: DataFrame, targets: list[float], supply: list[float], caps: list[int], total: float | None = None
) -> tuple[Column, float]:
    """The rate of a stratum as an expression of its columns (p, cap), and the total T.

    ``strata`` has (p, cap, tokens); each step is one aggregation over it. ``supply`` has the
    tokens of the records of each source.
    """
    m = len(targets)
    have = [s for s in range(m) if supply[s] > 0 and targets[s] > 0]
    if not have:
        return F.lit(0.0), 0.0
    missing = 1.0 - sum(targets[s] for s in have)
    goal = [targets[s] + missing / len(have) if s in have else 0.0 for s in range(m)]
    if total is None:
        total = min(caps[s] * supply[s] / goal[s] for s in have)
    start = min(1.0, total / sum(supply))
    gradients: list[list[float]] = []
    last: list[float] = []

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.zeros(m)
        for b in batches:
            p, cap = np.stack(b["p"].to_numpy()) if len(b) else np.zeros((0, m)), b["cap"].to_numpy(float)
            r = np.minimum(start, cap)
            for g in gradients:
                r = np.clip(r - p @ np.array(g), 0.0, cap)
            t += (r * b["tokens"].to_numpy(float)) @ p
        yield pd.DataFrame({"t": [t.tolist()]})

    rows = strata.select("p", "cap", "tokens")
    for _ in range(STEPS):
        parts = rows.mapInPandas(sums, "t array<double>").collect()  # one row a partition
        got = np.sum([r["t"] for r in parts], axis=0)
        off = [float(got[s]) / total - goal[s] for s in range(m)]
        if max(map(abs, off)) < TOLERANCE or last and max(abs(x - y) for x, y in zip(off, last, strict=True)) < TOLERANCE:
            break
        last = off
        # scaled by each domain's own curvature, so that small sources move as fast as large ones
        gradients.append([off[s] * total / supply[s] if supply[s] > 0 else 0.0 for s in range(m)])
    p, cap = F.col("p"), F.col("cap").cast("double")
    return _rate(p, cap, start, gradients), total


def mix(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None
) -> DataFrame:
    """(key, source, tokens, p, accuracy, repeats) of every record with tokens; repeats may be 0.

    ``p`` is the record's membership in the domains, in the order of their names; ``accuracy`` is
    that of the classifier on held-out records, the same in every row.
    """
    listed = sorted(targets.select("source", "target_share", "max_repeats").where("source is not null").collect())
    domains = [r["source"] for r in listed]  # the table of targets is small by its nature
    if not domains:
        raise ValueError("no targets")
    named = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where("text is not null")
    model = Classifier(named.where(F.col("source").isin(domains)), domains)
    cap_of = F.create_map(*(x for r in listed for x in (F.lit(r["source"]), F.lit(int(r["max_repeats"])))))
    index = F.create_map(*(x for i, s in enumerate(domains) for x in (F.lit(s), F.lit(i))))
    said = model.evidence(spread(named)).dropDuplicates(["key"])
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = store(
        token_counts(named, "key", "text", keep=("source",))
        .where("tokens > 0")
        .join(said, "key")
        .repartition(tasks)  # few bytes, but dear: left to the size of the data, too few tasks would do it
        .select(
            "key",
            "source",
            "tokens",
            membership(F.col("e"), index[F.col("source")], model.prior).alias("p"),
            F.when(F.col("source").isNull(), 1).otherwise(F.coalesce(cap_of[F.col("source")], F.lit(0))).alias("cap"),
            F.coalesce("source", F.lit("\0")).alias("stratum"),
            F.pmod(F.xxhash64("key"), F.lit(BUCKETS * BUCKETS)).alias("h"),
        )
    )
    strata = store(sized.groupBy("stratum", "p", "cap").agg(F.sum("tokens").alias("tokens")))
    supplies = {r["stratum"]: r["t"] for r in strata.where(F.col("stratum").isin(domains)).groupBy("stratum").agg(F.sum("tokens").alias("t")).collect()}
    rate, _ = fit_rates(
        strata.where("cap > 0"),
        [float(r["target_share"]) for r in listed],
        [float(supplies.get(s, 0)) for s in domains],
        [int(r["max_repeats"]) for r in listed],
        total,
    )
    whole = F.floor(F.col("rate") + 1e-9)
    rated = sized.withColumn("rate", rate).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - whole))
    # the hash over twice the part: where parts differ, records are taken in proportion to them
    last = F.lit(BUCKETS * BUCKETS - 1)
    rated = rated.withColumn("u", F.least(last, F.when(F.col("part") > 0, F.floor(F.col("h") / (2 * F.col("part")))).otherwise(last)))
    bounds = _bounds(rated)
    return (
        rated.join(F.broadcast(bounds), "stratum", "left")  # one row a source
        .withColumn("repeats", F.least(F.col("cap"), whole + (F.col("u") < F.coalesce("bound", F.lit(0))).cast("int")).cast("int"))
        .select("key", "source", "tokens", "p", F.lit(model.accuracy).cast("double").alias("accuracy"), "repeats")
    )


def _bounds(rated: DataFrame) -> DataFrame:
    """(stratum, bound): the hash below which the tokens add up to the fractional part of the rates."""
    wanted: dict[str, float] = {}
    hist: dict[str, dict[int, int]] = {}
    for r in (
        rated.groupBy("stratum", F.expr(f"u div {BUCKETS}").alias("b"))
        .agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("part")).alias("w"))
        .collect()  # at most BUCKETS rows a source
    ):
        wanted[r["stratum"]] = wanted.get(r["stratum"], 0.0) + r["w"]
        hist.setdefault(r["stratum"], {})[r["b"]] = r["t"]
    edge: dict[str, tuple[int, float]] = {}
    for s, by in hist.items():
        left = wanted[s]
        for b in sorted(by):
            if by[b] > left:
                edge[s] = (b, left)
                break
            left -= by[b]
        else:
            edge[s] = (BUCKETS, 0.0)
    spark = rated.sparkSession
    schema = "stratum string, b bigint, rest double"
    edges = spark.createDataFrame([(s, b, r) for s, (b, r) in edge.items()], schema)
    fine: dict[str, dict[int, int]] = {}
    within = rated.withColumn("b", F.expr(f"u div {BUCKETS}")).join(F.broadcast(edges), ["stratum", "b"])
    for r in within.groupBy("stratum", F.expr(f"u % {BUCKETS}").alias("c")).agg(F.sum("tokens").alias("t")).collect():
        fine.setdefault(r["stratum"], {})[r["c"]] = r["t"]
    bound = []
    for s, (b, left) in edge.items():
        at = b * BUCKETS
        for c in sorted(fine.get(s, {})):
            t = fine[s][c]
            if t > 2 * left:  # rather without this record than with it
                break
            left -= t
            at = b * BUCKETS + c + 1
        bound.append((s, at))
    return spark.createDataFrame(bound, "stratum string, bound bigint")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: its target and supply, and what was selected of it.

    (source, target_share, max_repeats, records, tokens, selected_tokens, actual_share,
    expected_share, most_total, accuracy): ``actual_share`` is the share of the records that name
    the source, ``expected_share`` that of the domain by the memberships of all selected records,
    ``most_total`` the size of the mix at which the source can just reach its target.
    """
    domains = sorted(r["source"] for r in targets.select("source").where("source is not null").collect())
    used = F.col("tokens") * F.col("repeats")
    sums = mixed.groupBy("source").agg(
        F.count("*").alias("records"),
        F.sum("tokens").alias("tokens"),
        F.sum(used).alias("selected_tokens"),
        F.max("accuracy").alias("accuracy"),
        F.array(*(F.sum(used * F.col("p")[i]) for i in range(len(domains)))).alias("expected"),
    )
    own = store(sums)  # one row a source
    row = own.agg(
        F.sum("selected_tokens").alias("total"), F.max("accuracy").alias("accuracy"), *(F.sum(F.col("expected")[i]).alias(f"e{i}") for i in range(len(domains)))
    ).first()
    total = max(1, row["total"] or 0)
    expected = F.create_map(*(x for i, s in enumerate(domains) for x in (F.lit(s), F.lit((row[f"e{i}"] or 0.0) / total))))
    joined = own.drop("accuracy").join(targets.select("source", "target_share", "max_repeats"), "source", "full_outer")
    selected = F.coalesce("selected_tokens", F.lit(0))
    tokens = F.coalesce("tokens", F.lit(0))
    return joined.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("records", F.lit(0)).alias("records"),
        tokens.alias("tokens"),
        selected.alias("selected_tokens"),
        (selected / F.lit(total)).alias("actual_share"),
        expected[F.col("source")].alias("expected_share"),
        F.try_divide(tokens * F.col("max_repeats"), F.col("target_share")).alias("most_total"),
        F.lit(row["accuracy"]).cast("double").alias("accuracy"),
    )
