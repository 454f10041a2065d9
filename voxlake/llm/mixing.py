"""Soft-membership mixing to target weights, in DataFrame functions only.

A naive Bayes classifier over words learns from a labelled table ``(doc_id,
domain)`` and gives every document a posterior over the domains. Document rates
r >= 0 are then fitted so that the expected tokens of each domain,
``sum over documents of rate * tokens * posterior``, match the target weights.

The fit is a projected gradient descent on the least squares problem. Residuals
are scaled by the tokens each domain has, steps by the tokens of a document; in
that metric no eigenvalue exceeds one, so the full step is stable, and a
document's step depends on its posterior only. A round is one aggregation over
the documents that returns one number for each domain; rates stay on the
executors as an expression over the posteriors, cut by a written table every
``CUT`` rounds. Rounds end when every domain is within ``TOLERANCE`` of its
target; a fit that ``ROUNDS`` rounds leave further off is reported (a warning, and
``fit_error`` of every row: the largest distance from a target, as a share of the
budget). Steps are accelerated (each starts ahead of the last
rate, on the line through the last two) and restart when a residual rises.

The classifier learns from a bounded sample, ``SAMPLE`` labelled documents and
``SAMPLE_BYTES`` of text at most (least hash of doc_id, whole texts), and knows
every word of it; so its table, which is broadcast, has fewer words than the
sample has bytes. All other numbers come from all documents.

By default the token budget is the least one that asks no domain for less than
it has: a document is repeated rather than dropped. Copies are the rate rounded
down, plus one for a share of the documents, chosen by a hash of doc_id, that
equals the fraction. ``floor`` raises the least rate above 0.

Defined results: a null text counts as empty, has no tokens and its posterior
is the prior; rows with equal doc_id and text have equal results; domains
without a target are ignored in learning, domains without a labelled document
get posterior 0 and their target is shared out; with no labelled document at
all every rate is 1; an empty table gives no rows; extra columns are ignored by
the operator and kept by ``mixed``.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, row_key, sampled, stash

SAMPLE = 4000
SAMPLE_BYTES = 8 << 20
TOLERANCE = 1e-3
ROUNDS = 60
CUT = 8
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[DataFrame, list[float]] | None:
    """Word table ``(word, l0, l1, ...)`` of log-likelihoods, and log-priors (-inf for an absent domain)."""
    known = labelled.where(F.col("domain").isin(*domains) & F.coalesce(fold_of(F.col("doc_id")) != 1, F.lit(False))).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = known.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit("sample"))).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = sampled(rows, "h", sample, SAMPLE_BYTES).groupBy("h", "doc_id", "domain").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = stash(rows, "labelled")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    counts = [F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)]
    top = stash(rows.select("domain", F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(*counts), "vocabulary")
    totals = top.agg(F.count("*").alias("v"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(domains))]).first()
    logs = [F.log((F.col(f"c{k}") + 1) / F.lit(float((totals[f"c{k}"] or 0) + totals["v"] + 1))).alias(f"l{k}") for k in range(len(domains))]
    priors = [math.log(sizes[d] / sum(sizes.values())) if d in sizes else -math.inf for d in domains]
    return top.select("word", *logs), priors


def memberships(docs: DataFrame, model: tuple[DataFrame, list[float]] | None, domains: list[str]) -> DataFrame:
    """``(key, text_hash, copies_in, n_tokens, p0, p1, ...)``, one row for each doc_id and text."""
    n = len(domains)
    keyed = docs.select(row_key().alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    if model is None:
        out = keyed.select("key", "text_hash", F.size(_words(F.col("text"))).cast("long").alias("n_tokens")).groupBy("key", "text_hash", "n_tokens").agg(F.count("*").alias("copies_in"))
        return out.select("key", "text_hash", "copies_in", "n_tokens", *[F.lit(1.0 / n).alias(f"p{k}") for k in range(n)])
    table, priors = model
    # every text also sends the empty word, which no text has: it keeps wordless rows and counts copies
    words = keyed.withColumn("words", _words(F.col("text"))).select("key", "text_hash", F.size("words").cast("long").alias("n_tokens"), F.explode(F.array_append("words", F.lit(""))).alias("word"))
    met = words.join(F.broadcast(table), "word", "left").where("word = '' OR l0 IS NOT NULL")
    sums = met.groupBy("key", "text_hash", "n_tokens").agg(F.count_if(F.col("word") == "").alias("copies_in"), *[F.sum(f"l{k}").alias(f"s{k}") for k in range(n)])
    live = [k for k in range(n) if priors[k] > -math.inf]
    scores = sums.withColumns({f"s{k}": F.coalesce(F.col(f"s{k}") / F.col("copies_in"), F.lit(0.0)) + F.lit(priors[k]) for k in live})
    scores = scores.withColumn("top", F.greatest(*[f"s{k}" for k in live]) if len(live) > 1 else F.col(f"s{live[0]}"))
    scores = scores.withColumns({f"e{k}": F.exp(F.col(f"s{k}") - F.col("top")) for k in live})
    whole = sum((F.col(f"e{k}") for k in live[1:]), F.col(f"e{live[0]}"))
    return scores.select("key", "text_hash", "copies_in", "n_tokens", *[(F.col(f"e{k}") / whole if k in live else F.lit(0.0)).alias(f"p{k}") for k in range(n)])


def fit_rates(members: DataFrame, weights: list[float], budget: float | None = None, tolerance: float = TOLERANCE, floor: float = 0.0) -> tuple[DataFrame, dict]:
    """``members`` with column ``rate``, and what the fit reached: rounds, tokens and targets of each domain."""
    k = range(len(weights))
    mass = F.col("n_tokens") * F.col("copies_in")

    def totals(rates: DataFrame) -> list[float]:
        row = rates.agg(*[F.sum(F.col("rate") * mass * F.col(f"p{i}")).alias(f"t{i}") for i in k]).first()
        return [row[f"t{i}"] or 0.0 for i in k]

    rates = members.withColumn("rate", F.lit(1.0))
    have = totals(rates)
    reach = [w if h > 0 else 0.0 for w, h in zip(weights, have)]
    if not sum(reach):
        return rates, {"rounds": 0, "targets": [0.0 for _ in k], "reached": have, "error": 0.0}
    reach = [w / sum(reach) for w in reach]
    budget = budget if budget is not None else max(h / w for h, w in zip(have, reach) if w > 0)
    goal, now, before, rounds, worst, speed = [budget * w for w in reach], have, have, 0, math.inf, 1.0
    rates = rates.withColumn("last", F.col("rate"))
    while rounds < ROUNDS:
        off = max(abs(a - b) for a, b in zip(now, goal)) / budget
        if off <= tolerance:
            break
        # a step from a point ahead on the line of the last two; totals are linear, so those of that point are known
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        lead = (speed - 1) / faster if off < worst else 0.0
        rounds, worst, speed = rounds + 1, off, faster if off < worst else 1.0
        ahead = [a + lead * (a - b) for a, b in zip(now, before)]
        pull = [(a - b) / h if h > 0 else 0.0 for a, b, h in zip(ahead, goal, have)]
        step = sum((F.col(f"p{i}") * F.lit(pull[i]) for i in k if i), F.col("p0") * F.lit(pull[0]))
        moved = F.greatest(F.lit(float(floor)), F.col("rate") + F.lit(lead) * (F.col("rate") - F.col("last")) - step)
        rates = rates.withColumns({"rate": moved, "last": F.col("rate")})
        if rounds % CUT == 0:
            rates = stash(rates, "rates")
        before, now = now, totals(rates)
    off = max(abs(a - b) for a, b in zip(now, goal)) / budget
    if off > tolerance:
        warnings.warn(f"after {rounds} rounds a domain is off its target by {off:.3g} of the budget", stacklevel=2)
    return rates.drop("last"), {"rounds": rounds, "targets": goal, "reached": now, "error": off}


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None, floor: float = 0.0) -> tuple[DataFrame, list[str], dict]:
    """Rows ``(key, text_hash, n_tokens, p0, ..., rate, copies)`` for each doc_id and text."""
    domains = sorted(targets)
    total = sum(targets.values())
    members = stash(memberships(docs, learn(docs, labelled, domains), domains), "memberships")
    rates, told = fit_rates(members, [targets[d] / total for d in domains], budget, floor=floor)
    share = F.pmod(F.xxhash64("key", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(share < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rates.withColumn("copies", copies), domains, told


def op2_mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """One row for each document: its tokens, posteriors ``p_<domain>``, rate and whole copies, and how far the fit is off."""
    out, domains, told = rated(docs, labelled, targets or TARGETS, budget)
    keyed = docs.select("doc_id", row_key().alias("key"), F.xxhash64("text").alias("text_hash"))
    named = [F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)]
    return keyed.join(out, ["key", "text_hash"]).select("doc_id", "n_tokens", *named, "rate", "copies", F.lit(float(told["error"])).alias("fit_error"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, floor: float = 0.0) -> DataFrame:
    """``docs`` with each row as often as its copies say; with a floor of 1 no row goes."""
    out, _, _ = rated(docs, labelled, targets or TARGETS, budget, floor)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("key"), F.xxhash64("text").alias("text_hash"))
    often = out.where("copies > 0").select("key", "text_hash", "copies")
    joined = keyed.join(often, ["key", "text_hash"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
