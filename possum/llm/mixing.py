"""Mixing to target weights by soft membership.

A labelled table names a domain for some documents. A naive Bayes classifier
over the most informative words predicts every document's domain posteriors
p. With t words in a document and a rate r of how often it is used, a domain's
expected words are the sum of r * t * p. Projected-gradient least squares
finds rates of 0 or more that bring these sums as near the targets as can be:

    r <- max(0, r - p . y),   y = (sums - targets) / step

p . gap is the gradient of the squared error, scaled by 1/t. The gap is that
of the new rates, so a step of any length is stable and a few steps do. The
gap is found by Newton's method with a line search: a round is one aggregate
over the documents, and what reaches the driver is the sums and the matrix of
t p p' over the positive rates, whose size is the number of domains. The steps
end when the targets are met, or when the optimality conditions (no document's
gradient below 0, none above 0 at a positive rate) bound the distance to the
least-squares sums. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from possum.llm.common import Scratch, doc_key, packed

# Default bounds of the classifier: labelled documents it is fitted on, and words it knows.
LABELLED_ROWS, FEATURES = 30_000, 4_096
# A word of the classifier tells so many nats about the domains of the labelled documents, and
# is so many times as common in one of them: common words of a language say little, and together.
MIN_GAIN, MIN_LIFT = 10.0, 3.0
# Of the largest target: the gap at which targets are met, and the bound on the distance to the least-squares sums.
TOLERANCE, OPTIMAL = 1e-9, 1e-4
# Of the trace of the matrix: the first step's length is 1 / STEP, every later one ten times as long, up to 1 / LAST_STEP.
STEP, LAST_STEP = 1e-6, 1e-12
MAX_STEPS, MAX_ROUNDS, SHORTEST = 16, 40, 1e-4
WORD_BREAK = r"[\x20\x09-\x0D]+"


def quality_domains(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(doc_id, domain) from quality and toxicity labels: toxic, low or clean; rows without both labels are left out."""
    domain = F.when(F.col(toxic_col) == 1, "toxic").when(F.col(quality_col) == 0, "low").when((F.col(quality_col) == 1) & (F.col(toxic_col) == 0), "clean")
    return labels.select(F.col(id_col).cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id is not null and domain is not null")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), *doc_key(F.col(id_col), F.col(text_col)), _words(text).alias("words"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], labelled_rows: int = LABELLED_ROWS, max_words: int = FEATURES) -> tuple[DataFrame, dict[str, int]]:
    """(word, w0, w1, ...) of at most ``max_words`` words, and a score for a document with none of them.

    Bernoulli naive Bayes in millionths: a word that is there adds the log
    odds of its share in a domain, and one that isn't counts as absent.

    Fitted on the documents of ``labelled_rows`` labels at most (by least hash).
    An id with several labels takes the last in the order of ``domains``.
    """
    rank = F.array_position(F.array(*map(F.lit, domains)), F.col("domain"))
    one = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.max(rank).cast("int").alias("k"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    known = docs.join(F.broadcast(sample), "doc_id").select("k", F.array_distinct("words").alias("words"))  # at most labelled_rows ids
    sizes = {r["k"]: r["n"] for r in known.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sizes.get(i + 1, 0) for i in range(len(domains))]
    total = sum(n)
    seen = known.select("k", F.explode("words").alias("word")).groupBy("word").agg(*(F.count(F.when(F.col("k") == i + 1, 1)).alias(f"n{i}") for i in range(len(domains))))
    held = reduce(lambda a, b: a + b, (F.col(f"n{i}") for i in range(len(domains))))
    share = held / F.lit(float(max(total, 1)))
    gain = reduce(lambda a, b: a + b, (F.when((F.col(f"n{i}") > 0), F.col(f"n{i}") * F.log(F.col(f"n{i}") / F.lit(float(max(n[i], 1))) / share)).otherwise(0.0) for i in range(len(domains))))
    lift = F.greatest(F.lit(0.0), *(F.col(f"n{i}") / F.lit(float(max(n[i], 1))) / share for i in range(len(domains))))
    best = seen.withColumn("gain", F.round(gain, 6)).where((F.col("gain") >= MIN_GAIN) & (lift >= MIN_LIFT)).orderBy(F.desc("gain"), "word").limit(max_words)
    chance = lambda i: (F.col(f"n{i}") + 0.5) / F.lit(n[i] + 1.0)
    whole = lambda c: F.round(c * 1e6).cast("long")
    features = Scratch(docs.sparkSession, "mixing").save(
        best.select("word", *(whole(F.log(chance(i) / (1 - chance(i)))).alias(f"w{i}") for i in range(len(domains))), *(whole(F.log(1 - chance(i))).alias(f"a{i}") for i in range(len(domains))))
    )
    absent = features.agg(*(F.sum(f"a{i}").alias(f"a{i}") for i in range(len(domains)))).first()
    prior = {d: round(float(np.log((n[i] + 1) / (total + len(domains)))) * 1_000_000) + (absent[f"a{i}"] or 0) for i, d in enumerate(domains)}
    return features.select("word", *(f"w{i}" for i in range(len(domains)))), prior


def posteriors(docs: DataFrame, features: DataFrame, prior: dict[str, int]) -> DataFrame:
    """(doc_id, keys, n_words, p0, p1, ...): domain posteriors of every row."""
    k = range(len(prior))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())  # used within one job alone
    rows = numbered.select("row", "doc_id", "k_id", "k_text", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.array_distinct("words")).alias("word"))
    hits = rows.join(F.broadcast(features), "word", "left")  # at most max_words rows
    sums = hits.groupBy("row", "doc_id", "k_id", "k_text", "n_words").agg(*(F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"s{i}") for i in k))
    scores = [(F.col(f"s{i}") + F.lit(p)) / 1e6 for i, p in enumerate(prior.values())]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    odds = sums.withColumns({f"o{i}": F.exp(s - top) for i, s in enumerate(scores)})
    whole = reduce(lambda a, b: a + b, (F.col(f"o{i}") for i in k))
    return odds.select("doc_id", "k_id", "k_text", "n_words", *((F.col(f"o{i}") / whole).alias(f"p{i}") for i in k))


def _dot(p: list[Column], y: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, (x * F.lit(float(v)) for x, v in zip(p, y, strict=True)))


def _step(at, eps: float, targets: np.ndarray, start: tuple) -> tuple[np.ndarray, np.ndarray]:
    """y and the new sums, with eps * y = gap of the rates max(0, r - p . y): the least of a convex function of y, whose gradient is the difference."""
    scale, y, (value, sums, m, _) = float(np.abs(targets).max()) or 1.0, np.zeros(len(targets)), start
    cost = lambda value, y: value + targets @ y + eps / 2 * (y @ y)
    for _ in range(MAX_ROUNDS):
        slope = eps * y - (sums - targets)
        if np.linalg.norm(slope) <= max(1e-12 * scale, 1e-9 * eps * np.linalg.norm(y)):
            break
        newton, length, best = np.linalg.solve(m + eps * np.eye(len(y)), slope), 1.0, cost(value, y)
        while True:
            new = y - length * newton
            value, sums, m, _ = at(new, new)
            if cost(value, new) <= best - 1e-4 * length * (slope @ newton) + 1e-13 * abs(best) or length < SHORTEST:
                break
            length /= 2
        still, y = np.allclose(y, new, rtol=1e-15, atol=0), new
        if still:
            break
    return y, sums


def fit_rates(soft: DataFrame, targets: np.ndarray) -> Column:
    """The rate as a column over (n_words, p0, p1, ...); every document begins at rate 1.

    No gradient holds back a document without words; its rate is at most the
    largest of the others. Raises if the sums aren't known to be within OPTIMAL of the least-squares
    ones after MAX_STEPS steps.
    """
    k = range(len(targets))
    p, t = [F.col(f"p{i}") for i in k], F.col("n_words")
    rate, scale = F.lit(1.0), float(np.abs(targets).max()) or 1.0
    moved = lambda rate, y: F.greatest(F.lit(0.0), rate - _dot(p, y))

    def at(y: np.ndarray, along: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, tuple[float, float]]:
        used = soft.withColumn("r", moved(rate, y))
        free = F.when(F.col("r") > 0, t).otherwise(0)
        got = used.agg(
            F.sum(F.col("r") * F.col("r") * t).alias("value"), F.min(F.when(t > 0, _dot(p, along))).alias("least"), F.max(F.when(t > 0, F.col("r"))).alias("top"),
            *(F.sum(F.col("r") * t * x).alias(f"g{i}") for i, x in enumerate(p)), *(F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in k for j in k),
        ).first()
        return (got["value"] or 0.0) / 2, np.array([got[f"g{i}"] or 0.0 for i in k]), np.array([[got[f"m{i}_{j}"] or 0.0 for j in k] for i in k]), (got["least"] or 0.0, got["top"] or 0.0)

    fitted = lambda: F.when(t > 0, rate).otherwise(F.least(rate, F.lit(float(start[3][1]))))
    start = at(np.zeros(len(targets)), np.zeros(len(targets)))
    size, off = float(np.trace(start[2])), float("inf")
    if size == 0:
        return rate  # no document has words
    for n in range(MAX_STEPS):
        gap = start[1] - targets
        if np.abs(gap).max() <= TOLERANCE * scale:
            return fitted()
        y, sums = _step(at, max(STEP / 10**n, LAST_STEP) * size, targets, start)
        rate, gap = moved(rate, y), sums - targets
        start = at(np.zeros(len(targets)), sums - targets)
        # for sums s and the nearest reachable ones s*: |s - s*|^2 <= gap . (s - s*), and s* is a sum of t r p with no more words than the targets' length allows
        off = float(np.sqrt(abs(start[1] @ gap) + max(0.0, -start[3][0]) * np.sqrt(len(targets)) * np.linalg.norm(targets)))
        if off <= OPTIMAL * scale and np.linalg.norm(gap) > off:
            return fitted()
    if np.abs(start[1] - targets).max() <= TOLERANCE * scale or off <= OPTIMAL * scale:
        return fitted()
    raise RuntimeError(f"rates did not settle in {MAX_STEPS} steps: sums {start[1].tolist()}, targets {targets.tolist()}, up to {off} off the nearest")


def _soft(df: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, labelled_rows: int, max_words: int) -> DataFrame:
    scratch = Scratch(df.sparkSession, "mixing")
    docs = _documents(df, id_col, text_col)
    features, prior = fit_classifier(docs, labelled, domains, labelled_rows, max_words)
    return scratch.save(posteriors(docs, features, prior))


def _rated(soft: DataFrame, targets: np.ndarray) -> DataFrame:
    # a document is used floor(rate + draw) times, its rate on average; the draw is a hash of the document
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(5), "k_id", "k_text"), 11).cast("double") / float(1 << 53)
    return soft.withColumn("rate", fit_rates(soft, targets)).withColumn("copies", F.floor(F.col("rate") + draw).cast("long"))


def mixing_rates(df: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS, max_words: int = FEATURES) -> DataFrame:
    """(doc_id, n_words, p_<domain> ..., rate, copies) for every row.

    ``weights`` are the target shares of the domains and ``total`` the words
    to aim at (default: what the corpus has). ``labelled_rows`` and
    ``max_words`` bound the classifier's sample and its words. A null or empty text has no
    words and keeps rate about 1; its posteriors are the priors. Without
    labels every domain has the same posterior. Targets that no rates of 0 or
    more can reach are met as closely as least squares does, to OPTIMAL of the
    largest; an error says if that isn't reached. Repeated rows get equal
    results; an empty table gives an empty result.
    """
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be 0 or more, and one above 0")
    domains = list(weights)
    soft = _soft(df, labelled, domains, id_col, text_col, labelled_rows, max_words)
    words = float(soft.agg(F.sum("n_words").alias("n")).first()["n"] or 0) if total is None else total
    share = np.array([weights[d] for d in domains], float) / sum(weights.values())
    rated = _rated(soft, share * words)
    return rated.select("doc_id", "n_words", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", "copies")


def remix(df: DataFrame, labelled: DataFrame, factors: dict[str, float], id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS, max_words: int = FEATURES) -> DataFrame:
    """The rows of ``df``, each as often as its ``copies`` says, for targets of ``factors`` times what every domain has now.

    All columns stay as they are, whatever their names. Null and empty texts,
    null ids, repeated rows and empty tables count as in ``mixing_rates``;
    rows of equal id and text come equally often.
    """
    domains = list(factors)
    soft = _soft(df, labelled, domains, id_col, text_col, labelled_rows, max_words)
    now = soft.agg(*(F.sum(F.col("n_words") * F.col(f"p{i}")).alias(f"g{i}") for i in range(len(domains)))).first()
    targets = np.array([(now[f"g{i}"] or 0.0) * factors[d] for i, d in enumerate(domains)])
    copies = _rated(soft, targets).groupBy("k_id", "k_text").agg(F.max("copies").alias("k_copies")).where("k_copies > 0")
    used = packed(df, id_col, text_col).join(copies, ["k_id", "k_text"])
    return used.withColumn("k_copy", F.explode(F.array_repeat(F.lit(0), F.col("k_copies").cast("int")))).select("row.*")
