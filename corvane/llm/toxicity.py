r"""Toxic passages by maximum-scoring segments: a linear scan over the log-odds of tokens finds every significant passage, calibrated by extreme values.

Tokens are the runs of letters of the whole lower-cased text. Their log-odds are learned from labelled rows: a token's share of toxic documents,
classes counting alike, is drawn by a Dirichlet prior of `PRIOR` documents to the share of its longest known prefix, that one to the share of the next shorter,
and the shortest to one half. So forms of a stem that were rarely or never seen weigh what the stem does.

Of a token that a text repeats, the k-th one weighs 1/k of its positive log-odds: a rare word written forty times says what it says once. A
drift is taken off each token, so that clean text scores below zero; the maximal segments of Ruzzo and Tompa are then the passages, found in one scan. In
clean text of L tokens the best segment exceeds s with probability p = 1 - exp(-K L exp(-lambda s)) (Karlin and Altschul); K and lambda are fitted to clean
labelled rows that weren't counted. A document's evidence is -ln p of its best segment and of all others with p below `SIGNIFICANT`; a logistic curve of ln(1 + evidence),
fitted to the same rows, makes it a score between 0 and 1.

Learned from at most about `bound` labelled rows of each class, drawn by hash, three quarters for the counts and one for the calibration, and at most about `terms` tokens and
prefixes; both are parameters, and the only samples: every text is scored from all of it.

Defined results: a null text is empty, and an empty one or one without letters has no evidence; a label other than 0 or 1, or of no document, isn't learned from; of several labels
of a document each counts; a row with a null key isn't held out, and not learned from; without labels of both classes every score is the share of toxic rows among
the labelled (0 where there is none); repeated rows are scored alike; an empty table gives an empty result; columns named like a new one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from math import exp, expm1, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import add_columns, forget, remainder

#: Labelled rows of each class, and tokens and prefixes of the model.
BOUND, TERMS = 20_000, 300_000
#: Documents that a prior weighs; those that a token or prefix is in at least, to count.
PRIOR, LEAST = 3, 5
#: Lengths of prefixes.
SHORTEST, LONGEST = 3, 8
#: What a prefix says for its forms stays this far from certain, since it counts the same documents.
DOUBT = 0.05
#: Taken off each token's log-odds.
DRIFT = 1.25
#: Passages are reported, and count as evidence beside the best, below this probability.
SIGNIFICANT = 0.01
#: No probability is taken to be less: exp(-300).
LEAST_LOG = -300.0
#: Tokens and counts that a task keeps at hand.
KEEP = 400_000
TOKEN = re.compile(r"[^\W\d_]+")
#: Follows a whole token, so that it differs from a prefix.
WHOLE = "."


def nodes(token: str) -> list[str]:
    """The prefixes of a token, the shortest first, then the token."""
    return [*(token[:k] for k in range(SHORTEST, min(LONGEST, len(token) - 1) + 1)), token + WHOLE]


def weights(counts: Iterable[tuple[str, int, int]], documents: tuple[int, int]) -> dict[str, float]:
    """Log-odds of tokens and prefixes from (node, clean, toxic) documents, each drawn to that of its longest known prefix."""
    clean, toxic = (max(1, n) for n in documents)
    seen = {n: (a, b) for n, a, b in counts}
    share: dict[str, float] = {}
    # Prefixes come before what they are prefixes of.
    for n in sorted(seen, key=lambda n: (n.endswith(WHOLE), len(n), n)):
        own = n.removesuffix(WHOLE)
        above = next((own[:k] for k in range(min(LONGEST, len(own) - 1), SHORTEST - 1, -1) if own[:k] in share), None)
        a, b = seen[n]
        x, y = a / clean, b / toxic
        share[n] = ((a + b) * y / (x + y) + PRIOR * (min(1 - DOUBT, max(DOUBT, share[above])) if above else 0.5)) / (a + b + PRIOR)
    return {n: log(s / (1 - s)) for n, s in share.items()}


def segments(scores: Iterable[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal segments (Ruzzo and Tompa) as (first place, last place, score) of scores at places that go up, in time linear in their number.

    Each candidate keeps the sum before it and the sum after it; a new one joins those back to the nearest that began lower, if it ends higher than that.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    lower: list[int] = []  # of each candidate: the nearest before it that begins lower, -1 if none does
    total = 0.0
    for place, s in scores:
        before, total = total, total + s
        if s <= 0:
            continue
        first, low, high = place, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = lower[j]
            if j < 0 or found[j][3] >= high:
                found.append((first, place, low, high))
                lower.append(j)
                break
            first, low = found[j][0], found[j][2]
            del found[j:], lower[j:]
    return [(a, z, high - low) for a, z, low, high in found]


@dataclass
class Model:
    """weight of each token or prefix; drift; K and lambda; a, b: score = 1 / (1 + exp(-(a + b ln(1 + evidence)))). Without labels of both classes: share."""

    weight: dict[str, float]
    drift: float = DRIFT
    k: float = 1.0
    rate: float = 1.0
    a: float = 0.0
    b: float = 1.0
    share: float | None = None

    def __post_init__(self):
        self.near: dict[str, float] = {}

    def of(self, token: str) -> float:
        got = self.near.get(token)
        if got is None:
            if len(self.near) >= KEEP:
                self.near.clear()
            got = self.weight.get(token + WHOLE)
            if got is None:
                got = next((self.weight[p] for k in range(min(LONGEST, len(token) - 1), SHORTEST - 1, -1) if (p := token[:k]) in self.weight), 0.0)
            if len(token) < 100:
                self.near[token] = got
        return got

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """How many tokens, and the maximal segments by characters (the end is exclusive)."""
        n, ends, times, drift, of = 0, {}, {}, self.drift, self.of

        def scores():
            nonlocal n
            for n, m in enumerate(TOKEN.finditer(lowered(text or "")), 1):
                s = of(m[0])
                if s > 0:
                    times[m[0]] = k = times.get(m[0], 0) + 1
                    s /= k
                s -= drift
                if s > 0:
                    ends[m.start()] = m.end()
                yield m.start(), s

        found = segments(scores())
        return n, [(a, ends[z], s) for a, z, s in found]

    def log_p(self, n: int, score: float) -> float:
        """ln of the probability that clean text of n tokens has a segment of at least this score."""
        expected = self.k * n * exp(-self.rate * score)
        return max(LEAST_LOG, log(max(-expm1(-expected), 5e-324)))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        logs = sorted(self.log_p(n, s) for *_, s in found)
        return -sum(x for i, x in enumerate(logs) if i == 0 or x < log(SIGNIFICANT))

    def score(self, evidence: float) -> float:
        return self.share if self.share is not None else 1 / (1 + exp(-(self.a + self.b * log1p(evidence))))


def lowered(text: str) -> str:
    """Lower case with as many characters as before, so that places hold in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def extreme_values(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """K and lambda of the largest likelihood; a text without a segment (best is 0) says only that there is none. lambda is drawn to 1, what log-odds would have."""
    above = best > 0

    def of(rate: float) -> tuple[float, float]:
        k = (above.sum() + 1) / ((lengths * np.exp(-rate * best)).sum() + 1)
        return above.sum() * (log(rate) + log(k)) - rate * best[above].sum() - log(rate) ** 2 / 2, k

    rate = max(np.geomspace(0.05, 5, 200).tolist(), key=lambda r: of(r)[0])
    return of(rate)[1], rate


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (0 at least) by weighted, slightly ridged Newton steps; labels are drawn in by one row each, as Platt does."""
    n1, n0 = w[y > 0].sum(), w[y == 0].sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(1.0, float(np.median(x[y > 0])) if (y > 0).any() else 1.0)
    z, at = np.column_stack([np.ones(len(x)), x / spread]), np.zeros(2)
    loss = lambda v: float((w * (np.logaddexp(0, z @ v) - t * (z @ v))).sum()) + 0.05 * float(v @ v)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -500, 500)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (w * (p - t)) + 0.1 * at)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), max(0.0, float(at[1]) / spread)


def counted(sample: DataFrame, text: str) -> DataFrame:
    """node, clean, toxic: the documents of each class that have a token or prefix."""

    def run(batches):
        forget()
        for b in batches:
            got: dict[str, list[int]] = {}
            for t, toxic in zip(b.column(0), b.column(1).to_pylist()):
                for n in {n for token in set(TOKEN.findall(lowered(t.as_py() or ""))) for n in nodes(token)}:
                    got.setdefault(n, [0, 0])[toxic] += 1
                if len(got) >= KEEP:
                    yield whole(got)
                    got = {}
            if got:
                yield whole(got)

    def whole(got):
        both = np.array(list(got.values()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["node", "clean", "toxic"])

    each = sample.select(F.col(text), "toxic").mapInArrow(run, "node string, clean long, toxic long")
    return each.groupBy("node").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", bound: int = BOUND, terms: int = TERMS) -> Model:
    """Fit on about `bound` labelled rows of each class, drawn by the hash of the key. `labels` has the key and 0 or 1."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{toxic}`").cast("int").alias("toxic")).where("toxic in (0, 1) and key is not null")
    there = dict(known.groupBy("toxic").count().collect())
    if len(there) < 2:
        return Model({}, share=1.0 if 1 in there else 0.0)
    share = {c: min(1.0, bound / n) for c, n in there.items()}
    draw = lambda seed, n: F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(seed)), F.lit(n))
    drawn = known.where(draw(0, 1 << 20) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * (1 << 20))
    # The drawn labels are at most about twice `bound` rows of two numbers.
    mine = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("key").isNotNull())
    sample = materialize(mine.join(F.broadcast(drawn), "key").withColumn("calibrates", draw(1, 4) == 0), "labelled")
    n = {(r["calibrates"], r["toxic"]): r["n"] for r in sample.groupBy("calibrates", "toxic").agg(F.count("*").alias("n")).collect()}
    if not all((c, x) in n for c in (True, False) for x in (0, 1)):
        ones, all_ = (sum(v for k, v in n.items() if x is None or k[1] == x) for x in (1, None))
        return Model({}, share=ones / all_ if all_ else 0.0)

    counts = materialize(counted(sample.where("not calibrates"), "text"), "tokens")
    sizes = sorted(counts.groupBy(F.least(F.col("clean") + F.col("toxic"), F.lit(1000)).alias("n")).agg(F.count("*").alias("nodes")).collect(), reverse=True)
    least, kept = 1001, 0
    for size, many in sizes:
        if kept and kept + many > terms:
            break
        least, kept = size, kept + many
    rows = counts.where(F.col("clean") + F.col("toxic") >= least).collect()
    model = Model(weights(rows, (n[False, 0], n[False, 1])))
    clean = [(r["clean"], model.weight[r["node"]]) for r in rows if r["node"].endswith(WHOLE)]
    model.drift = DRIFT + max(0.0, sum(c * w for c, w in clean) / max(1, sum(c for c, _ in clean)))

    shared = docs.sparkSession.sparkContext.broadcast(model)
    one = T.StructType([T.StructField("n", T.LongType()), T.StructField("best", T.ArrayType(T.DoubleType()))])

    def make():
        def work(texts):
            got = [shared.value.scan(t) for t in texts]
            # Lesser segments of clean text don't change what is fitted.
            return [[{"n": k, "best": sorted((s for *_, s in found), reverse=True)[:100]} for k, found in got]]

        return work

    seen = add_columns(sample.where("calibrates").select("toxic", "text"), ["text"], [T.StructField("seen", one)], make, drop=("text",)).collect()
    label, lengths = np.array([r["toxic"] for r in seen]), np.array([r["seen"]["n"] for r in seen], np.float64)
    best = np.array([max(r["seen"]["best"], default=0.0) for r in seen])
    model.k, model.rate = extreme_values(lengths[label == 0], best[label == 0])
    evidence = np.array([model.evidence(r["seen"]["n"], [(0, 0, s) for s in r["seen"]["best"]]) for r in seen])
    model.a, model.b = logistic(np.log1p(evidence), label, np.where(label == 1, 1 / share[1], 1 / share[0]))
    return model


PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("log_p", T.DoubleType())]))


def predict(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with score, predicted and passages: the significant ones, in code points, with score and ln of their probability. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            scores, passages = [], []
            for t in texts:
                n, found = m.scan(t) if m.share is None else (0, [])
                scores.append(m.score(m.evidence(n, found)))
                sure = [(a, z, s, m.log_p(n, s)) for a, z, s in found]
                passages.append([{"start": a, "end": z, "score": s, "log_p": p} for a, z, s, p in sure if p < log(SIGNIFICANT)])
            return [scores, [int(s >= 0.5) for s in scores], passages]

        return work

    return add_columns(docs, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", PASSAGE)], make, drop=drop)


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", mod: int = 5, bound: int = BOUND, terms: int = TERMS, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with held_out, score, predicted and passages; learned from labels whose key leaves a remainder."""
    model = train(docs, labels.where(remainder(F.col(f"`{key}`"), mod) != 0), text, key, toxic, bound, terms)
    return predict(docs.withColumn("held_out", F.coalesce(remainder(F.col(f"`{key}`"), mod) == 0, F.lit(False))), model, text, drop)
