"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it.

Features are hashed histograms of byte n-grams of the whole lower-cased text. A one-versus-rest linear
SVM predicts the family; the pairs of languages of that family then vote. All SVMs are fitted on about
`bound` labelled texts of each language, drawn by hash; this bound is a parameter, and is the only
sample: every text is predicted from all of it.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if no
label was learned; repeated rows are predicted alike; columns named like a new one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, remainder

#: Families by language code (fixed values). A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "hi", "mr", "ne", "ur"),
    "semitic": ("ar", "he", "mt"),
}
DIMENSIONS, BOUND = 4096, 500
UNKNOWN = "und"
#: Bytes that become spaces: ASCII other than letters.
_PLAIN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), f"only {lang}")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of 1 to 3 bytes: a vector of length 1."""
    b = np.frombuffer(f" {text.lower()} ".encode().translate(_PLAIN), np.uint8).astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    two = (b[:-1] << np.uint32(8)) | b[1:]
    codes = np.concatenate([b | np.uint32(1 << 30), two | np.uint32(1 << 29), (two[:-1] << np.uint32(8)) | b[2:]])
    at = (codes * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.bincount(at, minlength=DIMENSIONS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, y in {-1, 1}; classes count alike."""
    # Features stay in single precision, since the driver fits: weights are doubles, and only products are rounded.
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    c = penalty * np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    lipschitz = 1 + 2 * float(c @ np.einsum("ij,ij->i", x, x))
    w = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead.astype(x.dtype)))
        nxt = ahead - (ahead * 0.01 - 2 * (x.T @ (c * y * slack).astype(x.dtype))) / lipschitz
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = nxt + (t - 1) / t_next * (nxt - w)
        w, t = nxt, t_next
    return w


@dataclass
class Model:
    """families: names in order; by_family: its weights, one row each; languages of each family; pairs: weights for (first, second), first being positive."""

    families: list[str]
    by_family: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margin = x @ self.by_family.T.astype(x.dtype)
        share = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = margin.argmax(1)
        lang, score = [""] * len(x), [0.0] * len(x)
        for f, name in enumerate(self.families):
            own = np.flatnonzero(best == f)
            names = self.languages[name]
            votes, sure = np.zeros((len(own), len(names))), np.zeros((len(own), len(names)))
            for (a, b), w in self.pairs.items():
                if a in names:
                    m = x[own] @ w.astype(x.dtype)
                    p = 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
                    for k, q in ((names.index(a), p), (names.index(b), 1 - p)):
                        votes[:, k] += q > 0.5
                        sure[:, k] += q
            # Votes first, then how sure they were.
            k = (votes + sure / (2 * len(names))).argmax(1)
            within = sure[np.arange(len(own)), k] / (len(names) - 1) if len(names) > 1 else np.ones(len(own))
            for i, j, s in zip(own.tolist(), k.tolist(), (share[own, f] * within).tolist()):
                lang[i], score[i] = names[j], min(1.0, max(0.0, s))
        return lang, score


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", bound: int = BOUND) -> Model | None:
    """Fit on about `bound` texts of each label, chosen by the hash of key and label; None without labelled texts."""
    known = docs.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}")).withColumn("__l", F.col(f"`{label}`").cast("string"))
    counts = dict(known.groupBy("__l").count().collect())
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, bound / n))])
    drawn = known.where(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.col("__l")), F.lit(1 << 20)) < F.element_at(share, F.col("__l")) * (1 << 20))
    rows = add_columns(drawn.select("__l", F.col(f"`{text}`").alias("__t")), ["__t"], [T.StructField("x", T.BinaryType())], lambda: lambda ts: [[features(t).tobytes() for t in ts]], drop=("__t",)).collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.array([np.frombuffer(r[1], np.float32) for r in rows]).reshape(-1, DIMENSIONS)
    y = np.array([r[0] for r in rows])
    del rows
    languages: dict[str, list[str]] = {}
    for lang in sorted(set(y.tolist())):
        languages.setdefault(family(lang), []).append(lang)
    families = sorted(languages)
    of = np.array([family(v) for v in y])
    by_family = np.array([svm(x, np.where(of == f, 1.0, -1.0)) for f in families])
    pairs = {(a, b): svm(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1.0, -1.0)) for names in languages.values() for i, a in enumerate(names) for b in names[i + 1 :]}
    return Model(families, by_family, languages, pairs)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1). Only the text is looked at."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_letter = docs.withColumn("__letter", F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))

    def make():
        m = shared.value

        def work(texts, letter):
            own = [i for i, ok in enumerate(letter) if ok]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if own:
                for i, a, s in zip(own, *m.predict(np.array([features(texts[i]) for i in own]))):
                    lang[i], score[i] = a, s
            return [lang, score]

        return work

    return add_columns(has_letter, [text, "__letter"], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, drop=("__letter",))


def identify(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", mod: int = 5, bound: int = BOUND) -> DataFrame:
    """`docs` with held_out, lang_pred and score; learned from labelled rows whose key leaves a remainder."""
    held = F.coalesce(remainder(F.col(f"`{key}`"), mod) == 0, F.lit(False))
    model = train(docs.where(~held & F.col(f"`{key}`").isNotNull()), text, label, key, bound)
    return predict(docs.withColumn("held_out", held), model, text)
