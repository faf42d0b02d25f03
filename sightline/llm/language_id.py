"""Language identification with error-correcting output codes.

Every language gets a codeword of +1 and -1.  One binary classifier per bit, a log-odds weight for each hashed
byte trigram, says which side of that bit a text is on.  A text gets the language whose codeword has the least
loss: the sum over bits of the logistic loss of the bit's margin, weighted by how well that bit's classifier did
on texts it was not fitted to.  Two codewords of nearly the same loss are flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_row

BUCKETS = 1 << 15
EXHAUSTIVE_LANGUAGES = 6  # up to here all splits of the languages are bits


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # margin to log-odds
    trust: np.ndarray  # weight of each bit's loss


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row for each of n languages; rows far apart, no two columns the same split."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE_LANGUAGES:
        rows = [(1, *tail) for tail in itertools.product((1, -1), repeat=n - 1) if -1 in tail]
        return np.array(rows, float).T
    bits, rng, best = 16 * math.ceil(math.log2(n)), np.random.default_rng(seed), (0, None)
    for _ in range(50):
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        code[0, np.abs(code.sum(0)) == n] *= -1  # no bit is the same for all
        apart = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(n - 1))
        if apart > best[0]:
            best = (apart, code)
    return best[1]


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(65537 * 31) + b[1:-1] * np.uint32(257 * 17) + b[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(17)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """(text, language) of at most ``per_language`` rows of each language, chosen by a hash of the id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = [
        r["id"]
        for r in known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
        .withColumn("n", F.row_number().over(by_hash))
        .where(F.col("n") <= per_language)
        .collect()
    ]
    if not ids:
        return []
    rows = known.where(F.col(id_col).isin(ids)).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    return sorted((r["t"], r["l"]) for r in rows.collect() if has_letter(r["t"]))


def fit(examples: list[tuple[str, str]]) -> Model:
    """Weights from four fifths of the examples, scale and trust of each bit from the last fifth."""
    languages = sorted({lang for _, lang in examples})
    codes = codewords(len(languages))
    bits = codes.shape[1]
    index = {lang: i for i, lang in enumerate(languages)}
    held = [i % 5 == 4 for i in range(len(examples))]
    counts = np.zeros((len(languages), BUCKETS))
    for (text, lang), out in zip(examples, held, strict=True):
        if not out:
            seen = np.bincount(grams(text), minlength=BUCKETS).astype(float)
            counts[index[lang]] += seen / max(1.0, seen.sum()) ** 0.5
    weights = np.zeros((BUCKETS, bits), np.float32)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1e-9)
    for b in range(bits):
        plus, minus = (share[codes[:, b] == s].mean(0) if (codes[:, b] == s).any() else np.zeros(BUCKETS) for s in (1, -1))
        weights[:, b] = np.log((plus + 1e-6) / (minus + 1e-6))
    scale, trust = np.ones(bits), np.ones(bits)
    tests = [e for e, out in zip(examples, held, strict=True) if out]
    if tests:
        margins = np.array([weights[grams(t)].mean(0) for t, _ in tests], float)
        wanted = codes[[index[lang] for _, lang in tests]]
        for b in range(bits):
            a = 1.0
            for _ in range(100):  # slope of a logistic curve, with a prior that keeps it finite
                p = 1 / (1 + np.exp(np.clip(wanted[:, b] * margins[:, b] * a, -50, 50)))
                step = (p * wanted[:, b] * margins[:, b]).sum() - 0.05 * a
                curve = (p * (1 - p) * margins[:, b] ** 2).sum() + 0.05
                a = min(max(a + step / curve, 0.1), 100.0)
            right = ((margins[:, b] * wanted[:, b]) > 0).mean()
            scale[b], trust[b] = a, max(0.0, 2 * right - 1) + 1e-3
    return Model(languages, codes, weights, scale, trust / trust.sum() * bits)


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, score and whether the two nearest codewords are about equally near."""
    if not model.languages or not has_letter(text):
        return "und", 0.0, False
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    found = grams(text)
    if len(found) > BUCKETS:
        margin = np.bincount(found, minlength=BUCKETS).astype(np.float32) @ model.weights / len(found)
    else:
        margin = model.weights.take(found, axis=0).mean(0)
    margin = margin * model.scale
    loss = (np.logaddexp(0, -model.codes * margin) * model.trust).sum(1)
    order = np.argsort(loss, kind="stable")
    likely = np.exp(loss[order[0]] - loss)
    score = float(1 / likely.sum())
    return model.languages[order[0]], score, bool(loss[order[1]] - loss[order[0]] < 0.5)


def identify_language(
    docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 600, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, kept columns, lang_pred, score, ambiguous) for each row of ``docs``.

    The classifiers are fitted to at most ``per_language`` rows of each language of ``train``, taken whole.  A text
    that is null or has no letter is ``und`` with score 0; so is every text where ``train`` has no usable row.  An
    empty table gives an empty table; repeated rows give repeated results; further columns are ignored.
    """
    model = fit(sample(train, id_col, text_col, lang_col, per_language))

    def make():
        def work(texts):
            return [list(c) for c in zip(*(predict(model, t) for t in texts), strict=True)] if texts else [[], [], []]

        return work

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
    return per_row(docs, id_col, text_col, fields, make, keep)
