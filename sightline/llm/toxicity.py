"""Toxicity by compression distance.

Two zstandard dictionaries are trained separately, one on ordinary text, one on what toxic texts say and ordinary ones do
not.  Each window of a text, 128 bytes that overlap by half, is compressed twice: primed with the ordinary dictionary,
and with the toxic one behind it.  The bytes that the second saves tell toxic windows.  How many windows must save how
many bytes is calibrated on labelled texts that the dictionaries were not trained on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, per_row

WORD = re.compile(rb"[^\x00-\x20.,;:!?|*#$&%\"()<>\[\]{}=]+")
WINDOW, STEP = 128, 64  # bytes
TRAINING_WINDOW = 512
ORDINARY_BYTES, ORDINARY_SEGMENT = 110_000, 64
TOXIC_BYTES, TOXIC_SEGMENT = 1_024, 16
GRAM = 6  # bytes that the trainer counts as one
TELLING_SHARE = 0.03  # of the toxic texts, at least two, hold a telling word
TELLING_RATIO = 20.0  # a telling word is so many times as frequent in toxic texts as in ordinary ones
LONGEST_WORD = 48
STEPS = (2, 3, 5)  # bytes saved in a window
REACH = 6.0  # standard deviations a feature counts for at most
TAIL = b" . . . . . . . . "  # the compressor looks for no matches in its last bytes


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def normal(text: str | None) -> bytes:
    """Lower case, one blank between words and at either end."""
    return b" %b " % b" ".join((text or "").lower().encode("utf-8", "replace").split())


def windows(content: bytes, length: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Slices of one length that overlap and cover the whole; the last may be shorter."""
    return [content[i : i + length] for i in range(0, max(1, len(content) - length + step), step)]


def train(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary of so many bytes; where there is too little to train on, the samples themselves."""
    whole = b"".join(samples)
    if len(whole) > 2 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=GRAM).as_bytes()
        except zstandard.ZstdError:
            pass
    return whole[-size:]


def telling(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Toxic texts cut down to the words that recur in toxic texts and are far rarer in ordinary ones."""

    def in_texts(texts: list[bytes]) -> Counter:
        seen: Counter = Counter()
        for t in texts:
            seen.update(set(WORD.findall(t)))
        return seen

    t, o, least = in_texts(toxic), in_texts(ordinary), max(2, TELLING_SHARE * len(toxic))
    known = {
        w
        for w, n in t.items()
        if n >= least and len(w) <= LONGEST_WORD and (n + 0.5) / (len(toxic) + 1) >= TELLING_RATIO * (o[w] + 0.5) / (len(ordinary) + 1)
    }
    cut = (b" ".join(w for w in WORD.findall(x) if w in known) for x in toxic)
    return [b" %b " % x for x in cut if x]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        compression_level=3, strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=16, chain_log=17, search_log=7, min_match=5,
        target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    primed = zstandard.ZstdCompressionDict(content or TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=primed, compression_params=params)


class Scorer:
    """Features and score of a text; made in each task, as compressors cannot be sent."""

    def __init__(self, model: Model):
        self.model = model
        self.plain, self.marked = _compressor(model.ordinary), _compressor(model.ordinary + model.toxic)

    def gains(self, content: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        plain, marked = self.plain.compress, self.marked.compress
        return np.array([len(plain(x)) - len(marked(x)) for x in (w + TAIL for w in windows(content))], np.int64)

    def features(self, text: str | None) -> list[float]:
        content = normal(text)
        g = self.gains(content)
        n, hits = len(g), [float((g >= k).sum()) for k in STEPS]
        total, size = float(g.sum()), len(content) + 200.0
        return [
            float(g.max()), float(np.sort(g)[-3:].sum()), total, total / size, total / size**0.5,
            *hits, *(h / n for h in hits), *(h / n**0.5 for h in hits), float(np.log(size)),
        ]

    def score(self, text: str | None) -> float:
        if not WORD.search(normal(text)):
            return 0.0
        m = self.model
        z = np.clip((np.array(self.features(text)) - m.mean) / m.spread, -REACH, REACH)
        return float(1 / (1 + np.exp(-np.clip(z @ m.weights[:-1] + m.weights[-1], -50, 50))))


def fit(examples: list[tuple[str, int]]) -> Model | None:
    """Dictionaries from two thirds of the texts, thresholds' weights from the rest; None where a label is missing.

    Which third a text is in depends on the text alone, so copies of a text never are on both sides.  Copies count once.
    """
    aside = [zlib.crc32((t or "").encode("utf-8", "replace")) % 3 == 0 for t, _ in examples]
    toxic, ordinary = (
        list(dict.fromkeys(normal(t) for (t, y), a in zip(examples, aside, strict=True) if not a and bool(y) == want)) for want in (True, False)
    )
    checks = [e for e, a in zip(examples, aside, strict=True) if a]
    if not toxic or not ordinary or len({y for _, y in checks}) < 2:
        return None
    usual = train([w for t in ordinary for w in windows(t, TRAINING_WINDOW, TRAINING_WINDOW)], ORDINARY_BYTES, ORDINARY_SEGMENT)
    marked = telling(toxic, ordinary) or [w for t in toxic for w in windows(t, TRAINING_WINDOW, TRAINING_WINDOW)]
    model = Model(usual, train(marked, TOXIC_BYTES, TOXIC_SEGMENT), np.zeros(1), np.ones(1), np.zeros(1))
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t, _ in checks])
    y = np.array([label for _, label in checks], float)
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.clip((x - model.mean) / model.spread, -REACH, REACH), np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + 0.1 * np.eye(len(w)), z.T @ (y - p) - 0.1 * w)
    model.weights = w
    return model


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic_rows: int, other_rows: int
) -> list[tuple[str, int]]:
    """(text, label) of at most so many ids of either label, chosen by a hash of the id; labels that differ: toxic.

    An id that several rows have gives one of their texts.
    """
    of = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    of = of.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    label = {}
    for y, most in ((1, toxic_rows), (0, other_rows)):
        label |= {r["id"]: y for r in of.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()}
    if not label:
        return []
    rows = docs.where(F.col(id_col).isin(list(label))).groupBy(F.col(id_col).alias("i")).agg(F.min(text_col).alias("t"))
    return [(t, label[i]) for i, t in sorted((r["i"], r["t"] or "") for r in rows.collect())]


def score_toxicity(
    docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", toxic_rows: int = 1500, other_rows: int = 3000, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, kept columns, score) for each row of ``docs``; score: 0 to 1, higher for toxic text.

    Fitted to at most ``toxic_rows`` and ``other_rows`` texts of ``labelled`` that ``labels`` marks.  Null counts as the
    empty text; a text without a word has the score 0.  Where one of the labels has no text, every
    score is 0.  An empty table gives an empty table; further columns are ignored.
    """
    model = fit(sample(labelled, labels, id_col, text_col, label_col, toxic_rows, other_rows))

    def make():
        key = ("toxicity", model.ordinary, model.toxic, model.weights.tobytes()) if model else None
        scorer = held(key, lambda: Scorer(model)) if model else None

        def work(texts):
            return [[scorer.score(t) if scorer else 0.0 for t in texts]]

        return work

    return per_row(docs, id_col, text_col, [T.StructField("score", T.DoubleType())], make, keep)
