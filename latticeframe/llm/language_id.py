"""Language identification by string kernels (operator 9).

The kernel of two texts counts the n-grams (n = 1..3, of lower-case letters of any script, with all else as gaps) that
both hold, divided by the root of the product of their own counts: a blended-spectrum presence kernel.  N-grams are
told by 18 bits of a hash of their code points.  A bounded sample of labelled rows gives the Nystroem landmarks and the
training rows; one-versus-rest kernel ridge regression on the Nystroem features gives one weight vector a language.
Scoring folds weights and landmarks into matrix products over batches of whole texts.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; rows with a null language are never
learned from; with no labelled rows at all, or an empty table, every text is ``und``; repeated rows are scored alike; of
equally good languages the first by name is told; very long texts are read whole, but not learned from; columns
of the input that clash with the names of the result stay as they are, and the result's get ``_`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches

BITS = 18  # n-grams are told by so many bits
CODES = 1 << BITS
MOST_ROWS, MOST_LANGUAGES = 20_000, 2_000  # bounds of what the driver learns from
_letters: list[np.ndarray] = []


@dataclass
class Model:
    vocabulary: np.ndarray  # n-gram code -> column, -1 outside the landmarks' n-grams
    landmarks: np.ndarray  # columns x landmarks, 0/1
    root: np.ndarray  # the landmarks' root counts
    weights: np.ndarray  # landmarks x languages
    languages: list[str]


def letters() -> np.ndarray:
    """Whether a code point is a letter; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


#: Odd factors of the places of an n-gram, and a start for each n.
_FACTOR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str, seen: np.ndarray) -> np.ndarray:
    """Codes of the distinct 1- to 3-grams of the whole text; ``seen`` is scratch space of CODES zeros."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(letters()[p], p, np.uint32(0))
    if len(s) > 1:  # runs of other characters count as one gap
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = s[keep]
    s = np.concatenate(([0], s, [0])).astype(np.uint32)
    code = s * _FACTOR[0]
    for n in range(3):
        if n:
            code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * _FACTOR[n] + s[n:]
        seen[((code ^ code >> np.uint32(16)) * _FACTOR[2 - n]) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def _features(found: list[np.ndarray], model: Model) -> np.ndarray:
    x = np.zeros((len(found), len(model.landmarks)), np.float32)
    size = np.ones(len(found), np.float32)
    for k, f in enumerate(found):
        columns = model.vocabulary[f]
        x[k, columns[columns >= 0]] = 1
        size[k] = max(1, len(f)) ** 0.5
    return (x @ model.landmarks) / (size[:, None] * model.root[None, :])


def fit(rows: list[tuple[str, str]], per_language: int = 24, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """Landmarks and weights from labelled (text, language) rows."""
    rows = sorted((t, g) for t, g in rows if t and g)
    if not rows:
        return None
    languages = sorted({g for _, g in rows})
    seen = np.zeros(CODES, bool)
    found = [grams(t, seen) for t, _ in rows]
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(g) for _, g in rows])
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == k))[:per_language] for k in range(len(languages))])
    codes = np.unique(np.concatenate([found[k] for k in chosen]))
    vocabulary = np.full(CODES, -1, np.int32)
    vocabulary[codes] = np.arange(len(codes))
    landmarks = np.zeros((len(codes), len(chosen)), np.float32)
    for j, k in enumerate(chosen):
        landmarks[vocabulary[found[k]], j] = 1
    root = np.array([len(found[k]) ** 0.5 for k in chosen], np.float32)
    model = Model(vocabulary, landmarks, root, np.zeros((len(chosen), len(languages)), np.float32), languages)
    kernel = np.concatenate([_features(found[k : k + 256], model) for k in range(0, len(found), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[chosen])
    keep = value > 1e-6 * value.max()
    to_features = vector[:, keep] / np.sqrt(value[keep])
    x = kernel @ to_features
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(label, minlength=len(languages))[label]  # every language weighs alike
    a = (x * weight[:, None]).T @ x
    w = np.linalg.solve(a + ridge * np.trace(a) / len(a) * np.eye(len(a)), (x * weight[:, None]).T @ y)
    model.weights = (to_features @ w).astype(np.float32)
    return model


def labelled_sample(documents: DataFrame, learn_from, per_language: int, longest: int) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language, the first by a hash of the id, texts of at most ``longest`` characters.

    Of many languages each gives fewer, MOST_ROWS in all; over MOST_LANGUAGES values aren't languages, and an error.
    """
    ok = documents.where(learn_from & F.col("lang").isNotNull() & (F.length("text") <= longest) & F.col("text").rlike("\\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ok.select("lang", "doc_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    few = ids.groupBy("lang").count().limit(MOST_LANGUAGES + 1).count()
    if few > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different values of lang")
    ids = ids.where(F.col("rank") <= max(1, min(per_language, MOST_ROWS // max(1, few)))).select("lang", "doc_id")
    rows = ok.select("doc_id", "lang", "text").join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return [(r.text, r.lang) for r in rows.select("text", "lang").collect()]


def predict(model: Model | None, texts: list, seen: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores of whole texts, scored together."""
    guess, score = ["und"] * len(texts), np.zeros(len(texts))
    live = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
    if live:
        out = _features([grams(texts[k], seen) for k in live], model) @ model.weights
        p = np.exp(4 * (out - out.max(1, keepdims=True)).astype(np.float64))
        p /= p.sum(1, keepdims=True)
        for k, best, s in zip(live, out.argmax(1), p.max(1), strict=True):
            guess[k], score[k] = model.languages[best], min(1.0, s)
    return guess, score


def learn(documents: DataFrame, learn_from=None, per_language: int = 200, longest: int = 20_000, landmarks_per_language: int = 24) -> Model | None:
    """The model of at most ``per_language`` labelled rows a language among those that ``learn_from`` accepts; none without such rows."""
    learn_from = F.lit(True) if learn_from is None else learn_from
    return fit(labelled_sample(documents, learn_from, per_language, longest), landmarks_per_language)


def prediction(spark: SparkSession, model: Model | None):
    """A column (lang_pred, score) over any table, of its column ``text`` alone."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, seen = shared.value, np.zeros(CODES, bool)
        for texts in batches:
            guess, score = [], []
            for begin in range(0, len(texts), 64):
                some = predict(model, texts.iloc[begin : begin + 64].tolist(), seen)
                guess += some[0]
                score.append(some[1])
            yield pd.DataFrame({"lang_pred": guess, "score": np.concatenate([np.zeros(0), *score])})

    # only texts go to Python; nondeterministic, so that a filter on the result doesn't run it twice
    return F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()(F.col("text"))


def free_name(name: str, columns: list[str]) -> str:
    """The name, with ``_`` appended until no column has it, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def identify(documents: DataFrame, learn_from=None, **options) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` (0 to 1) added; only the text of a row decides its prediction."""
    bounded_batches(documents.sparkSession)
    model = learn(documents, learn_from, **options)
    held = documents.select(F.struct("*").alias("doc"), prediction(documents.sparkSession, model).alias("p"))
    lang, score = (free_name(n, documents.columns) for n in ("lang_pred", "score"))
    return held.select("doc.*", F.col("p.lang_pred").alias(lang), F.col("p.score").alias(score))


def is_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(documents, learn_from=~is_held_out())
    return out.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
