"""The trigram model in a shape that scores whole texts where they lie, without a row a gram.

Grams are numbers over the alphabet of the model, sorted, with a column of weights a language; a text's grams are looked up
and summed by text in numpy. A model of more than CELLS weights isn't packed: it is joined instead (see ``ngram``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from logoscope.functions import codepoints as C
from logoscope.operators import ngram

#: Weights of a model that is sent to all executors (8 bytes each); codes that are looked up in a plain table.
CELLS, DENSE = 20_000_000, 1 << 24
#: A scorer takes a column of text and gives the likeliest language with its confidence, null for none.
Scorer = Callable[[Column], Column]
SCORE = "struct<lang:string,conf:double>"


@dataclass
class Packed:
    languages: list[str]
    alphabet: np.ndarray  # by code point: number of a letter, 1 for the space, 0 for what the model lacks
    letters: int
    codes: np.ndarray
    weights: np.ndarray  # a row a language; the first column is for grams that the model lacks
    flags: np.ndarray
    dense: np.ndarray | None = None

    def __post_init__(self):
        if self.letters**3 <= DENSE:
            self.dense = np.zeros(self.letters**3, np.int32)
            self.dense[self.codes] = np.arange(1, len(self.codes) + 1)

    def slots(self, code: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[code]
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        return np.where(self.codes[at] == code, at + 1, 0) if len(self.codes) else np.zeros(len(code), np.int64)

    def sums(self, points: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores (``n`` by languages) of texts in lower case, and the number of their grams. Whole numbers, so sums are exact."""
        letter = (self.flags[points] & C.LETTER) > 0
        a = np.where(letter, self.alphabet[points], 1).astype(np.int64)
        left, mid, right = C.grams(a, of, letter, 1)
        slot, of = self.slots((left * self.letters + mid) * self.letters + right), of[letter]
        scores = [np.bincount(of, w[slot], n) for w in self.weights]
        return np.stack(scores, 1) if scores else np.zeros((n, 0)), np.bincount(of, minlength=n)

    def shares(self, sums: np.ndarray) -> np.ndarray:
        """Confidences: the softmax of scores."""
        e = np.exp((sums - sums.max(1, keepdims=True)) / ngram.SCALE)
        return e / e.sum(1, keepdims=True)


def pack(model: DataFrame, enabled: list[str] | None = None) -> Packed | None:
    """``model`` restricted to ``enabled`` languages; None if it has too many weights to be sent around."""
    by = ngram.wide(model, enabled)
    n = max(1, len(by.languages))
    if by.table.limit(CELLS // n + 1).count() > CELLS // n:
        return None
    table = by.table.toArrow()
    grams = table.column("gram").to_pylist()
    alphabet = np.zeros(0x110000, np.uint32)
    known = sorted(set("".join(grams)) - {" "})
    alphabet[C.BLANK] = 1
    for i, c in enumerate(known):
        alphabet[ord(c)] = i + 2
    letters = len(known) + 2
    points = C.flatten(grams)[0].reshape(-1, ngram.GRAM)
    a = alphabet[points].astype(np.int64)
    codes = (a[:, 0] * letters + a[:, 1]) * letters + a[:, 2]
    order = np.argsort(codes)
    weights = np.empty((len(by.languages), len(grams) + 1))
    for i, unseen in enumerate(by.unseen):
        weights[i, 0] = unseen
        weights[i, 1:] = table.column(f"lp_{i}").fill_null(unseen).to_numpy()[order]
    return Packed(by.languages, alphabet, letters, codes[order], weights, C.tables().flags)


def scores_udf(spark: SparkSession, packed: Packed):
    """UDF text -> array<struct<lang, score, conf>>, languages by code; null for a text without letters."""
    shared = spark.sparkContext.broadcast(packed)

    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        n, k = len(texts), len(model.languages)
        sums, grams = model.sums(*C.flatten(C.lowered(texts)), n)
        some = grams > 0 if k else np.zeros(n, bool)
        sums = sums[some]
        rows = pa.StructArray.from_arrays(
            [pa.array(model.languages * len(sums), pa.string()), pa.array(sums.astype(np.int64).ravel()), pa.array(model.shares(sums).ravel() if k else [], pa.float64())],
            ["lang", "score", "conf"],
        )
        offsets = np.concatenate([[0], np.cumsum(some * k)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), rows, mask=pa.array(~some))

    return F.arrow_udf(C.in_slices(score), "array<struct<lang:string,score:long,conf:double>>")


def best(model: Packed, texts: list[str]) -> pa.StructArray:
    """SCORE of texts in lower case, null for one without letters."""
    if not model.languages:
        return pa.nulls(len(texts), pa.struct([("lang", pa.string()), ("conf", pa.float64())]))
    sums, grams = model.sums(*C.flatten(texts), len(texts))
    shares = model.shares(sums)
    top = sums.argmax(1)
    found = pa.array(model.languages, pa.string()).take(pa.array(top))
    return pa.StructArray.from_arrays([found, pa.array(shares[np.arange(len(top)), top])], ["lang", "conf"], mask=pa.array(grams == 0))


def scorer(spark: SparkSession, packed: Packed) -> Scorer:
    """The model as a scorer; of equal scores the first language by code counts."""
    shared = spark.sparkContext.broadcast(packed)

    return F.arrow_udf(C.in_slices(lambda texts: best(shared.value, C.lowered(texts))), SCORE)


def checked(spark: SparkSession, score: Scorer) -> Scorer:
    """``score``, if what it makes of a text is a language (string) with a confidence (double); else a TypeError."""
    made = spark.createDataFrame([], "text string").select(score(F.col("text")).alias("s")).schema["s"].dataType
    fields = {f.name: f.dataType for f in made.fields} if isinstance(made, StructType) else {}
    if fields != {"lang": StringType(), "conf": DoubleType()}:
        raise TypeError(f"a scorer must give {SCORE}, not {made.simpleString()}")
    return score


def scores(texts: DataFrame, model: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, lang, score, conf): confidence of every language for every text with a word, as a softmax of the scores."""
    if fits := pack(model):
        found = texts.select(*key, F.explode(scores_udf(texts.sparkSession, fits)(F.col(text_col))).alias("_x"))
        return found.select(*key, "_x.lang", "_x.score", "_x.conf")
    by = ngram.wide(model)
    rows = by.joined(texts.select(*key, F.explode(ngram.grams_of(F.col(text_col))).alias("gram")))
    found = rows.groupBy(*key).agg(*by.sums()).select(*key, F.explode(by.scored()).alias("x"))
    return found.select(*key, F.col("x.lang").alias("lang"), (-F.col("x.s")).alias("score"), F.col("x.conf").alias("conf"))


def top(texts: DataFrame, model: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, lang, conf): the likeliest language of each text with a word; of equals the first by code."""
    if fits := pack(model):
        found = texts.select(*key, scorer(texts.sparkSession, fits)(F.col(text_col)).alias("_x")).where("_x is not null")
        return found.select(*key, "_x.lang", "_x.conf")
    by = ngram.wide(model)
    rows = by.joined(texts.select(*key, F.explode(ngram.grams_of(F.col(text_col))).alias("gram")))
    best = rows.groupBy(*key).agg(*by.sums()).select(*key, F.array_min(by.scored()).alias("b"))
    return best.select(*key, F.col("b.lang").alias("lang"), F.col("b.conf").alias("conf"))
