"""Statistical language identification: character trigrams with add-one smoothing, scored word by word.

The logarithms are whole numbers of millionths, so sums don't depend on their order. A text's score is the sum over its
grams. A model that fits is packed and sent to the executors (see ``packed``): a text is scored where it lies, as one row.
A larger one, with a row a gram, is joined to the grams of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logoscope.functions import codepoints as C

#: Letters of a gram; scale of the stored logarithms.
GRAM, SCALE = 3, 1_000_000
#: Grams of a model that is broadcast; one with more (very large alphabets) is joined by shuffle.
BROADCAST_GRAMS = 500_000


def word_list(text) -> F.Column:
    """Words of letters in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text): each letter of a word with what stands beside it, a space at the word's ends. Tasks
    count the grams of a part of a batch before the shuffle, so a text never becomes a row a letter."""
    shared = C.shared_tables(labelled.sparkSession)

    def count(batches):
        flags = shared.value.flags
        for b in batches:
            langs = b.column(0).dictionary_encode()
            names, who, done = langs.dictionary.to_pylist(), langs.indices.to_numpy(), 0
            for part in C.slices(b.column(1)):
                points, of = C.flatten(C.lowered(part))
                letter = (flags[points] & C.LETTER) > 0
                left, mid, right = C.grams(np.where(letter, points, C.BLANK).astype(np.int64), of, letter, C.BLANK)
                code, owner = left << 42 | mid << 21 | right, who[done + of[letter]]
                done += len(part)
                for i in np.unique(owner):
                    found, n = np.unique(code[owner == i], return_counts=True)
                    cut = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], 1).ravel()
                    said = C.strings(cut, np.full(len(found), GRAM))
                    yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(n), pa.string()), pa.array(said, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    made = labelled.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n, lp): grams by language with scaled log-probabilities. Null and empty texts have none."""
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = gram_counts(known)
    kinds = counts.select("gram").distinct().agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).crossJoin(F.broadcast(kinds))  # a row a language
    scaled = F.round(F.log((F.col("n") + 1) / (F.col("total") + F.col("v"))) * SCALE).cast("long")
    unseen = F.round(F.log(1 / (F.col("total") + F.col("v"))) * SCALE).cast("long")
    return counts.join(F.broadcast(totals), "lang").select("lang", "gram", "n", scaled.alias("lp"), unseen.alias("unseen"))


@dataclass
class Wide:
    """A model as one row a gram: ``table`` (gram, lp_0, lp_1, ...) with a column a language, and each one's unseen value."""

    table: DataFrame
    languages: list[str]
    unseen: list[int]

    def lp(self, i: int) -> Column:
        return F.coalesce(F.col(f"lp_{i}"), F.lit(self.unseen[i]))

    def sums(self) -> list[Column]:
        """Score of every language over the grams of a group of rows; null for a group without grams."""
        return [F.sum(F.when(F.col("gram").isNotNull(), self.lp(i))).alias(f"s_{i}") for i in range(len(self.languages))]

    def joined(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table, "gram", "left")

    def scored(self) -> Column:
        """array<struct<s, lang, conf>> of the sums: s is the score turned round, so the least is the best; conf the
        softmax of the scores. Of equal scores the first language by code comes first. Null without sums."""
        n = range(len(self.languages))
        if not n:
            return F.lit(None).cast("array<struct<s:bigint,lang:string,conf:double>>")
        best = F.greatest(*[F.col(f"s_{i}") for i in n]) if len(n) > 1 else F.col("s_0")
        shares = [F.exp((F.col(f"s_{i}") - best) / SCALE) for i in n]
        total = sum(shares[1:], shares[0])
        found = F.array(*[F.struct((-F.col(f"s_{i}")).alias("s"), F.lit(x).alias("lang"), (shares[i] / total).alias("conf")) for i, x in enumerate(self.languages)])
        return F.when(F.col("s_0").isNotNull(), found)


def wide(model: DataFrame, enabled: list[str] | None = None) -> Wide:
    """``model`` (of few languages, which are collected) in the shape for scoring, restricted to ``enabled`` languages."""
    known = model if enabled is None else model.where(F.col("lang").isin(enabled))
    languages = sorted((r.lang, r.unseen) for r in known.groupBy("lang").agg(F.min("unseen").alias("unseen")).collect())
    columns = [F.max(F.when(F.col("lang") == x, F.col("lp"))).alias(f"lp_{i}") for i, (x, _) in enumerate(languages)]
    table = known.groupBy("gram").agg(*columns) if columns else known.select("gram").distinct()
    few = table.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    return Wide(F.broadcast(table) if few else table, [x for x, _ in languages], [u for _, u in languages])


def grams_of(text: Column) -> Column:
    """Grams of the words of a text, as ``grams`` cuts them: each word gets spaces of its own before and after it, and a
    gram is a letter with what stands beside it. Texts with letters beyond 16 bits are cut word by word."""
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "  "), F.lit("  "))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(GRAM)))
    slow = F.flatten(F.transform(word_list(text), cut))
    return F.when(text.rlike(r"[\x{10000}-\x{10ffff}]"), slow).otherwise(F.regexp_extract_all(padded, F.lit(r"(?=(.\p{L}.))"), F.lit(1)))
