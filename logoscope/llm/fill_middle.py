"""Fill-in-the-middle: texts cut in three at units and put together in another order, batch by batch in Arrow.

A batch of texts is one run of Arrow kernels: texts are split into lists of units, the lists are flattened with the index
of their text, every unit gets its ordinal, units are filtered by the role that the ordinal has (prefix, middle, suffix),
lists are rebuilt from what remains, and the pieces of a role, then the pieces of a text, are joined. No row is looked at
by itself. It is one map over the table: nothing is shuffled, and a lost task is a batch computed again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN, PSM, SPM = "plain", "psm", "spm"
ROLES = 3
#: Characters of texts that go through the kernels at once; a longer text goes alone.
RUN_CHARS = 1 << 24


@dataclass(frozen=True)
class Marks:
    """Sentinels before prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        firsts = {m[:1] for m in self.all()}
        if "" in firsts or len(set(self.all())) < ROLES or any(c in firsts for m in self.all() for c in m[1:]):
            raise ValueError("marks must differ, and none may hold the first character of a mark again: only then can a text be rebuilt")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(seed: str, ident: Column) -> list[Column]:
    """Four numbers below 2^32 of an identifier: the first groups of eight hexadecimal digits of a sha256."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of texts with their newlines, flattened; index of their text, ordinal in it, and lines of each text."""
    split = pc.split_pattern(texts, "\n")
    parents = pc.list_parent_indices(split).to_numpy()
    flat = pc.list_flatten(split)
    sizes = pc.list_value_length(split).to_numpy()
    starts = np.cumsum(sizes) - sizes
    ordinal = np.arange(len(flat)) - starts[parents]
    ends = ordinal == sizes[parents] - 1  # what follows the last newline: a unit only if it is not empty
    newline = pc.if_else(pa.array(ends), pa.scalar("", flat.type), pa.scalar("\n", flat.type))
    kept = ~ends | (pc.binary_length(flat).to_numpy() > 0)
    units = pc.binary_join_element_wise(flat, newline, pa.scalar("", flat.type)).filter(pa.array(kept))
    parents, ordinal = parents[kept], ordinal[kept]
    return units, parents, ordinal, np.bincount(parents, minlength=len(texts))


def _joined(units: pa.Array, parents: np.ndarray, rows: int, role: np.ndarray) -> pa.Array:
    """Of every text the units of a role as one string."""
    ends = np.cumsum(np.bincount(parents[role], minlength=rows))
    offsets = np.concatenate([[0], ends])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), units.filter(pa.array(role)))
    return pc.binary_join(lists, pa.scalar("", units.type))


def _run(texts: pa.Array, h: list[np.ndarray], marks: Marks, fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """[n, form, prefix_chars, middle_chars, output] of a run of texts without nulls."""
    units, parents, ordinal, n = _units(texts)
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    roles = [ordinal < low[parents], (ordinal >= low[parents]) & (ordinal < high[parents]), ordinal >= high[parents]]
    prefix, middle, suffix = (_joined(units, parents, len(texts), r) for r in roles)
    plain = pc.equal(pc.binary_length(texts), 0)
    for m in marks.all():
        plain = pc.or_(plain, pc.match_substring(texts, m))
    plain = pc.or_(plain, pa.array(h[2] % 100 >= fim_percent))
    spm = pa.array(h[3] % 100 < spm_percent)
    of = lambda m: pa.scalar(m, texts.type)
    join = lambda *parts: pc.binary_join_element_wise(*parts, of(""))
    before = join(of(marks.prefix), prefix, of(marks.suffix), suffix, of(marks.middle), middle)
    after = join(of(marks.suffix), suffix, of(marks.prefix), prefix, of(marks.middle), middle)
    output = pc.if_else(plain, texts, pc.if_else(spm, after, before))
    form = pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, output]


def transform(
    docs: DataFrame,
    seed: str = "7",
    fim_percent: int = 100,
    spm_percent: int = 50,
    marks: Marks | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): whole texts of all rows, rearranged at two of their line ends.

    The cuts, the share of texts that stay plain and the form come from a hash of seed and id, so they don't depend on
    partitions and a task that runs again gives the same rows. Null text counts as empty; an empty text, and one that
    holds a mark, stays plain. Rows of a repeated id are each rearranged, by the same numbers; a null id is hashed as an empty
    one. Extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    marks = marks or Marks()

    def run(batches):
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            h = [b.column(i).to_numpy() for i in range(2, 6)]
            filled = np.cumsum(pc.binary_length(texts).to_numpy()) // RUN_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(texts)] if len(texts) else []
            for s, e in zip(cuts, cuts[1:], strict=False):
                out = _run(pa.concat_arrays([texts[s:e]]), [x[s:e] for x in h], marks, fim_percent, spm_percent)
                out[1], out[4] = out[1].cast(pa.string()), out[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0)[s:e], *out], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    ident = docs[id_col]
    rows = docs.select(ident.alias("id"), docs[text_col].alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(draws(seed, ident))])
    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: Marks | None = None) -> Column:
    """The text that an output was made from: a text that is not plain holds no mark of its own."""
    marks = marks or Marks()
    parts = F.split(output, "|".join(r"\Q" + m + r"\E" for m in marks.all()), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == PSM, F.concat(at(1), at(3), at(2))).when(form == SPM, F.concat(at(2), at(3), at(1))).otherwise(output)
