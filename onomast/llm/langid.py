"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts (up to ``order`` bytes)
keeps how often each byte followed. The probability of a byte is its frequency in
the longest context known; a byte new there costs an escape (method C: distinct
followers / (followers + distinct)) and is looked up in the next shorter context,
without the bytes already excluded, down to a uniform 1/256. Statistics are frozen
after training, so a text's code length is a sum over positions of a function of
(context, byte). That function is laid out as an automaton over the contexts of all
languages: one walk of a text gives the exact code lengths under every language.

The model is everything that the sample of labelled rows holds, however rare: every
context and every language. ``rows_per_language`` alone bounds it. An automaton for all
languages at once may be too large to send, so languages are dealt into groups whose
automata stay below ``AUTOMATON_BYTES`` by an upper bound (one language makes a group
however large); each group is a pass over the texts that carries the best language so far,
its code length and the sum of the others' weights, so the result does not depend on the
groups.

Results: ``lang_pred`` is the language of least code length (ties: alphabetically
first), ``score`` its posterior 1 / sum(2 ** -(excess bits)) under equal priors.
Null texts and texts without any letter give ``und`` with score 0; very long texts are read
whole, in strips. Any other column may be null; repeated rows are judged alike; an empty
table gives an empty result. Columns named like the results are replaced. With nothing to
learn from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm._common import CUT_BYTES, cuts, hash53, lean, materialise, maybe_broadcast, nullable, utf8, without

START = 256  # the symbol before a text's first byte, while counting
BASE = 257
FIXED = 256  # code lengths are integers, in 1/256 bit
UNDETERMINED = "und"
AUTOMATON_BYTES = 192 << 20


@dataclass(frozen=True)
class Automaton:
    """Frozen code lengths of some languages. ``symbol``: byte to column; ``step``: next state; ``cost``: by language."""

    langs: tuple[str, ...]
    order: int
    symbol: np.ndarray
    step: np.ndarray
    cost: np.ndarray
    width: int


@dataclass(frozen=True)
class Model:
    """The written counts (lang, gram, n) of the sample, and the languages by groups."""

    langs: tuple[str, ...]
    order: int
    counts: DataFrame | None = None
    groups: tuple[tuple[str, ...], ...] = ()

    def automaton(self, langs: Sequence[str]) -> Automaton:
        rows = self.counts.filter(F.col("lang").isin(list(langs))).toPandas()  # what one group's sample holds
        return build(rows["lang"].to_numpy(object), rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.float64), self.order)


def _grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lo, hi in cuts(offsets, CUT_BYTES):
            part, at = data[offsets[lo] : offsets[hi]].astype(np.int64), offsets[lo : hi + 1] - offsets[lo]
            code = part.copy()
            inside = np.arange(part.size) - np.repeat(at[:-1], np.diff(at))
            for back in range(1, order + 1):
                before = np.full(part.size, START, np.int64)
                before[back:] = part[:-back] if back < part.size else part[:0]
                code += np.where(inside >= back, before, START) * BASE**back
            row_lang = np.repeat(langs[lo:hi], np.diff(at))
            for lang in sorted(set(langs[lo:hi])):
                found, n = np.unique(code[row_lang == lang], return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = 3, rows_per_language: int = 400, most_bytes: int = AUTOMATON_BYTES) -> Model:
    """Learn from a sample of about ``rows_per_language`` whole rows of each language.

    The sample is the rows whose key hashes below rows_per_language / rows; it is
    the model's only bound. Counting is distributed.
    """
    labelled = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("rows"))
    sample = labelled.join(maybe_broadcast(sizes, 64), "lang").filter(hash53(F.lit("langid"), F.coalesce("key", F.lit(""))) < F.lit(float(1 << 52)) * share).select("lang", "text")
    counts = materialise(sample.mapInArrow(lean(lambda it: _grams(it, order)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # for each language: how many contexts there can be, and followers
    level = lambda k: F.count_distinct(F.floor(F.col("gram") / BASE) % BASE**k)
    rows = counts.groupBy("lang").agg(sum((level(k) for k in range(1, order + 1)), F.lit(1)).alias("states"), F.count_distinct(F.col("gram") % BASE).alias("symbols")).orderBy("lang").collect()  # a row for each language
    groups: list[list[str]] = []
    states = symbols = 0
    for r in rows:
        states, symbols = states + r["states"], min(256, symbols + r["symbols"])
        if not groups or states * (symbols + 2) * 4 * (len(groups[-1]) + 2) > most_bytes:
            groups.append([])
            states, symbols = r["states"], r["symbols"]
        groups[-1].append(r["lang"])
    return Model(tuple(r["lang"] for r in rows), order, counts, tuple(map(tuple, groups)))


def build(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int) -> Automaton:
    """The automaton from counts by (language, gram); all arithmetic is by level of the tree."""
    langs = tuple(sorted(set(lang)))
    lang_of = np.searchsorted(np.array(langs, object), lang) if langs else np.empty(0, np.int64)
    seen = np.unique(gram % BASE)
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    width, a = len(seen) + 2, len(seen)  # then: any other byte, and the start of a text
    others = 256 - a
    # by level: the contexts of k bytes that lie within a text
    inside = [np.ones(len(gram), bool)]
    for k in range(1, order + 1):
        inside.append(inside[-1] & ((gram // BASE**k) % BASE != START))
    own = [(gram // BASE) % BASE**k for k in range(order + 1)]
    levels = [np.unique(own[k][inside[k]]) if k else np.zeros(1, np.int64) for k in range(order + 1)]
    first = np.cumsum([0, *map(len, levels)])
    size = int(first[-1])
    step = np.zeros((size, width), np.int32)
    for k, context in enumerate(levels):
        ids = first[k] + np.arange(len(context))
        if k:
            step[ids] = step[first[k - 1] + np.searchsorted(levels[k - 1], context % BASE ** (k - 1))]
        if k < order and a and len(levels[k + 1]):
            child = context[:, None] * BASE + seen[None, :]
            at = np.minimum(np.searchsorted(levels[k + 1], child), len(levels[k + 1]) - 1)
            step[ids[:, None], np.arange(a)[None, :]] = np.where(levels[k + 1][at] == child, first[k + 1] + at, step[ids][:, :a])
    cost = np.zeros((len(langs), size, width), np.int16)  # 100 bits at most, by the floor of p
    weight = np.ones(a + 1)
    weight[a] = others
    for j in range(len(langs)):
        p = np.zeros((size, a + 1))
        for k, context in enumerate(levels):
            ids = first[k] + np.arange(len(context))
            pick = inside[k] & (lang_of == j)
            count = np.zeros((len(context), a + 1))
            np.add.at(count, (np.searchsorted(context, own[k][pick]), symbol[gram[pick] % BASE]), n[pick])
            below = p[first[k - 1] + np.searchsorted(levels[k - 1], context % BASE ** (k - 1))] if k else np.full((1, a + 1), 1 / 256)
            total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            rest = np.where(count > 0, 0, below * weight).sum(1, keepdims=True)
            escape = np.where(rest > 0, distinct, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                here = np.where(count > 0, count / (total + escape), escape / (total + escape) * below / rest)
            p[ids] = np.where(total > 0, here, below)
        cost[j, :, : a + 1] = np.rint(-np.log2(np.maximum(p, 1e-30)) * FIXED)
    return Automaton(langs, order, symbol.astype(np.int32), step.reshape(-1), cost.reshape(len(langs), size * width), width)


def code_lengths(model: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact code lengths, in 1/FIXED bits: one row for each text, one column for each language.

    Texts lie behind one another, a start symbol before each; the line is cut into
    strips that are walked side by side. A state depends on the last ``order`` symbols
    only, so so many symbols before a strip set its first state.
    """
    texts, w, k = len(offsets) - 1, model.width, model.order
    length = data.size + texts
    line = np.full(length, w - 1, np.int32)
    line[np.arange(data.size) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))] = model.symbol[data]
    strips = int(np.clip(length // 128, 1, 8192))
    each = -(-length // strips)
    padded = np.concatenate([np.full(k, w - 1, np.int32), line, np.full(strips * each - length, w - 1, np.int32)])
    columns = np.lib.stride_tricks.as_strided(padded, (strips, k + each), (4 * each, 4)).T.copy()
    state, visited = np.zeros(strips, np.int32), np.empty((each, strips), np.int32)
    for t in range(k + each):
        at = state * w + columns[t]
        if t >= k:
            visited[t - k] = at
        state = model.step.take(at)
    at = visited.T.ravel()[:length]
    starts = offsets[:-1] + np.arange(texts)
    return np.stack([np.add.reduceat(c.take(at), starts, dtype=np.int64) for c in model.cost], 1)


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: Sequence[Column | str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with ``lang_pred`` and ``score``; columns of these names are replaced."""
    kept = without(docs, "lang_pred", "score") if keep is None else docs.select(*keep)
    names = kept.columns
    n = len(names)
    if not model.langs:
        return kept.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    # positions, not names, inside the job: columns may be called anything
    given = (kept if keep is None else docs.select(*keep, F.col(text))).toDF(*[f"c{i}" for i in range(n + (keep is not None))])
    read = f"c{n if keep is not None else [c.lower() for c in kept.columns].index(text.lower())}"
    carried = nullable(given.schema)
    # best so far: its language, its bits, and the sum of 2 ** -(excess bits) of all languages seen
    given = given.withColumns({"best": F.lit(None).cast("string"), "bits": F.lit(float("inf")), "mass": F.lit(0.0)})
    schema = T.StructType([*carried, T.StructField("best", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("mass", T.DoubleType())])
    for i, langs in enumerate(model.groups):
        shared = docs.sparkSession.sparkContext.broadcast(model.automaton(langs))  # AUTOMATON_BYTES, or one language
        given = given.mapInArrow(lean(_pass(shared, read)), schema)
        if i + 1 < len(model.groups):
            given = materialise(given)  # so that a worker holds one automaton at a time
    letters = F.coalesce(F.col(read).rlike(r"\p{L}"), F.lit(False))
    pred, score = F.when(letters, F.col("best")).otherwise(UNDETERMINED), F.when(letters, 1 / F.col("mass")).otherwise(0.0)
    return given.select(*[f"c{i}" for i in range(n)], pred.alias("lang_pred"), score.alias("score")).toDF(*names, "lang_pred", "score")


def _pass(shared, read: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Automaton = shared.value
        names = np.array(own.langs, dtype=object)
        for batch in batches:
            data, offsets = utf8(batch.column(read))
            for lo, hi in cuts(offsets, CUT_BYTES):
                part = batch.slice(lo, hi - lo)
                bits = code_lengths(own, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) / FIXED
                least, before = bits.min(1), part.column("bits").to_numpy()
                new = least < before
                now = np.where(new, least, before)
                with np.errstate(invalid="ignore"):
                    old = np.where(np.isinf(before), 0.0, part.column("mass").to_numpy() * np.exp2(-np.minimum(before - now, 1000)))
                mass = old + np.exp2(-np.minimum(bits - now[:, None], 1000)).sum(1)
                best = np.where(new, names[bits.argmin(1)], part.column("best").to_numpy(zero_copy_only=False))
                done = {"best": pa.array(best, pa.string()), "bits": pa.array(now), "mass": pa.array(mass)}
                yield pa.record_batch([done.get(c, part.column(c)) for c in batch.schema.names], batch.schema.names)

    return run
