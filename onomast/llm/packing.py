"""Best-fit packing of documents into sequences, certified by lower bounds.

``pieces`` encodes each document once, ends it with ``eos`` and cuts only documents
longer than ``limit``: the first piece takes the remainder, all others are full.
``pack`` gives each piece a sequence and an offset:

1. Pieces are dealt at random into groups of at most about ``group_rows``; each group
   is packed by best-fit decreasing, in one task, on lengths alone.
2. Each group's number of sequences is held against a lower bound from dual feasible
   functions on its histogram of lengths (the identity and the u^(k)- and f_eps-
   functions of Fekete and Schepers). A group that meets the bound is certified.
3. The pieces of sequences with gaps, of all groups, are exchanged: dealt into fewer
   groups and packed again. A new packing replaces the old one only where it uses fewer
   sequences. This ends when the whole packing meets the bound of the whole histogram,
   or two exchanges in a row gain nothing. ``excess`` then says for each piece how many
   sequences its group has above its bound: 0 is certified, the rest is not.

Null text: an empty document (its piece is the ``eos`` alone). Equal rows are separate
pieces, ties of length are packed in any order, ids may be null. Very long texts are encoded
whole. Lengths below 1 or above ``limit`` in ``pack`` raise an error. An empty table
gives an empty result. Other columns are carried unless they clash with new ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm import tokens
from onomast.llm._common import CUT_BYTES, cuts, give_back, lean, materialise, nullable, utf8

LIMIT = 1024


def pieces(docs: DataFrame, path: str, *, text: str = "text", keep: Sequence[Column | str] = ("doc_id",), limit: int = LIMIT, eos: int = 2) -> DataFrame:
    """``keep`` with ``piece``, ``start``, ``length`` and ``ids`` (little-endian uint32)."""
    kept = docs.select(*keep)
    names, n = kept.columns, len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(n))
            for lo, hi in cuts(offsets, CUT_BYTES):
                coded = tokens.encode(path, batch.column(n).slice(lo, hi - lo).to_pylist())
                size = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
                ids = np.empty(int(size.sum()), "<u4")
                end = np.cumsum(size)
                for x, e, m in zip(coded, end, size, strict=True):
                    ids[e - m : e - 1] = x
                ids[end - 1] = eos
                parts = -(-size // limit)
                first = size - (parts - 1) * limit
                row = np.repeat(np.arange(len(size)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                length = np.where(piece == 0, first[row], limit)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * limit)
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * np.int32(4)
                blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                carried = [c.take(pa.array(row)) for c in batch.slice(lo, hi - lo).columns[:n]]
                yield pa.record_batch([*carried, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blob], out)

    inner = [f"c{i}" for i in range(n)]
    out = [*inner, "piece", "start", "length", "ids"]
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(inner, kept.schema, strict=True)], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(*keep, F.col(text)).toDF(*inner, "text").mapInArrow(lean(run), schema).toDF(*names, "piece", "start", "length", "ids")


def lower_bound(histogram: np.ndarray, limit: int = LIMIT) -> int:
    """The largest bound by a dual feasible function; ``histogram[x]``: pieces of length x."""
    x = np.arange(limit + 1, dtype=np.int64)
    h = histogram.astype(np.int64)
    best = -(-int((x * h).sum()) // limit)
    for k in range(1, 65):  # u^(k): multiples of limit / (k + 1) keep their share, others round down
        scaled = (k + 1) * x
        u = np.where(scaled % limit == 0, x * k, (scaled // limit) * limit)  # times k * limit
        best = max(best, -(-int((u * h).sum()) // (k * limit)))
    suffix_n, total = np.cumsum(h[::-1])[::-1], np.cumsum(x * h)
    for eps in range(1, limit // 2 + 1):  # over limit - eps counts whole, below eps nothing
        large = int(suffix_n[limit - eps + 1])
        middle = int(total[limit - eps] - total[eps - 1])
        best = max(best, large + -(-middle // limit))
    return best


def best_fit(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset, and each bin's fill.

    Bins wait in a stack for each room left; a bit for each non-empty stack finds the
    least room that is enough.
    """
    n = len(lengths)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    mask, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, bin_ = limit, len(fills)
            fills.append(0)
        where[i], offset[i] = bin_, limit - room
        room -= size
        fills[bin_] = limit - room
        if room:
            if not stacks[room]:
                mask |= 1 << room
            stacks[room].append(bin_)
    return where, offset, np.array(fills, np.int64)


def _packed(limit: int, prefix: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        where, offset, fill = best_fit(frame["length"].to_numpy(), limit)
        bound = lower_bound(np.bincount(frame["length"].to_numpy(), minlength=limit + 1), limit)
        bins = len(fill)
        give_back()
        return frame.assign(sequence_id=(np.int64(prefix) << 56) + (np.int64(key[0]) << 32) + where, offset=offset, fill=fill[where], bins=np.int64(bins), bound=np.int64(bound))

    return run


def _deal(df: DataFrame, groups: int, seed: int) -> DataFrame:
    return df.withColumn("g", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).cast("long"))


def pack(parts: DataFrame, *, limit: int = LIMIT, group_rows: int = 65_536, exchanges: int = 8) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``excess``. Carry ids only if you need them; they are not needed here."""
    clash = [c for c in parts.columns if c.lower() in ("sequence_id", "offset", "excess")]
    parts = parts.drop(*clash)
    names = parts.columns
    # a number for each row, fixed by the written table: equal rows stay apart
    table = materialise(parts.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("`length`").cast("long").alias("length"), F.monotonically_increasing_id().alias("row")))
    counted = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # limit rows at most, or an error
    if any(x is None or not 1 <= x <= limit for x in counted):
        raise ValueError(f"lengths must be from 1 to {limit}")
    histogram = np.zeros(limit + 1, np.int64)
    for x, n in counted.items():
        histogram[x] = n
    bound, rows = lower_bound(histogram, limit), int(histogram.sum())
    shape = T.StructType([T.StructField("row", T.LongType()), T.StructField("length", T.LongType()), T.StructField("g", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "fill", "bins", "bound")]])

    def packed(df: DataFrame, round_: int) -> DataFrame:
        return materialise(df.groupBy("g").applyInPandas(_packed(limit, round_), shape))

    small = table.filter(F.col("length") < limit).select("row", "length")
    groups = max(1, -(-(rows - int(histogram[limit])) // group_rows))
    done = packed(_deal(small, groups, 0), 0)
    final: list[DataFrame] = []
    used = int(histogram[limit]) + _bins(done)
    idle = 0
    for round_ in range(1, exchanges + 1):
        if used <= bound or idle == 2:
            break
        gaps = done.filter(F.col("fill") < limit)
        n, before = gaps.count(), gaps.select("sequence_id").distinct().count()
        fewer = max(1, -(-n // group_rows))
        new = packed(_deal(gaps.select("row", "length"), fewer, round_), round_)
        after = _bins(new)
        if after < before:
            final.append(done.filter(F.col("fill") == limit))
            done, used, idle = new, used - before + after, 0
        else:
            idle += 1
        if fewer == 1 and after <= lower_bound_of(new, limit):
            break  # what is left is certified as a whole
    for part in final:
        done = done.unionByName(part)
    whole = table.filter(F.col("length") == limit).select("row", F.lit(0).cast("long").alias("offset"), (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("excess"))
    placed = done.select("row", "offset", "sequence_id", F.greatest(F.lit(0), F.col("bins") - F.col("bound")).alias("excess")).unionByName(whole)
    return table.drop("length").join(placed, "row").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "sequence_id", "offset", "excess")


def _bins(df: DataFrame) -> int:
    return int(df.select("g", "bins").distinct().agg(F.coalesce(F.sum("bins"), F.lit(0))).collect()[0][0])


def lower_bound_of(df: DataFrame, limit: int) -> int:
    """The sum of the groups' own bounds."""
    return int(df.select("g", "bound").distinct().agg(F.coalesce(F.sum("bound"), F.lit(0))).collect()[0][0])
