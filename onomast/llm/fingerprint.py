"""Fingerprints by improbable-feature digests.

Every window of ``WINDOW`` bytes has a Shannon entropy (in thousandths of the largest).
Windows are ranked by how rare their entropy is in the whole corpus, the rarest first;
windows of nearly equal bytes come last. Each run of ``NEIGHBOURS`` windows votes for
its leftmost best-ranked one, and windows with at least ``POPULAR`` votes are features
(in a text of at most ``FEW`` windows all are, where none is so popular the ``FEW`` best-ranked; a
text shorter than a window is one).
A feature's 64-bit hash sets five bits of a Bloom filter of 2048 bits; after ``FULL``
features the next filter of the chain begins. The fingerprint is the chain's bytes, in base64.

Likeness: each filter of the shorter chain looks for its best partner in the other.
A pair's overlap is the number of common bits, less what chance gives filters so full,
over the most there can be, less the same. The mean, by bits set, is from 0 to 1.
Equal fingerprints have likeness 1, an empty one and another have 0.

Null counts as an empty text, which has an empty fingerprint. Repeated rows have one
fingerprint; ids may be null or repeated (see ``neighbours``); very long texts are read whole,
and their likeness takes time with the product of the chains' lengths. Only id and text are
read, so other columns may be called anything. An empty table gives an empty result. Entropies of all windows
of a batch are kept up to date byte by byte in strips that are walked side by side.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.llm._common import cuts, mix64, utf8

WINDOW, NEIGHBOURS, POPULAR, FEW, DULL = 16, 32, 6, 64, 250
FILTER_BYTES, FULL, PER_FEATURE = 256, 160, 5
BITS = FILTER_BYTES * 8
CLASSES = 1001
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_C = np.arange(WINDOW + 2)
_G = np.rint(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * 4096).astype(np.int32)
_DOWN = np.concatenate([[0], np.diff(_G)]).astype(np.int32)  # a byte's count falls from c to c - 1
_UP = np.append(np.diff(_G), 0).astype(np.int32)  # and rises from c to c + 1


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy class (0 to 1000) of the window that starts at each byte, as far as there is one."""
    n = data.size - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int16)
    strips = int(np.clip(n // 256, 1, 8192))
    each = -(-n // strips)
    padded = np.concatenate([data, np.zeros(strips * each + WINDOW - 1 - data.size, np.uint8)])
    line = np.lib.stride_tricks.as_strided(padded, (strips, each + WINDOW - 1), (each, 1)).T.astype(np.int32)
    line += (np.arange(strips, dtype=np.int32) * 256)[None, :]
    count, sums = np.zeros(strips * 256, np.uint8), np.zeros(strips, np.int32)
    out = np.empty((each, strips), np.int32)
    for t in range(each + WINDOW - 1):
        if t >= WINDOW:
            at = line[t - WINDOW]
            c = count.take(at)
            sums -= _DOWN.take(c)
            count[at] = c - 1
        at = line[t]
        c = count.take(at)
        sums += _UP.take(c)
        count[at] = c + 1
        if t >= WINDOW - 1:
            out[t - WINDOW + 1] = sums
    most = float(WINDOW * np.log2(WINDOW) * 4096)
    table = np.rint(1000 * (1 - np.arange(int(most) + 2) / most)).clip(0, 1000).astype(np.int16)
    return table.take(out.T.ravel()[:n])


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes by window start, and how many windows each text has."""
    return entropies(data), np.maximum(np.diff(offsets) - WINDOW + 1, 0)


def rarity(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """The rank of each entropy class, rarest first, over all windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in cuts(offsets, 1 << 20):
                at = offsets[lo : hi + 1] - offsets[lo]
                classes, n = _windows(data[offsets[lo] : offsets[hi]], at)
                inside = np.zeros(len(classes) + 1, np.int64)
                np.add.at(inside, at[:-1][n > 0], 1)
                np.add.at(inside, (at[:-1] + n)[n > 0], -1)
                total += np.bincount(classes[np.cumsum(inside)[:-1] > 0], minlength=CLASSES)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["class", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()  # 1001 at most
    n = np.zeros(CLASSES, np.int64)
    for r in rows:
        n[r["class"]] = r["n"]
    n[:DULL] = np.iinfo(np.int64).max
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), n))] = np.arange(CLASSES)
    return rank


def digests(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[bytes]:
    """The fingerprint of each text of a batch."""
    texts, size = len(offsets) - 1, np.diff(offsets)
    classes, n = _windows(data, offsets)
    feature_text, feature_hash, feature_at = [], [], []
    if len(classes):
        length = len(classes)
        key = (rank[classes] << 32) | np.arange(length)
        least = key.copy()
        step = 1
        while step < NEIGHBOURS:  # the least of 2, 4, 8, ... windows from here
            if step < length:
                least[: length - step] = np.minimum(least[: length - step], least[step:])
            step *= 2
        room = np.maximum(n - NEIGHBOURS + 1, 0)
        room[n <= FEW] = 0
        voters = np.repeat(offsets[:-1] - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
        votes = np.bincount(least[voters] & 0xFFFFFFFF, minlength=length)
        chosen = votes >= POPULAR
        small = np.where(n <= FEW, n, 0)
        chosen[np.repeat(offsets[:-1] - (np.cumsum(small) - small), small) + np.arange(int(small.sum()))] = True
        # where no window is popular (all of one class, say), the best-ranked stand for the text
        upto = np.concatenate([[0], np.cumsum(chosen)])
        own = upto[np.minimum(offsets[:-1] + n, length)] - upto[np.minimum(offsets[:-1], length)]
        for i in np.flatnonzero((n > FEW) & (own == 0)):
            chosen[offsets[i] + np.argpartition(key[offsets[i] : offsets[i] + n[i]], FEW - 1)[:FEW]] = True
        at = np.flatnonzero(chosen)
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].copy().view(np.uint64)
        feature_hash.append(mix64(mix64(view[:, 0]) ^ (view[:, 1] * np.uint64(0x9E3779B97F4A7C15))))
        feature_text.append(np.searchsorted(offsets, at, "right") - 1)
        feature_at.append(at)
    short = np.flatnonzero((n == 0) & (size > 0))
    if len(short):
        feature_hash.append(np.array([int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64))
        feature_text.append(short)
        feature_at.append(offsets[short])
    if not feature_text:
        return [b""] * texts
    text, hash_, at = (np.concatenate(x) for x in (feature_text, feature_hash, feature_at))
    order = np.argsort(at, kind="stable")
    text, hash_ = text[order], hash_[order]
    per = np.bincount(text, minlength=texts)
    filters = -(-per // FULL)
    first = np.cumsum(filters) - filters
    which = first[text] + (np.arange(len(text)) - (np.cumsum(per) - per)[text]) // FULL
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for i in range(PER_FEATURE):
        bits[which, ((hash_ >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    blob = np.packbits(bits, axis=1).tobytes()
    return [blob[a * FILTER_BYTES : (a + c) * FILTER_BYTES] for a, c in zip(first.tolist(), filters.tolist(), strict=True)]


def likeness(x: bytes, y: bytes) -> float:
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    a, b = sorted((np.frombuffer(v, np.uint64).reshape(-1, FILTER_BYTES // 8) for v in (x, y)), key=len)
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.zeros(len(a))
    for lo in range(0, len(b), 512):
        part, size = b[lo : lo + 512], nb[lo : lo + 512]
        for i in range(len(a)):
            chance = na[i] * size / BITS
            most = np.minimum(na[i], size) - chance
            common = np.bitwise_count(a[i] & part).sum(1, dtype=np.int64)
            best[i] = max(best[i], float(np.clip((common - chance) / np.maximum(most, 1e-9), 0, 1).max()))
    return float((best * na).sum() / na.sum())


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fingerprint(docs: DataFrame, rank: np.ndarray, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in cuts(offsets, 1 << 20):
                found = digests(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shared.value)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([encoded(x) for x in found], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, fingerprint string")


def encoded(chain: bytes) -> str:
    return base64.b64encode(chain).decode()


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range(id: Column, cut: list[int]) -> Column:
    """Descending: the largest ids in 0, null ids in the last; a binary search in ``cut``."""
    found = F.lit(0)
    if cut:
        steps = [1 << k for k in reversed(range(len(cut).bit_length()))]
        at = lambda pos: F.get(F.array(*map(F.lit, cut)), pos)
        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda pos, step: F.when(F.coalesce(at(pos + step - 1) < id, F.lit(False)), pos + step).otherwise(pos))
    return F.when(id.isNull(), len(cut) + 1).otherwise(len(cut) - found).cast("int")


def neighbours(docs: DataFrame, rank: np.ndarray, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Each row's fingerprint, its edited text's, and the likeness to that and to the next row.

    The next row has the next smaller id (ties: by a hash of the text; null ids come
    last); after the last comes the first. Rows are dealt by ranges of ids, so each text
    is shuffled once; the first row of each range is also sent to the range before. An id
    (or null) that fills several ranges has one of its own, parted by ranges of the hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    bins = min(65_536, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / bins) for i in range(1, bins)]) if bins > 1 else F.array(F.lit(0.5)), F.lit(20_000)).alias("q")).first()["q"] or []
    full = {x for x, y in zip(cut, cut[1:], strict=False) if x == y}
    cut = sorted({*cut, *(x - 1 for x in full)})  # ``bins`` and as many again, at most
    binned = rows.withColumn("range", _range(F.col("doc_id"), cut))
    sizes = binned.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one")).collect()  # a row for each range
    if not sizes:
        return spark.createDataFrame([], FIELDS)
    most = 2 * -(-sum(r["n"] for r in sizes) // bins)
    parts = {r["range"]: -(-r["n"] // most) for r in sizes if r["one"] and r["n"] > most}
    part = F.lit(0)
    for r, n in parts.items():  # fewer than ``bins`` ids are that frequent
        part = F.when(F.col("range") == r, F.least(F.lit(n - 1), F.floor((F.col("h") / 2.0**64 + 0.5) * n)).cast("int")).otherwise(part)
    binned = binned.withColumn("part", part)
    first = F.max(F.struct("doc_id", F.bitwise_not("h").alias("o")))  # of a range: the largest id, then the least hash; null is least
    tops = sorted(((r["range"], r["part"], r["t"]["doc_id"], ~r["t"]["o"]) for r in binned.groupBy("range", "part").agg(first.alias("t")).collect()), key=lambda t: t[:2])
    shared = spark.sparkContext.broadcast(rank)
    # a range's bin is its place; the first bin's top is the last one's guest
    borders = F.broadcast(spark.createDataFrame([(r, p, i, top, h, (i - 1) % len(tops)) for i, (r, p, top, h) in enumerate(tops)], "range int, part int, bin int, top long, top_h long, guest_of int"))
    own, guest = F.struct(F.col("bin"), F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("bin"), F.lit(True).alias("guest"))
    placed = binned.join(borders, ["range", "part"])
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("h") == F.col("top_h")), F.array(own, guest)).otherwise(F.array(own))
    dealt = placed.withColumn("x", F.explode(copies)).select(F.col("x.bin").alias("bin"), F.col("x.guest").alias("guest"), "doc_id", "text", "h")
    dealt = dealt.repartition("bin").sortWithinPartitions("bin", "guest", F.desc_nulls_last("doc_id"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_ = shared.value
        held: tuple | None = None  # the last row so far: bin, guest, id, text, fingerprint
        for batch in batches:
            _, offsets = utf8(batch.column(3))
            for lo, hi in cuts(offsets, 1 << 20):
                part = batch.slice(lo, hi - lo)
                texts = part.column(3).to_pylist()
                prints = digests(*_flat([t.encode() for t in texts]), rank_)
                chain = ([held] if held else []) + list(zip(*(part.column(i).to_pylist() for i in range(3)), texts, prints, strict=True))
                held = chain[-1]
                pairs = [(a, b) for a, b in zip(chain, chain[1:], strict=False) if a[0] == b[0] and not a[1]]
                if not pairs:
                    continue
                new = [edited(a[3], b[3]).encode() for a, b in pairs]
                new_prints = digests(*_flat(new), rank_)
                yield pa.record_batch(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in new]),
                        pa.array([encoded(a[4]) for a, _ in pairs]),
                        pa.array([encoded(p) for p in new_prints]),
                        pa.array([likeness(a[4], p) for (a, _), p in zip(pairs, new_prints, strict=True)], pa.float64()),
                        pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return dealt.select("bin", "guest", "doc_id", "text").mapInArrow(run, FIELDS)
