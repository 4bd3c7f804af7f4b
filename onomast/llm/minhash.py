"""Near-duplicate detection: MinHash, banding, verification and star components.

A text is lower-cased (A-Z only) and split into words at ASCII white space; its set is
its distinct shingles of ``WIDTH`` words (a shorter text: all its words as one). Two
texts are linked if the Jaccard similarity of their sets is at least ``percent`` / 100.

1. One Arrow pass makes, for each row, a digest of its set, ``HASHES`` universal hash
   minima (multiply and add, modulo 2^32), the hashes of the bands and one byte of each
   minimum as its signature. Only these are written, no sets.
2. Equal sets form a class; the smallest id stands for it.
3. In each bucket (band value) members are compared with the smallest one, the star:
   sizes first, then signatures, then the full sets, rebuilt from the whole texts.
   The links found are joined into components.
4. Other pairs of a bucket can add something only if they lie in different components.
   As the Jaccard distance is a metric, a member linked to the star cannot be linked to
   one whose distance from the star is larger by more than 1 - percent / 100. What is
   left is compared by signature in blocks and, if it passes, on the full sets.
5. Components: alternating large-star and small-star, until nothing changes.

Buckets have no cap: those of many members are split into blocks of pairs. With 48
bands of 5 minima a pair at the threshold itself is missed with probability 3e-6; the
signature has as many minima again, and is passed down to 0.08 below the threshold, four
standard deviations.

Copies and stars of many are no hot spots: a band of more than ``CHUNK`` texts, and a star of
more than ``MEMBERS``, are parted by a salt. Only what reads as a broadcast is one whose
counted size allows it.

Null or empty texts (no words) have no set and are linked with nothing; each is its own
component. Rows with a null id are dropped. Rows with one id are one document: it has
the sets of all of them, and a row is returned for each. Ties do not occur: ids decide.
Very long texts are read whole. Only id and text are read: other columns are not returned
and may be called anything. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm._common import CUT_BYTES, cuts, forget, lean, materialise, maybe_broadcast, mix64, utf8

WIDTH, PERCENT, BANDS, ROWS = 5, 75, 48, 5
HASHES = 2 * BANDS * ROWS
SLACK = 0.08
CHUNK, MEMBERS = 2048, 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_MULTIPLY = (_RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd radix, and of its inverse, modulo 2^64."""
    inverse = pow(_RADIX, -1, 1 << 64)
    out = []
    for base in (_RADIX, inverse):
        p = np.full(1 << log, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the first word of each text."""
    if not data.size:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _powers(max(18, int(data.size + 1).bit_length()))
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: data.size], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[63]), np.searchsorted(start, offsets)


def sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    word, first = words(data, offsets)
    if len(word) >= width:
        whole = np.zeros(len(word) - width + 1, np.uint64)
        for j in range(width):
            whole += word[j : j + len(whole)] * _MIX[j]
        whole = mix64(whole)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(whole[lo : hi - width + 1]))
        elif hi > lo:
            out.append(mix64((word[lo:hi] * _MIX[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + _MIX[32 + hi - lo]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(set_: np.ndarray) -> np.ndarray:
    x = (set_ >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        np.minimum(least, (_MULTIPLY[:, None] * x[None, lo : lo + 512] + _ADD[:, None]).min(1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return mix64((rows * _MIX[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MIX[62]).view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """A byte of each minimum, from all its bits: minima of many numbers begin alike."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        known: dict[bytes, tuple] = {}
        for lo, hi in cuts(offsets, CUT_BYTES):
            n, a, b, band, sig = [], [], [], [], []
            for s in sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                n.append(len(s))
                digest = hashlib.blake2b(s, digest_size=16).digest()
                if digest not in known:
                    if len(s):
                        least = minima(s)
                        known[digest] = (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), bands(least), signature(least))
                    else:
                        known[digest] = (None, None, None, None)
                for column, value in zip((a, b, band, sig), known[digest], strict=True):
                    column.append(value)
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n", "s1", "s2", "bands", "sig"])


def similar(agree: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from the share of equal signature bytes."""
    return (agree / HASHES - 1 / 256) / (255 / 256)


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = utf8(column)
    return data.reshape(-1, HASHES)


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        agree = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(similar(agree))], ["a", "b", "est"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, salt, whether a member): the star's set is held while its members pass."""
    stars: tuple | None = None
    held: list[np.ndarray] = []
    for batch in batches:
        data, offsets = utf8(batch.column(4))
        for lo, hi in cuts(offsets, CUT_BYTES):
            part = batch.slice(lo, hi - lo)
            a, salt, member, b = (part.column(i).to_pylist() for i in range(4))
            out = []
            for i, s in enumerate(sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])):
                if not member[i]:
                    if (a[i], salt[i]) != stars:
                        stars, held = (a[i], salt[i]), []
                    held.append(s)
                elif (a[i], salt[i]) == stars:
                    for star in held:  # one, unless its id has several rows
                        both = len(np.intersect1d(star, s, assume_unique=True))
                        out.append((a[i], b[i], both, len(star) + len(s) - both))
            yield pa.record_batch([pa.array([x[j] for x in out], pa.int64()) for j in range(4)], ["a", "b", "both", "either"])


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked, lo`` for pairs of ids: exact similarity of the whole texts (``doc_id, text``).

    Each member's text goes to its star once, a star's once for ``MEMBERS`` members: stars of
    many are parted by a salt, so none is one task's.
    """
    pairs = pairs.select("a", "b").distinct()
    pairs = materialise(pairs)
    stars = materialise(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts")))
    ids = materialise(stars.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    wanted = docs.join(maybe_broadcast(ids, 16), "doc_id", "left_semi")
    many = stars.filter("salts > 1")
    dealt = pairs.join(maybe_broadcast(many, 16), "a", "left").select("a", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).otherwise(0).alias("salt"), F.col("b").alias("doc_id"))
    members = wanted.join(dealt, "doc_id").select("a", "salt", F.lit(True).alias("member"), F.col("doc_id").alias("b"), "text")
    heads = wanted.join(stars.withColumnRenamed("a", "doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.lit(0).cast("long").alias("b"), "text")
    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    counted = rows.mapInArrow(lean(_verify), "a long, b long, both long, either long")
    return counted.select("a", "b", (F.col("both") * 100 >= F.col("either") * percent).alias("linked"), (1 - F.col("both") / F.greatest("either", F.lit(1))).alias("lo"))


def _pairs(low: float):
    """Rows of (key, p, q) come sorted by these; each such block's pairs are compared."""

    def compare(rows: pd.DataFrame) -> list[tuple[int, int]]:
        if len(rows) < 2 or rows["comp"].nunique() < 2:
            return []
        p, q = rows["p"].iat[0], rows["q"].iat[0]
        left, right = (rows, rows) if p == q else (rows[rows["blk"] == p], rows[rows["blk"] == q])
        sig = [np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(-1, HASHES) for x in (left, right)]
        band = [np.stack(x["bands"].to_list()) for x in (left, right)]
        here = int(np.flatnonzero(band[0][0] == (int(rows["key"].iat[0]) & 0x7FFFFFFF))[0]) if len(left) else 0
        ids, comps, free, sizes = ([x[c].to_numpy() for x in (left, right)] for c in ("rep", "comp", "free", "n"))
        found = []
        for i in range(0, len(left), 16):
            part = slice(i, i + 16)
            may = (comps[0][part, None] != comps[1][None, :]) & (free[0][part, None] | free[1][None, :])
            may &= np.minimum(sizes[0][part, None], sizes[1][None, :]) * 100 >= np.maximum(sizes[0][part, None], sizes[1][None, :]) * int(round((low + SLACK) * 100))
            if p == q:
                may &= ids[0][part, None] < ids[1][None, :]
            x, y = np.nonzero(may)
            for at in range(0, len(x), 1 << 13):
                u, v = x[at : at + (1 << 13)] + i, y[at : at + (1 << 13)]
                ok = similar((sig[0][u] == sig[1][v]).sum(1)) >= low
                # a pair of several buckets belongs to that of its first common band
                ok[ok] = ~(band[0][u[ok], :here] == band[1][v[ok], :here]).any(1)
                found += zip(np.minimum(ids[0][u[ok]], ids[1][v[ok]]).tolist(), np.maximum(ids[0][u[ok]], ids[1][v[ok]]).tolist(), strict=True)
        return found

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in _with_end(frames):
            last = frame is None
            rows = held if last else frame if held is None else pd.concat([held, frame], ignore_index=True)
            if rows is None or not len(rows):
                continue
            change = np.flatnonzero((rows[["key", "p", "q"]].to_numpy()[1:] != rows[["key", "p", "q"]].to_numpy()[:-1]).any(1)) + 1
            bounds = [0, *change.tolist(), len(rows)]
            whole = len(bounds) - 1 if last else len(bounds) - 2
            found: list[tuple[int, int]] = []
            for lo, hi in zip(bounds[:whole], bounds[1 : whole + 1], strict=True):
                found += compare(rows.iloc[lo:hi])
            held = None if last else rows.iloc[bounds[-2] :]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _with_end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id) of every id in ``links`` (``a, b``), by large-star and small-star."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Edges (u, v): large: tie u's larger neighbours to its least one; small: u and its smaller ones."""
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        tied = both.join(least, "u")
        if large:
            new = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return new.filter("u != v").distinct()

    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        old, edges = edges, materialise(star(star(edges, True), False))
        forget(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def cluster(docs: DataFrame, *, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id`` for each row of ``docs``."""
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("doc_id is not null")
    signed = materialise(docs.mapInArrow(lean(_sign), "doc_id long, n long, s1 long, s2 long, bands array<long>, sig binary"))
    some = signed.filter("n > 0")
    classes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = some.join(classes.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    reps = materialise(reps.select(F.col("doc_id").alias("rep"), "n", "bands", "sig"))
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    stars = materialise(keyed.groupBy("key").agg(F.min("rep").alias("star"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "star", F.ceil(F.col("m") / CHUNK).cast("int").alias("parts")))
    hot = stars.filter("parts > 1").select("key", F.col("parts").alias("salts"))
    salted = keyed.join(maybe_broadcast(hot, 16), "key", "left").withColumn("salt", F.pmod(F.xxhash64("rep"), F.coalesce("salts", F.lit(1))).cast("int"))
    spread = stars.select("key", "star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    members = materialise(salted.join(spread, ["key", "salt"]).filter("rep != star").select("key", "rep", "star"))
    low = percent / 100 - SLACK
    pairs = members.select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct()

    def signs(df: DataFrame) -> DataFrame:
        x = df.join(reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        return x.join(reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")

    sized = signs(pairs)
    ratio = F.least("na", "nb") / F.greatest("na", "nb")
    close = sized.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    guessed = materialise(close.select("a", "b", "sa", "sb").mapInArrow(lean(_estimate), "a long, b long, est double"))
    exact = materialise(verify(guessed.filter(F.col("est") >= low).select("a", "b"), docs, percent))
    first = exact.filter("linked").select("a", "b").distinct()
    found = materialise(components(first))
    # pairs beside the star's: what the star's distances leave open, in different components
    gap = 1 - percent / 100
    known = exact.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.min("lo").alias("lo"))
    about = guessed.filter(F.col("est") < low).select("a", "b", F.lit(False).alias("linked"), F.greatest(F.lit(gap), 1 - F.col("est") - SLACK).alias("lo"))
    far = known.unionByName(about).withColumnsRenamed({"a": "star", "b": "rep"})
    open_ = members.join(far, ["star", "rep"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("lo", F.coalesce("lo", F.lit(gap)))
    open_ = open_.join(found.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("comp", F.coalesce("c", "rep")).drop("c")
    open_ = materialise(open_)
    by = open_.groupBy("key").agg(F.min(F.when(~F.col("linked"), F.col("lo"))).alias("least"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("least is not null and c0 != c1")
    by = materialise(by.select("key", "least"))
    kept = open_.join(maybe_broadcast(by, 16), "key").filter(~F.col("linked") | (F.col("lo") >= F.col("least") - gap - 1e-9))
    kept = materialise(kept.select("key", "rep", "comp", (~F.col("linked")).alias("free")))
    sizes = kept.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("m > 1 and c0 != c1").select("key", F.ceil(F.col("m") / CHUNK).cast("int").alias("blocks"))
    sizes = materialise(sizes)
    dealt = kept.join(maybe_broadcast(sizes, 16), "key").join(reps.select("rep", "n", "sig", F.transform("bands", lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands")), "rep").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"), "blk", "rep", "comp", "free", "n", "sig", "bands")
    more = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInPandas(lean(_pairs(low)), "a long, b long").distinct()
    more = materialise(more.join(exact.select("a", "b"), ["a", "b"], "left_anti"))
    forget(stars, members, guessed, open_, by, kept, sizes)
    if not more.isEmpty():
        second = materialise(verify(more, docs, percent).filter("linked").select("a", "b").distinct())
        if not second.isEmpty():
            found = materialise(components(first.unionByName(second)))
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    rows = some.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(named, ["s1", "s2"]).drop("s1", "s2")
    alone = signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id")
