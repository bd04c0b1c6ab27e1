"""Problem 4: the same or almost the same record in an evaluation split and in the training split.

Method: prefix join on word overlap, complete by proof. Words (letters and digits in Japanese) of a text are numbered by
occurrence, so that texts become sets. If ``t`` is four fifths of the longer text, rounded up, a pair of the rule shares at
least ``t`` of them; so, in any one order of all terms, the first ``n - t + 1`` terms of one text and the first ``m - t + 1``
of the other share one. Rare terms come first. Inverted lists hold these prefixes only, split by length class, as lengths of
a pair differ by a quarter at most. Every list entry carries the parity of its text's terms in 256 cells: cells that differ
are at most the terms not shared, ``n + m - 2t``, which drops most pairs inside the join. No filter can drop a pair of the
rule; the exact test of the words' order alone decides.

Equal texts are folded into one representative first, so that copies never multiply in the lists; the links of the
representatives are expanded to the records at the end. The order of terms comes from counts over all texts in a count
sketch of fixed size; two fixed-size Bloom filters keep terms out of the lists that the other side does not have. Both only
lose sharpness, never a pair, when a corpus outgrows them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import p6_collapse
from quern.llm.kernels import common_in_order, cut, grouped_order, mix64, slabs, span_hashes, strings, units
from quern.plans.shared import attach_by_key, discard, materialize, materialize_counted

SKETCH_BITS, BLOOM_BITS = 20, 26
SEGMENTS = 64
#: Cells of a text's parity, and the 64-bit columns that hold them.
CELLS = 256
PARITY = [f"c{i}" for i in range(CELLS // 64)]
SHARE = (4, 5)  # at least four fifths of the longer text


def terms(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every unit, numbered by occurrence within its text: no text has a term twice."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(owner):
        return owner, np.zeros(0, dtype=np.uint64)
    order = grouped_order(owner, np.zeros(len(owner), dtype=np.uint64), values, 0)
    o, v = owner[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))))
    turn = np.empty(len(order), dtype=np.uint64)
    turn[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return owner, mix64(values ^ mix64(turn))


def least_common(longer: np.ndarray) -> np.ndarray:
    """Units that a pair must share in order, by the length of its longer text."""
    return (longer * SHARE[0] + SHARE[1] - 1) // SHARE[1]


@lru_cache(maxsize=1)
def length_classes() -> np.ndarray:
    """First length of each class. Lengths of a pair differ by a quarter at most, so the partners of a text are in two classes."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(edges[-1] * SHARE[1] ** 2 // SHARE[0] ** 2 + 1)
    return np.array(edges, dtype=np.int64)


def class_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(length_classes(), n, side="right") - 1


def placed(owner: np.ndarray, h: np.ndarray, n: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of a term, class it is listed in, hash of both: the text's class in training, those of its partners else."""
    low, high = (n * SHARE[0] + SHARE[1] - 1) // SHARE[1], n * SHARE[1] // SHARE[0]
    low, high = class_of(np.where(train, n, np.maximum(low, 1))), class_of(np.where(train, n, high))
    many = (high - low + 1)[owner]
    at = np.repeat(np.arange(len(h)), many)
    cls = low[owner[at]] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return at, cls, mix64(h[at] ^ mix64(cls))


def _pack(kind: int, array: np.ndarray) -> Iterator[tuple[int, bytes]]:
    size = len(array) // SEGMENTS
    for s in range(SEGMENTS):
        part = array[s * size : (s + 1) * size]
        if part.any():
            yield kind * SEGMENTS + s, zlib.compress(part.tobytes(), 1)


def fold(parts: DataFrame, dtype_of: Callable[[int], type], op_of: Callable[[int], np.ufunc]) -> dict[int, np.ndarray]:
    """Combine equal segments of fixed-size arrays on the executors and fetch the few combined ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = seg // SEGMENTS
                part = np.frombuffer(zlib.decompress(blob), dtype=dtype_of(kind))
                held[seg] = op_of(kind)(held[seg], part) if seg in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())], ["seg", "blob"])

    # In two steps, so that no task combines the parts of all tasks before; at most 3 * SEGMENTS rows come back.
    near = parts.repartition(F.col("seg"), F.pmod(F.xxhash64("blob"), F.lit(32))).mapInArrow(run, "seg int, blob binary")
    rows = near.repartition("seg").mapInArrow(run, "seg int, blob binary").collect()
    return {r["seg"]: np.frombuffer(zlib.decompress(bytes(r["blob"])), dtype=dtype_of(r["seg"] // SEGMENTS)) for r in rows}


KEYS = ("k1", "k2", "s1", "s2", "f1", "f2")
_READ = "id long, train boolean, " + ", ".join(f"{k} long" for k in KEYS) + ", seg int, blob binary"


def survey(rows: DataFrame) -> tuple[DataFrame, int, np.ndarray, np.ndarray, np.ndarray]:
    """One pass over all texts: their keys, counts of hashed terms, and the terms of the training and evaluation side as bits.

    Keys are ``id, train`` and two 64-bit keys each of the sequence of units (k), of the letters and digits (s), of the
    fields (f, or null); texts without letters and digits have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        bits = {side: np.zeros(1 << BLOOM_BITS, dtype=bool) for side in (True, False)}
        for batch in batches:
            texts = strings(batch.column(2))
            sides = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slabs(texts):
                part, train = texts[a:b], sides[a:b]
                c = cut(part)
                owner, h = terms(c.values, c.offsets)
                counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                for side in (True, False):
                    own = np.flatnonzero(train[owner] == side)
                    _, _, term = placed(owner[own], h[own], np.diff(c.offsets), train)
                    bits[side][(term & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)] = True
                keep = np.flatnonzero(np.diff(c.offsets))
                pairs = lambda v, o: [span_hashes(mix64(v ^ np.uint64(x)), o[:-1][keep], o[1:][keep]).view(np.int64) for x in (3, 5)]  # noqa: E731, B023
                fields = [p6_collapse.fields_of(part[i]) if ":" in part[i] or "：" in part[i] else None for i in keep]
                digest = [None if f is None else hashlib.blake2b("\x1d".join(f).encode("utf-8", "surrogatepass"), digest_size=16).digest() for f in fields]
                halves = [pa.array([None if d is None else int.from_bytes(d[x : x + 8], "big", signed=True) for d in digest], pa.int64()) for x in (0, 8)]
                own_rows = batch.select([0, 1]).slice(a, b - a).take(pa.array(keep))
                nothing = [pa.nulls(len(keep), t) for t in (pa.int32(), pa.binary())]
                keys = map(pa.array, (*pairs(c.values, c.offsets), *pairs(c.letters.astype(np.uint64), c.letter_offsets)))
                yield pa.RecordBatch.from_arrays([*own_rows.columns, *keys, *halves, *nothing], ["id", "train", *KEYS, "seg", "blob"])
        out = [*_pack(0, counts), *_pack(1, np.packbits(bits[True])), *_pack(2, np.packbits(bits[False]))]
        nothing = [pa.nulls(len(out), t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * len(KEYS))]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["id", "train", *KEYS, "seg", "blob"])

    read, size = materialize_counted(rows.mapInArrow(run, _READ), "p4-keys", F.count_if(F.col("seg").isNull()).alias("texts"))
    found = fold(read.filter("seg is not null").select("seg", "blob"), lambda k: np.uint8 if k else np.int64, lambda k: np.bitwise_or if k else np.add)

    def whole(kind: int, size: int, dtype: type) -> np.ndarray:
        part = size // SEGMENTS
        return np.concatenate([found.get(kind * SEGMENTS + x, np.zeros(part, dtype)) for x in range(SEGMENTS)])

    bits = (whole(kind, 1 << BLOOM_BITS >> 3, np.uint8) for kind in (1, 2))
    return read.filter("seg is null").select("id", "train", *KEYS), size["texts"] or 0, whole(0, 1 << SKETCH_BITS, np.int64), *bits


def ranks(owner: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of every term among those of its text, rare ones first: by count in the sketch, then by hash, alike in all texts.

    Counts are taken in eighths of a doubling, which any 64-bit count needs less than 512 of.
    """
    steps = (np.log2(counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.float64) + 1) * 8).astype(np.uint64)
    order = grouped_order(owner, steps, h, 9)
    rank = np.empty(len(h), dtype=np.int64)
    many = np.bincount(owner)
    rank[order] = np.arange(len(h)) - np.repeat(np.cumsum(many) - many, many)  # owners are ascending
    return rank


def parity(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of a text's terms in each cell modulo two, as 64-bit columns."""
    cell = (h & np.uint64(CELLS - 1)).astype(np.int64)
    odd = (np.bincount(owner * CELLS + cell, minlength=n * CELLS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, CELLS // 64)


def lists(texts_of_side: DataFrame, train: bool, counts: np.ndarray, other_bits: np.ndarray) -> DataFrame:
    """Inverted lists of one side: ``term, id, about`` and the text's parity, of every term of a prefix that the other side has, too.

    ``about`` packs the text's length and the term's rank, 31 bits each (no string holds more).
    """
    held = texts_of_side.sparkSession.sparkContext.broadcast((counts, other_bits))  # 8 MB each, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, packed = held.value
        for batch in batches:
            texts = strings(batch.column(2))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slabs(texts):
                values, offsets, _ = units(texts[a:b])
                owner, h = terms(values, offsets)
                n = np.diff(offsets)
                rank, odd = ranks(owner, h, counted), parity(owner, h, b - a)
                inside = np.flatnonzero(rank <= (n - least_common(n))[owner])
                at, cls, term = placed(owner[inside], h[inside], n, np.full(b - a, train))
                at = inside[at]
                longer = np.maximum(n[owner[at]], length_classes()[cls])  # of a pair met in this class, at least
                spot = (term & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)
                there = (packed[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
                keep = np.flatnonzero(there & (rank[at] <= n[owner[at]] - least_common(longer)))
                o = owner[at[keep]]
                columns = [pa.array(term[keep].view(np.int64)), pa.array(ids[a:b][o], pa.int64()), pa.array(n[o] << 31 | rank[at[keep]], pa.int64())]
                columns += [pa.array(odd[o, i]) for i in range(len(PARITY))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "id", "about", *PARITY])

    return texts_of_side.mapInArrow(run, "term long, id long, about long" + "".join(f", {c} long" for c in PARITY))


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose words agree in order; those that share too few words in any order need no test of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = strings(batch.column(2)), strings(batch.column(3))
            at = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}  # a text of several pairs is cut up once
            values, offsets, _ = units(list(at))
            _, h = terms(values, offsets)
            good = []
            for k, sides in enumerate(zip(left, right)):
                x, y = (slice(offsets[i], offsets[i + 1]) for i in (at[t] for t in sides))
                least = int(least_common(max(x.stop - x.start, y.stop - y.start)))
                if len(np.intersect1d(h[x], h[y], assume_unique=True)) >= least and common_in_order(values[x], values[y]) >= least:
                    good.append(k)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    return pairs.mapInArrow(run, "a long, b long")


def equal_classes(keys: DataFrame) -> DataFrame:
    """``s1, s2, t, e, n, class, r``: the class of every letter sequence, which sides have it, and its number of records.

    A sequence that is a serialized record anywhere is in the class of those fields (``r``), any other in one of its own.
    """
    by_letters = keys.groupBy("s1", "s2").agg(F.min(F.when(F.col("f1").isNotNull(), F.struct("f1", "f2"))).alias("f"), F.max("train").alias("t"), F.max(~F.col("train")).alias("e"), F.count("*").alias("n"))
    return by_letters.select("s1", "s2", "t", "e", "n", F.coalesce(F.col("f"), F.struct(F.col("s1").alias("f1"), F.col("s2").alias("f2"))).alias("class"), F.col("f").isNotNull().alias("r"))


def equal_pairs(keys: DataFrame, total: int) -> DataFrame:
    """``eval_id, train_id`` of records equal in letters and digits or, as serialized records, in their fields."""
    class_of = equal_classes(keys)
    both = class_of.groupBy("class", "r").agg(F.max("t").alias("t"), F.max("e").alias("e")).filter("t and e").select("class", "r")
    kept = class_of.join(both, ["class", "r"]).select(F.struct("s1", "s2").alias("s"), "class", "r", "n")
    members = attach_by_key(keys.select("id", "train", F.struct("s1", "s2").alias("s")), kept, "s", "id", "n", total)
    members = materialize(members.select("id", "train", "class", "r"), "p4-equal")
    ev = members.filter(~F.col("train")).select(F.col("id").alias("eval_id"), "class", "r")
    tr = members.filter("train").select(F.col("id").alias("train_id"), "class", "r")
    return ev.join(tr, ["class", "r"]).select("train_id", "eval_id")


def linked(df: DataFrame, id_col: str, split_col: str, text_col: str, train: str, held: tuple[str, ...]) -> tuple[DataFrame, int, DataFrame, DataFrame]:
    """Keys of all records, their number, copies (``id, rep``: of one side and word sequence, without the representative
    itself), and links ``a, b`` of almost equal representatives of the evaluation and the training side."""
    side = F.col(split_col)
    rows = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & side.isin(train, *held))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), (side == train).alias("train"), F.col(text_col).alias("text"))
    keys, total, counts, train_bits, eval_bits = survey(rows)
    # Copies within a side are left out of the lists; they get their representative's links back at the end.
    cell = keys.select("id", F.struct("k1", "k2", "train").alias("cell"))
    facts = cell.groupBy("cell").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    copies = materialize(attach_by_key(cell, facts, "cell", "id", "n", total).filter("id <> rep").select("id", "rep"), "p4-copies")
    reps = rows.join(copies.select("id"), "id", "left_anti").select("id", "train", "text")
    # Long lists are split while they are joined (AQE's skew join), which costs no copies of the other side.
    e = lists(reps.filter(~F.col("train")), False, counts, train_bits)
    t = lists(reps.filter("train"), True, counts, eval_bits)
    met = e.withColumnsRenamed({c: c + "e" for c in e.columns if c != "term"}).join(t, "term")
    (n1, r1), (n2, r2) = ((F.shiftright(c, 31), F.col(c).bitwiseAND((1 << 31) - 1)) for c in ("aboute", "about"))
    longer = F.greatest(n1, n2)
    least = F.floor((longer * SHARE[0] + (SHARE[1] - 1)) / SHARE[1])
    apart = reduce(add, (F.bit_count(F.col(c + "e").bitwiseXOR(F.col(c))) for c in PARITY))
    near = (F.least(n1, n2) >= least) & (apart <= n1 + n2 - 2 * least) & (r1 <= n1 - least) & (r2 <= n2 - least)
    pairs = materialize(met.filter(near).select(F.col("ide").alias("a"), F.col("id").alias("b")).distinct(), "p4-pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "p4-wanted")
    texts = materialize(rows.select("id", "text").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "p4-texts")
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    links = materialize(verified(joined.select("a", "b", "ta", "tb")), "p4-links")
    for done in (pairs, wanted, texts):
        discard(done)
    return keys, total, copies, links


def overlaps(df: DataFrame, id_col: str = "sample_id", split_col: str = "split_name", text_col: str = "text", train: str = "train", held: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """All pairs ``train_id, eval_id`` of records of the two sides that are equal or almost equal.

    Defined cases: records without a split, an id or letters and digits are in no pair; repeated rows count once; very
    long texts are compared whole; an empty table gives no pairs; other columns are not carried, so names cannot clash.
    Two texts may tie with many partners: all pairs come out.
    """
    keys, total, copies, links = linked(df, id_col, split_col, text_col, train, held)
    others = copies.select(F.col("rep").alias("a"), F.col("id").alias("eval_id"))
    links = links.select(F.col("a").alias("eval_id"), "b").unionByName(links.join(others, "a").select("eval_id", "b"))
    others = copies.select(F.col("rep").alias("b"), F.col("id").alias("train_id"))
    nearly = links.select(F.col("b").alias("train_id"), "eval_id").unionByName(links.join(others, "b").select("train_id", "eval_id"))
    return nearly.unionByName(equal_pairs(keys, total)).filter("train_id <> eval_id").distinct()


def found(df: DataFrame) -> DataFrame:
    """``sample_a, sample_b``, the smaller id first."""
    return overlaps(df).select(F.least("train_id", "eval_id").alias("sample_a"), F.greatest("train_id", "eval_id").alias("sample_b")).distinct()


def report(df: DataFrame, id_col: str = "sample_id", split_col: str = "split_name", text_col: str = "text", source_col: str = "source_name", train: str = "train", held: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """Counts by evaluation split and source: pairs, and evaluation records concerned.

    No pair is written out: partners are counted by representatives and classes of equal records and their sizes. A record
    of the evaluation side has as partners the training records of its class and those of the representatives linked to its
    own; linked ones of its own class are counted once. Defined cases are those of :func:`overlaps`.
    """
    keys, _, copies, links = linked(df, id_col, split_col, text_col, train, held)
    named = keys.select("id", "train", "s1", "s2").distinct().join(copies, "id", "left")
    named = materialize(named.select("id", "train", "s1", "s2", F.coalesce("rep", "id").alias("rep")), "p4-named")
    sizes = named.groupBy("rep", "train", "s1", "s2").agg(F.count("*").alias("n"))
    reps = materialize(sizes.join(equal_classes(keys).select("s1", "s2", "class", "r"), ["s1", "s2"]).select("rep", "train", "n", F.struct("class", "r").alias("class")), "p4-reps")
    ev = reps.filter(~F.col("train")).select(F.col("rep").alias("a"), F.col("class").alias("own"))
    tr = reps.filter("train").select(F.col("rep").alias("b"), "class", "n")
    near = links.join(tr, "b").join(ev, "a").groupBy("a").agg(F.sum("n").alias("near"), F.sum(F.when(F.col("class") == F.col("own"), F.col("n"))).alias("again"))
    equal = tr.groupBy(F.col("class").alias("own")).agg(F.sum("n").alias("equal"))
    of = lambda c: F.coalesce(c, F.lit(0))
    partners = ev.join(equal, "own", "left").join(near, "a", "left").select(F.col("a").alias("rep"), (of("equal") + of("near") - of("again")).alias("partners")).filter("partners > 0")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(split_col).alias("split_name"), F.col(source_col).alias("source_name")).filter(F.col("split_name").isin(*held)).distinct()
    concerned = named.filter(~F.col("train")).select("id", "rep").join(rows, "id").groupBy("rep", "split_name", "source_name").agg(F.count("*").alias("records"))
    counted = concerned.join(partners, "rep").groupBy("split_name", "source_name")
    return counted.agg(F.sum(F.col("records") * F.col("partners")).cast("long").alias("pairs"), F.sum("records").cast("long").alias("records"))
