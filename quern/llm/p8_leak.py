"""Problem 8: passages of evaluation items inside a training corpus.

Method: the items' normalised n-grams (ten words, or 25 letters and digits of a Japanese item) form a hash set that every
worker holds as sorted arrays; document windows are hashed by prefix sums and looked up, hits that run on are joined into
spans, and every span is verified on the exact letters. The set is broadcast in blocks bounded by code points, so its size
never grows with the evaluation material: a larger stated set makes more scans, it drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.kernels import alnum_table, mixed_table, slabs, span_hashes, strings, to_codepoints, windows, word_spans

#: Code points of evaluation material per broadcast block. One code point costs a worker 24 bytes at most, so a block stays below 200 MB.
BLOCK_CHARS = 8_000_000
WORDS, LETTERS = 10, 25


class Side:
    """Casefolded texts as letters and digits, and the units that windows are made of: words, or single letters."""

    def __init__(self, texts: list[str], by_letter: bool):
        cps, self.offsets = to_codepoints([t.casefold() for t in texts])
        ok = alnum_table()[cps]
        place = np.flatnonzero(ok)
        self.letters = cps[place]
        mixed = mixed_table()[cps]
        if by_letter:
            self.size, self.starts, self.ends = LETTERS, place, place + 1
            values, of_text = mixed[place], np.searchsorted(place, self.offsets)
            self.at = np.arange(len(place) + 1)
        else:
            self.size = WORDS
            self.starts, self.ends, _ = word_spans(cps, self.offsets, ok)
            values, of_text = span_hashes(mixed, self.starts, self.ends), np.searchsorted(self.starts, self.offsets)
            self.at = np.concatenate(([0], np.cumsum(self.ends - self.starts)))  # where each unit's letters begin
        self.hashes, self.owner, self.first = windows(values, of_text, self.size)

    def same(self, mine: int, other: NgramSet, its: int, n: int) -> bool:
        """Whether ``n`` units agree letter by letter."""
        a, b = self.at[mine : mine + n + 1], other.at[its : its + n + 1]
        return np.array_equal(np.diff(a), np.diff(b)) and np.array_equal(self.letters[a[0] : a[-1]], other.letters[b[0] : b[-1]])


class NgramSet:
    """Hash set of the items' windows, as sorted arrays with the place of each window; equal windows keep all their items."""

    def __init__(self, parts: list[tuple[object, str]], by_letter: bool):
        side = Side([t for _, t in parts], by_letter)
        order = np.argsort(side.hashes, kind="stable")
        self.ids = [i for i, _ in parts]
        self.by_letter, self.size = by_letter, side.size
        self.hashes = side.hashes[order]
        self.part, self.first = side.owner[order].astype(np.int32), side.first[order].astype(np.int32)
        self.letters, self.at = side.letters, side.at.astype(np.int32)

    @cached_property
    def bits(self) -> np.ndarray:
        """Which low bits of a hash occur: lets nearly all windows of ordinary texts go after one look."""
        size = 1 << min(26, max(16, (16 * len(self.hashes)).bit_length()))
        bits = np.zeros(size, dtype=bool)
        bits[(self.hashes & np.uint64(size - 1)).astype(np.intp)] = True
        return bits

    def spans(self, side: Side) -> Iterator[tuple[int, int, int, int]]:
        """Verified ``text, part, first unit, last unit`` of runs of units that a text shares with a part of an item."""
        maybe = np.flatnonzero(self.bits[(side.hashes & np.uint64(len(self.bits) - 1)).astype(np.intp)])
        low = np.searchsorted(self.hashes, side.hashes[maybe])
        many = np.searchsorted(self.hashes, side.hashes[maybe], side="right") - low
        hit = np.repeat(maybe, many)
        if not len(hit):
            return
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        text, mine, part, its = side.owner[hit], side.first[hit], self.part[entry].astype(np.int64), self.first[entry].astype(np.int64)
        order = np.lexsort((mine, mine - its, part, text))
        text, mine, part, its = text[order], mine[order], part[order], its[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1]) | (mine[1:] - its[1:] != mine[:-1] - its[:-1]) | (mine[1:] != mine[:-1] + 1)
        begin = np.flatnonzero(new)
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(order)).tolist()):
            if side.same(mine[a], self, its[a], b - a + self.size - 1):
                yield int(text[a]), int(part[a]), int(mine[a]), int(mine[a]) + b - a + self.size - 2
                continue
            for k in range(a, b):  # two different windows of one hash: each is looked at alone
                if side.same(mine[k], self, its[k], self.size):
                    yield int(text[k]), int(part[k]), int(mine[k]), int(mine[k]) + self.size - 1


def _original(text: str, at: int, up: bool) -> int:
    """Place in a text of a place in its casefolded form, which may be longer; inside a letter, its start or (``up``) its end."""
    if len(text.casefold()) == len(text):
        return at
    done = 0
    for i, c in enumerate(text):
        if done >= at:
            return i
        done += len(c.casefold())
        if done > at:
            return i + up
    return len(text)


def scan(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, lang: str, parts: list[str]) -> DataFrame:
    """``doc_id, text_key, item_id, start, end``: every verified span of a document, in code points of its text.

    ``text_key`` hashes the text, so that spans of repeated ids with different texts stay apart.
    """
    spark = docs.sparkSession
    names = [f"_part{k}" for k in range(len(parts))]
    stated = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.lower(F.coalesce(F.col(lang), F.lit(""))).alias("lang"), *[F.col(p).alias(n) for p, n in zip(parts, names)])
    kinds = [docs.schema[doc_id].dataType, T.LongType(), items.schema[item_id].dataType, T.IntegerType(), T.IntegerType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(("doc_id", "text_key", "item_id", "start", "end"), kinds)])
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(text_col).isNotNull()).select(doc_id, text_col, F.xxhash64(text_col))
    item_type = pa.int64() if isinstance(kinds[2], T.LongType) else None

    def with_block(block: list[tuple[object, bool, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast([NgramSet([(i, t) for i, ja, t in block if ja == by_letter], by_letter) for by_letter in (False, True)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = strings(batch.column(1))
                for a, b in slabs(texts):
                    found = []
                    for ngrams in held.value:
                        if not len(ngrams.hashes):
                            continue
                        side = Side(texts[a:b], ngrams.by_letter)
                        for t, part, first, last in ngrams.spans(side):
                            start, end = int(side.starts[first] - side.offsets[t]), int(side.ends[last] - side.offsets[t])
                            found.append((a + t, ngrams.ids[part], _original(texts[a + t], start, False), _original(texts[a + t], end, True)))
                    if found:
                        at, ids, starts, ends = zip(*found)
                        of_row = batch.select([0, 2]).take(pa.array(at, pa.int64()))
                        yield pa.RecordBatch.from_arrays([*of_row.columns, pa.array(ids, item_type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema.fieldNames())

        return rows.mapInArrow(run, schema)

    scans: list[DataFrame] = []
    block: list[tuple[object, bool, str]] = []
    size = 0
    for r in stated.toLocalIterator():  # the stated set of items, a block at a time
        for n in names:
            block.append((r["item_id"], r["lang"][:2] == "ja", r[n] or ""))
            size += len(r[n] or "")
        if size >= BLOCK_CHARS:
            scans.append(with_block(block))
            block, size = [], 0
    if block or not scans:
        scans.append(with_block(block))
    return reduce(DataFrame.unionByName, scans)


def leaks(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, lang: str, parts: list[str]) -> DataFrame:
    """``doc_id, item_id``: the document holds ten consecutive words (Japanese item: 25 letters) of one of the item's parts.

    Defined cases: null and empty texts or parts hold nothing; a part shorter than the window cannot be contained; a null
    id on either side is left out; repeated documents are scanned each and the pair is reported once; empty tables give an
    empty result; other columns are not carried. Case, spacing and punctuation do not count. Long texts are scanned whole.
    """
    return scan(docs, doc_id, text_col, items, item_id, lang, parts).select("doc_id", "item_id").distinct()


def without_spans(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, lang: str, parts: list[str]) -> DataFrame:
    """``doc_id, clean_text, removed, items``: every document without its leaked spans, each of which leaves one space.

    ``removed`` counts the code points taken out, ``items`` lists the items concerned, in order. Documents without a leak
    stay as they are, null texts stay null, documents with a null id are kept unscanned, repeated rows are cleaned each.
    """
    found = scan(docs, doc_id, text_col, items, item_id, lang, parts)
    by_text = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    joined = keyed.join(by_text, ["doc_id", "text_key"], "left")
    kind = docs.schema[doc_id].dataType
    item_kind = T.ArrayType(items.schema[item_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, at, gone = [], 0, 0
                for s in sorted(spans or (), key=lambda s: (s["start"], s["end"])):
                    if s["end"] <= at:
                        continue
                    if not kept or s["start"] > at:
                        kept.append(text[at : s["start"]])
                    gone += s["end"] - max(at, s["start"])
                    at = s["end"]
                texts.append(text if not kept else " ".join([*kept, text[at:]]))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), batch.column(3)], ["doc_id", "clean_text", "removed", "items"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("clean_text", T.StringType()), T.StructField("removed", T.LongType()), T.StructField("items", item_kind)])
    return joined.select("doc_id", "text", "spans", F.coalesce("items", F.array().cast(item_kind)).alias("items")).mapInArrow(run, schema)
