"""Problem 7: encoding a whole corpus with a public byte-level BPE tokenizer.

Method: code points are mapped to symbol classes; each symbol is a function on the states of a small automaton, and
since composing functions is associative, the state before every code point comes from a blocked scan over the
automaton's transition monoid instead of from a regular expression. Slices between the boundaries found are
dictionary-encoded, and only slices not seen before go through pair merging (the tokenizer library's merge routine on
one slice); their ids are cached per worker. Byte offsets of every token are kept so that any span can be decoded.

The automaton states the published pre-tokenisation of the 50k byte-level vocabulary: contractions after an
apostrophe, an optional single space before a run of letters, digits or other marks, and runs of white space of which
the last character belongs to what follows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.kernels import SLAB

#: Where the public tokenizers lie; an argument of every operator that needs one.
TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Slices of more bytes than this are merged but not cached, and the cache is emptied when it holds this many.
CACHED_BYTES, CACHED = 48, 400_000

# Symbols. SPACE_X / WHITE_X: followed by something that is not white space; WHITE: followed by white space or the end.
LETTER, NUMBER, OTHER, APO1, APO2, SPACE_X, WHITE_X, WHITE = range(8)
# States: what the code point before belongs to.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, TAIL1, TAIL2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a slice begins at this symbol."""
    if symbol == LETTER:
        if state in (TAIL1, TAIL2):
            return (START, False) if state == TAIL1 else (TAIL1, False)
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol in (OTHER, APO1, APO2):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, APO1: TAIL1, APO2: TAIL2}[symbol], True
    if symbol == SPACE_X:
        return AFTER_SPACE, True
    if symbol == WHITE_X:
        return START, True
    return IN_WHITE, state != IN_WHITE


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition monoid: composition table, element of each symbol, element of each symbol at a text's start, action.

    Element ids are uint8; ``action[e, s]`` is the state that element e leads to from s; id 0 is the identity.
    """
    gens = [tuple(_step(s, y)[0] for s in range(8)) for y in range(8)]
    firsts = [tuple(g[START] for _ in range(8)) for g in gens]
    ids = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in (*gens, *firsts):
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    fs = list(ids)
    assert len(fs) < 256
    compose = np.array([[ids[tuple(b[x] for x in a)] for b in fs] for a in fs], dtype=np.uint8)
    return compose, np.array([ids[g] for g in gens], np.uint8), np.array([ids[g] for g in firsts], np.uint8), np.array(fs, np.uint8)


@lru_cache(maxsize=1)
def _begins() -> np.ndarray:
    return np.array([_step(s, y)[1] for s in range(8) for y in range(8)])


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Symbol of each code point without its neighbours: letter, number, other, space (SPACE_X) or other white space."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE_X)):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            for first, last, shift in ((0, 0xD800, 0), (0xD800, len(every), 0x800)):
                lo, hi = max(a, first), min(b, last)
                if lo < hi:
                    table[lo + shift : hi + shift] = symbol
    table[0x20] = SPACE_X
    return table


def scan_states(elements: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each element, from START, by a two-level associative scan.

    Blocks of ``width`` elements are composed to one element each, the blocks are scanned the same way, and each block is
    replayed from its own starting state; all blocks advance together.
    """
    compose, _, _, action = automaton()
    n = len(elements)
    if n <= width:
        out = np.zeros(n, dtype=np.uint8)
        state = START
        for i in range(n):
            out[i] = state
            state = action[elements[i], state]
        return out
    flat, act, m = compose.ravel(), action.ravel(), len(compose)
    blocks = -(-n // width)
    lanes = np.zeros((blocks, width), dtype=np.uint8)
    lanes.ravel()[:n] = elements
    lanes = np.ascontiguousarray(lanes.T)
    whole = lanes[0]
    for j in range(1, width):
        whole = flat[whole.astype(np.intp) * m + lanes[j]]
    state = scan_states(whole, width)
    out = np.empty((width, blocks), dtype=np.uint8)
    for j in range(width):
        out[j] = state
        state = act[lanes[j].astype(np.intp) * 8 + state]
    return np.ascontiguousarray(out.T).ravel()[:n]


def boundaries(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Indices of code points at which a pre-token begins. ``offsets``: of the texts within ``cps``."""
    n = len(cps)
    if not n:
        return np.zeros(0, dtype=np.int64)
    symbol = class_table()[cps]
    starts = offsets[:-1][np.diff(offsets) > 0]
    last = np.zeros(n, dtype=bool)
    last[np.append(starts[1:], n) - 1] = True
    white = symbol >= SPACE_X
    before_white = np.append(white[1:], True)
    before_white |= last
    symbol[white & before_white] = WHITE
    apo = np.flatnonzero(cps == 0x27)
    if len(apo):
        padded = np.append(cps, [0, 0])
        stop = offsets[np.searchsorted(offsets, apo, side="right")]
        one, two = padded[apo + 1], padded[apo + 2]
        one = np.where(apo + 1 < stop, one, 0)
        two = np.where(apo + 2 < stop, two, 0)
        symbol[apo[np.isin(one, [ord(c) for c in "stmd"])]] = APO1
        symbol[apo[(np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = APO2
    _, element, first, _ = automaton()
    elements = element[symbol]
    elements[starts] = first[symbol[starts]]
    states = scan_states(elements)
    states[starts] = START
    begin = _begins()[states.astype(np.intp) * 8 + symbol]
    begin[starts] = True
    return np.flatnonzero(begin)


class Encoder:
    """Whole-batch encoder over one vocabulary file, with a bounded cache of slices."""

    def __init__(self, folder: str = TOKENIZERS, name: str = NAME):
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.merge_slice = merge.encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        self.width_of = np.array(list(map(len, self.bytes_of)), dtype=np.int64)
        self.cache: dict[bytes, list[int]] = {}

    def slices(self, values: pa.Array) -> list[list[int]]:
        cache, merge, out = self.cache, self.merge_slice, []
        if len(cache) > CACHED:
            cache.clear()
        for s in values.to_pylist():
            ids = cache.get(s)
            if ids is None:
                ids = merge(s)
                if len(s) <= CACHED_BYTES:
                    cache[s] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, token offsets of each text (len + 1), and which tokens begin a pre-token."""
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=offsets[1:])
        joined = "".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        data = joined.encode("utf-8")
        begin = boundaries(cps, offsets)
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        place = np.zeros(len(cps) + 1, dtype=np.int64)
        np.cumsum(width, out=place[1:])
        cuts = np.append(place[begin], len(data)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        pieces = self.slices(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = np.fromiter(chain.from_iterable(pieces), dtype=np.int32, count=int(size.sum()))
        first = np.cumsum(size) - size
        many = size[codes]
        upto = np.cumsum(many)
        ids = flat[np.repeat(first[codes] - (upto - many), many) + np.arange(int(many.sum()))]
        heads = np.zeros(len(ids), dtype=bool)
        heads[upto - many] = True
        slice_of_text = np.searchsorted(begin, offsets)
        return ids, np.concatenate(([0], upto))[slice_of_text], heads

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder_of(folder: str, name: str) -> Encoder:
    """The encoder of a vocabulary file, once per worker process; its cache of slices is bounded."""
    return Encoder(folder, name)


def valid(texts: list[str | None]) -> list[str]:
    return [t or "" for t in texts]


def text_slabs(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLAB:
            yield start, i
            start, size = i, 0
        size += len(t)
    yield start, len(texts)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, *, folder: str = TOKENIZERS, name: str = NAME, with_offsets: bool = False) -> DataFrame:
    """Encode every text without special tokens: ``id_col``, ``ids ARRAY<INT>`` (and ``ends ARRAY<INT>``, byte ends).

    Defined cases: a null or empty text gives an empty list; a null id is kept; repeated rows are encoded each; an empty
    table gives an empty table; further columns of the input, whatever their names, are not carried. Texts of any length
    are encoded whole. No shuffle: one narrow pass over the two columns.
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if with_offsets:
        fields.append(T.StructField("ends", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(folder, name)
        for batch in batches:
            texts = valid(batch.column(1).to_pylist())
            for a, b in text_slabs(texts):
                ids, at, _ = encoder.encode(texts[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
                if with_offsets:
                    ends = np.cumsum(encoder.width_of[ids])
                    ends -= np.repeat(np.concatenate(([0], ends))[at[:-1]], np.diff(at))
                    lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ends, pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], [f.name for f in fields])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
