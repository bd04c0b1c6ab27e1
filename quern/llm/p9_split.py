"""Problem 9: cutting oversized texts at natural boundaries with overlap, by pointer doubling.

Method: every token of a text is a possible start of a piece, and has exactly one farthest legal end: the last paragraph
end in the second half of the window, else the last sentence end there, else the last word end, else the last token that
ends a whole character. The start of the next piece, about ``overlap`` tokens before that end, is the token's successor.
Squaring the successor table doubles the number of pieces it skips, so after log2(pieces) squarings all cuts of all texts
of a batch are read off in parallel; no text is walked piece by piece.

Sizes are those of the text's own tokens. No merge ever crossed the border of two tokens, so a piece encoded by itself
has the same tokens, except that white space at a piece's end may join into fewer: the limit holds for it as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.p7_encode import Encoder, NAME, TOKENIZERS, encoder_of, text_slabs

# Marks that end a sentence, and marks that may follow them before the sentence is over.
ENDERS = ".!?。！？…؟"
CLOSERS = "\"'”’»)]』」）"


def _marks(encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Per token id: does its text end a sentence (closing marks aside), is it only closing marks."""
    ender = np.zeros(len(encoder.bytes_of), dtype=bool)
    closer = np.zeros(len(encoder.bytes_of), dtype=bool)
    for i, b in enumerate(encoder.bytes_of):
        t = b.decode("utf-8", "ignore")
        core = t.rstrip(CLOSERS)
        ender[i] = bool(core) and core[-1] in ENDERS
        closer[i] = bool(t) and not core
    return ender, closer


def cut_points(ids: np.ndarray, heads: np.ndarray, encoder: Encoder) -> dict[str, np.ndarray]:
    """For the gap after each token: may a piece end here, as a character, word, sentence or paragraph end."""
    width = encoder.width_of[ids]
    ends = np.cumsum(width)
    data = np.frombuffer(b"".join(encoder.bytes_of[i] for i in ids.tolist()), dtype=np.uint8)
    follows = np.append(data, 0)[ends]  # first byte of the next token
    whole = (follows & 0xC0) != 0x80
    ascii_white = np.isin(data, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    blank = np.add.reduceat(ascii_white, ends - width) == width if len(ids) else np.zeros(0, bool)
    newline = (data == 10) | (data == 13)
    lines = np.add.reduceat(data == 10, ends - width) if len(ids) else np.zeros(0, int)
    next_head = np.append(heads[1:], True)
    next_blank = np.append(blank[1:], False)
    # A white-space token before further white space belongs to one run; cutting inside would regroup the run.
    word = whole & next_head & ~(blank & next_blank)
    ender, closer = _marks_cached(encoder)
    says_end = ender[ids]
    for _ in range(3):  # closing marks after the sentence's end belong to it
        says_end = says_end | (closer[ids] & np.concatenate(([False], says_end[:-1])))
    next_white = np.isin(follows, np.frombuffer(b" \t\n\r\x0b\x0c\x00", np.uint8))
    wide = np.zeros(len(ids), bool)
    wide[:] = follows >= 0x80  # scripts written without spaces
    last_line = newline[ends - 1] if len(ids) else np.zeros(0, bool)
    sentence = word & ((says_end & (next_white | wide) & ~np.append(closer[ids][1:], False)) | (last_line & blank))
    double = blank & (lines + np.concatenate(([0], (lines * blank)[:-1])) >= 2)
    return {"whole": whole, "word": word, "sentence": sentence, "paragraph": word & double}


_MARKS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _marks_cached(encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    if id(encoder) not in _MARKS:
        _MARKS.clear()
        _MARKS[id(encoder)] = _marks(encoder)
    return _MARKS[id(encoder)]


def _last_at(mask: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each gap position in ``upto``, the last position <= it where a piece may end (0 if none). Position p = after p tokens."""
    seen = np.concatenate(([0], np.maximum.accumulate(np.where(mask, np.arange(1, len(mask) + 1), 0))))
    return seen[upto]


def cuts(ids: np.ndarray, heads: np.ndarray, at: np.ndarray, encoder: Encoder, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token spans of all pieces of all texts: owner, start, end. ``at``: token offsets of the texts."""
    n = len(ids)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    kind = cut_points(ids, heads, encoder)
    stop_of_text = np.repeat(at[1:], np.diff(at))
    start = np.arange(n)
    far = np.minimum(start + limit, stop_of_text)
    least = start + limit // 2
    end = _last_at(kind["whole"], far)
    for name in ("word", "sentence", "paragraph"):
        p = _last_at(kind[name], far)
        floor = start + overlap if name == "word" else least
        end = np.where(p > floor, p, end)
    end = np.where(far == stop_of_text, stop_of_text, np.maximum(end, start + 1))
    want = np.maximum(end - overlap, 0)
    by_word = _last_at(kind["word"], want)
    by_char = _last_at(kind["whole"], want)
    back = np.where(by_word >= want - overlap // 2, by_word, by_char)
    back = np.where(back > start, back, end)
    done = end >= stop_of_text
    successor = np.append(np.where(done, n, back), n)  # n: no further piece
    # Squaring: tables[k][s] is the start 2**k pieces after s.
    roots = at[:-1][np.diff(at) > 0]
    tables, reach = [successor], successor[roots]
    while (reach < n).any():
        tables.append(tables[-1][tables[-1]])
        reach = tables[-1][roots]
    # Number of pieces of each text, by binary descent; then every piece's start, all in parallel.
    count = np.zeros(len(roots), dtype=np.int64)
    here = roots.copy()
    for k in reversed(range(len(tables))):
        jump = tables[k][here]
        ok = jump < n
        here = np.where(ok, jump, here)
        count += ok * (1 << k)
    count += 1
    owner = np.repeat(np.arange(len(roots)), count)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = roots[owner]
    for k, table in enumerate(tables):
        step = (rank >> k & 1).astype(bool)
        begin = np.where(step, table[begin], begin)
    texts = np.flatnonzero(np.diff(at) > 0)
    return texts[owner], begin, end[begin]


def split_oversized(df: DataFrame, id_col: str, text_col: str, *, limit: int = 512, overlap: int = 32, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens: id, ``piece_no`` from 0, byte span, ``n_tokens``, ``piece``.

    Defined cases: texts within the limit, empty and null ones give no rows (they need no cut); a null id is kept;
    repeated rows are cut each alike; an empty table gives an empty table; other columns are not carried. Texts without
    spaces or line ends are cut between whole characters. Pieces cover the text without a gap. Spans are UTF-8 bytes.
    """
    if not 0 <= overlap * 2 < limit:
        raise ValueError("overlap must be less than half of limit")
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start_byte", T.LongType()),
            T.StructField("end_byte", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("piece", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(folder, name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keep = [i for i, t in enumerate(texts) if len(t) * 4 > limit and len(t.encode()) > limit]
            texts, keys = [texts[i] for i in keep], batch.column(0).take(pa.array(keep, pa.int64()))
            for a, b in text_slabs(texts):
                if a == b:
                    continue
                ids, at, heads = encoder.encode(texts[a:b])
                long = np.flatnonzero(np.diff(at) > limit)
                if not len(long):
                    continue
                pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in long])
                size = np.diff(at)[long]
                sub = np.concatenate(([0], np.cumsum(size)))
                ids, heads = ids[pick], heads[pick]
                owner, begin, end = cuts(ids, heads, sub, encoder, limit, overlap)
                place = np.concatenate(([0], np.cumsum(encoder.width_of[ids])))
                base = place[sub[:-1]][owner]
                lo, hi = place[begin] - base, place[end] - base
                raw = [texts[a + i].encode() for i in long]
                pieces = [raw[o][x:y].decode() for o, x, y in zip(owner.tolist(), lo.tolist(), hi.tolist())]
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(a, b - a).take(pa.array(long[owner], pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array(lo, pa.int64()),
                        pa.array(hi, pa.int64()),
                        pa.array(end - begin, pa.int32()),
                        pa.array(pieces, pa.string()),
                    ],
                    schema.fieldNames(),
                )

    return df.select(id_col, text_col).mapInArrow(run, schema)
