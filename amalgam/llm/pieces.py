"""Problem 10: texts above a size limit in pieces, by content-defined chunking.

Sizes are tokens of a public tokenizer, and a piece is a slice of the text's token sequence. A rolling hash over the last tokens
marks landmarks; from a cut on, the first landmark beyond the least size is snapped to the nearest natural boundary (sections before
paragraphs before lines before sentences) between the least and the largest size. Where no landmark falls in between, the strongest
boundary decides, the last one of its kind; then the last word; and inside a word longer than a piece the last whole character.
Cuts depend on the text near them only, so an edit alters its own and neighbouring pieces and the cuts behind it fall as before.

Each piece but a text's first begins with `overlap` tokens of the piece before it. `text` is the piece's text; a character that the
overlap would begin in the middle of is left to the piece before.

Defined results: null, empty and short texts (not above the limit) have no pieces; repeated rows are cut alike; whole texts of
any length are cut; a table of limits with no rows gives no pieces; limits must leave room beside the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.llm.tokens import TOKENIZERS
from amalgam.llm.words import coded, sizes, words_of

#: Tokens under the rolling hash, and its multiplier.
WINDOW, BASE = 12, np.uint64(0x9E3779B97F4A7C15)
KINDS = ("word", "sentence", "line", "paragraph", "section")
#: A boundary this many times as far from the landmark as another is taken if it is one kind stronger.
PULL = 3.0
SENTENCE_END = tuple(".!?。！？…।؟")


def rolling(ids: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW tokens before each position (fewer at the beginning)."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(ids) + 1, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(1, WINDOW + 1):
            if k <= len(ids):
                out[k:] += mixed[: len(ids) - k + 1] * factor
            factor *= BASE
    return out ^ (out >> np.uint64(32))


def cuts(n: int, hashes: np.ndarray, at: np.ndarray, kind: np.ndarray, whole: np.ndarray, limit: int, overlap: int) -> list[tuple[int, str]]:
    """The ends of the pieces of a text with n tokens, each with the kind of its boundary.

    at, kind: where natural boundaries are, ascending, and their kinds; whole: whether a character begins at each position.
    """
    out, start = [], 0
    while True:
        room = limit - (overlap if start else 0)
        if n - start <= room:
            out.append((n, "end"))
            return out
        low, high = start + max(1, room // 2), start + room
        i, j = np.searchsorted(at, low), np.searchsorted(at, high, "right")
        near, kinds = at[i:j], kind[i:j]
        natural = kinds > 0
        marks = np.flatnonzero(hashes[low : high + 1] % np.uint64(max(2, room // 8)) == 0)
        if natural.any():
            if len(marks):
                away = np.abs(near - (low + marks[0])).astype(float) + 1
                best = int(np.argmin(np.where(natural, away / PULL**kinds, np.inf)))
            else:
                best = len(kinds) - 1 - int(np.argmax(kinds[::-1]))
            end, what = int(near[best]), KINDS[kinds[best]]
        elif len(near):
            end, what = int(near[-1]), "word"
        else:
            inside = np.flatnonzero(whole[low : high + 1])
            end, what = (low + int(inside[-1]) if len(inside) else high), "character"
        out.append((end, what))
        start = end


def _word_flags(words: list[str]) -> np.ndarray:
    """Per distinct word: 1 holds a line break, 2 blank line, 4 begins a heading, 8 ends a sentence, 16 begins with a blank, 32 no Latin-like blank needed."""
    out = np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        f = 0
        if "\n" in w or "\r" in w:
            f |= 1
            if w.count("\n") > 1:
                f |= 2
        if w.startswith("=="):
            f |= 4
        tail = w.rstrip("\"'”’»)]}")
        if tail.endswith(SENTENCE_END):
            f |= 8
            if tail[-1] in "。！？":
                f |= 32
        if w[:1].isspace():
            f |= 16
        out[i] = f
    return out


SCHEMA = "limit_name string, piece int, start_token int, end_token int, n_tokens int, overlap int, boundary string, start_char int, end_char int, text string"


def _split(limits: list[tuple[str, int, int]], tokenizer: str, folder: str, schema: pa.Schema):
    least = min((m for _, m, _ in limits), default=2**31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sizes(tokenizer, folder)
        for batch in batches:
            words = batch.column(1)
            distinct, codes, first = coded(words)
            own = size.of(distinct)
            n_of = np.fromiter(map(len, own), np.int64, len(own))
            flags = _word_flags(distinct)
            id_start = np.concatenate([[0], np.cumsum(n_of)])
            all_ids = np.fromiter((i for w in own for i in w), np.int64, int(id_start[-1]))
            flat = words.flatten()
            byte_of = flat.offsets.to_numpy(zero_copy_only=False) if hasattr(flat, "offsets") else np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
            data = flat.buffers()[2]
            keys = batch.column(0)
            rows: list[list] = [[] for _ in schema]
            held = 0
            counts = np.concatenate([[0], np.cumsum(n_of[codes])])
            for r in range(len(first) - 1):
                a, b = first[r], first[r + 1]
                n = int(counts[b] - counts[a])
                if n <= least:
                    continue
                code = codes[a:b]
                per = n_of[code]
                begins = np.concatenate([[0], np.cumsum(per)])  # token position of each word
                ids = all_ids[np.repeat(id_start[code] - begins[:-1], per) + np.arange(n)]
                hashes = rolling(ids)
                cum = np.concatenate([[0], np.cumsum(size.n_bytes[ids])])
                raw = np.frombuffer(data, np.uint8, int(cum[-1]), int(byte_of[a]))
                lead = np.concatenate([(raw & 0xC0) != 0x80, [True]])
                whole = lead[cum]
                chars = np.concatenate([[0], np.cumsum(lead[:-1])])
                f = flags[code]
                before, before2 = f[:-1], np.concatenate([[0], f[:-2]])
                kind = np.zeros(len(f) - 1, np.int64)
                kind[(before & 8 > 0) & ((f[1:] & 16 > 0) | (before & 32 > 0))] = 1
                kind[(before & 1 > 0) & (f[1:] & 1 == 0)] = 2
                kind[(before & 1 > 0) & ((before2 & 1 > 0) | (before & 2 > 0)) & (f[1:] & 1 == 0)] = 3
                kind[(before & 1 > 0) & (f[1:] & 4 > 0)] = 4
                text = raw.tobytes()
                for name, limit, overlap in limits:
                    if n <= limit:
                        continue
                    start = 0
                    for k, (end, what) in enumerate(cuts(n, hashes, begins[1:-1], kind, whole, limit, overlap)):
                        own_overlap = overlap if k else 0
                        s = start - own_overlap
                        left = int(cum[s])
                        while not lead[left]:
                            left += 1
                        piece = text[left : int(cum[end])].decode("utf-8", "ignore")
                        for column, x in zip(rows, (keys[r].as_py(), name, k, s, end, end - s, own_overlap, what, int(chars[left]), int(chars[cum[end]]), piece)):
                            column.append(x)
                        held += len(piece)
                        start = end
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema)], schema=schema)
                    rows, held = [[] for _ in schema], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema)], schema=schema)

    return run


def split_texts(df: DataFrame, key: str, text: str, limits: list[tuple[str, int, int]], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, limit_name, piece, ...): the pieces of each text above a limit; limits: (name, most tokens, shared tokens)."""
    for name, most, shared in limits:
        if shared < 0 or most - shared < 8:
            raise ValueError(f"limit {name}: {most} tokens leave no room beside an overlap of {shared}")
    kind = df.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, {SCHEMA}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))
    return df.select(key, words_of(F.col(text)).alias("words")).mapInArrow(_split(limits, tokenizer, folder, schema), out)
