"""Problem 8: the whole corpus as ids of a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern in the JVM. Each task dictionary-encodes its words with Arrow, so only words it
hasn't met are encoded, by a recursive query of DuckDB: rows of (word, position, token) join the merge table, and every word's
leftmost pair of least rank is contracted (with its repeats in the word) until no word has a pair left; an ordered aggregation reads the ids off. Before that a
long word is cut where no token of the vocabulary reaches across, which changes no id and keeps the recursion short.

Defined results: an empty and a null text have no ids (an empty list); repeated rows are encoded alike; texts of any length are
encoded whole; other columns pass through.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("AMALGAM_TOKENIZERS", "/opt/tokenizers")

# White space as the tokenizer's pattern means it (the JVM's \s is ASCII only). Fixed values.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The tokenizer's pattern in the JVM's syntax. Fixed value.
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Positions that one recursive query holds at a time, and words that a task remembers; both only bound memory.
POSITIONS, REMEMBERED = 150_000, 400_000
#: Words of at least so many bytes are cut where no token reaches across.
LONG = 24

# A pair stands at `pos`, its second token at `nxt`. Where a word holds its least pair more than once, each is contracted in the same
# round, leftmost first; in a run of one token (aaaa) every second pair. No merge that uses a new token ranks before it, so
# this equals contracting one at a time.
RECURSION = """
WITH RECURSIVE s(it, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM start
  UNION ALL (
    WITH p AS (SELECT it, word, pos, tok, lead(pos) OVER w AS nxt, lead(tok) OVER w AS following FROM s WINDOW w AS (PARTITION BY word ORDER BY pos)),
    pairs AS (SELECT p.word, p.pos, p.nxt, m.rank, p.tok = p.following AS twin FROM p JOIN merges m ON m.a = p.tok AND m.b = p.following),
    least AS (SELECT word, min(rank) AS rank FROM pairs GROUP BY word),
    hits AS (SELECT pairs.word, pos, nxt, pairs.rank, twin FROM pairs JOIN least USING (word, rank)),
    runs AS (SELECT word, pos, nxt, rank, sum(apart) OVER (PARTITION BY word ORDER BY pos) AS run
             FROM (SELECT *, CASE WHEN lag(nxt) OVER (PARTITION BY word ORDER BY pos) = pos THEN 0 ELSE 1 END AS apart FROM hits WHERE twin)),
    chosen AS (SELECT word, pos, nxt, rank FROM hits WHERE NOT twin
               UNION ALL SELECT word, pos, nxt, rank FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS k FROM runs) WHERE k % 2 = 1),
    moves AS (SELECT word, pos AS at, (rank + $first)::INTEGER AS made FROM chosen UNION ALL SELECT word, nxt, -1 FROM chosen)
    SELECT it + 1, p.word, p.pos, coalesce(made, tok) FROM p JOIN least USING (word) LEFT JOIN moves ON moves.word = p.word AND moves.at = p.pos
    WHERE made IS NULL OR made >= 0
  )
)
SELECT s.word, list(tok ORDER BY pos) AS ids FROM s JOIN (SELECT word, max(it) AS it FROM s GROUP BY word) e ON e.word = s.word AND e.it = s.it
GROUP BY s.word ORDER BY s.word
"""


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The vocabulary, the merge table in DuckDB and the words met so far, one for each Python worker."""

    def __init__(self, path: str, unreached: frozenset[int] = frozenset()) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte = _byte_letters()
        self.vocab = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        a, b, made = ([model["vocab"][x] for x in xs] for xs in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        #: A merge's rank and the id it makes differ by a constant in such vocabularies.
        self.first = made[0]
        if any(m != self.first + r for r, m in enumerate(made)):
            raise ValueError(f"{path}: ids don't follow the ranks of merges")
        self.of_byte = np.array([self.vocab[bytes([i])] for i in range(256)], np.int32)
        #: Tokens that stand for themselves: all that their own bytes contract to. Others have no shortcut.
        self.whole = {t: i for t, i in self.vocab.items() if i not in unreached}
        #: The longest token that begins with two given bytes.
        self.reach: dict[bytes, int] = {}
        for t in self.vocab:
            if len(t) > 1:
                self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
        self.duck.register("t", pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(range(len(a)), pa.int64())}))
        self.duck.execute("CREATE TABLE merges AS FROM t")
        self.known: dict[str, list[int]] = {}

    def pieces(self, word: bytes) -> list[bytes]:
        """The word, cut where no token of the vocabulary could reach across."""
        if len(word) < LONG:
            return [word]
        n, reach, cuts = len(word), 0, []
        for i in range(n - 1):
            for k in range(min(self.reach.get(word[i : i + 2], 0), n - i), max(1, reach - i), -1):
                if word[i : i + k] in self.vocab:
                    reach = i + k
                    break
            if reach <= i + 1:
                cuts.append(i + 1)
        return [word[x:y] for x, y in zip([0, *cuts], [*cuts, n])]

    def contract(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= POSITIONS):
                size += len(words[end])
                end += 1
            own = words[at:end]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            tok = self.of_byte[np.frombuffer(b"".join(own), np.uint8)]
            pos = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.duck.register("start", pa.table({"word": np.repeat(np.arange(len(own), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "tok": tok}))
            out += self.duck.sql(RECURSION.replace("$first", str(self.first))).to_arrow_table().column("ids").to_pylist()
            self.duck.unregister("start")
            at = end
        return out

    def learn(self, words: list[str]) -> None:
        """Encode the words not known yet."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        todo: list[tuple[str, list[bytes]]] = []
        wanted: dict[bytes, list[int]] = {}
        for word in words:
            if word in self.known:
                continue
            raw = word.encode()
            if (i := self.whole.get(raw)) is not None:
                self.known[word] = [i]
            else:
                parts = self.pieces(raw)
                todo.append((word, parts))
                for p in parts:
                    wanted[p] = [i] if (i := self.whole.get(p)) is not None else []
        missing = [p for p, ids in wanted.items() if not ids]
        for p, ids in zip(missing, self.contract(missing)):
            wanted[p] = ids
        for word, parts in todo:
            self.known[word] = wanted[parts[0]] if len(parts) == 1 else [i for p in parts for i in wanted[p]]


@lru_cache(2)
def encoder(path: str, unreached: frozenset[int] = frozenset()) -> Encoder:
    return Encoder(path, unreached)


@lru_cache(4)
def unreached(path: str) -> frozenset[int]:
    """The tokens of a vocabulary whose own bytes the merges don't contract to that token alone, by contracting each of them, least rank first.

    Only a token that is reached may be looked up instead of contracted. Run once by the driver; the answer travels to the tasks.
    """
    model = json.load(open(path, encoding="utf-8"))["model"]
    rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
    none, out = len(rank), []
    for token, i in model["vocab"].items():
        parts = list(token)
        while len(parts) > 1:
            ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
            least = min(ranks)
            if least == none:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) > 1:
            out.append(i)
    return frozenset(out)


def _encode(path: str, at: int, without: frozenset[int]):
    """Replaces the array of words in column `at` by the array of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, without)
        for batch in batches:
            words = batch.column(at)
            coded = pc.dictionary_encode(words.flatten())
            distinct = coded.dictionary.to_pylist()
            enc.learn(distinct)
            ids = pa.array([enc.known[w] for w in distinct], pa.list_(pa.int32()))
            taken = ids.take(coded.indices)
            ends = taken.offsets.to_numpy(zero_copy_only=False) if len(taken) else np.zeros(1, np.int32)
            offsets = words.offsets.to_numpy(zero_copy_only=False)
            rows = pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]], pa.int32()), taken.flatten())
            yield pa.RecordBatch.from_arrays([rows if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return run


def encode(df: DataFrame, text: str, ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """df with the column `text` replaced by `ids`, an array of int."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))
    rest = [c for c in df.columns if c != text]
    kept = df.select(*rest, words.alias(ids))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    path = f"{folder}/{tokenizer}.json"
    return kept.mapInArrow(_encode(path, len(rest), unreached(path)), f"{schema + ', ' if rest else ''}`{ids}` array<int>")
