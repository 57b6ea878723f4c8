"""Names and addresses of business records taken apart, for problems 4, 5 and 7.

Both are folded first (look-alikes, width, accents, case). Words are then told apart by how many different values hold them: common
words (legal forms, trades, given names; kinds of streets, towns, directions) become marks, whose meaning roles.py learns from the
corpus; the rest make up the core, the name or street proper. A share of all values bounds the list of common words, whatever the
size of the data, so it may be handed to every task.

Defined results: a missing value has null in every part; a value of punctuation only has empty parts; texts are folded whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.llm.values import is_missing
from amalgam.llm.looks import folded
from amalgam.llm.vectors import sketch, sketches
from amalgam.sources.tables import cut

#: The share of all distinct values that a common word holds, and how many it holds at least (fewer show nothing).
COMMON, EVIDENCE = 0.0003, 4


def _plain_letters() -> dict[int, str]:
    """Latin letters with accents (as they are composed) to the letters without, and blanks of one width to the plain one."""
    out = {c: " " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            out[c] = base[0]
    return out | {0x110: "D", 0x111: "d", 0x141: "L", 0x142: "l", 0xD8: "O", 0xF8: "o"}


LATIN = _plain_letters()


@lru_cache(20_000)
def fold(value: str) -> str:
    """Lower case without accents or look-alikes; ae, oe, ue as a, o, u."""
    s = value if value.isascii() else value.translate(LATIN)
    if not s.isascii():
        s = folded(value)
    s = s.casefold()
    if not s.isascii():
        s = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ"))
        s = s.translate({0x111: "d", 0x142: "l", 0xF8: "o", 0x131: "i", 0x3C2: "σ"})
    return s.replace("ae", "a").replace("oe", "o").replace("ue", "u")


# Formats of addresses. Words before the number of a unit or of a house, and shapes of postcodes.
DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}(?:[^\W\d_]\b\.?)?")
UNIT = re.compile(r"\b(?:unit|apt|apartment|flat|ste|suite|room|rm)\b[.:]?\s*#?\s*\d+[a-z]?\b|\b\d+(?:st|nd|rd|th)\s+(?:fl|floor)\b")
HASH_UNIT = re.compile(r"#\d+\b")
POSTCODES = re.compile(r"\b(?:\d{3}-\d{4}|\d{5}-\d{3}|\d{2}-\d{3}|[a-z]{1,2}\d[a-z\d]?\s*\d[a-z]{2}|[a-z]\d[a-z]\s*\d[a-z]\d|\d{5,7})\b")
DUTCH, FOUR = re.compile(r"\b\d{4}\s?[a-z]{2}\b"), re.compile(r"\b\d{4}\b")
MARKED = re.compile(r"(?:\bno\b\.?|\bnr\b\.?|\bn\s?°|\bn\s?º|#|№|\bnum\b\.?)\s*(\d{1,4})\b")
NUMBER = re.compile(r"(?<![\w-])(\d{1,4})(?![\w])")
WORD = re.compile(r"[^\W\d_]+")


def words_of(folded_value: str) -> list[str]:
    """Runs of letters; letters with dots between (S.A.) are one word."""
    s = folded_value
    if "." in s:
        s = DOTTED.sub(lambda m: m[0].replace(".", "") + " ", s)
    if "'" in s or "’" in s:
        s = s.replace("'", "").replace("’", "")
    return WORD.findall(s)


def _less(word: str) -> list[str]:
    """The word and all words with one letter less."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Words:
    """Tells common words (and slips of them: a letter more, less, other, or two swapped) from rare ones."""

    def __init__(self, common: list[str]) -> None:
        self.id = {w: i for i, w in enumerate(common)}
        self.at: dict[str, str] = {}
        for w in common:
            if len(w) >= 5:
                for x in _less(w):
                    self.at.setdefault(x, w)
        #: Scripts written without blanks may run a common word and a name together; so do compounds of long words.
        self.longest = max((len(w) for w in common), default=0)
        self.seen: dict[str, tuple[str, tuple[int, ...]]] = {}

    def split(self, word: str) -> tuple[str, tuple[int, ...]]:
        """What is left of a word, and the marks in it."""
        if (i := self.id.get(word)) is not None:
            return "", (i,)
        if word not in self.seen:
            if len(self.seen) > 30_000:
                self.seen.clear()
            self.seen[word] = self._split(word)
        return self.seen[word]

    def _split(self, word: str) -> tuple[str, tuple[int, ...]]:
        if len(word) >= 5:
            n, at = len(word), self.at
            near = at.get(word)
            if near and abs(len(near) - n) <= 1:
                return "", (self.id[near],)
            for i in range(n):
                near = at.get(word[:i] + word[i + 1 :])
                if near and abs(len(near) - n) <= 1:
                    return "", (self.id[near],)
        marks: tuple[int, ...] = ()
        wide = word[0] > "ԯ"
        shortest, least = (1, 2) if wide else (5, 4)
        found = True
        while found:
            found = False
            for k in range(min(len(word) - least, self.longest), shortest - 1, -1):
                for end, rest in ((word[-k:], word[:-k]), (word[:k], word[k:]) if wide else ("", "")):
                    if end in self.id and (end[0] > "ԯ") == wide:
                        word, marks, found = rest, (*marks, self.id[end]), True
                        break
                if found:
                    break
        return word, marks

    def __call__(self, words: list[str]) -> tuple[list[str], list[int]]:
        """The rare words in order, and the marks in ascending order."""
        rare, marks = [], set()
        for w in words:
            left, own = self.split(w)
            marks.update(own)
            if left:
                rare.append(left)
        return rare, sorted(marks)


def _hashed(keys) -> list[int]:
    return [crc32(k.encode()) - (1 << 31) for k in keys]


def name_keys(core: list[str]) -> list[int]:
    """Pairs of n-grams, one from each end or word of a name: two spellings share one unless a slip hits each pair.

    Of words next to each other (the last and the first are, too), begin and end each pair with begin and end, in either order; of
    the name run together, begin, middle and end. Their number grows with the number of words.
    """
    if not core:
        return []
    wide = core[0][0] > "ԯ"  # scripts of syllables
    joined = "".join(core)
    n = 2 if wide else 3
    a, b = joined[:n], joined[-n:]
    keys = {f"{a}<>{b}" if a <= b else f"{b}><{a}", f"y{joined[: n + 2]}{joined[-1:]}", f"z{joined[:1]}{joined[-n - 2 :]}"}
    if len(core) == 1:
        m = max(len(joined) // 2 - 2, 0)
        keys |= {f"u{a}{joined[m : m + n + 1]}", f"w{joined[m : m + n + 1]}{b}"}
        return _hashed(sorted(keys))
    for i, v in enumerate(core if len(core) > 2 else core[:1]):
        w = core[(i + 1) % len(core)]
        p, q = (2 if wide or len(x) < 6 else 3 for x in (v, w))
        a, b, c, d = v[:p], v[-p:], w[:q], w[-q:]
        keys.add(f"{a}<<{c}" if a <= c else f"{c}<<{a}")
        keys.add(f"{b}>>{d}" if b <= d else f"{d}>>{b}")
        keys.add(f"{a}<>{d}" if a <= d else f"{d}><{a}")
        keys.add(f"{c}<>{b}" if c <= b else f"{b}><{c}")
    return _hashed(sorted(keys))


# Letters that are taken for each other by their sound.
LIKE = str.maketrans("cqwyzj", "kkvisi")
DOUBLED = re.compile(r"(.)\1+")


@lru_cache(50_000)
def sound(word: str) -> str:
    """A word in letters of its sound: those that sound alike are one, doubled ones single; other scripts as written."""
    return DOUBLED.sub(r"\1", word.replace("ph", "f").replace("ks", "x").translate(LIKE))


def street_keys(house: str, post: str, street: list[str]) -> list[int]:
    """The number with the postcode, and with the sound of the street: of a street of one word its beginning, its end and both; of more words,
    of each both, and for each two next to each other (the last and the first are, too), the beginning or end of one with that of the other, in either order."""
    if not house:
        return []
    keys = {f"{house}={post}"} if post else set()
    ends = []
    for w in map(sound, street):
        n = 3 if w[0] <= "ԯ" else 2
        ends.append((f"<{w[:n]}", f">{w[-n:]}"))
    if len(ends) == 1:
        keys |= {house + ends[0][0], house + ends[0][1], house + "".join(ends[0])}
    elif ends:
        for i, v in enumerate(ends if len(ends) > 2 else ends[:1]):
            keys |= {house + "".join(sorted((x, y))) for x in v for y in ends[(i + 1) % len(ends)]}
        keys |= {house + "".join(v) for v in ends}
    return _hashed(sorted(keys))


def parse_name(words: Words, value: str) -> tuple:
    """(core, marks, keys, sketches) of a folded name."""
    own = words_of(value)
    core, marks = words(own)
    if not core:  # a name of common words only is compared as it is written
        core, marks = own, []
    return " ".join(core), marks, name_keys(core), *sketches(core)


def parse_address(words: Words, value: str | None, country: str | None) -> tuple:
    """(house, post, street, marks, keys, sketch) of a folded address; the country is a mark like any other, also where the address is missing."""
    if value is None:
        i = words.id.get(country)
        return None, None, None, [] if i is None else [i], [], 0
    s = UNIT.sub(" ; ", value)
    post = ""
    if m := POSTCODES.search(s):
        post = re.sub(r"[\s-]", "", m[0])
        s = f"{s[: m.start()]} ; {s[m.end() :]}"
    elif m := DUTCH.search(s):
        post = m[0].replace(" ", "")
        s = f"{s[: m.start()]} ; {s[m.end() :]}"
    unhashed = HASH_UNIT.sub(" ; ", s) if "#" in s else s
    plain = NUMBER.findall(unhashed)
    short = [x for x in plain if len(x) < 4]
    marked = MARKED.findall(unhashed if plain else s)  # "#14" beside another number is a unit
    house = (marked or short or plain or [""])[0].lstrip("0")
    if not post and (m := next((x for x in FOUR.findall(s) if x != house), None)):
        post = m
    street, marks = words([w for w in words_of(s) if len(w) > 1 or not w.isascii()])
    if country and (i := words.id.get(country)) is not None:
        marks = sorted({*marks, i})
    street = sorted(set(street))
    return house, post, " ".join(street), marks, street_keys(house, post, street), sketch("".join(street))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [pa.array([None if v is None else fold(v) for v in c.to_pylist()], pa.string()) for c in b.columns[2:4]]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *own], ["id", "country", "name", "address"])


def folded_records(df: DataFrame, id_col: Column, name: bool = True, address: bool = True) -> DataFrame:
    """(id, country, name, address) of each row that has a name or an address: both folded, null where missing; written."""
    value = lambda c, on: (F.when(~is_missing(F.col(c)), F.col(c)) if on else F.lit(None)).cast("string")
    country = F.concat(F.lit("@"), F.lower(F.trim(value("country", address))))
    rows = df.select(id_col.alias("id"), country.alias("country"), value("business_name", name).alias("name"), value("business_address", address).alias("address"))
    rows = rows.where(F.col("name").isNotNull() | F.col("address").isNotNull())
    return cut(rows.mapInArrow(_folded, "id string, country string, name string, address string"))


def common_words(*distinct: DataFrame) -> list[str]:
    """Words that at least COMMON of the folded values in the only columns of tables of distinct values hold, in order; numbers don't count.

    At most (mean number of words) / COMMON words come back.
    """
    every = None
    for t in distinct:
        every = t if every is None else every.unionAll(t)
    col = F.col(every.columns[0])
    dotted = F.regexp_replace(F.regexp_replace(col, r"(?<![\p{L}])((?:\p{L}\.){2,}\p{L}?)", "$1 "), r"(?<=(?<!\p{L})\p{L})\.(?=\p{L}\b)|['’]", "")
    plain = F.when(F.contains(col, F.lit(".")) | F.contains(col, F.lit("'")) | F.contains(col, F.lit("’")), dotted).otherwise(col)
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(@.*|\p{L}+)"), F.lit(1)))
    counted = every.select(F.explode(found).alias("w")).groupBy("w").count().where(F.col("count") >= EVIDENCE)
    counted = counted.where(F.col("count") >= F.lit(COMMON) * sum(t.count() for t in distinct)).collect()
    return sorted(r.w for r in counted)


_MARKS = _KEYS = pa.list_(pa.int32())
NAME_FIELDS = {"core": pa.string(), "marks": _MARKS, "keys": _KEYS, "sketch_a": pa.int64(), "sketch_b": pa.int64()}
ADDRESS_FIELDS = {"house": pa.string(), "post": pa.string(), "street": pa.string(), "places": _MARKS, "address_keys": _KEYS, "street_sketch": pa.int64()}
_DDL = {pa.string(): "string", pa.int64(): "bigint", _MARKS: "array<int>"}


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if kind != _MARKS or any(v is None for v in values):
        return pa.array(values, kind)
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, values), np.int32, len(values)), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(values)), pa.int32()))


def parsed(rows: DataFrame, names: list[str] | None, addresses: list[str] | None) -> DataFrame:
    """rows with the parts of their columns `name` and `address` instead of these; written. names, addresses: common words."""
    fields = (NAME_FIELDS if names is not None else {}) | (ADDRESS_FIELDS if addresses is not None else {})
    kept = [c for c in rows.columns if c not in ("name", "address")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names is not None:
            name_words = Words(names)
            of_name = lru_cache(10_000)(lambda v: parse_name(name_words, v))
        if addresses is not None:
            address_words = Words(addresses)
            of_address = lru_cache(10_000)(lambda v, c: parse_address(address_words, v, c))
        no_name = (None,) * len(NAME_FIELDS)
        for b in batches:
            out = [()] * b.num_rows
            if names is not None:
                out = [no_name if v is None else of_name(v) for v in b.column("name").to_pylist()]
            if addresses is not None:
                out = [r + of_address(v, c) for r, v, c in zip(out, b.column("address").to_pylist(), b.column("country").to_pylist())]
            own = [_column(list(x), t) for x, t in zip(zip(*out), fields.values())] if out else [pa.array([], t) for t in fields.values()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *own], names=[*kept, *fields])

    ddl = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{k} {_DDL[t]}" for k, t in fields.items()]
    return cut(rows.mapInArrow(run, ", ".join(ddl)))
