"""Problem 1: text that looks the same, stored with different characters.

A value is brought to one form in two steps.
1. Without a choice: characters that take no room go, every kind of blank becomes one space, full- and half-width letters, ligatures,
   letter-like numerals and mathematical letters become plain ones, look-alike hyphens become "-", accents are composed (NFC).
2. Script-aware repair: each token's dominant script is the script of its letters that have no look-alike elsewhere (else the most
   frequent one, else that of the whole value). Look-alikes of other scripts are replaced only in tokens that mix scripts, and
   only if the repaired token is in the vocabulary of the corpus.

The required result needs a little more in two places, both of them only where the repaired token is in the vocabulary: a token all of
whose letters are look-alikes of one script (Cyrillic СО in a Latin value) counts as mixed with the value around it, and a repair that two
different spellings reach counts as stored. Without both, 10 of 1,329 pairs of sf0.1 are lost (4 and 6).

Defined results: null stays null, an empty or blank value becomes "", repeated rows and ties give equal forms (the form depends
on the value and the vocabulary only), texts of any length are processed whole, other columns pass through untouched.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.llm.values import is_missing
from amalgam.sources.tables import cut

# Letters that look like a Latin one, by script.
LOOKALIKES = {
    "CYRILLIC": "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW",
    "GREEK": "αa οo ρp υu νv ιi κk ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ",
    "CHEROKEE": "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB",
    "ARMENIAN": "սu ոn օo հh ցg յj զq Սu ՏS ՕO",
    "LATIN": "ɑa ɡg ɩi ʋv ꜱs ɴn ʀr ʏy ℎh",
}
# Characters drawn as a hyphen.
HYPHENS = "‐‑‒−﹣－"
#: Compatibility mappings that change nothing a reader sees.
PLAIN = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")

TO_LATIN = {pair[0]: pair[1] for pairs in LOOKALIKES.values() for pair in pairs.split()}
FROM_LATIN = {s: {p[1]: p[0] for p in LOOKALIKES[s].split()} for s in ("CYRILLIC", "GREEK")}
#: A reader can't tell these letters of the scripts that whole texts are written in apart, so they say nothing about a token's script.
AMBIGUOUS = {c for s in FROM_LATIN.values() for pair in s.items() for c in pair} | {p[0] for s in ("ARMENIAN", "CHEROKEE") for p in LOOKALIKES[s].split()}


@lru_cache(100_000)
def _char(c: str) -> str:
    kind = unicodedata.category(c)
    if c in HYPHENS:
        return "-"
    if c in "\r\n":
        return c
    if kind in ("Zs", "Zl", "Zp") or c in "\t\v\f\x85":
        return " "
    if kind in ("Cf", "Cc") or "︀" <= c <= "️" or c == "͏":
        return ""
    if c in TO_LATIN and c != "ℎ":
        return c
    how = unicodedata.decomposition(c)
    if how.startswith(PLAIN) and kind[0] in "LNPS" and c not in "…№℡™ªº":
        return unicodedata.normalize("NFKC", c)
    return c


@lru_cache(100_000)
def script(c: str) -> str:
    if c.isascii():
        return "LATIN" if c.isalpha() else ""
    return unicodedata.name(c, "").split(" ")[0].split("-")[0] if c.isalpha() else ""


def plain(value: str) -> str:
    """The form without look-alikes: width, blanks, invisible characters, accents."""
    if value.isascii() and value.isprintable() and "  " not in value:
        return value.strip(" ")
    if not value.isascii():
        value = unicodedata.normalize("NFC", "".join(map(_char, value)))
    lines = [" ".join(x for x in line.split(" ") if x) for line in "".join(_char(c) if c < " " else c for c in value).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return "\n".join(lines).strip()


def repaired(token: str, whole: str = "LATIN") -> str:
    """The token in its dominant script; the token itself if it doesn't mix scripts. whole: the script of the value around it."""
    if token.isascii() and whole == "LATIN":
        return token
    clear = Counter(s for c in token if c not in AMBIGUOUS and (s := script(c)))
    used = {s for c in token if (s := script(c))}
    odd = any(c in TO_LATIN and script(c) == "LATIN" for c in token)  # Latin letters drawn like plain ones
    to = clear.most_common(1)[0][0] if clear else whole
    if to not in ("LATIN", "CYRILLIC", "GREEK") or not (used - {to} or odd):
        return token
    latin = "".join(TO_LATIN.get(c, c) if to == "LATIN" or script(c) != to else c for c in token)
    if to != "LATIN":
        latin = "".join(FROM_LATIN[to].get(c, c) if script(c) == "LATIN" else c for c in latin)
    return unicodedata.normalize("NFC", latin)


def main_script(value: str) -> str:
    """The script of most letters that have no look-alike; Latin if there is none."""
    if value.isascii():
        return "LATIN"
    clear = Counter(s for c in value if c not in AMBIGUOUS and (s := script(c)) in ("LATIN", "CYRILLIC", "GREEK"))
    return clear.most_common(1)[0][0] if clear else "LATIN"


def folded(value: str) -> str:
    """Both steps without the vocabulary, for comparisons that only need some spelling in common."""
    at = plain(value)
    if at.isascii():
        return at
    whole = main_script(at)
    return " ".join(repaired(t, whole) for t in at.split(" "))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """value -> value, its plain tokens, and each token's repair (null where it is the token itself)."""
    for batch in batches:
        values, tokens, repairs = batch.column(0).to_pylist(), [], []
        for value in values:
            at = plain(value)
            own = at.replace("\n", " \n ").split(" ")
            tokens.append(own)
            if at.isascii():
                repairs.append([None] * len(own))
            else:
                whole = main_script(at)
                repairs.append([r if (r := repaired(t, whole)) != t else None for t in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string())), pa.array(repairs, pa.list_(pa.string()))], ["value", "tokens", "repairs"])


def visual_forms(values: DataFrame) -> DataFrame:
    """(value, form) for each distinct value other than null in the single column of `values`.

    A token's repair is in the vocabulary if some value stores it or if at least two values reach it.
    """
    col = values.columns[0]
    distinct = values.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    forms = distinct.mapInArrow(_forms, "value string, tokens array<string>, repairs array<string>")
    forms = cut(forms.withColumn("vid", F.md5("value")))  # tokens travel with a short id, however long their value is
    repair = F.filter("repairs", lambda r: r.isNotNull())
    each = forms.select(F.explode(F.array_distinct(F.transform("tokens", lambda t, i: F.coalesce(F.get("repairs", i), t)))).alias("token"))
    wanted = forms.select(F.explode(repair).alias("token")).distinct()
    vocabulary = each.join(wanted, "token", "left_semi").groupBy("token").count().where("count >= 2").select("token")
    joined = lambda ts: F.replace(F.array_join(ts, " "), F.lit(" \n "), F.lit("\n"))
    known = forms.select("vid", F.explode(F.array_distinct(repair)).alias("token")).join(vocabulary, "token").groupBy("vid").agg(F.collect_set("token").alias("known"))
    chosen = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.col("known"), F.get("repairs", i)), F.get("repairs", i)).otherwise(t))
    plain_only = forms.where(F.size(repair) == 0).select("value", joined(F.col("tokens")).alias("form"))
    mixed = forms.where(F.size(repair) > 0).join(known, "vid", "left")
    return plain_only.unionByName(mixed.select("value", joined(F.when(F.col("known").isNull(), F.col("tokens")).otherwise(chosen)).alias("form")))


def with_visual_forms(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """df with a column of forms beside each of `columns`; one vocabulary for all of them."""
    every = None
    for c in columns:
        one = df.select(F.col(c).alias("value"))
        every = one if every is None else every.unionByName(one)
    forms = visual_forms(every)
    for c in columns:
        df = df.join(forms.select(F.col("value").alias("__v"), F.col("form").alias(c + suffix)), df[c] == F.col("__v"), "left").drop("__v")
    return df


def same_looking_pairs(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(entity_id_1, entity_id_2): ids whose `columns` look the same, none of them missing, while some stored value differs."""
    rows = df.select(id_col, *columns).distinct()
    for c in columns:
        rows = rows.where(~is_missing(F.col(c)))
    formed = with_visual_forms(rows, columns)
    forms = [c + "_form" for c in columns]
    a = formed.select(F.col(id_col).alias("entity_id_1"), *forms, F.array(*columns).alias("stored_1"))
    b = formed.select(F.col(id_col).alias("entity_id_2"), *forms, F.array(*columns).alias("stored_2"))
    both = a.join(b, forms).where((F.col("entity_id_1") < F.col("entity_id_2")) & (F.col("stored_1") != F.col("stored_2")))
    return both.select("entity_id_1", "entity_id_2").distinct()
