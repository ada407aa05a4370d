"""Visually identical text in other characters: bring names to one plain form."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import hot_keys, lookup

# Letters of other scripts that look like Latin ones (Unicode's confusables, letters of names only).
CYRILLIC = "аaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwѵvӏlёëїïАAВBЕEКKМMНHОOРPСCТTУYХXІIЈJЅSҺHԚQԜW"
GREEK = "οoαaνvιiρpυuκkηnχxγyωwτtεeσoόóίíάáΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
ARMENIAN = "օoսuհhոnցgզqյjՕOՍUՏSԼL"
CHEROKEE = "ᎠDᎡRᎢTᎪAᎫJᎬEᎩYᎳWᎷMᎻHᏀGᏃZᏌUᏙVᏚSᏞLᏟCᏢPᏦKᏴB"
HYPHENS = "‐‑‒–−﹘﹣－⁃"
TO_LATIN = {s: dict(zip(t[::2], t[1::2])) for s, t in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK), ("ARMENIAN", ARMENIAN), ("CHEROKEE", CHEROKEE))}
FROM_LATIN = {s: {v: k for k, v in t.items()} for s, t in TO_LATIN.items()}
WORD = re.compile(r"[^\W\d_]+(?:[^\W\d_]|[̀-ͯ])*")


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK and so on; kana, Chinese characters and Hangul are one: no look-alikes are taken from them."""
    first = unicodedata.name(ch, "?").split(" ")[0]
    return "CJK" if first in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC") else first


@lru_cache(maxsize=1 << 16)
def plain_char(ch: str) -> str:
    """Ordinary width, plain space and hyphen, no ligature, nothing invisible."""
    if " " < ch < "\x7f" or ch == " ":
        return ch
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.category(ch)
    # ligatures, numerals and styled letters are by rule those that compatibility decomposition turns into letters of an alphabet
    if kind[0] in "LN" and unicodedata.decomposition(ch).startswith(("<compat>", "<font>")):
        out = unicodedata.normalize("NFKC", ch)
        if all(script(c) in ("LATIN", *TO_LATIN) and c.isalpha() or c.isdigit() and c.isascii() for c in out):
            return out
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if kind in ("Cf", "Cc") or ch in "͏ᅟᅠㅤﾠ" or "︀" <= ch <= "️":
        return ""
    if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", ch)
    return ch


def fold(value: str) -> str:
    """The plain form but for words of mixed scripts. Composed again after every step that can open a new composition."""
    if value.isascii() and value.isprintable():
        return value
    out = unicodedata.normalize("NFC", "".join(map(plain_char, unicodedata.normalize("NFC", value))))
    return unicodedata.normalize("NFC", "".join(map(plain_char, out)))


def mixed_words(value: str) -> list[str]:
    return [w for w in WORD.findall(value) if not w.isascii() and len({script(c) for c in w if c.isalpha()}) > 1]


def put(text: str, fix: dict[str, str]) -> str:
    """The text with every whole word of `fix` replaced."""
    return WORD.sub(lambda m: fix.get(m[0], m[0]), text) if fix else text


def repairs(word: str) -> list[str]:
    """The word in one script, each way that look-alikes allow; the dominant script's comes first."""
    count: dict[str, int] = {}
    for c in word:
        if c.isalpha():
            # a letter that could be either says less about the word than one that could not
            alone = c not in TO_LATIN.get(script(c), {}) and not any(c in t for t in FROM_LATIN.values())
            count[script(c)] = count.get(script(c), 0) + (100 if alone else 1)
    out = []
    for target in sorted(count, key=lambda s: (-count[s], s)):
        chars = []
        for c in word:
            s = script(c)
            if s == target or not c.isalpha():
                chars.append(c)
            elif target == "LATIN" and c in TO_LATIN.get(s, {}):
                chars.append(TO_LATIN[s][c])
            elif s == "LATIN" and c in FROM_LATIN.get(target, {}):
                chars.append(FROM_LATIN[target][c])
            elif (latin := TO_LATIN.get(s, {}).get(c)) and latin in FROM_LATIN.get(target, {}):
                chars.append(FROM_LATIN[target][latin])
            else:
                break
        else:
            out.append("".join(chars))
    return out


def plain(value: str, known: set[str] | frozenset[str] = frozenset()) -> str:
    """The plain form: a word of mixed scripts takes the repair that is a known word, else the dominant script's."""
    out, fix = fold(value), {}
    for word in mixed_words(out):
        ways = repairs(word)
        fix[word] = next((w for w in ways if w.lower() in known), ways[0] if ways else word)
    return put(out, fix)


def plain_forms(values: DataFrame, value: str = "value") -> DataFrame:
    """(value, plain, differs) for each distinct non-null value that isn't plain ASCII.

    The vocabulary is that of all given values: words of one script, lower case. Only words of mixed
    scripts are looked up in it, by a shuffle join on the few repairs that they allow. A mixed word
    without a repair stays as it is but counts as differing, being in no one script.
    """
    distinct = values.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    odd = distinct.filter(F.col(value).rlike(r"[^\x20-\x7e]")).select(value)
    shape = "value string, folded string, words array<struct<word:string,ways:array<string>>>"

    def run(batches):
        for batch in batches:
            vs = batch.column(0).to_pylist()
            folded = [fold(v) for v in vs]
            words = [[{"word": w, "ways": repairs(w)} for w in mixed_words(f)] for f in folded]
            kind = pa.list_(pa.struct([("word", pa.string()), ("ways", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.string()), pa.array(folded, pa.string()), pa.array(words, kind)], names=["value", "folded", "words"])

    seen = odd.mapInArrow(run, shape)
    each = seen.filter(F.size("words") > 0).select("value", F.explode("words").alias("w")).select("value", "w.word", F.posexplode_outer("w.ways").alias("place", "way"))
    vocabulary = distinct.select(F.explode(F.split(F.lower(F.col(value)), r"[^\p{L}\p{M}]+")).alias("known")).distinct()
    judged = each.join(vocabulary, F.lower("way") == F.col("known"), "left").withColumn("miss", F.col("known").isNull().cast("int"))
    best = judged.groupBy("value", "word").agg(F.min(F.struct("miss", "place", "way")).alias("b"))
    best = best.groupBy("value").agg(F.collect_list(F.struct("word", F.coalesce("b.way", "word").alias("way"))).alias("fix"))
    done = seen.join(best, "value", "left").withColumn("fix", F.coalesce("fix", F.array().cast("array<struct<word:string,way:string>>")))
    done = done.select("value", "folded", F.map_from_arrays("fix.word", "fix.way").alias("fix"), (F.size("words") > 0).alias("mixed"))

    def repair(batches):
        for batch in batches:
            plain = [put(f, dict(x or ())) for f, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.string()), batch.column(3)], names=["value", "plain", "mixed"])

    repaired = done.mapInArrow(repair, "value string, plain string, mixed boolean")
    return repaired.select("value", "plain", (F.col("mixed") | (F.col("plain") != F.col("value"))).alias("differs"))


def find_odd(rows: DataFrame) -> DataFrame:
    """(field, rowId, value, plain) of each row of (field, rowId, value) whose value isn't in plain form, once each.

    Nulls and empty values are never odd. A value that many rows share is folded once.
    """
    rows = rows.select("field", "rowId", "value")
    forms = plain_forms(rows).filter("differs").select("value", "plain")
    suspects = rows.filter(F.col("value").rlike(r"[^\x20-\x7e]")).distinct()
    hot = hot_keys(suspects.groupBy("value").agg(F.count(F.lit(1)).alias("n"))).join(forms, "value").select("value", "plain")
    return lookup(suspects, "value", forms, hot, "inner")
