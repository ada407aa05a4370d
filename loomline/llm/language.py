"""Languages of texts and of the parts of mixed texts: nearest centroids over TF-IDF n-gram vectors."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "de", "fr", "es", "pt", "zh", "ja")
# Three-letter codes of the seven languages.
CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "zho": "zh", "chi": "zh", "cmn": "zh", "jpn": "ja", "jp": "ja"}
#: Labelled texts that a model is fitted on, at most about this many.
SAMPLE = 20_000
CENTROIDS = 4  # clustered centroids of a language
SWITCH = 4.0  # log odds that a change of language within a text must win
AT_MARK = 2.0  # the same where a mark such as a dash or bracket stands
FAR = 0.04  # a part whose cosine with every centroid is below this belongs to no language
STRANGE = 2.0  # weight of an n-gram that the sample doesn't hold: it lengthens a text's vector and nears it to nothing
CAP = 2.5  # the most that one token says
FEW = 3  # a part of fewer words beside others must be of words that the clean samples hold

MARKS = "|/–—()（）[]:：-"
TOKEN = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾝ]|[㐀-鿿]|[^\W\d_㐀-鿿぀-ヿ]+|[|/–—()（）\[\]:：]|(?<= )-(?= )")
WIDE = re.compile(r"[㐀-鿿぀-ヿㇰ-ㇿｦ-ﾝ]")


def features(token: str, after: str) -> list[str]:
    """n-grams of a token: a word and, unless it is written like a name, its three-letter sequences; a Chinese or
    Japanese character and its pair with the next."""
    if token in MARKS:
        return []
    if WIDE.match(token):
        return [token, token + after] if WIDE.match(after or "") else [token]
    low = token.lower()
    if token[0].isupper() or len(low) < 4:
        return ["=" + low]
    m = f"^{low}$"
    return ["=" + low, *(m[i : i + 3] for i in range(len(m) - 2))]


def grams_of(ts: list[str]) -> list[str]:
    return [f for a, b in zip(ts, [*ts[1:], ""]) for f in features(a, b)]


def split_at_marks(ts: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in ts:
        if t in MARKS:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


class Model:
    """Log odds of features by language, their weights, and the centroids of each language."""

    def __init__(self, samples: list[tuple[str, str]], texts: list[tuple[str, str]]):
        """samples and texts: (language, text). The samples' languages are right. Those of the texts may be wrong in
        part, or the text mixed: what the model fitted so far is sure of counts more than the label."""
        self.clean: dict[str, set[str]] = defaultdict(set)  # the languages whose clean samples hold a word
        for l, x in samples:
            for t in tokens(x):
                self.clean[t.lower()].add(l)
        pieces, labels, whole = [], [], []
        for l, x in texts:
            cut = split_at_marks(tokens(x))
            for c in cut:
                pieces.append(grams_of(c))
                labels.append(LANGS.index(l))
                whole.append(len(cut) == 1)
        self.fit([grams_of(tokens(x)) for _, x in samples] * 3, [LANGS.index(l) for l, _ in samples] * 3)
        for _ in range(3):
            # one of several pieces may be in another language than its title: it must speak for itself
            odds = [self.log_odds(p) for p in pieces]
            said = [(int(np.argmax(o)), float(np.partition(o, -2)[-1] - np.partition(o, -2)[-2])) for o in odds]
            now = [j if margin > 2 else (l if w else -1) for (j, margin), l, w in zip(said, labels, whole)]
            kept = [(p, l) for p, l in zip(pieces, now) if l >= 0] + [(grams_of(tokens(x)), LANGS.index(l)) for l, x in samples] * 3
            self.fit([p for p, _ in kept], [l for _, l in kept])
        self.cluster([p for p, _ in kept], [l for _, l in kept])
        self.memo: dict[tuple[str, str], np.ndarray] = {}

    def fit(self, parts: list[list[str]], labels: list[int]) -> None:
        count: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
        size = np.ones(len(LANGS))
        for fs, l in zip(parts, labels):
            size[l] += 1
            for f in set(fs):
                count[f][l] += 1
        self.odds, self.idf = {}, {}
        n = size.sum()
        for f, c in count.items():
            if c.sum() < 2:
                continue
            share = (c + 0.02) / size  # how much of each language's texts hold it
            share = share / share.sum()
            # a feature that all languages share, as names do, says nothing
            spread = 1 + (share * np.log(share)).sum() / math.log(len(LANGS))
            self.idf[f] = math.log(1 + n / c.sum()) * max(spread, 0.0)
            # against the language that is next to it, damped while it is rare
            trust = c.sum() / (c.sum() + 3)
            self.odds[f] = np.clip(trust * np.log(share * len(LANGS)), -1.5, CAP) * max(spread, 0.0)

    def log_odds(self, fs: list[str]) -> np.ndarray:
        return sum((self.odds[f] / (3 if f[0] != "=" and not WIDE.match(f) else 1) for f in fs if f in self.odds), np.zeros(len(LANGS)))

    def token_row(self, token: str, after: str) -> np.ndarray:
        """Log odds by language, dot products with all centroids, and the squared length of a token's TF-IDF vector."""
        key = (token, after if WIDE.match(token) else "")
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            all_of = features(token, after)
            fs = [f for f in all_of if f in self.column]
            w = np.array([self.idf[f] for f in fs])
            dots = w @ self.centroids[[self.column[f] for f in fs]] if fs else np.zeros(self.centroids.shape[1])
            # words written like names may be unknown: they belong to no language
            strange = 0 if token[0].isupper() else sum(f not in self.idf for f in all_of) / max(1, len(all_of))
            self.memo[key] = got = np.r_[np.clip(self.log_odds(fs), -CAP, CAP), dots, (w * w).sum() + strange * STRANGE**2]
        return got

    def cluster(self, parts: list[list[str]], labels: list[int], rounds: int = 3, most: int = 2000) -> None:
        """Spherical k-means within each language, on `most` texts of the sample."""
        self.column = {f: i for i, f in enumerate(f for f in self.idf if self.idf[f] > 0)}
        weight = np.array([self.idf[f] for f in self.column])
        self.centroids = np.zeros((len(self.column), len(LANGS) * CENTROIDS))
        for l in range(len(LANGS)):
            own = [[self.column[f] for f in p if f in self.column] for p, x in zip(parts, labels) if x == l]
            own = [p for p in own if p]
            own = own[:: max(1, -(-len(own) // most))]
            if not own:
                continue
            x = np.zeros((len(own), len(self.column)), np.float32)
            for i, p in enumerate(own):
                np.add.at(x[i], p, weight[p])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            centres = x[:: max(1, len(own) // CENTROIDS)][:CENTROIDS]
            for _ in range(rounds):
                of = (x @ centres.T).argmax(1)
                centres = np.array([x[of == k].sum(0) if (of == k).any() else centres[k] for k in range(len(centres))])
                centres /= np.linalg.norm(centres, axis=1, keepdims=True)
            self.centroids[:, l * CENTROIDS : l * CENTROIDS + len(centres)] = centres.T

    @staticmethod
    def nearest(rows: np.ndarray) -> np.ndarray:
        """Cosines of summed token rows with the nearest centroid of each language."""
        dots = rows[:, len(LANGS) : -1].reshape(len(rows), len(LANGS), CENTROIDS).max(2)
        return dots / np.sqrt(np.maximum(rows[:, -1:], 1e-12))

    def segments(self, ts: list[str], odds: np.ndarray) -> list[tuple[int, int, int]]:
        """(language, first token, end) of the parts of a text: the cut of the highest log odds less SWITCH for every change."""
        score, back = odds[0].copy(), []
        for t, o in zip(ts[1:], odds[1:]):
            cost = AT_MARK if t in MARKS else SWITCH
            best = int(np.argmax(score))
            come = np.where(score >= score[best] - cost, np.arange(len(LANGS)), best)
            back.append(come)
            score = np.maximum(score, score[best] - cost) + o
        path = [int(np.argmax(score))]
        for come in reversed(back):
            path.append(int(come[path[-1]]))
        path.reverse()
        out, a = [], 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[a]:
                out.append((path[a], a, i))
                a = i
        return out

    def known(self, words: list[str], lang: str) -> bool:
        """Whether clean samples of the language hold every word, and those of no other language one of them."""
        held = [self.clean.get(w, ()) for w in words]
        return bool(held) and all(lang in h for h in held) and any(len(h) == 1 for h in held)

    def judge(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """Of each text its parts (language, confidence, first token, end); a text that is one part isn't cut.

        Log odds propose where a text is cut. What a part is, and whether it is of any language, its vector's nearest
        centroid alone decides: a part too far from all of them, as names and gibberish are, is rejected.
        """
        lists = [tokens(t) if t else [] for t in texts]
        flat = [self.token_row(a, b) for ts in lists for a, b in zip(ts, [*ts[1:], ""])]
        if not flat:
            return [[] for _ in texts]
        rows = np.array(flat)
        odds = rows[:, : len(LANGS)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        full = np.flatnonzero(size)
        first = np.cumsum(size) - size
        total = np.add.reduceat(odds, first[full], axis=0)
        main = total.argmax(1)
        # the most that any stretch could win by another language than the text's main one
        of = np.repeat(np.arange(len(full)), size[full])
        run = np.cumsum(odds - odds[np.arange(len(odds)), main[of]][:, None], axis=0) - of[:, None] * 1e6
        before = np.vstack([np.zeros((1, len(LANGS))), run[:-1]])
        low = np.minimum.accumulate(np.where((np.arange(len(odds)) == first[full][of])[:, None], before - 1e6 * (of > 0)[:, None], before), axis=0)
        mixed = np.maximum.reduceat((run - low).max(1), first[full]) > AT_MARK
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        parts = []
        for k, (i, m, l) in enumerate(zip(full.tolist(), mixed.tolist(), main.tolist())):
            at, n = int(first[i]), int(size[i])
            parts += [(i, x, at + a, at + b) for x, a, b in self.segments(lists[i], odds[at : at + n])] if m else [(i, l, at, at + n)]
        where = np.array([p[2] for p in parts])
        sums = np.add.reduceat(rows, where, axis=0)  # parts follow one another without a gap
        near = self.nearest(sums)
        each = np.arange(len(parts))
        named = near.argmax(1)
        best = near[each, named].copy()
        near[each, named] = -1
        sure = best / np.maximum(best + np.maximum(near.max(1), 0), 1e-12)
        several = np.bincount([p[0] for p in parts], minlength=len(lists))
        for k in np.flatnonzero(best >= FAR).tolist():
            i, _, a, b = parts[k]
            if several[i] > 1 and b - a < 2 * FEW:
                words = [t.lower() for t in lists[i][a - int(first[i]) : b - int(first[i])] if t not in MARKS]
                if len(words) < FEW and not self.known(words, LANGS[named[k]]):
                    continue
            part = (LANGS[named[k]], float(sure[k]), a - int(first[i]), b - int(first[i]))
            if out[i] and out[i][-1][0] == part[0]:  # a cut between parts of one language was none
                part = (part[0], max(part[1], out[i][-1][1]), out[i].pop()[2], part[3])
            out[i].append(part)
        return out


def label_code(label: str | None) -> str | None:
    """The language that a label names: None if missing, a code of two letters if it is one of the seven, else the label."""
    low = re.split(r"[-_]", (label or "").strip().lower())[0]
    return None if low in ("", "und") else CODES.get(low, low)


def fitted(rows: DataFrame, samples: DataFrame, id_col: str, text: str, label: str, most: int = SAMPLE) -> Model:
    """A model of all clean samples and about `most` labelled texts, chosen by a hash of their ids."""
    clean = [(r.lang, r.sample) for r in samples.select("lang", "sample").collect() if r.lang in LANGS and r.sample]
    known = rows.filter(F.length(F.trim(text)) > 0).filter(F.col(label).isNotNull())
    slices = max(1, -(-known.count() // most))
    got = known.filter(F.pmod(F.xxhash64(id_col), F.lit(slices)) == 0).select(label, text).limit(2 * most).collect()
    return Model(sorted(clean), sorted((c, t) for l, t in got if (c := label_code(l)) in LANGS))


def judge_items(items: DataFrame, samples: DataFrame) -> DataFrame:
    """(itemId, field, label, parts) of every non-empty originalTitle and translatedTitle, each item id once.

    label is the language that the item's label names, null if missing. Texts are judged once each,
    however many rows share them.
    """
    one = items.filter("id is not null").groupBy("id").agg(F.min(F.struct("originalTitle", "translatedTitle", "language")).alias("r")).select("id", "r.*")
    model = fitted(items, samples, "id", "originalTitle", "language")
    low = F.lower(F.trim(F.split(F.trim("language"), "[-_]")[0]))
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    label = F.when(~F.coalesce(low, F.lit("")).isin("", "und"), F.coalesce(F.try_element_at(codes, low), low))
    both = one.select("id", label.alias("label"), F.explode(F.array(
        F.struct(F.lit("originalTitle").alias("field"), F.col("originalTitle").alias("text")),
        F.struct(F.lit("translatedTitle").alias("field"), F.col("translatedTitle").alias("text")))).alias("t"))
    both = both.select(F.col("id").alias("itemId"), "label", "t.field", "t.text").filter(F.length(F.trim("text")) > 0)
    # a row is judged where it lies: texts repeat little, and gathering equal ones would move them all
    shipped = both.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        model = shipped.value
        for batch in batches:
            got = model.judge(batch.column(3).to_pylist())
            parts = [[{"lang": l, "confidence": c, "first": a, "end": b} for l, c, a, b in ps] for ps in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(parts, kind)], names=["itemId", "field", "label", "parts"])

    return both.mapInArrow(run, "itemId string, field string, label string, parts array<struct<lang:string,confidence:double,first:int,end:int>>")


def wrong_languages(judged: DataFrame) -> DataFrame:
    """(itemId, field, lang, confidence): one row per language of each title whose label is missing or wrong or that mixes
    languages, and of each translated title that isn't wholly Chinese."""
    langs = F.array_distinct(F.col("parts.lang"))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("label"))
    foreign = (F.size("langs") > 1) | (F.col("langs")[0] != "zh")
    case = judged.withColumn("langs", langs).filter(F.size("langs") > 0).filter(F.when(F.col("field") == "originalTitle", wrong).otherwise(foreign))
    parts = case.select("itemId", "field", F.explode("parts").alias("p"))
    return parts.groupBy("itemId", "field", F.col("p.lang").alias("lang")).agg(F.max("p.confidence").alias("confidence"))
