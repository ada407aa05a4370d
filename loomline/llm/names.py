"""Variant spellings of names: parse, join within a metric space, and group."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.components import contract
from loomline.llm.lookalike import plain
from loomline.runtime import materialize, pairs_within

# English given names and their short forms.
GIVEN = """alexander alex al sandy|andrew andy drew|anthony tony|benjamin ben benny|christopher chris kit|daniel dan danny|deborah deb debbie
edward ed eddie ted ned|elizabeth liz beth betty eliza lizzie|james jim jimmy jamie|jennifer jen jenny|joseph joe joey
katherine kate kathy katie kat|margaret meg maggie peggy marge|matthew matt|michael mike mick mickey|nicholas nick nicky|patricia pat patty trish tricia
rebecca becky becca|richard rick dick rich ricky|robert bob bobby rob robbie bert|samuel sam sammy|susan sue susie|thomas tom tommy
victoria vicky vicki tori|william bill billy will willie liam|charles charlie chuck|david dave|john jack johnny|george|henry harry hank
sarah sally|steven steve|timothy tim|gregory greg|jonathan jon|lawrence larry|philip phil|ronald ron|stephanie steph|theodore theo|catherine cathy|peter pete"""
# Company forms, titles, and short forms of lines of business.
LEGAL = set("co company corp corporation inc incorporated ltd limited plc sa ag gmbh llc lp nv bv se spa srl".split())
TITLES = set("dr prof mr mrs ms sir phd mp jr sr md esq ii iii".split())
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12"}
HAN_LEGAL = re.compile("(?:股份有限公司|有限责任公司|有限公司|集团|公司|株式会社)+$")
LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ı": "i", "ð": "d", "þ": "th"})

LONG = 40  # names beyond are compared one by one
FULL = {w: g.split()[0] for line in GIVEN.split("\n") for g in line.split("|") for w in g.split()}
FORMAL = {f: frozenset(f) for f in sorted(set(FULL.values()))}
RADIUS = 2
ENDS = 2000


def edits(a: str, b: str, most: int) -> int:
    """Damerau's distance: insertions, deletions, substitutions and swaps, also of letters between which something was
    inserted or deleted, so that it is a true metric; most + 1 if more are needed."""
    far = most + 1
    if abs(len(a) - len(b)) > most:
        return far
    rows = [{j: j for j in range(min(len(b), most) + 1)}]  # the last four rows, each a band of the table
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(rows[-1].get(j, far) + 1, row.get(j - 1, far) + 1, rows[-1].get(j - 1, far) + (x != b[j - 1]))
            for k, l in ((2, 2), (3, 2), (2, 3)):  # a swap, and one across a letter deleted or inserted
                if i >= k and j >= l and x == b[j - l] and a[i - k] == b[j - 1]:
                    d = min(d, rows[-k].get(j - l, far) + k + l - 3)
            row[j] = min(d, far)
        rows = [*rows[-3:], row]
    return min(rows[-1].get(len(b), far), far)


@lru_cache(maxsize=1 << 16)
def given(word: str) -> str | None:
    """The formal given name of a word: a short form, or a typing error in one."""
    if word in FULL:
        return FULL[word]
    if len(word) < 4:
        return None
    own = frozenset(word)
    near = [f for f, held in FORMAL.items() if abs(len(f) - len(word)) <= 2 and len(own ^ held) <= 4]  # an edit changes two letters of a set at most
    close = [(d, f) for f in near if (d := edits(word, f, 2)) <= (1 if len(f) < 6 else 2)]
    return min(close)[1] if close else None


def letters(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().translate(LETTERS)) if not unicodedata.combining(c))


class Lines(NamedTuple):
    """What the corpus shows of names of organisations: last words that many of them share, and short forms of such."""

    ends: frozenset[str] = frozenset()
    short: dict[str, str] = {}


def words_of(name: str) -> tuple[str, list[str], bool, bool]:
    """(plain name, words without edge marks and company forms, whether it held a company form, whether a hyphen joined words)."""
    s = plain(name).strip()
    s = re.sub(r"(?<=[^\W\d_])\.(?=[^\W\d_]\.)", "", s)  # S.A. is one word
    s = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", s) if not re.search(r"\bM[a]?c[A-Z]", s) else s
    front, comma, back = (x.strip() for x in s.partition(","))
    if comma and back and letters(back).strip(". ") not in LEGAL and letters(back).strip(". ") not in TITLES:
        s = back + " " + front
    words = [w for w in re.split(r"[\s,'’\"()/]+", letters(re.sub(r"(?<=\w)-(?=\w)", " - ", s))) if w]
    dash = "-" in words
    words = [w.strip(".") if not re.fullmatch(r"\d+\.0", w) else w[:-2] for w in words]
    words = [w for w in words if w and w != "-"]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    legal = len(words) > 1 and words[-1] in LEGAL
    while len(words) > 1 and words[-1] in LEGAL:
        words = words[:-1]
    return s, words, legal, dash


def name_ends(name: str) -> list[tuple[str, str]]:
    """(end, first word): the last word and the last two words of a name that holds no given name, initial, number or Chinese character."""
    _, words, _, _ = words_of(name)
    if len(words) < 2 or re.search(r"[㐀-鿿぀-ヿ]", name) or any(len(w) < 2 or w.isdigit() or w in ROMAN or w in TITLES or given(w) for w in words):
        return []
    return [(" ".join(words[-k:]), words[0]) for k in (1, 2) if len(words) > k]


def acronym(s: str) -> str | None:
    """The letters of a name that is one word of capitals, single small letters between them at most."""
    tight = s.replace(".", "").replace("-", "")
    low = sum(c.islower() for c in tight)
    if tight.isalpha() and 4 <= len(tight) <= 12 and len(tight) - low >= 3 * max(low, 1) and not re.search(r"[^\W\d_A-Z][^\W\d_A-Z]", letters_kept(tight)):
        return letters(tight)
    return None


def letters_kept(text: str) -> str:
    """Letters without accents, in their case."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def parse(name: str, lines: Lines = Lines()) -> tuple[str, str, str]:
    """(kind, head, tail): what a name names. Equal triples are spellings of one name but for typing errors.

    Kinds: pers (surname, given name or one initial), prod (line, number), inst (place, field), univ
    (place, ""), org (brand, line of business), pair (two brands, line of business), han (name without company form,
    ""), acr (letters of an acronym, ""). Which words are lines of business, and their short forms, the corpus says.
    """
    s = plain(name).strip()
    if re.search(r"[㐀-鿿぀-ヿ]", s):
        return "han", HAN_LEGAL.sub("", re.sub(r"\s+", "", s)) or s, ""
    if short := acronym(s):
        return "acr", short, ""
    comma = "," in s
    s, words, legal, dash = words_of(name)
    if not words:
        return "org", letters(s) or s, ""
    if any(w in ("university", "univ", "uni") for w in words) or (words[0] == "u" and len(words) > 2 and words[1] == "of"):
        rest = [w for w in words if w not in ("university", "univ", "uni", "of", "u")]
        return "univ", " ".join(rest), ""
    if any(w in ("institute", "inst") for w in words):
        at = next(i for i, w in enumerate(words) if w in ("institute", "inst"))
        rest = [w for w in words if w not in ("institute", "inst", "of", "for")]
        if len(rest) > 1:
            return ("inst", rest[-1], " ".join(rest[:-1])) if at == 0 else ("inst", rest[0], " ".join(rest[1:]))
    people = [w for w in words if w not in TITLES]
    if not legal and 2 <= len(people) <= 3 and (len(people) == 2 or len(people[1]) == 1):
        a, b = people[0], people[-1]
        number = b.isdigit() or (b in ROMAN and len(words) == 2 and not comma and not s.rstrip().endswith("."))
        if not number:
            if len(a) == 1 or len(b) == 1:
                x, y = (a, b) if len(a) == 1 else (b, a)
                if len(y) > 1 and x.isalpha():
                    return "pers", y, x
            for x, y in ((a, b), (b, a)):
                if x in FULL:
                    return "pers", y, FULL[x]
            if b not in lines.ends and b not in lines.short:
                for x, y in ((a, b), (b, a)):
                    if f := given(x):
                        return "pers", y, f
    if m := re.fullmatch(r"([^\W\d_]{3,})(\d+)", words[-1]):
        words = [*words[:-1], m[1], m[2]]
    if len(words) > 1 and (words[-1].isdigit() or words[-1] in ROMAN):
        line = [w for w in words[:-1] if w != "mk"]
        if line:
            return "prod", " ".join(line), ROMAN.get(words[-1], words[-1].lstrip("0") or "0")
    words = [lines.short.get(w, w) if i else w for i, w in enumerate(words)]
    tail = 2 if " ".join(words[-2:]) in lines.ends and len(words) > 2 else 1
    if len(words) > tail and " ".join(words[-tail:]) in lines.ends and len(words) - tail == 2:
        return "pair", " ".join(sorted(words[:2])), " ".join(words[2:])
    if len(words) > 2 and dash and words[-1] not in lines.ends:
        return "pair", " ".join(sorted(words[:2])), " ".join(words[2:])
    if len(words) > 1 and words[0] in lines.ends and words[-1] not in lines.ends:
        words = [words[-1], *words[:-1]]
    return "org", words[0], " ".join(words[1:])


def is_short_of(a: str, b: str) -> bool:
    """Whether a is written with letters of b in their order, from its first, and is shorter."""
    at = iter(b)
    return 2 <= len(a) < len(b) and a[0] == b[0] and all(c in at for c in a)


def lines_of_business(rows: DataFrame) -> Lines:
    """Ends that follow three different first words or more and at least 1 in ENDS of all ends: 2 * ENDS words at most.

    Of two such words one of which is written with the other's letters, both following at least a fifth of
    the rarer one's first words, the rarer is a form of the commoner. Both rules are shares, alike at every size.
    """

    def run(batches):
        for batch in batches:
            got = [e for n in batch.column(0).to_pylist() if n and n.strip() for e in name_ends(n)]
            cols = list(zip(*got)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["w", "head"])

    pairs = materialize(rows.select("name").mapInArrow(run, "w string, head string").distinct(), "ends")
    counts = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    least = max(3, -(-pairs.filter("w not like '% %'").count() // ENDS))
    ends = counts.filter(F.col("n") >= least)
    kept = materialize(pairs.join(ends.filter("w not like '% %'"), "w"), "kept")
    # every head holds at most as many ends as there are, 2 * ENDS
    both = kept.alias("x").join(kept.alias("y"), (F.col("x.head") == F.col("y.head")) & (F.substring("x.w", 1, 1) == F.substring("y.w", 1, 1)) & (F.length("x.w") < F.length("y.w")))
    both = both.groupBy(F.col("x.w").alias("a"), F.col("y.w").alias("b")).agg(F.count(F.lit(1)).alias("m"), F.min("x.n").alias("na"), F.min("y.n").alias("nb"))
    short: dict[str, str] = {}
    near = both.filter("m >= 2 and 5 * m >= least(na, nb)").collect()  # pairs of ends
    for r in sorted(near, key=lambda r: (-r.m, r.a, r.b)):
        if is_short_of(r.a, r.b):
            few, many = (r.a, r.b) if r.na <= r.nb else (r.b, r.a)
            short.setdefault(few, many)
    for w in list(short):  # chains end at their last word
        seen = {w}
        while short[w] in short and short[w] not in seen:
            seen.add(short[w])
            short[w] = short[short[w]]
    return Lines(frozenset(r.w for r in ends.select("w").collect()) - set(short), short)


def edit_distances(a: list[str], b: list[str], most: int) -> np.ndarray:
    """edits() of many pairs at once, over a band of the table; the few pairs of long names one by one."""
    n = len(a)
    long = [k for k in range(n) if len(a[k]) > LONG or len(b[k]) > LONG]
    if long:
        out = np.zeros(n, np.int8)
        rest = sorted(set(range(n)) - set(long))
        out[rest] = edit_distances([a[k] for k in rest], [b[k] for k in rest], most) if rest else 0
        out[long] = [edits(a[k], b[k], most) for k in long]
        return out
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    width = int(max(la.max(initial=0), lb.max(initial=0)))
    code = lambda xs: np.array([x.ljust(width, "\0") for x in xs], f"<U{max(width, 1)}").view(np.uint32).reshape(n, -1)
    x, y = code(a), code(b)
    far = np.int8(most + 1)
    rows = [np.full((width + 1, n), far, np.int8) for _ in range(4)]
    rows[0][: most + 1] = np.arange(most + 1, dtype=np.int8)[:, None]
    out = np.full(n, far, np.int8)
    empty = (la == 0) | (lb == 0)
    out[empty] = np.minimum(la + lb, most + 1)[empty]
    for i in range(1, width + 1):
        row, last = rows[i % 4], rows[(i - 1) % 4]
        row[:] = far
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(width, i + most) + 1):
            d = np.minimum(np.minimum(last[j], row[j - 1]) + np.int8(1), last[j - 1] + (x[:, i - 1] != y[:, j - 1]))
            for k, l in ((2, 2), (3, 2), (2, 3)):
                if i >= k and j >= l:
                    swap = (x[:, i - 1] == y[:, j - l]) & (x[:, i - k] == y[:, j - 1])
                    d = np.where(swap, np.minimum(d, rows[(i - k) % 4][j - l] + np.int8(k + l - 3)), d)
            row[j] = np.minimum(d, far)
            ends = (la == i) & (lb == j)
            out[ends] = row[j][ends]
    return out


def ball_keys(names: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, key): hashes of all strings that up to `most` deletions leave of each name of LONG letters or fewer."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    of, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(size[(size > 0) & (size <= LONG)]).tolist():
        at = np.flatnonzero(size == n)
        code = np.array([names[k] for k in at], f"<U{n}").view(np.uint32).reshape(len(at), n).astype(np.uint64)
        power = np.array([pow(base, k, 1 << 64) for k in range(n)], np.uint64)
        upto = np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum((code + np.uint64(1)) * power, axis=1, dtype=np.uint64)], axis=1)
        one, two = np.uint64(inverse), np.uint64(inverse * inverse % (1 << 64))
        found = [upto[:, n:]]
        if most >= 1:
            found.append(upto[:, :-1] + one * (upto[:, n:] - upto[:, 1:]))
        if most >= 2 and n >= 2:
            i, j = np.triu_indices(n, 1)
            found.append(upto[:, i] + one * (upto[:, j] - upto[:, i + 1]) + two * (upto[:, n:] - upto[:, j + 1]))
        key = np.concatenate(found, axis=1)
        of.append(np.repeat(at, key.shape[1]))
        keys.append(key.ravel())
    return np.concatenate(of), np.concatenate(keys)


def projections(name: str) -> list[int]:
    """Hashes of the name's letters of each of five classes of letters, in their order: two edits touch four classes at most."""
    return [crc32(f"{k} {''.join(c for c in name if ord(c) % 5 == k)}".encode()) | k << 33 for k in range(5)]


def radius_join(names: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(space, a, b, d): pairs of different names of one space at most `radius` (2 or less) edits apart, a < b, each once.

    `names` holds (space, name). Pivots are all strings that up to `radius` deletions leave of some name. A
    name is replicated into the ball of every pivot that it reaches by deletions: an edit costs either
    name at most one deletion, or two edits two, so two near names meet in a ball, and by the
    triangle inequality whatever meets is at most 2 * radius apart. A ball holds a
    pivot's extensions by at most `radius` letters, so no cell grows with the corpus, and cells are as many as
    names: work is linear. Within a cell the edit metric itself decides. Names beyond LONG letters
    meet under their letters of one class of five instead, of which two edits leave one untouched.
    Null and empty names are left out.
    """
    names = materialize(names.filter("name <> ''").distinct().withColumn("rid", F.monotonically_increasing_id()), "names")

    def balls(batches):
        for whole in batches:
            for batch in (whole.slice(k, 4000) for k in range(0, whole.num_rows, 4000)):
                space, name, rid = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                salt = np.fromiter((crc32((s or "").encode()) for s in space), np.uint64, len(space)) << np.uint64(32)
                of, key = ball_keys(name, radius)
                far = [(k, p) for k, x in enumerate(name) if len(x) > LONG - 2 * radius for p in projections(x)]
                of = np.r_[of, np.array([k for k, _ in far], np.int64)]
                key = np.r_[key, np.array([p for _, p in far], np.uint64)] ^ salt[of]
                order = np.lexsort((of, key))
                of, key = of[order], key[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])] if len(key) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(rid[of[new]])], names=["key", "rid"])

    cell = names.select("space", "name", "rid").mapInArrow(balls, "key long, rid long")
    def meet(key: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
        """The pairs of names of each run of equal keys, each once."""
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        found = [np.zeros((0, 2), np.int64)]
        for m in np.unique(size[size > 1]).tolist():
            at = start[size == m]
            for i in range(m - 1):  # each name with those after it
                x, y = np.repeat(rid[at + i], m - 1 - i), rid[at[:, None] + np.arange(i + 1, m)].ravel()
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def runs(batches):
        key = rid = np.zeros(0, np.int64)
        for batch in batches:
            key, rid = np.r_[key, batch.column(0).to_numpy()], np.r_[rid, batch.column(1).to_numpy()]
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            yield meet(key[:cut], rid[:cut]) if cut else meet(key[:0], rid[:0])
            key, rid = key[cut:], rid[cut:]
        yield meet(key, rid)

    # sorted by key, a partition is read as runs: most balls hold one name and cost nothing more
    pairs = cell.repartition("key").sortWithinPartitions("key").mapInArrow(runs, "a long, b long").distinct()
    one, two = (names.select(F.col("rid").alias(r), F.col("space").alias("space" + r), F.col("name").alias("n" + r)) for r in "ab")
    pairs = pairs.join(one, "a").join(two, "b").filter("spacea = spaceb").select(F.col("spacea").alias("space"), "na", "nb")

    def measure(batches):
        for batch in batches:
            x, y = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            d = edit_distances(x, y, radius)
            keep = np.flatnonzero(d <= radius)
            first = [min(x[k], y[k]) for k in keep]
            last = [max(x[k], y[k]) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(d[keep].astype(np.int32))], names=["space", "a", "b", "d"])

    return pairs.mapInArrow(measure, "space string, a string, b string, d int")


def parsed(rows: DataFrame, lines: Lines) -> DataFrame:
    """(key, kind, head, tail) of (key, name); rows without a key or a name that holds a letter or digit are left out."""

    def run(batches):
        for batch in batches:
            keys, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = [(k, *parse(n, lines)) for k, n in zip(keys, names) if k is not None and n and n.strip()]
            got = [g for g in got if g[2]]
            cols = list(zip(*got)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "kind", "head", "tail"])

    return rows.select("key", "name").mapInArrow(run, "key string, kind string, head string, tail string")


def link_names(rows: DataFrame, given_links: DataFrame) -> DataFrame:
    """(key, groupId): the group of every row of (key, name) that is linked to another; given_links holds (a, b) of keys.

    Rows with equal parsed names are one node. Nodes are linked if their tails agree and their heads lie
    within one edit (four letters or more) or two (six or more), whatever else the table holds and
    however many rows hold them. Chinese and Japanese names are linked by equal parsed names alone. Initials, names without a line of business and
    acronyms then join the one group that they fit; if they fit several they stay alone.
    """
    rows = materialize(parsed(rows, lines_of_business(rows)), "parsed")
    node = F.concat_ws("|", "kind", "head", "tail")
    nodes = materialize(rows.select("kind", "head", "tail").distinct().withColumn("node", node), "nodes")
    space = F.when(F.col("kind") == "pers", F.concat(F.lit("pers:"), F.substring("tail", 1, 1))).otherwise(F.col("kind"))
    heads = nodes.filter("kind in ('pers', 'prod', 'inst', 'univ', 'org', 'pair') and length(head) >= 4")
    near = radius_join(heads.select(space.alias("space"), F.col("head").alias("name")))
    shortest = F.least(F.length("a"), F.length("b"))
    near = materialize(near.filter((F.col("d") == 1) | (shortest >= 6)).select("space", "a", "b", "d"), "near")
    x = nodes.select(space.alias("space"), F.col("head").alias("a"), "tail", F.col("node").alias("na"))
    y = nodes.select(space.alias("space"), F.col("head").alias("b"), "tail", F.col("node").alias("nb"))
    typed = near.join(x, ["space", "a"]).join(y, ["space", "b", "tail"]).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    of = rows.select("key", node.alias("node"))
    known = given_links.join(of.select(F.col("key").alias("a"), F.col("node").alias("na")), "a").join(of.select(F.col("key").alias("b"), F.col("node").alias("nb")), "b")
    group = contract(typed.unionByName(known.select(F.col("na").alias("a"), F.col("nb").alias("b"))))
    placed = nodes.join(group.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    # what fits one group alone
    near = near.select("space", "a", "b")
    both = near.unionByName(near.select("space", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(heads.select(space.alias("space"), F.col("head").alias("a"), F.col("head").alias("b")).distinct())
    wild = placed.filter("(kind = 'pers' and length(tail) = 1) or (kind = 'org' and tail = '')").select(space.alias("space"), F.col("head").alias("a"), F.col("tail").alias("t"), F.col("component").alias("w"))
    full = placed.filter("(kind = 'pers' and length(tail) > 1) or (kind = 'org' and tail <> '')").select(space.alias("space"), F.col("head").alias("b"), "tail", F.col("component").alias("c"))
    fits = wild.join(both, ["space", "a"]).join(full, ["space", "b"]).filter((F.col("t") == "") | F.col("tail").startswith(F.col("t")))
    fits = fits.withColumn("exact", F.col("a") == F.col("b")).select("w", "c", "exact")
    # an acronym begins with the initials of a long name and ends in two of the first three letters of one of its words
    of_words = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.substring(w, 1, 1)), "")
    h = F.split("head", " ")
    orders = F.when(F.col("kind") == "inst", F.array(F.concat("head", F.lit(" institute of")))).otherwise(F.array("head", F.concat_ws(" ", F.reverse(h))))
    tails = F.array(F.col("tail"), F.split("tail", " ")[0])
    long = placed.filter("kind in ('inst', 'pair') and tail <> ''").select(F.col("component").alias("c"), h.alias("h"), F.explode(orders).alias("o"), tails.alias("tails"))
    long = long.select("c", "h", F.explode("tails").alias("t"), "o").select("c", of_words(F.concat_ws(" ", "o", "t")).alias("i"), F.explode("h").alias("w"))
    long = long.select("c", "i", F.explode(F.array(F.substring("w", 1, 2), F.substring("w", 2, 2))).alias("e")).filter("length(i) >= 3").distinct()
    short = placed.filter("kind = 'acr'").select(F.col("component").alias("w"), "head", F.explode(F.sequence(F.lit(3), F.length("head") - 2)).alias("k"))
    short = short.filter("k >= 3").select("w", "k", F.expr("substring(head, 1, k)").alias("i"), F.expr("substring(head, -2)").alias("e"))
    hits = short.join(long, ["i", "e"]).groupBy("w", "k").agg(F.count_distinct("c").alias("n"), F.min("c").alias("c"))
    hits = hits.groupBy("w").agg(F.max(F.struct("k", "n", "c")).alias("m")).filter("m.n = 1").select("w", F.col("m.c").alias("c"))
    fits = fits.unionByName(hits.withColumn("exact", F.lit(True)))
    best = fits.filter("w <> c").groupBy("w").agg(F.count_distinct(F.when(F.col("exact"), F.col("c"))).alias("m"), F.min(F.when(F.col("exact"), F.col("c"))).alias("e"), F.count_distinct("c").alias("k"), F.min("c").alias("c"))
    one = best.select("w", F.when(F.col("m") == 1, F.col("e")).when((F.col("m") == 0) & (F.col("k") == 1), F.col("c")).alias("c")).filter("c is not null")
    last = contract(one.select(F.col("w").alias("a"), F.col("c").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    placed = placed.join(last, "component", "left").select("node", F.coalesce("whole", "component").alias("c"))
    out = materialize(of.join(placed, "node").select("key", "c"), "linked")
    least = out.groupBy("c").agg(F.min("key").alias("groupId"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return out.join(least, "c").select("key", "groupId")


def variant_groups(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, groupId): each row of entities and aliases that names the same as another, with the least key of its group.

    A row's text is its name, or else its normal form; rows without either take part through entityId
    alone if a row of that id has a name. Repeated ids count once.
    """
    e = entities.select(F.col("id").alias("key"), F.coalesce("name", "normalized").alias("name"))
    a = aliases.select(F.col("id").alias("key"), F.coalesce("aliasName", "aliasNormalized").alias("name"))
    rows = e.unionByName(a).groupBy("key").agg(F.min("name").alias("name"))
    links = aliases.select(F.col("id").alias("a"), F.col("entityId").alias("b")).filter("b is not null").distinct()
    return link_names(rows, links)


def variant_pairs(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(keyA, keyB): each pair of different rows of variant_groups, keyA < keyB. A large group's pairs are made in many tasks."""
    return pairs_within(materialize(variant_groups(entities, aliases), "groups"), "groupId", "key").select(F.col("a").alias("keyA"), F.col("b").alias("keyB"))
