"""Text decoded with the wrong encoding: find it, and restore it by a best-first search."""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that UTF-8 is mistaken for.
SINGLE = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp1250")
DOUBLE = ("gb18030", "cp932")
# Signs of ordinary typesetting, which stand between Latin letters.
COMMON = set("–—‘’“”„«»‹›…€£¥©®™•·¿¡°ºª§№№、。，！？：；（）「」『』《》【】・ー％　“”‘’″′→✅")


def byte_of(encoding: str) -> dict[str, int]:
    """Each character that a byte from 128 on stands for; bytes without one stand for the control of their number."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


BYTES = {e: byte_of(e) for e in SINGLE}


def utf8_pattern(encoding: str) -> re.Pattern:
    """UTF-8's sequences of several bytes as a single-byte encoding shows them."""
    chars = {b: re.escape(c) for c, b in BYTES[encoding].items()}
    of = lambda lo, hi: "[" + "".join(chars.get(b, "") for b in range(lo, hi)) + "]"
    # cp1252 and its like show a no-break space where text was cleaned as a space
    more = of(0x80, 0xC0)
    return re.compile(f"(?:{of(0xC2, 0xE0)}{more}|{of(0xE0, 0xF0)}{more}{{2}}|{of(0xF0, 0xF5)}{more}{{3}})+")


PATTERNS = {e: utf8_pattern(e) for e in SINGLE}
#: Two bytes from 128 on shown by a single-byte encoding: without such a pair none of their operations changes a text.
PAIR = re.compile("[" + "".join(re.escape(c) for c in sorted({c for t in BYTES.values() for c in t})) + "]{2}")
MANY = re.compile(r"[^\x00-\x7f]+")
HIGH = re.compile("[\u0080-￿𐀀-\U0010ffff]")


@lru_cache(maxsize=1 << 17)
def single_run(run: str, encoding: str) -> str:
    table = BYTES[encoding]
    try:
        return bytes(table[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return run


def decode_single(text: str, encoding: str) -> str:
    """Read as UTF-8 what `encoding` was mistaken for, wherever that gives whole characters."""
    return PATTERNS[encoding].sub(lambda m: single_run(m[0], encoding), text)


@lru_cache(maxsize=1 << 17)
def double_run(run: str, encoding: str) -> str:
    try:
        raw = bytearray(run.encode(encoding))
    except UnicodeEncodeError:
        raw = bytearray()
        for c in run:
            try:
                raw += c.encode(encoding)
            except UnicodeEncodeError:
                raw += bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else b"\xff"
    out = bytes(raw).decode("utf-8", "replace")
    lost = out.count("\ufffd")
    if out == run or lost == len(out) or 5 * lost > len(run) + 3:
        return run
    if len(run) <= 2 and not all(c in COMMON or "À" <= c <= "ɏ" or c == "\ufffd" for c in out):
        return run
    return out


def decode_double(text: str, encoding: str) -> str:
    """The same for encodings of two bytes a character: runs whose bytes are UTF-8 but for what was lost.

    Of a run of one or two characters this holds by chance too often: it must give letters or signs of
    Latin text and stand in such.
    """
    return MANY.sub(lambda m: double_run(m[0], encoding), text)


WIDE = re.compile("[\u2e80-\uffdc]")
#: Runs that bytes of a two-byte encoding leave when they are shown one by one.
RUNS = {"gbk": re.compile(r"(?:[^\x00-\x7f]{2})+"), "cp932": re.compile(r"[^\x00-\x7f](?:[@-~]|[^\x00-\x7f])(?:[@-~]?[^\x00-\x7f]+[@-~]?)*")}


@lru_cache(maxsize=1 << 17)
def wide_run(run: str, shown: str, was: str) -> str:
    table = BYTES[shown]
    raw = bytes(table.get(c, ord(c) if ord(c) < 128 else 255) for c in run)
    for cut in (0, 1):  # an ASCII letter at the end may not belong to the run
        if cut and run[-1] > "\x7f":
            break
        try:
            return raw[: len(raw) - cut].decode(was) + run[len(raw) - cut :]
        except UnicodeDecodeError:
            continue
    return run


def widen(text: str, shown: str, was: str) -> str:
    """Read in the two-byte encoding `was` what was shown in the single-byte encoding `shown`."""
    return RUNS[was].sub(lambda m: wide_run(m[0], shown, was), text)


LATIN = "\u0080-\u00ff\u0152-\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122"
LATIN_RUN = re.compile(f"[{LATIN}]{{2}}|[\x80-\x9f]")
#: Two characters of a two-byte encoding in a row, as a name of two characters leaves; fewer are evidence only together.
LATIN_NAME = re.compile(f"[{LATIN}]{{4}}")
CONTROLS = re.compile("[\x80-\x9f]")


def successors(text: str):
    """(operation, text) of every operation that can apply. Each that changes a text shortens it, so that a search always ends."""
    if PAIR.search(text):
        for e in SINGLE:
            if PATTERNS[e].search(text):
                yield f"{e}>utf-8", decode_single(text, e)
    if len(LATIN_RUN.findall(text)) > 2 or LATIN_NAME.search(text):
        controls = CONTROLS.search(text)  # without any, the two encodings show one text
        for was in RUNS:
            for shown in ("cp1252", "latin-1") if controls else ("cp1252",):
                yield f"{shown}>{was}", widen(text, shown, was)
    if WIDE.search(text):
        for e in DOUBLE:
            yield f"{e}>utf-8", decode_double(text, e)
    if "&" in text:
        yield "unescape", html.unescape(text)


def script_of(c: str) -> str:
    if c < "\x80":
        return "L" if c.isalpha() else ""
    return "" if not c.isalpha() else "L" if "À" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ" else "J" if c >= "⺀" else "O"


class Scripts(dict):
    """For str.translate: the script letter of each character, a blank for none."""

    def __missing__(self, c: int) -> str:
        self[c] = s = script_of(chr(c)) or " "
        return s


class Prices(dict):
    """How implausible each character is, given how often each code point from U+0080 on occurs in the corpus."""

    def __init__(self, count: dict[int, int]):
        super().__init__()
        self.most = {wide: math.log(1 + max((n for c, n in count.items() if (c >= 0x2E80) == wide), default=1)) for wide in (False, True)}
        self.count = count

    def __missing__(self, c: str) -> float:
        self[c] = price = self.of(c)
        return price

    def of(self, c: str) -> float:
        if c < "\x80":
            return 0.0 if c >= " " or c in "\n\t\r" else 3.0
        if c == "\ufffd" or unicodedata.category(c) in ("Cc", "Co", "Cn"):
            return 10.0
        # by how much rarer than the commonest of its kind, and if it is found nowhere else
        n = self.count.get(ord(c), 0)
        return 1.0 + RARE * max(0.0, self.most[c >= "\u2e80"] - math.log(1 + n)) + 3.0 * (n == 0)


class Cost:
    """How implausible a text is: the prices of its characters, and clashes of scripts."""

    def __init__(self, count: dict[int, int]):
        self.prices, self.scripts = Prices(count), Scripts()

    def __call__(self, text: str) -> float:
        if "&" in text and (shown := html.unescape(text)) != text:  # an escape costs what it stands for, and a little
            return self(shown) + 0.5
        # letters of two scripts within a word; beside Chinese and Japanese that is ordinary
        return sum(map(self.prices.__getitem__, HIGH.findall(text))) + 3.0 * len(CLASH.findall(text.translate(self.scripts)))


RARE = 0.6  # what a character costs for each e-fold that it is rarer
CLASH = re.compile("L(?=O)|O(?=L)")


def restore(text: str, cost: Cost) -> tuple[str, list[str]]:
    """The cheapest text that encode, decode and unescape operations reach, and the operations.

    Best first: the cheapest open text is expanded next; texts seen before are not opened again. A layer of garbling
    makes text costlier, so undoing one makes it cheaper: an operation counts if it does. The search ends at the first
    opened text that no operation changes any more if none is cheaper, else when nothing is left to
    open; the number of texts and operations has no limit. Of two operations one of which does all that the other does
    and more, making the text cheaper, the other is left out.
    """
    heap, best, seen, start, opened = [(0.0, 0, text, [])], None, {text}, 0.0, 0
    while heap:
        c, _, t, path = heapq.heappop(heap)
        new = {}
        changed = False
        for op, u in successors(t):
            changed |= u != t
            if u not in seen:
                new.setdefault(u, op)
        if new and best is None:  # the cost of what was given is asked for only if there is something to compare
            c = start = cost(text)
            best = (start, text, [])
        seen.update(new)
        kept: list[tuple[float, str, str]] = []
        for d, u, op in sorted((cost(u), u, op) for u, op in new.items()):
            if any(before < d and decode_single(u, e) == v for before, v, e in kept):
                continue
            if op.removesuffix(">utf-8") in PATTERNS:
                kept.append((d, u, op.removesuffix(">utf-8")))
            if d < best[0] - 1e-9:
                best = (d, u, [*path, op])
            if d < c - 1e-9:
                opened += 1
                heapq.heappush(heap, (d, opened, u, [*path, op]))
        if best and not changed and best[1] == t:
            break
    return (best[1], best[2]) if best and start - best[0] >= GAIN else (text, [])


#: How much cheaper a restored text must be.
GAIN = 1.5


def lines(text: str) -> list[str]:
    """Stretches that are judged by themselves: lines, with their ends. They lose nothing when joined."""
    return re.split(r"(?<=\n)", text)


def examine(text: str, cost: Cost) -> tuple[bool, bool, str]:
    """(garbled, restored, text): whether a stretch is garbled, whether all garbled stretches could be had back, and the text then."""
    garbled, whole, out = False, True, []
    if not SUSPECT.search(text):
        return False, False, text
    for line in lines(text):
        if not SUSPECT.search(line):
            out.append(line)
            continue
        got, path = restore(line, cost)
        if [p for p in path if p != "unescape"]:
            garbled = True
            out.append(got)
        else:
            out.append(line)
        if "�" in out[-1] or (not path and lost(line)):
            garbled, whole = True, False
    return garbled, garbled and whole, "".join(out)


#: What a line must hold for an operation to apply or a loss to show: without it a line needs no search.
SUSPECT = re.compile(f"{PAIR.pattern}|{WIDE.pattern}|{LATIN_RUN.pattern}|&[#A-Za-z]|[\ue000-\uf8ff\ufffd\x80-\x9f]")


def lost(line: str) -> bool:
    """Signs of garbling that no operation undoes: private characters, or controls of the upper range, among letters."""
    return bool(re.search(r"[-]|[^\W\d_][\x80-\x84\x86-\x9f]|[\x80-\x84\x86-\x9f][^\W\d_]", line))


def code_point_counts(df: DataFrame, text: str = "text") -> dict[int, int]:
    """Occurrences of each code point from U+0080 on over all texts; at most as many numbers as Unicode has."""

    def run(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t and not t.isascii()]
            for k in range(0, len(texts), 500):
                cp = np.frombuffer("".join(texts[k : k + 500]).encode("utf-32-le", "surrogatepass"), np.uint32)
                total += np.bincount(cp[cp >= 0x80], minlength=0x110000)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    got = df.select(text).filter(F.col(text).isNotNull()).mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(got.column("c").to_pylist(), got.column("n").to_pylist()))


def find_garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, text) of each row with at least one garbled stretch; `restored` says if all of it could be had back.

    Null and empty texts, and texts of ASCII alone without escapes, are never garbled. The whole text is examined, line by
    line. Only the table of code point counts, of bounded size, is held by every task.
    """
    counts = df.sparkSession.sparkContext.broadcast(code_point_counts(df, text))

    def run(batches):
        cost = Cost(counts.value)
        for batch in batches:
            rows = []
            for k, t in enumerate(batch.column(1).to_pylist()):
                garbled, restored, out = examine(t, cost)
                if garbled:
                    rows.append((k, restored, out))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], names=[key, "restored", "text"])

    some = df.select(key, F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]|&[#A-Za-z]"))
    return some.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, restored boolean, text string")
