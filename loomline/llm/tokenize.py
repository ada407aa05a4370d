"""Encode texts with a public byte-level BPE: vectorised pre-tokenisation, cached pair merging."""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Unicode's White_Space code points.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Distinct pre-tokens a worker remembers before it starts anew.
CACHE = 400_000
#: Code points handled in one vectorised step.
STEP = 1_000_000


def default_vocabulary() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return os.environ.get("TOKENIZER_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, other, white space."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def starts(cp: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point. doc_start marks the first code point of each text.

    A token is a contraction ('s 't 're 've 'm 'll 'd), a run of letters, numbers or others with the one
    U+0020 before it, or white space; of a run of white space before anything else the last character stands
    apart. Whether a token starts at a place depends on a window of three code points to either side, so
    the transition functions have finite memory and the scan is an elementwise comparison of shifted arrays.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    c = classes()[cp]
    first, last = doc_start, np.r_[doc_start[1:], True]
    before, after = np.r_[np.uint8(9), c[:-1]], np.r_[c[1:], np.uint8(9)]
    before[first], after[last] = 9, 9
    joined = np.zeros(n, bool)  # the one space that goes with what follows
    joined[1:] = (cp[:-1] == 32) & ~first[1:]
    start = first | (c != before)
    start |= (c == SPACE) & (after != SPACE) & (after != 9)  # the last of a run of white space before something else
    start &= ~((c != SPACE) & joined)
    # contractions: an apostrophe alone between no other sign and letters, without a space that it would take
    at = np.flatnonzero((cp == 39) & (before != OTHER) & ~joined & (after == LETTER))
    if len(at):
        one, two = cp[np.minimum(at + 1, n - 1)], cp[np.minimum(at + 2, n - 1)]
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        pair &= (at + 2 < n) & ~doc_start[np.minimum(at + 2, n - 1)]
        size = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(pair, 2, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[(at + 1 + size)[at + 1 + size < n]] = True
    return start


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Pair merging, lowest rank first, leftmost of equals, with a heap: n log n even for a long run."""
    if piece in ranks:
        return (ranks[piece],)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = nxt[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != whole:
            continue
        parts[i], parts[j], nxt[i] = whole, None, nxt[j]
        if nxt[i] < len(parts):
            prv[nxt[i]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return tuple(ranks[p] for p in parts if p is not None)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Encoder(dict):
    """From the bytes of a pre-token to its ids; remembers what it has merged."""

    def __init__(self, ranks: dict[bytes, int], native: bool = True):
        super().__init__()
        self.ranks, self.piece = ranks, lambda p: merge(p, ranks)
        if native:
            try:  # the same pair merging as a compiled kernel
                import tiktoken

                core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
                self.piece = lambda p: tuple(core._core_bpe.encode_single_piece(p))
            except (ImportError, AttributeError):
                pass

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = self.piece(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, each text's end among them, and the byte at which each id's pre-token starts in the joined texts."""
        texts = [t or "" for t in texts]
        ids_of: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        byte_of: list[np.ndarray] = []
        at = total = base = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= STEP):
                size += len(texts[upto])
                upto += 1
            part = texts[at:upto]
            joined = "".join(part)
            cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            raw = joined.encode("utf-8")
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            text_at = np.cumsum(lengths) - lengths
            mark = np.zeros(len(cp) + 1, bool)
            mark[text_at] = True
            where = np.flatnonzero(starts(cp, mark[:-1]))
            width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
            byte = np.r_[0, np.cumsum(width)]
            cut = [*byte[where].tolist(), len(raw)]
            got = [self[raw[a:b]] for a, b in zip(cut, cut[1:])] if len(where) else []
            count = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.int32, int(count.sum()))
            upto_token = np.r_[0, np.cumsum(count)]
            ends.append(upto_token[np.searchsorted(where, text_at + lengths)] + total)
            ids_of.append(flat)
            byte_of.append(np.repeat(byte[where] + base, count))
            total += len(flat)
            base += len(raw)
            at = upto
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        return cat(ids_of, np.int32), cat(ends, np.int64), cat(byte_of, np.int64)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, count_only: bool = False, offsets: bool = False) -> DataFrame:
    """(key, ids): the token ids of each text, or (key, n_ids) if count_only; with offsets also (starts), of each id the
    byte of the text's UTF-8 at which its pre-token starts: ids of equal start decode together to the bytes up to the next.

    A null and an empty text both give the empty list. Special tokens' strings are ordinary text.
    Any table with a key and a text column will do; other columns are not read. The vocabulary file
    (ranks as base64 lines) is read on the driver and shipped once: its size is fixed.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = Encoder(read_ranks(shipped.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, ends, at = encoder.encode(texts)
            more = []
            if count_only:
                value = pa.array(np.diff(np.r_[0, ends]).astype(np.int32), pa.int32())
            else:
                edges = pa.array(np.r_[0, ends].astype(np.int32), pa.int32())
                value = pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32()))
                if offsets:
                    size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                    first = np.repeat(np.cumsum(size) - size, np.diff(np.r_[0, ends]))
                    more = [pa.ListArray.from_arrays(edges, pa.array((at - first).astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), value, *more], names=[key, "n_ids" if count_only else "ids", *["starts"] * len(more)])

    kind = df.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, " + ("n_ids int" if count_only else "ids array<int>" + ", starts array<int>" * offsets)
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, out)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of a list of ids."""
    tokens = {v: k for k, v in ranks.items()}
    return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")
