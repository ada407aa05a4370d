"""Fill containers of fixed capacity with items: best-two-fit."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import materialize

#: Pieces packed together by one task; each such chunk leaves at most one container badly filled.
CHUNK = 50_000


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item. Sizes must lie in 1..capacity.

    A container is filled greedily with the largest items that fit. Then its smallest item is taken
    out if two unpacked items fill the larger gap more tightly than it did, as long as that helps.
    """
    order = np.argsort(sizes, kind="stable")
    stock: dict[int, list[int]] = {}
    for i in order.tolist():
        stock.setdefault(int(sizes[i]), []).append(i)
    avail = sorted(stock)  # the distinct sizes left
    out = np.full(len(sizes), -1, np.int64)

    def take(size: int) -> int:
        item = stock[size].pop()
        if not stock[size]:
            del stock[size]
            avail.pop(bisect_right(avail, size) - 1)
        return item

    def give(item: int) -> None:
        size = int(sizes[item])
        if size not in stock:
            avail.insert(bisect_right(avail, size), size)
            stock[size] = []
        stock[size].append(item)

    def two(room: int) -> tuple[int, int, int]:
        """Largest a + b <= room of unpacked sizes a >= b; 0 if there are no two."""
        best = (0, 0, 0)
        lo, hi = 0, bisect_right(avail, room) - 1
        while lo <= hi:
            a, b = avail[hi], avail[lo]
            if a + b > room or (lo == hi and len(stock[a]) < 2):
                hi -= 1
                continue
            if a + b > best[0]:
                best = (a + b, a, b)
                if a + b == room:
                    break
            lo += 1
        return best

    box = 0
    while avail:
        inside, gap = [], capacity
        while gap and (k := bisect_right(avail, gap)):
            item = take(avail[k - 1])
            inside.append(item)
            gap -= int(sizes[item])
        while gap and avail:
            least = min(inside, key=lambda i: sizes[i])
            total, a, b = two(gap + int(sizes[least]))
            if total <= int(sizes[least]):
                break
            inside.remove(least)
            gap += int(sizes[least]) - total
            inside += [take(a), take(b)]
            give(least)
        out[inside] = box
        box += 1
    return out


def pack(sized: DataFrame, key: str = "doc_id", size: str = "n_ids", capacity: int = 2048) -> DataFrame:
    """(key, piece, start, length, container): every item in containers of `capacity`.

    Only an item larger than the capacity is split, into full pieces and a rest. Items of size 0 or
    null get one piece of length 0 and no container (null): they need no room. Pieces are dealt to chunks of
    about CHUNK by hash, so a frequent size or key gathers nowhere, and each chunk is packed by
    itself; the number of chunks follows the number of pieces alone.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = sized.select(F.col(key), n.alias("n")).select(
        key, "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    pieces = materialize(pieces.select(key, "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("length")), "pieces")
    chunks = max(1, -(-pieces.count() // CHUNK))

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        length, chunk = t.column("length").to_numpy(), t.column("chunk").to_numpy()
        box = np.full(len(length), -1, np.int64)
        for c in np.unique(chunk):
            mine = np.flatnonzero((chunk == c) & (length > 0))
            if len(mine):
                box[mine] = (int(c) << 32) + best_two_fit(length[mine], capacity)
        column = pa.array(box, pa.int64(), mask=box < 0)
        t = t.drop_columns("chunk").append_column("container", column)
        yield from t.to_batches(max_chunksize=50_000)

    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64(key, "piece", F.lit(3)), F.lit(chunks)))
    schema = f"`{key}` {sized.schema[key].dataType.simpleString()}, piece int, start long, length int, container long"
    ordered = dealt.repartition(chunks, "chunk").sortWithinPartitions("chunk", key, "piece")
    return ordered.mapInArrow(run, schema)
