"""Filling fixed-capacity containers with items (problem 7).

Method.  Variable-capacity best-fit: items are taken by falling size; each goes to the open
container with the least sufficient space; if there is none, the capacity of least cost is
opened: for every permitted capacity the items to come are tried, and the cost is the share that
would stay unused.  At the end each container shrinks to the least permitted capacity that holds
its contents.  The same is done with the greatest and with the least capacity throughout, and the
packing of least space is kept, so mixing capacities never costs space.  Items longer than the largest
capacity are cut into pieces of it.

Sizes are tokens of a public tokenizer.  Items are dealt by hash into cells of about
``CELL_ITEMS``; a cell is packed by one task, so no task holds more than that, and with
thousands of items a cell the space lost at its end is small.  Cells don't depend on source or
genre, so hot groups spread evenly.

Defined results: null and empty texts have no tokens and are placed in the first container of
their cell; equal rows are separate items; ties are broken by id and piece; without documents
no row comes out; without capacities an error is raised; further columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.arrow import map_lists
from lintmill.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
CELL_ITEMS = 20_000


def encoder(path: str = TOKENIZER):
    """The byte-level BPE whose ranks stand in a file; nothing is trained or copied."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(enc, ids, texts):
    encode = enc.encode_ordinary
    for i, t in zip(ids, texts):
        yield i, len(encode(t)) if t else 0


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens`` of every document, whole texts."""
    return map_lists(documents, ["doc_id", "text"], _sizes, "doc_id long, tokens long", once=lambda: encoder(tokenizer))


class Bins:
    """Open containers by free space."""

    def __init__(self):
        self.free: dict[int, list[int]] = {}
        self.levels: list[int] = []

    def put(self, space: int, number: int) -> None:
        if space <= 0:
            return
        at = self.free.get(space)
        if at is None:
            self.free[space] = [number]
            insort(self.levels, space)
        else:
            at.append(number)

    def take(self, size: int) -> tuple[int, int] | None:
        """(container, its free space) of the least space that holds ``size``."""
        i = bisect_left(self.levels, size)
        if i == len(self.levels):
            return None
        space = self.levels[i]
        at = self.free[space]
        number = at.pop()
        if not at:
            del self.free[space]
            self.levels.pop(i)
        return number, space


def opening(i: int, sizes: list[int], negative: list[int], caps: list[int]) -> int:
    """The capacity of least cost for a container that item i opens.

    For each capacity the items to come are tried, the longest that fits each time.  The cost is the share
    of the container, downsized to what it would hold then, that would stay unused; of equal cost the
    greater capacity is the better, as it leaves the most room to choose from.
    """
    best = None
    for c in caps:
        space = c - sizes[i]
        if space < 0:
            continue
        at = i + 1
        while space:
            at = max(at, bisect_left(negative, -space))
            if at >= len(sizes) or not sizes[at]:
                break
            space -= sizes[at]
            at += 1
        fits = caps[bisect_left(caps, c - space)]
        cost = ((fits - (c - space)) / fits, -c)
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def greatest(i: int, sizes: list[int], negative: list[int], caps: list[int]) -> int:
    return caps[-1]


def least(i: int, sizes: list[int], negative: list[int], caps: list[int]) -> int:
    return caps[bisect_left(caps, sizes[i])]


def pack(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int]]:
    """(container of each item, capacity of each container); sizes fall, none exceeds the largest capacity.

    Of the packings by least cost, by the greatest and by the least capacity, the one of least space.
    """
    caps = sorted(set(capacities))
    packed = [best_fit(sizes, caps, rule) for rule in (opening, greatest, least)]
    return min(packed, key=lambda p: sum(p[1]))


def best_fit(sizes: list[int], caps: list[int], rule=opening) -> tuple[list[int], list[int]]:
    """Best fit by falling size; ``rule`` gives the capacity of a container to open."""
    negative = [-s for s in sizes]
    bins, where, used = Bins(), [], []
    for i, n in enumerate(sizes):
        if n == 0:
            if not used:
                used.append(0)
            where.append(0)
            continue
        got = bins.take(n)
        if got is None:
            c = rule(i, sizes, negative, caps)
            used.append(n)
            where.append(len(used) - 1)
            bins.put(c - n, len(used) - 1)
        else:
            number, space = got
            used[number] += n
            where.append(number)
            bins.put(space - n, number)
    return where, [caps[bisect_left(caps, u)] for u in used]


_PLACED = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int64()), ("tokens", pa.int64()), ("container", pa.int64()), ("capacity", pa.int32())]
)


def _pack_cell(capacities: list[int]):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        rows = sorted(
            zip(group["tokens"].to_pylist(), group["doc_id"].to_pylist(), group["piece"].to_pylist()), key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
        )
        where, caps = pack([r[0] for r in rows], capacities)
        base = cell << 32
        return pa.table(
            [
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([base + w for w in where], pa.int64()),
                pa.array([caps[w] for w in where], pa.int32()),
            ],
            schema=_PLACED,
        )

    return run


def fill(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str = TOKENIZER, cell_items: int = CELL_ITEMS) -> DataFrame:
    """``doc_id, piece, tokens, container, capacity``: where each document, or piece of one, lies."""
    capacities = [r[0] for r in pack_sizes.where("capacity_tokens > 0").select("capacity_tokens").distinct().limit(1001).collect()]
    if not capacities or len(capacities) > 1000:
        raise ValueError("between 1 and 1000 capacities are needed")
    most = max(capacities)
    counted = cut(token_counts(documents, tokenizer))  # few bytes a document; counting tokens is the dear part
    pieces = counted.select(
        "doc_id",
        F.posexplode(
            F.concat(
                F.array_repeat(F.lit(most).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("tokens") / most) - 1).cast("int")),
                F.array(F.col("tokens") - F.greatest(F.lit(0), F.ceil(F.col("tokens") / most) - 1) * most),
            )
        ).alias("piece", "tokens"),
    )
    total = counted.select(F.sum(F.greatest(F.lit(1), F.ceil(F.col("tokens") / most)))).first()[0] or 0
    cells = max(1, -(-int(total) // cell_items))
    cell = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)).alias("cell")
    return (
        pieces.select(cell, "doc_id", F.col("piece").cast("long").alias("piece"), F.col("tokens").cast("long").alias("tokens"))
        .groupBy("cell")
        .applyInArrow(_pack_cell(capacities), "doc_id long, piece long, tokens long, container long, capacity int")
    )


def utilisation(placed: DataFrame) -> DataFrame:
    """Containers, tokens and share of space used per capacity."""
    bins = placed.groupBy("container", "capacity").agg(F.sum("tokens").alias("used"))
    return bins.groupBy("capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum("capacity")).alias("used_share")
    )
