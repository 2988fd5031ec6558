"""Packing documents into sequences of bounded length (operators 2 and 5).

Both cut overlong documents without losing a token; every id of every document is in exactly
one piece, and a piece is in exactly one sequence.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import sliced, stored
from .tokens import byte_bpe


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else pieces of ``most`` ids of
    which the first takes the rest."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


# --- operator 5: best two fit ---------------------------------------------------------------


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Pack items, given as how many there are of each length, into bins.

    A bin is filled greedily with the longest item that still fits. Then its smallest item is
    replaced by the two unpacked items that together fill the gap it leaves best, if they fill it
    better than it does; of pairs that fill it alike, the most even one. As in the published algorithm
    (Friesen and Langston 1991) only items of a sixth of the capacity or more come in pairs: smaller
    ones are worth more later. Bins that come out alike are made at once, so the work grows with the
    number of lengths, not of items: no more than a few bins' kinds for each length.
    Returns (lengths in the bin, number of such bins).
    """
    left = {k: v for k, v in counts.items() if v > 0}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("a length is not between 1 and the capacity")
    out: list[tuple[list[int], int]] = []
    lengths = sorted(left, reverse=True)
    while left:
        used: Counter[int] = Counter()
        room, items = capacity, []
        for k in lengths:
            if k > room or k not in left:
                continue
            n = min(left[k], room // k)
            used[k] += n
            items += [k] * n
            room -= n * k
            if not room:
                break
        need = Counter(used)
        if room and len(items) > 1:
            smallest = items[-1]
            gap, best = room + smallest, None
            rest = [k for k in lengths if k < gap and 6 * k >= capacity and left.get(k, 0) - used[k] > 0]
            i, j = 0, len(rest) - 1  # two pointers: rest is in descending order
            while i <= j:
                total = rest[i] + rest[j]
                if total > gap:
                    i += 1
                    continue
                if (i != j or left[rest[i]] - used[rest[i]] > 1) and total > smallest and (best is None or total >= best[0]):
                    best = (total, rest[i], rest[j])
                j -= 1
            if best:
                need.update(best[1:])
                items = [*items[:-1], *best[1:]]
                used = Counter(items)
        times = min(1 + (left[k] - max(n, used[k])) // used[k] if used[k] else left[k] for k, n in need.items())
        times = max(1, times)
        out.append((sorted(items, reverse=True), times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        lengths = [k for k in lengths if k in left]
    return out


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Assign each document's pieces to as few sequences as best-two-fit makes of the whole
    table.

    The pieces are written once, each with the place it has among the pieces of its length in
    its block (the rows of one task). What goes to the driver is the number of pieces of each
    length, at most ``capacity`` numbers; from them ``best_two_fit`` makes the plan. A piece
    finds its sequence by the rank among all pieces of its length. Null text: empty, so its
    only id is ``end_id``. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    wide = np.dtype("<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, block = byte_bpe(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in sliced(batches):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.append(bpe.ids(text).astype(wide), np.array([end_id], wide))
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), block, seen[n]))
                    seen[n] += 1
            columns = zip(*rows) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "place"])

    pieces = stored(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            cut, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, place long"
        ),
        "pieces",
    )
    in_block = pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_block = stored(in_block.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "in-block")
    counts = {r["length"]: r["n"] for r in in_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, taken, first = [], Counter(), 0
    for items, times in best_two_fit(counts, capacity):
        offsets = np.concatenate([[0], np.cumsum(items)]).tolist()
        at: dict[int, list[int]] = {}
        for k, o in zip(items, offsets):
            at.setdefault(k, []).append(o)
        for k, places in at.items():
            slots.append((k, taken[k], taken[k] + times * len(places), first, times, places))
            taken[k] += times * len(places)
        first += times
    plan = spark.createDataFrame(slots, "slot_length long, low long, high long, first long, times long, places array<int>")
    ranked = pieces.join(in_block.select("block", "length", "before"), ["block", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    # The plan has a few rows for each of at most ``capacity`` lengths, whatever the input.
    found = ranked.join(F.broadcast(plan), F.expr("length = slot_length AND rank >= low AND rank < high"))
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + (F.col("rank") - F.col("low")) % F.col("times")).alias("sequence_id"),
        F.expr("CAST(places[CAST((rank - low) DIV times AS INT)] AS BIGINT)").alias("offset"),
    )


# --- operator 2: best fit decreasing --------------------------------------------------------


class RoomTree:
    """Segment tree over capacities: finds the bin whose room is the least that suffices.

    Leaf r stands for bins with room r; a node holds how many bins are below it.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = [0] * (2 * self.size)

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest bin with at least that room, taken out."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until a right sibling has bins
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins, each a list of places in ``lengths``. Longest first, each into the bin it leaves
    the least room in; equal lengths in the order given."""
    tree, bins = RoomTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        if got := tree.take(n):
            room, b = got
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        if room > n:
            tree.put(room - n, b)
    return bins


def packed_matrices(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 50256, pad_id: int = 50256, block_tokens: int = 8_000_000) -> DataFrame:
    """Token-id rows of ``capacity`` ids, with the bounds of the documents inside.

    Each task packs its rows by best-fit-decreasing, in blocks of about ``block_tokens`` tokens,
    so nothing is shuffled and a task holds no more than one block, however large its input; a
    block ends with at most one sequence less full than best-fit leaves them. Which documents
    share a sequence thus depends on how the input is split; that each token occurs once does
    not. A document is its ids and ``end_id`` (None: nothing is added); longer ones are cut into
    pieces of ``capacity``. Null text counts as empty; a document without ids has no row.

    Returns a row for each sequence: block and sequence (numbers), n_tokens, input_ids (binary,
    little-endian unsigned 16-bit, or 32-bit for vocabularies above 65536, filled up with
    ``pad_id``), cu_seqlens array<int> (from 0, the last is n_tokens), position_ids (binary,
    as input_ids; 0 at the beginning of each piece and on), doc_ids and starts (of each piece:
    its document and the place of its first id there).
    """
    if capacity > 65_536:
        raise ValueError("positions of more than 65,536 tokens don't fit the 16 bits of a small vocabulary")
    schema = "block string, sequence long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = byte_bpe(tokenizer), TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], bpe.width)
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = block = 0

        def packed() -> Iterator[pa.RecordBatch]:
            bins = best_fit_decreasing([len(p[2]) for p in pieces], capacity)
            for low in range(0, len(bins), 512):
                rows = []
                for s, members in enumerate(bins[low : low + 512], low):
                    own = [pieces[k] for k in members]
                    n = [len(p[2]) for p in own]
                    ends = np.cumsum([0, *n])
                    ids, places = np.full(capacity, pad_id, bpe.width), np.zeros(capacity, bpe.width)
                    ids[: ends[-1]] = np.concatenate([p[2] for p in own])
                    places[: ends[-1]] = np.concatenate([np.arange(x) for x in n])
                    rows.append((f"{task}-{block}", s, int(ends[-1]), ids.tobytes(), ends.tolist(), places.tobytes(), [p[0] for p in own], [p[1] for p in own]))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                names = ["block", "sequence", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in sliced(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.concatenate([bpe.ids(text), tail])
                for start, n in cuts(len(ids), capacity):
                    if n:
                        pieces.append((doc, start, ids[start : start + n]))
                        held += n
                if held >= block_tokens:
                    yield from packed()
                    pieces, held, block = [], 0, block + 1
        if pieces:
            yield from packed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, schema)
