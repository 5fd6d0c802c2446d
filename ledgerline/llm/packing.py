"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows and a rest, and the rests into small
pieces.  A batch of pieces, which stays a little under the room of its windows,
is spread over k of them: every piece begins as a partition of k loads, one of
them the piece; the two partitions of largest spread are merged, the largest
load of one with the least of the other, until one partition is left.  If its
largest window is over the capacity, k rises.  Batches are formed inside a
task, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ARROW_ROWS, small_batches
from .tokens import CachedEncoder

#: Tokens of a sequence.
CAPACITY = 2048
#: Longest piece of a document's rest; small pieces even out better.
PIECE = 512
#: Every so many documents the rest is cut into pieces of at most FINE, to fill what the others leave.
FINE_EVERY, FINE = 16, 96
#: Windows of a batch, and the tokens by which its pieces stay under the windows' room for each window.
WINDOWS, SLACK = 32, 12


def differencing(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp: (load, pieces) of each of k windows, loads ascending.

    A partition is a sorted list of its loads other than zero, with their pieces.
    """
    heap: list[tuple[int, int, list]] = [(-size, i, [(size, i, None)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            # Each load meets a zero of the other partition.
            made = a + b
        else:
            # Opposite orders: the greatest of either side meet the zeros of the other, and so the least meet each other.
            made = [(x[0] + y[0], x, y) for x, y in zip(a[:over], b[:over][::-1])] + a[over:] + b[over:]
        made.sort(key=_load)
        spread = made[-1][0] - (made[0][0] if len(made) == k else 0)
        heapq.heappush(heap, (-spread, serial, made))
        serial += 1
    loads = heap[0][2]
    return [0] * (k - len(loads)) + [x[0] for x in loads], [[] for _ in range(k - len(loads))] + [_pieces(x) for x in loads]


def _load(entry: tuple) -> int:
    return entry[0]


def _pieces(entry: tuple) -> list[int]:
    """Pieces of a load, which is a piece (size, number, None) or the sum of two loads (sum, one, other)."""
    out, stack = [], [entry]
    while stack:
        _, one, other = stack.pop()
        if other is None:
            out.append(one)
        else:
            stack += (one, other)
    return sorted(out)


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Pieces of each window, with no window over ``capacity``; as few windows as differencing finds from the least number on."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        loads, windows = differencing(sizes, k)
        if loads[-1] <= capacity:
            return [w for w in windows if w]
        k += 1


def cut(start: int, stop: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of nearly equal pieces of at most ``piece`` tokens."""
    parts = -(-(stop - start) // piece)
    edges = [start + (stop - start) * i // parts for i in range(parts + 1)] if parts else []
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def pack_documents(docs: DataFrame, encoder: CachedEncoder, end_id: int, capacity: int = CAPACITY, piece: int = PIECE, fine: int = FINE, windows: int = WINDOWS, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of every text.

    Each text is its ids and ``end_id``; a null or empty text is ``end_id``
    alone.  sequence_id is unique over the table: the task's number and the
    window's number in it.  Windows of one task share no pieces with another
    task, so the last window of a task may be short.  Rows with null or
    repeated ids are packed like others; an empty table gives no pieces.
    """
    if max(piece, fine) > capacity or slack >= capacity:
        raise ValueError("pieces must fit a window, and the slack must leave room in it")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    if with_ids:
        schema.add("ids", T.BinaryType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        rests: list[tuple] = []
        goal = windows * (capacity - slack)
        gathered = 0
        serial_doc = 0
        rows: list[tuple] = []

        def place(piece_row: tuple, sequence: int, offset: int) -> None:
            doc_id, at, raw, total = piece_row
            rows.append((doc_id, at, len(raw) // 4, zlib.crc32(raw), total, sequence, offset) + ((raw,) if with_ids else ()))

        def close() -> None:
            nonlocal serial, gathered
            for window in pack([len(r[2]) // 4 for r in rests], capacity):
                offset = 0
                for i in window:
                    place(rests[i], serial, offset)
                    offset += len(rests[i][2]) // 4
                serial += 1
            rests.clear()
            gathered = 0

        def add(doc_id, ids: np.ndarray) -> None:
            nonlocal serial, gathered, serial_doc
            raw, total = ids.tobytes(), len(ids)
            serial_doc += 1
            whole = total // capacity * capacity
            for at in range(0, whole, capacity):
                place((doc_id, at, raw[at * 4 : (at + capacity) * 4], total), serial, 0)
                serial += 1
            longest = fine if serial_doc % FINE_EVERY == 0 else piece
            while whole < total:
                # A batch is filled up to its goal; the rest of the document goes to the next.
                stop = min(total, whole + goal - gathered)
                for at, length in cut(whole, stop, longest):
                    rests.append((doc_id, at, raw[at * 4 : (at + length) * 4], total))
                gathered += stop - whole
                whole = stop
                if gathered >= goal:
                    close()

        def table() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
            rows.clear()
            return made

        for batch in batches:
            for k in range(0, batch.num_rows, ARROW_ROWS):
                part = batch.slice(k, ARROW_ROWS)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist())):
                    add(doc_id, np.append(ids, end_id).astype("<u4"))
                if rows:
                    yield table()
        close()
        if rows:
            yield table()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
