"""Online packing by the sum of squares.

Every document becomes its ids and one end id; what exceeds a window is cut off in full windows of
its own, and the rest is placed at once.  A level array counts the open windows of each fill.  The
rest goes to the fill that makes the sum of the squared counts smallest: an open window it fits in,
a new one, or, since cuts are free, a window that it fills up, with what is left over as a new
window.  A cut is charged `CUT`, so it happens only where windows would otherwise heap up at some
fills (all documents of 600 ids, say); that bounds the open windows of a fill and so the memory.

Rows of an input partition are one stream with a level array of its own, packed in the task that
tokenises them: nothing is shuffled, and a lost task is done again with the same result.  When a
stream ends, its open windows, a bounded number, are joined to full ones, cut where one is full.
What remains is less than one window; its binary digits are sequences whose lengths are powers of
two, so it needs no padding either.

`sequence_id` is the number of the partition, then that of the window in it.

Defined cases: null and empty texts are the end id alone; repeated rows are documents of their own;
a null id is carried like any other; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from playbill.llm.packing import encoder, paths

SEQUENCE = 1024
END_ID = 0
CUT = 16  # what a cut must save in squared counts
STREAM_BITS = 36  # windows of one stream


class Stream:
    """Open windows by fill, and the pieces of the windows that are done.

    A piece is (document, start, ids as bytes); a document is any value that is handed back.
    """

    def __init__(self, size: int = SEQUENCE, cut: int = CUT):
        self.size, self.cut = size, cut
        self.done: list[list] = []
        self._clear()

    def _clear(self) -> None:
        import numpy as np

        size = self.size
        self.level = np.zeros(size + 1, dtype=np.int64)
        # Changes of the sum of squares when a window leaves or reaches a fill; nothing leaves a fill without windows.
        self.leave = np.full(size + 1, np.iinfo(np.int64).max // 4)
        self.leave[0] = 0
        self.reach = np.ones(size + 1, dtype=np.int64)
        self.reach[size] = 0
        self.open: list[list[list]] = [[] for _ in range(size)]

    def _count(self, fill: int, change: int) -> None:
        if 0 < fill < self.size:
            self.level[fill] += change
            n = int(self.level[fill])
            self.leave[fill] = 1 - 2 * n if n else self.leave[self.size]
            self.reach[fill] = 1 + 2 * n

    def _put(self, fill: int, piece) -> None:
        window = self.open[fill].pop() if fill else []
        window.append(piece)
        self._count(fill, -1)
        after = fill + len(piece[2]) // 4
        if after == self.size:
            self.done.append(window)
        else:
            self._count(after, 1)
            self.open[after].append(window)

    def best(self, n: int) -> tuple[int, bool]:
        """(fill, whether the document is cut) of the least sum of squares; the fullest window wins ties, and no cut."""
        room = self.size - n
        whole = self.leave[: room + 1] + self.reach[n:]
        at = room - int(whole[::-1].argmin())
        if n > 1:
            parted = self.leave[room + 1 : self.size] + self.reach[1:n]
            on = n - 2 - int(parted[::-1].argmin())
            if parted[on] + self.cut < whole[at]:
                return room + 1 + on, True
        return at, False

    def add(self, document, ids: bytes) -> None:
        start, n = 0, len(ids) // 4
        while n - start >= self.size:
            self.done.append([(document, start, ids[4 * start : 4 * (start + self.size)])])
            start += self.size
        if n == start:
            return
        fill, parted = self.best(n - start)
        middle = start + self.size - fill if parted else n
        self._put(fill, (document, start, ids[4 * start : 4 * middle]))
        if parted:
            self._put(0, (document, middle, ids[4 * middle :]))

    def finish(self) -> None:
        """Joins the open windows, the fullest first, and cuts where one is full; the remainder goes by binary digits."""
        left = [piece for fill in reversed(range(self.size)) for window in self.open[fill] for piece in window]
        total = sum(len(p[2]) // 4 for p in left)
        lengths = [self.size] * (total // self.size) + [1 << b for b in reversed(range(self.size.bit_length())) if total % self.size >> b & 1]
        left.reverse()
        for length in lengths:
            window, room = [], length
            while room:
                document, start, ids = left.pop()
                n = min(room, len(ids) // 4)
                window.append((document, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    left.append((document, start + n, ids[4 * n :]))
                room -= n
            self.done.append(_joined(window))
        self._clear()

    def taken(self) -> list[list]:
        out, self.done = self.done, []
        return out


def _joined(window: list) -> list:
    """Neighbouring pieces of one document that go on where the last one ended are one piece."""
    out: list = []
    for document, start, ids in window:
        if out and out[-1][0] is document and out[-1][1] + len(out[-1][2]) // 4 == start:
            document, start, ids = document, out[-1][1], out.pop()[2] + ids
        out.append((document, start, ids))
    return out


def padding(length: int, sequence: int = SEQUENCE) -> int:
    """Places that are filled up in a sequence of this length."""
    return 0 if length & (length - 1) == 0 else sequence - length


def pack_online(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, cut: int = CUT, with_ids: bool = False, files: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece, and `ids` on request."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, ArrayType, LongType, StructField, StructType

    if sequence & (sequence - 1):
        raise ValueError("the length of a sequence must be a power of two")
    vocabulary, ranks = files or paths()
    end = end_id.to_bytes(4, "little")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [docs.schema["doc_id"], *(StructField(n, LongType()) for n in names)] + [StructField("ids", ArrayType(IntegerType()))] * with_ids
    schema = StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, stream = encoder(vocabulary, ranks), Stream(sequence, cut)
        number = TaskContext.get().partitionId() << STREAM_BITS

        def rows():
            nonlocal number
            out: list[list] = [[] for _ in schema]
            for window in stream.taken():
                at = 0
                for (doc_id, tokens), start, ids in window:
                    n = len(ids) // 4
                    for column, value in zip(out, (doc_id, start, n, zlib.crc32(ids), tokens, number, at, np.frombuffer(ids, "<u4").astype("int32") if with_ids else None)):
                        column.append(value)
                    at += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                stream.add((doc_id, len(ids) // 4), ids)
            yield rows()
        stream.finish()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
