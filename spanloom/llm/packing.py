"""Cost-balanced packing of tokenised documents into sequences of one capacity."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.textvec import slices

#: The split of texts before merges, a fixed value of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = "<|endoftext|>"
_encoders: dict[str, object] = {}


def encoder(ranks_path: str):
    """The byte-level vocabulary, loaded once a worker; the rank file gives the ids of the tokenizers file of the same vocabulary, faster."""
    if ranks_path not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})
    return _encoders[ranks_path]


def ids_of(enc, text: str) -> list[int]:
    return enc.encode(text, allowed_special={END}) if END in text else enc.encode_ordinary(text)


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float, full: bool) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of the items, cut where needed.

    Whole runs of `capacity` are sequences of their own. The rests go, longest first, each to the lowest-cost sequence
    that has room for it; a sequence's cost is the sum of linear * length + quadratic * length ** 2 over its pieces. What fits nowhere whole is
    cut to fill the lowest-cost sequences' rooms. full: the lengths add up to a multiple of capacity, so all sequences fill up."""
    out, seq = [], 0
    rests = []
    for i, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((i, k * capacity, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rests.append((n % capacity, i, whole * capacity))
    bins = -(-sum(r[0] for r in rests) // capacity)
    room, cost = np.full(bins, capacity, dtype=np.int64), np.zeros(bins)
    late = []
    for n, i, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        at = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[at] < n:
            late.append((n, i, start))
            continue
        out.append((i, start, n, seq + at, capacity - int(room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
    for n, i, start in late:
        while n:
            at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            take = min(n, int(room[at]))
            out.append((i, start, take, seq + at, capacity - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return out


def pack(docs: DataFrame, ranks_path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", linear: float = 1.0, quadratic: float = 1 / 512, group: int = 256, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with with_ids, ids.

    A document is its text's ids and an id 0 at the end; null counts as empty (the 0 alone). Tasks pack as they read, in
    groups of `group` sequences: a group's last document is cut so that its sequences are full, and the rest goes to the next
    group, so a task's padding comes to less than one sequence. sequence_id is the task's number times 2 ** 33 and a running number; offsets are
    gapless from 0. Rows that repeat an id are documents of their own. A null id is returned as null. An empty table gives no rows."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(ranks_path), TaskContext.get().partitionId() << 33
        made, held, total = 0, [], 0  # held: [id, start, ids of the document]

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal made, held, total
            extra = 0 if last else total % capacity
            lengths = [len(x[2]) - x[1] for x in held]
            carry = []
            while extra:  # from the last documents on
                take = min(extra, lengths[-1])
                x = held[len(lengths) - 1]
                carry.insert(0, [x[0], x[1] + lengths[-1] - take, x[2]])
                lengths[-1] -= take
                extra -= take
                if not lengths[-1]:
                    lengths.pop()
            cols = [[] for _ in range(8)]
            top = 0
            for i, start, n, seq, offset in assign(lengths, capacity, linear, quadratic, not last):
                doc, before, ids = held[i]
                piece = ids[before + start : before + start + n]
                for c, v in zip(cols, (doc, before + start, n, zlib.crc32(piece.tobytes()), len(ids), base + made + seq, offset, piece), strict=True):
                    c.append(v)
                top = max(top, seq + 1)
            made += top
            held, total = carry, sum(len(x[2]) - x[1] for x in carry)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[2])]).astype(np.int32)), pa.array(np.concatenate(cols[7]).astype(np.int32) if cols[7] else np.zeros(0, np.int32)))
            arrays = [pa.array(cols[0], ids_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], *([lists] if with_ids else [])]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])

        ids_type = None
        for b in batches:
            ids_type = b.column(0).type
            for lo, hi in slices(b.column(1)):
                seen: dict[str, np.ndarray] = {}
                for doc, text in zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                    text = text or ""
                    ids = seen.get(text)
                    if ids is None:
                        ids = seen[text] = np.array([*ids_of(enc, text), 0], dtype=np.uint32)
                    held.append([doc, 0, ids])
                    total += len(ids)
                    if total >= group * capacity:
                        yield flush(False)
        if held:
            yield flush(True)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
