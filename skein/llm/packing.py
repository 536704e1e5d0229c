"""Packing documents into windows by non-negative least squares over length combinations.

Work goes in chunks of a bounded number of ids, each packed where it was read: no shuffle, and nothing gathers anywhere.
In a chunk, full windows are cut off long documents; the lengths that remain form a histogram over quanta; combinations of
at most two lengths (each any number of times) that fill a window exactly are the columns of a non-negative least-squares
problem whose solution says how often to use each; the counts are rounded down; a greedy pass fills windows from the
residual lengths; and what still fits nowhere is strung together and cut, which also fills the gaps that lengths under a
quantum leave. The last, partial window is split at powers of two, which are not padded.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordbpe import encoder

WINDOW = 4096
#: Ids to a step of the histogram; a window has WINDOW / QUANTUM steps.
QUANTUM = 8
#: Ids of one chunk.
CHUNK_IDS = 12 << 20
#: Gaps of fewer ids are padded, not filled by cutting a document.
LEAST_FILL = 8
#: Columns that enter the least-squares solution at once.
AT_ONCE = 12
#: Sequences of one task have ids from partition * 2**40.
TASK_BITS = 40

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def combinations(steps: int) -> np.ndarray:
    """Rows (i, times i, j, times j) with i * times i + j * times j == steps: one length (times j is 0) or two."""
    found = []
    for i in range(1, steps + 1):
        for a in range(1, steps // i + 1):
            rest = steps - a * i
            if rest == 0:
                found.append((i, a, i, 0))
            for j in range(i + 1, rest + 1):
                if rest % j == 0:
                    found.append((i, a, j, rest // j))
    return np.asarray(found, np.int64)


def nnls(columns: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |A x - b| over x >= 0 by active sets: columns of steepest descent enter, a few at a time that share no length; those that
    turn negative leave.

    A's columns are sparse: rows (i, times i, j, times j) as above, i and j counted from 1.
    """
    i, m, j, n = columns.T
    i, j = i - 1, j - 1
    x, inside = np.zeros(len(columns)), np.zeros(0, np.int64)
    a, gram, aim = np.zeros((0, len(b))), np.zeros((0, 0)), np.zeros(0)  # of the columns inside
    residual = b.astype(float)
    least = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * len(b)):
        w = m * residual[i] + n * residual[j]
        w[inside] = -np.inf
        new = []
        steepest = np.argpartition(-w, min(8 * AT_ONCE, len(w) - 1))[: 8 * AT_ONCE]
        for k in steepest[np.argsort(-w[steepest], kind="stable")].tolist():
            if w[k] > least and len(new) < AT_ONCE and not {i[k], j[k]} & {y for z in new for y in (i[z], j[z])}:
                new.append(k)
        if not new:
            break
        more = np.zeros((len(new), len(b)))
        np.add.at(more, (np.arange(len(new)), i[new]), m[new])
        np.add.at(more, (np.arange(len(new)), j[new]), n[new])
        dots = a @ more.T
        gram = np.block([[gram, dots], [dots.T, more @ more.T]])
        a, aim, inside = np.vstack([a, more]), np.append(aim, more @ b), np.append(inside, new)
        while len(inside):
            s = np.linalg.solve(gram + 1e-9 * np.eye(len(inside)), aim)
            if s.min() > 0:
                break
            old, bad = x[inside], s <= 0
            moved = old + np.min(old[bad] / np.maximum(old[bad] - s[bad], 1e-300)) * (s - old)
            keep = ~(bad & (moved <= 1e-12))
            if keep.all():
                keep[np.flatnonzero(bad)[np.argmin(moved[bad])]] = False
            x[inside] = np.where(keep, moved, 0)
            inside, a, aim, gram = inside[keep], a[keep], aim[keep], gram[np.ix_(keep, keep)]
        x[inside] = s if len(inside) else 0
        residual = b - x[inside] @ a
    return x


def plan(hist: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """(lengths in steps and how often each, windows) for a histogram of lengths 1..steps; uses no length more often than it occurs.

    First the rounded solution, most used first; then greedy combinations of what is left, largest first, that fill a window.
    """
    steps = len(hist)
    out: list[tuple[dict[int, int], int]] = []
    left = hist.astype(np.int64).copy()
    every = combinations(steps)
    own = every[(hist[every[:, 0] - 1] >= every[:, 1]) & (hist[every[:, 2] - 1] >= every[:, 3])]
    if len(own):
        x = nnls(own, hist)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1 - 1e-6:
                break
            i, m, j, n = own[k].tolist()
            mix = {i: m} | ({j: n} if n else {})
            times = min(int(x[k] + 1e-6), *(int(left[u - 1]) // c for u, c in mix.items()))
            if times > 0:
                for u, c in mix.items():
                    left[u - 1] -= times * c
                out.append((mix, times))
    while left.any():
        room, mix = steps, {}
        for u in np.flatnonzero(left)[::-1].tolist():
            if c := min(int(left[u]), room // (u + 1)):
                mix[u + 1] = c
                room -= c * (u + 1)
        if room:  # the largest length fills no window with what is left: for the string
            left[np.flatnonzero(left)[-1]] = 0
            continue
        times = min(int(left[u - 1]) // c for u, c in mix.items())
        for u, c in mix.items():
            left[u - 1] -= times * c
        out.append((mix, times))
    return out


def pack(lengths: np.ndarray, window: int = WINDOW, quantum: int = QUANTUM) -> tuple[np.ndarray, int]:
    """Pieces as rows (document, start, length, sequence, offset) and the number of sequences, for documents of these lengths."""
    lengths = np.asarray(lengths, np.int64)
    full, tail = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    parts = [np.stack([doc, nth * window, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64)], axis=1)]
    sequence = len(doc)

    steps = -(-tail // quantum)
    order = np.argsort(steps, kind="stable")
    order = order[tail[order] > 0]
    hist = np.bincount(steps[order], minlength=window // quantum + 1)[1:]
    first = np.concatenate([[0], np.cumsum(hist)])[:-1]  # of each length in order
    used = np.zeros(len(hist), np.int64)
    gaps: list[tuple[int, int]] = []
    for mix, times in plan(hist):
        rows = []
        for u, n in mix.items():
            at = first[u - 1] + used[u - 1]
            rows.append(order[at : at + n * times].reshape(times, n))
            used[u - 1] += n * times
        docs = np.concatenate(rows, axis=1)
        size = tail[docs]
        off = np.cumsum(size, axis=1) - size
        seq = sequence + np.arange(times)
        parts.append(np.stack([docs.ravel(), (lengths - tail)[docs].ravel(), size.ravel(), np.repeat(seq, docs.shape[1]), off.ravel()], axis=1))
        gaps += [(int(s), int(f)) for s, f in zip(seq, size.sum(axis=1)) if window - f >= LEAST_FILL]
        sequence += times

    rest = np.concatenate([order[first[u] + used[u] : first[u] + hist[u]] for u in np.flatnonzero(hist > used)] or [np.zeros(0, np.int64)]).astype(np.int64)
    if len(rest):
        string, total = np.cumsum(tail[rest]) - tail[rest], int(tail[rest].sum())
        at, slots = 0, []  # (begin in the string, sequence, offset)
        for s, f in gaps:
            if at >= total:
                break
            slots.append((at, s, f))
            at += window - f
        while total - at >= window:
            slots.append((at, sequence, 0))
            at, sequence = at + window, sequence + 1
        while at < total:
            slots.append((at, sequence, 0))
            at, sequence = at + (1 << ((total - at).bit_length() - 1)), sequence + 1
        begin = np.asarray([x[0] for x in slots], np.int64)
        cuts = np.unique(np.concatenate([begin, string]))
        size = np.diff(np.concatenate([cuts, [total]]))
        d = np.searchsorted(string, cuts, side="right") - 1
        s = np.searchsorted(begin, cuts, side="right") - 1
        info = np.asarray(slots, np.int64)
        parts.append(np.stack([rest[d], (lengths - tail)[rest[d]] + cuts - string[d], size, info[s, 1], info[s, 2] + cuts - begin[s]], axis=1))
    return np.concatenate(parts), sequence


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text; more columns are not read): see PIECES.

    Null or empty text is the end id alone. Rows with equal or null doc_id are packed each for itself. No rows: no pieces.
    """
    common.bounded_batches(spark)

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        end, w = np.asarray([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        sequence = TaskContext.get().partitionId() << TASK_BITS
        keys, ids, held = [], [], 0

        def flush():
            nonlocal keys, ids, held, sequence
            sizes = np.fromiter((len(x) // w for x in ids), np.int64, len(ids))
            rows, n = pack(sizes)
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                crc = [zlib.crc32(np.frombuffer(ids[d], enc.dtype)[a : a + m].astype("<u4").tobytes()) for d, a, m in part[:, :3].tolist()]
                columns = [[keys[d] for d in part[:, 0].tolist()], part[:, 1], part[:, 2], crc, sizes[part[:, 0]], part[:, 3] + sequence, part[:, 4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += n
            keys, ids, held = [], [], 0

        for b in batches:
            new = [x + end for x in enc.encode(b.column(1).to_pylist())]
            keys += b.column(0).to_pylist()
            ids += new
            held += sum(map(len, new)) // w
            if held >= CHUNK_IDS:
                yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)
