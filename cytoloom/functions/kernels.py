"""Gapped alignment under bisulfite costs, for the few pairs that joins leave to verify.

``query`` is compared with reference bases in the query's own orientation, so the allowed change is a C
of the reference read as T (top) or, where ``bottom`` is set, a G read as A.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

# Affine score of a match, mismatch, gap opening and extension, and its band.
MATCH, MISMATCH, OPEN, EXTEND, BAND = 1, 4, 6, 1, 10
# Fixed values of the clipped search: edit cost, least aligned bases, most clipped bases.
EDIT_COST, LEAST_ALIGNED, MOST_CLIPPED = 7, 50, 30
_CODE = np.full(256, 4, np.int8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i


def cost_matrix(ref: str, query: str, bottom: bool = False) -> np.ndarray:
    """1 for a mismatch or an N, else 0; rows are reference bases."""
    r, q = (_CODE[np.frombuffer(s.encode(), np.uint8)] for s in (ref, query))
    same = (r[:, None] == q[None]) & (r[:, None] < 4)
    turned = (r[:, None] == 2) & (q[None] == 0) if bottom else (r[:, None] == 1) & (q[None] == 3)
    return (~(same | turned)).astype(np.int32)


def distance(ref: str, query: str, bottom: bool = False) -> int:
    """Global edit distance; a row of the table at a time, deletions by a running minimum."""
    cost = cost_matrix(ref, query, bottom)
    steps = np.arange(len(query) + 1)
    row = steps.copy()
    for i in range(len(ref)):
        best = np.minimum(row + 1, np.concatenate([[row[0] + 1], row[:-1] + cost[i]]))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def alignment(ref: str, query: str, bottom: bool = False, most: int | None = None) -> tuple[int, str, bool]:
    """(distance, cigar, whether another optimum exists). Among optima: fewest gap bases, then fewest gap
    runs, then the least operations, D before I before M. ``most`` edits, if known, bound the band."""
    cost = cost_matrix(ref, query, bottom)
    n, m = len(ref), len(query)
    band = max(n, m) if most is None else most
    # best (edits, gap bases, gap runs) from each cell to the end, by the operation that leads into it
    inf = (1 << 20, 0, 0)
    table = [[[inf] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    ways = np.zeros((n + 1, m + 1), object)
    least = np.full((n + 1, m + 1), 1 << 20)
    for i in range(n, -1, -1):
        for j in range(min(m, i + band), max(0, i - band) - 1, -1):
            if i == n and j == m:
                table[i][j] = [(0, 0, 0)] * 3
                ways[i, j], least[i, j] = 1, 0
                continue
            steps = []
            if i < n:
                steps.append((0, i + 1, j, 1))
            if j < m:
                steps.append((1, i, j + 1, 1))
            if i < n and j < m:
                steps.append((2, i + 1, j + 1, int(cost[i, j])))
            least[i, j] = min(least[a, b] + c for _, a, b, c in steps)
            ways[i, j] = min(2, sum(ways[a, b] for _, a, b, c in steps if least[a, b] + c == least[i, j]))
            for came in range(3):
                table[i][j][came] = min((e + c, g + (op < 2), r + (op < 2 and op != came)) for op, a, b, c in steps for e, g, r in [table[a][b][op]])
    i = j = 0
    came, ops = 2, []
    while (i, j) != (n, m):
        want = table[i][j][came]
        for op, a, b, ok in ((0, i + 1, j, i < n), (1, i, j + 1, j < m), (2, i + 1, j + 1, i < n and j < m)):
            if ok:
                e, g, r = table[a][b][op]
                c = int(cost[i, j]) if op == 2 else 1
                if (e + c, g + (op < 2), r + (op < 2 and op != came)) == want:
                    ops.append("DIM"[op])
                    i, j, came = a, b, op
                    break
    return int(least[0, 0]), "".join(f"{len(list(g))}{op}" for op, g in groupby(ops)), bool(ways[0, 0] > 1)


def flexible(window: str, query: str, slack: int, bottom: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, distance) of every placement with the least distance of at most ``slack``, with both
    ends within ``slack`` of the window's middle; the window has ``slack`` bases more on each side."""
    found: list[tuple[int, int, int]] = []
    for s in range(0, 2 * slack + 1):
        cost = cost_matrix(window[s:], query, bottom)
        steps = np.arange(len(query) + 1)
        row = steps.copy()
        for i in range(len(window) - s + 1):
            end = s + i
            if abs(end - (len(window) - slack)) <= slack and row[-1] <= slack:
                found.append((s, end, int(row[-1])))
            if i < len(window) - s:
                best = np.minimum(row + 1, np.concatenate([[row[0] + 1], row[:-1] + cost[i]]))
                row = np.minimum.accumulate(best - steps) + steps
    least = min((d for *_, d in found), default=None)
    return [x for x in found if x[2] == least]


def _codes(texts: list[str]) -> np.ndarray:
    """Base codes of texts of one length, a row each."""
    return _CODE[np.frombuffer("".join(texts).encode(), np.uint8)].reshape(len(texts), -1)


def _by_length(*columns) -> dict[tuple[int, ...], list[int]]:
    """Rows of equal lengths in every column; rows with a null are in none."""
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, row in enumerate(zip(*columns)):
        if all(x is not None for x in row):
            groups.setdefault(tuple(map(len, row)), []).append(i)
    return groups


def _costs(bottom: bool) -> np.ndarray:
    """Cost of each pair of base codes (reference, query)."""
    cost = 1 - np.eye(5, dtype=np.int16)
    cost[4, 4] = 1
    cost[(2, 0) if bottom else (1, 3)] = 0
    return cost


#: Rows of a batch that are compared at a time.
BATCH = 2048


def flexible_batch(windows: list[str], queries: list[str], slack: int, bottom: bool = False) -> list[list[tuple[int, int, int]]]:
    """``flexible`` of rows of one length each, a column of the band at a time for all rows and starts.

    Dots at a window's ends stand beyond the contig, and no placement reaches them. A path within
    ``slack`` edits never shifts by more, so the band has 2 * slack + 1 offsets.
    """
    n, wide, costs = len(queries[0]), 2 * slack + 1, _costs(bottom)
    if len(windows[0]) != n + 2 * slack or not n:
        return [flexible(w, q, slack, bottom) for w, q in zip(windows, queries)]
    w = np.pad(_codes(windows), ((0, 0), (slack, slack)), constant_values=4)
    q = _codes(queries)
    steps = np.arange(wide, dtype=np.int16)
    # cell (row, start, offset): edits of the first j bases against the window from start, shifted by offset
    now = np.broadcast_to(np.where(steps >= slack, steps - slack, 99).astype(np.int16), (len(q), wide, wide))
    for j in range(n):
        miss = costs[w[:, j : j + 4 * slack + 1], q[:, j, None]]
        new = now + np.lib.stride_tricks.sliding_window_view(miss, wide, axis=1)
        np.minimum(new[:, :, :-1], now[:, :, 1:] + 1, out=new[:, :, :-1])
        now = np.minimum.accumulate(new - steps, axis=2) + steps
    start, shift = np.meshgrid(np.arange(wide), np.arange(wide) - slack, indexing="ij")
    end = start + n + shift
    left = np.array([len(x) - len(x.lstrip(".")) for x in windows])
    right = np.array([len(x.rstrip(".")) for x in windows])
    open_ = (np.abs(start + shift - slack) <= slack)[None] & (start[None] >= left[:, None, None]) & (end[None] <= right[:, None, None])
    now = np.where(open_, now, 99)
    least = now.min((1, 2))
    out: list[list[tuple[int, int, int]]] = [[] for _ in windows]
    for i, s, o in np.argwhere((now == least[:, None, None]) & (least <= slack)[:, None, None]).tolist():
        out[i].append((s, s + n + o - slack, int(least[i])))
    return out


#: Cells of the tables that ``alignment_batch`` and ``distance_batch`` hold at a time.
CELLS = 1 << 20
_END = 3


def _misses(refs: list[str], queries: list[str], bottom: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bit masks of the bases that each reference base allows and each query base is, a column a row; they
    meet in no bit for a mismatch."""
    one = np.array([1, 2, 4, 8, 0], np.uint8)
    allowed = one.copy()
    if bottom:
        allowed[2] |= one[0]
    else:
        allowed[1] |= one[3]
    return np.ascontiguousarray(allowed[_codes(refs)].T), np.ascontiguousarray(one[_codes(queries)].T)


def distance_batch(refs: list[str], queries: list[str], bottom: bool = False) -> list[int]:
    """``distance`` of rows of one length each, a row of the table at a time for all."""
    m = len(queries[0])
    ref, query = _misses(refs, queries, bottom)
    steps = np.arange(m + 1, dtype=np.int32)[:, None]
    row = np.repeat(steps, len(refs), axis=1)
    for allowed in ref:
        best = row + 1
        np.minimum(best[1:], row[:-1] + ((allowed & query) == 0), out=best[1:])
        row = np.minimum.accumulate(best - steps, axis=0) + steps
    return row[-1].tolist()


def alignment_batch(refs: list[str], queries: list[str], bottom: bool = False) -> list[tuple[int, str, bool]]:
    """``alignment`` of rows of one length each, a diagonal of the table at a time for all.

    Edits, gap bases and gap runs are one number, so its minimum is the first of them in that order.
    """
    n, m, rows = len(refs[0]), len(queries[0]), len(refs)
    if not n or not m:
        return [alignment(r, q, bottom) for r, q in zip(refs, queries)]
    ref, query = _misses(refs, queries, bottom)
    query = query[::-1]
    size = n + m + 1
    kind = np.int32 if size**3 < 1 << 29 else np.int64
    inf = 1 << (30 if kind is np.int32 else 62)
    edit, gap = size * size, size * size + size
    # of the cells (i, d - i) of a diagonal d, by i: the number by the operation that leads into the cell,
    # the edits alone, and the ways to have as few; each of the last two diagonals, and the one in work
    tables = [[np.full((n + 2, rows), inf, kind) for _ in range(3)] for _ in range(3)]
    leasts = [np.full((n + 2, rows), 1 << 30, np.int32) for _ in range(3)]
    wayss = [np.zeros((n + 2, rows), np.uint8) for _ in range(3)]
    # the next operation from a cell, two bits for each that may lead into it
    picks = np.zeros((n + m + 1, n + 1, rows), np.uint8)
    for d in range(n + m, -1, -1):
        now, one, two = d % 3, (d + 1) % 3, (d + 2) % 3
        lo, hi = max(0, d - m), min(n, d)
        at, below = slice(lo, hi + 1), slice(lo + 1, hi + 2)
        if d == n + m:
            for t in tables[now]:
                t[n] = 0
            leasts[now][n], wayss[now][n], picks[d, n] = 0, 1, _END * 21
        else:
            # a miss of the cells (n, j) and (i, m) is not read, as nothing stands behind them
            miss = np.zeros((hi - lo + 1, rows), np.uint8)
            first, last = lo + (d - lo == m), hi - (hi == n)
            if first <= last:
                miss[first - lo : last - lo + 1] = (ref[first : last + 1] & query[m - 1 - d + first : m - d + last]) == 0
            dele = tables[one][0][below] + gap
            ins = tables[one][1][at] + gap
            same = tables[two][2][below] + miss * kind(edit)
            for came in range(3):
                x, y = dele + (came != 0), ins + (came != 1)
                best = np.minimum(np.minimum(x, y), same)
                tables[now][came][at] = best
                # the first of D, I and M that has it
                pick = np.where(x == best, np.uint8(0), np.where(y == best, np.uint8(1), np.uint8(2)))
                picks[d, at] |= pick << np.uint8(2 * came)
            x, y, z = leasts[one][below] + 1, leasts[one][at] + 1, leasts[two][below] + miss
            least = np.minimum(np.minimum(x, y), z)
            ways = (x == least) * wayss[one][below] + (y == least) * wayss[one][at] + (z == least) * wayss[two][below]
            leasts[now][at], wayss[now][at] = least, np.minimum(ways, 2)
        for edge in {lo - 1, hi + 1} - {-1}:
            for t in tables[now]:
                t[edge] = inf
            leasts[now][edge], wayss[now][edge] = 1 << 30, 0
    down, along = np.array([1, 0, 1, 0]), np.array([1, 1, 2, 0])
    i, d, came, every = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.full(rows, 2, np.uint8), np.arange(rows)
    ops = []
    while True:
        op = picks[d, i, every] >> 2 * came & 3
        if (op == _END).all():
            break
        ops.append(op)
        i, d, came = i + down[op], d + along[op], np.where(op == _END, came, op).astype(np.uint8)
    text = np.frombuffer(b"DIM ", np.uint8)[np.stack(ops, 1)]
    known: dict[bytes, str] = {}
    cigars = []
    for x in map(bytes, text):
        if x not in known:
            known[x] = "".join(f"{len(list(g))}{op}" for op, g in groupby(x.decode().rstrip()))
        cigars.append(known[x])
    return list(zip(leasts[0][0].tolist(), cigars, (wayss[0][0] > 1).tolist()))


def affine_batch(refs: list[str], queries: list[str], bottom: bool = False, band: int = BAND) -> list[int | None]:
    """``affine_score`` of rows of one length each, a row of the band at a time."""
    n, m = len(refs[0]), len(queries[0])
    if abs(n - m) > band:
        return [None] * len(refs)
    costs, low, wide = _costs(bottom), -(10**6), 2 * band + 1
    r, q = _codes(refs), np.pad(_codes(queries), ((0, 0), (band, band + max(0, n - m))), constant_values=4)
    shift = np.arange(wide) - band
    h = np.broadcast_to(np.where((shift < 0) | (shift > m), low, np.where(shift == 0, 0, -OPEN - EXTEND * shift)), (len(r), wide))
    d = np.full((len(r), wide), low)
    edge = np.full((len(r), 1), low)
    for i in range(1, n + 1):
        new_d = np.concatenate([np.maximum(h[:, 1:] - OPEN - EXTEND, d[:, 1:] - EXTEND), edge], 1)
        gain = np.where(costs[r[:, i - 1, None], q[:, i - 1 : i - 1 + wide]] == 0, MATCH, -MISMATCH)
        new_h = np.maximum(h + gain, new_d)
        j = i + shift
        if i <= band:
            new_h[:, band - i] = new_d[:, band - i] = -OPEN - EXTEND * i
        new_h[:, (j < 0) | (j > m)] = new_d[:, (j < 0) | (j > m)] = low
        # an insertion from another never beats a longer one
        run = np.maximum.accumulate(new_h + EXTEND * shift, axis=1)
        ins = np.concatenate([edge, run[:, :-1] - OPEN - EXTEND * shift[1:]], 1)
        ins[:, (j <= 0) | (j > m)] = low
        h, d = np.maximum(new_h, ins), new_d
    return h[:, m - n + band].tolist()


def affine_score(ref: str, query: str, bottom: bool = False, band: int = BAND) -> int | None:
    """Global banded score; None where the lengths differ by more than the band."""
    n, m = len(ref), len(query)
    if abs(n - m) > band:
        return None
    gain = np.where(cost_matrix(ref, query, bottom) == 0, MATCH, -MISMATCH)
    low = -(10**6)
    h, d = np.full(m + 1, low), np.full(m + 1, low)
    h[0] = 0
    for j in range(1, min(m, band) + 1):
        h[j] = -OPEN - EXTEND * j
    for i in range(1, n + 1):
        new_h, new_d = np.full(m + 1, low), np.full(m + 1, low)
        ins = low
        for j in range(max(0, i - band), min(m, i + band) + 1):
            if j == 0:
                new_h[0] = -OPEN - EXTEND * i
                new_d[0] = new_h[0]
                continue
            new_d[j] = max(h[j] - OPEN - EXTEND, d[j] - EXTEND)
            ins = max(new_h[j - 1] - OPEN - EXTEND, ins - EXTEND)
            new_h[j] = max(h[j - 1] + gain[i - 1, j - 1], new_d[j], ins)
        h, d = new_h, new_d
    return int(h[m])


def clipped_batch(refs: list[str], queries: list[str], edits: list[int], clip_cost: int = 1, bottom: bool = False) -> list[tuple[int, int, int] | None]:
    """``clipped`` of rows of one length, a pair of clips at a time for all rows."""
    n, rows = len(queries[0]), len(queries)
    if len(refs[0]) != n:
        return [None] * rows
    bad = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(_costs(bottom)[_codes(refs), _codes(queries)], 1)], 1)
    most = np.asarray(edits)
    far = 1 << 40
    best, what = np.full(rows, far), np.zeros((rows, 3), np.int64)
    for left in range(MOST_CLIPPED + 1):
        for right in range(MOST_CLIPPED + 1 - left):
            clip = left + right
            if clip == 0 or n - clip < LEAST_ALIGNED:
                continue
            d = bad[:, n - right] - bad[:, left]
            # the least of (cost, clipped bases, mismatches, left clip) as one number
            key = np.where((d <= most) & (2 * d + clip <= n // 5), (((EDIT_COST * d + clip_cost * clip) * 64 + clip) * 1024 + d) * 64 + left, far)
            won = key < best
            best[won] = key[won]
            what[won] = np.stack([np.full(rows, left), np.full(rows, right), d], 1)[won]
    return [tuple(w) if b < far else None for b, w in zip(best.tolist(), what.tolist())]


def clipped(ref: str, query: str, most_edits: int, clip_cost: int = 1, bottom: bool = False) -> tuple[int, int, int] | None:
    """(left clip, right clip, mismatches) of the best ungapped placement with clipped ends, or None.

    A placement needs 2 * mismatches + clipped bases of at most a fifth of the read. Least first: total
    cost, clipped bases, mismatches, left clip.
    """
    return clipped_batch([ref], [query], [most_edits], clip_cost, bottom)[0]


def best_partition(hits: list[list[int]]) -> tuple[int, list[int]]:
    """Least summed hits over the shift chosen at each inner boundary (dynamic programme).

    ``hits[b][3 * left + right]`` are block b's hits with its boundaries shifted by -3, 0 or 3 (numbers
    0 to 2); outer boundaries are fixed at 1.
    """
    cost = {1: (0, [])}
    for b, h in enumerate(hits):
        new: dict[int, tuple[int, list[int]]] = {}
        for left, (c, path) in cost.items():
            for right in (1,) if b == len(hits) - 1 else (0, 1, 2):
                option = (c + h[3 * left + right], path + [right])
                if right not in new or option < new[right]:
                    new[right] = option
        cost = new
    return cost[1][0], cost[1][1][:-1]


def struct_of(**fields: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


def _batched(fn, ref: pd.Series, query: pd.Series, bottom: pd.Series, absent, square: bool = False) -> list:
    """``fn`` of the rows of equal lengths and side, so many at a time as their tables, of a row of cells or
    all (``square``), fit CELLS; ``absent`` where a text is null. A null side is the top."""
    out: list = [absent] * len(ref)
    queries, side = query.tolist(), np.array([b is not None and bool(b) for b in bottom], bool)
    for turned in (False, True):
        refs = ref.where(side == turned, None).tolist()
        for (n, m), rows in _by_length(refs, queries).items():
            step = max(1, CELLS // ((n + m + 1) * (n + 1) if square else m + 1))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, x in zip(part, fn([refs[i] for i in part], [queries[i] for i in part], turned)):
                    out[i] = x
    return out


@F.pandas_udf(struct_of(distance=IntegerType(), cigar=StringType(), multiple=BooleanType()))
def alignment_udf(ref: pd.Series, query: pd.Series, bottom: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_batched(alignment_batch, ref, query, bottom, (None, None, None), square=True), columns=["distance", "cigar", "multiple"])


@F.pandas_udf(IntegerType())
def distance_udf(ref: pd.Series, query: pd.Series, bottom: pd.Series) -> pd.Series:
    return pd.Series(_batched(distance_batch, ref, query, bottom, None), dtype="Int32")


@F.pandas_udf(IntegerType())
def affine_udf(ref: pd.Series, query: pd.Series, bottom: pd.Series) -> pd.Series:
    out: list = [None] * len(ref)
    for side in (False, True):
        refs, queries = ref.where(bottom == side, None).tolist(), query.tolist()
        for rows in _by_length(refs, queries).values():
            for at in range(0, len(rows), BATCH):
                part = rows[at : at + BATCH]
                for i, x in zip(part, affine_batch([refs[i] for i in part], [queries[i] for i in part], side)):
                    out[i] = x
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(struct_of(left=IntegerType(), right=IntegerType(), distance=IntegerType()))
def clipped_udf(ref: pd.Series, query: pd.Series, edits: pd.Series, bottom: pd.Series) -> pd.DataFrame:
    out: list = [(None, None, None)] * len(ref)
    queries, most = query.tolist(), edits.tolist()
    for side in (False, True):
        refs = ref.where(bottom == side, None).tolist()
        for rows in _by_length(refs, queries).values():
            for i, x in zip(rows, clipped_batch([refs[i] for i in rows], [queries[i] for i in rows], [most[i] for i in rows], bottom=side)):
                out[i] = x or out[i]
    return pd.DataFrame(out, columns=["left", "right", "distance"])


@F.pandas_udf(IntegerType())
def mismatches_udf(ref: pd.Series, query: pd.Series) -> pd.Series:
    """Bisulfite mismatches of a read against as many reference bases of its strand; dots match nothing."""
    refs, queries = ref.tolist(), query.tolist()
    out: list = [None] * len(refs)
    for (n, m), rows in _by_length(refs, queries).items():
        if n == m:
            bad = _costs(False)[_codes([refs[i] for i in rows]), _codes([queries[i] for i in rows])].sum(1).tolist() if n else [0] * len(rows)
            for i, x in zip(rows, bad):
                out[i] = x
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(ArrayType(struct_of(start=IntegerType(), end=IntegerType(), distance=IntegerType())))
def flexible_udf(window: pd.Series, query: pd.Series, slack: pd.Series) -> pd.Series:
    windows, queries = window.tolist(), query.tolist()
    out: list = [None] * len(windows)
    for most in slack.unique().tolist():
        mine = (slack == most).tolist()
        for rows in _by_length([w if m else None for w, m in zip(windows, mine)], queries).values():
            for at in range(0, len(rows), BATCH):
                part = rows[at : at + BATCH]
                for i, found in zip(part, flexible_batch([windows[i] for i in part], [queries[i] for i in part], int(most))):
                    out[i] = [dict(zip(("start", "end", "distance"), x)) for x in found]
    return pd.Series(out)
