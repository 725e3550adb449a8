"""Near-duplicate vectors by lattice hashing (operator 2).

Each table projects a vector at random to eight dimensions and decodes it to the nearest point of the E8 lattice, its cell; it also
looks into the nearest neighbouring cells. What meets in a cell is compared by 128 signs of projections first, so that vectors move only
with those that have a likely partner there; these are verified by cosine in double precision. Large cells are cut into blocks
that meet block by block, inside tasks. Pairs are never listed: a task returns how many links each vector has and a forest of links that
joins the same vectors. A pair that meets in several tables counts in the first only, which every task can tell from the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfall.llm.common import components, stored
from outfall.llm.words import mix

THRESHOLD = 0.9
TABLES = 12
#: Neighbouring cells looked into, of 240.
PROBES = 8
#: Standard deviation of the projected difference of two vectors at the threshold, for each of eight dimensions.
SPREAD = 0.4
#: Signs of projections that may differ, of 128. At the threshold 18 are expected to, with a deviation of 4.
SIGNS = 48
#: Vectors of a cell in one block.
BLOCK = 256


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to integers."""
    whole = [v for i in range(8) for j in range(i) for a, b in product((2, -2), repeat=2) for v in [np.bincount([i, j], [a, b], 8)]]
    half = [v for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(whole + half, np.int64)


_AROUND = _neighbours()


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (doubled, so integers) of each row: the better of D8 and D8 shifted by halves."""
    best, far = None, None
    for shift in (0.0, 0.5):
        z = y - shift
        r = np.rint(z)
        off = z - r
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        worst = np.abs(off[odd]).argmax(axis=1)
        r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        point = r + shift
        d = ((y - point) ** 2).sum(axis=1)
        if best is None:
            best, far = point, d
        else:
            best = np.where((d < far)[:, None], point, best)
    return np.rint(2 * best).astype(np.int64)


def _cell(points: np.ndarray, t: int) -> np.ndarray:
    h = np.full(points.shape[:-1], t + 1, np.uint64)
    for k in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + points[..., k].astype(np.uint64))
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = 5) -> np.ndarray:
    """Cells of unit vectors, per table: the own one, then the nearest neighbours'. Shape (rows, tables, 1 + probes)."""
    rng = np.random.default_rng(seed + x.shape[1])
    scale = SPREAD / np.sqrt(2 - 2 * THRESHOLD)
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        y = x @ (rng.normal(size=(x.shape[1], 8)) * scale)
        y = y + rng.uniform(0, 2, 8)
        own = decode(y)
        rest = y - own / 2
        near = ((_AROUND / 2) ** 2).sum(axis=1)[None, :] - rest @ _AROUND.T
        pick = np.argpartition(near, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
        out[:, t, 0] = _cell(own, t)
        out[:, t, 1:] = _cell(own[:, None, :] + _AROUND[pick], t)
    return out


def _unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.reshape(-1, dims).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def signs(x: np.ndarray, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Two longs of signs of random projections."""
    bits = x @ np.random.default_rng(seed + x.shape[1]).normal(size=(x.shape[1], 128)) >= 0
    packed = np.packbits(bits, axis=1).view(np.int64)
    return packed[:, 0], packed[:, 1]


def _placed(tables: int, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An entry for every cell a vector is in or looks into; dimensions are hashed apart."""
    for batch in batches:
        node, column = batch.column("node").to_numpy(), batch.column("v")
        at = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)
        for dims in np.unique(np.diff(at)):
            rows = np.flatnonzero(np.diff(at) == dims)
            for part in np.array_split(rows, max(1, len(rows) // 500)):
                x = _unit(np.concatenate([values[at[i]:at[i + 1]] for i in part]), int(dims))
                n = tables * (1 + probes)
                own = np.zeros((len(part), tables, 1 + probes), bool)
                own[:, :, 0] = True
                yield pa.RecordBatch.from_arrays([pa.array(cells(x, tables, probes).ravel()), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), len(part))), pa.array(own.ravel()),
                                                  pa.array(np.repeat(node[part], n)), *(pa.array(np.repeat(b, n)) for b in signs(x))], names=["cell", "t", "own", "node", "s0", "s1"])


def _blocks(entries: DataFrame) -> DataFrame:
    """Rows dealt and sorted so that a run of equal (cell, block, part) is one block of a cell's vectors (base) and one part of its entries.

    Cells in which nothing meets are left out. A cell's own vectors are dealt into blocks, all its entries into parts, both of bounded size.
    """
    busy = stored(entries.groupBy("cell").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("own").cast("long")).alias("homes")).where("homes > 0 AND entries > 1"), "busy")
    sized = entries.join(busy, "cell").withColumn("blocks", F.ceil(F.col("homes") / BLOCK).cast("int")).withColumn("parts", F.ceil(F.col("entries") / BLOCK).cast("int"))
    rest = [c for c in entries.columns if c != "cell"]
    base = sized.where("own").select("cell", *rest, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
                                     F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("base"))
    other = sized.select("cell", *rest, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("base"))
    return base.union(other)


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole runs, with each row's run number; a run that goes on in the next batch waits for it."""
    held: pa.Table | None = None

    def number(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for c in ("cell", "block", "part"):
            k = rows[c].to_numpy()
            new[1:] |= k[1:] != k[:-1]
        return np.cumsum(new)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        run = number(held)
        cut = int(np.searchsorted(run, run[-1])) if len(run) else 0
        if cut:
            yield held.slice(0, cut).combine_chunks(), run[:cut]
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held, number(held)


def _meeting(run: np.ndarray, base: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (base row, other row) of each run, some of them at a time."""
    left, right = np.flatnonzero(base), np.flatnonzero(~base)
    begin, end = np.searchsorted(run[right], run[left]), np.searchsorted(run[right], run[left], side="right")
    size = end - begin
    total = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        n = size[at:to]
        yield np.repeat(left[at:to], n), right[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)]
        at = to


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with a likely partner in their cell, by signs."""
    for rows, run in _runs(batches):
        node, s0, s1 = (rows[c].to_numpy().view(np.uint64) for c in ("node", "s0", "s1"))
        likely = np.zeros(len(node), bool)
        for i, j in _meeting(run, rows["base"].to_numpy()):
            near = (np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j]).astype(int) <= SIGNS) & (node[i] != node[j])
            likely[i[near]] = likely[j[near]] = True
        yield rows.select(["cell", "t", "own", "node"]).filter(pa.array(likely)).combine_chunks().to_batches()[0] if likely.any() else _NOTHING


_NOTHING = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.bool_()), pa.array([], pa.int64())], names=["cell", "t", "own", "node"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of edges: few enough to send on."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            top[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def _met(tables: int, probes: int, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many links each vector has here (node, n, itself), and a forest of the links (node, 0, other)."""
    for rows, run in _runs(batches):
        every, own, copies, cell, t = (rows[c].to_numpy() for c in ("node", "own", "copies", "cell", "t"))
        node, first_row, of = np.unique(every, return_index=True, return_inverse=True)
        column = rows["v"].chunk(0) if rows["v"].num_chunks else pa.array([], pa.list_(pa.float64()))
        at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        dims = np.diff(at)
        count = np.zeros(len(node), np.int64)
        ends: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for d in np.unique(dims):
            some = np.flatnonzero(dims[first_row] == d)
            x = _unit(np.concatenate([values[at[r]:at[r + 1]] for r in first_row[some]]), int(d))
            found = cells(x, tables, probes)
            place = np.full(len(node), -1)
            place[some] = np.arange(len(some))
            sees = lambda p, q, s: (found[p, s] == found[q, s, 0][..., None]).any(axis=-1)
            for i, j in _meeting(run, rows["base"].to_numpy()):
                p, q = place[of[i]], place[of[j]]
                ok = (p >= 0) & (q >= 0) & (p != q) & ~(own[i] & own[j] & (p > q))
                i, p, q = i[ok], p[ok], q[ok]
                ok = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                i, p, q = i[ok], p[ok], q[ok]
                # In this table the pair counts in the larger one's cell if the smaller one looks there, else in the smaller one's.
                low, high = np.minimum(p, q), np.maximum(p, q)
                here = np.where(sees(low, high, t[i]), found[high, t[i], 0], found[low, t[i], 0]) == cell[i]
                for s in range(tables):
                    here &= (t[i] <= s) | ~(sees(low, high, s) | sees(high, low, s))
                p, q = some[p[here]], some[q[here]]
                np.add.at(count, p, copies[first_row[q]])
                np.add.at(count, q, copies[first_row[p]])
                ends[0].append(node[p])
                ends[1].append(node[q])
        a, b = _forest(np.concatenate(ends[0]), np.concatenate(ends[1])) if ends[0] else ([], [])
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[used], np.array(a, np.int64)))), pa.array(np.concatenate((count[used], np.zeros(len(a), np.int64)))),
                                          pa.array(np.concatenate((node[used], np.array(b, np.int64))))], names=["node", "n", "other"])


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    n_links counts the other rows linked directly. A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing and is its own component. Equal vectors are one class, whose copies link with each other and share its links.
    A null vec_id counts as a row and is ordered last; it is its own component if nothing smaller is linked. Vectors of different lengths don't
    link. Other columns are left out. No rows: no rows.
    """
    d = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    good = F.expr("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    rows = stored(d.withColumn("node", F.when(good, F.xxhash64("v"))).select("vec_id", "v", "node"), "vectors")
    classes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v")), "classes")
    placed = stored(classes.select("node", "v").mapInArrow(lambda batches: _placed(tables, probes, batches), "cell long, t int, own boolean, node long, s0 long, s1 long"), "placed")
    suspects = stored(_dealt(_blocks(placed)).mapInArrow(_suspects, "cell long, t int, own boolean, node long").distinct(), "suspects")
    carried = stored(_blocks(suspects), "blocks").join(classes.select("node", "v", "copies"), "node")
    met = stored(_dealt(carried).mapInArrow(lambda batches: _met(tables, probes, threshold, batches), "node long, n long, other long"), "met")
    links = met.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(met.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("node", "copies", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "lowest")
    facts = stored(named.join(lowest, "label").join(links, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "facts")
    return rows.select("vec_id", "node").join(facts, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.expr("vec_id <=> component_id"))
