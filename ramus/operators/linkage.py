"""complete and avg clustering from the members of clusters, without a table of the points' pairs.

Between rounds there are two tables, both linear in the points: clusters (size, centroid,
variance, radius, nearest other one) and their members in chunks. A cluster looks for its
nearest one only after it or its nearest has merged. What it can be is bounded by
centroids, variances and radii (:func:`ramus.operators.boxes.limits`); the linkage itself
is made for those candidates alone, from pairs of chunks. Once a bounded number of clusters is
left, their matrix is made from blocks of chunks, which goes on as given pairs do.

In many dimensions these bounds leave out little. There (:func:`hac_parts`) the members of the
clusters that look meet all others in large parts of whole clusters: a task makes the distances
by matrix products, reduces them to linkages, and only each cluster's nearest leaves it.
Clusters too large for a part are spread, and their parts' maxima and sums are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ramus.functions import vectors as V
from ramus.operators.boxes import SLACK, candidates
from ramus.operators.sequences import scan, with_rank
from ramus.operators.spatial import BLOCK_ROWS, PAIR_CELLS, _distances, exact_distances, product_error
from ramus.operators.storage import Tables

#: Coordinates in a chunk of members. A member is a place: its coordinates, then the number of points there.
CHUNK = 4096
_LINK = "a long, b long, most double, total double"
#: Members of a cluster that aren't spread over parts, and coordinates of a part.
SPLIT, PART_CELLS = 8192, 1 << 22
#: Pairs of members up to which a linkage is made anew from distances by coordinates, and what products can be wrong by.
EXACT, ROUNDING = 4096, 1e-7
#: Points of a tile on either side, and members from which a cluster's are put together by themselves.
TILE, SLOTS = (256, 1024), 8
_NEAREST = "id long, nn long, d double, most double, total double"


def joined_copies(points: DataFrame, store: Tables) -> tuple[list[DataFrame], DataFrame, int]:
    """Merges of the points that lie at one place, one after the other by their ids, and what is left: id, v, n; and the number of rounds.

    A place's copies would otherwise merge one a round, so that rounds grow with the copies. points: id, v.
    """
    places = store.put("places", points.groupBy("v").agg(F.max("id").alias("id"), F.count("*").alias("n")).select("id", "v", "n"))
    most = places.agg(F.max("n")).first()[0] or 1
    if most == 1:
        return [], places, 0
    of = places.filter("n > 1").select("v", F.col("id").alias("_to"))
    ranked = store.put("copies", with_rank(points.join(of, "v").select("_to", "id"), ["_to", "id"], "_pos"))
    first = ranked.groupBy("_to").agg(F.min("_pos").alias("_first"))
    before = ranked.select((F.col("_pos") + 1).alias("_pos"), F.col("_to").alias("_of"), F.col("id").alias("lo"))
    nth = F.col("_pos") - F.col("_first")
    chain = ranked.join(before, "_pos").filter("_to = _of").join(first, "_to")
    merges = chain.select(nth.alias("round"), "lo", F.col("id").alias("hi"), F.lit(0.0).alias("height"), (nth + 1).alias("size"))
    return [store.put("joined", merges)], places, most - 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def _link_chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (x, at), (y, to) = _flat(batch.column("fa")), _flat(batch.column("fb"))
        most, total = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        # Rows of one shape go together, up to a bounded number of distances.
        shape = np.diff(at) * (CHUNK * 4) + np.diff(to)
        by = np.argsort(shape, kind="stable")
        for same in np.split(by, np.flatnonzero(np.diff(shape[by])) + 1):
            if not len(same):
                continue
            n, m = int(np.diff(at)[same[0]]), int(np.diff(to)[same[0]])
            step = max(1, (1 << 20) * (dims + 1) // (n * m))
            for own in np.split(same, range(step, len(same), step)):
                p = x[at[own][:, None] + np.arange(n)].reshape(len(own), -1, dims + 1)
                q = y[to[own][:, None] + np.arange(m)].reshape(len(own), -1, dims + 1)
                d = np.zeros((len(own), p.shape[1], q.shape[1]))
                for k in range(dims):
                    d += (p[:, :, None, k] - q[:, None, :, k]) ** 2
                d = np.sqrt(d, out=d)
                most[own] = d.reshape(len(own), -1).max(1)
                total[own] = (np.matmul(d, q[:, :, dims, None])[:, :, 0] * p[:, :, dims]).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(most), pa.array(total)], ["a", "b", "most", "total"])


def linked(pairs: DataFrame, chunks: DataFrame, dims: int) -> DataFrame:
    """a, b, most, total: largest distance and sum of distances of the members' points. pairs: a, b; chunks: cid, m, flat."""
    x, y = chunks.select(F.col("cid").alias("a"), F.col("flat").alias("fa")), chunks.select(F.col("cid").alias("b"), F.col("flat").alias("fb"))
    rows = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "fa", "fb")
    return rows.mapInArrow(lambda b: _link_chunks(b, dims), _LINK).groupBy("a", "b").agg(F.max("most").alias("most"), F.sum("total").alias("total"))


def linkage_matrix(clusters: DataFrame, chunks: DataFrame, dims: int, method: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """i < j, m of all pairs of clusters (id, n): chunks in the order of their clusters fall into blocks, and two blocks meet in a task."""
    ranked = scan(with_rank(chunks.select("cid", "slot", "m", "flat"), ["cid", "slot"], "_place"), "_place", "m", "_upto")
    dealt = ranked.select("cid", "flat", F.floor(F.col("_upto") / block_rows).cast("int").alias("_x"))
    blocks = (dealt.agg(F.max("_x")).first()[0] or 0) + 1
    sent = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"_lo": F.least("_x", "_y"), "_hi": F.greatest("_x", "_y")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", kind="stable")
        sides = []
        for block in (pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]):
            side = pdf[pdf["_x"] == block]
            flat = [np.asarray(f, float).reshape(-1, dims + 1) for f in side["flat"]]
            cid = np.repeat(side["cid"].to_numpy(), [len(f) for f in flat])
            head = np.flatnonzero(np.diff(cid, prepend=cid[0] - 1)) if len(cid) else np.empty(0, int)
            sides.append((np.concatenate(flat) if flat else np.zeros((0, dims + 1)), cid[head], head))
        (x, a, at), (y, b, to) = sides
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "most": [], "total": []}).astype({"a": "int64", "b": "int64"})
        d = np.sqrt(_distances(x[:, :dims], y[:, :dims]))
        most = np.maximum.reduceat(np.maximum.reduceat(d, at, 0), to, 1)
        d *= x[:, dims, None]
        total = np.add.reduceat(np.add.reduceat(d, at, 0) * y[None, :, dims], to, 1)
        # Two blocks can share a cluster; within a block each pair counts once.
        i, j = np.nonzero(a[:, None] < b[None, :] if pdf["_lo"].iloc[0] == pdf["_hi"].iloc[0] else a[:, None] != b[None, :])
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "most": most[i, j], "total": total[i, j]})

    parts = sent.groupBy("_lo", "_hi").applyInPandas(run, _LINK)
    sums = parts.groupBy("a", "b").agg(F.max("most").alias("most"), F.sum("total").alias("total"))
    na, nb = clusters.select(F.col("id").alias("a"), F.col("n").alias("na")), clusters.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    return sums.join(na, "a").join(nb, "b").select(F.col("a").alias("i"), F.col("b").alias("j"), _linkage(method).alias("m"))


def _linkage(method: str) -> Column:
    return F.col("most") if method == "complete" else F.col("total") / (F.col("na") * F.col("nb"))


def nearest_linked(clusters: DataFrame, chunks: DataFrame, method: str, dims: int, store: Tables, **blocks: int) -> DataFrame:
    """id, nn, d: of each stale cluster the nearest by complete or avg, ties by the smaller id."""
    found = store.put("candidates", candidates(clusters, method, **blocks).withColumns({"a": F.least("id", "nn"), "b": F.greatest("id", "nn")}))
    size = lambda c, n: clusters.select(F.col("id").alias(c), F.col("n").alias(n))

    def made(pairs: DataFrame) -> DataFrame:
        return linked(pairs, chunks, dims).join(size("a", "na"), "a").join(size("b", "nb"), "b").select("a", "b", _linkage(method).alias("d"))

    # The one that is at most the least bounds the rest.
    guess = found.groupBy("id").agg(F.min(F.struct("high", "low", "a", "b")).alias("g")).select("id", "g.*")
    first = store.put("first", made(guess.filter("low < high").select("a", "b").distinct()))
    bound = guess.join(first, ["a", "b"], "left").select("id", F.coalesce("d", "high").alias("bound"))
    near = store.put("near", found.join(bound, "id").filter(F.col("low") <= F.col("bound") * (1 + SLACK)).join(first, ["a", "b"], "left"))
    rest = made(near.filter("low < high AND d IS NULL").select("a", "b").distinct()).withColumnRenamed("d", "_d")
    known = near.join(rest, ["a", "b"], "left").withColumn("d", F.coalesce("d", "_d", "low"))
    return store.put("nearest", known.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("s")).select("id", "s.nn", "s.d"))


def _regrouped(chunks: DataFrame, of: DataFrame, per: int) -> DataFrame:
    """The chunks under their new clusters; those of merged clusters are packed together again, ``per`` members a chunk or more."""
    moved = chunks.join(of.select(F.col("lo").alias("cid"), F.col("hi").alias("_to")), "cid", "left").withColumn("cid", F.coalesce("_to", "cid")).drop("_to")
    merged = of.select(F.col("hi").alias("cid"))
    same = moved.join(merged, "cid", "left_anti").select("cid", "slot", "m", "flat")
    order = W.partitionBy("cid").orderBy("m", "slot", "flat").rowsBetween(W.unboundedPreceding, -1)
    new = moved.join(merged, "cid").withColumn("slot", F.floor(F.coalesce(F.sum("m").over(order), F.lit(0)) / per))
    packed = new.groupBy("cid", "slot").agg(F.sum("m").alias("m"), F.flatten(F.sort_array(F.collect_list("flat"))).alias("flat"))
    return same.unionByName(packed.select("cid", "slot", "m", "flat"))


def hac_members(points: DataFrame, method: str, finish: int, **blocks: int) -> tuple[list[DataFrame], DataFrame, DataFrame, int]:
    """The rounds' merges until ``finish`` clusters are left, then those clusters (cid, n, var, of 0; v, spread and r) with their matrix (i, j, m), and the number of rounds."""
    store = Tables(points.sparkSession, "hac")
    dims = (points.select(F.size("v")).first() or [1])[0]
    per = max(1, CHUNK // (dims + 1))
    out, places, round_no = joined_copies(points, store)
    clusters = store.put("clusters", places.select("id", "v", "n", F.lit(0.0).alias("var"), F.lit(0.0).alias("r"), F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("d")))
    flat = F.concat("v", F.array(F.col("n").cast("double")))
    chunks = store.put("chunks", places.select(F.col("id").alias("cid"), F.lit(0).cast("long").alias("slot"), F.lit(1).cast("long").alias("m"), flat.alias("flat")))
    left, again = clusters.count(), False
    while left > max(finish, 1):
        round_no += 1
        found = nearest_linked(clusters.withColumn("stale", F.lit(True) if again else F.col("nn").isNull()), chunks, method, dims, store, **blocks)
        fresh = found.withColumnsRenamed({"nn": "_nn", "d": "_d"})
        known = store.put("known", clusters.join(fresh, "id", "left").withColumns({"nn": F.coalesce("_nn", "nn"), "d": F.coalesce("_d", "d")}).drop("_nn", "_d"))
        side = lambda i, o, k: known.select(F.col("id").alias(i), F.col("nn").alias(o), *(F.col(c).alias(f"{c}{k}") for c in ("n", "v", "var", "r")), *([F.col("d").alias("height")] if k == "a" else []))  # noqa: B023, E731
        both = side("lo", "hi", "a").filter("lo < hi").join(side("hi", "lo", "b"), ["lo", "hi"])
        size, (na, nb) = F.col("na") + F.col("nb"), (F.col("na"), F.col("nb"))
        centre = F.zip_with("va", "vb", lambda x, y: (x * na + y * nb) / (na + nb))
        both = both.withColumn("c", centre)
        gap = V.distance("va", "vb")
        var = (na * F.col("vara") + nb * F.col("varb")) / size + na * nb / (size * size) * gap * gap
        radius = F.greatest(V.distance("va", "c") + F.col("ra"), V.distance("vb", "c") + F.col("rb"))
        of = store.put(f"merged{round_no}", both.select("lo", "hi", "height", size.alias("size"), "c", var.alias("cvar"), radius.alias("cr")))
        n_merged = of.count()
        if not n_merged:
            # Ties, or rounding in kept distances; with all of them new there is always a pair.
            if again:
                raise RuntimeError("a round without a merge: the distances hold NaN")
            again = True
            clusters = known
            continue
        again = False
        out.append(of.select(F.lit(round_no).cast("long").alias("round"), "lo", "hi", "height", "size"))
        gone = of.select(F.explode(F.array("lo", "hi")).alias("nn"), F.lit(True).alias("_gone"))
        rest = known.join(of.select(F.col("lo").alias("id")), "id", "left_anti").join(of.select(F.col("hi").alias("id"), "size", "c", "cvar", "cr"), "id", "left").join(gone, "nn", "left")
        keeps = F.col("size").isNull() & F.col("_gone").isNull()
        clusters = store.put("clusters", rest.select("id", F.coalesce("c", "v").alias("v"), F.coalesce("size", "n").alias("n"), F.coalesce("cvar", "var").alias("var"), F.coalesce("cr", "r").alias("r"), F.when(keeps, F.col("nn")).alias("nn"), F.when(keeps, F.col("d")).alias("d")))
        chunks = store.put("chunks", _regrouped(chunks, of, per))
        left -= n_merged
    matrix = linkage_matrix(clusters, chunks, dims, method) if left > 1 else None
    return out, clusters.select(F.col("id").alias("cid"), "n", F.lit(0.0).alias("var"), "v", F.col("var").alias("spread"), "r"), matrix, round_no


def _members(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points by clusters, those of most members first; each cluster's id, first place, members here and members in all."""
    rows = rows.sort_by([("cid", "ascending"), ("id", "ascending")])
    cid = rows.column("cid").to_numpy()
    at = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]])) if len(cid) else np.empty(0, np.int64)
    v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1) if len(cid) else np.zeros((0, 1))
    n, whole = np.diff(np.append(at, len(cid))), rows.column("n").to_numpy()[at]
    by = np.argsort(-n, kind="stable")
    first = np.cumsum(n[by]) - n[by]
    v = v[np.repeat(at[by] - first, n[by]) + np.arange(len(v))]
    return v, cid[at[by]], first, n[by], whole[by]


class _Tile:
    """Some clusters' points, small clusters' first members together, then their second ones and so on, so that whole rows are put together."""

    def __init__(self, p: np.ndarray, at: np.ndarray, n: np.ndarray):
        large = int(np.searchsorted(-n, -SLOTS, "right"))
        self.large = [(int(x), int(x + m)) for x, m in zip(at[:large] - at[0], n[:large])]
        self.clusters, small = len(at), at[large:] - at[0]
        held = [small[: int(np.searchsorted(-n[large:], -k, "left"))] + k for k in range(int(n[large]) if large < len(at) else 0)]
        self.slots = [len(x) for x in held]
        self.order = np.concatenate([np.arange(self.large[-1][1] if large else 0), *held])
        self.x, self.single = p[at[0] + self.order], not large and len(held) == 1

    def fold(self, d: np.ndarray, f: np.ufunc) -> np.ndarray:
        """A row for each cluster from a row for each point."""
        if self.single:
            return d
        out, done = np.empty((self.clusters, d.shape[1])), self.large[-1][1] if self.large else 0
        for k, (x, y) in enumerate(self.large):
            f.reduce(d[x:y], axis=0, out=out[k])
        k = len(self.large)
        for i, m in enumerate(self.slots):
            if i:
                f(out[k : k + m], d[done : done + m], out=out[k : k + m])
            else:
                out[k:] = d[done : done + m]
            done += m
        return out


def _tiles(p: np.ndarray, at: np.ndarray, most: int) -> list[tuple[int, int, _Tile]]:
    """First and last cluster of tiles of about ``most`` points, or of one larger cluster. at: first places of clusters, those of most members first."""
    n, ends, lo, out = np.diff(np.append(at, len(p))), np.append(at[1:], len(p)), 0, []
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + most, "right")))
        out.append((lo, hi, _Tile(p, at[lo:hi], n[lo:hi])))
        lo = hi
    return out


def _reduced(p: np.ndarray, q: np.ndarray, at: np.ndarray, to: np.ndarray, method: str) -> np.ndarray:
    """Largest squared distance, or sum of distances, of the members of clusters that begin at ``at`` in p and at ``to`` in q, those of most members first.

    Distances are made by matrix products, some hundred points by some hundred at a time, so that
    they stay in a core's cache; small ones, where products lose digits, by coordinates.
    """
    out = np.empty((len(at), len(to)))
    f = np.maximum if method == "complete" else np.add
    centre = q.mean(0)
    scale = max(np.abs(p - centre).max(), np.abs(q - centre).max()) or 1.0
    least, unit = product_error(p, q, centre, scale, np.float64) / ROUNDING * scale * scale, scale * scale

    def side(x: np.ndarray, own: bool) -> np.ndarray:
        x = (x - centre) / scale
        one, squares = np.ones(len(x)), (x * x).sum(1) * unit
        return np.column_stack([-2 * unit * x, squares, one] if own else [x, one, squares])

    rows = [(lo, hi, t, side(t.x, True)) for lo, hi, t in _tiles(p, at, TILE[0])]
    for c, e, y in _tiles(q, to, TILE[1]):
        right, room = side(y.x, False), np.empty(len(y.x) * TILE[0])
        for lo, hi, x, left in rows:
            found = None
            # A larger cluster's points come in pieces.
            for piece in range(0, len(left), TILE[0]):
                some = left[piece : piece + TILE[0]]
                d = np.matmul(right, some.T, out=room[: len(right) * len(some)].reshape(len(right), len(some)))
                if d.min() < least:
                    j, i = np.nonzero(d < least)
                    d[j, i] = exact_distances(x.x, y.x, i + piece, j)
                if method != "complete":
                    np.sqrt(d, out=d)
                part = y.fold(d, f)
                if len(left) > len(some):
                    part = f.reduce(part, axis=1)[None, :]
                else:
                    part = part.T if x.single else x.fold(np.ascontiguousarray(part.T), f)
                found = part if found is None else f(found, part)
            out[lo:hi, c:e] = found
    return out


def _anew(p: np.ndarray, q: np.ndarray, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], swap: np.ndarray, method: str) -> np.ndarray:
    """Linkages of pairs of clusters (first place and members in p, in q) by coordinates, with the same bits in either direction."""
    (at, n), (to, m) = a, b
    size = n * m
    ends = np.cumsum(size)
    pair = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(pair)) - (ends - size)[pair]
    inner = np.where(swap, n, m)[pair]
    outer, inner = k // inner, k % inner
    d = np.sqrt(exact_distances(p, q, at[pair] + np.where(swap[pair], inner, outer), to[pair] + np.where(swap[pair], outer, inner)))
    return np.maximum.reduceat(d, ends - size) if method == "complete" else np.add.reduceat(d, ends - size) / size


def _link_parts(rows: pa.Table, method: str, every: bool) -> pa.Table:
    """id, nn, d: for each whole cluster that asks the nearest whole one here (or ``every`` one of a larger id); most or total where either is a part."""
    asks = rows.column("_asks")
    p, a, at, n, in_a = _members(rows.filter(asks))
    q, b, to, m, in_b = _members(rows.filter(pc.invert(asks)))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0))]
    step = max(1, PAIR_CELLS // max(len(q), 1))
    # Clusters of so many rows at a time, or a single larger one.
    cuts = np.flatnonzero(np.diff((at + n) // step, prepend=-1)) if len(q) else np.empty(0, np.int64)
    cut, by_id = bool((n != in_a).any() or (m != in_b).any()), np.argsort(b)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(a))):
        own = p[at[lo] : at[hi - 1] + n[hi - 1]]
        link = _reduced(own, q, at[lo:hi] - at[lo], to, method)
        if every or cut:
            whole = (n[lo:hi] == in_a[lo:hi])[:, None] & (m == in_b)[None, :]
            other = a[lo:hi, None] < b[None, :] if every else a[lo:hi, None] != b[None, :]
            i, j = np.nonzero(~whole & other)
            if len(i):
                nothing = np.full(len(i), np.nan)
                out.append((a[lo + i], b[j], nothing, *((np.sqrt(link[i, j]), nothing) if method == "complete" else (nothing, link[i, j]))))
            link[~(whole & other)] = np.inf
        else:
            # Itself; nothing else is left out.
            at_b = np.minimum(np.searchsorted(b[by_id], a[lo:hi]), len(b) - 1)
            same = np.flatnonzero(b[by_id][at_b] == a[lo:hi])
            link[same, by_id[at_b[same]]] = np.inf
        d = link
        if method != "complete":
            d /= n[lo:hi, None]
            d /= m
        if every:
            i, j = np.nonzero(np.isfinite(d))
        else:
            least = d.min(1)
            i, j = np.nonzero(d <= np.where(np.isfinite(least), least * (1 + 2 * ROUNDING), -1.0)[:, None])
        if not len(i):
            continue
        if method == "complete":
            d = np.sqrt(d[i, j])
        else:
            d = d[i, j]
        i = lo + i
        few = np.flatnonzero(n[i] * m[j] <= (16 if every else EXACT))
        # A bounded number of pairs at a time.
        for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(n[i[few]] * m[j[few]]) // PAIR_CELLS)) + 1):
            if len(some):
                x, y = i[some], j[some]
                d[some] = _anew(p, q, (at[x], n[x]), (to[y], m[y]), a[x] > b[y], method)
        by = np.lexsort((b[j], d, i))
        if not every:
            by = by[np.flatnonzero(np.diff(i[by], prepend=-1))]
        nothing = np.full(len(by), np.nan)
        out.append((a[i[by]], b[j[by]], d[by], nothing, nothing))
    columns = [np.concatenate(x) for x in zip(*out)]
    return pa.table([pa.array(x, from_pandas=True) for x in columns], ["id", "nn", "d", "most", "total"])


def linked_parts(clusters: DataFrame, members: DataFrame, method: str, dims: int, store: Tables, every: bool = False, packed: bool = False, split: int = SPLIT, cells: int = PART_CELLS) -> DataFrame:
    """id, nn, d: of each stale cluster the nearest, ties by the smaller id, or all pairs id < nn. clusters: id, n, stale; members: id, cid, v."""
    asking, n, most = clusters.agg(F.sum(F.when(F.col("stale"), F.col("n"))), F.sum("n"), F.max("n")).first()
    rows = max(BLOCK_ROWS, cells // max(dims, 1))
    xs, ys = max(1, -(-(asking or 0) // rows)), max(1, -(-n // rows), min(16, n // BLOCK_ROWS))
    own = members.join(clusters.select(F.col("id").alias("cid"), "n", "stale"), "cid")
    # Whole clusters go to one part; those of many members are spread.
    part = lambda k: F.pmod(F.when(F.col("n") > split, F.xxhash64("id", "cid")).otherwise(F.xxhash64("cid")), F.lit(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = own.filter("stale").withColumns({"x": part(xs), "_asks": F.lit(True)}).withColumn("y", all_of(ys))
    right = own.withColumns({"y": part(ys), "_asks": F.lit(False)}).withColumn("x", all_of(xs))
    both = left.unionByName(right).select("x", "y", "_asks", "cid", "id", "n", "v").repartition(min(xs * ys, 1024), "x", "y")
    if packed and most <= split:
        return both.groupBy("x", "y").applyInArrow(lambda t: _packed(_link_parts(t, method, every)), "k long, js binary, ds binary")
    found = both.groupBy("x", "y").applyInArrow(lambda t: _link_parts(t, method, every), _NEAREST)
    if most > split:
        found = store.put("parts", found)
        size = lambda c, to: clusters.select(F.col("id").alias(c), F.col("n").alias(to))
        cut = found.filter("d IS NULL").groupBy("id", "nn").agg(F.max("most").alias("most"), F.sum("total").alias("total"))
        cut = cut.join(size("id", "na"), "id").join(size("nn", "nb"), "nn").select("id", "nn", _linkage(method).alias("d"))
        found = found.filter("d IS NOT NULL").select("id", "nn", "d").unionByName(cut)
    if packed:
        return found.select("id", "nn", "d").groupBy("id").applyInArrow(_packed, "k long, js binary, ds binary")
    return found.select("id", "nn", "d") if every else found.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("s")).select("id", "s.nn", "s.d")


def _packed(rows: pa.Table) -> pa.Table:
    """k, js, ds: a cluster's other ones and linkages as two strings of bytes, from rows id, nn, d."""
    rows = rows.sort_by("id")
    k, j, d = (rows.column(c).to_numpy() for c in ("id", "nn", "d"))
    cuts = np.append(np.flatnonzero(np.diff(k, prepend=-1)), len(k)).tolist()
    j = j.astype(np.int32)
    own = list(zip(cuts[:-1], cuts[1:]))
    return pa.table([pa.array(k[np.array(cuts[:-1], int)], pa.int64()), pa.array([j[x:y].tobytes() for x, y in own], pa.binary()), pa.array([d[x:y].tobytes() for x, y in own], pa.binary())], ["k", "js", "ds"])


def hac_parts(points: DataFrame, method: str, finish: int, packed: bool = False, **parts: int) -> tuple[list[DataFrame], DataFrame, DataFrame | None, int]:
    """As :func:`hac_members`, without bounds: what hasn't got a nearest one is compared with all members of all clusters.

    packed: the matrix has rows k, js, ds of the clusters' places k in the order of their ids (a column more), not one for each pair.
    """
    store = Tables(points.sparkSession, "hac")
    dims = (points.select(F.size("v")).first() or [1])[0]
    out, places, round_no = joined_copies(points, store)
    clusters = store.put("clusters", places.select("id", "n", F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("d")))
    members = points.select("id", "v", F.col("id").alias("cid")) if not out else points.join(places.select("v", F.col("id").alias("cid")), "v")
    members = store.put("members", members.select("id", "cid", "v"))
    left, again = clusters.count(), False
    while left > max(finish, 1):
        round_no += 1
        found = linked_parts(clusters.withColumn("stale", F.lit(True) if again else F.col("nn").isNull()), members, method, dims, store, **parts).withColumnsRenamed({"nn": "_nn", "d": "_d"})
        known = store.put("known", clusters.join(found, "id", "left").select("id", "n", F.coalesce("_nn", "nn").alias("nn"), F.coalesce("_d", "d").alias("d")))
        a = known.select(F.col("id").alias("lo"), F.col("nn").alias("hi"), F.col("d").alias("height"), F.col("n").alias("na"))
        b = known.select(F.col("id").alias("hi"), F.col("nn").alias("_back"), F.col("n").alias("nb"))
        both = a.join(b, "hi").filter("lo < hi AND lo = _back")
        if again and both.isEmpty():
            # Rounding of sums alone keeps neighbours apart, so the least pair is next.
            both = a.join(b, "hi").orderBy("height", F.least("lo", "hi"), F.greatest("lo", "hi")).limit(1)
            both = both.select(F.greatest("lo", "hi").alias("hi"), F.least("lo", "hi").alias("lo"), "height", "na", "nb")
        of = store.put(f"merged{round_no}", both.select("lo", "hi", "height", (F.col("na") + F.col("nb")).alias("size")))
        n_merged = of.count()
        if not n_merged:
            again, clusters = True, known
            continue
        again = False
        out.append(of.select(F.lit(round_no).cast("long").alias("round"), "lo", "hi", "height", "size"))
        gone = of.select(F.explode(F.array("lo", "hi")).alias("nn"), F.lit(True).alias("_gone"))
        rest = known.join(of.select(F.col("lo").alias("id")), "id", "left_anti").join(of.select(F.col("hi").alias("id"), "size"), "id", "left").join(gone, "nn", "left")
        keeps = F.col("size").isNull() & F.col("_gone").isNull()
        clusters = store.put("clusters", rest.select("id", F.coalesce("size", "n").alias("n"), F.when(keeps, F.col("nn")).alias("nn"), F.when(keeps, F.col("d")).alias("d")))
        members = store.put("members", members.join(of.select(F.col("lo").alias("cid"), "hi"), "cid", "left").select("id", F.coalesce("hi", "cid").alias("cid"), "v"))
        left -= n_merged
    matrix = None
    if left > 1 and packed:
        ranked = store.put("ranked", with_rank(clusters.select("id", "n"), ["id"], "k"))
        own = members.join(ranked.select(F.col("id").alias("cid"), "k"), "cid").select("id", F.col("k").alias("cid"), "v")
        matrix = store.put("matrix", linked_parts(ranked.select(F.col("k").alias("id"), "n", F.lit(True).alias("stale")), own, method, dims, store, every=True, packed=True, **parts))
        return out, ranked.select(F.col("id").alias("cid"), "n", F.lit(0.0).alias("var"), "k"), matrix, round_no
    if left > 1:
        matrix = linked_parts(clusters.withColumn("stale", F.lit(True)), members, method, dims, store, every=True, **parts).select(F.col("id").alias("i"), F.col("nn").alias("j"), F.col("d").alias("m"))
    return out, clusters.select(F.col("id").alias("cid"), "n", F.lit(0.0).alias("var")), matrix, round_no
