"""Points that change in batches, kept on disk in cells along a Morton curve."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.functions import vectors as V
from ramus.operators.spatial import in_cube, meet_in_cells
from ramus.operators.storage import delete

#: Changed rows for each kept row at which the points are written anew.
COMPACT_AT = 0.75
_LOG = "version long, kind string, batch long, n long, lo array<double>, side double, bits int, base long"


class DynamicPoints:
    """An index of points (id, v) that takes inserts and erasures without being rewritten.

    Each batch of inserts is a folder with a folder for each of its cells (2^bits along each
    of up to three coordinates of the cube from lo on; points outside count to its outermost
    cells). A batch of erasures is a table of ids and cells: it takes out the points of that
    id that lie in that cell and were inserted before, copies of an id too; ids that aren't
    there are ignored. Searches read only the cells that they meet. When ``COMPACT_AT``
    rows have changed for each row kept at the last compaction, the living points are written
    as one batch. A version is a table of its batches, written last, so that a failed change
    leaves the version before; readers of an old version keep their files until ``vacuum``.
    Changes must come one after another. Null ids or points, and points of another dimension
    than the first batch's, raise an error.
    """

    def __init__(self, spark: SparkSession, path: str, lo: list[float], side: float, bits: int = 4):
        if not 1 <= len(lo) <= 3 or bits * len(lo) > 15 or bits < 1 or not side > 0:
            raise ValueError("a cube of one to three dimensions and at most 32,768 cells")
        self.spark, self.path, self.lo, self.side, self.bits = spark, path.rstrip("/"), [float(x) for x in lo], float(side), bits
        self.version, self.base, self.batches = 0, 0, []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DynamicPoints:
        """The last version under ``path``."""
        log = spark.read.schema(_LOG).parquet(f"{path.rstrip('/')}/log/*")
        last = log.filter(F.col("version") == log.agg(F.max("version")).first()[0]).collect()
        out = cls(spark, path, last[0].lo, last[0].side, last[0].bits)
        out.version, out.base, out.batches = last[0].version, last[0].base, sorted((r.batch, r.kind, r.n) for r in last)
        return out

    def _code(self, v) -> F.Column:
        return V.morton(v, self.lo, [self.side / (1 << self.bits)] * len(self.lo), self.bits)

    def _commit(self, batches: list[tuple[int, str, int]], base: int) -> None:
        rows = [(self.version + 1, kind, batch, n, self.lo, self.side, self.bits, base) for batch, kind, n in batches]
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.parquet(f"{self.path}/log/{self.version + 1}")
        self.version, self.base, self.batches = self.version + 1, base, batches

    def _write(self, rows: DataFrame, kind: str) -> tuple[int, str, int]:
        batch = self.version + 1
        target = f"{self.path}/{kind}/batch={batch}"
        # What a failed attempt at this version left goes; large cells are split over tasks and files.
        if kind == "points":
            rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(target)
        else:
            rows.write.mode("overwrite").parquet(target)
        return batch, kind, self._read([batch], kind).count()

    def _read(self, batches: list[int], kind: str) -> DataFrame:
        schema = "id long, v array<double>, batch long, cell long" if kind == "points" else "id long, cell long, batch long"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/batch={b}" for b in batches))

    def _of(self, kind: str) -> list[int]:
        return [b for b, k, n in self.batches if k == kind and n]

    def _placed(self, points: DataFrame) -> DataFrame:
        bad = F.col("id").isNull() | F.col("v").isNull() | (F.size("v") < len(self.lo)) | F.exists("v", lambda x: x.isNull() | F.isnan(x))
        rows = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        return rows.filter(F.when(bad, F.raise_error(F.lit("a point with a null id or coordinate, or too few coordinates")).isNull()).otherwise(True)).withColumn("cell", self._code("v"))

    def insert(self, points: DataFrame) -> DynamicPoints:
        self._commit([*self.batches, self._write(self._placed(points), "points")], self.base)
        return self._maybe_compact()

    def erase(self, points: DataFrame) -> DynamicPoints:
        """Takes out points (id, v), which are looked for in v's cell."""
        self._commit([*self.batches, self._write(self._placed(points).select("id", "cell").distinct(), "gone")], self.base)
        return self._maybe_compact()

    def _maybe_compact(self) -> DynamicPoints:
        if self.base:
            changed = sum(n for b, _, n in self.batches if b != self.batches[0][0])
            return self.compact() if changed >= COMPACT_AT * self.base else self
        # The first batch that holds anything is what the next ones are measured by.
        self.base = sum(n for _, k, n in self.batches if k == "points")
        return self

    def compact(self) -> DynamicPoints:
        """The living points as one batch."""
        kept = self._write(self.rows().select("id", "v", "cell"), "points")
        self._commit([kept], kept[2])
        return self

    def vacuum(self) -> None:
        """Deletes the batches of former versions."""
        used = {(k, b) for b, k, _ in self.batches}
        log = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/*").select("kind", "batch").distinct()
        for row in log.collect():
            if (row.kind, row.batch) not in used:
                delete(self.spark, f"{self.path}/{row.kind}/batch={row.batch}")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """id, v, cell of the living points, in ``cells`` only if they are given."""
        rows, gone = self._read(self._of("points"), "points"), self._read(self._of("gone"), "gone")
        if cells is not None:
            rows, gone = rows.filter(F.col("cell").isin(cells)), gone.filter(F.col("cell").isin(cells))
        if not self._of("gone"):
            return rows.select("id", "v", "cell")
        last = gone.groupBy("cell", "id").agg(F.max("batch").alias("_gone"))
        return rows.join(last, ["cell", "id"], "left").filter("_gone IS NULL OR batch > _gone").select("id", "v", "cell")

    def count(self) -> int:
        return self.rows().count()

    def _index(self, x: float, k: int) -> int:
        return int(min(max((x - self.lo[k]) // (self.side / (1 << self.bits)), 0), (1 << self.bits) - 1))

    def within(self, lo: list[float], hi: list[float]) -> DataFrame:
        """id, v of the points in one box, read from the cells that it meets (a partition filter)."""
        along = len(self.lo)
        spans = [range(self._index(lo[k], k), self._index(hi[k], k) + 1) for k in range(along)]
        cells = [sum(((x >> b) & 1) << (b * along + k) for k, x in enumerate(at) for b in range(self.bits)) for at in product(*spans)]
        array = lambda x: F.array(*(F.lit(float(y)) for y in x))
        return self.rows(cells).filter(V.in_box("v", array(lo), array(hi))).select("id", "v")

    def box(self, centers: DataFrame, half: float) -> DataFrame:
        """center, id of the points in the cube of half-width ``half`` around each centre (center, c).

        A centre goes to the cells that its cube meets, at most all of them, and to every part
        of a cell: cells are split by the number of their points.
        """
        along, wide = len(self.lo), self.side / (1 << self.bits)
        asks = centers.select("center", "c")
        at = lambda x, k: F.least(F.greatest(F.floor((x - self.lo[k]) / wide), F.lit(0)), F.lit((1 << self.bits) - 1))
        for k in range(along):
            x = F.element_at("c", k + 1)
            asks = asks.withColumn(f"_k{k}", F.explode(F.sequence(at(x - half, k), at(x + half, k))))
        code = V.morton(F.array(*(F.col(f"_k{k}") + F.lit(0.5) for k in range(along))), [0.0] * along, [1.0] * along, self.bits)
        asks = asks.select("center", "c", code.alias("cell"))
        met, gaps = meet_in_cells(self.rows(), asks, centers.select("center", "c"), ["cell"])
        return met.filter(in_cube(gaps, half)).select("center", "id")
