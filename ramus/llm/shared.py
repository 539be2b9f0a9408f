"""Expressions made once, tables under safe names, and row identities; the shared folder comes from the library's storage module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

LAST = (1 << 63) - 1
#: Ids that occur more than once are marked in slots of their hash.
ID_SLOTS = 1 << 16


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The columns of ``keep`` and new ones, which are made once for each row.

    A filter on a projected column is pushed below the projection with a copy of its
    expression. Nothing is pushed below this generator, which gives one row for each row.
    """
    made = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return df.select(*keep, F.explode_outer(made).alias("_x")).select(*keep, *(F.col("_x")[n].alias(n) for n in columns))


class Safe:
    """A table under the names c0, c1, ..., so that its own names can hold dots or quotes, or differ by case alone.

    ``col`` and ``field`` look a name up as it is written, else without regard to case.
    ``rec`` is a struct of the kept columns, by default all; ``out`` gives its fields
    their own names again.
    """

    def __init__(self, table: DataFrame, keep: list[str] | None = None):
        self.names, self.fields = table.columns, table.schema.fields
        self.rows = table.toDF(*(f"c{i}" for i in range(len(self.names))))
        self.kept = list(range(len(self.names))) if keep is None else [self._at(c) for c in keep]
        # A struct can't be empty.
        kept = [F.col(f"c{i}") for i in self.kept] or [F.lit(None).cast("int").alias("none")]
        self.rec = F.struct(*kept).alias("rec")

    def _at(self, name: str) -> int:
        found = [i for i, c in enumerate(self.names) if c == name] or [i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns are named {name!r}; there are {self.names}")
        return found[0]

    def field(self, name: str) -> str:
        return f"c{self._at(name)}"

    def col(self, name: str) -> Column:
        return F.col(self.field(name))

    def holds(self, name: str) -> bool:
        return self._at(name) in self.kept

    def type_of_rec(self) -> DataType:
        return self.rows.select(self.rec).schema["rec"].dataType

    def schema(self, rest: str) -> StructType:
        """rec and the columns of a DDL text, for functions of Arrow batches."""
        return StructType([StructField("rec", self.type_of_rec()), *StructType.fromDDL(rest).fields])

    def out(self, df: DataFrame) -> DataFrame:
        if not self.kept:
            return df
        named = StructType([StructField(self.names[i], self.fields[i].dataType) for i in self.kept])
        return df.withColumn("rec", F.col("rec").cast(named))


def without(table: DataFrame, name: str) -> list[str]:
    return [c for c in table.columns if c != name]


def row_keys(rows: DataFrame, row_id: Column, text: Column) -> list[Column]:
    """key, uid, sum: what tells the rows of a table apart. Rows with equal ids and texts share one identity.

    key is the id, a null id larger than all others. Where it is known that an id occurs
    once, uid and sum are 0, which costs nothing when packed; else they are two 64-bit hashes
    of id and text. Ids that occur more than once are counted over all rows and marked
    in ``ID_SLOTS`` slots, so that what comes to the driver is bounded; a slot that many
    ids share costs its other rows their hashes, no more.
    """
    key = F.coalesce(row_id.cast("long"), F.lit(LAST))
    slot = F.pmod(F.xxhash64("key"), F.lit(ID_SLOTS)).cast("int")
    # At most ID_SLOTS rows.
    marked = rows.select(key.alias("key")).groupBy("key").count().filter("count > 1").select(slot.alias("slot")).distinct().collect()
    if not marked:
        return [key.alias("key"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("sum")]
    words = [0] * (ID_SLOTS // 63 + 1)
    for row in marked:
        words[row.slot // 63] |= 1 << row.slot % 63
    own = F.pmod(F.xxhash64(key), F.lit(ID_SLOTS)).cast("int")
    often = F.getbit(F.element_at(F.lit(words).cast("array<long>"), (F.floor(own / 63) + 1).cast("int")), own % 63) == 1
    made = lambda *x: F.when(often, F.xxhash64(*x)).otherwise(F.lit(0).cast("long"))
    return [key.alias("key"), made(key, text).alias("uid"), made(F.lit(1), text, key).alias("sum")]
