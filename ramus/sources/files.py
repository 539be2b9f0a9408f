"""Readers and writers of plain-text points, sequences, graphs, meshes and sparse matrices.

Readers give tables with explicit positions or ids, as order is part of these formats.
Tokens are what stands between white space; a token that isn't a number makes the
reader fail when the column is used (ANSI casts), it isn't read as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.operators.graphs import csr_offsets
from ramus.operators.sequences import with_rank
from ramus.operators.storage import cut

SPACE, SPACE_OR_COMMA = r"[ \t\r\n\x00]+", r"[ \t\r\n\x00,]+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0, in the order of the file), value. Line numbers come from the splits' own order."""
    return spark.createDataFrame(spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1], x[0])), "line long, value string")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, value: each file as one string; a file is held whole by its task."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def tokens(spark: SparkSession, path: str, separators: str = SPACE) -> DataFrame:
    """pos, token over the whole file; the lines don't matter."""
    split = lines(spark, path).select("line", F.posexplode(F.array_remove(F.split("value", separators), "")).alias("k", "token"))
    return with_rank(split, ["line", "k"]).select("pos", "token")


def _headed(spark: SparkSession, path: str, header: str | None = None, separators: str = SPACE) -> DataFrame:
    """Tokens after the header word, numbered from 0."""
    all_tokens = tokens(spark, path, separators)
    if header is not None:
        found = all_tokens.filter("pos = 0").first()
        if not found or found.token != header:
            raise ValueError(f"{path} starts with {found.token if found else 'nothing'!r}, not {header!r}")
    # Cut here, so that no cast of what follows is tried on the header.
    return cut(all_tokens.filter("pos > 0").select((F.col("pos") - 1).alias("pos"), "token"))


def _rows(tokens: DataFrame, width: int, kinds: list[str], names: list[str]) -> DataFrame:
    """Each ``width`` tokens as a row: id and the named columns."""
    at = F.col("pos") % width
    cells = [F.max(F.when(at == k, F.col("token"))).cast(kind).alias(name) for k, (kind, name) in enumerate(zip(kinds, names))]
    return tokens.groupBy(F.floor(F.col("pos") / width).alias("id")).agg(*cells)


def read_points(spark: SparkSession, path: str, dim: int | None = None, limit: int | None = None, separators: str = SPACE) -> DataFrame:
    """id, v. With ``dim``, points are runs of so many tokens, whatever the lines; else a line is a point."""
    if dim is None:
        v = F.transform(F.array_remove(F.split("value", separators), ""), lambda x: x.cast("double"))
        out = lines(spark, path).select("line", v.alias("v")).filter(F.size("v") > 0)
        out = with_rank(out, ["line"], "id").select("id", "v")
    else:
        at = F.struct((F.col("pos") % dim).alias("k"), F.col("token").cast("double").alias("x"))
        grouped = tokens(spark, path, separators).groupBy(F.floor(F.col("pos") / dim).alias("id")).agg(F.sort_array(F.collect_list(at)).alias("c"))
        out = grouped.filter(F.size("c") == dim).select("id", F.col("c.x").alias("v"))
    return out if limit is None else out.filter(F.col("id") < limit)


def read_headed_points(spark: SparkSession, path: str) -> DataFrame:
    """id, v of a file that starts with pbbs_sequencePoint<d>d."""
    first = tokens(spark, path).filter("pos = 0").first()
    dim = int(first.token.removeprefix("pbbs_sequencePoint").removesuffix("d")) if first else 1
    at = F.struct((F.col("pos") % dim).alias("k"), F.col("token").cast("double").alias("x"))
    grouped = _headed(spark, path).groupBy(F.floor(F.col("pos") / dim).alias("id")).agg(F.sort_array(F.collect_list(at)).alias("c"))
    return grouped.select("id", F.col("c.x").alias("v"))


def read_csv_points(spark: SparkSession, path: str, header: bool = False, limit: int | None = None) -> DataFrame:
    """id, v of comma-separated lines."""
    found = lines(spark, path).filter("trim(value) <> ''")
    if header:
        found = found.filter("line > 0")
    v = F.transform(F.split("value", r"\s*,\s*"), lambda x: F.trim(x).cast("double"))
    out = with_rank(found.select("line", v.alias("v")), ["line"], "id").select("id", "v")
    return out if limit is None else out.filter(F.col("id") < limit)


# Header words of sequence files, with their columns.
SEQUENCES = {
    "sequenceInt": (["long"], ["value"]),
    "sequenceDouble": (["double"], ["value"]),
    "sequenceChar": (["string"], ["value"]),
    "sequenceIntPair": (["long", "long"], ["first", "second"]),
    "sequenceStringIntPair": (["string", "long"], ["first", "second"]),
}


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """id and the columns that the file's header word names."""
    first = tokens(spark, path).filter("pos = 0").first()
    if not first or first.token not in SEQUENCES:
        raise ValueError(f"{path} has no known header word")
    kinds, names = SEQUENCES[first.token]
    return _rows(_headed(spark, path), len(kinds), kinds, names)


def read_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """id, u, v[, w] of EdgeArray and WeightedEdgeArray files."""
    header = "WeightedEdgeArray" if weighted else "EdgeArray"
    kinds, names = ["long", "long", "double"][: 2 + weighted], ["u", "v", "w"][: 2 + weighted]
    return _rows(_headed(spark, path, header), len(kinds), kinds, names)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """u, v of an AdjacencyGraph file: n, m, n offsets, m targets."""
    body = _headed(spark, path, "AdjacencyGraph").select("pos", F.col("token").cast("long").alias("x"))
    n, m = (r.x for r in body.filter("pos < 2").orderBy("pos").collect())
    starts = body.filter((F.col("pos") >= 2) & (F.col("pos") < 2 + n)).select((F.col("pos") - 2).alias("u"), F.col("x").alias("start"))
    # Where the next vertex starts; a row for each vertex, joined on neighbouring numbers.
    after = starts.select((F.col("u") - 1).alias("u"), F.col("start").alias("end"))
    spans = starts.join(after, "u", "left").select("u", "start", F.coalesce("end", F.lit(m)).alias("end")).filter("end > start")
    places = spans.select("u", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("e"))
    targets = body.filter(F.col("pos") >= 2 + n).select((F.col("pos") - 2 - n).alias("e"), F.col("x").alias("v"))
    return places.join(targets, "e").select("u", "v")


def read_triangles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, v) points and (t, a, b, c) triangles of a pbbs_triangles file."""
    body = _headed(spark, path, "pbbs_triangles")
    n, _ = (int(r.token) for r in body.filter("pos < 2").orderBy("pos").collect())
    points = _rows(body.filter((F.col("pos") >= 2) & (F.col("pos") < 2 + 2 * n)).withColumn("pos", F.col("pos") - 2), 2, ["double", "double"], ["x", "y"])
    triangles = _rows(body.filter(F.col("pos") >= 2 + 2 * n).withColumn("pos", F.col("pos") - 2 - 2 * n), 3, ["long"] * 3, ["a", "b", "c"])
    return points.select("id", F.array("x", "y").alias("v")), triangles.withColumnRenamed("id", "t")


def _numbered(spark: SparkSession, path: str) -> tuple[list[int], DataFrame]:
    """The numbers of the first line, and line, k (from 0), t (fields) of the rows after it; '#' starts a comment."""
    body = lines(spark, path).withColumn("value", F.trim(F.regexp_replace(F.regexp_replace("value", "#.*", ""), SPACE, " "))).filter("value <> ''")
    body = cut(body.select("line", F.split("value", " ").alias("t")))
    first = body.orderBy("line").first()
    if first is None:
        raise ValueError(f"{path} has no header line")
    rows = body.filter(F.col("line") > first.line)
    head = [int(x) for x in first.t]
    if rows.count() != head[0]:
        raise ValueError(f"{path} tells {head[0]} rows and has another number of them")
    least = rows.agg(F.min(F.col("t")[0].cast("long"))).first()[0] or 0
    return head, rows.select((F.col("t")[0].cast("long") - least).alias("k"), F.lit(least).alias("least"), "t")


def read_node_ele(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, v) points of path.node and (t, a, b, c) triangles of path.ele.

    Files may number from 0 or 1; here points and triangles count from 0. Attributes,
    markers and further corners of a row are left out.
    """
    head, nodes = _numbered(spark, f"{path}.node")
    dims = head[1] if len(head) > 1 else 2
    points = nodes.select(F.col("k").alias("id"), F.transform(F.slice("t", 2, dims), lambda x: x.cast("double")).alias("v"))
    least = nodes.agg(F.max("least")).first()[0] or 0
    corner = lambda j: F.get("t", F.lit(j)).cast("long") - least
    _, rows = _numbered(spark, f"{path}.ele")
    return points, rows.select(F.col("k").alias("t"), *(corner(j).alias(c) for j, c in enumerate("abc", 1)))


def without_last_points(points: DataFrame, triangles: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both without the last n points (ids from 0), which close the hull in some files, and the triangles at them."""
    keep = points.count() - n
    return points.filter(F.col("id") < keep), triangles.filter(F.greatest("a", "b", "c") < keep)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """u, v, w from 0, without zeros and comment lines."""
    body = lines(spark, path).filter("NOT value LIKE '!%%' ESCAPE '!' AND trim(value) <> ''")
    first = body.agg(F.min("line")).first()[0]
    t = F.split(F.trim("value"), r"\s+")
    w = F.coalesce(F.get(t, 2).cast("double"), F.lit(1.0))
    return body.filter(F.col("line") > first).select((t[0].cast("long") - 1).alias("u"), (t[1].cast("long") - 1).alias("v"), w.alias("w")).filter("w <> 0")


def read_binary_csr(spark: SparkSession, path: str) -> DataFrame:
    """u, v of int32 files: rows, columns, entries, rows + 1 starts, targets. Files are read one to a task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                x = np.frombuffer(content, "<i4")
                rows, entries = int(x[0]), int(x[2])
                starts, targets = x[3 : 4 + rows], x[4 + rows : 4 + rows + entries]
                yield pd.DataFrame({"u": np.repeat(np.arange(rows), np.diff(starts)).astype("int64"), "v": targets.astype("int64")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "u long, v long")


def uniform_points(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """id, v in the unit cube; a coordinate depends on id, dimension and seed alone."""
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), F.lit(1 << 52)) / float(1 << 52)
    return spark.range(n).select("id", F.array(*(unit(k) for k in range(dim))).alias("v"))


def is_number(token: Column | str) -> Column:
    """True for decimal numbers with an optional sign, fraction and exponent."""
    return (F.col(token) if isinstance(token, str) else token).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def _text(columns: list[Column | str]) -> Column:
    return F.concat_ws(" ", *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns))


def write_lines(df: DataFrame, columns: list[str], path: str, order: list[str] | None = None, header: str | None = None) -> None:
    """Rows as space-separated lines, in the order of ``order`` across the part files, after a header line."""
    body = df.select(*(order or []), _text(list(columns)).alias("value"))
    if order:
        body = body.repartitionByRange(*order).sortWithinPartitions(*order)
    body = body.select("value")
    if header is not None:
        body = df.sparkSession.createDataFrame([(header,)], "value string").union(body)
    body.write.text(path)


def write_points(points: DataFrame, path: str, headed: bool = False) -> None:
    d = points.select(F.size("v")).first()
    header = f"pbbs_sequencePoint{d[0]}d" if headed and d else None
    write_lines(points.select("id", F.array_join(F.transform("v", lambda x: F.format_string("%.11e", x)), " ").alias("t")), ["t"], path, ["id"], header)


def write_edges(edges: DataFrame, path: str, weighted: bool = False) -> None:
    columns = ["u", "v", "w"] if weighted else ["u", "v"]
    write_lines(edges, columns, path, ["u", "v"], "WeightedEdgeArray" if weighted else "EdgeArray")


def _write_parts(parts: list[DataFrame], path: str, header: list[str]) -> None:
    """Lines (pos, value) of each part in order, one part after the other, after the header's lines."""
    spark = parts[0].sparkSession
    rows = spark.createDataFrame([(-1, k, line) for k, line in enumerate(header)], "part int, pos long, value string")
    for k, part in enumerate(parts):
        rows = rows.union(part.select(F.lit(k), F.col("pos").cast("long"), F.col("value").cast("string")))
    write_lines(rows, ["value"], path, ["part", "pos"])


def write_adjacency(edges: DataFrame, n: int, path: str) -> None:
    """An AdjacencyGraph file of edges (u, v) between 0 .. n - 1."""
    starts = csr_offsets(edges, n).select(F.col("row").alias("pos"), F.col("start").alias("value"))
    targets = with_rank(edges.select("u", "v"), ["u", "v"]).select("pos", F.col("v").alias("value"))
    _write_parts([starts, targets], path, ["AdjacencyGraph", str(n), str(edges.count())])


def write_triangles(points: DataFrame, triangles: DataFrame, path: str) -> None:
    """A pbbs_triangles file of planar points (id from 0, v) and triangles (t, a, b, c)."""
    corners = points.select(F.col("id").alias("pos"), F.array_join(F.transform("v", lambda x: F.format_string("%.11e", x)), " ").alias("value"))
    rows = triangles.select(F.col("t").alias("pos"), _text(["a", "b", "c"]).alias("value"))
    _write_parts([corners, rows], path, ["pbbs_triangles", str(points.count()), str(triangles.count())])


def write_dendrogram(rows: DataFrame, path: str) -> None:
    """Lines of id1 id2 height size, a merge each, in their order."""
    write_lines(rows, ["id1", "id2", F.format_string("%.20f", "height"), "size"], path, ["step"])


def write_merges(merges: DataFrame, path: str) -> None:
    """Lines of lo hi height, a merge each, by round and ids."""
    write_lines(merges, ["lo", "hi", "height"], path, ["round", "lo", "hi"])


def write_labels(labels: DataFrame, path: str) -> None:
    """Lines of id,label, in the order of ids."""
    write_lines(labels.select("id", F.concat_ws(",", "id", "label").alias("t")), ["t"], path, ["id"])
