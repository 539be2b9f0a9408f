"""Batches of edits on a table of triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.operators.storage import Tables

EDITS = "edit long, kind string, t long, u long, v long, p long"
KINDS = ("flip", "split", "split_boundary", "extend")


def _sides(mesh: DataFrame) -> DataFrame:
    """least, most, s: each triangle's three sides x -> y with the corner z across, by their two ends."""
    side = lambda x, y, z: F.struct("t", F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    out = mesh.select(F.explode(F.array(side("a", "b", "c"), side("b", "c", "a"), side("c", "a", "b"))).alias("s"))
    return out.select(F.least("s.x", "s.y").alias("least"), F.greatest("s.x", "s.y").alias("most"), "s")


def _applicable(mesh: DataFrame, todo: DataFrame) -> DataFrame:
    """edit, kind, p, s, r: the edits that the mesh allows, with the side s they are at and the one across, r."""
    edges = todo.filter("kind <> 'split'").select("edit", "kind", "p", F.least("u", "v").alias("least"), F.greatest("u", "v").alias("most"))
    at = edges.join(_sides(mesh), ["least", "most"]).groupBy("edit", "kind", "p").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.max("s").alias("r"))
    two = (F.col("n") == 2) & (F.col("s.x") == F.col("r.y")) & (F.col("s.y") == F.col("r.x")) & (F.col("s.z") != F.col("r.z"))
    at = at.filter(F.when(F.col("kind") == "flip", two).otherwise(F.col("n") == 1))
    at = at.select("edit", "kind", "p", "s", F.when(F.col("kind") == "flip", F.col("r")).alias("r"))
    inside = todo.filter("kind = 'split'").join(mesh, "t")
    whole = F.struct("t", F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    return at.unionByName(inside.select("edit", "kind", "p", whole.alias("s"), F.lit(None).cast(dict(at.dtypes)["r"]).alias("r")))


def apply_edits(triangles: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triangles (t, a, b, c, counter-clockwise) after the edits, and edit, round of each edit (null: refused).

    edits: edit (unique, from 0; the smaller goes first), kind, and what the kind needs:

        flip            the edge u, v of two triangles becomes that of their other corners
        split           triangle t becomes three around the new point p
        split_boundary  the boundary edge u, v gets the point p, its triangle becomes two
        extend          the boundary edge u, v and the point p become a triangle

    In a round an edit is done if no smaller one touches any of its triangles; all others
    look again at the changed mesh. So edits far apart are done at once, and there are as
    many rounds as the longest chain of edits that wait for each other. An edit that never
    fits the mesh (no such triangle or edge, one side too few or too many, nulls) is refused.
    The first triangle of an edit keeps its t; new ones are numbered from the largest t
    and the edit. Points' places aren't looked at: a flip of a concave pair is the caller's.
    """
    unknown = edits.filter(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)).limit(1).count()
    if unknown:
        raise ValueError(f"edits of other kinds than {KINDS}")
    store = Tables(triangles.sparkSession, "mesh")
    mesh = store.put("mesh", triangles.select("t", "a", "b", "c"))
    todo = store.put("todo", edits.select("edit", "kind", "t", "u", "v", "p"))
    base = (mesh.agg(F.max("t")).first()[0] or 0) + 1
    new = lambda k, x, y, z: F.struct((F.lit(base) + F.col("edit") * 2 + k).alias("t"), x.alias("a"), y.alias("b"), z.alias("c"))
    old = lambda s, x, y, z: F.struct(F.col(f"{s}.t").alias("t"), x.alias("a"), y.alias("b"), z.alias("c"))
    x, y, z, w, p = F.col("s.x"), F.col("s.y"), F.col("s.z"), F.col("r.z"), F.col("p")
    made = (
        F.when(F.col("kind") == "flip", F.array(old("s", x, w, z), old("r", w, y, z)))
        .when(F.col("kind") == "split", F.array(old("s", x, y, p), new(0, y, z, p), new(1, z, x, p)))
        .when(F.col("kind") == "split_boundary", F.array(old("s", x, p, z), new(0, p, y, z)))
        .otherwise(F.array(old("s", x, y, z), new(0, y, x, p)))
    )
    done, round_no = None, 0
    while True:
        round_no += 1
        fit = store.put("fit", _applicable(mesh, todo).filter("p IS NOT NULL OR kind = 'flip'"))
        touched = fit.select("edit", F.explode(F.array_compact(F.array("s.t", "r.t"))).alias("t"))
        first = touched.groupBy("t").agg(F.min("edit").alias("_first"))
        holds = touched.join(first, "t").groupBy("edit").agg(F.min(F.col("edit") == F.col("_first")).alias("_all")).filter("_all")
        chosen = store.put(f"done{round_no}", fit.join(holds.select("edit"), "edit", "left_semi"))
        if chosen.isEmpty():
            break
        gone = chosen.select(F.explode(F.array_compact(F.array("s.t", "r.t"))).alias("t"))
        mesh = store.put("mesh", mesh.join(gone, "t", "left_anti").unionByName(chosen.select(F.inline(made))))
        todo = store.put("todo", todo.join(chosen.select("edit"), "edit", "left_anti"))
        rows = chosen.select("edit", F.lit(round_no).cast("long").alias("round"))
        done = rows if done is None else done.unionByName(rows)
    refused = todo.select("edit", F.lit(None).cast("long").alias("round"))
    return mesh, refused if done is None else done.unionByName(refused)
