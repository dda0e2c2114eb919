"""Exact cosine search over chunk embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.storage import settled

TOP = 10
DECIMALS = 6


class DimensionError(ValueError):
    """A vector of another length than the table's."""


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos, null where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def with_norms(chunks: DataFrame) -> DataFrame:
    """chunks with a column norm, for tables that are searched often."""
    return chunks.withColumn("norm", norm(F.col("embedding")))


def search(chunks: DataFrame, files: DataFrame, query: list[float], k: int = TOP, under: str | None = None, prefilter: bool = False, dim: int | None = None) -> DataFrame:
    """The k chunks nearest to a vector, with path, distance and similarity, nearest first.

    k <= 0 is 10; ties go by chunk_id; zero vectors are nowhere.  The k nearest are taken
    from all chunks, and those without a file or outside the folder `under` are dropped
    after, so fewer may come back; prefilter=True drops first.  Each task keeps k rows, and
    the query is a literal, so nothing is shuffled but k rows a task.
    """
    if dim is not None and len(query) != dim:
        raise DimensionError(f"the query has {len(query)} dimensions, the table {dim}")
    k = k if k > 0 else TOP
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    own = F.col("norm") if "norm" in chunks.columns else norm(F.col("embedding"))
    size = own * F.lit(length)
    rows = chunks.select("chunk_id", "file_id", "content_snippet", "start_line", "end_line", F.when(size > 0, 1 - dot(F.col("embedding"), q) / size).alias("distance")).filter("distance IS NOT NULL")
    paths = files.select(F.col("id").alias("file_id"), "path")
    if under is not None:
        paths = paths.filter(F.col("path").startswith(under.rstrip("/") + "/"))
    order = ("distance", "chunk_id")
    rows = rows.join(paths, "file_id").orderBy(*order).limit(k) if prefilter else rows.orderBy(*order).limit(k).join(paths, "file_id").orderBy(*order)
    return rows.select("chunk_id", "file_id", "path", "content_snippet", "start_line", "end_line", "distance", (1 - F.col("distance")).alias("similarity"))


class ChunkError(KeyError):
    """A chunk that isn't there."""


def chunk_distance(chunks: DataFrame, a: int, b: int, strict: bool = False) -> DataFrame:
    """The distance of two chunks; no row if either is missing, or with `strict` an error."""
    one = chunks.filter(F.col("chunk_id") == a).select(F.lit(1).alias("_k"), F.col("embedding").alias("a"))
    two = chunks.filter(F.col("chunk_id") == b).select(F.lit(1).alias("_k"), F.col("embedding").alias("b"))
    if strict and (missing := [i for i, rows in ((a, one), (b, two)) if rows.isEmpty()]):
        raise ChunkError(missing[0])
    return one.join(two, "_k").select(cosine_distance(F.col("a"), F.col("b")).alias("distance"))


def neighbours(hits: DataFrame, entities: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """hit, chunk_id, total_weight, relation: the chunks that entities of each hit
    (chunk_id) lead to over `depth` edges or fewer.

    Weights are those of the last edges, and a chunk counts where it is first met.  A hop
    starts from the few entities of the hits, so edges are only looked up.
    """
    inside = entities.select(F.col("id").alias("_i"), F.col("chunk_id").alias("_c"))
    ids = hits.select(F.col("chunk_id").alias("hit")).distinct()
    front = inside.join(F.broadcast(ids), F.col("_c") == F.col("hit"), "inner").select("hit", F.col("_i").alias("at"))
    seen, out = ids.select("hit", F.col("hit").alias("chunk_id")), None
    for step in range(1, depth + 1):
        near = edges.join(front, F.col("source_entity_id") == F.col("at")).join(inside, F.col("target_entity_id") == F.col("_i"))
        found = near.groupBy("hit", F.col("_c").alias("chunk_id")).agg(F.sum("weight").alias("total_weight"), F.min("relation_type").alias("relation"))
        found = found.join(seen, ["hit", "chunk_id"], "left_anti")
        if depth > 1:
            found = settled(found, "neighbours")
        out = found if out is None else out.unionByName(found)
        if step < depth:
            front = settled(near.select("hit", F.col("target_entity_id").alias("at")).distinct(), "front")
            seen = seen.unionByName(found.select("hit", "chunk_id"))
    return out


def search_with_relations(chunks: DataFrame, files: DataFrame, query: list[float], k: int = TOP, under: str | None = None, entities: DataFrame | None = None, edges: DataFrame | None = None, limit: int = 5, min_weight: float = 0.0, depth: int = 1) -> DataFrame:
    """search() with related, an array of chunks.

    Without entities and edges it is empty, as it is in the plain engine; with them it
    has up to `limit` chunks that entities of the hit lead to over `depth` edges, the
    heaviest first.
    """
    hits = search(chunks, files, query, k, under)
    shape = "array<struct<chunk_id:bigint,total_weight:double,relation:string>>"
    if entities is None or edges is None:
        return hits.withColumn("related", F.array().cast(shape))
    hits = settled(hits, "hits")  # k rows: what follows starts from them
    summed = neighbours(hits, entities, edges, depth).filter(F.col("total_weight") >= min_weight)
    ranked = summed.groupBy("hit").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("total_weight")).alias("w"), "chunk_id", "relation"))), 1, limit).alias("r"))
    related = ranked.select(F.col("hit").alias("chunk_id"), F.transform("r", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), (-x["w"]).alias("total_weight"), x["relation"].alias("relation"))).cast(shape).alias("related"))
    return hits.join(related, "chunk_id", "left").withColumn("related", F.coalesce("related", F.array().cast(shape))).orderBy("distance", "chunk_id")
