"""Brute-force vector search, embedding by feature hashing, and goal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine, l2_norm, let


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (id, embedding and, if there is one, seq) replace those of the same id; of several of one id that of the largest seq,
    and among rows without an order the one whose embedding sorts last."""
    order = F.struct("seq", "embedding") if "seq" in rows.columns else F.col("embedding")
    return index.join(rows.select("id"), "id", "left_anti").unionByName(rows.groupBy("id").agg(F.max_by("embedding", order).alias("embedding")))


def remove(index: DataFrame, id: int) -> DataFrame:
    return index.where(F.col("id") != id)


def scores(index: DataFrame, query: list[float]) -> DataFrame:
    """id, score of every vector; none for a zero query. The query is a literal: no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = index.select("id", cosine(F.col("embedding"), q).alias("score"))
    return out if any(query) else out.limit(0)


def search(index: DataFrame, query: list[float], k: int = 10, least: float | None = None) -> DataFrame:
    """The k best of at least ``least``, scores alike to twelve places by id; the filter lies below the top-k."""
    s = scores(index, query)
    return (s.where(F.col("score") >= least) if least is not None and least > 0 else s).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def enrich(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(hits, "id").orderBy(F.desc("score"), "id")


def neighbors_of(index: DataFrame, id: int, k: int = 5) -> DataFrame:
    """The k most similar others of a score over .1, with a label."""
    row = index.where(F.col("id") == id).first()
    best = search(index, [float(x) for x in row["embedding"]] if row else [0.0], k + 1)
    return best.where((F.col("id") != id) & (F.col("score") > 0.1)).orderBy(F.desc("score"), "id").limit(k).withColumn("label", F.format_string("semantic(%.2f)", "score"))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A stand-in for a model, without one: signed counts of words hashed to ``dim`` places, of unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    part = lambda w, k: F.conv(F.substring(F.md5(w), k, 7), 16, 10).cast("long")
    places = F.transform(words, lambda w: F.struct(F.pmod(part(w, 1), F.lit(dim)).cast("int").alias("p"), F.when(part(w, 8) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = let(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter(ps, lambda x: x["p"] == d), F.lit(0.0), lambda a, x: a + x["s"])))
    scaled = lambda v, norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))
    return let(raw, lambda v: let(l2_norm(v), lambda norm: scaled(v, norm)))


def zero_embedding(dim: int = 64) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def index_nodes(nodes: DataFrame, text: Column, dim: int = 64) -> DataFrame:
    """id, embedding of nodes of kind File or Module."""
    return nodes.where(F.col("kind").isin("File", "Module")).select("id", hashed_embedding(text, dim).alias("embedding"))


#: Embedders by code; a model of one's own is a function from texts to vectors.
MODELS = (("feature-hash", 64, "signed word counts, no model"), ("zero", 64, "all zero, for tests"))


def available_models(spark) -> DataFrame:
    return spark.createDataFrame(MODELS, "code string, dim int, description string")


def node_header(nodes: DataFrame, depth: str = "fast", content: Column | None = None) -> Column:
    """What an index reads of a node: fast its kind, language and path; deep an excerpt of its content too."""
    from ..functions import code, scalars

    language = scalars.language("path")
    if depth not in ("fast", "deep"):
        raise ValueError(f"no such depth: {depth}")
    return code.node_text(F.col("kind"), language, F.col("path"), code.excerpt(content, language) if depth == "deep" and content is not None else None)


def bootstrap(store, nodes: DataFrame, depth: str = "fast", content: Column | None = None, dim: int = 64, force: bool = False):
    """The stored index and its meta, made and stored first if there is none: dim, model and depth go into the meta."""
    if force or store.load_vectors() is None:
        store.save_vectors(index_nodes(nodes, node_header(nodes, depth, content), dim), "feature-hash", dim, {"depth": depth})
    return store.load_vectors()


def search_stored(store, query: list[float], model: str, k: int = 10) -> tuple[DataFrame | None, str | None]:
    """Hits in the stored index, and a warning if it was made by another model; none without an index."""
    have = store.load_vectors()
    if have is None:
        return None, "there is no index"
    index, meta = have
    return search(index, query, k), None if meta["model"] == model else f"the index is of {meta['model']}, the query of {model}"


def semantic_enabled(index: DataFrame | None, model: str | None) -> bool:
    """Search by meaning needs an index with a row and a real model."""
    return index is not None and model not in (None, "zero") and not index.isEmpty()


def get(index: DataFrame, id: int) -> DataFrame:
    return index.where(F.col("id") == id)


def node_ids(index: DataFrame) -> DataFrame:
    return index.select("id")
