"""Vector top-k, keyword recall, rank fusion and hybrid search."""

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keepsake.functions import scalars as S
from keepsake.functions.text import strip
from keepsake.operators.blocks import first_n, top_n
from keepsake.operators.keyword import match_terms

#: Columns that a search may be limited by.
FILTERS = ("domain", "type", "category_id")
#: Rows and queries that meet in one task.
ROW_BLOCK, QUERY_BLOCK = 65_536, 8_192


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column to a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best_k(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest similarities, ties by id."""
    if len(sims) > k:
        cut = np.partition(sims, len(sims) - k)[len(sims) - k]
        keep = np.flatnonzero(sims >= cut)
    else:
        keep = np.arange(len(sims))
    return keep[np.lexsort((ids[keep], -sims[keep]))][:k]


def vector_topk(vectors: DataFrame, query: DataFrame, k: int, where: Column | None = None,
                id_: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows to one query vector (``query`` has one row, column ``qe``)."""
    if where is not None:
        vectors = vectors.filter(where)
    return first_n(vectors.join(F.broadcast(query)).withColumn("sim", S.dot(vector, "qe")).drop(vector, "qe"),
                   [F.desc("sim"), F.col(id_)], k, "rank")


def best_of_rows(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest finite values of each row, ties by id."""
    n = sims.shape[1]
    cut = np.partition(sims, n - k, axis=1)[:, n - k] if n > k else np.full(len(sims), -np.inf)
    row, col = np.nonzero((sims >= cut[:, None]) & np.isfinite(sims))
    order = np.lexsort((ids[col], -sims[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def knn_scan(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "chunk_id",
             vector: str = "embedding", query_id: str = "query_id", query_vector: str = "qe",
             scope: str | list[str] | None = None) -> DataFrame:
    """The k nearest rows for every query of a query table, exact, ranked per query.

    Vectors have unit length (see ``l2_normalize``), so the inner product is the cosine. With ``scope``, one or several
    columns of both tables, a query only sees rows that agree with it in each; a null of the query's sees all. Rows and queries are cut into blocks
    by hash, as many as their counts ask for; each block of rows meets each block of queries in one task, which
    returns its own best k per query. Nothing but the two counts reaches the driver.
    """
    scopes = [scope] if isinstance(scope, str) else list(scope or [])
    group = F.array(*[F.col(c).cast("string") for c in scopes]).cast("array<string>")
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"), group.alias("s")).filter(
        F.col("v").isNotNull())
    rows = vectors.select(F.col(id_).alias("i"), F.col(vector).alias("v"), group.alias("s")).filter(
        F.col("v").isNotNull())
    row_blocks = max(1, -(-rows.count() // ROW_BLOCK))
    query_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))      # noqa: E731
    left = q.select("*", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int").alias("qb"),
                    spread(row_blocks).alias("rb"))
    right = rows.select("*", F.pmod(F.xxhash64("i"), F.lit(row_blocks)).cast("int").alias("rb"),
                        spread(query_blocks).alias("qb"))
    id_type, query_type = vectors.schema[id_].dataType, queries.schema[query_id].dataType
    schema = StructType([StructField(query_id, query_type), StructField(id_, id_type),
                         StructField("sim", DoubleType())])

    def multiply(asked: pa.Table, there: pa.Table) -> pa.Table:
        names = [query_id, id_, "sim"]
        if not asked.num_rows or not there.num_rows:
            return pa.table([asked["q"].slice(0, 0), there["i"].slice(0, 0), pa.array([], pa.float64())], names=names)
        ids = there["i"].to_numpy()
        own = [np.array(x, dtype=object) for x in zip(*there["s"].to_pylist())]      # one array for each scope
        m, parts = matrix(there["v"]), []
        for at in range(0, asked.num_rows, 256):       # similarity strips of bounded memory
            strip = asked.slice(at, 256)
            sims = matrix(strip["v"]) @ m.T
            for j, wanted in enumerate(strip["s"].to_pylist()):
                for held, s in zip(own, wanted):
                    if s is not None:
                        sims[j, held != s] = -np.inf
            row, col = best_of_rows(sims, ids, k)
            parts.append(pa.table([strip["q"].take(pa.array(row)), there["i"].take(pa.array(col)),
                                   pa.array(sims[row, col])], names=names))
        return pa.concat_tables(parts)

    out = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(multiply, schema)
    return top_n(out, [query_id], [F.desc("sim"), F.col(id_)], k, "rank")


def keyword_topk(chunks: DataFrame, term: str, k: int, id_: str = "chunk_id", content: str = "content") -> DataFrame:
    """Chunks that contain the trimmed term, case-insensitive, by id. Blank terms find nothing."""
    term = term.strip().lower()
    found = F.contains(F.lower(content), F.lit(term)) if term else F.lit(False)
    return first_n(chunks.filter(found).select(id_), [F.col(id_)], k, "rank")


def keyword_batch(chunks: DataFrame, queries: DataFrame, k: int, id_: str = "chunk_id",
                  content: str = "content", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Keyword recall for a query table: one pass over the texts for all terms."""
    terms = queries.select(query_id, strip(query).alias(query))
    hits = match_terms(chunks, id_, content, terms, query_id, query)
    return top_n(hits, [query_id], [F.col(id_)], k, "rank")


def fuse(lists: list[DataFrame], by: list[str], id_: str = "chunk_id", k: float = S.RRF_K) -> DataFrame:
    """Reciprocal rank fusion. Earlier lists win ties, then the smaller id."""
    parts = [df.select(*by, id_, F.col("rank"), F.lit(i).alias("_list")) for i, df in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*by, id_).agg(F.sum(S.rrf_term("rank", k)).alias("score"),
                                       F.min("_list").alias("_list"))


def hybrid_search(chunks: DataFrame, vectors: DataFrame, items: DataFrame, queries: DataFrame, k: int = 8,
                  prefilter: bool = False) -> DataFrame:
    """Hybrid search for a table of queries.

    ``chunks(chunk_id, item_id, content)``, ``vectors(chunk_id, embedding, domain)``,
    ``items(id, domain, type)``, ``queries(query_id, query, qe, domain)`` where a null ``qe`` leaves keywords only.
    ``queries`` may also have ``type`` and ``category_id``, which ``vectors`` and ``items`` then have too. All of them are
    filters; a null doesn't filter. Per query: vector top 2k among the rows that pass, keyword top 2k (over all rows
    unless ``prefilter``), fusion, first 2k fused, filters re-checked on the items, first k.
    """
    queries = queries.filter(strip(F.coalesce("query", F.lit(""))) != "")
    wide = 2 * k
    filters = [c for c in FILTERS if c in queries.columns]
    vec = knn_scan(vectors, queries, wide, scope=filters)
    wanted = queries.select("query_id", *[F.col(c).alias(f"_want_{c}") for c in filters])
    passes = reduce(and_, [F.col(f"_want_{c}").isNull() | (F.col(c) == F.col(f"_want_{c}")) for c in filters], F.lit(True))
    shown = list(dict.fromkeys(["domain", "type", *filters]))
    there = items.select(F.col("id").alias("item_id"), *shown)
    if prefilter:
        source = chunks.join(there, "item_id")
        hits = match_terms(source, "chunk_id", "content", queries.select("query_id", strip("query").alias("query")),
                           "query_id", "query")
        hits = hits.join(source.select("chunk_id", *shown), "chunk_id").join(wanted, "query_id").filter(passes)
        kw = top_n(hits.select("query_id", "chunk_id"), ["query_id"], [F.col("chunk_id")], wide, "rank")
    else:
        kw = keyword_batch(chunks, queries, wide)
    order = [F.desc("score"), F.col("_list"), F.col("chunk_id")]
    fused = top_n(fuse([vec, kw], ["query_id"]), ["query_id"], order, wide, "_fused")
    rows = (fused.join(chunks.select("chunk_id", "item_id"), "chunk_id").join(there, "item_id")
            .join(wanted, "query_id").filter(passes))
    return top_n(rows, ["query_id"], order, k, "rank").select(
        "query_id", "rank", "chunk_id", "item_id", "domain", "type", F.round("score", 6).alias("score"))


def hybrid_search_one(chunks: DataFrame, vectors: DataFrame, items: DataFrame, query: str, vector: DataFrame | None,
                      k: int = 8, domain: str | None = None, type: str | None = None,
                      category_id: int | None = None) -> DataFrame:
    """Hybrid search for one query text and its vector (one row, column ``qe``; None leaves keywords only).

    Same result as ``hybrid_search``: two top-2k scans, fused over at most 4k rows. The filters are columns of
    ``vectors`` and ``items`` and reach the scan of the vectors.
    """
    wide = 2 * k
    filters = {c: v for c, v in zip(FILTERS, (domain, type, category_id)) if v is not None}
    passes = reduce(and_, [F.col(c) == v for c, v in filters.items()], F.lit(True))
    lists = [keyword_topk(chunks, query, wide)]
    if vector is not None:
        lists.insert(0, vector_topk(vectors, vector.select("qe"), wide, passes).select("chunk_id", "rank"))
    order = [F.desc("score"), F.col("_list"), F.col("chunk_id")]
    # the list number keeps its place when the vector list is missing
    fused = first_n(fuse(lists, []), order, wide, "_fused")
    near = chunks.select("chunk_id", "item_id").join(F.broadcast(fused), "chunk_id")       # 2k rows
    rows = items.filter(passes).select(F.col("id").alias("item_id"), "domain", "type").join(F.broadcast(near), "item_id")
    return first_n(rows, order, k, "rank").select(
        "rank", "chunk_id", "item_id", "domain", "type", F.round("score", 6).alias("score"))


def search_page(hits: DataFrame, page: int, size: int) -> DataFrame:
    """A page of ranked hits; page from 1, size 1..100."""
    page, size = max(1, page), min(100, max(1, size))
    return hits.filter(F.col("rank").between((page - 1) * size + 1, page * size))


def similar_rows(vectors: DataFrame, id_value: int, k: int, id_: str = "chunk_id",
                 vector: str = "embedding") -> DataFrame:
    """Nearest rows to a stored row's own vector, the row itself excluded."""
    own = vectors.filter(F.col(id_) == id_value).select(F.col(vector).alias("qe"))
    return vector_topk(vectors, own, k, F.col(id_) != id_value, id_, vector)


# ---- embedding ------------------------------------------------------------

class HashEncoder:
    """Deterministic stand-in encoder: equal text, equal vector; other text nearly orthogonal."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        from hashlib import shake_128

        raw = b"".join(shake_128(t.encode()).digest(2 * self.dim) for t in texts)
        m = np.frombuffer(raw, dtype="<u2").astype(np.float32).reshape(len(texts), self.dim) - 32767.5
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def embed(df: DataFrame, text: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
          out: str = "embedding") -> DataFrame:
    """Add a vector per row. The encoder is built once per Python worker, fed Arrow batches."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield pd.Series(list(encoder(texts.fillna("").tolist()))) if len(texts) else pd.Series([], dtype=object)

    return df.withColumn(out, encode(F.col(text)))


def reindex(chunks: DataFrame, make_encoder: Callable, text: str = "content") -> DataFrame:
    """Vectors for every text chunk; the chunk is marked as embedded."""
    return embed(chunks.filter(F.col(text).isNotNull()), text, make_encoder).withColumn(
        "embed_status", F.lit("done"))


def image_backfill(chunks: DataFrame, make_encoder: Callable, path: str = "media_path") -> DataFrame:
    """Pending images get a vector; rows without a usable path, or whose encoding fails, are marked as skipped.

    Only usable paths reach the encoder.
    """
    usable = F.coalesce(F.lower(path).rlike(r"\.(jpg|jpeg|png|webp|gif|bmp)$"), F.lit(False))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()

        def one(value):
            try:
                return encoder([value])[0]
            except Exception:  # noqa: BLE001  a broken image costs its own vector only
                return None

        for paths in batches:
            yield pd.Series([None if pd.isna(p) else one(p) for p in paths], dtype=object)

    out = chunks.withColumn("embedding", encode(F.when(usable, F.col(path))))
    return out.withColumn("embed_status", F.when(F.col("embedding").isNotNull(), "done").otherwise("skipped"))


