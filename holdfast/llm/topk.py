"""Exact top-k search by inner product with the threshold algorithm.

Vectors are cut into blocks. A block sorts its vectors once per dimension. For a
query each list is walked from its best end (largest components where the query
is positive, smallest where it is negative), new vectors are scored in full, and
the walk stops when the threshold - the score of a vector that had the current
value of every list - is below the kth score found: no unseen vector can reach
it, not even a tie. Each block's k best go to a merge per query.

Equal vectors of a block are one entry with its k + 1 smallest ids, so a group of
copies is walked once. The queries are a stated subset of the rows; they meet
the blocks in chunks, so a task holds one block and one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK = 8192  # vectors
CHUNK = 512  # queries
STEP = 32  # depth of the first walk; each further one is twice as deep


def quantised(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(F.forall(vector, finite), whole)


def _exact_type(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The cheapest type in which no inner product is rounded."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Lists:
    """A block's distinct vectors with their ids, sorted by every dimension both ways."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, kind: type):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * max(1, vectors.shape[1]))))
        _, first, group = np.unique(whole.reshape(-1), return_index=True, return_inverse=True)
        # ids by group, ascending; copies of one row (same id) count once
        by_group = np.lexsort((ids, group))
        g, i = group[by_group], ids[by_group]
        once = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
        g, i = g[once], i[once]
        begin = np.searchsorted(g, np.arange(len(first)))
        near = np.arange(len(g)) - begin[g] <= k
        self.ids, self.group = i[near], g[near]
        self.begin = np.searchsorted(self.group, np.arange(len(first) + 1))
        self.vectors = vectors[first].astype(kind)
        rising = np.argsort(self.vectors, axis=0, kind="stable").T
        self.walks = np.stack([rising, rising[:, ::-1]])
        values = np.take_along_axis(self.vectors.T, rising, axis=1)
        self.values = np.stack([values, values[:, ::-1]])

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for a query, ties to smaller ids."""
        n, d = self.vectors.shape
        way, dims = (query >= 0).astype(np.int64), np.arange(d)
        scores = np.zeros(n, dtype=np.float64 if self.vectors.dtype.kind == "f" else np.int64)
        seen = np.zeros(n, dtype=bool)
        done, depth, step = seen.copy(), 0, STEP
        while True:
            seen[self.walks[way, dims, depth : depth + step]] = True
            fresh = np.flatnonzero(seen & ~done)
            scores[fresh] = self.vectors[fresh] @ query
            done[fresh] = True
            depth = min(depth + step, n)
            step *= 2
            ids, found = self._best(np.flatnonzero(done), scores, own, k)
            if depth >= n or done.all():
                return ids, found
            if len(ids) == k and found[-1] > float(self.values[way, dims, depth - 1] @ query):
                return ids, found

    def _best(self, groups: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(groups) > k + 1:  # at most one group is the query's own alone
            least = np.partition(scores[groups], len(groups) - k - 1)[len(groups) - k - 1]
            groups = groups[scores[groups] >= least]
        entries = np.concatenate([np.arange(self.begin[g], self.begin[g + 1]) for g in groups])
        entries = entries[self.ids[entries] != own]
        found = scores[self.group[entries]]
        order = np.lexsort((self.ids[entries], -found))[:k]
        return self.ids[entries][order], found[order]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = column.combine_chunks().flatten()
    return np.asarray(values).astype(np.int64).reshape(rows, -1)


def _search(k: int):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "part": [], "vec_id": [], "score": []}
        if block.num_rows and queries.num_rows:
            vectors, wanted = _matrix(block["vector"], block.num_rows), _matrix(queries["vector"], queries.num_rows)
            kind = _exact_type(vectors, wanted)
            lists = Lists(np.asarray(block["vec_id"]), vectors, k, kind)
            parts = queries["part"].to_pylist()
            for query_id, part, query in zip(queries["vec_id"].to_pylist(), parts, wanted.astype(kind)):
                ids, scores = lists.top(query, query_id, k)
                out["query_id"] += [query_id] * len(ids)
                out["part"] += [part] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += [int(s) for s in scores]
        schema = pa.schema([(c, pa.int64()) for c in out])
        return pa.Table.from_pydict(out, schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each query.

    Both tables have vec_id and vector (an array of whole numbers, without null
    components). Rows with a null id, or a null or empty vector, take no part. A query meets
    vectors of its own length only, and none of its own id. Ties go to the
    smaller vec_id. Rows equal in both columns are one row; of rows that share an
    id but not the vector, each is a candidate and each a query. Fewer than k
    candidates are all returned, without any the query has no row.
    """
    # by vector as well: queries that share an id stay apart
    part = F.xxhash64("vec_id", "vector").alias("part")
    whole = lambda df: df.select("vec_id", "vector").filter("vec_id IS NOT NULL AND size(vector) > 0")
    vectors = whole(vectors).withColumn("size", F.size("vector"))
    queries = whole(queries).withColumn("size", F.size("vector")).dropDuplicates(["vec_id", "vector"])
    blocks = vectors.count() // BLOCK + 1
    chunks = queries.count() // CHUNK + 1
    number = lambda n: F.sequence(F.lit(0), F.lit(int(n) - 1))
    block, chunk = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id"), F.lit(chunks))
    dealt = vectors.select("size", block.cast("int").alias("block"), F.explode(number(chunks)).alias("chunk"), "vec_id", "vector")
    asked = queries.select("size", F.explode(number(blocks)).alias("block"), chunk.cast("int").alias("chunk"), "vec_id", "vector", part)
    keys = ["size", "block", "chunk"]
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k), "query_id long, part long, vec_id long, score long")
    best = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised().alias("vector"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
