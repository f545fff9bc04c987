"""The best vectors of each query, scored in blocks: both sides are dealt to blocks, each pair of blocks is one group of a join.

A group holds at most about ``QUERY_BLOCK`` queries and ``VECTOR_BLOCK`` vectors and is scored by matrix products inside its
task; only the best of each group are shuffled again. Nothing is broadcast but the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Queries and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16384
#: Terms of queries and of points in a block of a sparse search.
WEIGHT_BLOCK, ENTRY_BLOCK = 1 << 17, 1 << 20
#: Pairs that are scored at once.
PAIRS = 1 << 21
DIGITS = 8


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the lists, and of every element its row, place and value; null lists are empty, null elements NaN."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(), dtype=np.int64)
    values = pc.list_flatten(column).to_numpy().astype(np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return sizes, rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes), values


def _vectors(column: pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrix of ``width`` columns, lengths, sizes and which rows have no length (or a null): these score 0 with all."""
    sizes, rows, places, values = _flat(column)
    width = int(sizes.max(initial=0)) if width is None else width
    norms = np.sqrt(np.bincount(rows, weights=values * values, minlength=len(sizes)))
    void = norms == 0
    void[rows[pc.is_null(pc.list_flatten(column)).to_numpy()]] = True
    matrix = np.zeros((len(sizes), width))
    inside = places < width
    matrix[rows[inside], places[inside]] = values[inside]
    matrix[void], norms[void] = 0.0, 1.0
    return matrix, norms, sizes, void


def cosines(queries: pa.Table, vectors: pa.Table) -> Callable:
    """A function of a slice of queries and the positions of vectors: their cosines; -inf for vectors of another size (null)."""
    a, a_norms, a_sizes, a_void = _vectors(queries["query"])
    b, b_norms, b_sizes, b_void = _vectors(vectors["embedding"], a.shape[1])

    def score(part: slice, at: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            out = (a[part] @ b[at].T) / (a_norms[part, None] * b_norms[None, at])
        odd = (a_sizes[part, None] != b_sizes[None, at]) & ~a_void[part, None] & ~b_void[None, at]
        out[odd] = -np.inf
        return out

    return score


def looked_up(queries: pa.Table, vectors: pa.Table) -> Callable:
    """The same for codes: sums over each query's table (parts x centres, flat) at the vectors' codes."""
    codes = _flat(vectors["codes"])[3].astype(np.int64).reshape(len(vectors), -1)
    tables = _flat(queries["table"])[3].reshape(len(queries), codes.shape[1], -1)

    def score(part: slice, at: np.ndarray) -> np.ndarray:
        out = np.take(tables[part, 0], codes[at, 0], axis=1)
        for p in range(1, codes.shape[1]):
            out += np.take(tables[part, p], codes[at, p], axis=1)
        return out

    return score


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up, as SQL rounds."""
    unit = 10.0**digits
    return np.where(np.isfinite(x), np.copysign(np.floor(np.abs(x) * unit + 0.5) / unit, x), x) + 0.0


def picked(keys: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded key of the ``k`` largest rounded keys of each row, equal ones by column."""
    n = keys.shape[1]
    least = np.partition(keys, n - k, axis=1)[:, n - k] if n > k else np.full(len(keys), -np.inf)
    rows, columns = np.nonzero(keys >= (least if digits is None else least - 10.0**-digits)[:, None])
    found = keys[rows, columns]
    found = found if digits is None else rounded(found, digits)
    order = np.lexsort((-found, rows))  # stable: equal keys stay in the order of columns
    rows, columns, found = rows[order], columns[order], found[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], columns[keep], found[keep]


def _search(scores: Callable, k: int, digits: int | None, by: str | None, kept: list[str], schema: pa.Schema) -> Callable:
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(queries) or not len(vectors):
            return schema.empty_table()
        vectors = vectors.sort_by("point_id")
        score, out = scores(queries, vectors), []
        kinds = pc.dictionary_encode(vectors[by], null_encoding="encode").combine_chunks().indices.to_numpy() if by else np.zeros(len(vectors), dtype=int)
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            step = max(1, PAIRS // len(at))
            for start in range(0, len(queries), step):
                keys = score(slice(start, start + step), at)
                keys[np.isnan(keys)] = np.inf  # SQL takes it for the largest number
                rows, columns, found = picked(keys, k, digits)
                told = pa.array(np.where(found == np.inf, np.nan, found), mask=found == -np.inf)
                right = vectors.select(kept).take(pa.array(at[columns]))
                out.append(pa.table([queries["query_id"].take(pa.array(rows + start)), *right.columns, told], names=["query_id", *kept, "score"]).cast(schema))
        return pa.concat_tables(out)

    return search


def block_topk(queries: DataFrame, vectors: DataFrame, k: int, scores: Callable, on: tuple[str, ...] = (), by: str | None = None, keep: tuple[str, ...] = (), digits: int | None = DIGITS) -> DataFrame:
    """query_id, point_id, ``keep``, score: of each pair of blocks the ``k`` best vectors of each query (and value of ``by``).

    Among these are the best of all, to be ranked once more. With ``on`` only queries and vectors with equal values there
    are paired; these are few values, such as lists or buckets, each of which is cut into as many blocks as it needs.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if not on:
        on = ("_all",)
        queries, vectors = queries.withColumn("_all", F.lit(0)), vectors.withColumn("_all", F.lit(0))
    blocks = lambda df, size, name: df.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(queries, QUERY_BLOCK, "_nq").join(blocks(vectors, VECTOR_BLOCK, "_nv"), list(on)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, list(on)).withColumn("_q", block("query_id", "_nq")).withColumn("_v", each("_nv")).drop("_nq", "_nv")
    right = vectors.join(sizes, list(on)).withColumn("_v", block("point_id", "_nv")).withColumn("_q", each("_nq")).drop("_nq", "_nv")
    kept = ["point_id", *keep]
    schema = StructType([queries.schema["query_id"], *[vectors.schema[c] for c in kept], StructField("score", DoubleType())])
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
    cell = [*on, "_q", "_v"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_search(scores, k, digits, by, kept, to_arrow_schema(schema)), schema)


def _sparse(k: int, digits: int, schema: pa.Schema) -> Callable:
    def search(weights: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(weights) or not len(entries):
            return schema.empty_table()
        weights = weights.sort_by("query_id")
        terms = pc.unique(weights["term"])
        code = lambda table: pc.index_in(table["term"], value_set=terms)
        held = entries.append_column("_code", code(entries)).sort_by([("_code", "ascending"), ("point_id", "ascending")])
        codes, x = pc.fill_null(held["_code"], len(terms)).to_numpy(), held["x"].to_numpy()
        starts = np.searchsorted(codes, np.arange(len(terms) + 1))
        points, queries = pc.unique(entries["point_id"]).sort(), pc.unique(weights["query_id"])
        point = pc.index_in(held["point_id"], value_set=points).to_numpy()
        query, term, w = pc.index_in(weights["query_id"], value_set=queries).to_numpy(), code(weights).to_numpy(), weights["w"].to_numpy()
        n, out = len(points), [schema.empty_table()]
        step = max(1, PAIRS // n)
        for start in range(0, len(queries), step):
            some = slice(*np.searchsorted(query, [start, start + step]))
            m, at = min(step, len(queries) - start), term[some]
            sizes = starts[at + 1] - starts[at]
            index = np.arange(sizes.sum()) + np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes)
            cells = np.repeat((query[some] - start).astype(np.int64) * n, sizes) + point[index]
            keys = np.bincount(cells, np.repeat(w[some], sizes) * x[index], m * n).astype(np.float64)  # of none: integers
            keys[np.bincount(cells, minlength=m * n) == 0] = -np.inf  # no shared term
            rows, columns, found = picked(keys.reshape(m, n), k, digits)
            rows, columns, found = rows[found > -np.inf], columns[found > -np.inf], found[found > -np.inf]
            out.append(pa.table([queries.take(pa.array(rows + start)), points.take(pa.array(columns)), pa.array(found)], names=["query_id", "point_id", "score"]).cast(schema))
        return pa.concat_tables(out)

    return search


def sparse_topk(weights: DataFrame, entries: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """query_id, point_id, score: of each pair of blocks the ``k`` points with the largest sums of ``w * x`` over shared terms.

    ``weights`` has query_id, term, w and ``entries`` point_id, term, x, each term once for a query or point. All terms of a
    query, and of a point, lie in one block; a block has about as many of them as the constants say. Among the rows are the
    best of all, to be ranked once more. Scores are rounded to ``digits`` places before they are compared.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    count = lambda df, size, name: df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias(name))
    sizes = F.broadcast(count(weights, WEIGHT_BLOCK, "_nq").crossJoin(count(entries, ENTRY_BLOCK, "_nv")))  # one row
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = weights.crossJoin(sizes).withColumn("_q", block("query_id", "_nq")).withColumn("_v", each("_nv")).select("_q", "_v", "query_id", "term", "w")
    right = entries.crossJoin(sizes).withColumn("_v", block("point_id", "_nv")).withColumn("_q", each("_nq")).select("_q", "_v", "point_id", "term", "x")
    schema = StructType([StructField(n, t, True) for n, t in (("query_id", weights.schema["query_id"].dataType), ("point_id", entries.schema["point_id"].dataType), ("score", DoubleType()))])
    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(_sparse(k, digits, to_arrow_schema(schema)), schema)
