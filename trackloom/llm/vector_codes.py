"""Compression of vectors into codes of codebook entries, trained by Lloyd's rounds with heaps (on integers).

Vectors lie in blocks, and a block is cut into part positions. For every position and entry of its codebook a block has
a heap of the parts that belong to the entry, keyed by their slack: the lower bound of the distance to any other entry
less the upper bound of the distance to their own. When entries move, an entry's cumulative drift (its own moves and the
largest of the others') is all that changes: a part's key is its slack plus the drift when it was pushed, so the parts
whose bounds no longer hold are those at the top of the heap whose key the drift has reached. These are popped and
compared with all entries, exactly; the rest of the heap is not looked at. Bounds are rounded outwards and a slack of
nothing counts as violated, so ties are decided by exact integers and the codes are those of plain rounds.

A block is a row of bounded size (its vectors, codes and heaps as bytes), written to the shared folder after each round:
a lost executor costs the blocks of one task. Only parts that change their entry change the sums: blocks write these
differences, and the driver gets one number per component of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .vectors import all_gaps, gaps, is_whole, matrix, root_down, root_up, scaled, summed

#: Vectors and components in one block at most.
BLOCK_ROWS, BLOCK_CELLS = 8192, 1 << 20

#: Tables of as many labels are broadcast; larger ones are joined by salted keys.
FEW_LABELS = 10_000
SALTS = 32


def packed(kept: DataFrame, dims: int) -> DataFrame:
    """Blocks of the rows (vec_id, label, vec) of each partition."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_CELLS // dims))
    kinds = kept.schema
    schema = T.StructType([T.StructField("ids", T.ArrayType(kinds["vec_id"].dataType)), T.StructField("labels", T.ArrayType(kinds["label"].dataType)), T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator):
        import pyarrow as pa

        held, n = [], 0

        def block(b):
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(i)) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([matrix(b.column(2), dims).astype("int32").tobytes()], pa.binary())], names=schema.names)

        def whole():
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for b in batches:
            while b.num_rows:
                take = b.slice(0, rows - n)
                held.append(take)
                n, b = n + take.num_rows, b.slice(take.num_rows)
                if n == rows:
                    yield block(whole())
                    held, n = [], 0
        if n:
            yield block(whole())

    return kept.select("vec_id", "label", "vec").mapInArrow(run, schema)


def violated(keys, starts, sizes, drift):
    """Places of all heap nodes whose key the drift of their heap has reached: from each root down, children only of
    nodes that are violated themselves. Heaps lie one after another; children of node i are 2i + 1 and 2i + 2."""
    import numpy as np

    heap, node, out = np.flatnonzero(sizes), None, []
    node = np.zeros(len(heap), dtype="int64")
    while len(heap):
        hit = keys[starts[heap] + node] <= drift[heap]
        heap, node = heap[hit], node[hit]
        out.append(starts[heap] + node)
        heap, node = np.concatenate([heap, heap]), np.concatenate([2 * node + 1, 2 * node + 2])
        inside = node < sizes[heap]
        heap, node = heap[inside], node[inside]
    return np.concatenate(out) if out else np.zeros(0, dtype="int64")


def two_nearest(x, entries):
    """Number of the nearest entry (ties: the lower), and squared distances to it and to the second nearest."""
    import numpy as np

    d = all_gaps(x, entries)
    at = np.arange(len(x))
    code = d.argmin(axis=1)
    best = d[at, code]
    if len(entries) == 1:
        return code, best, np.full(len(x), np.inf)
    d[at, code] = np.iinfo("int64").max
    return code, best, d.min(axis=1)


def reassigned(x, entries, drift, code, rows, keys):
    """One position of a block: pop the parts whose bounds may not hold, rescan these, push them again.

    code, rows and keys are None the first time. Returns them anew (rows and keys heap by heap, as many as code counts
    entries) with the rows that were popped.
    """
    import numpy as np

    n, k = len(x), len(entries)
    if code is None:
        code, key_of, popped = np.zeros(n, dtype="int64"), np.zeros(n), np.arange(n)
    else:
        sizes = np.bincount(code, minlength=k)
        popped = rows[violated(keys, np.cumsum(sizes) - sizes, sizes, drift)]
        if not len(popped):
            return code, rows, keys, popped
        code, key_of = code.copy(), np.empty(n)
        key_of[rows] = keys
    found, best, second = two_nearest(x[popped], entries)
    code[popped] = found
    slack = np.nextafter(root_down(second) - root_up(best), -np.inf)
    key_of[popped] = np.nextafter(slack + drift[found], -np.inf)
    rows = np.lexsort((key_of, code))  # a sorted run is a heap
    return code, rows, key_of[rows], popped


def passed(blocks: DataFrame, books, drift) -> DataFrame:
    """One round over the blocks: codes and heaps anew, and `moved`, what the changes of code add to counts and sums."""
    parts, k, width = books.shape
    kinds = blocks.schema
    schema = T.StructType([*(kinds[c] for c in ("ids", "labels", "vec")), *T.StructType.fromDDL("code binary, rows binary, keys binary, moved binary")])
    first = "code" not in blocks.columns

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for b in (batch.slice(i, 1) for i in range(batch.num_rows)):
                read = lambda name, kind, b=b: np.frombuffer(b.column(b.schema.get_field_index(name))[0].as_buffer(), dtype=kind)
                x = read("vec", "int32").reshape(-1, parts, width).astype("int64")
                n = len(x)
                code, rows, keys = np.zeros((parts, n), "uint8"), np.zeros((parts, n), "int32"), np.zeros((parts, n))
                if not first:
                    old = [read(c, t).reshape(parts, n) for c, t in (("code", "uint8"), ("rows", "int32"), ("keys", "float64"))]
                change = np.zeros((parts, k, width + 1), dtype="int64")
                for p in range(parts):
                    was = None if first else old[0][p].astype("int64")
                    now, rows[p], keys[p], popped = reassigned(x[:, p], books[p], drift[p], was, *((None, None) if first else (old[1][p], old[2][p])))
                    went = popped if first else popped[now[popped] != was[popped]]
                    row = np.concatenate([np.ones((len(went), 1), dtype="int64"), x[went, p]], axis=1)
                    np.add.at(change[p], now[went], row)
                    if not first:
                        np.subtract.at(change[p], was[went], row)
                    code[p] = now
                out = [b.column(b.schema.get_field_index(c)) for c in ("ids", "labels", "vec")]
                out += [pa.array([a.tobytes()], pa.binary()) for a in (code, rows, keys, change)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return blocks.mapInArrow(run, schema)


def coded(blocks: DataFrame, books) -> DataFrame:
    """A row per vector of the blocks: vec_id, label, code and error."""
    parts, _, width = books.shape
    kinds = blocks.schema
    of = lambda name: kinds[name].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", of("ids")), T.StructField("label", of("labels")), *T.StructType.fromDDL("code string, error long")])

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                n = len(ids)
                x = np.frombuffer(batch.column(2)[i].as_buffer(), dtype="int32").reshape(n, parts, width).astype("int64")
                code = np.frombuffer(batch.column(3)[i].as_buffer(), dtype="uint8").reshape(parts, n)
                error = sum(gaps(x[:, p], books[p][code[p]]) for p in range(parts))
                text = code.T.tobytes().hex()
                codes = pa.array([text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(error, pa.int64())], names=schema.names)

    return blocks.select("ids", "labels", "vec", "code").mapInArrow(run, schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """label_error, the error summed over equal labels (nulls together). Sums are pre-aggregated; few labels are
    broadcast, many are joined by salted keys, so that a label of any size is spread."""
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    same = rows["label"].eqNullSafe(sums["of"])
    if sums.count() <= FEW_LABELS:
        return rows.join(F.broadcast(sums), same).drop("of")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)))
    spread = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"))
    return salted.join(spread, same & (salted["salt"] == spread["at"])).drop("of", "salt", "at")


def common_length(vectors: DataFrame, vec_col: str, parts: int) -> int:
    """The length of most vectors that `parts` divides (ties: the longer); 0 if there is none."""
    sizes = vectors.where(is_whole(F.col(vec_col))).groupBy(F.size(vec_col).alias("n")).count()
    top = sizes.where((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def compressed(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """A row per kept vector: vec_id, code, error, label_error and codebooks_sha256.

    Kept are vectors without null, NaN or infinite components, each component as floor(scale * x). They must have one
    length that `parts` divides: the commonest such (ties: the longer) is taken, vectors of other lengths (empty ones
    too) can't be cut and go. Codebooks start from the `entries` smallest ids (rows that share an id by their
    components, null ids last); if fewer are kept there are fewer entries, 256 at most. Repeated rows count each and are
    coded alike; no kept row gives no rows; null labels are one label; other columns are not read. Components of 2^24
    or more after scaling raise an error.
    """
    import numpy as np

    if not 1 <= entries <= 256:
        raise ValueError("a code byte holds 256 entries at most")
    spark = vectors.sparkSession
    dims = common_length(vectors, vec_col, parts)
    whole = is_whole(F.col(vec_col)) & (F.size(vec_col) == dims)
    kept = vectors.where(whole).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), scaled(F.col(vec_col), scale).alias("vec"))
    starts = kept.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect() if dims else []
    if not starts:
        schema = T.StructType([kept.schema["vec_id"], *T.StructType.fromDDL("code string, error long, label_error long, codebooks_sha256 string")])
        return spark.createDataFrame([], schema)
    k, width = len(starts), dims // parts
    books = np.array([r["vec"] for r in starts], dtype="int64").reshape(k, parts, width).transpose(1, 0, 2).copy()
    drift, cells = np.zeros((parts, k)), np.zeros((parts, k, width + 1), dtype="int64")

    def add(total, batch):
        for one in batch.column(0):
            total += np.frombuffer(one.as_buffer(), dtype="int64")

    blocks = packed(kept, dims)
    for _ in range(rounds):
        blocks = stored(passed(blocks, books, drift), "code-blocks")
        cells = cells + summed(blocks.select("moved"), cells.size, add).reshape(cells.shape)
        n = cells[:, :, :1]
        after = np.where(n > 0, np.floor_divide(cells[:, :, 1:], np.maximum(n, 1)), books)
        drift, books = drifted(drift, books, after), after
    rows = stored(coded(stored(passed(blocks, books, drift), "code-blocks"), books), "codes")
    text = ",".join(map(str, books.ravel().tolist()))
    digest = hashlib.sha256(text.encode()).hexdigest()
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def drifted(drift, before, after):
    """Cumulative drift: an entry's own move, and the largest of the others', by which a lower bound may have shrunk."""
    import numpy as np

    k = before.shape[1]
    step = np.where((after == before).all(axis=2), 0.0, root_up(gaps(after, before)))
    others = np.stack([np.delete(step, j, axis=1).max(axis=1, initial=0.0) for j in range(k)], axis=1)
    total = np.nextafter(drift + np.nextafter(step + others, np.inf), np.inf)
    return np.where(step + others > 0, total, drift)


def op11_vector_codes(spark, sf_dir):
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    ctes = []
    for r in range(3):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT r, p, min(list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + c) AS best
  FROM parts JOIN b{r} USING (p) GROUP BY r, p)""")
        if r < 2:
            ctes.append(f"""s{r} AS (
  SELECT p, c, pos, sum(x) AS s, count(*) AS n
  FROM (SELECT p, best % 64 AS c, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{r} JOIN parts USING (r, p)) GROUP BY p, c, pos),
m{r} AS (SELECT p, c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS m FROM s{r} GROUP BY p, c),
b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.c, coalesce(m{r}.m, b{r}.m) AS m FROM b{r} LEFT JOIN m{r} ON m{r}.p = b{r}.p AND m{r}.c = b{r}.c)""")
    steps = ",\n".join(ctes)
    return f"""
WITH whole AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM whole
  WHERE len(embedding) = (SELECT len(embedding) FROM whole WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
parts AS MATERIALIZED (
  SELECT r, p, list_slice(q, p * (len(q) // 16) + 1, (p + 1) * (len(q) // 16)) AS q FROM v, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS c, q AS m FROM parts WHERE r <= 64),
{steps},
coded AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(best % 64 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, c)) FROM b2) AS codebooks_sha256
FROM coded JOIN v USING (r)
"""


OP11_SQL = _sql()
