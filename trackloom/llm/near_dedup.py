"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. A shingle is five words. Its weight in a document is tf * idf, with idf from the number of documents that
   hold the shingle's feature (shingle hashes fall into 2^18 features, so the table that is sent to the
   executors has a fixed size, and the share of documents a feature has does not change with the corpus).
2. For each of `bands * rows` draws, every shingle of a document gets a value from its weight and from random
   numbers that depend on shingle and draw alone; the smallest is the sample. Two documents share a sample with
   the probability of their weighted Jaccard similarity. `rows` samples are a band.
3. Documents with one word sequence are one node. Nodes that share a band, or two neighbouring bands, meet in a
   bucket. Each is paired with two pivots of the bucket, the node of the smallest digest and one drawn anew in
   every bucket, so a bucket of m nodes makes 2 m pairs at most, never m^2.
4. A pair is a link if the weighted Jaccard similarity of its documents, computed from all their shingles,
   reaches the threshold. Linked nodes are one class, found by alternating large and small stars.
5. Buckets whose pivots leave pairs out, and that hold more than one class then, are opened: their nodes meet once
   more by an exact join on the rarest shingles of each (a weighted prefix filter), which leaves out no pair of
   different classes that reaches the threshold. Its pairs are verified in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, sliced, stored, table
from .shingles import blocks, mix

THRESHOLD, BANDS, ROWS, SEED = 0.8, 10, 3, 42

#: Features of the document-frequency table: 2 ** FEATURE_BITS, of the upper bits of a shingle's hash.
FEATURE_BITS = 18

#: Entries of the table of random numbers of one draw.
DRAW_BITS = 16

#: Rows of a shingle in one part of the exact join: of nodes that are looked up, and of those that look up.
INDEX_PART, PROBE_PART = 256, 4096


def feature_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def idf_table(df: np.ndarray, n_docs: int) -> np.ndarray:
    """ln((n + 1) / (df + 1)) + 1, smoothed so that a shingle of every document still counts a little."""
    return (np.log((n_docs + 1) / (np.minimum(df, n_docs) + 1.0)) + 1.0).astype(np.float32)


class Sampler:
    """The random numbers of every draw and the sampling of a block of documents."""

    def __init__(self, draws: int, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        shape = (draws, 1 << DRAW_BITS)
        r = rng.standard_gamma(2.0, shape)
        self.r = r.astype(np.float32)
        self.over_r = (1.0 / r).astype(np.float32)
        self.ln_c = np.log(rng.standard_gamma(2.0, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.factor = rng.integers(0, 1 << 63, draws, np.uint64) * np.uint64(2) + np.uint64(1)
        self.draws = draws

    def samples(self, shingle: np.ndarray, ln_weight: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A row of samples (64-bit names) for each document; document i has shingles begins[i] to begins[i+1]-1,
        at least one. A sample is named by its value's bits, which hold shingle and weight step, and its hash."""
        name = shingle >> np.uint64(32)
        out = np.empty((len(begins), self.draws), np.uint64)
        shift, high = np.uint64(64 - DRAW_BITS), np.uint64(32)
        for k in range(self.draws):
            i = ((shingle * self.factor[k]) >> shift).astype(np.int32)
            r, beta = self.r[k][i], self.beta[k][i]
            step = np.floor(ln_weight * self.over_r[k][i] + beta)
            value = self.ln_c[k][i] - r * (step + np.float32(1) - beta)
            bits = value.view(np.int32)
            # Bits whose unsigned order is that of the floats.
            bits = bits ^ ((bits >> 31) | np.int32(-(1 << 31)))
            out[:, k] = np.minimum.reduceat((bits.view(np.uint32).astype(np.uint64) << high) | name, begins)
        return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(samples), bands), np.uint64)
    for j in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, j::rows][:, :bands] + np.uint64(j + 1))
    return keys.view(np.int64)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of sorted distinct names with weights."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = float(np.minimum(wa[i], wb[j]).sum(dtype=np.float64))
    total = float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - least
    return least / total if total else 0.0


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents per feature, as an array of fixed size, and the number of documents that have words."""

    def count(batches: Iterator):
        import pyarrow as pa

        df, n = np.zeros(1 << FEATURE_BITS, np.int64), 0
        for b in sliced(batches):
            for _, block in blocks([t.as_py() or "" for t in b.column(0)]):
                # A feature counts once a document, however many of its shingles fall into it.
                seen = np.unique(block.doc.astype(np.int64) << FEATURE_BITS | feature_of(block.shingle)) & ((1 << FEATURE_BITS) - 1)
                df += np.bincount(seen, minlength=len(df))
                n += int((np.diff(block.bounds) > 0).sum())
        found = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], names=["feature", "n"])
        give_back()

    counted = docs.select(text_col).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros(1 << FEATURE_BITS, np.int64), 0
    real = counted["feature"] >= 0
    df[counted["feature"][real].to_numpy()] = counted["n"][real].to_numpy()
    n = int(counted["n"][~real].sum())
    return df, n


def signatures(docs: DataFrame, idf, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, seal (hash of the text), node (digest of the words, null without words) and keys of the bands."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("seal", T.LongType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches: Iterator):
        import pyarrow as pa

        sampler, weights = Sampler(bands * rows), idf.value
        for b in sliced(batches):
            texts = [t.as_py() or "" for t in b.column(2)]
            nodes: list[bytes | None] = [None] * len(texts)
            keys: list = [None] * len(texts)
            for at, block in blocks(texts):
                has = np.flatnonzero(np.diff(block.bounds))
                if not len(has):
                    continue
                ln_weight = np.log(block.tf.astype(np.float32) * weights[feature_of(block.shingle)])
                found = band_keys(sampler.samples(block.shingle, ln_weight, block.bounds[:-1][has]), bands, rows)
                for row, d in enumerate(has):
                    own = block.words[block.word_bounds[d] : block.word_bounds[d + 1]]
                    nodes[at + d] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    keys[at + d] = found[row]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "seal", "node", "keys"]
            )
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("seal"), F.col(text_col).alias("text")).mapInArrow(sign, schema)


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """node, band, key of each bucket that a node is in. nodes: node, keys."""
    # Two neighbouring bands together are a narrower bucket: in a wide one, which texts of a common passage share,
    # the pivots may be strangers to two that are alike in more than the passage.
    n = F.size("keys")
    both = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get("keys", i), F.get("keys", (i + 1) % n)))
    return nodes.select("node", F.posexplode(F.concat("keys", both)).alias("band", "key"))


def bucket_pivots(rows: DataFrame) -> DataFrame:
    """band, key, pivots and whole (the pivots make all pairs) of the buckets of more than one node."""
    drawn = F.min(F.struct(F.xxhash64("node", "band").alias("draw"), "node"))
    buckets = rows.groupBy("band", "key").agg(F.min("node").alias("first"), drawn.alias("drawn"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return buckets.select("band", "key", F.array_distinct(F.array("first", "drawn.node")).alias("pivots"), "n").select(
        "band", "key", "pivots", (F.col("n") <= F.size("pivots") + 1).alias("whole")
    )


def candidate_pairs(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes with their pivots in each bucket."""
    met = rows.join(buckets, ["band", "key"]).select("node", F.explode("pivots").alias("pivot")).where(F.col("node") != F.col("pivot"))
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def open_nodes(rows: DataFrame, buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root of the nodes in buckets that their pivots did not settle: not all pairs were made, and the nodes
    are not of one class."""
    left = rows.join(buckets.where(~F.col("whole")).select("band", "key"), ["band", "key"])
    left = left.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "band", "key")
    mixed = left.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band", "key")
    return left.join(mixed, ["band", "key"], "left_semi").select("node", "root").distinct()


def rarest(opened: DataFrame, features: DataFrame, idf, threshold: float) -> DataFrame:
    """name, node, root, total, rest, indexed: the rarest shingles of each node. total is the weight of all its
    shingles, rest that of this one and all that are commoner.

    Shingles have one order in all nodes, rarest first. Let x and y reach the threshold t and y be the lighter one:
    they share a weight of t / (1 + t) (total x + total y) or more, none of it before the first shingle they share.
    There, rest is t total or more in x and 2 t / (1 + t) total or more in y (these are indexed).
    """
    slack = 1 - 1e-5

    def read(batches: Iterator):
        import pyarrow as pa

        weights = idf.value
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(2)[i].values.to_numpy(False).view(np.uint64)
                rarity, tf = weights[feature_of(own)], b.column(3)[i].as_py()
                order = np.lexsort((own, -rarity))
                w = (rarity if tf is None else rarity * np.array(tf, np.float32))[order].astype(np.float64)
                rest = np.cumsum(w[::-1])[::-1]
                total = float(rest[0]) if len(rest) else 0.0
                n = int((rest >= threshold * total * slack).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[order[:n]].view(np.int64)), b.column(0).take(pa.array([i] * n, pa.int32())), b.column(1).take(pa.array([i] * n, pa.int32()))]
                    + [pa.array(np.full(n, total)), pa.array(rest[:n]), pa.array(rest[:n] >= 2 * threshold / (1 + threshold) * total * slack)],
                    names=["name", "node", "root", "total", "rest", "indexed"],
                )
        give_back()

    joined = opened.join(features, "node").select("node", "root", "names", "tf")
    return joined.mapInArrow(read, "name long, node binary, root binary, total double, rest double, indexed boolean")


def exact_pairs(opened: DataFrame, features: DataFrame, idf, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of opened nodes of different roots: all that may reach the threshold. A shingle
    that many hold is dealt in parts, by nodes of either side."""
    rows = stored(rarest(opened, features, idf, threshold), "rarest")
    sizes = rows.groupBy("name").agg(F.count_if("indexed").alias("index"), F.count(F.lit(1)).alias("probe"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    sizes = sizes.where("index > 0 and lo != hi").select("name", F.ceil(F.col("index") / INDEX_PART).cast("int").alias("parts"), F.ceil(F.col("probe") / PROBE_PART).cast("int").alias("turns"))
    dealt = stored(rows.join(sizes, "name"), "rarest-dealt")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    x = dealt.select("name", own("turns").alias("turn"), every("parts").alias("part"), F.col("node").alias("x"), F.col("root").alias("x_root"), F.col("total").alias("x_total"), F.col("rest").alias("x_rest"))
    y = dealt.where("indexed").select("name", own("parts").alias("part"), every("turns").alias("turn"), F.col("node").alias("y"), F.col("root").alias("y_root"), F.col("total").alias("y_total"), F.col("rest").alias("y_rest"))
    lighter = (F.col("y_total") < F.col("x_total")) | ((F.col("y_total") == F.col("x_total")) & (F.col("y") < F.col("x")))
    enough = F.least("x_rest", "y_rest") >= (F.col("x_total") + F.col("y_total")) * (threshold / (1 + threshold) * (1 - 1e-5))
    met = x.join(y, ["name", "turn", "part"]).where(lighter & enough & (F.col("x_root") != F.col("y_root")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def features_of(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, names (sorted shingle hashes), tf (null where all are 1) of the nodes in `wanted` (node, doc_id, seal)."""

    def read(batches: Iterator):
        import pyarrow as pa

        for b in sliced(batches):
            texts = [t.as_py() or "" for t in b.column(1)]
            names, tfs = [], []
            for _, block in blocks(texts):
                for d in range(block.n):
                    s = slice(block.bounds[d], block.bounds[d + 1])
                    tf = block.tf[s].astype(np.int32)
                    names.append(block.shingle[s].view(np.int64))
                    tfs.append(tf if (tf != 1).any() else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int32()))], names=["node", "names", "tf"]
            )

    own = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__seal"), F.col(text_col).alias("text"))
    found = own.join(wanted, own["__id"].eqNullSafe(wanted["doc_id"]) & (own["__seal"] == wanted["seal"]))
    return found.select("node", "text").mapInArrow(read, "node binary, names array<long>, tf array<int>").dropDuplicates(["node"])


def links(pairs: DataFrame, features: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity reaches the threshold: a, b, similarity."""

    def verify(batches: Iterator):
        import pyarrow as pa

        weights = idf.value

        def side(names, tf):
            own = names.view(np.uint64)
            w = weights[feature_of(own)]
            return own, w if tf is None else w * np.array(tf, np.float32)

        for b in batches:
            cols = [b.column(i) for i in range(6)]
            value = [weighted_jaccard(*side(cols[2][i].values.to_numpy(False), cols[3][i].as_py()), *side(cols[4][i].values.to_numpy(False), cols[5][i].as_py())) for i in range(b.num_rows)]
            out = pa.RecordBatch.from_arrays([cols[0], cols[1], pa.array(value, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([v >= threshold for v in value], pa.bool_()))
        give_back()

    left = features.select(F.col("node").alias("a"), F.col("names").alias("a_names"), F.col("tf").alias("a_tf"))
    right = features.select(F.col("node").alias("b"), F.col("names").alias("b_names"), F.col("tf").alias("b_tf"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_names", "a_tf", "b_names", "b_tf")
    return joined.mapInArrow(verify, "a binary, b binary, similarity double")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b): alternating large and small stars until nothing changes.

    A round sends the larger neighbours of a node to the smallest of its neighbourhood, then the smaller ones.
    The smallest is a partial aggregate, stored before it is joined, so that the edges of a node with very many
    neighbours are dealt for the join alone and Spark can split them among tasks.
    """
    edges = stored(edges.select("a", "b"), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Now a > b in every row.
        large = stored(large.where(F.col("a") != F.col("b")).distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select("a", "b", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct().select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_classes(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per input row: doc_id, class_id (the smallest id of the class), class_size, kept, seal.

    Rows with one sequence of words are of one class; so are documents linked by a similarity of `threshold` or
    more, over any number of links. One row of each class is kept: that of the smallest id (null last), of rows
    that repeat it one. A text without words (null and empty ones too) is a class of its own. An empty table
    gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    df, n = document_frequencies(docs, text_col)
    idf = spark.sparkContext.broadcast(idf_table(df, n))
    slim = stored(signatures(docs, idf, bands, rows, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = slim.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "seal", "keys")).alias("one"))
    nodes = nodes.select("node", "one.doc_id", "one.seal", "one.keys")
    rows_of = bucket_rows(nodes.select("node", "keys"))
    buckets = stored(bucket_pivots(rows_of), "buckets")
    pairs = stored(candidate_pairs(rows_of, buckets), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(wanted, "node").select("node", "doc_id", "seal")
    features = stored(features_of(docs, wanted, id_col, text_col), "features")
    roots = components(links(pairs, features, idf, threshold))
    opened = stored(open_nodes(rows_of, buckets, roots), "opened")
    if not opened.isEmpty():
        more = links(stored(exact_pairs(opened, features, idf, threshold), "exact-pairs"), features, idf, threshold)
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more.select("a", "b")))

    placed = slim.drop("keys").join(roots, "node", "left")
    alone = F.concat(F.lit("row").cast("binary"), F.col("row").cast("string").cast("binary"))
    placed = stored(placed.select("doc_id", "seal", "row", F.coalesce("root", "node", alone).alias("root")), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    # Stored, so that the join's large side is dealt for the join alone and Spark can split a large class.
    classes = stored(placed.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
    return placed.join(classes, "root").select(
        "doc_id", F.col("first.id").alias("class_id"), "class_size", (placed["row"] == F.col("first.row")).alias("kept"), "seal"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all columns of docs."""
    kept = near_classes(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("doc_id").alias("__kept"), F.col("seal").alias("__kept_seal"))
    tagged = docs.withColumn("__seal", F.xxhash64(text_col))
    same = tagged[id_col].eqNullSafe(kept["__kept"]) & (tagged["__seal"] == kept["__kept_seal"])
    return tagged.join(kept, same, "left_semi").dropDuplicates([id_col, "__seal"]).drop("__seal")


def op8_near_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents")).drop("seal")
