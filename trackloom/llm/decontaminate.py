"""Benchmark decontamination with a positional inverted index. DataFrame functions only.

The index holds a posting (term, document, position) for every occurrence, in the training texts, of a term that
occurs in the benchmark; no query can ask for another term. A phrase is looked up from its rarest terms: the
posting lists of its `LEADS` rarest terms, each shifted back by the term's offset in the phrase, are
intersected on (phrase, document, start); what is left is intersected with the lists of all its other terms.
Two occurrences of one term in a phrase are two lists. Proximity looks up pairs of rare terms within a distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table, words

#: Words in a window of a benchmark text; a shorter text is one window.
WINDOW = 10

#: Rarest terms of a phrase that are intersected before the others are asked for.
LEADS = 2

#: The position under which the index keeps a document's number of words.
LENGTH_AT = -1

#: Rows of two or three numbers that may be sent to every executor (tens of MB); counted before it is done.
SENT_ROWS = 1_000_000


def sent_if_small(df: DataFrame) -> DataFrame:
    """df, to be sent to every executor if it has SENT_ROWS rows at most; else joins shuffle it as usual."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def phrases(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per window and item: item_id, digest of the window's words, terms. Texts without words have none."""
    listed = bench.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    cut = listed.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.slice("w", i, window))).alias("terms"),
    )
    return cut.select("item_id", F.sha2(F.array_join("terms", " ").cast("binary"), 256).alias("digest"), "terms").dropDuplicates(["item_id", "digest"])


def numbered(df: DataFrame, column: str, label: str) -> DataFrame:
    """The rows of df with a number of their own in `column`, stored, so that the numbers stay as they are."""
    return stored(df.withColumn(column, F.monotonically_increasing_id()), label)


def query_tables(bench: DataFrame, item_col: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word, term), (phrase, n_terms, offset, term), (phrase, item): what is asked of the index."""
    cut = stored(phrases(bench, item_col, "text", window), "windows")
    terms = numbered(cut.select(F.explode("terms").alias("word")).distinct(), "term", "terms")
    distinct = numbered(cut.dropDuplicates(["digest"]).select("digest", "terms"), "phrase", "phrases")
    wanted = distinct.select("phrase", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "word")).join(terms, "word").drop("word")
    items = cut.select("digest", F.col("item_id").cast("string").alias("item")).join(distinct.select("digest", "phrase"), "digest").select("phrase", "item")
    return terms, wanted, items


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, row, pos) of the terms given (word, term), stored in the shared folder.

    row numbers the documents, so rows that repeat an id stay apart. At position LENGTH_AT, a document's number
    of words stands in place of a term, with its id and a hash of its text in doc_id and seal, which
    other postings leave null.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("seal"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("w"))
    # The number of words goes before the words, under a term that no text can hold.
    tokens = texts.select("doc_id", "seal", "row", F.posexplode(F.concat(F.array(F.concat(F.lit("#"), F.size("w").cast("string"))), F.col("w"))).alias("at", "word"))
    found = tokens.join(sent_if_small(terms), "word", "left").where((F.col("at") == 0) | F.col("term").isNotNull())
    return stored(
        found.select(
            F.when(F.col("at") == 0, F.substring("word", 2, 20).cast("long")).otherwise(F.col("term")).alias("term"),
            "row",
            (F.col("at") - 1).cast("int").alias("pos"),
            F.when(F.col("at") == 0, F.col("doc_id")).alias("doc_id"),
            F.when(F.col("at") == 0, F.col("seal")).alias("seal"),
        ),
        "postings",
    )


def occurrences(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where the phrases occur: phrase, n_terms, row, start.

    wanted: phrase, n_terms, offset, term. Terms are ranked in each phrase by their number of postings."""
    postings = index.where(F.col("pos") > LENGTH_AT).select("term", "row", "pos")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "term", "offset")
    ranked = wanted.join(counts, "term", "left").withColumn("rank", F.row_number().over(rarest))
    # A phrase one of whose terms has no posting occurs nowhere.
    ranked = stored(ranked.withColumn("all", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("phrase"))).where(F.col("all") > 0), "ranked")

    leads = ranked.where(F.col("rank") <= LEADS).select("phrase", "n_terms", "offset", "term", "rank")
    shifted = postings.join(sent_if_small(leads), "term").select("phrase", "n_terms", "row", (F.col("pos") - F.col("offset")).alias("start"), "rank")
    # A bit for each list that a place is in.
    every = F.expr(f"shiftleft(1, least({LEADS}, n_terms)) - 1")
    met = (
        shifted.where(F.col("start") >= 0)
        .groupBy("phrase", "n_terms", "row", "start")
        .agg(F.bit_or(F.expr("shiftleft(1, rank - 1)")).alias("lists"))
        .where(F.col("lists") == every)
        .drop("lists")
    )
    met = stored(met, "candidates")

    others = ranked.where(F.col("rank") > LEADS).select("phrase", "offset", "term")
    asked = met.join(others, "phrase").select("phrase", "n_terms", "row", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    # Only documents with a candidate are asked for; their postings are few beside the index.
    near = postings.join(sent_if_small(met.select("row").distinct()), "row", "left_semi")
    held = asked.join(near, ["row", "pos", "term"]).groupBy("phrase", "n_terms", "row", "start").agg(F.count(F.lit(1)).alias("lists"))
    short = met.where(F.col("n_terms") <= LEADS)
    return held.where(F.col("lists") == F.col("n_terms") - LEADS).drop("lists").unionByName(short)


def contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and a hash of the text, seal.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z; null has none. A
    word inside an occurrence of a benchmark window is hit. items_sha256 digests the ids of the items that have
    an occurring window, sorted as text and joined by commas (of nothing: the empty text). Rows that repeat an
    id or a text each get a result; an empty benchmark hits nothing. Other columns are not looked at.
    """
    terms, wanted, phrase_items = query_tables(bench, item_col, window)
    index = build_index(docs, terms, id_col, text_col)
    found = stored(occurrences(index, wanted), "occurrences")

    covered = (
        found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_terms") - 1)).alias("pos"))
        .distinct()
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = found.select("phrase", "row").distinct().join(phrase_items, "phrase").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = covered.join(items, "row")
    lengths = index.where(F.col("pos") == LENGTH_AT).select("doc_id", "seal", "row", F.col("term").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return lengths.join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "seal",
    )


def near_matches(
    docs: DataFrame, bench: DataFrame, within: int = WINDOW - 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """Proximity: doc_id, phrase, start of every place where the two rarest terms of a window stand within `within`
    words of each other, in either order; of a window of one term, every place where that stands. Exact for that
    question; a screen for edited passages. With the default no exact occurrence of a window is missed. Null and empty
    texts match nothing; rows that repeat an id or a text each give their places; empty tables give none."""
    terms, wanted, _ = query_tables(bench, item_col)
    index = build_index(docs, terms, id_col, text_col)
    ids = index.where(F.col("pos") == LENGTH_AT).select("row", "doc_id")
    postings = index.where(F.col("pos") > LENGTH_AT).select("term", "row", "pos")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # A window one of whose terms has no posting still has the two that are rarest among those that have: none has both.
    ranked = wanted.select("phrase", "term").distinct().join(counts, "term", "left")
    two = (
        ranked.withColumn("r", F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "term")))
        .where("r <= 2")
        .groupBy("phrase")
        .agg(F.max(F.when(F.col("r") == 1, F.col("term"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("term"))).alias("b"))
    )
    two = stored(two, "rarest-two")
    alone = postings.join(two.where("b is null"), postings["term"] == two["a"]).select("row", "phrase", F.col("pos").alias("start"))
    # Positions are put in bins of the distance, so that the join is on equal bins and not on a range.
    pairs = two.where("b is not null")
    first = postings.join(pairs, postings["term"] == pairs["a"]).select("phrase", "row", F.col("pos").alias("at"), "b")
    first = first.withColumn("bin", F.explode(F.array(*[F.floor(F.col("at") / within) + k for k in (-1, 0, 1)])))
    second = postings.select(F.col("term").alias("b"), "row", F.col("pos").alias("other"), F.floor(F.col("pos") / within).alias("bin"))
    met = first.join(second, ["b", "row", "bin"]).where(F.abs(F.col("at") - F.col("other")) <= within)
    return met.select("row", "phrase", F.least("at", "other").alias("start")).unionByName(alone).distinct().join(ids, "row").select("doc_id", "phrase", "start")


def drop_contaminated(docs: DataFrame, bench: DataFrame, most: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of whose words a share of `most` at most is hit, with all columns of docs."""
    over = F.col("contaminated") & (F.col("n_hit") > F.col("n_words") * F.lit(most))
    bad = contamination(docs, bench, id_col, text_col).where(over).select(F.col("doc_id").alias("__bad"), F.col("seal").alias("__bad_seal"))
    tagged = docs.withColumn("__seal", F.xxhash64(text_col))
    return tagged.join(bad, tagged[id_col].eqNullSafe(bad["__bad"]) & (tagged["__seal"] == bad["__bad_seal"]), "left_anti").drop("__seal")


def op1_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("seal")


OP1_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rid, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS phrase
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM dw) JOIN sizes s ON i + s.n - 1 <= len(w)),
hit AS (SELECT rid, i, n, item_id FROM grams JOIN win USING (n, phrase)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
