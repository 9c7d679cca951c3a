"""Benchmark decontamination with a positional inverted index.

The training corpus becomes postings (term, document, position). A test phrase
starts from its rarest term's postings, shifted by the term's offset, and is
intersected with the shifted postings of its next rarest terms; what is left is
compared with the text. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, read_table, staged, table_bytes

#: What stands between words; A-Z is lower-cased afterwards, word by word.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The word that each document's end is posted under; no text holds it.
END = ""
KEY = ["doc_id", "copy"]


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(word: Column) -> Column:
    return F.when(F.lower(word) == word, word).otherwise(ascii_lower(word))


def words_of(text: Column) -> Column:
    return F.transform(raw_words(text), lowered)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows as (doc_id, copy, text): copy tells texts of one doc_id apart."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"), "text")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored postings (term, doc_id, copy, pos) of whole texts, in runs sorted by term.

    ``term`` is the word's 64-bit hash. ``terms`` (a column ``term``) keeps only
    the lists that some test phrase can ask for; without it all are stored. The
    end of each document is posted under END, at its number of words, once for
    each row. Null texts have no words.
    """
    posted = keyed(docs).select(*KEY, F.posexplode(F.array_append(raw_words(F.col("text")), END)).alias("pos", "word"))
    posted = posted.select(F.xxhash64(lowered(F.col("word"))).alias("term"), *KEY, "pos")
    if terms is not None:
        terms = staged(terms.select("term").union(docs.sparkSession.range(1).select(F.xxhash64(F.lit(END)))).distinct().coalesce(1), "index-terms")
        side = F.broadcast(terms) if table_bytes(terms) <= BROADCAST_BYTES // 8 else terms
        posted = posted.join(side, "term")
    return staged(posted, "postings", sort=("term",))


def test_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows of item words: (window, words, items); all words of a shorter item."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(size)))).alias("words"))
    return rows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("window", F.xxhash64("words"))


def term_offsets(windows: DataFrame) -> DataFrame:
    return windows.select("window", F.posexplode("words").alias("off", "word")).select("window", "off", F.xxhash64("word").alias("term"))


def rarest(index: DataFrame, windows: DataFrame, lists: int) -> DataFrame:
    """The ``lists`` rarest terms of each window that can occur: (window, off, term, rank, m)."""
    offsets = term_offsets(windows)
    counts = index.groupBy("term").count()
    counted = offsets.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    by = Window.partitionBy("window")
    counted = counted.withColumns({"least": F.min("count").over(by), "rank": F.row_number().over(by.orderBy("count", "off"))})
    return counted.where((F.col("least") > 0) & (F.col("rank") <= lists)).select("window", "off", "term", "rank")


def phrase_candidates(index: DataFrame, windows: DataFrame, lists: int = 3) -> DataFrame:
    """Where the ``lists`` rarest terms of a window all stand right: (window, doc_id, copy, start)."""
    ranked = staged(rarest(index, windows, lists).coalesce(4), "rarest")
    small = table_bytes(ranked) <= BROADCAST_BYTES // 8

    def postings(rank: int) -> DataFrame:
        wanted = ranked.where(F.col("rank") == rank)
        return index.join(F.broadcast(wanted) if small else wanted, "term").select("window", *KEY, (F.col("pos") - F.col("off")).alias("start"))

    found = postings(1).where(F.col("start") >= 0).distinct()
    for rank in range(2, lists + 1):
        more = ranked.where(F.col("rank") == rank).select("window", F.col("off").alias("next_off"), F.col("term").alias("next_term"))
        found = found.join(F.broadcast(more) if small else more, "window", "left").withColumn("next_pos", F.col("start") + F.col("next_off"))
        wanted = more.select(F.col("next_term").alias("term")).distinct()
        lists_of = index.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").select(
            F.col("doc_id").alias("p_doc"), F.col("copy").alias("p_copy"), F.col("pos").alias("p_pos"), F.col("term").alias("p_term")
        )
        met = (F.col("doc_id").eqNullSafe(F.col("p_doc"))) & (F.col("copy") == F.col("p_copy")) & (F.col("next_pos") == F.col("p_pos")) & (F.col("next_term") == F.col("p_term"))
        short = found.where(F.col("next_off").isNull())
        found = found.where(F.col("next_off").isNotNull()).join(lists_of, met, "left_semi").unionByName(short).select("window", *KEY, "start")
    return found


def phrase_matches(docs: DataFrame, index: DataFrame, windows: DataFrame, lists: int = 3) -> DataFrame:
    """Exact matches by document: (doc_id, copy, hits), hits an array of (start, m, items)."""
    found = phrase_candidates(index, windows, lists)
    shapes = staged(windows.select("window", F.array_join("words", " ").alias("phrase"), F.size("words").alias("m"), "items").coalesce(4), "windows")
    side = F.broadcast(shapes) if table_bytes(shapes) <= BROADCAST_BYTES // 8 else shapes
    per_doc = found.join(side, "window").groupBy(*KEY).agg(F.collect_set(F.struct("start", "m", "phrase", "items")).alias("hits"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "hits")
    texts = keyed(docs).join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")))
    texts = texts.select(*KEY, words_of(F.col("text")).alias("words"), "hits")
    right = F.filter("hits", lambda h: F.array_join(F.slice("words", h["start"] + 1, h["m"]), " ") == h["phrase"])
    return texts.select(*KEY, right.alias("hits")).where(F.size("hits") > 0).select(*KEY, F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["m"].alias("m"), h["items"].alias("items"))).alias("hits"))


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """Documents where all terms of a query stand near its rarest one.

    ``queries`` has (item_id, terms array of words). Returns (item_id, doc_id,
    copy, pos) of each posting of the rarest term with every other term at most
    ``span`` words away. Positions meet by blocks of ``span`` words, so pairs are
    made only inside neighbouring blocks.
    """
    terms = queries.select("item_id", F.posexplode(F.array_distinct("terms")).alias("k", "word")).select("item_id", "k", F.xxhash64(ascii_lower(F.col("word"))).alias("term"))
    counted = terms.join(index.groupBy("term").count(), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    by = Window.partitionBy("item_id")
    counted = counted.withColumns({"rank": F.row_number().over(by.orderBy("count", "k")), "n": F.count("*").over(by)})
    anchors = index.join(counted.where("rank = 1").select("item_id", "term", "n"), "term").select("item_id", *KEY, "pos", "n")
    others = index.join(counted.where("rank > 1").select("item_id", "term", "k"), "term")
    block = F.floor(F.col("pos") / span)
    others = others.select(F.col("item_id").alias("o_item"), F.col("doc_id").alias("o_doc"), F.col("copy").alias("o_copy"), F.col("pos").alias("o_pos"), "k", F.explode(F.array(block - 1, block, block + 1)).alias("o_block"))
    near = anchors.withColumn("block", block).join(
        others,
        (F.col("item_id") == F.col("o_item")) & F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("copy") == F.col("o_copy")) & (F.col("block") == F.col("o_block")) & (F.abs(F.col("pos") - F.col("o_pos")) <= span),
        "left",
    )
    near = near.groupBy("item_id", *KEY, "pos", "n").agg(F.count_distinct("k").alias("others"))
    return near.where(F.col("others") == F.col("n") - 1).select("item_id", *KEY, "pos")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, lists: int = 3) -> DataFrame:
    """One row for each row of ``docs``: what of it stands in benchmark items.

    Returns doc_id, copy (hash of the text), n_words, n_hit (words inside an
    occurrence of a window of ``window`` item words), n_items, item_ids (sorted
    strings) and contaminated. Items with fewer words are one window; items
    without words have none. Null texts have no words. Repeated rows give
    repeated results; rows of one doc_id with other texts are told apart by
    ``copy``. Empty tables: no documents, no rows; no items, nothing is hit.
    """
    windows = staged(test_windows(items, window).coalesce(8), "test-windows")
    index = build_index(docs, term_offsets(windows).select("term"))
    hits = phrase_matches(docs, index, windows, lists)
    within = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["m"] - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.size(within).cast("long").alias("n_hit"), ids.alias("item_ids")).dropDuplicates(["d", "c"])
    rows = index.where(F.col("term") == F.xxhash64(F.lit(END))).select(*KEY, F.col("pos").cast("long").alias("n_words"))
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(*KEY, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = find_contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS m, array_to_string(w[s : s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT doc_id, s, m, array_to_string(w[s : s + m - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM docs, sizes)),
hits AS (SELECT g.doc_id, g.s, g.m, w.item_id FROM grams g JOIN windows w ON g.m = w.m AND g.phrase = w.phrase),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""
