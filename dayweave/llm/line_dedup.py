"""Removal of lines that many documents share, with DataFrame operations only.

Lines are represented by a 128-bit hash of their key and their place.  They are
dealt out by ranges of (hash, document) and sorted by position, so a line that a
third of all documents share spreads over many ranges; the first line of each
(hash, document) run is streamed out and these are counted.  Decisions come back
as one bitmap per document that lost a line: words of 64 positions, with words
that keep everything left out.  Texts are only touched when a bitmap is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm import common
from dayweave.session import cut_lineage

#: White space that is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
LEAST_DOCUMENTS, LEAST_CHARS = 10, 1
#: Shared lines are broadcast up to this size; beyond it places are joined by a shuffle, whose large partitions Spark splits.
BROADCAST_BYTES, HASH_BYTES = 16_000_000, 32


def lines(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return common.ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def line_places(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, body, pos, h1, h2): hashed keys of all lines with a long enough key; ``body`` tells texts of one id apart."""
    found = df.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.posexplode(F.transform(lines(F.col(text)), line_key)).alias("pos", "key"))
    return found.where(F.length("key") >= least_chars).select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key", F.length("key")).alias("h2"))


def keep_bitmaps(places: DataFrame, *, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc, body, keep map<int,bigint>): bits of lines to keep, by word of 64 positions.

    Words without a lost line, and documents without one, are left out.
    """
    run = Window.partitionBy("h1", "h2", "doc").orderBy("pos")
    first = places.repartitionByRange("h1", "h2", "doc").withColumn("nth", F.row_number().over(run)).where("nth = 1")
    shared = cut_lineage(first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents).select("h1", "h2"))
    # few shared lines are broadcast, so that a line of a third of all documents meets no other row of its own in one task
    small = shared.count() * HASH_BYTES <= BROADCAST_BYTES
    lost = places.join(F.broadcast(shared) if small else shared, ["h1", "h2"], "left_semi")
    words = lost.groupBy("doc", "body", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(_shifted(F.col("pos").bitwiseAND(63))).alias("bits"))
    return words.groupBy("doc", "body").agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))).alias("keep"))


def _shifted(places: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), places)


def kept_lines(text: Column, keep: Column) -> Column:
    """The lines of a text whose bits are set; all lines if there is no bitmap."""
    words = F.sequence(F.lit(0), F.shiftright(F.size(lines(text)) - 1, 6))
    flags = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.coalesce(F.try_element_at(keep, w), F.lit(-1).cast("long")).bitwiseAND(_shifted(b)) != 0)))
    chosen = F.filter(F.zip_with(lines(text), flags, lambda line, flag: F.when(flag, line)), lambda line: line.isNotNull())
    return F.when(keep.isNull(), lines(text)).otherwise(chosen)


def dedup_lines(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Adds ``kept_text``, ``n_lines`` and ``n_dropped`` to every row.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased.  Keys found in at least ``least_documents`` documents lose all
    their lines; keys shorter than ``least_chars`` never do.  Rows with one id
    count as one document; rows with a null id are no document: they are not
    counted and keep their lines.  A null or empty text is one empty line and
    stays.  Columns of the three added names are replaced.
    """
    df = df.drop("kept_text", "n_lines", "n_dropped")
    places = cut_lineage(line_places(df.where(F.col(doc_id).isNotNull()), doc_id=doc_id, text=text, least_chars=least_chars))
    maps = keep_bitmaps(places, least_documents=least_documents)
    doc, body, keep = "_line_dedup_doc", "_line_dedup_body", "_line_dedup_keep"
    maps = maps.select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("keep").alias(keep)).hint("shuffle_hash")
    joined = df.join(maps, (F.col(doc_id) == F.col(doc)) & (F.xxhash64(text) == F.col(body)), "left")
    kept = F.array_join(kept_lines(F.col(text), F.col(keep)), "\n")
    n = F.size(lines(F.col(text))).cast("long")
    dropped = F.when(F.col(keep).isNull(), F.lit(0)).otherwise(F.aggregate(F.map_values(keep), F.lit(0), lambda a, w: a + F.lit(64) - F.bit_count(w)))
    return joined.withColumns({"kept_text": kept, "n_lines": n, "n_dropped": dropped.cast("long")}).drop(doc, body, keep)


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(s.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY doc_id
"""
