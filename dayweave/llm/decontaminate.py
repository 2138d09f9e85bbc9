"""Benchmark passages in documents through a stored positional inverted index.

Every text is split into words once.  Words that stand in an item become postings
(term, document, position) in a table in the shared folder, next to one row per
document with its number of words; a posting also keeps 16 bits of a hash of the
words beside it.  Everything else reads that table: counts give the rarest term
of each window; that term's list, shifted by its offset, gives candidate places, of
which those stay whose neighbours agree; then the lists of all terms, shifted by
their offsets, are intersected at what is left.  No text and no array of words is
ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm import common
from dayweave.session import cut_lineage

#: Words of a window; a shorter item is one window of all its words.
WINDOW = 10
#: Bytes up to which terms, anchors and documents with candidates are broadcast.
BROADCAST_BYTES = 16_000_000
#: Bits of a neighbour's hash that a posting keeps.
SIDE_BITS = 16


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    return F.coalesce(F.regexp_extract_all(common.ascii_lower(text), F.lit(common.WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def windows(items: DataFrame, *, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, window array<string>): all runs of ``width`` words; a shorter item is one run, an empty one none."""
    found = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.lit(width - 1)))
    return found.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, width))).alias("window")).distinct()


def _sized(df: DataFrame, n_bytes: int) -> DataFrame:
    """The frame with a broadcast hint if it is proven small; else Spark joins it by a shuffle."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def _measured(df: DataFrame, row_bytes: int) -> DataFrame:
    """The rows, cut from their lineage, to be broadcast if they are few."""
    df = cut_lineage(df)
    return _sized(df, df.count() * row_bytes)


def _term(word: Column) -> Column:
    return F.xxhash64(word)


def _side(word: Column) -> Column:
    return F.when(word.isNotNull(), F.xxhash64(F.lit(7), word).bitwiseAND((1 << SIDE_BITS) - 1)).otherwise(-1).cast("int")


def positional_index(corpus: DataFrame, terms: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of some terms (word string) in the corpus, and a row per document, from one reading of the texts.

    ``uid, pos, term, left, right``: a document's number, a position from 0, the term's hash and
    16 bits of the words on either side (-1: none).  The row at position 0, which every
    document has, also carries ``doc`` (a struct of id and a hash of the text) and ``n_words``;
    its term is null where the first word is not among ``terms``.
    """
    rows = corpus.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("body"), words(F.col(text)).alias("words"))
    rows = rows.select("*", F.size("words").alias("n"))
    n_bytes = terms.agg(F.coalesce(F.sum(F.octet_length("word") + F.lit(24)), F.lit(0))).first()[0]
    terms = _sized(terms.withColumn("term", _term(F.col("word"))), n_bytes)
    left, right = (_side(F.get("words", F.coalesce("pos", F.lit(0)) + d)) for d in (-1, 1))
    # outer: an inner explode would add a filter on the size of the words and so split every text again
    spread = rows.select("*", F.posexplode_outer("words").alias("pos", "word"))
    if n_bytes <= BROADCAST_BYTES:
        # nothing is shuffled, so neighbours are looked up for postings only
        known = spread.join(terms, "word", "left").withColumns({"left": left, "right": right})
    else:
        known = spread.withColumns({"left": left, "right": right}).drop("words").join(terms, "word", "left")
    known = known.withColumn("pos", F.coalesce("pos", F.lit(0)))
    head = F.col("pos") == 0
    kept = known.where(F.col("term").isNotNull() | head)
    doc = F.when(head, F.struct(F.col("id"), F.col("body")))
    return common.written(kept.select("uid", "pos", "term", "left", "right", doc.alias("doc"), F.when(head, F.col("n").cast("long")).alias("n_words")))


def index_for(corpus: DataFrame, phrases: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all words of ``phrases`` (window array<string>)."""
    return positional_index(corpus, cut_lineage(phrases.select(F.explode("window").alias("word")).distinct()), doc_id=doc_id, text=text)


def documents_of(index: DataFrame) -> DataFrame:
    """(uid, doc, n_words) of every document of the index."""
    return index.where("n_words IS NOT NULL").select("uid", "doc", "n_words")


def _postings(index: DataFrame) -> DataFrame:
    return index.where("term IS NOT NULL").select("uid", "pos", "term", "left", "right")


def rarest_terms(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(w, window, term, offset, n): the rarest term of each distinct phrase; phrases with a term that no document holds are left out."""
    counts = cut_lineage(_postings(index).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    distinct = phrases.select("window", F.xxhash64("window").alias("w")).distinct()
    offsets = distinct.select("w", "window", F.posexplode(F.transform("window", _term)).alias("offset", "term")).join(counts, "term", "left")
    found = offsets.groupBy("w", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")).alias("rarest"))
    return found.where("rarest.n > 0").select("w", "window", "rarest.term", "rarest.offset", "rarest.n")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(w, uid, start, length): every place where a distinct phrase occurs exactly.

    ``phrases`` has (window array<string>) whose words the index knows; ``w`` is the window's hash.
    """
    anchors = cut_lineage(rarest_terms(index, phrases))
    n_bytes = anchors.agg(F.coalesce(F.sum(F.size("window") * 8 + F.lit(64)), F.lit(0))).first()[0]
    before, after = F.get("window", F.col("offset") - 1), F.get("window", F.col("offset") + 1)
    wanted = anchors.select("w", "term", "offset", F.transform("window", _term).alias("terms"), _side(F.when(F.col("offset") > 0, before)).alias("before"), _side(after).alias("after"))
    agrees = (F.col("before") < 0) | (F.col("before") == F.col("left"))
    agrees &= (F.col("after") < 0) | (F.col("after") == F.col("right"))
    places = _postings(index).join(_sized(wanted, n_bytes), "term").where(agrees & (F.col("pos") >= F.col("offset")))
    places = common.written(places.select("w", "uid", (F.col("pos") - F.col("offset")).alias("start"), "terms"))
    # the other lists, shifted by their offsets, only of documents that have a place left
    docs = _measured(places.select("uid").distinct(), 16)
    lists = _postings(index).join(docs, "uid", "left_semi").select("uid", "pos", "term")
    probes = places.select("w", "uid", "start", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    met = probes.select("w", "uid", "start", "length", (F.col("start") + F.col("offset")).alias("pos"), "term").join(lists, ["uid", "pos", "term"])
    return met.groupBy("w", "uid", "start", "length").agg(F.count(F.lit(1)).alias("n")).where("n = length").drop("n")


def proximity_matches(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """(w, uid, pos): places of a phrase's rarest term with all its other words at most ``within`` words away, in any order.

    Every word counts once, however often the phrase has it.  Lists meet by blocks of positions.
    """
    anchors = cut_lineage(rarest_terms(index, phrases))
    width = F.lit(within + 1)
    places = _postings(index).join(anchors.select("w", "term", F.array_distinct(F.transform("window", _term)).alias("terms")), "term").select("w", "uid", "pos", "terms")
    around = F.array(*(F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)))
    probes = places.select("w", "uid", F.col("pos").alias("at"), F.size("terms").alias("n_terms"), F.explode("terms").alias("term"), around.alias("blocks"))
    probes = probes.select("w", "uid", "at", "n_terms", "term", F.explode("blocks").alias("block"))
    lists = _postings(index).select("uid", "term", "pos", F.floor(F.col("pos") / width).alias("block"))
    met = probes.join(lists, ["uid", "term", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    found = met.select("w", "uid", "at", "n_terms", "term").distinct().groupBy("w", "uid", "at", "n_terms").agg(F.count(F.lit(1)).alias("n"))
    return found.where("n = n_terms").select("w", "uid", F.col("at").alias("pos"))


def contamination(index: DataFrame, item_windows: DataFrame) -> DataFrame:
    """(uid, n_hit, items): per document with a match, its words inside matches and the ids of the items whose windows occur."""
    hits = common.written(phrase_matches(index, item_windows))
    # words covered by a union of runs: each run adds what reaches beyond all runs before it
    before = Window.partitionBy("uid").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    ends = hits.select("uid", "start", "length").distinct().withColumn("reached", F.coalesce(F.max(F.col("start") + F.col("length")).over(before), F.lit(0)))
    covered = ends.groupBy("uid").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", "reached"))).alias("n_hit"))
    owners = item_windows.where("item_id IS NOT NULL").select("item_id", F.xxhash64("window").alias("w"))
    named = hits.select("uid", "w").distinct().join(owners, "w").select("uid", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = named.groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return covered.join(listed, "uid", "left")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows with one id and different texts apart."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("body"))


def contaminated_rows(corpus: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc): ``row_key`` of every row of the corpus that holds a window of an item; items without an id count."""
    found = cut_lineage(windows(items, item_id=item_id, text=item_text, width=width))
    index = index_for(corpus, found, doc_id=doc_id, text=text)
    return documents_of(index).join(phrase_matches(index, found).select("uid").distinct(), "uid").select("doc").distinct()


def report(corpus: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>) for every row of the corpus.

    Null and empty texts have no words; ``items`` is empty where nothing matches.
    Windows of items without an id are hit like others, but no id can be listed.
    Every row is looked at by itself, so repeated ids and rows are fine.  Other
    columns are left behind, whatever their names.
    """
    found = cut_lineage(windows(items, item_id=item_id, text=item_text, width=width))
    index = index_for(corpus, found, doc_id=doc_id, text=text)
    joined = documents_of(index).join(contamination(index, found), "uid", "left")
    return joined.select(F.col("doc.id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


OP6_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
item_words AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM benchmark),
item_starts AS (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS s FROM item_words WHERE len(words) > 0),
item_windows AS (SELECT DISTINCT item_id, list_slice(words, s, s + 9) AS win FROM item_starts),
lengths AS (SELECT DISTINCT len(win) AS n FROM item_windows),
doc_starts AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM doc_words, lengths WHERE len(words) >= n),
doc_windows AS (SELECT doc_id, s, n, list_slice(words, s, s + n - 1) AS win FROM doc_starts),
hits AS (SELECT DISTINCT d.doc_id, d.s, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.win = i.win),
places AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits),
covered AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
named AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM named GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN listed l ON l.doc_id = w.doc_id
"""
