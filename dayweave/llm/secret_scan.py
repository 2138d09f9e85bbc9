"""Secrets in texts, judged by how many owners hold the same value, with DataFrame operations only.

Texts are read once: every pattern yields its matches and, where there are any, the
lengths of the gaps between them.  Only these leave the scan.  Places are running
sums of gaps and matches.  The hashes of all candidate values are then counted over
the whole corpus by distinct repositories and owners: a value that many hold is a
copied example, a value of one owner that looks random is a live credential.  Base
spans stay whatever the verdict; tokens without a telling keyword or format become
spans of their own only where the count says that they belong to one owner.

The counts are taken in three steps (value, owner, repository), each combined before
its shuffle, so that a value copied a billion times is a row per task.  The join of
places with verdicts is a plain equi join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm import common

# The patterns and least lengths of base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

#: A maximal run of characters that generated credentials are made of.
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}"
KINDS = ("assign", "access", "hex", "token")
BASE_KINDS = 3
#: A live credential is held by at most so many owners and repositories, and has at least so many different characters.
MOST_OWNERS, MOST_REPOSITORIES, LEAST_DISTINCT = 2, 20, 10

SPAN = "array<struct<start:bigint,kind:int,end:bigint,owners:bigint,repositories:bigint,live:boolean>>"


def _hits(kind: int, matches: Column, text: Column, pattern: str) -> Column:
    """Matches with the length of the gap before each; the text behind the last one comes with a null match."""
    pairs = F.zip_with(matches, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap")))
    numbered = F.transform(pairs, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), p["gap"].alias("gap"), p["match"].alias("match")))
    return F.when(F.size(matches) > 0, numbered).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,match:string>>"))


def scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """(uid, doc, owner, repository, hits): all matches of a row with the gap before each; ``uid`` numbers the rows."""
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    rows = df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc"), F.col(owner).cast("string").alias("owner"),
        F.col(repository or doc_id).cast("string").alias("repository"), F.coalesce(text, F.lit("")).alias("body"),
    )
    matched = rows.withColumns({f"m{k}": F.regexp_extract_all("body", F.lit(p), F.lit(0)) for k, p in enumerate(patterns)})
    hits = F.concat(*(_hits(k, F.col(f"m{k}"), F.col("body"), p) for k, p in enumerate(patterns)))
    return matched.select("uid", "doc", "owner", "repository", hits.alias("hits"))


def looks_random(value: Column) -> Column:
    """A value with digits, letters and enough different characters."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= LEAST_DISTINCT)


def places(scanned: DataFrame) -> DataFrame:
    """(uid, owner, repository, kind, start, end, print, random): one row per candidate, without tokens that touch a base span."""
    rows = scanned.select("uid", "owner", "repository", F.explode_outer("hits").alias("hit")).where("hit.match is not null").select("uid", "owner", "repository", "hit.*")
    size = F.length("match").cast("long")
    running = Window.partitionBy("uid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("end", F.sum(F.col("gap") + size).over(running)).withColumn("start", F.col("end") - size)
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    found = found.withColumn("value", value).where((F.col("kind") != 0) | (F.length("value") >= LEAST_VALUE))
    base = F.col("kind") < BASE_KINDS
    before = Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    reach = found.withColumns({"last_end": F.max(F.when(base, F.col("end"))).over(before), "next_start": F.min(F.when(base, F.col("start"))).over(after)})
    free = (F.coalesce("last_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("next_start", F.col("end")) >= F.col("end"))
    kept = reach.where(base | (free & looks_random(F.col("value"))))
    return kept.select("uid", "owner", "repository", "kind", "start", "end", F.unhex(F.md5("value")).alias("print"), looks_random(F.col("value")).alias("random"))


def ownership(found: DataFrame) -> DataFrame:
    """(print, owners, repositories): distinct holders of every candidate value; a missing owner or repository counts as one."""
    held = found.select("print", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    by_owner = held.groupBy("print", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("print").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None,
    most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """(doc_id, spans): one row per input row, its spans by start and kind.

    A span is (start, kind, end, owners, repositories, live) in code points, the end
    exclusive; ``kind`` is a place in ``KINDS``.  Base spans are all there; spans of
    kind token are there only if live: held by at most ``most_owners`` distinct
    owners and ``most_repositories`` distinct repositories (without a column for
    them, documents) and random looking.  Repositories are counted per owner.
    Null texts are empty; rows with one id, also repeated ones, are each a row of
    the result and together one repository; null ids and null owners count as one
    unknown repository or owner.  Texts of any length are read whole.  Other
    columns are left behind, whatever their names.
    """
    scanned = common.written(scan(df, doc_id=doc_id, text=text, owner=owner, repository=repository))
    found = common.written(places(scanned))
    few = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = found.join(ownership(found), "print").withColumn("live", few & F.col("random"))
    kept = judged.where((F.col("kind") < BASE_KINDS) | F.col("live"))
    spans = kept.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("spans"))
    joined = scanned.select("uid", "doc").join(spans, "uid", "left")
    return joined.select(F.col("doc").alias(doc_id), F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def written_spans(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(found: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests per row of ``find_secrets``, with the spans judged live and those judged widely copied."""
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)

    def n(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of(kind: int) -> Column:
        return n(lambda s: s["kind"] == kind).alias(f"n_{KINDS[kind]}")

    return found.select(
        doc_id,
        *map(of, range(BASE_KINDS)),
        F.sha2(written_spans(base), 256).alias("base_sha256"),
        written_spans(F.col("spans")).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"),
        n(lambda s: ~s["live"]).alias("n_copied"),
    )


OP11_SQL = r"""
WITH patterns(kind, pattern) AS (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (3, '[A-Za-z0-9_-]+')),
least(kind, n) AS (VALUES (0, 0), (1, 16), (2, 32), (3, 16)),
docs AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS owner, coalesce(CAST(doc_id AS VARCHAR), '') AS repository, coalesce(text, '') AS body FROM documents),
lists AS (
  SELECT uid, owner, repository, kind, regexp_extract_all(body, pattern) AS m, regexp_split_to_array(body, pattern) AS g FROM docs, patterns
  WHERE regexp_matches(body, pattern)),
rows_ AS (SELECT uid, owner, repository, kind, unnest(m) AS match, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS nth FROM lists),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY uid, kind ORDER BY nth) AS BIGINT) AS stop,
         CASE WHEN kind = 0 THEN regexp_extract(match, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE match END AS value
  FROM rows_),
good AS (
  SELECT p.*, p.stop - length(match) AS start, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10 AS random
  FROM placed p JOIN least l USING (kind) WHERE length(match) >= l.n AND (kind <> 0 OR length(value) >= 8)),
candidates AS (
  SELECT * FROM good g WHERE kind < 3 OR (random AND NOT EXISTS (SELECT 1 FROM good b WHERE b.uid = g.uid AND b.kind < 3 AND b.start < g.stop AND b.stop > g.start))),
holders AS (
  SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM candidates GROUP BY value),
kept AS (
  SELECT c.*, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start || ':' || stop AS span, random AND owners <= 2 AND repositories <= 20 AS live
  FROM candidates c JOIN holders h USING (value))
SELECT d.doc_id, count(*) FILTER (WHERE k.kind = 0) AS n_assign, count(*) FILTER (WHERE k.kind = 1) AS n_access, count(*) FILTER (WHERE k.kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE k.kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans,
       count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied
FROM docs d LEFT JOIN kept k ON k.uid = d.uid AND (k.kind < 3 OR k.live)
GROUP BY d.uid, d.doc_id
"""
