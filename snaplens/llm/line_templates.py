"""Line dedup with a fixed-depth tree of line templates; DataFrame functions only.

A line is cut into tokens. Tokens with a digit are variable fields and become
``<*>``. The tree's path is the token count and the leading tokens; the leaf holds the
template of the whole line and, for longer lines, ``SEGMENTS`` generalised templates
in which one run of the remaining tokens is variable as well. Lines too short for the tree and
long passages are leaves as they are written. A leaf recurs if enough documents hold it. Its
lines stay in the first of them and go elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplens.llm.common import SPACES, new_folder, plain, removed, saved, stored

LEAD = 2  # leading tokens on the path
SEGMENTS = 4  # runs of the rest, one of which may vary
SHORTEST = 4  # lines with fewer fixed tokens are no template; they only recur literally
BLANKS = " \t\n\v\f\r"
PASSAGE = 50  # lines of more tokens recur literally from the second document on
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"  # a token with a digit
GENERAL = 8  # lines from this many tokens on are generalised


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_dropped``.

    A template recurs when at least ``min_docs`` rows hold it; the first document is
    the one with the smallest id. Lines too short for a template recur as they are written,
    without the spaces around them, and so do lines of more than ``PASSAGE`` tokens, for which
    two rows suffice. Blank lines always stay.

    What happens to a line depends only on its words and the document's id, so repeated rows
    are treated alike. Rows without id come last, each text of them a document of its own.
    A null text stays null with no lines, an empty one is one empty line. Lines end at ``\\n``.
    Other columns pass through; those named like a new one are replaced.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    nameless = F.when(plain(doc_id).isNull(), F.xxhash64(plain(text))).otherwise(0).alias("h")
    row = docs.select(plain(doc_id).alias("d"), nameless, plain(text).alias("t"), F.struct(*map(plain, others)).alias("r"))
    folder = new_folder(docs.sparkSession, "lines")
    held = stored(row.filter("t is not null").select("d", "h", _line_keys().alias("lines")), folder)

    keys = held.select("d", "h", F.explode(F.array_distinct(F.flatten("lines.keys"))).alias("key"))
    enough = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, min(2, min_docs)).otherwise(min_docs)
    recurring = (
        keys.groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.min("h").alias("first_h"))
        .filter(F.col("n") >= enough).select("key", "first", "first_h")
    )
    lines = held.select("d", "h", F.explode("lines").alias("l")).select("d", "h", F.col("l.line"), F.explode("l.keys").alias("key"))
    # Without a first id all holders are nameless, and the smallest text hash is first.
    is_first = F.col("d").eqNullSafe(F.col("first")) & (F.col("first").isNotNull() | (F.col("h") == F.col("first_h")))
    gone = (
        lines.join(recurring, "key").filter(~is_first)
        .groupBy(F.col("d").alias("d2"), F.col("h").alias("h2")).agg(F.collect_set("line").alias("gone"))
    )
    gone = saved(gone, "gone")
    removed(docs.sparkSession, folder)  # the keys of all lines go before texts move

    parts = F.split("t", "\n")
    stay = F.when(F.col("gone").isNull(), parts).otherwise(
        F.filter(parts, lambda l: ~F.array_contains("gone", F.xxhash64(l)))
    )
    out = row.join(gone, F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").select(
        "r", "t", stay.alias("stay"), F.coalesce(F.size(parts), F.lit(0)).alias("n")
    )
    kept = F.when(F.col("t").isNotNull(), F.array_join("stay", "\n"))
    return out.select(
        *[kept.alias(c) if c == text else F.col("r").getField(c).alias(c) for c in others],
        F.when(F.col("t").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.when(F.col("t").isNull(), 0).otherwise(F.col("n") - F.size("stay")).cast("long").alias("n_dropped"),
    )


def _line_keys() -> Column:
    """The document's different lines, each with its hash and the hashes of its templates."""
    blanks = F.lit(BLANKS)

    def cut(line: Column) -> Column:
        # Most lines have no digit and skip the replacement, whose look-behind starts a match
        # at the front of a token only: linear in the text.
        masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, "<*>")).otherwise(line)
        return F.struct(
            F.xxhash64(line).alias("line"),
            F.split(F.btrim(masked, blanks), SPACES + "+").alias("tokens"),
            F.xxhash64(F.lit(-1), F.btrim(line, blanks)).alias("literal"),
        )

    written = F.filter(F.array_distinct(F.split("t", "\n")), lambda l: F.btrim(l, blanks) != "")
    return F.transform(F.transform(written, cut), lambda c: F.struct(c["line"].alias("line"), _templates(c["tokens"], c["literal"]).alias("keys")))


def _templates(tokens: Column, literal: Column) -> Column:
    n = F.size(tokens)
    whole = F.xxhash64(F.lit(0), n, tokens)
    general = []
    for i in range(SEGMENTS):
        start = F.lit(LEAD) + F.floor((n - LEAD) * F.lit(i) / SEGMENTS).cast("int")
        end = F.lit(LEAD) + F.floor((n - LEAD) * F.lit(i + 1) / SEGMENTS).cast("int")
        general.append(F.xxhash64(F.lit(i + 1), n, F.slice(tokens, F.lit(1), start), F.slice(tokens, end + 1, n - end)))
    short = F.size(F.array_remove(tokens, F.lit("<*>"))) < SHORTEST
    # The lowest bit of a key tells whether it is that of a passage.
    even, passage = lambda k: k.bitwiseAND(F.lit(-2)), F.array(literal.bitwiseOR(F.lit(1)))
    found = F.when(n < GENERAL, F.array(even(whole))).otherwise(F.array(*map(even, [whole, *general])))
    return (
        F.when(short & (n > PASSAGE), passage).when(short, F.array(even(literal)))
        .when(n > PASSAGE, F.concat(found, passage)).otherwise(found)
    )


# The same rule for an engine with list functions; columns as op9_line_dedup returns them.
LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line, unnest(m) AS masked FROM (
    SELECT doc_id, string_split(text, chr(10)) AS l, string_split(
      regexp_replace(text, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), chr(10)) AS m
    FROM documents WHERE text IS NOT NULL)
), toks AS (
  SELECT doc_id, pos, line, list_filter(regexp_split_to_array(masked, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM lines
), keyed AS (
  SELECT doc_id, pos, line, len(t) AS n, i,
    CASE WHEN i = 0 THEN t ELSE list_slice(t, 1, 2 + CAST(floor((len(t) - 2) * (i - 1) / 4.0) AS INT)) END AS a,
    CASE WHEN i = 0 THEN [] ELSE list_slice(t, 3 + CAST(floor((len(t) - 2) * i / 4.0) AS INT), len(t)) END AS b
  FROM toks, (SELECT unnest([0, 1, 2, 3, 4]) AS i)
  WHERE len(list_filter(t, lambda x: x <> '<*>')) >= 4 AND (i = 0 OR len(t) >= 8)
  UNION ALL
  SELECT doc_id, pos, line, 0 AS n, CASE WHEN len(t) > 50 THEN -1 ELSE -2 END AS i,
    [trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))] AS a, [] AS b
  FROM toks WHERE len(t) > 50 OR (len(t) > 0 AND len(list_filter(t, lambda x: x <> '<*>')) < 4)
), recurring AS (
  SELECT n, i, a, b, min(doc_id) AS first FROM (SELECT DISTINCT doc_id, n, i, a, b FROM keyed)
  GROUP BY n, i, a, b HAVING count(*) >= CASE WHEN i = -1 THEN 2 ELSE 3 END
), gone AS (
  SELECT DISTINCT k.doc_id, k.pos FROM keyed k JOIN recurring r
  ON k.n = r.n AND k.i = r.i AND k.a = r.a AND k.b = r.b AND k.doc_id <> r.first
), sums AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
    md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS text_md5
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_dropped, 0) AS n_dropped, s.text_md5
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
