"""Line deduplication by winnowing over line hashes.

Built-in DataFrame functions only. Lines are compared by a hash of their trimmed text; blank lines take no part. In every
window of ``run`` lines the last of the least hashes is selected, and a selected position is kept once, with the lines
around it as far as the windows reach that selected it. Equal windows select the same line at the same offset, so any
repeated run of that many lines shares a fingerprint. Fingerprints of a single position go; positions that are left join,
and their matches are extended both ways over those windows: one that also begins earlier in the corpus is a
later repeat. Overlapping windows make up runs, which are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, fresh, table, tables, text_or_empty

#: Least number of lines of a repeated run.
RUN = 3
#: Words at which a shorter run counts too, where runs are judged by content; one word is a run of other than white space.
WORDS = 25


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _filled(text: Column) -> Column:
    """Lines that are not blank: structs of their place among all lines, two hashes of the trimmed text, and its words."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), _trimmed(x).alias("t")))
    kept = F.filter(lines, lambda x: x["t"] != "")
    return F.transform(kept, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g"), F.size(F.split(x["t"], r"[\x20\x09-\x0D]+")).alias("w")))


def _selected(start: Column, run: int) -> Column:
    """The place, among the elements of column lines, of the last least hash of the window that begins at ``start``."""
    if run == 1:
        return start
    least = F.least(*[F.struct(F.get("lines", start + k)["h"].alias("h"), (-(start + k)).alias("p")) for k in range(run)])
    return -least["p"]


def _starts(run: int) -> Column:
    return F.when(F.size("lines") >= run, F.sequence(F.lit(0), F.size("lines") - run)).otherwise(F.array().cast("array<int>"))


def _wordy(width: int, words: int, found) -> Column:
    """What the windows of ``width`` lines select that hold ``words`` words or more."""
    held = lambda s: sum((F.get("lines", s + k)["w"] for k in range(width)), F.lit(0)) >= words
    return F.transform(F.filter(_starts(width), held), lambda s: found(width, s, F.lit(1), _selected(s, width)))


def positions(rows: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """(id, key, width, h, g, line, near) of every selected position, once, of ``rows`` (id, key, lines).

    h and g are the hashes of the selected line, line its place; near holds the lines of the windows of ``width`` lines
    that selected it. With ``words``, shorter windows of that many words or more select positions too.
    """
    rows = rows.withColumn("selected", F.transform(_starts(run), lambda i: _selected(i, run)))
    # Windows that select one position follow each other: the first of them, and how many there are.
    new = lambda i: (i == 0) | (F.get("selected", i) != F.get("selected", i - 1))
    rows = rows.withColumn("firsts", F.filter(F.when(F.size("selected") > 0, F.sequence(F.lit(0), F.size("selected") - 1)).otherwise(F.array().cast("array<int>")), new))
    found = lambda width, s, n, p: F.struct(F.lit(width).alias("width"), s.alias("s"), n.alias("n"), p.alias("p"))
    stop = lambda j: F.coalesce(F.get("firsts", j + 1), F.size("selected"))
    all_found = F.transform("firsts", lambda s, j: found(run, s, stop(j) - s, F.get("selected", s)))
    for width in range(1, run) if words is not None else ():
        all_found = F.concat(all_found, _wordy(width, words, found))
    out = rows.select("id", "key", "lines", F.explode(all_found).alias("x"))
    at = F.get("lines", F.col("x.p"))
    near = F.transform(F.slice("lines", F.col("x.s") + 1, F.col("x.n") + F.col("x.width") - 1), lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"), x["g"].alias("g")))
    return out.select("id", "key", "x.width", at["h"].alias("h"), at["g"].alias("g"), at["i"].alias("line"), near.alias("near"))


def later_repeats(docs: DataFrame, run: int = RUN, id_column: str = "doc_id", text_column: str = "text", words: int | None = None) -> DataFrame:
    """Rows (id, key, gone) of the texts that hold later repeats; key is a hash of the text.

    gone holds a boolean per line as far as the last one to delete. Places in the corpus are ordered by (id, key, line),
    null ids first. Rows that repeat both id and text have the same places, and are treated alike.
    """
    text = text_or_empty(docs, text_column)
    rows = docs.select(docs[id_column].cast("long").alias("id"), F.xxhash64(text).alias("key"), _filled(text).alias("lines"))
    with tables(docs.sparkSession) as keep:
        selected = keep(positions(rows, run, words))
        place = F.struct("id", "key", "line")
        repeated = selected.groupBy("width", "h", "g").agg(F.min(place).alias("low"), F.max(place).alias("high"))
        repeated = keep(repeated.where("low != high").select("width", "h", "g"))
        # Both ways from a position: the windows that selected it.
        near = selected.join(repeated, ["width", "h", "g"], "left_semi")
        near = near.select("id", "key", "width", "near", F.explode(F.sequence(F.lit(0), F.size("near") - F.col("width"))).alias("j"))
        window = F.slice("near", F.col("j") + 1, F.col("width"))
        field = lambda name: F.transform(window, lambda x: x[name])
        windows = keep(near.select("id", "key", field("i").alias("places"), F.xxhash64(field("h")).alias("a"), F.xxhash64(field("g")).alias("b")))
        start = F.struct("id", "key", F.get("places", 0).alias("line"))
        first = windows.groupBy("a", "b").agg(F.min(start).alias("first"), F.max(start).alias("last"))
        first = keep(first.where("first != last").select("a", "b", "first"))
        later = windows.join(first, ["a", "b"]).where(F.col("first") < start)
        sorted_lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list("places"))))
        lines = later.groupBy("id", "key").agg(sorted_lines.alias("lines"))
        before = F.concat(F.array(F.lit(-1)), F.slice("lines", 1, F.size("lines") - 1))
        kept_between = F.zip_with("lines", before, lambda line, last: line - last - 1)
        gone = F.flatten(F.transform(kept_between, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))
        return cut(lines.select("id", "key", gone.alias("gone")))


def deduplicate(docs: DataFrame, run: int = RUN, id_column: str = "doc_id", text_column: str = "text", removed: str | None = None, length_column: str | None = None, words: int | None = None) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted from the text; all rows and columns stay.

    A run is ``run`` or more consecutive lines, blank ones not counted, that are equal, after trimming ASCII white space,
    to lines that begin earlier: in a row of a smaller id, or further up. Runs are judged on the input, so the
    first occurrence always stays. Blank lines stay. Null texts stay null, and texts without repeats as they are. Null
    ids come first; rows that repeat id and text are treated alike; an empty table gives none. ``removed`` names a
    column to add, with the number of lines deleted; ``length_column`` one of ``docs`` that is set to the new length in
    code points of the texts that change. With ``words``, shorter runs of that many words or more are deleted likewise.
    """
    if run < 1:
        raise ValueError("a run has one line at least")
    found = later_repeats(docs, run, id_column, text_column, words)
    text = text_or_empty(docs, text_column)
    id_f, key_f, gone_f = (fresh(docs, n) for n in ("id_f", "key_f", "gone_f"))
    found = found.select(F.col("id").alias(id_f), F.col("key").alias(key_f), F.col("gone").alias(gone_f))
    joined = docs.join(found, docs[id_column].cast("long").eqNullSafe(F.col(id_f)) & (F.xxhash64(text) == F.col(key_f)), "left")
    lines = F.zip_with(F.split(text, "\n", -1), gone_f, lambda line, gone: F.when(~F.coalesce(gone, F.lit(False)), line))
    kept = F.array_join(F.filter(lines, lambda line: line.isNotNull()), "\n")
    changed = {text_column: kept}
    if length_column is not None:
        changed[length_column] = F.length(kept).cast(docs.schema[length_column].dataType)
    columns = [F.when(F.col(gone_f).isNull(), joined[c]).otherwise(changed[c]).alias(c) if c in changed else joined[c] for c in docs.columns]
    if removed is not None:
        columns.append(F.size(F.filter(F.coalesce(F.col(gone_f), F.array().cast("array<boolean>")), lambda x: x)).alias(removed))
    return joined.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, and the SHA-256 of the text that is left.

    Later runs of three lines go, and shorter ones of 25 words or more.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = deduplicate(docs, removed="n_removed", words=WORDS)
    return out.select("doc_id", "n_lines", F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), filled AS (
  SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM lines
), follow AS (
  SELECT doc_id, i, [t, lead(t, 1) OVER w, lead(t, 2) OVER w] AS ts, [i, lead(i, 1) OVER w, lead(i, 2) OVER w] AS places,
    len(string_split_regex(t, '[\x20\x09-\x0D]+')) AS n, lead(len(string_split_regex(t, '[\x20\x09-\x0D]+'))) OVER w AS next
  FROM filled WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, i, ts, places FROM follow WHERE places[3] IS NOT NULL
  UNION ALL SELECT doc_id, i, ts[:2], places[:2] FROM follow WHERE places[2] IS NOT NULL AND n + next >= 25
  UNION ALL SELECT doc_id, i, ts[:1], places[:1] FROM follow WHERE n >= 25
), later AS (
  SELECT *, row_number() OVER (PARTITION BY ts ORDER BY doc_id, i) AS nth FROM runs
), gone AS (
  SELECT DISTINCT doc_id, unnest(places) AS i FROM later WHERE nth > 1
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
GROUP BY l.doc_id
"""
