"""Quality rules and cross-document line frequency, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, joined, written

LINE_LIMIT = 5  # documents of one host that may share a line, however small the host
LINE_SHARE = 10  # per cent of a host's documents that may share a line, where that is more
LEAST_LEFT = 30  # per cent of a document's words that must be left


def _repeat_words(words: str, hashes: str) -> str:
    """Words covered by five-word windows whose hash occurs twice or more in hashes, in SQL.

    Sorting the hashes with their places puts equal windows side by side.
    """
    ordered = f"array_sort(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = "filter(o, (x, k) -> (k > 0 AND o[k - 1].h = x.h) OR (k < size(o) - 1 AND o[k + 1].h = x.h))"
    at = f"array_sort(transform({twice}, x -> x.i))"
    covered = "aggregate(transform(p, (a, k) -> CASE WHEN k = size(p) - 1 THEN 5L ELSE CAST(least(5, p[k + 1] - a) AS BIGINT) END), 0L, (s, x) -> s + x)"
    # transform over a one-element array binds a name to a value that is used again
    return f"element_at(transform(array({ordered}), o -> element_at(transform(array({at}), p -> {covered}), 1)), 1)"


def line_quality(docs: DataFrame, line_limit: int = LINE_LIMIT, line_share: int = LINE_SHARE, least_left: int = LEAST_LEFT) -> DataFrame:
    """Rule counts for every whole text of docs (doc_id, source, text) and a verdict from cross-document line frequency.

    Lines are normalised (lower case, digits as 0, white space as one space) and hashed. A line is removed from all documents of a
    host (source) if more than line_limit distinct documents of it and more than line_share per cent of its documents hold it, so
    the limit follows the size of the host. Exact copies under different ids are
    different documents; rows with one id and one text are one document, and every row without an id is its own. A document
    is kept if the base rules pass it and at least least_left per cent of its words are left. Five-word windows
    are compared by a 64-bit hash of their words, within one text.

    Each text is read once; what is counted from it (its line hashes too) is written to the shared folder. Counts of
    (host, line, document) and of (host, line) are partial before they are shuffled. Lines join the frequent lines on
    (host, line), and these the hosts: a side of bounded bytes is sent to every task; beyond that only hubs are, hot lines
    or hosts, and the rest is shuffled. Removed words come back to rows by a unique row number.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and n_removed (words in removed
    lines). Null text has no words and fails the base rules, as does an empty one; null is a host of its own; repeated rows get
    a row each; an empty table gives none; other columns are ignored; long texts are read whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\x00null")).alias("host"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    window = ", ".join(f"words[i + {k}]" for k in range(5))
    words = words.withColumn("hashes", F.expr(f"CASE WHEN size(words) < 5 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(words) - 5), i -> xxhash64({window})) END"))
    words = words.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    normal = "lower(trim(regexp_replace(regexp_replace(x, '[0-9]', '0'), '[\\\\x20\\\\x09-\\\\x0D]+', ' ')))"
    rows = words.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", F.xxhash64("text").alias("text_key"),
        F.size("words").cast("long").alias("n_words"), F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE {_repeat_words('words', 'hashes')} END").alias("n_repeat_words"),
        F.expr(f"transform(lines, x -> named_struct('hash', xxhash64({normal}), 'words', CAST(regexp_count(x, '[^\\\\x20\\\\x09-\\\\x0D]+') AS BIGINT)))").alias("lines"),
    )
    rows = written(rows, "quality-rows")  # row numbers are fixed from here on
    document = F.xxhash64("doc_id", "text_key", F.when(F.col("doc_id").isNull(), F.col("row"))).alias("document")
    hosts = rows.groupBy("host", document).agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of"))
    lines = rows.select("row", "host", document, F.explode("lines").alias("line")).select("row", "host", "document", "line.hash", "line.words")
    held = lines.groupBy("host", "hash", "document").agg(F.count("*").alias("rows"))
    common = held.groupBy("host", "hash").agg(F.count("*").alias("documents"), F.sum("rows").alias("rows")).filter(F.col("documents") > line_limit)
    common = written(common, "quality-lines")
    hosts = written(hosts.join(common.groupBy("host").agg(F.count("*").alias("lines")), "host"), "quality-hosts")
    frequent = joined(common, hosts, "host", rows="lines").filter(100 * F.col("documents") > line_share * F.col("of")).select("host", "hash", "rows")
    removed = joined(lines, written(frequent, "quality-frequent"), ["host", "hash"], rows="rows").groupBy("row").agg(F.sum("words").alias("n_removed"))
    out = rows.drop("lines").join(removed, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_removed")) >= least_left * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & left).alias("kept"), "n_removed")


def oracle(line_limit: int = LINE_LIMIT, line_share: int = LINE_SHARE, least_left: int = LEAST_LEFT) -> str:
    """The same rows in DuckDB, for distinct ids."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, chr(0) || 'null') AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    g AS (SELECT row, i, words[i:i + 4] AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 1))) AS i)),
    twice AS (SELECT row, unnest(pos) AS i FROM (SELECT row, list(i) AS pos FROM g GROUP BY row, g HAVING count(*) > 1)),
    covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY row),
    l AS (SELECT row, host, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, lower(trim(regexp_replace(regexp_replace(x, '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM (SELECT row, host, unnest(lines) AS x FROM w)),
    hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
    frequent AS (SELECT host, line FROM l JOIN hosts USING (host) GROUP BY host, line HAVING count(DISTINCT row) > {line_limit} AND 100 * count(DISTINCT row) > {line_share} * any_value(hosts.n)),
    removed AS (SELECT row, sum(n) AS n FROM l JOIN frequent USING (host, line) GROUP BY row),
    m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed FROM w LEFT JOIN covered USING (row) LEFT JOIN removed USING (row)),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
      NOT base_failed AND 100 * (n_words - n_removed) >= {least_left} * n_words AS kept, n_removed::BIGINT AS n_removed FROM f"""
