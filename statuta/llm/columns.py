"""Those columns of the operators' queries that SQL can say, each with its SQL. Rows come through the operators' queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.llm.fingerprints import op2_winnowing
from statuta.llm.mixing import op3_source_mixing
from statuta.llm.packing import op1_best_fit_packing
from statuta.llm.pii import op10_bootstrapped_pii
from statuta.llm.quality import op9_quality_rules
from statuta.llm.sharding import op8_compaction

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PACKED_SQL = f"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS words FROM documents"


def packed_words(spark, sf_dir):
    """op1: the words of each document that are in bins."""
    return op1_best_fit_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("words"))


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS following FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(following, 1, length(t) // 3)) AS edited_sha256 FROM n
"""


def edited_texts(spark, sf_dir):
    """op2: length and edited text of each document."""
    return op2_winnowing(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


TARGETS_SQL = f"""
WITH s AS (SELECT source, CAST(sum(len({WORDS})) AS DOUBLE) AS size FROM documents GROUP BY source), r AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, 2 * size AS cap, 1.5 * sum(size) OVER () AS total FROM s),
f AS (SELECT *, sum(cap) OVER o + cap / w * (sum(w) OVER () - sum(w) OVER o) <= total AS filled FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - coalesce(sum(CASE WHEN filled THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT filled THEN w END) OVER () AS level FROM f)
SELECT source, CAST(size AS BIGINT) AS source_size, round(CASE WHEN filled THEN cap ELSE least(cap, level * w) END, 3) AS target FROM l
"""


def mix_targets(spark, sf_dir):
    """op3: size and target of each source."""
    return op3_source_mixing(spark, sf_dir).groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"))


COMPACTED_SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"


def compacted_rows(spark, sf_dir):
    """op8: the rows of the compacted store."""
    return op8_compaction(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "text_sha256")


COUNTS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)), m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM m WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def base_counts(spark, sf_dir):
    """op9: the counts of each document and its base verdict."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


ENTITIES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS emails,
  list_filter(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS BIGINT), 256) > 255)) = 0) AS ips,
  list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 16 AND 19) AS cards,
  list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15) AS phones FROM d)
SELECT doc_id, CAST(len(emails) AS BIGINT) AS n_email, CAST(len(ips) AS BIGINT) AS n_ip,
  CAST(len(list_filter(cards, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(x, length(x) - i + 1, 1) AS BIGINT) WHEN CAST(substr(x, length(x) - i + 1, 1) AS BIGINT) > 4 THEN 2 * CAST(substr(x, length(x) - i + 1, 1) AS BIGINT) - 9 ELSE 2 * CAST(substr(x, length(x) - i + 1, 1) AS BIGINT) END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(phones) AS BIGINT) AS n_phone FROM f
"""


def base_entities(spark, sf_dir):
    """op10: base entities of each document by kind."""
    return op10_bootstrapped_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


#: op7 whole: all pairs that share a shingle, their links, and what links reach.
JOIN_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS ws FROM documents), u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS gram FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE i <= greatest(n - 4, 1)), z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y, c = zx.size AND c = zy.size AS same FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 5 * c >= 4 * (zx.size + zy.size - c)),
r AS (SELECT doc_id, doc_id AS label FROM documents UNION SELECT l.y, r.label FROM r JOIN l ON l.x = r.doc_id),
c AS (SELECT doc_id, min(label) AS class_id FROM r GROUP BY doc_id), n AS (SELECT x AS doc_id, count(*) AS links, count(*) FILTER (same) AS copies FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(links, 0) AS n_links, 1 + coalesce(copies, 0) AS n_copies FROM c LEFT JOIN n USING (doc_id)
"""

OWN = {
    "packed_words": (packed_words, PACKED_SQL), "edited_texts": (edited_texts, EDITED_SQL), "mix_targets": (mix_targets, TARGETS_SQL), "compacted_rows": (compacted_rows, COMPACTED_SQL),
    "base_counts": (base_counts, COUNTS_SQL), "base_entities": (base_entities, ENTITIES_SQL),
}
