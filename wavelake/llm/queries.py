"""The text operators' queries and their SQL.

Queries without a number show a part of an operator that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .boosting import op8_boosting
from .common import table
from .compression import judge, op6_compression
from .interaction import op12_interaction
from .language import op4_language
from .maxent import op2_maxent
from .mixing import mix, op7_mixing
from .ngramjoin import op11_ngramjoin
from .packing import op1_packing
from .passages import op5_passages
from .piecewise import op3_piecewise
from .simhash import op10_simhash
from .wrappers import op9_wrappers



def compression_counts(spark, sf_dir):
    """op6's counts and base rules, without the bands."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark, sf_dir):
    """op7's sizes and targets by source, from its documents."""
    d = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    d = d.groupBy(F.col("pattern")[0].alias("source")).agg(F.count("*").alias("documents"), F.sum("size").alias("words"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"))
    return d.select("source", "documents", "words", "source_size", "target")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_maxent": op2_maxent,
    "op3_piecewise": op3_piecewise,
    "op4_language": op4_language,
    "op5_passages": op5_passages,
    "op6_compression": op6_compression,
    "op7_mixing": op7_mixing,
    "op8_boosting": op8_boosting,
    "op9_wrappers": op9_wrappers,
    "op10_simhash": op10_simhash,
    "op11_ngramjoin": op11_ngramjoin,
    "op12_interaction": op12_interaction,
    "compression_counts": compression_counts,
    "mixing_targets": mixing_targets,
}
SQL: dict[str, str] = {
    "op5_passages": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 x AS (SELECT doc_id, s, ws[s:s + 19] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
 r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM x) WHERE k > 1),
 gone AS (SELECT DISTINCT doc_id, s + i AS p FROM r, range(0, 20) t(i)),
 every AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
 kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS t FROM every e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
 SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
    "compression_counts": r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 x AS (SELECT doc_id, s, ws[s:s + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS s FROM w WHERE len(ws) >= 3)),
 twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS k FROM x) WHERE k > 1),
 again AS (SELECT doc_id, count(DISTINCT s + i) AS n FROM twice, range(0, 3) t(i) GROUP BY doc_id),
 lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
 SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(ws) AS base_failed
 FROM w LEFT JOIN again ON w.doc_id = again.doc_id LEFT JOIN lines ON w.doc_id = lines.doc_id""",
    "mixing_targets": r"""WITH s AS (SELECT source, count(*) AS documents, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS words FROM documents GROUP BY source),
 w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0 * words AS cap, sum(words) OVER () AS total FROM s),
 l AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 a AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio)
 SELECT source, documents, words, words AS source_size, round(least(cap, coalesce(a.level * weight, cap)), 3) AS target FROM l LEFT JOIN a ON TRUE""",
    "op11_ngramjoin": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
 e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
 r AS (SELECT u AS doc_id, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id),
 c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.doc_id""",
    "op12_interaction": r"""WITH p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM (VALUES ('A'),('B'),('C'),('D'),('E')) a(f), (VALUES ('A'),('B'),('C'),('D'),('E')) b(f), (VALUES ('A'),('B'),('C'),('D'),('E')) c(f), (VALUES ('A'),('B'),('C'),('D'),('E')) d(f), (VALUES ('A'),('B'),('C'),('D'),('E')) e(f) WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
 t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 g AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 x AS (SELECT part, concat(CASE WHEN len(ws) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END,
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM t LEFT JOIN g USING (doc_id)),
 n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY part, fails),
 s AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, fails, n, good, toxic, length(regexp_replace(filter_order, '[' || CASE WHEN fails = '' THEN '_' ELSE fails END || '].*', '')) + 1 AS first FROM n, p, range(1, 6) r(step)),
 a AS (SELECT part, filter_order, step, f, sum(CASE WHEN first > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN first < step AND contains(fails, f) THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN first = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY part, filter_order, step, f)
 SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM a""",
}
