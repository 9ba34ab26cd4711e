"""Excerpts of the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.data import table
from tracewright.operators import excerpts as E

Q, SQL = {}, {}

TOPICS = {"orders": (["order", "leron", "than"], ["the", "and", "that"]), "invoices": (["eau", "entre"], ["les", "des"]),
          "notes": (["nothing of this kind"], ["license", "copyright", "permission"])}


def c6_passages(spark, folder):
    p = E.passages(table(spark, folder, "documents"))
    return p.groupBy("doc").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("passage")).alias("chars"))


Q["c6_passages"] = c6_passages
# the same greedy cut, line by line
_PASSAGES = """
    n AS (SELECT doc_id, generate_subscripts(x, 1) AS no, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS x FROM documents WHERE text IS NOT NULL)),
    l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, k) AS i, substring(line, k * 1400 + 1, 1400) AS line
        FROM (SELECT doc_id, no, line, unnest(range(0, greatest((length(line) + 1399) // 1400, 1))) AS k FROM n)),
    w AS (SELECT doc_id, i, line || chr(10) AS now, 0 AS part FROM l WHERE i = 1
        UNION ALL SELECT l.doc_id, l.i, CASE WHEN length(w.now) + length(l.line) + 1 > 700 THEN '' ELSE w.now END || l.line || chr(10),
            w.part + CASE WHEN length(w.now) + length(l.line) + 1 > 700 THEN 1 ELSE 0 END
        FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS place, t FROM (
        SELECT doc_id, part, regexp_replace(arg_max(now, i), '^\\s+|\\s+$', '', 'g') AS t FROM w GROUP BY 1, 2) WHERE t <> '')"""
SQL["c6_passages"] = f"WITH RECURSIVE {_PASSAGES} SELECT doc_id AS doc, count(*) AS passages, sum(length(t))::BIGINT AS chars FROM p GROUP BY 1"


def _hits(terms):
    return " + ".join(f"regexp_matches(t, '(?i)(^|[^A-Za-z0-9_]){x}([^A-Za-z0-9_]|$)')::INTEGER" for x in terms)


_SCORED = "s AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS topic, doc_id AS doc, place, 3 * ({_hits(a)}) + {_hits(b)} AS score, length(t) AS chars FROM p WHERE ({_hits(a)}) > 0 OR {_hits(b)} >= 2"
    for k, (a, b) in TOPICS.items()) + ")"


def c6_scores(spark, folder):
    kind = F.when(F.col("source") == "src0", "manual").when(F.col("source") == "src1", "data_dictionary").otherwise("other")
    s = E.scored_passages(E.passages(table(spark, folder, "documents").withColumn("kind", kind), kind="kind"), TOPICS)
    return s.select("topic", "doc", "place", F.round("score", 4).alias("score"))


Q["c6_scored_passages"] = c6_scores
SQL["c6_scored_passages"] = f"""WITH RECURSIVE {_PASSAGES}, {_SCORED}
    SELECT topic, doc, place, round(score * CASE source WHEN 'src0' THEN 1.3 WHEN 'src1' THEN 2 ELSE 1 END, 4)::DOUBLE AS score FROM s JOIN documents ON doc_id = doc"""


def c6_excerpts(spark, folder):
    s = E.scored_passages(E.passages(table(spark, folder, "documents")), TOPICS)
    return E.pick_excerpts(s).select("topic", "doc", "place", F.length("passage").alias("chars"), F.round("score", 4).alias("score"))


Q["c6_excerpts"] = c6_excerpts
# greedy: a passage is taken when it still fits
SQL["c6_excerpts"] = f"""WITH RECURSIVE {_PASSAGES}, {_SCORED},
    o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc, place) AS r FROM s),
    g AS (SELECT topic, doc, place, score, chars, r, CASE WHEN chars <= 2500 THEN chars ELSE 0 END AS used, chars <= 2500 AS taken FROM o WHERE r = 1
        UNION ALL SELECT o.topic, o.doc, o.place, o.score, o.chars, o.r, g.used + CASE WHEN g.used + o.chars <= 2500 THEN o.chars ELSE 0 END, g.used + o.chars <= 2500
        FROM g JOIN o ON o.topic = g.topic AND o.r = g.r + 1)
    SELECT topic, doc, place, chars, score::DOUBLE AS score FROM g WHERE taken"""
