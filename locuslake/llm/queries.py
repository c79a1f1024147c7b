"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op5_nearest_neighbours
from .decontamination import UNITS, op3_decontamination
from .html_extraction import op2_html_extraction
from .lm_scoring import op9_lm_scoring
from .near_duplicates import op8_near_duplicates
from .packing import op7_packing
from .pii import op1_pii_surrogates
from .quality import op6_quality_classifier
from .substring_dedup import op4_substring_dedup
from .toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_pii_surrogates, op2_html_extraction, op3_decontamination, op4_substring_dedup, op5_nearest_neighbours, op6_quality_classifier, op7_packing, op8_near_duplicates, op9_lm_scoring, op10_toxicity)
}

_UNITS = ", ".join(f"'{u}'" for u in UNITS)

ORACLE_SQL = {
    # Placeholders, windows at their first place in an item, best alignment, slots: all by plain joins.
    "op3_decontamination": r"""
WITH texts AS (
  SELECT 'd' AS origin, doc_id AS id, coalesce(text, '') AS text FROM documents GROUP BY ALL UNION ALL SELECT 'b' AS origin, item_id AS id, text FROM benchmark WHERE text IS NOT NULL GROUP BY ALL
),
cut AS MATERIALIZED (SELECT origin, id, text, regexp_extract_all(text, '\d+(?:[.,]\d+)*|\pL+') AS words FROM texts),
formed AS MATERIALIZED (
  SELECT origin, id, text, words, list_transform(range(1, len(words) + 1), lambda k:
    CASE WHEN words[k] < ':' THEN '<num>'
         WHEN k > 1 AND words[k - 1] < ':' AND length(words[k]) <= 7 AND lower(words[k]) IN @UNITS@ THEN '<unit>'
         WHEN lower(words[k]) = words[k] OR upper(words[k]) = words[k] THEN lower(words[k])
         ELSE '<name>' END) AS form
  FROM cut
),
items AS MATERIALIZED (SELECT id AS item_id, text AS item_text, words AS item_words, form AS item_form, least(len(words), 8) AS n FROM formed WHERE origin = 'b' AND len(words) >= 4),
item_windows AS MATERIALIZED (
  SELECT item_id, item_text, n, win, min(pos) AS item_pos, any_value(wins) AS wins FROM (
    SELECT *, count(DISTINCT win) OVER (PARTITION BY item_id, item_text) AS wins FROM (
      SELECT item_id, item_text, n, pos, CASE WHEN n = 8 THEN array_to_string(item_form[pos + 1:pos + 8], ' ') ELSE lower(array_to_string(item_words, ' ')) END AS win
      FROM (SELECT *, unnest(range(0, len(item_words) - n + 1)) AS pos FROM items) q) p) o
  GROUP BY item_id, item_text, n, win
),
seen AS MATERIALIZED (
  SELECT id AS doc_id, text, pos, 8 AS n, array_to_string(form[pos + 1:pos + 8], ' ') AS win FROM (SELECT *, unnest(range(0, len(words) - 7)) AS pos FROM formed WHERE origin = 'd') q
  UNION ALL
  SELECT id AS doc_id, text, pos, s.n, lower(array_to_string(words[pos + 1:pos + s.n], ' ')) AS win
  FROM (SELECT f.*, k.n, unnest(range(0, len(words) - k.n + 1)) AS pos FROM formed f, (SELECT DISTINCT n FROM items WHERE n < 8) k WHERE origin = 'd') s
),
aligned AS MATERIALIZED (
  SELECT doc_id, text, item_id, item_text, i.n, s.pos - item_pos AS moved, count(DISTINCT item_pos) AS matched, any_value(wins) AS wins, list(DISTINCT item_pos) AS spots
  FROM seen s JOIN item_windows i ON i.win = s.win AND i.n = s.n GROUP BY doc_id, text, item_id, item_text, i.n, s.pos - item_pos HAVING count(DISTINCT item_pos) >= 0.3 * any_value(wins)
),
covered AS MATERIALIZED (
  SELECT DISTINCT doc_id, text, item_id, item_text, n, moved, matched, wins, spot FROM (SELECT *, unnest(range(pos, pos + n)) AS spot FROM (SELECT *, unnest(spots) AS pos FROM aligned) q) p
),
slots AS (
  SELECT c.*, i.item_form[spot + 1] AS kind, i.item_words[spot + 1] AS item_val, d.words[spot + moved + 1] AS val
  FROM covered c JOIN items i ON i.item_id IS NOT DISTINCT FROM c.item_id AND i.item_text = c.item_text JOIN formed d ON d.origin = 'd' AND d.id IS NOT DISTINCT FROM c.doc_id AND d.text = c.text
),
judged AS (
  SELECT doc_id, text, item_id, item_text, moved, n, matched, wins, count(DISTINCT CASE WHEN kind[1] = '<' THEN kind || ' ' || item_val || ' ' || val END) AS slots,
         count(DISTINCT CASE WHEN kind[1] = '<' THEN kind || ' ' || item_val END) AS asked, bool_or(kind[1] <> '<') AS literal, bool_and(kind[1] <> '<' OR item_val = val) AS verbatim
  FROM slots GROUP BY ALL
),
best AS (
  SELECT doc_id, item_id, max(row(matched, verbatim, slots, wins)) AS b FROM judged WHERE (slots = asked OR n < 8) AND (literal OR verbatim) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(b[1] AS BIGINT) AS matched, CAST(b[4] AS BIGINT) AS item_windows, CAST(b[3] AS BIGINT) AS slots, b[2] AS verbatim FROM best
""".replace("@UNITS@", f"({_UNITS})"),
    # All pairs that share a run of five words, exact similarities, components.
    "op8_near_duplicates": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
texts AS MATERIALIZED (SELECT min(doc_id) AS doc, words FROM w WHERE len(words) > 0 GROUP BY words),
runs AS MATERIALIZED (
  SELECT doc, md5(array_to_string(words[i:i + least(5, len(words)) - 1], ' ')) AS run, count(*) AS n
  FROM (SELECT doc, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS i FROM texts) q GROUP BY ALL
),
total AS MATERIALIZED (SELECT doc, sum(n) AS n FROM runs GROUP BY doc),
pairs AS MATERIALIZED (
  SELECT a.doc AS a, b.doc AS b, sum(least(a.n, b.n)) AS common FROM runs a JOIN runs b ON a.run = b.run AND a.doc < b.doc GROUP BY a.doc, b.doc
),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN total x ON x.doc = a JOIN total y ON y.doc = b WHERE common / (x.n + y.n - common) >= 0.8
),
paired AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b AS a, a AS b FROM links),
reach AS (SELECT DISTINCT a AS doc, a AS other FROM paired UNION SELECT r.doc, e.b AS other FROM reach r JOIN paired e ON e.a = r.other),
grouped AS MATERIALIZED (SELECT doc, min(other) AS class_id FROM reach GROUP BY doc),
of_doc AS (SELECT w.doc_id, min(coalesce(c.class_id, t.doc)) AS class_id FROM w JOIN texts t ON t.words = w.words LEFT JOIN grouped c ON c.doc = t.doc GROUP BY w.doc_id)
SELECT w.doc_id, coalesce(o.class_id, w.doc_id) AS class_id, w.doc_id = coalesce(o.class_id, w.doc_id) AS representative FROM w LEFT JOIN of_doc o ON o.doc_id = w.doc_id
""",
    "op4_substring_dedup": r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
hit AS (SELECT win.doc_id, win.i FROM win JOIN low USING (h) WHERE win.doc_id > low.low),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS gone_at FROM hit),
list_gone AS (SELECT doc_id, list(gone_at) AS ats FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(w.words) AS n, coalesce(len(g.ats), 0) AS removed,
         CASE WHEN g.ats IS NULL THEN w.words
              ELSE list_transform(list_filter(range(1, len(w.words) + 1), lambda k: NOT list_contains(g.ats, k)), lambda k: w.words[k]) END AS left_
  FROM w LEFT JOIN list_gone g USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS n_removed, sha256(array_to_string(left_, ' ')) AS kept_sha256 FROM kept
""",
}
