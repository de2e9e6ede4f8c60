"""Pieces of SQL that several checks share."""

from __future__ import annotations


def norm(x: str) -> str:
    """White space collapsed, invisible characters gone, ends trimmed."""
    return rf"trim(regexp_replace(regexp_replace({x}, '[\x{{00ad}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), '[ \t\n\r\f\x{{00a0}}]+', ' ', 'g'), ' ')"


def words(x: str) -> str:
    """How many words a text has."""
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'))"


#: Blocks of conversation turns: conv_id, turn, pos, text.
TURN_BLOCKS = f"""
tl AS (SELECT conv_id, turn, text AS body, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
te AS (SELECT conv_id, turn, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM tl),
tn AS (SELECT conv_id, turn, p, {norm("line")} AS text FROM te),
blocks AS MATERIALIZED (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) - 1 AS pos, text FROM tn WHERE text <> '')"""

#: Versions of conversation turns: raw and filtered hash, reason of rejection (fewer than 40 characters).
TURN_VERSIONS = TURN_BLOCKS + """,
joined AS (SELECT conv_id, turn, string_agg(text, chr(10) ORDER BY pos) AS page, sum(length(text)) AS chars FROM blocks GROUP BY ALL),
versions AS MATERIALIZED (
  SELECT c.conv_id, c.turn, sha256(coalesce(c.text, '')) AS raw_hash, sha256(lower(coalesce(page, ''))) AS filtered_hash,
         CASE WHEN coalesce(chars, 0) < 40 THEN 'too_short' END AS reject
  FROM conversations c LEFT JOIN joined USING (conv_id, turn)),
good AS (SELECT *, CASE WHEN reject IS NULL THEN filtered_hash END AS g FROM versions),
seen AS (SELECT *, last_value(g IGNORE NULLS) OVER w AS last_hash FROM good WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stored AS (SELECT *, reject IS NULL AND (last_hash IS NULL OR last_hash <> filtered_hash) AS is_version FROM seen),
latest AS MATERIALIZED (
  SELECT *, last_value(CASE WHEN is_version THEN turn END IGNORE NULLS) OVER w AS latest_at,
         last_value(CASE WHEN is_version THEN raw_hash END IGNORE NULLS) OVER w AS latest_raw
  FROM stored WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
classified AS MATERIALIZED (
  SELECT conv_id, turn, latest_at, CASE WHEN latest_raw = raw_hash THEN 'unchanged_raw' WHEN reject IS NOT NULL THEN 'rejected'
         WHEN last_hash IS NULL THEN 'first' WHEN is_version THEN 'stored' ELSE 'unchanged' END AS outcome, filtered_hash, raw_hash
  FROM latest)"""

#: Block deltas of changed turns against their latest version.
TURN_DELTA = TURN_VERSIONS + """,
pairs AS (SELECT conv_id, turn, latest_at FROM classified WHERE outcome = 'stored'),
sides AS (
  SELECT p.conv_id, p.turn, b.text, 1 AS d FROM pairs p JOIN blocks b ON b.conv_id = p.conv_id AND b.turn = p.turn
  UNION ALL SELECT p.conv_id, p.turn, b.text, -1 FROM pairs p JOIN blocks b ON b.conv_id = p.conv_id AND b.turn = p.latest_at),
delta AS MATERIALIZED (
  SELECT conv_id, turn, text, greatest(sum(d), 0) AS n_ins, greatest(-sum(d), 0) AS n_del FROM sides GROUP BY ALL HAVING sum(d) <> 0)"""
