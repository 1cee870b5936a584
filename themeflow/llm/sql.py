"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.*, coalesce(k.doc_id > f.first_doc, FALSE) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
          ("allow", "org", "/fr/"))


def _rule_case(what: str) -> str:
    longest_first = sorted(_RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
        f"THEN '{v if what == 'verdict' else h + p}'" for v, h, p in longest_first) + " ELSE NULL END"


def _level(level: str, above: str) -> str:
    """Empirical-Bayes shrinkage of one level towards the means of ``above``."""
    return f"""
{level}_groups AS (
  SELECT {level}, sum(n) AS gn, sum(bad) AS gbad, max(prior) AS prior FROM {above} GROUP BY {level}
), {level}_rho AS (
  SELECT sum(prior * (1 - prior) * (gn - 1)) AS slope,
         sum(gn * (gbad / gn - prior) ** 2) - sum(prior * (1 - prior)) AS over
  FROM {level}_groups WHERE gn > 0
), {level}_strength AS (
  SELECT coalesce(CASE WHEN slope > 0 THEN CASE WHEN over / slope > 0
      THEN least(1000.0, greatest(1.0, slope / over - 1)) ELSE 1000.0 END ELSE 20.0 END, 20.0) AS strength
  FROM {level}_rho
), {level}_post AS (
  SELECT a.* REPLACE ((g.gbad + strength * g.prior) / (g.gn + strength) AS prior)
  FROM {above} a JOIN {level}_groups g USING ({level}), {level}_strength
)"""


HOST_REPUTATION_SQL = f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)
), seen AS (
  SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
), named AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(host, '.') AS names
  FROM parsed LEFT JOIN seen ON page_id = doc_id GROUP BY host
), suffixed AS (
  SELECT *, CASE WHEN len(names) > 2 AND length(names[-1]) = 2
                      AND names[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS tail
  FROM named
), counted AS (
  SELECT host, n, bad, array_to_string(names[greatest(1, len(names) - tail + 1):], '.') AS suffix,
         array_to_string(names[greatest(1, len(names) - tail):], '.') AS domain,
         CASE WHEN sum(n) OVER () > 0 THEN (sum(bad) OVER () + 0.5) / (sum(n) OVER () + 1.0) ELSE 0.0 END AS prior
  FROM suffixed
), {_level('suffix', 'counted')}, {_level('domain', 'suffix_post')}, {_level('host', 'domain_post')},
bounds AS (
  SELECT host, n, bad, prior - 1.645 * sqrt(prior * (1 - prior) / (n + strength + 1)) AS bound
  FROM host_post, host_strength
)
SELECT page_id, host, path, {_rule_case('name')} AS rule,
       coalesce({_rule_case('verdict')}, CASE WHEN bound > 0.3 THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS n_labelled, bad::BIGINT AS n_bad
FROM parsed JOIN bounds USING (host)
"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _crc_rows() -> str:
    """The table of CRC-32, eight steps for each byte."""
    rows = "SELECT n, n::BIGINT AS c FROM range(256) AS t(n)"
    for _ in range(8):
        rows = f"SELECT n, {_CRC_STEP.format('c')} AS c FROM ({rows})"
    return rows


def _tree(name: str, leaves: str, tree: str) -> str:
    """Levels above ``leaves`` ({tree}, idx, digest, n) and their runs of 16."""
    return f"""{name} AS (
  SELECT {tree}, 0 AS level, idx, digest, n FROM {leaves}
  UNION ALL
  SELECT {tree}, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
  FROM {name} WHERE n > 1 GROUP BY {tree}, level, idx // 16, n
), {name}_runs AS (
  SELECT {tree}, level, idx // 16 AS run, list(digest ORDER BY idx) AS kids
  FROM {name} WHERE n > 1 GROUP BY {tree}, level, idx // 16
)"""


def _climb(name: str, start: str, runs: str, tree: str) -> str:
    before, behind = "array_to_string(kids[:idx % 16], '')", "array_to_string(kids[idx % 16 + 2:], '')"
    return f"""{name} AS (
  SELECT * FROM {start}
  UNION ALL
  SELECT c.rid, c.{tree}, c.level + 1, c.idx // 16, sha256({before} || c.f || {behind}), c.proof || {before} || {behind}
  FROM {name} c JOIN {runs} r ON c.{tree} = r.{tree} AND c.level = r.level AND c.idx // 16 = r.run
), {name}_end AS (
  SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1
)"""


MERKLE_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY n) AS t FROM ({_crc_rows()})),
hashed AS (
  SELECT doc_id, source, {_LEAF.format(text=_FIELD.format('text'))} AS leaf,
         {_LEAF.format(text=_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')"))} AS lowered,
         coalesce(xor(list_reduce(list_concat([4294967295::BIGINT],
             list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0, FALSE) AS tampered
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), leaves AS (SELECT sid, idx, leaf AS digest, n FROM placed
), {_tree('nodes', 'leaves', 'sid')}, subroots AS (
  SELECT 0 AS top, sid AS idx, digest, count(*) OVER () AS n FROM nodes WHERE n = 1
), {_tree('tops', 'subroots', 'top')}, started AS (
  SELECT rid, sid, 0 AS level, idx, CASE WHEN tampered THEN lowered ELSE leaf END AS f, '' AS proof FROM placed
), {_climb('low', 'started', 'nodes_runs', 'sid')}, crossed AS (
  SELECT rid, 0 AS top, 0 AS level, sid AS idx, f, proof FROM low_end
), {_climb('high', 'crossed', 'tops_runs', 'top')}
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(h.proof) AS proof_sha256,
       h.f AS folded_root, h.f = t.digest AS verified
FROM placed p JOIN high_end h USING (rid) JOIN subroots s ON p.sid = s.idx, (SELECT digest FROM tops WHERE n = 1) t
"""
