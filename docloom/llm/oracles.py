"""DuckDB SQL for those of this subpackage's queries that SQL can express."""

from __future__ import annotations

from docloom.llm.mixing import Mix


def _case(column: str, named: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in sorted(named.items())) + " ELSE 1 END" if named else "1"


def _filled(children: str, parent: str, name: str) -> str:
    """children has capacity, weight and the parent's budget; adds given."""
    first = "min(CASE WHEN capacity::HUGEINT * parts > rest::HUGEINT * weight THEN rn END) OVER (PARTITION BY {p})".format(p=parent)
    at = "max(CASE WHEN rn = fst THEN {c} END) OVER (PARTITION BY {p})"
    return f"""(SELECT * EXCLUDE (rn, rest, parts, fst, f_rest, f_parts), CASE WHEN fst IS NULL OR rn < fst THEN capacity ELSE ((f_rest::HUGEINT * weight) // f_parts)::BIGINT END AS given
      FROM (SELECT *, {at.format(c='rest', p=parent)} AS f_rest, {at.format(c='parts', p=parent)} AS f_parts
      FROM (SELECT *, {first} AS fst
      FROM (SELECT *, row_number() OVER o AS rn, budget - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
              sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS parts
            FROM {children} WINDOW o AS (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name})))))"""


def mixing_sql(mix: Mix) -> str:
    domains = f"(SELECT domain, sum(capacity)::BIGINT AS capacity, {_case('domain', mix.domains)} AS weight, ((SELECT sum(tokens) FROM leaves) * {mix.share_of} // {mix.share_in})::BIGINT AS budget, 0 AS root FROM leaves GROUP BY domain)"
    langs = f"(SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, {_case('l.lang', mix.languages)} AS weight, any_value(d.given) AS budget FROM leaves l JOIN d USING (domain) GROUP BY l.domain, l.lang)"
    sources = f"(SELECT l.*, {_case('l.source', mix.sources)} AS weight, g.given AS budget FROM leaves l JOIN g USING (domain, lang))"
    return rf"""
WITH f AS (SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS mark FROM documents),
  leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {mix.epochs})::BIGINT AS capacity FROM f GROUP BY ALL HAVING sum(n_tokens) > 0),
  d AS {_filled(domains, 'root', 'domain')},
  g AS {_filled(langs, 'domain', 'lang')},
  s AS {_filled(sources, 'domain, lang', 'source')},
  e AS (SELECT f.*, s.tokens, epoch, least(greatest(s.given - epoch * s.tokens, 0), s.tokens) AS part, md5('{mix.seed}:' || epoch || ':' || doc_id || ':' || mark) AS key
        FROM f JOIN s USING (domain, lang, source), range({mix.epochs}) r(epoch) WHERE n_tokens > 0),
  c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key RANGE UNBOUNDED PRECEDING) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch, key) AS before FROM e)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens, least(n_tokens, part - before)::BIGINT AS take_tokens FROM c WHERE before < part"""


REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM t WHERE length(h) >= 100)),
  m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
  r AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE least < doc_id),
  j AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM r),
  k AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM j),
  runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY ALL),
  sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda i: substr(h, 2 * CASE WHEN i = 0 THEN 0 ELSE ends[i] END + 1, 2 * (CASE WHEN i = n_spans THEN length(h) // 2 ELSE starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE ends[i] END))), '') END)) AS kept_sha256
FROM t LEFT JOIN sums USING (doc_id)"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
  x AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
  l AS MATERIALIZED (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 75 * (len(sa.s) + len(sb.s) - n)),
  e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  c AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.o = e.a)
SELECT doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(o) AS component_id FROM c JOIN s USING (doc_id) GROUP BY doc_id"""

ORACLE_SQL = {"op2_mixing": mixing_sql(Mix()), "op6_repeats": REPEATS, "op10_jaccard_join": JACCARD}
