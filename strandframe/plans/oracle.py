"""DuckDB SQL of alignment recurrences, to hold the engine's results against."""

from __future__ import annotations

from ..scheme import CELL_FLOOR, DEFAULT, ScoringScheme

NAMES = "SELECT n_nationkey::BIGINT AS k1, r_regionkey::BIGINT AS k2, n_name AS a, r_name AS b FROM nation, region"
PARTS = "SELECT x.p_name AS k1, y.p_name AS k2, x.p_name AS a, y.p_name AS b FROM (SELECT DISTINCT p_name FROM part) x JOIN (SELECT DISTINCT p_name FROM part) y ON x.p_name < y.p_name"
DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def dp(pairs: str, scheme: ScoringScheme = DEFAULT) -> str:
    """CTEs ending in `scored` (k1, k2, a, b, global_score, max_cell_score) for a query of k1, k2, a, b.

    One step of the recursion is a row: h are the row's scores at columns 0 to m, e the gaps that enter it from above. A
    gap along the row starts at any column before; its best start is looked up directly.
    """
    m, x, e, o = scheme.match, scheme.mismatch, scheme.gap_extend, scheme.gap_open
    g = f"list_transform(range(1, length(a) + 1), lambda j: greatest(h[j] + (CASE WHEN a[j] = b[i + 1] THEN {m} ELSE {x} END), e[j]))"
    f = f"list_max(list_transform(range(0, j), lambda k: (CASE WHEN k = 0 THEN {o} + (i + 1) * {e} ELSE g[k] END) + {o} + (j - k) * {e}))"
    return f"""
pairs AS ({pairs}),
dp AS (
  SELECT k1, k2, a, b, 0 AS i, list_transform(range(0, length(a) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE {o} + j * {e} END) AS h,
    list_transform(range(1, length(a) + 1), lambda j: {2 * o + e} + j * {e}) AS e, {CELL_FLOOR}::BIGINT AS best FROM pairs
  UNION ALL
  SELECT k1, k2, a, b, i + 1, [{o} + (i + 1) * {e}] || r, list_transform(range(1, length(a) + 1), lambda j: greatest(e[j], r[j] + {o}) + {e}), greatest(best, list_max(r))
  FROM (SELECT *, list_transform(range(1, length(a) + 1), lambda j: greatest(g[j], {f})) AS r FROM (SELECT *, {g} AS g FROM dp WHERE i < length(b)))),
scored AS (SELECT k1, k2, a, b, h[length(a) + 1]::BIGINT AS global_score, best::BIGINT AS max_cell_score FROM dp WHERE i = length(b))"""


def dp_cells(pairs: str, scheme: ScoringScheme = DEFAULT) -> str:
    """dp() for longer strings, of a query of k1, a, b: cells are rows, a step of the recursion works out one row of all
    matrices, and gaps along it are a running maximum. A string must not be empty."""
    m, x, e, o = scheme.match, scheme.mismatch, scheme.gap_extend, scheme.gap_open
    return f"""
pairs AS ({pairs}),
cells AS (
  SELECT k1, 0::BIGINT AS i, j, c, b, (CASE WHEN j = 0 THEN 0 ELSE {o} + j * {e} END)::BIGINT AS h, (CASE WHEN j = 0 THEN 0 ELSE {2 * o + e} + j * {e} END)::BIGINT AS e
  FROM (SELECT k1, b, unnest(range(0, length(a) + 1)) AS j, unnest([''] || string_split(a, '')) AS c FROM pairs)
  UNION ALL
  SELECT k1, i + 1, j, c, b, r, greatest(e, r + {o}) + {e}
  FROM (SELECT *, greatest(g, {o} + j * {e} + max(g - j * {e}) OVER (PARTITION BY k1 ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS r
    FROM (SELECT *, CASE WHEN j = 0 THEN {o} + (i + 1) * {e} ELSE greatest(lag(h) OVER (PARTITION BY k1 ORDER BY j) + CASE WHEN c = b[i + 1] THEN {m} ELSE {x} END, e) END AS g
      FROM cells WHERE i < length(b)))),
scored AS (SELECT k1, arg_max(h, i * 1000000 + j)::BIGINT AS global_score, greatest({CELL_FLOOR}, max(h) FILTER (i > 0 AND j > 0))::BIGINT AS max_cell_score FROM cells GROUP BY k1)"""


def trace(pairs: str, scheme: ScoringScheme = DEFAULT) -> str:
    """CTEs ending in `traced` (k1, k2, swapped, row_a, row_b, ops, global_score): the same rows kept whole, then a walk
    back that carries the gap it must stay in (0 none, 1 along the row, 2 along the column)."""
    m, x, e, o = scheme.match, scheme.mismatch, scheme.gap_extend, scheme.gap_open
    low = -100000
    g = f"list_transform(range(1, m + 1), lambda j: greatest(h[j] + (CASE WHEN p[j] = q[i + 1] THEN {m} ELSE {x} END), e[j]))"
    f = f"list_transform(range(1, m + 1), lambda j: list_max(list_transform(range(0, j), lambda k: (CASE WHEN k = 0 THEN {o} + (i + 1) * {e} ELSE g[k] END) + {o} + (j - k) * {e})))"
    d = f"hs[i][j] + (CASE WHEN p[j] = q[i] THEN {m} ELSE {x} END)"
    move = f"(CASE WHEN forced > 0 THEN forced WHEN hs[i + 1][j + 1] = {d} THEN 3 WHEN hs[i + 1][j + 1] = fs[i][j] THEN 1 ELSE 2 END)"
    # whether extending beats (1), equals (0) or loses to (-1) opening, in the cell the gap leads to and the one behind it
    row1, row2 = f"sign(fs[i][j - 1] - hs[i + 1][j] - {o})", f"(CASE WHEN j > 2 THEN sign(fs[i][j - 2] - hs[i + 1][j - 1] - {o}) ELSE -1 END)"
    col1, col2 = f"sign(es[i - 1][j] - hs[i][j + 1] - {o})", f"(CASE WHEN i > 2 THEN sign(es[i - 2][j] - hs[i - 1][j + 1] - {o}) ELSE -1 END)"
    return f"""
pairs AS ({pairs}),
turned AS (SELECT k1, k2, length(b) > length(a) AS swapped, CASE WHEN length(b) > length(a) THEN b ELSE a END AS p, CASE WHEN length(b) > length(a) THEN a ELSE b END AS q FROM pairs),
dp AS (
  SELECT k1, k2, swapped, p, q, length(p) AS m, length(q) AS n, 0 AS i, list_transform(range(0, length(p) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE {o} + j * {e} END) AS h,
    list_transform(range(1, length(p) + 1), lambda j: {2 * o + e} + j * {e}) AS e,
    [list_transform(range(0, length(p) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE {o} + j * {e} END)] AS hs, [[{low}]][1:0] AS fs, [[{low}]][1:0] AS es FROM turned
  UNION ALL
  SELECT k1, k2, swapped, p, q, m, n, i + 1, [{o} + (i + 1) * {e}] || r, list_transform(range(1, m + 1), lambda j: greatest(e[j], r[j] + {o}) + {e}),
    list_append(hs, [{o} + (i + 1) * {e}] || r), list_append(fs, f), list_append(es, e)
  FROM (SELECT *, list_transform(range(1, m + 1), lambda j: greatest(g[j], f[j])) AS r FROM (SELECT *, {f} AS f FROM (SELECT *, {g} AS g FROM dp WHERE i < n)))),
walk AS (
  SELECT k1, k2, swapped, p, q, hs, fs, es, n::BIGINT AS i, m::BIGINT AS j, 0 AS forced, '' AS x, '' AS y, '' AS ops, h[m + 1]::BIGINT AS global_score FROM dp WHERE i = n
  UNION ALL
  SELECT k1, k2, swapped, p, q, hs, fs, es, CASE WHEN v = 1 THEN i ELSE i - 1 END, CASE WHEN v = 2 THEN j ELSE j - 1 END,
    CASE WHEN v = 1 AND j > 1 AND ({row1} > 0 OR {row1} = 0 AND {row2} <= 0) THEN 1 WHEN v = 2 AND i > 1 AND ({col1} > 0 OR {col1} = 0 AND {col2} <= 0) THEN 2 ELSE 0 END,
    CASE WHEN v = 2 THEN '-' ELSE p[j] END || x, CASE WHEN v = 1 THEN '-' ELSE q[i] END || y,
    CASE WHEN v = 3 THEN (CASE WHEN p[j] = q[i] THEN '=' ELSE 'X' END) WHEN (v = 1) = swapped THEN 'I' ELSE 'D' END || ops, global_score
  FROM (SELECT *, {move} AS v FROM walk WHERE i > 0 AND j > 0)),
done AS (SELECT k1, k2, swapped, p[1:j] || repeat('-', i) || x AS px, repeat('-', j) || q[1:i] || y AS qx,
  repeat(CASE WHEN swapped THEN 'I' ELSE 'D' END, j) || repeat(CASE WHEN swapped THEN 'D' ELSE 'I' END, i) || ops AS ops, global_score FROM walk WHERE i = 0 OR j = 0),
traced AS (SELECT k1, k2, swapped, CASE WHEN swapped THEN qx ELSE px END AS row_a, CASE WHEN swapped THEN px ELSE qx END AS row_b, ops, global_score FROM done)"""


def pair_msa(pairs: str, scheme: ScoringScheme = DEFAULT) -> str:
    """CTEs ending in `msa` (k1, k2, row_a, row_b) and `consensus` (k1, k2, consensus) of sets of two sequences, a then b.

    The graph is a's chain (rows), b is the query (columns). Columns where both stand come in order. What stands in one
    sequence alone between two of them is a branch, and the two branches come one after the other: a's first, but behind a
    pair of different symbols that of the symbol which completed their ring, which is b's, and then each in turn. Of two
    branches between equal symbols the consensus takes the longer, of equal ones b's, and at the end the one that comes first.
    """
    o = scheme.gap_open
    text = trace(pairs, scheme)
    turned = "turned AS (SELECT k1, k2, false AS swapped, b AS p, a AS q FROM pairs)"
    i, j = text.index("turned AS ("), text.index("dp AS (")
    text = text[:i] + turned + ",\n" + text[j:]
    i, j = text.index("walk AS ("), text.index("done AS (")
    move = f"(CASE WHEN forced > 0 THEN forced WHEN hs[i + 1][j + 1] = hs[i][j] + (CASE WHEN p[j] = q[i] THEN {scheme.match} ELSE {scheme.mismatch} END) THEN 3 WHEN hs[i + 1][j + 1] = es[i][j] THEN 2 ELSE 1 END)"
    return text[:i] + f"""walk AS (
  SELECT k1, k2, p, q, hs, fs, es, n::BIGINT AS i, m::BIGINT AS j, 0 AS forced, '' AS ops FROM dp WHERE i = n
  UNION ALL
  SELECT k1, k2, p, q, hs, fs, es, CASE WHEN v = 1 THEN i ELSE i - 1 END, CASE WHEN v = 2 THEN j ELSE j - 1 END,
    CASE WHEN v = 1 AND j > 1 AND fs[i][j - 1] >= hs[i + 1][j] + {o} THEN 1 WHEN v = 2 AND i > 1 AND es[i - 1][j] >= hs[i][j + 1] + {o} THEN 2 ELSE 0 END,
    CASE WHEN v = 3 THEN (CASE WHEN p[j] = q[i] THEN '=' ELSE 'X' END) WHEN v = 1 THEN 'I' ELSE 'D' END || ops
  FROM (SELECT *, {move} AS v FROM walk WHERE i > 0 AND j > 0)),
fused AS (SELECT k1, k2, q AS a, p AS b, repeat('D', i) || repeat('I', j) || ops AS ops FROM walk WHERE i = 0 OR j = 0),
steps AS (SELECT k1, k2, a, b, t, ops[t] AS op FROM (SELECT *, unnest(generate_series(1, length(ops))) AS t FROM fused)),
placed AS (SELECT *, count(*) FILTER (op IN ('=', 'X')) OVER w AS k, max(CASE WHEN op = '=' THEN t END) OVER w AS anchor,
  count(*) FILTER (op = '=') OVER w AS seg, count(*) FILTER (op <> 'I') OVER w AS ia, count(*) FILTER (op <> 'D') OVER w AS ib FROM steps
  WINDOW w AS (PARTITION BY k1, k2 ORDER BY t ROWS UNBOUNDED PRECEDING)),
begun AS (SELECT k1, k2, bool_or(op = 'I' AND k = 0) AS b_first FROM placed GROUP BY ALL),
turns AS (SELECT placed.*, CASE WHEN op NOT IN ('=', 'X') THEN NULL WHEN op = '=' THEN 'D'
  WHEN ((count(*) FILTER (op = 'X') OVER (PARTITION BY k1, k2, seg ORDER BY t ROWS UNBOUNDED PRECEDING)) % 2 = 1) = (anchor IS NOT NULL OR b_first) THEN 'I' ELSE 'D' END AS lead
  FROM placed JOIN begun USING (k1, k2)),
led AS (SELECT *, coalesce(max(lead) OVER (PARTITION BY k1, k2, k), 'D') AS ahead FROM turns),
ordered AS (SELECT *, CASE WHEN op IN ('=', 'X') THEN 0 WHEN op = ahead THEN 1 ELSE 2 END AS phase FROM led),
msa AS (SELECT k1, k2, string_agg(CASE WHEN op = 'I' THEN '-' ELSE a[ia] END, '' ORDER BY k, phase, t) AS row_a,
  string_agg(CASE WHEN op = 'D' THEN '-' ELSE b[ib] END, '' ORDER BY k, phase, t) AS row_b FROM ordered GROUP BY k1, k2),
branches AS (SELECT k1, k2, seg, max(CASE WHEN op = '=' THEN a[ia] END) AS symbol,
  coalesce(string_agg(CASE WHEN op IN ('X', 'D') THEN a[ia] END, '' ORDER BY t), '') AS x, coalesce(string_agg(CASE WHEN op IN ('X', 'I') THEN b[ib] END, '' ORDER BY t), '') AS y,
  arg_max(ahead, t) AS ahead, arg_max(op, t) AS final, seg = max(seg) OVER (PARTITION BY k1, k2) AS at_end FROM led GROUP BY k1, k2, seg),
consensus AS (SELECT k1, k2, string_agg(coalesce(symbol, '') || CASE WHEN length(x) > length(y) THEN x WHEN length(x) < length(y) THEN y
  WHEN at_end AND (final = 'X' OR ahead = 'D') THEN x ELSE y END, '' ORDER BY seg) AS consensus FROM branches GROUP BY k1, k2)"""
