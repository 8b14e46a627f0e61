"""DuckDB SQL for every registered query that has an exact SQL equivalent.

Tables ``region nation customer supplier part orders lineitem events ...`` are
views in the DuckDB session.  Conventions that make two engines agree cell by
cell:
* money is summed as ``DECIMAL(18,2)`` (exact); ``round(sum/3, 1)`` half-up
  is computed on integer cents as ``((2*cents + 30) // 60) / 10`` (sums > 0);
* NumPy-style rounding is ``round_even``;
* quantiles are ``quantile_cont`` (same linear rule as pandas and Spark).
"""

from __future__ import annotations

import json

from segmint.plans import domain as d
from segmint.plans import queries as q
from segmint.sources.catalog import DEFAULT_CATALOG


def _lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _in(values) -> str:
    return ", ".join(_lit(v) for v in values)


# The windows as dates, written out: as of 2001-08-15 (orders, lines) and 2024-02-15 (events).
LO, HI = "2001-05-01", "2001-08-01"            # months -3 to -1
HALF_LO = "2001-02-01"                         # months -6 to -1
LAST_LO = "2001-07-01"                         # month -1
SNAP, SNAP_2, SNAP_3 = "2001-07-31", "2001-06-30", "2001-05-31"
SNAP_MONTHS = 2001 * 12 + 7
W_LO, W_HI = "2001-05-31", "2001-07-31"        # branch window, closed, at midnight
E_LO, E_HI = "2023-11-30", "2024-01-31"        # event window, closed, at midnight
ALL_TYPES = [t for ts in d.CHANNEL_EVENT_TYPES.values() for t in ts]


def _cents_round(expr: str) -> str:
    return f"((2 * {expr} + 30) // 60) / 10.0"


TRN = f"""trn AS (
  SELECT o_custkey AS PERS_ID, last_day(o_orderdate)::DATE AS SNAP_DATE, o_orderpriority AS TRN_CLASS_DESCR,
         1::BIGINT AS CNT, CAST(o_totalprice AS DECIMAL(18,2)) AS AMT
  FROM orders WHERE o_orderdate >= DATE '{LO}' AND o_orderdate < DATE '{HI}')"""


def _cat(classes, avg=True) -> str:
    cols = []
    for v, a in classes.items():
        f = f"FILTER (WHERE TRN_CLASS_DESCR = {_lit(v)})"
        if avg:
            cols.append(f"sum(CNT) {f} / 3.0 AS {a}_AVG_CNT")
            cols.append(f"CAST(sum(AMT) {f} AS DOUBLE) / 3.0 AS {a}_AVG_AMT")
        else:
            cols.append(f"CAST(sum(CNT) {f} AS DOUBLE) AS {a}_SUM_CNT")
            cols.append(f"CAST(sum(AMT) {f} AS DOUBLE) AS {a}_SUM_AMT")
    return ",\n    ".join(cols)


def _cat_cte(name, classes, avg=True) -> str:
    return f"""{name} AS (
  SELECT PERS_ID,
    {_cat(classes, avg)}
  FROM trn GROUP BY PERS_ID)"""


BASE = """base AS (
  SELECT c_custkey AS PERS_ID, n_name AS PREF_CITY, c_mktsegment AS SOC_SEG, c_acctbal AS MONTHLY_INCOME,
         c_nationkey AS NATION_KEY
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

ACTIVE = f"""active AS (
  SELECT o_custkey AS PERS_ID FROM orders
  WHERE o_orderdate >= DATE '{LAST_LO}' AND o_orderdate < DATE '{HI}' AND o_orderstatus = {_lit(d.ACTIVE_STATUS)})"""

SEGM = f"""segm AS (
  SELECT c_custkey AS PERS_ID, r_name AS REGION, t.TENURE
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey,
                    ({SNAP_MONTHS} - (year(min(o_orderdate)) * 12 + month(min(o_orderdate)))) / 12.0 AS TENURE
             FROM orders WHERE o_orderdate < DATE '{HI}' GROUP BY o_custkey) t ON t.o_custkey = c_custkey)"""


def _events_cte(channels=None, lo=E_LO, hi=E_HI, name="ev") -> str:
    chans = channels or list(d.CHANNEL_EVENT_TYPES)
    types = [t for c in chans for t in d.CHANNEL_EVENT_TYPES[c]]
    cols = []
    for c in chans:
        cnt, amt = d.CHANNEL_NAMES[c]
        f = f"FILTER (WHERE EVENT_TYPE IN ({_in(d.CHANNEL_EVENT_TYPES[c])}))"
        cols.append(f"nullif(count(*) {f}, 0) / 3.0 AS {cnt}")
        cols.append(f"{_cents_round(f'sum(cents) {f}')} AS {amt}")
    return f"""{name} AS (
  SELECT PERS_ID,
    {(','+chr(10)+'    ').join(cols)}
  FROM (SELECT user_id AS PERS_ID, event_type AS EVENT_TYPE, CAST(round(value * 100) AS BIGINT) AS cents
        FROM events
        WHERE ts BETWEEN DATE '{lo}' AND DATE '{hi}' AND value > 0 AND event_type IN ({_in(types)}))
  GROUP BY PERS_ID)"""


BRANCH = f"""br AS (
  SELECT o_custkey AS PERS_ID, count(*) / 3.0 AS {d.CHANNEL_NAMES['BRNCH'][0]},
         {_cents_round('sum(CAST(round(l_extendedprice * 100) AS BIGINT))')} AS {d.CHANNEL_NAMES['BRNCH'][1]}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate BETWEEN DATE '{W_LO}' AND DATE '{W_HI}' AND l_extendedprice > 0
    AND l_returnflag <> {_lit(d.BRANCH_EXCLUDED_RETURNFLAG)}
  GROUP BY o_custkey)"""


def _fact_ctes() -> str:
    """The customer fact (by the second key) and the segment fact, each at the last month end."""
    def cast(name, expr, flags=()):
        return f"{expr} AS {name}" if name in flags else f"CAST({expr} AS DOUBLE) AS {name}"

    months = {1: LAST_LO, 6: HALF_LO}
    cust = ",\n    ".join(cast(n, f"{fn}({sql}) FILTER (WHERE o_orderdate >= DATE '{months[back]}')") for n, (fn, sql, back) in d.CUSTOMER_FACT.items())
    seg = ",\n    ".join(cast(n, f"{fn}({sql})", d.FLAG_MEASURES) for n, (fn, sql) in d.SEGMENT_FACT.items())
    return f"""cfact AS (
  SELECT c_name AS UNI_PT_KEY,
    {cust}
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderdate >= DATE '{HALF_LO}' AND o_orderdate < DATE '{HI}'
  GROUP BY c_name HAVING count(*) FILTER (WHERE o_orderdate >= DATE '{LAST_LO}') > 0),
sfact AS (
  SELECT o_custkey AS PERS_ID,
    {seg}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate >= DATE '{LAST_LO}' AND l_shipdate < DATE '{HI}' GROUP BY o_custkey)"""


def _wide_ctes(active_only: bool) -> str:
    where = "WHERE base.PERS_ID IN (SELECT PERS_ID FROM active)" if active_only else ""
    facts = ", ".join([*(f"cfact.{c}" for c in d.CUSTOMER_FACT), *(f"sfact.{c}" for c in d.SEGMENT_FACT)])
    cats = ", ".join(f"cat.{a}_AVG_CNT, cat.{a}_AVG_AMT"
                     for a in list(d.SPEND_CLASSES.values()) + list(d.INCOME_CLASSES.values()))
    ev_cnt = ", ".join(f"ev.{d.CHANNEL_NAMES[c][0]}" for c in d.CHANNEL_EVENT_TYPES)
    ev_amt = ", ".join(f"ev.{d.CHANNEL_NAMES[c][1]}" for c in d.CHANNEL_EVENT_TYPES)
    bc, ba = d.CHANNEL_NAMES["BRNCH"]
    return f"""{TRN},
{_cat_cte('cat', {**d.SPEND_CLASSES, **d.INCOME_CLASSES})},
{BASE},
{ACTIVE},
{SEGM},
{_events_cte()},
{BRANCH},
{_fact_ctes()},
wide AS (
  SELECT base.PERS_ID, segm.REGION, base.PREF_CITY, base.SOC_SEG, base.MONTHLY_INCOME, segm.TENURE,
    {cats},
    {ev_cnt}, br.{bc},
    {ev_amt}, br.{ba}, cust.c_name AS UNI_PT_KEY, {facts}
  FROM base
  JOIN customer cust ON cust.c_custkey = base.PERS_ID
  LEFT JOIN cfact ON cfact.UNI_PT_KEY = cust.c_name
  LEFT JOIN sfact ON sfact.PERS_ID = base.PERS_ID
  LEFT JOIN segm ON base.PERS_ID = segm.PERS_ID
  LEFT JOIN cat ON base.PERS_ID = cat.PERS_ID
  LEFT JOIN ev ON base.PERS_ID = ev.PERS_ID
  LEFT JOIN br ON base.PERS_ID = br.PERS_ID
  {where})"""


WIDE = f"WITH {_wide_ctes(True)}\nSELECT * FROM wide"
SEG = f"WITH {_wide_ctes(False)}"          # + a final SELECT over ``wide``
SEG_STEPS = f"WITH RECURSIVE {_wide_ctes(False)}"

FILTER_VIEW = ("PERS_ID, SOC_SEG, REGION, PREF_CITY, MONTHLY_INCOME, TENURE, "
               "AVG_MB_IB_TRN_CNT, AVG_POS_TRN_CNT, AVG_ATM_TRN_CNT")


def _between(col, b) -> str:
    return f"{col} BETWEEN {float(b[0])!r} AND {float(b[1])!r}"


def _opt_conds(ranges=None, members=None) -> list[str]:
    conds = []
    for c, b in (ranges or {}).items():
        if b is not None and tuple(b) != (0.0, 0.0):
            conds.append(_between(c, b))
    for c, v in (members or {}).items():
        if v:
            conds.append(f"{c} IN ({_in(v)})")
    return conds


def _where(conds) -> str:
    return ("WHERE " + " AND ".join(conds)) if conds else ""


LI_LAB = ("li AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
          "CAST(l_linenumber - 1 AS INTEGER) AS Cluster FROM lineitem)")


def _describe_sql() -> str:
    parts = []
    for v in q.LI_DESCRIBE:
        parts.append(f"""SELECT {_lit(v)} AS variable, Cluster, count({v}) AS count,
  avg({v}::DOUBLE) AS mean, stddev_samp({v}::DOUBLE) AS std, min({v}::DOUBLE) AS min,
  quantile_cont({v}::DOUBLE, 0.25) AS p25, quantile_cont({v}::DOUBLE, 0.5) AS p50,
  quantile_cont({v}::DOUBLE, 0.75) AS p75, max({v}::DOUBLE) AS max
FROM li GROUP BY Cluster""")
    return "\nUNION ALL\n".join(parts)


def _describe_rounded() -> str:
    r = ", ".join(f"round_even({c}, {q.PREC}) AS {c}" for c in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return f"WITH {LI_LAB}, descr AS ({_describe_sql()})\nSELECT variable, Cluster, count, {r} FROM descr"


def _profile_long_sql() -> str:
    stats = [("mean", "mean"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]
    cells = []
    for i, v in enumerate(q.LI_DESCRIBE):
        for j, (s, label) in enumerate(stats):
            cells.append(f"SELECT CAST({2 + i * len(stats) + j} AS INTEGER) AS row_order, "
                         f"{_lit(v + '_' + label)} AS row_label, Cluster, round_even({s}, 2) AS value "
                         f"FROM descr WHERE variable = {_lit(v)}")
    head = ("SELECT 0 AS row_order, 'Count' AS row_label, Cluster, CAST(n AS DOUBLE) AS value FROM sizes\n"
            "UNION ALL\nSELECT 1, 'CountShare %', Cluster, round_even(100.0 * n / sum(n) OVER (), 2) FROM sizes")
    return (f"WITH {LI_LAB}, descr AS ({_describe_sql()}),\n"
            f"sizes AS (SELECT Cluster, count(*) AS n FROM li GROUP BY Cluster),\n"
            f"prof AS ({head}\nUNION ALL\n" + "\nUNION ALL\n".join(cells) + ")\n")


LI_PRICES = ("px AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS disc_price, "
             "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)")


def _corr_pairs(lower_only: bool, variables=None, source: str = "wide", raw: bool = False) -> str:
    vs = variables or q.CORR_VARS
    rows = []
    for i, a in enumerate(vs):
        for j, b in enumerate(vs):
            if i > j:
                continue
            expr = (f"(SELECT CASE WHEN isnan(r) THEN NULL ELSE {'r' if raw else 'round_even(r, 2)'} END FROM "
                    f"(SELECT corr({a}, {b}) AS r FROM {source}))")
            rows.append(f"SELECT {_lit(b)} AS var_x, {_lit(a)} AS var_y, {expr} AS r")
            if a != b and not lower_only:
                rows.append(f"SELECT {_lit(a)} AS var_x, {_lit(b)} AS var_y, {expr} AS r")
    return "\nUNION ALL\n".join(rows)


def _corr_wide_sql() -> str:
    """All pairs of the unpivoted columns, joined by customer."""
    exprs = q.wide_numbers()
    cells = ", ".join(f"{{'n': 'v{i:03d}', 'v': ({e})::DOUBLE}}" for i, e in enumerate(exprs))
    names = ", ".join(f"('v{i:03d}')" for i in range(len(exprs)))
    return (f"{SEG}, cells AS (SELECT PERS_ID, unnest([{cells}]) AS c FROM wide), l AS (SELECT PERS_ID, c.n AS n, c.v AS v FROM cells WHERE c.v IS NOT NULL), "
            f"names(n) AS (VALUES {names}), r AS (SELECT a.n AS var_x, b.n AS var_y, corr(a.v, b.v) AS r FROM l a JOIN l b ON a.PERS_ID = b.PERS_ID AND a.n >= b.n GROUP BY a.n, b.n) "
            f"SELECT a.n AS var_x, b.n AS var_y, CASE WHEN isnan(r) THEN NULL ELSE round_even(r, 2) END AS r FROM names a JOIN names b ON a.n >= b.n LEFT JOIN r ON r.var_x = a.n AND r.var_y = b.n")


def _li_centres_cte() -> str:
    avgs = ", ".join(f"round_even(avg({c}), {q.PREC}) AS {c}" for c in q.LI_MODEL)
    return f"cen AS (SELECT Cluster, {avgs}, count(*) AS n FROM li GROUP BY Cluster)"


def _dist(prefix_row: str, prefix_c: str) -> str:
    return " + ".join(f"({prefix_row}.{c} - {prefix_c}.{c}) * ({prefix_row}.{c} - {prefix_c}.{c})"
                      for c in q.LI_MODEL)


def _nearest_sql() -> str:
    """Per-row argmin over the k given centres; ties go to the lower cluster id."""
    dists = []
    for i in range(q.LI_K):
        terms = " + ".join(f"(l.{c} - (SELECT {c} FROM cen WHERE Cluster = {i})) * "
                           f"(l.{c} - (SELECT {c} FROM cen WHERE Cluster = {i}))" for c in q.LI_MODEL)
        dists.append(f"{terms} AS d{i}")
    least = "least(" + ", ".join(f"d{i}" for i in range(q.LI_K)) + ")"
    case = " ".join(f"WHEN d{i} = m THEN {i}" for i in range(q.LI_K))
    return (f"SELECT l_orderkey, l_linenumber, CAST(CASE {case} END AS INTEGER) AS Nearest FROM "
            f"(SELECT *, {least} AS m FROM (SELECT l.l_orderkey, l.l_linenumber, {', '.join(dists)} FROM li l))")


def _std_sql(fill: bool) -> str:
    cols = q.SEG_MODEL
    src = ", ".join(f"coalesce({c}, 0) AS {c}" if fill else c for c in cols)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    z = ", ".join(f"round_even(CASE WHEN s_{c} = 0 THEN {c} - m_{c} ELSE ({c} - m_{c}) / s_{c} END, {q.PREC}) AS {c}"
                  for c in cols)
    return (f"{SEG}, x AS (SELECT PERS_ID, {src} FROM wide), st AS (SELECT {stats} FROM x)\n"
            f"SELECT PERS_ID, {z} FROM x, st")


def _kmeans_ctes(ks: list[int], seed: int = 42, starts: int = 2, tol: float = 1e-4, most: int = 300) -> str:
    """K-means step by step: standardised units ``p``, starting centres ``c<step>``, Lloyd steps ``lloyd``, best fits ``best``.

    A fit is (k, start).  The Lloyd steps are a recursion that a fit leaves once its centres' squared moves add up to ``stop``.
    """
    cols, qs = q.SEG_MODEL, [f"q{i}" for i in range(len(q.SEG_MODEL))]
    src = ", ".join(f"coalesce({c}, 0)::DOUBLE AS x{i}" for i, c in enumerate(cols))
    stats = ", ".join(f"printf('%.12g', avg(x{i}))::DOUBLE AS m{i}, printf('%.12g', stddev_pop(x{i}))::DOUBLE AS s{i}" for i in range(len(cols)))
    units = ", ".join(f"floor((CASE WHEN s{i} = 0 THEN x{i} - m{i} ELSE (x{i} - m{i}) / s{i} END) / 1e-06::DOUBLE + 0.5) AS q{i}" for i in range(len(cols)))
    dist = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in qs)
    qlist = ", ".join(qs)
    out = [f"x AS MATERIALIZED (SELECT PERS_ID, {src} FROM wide)", f"st AS MATERIALIZED (SELECT {stats} FROM x)",
           f"p AS MATERIALIZED (SELECT PERS_ID, {units} FROM x, st)"]

    def draw(part: str, key: str) -> str:
        bits = f"('0x' || substr(md5('{seed}|' || {part} || '|' || {key}), 1, 13))::BIGINT::DOUBLE"
        return f"-ln(({bits} + 0.5) / 4503599627370496.0)"

    pcols, order = ", ".join(f"p.{c}" for c in qs), ", ".join(qs)
    for r in range(3):  # candidates: three passes of twice the largest k
        part = f"'r{r}'"
        if r == 0:
            scored = f"SELECT p.PERS_ID::VARCHAR AS key, {pcols}, 1.0 / {draw(part, 'p.PERS_ID')} AS score FROM p"
        else:
            scored = (f"SELECT p.PERS_ID::VARCHAR AS key, {pcols}, n.d / {draw(part, 'p.PERS_ID')} AS score FROM p "
                      f"JOIN (SELECT p.PERS_ID, min({dist}) AS d FROM p, t{r - 1} c GROUP BY ALL) n ON n.PERS_ID = p.PERS_ID")
        top = f"SELECT {r} AS r, * FROM ({scored}) WHERE score > 0 ORDER BY score DESC, key, {order} LIMIT {2 * max(ks)}"
        out.append(f"t{r} AS MATERIALIZED (" + (f"SELECT * FROM t{r - 1} UNION ALL " if r else "") + f"SELECT * FROM ({top}))")
    out.append(f"num AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY r, score DESC, key, {order}) - 1) AS n, key, {qlist} FROM t2)")
    out.append(f"w AS (SELECT near.n AS n, count(*)::DOUBLE AS w FROM (SELECT min({{'d': {dist}, 'n': c.n}}) AS near FROM p, num c GROUP BY p.PERS_ID) GROUP BY near.n)")
    out.append(f"cand AS MATERIALIZED (SELECT num.*, coalesce(w.w, 0.0) AS w FROM num LEFT JOIN w ON w.n = num.n)")
    out.append(f"s AS (SELECT unnest(range(0, {starts})) AS start)")
    pick = "QUALIFY row_number() OVER (PARTITION BY s.start ORDER BY score DESC, p.n) = 1"
    part = lambda j: f"'s' || s.start || '.{j}'"
    out.append(f"c0 AS MATERIALIZED (SELECT s.start, 0 AS i, {pcols}, p.w / {draw(part(0), 'p.key')} AS score FROM cand p, s {pick})")
    for j in range(1, max(ks)):
        near = f"(SELECT p.n, c.start, min({dist}) AS d FROM cand p, c{j - 1} c GROUP BY ALL)"
        out.append(f"c{j} AS MATERIALIZED (SELECT start, i, {qlist}, score FROM c{j - 1} UNION ALL SELECT * FROM (SELECT s.start, {j} AS i, {pcols}, p.w * n.d / {draw(part(j), 'p.key')} AS score "
                   f"FROM cand p JOIN {near} n ON n.n = p.n JOIN s ON s.start = n.start {pick}))")
    fits = ", ".join(map(str, ks))
    out.append(f"l0 AS MATERIALIZED (SELECT k, start, i, {qlist} FROM c{max(ks) - 1} c JOIN (SELECT unnest([{fits}]) AS k) f ON c.i < f.k)")
    near = f"min({{'d': {dist}, 'i': c.i}}) AS near"
    point = "any_value({" + ", ".join(f"'{c}': p.{c}" for c in qs) + "}) AS pt"
    means = ", ".join(f"sum(pt.{c}::BIGINT)::DOUBLE / count(*)::DOUBLE AS {c}" for c in qs)
    moved = " + ".join(f"(c.{c} - coalesce(n.{c}, c.{c})) * (c.{c} - coalesce(n.{c}, c.{c}))" for c in qs)
    out.append(f"stop AS MATERIALIZED (SELECT {tol}::DOUBLE * ({' + '.join(f'var_pop({c})' for c in qs)}) / {len(qs)} AS least FROM p)")
    out.append(f"lloyd AS (SELECT 0 AS t, k, start, i, {qlist}, 1e300::DOUBLE AS moved FROM l0 UNION ALL ("
               f"WITH c AS (SELECT * FROM lloyd WHERE t < {most} AND moved > (SELECT least FROM stop)), "
               f"a AS (SELECT p.PERS_ID, c.k, c.start, {near}, {point} FROM p, c GROUP BY p.PERS_ID, c.k, c.start), "
               f"n AS (SELECT k, start, near.i AS i, {means} FROM a GROUP BY k, start, near.i) "
               f"SELECT c.t + 1, c.k, c.start, c.i, {', '.join(f'coalesce(n.{c}, c.{c})' for c in qs)}, sum({moved}) OVER (PARTITION BY c.k, c.start) "
               f"FROM c LEFT JOIN n ON n.k = c.k AND n.start = c.start AND n.i = c.i))")
    out.append(f"last AS MATERIALIZED (SELECT k, start, i, {qlist} FROM lloyd QUALIFY t = max(t) OVER (PARTITION BY k, start))")
    out.append(f"fin AS MATERIALIZED (SELECT p.PERS_ID, c.k, c.start, {near} FROM p, last c GROUP BY p.PERS_ID, c.k, c.start)")
    out.append("cost AS (SELECT k, start, sum(near.d::DECIMAL(38, 3))::DOUBLE * 1e-06::DOUBLE * 1e-06::DOUBLE AS inertia FROM fin GROUP BY k, start)")
    out.append("best AS (SELECT k, min(inertia) AS inertia, arg_min(start, (inertia, start)) AS start FROM cost GROUP BY k)")
    # canonical numbers: centres in ascending order
    out.append(f"named AS (SELECT c.k, c.i, (row_number() OVER (PARTITION BY c.k ORDER BY {', '.join('c.' + c for c in qs)}) - 1)::INTEGER AS Cluster "
               f"FROM last c JOIN best b ON b.k = c.k AND b.start = c.start)")
    out.append(f"labelled AS (SELECT a.PERS_ID, n.Cluster FROM fin a JOIN best b ON b.k = a.k AND b.start = a.start JOIN named n ON n.k = a.k AND n.i = a.near.i)")
    return ",\n".join(out)


def _cascade_sql() -> str:
    """Control by control: the rows left by the choices before it, its kind, then its values or ends."""
    parts, conds, numeric = [], [], ("MONTHLY_INCOME", "AVG_ATM_TRN_CNT", "AVG_POS_TRN_CNT")
    for j, (c, v) in enumerate(q.CASCADE.items()):
        left = f"(SELECT * FROM wide {_where(conds)})"
        few = "FALSE" if c == "AVG_ATM_TRN_CNT" else f"(SELECT count(DISTINCT {c}) FROM {left}) < 88"
        other = "numeric" if c in numeric else "text"
        ends = ("0.0::DOUBLE", f"max({c})::DOUBLE") if c in numeric else ("NULL::DOUBLE", "NULL::DOUBLE")
        parts.append(f"SELECT {j} AS position, {_lit(c)} AS column_name, 'categorical' AS kind, {c}::VARCHAR AS value, count(*)::BIGINT AS n_rows, "
                     f"NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::VARCHAR AS first_day, NULL::VARCHAR AS last_day FROM {left} WHERE {few} GROUP BY {c}")
        parts.append(f"SELECT {j}, {_lit(c)}, '{other}', NULL, count(*)::BIGINT, {ends[0]}, {ends[1]}, NULL, NULL FROM {left} HAVING NOT ({few})")
        if isinstance(v, list):
            conds.append(f"{c} IN ({_in(v)})")
        elif isinstance(v, tuple):
            conds.append(_between(c, v))
        else:  # untouched: a list leaves nothing, a slider what is not negative
            conds.append(f"NOT ({few}) AND {c} >= 0" if c in numeric else f"NOT ({few})")
    return "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    fr, fm = q.SEGMENT_FORM["ranges"], q.SEGMENT_FORM["members"]
    strict = [_between(c, b) for c, b in q.STRICT_RANGES.items()] + \
             [f"{c} IN ({_in(v)})" for c, v in q.STRICT_MEMBERS.items()]
    # MONTHLY_INCOME untouched: numeric on the full frame -> (0, max)
    auto = ["MONTHLY_INCOME BETWEEN 0.0 AND (SELECT max(MONTHLY_INCOME) FROM wide)",
            f"SOC_SEG IN ({_in(q.AUTO_CRITERIA['SOC_SEG'])})",
            f"PREF_CITY IN ({_in(q.AUTO_CRITERIA['PREF_CITY'])})"]
    opt_cols = ["MONTHLY_INCOME", "TENURE", "AVG_MB_IB_TRN_CNT", "URGENT_AVG_AMT"]
    options = "\nUNION ALL\n".join(
        f"SELECT {_lit(c)} AS column_name, count(DISTINCT {c})::BIGINT AS n_distinct, "
        f"round_even(min({c})::DOUBLE, {q.PREC}) AS min_value, round_even(max({c})::DOUBLE, {q.PREC}) AS max_value "
        f"FROM wide WHERE SOC_SEG IN ('BUILDING')" for c in opt_cols)
    imp_sel = ", ".join([f"coalesce({c}, {_lit(v)}) AS {c}" for c, v in q.IMPUTE_TEXT.items()] +
                        [f"coalesce({c}, {float(v)!r}) AS {c}" for c, v in q.IMPUTE_NUM.items()])
    bc, ba = d.CHANNEL_NAMES["BRNCH"]
    city = ("city AS (SELECT c_custkey AS PERS_ID, n_name AS PREF_CITY, c_acctbal AS MONTHLY_INCOME FROM customer "
            "LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey)")
    fill = "'თბილისი'"
    with open(DEFAULT_CATALOG, encoding="utf-8") as f:
        roles = json.load(f)
    have = ["PERS_ID", *d.REPORTING_VARIABLES, *d.MODEL_VARIABLES, "UNI_PT_KEY", *d.CUSTOMER_FACT, *d.SEGMENT_FACT]
    coverage = "\nUNION ALL\n".join(
        f"SELECT {_lit(v)} AS variable, {_lit(role)} AS role, count({v})::BIGINT AS n_values FROM wide"
        for role, names in (("model", roles["model_variables"]), ("reporting", roles["reporting_variables"])) for v in names if v in have)
    exprs, centres = q.wide_points()
    dists = ", ".join("[" + " + ".join(f"pow(v{i} - {c!r}::DOUBLE, 2)" for i, c in enumerate(ctr)) + f", {j}]" for j, ctr in enumerate(centres))
    sqls = {
        "client_csv_roundtrip": "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer",
        "wide_csv_roundtrip": f"WITH {BASE} SELECT PERS_ID, SOC_SEG, MONTHLY_INCOME FROM base",
        "profile_csv_roundtrip": _profile_long_sql() + "SELECT row_order, row_label, "
                                 + ", ".join(f'max(value) FILTER (WHERE Cluster = {i}) AS "{i}"' for i in range(q.LI_K))
                                 + " FROM prof GROUP BY row_order, row_label",
        "snapshot_roundtrip": f"WITH {TRN} SELECT PERS_ID, strftime(SNAP_DATE, '%Y-%m-%d') AS SNAP_DATE, TRN_CLASS_DESCR, CNT, CAST(AMT AS DOUBLE) AS AMT "
                              f"FROM trn WHERE SNAP_DATE = DATE '{SNAP}'",
        "snapshot_store": f"WITH {_events_cte()}, {_events_cte(lo='2023-10-31', hi='2023-12-31', name='before')}\n"
                          f"SELECT *, '{E_HI}' AS EVENT_MONTH FROM ev UNION ALL SELECT *, '2023-12-31' FROM before",
        "catalog_coverage": f"{SEG}\n{coverage}",
        "predicate_in_dimension": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN "
                                  "(SELECT p_partkey FROM part WHERE starts_with(p_type, 'S') AND p_size > 10)",
        "filter_auto_dates": "SELECT event_id, ts FROM events WHERE ts BETWEEN (SELECT date_trunc('day', min(ts)) FROM events) "
                             "AND (SELECT date_trunc('day', max(ts)) FROM events)",
        "filter_null_choice": f"WITH {city} SELECT * FROM city WHERE PREF_CITY IN ('NATION_1', 'NATION_2') OR PREF_CITY IS NULL",
        "filter_panel": f"{SEG}, {city}, f AS (SELECT PERS_ID, coalesce(city.PREF_CITY, {fill}) AS PREF_CITY, city.MONTHLY_INCOME, wide.AVG_ATM_TRN_CNT "
                        f"FROM city JOIN wide USING (PERS_ID)), g AS (SELECT * FROM f WHERE PREF_CITY IN ('NATION_1', {fill}))\n"
                        f"SELECT * FROM g WHERE AVG_ATM_TRN_CNT BETWEEN 0.0 AND (SELECT max(AVG_ATM_TRN_CNT) FROM g)",
        "filter_options_text": "SELECT o_orderpriority AS value, count(*)::BIGINT AS n_rows FROM orders GROUP BY o_orderpriority",
        "filter_options_cascade": f"{SEG}\n{_cascade_sql()}",
        "filter_options_dates": "SELECT 'o_orderdate' AS column_name, strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, "
                                "strftime(max(o_orderdate), '%Y-%m-%d') AS max_date FROM orders",
        "city_fill": f"WITH {city} SELECT PERS_ID, coalesce(PREF_CITY, {fill}) AS PREF_CITY, MONTHLY_INCOME FROM city",
        "parse_dates": "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate) + INTERVAL 36 HOURS, '%Y-%m-%d %H:%M') AS later, "
                       "o_orderpriority AS other FROM orders",
        "strip_timezone": "SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') "
                          "ELSE rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') END AS wall_clock FROM events",
        "assign_nearest_wide": "SELECT l_orderkey, l_linenumber, list_min([" + dists + "])[2]::INTEGER AS Nearest FROM (SELECT l_orderkey, l_linenumber, "
                               + ", ".join(f"({e})::DOUBLE AS v{i}" for i, e in enumerate(exprs)) + " FROM lineitem)",
        "scan_customer": f"WITH {BASE} SELECT * FROM base",
        "scan_ranges": "SELECT o_orderkey, 1 AS n_ranges FROM orders",
        "customer_wide": WIDE,
        "view_layer_sql": WIDE,
        "month_snapshot": f"WITH {TRN} SELECT PERS_ID, strftime(SNAP_DATE, '%Y-%m-%d') AS SNAP_DATE, TRN_CLASS_DESCR, CNT, CAST(AMT AS DOUBLE) AS AMT "
                          f"FROM trn WHERE SNAP_DATE = DATE '{SNAP}'",
        "union_months": f"WITH {TRN} SELECT PERS_ID, strftime(SNAP_DATE, '%Y-%m-%d') AS SNAP_DATE, TRN_CLASS_DESCR, CNT, CAST(AMT AS DOUBLE) AS AMT "
                        f"FROM trn WHERE SNAP_DATE IN (DATE '{SNAP}', DATE '{SNAP_2}', DATE '{SNAP_3}')",
        "segment_attrs": f"WITH {SEGM} SELECT * FROM segm",
        "spend_avg": f"WITH {TRN}, {_cat_cte('cat', d.SPEND_CLASSES)}, {BASE}\n"
                     f"SELECT base.PERS_ID, cat.* EXCLUDE (PERS_ID) FROM base LEFT JOIN cat ON base.PERS_ID = cat.PERS_ID",
        "income_avg": f"WITH {TRN}, {_cat_cte('cat', d.INCOME_CLASSES)}, {BASE}\n"
                      f"SELECT base.PERS_ID, cat.* EXCLUDE (PERS_ID) FROM base LEFT JOIN cat ON base.PERS_ID = cat.PERS_ID",
        "spend_pivot": f"WITH {TRN}, {_cat_cte('cat', d.SPEND_CLASSES, avg=False)} SELECT * FROM cat",
        "income_pivot": f"WITH {TRN}, {_cat_cte('cat', d.INCOME_CLASSES, avg=False)} SELECT * FROM cat",
        "select_model_vars": f"{SEG} SELECT PERS_ID, "
                             + ", ".join(f"coalesce({c}, 0) AS {c}" for c in q.SEG_MODEL) + ", "
                             + ", ".join(f"coalesce({c}, '0') AS {c}" for c in q.SEG_REPORT) + " FROM wide",
        "left_join_features": f"WITH {TRN}, {_cat_cte('cat', d.SPEND_CLASSES)}, {BASE}, {SEGM}\n"
                              f"SELECT base.PERS_ID, base.SOC_SEG, segm.REGION, segm.TENURE, cat.* EXCLUDE (PERS_ID) "
                              f"FROM base LEFT JOIN segm ON base.PERS_ID = segm.PERS_ID "
                              f"LEFT JOIN cat ON base.PERS_ID = cat.PERS_ID",
        "active_customers": f"WITH {BASE}, {ACTIVE} SELECT * FROM base WHERE PERS_ID IN (SELECT PERS_ID FROM active)",
        "predicate_ne": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag <> 'R'",
        "predicate_gt": "SELECT event_id, user_id, value FROM events WHERE value > 100",
        "predicate_prefix": "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')",
        "predicate_in": "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click')",
        "predicate_not_in": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem "
                            "WHERE l_returnflag NOT IN ('R', 'A')",
        "window_filter": f"SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem "
                         f"WHERE l_shipdate BETWEEN DATE '{W_LO}' AND DATE '{W_HI}'",
        "filter_optional_range": f"{SEG} SELECT {FILTER_VIEW} FROM wide {_where(_opt_conds(ranges=q.RANGES))}",
        "filter_optional_member": f"{SEG} SELECT {FILTER_VIEW} FROM wide {_where(_opt_conds(members=q.MEMBERS))}",
        "filter_strict": f"{SEG}, capped AS (SELECT * REPLACE (least(coalesce(TENURE, 0.0), 30.0) AS TENURE) FROM wide)\n"
                         f"SELECT {FILTER_VIEW} FROM capped {_where(strict)}",
        "filter_segment": f"{SEG} SELECT {FILTER_VIEW} FROM wide {_where(_opt_conds(fr, fm))}",
        "filter_auto": f"{SEG} SELECT {FILTER_VIEW} FROM wide {_where(auto)}",
        "filter_date_range": f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate "
                             f"BETWEEN TIMESTAMP '{q.DATE_RANGE[0]}' AND TIMESTAMP '{q.DATE_RANGE[1]}'",
        "filter_regex": f"SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, {_lit(q.REGEX)})",
        "filter_options": f"{SEG}\n{options}",
        "channel_activity": f"WITH {_events_cte()}, {BRANCH}, {BASE}\n"
                            f"SELECT base.PERS_ID, "
                            + ", ".join(f"ev.{d.CHANNEL_NAMES[c][0]}" for c in d.CHANNEL_EVENT_TYPES)
                            + f", br.{bc}, "
                            + ", ".join(f"ev.{d.CHANNEL_NAMES[c][1]}" for c in d.CHANNEL_EVENT_TYPES)
                            + f", br.{ba} FROM base LEFT JOIN ev ON base.PERS_ID = ev.PERS_ID "
                              f"LEFT JOIN br ON base.PERS_ID = br.PERS_ID",
        "channel_amounts": f"WITH {_events_cte()} SELECT PERS_ID, "
                           + ", ".join(d.CHANNEL_NAMES[c][1] for c in ("MB_IB", "POS", "ATM")) + " FROM ev",
        "channel_digital": f"WITH {_events_cte(['MB_IB'])} SELECT * FROM ev",
        "channel_pos": f"WITH {_events_cte(['POS'])} SELECT * FROM ev",
        "channel_atm": f"WITH {_events_cte(['ATM'])} SELECT * FROM ev",
        "channel_branch": f"WITH {BRANCH} SELECT * FROM br",
        "cluster_describe": _describe_rounded(),
        "population_metrics": f"{SEG} SELECT count(*)::BIGINT AS n_rows, "
                              f"{2 + len(d.REPORTING_VARIABLES) + len(d.MODEL_VARIABLES) + 5 + 28}::BIGINT AS n_columns FROM wide",
        "cluster_share": f"WITH {LI_LAB}, sizes AS (SELECT Cluster, count(*) AS Count FROM li GROUP BY Cluster)\n"
                         f"SELECT Cluster, Count, round_even(100.0 * Count / sum(Count) OVER (), 2) AS CountShare FROM sizes",
        "correlation_long": f"{SEG}\n{_corr_pairs(False)}",
        "correlation_lower": f"{SEG}\n{_corr_pairs(True)}",
        "correlation_wide": _corr_wide_sql(),
        "redundant_pairs": f"WITH {LI_PRICES}, c AS ({_corr_pairs(True, q.PRICE_VARS, 'px', raw=True)})\n"
                           f"SELECT var_x, var_y, round_even(r, 2) AS r FROM c WHERE var_x <> var_y AND (r > 0.8 OR r < -0.8)",
        "profile_long": _profile_long_sql() + "SELECT row_order, row_label, Cluster, value FROM prof",
        "profile_wide": _profile_long_sql() + "SELECT row_order, row_label, "
                        + ", ".join(f'max(value) FILTER (WHERE Cluster = {i}) AS "{i}"' for i in range(q.LI_K))
                        + " FROM prof GROUP BY row_order, row_label",
        "dedup_first": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
                       "FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn "
                       "FROM orders) WHERE rn = 1",
        "month_end": "SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS SNAP_DATE, "
                     "strftime(last_day(o_orderdate::DATE - INTERVAL 1 MONTH), '%Y-%m-%d') AS PREV_MONTH_END, "
                     "strftime(last_day(o_orderdate::DATE - INTERVAL 1 MONTH), '%Y_%m_%d') AS SNAP_LABEL FROM orders",
        "impute_defaults": f"{SEG} SELECT PERS_ID, {imp_sel} FROM wide",
        "cap_value": f"{SEG} SELECT PERS_ID, least(coalesce(TENURE, 0.0), 30.0) AS TENURE_CAPPED, "
                     f"least(coalesce(AVG_MB_IB_TRN_CNT, 0.0), 10.0) AS MB_IB_CNT_CAPPED FROM wide",
        "flag_to_int": "SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 1 ELSE 0 END AS URGENT_FLAG "
                       "FROM orders",
        "standardize": _std_sql(False),
        "prepare_features": _std_sql(True),
        "kmeans_fit": f"{SEG_STEPS}, {_kmeans_ctes([q.FINAL_K])}\nSELECT PERS_ID, Cluster FROM labelled",
        "elbow_curve": f"{SEG_STEPS}, {_kmeans_ctes(list(range(3, q.ELBOW_K_MAX + 1)))}\n"
                       f"SELECT k::INTEGER AS K, round_even(inertia, {q.PREC}) AS Inertia FROM best",
        "segment_customers": f"{SEG_STEPS}, {_kmeans_ctes([q.FINAL_K])}\nSELECT PERS_ID, "
                             + ", ".join(f"coalesce({c}, 0) AS {c}" for c in q.SEG_MODEL) + ", Cluster, "
                             + ", ".join(f"coalesce({c}, '0') AS {c}" for c in q.SEG_REPORT) + " FROM wide JOIN labelled USING (PERS_ID)",
        "feature_vectors": f"{SEG} SELECT PERS_ID, [" + ", ".join(f"coalesce({c}, 0)::DOUBLE" for c in q.SEG_MODEL) + "] AS features FROM wide",
        "centroid_update": f"WITH {LI_LAB}, {_li_centres_cte()} SELECT * FROM cen",
        "assign_nearest": f"WITH {LI_LAB}, {_li_centres_cte()}\n{_nearest_sql()}",
        "inertia_given_labels": f"WITH {LI_LAB}, {_li_centres_cte()}\n"
                                f"SELECT round_even(sum({_dist('li', 'cen')}), 4) AS inertia "
                                f"FROM li JOIN cen ON li.Cluster = cen.Cluster",
    }
    return sqls
