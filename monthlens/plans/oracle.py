"""Plain-SQL restatements of the registered queries (run by DuckDB on the same
parquet tables). Each statement is written from the definition of the view or
operator, independently of the Spark code path."""

from __future__ import annotations

from monthlens.functions.text import ENGLISH_STOP_WORDS

STOP_SQL = ", ".join("'" + w + "'" for w in ENGLISH_STOP_WORDS)

ARTICLES = """
articles AS (
  SELECT d.doc_id AS article_id, o.o_orderdate AS display_date, d.text AS headline,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period
  FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey),
toks AS (
  SELECT article_id, period,
         unnest(regexp_extract_all(lower(headline), '[\\p{L}\\p{N}_]{2,}')) AS term
  FROM articles),
ctoks AS (SELECT * FROM toks WHERE term NOT IN (%s)),
dtm AS (SELECT article_id, period, term, count(*) AS tf FROM ctoks GROUP BY article_id, period, term)
""" % STOP_SQL

MACRO = """
ord AS (
  SELECT o_orderkey, o_custkey, o_totalprice, CAST(date_trunc('month', o_orderdate) AS DATE) AS period
  FROM orders),
m1 AS (SELECT period, sum(o_totalprice) AS s, CAST(count(*) AS DOUBLE) AS c,
              stddev_pop(ln(o_totalprice)) AS vol FROM ord GROUP BY period),
m2 AS (SELECT period, vol, ln(s / lag(s) OVER (ORDER BY period)) AS mret,
              c / lag(c) OVER (ORDER BY period) - 1.0 AS indpro FROM m1),
m3 AS (SELECT *, lead(indpro) OVER (ORDER BY period) AS indprol1 FROM m2),
macro AS (
  SELECT period, 'mret' AS outcome, mret AS y FROM m3
  UNION ALL SELECT period, 'vol', vol FROM m3
  UNION ALL SELECT period, 'indpro', indpro FROM m3
  UNION ALL SELECT period, 'indprol1', indprol1 FROM m3
  UNION ALL SELECT o.period, lower(c.c_mktsegment) || '_vol', stddev_pop(ln(o.o_totalprice))
            FROM ord o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2),
outc AS (SELECT period, outcome, y FROM macro WHERE y IS NOT NULL AND NOT isnan(y))
"""

TOPICS = """
tcell AS (SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS period, p.p_brand AS feature,
                 sum(l.l_quantity) AS q
          FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
topics AS (SELECT period, feature, q / sum(q) OVER (PARTITION BY period) AS value FROM tcell)
"""

VECTORS = """
vec AS (SELECT e.vec_id AS article_id, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period,
               e.embedding
        FROM embeddings e JOIN orders o ON e.vec_id = o.o_orderkey),
vexp AS (SELECT period, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM vec),
embm AS (SELECT period, printf('emb_%03d', pos) AS feature, avg(CAST(x AS DOUBLE)) AS value
         FROM vexp GROUP BY period, pos)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


SQL: dict[str, str] = {}

SQL["top_terms"] = with_(ARTICLES, """
f AS (SELECT term, count(*) AS freq FROM ctoks GROUP BY term)""") + """
SELECT CAST(row_number() OVER (ORDER BY freq DESC, term) AS BIGINT) AS rank, term, freq
FROM f ORDER BY freq DESC, term LIMIT 25"""

SQL["dtm_stats"] = with_(ARTICLES) + """
SELECT (SELECT count(*) FROM articles) AS n_docs,
       count(DISTINCT term) AS vocab, count(*) AS nnz, CAST(sum(tf) AS BIGINT) AS n_tokens,
       count(*) / ((SELECT count(*) FROM articles) * count(DISTINCT term)) AS density,
       count(*) / (SELECT count(*) FROM articles) AS avg_terms_per_doc
FROM dtm"""

SQL["monthly_counts"] = with_(ARTICLES) + """
SELECT period, term AS feature, CAST(count(*) AS DOUBLE) AS value FROM ctoks GROUP BY period, term"""

SQL["monthly_tfidf"] = with_(ARTICLES, """
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM articles),
dfq AS (SELECT term, count(*) AS df FROM dtm GROUP BY term),
w AS (SELECT dtm.article_id, dtm.period, dtm.term,
             dtm.tf * (ln((1 + nd.n) / (1 + dfq.df)) + 1) AS w
      FROM dtm JOIN dfq ON dtm.term = dfq.term, nd),
wn AS (SELECT period, term, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS v FROM w)""") + """
SELECT period, term AS feature, round(sum(v), 8) AS value FROM wn GROUP BY period, term"""

SQL["monthly_embeddings"] = with_(VECTORS) + """
SELECT period, feature, round(value, 8) AS value FROM embm WHERE value <> 0"""

SQL["macro_outcomes"] = with_(MACRO) + """
SELECT period, outcome, round(y, 8) AS y FROM outc"""

SQL["topic_shares"] = with_(TOPICS) + """
SELECT period, feature, round(value, 8) AS value FROM topics WHERE value <> 0"""


# ------------------------------------------------------------ moments and scores
SQL["count_moments"] = with_(ARTICLES, """
mc AS (SELECT period, term AS feature, count(*) AS value FROM ctoks GROUP BY 1, 2),
nm AS (SELECT count(DISTINCT period) AS n FROM articles)""") + """
SELECT feature, CAST(n AS BIGINT) AS n, round(sum(value) / n, 8) AS mu,
       round(sqrt(greatest(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 0)), 8) AS sigma
FROM mc, nm GROUP BY feature, n"""

SQL["lasso_alpha_max"] = with_(ARTICLES, MACRO, """
mc AS (SELECT period, term AS feature, count(*) AS value FROM ctoks GROUP BY 1, 2),
ap AS (SELECT DISTINCT period FROM articles),
yy AS (SELECT o.outcome, o.period, o.y FROM outc o JOIN ap ON o.period = ap.period),
yn AS (SELECT outcome, count(*) AS n, avg(y) AS ybar FROM yy GROUP BY outcome),
cells AS (SELECT yy.outcome, mc.feature, mc.value, yy.y - yn.ybar AS r, yn.n
          FROM mc JOIN yy ON mc.period = yy.period JOIN yn ON yy.outcome = yn.outcome),
st AS (SELECT outcome, feature, any_value(n) AS n, sum(value) AS s1, sum(value * value) AS s2,
              sum(value * r) AS xr FROM cells GROUP BY outcome, feature),
sc AS (SELECT outcome, abs(xr / (n * sqrt(s2 / n - (s1 / n) * (s1 / n)))) AS score FROM st
       WHERE s2 / n - (s1 / n) * (s1 / n) > 1e-12 * s2 / n)""") + """
SELECT outcome, round(max(score), 6) AS alpha_max FROM sc GROUP BY outcome"""

# ------------------------------------------------------------ inference layer
# --- fixed values, restated: prompt template and look-ahead keywords ---------
PROMPT_HEAD = """Below are {n} newspaper headlines, numbered 1 to {n}.

For EACH headline, extract exactly 1-3 keyword topics about the economic or financial risk/theme.

RULES:
- Output exactly {n} lines, numbered 1 to {n}.
- Each line must be: <number>. <1-3 keywords>
- Do NOT skip any line. Do NOT add extra lines.
- Do NOT repeat the headline -- only output keywords.

Headlines:
"""
PROMPT_TAIL = """

Output:"""
LOOKAHEAD_KEYWORDS = ("crash", "crisis", "lehman", "collapse", "recession", "tarp", "bailout", "meltdown", "contagion",
                      "systemic", "subprime", "great recession", "2008", "financial crisis")
# --- end fixed values ---------------------------------------------------------


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NUMBERED = """
na AS (SELECT d.doc_id AS article_id, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS item
       FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey),
nb AS (SELECT article_id, item, row_number() OVER (ORDER BY article_id) - 1 AS rn FROM na),
bt AS (SELECT article_id, CAST(rn // 50 AS BIGINT) AS batch_id, CAST(rn % 50 + 1 AS INT) AS pos, item FROM nb)
"""

SQL["batch_prompts"] = with_(NUMBERED, """
pb AS (SELECT batch_id, count(*) AS n,
              string_agg(CAST(pos AS VARCHAR) || '. ' || item, chr(10) ORDER BY pos) AS numbered
       FROM bt GROUP BY batch_id)""") + f"""
SELECT batch_id, n, md5(replace({_lit(PROMPT_HEAD)}, '{{n}}', CAST(n AS VARCHAR)) || numbered || {_lit(PROMPT_TAIL)})
       AS prompt_md5 FROM pb"""

def _prompts(rows: str) -> str:
    """Prompts of the numbered articles that ``rows`` names, numbered anew."""
    return with_(NUMBERED, f"""
part AS (SELECT article_id, item, row_number() OVER (ORDER BY article_id) - 1 AS rn FROM nb WHERE {rows}),
pb AS (SELECT CAST(rn // 50 AS BIGINT) AS batch_id, count(*) AS n,
              string_agg(CAST(rn % 50 + 1 AS VARCHAR) || '. ' || item, chr(10) ORDER BY rn) AS numbered
       FROM part GROUP BY 1)""") + f"""
SELECT batch_id, n, md5(replace({_lit(PROMPT_HEAD)}, '{{n}}', CAST(n AS VARCHAR)) || numbered || {_lit(PROMPT_TAIL)})
       AS prompt_md5 FROM pb"""


SQL["head_prompts"] = _prompts("rn < 100")
SQL["remaining_prompts"] = _prompts("rn >= 100")

RANKED = """
dt AS (SELECT DISTINCT article_id, term FROM ctoks),
cnt AS (SELECT a.article_id, count(dt.term) AS c FROM articles a LEFT JOIN dt ON a.article_id = dt.article_id
        GROUP BY a.article_id),
rk AS (SELECT article_id, term, row_number() OVER (PARTITION BY article_id ORDER BY length(term) DESC, term) AS r
       FROM dt)
"""


def _kw(shift_expr: str) -> str:
    return ("coalesce(string_agg(rk.term, ', ' ORDER BY rk.r) FILTER (WHERE rk.r > " + shift_expr +
            " AND rk.r <= " + shift_expr + " + 3), 'none')")


SQL["generated_topics"] = with_(ARTICLES, RANKED) + f"""
SELECT a.article_id, {_kw('0')} AS generated_topics
FROM articles a LEFT JOIN rk ON a.article_id = rk.article_id GROUP BY a.article_id"""

SQL["turn_stability"] = """
WITH g AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS run
           FROM conversations),
per AS (SELECT role, conv_id, count(DISTINCT text) AS nu FROM g GROUP BY 1, 2),
ch AS (SELECT g.role, count(*) FILTER (WHERE g.run > 0 AND g.text <> f.text) AS n_changed_vs_first
       FROM g JOIN g f ON g.conv_id = f.conv_id AND g.role = f.role AND f.run = 0 GROUP BY g.role),
agg AS (SELECT role, count(*) AS n_articles, count(*) FILTER (WHERE nu = 1) AS n_identical,
               round(avg(nu), 6) AS avg_unique FROM per GROUP BY role)
SELECT agg.role, n_articles, n_identical, round(n_identical / n_articles, 6) AS share_identical,
       avg_unique, n_changed_vs_first
FROM agg JOIN ch ON agg.role = ch.role"""

SQL["empty_share_by_source"] = """
WITH d AS (SELECT source, NOT regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}]{2}') AS e FROM documents)
SELECT source, count(*) AS n_documents, count(*) FILTER (WHERE e) AS n_empty,
       round(avg(CAST(e AS INT)), 6) AS empty_share FROM d GROUP BY source"""

SQL["target_moments"] = with_(MACRO) + """
SELECT outcome, count(*) AS n, min(period) AS first_period, max(period) AS last_period,
       round(avg(y), 8) AS mean, round(stddev_pop(y), 8) AS std FROM outc GROUP BY outcome"""

_FLAG = " OR ".join(f"contains(lower(%s), {_lit(k)})" for k in LOOKAHEAD_KEYWORDS)

SQL["lookahead_audit"] = with_(ARTICLES, RANKED, """
rkc AS (SELECT article_id, term, row_number() OVER (PARTITION BY article_id ORDER BY length(term) DESC, term) AS r
        FROM dt WHERE NOT regexp_matches(term, '[0-9]')),
gb AS (SELECT a.article_id, coalesce(string_agg(rk.term, ', ' ORDER BY rk.r) FILTER (WHERE rk.r <= 3), 'none') AS ta
       FROM articles a LEFT JOIN rk ON a.article_id = rk.article_id GROUP BY a.article_id),
gc AS (SELECT a.article_id, coalesce(string_agg(rkc.term, ', ' ORDER BY rkc.r) FILTER (WHERE rkc.r <= 3), 'none') AS tb
       FROM articles a LEFT JOIN rkc ON a.article_id = rkc.article_id GROUP BY a.article_id)""") + f"""
SELECT count(*) AS n_articles,
       count(*) FILTER (WHERE {_FLAG % (('ta',) * len(LOOKAHEAD_KEYWORDS))}) AS n_flagged_base,
       count(*) FILTER (WHERE {_FLAG % (('tb',) * len(LOOKAHEAD_KEYWORDS))}) AS n_flagged_constrained,
       count(*) FILTER (WHERE ta <> tb) AS n_different
FROM gb JOIN gc ON gb.article_id = gc.article_id"""

SQL["lookahead_audit_sample"] = with_(ARTICLES, RANKED, """
rkc AS (SELECT article_id, term, row_number() OVER (PARTITION BY article_id ORDER BY length(term) DESC, term) AS r
        FROM dt WHERE NOT regexp_matches(term, '[0-9]')),
lastd AS (SELECT max(display_date) AS m FROM articles),
pick AS (SELECT article_id FROM articles, lastd
         WHERE display_date >= date_trunc('month', m) - INTERVAL 12 MONTH
         ORDER BY md5(CAST(article_id AS VARCHAR) || ':123'), article_id LIMIT 10),
both_ AS (
  SELECT p.article_id, 'base' AS variant,
         coalesce(string_agg(rk.term, ', ' ORDER BY rk.r) FILTER (WHERE rk.r <= 3), 'none') AS generated_topics
  FROM pick p LEFT JOIN rk ON p.article_id = rk.article_id GROUP BY p.article_id
  UNION ALL
  SELECT p.article_id, 'constrained',
         coalesce(string_agg(rkc.term, ', ' ORDER BY rkc.r) FILTER (WHERE rkc.r <= 3), 'none')
  FROM pick p LEFT JOIN rkc ON p.article_id = rkc.article_id GROUP BY p.article_id)""") + f"""
SELECT article_id, variant, generated_topics,
       CAST({" + ".join(f"CAST(contains(lower(generated_topics), {_lit(k)}) AS INT)" for k in LOOKAHEAD_KEYWORDS)} AS BIGINT) AS n_flags
FROM both_"""

# ------------------------------------------------------------ time series
SERIES = """
ser AS (SELECT period, y FROM outc WHERE outcome = 'indprol1'),
pos AS (SELECT period, y, row_number() OVER (ORDER BY period) - 1 AS t, count(*) OVER () AS n,
               avg(y) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS forecast
        FROM ser),
te AS (SELECT * FROM pos WHERE t >= floor(n * 0.5))
"""

SQL["hist_mean_forecast"] = with_(MACRO, SERIES, """
rr AS (SELECT *, sum((y - forecast) * (y - forecast)) OVER w AS e2, sum(y) OVER w AS sy,
              sum(y * y) OVER w AS sy2, count(*) OVER w AS m
       FROM te WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""") + """
SELECT period, CAST(t AS BIGINT) AS t, round(y, 8) AS y, round(forecast, 8) AS forecast,
       round(CASE WHEN m > 1 THEN 1 - e2 / (sy2 - sy * sy / m) END, 6) AS running_r2
FROM rr"""

SQL["hist_mean_oos"] = with_(MACRO, SERIES) + """
SELECT count(*) AS n_test,
       round(1 - sum((y - forecast) * (y - forecast)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS oos_r2,
       round(avg((y - forecast) * (y - forecast)), 10) AS mse
FROM te"""

SQL["chrono_split_folds"] = with_(MACRO, TOPICS, """
al AS (SELECT DISTINCT o.period FROM outc o JOIN (SELECT DISTINCT period FROM topics) tp ON o.period = tp.period
       WHERE o.outcome = 'mret'),
ps AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS t, count(*) OVER () AS n FROM al),
sp AS (SELECT period, CASE WHEN t < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM ps),
fo AS (SELECT period, ntile(5) OVER (ORDER BY period) - 1 AS fold FROM sp WHERE split = 'train')""") + """
SELECT sp.period, sp.split, CAST(fo.fold AS BIGINT) AS fold FROM sp LEFT JOIN fo ON sp.period = fo.period"""

# ------------------------------------------------------------ ridge
SQL["gram_embeddings"] = with_(VECTORS, """
nm AS (SELECT count(DISTINCT period) AS n FROM embm),
mom AS (SELECT feature, sum(value) / n AS mu, sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS var
        FROM embm, nm GROUP BY feature, n),
zz AS (SELECT e.period, e.feature, (e.value - m.mu) / sqrt(m.var) AS z FROM embm e JOIN mom m ON e.feature = m.feature
       WHERE m.var > 0)""") + """
SELECT a.period AS period_a, b.period AS period_b, round(sum(a.z * b.z), 6) AS k
FROM zz a JOIN zz b ON a.feature = b.feature GROUP BY 1, 2"""

# dense restatement: every (month, term) cell standardised, then summed over terms
SQL["gram_counts"] = with_(ARTICLES, """
mc AS (SELECT period, term AS feature, CAST(count(*) AS DOUBLE) AS value FROM ctoks GROUP BY 1, 2),
ap AS (SELECT DISTINCT period FROM articles),
nm AS (SELECT count(*) AS n FROM ap),
mom AS (SELECT feature, sum(value) / n AS mu,
               sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS var
        FROM mc, nm GROUP BY feature, n),
ok AS (SELECT * FROM mom WHERE var > 1e-12 * (var + mu * mu)),
dense AS (SELECT ap.period, ok.feature, (coalesce(mc.value, 0) - ok.mu) / sqrt(ok.var) AS z
          FROM ap CROSS JOIN ok LEFT JOIN mc ON mc.period = ap.period AND mc.feature = ok.feature)""") + """
SELECT a.period AS period_a, b.period AS period_b, round(sum(a.z * b.z), 4) AS k
FROM dense a JOIN dense b ON a.feature = b.feature GROUP BY 1, 2"""

SQL["article_term_counts"] = with_(ARTICLES) + """
SELECT article_id, term, tf FROM dtm"""

SQL["vector_failure_summary"] = with_(VECTORS) + """
SELECT count(*) AS n_vectors,
       count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x <> 0)) = 0) AS n_failed,
       CAST(max(len(embedding)) AS BIGINT) AS dims
FROM vec"""

SQL["generated_term_counts"] = with_(ARTICLES, RANKED, """
gen AS (SELECT a.article_id, a.period, """ + _kw("0") + """ AS topics
        FROM articles a LEFT JOIN rk ON a.article_id = rk.article_id GROUP BY a.article_id, a.period),
gt AS (SELECT period, unnest(regexp_extract_all(lower(topics), '[\\p{L}\\p{N}_]{2,}')) AS term FROM gen)""") + """
SELECT period, term AS feature, CAST(count(*) AS DOUBLE) AS value FROM gt
WHERE term NOT IN (""" + STOP_SQL + """) GROUP BY period, term"""

_OUTCOME_COLS = ["automobile_vol", "building_vol", "furniture_vol", "household_vol", "indpro", "indprol1",
                 "machinery_vol", "mret", "vol"]
SQL["macro_table"] = with_(MACRO) + "SELECT period, " + ", ".join(
    f"round(max(y) FILTER (WHERE outcome = '{c}'), 8) AS {c}" for c in _OUTCOME_COLS) + " FROM macro GROUP BY period"

SQL["macro_from_csv"] = SQL["macro_outcomes"]

# One-feature OLS by the regression aggregates.
SQL["ols_single_topics"] = with_(MACRO, TOPICS, """
tp AS (SELECT DISTINCT period FROM topics),
nm AS (SELECT DISTINCT feature AS topic FROM topics WHERE value <> 0),
yy AS (SELECT o.outcome, o.period, o.y, nm.topic FROM outc o JOIN tp ON o.period = tp.period CROSS JOIN nm),
xy AS (SELECT yy.outcome, yy.topic, yy.y, coalesce(t.value, 0.0) AS x
       FROM yy LEFT JOIN topics t ON t.period = yy.period AND t.feature = yy.topic),
f AS (SELECT outcome, topic, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2,
             sqrt((1 - regr_r2(y, x)) * var_pop(y) / var_pop(x) / (count(*) - 2)) AS se FROM xy GROUP BY 1, 2)""") + """
SELECT outcome, topic, n, round(a, 6) AS intercept, round(b, 6) AS coef, round(se, 6) AS se, round(b / se, 6) AS t, round(r2, 8) AS r2,
       round(1 - (n - 1) * (1 - r2) / (n - 2), 8) AS adj_r2, round((b / se) * (b / se), 6) AS fstat FROM f"""

SQL["standardised_variance"] = with_(VECTORS, """
em AS (SELECT period, pos, avg(x) AS value FROM vexp GROUP BY 1, 2),
z AS (SELECT pos, (value - avg(value) OVER (PARTITION BY pos)) / stddev_pop(value) OVER (PARTITION BY pos) AS z FROM em)""") + """
SELECT (SELECT count(DISTINCT period) FROM em) AS n, count(DISTINCT pos) AS p, round(avg(z * z), 8) AS variance FROM z"""
