"""Query registry and the shared SQL of the stand-in inputs."""
from pyspark.sql import functions as F

from ..session import use_utc
from ..sources.standins import SETS, Tables

REGISTRY = {}
CTES = {}
STORED = {"signals", "pairs"}  # read by many others


def cte(name, sql, *deps):
    CTES[name] = (sql, deps)


def with_ctes(final, *names):
    order = []

    def visit(n):
        for d in CTES[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({CTES[n][0]})" for n in order) + "\n" + final


def query(name, final=None, ctes=(), doubles="", longs="", dp=6):
    """Register a query; doubles are rounded (``name:places`` overrides ``dp``) and counts
    widened alike on both engines."""
    d, n = [(*c.split(":"), dp)[:2] for c in doubles.split()], longs.split()
    d = [(c, int(k)) for c, k in d]

    def deco(fn):
        def run(spark, sf_dir):
            df = fn(Tables(use_utc(spark), sf_dir))
            return df.withColumns({
                **{c: F.round(F.col(c).cast("double"), k) + F.lit(0.0) for c, k in d},
                **{c: F.col(c).cast("long") for c in n}})

        sql = None
        if final is not None:
            rep = [f"round(CAST({c} AS DOUBLE), {k}) + 0.0 AS {c}" for c, k in d]
            rep += [f"CAST({c} AS BIGINT) AS {c}" for c in n]
            inner = with_ctes(final, *ctes)
            sql = f"SELECT * REPLACE ({', '.join(rep)}) FROM ({inner})" if rep else inner
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def erfc_sql(z):
    """1 - erf(z) from the all-positive series exp(-z^2) * sum z^(2n+1) / gamma(n + 3/2)."""
    return (f"(CASE WHEN ({z}) <= 0 THEN 1.0 WHEN ({z}) > 6 THEN 0.0 ELSE greatest(0.0, 1.0 - list_sum("
            f"list_transform(range(0, 160), lambda n: exp((2*n+1)*ln(({z})) - lgamma(n+1.5) - ({z})*({z}))))) END)")


def chi2_sql(x):
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE {erfc_sql(f'sqrt(({x})/2.0)')} END)"


def normal_sql(z):
    return f"(CASE WHEN ({z}) IS NULL THEN NULL ELSE {erfc_sql(f'abs({z})/sqrt(2.0)')} END)"


def _ibeta_series(x, a, b):
    # x^a (1-x)^b / (a B(a,b)) * (1 + sum B(a+1,n+1)/B(a+b,n+1) x^(n+1))
    return (f"exp(({a})*ln({x}) + ({b})*ln(1.0-({x})) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma(({a})+({b}))) * "
            f"(1.0 + list_sum(list_transform(range(0, 400), lambda n: exp(lgamma(({a})+1.0) + lgamma(({a})+({b})+n+1.0) "
            f"- lgamma(({a})+n+2.0) - lgamma(({a})+({b})) + (n+1)*ln({x})))))")


def t_sql(t, dof):
    """Two-sided Student tail by the incomplete-beta series on whichever side converges fast."""
    x = f"(({dof})/(({dof})+({t})*({t})))"
    y = f"((({t})*({t}))/(({dof})+({t})*({t})))"
    return (f"(CASE WHEN ({t}) IS NULL OR ({dof}) IS NULL THEN NULL WHEN ({t}) = 0 THEN 1.0 "
            f"WHEN {x} < 0.5 THEN {_ibeta_series(x, f'(({dof})/2.0)', '0.5')} "
            f"ELSE 1.0 - {_ibeta_series(y, '0.5', f'(({dof})/2.0)')} END)")


cte("bars_1d", """
SELECT 'T' || (o_custkey % 5) AS ticker, o_orderdate AS timestamp, '1d' AS horizon,
       arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
       arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume
FROM orders GROUP BY 1, 2""")

for _h, _w in (("1h", "1 hour"), ("6h", "6 hours"), ("e1d", "1 day")):
    cte(f"bars_{_h}", f"""
SELECT 'T' || (user_id % 5) AS ticker, time_bucket(INTERVAL '{_w}', ts) AS timestamp, '{_h[-2:]}' AS horizon,
       arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, event_id) AS close, sum(value) AS volume
FROM events GROUP BY 1, 2""")

cte("caps", """
SELECT 'T' || (l_suppkey % 5) AS ticker, l_shipdate AS date, round(sum(l_extendedprice), 2) AS market_cap
FROM lineitem GROUP BY 1, 2""")

cte("scored", """
SELECT event_id AS post_id, ts AS date, 'T' || (user_id % 5) AS ticker,
  CASE event_id % 7 WHEN 0 THEN '[removed]' WHEN 1 THEN ' NaN ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE props END AS selftext,
  CASE WHEN event_type IN ('purchase','signup') THEN 'positive' WHEN event_type='error' THEN 'negative' ELSE 'neutral' END AS vader_title_sentiment,
  ((c * 37) % 2000003 - 1000001) / 1000001.0 AS vader_title_score,
  CASE WHEN event_id % 5 <> 0 THEN ((c * 53) % 2000003 - 1000001) / 1000001.0 END AS vader_selftext_score,
  CASE c % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS cryptobert_title_sentiment,
  ((c * 41) % 2000003 - 1000001) / 1000001.0 AS cryptobert_title_score,
  ((c * 59) % 2000003 - 1000001) / 1000001.0 AS cryptobert_selftext_score
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)""")

cte("raw_posts", """
SELECT event_id AS submission, 'sub' || (user_id % 7) AS subreddit, 'T' || (user_id % 5) AS ticker, ts AS date,
  CAST(event_id % 11 = 0 AS INT) AS removed, CAST(round(value * 100) AS BIGINT) % 100 / 100.0 AS upvote_ratio,
  CAST(floor(value) AS BIGINT) AS score, event_id % 4 AS total_awards_received,
  user_id % 23 + event_id % 5 AS num_comments, event_id % 3 AS num_crossposts,
  CASE event_id % 7 WHEN 0 THEN '[removed]' WHEN 3 THEN NULL ELSE props END AS selftext
FROM events""")

cte("text_posts", r"""
SELECT d.doc_id, 'T' || (e.user_id % 5) AS ticker, e.ts AS date, split_part(d.text, chr(10), 1) AS title, d.text AS selftext
FROM documents d JOIN events e ON d.doc_id = e.event_id""")

cte("sets", "SELECT * FROM (VALUES " + ", ".join(
    f"({s}, '{i}', '{c}', '{m}', '{mt}', '{pm}')" for s, i, c, m, mt, pm in SETS)
    + ") v(s, set_id, category, sentiment_model, model_type, panel_mode)")
cte("grid", """
SELECT horizon, ticker, timestamp, epoch_us(timestamp) // 86400000000 AS d, CAST(substr(ticker, 2, 1) AS BIGINT) AS k,
       CAST(close >= open AS INT) AS target FROM bars_1d
UNION ALL
SELECT horizon, ticker, timestamp, epoch_us(timestamp) // 21600000000, CAST(substr(ticker, 2, 1) AS BIGINT),
       CAST(close >= open AS INT) FROM bars_6h""", "bars_1d", "bars_6h")
cte("signals", """
SELECT timestamp, ticker, target, CAST(p >= 0.5 AS INT) AS prediction, p AS probability, set_id, category,
       sentiment_model, horizon, model_type, panel_mode, 'fixed' AS hpo_variant,
       timestamp + CASE horizon WHEN '1d' THEN INTERVAL 1 DAY ELSE INTERVAL 6 HOUR END AS forecast_origin
FROM (SELECT *, ((d * 7919 + k * 104729 + s * 15485863) % 1000 + 150 * target) / 1150.0 AS p
      FROM grid, sets WHERE set_id = 'ECON' OR (d + k + s) % 17 <> 0)""", "grid", "sets")
