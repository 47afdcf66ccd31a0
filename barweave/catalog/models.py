"""Reference probabilities, training windows, preprocessing, walk-forward models, text scoring."""
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times
from ..operators import forecasts as L
from ..operators import metrics as E
from ..operators import preprocessing as P
from ..operators import windows as N
from ..operators.sequence import sliding
from ..session import reuse
from ..sources import registry
from ..sources import standins as S
from .base import cte, query
from .features import final_1d, price_1d

cte("panel", "SELECT ticker, timestamp, target FROM price_1d", "price_1d")
cte("axis", "SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM panel)", "panel")
R180 = "RANGE BETWEEN INTERVAL 180 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


def panel(t):
    return t.once("panel", lambda: price_1d(t).withColumn("target", F.col("target").cast("int")))


cte("rollprob", f"""SELECT o.timestamp, o.ticker, o.target, CAST(coalesce(ws * 1.0 / nullif(wn, 0), ps * 1.0 / pn) >= 0.5 AS INT) AS prediction,
 coalesce(ws * 1.0 / nullif(wn, 0), ps * 1.0 / pn) AS probability, 'ticker_rolling_probability_with_pooled_fallback' AS benchmark_model,
 train_window_timestamps, train_start_timestamp, train_end_timestamp FROM (
 SELECT *, count(target) OVER w AS wn, sum(target) OVER w AS ws FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY timestamp {R180})) o JOIN (
 SELECT timestamp, sum(c) OVER w AS pn, sum(s) OVER w AS ps, count(*) OVER w AS train_window_timestamps, min(timestamp) OVER w AS train_start_timestamp,
  max(timestamp) OVER w AS train_end_timestamp FROM (SELECT timestamp, count(target) c, sum(target) s FROM panel GROUP BY 1) WINDOW w AS (ORDER BY timestamp {R180})) p
 USING (timestamp) JOIN axis a USING (timestamp) WHERE a.i >= greatest(n // 2, 30) AND pn >= 20""", "axis")


@query("panel_rolling_probability", "SELECT * FROM rollprob", ["rollprob"], doubles="probability", longs="target prediction train_window_timestamps")
def _(t):
    return N.panel_rolling_probability(panel(t))


@query("asset_rolling_probability_window", f"""SELECT timestamp, ticker, target, CAST(ws * 1.0 / wn >= 0.5 AS INT) AS prediction, ws * 1.0 / wn AS probability, wn AS train_window_timestamps
FROM (SELECT *, count(target) OVER w AS wn, sum(target) OVER w AS ws, row_number() OVER (PARTITION BY ticker ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n
 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY timestamp {R180})) WHERE i >= greatest(n // 2, 30) AND wn >= 30""", ["panel"],
       doubles="probability", longs="target prediction train_window_timestamps")
def _(t):
    return N.asset_rolling_probability(panel(t), days=180)


@query("asset_rolling_probability_expanding", """SELECT timestamp, ticker, target, CAST(ws * 1.0 / wn >= 0.5 AS INT) AS prediction, ws * 1.0 / wn AS probability, wn AS train_window_timestamps
FROM (SELECT *, count(target) OVER w AS wn, sum(target) OVER w AS ws, row_number() OVER (PARTITION BY ticker ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n
 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE i >= greatest(n // 2, 30) AND wn >= 30""", ["panel"],
       doubles="probability", longs="target prediction train_window_timestamps")
def _(t):
    return N.asset_rolling_probability(panel(t))


def _window_sql(first):
    return f"""SELECT w.timestamp, i AS test_index, n AS n_timestamps, i - f AS train_window_timestamps, CASE WHEN i > f THEN a.timestamp END AS train_start_timestamp,
 CASE WHEN i > f THEN b.timestamp END AS train_end_timestamp, v.timestamp AS validation_start FROM (SELECT *, CASE WHEN i - f >= 2 THEN
 i - least(greatest(CAST(round_even((i - f) * 0.2, 0) AS BIGINT), 1), i - f - 1) END AS vi FROM (SELECT *, {first} AS f FROM axis)) w
 LEFT JOIN (SELECT i AS j, timestamp FROM axis) a ON a.j = w.f LEFT JOIN (SELECT i AS j, timestamp FROM axis) b ON b.j = w.i - 1 LEFT JOIN (SELECT i AS j, timestamp FROM axis) v ON v.j = w.vi"""


def _register_windows(name, first, mode, size):
    @query(name, _window_sql(first), ["axis"], longs="test_index n_timestamps train_window_timestamps")
    def _(t):
        return N.train_windows(panel(t).select("timestamp"), mode=mode, size=size)


_register_windows("train_windows_days", f"i - count(*) OVER (ORDER BY timestamp {R180})", "days", 180)
_register_windows("train_windows_timestamps", "greatest(i - 120, 0)", "timestamps", 120)
_register_windows("train_windows_expanding", "0", "expanding", None)


@query("chronological_split", """SELECT t.timestamp AS tau, count(*) FILTER (x.timestamp < v) AS n_inner, count(*) FILTER (x.timestamp >= v) AS n_validation FROM (
 SELECT w.timestamp, a.timestamp AS f, v.timestamp AS v FROM (SELECT *, i - least(greatest(CAST(round_even((i - f) * 0.2, 0) AS BIGINT), 1), i - f - 1) AS vi FROM (
  SELECT *, greatest(i - 60, 0) AS f FROM axis) WHERE i - f >= 2) w JOIN (SELECT i AS j, timestamp FROM axis) a ON a.j = w.f JOIN (SELECT i AS j, timestamp FROM axis) v ON v.j = w.vi) t
 JOIN panel x ON x.timestamp >= t.f AND x.timestamp < t.timestamp GROUP BY 1""", ["axis"], longs="n_inner n_validation")
def _(t):
    """Sizes of both parts of each window, from running counts over the time axis instead of a range join."""
    p = panel(t)
    per = p.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    from ..operators.sequence import running
    cum = running(per, ["_all"], "timestamp", sums={"c": F.col("n")}).select("timestamp", (F.col("c") - F.col("n")).alias("before"))
    w = N.train_windows(p.select("timestamp"), mode="timestamps", size=60).where("validation_start is not null")
    at = {}
    for c in ("timestamp", "train_start_timestamp", "validation_start"):
        at[c] = cum.withColumnsRenamed({"timestamp": c, "before": f"_{c}"})
        w = w.join(at[c], c)
    return w.select(F.col("timestamp").alias("tau"), (F.col("_validation_start") - F.col("_train_start_timestamp")).alias("n_inner"),
                    (F.col("_timestamp") - F.col("_validation_start")).alias("n_validation"))


@query("expanding_folds", """SELECT ticker, fold, role, count(*) AS n, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM (
 SELECT *, CASE WHEN b = fold THEN 'valid' ELSE 'train' END AS role FROM (SELECT *, i // (n // 5) AS b FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY timestamp) - 1 AS i,
  count(*) OVER (PARTITION BY ticker) AS n FROM panel)), (SELECT unnest([1, 2, 3, 4]) AS fold) WHERE b <= fold) GROUP BY ALL""", ["panel"], longs="n fold")
def _(t):
    f = N.expanding_folds(panel(t).select("ticker", "timestamp"), ["ticker"], "timestamp", 4)
    return f.groupBy("ticker", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_timestamp"),
                                                   F.max("timestamp").alias("last_timestamp"))


@query("train_before_test", """SELECT timestamp FROM (SELECT timestamp, lag(timestamp) OVER (ORDER BY timestamp) AS train_end FROM (SELECT DISTINCT timestamp FROM price_1d))
 WHERE train_end IS NOT NULL AND epoch_us(timestamp) // 86400000000 % 10 = 3""", ["price_1d"])
def _(t):
    """Windows that end right before their test time, but for every tenth day, where the test itself is let in."""
    ax = panel(t).select("timestamp").distinct()
    before = sliding(ax.withColumn("k", F.lit(1)), ["k"], "timestamp", {"prior": lambda w: F.lag("timestamp").over(w)}, before=1).dropna(subset=["prior"])
    leak = F.floor(times.micros("timestamp") / 86400000000) % 10 == 3
    return N.test_after_train(before.withColumn("train_end_timestamp", F.when(leak, F.col("timestamp")).otherwise(F.col("prior")))).select("timestamp")


cte("stamped", """SELECT CASE WHEN ticker = 'T2' THEN 'expanding' ELSE 'rolling_fixed' END AS mode, CASE WHEN ticker = 'T3' THEN NULL WHEN ticker = 'T4' AND d % 5 = 0 THEN -180.0 ELSE 180.0 END AS days,
 CASE WHEN ticker = 'T1' THEN 181 WHEN ticker = 'T2' AND d % 7 = 0 THEN NULL WHEN ticker = 'T0' AND d % 3 = 0 THEN 0 ELSE 180 END AS times
FROM (SELECT ticker, epoch_us(timestamp) // 86400000000 AS d FROM price_1d)""", "price_1d")


@query("window_contract", """SELECT rule, n_violations FROM (SELECT CAST(count(DISTINCT mode) > 1 AS INT) AS mode_not_constant, CAST(count(days) > 0 AND count(days) < count(*) AS INT) AS days_partly_null,
 CAST(count(times) > 0 AND count(times) < count(*) AS INT) AS timestamps_partly_null, count(*) FILTER (days <= 0) AS days_not_positive, count(*) FILTER (times <= 0) AS timestamps_not_positive,
 CAST(count(DISTINCT days) > 1 AS INT) AS days_not_constant, CAST(count(DISTINCT times) > 1 AS INT) AS timestamps_not_constant,
 count(*) FILTER (times <> floor(days)) AS timestamps_not_days_times_bars, CAST(count(days) = 0 AND count(times) = 0 AS INT) AS no_window_given FROM stamped)
 UNPIVOT (n_violations FOR rule IN (mode_not_constant, days_partly_null, timestamps_partly_null, days_not_positive, timestamps_not_positive, days_not_constant, timestamps_not_constant,
 timestamps_not_days_times_bars, no_window_given))""", ["stamped"], longs="n_violations")
def _(t):
    """Windows of a run in which some tickers break the contract, each in another way."""
    d = F.floor(times.micros("timestamp") / 86400000000)
    days, n, of = F.col("rolling_window_days"), F.col("rolling_window_timestamps"), lambda k: F.col("ticker") == k
    s = N.stamp_window(panel(t), 180, 1).withColumns({
        "train_window_mode": F.when(of("T2"), "expanding").otherwise(F.col("train_window_mode")),
        "rolling_window_days": F.when(of("T3"), None).when(of("T4") & (d % 5 == 0), -days).otherwise(days),
        "rolling_window_timestamps": F.when(of("T1"), 181).when(of("T2") & (d % 7 == 0), None).when(of("T0") & (d % 3 == 0), 0).otherwise(n)})
    return N.window_contract(s, 1)


@query("universe_stamp", """SELECT ticker, count(*) AS n, (SELECT substr(sha256(string_agg(DISTINCT ticker, '|' ORDER BY ticker)), 1, 8) FROM bars_1d) AS requested_coin_universe_hash,
 (SELECT count(DISTINCT ticker) FROM bars_1d) AS n_requested_tickers, (SELECT substr(sha256(string_agg(DISTINCT ticker, '|' ORDER BY ticker)), 1, 8) FROM price_1d) AS realized_coin_universe_hash
FROM price_1d GROUP BY 1""", ["price_1d"], longs="n n_requested_tickers")
def _(t):
    p = panel(t)
    s = L.stamp_universe(p, S.bars(t, "1d").select(F.lower("ticker").alias("ticker")), p)
    return s.groupBy("ticker", "requested_coin_universe_hash", "n_requested_tickers", "realized_coin_universe_hash").agg(F.count(F.lit(1)).alias("n"))


# ---- preprocessing -------------------------------------------------------------------------------

WF = ["log_return_t", "volume_diff", "realized_vol_14d"]
cte("folded", "SELECT *, 1 AS fold FROM price_1d WHERE timestamp < TIMESTAMP '1999-01-01' UNION ALL SELECT *, 2 FROM price_1d WHERE timestamp < TIMESTAMP '2000-01-01'", "price_1d")
cte("wlong", " UNION ALL ".join(f"SELECT fold, ticker, '{f}' AS feature, {f} AS v FROM folded" for f in WF), "folded")
cte("wthr", """SELECT a.fold, a.ticker, a.feature, a.n, CASE WHEN a.n >= 20 THEN a.lo WHEN p.n >= 20 THEN p.lo END AS lower, CASE WHEN a.n >= 20 THEN a.hi WHEN p.n >= 20 THEN p.hi END AS upper,
 CASE WHEN a.n >= 20 THEN 'ticker' WHEN p.n >= 20 THEN 'pooled' ELSE 'passthrough_insufficient_pooled' END AS rule FROM
 (SELECT fold, ticker, feature, count(v) n, quantile_cont(v, 0.005) lo, quantile_cont(v, 0.995) hi FROM wlong GROUP BY 1, 2, 3) a JOIN
 (SELECT fold, feature, count(v) n, quantile_cont(v, 0.005) lo, quantile_cont(v, 0.995) hi FROM wlong GROUP BY 1, 2) p USING (fold, feature)""", "wlong")


def folded(t):
    p = panel(t)
    cut = lambda d: F.col("timestamp") < F.lit(d).cast("timestamp_ntz")
    return p.where(cut("1999-01-01")).withColumn("fold", F.lit(1)).unionByName(p.where(cut("2000-01-01")).withColumn("fold", F.lit(2)))


@query("winsor_thresholds", "SELECT * FROM wthr", ["wthr"], doubles="lower upper", longs="fold n")
def _(t):
    return P.winsor_thresholds(folded(t), WF)


def _clip_sql(f):
    lim = lambda c: f"max(CASE WHEN feature = '{f}' THEN {c} END)"
    return lim("lower"), lim("upper")


cte("wlim", "SELECT fold, ticker, " + ", ".join(f"{_clip_sql(f)[0]} AS lo_{f}, {_clip_sql(f)[1]} AS hi_{f}" for f in WF) + " FROM wthr GROUP BY 1, 2", "wthr")
cte("wins", "SELECT fold, ticker, timestamp, " + ", ".join(f"greatest(least({f}, hi_{f}), lo_{f}) AS {f}" for f in WF) + " FROM folded JOIN wlim USING (fold, ticker)", "folded", "wlim")


@query("winsorise", "SELECT * FROM wins", ["wins"], doubles=" ".join(WF), longs="fold")
def _(t):
    f = folded(t)
    return P.winsorise(f.select("fold", "ticker", "timestamp", *WF), P.winsor_thresholds(f, WF), WF)


@query("standardise_effects", "SELECT fold, ticker, timestamp, " + ", ".join(f"({f} - avg({f}) OVER w) / stddev_pop({f}) OVER w AS {f}" for f in WF)
       + ", dense_rank() OVER (PARTITION BY fold ORDER BY ticker) - 1 AS ticker_effect FROM wins WINDOW w AS (PARTITION BY fold)", ["wins"],
       doubles=" ".join(WF), longs="fold ticker_effect")
def _(t):
    f = folded(t)
    w = reuse(P.winsorise(f.select("fold", "ticker", "timestamp", *WF), P.winsor_thresholds(f, WF), WF))
    return P.ticker_effects(w, P.standardise(w, w, WF))


# ---- walk-forward models: no SQL equivalent (iterative fits); checked against brute force in tests ----

SETS = {set_id: features for set_id, _, _, _, features in registry.set_rows()}


@query("panel_walk_forward")
def _(t):
    return L.panel_walk_forward(reuse(final_1d(t)), SETS, days=180, chunk_days=60)


@query("panel_walk_forward_tuned")
def _(t):
    return L.panel_walk_forward(reuse(final_1d(t)), SETS, days=180, chunk_days=60, grid=L.C_GRID, fixed_effects=True)


@query("asset_walk_forward")
def _(t):
    return L.asset_walk_forward(reuse(final_1d(t)), SETS, chunk=100)


# ---- text ----------------------------------------------------------------------------------------

def clean_sql(c):
    """The cleaning steps for RE2, which has no back-references: the emphasis step lists its six forms."""
    w = "[\\p{L}\\p{N}\\p{M}_]"
    sp = "[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]"
    ns = "[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]"
    steps = [
        (f"https?://{ns}+|www\\.{ns}+", "", "gi"), (f"/?u/{w}+", "", "g"), (f"/?r/{w}+", "", "g"), ("```.*?```", "", "gs"),
        ("`([^`]*)`", "\\1", "g"), ("\\[([^\\]]*)\\]\\([^\\)]*\\)", "\\1", "g"), (f"^#{{1,6}}{sp}+", "", "gm"),
        ("\\*\\*\\*(.*?)\\*\\*\\*|\\*\\*(.*?)\\*\\*|\\*(.*?)\\*|___(.*?)___|__(.*?)__|_(.*?)_", "\\1\\2\\3\\4\\5\\6", "g"),
        ("~~(.*?)~~", "\\1", "g"), (f"^>{sp}?", "", "gm"), (f"{sp}+", " ", "g")]
    x = c
    for p, to, fl in steps:
        x = f"regexp_replace({x}, '{p}', '{to}', '{fl}')"
    return f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN {c} ELSE trim({x}) END"


cte("unescaped", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&amp;', '&') AS text FROM documents")


@query("clean_text", f"SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, {clean_sql('text')} AS c FROM unescaped)", ["unescaped"], longs="n_chars")
def _(t):
    c = X.clean_text("text")
    return t.documents.select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("digest"))


@query("clean_text_report", f"""SELECT 'selftext' AS field, avg(length(text)) AS mean_length_before, avg(length({clean_sql('text')})) AS mean_length_after,
 (avg(length(text)) - avg(length({clean_sql('text')}))) * 100.0 / avg(length(text)) AS reduction_pct FROM unescaped""", ["unescaped"],
       doubles="mean_length_before mean_length_after reduction_pct")
def _(t):
    return X.cleaning_report(t.documents.select(F.col("text").alias("selftext")), ["selftext"])


@query("score_labels", """SELECT post_id, CASE WHEN vader_title_score >= 0.05 THEN 'positive' WHEN vader_title_score <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM scored""", ["scored"])
def _(t):
    return S.scored_posts(t).select("post_id", X.label_from_score("vader_title_score").alias("label"))


cte("lexicon", """SELECT token, (length(token) * 7 + ascii(token)) % 9 - 4 AS valence FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}'']+')) AS token FROM benchmark)
WHERE token <> ''""")


def lexicon(t):
    """A valence for every word of the benchmark texts."""
    w = t.benchmark.select(F.explode(X.tokens("text")).alias("token")).distinct()
    return w.select("token", ((F.length("token") * 7 + F.ascii("token")) % 9 - 4).alias("valence"))


NEG = "['" + "', '".join(X.NEGATIONS) + "']"
BOO = "['" + "', '".join(X.BOOSTERS) + "']"
cte("lexhits", f"""SELECT doc_id, CASE WHEN neg THEN v0 * -0.74 ELSE v0 END AS v FROM (
 SELECT doc_id, valence + CASE WHEN boost THEN 0.293 * sign(valence) ELSE 0 END AS v0, neg FROM (
 SELECT doc_id, token, coalesce(len(list_intersect(tk[greatest(i - 3, 1):i - 1], {NEG})) > 0, FALSE) AS neg,
  coalesce(list_contains({BOO}, tk[i - 1]) AND i > 1, FALSE) AS boost FROM (
  SELECT doc_id, tk, unnest(range(1, len(tk) + 1)) AS i, unnest(tk) AS token FROM toks)) JOIN lexicon USING (token))""", "lexicon", "toks")
cte("toks", """SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}'']+'), lambda x: x <> '') AS tk FROM documents""")


@query("lexicon_scores", """SELECT doc_id, CASE WHEN k > 0 THEN round(s / sqrt(s * s + 15), 4) END AS score, CASE WHEN k > 0 THEN round(p / (p + abs(n) + k - h), 3) END AS prob_pos,
 CASE WHEN k > 0 THEN round(abs(n) / (p + abs(n) + k - h), 3) END AS prob_neg, CASE WHEN k > 0 THEN round((k - h) / (p + abs(n) + k - h), 3) END AS prob_neu FROM (
 SELECT d.doc_id, len(t.tk) AS k, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(h, 0) AS h FROM documents d LEFT JOIN toks t USING (doc_id) LEFT JOIN (
 SELECT doc_id, sum(v) s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) p, sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END) n, count(*) FILTER (v <> 0) h FROM lexhits GROUP BY 1) USING (doc_id))""",
       ["toks", "lexhits"], doubles="score prob_pos prob_neg prob_neu")
def _(t):
    return X.lexicon_scores(t.documents, "doc_id", "text", lexicon(t)).drop("sentiment")


def length_model():
    """A stand-in for a user's classifier: probabilities from the text length."""
    def run(texts):
        k = [len(x) % 7 for x in texts]
        return [((a + 1) / 14.0, (7 - a) / 14.0, 6 / 14.0) for a in k]
    return run


@query("model_scores", """SELECT doc_id, CASE WHEN k >= 6 THEN 'positive' WHEN k <= 0 THEN 'negative' WHEN k + 1 >= 7 - k AND k + 1 >= 6 THEN 'positive' WHEN 7 - k >= 6 THEN 'negative' ELSE 'neutral' END AS sentiment,
 (k + 1) / 14.0 - (7 - k) / 14.0 AS score, (k + 1) / 14.0 AS prob_pos, (7 - k) / 14.0 AS prob_neg, 6 / 14.0 AS prob_neu FROM (SELECT doc_id, length(text) % 7 AS k FROM documents)""",
       doubles="score prob_pos prob_neg prob_neu")
def _(t):
    return L.score_with(t.documents.select("doc_id", "text"), "text", length_model).drop("text")


# ---- labelled benchmark --------------------------------------------------------------------------

cte("bench", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS truth,
 CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS pred FROM labels""")
LAB = ("positive", "negative", "neutral")


def bench(t):
    return t.labels.select(
        "doc_id", F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("truth"),
        F.when(F.col("doc_id") % 3 == 0, "positive").when(F.col("doc_id") % 3 == 1, "negative").otherwise("neutral").alias("pred"))


@query("confusion_matrix", "SELECT truth AS true_label, " + ", ".join(f"count(*) FILTER (pred = '{x}') AS {x}, count(*) FILTER (pred = '{x}') * 1.0 / count(*) AS {x}_share" for x in LAB)
       + " FROM bench GROUP BY 1", ["bench"], doubles=" ".join(f"{x}_share" for x in LAB), longs=" ".join(LAB))
def _(t):
    return E.confusion_matrix(bench(t), "truth", "pred", LAB)


@query("class_report", " UNION ALL ".join(f"""SELECT '{x}' AS label, coalesce(tp * 1.0 / nullif(np, 0), 0) AS precision, coalesce(tp * 1.0 / nullif(s, 0), 0) AS recall,
 coalesce(2.0 * tp / nullif(np + s, 0), 0) AS f1, s AS support FROM (SELECT count(*) FILTER (truth = '{x}' AND pred = '{x}') tp, count(*) FILTER (truth = '{x}') s, count(*) FILTER (pred = '{x}') np FROM bench)"""
                                              for x in LAB), ["bench"], doubles="precision recall f1", longs="support")
def _(t):
    return E.class_report(bench(t), "truth", "pred", LAB)


@query("seeded_sample", "SELECT * FROM bench ORDER BY md5('42:' || doc_id), doc_id LIMIT 1000", ["bench"])
def _(t):
    """A sampling operator: the limit is the feature."""
    return E.seeded_sample(bench(t), "doc_id", 1000)
