"""Named queries on fitted curves and resampled intervals, with SQL that takes the same Newton steps and draws the same weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proofline.operators import evidence as E, metrics as M, ranking as K
from proofline.operators.resampling import CUTS, PER_DIGEST
from proofline.plans import registry as G

_add, STEPS, RESAMPLES, SEED = G._add, 40, 1000, 7


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _curve(data: str, by: str, least: int) -> str:
    """Rows ({by}, total, good, a, b) of counts (s, ok, n) in data: a and b null where there is nothing to fit."""
    keys = by.replace(" ", "").split(",")
    using = "USING (" + by + ")"
    return f"""(WITH RECURSIVE tot AS (SELECT {by}, sum(n)::DOUBLE AS total, coalesce(sum(n) FILTER (ok), 0)::DOUBLE AS good FROM {data} GROUP BY {by}),
aim AS (SELECT d.*, CASE WHEN ok THEN (good + 1) / (good + 2) ELSE 1 / (total - good + 2) END AS t FROM {data} d JOIN tot {using}),
it AS (SELECT {by}, 0 AS k, 0::DOUBLE AS a, ln((total - good + 1) / (good + 1)) AS b FROM tot WHERE total >= {least} AND good > 0 AND good < total
UNION ALL SELECT {by}, k + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
  SELECT {by}, k, a, b, sum(n * p * (1 - p) * s * s) + 1e-10 AS h11, sum(n * p * (1 - p) * s) AS h12, sum(n * p * (1 - p)) + 1e-10 AS h22, sum(n * (t - p) * s) AS g1, sum(n * (t - p)) AS g2
  FROM (SELECT {", ".join(f"it.{x}" for x in keys)}, k, a, b, s, t, n, 1 / (1 + exp(a * s + b)) AS p FROM it JOIN aim {using}) GROUP BY ALL) WHERE k < {STEPS})
SELECT {by}, total, good, a, b FROM tot LEFT JOIN (SELECT * EXCLUDE (k) FROM it WHERE k = {STEPS}) {using})"""


_COUNTS = G._RIGHT + ", dt AS (SELECT judge, round(confidence, 4) AS s, ok, count(*) AS n FROM jc WHERE confidence IS NOT NULL GROUP BY ALL)"
_PLATT = _COUNTS + f", pl AS {_curve('dt', 'judge', 100)}"
_add("m28_platt", G._VOL, lambda v, o, l: _rounded(K.platt(K.judged_pairs(v, o, l)), "a", "b"), _PLATT + " SELECT judge, total::BIGINT AS n, round(a, 6) AS a, round(b, 6) AS b FROM pl")


def _calibrated(v: DataFrame, o: DataFrame, l: DataFrame) -> DataFrame:
    pairs = K.judged_pairs(v, o, l)
    return _rounded(K.apply_platt(pairs, K.platt(pairs)), "probability")


_add("m30_calibrated_risk", G._VOL, _calibrated, _PLATT + " SELECT judge, confidence, ok AS right, round(1 / (1 + exp(a * confidence + b)), 6) AS probability FROM jc JOIN pl USING (judge)")
_add("t02_calibrated_risk", G._VOL, lambda v, o, l: E.calibrated_risk(v, K.platt(K.judged_pairs(v, o, l))), _PLATT + ", rk AS (SELECT item_id, status, 1 / (1 + exp(a * confidence + b)) AS p FROM verdicts_r JOIN pl USING (judge) WHERE a IS NOT NULL) SELECT item_id, round(max(CASE status WHEN 'fail' THEN p WHEN 'pass' THEN 1 - p END), 6) AS score FROM rk GROUP BY item_id")

_FOLDED = G._RIGHT.replace("SELECT judge, confidence, approved = ok AS ok FROM jr", "SELECT judge, item_id, confidence, approved = ok AS ok FROM jr")
_CROSS = (
    _FOLDED
    + ", fd AS (SELECT judge, ('0x' || substr(sha256(item_id), 1, 8))::BIGINT % 5 AS fold, round(confidence, 4) AS s, ok, count(*) AS n FROM jc WHERE confidence IS NOT NULL GROUP BY ALL), tr AS (SELECT judge, k AS fold, s, ok, sum(n) AS n FROM fd, range(5) AS t(k) WHERE fold <> k GROUP BY ALL)"
    + f", cv AS {_curve('tr', 'judge, fold', 1)}, pr AS (SELECT judge, n, ok::INT AS y, coalesce(1 / (1 + exp(a * s + b)), good / total) AS p FROM fd JOIN cv USING (judge, fold))"
    + ", bn AS (SELECT judge, abs(sum(n * p) - sum(n * y)) AS gap FROM (SELECT *, least(floor(p * 10), 9) AS bin FROM pr) GROUP BY judge, bin), gp AS (SELECT judge, sum(gap) AS gap FROM bn GROUP BY judge), sm AS (SELECT judge, sum(n)::DOUBLE AS n, sum(n * y) AS good, sum(n * (p - y) ** 2) AS e FROM pr GROUP BY judge)"
    + " SELECT judge, n::BIGINT AS n, CASE WHEN fit THEN round(gap / n, 6) END AS ece, CASE WHEN fit THEN round(e / n, 6) END AS brier, CASE WHEN fit THEN round(good / n * (1 - good / n), 6) END AS brier_base_rate FROM (SELECT *, n >= 100 AND good > 0 AND good < n AS fit FROM sm JOIN gp USING (judge))"
)
_add(
    "m29_cross_fitted", G._VOL,
    lambda v, o, l: _rounded(E.cross_fitted(M.judged_right(v, o, l).select("item_id", "judge", "confidence", (F.col("approved") == F.col("right")).alias("right"))), "ece", "brier", "brier_base_rate"),
    _CROSS,
)


def _weights(source: str, columns: str) -> str:
    """ww: every row of source with its weight w in every resample r."""
    blocks = -(-RESAMPLES // PER_DIGEST)
    w = " + ".join(f"(u >= {c})::INT" for c in CUTS)
    return f"ru AS (SELECT {columns}, (b * {PER_DIGEST} + j)::BIGINT AS r, ('0x' || substr(sha256(concat('{SEED}', chr(0), b, chr(0), item_id)), 4 * j + 1, 4))::INT AS u FROM {source}, range({blocks}) AS t(b), range({PER_DIGEST}) AS x(j) WHERE b * {PER_DIGEST} + j < {RESAMPLES}), ww AS (SELECT {columns}, r, {w} AS w FROM ru)"


_ENDS = "count(*) AS resamples{0}, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high"
_SCORED = "sc AS (SELECT * FROM ratings_r WHERE score IS NOT NULL), " + _weights("sc", "item_id, score, error") + ", gs AS (SELECT r, score, (coalesce(sum(w) FILTER (error), 0))::BIGINT AS p, (coalesce(sum(w) FILTER (NOT error), 0))::BIGINT AS n FROM ww GROUP BY r, score)"
_add("t13_bootstrap_auc", "ratings", lambda s: _rounded(K.bootstrap_auc(s, RESAMPLES, SEED), "mean", "low", "high"), _SCORED + ", bl AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY r ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM gs), dr AS (SELECT r, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS value FROM bl GROUP BY r HAVING sum(p) > 0 AND sum(n) > 0) SELECT " + _ENDS.format(", round(avg(value), 6) AS mean") + " FROM dr")
_add(
    "t17_recall_interval", "ratings", lambda s: _rounded(E.recall_interval(s, 0.1, RESAMPLES, SEED), "low", "high"),
    _SCORED + ", ab AS (SELECT *, p + n AS m, coalesce(sum(p + n) OVER (PARTITION BY r ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(p + n) OVER (PARTITION BY r) AS total FROM gs), cu AS (SELECT *, least(greatest(1, round_even(0.1::DOUBLE * total, 0)), total) AS k FROM ab), dr AS (SELECT r, sum(CASE WHEN m > 0 THEN p * (greatest(0, least(m, k - above)) / m) ELSE 0 END) / sum(p) AS value FROM cu WHERE (SELECT count(*) FROM sc) >= 200 GROUP BY r HAVING sum(p) > 0) SELECT (SELECT count(*) FROM sc) AS n, " + _ENDS.format("") + " FROM dr",
)
_add(
    "t14_cluster_bootstrap", "verdicts", lambda v: _rounded(E.bootstrap_ci(v.filter("confidence IS NOT NULL").select("item_id", F.col("confidence").alias("value")), E.weighted_mean, RESAMPLES, SEED), "low", "high"),
    "im AS (SELECT item_id, sum(confidence) AS s, count(*) AS k FROM verdicts_r WHERE confidence IS NOT NULL GROUP BY item_id), " + _weights("im", "item_id, s, k") + ", dr AS (SELECT r, sum(w * s) / sum(w * k) AS value FROM ww GROUP BY r HAVING sum(w * k) > 0) SELECT " + _ENDS.format("") + " FROM dr",
)
