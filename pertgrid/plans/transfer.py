"""Queries: transfer, scores, decoders, moments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decoders, effects, latent, metrics, moments, ranks, transfer
from ..operators.pooling import row_totals
from . import registry as R
from .registry import query, r, sql

_CPM4 = "SELECT p.target, p.gene_id, coalesce(h0.cpm, 0) AS h0, coalesce(k0.cpm, 0) AS k0, p.cpm AS kp FROM panel_cpm p LEFT JOIN panel_cpm k0 ON k0.context = 'F' AND k0.target = 0 AND k0.gene_id = p.gene_id LEFT JOIN panel_cpm h0 ON h0.context = 'O' AND h0.target = 0 AND h0.gene_id = p.gene_id WHERE p.context = 'F' AND p.target <> 0"


def _cpm4(spark, d):
    p = R.panel_cpm(spark, d)
    own = lambda c, n: p.where((F.col("context") == c) & (F.col("target") == 0)).select("gene_id", F.col("cpm").alias(n))
    return p.where("context = 'F' and target <> 0").select("target", "gene_id", F.col("cpm").alias("kp")).join(own("F", "k0"), "gene_id", "left").join(own("O", "h0"), "gene_id", "left").na.fill(0.0, ["k0", "h0"])


@query("transfer_rules", sql("panel_cpm", x=_CPM4, body="SELECT target, gene_id, round(h0 + kp - k0, 4) AS additive, round(h0 * CASE WHEN k0 > 0 THEN kp / k0 ELSE 1 END, 4) AS ratio, round((h0 + 1) * (kp + 1) / (k0 + 1) - 1, 4) AS log1p FROM x"))
def transfer_rules(spark, d):
    x = _cpm4(spark, d)
    return x.select("target", "gene_id", *[r(transfer.transferred(F.col("h0"), F.col("k0"), F.col("kp"), rule), 4).alias(rule) for rule in ("additive", "ratio", "log1p")])


@query("boundary_closure", sql("panel_cpm", x=_CPM4, body="SELECT target, gene_id, round(greatest(h0 + kp - k0, 0) * 1e6 / sum(greatest(h0 + kp - k0, 0)) OVER (PARTITION BY target), 4) AS closed, round(sum(greatest(-(h0 + kp - k0), 0)) OVER (PARTITION BY target), 4) AS negative_mass FROM x"))
def boundary_closure(spark, d):
    x = _cpm4(spark, d).withColumn("v", F.col("h0") + F.col("kp") - F.col("k0"))
    return transfer.close_boundary(x, ["target"], "v").select("target", "gene_id", r("closed", 4).alias("closed"), r("negative_mass", 4).alias("negative_mass"))


@query("pseudocount_direction", sql("panel_cpm", x=_CPM4, body="SELECT target, gene_id, round(ln((kp + 20) / (k0 + 20)), 6) AS log_change, round(kp - k0, 4) AS difference, round(greatest((h0 + 20) * (kp + 20) / (k0 + 20) - 20, 0), 4) AS realised FROM x"))
def pseudocount_direction(spark, d):
    x = _cpm4(spark, d)
    change = transfer.direction(F.col("kp"), F.col("k0"))
    return x.select("target", "gene_id", r(change).alias("log_change"), r(transfer.direction(F.col("kp"), F.col("k0"), transfer.INFINITE), 4).alias("difference"), r(transfer.realise(F.col("h0"), change), 4).alias("realised"))


@query("average_change", sql("effects", body="SELECT target, gene_id, round(avg(value), 6) AS value, count(*) AS donors FROM effects GROUP BY target, gene_id"))
def average_change(spark, d):
    return transfer.average_change([R.truth(spark, d), R.prediction(spark, d)]).withColumn("value", r("value"))


@query("fallback_mean", sql("truth", body="SELECT t.target, g.gene_id, round(coalesce(x.value, avg(x.value) OVER (PARTITION BY g.gene_id), 0), 6) AS value, x.value IS NULL AS is_fallback FROM (SELECT DISTINCT target FROM truth) t CROSS JOIN (SELECT DISTINCT gene_id FROM truth) g LEFT JOIN (SELECT * FROM truth WHERE (target + gene_id) % 5 <> 0) x ON x.target = t.target AND x.gene_id = g.gene_id"))
def fallback_mean(spark, d):
    t = R.truth(spark, d)
    grid = t.select("target").distinct().join(t.select("gene_id").distinct(), how="cross")
    return transfer.with_fallback(t.where("(target + gene_id) % 5 <> 0"), grid).withColumn("value", r("value"))


@query("global_axis", sql("truth", body="SELECT gene_id, round(avg(value), 6) AS value FROM truth WHERE target <> gene_id GROUP BY gene_id"))
def global_axis(spark, d):
    return transfer.global_axis(R.truth(spark, d)).withColumn("value", r("value"))


@query("shared_specific", sql("truth", g="SELECT gene_id, avg(value) AS m FROM truth WHERE target <> gene_id GROUP BY gene_id", body="SELECT target, gene_id, round(m, 6) AS shared, round(value - m, 6) AS specific FROM truth JOIN g USING (gene_id)"))
def shared_specific(spark, d):
    return transfer.shared_specific(R.truth(spark, d)).select("target", "gene_id", r("shared").alias("shared"), r("specific").alias("specific"))


def _xy(spark, d):
    return R.pairs(spark, d).withColumnsRenamed({"prediction": "x", "truth": "y"})


_S3 = "SELECT target, sum(prediction * prediction) AS xx, sum(prediction * truth) AS xy, sum(truth * truth) AS yy FROM pairs GROUP BY target"


@query("projection", sql("pairs", s=_S3, body="SELECT target, round(xy / nullif(xx, 0), 6) AS slope, round(xy / sqrt(xx * yy), 6) AS cosine, round(sqrt(xx / yy), 6) AS norm_ratio, round(yy - xy * xy / xx, 6) AS orthogonal_energy FROM s"))
def projection(spark, d):
    return transfer.project(_xy(spark, d), ["target"]).select("target", *[r(c).alias(c) for c in ("slope", "cosine", "norm_ratio", "orthogonal_energy")])


@query("two_column_ols", sql("pairs", s="SELECT target, sum(prediction * prediction) AS a, sum(prediction * prediction * (gene_id - 30)) AS b, sum(prediction * prediction * (gene_id - 30) * (gene_id - 30)) AS c, sum(prediction * truth) AS p, sum(prediction * (gene_id - 30) * truth) AS q FROM pairs GROUP BY target", body="SELECT target, round((p * c - q * b) / (a * c - b * b), 6) AS a, round((q * a - p * b) / (a * c - b * b), 6) AS b FROM s"))
def two_column_ols(spark, d):
    x = _xy(spark, d).withColumn("dd", (F.col("gene_id") - 30).cast("double"))
    return transfer.two_column_ols(x, ["target"], "x", "dd", "y").select("target", r("a").alias("a"), r("b").alias("b"))


@query("cross_fitted_slopes", sql("pairs", s=_S3, f="SELECT target % 5 AS fold, xy / xx AS slope FROM s", body="SELECT h.fold, round(median(f.slope), 6) AS fitted FROM (SELECT DISTINCT fold FROM f) h JOIN f ON f.fold <> h.fold GROUP BY h.fold"))
def cross_fitted_slopes(spark, d):
    p = transfer.project(_xy(spark, d), ["target"]).withColumn("fold", F.col("target") % 5)
    return transfer.cross_fitted(p, "fold", "slope").withColumn("fitted", r("fitted"))


@query("shrunk_gene_slopes", sql("pairs", g="SELECT gene_id, sum(prediction * truth) AS xy, sum(prediction * prediction) AS xx FROM pairs GROUP BY gene_id", k="SELECT sum(xy) / sum(xx) AS slope, 2 * median(xx) FILTER (xx > 0) AS lam FROM g", body="SELECT gene_id, round((xy + lam * slope) / (xx + lam), 6) AS slope FROM g, k"))
def shrunk_gene_slopes(spark, d):
    return transfer.shrunk_gene_slopes(_xy(spark, d), 2.0).withColumn("slope", r("slope"))


@query("source_weights", None)
def source_weights(spark, d):
    """Non-negative weights of two sources (the contexts' gene means) for the truth."""
    t = R.truth(spark, d)
    p = R.prediction(spark, d).withColumnRenamed("value", "a").join(transfer.global_axis(t).withColumnRenamed("value", "b"), "gene_id")
    g, rhs = transfer.gram(p, t, ["a", "b"])
    w = transfer.nonnegative_weights(g, rhs)
    return spark.createDataFrame([("a", w[0]), ("b", w[1])], "source string, weight double")


_GRID = "(VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0), (2.0)) a(amplitude)"


@query("scale_scan", sql("pairs", s=_S3, body=f"SELECT target, amplitude, round(yy - 2 * amplitude * xy + amplitude * amplitude * xx, 6) AS error, round(yy, 6) AS energy FROM s, {_GRID}"))
def scale_scan(spark, d):
    return transfer.scale_scan(_xy(spark, d), ["target"], [0.0, 0.25, 0.5, 1.0, 2.0]).select("target", "amplitude", r("error").alias("error"), r("energy").alias("energy"))


@query("chosen_amplitude", sql("pairs", s=_S3, e=f"SELECT target % 5 AS fold, amplitude, sum(yy - 2 * amplitude * xy + amplitude * amplitude * xx) AS error FROM s, {_GRID} GROUP BY ALL", body="SELECT fold, arg_min(amplitude, error) AS amplitude, round(min(error), 6) AS error FROM e GROUP BY fold"))
def chosen_amplitude(spark, d):
    s = transfer.scale_scan(_xy(spark, d), ["target"], [0.0, 0.25, 0.5, 1.0, 2.0]).withColumn("fold", F.col("target") % 5)
    return transfer.chosen_amplitude(s, ["fold"]).withColumn("error", r("error"))


@query("cross_fit_curve", sql("pairs", s=_S3, e=f"SELECT target % 5 AS fold, amplitude, yy - 2 * amplitude * xy + amplitude * amplitude * xx AS error FROM s, {_GRID}", c="SELECT h.fold, e.amplitude, avg(error) FILTER (e.fold <> h.fold) AS training, avg(error) FILTER (e.fold = h.fold) AS held_out FROM (SELECT DISTINCT fold FROM e) h CROSS JOIN e GROUP BY ALL", body="SELECT fold, amplitude, round(training, 6) AS training, round(held_out, 6) AS held_out, row_number() OVER (PARTITION BY fold ORDER BY training, amplitude) = 1 AS selected FROM c"))
def cross_fit_curve(spark, d):
    s = transfer.scale_scan(_xy(spark, d), ["target"], [0.0, 0.25, 0.5, 1.0, 2.0]).withColumn("fold", F.col("target") % 5)
    return transfer.cross_fit_curve(s, "fold").select("fold", "amplitude", r("training").alias("training"), r("held_out").alias("held_out"), "selected")


@query("inverse_noise_average", sql("effects", w="SELECT context, 1 / sum(value * value) AS w FROM effects GROUP BY context", n="SELECT context, w / sum(w) OVER () AS weight FROM w", body="SELECT target, gene_id, round(sum(weight * value) / sum(weight), 6) AS value FROM effects JOIN n USING (context) GROUP BY target, gene_id"))
def inverse_noise_average(spark, d):
    e = R.effects(spark, d)
    noise = e.groupBy("context").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    return transfer.weighted_average(e, transfer.inverse_noise_weights(noise, "context", "energy"), "context").withColumn("value", r("value"))


@query("wrong_target", sql("truth", p="SELECT target, row_number() OVER (ORDER BY target) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT target FROM truth)", body="SELECT a.target, t.gene_id, round(t.value, 6) AS value FROM p a JOIN p b ON (a.k + 3) % a.n = b.k JOIN truth t ON t.target = b.target"))
def wrong_target(spark, d):
    t = R.truth(spark, d)
    return transfer.wrong_target(t, t.select("target").distinct(), 3).withColumn("value", r("value"))


@query("own_axis_average", sql("panel", body=", s AS (SELECT p.context, p.target, p.gene_id, p.count, c.count AS c0 FROM panel p JOIN panel c ON c.context = p.context AND c.gene_id = p.gene_id AND c.target = 0 WHERE p.target <> 0), v AS (SELECT target, gene_id, ln((count * 1e6 / sum(count) OVER w + 20) / (c0 * 1e6 / sum(c0) OVER w + 20)) AS value FROM s WINDOW w AS (PARTITION BY context, target)) SELECT target, gene_id, round(avg(value), 6) AS value, count(*) AS donors FROM v GROUP BY ALL"))
def own_axis_average(spark, d):
    p = R.panel(spark, d)
    c = p.where("target = 0").select("context", "gene_id", F.col("count").alias("control_count"))
    s = p.where("target <> 0").join(c, ["context", "gene_id"])
    return transfer.own_axis_average([s.where(F.col("context") == k) for k in ("F", "O")]).withColumn("value", r("value"))


@query("profile_metrics", sql("pairs", body="SELECT target, round(sum(prediction * truth) / sqrt(sum(prediction * prediction) * sum(truth * truth)), 6) AS cosine, round(sum(abs(prediction - truth)) / sum(abs(truth)), 6) AS nae, round(sqrt(sum(prediction * prediction) / sum(truth * truth)), 6) AS norm_ratio, round(sum((prediction - truth) * (prediction - truth)), 6) AS squared_error, round(sum(truth * truth), 6) AS energy, round(avg(CASE WHEN sign(prediction) = sign(truth) THEN 1.0::DOUBLE ELSE 0 END), 6) AS sign_agreement FROM pairs GROUP BY target"))
def profile_metrics(spark, d):
    return metrics.profile_metrics(R.pairs(spark, d), ["target"]).select("target", *[r(c).alias(c) for c in ("cosine", "nae", "norm_ratio", "squared_error", "energy", "sign_agreement")])


@query("ratio_of_sums", sql("pairs", body="SELECT target % 5 AS fold, round(sum((prediction - truth) * (prediction - truth)) / sum(truth * truth), 6) AS ratio FROM pairs GROUP BY target % 5"))
def ratio_of_sums(spark, d):
    s = metrics.profile_metrics(R.pairs(spark, d), ["target"]).withColumn("fold", F.col("target") % 5)
    return metrics.ratio_of_sums(s, ["fold"]).withColumn("ratio", r("ratio"))


@query("energy_decomposition", sql("pairs", body="SELECT target, round(sum((prediction - truth) * (prediction - truth)) / sum(truth * truth), 6) AS ratio, round(1 + sum(prediction * prediction) / sum(truth * truth) - 2 * sum(prediction * truth) / sum(truth * truth), 6) AS decomposed FROM pairs GROUP BY target"))
def energy_decomposition(spark, d):
    return metrics.energy_decomposition(R.pairs(spark, d), ["target"]).select("target", r("ratio").alias("ratio"), r("decomposed").alias("decomposed"))


_REC = "SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(prediction) DESC, gene_id) AS pr, row_number() OVER (PARTITION BY target ORDER BY abs(truth) DESC, gene_id) AS tr, {k} AS k FROM pairs"
_REC_OUT = "SELECT target, round(count(*) FILTER (pr <= k AND tr <= k) / max(k), 6) AS recall, round(count(*) FILTER (pr <= k AND tr <= k AND sign(prediction) = sign(truth)) / max(k), 6) AS signed_recovery, round(count(*) FILTER (pr <= k AND tr <= k AND sign(prediction) = sign(truth)) / nullif(count(*) FILTER (pr <= k AND tr <= k), 0), 6) AS sign_given_recovered FROM x GROUP BY target"


@query("signed_recovery", sql("pairs", x=_REC.format(k="15"), body=_REC_OUT))
def signed_recovery(spark, d):
    return metrics.signed_recovery(R.pairs(spark, d), 15).select("target", *[r(c).alias(c) for c in ("recall", "signed_recovery", "sign_given_recovered")])


@query("strong_recovery", sql("pairs", x=_REC.format(k="5 + target % 7"), body=_REC_OUT))
def strong_recovery(spark, d):
    return metrics.signed_recovery(R.pairs(spark, d).withColumn("n_strong", 5 + F.col("target") % 7), "n_strong").select("target", *[r(c).alias(c) for c in ("recall", "signed_recovery", "sign_given_recovered")])


_SIM = "SELECT a.target AS i, b.target AS j, sum(a.value * b.value) / (sqrt(max(an.n)) * sqrt(max(bn.n))) AS s FROM prediction a JOIN truth b USING (gene_id) JOIN (SELECT target, sum(value * value) AS n FROM prediction GROUP BY ALL) an ON an.target = a.target JOIN (SELECT target, sum(value * value) AS n FROM truth GROUP BY ALL) bn ON bn.target = b.target GROUP BY a.target, b.target"


@query("retrieval", sql("prediction", "truth", c=_SIM, m="SELECT i, s, max(CASE WHEN i = j THEN s END) OVER (PARTITION BY i) AS own FROM c", body="SELECT i AS target, count(*) FILTER (s > own + 1e-12 * (1 + abs(own))) + 0.5::DOUBLE * (count(*) FILTER (abs(s - own) <= 1e-12 * (1 + abs(own))) - 1) AS rank0, round(1 - (count(*) FILTER (s > own + 1e-12 * (1 + abs(own))) + 0.5 * (count(*) FILTER (abs(s - own) <= 1e-12 * (1 + abs(own))) - 1)) / (count(*) - 1), 6) AS score, count(*) FILTER (s > own + 1e-12 * (1 + abs(own))) = 0 AS top1 FROM m GROUP BY i"))
def retrieval(spark, d):
    return metrics.retrieval(R.prediction(spark, d), R.truth(spark, d), 1e-12).select("target", "rank0", r("score").alias("score"), "top1")


@query("matched_minus_wrong", sql("prediction", "truth", c=_SIM, body="SELECT i, round(max(CASE WHEN i = j THEN s END) - median(CASE WHEN i <> j THEN s END), 6) AS margin FROM c GROUP BY i"))
def matched_minus_wrong(spark, d):
    return metrics.matched_minus_wrong(effects.cosine_pairs(R.prediction(spark, d), R.truth(spark, d))).withColumn("margin", r("margin"))


@query("expression_bins", sql("pairs", "panel_cpm", x="SELECT p.*, coalesce(c.cpm, 0) / 1000 AS e FROM pairs p LEFT JOIN panel_cpm c ON c.context = 'F' AND c.target = 0 AND c.gene_id = p.gene_id", b="SELECT CASE WHEN e >= 100 THEN 5 WHEN e >= 20 THEN 4 WHEN e >= 5 THEN 3 WHEN e >= 1 THEN 2 WHEN e >= 0.1 THEN 1 ELSE 0 END AS bin, count(*) AS n, sum((prediction - truth) * (prediction - truth)) AS se, sum(truth * truth) AS tt FROM x GROUP BY 1", body="SELECT bin, n, round(se / sum(se) OVER (), 6) AS error_share, round(tt / sum(tt) OVER (), 6) AS energy_share FROM b"))
def expression_bins(spark, d):
    c = R.panel_cpm(spark, d).where("context = 'F' and target = 0").select("gene_id", (F.col("cpm") / 1000).alias("e"))
    p = R.pairs(spark, d).join(c, "gene_id", "left").na.fill(0.0, ["e"])
    return metrics.expression_bins(p, "e").select("bin", "n", r("error_share").alias("error_share"), r("energy_share").alias("energy_share"))


@query("common_response", sql("prediction", body="SELECT target, gene_id, round(avg(value) OVER (PARTITION BY gene_id), 6) AS value FROM prediction"))
def common_response(spark, d):
    return metrics.common_response(R.prediction(spark, d)).select("target", "gene_id", r("value").alias("value"))


@query("scoped_summary", sql("pairs", s="SELECT target, sum((prediction - truth) * (prediction - truth)) AS se, sum(truth * truth) AS tt FROM pairs GROUP BY target", q="SELECT *, ntile(4) OVER (ORDER BY tt, target) AS q FROM s", z="SELECT 'overall' AS scope, * FROM q UNION ALL SELECT 'Q' || q, * FROM q", body="SELECT scope, count(*) AS n, round(avg(se), 6) AS mean_squared_error, round(median(se), 6) AS median_squared_error, round(sum(se) / sum(tt), 6) AS ratio FROM z GROUP BY scope"))
def scoped_summary(spark, d):
    s = ranks.quantile_bins(metrics.profile_metrics(R.pairs(spark, d), ["target"]), "energy", "target", 4, out="q")
    return metrics.scoped_summary(s, "q", ["squared_error"], "squared_error", "energy").select("scope", "n", *[r(c).alias(c) for c in ("mean_squared_error", "median_squared_error", "ratio")])


@query("paired_differences", sql("effects", body="SELECT target, round(f - o, 6) AS difference FROM (SELECT target, sum(value) FILTER (context = 'F') AS f, sum(value) FILTER (context = 'O') AS o FROM effects GROUP BY target) WHERE f IS NOT NULL AND o IS NOT NULL"))
def paired_differences(spark, d):
    s = R.effects(spark, d).groupBy("context", "target").agg(F.sum("value").alias("v"))
    return metrics.paired_differences(s, "context", "F", "O", "v").withColumn("difference", r("difference"))


@query("best_per_target", sql("effects", body="SELECT target, context, gene_id FROM effects QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(value, 9) DESC, context, gene_id) = 1"))
def best_per_target(spark, d):
    e = R.effects(spark, d).withColumn("v", F.round("value", 9))
    return metrics.best_per_target(e, F.col("v").desc(), F.col("context"), F.col("gene_id")).select("target", "context", "gene_id")


@query("significant_jaccard", sql("prediction", "truth", body="SELECT coalesce(p.target, t.target) AS target, round(coalesce(count(*) FILTER (p.value > 0.3 AND t.value > 0.3) / nullif(count(*) FILTER (p.value > 0.3 OR t.value > 0.3), 0), 1), 6) AS jaccard FROM prediction p FULL JOIN truth t ON p.target = t.target AND p.gene_id = t.gene_id GROUP BY 1"))
def significant_jaccard(spark, d):
    s = lambda df: df.withColumn("significant", F.col("value") > 0.3)
    return metrics.significant_jaccard(s(R.prediction(spark, d)), s(R.truth(spark, d)), ["target"]).withColumn("jaccard", r("jaccard"))


_EFF = "SELECT gene_id, avg(value) AS d FROM truth GROUP BY gene_id"


def _eff(spark, d):
    return R.truth(spark, d).groupBy("gene_id").agg(F.avg("value").alias("value"))


@query("log_rate_decoder", sql("modules", "truth", e=_EFF, x="SELECT m.row_id, m.gene_id, m.count, e.d, CASE WHEN e.d IS NOT NULL THEN m.count * exp(2 * e.d) END AS w FROM modules m LEFT JOIN e USING (gene_id)", body="SELECT row_id, gene_id, round(CASE WHEN d IS NOT NULL THEN sum(CASE WHEN d IS NOT NULL THEN count END) OVER p * w / sum(w) OVER p ELSE count END, 6) AS expected FROM x WINDOW p AS (PARTITION BY row_id)"))
def log_rate_decoder(spark, d):
    return decoders.log_rate(R.modules(spark, d), _eff(spark, d), 2.0).withColumn("expected", r("expected"))


@query("shift_decoder", sql("modules", "truth", e=_EFF, t="SELECT row_id, sum(count) AS total FROM modules GROUP BY row_id", x="SELECT t.row_id, e.gene_id, t.total, greatest(exp(ln(1 + coalesce(c.count, 0) * 1e4 / t.total) + e.d) - 1, 0) AS raw FROM t CROSS JOIN e LEFT JOIN modules c ON c.row_id = t.row_id AND c.gene_id = e.gene_id", body="SELECT row_id, gene_id, round(coalesce(total * raw / nullif(sum(raw) OVER (PARTITION BY row_id), 0), 0), 5) AS expected FROM x"))
def shift_decoder(spark, d):
    return decoders.shift_and_renormalise(R.modules(spark, d), _eff(spark, d)).withColumn("expected", r("expected", 5))


@query("decoded_sums", sql("modules", "obs", "truth", e=_EFF, x="SELECT m.row_id, m.gene_id, m.count, e.d, CASE WHEN e.d IS NOT NULL THEN m.count * exp(e.d) END AS w FROM modules m LEFT JOIN e USING (gene_id)", y="SELECT row_id, gene_id, CASE WHEN d IS NOT NULL THEN sum(CASE WHEN d IS NOT NULL THEN count END) OVER p * w / sum(w) OVER p ELSE count END AS v FROM x WINDOW p AS (PARTITION BY row_id)", z="SELECT o.target, y.gene_id, sum(v) AS v, sum(v * 1e6 / s) AS c FROM (SELECT *, sum(v) OVER (PARTITION BY row_id) AS s FROM y) y JOIN obs o USING (row_id) GROUP BY ALL", body="SELECT z.target, gene_id, round(v, 4) AS expected, round(v * 1e6 / sum(v) OVER (PARTITION BY z.target), 4) AS cpm, round(c / n, 4) AS mean_cpm FROM z JOIN (SELECT target, count(*) AS n FROM obs GROUP BY target) k USING (target)"))
def decoded_sums(spark, d):
    expected = decoders.log_rate(R.modules(spark, d), _eff(spark, d))
    return decoders.decoded_sums(expected, R.obs(spark, d), "target").select("target", "gene_id", *[r(c, 4).alias(c) for c in ("expected", "cpm", "mean_cpm")])


@query("tangents", sql("modules", "truth", e=_EFF, body="SELECT row_id, gene_id, round(count * (d - sum(count * d) OVER p / sum(count) OVER p), 6) + 0 AS tangent FROM modules JOIN e USING (gene_id) WINDOW p AS (PARTITION BY row_id)"))
def tangents(spark, d):
    return decoders.tangent(R.modules(spark, d), _eff(spark, d)).withColumn("tangent", r("tangent"))


@query("multiplicative_sum", sql("modules", "truth", e=_EFF, x="SELECT m.row_id, m.gene_id, m.count, m.count * pow(2.0, coalesce(e.d, 0)) AS w FROM modules m LEFT JOIN e USING (gene_id)", y="SELECT gene_id, sum(count) OVER p * w / sum(w) OVER p AS v FROM x WINDOW p AS (PARTITION BY row_id)", body="SELECT gene_id, round(sum(v), 4) AS expected FROM y GROUP BY gene_id"))
def multiplicative_sum(spark, d):
    return decoders.multiplicative_sum(R.modules(spark, d), _eff(spark, d)).withColumn("expected", r("expected", 4))


_EXP = "SELECT l_suppkey, l_partkey, round(sum(l_discount) * 7.3, 6) AS v FROM lineitem GROUP BY ALL"


def _expected(spark, d):
    return R.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_discount") * 7.3, 6).alias("expected"))


@query("largest_remainder", f"WITH e AS ({_EXP}), x AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v - floor(v) DESC, l_partkey) AS rk, round_even(sum(v) OVER (PARTITION BY l_suppkey), 0) - sum(floor(v)) OVER (PARTITION BY l_suppkey) AS lft FROM e) SELECT l_suppkey, l_partkey, CAST(floor(v) + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS rounded FROM x")
def largest_remainder(spark, d):
    return decoders.largest_remainder(_expected(spark, d), ["l_suppkey"], "l_partkey").select("l_suppkey", "l_partkey", "rounded")


@query("systematic_rounding", f"WITH e AS ({_EXP}), u AS (SELECT DISTINCT l_suppkey, (('0x' || substr(sha256('0:' || l_suppkey), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u FROM lineitem), c AS (SELECT l_suppkey, l_partkey, floor(sum(v) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - u) + 1 AS c FROM e JOIN u USING (l_suppkey)) SELECT l_suppkey, l_partkey, CAST(c - coalesce(lag(c) OVER (PARTITION BY l_suppkey ORDER BY l_partkey), 0) AS BIGINT) AS rounded FROM c")
def systematic_rounding(spark, d):
    return decoders.systematic_rounding(_expected(spark, d), ["l_suppkey"], "l_partkey").select("l_suppkey", "l_partkey", "rounded")


@query("stochastic_rounding", f"WITH e AS ({_EXP}) SELECT l_suppkey, l_partkey, CAST(floor(v) + CASE WHEN (('0x' || substr(sha256('0:' || l_suppkey || ':' || l_partkey), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE < v - floor(v) THEN 1 ELSE 0 END AS BIGINT) AS rounded FROM e")
def stochastic_rounding(spark, d):
    return decoders.stochastic_rounding(_expected(spark, d), ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey", "rounded")


@query("shifted_counts", sql("modules", x="SELECT t.row_id, g.gene_id, coalesce(m.count, 0) AS count, total, CASE WHEN g.gene_id < 30 THEN g.gene_id * 1000.0 - 15000 ELSE 0 END AS d FROM (SELECT row_id, sum(count) AS total FROM modules GROUP BY row_id) t CROSS JOIN (SELECT unnest(range(60)) AS gene_id) g LEFT JOIN modules m ON m.row_id = t.row_id AND m.gene_id = g.gene_id", y="SELECT row_id, gene_id, CAST(round_even(greatest(0, count * 1e6 / total + d) * least(total::DOUBLE, 100) / 1e6, 0) AS BIGINT) AS count FROM x", body="SELECT * FROM y WHERE count > 0"))
def shifted_counts(spark, d):
    delta = spark.range(30).select(F.col("id").alias("gene_id"), (F.col("id") * 1000.0 - 15000).alias("value"))
    return decoders.shifted_counts(R.modules(spark, d), delta, 100.0)


@query("fidelity", sql("pairs", body="SELECT target, round(sum(prediction * truth) / sqrt(sum(prediction * prediction) * sum(truth * truth)), 6) AS cosine, round(sqrt(sum(prediction * prediction) / sum(truth * truth)), 6) AS norm_ratio, round(max(abs(prediction - truth)), 6) AS max_error, sum(prediction * truth) / sqrt(sum(prediction * prediction) * sum(truth * truth)) >= 0.3 AS passes FROM pairs GROUP BY target"))
def fidelity(spark, d):
    return decoders.fidelity(R.prediction(spark, d), R.truth(spark, d), ["target"], "gene_id", 0.3).select("target", r("cosine").alias("cosine"), r("norm_ratio").alias("norm_ratio"), r("max_error").alias("max_error"), "passes")


@query("poisson_draws", None)
def poisson_draws(spark, d):
    return decoders.poisson_draw(_expected(spark, d), ["l_suppkey", "l_partkey"], "expected")


@query("negative_binomial_draws", None)
def negative_binomial_draws(spark, d):
    return decoders.negative_binomial_draw(_expected(spark, d).withColumn("theta", F.lit(2.0)), ["l_suppkey", "l_partkey"], "expected", "theta")


@query("multinomial_draws", None)
def multinomial_draws(spark, d):
    e = _expected(spark, d).withColumn("total", F.lit(1000))
    return decoders.multinomial_draw(e, "l_suppkey", "l_partkey", "expected", "total")


@query("nb_quantile_map", None)
def nb_quantile_map(spark, d):
    c = R.modules(spark, d).withColumn("mu", F.lit(20.0)).withColumn("new_mu", F.lit(30.0))
    return decoders.nb_quantile_map(c, ["row_id", "gene_id"], "count", "mu", "new_mu", 5.0)


@query("scatter_increases", None)
def scatter_increases(spark, d):
    cells = R.modules(spark, d).join(R.obs(spark, d).select("row_id", "target"), "row_id").groupBy("target", "row_id").agg(F.sum("count").cast("double").alias("depth"))
    extra = R.panel(spark, d).groupBy("gene_id").agg((F.sum("count") % 50).alias("extra")).join(cells.select("target").distinct(), how="cross")
    return decoders.scatter_increases(extra, cells)


@query("covariance_columns", sql("modules", g="SELECT DISTINCT gene_id FROM modules", x="SELECT a.gene_id, t.gene_id AS target_gene, sum(a.count * t.count) AS xy FROM modules a JOIN modules t ON a.row_id = t.row_id AND t.gene_id IN (1, 2, 3) GROUP BY ALL", s="SELECT gene_id, sum(count)::DOUBLE AS s FROM modules GROUP BY gene_id", body="SELECT a.gene_id, t.gene_id AS target_gene, round((coalesce(xy, 0) - a.s * t.s / (SELECT count(*) FROM orders)) / ((SELECT count(*) FROM orders) - 1), 6) AS covariance FROM s a JOIN s t ON t.gene_id IN (1, 2, 3) LEFT JOIN x ON x.gene_id = a.gene_id AND x.target_gene = t.gene_id"))
def covariance_columns(spark, d):
    return moments.covariance_columns(R.modules(spark, d).withColumn("value", F.col("count").cast("double")), [1, 2, 3], R.obs(spark, d).count()).withColumn("covariance", r("covariance"))


@query("pooled_within_covariance", sql("modules", "obs", m="SELECT m.*, o.batch FROM modules m JOIN obs o USING (row_id)", n="SELECT batch, count(*)::DOUBLE AS n FROM obs GROUP BY batch", s="SELECT batch, gene_id, sum(count)::DOUBLE AS s FROM m GROUP BY ALL", x="SELECT a.batch, a.gene_id, t.gene_id AS target_gene, sum(a.count * t.count) AS xy FROM m a JOIN m t ON a.row_id = t.row_id AND t.gene_id IN (1, 2) GROUP BY ALL", body="SELECT a.gene_id, t.gene_id AS target_gene, round(sum(coalesce(xy, 0) - a.s * t.s / n) / (SELECT sum(n) - count(*) FROM n), 6) AS covariance FROM s a JOIN s t ON t.batch = a.batch AND t.gene_id IN (1, 2) JOIN n ON n.batch = a.batch LEFT JOIN x ON x.batch = a.batch AND x.gene_id = a.gene_id AND x.target_gene = t.gene_id GROUP BY a.gene_id, t.gene_id"))
def pooled_within_covariance(spark, d):
    o = R.obs(spark, d).select("row_id", "batch")
    v = R.modules(spark, d).join(o, "row_id").withColumn("value", F.col("count").cast("double"))
    return moments.pooled_within(v, o, "batch", [1, 2]).withColumn("covariance", r("covariance"))


@query("between_state_covariance", sql("effects", body="SELECT a.gene_id, t.gene_id AS target_gene, round(covar_samp(a.value, t.value), 6) AS covariance FROM effects a JOIN effects t ON a.context = t.context AND a.target = t.target AND t.gene_id IN (1, 2) WHERE a.context = 'F' GROUP BY ALL"))
def between_state_covariance(spark, d):
    return moments.between_states(R.truth(spark, d), "target", [1, 2]).withColumn("covariance", r("covariance"))


@query("response_columns", sql("effects", c="SELECT a.gene_id, t.gene_id AS target_gene, covar_samp(a.value, t.value) AS c FROM effects a JOIN effects t ON a.context = t.context AND a.target = t.target AND t.gene_id IN (1, 2) WHERE a.context = 'F' GROUP BY ALL", body="SELECT c.gene_id, c.target_gene, round(CASE WHEN c.gene_id = c.target_gene THEN -1 ELSE -c.c / v.c END, 6) AS response FROM c JOIN c v ON v.gene_id = v.target_gene AND v.target_gene = c.target_gene"))
def response_columns(spark, d):
    return moments.response_columns(moments.between_states(R.truth(spark, d), "target", [1, 2])).withColumn("response", r("response"))


_RATES = dict(rt="SELECT row_id, gene_id, count, sum(count) OVER (PARTITION BY row_id) AS total, count / sum(count) OVER (PARTITION BY row_id) AS rate FROM modules", mr="SELECT gene_id, sum(rate) / (SELECT count(*) FROM orders) AS m FROM rt GROUP BY gene_id", sm="SELECT a.gene_id, t.gene_id AS target_gene, sum(CASE WHEN a.gene_id = t.gene_id THEN t.count * (t.count - 1) / (t.total * t.total)::DOUBLE ELSE a.rate * t.rate END) / (SELECT count(*) FROM orders) AS m2 FROM rt a JOIN rt t ON a.row_id = t.row_id AND t.gene_id IN (1, 2) GROUP BY ALL")


@query("factorial_moments", sql("modules", **_RATES, body="SELECT gene_id, target_gene, round(m2, 9) AS second_moment FROM sm"))
def factorial_moments(spark, d):
    return moments.factorial_moments(R.modules(spark, d), R.obs(spark, d).count(), [1, 2]).withColumn("second_moment", r("second_moment", 9))


@query("lognormal_columns", sql("modules", **_RATES, body="SELECT sm.gene_id, sm.target_gene, round(ln(m2 / (a.m * b.m)), 6) AS log_covariance FROM sm JOIN mr a ON a.gene_id = sm.gene_id JOIN mr b ON b.gene_id = sm.target_gene WHERE m2 > 0"))
def lognormal_columns(spark, d):
    m, n = R.modules(spark, d), R.obs(spark, d).count()
    out = moments.lognormal_columns(moments.factorial_moments(m, n, [1, 2]), moments.mean_rates(m, n))
    return out.where("log_covariance is not null").withColumn("log_covariance", r("log_covariance"))


@query("nb_dispersion", sql("modules", t="SELECT row_id, sum(count)::DOUBLE AS total FROM modules GROUP BY row_id", k="SELECT sum(total) AS t1, sum(total * total) AS t2 FROM t", g="SELECT gene_id, sum(count)::DOUBLE AS s, sum(count * count)::DOUBLE AS yy, sum(count * total) AS yt FROM modules JOIN t USING (row_id) GROUP BY gene_id", body="SELECT gene_id, round(greatest(0, (yy - 2 * s / t1 * yt + s / t1 * s / t1 * t2 - s) / (s / t1 * s / t1 * t2)), 6) AS dispersion FROM g, k"))
def nb_dispersion(spark, d):
    m = R.modules(spark, d)
    return moments.nb_dispersion(m, row_totals(m)).withColumn("dispersion", r("dispersion"))


@query("soft_threshold", sql("truth", body="SELECT target, gene_id, round(sign(value) * greatest(0, abs(value) - 0.2), 6) + 0 AS thresholded FROM truth"))
def soft_threshold(spark, d):
    return moments.soft_threshold(R.truth(spark, d).withColumn("se", F.lit(0.1)), "value", "se", 2.0).select("target", "gene_id", r("thresholded").alias("thresholded"))


@query("posterior_mean", sql("truth", body="SELECT target, gene_id, round(value * (0.7 * exp(-value * value / (2 * (0.01 + 0.04))) / sqrt(0.01 + 0.04) * 0.01 / (0.01 + 0.04) + 0.3 * exp(-value * value / (2 * (0.25 + 0.04))) / sqrt(0.25 + 0.04) * 0.25 / (0.25 + 0.04)) / (0.7 * exp(-value * value / (2 * (0.01 + 0.04))) / sqrt(0.01 + 0.04) + 0.3 * exp(-value * value / (2 * (0.25 + 0.04))) / sqrt(0.25 + 0.04)), 6) AS posterior_mean FROM (SELECT target, gene_id, value::DOUBLE AS value FROM truth)"))
def posterior_mean(spark, d):
    return moments.posterior_mean(R.truth(spark, d).withColumn("se", F.lit(0.2)), "value", "se", [0.1, 0.5], [0.7, 0.3]).select("target", "gene_id", r("posterior_mean").alias("posterior_mean"))


@query("quadratic_dose", "WITH x AS (SELECT l_partkey % 20 AS gene_id, l_suppkey % 10 AS grp, l_quantity / 50 AS a, l_quantity / 50 * l_quantity / 50 AS b, l_extendedprice / 1000 AS y FROM lineitem), c AS (SELECT gene_id, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, y - avg(y) OVER w AS y FROM x WINDOW w AS (PARTITION BY gene_id, grp)), s AS (SELECT gene_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS \"by\" FROM c GROUP BY gene_id) SELECT gene_id, round((ay * bb - \"by\" * ab) / (aa * bb - ab * ab), 4) AS b1, round((\"by\" * aa - ay * ab) / (aa * bb - ab * ab), 4) AS b2 FROM s")
def quadratic_dose(spark, d):
    x = R.table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("gene_id"), (F.col("l_suppkey") % 10).alias("grp"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 1000).alias("y"))
    return moments.quadratic_dose(x, "grp", "a", "y").select("gene_id", r("b1", 4).alias("b1"), r("b2", 4).alias("b2"))


@query("poisson_likelihood", sql("modules", "obs", t="SELECT row_id, sum(count)::DOUBLE AS total FROM modules GROUP BY row_id", m="SELECT o.target, m.gene_id, sum(count) AS n, sum(sum(count)) OVER (PARTITION BY o.target) AS tot FROM modules m JOIN obs o USING (row_id) GROUP BY o.target, m.gene_id", body="SELECT a.row_id, o.target AS \"group\", round(max(t.total) - sum(a.count * ln(m.n / m.tot * t.total)), 4) AS nll FROM modules a JOIN obs o USING (row_id) JOIN t USING (row_id) JOIN m ON m.target = o.target AND m.gene_id = a.gene_id GROUP BY a.row_id, o.target"))
def poisson_likelihood(spark, d):
    o = R.obs(spark, d).select("row_id", F.col("target").alias("group"))
    c = R.modules(spark, d).join(o, "row_id")
    m = c.groupBy("group", "gene_id").agg(F.sum("count").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("group"))).drop("n")
    return moments.poisson_log_likelihood(c, m, row_totals(R.modules(spark, d)).select("row_id", F.col("total").cast("double").alias("total"))).select("row_id", "group", r("nll", 4).alias("nll"))


@query("principal_components", None)
def principal_components(spark, d):
    e = R.table(spark, d, "embeddings")
    _, directions = moments.gram_eigen(e, "vec_id", "embedding", 8)
    return moments.project_components(e, "vec_id", "embedding", directions)


@query("latent_components", None)
def latent_components(spark, d):
    """Scores of all cells in a rank-2 Poisson-lognormal model of the module counts, fitted to its tolerance."""
    v = latent.cell_vectors(R.modules(spark, d)).persist()  # read once a round
    mu, w, _ = latent.fit(v, 60, 2, rounds=10_000)
    return latent.cell_scores(v, mu, w)


@query("cosine_blocked", sql("prediction", "truth", c=_SIM, body="SELECT i, j, round(s, 6) AS cosine FROM c"))
def cosine_blocked(spark, d):
    p = effects.pair_scores_blocked(R.prediction(spark, d), R.truth(spark, d), block=16)
    return p.select("i", "j", r(effects.cosine_of("dot", "norm_i", "norm_j")).alias("cosine"))
