"""The registered queries on clusters, effort and experience, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded as r
from ..functions.numeric import rounded_signed as rs
from ..operators import activity, clustering, code, coupling, effort, experience, knowledge
from ..sources import made, star
from ..sources.star import DAYS, NOW
from . import oracle
from .oracle import rounded, signed

#: Scaled centroids that the SQL-checked cluster queries assign to.
CENTROIDS = [[0.1, 0.1, 0.9], [0.6, 0.6, 0.5], [0.2, 0.3, 0.4], [0.9, 0.9, 0.9]]


def windowed(spark: SparkSession, d: str) -> DataFrame:
    return activity.in_window(star.changes(spark, d), NOW, DAYS)


def features(spark: SparkSession, d: str) -> DataFrame:
    return clustering.commit_features(windowed(spark, d))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return clustering.assigned(clustering.normalized(features(spark, d)), CENTROIDS)


def named(spark: SparkSession, d: str) -> DataFrame:
    return clustering.summaries(placed(spark, d), CENTROIDS)


def silhouette(spark: SparkSession, d: str) -> DataFrame:
    scaled = clustering.normalized(features(spark, d))
    points, counts, _ = clustering.triples(scaled)
    import numpy as np

    score = clustering.silhouette(points, counts, clustering.nearest(points, np.array(CENTROIDS)))
    return spark.createDataFrame([(round(float(score), 4),)], "silhouette_score double")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means over all commits: the best k, its silhouette, and each cluster."""
    found = clustering.clusters(star.changes(spark, d), NOW, DAYS)
    return found["summaries"].withColumns({"k": F.lit(found["k"]), "silhouette_score": F.lit(found["silhouette"])})


def kmeans_drift(spark: SparkSession, d: str) -> DataFrame:
    return clustering.clusters(star.changes(spark, d), NOW, DAYS)["drift"]


def effort_rows(spark: SparkSession, d: str) -> DataFrame:
    log = star.changes(spark, d)
    hot = activity.hotspots(log, star.sizes(spark, d), NOW, DAYS)
    rows = effort.features(hot, knowledge.files(log, NOW, DAYS), coupling.pain(log, coupling.pairs(log, NOW, DAYS), NOW, DAYS))
    return effort.proxy(rows, activity.commit_density(log, NOW, DAYS))


def scaled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features, proxy and scaled features; kept, as fitting and scoring both read it."""
    return effort.scaled(effort_rows(spark, d), effort.NAMES).persist()


def fitted(spark: SparkSession, d: str):
    rows = scaled_rows(spark, d)
    return rows, *effort.fit(rows)


def effort_features(spark: SparkSession, d: str) -> DataFrame:
    return effort_rows(spark, d).select("file_path", *(r(F.col(c), 8).alias(c) for c in effort.NAMES))


def effort_proxy(spark: SparkSession, d: str) -> DataFrame:
    return effort_rows(spark, d).select("file_path", r(F.col("commit_density")).alias("commit_density"), "rework_ratio", r(F.col("proxy")).alias("proxy_label"))


def ridge_normal_equations(spark: SparkSession, d: str) -> DataFrame:
    sums = effort.normal_equations(scaled_rows(spark, d))
    return sums.select(*(r(F.col(c), 6).alias(c) for c in sums.columns if c[0] in "xy"), "n")


def ridge_coefficients(spark: SparkSession, d: str) -> DataFrame:
    _, alpha, beta, _ = fitted(spark, d)
    return spark.createDataFrame([(n, i, float(b), alpha) for i, (n, b) in enumerate(zip(effort.NAMES, beta, strict=True))], "feature_name string, place int, b double, alpha double").select("feature_name", "place", "alpha", rs(F.col("b"), 4).alias("coefficient"))


def effort_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = scaled_rows(spark, d)
    sums = effort.normal_equations(rows).first().asDict()
    scores = effort.r_squared(rows, [effort.solve(sums, a) for a in effort.ALPHAS])
    return spark.createDataFrame(list(zip(map(float, effort.ALPHAS), map(float, scores), strict=True)), "alpha double, s double").select("alpha", rs(F.col("s")).alias("r_squared"))


def effort_r2(spark: SparkSession, d: str) -> DataFrame:
    _, alpha, _, score = fitted(spark, d)
    return spark.createDataFrame([(alpha, float(score))], "alpha double, s double").select("alpha", rs(F.col("s")).alias("model_r_squared"))


def effort_files(spark: SparkSession, d: str) -> DataFrame:
    rows, _, beta, _ = fitted(spark, d)
    return effort.files(rows, beta)


def effort_attributions(spark: SparkSession, d: str) -> DataFrame:
    rows, _, beta, _ = fitted(spark, d)
    each = effort.attributions(rows, beta)
    return each.select("file_path", "feature_name", r(F.col("raw_value"), 6).alias("raw_value"), rs(F.col("contribution"), 4).alias("contribution"))


def complexity(spark: SparkSession, d: str) -> DataFrame:
    """Per part: the made Python file's complexity, under the part's number."""
    per = code.file_complexity(code.functions(code.parsed(code.sources(made.tree(spark, d)).where("lang = 'python'"), ("functions",))))
    return per.withColumn("file_path", F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint"))


def load(spark: SparkSession, d: str) -> DataFrame:
    log = star.changes(spark, d)
    pained = coupling.pain(log, coupling.pairs(log, NOW, DAYS), NOW, DAYS)
    return experience.cognitive_load(activity.hotspots(log, star.sizes(spark, d), NOW, DAYS), knowledge.files(log, NOW, DAYS), pained, complexity(spark, d))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    log = star.changes(spark, d)
    return experience.feedback(activity.hotspots(log, star.sizes(spark, d), NOW, DAYS), activity.commit_density(log, NOW, DAYS))


def dx_report(spark: SparkSession, d: str) -> DataFrame:
    log = star.changes(spark, d)
    hot = activity.hotspots(log, star.sizes(spark, d), NOW, DAYS)
    return experience.report(activity.total_commits(log, NOW, DAYS), named(spark, d), hot, activity.commit_density(log, NOW, DAYS), load(spark, d), DAYS)


SCALED = ["n_file_count", "n_total_churn", "n_add_ratio"]

QUERIES = {
    "commit_features": features,
    "minmax_commits": lambda s, d: clustering.normalized(features(s, d)).select("commit_hash", *(r(F.col(c), 6).alias(c) for c in SCALED)),
    "kmeans_assign": lambda s, d: placed(s, d).select("commit_hash", "cluster"),
    "label_clusters": named,
    "cluster_drift": lambda s, d: clustering.drift(placed(s, d), named(s, d), NOW, DAYS),
    "silhouette": silhouette,
    "clusters": clusters,
    "kmeans_drift": kmeans_drift,
    "effort_features": effort_features,
    "effort_proxy": effort_proxy,
    "ridge_normal_equations": ridge_normal_equations,
    "ridge_coefficients": ridge_coefficients,
    "effort_grid": effort_grid,
    "effort_r2": effort_r2,
    "effort_rei": lambda s, d: effort_files(s, d).select("file_path", "rei_score"),
    "effort_files": effort_files,
    "effort_attributions": effort_attributions,
    "all_paths": lambda s, d: load(s, d).select("file_path"),
    "cognitive_load": load,
    "dx_throughput": lambda s, d: experience.throughput(named(s, d), DAYS),
    "dx_feedback": feedback,
    "dx_focus": lambda s, d: experience.focus(named(s, d)),
    "dx_report": dx_report,
}


def _distance(c: list[float]) -> str:
    return "sqrt(" + " + ".join(f"(n_{n} - {v}) * (n_{n} - {v})" for n, v in zip(clustering.FEATURES, c, strict=True)) + ")"


def _cluster_sql() -> str:
    far = "[" + ", ".join(map(_distance, CENTROIDS)) + "]"
    scaled = ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN CAST({c} - min({c}) OVER () AS DOUBLE) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END AS n_{c}" for c in clustering.FEATURES)
    held = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(CENTROIDS))
    span = ", ".join(f"(CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS n_{c}" for c in clustering.FEATURES)
    middle = f"(epoch_us(TIMESTAMP '{NOW}') - {DAYS} * 86400000000 // 2)"
    return f"""WITH {oracle.log()},
cf0 AS (SELECT commit_hash, min(date) AS date, count(DISTINCT file_path) AS file_count, CAST(sum(churn) AS BIGINT) AS total_churn, sum(lines_added) AS added FROM w GROUP BY commit_hash),
cf AS (SELECT commit_hash, date, file_count, total_churn, CASE WHEN total_churn > 0 THEN {rounded('CAST(added AS DOUBLE) / total_churn')} ELSE 0.0 END AS add_ratio FROM cf0),
cn AS (SELECT *, {scaled} FROM cf),
ca AS (SELECT *, list_position({far}, list_min({far})) - 1 AS cluster FROM cn),
held(cluster, file_count, total_churn, add_ratio) AS (VALUES {held}),
hn AS (SELECT *, {span} FROM held),
lab AS (SELECT *, CASE WHEN n_add_ratio >= 0.6 AND n_total_churn >= 0.5 THEN 'feature' WHEN n_total_churn < 0.3 AND n_file_count < 0.3 THEN CASE WHEN n_add_ratio < 0.6 THEN 'config' ELSE 'bugfix' END
  WHEN n_file_count >= 0.5 AND n_add_ratio >= 0.3 AND n_add_ratio < 0.6 THEN 'refactoring' ELSE 'mixed' END AS label FROM hn),
summ AS (SELECT cluster AS cluster_id, label, count(*) AS size, {', '.join(f"any_value({rounded(f'lab.{c}', 6)}) AS centroid_{c}" for c in clustering.FEATURES)} FROM ca JOIN lab USING (cluster) GROUP BY cluster, label),
half AS (SELECT cluster, count(*) FILTER (epoch_us(date) < {middle}) AS a, count(*) FILTER (epoch_us(date) >= {middle}) AS b FROM ca GROUP BY cluster),
pct AS (SELECT cluster, CAST(a AS DOUBLE) / sum(a) OVER () * 100 AS a, CAST(b AS DOUBLE) / sum(b) OVER () * 100 AS b FROM half),
drift AS (SELECT cluster AS cluster_id, label AS cluster_label, {rounded('a', 1)} AS first_half_pct, {rounded('b', 1)} AS second_half_pct, {signed('b - a', 1)} AS drift FROM pct JOIN lab USING (cluster)),
through AS (SELECT {rounded("least(1.0, sum(size * CASE label WHEN 'feature' THEN 1.0 WHEN 'bugfix' THEN 0.8 WHEN 'config' THEN 0.3 ELSE 0.5 END) / " + str(DAYS * 10.0) + ")")} AS throughput FROM summ),
foc AS (SELECT {rounded("coalesce(CAST(sum(size) FILTER (label = 'feature') AS DOUBLE), 0.0) / nullif(sum(size) FILTER (label <> 'mixed'), 0)")} AS focus_ratio FROM summ)"""


def _effort_sql() -> str:
    names = effort.NAMES
    z = ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END AS z{i}" for i, c in enumerate(names))
    mm = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END"
    sums = ", ".join([f"sum(z{i} * z{j}) AS x{i}{j}" for i in range(6) for j in range(i, 6)] + [f"sum(z{i} * proxy) AS y{i}" for i in range(6)])
    steps = ["m0 AS (SELECT alpha, " + ", ".join(f"x{min(i, j)}{max(i, j)}{' + alpha' if i == j else ''} AS a{i}{j}" for i in range(6) for j in range(6)) + ", " + ", ".join(f"y{i} AS a{i}6" for i in range(6)) + " FROM ne, (VALUES (0.1), (0.5), (1.0), (2.0), (5.0)) v(alpha))"]
    for p in range(6):
        cells = ", ".join(f"a{p}{j} / a{p}{p} AS a{p}{j}" if i == p else f"a{i}{j} - a{i}{p} * (a{p}{j} / a{p}{p}) AS a{i}{j}" for i in range(6) for j in range(7))
        steps.append(f"m{p + 1} AS (SELECT alpha, {cells} FROM m{p})")
    dot = " + ".join(f"z{i} * a{i}6" for i in range(6))
    return f"""WITH {oracle.log()}, {oracle.hot()}, {oracle.KNOW}, {oracle.COUPLE}, {oracle.DENSITY},
fe0 AS (SELECT hot.file_path, rework_ratio, coalesce(commit_density, 1.0) AS commit_density, CAST(code_churn AS DOUBLE) AS code_churn, CAST(change_frequency AS DOUBLE) AS change_frequency, coalesce(pain_score, 0.0) AS pain_score,
  coalesce(knowledge_concentration, 0.0) AS knowledge_concentration, CAST(coalesce(author_count, 1) AS DOUBLE) AS author_count FROM hot LEFT JOIN know USING (file_path) LEFT JOIN pain USING (file_path) LEFT JOIN dens USING (file_path)),
fe AS (SELECT *, knowledge_concentration * pain_score AS knowledge_x_pain, 0.5 * {mm('commit_density')} + 0.5 * {mm('rework_ratio')} AS proxy FROM fe0),
fz AS (SELECT *, {z} FROM fe),
ne AS (SELECT {sums}, count(*) AS n FROM fz),
{', '.join(steps)},
r2 AS (SELECT alpha, 1.0 - sum((proxy - ({dot})) * (proxy - ({dot}))) / any_value(tot) AS r2 FROM fz, m6, (SELECT sum((proxy - m) * (proxy - m)) AS tot FROM fz, (SELECT avg(proxy) AS m FROM fz)) GROUP BY alpha),
best AS (SELECT arg_max(alpha, (r2, -alpha)) AS alpha, max(r2) AS r2 FROM r2),
co AS (SELECT m6.* FROM m6 JOIN best ON m6.alpha = best.alpha),
raw1 AS (SELECT fz.*, {dot} AS raw FROM fz, co),
rei AS (SELECT file_path, {rounded('(raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ())')} AS rei_score, {rounded('proxy')} AS proxy_label, {rounded('commit_density')} AS commit_density, {rounded('rework_ratio')} AS rework_ratio FROM raw1)"""


def oracle_sql() -> dict[str, str]:
    from .trees import BASE

    c, e = _cluster_sql(), _effort_sql()
    names = effort.NAMES
    mm = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END"
    fc = BASE.replace("WITH p AS", "p AS", 1).replace("target AS", "ctarget AS", 1).replace("JOIN target t", "JOIN ctarget t", 1).replace("\ntouch AS (", "\nctouch AS (", 1).replace("\nf AS (", "\nfun AS (", 1).replace("\nc AS (", "\nccc AS (", 1)
    sides = f""", {fc}, cx AS (SELECT CAST(regexp_extract(file_path, '([0-9]+)', 1) AS BIGINT) AS file_path, {rounded('avg(cognitive_complexity)', 2)} AS v FROM fun WHERE lang = 'python' GROUP BY 1),
st AS (SELECT file_path, v AS complexity, 0.0 AS coordination, 0.0 AS knowledge, 0.0 AS change_rate FROM cx UNION ALL SELECT file_path, 0.0, distance_normalized, 0.0, 0.0 FROM pain
  UNION ALL SELECT file_path, 0.0, 0.0, knowledge_concentration, 0.0 FROM know UNION ALL SELECT file_path, 0.0, 0.0, 0.0, change_frequency FROM hot),
sg AS (SELECT file_path, sum(complexity) AS complexity, sum(coordination) AS coordination, sum(knowledge) AS knowledge, sum(change_rate) AS change_rate FROM st GROUP BY file_path),
sn AS (SELECT file_path, {', '.join(f'{mm(n)} AS {n}' for n in experience.LOAD)} FROM sg),
cl AS (SELECT file_path, {', '.join(f'{rounded(n)} AS {n}_score' for n in experience.LOAD)}, {rounded(' + '.join(f'{n} * {w}' for n, w in experience.LOAD.items()))} AS composite_load FROM sn),
fb AS (SELECT {rounded('avg(coalesce(commit_density, 1.0)) * (1.0 - avg(rework_ratio))')} AS feedback_delay FROM hot LEFT JOIN dens USING (file_path))"""
    dx = c + ", " + oracle.hot() + ", " + oracle.KNOW + ", " + oracle.COUPLE + ", " + oracle.DENSITY + sides
    return {
        "commit_features": c + " SELECT * FROM cf",
        "minmax_commits": c + " SELECT commit_hash, " + ", ".join(f"{rounded(x, 6)} AS {x}" for x in SCALED) + " FROM cn",
        "kmeans_assign": c + " SELECT commit_hash, cluster FROM ca",
        "label_clusters": c + " SELECT * FROM summ",
        "cluster_drift": c + " SELECT *, CASE WHEN abs(drift) < 5.0 THEN 'stable' WHEN drift >= 5.0 THEN 'growing' ELSE 'shrinking' END AS trend FROM drift",
        "silhouette": c
        + f""", tri AS (SELECT n_file_count AS a, n_total_churn AS b, n_add_ratio AS c, cluster, count(*) AS m FROM ca GROUP BY ALL),
far AS (SELECT x.a, x.b, x.c, x.cluster, any_value(x.m) AS m, y.cluster AS other, sum(y.m * sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c))) AS d, sum(y.m) AS n FROM tri x, tri y GROUP BY x.a, x.b, x.c, x.cluster, y.cluster),
ab AS (SELECT a, b, c, any_value(m) AS m, max(CASE WHEN other = cluster THEN CASE WHEN n > 1 THEN d / (n - 1) ELSE 0.0 END END) AS own, min(CASE WHEN other <> cluster THEN d / n END) AS near FROM far GROUP BY a, b, c, cluster)
SELECT {signed('sum(m * CASE WHEN greatest(own, near) > 0 THEN (near - own) / greatest(own, near) ELSE 0.0 END) / sum(m)')} AS silhouette_score FROM ab""",
        "effort_features": e + " SELECT file_path, " + ", ".join(f"{rounded(n, 8)} AS {n}" for n in names) + " FROM fe",
        "effort_proxy": e + f" SELECT file_path, {rounded('commit_density')} AS commit_density, rework_ratio, {rounded('proxy')} AS proxy_label FROM fe",
        "ridge_normal_equations": e + " SELECT " + ", ".join(f"{rounded(f'x{i}{j}', 6)} AS x{i}{j}" for i in range(6) for j in range(i, 6)) + ", " + ", ".join(f"{rounded(f'y{i}', 6)} AS y{i}" for i in range(6)) + ", n FROM ne",
        "ridge_coefficients": e + " " + " UNION ALL ".join(f"SELECT '{n}' AS feature_name, {i} AS place, CAST(alpha AS DOUBLE) AS alpha, {signed(f'a{i}6')} AS coefficient FROM co" for i, n in enumerate(names)),
        "effort_grid": e + f" SELECT CAST(alpha AS DOUBLE) AS alpha, {signed('r2')} AS r_squared FROM r2",
        "effort_r2": e + f" SELECT CAST(alpha AS DOUBLE) AS alpha, {signed('r2')} AS model_r_squared FROM best",
        "effort_rei": e + " SELECT file_path, rei_score FROM rei",
        "effort_files": e + " SELECT * FROM rei",
        "effort_attributions": e + " " + " UNION ALL ".join(f"SELECT file_path, '{n}' AS feature_name, {rounded(n, 6)} AS raw_value, {signed(signed(f'z{i} * a{i}6', 6))} AS contribution FROM fz, co" for i, n in enumerate(names)),
        "all_paths": dx + " SELECT file_path FROM cl",
        "cognitive_load": dx + " SELECT * FROM cl",
        "dx_throughput": c + " SELECT * FROM through",
        "dx_feedback": dx + " SELECT * FROM fb",
        "dx_focus": c + " SELECT coalesce(focus_ratio, 0.5) AS focus_ratio FROM foc",
        "dx_report": dx
        + f""", load1 AS (SELECT {rounded('avg(composite_load)')} AS cognitive_load FROM cl)
SELECT (SELECT count(DISTINCT commit_hash) FROM w) AS total_commits, (SELECT count(*) FROM hot) AS total_files, throughput, feedback_delay, coalesce(focus_ratio, 0.5) AS focus_ratio, cognitive_load,
  {rounded('throughput * 0.3 + feedback_delay * 0.25 + coalesce(focus_ratio, 0.5) * 0.25 + (1.0 - cognitive_load) * 0.2')} AS dx_score FROM through, fb, foc, load1""",
    }
