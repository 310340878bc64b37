"""ANSI SQL for DuckDB: the same analyses over the same tables, as common table expressions."""

from __future__ import annotations

from ..sources.star import DAYS, NOW


def rounded(x: str, digits: int = 4) -> str:
    return f"(CAST(floor(({x}) * {float(10**digits)} + 0.5) AS DOUBLE) / {float(10**digits)})"


def signed(x: str, digits: int = 4) -> str:
    return f"(sign({x}) * {rounded(f'abs({x})', digits)})"


def log(now: str = NOW, days: int = DAYS, suffix: str = "") -> str:
    """changes and windowed rows."""
    return f"""changes AS (
  SELECT l_orderkey AS commit_hash, CAST(o_orderdate AS TIMESTAMP) AS date, l_partkey AS file_path, CAST(l_quantity AS BIGINT) AS lines_added,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS lines_deleted, o_custkey AS author_email, c_name AS author_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
sizes AS (SELECT p_partkey AS file_path, CAST(p_size AS BIGINT) AS file_size FROM part WHERE p_partkey % 10 <> 0),
""" + windowed(now, days, suffix)


def age(now: str) -> str:
    return f"((epoch_us(TIMESTAMP '{now}') - epoch_us(date)) / 86400000000.0)"


def windowed(now: str = NOW, days: int = DAYS, suffix: str = "") -> str:
    return f"""w{suffix} AS (SELECT *, lines_added + lines_deleted AS churn, pow(2.0, -{age(now)} / 30.0) AS w30, pow(2.0, -{age(now)} / 90.0) AS w90
  FROM changes WHERE date >= TIMESTAMP '{now}' - INTERVAL {days} DAY AND date <= TIMESTAMP '{now}')"""


def hot(s: str = "") -> str:
    return f"""touch{s} AS (SELECT file_path, commit_hash, min(date) AS date, sum(churn) AS churn, max(w30) AS weight, sum(churn * w30) AS wchurn FROM w{s} GROUP BY ALL),
gap{s} AS (SELECT *, CASE WHEN epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY file_path ORDER BY date, commit_hash) <= 14 * 86400000000 THEN 1 ELSE 0 END AS again FROM touch{s}),
act{s} AS (SELECT file_path, count(*) AS change_frequency, CAST(sum(churn) AS BIGINT) AS code_churn, sum(weight) AS wfreq, sum(wchurn) AS wchurn, CAST(sum(again) AS DOUBLE) / count(*) AS rework FROM gap{s} GROUP BY file_path),
rel{s} AS (SELECT act{s}.*, coalesce(file_size, 0) AS file_size, CASE WHEN coalesce(file_size, 0) > 0 THEN wchurn / file_size ELSE wchurn END AS relative FROM act{s} LEFT JOIN sizes USING (file_path)),
hot{s} AS (SELECT file_path, change_frequency, code_churn, {rounded('(wfreq / max(wfreq) OVER ()) * (CASE WHEN max(relative) OVER () > 0 THEN relative / max(relative) OVER () ELSE 0.0 END)')} AS hotspot_score,
  {rounded('rework')} AS rework_ratio, file_size FROM rel{s})"""


KNOW = f"""au AS (SELECT file_path, author_email, count(*) AS change_count, CAST(sum(churn) AS BIGINT) AS total_churn, sum(churn * w90) AS wc FROM w GROUP BY ALL),
con AS (SELECT file_path, author_email, change_count, total_churn,
  CASE WHEN sum(total_churn) OVER f > 0 THEN {rounded('CAST(total_churn AS DOUBLE) / sum(total_churn) OVER f')} ELSE 0.0 END AS proportion,
  CASE WHEN sum(wc) OVER f > 0 THEN {rounded('wc / sum(wc) OVER f')} ELSE 0.0 END AS weighted_proportion FROM au WINDOW f AS (PARTITION BY file_path)),
kn AS (SELECT file_path, count(*) AS author_count, sum(CASE WHEN weighted_proportion > 0 THEN -weighted_proportion * log2(weighted_proportion) ELSE 0 END) AS entropy,
  max(proportion) AS primary_author_pct, arg_min(author_email, (-proportion, author_email)) AS primary_author FROM con GROUP BY file_path),
know AS (SELECT file_path, CASE WHEN author_count <= 1 THEN 1.0 ELSE {signed('1.0 - entropy / log2(author_count)')} END AS knowledge_concentration, primary_author, primary_author_pct,
  primary_author_pct > 0.8 AS is_knowledge_island, author_count FROM kn)"""

COUPLE = f"""t AS (SELECT commit_hash, file_path, max(w30) AS weight FROM w GROUP BY ALL),
pf AS (SELECT file_path, count(*) AS c, sum(weight) AS ws FROM t GROUP BY file_path),
n AS (SELECT count(DISTINCT commit_hash) AS n FROM t),
ps AS (SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS shared_commits, sum(a.weight) AS ws FROM t a JOIN t b ON a.commit_hash = b.commit_hash AND a.file_path < b.file_path GROUP BY ALL HAVING count(*) >= 2),
cand AS (SELECT file_a, file_b, shared_commits, n AS total_commits, {rounded('ps.ws / (x.ws + y.ws - ps.ws)')} AS coupling_strength, {rounded('CAST(shared_commits AS DOUBLE) / n')} AS support,
  {rounded('(CAST(x.c AS DOUBLE) / n) * (CAST(y.c AS DOUBLE) / n) * n')} AS expected_cochange, {rounded('CAST(shared_commits AS DOUBLE) / ((CAST(x.c AS DOUBLE) / n) * (CAST(y.c AS DOUBLE) / n) * n)')} AS lift
  FROM ps JOIN pf x ON x.file_path = file_a JOIN pf y ON y.file_path = file_b, n),
pairs AS (SELECT * FROM cand WHERE lift > 1.0),
ends AS (SELECT file_a AS file_path, coupling_strength FROM pairs UNION ALL SELECT file_b, coupling_strength FROM pairs),
dist AS (SELECT file_path, {rounded('avg(coupling_strength)')} AS distance_raw FROM ends GROUP BY file_path),
raw AS (SELECT file_path, CAST(sum(churn) AS BIGINT) AS size_raw, count(DISTINCT commit_hash) AS volatility_raw FROM w GROUP BY file_path),
rawd AS (SELECT raw.*, coalesce(distance_raw, 0.0) AS distance_raw FROM raw LEFT JOIN dist USING (file_path)),
norm AS (SELECT *, {rounded('CAST(size_raw AS DOUBLE) / max(size_raw) OVER ()')} AS size_normalized, {rounded('CAST(volatility_raw AS DOUBLE) / max(volatility_raw) OVER ()')} AS volatility_normalized,
  CASE WHEN max(distance_raw) OVER () > 0 THEN {rounded('distance_raw / max(distance_raw) OVER ()')} ELSE 0.0 END AS distance_normalized FROM rawd),
pain AS (SELECT *, {rounded('size_normalized * volatility_normalized * distance_normalized')} AS pain_score FROM norm)"""

DENSITY = """gaps AS (SELECT file_path, (epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY file_path ORDER BY date)) / 86400000000.0 AS gap FROM w),
dens AS (SELECT file_path, coalesce(1.0 / (1.0 + median(gap)), 1.0) AS commit_density FROM gaps GROUP BY file_path)"""


def compared() -> str:
    return f"""{windowed('2000-08-01', DAYS, '0')}, {hot('0')}, {hot()},
cmp AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.hotspot_score, 0.0) AS from_score, coalesce(b.hotspot_score, 0.0) AS to_score,
  coalesce(a.code_churn, 0) AS from_churn, coalesce(b.code_churn, 0) AS to_churn, coalesce(a.change_frequency, 0) AS from_frequency, coalesce(b.change_frequency, 0) AS to_frequency,
  a.file_path IS NULL AS is_new, b.file_path IS NULL AS is_removed FROM hot0 a FULL JOIN hot b ON a.file_path = b.file_path),
delta AS (SELECT *, {signed('to_score - from_score')} AS score_delta, to_churn - from_churn AS churn_delta, to_frequency - from_frequency AS frequency_delta FROM cmp),
comparison AS (SELECT * EXCLUDE (is_new, is_removed), CASE WHEN is_new THEN 'new' WHEN is_removed THEN 'removed' WHEN score_delta > 0 THEN 'degraded' WHEN score_delta < 0 THEN 'improved' ELSE 'unchanged' END AS status FROM delta)"""


def history() -> dict[str, str]:
    """SQL of the queries over the change log, by name."""
    base = "WITH " + log() + ",\n"
    h, k, c, d = base + hot(), base + KNOW, base + COUPLE, base + DENSITY
    both = base + compared()
    return {
        "scan_changes": "WITH " + log() + " SELECT commit_hash, date, file_path, lines_added, lines_deleted, author_email, author_name FROM changes",
        "scan_sizes": "WITH " + log() + " SELECT * FROM sizes",
        "repo_summary": "WITH " + log() + " SELECT count(DISTINCT commit_hash) AS commit_count, min(date) AS first_commit_date, max(date) AS last_commit_date FROM changes",
        "window_filter": "WITH " + log() + " SELECT commit_hash, date, file_path, lines_added, lines_deleted, author_email FROM w",
        "decay_weights": "WITH " + log() + f" SELECT DISTINCT date, {rounded('w30')} AS weight_30, {rounded('w90')} AS weight_90 FROM w",
        "total_commits": "WITH " + log() + " SELECT count(DISTINCT commit_hash) AS total_commits FROM w",
        "file_activity": h + f" SELECT file_path, change_frequency, code_churn, {rounded('wfreq')} AS weighted_frequency, {rounded('wchurn')} AS weighted_churn FROM act",
        "rework_ratio": h + f" SELECT file_path, {rounded('rework')} AS rework_ratio FROM act",
        "hotspots": h + " SELECT * FROM hot",
        "top_hotspots": h + " SELECT * FROM hot ORDER BY hotspot_score DESC, file_path LIMIT 20",
        "effort_distribution": h
        + """, run AS (SELECT row_number() OVER o AS place, sum(code_churn) OVER (o ROWS UNBOUNDED PRECEDING) AS s, sum(code_churn) OVER () AS total FROM hot WINDOW o AS (ORDER BY hotspot_score DESC, file_path))
SELECT threshold, min(place) AS file_count FROM run, (VALUES (50), (80), (90)) v(threshold) WHERE CAST(s AS DOUBLE) / total * 100 >= threshold GROUP BY threshold""",
        "author_contributions": k + " SELECT * FROM con",
        "author_names": "WITH " + log() + " SELECT author_email, arg_max(author_name, (date, commit_hash, author_name)) AS author_name FROM changes GROUP BY author_email",
        "knowledge_kdi": k + " SELECT file_path, knowledge_concentration, author_count FROM know",
        "knowledge_files": k + " SELECT * FROM know",
        "knowledge_authors": k + " SELECT file_path, list({'author_email': author_email, 'change_count': change_count, 'total_churn': total_churn, 'proportion': proportion, 'weighted_proportion': weighted_proportion} ORDER BY proportion DESC, author_email) AS authors FROM con GROUP BY file_path",
        "knowledge_islands": k + " SELECT count(*) FILTER (is_knowledge_island) AS knowledge_island_count FROM know",
        "author_gini": "WITH " + log()
        + f""", s AS (SELECT author_email, sum(churn) AS x FROM w GROUP BY author_email), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM s)
SELECT {signed('(2.0 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x))')} AS developer_risk_index FROM r""",
        "coupling_pairs": c + " SELECT * FROM pairs",
        "coupling_distance": c + " SELECT * FROM dist",
        "file_pain": c + " SELECT * FROM pain",
        "compare_hotspots": both + " SELECT * FROM comparison",
        "compare_counts": both + " SELECT count(*) FILTER (status = 'new') AS new_hotspot_count, count(*) FILTER (status = 'removed') AS removed_hotspot_count, count(*) FILTER (status = 'improved') AS improved_count, count(*) FILTER (status = 'degraded') AS degraded_count FROM comparison",
        "new_files": both + " SELECT file_path FROM comparison WHERE status = 'new'",
        "removed_files": both + " SELECT file_path FROM comparison WHERE status = 'removed'",
        "kept_files": both + " SELECT a.file_path FROM hot0 a SEMI JOIN hot b ON a.file_path = b.file_path",
        "commit_density": d + f" SELECT file_path, {rounded('commit_density')} AS commit_density FROM dens",
    }
