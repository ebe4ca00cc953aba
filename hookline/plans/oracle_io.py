"""Oracle statements for the files and for the rules as a model."""

from __future__ import annotations

from hookline.fixed import CUSTOM_POSITIVE_LABELS, INDICATOR_RULES
from hookline.functions.url import PY_STRIP
from hookline.plans.oracle import _q, _with, corpus_ctes, full_ctes, local_ctes
from hookline.plans.oracle_more import FEATS, IND_SUM, N_RULES, RULE_THRESHOLD, ZEROED, _rule_sql, folds_ctes, url_events_ctes

P1 = f"(CAST({IND_SUM} AS DOUBLE) / CAST({N_RULES} AS DOUBLE))"
FIRED = f"({IND_SUM}) >= {RULE_THRESHOLD}"
VERDICT = (f"CASE WHEN error IS NULL THEN {FIRED} END AS is_phishing, CASE WHEN error IS NULL THEN greatest(1.0::DOUBLE - {P1}, {P1}) END AS confidence, "
           f"CASE WHEN error IS NULL THEN {P1} END AS phishing_probability")


def statements() -> dict[str, str]:
    full = _with(corpus_ctes(), full_ctes("url_corpus"))
    positive = ", ".join(_q(x) for x in CUSTOM_POSITIVE_LABELS)
    out = {}
    out["custom_dataset"] = _with(corpus_ctes(), f"""cu AS (SELECT id, coalesce(url, 'nan') AS url,
  CAST(CASE WHEN lower(label_text) IN ({positive}) THEN 1 ELSE 0 END AS INTEGER) AS label FROM url_corpus)""", full_ctes("cu", registry=False, certificates=False)) + f"""
SELECT url, label, {ZEROED} FROM full_"""
    out["uci_datasets"] = _with(corpus_ctes(), local_ctes("url_corpus")) + """,
u AS (SELECT coalesce(url_length, 0)::DOUBLE AS url_length, coalesce(dot_count, 0)::DOUBLE AS dot_count, coalesce(has_https, 0)::DOUBLE AS has_https,
  CASE WHEN id % 5 <> 0 AND label = 1 THEN 1 ELSE 0 END::INTEGER AS label FROM local)
SELECT 'csv' AS file, * FROM u UNION ALL SELECT 'arff', * FROM u"""
    strip = f"regexp_replace(url, {_q(PY_STRIP)}, '', 'g')"
    out["url_list"] = _with(corpus_ctes()) + f"""
SELECT {strip} AS url FROM url_corpus WHERE {strip} <> ''"""
    out["json_results"] = full + f"""
SELECT id, url, {VERDICT}, error FROM full_"""
    out["feature_records"] = full + f"""
SELECT id, {FEATS}, closest_brand FROM full_"""
    out["metrics_json"] = _with(folds_ctes()) + """,
per AS (SELECT fold, CAST(count_if(label = prediction) AS DOUBLE) / count(*) AS accuracy FROM folds GROUP BY fold),
c AS (SELECT count(*) AS n, count_if(label = 1 AND prediction = 1) AS tp, count_if(label <> 1 AND prediction = 1) AS fp, count_if(label = 1 AND prediction <> 1) AS fn FROM folds)
SELECT (n - fp - fn)::DOUBLE / n AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1_score,
  (SELECT round(avg(accuracy), 9) FROM per) AS cv_mean_accuracy, (SELECT round(stddev_pop(accuracy), 9) FROM per) AS cv_std_accuracy FROM c"""
    out["rule_batch_score"] = _with(corpus_ctes(), url_events_ctes(), "ue AS (SELECT event_id AS id, url FROM url_events)", full_ctes("ue")) + f"""
SELECT id AS event_id, url, {VERDICT}, error FROM full_"""
    out["rule_score_with_features"] = full + f"""
SELECT id, {VERDICT}, {FEATS}, closest_brand, error FROM full_"""
    out["rule_status_lines"] = full + f"""
SELECT url, CASE WHEN error IS NOT NULL THEN 'ERROR    ' || coalesce(left(url, 50), 'null') || '... (' || error || ')'
  ELSE CASE WHEN {FIRED} THEN 'PHISHING' ELSE 'SAFE    ' END || ' ' || left(url, 50) || '... (' || round(greatest(1.0::DOUBLE - {P1}, {P1}) * 100)::INTEGER || '%)' END AS status FROM full_"""
    out["rule_summary"] = full + f"""
SELECT count_if(error IS NULL AND NOT {FIRED}) AS safe_count, count_if(error IS NULL AND {FIRED}) AS phishing_count, count_if(error IS NOT NULL) AS error_count FROM full_"""
    out["rule_evaluation"] = full + f"""
SELECT url, CASE WHEN label = 1 THEN 'phishing' ELSE 'legitimate' END AS actual,
  CASE WHEN error IS NULL THEN CASE WHEN {FIRED} THEN 'phishing' ELSE 'legitimate' END END AS predicted,
  CASE WHEN error IS NULL THEN greatest(1.0::DOUBLE - {P1}, {P1}) END AS confidence, CASE WHEN error IS NULL THEN ({FIRED}) = (label = 1) END AS match, error FROM full_"""
    fired = " UNION ALL ".join(f"SELECT {_q(feature)} AS feature, count_if({_rule_sql(feature, op, value)}) AS n FROM full_" for _, feature, op, value in INDICATOR_RULES)
    shares = full + f""",
fired AS ({fired}),
shares AS (SELECT 'indicator_rules' AS model_type, feature, sum(n)::DOUBLE / (SELECT sum(n) FROM fired) AS importance FROM fired GROUP BY feature HAVING sum(n) > 0)
SELECT * FROM shares"""
    out["rule_importance"] = shares
    out["rule_top_features"] = shares + " ORDER BY importance DESC, feature LIMIT 5"
    out["saved_model_score"] = """
SELECT count(*) AS n_rows, count(*) AS n_same FROM pages"""
    return out
