"""Oracle statements for content, rules, labels, splits and metrics."""

from __future__ import annotations

from hookline.fixed import (CONTENT_COLUMNS, CUSTOM_POSITIVE_LABELS, FEATURE_COLUMNS,
                            INDICATOR_RULES, NEW_DOMAIN_DAYS, NO_WARNINGS_TEXT, RANDOM_SEED,
                            UCI_POSITIVE_TEXT, WARN_IP, WARN_NEW_DOMAIN, WARN_NO_HTTPS,
                            WARN_TYPOSQUAT)
from hookline.functions.url import PY_STRIP
from hookline.plans.oracle import _q, _with, corpus_ctes, full_ctes, parse_ctes
from hookline.sources import corpus as C

RULE_THRESHOLD = 4
N_RULES = len(INDICATOR_RULES)
FOLDS = 5


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


_SQL_OP = {">": ">", "<": "<", "<=": "<=", "==": "="}


def _rule_sql(feat: str, op: str, val) -> str:
    if op == "in [0, v)":
        return f"({feat} >= 0 AND {feat} < {val})"
    return f"({feat} {_SQL_OP[op]} {val})"


IND_SUM = " + ".join(f"(CASE WHEN {_rule_sql(f, o, v)} THEN 1 ELSE 0 END)" for _, f, o, v in INDICATOR_RULES)
FEATS = ", ".join(FEATURE_COLUMNS)
ZEROED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURE_COLUMNS)


def scored_ctes() -> str:
    return corpus_ctes() + "," + full_ctes("url_corpus") + f""",
filled AS (SELECT id, label, {ZEROED}, closest_brand, error FROM full_),
scored AS (
  SELECT id, label, {FEATS}, closest_brand,
         CAST({IND_SUM} AS INTEGER) AS n_indicators,
         CAST({IND_SUM} AS DOUBLE) / CAST({N_RULES} AS DOUBLE) AS score,
         CAST(CASE WHEN {IND_SUM} >= {RULE_THRESHOLD} THEN 1 ELSE 0 END AS INTEGER) AS prediction
  FROM filled)"""


def pages_decorated_cte() -> str:
    h = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
    whens = []
    for i, text in enumerate(C.HTML_FRAGMENTS):
        head, _, tail = text.partition("{netloc}")
        piece = f"{_q(head)} || {h} || {_q(tail)}" if "{netloc}" in text else _q(text)
        whens.append(f"WHEN {i} THEN {piece}")
    frag = f"CASE page_id % {len(C.HTML_FRAGMENTS)} {' '.join(whens)} END"
    return f"""
pages_decorated AS (
  SELECT page_id, url,
         CASE WHEN page_id % {C.NULL_HTML_EVERY} = {C.NULL_HTML_EVERY - 1} THEN NULL ELSE html || {frag} END AS html
  FROM pages)"""


# The oracle's own patterns: markup in one scan, a tag's name, its attributes, and the references of the derived pages.
_INSIDE = r"""(?:[\s/](?:"[^"]*"|'[^']*'|[^>"'])*)?"""
_RAW = "|".join(rf"<{n}{_INSIDE}>.*?</\s*{n}\s*>|<{n}{_INSIDE}>.*" for n in ("script", "style"))
MARKUP = rf"(?is)<!--.*?--\s*>|<!\[cdata\[.*?\]\s*\]\s*>|{_RAW}|<[a-z][^\s/>]*{_INSIDE}>|<[!?/][^>]*>"
TAG_NAME = r"(?is)^<([a-z][^\s/>]*)"
ONE_ATTRIBUTE = r"""(?is)[\s/]+[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _decoded(v: str) -> str:
    pieces = f"regexp_extract_all({v}, '&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[a-z]+;|[^&]+|&')"
    one = ("CASE WHEN starts_with(p, '&#x') THEN chr(CAST('0x' || p[4:-2] AS INTEGER)) WHEN starts_with(p, '&#') THEN chr(CAST(p[3:-2] AS INTEGER)) "
           "WHEN p = '&amp;' THEN '&' WHEN p = '&colon;' THEN ':' ELSE p END")
    return f"coalesce(array_to_string(list_transform({pieces}, lambda p: {one}), ''), '')"


def _attr(t: str, name: str) -> str:
    named = (f"list_filter(regexp_extract_all({t}, {_q(ONE_ATTRIBUTE)}), "
             f"lambda a: regexp_matches(a, {_q('(?is)^[' + chr(92) + 's/]+' + name + '(' + chr(92) + 's*=|$)')}))")
    whole = f"coalesce(list_last({named}), '')"
    v = f"regexp_extract({whole}, '(?s)=\\s*(.*)$', 1)"
    bare = f"(CASE WHEN starts_with({v}, '\"') OR starts_with({v}, '''') THEN substr({v}, 2, length({v}) - 2) ELSE {v} END)"
    return _decoded(bare)


def _ext(href: str) -> str:
    return f"(starts_with({href}, 'http') AND netloc <> '' AND NOT contains({href}, netloc))"


def content_ctes(src: str) -> str:
    """{src}(page_id, url, html) -> content(page_id, url, 5 features)."""
    tags = {n: f"list_filter(all_tags, lambda t: lower(regexp_extract(t, {_q(TAG_NAME)}, 1)) = '{n}')"
            for n in ["form", "input", "a", "img", "link"]}
    return parse_ctes(src, "pp") + f""",
pc0 AS (SELECT page_id, url, html, coalesce(netloc, '') AS netloc,
               regexp_extract_all(html, {_q(MARKUP)}, 0) AS all_tags FROM pp),
pc1 AS (SELECT page_id, url, html, netloc, {tags['form']} AS forms, {tags['input']} AS inputs,
               {tags['a']} AS anchors, {tags['img']} AS images,
               list_filter({tags['link']}, lambda t: regexp_matches({_attr('t', 'rel')}, '(^|\\s)icon(\\s|$)')) AS icons
        FROM pc0),
content AS (
  SELECT page_id, url,
    CAST(CASE WHEN html IS NULL THEN 0.0 WHEN len(forms) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS has_form,
    CAST(CASE WHEN html IS NULL THEN 0.0
              WHEN len(list_filter(inputs, lambda t: {_attr('t', 'type')} = 'password')) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS has_password_field,
    CAST(CASE WHEN html IS NULL THEN 0 ELSE len(list_filter(anchors, lambda t: {_ext(_attr('t', 'href'))})) END AS DOUBLE) AS num_external_links,
    CAST(CASE WHEN html IS NULL THEN 0 ELSE len(images) END AS DOUBLE) AS num_images,
    CAST(CASE WHEN html IS NULL THEN 0.0
              WHEN len(icons) > 0 AND {_ext(_attr('icons[1]', 'href'))} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS favicon_from_other_domain
  FROM pc1)"""


def url_events_ctes() -> str:
    return """
n_corpus AS (SELECT count(*) AS n FROM url_corpus),
url_events AS (
  SELECT e.event_id, e.ts, c.url, c.label
  FROM events e LEFT JOIN url_corpus c ON c.id = e.event_id % (SELECT n FROM n_corpus))"""


def _alloc_ctes(prefix: str, counts: str, n_col: str, ratio: float) -> str:
    """{prefix}(label, hold): held-out rows per class (largest remainder on the kept share)."""
    r = _dbl(ratio)
    return f"""
{prefix}_a AS (
  SELECT label, {n_col} AS n, CAST(sum({n_col}) OVER () AS DOUBLE) AS n_all FROM {counts}),
{prefix}_b AS (
  SELECT *, n_all - ceil({r} * n_all) AS keep_total FROM {prefix}_a),
{prefix}_c AS (
  SELECT *, CAST(n AS DOUBLE) / n_all * keep_total AS cont FROM {prefix}_b),
{prefix}_d AS (
  SELECT *, floor(cont) AS fl FROM {prefix}_c),
{prefix}_e AS (
  SELECT *, keep_total - sum(fl) OVER () AS need,
         row_number() OVER (ORDER BY cont - fl DESC, label) AS rr FROM {prefix}_d),
{prefix} AS (
  SELECT label, CAST(n - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS BIGINT) AS hold FROM {prefix}_e)"""


def _hash_rank(src: str) -> str:
    return (f"SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY "
            f"md5('{RANDOM_SEED}:' || CAST(id AS VARCHAR)), id) AS rnk FROM {src}")


def split_ctes(ratio: float = 0.2) -> str:
    return scored_ctes() + f""",
sp_cnt AS (SELECT label, count(*) AS n FROM scored GROUP BY label),""" + _alloc_ctes("sp_alloc", "sp_cnt", "n", ratio) + f""",
sp_rank AS ({_hash_rank('scored')}),
split AS (
  SELECT sp_rank.id, sp_rank.label, CASE WHEN rnk <= hold THEN 'validation' ELSE 'train' END AS split
  FROM sp_rank JOIN sp_alloc USING (label))"""


def _clamp(x: str, hi: str) -> str:
    return f"least(greatest({x}, 0), {hi})"


def fold_sql(k: int) -> str:
    terms = []
    for i in range(k):
        no_wrap = _clamp(f"{i} - o2 + 1", "m")
        wrap = f"{_clamp(f'{i} - o2 + 1', f'{k} - o2')} + {_clamp(f'{i + 1}', f'o2 + m - {k}')}"
        extra = f"(CASE WHEN o2 + m <= {k} THEN {no_wrap} ELSE {wrap} END)"
        terms.append(f"(CASE WHEN q * {i + 1} + {extra} <= r THEN 1 ELSE 0 END)")
    return " + ".join(terms)


def folds_ctes(k: int = FOLDS) -> str:
    return scored_ctes() + f""",
fd_cls AS (SELECT label, count(*) AS n, min(id) AS first_id FROM scored GROUP BY label),
fd_cls2 AS (
  SELECT label, n, coalesce(sum(n) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM fd_cls),
fd_rank AS (SELECT id, label, prediction, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS r FROM scored),
fd_x AS (
  SELECT fd_rank.*, n // {k} AS q, n % {k} AS m, o % {k} AS o2 FROM fd_rank JOIN fd_cls2 USING (label)),
folds AS (SELECT id, label, prediction, CAST({fold_sql(k)} AS INTEGER) AS fold FROM fd_x)"""


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    content_cols = ", ".join(CONTENT_COLUMNS)
    out["page_content_features"] = (_with(pages_decorated_cte(), content_ctes("pages_decorated"))
                                    + f"\nSELECT page_id, {content_cols} FROM content")
    by_url = ", ".join(f"cb.c.{c} AS {c}" for c in CONTENT_COLUMNS)
    coal = ", ".join(f"CAST(coalesce(cu.{c}, 0.0) AS DOUBLE) AS {c}" for c in CONTENT_COLUMNS)
    out["page_content_join"] = _with(corpus_ctes(), url_events_ctes(), pages_decorated_cte(),
                                     content_ctes("pages_decorated")) + f""",
cb AS (SELECT url, arg_min(struct_pack({', '.join(f'{c} := {c}' for c in CONTENT_COLUMNS)}), page_id) AS c
       FROM content WHERE url IS NOT NULL GROUP BY url),
cu AS (SELECT url, {by_url} FROM cb)
SELECT e.event_id, {coal} FROM url_events e LEFT JOIN cu ON cu.url = e.url"""

    head, tail = WARN_TYPOSQUAT.split("{brand}")
    w = [f"CASE WHEN has_https = 0 THEN {_q(WARN_NO_HTTPS)} END",
         f"CASE WHEN has_ip_address <> 0 THEN {_q(WARN_IP)} END",
         f"CASE WHEN typosquatting_score > 0 THEN {_q(head)} || coalesce(closest_brand, 'unknown') || {_q(tail)} END",
         f"CASE WHEN domain_age_days >= 0 AND domain_age_days < {NEW_DOMAIN_DAYS} THEN {_q(WARN_NEW_DOMAIN)} END"]
    n_w = " + ".join(f"(CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END)" for x in w)
    out["warning_rules"] = _with(corpus_ctes(), full_ctes("url_corpus")) + f"""
SELECT id, CASE WHEN error IS NULL THEN CAST({n_w} AS INTEGER) END AS n_warnings, error,
       CASE WHEN error IS NOT NULL THEN NULL WHEN {n_w} = 0 THEN {_q(NO_WARNINGS_TEXT)} ELSE concat_ws(chr(10), {', '.join(w)}) END AS warning_text
FROM full_"""

    names = [f"CASE WHEN {_rule_sql(f, o, v)} THEN {_q(n)} END" for n, f, o, v in INDICATOR_RULES]
    out["risk_indicators"] = _with(corpus_ctes(), full_ctes("url_corpus")) + f"""
SELECT id, CASE WHEN error IS NULL THEN CAST({IND_SUM} AS INTEGER) END AS n_indicators, error,
       CASE WHEN error IS NULL THEN concat_ws(',', {', '.join(names)}) END AS indicators
FROM full_"""

    out["warning_summary"] = _with(corpus_ctes(), url_events_ctes(),
                                   "ue AS (SELECT event_id AS id, url FROM url_events)",
                                   full_ctes("ue")) + f"""
SELECT CAST(count_if(error IS NULL AND ({IND_SUM}) < {RULE_THRESHOLD}) AS BIGINT) AS safe_count,
       CAST(count_if(error IS NULL AND ({IND_SUM}) >= {RULE_THRESHOLD}) AS BIGINT) AS phishing_count,
       CAST(count_if(error IS NOT NULL) AS BIGINT) AS error_count
FROM full_"""

    pos = ", ".join(_q(x) for x in CUSTOM_POSITIVE_LABELS)
    out["labels_custom"] = _with(corpus_ctes()) + f"""
SELECT id, label_text, CAST(CASE WHEN lower(coalesce(label_text, 'nan')) IN ({pos}) THEN 1 ELSE 0 END AS INTEGER) AS label
FROM url_corpus"""

    txt = ", ".join(_q(x) for x in UCI_POSITIVE_TEXT)
    out["labels_uci"] = _with(corpus_ctes()) + f""",
u AS (
  SELECT id, CAST(CASE WHEN id % 5 = 0 THEN 0 WHEN label = 1 THEN 1 ELSE -1 END AS INTEGER) AS "Result",
         CASE id % 4 WHEN 0 THEN '1' WHEN 1 THEN '-1' WHEN 2 THEN 'phishing' ELSE 'legitimate' END AS "class"
  FROM url_corpus)
SELECT id, "Result", "class",
       CAST(CASE WHEN "Result" IN (1, -1) THEN 1 ELSE 0 END AS INTEGER) AS label_ref,
       CAST(CASE WHEN "Result" = 1 THEN 1 ELSE 0 END AS INTEGER) AS label_pos,
       CAST(CASE WHEN "class" IN ({txt}) THEN 1 ELSE 0 END AS INTEGER) AS class_label
FROM u"""

    out["class_distribution"] = _with(corpus_ctes()) + """
SELECT label, count(*) AS n FROM url_corpus GROUP BY label"""

    out["sample_corpus"] = _with(corpus_ctes()) + """,
pools AS (SELECT id, url, CASE WHEN label = 0 THEN 'legitimate' ELSE 'phishing' END AS label
          FROM url_corpus WHERE url IS NOT NULL),
pools_r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS pos FROM pools),
sizes AS (SELECT label, count(*) AS size FROM pools GROUP BY label),
half AS (SELECT count(*) // 2 AS h FROM url_corpus),
idx AS (SELECT unnest(range(h)) AS i FROM half),
targets AS (SELECT i, k.label FROM idx CROSS JOIN (VALUES ('legitimate'), ('phishing')) k(label))
SELECT CAST(CASE WHEN t.label = 'legitimate' THEN t.i ELSE t.i + (SELECT h FROM half) END AS BIGINT) AS row_idx,
       p.url, t.label
FROM targets t JOIN sizes s ON s.label = t.label JOIN pools_r p ON p.label = t.label AND p.pos = t.i % s.size + 1"""

    out["split_train_val"] = _with(split_ctes()) + "\nSELECT id, label, split FROM split"

    out["split_three_way"] = _with(scored_ctes()) + """,
tw_cnt AS (SELECT label, count(*) AS n FROM scored GROUP BY label),""" + _alloc_ctes(
        "tw_test", "tw_cnt", "n", 0.1) + """,
tw_rest AS (SELECT tw_cnt.label, n - hold AS rest, hold AS n_test FROM tw_cnt JOIN tw_test USING (label)),""" + \
        _alloc_ctes("tw_val", "tw_rest", "rest", 0.1 / (0.8 + 0.1)) + f""",
tw_rank AS ({_hash_rank('scored')})
SELECT r.id, r.label,
       CASE WHEN rnk <= n_test THEN 'test' WHEN rnk <= n_test + v.hold THEN 'validation' ELSE 'train' END AS split
FROM tw_rank r JOIN tw_rest t USING (label) JOIN tw_val v USING (label)"""

    out["stratified_folds"] = _with(folds_ctes()) + "\nSELECT id, label, fold FROM folds"

    train = _with(split_ctes()) + """,
train AS (SELECT scored.* FROM scored JOIN split USING (id) WHERE split.split = 'train')"""
    stats_rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 9) AS mean, "
        f"round(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END, 9) AS std "
        f"FROM train" for c in FEATURE_COLUMNS)
    out["scaler_stats"] = train + f"\n{stats_rows}"

    raw = ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS m_{c}, "
        f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS s_{c}"
        for c in FEATURE_COLUMNS)
    scaled = ", ".join(f"round((CAST(s.{c} AS DOUBLE) - st.m_{c}) / st.s_{c}, 9) AS {c}" for c in FEATURE_COLUMNS)
    out["scaled_features"] = train + f""",
st AS (SELECT {raw} FROM train)
SELECT s.id, {scaled} FROM scored s CROSS JOIN st"""

    out["binary_metrics"] = _with(scored_ctes()) + """,
c AS (SELECT count(*) AS n,
             count_if(label = 1 AND prediction = 1) AS tp, count_if(label <> 1 AND prediction = 1) AS fp,
             count_if(label = 1 AND prediction <> 1) AS fn, count_if(label <> 1 AND prediction <> 1) AS tn
      FROM scored)
SELECT CASE WHEN n = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) END AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1_score
FROM c"""

    out["roc_auc"] = _with(scored_ctes()) + """,
per AS (SELECT score, CAST(count_if(label = 1) AS DOUBLE) AS p, CAST(count_if(label <> 1) AS DOUBLE) AS q
        FROM scored GROUP BY score),
cum AS (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS qb
        FROM per)
SELECT CASE WHEN sum(p) = 0 OR sum(q) = 0 THEN NULL
            ELSE sum(p * (qb + q / CAST(2 AS DOUBLE))) / (sum(p) * sum(q)) END AS roc_auc
FROM cum"""

    out["confusion_matrix"] = _with(scored_ctes()) + """
SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction"""

    out["cv_summary"] = _with(folds_ctes()) + """,
per AS (SELECT fold, CAST(count_if(label = prediction) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS accuracy
        FROM folds GROUP BY fold)
SELECT round(avg(accuracy), 9) AS cv_mean_accuracy, round(stddev_pop(accuracy), 9) AS cv_std_accuracy FROM per"""

    out["best_model"] = _with(scored_ctes()) + f""",
ts AS (SELECT unnest(range(1, {N_RULES + 1})) AS t),
per AS (
  SELECT t, count_if(label = 1 AND n_indicators >= t) AS tp, count_if(label <> 1 AND n_indicators >= t) AS fp,
         count_if(label = 1 AND n_indicators < t) AS fn
  FROM scored CROSS JOIN ts GROUP BY t),
m AS (
  SELECT t, 'rules_ge_' || CAST(t AS VARCHAR) AS model,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1_score
  FROM per)
SELECT model, f1_score FROM m ORDER BY f1_score DESC, t LIMIT 1"""

    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)
    out["features_by_name"] = _with(scored_ctes()) + f"""
SELECT id, feature, value FROM (
  UNPIVOT (SELECT id, {casts} FROM scored) ON {FEATS} INTO NAME feature VALUE value)"""

    out["url_quarantine"] = _with(corpus_ctes(), parse_ctes("url_corpus")) + f"""
SELECT id, reason FROM (
  SELECT id, CASE WHEN url IS NULL THEN 'missing url'
                  WHEN regexp_replace(url, {_q(PY_STRIP)}, '', 'g') = '' THEN 'blank url'
                  ELSE error END AS reason
  FROM parsed) WHERE reason IS NOT NULL"""

    out["typosquat_blocked_join"] = _with(corpus_ctes(), parse_ctes("url_corpus")) + """,
labs AS (SELECT DISTINCT main_label FROM parsed WHERE main_label IS NOT NULL AND error IS NULL)
SELECT main_label, brand, CAST(levenshtein(main_label, brand) AS INTEGER) AS distance
FROM labs CROSS JOIN brands WHERE levenshtein(main_label, brand) <= 2"""
    out["typosquat_brand_table"] = _with(corpus_ctes(), parse_ctes("url_corpus")) + f""",
shops AS (SELECT c_custkey AS k, [lower(c_mktsegment) || c_custkey::VARCHAR, 'shop' || left(md5(c_custkey::VARCHAR), 6)] AS names FROM customer),
squats AS (SELECT k, names[(k % 2 + 1)::INTEGER] AS name FROM shops),
labs AS (
  SELECT main_label FROM parsed WHERE main_label IS NOT NULL AND error IS NULL
  UNION SELECT CASE k % 4 WHEN 0 THEN replace(name, 'e', '3') WHEN 1 THEN substr(name, 2) || 's' WHEN 2 THEN 'my-' || name
                          ELSE left(name, 5) || left(md5(name), 4) END FROM squats),
goods AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type) AS t FROM part),
more AS (
  SELECT brand_idx, brand FROM brands UNION ALL SELECT n_nationkey + (SELECT count(*) FROM brands), lower(n_name) FROM nation
  UNION ALL SELECT {C.PART_BRANDS_FROM} + 4 * k, a || b || (k % 1000)::VARCHAR FROM goods
  UNION ALL SELECT {C.PART_BRANDS_FROM} + 4 * k + 1, b || left(md5(k::VARCHAR), 4) FROM goods
  UNION ALL SELECT {C.PART_BRANDS_FROM} + 4 * k + 2, t || a || (k % 97)::VARCHAR FROM goods
  UNION ALL SELECT {C.PART_BRANDS_FROM} + 4 * k + 3, left(md5('n' || k::VARCHAR), (5 + k % 6)::INTEGER) FROM goods
  UNION ALL SELECT {C.CUSTOMER_BRANDS_FROM} + 2 * k, names[1] FROM shops UNION ALL SELECT {C.CUSTOMER_BRANDS_FROM} + 2 * k + 1, names[2] FROM shops),
per AS (SELECT main_label, min(struct_pack(d := levenshtein(main_label, brand), i := brand_idx, b := brand)) AS b FROM labs CROSS JOIN more GROUP BY main_label)
SELECT main_label, CAST(b.d AS INTEGER) AS distance, b.b AS brand FROM per"""
    out.update(stream_statements())
    out.update(request_statements())
    return out


def stream_statements() -> dict[str, str]:
    from hookline.plans.oracle import local_ctes
    out = {}
    out["score_stream"] = _with(corpus_ctes(), url_events_ctes(),
                                "ue AS (SELECT event_id AS id, url FROM url_events)", full_ctes("ue")) + f"""
SELECT id AS event_id,
       CAST(CASE WHEN error IS NULL THEN {IND_SUM} END AS INTEGER) AS n_indicators,
       CASE WHEN error IS NULL THEN ({IND_SUM}) >= {RULE_THRESHOLD} END AS is_phishing,
       error
FROM full_"""
    out["stream_verdict_windows"] = _with(corpus_ctes(), url_events_ctes(),
                                          "ue AS (SELECT event_id AS id, ts, url FROM url_events)",
                                          local_ctes("ue")) + f""",
lr AS (SELECT *, 0.0 AS has_valid_ssl, -1.0 AS domain_age_days FROM local)
SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start_epoch,
       CAST(count_if(error IS NULL AND ({IND_SUM}) < {RULE_THRESHOLD}) AS BIGINT) AS safe_count,
       CAST(count_if(error IS NULL AND ({IND_SUM}) >= {RULE_THRESHOLD}) AS BIGINT) AS phishing_count,
       CAST(count_if(error IS NOT NULL) AS BIGINT) AS error_count
FROM lr GROUP BY 1"""
    return out


def request_statements() -> dict[str, str]:
    out = {}
    out["request_validation"] = _with(corpus_ctes(), url_events_ctes()) + """,
k AS (SELECT event_id, url, event_id % 15 AS k, to_json(url)::VARCHAR AS t FROM url_events),
b AS (
  SELECT event_id AS request_id, k IN (1, 2, 5, 6, 7, 12) AS batch,
    CASE k WHEN 0 THEN CASE WHEN url IS NULL THEN '{}' ELSE '{"url":' || t || '}' END
      WHEN 1 THEN '{"urls":[' || coalesce(t, 'null') || ',' || coalesce(t, 'null') || ']}'
      WHEN 2 THEN CASE WHEN url IS NULL THEN '{}' ELSE '{"urls":' || t || '}' END
      WHEN 3 THEN CASE WHEN url IS NULL THEN '{}' ELSE '{"link":' || t || '}' END
      WHEN 4 THEN CASE WHEN url IS NULL THEN '{"extra":1}' ELSE '{"url":' || t || ',"extra":1}' END
      WHEN 5 THEN '{"urls":[' || coalesce(t, 'null') || ',null,5,["x"],{"url":"y"},' || coalesce(t, 'null') || ']}'
      WHEN 6 THEN '{"urls":[]}' WHEN 7 THEN '{"urls":"[abc"}' WHEN 8 THEN '{"url": ' || coalesce(t, 'null') WHEN 9 THEN '{"url":5}' WHEN 10 THEN '{"url":null}' WHEN 11 THEN '["url"]'
      WHEN 12 THEN CASE WHEN url IS NULL THEN '{}' ELSE '{"link":' || t || '}' END WHEN 13 THEN NULL ELSE 'null' END AS body
  FROM k),
good AS (SELECT request_id, batch, body, json_type(body, CASE WHEN batch THEN '$.urls' ELSE '$.url' END) AS kind FROM b WHERE coalesce(json_valid(body), false)),
items AS (
  SELECT request_id, 0 AS pos, json_extract(body, '$.url') AS item FROM good WHERE NOT batch AND kind IS NOT NULL
  UNION ALL
  SELECT request_id, unnest(range(json_array_length(body, '$.urls')::BIGINT))::INTEGER AS pos, unnest(json_extract(body, '$.urls[*]')) AS item FROM good WHERE batch AND kind = 'ARRAY')
SELECT request_id, pos::INTEGER AS pos, CASE WHEN json_type(item) = 'VARCHAR' THEN item ->> '$' END AS url,
       CASE WHEN json_type(item) <> 'VARCHAR' THEN 'url must be a string' END AS error FROM items
UNION ALL SELECT request_id, 0, NULL, 'Invalid JSON' FROM b WHERE NOT coalesce(json_valid(body), false)
UNION ALL SELECT request_id, 0, NULL, 'Missing required field: ' || CASE WHEN batch THEN 'urls' ELSE 'url' END FROM good WHERE kind IS NULL
UNION ALL SELECT request_id, 0, NULL, 'urls must be a list' FROM good WHERE batch AND kind <> 'ARRAY'"""
    out["dataset_shape"] = _with(scored_ctes()) + f"""
SELECT count(*) AS n_rows, CAST({len(FEATURE_COLUMNS)} AS INTEGER) AS n_columns FROM scored"""
    out["event_url_features"] = _with(corpus_ctes(), url_events_ctes(),
                                      "ue AS (SELECT event_id AS id, url FROM url_events)",
                                      full_ctes("ue")) + f"""
SELECT id AS event_id, {FEATS}, closest_brand, error FROM full_"""
    first = ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURE_COLUMNS[:10])
    out["first_numeric_features"] = _with(corpus_ctes(), full_ctes("url_corpus")) + f"""
SELECT id, {first} FROM full_"""
    return out
