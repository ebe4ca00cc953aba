"""Registered queries, second part: content, rules, labels, splits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hookline.fixed import CONTENT_COLUMNS, FEATURE_COLUMNS, INDICATOR_RULES
from hookline.functions.labels import custom_label, uci_label
from hookline.functions.rules import indicator_count, risk_indicators, warning_text, warnings
from hookline.functions.url import py_strip, with_parsed
from hookline.operators import metrics as M
from hookline.operators.content import page_content, with_content
from hookline.operators.features import url_features
from hookline.operators.splits import split_cuts, stratified_folds, stratified_split, three_way_split
from hookline.operators.typosquat import brand_matches, nearest_brands
from hookline.plans.catalog import corpus_features, corpus_local, query
from hookline.sources import corpus as C
from hookline.sources.datasets import sample_dataset_from_pools

# Rule model used where a score is needed without a trained model: the
# number of fired documented indicators, verdict at RULE_THRESHOLD or more.
RULE_THRESHOLD = 4
N_RULES = len(INDICATOR_RULES)
FOLDS = 5


def zero_filled(feats):
    """Feature rows with zeros where the url could not be read (the rows stay)."""
    return feats.select(*[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) if c in FEATURE_COLUMNS else F.col(c) for c, t in feats.dtypes])


def scored(spark, sf):
    """Every corpus row with 32 features (zeros for unreadable urls), rule score and rule verdict."""
    n = indicator_count()
    f = zero_filled(corpus_features(spark, sf))
    return f.select("id", "label", *FEATURE_COLUMNS, "closest_brand",
                    n.alias("n_indicators"),
                    (n.cast("double") / F.lit(float(N_RULES))).alias("score"),
                    F.when(n >= RULE_THRESHOLD, 1).otherwise(0).alias("prediction"))


def labelled_ids(spark, sf):
    """(id, label) of every corpus row: what the splits and folds need."""
    return C.url_corpus(spark, sf).select("id", "label")


# --- content (F34-F38, J4) ------------------------------------------------------------

@query("page_content_features")
def page_content_features(spark, sf):
    return page_content(C.pages_decorated(spark, sf)).select("page_id", *CONTENT_COLUMNS)


@query("page_content_join")
def page_content_join(spark, sf):
    ev = C.url_events(spark, sf).select("event_id", "url")
    return with_content(ev, C.pages_decorated(spark, sf)).select("event_id", *CONTENT_COLUMNS)


# --- rules (M7, M8, M11, A4) -----------------------------------------------------------

@query("warning_rules")
def warning_rules(spark, sf):
    f = corpus_features(spark, sf)
    w = warnings()
    ok = F.col("error").isNull()
    return f.select("id", F.when(ok, F.size(w)).alias("n_warnings"), F.when(ok, warning_text(w)).alias("warning_text"), "error")


@query("risk_indicators")
def risk_indicators_q(spark, sf):
    f = corpus_features(spark, sf)
    r = risk_indicators()
    ok = F.col("error").isNull()
    return f.select("id", F.when(ok, F.size(r)).alias("n_indicators"), F.when(ok, F.array_join(r, ",")).alias("indicators"), "error")


@query("warning_summary")
def warning_summary(spark, sf):
    """A4 over the event stream table: safe / phishing / error counts."""
    ev = C.url_events(spark, sf).select("event_id", "url")
    f = url_features(ev, registry=C.registry_snapshot(spark, sf),
                     certificates=C.certificate_snapshot(spark, sf), as_of=C.as_of())
    n = indicator_count()
    ok = F.col("error").isNull()
    return f.agg(F.count_if(ok & (n < RULE_THRESHOLD)).alias("safe_count"),
                 F.count_if(ok & (n >= RULE_THRESHOLD)).alias("phishing_count"),
                 F.count_if(~ok).alias("error_count"))


# --- labels (M1, M2, A2, S5) --------------------------------------------------------------

@query("labels_custom")
def labels_custom(spark, sf):
    c = C.url_corpus(spark, sf)
    return c.select("id", "label_text", custom_label(F.col("label_text")).alias("label"))


def uci_frame(spark, sf):
    """UCI-style targets derived from the corpus: numeric -1/0/1 and text."""
    c = C.url_corpus(spark, sf)
    num = (F.when(F.col("id") % 5 == 0, 0).when(F.col("label") == 1, 1).otherwise(-1)).cast("int")
    txt = F.element_at(F.array(*[F.lit(x) for x in ["1", "-1", "phishing", "legitimate"]]),
                       (F.col("id") % 4 + 1).cast("int"))
    return c.select("id", num.alias("Result"), txt.alias("class"))


@query("labels_uci")
def labels_uci(spark, sf):
    from pyspark.sql.types import IntegerType, StringType
    u = uci_frame(spark, sf)
    return u.select("id", "Result", "class",
                    uci_label(F.col("Result"), IntegerType()).alias("label_ref"),
                    uci_label(F.col("Result"), IntegerType(), positive=1).alias("label_pos"),
                    uci_label(F.col("class"), StringType()).alias("class_label"))


@query("class_distribution")
def class_distribution(spark, sf):
    return M.class_distribution(C.url_corpus(spark, sf))


@query("sample_corpus")
def sample_corpus(spark, sf):
    """Legit and phishing pools (corpus urls by label) repeated in
    id order and cut to n//2 each, n = corpus size."""
    c = C.url_corpus(spark, sf).where(F.col("url").isNotNull())
    legit = c.where(F.col("label") == 0).select("id", "url")
    phish = c.where(F.col("label") == 1).select("id", "url")
    n = C.url_corpus(spark, sf).count()
    return sample_dataset_from_pools(spark, legit, phish, n)


# --- splits and folds (D1-D3) ---------------------------------------------------------------

@query("split_train_val")
def split_train_val(spark, sf):
    return stratified_split(labelled_ids(spark, sf)).select("id", "label", "split")


@query("split_three_way")
def split_three_way(spark, sf):
    return three_way_split(labelled_ids(spark, sf)).select("id", "label", "split")


@query("stratified_folds")
def stratified_folds_q(spark, sf):
    return stratified_folds(labelled_ids(spark, sf), FOLDS).select("id", "label", "fold")


# --- scaler, metrics (A5-A9, L1, T4, T5) ------------------------------------------------------

def _train_rows(spark, sf):
    """Training split of the scored rows; the cuts are found on (id, label), so the features are computed once."""
    return stratified_split(scored(spark, sf), cuts=split_cuts(labelled_ids(spark, sf))).where(F.col("split") == "train")


@query("scaler_stats")
def scaler_stats(spark, sf):
    return M.scaler_stats(_train_rows(spark, sf), FEATURE_COLUMNS)


@query("scaled_features")
def scaled_features(spark, sf):
    """L1: (x - mean) / std with the statistics of the training split only."""
    fitted = M.fit_scaler(_train_rows(spark, sf), FEATURE_COLUMNS)
    s = scored(spark, sf)
    return s.select("id", *[F.round(e, 9).alias(c) for c, e in M.apply_scaler(fitted).items()])


@query("binary_metrics")
def binary_metrics(spark, sf):
    return M.binary_metrics(scored(spark, sf))


@query("roc_auc")
def roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf))


@query("confusion_matrix")
def confusion_matrix(spark, sf):
    return M.confusion_counts(scored(spark, sf))


@query("cv_summary")
def cv_summary(spark, sf):
    """Per-fold accuracy of the rule model over D3 folds -> mean, pop. std."""
    f = stratified_folds(scored(spark, sf).select("id", "label", "prediction"), FOLDS)
    per = f.groupBy("fold").agg(
        (F.count_if(F.col("label") == F.col("prediction")) / F.count(F.lit(1))).alias("accuracy"))
    return M.fold_summary(per)


@query("best_model")
def best_model(spark, sf):
    """T5: rule models 'rules_ge_t' for every threshold t; best F1, first wins ties."""
    # counted per (class, indicators) first: at most 2 x (N_RULES + 1) rows meet the thresholds
    s = scored(spark, sf).groupBy((F.col("label") == 1).alias("pos"), "n_indicators").agg(F.count(F.lit(1)).alias("n"))
    t = F.explode(F.sequence(F.lit(1), F.lit(N_RULES))).alias("t")
    fired = F.col("n_indicators") >= F.col("t")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    per = (s.select("pos", "n_indicators", "n", t)
           .groupBy("t").agg(total(F.col("pos") & fired).alias("tp"), total(~F.col("pos") & fired).alias("fp"),
                             total(F.col("pos") & ~fired).alias("fn")))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, F.lit(0.0)).otherwise(
        (2 * F.col("tp")).cast("double") / (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))
    metrics = per.select(F.concat(F.lit("rules_ge_"), F.col("t").cast("string")).alias("model"),
                         f1.alias("f1_score"), "t")
    return M.best_by(metrics, "model", "f1_score", "t")


@query("features_by_name")
def features_by_name(spark, sf):
    """T4: (id, feature, value) long form of the 32 features."""
    s = scored(spark, sf).select("id", *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS])
    return s.unpivot("id", FEATURE_COLUMNS, "feature", "value")


@query("url_quarantine")
def url_quarantine(spark, sf):
    """P1-P3 + parse errors: rows that cannot be scored, with the reason."""
    c = with_parsed(C.url_corpus(spark, sf).select("id", "url"))
    p = F.col("p")
    blank = py_strip(F.col("url")) == ""
    reason = (F.when(F.col("url").isNull(), F.lit("missing url"))
              .when(blank, F.lit("blank url"))
              .otherwise(p["error"]))
    return c.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


@query("typosquat_brand_table")
def typosquat_brand_table(spark, sf):
    """F30/F33 against a brand table: the fixed brands, the nations, names of parts and customers."""
    return nearest_brands(C.squatted_labels(spark, sf), C.brand_table(spark, sf)).select(F.col("label").alias("main_label"), "distance", "brand")


@query("typosquat_blocked_join")
def typosquat_blocked_join(spark, sf):
    """J3 for brand tables: (main_label, brand, distance <= 2) via deletion blocks."""
    from hookline.fixed import BRANDS
    labels = with_parsed(C.url_corpus(spark, sf).select("url")).where("p.error is null").select(F.col("p.main_label").alias("main_label"))
    brands = spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    return brand_matches(labels, brands).select(
        F.col("label").alias("main_label"), "brand", "distance")


# --- requests, shape, first features (P1, P2, A3, T3) ---------------------------------------

def request_bodies(spark, sf):
    """(request_id, batch, body): JSON requests derived from the event urls, of the kind ``event_id % 15``.

    Single and batch requests that are right, and the wrong ones: no list, a text
    that starts like one, wrong or no field, items and urls of other types, an empty
    list, broken JSON, JSON that is no object, no body.
    """
    ev = C.url_events(spark, sf).select("event_id", "url")
    u = F.col("url")
    own = lambda *fields: F.to_json(F.struct(*fields))
    item = F.to_json(F.struct(u.alias("x")), {"ignoreNullFields": "false"})
    text = F.substring(item, 6, F.length(item) - 6)  # the url as JSON
    kinds = [own(u.alias("url")), own(F.array(u, u).alias("urls")), own(u.alias("urls")), own(u.alias("link")), own(u.alias("url"), F.lit(1).alias("extra")),
             F.concat(F.lit('{"urls": ['), text, F.lit(', null, 5, ["x"], {"url": "y"}, '), text, F.lit("]}")), F.lit('{"urls": []}'), F.lit('{"urls": "[abc"}'),
             F.concat(F.lit('{"url": '), text), F.lit('{"url": 5}'), F.lit('{"url": null}'), F.lit('["url"]'), own(u.alias("link")), F.lit(None).cast("string"), F.lit("null")]
    k = F.col("event_id") % len(kinds)
    body = kinds[-1]
    for i, kind in enumerate(kinds[:-1]):
        body = F.when(k == i, kind).otherwise(body)
    return ev.select(F.col("event_id").alias("request_id"), k.isin(*BATCH_KINDS).alias("batch"), body.alias("body"))


BATCH_KINDS = (1, 2, 5, 6, 7, 12)


@query("request_validation")
def request_validation(spark, sf):
    from hookline.sources.sinks import parse_requests
    return parse_requests(request_bodies(spark, sf), batch_col="batch")


@query("dataset_shape")
def dataset_shape(spark, sf):
    """A3: rows and feature columns of the training table."""
    return labelled_ids(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.lit(len(FEATURE_COLUMNS)).alias("n_columns"))


@query("first_numeric_features")
def first_numeric_features(spark, sf):
    """The first ten features in vector order."""
    return zero_filled(corpus_local(spark, sf)).select("id", *FEATURE_COLUMNS[:10])


@query("event_url_features")
def event_url_features(spark, sf):
    """F40 over the event table: the 32 features for every event url."""
    ev = C.url_events(spark, sf).select("event_id", "url")
    f = url_features(ev, registry=C.registry_snapshot(spark, sf),
                     certificates=C.certificate_snapshot(spark, sf), as_of=C.as_of())
    return f.select("event_id", *FEATURE_COLUMNS, "closest_brand", "error")
