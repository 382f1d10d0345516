"""Registered queries for A-H (sources, expressions, filters, joins,
aggregates, windows, sorts, sets).  Each has a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.functions import expr as B
from vantage.operators import relational as RL
from vantage.operators import stats as ST
from vantage.operators import vectors as VX
from vantage.plans import duck as D
from vantage.plans import reports as R
from vantage.plans.catalog import register
from vantage.sources import files as A
from vantage.sources import testdata as V

r6 = D.r6


def base(*views: str) -> D.CTE:
    """A CTE pre-loaded with the standard views (DuckDB side)."""
    q = D.CTE()
    if "pairs" in views:
        D.pairs_ctes(q)
    if "samples" in views and "pairs" not in views:
        q.add("samples", D.samples_sql())
    if "scores" in views:
        q.add("scores", D.scores_sql())
    if "meta" in views:
        q.add("meta", D.meta_sql())
    if "emb" in views:
        q.add("emb", D.emb_long_sql())
    if "raw" in views:
        q.add("raw", D.emb_raw_sql())
    return q


def wide_pairs(spark, d):
    return R.regression_pairs_wide(spark, d).drop("n")


WIDE_PAIRS_SQL = """
SELECT u.dataset, u.r2 AS r2_unassisted, u.rmse AS rmse_unassisted, u.mae AS mae_unassisted,
       a.r2 AS r2_assisted, a.rmse AS rmse_assisted, a.mae AS mae_assisted
FROM pairs u JOIN pairs a ON u.dataset = a.dataset AND u.model = 'unassisted' AND a.model = 'assisted'"""


# ---------------------------------------------------------------- A

@register("a1_scan_keyed", lambda: """
SELECT 'lineitem' AS source, count(*) AS n, """ + r6("sum(l_quantity)") + """ AS sum_qty FROM lineitem""")
def a1_scan_keyed(spark, d):
    """A1: scan files keyed by file stem; the stem becomes a column."""
    df = A.scan_keyed(spark, f"{d}/lineitem.parquet", fmt="parquet")
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"))


@register("a2_parse_artifact_name", lambda: base("samples").sql("""
SELECT DISTINCT dataset, TRY_CAST(regexp_extract(dataset, '^data_([0-9]+)_', 1) AS BIGINT) AS seed,
       string_split(dataset, '_')[-1] AS equation FROM samples"""))
def a2_parse_artifact_name(spark, d):
    """A2: seed and equation parsed from dataset names."""
    s = V.samples(spark, d).select("dataset").distinct()
    return s.select("dataset", *A.parse_artifact_name(F.col("dataset")))


@register("a3_scan_embeddings", lambda: base("emb").sql(f"""
SELECT dataset, model, count(*) AS n, max(len(embedding)) AS dim,
       {r6('avg(sqrt(list_sum(list_transform(embedding, lambda x: x * x))))')} AS mean_norm
FROM emb GROUP BY dataset, model"""))
def a3_scan_embeddings(spark, d):
    """A3: embedding matrices in long form (dataset, model, row_id, vector)."""
    e = V.emb_long(spark, d)
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return e.groupBy("dataset", "model").agg(F.count(F.lit(1)).alias("n"),
                                             F.max(F.size("embedding")).cast("bigint").alias("dim"),
                                             F.avg(norm).alias("mean_norm"))


@register("a7_preview", lambda: base("samples").sql(f"""
SELECT dataset, count(*) AS n, {r6('avg(x1)')} AS x1_mean, {r6('avg(x3)')} AS x3_mean
FROM samples WHERE dataset IN (SELECT DISTINCT dataset FROM samples ORDER BY dataset LIMIT 3)
GROUP BY dataset"""))
def a7_preview(spark, d):
    """The first three datasets in sorted order (data behind the check plot)."""
    p = RL.preview(V.samples(spark, d), 3)
    return p.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("x1").alias("x1_mean"),
                                    F.avg("x3").alias("x3_mean"))


# ---------------------------------------------------------------- B

@register("b1_function_type", lambda: base("scores").sql("""
SELECT name, nullif(regexp_extract(name, '_(linear|exponential|quadratic|cubic)', 1), '') AS function_type
FROM (SELECT DISTINCT dataset AS name FROM scores UNION SELECT DISTINCT model FROM scores) t"""))
def b1_function_type(spark, d):
    """B1: equation family from a name; no match -> NULL."""
    s = V.scores(spark, d)
    names = s.select(F.col("dataset").alias("name")).union(s.select(F.col("model").alias("name"))).distinct()
    return names.select("name", B.function_type("name").alias("function_type"))


@register("b2_to_numeric", lambda: f"""
SELECT event_type, count(*) AS n, count(v) AS n_numeric, {r6('avg(v)')} AS mean_value FROM (
  SELECT event_type, TRY_CAST(CASE WHEN event_type = 'error' THEN 'NA' ELSE json_extract_string(props, '$.k') END
         AS DOUBLE) AS v FROM events) t GROUP BY event_type""")
def b2_to_numeric(spark, d):
    """B2: tolerant coercion of a text column ('NA' -> NULL)."""
    ev = A.events_text(spark, d)
    return (ev.select("event_type", B.to_numeric("raw").alias("v")).groupBy("event_type")
              .agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_numeric"), F.avg("v").alias("mean_value")))


# Event-type labels (one type deliberately left unmapped).
EVENT_LABELS = {"click": "Click", "view": "Page view", "purchase": "Purchase", "signup": "Sign-up"}


@register("b4_map_labels", lambda: """
SELECT label, count(*) AS n FROM (SELECT CASE event_type """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_LABELS.items()) + """ END AS label FROM events) t GROUP BY label""")
def b4_map_labels(spark, d):
    """Code -> label map; unmapped codes -> NULL."""
    ev = V.table(spark, d, "events")
    return ev.select(B.map_labels("event_type", EVENT_LABELS).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))


@register("b5_binarize", lambda: """
SELECT CASE WHEN l_linenumber - 4 > 0 THEN 'presence' ELSE 'absence' END AS outcome, count(*) AS n
FROM lineitem GROUP BY 1""")
def b5_binarize(spark, d):
    """Binarise a count-like column into outcome text."""
    li = V.table(spark, d, "lineitem")
    return li.select(B.binarize(F.col("l_linenumber") - 4, 0, "presence", "absence").alias("outcome")).groupBy(
        "outcome").agg(F.count(F.lit(1)).alias("n"))


@register("b6_text_from_cols", lambda: base("samples").sql("""
SELECT concat_ws(' ', coalesce(cat1, 'nan'), coalesce(cat2, 'nan')) AS text, count(*) AS n FROM samples GROUP BY 1"""))
def b6_text_from_cols(spark, d):
    """Row text from the category columns."""
    s = V.samples(spark, d)
    return s.select(B.text_from_cols(["cat1", "cat2"]).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _sentence_sql() -> str:
    parts = []
    for c in ["slot", "qty", "flag"]:
        parts.append(f"CASE WHEN {c} IS NULL THEN 'nan {c}' WHEN {c} = 0 THEN 'no {c}' WHEN {c} = 1 THEN '{c}' "
                     f"ELSE CAST({c} AS VARCHAR) || ' {c}' END")
    return f"""
SELECT sentence, count(*) AS n FROM (
  SELECT concat_ws(' ', {', '.join(parts)}) AS sentence FROM (
    SELECT CAST(l_linenumber - 1 AS INTEGER) AS slot, CAST(l_quantity AS BIGINT) AS qty,
           CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS flag, 1 AS ca FROM lineitem) a) b
GROUP BY sentence"""


@register("b7_row_sentence", _sentence_sql)
def b7_row_sentence(spark, d):
    """Row -> sentence (0 -> 'no c', 1 -> 'c', missing -> 'nan c'); 'ca' skipped."""
    li = V.table(spark, d, "lineitem").select(
        (F.col("l_linenumber") - 1).cast("int").alias("slot"), F.col("l_quantity").cast("bigint").alias("qty"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("flag"),
        F.lit(1).alias("ca"))
    return li.select(B.row_sentence(["slot", "qty", "flag", "ca"]).alias("sentence")).groupBy("sentence").agg(
        F.count(F.lit(1)).alias("n"))


_LIST_SQL = """
SELECT equation, feats, count(*) AS n FROM (
  SELECT equation, array_to_string(list_filter(list_transform(string_split(raw, ','), lambda s: trim(s)),
         lambda s: s <> ''), ', ') AS feats FROM (
    SELECT equation, ' x1 ,' || cat1 || ', ,' || cat2 || ' ' AS raw FROM samples) a) b
GROUP BY equation, feats"""


def _list_frame(spark, d):
    s = V.samples(spark, d)
    return s.select("equation", F.concat(F.lit(" x1 ,"), F.col("cat1"), F.lit(", ,"), F.col("cat2"),
                                         F.lit(" ")).alias("raw"))


@register("b8_parse_list", lambda: base("samples").sql(_LIST_SQL))
def b8_parse_list(spark, d):
    """Split and trim a comma list (empty items dropped)."""
    s = _list_frame(spark, d).select("equation", B.parse_list("raw").alias("lst"))
    return s.groupBy("equation", F.array_join("lst", ", ").alias("feats")).agg(F.count(F.lit(1)).alias("n"))


@register("b9_join_list", lambda: base("samples").sql(_LIST_SQL))
def b9_join_list(spark, d):
    """Join a list for output."""
    s = _list_frame(spark, d).select("equation", B.join_list(B.parse_list("raw")).alias("feats"))
    return s.groupBy("equation", "feats").agg(F.count(F.lit(1)).alias("n"))


@register("b10_round_cols", lambda: base("samples").sql("""
SELECT dataset, round(avg(x3), 3) + 0.0 AS x3_mean, round(avg(x1), 4) + 0.0 AS x1_mean FROM samples GROUP BY dataset"""))
def b10_round_cols(spark, d):
    """Half-up rounding to 3 / 4 decimals at the output."""
    g = V.samples(spark, d).groupBy("dataset").agg(F.avg("x3").alias("x3_mean"), F.avg("x1").alias("x1_mean"))
    return B.round_cols(B.round_cols(g, ["x3_mean"], 3), ["x1_mean"], 4)


@register("b11_split_by_dtype", lambda: base("samples").sql(f"""
SELECT equation, {r6('sum(x1)')} AS x1, {r6('sum(x2)')} AS x2, {r6('sum(x3)')} AS x3, count(*) AS n
FROM samples GROUP BY equation"""))
def b11_split_by_dtype(spark, d):
    """Numeric-only view of a table, chosen from the schema."""
    s = V.samples(spark, d).select("equation", "x1", "x2", "x3", "cat1", "cat2")
    num, _other = B.split_by_dtype(s.drop("equation"))
    return s.groupBy("equation").agg(*[F.sum(c).alias(c) for c in num], F.count(F.lit(1)).alias("n"))


@register("b12_select_prefix", lambda: base("samples").sql(f"""
SELECT dataset, {r6('avg(x1)')} AS x1, {r6('avg(x2)')} AS x2, {r6('avg(x3)')} AS x3 FROM samples GROUP BY dataset"""))
def b12_select_prefix(spark, d):
    """Select the columns with a prefix (``x``)."""
    s = V.samples(spark, d)
    x = B.select_prefix(s.drop("dataset"), "x")
    return s.select("dataset", *x.columns).groupBy("dataset").agg(*[F.avg(c).alias(c) for c in x.columns])


@register("b13_better_flag", lambda: base("pairs").sql(f"""
SELECT coalesce(r2_assisted > r2_unassisted, false) AS r2_better,
       coalesce(mae_assisted < mae_unassisted, false) AS mae_better, count(*) AS n
FROM ({WIDE_PAIRS_SQL}) w GROUP BY 1, 2"""))
def b13_better_flag(spark, d):
    """Strict better flags (higher R2, lower MAE); ties are not better."""
    w = wide_pairs(spark, d)
    return w.groupBy(B.better_flag("r2_unassisted", "r2_assisted", True).alias("r2_better"),
                     B.better_flag("mae_unassisted", "mae_assisted", False).alias("mae_better")).agg(
        F.count(F.lit(1)).alias("n"))


# Chosen feature names per equation family (B14 / B15 fixtures).
CHOSEN = {"linear": ["x1", "x2"], "quadratic": ["x1"], "cubic": ["x2", "cat2"], "exponential": ["cat1"]}
REQUESTED = {"linear": ["x1", "x9", "x3"], "quadratic": ["x2", "cat1"], "cubic": ["cat2", "x1", "x3"],
             "exponential": ["cat1", "cat2", "x2"]}


def _chosen_col(mapping):
    out = None
    for eq, lst in mapping.items():
        arr = F.array(*[F.lit(x) for x in lst])
        out = F.when(F.col("equation") == eq, arr) if out is None else out.when(F.col("equation") == eq, arr)
    return out


def _chosen_sql(mapping):
    return "CASE equation " + " ".join(
        f"WHEN '{eq}' THEN [{', '.join(repr(x) for x in lst)}]" for eq, lst in mapping.items()) + " END"


def _b14_sql():
    q = base("samples")
    q.add("names", """SELECT DISTINCT dataset, equation, name FROM (
    SELECT dataset, equation, unnest(['x1', 'x2', 'cat1_' || cat1, 'cat2_' || cat2]) AS name FROM samples) u""")
    return q.sql(f"""SELECT dataset, name, len(list_filter({_chosen_sql(CHOSEN)}, lambda f: contains(name, f))) > 0
       AS keep FROM names""")


@register("b14_match_features", _b14_sql)
def b14_match_features(spark, d):
    """Keep an encoded feature when a chosen name is its substring."""
    s = V.samples(spark, d)
    names = s.select("dataset", "equation", F.explode(F.array(
        F.lit("x1"), F.lit("x2"), F.concat(F.lit("cat1_"), "cat1"), F.concat(F.lit("cat2_"), "cat2"))).alias("name")
    ).distinct()
    return names.select("dataset", "name", B.match_features(F.col("name"), _chosen_col(CHOSEN)).alias("keep"))



@register("b15_usable_features", lambda: base("samples").sql(f"""
SELECT DISTINCT dataset, array_to_string(list_sort(list_filter(list_distinct({_chosen_sql(REQUESTED)}),
       lambda f: list_contains(['x1', 'x2', 'x3', 'cat1', 'cat2'], f) AND f <> 'x3')), ',') AS usable
FROM samples"""))
def b15_usable_features(spark, d):
    """Requested features that exist, never the target."""
    s = V.samples(spark, d).select("dataset", "equation").distinct()
    avail = F.array(*[F.lit(c) for c in ["x1", "x2", "x3", "cat1", "cat2"]])
    u = B.usable_features(_chosen_col(REQUESTED), avail, "x3")
    return s.select("dataset", F.array_join(F.array_sort(u), ",").alias("usable"))


@register("b16_format_summary", lambda: base("scores").sql("""
SELECT model, printf('%.3f ± %.3f', avg(distance_correlation), stddev_samp(distance_correlation) / sqrt(count(*)))
       AS summary FROM scores GROUP BY model"""))
def b16_format_summary(spark, d):
    """B16: 'mean ± sem' annotation text."""
    g = ST.summarize(V.scores(spark, d), ["model"], ["distance_correlation"], ["mean", "sem"])
    return g.select("model", B.mean_pm("distance_correlation_mean", "distance_correlation_sem").alias("summary"))


@register("b17_math", lambda: base("samples").sql(f"""
SELECT equation, {r6('avg(sqrt(abs(x3)))')} AS root_abs, {r6('avg(pow(x1 - 50.0, 2))')} AS sq,
       {r6('avg(exp(x2 / 100.0))')} AS ex FROM samples GROUP BY equation"""))
def b17_math(spark, d):
    """Residual-style math (sqrt, abs, pow, exp)."""
    s = V.samples(spark, d)
    return s.groupBy("equation").agg(F.avg(F.sqrt(F.abs("x3"))).alias("root_abs"),
                                     F.avg(F.pow(F.col("x1") - 50.0, 2)).alias("sq"),
                                     F.avg(F.exp(F.col("x2") / 100.0)).alias("ex"))


# ---------------------------------------------------------------- C

@register("c1_quality_filter", lambda: base("pairs").sql("""
SELECT model, count(*) AS n FROM pairs WHERE r2 > 0.2 GROUP BY model"""))
def c1_quality_filter(spark, d):
    """Strict quality cut R2 > 0.2."""
    return RL.quality_filter(R.regression_pairs(spark, d), "r2", 0.2).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"))


@register("c2_inclusive_cut", lambda: base("pairs").sql(f"""
SELECT count(*) AS n FROM ({WIDE_PAIRS_SQL}) w WHERE r2_unassisted >= 0.2 AND r2_assisted >= 0.2"""))
def c2_inclusive_cut(spark, d):
    """Inclusive cut on both sides of a pair."""
    w = RL.quality_filter(RL.quality_filter(wide_pairs(spark, d), "r2_unassisted", 0.2, False),
                          "r2_assisted", 0.2, False)
    return w.agg(F.count(F.lit(1)).alias("n"))


@register("c3_cutoff_filter", lambda: base("meta").sql(f"""
SELECT dataset, {r6('subject_variable_ratio')} AS subject_variable_ratio, num_categorical_vars FROM meta
WHERE subject_variable_ratio >= 20 AND num_categorical_vars <= 25"""))
def c3_cutoff_filter(spark, d):
    """Metadata cut-offs SVR >= 20 and categories <= 25."""
    return RL.cutoff_filter(V.dataset_meta(spark, d)).select("dataset", "subject_variable_ratio",
                                                             "num_categorical_vars")


@register("c4_drop_missing", lambda: """
SELECT event_type, count(*) AS n FROM (
  SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events) t
WHERE value IS NOT NULL GROUP BY event_type""")
def c4_drop_missing(spark, d):
    """C4: drop rows with a missing value (NULLs injected for every 7th event)."""
    ev = V.table(spark, d, "events").select(
        "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return RL.drop_missing(ev, ["value"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("c5_min_group_size", lambda: base("scores").sql("""
SELECT s.model, count(*) AS n FROM scores s JOIN (
  SELECT dataset, model FROM scores GROUP BY dataset, model HAVING count(*) >= 5) k
  ON s.dataset = k.dataset AND s.model = k.model GROUP BY s.model"""))
def c5_min_group_size(spark, d):
    """Drop (dataset, model) groups with fewer than 5 rows."""
    return RL.min_group_size(V.scores(spark, d), ["dataset", "model"], 5).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"))


@register("c6_head_per_group", lambda: base("samples").sql(f"""
SELECT dataset, count(*) AS n, {r6('avg(x3)')} AS x3_mean FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ok, ln, pk) AS rn FROM samples) t
WHERE rn <= 300 GROUP BY dataset"""))
def c6_head_per_group(spark, d):
    """The first 300 rows of each dataset (the reference's sample cap)."""
    h = RL.head_per_group(V.samples(spark, d), ["dataset"], ["ok", "ln", "pk"], 300)
    return h.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("x3").alias("x3_mean"))


@register("c7_segment", lambda: base("pairs").sql(f"""
SELECT mae_assisted < mae_unassisted AS segment, count(*) AS n, {r6('avg(mae_assisted)')} AS mae_assisted
FROM ({WIDE_PAIRS_SQL}) w GROUP BY 1"""))
def c7_segment(spark, d):
    """Better / not-better as one grouping key."""
    w = RL.segment_flag(wide_pairs(spark, d), F.col("mae_assisted") < F.col("mae_unassisted"))
    return w.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("mae_assisted").alias("mae_assisted"))


@register("c8_min_classes", lambda: """
SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id)
WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source
                 HAVING count(DISTINCT quality) >= 2) GROUP BY source""")
def c8_min_classes(spark, d):
    """Skip groups whose label has fewer than 2 classes."""
    return RL.min_classes(V.docs(spark, d), ["source"], "quality").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- D

@register("d1_merge_results", lambda: base("pairs").sql(f"""
SELECT u.dataset, {r6('u.r2')} AS r2_unassisted, {r6('a.r2')} AS r2_assisted
FROM pairs u JOIN pairs a ON u.dataset = a.dataset WHERE u.model = 'unassisted' AND a.model = 'assisted'"""))
def d1_merge_results(spark, d):
    """Inner join of two result sets on dataset, suffixes on clashes."""
    p = R.regression_pairs(spark, d)
    un = p.where(F.col("model") == "unassisted").select("dataset", "r2")
    asd = p.where(F.col("model") == "assisted").select("dataset", "r2")
    # D1 as written by the reference: two result tables joined on the key
    return RL.merge_results(un, asd, ["dataset"], ("_unassisted", "_assisted"))


@register("d2_merge_with_metadata", lambda: base("pairs", "meta").sql(f"""
SELECT w.mae_assisted < w.mae_unassisted AS llm_better, count(*) AS n,
       {r6('avg(m.subject_variable_ratio)')} AS svr_mean
FROM ({WIDE_PAIRS_SQL}) w JOIN (SELECT meta.*, unnest(['cluster_m0', 'cluster_m1']) AS cluster FROM meta) m
  ON w.dataset = m.dataset GROUP BY 1"""))
def d2_merge_with_metadata(spark, d):
    """Pair table + metadata with one row per (dataset, cluster): rows fan out."""
    meta = V.dataset_meta(spark, d).withColumn("cluster", F.explode(F.array(F.lit("cluster_m0"), F.lit("cluster_m1"))))
    j = RL.merge_with_metadata(wide_pairs(spark, d), meta)
    return j.groupBy((F.col("mae_assisted") < F.col("mae_unassisted")).alias("llm_better")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("subject_variable_ratio").alias("svr_mean"))


@register("d3_join_embeddings", lambda: base("emb", "raw").sql(f"""
SELECT e.dataset, e.model, count(*) AS n, {r6('avg(r.x1 * e.embedding[1])')} AS x1_e1
FROM raw r JOIN emb e ON r.dataset = e.dataset AND r.row_id = e.row_id GROUP BY e.dataset, e.model"""))
def d3_join_embeddings(spark, d):
    """D3: match rows to their embeddings on (dataset, row_id)."""
    j = V.emb_raw(spark, d).join(V.emb_long(spark, d), ["dataset", "row_id"])
    return j.groupBy("dataset", "model").agg(F.count(F.lit(1)).alias("n"),
                                             F.avg(F.col("x1") * F.col("embedding")[0]).alias("x1_e1"))


@register("d5_semi_join", lambda: base("pairs").sql("""
SELECT dataset, count(*) AS n FROM sx WHERE dataset IN (SELECT dataset FROM pairs WHERE r2 > 0.6)
GROUP BY dataset"""))
def d5_semi_join(spark, d):
    """Keep the rows of datasets that have a result (R2 > 0.6)."""
    keys = R.regression_pairs(spark, d).where(F.col("r2") > 0.6)
    return RL.semi_join(V.samples(spark, d), keys, ["dataset"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@register("d6_pending", lambda: base("scores").sql("""
SELECT model, count(*) AS n FROM (SELECT DISTINCT dataset, model FROM scores) w
WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.dataset = w.dataset AND s.model = w.model
                  AND s.distance_correlation > 0.6) GROUP BY model"""))
def d6_pending(spark, d):
    """(dataset, model) work items not yet done (done = has a score above 0.6)."""
    s = V.scores(spark, d)
    work = s.select("dataset", "model").distinct()
    done = s.where(F.col("distance_correlation") > 0.6)
    return RL.pending(work, done).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@register("d7_pairwise", lambda: base("raw").sql(f"""
SELECT a.dataset, count(*) AS n_pairs,
       {r6('avg(sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) + (a.x3 - b.x3) * (a.x3 - b.x3)))')} AS mean_dist
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn FROM raw) t WHERE rn <= 300) a
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn FROM raw) t WHERE rn <= 300) b
  ON a.dataset = b.dataset AND a.row_id < b.row_id GROUP BY a.dataset"""))
def d7_pairwise(spark, d):
    """Row pairs i < j inside a dataset, first 300 rows."""
    raw = VX.as_vector(V.emb_raw(spark, d), ["x1", "x2", "x3"])
    p = VX.distance_pairs(raw, ["dataset"], "row_id", "vec", cap=300).where(F.col("w") == 2.0)
    return p.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("dist").alias("mean_dist"))


@register("d8_join_feature_lists", lambda: base("samples").sql(f"""
SELECT s.dataset, f.feature, count(*) AS n, {r6('avg(f_value)')} AS mean_value FROM (
  SELECT dataset, equation, unnest(['x1', 'x2']) AS feature, unnest([x1, x2]) AS f_value FROM samples) s
JOIN (SELECT DISTINCT dataset, unnest({_chosen_sql(CHOSEN)}) AS feature FROM samples) f
  ON s.dataset = f.dataset AND s.feature = f.feature GROUP BY s.dataset, f.feature"""))
def d8_join_feature_lists(spark, d):
    """Long feature table joined to each dataset's chosen feature list."""
    s = V.samples(spark, d)
    long = RL.melt(s.select("dataset", "x1", "x2"), ["dataset"], ["x1", "x2"], "feature", "f_value")
    lists = s.select("dataset", F.explode(_chosen_col(CHOSEN)).alias("feature")).distinct()
    return long.join(lists, ["dataset", "feature"]).groupBy("dataset", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("f_value").alias("mean_value"))
