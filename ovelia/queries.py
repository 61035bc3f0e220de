"""Registered queries over the driver's tables, and their SQL.

D is documents with labels (characters and words; toxic or not), L is lineitem (four numbers; returned or not),
E is embeddings (label 5 or not).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import uniform, uniform_sql
from .functions.stages import cut
from .operators import evaluate as ev
from .operators import measures as m
from .operators import samplers as sm
from .operators import structure as st
from .operators.distance import knn, ranges
from .plans import overlap as ov
from .plans.pipeline import TECHNIQUES, ImbalancedPipeline
from .sources import labelled as lb

_WORD = r"[^\x20\x09-\x0D]+"
#: Techniques of a table that are under way at once: most of a small one's time is making plans.
AT_ONCE = 4


def table_d(spark: SparkSession, sf: str, label: str = "toxic") -> DataFrame:
    """Characters and words of labelled documents; the narrow side of the join is read first and broadcast by its size."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("n_chars").cast("double").alias("a"), F.regexp_count("text", F.lit(_WORD)).cast("double").alias("b"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("label").cast("int").alias("label"), F.array("a", "b").alias("features"))


def table_q(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of D in three classes, by quality and toxicity: neither, one, both."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("n_chars").cast("double").alias("a"), F.regexp_count("text", F.lit(_WORD)).cast("double").alias("b"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (F.col("quality") + F.col("toxic")).cast("int").alias("label"))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "label", F.array("a", "b").alias("features"))


def table_l(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of lineitem; (l_orderkey, l_linenumber) is no key, so only order-free measures use it."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"))


def table_e(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.read.parquet(f"{sf}/embeddings.parquet")
    return x.select(F.col("vec_id").alias("id"), (F.col("label") == 5).cast("int").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))


def _nn(spark, sf, k=5):
    x = cut(table_d(spark, sf))
    return knn(x, k, scale=ranges(x))


def _near(spark, sf):
    return m.enemies(cut(table_d(spark, sf)))


def _on(f, table=table_d):
    """A query of a function of a table that passes over it a fixed number of times: its scans are pruned to what each needs."""
    return lambda s, d: f(table(s, d))


def _held(f, table=table_d):
    """A query of a function that rereads its table, in a loop or in blocks: the table is made once, in the checkpoint folder."""
    return lambda s, d: f(cut(table(s, d)))


def _sampled(make):
    return lambda s, d: make().resample(cut(table_d(s, d))).select("id", "label", "origin")


def _features(x: DataFrame, *names: str) -> DataFrame:
    return x.select(*names, F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[1], 6).alias("f1"))


def _wide(x: DataFrame, d: int = 10) -> DataFrame:
    return x.select("id", "label", *[F.round(F.col("features")[k], 6).alias(f"f{k}") for k in range(d)])


def _radius_stats(x: DataFrame) -> DataFrame:
    d = lb.width(x)
    return x.agg(*[F.round(f(F.col("features")[k]), 6).alias(f"{n}{k}") for k in range(d) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def _predictions(x: DataFrame) -> DataFrame:
    """Fixed scores, by hash: what metrics are computed from."""
    score = F.round(uniform(3, "score", "id") * 0.7 + F.col("label") * 0.3, 3)
    return ev.scored(x, score, 0.5)


# Starts of one clustering step, as in SQL below.
CENTRES = [[500.0, 100.0], [2000.0, 350.0], [6000.0, 1000.0]]


def _centres(values: list[list[float]]) -> list[tuple]:
    return [(i, round(float(c[0]), 3), round(float(c[1]), 3)) for i, c in enumerate(values)]


def _step(f):
    def query(s, d):
        x = cut(table_d(s, d).where("label = 0"))
        return s.createDataFrame(_centres(f(x)), "cluster int, f0 double, f1 double")

    return query


def _svm(x: DataFrame) -> DataFrame:
    return x.sparkSession.createDataFrame(sorted(ov.ComplexityMeasures(x).svm_reduction().items()), "label int, value double")


def _depth(x: DataFrame) -> DataFrame:
    return x.sparkSession.createDataFrame([(m.tree_depth(x), m.tree_depth(x, True))], "tree double, forest double")


def _analysis(x: DataFrame) -> DataFrame:
    a = ov.ComplexityMeasures(x).analyze_overlap()
    return x.sparkSession.createDataFrame([(float(a["n3"]["overall"]), float(a["t1"]["normalized"]), float(a["n1"]), a["interpretation"]["overall"], a["interpretation"]["recommendations"])], "n3 double, t1 double, n1 double, overall string, recommendations array<string>")


def techniques() -> dict[str, sm.Sampler]:
    """All techniques with their defaults."""
    return {n: make() for n, make in TECHNIQUES.items()}


def _resampled(x: DataFrame) -> DataFrame:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        results = {n: pool.submit(t.resample, x) for n, t in techniques().items()}
    return ov.resampling_table(x, {n: r.result() for n, r in results.items()})


def _compared(x: DataFrame) -> DataFrame:
    return ev.ModelEvaluator().compare(x, techniques(), "knn", AT_ONCE)


def _best(s: SparkSession, d: str) -> DataFrame:
    p = ImbalancedPipeline(s)
    x = cut(table_d(s, d))
    p.data = lb.standard_scaler(x).transform(x)
    p.apply_resampling_techniques()
    p.evaluate_techniques()
    return s.createDataFrame([(p.get_best_technique(),)], "technique string")


def _cv(x: DataFrame) -> DataFrame:
    r = ev.ModelEvaluator().cross_validate(x, sm.RandomUnderSampler(), "knn")
    return x.sparkSession.createDataFrame([(round(r["mean"], 6), round(r["std"], 6))], "mean double, std double")


def _n4(s, d):
    x = cut(table_d(s, d))
    return m.n4(x)


QUERIES = {
    # sources and preprocessing
    "class_distribution": _on(lb.class_distribution),
    "label_orient": _on(lambda x: lb.encode_label(x.withColumn("q", 1 - F.col("label")).drop("label"), "q")[0].select("id", "label")),
    "standardize_stats": _on(_radius_stats, table_l),
    "standardize": _on(lambda x: _features(lb.standard_scaler(x).transform(x), "id")),
    "inverse_scale": _on(lambda x: (lambda s: _features(s.inverse(s.transform(x)), "id"))(lb.standard_scaler(x))),
    "preview": _on(lambda x: _features(lb.preview(x, 7), "id", "label")),
    "minmax_scale": _on(lambda x: _features(lb.minmax_scaler(x).transform(x), "id")),
    "iqr_filter": _on(lambda x: sm.iqr_filter(x).select("id")),
    "iqr_filter_lineitem": _on(lambda x: sm.iqr_filter(x).groupBy("label").agg(F.count(F.lit(1)).alias("n")), table_l),
    "synthetic": lambda s, d: _wide(lb.synthetic(s)),
    "fraud_like": lambda s, d: _wide(lb.fraud_like(s)),
    "stratified_subset": _on(lambda x: lb.stratified_subset(x, 20).select("id", "label")),
    # feature measures
    "f1_fisher": _on(m.f1, table_l),
    "f1v": _on(lambda x: m.f1v(x.withColumn("features", F.slice("features", 1, 2))), table_l),
    "f1v_lineitem": _on(m.f1v, table_l),
    "f2_volume": _on(m.f2, table_l),
    "f3_efficiency": _on(m.f3, table_l),
    "f3_documents": _on(m.f3),
    "f4": _held(m.f4, table_l),
    "input_noise": _on(m.input_noise, table_l),
    "class_moments": _on(lambda x: _moments(x), table_l),
    # neighbours
    "heom_knn": lambda s, d: _nn(s, d),
    "n3": lambda s, d: m.n3(_nn(s, d, 1)),
    "n3_by_class": lambda s, d: m.n3(_nn(s, d, 1), 1, True),
    "n3_embeddings": lambda s, d: m.n3(m.neighbours(cut(table_e(s, d)), 1)),
    "kdn_embeddings": lambda s, d: m.kdn(m.neighbours(cut(table_e(s, d)))),
    "kdn": lambda s, d: m.kdn(_nn(s, d)),
    "cm": lambda s, d: m.cm(_nn(s, d)),
    "d3": lambda s, d: m.d3(_nn(s, d)),
    "si": lambda s, d: m.si(_nn(s, d, 1)),
    "deg_overlap": lambda s, d: m.deg_overlap(_nn(s, d)),
    "borderline": lambda s, d: m.borderline(_nn(s, d)),
    "borderline_tags": lambda s, d: m.borderline_tags(_nn(s, d)),
    "c1": lambda s, d: m.c1(_nn(s, d)),
    "c2": lambda s, d: m.c2(_nn(s, d)),
    **{f"{n}_by_class": lambda s, d, f=f: f(_nn(s, d), by_class=True) for n, f in (("kdn", m.kdn), ("cm", m.cm), ("deg_overlap", m.deg_overlap), ("c1", m.c1), ("c2", m.c2))},
    "si_by_class": lambda s, d: m.si(_nn(s, d, 1), 1, True),
    "n2_by_class": lambda s, d: m.n2(_near(s, d), True),
    "lsc_by_class": _held(lambda x: m.lsc(x, cut(m.enemies(x)), ranges(x), True)),
    "borderline_by_class": lambda s, d: m.borderline(_nn(s, d), True),
    "r_value_by_class": lambda s, d: m.r_by_class(_nn(s, d)),
    "r_value_of_pairs": _held(lambda x: m.r_pairs(m.neighbours(x)), table_q),
    "f2_by_class": _on(lambda x: m.f2(x, True), table_l),
    "f3_by_class": _on(lambda x: m.f3(x, True), table_l),
    "input_noise_by_class": _on(lambda x: m.input_noise(x, True), table_l),
    "instance_hardness": lambda s, d: m.instance_hardness(_nn(s, d, 1)),
    "r_value": lambda s, d: (lambda x: m.r_value(m.neighbours(x), {r["label"]: r["count"] for r in x.groupBy("label").count().collect()}))(cut(table_d(s, d))),
    "nearest_enemy": lambda s, d: _near(s, d).select(F.col("i").alias("id"), F.col("other_j").alias("enemy"), F.round("other_dist", 6).alias("dist")),
    "n2": lambda s, d: m.n2(_near(s, d)),
    "lsc": _held(lambda x: m.lsc(x, cut(m.enemies(x)), ranges(x))),
    "hypersphere_profile": _held(lambda x: m.hypersphere_profile(x, ranges(x))),
    "n4": _n4,
    # structure
    "n1_mst": _held(st.n1),
    "t1": _held(st.t1),
    "clust": _held(st.clust),
    "onb": _held(st.onb),
    "dbc": _held(st.dbc),
    "nsg": _held(st.nsg),
    "icsv": _held(st.icsv),
    "mrca": _held(st.mrca),
    "purity": _held(st.purity_curve),
    "purity_index": _held(st.purity),
    "neigh_sep": _held(st.neighbourhood_separability),
    "svm_reduction": _held(_svm),
    "tree_depth": _held(_depth),
    "analyze_overlap": _held(_analysis),
    "compare_pre_post": _held(lambda x: ov.compare_pre_post(x, sm.NBUS("basic").resample(x))),
    "overlap_picture": _held(ov.overlap_picture, table_e),
    "overlap_picture_after": _held(lambda x: ov.overlap_picture(sm.RandomUnderSampler().resample(x), source=x).select("id", "label", "pc", F.round("value", 6).alias("value"))),
    "hardness_picture": _held(lambda x: ov.ComplexityMeasures(x).hardness_picture(), table_e),
    "measure_table": _held(lambda x: ov.ComplexityMeasures(x).table()),
    "resampling_table": _held(_resampled),
    # overlap regions
    "tomek_links": _held(sm.tomek_links),
    "tomek_like_pairs": _held(sm.tomek_like_pairs),
    "overlap_region": _held(sm.overlap_region),
    "density_peaks": _held(lambda x: sm.density_peaks(x.where("label = 1"))),
    # resamplers
    "ros": _sampled(sm.RandomOverSampler),
    "rus": _sampled(sm.RandomUnderSampler),
    "nus": _sampled(sm.NUS),
    "urns": _sampled(sm.URNS),
    "nb_basic": _sampled(lambda: sm.NBUS("basic")),
    "nb_tomek": _sampled(lambda: sm.NBUS("tomek")),
    "nb_comm": _sampled(lambda: sm.NBUS("common")),
    "nb_rec": _sampled(lambda: sm.NBUS("recursive")),
    "smote": lambda s, d: _features(sm.SMOTE().resample(cut(table_d(s, d))).where("origin = 'synth'"), "id"),
    "blsmote1": lambda s, d: _features(sm.BorderlineSMOTE().resample(cut(table_d(s, d))).where("origin = 'synth'"), "id"),
    "hkm_step": _step(lambda x: sm.hard_step(x, CENTRES)),
    "fcm_step": _step(lambda x: sm.fuzzy_step(x, CENTRES)),
    "rkm_step": _step(lambda x: sm.rough_step(x, CENTRES, 0.95, 200.0)),
    "frkm_step": _step(lambda x: sm.rough_step(x, CENTRES, 0.95, 200.0, 2.0)),
    "hkm": _sampled(lambda: sm.KMeansUndersampling("HKM")),
    "fcm": _sampled(lambda: sm.KMeansUndersampling("FCM")),
    "rkm": _sampled(lambda: sm.KMeansUndersampling("RKM")),
    "frkm": _sampled(lambda: sm.KMeansUndersampling("FRKM")),
    "odbot": _sampled(sm.ODBOT),
    "fcm_boost": _sampled(sm.FCMBoostOBU),
    "rfcl": _sampled(sm.RFCL),
    "ehso": _sampled(sm.EHSO),
    "devi_ocsvm": _sampled(sm.DeviOCSVM),
    "svddwsmote": _sampled(sm.SVDDWSMOTE),
    "osm": _sampled(sm.OSM),
    # evaluation
    "stratified_split": _on(lambda x: ev.stratified_split(x).select("id", "label", "is_test")),
    "kfold": _on(lambda x: ev.kfold(x).select("id", "label", "fold")),
    "metrics_from_predictions": _on(lambda x: ev.metrics(_predictions(x), 6)),
    "confusion_matrix": _on(lambda x: ev.confusion(_predictions(x))),
    "knn_classify": _held(lambda x: (lambda y: ev.knn_predict(y.where("not is_test"), y.where("is_test")))(cut(ev.stratified_split(x)))),
    "technique_compare": _held(_compared),
    "cross_validate": _held(_cv),
    "pipeline_best": _best,
    **{f"classify_{c}": _held(lambda x, c=c: (lambda y: ev.metrics(ev.fit_predict(y.where("not is_test"), y.where("is_test"), c)))(cut(ev.stratified_split(x)))) for c in ("decision_tree", "random_forest", "logistic_regression", "naive_bayes", "svm")},
}


def _moments(x: DataFrame) -> DataFrame:
    d = lb.width(x)
    r = lambda c, k, n: F.round(F.col(c)[k], 6).alias(f"{n}{k}")
    return m.class_moments(x).select("label", "n", *[r(c, k, c) for k in range(d) for c in ("mean", "var", "lo", "hi")])


# --- SQL ------------------------------------------------------------------------------------------------------------

_D = rf"""D AS (SELECT d.doc_id AS id, l.toxic::INT AS label, d.n_chars::DOUBLE AS f0, len(regexp_extract_all(d.text, '{_WORD}'))::DOUBLE AS f1
  FROM documents d JOIN labels l USING (doc_id))"""
_L = """L AS (SELECT (l_returnflag = 'R')::INT AS label, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3 FROM lineitem)"""
_R = "R AS (SELECT CASE WHEN max(f0) > min(f0) THEN max(f0) - min(f0) ELSE 1 END AS r0, CASE WHEN max(f1) > min(f1) THEN max(f1) - min(f1) ELSE 1 END AS r1 FROM D)"
_HEOM = "round(sqrt(((a.f0 - b.f0) / r0) * ((a.f0 - b.f0) / r0) + ((a.f1 - b.f1) / r1) * ((a.f1 - b.f1) / r1)), 9)"
_EUCLID = "round(sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)), 9)"
_P = f"{_D}, {_R}, P AS (SELECT a.id AS i, a.label AS yi, b.id AS j, b.label AS yj, {_HEOM} AS dist FROM D a JOIN D b ON a.id <> b.id, R)"
_K = f"{_P}, K AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM P)"
_U = f"{_D}, P AS (SELECT a.id AS i, a.label AS yi, b.id AS j, b.label AS yj, {_EUCLID} AS dist FROM D a JOIN D b ON a.id <> b.id), K AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM P)"
_OWN = f"WITH {_K}, O AS (SELECT i, yi, count(*) AS k, sum((yi = yj)::INT) AS own FROM K WHERE rk <= 5 GROUP BY ALL) "
_V = f"WITH {_K}, V AS (SELECT i, yi, max((yi = yj)::INT) AS own FROM K WHERE rk <= 1 GROUP BY ALL) "
_ENEMY = f"WITH {_P}, N AS (SELECT i, yi, min(CASE WHEN yi = yj THEN dist END) AS s, min(CASE WHEN yi <> yj THEN dist END) AS o FROM P GROUP BY ALL) "
_KNBUS = "CAST(floor(sqrt((SELECT count(*) FROM D)) + (SELECT sum((label = 0)::INT) / sum((label = 1)::INT) FROM D)) AS INT)"
_KEPT = "SELECT id, label, 'orig' AS origin FROM D WHERE id NOT IN (SELECT id FROM G)"
_EMB = """E AS (SELECT vec_id AS id, (label = 5)::INT AS label, embedding::DOUBLE[] AS x FROM embeddings),
 U AS (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM E),
 S AS (SELECT k, max(v) - min(v) AS r FROM U GROUP BY k),
 Z AS (SELECT id, label, list(v / CASE WHEN r > 0 THEN r ELSE 1 END ORDER BY k) AS z FROM U JOIN S USING (k) GROUP BY id, label),
 P AS (SELECT a.id AS i, a.label AS yi, b.id AS j, b.label AS yj, round(list_distance(a.z, b.z), 9) AS dist FROM Z a JOIN Z b ON a.id <> b.id),
 K AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM P)"""
_F = [f"f{k}" for k in range(4)]
_LB = f"WITH {_L}, B AS (SELECT {', '.join(f'greatest(min({f}) FILTER (label = 0), min({f}) FILTER (label = 1)) AS lo{k}, least(max({f}) FILTER (label = 0), max({f}) FILTER (label = 1)) AS hi{k}, max({f}) - min({f}) AS w{k}' for k, f in enumerate(_F))} FROM L) "
_DIST = [f"greatest(sqrt((f0 - {a}) * (f0 - {a}) + (f1 - {b}) * (f1 - {b})), 1e-10)" for a, b in CENTRES]
_MU = ", ".join(f"1 / ({' + '.join(f'(d{i} / d{j}) ^ 2' for j in range(3))}) AS mu{i}" for i in range(3))
_STEP = f"WITH {_D}, X AS (SELECT *, {', '.join(f'{d} AS d{i}' for i, d in enumerate(_DIST))} FROM D WHERE label = 0), M AS (SELECT *, least(d0, d1, d2) AS dn, {_MU} FROM X), "
_ROUGH = "T AS (SELECT *, (d0 - dn <= 200)::INT AS u0, (d1 - dn <= 200)::INT AS u1, (d2 - dn <= 200)::INT AS u2 FROM M), "


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _rough_sql(weighted: bool) -> str:
    parts = []
    for i in range(3):
        w = f"mu{i} * mu{i} * " if weighted else ""
        low, up = f"u{i} = 1 AND u0 + u1 + u2 = 1", f"u{i} = 1 AND u0 + u1 + u2 > 1"
        mean = lambda f, c: f"(sum({w}{f}) FILTER ({c}) / count(*) FILTER ({c}))"  # noqa: E731, B023
        both = lambda f: f"round(coalesce(0.95 * {mean(f, low)} + (1 - 0.95) * {mean(f, up)}, {mean(f, low)}, {mean(f, up)}, {CENTRES[i][int(f[1])]}), 3) AS {f}"  # noqa: E731, B023
        parts.append(f"SELECT {i}::INT AS cluster, {both('f0')}, {both('f1')} FROM T")
    return _STEP + _ROUGH.rstrip(", ") + " " + _union(parts)


def _rank(salt: str, seed: int = 42) -> str:
    return f"WITH {_D}, N AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(seed, salt, 'id')}, id) - 1 AS n, count(*) OVER (PARTITION BY label) AS m FROM D) "


_SPLIT = _rank("split") + ", Y AS (SELECT id, label, n < round(m * 0.3) AS is_test FROM N)"
_MINN = "Q AS (SELECT i, yi, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM P WHERE yi = 1 AND yj = 1)"
_METRIC = f"""WITH {_D}, S AS (SELECT label, round({uniform_sql(3, 'score', 'id')} * 0.7 + label * 0.3, 3) AS score FROM D),
 Y AS (SELECT label, score, (score > 0.5)::INT AS prediction FROM S)"""
_C = ", C AS (SELECT sum((label = 1 AND prediction = 1)::INT) AS tp, sum((label = 0 AND prediction = 1)::INT) AS fp, sum((label = 0 AND prediction = 0)::INT) AS tn, sum((label = 1 AND prediction = 0)::INT) AS fn FROM Y)"

def _normal_sql(seed: int, salt: str, row: str) -> str:
    a, b = uniform_sql(seed, f"{salt}a", row), uniform_sql(seed, f"{salt}b", row)
    return f"(sqrt(-2 * ln(greatest({a}, 1e-300))) * cos(2 * 3.141592653589793 * {b}))"


def _generated_sql(name: str) -> str:
    if name == "fraud_like":
        cells = [f"round({_normal_sql(42, f'v{k}', 'id')} * CASE WHEN label = 1 THEN 1.5 ELSE 1 END + label * 0.5, 6) AS f{k}" for k in range(10)]
        return f"SELECT id, label, {', '.join(cells)} FROM (SELECT id, (id >= 500)::INT AS label FROM range(550) AS t(id))"
    cells = []
    for k in range(10):
        centre = f"(t * 2 - 1) * {1.0 if k % 2 == 0 else 0.5} + (s * 2 - 1) * {0.8 if k % 2 else -0.3}" if k < 8 else "0"
        cells.append(f"round({_normal_sql(42, f'x{k}', 'id')} + ({centre}), 6) AS f{k}")
    label = f"CASE WHEN {uniform_sql(42, 'flip', 'id')} < 0.3 THEN ({uniform_sql(42, 'new', 'id')} < 83 / 500)::INT ELSE t END"
    return f"SELECT id, {label} AS label, {', '.join(cells)} FROM (SELECT id, (id < 83)::INT AS t, (id % 2)::INT AS s FROM range(500) AS t(id))"


SQL = {
    "class_distribution": f"WITH {_D}, C AS (SELECT label, count(*) AS n FROM D GROUP BY label) SELECT label, n, round(n / (SELECT sum(n) FROM C), 6) AS share, (SELECT sum(n) FROM C)::BIGINT AS n_samples, (SELECT count(*) FROM C) AS n_classes, round((SELECT max(n) / min(n) FROM C), 6) AS imbalance_ratio, (SELECT label FROM C ORDER BY n DESC, label LIMIT 1) AS majority, (SELECT label FROM C ORDER BY n, label DESC LIMIT 1) AS minority FROM C",
    "label_orient": f"WITH {_D} SELECT id, label FROM D",
    "standardize_stats": f"WITH {_L} SELECT {', '.join(f'round(avg({f}), 6) AS mean{k}, round(stddev_pop({f}), 6) AS sd{k}' for k, f in enumerate(_F))} FROM L",
    "standardize": f"WITH {_D} SELECT id, {', '.join(f'round(({f} - (SELECT avg({f}) FROM D)) / (SELECT stddev_pop({f}) FROM D), 6) AS {f}' for f in _F[:2])} FROM D",
    "minmax_scale": f"WITH {_D} SELECT id, {', '.join(f'round(({f} - (SELECT min({f}) FROM D)) / (SELECT max({f}) - min({f}) FROM D), 6) AS {f}' for f in _F[:2])} FROM D",
    "iqr_filter": f"WITH {_D}, Q AS (SELECT quantile_cont(f0, 0.25) AS a0, quantile_cont(f0, 0.75) AS b0, quantile_cont(f1, 0.25) AS a1, quantile_cont(f1, 0.75) AS b1 FROM D) SELECT id FROM D, Q WHERE f0 BETWEEN a0 - 1.5 * (b0 - a0) AND b0 + 1.5 * (b0 - a0) AND f1 BETWEEN a1 - 1.5 * (b1 - a1) AND b1 + 1.5 * (b1 - a1)",
    "iqr_filter_lineitem": f"WITH {_L}, Q AS (SELECT {', '.join(f'quantile_cont({f}, 0.25) AS a{k}, quantile_cont({f}, 0.75) AS b{k}' for k, f in enumerate(_F))} FROM L) SELECT label, count(*) AS n FROM L, Q WHERE {' AND '.join(f'{f} BETWEEN a{k} - 1.5 * (b{k} - a{k}) AND b{k} + 1.5 * (b{k} - a{k})' for k, f in enumerate(_F))} GROUP BY label",
    "stratified_subset": f"WITH {_D} SELECT id, label FROM D WHERE label <> 1 UNION ALL SELECT id, label FROM (SELECT * FROM D WHERE label = 1 ORDER BY {uniform_sql(42, 'subset', 'id')}, id LIMIT 20)",
    "class_moments": f"WITH {_L} SELECT label, count(*) AS n, {', '.join(f'round(avg({f}), 6) AS mean{k}, round(var_pop({f}), 6) AS var{k}, min({f}) AS lo{k}, max({f}) AS hi{k}' for k, f in enumerate(_F))} FROM L GROUP BY label",
    "f1_fisher": f"WITH {_L}, M AS (SELECT label, {', '.join(f'avg({f}) AS m{k}, var_pop({f}) AS v{k}' for k, f in enumerate(_F))} FROM L GROUP BY label) " + _union(f"SELECT {k}::INT AS feature, round(1 / (1 + coalesce((a.m{k} - b.m{k}) ^ 2 / nullif(a.v{k} + b.v{k}, 0), 0)), 6) AS value FROM M a, M b WHERE a.label = 0 AND b.label = 1" for k in range(4)),
    "f2_volume": _LB + f"SELECT 0::INT AS a, 1::INT AS b, round({' * '.join(f'coalesce(greatest(0, hi{k} - lo{k}) / nullif(w{k}, 0), 0)' for k in range(4))}, 6) AS value FROM B",
    "f3_efficiency": _LB + f"SELECT 0::INT AS a, 1::INT AS b, round(least({', '.join(f'sum(({f} BETWEEN lo{k} AND hi{k})::INT)' for k, f in enumerate(_F))}) / count(*), 6) AS value FROM L, B",
    "f3_documents": f"WITH {_D}, B AS (SELECT {', '.join(f'greatest(min({f}) FILTER (label = 0), min({f}) FILTER (label = 1)) AS lo{k}, least(max({f}) FILTER (label = 0), max({f}) FILTER (label = 1)) AS hi{k}' for k, f in enumerate(_F[:2]))} FROM D) SELECT 0::INT AS a, 1::INT AS b, round(least({', '.join(f'sum(({f} BETWEEN lo{k} AND hi{k})::INT)' for k, f in enumerate(_F[:2]))}) / count(*), 6) AS value FROM D, B",
    "input_noise": f"WITH {_L}, M AS (SELECT label, {', '.join(f'min({f}) AS lo{k}, max({f}) AS hi{k}' for k, f in enumerate(_F))} FROM L GROUP BY label) SELECT round(sum({' + '.join(f'({f} > lo{k} AND {f} < hi{k})::INT' for k, f in enumerate(_F))}) / ((SELECT count(*) FROM L) * 4), 6) AS value FROM L JOIN M ON L.label <> M.label",
    "heom_knn": f"WITH {_K} SELECT i, yi, rk::INT AS rk, j, yj, dist FROM K WHERE rk <= 5",
    "n3": _V + "SELECT round(avg(1 - own), 6) AS value FROM V",
    "n3_by_class": _V + "SELECT yi AS label, round(avg(1 - own), 6) AS value FROM V GROUP BY yi",
    "si": _V + "SELECT round(avg(own), 6) AS value FROM V",
    "instance_hardness": _V + "SELECT i AS id, round(1.0 - own, 6)::DOUBLE AS value FROM V",
    "n3_embeddings": f"WITH {_EMB} SELECT round(avg((yi <> yj)::INT), 6) AS value FROM K WHERE rk = 1",
    "kdn_embeddings": f"WITH {_EMB} SELECT round(avg(v), 6) AS value FROM (SELECT i, avg((yi <> yj)::INT) AS v FROM K WHERE rk <= 5 GROUP BY i)",
    "kdn": _OWN + "SELECT round(avg(1 - own / k), 6) AS value FROM O",
    "cm": _OWN + "SELECT round(avg((1 - own / k > 0.5)::INT), 6) AS value FROM O",
    "d3": _OWN + "SELECT yi AS label, sum((own / k < 0.5)::INT)::BIGINT AS value FROM O GROUP BY yi",
    "deg_overlap": _OWN + "SELECT round(avg((own < k)::INT), 6) AS value FROM O",
    "borderline": _OWN + "SELECT round(avg((k - own <= 1)::INT), 6) AS safe, round(avg((k - own BETWEEN 2 AND 3)::INT), 6) AS borderline, round(avg((k - own = 4)::INT), 6) AS rare, round(avg((k - own = 5)::INT), 6) AS outlier FROM O",
    "borderline_tags": _OWN + "SELECT i AS id, yi AS label, CASE WHEN k - own <= 1 THEN 'safe' WHEN k - own <= 3 THEN 'borderline' WHEN k - own = 4 THEN 'rare' ELSE 'outlier' END AS tag FROM O",
    "r_value": _OWN + ", W AS (SELECT yi, avg((k - own > 2)::INT) AS r, count(*) AS n FROM O GROUP BY yi) SELECT round((a.r + (a.n / b.n) * b.r) / (a.n / b.n + 1), 6) AS value FROM W a, W b WHERE a.n > b.n",
    "c1": f"WITH {_K}, S AS (SELECT i, sum((yi = yj)::INT) OVER (PARTITION BY i ORDER BY rk) / rk AS s FROM K WHERE rk <= 5) SELECT round(avg(v), 6) AS value FROM (SELECT i, 1 - avg(s) AS v FROM S GROUP BY i)",
    "c2": f"WITH {_K}, S AS (SELECT i, sum(CASE WHEN yi = yj THEN 1 - least(dist, 1) ELSE 0 END) OVER (PARTITION BY i ORDER BY rk) / rk AS s FROM K WHERE rk <= 5) SELECT round(avg(v), 6) AS value FROM (SELECT i, 1 - avg(s) AS v FROM S GROUP BY i)",
    "kdn_by_class": _OWN + "SELECT yi AS label, round(avg(1 - own / k), 6) AS value FROM O GROUP BY yi",
    "cm_by_class": _OWN + "SELECT yi AS label, round(avg((1 - own / k > 0.5)::INT), 6) AS value FROM O GROUP BY yi",
    "deg_overlap_by_class": _OWN + "SELECT yi AS label, round(avg((own < k)::INT), 6) AS value FROM O GROUP BY yi",
    "si_by_class": _V + "SELECT yi AS label, round(avg(own), 6) AS value FROM V GROUP BY yi",
    "c1_by_class": f"WITH {_K}, S AS (SELECT i, yi, sum((yi = yj)::INT) OVER (PARTITION BY i ORDER BY rk) / rk AS s FROM K WHERE rk <= 5) SELECT yi AS label, round(avg(v), 6) AS value FROM (SELECT i, yi, 1 - avg(s) AS v FROM S GROUP BY ALL) GROUP BY yi",
    "c2_by_class": f"WITH {_K}, S AS (SELECT i, yi, sum(CASE WHEN yi = yj THEN 1 - least(dist, 1) ELSE 0 END) OVER (PARTITION BY i ORDER BY rk) / rk AS s FROM K WHERE rk <= 5) SELECT yi AS label, round(avg(v), 6) AS value FROM (SELECT i, yi, 1 - avg(s) AS v FROM S GROUP BY ALL) GROUP BY yi",
    "n2_by_class": _ENEMY + ", T AS (SELECT yi, sum(s) / sum(o) AS r FROM N GROUP BY yi) SELECT yi AS label, round(r / (1 + r), 6) AS value FROM T",
    "lsc_by_class": _ENEMY + ", Z AS (SELECT N.i, N.yi, (N.o > 0)::INT + coalesce(sum((P.yi = P.yj AND dist < o)::INT), 0) AS size FROM N JOIN P USING (i) GROUP BY N.i, N.yi, N.o) SELECT yi AS label, round(1 - sum(size) / (count(*) * count(*)), 6) AS value FROM Z GROUP BY yi",
    "borderline_by_class": _OWN + "SELECT yi AS label, round(avg((k - own <= 1)::INT), 6) AS safe, round(avg((k - own BETWEEN 2 AND 3)::INT), 6) AS borderline, round(avg((k - own = 4)::INT), 6) AS rare, round(avg((k - own = 5)::INT), 6) AS outlier FROM O GROUP BY yi",
    "r_value_by_class": _OWN + "SELECT yi AS label, round(avg((k - own > 2)::INT), 6) AS value FROM O GROUP BY yi",
    "r_value_of_pairs": "WITH " + _K.replace("l.toxic::INT", "(l.quality + l.toxic)::INT") + ", O AS (SELECT i, yi, c.label AS other, sum((yj = c.label)::INT) AS n FROM K, (SELECT DISTINCT label FROM D) c WHERE rk <= 5 GROUP BY ALL), S AS (SELECT yi, other, avg((n > 2)::INT) AS r, count(*) AS m FROM O GROUP BY ALL) SELECT a.yi AS a, a.other AS b, round(CASE WHEN a.m > b.m THEN (a.r + (a.m / b.m) * b.r) / (a.m / b.m + 1) ELSE (b.r + (b.m / a.m) * a.r) / (b.m / a.m + 1) END, 6) AS value FROM S a JOIN S b ON a.yi = b.other AND a.other = b.yi WHERE a.yi < a.other",
    "f2_by_class": _LB + ", W AS (SELECT label, " + ", ".join(f"max({f}) - min({f}) AS s{k}" for k, f in enumerate(_F)) + " FROM L GROUP BY label) SELECT 0::INT AS a, 1::INT AS b, label, round(" + " * ".join(f"coalesce(greatest(0, hi{k} - lo{k}) / nullif(s{k}, 0), 0)" for k in range(4)) + ", 6) AS value FROM W, B",
    "f3_by_class": _LB + "SELECT 0::INT AS a, 1::INT AS b, label, round(least(" + ", ".join(f"sum(({f} BETWEEN lo{k} AND hi{k})::INT)" for k, f in enumerate(_F)) + ") / count(*), 6) AS value FROM L, B GROUP BY label",
    "input_noise_by_class": f"WITH {_L}, M AS (SELECT label, {', '.join(f'min({f}) AS lo{k}, max({f}) AS hi{k}' for k, f in enumerate(_F))} FROM L GROUP BY label) SELECT L.label, round(sum({' + '.join(f'({f} > lo{k} AND {f} < hi{k})::INT' for k, f in enumerate(_F))}) / (count(*) * 4), 6) AS value FROM L JOIN M ON L.label <> M.label GROUP BY L.label",
    "f1v": f"WITH {_L}, M AS (SELECT label, count(*) AS n, {', '.join(f'avg({f}) AS m{k}' for k, f in enumerate(_F[:2]))}, {', '.join(f'covar_samp({_F[a]}, {_F[b]}) AS c{a}{b}' for a in range(2) for b in range(a, 2))} FROM L GROUP BY label), W AS (SELECT p.m0 - q.m0 AS d0, p.m1 - q.m1 AS d1, " + ", ".join(f"(p.n * p.c{x} + q.n * q.c{x}) / (p.n + q.n) AS w{x}" for x in ("00", "01", "11")) + " FROM M p, M q WHERE p.label = 0 AND q.label = 1), T AS (SELECT (d0 * d0 * w11 - 2 * d0 * d1 * w01 + d1 * d1 * w00) / (w00 * w11 - w01 * w01) AS r FROM W) SELECT 0::INT AS a, 1::INT AS b, round(1 / (1 + r), 6) AS value FROM T",
    "synthetic": _generated_sql("synthetic"),
    "fraud_like": _generated_sql("fraud_like"),
    "nearest_enemy": f"WITH {_P}, N AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM P WHERE yi <> yj) SELECT i AS id, j AS enemy, round(dist, 6) AS dist FROM N WHERE rk = 1",
    "n2": _ENEMY + ", T AS (SELECT sum(s) / sum(o) AS r FROM N) SELECT round(r / (1 + r), 6) AS value FROM T",
    "lsc": _ENEMY + "SELECT round(1 - ((SELECT count(*) FROM N WHERE o > 0) + (SELECT count(*) FROM P JOIN N USING (i) WHERE P.yi = P.yj AND dist < o)) / ((SELECT count(*) FROM D) ^ 2), 6) AS value",
    "hypersphere_profile": f"WITH {_P}, " + "A AS (SELECT i, yi, j, yj, dist FROM P UNION ALL SELECT id, label, id, label, 0 FROM D) SELECT i AS id, yi AS label, " + ", ".join(f"round((CASE WHEN yi = 1 THEN 1 ELSE -1 END) * sum(CASE WHEN dist > {r} THEN 0 WHEN yi = yj THEN 1 ELSE -1 END) / sum((dist <= {r})::INT), 6) AS psi_{k}" for k, r in enumerate((0.25, 0.5, 0.75))) + " FROM A GROUP BY i, yi",
    "tomek_links": f"WITH {_U} SELECT a.i AS min_id, a.j AS maj_id FROM K a JOIN K b ON a.i = b.j AND a.j = b.i WHERE a.rk = 1 AND b.rk = 1 AND a.yi = 1 AND a.yj = 0",
    "tomek_like_pairs": f"WITH {_U}, N AS (SELECT i, yi, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS r FROM P WHERE yi <> yj) SELECT a.i AS min_id, a.j AS maj_id FROM N a JOIN N b ON a.i = b.j AND a.j = b.i WHERE a.r = 1 AND b.r = 1 AND a.yi = 1",
    "overlap_region": f"WITH {_U} SELECT DISTINCT i AS id FROM K WHERE rk <= 5 AND yi = 0 AND yj = 1",
    "ros": f"WITH {_D}, N AS (SELECT id, label, row_number() OVER (ORDER BY id) - 1 AS n FROM D WHERE label = 1), G AS (SELECT unnest(range((SELECT sum((label = 0)::INT) - sum((label = 1)::INT) FROM D)::BIGINT)) AS g) SELECT id, label, 'orig' AS origin FROM D UNION ALL SELECT N.id, N.label, 'dup' FROM G JOIN N ON N.n = floor({uniform_sql(42, 'ros', 'g')} * (SELECT count(*) FROM N))::BIGINT",
    "rus": f"WITH {_D} SELECT id, label, 'orig' AS origin FROM D WHERE label = 1 UNION ALL SELECT id, label, 'orig' FROM (SELECT id, label, row_number() OVER (ORDER BY {uniform_sql(42, 'rus', 'id')}, id) AS n FROM D WHERE label = 0) WHERE n <= (SELECT count(*) FROM D WHERE label = 1)",
    "nus": f"WITH {_U}, Q AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS r FROM P WHERE yi = 1 AND yj = 0), T AS (SELECT *, median(dist) OVER (PARTITION BY i) AS t FROM Q WHERE r <= least(floor(sqrt((SELECT count(*) FROM D WHERE label = 0))), 50)), G AS (SELECT j AS id FROM T WHERE dist <= t GROUP BY j HAVING count(*) >= 2) {_KEPT}",
    "urns": f"WITH {_U}, KK AS (SELECT * FROM K WHERE rk <= CAST(floor(sqrt((SELECT count(*) FROM D)) + sqrt((SELECT sum((label = 0)::INT) / sum((label = 1)::INT) FROM D))) AS INT)), A AS (SELECT j AS id FROM KK WHERE yi = 1 AND yj = 0 GROUP BY j HAVING count(*) >= 2), B AS (SELECT j AS id FROM KK WHERE i IN (SELECT id FROM A) AND yj = 0 GROUP BY j HAVING count(*) >= 2), G AS (SELECT id FROM A UNION SELECT id FROM B) {_KEPT}",
    "nb_basic": f"WITH {_U}, G AS (SELECT DISTINCT i AS id FROM K WHERE rk <= {_KNBUS} AND yi = 0 AND yj = 1) {_KEPT}",
    "nb_tomek": f"WITH {_U}, KK AS (SELECT i, yi, j, yj FROM K WHERE rk <= {_KNBUS}), G AS (SELECT DISTINCT a.i AS id FROM KK a JOIN KK b ON a.i = b.j AND a.j = b.i WHERE a.yi = 0 AND a.yj = 1) {_KEPT}",
    "nb_comm": f"WITH {_U}, G AS (SELECT j AS id FROM K WHERE rk <= {_KNBUS} AND yi = 1 AND yj = 0 GROUP BY j HAVING count(*) > 1) {_KEPT}",
    "nb_rec": f"WITH {_U}, KK AS (SELECT i, yi, j, yj FROM K WHERE rk <= {_KNBUS}), A AS (SELECT j AS id FROM KK WHERE yi = 1 AND yj = 0 GROUP BY j HAVING count(*) > 1), B AS (SELECT j AS id FROM KK WHERE i IN (SELECT id FROM A) AND yj = 0 GROUP BY j HAVING count(*) > 1), G AS (SELECT id FROM A UNION SELECT id FROM B) {_KEPT}",
    "smote": f"WITH {_U}, {_MINN}, J AS (SELECT i, list(j ORDER BY rk) AS js FROM Q WHERE rk <= 5 GROUP BY i), N AS (SELECT D.*, js, row_number() OVER (ORDER BY id) - 1 AS n FROM D JOIN J ON id = i), G AS (SELECT unnest(range((SELECT sum((label = 0)::INT) - sum((label = 1)::INT) FROM D)::BIGINT)) AS g), B AS (SELECT g, N.f0, N.f1, js[floor({uniform_sql(42, 'pick', 'g')} * len(js))::INT + 1] AS j FROM G JOIN N ON n = floor({uniform_sql(42, 'base', 'g')} * (SELECT count(*) FROM D WHERE label = 1))::BIGINT) SELECT -1 - g AS id, round(B.f0 + (D.f0 - B.f0) * {uniform_sql(42, 'gap', 'g')}, 6) AS f0, round(B.f1 + (D.f1 - B.f1) * {uniform_sql(42, 'gap', 'g')}, 6) AS f1 FROM B JOIN D ON D.id = j",
    "blsmote1": f"WITH {_U}, {_MINN}, J AS (SELECT i, list(j ORDER BY rk) AS js FROM Q WHERE rk <= 5 GROUP BY i), A AS (SELECT i FROM K WHERE yi = 1 AND rk <= 5 GROUP BY i HAVING sum((yj = 0)::INT) > 0 AND sum((yj = 0)::INT) < count(*)), B AS (SELECT D.*, js[floor({uniform_sql(42, 'pick', 'id')} * len(js))::INT + 1] AS j FROM D JOIN A ON id = A.i JOIN J ON id = J.i) SELECT -1 - B.id AS id, round(B.f0 + (D.f0 - B.f0) * {uniform_sql(42, 'gap', 'B.id')}, 6) AS f0, round(B.f1 + (D.f1 - B.f1) * {uniform_sql(42, 'gap', 'B.id')}, 6) AS f1 FROM B JOIN D ON D.id = B.j",
    "hkm_step": _STEP + "A AS (SELECT *, CASE WHEN round(d0, 9) <= round(d1, 9) AND round(d0, 9) <= round(d2, 9) THEN 0 WHEN round(d1, 9) <= round(d2, 9) THEN 1 ELSE 2 END AS c FROM M) SELECT c::INT AS cluster, round(avg(f0), 3) AS f0, round(avg(f1), 3) AS f1 FROM A GROUP BY c",
    "fcm_step": _STEP.rstrip(", ") + " " + _union(f"SELECT {i}::INT AS cluster, round(sum(mu{i} * mu{i} * f0) / sum(mu{i} * mu{i}), 3) AS f0, round(sum(mu{i} * mu{i} * f1) / sum(mu{i} * mu{i}), 3) AS f1 FROM M" for i in range(3)),
    "rkm_step": _rough_sql(False),
    "frkm_step": _rough_sql(True),
    "stratified_split": _SPLIT + " SELECT id, label, is_test FROM Y",
    "kfold": _rank("fold") + "SELECT id, label, (n % 5)::INT AS fold FROM N",
    "knn_classify": _SPLIT + f", Z AS (SELECT D.*, is_test FROM D JOIN Y USING (id)), P AS (SELECT a.id AS i, a.label AS yi, b.id AS j, b.label AS yj, {_EUCLID} AS dist FROM Z a JOIN Z b ON a.is_test AND NOT b.is_test), K AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM P), S AS (SELECT i AS id, yi AS label, round(avg(yj), 9) AS score FROM K WHERE rk <= 5 GROUP BY ALL) SELECT id, label, score, (score > 0.5)::INT AS prediction FROM S",
    "confusion_matrix": _METRIC + " SELECT label, prediction, count(*) AS n FROM Y GROUP BY ALL",
    "metrics_from_predictions": _METRIC + _C + ", A AS (SELECT sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM Y a JOIN Y b ON a.label = 1 AND b.label = 0) SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity, round(sqrt((tp / (tp + fn)) * (tn / (tn + fp))), 6) AS g_mean, round(auc, 6) AS auc_roc FROM C, A",
    "purity": f"WITH {_D}, G AS (SELECT unnest(range(32)) AS res), B AS (SELECT min(f0) AS a0, max(f0) AS b0, min(f1) AS a1, max(f1) AS b1 FROM D), X AS (SELECT res, label, greatest(0, ceil(round((f0 - a0) / ((b0 - a0) / (res + 1)), 9)) - 1)::BIGINT AS c0, greatest(0, ceil(round((f1 - a1) / ((b1 - a1) / (res + 1)), 9)) - 1)::BIGINT AS c1 FROM D, G, B), C AS (SELECT res, c0, c1, label, count(*) AS c FROM X GROUP BY ALL), S AS (SELECT res, c0, c1, sum(c) AS n, sum(c * c) AS q FROM C GROUP BY ALL) SELECT res::INT AS res, round(sum(sqrt(greatest(0, 2 * (q / (n * n) - 0.5))) * n) / sum(n), 6) AS purity FROM S GROUP BY res",
}


# --- SQL of loops ---------------------------------------------------------------------------------------------------


def _least_of(names: list[str], free: list[str]) -> str:
    """The first name whose value is least among those still free."""
    out = "-1"
    for k in reversed(range(len(names))):
        ahead = " AND ".join([free[k], *[f"(NOT {free[j]} OR {names[k]} {'<=' if j > k else '<'} {names[j]})" for j in range(len(names)) if j != k]])
        out = f"CASE WHEN {ahead} THEN {k} ELSE {out} END"
    return out


def _f4_sql() -> str:
    """Four rounds: the free feature with the fewest rows in the overlap is taken, and rows outside its overlap go."""
    parts, used = [_L, "R0 AS (SELECT * FROM L)"], []
    for s in range(4):
        ends = ", ".join(f"CASE WHEN count(DISTINCT label) = 2 THEN greatest(min({f}) FILTER (label = 0), min({f}) FILTER (label = 1)) END AS lo{k}, least(max({f}) FILTER (label = 0), max({f}) FILTER (label = 1)) AS hi{k}" for k, f in enumerate(_F))
        parts.append(f"B{s} AS (SELECT {ends} FROM R{s})")
        parts.append(f"C{s} AS (SELECT {', '.join(f'coalesce(sum(({f} BETWEEN lo{k} AND hi{k})::INT), 0) AS c{k}' for k, f in enumerate(_F))} FROM R{s}, B{s})")
        free = [" AND ".join(["TRUE", *[f"(SELECT p FROM P{t}) <> {k}" for t in used]]) for k in range(4)]
        parts.append(f"P{s} AS (SELECT {_least_of([f'c{k}' for k in range(4)], [f'({f})' for f in free])} AS p FROM C{s})")
        keep = " ".join(f"WHEN {k} THEN {f} BETWEEN lo{k} AND hi{k}" for k, f in enumerate(_F))
        parts.append(f"R{s + 1} AS MATERIALIZED (SELECT label, {', '.join(_F)} FROM R{s}, B{s}, P{s} WHERE CASE p {keep} END)")
        used.append(s)
    return f"WITH {', '.join(parts)} SELECT 0::INT AS a, 1::INT AS b, round((SELECT count(*) FROM R4) / (SELECT count(*) FROM L), 6) AS value"


def _f1v_sql() -> str:
    """delta' W^-1 delta by elimination, a feature at a time."""
    pairs = [(a, b) for a in range(4) for b in range(a, 4)]
    moments = ", ".join([f"avg({f}) AS m{k}" for k, f in enumerate(_F)] + [f"covar_samp({_F[a]}, {_F[b]}) AS c{a}{b}" for a, b in pairs])
    parts = [_L, f"M AS (SELECT label, count(*) AS n, {moments} FROM L GROUP BY label)"]
    start = ", ".join([f"p.m{k} - q.m{k} AS d{k}" for k in range(4)] + [f"(p.n * p.c{a}{b} + q.n * q.c{a}{b}) / (p.n + q.n) AS w{a}{b}" for a, b in pairs])
    parts.append(f"S0 AS (SELECT 0.0::DOUBLE AS s, {start} FROM M p, M q WHERE p.label = 0 AND q.label = 1)")
    for k in range(4):
        rest = [f"d{i} - w{k}{i} * d{k} / w{k}{k} AS d{i}" for i in range(k + 1, 4)] + [f"w{a}{b} - w{k}{a} * w{k}{b} / w{k}{k} AS w{a}{b}" for a, b in pairs if a > k]
        parts.append(f"S{k + 1} AS (SELECT {', '.join([f's + d{k} * d{k} / w{k}{k} AS s', *rest])} FROM S{k})")
    return f"WITH {', '.join(parts)} SELECT 0::INT AS a, 1::INT AS b, round(1 / (1 + s), 6) AS value FROM S4"


def _by_label(salt: str, row: str) -> str:
    return f"CASE label WHEN 0 THEN {uniform_sql(7, f'{salt}0', row)} ELSE {uniform_sql(7, f'{salt}1', row)} END"


_N4 = f"""WITH {_D}, {_R}, N AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS n, count(*) OVER (PARTITION BY label) AS m FROM D),
 G AS (SELECT label, n AS g, floor({_by_label('a', 'n')} * m)::BIGINT AS pa, floor({_by_label('b', 'n')} * m)::BIGINT AS pb, {_by_label('t0_', 'n')} AS t0, {_by_label('t1_', 'n')} AS t1 FROM N),
 I AS (SELECT G.label, g, x.f0 + (y.f0 - x.f0) * t0 AS f0, x.f1 + (y.f1 - x.f1) * t1 AS f1 FROM G JOIN N x ON x.label = G.label AND x.n = pa JOIN N y ON y.label = G.label AND y.n = pb),
 K AS (SELECT a.label AS yi, b.label AS yj, row_number() OVER (PARTITION BY a.label, a.g ORDER BY {_HEOM}, b.id) AS rk FROM I a, D b, R)
 SELECT round(avg((yi <> yj)::INT), 6) AS value FROM K WHERE rk = 1"""

_CELLS = f"""{_D}, G AS (SELECT unnest(range(32)) AS res), B AS (SELECT min(f0) AS a0, max(f0) AS b0, min(f1) AS a1, max(f1) AS b1 FROM D),
 X AS (SELECT id, label, f0, f1, res, greatest(0, ceil(round((f0 - a0) / ((b0 - a0) / (res + 1)), 9)) - 1)::BIGINT AS c0, greatest(0, ceil(round((f1 - a1) / ((b1 - a1) / (res + 1)), 9)) - 1)::BIGINT AS c1 FROM D, G, B)"""
_SEPARABLE = f"""WITH {_CELLS}, {_R}, T AS (SELECT a.id, a.label, a.res, (a.label = b.label)::INT AS same, row_number() OVER (PARTITION BY a.id, a.res ORDER BY {_HEOM}, b.id) AS k
  FROM X a JOIN X b ON a.res = b.res AND a.c0 = b.c0 AND a.c1 = b.c1 AND a.id <> b.id, R QUALIFY k <= 11),
 S AS (SELECT id, res, k, sum(same) OVER (PARTITION BY id, res ORDER BY k) / k AS p FROM T),
 M AS (SELECT id, res, least(count(*) OVER (PARTITION BY res, c0, c1, label) - 1, 11) AS m, count(*) OVER (PARTITION BY res, c0, c1) AS whole FROM X),
 A AS (SELECT S.id, S.res, k, p, (p + lag(p) OVER (PARTITION BY S.id, S.res ORDER BY k)) / 2 AS area FROM S JOIN M ON M.id = S.id AND M.res = S.res AND k <= m),
 V AS (SELECT M.id, M.res, CASE WHEN m = 0 AND whole > 1 THEN 0 WHEN m = 0 THEN 1 WHEN m = 1 THEN min(p) ELSE sum(area) / m END AS v FROM M LEFT JOIN A ON A.id = M.id AND A.res = M.res GROUP BY M.id, M.res, m, whole),
 W AS (SELECT res, avg(v) / (2 ^ res) AS w FROM V GROUP BY res) SELECT round(sum((a.w + b.w) / 2) / 31, 6) AS value FROM W a JOIN W b ON b.res = a.res + 1"""

_PEAKS = f"""WITH {_D}, X AS (SELECT * FROM D WHERE label = 1), P AS (SELECT a.id AS i, b.id AS j, {_EUCLID} AS dist FROM X a, X b),
 K AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM P WHERE i <> j),
 C AS (SELECT coalesce(nullif(avg(dist), 0), 1) AS dc FROM K WHERE rk = greatest(1, floor(0.02 * (SELECT count(*) FROM X)))),
 H AS (SELECT i, round(sum(exp(-(dist / dc) * (dist / dc))), 9) AS rho FROM P, C GROUP BY i),
 Z AS (SELECT P.i, a.rho, coalesce(min(CASE WHEN b.rho > a.rho OR (b.rho = a.rho AND P.j < P.i) THEN dist END), max(dist)) AS delta FROM P JOIN H a ON a.i = P.i JOIN H b ON b.i = P.j GROUP BY P.i, a.rho),
 E AS (SELECT min(rho) AS r0, max(rho) AS r1, min(delta) AS e0, max(delta) AS e1 FROM Z)
 SELECT i AS id, round(rho, 6) AS rho, round(delta, 6) AS delta, coalesce((rho - r0) / nullif(r1 - r0, 0), 0) <= 0.045 AND coalesce((delta - e0) / nullif(e1 - e0, 0), 0) >= 0.25 AS noisy FROM Z, E"""

_FOLDS = (
    _rank("fold")
    + f""", Z AS (SELECT D.*, N.n % 5 AS fold FROM D JOIN N USING (id)), V AS (SELECT unnest(range(5)) AS v),
 T AS (SELECT v, Z.*, row_number() OVER (PARTITION BY v, label ORDER BY {uniform_sql(42, 'rus', 'id')}, id) AS r, sum((label = 1)::INT) OVER (PARTITION BY v) AS few FROM Z, V WHERE fold <> v),
 P AS (SELECT a.fold, a.id AS i, a.label AS yi, b.id AS j, b.label AS yj, {_EUCLID} AS dist FROM Z a JOIN T b ON a.fold = b.v AND (b.label = 1 OR b.r <= b.few)),
 K AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM P),
 S AS (SELECT fold, i, yi, (avg(yj) > 0.5)::INT AS y FROM K WHERE rk <= 5 GROUP BY ALL),
 Q AS (SELECT fold, sqrt(coalesce(sum(y) FILTER (yi = 1) / nullif(sum((yi = 1)::INT), 0), 0) * coalesce(sum(1 - y) FILTER (yi = 0) / nullif(sum((yi = 0)::INT), 0), 0)) AS g FROM S GROUP BY fold)
 SELECT round(avg(round(g, 9)), 6) AS mean, round(stddev_pop(round(g, 9)), 6) AS std FROM Q"""
)

_RECURSIVE = _ENEMY.replace("WITH", "WITH RECURSIVE", 1).rstrip()
#: A row is a core unless an earlier core's local set has it, by falling size of its local set.
_CORES = (
    _RECURSIVE
    + """, O AS (SELECT N.i, N.yi, list(j) FILTER (P.yj = N.yi AND dist < o) AS js FROM N JOIN P USING (i) GROUP BY N.i, N.yi),
 W AS (SELECT N.i, N.yi, coalesce(js, []) AS js, row_number() OVER (PARTITION BY N.yi ORDER BY -((N.o > 0)::INT + len(coalesce(js, []))), N.i) AS n FROM N JOIN O USING (i)),
 Y AS (SELECT 0::BIGINT AS n, yi, []::BIGINT[] AS covered, 0::BIGINT AS cores FROM N GROUP BY yi
  UNION ALL SELECT W.n, Y.yi, CASE WHEN list_contains(covered, i) THEN covered ELSE list_distinct(list_concat(covered, js)) END, cores + (NOT list_contains(covered, i))::INT FROM Y JOIN W ON W.yi = Y.yi AND W.n = Y.n + 1)
 SELECT round((SELECT sum(c) FROM (SELECT max(cores) AS c FROM Y GROUP BY yi)) / (SELECT count(*) FROM D), 6) AS value"""
)
#: Per class, balls that reach to the nearest other class; the one with most new rows first, then the lowest id.
_BALLS = (
    _RECURSIVE
    + """, O AS (SELECT N.i, N.yi, N.o AS radius, list_append(coalesce(list(j) FILTER (P.yj = N.yi AND dist <= o), []), N.i) AS js FROM N JOIN P USING (i) GROUP BY N.i, N.yi, N.o),
 Y AS (SELECT yi, NULL::BIGINT AS id, NULL::DOUBLE AS radius, 0::BIGINT AS members, list(i) AS free FROM N GROUP BY yi
  UNION ALL SELECT yi, i, radius, len(got), list_filter(free, lambda x: NOT list_contains(got, x)) FROM (
   SELECT Y.yi, O.i, O.radius, Y.free, list_intersect(O.js, Y.free) AS got FROM Y JOIN O ON O.yi = Y.yi WHERE len(Y.free) > 0
   QUALIFY row_number() OVER (PARTITION BY Y.yi ORDER BY len(got) DESC, O.i) = 1)),
 A AS (SELECT yi, id, radius, members FROM Y WHERE id IS NOT NULL)"""
)


def _tree(rows: str) -> str:
    """Prim's tree over a table (id, label, f0, f1), from the lowest id: a CTE T(id, a, b) with the edge that brought each row in."""
    return f"""E AS (SELECT a.id AS i, b.id AS j, {_HEOM} AS dist, (a.label <> b.label) AS crosses FROM {rows} a JOIN {rows} b ON a.id <> b.id, RR),
 TT AS (SELECT [min(id)] AS seen, NULL::BIGINT AS a, NULL::BIGINT AS b, FALSE AS crosses FROM {rows}
  UNION ALL SELECT list_append(seen, j), i, j, crosses FROM (SELECT seen, E.i, E.j, E.crosses FROM TT JOIN E ON list_contains(seen, E.i) AND NOT list_contains(seen, E.j)
   WHERE E.dist > 0 ORDER BY E.dist, least(E.i, E.j), greatest(E.i, E.j) LIMIT 1)),
 H AS (SELECT DISTINCT unnest([a, b]) AS id FROM TT WHERE crosses)"""


_RANGES = "RR AS (SELECT CASE WHEN max(f0) > min(f0) THEN max(f0) - min(f0) ELSE 1 END AS r0, CASE WHEN max(f1) > min(f1) THEN max(f1) - min(f1) ELSE 1 END AS r1 FROM {})"

SQL |= {
    "f4": _f4_sql(),
    "f1v_lineitem": _f1v_sql(),
    "n4": _N4,
    "purity_index": SQL["purity"].replace("SELECT res::INT AS res", ", Y AS (SELECT res::INT AS res", 1)
    + "), W AS (SELECT res, purity / (2 ^ res) AS w FROM Y), Z AS (SELECT res, coalesce((w - min(w) OVER ()) / nullif(max(w) OVER () - min(w) OVER (), 0), 0) AS z FROM W) SELECT round(sum((a.z + b.z) / 2) / 31 / 0.702, 6) AS value FROM Z a JOIN Z b ON b.res = a.res + 1",
    "neigh_sep": _SEPARABLE,
    "density_peaks": _PEAKS,
    "cross_validate": _FOLDS,
    "clust": _CORES,
    "onb": _BALLS + " SELECT round(avg(c / n), 6) AS value FROM (SELECT yi, count(*) AS c FROM A GROUP BY yi) JOIN (SELECT yi, count(*) AS n FROM N GROUP BY yi) USING (yi)",
    "nsg": _BALLS + " SELECT round(avg(members), 6) AS value FROM A",
    "icsv": _BALLS + f", V AS (SELECT {math.pi} * (radius / coalesce(nullif((SELECT max(radius) FROM A), 0), 1)) ^ 2 AS v, members FROM A) SELECT round(stddev_pop(CASE WHEN v > 0 THEN members / v END), 6) AS value FROM V",
    "n1_mst": f"WITH RECURSIVE {_D}, {_RANGES.format('D')}, {_tree('D')} SELECT round((SELECT count(*) FROM H) / (SELECT count(*) FROM D), 6) AS value",
    "dbc": _BALLS + f", BB AS (SELECT D.* FROM D JOIN A USING (id)), {_RANGES.format('BB')}, {_tree('BB')} SELECT round((SELECT count(*) FROM H) / (SELECT count(*) FROM BB), 6) AS value",
}


def _clustering_sql(method: str) -> str:
    """The rounds of KMeansUndersampling with its defaults, from the same three rows, then the rows it takes out."""
    at = [f"c{i}{f}" for i in range(3) for f in range(2)]
    near = ", ".join(f"sqrt((f0 - c{i}0) * (f0 - c{i}0) + (f1 - c{i}1) * (f1 - c{i}1)) AS d{i}" for i in range(3))
    safe = [f"greatest(d{i}, 1e-10)" for i in range(3)]
    mu = ", ".join(f"1 / ({' + '.join(f'({safe[i]} / {safe[j]}) ^ 2' for j in range(3))}) AS mu{i}" for i in range(3))
    upper = ", ".join(f"(d{i} - least(d0, d1, d2) <= 0.1)::INT AS u{i}" for i in range(3))
    hard = "CASE WHEN round(d0, 9) <= round(d1, 9) AND round(d0, 9) <= round(d2, 9) THEN 0 WHEN round(d1, 9) <= round(d2, 9) THEN 1 ELSE 2 END AS c"
    rows = lambda source: f"(SELECT *, {mu}, {upper}, {hard} FROM (SELECT *, {near} FROM {source}))"

    def mean(i: int, f: int) -> str:
        if method == "HKM":
            return f"coalesce(avg(f{f}) FILTER (c = {i}), c{i}{f})"
        if method == "FCM":
            return f"sum(mu{i} * mu{i} * f{f}) / sum(mu{i} * mu{i})"
        w = f"mu{i} * mu{i} * " if method == "FRKM" else ""
        low, up = (f"(sum({w}f{f}) FILTER ({x}) / count(*) FILTER ({x}))" for x in (f"u{i} = 1 AND u0 + u1 + u2 = 1", f"u{i} = 1 AND u0 + u1 + u2 > 1"))
        return f"coalesce(0.95 * {low} + (1 - 0.95) * {up}, {low}, {up}, c{i}{f})"

    new = ", ".join(f"{mean(i, f)} AS n{i}{f}" for i in range(3) for f in range(2))
    step = f"SELECT n, {', '.join(at)}, {new} FROM {rows('Y, X WHERE n < 100 AND moved >= 1e-5')} GROUP BY n, {', '.join(at)}"
    moved = " + ".join(f"(n{c[1:]} - {c}) * (n{c[1:]} - {c})" for c in at)
    first = ", ".join(f"max(f{f}) FILTER (r = {i + 1}) AS c{i}{f}" for i in range(3) for f in range(2))
    second = "list_sort([mu0, mu1, mu2])[2] > 0.3"
    ratio = "list_sort([d0, d1, d2])[1] / (list_sort([d0, d1, d2])[2] + 1e-10)"
    gone = {"HKM": f"{ratio} < (SELECT quantile_cont({ratio}, 0.1) FROM Z)", "FCM": second, "RKM": "u0 + u1 + u2 > 1", "FRKM": f"u0 + u1 + u2 > 1 OR {second}"}[method]
    return f"""WITH RECURSIVE {_D}, X AS (SELECT id, f0, f1, row_number() OVER (ORDER BY {uniform_sql(42, 'centre', 'id')}, id) AS r FROM D WHERE label = 0),
 Y AS (SELECT 0 AS n, 1e9::DOUBLE AS moved, {first} FROM X WHERE r <= 3
  UNION ALL SELECT n + 1, sqrt({moved}), {', '.join(f'n{c[1:]}' for c in at)} FROM ({step})),
 Z AS (SELECT * FROM {rows('(SELECT * FROM Y ORDER BY n DESC LIMIT 1), X')}), G AS (SELECT id FROM Z WHERE {gone}) {_KEPT}"""


#: Radii along the pointers to nearest enemies, then the balls that no later ball contains.
_SPHERES = f"""WITH RECURSIVE {_U}, N AS (SELECT i, j AS e, dist AS d FROM P WHERE yi <> yj QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, j) = 1),
 M AS (SELECT a.i, a.e, a.d, b.e = a.i AS mutual FROM N a JOIN N b ON b.i = a.e),
 Y AS (SELECT i AS id, i AS here, 1 AS sign, 0::DOUBLE AS acc FROM M
  UNION ALL SELECT id, CASE WHEN mutual THEN NULL ELSE e END, -sign, acc + sign * CASE WHEN mutual THEN d / 2 ELSE d END FROM Y JOIN M ON M.i = Y.here),
 A AS (SELECT id, abs(acc) AS radius FROM Y WHERE here IS NULL),
 G AS (SELECT DISTINCT a.id FROM A a JOIN P ON P.i = a.id JOIN A b ON b.id = P.j WHERE (b.radius > a.radius OR (b.radius = a.radius AND b.id > a.id)) AND round(dist + a.radius, 9) <= round(b.radius, 9))
 SELECT round(((SELECT count(*) FROM A) - (SELECT count(*) FROM G)) / (SELECT count(*) FROM D), 6) AS value"""

SQL |= {
    "inverse_scale": f"WITH {_D} SELECT id, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM D",
    "preview": f"WITH {_D} SELECT id, label, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM D ORDER BY id LIMIT 7",
    "overlap_picture_after": SQL["rus"].replace("SELECT id, label, 'orig' AS origin FROM D", ", A AS (SELECT id, label, 'orig' AS origin FROM D", 1)
    + ") SELECT id, A.label, pc::INT AS pc, round(CASE pc WHEN 0 THEN f0 - (SELECT avg(f0) FROM D) ELSE f1 - (SELECT avg(f1) FROM D) END, 6) AS value FROM A JOIN D USING (id), range(2) AS t(pc)",
}

SQL |= {**{n.lower(): _clustering_sql(n) for n in sm.KMeansUndersampling.METHODS}, "t1": _SPHERES}
