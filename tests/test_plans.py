import pytest

from ovelia.operators import samplers as sm
from ovelia.plans.overlap import ComplexityMeasures, available_measures, interpret
from ovelia.plans.pipeline import ImbalancedPipeline
from ovelia.sources import labelled as lb


def test_steps_out_of_order(spark):
    p = ImbalancedPipeline(spark)
    for step in (p.statistics, p.apply_resampling_techniques, p.evaluate_techniques, p.get_best_technique):
        with pytest.raises(ValueError):
            step()
    with pytest.raises(ValueError):
        p.load_data("nowhere")


def test_complete_run(spark):
    out = ImbalancedPipeline(spark).run_complete_pipeline("synthetic", {"RUS": sm.RandomUnderSampler()}, "knn", n_samples=120, n_features=3)
    assert out["best_technique"] in ("RUS", "Baseline (No Resampling)")
    assert out["evaluation_results"].count() == 2 and set(out["resampled_data"]) == {"RUS"}


def test_measures_are_shares(spark):
    c = ComplexityMeasures(lb.synthetic(spark, 60, 2, 2))
    for name in ("n3", "kdn", "cm", "si", "deg_overlap", "n2", "lsc", "t1", "f2", "input_noise", "onb", "clust"):
        assert 0 <= c.value(name) <= 1, name
    assert c.calculate_n3()["level"] in ("low", "medium", "high") and c.hardness_picture().count() == 120
    assert c.table(("feature",)).count() == 6
    with pytest.raises(ValueError):
        c.measure("none")
    assert sum(map(len, available_measures().values())) == 29


def test_reading():
    assert interpret({"n3": 0.3, "t1": 0.1})["overall"] == "high"
    assert interpret({"n3": 0.05, "t1": 0.2})["overall"] == "medium"
    assert interpret({"n3": 0.05, "t1": 0.05, "f1": 1.0})["overall"] == "low"


@pytest.mark.parametrize("make", [lambda: sm.KMeansUndersampling("HKM"), lambda: sm.KMeansUndersampling("FRKM"), sm.URNS, sm.DeviOCSVM, lambda: sm.SVDDWSMOTE(n_c1=2, n_sigma=2), lambda: sm.FCMBoostOBU(max_iter=5), lambda: sm.EHSO(generations=3)])
def test_samplers_keep_rows_whole(spark, make):
    x = lb.synthetic(spark, 60, 2, 3).cache()
    out = make().resample(x)
    assert out.columns == ["id", "label", "features", "origin"]
    orig = {(r["id"], r["label"]) for r in out.where("origin = 'orig'").collect()}
    assert orig <= {(r["id"], r["label"]) for r in x.collect()} and out.count() > 0


def test_tables_over_all_techniques():
    """Both tables have every technique; before, four were left out for their time."""
    from ovelia import queries as q
    from ovelia.plans.pipeline import TECHNIQUES

    got = q.techniques()
    assert set(got) == set(TECHNIQUES) and {"FCM", "FRKM", "FCMBoostOBU", "RFCL"} <= set(got)
    assert {n: (type(s), s.get_params()) for n, s in got.items()} == {n: (type(s := make()), s.get_params()) for n, make in TECHNIQUES.items()}
