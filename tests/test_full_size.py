"""Queries whose models have the sizes of the library's defaults."""

from sojourn.catalog import models as m
from sojourn.plans import training as tr


def test_regression_models_are_full_size(spark, data, monkeypatch):
    seen = []

    def watched(split, features, models, subsets, **more):
        seen.extend(models)
        return split.limit(0), {}

    monkeypatch.setattr(tr, "train_models", watched)
    m.regression_models(spark, data)
    params = {spec.name: dict(spec.params) for spec in seen}
    want = [tr.dummy_regressor(), tr.ridge(), tr.forest_regressor(), tr.boosting_regressor()]
    assert params == {spec.name: dict(spec.params) for spec in want}
    assert (params["random_forest"]["numTrees"], params["random_forest"]["maxDepth"], params["boosting"]["maxIter"]) == (200, 14, 100)
