"""The registered model queries fit the library's default models."""

import pytest

from proving import q_models


class Fitted(Exception):
    pass


@pytest.mark.parametrize("query, module, name", [
    ("cus_5", "customers", "churn_model"), ("del_3", "delivery", "delivery_time_model"),
    ("del_4", "delivery", "delivery_time_model")])
def test_no_option_makes_the_model_smaller(monkeypatch, query, module, name):
    def fit(*args, **options):
        raise Fitted(options)

    for at in ("dated_orders", "trips"):
        monkeypatch.setattr(q_models, at, lambda s: None)
    monkeypatch.setattr(q_models.customers, "churn_features", lambda *a, **b: None)
    monkeypatch.setattr(getattr(q_models, module), name, fit)
    with pytest.raises(Fitted) as got:
        getattr(q_models, query)(None)
    assert got.value.args == ({},)
