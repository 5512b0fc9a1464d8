import pytest

from doppel import config
from doppel.config import DetectorConfig


def test_defaults_are_valid():
    assert DetectorConfig().validate().dp == 3 and DetectorConfig(min_prefix_depth=0).dp == 6


@pytest.mark.parametrize("change", [{"window_days": 0}, {"kp": 0}, {"theta_p": 9}, {"tau": 1.5}, {"lambda_sec": 0}, {"score_mode": "additive", "weights": (1, 1, 0, 0, 0)}, {"tiny_value": -1}, {"weights": (1.0,)}])
def test_bad_settings(change):
    with pytest.raises(ValueError):
        DetectorConfig().replace(**change).validate()


def test_clamp_depth():
    assert [config.clamp_depth(d, 6) for d in (-1, 0, 1, 6, 7)] == [6, 6, 1, 6, 6]


def test_logistic_ablations_fold_the_floor():
    c = DetectorConfig()
    assert config.ablate(c, "time") == c and config.ablate(c, "value") == c
    w = config.ablate(c, "token").logistic_weights
    assert w[2] == 0 and w[0] == pytest.approx(c.logistic_weights[0] + 0.2 * c.logistic_weights[2])
    assert config.address_only(c).logistic_weights[1:] == (0.0, 0.0)


def test_other_ablations():
    gate = DetectorConfig(score_mode="context_gate", context_weights=(0.4, 0.3, 0.2, 0.1))
    assert config.ablate(gate, "value").context_weights == (0.4, 0.3, 0.0, 0.1)
    add = config.ablate(DetectorConfig(score_mode="additive"), "type").weights
    assert add[1] == 0 and sum(add) == pytest.approx(1)
    assert config.address_only(gate).score_mode == "address_only"


def test_import_and_environment(tmp_path):
    text = "detector:\n  tau: 0.5  # lower\n  weights: [0.4, 0.2, 0.1, 0.2, 0.1]\n  score_mode: additive\nother:\n  x: 1\n"
    got = config.import_detector(text)
    assert got.tau == 0.5 and got.weights[0] == 0.4 and got.kp == 6
    assert config.import_detector("tau: 0.25\n").tau == 0.25 and config.import_detector('{"detector": {"kp": 5, "theta_p": 3}}').kp == 5
    path = tmp_path / "app.yaml"
    path.write_text(text)
    assert config.load(str(path), {"DETECTOR_TAU": "0.75"}).tau == 0.75
