import json

from doppel import config
from doppel.config import DetectorConfig
from doppel.operators.learn import Fitted
from doppel.sources import reports, rpc


def test_tables(spark):
    df = spark.createDataFrame([("a_b", 0.5)], "name string, f1 double")
    assert reports.markdown(df).splitlines()[-1] == "| a_b | 0.500000 |"
    assert r"a\_b & 0.50 \\" in reports.latex(df, 2)


def test_settings_and_models_round_trip(tmp_path):
    c = DetectorConfig(tau=0.25, address_mode="balanced")
    assert config.import_detector(reports.config_text(c)) == c
    files = reports.tau_configs(c, [0.1, 0.9], str(tmp_path))
    assert config.load(files[1], {}).tau == 0.9 and files[0].endswith("tau_0p100000.yaml")
    fitted = Fitted(("a", "b"), 0.5, (1.0, 2.0), 0.75)
    reports.save_model(fitted, str(tmp_path / "m.json"))
    assert reports.load_model(str(tmp_path / "m.json")) == fitted


def test_lookups(spark, tmp_path):
    word = lambda t: "0x" + f"{32:064x}{len(t):064x}" + t.encode().hex().ljust(64, "0")
    answers = {}
    for token, (d, s, n) in {"0xaa": ("0x6", word("USDT"), word("Tether")), "0xbb": (None, None, None)}.items():
        for data, value in zip(rpc.SELECTORS.values(), (d, s, n), strict=True):
            answers[f"eth_call|{json.dumps([{'to': token, 'data': data}, 'latest'])}"] = value
    span = {"fromBlock": "0x1", "toBlock": "0x9"}
    v = "1" * 40
    log = {"transactionHash": "0xt", "address": "0xaa", "topics": [rpc.TRANSFER_TOPIC, "0x" + v.rjust(64, "0"), "0x" + ("2" * 40).rjust(64, "0")], "data": "0x05", "blockNumber": "0x4"}
    answers[f"eth_getLogs|{json.dumps([span | {'topics': log['topics'][:2]}])}"] = [log]
    answers[f"eth_getLogs|{json.dumps([span | {'topics': [rpc.TRANSFER_TOPIC, None, log['topics'][1]]}])}"] = []
    path = tmp_path / "a.json"
    path.write_text(json.dumps(answers))
    got = {r.address: r for r in rpc.token_metadata(spark.createDataFrame([("0xaa",), ("0xbb",), ("0xaa",)], "address string"), {"file": str(path)}).collect()}
    assert (got["0xaa"].decimals, got["0xaa"].symbol, got["0xaa"].name) == (6, "USDT", "Tether") and got["0xbb"].metadata_missing and got["0xbb"].decimals == 18
    rows = rpc.transfer_logs(spark.createDataFrame([(v,)], "victim string"), 1, 9, {"file": str(path)}).collect()
    assert [(r.other, r.token, r.block_number) for r in rows] == [("2" * 40, "0xaa", 4)]
