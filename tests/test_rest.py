"""Functions, files, statistics, RPC and streams."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from doppel import schemas
from doppel.functions import address, hashing, values
from doppel.operators import accounts, evaluate, features, learn, stats
from doppel.sources import files, notify, rpc
from doppel.streaming import live


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_addresses(spark):
    a = "0xA0b86991c6218b36c1d19D4a2E9eb0cE3606eB48"
    assert one(spark, address.normalize_address(F.lit(a))) == a[2:].lower() == one(spark, address.normalize_address(F.lit(" 0X" + a[2:] + " ")))
    assert one(spark, address.normalize_address(F.lit("0x12"))) is None and one(spark, address.normalize_address(F.lit(None).cast("string"))) is None
    assert one(spark, address.prefix_match(F.lit("abcd" + "0" * 36), F.lit("abce" + "1" * 36))) == 3


def test_call_data(spark):
    to, frm = "1" * 40, "2" * 40
    plain = "0xa9059cbb" + to.rjust(64, "0") + f"{123:064x}"
    behalf = "0x23b872dd" + to.rjust(64, "0") + frm.rjust(64, "0") + f"{500:064x}"
    a, b = one(spark, values.transfer_call(F.lit(plain))), one(spark, values.transfer_call(F.lit(behalf)))
    assert (a.from_addr, a.to_addr, int(a.amount_hex, 16)) == (None, to, 123) and (b.from_addr, b.to_addr, int(b.amount_hex, 16)) == (to, frm, 500)
    assert one(spark, values.transfer_call(F.lit(plain[:-4]))) is None and one(spark, values.transfer_call(F.lit("0x"))) is None


def test_numbers(spark):
    assert one(spark, values.hex_to_double(F.lit("0x" + "f" * 64))) == pytest.approx(float(2**256), rel=1e-12)
    assert one(spark, values.hex_to_double(F.lit("zz"))) == 0 and one(spark, values.hex_quantity(F.lit("0x000a"))) == "0xa" and one(spark, values.hex_quantity(F.lit("0x0"))) == "0x0"
    assert one(spark, values.to_double(F.lit("inf"))) == math.inf and one(spark, values.to_double(F.lit("nan"))) == 0 and one(spark, values.to_long(F.lit("7.9"))) == 7
    text = "USDC".encode().hex()
    assert one(spark, values.abi_string(F.lit("0x" + f"{32:064x}{4:064x}" + text.ljust(64, "0")))) == "USDC" == one(spark, values.abi_string(F.lit("0x" + text.ljust(64, "0"))))
    assert one(spark, hashing.stable_u64(F.lit("a"))) == str(int.from_bytes(__import__("hashlib").blake2b(b"a", digest_size=8).digest(), "big"))


def test_files(spark, tmp_path):
    cp = {"victim": "v", "recipient": "r", "token": "t", "observed_freq": 2, "last_seen": "2026-01-01T00:00:00Z"}
    for name, text in (("a.json", json.dumps([cp, cp])), ("b.json", json.dumps({"counterparties": [cp]})), ("c.jsonl", json.dumps(cp) + "\n")):
        (tmp_path / name).write_text(text)
    assert [files.read_counterparties(spark, str(tmp_path / n)).count() for n in ("a.json", "b.json", "c.jsonl")] == [2, 1, 1]
    (tmp_path / "m.json").write_text(json.dumps({"0xaa": {"symbol": "S", "decimals": 6}}))
    assert files.read_token_metadata(spark, str(tmp_path / "m.json")).first().address == "0xaa"
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(ValueError):
        files.read_replay(spark, str(tmp_path / "empty.jsonl"))
    (tmp_path / "d.csv").write_text("day,start_block\n2026-01-01,5\n")
    with pytest.raises(ValueError):
        files.read_day_boundaries(spark, str(tmp_path / "d.csv"))
    files.write_parquet(spark.range(3), str(tmp_path / "p"), {"max_rows": 5})
    meta = files.read_meta(spark, str(tmp_path / "p"))
    assert files.covers(meta, 5) and not files.covers(meta, 6) and not files.covers(meta, 0) and files.covers({"max_rows": 0}, 9) and files.covers({"max_rows": -1}, 0) and not files.covers(None, 1)
    assert files.read_meta(spark, str(tmp_path / "nothing")) is None
    store = files.Store(spark, str(tmp_path / "store"))
    for tau in (0.1, 0.2):
        store.append("config_versions", spark.createDataFrame([(tau,)], "tau double"))
    assert store.active_config().first().tau == 0.2 and store.newest("config_versions", 5).count() == 2
    files.write_metrics_csv(spark.createDataFrame([("m", 0.5)], "method string, f1 double"), str(tmp_path / "csv"))
    assert any("m,0.500000" in f.read_text() for f in (tmp_path / "csv").glob("part-*"))


def test_rpc_retries_and_source(spark, tmp_path):
    tries = []

    def send(url, body, key):
        tries.append(len(body))
        if len(tries) == 1:
            return 429, []
        if len(tries) == 2:
            return 200, [{"id": 0, "result": "a"}, {"id": 1, "error": {"code": 30, "message": "x"}}]
        return 200, [{"id": b["id"], "result": "b"} for b in body]

    waits = []
    assert rpc.call("u", [("m", []), ("m", [])], send=send, wait=waits.append) == ["a", "b"] and tries == [2, 2, 1] and waits == [0.75, 1.5]
    assert rpc.call("u", [("m", [])], send=lambda *a: (404, []), wait=waits.append) == [None] and rpc.backoff(9) == 30
    assert list(rpc.sequential(0, 9)) == [9] and list(rpc.sequential(7, 9)) == [8, 9] and not list(rpc.sequential(9, 9))
    block = lambda n: {"number": hex(n), "hash": f"b{n}", "timestamp": hex(100 + n), "transactions": [{"hash": f"0x{n}", "from": "f", "to": "t", "input": "0x", "value": "0x0", "nonce": "0x1"}]}
    path = tmp_path / "answers.json"
    path.write_text(json.dumps({f"eth_getBlockByNumber|{json.dumps([hex(n), True])}": block(n) for n in range(1, 8)} | {"eth_blockNumber|[]": hex(7)}))
    spark.dataSource.register(rpc.BlockSource)
    rows = spark.read.format("rpc_blocks").option("file", str(path)).option("start", 2).option("end", 6).load()
    assert sorted(r.block_number for r in rows.collect()) == [2, 3, 4, 5, 6]
    reader = rpc.BlockStream({"file": str(path)})
    assert reader.read({"block": 4})[1] == {"block": 7} and reader.read(reader.initialOffset())[1] == {"block": 7}


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 5.0)], "k string, v double")
    assert {r.k: r.avg_rank for r in stats.average_ranks(rows, "v").collect()} == {"a": 1, "b": 2.5, "c": 2.5, "d": 4}
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double").withColumn("g", F.lit(1))
    assert {r.k: round(r.p_holm, 9) for r in stats.holm(p, "p", "g", tie="k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert one(spark, stats.normal_cdf(F.lit(1.96))) == pytest.approx(0.975, abs=1e-4)
    low, high = stats.bca_interval([0.9, 0.91, 0.92, 0.95, 0.97, 0.9], 2000)
    assert 0.9 <= low < 0.925 < high <= 0.97 and stats.bca_interval([1.0, 1.0]) == (1.0, 1.0)
    assert stats.hash_sample(spark.range(50), "id", 7).count() == 7


def test_learning(spark):
    rows = spark.range(900).select(
        F.col("id").cast("string").alias("event_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), *(F.when(F.col("id") % 3 == 0, 0.6 + F.rand(1) * 0.4).otherwise(F.rand(2) * 0.6).alias(c) for c in ("s_addr", "s_type", "s_token", "s_time", "s_value")),
        F.lit(4).alias("matched_prefix"), F.lit(2).alias("matched_suffix"), F.lit(3).alias("candidates_scored"), F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 7 % 3 + 1).cast("int")).alias("split_victim"),
    ).cache()
    fitted, report = learn.calibrate(rows)
    assert report.first().f1 > 0.9 and len(fitted.coefficients) == 3
    assert len(features.VARIANTS) == 19 and len(features.named_scores()) == 34 and len(features.formula_grid()) == 3264
    assert features.VARIANTS["full_hard_negative"][5:10] == ("balance_addr", "both_addr", "prefix_suffix_gap", "candidate_pressure", "s_addr_x_candidate_pressure")
    assert features.VARIANTS["type_token_without_address"] == ("s_type", "s_token") and {"display_address_only", "display_no_type", "display_no_token"} <= set(features.VARIANTS)
    grid = features.formula_grid()
    assert grid[0].name == "gate_sum_a1.00_g1.0_b0.30_tmax_type_token_w0.35-0.35-0.15-0.15" and grid[-1].name == "gate_min_a1.00_g1.0_b0.95_traw_w0.50-0.30-0.00-0.20"
    assert {f.time_mode for f in grid} == {"max_type_token", "avg_type_token", "token", "raw"} and all(abs(sum(f.weights) - 1) < 1e-9 for f in grid)


def test_formula_search(spark):
    rows = [(int(k % 2), float(min(6, k % 7)), float(min(6, k % 5)), k % 2 * 0.5 + k % 7 / 14, float(k % 3 == 0), float(k % 2), k % 10 / 10, k % 4 / 4, ("val", "test")[k // 2 % 2]) for k in range(400)]
    data = spark.createDataFrame(rows, "label int, matched_prefix double, matched_suffix double, s_addr double, s_type double, s_token double, s_time double, s_value double, split_time string").withColumn("candidates_scored", F.lit(1))
    search = features.FormulaSearch(data, bins=101, top=5, report=2)
    table, apart, told = (x.collect() for x in (search.table(), search.ablations(), search.test()))
    assert len(table) == 3264 and len(apart) == 50 and len(told) == 20 and {r.ablation for r in told} == {r.ablation for r in apart} and len({r.ablation for r in apart}) == 10
    # the best formula again, threshold by threshold
    best = max(table, key=lambda r: (r.margin_vs_fair_ceiling, r.margin_vs_same_address, r.f1, -r.place))
    f = features.formula_grid()[best.place]
    val = [r for r in rows if r[-1] == "val"]

    def score(r):
        p, s = min(r[1], 6) / 6, min(r[2], 6) / 6
        low, high = min(p, s), max(p, s)
        a = {"sum": r[3], "balanced": r[3] * (f.alpha + (1 - f.alpha) * ((low / high) ** f.gamma if high else 0)), "harmonic": 2 * p * s / (p + s) if p + s else 0, "min": low}[f.addr_mode]
        t = {"max_type_token": max(r[4], r[5]), "avg_type_token": (r[4] + r[5]) / 2, "token": r[5], "raw": 1}[f.time_mode]
        context = (f.w_type * r[4] + f.w_token * r[5] + f.w_value * r[7] + f.w_time * r[6] * t) / sum(f.weights)
        return round(a * (f.beta + (1 - f.beta) * context), 9)

    def f1(tau):
        tp, fp = sum(score(r) >= tau and r[0] for r in val), sum(score(r) >= tau and not r[0] for r in val)
        fn = sum(r[0] for r in val) - tp
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    assert best.f1 == pytest.approx(max(f1(k / 100) for k in range(101))) and f1(best.tau) == pytest.approx(best.f1) and (best.tau == 0 or f1(best.tau - 0.01) < best.f1)
    assert {r.place for r in told} <= {r.place for r in apart}


def test_formula_search_reads_written_rows(spark):
    """Its jobs don't derive the features anew."""
    from doppel.plans.registry import q_learn

    search = q_learn.searched(spark, "/root/testdata/sf0.001")
    for rows in search.rows.values():
        assert rows.inputFiles() and all("formula-rows" in f for f in rows.inputFiles())


def feed(spark, *rows):
    return spark.createDataFrame([(i, h, at, s, n) for i, (h, at, s, n) in enumerate(rows)], "event_id long, hash string, observed_at timestamp, sender string, nonce long")


T0 = dt.datetime(2026, 1, 1)


def test_block_summary(spark):
    pending = feed(spark, ("AAA", T0 - dt.timedelta(seconds=2), "s", 1), ("0xbbb", T0 - dt.timedelta(seconds=1), "s", 2))
    call = "0xa9059cbb" + "1".rjust(64, "0") + "1".rjust(64, "0")
    blocks = spark.createDataFrame([(16, T0, "0xaaa", call), (16, T0, "0xccc", call), (16, T0, "0xbbb", "0x")], "block_number long, block_time timestamp, tx_hash string, input string")
    row = live.block_summary(live.inclusion(blocks, pending)).first()
    assert (row.tx_total, row.tx_seen, row.erc20_total, row.erc20_seen, row.lead_mean_ms) == (3, 2, 2, 1, 1500)


def test_warmup_and_retention(spark):
    rows = spark.createDataFrame([(n, T0 + dt.timedelta(seconds=s)) for n, s in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 120), (6, 30), (7, 61))], "block_number long, block_time timestamp")
    assert {r.block_number: r.counted for r in live.after_warmup(rows, T0).collect()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}
    seen = spark.createDataFrame([("a", T0 - dt.timedelta(hours=6, seconds=1)), ("b", T0 - dt.timedelta(hours=6) + dt.timedelta(seconds=1))], "hash string, seen_at timestamp")
    assert {r.hash: r.kept for r in live.retained(seen, "seen_at", T0).collect()} == {"a": False, "b": True}


def test_streams(spark, tmp_path):
    pending = feed(spark, ("0xa", T0, "s", 1), ("0xb", T0 + dt.timedelta(seconds=5), "s", 1), ("0xc", T0 + dt.timedelta(seconds=9), "s", 2), ("0xa", T0 + dt.timedelta(seconds=11), "s", 1))
    path = str(tmp_path / "in")
    pending.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(pending.schema).parquet(path)
    q = live.stream_replacements(source).writeStream.format("memory").queryName("repl").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.hash, r.is_replacement) for r in spark.table("repl").collect()) == [("0xa", False), ("0xa", False), ("0xb", True), ("0xc", False)]
    assert {(r.hash, r.is_replacement) for r in live.replacements(pending).collect()} == {("0xa", False), ("0xb", True), ("0xc", False)}


def test_stream_detection_equals_batch(spark, tmp_path):
    from doppel.config import DetectorConfig

    r6, l6, v, tok = "aaaaaa" + "0" * 28 + "bbbbbb", "aaaaaa" + "9" * 28 + "bbbbbb", "1" * 40, "3" * 40
    call = "0xa9059cbb" + l6.rjust(64, "0") + f"{0:064x}"
    rows = spark.createDataFrame([(1, "h", "0x" + v, "0x" + tok, call, 0, T0), (2, "g", "0x" + v, "0x" + tok, "0x", 5, T0)], "event_id long, hash string, from_addr string, to_addr string, input string, amount long, observed_at timestamp")
    cps = spark.createDataFrame([(v, r6, "2" * 40, "S", "N", 6, T0 - dt.timedelta(hours=1), 1, False)], schemas.COUNTERPARTY)
    assert [r.event_id for r in live.detect_live(rows, cps, DetectorConfig()).collect()] == [1]
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    q = live.run_detector(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), cps, DetectorConfig(), lambda df, epoch: got.extend(df.collect()), str(tmp_path / "ck"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert [(r.event_id, r.recipient) for r in got] == [(1, r6)]


def test_decode_and_notify(spark):
    rows = spark.createDataFrame([("0xABC",), ('"0xdef"',), ('{"hash": "0x1", "to": "t"}',), ("bad",), ("{}",), (None,)], "payload string")
    assert [r.kind for r in live.decode(rows).collect()] == ["hash", "hash", "object", "error", "error", "error"]
    alert = spark.createDataFrame([("h", "v", "l", "r", 0.95)], "hash string, victim string, lookalike string, recipient string, total double")
    sent = []
    assert notify.sink(lambda text: sent.append(text) or True)(alert, 3)[0]["sent"] and "0.950" in sent[0] and notify.sink(None)(alert, 1) == []


def test_counterparties(spark):
    row = (0, "0xh", "0x" + "3" * 40, "0x" + "1" * 40, "0x" + "2" * 40, True, 5.0, 5.0, True, False, False, False, False, False, False, "0x" + "2" * 40, 0, 0)
    labels = spark.createDataFrame([row, row, (*row[:8], True, True, *row[10:]), (*row[:15], "", 0, 0)], schemas.LABEL_ROW)
    got = accounts.build(labels).collect()
    assert len(got) == 1 and got[0].observed_freq == 2 and got[0].last_seen == dt.datetime(2015, 7, 30)
    assert evaluate.rollup(spark.createDataFrame([("m", 1, 0, 0, 1), ("m", 0, 1, 1, 0)], "method string, tp int, fp int, fn int, tn int"), "method").first().f1 == 0.5


def test_dump_blocks(spark, tmp_path):
    fields = ["7", "0xabc", "0x" + "3" * 40, "0x" + "1" * 40, "0x" + "2" * 40, "t", "5", "5", "t", *["f"] * 6, "0x" + "2" * 40, "0", "0"]
    row = lambda n: "\t".join([str(n), *fields[1:]])
    lines = [row(1), "COPY public.other (a) FROM stdin;", row(2), "\\.", "COPY public.labels (a) FROM stdin;", row(3), "a\tb", row(4), "\\.", row(5), "COPY public.labels_old (a) FROM stdin;", row(6), "\\."]
    (tmp_path / "d.sql").write_text("\n".join(lines))
    got = files.read_sql_dump(spark, str(tmp_path / "d.sql"), "public.labels")
    assert sorted(r.block_number for r in got.collect()) == [3, 4]
    assert [r.block_number for r in files.read_sql_dump(spark, str(tmp_path / "d.sql"), "public.labels", 1).collect()] == [3]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        assert sorted(r.block_number for r in got.select("*").collect()) == [3, 4]
        assert sorted(r.block_number for r in files.read_sql_dump(spark, str(tmp_path / "d.sql"), "public.labels").collect()) == [3, 4]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scan_tells_failed_blocks(spark, tmp_path):
    import json

    block = lambda n: {"number": hex(n), "hash": f"0xb{n}", "timestamp": "0x10", "transactions": [{"hash": f"0x{n}", "from": "a", "to": "b", "input": "0x", "value": "0x0", "nonce": "0x1"}]}
    path = tmp_path / "answers.json"
    path.write_text(json.dumps({f'eth_getBlockByNumber|["{hex(n)}", true]': block(n) for n in (2, 4)} | {'eth_getTransactionByHash|["0x2"]': {"hash": "0x2", "from": "a"}, 'eth_getTransactionReceipt|["0x2"]': {"blockNumber": "0x2", "status": "0x1"}}))
    spark.dataSource.register(rpc.BlockSource)
    txs, failed = rpc.scanned(spark.read.format("rpc_blocks").option("file", str(path)).option("start", 2).option("end", 5).load())
    assert sorted(r.tx_hash for r in txs.collect()) == ["0x2", "0x4"] and sorted(r.block_number for r in failed.collect()) == [3, 5]
    asked = spark.createDataFrame([("0x2",), ("0x9",)], "hash string")
    got = {r.hash: r for r in rpc.pending_transactions(asked, {"file": str(path)}).collect()}
    assert (got["0x2"].fetch_ok, got["0x2"].fetch_attempts, got["0x2"].from_addr) == (True, 1, "a") and (got["0x9"].fetch_ok, got["0x9"].fetch_attempts, got["0x9"].error) == (False, 3, "empty tx result")
    assert {r.hash: (r.block_number, r.succeeded) for r in rpc.receipts(asked, {"file": str(path)}).collect()} == {"0x2": (2, True), "0x9": (None, None)}


def test_subscription_reconnects_and_holds_back():
    import base64
    import hashlib
    import json
    import socket
    import struct
    import threading
    import time

    from doppel.sources import subscription as sub

    server = socket.create_server(("127.0.0.1", 0))

    def frame(text, kind=1):
        raw = text.encode()
        return bytes([0x80 | kind]) + (bytes([len(raw)]) if len(raw) < 126 else bytes([126]) + struct.pack(">H", len(raw))) + raw

    def serve():
        for n in (0, 1):
            conn, _ = server.accept()
            head = b""
            while b"\r\n\r\n" not in head:
                head += conn.recv(4096)
            key = next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Sec-WebSocket-Key"))
            conn.sendall(b"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: " + base64.b64encode(hashlib.sha1(key + sub.MAGIC.encode()).digest()) + b"\r\n\r\n")
            conn.recv(4096)
            conn.sendall(frame(json.dumps({"id": 1, "result": "0xsub"})) + frame("ping", 9) + frame("no json"))
            for k in range(3):
                conn.sendall(frame(json.dumps({"method": "eth_subscription", "params": {"result": f"0x{n}{k}" + "e" * 200 * k}})))
            time.sleep(0.5)
            conn.close()

    threading.Thread(target=serve, daemon=True).start()
    reader = sub.PendingStream({"url": f"ws://127.0.0.1:{server.getsockname()[1]}", "buffer": "2", "per_batch": "2"})
    at, seen = reader.initialOffset(), []
    until = time.time() + 20
    while len(seen) < 6 and time.time() < until:
        rows, end = reader.read(at)
        rows = list(rows)
        assert len(rows) <= 2 and list(reader.readBetweenOffsets(at, end)) == rows
        seen, at = seen + rows, end
        time.sleep(0.05)
    reader.feed.close()
    reader.commit(at)
    assert [r[0] for r in seen] == list(range(6)) and [json.loads(r[2])[:4] for r in seen] == ["0x00", "0x01", "0x02", "0x10", "0x11", "0x12"] and at["reconnects"] == 1 and not reader.kept
    assert sub.payload('{"method": "x"}') is None and sub.payload('{"method": "eth_subscription", "params": {"result": {"hash": "0x1"}}}') == '{"hash": "0x1"}'


def test_live_files_and_runs(spark, tmp_path):
    import json

    from doppel.config import DetectorConfig
    from doppel.sources import live_files as lf

    assert len(lf.EVENT_COLUMNS) == 29 and len(lf.BLOCK_COLUMNS) == 12
    rows = spark.createDataFrame([(T0, "0x1", True, 1.5, None)], "observed_at timestamp, tx_hash string, fetch_ok boolean, fetch_latency_ms double, error string")
    lf.write_events(rows, str(tmp_path / "events"))
    got = spark.read.option("header", True).csv(str(tmp_path / "events")).first()
    assert (got["observed_at"], got["tx_hash"], got["fetch_ok"], got["fetch_latency_ms"], got["gas"]) == ("2026-01-01T00:00:00.000000Z", "0x1", "true", "1.500000", None)
    (tmp_path / "accounts.json").write_text("[]")
    found = lf.manifest(spark, DetectorConfig(), {"blocks": 3}, {"accounts": str(tmp_path / "accounts.json"), "gone": str(tmp_path / "gone")})
    assert found["sha256"]["accounts"] == "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945" and "gone" in found["sha256_errors"] and found["blocks"] == 3
    lf.write_manifest(spark, found, str(tmp_path / "manifest"))
    assert json.loads(spark.read.text(str(tmp_path / "manifest")).first()[0])["config_sha256"] == found["config_sha256"]
    (tmp_path / "summary_a.json").write_text('{"metrics": {"method": "linear_scan"}}')
    (tmp_path / "summary_b.json").write_text("nothing")
    assert [r.method for r in lf.discover_runs(spark, str(tmp_path / "summary_*.json")).collect()] == ["linear_scan"]


def test_settings_change_while_running():
    from doppel.config import DetectorConfig

    held = live.Settings(DetectorConfig())
    held.apply(DetectorConfig(tau=0.5))
    assert held.get().tau == 0.5
