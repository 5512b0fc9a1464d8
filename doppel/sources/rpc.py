"""A Python data source for JSON-RPC: blocks of a range, and their transactions.

Options: `url` of a node or `file` with recorded answers by method and parameters; `start` and `end` block; `batch` blocks a
partition. Requests are repeated after 408, 429, 5xx, code 30, and errors that name a timeout or a rate, waiting 0.75 * 2**n
seconds, 30 at most. Nothing is fetched while planning.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

RETRY_STATUS = (408, 429, *range(500, 600))
TIMEOUT, TRIES = 25, 5


def backoff(n: int) -> float:
    return min(30.0, 0.75 * 2**n)


def retryable(status: int | None, error: dict | None) -> bool:
    if status in RETRY_STATUS:
        return True
    message = str((error or {}).get("message", "")).lower()
    return (error or {}).get("code") == 30 or "timeout" in message or "rate" in message


def call(url: str, requests: list[tuple[str, list]], key: str | None = None, send: Callable | None = None, wait: Callable[[float], None] = time.sleep, tries: int = TRIES, pause: Callable[[int], float] = backoff) -> list:
    """Results of a batch, in its order; None for what fails for good."""
    send = send or _post
    out: list = [None] * len(requests)
    todo = list(range(len(requests)))
    for n in range(tries):
        if n:
            wait(pause(n - 1))
        body = [{"jsonrpc": "2.0", "id": k, "method": requests[k][0], "params": requests[k][1]} for k in todo]
        status, answer = send(url, body, key)
        if status != 200:
            if not retryable(status, None):
                break
            continue
        again = []
        for item in answer if isinstance(answer, list) else [answer]:
            if item.get("error"):
                if retryable(None, item["error"]):
                    again.append(item["id"])
            else:
                out[item["id"]] = item.get("result")
        todo = again
        if not todo:
            break
    return out


def _post(url: str, body: list, key: str | None) -> tuple[int, list]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Drpc-Key": key} if key else {}))
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return answer.status, json.loads(answer.read())
    except urllib.error.HTTPError as e:
        return e.code, []
    except (urllib.error.URLError, TimeoutError, ValueError):
        return 599, []


def recorded(path: str) -> Callable:
    """Answers from a file: {"method|params as JSON": result}."""
    with open(path) as f:
        known = json.load(f)

    def send(url: str, body: list, key: str | None) -> tuple[int, list]:
        return 200, [{"id": b["id"], "result": known.get(f"{b['method']}|{json.dumps(b['params'])}")} for b in body]

    return send


def block_rows(block: dict | None) -> Iterator[tuple]:
    if not block:
        return
    for tx in block.get("transactions", []):
        yield int(block["number"], 16), block.get("hash"), int(block["timestamp"], 16), tx.get("hash"), tx.get("from"), tx.get("to"), tx.get("input"), tx.get("value"), tx.get("nonce"), None


def failed_row(number: int) -> tuple:
    """What stands for a block that no answer came for."""
    return (number, *[None] * 8, "no answer")


def scanned(rows) -> tuple:
    """Transactions of a block scan, and the numbers of the blocks that failed: an incomplete scan can be told."""
    from pyspark.sql import functions as F

    return rows.filter(F.col("error").isNull()).drop("error"), rows.filter(F.col("error").isNotNull()).select("block_number", "error")


def sequential(last: int, latest: int) -> range:
    """Blocks after the last one seen; on the first poll the latest only."""
    return range(latest, latest + 1) if last == 0 else range(last + 1, latest + 1)


class Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        start, end, size = int(self.options["start"]), int(self.options["end"]), int(self.options.get("batch", 3))
        return [Range(a, min(a + size - 1, end)) for a in range(start, end + 1, size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        send = recorded(self.options["file"]) if "file" in self.options else None
        requests = [("eth_getBlockByNumber", [hex(n), True]) for n in range(partition.start, partition.end + 1)]
        answers = call(self.options.get("url", ""), requests, self.options.get("key"), send)
        for n, block in zip(range(partition.start, partition.end + 1), answers, strict=True):
            if block:
                yield from block_rows(block)
            else:
                yield failed_row(n)


class BlockStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"block": 0}

    def _fetch(self, method: str, params: list):
        send = recorded(self.options["file"]) if "file" in self.options else None
        return call(self.options.get("url", ""), [(method, params)], self.options.get("key"), send)[0]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        latest = self._fetch("eth_blockNumber", [])
        rows, last = [], start["block"]
        for n in sequential(last, int(latest, 16)) if latest else ():
            block = self._fetch("eth_getBlockByNumber", [hex(n), True])
            if not block:
                break  # the rest comes with the next poll
            rows += block_rows(block)
            last = n
        return iter(rows), {"block": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        first = end["block"] if start["block"] == 0 else start["block"] + 1
        for n in range(first, end["block"] + 1):
            yield from block_rows(self._fetch("eth_getBlockByNumber", [hex(n), True]))

    def commit(self, end: dict) -> None:
        pass


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rpc_blocks"

    def schema(self) -> str:
        return "block_number long, block_hash string, block_seconds long, tx_hash string, from_addr string, to_addr string, input string, value string, nonce string, error string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)

    def simpleStreamReader(self, schema) -> BlockStream:
        return BlockStream(self.options)


# ---------------------------------------------------------------- look-ups by key, dealt to the executors

#: Selectors of decimals(), symbol() and name(), and the topic of a token transfer.
SELECTORS = {"decimals": "0x313ce567", "symbol": "0x95d89b41", "name": "0x06fdde03"}
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
LOOKUP_BATCH = 50


def _lookup(df, column: str, requests: Callable[[str], list[tuple[str, list]]], options: dict, schema: str, row: Callable[[str, list], list[tuple]]):
    """Answers for each distinct value of a column: a few requests a value, LOOKUP_BATCH values a call."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator) -> Iterator:
        send = recorded(options["file"]) if "file" in options else None
        for frame in frames:
            keys = frame[column].tolist()
            for i in range(0, len(keys), LOOKUP_BATCH):
                part = keys[i : i + LOOKUP_BATCH]
                asked = [requests(k) for k in part]
                answers = iter(call(options.get("url", ""), [r for a in asked for r in a], options.get("key"), send))
                rows = [x for k, a in zip(part, asked, strict=True) for x in row(k, [next(answers) for _ in a])]
                yield pd.DataFrame(rows, columns=names)

    return df.select(column).distinct().mapInPandas(run, schema)


def _text(answer: str | None) -> str:
    raw = bytes.fromhex((answer or "0x")[2:])
    if len(raw) > 64:
        size = int.from_bytes(raw[32:64], "big")
        raw = raw[64 : 64 + size]
    return raw.rstrip(b"\0").decode("utf-8", "ignore")


def token_metadata(tokens, options: dict, column: str = "address"):
    """(address, decimals, symbol, name, metadata_missing) of token contracts; what fails has 18 decimals and no names."""

    def row(token: str, answers: list) -> list[tuple]:
        decimals, symbol, name = answers
        if decimals is None:
            return [(token, 18, "", "", True)]
        return [(token, int(decimals, 16), _text(symbol), _text(name), False)]

    def requests(token: str) -> list[tuple[str, list]]:
        return [("eth_call", [{"to": token, "data": data}, "latest"]) for data in SELECTORS.values()]

    return _lookup(tokens, column, requests, options, "address string, decimals int, symbol string, name string, metadata_missing boolean", row)


def transfer_logs(victims, start: int, end: int, options: dict, column: str = "victim"):
    """(victim, tx_hash, token, other, amount_hex, block_number) of transfers from and to each victim (40 digits) in a range of blocks."""
    topic = lambda v: "0x" + v.rjust(64, "0")
    span = {"fromBlock": hex(start), "toBlock": hex(end)}

    def requests(victim: str) -> list[tuple[str, list]]:
        return [("eth_getLogs", [span | {"topics": [TRANSFER_TOPIC, topic(victim)]}]), ("eth_getLogs", [span | {"topics": [TRANSFER_TOPIC, None, topic(victim)]}])]

    def row(victim: str, answers: list) -> list[tuple]:
        return [(victim, x["transactionHash"], x["address"], x["topics"][2 - side][-40:], x["data"], int(x["blockNumber"], 16)) for side, logs in enumerate(answers) for x in logs or []]

    return _lookup(victims, column, requests, options, "victim string, tx_hash string, token string, other string, amount_hex string, block_number long", row)


#: Tries of a pending transaction, and the milliseconds before each further one, times its number.
PENDING_TRIES, PENDING_WAIT_MS = 3, 150


def pending_transactions(hashes, options: dict, column: str = "hash", wait: Callable[[float], None] = time.sleep):
    """(hash, fetch_ok, fetch_attempts, from_addr, to_addr, input, value, nonce, error) of transactions told by hash only.

    A transaction that a node doesn't know yet is asked for again, with those of its batch that are still missing."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        send = recorded(options["file"]) if "file" in options else None
        for frame in frames:
            keys = frame[column].tolist()
            for i in range(0, len(keys), LOOKUP_BATCH):
                todo, rows = keys[i : i + LOOKUP_BATCH], {}
                for n in range(1, PENDING_TRIES + 1):
                    answers = call(options.get("url", ""), [("eth_getTransactionByHash", [h]) for h in todo], options.get("key"), send, wait, tries=1)
                    for h, tx in zip(todo, answers, strict=True):
                        ok = bool(tx and tx.get("hash"))
                        rows[h] = (h, ok, n, *((tx.get(c) for c in ("from", "to", "input", "value", "nonce")) if ok else [None] * 5), "" if ok else "empty tx result")
                    todo = [h for h in todo if not rows[h][1]]
                    if not todo:
                        break
                    wait(PENDING_WAIT_MS * n / 1000)
                yield pd.DataFrame(list(rows.values()), columns=["hash", "fetch_ok", "fetch_attempts", "from_addr", "to_addr", "input", "value", "nonce", "error"])

    return hashes.select(column).distinct().mapInPandas(run, "hash string, fetch_ok boolean, fetch_attempts int, from_addr string, to_addr string, input string, value string, nonce string, error string")


def receipts(hashes, options: dict, column: str = "hash"):
    """(hash, block_number, succeeded) of transactions that are in a block; others have nulls."""

    def row(tx: str, answers: list) -> list[tuple]:
        r = answers[0] or {}
        return [(tx, int(r["blockNumber"], 16) if r.get("blockNumber") else None, r.get("status") == "0x1" if r.get("status") else None)]

    return _lookup(hashes, column, lambda tx: [("eth_getTransactionReceipt", [tx])], options, "hash string, block_number long, succeeded boolean", row)
