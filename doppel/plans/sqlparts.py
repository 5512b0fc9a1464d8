"""DuckDB's form of the derived tables and of the scores, written apart from the Spark code that they check."""

from __future__ import annotations



def addr(kind: str, key: str) -> str:
    return f"left(sha256('{kind}:' || CAST({key} AS VARCHAR)), 40)"


def frac(kind: str, key: str) -> str:
    return f"(CAST(CAST('0x' || left(sha256('{kind}:' || CAST({key} AS VARCHAR)), 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), "SELECT o_orderkey k, o_custkey c, l_suppkey s, l_partkey % 20 t, l_linenumber n, l_shipdate d, l_quantity q, l_extendedprice x FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "cps": (("lines",), f"""SELECT {addr('acct', 'c')} victim, {addr('peer', 's')} recipient, {addr('tok', 't')} token, 'SYM' || CAST(t % 5 AS VARCHAR) token_symbol, 'Name' || CAST(t % 5 AS VARCHAR) token_name,
      CASE WHEN t % 3 = 0 THEN 6 ELSE 18 END token_decimals, d last_seen, count(*) observed_freq, t = 7 metadata_missing FROM lines GROUP BY c, s, t, d"""),
    "meta": ((), f"""SELECT {addr('tok', 't')} address, CASE WHEN t % 3 = 0 THEN 6 ELSE 18 END decimals, 'SYM' || CAST(t % 5 AS VARCHAR) symbol, 'Name' || CAST(t % 5 AS VARCHAR) AS name, t = 7 metadata_missing FROM range(20) r(t)"""),
    "base": (("lines",), f"""SELECT *, CASE k % 8 WHEN 0 THEN r0 WHEN 1 THEN left(r0, 6) || substr(mid, 7, 28) || right(r0, 6) WHEN 2 THEN left(r0, 4) || substr(mid, 5, 32) || right(r0, 4)
        WHEN 3 THEN left(r0, 3) || substr(mid, 4, 37) WHEN 4 THEN substr(mid, 1, 37) || right(r0, 3) WHEN 5 THEN left(r0, 2) || substr(mid, 3, 36) || right(r0, 2) ELSE mid END lookalike,
      CASE (k // 8) % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN q / 10 ELSE x END AS value, CASE (k // 24) % 4 WHEN 0 THEN {addr('tok', 't')} WHEN 1 THEN {addr('tok', '((t + 5) % 20)')} WHEN 2 THEN {addr('tok', '((t + 1) % 20)')} ELSE '' END token_address,
      k % 8 cls, (k // 24) % 4 token_class, (k // 96) % 2 = 1 is_sender_victim, d + to_days(CAST(k % 40 AS INTEGER)) observed_at
      FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, s, t, d, q, x) rn, {addr('peer', 's')} r0, {addr('mid', 'k')} mid, {addr('acct', 'c')} victim FROM lines) WHERE rn = 1"""),
    "ev": (("base",), f"""SELECT k event_id, 'tx' || CAST(k // 2 AS VARCHAR) hash, CASE WHEN is_sender_victim THEN victim ELSE lookalike END from_addr, CASE WHEN is_sender_victim THEN lookalike ELSE victim END to_addr, token_address, value,
      CASE WHEN k % 5 = 0 THEN 0.0::DOUBLE ELSE value END value_normalized, observed_at, observed_at + INTERVAL 12 SECOND block_time, greatest(0, CAST(round((epoch_us(observed_at + INTERVAL 12 SECOND + to_days(10950)) / 1e6 - 1438214400) / 12) AS BIGINT)) block_number,
      CASE WHEN k % 97 = 0 THEN NULL ELSE {frac('vis', 'k')} >= 0.1 END visible, (k % 8 BETWEEN 1 AND 5) AND value <= 10 is_poisoning, CASE WHEN value = 0 THEN 'zero_value' WHEN value <= 10 THEN 'tiny' ELSE 'intended' END label_tx_class, victim victim_hint FROM base"""),
    "labels_": (("base",), f"""SELECT greatest(0, CAST(round((epoch_us(observed_at + to_days(10950)) / 1e6 - 1438214400) / 12) AS BIGINT)) block_number, '0x' || left(sha256('tx:' || CAST(k AS VARCHAR)), 64) tx_hash, '0x' || {addr('tok', 't')} token_addr,
      '0x' || CASE WHEN is_sender_victim THEN victim ELSE lookalike END from_addr, '0x' || CASE WHEN is_sender_victim THEN lookalike ELSE victim END to_addr, is_sender_victim, value, value * 2 value_usd, cls IN (0, 6) intended_transfer,
      value = 0 AND cls BETWEEN 1 AND 5 zero_value_transfer, value > 0 AND value <= 10 AND cls BETWEEN 1 AND 5 tiny_transfer, token_class = 1 AND cls BETWEEN 1 AND 5 counterfeit_token_transfer, k % 50 = 0 payoff_transfer, k % 60 = 0 payoff_transfer_unconfirmed,
      cls = 7 is_not_categorized, '0x' || r0 intended_addr, CASE cls WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 5 THEN 2 ELSE 0 END::BIGINT num_first_matched_digits, CASE cls WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 0 END::BIGINT num_last_matched_digits FROM base"""),
    "feed": ((), f"""SELECT event_id, '0x' || left(sha256('pend:' || CAST(event_id AS VARCHAR)), 64) hash, ts observed_at, user_id, '0x' || {addr('acct', 'user_id')} from_addr, '0x' || {addr('tok', '(event_id % 20)')} to_addr, peer, amount,
      CASE WHEN event_id % 5 <= 2 THEN '0xa9059cbb' || lpad(peer, 64, '0') || lpad(lower(to_hex(amount)), 64, '0') WHEN event_id % 5 = 3 THEN '0x23b872dd' || lpad({addr('acct', 'user_id')}, 64, '0') || lpad(peer, 64, '0') || lpad(lower(to_hex(amount)), 64, '0') ELSE '0x' END input,
      event_id // 3 nonce_seed FROM (SELECT *, {addr('peer', '(user_id % 97)')} peer, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END amount FROM events)"""),
    "pairs": (("ev",), "SELECT *, from_addr victim, to_addr lookalike FROM ev UNION ALL SELECT *, to_addr victim, from_addr lookalike FROM ev"),
    "shown": (("ev",), "SELECT * FROM ev WHERE coalesce(visible, true)"),
    "spairs": (("shown",), "SELECT *, from_addr victim, to_addr lookalike FROM shown UNION ALL SELECT *, to_addr victim, from_addr lookalike FROM shown"),
}


def lcp(a: str, b: str, most: int = 6) -> str:
    return "(" + " + ".join(f"(left({a}, {d}) = left({b}, {d}))::INT" for d in range(1, most + 1)) + ")"


def lcs(a: str, b: str, most: int = 6) -> str:
    return "(" + " + ".join(f"(right({a}, {d}) = right({b}, {d}))::INT" for d in range(1, most + 1)) + ")"


ACTIVE = "recipient <> lookalike AND (last_seen IS NULL OR observed_at IS NULL OR epoch_us(last_seen) = 0 OR (last_seen <= observed_at AND epoch_us(observed_at) - epoch_us(last_seen) <= 30 * 86400 * 1000000::BIGINT))"
V = "(CASE WHEN value_normalized <> 0 THEN value_normalized ELSE value END)"
S_TYPE = f"(CASE WHEN {V} = 0 THEN 1.0::DOUBLE WHEN {V} > 0 AND {V} <= 10 THEN 0.8::DOUBLE ELSE 0.25::DOUBLE END)"
S_TOKEN = "(CASE WHEN token_address = '' OR token = '' THEN 0.4::DOUBLE WHEN token_address = token THEN 0.2::DOUBLE WHEN coalesce(NOT p_missing AND NOT metadata_missing AND (lower(p_symbol) = lower(token_symbol) OR lower(p_name) = lower(token_name)), false) THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)"
S_TIME = "exp(-greatest(0, (epoch_us(observed_at) - epoch_us(last_seen)) / 1e6) / 604800.0)"
S_VALUE = f"(CASE WHEN {V} = 0 THEN 1.0::DOUBLE WHEN {V} <= 10 THEN 0.7::DOUBLE ELSE greatest(0.1, 1 / (1 + log10(1 + {V}))) END)"
SUM_ADDR = "((least(ap, 6) + least(as_, 6)) / 12.0::DOUBLE)"


def cand(where: str, pairs: str = "pairs", inner: str | None = None) -> str:
    """Candidate histories with metadata; `where` restricts by ap and as_."""
    src = inner or f"SELECT p.*, c.recipient, c.token, c.token_symbol, c.token_name, c.last_seen, c.observed_freq, c.metadata_missing, {lcp('p.lookalike', 'c.recipient')} ap, {lcs('p.lookalike', 'c.recipient')} as_ FROM {pairs} p JOIN cps c USING (victim)"
    return f"SELECT q.*, m.symbol p_symbol, m.name p_name, m.metadata_missing p_missing FROM ({src}) q LEFT JOIN meta m ON m.address = q.token_address WHERE {where}"


UNION = "ap >= 3 OR as_ >= 3"


def logistic(w0: float = -8.127027112801793, w1: float = 20.659171304234917, w2: float = 22.44110879456234, b: float = -3.1619704800591686) -> str:
    return f"(1 / (1 + exp(-(({b}::DOUBLE) + ({w0}::DOUBLE) * s_addr + ({w1}::DOUBLE) * s_addr * s_type + ({w2}::DOUBLE) * s_addr * s_token))))"


GATE = "(s_addr * (0.3 + 0.7 * least(1.0, greatest(0.0, (0.65 * s_type + 0.35 * s_token + 0.0 * s_value + 0.0 * s_time * greatest(s_type, s_token)) / 1.0))))"
ADDITIVE = "(0.30 * s_addr + 0.20 * s_type + 0.20 * s_token + 0.15 * s_time + 0.15 * s_value)"


def scored(total: str, addr_: str = SUM_ADDR, timed: bool = False, src: str = "act") -> str:
    return f"SELECT *, {total} AS total FROM (SELECT *, {addr_} s_addr, {S_TYPE} s_type, {S_TOKEN} s_token, {S_TIME if timed else '0.0::DOUBLE'} s_time, {S_VALUE if timed else '0.0::DOUBLE'} s_value FROM {src})"


BEST = "SELECT *, count(*) OVER (PARTITION BY event_id, victim, lookalike, recipient) n_scored, row_number() OVER (PARTITION BY event_id, victim, lookalike, recipient ORDER BY total DESC, last_seen DESC, token) rn FROM sc"


def sql(body: str, *names: str, **more: str) -> str:
    """`body` after the named tables and what they need; `more` are further ones, in order."""
    got: dict[str, str] = {}

    def need(n: str) -> None:
        if n not in got:
            for m in CTES[n][0]:
                need(m)
            got[n] = CTES[n][1]

    for n in names:
        need(n)
    got |= more
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in got.items()) + "\n" + body


def alert_ctes(where: str = UNION, total: str | None = None, pairs: str = "pairs", addr_: str = SUM_ADDR, inner: str | None = None, timed: bool = False) -> dict[str, str]:
    """cand, act, sc and best (rows rn = 1 are each recipient's best)."""
    return {"cand": cand(where, pairs, inner), "act": f"SELECT * FROM cand WHERE {ACTIVE}", "sc": scored(total or logistic(), addr_, timed), "best": BEST}


