"""State machines over event logs, as ordered folds.

Each function checks its parameters and returns a :class:`~loomery.operators.fold.Fold`.
Rows offer ``t`` (a tick), ``v`` (a whole number), ``kind`` (a word) and ``ok``
(a flag) as each machine's docstring says.
"""

from __future__ import annotations

from loomery.errors import BadRequest
from loomery.operators.fold import Fold

#: The other dialect's names of the array functions used below.
ARRAYS = {
    "size(": "len(", "array_append(": "list_append(", "array_contains(": "list_contains(", "filter(": "list_filter(",
    "e ->": "lambda e:", "element_at(": "list_extract(", "concat(": "list_concat(", "array()": "[]", "transform(": "list_transform(",
    "array_min(": "list_min(", "array_max(": "list_max(", "array(": "list_value(", "sequence(": "generate_series(",
}
N = "BIGINT"


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise BadRequest(why)


# ---- rate and concurrency limits


def token_bucket(burst: int = 5, refill: int = 1) -> Fold:
    """Tokens refill with ``t`` up to ``burst``; each row takes one or is refused."""
    _need(burst >= refill >= 1, "burst must be at least the refill, and that at least one")
    return Fold(
        {"tok": (N, str(burst), "$full - $go"), "last": (N, "NULL", "x.t"), "yes": (N, "0", "s.yes + $go"), "no": (N, "0", "s.no + 1 - $go"), "low": (N, str(burst), "least(s.low, $full - $go)")},
        {"admitted": (N, "s.yes"), "refused": (N, "s.no"), "tokens_left": (N, "s.tok"), "lowest": (N, "s.low")},
        {"full": f"least({burst}, s.tok + (x.t - coalesce(s.last, x.t)) * {refill})", "go": "CASE WHEN $full >= 1 THEN 1 ELSE 0 END"},
    )


def gcra(interval: int = 60, tolerance: int = 120) -> Fold:
    """Generic cell rate: a row conforms unless it is more than the tolerance ahead of its theoretical time."""
    _need(interval > 0 and tolerance >= 0, "the interval must be positive and the tolerance not negative")
    return Fold(
        {"tat": (N, "NULL", f"CASE WHEN $go THEN greatest(x.t, $tat) + {interval} ELSE $tat END"), "yes": (N, "0", "s.yes + CASE WHEN $go THEN 1 ELSE 0 END"), "no": (N, "0", "s.no + CASE WHEN $go THEN 0 ELSE 1 END")},
        {"conforming": (N, "s.yes"), "rejected": (N, "s.no")},
        {"tat": "coalesce(s.tat, x.t)", "go": f"x.t >= $tat - {tolerance}"},
    )


def leaky_bucket(rate: int = 10, capacity: int = 60) -> Fold:
    """``v`` units arrive, the excess over the capacity is lost, then ``rate`` units leave."""
    _need(rate > 0 and capacity > 0, "rate and capacity must be positive")
    return Fold(
        {"q": (N, "0", f"greatest(0, $held - {rate})"), "lost": (N, "0", "s.lost + s.q + x.v - $held"), "out": (N, "0", f"s.out + least({rate}, $held)")},
        {"queued": (N, "s.q"), "overflow": (N, "s.lost"), "emitted": (N, "s.out")},
        {"held": f"least({capacity}, s.q + x.v)"},
    )


def sliding_log(limit: int = 3, window: int = 3600) -> Fold:
    """A row is admitted if fewer than ``limit`` rows were within the last ``window`` ticks; only admitted rows count."""
    _need(limit > 0 and window > 0, "limit and window must be positive")
    return Fold(
        {"log": ("ARRAY<BIGINT>", "array()", "CASE WHEN $go THEN array_append($live, x.t) ELSE $live END"), "yes": (N, "0", "s.yes + CASE WHEN $go THEN 1 ELSE 0 END"), "no": (N, "0", "s.no + CASE WHEN $go THEN 0 ELSE 1 END")},
        {"admitted": (N, "s.yes"), "refused": (N, "s.no")},
        {"live": f"filter(s.log, e -> e > x.t - {window})", "go": f"size($live) < {limit}"},
        ARRAYS,
    )


def aimd(start: int = 10, floor: int = 1, ceiling: int = 64) -> Fold:
    """The limit grows by one on ``ok`` and halves otherwise."""
    _need(1 <= floor <= start <= ceiling, "need 1 <= floor <= start <= ceiling")
    return Fold(
        {"cap": (N, str(start), f"CASE WHEN x.ok THEN least({ceiling}, s.cap + 1) ELSE greatest({floor}, floor(s.cap / 2)) END"), "low": (N, str(start), f"least(s.low, CASE WHEN x.ok THEN s.cap ELSE greatest({floor}, floor(s.cap / 2)) END)")},
        {"limit_now": (N, "s.cap"), "lowest": (N, "s.low")},
    )


def vegas(start: int = 10) -> Fold:
    """The limit follows the queue that ``v`` (a round trip) implies against the least one seen."""
    return Fold(
        {
            "low": (N, "NULL", "$low"),
            "cap": (N, str(start), "greatest(1, CASE WHEN $queue < 3 THEN s.cap + 1 WHEN $queue > 6 THEN s.cap - 1 ELSE s.cap END)"),
        },
        {"limit_now": (N, "s.cap"), "least_rtt": (N, "s.low")},
        {"low": "least(coalesce(s.low, x.v + 1), x.v + 1)", "queue": "s.cap * (1 - $low / CAST(x.v + 1 AS DOUBLE))"},
    )


def slow_start(threshold: int = 16) -> Fold:
    """The window doubles up to the threshold, then grows by one; a row that is not ``ok`` halves the threshold and restarts."""
    return Fold(
        {
            "w": (N, "1", "CASE WHEN NOT x.ok THEN 1 WHEN s.w < s.h THEN least(s.w * 2, s.h) ELSE s.w + 1 END"),
            "h": (N, str(threshold), "CASE WHEN x.ok THEN s.h ELSE greatest(1, floor(s.w / 2)) END"),
            "top": (N, "1", "greatest(s.top, s.w)"),
        },
        {"window_now": (N, "s.w"), "threshold_now": (N, "s.h"), "peak": (N, "s.top")},
    )


def bulkhead(slots: int = 2) -> Fold:
    """Rows of kind ``signup`` or ``purchase`` give a slot back, all others ask for one."""
    _need(slots > 0, "a partition needs slots")
    return Fold(
        {"used": (N, "0", "CASE WHEN $back THEN greatest(0, s.used - 1) WHEN s.used < $cap THEN s.used + 1 ELSE s.used END"), "no": (N, "0", "s.no + CASE WHEN NOT $back AND s.used >= $cap THEN 1 ELSE 0 END")},
        {"in_use": (N, "s.used"), "turned_away": (N, "s.no")},
        {"back": "x.kind IN ('signup', 'purchase')", "cap": str(slots)},
    )


def credits(capacity: int = 8) -> Fold:
    """A ``purchase`` drains what is in flight; every other row sends if there is credit."""
    _need(capacity > 0, "capacity must be positive")
    return Fold(
        {"c": (N, str(capacity), f"CASE WHEN x.kind = 'purchase' THEN {capacity} WHEN s.c > 0 THEN s.c - 1 ELSE 0 END"), "halted": (N, "0", "s.halted + CASE WHEN x.kind <> 'purchase' AND s.c = 0 THEN 1 ELSE 0 END")},
        {"credit": (N, "s.c"), "halted_sends": (N, "s.halted")},
    )


def circuit_breaker(threshold: int = 2, cooldown: int = 86400) -> Fold:
    """Opens after ``threshold`` failures in a row, lets one row try after the cooldown; rows meanwhile are short-circuited."""
    _need(threshold > 0 and cooldown > 0, "threshold and cooldown must be positive")
    return Fold(
        {
            "open": ("BOOLEAN", "FALSE", "$trip OR $blocked"),
            "fails": (N, "0", f"CASE WHEN $blocked THEN s.fails WHEN x.ok OR $trip THEN 0 ELSE s.fails + 1 END"),
            "at": (N, "0", "CASE WHEN $trip THEN x.t ELSE s.at END"),
            "trips": (N, "0", "s.trips + CASE WHEN $trip THEN 1 ELSE 0 END"),
            "cut": (N, "0", "s.cut + CASE WHEN $blocked THEN 1 ELSE 0 END"),
        },
        {"is_open": ("BOOLEAN", "s.open"), "trips": (N, "s.trips"), "short_circuited": (N, "s.cut")},
        {"blocked": f"s.open AND x.t - s.at < {cooldown}", "trip": f"NOT $blocked AND NOT x.ok AND (s.open OR s.fails + 1 >= {threshold})"},
    )


def hysteresis(low: int = 20, high: int = 80) -> Fold:
    """Depth rises by ``v`` on ``ok`` rows, falls by ``v`` otherwise (never below 0); paused from ``high`` until ``low``."""
    _need(0 <= low < high, "need 0 <= low < high")
    return Fold(
        {"d": (N, "0", "$d"), "p": ("BOOLEAN", "FALSE", "$p"), "flips": (N, "0", "s.flips + CASE WHEN $p <> s.p THEN 1 ELSE 0 END")},
        {"depth": (N, "s.d"), "paused": ("BOOLEAN", "s.p"), "flips": (N, "s.flips")},
        {"d": "CASE WHEN x.ok THEN s.d + x.v ELSE greatest(0, s.d - x.v * 3) END", "p": f"CASE WHEN $d >= {high} THEN TRUE WHEN $d <= {low} THEN FALSE ELSE s.p END"},
    )


def metastable(healthy: int = 50, amplification: float = 1.5, shed: int = 20) -> Fold:
    """Tips into failure above twice the healthy load; a failed system amplifies its excess until a row below ``shed`` resets it."""
    _need(healthy > 0 and amplification > 1, "the threshold must be positive and the amplification above one")
    return Fold(
        {
            "load": ("DOUBLE", "0", f"CASE WHEN NOT s.bad OR $calm THEN x.v ELSE least(1e6, x.v + (s.load - {healthy}) * {amplification}) END"),
            "bad": ("BOOLEAN", "FALSE", f"CASE WHEN s.bad THEN NOT $calm ELSE x.v > {2 * healthy - 5} END"),
            "tips": (N, "0", f"s.tips + CASE WHEN NOT s.bad AND x.v > {2 * healthy - 5} THEN 1 ELSE 0 END"),
        },
        {"failed": ("BOOLEAN", "s.bad"), "tips": (N, "s.tips"), "load_now": ("DOUBLE", "round(s.load, 4)")},
        {"calm": f"x.v < {shed}"},
    )


def deadline(budget: int = 400) -> Fold:
    """Stages of cost ``v + 1`` run while they fit what is left; a later, cheaper one may still run."""
    _need(budget >= 1, "a deadline needs a budget")
    return Fold(
        {"left": (N, str(budget), "CASE WHEN $fits THEN s.left - x.v - 1 ELSE s.left END"), "ran": (N, "0", "s.ran + CASE WHEN $fits THEN 1 ELSE 0 END"), "gone": (N, "0", "s.gone + CASE WHEN $fits THEN 0 ELSE 1 END")},
        {"remaining": (N, "s.left"), "stages_run": (N, "s.ran"), "abandoned": (N, "s.gone")},
        {"fits": "x.v + 1 <= s.left"},
    )


def priority_lanes(express_per_standard: int = 3) -> Fold:
    """Purchases and signups queue in the express lane, clicks and views in the standard one, an error drains one row."""
    _need(express_per_standard >= 1, "the ratio must be at least one")
    return Fold(
        {
            "e": (N, "0", "s.e + CASE WHEN x.kind IN ('purchase', 'signup') THEN 1 WHEN $take = 'e' THEN -1 ELSE 0 END"),
            "d": (N, "0", "s.d + CASE WHEN x.kind IN ('click', 'view') THEN 1 WHEN $take = 's' THEN -1 ELSE 0 END"),
            "run": (N, "0", "CASE WHEN $take = 'e' THEN s.run + 1 WHEN $take = 's' THEN 0 ELSE s.run END"),
            "ne": (N, "0", "s.ne + CASE WHEN $take = 'e' THEN 1 ELSE 0 END"),
            "ns": (N, "0", "s.ns + CASE WHEN $take = 's' THEN 1 ELSE 0 END"),
        },
        {"express_drained": (N, "s.ne"), "standard_drained": (N, "s.ns"), "express_waiting": (N, "s.e"), "standard_waiting": (N, "s.d")},
        {"take": f"CASE WHEN x.kind <> 'error' THEN '-' WHEN s.e > 0 AND (s.d = 0 OR s.run < {express_per_standard}) THEN 'e' WHEN s.d > 0 THEN 's' ELSE '-' END"},
    )


def single_flight(flight: int = 7200) -> Fold:
    """The first request of an idle period fetches; requests until it resolves wait."""
    return Fold(
        {"until": (N, "NULL", f"CASE WHEN $free THEN x.t + {flight} ELSE s.until END"), "f": (N, "0", "s.f + CASE WHEN $free THEN 1 ELSE 0 END"), "w": (N, "0", "s.w + CASE WHEN $free THEN 0 ELSE 1 END")},
        {"fetches": (N, "s.f"), "waiters": (N, "s.w")},
        {"free": "s.until IS NULL OR x.t >= s.until"},
    )


def visibility(timeout: int = 86400) -> Fold:
    """Views are sent messages, clicks receive one and hide it, purchases acknowledge one; hidden ones come back."""
    return Fold(
        {
            "ready": (N, "0", "$back + CASE WHEN x.kind = 'view' THEN 1 WHEN x.kind = 'click' AND $back > 0 THEN -1 ELSE 0 END"),
            "held": ("ARRAY<BIGINT>", "array()", f"CASE WHEN x.kind = 'click' AND $back > 0 THEN array_append($live, x.t + {timeout}) WHEN x.kind = 'purchase' AND size($live) > 0 THEN filter($live, e -> e > element_at($live, 1)) ELSE $live END"),
            "again": (N, "0", "s.again + size(s.held) - size($live)"),
        },
        {"available": (N, "s.ready"), "in_flight": (N, "size(s.held)"), "redelivered": (N, "s.again")},
        {"live": "filter(s.held, e -> e > x.t)", "back": "s.ready + size(s.held) - size($live)"},
        ARRAYS,
    )


def lru(capacity: int = 3, ids: int = 7) -> Fold:
    """Accesses of item ``v % ids``: a hit moves it to the end, a miss evicts the least recent."""
    _need(capacity >= 1, "capacity must be positive")
    return Fold(
        {"keys": ("ARRAY<BIGINT>", "array()", f"array_append(CASE WHEN $hit THEN filter(s.keys, e -> e <> $id) WHEN size(s.keys) >= {capacity} THEN filter(s.keys, e -> e <> element_at(s.keys, 1)) ELSE s.keys END, $id)"), "hits": (N, "0", "s.hits + CASE WHEN $hit THEN 1 ELSE 0 END"), "n": (N, "0", "s.n + 1")},
        {"hits": (N, "s.hits"), "accesses": (N, "s.n"), "cached": (N, "size(s.keys)")},
        {"id": f"x.v % {ids}", "hit": "array_contains(s.keys, $id)"},
        ARRAYS,
    )


# ---- delivery, batching, sinks


def micro_batch(size: int = 4, interval: int = 86400) -> Fold:
    """A crate leaves when it is full or, at the next row, older than the interval."""
    _need(size >= 1 and interval >= 1, "size and interval must be positive")
    return Fold(
        {"n": (N, "0", "CASE WHEN $full THEN 0 ELSE s.n + 1 END"), "since": (N, "NULL", "CASE WHEN $full THEN NULL ELSE coalesce(s.since, x.t) END"), "out": (N, "0", "s.out + CASE WHEN $full THEN 1 ELSE 0 END"), "big": (N, "0", "s.big + CASE WHEN $full AND s.n + 1 < " + str(size) + " THEN 1 ELSE 0 END")},
        {"crates": (N, "s.out"), "flushed_by_age": (N, "s.big"), "left_over": (N, "s.n")},
        {"full": f"s.n + 1 >= {size} OR x.t - coalesce(s.since, x.t) >= {interval}"},
    )


def group_commit(batch: int = 5, wait: int = 43200) -> Fold:
    """One sync for up to ``batch`` records or once the oldest waited ``wait`` ticks."""
    return Fold(
        {"p": (N, "0", "CASE WHEN $full THEN 0 ELSE $p + 1 END"), "first": (N, "NULL", "CASE WHEN $full THEN NULL ELSE coalesce(CASE WHEN $late THEN NULL ELSE s.first END, x.t) END"), "syncs": (N, "0", "s.syncs + CASE WHEN $late THEN 1 ELSE 0 END + CASE WHEN $full THEN 1 ELSE 0 END"), "n": (N, "0", "s.n + 1")},
        {"fsyncs": (N, "s.syncs"), "pending": (N, "s.p"), "durable": (N, "s.n - s.p")},
        {"late": f"s.p > 0 AND x.t - s.first >= {wait}", "p": "CASE WHEN $late THEN 0 ELSE s.p END", "full": f"$p + 1 >= {batch}"},
    )


def rolling_sink(records: int = 6, age: int = 172800, idle: int = 86400) -> Fold:
    """A file rolls when it is full, too old, or was idle too long."""
    return Fold(
        {"n": (N, "0", "CASE WHEN s.n = 0 OR $roll THEN 1 ELSE s.n + 1 END"), "open": (N, "NULL", "CASE WHEN s.n = 0 OR $roll THEN x.t ELSE s.open END"), "last": (N, "NULL", "x.t"), "files": (N, "0", "s.files + CASE WHEN $roll THEN 1 ELSE 0 END")},
        {"committed": (N, "s.files"), "open_records": (N, "s.n")},
        {"roll": f"s.n > 0 AND (s.n >= {records} OR x.t - s.open >= {age} OR x.t - s.last >= {idle})"},
    )


def size_tiered(tier: int = 3) -> Fold:
    """Flushes of unit runs; ``tier`` equal runs merge. The runs of a count are its digits in base ``tier``."""
    _need(tier >= 2, "a tier has two runs at least")
    return Fold(
        {"n": (N, "0", "s.n + 1"), "bytes": (N, "0", "s.bytes + 1" + "".join(f" + CASE WHEN (s.n + 1) % {tier**k} = 0 THEN {tier**k} ELSE 0 END" for k in range(1, 8)))},
        {"flushes": (N, "s.n"), "runs": (N, " + ".join(f"(CAST(floor(s.n / {tier**k}) AS BIGINT) % {tier})" for k in range(8))), "bytes_written": (N, "s.bytes")},
    )


def poison_budget(budget: int = 2) -> Fold:
    """Failures in a row beyond the budget quarantine a row; a success clears the count."""
    return Fold(
        {"f": (N, "0", "CASE WHEN x.ok OR $out THEN 0 ELSE s.f + 1 END"), "q": (N, "0", "s.q + CASE WHEN $out THEN 1 ELSE 0 END"), "r": (N, "0", "s.r + CASE WHEN NOT x.ok AND NOT $out THEN 1 ELSE 0 END")},
        {"quarantined": (N, "s.q"), "retries": (N, "s.r")},
        {"out": f"NOT x.ok AND s.f + 1 >= {budget}"},
    )


def correlate(timeout: int = 86400) -> Fold:
    """A view is a request, a purchase its response; the outstanding request times out after ``timeout``."""
    return Fold(
        {
            "at": (N, "NULL", "CASE WHEN x.kind = 'view' THEN coalesce($at, x.t) WHEN x.kind = 'purchase' THEN NULL ELSE $at END"),
            "done": (N, "0", "s.done + CASE WHEN x.kind = 'purchase' AND $at IS NOT NULL THEN 1 ELSE 0 END"),
            "orphans": (N, "0", "s.orphans + CASE WHEN x.kind = 'purchase' AND $at IS NULL THEN 1 ELSE 0 END"),
            "old": (N, "0", "s.old + CASE WHEN s.at IS NOT NULL AND $at IS NULL THEN 1 ELSE 0 END"),
            "dup": (N, "0", "s.dup + CASE WHEN x.kind = 'view' AND $at IS NOT NULL THEN 1 ELSE 0 END"),
        },
        {"matched": (N, "s.done"), "orphan_responses": (N, "s.orphans"), "timed_out": (N, "s.old"), "duplicate_requests": (N, "s.dup")},
        {"at": f"CASE WHEN x.t - s.at > {timeout} THEN NULL ELSE s.at END"},
    )


def ttl_cache(ttl: int = 86400) -> Fold:
    """Purchases load an entry; other rows look it up: absent, fresh, or stale but served."""
    return Fold(
        {"at": (N, "NULL", "CASE WHEN x.kind = 'purchase' THEN x.t ELSE s.at END"), "miss": (N, "0", "s.miss + CASE WHEN $look AND s.at IS NULL THEN 1 ELSE 0 END"), "fresh": (N, "0", f"s.fresh + CASE WHEN $look AND x.t - s.at <= {ttl} THEN 1 ELSE 0 END"), "stale": (N, "0", f"s.stale + CASE WHEN $look AND x.t - s.at > {ttl} THEN 1 ELSE 0 END")},
        {"misses": (N, "s.miss"), "fresh_hits": (N, "s.fresh"), "stale_hits": (N, "s.stale")},
        {"look": "x.kind <> 'purchase'"},
    )


def sequence_pattern(stages: tuple[str, ...] = ("view", "click", "purchase"), window: int = 172800) -> Fold:
    """Stages in order within a window; the first stage (re)starts, other rows are ignored, a late partial is dropped."""
    _need(len(stages) >= 2 and window > 0, "a pattern needs two stages and a window")
    names = "CASE " + " ".join(f"WHEN x.kind = '{s}' THEN {k}" for k, s in enumerate(stages)) + " ELSE -1 END"
    last = len(stages) - 1
    return Fold(
        {
            "at": (N, "-1", f"CASE WHEN $stage = 0 THEN 0 WHEN $next AND $stage = {last} THEN -1 WHEN $next THEN $stage ELSE $at END"),
            "start": (N, "0", "CASE WHEN $stage = 0 THEN x.t ELSE s.start END"),
            "hits": (N, "0", f"s.hits + CASE WHEN $next AND $stage = {last} THEN 1 ELSE 0 END"),
            "gone": (N, "0", "s.gone + CASE WHEN s.at >= 0 AND $at < 0 THEN 1 ELSE 0 END"),
        },
        {"matches": (N, "s.hits"), "abandoned": (N, "s.gone"), "partial_stage": (N, "s.at")},
        {"stage": names, "at": f"CASE WHEN s.at >= 0 AND x.t - s.start > {window} THEN -1 ELSE s.at END", "next": "$at >= 0 AND $stage = $at + 1"},
    )


def account(overdraft: int = 0) -> Fold:
    """Purchases withdraw ``v`` if the balance allows, other rows deposit it."""
    return Fold(
        {"b": (N, "0", "CASE WHEN x.kind <> 'purchase' THEN s.b + x.v WHEN $ok THEN s.b - x.v ELSE s.b END"), "no": (N, "0", "s.no + CASE WHEN x.kind = 'purchase' AND NOT $ok THEN 1 ELSE 0 END")},
        {"balance": (N, "s.b"), "refused": (N, "s.no")},
        {"ok": f"s.b - x.v >= {-overdraft}"},
    )


def kahan() -> Fold:
    """Compensated sum of ``v / 7``."""
    return Fold(
        {"sum": ("DOUBLE", "0", "$total"), "c": ("DOUBLE", "0", "($total - s.sum) - $y")},
        {"total": ("DOUBLE", "round(s.sum, 6)")},
        {"y": "x.v / CAST(7 AS DOUBLE) - s.c", "total": "s.sum + $y"},
    )


# ---- sketches that depend on order


def frugal_median() -> Fold:
    """One number that steps towards each sample."""
    return Fold({"m": (N, "NULL", "CASE WHEN s.m IS NULL THEN x.v WHEN x.v > s.m THEN s.m + 1 WHEN x.v < s.m THEN s.m - 1 ELSE s.m END")}, {"estimate": (N, "s.m")})


def morris() -> Fold:
    """Approximate counter: the exponent grows with probability ``2 ** -exponent``, coins taken from ``v``."""
    return Fold({"e": (N, "0", "s.e + CASE WHEN (x.v + x.t) % CAST(power(2, s.e) AS BIGINT) = 0 THEN 1 ELSE 0 END")}, {"exponent": (N, "s.e"), "estimate": (N, "CAST(power(2, s.e) AS BIGINT) - 1")})


def boyer_moore(ids: int = 3) -> Fold:
    """Majority candidate of ``v % ids``."""
    return Fold({"c": (N, "NULL", f"CASE WHEN s.n = 0 THEN x.v % {ids} ELSE s.c END"), "n": (N, "0", f"CASE WHEN s.n = 0 OR s.c = x.v % {ids} THEN s.n + 1 ELSE s.n - 1 END")}, {"candidate": (N, "s.c")})


def cusum(target: int = 50, slack: int = 10, threshold: int = 60) -> Fold:
    """Two one-sided cumulative sums; alarms are counted, nothing is reset."""
    return Fold(
        {"up": (N, "0", "$up"), "down": (N, "0", "$down"), "a": (N, "0", f"s.a + CASE WHEN $up > {threshold} THEN 1 ELSE 0 END"), "b": (N, "0", f"s.b + CASE WHEN $down > {threshold} THEN 1 ELSE 0 END")},
        {"high": (N, "s.up"), "low": (N, "s.down"), "up_alarms": (N, "s.a"), "down_alarms": (N, "s.b")},
        {"up": f"greatest(0, s.up + x.v - {target} - {slack})", "down": f"greatest(0, s.down + {target} - x.v - {slack})"},
    )


def ew_deviation(alpha: float = 0.3, sigmas: float = 3.0) -> Fold:
    """Exponentially weighted mean and variance; a value beyond ``sigmas`` deviations of the state before it is an anomaly."""
    _need(0 < alpha <= 1, "alpha must be in (0, 1]")
    return Fold(
        {
            "m": ("DOUBLE", "NULL", f"CASE WHEN s.m IS NULL THEN x.v ELSE s.m + {alpha} * (x.v - s.m) END"),
            "q": ("DOUBLE", "0", f"CASE WHEN s.m IS NULL THEN 0 ELSE (1 - {alpha}) * (s.q + {alpha} * (x.v - s.m) * (x.v - s.m)) END"),
            "odd": (N, "0", f"s.odd + CASE WHEN s.m IS NOT NULL AND abs(x.v - s.m) > {sigmas} * sqrt(s.q) + 1e-9 THEN 1 ELSE 0 END"),
        },
        {"mean": ("DOUBLE", "round(s.m, 5)"), "deviation": ("DOUBLE", "round(sqrt(s.q), 5)"), "anomalies": (N, "s.odd")},
    )


def holt(alpha: float = 0.5, beta: float = 0.3, steps: int = 3) -> Fold:
    """Level and trend smoothing; the forecast is ``steps`` ahead."""
    return Fold(
        {"l": ("DOUBLE", "NULL", f"CASE WHEN s.l IS NULL THEN x.v ELSE $l END"), "b": ("DOUBLE", "0", f"CASE WHEN s.l IS NULL THEN 0 ELSE {beta} * ($l - s.l) + (1 - {beta}) * s.b END")},
        {"level": ("DOUBLE", "round(s.l, 5)"), "trend": ("DOUBLE", "round(s.b, 5)"), "forecast": ("DOUBLE", f"round(s.l + {steps} * s.b, 5)")},
        {"l": f"{alpha} * x.v + (1 - {alpha}) * (s.l + s.b)"},
    )


def max_product(modulus: int = 5) -> Fold:
    """Largest product of a run of ``v % modulus - 1`` (a bounded logarithm-free form: sign and zeros decide)."""
    return Fold(
        {"hi": ("DOUBLE", "NULL", "greatest($w, coalesce(s.hi, 1) * $w, coalesce(s.lo, 1) * $w)"), "lo": ("DOUBLE", "NULL", "least($w, coalesce(s.hi, 1) * $w, coalesce(s.lo, 1) * $w)"), "best": ("DOUBLE", "NULL", "greatest(coalesce(s.best, $w), $w, coalesce(s.hi, 1) * $w, coalesce(s.lo, 1) * $w)")},
        {"best": ("DOUBLE", "s.best")},
        {"w": f"CAST(x.v % {modulus} - 2 AS DOUBLE) / 2"},
    )


def capped_sessions(gap: int = 43200, longest: int = 172800) -> Fold:
    """A session ends after ``gap`` idle ticks or when it has lasted ``longest``."""
    return Fold(
        {"start": (N, "NULL", "CASE WHEN s.start IS NULL OR $cut THEN x.t ELSE s.start END"), "last": (N, "NULL", "x.t"), "closed": (N, "0", "s.closed + CASE WHEN $cut THEN 1 ELSE 0 END"), "capped": (N, "0", f"s.capped + CASE WHEN $cut AND x.t - s.last < {gap} THEN 1 ELSE 0 END")},
        {"closed": (N, "s.closed"), "capped": (N, "s.capped"), "open_since": (N, "s.start")},
        {"cut": f"s.start IS NOT NULL AND (x.t - s.last >= {gap} OR x.t - s.start >= {longest})"},
    )


def global_window(every: int = 5) -> Fold:
    """A pane over everything that fires and empties at each ``every`` rows."""
    return Fold(
        {"n": (N, "0", f"CASE WHEN s.n + 1 = {every} THEN 0 ELSE s.n + 1 END"), "sum": (N, "0", f"CASE WHEN s.n + 1 = {every} THEN 0 ELSE s.sum + x.v END"), "fired": (N, "0", f"s.fired + CASE WHEN s.n + 1 = {every} THEN 1 ELSE 0 END"), "top": (N, "NULL", f"CASE WHEN s.n + 1 = {every} THEN greatest(coalesce(s.top, 0), s.sum + x.v) ELSE s.top END")},
        {"firings": (N, "s.fired"), "largest_pane": (N, "s.top"), "held": (N, "s.n")},
    )


def early_triggers(interval: int = 86400, window: int = 604800) -> Fold:
    """Panes of ``window`` ticks with early estimates each ``interval`` after the last firing; the first fold fires."""
    return Fold(
        {"w": (N, "NULL", "$w"), "last": (N, "NULL", "CASE WHEN $fire THEN x.t ELSE s.last END"), "early": (N, "0", "s.early + CASE WHEN $fire THEN 1 ELSE 0 END"), "panes": (N, "0", "s.panes + CASE WHEN $new THEN 1 ELSE 0 END"), "sum": (N, "0", "CASE WHEN $new THEN x.v ELSE s.sum + x.v END")},
        {"estimates": (N, "s.early"), "panes": (N, "s.panes"), "last_answer": (N, "s.sum")},
        {"w": f"CAST(floor(x.t / {window}) AS BIGINT)", "new": "s.w IS NULL OR $w <> s.w", "fire": f"$new OR x.t - s.last >= {interval}"},
    )


def lateness_pane(window: int = 604800, lateness: int = 86400, skew: int = 259200) -> Fold:
    """Rows whose time is behind the greatest ``t`` seen: folded into their open pane, a correction within the allowance, else dropped."""
    return Fold(
        {"mark": (N, "NULL", "greatest(coalesce(s.mark, x.t), x.t)"), "fine": (N, "0", "s.fine + CASE WHEN $e > $m THEN 1 ELSE 0 END"), "fix": (N, "0", f"s.fix + CASE WHEN $e <= $m AND $m <= $e + {lateness} THEN 1 ELSE 0 END"), "gone": (N, "0", f"s.gone + CASE WHEN $m > $e + {lateness} THEN 1 ELSE 0 END")},
        {"on_time": (N, "s.fine"), "corrections": (N, "s.fix"), "dropped": (N, "s.gone")},
        {"m": "coalesce(s.mark, x.t)", "e": f"(CAST(floor((x.t - (x.v * 7919) % {skew}) / {window}) AS BIGINT) + 1) * {window}"},
    )


def clamped_lag() -> Fold:
    """Lag rises by ``v`` on ok rows and drains by 60 otherwise, never below 0."""
    return Fold({"lag": (N, "0", "greatest(0, s.lag + CASE WHEN x.ok THEN x.v - 55 ELSE -60 END)"), "top": (N, "0", "greatest(s.top, s.lag)")}, {"lag_now": (N, "s.lag"), "peak": (N, "s.top")})


def timers(delay: int = 86400) -> Fold:
    """One deadline a key: each row first fires a due one, then sets it anew."""
    return Fold(
        {"due": (N, "NULL", f"x.t + {delay}"), "fired": (N, "0", "s.fired + CASE WHEN s.due <= x.t THEN 1 ELSE 0 END"), "moved": (N, "0", "s.moved + CASE WHEN s.due > x.t THEN 1 ELSE 0 END")},
        {"fired": (N, "s.fired"), "replaced": (N, "s.moved"), "next_deadline": (N, "s.due")},
    )


# ---- state, replication, coordination


def dedupe(horizon: int = 86400, ids: int = 10) -> Fold:
    """An identity ``v % ids`` seen within the horizon of its last admission is dropped; refusals do not extend it."""
    marks = ", ".join("-1" for _ in range(ids))
    return Fold(
        {"seen": ("ARRAY<BIGINT>", f"array({marks})", "CASE WHEN $dup THEN s.seen ELSE transform(sequence(1, " + str(ids) + "), e -> CASE WHEN e = $id THEN x.t ELSE element_at(s.seen, CAST(e AS INT)) END) END"), "yes": (N, "0", "s.yes + CASE WHEN $dup THEN 0 ELSE 1 END"), "no": (N, "0", "s.no + CASE WHEN $dup THEN 1 ELSE 0 END")},
        {"admitted": (N, "s.yes"), "dropped": (N, "s.no")},
        {"id": f"CAST(x.v % {ids} + 1 AS INT)", "dup": f"element_at(s.seen, $id) >= 0 AND x.t - element_at(s.seen, $id) <= {horizon}"},
        ARRAYS,
    )


def keyed_ttl(ttl: int = 86400) -> Fold:
    """A value idle for longer than ``ttl`` has expired by the next touch."""
    return Fold(
        {"last": (N, "NULL", "x.t"), "n": (N, "0", "CASE WHEN $gone THEN 1 ELSE s.n + 1 END"), "exp": (N, "0", "s.exp + CASE WHEN $gone THEN 1 ELSE 0 END")},
        {"count_now": (N, "s.n"), "expired": (N, "s.exp")},
        {"gone": f"s.last IS NOT NULL AND x.t - s.last > {ttl}"},
    )


def write_ttl(ttl: int = 86400) -> Fold:
    """Purchases write, other rows read; a value is gone once ``ttl`` ticks have passed since its write."""
    return Fold(
        {"at": (N, "NULL", "CASE WHEN x.kind = 'purchase' THEN x.t ELSE s.at END"), "hit": (N, "0", f"s.hit + CASE WHEN x.kind <> 'purchase' AND x.t - s.at < {ttl} THEN 1 ELSE 0 END"), "miss": (N, "0", f"s.miss + CASE WHEN x.kind <> 'purchase' AND (s.at IS NULL OR x.t - s.at >= {ttl}) THEN 1 ELSE 0 END")},
        {"hits": (N, "s.hit"), "misses": (N, "s.miss")},
    )


def producer_sequence(ids: int = 12) -> Fold:
    """Sequence numbers ``v % ids``: at most the last accepted is a duplicate, beyond the next a gap."""
    return Fold(
        {"last": (N, "-1", "CASE WHEN $n = s.last + 1 THEN $n ELSE s.last END"), "dup": (N, "0", "s.dup + CASE WHEN $n <= s.last THEN 1 ELSE 0 END"), "gap": (N, "0", "s.gap + CASE WHEN $n > s.last + 1 THEN 1 ELSE 0 END")},
        {"last_accepted": (N, "s.last"), "duplicates": (N, "s.dup"), "gaps": (N, "s.gap")},
        {"n": f"x.v % {ids}"},
    )


def ack_tree() -> Fold:
    """Pending work of a root: purchases acknowledge one, signups emit three, others one."""
    return Fold({"p": (N, "0", "CASE WHEN x.kind = 'purchase' THEN greatest(0, s.p - 1) WHEN x.kind = 'signup' THEN s.p + 3 ELSE s.p + 1 END"), "done": (N, "0", "s.done + CASE WHEN x.kind = 'purchase' AND s.p = 1 THEN 1 ELSE 0 END")}, {"pending": (N, "s.p"), "completed": (N, "s.done")})


def spill_store(hot: int = 3, ids: int = 8) -> Fold:
    """A hot tier of ``hot`` keys; an access of a cold key promotes it and demotes the least recent."""
    base = lru(hot, ids)
    return Fold(
        {**base.state, "cost": (N, "0", "s.cost + CASE WHEN $hit THEN 1 ELSE 20 END")},
        {"promotions": (N, "s.n - s.hits"), "ticks": (N, "s.cost"), "thrashing": ("BOOLEAN", "(s.n - s.hits) * 2 >= s.n")},
        base.let,
        ARRAYS,
    )


def lease_election(duration: int = 86400, nodes: int = 3) -> Fold:
    """Candidate ``v % nodes`` takes the lease if it is free, expired or its own; a change of holder raises the term."""
    return Fold(
        {"who": (N, "NULL", "CASE WHEN $win THEN $me ELSE s.who END"), "until": (N, "0", f"CASE WHEN $win THEN x.t + {duration} ELSE s.until END"), "term": (N, "0", "s.term + CASE WHEN $win AND (s.who IS NULL OR s.who <> $me OR x.t >= s.until) THEN 1 ELSE 0 END"), "no": (N, "0", "s.no + CASE WHEN $win THEN 0 ELSE 1 END")},
        {"holder": (N, "s.who"), "term": (N, "s.term"), "refused": (N, "s.no")},
        {"me": f"x.v % {nodes}", "win": "s.who IS NULL OR x.t >= s.until OR s.who = $me"},
    )


def fencing_token() -> Fold:
    """Writes with token ``v`` below the highest seen are stale."""
    return Fold({"top": (N, "-1", "greatest(s.top, x.v)"), "stale": (N, "0", "s.stale + CASE WHEN x.v < s.top THEN 1 ELSE 0 END")}, {"highest_token": (N, "s.top"), "stale_writes": (N, "s.stale")})


def version_checked(readers: int = 4) -> Fold:
    """A commit succeeds only if the version its reader saw (``v % readers`` commits ago) is the current one."""
    return Fold({"ver": (N, "0", f"s.ver + CASE WHEN x.v % {readers} = 0 THEN 1 ELSE 0 END"), "no": (N, "0", f"s.no + CASE WHEN x.v % {readers} = 0 THEN 0 ELSE 1 END")}, {"version": (N, "s.ver"), "conflicts": (N, "s.no")})


def reader_writer() -> Fold:
    """Views take and clicks give back a read lock; a purchase asks to write, which blocks new readers until readers are gone."""
    return Fold(
        {"r": (N, "0", "CASE WHEN x.kind = 'view' AND NOT s.w THEN s.r + 1 WHEN x.kind = 'click' THEN greatest(0, s.r - 1) ELSE s.r END"), "w": ("BOOLEAN", "FALSE", "CASE WHEN x.kind = 'purchase' THEN s.r > 0 WHEN x.kind = 'click' AND s.r <= 1 THEN FALSE ELSE s.w END"), "wrote": (N, "0", "s.wrote + CASE WHEN (x.kind = 'purchase' AND s.r = 0) OR (s.w AND x.kind = 'click' AND s.r <= 1) THEN 1 ELSE 0 END"), "held": (N, "0", "s.held + CASE WHEN x.kind = 'view' AND s.w THEN 1 ELSE 0 END")},
        {"readers": (N, "s.r"), "writes": (N, "s.wrote"), "blocked_reads": (N, "s.held")},
    )


def hinted_handoff(cap: int = 4) -> Fold:
    """While the replica is down (after an error, until a purchase) writes are kept as hints up to a cap."""
    return Fold(
        {"down": ("BOOLEAN", "FALSE", "CASE WHEN x.kind = 'error' THEN TRUE WHEN x.kind = 'purchase' THEN FALSE ELSE s.down END"), "h": (N, "0", f"CASE WHEN x.kind = 'purchase' THEN 0 WHEN s.down AND x.kind <> 'error' THEN least({cap}, s.h + 1) ELSE s.h END"), "lost": (N, "0", f"s.lost + CASE WHEN s.down AND x.kind NOT IN ('error', 'purchase') AND s.h >= {cap} THEN 1 ELSE 0 END"), "back": (N, "0", "s.back + CASE WHEN x.kind = 'purchase' THEN s.h ELSE 0 END")},
        {"pending_hints": (N, "s.h"), "dropped": (N, "s.lost"), "replayed": (N, "s.back"), "needs_repair": ("BOOLEAN", "s.lost > 0")},
    )


def min_stack() -> Fold:
    """Rows push ``v``, purchases pop; the least value on the stack is asked for after each row."""
    return Fold(
        {"st": ("ARRAY<BIGINT>", "array()", "CASE WHEN x.kind <> 'purchase' THEN array_append(s.st, x.v) WHEN size(s.st) > 1 THEN transform(sequence(1, size(s.st) - 1), e -> element_at(s.st, CAST(e AS INT))) ELSE array() END"), "sum": (N, "0", "s.sum + CASE WHEN size(s.st) = 0 THEN 0 ELSE array_min(s.st) END")},
        {"depth": (N, "size(s.st)"), "sum_of_minima": (N, "s.sum")},
        {},
        ARRAYS,
    )


# ---- greedy and dynamic programmes over ordered rows


def non_adjacent() -> Fold:
    """Largest sum of ``v`` over rows no two of which are neighbours."""
    return Fold({"take": (N, "0", "s.skip + x.v"), "skip": (N, "0", "greatest(s.skip, s.take)")}, {"best": (N, "greatest(s.take, s.skip)")})


def next_fit(capacity: int = 150) -> Fold:
    """Bins filled in order: a row that does not fit the open bin opens the next."""
    return Fold({"fill": (N, "0", f"CASE WHEN s.bins = 0 OR s.fill + x.v > {capacity} THEN x.v ELSE s.fill + x.v END"), "bins": (N, "0", f"s.bins + CASE WHEN s.bins = 0 OR s.fill + x.v > {capacity} THEN 1 ELSE 0 END")}, {"bins": (N, "s.bins"), "last_fill": (N, "s.fill")})


def first_fit(capacity: int = 150) -> Fold:
    """Bins kept as an array: a row goes into the first with room."""
    roomy = f"filter(sequence(1, size(s.bins)), e -> element_at(s.bins, CAST(e AS INT)) + x.v <= {capacity})"
    return Fold(
        {"bins": ("ARRAY<BIGINT>", "array()", f"CASE WHEN size(s.bins) = 0 OR size($roomy) = 0 THEN array_append(s.bins, x.v) ELSE transform(sequence(1, size(s.bins)), e -> element_at(s.bins, CAST(e AS INT)) + CASE WHEN e = element_at($roomy, 1) THEN x.v ELSE 0 END) END")},
        {"bins": (N, "size(s.bins)"), "emptiest": (N, "array_min(s.bins)")},
        {"roomy": roomy},
        ARRAYS,
    )


def earliest_finish() -> Fold:
    """Rows are intervals ``[a, b]`` sorted by end: the most that do not overlap."""
    return Fold({"end": (N, "NULL", "CASE WHEN $ok THEN x.b ELSE s.end END"), "n": (N, "0", "s.n + CASE WHEN $ok THEN 1 ELSE 0 END")}, {"chosen": (N, "s.n")}, {"ok": "s.end IS NULL OR x.a >= s.end"})


def stabbing() -> Fold:
    """Rows are closed intervals ``[a, b]`` sorted by end: the fewest points that meet all."""
    return Fold({"p": (N, "NULL", "CASE WHEN $ok THEN x.b ELSE s.p END"), "n": (N, "0", "s.n + CASE WHEN $ok THEN 1 ELSE 0 END")}, {"points": (N, "s.n")}, {"ok": "s.p IS NULL OR x.a > s.p"})


def longest_processing(machines: int = 3) -> Fold:
    """Jobs of length ``v`` in order go to the least loaded machine."""
    zeros = ", ".join("0" for _ in range(machines))
    return Fold(
        {"l": ("ARRAY<BIGINT>", f"array({zeros})", f"transform(sequence(1, {machines}), e -> element_at(s.l, CAST(e AS INT)) + CASE WHEN e = $at THEN x.v ELSE 0 END)")},
        {"makespan": (N, "array_max(s.l)"), "least_loaded": (N, "array_min(s.l)")},
        {"at": "CAST(array_min(filter(sequence(1, " + str(machines) + "), e -> element_at(s.l, CAST(e AS INT)) = array_min(s.l))) AS INT)"},
        ARRAYS,
    )


def two_choice(bins: int = 8) -> Fold:
    """Balls go to the less loaded of two bins derived from ``v`` and ``seq``."""
    zeros = ", ".join("0" for _ in range(bins))
    return Fold(
        {"l": ("ARRAY<BIGINT>", f"array({zeros})", f"transform(sequence(1, {bins}), e -> element_at(s.l, CAST(e AS INT)) + CASE WHEN e = $at THEN 1 ELSE 0 END)")},
        {"peak_load": (N, "array_max(s.l)"), "least_load": (N, "array_min(s.l)")},
        {"a": f"CAST(x.v % {bins} + 1 AS INT)", "b": f"CAST((x.seq * 31 + 7) % {bins} + 1 AS INT)", "at": "CASE WHEN element_at(s.l, $a) <= element_at(s.l, $b) THEN $a ELSE $b END"},
        ARRAYS,
    )


def bounded_line(capacity: int = 3) -> Fold:
    """Three stages joined by bounded channels; the sink takes only on ``ok`` rows, and a full channel stalls what is before it."""
    return Fold(
        {
            "a": (N, "0", "CASE WHEN $room_a THEN $left_a + 1 ELSE $left_a END"),
            "b": (N, "0", "$left_b + CASE WHEN $move THEN 1 ELSE 0 END"),
            "out": (N, "0", "s.out + s.b - $left_b"),
            "stall": (N, "0", "s.stall + CASE WHEN $room_a THEN 0 ELSE 1 END"),
        },
        {"delivered": (N, "s.out"), "stalled_ticks": (N, "s.stall"), "waiting": (N, "s.a + s.b")},
        {"left_b": "CASE WHEN x.ok AND s.b > 0 THEN s.b - 1 ELSE s.b END", "move": f"s.a > 0 AND $left_b < {capacity}", "left_a": "CASE WHEN $move THEN s.a - 1 ELSE s.a END", "room_a": f"$left_a < {capacity}"},
    )


def tiny_lfu(capacity: int = 3, ids: int = 7) -> Fold:
    """A cache whose newcomer must have been asked for more often than the least recent entry it would replace."""
    zeros = ", ".join("0" for _ in range(ids))
    return Fold(
        {
            "f": ("ARRAY<BIGINT>", f"array({zeros})", "$f"),
            "keys": ("ARRAY<BIGINT>", "array()", f"CASE WHEN $hit THEN array_append(filter(s.keys, e -> e <> $id), $id) WHEN size(s.keys) < {capacity} THEN array_append(s.keys, $id) WHEN element_at($f, CAST($id AS INT)) > element_at($f, CAST(element_at(s.keys, 1) AS INT)) THEN array_append(filter(s.keys, e -> e <> element_at(s.keys, 1)), $id) ELSE s.keys END"),
            "hits": (N, "0", "s.hits + CASE WHEN $hit THEN 1 ELSE 0 END"),
        },
        {"hits": (N, "s.hits"), "cached": (N, "size(s.keys)")},
        {"id": f"x.v % {ids} + 1", "hit": "array_contains(s.keys, $id)", "f": f"transform(sequence(1, {ids}), g -> element_at(s.f, CAST(g AS INT)) + CASE WHEN g = $id THEN 1 ELSE 0 END)"},
        {**ARRAYS, "g ->": "lambda g:"},
    )


def deficit_round(quantum: int = 60) -> Fold:
    """A flow's items of size ``v + 1`` in order: the rounds needed when each adds a quantum and unspent credit carries over."""
    _need(quantum > 0, "the quantum must be positive")
    return Fold(
        {"d": (N, "0", "s.d + $more * " + str(quantum) + " - (x.v + 1)"), "r": (N, "0", "s.r + $more"), "bytes": (N, "0", "s.bytes + x.v + 1")},
        {"rounds": (N, "s.r"), "bytes": (N, "s.bytes"), "credit_left": (N, "s.d")},
        {"more": f"CAST(ceil(greatest(0, x.v + 1 - s.d) / {quantum}e0) AS BIGINT)"},
    )


def job_slots(slots: int = 6) -> Fold:
    """Jobs by falling profit ``v``, deadline ``seq % slots + 1``: each takes the latest free slot before its deadline."""
    zeros = ", ".join("0" for _ in range(slots))
    return Fold(
        {"used": ("ARRAY<BIGINT>", f"array({zeros})", f"transform(sequence(1, {slots}), g -> CASE WHEN g = $slot THEN 1 ELSE element_at(s.used, CAST(g AS INT)) END)"), "p": (N, "0", "s.p + CASE WHEN $slot > 0 THEN x.v ELSE 0 END"), "n": (N, "0", "s.n + CASE WHEN $slot > 0 THEN 1 ELSE 0 END")},
        {"profit": (N, "s.p"), "jobs": (N, "s.n")},
        {"slot": f"coalesce(array_max(filter(sequence(1, {slots}), e -> e <= x.seq % {slots} + 1 AND element_at(s.used, CAST(e AS INT)) = 0)), 0)"},
        {**ARRAYS, "g ->": "lambda g:"},
    )


_PACK = 1 << 20  # values below this share a number with their position


def spans(following: bool = False) -> Fold:
    """Distance from each row to the nearest earlier row with a greater ``v`` (rows before the first count from there).

    A stack of falling values holds what may still be seen, so a key costs about its rows.
    With ``following`` rows come in reverse, and -1 says that none is greater.
    """
    none = "-1" if following else "s.i + 1"
    return Fold(
        {"i": (N, "0", "s.i + 1"), "st": ("ARRAY<BIGINT>", "array()", f"array_append($keep, (s.i + 1) * {_PACK} + x.v)"), "out": ("ARRAY<BIGINT>", "array()", f"array_append(s.out, CASE WHEN size($keep) = 0 THEN {none} ELSE s.i + 1 - CAST(floor(element_at($keep, -1) / {_PACK}) AS BIGINT) END)")},
        {"spans": ("ARRAY<BIGINT>", "s.out")},
        {"keep": f"filter(s.st, e -> e % {_PACK} > x.v)"},
        ARRAYS,
    )
