"""State machines folded over each user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomery.operators import machines as m

SPARK_EVENTS = """SELECT user_id AS k, event_id AS seq, unix_seconds(CAST(ts AS TIMESTAMP)) AS t, CAST(floor(value) AS BIGINT) AS v,
                  event_type AS kind, event_type <> 'error' AS ok FROM {events}"""
DUCK_EVENTS = """SELECT user_id AS k, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(value) AS BIGINT) AS v,
                 event_type AS kind, event_type <> 'error' AS ok FROM events"""
_INPUTS = ["t", "v", "kind", "ok"]


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, seq, t, v, kind, ok)``: events with whole values and epoch seconds."""
    return spark.sql(SPARK_EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


FOLDS = {
    "ratelimit": m.token_bucket(5, 1), "throttle": m.token_bucket(2, 1), "gcra": m.gcra(7200, 86400), "leakybucket": m.leaky_bucket(40, 120),
    "slidingwindowrate_log": m.sliding_log(2, 86400), "aimd": m.aimd(), "vegaslimit": m.vegas(), "slowstart": m.slow_start(), "bulkhead": m.bulkhead(),
    "creditflow": m.credits(), "circuitbreaker": m.circuit_breaker(), "hysteresis": m.hysteresis(), "metastable": m.metastable(), "deadline": m.deadline(),
    "priority": m.priority_lanes(), "singleflight": m.single_flight(), "visibilitytimeout": m.visibility(), "lru": m.lru(), "microbatch": m.micro_batch(),
    "groupcommit": m.group_commit(), "rollingsink": m.rolling_sink(), "lsmtree": m.size_tiered(), "poison": m.poison_budget(), "correlate": m.correlate(),
    "enrichcache": m.ttl_cache(), "patternmatch": m.sequence_pattern(), "commands": m.account(), "kahan": m.kahan(), "frugal": m.frugal_median(),
    "morris": m.morris(), "majority_candidate": m.boyer_moore(), "cusum": m.cusum(), "ewstd": m.ew_deviation(), "holtsmoothing": m.holt(),
    "maxproduct": m.max_product(), "sessioncap": m.capped_sessions(), "globalwindow": m.global_window(), "triggers": m.early_triggers(),
    "allowedlateness": m.lateness_pane(), "lag": m.clamped_lag(), "timerheap": m.timers(), "timers": m.timers(3600), "dedupe": m.dedupe(), "state": m.keyed_ttl(),
    "statettl": m.write_ttl(), "seqdedupe": m.producer_sequence(), "acktracking": m.ack_tree(), "spillover": m.spill_store(), "jobmanager": m.lease_election(),
    "lease": m.lease_election(43200, 2), "fencing": m.fencing_token(), "occ": m.version_checked(), "rwlock": m.reader_writer(), "hintedhandoff": m.hinted_handoff(),
    "minstack": m.min_stack(), "nonadjacent": m.non_adjacent(), "binpacking_next_fit": m.next_fit(), "binpacking": m.first_fit(), "lpt_in_order": m.longest_processing(),
    "powerof2": m.two_choice(), "backpressure": m.bounded_line(), "tinylfu": m.tiny_lfu(), "drr": m.deficit_round(),
}


def _query(fold):
    return lambda spark, sf_dir: fold.apply(user_events(spark, sf_dir), ["k"], ["seq"], _INPUTS)


QUERIES = {name: _query(fold) for name, fold in FOLDS.items()}
ORACLES = {name: fold.duck_sql(DUCK_EVENTS, ["k"], ["seq"], _INPUTS) for name, fold in FOLDS.items()}
