"""Registered queries of the engine for machine logs over the driver's tables, and their SQL.

Blocks are ``user x day`` over ``events``; log lines are made from its rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserlog.functions import catalog as cat
from tesserlog.functions import parse, scores
from tesserlog.operators import clusters, drain, features, iforest, metrics, patterns, quantiles, threshold, traces
from tesserlog.plans import batch, views
from tesserlog.sources import store
from tesserlog.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ALPHABET = ["click", "error", "purchase", "signup", "view"]
SUPPORT, CONFIDENCE = 0.005, 0.1
TEMPLATES = [
    ("T1", "Receiving block <*> src: <*>"),
    ("T2", "block <*>"),
    ("T3", "PacketResponder <*> for block <BLOCK> terminating"),
    ("T4", "Verification succeeded for <BLOCK>"),
    ("T5", "[*]exception[*]"),
]
RISKY = ("T5", "T3")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# inputs and their SQL


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit("_"), F.date_format(ts, "yyyyMMdd")).alias("block_id"), F.col("event_type").alias("event"),
        F.col("event_id").alias("n"), ts.alias("ts"), "user_id", "value",
    )


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return traces.traces_from_events(_events(spark, d), event="event", order=("ts", "n"))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return traces.event_sets(_traces(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """line_no and raw text; every 17th line is malformed, every 13th names no block, every 19th two."""
    blk = F.concat(F.lit("blk_"), F.when(F.col("n") % 3 == 0, "-").otherwise(""), F.col("user_id"))
    message = (
        F.when(F.col("n") % 13 == 0, "Starting thread")
        .when(F.col("event") == "click", F.concat(F.lit("Receiving  block "), blk, F.lit(" src: /10.0.0.7:50010")))
        .when(F.col("event") == "view", F.concat(F.lit("Served block "), blk, F.lit(" to /10.0.0.9")))
        .when(F.col("event") == "purchase", F.concat(F.lit("packetresponder 1 for block "), blk, F.lit(" terminating")))
        .when(F.col("event") == "signup", F.concat(F.lit("Verification succeeded for "), blk))
        .otherwise(F.concat(F.lit("writeBlock "), blk, F.lit(" received exception java.io.IOException")))
    )
    message = F.when(F.col("n") % 19 == 0, F.concat(message, F.lit(" blk_5"))).otherwise(message)
    line = F.concat(F.date_format("ts", "yyMMdd HHmmss"), F.lit(" "), F.col("user_id"), F.when(F.col("event") == "error", " WARN dfs.").otherwise(" INFO dfs."), F.col("event"), F.lit(": "), message)
    return _events(spark, d).select(F.col("n").alias("line_no"), F.when(F.col("n") % 17 == 0, "garbage line").otherwise(line).alias("raw"), F.col("n").cast("string").alias("ingested_at"))


def _logs(spark: SparkSession, d: str, order: str = "length") -> DataFrame:
    return parse.parse_logs(_lines(spark, d), cat.match_event(F.col("content"), cat.compile_catalog(TEMPLATES, order)), RISKY)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy("block_id").agg(F.max(F.when((F.col("event") == "error") & (F.col("user_id") % 3 == 0), 1).otherwise(0)).alias("a"))
    return e.select("block_id", F.when(F.col("a") == 1, " anomaly").otherwise("Normal ").alias("label"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """One score per block: a fixed function of its events."""
    e = _events(spark, d).groupBy("block_id").agg(F.sum("n").alias("x"), F.count("*").alias("c"), F.max((F.col("event") == "error").cast("int")).alias("err"))
    s = ((F.col("x") % 97) / 97.0 + F.col("err")) / 2
    return threshold.label_anomalies(e.select("block_id", s.alias("if_score")), 0.6, "fixed")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return metrics.align(metrics.clean_labels(_labels(spark, d)), _scored(spark, d))


EV = "ev as (select 'u' || user_id || '_' || strftime(ts, '%Y%m%d') as block_id, event_type as event, event_id as n, ts, user_id, value from events)"
SETS = f"{EV}, sets as (select distinct block_id, event from ev), tot as (select count(distinct block_id) as total from ev)"
TR = f"{EV}, tr as (select block_id, list(event order by ts, n) as events from ev group by 1)"
LINES = f"""{EV}, msg as (select *, 'blk_' || case when n % 3 = 0 then '-' else '' end || user_id as blk from ev),
m2 as (select *, case when n % 13 = 0 then 'Starting thread' when event = 'click' then 'Receiving  block ' || blk || ' src: /10.0.0.7:50010'
  when event = 'view' then 'Served block ' || blk || ' to /10.0.0.9' when event = 'purchase' then 'packetresponder 1 for block ' || blk || ' terminating'
  when event = 'signup' then 'Verification succeeded for ' || blk else 'writeBlock ' || blk || ' received exception java.io.IOException' end as m from msg),
lines as (select n as line_no, case when n % 17 = 0 then 'garbage line' else strftime(ts, '%y%m%d %H%M%S') || ' ' || user_id
  || case when event = 'error' then ' WARN dfs.' else ' INFO dfs.' end || event || ': ' || m || case when n % 19 = 0 then ' blk_5' else '' end end as raw from m2)"""
RX = "^\\s*(\\d{6})\\s+(\\d{6})\\s+(\\d+)\\s+(\\w+)\\s+(\\S+):\\s+(.+?)\\s*$"
PARSED = f"""{LINES}, parsed as (select line_no, regexp_extract(raw, '{RX}', 1) as log_date, regexp_extract(raw, '{RX}', 2) as log_time, regexp_extract(raw, '{RX}', 3) as pid,
  regexp_extract(raw, '{RX}', 4) as level, regexp_extract(raw, '{RX}', 5) as component, regexp_extract(raw, '{RX}', 6) as content from lines where regexp_matches(raw, '{RX}')),
blocked as (select *, nullif(regexp_extract(content, '(blk_-?\\d+)', 1), '') as block_id from parsed)"""


#: The templates' expressions, written by hand for the SQL; fixed values.
EXPRESSIONS = {
    "T1": r"Receiving\s+block\s+.*?\s+src\:\s+.*?",
    "T2": r"block\s+.*?",
    "T3": r"PacketResponder\s+.*?\s+for\s+block\s+blk_-?\d+\s+terminating",
    "T4": r"Verification\s+succeeded\s+for\s+blk_-?\d+",
    "T5": r".*?exception.*?",
}
#: Longest template first, and as in the catalogue.
ORDERS = {"length": ("T3", "T4", "T1", "T5", "T2"), "catalog": ("T1", "T2", "T3", "T4", "T5")}


def _case(order: str) -> str:
    return "case " + " ".join(f"when regexp_matches(content, '(?i){EXPRESSIONS[i]}') then '{i}'" for i in ORDERS[order]) + " else 'E_UNKNOWN' end"


LOGS = f"{PARSED}, logs as (select *, {_case('length')} as event_id from blocked where block_id is not null)"
LABELS = f"{EV}, labs as (select block_id, case when max(case when event = 'error' and user_id % 3 = 0 then 1 else 0 end) = 1 then 'ANOMALY' else 'NORMAL' end as label from ev group by 1)"
SCORED = f"{LABELS}, scored as (select block_id, ((sum(n) % 97) / 97.0 + max(case when event = 'error' then 1 else 0 end)) / 2 as if_score from ev group by 1), al as (select block_id, case when label = 'ANOMALY' then 1 else 0 end as y, case when if_score >= 0.6 then 1 else 0 end as p, if_score as s from labs join scored using (block_id))"
SUBSETS = f"""{SETS}, masks as (select unnest(range(1, 32)) as mask), sym(e, bit) as (values {', '.join(f"('{a}', {1 << i})" for i, a in enumerate(ALPHABET))}),
bm as (select block_id, sum(bit)::int as m from sets join sym on event = e group by 1), grouped as (select m, count(*) as c from bm group by 1),
freq as (select mask, sum(c)::bigint as freq, bit_count(mask) as k from masks join grouped on (m & mask) = mask group by 1),
named as (select mask, k, freq, (select string_agg(e, ',' order by e) from sym where (mask & bit) <> 0) as items from freq, tot where freq >= ceil({SUPPORT} * total))"""
SINGLE = f"{SETS}, single as (select event, count(*) / any_value(total) as support from sets, tot group by 1 having count(*) >= ceil({SUPPORT} * any_value(total)))"
RAR = f"{SINGLE}, rar as (select block_id, coalesce(max(support), 0) as max_single_support, avg(support) as avg_single_support, least(1, greatest(0, coalesce(1 - avg(support), 1))) as fp_rarity_score from sets left join single using (event) group by 1)"


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# parsing


@query(f"with {LINES} select line_no, raw, cast(line_no as varchar) as ingested_at from lines")
def envelope_parse(spark, d):
    rows = _lines(spark, d)
    return parse.open_envelopes(rows.select(F.to_json(F.struct("line_no", "ingested_at", "raw")).cast("binary").alias("value"))).select("line_no", "raw", "ingested_at")


@query(f"with {PARSED} select * from parsed")
def parse_log_line(spark, d):
    return parse.parsed_lines(_lines(spark, d)).select("line_no", *parse.FIELDS)


@query(f"with {PARSED} select line_no, block_id from blocked")
def extract_block_id(spark, d):
    return parse_log_line(spark, d).select("line_no", parse.block_id(F.col("content")).alias("block_id"))


@query(f"with {PARSED} select line_no, cast(substr(log_time, 1, 2) as int) * 3600 + cast(substr(log_time, 3, 2) as int) * 60 + cast(substr(log_time, 5, 2) as int) as secs from parsed")
def time_to_secs(spark, d):
    return parse_log_line(spark, d).select("line_no", parse.seconds_of_day(F.col("log_time")).alias("secs"))


@query(f"with {LOGS} select line_no, event_id from logs")
def match_event(spark, d):
    return _logs(spark, d).select("line_no", "event_id")


@query(f"with {PARSED} select line_no, {_case('catalog')} as event_id from blocked where block_id is not null")
def match_event_catalog_order(spark, d):
    return _logs(spark, d, "catalog").select("line_no", "event_id")


@query(f"with {LOGS} select line_no, event_id in ('T5', 'T3') as is_high_risk from logs")
def high_risk_flag(spark, d):
    return _logs(spark, d).select("line_no", "is_high_risk")


@query("select * from (values " + ", ".join(f"('{i}', '{t}', '{p}')" for i, t, p in ((i, t, EXPRESSIONS[i]) for i, t in TEMPLATES)) + ") v(event_id, template, pattern)")
def catalog_regex(spark, d):
    return spark.createDataFrame(cat.compile_catalog(TEMPLATES), "event_id string, template string, pattern string")


@query("select * from (values " + ", ".join(f"('{i}', '{t}')" for i, t in TEMPLATES) + ") v(event_id, template)")
def catalog_load(spark, d):
    table = spark.createDataFrame([(f" {i} ", f"{t} ") for i, t in TEMPLATES] + [("", "x"), ("T9", "")], "EventId string, EventTemplate string")
    return spark.createDataFrame(cat.load_catalog(table), "event_id string, template string")


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'blk_-?\\d+', '<BLOCK>', 'g'), '/?\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}(:\\d+)?', '<IP>', 'g'), '\\b\\d+\\b', '<NUM>', 'g') as masked from documents")
def mask_message(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", parse.mask_message(F.col("text")).alias("masked"))


@query(f"with {LOGS} select line_no, log_date, level, component, block_id, event_id from logs")
def stream_parse(spark, d):
    """The transformation that streams and batches share."""
    return _logs(spark, d).select("line_no", "log_date", "level", "component", "block_id", "event_id")


# traces


@query(f"with {TR} select block_id, array_to_string(events, ',') as trace, len(events) as n from tr")
def parse_trace(spark, d):
    text = _traces(spark, d).select("block_id", F.concat(F.lit("[ "), F.array_join("events", ", "), F.lit("]")).alias("f"))
    out = traces.parse_trace(F.col("f"))
    return text.select("block_id", F.array_join(out, ",").alias("trace"), F.size(out).cast("long").alias("n"))


@query(f"with {SETS} select block_id, string_agg(event, ',' order by event) as items from sets group by 1")
def event_sets(spark, d):
    return _sets(spark, d).select("block_id", scores.items_key(F.col("events")).alias("items"))


@query(f"with {TR} select block_id, array_to_string(events[1:20], '→') as rendered from tr")
def sequences_truncated(spark, d):
    return traces.sequences(_traces(spark, d)).select("block_id", scores.render_sequence(F.col("sequence")).alias("rendered"))

_COUNTS = ", ".join(f"count(*) filter (where event = '{a}')::int as {a}" for a in ALPHABET)


@query(f"with {EV} select block_id, {_COUNTS} from ev group by 1")
def occurrence_matrix(spark, d):
    return traces.occurrence_matrix(_traces(spark, d), ALPHABET)


@query(f"with {SETS} select block_id, string_agg(event, ',' order by event) as items from sets group by 1")
def matrix_to_sets(spark, d):
    return traces.matrix_to_sets(occurrence_matrix(spark, d), ALPHABET).select("block_id", scores.items_key(F.col("events")).alias("items"))


@query(f"with {EV} select block_id, " + ", ".join(f"round(ln(1 + count(*) filter (where event = '{a}')), 6) as {a}_norm" for a in ALPHABET) + " from ev group by 1")
def log1p_features(spark, d):
    return _rounded(traces.log1p_features(occurrence_matrix(spark, d), ALPHABET), *[f"{a}_norm" for a in ALPHABET])


def _stats(spark, d):
    e = _events(spark, d).withColumn("event_id", F.col("event"))
    return traces.block_stats(e, parse.seconds_of_day(F.date_format("ts", "HHmmss")))


STATS = "stats as (select block_id, count(*) as log_count, count(distinct event) as unique_events, max(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::int - min(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::int as time_span from ev group by 1)"


@query(f"with {EV}, {STATS} select * from stats")
def block_stats(spark, d):
    return _stats(spark, d)


@query(f"with {LOGS} select block_id, count(*) as risk_event_count, arg_min(event_id, line_no) as trigger_event, arg_min(component, line_no) as component from logs where event_id in ('T5', 'T3') group by 1 having count(*) >= 2")
def prescreen_alerts(spark, d):
    return traces.prescreen_alerts(_logs(spark, d))


# patterns


@query(f"with {SUBSETS} select items, freq from named")
def fp_itemsets(spark, d):
    items, _ = patterns.frequent_itemsets(_sets(spark, d), SUPPORT, CONFIDENCE)
    return items.select(scores.items_key(F.col("items")).alias("items"), "freq")


@query(f"""with {SUBSETS} select a.items as antecedent, c.items as consequent, round(u.freq / a.freq, 6) as confidence, round((u.freq / a.freq) / (c.freq / total), 6) as lift, round(u.freq / total, 6) as support
from named u join named a on (u.mask & a.mask) = a.mask and a.k = u.k - 1 join named c on c.mask = u.mask - a.mask, tot where u.k > 1 and u.freq / a.freq >= {CONFIDENCE}""")
def fp_rules(spark, d):
    _, rules = patterns.frequent_itemsets(_sets(spark, d), SUPPORT, CONFIDENCE)
    return rules.select(scores.items_key(F.col("antecedent")).alias("antecedent"), scores.items_key(F.col("consequent")).alias("consequent"), *[F.round(c, 6).alias(c) for c in ("confidence", "lift", "support")])


@query(f"with {SUBSETS} select items as itemset, k::int as n_items, freq, round(freq / total, 6) as support from named, tot")
def itemset_support(spark, d):
    sets = _sets(spark, d)
    items, _ = patterns.frequent_itemsets(sets, SUPPORT, CONFIDENCE)
    return _rounded(patterns.itemset_support(items, sets.count()), "support")


@query(f"with {RAR} select block_id, round(max_single_support, 6) as max_single_support, round(avg_single_support, 6) as avg_single_support from rar")
def fp_block_support(spark, d):
    return _rounded(_rarity(spark, d).drop("fp_rarity_score"), "max_single_support", "avg_single_support")


def _rarity(spark, d):
    sets = _sets(spark, d)
    return patterns.rarity(sets, patterns.single_support(sets, SUPPORT))


@query(f"with {RAR} select block_id, round(max_single_support, 6) as max_single_support, round(avg_single_support, 6) as avg_single_support, round(fp_rarity_score, 6) as fp_rarity_score from rar")
def fp_rarity(spark, d):
    return _rounded(_rarity(spark, d), "max_single_support", "avg_single_support", "fp_rarity_score")


@query(f"with {SUBSETS} select items as pair, freq, round(freq / total, 6) as support from named, tot where k = 2")
def pair_support(spark, d):
    return _rounded(patterns.pair_support(_sets(spark, d), SUPPORT), "support")


def _normal(spark, d, longest=20):
    normal = metrics.clean_labels(_labels(spark, d))
    t = _traces(spark, d).join(normal, "block_id", "left").where("label is null or label = 'NORMAL'")
    return patterns.sequential_patterns(traces.sequences(t, 20), SUPPORT, longest)


POS = f"""{LABELS}, pos as (select block_id, event as e, row_number() over (partition by block_id order by ts, n) as i from ev join labs using (block_id) where label = 'NORMAL' qualify i <= 20),
least as (select ceil({SUPPORT} * count(distinct block_id)) as m from pos),
grown(k, t, es, block_id, i) as (
  select 1, e, [e], block_id, min(i) from pos group by e, block_id
  union all
  select k, t, es, block_id, i from (select g.k + 1 as k, g.t || '>' || p.e as t, list_append(g.es, p.e) as es, g.block_id, min(p.i) as i, count(*) over (partition by g.t || '>' || p.e) as freq
    from grown g join pos p on p.block_id = g.block_id and p.i > g.i where g.k < 20 group by g.k, g.t, g.es, p.e, g.block_id) where freq >= (select m from least)),
pats as (select k, t, array_to_string(list_sort(any_value(es)), '|') as s, count(*) as freq from grown group by k, t),
often as (select * from pats where freq >= (select m from least))"""
BASE = f"{POS}, base as (select s, max(freq) as freq from (select * from often order by freq desc, s, t limit 50) group by 1)"
DEV = f"""base as (select s, max(freq) as freq from (select * from often order by freq desc, s, t limit 50) group by 1), tr as (select block_id, list(event order by ts, n) as es from ev group by 1),
win as (select block_id, unnest(case when len(es) = 1 then es else flatten([case when len(es) >= k then list_transform(range(1, len(es) - k + 2), lambda i: array_to_string(list_sort(es[i:i + k - 1]), '|')) else [] end for k in [2, 3, 4]]) end) as s from tr),
dev as (select block_id, 1 - count(base.s) / count(*) as seq_deviation_score, count(base.s)::int as matched_subseq_count, count(*)::int as total_subseq_count from win left join base using (s) group by 1)"""


@query(f"with recursive {POS} select t as pattern, freq from often")
def prefixspan_patterns(spark, d):
    return _pattern_text(_normal(spark, d))


def _pattern_text(found):
    return found.select(F.array_join(F.flatten("sequence"), ">").alias("pattern"), "freq")


@query(f"with recursive {BASE} select s as signature, freq from base")
def normal_baseline(spark, d):
    return patterns.normal_baseline(_normal(spark, d), 50)


def _deviation(spark, d):
    known = [r["signature"] for r in patterns.normal_baseline(_normal(spark, d), 50).collect()]
    return patterns.sequence_deviation(_traces(spark, d), known)


@query(f"with recursive {POS}, {DEV} select block_id, round(seq_deviation_score, 6) as seq_deviation_score, matched_subseq_count, total_subseq_count from dev")
def seq_deviation(spark, d):
    return _rounded(_deviation(spark, d), "seq_deviation_score")


@query(f"with {SUBSETS} select items, freq from named order by freq desc, items limit 10")
def top_itemsets(spark, d):
    return views.top_patterns(fp_itemsets(spark, d), "items", 10)


@query(f"with recursive {POS} select t as pattern, freq from often order by freq desc, t limit 10")
def top_sequences(spark, d):
    return views.top_patterns(prefixspan_patterns(spark, d), "pattern", 10)


@query(f"with {SUBSETS} select 'fp_' || replace(items, ',', '|') as pattern_id, 'itemset' as pattern_type, replace(items, ',', '|') as pattern, freq, round(freq / total, 6) as support from named, tot")
def pattern_documents(spark, d):
    sets = _sets(spark, d)
    items, _ = patterns.frequent_itemsets(sets, SUPPORT, CONFIDENCE)
    return store.pattern_documents(items, "itemset", sets.count())


# labels and metrics


@query("select cast(doc_id as varchar) as block_id, case when toxic = 1 then 'ANOMALY' else 'NORMAL' end as label from labels")
def labels_clean(spark, d):
    raw = spark.read.parquet(f"{d}/labels.parquet").select(F.concat(F.lit(" "), "doc_id").alias("BlockId"), F.when(F.col("toxic") == 1, "Anomaly ").otherwise(" normal").alias("Label"))
    return metrics.clean_labels(raw)


_CONF = "conf as (select count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp, count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 0 and p = 0) as tn from al)"


@query(f"with {SCORED}, {_CONF} select * from conf")
def confusion_matrix(spark, d):
    return metrics.confusion(_aligned(spark, d))


def _div(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(({b})::double, 0), 0)"


_P, _R = _div("tp", "tp + fp"), _div("tp", "tp + fn")
_RATES = {
    "accuracy": _div("tp + tn", "tp + fp + fn + tn"), "precision": _P, "recall": _R, "f1": _div(f"2 * {_P} * {_R}", f"{_P} + {_R}"),
    "f05": _div(f"1.25 * {_P} * {_R}", f"0.25 * {_P} + {_R}"), "f2": _div(f"5 * {_P} * {_R}", f"4 * {_P} + {_R}"),
    "mcc": _div("tp::double * tn - fp::double * fn", "sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn))"), "fpr": _div("fp", "fp + tn"), "fnr": _div("fn", "fn + tp"),
    "true_rate": _div("tp + fn", "tp + fp + fn + tn"), "predicted_rate": _div("tp + fp", "tp + fp + fn + tn"),
}


@query(f"with {SCORED}, {_CONF} select tp, fp, fn, tn, " + ", ".join(f"round({v}, 6) as {k}" for k, v in _RATES.items()) + " from conf")
def core_metrics(spark, d):
    return _rounded(metrics.rates(metrics.confusion(_aligned(spark, d))), *_RATES)


@query(f"with {SCORED}, sc as (select s, sum(y) as pos, sum(1 - y) as neg from al group by 1) select round((select sum(a.pos * b.neg * case when a.s > b.s then 1 when a.s = b.s then 0.5 else 0 end) from sc a, sc b) / ((select sum(pos) from sc) * (select sum(neg) from sc)), 6) as auc_roc")
def auc_roc(spark, d):
    return _rounded(metrics.auc_roc(_aligned(spark, d)), "auc_roc")


@query(f"with {SCORED}, sc as (select s, sum(y) as pos, count(*) as c from al group by 1), cu as (select pos, sum(pos) over (order by s desc) / sum(c) over (order by s desc) as prec from sc) select round(sum(pos * prec) / sum(pos), 6) as auc_pr from cu")
def auc_pr(spark, d):
    return _rounded(metrics.auc_pr(_aligned(spark, d)), "auc_pr")


_SWEEP = f"""{SCORED}, ends as (select min(s)::double as lo, max(s)::double as hi from al), grid as (select i::int as point, lo + (hi - lo) * i::double / 99 as threshold from ends, range(100) r(i)),
conf as (select point, threshold, count(*) filter (where y = 1 and s::double >= threshold) as tp, count(*) filter (where y = 0 and s::double >= threshold) as fp, count(*) filter (where y = 1 and s::double < threshold) as fn, count(*) filter (where y = 0 and s::double < threshold) as tn from grid, al group by all),
sw as (select point, round(threshold, 6) as threshold, tp, fp, fn, tn, round({_P}, 6) as precision, round({_R}, 6) as recall, round({_RATES['f1']}, 6) as f1, round({_RATES['fpr']}, 6) as fpr, round({_R}, 6) as tpr from conf)"""
_SWEPT = ("threshold", "precision", "recall", "f1", "fpr", "tpr")


@query(f"with {_SWEEP} select * from sw")
def threshold_sweep(spark, d):
    return _rounded(metrics.threshold_sweep(_aligned(spark, d)), *_SWEPT)


@query(f"with {_SWEEP} select * from sw order by f1 desc, threshold limit 1")
def best_f1(spark, d):
    return metrics.best_f1(_rounded(metrics.threshold_sweep(_aligned(spark, d)), *_SWEPT))


@query(f"with {LABELS}, al as (select case when label = 'ANOMALY' then 1 else 0 end as y, case when count(*) filter (where event in ('error', 'signup')) > 0 then 1 else 0 end as p from labs join ev using (block_id) group by block_id, label), {_CONF} select tp, fp, fn, tn, round({_P}, 6) as precision, round({_R}, 6) as recall, round({_RATES['f1']}, 6) as f1 from conf")
def ablation_rule(spark, d):
    rows = metrics.clean_labels(_labels(spark, d)).join(metrics.rule_baseline(occurrence_matrix(spark, d), ["error", "signup"]), "block_id")
    counts = metrics.rates(metrics.confusion(rows.select((F.col("label") == "ANOMALY").cast("int").alias("y"), "p")))
    return _rounded(counts.select("tp", "fp", "fn", "tn", "precision", "recall", "f1"), "precision", "recall", "f1")


_UNSCORED = "user_id % 7 = 3 and event = 'error'"


@query(f"""with {SCORED}, kept as (select block_id from scored where block_id not in (select block_id from ev where {_UNSCORED})),
known as (select block_id from labs where label = 'NORMAL')
select 'truth' as side, count(*) as n from known where block_id not in (select block_id from kept)
union all select 'predictions', count(*) from kept where block_id not in (select block_id from known)""")
def unmatched_rows(spark, d):
    """Normal blocks as truth; blocks with an error of some users have no prediction."""
    unscored = _events(spark, d).where(_UNSCORED).select("block_id").distinct()
    truth = metrics.clean_labels(_labels(spark, d)).where("label = 'NORMAL'")
    return metrics.unmatched(truth, _scored(spark, d).join(unscored, "block_id", "left_anti"))


@query(f"with {SCORED} select 'truth' as side, count(*) as n from labs where block_id not in (select block_id from scored) union all select 'predictions', count(*) from scored where block_id not in (select block_id from labs)")
def unmatched_rows_full(spark, d):
    return metrics.unmatched(metrics.clean_labels(_labels(spark, d)), _scored(spark, d))


# clusters and features


def _vectors(spark, d):
    return clusters.feature_vectors(written(occurrence_matrix(spark, d), "matrix"), ALPHABET)


@query()
def cluster_assign(spark, d):
    return clusters.assign_clusters(_vectors(spark, d))[0].select("block_id", "cluster_id")


def _outliers(spark, d):
    assigned, centres, _ = clusters.assign_clusters(_vectors(spark, d))
    return clusters.outlier_scores(clusters.own_distance(assigned, centres))


@query()
def cluster_outlier(spark, d):
    return _outliers(spark, d)


#: Centres of two clusters in counts, for a distance that SQL can follow.
CENTRES = [[0.5, 0.25, 1.0, 0.0, 2.0], [1.5, 0.0, 0.0, 1.0, 0.5]]


def _apart(centre: list[float]) -> str:
    return "sqrt(" + " + ".join(f"pow({a} - {x}, 2)" for a, x in zip(ALPHABET, centre)) + ")"


@query(f"with {EV}, m as (select block_id, {_COUNTS} from ev group by 1) select block_id, (click > 0)::int as cluster_id, round(case when click > 0 then {_apart(CENTRES[1])} else {_apart(CENTRES[0])} end, 6) as centroid_distance from m")
def own_distance_given(spark, d):
    """Distance to the own centre, with given centres: blocks with a click belong to the second."""
    m = occurrence_matrix(spark, d)
    rows = m.select("block_id", (F.col("click") > 0).cast("int").alias("cluster_id"), array_to_vector(F.array(*[F.col(a).cast("double") for a in ALPHABET])).alias("features"))
    return _rounded(clusters.own_distance(rows, CENTRES), "centroid_distance")


def _given(spark, d):
    """Embeddings with their label as cluster, and the distance of the first component to 0."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return clusters.outlier_scores(e.select(F.col("vec_id").cast("string").alias("block_id"), F.col("label").alias("cluster_id"), F.abs(F.col("embedding")[0].cast("double")).alias("centroid_distance")))


GIVEN = """g as (select cast(vec_id as varchar) as block_id, label as cluster_id, abs(embedding[1]::double) as dist from embeddings),
q as (select min(dist) as lo, quantile_cont(dist, 0.95) as hi from g), o as (select block_id, cluster_id, dist, least(1, greatest(0, (dist - lo) / (hi - lo))) as score from g, q)"""


@query(f"with {GIVEN} select cluster_id, count(*) as total_blocks, count(*) filter (where toxic = 1) as anomaly_blocks, round(avg(dist), 6) as mean_centroid_dist, round(avg(score), 6) as mean_outlier_score, round(max(score), 6) as max_outlier_score, round(count(*) filter (where toxic = 1) / count(*), 6) as anomaly_ratio from o left join labels on block_id = cast(doc_id as varchar) group by 1")
def cluster_summary(spark, d):
    return _rounded(clusters.cluster_summary(_given(spark, d), labels_clean(spark, d)), "mean_centroid_dist", "mean_outlier_score", "max_outlier_score", "anomaly_ratio")


@query(f"with {GIVEN} select cluster_id, count(*) as blocks, round(count(*) / sum(count(*)) over (), 6) as share from o group by 1")
def cluster_distribution(spark, d):
    return _rounded(clusters.cluster_distribution(_given(spark, d)), "share")


@query(f"with {GIVEN} select round(lo, 6) as lo, round(hi, 6) as p95 from q")
def p95_distance(spark, d):
    lo, p95 = quantiles.quantiles(_given(spark, d), "centroid_distance", [0.0, 0.95])
    return spark.createDataFrame([(round(lo, 6), round(p95, 6))], "lo double, p95 double")


@query(f"with {GIVEN} select round(avg(score), 6) as mean, round(stddev_samp(score), 6) as deviation, round(min(score), 6) as low, round(max(score), 6) as high from o")
def score_stats(spark, d):
    s = F.col("cluster_outlier_score")
    return _given(spark, d).agg(F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_samp(s), 6).alias("deviation"), F.round(F.min(s), 6).alias("low"), F.round(F.max(s), 6).alias("high"))


def _occurrence(spark, d):
    return traces.log1p_features(occurrence_matrix(spark, d), ALPHABET).withColumn("never", F.lit(0.0))


def _features(spark, d):
    """Without clusters, which SQL cannot express."""
    return features.assemble(_occurrence(spark, d), fp=_rarity(spark, d), seq=_deviation(spark, d), stats=_stats(spark, d))


def _all_features(spark, d):
    return features.assemble(_occurrence(spark, d), fp=_rarity(spark, d), seq=_deviation(spark, d), cluster=_outliers(spark, d), stats=_stats(spark, d))


_NORM = [f"{a}_norm" for a in ALPHABET]
POS_OF = POS.removeprefix(f"{EV}, ")
FEAT = f"{RAR}, {POS_OF}, {DEV}, {STATS}, feat as (select s.block_id, coalesce(r.fp_rarity_score, 0.5) as fp_rarity_score, coalesce(v.seq_deviation_score, 0.5) as seq_deviation_score, s.log_count::double as log_count, s.unique_events::double as unique_events, s.time_span::double as time_span, {', '.join(f'm.{c}' for c in _NORM)} from stats s join (select block_id, {', '.join(chr(108) + f'n(1 + count(*) filter (where event = {chr(39)}{a}{chr(39)})) as {a}_norm' for a in ALPHABET)} from ev group by 1) m using (block_id) left join rar r using (block_id) left join dev v using (block_id))"


@query(f"with recursive {FEAT} select block_id, round(fp_rarity_score, 6) as fp_rarity_score, round(seq_deviation_score, 6) as seq_deviation_score, log_count, unique_events, time_span, {', '.join(f'round({c}, 6) as {c}' for c in _NORM)} from feat")
def feature_matrix(spark, d):
    return _rounded(features.drop_constant(written(_features(spark, d), "features")), "fp_rarity_score", "seq_deviation_score", *_NORM)


@query(f"with recursive {FEAT} " + " union all ".join(f"select '{c}' as feature, round(coalesce(stddev_samp({c}), 0), 6) as deviation from feat" for c in ["fp_rarity_score", "seq_deviation_score", "log_count", "unique_events", "time_span", *_NORM]) + " union all select 'never', 0.0")
def constant_columns(spark, d):
    return _rounded(features.deviations(_features(spark, d)), "deviation")


@query()
def feature_matrix_full(spark, d):
    return features.drop_constant(_all_features(spark, d))


@query()
def constant_columns_full(spark, d):
    return features.deviations(_all_features(spark, d))


def _forest(spark, d):
    f = features.drop_constant(written(_all_features(spark, d), "features"))
    columns = [c for c in f.columns if c != "block_id"]
    return f, iforest.fit_forest(f, columns, 100, 256)


@query()
def iforest_scores(spark, d):
    f, forest = _forest(spark, d)
    s = written(iforest.score_forest(f, forest), "scores")
    t = threshold.fit_threshold(s)
    return threshold.label_anomalies(s, t.threshold, t.method)


@query()
def score_new(spark, d):
    f, forest = _forest(spark, d)
    new = _events(spark, d).where(F.col("ts") >= "2024-01-02").select("block_id").distinct()
    return batch.score_new(f, new, iforest.Forest.from_json(forest.to_json()), threshold.Threshold(0.5, "fixed"))


#: Two small trees over (log_count, time_span): (feature, cut, left, right, depth at a leaf).
TREES = [
    [(0, 2.5, 1, 2, 0.0), (-1, 0.0, 0, 0, 3.25), (1, 3600.0, 3, 4, 0.0), (-1, 0.0, 0, 0, 2.0), (-1, 0.0, 0, 0, 2.5)],
    [(1, 40000.5, 1, 2, 0.0), (-1, 0.0, 0, 0, 4.0), (-1, 0.0, 0, 0, 1.0)],
]


def _depth(nodes: list[tuple], at: int = 0) -> str:
    f, cut, left, right, leaf = nodes[at]
    return f"{leaf}::double" if f < 0 else f"case when {('log_count', 'time_span')[f]} < {cut} then {_depth(nodes, left)} else {_depth(nodes, right)} end"


@query(f"with {EV}, {STATS} select block_id, round(least(1, greatest(0, (pow(2, -({_depth(TREES[0])} + {_depth(TREES[1])}) / 2 / {float(iforest.mean_path(16))!r}) - 0.25) / 0.5)), 6) as if_score from stats")
def forest_scores_given(spark, d):
    """Path lengths, score and scaling of a forest that is written down here."""
    forest = iforest.Forest(["log_count", "time_span"], TREES, 16, 0.25, 0.75)
    return _rounded(iforest.score_forest(_stats(spark, d), iforest.Forest.from_json(forest.to_json())), "if_score")


@query("""with q as (select quantile_cont(value, 0.9) as base, max(value) as most, count(*) as n from events), m as (select count(*) as m from events, q where value > base)
select round(base + least(greatest(8.0 / 0.25 * (pow(0.01 * n / m, -0.25) - 1), 0), most - base), 6) as threshold from q, m""")
def pot_threshold_given(spark, d):
    """The threshold over the values of events under a tail of given shape and scale."""
    values = spark.read.parquet(f"{d}/events.parquet").select("value")
    base, most = quantiles.quantiles(values, "value", [0.9, 1.0])
    n, m = values.agg(F.count("value"), F.sum((F.col("value") > base).cast("long"))).first()
    return spark.createDataFrame([(round(threshold.tail_threshold(base, 0.25, 8.0, 0.01 * n / m, most - base), 6),)], "threshold double")


@query()
def pot_threshold(spark, d):
    t = threshold.fit_threshold(spark.read.parquet(f"{d}/events.parquet").select("value"), "value")
    return spark.createDataFrame([tuple(json.loads(t.to_json()).values())], "threshold double, method string, q0 double, risk_level double, shape double, scale double")


@query("select round(quantile_cont(p_retailprice, 0.97), 6) as threshold, 'percentile_97.0' as method from part")
def pot_threshold_short_tail(spark, d):
    """A tail that has fewer rows than are asked for."""
    t = threshold.fit_threshold(spark.read.parquet(f"{d}/part.parquet"), "p_retailprice", least_tail=1 << 40)
    return spark.createDataFrame([(round(t.threshold, 6), t.method)], "threshold double, method string")


@query(f"with {SCORED} select block_id, round((s - min(s) over ()) / (max(s) over () - min(s) over ()), 6) as if_score from al")
def minmax_scores(spark, d):
    return _rounded(iforest.minmax(_scored(spark, d).select("block_id", "if_score"), "if_score"), "if_score")


@query(f"with {SCORED} select block_id, round(s, 6) as if_score, p as is_anomaly, 0.6::double as threshold, 'fixed' as threshold_method from al")
def label_anomalies(spark, d):
    return _rounded(_scored(spark, d), "if_score")


# views and batch


@query("with p(percentile) as (values (50.0::double), (75.0), (90.0), (95.0), (97.0), (99.0), (99.9)), a as (select list(value) as v from events) select percentile, round(list_aggregate(v, 'quantile_cont', percentile / 100), 6) as value from p, a".replace("list_aggregate(v, 'quantile_cont', percentile / 100)", "case percentile " + " ".join(f"when {p} then (select quantile_cont(value, {p / 100}) from events)" for p in views.PERCENTILES) + " end"))
def score_percentiles(spark, d):
    return _rounded(views.score_percentiles(spark.read.parquet(f"{d}/events.parquet"), "value"), "value")


@query(f"with {SCORED}, h as (select least(floor(s * 50), 49)::int as bin, count(*) as c from al group by 1) select i::int as bin, coalesce(c, 0) as count from range(50) r(i) left join h on bin = i")
def score_histogram(spark, d):
    return views.score_histogram(_scored(spark, d))


@query(f"with {SCORED}, {_CONF} select (select count(*) from al) as total_blocks, (select sum(p) from al)::bigint as anomalies, round((select sum(p) * 100.0 / count(*) from al), 2)::double as anomaly_rate, round({_P}, 4) as precision, round({_R}, 4) as recall, round({_RATES['f1']}, 4) as f1 from conf")
def kpi_stats(spark, d):
    return views.kpi_stats(_scored(spark, d), _aligned(spark, d))


_ANOM = f"with {SCORED} select block_id, round(s, 6) as if_score from al where p = 1"


@query(f"{_ANOM} and s >= 0.65 order by s desc, block_id limit 20 offset 20")
def anomalies_page(spark, d):
    return _rounded(views.anomalies_page(_scored(spark, d), 2, 20, 0.65).select("block_id", "if_score"), "if_score")


@query(f"with {SCORED} select block_id, round(s, 6) as if_score, case when s > 0.7 then 'CRITICAL' when s > 0.55 then 'HIGH' else 'MEDIUM' end as severity from al where p = 1 order by s desc, block_id limit 100")
def alert_severity(spark, d):
    return _rounded(views.stream_alerts(_scored(spark, d), 100).select("block_id", "if_score", "severity"), "if_score")


@query(f"with {LOGS} select line_no, block_id, event_id, case when event_id in ('T5', 'T3') then 'ERROR' else 'INFO' end as level from logs order by line_no desc limit 50")
def api_stream_logs(spark, d):
    return views.stream_logs(_logs(spark, d)).select("line_no", "block_id", "event_id", "level")


_SINCE = datetime(2024, 1, 15)


@query(f"with {EV} select block_id, n from ev where ts > timestamp '2024-01-15 00:00:00'")
def batch_window(spark, d):
    return batch.new_rows(_events(spark, d), _SINCE, "ts").select("block_id", "n")


@query(f"with {EV} select distinct block_id from ev where ts > timestamp '2024-01-15 00:00:00'")
def new_blocks(spark, d):
    return batch.new_blocks(batch.new_rows(_events(spark, d), _SINCE, "ts"))


@query(f"with {SCORED} select count(*) as new_blocks, sum(p)::bigint as anomalies_detected, round(sum(p) / count(*), 6) as anomaly_rate from al")
def run_metadata(spark, d):
    return _rounded(batch.run_metadata(_scored(spark, d)), "anomaly_rate")


@query(f"with {SCORED} select block_id as key, 'BATCH_CONFIRMED' as alert_type from al where p = 1")
def confirmed_alerts(spark, d):
    return batch.confirmed_alerts(_scored(spark, d)).select("key", F.get_json_object("value", "$.alert_type").alias("alert_type"))


# templates


@query()
def drain_templates(spark, d):
    return drain.learn_templates(parse_log_line(spark, d))


@query("select * from (values ('Receiving block <*> src: <*>', true), ('Served block <*>', true), ('PacketResponder <*> for block <*> terminating', false), ('<*> of <*>', false)) v(template, covered)")
def template_coverage(spark, d):
    official = spark.createDataFrame([(t,) for t in ("Receiving block <*> src: <*>", "Served block <*>", "PacketResponder <*> for block <*> terminating", "<*> of <*>")], "template string")
    return drain.template_coverage(official, drain_templates(spark, d))
