"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserlog.llm import decontaminate, language, licenses, neighbours, ngram_join, packing, pseudo_likelihood, shards, threads, toxicity
from tesserlog.llm.shared import scratch_path

TOXIC_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.format_conversations(_table(spark, sf_dir, "conversations"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_corpus(_table(spark, sf_dir, "documents"))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Scorer:
    """Learned from the labelled documents outside the held-out fold; a row without id is in no fold."""
    labelled = docs.select("doc_id", F.octet_length("text").alias("size")).join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    return toxicity.learn(labelled.where(~language.held_out("doc_id", 4, 2)), texts_of=docs)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score_texts(docs, model)
    score = F.col(found.columns[-1])
    return found.select(
        "doc_id", language.held_out("doc_id", 4, 2).alias("held_out"), score.alias("score"), (score >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs.where(~language.held_out()))
    found = language.predict_language(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", language.held_out().alias("held_out"), f"{found.columns[-1]}.lang_pred", f"{found.columns[-1]}.score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at")


def op10_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals, compacted; the committed version read back."""
    docs = _table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, scratch_path(spark, "shards"))
    for arrival in range(4):
        store.append(docs.where(F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)), F.lit(0)) == arrival))
    store.compact()
    store.vacuum()
    return shards.content(store.read())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quotation_threads, op3_pseudo_likelihood, op4_learned_partitions, op5_toxicity,
        op6_best_fit_packing, op7_ngram_jaccard, op8_language_id, op9_decontamination, op10_tiered_shards,
    )
}


def _canonical_sql(text: str) -> str:
    lower = f"regexp_replace(translate({text}, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.OWN_LINE}', '\\1\\2~\\3', 'g')"
    out = f"regexp_replace(regexp_replace({lower}, '{licenses.COPYRIGHT_LINE}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')"
    for spelling, unified in licenses.SPELLINGS:
        out = f"replace({out}, '{spelling}', '{unified}')"
    return f"trim({out})"


_KNOWN = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.KNOWN)
_NL = "chr(10)"

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": f"""
with known as (select sha256({_canonical_sql('t')}) as known, min(k) as license from (values {_KNOWN}) v(k, t) group by 1),
lines as (select distinct doc_id, unnest(string_split(text, {_NL})) as line from documents where doc_id is not null and text is not null),
notices as (select doc_id, string_agg(distinct license, ',' order by license) as notices from lines join known on sha256({_canonical_sql('line')}) = known group by 1),
whole as (select doc_id, sha256({_canonical_sql('text')}) as digest from documents)
select w.doc_id, w.digest, k.license, coalesce(n.notices, '') as notices
from whole w left join known k on w.digest = k.known left join notices n on w.doc_id = n.doc_id
""",
    "op2_quotation_threads": f"""
with recursive m as (
  select conv_id as conv, turn, role, text,
    regexp_replace(array_to_string(list_filter(string_split(coalesce(text, ''), {_NL}), lambda x: not regexp_matches(x, '^[ \\t]*>')), {_NL}),
      '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') as body
  from conversations),
blocks as (select conv, turn, unnest(regexp_extract_all(text, '((?:^|\\n)[ \\t]*>[^\\n]*)+')) as b from m where conv is not null and turn is not null),
marked as (select conv, turn, list_transform(string_split(b, {_NL}), lambda x: {{
    'l': length(regexp_replace(regexp_extract(x, '^([ \\t]*>)+'), '[^>]', '', 'g')), 't': regexp_replace(x, '^([ \\t]*>)+', '')}}) as ls from blocks),
each_level as (select conv, turn, ls, unnest(range(1, list_max(list_transform(ls, lambda x: x.l)) + 1)) as level from marked),
quoted as (select distinct conv, turn, level, t from (
  select conv, turn, level, trim(regexp_replace(lower(array_to_string(list_transform(list_filter(ls, lambda x: x.l = level), lambda x: x.t), {_NL})), '[ \\t\\r\\n]+', ' ', 'g')) as t
  from each_level) where t <> ''),
units as (
  select conv, turn, body as u from m union all
  select conv, turn, unnest(regexp_split_to_array(body, '\\n[ \\t\\r]*\\n')) from m union all
  select conv, turn, unnest(string_split(body, {_NL})) from m),
originals as (select distinct conv, turn, trim(regexp_replace(lower(u), '[ \\t\\r\\n]+', ' ', 'g')) as t from units),
links as (select q.conv, q.turn, q.level, q.t, max(o.turn) as source from quoted q
  left join originals o on o.conv = q.conv and o.t = q.t and o.turn < q.turn group by all),
shallow as (select conv, turn, count(*) as n_quoted, count(source) as n_linked, min(case when source is not null then level end) as level from links group by all),
replies as (select s.conv, s.turn, s.n_quoted, s.n_linked, max(l.source) as reply_to from shallow s
  left join links l on l.conv = s.conv and l.turn = s.turn and l.level = s.level and l.source is not null group by all),
chain(conv, turn, root) as (
  select conv, turn, reply_to from replies where reply_to is not null
  union all
  select c.conv, c.turn, r.reply_to from chain c join replies r on r.conv = c.conv and r.turn = c.root where r.reply_to is not null),
roots as (select conv, turn, min(root) as root from chain group by all)
select m.conv as conv_id, m.turn, m.role, m.body, coalesce(r.n_quoted, 0) as n_quoted, coalesce(r.n_linked, 0) as n_linked, r.reply_to, coalesce(roots.root, m.turn) as root_turn,
  case when m.conv is not null then row_number() over (partition by m.conv order by coalesce(roots.root, m.turn) nulls first, m.turn nulls first, m.role nulls first, sha256(coalesce(m.text, ''))) end as position
from m left join replies r on r.conv = m.conv and r.turn = m.turn left join roots on roots.conv = m.conv and roots.turn = m.turn
""",
    "op7_ngram_jaccard": """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents),
g as (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    when len(ws) > 0 then [array_to_string(ws, ' ') || ' #' || len(ws)] else [] end) as s from w),
n as (select doc_id, count(*) as n from g group by 1),
d as (select doc_id, n, h from n join (select doc_id, md5(string_agg(s, chr(10) order by s)) as h from g group by 1) using (doc_id)),
reps as (select h, min(doc_id) as rep, any_value(n) as n from d group by 1),
rg as (select rep, s from g join reps on g.doc_id = reps.rep),
pairs as (select a.rep as x, b.rep as y, count(*) as c from rg a join rg b on a.s = b.s and a.rep < b.rep group by 1, 2),
links as (select x, y from pairs join reps p on p.rep = x join reps q on q.rep = y where 100 * c >= 90 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach(node, seen) as (select rep, rep from reps union select r.node, b.y from reach r join both_ways b on b.x = r.seen),
comp as (select node, min(seen) as c from reach group by 1)
select documents.doc_id, coalesce(d.n, 0) as n_shingles, coalesce(comp.c, documents.doc_id) as component_id
from documents left join d using (doc_id) left join reps on reps.h = d.h left join comp on comp.node = reps.rep
""",
    "op9_decontamination": """
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as ws
  from documents),
b as (
  select row_number() over () as r, item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as ws
  from benchmark),
win as (select r, item_id, j, k, unnest(list_transform([1], lambda z: array_to_string(ws[j:j + k - 1], ' '))) as t
  from (select r, item_id, ws, least(13, len(ws)) as k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as j from b where len(ws) > 0)),
occ as (select doc_id, i, k, unnest(list_transform([1], lambda z: array_to_string(ws[i:i + k - 1], ' '))) as t
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select distinct k from win) where len(ws) >= k)),
found as (select doc_id, i, j, r, o.k, item_id from occ o join win on win.k = o.k and win.t = o.t),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from found group by 1),
runs as (select doc_id, r, k, i, i - j as d, i - row_number() over (partition by doc_id, r, i - j order by i) as g from found),
longest as (select doc_id, count(*) + any_value(k) - 1 as longest_match, min(i) - 1 as longest_at from runs group by doc_id, r, d, g
  qualify row_number() over (partition by doc_id order by count(*) + any_value(k) desc, min(i)) = 1)
select doc_id, coalesce(len(ws), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) as contaminated, coalesce(longest_match, 0) as longest_match, longest_at
from w left join hit using (doc_id) left join items using (doc_id) left join longest using (doc_id)
""",
    "op10_tiered_shards": "select doc_id, cast(strlen(text) as bigint) as n_bytes, sha256(text) as text_sha256 from documents",
}
