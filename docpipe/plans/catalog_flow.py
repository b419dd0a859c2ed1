"""Queries of responses, whole invoices and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.functions import jsonx
from docpipe.functions.repair import repair_json
from docpipe.plans import inputs, invoice, oracle_invoices
from docpipe.sources import plugins
from docpipe.sources.ledger import Calls, ResponseLedger
from docpipe.sources.places import shared_folder
from docpipe.streaming import feed, jobs
from docpipe.streaming.store import KeyedStore


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, inputs.RESPONSES)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = invoice.parsed(responses(spark, sf_dir).withColumn("kind", F.lit("full")))
    h = F.col("header")
    return rows.select("doc_id", h["seller"]["name"].alias("seller_name"), h["seller"]["tax_id"].alias("seller_tax_id"), h["buyer"]["name"].alias("buyer_name"), h["invoice_number"].alias("invoice_number"), h["issue_date"].alias("issue_date"), h["currency"].alias("currency"), "parse_error")


OBJECTS = rf"j as (select doc_id, case when json_valid(s) then s end as j from (select doc_id, regexp_extract(response, '(?s)\{{.*\}}') as s from ({inputs.RESPONSES}) x) y)"
HEADERS = f"""
with {OBJECTS}
select doc_id, coalesce(j->>'$.seller.name', '') as seller_name, coalesce(j->>'$.seller.tax_id', '') as seller_tax_id, coalesce(j->>'$.buyer.name', '') as buyer_name, coalesce(j->>'$.invoice_number', '') as invoice_number,
  coalesce(j->>'$.issue_date', '') as issue_date, case when json_type(j, '$.currency') = 'NULL' then 'None' else coalesce(j->>'$.currency', '') end as currency, j is null as parse_error from j"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = invoice.parsed(responses(spark, sf_dir).withColumn("kind", F.lit("full")))
    return rows.select("doc_id", F.posexplode("items").alias("at", "i")).select("doc_id", (F.col("at") + 1).alias("item_no"), "i.name", "i.quantity", "i.net", "i.gross")


ITEMS = f"""
with {OBJECTS}, e as (select doc_id, unnest(json_extract(j, '$.invoice_data[*]')) as e, unnest(range(json_array_length(j, '$.invoice_data')::bigint)) as n from j where j is not null),
o as (select doc_id, e, row_number() over (partition by doc_id order by n)::int as item_no from e where json_type(e) = 'OBJECT')
select doc_id, item_no, case when json_type(e, '$.name') = 'NULL' then 'None' else coalesce(e->>'$.name', '') end as name, coalesce(e->>'$.quantity', '') as quantity, coalesce(e->>'$.net', '') as net, coalesce(e->>'$.gross', '') as gross from o"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("doc_id", jsonx.largest_array(F.col("response")).alias("array"), jsonx.largest_object(F.col("response")).alias("object"), jsonx.strip_fence(F.col("response")).alias("inside"))


ARRAYS = rf"""
with a as (select doc_id, response, regexp_extract_all(response, '(?s)\[.*?\]') as a, regexp_extract_all(response, '\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}') as o from ({inputs.RESPONSES}) x)
select doc_id, list_filter(a, lambda x: length(x) = list_max(list_transform(a, lambda y: length(y))))[1] as "array", list_filter(o, lambda x: length(x) = list_max(list_transform(o, lambda y: length(y))))[1] as "object",
  regexp_replace(response, '(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$', '\1') as inside from a"""


def mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged responses, read by the tolerant reader; those without any object are errors."""
    rows = invoice.parsed(inputs.run(spark, sf_dir, inputs.DAMAGED).withColumn("kind", F.lit("full")), repair=repair_json)
    h, i = F.col("header"), lambda n, name: F.coalesce(F.get("items", F.lit(n))[name], F.lit(""))
    return rows.select("doc_id", h["seller"]["name"].alias("seller_name"), h["seller"]["tax_id"].alias("seller_tax_id"), h["buyer"]["name"].alias("buyer_name"), h["invoice_number"].alias("invoice_number"), h["issue_date"].alias("issue_date"), h["currency"].alias("currency"), F.size("items").alias("n_items"), i(0, "net").alias("net"), i(1, "gross").alias("gross"), F.when(F.col("parse_error"), "no object").alias("error"))


#: What the responses said before they were damaged.
MENDED = """
with r as (select o_orderkey as doc_id, o_custkey, c_name, year(o_orderdate)::varchar as y, o_orderkey % 16 in (13, 14) as bad, o_orderkey % 16 as way from {orders} join {customer} on o_custkey = c_custkey)
select doc_id, case when bad then '' else 'Seller' || case when way = 10 then ' "best"' else '' end || ', ' || (o_custkey % 10) end as seller_name, case when bad then '' else 'HU' || o_custkey end as seller_tax_id,
  case when bad then '' else c_name end as buyer_name, case when bad then '' else 'INV-' || doc_id end as invoice_number, case when bad then '' else y end as issue_date, case when bad then '' when way = 9 then 'None' else 'EUR' end as currency,
  case when bad then 0 else 2 end::int as n_items, case when bad then '' else o_custkey::varchar end as net, case when bad then '' else doc_id::varchar end as gross, case when bad then 'no object' end as error from r"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses and table texts through the whole plan: parsed, cleaned, matched, repaired, totalled."""
    items = inputs.items(spark, sf_dir)
    listed = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "name", "quantity", "unit_price", "net", "gross", "currency"))).alias("invoice_data"))
    asked = responses(spark, sf_dir).select("doc_id", F.lit("metadata").alias("kind"), "response").repartition("doc_id")
    answers = asked.unionByName(listed.select("doc_id", F.lit("items").alias("kind"), F.to_json(F.struct("invoice_data")).alias("response")))
    lines = inputs.table_lines(spark, sf_dir, items).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    done = invoice.process(answers, lines.select("doc_id", F.array_join("l.line", "\n").alias("table_text")))
    return done.select("id", "invoice_number", "issue_date", "currency", F.col("n_items").cast("int").alias("n_items"), F.col("total_net").cast("double").alias("total_net"), F.col("total_gross").cast("double").alias("total_gross"), F.size("warnings").alias("n_warnings"), "parse_error")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in model's answers to prompts of every document, parsed into empty invoices."""
    prompts = inputs.run(spark, sf_dir, "select cast(doc_id as string) as doc_id, 'full' as kind, text as prompt from {documents}")
    done = invoice.parsed(plugins.completions(prompts, plugins.EmptyModel).select("doc_id", "kind", "response"))
    return done.select("doc_id", F.size("items").alias("n_items"), F.col("header.currency").alias("currency"), "parse_error")


ANSWERS = "select doc_id::varchar as doc_id, 0 as n_items, '' as currency, false as parse_error from {documents}"


def asked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to every document through the ledger, in two runs of which the second asks only what the first did not."""
    prompts = inputs.run(spark, sf_dir, "select cast(doc_id as string) as doc_id, 'full' as kind, coalesce(text, '') as prompt from {documents}")
    ledger, calls = ResponseLedger(spark, shared_folder(spark, "ledger")), Calls(flush_rows=2000)
    ledger.complete(prompts.where("cast(doc_id as bigint) % 3 = 0"), plugins.LengthModel, "length", calls=calls)
    done = ledger.complete(prompts, plugins.LengthModel, "length", calls=calls)
    read = invoice.parsed(done.select("doc_id", "kind", "response"))
    return read.select("doc_id", F.col("header.invoice_number").alias("invoice_number"), F.get("items", F.lit(0))["name"].alias("name"), "parse_error")


ASKED_ONCE = "select doc_id::varchar as doc_id, length(coalesce(text, ''))::varchar as invoice_number, substr(coalesce(text, ''), 1, 5) as name, false as parse_error from {documents}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, inputs.JOB_EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_states(events(spark, sf_dir)).select("job_id", "status", "progress", "stage", "n_events")


STATES = f"""
with e as (select *, row_number() over (partition by job_id order by ts, seq) as n from ({inputs.JOB_EVENTS}) x),
c as (select job_id, min(n) filter (action = 'create') as born, count(*) as n_events from e group by job_id),
f as (select job_id, min(n) as ended from e join c using (job_id) where n > born and action in ('complete', 'error', 'cancel') group by job_id),
a as (select e.*, born, n_events, ended from e join c using (job_id) left join f using (job_id)),
u as (select job_id, any_value(born) as born, any_value(n_events) as n_events, max(action) filter (n = ended) as last_action, count(*) filter (n > born and action = 'update' and (ended is null or n < ended)) as n_updates,
  arg_max(greatest(0, least(100, progress)), n) filter (n > born and action = 'update' and (ended is null or n < ended)) as p,
  arg_max(stage, n) filter (n > born and stage is not null and (action = 'update' and (ended is null or n < ended) or action = 'complete' and n = ended)) as s from a group by job_id)
select job_id, case when born is null then null when last_action = 'complete' then 'completed' when last_action = 'cancel' then 'cancelled' when last_action = 'error' then 'error' when n_updates > 0 then 'processing' else 'started' end as status,
  (case when born is null then null when last_action = 'complete' then 100 else coalesce(p, 0) end)::int as progress, case when born is not null then coalesce(s, 'upload') end as stage, n_events from u"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = events(spark, sf_dir).select("job_id", "ts", "seq", F.col("action").alias("status"), (F.col("seq") % 2).cast("int").alias("progress"), F.lit("ocr").alias("stage"))
    return jobs.changes(snapshots).select("job_id", "seq", "status", "progress")


CHANGES = f"""
with s as (select job_id, seq, action as status, (seq % 2)::int as progress, lag((action, seq % 2)) over (partition by job_id order by ts, seq) as before from ({inputs.JOB_EVENTS}) x)
select job_id, seq, status, progress from s where before is null or before <> (status, progress::bigint)"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stage_durations(events(spark, sf_dir))


DURATIONS = f"""
select job_id, stage, coalesce(floor((greatest(epoch_us(max(ts)) - epoch_us(min(ts) filter (progress > 0)), 0) + 50000) / 100000)::bigint / 10, null) as seconds
from ({inputs.JOB_EVENTS}) x where stage in ('upload', 'ocr', 'llm', 'postprocess') and action in ('update', 'complete') group by all"""


def kept_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events(spark, sf_dir).groupBy("job_id").agg(F.max("ts").alias("updated_at"))
    return jobs.retained(last, F.lit("2024-01-30 12:00:00").cast("timestamp"), 12 * 3600).select("job_id")


KEPT_JOBS = f"select job_id from ({inputs.JOB_EVENTS}) x group by job_id having max(ts) >= timestamp '2024-01-30 00:00:00'"

def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.snapshots(events(spark, sf_dir))


_stage = lambda name: f"""'"{name}":{{"progress":' || coalesce(max(p) filter (stage = '{name}'), 0) || ',"status":"' || coalesce(max(s) filter (stage = '{name}'), 'pending') || '"' || coalesce(',"duration":' || max(seconds::double) filter (stage = '{name}'), '') || '}}'"""
SNAPSHOTS = f"""
with states as ({STATES}), durations as ({DURATIONS}),
stages as (select job_id, stage, case when bool_or(action = 'complete') then 100 else greatest(0, least(100, arg_max(coalesce(progress, 0), (ts, seq)))) end as p,
  case when bool_or(action = 'complete') then 'completed' when bool_or(progress > 0) then 'processing' else 'pending' end as s
  from ({inputs.JOB_EVENTS}) x where stage in ('upload', 'ocr', 'llm', 'postprocess') and action in ('update', 'complete') group by all),
listed as (select st.job_id, st.status, st.progress, st.stage as place, g.stage, p, s, seconds from states st left join stages g using (job_id) left join durations d on d.job_id = g.job_id and d.stage = g.stage where st.status is not null)
select job_id, '{{"status":"' || status || '","progress":' || progress || ',"stage":"' || place || '","stages":{{' || {_stage('upload')} || ',' || {_stage('ocr')} || ',' || {_stage('llm')} || ',' || {_stage('postprocess')} || '}}}}' as snapshot
from listed group by job_id, status, progress, place"""


def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.listed(jobs.job_states(events(spark, sf_dir)))


JOB_LIST = f"select job_id, status, progress from ({STATES}) x where status is not null"

def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listeners of all jobs are sent."""
    return feed.job_feed(events(spark, sf_dir)).select("job_id", "seq", "event", "status", "progress", "stage")


FEED = f"""
with e as (select distinct job_id, ts, seq, action, stage, progress, row_number() over (partition by job_id order by ts, seq) as n from ({inputs.JOB_EVENTS}) x),
c as (select job_id, min(n) filter (action = 'create') as born from e group by job_id),
f as (select job_id, min(n) as ended from e join c using (job_id) where n > born and action in ('complete', 'error', 'cancel') group by job_id),
a as (select e.*, born, ended from e join c using (job_id) left join f using (job_id) where n >= born and (ended is null or n <= ended)),
s as (select job_id, n, seq, ended = n as final, case when ended = n then case action when 'complete' then 'completed' when 'cancel' then 'cancelled' else 'error' end when bool_or(action = 'update' and n > born) over w then 'processing' else 'started' end as status,
  case when ended = n and action = 'complete' then 100 else coalesce(last_value(case when action = 'update' and n > born then greatest(0, least(100, progress)) end ignore nulls) over w, 0) end::int as progress,
  coalesce(last_value(case when action = 'update' and n > born or action = 'complete' and n = ended then stage end ignore nulls) over w, 'upload') as stage
  from a window w as (partition by job_id order by n rows between unbounded preceding and current row)),
d as (select *, lag((status, progress, stage)) over (partition by job_id order by n) as before from s)
select job_id, seq, case when final then 'complete' else 'progress' end as event, status, progress, stage from d where before is null or before <> (status, progress, stage)"""

def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each job from a store that takes the events in eight batches, two of them twice, and compacts twice."""
    rows = events(spark, sf_dir).withColumn("batch", (F.col("seq") % 8).cast("int"))
    store = KeyedStore(spark, shared_folder(spark, "store"), "job_id string, seq long, action string, progress int", "job_id", ("seq",), 16)
    for batch in (0, 1, 2, 1, 3, 4, 5, 2, 6, 7):
        store.upsert(rows.where(F.col("batch") == batch), batch)
        if batch in (3, 6):
            store.compact()
    return store.latest()


#: Batches follow each other, within one the greatest seq is the latest.
STORED = f"select job_id, arg_max(seq, (seq % 8, seq)) as seq, arg_max(action, (seq % 8, seq)) as action, arg_max(progress, (seq % 8, seq)) as progress from ({inputs.JOB_EVENTS}) x group by job_id"

QUERIES = {
    "json_header": headers, "json_items": items, "json_longest": arrays, "json_repair": mended, "process_invoices": invoices, "model_answers": answers, "model_ledger": asked_once,
    "job_state": states, "job_changes": changes, "job_feed": live_feed, "result_store": stored, "stage_durations": durations, "job_retention": kept_jobs, "job_snapshot": snapshot, "job_list": job_list,
}
ORACLES = {
    "json_header": HEADERS, "json_items": ITEMS, "json_longest": ARRAYS, "json_repair": MENDED, "model_answers": ANSWERS, "model_ledger": ASKED_ONCE, "process_invoices": oracle_invoices.oracle(HEADERS),
    "job_state": STATES, "job_changes": CHANGES, "job_feed": FEED, "result_store": STORED, "stage_durations": DURATIONS, "job_retention": KEPT_JOBS, "job_snapshot": SNAPSHOTS, "job_list": JOB_LIST,
}
