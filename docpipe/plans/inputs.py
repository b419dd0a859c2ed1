"""Documents that the driver's star schema makes up, as SQL that Spark and DuckDB read alike.

Amounts are whole cents, so both engines render the same texts. Table names stand in braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = {x for x in re.findall(r"\{(\w+)\}", sql) if x in TABLES}
    escaped = re.sub(r"\{\{(\w+)\}\}", lambda m: "{" + m[1] + "}" if m[1] in TABLES else m[0], sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(escaped, **{name: table(spark, sf_dir, name) for name in names})


def plain(sql: str) -> str:
    """The same SQL over views with the tables' names."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def whole(c: str) -> str:
    return f"cast(cast(floor(({c}) / 100) as bigint) as string)"


def cents(c: str, mark: str = ".") -> str:
    """Cents as text with two decimals."""
    return f"concat({whole(c)}, '{mark}', lpad(cast(({c}) % 100 as string), 2, '0'))"


def grouped(c: str, group: str) -> str:
    """Cents as text with a decimal comma and a mark before the last three whole digits."""
    return f"case when {c} >= 100000 then concat(cast(cast(floor({c} / 100000) as bigint) as string), '{group}', lpad(cast(cast(floor({c} / 100) as bigint) % 1000 as string), 3, '0'), ',', lpad(cast({c} % 100 as string), 2, '0')) else {cents(c, ',')} end"


LINES = """
select *, cast(floor((net_c * (100 + t) + 50) / 100) as bigint) as gross_c from (
  select *, cast(floor(ext / q) as bigint) as unit_c, cast(floor((ext * (100 - d) + 50) / 100) as bigint) as net_c from (
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as q, cast(round(l_extendedprice * 100) as bigint) as ext,
      cast(round(l_discount * 100) as bigint) as d, cast(round(l_tax * 100) as bigint) as t from {lineitem}) a) b"""

#: Amounts as texts of five styles, by part.
AMOUNTS = f"""
select l_orderkey, l_linenumber, l_partkey, ext, case cast(l_partkey % 6 as int)
  when 0 then {cents("ext")} when 1 then {cents("ext", ",")} when 2 then {grouped("ext", ".")} when 3 then concat({cents("ext", ",")}, ' Ft')
  when 4 then concat({grouped("ext", " ")}, ' EUR') else concat('  ', {cents("ext")}, '0 HUF') end as raw
from ({LINES}) l"""

#: Items of invoices (one for each order); some have net and gross exchanged, some an unreadable net, some no amounts.
ITEMS = f"""
select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, q, ext, d, t) as int) as item_no,
  p_name as name, cast(q as string) as quantity, {cents("unit_c")} as unit_price,
  case when l_partkey % 97 = 5 then '1.2.3' when l_partkey % 89 = 7 then '' when l_partkey % 17 = 3 then {cents("gross_c")} else {cents("net_c")} end as net,
  case when l_partkey % 89 = 7 then '' when l_partkey % 17 = 3 then {cents("net_c")} else {cents("gross_c")} end as gross,
  'HUF' as currency, q, unit_c, net_c, gross_c, t, l_partkey
from ({LINES}) l join {{part}} on l_partkey = p_partkey"""

ROW_TEXT = f"concat(name, ' 4744183012622 ', quantity, ' ', {cents('unit_c', ',')}, ' ', {cents('net_c', ',')}, ' ', cast(t as string), '% ', {cents('gross_c - net_c', ',')}, ' ', {cents('gross_c', ',')})"

#: What items are made of, which is all of them that is shuffled.
SOLD = """
select l_orderkey as doc_id, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as q, cast(round(l_extendedprice * 100) as bigint) as ext,
  cast(round(l_discount * 100) as bigint) as d, cast(round(l_tax * 100) as bigint) as t from {lineitem}"""


def items(spark: SparkSession, sf_dir: str, of_name: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The rows of ITEMS, dealt by document, with columns `of_name`, made of names once for each part.

    Texts and amounts are made of an item's numbers where they are needed, behind the shuffle, and its window has the key that
    later steps group and join by. So numbers and names are what is shuffled, and once for all branches of a plan.
    """
    extra = of_name or {}
    sold, parts = run(spark, sf_dir, SOLD), table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), *(make(F.col("p_name")).alias(c) for c, make in extra.items()))
    dealt = sold.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").repartition("doc_id")
    numbered = dealt.withColumn("item_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q", "ext", "d", "t")))
    netted = numbered.withColumns({"unit_c": F.expr("cast(floor(ext / q) as bigint)"), "net_c": F.expr("cast(floor((ext * (100 - d) + 50) / 100) as bigint)")})
    priced = netted.withColumn("gross_c", F.expr("cast(floor((net_c * (100 + t) + 50) / 100) as bigint)"))
    swapped = "l_partkey % 17 = 3"
    net = f"case when l_partkey % 97 = 5 then '1.2.3' when l_partkey % 89 = 7 then '' when {swapped} then {cents('gross_c')} else {cents('net_c')} end"
    gross = f"case when l_partkey % 89 = 7 then '' when {swapped} then {cents('net_c')} else {cents('gross_c')} end"
    return priced.selectExpr("doc_id", "item_no", "name", "cast(q as string) as quantity", f"{cents('unit_c')} as unit_price", f"{net} as net", f"{gross} as gross", "'HUF' as currency", "q", "unit_c", "net_c", "gross_c", "t", "l_partkey", *extra)


#: Lines of the invoices' tables: a header, a row for each item, up to two lines that go on with its name, sums, a greeting.
TABLE_LINES = f"""
select doc_id, cast(3 * item_no + k as int) as line_no, case k when 0 then {ROW_TEXT} when 1 then 'deluxe edition' else 'in blue box' end as line
from ({ITEMS}) i join (values (0), (1), (2)) v(k) on k = 0 or k = 1 and l_partkey % 3 = 0 or k = 2 and l_partkey % 6 = 0
union all select o_orderkey, cast(case k when 0 then 0 else 89999 + k end as int), case k when 0 then 'Item quantity unit net gross' when 1 then 'Total' when 2 then '1,00 2,00 3,00' else 'Thank you' end
from {{orders}} join (values (0), (1), (2), (3)) v(k) on k = 0 or k = 3 or k = 1 and o_orderkey % 2 = 0 or k = 2 and o_orderkey % 4 = 0"""



def table_lines(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """The rows of TABLE_LINES, dealt by document as `items` are."""

    def listed(*lines: tuple[bool | Column, int | Column, str | Column]) -> Column:
        return F.inline_outer(F.filter(F.array(*(F.when(on, F.struct(F.lit(no).cast("int").alias("line_no"), F.lit(line).alias("line"))) for on, no, line in lines)), lambda x: x.isNotNull()))

    at, part, order = F.col("item_no") * 3, F.col("l_partkey"), F.col("doc_id")
    own = items.select("doc_id", listed((F.lit(True), at, F.expr(ROW_TEXT)), (part % 3 == 0, at + 1, "deluxe edition"), (part % 6 == 0, at + 2, "in blue box")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).repartition("doc_id")
    sums = listed((F.lit(True), 0, "Item quantity unit net gross"), (order % 2 == 0, 90000, "Total"), (order % 4 == 0, 90001, "1,00 2,00 3,00"), (F.lit(True), 90002, "Thank you"))
    return own.unionByName(orders.select("doc_id", sums))


#: Words with places: lines whose y drifts and wavers, gaps of two widths, some documents in two columns.
WORD_PLACES = """
  cast(floor(i / 240) as int) as page_no, 0 as block_no, cast(floor((i % 240) / 8) as int) as line_no, cast(i as int) as word_no, w as value,
  cast((i % 3) * 30 + (i % 7) * 2 + case when doc_id % 4 = 0 and i % 2 = 1 then 500 else 0 end as double) / 1000 as x,
  cast((i % 240) * 3 + (i * 7 + doc_id) % 6 as double) / 1000 as y, cast((doc_id * 31 + i * 17) % 100 as double) / 100 as confidence"""
WORDS = f"select doc_id, {WORD_PLACES} from (select doc_id, posexplode(split(trim(text), ' +')) as (i, w) from {{documents}}) p where w <> ''"
WORDS_DUCK = f"select doc_id, {WORD_PLACES} from (select doc_id, unnest(a) as w, generate_subscripts(a, 1) - 1 as i from (select doc_id, regexp_split_to_array(trim(text), ' +') as a from documents)) p where w <> ''"

#: Dates of orders in the formats of business documents, and one that is none.
DATE_PARTS = "cast(year(o_orderdate) as string) as y, lpad(cast(month(o_orderdate) as string), 2, '0') as m, lpad(cast(day(o_orderdate) as string), 2, '0') as d"
DATES = f"""
select o_orderkey, case cast(o_orderkey % 14 as int) when 0 then concat(y, '-', m, '-', d) when 1 then concat(y, '.', m, '.', d) when 2 then concat(y, '. ', m, '. ', d, '.')
  when 3 then concat(y, '. ', m, '. ', d) when 4 then concat(y, ' / ', m, ' / ', d) when 5 then concat(y, '/', m, '/', d) when 6 then concat(d, '.', m, '.', y)
  when 7 then concat(d, '. ', m, '. ', y, '.') when 8 then concat(d, '. ', m, '. ', y) when 9 then concat(d, '/', m, '/', y) when 10 then concat(d, '-', m, '-', y)
  when 11 then concat(m, '/', d, '/', y) when 12 then concat(y, m, d) else concat('due in ', d, ' days') end as raw from (select o_orderkey, {DATE_PARTS} from {{orders}}) o"""

#: Responses of a language model about an invoice's header: fenced, after prose, cut short, with nulls and wrong types.
RESPONSES = """
select doc_id, o_custkey, case cast(doc_id % 7 as int) when 0 then concat('```json', chr(10), body, chr(10), '```') when 1 then concat('Here it is: ', body)
  when 2 then substring(body, 1, length(body) - 1) when 3 then concat(body, ' Done.') else body end as response from (
  select o_orderkey as doc_id, o_custkey, concat('{"seller":', case when o_orderkey % 7 = 4 then '"none"' else concat('{"name":"Seller, ', cast(o_custkey % 10 as string), '","tax_id":"HU', cast(o_custkey as string), '"}') end,
    ',"buyer":{"name":"', c_name, '"},"invoice_number":"INV-', cast(o_orderkey as string), '","issue_date":"', cast(year(o_orderdate) as string), '","currency":', case when o_orderkey % 7 = 5 then 'null' else '"EUR"' end,
    ',"invoice_data":[{"name":"a","quantity":"2","net":"', cast(o_custkey as string), '"},', case when o_orderkey % 7 = 6 then '"x",' else '' end, '{"name":null,"gross":', cast(o_orderkey as string), '}]}') as body
  from {orders} join {customer} on o_custkey = c_custkey) r"""

#: Responses whose object is damaged in a dozen ways, by document; two in sixteen hold none.
DAMAGED = r"""
select doc_id, o_custkey, case cast(doc_id % 16 as int) when 0 then body when 1 then translate(body, '"', "'") when 2 then regexp_replace(body, '"(\w+)":', '$1: ')
  when 3 then replace(replace(body, ',"', ' "'), '},{', '} {') when 4 then concat(replace(body, ',"buyer"', ', // who pays\n "buyer"'), ' /* done') when 5 then concat('Here: ', body, ' I hope {"this": helps}')
  when 6 then replace(replace(body, '}', ',}'), ']', ',]') when 7 then substring(body, 1, length(body) - 3) when 8 then replace(body, '":', '" ') when 9 then replace(body, '"EUR"', 'None')
  when 10 then replace(body, 'Seller, ', 'Seller "best", ') when 11 then replace(body, '","issue_date"', ',"issue_date"') when 12 then replace(body, ']}', '}') when 13 then 'This invoice cannot be read.'
  when 14 then null else concat('```json\n', translate(substring(body, 1, length(body) - 2), '"', "'"), '\n```') end as response from (
  select o_orderkey as doc_id, o_custkey, concat('{"seller":{"name":"Seller, ', cast(o_custkey % 10 as string), '","tax_id":"HU', cast(o_custkey as string), '"},"buyer":{"name":"', c_name, '"},"invoice_number":"INV-', cast(o_orderkey as string),
    '","issue_date":"', cast(year(o_orderdate) as string), '","currency":"EUR","invoice_data":[{"name":"a","quantity":"2","net":"', cast(o_custkey as string), '"},{"name":"b","gross":', cast(o_orderkey as string), '}]}') as body
  from {orders} join {customer} on o_custkey = c_custkey) r"""

#: Events of users as events of their jobs.
JOB_EVENTS = """
select cast(user_id as string) as job_id, ts, event_id as seq,
  case when event_type = 'signup' then 'create' when event_type = 'purchase' and event_id % 7 = 0 then 'complete' when event_type = 'error' and event_id % 5 = 0 then 'error' when event_type = 'click' and event_id % 50 = 0 then 'cancel' else 'update' end as action,
  case cast(event_id % 6 as int) when 0 then 'upload' when 1 then 'ocr' when 2 then 'llm' when 3 then 'postprocess' when 4 then 'vision' end as stage,
  cast(event_id % 130 - 10 as int) as progress, cast(null as string) as message from {events}"""
