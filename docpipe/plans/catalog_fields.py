"""Queries of single fields: numbers, dates, currencies, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.functions import currency, dates, numeric, text
from docpipe.operators.validate import invoice_totals
from docpipe.plans import inputs
from docpipe.plans.inputs import cents
from docpipe.plans.prompts import extraction_prompt, prompt_frame
from docpipe.sources.uploads import MAX_BYTES, rejection


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleans the items' amounts and totals every invoice, with the number of warnings."""
    items = inputs.run(spark, sf_dir, inputs.ITEMS)
    cleaned = items.select("doc_id", "item_no", "name", numeric.clean_numeric(F.col("net")).alias("net"), numeric.clean_numeric(F.col("gross")).alias("gross"))
    money = lambda c: F.col(c).cast("double").alias(c)
    return invoice_totals(cleaned).select("doc_id", F.col("n_items").cast("long").alias("n_items"), money("total_net"), money("total_gross"), F.size("warnings").cast("long").alias("n_warnings"), F.array_join("warnings", ";").alias("warnings"))


TOTALS = f"""
with i as (select *, case when l_partkey % 97 = 5 then null when l_partkey % 89 = 7 then null when l_partkey % 17 = 3 then gross_c else net_c end as n,
  case when l_partkey % 97 = 5 or l_partkey % 89 = 7 then null when l_partkey % 17 = 3 then net_c else gross_c end as g from ({inputs.ITEMS}) x),
w as (select *, case when l_partkey % 97 = 5 then concat('Item ', item_no, ': Invalid numeric values')
  when g < n and g > 0 then concat('Item ', item_no, ' ''', name[:30], ''': gross (', {cents("g")}, ') < net (', {cents("n")}, ')') end as w from i)
select doc_id, count(*) as n_items, coalesce(sum(n), 0)::bigint / 100 as total_net, coalesce(sum(g), 0)::bigint / 100 as total_gross, count(w) as n_warnings, coalesce(string_agg(w, ';' order by item_no), '') as warnings
from w group by doc_id"""


def cleaned_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, inputs.AMOUNTS).select("l_orderkey", "l_linenumber", "raw", numeric.clean_numeric(F.col("raw")).alias("cleaned"))


CLEANED = rf"""
with a as (select *, regexp_replace(replace(replace(replace(replace(replace(trim(raw), 'Ft', ''), 'HUF', ''), 'EUR', ''), 'USD', ''), ' ', ''), '\.(\d{{3}})', '\1', 'g') as c from ({inputs.AMOUNTS}) x)
select l_orderkey, l_linenumber, raw, case when c like '%,%' then replace(replace(c, '.', ''), ',', '.') else c end as cleaned from a"""

NET_GROSS_INPUT = f"select l_orderkey, l_linenumber, case when l_partkey % 3 = 0 then concat({cents('gross_c', ',')}, ' Ft') when l_partkey % 31 = 1 then 'n/a' else {cents('net_c')} end as net, case when l_partkey % 3 = 0 then {cents('net_c', ',')} else {cents('gross_c')} end as gross from ({inputs.LINES}) l"


def net_gross(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.run(spark, sf_dir, NET_GROSS_INPUT)
    return rows.withColumn("i", numeric.fix_net_gross(F.struct("net", "gross"))).select("l_orderkey", "l_linenumber", "i.net", "i.gross")


NET_GROSS = rf"""
with a as (select *, try_cast(replace(regexp_replace(net, '[^0-9,.-]', '', 'g'), ',', '.') as double) as n, try_cast(replace(regexp_replace(gross, '[^0-9,.-]', '', 'g'), ',', '.') as double) as g from ({NET_GROSS_INPUT}) x)
select l_orderkey, l_linenumber, case when g < n and g > 0 and n > 0 then gross else net end as net, case when g < n and g > 0 and n > 0 then net else gross end as gross from a"""

UNIT_INPUT = f"select l_orderkey, l_linenumber, cast(q as string) as quantity, concat(case when l_partkey % 4 = 0 then '7' else '' end, {cents('unit_c')}) as unit_price, {cents('unit_c * q')} as net from ({inputs.LINES}) l"


def unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.run(spark, sf_dir, UNIT_INPUT)
    return rows.withColumn("unit_price", numeric.fix_unit_price(F.col("quantity"), F.col("unit_price"), F.col("net")))


UNIT = f"""
with a as (select *, quantity::double as q, unit_price::double as u, net::double as n from ({UNIT_INPUT}) x)
select l_orderkey, l_linenumber, quantity, net, case when abs(u * q - n) > n * 0.1::double and length(split_part(unit_price, '.', 1)) >= 2 and abs(unit_price[2:]::double * q - n) < 1 then unit_price[2:] else unit_price end as unit_price from a"""

QUANTITY_INPUT = f"select l_orderkey, l_linenumber, case when l_partkey % 3 = 0 then '1' when l_partkey % 3 = 1 then '' else cast(q as string) end as quantity, {cents('unit_c')} as unit_price, {cents('unit_c * q')} as net from ({inputs.LINES}) l"


def quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.run(spark, sf_dir, QUANTITY_INPUT)
    return rows.withColumn("quantity", numeric.fix_quantity(F.col("quantity"), F.col("unit_price"), F.col("net")))


QUANTITY = f"""
with a as (select *, case when quantity = '' then 1 else quantity::double end as q, unit_price::double as u, net::double as n from ({QUANTITY_INPUT}) x)
select l_orderkey, l_linenumber, unit_price, net, case when abs(q - 1) < 0.01 and abs(u - n) > 1 and u > 0 and abs(n / u - round_even(n / u, 0)) < 0.1 and round_even(n / u, 0) > 1 then round_even(n / u, 0)::bigint::varchar else quantity end as quantity from a"""


def normalized_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, inputs.DATES).select("o_orderkey", "raw", dates.normalize_date(F.col("raw")).alias("iso"))


DATES = f"""
select o_orderkey, raw, coalesce(strftime(try_strptime(raw, ['%Y-%m-%d', '%Y.%m.%d', '%Y. %m. %d.', '%Y. %m. %d', '%Y / %m / %d', '%Y/%m/%d', '%d.%m.%Y', '%d. %m. %Y.', '%d. %m. %Y', '%d/%m/%Y', '%d-%m-%Y', '%m/%d/%Y', '%Y%m%d']), '%Y-%m-%d'), raw) as iso
from ({inputs.DATES}) x"""

#: Texts with signs and codes of currencies added by id.
CURRENCY_INPUT = "select doc_id, concat(coalesce(text, ''), case cast(doc_id % 8 as int) when 0 then ' 10 Ft, 5 EUR' when 1 then ' € 5 £ 3 € 1' when 2 then ' 3 USD' when 3 then ' 99 czk 1 Kč' when 4 then ' zł zł PLN' when 5 then ' GBPS 7' when 6 then ' $1 and £1' else '' end) as text from {documents}"


def detected_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, CURRENCY_INPUT).select("doc_id", currency.detect_currency(F.col("text")).alias("currency"))


_hits = lambda word: f"len(regexp_extract_all(t, '(^|[^\\pL\\pN_]){word}($|[^\\pL\\pN_])'))"
DETECTED = f"""
with a as (select doc_id, replace(lower(text), ' ', '  ') as t from ({CURRENCY_INPUT}) x),
h as (select doc_id, [len(regexp_extract_all(t, '€')) + 2 * {_hits("eur")}, len(regexp_extract_all(t, '\\$')) + 2 * {_hits("usd")}, len(regexp_extract_all(t, '£')) + 2 * {_hits("gbp")},
  2 * {_hits("huf")} + 2 * {_hits("ft")}, {_hits("czk")} + {_hits("kč")}, {_hits("pln")} + {_hits("zł")}] as h from a)
select doc_id, case when list_max(h) = 0 then 'HUF' else ['EUR', 'USD', 'GBP', 'HUF', 'CZK', 'PLN'][list_position(h, list_max(h))] end as currency from h"""

NAME_INPUT = "select c_custkey, case cast(c_custkey % 9 as int) when 0 then 'Ft' when 1 then ' euro ' when 2 then '$' when 3 then 'pound' when 4 then 'chf' when 5 then ' chf' when 6 then 'HUF' when 7 then '' else '€' end as raw from {customer}"


def normalized_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, NAME_INPUT).select("c_custkey", "raw", currency.normalize_currency(F.col("raw")).alias("currency"))


NORMALIZED = f"""
select c_custkey, raw, case when lower(trim(raw)) in ('ft', 'huf', 'forint') then 'HUF' when lower(trim(raw)) in ('eur', '€', 'euro') then 'EUR' when lower(trim(raw)) in ('usd', '$', 'dollar') then 'USD'
  when lower(trim(raw)) in ('gbp', '£', 'pound') then 'GBP' else upper(raw) end as currency from ({NAME_INPUT}) x"""

BACKFILL_INPUT = "select l_orderkey, l_linenumber, l_partkey, case when l_orderkey % 3 = 0 then 'EUR' when l_orderkey % 3 = 1 then '' end as own, case when l_partkey % 5 = 0 then 'USD' when l_partkey % 5 = 1 then 'GBP' else '' end as c from {lineitem}"


def backfilled_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.run(spark, sf_dir, BACKFILL_INPUT)
    docs = rows.groupBy("l_orderkey").agg(F.max("own").alias("own"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("c").alias("currency")))).alias("items"))
    return docs.select("l_orderkey", currency.backfill_currency(F.col("own"), F.col("items")).alias("currency"))


BACKFILLED = f"select l_orderkey, coalesce(nullif(max(own), ''), arg_min(c, (l_linenumber, l_partkey)) filter (c <> ''), 'HUF') as currency from ({BACKFILL_INPUT}) x group by l_orderkey"


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select("doc_id", text.fold_accents(F.col("text")).alias("folded"))


FOLDED = f"select doc_id, translate(text, '{text.ACCENTED}', '{text.PLAIN}') as folded from {{documents}}"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = inputs.run(spark, sf_dir, "select p_partkey, concat(p_name, ' Óriás-', p_type, ' x1') as name from {part}")
    return names.select("p_partkey", F.array_join(text.name_tokens(text.nfkd_fold("name")), " ").alias("tokens"))


TOKENS = r"select p_partkey, array_to_string(list_filter(regexp_extract_all(lower(strip_accents(concat(p_name, ' Óriás-', p_type, ' x1'))), '[a-z0-9]+'), lambda x: length(x) >= 3), ' ') as tokens from {part}"

#: Texts with broken and glued numbers and noise lines added by id.
BROKEN_INPUT = "select doc_id, concat(coalesce(text, ''), chr(10), ' Page 3 of 9 ', chr(10), 'Copyright, total 5', chr(10), chr(10), case cast(doc_id % 4 as int) when 0 then 'sum 1 244,00 2 500 Ft' when 1 then '1236,00236,00' when 2 then 'see https://example.org' else 'Privacy Policy 2024-01-02' end) as text from {documents}"
BLANK = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, BROKEN_INPUT).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


CLEANED_TEXT = rf"""
with a as (select doc_id, regexp_replace(text, '(\p{{Nd}}){BLANK}+(\p{{Nd}}{{3}}[,.])', '\1\2', 'g') as t from ({BROKEN_INPUT}) x),
b as (select doc_id, regexp_replace(t, '(\p{{Nd}}){BLANK}+(\p{{Nd}}{{3}})($|\P{{Nd}})', '\1\2\3', 'g') as t from a),
c as (select doc_id, list_filter(list_transform(string_split(regexp_replace(t, '(\d+[,.]\d{{2}})(\d)', '\1 \2', 'g'), chr(10)), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> '') as l from b)
select doc_id, array_to_string(list_filter(l, lambda x: not regexp_matches(lower(x), '{text.NOISE}') or regexp_matches(x, '{text.KEPT}') or regexp_matches(lower(x), '{text.KEPT_LOWER}')), chr(10)) as cleaned from c"""


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", ">")).alias("line"))
    flags = lines.select("page_id", text.is_noise(F.col("line")).alias("n"), text.is_important(F.col("line")).alias("k"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return flags.groupBy("page_id").agg(F.count("*").alias("n_lines"), count(F.col("n"), "n_noise"), count(F.col("k"), "n_important"), count(~F.col("n") | F.col("k"), "n_kept"))


NOISE = f"""
with l as (select page_id, unnest(string_split(html, '>')) as line from {{pages}}),
f as (select page_id, regexp_matches(lower(line), '{text.NOISE}') as n, regexp_matches(line, '{text.KEPT}') or regexp_matches(lower(line), '{text.KEPT_LOWER}') as k from l)
select page_id, count(*) as n_lines, count(*) filter (n) as n_noise, count(*) filter (k) as n_important, count(*) filter (not n or k) as n_kept from f group by page_id"""

BARCODE_INPUT = "select p_partkey, substring(concat(cast(4744183012622 + p_partkey as string), '-', cast(p_partkey as string)), 1, cast(8 + p_partkey % 8 as int)) as code from {part}"


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, BARCODE_INPUT).select("p_partkey", "code", text.is_barcode(F.col("code")).alias("is_barcode"))


BARCODES = rf"select p_partkey, code, length(regexp_replace(code, '\D', '', 'g')) in (8, 12, 13, 14) as is_barcode from ({BARCODE_INPUT}) x"


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select("doc_id", numeric.estimated_seconds(F.col("n_chars")).alias("seconds"))


ESTIMATES = "select doc_id, round(75.00 + coalesce(n_chars, 0)::decimal(18, 2) * 0.03, 1)::double as seconds from {documents}"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of prompt for every document: texts are read and their currencies found once."""
    docs = inputs.run(spark, sf_dir, CURRENCY_INPUT).withColumn("found", currency.detect_currency(F.col("text")))
    each = [F.struct(F.lit(kind).alias("kind"), F.md5(extraction_prompt(F.col("text"), kind, F.col("found"))).alias("prompt_md5")) for kind in ("metadata", "items", "full")]
    return docs.select("doc_id", F.inline(F.array(*each)))


def _prompt_sql(kind: str) -> str:
    before, answer, chars = prompt_frame(kind)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    body = f"text[:{chars}]" if chars else "text"
    return f"select doc_id, '{kind}' as kind, md5(concat({quote(before)}, replace({quote(answer)}, '%s', currency), {quote(chr(10) * 2 + 'Document:' + chr(10))}, {body}, {quote(chr(10) * 2 + 'JSON:')})) as prompt_md5 from p"


PROMPTS = f"with p as (select doc_id, text, currency from ({CURRENCY_INPUT}) x join ({DETECTED}) d using (doc_id)) " + " union all ".join(map(_prompt_sql, ("metadata", "items", "full")))

UPLOAD_INPUT = "select o_orderkey, concat('/in/', case cast(o_orderkey % 5 as int) when 0 then 'a.pdf' when 1 then 'B.PDF' when 2 then 'c.png' when 3 then '' else 'd.pdf' end) as path, cast(round(o_totalprice) as bigint) * 200 as length from {orders}"


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, UPLOAD_INPUT).select("o_orderkey", "path", "length", rejection(F.col("path"), F.col("length")).alias("reason"))


UPLOADS = f"select o_orderkey, path, length, case when path like '%/' then 'no name' when lower(path) not like '%.pdf' then 'not a pdf' when length > {MAX_BYTES} then 'too large' end as reason from ({UPLOAD_INPUT}) x"

QUERIES = {
    "invoice_totals": totals, "numeric_clean": cleaned_numbers, "net_gross_swap": net_gross, "unit_price_fix": unit_price, "quantity_fix": quantity, "date_normalize": normalized_dates,
    "currency_detect": detected_currency, "currency_normalize": normalized_currency, "currency_backfill": backfilled_currency, "accent_fold": folded, "name_tokens": tokens, "clean_text_lines": cleaned_text,
    "noise_filter": noise, "barcode_flags": barcodes, "estimate_time": estimates, "prompt_build": prompts, "upload_rejections": upload_checks,
}
ORACLES = {
    "invoice_totals": TOTALS, "numeric_clean": CLEANED, "net_gross_swap": NET_GROSS, "unit_price_fix": UNIT, "quantity_fix": QUANTITY, "date_normalize": DATES,
    "currency_detect": DETECTED, "currency_normalize": NORMALIZED, "currency_backfill": BACKFILLED, "accent_fold": FOLDED, "name_tokens": TOKENS, "clean_text_lines": CLEANED_TEXT,
    "noise_filter": NOISE, "barcode_flags": BARCODES, "estimate_time": ESTIMATES, "prompt_build": PROMPTS, "upload_rejections": UPLOADS,
}
