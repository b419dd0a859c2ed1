"""Queries of page layout over words with places."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.functions.text import ACCENTED, PLAIN
from docpipe.operators import layout
from docpipe.plans import inputs
from docpipe.sources import images, plugins, upload_source
from docpipe.sources.places import shared_folder
from docpipe.sources.png import PngCodec, PngPages


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.run(spark, sf_dir, inputs.WORDS)


fold = lambda c: f"translate({c}, '{ACCENTED}', '{PLAIN}')"
W = f"w as ({inputs.WORDS_DUCK})"


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plain_text(words(spark, sf_dir))


PLAIN_TEXT = f"with {W}, l as (select doc_id, page_no, line_no, string_agg(value, ' ' order by word_no) as line from w group by all) select doc_id, page_no, {fold('string_agg(line, chr(10) order by line_no)')} as text from l group by all"


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.anchored_lines(words(spark, sf_dir)).select("doc_id", "page_no", "word_no", "anchored_line")


def _anchored(keys: str, tolerance: float, source: str) -> str:
    """CTEs numbered, fold and anchored: a fold over each page's words in order, one word a step, by recursion."""
    same = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    joins = f"abs(t.y - f.anchor) < {tolerance}::double"
    return f"""numbered as materialized (select *, row_number() over (partition by {keys} order by y, x, block_no, line_no, word_no) as n from {source}),
fold as (select {keys}, n, y as anchor, 0 as line from numbered where n = 1 union all
  select {", ".join(f"t.{k}" for k in keys.split(", "))}, t.n, case when {joins} then f.anchor else t.y end, case when {joins} then f.line else f.line + 1 end from fold f join numbered t on {same("t", "f")} and t.n = f.n + 1),
anchored as (select t.*, f.line::int as anchored_line from numbered t join fold f on {same("t", "f")} and t.n = f.n)"""


ANCHORED = _anchored("doc_id, page_no", layout.LINE_TOLERANCE, "w")
GROUPED = f"with recursive {W}, {ANCHORED} select doc_id, page_no, word_no, anchored_line from anchored"


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spaced_lines(words(spark, sf_dir))


def _spaced(keys: str, source: str) -> str:
    return f"""gapped as (select *, x - lag(x) over (partition by {keys}, anchored_line order by x, word_no) as gap from {source}),
spaced as (select {keys}, anchored_line, string_agg(case when gap > 0.03::double then '  ' else '' end || value, ' ' order by x, word_no) as text from gapped group by all)"""


SPACED = f"with recursive {W}, {ANCHORED}, {_spaced('doc_id, page_no', 'anchored')} select * from spaced"


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.structured_text(words(spark, sf_dir)).select("doc_id", "page_no", "text")


STRUCTURED = f"with recursive {W}, {ANCHORED}, {_spaced('doc_id, page_no', 'anchored')} select doc_id, page_no, {fold('string_agg(text, chr(10) order by anchored_line)')} as text from spaced where trim(text) <> '' group by all"


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_split(words(spark, sf_dir))


COLUMNS = f"""with {W}, s as (select doc_id, list(x order by x) as a from w group by doc_id),
g as (select doc_id, len(a) as n_words, a, list_transform(range(len(a) // 4, 3 * len(a) // 4), lambda i: coalesce(a[i + 2] - a[i + 1], 0)) as gaps from s)
select doc_id, n_words, case when n_words >= 10 and list_max(gaps) > 0.15::double then (a[n_words // 4 + list_position(gaps, list_max(gaps))] + a[n_words // 4 + list_position(gaps, list_max(gaps)) + 1]) / 2 end as split_x from g"""


def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.two_column_text(words(spark, sf_dir))


TWO = f"""with recursive c as ({COLUMNS}), {W},
sided as (select w.*, case when x < split_x then 0 else 1 end as side from w join c using (doc_id) where split_x is not null),
{_anchored('doc_id, page_no, side', layout.COLUMN_LINE_TOLERANCE, 'sided')}, {_spaced('doc_id, page_no, side', 'anchored')},
sides as (select doc_id, page_no, side, string_agg(text, chr(10) order by anchored_line) as t from spaced group by all)
select doc_id, page_no, {fold("concat('=== LEFT COLUMN ===', chr(10), coalesce(max(t) filter (side = 0), ''), chr(10), chr(10), '=== RIGHT COLUMN ===', chr(10), coalesce(max(t) filter (side = 1), ''))")} as text from sides group by all"""


def rows_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_rows(inputs.run(spark, sf_dir, inputs.TABLE_LINES))


_count = lambda pattern: f"len(regexp_extract_all(line, '{pattern}'))"
_case = lambda pattern: pattern.replace("(?iu)", "(?i)")
#: Which lines go on with the name of a row above is told by joining each line with the two before and after it.
TABLE_ROWS = rf"""
with m as (select *, row_number() over (partition by doc_id order by line_no) as n, {_count(layout.PRICE)} as prices, {_count(layout.WORD)} as words, trim(line) = '' as blank from ({inputs.TABLE_LINES}) x),
f as materialized (select *, prices >= 3 and words > 0 as is_row, not blank and prices = 0 and words > 0 and not regexp_matches(line, '{_case(layout.NO_CONTINUATION)}') as more, regexp_matches(line, '{_case(layout.TABLE_HEADER)}') and not (prices >= 3 and words = 0) as head from m),
j as (select f.doc_id, f.line_no, f.line, f.is_row, f.head, f.more and (coalesce(p1.is_row, false) or coalesce(p2.is_row and p1.more, false)) as taken,
  concat(f.line, case when n1.more then ' ' || trim(n1.line) else '' end, case when n2.more and (n1.more or n1.blank) then ' ' || trim(n2.line) else '' end) as whole
  from f left join f n1 on n1.doc_id = f.doc_id and n1.n = f.n + 1 left join f n2 on n2.doc_id = f.doc_id and n2.n = f.n + 2 left join f p1 on p1.doc_id = f.doc_id and p1.n = f.n - 1 left join f p2 on p2.doc_id = f.doc_id and p2.n = f.n - 2),
k as (select *, is_row or head and not taken as kept, count(*) filter (is_row or head and not taken) over (partition by doc_id) as n_kept from j)
select doc_id, line_no, case when n_kept >= 2 and is_row then whole else line end as line from k where n_kept < 2 or kept"""


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.mean_confidence(words(spark, sf_dir)).select("doc_id", F.round("confidence", 6).alias("confidence"))


CONFIDENCE = f"with {W} select doc_id, round(avg(confidence) * 100, 6) as confidence from w group by doc_id"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.document_text(layout.plain_text(words(spark, sf_dir)), "text")


DOCUMENTS = f"select doc_id, string_agg(text, chr(10) || chr(10) order by page_no) as text from ({PLAIN_TEXT}) x group by doc_id"


def recognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of text through the stand-in page reader and recogniser: words and lines of every page."""
    files = inputs.run(spark, sf_dir, "select cast(doc_id as string) as path, cast(text as binary) as content from {documents} where text is not null")
    found = plugins.recognized_words(plugins.page_images(files, plugins.TextPages), plugins.TextWords)
    return found.groupBy("doc_id", "page_no").agg(F.count("value").alias("n_words"), F.countDistinct("line_no").alias("n_lines"), F.count("error").alias("n_errors"))


RECOGNIZED = r"""
with l as (select doc_id::varchar as doc_id, unnest(string_split(text, chr(10))) as line from {documents} where text is not null),
n as (select doc_id, len(list_filter(regexp_split_to_array(line, '[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) as n from l)
select doc_id, 0 as page_no, sum(n)::bigint as n_words, count(*) filter (n > 0) as n_lines, 0::bigint as n_errors from n group by doc_id having sum(n) > 0"""

#: Documents in a file.
IN_FILE = 100


def written_files(docs: DataFrame, uri: str) -> int:
    """Writes documents, by IN_FILE to a file with a form feed between, and returns the number of files; a retried task writes
    the same bytes again."""

    def write(batches):
        system, base = pafs.FileSystem.from_uri(uri)
        system.create_dir(base, recursive=True)
        name, stream = None, None
        for batch in batches:
            for number, text in zip(batch.column("file_no").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if number != name:
                    if stream:
                        stream.close()
                    name, stream = number, system.open_output_stream(f"{base}/{number}.pdf", compression=None)
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], ["file_no"])
                else:
                    stream.write(b"\f")
                stream.write(text.encode())
        if stream:
            stream.close()

    numbered = docs.select((F.floor(F.col("doc_id") / IN_FILE)).alias("file_no"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return numbered.repartition("file_no").sortWithinPartitions("file_no", "doc_id").drop("doc_id").mapInArrow(write, "file_no long").count()


def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files and read back as pages, long files in parts."""
    folder = shared_folder(spark, "uploads")
    written_files(inputs.table(spark, sf_dir, "documents"), folder)
    spark.dataSource.register(upload_source.UploadPages)
    pages = spark.read.format("uploads").option("reader", "docpipe.sources.plugins:TextPages").option("splitBytes", 256 << 10).load(folder)
    number = F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long")
    return pages.select(number.alias("file_no"), "page_no", F.length("image").cast("long").alias("n_bytes"), F.md5("image").alias("digest"), "error")


READ_FILES = "select doc_id // 100 as file_no, (row_number() over (partition by doc_id // 100 order by doc_id) - 1)::int as page_no, strlen(coalesce(text, ''))::bigint as n_bytes, md5(coalesce(text, '')) as digest, null::varchar as error from {documents}"

def drawn(ids: DataFrame) -> DataFrame:
    """path and content: an image of one colour for each doc_id, gray or coloured, with and without alpha."""

    def draw(batches):
        codec = PngCodec()
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            made = [codec.png(np.tile(np.array([i % 251, (i * 7) % 251, (i * 13) % 251, 200], np.uint8)[: i % 4 + 1], (15 + i % 31, 20 + i % 47, 1))) for i in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(map(str, numbers)), pa.array(made, pa.binary())], ["path", "content"])

    return ids.mapInArrow(draw, "path string, content binary")


def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and colours of drawn pages after both image steps."""
    ids = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"))
    files = drawn(ids.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id"))  # a few bytes of input each, but work

    def measured(batches):
        codec = PngCodec()
        for batch in batches:
            rows = []
            for path, large, small in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "image", "vision")), strict=True):
                image, seen = codec.open(large), codec.open(base64.b64decode(small))
                rows.append((int(path), image.shape[1], image.shape[0], *(int(x) for x in image[0, 0]), len(np.unique(image.reshape(-1, 3) @ np.array([1 << 16, 1 << 8, 1]))), seen.shape[1], seen.shape[0], seen.shape[2]))
            names = ("doc_id", "width", "height", "red", "green", "blue", "n_colours", "vision_width", "vision_height", "vision_channels")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "doc_id" else pa.int32()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], list(names))

    pages = images.prepared_pages(plugins.page_images(files, PngPages), PngCodec).select("doc_id", "image")
    vision = images.vision_images(files, PngPages, PngCodec, longest=40).select("doc_id", F.col("image").alias("vision"))
    return pages.join(vision, "doc_id").mapInArrow(measured, "doc_id long, width int, height int, red int, green int, blue int, n_colours int, vision_width int, vision_height int, vision_channels int")


PICTURES = """
with s as (select doc_id::bigint as doc_id, 20 + doc_id % 47 as w, 15 + doc_id % 31 as h, (doc_id % 251)::int as r, (doc_id * 7 % 251)::int as g, (doc_id * 13 % 251)::int as b, doc_id % 4 + 1 as c from {documents}),
v as (select *, least(40::double / w, 40::double / h) as ratio from s)
select doc_id, floor(w * 1.5)::int as width, floor(h * 1.5)::int as height, r as red, case when c < 3 then r else g end as green, case when c < 3 then r else b end as blue, 1::int as n_colours,
  (case when ratio < 1 then floor(w * ratio) else w end)::int as vision_width, (case when ratio < 1 then floor(h * ratio) else h end)::int as vision_height, c::int as vision_channels from v"""

QUERIES = {
    "plain_text": plain, "line_group": grouped, "gap_spacing": spaced, "structured_text": structured, "column_detect": columns, "two_column": two_columns, "table_rows": rows_of_tables,
    "confidence": confidence, "document_text": documents, "recognized_words": recognized, "upload_pages": read_files, "page_pictures": page_pictures,
}
ORACLES = {
    "plain_text": PLAIN_TEXT, "line_group": GROUPED, "gap_spacing": SPACED, "structured_text": STRUCTURED, "column_detect": COLUMNS, "two_column": TWO, "table_rows": TABLE_ROWS,
    "confidence": CONFIDENCE, "document_text": DOCUMENTS, "recognized_words": RECOGNIZED, "upload_pages": READ_FILES, "page_pictures": PICTURES,
}
