"""The pipeline's five stages in a row, against a plain restatement of them."""

from __future__ import annotations

import threading

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docpipe.llm import mil, pii
from tests.llm import brute


def redacted(text: str, trees) -> str:
    spans = brute.pii(text)
    spans = sorted([*spans, *pii.added_spans(text, pii.base_spans(text), trees)], key=lambda s: (s[0], -s[1]))
    out, at, i = "", 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out, at, i = out + text[at:start] + f"[{kind.upper()}]", end, i + 1
    return out + text[at:]


def test_pipeline_like_its_stages(spark, sf, tmp_path):
    docs, labels, items = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels", "benchmark"))
    first = docs.where("text is not null").orderBy("doc_id").first()
    more = [(10**6, f"{first['text']} phone +49 30 1234567 2024-01-02 10"), (10**6 + 1, "Contact a.b@example.org, card 4111111111111111 12 items")]
    extra = spark.createDataFrame([(i, t, first["lang"], first["source"], len(t)) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"file://{tmp_path}"
    docs.unionByName(extra.select([extra[f.name].cast(f.dataType) for f in docs.schema])).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    bad = {r["doc_id"] for r in mil.quality(docs, labels).collect() if r["predicted"] == 0}
    good = [r for r in rows if r[0] not in bad]
    of = brute.classes(good)
    alone = [r for r in good if of[r[0]] == r[0]]
    found = {r[0] for r in brute.contained(alone, [(r["item_id"], r["text"]) for r in items.collect()])}
    clean = [r for r in alone if r[0] not in found]
    held = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    trees = pii.fitted(spark.createDataFrame(clean, "doc_id long, text string"))  # as the stage does, on what it was given
    want, changed = {}, 0
    for doc_id, text in clean:
        safe = redacted(text, trees)
        changed += safe != text
        ids = held.encode(safe, add_special_tokens=False).ids
        want[doc_id] = (len(ids), ids, held.decode(ids, skip_special_tokens=False))
    assert len(rows) > len(good) > len(alone) > len(clean) > changed > 0
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n_tokens"], r["token_ids"], r["decoded"]) for r in got} == want


def test_pipeline_on_edges(spark, tmp_path):
    """Nulls, empty texts, repeated rows, ids that repeat or lack, columns that clash; and empty tables."""
    from pyspark.sql import functions as F

    rows = [(1, "a fine text of some words that nobody else has"), (1, "a fine text of some words that nobody else has"), (2, None), (3, ""), (None, "no id here but words enough to stand alone"), (4, "mail me at a.b@example.org today please and thanks"), (4, "another text with the same id and its own words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("z") for n in ("lang", "source", "__md5", "node", "label", "score")}).withColumn("n_chars", F.length("text").cast("long"))
    tables = {"documents": docs, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "a benchmark item that is found in no document at all")], "item_id long, text string")}
    for name, df in tables.items():
        df.write.parquet(f"file://{tmp_path}/some/{name}.parquet")
        df.limit(0).write.parquet(f"file://{tmp_path}/none/{name}.parquet")
    got = sorted((r["doc_id"] or 0, r["n_tokens"] > 0, "[email]" in r["decoded"].replace(" ", "").replace("</w>", "")) for r in corpus_pipeline.run(spark, f"file://{tmp_path}/some").collect())
    assert got == [(0, True, False), (1, True, False), (2, False, False), (4, True, False), (4, True, True)]
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline_leaves_only_its_result(spark, sf):
    from docpipe.llm import common

    before = common.made()
    rows = corpus_pipeline.run(spark, sf)
    assert common.made() == before + 1 and rows.count() > 0


def test_two_pipelines_at_a_time(spark, sf):
    """Each deletes only what it made itself, so both give the same rows."""
    rows: dict[int, list] = {}

    def run(number: int) -> None:
        rows[number] = sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())

    threads = [threading.Thread(target=run, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows[0] and rows[0] == rows[1]
