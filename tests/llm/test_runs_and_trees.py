"""Replayed merges against the library, periodic runs against all lags, manifests against SQL and plain recursion."""

from __future__ import annotations

import hashlib
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docpipe.llm import merkle, periodic, replay
from docpipe.llm.queries import BYTE_RANKS, queries
from tests.llm import brute

RANKS = public_tokenizers.path(BYTE_RANKS)
Q = queries()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=replay.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def odd(n: int, alphabet: str, longest: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_op11(spark, sf, docs, library):
    got = {r["doc_id"]: r for r in Q["op11_merge_replay"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[doc_id]["n_tokens"], got[doc_id]["ids_sha256"], got[doc_id]["decoded_sha256"]) == (len(ids), brute.sha(data), brute.sha(text or ""))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz", "aàéあ漢字한글дж\U0001f600 \t\n\x1c\x85\xa0'sStTdlLmrRevV.!?019²½", " \n\t\xa0x"])
def test_replay_like_the_library(library, alphabet):
    texts = odd(400, alphabet, 300, len(alphabet))
    mine = replay.model(RANKS)
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_replay_of_long_words(library):
    texts = ["a" * 30_000, "ab" * 30_000, " " * 20_000, "\n" * 9_999 + "x", "é" * 20_000, "漢" * 9_000]
    for text, ids in zip(texts, replay.model(RANKS).encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_replay_where_ranks_fall():
    """Vocabularies in which a merge makes a pair of a smaller rank: each word is merged as it would be alone."""
    for seed in range(60):
        rng = random.Random(seed)
        ranks = {bytes([b]): b for b in range(256)}
        more = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)})
        ranks |= {token: 256 + i for i, token in enumerate(more)}
        mine = replay.MergeReplay(ranks)
        theirs = tiktoken.Encoding(f"s{seed}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = odd(60, "abc", 40, seed) + odd(5, "abc", 400, seed)
        assert [x.tolist() for x in mine.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_replay_edges(spark, library):
    rows = [(1, "Hello, wörld!  x"), (2, None), (3, ""), (None, "no id"), (4, "a b"), (4, "a b"), (5, "x" * 5000 + " " * 5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"token_ids": F.lit("clash"), "decoded": F.lit(1), "n_tokens": F.lit(None).cast("string")})
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["token_ids"], bytes(r["decoded"])) for r in replay.encode_decode(table, RANKS).collect()), key=str)
    assert got == sorted(((i is None, i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert replay.encode_decode(table.limit(0), RANKS).count() == 0


def all_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """start, length, smallest period by trying every lag at every place."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def rewritten(words: list[str], doc_id: int) -> list[str]:
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(words: list[str]) -> tuple:
    runs = all_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    first = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *first, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12(spark, sf, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q["op12_periodic"](spark, sf).collect()}
    assert len(got) == len(docs)
    looped = 0
    for doc_id, text in docs:
        words = "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ")
        words = rewritten([w for w in words if w], doc_id)
        if len(words) < 3000:
            assert got[doc_id] == expected(words), doc_id
            looped += got[doc_id][0] > 0
    assert looped > 10


def test_periodic_like_all_lags():
    rng = random.Random(5)
    for _ in range(25):
        texts = []
        for _ in range(rng.randint(1, 15)):
            k, n = rng.choice([1, 2, 3, 50, 1000]), rng.choice([0, 1, 11, 12, 13, 30, 100, 400, 800])
            words = [str(rng.randrange(k)) for _ in range(n)]
            for _ in range(rng.randrange(4) if words else 0):
                a, p = rng.randrange(len(words)), rng.randrange(1, 1 + max(1, len(words) // 3))
                words = (words[:a] + words[a : a + p] * rng.randrange(1, 8) + words[a + p * rng.randrange(2) :])[:1500]
            texts.append(words)
        texts += texts[:2]
        assert periodic.of_texts(texts) == [all_runs(words) for words in texts]


def test_periodic_special_words():
    short, long = ["a"], ["a", "b"]
    while len(long) < 1200:
        short, long = long, long + short
    phrase = ["x", "y"] * 150 + ["z"]
    for words in (long, ["a"] * 1000, ["x"] * 400 + ["y"] + ["x"] * 400, phrase * 3, ["q", *phrase * 3, "r"], [str(i) for i in range(300)] * 3):
        assert periodic.of_texts([words]) == [all_runs(words)]


def test_long_texts_of_repeats():
    """Texts of a hundred thousand words end in time."""
    word = [str(i % 4999) for i in range(100_000)]
    assert periodic.of_texts([["a"] * 100_000, word, ["b", *["a"] * 30_000, "c"]]) == [[(0, 100_000, 1)], [(0, 100_000, 4999)], [(1, 30_000, 1)]]


def test_periodic_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\v\f\r "), (4, "é\xa0é " * 12), (4, "é\xa0é " * 12), (None, "a " * 40), (5, "a b c"), (6, "one two " * 7 + "end")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("clash"), "runs": F.lit(0), "period": F.lit(None).cast("string")})
    got = sorted(((r["doc_id"], r["n_runs"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in periodic.periodic(table).collect()), key=str)
    want = [(1, 0, "", []), (2, 0, "", []), (3, 0, "", []), *[(4, 1, "é\xa0é", [(0, 12, 1)])] * 2, (None, 1, "a", [(0, 40, 1)]), (5, 0, "a b c", []), (6, 1, "one two end", [(0, 14, 2)])]
    assert got == sorted(want, key=str)
    assert periodic.periodic(table.limit(0)).count() == 0


def enc(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves: list[str], fanout: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root and each leaf's siblings, level by level."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, path in enumerate(paths):
            begin = at[i] // fanout * fanout
            path.append((level[begin : at[i]], level[at[i] + 1 : begin + fanout]))
            at[i] //= fanout
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def proofs_of(rows: list[tuple], fanout: int) -> list[tuple]:
    """Plain restatement; rows: doc_id, source, lang, n_chars, text."""
    keyed = [(r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, h(*map(enc, r)), r) for r in rows]
    groups: dict = {}
    for key in sorted(keyed, key=lambda x: x[:5]):
        groups.setdefault(key[:2], []).append(key)
    trees = [tree_of([k[4] for k in held], fanout) for held in groups.values()]
    root, top_paths = tree_of([t[0] for t in trees], fanout) if trees else ("", [])
    out = []
    for held, (subroot, paths), above in zip(groups.values(), trees, top_paths, strict=True):
        for key, path in zip(held, paths, strict=True):
            row = key[5]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            small = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if changed else row[4]
            leaf = h(*map(enc, (*row[:4], small)))
            for left, right in path + above:
                leaf = h(*left, leaf, *right)
            out.append((row[0], key[4], subroot, root, h(*(x for left, right in path + above for x in left + right)), leaf, leaf == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("n", "piece", "fanout"), [(0, 10, 8), (1, 10, 8), (9, 3, 8), (64, 7, 8), (65, 9, 8), (300, 11, 8), (200, 13, 3), (100, 10_000, 2)])
def test_manifest(spark, n, piece, fanout):
    """Pieces of any alignment, groups of one row, null and clashing values, repeated rows and ids."""
    rng = random.Random(n)
    langs = ["en", "en", "en", "de", None, "ñ", "z"]
    rows = [(rng.choice([i, i, i, None, 7]), rng.choice(["web", None]), rng.choice(langs), i, rng.choice(["Some Text", "small", "", None, "ÀB"])) for i in range(n)]
    rows += rows[: n // 5] * 2
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"leaf": F.lit("clash"), "part": F.lit(0), "g": F.lit(1), "order": F.lit(None).cast("string")})
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    where = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    made = merkle.manifest(table, claim={"text": small}, where=where, fanout=fanout, piece=piece)
    got, want = sorted(map(tuple, made.proofs().collect()), key=str), sorted(proofs_of(rows, fanout), key=str)
    assert got == want
    assert {r["root"] for r in made.root().collect()} == {r[3] for r in want}
    assert {r["subroot"] for r in made.subroots().collect()} == {r[2] for r in want}


def test_manifest_nodes(spark):
    """Every inner node is recorded once, whichever piece or merge made it."""
    rows = [(i, "s", "en", i, f"t{i}") for i in range(100)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), piece=9)
    leaves = [h(*map(enc, r)) for r in rows]
    want, level = set(), 0
    while len(leaves) > 1:
        level, leaves = level + 1, [h(*leaves[i : i + 8]) for i in range(0, len(leaves), 8)]
        want |= {("en", level, i, x) for i, x in enumerate(leaves)}
    got = [tuple(r) for r in made.nodes().collect()]
    assert len(got) == len(want) and set(got) == want


def test_many_groups(spark):
    """More groups than a block holds: their tops make a tree of two levels."""
    rows = [(i, None, f"l{i % 70:03}", 1, "A") for i in range(90)]
    got = sorted(map(tuple, merkle.report(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == sorted(proofs_of(rows, 8))


def test_op13_columns(spark, sf):
    assert Q["op13_merkle"](spark, sf).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
