"""BPE encoding and decoding with forced-boundary splitting.

Merges only ever build vocabulary tokens. So two neighbouring bytes that stand next to each other inside no token can
never be merged over: the place between them is a certain cut. Every pre-token is cut there, its fragments are encoded
on their own (and cached, as far fewer fragments than words differ), and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docpipe.llm import spans, tokens
from docpipe.llm.common import bounded_batches, slices, text_or_empty


class ForcedBoundaryBPE:
    """A byte-level BPE model with word ends (lower-casing normalizer, white space dropped), read from its JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        model = tokens.read_model(path)
        self.suffix = model["model"].get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.specials = [x["content"] for x in model["added_tokens"]]
        merges = list(map(tuple, model["model"]["merges"]))
        self.inner = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0)
        self.last = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0, end_of_word_suffix=self.suffix or None)
        self.joined = self._pairs_inside_tokens()
        tokens.read_model.cache_clear()
        self.encode_fragment = lru_cache(30_000)(self._merge)
        self.pieces = tokens.PieceCache(lambda pieces: [self.encode_piece(piece) for piece in pieces])
        n = max([*self.vocab.values(), *(x["id"] for x in model["added_tokens"])]) + 1
        self.texts = [""] * n
        for token, i in self.vocab.items():
            self.texts[i] = token
        for x in model["added_tokens"]:
            self.texts[x["id"]] = x["content"]

    def _units(self, token: str) -> list[str]:
        """The symbols merges start from: single letters, the last with the word end."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _pairs_inside_tokens(self) -> set[tuple[str, str]]:
        return {pair for token in self.vocab for units in [self._units(token)] for pair in zip(units, units[1:], strict=False)}

    def fragments(self, piece: str) -> list[str]:
        """The pre-token's letters, cut wherever a pair occurs inside no vocabulary token."""
        letters = tokens.letters_of(piece)
        units = [*letters[:-1], letters[-1] + self.suffix]
        cuts = [0, *(i for i, pair in enumerate(zip(units, units[1:], strict=False), 1) if pair not in self.joined), len(units)]
        return [letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merge(self, fragment: str, last: bool) -> list[int]:
        """The merges within one fragment; only a pre-token's last fragment takes the word end."""
        return [x.id for x in (self.last if last else self.inner).tokenize(fragment)]

    def encode_piece(self, piece: str) -> list[int]:
        *inner, last = self.fragments(piece)
        return [*(i for fragment in inner for i in self.encode_fragment(fragment, False)), *self.encode_fragment(last, True)]

    def normalize(self, text: str) -> str:
        """NFC, runs of white space to one space, lower case; texts past Latin letters go through the library's own."""
        if text.isascii() or max(text) < "ɐ":
            return text.lower() if "İ" not in text else self.whole.normalizer.normalize_str(text)
        return self.whole.normalizer.normalize_str(text)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids."""
        special = [i for i, text in enumerate(texts) if any(s in text for s in self.specials)]
        normal = ["" if i in special else self.normalize(text) for i, text in enumerate(texts)] if special else [self.normalize(t) for t in texts]
        codes, offsets = spans.code_points(normal)
        starts, ends = tokens.bare_pieces(codes, offsets)
        ids, counts = self.pieces.ids(codes, starts, ends, normal)
        total = np.concatenate([[0], np.cumsum(counts)])
        bounds = total[np.searchsorted(starts, offsets)]
        for i, text in enumerate(texts):
            yield self._with_specials(text) if i in special else ids[bounds[i] : bounds[i + 1]]

    def _with_specials(self, text: str) -> np.ndarray:
        """Special tokens found in the text are ids of their own; what stands between them is encoded as other text."""
        out, rest = [], text
        while rest:
            found = min(((at, -len(s), s) for s in self.specials if (at := rest.find(s)) >= 0), default=None)
            before = rest if found is None else rest[: found[0]]
            out += [x for ids in self.encode([before]) for x in ids.tolist()] if before else []
            if found is None:
                break
            out.append(self.whole.token_to_id(found[2]))
            rest = rest[found[0] + len(found[2]) :]
        return np.array(out, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the file, tokens are joined by single spaces, as they stand in the vocabulary."""
        return " ".join(map(self.texts.__getitem__, ids.tolist()))


@cache
def model(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_decode(docs: DataFrame, tokenizer: str, keep_ids: bool = True) -> DataFrame:
    """Adds to each row of doc_id and text: token_ids (if keep_ids), decoded (if keep_ids), n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty; an empty text has no ids and decodes to "". Repeated rows stay repeated; other columns
    of `docs` are dropped, so their names can't clash. One narrow pass: no shuffle, texts of any length.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * keep_ids

    def run(batches):
        bpe = model(tokenizer)
        for batch, texts in slices(batches, "text", 1_000_000):
            rows: list[list] = [[], [], [], [], []]
            for ids in bpe.encode(texts):
                text = bpe.decode(ids)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                rows[2].append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if keep_ids:
                    rows[3].append(ids.astype(np.int32))
                    rows[4].append(text)
            columns = [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            if keep_ids:
                columns += [pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def token_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and token_ids of each row; see encode_decode for nulls, repeats and other columns."""
    return encode_decode(docs, tokenizer).select("doc_id", "token_ids")


def decode_rows(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text for rows of doc_id and token_ids.

    Null or empty ids decode to empty text; repeated rows repeat; empty tables give no rows; other columns are not read.
    """

    def run(batches):
        bpe = model(tokenizer)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
