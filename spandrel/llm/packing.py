"""Best-fit packing of token sequences by vector best-fit.

Texts are tokenised whole; a document longer than a sequence is cut, so that only its first piece is shorter. Pieces
that fill a sequence stand alone. The others are dealt evenly to shards of bounded size and packed there in falling
order of length: a piece goes to an open sequence with room for it in every capacity (tokens, documents, attention
cost as the sum of squared lengths), chosen by the weighted norm of what would be left, or by the weighted dot product
of need and room. A shard leaves a few sequences unfilled at most, so with thousands of pieces a shard the loss
against one global packing is far below a thousandth. What a sequence has left of each capacity comes with its pieces.

Defined results: a null or empty text is one piece of its end id; repeated rows are packed each; other columns are not
read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import staged

#: Fixed value: the published pattern that cuts texts before byte-level merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that one shard packs.
SHARD = 20_000


class Tokeniser:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, those of the tokenizers library.

    The library's byte-level BPE takes the best-ranked of neighbouring pairs, tiktoken the best-ranked of neighbours'
    joint strings. Where every token's own characters merge to that token, no other pair can ever make it, so both give
    equal ids; tiktoken needs a third of the time. Texts that name an added token, and tokenizer files of other kinds,
    go to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [x["content"] for x in told["added_tokens"]]
        self.merging = self.same_by_rank(told)

    def same_by_rank(self, told: dict) -> tiktoken.Encoding | None:
        """The vocabulary as ranks, if the file describes plain byte-level BPE whose ids are in the order of merging."""
        model, cut = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if not plain or not level or told["normalizer"] is not None:
            return None
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if len(model["vocab"]) != 256 + len(made) or made != sorted(set(made)) or made[0] != 256:
            return None
        as_byte = {c: b for b, c in byte_signs().items()}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in model["vocab"].items()}
        return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.merging is None or any(x in text for x in self.added):
            return self.whole(text)
        return np.array(self.merging.encode_ordinary(text), "<u4").tobytes()


def byte_signs() -> dict[int, str]:
    """The printable character that stands for each byte in such a vocabulary: itself, or the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(2)
def tokeniser(path: str) -> Tokeniser:
    return Tokeniser(path)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `size` tokens but the first, which takes the rest."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's tokens with the end id."""
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokeniser(tokenizer_path)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                ids = t.ids(text.as_py() or "") + end
                rows += [(i, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, size))]
            table = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, k]) for k in (2, 3, 4))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


#: Columns with what a sequence has left.
LEFT = ("tokens_left", "documents_left", "attention_left")


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence, weights of the three, and the rule that chooses among sequences with room. Texts are cut
    into pieces of `piece` tokens (all of a sequence, if none is given)."""

    tokens: int = 2048
    documents: int = 2048
    attention: float = 2048.0**2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"
    piece: int | None = None

    @property
    def cut(self) -> int:
        return min(self.piece or self.tokens, self.tokens)

    def left(self, bins: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        """What each piece's sequence has left of every capacity."""
        used = [np.bincount(bins, x) for x in (lengths, np.ones(len(lengths)), lengths.astype(float) ** 2)]
        whole = (self.tokens, self.documents, self.attention)
        return {name: (limit - u)[bins] for name, limit, u in zip(LEFT, whole, used, strict=True)}


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. Falling order; of sequences with room in every capacity the one with the smallest
    weighted norm of what is left ("norm") or the largest weighted dot product of need and room ("dot")."""
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1) / limits
    weights = np.array(capacity.weights)
    if (need > 1 + 1e-12).any():
        raise ValueError("a piece exceeds a capacity of an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    least = need[order[-1]] if len(order) else np.zeros(3)
    room = np.ones((max(1, len(lengths)), 3))
    used = np.zeros(max(1, len(lengths)), np.int64)
    open_ = np.zeros(0, np.int64)  # sequences that the smallest piece still fits
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for count, i in enumerate(order):
        left = room[open_]
        fits = (left >= need[i] - 1e-12).all(axis=1)
        if fits.any():
            at = np.flatnonzero(fits)
            score = (((left[at] - need[i]) ** 2) @ weights) if capacity.rule == "norm" else -(left[at] @ (weights * need[i]))
            b = open_[at[int(score.argmin())]]
        else:
            b, n = n, n + 1
            open_ = np.append(open_, b)
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
        room[b] -= need[i]
        if not (room[b] >= least - 1e-12).all() or count % 512 == 511:
            open_ = open_[(room[open_] >= least - 1e-12).all(axis=1)]
    return bins, offsets


def packed_pieces(cuts: DataFrame, capacity: Capacity, shard: int = SHARD) -> DataFrame:
    """`cuts` with sequence_id, offset and what the sequence has left of each capacity: pieces of a full sequence alone,
    the others by shards of even size."""
    full = cuts.filter(F.col("length") >= capacity.tokens)
    part = cuts.filter(F.col("length") < capacity.tokens)
    shards = max(1, -(-part.count() // shard))
    schema = T.StructType([*cuts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in LEFT)])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = list(frames)
        if not all_:
            return
        frame = pd.concat(all_, ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        yield frame.assign(sequence_id=bins + (TaskContext.get().partitionId() << 32), offset=offsets, **capacity.left(bins, lengths))

    mixed = part.repartition(shards).mapInPandas(pack, schema)
    rest = (capacity.tokens - F.col("length"), F.lit(capacity.documents - 1), capacity.attention - F.col("length") * F.col("length"))
    alone = full.select("*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(c.cast("double").alias(n) for c, n in zip(rest, LEFT, strict=True)))
    return mixed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:  # noqa: B008
    """(id, piece, start, length, ids_crc32, sequence_id, offset, tokens_left, documents_left, attention_left). Tokens are
    made once and written to the shared folder, so shards are dealt from fixed rows and a lost executor repeats its own
    shard only. An empty table packs to an empty one; pieces of equal length keep the order of their rows."""
    cuts = staged(pieces(docs, tokenizer_path, capacity.cut, id_col=id_col, text_col=text_col), "pieces")
    return packed_pieces(cuts, capacity, shard).withColumnRenamed("id", id_col)
