"""SentencePiece encoding and decoding: exact merge-type (BPE) encoding by backtracking.

A segmentation of a text into pieces is the one that merging would make if and only if every two neighbours,
re-merged alone, stay the same two pieces. The encoder therefore takes the longest piece at each place (all places'
matches come from one Aho-Corasick pass), checks it against the piece before it, falls back to shorter pieces, and
steps back where none fits; a bitfield keeps the places from which no continuation exists, so none is tried twice.

Defined results: a null text is an empty one, which has no ids; repeated rows are encoded each; a text of any length is
read whole, in time and memory in proportion to it; an empty table has no rows; further columns are not read, so that no
name can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: A place that only its own character matches.
ONE = [1]
EMPTY = hashlib.sha256(b"").hexdigest()
#: Parts kept in a worker's newer cache; when it is full it becomes the older one, whose parts move up when seen again.
CACHE_PARTS = 160_000
#: Longest part that is cached.
CACHE_CHARS = 64


class PieceCodec:
    """Encoder and decoder of one BPE model with byte fallback and no normalisation."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        self.ids = {names[i]: i for i in range(size) if i not in special}
        self.part = self.part_pattern()
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.piece = {i: p for p, i in self.ids.items()}
        self.byte = {i: b for b, i in self.byte_ids.items()}
        #: Pieces that merging really yields from their own characters; no other can occur in an encoding.
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and self.merged(p) == [p]:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.fits = lru_cache(1 << 18)(lambda a, b: self.merged(a + b) == [a, b])
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def part_pattern(self) -> re.Pattern[str]:
        """Cuts a text where no piece can span: before space marks, and between ASCII signs (with what
        pieces mix with them) and other characters. So parts repeat often, and each can be encoded alone."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a word boundary")
        signs = {c for c in map(chr, range(128)) if not c.isalnum() and c != " "}
        pairs = {x for p in self.ids for x in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:], strict=False)}
        while more := {c for x in pairs if (x[0] in signs) != (x[1] in signs) for c in x} - signs:
            signs |= more
        some = "".join(map(re.escape, sorted(signs)))
        return re.compile(f"{SPACE}*[^{SPACE}{some}]+|{SPACE}*[{some}]+|{SPACE}+" if some else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """Plain merging: again and again the best-scored neighbours, the leftmost of equals, until none is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            found = [(-score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in score]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def pieces(self, part: str) -> list[str]:
        """The pieces of one part, characters outside the vocabulary as pieces of their own."""
        n, fits = len(part), self.fits
        lengths: list[list[int] | None] = [None] * n
        for end, size in self.automaton.iter(part):  # by growing end, so each place's lengths grow
            if (found := lengths[at := end - size + 1]) is None:
                lengths[at] = [1, size]
            else:
                found.append(size)
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        tried: list[int] = []  # for each piece in out, which of its place's lengths it is
        at, before, k = 0, "", -1  # k: the length to try; -1 the longest, -2 the next, and so on
        while at < n:
            found = lengths[at] or ONE
            while k >= -len(found):
                end = at + found[k]
                piece = part[at:end]
                if (not before or fits(before, piece)) and not failed[end >> 3] >> (end & 7) & 1:
                    out.append(piece)
                    tried.append(k)
                    at, before, k = end, piece, -1
                    break
                k -= 1
            else:
                if not out:
                    raise AssertionError(f"no encoding of {part!r}")
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                before, k = out[-1] if out else "", tried.pop() - 1
        return out

    def part_ids(self, part: str) -> list[int]:
        ids: list[int] = []
        for p in self.pieces(part):
            if (i := self.ids.get(p)) is not None:
                ids.append(i)
            else:
                ids.extend(self.byte_ids[b] for b in p.encode())
        return ids

    def parts(self, text: str) -> list[str]:
        return self.part.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end marks."""
        return [i for part in self.parts(text) for i in self.part_ids(part)]

    def pieces_text(self, ids: list[int]) -> str:
        """The pieces' characters, runs of byte pieces read as UTF-8; the space mark stays a space."""
        try:
            return "".join([self.piece[i] for i in ids]).replace(SPACE, " ")
        except KeyError:
            pass
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.piece.get(i, ""))
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the one space that encoding puts before a text goes."""
        text = self.pieces_text(ids)
        return text[1:] if ids and self.piece.get(ids[0], "").startswith(SPACE) else text

    def known(self, part: str) -> tuple[bytes, str]:
        """Ids of a part as b"1,2," and what they decode to."""
        if (got := self.cache.get(part) or self.older.get(part)) is None:
            ids = self.part_ids(part)
            got = b"%s," % ",".join(map(str, ids)).encode(), self.pieces_text(ids)
        if len(part) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PARTS:
                self.older, self.cache = self.cache, {}
            self.cache[part] = got
        return got

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids joined by commas, digest of the decoded text."""
        if not text:
            return 0, EMPTY, EMPTY
        parts = self.parts(text)
        done = list(map(self.cache.get, parts))
        if None in done:
            done = [x or self.known(part) for x, part in zip(done, parts, strict=True)]
        coded, read = zip(*done, strict=True)
        ids, decoded = b"".join(coded), "".join(read)
        return ids.count(b","), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(decoded[1:].encode()).hexdigest()


@lru_cache(2)
def codec(model_path: str) -> PieceCodec:
    """One codec a worker process and model."""
    return PieceCodec(model_path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): every whole text encoded; null and empty texts give an empty array."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema).toDF(id_col, "ids")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): every array of ids decoded; a null array gives an empty text."""
    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema).toDF(id_col, "text")


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, repeated rows included.

    Texts may be null (as empty), empty or very long; other columns are not read, so their names cannot clash. The
    work is one narrow pass: no shuffle, memory of one Arrow batch and a cache of bounded size, and a lost executor
    costs its own tasks only.
    """
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            rows = [c.round_trip(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
