"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most two bits are cut into two halves. Either the upper halves differ in at most
one bit, or the lower halves are equal. So each fingerprint is indexed under 32 variants of its upper half, each with
one bit as a wildcard, and under its lower half; two fingerprints that link share a signature. Fingerprints of one
signature are compared over a sliding frame of bounded size; a signature with more of them than the frame (near copies
in thousands) is indexed further, with a second wildcard: fingerprints that share both the signature and the rest
differ in at most those two bits, so all of them link to the group's smallest and no pairs are made.

Components come from alternating large-star and small-star steps over the links, in the shared folder between steps.
Equal fingerprints are one node, so copies are never paired.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; repeated rows get a row each; a
text of any length is read in blocks of shingles; an empty table has no rows; further columns are not read by
near_duplicates and are kept whole, in a struct of their own, by keep_first, so that no name can clash.

keep_first, the pipeline's stage, has a contract of its own: documents whose sets of 5-word shingles have a Jaccard
similarity of at least 0.8 link. Candidates come from SimHash first: documents whose fingerprints are equal or link at two
or fewer bits, by deletion variants as above (`print_pairs`). At 0.8 fingerprints differ in some 10 of 64 bits, too many for
deletion variants, so candidates are also those that share a band, that is BAND least hashes of a set (at 0.8, 99.96 % of pairs share one of BANDS); each candidate is
compared exactly. In a band with more than FRAME documents each is first compared with the band's first document, by
which a crowd of copies of one text is connected, and with its neighbours in the order of the rotated fingerprints. If
that leaves such a band in several components, `settled` finds every link between them: by the prefix filter, documents
that are similar enough share one of their rarest shingles, and those of a shingle are compared across components only.
Each set has PARITIES bits, each the parity of the shingles that belong to it: two sets differ by at least as many
shingles as bits, so that pairs with too many differing bits are never made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import discard, staged, text_batches

SEED = 42
SHINGLE = 3
#: Fingerprints of one signature that are compared with each other; larger groups take the second wildcard.
FRAME = 32
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: keep_first: words of a shingle, and the similarity that links, as a fraction.
COPY_SHINGLE, ALIKE = 5, (4, 5)
BANDS, BAND = 20, 5
#: Neighbours that are compared at first in a band of more than FRAME documents, in each of four rotations.
NEIGHBOURS = 8
#: Documents of one rare shingle that meet all others of it in one round: at first, and at most.
MEET, MEET_MOST = 32, 1024
#: Bits of a set's parities, in words of 64.
PARITIES = 512
WORDS = [f"p{i}" for i in range(PARITIES // 64)]
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
XORS, FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND), np.uint64) | np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's word shingles, repeats included. Fewer words than a shingle make one of the whole."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the white space \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    grams = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(seed)), np.uint64, n)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each set if it is set in over half the hashes of the text's shingles; no words give zero."""
    return majority(shingles(text, size, seed))


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, BLOCK):
        counts += np.unpackbits(hashes[a : a + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; a null text counts as one without words. One narrow pass."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a > b: links between the different fingerprints `fp` of `nodes`, enough of them that two
    fingerprints with at most two differing bits are always connected."""
    fp = F.col("fp")
    upper, lower = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    # signature: which bit is the wildcard (32: the whole upper half is, the lower half stands), then the 32 bits left
    sign = [F.lit(i << 32).bitwiseOR(upper.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i)))) for i in range(32)] + [F.lit(32 << 32).bitwiseOR(lower)]
    signed = nodes.select("fp", F.explode(F.array(*sign)).alias("sig"))
    group = Window.partitionBy("sig")
    before = F.collect_list("fp").over(group.orderBy("fp").rowsBetween(-(FRAME - 1), -1))
    read = signed.select("fp", "sig", F.count(F.lit(1)).over(group).alias("n"), before.alias("before")).filter("n > 1")
    read = staged(read.withColumn("before", F.when(F.col("n") <= FRAME, F.filter("before", lambda x: F.bit_count(x.bitwiseXOR(F.col("fp"))) <= 2))), "signatures")
    near = read.filter(F.size("before") > 0).select(F.explode("before").alias("x"), "fp")
    # large groups: the second wildcard
    wild = F.shiftrightunsigned(F.col("sig"), 32)
    one = [F.lit(1 << j).cast("long") for j in range(32)]
    pair = lambda lo: F.array(*[F.lit(_signed(1 << i | 1 << j)).cast("long") for i in range(lo, lo + 32) for j in range(lo, i)])
    own = F.call_function("shiftleft", F.lit(1).cast("long"), (wild + 32).cast("int"))
    other = F.transform(F.array(*one), lambda m: m.bitwiseOR(own))
    masks = F.when(wild == 32, pair(32)).when(wild == 0, F.concat(other, pair(0))).otherwise(other)
    keys = read.filter(F.col("n") > FRAME).select("fp", F.explode(masks).alias("mask"))
    keys = keys.select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    least = F.min("fp").over(Window.partitionBy("mask", "rest"))
    stars = keys.select("fp", least.alias("x")).filter("fp <> x")
    return near.select("fp", "x").unionByName(stars).select(F.greatest("fp", "x").alias("a"), F.least("fp", "x").alias("b")).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of `edges` (a > b) the smallest node it is connected with. Each round is written to
    the shared folder; rounds grow with the logarithm of a component's length."""
    edges = staged(edges.distinct(), "edges")
    while True:
        # large star: every larger neighbour goes to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        next_ = large.join(small, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        next_ = staged(next_, "edges")
        discard(edges)
        # done when every node has one edge and no node is both an end and a root
        parents = next_.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        loose = parents.filter("n > 1").select("a").unionByName(next_.select(F.col("b").alias("a")).distinct().join(parents.select("a"), "a", "left_semi"))
        edges = next_
        if loose.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the different fingerprints of `fps` (id, fp): the smallest fingerprint and the
    smallest id reachable."""
    nodes = staged(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(best, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row, repeated rows included.

    Null, empty and blank texts have fingerprint zero and link like any other; a null id joins its class but is its
    name only if the class has no other.
    """
    fps = staged(fingerprints(docs, size, id_col, text_col), "document-fingerprints")
    out = fps.join(classes(fps), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of BAND least values of a set under its own permutations."""
    least = np.full(BANDS * BAND, ONES, np.uint64)
    for a in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[a : a + 1024, None] ^ XORS) * FACTORS).min(axis=0), out=least)
    out = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) with a > b: nodes (node, fp, bands) that share a band; and (node, band, sig) of the bands with more than
    FRAME nodes, not all of whose pairs are among them."""
    turn = (F.col("band") % 4 * 16).cast("int")
    left, right = F.call_function("shiftleft", F.col("fp"), turn), F.call_function("shiftrightunsigned", F.col("fp"), 64 - turn)
    banded = nodes.select("node", "fp", F.posexplode("bands").alias("band", "sig")).withColumn("turned", left.bitwiseOR(right))
    group = Window.partitionBy("band", "sig")
    before = F.collect_list("node").over(group.orderBy("turned", "node").rowsBetween(-(FRAME - 1), -1))
    read = banded.select("node", "band", "sig", F.count(F.lit(1)).over(group).alias("n"), F.min("node").over(group).alias("first"), before.alias("before")).filter("n > 1")
    near = F.when(F.size("before") <= NEIGHBOURS, F.col("before")).otherwise(F.slice("before", -NEIGHBOURS, NEIGHBOURS))
    met = F.when(F.col("n") <= FRAME, F.col("before")).otherwise(F.array_append(near, F.col("first")))
    read = staged(read.select("node", "band", "sig", "n", met.alias("met")), "bands")
    pairs = read.select("node", F.explode("met").alias("x")).filter("node <> x")
    return pairs.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b")).distinct(), read.filter(F.col("n") > FRAME).select("node", "band", "sig")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) with a > b: nodes (node, fp) whose fingerprints are equal or link. A fingerprint's least node stands for it:
    the others of it meet that one only."""
    least = staged(nodes.groupBy("fp").agg(F.min("node").alias("of")), "prints")
    own = nodes.select("node", "fp").join(least, "fp").filter("node <> of").select(F.col("node").alias("a"), F.col("of").alias("b"))
    near = links(least).join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return own.unionByName(near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits of a set: each is the parity of the number of its hashes that belong to it."""
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % PARITIES, minlength=PARITIES) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def near_enough(size: Column, other: Column, words: list[Column], others: list[Column]) -> Column:
    """Whether two sets can be similar enough, by their sizes and parities."""
    p, q = ALIKE
    bits = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(words, others, strict=True)), F.lit(0))
    return (F.least(size, other) * q >= F.greatest(size, other) * p) & (bits * (q + p) <= (size + other) * (q - p))


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(hash, node, size, WORDS): the shingles of each of `sets` (node, hashes, parities) by which it must meet any other that is similar
    enough. Of two such sets, ordered from the rarest shingle on, these many first ones have one in common; those that
    no other set has are counted and left out."""
    words = [F.col("parities")[i].alias(w) for i, w in enumerate(WORDS)]
    all_ = sets.select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    held = all_.groupBy("hash").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    own = Window.partitionBy("node")
    shared = all_.join(held, "hash").select("hash", "node", "size", F.count(F.lit(1)).over(own).alias("n"), F.row_number().over(own.orderBy("held", "hash")).alias("at"))
    first = F.col("size") - F.ceil(F.col("size") * ALIKE[0] / ALIKE[1]) + 1
    rare = shared.filter(F.col("at") <= first - (F.col("size") - F.col("n"))).select("hash", "node", "size")
    return rare.join(sets.select("node", *words), "node").select("hash", "node", "size", *WORDS)


def settled(links: DataFrame, crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root): components of `links` (a, b) and of all links between nodes of `crowds` (node, band, sig).

    Only crowds that `links` leaves in several components are looked at. In each round, some nodes of each rare shingle
    meet all others of it that are in other components, and are done with; nodes of its largest component come last.
    A shingle within one component needs no more. So a crowd of copies costs a few rounds over its rows, whatever its
    size, and no link is lost.
    """
    roots = components(links)
    rooted = lambda rows: rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def mixed(rows: DataFrame, *by: str) -> DataFrame:
        rows = rooted(rows)
        some = rows.groupBy(*by).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        return rows.join(some.select(*by), list(by), "left_semi")

    loose = staged(mixed(crowds, "band", "sig").select("node").distinct(), "loose")
    if loose.isEmpty():
        return roots
    rare = staged(rare_shingles(sets.join(loose, "node", "left_semi")), "rare")
    meet = MEET
    while True:
        left = staged(mixed(rare, "hash"), "left")
        if left.isEmpty():
            return roots
        largest = left.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
        others = left.join(largest, "hash").filter("root <> largest")
        turn = F.row_number().over(Window.partitionBy("hash").orderBy("node"))
        now = staged(others.withColumn("turn", turn).filter(F.col("turn") <= meet).select("hash", F.col("node").alias("x"), F.col("root").alias("of"), F.col("size").alias("long"), *(F.col(w).alias(f"of_{w}") for w in WORDS)), "meeting")
        near = near_enough(F.col("size"), F.col("long"), [F.col(w) for w in WORDS], [F.col(f"of_{w}") for w in WORDS])
        pairs = left.join(now, "hash").filter((F.col("root") != F.col("of")) & near)
        pairs = pairs.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b")).distinct()
        new = staged(alike(pairs, sets), "links")
        if not new.isEmpty():
            roots = components(roots.toDF("a", "b").unionByName(new))
        rare = left.join(now.select("hash", F.col("x").alias("node")), ["hash", "node"], "left_anti").select("hash", "node", "size", *WORDS)
        meet = min(2 * meet, MEET_MOST)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose `sets` (node, hashes) are similar enough, compared exactly."""
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    all_ = F.size("of_a") + F.size("of_b") - F.col("shared")
    return both.filter(F.col("shared") * ALIKE[1] >= all_ * ALIKE[0]).select("a", "b")


def keep_first(docs: DataFrame, size: int = COPY_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class of near copies left, that of the smallest id (of equal ids, any one row).
    Equal sets of shingles are one node; texts without words are copies of each other."""

    @F.pandas_udf("copy binary, fp long, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = np.unique(shingles((t or "").encode(), size))
            rows.append((xxhash.xxh3_128_digest(hashes.tobytes()), _signed(majority(hashes)), bands(hashes)))
        return pd.DataFrame(rows, columns=["copy", "fp", "bands"])

    @F.pandas_udf("hashes array<long>, parities array<long>")
    def hashes(texts: pd.Series) -> pd.DataFrame:
        own = [np.unique(shingles((t or "").encode(), size)) for t in texts]
        return pd.DataFrame({"hashes": [x.view(np.int64) for x in own], "parities": [parities(x) for x in own]})

    numbered = docs.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).alias("id"), sketch(F.col(text_col)).alias("sketch"), F.struct("*").alias("row"))
    rows = staged(numbered.select("number", "id", "sketch.*", "row"), "numbered")
    nodes = staged(rows.groupBy("copy", "fp", "bands").agg(F.min("number").alias("node")), "copies")
    pairs, crowds = candidates(nodes)
    pairs = staged(pairs.unionByName(print_pairs(nodes)).distinct(), "candidates")
    used = pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct()
    texts = rows.select("number", F.col(f"row.{text_col}").alias("text")).join(used, "number", "left_semi")
    sets = staged(texts.select(F.col("number").alias("node"), hashes("text").alias("of")).select("node", "of.*"), "sets")
    roots = settled(staged(alike(pairs, sets), "links"), crowds, sets)
    rooted = nodes.select("copy", "node").join(roots, "node", "left").select("copy", F.coalesce("root", "node").alias("root"))
    first = rows.select("number", "id", "copy").join(rooted, "copy").groupBy("root").agg(F.min(F.struct("id", "number")).alias("first")).select("first.number")
    return rows.join(first, "number", "left_semi").select("row.*")
