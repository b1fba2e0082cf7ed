"""Secret scans: candidates by pattern, a random forest to remove false positives.

Candidates come by shape and by context: runs of at least LEAST key characters, issued keys, web tokens and private-key
blocks wherever they stand, passwords within URLs, and whatever is assigned to a name that speaks of secrets, by a sign
or in prose ("the password is ..."), of whatever characters. Where candidates overlap, the more telling kind stands for
all. Every search reads a text once, from stop to stop, so that no text takes more than its length. Their features are
length, character transitions, how much of them dictionary words cover, the path the text comes from, and the words
beside them. The forest is trained by Spark on labelled findings; its trees (their number and depth are parameters, so
their size is bounded) are read off once and travel with the scan, which is then one narrow pass over whole texts.

The dictionary is the whole words of a public tokenizer's vocabulary, read from its file by each worker.

Labelled findings are rows (before, candidate, after, path, label). Where a project has none of its own, `labelled()`
makes them: secrets of the usual shapes in the usual places, against identifiers, checksums, numbers, placeholders,
settings, prose and long words. Labels have no other source here.

Defined results: null and empty texts have no findings; null paths are empty; repeated rows are scanned each; equal
spans are one candidate; a probability of exactly the threshold is a secret; a text of any length takes time and memory
in proportion to it; an empty table has no findings; other columns are not read by the scan and are kept by the
redaction.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 16
KEY = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
#: How issued keys of well-known services look, and the forms of web tokens, private keys and URLs.
ISSUED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[pousr]_|glpat-|sk_live_|sk-|xox[abp]-|npm_|AIza)[A-Za-z0-9_\-]{16,}")
DOTTED = re.compile(r"[A-Za-z0-9_\-.]+")
#: A web token: its first part begins with this; letters of each of the three parts at least (of the first: after it).
TOKEN_START, TOKEN_PART = "eyJ", 6
KEY_MARK = re.compile(r"-----(BEGIN|END) ([A-Z ]*PRIVATE KEY)-----")
IN_URL = re.compile(r"://[^\s/:@]*:([^\s/@]+)@")
#: Names that speak of secrets, and what assigns to them: a sign, or a verb of prose.
NAMED = re.compile(r"(?i)passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer")
NAME_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
SIGN = re.compile(r"=>|:=|[=:]|(?<=\s)(?:is|was)(?=\s)")
BLANK, STOP = re.compile(r"\s*"), re.compile(r"[\s\"',;]")
QUOTE_END = {q: re.compile(f"[{q}\n]") for q in "\"'"}
#: Letters of an assigned value at least.
LEAST_VALUE = 3
#: Kinds of candidates, the most telling first.
KINDS = ("private", "web_token", "issued", "in_url", "assigned", "run")
#: Characters of context on either side.
BESIDE = 40
#: Words that name secrets, words that name harmless identifiers, and common words of code and prose.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "credential", "auth", "bearer", "access", "private")
HARMLESS_WORDS = ("sha", "sha256", "md5", "commit", "checksum", "digest", "uuid", "guid", "card", "isbn", "version", "hash", "etag", "revision", "order", "phone", "example", "id")
WORDS = (
    "the and for with that this from have not are was were will would can one all more some time like into than then them only other new now over such after also back user name "
    "file data value type class test main code list item page text line word string number object array model view table index query service config system server client request "
    "response content document process function method return error default example sample placeholder change your here"
).split()
#: Letters of a dictionary word at least.
WORD_LETTERS = 4
HARMLESS_PATHS = re.compile(r"(?i)test|example|sample|doc|mock|fixture|lock")
PLACEHOLDER = re.compile(r"(?i)x{4,}|example|placeholder|your|changeme|0{6,}|1234567")
FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "entropy", "distinct", "hex", "class_changes", "letter_pairs", "vowel_changes", "longest_letters", "covered", "placeholder", "issued",
    "path_harmless", "assigned", "quoted", "secret_beside", "harmless_beside", "words_beside", *(f"kind_{k}" for k in KINDS),
)
TREES, DEPTH, SEED, FINDINGS = 24, 10, 7, 6000


@lru_cache(2)
def dictionary(path: str) -> ahocorasick.Automaton:
    """The whole words of a SentencePiece vocabulary, in lower case, as one automaton."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.vocab_size()))
    out = ahocorasick.Automaton()
    for word in {n[1:].lower() for n in names if n.startswith("▁")}:
        if len(word) >= WORD_LETTERS and word.isalpha():
            out.add_word(word, len(word))
    out.make_automaton()
    return out


def covered(low: str, words: ahocorasick.Automaton) -> int:
    """Characters that dictionary words cover."""
    n, end = 0, -1  # matches come by growing end
    runs: list[list[int]] = []
    for last, size in words.iter(low):
        start = last - size + 1
        while runs and runs[-1][0] >= start:
            runs.pop()
        if runs and runs[-1][1] >= start - 1:
            runs[-1][1] = last
        else:
            runs.append([start, last])
    for a, b in runs:
        n, end = n + b - max(a, end + 1) + 1, b
    return n


def features(before: str, candidate: str, after: str, path: str, kind: str, words: ahocorasick.Automaton) -> list[float]:
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in candidate]
    low = candidate.lower()
    counts = Counter(low).values()
    letters = re.findall("[a-z]+", low)
    vowels = [c in "aeiouy" for c in low if c.isalpha()]
    near, left = (before[-BESIDE:] + " " + after[:BESIDE]).lower(), before.rstrip("\"' ")
    beside = set(re.findall("[a-z_0-9]+", before[-BESIDE:].lower()))
    return [
        float(n),
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("l") / n,
        kinds.count("s") / n,
        -sum(c / n * math.log2(c / n) for c in counts),
        len(counts) / n,
        float(all(c in "0123456789abcdef-" for c in low)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(len(x) - 1 for x in letters) / n,
        sum(a != b for a, b in zip(vowels, vowels[1:], strict=False)) / max(1, len(vowels)),
        max(map(len, letters), default=0) / n,
        covered(low, words) / n,
        float(bool(PLACEHOLDER.search(candidate))),
        float(bool(ISSUED.search(candidate))),
        float(bool(HARMLESS_PATHS.search(path))),
        float(left.endswith(("=", ":", "=>", " is", " was"))),
        float(before.endswith(('"', "'")) and after.startswith(('"', "'"))),
        float(any(w in x for x in beside for w in SECRET_WORDS)),
        float(any(w == x for x in beside for w in HARMLESS_WORDS)),
        float(len(re.findall(r"\b[a-z]{2,}\b", near))),
        *(float(kind == k) for k in KINDS),
    ]


def assigned_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what is assigned to a name that speaks of secrets: in quotes on one line, or up to a stop. What
    lies between two signs is read for the second one only, and stops are found in one pass beside the signs."""
    stops = (m.start() for m in STOP.finditer(text))
    stop, last = -1, 0
    for m in SIGN.finditer(text):
        before, last = text[last : m.start()].rstrip().rstrip("\"'])"), m.end()
        if not NAMED.search(before[len(before.rstrip(NAME_CHARS)) :]):
            continue
        start = BLANK.match(text, m.end()).end()
        if quote := QUOTE_END.get(text[start : start + 1]):
            end = quote.search(text, start + 1)
            if end and end.group() == text[start] and end.start() - start > LEAST_VALUE:
                yield start + 1, end.start()
            continue
        while stop is not None and stop < start:
            stop = next(stops, None)
        end = len(text) if stop is None else stop
        if end - start >= LEAST_VALUE:
            yield start, end


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of three dotted parts of which the first holds TOKEN_START."""
    for m in DOTTED.finditer(text):
        if TOKEN_START not in m.group():
            continue
        start, parts, free = m.start(), m.group().split("."), m.start()
        for i, part in enumerate(parts):
            if start >= free and i + 2 < len(parts) and len(parts[i + 1]) >= TOKEN_PART <= len(parts[i + 2]):
                at = part.find(TOKEN_START)
                if at >= 0 and len(part) - at - len(TOKEN_START) >= TOKEN_PART:
                    free = start + len(part) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                    yield start + at, free
            start += len(part) + 1


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of private-key blocks: a beginning, up to the nearest end of the same kind."""
    marks = [(m.start(), m.end(), m.group(1), m.group(2)) for m in KEY_MARK.finditer(text)]
    ends: dict[str, int] = {}
    closing = [0] * len(marks)  # where the block that begins here ends, found from the right
    for i in range(len(marks) - 1, -1, -1):
        start, end, what, kind = marks[i]
        if what == "END":
            ends[kind] = end
        else:
            closing[i] = ends.get(kind, 0)
    free = 0
    for (start, _, what, _), end in zip(marks, closing, strict=True):
        if what == "BEGIN" and end and start >= free:
            yield start, end
            free = end


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of a text, none of which overlap."""
    by_kind = {
        "private": private_keys(text) if "-----BEGIN" in text else (),
        "web_token": web_tokens(text) if TOKEN_START in text else (),
        "issued": (m.span() for m in ISSUED.finditer(text)),
        "in_url": (m.span(1) for m in IN_URL.finditer(text)) if "://" in text else (),
        "assigned": assigned_values(text),
        "run": (m.span() for m in KEY.finditer(text)),
    }
    taken: list[tuple[int, int, str]] = []
    for kind in KINDS:
        out, i, free = [], 0, 0  # spans of one kind come in the order of their starts
        for start, end in by_kind[kind]:
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if start >= free and (i == len(taken) or taken[i][0] >= end):
                out.append((start, end, kind))
                free = end
        taken = sorted(taken + out)
    return taken


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, left and right node, probability of a secret at leaves; and
    the file of the dictionary that its features count by."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    vocabulary: str

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = np.flatnonzero(inner)
                node = at[go]
                at[go] = np.where(x[go, feature[node]] <= threshold[node], left[node], right[node])
            total += leaf[at]
        return total / max(1, len(self.trees))


def train(findings: DataFrame, vocabulary: str, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """A forest from labelled findings (before, candidate, after, path, label); vocabulary: the dictionary's file."""

    @F.pandas_udf("array<double>")
    def vector(before: pd.Series, candidate: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        words = dictionary(vocabulary)
        return pd.Series([features(b or "", c, a or "", p or "", kind_of(b or "", c, a or ""), words) for b, c, a, p in zip(before, candidate, after, path, strict=True)])

    rows = findings.filter(F.length("candidate") > 0).select(array_to_vector(vector("before", "candidate", "after", "path")).alias("features"), F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    return Forest(tuple(_nodes(t._call_java("rootNode")) for t in model.trees), vocabulary)


def kind_of(before: str, candidate: str, after: str) -> str:
    """The kind under which the scan would find a labelled candidate in its place."""
    a = len(before)
    return next((k for start, end, k in candidates(before + candidate + after) if start < a + len(candidate) and end > a), "run")


def _nodes(root) -> tuple[np.ndarray, ...]:
    """A tree of Spark's, read through its public node methods, as arrays."""
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, at, at, float(node.prediction())])
        if node.subtreeDepth() > 0:
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            rows[at][:4] = [split.featureIndex(), split.threshold(), left, right]
        return at

    add(root)
    table = np.array(rows)
    return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]


def labelled(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """n labelled findings, half of them secrets, the same for equal seeds."""
    return spark.createDataFrame(_labelled(n, seed), "before string, candidate string, after string, path string, label int")


def _labelled(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllable = lambda: r.choice(["th", "er", "on", "an", "ti", "re", "ou", "ion", "ment", "sch", "ung", "lich", "keit", "ado", "ción", "eau", "ent", "ste", "ble", "ing"])
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(r.choice([word(), r.choice(WORDS)]) for _ in range(k))

    name = lambda: r.choice(["", "api_", "client_", "aws_", "db_", "MY_"]) + r.choice(["token", "secret", "password", "passwd", "key", "auth_token", "access_key", "private_key"])
    sign = lambda: r.choice([" = ", "=", ": ", ":", " => "])

    def told(value: str) -> tuple[str, str, str]:
        quote = r.choice(['"', "'", "", "", ""])
        told = r.choice(["password", "Password", "passphrase", "secret", "token", "access key", "API key", "credential"])
        return f"{prose(r.randint(0, 4))}{r.choice([' ', '. ', chr(10)])}{r.choice(['The ', 'the ', 'Your ', 'my ', ''])}{told} {r.choice(['is', 'was'])} {quote}", value, f"{quote}{r.choice(['.', ' ' + prose(3), chr(10), ', ' + prose(2)])}"

    def assigned(value: str, named: str = "") -> tuple[str, str, str]:
        quote = r.choice(['"', "'", '"', ""]) if not re.search(r"[\s\"',;]", value) else '"'
        named = named or name()
        named = named.upper() if r.random() < 0.2 else named
        return f"{prose(r.randint(0, 4))}{r.choice([chr(10), ' '])}{named}{sign()}{quote}", value, f"{quote}{r.choice(['', chr(10), ' ' + prose(3), '###', ','])}"

    def secret() -> tuple[str, str, str]:
        kind = r.choice([*range(10), 6, 6])
        if kind < 2:  # issued keys betray themselves, wherever they stand
            value = "AK" + "IA" + some(upper + digits, 16) if kind else r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "npm_"]) + some(lower + upper + digits, r.randint(24, 40))
            return assigned(value) if r.random() < 0.5 else (f"{prose(r.randint(0, 6))}{r.choice([' ', '/', ' key:'])}", value, r.choice([f" {prose(4)}", "\n", ".", ""]))
        if kind < 4:
            value = some("0123456789abcdef", r.choice([16, 18, 20, 24, 32, 40, 40, 64]))
            return assigned(value.upper() if r.random() < 0.2 else value)
        if kind == 4:
            return assigned(some(lower + upper + digits, r.randint(16, 48)))
        if kind == 5:
            return assigned(some(lower + upper + digits + "+/", r.choice([24, 32, 44, 64])) + r.choice(["", "=", "=="]))
        if kind == 6:  # passwords that people make
            value = r.choice([some(lower + digits, r.randint(6, 11)), r.choice(WORDS) + some(digits, r.randint(1, 4)) + r.choice("!#$%&*") + r.choice(["", r.choice(WORDS).capitalize()]), some(lower, r.randint(16, 24)), "".join(r.sample(WORDS, r.randint(3, 4))), "".join(w.capitalize() for w in r.sample(WORDS, 2)) + some(digits + "!#$", 3)])
            if r.random() < 0.1:
                value = some(lower + digits, r.randint(3, 5))
            return told(value.replace(" ", "")) if r.random() < 0.25 and any(c.isdigit() for c in value) else assigned(value, r.choice(["", "", "password", "passwd", "pwd"]))
        if kind == 7:
            value = some(lower + upper + digits, r.randint(6, 14)) if r.random() < 0.7 else r.choice(WORDS) + some(digits, 3)
            return f"{prose(3)} {r.choice(['postgres', 'mysql', 'amqp', 'https', 'redis'])}://{r.choice(WORDS)}:", value, f"@{r.choice(WORDS)}.{word()}{r.choice([':5432/db', '/', ''])}"
        if kind == 8:
            part = lambda k: some(lower + upper + digits + "-_", k)
            return r.choice(["Authorization: Bearer ", f"{prose(2)} ", "token=", 'jwt = "']), f"eyJ{part(17)}.eyJ{part(r.randint(20, 60))}.{part(43)}", r.choice(["\n", '"', f" {prose(2)}"])
        body = "\n".join(some(lower + upper + digits + "+/", 64) for _ in range(r.randint(2, 6)))
        what = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY"])
        return f"{prose(2)}\n", f"-----BEGIN {what}-----\n{body}\n-----END {what}-----", "\n"

    def harmless() -> tuple[str, str, str]:
        kind = r.randint(0, 9)
        if kind == 0:
            return f"{prose(3)} ", some(digits, r.choice([16, 18, 20])), f" {prose(2)}"
        if kind == 1:
            return r.choice(["commit ", "sha256: ", "md5 ", "checksum = ", "digest: ", "revision ", "etag "]), some("0123456789abcdef", r.choice([32, 40, 64])), r.choice(["\n", f" {prose(2)}"])
        if kind == 2:
            hexa = some("0123456789abcdef", 32)
            return r.choice(["uuid: ", "id ", "guid = ", f"{prose(2)} "]), "-".join((hexa[:8], hexa[8:12], hexa[12:16], hexa[16:20], hexa[20:])), r.choice(["\n", " "])
        if kind == 3:
            camel = "".join(w.capitalize() for w in r.sample(WORDS, 4)) + some(digits, r.randint(0, 3))
            return r.choice([f"{prose(2)} ", "class ", "def ", "import "]), camel.ljust(LEAST, "x"), r.choice(["(", " ", ":", "\n"])
        if kind == 4:
            path = "/".join([*(r.choice(WORDS) for _ in range(4)), word() + some(digits, 2)]).ljust(LEAST, "s")
            return r.choice(["http://", "see ", "/"]), path, r.choice([".html", " ", "\n"])
        if kind == 5:
            value = r.choice(["YOUR_API_KEY_HERE_123", "xxxxxxxxxxxxxxxxxxxx1", "EXAMPLE_TOKEN_000000", "changeme_changeme_1", "0000000000000000000", "changeme", "********", "<password>", "${DB_PASSWORD}", "your-password"])
            return f"{r.choice(['token', 'api_key', 'secret', 'password'])}{sign()}\"", value, '"'
        if kind == 6:  # settings and prose after such names
            value = r.choice(["None", "null", "true", "false", "required", "string", "string,", "optional", "self.token", "os.environ", "getpass()", "request.headers", "config.secret", r.choice(WORDS), word()])
            if r.random() < 0.4:  # what prose says of them is no secret
                return told(r.choice(["required", "wrong", "valid", "stored", "the", "not", "in", "sent", "hashed", "expired", "missing", r.choice(WORDS), word()]).rjust(LEAST_VALUE, "a"))
            return f"{prose(r.randint(0, 3))} {name()}{sign()}", value.rjust(4, "e"), r.choice([" " + prose(4), "\n", ")", ","])
        if kind == 7:
            return f"{prose(4)} ", "-".join(r.choice([word(), r.choice(WORDS)]) for _ in range(r.randint(3, 5))).ljust(LEAST, "e"), f" {prose(3)}"
        long_ = "".join(c for c in "".join(syllable() for _ in range(r.randint(6, 10))) if c.isascii())
        tail = some(digits, r.randint(1, 3)) if kind == 8 else ""
        return f"{prose(4)} ", (r.choice([long_, long_.capitalize(), long_.upper()]) + tail).ljust(LEAST, "e"), f" {prose(3)}"

    out = []
    for i in range(n):
        before, candidate, after = (secret, harmless)[i % 2]()
        path = r.choice(["", f"src{r.randint(0, 40)}", f"{word()}/{word()}.py", "tests/fixtures/" + word() if i % 2 else "config/" + word()])
        out.append((before, candidate, after, path, int(i % 2 == 0)))
    return out


def scored(texts: list[str], paths: list[str], forest: Forest) -> list[tuple[int, int, int, float]]:
    """(row, start, end, probability) of all candidates of a batch."""
    spans = [(i, *x) for i, t in enumerate(texts) for x in candidates(t)]
    if not spans:
        return []
    words = dictionary(forest.vocabulary)
    x = np.array([features(texts[i][max(0, a - BESIDE) : a], texts[i][a:b], texts[i][b : b + BESIDE], paths[i], kind, words) for i, a, b, kind in spans])
    return [(*s[:3], float(p)) for s, p in zip(spans, forest.probability(x), strict=True)]


def secret_findings(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, start, end, candidate_sha256, probability, is_secret) of every candidate; places in code points. The
    candidate itself is not returned."""
    names = ["start", "end", "candidate_sha256", "probability", "is_secret"]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = ([x or "" for x in batch.column(i).to_pylist()] for i in (1, 2))
            found = scored(texts, paths, forest)
            if found:
                rows, starts, ends, ps = zip(*found, strict=True)
                shas = [hashlib.sha256(texts[i][a:b].encode()).hexdigest() for i, a, b, _ in found]
                columns = [pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(shas), pa.array(ps), pa.array([p >= threshold for p in ps])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], schema.names)

    return docs.select(id_col, text_col, F.col(path_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redacted(text: Column, path: Column, forest: Forest, threshold: float = 0.5, mask: str = "[SECRET]") -> Column:
    """The text with every secret replaced by `mask`; null stays null."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series, paths: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        cuts: dict[int, list[tuple[int, int]]] = {}
        for i, a, b, p in scored(whole, [x or "" for x in paths], forest):
            if p >= threshold:
                cuts.setdefault(i, []).append((a, b))
        out = list(texts)
        for i, spans in cuts.items():
            starts, ends = zip(*spans, strict=True)
            out[i] = mask.join(whole[i][a:b] for a, b in zip((0, *ends), (*starts, len(whole[i])), strict=True))
        return pd.Series(out, dtype=object)

    return redact(text, path.cast("string"))
