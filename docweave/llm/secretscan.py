"""Secret scans: fixed patterns, and password guess cost by dynamic programming.

The pattern spans are ``assign`` (a credential name, a mark, a value of 12 or more characters),
``access`` (cloud access keys) and ``hex`` (16 or more hexadecimal digits). To these, values in
credential contexts, also short ones and names that the patterns lack, are added as ``guess`` spans
if even the cheapest segmentation into dictionary words, dates, repeats, sequences, keyboard walks
and brute-force spans takes at least 10 ** ``min_log10`` guesses. A value of words alone between
separators (``your_api_key_here``) names something and is no secret, however long.

The dictionary has three parts, each ranked, commonest first; a word's guesses are its best rank: the
passwords that people choose (``WORDS``), the whole words and endings of a public tokenizer's vocabulary,
some 33,000, and the ``CORPUS_WORDS`` commonest words of all the documents scanned, so that a corpus in
any language has its own ordinary words. What is broadcast is bounded by these two sizes.

Spans are in code points, end exclusive. Defined results: a null text is empty and has no spans; one
value may be an assign and a guess span; repeated rows and rows with a null doc_id are all scanned; an empty
table gives no rows; extra columns are ignored. Values of any length are segmented whole: each match is
bounded, so the time is linear in the value.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.textblock import Block, blocks
from docweave.llm.tokens import default_path
from docweave.runtime import cut, ship_package

# Fixed values of the contract.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = {"assign": 0, "access": 1, "hex": 2, "guess": 3}

CONTEXT = re.compile(r"(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?)[\"']?\s{0,8}(?:=>|:=|[:=])\s{0,8}[\"']?([^\s\"'<>|,;]{6,})", re.I | re.A)
HINTS = ("passw", "passp", "passc", "pwd", "secret", "token", "api", "access", "credential")
HEX_BYTES = np.zeros(256, bool)
HEX_BYTES[list(b"0123456789abcdef")] = True

#: Passwords that people choose, commonest first.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login secret shadow sunshine princess football "
    "baseball superman batman trustno hello freedom whatever test guest root user pass love iloveyou summer winter spring "
    "autumn changeme default server oracle database token access key api prod dev stage local example demo company"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
CORPUS_WORDS = 20_000
SEPARATORS = "_-./:"
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEAR: dict[str, set[str]] = {}
for _r, _row in enumerate(ROWS):
    for _i, _c in enumerate(_row):
        NEAR[_c] = {_row[j] for j in (_i - 1, _i + 1) if 0 <= j < len(_row)}
        NEAR[_c] |= {ROWS[q][j] for q in (_r - 1, _r + 1) if 0 <= q < len(ROWS) for j in (_i - 1, _i, _i + 1) if 0 <= j < len(ROWS[q])}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
LONGEST = 24  # of a dictionary word or a date
SEGMENT = math.log10(4)  # what each further segment adds, for the attacker's choice of structure


def vocabulary_words(path: str | None = None) -> list[str]:
    """The letters-only tokens of three or more characters that end a word, in order of their ids: commonest first."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path or default_path()).get_vocab(False)
    words = (t.removesuffix("</w>") for t, _ in sorted(ids.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    return [w for w in words if len(w) >= 3 and w.isalpha() and w.isascii()]


def corpus_words(docs: DataFrame, limit: int = CORPUS_WORDS) -> list[str]:
    """The words of letters alone that all documents have most often, ``limit`` at most, commonest first, then by alphabet.

    A histogram of their counts tells from which count on they are few enough, so that no more than these
    are collected; words of one count, or of one class of great counts, are all taken or all left.
    """
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")
    counts = docs.select(word).where(F.col("w").rlike(rf"^\p{{L}}{{3,{LONGEST}}}$")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.withColumn("class", F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(1024 + 64 * (F.log2("n") - 10)))), "words")
    total, least = 0, None
    for r in sorted(counts.groupBy("class").count().collect(), reverse=True):  # some thousand classes at most
        total += r["count"]
        if total > limit:
            break
        least = r["class"]
    found = [] if least is None else counts.where(F.col("class") >= least).select("n", "w").collect()
    return [r["w"] for r in sorted(found, key=lambda r: (-r["n"], r["w"]))]


def dictionary(*ranked: list[str]) -> dict[str, int]:
    """Best rank of each word over lists, commonest first; of ``WORDS`` too."""
    out = dict(RANK)
    for words in ranked:
        for i, w in enumerate(words, 1):
            if i < out.get(w, i + 1):
                out[w] = i
    return out


def _brute(c: str) -> float:
    if c.isascii():
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 2.0


def is_name(value: str, parts: list[tuple[str, int, int]]) -> bool:
    """Whether a segmentation has words and single separators between them only, two words at least."""
    kinds = [k for k, _, _ in parts]
    marks = all(k == "word" or (k == "brute" and e - s == 1 and value[s] in SEPARATORS) for k, s, e in parts)
    return marks and kinds.count("word") >= 2 and "brute" in kinds and kinds[0] == kinds[-1] == "word"


def guess_cost(value: str, words: dict[str, int] = RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses of the cheapest segmentation, and its segments (kind, start, end).

    Two costs are kept at each place: the last segment is brute force and may go on, or isn't.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    ends: list[list[tuple[float, int, str]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = words.get(low[i:j])
            if rank is not None:
                ends[j].append((math.log10(rank + 1) + (value[i:j] != low[i:j]) * 0.6, i, "word"))
            elif (rank := words.get(plain[i:j])) is not None:
                ends[j].append((math.log10(rank + 1) + 1.0, i, "word"))
        if value[i].isdigit() and (m := DATE.match(value, i)):
            ends[m.end()].append((math.log10(150 if m.end() - i == 4 else 365 * 150) + (not value[i : m.end()].isdigit()) * 0.6, i, "date"))
    for kind, same, base in (("repeat", lambda a, b: a == b, 1.6), ("sequence", lambda a, b: abs(ord(a) - ord(b)) == 1, 1.6), ("walk", lambda a, b: b in NEAR.get(a, ()), 2.0)):
        i = 0
        while i < n:
            j = i
            while j + 1 < n and same(low[j], low[j + 1]):
                j += 1
            if j - i >= 2:
                turn = 0.35 * (j - i) if kind == "walk" else 0.0
                ends[j + 1].append((base + math.log10(j - i + 1) + turn, i, kind))
            i = max(j, i + 1)
    for width in (2, 3, 4):  # a group that comes again at once
        i = 0
        while i + 2 * width <= n:
            j = i + width
            while low[j : j + width] == low[i : i + width]:
                j += width
            if j > i + width:
                each = sum(map(_brute, value[i : i + width]))
                ends[j].append((each + math.log10((j - i) / width), i, "repeat"))
                i = j - width + 1
            else:
                i += 1
    inf = math.inf
    done, open_ = [inf] * (n + 1), [inf] * (n + 1)
    back: list[tuple] = [()] * (n + 1)
    since = [0] * (n + 1)
    done[0] = -SEGMENT
    best = [(-SEGMENT, 0)] + [(inf, 0)] * n
    for j in range(1, n + 1):
        step = _brute(value[j - 1])
        fresh, on = best[j - 1][0] + SEGMENT + step, open_[j - 1] + step
        open_[j], since[j] = (on, since[j - 1]) if on <= fresh else (fresh, j - 1)
        for cost, i, kind in ends[j]:
            if (c := best[i][0] + SEGMENT + cost) < done[j]:
                done[j], back[j] = c, (kind, i)
        best[j] = (done[j], 0) if done[j] <= open_[j] else (open_[j], 1)
    out, j = [], n
    while j:
        kind, i = ("brute", since[j]) if best[j][1] else back[j]
        out.append((kind, i, j))
        j = i
    return max(0.0, best[n][0]), out[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]


def guess_spans(text: str, min_log10: float, words: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".)]}!?")
        if len(value) < 6:
            continue
        cost, parts = guess_cost(value, words)
        if cost >= min_log10 and not is_name(value, parts):
            out.append(("guess", m.start(1), m.start(1) + len(value)))
    return out


def _rows_with_hex(b: Block) -> np.ndarray:
    """Rows that have a run of 16 or more hexadecimal bytes."""
    on = HEX_BYTES[b.data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    long = edge[::2][edge[1::2] - edge[::2] >= 16]  # a run over a row's end is harmless: rows are only scanned
    flags = np.zeros(b.n, bool)
    for s, e in zip(long.tolist(), (edge[1::2][edge[1::2] - edge[::2] >= 16]).tolist()):
        a, z = np.searchsorted(b.offsets, [s, e - 1], side="right") - 1
        flags[a : z + 1] = True
    return flags


def scan_secrets(docs: DataFrame, min_log10: float = 10.0, words: dict[str, int] | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then kind; one row per input row.

    ``words``: a dictionary to use instead of the vocabulary's and the corpus's.
    """
    ship_package(docs.sparkSession)
    words = dictionary(vocabulary_words(vocabulary), corpus_words(docs)) if words is None else words
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        words = shared.value
        for batch in batches:
            for part in blocks(batch, "text"):
                flags = _rows_with_hex(Block(part.column(1)))
                out = []
                for text, hexed in zip(part.column(1).to_pylist(), flags.tolist()):
                    found = []
                    if text:
                        low = text.lower()
                        hint = any(h in low for h in HINTS)
                        if hint or hexed or "AKIA" in text:
                            found = base_spans(text) + (guess_spans(text, min_log10, words) if hint else [])
                            found.sort(key=lambda s: (s[1], KINDS[s[0]], s[2]))
                    out.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def mask_secrets(text: str, spans: list[tuple[str, int, int]], mask: str = "[REDACTED]") -> str:
    """The text with each span, or each union of spans that overlap, replaced."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def span_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
