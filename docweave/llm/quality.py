"""Quality rules: surface counts plus distribution divergence from language references.

``language_references`` counts, over all documents that pass the base rule, how each language uses
character classes and words. A language's common words are those that make up at least one in
``common_share`` of its words, so there are at most so many of them, whatever their length. ``score_quality``
compares each document's two histograms with those of its language by Jensen-Shannon distance.

A language of fewer than ``min_reference_words`` words can't be its own measure: its documents are compared
with all documents together, by character classes that don't depend on the script, and not by words.

Defined results: a null text counts as empty (no words, fails the base rule); a null language is
``''``; languages beyond the ``max_languages`` largest are treated like small ones; a document of fewer than
``min_words`` words, or of a corpus without any that pass, is judged by the base rule alone. Repeated rows and
rows with a null doc_id are judged alike and all returned. Output columns replace input columns of their name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.textblock import Block, blocks, cover, in_one_row, lut_is_space, lut_lower, mix, span_hash, window_hash
from docweave.runtime import cut, ship_package

SPACE, LOWER = lut_is_space(), lut_lower()
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Character classes: lower, upper, digit, white space, sentence marks, symbols, other ASCII, non-ASCII.
CLASSES = np.full(256, 6, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 0, 1, 2
CLASSES[SPACE] = 3
CLASSES[list(b".,;:?'\"()-")] = 4
CLASSES[list(b"!#*$%&|<>/\\@[]{}=+~^_`")] = 5
CLASSES[0xC0:] = 7
N_CLASSES = 8
#: Letters of any script, digits, white space, marks, symbols and other signs.
SCRIPTLESS = np.array([0, 0, 1, 2, 3, 4, 5, 0])
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True  # a continuation byte belongs to the code point before it


@dataclass(frozen=True)
class QualityRules:
    """``min_words``: the length guard of the divergence test. Distances lie in 0..1; README has the limits' figures."""

    base_min_words: int = 50
    max_repeat_percent: int = 50
    min_words: int = 50
    common_share: int = 400
    min_reference_words: int = 10_000
    max_languages: int = 256
    max_class_distance: float = 0.3
    max_word_distance: float = 0.45


def _per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n).astype(np.int64) if values is not None else np.bincount(row, minlength=n)


def _repeated(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys within rows: which occur twice or more in their row; which are not the first there."""
    both = mix(keys + mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = s[1:] == s[:-1]
    twice, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def _classes(b: Block) -> np.ndarray:
    """Code points of each class, per row."""
    lead = ~CONTINUES[b.data]
    row = np.repeat(np.arange(b.n), np.diff(b.offsets))
    return np.bincount((row * N_CLASSES + CLASSES[b.data])[lead], minlength=b.n * N_CLASSES).reshape(b.n, N_CLASSES)


def _folded(b: Block, starts, ends) -> np.ndarray:
    """A hash of each word with A-Z lower-cased."""
    return span_hash(LOWER[b.data], starts, ends).view(np.int64)


def _repeat_words(b: Block, starts, ends, row) -> np.ndarray:
    words = window_hash(span_hash(b.data, starts, ends), 3)
    ok = np.flatnonzero(in_one_row(row, 3))
    twice, _ = _repeated(words[ok], row[ok])
    return np.bincount(row[cover(ok[twice], 3, len(row))], minlength=b.n)


def _fails(n_words: np.ndarray, n_repeat: np.ndarray, rules: QualityRules) -> np.ndarray:
    return (n_words < rules.base_min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)


def base_counts(b: Block) -> dict[str, np.ndarray]:
    starts, ends, row = b.spans(SPACE)
    lead = np.concatenate([[0], np.cumsum(~CONTINUES[b.data])])
    ls, le, lrow = b.line_spans()
    word_at = np.concatenate([[0], np.cumsum(~SPACE[b.data])])
    full = word_at[le] > word_at[ls]
    ls, le, lrow = ls[full], le[full], lrow[full]
    _, later = _repeated(span_hash(b.data, ls, le), lrow)
    sym = np.flatnonzero(SYMBOLS[b.data])
    return {
        "n_words": _per_row(None, row, b.n),
        "word_chars": _per_row(lead[ends] - lead[starts], row, b.n),
        "n_symbols": np.bincount(np.searchsorted(b.offsets, sym, side="right") - 1, minlength=b.n),
        "n_dup_lines": np.bincount(lrow[later], minlength=b.n),
        "n_repeat_words": _repeat_words(b, starts, ends, row),
        "_words": (starts, ends, row),
    }


class _Counts:
    """Word counts of one task per language, merged by sorting when enough have come together."""

    def __init__(self, limit: int = 1 << 18):
        self.limit, self.parts, self.size = limit, {}, 0

    def add(self, lang: str, words: np.ndarray) -> None:
        v, n = np.unique(words, return_counts=True)
        self.parts.setdefault(lang, []).append((v, n))
        self.size += len(v)

    def full(self) -> bool:
        """Whether the counts should be emitted: if merging alone doesn't make them fewer than the limit."""
        if self.size <= self.limit:
            return False
        self.parts = {k: [self.merged(k)] for k in self.parts}
        self.size = sum(len(p[0][0]) for p in self.parts.values())
        return self.size > self.limit // 2

    def merged(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        v, which = np.unique(np.concatenate([p[0] for p in self.parts[lang]]), return_inverse=True)
        return v, np.bincount(which, weights=np.concatenate([p[1] for p in self.parts[lang]])).astype(np.int64)


def language_references(docs: DataFrame, rules: QualityRules = QualityRules()) -> dict[str, dict]:
    """Per language: class shares, the common words and their shares; ``None`` keys all documents' classes.

    Workers count classes and words per language and emit partial sums. What reaches the driver is at
    most ``common_share`` words and the classes of each of ``max_languages`` languages.
    """
    ship_package(docs.sparkSession)
    schema = "lang string, kind int, item long, n long"
    names = ["lang", "kind", "item", "n"]

    def run(batches):
        held, classes = _Counts(), {}

        def emit():
            for lang in held.parts:
                v, n = held.merged(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(v), np.int32))), pa.array(np.ones(len(v), np.int32)), pa.array(v), pa.array(n)], names)

        for batch in batches:
            for part in blocks(batch, "text"):
                b = Block(part.column(0))
                starts, ends, row = b.spans(SPACE)
                n_words = np.bincount(row, minlength=b.n)
                good = ~_fails(n_words, _repeat_words(b, starts, ends, row), rules)
                langs, idx = np.unique(np.array([x or "" for x in part.column(1).to_pylist()], dtype=object).astype(str), return_inverse=True)
                counts, words = _classes(b), _folded(b, starts, ends)
                for i, lang in enumerate(langs.tolist()):
                    mine = good & (idx == i)
                    if mine.any():
                        classes[lang] = classes.get(lang, 0) + np.concatenate([counts[mine].sum(0), [n_words[mine].sum()]])
                        held.add(lang, words[mine[row]])
                if held.full():
                    yield from emit()
                    held = _Counts()
        yield from emit()
        rows = [(k, 0, i, int(n)) for k, v in classes.items() for i, n in enumerate(v)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names)

    parts = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, schema)
    by_lang = cut(parts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "langref")
    totals = by_lang.where(f"kind = 0 and item = {N_CLASSES} and n >= {rules.min_reference_words}").select("lang", F.col("n").alias("total"))
    largest = totals.orderBy(F.desc("total"), "lang").limit(rules.max_languages)
    every = by_lang.join(F.broadcast(largest), "lang").where(f"kind = 0 or n * {rules.common_share} >= total").select("lang", "kind", "item", "n")
    whole = by_lang.where("kind = 0").groupBy("kind", "item").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "item", "n")
    out: dict = {}
    for lang, kind, item, n in every.unionByName(whole).collect():
        out.setdefault(lang, {0: {}, 1: {}})[kind][item] = n
    refs = {}
    for lang, d in out.items():
        total = d[0].get(N_CLASSES, 0)
        cls = np.array([d[0].get(i, 0) for i in range(N_CLASSES)], float)
        items = sorted(d[1])
        cnt = np.array([d[1][i] for i in items] + [total - sum(d[1].values())], float)
        refs[lang] = {"classes": (cls / max(1.0, cls.sum())).tolist(), "words": items, "shares": (cnt / max(1.0, cnt.sum())).tolist()}
    return refs


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p and q; rows are shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0.0, 1.0))


def _judge(b: Block, langs: list, refs: dict, rules: QualityRules) -> dict[str, np.ndarray]:
    c = base_counts(b)
    starts, ends, row = c.pop("_words")
    words = _folded(b, starts, ends)
    classes = _classes(b).astype(float)
    classes /= np.maximum(1, classes.sum(1))[:, None]
    class_js, word_js = np.zeros(b.n), np.zeros(b.n)
    keys = [x if x in refs else None for x in ((y or "") for y in langs)]
    for lang in set(keys):
        ref = refs.get(lang)
        if ref is None:
            continue
        rows = np.flatnonzero([k == lang for k in keys])
        own, known = classes[rows], np.array(ref["classes"])[None, :]
        if lang is None:
            fold = np.eye(int(SCRIPTLESS.max()) + 1)[SCRIPTLESS]
            class_js[rows] = js_distance(own @ fold, known @ fold)
            continue
        class_js[rows] = js_distance(own, known)
        items = np.array(ref["words"], np.int64)
        k = len(items)
        local = np.full(b.n, -1)
        local[rows] = np.arange(len(rows))
        mine = local[row] >= 0
        at = np.minimum(np.searchsorted(items, words[mine]), max(0, k - 1))
        hit = items[at] == words[mine] if k else np.zeros(int(mine.sum()), bool)
        hist = np.bincount(local[row[mine]][hit] * (k + 1) + at[hit], minlength=len(rows) * (k + 1)).reshape(len(rows), k + 1).astype(float)
        hist[:, k] = c["n_words"][rows] - hist[:, :k].sum(1)
        hist /= np.maximum(1, hist.sum(1))[:, None]
        word_js[rows] = js_distance(hist, np.array(ref["shares"])[None, :])
    c["base_failed"] = _fails(c["n_words"], c["n_repeat_words"], rules)
    diverges = (c["n_words"] >= rules.min_words) & ((class_js > rules.max_class_distance) | (word_js > rules.max_word_distance))
    return c | {"kept": ~c["base_failed"] & ~diverges, "class_js": class_js, "word_js": word_js}


SCORES = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_js", pa.float64()), ("word_js", pa.float64())]
_DDL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


def score_quality(docs: DataFrame, rules: QualityRules = QualityRules(), refs: dict | None = None) -> DataFrame:
    """doc_id with the base counts, both distances and the verdict ``kept``; one row per input row."""
    ship_package(docs.sparkSession)
    refs = language_references(docs, rules) if refs is None else refs

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                got = _judge(Block(part.column(1)), part.column(2).to_pylist(), refs, rules)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[k], t) for k, t in SCORES)], ["doc_id", *(k for k, _ in SCORES)])

    schema = "doc_id long, " + ", ".join(f"{k} {_DDL[t]}" for k, t in SCORES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules(), refs: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in one pass over the texts."""
    ship_package(docs.sparkSession)
    refs = language_references(docs, rules) if refs is None else refs

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                at = part.schema.get_field_index
                got = _judge(Block(part.column(at("text"))), part.column(at("lang")).to_pylist(), refs, rules)
                yield part.filter(pa.array(got["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return score_quality(docs).select(*cols, F.round("class_js", 6).alias("class_js"), F.round("word_js", 6).alias("word_js"))


def _oracle(rules: QualityRules = QualityRules()) -> str:
    chars = ["[a-z]", "[A-Z]", "[0-9]", r"[\t-\r ]", r"[.,;:?''\"()-]", r"[!#*$%&|<>/\\@\[\]{}=+~^_`]", r"[\x00-\x08\x0e-\x1f\x7f]", r"[^\x00-\x7f]"]
    counts = ", ".join(f"len(regexp_replace(t, '{c.replace('[', '[^', 1) if not c.startswith('[^') else c.replace('[^', '[', 1)}', '', 'g'))" for c in chars)
    shares = lambda x: f"list_transform({x}, lambda v: v / greatest(list_sum({x}), 1)::double)"
    js = lambda p, q: f"sqrt(greatest(0, least(1, (list_sum(list_transform(list_zip({p}, {q}), lambda z: case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end)) + list_sum(list_transform(list_zip({p}, {q}), lambda z: case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end))) / 2)))"
    coarse = lambda x: f"[{x}[1] + {x}[2] + {x}[8], {x}[3], {x}[4], {x}[5], {x}[6], {x}[7]]"
    return rf"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\t-\r ]+') as w from documents
), tri as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d
), grams as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from tri
), rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 3)) as j from grams where c > 1) group by 1
), lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d
), dup as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\t-\r ]') group by 1
), base as (
  select d.*, len(w)::bigint as n_words, len(regexp_replace(t, '[\t-\r ]', '', 'g'))::bigint as word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, [{counts}] as cls
  from d left join dup using (doc_id) left join rep using (doc_id)
), judged as (select *, n_words < {rules.base_min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from base
), words as (select doc_id, lang, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word from (select doc_id, lang, unnest(w) as u from judged where not base_failed)
), sums as (select lang, sum(n_words) as total, [{', '.join(f'sum(cls[{i}])' for i in range(1, 9))}] as cls from judged where not base_failed group by lang
), large as (select * from sums where total >= {rules.min_reference_words} order by total desc, lang limit {rules.max_languages}
), pooled as (select [{', '.join(f'sum(cls[{i}])' for i in range(1, 9))}] as cls from sums
), common as (select lang, word, count(*) as n, any_value(total) as total from words join large using (lang) group by lang, word having count(*) * {rules.common_share} >= any_value(total)
), rest as (select lang, any_value(total) - coalesce(sum(n), 0) as n, any_value(total) as total from (select lang, total, n from large left join common using (lang, total)) group by lang
), own as (
  select doc_id, lang, word, count(*) as n from (select doc_id, lang, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word from (select doc_id, lang, unnest(w) as u from judged)) group by all
), bins as (
  select j.doc_id, coalesce(o.n, 0) / n_words::double as p, c.n / c.total::double as q from judged j join common c using (lang) left join own o on o.doc_id = j.doc_id and o.word = c.word where n_words > 0
  union all
  select j.doc_id, (n_words - coalesce(s.n, 0)) / n_words::double, r.n / r.total::double from judged j join rest r using (lang) left join (select doc_id, sum(o.n) as n from own o join common using (lang, word) group by 1) s using (doc_id) where n_words > 0
), word_js as (
  select doc_id, sqrt(greatest(0, least(1, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2))) as js from bins group by 1
), scored as (
  select j.*, case when large.lang is not null then {js(shares('j.cls'), shares('large.cls'))} when list_sum(pooled.cls) > 0 then {js(shares(coarse('j.cls')), shares(coarse('pooled.cls')))} else 0 end as cjs,
         case when n_words > 0 or large.lang is null then coalesce(word_js.js, 0) else sqrt(0.5) end as wjs
  from judged j cross join pooled left join large using (lang) left join word_js using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (n_words >= {rules.min_words} and (cjs > {rules.max_class_distance} or wjs > {rules.max_word_distance})) as kept, round(cjs, 6) as class_js, round(wjs, 6) as word_js
from scored
"""


ORACLE = _oracle()
