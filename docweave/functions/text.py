"""Text functions as Column expressions: everything here stays inside the JVM.

``fold`` lower-cases, undoes compatibility signs and deletes combining marks, whether a letter comes
composed or not, so ``tokens`` of it equal those of ``fold_text``. Signs that decompose into nothing of
ASCII (Hangul syllables, say) stay as they are, which no token sees.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import lexicon as L


def _signs() -> tuple[str, str, dict[str, str]]:
    """Signs that fold to one ASCII character, and these, then combining marks; signs that fold to several."""
    ones, marks, several = [], [], {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        d = fold_text(c)
        if c.lower() != c or d == c or not any(x.isascii() and x.isprintable() for x in d):
            continue
        if len(d) == 1:
            ones.append((c, d))
        elif any(x.isascii() and x.isalnum() for x in d):
            several[c] = d
    return "".join(c for c, _ in ones) + "".join(marks), "".join(d for _, d in ones), several


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_text(text: str) -> str:
    """The exact fold of a Python string."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


FROM, TO, SEVERAL = _signs()


def _ranges(signs) -> str:
    """A character class of the signs, neighbours joined."""
    codes, out = sorted(map(ord, signs)), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in out) + "]"


_SEVERAL = _ranges(SEVERAL)
_NAMED = "\n".join(f"{c}\t{d}" for c, d in SEVERAL.items())


def _apart(x: Column) -> Column:
    """Signs that fold to several characters, written out; the map is one literal."""
    pieces = F.regexp_extract_all(x, F.lit(f"{_SEVERAL}|[^{_SEVERAL[1:-1]}]+"), F.lit(0))
    named = F.str_to_map(F.lit(_NAMED), F.lit("\n"), F.lit("\t"))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(named, p), p)), "")


def fold(c: Column | str) -> Column:
    """``c`` stands once in the expression, so that folds of long expressions keep plans small."""
    lower = F.array(F.lower(as_col(c)))
    return F.transform(lower, lambda x: F.translate(F.when(x.rlike(_SEVERAL), _apart(x)).otherwise(x), FROM, TO))[0]


def fold_exact(c: Column | str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fold_text, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def _words(c: Column | str) -> Column:
    """Maximal runs of two or more of a-z and 0-9 in the folded text; null reads as none."""
    return F.regexp_extract_all(fold(F.coalesce(as_col(c), F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def tokens(c: Column | str, stopwords: bool = True) -> Column:
    """The words of a text in order, without stopwords if ``stopwords`` is to be applied."""
    return F.filter(_words(c), lambda w: ~w.isin(L.STOPWORDS)) if stopwords else _words(c)


def unique_terms(c: Column | str) -> Column:
    """Distinct tokens in order of first sight: one pass with a hash set."""
    return F.array_except(_words(c), F.array(*map(F.lit, L.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct terms: two empty ones are equal, an empty one equals nothing else."""
    both, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s terms that ``b`` has; 0 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def near_duplicate(a: Column, b: Column, threshold: float) -> Column:
    """Whether ``a`` repeats ``b``: alike, or, with four terms or more, contained at 0.92."""
    return (jaccard(a, b) >= threshold) | ((containment(a, b) >= 0.92) & (F.size(a) >= 4))


def years(c: Column | str) -> Column:
    """All 20dd, also inside longer numbers."""
    return F.transform(F.regexp_extract_all(F.coalesce(as_col(c), F.lit("")), F.lit(r"20\d{2}"), F.lit(0)), lambda y: y.cast("int"))


def max_year(c: Column | str) -> Column:
    return F.array_max(years(c))


def collapse_prose(c: Column | str) -> Column:
    c = F.regexp_replace(as_col(c), r"[ \t]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_cell(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.replace(as_col(c), F.lit("**"), F.lit("")), r"\s+", " "))


def is_table_line(c: Column | str) -> Column:
    return as_col(c).rlike(r"^\s*\|.*\|")


def is_period_label(c: Column | str) -> Column:
    return F.trim(fold(F.replace(as_col(c), F.lit("Δ"), F.lit("δ")))).rlike(L.PERIOD_LABEL)


def title_block(stem: Column | str, body: Column | str) -> Column:
    """The body, under a heading made of the file's stem unless it has one."""
    body = F.regexp_replace(as_col(body), r"^\s+|\s+$", "")
    head = F.concat(F.lit("# "), F.trim(F.replace(as_col(stem), F.lit("_"), F.lit(" "))), F.lit("\n\n"))
    return F.when(body.startswith("#"), F.concat(body, F.lit("\n"))).otherwise(F.concat(head, body, F.lit("\n")))


def txt_to_markdown(stem: Column | str, text: Column | str) -> Column:
    parts = F.transform(F.split(F.regexp_replace(as_col(text), r"^\s+|\s+$", ""), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return title_block(stem, F.array_join(F.filter(parts, lambda p: p != ""), "\n\n"))


def content_terms(c: Column | str, drop: Column | None = None, common: Column | None = None) -> Column:
    """Distinct tokens without filler, ``drop`` and ``common`` terms, of three characters or a quarter."""
    t = F.filter(unique_terms(c), lambda w: ~w.isin(L.FILLER) & ((F.length(w) > 2) | w.rlike("^q[1-4]$")))
    for out in (drop, common):
        if out is not None:
            t = F.array_except(t, out)
    return t
