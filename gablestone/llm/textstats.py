"""Statistics of whole texts, used by the quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestone.llm.common import parts

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars_all", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct_words", "n_capital_words", "n_long_words", "n_ends",
)
SCHEMA = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])
_CLASS = bytes(1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b < 128 and not (b < 33 or b == 127) else 0 for b in range(256))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit += i + 3 - max(i, end)
            end = i + 3
    return hit


def stats(text: str | None) -> tuple[int, ...]:
    """The counts of one text; words are ``[^\\x20\\x09-\\x0D]+``. A null text has none."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = raw.translate(_CLASS)
    distinct = set(words)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(text),
        len(lines),
        kinds.count(1),
        kinds.count(2),
        kinds.count(3),
        kinds.count(4),
        len(distinct),
        sum(w[:1].isupper() for w in words),
        sum(len(w) > 12 for w in words),
        text.count(". ") + text.count(".\n") + text.endswith("."),
    )


def _columns(texts: pa.Array) -> pa.Array:
    rows = [stats(t) for t in texts.to_pylist()]
    cols = zip(*rows) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(COUNTS))


def _text_stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A struct of COUNTS for each whole text."""
    for texts in parts(batches):
        yield _columns(texts)


#: Marked as not deterministic so that a filter on its result doesn't run it a second time.
text_stats = F.arrow_udf(_text_stats, SCHEMA).asNondeterministic()


def ratio(a, b):
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))
