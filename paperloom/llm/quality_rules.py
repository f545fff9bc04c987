"""Quality rules (operator 1): judge every line first, then the document by how much text its lines lost.

Line rules, in this order; the first that applies names the reason:

``blank``        no word in the line (kept as it is; it counts neither as kept nor as lost)
``boilerplate``  an earlier line of the document is equal to it, or it holds a stock phrase of web pages
``navigation``   separators (``|``, ``>``, ``<``) between items make up a large share of its words
``symbols``      more symbols ``#*$%&|<>`` than ``max_symbol_share`` of its words
``punctuation``  it does not end like a sentence and holds no sentence end inside either

A document is rejected when it fails the base checks (too few words, or mostly repeated three-word windows) or when
the failing lines hold more than ``max_lost_share`` of its characters. A kept document's ``clean_text`` is the text
without its failing lines.

Null texts count as empty; an empty text has 0 words and is rejected by the base check. Repeated rows are judged alike,
each for itself. Every row is judged alone inside one Arrow batch, so there is no shuffle and no skew; a very long text
is bounded by its own row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import give_back

SYMBOLS = b"#*$%&|<>"

#: Stock phrases of pages around the text, in English, German, French and Spanish; compared in lower case. Fixed values.
STOCK_PHRASES = (
    "accept all cookies",
    "accepter tous les cookies",
    "aceptar todas las cookies",
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "all rights reserved",
    "conditions d'utilisation",
    "datenschutzerklärung",
    "click here to",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "mentions légales",
    "nutzungsbedingungen",
    "política de privacidad",
    "politique de confidentialité",
    "privacy policy",
    "sign up for our newsletter",
    "skip to main content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "todos los derechos reservados",
    "tous droits réservés",
    "términos de uso",
)

#: A sentence end: a closing mark, quotes and brackets, then white space or the line's end; or a colon at the line's end.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*(?:[ \t\r\f\v]|$)|[:;][ \t\r\f\v]*$"
_SENTENCE_END = re.compile(SENTENCE_END)


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_share: float = 0.1
    max_separator_share: float = 0.2
    max_lost_share: float = 0.4


def line_failure(line: str, seen: set[str], p: QualityParams) -> str | None:
    """The rule that the line fails, or None. ``seen`` holds the document's earlier lines that have a word."""
    raw = line.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return None
    if line in seen:
        return "boilerplate"
    lower = line.lower()
    if len(words) <= 40 and any(x in lower for x in STOCK_PHRASES):
        return "boilerplate"
    separators = raw.count(b"|") + raw.count(b">") + raw.count(b"<")
    if separators >= 2 and separators > p.max_separator_share * len(words):
        return "navigation"
    if len(raw) - len(raw.translate(None, SYMBOLS)) > p.max_symbol_share * len(words):
        return "symbols"
    return None if _SENTENCE_END.search(line) else "punctuation"


def judge(text: str | None, p: QualityParams) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_share, reasons, clean)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at x20 and x09-x0D exactly
    n_words = len(words)
    blanks = sum(raw.count(bytes([b])) for b in b"\x20\x09\x0a\x0b\x0c\x0d")
    word_chars = len(text) - blanks
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    n_repeat = 0
    if len(set(windows)) < len(windows):
        counts, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                n_repeat += i + 3 - max(i, end)
                end = i + 3
    n_dup, lost, reasons, kept_lines, seen = 0, 0, Counter(), [], set()
    for line in text.split("\n"):
        why = line_failure(line, seen, p)
        if line in seen:
            n_dup += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
        if why:
            lost += len(line)
            reasons[why] += 1
        else:
            kept_lines.append(line)
    base_failed = n_words < p.min_words or 100 * n_repeat > p.max_repeat_percent * n_words
    lost_share = lost / len(text) if text else 0.0
    kept = not base_failed and lost_share <= p.max_lost_share
    told = ",".join(f"{k}:{v}" for k, v in sorted(reasons.items()))
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, lost_share, told, "\n".join(kept_lines)


RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("lost_share", pa.float64()),
        ("failed_lines", pa.string()),
        ("clean_text", pa.string()),
    ]
)
RESULT_DDL = (
    "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,"
    "kept:boolean,lost_share:double,failed_lines:string,clean_text:string>"
)


def quality_rules(docs: DataFrame, text: str = "text", params: QualityParams | None = None, clean: bool = True, into: str = "quality") -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``into`` of the figures, the verdict and the clean text.

    A column that has the name ``into`` is replaced; all others stay.

    ``clean=False`` leaves ``clean_text`` null, for callers that need the verdict only.
    """
    p = params or QualityParams()

    @F.arrow_udf(RESULT_DDL)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([], RESULT)]
            for at in range(0, len(texts), 200):  # bounds what Python objects are made of at once
                rows = [judge(t, p) for t in texts[at : at + 200].to_pylist()]
                columns = [list(c) for c in zip(*rows, strict=True)]
                if not clean:
                    columns[-1] = [None] * len(rows)
                parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], fields=list(RESULT)))
            yield pa.concat_arrays(parts)
        give_back()

    # Marked so that a filter on the verdict does not make Spark judge every text twice.
    return docs.withColumn(into, judged.asNondeterministic()(F.col(text)))

