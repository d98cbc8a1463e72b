"""Unicode text segmentation (UAX #29): user-perceived characters, words and sentences, without tailoring.

Every kind tiles its text: the segments joined are the text.  Nothing is normalised or folded.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GRAPHEME = regex.compile(r"\X")
_WORD_EDGE = regex.compile(r"(?V1w)\b")

_PARAGRAPH = r"(?:\r\n|[\p{SB=Sep}\p{SB=CR}\p{SB=LF}])"
_IGNORED = r"[\p{SB=Extend}\p{SB=Format}]"
_TAIL = rf"(?:\p{{SB=Close}}{_IGNORED}*+)*+(?:\p{{SB=Sp}}{_IGNORED}*+)*+"
_CASED = rf"[\p{{SB=Upper}}\p{{SB=Lower}}]{_IGNORED}*"
_CONTINUES = r"[\p{SB=SContinue}\p{SB=STerm}\p{SB=ATerm}]"
_NEUTRAL = r"[^\p{SB=OLetter}\p{SB=Upper}\p{SB=Lower}\p{SB=Sep}\p{SB=CR}\p{SB=LF}\p{SB=STerm}\p{SB=ATerm}]"
_ABBREVIATION = rf"(?:(?<={_CASED})\p{{SB=ATerm}}{_IGNORED}*+(?![\p{{SB=Numeric}}\p{{SB=Upper}}])|(?<!{_CASED})\p{{SB=ATerm}}{_IGNORED}*+(?!\p{{SB=Numeric}}))"
#: What a sentence ends with: a paragraph's end, or a terminator with what closes it, unless the sentence goes on.
_SENTENCE_END = regex.compile(
    rf"{_PARAGRAPH}"
    rf"|\p{{SB=STerm}}{_IGNORED}*+{_TAIL}(?:{_PARAGRAPH}|(?!{_CONTINUES}))"
    rf"|{_ABBREVIATION}{_TAIL}(?:{_PARAGRAPH}|(?!{_CONTINUES})(?!{_NEUTRAL}*+\p{{SB=Lower}}))",
    regex.V1,
)


def graphemes(text: str) -> list[str]:
    return _GRAPHEME.findall(text)


def words(text: str) -> list[str]:
    """Everything between word boundaries, white space and punctuation too."""
    return [w for w in _WORD_EDGE.split(text) if w]


def sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _SENTENCE_END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return out if at == len(text) else [*out, text[at:]]


_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("graphemes", "words", "sentences")])


@F.pandas_udf(_COUNTS)
def segment_counts(texts: pd.Series) -> pd.DataFrame:
    """How many segments of each kind; null text has none."""
    known = [t or "" for t in texts]
    return pd.DataFrame({"graphemes": [len(graphemes(t)) for t in known], "words": [len(words(t)) for t in known], "sentences": [len(sentences(t)) for t in known]})


@F.pandas_udf(T.LongType())
def grapheme_count(texts: pd.Series) -> pd.Series:
    return pd.Series([len(graphemes(t or "")) for t in texts], dtype="int64")
