"""Multi-level collation keys from what Python's Unicode data gives: base letters, marks, case.

Without the standard's element tables the primary order is that of folded base letters, which agrees with it for
alphabets whose letters are in code point order.  Shifted keys ignore punctuation on the first levels.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sort_key(text: str, shifted: bool = False) -> str:
    """Levels in hex, separated by a zero: base letters, marks, case, then the text itself as a last resort."""
    base, marks, case, ignored = [], [], [], []
    for c in unicodedata.normalize("NFD", text):
        kind = unicodedata.category(c)
        if kind[0] == "M":
            marks.append(f"{len(base):04x}{ord(c):06x}")
        elif shifted and kind[0] in "PZS":
            ignored.append(f"{len(base):04x}{ord(c):06x}")
        else:
            base += [f"{ord(f):06x}" for f in c.casefold()]
            case.append("1" if c != c.casefold() else "0")
    return "0".join(("".join(base) + "!", "".join(marks) + "!", "".join(case) + "!", "".join(ignored) + "!"))


def collation_key(shifted: bool = False):
    @F.pandas_udf(T.StringType())
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sort_key(t, shifted))

    return key
