"""Functions that built-ins cannot express, on Arrow batches: common subsequences, fuzzy spans, JSON repair."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as D


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence over code points, a whole row of the table at a time: bit i of the row is
    clear where the i-th step of `a` adds to the length. Python's integers hold rows of any length."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for c in b:
        if hit := row & places.get(c, 0):
            row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


@F.pandas_udf(D.IntegerType())
def lcs_length(one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series([_lcs(a or "", b or "") for a, b in zip(one, two, strict=True)], dtype="int32")


@F.pandas_udf(D.DoubleType())
def rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence on characters; 0 if either text is empty. (The first version gave 1 if both are.)"""
    out = []
    for p, r in zip(prediction, reference, strict=True):
        n = _lcs(p or "", r or "")
        out.append(2 * n / (len(p) + len(r)) if n else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(D.StructType().add("char_start", D.IntegerType()).add("char_end", D.IntegerType()).add("similarity", D.DoubleType()))
def fuzzy_span(name: pd.Series, text: pd.Series) -> pd.DataFrame:
    """The window of the name's length that is most like it by matching blocks, if the ratio is over 0.85."""
    out = []
    for n, t in zip(name, text, strict=True):
        best = (None, None, None)
        if n and t:
            matcher, most = SequenceMatcher(autojunk=False), 0.85
            matcher.set_seq2(n)
            for i in range(len(t) - len(n) + 1):
                matcher.set_seq1(t[i : i + len(n)])
                if matcher.quick_ratio() > most and (ratio := matcher.ratio()) > most:
                    best, most = (i, i + len(n), ratio), ratio
        out.append(best)
    return pd.DataFrame(out, columns=["char_start", "char_end", "similarity"]).astype({"char_start": "Int32", "char_end": "Int32"})


@F.pandas_udf(D.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """The JSON value in a model's reply as canonical JSON: fenced or bare, with trailing commas and open brackets mended."""

    def repair(t):
        if not t:
            return None
        fenced = re.search(r"```(?:json)?\s*(.*?)```", t, re.S)
        body = fenced[1] if fenced else t
        start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
        if start < 0:
            return None
        body = re.sub(r",\s*([}\]])", r"\1", body[start:])
        open_, quoted, escaped, end = [], False, False, len(body)
        for i, c in enumerate(body):
            if escaped or c == "\\":
                escaped = not escaped and quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{[":
                open_.append("}" if c == "{" else "]")
            elif not quoted and c in "}]" and open_:
                open_.pop()
                if not open_:
                    end = i + 1
                    break
        for whole in (body[:end], re.sub(r",\s*$", "", body[:end]) + '"' * quoted + "".join(reversed(open_))):
            try:
                return json.dumps(json.loads(whole), ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
        return None

    return text.map(repair)
