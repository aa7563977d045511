"""Tolerant parsing of model output, and validation of options."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def loads(raw: str | None) -> Any:
    """The first JSON object or array of a text, closing what was left open; None if there is none."""
    s = re.sub(r"^\s*```[a-zA-Z]*|```\s*$", "", raw or "").strip()
    start = min((i for i in (s.find("{"), s.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    s = s[start:]
    try:
        return json.JSONDecoder().raw_decode(s)[0]
    except ValueError:
        pass
    places, stack, quoted, skip = [], [], False, False
    for i, c in enumerate(s):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
        if not quoted and c in ',}]"0123456789el':
            places.append((i + (c != ","), list(stack)))
    tries = [(s + '"' * quoted, stack)] + [(s[:i], open_) for i, open_ in places[::-1][:50]]
    for text, open_ in tries:
        try:
            return json.loads(text + "".join(open_[::-1]))
        except ValueError:
            continue
    return None


def as_text(value: Any) -> str:
    """An answer of any shape as text: sections of a mapping with titles, lists as bullets."""
    if value is None:
        return ""
    if isinstance(value, dict):
        return "\n\n".join(f"{str(k).replace('_', ' ').title()}:\n{as_text(v)}" for k, v in value.items() if as_text(v))
    if isinstance(value, (list, tuple)):
        return "\n".join(f"- {as_text(v)}" for v in value if as_text(v))
    return str(value).strip()


def repaired_json(c: Column) -> Column:
    """Canonical JSON of a text's first object or array; the built-in parser first, repair only where it fails."""

    @F.pandas_udf(StringType())
    def repair(x: pd.Series) -> pd.Series:
        found = x.map(loads)
        return found.map(lambda v: None if v is None else json.dumps(v, sort_keys=True, separators=(",", ":")))

    return repair(c)


def answer_text(c: Column) -> Column:
    @F.pandas_udf(StringType())
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: as_text(loads(v) if loads(v) is not None else v))

    return text(c)


# Least and greatest value of each run-time option.
LIMITS = {"workers": (1, 16), "batch_size": (1, 100), "top_n": (1, 500), "top_k": (1, 200), "rerank_k": (1, 100), "evidence_chars": (100, 5000), "embedding_dim": (128, 4096), "embed_batch": (1, 512)}


def options(given: dict[str, Any]) -> dict[str, int]:
    """Known options as integers within their limits; others and what is no number are left out."""
    out = {}
    for k, v in given.items():
        if k in LIMITS:
            try:
                out[k] = min(max(int(v), LIMITS[k][0]), LIMITS[k][1])
            except (TypeError, ValueError):
                continue
    return out
