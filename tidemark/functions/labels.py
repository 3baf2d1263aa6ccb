"""Series identity and label matching, as column expressions."""

from __future__ import annotations

import functools
import json
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import BadRequest


def labels_key(labels: Column) -> Column:
    """A string equal for equal label sets, whatever their order; Parquet can be filtered by it."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def check_labels(labels: dict[str, str]) -> None:
    for k, v in labels.items():
        if not isinstance(k, str) or not isinstance(v, str):
            raise BadRequest(f"a label and its value are strings, not {k!r} and {v!r}")


def labels_column(labels: dict[str, str]) -> Column:
    """A label set as a literal map."""
    check_labels(labels)
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def labels_from_json(text: Column) -> Column:
    """A JSON object as labels; null where the text is none."""
    return F.from_json(text, "map<string,string>")


def labels_literal(labels: dict[str, str]) -> str:
    """What labels_key gives for this label set: as a constant, a filter by it reaches the Parquet scan."""
    check_labels(labels)
    text = json.dumps([{"key": k, "value": v} for k, v in sorted(labels.items())], ensure_ascii=False, separators=(",", ":"))
    return re.sub(r"\\(?:u[0-9a-f]{4}|.)", lambda m: "\\u" + m[0][2:].upper() if m[0][1] == "u" else m[0], text)


def has_labels(labels: dict[str, str]) -> Column:
    """The label set is exactly this one."""
    return F.col("labels_key") == F.lit(labels_literal(labels))


def _members(body: str) -> str:
    """The inside of a Java character class for what stands between brackets; empty if nothing can match."""
    out, i = [], 0
    escape = lambda c: c if c.isalnum() else "\\" + c
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                out.append(f"{escape(low)}-{escape(high)}")
            i += 3
        else:
            out.append(escape(body[i]))
            i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """A shell-style pattern (*, ?, [seq], [!seq]) as a Java expression for the whole string."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            first = i + 1 if i < len(pattern) and pattern[i] == "!" else i
            close = pattern.find("]", first + 1)  # a bracket in the first place is a member
            if close < 0:
                out.append("\\[")
                continue
            members = _members(pattern[first:close])
            if first > i:
                out.append(f"[^{members}]" if members else ".")
            else:
                out.append(f"[{members}]" if members else "(?!)")
            i = close + 1
        else:
            out.append(c if c.isalnum() or c == "_" else "\\" + c)
    return "^(?s:" + "".join(out) + r")\z"


def matches(matchers: dict[str, str]) -> Column:
    """All patterns match; a label that a series lacks counts as empty."""
    tests = [F.coalesce(F.col("labels")[F.lit(k)], F.lit("")).rlike(glob_regex(p)) for k, p in matchers.items()]
    return functools.reduce(operator.and_, tests, F.lit(True))
