"""Driver-side settings (keys, schemes, rules) as small frames whose size Spark knows.

An Arrow table becomes a local relation with an exact size, so Spark itself decides from that
size whether a join may broadcast it; nothing here forces a broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Two or three dots stand between the first and the last name of a run, as in q1..q50 or q1...50.
RUN_DOTS = (2, 3)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def numbered_name(text: str) -> tuple[str, str]:
    """What stands before the digits a name ends in, and these digits."""
    end = len(text)
    while end and text[end - 1].isdecimal():
        end -= 1
    return text[:end], text[end:]


def names_of(text: str, strict: bool = False) -> list[str]:
    """The names of a run such as q1..q50; any other text names itself.

    strict, for fields of a template: the stem stands once, at least two names, no other dots.
    """
    if ("." if strict else "..") not in text:
        return [text]
    first, last = text[: text.index(".")], text[text.rindex(".") + 1 :]
    dots = text[len(first) : len(text) - len(last)]
    (stem, low), (again, high) = numbered_name(first), numbered_name(last)
    plain = not any(c.isdecimal() for c in stem + again)
    if not (low and high and plain) or dots != "." * len(dots) or len(dots) not in RUN_DOTS:
        raise ValueError(f"{text!r} is not a run of names like q1..5")
    fewest = 2 if strict else 1
    wanted = range(int(low), int(high) + 1)
    if len(wanted) < fewest or (not stem or again if strict else again not in ("", stem)):
        raise ValueError(f"{text!r}: a run has one stem and rising numbers")
    return [f"{stem}{n}" for n in wanted]


def names_in(text: str, between: str) -> list[str]:
    """All names of a list whose parts the pattern `between` separates."""
    parts = (part.strip() for part in re.split(between, text))
    return [name for part in parts if part for name in names_of(part)]


def expand_fields(texts: Sequence[str]) -> list[str]:
    """Names with ranges such as `q1..5` written out; a name given twice is refused."""
    names = [name for text in texts for name in names_of(text, strict=True)]
    if len(set(names)) < len(names):
        raise ValueError(f"overlapping names in {list(texts)}")
    return names


def deep_merge(base: dict, override: dict) -> dict:
    """Settings with the override's leaves put over the base's; None removes a key."""
    merged = dict(base)
    for name, value in override.items():
        if value is None:
            merged.pop(name, None)
        elif isinstance(value, dict) and isinstance(merged.get(name), dict):
            merged[name] = deep_merge(merged[name], value)
        else:
            merged[name] = value
    return merged
