"""Value semantics: blank / value / multi-mark, group columns, splits and typed casts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlake.config import names_in
from answerlake.functions import text as tx

# The kinds of a reading.
BLANK, MULTI, VALUE = "blank", "multi", "value"


@dataclass(frozen=True)
class CompareRules:
    """How two readers' values are compared."""

    blank: str = "mismatch"  # or ignore
    multi: str = "same"  # or exact, ignore
    case: bool = False
    spaces: bool = True
    blank_codes: Sequence[str] = (" ", "-")
    multi_codes: Sequence[str] = ("*",)
    duplicates: str = "newest"  # or skip


def kind_text(kind, text) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(kind).alias("kind"), lit(text).alias("text"))


def _single_or_multi(text: Column, multi: Column) -> Column:
    return F.when(multi, kind_text(MULTI, tx.sorted_letters(text))).otherwise(
        kind_text(VALUE, text)
    )


def external_value(raw: Column, rules: CompareRules, question: Column) -> Column:
    """struct<kind, text> of a cell of the other reader's file."""
    raw = F.coalesce(raw, F.lit(""))
    bare = tx.strip(raw)
    text = tx.squeeze(raw, rules.spaces, rules.case)
    multi = raw.isin(*rules.multi_codes) | (
        (bare != "") & bare.isin(*[c.strip() for c in rules.multi_codes])
    )
    blank = (
        (bare == "")
        | raw.isin(*rules.blank_codes)
        | bare.isin(*[c.strip() for c in rules.blank_codes if c.strip()])
    )
    return (
        F.when(multi, kind_text(MULTI, ""))
        .when(blank, kind_text(BLANK, ""))
        .otherwise(_single_or_multi(text, question & (F.length(text) > 1)))
    )


def our_value(
    value: Column, empty: Column, question: Column, multi_flag: Column, rules: CompareRules
) -> Column:
    """struct<kind, text> of our own value."""
    value = F.coalesce(value, F.lit(""))
    bare = tx.strip(value)
    text = tx.squeeze(value, rules.spaces, rules.case)
    is_empty = (bare == "") | ((F.coalesce(empty, F.lit("")) != "") & (value == empty))
    return (
        F.when(is_empty, kind_text(BLANK, ""))
        .when(bare.isin(*[c.strip() for c in rules.multi_codes if c.strip()]), kind_text(MULTI, ""))
        .otherwise(_single_or_multi(text, multi_flag | (question & (F.length(text) > 1))))
    )


def differs(theirs: Column, ours: Column, rules: CompareRules) -> Column:
    """True for a mismatch, False for a match, null where the rules leave the pair out."""
    tk, tt, ok, ot = theirs["kind"], theirs["text"], ours["kind"], ours["text"]
    one_blank = ((tk == BLANK) | (ok == BLANK)) & (tk != ok)
    any_multi = (tk == MULTI) | (ok == MULTI)
    both_multi = (tk == MULTI) & (ok == MULTI)
    exact = (tt != ot) & (tt != "") & (ot != "") if rules.multi == "exact" else F.lit(False)
    skipped = (one_blank & (rules.blank == "ignore")) | (any_multi & (rules.multi == "ignore"))
    return (
        F.when(skipped, F.lit(None).cast("boolean"))
        .when(both_multi, exact)
        .when(any_multi, True)
        .otherwise((tk != ok) | (tt != ot))
    )


def shown(raw: Column, kind: Column) -> Column:
    """A value as reviewers see it."""
    bare = tx.strip(F.coalesce(raw, F.lit("")))
    return (
        F.when(kind == BLANK, "").when((kind == MULTI) & (bare == ""), "*").otherwise(bare)
    )


def parse_bands(text: str) -> dict[str, list[str]]:
    """`1: q1..q50; 2: q51..q100` as level -> field names."""
    entries = [re.split("[:=]", entry, maxsplit=1) for entry in re.split(r"[;\n]", text) if entry.strip()]
    if any(len(entry) < 2 for entry in entries):
        raise ValueError("a band is written LEVEL: FIELDS")
    return {level.strip().upper(): names_in(names, r"[,\s]+") for level, names in entries}


def sheet_band(
    bands: Mapping[str, Sequence[str]], theirs: Column, ours: Column, source="theirs_then_ours"
) -> Column:
    """Field names a sheet answers by its level; null means all of them."""
    table = F.create_map(
        *[c for k, v in bands.items() for c in (F.lit(k), F.array(*map(F.lit, v)))]
    )

    def band(level: Column) -> Column:
        return F.try_element_at(table, F.upper(tx.strip(F.coalesce(level, F.lit("")))))

    one, two = band(theirs), band(ours)
    if source == "either":
        both = F.array_union(one, two)
        return F.coalesce(both, one, two)
    return {"theirs": one, "ours": two}.get(source, F.coalesce(one, two))


# ---- group columns ------------------------------------------------------------------------


def column_state(
    value: Column, flags: Column, needs_review: Column, reviewed: Column, empty: str = ""
) -> Column:
    """ok, empty, multi or issue for one bubble column of a joined value."""
    blank = (tx.strip(value) == "") | ((F.lit(empty) != "") & (value == empty))
    other = F.size(F.array_remove(flags, "empty")) > 0
    has_empty = F.array_contains(flags, "empty")
    return (
        F.when(blank & ~reviewed & needs_review & other, "issue")
        .when(blank, "empty")
        .when(reviewed, F.when(has_empty, "empty").otherwise("ok"))
        .when(F.array_contains(flags, "multi_marked"), "multi")
        .when(has_empty, "empty")
        .when(needs_review, "issue")
        .otherwise("ok")
    )


def column_flagged(state: Column, needs_review: Column) -> Column:
    return (state == "issue") | ((state == "multi") & needs_review)


def column_piece(
    value: Column, state: Column, empty: str | None = " ", multi: str = "*", issue: str | None = "-"
) -> Column:
    """What one column writes into its joined value: the value or a placeholder."""
    as_empty = F.lit(empty or "")
    kept = F.when(tx.strip(value) == "", as_empty).otherwise(value)
    return (
        F.when(state == "ok", value)
        .when(state == "empty", as_empty)
        .when(state == "multi", F.lit(multi or ""))
        .otherwise(kept if issue is None else F.lit(issue))
    )


# ---- bubble values ------------------------------------------------------------------------


def _alternatives(values: Sequence[str]) -> str:
    longest = sorted({v for v in values if v}, key=lambda v: (-len(v), v))
    return "|".join(re.escape(v) for v in longest)


def split_value(value: Column, values: Sequence[str]) -> Column:
    """Greedy longest-first split into bubble values; null when it does not fit."""
    picks = F.regexp_extract_all(value, F.lit(f"({_alternatives(values)})"), 1)
    return F.when(value.isin(*values), F.array(value)).when(
        F.array_join(picks, "") == value, picks
    )


def split_ordered(value: Column, values: Sequence[str]) -> Column:
    """0-based bubbles whose values, in order, spell the value; null when none do.

    Optional groups in order make the regex engine try the earlier bubble first.
    """
    pattern = "^" + "".join(f"({re.escape(v)})?" for v in values) + "$"
    bare = tx.strip(value)
    hits = [
        F.when(F.regexp_extract(bare, pattern, i + 1) != "", i) for i in range(len(values))
    ]
    return F.when(bare.rlike(pattern), F.array_compact(F.array(*hits)))


def toggled(value: Column, bubble: Column, values: Sequence[str], empty: str = "") -> Column:
    """The value after one bubble is toggled; marks stay in sheet order."""
    marks = F.coalesce(
        F.when(value == empty, F.array().cast("array<string>")),
        split_value(value, values),
        F.array().cast("array<string>"),
    )
    order = F.array(*map(F.lit, dict.fromkeys(values)))
    kept = F.filter(order, lambda v: F.array_contains(marks, v) != (v == bubble))
    return F.when(F.size(kept) == 0, empty).otherwise(F.array_join(kept, ""))


def distribute(value: Column, columns: Sequence[Sequence[str]], empty: str = "") -> Column:
    """A corrected joined value over its columns, one bubble value or blank each; null = misfit."""
    groups = []
    for options in columns:
        parts = [_alternatives(options), " "] + ([re.escape(empty)] if empty else []) + ["$"]
        groups.append(f"(?>({'|'.join(parts)}))")
    pattern = "^" + "".join(groups) + "$"
    cells = [F.regexp_extract(value, pattern, i + 1) for i in range(len(columns))]
    blanked = [F.when(c.isin("", " "), empty).otherwise(c) for c in cells]
    return F.when(value.rlike(pattern), F.array(*blanked))


def same_value(decoded: Column, label: Column) -> Column:
    """Equal up to blanks and leading zeros; a multi-mark never equals by tolerance."""
    d, lab = tx.strip(decoded), tx.strip(label)
    compact = F.replace(d, F.lit(" "), F.lit(""))
    numbers = compact.rlike(r"^\p{Nd}+$") & lab.rlike(r"^\p{Nd}+$")
    close = (F.ltrim(compact, F.lit("0")) == F.ltrim(lab, F.lit("0"))) & (
        F.length(compact) <= F.length(lab) + 1
    )
    return (
        F.when((decoded == label) | (d == lab), True)
        .when(d.contains("*"), False)
        .otherwise((compact == lab) | (numbers & close))
    )


# ---- typed export values ------------------------------------------------------------------

# yes/no words and the date codes of export formats.
TRUE_WORDS = ("1", "Y", "YES", "TRUE", "T", "X")
FALSE_WORDS = ("0", "N", "NO", "FALSE", "F", "")
DATE_CODES = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%H": "HH", "%M": "mm"}


def date_pattern(codes: str) -> str:
    for code, letters in DATE_CODES.items():
        codes = codes.replace(code, letters)
    return codes


def has_leading_zero(text: Column) -> Column:
    whole = F.substring_index(F.regexp_replace(text, r"^[+-]+", ""), ".", 1)
    return (F.length(whole) > 1) & whole.startswith("0")


def cast_value(value: Column, kind: str, lossy: bool = False, **options) -> Column:
    """struct<value, reason>: the typed value, or why the text was refused."""
    bare = tx.strip(value)

    def out(typed: Column, sql: str, refused: Column) -> Column:
        ok = refused.isNull()
        typed = F.when(ok & (bare != ""), typed) if sql != "boolean" else F.when(ok, typed)
        reason = F.when((bare != "") | (sql == "boolean"), refused)
        return F.struct(typed.cast(sql).alias("value"), reason.alias("reason"))

    zero = has_leading_zero(bare) if not lossy else F.lit(False)
    if kind == "text":
        return F.struct(value.alias("value"), F.lit(None).cast("string").alias("reason"))
    if kind == "int":
        refused = F.when(~bare.rlike(r"^[+-]?\d+$"), "not a whole number").when(zero, "leading zero")
        return out(bare.try_cast("bigint"), "bigint", refused)
    if kind == "decimal":
        if options.get("decimal_comma"):
            bare = F.translate(bare, ",.", ".")
            zero = has_leading_zero(bare) if not lossy else F.lit(False)
        number = bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
        refused = F.when(~number, "not a number").when(zero, "leading zero")
        return out(bare.try_cast("decimal(38,18)"), "decimal(38,18)", refused)
    if kind == "bool":
        true = F.upper(bare).isin(*map(str.upper, options.get("true", TRUE_WORDS)))
        false = F.upper(bare).isin(*map(str.upper, options.get("false", FALSE_WORDS)))
        return out(true, "boolean", F.when(~true & ~false, "not a yes/no value"))
    if kind == "date":
        typed = F.try_to_timestamp(bare, F.lit(date_pattern(options["format"]))).cast("date")
        return out(typed, "date", F.when(typed.isNull(), "not a date"))
    raise ValueError(f"unknown type {kind!r}")


def text_of(value: Column, kind: str, date_format: str = "%Y-%m-%d") -> Column:
    """A typed value as plain text; null is empty."""
    if kind == "date":
        text = F.date_format(value, date_pattern(date_format))
    elif kind == "decimal":
        plain = value.cast("string")
        text = F.when(
            plain.contains("."), F.regexp_replace(F.rtrim(plain, F.lit("0")), r"\.$", "")
        ).otherwise(plain)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def csv_guard(text: Column, mode: str = "formula") -> Column:
    """Keep spreadsheets from dropping leading zeros or digits beyond the fifteenth."""
    risky = text.rlike(r"^(0\d+|\d{16,})$")
    guarded = F.format_string('="%s"', text) if mode == "formula" else F.concat(F.lit("'"), text)
    return F.when(risky & F.lit(mode != "none"), guarded).otherwise(text)


def merge_maps(base: Column, override: Column) -> Column:
    """Flat settings with the override's entries put over the base's."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(override), k))
    return F.map_concat(kept, override)


def lab(b: Column, g: Column, r: Column) -> list[Column]:
    """CIE Lab (D65) of 8-bit BGR columns."""

    def linear(c):
        c = c / 255.0
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92)

    lr, lg, lb = linear(r), linear(g), linear(b)

    def f(v):
        return F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16.0 / 116.0)

    # sRGB to XYZ and the D65 white point.
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    return [116.0 * f(y) - 16.0, 500.0 * (f(x) - f(y)), 200.0 * (f(y) - f(z))]


def lab_distance(one: Sequence[Column], two: Sequence[Column], lightness: float = 0.5) -> Column:
    """Colour distance with lightness weighted down."""
    (l1, a1, b1), (l2, a2, b2) = lab(*one), lab(*two)
    d = lightness * (l1 - l2)
    return F.sqrt(d * d + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))
