"""Validation and cross-field checks over a sheet's readings.

A sheet's readings become one map (one shuffle by sheet, bounded by the template); every rule is
then a column over that map, so a chain of checks is a chain of projections without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.functions import text as tx

# Names of the actions, and what each does to a value that fails.
ON_FAIL = {"review": {"review"}, "blank": {"blank"}, "both": {"review", "blank"}, "flag": set()}
ON_MISSING = ("fallback", "review")
ON_CONFLICT = ("prefer", "review", "error")


@dataclass(frozen=True)
class Validation:
    """The shape a value must have; a two-item bound may leave an end open with None."""

    name: str
    length: int | tuple | None = None
    allow_gaps: bool = True
    allow_empty_ends: bool = True
    leading_zeros: str = "keep"
    pattern: str | None = None
    allowed: Sequence[str] | None = None
    range: tuple | None = None
    required: bool = False
    on_fail: str = "review"

    def __post_init__(self):
        if self.on_fail not in ON_FAIL:
            raise ValueError(f"{self.name}: {self.on_fail} is none of {sorted(ON_FAIL)}")

    def does(self, effect: str) -> bool:
        return effect in ON_FAIL[self.on_fail]


@dataclass(frozen=True)
class Check:
    """One value from several sources, in order of priority."""

    name: str
    sources: Sequence[str]
    normalize: str | tuple[str, int] = "none"
    priority: Sequence[str] = ()
    output: str = ""
    on_missing: str = "fallback"
    on_conflict: str = "prefer"
    review_on_conflict: bool = True
    review_on_fallback: bool = False
    review_on_all_missing: bool = True
    skip_invalid: bool = True
    skip_flagged: bool = False
    absorb: bool = True

    def __post_init__(self):
        if not self.sources or len(set(self.sources)) < len(self.sources):
            raise ValueError(f"{self.name}: sources must be given once each")
        if self.on_missing not in ON_MISSING or self.on_conflict not in ON_CONFLICT:
            raise ValueError(f"{self.name}: unknown on_missing or on_conflict")
        # Preferred sources first, in their order; a dict keeps the first place of each name
        order = tuple(dict.fromkeys([*self.priority, *self.sources]))
        if len(order) > len(self.sources):
            raise ValueError(f"{self.name}: a preferred name is no source")
        object.__setattr__(self, "priority", order)
        object.__setattr__(self, "output", self.output or self.name)


@dataclass(frozen=True)
class Rules:
    validations: Sequence[Validation] = ()
    checks: Sequence[Check] = ()
    groups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    empty: str = ""

    def ordered(self, known: Sequence[str]) -> list[Check]:
        """Checks after the checks they read; unknown, repeated and circular names are refused."""
        names = [c.name for c in self.checks]
        outputs = {c.output: c for c in self.checks}
        if len(set(names)) < len(names) or len(outputs) < len(names):
            raise ValueError("two checks share a name or an output")
        by_name = {c.name: c.output for c in self.checks}
        base = {*known, *self.groups}
        left: list[Check] = []
        for check in self.checks:
            if check.output in base and check.output not in check.sources:
                raise ValueError(f"{check.name}: output {check.output} hides a field")
            mapped = [s if s in base or s in outputs else by_name.get(s, s) for s in check.priority]
            unknown = [s for s in mapped if s not in base and s not in outputs]
            if unknown:
                raise ValueError(f"{check.name}: unknown source {unknown[0]}")
            left.append(replace(check, sources=tuple(mapped), priority=tuple(mapped)))
        done: list[Check] = []
        while left:
            waiting = {c.output for c in left}
            ready = [c for c in left if not (waiting - {c.output}) & set(c.sources)]
            if not ready:
                raise ValueError(f"checks read each other: {sorted(waiting)}")
            done += ready
            left = [c for c in left if c not in ready]
        return done


def fallback_checks(zones: Mapping[str, str]) -> list[Check]:
    """A check per zone that names a fallback zone; its value replaces the zone's own."""
    return [Check(f"{z}_fallback", [z, other], output=z) for z, other in zones.items()]


# ---- validation ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Bound:
    """Limits of a number, both included; a missing end is open. `text` is how reasons show it."""

    ends: tuple
    text: str

    @classmethod
    def of(cls, spec) -> Bound:
        """From one number or from [low, high]."""
        if not isinstance(spec, (tuple, list)):
            return cls((spec, spec), str(spec))
        low, high = [*spec, None, None][:2]
        # Fixed value: spelling of an interval in a reason
        return cls((low, high), "[{}, {}]".format(*("" if e is None else e for e in (low, high))))

    def misses(self, value: Column) -> Column:
        low, high = (F.lit(end) for end in self.ends)
        return F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))


def failures(rule: Validation, value: Column, empties: Column | None = None) -> Column:
    """Ordered reasons why a value fails; an all-empty value fails only when required.

    empties: emptiness per position (joined columns, character boxes); else per character.
    """
    if empties is None:
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        empties = F.transform(chars, lambda c: tx.strip(c) == "")
    n = F.size(empties)
    first = F.array_position(empties, False)
    last = n - F.array_position(F.reverse(empties), False) + 1
    places = F.filter(
        F.transform(empties, lambda e, i: F.when(e, i + 1)),
        lambda i: i.isNotNull() & (i > first) & (i < last),
    )
    size, reasons = F.length(value), []
    if rule.length is not None:
        bound = Bound.of(rule.length)
        text = F.concat(F.lit("length "), size.cast("string"), F.lit(f" not in {bound.text}"))
        reasons.append(F.when(bound.misses(size), text))
    if not rule.allow_gaps:
        listed = F.array_join(places.cast("array<string>"), ", ")
        reasons.append(F.when(listed != "", F.concat(F.lit("gap at position "), listed)))
    if not rule.allow_empty_ends:
        lead, tail = first - 1, n - last
        reasons.append(F.when(lead > 0, F.format_string("%d empty leading position(s)", lead)))
        reasons.append(F.when(tail > 0, F.format_string("%d empty trailing position(s)", tail)))
    if rule.leading_zeros == "forbid":
        reasons.append(F.when((size > 1) & value.startswith("0"), "leading zero"))
    if rule.pattern:
        reasons.append(
            F.when(~value.rlike(rf"^(?:{rule.pattern})\z"), f"does not match {rule.pattern!r}")
        )
    if rule.allowed is not None:
        reasons.append(F.when(~value.isin(*rule.allowed), "not an allowed value"))
    if rule.range is not None:
        number, bound = value.try_cast("double"), Bound.of(rule.range)
        text = F.concat(value, F.lit(f" outside {bound.text}"))
        reasons.append(F.when(number.isNull(), "not a number").when(bound.misses(number), text))
    none = F.array().cast("array<string>")
    found = F.array_compact(F.array(*reasons)) if reasons else none
    blank = F.array(F.lit("empty")) if rule.required else none
    return F.when(F.array_contains(empties, False), found).otherwise(blank)


# ---- sheets -------------------------------------------------------------------------------


def sheet_maps(readings: DataFrame) -> DataFrame:
    """One row per sheet with a map from name to reading(value, flags, needs_review)."""
    reading = F.struct("value", "flags", "needs_review")
    return readings.groupBy("scan_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", reading))).alias("read")
    )


class Run:
    """Applies rules to sheets(scan_id, read); each rule adds the columns later rules read."""

    def __init__(self, sheets: DataFrame, rules: Rules, known: Sequence[str]):
        self.df, self.rules, self.known = sheets, rules, list(known)
        self.order = rules.ordered(known)
        self.outputs: dict[str, str] = {}  # output name -> column of its check
        self.blanked: dict[str, str] = {}  # name -> column of the validation that blanks it
        self.checked: dict[str, str] = {}  # name -> column of its validation
        simple = [v for v in rules.validations if v.name not in {c.output for c in rules.checks}]
        # Fields first, so that blanked columns show in the labels joined from them
        for rule in sorted(simple, key=lambda v: v.name in rules.groups):
            self._validate(rule)
        for check in self.order:
            self._check(check)

    def reading(self, name: str, part: str) -> Column:
        return F.try_element_at("read", F.lit(name))[part]

    def base(self, name: str) -> Column:
        """The value a rule sees: a check's output, a blanked or joined value, or the reading."""
        if name in self.outputs:
            return F.col(self.outputs[name])["value"]
        if name in self.rules.groups:
            value = F.concat(*[self.base(c) for c in self.rules.groups[name]])
        else:
            value = F.coalesce(self.reading(name, "value"), F.lit(""))
        if name in self.blanked:
            failed = F.size(F.col(self.blanked[name])["reasons"]) > 0
            value = F.when(failed, self.rules.empty).otherwise(value)
        return value

    def empties(self, name: str) -> Column | None:
        if name in self.outputs or name in self.blanked or name not in self.rules.groups:
            return None
        return F.array(*[self._column_empty(c) for c in self.rules.groups[name]])

    def _column_empty(self, column: str) -> Column:
        value = self.base(column)
        flagged = F.coalesce(F.array_contains(self.reading(column, "flags"), "empty"), F.lit(False))
        return flagged | (tx.strip(value) == "") | (value == self.rules.empty)

    def missing(self, name: str, value: Column) -> Column:
        blank = (tx.strip(value) == "") | (value == self.rules.empty)
        if name in self.outputs:
            return blank
        if name in self.rules.groups:
            every = self._column_empty(self.rules.groups[name][0])
            for column in self.rules.groups[name][1:]:
                every = every & self._column_empty(column)
            return blank | every
        flag = F.array_contains(self.reading(name, "flags"), "empty")
        return blank | F.coalesce(flag, F.lit(False))

    def _validate(self, rule: Validation) -> None:
        empties, column = self.empties(rule.name), f"v_{rule.name}"
        # Columns of their own, so that each reason reads them instead of working them out again
        df = self.df.withColumn("_value", self.base(rule.name))
        df = df if empties is None else df.withColumn("_empties", empties)
        reasons = failures(rule, F.col("_value"), None if empties is None else F.col("_empties"))
        df = df.withColumn("_why", reasons)
        self.df = df.withColumn(column, F.struct(F.col("_value").alias("value"), F.col("_why").alias("reasons"))).drop("_value", "_empties", "_why")
        self.checked[rule.name] = column
        if rule.does("blank"):
            self.blanked[rule.name] = column

    def _check(self, check: Check) -> None:
        """Adds s_<check> (its sources) and c_<check> (its result)."""
        sources = []
        for place, name in enumerate(check.priority):
            raw = self.base(name)
            norm = tx.normalize(raw, check.normalize)
            missing = self.missing(name, raw) | (norm == "")
            invalid, flagged = F.lit(False), F.lit(False)
            if check.skip_invalid and name in self.checked:
                invalid = F.size(F.col(self.checked[name])["reasons"]) > 0
            if check.skip_flagged and name not in self.outputs and name not in self.rules.groups:
                flagged = F.coalesce(self.reading(name, "needs_review"), F.lit(False))
            note = F.when(missing, "missing").when(invalid, "invalid").when(flagged, "flagged")
            sources.append(
                F.struct(
                    F.lit(place).alias("place"),
                    F.lit(name).alias("source"),
                    raw.alias("raw"),
                    norm.alias("norm"),
                    note.alias("note"),
                )
            )
        s, c = f"s_{check.name}", f"c_{check.name}"
        df = self.df.withColumn(s, F.array(*sources))
        df = df.withColumn("_use", F.filter(s, lambda x: x["note"].isNull()))
        df = df.withColumn("_first", F.get("_use", F.lit(0)))
        none = F.size("_use") == 0
        conflict = F.size(F.array_distinct(F.transform("_use", lambda x: x["norm"]))) > 1
        fallback = ~none & (F.col("_first.place") > 0)
        blanked = none | (conflict & F.lit(check.on_conflict == "error"))
        flags = F.array_compact(
            F.array(
                F.when(none, "all_sources_missing"),
                F.when(conflict, "cross_check_failed"),
                F.when(fallback, "fallback_used"),
            )
        )
        review = (
            (none & F.lit(check.review_on_all_missing))
            | (fallback & F.lit(check.on_missing == "review" or check.review_on_fallback))
            | (conflict & F.lit(check.on_conflict != "prefer" or check.review_on_conflict))
        )
        value = F.when(blanked, self.rules.empty).otherwise(F.col("_first.norm"))
        rule = next((v for v in self.rules.validations if v.name == check.output), None)
        reasons = failures(rule, value) if rule else F.array().cast("array<string>")
        df = df.withColumn("_why", reasons)
        failed = F.size("_why") > 0
        if rule:
            flags = F.when(failed, F.array_append(flags, "validation_failed")).otherwise(flags)
            value = F.when(failed & F.lit(rule.does("blank")), self.rules.empty).otherwise(value)
            review = review | (failed & F.lit(rule.does("review")))
        chosen = F.when(~blanked, F.col("_first.source"))
        self.df = df.withColumn(
            c,
            F.struct(
                value.alias("value"),
                chosen.alias("chosen_source"),
                F.array_sort(flags).alias("flags"),
                review.alias("needs_review"),
                F.col("_why").alias("reasons"),
            ),
        ).drop("_use", "_first", "_why")
        self.outputs[check.output] = c

    # ---- results --------------------------------------------------------------------------

    def checks(self) -> DataFrame:
        """One row per (sheet, check)."""
        rows = [
            F.struct(
                F.lit(c.name).alias("name"),
                F.lit(c.output).alias("output"),
                F.col(f"c_{c.name}")["value"].alias("value"),
                F.col(f"c_{c.name}")["chosen_source"].alias("chosen_source"),
                F.col(f"c_{c.name}")["flags"].alias("flags"),
                F.col(f"c_{c.name}")["needs_review"].alias("needs_review"),
            )
            for c in self.order
        ]
        return self.df.select("scan_id", F.inline(F.array(*rows)))

    def sources(self) -> DataFrame:
        """One row per (sheet, check, source) with why it was not used."""

        def named(check: Check) -> Column:
            return F.transform(f"s_{check.name}", lambda s: s.withField("name", F.lit(check.name)))

        return self.df.select("scan_id", F.inline(F.concat(*[named(c) for c in self.order])))

    def validations(self) -> DataFrame:
        """One row per (sheet, validated name)."""
        specs = {v.name: v for v in self.rules.validations}
        rows = []
        for name, column in self.checked.items():
            kind = "custom_label" if name in self.rules.groups else "field"
            failed = F.size(F.col(column)["reasons"]) > 0
            rows.append(
                F.struct(
                    F.lit(name).alias("name"),
                    F.lit(kind).alias("kind"),
                    F.col(column)["value"].alias("value"),
                    (~failed).alias("ok"),
                    F.col(column)["reasons"].alias("reasons"),
                    F.when(failed, specs[name].on_fail).alias("action"),
                )
            )
        for check in self.order:
            rule = specs.get(check.output)
            if rule:
                result = F.col(f"c_{check.name}")
                failed = F.size(result["reasons"]) > 0
                rows.append(
                    F.struct(
                        F.lit(check.output).alias("name"),
                        F.lit("check").alias("kind"),
                        result["value"].alias("value"),
                        (~failed).alias("ok"),
                        result["reasons"].alias("reasons"),
                        F.when(failed, rule.on_fail).alias("action"),
                    )
                )
        none = "array<struct<name:string,kind:string,value:string,ok:boolean,reasons:array<string>,action:string>>"
        return self.df.select("scan_id", F.inline(F.array(*rows) if rows else F.array().cast(none)))

    def details(self, states: Mapping[str, Column] | None = None) -> DataFrame:
        """What a reviewer sees of a rule's result, one row per (sheet, check or validated name): value, flags, whether it waits,
        reasons, of a check the sources that hold a value (candidates, by priority), of a group the states of its columns.

        states: group name -> state by column name, see `column_states`.
        """
        parts = ("kind", "value", "flags", "needs_review", "reasons", "candidates", "group")
        candidate = lambda s: F.struct(s["source"].alias("source"), s["raw"].alias("value"))
        specs, rows = {v.name: v for v in self.rules.validations}, []
        for check in self.order:
            result = F.col(f"c_{check.name}")
            found = F.transform(F.filter(f"s_{check.name}", lambda s: s["raw"] != ""), candidate)
            rows.append([F.lit(check.name), F.lit("check"), *[result[p] for p in ("value", "flags", "needs_review", "reasons")], found, F.lit(None)])
        for name, column in self.checked.items():
            if name in {c.name for c in self.order}:
                continue
            result, label = F.col(column), name in self.rules.groups
            failed = F.size(result["reasons"]) > 0
            flags = F.when(failed, F.array(F.lit("validation_failed"))).otherwise(F.array().cast("array<string>"))
            # A field waits for what it was read with, not for its rule
            waits = failed if label and specs[name].does("review") else F.lit(False)
            kind = F.lit("custom_label" if label else "field")
            rows.append([F.lit(name), kind, result["value"], flags, waits, result["reasons"], F.lit(None), (states or {}).get(name, F.lit(None))])
        pairs = "array<struct<{}:string,{}:string>>"
        kinds = ("string", "string", "array<string>", "boolean", "array<string>", pairs.format("source", "value"), pairs.format("column", "state"))
        every = [F.struct(n.alias("name"), *[c.cast(k).alias(p) for c, k, p in zip(row, kinds, parts)]) for n, *row in rows]
        none = "array<struct<name:string," + ",".join(f"{p}:{k}" for p, k in zip(parts, kinds)) + ">>"
        return self.df.select("scan_id", F.inline(F.array(*every) if every else F.array().cast(none)))

    def column_states(self, group: str, state: Callable[[Column, Column, Column], Column]) -> Column:
        """The (column, state) of a group's columns that were read, in order; state(value, flags, needs_review) says which."""

        def of(name: str) -> Column:
            read = [self.reading(name, part) for part in ("value", "flags", "needs_review")]
            return F.when(F.map_contains_key("read", name), F.struct(F.lit(name).alias("column"), state(*read).alias("state")))

        return F.array_compact(F.array(*map(of, self.rules.groups[group])))

    def held(self, name: str) -> Column:
        """A validation keeps this reading in review."""
        rule = next((v for v in self.rules.validations if v.name == name and v.does("review")), None)
        if rule is None or name not in self.checked:
            return F.lit(False)
        return F.size(F.col(self.checked[name])["reasons"]) > 0

    def absorbed(self) -> DataFrame:
        """Flagged readings a resolved check settles: missing ones, and ones that agree with
        another usable source; a reading its own validation holds stays."""
        rows = []
        for check in self.order:
            if not check.absorb:
                continue
            c, sources = F.col(f"c_{check.name}"), F.col(f"s_{check.name}")
            resolved = ~c["needs_review"] & c["chosen_source"].isNotNull()
            for name in check.priority:
                if name in self.outputs and name != check.output or name in self.rules.groups:
                    continue
                mine, agrees = _own(sources, name), _agrees(sources, name)
                waits = F.coalesce(self.reading(name, "needs_review"), F.lit(False)) & ~self.held(name)
                settled = resolved & waits & (mine["note"].isNotNull() | agrees)
                rows.append(F.when(settled, F.struct(F.lit(name).alias("name"), F.lit(check.name).alias("resolved_by"))))
        none = F.array().cast("array<struct<name:string,resolved_by:string>>")
        found = F.array_compact(F.array(*rows)) if rows else none
        return self.df.select("scan_id", F.inline(found))

    def review(self) -> DataFrame:
        """Review items of the rules: failed labels and checks that need a person."""
        labels = self.validations().where("kind = 'custom_label' AND NOT ok AND action IN ('review', 'both')")
        labels = labels.select("scan_id", "kind", "name", F.array(F.lit("validation_failed")).alias("flags"))
        checks = self.checks().where("needs_review").select("scan_id", F.lit("check").alias("kind"), "name", "flags")
        return labels.unionByName(checks)


def _own(sources: Column, name: str) -> Column:
    return F.get(F.filter(sources, lambda s: s["source"] == name), F.lit(0))


def _agrees(sources: Column, name: str) -> Column:
    """Another usable source has the same normalised value."""
    own = _own(sources, name)["norm"]
    return F.exists(
        sources, lambda s: (s["source"] != name) & s["note"].isNull() & (s["norm"] == own)
    )


def review_list(readings: DataFrame, rule_items: DataFrame, group_items: DataFrame, absorbed: DataFrame) -> DataFrame:
    """The sheet's review list: flagged readings not settled by a check, rule items, then group
    items none of whose columns is already listed (group_items has a `columns` array)."""
    fields = (
        readings.where("needs_review")
        .join(absorbed.select("scan_id", "name").distinct(), ["scan_id", "name"], "left_anti")
        .select("scan_id", "kind", "name", "flags")
    )
    listed = fields.unionByName(rule_items)
    names = group_items.select("scan_id", F.col("name").alias("_group"), F.explode(F.array_append("columns", F.col("name"))).alias("name"))
    taken = names.join(listed, ["scan_id", "name"], "left_semi").select("scan_id", F.col("_group").alias("name"))
    extra = group_items.join(taken, ["scan_id", "name"], "left_anti").select(
        "scan_id", F.lit("custom_label").alias("kind"), "name", "flags"
    )
    return listed.unionByName(extra)
