"""Diff, patch, schema evolution and validation as joins and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, value): one row for each field that is present (not null), values as text."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return df.select(key, F.expr(f"stack({len(columns)}, {pairs}) as (field, value)")).where("value is not null")


def diff(base: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, field, op, value): set or delete operations that turn ``base`` fields into ``target`` fields."""
    b, t = base.select(key, "field", F.col("value").alias("_b")), target.select(key, "field", F.col("value").alias("_t"))
    both = b.join(t, [key, "field"], "full_outer").where(~F.col("_b").eqNullSafe(F.col("_t")))
    op = F.when(F.col("_b").isNull(), "add").when(F.col("_t").isNull(), "delete").otherwise("set")
    return both.select(key, "field", op.alias("op"), F.col("_t").alias("value"))


def diff_stats(changes: DataFrame) -> DataFrame:
    """One row: fields added, removed and changed, and records touched."""
    return changes.agg(*[F.count_if(F.col("op") == o).alias(n) for o, n in (("add", "added"), ("delete", "removed"), ("set", "changed"))])


def apply_changes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` fields after set, add and delete operations; apply(base, diff(base, target)) is target."""
    c = changes.select(key, "field", F.col("op").alias("_op"), F.col("value").alias("_v"))
    merged = base.join(c, [key, "field"], "full_outer").where(F.col("_op").isNull() | (F.col("_op") != "delete"))
    return merged.select(key, "field", F.when(F.col("_op").isNull(), F.col("value")).otherwise(F.col("_v")).alias("value"))


def apply_patch(base: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """Fold ordered operations (key, path, seq, op, value) over (key, path, value) fields.

    ``=`` sets, ``-`` deletes, ``+`` appends to the text after a comma, ``~`` adds a number.  The last ``=`` or ``-``
    of a path starts it anew; later appends and additions follow in order.
    """
    last = ops.groupBy(key, "path").agg(F.max(F.when(F.col("op").isin("=", "-"), F.col("seq"))).alias("_at"))
    marked = ops.join(last, [key, "path"]).where(F.col("_at").isNull() | (F.col("seq") >= F.col("_at")))
    folded = marked.groupBy(key, "path").agg(
        F.max(F.when(F.col("op") == "=", F.col("value"))).alias("_set"),
        F.count_if(F.col("op").isin("=", "-")).alias("_fresh"),
        F.sum(F.when(F.col("op") == "~", F.col("value").cast("double"))).alias("_more"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") == "+", F.struct("seq", "value")))), lambda x: x["value"]), ",").alias("_tail"),
    )
    both = base.join(folded, [key, "path"], "full_outer")
    start = F.when(F.coalesce("_fresh", F.lit(0)) > 0, F.col("_set")).otherwise(F.col("value"))
    number = F.when(F.col("_more").isNotNull(), (F.coalesce(start.cast("double"), F.lit(0.0)) + F.col("_more")).cast("string")).otherwise(start)
    value = F.when(F.coalesce("_tail", F.lit("")) != "", F.concat_ws(",", number, "_tail")).otherwise(number)
    return both.select(key, "path", value.alias("value")).where("value is not null")


def version_parts(version: Column) -> Column:
    """A dotted version as four numbers; a part that is no number counts 0, missing parts too."""
    parts = F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


@dataclass
class EvolvingField:
    """A field of a versioned schema."""

    name: str
    type: str = "string"
    added_in: str = "1.0"
    deprecated_in: str | None = None
    renamed_from: str | None = None
    default: object = None
    required: bool = False
    pattern: str | None = None


@dataclass
class VersionedSchema:
    """Versions in ascending order and their fields; rows are migrated upwards, one version after another."""

    name: str
    versions: list[str]
    fields: list[EvolvingField] = field(default_factory=list)

    def _at(self, version: str) -> int:
        if version not in self.versions:
            raise ValueError(f"unknown version {version}")
        return self.versions.index(version)

    def fields_of(self, version: str) -> list[EvolvingField]:
        """Fields that a version has; deprecated ones stay."""
        return [f for f in self.fields if self._at(f.added_in) <= self._at(version)]

    def migrate(self, df: DataFrame, from_version: str, to_version: str) -> DataFrame:
        """Rename, then fill defaults, then drop what is unknown, for each version on the way; downgrades raise."""
        start, stop = self._at(from_version), self._at(to_version)
        if stop < start:
            raise ValueError("a downgrade is no migration")
        for k in range(start + 1, stop + 1):
            for f in self.fields:
                if self._at(f.added_in) != k:
                    continue
                if f.renamed_from and f.renamed_from in df.columns:
                    df = df.withColumnRenamed(f.renamed_from, f.name)
                elif f.name not in df.columns:
                    df = df.withColumn(f.name, F.lit(f.default).cast(f.type))
                elif f.default is not None:
                    df = df.withColumn(f.name, F.coalesce(f.name, F.lit(f.default).cast(f.type)))
            gone = {f.renamed_from for f in self.fields if f.renamed_from and self._at(f.added_in) <= k}
            known = {f.name for f in self.fields if self._at(f.added_in) <= k} - gone
            df = df.select(*[c for c in df.columns if c in known])
        return df

    def errors(self, df: DataFrame, version: str) -> Column:
        """An array of error texts for each row: missing required fields, then fields against their pattern."""
        checks = []
        for f in self.fields_of(version):
            if f.name not in df.columns:
                continue
            if f.required:
                checks.append(F.when(F.col(f.name).isNull(), F.lit(f"required_field:{f.name}")))
            if f.pattern:
                checks.append(F.when(~F.col(f.name).cast("string").rlike(f.pattern), F.lit(f"pattern:{f.name}")))
        return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")

    def availability(self) -> list[tuple[str, str, bool, bool]]:
        """(field, version, available, deprecated)."""
        found = []
        for f in self.fields:
            for v in self.versions:
                old = f.deprecated_in is not None and self._at(f.deprecated_in) <= self._at(v)
                found.append((f.name, v, self._at(f.added_in) <= self._at(v), old))
        return found

    def changelog(self) -> list[tuple[str, str, str]]:
        """(version, change, field) in order."""
        found = []
        for v in self.versions:
            for f in self.fields:
                if f.added_in == v:
                    found.append((v, "renamed" if f.renamed_from else "added", f.name))
                if f.deprecated_in == v:
                    found.append((v, "deprecated", f.name))
        return found


@dataclass
class Rule:
    """A named check of a column: kind one of required, min, max, range, min_len, max_len, len, nonempty, regex, enum."""

    column: str
    kind: str
    argument: object = None

    def violated(self) -> Column:
        """True where the row breaks the rule; null values break only ``required``."""
        c, a = F.col(self.column), self.argument
        size = F.octet_length(c.cast("string"))
        broken = {
            "required": lambda: c.isNull(),
            "min": lambda: c < a,
            "max": lambda: c > a,
            "range": lambda: ~c.between(a[0], a[1]),
            "min_len": lambda: size < a,
            "max_len": lambda: size > a,
            "len": lambda: size != a,
            "nonempty": lambda: size == 0,
            "regex": lambda: ~c.rlike(a),
            "enum": lambda: ~c.isin(*a),
        }[self.kind]()
        return F.coalesce(broken, F.lit(False))


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, field, rule): one row for each broken rule, in one pass over the rows."""
    marks = [F.when(r.violated(), F.struct(F.lit(r.column).alias("field"), F.lit(r.kind).alias("rule"))) for r in rules]
    return df.select(key, F.explode(F.array_compact(F.array(*marks))).alias("v")).select(key, "v.field", "v.rule")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that break a unique constraint, and how often they occur."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
