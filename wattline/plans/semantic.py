"""Semantic layer: logical tables with dimensions, facts, metrics, filters and many-to-one relationships."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions import rules
from wattline.functions.calendar import trunc

Expr = Callable[[], Column]


@dataclass
class LogicalTable:
    """Named column expressions over one DataFrame."""

    name: str
    key: str
    dimensions: dict[str, Expr] = field(default_factory=dict)
    facts: dict[str, Expr] = field(default_factory=dict)
    metrics: dict[str, Expr] = field(default_factory=dict)
    filters: dict[str, Expr] = field(default_factory=dict)
    synonyms: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Relationship:
    """left.left_key -> right.right_key, many to one."""

    left: str
    left_key: str
    right: str
    right_key: str


class Model:
    """Logical tables, their relationships, and shared dimensions: {name: {table: its dimension}}, a day or month that several facts have."""

    def __init__(self, tables: list[LogicalTable], relationships: list[Relationship], shared: dict[str, dict[str, str]] | None = None):
        self.tables = {t.name: t for t in tables}
        self.relationships = relationships
        self.shared = shared or {}

    @classmethod
    def from_dict(cls, spec: dict) -> "Model":
        """Tables and relationships from plain text; expressions are Spark SQL."""
        def exprs(block: dict[str, str]) -> dict[str, Expr]:
            return {n: (lambda e=e: F.expr(e)) for n, e in block.items()}

        tables = [
            LogicalTable(
                t["name"], t["key"], exprs(t.get("dimensions", {})), exprs(t.get("facts", {})), exprs(t.get("metrics", {})), exprs(t.get("filters", {})), t.get("synonyms", {})
            )
            for t in spec["tables"]
        ]
        return cls(tables, [Relationship(**r) for r in spec.get("relationships", [])], spec.get("shared"))

    def find(self, name: str) -> tuple[LogicalTable, str]:
        """'table.name' or an unambiguous name or synonym."""
        table, _, short = name.rpartition(".")
        hits = []
        for t in [self.tables[table]] if table else self.tables.values():
            target = t.synonyms.get(short, short)
            if target in t.dimensions or target in t.metrics or target in t.filters or target in t.facts:
                hits.append((t, target))
        if len(hits) != 1:
            raise KeyError(f"{name}: {len(hits)} matches")
        return hits[0]

    def join_path(self, start: str, goal: str) -> list[Relationship]:
        """Shortest chain of many-to-one steps from the fact table to the goal."""
        queue, seen = [(start, [])], {start}
        while queue:
            at, path = queue.pop(0)
            if at == goal:
                return path
            for r in self.relationships:
                if r.left == at and r.right not in seen:
                    seen.add(r.right)
                    queue.append((r.right, path + [r]))
        raise KeyError(f"no many-to-one path from {start} to {goal}")

    def query(self, frames: dict[str, DataFrame], dims: list[str], metrics: list[str], filters: list[str] = (), check_keys: bool = False) -> DataFrame:
        """Group by the dimensions and evaluate the metrics.

        Metrics of several fact tables are evaluated for each table by itself, down to the dimensions, and only these short results
        meet, so no fact row is ever joined to another fact's rows. Null dimension values are one group. A filter counts for the
        facts that lead to its table; one that no fact leads to is an error.
        """
        by_fact: dict[str, list[str]] = {}
        for m in metrics:
            by_fact.setdefault(self.find(m)[0].name, []).append(m)
        if not by_fact:
            raise ValueError("a query needs a metric")
        applied = {name: [f for f in filters if self._leads(name, self.find(f)[0].name)] for name in by_fact}
        for f in filters:
            if not any(f in fs for fs in applied.values()):
                raise KeyError(f"no many-to-one path from {', '.join(by_fact)} to the table of {f}")
        results = [self._of_one_fact(frames, name, dims, ms, applied[name], check_keys) for name, ms in by_fact.items()]
        if len(results) == 1:
            return results[0]
        names = [self._out(d) for d in dims]
        columns = [self._out(m) for m in metrics]
        rows = results[0]
        for other in results[1:]:
            rows = rows.unionByName(other, allowMissingColumns=True)
        # Every fact has one row for a combination of dimension values, and metrics are columns of one fact.
        return rows.groupBy(*names).agg(*[F.any_value(c, ignoreNulls=True).alias(c) for c in columns])

    def _out(self, name: str) -> str:
        return (name if name in self.shared else self.find(name)[1]).lower()

    def _leads(self, start: str, goal: str) -> bool:
        try:
            self.join_path(start, goal)
        except KeyError:
            return False
        return True

    def _of_one_fact(self, frames: dict[str, DataFrame], fact: str, dims: list[str], metrics: list[str], filters: list[str], check_keys: bool) -> DataFrame:
        """Only the columns that the query names are read.  Joins go to the unique side, so they never multiply facts."""
        base = self.tables[fact]
        found_m = [self.find(m) for m in metrics]
        found_d = [(d, *(self._shared(d, fact) if d in self.shared else self.find(d))) for d in dims]
        found_f = [(f, *self.find(f)) for f in filters]
        df = frames[base.name]
        for _, t, name in found_f:
            if t.name == base.name:
                df = df.where(t.filters[name]())
        for _, t, name in found_d:
            if t.name == base.name:
                df = df.withColumn(f"__d_{t.name}_{name}", t.dimensions[name]())
        joined: set[str] = set()
        for _, t, _ in found_d + found_f:
            for step in self.join_path(base.name, t.name):
                if step.right in joined:
                    continue
                joined.add(step.right)
                df = self._join(df, frames, step, base.name, found_d, found_f, check_keys)
        for _, t, name in found_f:
            if t.name != base.name:
                df = df.where(F.col(f"__f_{t.name}_{name}"))
        groups = [F.col(f"__d_{t.name}_{name}").alias(self._out(d)) for d, t, name in found_d]
        return df.groupBy(*groups).agg(*[t.metrics[name]().alias(name.lower()) for t, name in found_m])

    def _shared(self, name: str, fact: str) -> tuple[LogicalTable, str]:
        if fact not in self.shared[name]:
            raise KeyError(f"{fact} has no {name}")
        return self.tables[fact], self.shared[name][fact]

    def _join(self, df, frames, step, base, found_d, found_f, check_keys):
        right = frames[step.right]
        if check_keys and not right.groupBy(step.right_key).count().where("count > 1").isEmpty():
            raise ValueError(f"{step.right}.{step.right_key} is not unique")
        t = self.tables[step.right]
        onward = [r for r in self.relationships if r.left == step.right]
        cols = {f"__k_{step.right}": F.col(step.right_key)}
        cols.update({f"__l_{step.right}_{r.left_key}": F.col(r.left_key) for r in onward})
        cols.update({f"__d_{t.name}_{n}": t.dimensions[n]() for _, x, n in found_d if x.name == t.name})
        cols.update({f"__f_{t.name}_{n}": t.filters[n]() for _, x, n in found_f if x.name == t.name})
        side = right.select(*[c.alias(n) for n, c in cols.items()])
        left_key = step.left_key if step.left == base else f"__l_{step.left}_{step.left_key}"
        return df.join(side, df[left_key] == side[f"__k_{step.right}"], "left")


def _count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _col(name: str) -> Expr:
    return lambda: F.col(name)


def grid_model() -> Model:
    """The utility model over readings, meters, customers, transformers, hourly load, substations and outages."""
    kwh = F.col
    readings = LogicalTable(
        "readings", "meter_id",
        dimensions={
            "METER_ID": _col("meter_id"), "QUALITY": _col("quality"), "SAG_TYPE": _col("sag_type"),
            "READING_DATE": lambda: F.to_date("reading_ts"), "READING_MONTH": lambda: trunc("MONTH", F.col("reading_ts")),
            "READING_HOUR": lambda: F.hour("reading_ts"), "READING_YEAR": lambda: F.year("reading_ts"),
        },
        facts={"USAGE_KWH": _col("usage_kwh"), "USAGE_KWH_ADJUSTED": _col("usage_kwh_adjusted"), "VOLTAGE": _col("voltage_v"), "POWER_FACTOR": _col("power_factor"), "VOLTAGE_DROP_AMOUNT": _col("voltage_drop")},
        metrics={
            "TOTAL_CONSUMPTION": lambda: F.sum(kwh("usage_kwh_adjusted")), "AVG_CONSUMPTION": lambda: F.avg(kwh("usage_kwh_adjusted")),
            "PEAK_CONSUMPTION": lambda: F.max(kwh("usage_kwh_adjusted")), "ACTIVE_METER_COUNT": lambda: F.countDistinct("meter_id"),
            "AVG_VOLTAGE": lambda: F.avg("voltage_v"), "MIN_VOLTAGE": lambda: F.min("voltage_v"), "READING_COUNT": lambda: F.count(F.lit(1)),
            "LOW_VOLTAGE_COUNT": lambda: _count_if(F.col("voltage_v") < 114), "VOLTAGE_SAG_COUNT": lambda: _count_if(F.col("voltage_event_id").isNotNull()),
            "OUTAGE_IMPACT_KWH": lambda: F.sum(F.col("usage_kwh") - F.col("usage_kwh_adjusted")),
            "DATA_COMPLETENESS": lambda: _count_if(F.col("quality") == "VALID").cast("double") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)),
        },
        filters={n: rules.FILTERS[n] for n in ("SUMMER_2024", "SUMMER_2025", "PEAK_HOURS", "OFF_PEAK", "VALID_READINGS_ONLY", "LOW_VOLTAGE_INCIDENTS", "VOLTAGE_SAG_EVENTS")},
        synonyms={"usage": "TOTAL_CONSUMPTION", "energy": "TOTAL_CONSUMPTION"},
    )
    customers = LogicalTable(
        "customers", "customer_id",
        dimensions={"CUSTOMER_SEGMENT": _col("segment"), "CITY": _col("city"), "ACCOUNT_STATUS": _col("account_status"), "FULL_NAME": _col("full_name")},
        metrics={"CUSTOMER_COUNT": lambda: F.countDistinct("customer_id")},
        filters={"ACTIVE_CUSTOMERS": rules.FILTERS["ACTIVE_CUSTOMERS"]},
    )
    transformers = LogicalTable(
        "transformers", "transformer_id",
        dimensions={"TRANSFORMER_ID": _col("transformer_id"), "LOCATION_AREA": _col("location_area"), "MANUFACTURER": _col("manufacturer"), "ROLE": _col("role"), "HEALTH_CATEGORY": lambda: rules.health_category(F.col("health_score"))},
        facts={"RATED_KVA": _col("rated_kva"), "AGE_YEARS": _col("age_years"), "HEALTH_SCORE": _col("health_score"), "LOAD_UTILIZATION_PCT": _col("load_utilization_pct")},
        metrics={
            "TRANSFORMER_COUNT": lambda: F.count(F.lit(1)), "AVG_AGE": lambda: F.avg("age_years"), "AVG_HEALTH_SCORE": lambda: F.avg("health_score"),
            "AVG_UTILIZATION": lambda: F.avg("load_utilization_pct"), "TOTAL_CAPACITY_KVA": lambda: F.sum("rated_kva"), "OVERLOADED_COUNT": lambda: _count_if(F.col("load_utilization_pct") > 100),
        },
        filters={n: rules.FILTERS[n] for n in ("OVERLOADED", "HIGH_RISK", "AGING", "LARGE_TRANSFORMERS")},
    )
    hourly = LogicalTable(
        "hourly_load", "transformer_id",
        dimensions={"LOAD_DATE": lambda: F.to_date("load_hour"), "LOAD_MONTH": lambda: trunc("MONTH", F.col("load_hour")), "THERMAL_STRESS_CATEGORY": lambda: rules.stress_category(F.col("load_factor_pct"))},
        facts={"LOAD_KW": _col("load_kw"), "LOAD_FACTOR_PCT": _col("load_factor_pct")},
        metrics={
            "AVG_LOAD_FACTOR": lambda: F.avg("load_factor_pct"), "PEAK_LOAD_FACTOR": lambda: F.max("load_factor_pct"), "OVERLOAD_HOURS": lambda: _count_if(F.col("load_factor_pct") > 100),
            "HIGH_STRESS_HOURS": lambda: _count_if(rules.stress_category(F.col("load_factor_pct")).isin("HIGH", "CRITICAL")), "AVG_LOAD_KW": lambda: F.avg("load_kw"),
            "CRITICAL_HOURS": lambda: _count_if(rules.stress_category(F.col("load_factor_pct")) == "CRITICAL"), "LOADED_TRANSFORMERS": lambda: F.countDistinct("transformer_id"),
        },
        filters={n: rules.FILTERS[n] for n in ("OVERLOADED_HOURS", "HIGH_STRESS", "CRITICAL_STRESS")},
    )
    substations = LogicalTable(
        "substations", "substation_id",
        dimensions={"SUBSTATION_NAME": _col("substation_name"), "REGION_ID": _col("region_id")},
        metrics={"SUBSTATION_COUNT": lambda: F.count(F.lit(1)), "TOTAL_CAPACITY": lambda: F.sum("capacity_mva")},
    )
    meters = LogicalTable(
        "meters", "meter_id",
        dimensions={"COUNTY": _col("county"), "METER_SEGMENT": _col("segment"), "METER_CIRCUIT": _col("circuit_id")},
        metrics={"METER_COUNT": lambda: F.count(F.lit(1)), "METERS_PER_TRANSFORMER": lambda: F.count(F.lit(1)) / F.nullif(F.countDistinct("transformer_id"), F.lit(0))},
    )
    outages = LogicalTable(
        "outages", "outage_id",
        dimensions={"CAUSE": _col("cause"), "STATUS": _col("status"), "OUTAGE_DATE": lambda: F.to_date("start_ts"), "OUTAGE_MONTH": lambda: trunc("MONTH", F.col("start_ts")), "SEVERITY": lambda: rules.outage_severity(F.col("customers"))},
        metrics={
            "OUTAGE_COUNT": lambda: F.countDistinct("outage_id"), "TOTAL_CUSTOMERS_AFFECTED": lambda: F.sum("customers"),
            "AVG_OUTAGE_DURATION": lambda: F.avg(F.timestamp_diff("MINUTE", F.col("start_ts"), F.col("end_ts"))),
        },
    )
    return Model(
        [readings, customers, transformers, hourly, substations, meters, outages],
        [
            Relationship("readings", "meter_id", "meters", "meter_id"),
            Relationship("meters", "meter_id", "customers", "meter_id"),
            Relationship("meters", "transformer_id", "transformers", "transformer_id"),
            Relationship("hourly_load", "transformer_id", "transformers", "transformer_id"),
            Relationship("transformers", "substation_id", "substations", "substation_id"),
            Relationship("outages", "transformer_id", "transformers", "transformer_id"),
        ],
        {
            "DAY": {"readings": "READING_DATE", "hourly_load": "LOAD_DATE", "outages": "OUTAGE_DATE"},
            "MONTH": {"readings": "READING_MONTH", "hourly_load": "LOAD_MONTH", "outages": "OUTAGE_MONTH"},
        },
    )
