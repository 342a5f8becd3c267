"""A report as JSON, read again with validation, and what changed between two."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

METRICS = ("duplicated_mass", "redundant_fraction", "propagation_cost", "cycle_count", "largest_scc")


class SidecarError(ValueError):
    """A file that is not a report."""


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False) + "\n"


def write(spark: SparkSession, report: dict, path: str) -> None:
    """Writes the report to a path of any file system that Spark knows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(to_json(report).encode()))
    finally:
        out.close()


def parse(text: str, name: str) -> dict:
    """The parts of a report that two are compared by; SidecarError names the file and what is wrong with it."""
    try:
        report = json.loads(text)
    except ValueError as e:
        raise SidecarError(f"{name} is not JSON: {e}") from e
    if not isinstance(report, dict) or not isinstance(report.get("metrics"), dict):
        raise SidecarError(f"{name} has no metrics")
    for m in METRICS:
        if not isinstance(report["metrics"].get(m), (int, float)) or isinstance(report["metrics"][m], bool):
            raise SidecarError(f"{name}: metrics.{m} is not a number")
    for section in ("duplication", "cycles"):
        rows = report.get(section)
        if not isinstance(rows, list) or not all(isinstance(r, dict) and isinstance(r.get("id"), str) for r in rows):
            raise SidecarError(f"{name}: {section} is not a list of findings with an id")
    return report


def read(spark: SparkSession, path: str) -> dict:
    """A report from a file of any file system that Spark knows."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise SidecarError(f"{path} is not one file")
    return parse(rows[0][0], path)


def metrics_frame(spark: SparkSession, report: dict) -> DataFrame:
    m = report["metrics"]
    row = tuple(float(m[k]) if k in ("redundant_fraction", "propagation_cost") else int(m[k]) for k in METRICS)
    return spark.createDataFrame([row], "duplicated_mass bigint, redundant_fraction double, propagation_cost double, cycle_count bigint, largest_scc bigint")


def findings_frame(spark: SparkSession, report: dict) -> DataFrame:
    rows = [(r["id"], section) for section in ("duplication", "cycles") for r in report[section]]
    return spark.createDataFrame(rows, "id string, section string")


@dataclass(frozen=True)
class Difference:
    resolved: list[str]
    added: list[str]
    unchanged: list[str]
    before: dict
    after: dict


def difference(before: dict, after: dict) -> Difference:
    """By id: duplication and cycles share one space of ids; types are not compared."""
    a, b = ({r["id"] for section in ("duplication", "cycles") for r in x[section]} for x in (before, after))
    return Difference(sorted(a - b), sorted(b - a), sorted(a & b), before["metrics"], after["metrics"])


def change(before: float, after: float) -> float:
    """In percent; from nothing to something is 100."""
    return (100.0 if after else 0.0) if not before else 100.0 * (after - before) / before


def number(x: float) -> str:
    return f"{x:.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)


def difference_text(d: Difference) -> str:
    """One line of totals, then a line for each id that went and that came."""

    def moved(label: str, key: str) -> str:
        a, b = d.before[key], d.after[key]
        return f"{label} {change(a, b):+.1f}% ({number(a)} -> {number(b)})"

    head = f"{len(d.resolved)} findings resolved, {len(d.added)} new, {moved('duplicated mass', 'duplicated_mass')}, {moved('propagation cost', 'propagation_cost')}"
    return "\n".join([head, *(f"  - {i}" for i in d.resolved), *(f"  + {i}" for i in d.added)]) + "\n"
