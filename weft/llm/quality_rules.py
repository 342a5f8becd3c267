"""Quality rules: an ordered decision list of threshold conjunctions, learned by sequential covering.

``text_statistics`` measures whole texts in Arrow batches. ``learn_rules`` grows each conjunction on two thirds of the
labelled rows by information gain, prunes it on the rest, keeps it while it is precise there, takes the rows it covers
away and goes on. ``verdict`` writes the list as one ordered Spark ``CASE``; rows no rule covers are kept.

Defined results: a null or empty text counts zero everywhere; a null label or label without document is not learned from;
of labels of one id that disagree the worse counts, and
equal rows of one id are learned from once; with no labelled rows of both classes the list is empty; repeated rows are measured each; of other columns none is read,
so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import textops as T
from weft.llm.common import cut

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_letters", "n_bang", "n_pipe", "n_same_next", "n_lines"]
STATISTICS_SCHEMA = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS + MORE)])
#: Rows of each class that rules are learned from, about; taken by hash.
FIT_ROWS = 6000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[0xC3:] = True


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text of a slice."""
    starts, ends, bounds = T.words(data, offsets)
    h = T.range_hash(data, starts, ends)
    text = T.owner(bounds)
    out = {"n_words": np.diff(bounds), "word_chars": T.total_by(((data & 0xC0) != 0x80) & ~T.SPACE[data], offsets)}
    out |= {name: T.total_by(mask[data], offsets) for name, mask in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_letters", LETTER))}
    out |= {"n_bang": T.total_by(data == ord("!"), offsets), "n_pipe": T.total_by(data == ord("|"), offsets)}

    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    out["n_same_next"] = T.total_by(same, bounds)

    grams, at = T.window_hash(h, bounds, 5)
    _, inverse, times = np.unique(grams ^ T.mix(text[at].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    step = np.zeros(len(h) + 1, np.int64)
    found = at[times[inverse] > 1]
    step[found] += 1
    step[found + 5] -= 1
    out["n_repeat_words"] = T.total_by(np.cumsum(step[:-1]) > 0, bounds)

    lines, line_ends, line_bounds = T.runs(data != 10, offsets)
    held = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
    line_text = T.owner(line_bounds)[held]
    key = T.range_hash(data, lines[held], line_ends[held]) ^ T.mix(line_text.astype(np.uint64) + np.uint64(1))
    kinds = np.bincount(line_text[np.unique(key, return_index=True)[1]], minlength=len(offsets) - 1)
    out["n_lines"] = np.bincount(line_text, minlength=len(offsets) - 1)
    out["n_dup_lines"] = out["n_lines"] - kinds
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offsets in T.slices(T.text_column(batch)):
            got = measure(data, offsets)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(got[c].astype(np.int64)) for c in COUNTS + MORE)], names=["doc_id", *COUNTS, *MORE])


def text_statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_statistics, STATISTICS_SCHEMA)


def _ratio(top: str, below: str) -> Column:
    return F.col(top) / F.greatest(F.col(below), F.lit(1))


def measures() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "chars_per_word": _ratio("word_chars", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "upper_share": _ratio("n_upper", "n_letters"),
        "letter_share": _ratio("n_letters", "word_chars"),
        "bangs_per_word": _ratio("n_bang", "n_words"),
        "pipes_per_word": _ratio("n_pipe", "n_words"),
        "same_next_share": _ratio("n_same_next", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.measure]
        return v > self.threshold if self.above else v <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction; rows it covers are rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int, cuts: int) -> Rule:
    """Add the condition of most information gain until no good row is covered."""
    chosen: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(chosen) < longest and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        base, best, gain = np.log2(p / (p + n)), None, 1e-9
        for name in sorted(x):
            v = x[name]
            for t in np.unique(np.quantile(v[inside], np.linspace(0, 1, cuts + 2)[1:-1])):
                over = inside & (v > t)
                p1, n1 = (over & bad).sum(), (over & ~bad).sum()
                for above, q, m in ((True, p1, n1), (False, p - p1, n - n1)):
                    if q and (g := q * (np.log2(q / (q + m)) - base)) > gain:
                        best, gain = Condition(name, above, float(t)), g
        if best is None:
            break
        chosen.append(best)
        inside &= best.holds(x)
    return Rule(tuple(chosen))


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    on = rule.holds(x)
    p, n = (on & bad).sum(), (on & ~bad).sum()
    return (p - 4 * n) / (p + n) if p + n else -1.0


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, longest: int = 4, cuts: int = 24, most: int = 20) -> list[Rule]:
    """x: values by measure; bad: which rows to reject. Rows are dealt 2 to 1 into growing and pruning by their order."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    grow_half = np.arange(len(bad)) % 3 != 2
    for _ in range(3 * most):
        grow, prune = left & grow_half, left & ~grow_half
        if len(rules) == most or not (grow & bad).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], longest, cuts)
        if not rule.conditions:
            break
        xp, bp = {k: v[prune] for k, v in x.items()}, bad[prune]
        rule = max((Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))), key=lambda r: (_worth(r, xp, bp), -len(r.conditions)))
        on = rule.holds(x) & left
        if (on & bad).sum() >= max(5, precision * on.sum()) and (on & prune & bad).sum() >= max(1, precision * (on & prune).sum()):
            rules.append(rule)
        else:  # not to be trusted: what it covers is set aside, and the search goes on
            on &= bad
        left &= ~on
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered CASE: false for rows that a rule covers, else true."""
    by = measures()
    out = None
    for rule in rules:
        cond = F.lit(True)
        for c in rule.conditions:
            cond = cond & (by[c.measure] > c.threshold if c.above else by[c.measure] <= c.threshold)
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(statistics: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from at most about ``fit_rows`` labelled rows of each class, taken by hash of the id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    there = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(there) < 2:
        return []
    spin = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.when(F.col("quality") == 0, min(1.0, fit_rows / there[0])).otherwise(min(1.0, fit_rows / there[1]))
    # of labels that disagree, the worse one counts
    sample = marked.where(spin < share * 1_000_000).groupBy("doc_id").agg(F.min("quality").alias("quality")).join(statistics.dropDuplicates(["doc_id", *COUNTS, *MORE]), "doc_id")
    rows = sample.select("doc_id", "quality", *(v.alias(k) for k, v in measures().items())).toPandas().sort_values(["doc_id", *measures()])
    order = np.argsort(T.mix(rows["doc_id"].to_numpy().astype(np.uint64)), kind="stable")
    rows = rows.iloc[order]
    return learn_rules({k: rows[k].to_numpy(float) for k in measures()}, rows["quality"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics of every document, whether the base rules fail it, and whether it is kept."""
    statistics = cut(text_statistics(docs))
    rules = fit(statistics, labels, fit_rows)
    return statistics.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
