"""Quality rules: a decision list learned by sequential covering.

Each document gets a few statistics.  From labelled statistics the learner
grows conjunctions of thresholds that cover low-quality documents (FOIL gain on
a growing part), prunes them on a held-out part, takes a rule if it is precise
enough there, removes what it covers and goes on.  The list becomes one Spark
conditional expression; documents that no rule covers are kept.

The learner sees at most SAMPLE labelled documents, the ones whose hashed ids
are smallest; statistics are computed over every word of every document.

Defined results: null text has no words and fails the base rule; documents
without labels are judged by the same list; labels with nulls, and repeated
labels that disagree, are left out of training; without labels of both kinds
the list is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, with_text
from .words import SPACE, grams, hashes, mix, split, starts_of_runs

SAMPLE = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS, MAX_REPEAT = 50, 50

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: What the rules' thresholds are on.
FEATURES = {
    "n_words": lambda c: c("n_words").cast("double"),
    "mean_chars": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbols_per_word": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "dup_lines_per_100_words": lambda c: 100 * c("n_dup_lines") / F.greatest(c("n_words"), F.lit(1)),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "upper_share": lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
    "digit_share": lambda c: c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
    "ends_per_word": lambda c: c("n_ends") / F.greatest(c("n_words"), F.lit(1)),
}


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values between the offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def measure(piece: pa.RecordBatch) -> pa.RecordBatch:
    w = split(piece.column("text"), SPACE)
    inside = ~SPACE[w.data]
    points = (w.data & 0xC0) != 0x80
    repeat = np.zeros(len(w) + 1, np.int64)
    if len(w) >= 3:
        start = np.flatnonzero(starts_of_runs(w, 3))
        if len(start):
            key = mix(grams(hashes(w), 3)[start], w.owners()[start].astype(np.uint64))
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            again = start[count[which] > 1]
            np.add.at(repeat, again, 1)
            np.add.at(repeat, again + 3, -1)
    columns = {
        "n_words": w.counts(),
        "word_chars": sums(inside & points, w.bytes_first),
        "n_symbols": sums(SYMBOLS[w.data], w.bytes_first),
        "n_dup_lines": np.array([dup_lines(t) for t in piece.column("text").to_pylist()], np.int64),
        "n_repeat_words": sums(np.cumsum(repeat[:-1]) > 0, w.first),
        "n_upper": sums((w.data >= 65) & (w.data <= 90), w.bytes_first),
        "n_digits": sums((w.data >= 48) & (w.data <= 57), w.bytes_first),
        "n_ends": sums((w.data == 0x2E) | (w.data == 0x21) | (w.data == 0x3F), w.bytes_first),
    }
    return pa.record_batch([piece.column("doc_id"), *(pa.array(v, pa.int64()) for v in columns.values())], ["doc_id", *columns])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(with_text(docs), measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in [*STATISTICS, "n_upper", "n_digits", "n_ends"]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold), with its precision and cover on the held-out part."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float = 0.0
    covered: int = 0

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.conditions:
            out &= x[f] <= t if op == "<=" else x[f] > t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            out = out & (F.col(f) <= t if op == "<=" else F.col(f) > t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions) or "always"


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, bins: int) -> Rule:
    """Adds the condition of the largest FOIL gain until no good document is covered or nothing helps."""
    conditions: list[tuple[str, str, float]] = []
    inside = np.ones(len(bad), bool)
    while len(conditions) < most:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not n0 or not p0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, bins + 1)[1:-1]))
            for t in cuts.tolist():
                low = inside & (v <= t)
                p, n = int(bad[low].sum()), int((~bad[low]).sum())
                for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if pp:
                        gain = pp * (np.log2(pp / (pp + nn)) - base)
                        if gain > best[0]:
                            best = (gain, (f, op, t))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],)).matches(x)
    return Rule(tuple(conditions))


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops final conditions while (p - n) / (p + n) on the held-out part doesn't fall."""

    def worth(r):
        m = r.matches(x)
        p, n = int(bad[m].sum()), int((~bad[m]).sum())
        return ((p - n) / (p + n) if p + n else -1.0), p, n

    best = (worth(rule), rule)
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if (value := worth(shorter))[0] >= best[0][0]:
            best = (value, shorter)
    (_, p, n), rule = best
    return Rule(rule.conditions, p / (p + n) if p + n else 0.0, p + n)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 16, most_conditions: int = 4, bins: int = 32, seed: int = 7) -> list[Rule]:
    """Sequential covering: rules for low quality, in order."""
    rules: list[Rule] = []
    live = np.ones(len(bad), bool)
    r = np.random.default_rng(seed)
    while len(rules) < most_rules and bad[live].any() and (~bad[live]).any():
        held = r.random(len(bad)) < 1 / 3
        a, b = live & ~held, live & held
        if not bad[a].any() or not (~bad[a]).any():
            break
        rule = grow({f: v[a] for f, v in x.items()}, bad[a], most_conditions, bins)
        rule = prune(rule, {f: v[b] for f, v in x.items()}, bad[b])
        if not rule.conditions or rule.covered < least or rule.precision < precision:
            break
        rules.append(rule)
        live &= ~rule.matches(x)
    return rules


def features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f: e(F.col) for f, e in FEATURES.items() if f not in STATISTICS})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **how) -> list[Rule]:
    """The list learned from a bounded sample of labelled documents."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    chosen = marks.select(F.col("doc_id").alias("id"), F.col("lo").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(sample)
    known = with_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most `sample` ids
    rows = features(statistics(known.select("doc_id", "text"))).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).orderBy("doc_id", *STATISTICS).limit(sample).toPandas()
    if rows.empty:
        return []
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["quality"].to_numpy() == 0, **how)


def verdict(rules: list[Rule]) -> Column:
    """The rule that applies first (0: none), as one conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and rule (the number of the rule that applied, 0 if none)."""
    df = features(statistics(docs))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return df.select("doc_id", *STATISTICS, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
