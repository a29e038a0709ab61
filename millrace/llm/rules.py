"""Quality rules: decision lists learned by sequential covering, emitted as Spark conditional expressions.

Native: statistics, learning and application are DataFrame operations; the driver sees only histograms whose size is
(number of features) x (number of thresholds), whatever the input. Statistics are computed once and written; what learns, and
what applies the list, reads them.

The model's size is set by parameters: a threshold is one of N_THRESHOLDS quantiles of the bad or the good documents, a list has
MAX_RULES rules at most, a rule MAX_CONDITIONS conditions. They bound what is learned, not what is looked at: every labelled
document counts in every histogram, and every document is judged.

Edge cases: null text counts as empty (no words, hence rejected by the base rule); a text without words has all statistics
0; null doc_id rows get statistics and a verdict but can't carry a label; repeated rows are judged each on its own; rows
labelled several times count once with the lower label; without labels of both kinds no rule is learned and only the base rule
rejects; long texts are measured whole; extra columns pass through ``keep_good`` unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, cut, fresh

WINDOW = 8
N_THRESHOLDS = 24
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVER = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]


def _ordered(hashes: Column) -> Column:
    """The text's window hashes with their places, in order: equal windows become neighbours."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def text_stats(docs: DataFrame, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """``docs``, with its text or without, and one more column, whose name is returned: a struct of STATS. Written, so that it is computed once."""
    taken = list(docs.columns)

    def new(x: str) -> str:
        taken.append(fresh(taken, f"__{x}"))
        return taken[-1]

    a, b, c, d, e, marks, lines, name = map(new, ("words", "hashes", "windows", "twice", "at", "marks", "lines", "stats"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.withColumns(
        {
            a: F.regexp_extract_all(t, F.lit(f"[^{SPACE}]+"), F.lit(0)),
            marks: F.regexp_replace(t, r"[^#*$%&|<>!A-Z]+", ""),
            lines: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
        }
    )
    base = base.withColumn(b, F.transform(a, lambda w: F.xxhash64(w)))
    n = F.size(a)
    # each array is named more than once by the next step, so the optimizer never moves its computation into a lambda
    size = F.size(b)
    base = base.withColumn(c, F.when(size >= WINDOW, F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(b, i, WINDOW)))))
    base = base.withColumn(d, F.when(F.size(F.array_distinct(c)) < F.size(c), _ordered(F.col(c))))
    same = lambda j, x: F.coalesce(F.get(F.col(d), j)["h"] == x["h"], F.lit(False))
    base = base.withColumn(e, F.sort_array(F.transform(F.filter(d, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"])))
    covered = F.aggregate(F.transform(e, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(e), j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    symbols = F.length(F.regexp_replace(F.col(marks), "[!A-Z]+", ""))
    shouts = F.length(F.regexp_replace(F.col(marks), "[^!]+", ""))
    stats = {
        "n_words": n,
        "word_chars": F.length(F.array_join(a, "")),
        "n_symbols": symbols,
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": F.length(F.col(marks)) - symbols - shouts,
        "n_marks": shouts,
    }
    base = base.withColumn(name, F.struct(*(v.cast("long").alias(k) for k, v in stats.items())))
    return cut(base.select(*(F.col(f"`{x}`") for x in [*docs.columns, name] if keep_text or x != text))), name


def features(s: Column) -> dict[str, Column]:
    """What rules may test, from a struct of STATS."""
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return {
        "n_words": s["n_words"].cast("double"),
        "word_length": s["word_chars"] / words,
        "symbol_share": s["n_symbols"] / chars,
        "dup_lines_per_100_words": 100 * s["n_dup_lines"] / words,
        "repeat_share": s["n_repeat_words"] / words,
        "upper_share": s["n_upper"] / chars,
        "marks_per_word": s["n_marks"] / words,
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int

    def on(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class Rule:
    conditions: list[Condition]
    rejects: int = 0
    keeps: int = 0

    def on(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for x in self.conditions:
            out = out & x.on(values)
        return out


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, else the document is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self, s: Column) -> Column:
        """True: keep. An ordered CASE expression over a struct of STATS."""
        values, out = features(s), None
        for r in self.rules:
            out = F.when(r.on(values), F.lit(False)) if out is None else out.when(r.on(values), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"IF {' AND '.join(map(str, r.conditions))} THEN reject  -- {r.rejects} right, {r.keeps} wrong" for r in self.rules) + "\nELSE keep"


def _holds(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        x = F.col(f"b_{c.feature}")
        out = out & ((x > c.bin) if c.above else (x <= c.bin))
    return out


def _purity(p: float, n: float) -> float:
    return (p + 1) / (p + n + 2)


def learn(labelled: DataFrame, names: list[str]) -> DecisionList:
    """``labelled``: bad (int 0/1), part (0, 1: grow, 2: prune) and a double column for each name. All rows take part in each count."""
    steps = [i / N_THRESHOLDS for i in range(N_THRESHOLDS + 1)]
    cuts: dict[str, list[float]] = {}
    quantiles = labelled.groupBy("bad").agg(*(F.percentile_approx(x, steps, 10_000).alias(x) for x in names)).collect()
    for x in names:
        cuts[x] = sorted({0.0, *(v for row in quantiles for v in (row[x] or []) if v is not None)})
    if len(quantiles) < 2:
        return DecisionList()

    def binned(x: str) -> Column:
        """How many thresholds lie below the value: it is > k exactly if the value > cuts[k]."""
        return sum(((F.col(x) > c).cast("int") for c in cuts[x]), F.lit(0))

    # what the learning loop reads is one row for each combination of bins, with its number of labelled documents
    rows = cut(labelled.groupBy("bad", (F.col("part") == 2).alias("prune"), *(binned(x).alias(f"b_{x}") for x in names)).agg(F.count("*").alias("n")).withColumn("live", F.lit(True)).repartition(4))
    rules: list[Rule] = []
    stack = f"stack({len(names)}, " + ", ".join(f"'{x}', b_{x}" for x in names) + ") as (feature, bin)"

    def histogram(where: Column) -> dict[str, dict[int, tuple[int, int]]]:
        out: dict[str, dict[int, tuple[int, int]]] = {x: {} for x in names}
        counted = rows.where(where).selectExpr("bad", "n", stack).groupBy("feature", "bin").agg(F.sum(F.col("n") * F.col("bad")).alias("p"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("q"))
        for r in counted.collect():
            out[r["feature"]][r["bin"]] = (r["p"], r["q"])
        return out

    def uncovered() -> Column:
        out = F.lit(True)
        for r in rules:
            out = out & ~_holds(r.conditions)
        return out

    for _ in range(MAX_RULES):
        left, conditions, score = uncovered(), [], 0.0
        while len(conditions) < MAX_CONDITIONS:
            best = None
            for x, hist in histogram(left & ~F.col("prune") & _holds(conditions)).items():
                bins = sorted(hist)
                all_p, all_q = sum(v[0] for v in hist.values()), sum(v[1] for v in hist.values())
                low_p = low_q = 0
                for b in bins[:-1]:
                    low_p, low_q = low_p + hist[b][0], low_q + hist[b][1]
                    if b >= len(cuts[x]):
                        continue
                    for above, p, q in ((True, all_p - low_p, all_q - low_q), (False, low_p, low_q)):
                        if p >= MIN_COVER and (best is None or (_purity(p, q) * p**0.15, p) > best[0]):
                            best = ((_purity(p, q) * p**0.15, p), _purity(p, q), Condition(x, above, cuts[x][b], b))
            if best is None or best[1] <= score:
                break
            conditions, score = [*conditions, best[2]], best[1]
            if score > 0.995:
                break
        if not conditions:
            break
        tried = [conditions[:k] for k in range(1, len(conditions) + 1)]
        sums = rows.where(left & F.col("prune")).agg(*(F.sum(F.when(_holds(c), F.col("n") * kind).otherwise(0)).alias(f"{name}{k}") for k, c in enumerate(tried) for name, kind in (("p", F.col("bad")), ("q", 1 - F.col("bad"))))).first()
        counted = [(sums[f"p{k}"] or 0, sums[f"q{k}"] or 0) for k in range(len(tried))]
        k = max(range(len(tried)), key=lambda i: (_purity(*counted[i]), -i))
        p, q = counted[k]
        if p < 1 or _purity(p, q) < MIN_PRECISION and p / max(p + q, 1) < MIN_PRECISION:
            break
        rules.append(Rule(tried[k], p, q))
    return DecisionList(rules)


def learn_from(stats: DataFrame, column: str, doc_id: str, labels: DataFrame, label: str = "quality") -> DecisionList:
    """``stats``: rows with an id and a struct of STATS, as ``text_stats`` writes them; ``labels``: doc_id and label (0 or 1)."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("q"))
    one = stats.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{column}`").alias("s")).where(F.col("id").isNotNull() & ~base_failed(F.col("s")))
    values = features(F.col("s"))
    rows = one.join(marked, "id").select((F.col("q") < 1).cast("int").alias("bad"), F.pmod(F.xxhash64(F.col("id")), F.lit(3)).alias("part"), *(v.alias(k) for k, v in values.items()))
    return learn(cut(rows), list(values))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, STATS, base_failed, kept."""
    measured, column = text_stats(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), keep_text=False)
    found, s = learn_from(measured, column, "doc_id", labels), F.col(column)
    return measured.select("doc_id", *(s[x].alias(x) for x in STATS), base_failed(s).alias("base_failed"), (~base_failed(s) & found.verdict(s)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned list keep, columns unchanged. Documents are written once with their statistics, so texts aren't shuffled."""
    measured, column = text_stats(docs, text)
    s = F.col(f"`{column}`")
    kept = measured.where(~base_failed(s) & learn_from(measured, column, doc_id, labels).verdict(s))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
