"""Quality rules: a learned decision list over text statistics, in DataFrame functions only.

Each text becomes a row of statistics, once. From labelled rows, sequential covering grows
conjunctions of thresholds that single out the rejected class, prunes each on rows set aside,
and goes on with the rows that no rule covers yet. Histograms are counted by Spark over all
labelled rows; the driver sees one count for each statistic, step and class. The list becomes
one ordered conditional expression.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise

SPACE, SYMBOLS, WINDOW = " \t\n\x0b\f\r", "#*$%&|<>", 5
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Steps of thresholds: shares and rates in thousandths, lengths in tenths of a character.
_RATES = (1, 2, 5, 10, 20, 30, 50, 75, 100, 125, 150, 175, 200, 225, 250, 275, 300, 350, 400, 450, 500, 550, 600, 650, 700, 725, 750, 775, 800, 825, 850, 875, 900, 950, 1000, 1500, 2000, 3000)
_LENGTHS = (10, 20, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 100, 110, 120, 150, 200, 300, 500)


def _rate(part: str, whole: str, of: int = 1000) -> str:
    """SQL of the whole thousandths of ``part`` in ``whole``; 0 where ``whole`` is."""
    return f"if({whole} > 0, {part} * {of} div {whole}, 0)"


#: What rules may test: name -> (steps, SQL over the columns of ``counts``).
STATISTICS = {
    "symbols": (_RATES, _rate("n_symbols", "n_words")),
    "bangs": (_RATES, _rate("n_bangs", "n_words")),
    "pipes": (_RATES, _rate("n_pipes", "n_words")),
    "ends": (_RATES, _rate("n_ends", "n_words")),
    "digits": (_RATES, _rate("n_digits", "word_chars")),
    "capitals": (_RATES, _rate("n_capitals", "word_chars")),
    "variety": (_RATES, "if(n_words > 1, cast(floor(1000 * ln(n_distinct) / ln(n_words)) as bigint), 1000)"),
    "repeated": (_RATES, _rate("n_repeat_words", "n_words")),
    "same_next": (_RATES, _rate("n_same_next", "n_words")),
    "same_lines": (_RATES, _rate("n_dup_lines", "n_lines")),
    "word_length": (_LENGTHS, _rate("n_letters", "n_words", 10)),
}


class Term(NamedTuple):
    """statistic >= cut, or statistic < cut."""

    statistic: str
    above: bool
    cut: int

    def column(self) -> Column:
        return F.col(self.statistic) >= self.cut if self.above else F.col(self.statistic) < self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.cut}"


class Rule(NamedTuple):
    """A conjunction that rejects, and how many labelled rows it met when it was learned, by class."""

    terms: tuple[Term, ...]
    rejected: int
    wanted: int

    def column(self) -> Column:
        out = self.terms[0].column()
        for term in self.terms[1:]:
            out &= term.column()
        return out

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.terms))} ({self.rejected} : {self.wanted})"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in windows of five that the text has twice or more.

    Windows are compared as 64-bit hashes: in a text of a million words two different ones
    agree with probability 3e-8. Places are looked for only where some hash recurs at all.
    """

    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def places(h):
        """Starts of recurring windows, in order: neighbours in the order of hashes."""
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        found = _bound(pairs, lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(s, i, i + 1) | same(s, i, i - 1), x["i"])), lambda p: p.isNotNull()))
        return F.array_sort(found)

    def covered(p):
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(p, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")))["n"]

    count = _bound(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(places(h))).otherwise(0))
    return F.when(F.size(words) >= WINDOW, count).otherwise(0)


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of whole-text counts for each row of ``docs``; null texts are empty, ids are kept as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda marks: F.length("text") - F.length(F.translate("text", marks, ""))
    words = F.array_remove(F.split("text", f"[{SPACE}]+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.length(F.translate("text", SPACE, "")).alias("word_chars"), of(SYMBOLS).alias("n_symbols"), of("!").alias("n_bangs"), of("|").alias("n_pipes"), of(".!?").alias("n_ends"),
        (F.length("text") - of(SPACE + MARKS)).alias("n_letters"), of("0123456789").alias("n_digits"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("same"))).alias("l"),
        _bound(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))).alias("next"), _repeated(w).alias("again"))).alias("w"),
    )
    named = {"n_words": "w.n", "n_repeat_words": "w.again", "n_distinct": "w.distinct", "n_same_next": "w.next", "n_lines": "l.n", "n_dup_lines": "l.same"}
    plain = [c for c in rows.columns if c not in ("doc_id", "l", "w")]
    return rows.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in plain), *(F.col(c).cast("bigint").alias(n) for n, c in named.items()))


def statistics(counted: DataFrame) -> DataFrame:
    """``counts`` with what rules may test."""
    return counted.select("*", *(F.expr(sql).cast("bigint").alias(name) for name, (_, sql) in STATISTICS.items()))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def labelled(rows: DataFrame, labels: DataFrame, *, label_col: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """Statistics, y (1: wanted) and ``prune`` of the labelled rows that pass the base and whose crc32 fold of five is not 0; ids with both labels are left out."""
    marks = labels.select(F.col(label_id).alias("label_id"), F.col(label_col).cast("int").alias("y")).filter("label_id is not null and y is not null").filter(fold("label_id") != 0)
    marks = marks.groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top")
    found = rows.filter(~base_failed()).join(marks, rows["doc_id"] == marks["label_id"])
    return found.select(*STATISTICS, "y", (F.pmod(F.xxhash64("label_id"), F.lit(3)) == 0).alias("prune"))


def _histogram(rows: DataFrame) -> dict[str, list[list[int]]]:
    """statistic -> [rejected, wanted] rows by step: how many reach exactly so many of its thresholds."""
    steps = [F.struct(F.lit(name).alias("name"), sum((F.col(name) >= c).cast("int") for c in cuts).alias("step")) for name, (cuts, _) in STATISTICS.items()]
    counted = rows.select("y", F.explode(F.array(*steps)).alias("s")).groupBy("s.name", "s.step").agg(F.sum(1 - F.col("y")).alias("rejected"), F.sum("y").alias("wanted"))
    out = {name: [[0, 0] for _ in range(len(cuts) + 1)] for name, (cuts, _) in STATISTICS.items()}
    for r in counted.collect():  # at most a row for each step
        out[r["name"]][r["step"]] = [r["rejected"], r["wanted"]]
    return out


def best_term(histogram: dict[str, list[list[int]]]) -> tuple[Term, int, int] | None:
    """The threshold of the largest information gain, and what it covers; ties go to the first statistic and cut."""
    best, top = None, 0.0
    for name, steps in histogram.items():
        p, n = (sum(s[k] for s in steps) for k in (0, 1))
        if not p or not n:
            continue
        below = [0, 0]
        for cut, step in zip(STATISTICS[name][0], steps):
            below = [below[0] + step[0], below[1] + step[1]]
            for above, (a, b) in ((True, (p - below[0], n - below[1])), (False, tuple(below))):
                gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n))) if a else 0.0
                if gain > top + 1e-9:
                    best, top = (Term(name, above, cut), a, b), gain
    return best


def learn(rows: DataFrame, *, most_rules: int = 12, most_terms: int = 4, purity: float = 0.97, least: int = 5) -> list[Rule]:
    """The ordered rules that reject, from ``labelled`` rows.

    A rule grows by the term of the largest gain until it covers no wanted row of the growing
    part, then loses last terms while that does not lower (p - n) / (p + n) on the pruning part.
    It is taken while, over both parts, it covers ``least`` rejected rows or more and at most
    ``1 - purity`` wanted ones; else the list ends. Without labels of both classes it is empty.
    """
    rules: list[Rule] = []
    while len(rules) < most_rules:
        rest = rows
        for rule in rules:
            rest = rest.filter(~rule.column())
        terms, here = [], rest.filter("not prune")
        while len(terms) < most_terms:
            found = best_term(_histogram(here))
            if found is None:
                break
            term, _, wrong = found
            terms.append(term)
            here = here.filter(term.column())
            if not wrong:
                break
        if not terms:
            break
        tried = [Rule(tuple(terms[: k + 1]), 0, 0) for k in range(len(terms))]
        sums = [F.coalesce(F.sum(F.when(r.column() & (F.col("prune") == prune) & (F.col("y") == y), 1)), F.lit(0)) for r in tried for prune in (True, False) for y in (0, 1)]
        met = list(rest.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first())
        worth = [(met[4 * k] - met[4 * k + 1]) / (met[4 * k] + met[4 * k + 1]) if met[4 * k] + met[4 * k + 1] else -1.0 for k in range(len(tried))]
        k = worth.index(max(worth))
        rejected, wanted = met[4 * k] + met[4 * k + 2], met[4 * k + 1] + met[4 * k + 3]
        if rejected < least or wanted > (1 - purity) * (rejected + wanted):
            break
        rules.append(Rule(tried[k].terms, rejected, wanted))
    return rules


def decision(rules: list[Rule]) -> Column:
    """0 where the list accepts, else the number of the rule that rejects: one ordered conditional expression."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), 1)
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), i)
    return out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, **limits) -> tuple[DataFrame, list[Rule]]:
    """Counts, statistics, base_failed, rule and kept of every row, and the rules. Texts are read once."""
    rows = materialise(statistics(counts(docs)), "rule-statistics")
    rules = learn(materialise(labelled(rows, labels), "rule-labels"), **limits)
    out = rows.withColumns({"base_failed": base_failed(), "rule": decision(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, the number of the rule that rejects (0: none) and kept, for every row.

    Labels are learned from rows of fold 1 to 4 of five only. Null and empty texts have zeros
    and fail the base; repeated rows get equal verdicts; without labels only the base rejects.
    """
    judged, _ = judge(docs, labels)
    return judged.select("doc_id", *BASE, "base_failed", "rule", "kept")
