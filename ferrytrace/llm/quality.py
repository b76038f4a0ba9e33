"""Quality by a sparse ensemble of rules.

Statistics of a text are Spark columns.  Small trees over the statistics of labelled texts are cut into
their paths: each path is a rule, a conjunction of comparisons.  A lasso logistic regression gives
weights to the rules and leaves most of them at zero; the rest is compiled back into one Spark column,
so every text is scored where it is read.

Trees and weights are learned from at most about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the
id; only their statistics reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrytrace.llm.common import ids_and_text

SAMPLE_ROWS = 20_000
TREES = 60
DEPTH = 3
CUTS = 48
# Rows a leaf holds at least.
LEAF = 4
# Strengths of the lasso, as shares of the least that leaves no rule; held-out rows choose.
STRENGTHS = (0.3, 0.1, 0.05, 0.02, 0.01, 0.005)
FOLDS = 4

Condition = tuple[int, bool, float]  # statistic, whether it is above, threshold
Rule = tuple[Condition, ...]


def _count(text: Column, kind: str) -> Column:
    """Code points in runs of a kind."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; none is null, whatever the text."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")

    def share(kind: str) -> Column:
        return _count(text, kind) / size

    def distinct(parts: Column) -> Column:
        return F.size(F.array_distinct(parts)) / F.greatest(F.size(parts), F.lit(1))

    # A word again right after itself.
    repeated = F.regexp_replace(text, r"(?<!\S)(\S++)(?=\s\1(?!\S))", "")
    return {
        "size": F.log1p(F.length(text).cast("double")),
        "letters": share(r"\p{L}"),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{Nd}"),
        "space": share(r"\s"),
        "symbols": share(r"[#$%&*@^~<>{}\[\]\\/=+_]"),
        "bars": share(r"[|]"),
        "calls": share(r"[!?]"),
        "stops": share(r"[.,;:]"),
        "other": share(r"[^\p{L}\p{N}\s\x00-\x7F]"),
        "repeated": (F.length(text) - F.length(repeated)) / size,
        "distinct_words": distinct(words),
        "distinct_lines": distinct(lines),
        "word_length": size / F.greatest(F.size(words), F.lit(1)),
    }


def _holds(values: np.ndarray, rule: Rule) -> np.ndarray:
    found = np.ones(len(values), bool)
    for at, above, cut in rule:
        found &= (values[:, at] > cut) == above
    return found


def _best_split(values: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[float, int, float] | None:
    """(impurity left, statistic, threshold) of the split with the purest sides."""
    best = None
    for at in columns.tolist():
        column = values[:, at]
        ordered = np.unique(column)
        if len(ordered) < 2:
            continue
        cuts = (ordered[1:] + ordered[:-1]) / 2
        cuts = np.unique(cuts[np.linspace(0, len(cuts) - 1, min(CUTS, len(cuts))).astype(int)])
        side = np.searchsorted(cuts, column)  # how many thresholds are below
        below = np.cumsum(np.bincount(side, minlength=len(cuts) + 1))[:-1]
        ones = np.cumsum(np.bincount(side, y, minlength=len(cuts) + 1))[:-1]
        above, others = len(y) - below, y.sum() - ones
        with np.errstate(divide="ignore", invalid="ignore"):
            impure = ones * (below - ones) / below + others * (above - others) / above
        impure = np.where((below >= LEAF) & (above >= LEAF), impure, np.inf)
        i = int(np.argmin(impure))
        if np.isfinite(impure[i]) and (best is None or impure[i] < best[0]):
            best = (float(impure[i]), at, float(cuts[i]))
    return best


def tree_paths(values: np.ndarray, y: np.ndarray, rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """The rules of all nodes below: each is the path to a node."""
    ones = y.sum()
    if len(path) == DEPTH or ones in (0, len(y)) or len(y) < 2 * LEAF:
        return []
    some = rng.permutation(values.shape[1])[: max(2, values.shape[1] // 2)]
    split = _best_split(values, y, some)
    if split is None or split[0] >= ones * (len(y) - ones) / len(y) - 1e-9:
        return []
    _, at, cut = split
    above, found = values[:, at] > cut, []
    for side in (False, True):
        rule = (*path, (at, side, cut))
        rows = above == side
        found += [rule, *tree_paths(values[rows], y[rows], rng, rule)]
    return found


def simplified(rule: Rule) -> Rule:
    """Of several comparisons of one statistic in one direction, only the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for at, above, cut in rule:
        known = tight.get((at, above), cut)
        tight[at, above] = max(known, cut) if above else min(known, cut)
    return tuple(sorted((at, above, cut) for (at, above), cut in tight.items()))


def lasso_logistic(
    x: np.ndarray, ones: np.ndarray, size: np.ndarray, strength: float, start: np.ndarray, steps: int = 300
) -> np.ndarray:
    """Weights (the last one is the constant, which isn't shrunk) by accelerated proximal gradient.  Row i
    of ``x`` stands for ``size[i]`` texts, ``ones[i]`` of them with label 1."""
    total = max(size.sum(), 1e-12)
    curvature = (x * (size / total)[:, None]).T @ x
    step = 4.0 / max(float(np.linalg.eigvalsh(curvature)[-1]), 1e-12)
    weight, ahead, momentum = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        moved = ahead - step * (x.T @ (size * p - ones)) / total
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * strength, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = moved + (momentum - 1) / after * (moved - weight)
        change = np.abs(moved - weight).max()
        weight, momentum = moved, after
        if change < 1e-7:
            break
    return weight


@dataclass
class RuleModel:
    """Rules with their weights, and the constant."""

    names: list[str]
    constant: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, statistic: dict[str, Column]) -> Column:
        """The score, from columns of the statistics."""

        def holds(rule: Rule) -> Column:
            values = [(statistic[self.names[at]], above, cut) for at, above, cut in rule]
            return reduce(lambda a, b: a & b, [v > cut if above else v <= cut for v, above, cut in values])

        terms = [F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        terms.append(F.lit(float(self.constant)))
        while len(terms) > 1:  # in pairs: a long chain of sums would be too deep an expression
            terms = [reduce(lambda a, b: a + b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.constant)
        for rule, weight in self.rules:
            total += weight * _holds(values, rule)
        return 1 / (1 + np.exp(-total))

    def __str__(self) -> str:
        def text(rule: Rule) -> str:
            return " and ".join(f"{self.names[at]} {'>' if above else '<='} {cut:.4g}" for at, above, cut in rule)

        return "\n".join(f"{weight:+.3f} if {text(rule)}" for rule, weight in self.rules)


def fit(names: list[str], values: np.ndarray, labels: np.ndarray) -> RuleModel:
    """The model for rows of statistics and labels 0 / 1.  Equal rows count once; without both labels the
    score is the share of label 1 (1/2 without rows)."""
    rows = np.unique(np.column_stack([values, labels]), axis=0)
    values, y = rows[:, :-1], rows[:, -1]
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return RuleModel(names, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(7)
    rules: set[Rule] = set()
    for _ in range(TREES):
        # Both labels are drawn alike, so that the rarer one has rules too.
        some = np.concatenate([rng.choice(np.flatnonzero(y == v), max(int((y == v).sum()), LEAF)) for v in (0, 1)])
        shares = np.where(y[some] == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        some = rng.choice(some, len(some), p=shares / shares.sum())
        rules.update(map(simplified, tree_paths(values[some], y[some], rng)))
    listed, seen = [], set()
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        held = _holds(values, rule)
        key = min(held.tobytes(), (~held).tobytes())  # a rule and its opposite say the same
        if key not in seen and held.any() and not held.all():
            seen.add(key)
            listed.append(rule)
    # Texts in which the same rules hold are one row.
    held = np.column_stack([*(_holds(values, r) for r in listed), np.ones(len(values), bool)])
    packed, group = np.unique(np.packbits(held, axis=1), axis=0, return_inverse=True)
    group = group.ravel()
    x = np.unpackbits(packed, axis=1, count=held.shape[1]).astype(float)
    fold = rng.permutation(len(y)) % FOLDS

    def counts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(group[rows], of[rows], len(x)) for of in (y, np.ones(len(y))))

    whole = counts(np.ones(len(y), bool))
    start = np.zeros(x.shape[1])
    start[-1] = np.log(y.mean() / (1 - y.mean()))
    most = np.abs(x[:, :-1].T @ (whole[0] - whole[1] * y.mean())).max(initial=1e-9) / len(y)
    losses = np.zeros((FOLDS, len(STRENGTHS)))
    for f in range(FOLDS):
        inside, outside, weight = counts(fold != f), counts(fold == f), start
        if not outside[1].any() or inside[0].sum() in (0, inside[1].sum()):
            continue
        for i, strength in enumerate(STRENGTHS):
            weight = lasso_logistic(x, *inside, strength * most, weight)
            z = np.clip(x @ weight, -30, 30)
            losses[f, i] = np.sum(outside[1] * np.logaddexp(0, z) - outside[0] * z)
    weight = start
    # The sparsest model that is no worse than the best one by more than the error of its loss.
    mean, error = losses.mean(0), losses.std(0) / np.sqrt(FOLDS)
    best = int(np.argmin(mean))
    chosen = int(np.argmax(mean <= mean[best] + error[best]))
    for strength in STRENGTHS[: chosen + 1]:
        weight = lasso_logistic(x, *whole, strength * most, weight)
    kept = [(rule, float(w)) for rule, w in zip(listed, weight[:-1], strict=True) if w]
    return RuleModel(names, float(weight[-1]), kept)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleModel:
    """The model for documents (doc_id, text) and labels (doc_id, quality).  Null labels, and labels
    without a document, count for nothing."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int"))
    count = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)).cast("double") / (1 << 30)
    # A fifth more at most than asked for; only labels are sent out, to where texts are read.
    chosen = known.where(draw * count < rows).orderBy(draw, "doc_id", "quality").limit(rows + rows // 5)
    texts = ids_and_text(docs).join(F.broadcast(chosen), "doc_id")
    found = statistics(F.col("text"))
    picked = texts.select("quality", *[c.alias(n) for n, c in found.items()]).collect()
    values = np.array([r[1:] for r in picked], float).reshape(len(picked), len(found))
    return fit(list(found), values, np.array([r[0] for r in picked], float))


def score_texts(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row: how likely its label is 1.  Null texts count as empty.
    Repeated rows stay; other columns are ignored; an empty table gives none; long texts are read whole."""
    narrow = ids_and_text(docs, key, text)
    found = statistics(F.col("text"))
    # Statistics are columns of their own, so that each is computed once however many rules use it.
    wide = narrow.select("doc_id", *[c.alias(f"s_{n}") for n, c in found.items()])
    return wide.select("doc_id", model.column({n: F.col(f"s_{n}") for n in found}).alias("score"))
