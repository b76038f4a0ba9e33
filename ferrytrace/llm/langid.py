"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads ``STRIDE`` bytes per step, in both directions, and labels every position; a
document's probabilities are the means over its positions.  It is trained here, in numpy, by
backpropagation through time, on a bounded sample of labelled documents; all texts are then labelled
whole, where they are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytrace.llm.common import chunks, ids_and_text, string_bytes

UNDETERMINED = "und"
STRIDE = 4
# Steps of one window: the states start anew with each.
STEPS = 96
HIDDEN = 16
# The sample that is learned from: documents of each language (about), and of all at most.
DOCS_PER_LANGUAGE = 600
DOCS_AT_MOST = 12_000
# Counts of so many languages are sent out; of more, they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
ROUNDS = 200
BATCH = 128
WINDOWS_AT_ONCE = 1024

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Weights by name, and the languages of the outputs."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        weights = {}
        for way in "fb":
            weights[f"e{way}"] = rng.normal(0, 0.15, (STRIDE * 256, 3 * hidden))
            weights[f"u{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            weights[f"c{way}"] = np.zeros(3 * hidden)
        weights["v"] = rng.normal(0, 0.1, (2 * hidden, len(languages)))
        weights["d"] = np.zeros(len(languages))
        return cls(languages, {k: w.astype(np.float32) for k, w in weights.items()})

    def _run(self, rows: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, windows, hidden) for rows (windows, steps, STRIDE) of table rows."""
        table, u, c = (self.weights[x + way] for x in "euc")
        hidden = u.shape[0]
        n, steps = rows.shape[:2]
        order = range(steps) if way == "f" else range(steps - 1, -1, -1)
        states = np.empty((steps, n, hidden), np.float32)
        h, kept = np.zeros((n, hidden), np.float32), []
        x, part = np.empty((n, 3 * hidden), np.float32), np.empty((n, 3 * hidden), np.float32)
        for t in order:
            np.take(table, rows[:, t, 0], 0, out=x, mode="clip")
            for s in range(1, STRIDE):
                x += np.take(table, rows[:, t, s], 0, out=part, mode="clip")
            x += c
            g = h @ u
            gates = x[:, : 2 * hidden] + g[:, : 2 * hidden]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :hidden], gates[:, hidden:]
            new = r * g[:, 2 * hidden :]
            new += x[:, 2 * hidden :]
            np.tanh(new, out=new)
            before = h
            h = before - new
            h *= z
            h += new
            states[t] = h
            if keep:
                kept.append((t, before, z, r, new, g[:, 2 * hidden :]))
        return states, kept

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """(steps, windows, languages) for each position."""
        both = np.concatenate([self._run(rows, way, False)[0] for way in "fb"], 2)
        logits = both @ self.weights["v"] + self.weights["d"]
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(2, keepdims=True)

    def gradients(self, rows: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over positions; mask (windows, steps), label (windows)."""
        w = self.weights
        runs = {way: self._run(rows, way, True) for way in "fb"}
        both = np.concatenate([runs[way][0] for way in "fb"], 2)
        logits = both @ w["v"] + w["d"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(label)), label] -= 1
        p *= (mask.T / mask.sum())[:, :, None]
        grads = {"v": np.tensordot(both, p, ((0, 1), (0, 1))), "d": p.sum((0, 1))}
        down = p @ w["v"].T
        hidden = w["uf"].shape[0]
        for way, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
            u = w["u" + way]
            gu = np.zeros_like(u)
            inputs = np.empty((rows.shape[1], len(label), 3 * hidden), np.float32)
            dh = np.zeros((len(label), hidden), np.float32)
            for t, before, z, r, new, gn in reversed(runs[way][1]):
                dh = dh + down[t][:, part]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                inputs[t] = np.concatenate([dz, dr, dn], 1)
                dg = np.concatenate([dz, dr, dn * r], 1)
                gu += before.T @ dg
                dh = dh * z + dg @ u.T
            flat = inputs.reshape(-1, 3 * hidden)
            ge = np.zeros_like(w["e" + way])
            for s in range(STRIDE):
                at = rows[:, :, s].T.ravel()
                order = np.argsort(at, kind="stable")
                used, begin = np.unique(at[order], return_index=True)
                ge[used] += np.add.reduceat(flat[order], begin, 0)
            grads |= {"u" + way: gu, "e" + way: ge, "c" + way: flat.sum(0)}
        return grads


def _table_rows(taken: np.ndarray) -> np.ndarray:
    """Table rows of the bytes of windows: each place of a step has a part of the table."""
    return taken.astype(np.int32) + np.arange(STRIDE, dtype=np.int32) * 256


def _byte_windows(data: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, ...]:
    """Bytes (windows, steps, STRIDE) that cover all texts, how many positions of each window are
    text, and the text each belongs to."""
    span = steps * STRIDE
    sizes = np.diff(offsets)
    count = -(-sizes // span)
    owner = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + within * span
    left = np.minimum(offsets[owner + 1] - start, span)
    padded = np.concatenate([data, np.zeros(span, np.uint8)])
    taken = np.lib.stride_tricks.sliding_window_view(padded, span)[start]
    taken[np.arange(span) >= left[:, None]] = 0
    return taken.reshape(-1, steps, STRIDE), -(-left // STRIDE), owner


def windows_of(data: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, ...]:
    """The same with table rows in place of bytes."""
    taken, left, owner = _byte_windows(data, offsets, steps)
    return _table_rows(taken), left, owner


def train(
    texts: list[str], labels: list[str], hidden: int = HIDDEN, rounds: int = ROUNDS, seed: int = 11
) -> Network:
    """Adam on random windows of the texts, every language as often as any other."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    data, offsets = string_bytes(pa.array(texts, pa.large_string()))
    rows, left, owner = windows_of(data, offsets)
    number = np.array([languages.index(x) for x in labels], int)[owner]
    of = [np.flatnonzero(number == i) for i in range(len(languages))]
    net = Network.new(languages, hidden, rng)
    first = {k: np.zeros_like(w) for k, w in net.weights.items()}
    second = {k: np.zeros_like(w) for k, w in net.weights.items()}
    present = [i for i, x in enumerate(of) if len(x)]
    for turn in range(1, rounds + 1 if present else 0):
        which = rng.choice(present, BATCH)
        picked = np.array([of[i][rng.integers(len(of[i]))] for i in which])
        mask = (np.arange(STEPS) < left[picked][:, None]).astype(np.float32)
        rate = 0.02 * min(1, turn / 20) * (1 - 0.9 * turn / rounds)
        for k, g in net.gradients(rows[picked], mask, number[picked]).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            fix = rate * np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn)
            net.weights[k] -= fix * first[k] / (np.sqrt(second[k]) + 1e-8)
    return net


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): means over all positions of each text; zeros for empty texts."""
    total = np.zeros((len(offsets) - 1, len(net.languages)))
    # Of all windows only the bytes are held.
    taken, left, owner = _byte_windows(data, offsets)
    order = np.argsort(left, kind="stable")
    for a in range(0, len(order), WINDOWS_AT_ONCE):
        some = order[a : a + WINDOWS_AT_ONCE]
        longest = int(left[some].max())
        found = net.probabilities(_table_rows(taken[some, :longest]))
        mask = np.arange(longest)[:, None] < left[some]
        np.add.at(total, owner[some], np.einsum("tnl,tn->nl", found, mask.astype(np.float32)))
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def sample(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE, at_most: int = DOCS_AT_MOST) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``per_language`` documents each, ``at_most`` in all, chosen by a
    hash of the row.  Of a long text one stretch goes to the driver, at a place chosen by the hash."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("lang", "text", F.lit(5)), F.lit(1 << 30)).cast("double") / (1 << 30)
    few = counted.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    chosen = rows.join(F.broadcast(counted) if few else counted, "lang").withColumn("draw", draw)
    chosen = chosen.where(F.col("draw") * F.col("n") < per_language)
    reach = STEPS * STRIDE * 3
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - reach, F.lit(0)) + 1) + 1
    piece = F.substr("text", place.cast("int"), F.lit(reach))
    found = chosen.select("draw", "lang", piece.alias("piece")).orderBy("draw", "lang", "piece").limit(at_most).collect()
    return [r["piece"] for r in found], [r["lang"] for r in found]


def _predictor(net: Network | None):
    def predict(texts: pa.Array) -> tuple[list[str], list[float]]:
        lettered = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
        if net is None or not net.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        found = document_probabilities(net, *string_bytes(texts))
        best = found.argmax(1)
        named = [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
        scores = [float(min(1.0, f[b])) if ok else 0.0 for f, b, ok in zip(found, best, lettered, strict=True)]
        return named, scores

    return predict


def learn(labelled: DataFrame) -> Network | None:
    """The network for (text, lang) rows; None where there is nothing to learn from."""
    texts, labels = sample(labelled)
    return train(texts, labels) if texts else None


def predict_languages(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (mean probability of the language over all positions).

    Null texts, and texts without a letter, are ``und`` with score 0; so are all without a network.
    Repeated rows stay; other columns are ignored; an empty table gives none.
    """
    predict = _predictor(net)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            named, scores = predict(chunk.column("text"))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    narrow = ids_and_text(docs, key, text)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Network | None, least: float = 0.4, text: str = "text") -> DataFrame:
    """The documents, all columns, whose language is determined with a score of ``least`` or more."""
    predict = _predictor(net)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text):
            named, scores = predict(chunk.column(text))
            kept = [n != UNDETERMINED and s >= least for n, s in zip(named, scores, strict=True)]
            yield chunk.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
