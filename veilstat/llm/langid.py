"""Language of a text by a bidirectional gated recurrent network over its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.common import fresh, remainder, text_batches

HIDDEN = 4
#: Bytes that the network reads at once; it starts anew at each window.
WINDOW = 96
#: Windows in one batch of the prediction.
LANES = 4096
#: Labelled windows per language that the training takes, at most about twice as many.
TRAINING_WINDOWS = 600
EPOCHS = 12
BATCH = 96
RATE = 0.02


def new_network(classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Per direction: gate inputs per byte (update, reset, new), recurrent weights, bias; output."""
    draw = np.random.default_rng(seed)
    net = {}
    for way in "fb":
        net[f"x{way}"] = draw.normal(0, 0.3, (3 * hidden, 256))
        net[f"u{way}"] = draw.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        net[f"c{way}"] = np.zeros((hidden, 1))
        net[f"o{way}"] = draw.normal(0, 1 / np.sqrt(hidden), (classes, hidden))
    net["o"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in net.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: 1 / (1 + e^-x), written with tanh."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _run(net, way: str, data: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, hidden, lane) of one direction; what the gradient needs, if kept."""
    time, lanes = data.shape
    size = net[f"u{way}"].shape[1]
    inputs, weights, bias = net[f"x{way}"], net[f"u{way}"], net[f"c{way}"]
    states, kept = np.empty((time, size, lanes), np.float32), []
    state = np.zeros((size, lanes), np.float32)
    recurrent = np.empty((3 * size, lanes), np.float32)
    gates = np.empty((3 * size, lanes), np.float32)
    for t in range(time) if way == "f" else range(time - 1, -1, -1):
        np.take(inputs, data[t], axis=1, out=gates, mode="clip")
        np.matmul(weights, state, out=recurrent)
        both = gates[: 2 * size]
        both += recurrent[: 2 * size]
        _sigmoid(both)
        update, reset = gates[:size], gates[size : 2 * size]
        inner = recurrent[2 * size :]
        inner += bias
        new = gates[2 * size :]
        if keep:
            kept.append((t, state, both.copy(), inner.copy()))
        inner *= reset
        new += inner
        np.tanh(new, out=new)
        out = states[t]
        np.subtract(state, new, out=out)
        out *= update
        out += new
        if keep:
            kept[-1] += (new.copy(),)
        state = out
    return states, kept


def _softmax(scores: np.ndarray) -> np.ndarray:
    """In place over the class axis (time, class, lane)."""
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def label_positions(net, data: np.ndarray) -> np.ndarray:
    """Probabilities (time, class, lane) of every byte of ``data`` (time, lane)."""
    scores = np.matmul(net["of"], _run(net, "f", data, False)[0])
    scores += np.matmul(net["ob"], _run(net, "b", data, False)[0])
    scores += net["o"]
    return _softmax(scores)


def gradients(net, data, labels, mask) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy per position, and its gradient by backpropagation through time."""
    runs = {way: _run(net, way, data, True) for way in "fb"}
    scores = sum(np.matmul(net[f"o{way}"], runs[way][0]) for way in "fb") + net["o"]
    chances = _softmax(scores)
    lanes, total = np.arange(data.shape[1]), mask.sum()
    loss = float(-(np.log(chances[:, labels, lanes] + 1e-9) * mask).sum() / total)
    chances[:, labels, lanes] -= 1
    chances *= (mask / total)[:, None, :]
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["o"] = chances.sum(axis=(0, 2))[:, None]
    for way in "fb":
        states, kept = runs[way]
        grad[f"o{way}"] = np.einsum("tcl,thl->ch", chances, states)
        at_state = np.matmul(net[f"o{way}"].T, chances)
        size = states.shape[1]
        back = np.zeros(states.shape[1:], np.float32)
        pre_all, bytes_all = [], []
        for t, state, both, inner, new in reversed(kept):
            update, reset = both[:size], both[size:]
            back = back + at_state[t]
            pre_new = back * (1 - update) * (1 - new * new)
            pre_update = back * (state - new) * update * (1 - update)
            pre_reset = pre_new * inner * reset * (1 - reset)
            at_inner = pre_new * reset
            recurrent = np.concatenate([pre_update, pre_reset, at_inner])
            grad[f"u{way}"] += recurrent @ state.T
            grad[f"c{way}"] += at_inner.sum(axis=1, keepdims=True)
            pre_all.append(np.concatenate([pre_update, pre_reset, pre_new]))
            bytes_all.append(data[t])
            back = back * update + net[f"u{way}"].T @ recurrent
        pre, seen = np.concatenate(pre_all, axis=1), np.concatenate(bytes_all)
        for row in range(3 * size):
            grad[f"x{way}"][row] = np.bincount(seen, pre[row], minlength=256)
    return loss, grad


def train(windows: list[bytes], labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> dict:
    """Adam over shuffled batches of windows; deterministic."""
    net, draw = new_network(classes), np.random.default_rng(11)
    data, mask = _lanes(windows)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    steps, total = 0, epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            _, grad = gradients(net, data[:, at], labels[at], mask[:, at])
            steps += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - 0.9 * steps / total)
            for name, g in grad.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                step = first[name] / (1 - 0.9**steps)
                net[name] -= rate * step / (np.sqrt(second[name] / (1 - 0.99**steps)) + 1e-6)
    return net


def _lanes(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows side by side (time, lane), filled up with spaces; which places are real."""
    data = np.frombuffer(b"".join(w.ljust(WINDOW) for w in windows), np.uint8)
    sizes = np.array([len(w) for w in windows])
    mask = (np.arange(WINDOW)[:, None] < sizes[None, :]).astype(np.float32)
    return np.ascontiguousarray(data.reshape(len(windows), WINDOW).T), mask


def pool(net, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all bytes of each text (no bytes: zeros)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros((len(texts), len(net["o"])))
    padded = b"".join(t.ljust(int(n) * WINDOW) for t, n in zip(texts, counts))
    flat = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    real = np.minimum(WINDOW, np.repeat(sizes, counts) - place * WINDOW)
    for i in range(0, len(flat), LANES):
        data = np.ascontiguousarray(flat[i : i + LANES].T)
        chances = label_positions(net, data)
        short = np.flatnonzero(real[i : i + LANES] < WINDOW)
        for lane in short:
            chances[real[i + lane] :, :, lane] = 0
        sums = chances.sum(axis=0, dtype=np.float64)
        for c in range(len(out[0])):
            out[:, c] += np.bincount(owner[i : i + LANES], sums[c], minlength=len(texts))
    return out / np.maximum(sizes, 1)[:, None]


def _training_windows(docs: DataFrame, per_language: int) -> list:
    """About ``per_language`` windows of each language, at places given by a hash."""
    labelled = docs.filter("not held_out and doc_id is not null and lang is not null")
    labelled = labelled.filter("has_letter")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - WINDOW))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(
        *[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(per_language / n))]
    )
    picked = labelled.filter(draw < share[F.col("lang")])
    picked = picked.select("lang", F.expr("doc_id").alias("id"), place.alias("p"), "text")
    window = F.col("text").substr((F.col("p") + 1).cast("int"), F.lit(WINDOW))
    rows = picked.select("lang", "id", window.alias("w")).collect()
    return sorted(rows, key=lambda r: (r["lang"], r["id"], r["w"]))


def _prepared(docs: DataFrame, per_language: int):
    """Marks of held-out rows and rows with letters, and the trained network as a broadcast."""
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    base = docs.select("doc_id", F.col("text").cast("string"), "lang", held_out, letter)
    rows = _training_windows(base, per_language)
    languages = sorted({r["lang"] for r in rows})
    net = None
    if rows:
        labels = np.array([languages.index(r["lang"]) for r in rows])
        net = train([r["w"].encode()[:WINDOW] for r in rows], labels, len(languages))
    return held_out, letter, docs.sparkSession.sparkContext.broadcast((languages, net))


def _labels(texts: pa.Array, letters: pa.Array, languages: list, net) -> tuple[list, np.ndarray]:
    """Language and score of each text."""
    best, score = ["und"] * len(texts), np.zeros(len(texts))
    rows = [i for i, yes in enumerate(letters.to_pylist()) if yes] if net else []
    for at, raw in _portions(texts, rows):
        for i, row in zip(at, pool(net, raw)):
            best[i], score[i] = languages[int(row.argmax())], min(1.0, float(row.max()))
    return best, score


def predict(docs: DataFrame, per_language: int = TRAINING_WINDOWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of every whole text.

    The network is trained on the driver, on about ``per_language`` windows of
    ``WINDOW`` characters for each value of ``lang``, from rows whose
    crc32(doc_id) mod 4 is not 2; fewer if there are fewer.  A prediction reads
    the text alone: each byte is labelled, and the mean of the probabilities is
    the document's.  Null texts and texts without a letter are ``und`` with score
    0; so are all texts if no row is labelled.  A null ``doc_id`` is not held
    out, and not learnt from.  Rows with equal ids are predicted each; other
    columns are ignored; an empty table gives an empty result.
    """
    held_out, letter, sent = _prepared(docs, per_language)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = _labels(batch.column(1), batch.column(3), *sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(best), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out, letter)
    return text_batches(rows).mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")


def label(docs: DataFrame, least: float, per_language: int = TRAINING_WINDOWS) -> DataFrame:
    """``docs`` without the rows that are ``und`` or score below ``least``.

    ``lang`` holds the predicted language in the rows that stay; all other
    columns are as they were.  If no row is labelled nothing can be told apart,
    and every text with a letter stays as it is.
    """
    _, letter, sent = _prepared(docs, per_language)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, net = sent.value
        for batch in batches:
            letters = batch.column(batch.num_columns - 1)
            columns = list(batch.columns[:-1])
            keep = letters
            if net:
                best, score = _labels(batch.column(text), letters, languages, net)
                columns[lang] = pa.array(best, columns[lang].type)
                keep = pa.array([b != "und" and x >= least for b, x in zip(best, score)], pa.bool_())
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            yield out.filter(keep)

    letter = letter.alias(fresh(docs, "has_letter"))
    return text_batches(docs.select("*", letter)).mapInArrow(each, docs.schema)


def _portions(texts: pa.Array, rows: list[int]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows and their bytes, in portions of about a million bytes."""
    held, raw, size = [], [], 0
    for i in rows:
        held.append(i)
        raw.append(texts[i].as_py().encode())
        size += len(raw[-1])
        if size > 1 << 20:
            yield held, raw
            held, raw, size = [], [], 0
    if held:
        yield held, raw
