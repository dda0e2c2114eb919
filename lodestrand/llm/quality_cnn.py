"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it.  Filters learned
over byte embeddings run along each chunk and are max-pooled; a small layer turns the
pooled values into the chunk's own, and their mean and maximum over all chunks give
one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_rows
from lodestrand.shipping import ship

CHUNK, HOP, WIDTH, STRIDE = 256, 192, 8, 4
EMBED, FILTERS, HIDDEN, PAD = 8, 32, 16, 256
#: The bounds on labelled rows to learn from: their number, and the bytes of their texts
#: (each is read whole, or left out if it would pass the bound).
SAMPLE, SAMPLE_BYTES = 3_000, 64 << 20
STEPS, BATCH, RATE, SEED = 400, 32, 0.01, 7
#: Chunks that are scored at once.
AT_ONCE = 256
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(text: str) -> np.ndarray:
    """The chunks of a text's bytes, padded; one chunk of padding for an empty text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(len(data) - CHUNK) // HOP) + 1)
    padded = np.full((n - 1) * HOP + CHUNK, PAD, np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    embed = rng.standard_normal((PAD + 1, EMBED)).astype(np.float32) * 0.5
    embed[PAD] = 0
    return {"embed": embed, "filters": draw(WIDTH * EMBED, FILTERS), "shift": np.zeros(FILTERS, np.float32), "mid": draw(FILTERS, HIDDEN), "mid_shift": np.zeros(HIDDEN, np.float32), "out": draw(2 * HIDDEN) * 0.5, "out_shift": np.zeros(1, np.float32)}


def _windows(net: dict[str, np.ndarray], chunks: np.ndarray) -> np.ndarray:
    """Embedded bytes of every filter position of every chunk."""
    x = net["embed"][chunks]
    view = np.lib.stride_tricks.as_strided(x, (len(x), POSITIONS, WIDTH * EMBED), (x.strides[0], STRIDE * x.strides[1], x.strides[2]))
    return view.reshape(-1, WIDTH * EMBED)


def pooled(net: dict[str, np.ndarray], chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The max-pooled filter values of each chunk and the positions they come from."""
    values = (_windows(net, chunks) @ net["filters"]).reshape(len(chunks), POSITIONS, FILTERS)
    place = values.argmax(1)
    return np.take_along_axis(values, place[:, None], 1)[:, 0] + net["shift"], place


def _combined(net, top, heads):
    """From pooled chunk values to the logit of each document; what the way back needs."""
    p = np.maximum(top, 0)
    h = np.maximum(p @ net["mid"] + net["mid_shift"], 0)
    n = np.diff(np.r_[heads, len(h)])[:, None].astype(np.float32)
    mean, most = np.add.reduceat(h, heads) / n, np.maximum.reduceat(h, heads)
    return np.concatenate([mean, most], 1) @ net["out"] + net["out_shift"][0], p, h, n, mean, most


def scores(net: dict[str, np.ndarray], texts: list[str]) -> np.ndarray:
    """The probability of label 1 for each text, from all its chunks."""
    found, tops, sizes, held = [], [], [], []

    def close():
        if sizes:
            logit = _combined(net, np.concatenate(tops), np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64))[0]
            found.append(1 / (1 + np.exp(-logit.astype(np.float64))))
            tops.clear(), sizes.clear()

    def flush():
        if held:
            block = np.concatenate(held)
            tops.extend(pooled(net, block[i : i + AT_ONCE])[0] for i in range(0, len(block), AT_ONCE))
            held.clear()

    waiting = 0
    for text in texts:
        own = chunks_of(text)
        held.append(own)
        sizes.append(len(own))
        waiting += len(own)
        if waiting >= 8 * AT_ONCE:
            flush()
            close()
            waiting = 0
    flush()
    close()
    return np.concatenate(found) if found else np.zeros(0)


def gradients(net: dict[str, np.ndarray], chunks: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The slopes of the mean cross-entropy of some documents, given by the chunks of all
    of them, the number of each one's, and their labels."""
    heads = np.r_[0, np.cumsum(sizes)[:-1]]
    blocks = [slice(i, i + AT_ONCE) for i in range(0, len(chunks), AT_ONCE)]
    top, place = (np.concatenate(x) for x in zip(*(pooled(net, chunks[s]) for s in blocks), strict=True))
    logit, p, h, n, mean, most = _combined(net, top, heads)
    slope = (1 / (1 + np.exp(-logit)) - y) / len(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    grad = {"out": np.concatenate([mean, most], 1).T @ slope, "out_shift": slope.sum(keepdims=True)}
    dh = (slope[:, None] * net["out"][:HIDDEN] / n)[owner]
    is_most = h == most[owner]
    ties = np.add.reduceat(is_most.astype(np.float32), heads)[owner]
    dh += is_most / ties * (slope[:, None] * net["out"][HIDDEN:])[owner]
    dh *= h > 0
    grad["mid"], grad["mid_shift"] = p.T @ dh, dh.sum(0)
    dp = (dh @ net["mid"].T) * (top > 0)
    grad["shift"] = dp.sum(0)
    grad["filters"], grad["embed"] = np.zeros_like(net["filters"]), np.zeros_like(net["embed"])
    for s in blocks:
        # Only the positions that were the greatest have a share in the result.
        c, f = np.nonzero(dp[s])
        bytes_at = chunks[s][c[:, None], (place[s][c, f] * STRIDE)[:, None] + np.arange(WIDTH)]
        seen = net["embed"][bytes_at].reshape(len(c), WIDTH * EMBED)
        share = dp[s][c, f][:, None]
        for k in range(FILTERS):
            mine = f == k
            grad["filters"][:, k] += (seen[mine] * share[mine]).sum(0)
        spread = (share * net["filters"].T[f]).reshape(-1, EMBED)
        for k in range(EMBED):
            grad["embed"][:, k] += np.bincount(bytes_at.reshape(-1), spread[:, k], PAD + 1)
    grad["embed"][PAD] = 0
    return grad


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """A network fitted to labelled texts, each from all its chunks, by Adam; the same for the same input."""
    net, rng = initial(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y):
        net["out"][:] = 0  # nothing is known: every score is one half
        return net
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    step = 0
    each = -(-len(texts) // BATCH)
    total = each * -(-steps // each)
    while step < total:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            docs = [chunks_of(texts[i]) for i in chosen]
            grad = gradients(net, np.concatenate(docs), np.array([len(d) for d in docs]), y[chosen])
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / total)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray]:
    """A network learned from at most `sample` labelled rows that aren't held out and
    `sample_bytes` of text, picked by a hash of the id and the text.

    Texts teach whole; a null one is empty.  Rows without a label of 0 or 1 and held-out
    rows teach nothing; rows that repeat teach once; of an id with two labels the lesser
    counts.  Of empty tables nothing is learned: every score is one half.  Other columns
    aren't read, whatever their names.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_label")).orderBy(F.xxhash64("_k"), "_k").limit(sample)
    known = known.select("_k", F.col("_label").cast("int"))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(known), F.col("_key") == F.col("_k")).select("_key", "_label", "_text", F.xxhash64("_key", "_text").alias("_hash"))
    # Ids may repeat, so rows are picked first, without their texts.
    sizes = rows.select("_hash", F.octet_length("_text").alias("n")).distinct().orderBy("_hash").limit(sample).collect()
    picked, room = [], sample_bytes
    for r in sizes:
        if r["n"] <= room:
            picked.append((r["_hash"],))
            room -= r["n"]
    wanted = docs.sparkSession.createDataFrame(picked, "_h long")  # `sample` rows at most
    found = rows.join(F.broadcast(wanted), F.col("_hash") == F.col("_h")).groupBy("_hash").agg(F.first("_text").alias("_text"), F.first("_label").alias("_label")).collect()
    found.sort(key=lambda r: r["_hash"])
    return train([r["_text"] for r in found], [r["_label"] for r in found])


def _score(net):
    def run(batches):
        for batch in batches:
            texts = [t.as_py() or "" for (t,) in arrow_rows(batch, "_text")]
            yield pa.record_batch([batch.column("_key"), batch.column("_held"), pa.array(scores(net.value, texts))], names=["_key", "_held", "score"])

    return run


def score(docs: DataFrame, net: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its key, held_out (boolean), score (double), predicted (int).

    The score sees the text alone, all of it, however long.  A null text is an empty one,
    and that has a score too; null and repeated keys give a row each.  Other columns
    aren't read, whatever their names; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), held_out(key).alias("_held"), F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    found = rows.mapInArrow(_score(shared), f"_key {rows.schema['_key'].dataType.simpleString()}, _held boolean, score double")
    return found.select(F.col("_key").alias(key), F.col("_held").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
