"""Secret scans: patterns for known kinds, and a character convolutional network for the rest.

The base findings are those of three patterns (``assign``, ``access``, ``hex``).  The
network judges every candidate that no base finding covers: a run of 16 or more token characters, together
with ``CONTEXT`` characters on either side.  It is a one-layer convolution over character classes
with max-pooling and a dense layer, in numpy.  Candidates at or above its threshold are added as kind ``net``;
base findings stay as they are.

It is trained on labelled candidates.  Those that a base finding covers are secrets, others are not,
unless a keyword of secrets stands close before them (they are left out).  So that it learns form and not
just what the patterns know already, secrets come again with what stands before them blotted out and
moved into the surroundings of others, beside keys made up of several alphabets and lengths; made-up names and
paths are among the others.

A part of the candidates is set apart by their own characters, so that no secret is on both sides:
on it, the output is calibrated (Platt), and the threshold is the highest that keeps ``RECALL`` of the
secrets there.  ``unseen_recall`` says how many secrets of a form it finds when it learns from others only.

A candidate longer than ``SEEN`` is judged by windows of ``SEEN`` characters that overlap by half,
from its beginning to its end, and has the largest of their probabilities.

The network is fitted on the distinct labelled windows of all rows.  Up to ``BLOCK`` of them are learnt in the
driver.  More are dealt by hash to at most ``SHARDS`` shards; in each epoch every shard goes on from the
common network, block after block, and the shards' networks are averaged by their rows.  Calibration and
threshold then come from a histogram of the outputs of everything that was set apart, in bins of
1 / ``FINE``, each counted at its lower edge, so that the threshold keeps its recall.  The network
does not depend on how rows lie.

Null texts count as empty.  Repeated rows get a row each; a null doc_id stays null; other
columns are not read.  Without any labelled secret nothing is added to the base.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs of at least 16 token characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
CONTEXT = 24
#: Characters of a candidate that the network sees at once.
SEEN = 48
WIDTH, FILTERS, HIDDEN = 5, 24, 16
RECALL, EPOCHS = 0.99, 12
#: Labelled windows that are held and learnt at a time, and shards at most that learn side by side.
BLOCK, SHARDS = 1 << 14, 64
#: Bins of the histogram of outputs, for each unit.
FINE = 256
#: Made-up keys, and made-up names and paths, that training adds to each block.
MADE = 1500


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base findings, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Character classes of the network's input: 0 nothing, then lower vowels, lower others a-f, ... ; a class a column.
def _class_table() -> np.ndarray:
    t = np.full(128, 9, np.uint8)
    for group, k in (("aeiou", 1), ("bcdf", 2), ("ghjklmnpqrstvwxyz", 3), ("AEIOU", 4), ("BCDFGHJKLMNPQRSTVWXYZ", 5), ("0123456789", 6), ("+/_-", 7), ("=:@", 8), (" \t\n", 10), ("\"'", 11), (".,;!?", 12)):
        for c in group:
            t[ord(c)] = k
    return t


_CLASSES = _class_table()
N_CLASSES = 14  # 13: beyond ASCII
LENGTH = CONTEXT + SEEN + CONTEXT


def window(text: str, a: int, b: int, blot: bool = False) -> np.ndarray:
    """The classes of the characters before, in and after a candidate; ``blot`` leaves out what stands before."""
    row = np.zeros(LENGTH, np.uint8)
    before = "" if blot else text[max(0, a - CONTEXT) : a]
    for at, part in ((CONTEXT - len(before), before), (CONTEXT, text[a : min(b, a + SEEN)]), (CONTEXT + SEEN, text[b : b + CONTEXT])):
        if part:
            cps = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            row[at : at + len(cps)] = np.where(cps < 128, _CLASSES[np.minimum(cps, 127)], 13)
    return row


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """The parts of a candidate that the network sees one by one."""
    starts = [*range(a, b - SEEN, SEEN // 2), max(a, b - SEEN)]
    return [(x, min(b, x + SEEN)) for x in starts]


class Net:
    """One convolution, ReLU, max-pool over candidate and context apart, dense, ReLU, dense."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.conv = r.normal(0, 0.3, (WIDTH, N_CLASSES, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.w1, self.b1 = r.normal(0, 0.2, (3 * FILTERS, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = r.normal(0, 0.3, HIDDEN), 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1
        self.m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        self.v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        self.step = 0.0

    NAMES = ("conv", "bias", "w1", "b1", "w2", "b2")

    def state(self) -> np.ndarray:
        """What training changes, as one vector: shards' networks are averaged by it."""
        return np.concatenate([*(np.ravel(x) for k in self.NAMES for x in (getattr(self, k), self.m[k], self.v[k])), [self.step]])

    def restore(self, flat: np.ndarray) -> Net:
        at = 0
        for k in self.NAMES:
            shape, size = np.shape(getattr(self, k)), np.size(getattr(self, k))
            parts = [flat[at + i * size : at + (i + 1) * size].reshape(shape).copy() for i in range(3)]
            setattr(self, k, parts[0])
            self.m[k], self.v[k] = parts[1:]
            at += 3 * size
        self.step = float(flat[at])
        return self

    #: Positions of the convolution's output that lie before, in and after the candidate.
    PARTS = ((0, CONTEXT - 2), (CONTEXT - 2, CONTEXT + SEEN - 2), (CONTEXT + SEEN - 2, LENGTH - WIDTH + 1))

    def _forward(self, x: np.ndarray) -> tuple:
        n = LENGTH - WIDTH + 1
        z = np.zeros((len(x), n, FILTERS)) + self.bias
        for j in range(WIDTH):  # a class is a column, so the product is a lookup
            z += self.conv[j][x[:, j : j + n]]
        # the mean beside the maximum would see density; the maximum alone keeps the gradient sparse
        top = [a + z[:, a:b].argmax(1) for a, b in self.PARTS]
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)
        p = np.concatenate([np.maximum(z[rows, t, cols], 0) for t in top], 1)
        h = np.maximum(p @ self.w1 + self.b1, 0)
        return top, p, h, h @ self.w2 + self.b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[3] for i in range(0, len(x), 256)]) if len(x) else np.empty(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(self.logits(x))

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z * self.scale + self.shift, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the weighted cross-entropy; goes on from the moments of a training before."""
        r = np.random.default_rng(seed)
        m, v = self.m, self.v
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                at = order[i : i + 64]
                xb = x[at]
                top, p, h, out = self._forward(xb)
                d = weight[at] * (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[at]) / len(at)
                dh = np.outer(d, self.w2) * (h > 0)
                dp = (dh @ self.w1.T) * (p > 0)
                g = {"w2": h.T @ d, "b2": d.sum(), "w1": p.T @ dh, "b1": dh.sum(0), "conv": np.zeros_like(self.conv), "bias": np.zeros(FILTERS)}
                cols = np.broadcast_to(np.arange(FILTERS), (len(at), FILTERS))
                for k, t in enumerate(top):
                    part = dp[:, k * FILTERS : (k + 1) * FILTERS]
                    g["bias"] += part.sum(0)
                    for j in range(WIDTH):
                        np.add.at(g["conv"][j], (np.take_along_axis(xb, t + j, 1), cols), part)
                self.step += 1
                for k in self.NAMES:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * np.square(g[k])
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**self.step)) / (np.sqrt(v[k] / (1 - 0.999**self.step)) + 1e-8))

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling on candidates that training didn't see; then the recall-constrained threshold."""
        self.calibrate_on(self.logits(x), y, np.ones(len(y)), recall)

    def calibrate_on(self, z: np.ndarray, y: np.ndarray, count: np.ndarray, recall: float = RECALL) -> None:
        """The same on outputs, each of which stands ``count`` times."""
        n1, n0 = int((count * y).sum()), int((count * (1 - y)).sum())
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

        def loss(ab: np.ndarray) -> float:
            u = ab[0] * z + ab[1]
            return float((count * (np.logaddexp(0, u) - target * u)).sum() + 5e-4 * ((ab[0] - 1) ** 2 + ab[1] ** 2))

        at = np.array([1.0, 0.0])
        for _ in range(50):  # Newton's method on two parameters, with halved steps
            p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -40, 40)))
            w, off = count * np.maximum(p * (1 - p), 1e-9), count * (p - target)
            g = np.array([(off * z).sum() + 1e-3 * (at[0] - 1), off.sum() + 1e-3 * at[1]])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            change = np.linalg.solve(hess, g)
            while loss(at - change) > loss(at) and np.abs(change).max() > 1e-7:
                change /= 2
            at = at - change
            if np.abs(change).max() < 1e-6:
                break
        a, b = at.tolist()
        self.scale, self.shift = a, b
        p, n = self._scaled(z[y > 0]), count[y > 0]
        order = np.argsort(p)
        lost = np.cumsum(n[order]) <= np.floor((1 - recall) * n.sum())  # may stay below the threshold
        self.threshold = float(p[order][int(lost.sum())]) if len(p) else 1.1


_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key|AKIA", re.ASCII | re.IGNORECASE)


def labelled(text: str) -> list[tuple[np.ndarray, int]]:
    """Windows of a text's candidates, labelled; secrets twice, once without what stands before.

    In a candidate that holds a secret, windows beside the secret have no label.
    """
    found = base(text)
    out = []
    for a, b in candidates(text):
        if any(s < b and a < e for s, _, e in found):
            for x, y in windows(a, b):
                if any(s < y and x < e for s, _, e in found):
                    out += [(window(text, x, y), 1), (window(text, x, y, blot=True), 1)]
        elif not _KEYWORD.search(text, max(0, a - CONTEXT), b):
            out += [(window(text, x, y), 0) for x, y in windows(a, b)]
    return out


def windows_of(documents: DataFrame) -> DataFrame:
    """The distinct labelled windows (w, y) of all rows."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _text.slices(batches):
            found = [x for t in texts.to_pylist() for x in labelled(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32())], names=["w", "y"])

    return documents.select("text").where("text is not null").mapInArrow(collect, "w binary, y int").distinct()


def fit(documents: DataFrame) -> Net:
    """A network trained and calibrated on all labelled windows."""
    near = _spark.cut(windows_of(documents).withColumn("h", F.xxhash64("w")))
    n, secrets = near.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not secrets:
        return Net()
    if n > BLOCK:
        return learn_in_shards(near, min(SHARDS, -(-n // BLOCK)))
    return learn(*_arrays(near.orderBy(F.desc("y"), "h", "w").select("w", "y").toArrow()))


def _arrays(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows.column("w").to_pylist()), np.uint8).reshape(-1, LENGTH), rows.column("y").to_numpy().astype(np.int64)


def learn(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Net:
    """A network from labelled windows, calibrated on those whose candidate's form falls to the side that is set apart."""
    rows, label, apart, balance = examples(x, y, seed)
    net = Net()
    net.train(rows[~apart], label[~apart], balance[~apart])
    net.calibrate(rows[apart], label[apart])
    return net


def examples(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Rows to learn from, their labels, whether they are set apart, and their weights; made-up ones come in."""
    r = np.random.default_rng(seed)
    others = np.concatenate([x[y == 0], _plain(r, MADE)])
    secrets = x[y == 1]
    keys = np.stack([window(k, *c) for k in _keys(r, MADE) for c in windows(0, len(k))])
    rows = np.concatenate([secrets, _moved(r, secrets, others), _moved(r, keys, others), others])
    label = np.arange(len(rows)) < len(rows) - len(others)
    # all windows of one candidate, wherever it stands, are on one side
    apart = np.array([zlib.crc32(w.tobytes()) % 5 == 0 for w in rows[:, CONTEXT : CONTEXT + SEEN]])
    order = r.permutation(len(rows))
    rows, label, apart = rows[order], label[order].astype(np.float64), apart[order]
    return rows, label, apart, np.where(label > 0, len(label) / (2 * label.sum()), len(label) / (2 * (1 - label).sum()))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The examples of each ``size`` windows in turn."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        x, y = _arrays(pa.Table.from_batches(parts))
        return examples(x, y, zlib.crc32(x.tobytes()))

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - sum(b.num_rows for b in held))
            held.append(part)
            batch = batch.slice(part.num_rows)
            if sum(b.num_rows for b in held) == size:
                yield whole(held)
                held = []
    if held:
        yield whole(held)


def learn_in_shards(near: DataFrame, shards: int, epochs: int = EPOCHS) -> Net:
    """A network from any number of labelled windows (w, y, h: their hash), which no task holds more than a block of."""
    sc, size = near.sparkSession.sparkContext, BLOCK
    dealt = near.repartitionById(shards, F.pmod("h", F.lit(shards)).cast("int")).sortWithinPartitions("h", "w", "y")
    dealt = _spark.cut(dealt.select("w", "y"))
    net = Net()
    for epoch in range(epochs):
        shared = sc.broadcast(net.state())

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            net, n = Net().restore(shared.value), 0
            for rows, label, apart, balance in _blocks(batches, size):
                net.train(rows[~apart], label[~apart], balance[~apart], epochs=1, seed=epoch)
                n += int((~apart).sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([net.state().tobytes()], pa.binary())], names=["n", "state"])

        learnt = sorted((r["n"], bytes(r["state"])) for r in dealt.mapInArrow(run, "n long, state binary").collect())
        net.restore(np.average([np.frombuffer(x) for _, x in learnt], axis=0, weights=[n for n, _ in learnt]))
        shared.unpersist()
    shared = sc.broadcast(net.state())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net().restore(shared.value)
        for rows, label, apart, _ in _blocks(batches, size):
            z = np.floor(net.logits(rows[apart]) * FINE).astype(np.int64)
            bins, n = np.unique(np.stack([z, label[apart].astype(np.int64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins[0]), pa.array(bins[1]), pa.array(n, pa.int64())], names=["z", "y", "n"])

    bins = dealt.mapInArrow(measure, "z long, y long, n long").groupBy("z", "y").agg(F.sum("n").alias("n")).orderBy("z", "y").toPandas()
    net.calibrate_on(bins["z"].to_numpy() / FINE, bins["y"].to_numpy(np.float64), bins["n"].to_numpy(np.float64))
    return net


def _moved(r: np.random.Generator, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Candidates in the surroundings of others."""
    out = others[r.integers(0, len(others), len(rows))]
    out[:, CONTEXT : CONTEXT + SEEN] = rows[:, CONTEXT : CONTEXT + SEEN]
    return out


def _keys(r: np.random.Generator, n: int) -> list[str]:
    """Made-up keys: random characters of an alphabet, some behind a short prefix or in groups."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = (upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", digits + "abcdef", digits + "ABCDEF", upper + "234567", lower + digits)
    out = []
    for i in range(n):
        key = "".join(r.choice(list(alphabets[i % len(alphabets)]), int(r.integers(18, 64))))
        if i % 5 == 1:
            key = "".join(r.choice(list(lower), int(r.integers(2, 5)))) + "_" + key
        elif i % 5 == 2:
            key = "-".join(key[k : k + 8] for k in range(0, len(key), 8))
        out.append(key)
    return out


def _plain(r: np.random.Generator, n: int) -> np.ndarray:
    """Windows of made-up harmless candidates: names of words and numbers, paths, addresses, dates, numbers."""
    words = ["section", "figure", "chapter", "release", "version", "building", "item", "number", "page", "paragraph", "Index", "Total", "value", "data", "main"]
    out = []
    for i in range(n):
        w, k = list(r.choice(words, int(r.integers(2, 5)))), int(r.integers(1, 3000))
        kind = i % 6
        text = ("-".join(w) + f"-{k}", "/" + "/".join(w) + ".html", "_".join(w), f"www.{w[0]}-{w[1]}.example.com/{k}", f"{k:04d}-{k % 12 + 1:02d}-{k % 28 + 1:02d}T10:00:{k % 60:02d}.000", "".join(r.choice(list("0123456789"), 16)))[kind]
        text = f"the {text.ljust(16, text[-1])} is here"
        out += [window(text, a, b) for c in candidates(text) for a, b in windows(*c)]
    return np.stack(out)


def unseen_recall(x: np.ndarray, y: np.ndarray, form: np.ndarray) -> float:
    """Of the secrets of a form (a mask), the share that a network finds which learnt from the others, with nothing before them to go by."""
    hidden = x[form & (y == 1)].copy()
    hidden[:, :CONTEXT] = 0
    net = learn(x[~form], y[~form])
    return float((net.probability(hidden) >= net.threshold).mean()) if len(hidden) else 1.0


def scan(documents: DataFrame, net: Net | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net."""
    shared = documents.sparkSession.sparkContext.broadcast(net or fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch, texts in _text.slices(batches):
            all_base, places, begin, rows = [], [], [], []
            for i, text in enumerate(texts.to_pylist()):
                found = base(text)
                all_base.append(found)
                for a, b in candidates(text):
                    if not any(s < b and a < e for s, _, e in found):
                        parts = windows(a, b)
                        places.append((i, a, b))
                        begin.append(len(rows))
                        rows += [window(text, x, y) for x, y in parts]
            added: list[list] = [[] for _ in all_base]
            if rows and net.threshold <= 1:
                for (i, a, b), p in zip(places, np.maximum.reduceat(net.probability(np.stack(rows)), begin).tolist()):
                    if p >= net.threshold:
                        added[i].append((a, 3, b))
            count = [[sum(k == kind for _, k, _ in f) for f in all_base] for kind in range(3)]
            yield _spark.record(
                batch,
                ("doc_id",),
                n_assign=pa.array(count[0], pa.int64()),
                n_access=pa.array(count[1], pa.int64()),
                n_hex=pa.array(count[2], pa.int64()),
                base_sha256=[hashlib.sha256(joined(f).encode()).hexdigest() for f in all_base],
                spans=[joined(sorted(f + more)) for f, more in zip(all_base, added)],
                n_net=pa.array([len(x) for x in added], pa.int64()),
            )

    return _spark.map_arrow(documents, run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long")
