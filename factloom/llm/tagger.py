"""A character-level bidirectional LSTM with a CRF on top, trained with numpy.

Characters are looked up in a table of input projections, so only the recurrent products are computed per character; in
training both directions run in one batched product. Training minimises the CRF's negative log likelihood with Adam.
Texts are read by onnxruntime where it is installed, a beginning or an end that several share once; decoding is
Viterbi's algorithm over whole batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Characters with a row of their own; the others share rows by kind.
_OWN = "\n" + "".join(map(chr, range(32, 127))) + "äöüßéíóáúñøåëºª–—¿"
_AT = {c: k + 5 for k, c in enumerate(_OWN)}
PAD, UPPER, LOWER, DIGIT, OTHER = range(5)
SYMBOLS = len(_OWN) + 5
#: Texts read in one go, and those of them searched for the best tags in one go.
TOGETHER, SEARCHED = 4096, 256


def encode(text: str) -> list[int]:
    """Rows of the characters of a text."""
    return [_AT.get(c) or (UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else OTHER) for c in text]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _numpy_step(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States, cells and tag scores after one character more: ``ids`` are the characters, ``from`` says which of the
    states ``s`` and cells ``c`` each follows."""
    h = x["recur"].shape[0]
    z = x["s"][x["from"]] @ x["recur"]
    z += x["table"][x["ids"]]
    gates = _sigmoid(z[:, : 3 * h])
    c = gates[:, h : 2 * h] * x["c"][x["from"]] + gates[:, :h] * np.tanh(z[:, 3 * h :])
    s = gates[:, 2 * h :] * np.tanh(c)
    return s, c, s @ x["out"] + x["bias"]


def _field(number: int, value: int | str | bytes) -> bytes:
    """A field of a protobuf message."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _step_model() -> bytes:
    """``_numpy_step`` as an ONNX model; numbers of fields as in onnx.proto."""

    def node(op: str, takes: str, gives: str, **attributes: int) -> bytes:
        own = (_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in attributes.items())
        return _field(1, b"".join([*(_field(1, x) for x in takes.split()), *(_field(2, x) for x in gives.split()), _field(4, op), *own]))

    def value(number: int, name: str, kind: int, *dims: str) -> bytes:
        shape = b"".join(_field(1, _field(2, d)) for d in dims)
        return _field(number, _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape))))

    real, whole = 1, 6  # float, int32
    graph = [
        node("Gather", "table ids", "x"), node("Gather", "s from", "s0"), node("Gather", "c from", "c0"),
        node("Gemm", "s0 recur x", "z"), node("Split", "z", "zi zf zo zg", axis=1, num_outputs=4),
        node("Sigmoid", "zi", "i"), node("Sigmoid", "zf", "f"), node("Sigmoid", "zo", "o"), node("Tanh", "zg", "g"),
        node("Mul", "i g", "ig"), node("Mul", "f c0", "fc"), node("Add", "ig fc", "c1"),
        node("Tanh", "c1", "tc"), node("Mul", "o tc", "s1"), node("Gemm", "s1 out bias", "e"), _field(2, "step"),
        value(11, "table", real, "symbols", "h4"), value(11, "recur", real, "h", "h4"), value(11, "out", real, "h", "tags"), value(11, "bias", real, "tags"),
        value(11, "s", real, "before", "h"), value(11, "c", real, "before", "h"), value(11, "ids", whole, "rows"), value(11, "from", whole, "rows"),
        value(12, "s1", real, "rows", "h"), value(12, "c1", real, "rows", "h"), value(12, "e", real, "rows", "tags"),
    ]
    return _field(1, 8) + _field(7, b"".join(graph)) + _field(8, _field(1, "") + _field(2, 18))


@cache
def _step() -> Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_numpy_step``, by onnxruntime where it is installed, which is quicker with sigmoids and hyperbolic tangents."""
    try:
        import onnxruntime
    except ImportError:
        return _numpy_step
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    session = onnxruntime.InferenceSession(_step_model(), options, providers=["CPUExecutionProvider"])
    return lambda x: session.run(None, x)


@dataclass
class Tagger:
    """Parameters: input table, recurrent weights of both directions, output layer, CRF transitions."""

    table: np.ndarray  # 2, symbols, 4h
    recur: np.ndarray  # 2, h, 4h
    out: np.ndarray  # 2h, tags
    bias: np.ndarray  # tags
    trans: np.ndarray  # tags + 1 (start), tags

    @classmethod
    def fresh(cls, hidden: int, tags: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        table = r.normal(0, 0.3, (2, SYMBOLS, 4 * hidden)).astype(np.float32)
        table[:, :, hidden : 2 * hidden] += 1.0  # forget gates start open
        return cls(table, r.normal(0, 0.6 / np.sqrt(hidden), (2, hidden, 4 * hidden)).astype(np.float32), r.normal(0, 0.3, (2 * hidden, tags)).astype(np.float32), np.zeros(tags, np.float32), np.zeros((tags + 1, tags), np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.out, self.bias, self.trans]

    def _forward(self, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Outputs (T, 2, B, h) in text order for each direction, from ids (B, T); a row's padding stands at its end."""
        b, t = ids.shape
        h = self.recur.shape[1]
        # padding comes last forwards and first backwards; its gates are shut below
        both = np.stack([ids.T, ids.T[::-1]], 1)  # T, 2, B
        live = (both != PAD).astype(np.float32)[..., None]
        s, c = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        states, saved = np.empty((t, 2, b, h), np.float32), []
        for k in range(t):
            z = np.matmul(s, self.recur)
            z[0] += self.table[0][both[k, 0]]
            z[1] += self.table[1][both[k, 1]]
            gates = _sigmoid(z[..., : 3 * h])
            g = np.tanh(z[..., 3 * h :])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            old_s, old_c = s, c
            c = (f * c + i * g) * live[k]
            th = np.tanh(c)
            s = o * th
            states[k] = s
            if keep:
                saved.append((old_s, old_c, gates, g, th))
        return states, [both, live, saved]

    @staticmethod
    def _join(states: np.ndarray) -> np.ndarray:
        """(T, B, 2h) from both directions in text order."""
        return np.concatenate([states[:, 0], states[::-1, 1]], 2)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores (T, B, tags) of padded rows, 0 at padding."""
        live = ids != PAD
        e = np.zeros((*ids.shape, len(self.bias)), np.float32)
        e[live] = self._flat_scores(ids)
        return e.transpose(1, 0, 2)

    def _flat_scores(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores of the characters of all rows, row by row without padding.

        A state depends on what was read up to it alone, so texts with the same beginning share the states of one
        direction up to where they differ, and those with the same end share the other's.
        """
        ids = ids.astype(np.uint8)
        live = ids != PAD
        turned = np.zeros_like(ids)
        turned[live] = ids[:, ::-1][live[:, ::-1]]
        first, at = self._walk(0, ids)
        e = np.take(first, at[live], 0, mode="clip")
        last, at = self._walk(1, turned)
        e += np.take(last, at[:, ::-1][live[:, ::-1]], 0, mode="clip")
        return e

    def _walk(self, way: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag scores that one direction gives, for each different beginning of the rows, and which beginning ends at each
        character."""
        b, t = ids.shape
        h = self.recur.shape[1]
        order = np.argsort(ids.view(f"S{t}")[:, 0])
        rows = np.ascontiguousarray(ids[order].T)
        # a character ends a new beginning where its row differs from the row before up to there
        differ = rows[:, 1:] != rows[:, :-1]
        for k in range(1, t):
            differ[k] |= differ[k - 1]
        new = rows != PAD
        new[:, 1:] &= differ
        at = np.cumsum(new, 1, dtype=np.int32) - 1
        base = np.r_[0, np.cumsum(new.sum(1))]
        # the bias is added once, forwards
        weights = {"table": self.table[way], "recur": self.recur[way], "out": self.out[way * h : way * h + h], "bias": self.bias * (way == 0)}
        step = _step()
        e = np.empty((base[-1], len(self.bias)), np.float32)
        kinds = rows.astype(np.int32)
        s, c, before = np.zeros((1, h), np.float32), np.zeros((1, h), np.float32), np.zeros(b, np.int32)
        for k in range(t):
            own = np.flatnonzero(new[k])
            s, c, e[base[k] : base[k + 1]] = step(weights | {"s": s, "c": c, "ids": kinds[k, own], "from": before[own]})
            before = at[k]
        nodes = np.empty((b, t), np.int32)
        nodes[order] = (at + base[:-1, None].astype(np.int32)).T
        return e, nodes

    def tags(self, texts: list[str]) -> list[list[int] | None]:
        """Best tags of each text, none of which is empty; None where no tag is set.

        Where tag 0 leads everywhere by more than transitions can give to other tags, it needs no search: a run of ``n``
        other tags gains at most the ways in and out and ``n - 1`` steps within over staying at 0.
        """
        out: list[list[int] | None] = []
        for k in range(0, len(texts), TOGETHER):
            out += self._tags(texts[k : k + TOGETHER])
        return out

    def _tags(self, texts: list[str]) -> list[list[int] | None]:
        ids = encoded(texts)
        sizes = (ids != PAD).sum(1)
        e = self._flat_scores(ids)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        stay, trans = self.trans[0, 0], self.trans[:-1]
        into = max(float((trans[0, 1:] - stay).max()), float((self.trans[-1, 1:] - self.trans[-1, 0]).max()))
        bound = max(into, into + float((trans[1:, 0] - stay).max()), float((trans[1:, 1:] - stay).max()), 0.0) + 1e-3
        by_tag = np.ascontiguousarray(e.T)
        lead = np.minimum.reduceat(by_tag[0] - by_tag[1:].max(0), starts)
        rows = np.flatnonzero(lead <= bound)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        out: list[list[int] | None] = [None] * len(texts)
        for k in range(0, len(rows), SEARCHED):
            own = rows[k : k + SEARCHED]
            t = sizes[own[-1]]
            inside = np.arange(t) < sizes[own, None]
            scores = np.zeros((*inside.shape, e.shape[1]), np.float32)
            scores[inside] = e[(starts[own, None] + np.arange(t))[inside]]
            for j, row in zip(own.tolist(), self._best(ids[own, :t], scores.transpose(1, 0, 2))):
                if row[: sizes[j]].any():
                    out[j] = row[: sizes[j]].tolist()
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tags (B, T) of padded rows."""
        return self._best(ids, self.scores(ids))

    def _best(self, ids: np.ndarray, e: np.ndarray) -> np.ndarray:
        t, b, n = e.shape
        last = (ids != PAD).sum(1) - 1
        e = np.ascontiguousarray(e.transpose(0, 2, 1))
        trans, ways = np.ascontiguousarray(self.trans[:-1, :, None]), np.empty((n, n, b), np.float32)
        best = np.empty((t, n, b), np.float32)
        best[0] = e[0] + self.trans[-1][:, None]
        for k in range(1, t):
            np.add(best[k - 1][:, None], trans, out=ways)
            np.maximum.reduce(ways, 0, out=best[k])
            best[k] += e[k]
        tags = np.zeros((b, t), np.int8)
        at = best[-1].argmax(0)
        for k in range(t - 1, -1, -1):
            if k < t - 1:
                at = np.where(last > k, (best[k] + self.trans[:-1, at]).argmax(0), best[k].argmax(0))
            tags[:, k] = at
        return tags

    def _loss(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood and the parameters' gradients; gold is (B, T)."""
        states, (both, live2, saved) = self._forward(ids, True)
        x = self._join(states)
        e = x @ self.out + self.bias
        t, b, n = e.shape
        live = (ids.T != PAD)[:, :, None]
        tr = self.trans[:-1]
        fwd = np.empty_like(e)
        fwd[0] = e[0] + self.trans[-1]
        for k in range(1, t):
            m = fwd[k - 1].max(1, keepdims=True)
            new = np.log(np.exp(fwd[k - 1] - m) @ np.exp(tr) + 1e-30) + m + e[k]
            fwd[k] = np.where(live[k], new, fwd[k - 1])
        m = fwd[-1].max(1, keepdims=True)
        z = (np.log(np.exp(fwd[-1] - m).sum(1, keepdims=True)) + m)[:, 0]
        bwd = np.zeros_like(e)
        gt = np.zeros_like(self.trans)
        for k in range(t - 2, -1, -1):
            y = bwd[k + 1] + e[k + 1]
            my = y.max(1, keepdims=True)
            ey = np.exp(y - my)
            new = np.log(ey @ np.exp(tr).T + 1e-30) + my
            bwd[k] = np.where(live[k + 1], new, bwd[k + 1])
            ma = fwd[k].max(1, keepdims=True)
            scale = np.exp(ma[:, 0] + my[:, 0] - z) * live[k + 1][:, 0]
            gt[:-1] += np.exp(tr) * ((np.exp(fwd[k] - ma) * scale[:, None]).T @ ey)
        p = np.exp(fwd + bwd - z[None, :, None]) * live
        gt[-1] += p[0].sum(0)
        g = gold.T
        one = np.zeros_like(e)
        np.put_along_axis(one, g[:, :, None].astype(np.int64), 1, 2)
        one *= live
        gold_score = (one * e).sum() + self.trans[-1][g[0]].sum() + (tr[g[:-1], g[1:]] * live[1:, :, 0]).sum()
        np.add.at(gt[-1], g[0], -1.0)
        np.subtract.at(gt, (g[:-1][live[1:, :, 0]], g[1:][live[1:, :, 0]]), 1.0)
        de = (p - one).astype(np.float32)
        g_out = np.einsum("tbh,tbn->hn", x, de, optimize=True)
        g_bias = de.sum((0, 1))
        dx = de @ self.out.T
        h = self.recur.shape[1]
        ds_in = np.stack([dx[:, :, :h], dx[::-1, :, h:]], 1)
        g_table, g_recur = np.zeros_like(self.table), np.zeros_like(self.recur)
        ds, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        dz_all = np.empty((t, 2, b, 4 * h), np.float32)
        back = self.recur.transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            old_s, old_c, gates, gg, th = saved[k]
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            ds = ds + ds_in[k]
            dc = (dc + ds * o * (1 - th * th)) * live2[k]
            dz = dz_all[k]
            dz[..., :h] = dc * gg * i * (1 - i)
            dz[..., h : 2 * h] = dc * old_c * f * (1 - f)
            dz[..., 2 * h : 3 * h] = ds * th * o * (1 - o)
            dz[..., 3 * h :] = dc * i * (1 - gg * gg)
            dc = dc * f
            ds = np.matmul(dz, back)
            g_recur += np.matmul(old_s.transpose(0, 2, 1), dz)
        for d in range(2):
            flat, rows = both[:, d].ravel(), dz_all[:, d].reshape(-1, 4 * h)
            order = np.argsort(flat, kind="stable")
            ids_sorted = flat[order]
            first = np.flatnonzero(np.r_[True, ids_sorted[1:] != ids_sorted[:-1]])
            g_table[d][ids_sorted[first]] = np.add.reduceat(rows[order], first, 0)
        g_table[:, PAD] = 0
        scale = np.float32(1.0 / b)
        return float((z.sum() - gold_score) / b), [x * scale for x in (g_table, g_recur, g_out, g_bias, gt)]

    def train(self, texts: list[str], tags: list[list[int]], rounds: int, batch: int = 96, rate: float = 0.012, seed: int = 7) -> list[float]:
        """Adam over batches of texts of like length; mean loss of each round."""
        r = np.random.default_rng(seed)
        params = self.params()
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = np.argsort([len(t) for t in texts], kind="stable")
        batches = [order[k : k + batch] for k in range(0, len(order), batch)]
        losses, step = [], 0
        for round_ in range(rounds):
            total = 0.0
            for k in r.permutation(len(batches)):
                own = batches[k]
                ids, gold = pad([encode(texts[j]) for j in own]), pad([tags[j] for j in own])
                loss, grads = self._loss(ids, gold)
                total += loss * len(own)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                clip = min(1.0, 5.0 / (norm + 1e-9))
                lr = rate * (1 - 0.9 * round_ / max(1, rounds - 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, a, b in zip(params, grads, m1, m2):
                    g = g * clip
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= (lr * a / (np.sqrt(b) + 1e-8)).astype(p.dtype)
            losses.append(total / max(1, len(texts)))
        return losses


def pad(rows: list[list[int]]) -> np.ndarray:
    """Rows of numbers as one array, filled up with 0."""
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


_FEW = 0x530
_ROWS = np.array([0, *encode("".join(map(chr, range(1, _FEW))))], np.uint8)
_ROWS[0] = OTHER


def encoded(texts: list[str]) -> np.ndarray:
    """``pad`` of the texts' ``encode``, character by character only for rare ones."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = _ROWS[np.minimum(points, _FEW - 1)]
    rare = np.flatnonzero(points >= _FEW)
    if len(rare):
        kinds, at = np.unique(points[rare], return_inverse=True)
        rows[rare] = np.array(encode("".join(map(chr, kinds.tolist()))), np.uint8)[at]
    sizes = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), int(sizes.max())), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = rows
    return out
