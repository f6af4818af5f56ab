"""A character tagger: bidirectional LSTM with CRF transitions, in numpy.

Sizes are small enough to read every character of a large corpus on CPUs: the
gates are piecewise linear, states are laid out with windows side by side, and
the only transitions are into, within and out of a kind.

``train`` fits all weights by gradients through time of the CRF's likelihood.

``Model.decode`` reads a text in overlapping windows and mixes their scores
where they overlap, each the less the nearer its end. Over the mixed scores of
the whole text the one best path of tags is found: stretches are decoded side by
side, each with some text behind it, and the best paths to all tags there must
agree that its end is outside; if they don't, the stretch and the next are
decoded as one. So windows and stretches never change what is found.
"""

from __future__ import annotations

import bisect
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Characters in a window at most, and how many it shares with the next.
WINDOW, OVERLAP = 1024, 64
#: Windows that are read side by side.
BESIDE = 768
#: Characters of texts whose scores are held at once; those of a longer text are held alone.
HELD = 1 << 21
#: Characters behind a stretch in which paths are to meet.
BEHIND = 64
HIDDEN, EMBEDDED = 8, 8
_SIGNS = " \n\t@.,-+()_%:;/|\"'=#&*!?$<>[]"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: 0 is padding; then signs, letters, digit, capital, other letter, anything else.
_DIGIT = 1 + len(_SIGNS) + len(_LETTERS)
SYMBOLS = _DIGIT + 4
_table: np.ndarray | None = None
_F = np.float32
_NONE = _F(-1e4)
_MOST = _F(0.05)


def symbols(text: str) -> np.ndarray:
    """The numbers of a text's characters."""
    global _table
    if _table is None:
        _table = np.fromiter((_DIGIT + (2 if chr(c).isalpha() else 3) for c in range(0x110000)), np.uint8, 0x110000)
        for k, c in enumerate(_SIGNS + _LETTERS):
            _table[ord(c)] = k + 1
        for c in _LETTERS:
            _table[ord(c.upper())] = _DIGIT + 1
        for c in "0123456789":
            _table[ord(c)] = _DIGIT
    return _table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


@dataclass
class Model:
    kinds: tuple[str, ...]
    embedding: np.ndarray  # (EMBEDDED, SYMBOLS)
    cells: list[np.ndarray]  # of each direction (4 HIDDEN, HIDDEN + EMBEDDED + 1): gates in, forget, out, new
    out: np.ndarray  # (1 + kinds, 2 HIDDEN + 1)
    enter: np.ndarray  # transitions from outside into each kind
    stay: np.ndarray
    leave: np.ndarray
    outside: float

    def emissions(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(T, tags, B) scores of the tags of symbols ``at`` (T, B); windows longest last end at ``lengths``."""
        steps, beside = at.shape
        read = np.empty((steps, EMBEDDED, beside), _F)
        for k in range(EMBEDDED):
            np.take(self.embedding[k], at, out=read[:, k], mode="clip")
        scores = np.empty((steps, len(self.out), beside), _F)
        scores[:] = self.out[:, -1:]
        full = int(lengths.min()) if beside else 0
        for way, cell in enumerate(self.cells):
            of_state, of_read, bias = np.ascontiguousarray(cell[:, :HIDDEN]), np.ascontiguousarray(cell[:, HIDDEN:-1]), np.ascontiguousarray(cell[:, -1:])
            head = np.ascontiguousarray(self.out[:, way * HIDDEN : (way + 1) * HIDDEN])
            h, c = np.zeros((HIDDEN, beside), _F), np.zeros((HIDDEN, beside), _F)
            z, y, s = np.empty((4 * HIDDEN, beside), _F), np.empty((4 * HIDDEN, beside), _F), np.empty((len(self.out), beside), _F)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.matmul(of_read, read[t], out=z)
                np.matmul(of_state, h, out=y)
                z += y
                z += bias
                np.maximum(z, 0, out=z)
                np.minimum(z, 1, out=z)
                new = z[3 * HIDDEN :]
                new *= 2
                new -= 1
                new *= z[:HIDDEN]
                c *= z[HIDDEN : 2 * HIDDEN]
                c += new
                np.maximum(c, -1, out=h)
                np.minimum(h, 1, out=h)
                h *= z[2 * HIDDEN : 3 * HIDDEN]
                if t >= full:  # some windows have ended
                    inside = t < lengths
                    h *= inside
                    c *= inside
                np.matmul(head, h, out=s)
                scores[t] += s
        return scores

    def best(self, scores: np.ndarray, lengths: np.ndarray, cores: np.ndarray, before: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(T, B) the best tags by Viterbi's algorithm, and whether they are sure up to ``cores``, whatever follows.

        Columns end at ``lengths``, where the text has ``ended`` or goes on. Where there is text ``before``, a column
        begins behind a tag that is outside; its core is sure if it ends with its text, or if the best paths to all
        tags at the column's end are outside at the core's.
        """
        steps, tags, beside = scores.shape
        full = int(lengths.min())
        enter, stay, leave = self.enter[:, None], self.stay[:, None], self.leave[:, None]
        stays = np.empty((steps, tags - 1, beside), bool)  # whether a kind's best predecessor is the kind itself
        source = np.zeros((steps, beside), np.uint8)  # the best predecessor of the outside
        now = scores[0].copy()
        now[0] += np.where(before, self.outside, 0)
        now[1:] += np.where(before, enter, 0)
        for t in range(1, steps):
            within, into = now[1:] + stay, now[:1] + enter
            np.greater(within, into, out=stays[t])
            left = now[1:] + leave
            top, none = left.max(0), now[0] + self.outside
            some = np.flatnonzero(top > none)
            if len(some):
                source[t, some] = 1 + left[:, some].argmax(0)
            new = now if t < full else np.empty_like(now)  # some columns have ended
            np.maximum(top, none, out=new[0])
            np.maximum(within, into, out=new[1:])
            new += scores[t]
            now = now if t < full else np.where(t < lengths, new, now)
        # One path where the text has ended; else one to each tag, followed back to where all cores have ended.
        last = np.where(ended, now.argmax(0), np.arange(tags)[:, None]).astype(np.uint8)
        sure, out, everyone = cores == lengths, np.zeros((steps, beside), np.uint8), np.arange(beside)
        tag, low = last, int(cores.min())
        for t in range(steps - 1, -1, -1):
            if t < steps - 1:
                of, at = stays[t + 1], source[t + 1]
                if not tag.any():
                    tag = np.broadcast_to(at, tag.shape)
                else:
                    tag = np.where(tag == 0, at, np.where(of[np.maximum(tag, 1) - 1, everyone], tag, 0)).astype(np.uint8)
                if t >= full - 1:  # some columns end here
                    tag = np.where(lengths - 1 == t, last[: len(tag)], tag)
            if t >= low - 1:
                here = np.flatnonzero((cores - 1 == t) & ~sure)
                sure[here] = (tag[:, here] == 0).all(0)
                if t == low - 1:
                    tag = tag[:1]
            out[t] = tag[0]
        return out, sure

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text the spans (kind, start, end) of equal tags on its best path."""
        out: list[list[tuple[int, int, int]]] = []
        for some in _held(texts):
            numbers = [symbols(x) for x in some]
            out += map(self._spans, self._paths([len(x) for x in numbers], self._scores(numbers)))
        return out

    def _scores(self, numbers: list[np.ndarray]) -> np.ndarray:
        """(N, tags) mixed scores of the windows of all texts, one text behind the other."""
        firsts = np.concatenate(([0], np.cumsum([len(x) for x in numbers], dtype=int)))
        joined = np.concatenate(numbers) if numbers else np.zeros(0, np.uint8)
        cuts = []  # (length, start, whether a window of the text comes before, whether one comes behind)
        for first, x in zip(firsts.tolist(), numbers, strict=False):
            n = max(1, -(-(len(x) - OVERLAP) // (WINDOW - OVERLAP))) if len(x) else 0
            step = -(-(len(x) - OVERLAP) // n) if n > 1 else len(x)
            cuts += [(min(len(x) - j * step, step + OVERLAP) if n > 1 else len(x), first + j * step, j > 0, j + 1 < n) for j in range(n)]
        cuts.sort()
        out = np.zeros((len(joined), len(self.out)), _F)
        rise = ((np.arange(OVERLAP, dtype=_F) + _F(0.5)) / OVERLAP)[:, None]
        for a in range(0, len(cuts), BESIDE):
            some = cuts[a : a + BESIDE]
            at = np.zeros((some[-1][0], len(some)), np.uint8)
            for b, (n, start, _, _) in enumerate(some):
                at[:n, b] = joined[start : start + n]
            scores = self.emissions(at, np.array([c[0] for c in some])).transpose(2, 0, 1)
            for own, (n, start, before, behind) in zip(scores, some, strict=True):
                own = own[:n]
                if before:
                    own[:OVERLAP] *= rise
                if behind:
                    own[-OVERLAP:] *= rise[::-1]
                out[start : start + n] += own
        return out

    def _paths(self, lengths: list[int], scores: np.ndarray, stretch: int = WINDOW) -> Iterator[np.ndarray]:
        """Of each text the tags of the best path through its scores."""
        firsts = np.concatenate(([0], np.cumsum(lengths, dtype=int))).tolist()
        tags = np.zeros(len(scores), np.uint8)
        todo = []  # (length, start, whether text comes before, whether text comes behind)
        for first, n in zip(firsts, lengths, strict=False):
            todo += [(min(stretch, n - j), first + j, j > 0, j + stretch < n) for j in range(0, n, stretch)]
        borders = {start for _, start, _, _ in todo} | {firsts[-1]}
        while todo:
            todo.sort()
            unsure, b = [], 0
            while b < len(todo):
                # By length, so long ones have few beside them.
                a, b = b, b + 1
                while b < len(todo) and b - a < BESIDE and (b - a + 1) * todo[b][0] <= BESIDE * WINDOW:
                    b += 1
                some = todo[a:b]
                ends = [firsts[bisect.bisect_right(firsts, start)] for _, start, _, _ in some]
                sizes = [min(n + BEHIND, end - start) if behind else n for (n, start, _, behind), end in zip(some, ends, strict=True)]
                own = np.zeros((max(sizes), len(self.out), len(some)), _F)
                for k, (size, (_, start, _, _)) in enumerate(zip(sizes, some, strict=True)):
                    own[:size, :, k] = scores[start : start + size]
                cores, starts, before, _ = (np.array(x) for x in zip(*some, strict=True))
                found, sure = self.best(own, np.array(sizes), cores, before, starts + sizes == ends)
                for k, (n, start, _, _) in enumerate(some):
                    tags[start : start + n] = found[:n, k]
                unsure += [some[k] for k in np.flatnonzero(~sure)]
            todo = self._joined(unsure, firsts, borders)
        return (tags[a : a + n] for a, n in zip(firsts, lengths, strict=False))

    @staticmethod
    def _joined(unsure: list[tuple[int, int, bool, bool]], firsts: list[int], borders: set[int]) -> list[tuple[int, int, bool, bool]]:
        """Unsure stretches, each with at least as much again of what follows, up to where a stretch ends; those that meet become one."""
        out: list[tuple[int, int, bool, bool]] = []
        known = sorted(borders)
        for n, start, before, _ in sorted(unsure, key=lambda x: x[1]):
            if out and start < out[-1][1] + out[-1][0]:
                n, start, before, _ = out.pop()
            end = firsts[bisect.bisect_right(firsts, start)]
            to = min(end, known[bisect.bisect_left(known, min(end, start + 2 * n))])
            out.append((to - start, start, before, to < end))
        for n, start, _, _ in out:
            borders.difference_update(known[bisect.bisect_right(known, start) : bisect.bisect_left(known, start + n)])
        return out

    def saved(self) -> bytes:
        """All weights, for ``loaded``."""
        file = io.BytesIO()
        np.savez(file, kinds=np.array(self.kinds), embedding=self.embedding, cell0=self.cells[0], cell1=self.cells[1], out=self.out, enter=self.enter, stay=self.stay, leave=self.leave, outside=self.outside)
        return file.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return cls(tuple(x["kinds"].tolist()), x["embedding"], [x["cell0"], x["cell1"]], x["out"], x["enter"], x["stay"], x["leave"], float(x["outside"]))

    @staticmethod
    def _spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
        if not tags.any():
            return []
        edges = np.flatnonzero(np.diff(tags, prepend=np.uint8(0), append=np.uint8(0)))
        return [(int(tags[a]) - 1, int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False) if tags[a]]


def _held(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of bounded size."""
    some, size = [], 0
    for x in texts:
        if some and size + len(x) > HELD:
            yield some
            some, size = [], 0
        some.append(x)
        size += len(x)
    if some:
        yield some


def _grow(x: np.ndarray) -> np.ndarray:
    """Slope of a clipped line, with a leak so that no unit is lost for good."""
    return np.where((x > 0) & (x < 1), _F(1), _F(0.02))


def _cell_forward(cell: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, list]:
    steps, _, beside = read.shape
    h = c = np.zeros((HIDDEN, beside), _F)
    states, kept = np.empty((steps, HIDDEN, beside), _F), []
    for t in range(steps):
        x = np.concatenate([h, read[t], np.ones((1, beside), _F)])
        z = cell @ x
        g = np.clip(z, 0, 1)
        i, f, o, new = g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN : 3 * HIDDEN], 2 * g[3 * HIDDEN :] - 1
        before, c = c, f * c + i * new
        flat = np.clip(c, -1, 1)
        h = o * flat
        states[t] = h
        kept.append((x, z, i, f, o, new, before, c, flat))
    return states, kept


def _cell_backward(cell: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d_cell, d_read = np.zeros_like(cell), np.empty((len(kept), EMBEDDED, d_states.shape[2]), _F)
    dh = dc = np.zeros(d_states.shape[1:], _F)
    for t in range(len(kept) - 1, -1, -1):
        x, z, i, f, o, new, before, c, flat = kept[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * _grow((c + 1) / 2)
        d = np.concatenate([dc * new, dc * before, dh * flat, 2 * dc * i]) * _grow(z)
        d_cell += d @ x.T
        back = cell.T @ d
        # Clipped at each step: the leak would let gradients grow over long texts.
        dh, d_read[t], dc = np.clip(back[:HIDDEN], -_MOST, _MOST), back[HIDDEN:-1], np.clip(dc * f, -_MOST, _MOST)
    return d_cell, d_read


def _likelihood(model: Model, scores: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
    """Mean negative log likelihood of ``tags`` (T, B), and its gradients by scores and transitions."""
    steps, n, beside = scores.shape
    move = np.full((n, n), _NONE)
    move[0, 0] = model.outside
    move[0, 1:], move[1:, 0] = model.enter, model.leave
    move[np.arange(1, n), np.arange(1, n)] = model.stay

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = lse(ahead[t - 1][:, None] + move[:, :, None], 0) + scores[t]
    for t in range(steps - 2, -1, -1):
        behind[t] = lse(move[:, :, None] + (scores[t + 1] + behind[t + 1])[None], 1)
    total = lse(ahead[-1], 0)
    everyone = np.arange(beside)
    own = sum(scores[t, tags[t], everyone] for t in range(steps)) + sum(move[tags[t - 1], tags[t]] for t in range(1, steps))
    d_scores = np.exp(ahead + behind - total)
    d_move = np.zeros_like(move)
    for t in range(1, steps):
        d_move += np.exp(ahead[t - 1][:, None] + move[:, :, None] + (scores[t] + behind[t])[None] - total).sum(2)
        np.add.at(d_move, (tags[t - 1], tags[t]), -1)
    for t in range(steps):
        d_scores[t, tags[t], everyone] -= 1
    d_move /= beside
    return float((total - own).mean()), (d_scores / beside).astype(_F), {"enter": d_move[0, 1:], "leave": d_move[1:, 0], "stay": d_move[np.arange(1, n), np.arange(1, n)], "outside": d_move[0, 0]}


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], kinds: tuple[str, ...], seed: int = 7, batch: int = 48, rounds: int = 3, rate: float = 0.02) -> Model:
    """A model of labelled texts (text, spans as kind, start, end), by Adam over batches of texts of like length."""
    rng = np.random.default_rng(seed)
    width = HIDDEN + EMBEDDED + 1

    def cell() -> np.ndarray:
        w = rng.normal(0, 0.35 / np.sqrt(width), (4 * HIDDEN, width)).astype(_F)
        w[:, -1] = np.repeat([0.5, 0.8, 0.5, 0.5], HIDDEN)
        return w

    model = Model(kinds, rng.normal(0, 1, (EMBEDDED, SYMBOLS)).astype(_F), [cell(), cell()], rng.normal(0, 0.3, (1 + len(kinds), 2 * HIDDEN + 1)).astype(_F), np.full(len(kinds), -2, _F), np.full(len(kinds), 1, _F), np.full(len(kinds), -1, _F), 1.0)
    rows = []
    for text, spans in labelled:
        tags = np.zeros(len(text), np.uint8)
        for kind, a, b in spans:
            tags[a:b] = 1 + kinds.index(kind)
        rows.append((symbols(text), tags))
    rows.sort(key=lambda r: len(r[0]))
    batches = [rows[k : k + batch] for k in range(0, len(rows), batch)]
    names = ("embedding", "out", "enter", "stay", "leave", "outside")
    moments: dict[str, list] = {}
    count, total = 0, rounds * len(batches)
    for _ in range(rounds):
        for b in rng.permutation(len(batches)):
            some = [r for r in batches[b] if len(r[0])]
            steps = min((len(r[0]) for r in some), default=0)
            if not steps:
                continue
            # Texts of a batch are cut to the shortest one's length, each at a place of its own.
            at, tags = np.empty((steps, len(some)), np.int64), np.empty((steps, len(some)), np.int64)
            for k, (x, y) in enumerate(some):
                start = int(rng.integers(0, len(x) - steps + 1))
                at[:, k], tags[:, k] = x[start : start + steps], y[start : start + steps]
            read = np.ascontiguousarray(model.embedding[:, at].transpose(1, 0, 2))
            ahead, kept = _cell_forward(model.cells[0], read)
            behind, kept_back = _cell_forward(model.cells[1], read[::-1])
            states = np.concatenate([ahead, behind[::-1], np.ones((steps, 1, len(some)), _F)], 1)
            scores = np.matmul(model.out, states)
            _, d_scores, gradient = _likelihood(model, scores, tags)
            gradient["out"] = np.matmul(d_scores, states.transpose(0, 2, 1)).sum(0)
            d_states = np.matmul(model.out.T, d_scores)
            d0, r0 = _cell_backward(model.cells[0], kept, d_states[:, :HIDDEN])
            d1, r1 = _cell_backward(model.cells[1], kept_back, d_states[::-1, HIDDEN:-1])
            d_embedding = np.zeros_like(model.embedding)
            np.add.at(d_embedding.T, at.ravel(), (r0 + r1[::-1]).transpose(0, 2, 1).reshape(-1, EMBEDDED))
            gradient |= {"embedding": d_embedding, "cell0": d0, "cell1": d1}
            norm = np.sqrt(sum(float((g * g).sum()) for g in map(np.asarray, gradient.values())))
            count += 1
            step = rate * min(1, count / 20) * (1 - 0.95 * count / total)
            for name, g in gradient.items():
                g = np.asarray(g, _F) * _F(min(1, 5 / max(norm, 1e-9)))
                m = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
                move = step * (m[0] / (1 - 0.9**count)) / (np.sqrt(m[1] / (1 - 0.99**count)) + 1e-8)
                if name.startswith("cell"):
                    model.cells[int(name[-1])] -= move
                elif name in names:
                    new = getattr(model, name) - move
                    setattr(model, name, float(new) if name == "outside" else new.astype(_F))
    return model
