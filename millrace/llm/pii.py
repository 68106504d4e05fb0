"""Operator 10: personal data, by fixed patterns and a character-level bidirectional LSTM with a CRF.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers in whole texts, in one
linear pass each. The network labels characters with B-/I- tags of the same four kinds. It is trained here, in
numpy, on labelled spans in generated sentences (see ``make_examples``; the seed and sizes are parameters), and adds spans
the patterns leave out, such as phone numbers without a country code.

Texts are cut into windows that overlap by half, so two windows cover a character; its emissions are their mean, weighted
by the distance to the window's ends. One Viterbi search over the whole text then picks the tags, so a window's border
neither cuts a span nor breaks a transition. In that search a span holds only characters that the four kinds are written
with, and no space beside a letter (or the text's end); all other characters are outside. They cut the text into pieces
whose best paths do not depend on each other, and a piece without a digit or '@' can hold no span. So only pieces
with one are searched, and only windows that cover some of their characters are run: the result is that of the search over
the whole text with all windows, which ``tag_whole`` states and the tests compare.

Added spans that touch a pattern's span, or have too few digits for their kind, are dropped.
Null and empty texts have no spans. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, text_buffers, tidy

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
SLICE_BYTES = 1 << 20
TAGS = 1 + 2 * len(KINDS)
CLASSES = 100  # 0: padding, 1: space, 2: line end, 3: other letters, 4: other, 5..99: ASCII 0x20 on
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 14, "phone": 9}

# ------------------------------------------------------------------ patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9][0-9.]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str):
    """Matches of the address pattern, found from each '@' outwards."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def addresses(text: str):
    """Four dot-separated numbers, by whole runs of digits and dots."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts = run[0].split(".")
        starts, at = [], run.start()
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(four):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield starts[i], starts[i + 3] + len(four[3])
                i += 4
            else:
                i += 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT(text):
        out += [(s, 1, e) for s, e in addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    out.sort()
    return out


_DIGIT = re.compile("[0-9]").search

# ------------------------------------------------------------------ characters


def _class_table() -> np.ndarray:
    out = np.full(0x10000, 4, np.uint8)
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        if chr(cp).isalpha():
            out[cp] = 3
    out[0x20:0x7F] = 5 + np.arange(0x5F)
    out[[0x09, 0x20, 0x0B, 0x0C]] = 1
    out[[0x0A, 0x0D]] = 2
    return out


_CLASS: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _CLASS:
        _CLASS.append(_class_table())
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CLASS[0][np.minimum(cp, 0xFFFF)]


def _holds(chars: str) -> np.ndarray:
    out = np.zeros(CLASSES, bool)
    out[[5 + ord(c) - 0x20 for c in chars]] = True
    return out


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LETTER = _holds(_LETTERS)
_TRIGGERS = _holds("0123456789@")
_WRITTEN = _holds(_LETTERS + "0123456789@._%+-()")
_SPACE = 1


def inside(x: np.ndarray) -> np.ndarray:
    """Which characters (as classes) a span of the network may hold."""
    letter = np.r_[True, _LETTER[x], True]  # the text's ends count as letters
    return _WRITTEN[x] | (x == _SPACE) & ~letter[:-2] & ~letter[2:]

# ------------------------------------------------------------------ network


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, one LSTM each way, linear emissions, CRF transitions; float32."""

    def __init__(self, hidden: int = 20, embed: int = 10, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"emb": g(CLASSES, embed) * 3, "out": g(2 * hidden, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": g(embed, 4 * hidden), f"u{d}": g(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1
        #: An I- tag follows the B- or I- tag of its kind only.
        self.ban = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            self.ban[:, 2 + 2 * k] = -1e4
            self.ban[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.start_ban = self.ban[0]

    def _run(self, x: np.ndarray, d: str, keep: bool):
        n, t = x.shape
        h_size = self.h
        gates = self.p["emb"] @ self.p[f"w{d}"] + self.p[f"c{d}"]  # inputs take one of CLASSES values
        u = self.p[f"u{d}"]
        h = np.zeros((n, h_size), np.float32)
        c = np.zeros((n, h_size), np.float32)
        out = np.empty((t, n, h_size), np.float32)
        tape = []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = gates[x[:, s]] + h @ u
            ifo = _sigmoid(z[:, : 3 * h_size])
            g = np.tanh(z[:, 3 * h_size :])
            i, f, o = ifo[:, :h_size], ifo[:, h_size : 2 * h_size], ifo[:, 2 * h_size :]
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep:
                tape.append((s, i, f, o, g, before, tc, h))
            h = o * tc
            out[s] = h
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        hf, tf = self._run(x, "f", keep)
        hb, tb = self._run(x, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["out"] + self.p["out_b"], both, tf, tb  # (time, n, TAGS)

    def decode(self, e: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tags of every row of ``e`` that lies in a piece e[s : s + n]; a piece follows and precedes the outside tag."""
        out = np.zeros(len(e), np.int8)
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        if not len(lens):
            return out
        live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), "right")  # pieces of more than t characters
        move = (self.p["trans"] + self.ban).astype(np.float64)
        score = e[starts] + move[0]
        back = [None]
        for t in range(1, lens[0]):
            a = live[t]
            every = score[:a, :, None] + move
            back.append(every.argmax(1).astype(np.int8))
            score[:a] = every.max(1) + e[starts[:a] + t]
        now = (score + move[:, 0]).argmax(1).astype(np.int8)
        for t in range(lens[0] - 1, 0, -1):
            a = live[t]
            out[starts[:a] + t] = now[:a]
            now[:a] = back[t][np.arange(a), now[:a]]
        out[starts] = now
        return out

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        e = self.emissions(x)[0]
        t, n, _ = e.shape
        move = self.p["trans"] + self.ban
        score = e[0] + self.start_ban
        back = np.empty((t, n, TAGS), np.int8)
        for s in range(1, t):
            every = score[:, :, None] + move
            back[s] = every.argmax(1)
            score = every.max(1) + e[s]
        tags = np.empty((n, t), np.int8)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[s][rows, tags[:, s]]
        return tags

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray):
        e, both, tf, tb = self.emissions(x, True)
        t, n, _ = e.shape
        move = (self.p["trans"] + self.ban).astype(np.float64)
        e64 = e.astype(np.float64)

        top = e64.max(2, keepdims=True)
        step, gain = np.exp(move), np.exp(e64 - top)  # forward and backward sums, scaled to 1 at each character
        alpha, beta, scale = np.empty((t, n, TAGS)), np.ones((t, n, TAGS)), np.empty((t, n, 1))
        for s in range(t):
            alpha[s] = (alpha[s - 1] @ step if s else np.exp(self.start_ban)) * gain[s]
            scale[s] = alpha[s].sum(1, keepdims=True)
            alpha[s] /= scale[s]
        for s in range(t - 2, -1, -1):
            beta[s] = (gain[s + 1] * beta[s + 1]) @ step.T / scale[s + 1]
        z = (np.log(scale) + top).sum((0, 2))
        marginal = alpha * beta
        d_trans = np.einsum("sna,snb->ab", alpha[:-1], gain[1:] * beta[1:] / scale[1:], optimize=True) * step
        np.add.at(d_trans, (y[:, :-1], y[:, 1:]), -1)
        rows = np.arange(n)
        gold = self.start_ban[y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(1) + e64[np.arange(t), rows[:, None], y].sum(1)
        d_e = marginal
        for s in range(t):
            d_e[s][rows, y[:, s]] -= 1
        d_e = (d_e / n).astype(np.float32)
        h = self.h
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["trans"] = (d_trans / n).astype(np.float32)
        flat = d_e.reshape(-1, TAGS)
        grads["out"] = both.reshape(-1, 2 * h).T @ flat
        grads["out_b"] = flat.sum(0)
        d_both = d_e @ self.p["out"].T
        for d, tape, part in (("f", tf, d_both[:, :, :h]), ("b", tb, d_both[:, :, h:])):
            dzs = []
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            u = self.p[f"u{d}"]
            for s, i, f, o, g, before, tc, h_before in reversed(tape):
                dh = dh + part[s]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dzs.append((s, dz))
                grads[f"u{d}"] += h_before.T @ dz
                dh, dc = dz @ u.T, dc * f
            seen = np.concatenate([x[:, s] for s, _ in dzs])
            order = np.argsort(seen, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(seen[order]) != 0])
            d_gates = np.zeros((CLASSES, 4 * h), np.float32)
            d_gates[seen[order][edge]] = np.add.reduceat(np.concatenate([dz for _, dz in dzs])[order], edge)
            grads[f"c{d}"] = d_gates.sum(0)
            grads[f"w{d}"] = self.p["emb"].T @ d_gates
            grads["emb"] += d_gates @ self.p[f"w{d}"].T
        return float((z - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 96, rate: float = 0.02, seed: int = 12) -> list[float]:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            loss, grads = self.loss_and_grads(x[at], y[at])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


# ------------------------------------------------------------------ labelled spans


def _with_check_digit(digits: list[int]) -> str:
    for last in range(10):
        text = "".join(map(str, [*digits, last]))
        if luhn(text):
            return text
    raise AssertionError


def make_examples(n: int, seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, classes, tags) of n windows of generated prose with labelled spans and look-alikes."""
    rng = random.Random(seed)
    syllables = "an the er on in ti re ou es at nd st or en ha ed sh de la que ment ción é ü ß aux ich ung ei do os ra ll ñ a wh ly".split()
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = rng.choice

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randrange(1, 5)))

    def number(k: int) -> str:
        return "".join(rng.choices("0123456789", k=k))

    def span():
        kind = rng.randrange(4)
        if kind == 0:
            name = "".join(pick(letters) for _ in range(rng.randrange(2, 10))) + pick(["", ".", "_", "-"]) + pick(["", number(2), "".join(filter(str.isascii, word())) if rng.random() < 0.2 else "x"])
            if rng.random() < 0.15:  # long local parts, of up to two thirds of a window
                name = ".".join([name, *("".join(pick(letters) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 9)))])[: 2 * WINDOW // 3]
            host = pick(["mail", "post", "web", "corp"]) + pick(["", number(1)])
            return kind, f"{name.rstrip('.')}@{host}" + ("" if rng.random() < 0.15 else "." + pick(["example.com", "org", "net", "co.uk", "de"]))
        if kind == 1:
            return kind, ".".join(str(rng.randrange(1, 256)) for _ in range(4))
        if kind == 2:
            card = _with_check_digit([4, *(rng.randrange(10) for _ in range(14))])
            sep = pick(["", "", " ", "-"])
            return kind, sep.join(card[i : i + 4] for i in range(0, 16, 4))
        a, b, c = number(3), number(3), number(4)
        return kind, pick([f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"+1-{a}-{b}-{c}"])

    def decoy():
        return pick([number(rng.randrange(1, 7)), f"{number(4)}-{number(2)}-{number(2)}", f"v{number(1)}.{number(1)}.{number(2)}", f"{number(3)},{number(3)}", f"token={''.join(pick('0123456789abcdef') for _ in range(20))}", f'key = "{"".join(pick("0123456789abcdef") for _ in range(30))}"', "@" + word(), f"{number(2)}:{number(2)}", f"#{number(5)}", f"{number(25)}", f"({number(4)})", f"{number(2)}%"])

    texts, xs, ys = [], [], []
    while len(texts) < n:
        parts, tags = [], []

        def put(text, kind=None):
            parts.append(text)
            tags.extend([0] * len(text) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(text) - 1))

        while len(tags) < WINDOW + 40:
            u = rng.random()
            if u < 0.16:
                kind, s = span()
                put(s, kind)
            elif u < 0.30:
                put(decoy())
            else:
                w = word()
                put(w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.03 else w)
            put(pick([" "] * 12 + [", ", ". ", "\n", " | ", "!! ", "*** "]))
        text = "".join(parts)
        at = rng.randrange(len(text) - WINDOW + 1)
        tag = np.array(tags[at : at + WINDOW], np.int8)
        if tag[0] and tag[0] % 2 == 0:  # the window starts inside a span: its first part counts as a beginning
            tag[0] -= 1
        texts.append(text[at : at + WINDOW])
        xs.append(classes(texts[-1]))
        ys.append(tag)
    return texts, np.array(xs), np.array(ys)


_TRAINED: dict[tuple, Tagger] = {}


def trained(examples: int = 3000, steps: int = 260, seed: int = 21) -> Tagger:
    """The tagger, trained once in a process."""
    key = (examples, steps, seed)
    if key not in _TRAINED:
        _, x, y = make_examples(examples, seed)
        tagger = Tagger()
        tagger.fit(x, y, steps)
        _TRAINED[key] = tagger
    return _TRAINED[key]


# ------------------------------------------------------------------ windows over texts


#: Weights of a window's characters; those of the two windows over a character add up to 1.
_WEIGHT = (np.minimum(np.arange(WINDOW) + 0.5, WINDOW - np.arange(WINDOW) - 0.5) / STRIDE).astype(np.float32)


def _blend(tagger: Tagger, texts: list[np.ndarray], wanted: list[np.ndarray], chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(emissions of the wanted characters of all texts, first row of each text); runs the windows that cover any of them."""
    first = np.concatenate([[0], np.cumsum([w.sum() for w in wanted])]).astype(np.int64)
    e = np.zeros((int(first[-1]) + 1, TAGS), np.float32)  # the last row takes what is not wanted
    for parity in (0, 1):  # windows of one parity do not overlap
        xs, rows, held = [], [], 0

        def flush():
            x, at = np.concatenate(xs), np.concatenate(rows)
            e[at] += tagger.emissions(x)[0].transpose(1, 0, 2) * _WEIGHT[None, :, None]
            xs.clear()
            rows.clear()

        for i, (x, w) in enumerate(zip(texts, wanted, strict=True)):
            marks = np.concatenate([[0], np.cumsum(w)])
            starts = np.arange(-STRIDE * (1 - parity), len(x), WINDOW)
            lo, hi = np.clip(starts, 0, len(x)), np.clip(starts + WINDOW, 0, len(x))
            starts = starts[marks[hi] > marks[lo]]
            if not len(starts):
                continue
            pad = np.zeros(WINDOW, np.uint8)
            padded = np.concatenate([pad, x, pad])
            row = np.full(len(padded), len(e) - 1, np.int64)
            row[WINDOW : WINDOW + len(x)][w] = first[i] + np.arange(int(w.sum()))
            for at in range(0, len(starts), chunk):
                grid = (starts[at : at + chunk] + WINDOW)[:, None] + np.arange(WINDOW)
                xs.append(padded[grid])
                rows.append(row[grid])
                held += len(grid)
                if held >= chunk:
                    flush()
                    held = 0
        if xs:
            flush()
    return e[:-1], first


def _pieces(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, wanted, False].astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def tag_texts(tagger: Tagger, texts: list[str]) -> list[np.ndarray | None]:
    """Each text's tags in the pieces that can hold a span; None where a text has no such piece."""
    out: list[np.ndarray | None] = [None] * len(texts)
    at, xs, wanted, places = [], [], [], []
    for i, text in enumerate(texts):
        if not ("@" in text or _DIGIT(text)):
            continue
        x = classes(text)
        begin, size = _pieces(inside(x))
        marks = np.concatenate([[0], np.cumsum(_TRIGGERS[x])])
        some = marks[begin + size] > marks[begin]
        begin, size = begin[some], size[some]
        edge = np.zeros(len(x) + 1, np.int8)
        edge[begin] = 1
        edge[begin + size] -= 1
        at.append(i)
        xs.append(x)
        wanted.append(np.cumsum(edge)[:-1].astype(bool))
        places.append((begin, size))
    if not at:
        return out
    e, first = _blend(tagger, xs, wanted)
    sizes = np.concatenate([p[1] for p in places])
    tags = tagger.decode(e, np.cumsum(sizes) - sizes, sizes)  # a text's wanted rows are its pieces one after another
    for k, i in enumerate(at):
        out[i] = np.zeros(len(xs[k]), np.int8)
        out[i][wanted[k]] = tags[first[k] : first[k + 1]]
    return out


def tag_whole(tagger: Tagger, text: str) -> np.ndarray:
    """The tags by definition: all windows, one search over the text, with the outside tag where no span may be."""
    x = classes(text)
    e, _ = _blend(tagger, [x], [np.ones(len(x), bool)])
    e[~inside(x), 1:] -= 1e6
    return tagger.decode(e, np.zeros(min(1, len(x)), np.int64), np.full(min(1, len(x)), len(x)))


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the joined tags: a kind's run, cut at each B- tag."""
    if not tags.any():
        return []
    kind = (tags.astype(np.int64) + 1) // 2
    begin = (kind > 0) & (np.r_[True, kind[1:] != kind[:-1]] | (tags % 2 == 1))
    finish = (kind > 0) & np.r_[(kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1), True]
    return list(zip(np.flatnonzero(begin).tolist(), (kind[begin] - 1).tolist(), (np.flatnonzero(finish) + 1).tolist(), strict=True))


def find_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(pattern spans, added spans) of each text, sorted (start, kind number, end)."""
    out = []
    for text, tags in zip(texts, tag_texts(tagger, texts), strict=True):
        base = base_spans(text)
        added = []
        for s, k, e in spans_of(tags) if tags is not None else []:
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1] in " \t\n\r.,|!":
                e -= 1
            if any(s < b_e and b_s < e for b_s, _, b_e in base):
                continue
            kind, piece = KINDS[k], text[s:e]
            n = len(digits_of(piece))
            good = kind == "email" and "@" in piece[1:-1] or kind != "email" and n >= LEAST_DIGITS[kind] and not any(c.isalpha() for c in piece)
            if kind == "card" and not (n <= 19 and luhn(digits_of(piece))) or kind == "phone" and n > 15:
                good = False
            if good:
                added.append((s, k, e))
        out.append((base, added))
    return out


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans) -> str:
    out, at = [], 0
    for s, k, e in spans:
        if s < at:  # overlaps the one before it, of another kind
            at = max(at, e)
            continue
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` plus counts of the patterns' spans, n_added, base_spans, spans and the redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    names = [*(f"n_{k}" for k in KINDS), "n_added", "base_spans", "spans", "redacted"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column(len(columns))
            _, offsets = text_buffers(text)
            for at, end in slices(offsets, SLICE_BYTES, 512):
                piece = [x or "" for x in text.slice(at, end - at).to_pylist()]
                rows = []
                for t, (base, added) in zip(piece, find_spans(shared.value, piece), strict=True):
                    every = sorted(base + added)
                    rows.append((*(sum(k == i for _, k, _ in base) for i in range(4)), len(added), show(base), show(every), redact(t, every)))
                cols = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in range(len(columns))), *cols], names=[*columns, *names])

    return docs.select(*columns, F.col(text_col).alias("_text")).mapInArrow(tidy(run), f"{kinds}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_spans string, spans string, redacted string")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


def digest(spans) -> str:
    return hashlib.sha256(show(spans).encode()).hexdigest()
