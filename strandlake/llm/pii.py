"""Personal data by a semi-Markov conditional random field over whole spans.

Four base patterns (email, ip, card, phone) give spans that always stay. A semi-Markov CRF adds spans that the patterns miss,
such as spelled-out addresses or numbers in other groupings: a candidate is a run of at most MAX_TOKENS white-space tokens,
features describe the whole run, and dynamic programming over bounded runs chooses boundaries and kinds jointly. Added
spans never overlap base ones.

Only runs that hold a digit, an at sign or a spelled `at` or `dot` can be named, so the dynamic program is run on windows around
such tokens; between them every token is `other` in every segmentation, and the result is that of the whole text. Candidates are scored as
the program comes to their last token; of a token it keeps a few bytes, so that a table of numbers of any length fits a task. Weights are fitted on
examples made from a seed, once in the driver; they take no rows of the corpus.

Defined cases: null text counts as empty and has no spans; texts of any length are searched whole; repeated rows are searched
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, pick

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
MAX_TOKENS = 5
#: Tokens on either side of one that opens a window.
CONTEXT = MAX_TOKENS
#: Characters of the longest candidate span.
LONGEST = 120
#: Score over `other` that a candidate has for some kind; shapes of spans whose scores a task keeps.
LEAST = -4.0
SHAPES = 100_000

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
#: What opens a window: a mark, or a token that `Window` calls spelled.
_OPENS = re.compile(r"(?i)[0-9@]|[\[(](?:at|dot)[\])]|(?<!\S)[\[(]?(?:at|dot)[\])]?(?!\S)")
_END = re.compile(r"^[+(\[]|[A-Za-z0-9]$")
_SPELLED = re.compile(r"(?i)^[\[(]?(at|dot)[\])]?$|[\[(](at|dot)[\])]")
_EDGE = ".,;:!?\"'<>|[]{}"
_CUES = {"tel": "call", "telephone": "call", "phone": "call", "call": "call", "mobile": "call", "fax": "call", "mail": "mail", "email": "mail", "contact": "mail", "card": "pay", "visa": "pay", "payment": "pay", "ip": "net", "host": "net", "server": "net", "address": "net"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind; matches that fail are dropped."""
    out = [(0, *x) for x in emails(text)] + [(1, *x) for x in addresses(text)]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def emails(text: str):
    """The matches of `EMAIL`, each found from its at sign, so that long runs without one cost no more than their length."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := EMAIL.match(text, begin)):
            yield begin, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def addresses(text: str):
    """The matches of `IP` whose parts are 255 at most: four parts in a row without a gap, from the left of each run."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        begin, parts = run.start(), []
        for p in run.group().split("."):
            parts.append((begin, p))
            begin += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            gap = next((k for k in (3, 2, 1, 0) if not four[k][1]), None)
            if gap is not None:
                i += gap + 1
                continue
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, p in four):
                yield four[0][0], four[3][0] + len(four[3][1])
            i += 4


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its edges."""
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    if text[start:end].count(")") > text[start:end].count("(") and text[end - 1 : end] == ")":
        end -= 1
    return start, end


def span_features(span: str, tokens: int, cue: str) -> tuple[str, ...]:
    """Features of a whole candidate span."""
    digits = re.sub(r"[^0-9]", "", span)
    groups = re.findall(r"[0-9]+", span)
    marks = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", span))))[:6]
    words = re.findall(r"[^\W\d_]+", span)
    n = len(digits)
    out = [f"n{min(n, 20)}", f"groups {'-'.join(str(len(g)) for g in groups[:6])}", f"marks {marks}", f"words {min(len(words), 4)}", f"tokens {tokens}"]
    if 13 <= n <= 19:
        out.append("luhn" if luhn(digits) and not words else "no luhn")
    if n and not words:
        out.append("digits only")
        if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and set(re.sub(r"[0-9]", "", span)) <= {".", " ", "[", "]", "("}:
            out.append("four octets")
        if 9 <= n <= 15 and (span[0] == "+" or span[0] == "(" or (2 <= len(groups) <= 5 and all(2 <= len(g) <= 4 for g in groups))):
            out.append("phone groups")
    low = span.lower()
    if "@" in span or re.search(r"[\[(]at[\])]|\bat\b", low):
        out.append("at")
        # A full stop before a space ends a sentence.
        if re.search(r"(\.|([\[(]dot[\])]|\bdot\b)\s*)[a-z]{2,6}$", low):
            out.append("at then domain")
            if re.match(r"[a-z0-9._%+-]+\s*(@|[\[(]at[\])]|\bat\b)", low):
                out.append("whole address")
    if cue:
        out.append(f"cue {cue}")
        out.append(f"cue {cue} {'many' if n >= 7 else 'few'}")
    return tuple(out)


class Window:
    """The tokens of one window, and the candidate spans that can be named. Candidates are made one end at a time and not kept."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens
        self.marked, self.open, self.spelled = bytearray(), bytearray(), bytearray()
        for a, b in tokens:
            token = text[a:b]
            marked = bool(_MARK.search(token))
            self.marked.append(marked)
            # An end of a span has a digit or an at sign, or is a part of a spelled-out address.
            self.open.append(marked or bool(_END.search(token.rstrip(_EDGE))))
            self.spelled.append(bool(_SPELLED.search(token)))

    def ending(self, j: int) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
        """(first token, start, end, features) of the candidates whose last token is the one before `j`."""
        for i in range(j - 1, max(0, j - MAX_TOKENS) - 1, -1):
            words = 1 in self.spelled[i:j]
            if not words and 1 not in self.marked[i:j]:
                continue
            if not words and j - i > 1 and not (self.marked[i] and self.marked[j - 1]):
                continue
            if words and not (self.open[i] and self.open[j - 1]):
                continue
            a, b = core(self.text, self.tokens[i][0], self.tokens[j - 1][1])
            if a < b <= a + LONGEST:
                before = self.text[self.tokens[i - 1][0] : self.tokens[i - 1][1]].strip(_EDGE).lower() if i else ""
                yield i, a, b, span_features(self.text[a:b], j - i, _CUES.get(before, ""))

    @property
    def spans(self) -> dict[tuple[int, int], tuple[int, int, tuple[str, ...]]]:
        """All candidates, by first and last token."""
        return {(i, j): (a, b, f) for j in range(1, len(self.tokens) + 1) for i, a, b, f in self.ending(j)}


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token runs around every token with a digit, an at sign, or a spelled `at` or `dot`."""
    out: list[list[tuple[int, int]]] = []
    end = -1
    for m in _OPENS.finditer(text):
        if m.start() < end:
            continue
        begin = m.start()
        steps = 0
        while begin > max(end, 0) and steps <= CONTEXT:
            # Back over one token and the space before it; the first is the one that opens the window.
            while begin > max(end, 0) and not text[begin - 1].isspace():
                begin -= 1
            steps += 1
            if steps <= CONTEXT:
                while begin > max(end, 0) and text[begin - 1].isspace():
                    begin -= 1
        runs = []
        left = None
        for t in _RUN.finditer(text, begin):
            runs.append(t.span())
            if t.start() > m.start():
                left = CONTEXT if _OPENS.search(t.group()) else (CONTEXT if left is None else left) - 1
                if left <= 0:
                    break
        new_end = runs[-1][1]
        if out and begin <= end:
            out[-1] += runs
        else:
            out.append(runs)
        end = new_end
    return out


class Model:
    """Weights: (feature, label) and label to label."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.shapes: dict[tuple[str, ...], list[float] | None] = {}

    def scores(self, features: tuple[str, ...]) -> np.ndarray:
        at = [i for f in features if (i := self.names.get(f)) is not None]
        return self.weights[at].sum(axis=0)

    def scored(self, features: tuple[str, ...]) -> list[float] | None:
        """The scores of the kinds, kept for as many shapes of spans as SHAPES; None if all are below LEAST."""
        if features not in self.shapes:
            if len(self.shapes) >= SHAPES:
                self.shapes.clear()
            s = (self.scores(features)[1:]).tolist()
            self.shapes[features] = s if max(s) > LEAST else None
        return self.shapes[features]

    def best(self, w: Window) -> list[tuple[int, int, int]]:
        """The best segmentation's named spans: (kind, start, end) in the text.

        Of a token are kept the values of its labels, for as many tokens as a span has, and for each label the length and the label before
        the span that ends there: two bytes.
        """
        n, k = len(w.tokens), len(LABELS)
        moves = self.moves.tolist()
        none = [-np.inf] * k
        values = [[0.0, *none[1:]]]
        lengths, labels = bytearray(k), bytearray(k)
        named = False
        for j in range(1, n + 1):
            last = values[-1]
            value = none.copy()
            length, label = bytearray([1] * k), bytearray(k)
            for y in range(k):
                if (come := last[y] + moves[y][0]) > value[0]:
                    value[0], label[0] = come, y
            # Longer spans first, as they begin first.
            for i, _, _, f in reversed(list(w.ending(j))):
                if (s := self.scored(f)) is None:
                    continue
                named = True
                start = values[i - j]
                for y in range(1, k):
                    come, x = max((start[x] + moves[x][y], -x) for x in range(k))
                    if come + s[y - 1] > value[y]:
                        value[y], length[y], label[y] = come + s[y - 1], j - i, -x
            values.append(value)
            if len(values) > MAX_TOKENS:
                del values[0]
            lengths += length
            labels += label
        if not named:
            return []
        out = []
        j, y = n, max(range(k), key=lambda y: (values[-1][y], -y))
        while j > 0:
            i, before = j - lengths[j * k + y], labels[j * k + y]
            if y:
                out.append((y - 1, *core(w.text, w.tokens[i][0], w.tokens[j - 1][1])))
            j, y = i, before
        return out[::-1]


def examples(seed: int = 11, n: int = 420) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts and their spans, made from a seed: kinds in many spellings among words, dates, versions, prices and keys."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "an", "er", "on", "ti", "sch", "que", "ment", "la", "do", "re", "in"]) for _ in range(r.randint(1, 3)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(lengths: list[int], mark: str, good: bool = True) -> str:
        while True:
            x = d(sum(lengths))
            if luhn(x) == good and x[0] != "0":
                break
        parts, at = [], 0
        for k in lengths:
            parts.append(x[at : at + k])
            at += k
        return mark.join(parts)

    octet = lambda: str(r.randint(1, 255))

    def named() -> tuple[int, str]:
        kind = r.randrange(4)
        if kind == 0:
            a, b, c = word(), word(), r.choice(["com", "org", "net", "de"])
            return 0, r.choice([f"{a}@{b}.{c}", f"{a}.{d(2)}@{b}.{c}", f"{a} at {b} dot {c}", f"{a} [at] {b} [dot] {c}", f"{a}(at){b}.{c}", f"{a} (at) {b}.{c}", f"{a}[at]{b}[dot]{c}"])
        if kind == 1:
            return 1, r.choice([".", ".", "[.]"]).join(octet() for _ in range(4))
        if kind == 2:
            return 2, card(r.choice([[4, 4, 4, 4], [4, 6, 5], [16], [4, 4, 4, 4]]), r.choice([" ", "-", ".", ""]))
        return 3, r.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"({d(3)}) {d(3)} {d(4)}"])

    def other() -> str:
        return r.choice([f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 12)}:{r.randint(10, 59)}", f"{d(2)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(2)}.{d(1)}", f"${d(3)}", f"#{d(4)}", d(r.randint(1, 8)), "%032x" % r.getrandbits(128), card([16], "", False), card([4, 4, 4, 4], " ", False), f"{d(2)}/{d(2)}/{d(4)}", f"{d(3)}-{d(3)}", f"{r.randint(256, 999)}.{octet()}.{octet()}.{octet()}", f"{d(1)},{d(3)},{d(3)}", "at", f"{d(5)}-{d(5)}", f"{d(24)}", f"{d(1)} {d(2)} {d(1)}", f"{d(4)} {d(4)}", *prose()])

    def prose() -> list[str]:
        a, b, c, e = word(), word(), word(), word()
        return [f"{a} at {b}. {c.capitalize()}", f"{a}.\nAt {b}", f"{a}, at {b} {c}", f"{a} at {b}, {c}", f"{a}. At {b} {c}. {e.capitalize()}", f"{a} dot {b}", f"at {a} the dot"]

    cues = {0: ["mail", "contact"], 1: ["host", "ip"], 2: ["card", "visa"], 3: ["call", "tel", "phone"]}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.5:
                kind, s = named()
                if r.random() < 0.3:
                    text += r.choice(cues[kind]) + r.choice([" ", ": "])
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + r.choice(["", ".", ","]) + " "
            elif r.random() < 0.7:
                text += other() + " "
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=1)
def fitted(epochs: int = 6, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """The CRF fitted to `examples` by its conditional likelihood (forward and backward sums over all segmentations)."""
    data = []
    names: dict[str, int] = {}
    for text, spans in examples():
        w = Window(text, [m.span() for m in _RUN.finditer(text)])
        spans_ = w.spans
        gold = {}
        for kind, a, b in spans:
            at = [ij for ij, (x, y, _) in spans_.items() if (x, y) == core(text, a, b)]
            if at:
                gold[at[0]] = kind + 1
        for _, _, f in spans_.values():
            for x in f:
                names.setdefault(x, len(names))
        rows = [(i, j, np.array([names[x] for x in f])) for (i, j), (_, _, f) in sorted(spans_.items(), key=lambda e: e[0][1])]
        data.append((len(w.tokens), rows, gold))
    k = len(LABELS)
    weights, moves = np.zeros((len(names), k)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    order = random.Random(5)
    for _ in range(epochs):
        order.shuffle(data)
        for n, rows, gold in data:
            s = [weights[f].sum(axis=0) for _, _, f in rows]
            alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
            alpha[0, 0], beta[n] = 0.0, 0.0
            ends: dict[int, list[int]] = {}
            starts: dict[int, list[int]] = {}
            for x, (i, j, _) in enumerate(rows):
                ends.setdefault(j, []).append(x)
                starts.setdefault(i, []).append(x)
            with np.errstate(divide="ignore", invalid="ignore"):
                for j in range(1, n + 1):
                    alpha[j, 0] = np.logaddexp.reduce(alpha[j - 1] + moves[:, 0])
                    for x in ends.get(j, ()):
                        alpha[j, 1:] = np.logaddexp(alpha[j, 1:], np.logaddexp.reduce(alpha[rows[x][0]][:, None] + moves[:, 1:], axis=0) + s[x][1:])
                for i in range(n - 1, -1, -1):
                    total = moves[:, 0] + beta[i + 1, 0]
                    for x in starts.get(i, ()):
                        total = np.logaddexp(total, np.logaddexp.reduce(moves[:, 1:] + s[x][1:] + beta[rows[x][1], 1:], axis=1))
                    beta[i] = total
                z = np.logaddexp.reduce(alpha[n])
                grad_m = np.zeros_like(moves)
                grads = []
                for x, (i, j, f) in enumerate(rows):
                    p = np.exp(alpha[i][:, None] + moves[:, 1:] + s[x][1:] + beta[j, 1:] - z)
                    grad_m[:, 1:] -= p
                    g = np.zeros(k)
                    g[1:] = -p.sum(axis=0)
                    if (i, j) in gold:
                        g[gold[i, j]] += 1.0
                    grads.append((f, g))
                for j in range(1, n + 1):
                    grad_m[:, 0] -= np.exp(alpha[j - 1] + moves[:, 0] + beta[j, 0] - z)
            at, y = 0, 0
            while at < n:
                j, label = next(((j, label) for (i, j), label in gold.items() if i == at), (at + 1, 0))
                grad_m[y, label] += 1.0
                at, y = j, label
            for f, g in grads:
                step = g - decay * weights[f]
                seen_w[f] += step * step
                weights[f] += rate * step / np.sqrt(seen_w[f])
            seen_m += grad_m * grad_m
            moves += rate * grad_m / np.sqrt(seen_m)
    return Model(names, weights, moves)


def added_spans(text: str, model: Model, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the CRF that overlap no base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    furthest = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts
    out = []
    for tokens in windows(text):
        for kind, a, b in model.best(Window(text, tokens)):
            before = int(np.searchsorted(starts, b)) if taken else 0
            if not before or furthest[before - 1] <= a:
                out.append((kind, a, b))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added."""
    model = fitted()

    def work(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for t in texts:
            t = t or ""
            base = base_spans(t)
            more = added_spans(t, model, base)
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(s[0] == i for s in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(base + more))
            out["n_added"].append(len(more))
        return out

    return map_texts(pick(df, doc_id=id_col, text=text_col), ["doc_id"], "text", "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint", work)
