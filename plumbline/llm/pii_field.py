"""A linear-chain conditional random field over the shapes of a line's words.

Words are labelled with the features of their own shape, of their neighbours' shapes, and of what stands
between them and the word before.  The field is trained from a small labelled table by gradient ascent on the penalised
likelihood, and decoded by Viterbi in numpy: all lines of a slice of texts at once, longest first.

Every state is open to every word.  Long runs of plain small-letter words are not walked through, though: from the trained
weights it follows how many such words in a row make the outside state the best one in their middle, whatever
stands before and after (`certain`), and there the line is cut.  So what is found is what Viterbi finds in the whole line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from plumbline.llm.pii_lines import LABELLED

ENTITIES = ("EMAIL", "IP", "CARD", "PHONE", "ID", "NAME", "ADDRESS")
STATES = ("O", *(f"{p}-{e}" for e in ENTITIES for p in "BI"))
OUT = 0

#: Classes of words that stand near personal data, or that tell it from the rest.
_LEXICON = {
    "phone": "call phone tel telefon teléfono fax mobile numéro number ring text",
    "mail": "email e-mail mail write send reach",
    "at": "at (at) [at]",
    "dot": "dot (dot) [dot]",
    "card": "card visa mastercard carte tarjeta karte",
    "id": "ssn security passport licence license iban account tax id national ausweis pasaporte",
    "number": "version release section page isbn sha commit order table figure chapter room release key build year price",
    "title": "mr mrs ms dr prof herr frau monsieur madame mademoiselle señor señora señorita docteur doctor",
    "name": "name names signed contact dear regards thanks patient employee customer author by with from to ask heiße m'appelle llamo user for friend wife husband brother sister"
    " son hired met client tenant",
    "street": "street st avenue ave road rd lane drive boulevard blvd court square place close way terrace rue calle avenida platz apt suite box p.o po",
    "live": "lives live address adresse anschrift dirección ship deliver moved home house wohnt wohnhaft habite vive office residence",
    "calendar": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
    " januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag",
    "thing": "license public general apache gnu copyright software university united nations holder contributors windows chrome world war great sales support help customer sir madam",
    "small": "the a an and or of in on is it this that we they our your his her my their you i he she be was were are not no yes so then but if all some most both as there here what who when how"
    " der die das und ein eine im am den dem ist nicht mit für auf von zu sich des als auch es an werden aus er hat dass sie nach wird bei einer um wer"
    " le la les un une des du de et est dans que qui pour pas sur il elle au ce en tout rien"
    " el los las una y del se que por con para su al lo como",
}
CLASS_OF = {w: k for k, ws in _LEXICON.items() for w in ws.split()}
_STREET = ("straße", "strasse", "weg", "allee", "platz", "gasse", "str")

_TOKEN = re.compile(r"[^\x20\x09-\x0D\"=,;<>{}|]+")
_TRIM = ".:!?'%$#&*"
_RUNS = re.compile(r"a+|A+")
_DIGIT_RUNS = re.compile(r"9{6,}")
_HEX_COLONS = re.compile(r"[0-9a-fA-F]{0,4}(:[0-9a-fA-F]{0,4}){2,7}")
_SPELLED_AT = re.compile(r"[\w.+-]+[(\[]at[)\]][\w.-]+")
#: Longer words are not remembered, and so many others at most.
LONGEST_REMEMBERED, REMEMBERED = 40, 150_000
PLAIN, EDGE = ("plain",), ("edge",)
#: What may stand between a word and the one before: bits of a number.
STARTS, COMMA, SIGN, SAME = 1, 2, 4, 8
N_BETWEEN = 16


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if len(self) < 5000:
            self[code] = out
        return out


_CLASSES = _Classes()


def core(word: str) -> tuple[int, int]:
    """Where the word stands without the signs around it."""
    a = len(word) - len(word.lstrip(_TRIM))
    b = len(word.rstrip(_TRIM))
    return (a, b) if a < b else (0, len(word))


def features(word: str) -> tuple[str, ...]:
    """A word's own features.  Plain small-letter words have just one."""
    if word not in CLASS_OF and word.islower() and word.isalpha() and not word.endswith(_STREET):
        return PLAIN
    low = word.lower()
    known = CLASS_OF.get(low) or CLASS_OF.get(low.rstrip(".,:;!?"))
    if known:
        return (f"class={known}", f"class={known},{'A' if word[:1].isupper() else 'a'}")
    bare = word.rstrip(".!?") if len(word) > 2 else word
    if bare.isalpha() and bare == low[: len(bare)] and not bare.endswith(_STREET):
        return PLAIN
    a, b = core(word)
    w = word[a:b]
    shape = _DIGIT_RUNS.sub("9999999", _RUNS.sub(lambda m: m[0][0] + m[0][0] * (len(m[0]) > 1), w.translate(_CLASSES)))
    shape = shape.replace("Aaa", "Aa")
    out = ["shape=" + shape]
    if any(c.isdigit() for c in w):
        out += [f"digits={min(sum(c.isascii() and c.isdigit() for c in w), 17)}", "signs=" + "".join(sorted({c for c in shape if not c.isalnum()}))]
        if any(c.isalpha() for c in w):
            out.append("letters" + ("-upper" if w.upper() == w else ""))
    else:
        out.append("no-digits")
        if w[:1].isupper():
            out.append("capital")
            if w.isupper() and len(w) > 1:
                out.append("capitals")
    if word[-1] in ".!?" and b - a > 1:
        out.append("stops")
    if word.startswith("("):
        out.append("opens")
    if _HEX_COLONS.fullmatch(w):
        out.append("colons-hex")
    if _SPELLED_AT.fullmatch(w):
        out.append("spelled-at")
    if "@" in w:
        out.append("at-sign")
    if low.rstrip(".").endswith(_STREET):
        out.append("street-end")
    return tuple(out)


def tokens(line: str) -> list[tuple[str, int, int]]:
    """The line's words, where each starts, and what stands before it (bits)."""
    out, end, last = [], 0, ""
    for m in _TOKEN.finditer(line):
        w, start = m[0], m.start()
        gap = line[end:start]
        bits = STARTS if not last or last[-1] in ".!?" else 0
        if gap and gap != " ":
            bits |= COMMA if "," in gap else 0
            bits |= SIGN if gap.strip(" \t\x0b\x0c\r,") else 0
        if w == last:
            bits |= SAME
        out.append((w, start, bits))
        end, last = m.end(), w
    return out


_SEPARATES = np.zeros(128, dtype=bool)
_SEPARATES[[ord(c) for c in " \t\n\x0b\x0c\r\"=,;<>{}|"]] = True
_SPACE = np.zeros(128, dtype=bool)
_SPACE[[ord(c) for c in " \t\n\x0b\x0c\r"]] = True
_STOPS = np.zeros(128, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True


@dataclass
class Words:
    """The words of several lines laid end to end: their text, start, end, what stands before each (bits), and which open and close a line."""

    words: list[str]
    start: np.ndarray
    end: np.ndarray
    between: np.ndarray
    opens: np.ndarray
    closes: np.ndarray


def words_of(text: str) -> Words:
    """The same as `tokens` of every line, in a few numpy passes over the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(code, 127)
    held = np.concatenate(([False], ~(_SEPARATES[low] & (code < 128)), [False]))
    edge = np.flatnonzero(held[1:] != held[:-1])
    start, end = edge[::2], edge[1::2]
    words = [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    lines = np.flatnonzero(code == 10) + 1
    line = np.searchsorted(lines, start, side="right")
    opens, closes = np.ones(len(start), dtype=bool), np.ones(len(start), dtype=bool)
    opens[1:] = closes[:-1] = line[1:] != line[:-1]
    line_start = np.concatenate(([0], lines))[line]
    gap = np.concatenate(([0], end[:-1])) if len(end) else end
    gap = np.maximum(gap, line_start)
    commas = np.concatenate(([0], np.cumsum(code == 44)))
    signs = np.concatenate(([0], np.cumsum(~held[1:-1] & ~_SPACE[low] & (code != 44))))
    between = np.where(opens, STARTS, 0)
    if len(start) > 1:
        between[1:] |= np.where(_STOPS[low[end[:-1] - 1]] & (code[end[:-1] - 1] < 128), STARTS, 0)
        same = np.fromiter((a == b for a, b in zip(words[1:], words[:-1], strict=True)), dtype=bool, count=len(words) - 1)
        between[1:] |= np.where(same & ~opens[1:], SAME, 0)
    between |= np.where(commas[start] > commas[gap], COMMA, 0) | np.where(signs[start] > signs[gap], SIGN, 0)
    return Words(words, start, end, between, opens, closes)


def read_labelled(lines: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Each line's text, and its entities: kind, start, end."""
    out = []
    for line in lines:
        text, spans, stack, at = "", [], None, 0
        for m in re.finditer(r"\[(%s) |\]|[^\]\[]+|\[" % "|".join(ENTITIES), line):
            if m[1]:
                stack, depth = (m[1], len(text)), 0
            elif m[0] == "]" and stack and not depth:
                spans.append((*stack, len(text)))
                stack = None
            else:
                if stack:
                    depth += (m[0] == "[") - (m[0] == "]")
                text += m[0]
        out.append((text, spans))
    return out


def states_of(words: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """The state of each word: inside of the span that holds its middle."""
    out = []
    before = None
    for w, start, _ in words:
        middle = start + len(w) // 2
        own = next((s for s in spans if s[1] <= middle < s[2]), None)
        out.append(STATES.index(f"{'I' if own is before else 'B'}-{own[0]}") if own else OUT)
        before = own
    return out


def allowed_moves() -> np.ndarray:
    """0 where a state may follow another (an inside only after its own kind), else minus infinity in effect."""
    out = np.zeros((len(STATES), len(STATES)))
    for j, s in enumerate(STATES):
        if s[0] == "I":
            out[:, j] = -1e9
            out[[STATES.index("B" + s[1:]), j], j] = 0
    return out


def _start() -> np.ndarray:
    return np.array([-1e9 if s[0] == "I" else 0.0 for s in STATES])


class Field:
    """Weights of the field: for each feature and side (left neighbour, self, right neighbour), for what stands between, and for pairs of states."""

    def __init__(self, index: dict[tuple[int, str], int], weights: np.ndarray, between: np.ndarray, moves: np.ndarray) -> None:
        self.index, self.weights, self.between, self.moves = index, weights, between, moves
        self.rows: dict[str, int] = {}
        self.row_of: dict[tuple[str, ...], int] = {}
        self.emitted: list[np.ndarray] = []
        self.edge = self._emit(EDGE)
        self.plain = self._emit(PLAIN)
        self.row_of[PLAIN] = 0
        self.emitted.append(self.plain)
        self.cut_at = self.certain()

    def _emit(self, own: tuple[str, ...]) -> np.ndarray:
        """What a word with these features adds to its right neighbour's, its own and its left neighbour's states."""
        out = np.zeros((3, len(STATES)))
        for k, side in enumerate((-1, 0, 1)):
            rows = [self.index[side, f] for f in own if (side, f) in self.index]
            out[k] = self.weights[rows].sum(axis=0) if rows else 0
        return out

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's row in the table of what its features emit, and the table (row 0: a plain word's)."""
        known = self.rows
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.emitted) > REMEMBERED // 10:
            known.clear()
            self.row_of, self.emitted = {PLAIN: 0}, [self.plain]
        out = []
        for w in words:
            r = known.get(w)
            if r is None:
                own = features(w)
                r = self.row_of.get(own)
                if r is None:
                    r = self.row_of[own] = len(self.emitted)
                    self.emitted.append(self._emit(own))
                if len(w) <= LONGEST_REMEMBERED:
                    known[w] = r
            out.append(r)
        return np.array(out, dtype=np.int64), np.array(self.emitted)

    def certain(self, most: int = 24) -> int:
        """How many plain words on either side make the outside state the only best one for a plain word; 0 if not even `most` do."""
        step = self.moves + self.plain.sum(axis=0)[None, :] + self.between[0][None, :]
        power = step
        for m in range(1, most + 1):
            both = (power[:, :, None] + power[None, :, :]).max(axis=1)
            through = power[:, OUT][:, None] + power[OUT][None, :]
            rest = power.copy()
            rest[:, OUT] = -np.inf
            others = (rest[:, :, None] + power[None, :, :]).max(axis=1)
            open_ends = both > -1e8
            if (through[open_ends] > others[open_ends] + 1e-6).all():
                return m
            power = (power[:, :, None] + step[None, :, :]).max(axis=1)
        return 0


def _neighbours(own: list[tuple[str, ...]]) -> list[list[tuple[int, str]]]:
    return [[(s, f) for s, fs in zip((-1, 0, 1), three, strict=True) for f in fs] for three in zip([EDGE, *own[:-1]], own, [*own[1:], EDGE], strict=True)]


class _Sums:
    """Sums of a table's rows: row `of` of the table is added to row `to` of the result.  A sparse product, without the zeros."""

    def __init__(self, to: np.ndarray, of: np.ndarray, n: int) -> None:
        pairs = np.unique(np.stack((to, of)), axis=1)  # a feature that a word has twice counts once
        self.of, self.n = pairs[1], n
        self.first = np.flatnonzero(np.concatenate(([True], pairs[0][1:] != pairs[0][:-1])))
        self.rows = pairs[0][self.first]

    def __call__(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]))
        out[self.rows] = np.add.reduceat(table[self.of], self.first, axis=0)
        return out


@lru_cache(maxsize=2)
def _trained(lines: tuple[str, ...], steps: int, rate: float, penalty: float) -> Field:
    data = [(tokens(t), spans) for t, spans in read_labelled(list(lines))]
    data = sorted(((w, states_of(w, spans)) for w, spans in data if w), key=lambda x: -len(x[0]))
    index: dict[tuple[int, str], int] = {}
    n, k = len(data), len(STATES)
    t = max((len(w) for w, _ in data), default=1)
    gold, real, bits = np.zeros((n, t), dtype=int), np.zeros((n, t), dtype=bool), np.zeros((n, t), dtype=int)
    at, feature = [], []
    for i, (words, states) in enumerate(data):
        gold[i, : len(states)], real[i, : len(states)] = states, True
        bits[i, : len(words)] = [b for _, _, b in words]
        for j, names in enumerate(_neighbours([features(w) for w, _, _ in words])):
            for x in names:
                at.append(i * t + j)
                feature.append(index.setdefault(x, len(index)))
    for b in range(4):
        there = np.flatnonzero((bits.ravel() >> b & 1) & real.ravel())
        at += there.tolist()
        feature += [len(index) + b] * len(there)
    by_word, by_feature = _Sums(np.array(at), np.array(feature), n * t), _Sums(np.array(feature), np.array(at), len(index) + 4)
    hot = np.eye(k)[gold] * real[:, :, None]
    block, start = allowed_moves(), _start()
    both = real[:, 1:] & real[:, :-1]
    gold_moves = np.einsum("ntj,ntk,nt->jk", hot[:, :-1], hot[:, 1:], both)
    last = real.sum(axis=1) - 1
    going = real.sum(axis=0)  # lines that have so many words; the longest are the first
    theta = [np.zeros((len(index) + 4, k)), np.zeros((k, k))]
    first, second = ([np.zeros_like(x) for x in theta] for _ in range(2))

    def add(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        e = by_word(theta[0]).reshape(n, t, k)
        moves = theta[1] + block
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0] + start
        for j in range(1, t):
            m = going[j]
            alpha[:m, j] = add(alpha[:m, j - 1, :, None] + moves[None], 1) + e[:m, j]
        z = add(alpha[np.arange(n), last], 1)
        pairs = np.zeros((k, k))
        for j in range(t - 2, -1, -1):
            m = going[j + 1]
            ahead = moves[None] + (e[:m, j + 1] + beta[:m, j + 1])[:, None, :]
            beta[:m, j] = add(ahead, 2)
            pairs += np.exp(np.minimum(alpha[:m, j, :, None] + ahead - z[:m, None, None], 0)).sum(axis=0)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * real[:, :, None]
        grad = [by_feature((hot - p).reshape(n * t, k)), gold_moves - pairs]
        for x, g, m, v in zip(theta, grad, first, second, strict=True):
            g = g - penalty * x
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    own = theta[0][: len(index)]
    bit = theta[0][len(index) : len(index) + 4]
    between = np.array([sum((bit[b] for b in range(4) if code >> b & 1), np.zeros(k)) for code in range(N_BETWEEN)])
    return Field(index, own, between, theta[1] + block)


def train(lines: list[str] = LABELLED, steps: int = 120, rate: float = 0.15, penalty: float = 0.05) -> Field:
    """Maximise the penalised log-likelihood by Adam; all lines at once, padded to one length."""
    return _trained(tuple(lines), steps, rate, penalty)


def decode(field: Field, found: Words, cut: bool = True) -> np.ndarray:
    """The best states of the words, line by line.  cut=False walks through plain runs as well, with the same result."""
    return decode_surely(field, found, lambda state: np.zeros(len(state), dtype=bool), cut)[0]


def decode_surely(field: Field, found: Words, asked: Callable[[np.ndarray], np.ndarray], cut: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The best states of the words, line by line, and how probable each one is: its marginal, over all states of the words around it.

    The second is computed only for stretches in which `asked`, given all states, marks a word, and is 1 elsewhere.
    """
    n = len(found.words)
    state, chance = np.zeros(n, dtype=np.int64), np.ones(n)
    if n:
        row, table = field.rows_of(found.words)
        e = table[row, 1] + field.between[found.between]
        e[1:] += np.where(found.opens[1:, None], field.edge[0], table[row[:-1], 0])
        e[0] += field.edge[0]
        e[:-1] += np.where(found.closes[:-1, None], field.edge[2], table[row[1:], 2])
        e[-1] += field.edge[2]
        dead = _dead(field, row, found) if cut and field.cut_at else np.zeros(n, dtype=bool)
        stretches = _stretches(dead, found.opens, found.closes)
        _walk(field, e, stretches, found.opens, found.closes, state)
        marked = asked(state)
        if marked.any():
            held = np.concatenate(([0], np.cumsum(marked)))
            _marginals(field, e, stretches[:, held[stretches[1]] > held[stretches[0]]], found.opens, found.closes, state, chance)
    return state, chance


def viterbi(field: Field, lines: list[list[tuple[str, int, int]]], cut: bool = True) -> list[np.ndarray]:
    """The best states of each line's words, as `tokens` gives them."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    opens, closes = np.zeros(int(sizes.sum()), dtype=bool), np.zeros(int(sizes.sum()), dtype=bool)
    opens[first[sizes > 0]] = True
    closes[(first + sizes - 1)[sizes > 0]] = True
    start = np.array([a for x in lines for _, a, _ in x], dtype=np.int64)
    between = np.array([b for x in lines for _, _, b in x], dtype=np.int64)
    state = decode(field, Words([w for x in lines for w, _, _ in x], start, start, between, opens, closes), cut)
    return np.split(state, np.cumsum(sizes)[:-1]) if len(lines) else []


def _dead(field: Field, row: np.ndarray, found: Words) -> np.ndarray:
    """Words that `certain` says are outside: plain ones with enough plain ones before and after."""
    plain = row == 0
    inner = plain & (found.between == 0) & ~found.opens & ~found.closes
    inner[1:] &= plain[:-1]
    inner[:-1] &= plain[1:]
    place = np.arange(len(inner))
    last_break = np.maximum.accumulate(np.where(inner, -1, place))
    next_break = np.minimum.accumulate(np.where(inner, len(inner), place)[::-1])[::-1]
    return inner & (place - last_break > field.cut_at) & (next_break - place > field.cut_at)


def _stretches(dead: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Start and end of each stretch of a line between dead words, the longest first."""
    alive = ~dead
    opens, closes = alive & begins, alive & ends
    opens[1:] |= alive[1:] & dead[:-1]
    closes[:-1] |= alive[:-1] & dead[1:]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    order = np.argsort(a - b, kind="stable")
    return np.array([a[order], b[order]])


def _marginals(field, e, stretches, begins, ends, state, chance) -> None:
    """The marginal of each word's state, forward and backward over the stretches side by side."""
    a, b = stretches
    if not len(a):
        return
    length = b - a
    forward = np.zeros((int(length.sum()), e.shape[1]))  # the stretches' words, end to end
    first = np.cumsum(length) - length
    weight = np.exp(field.moves)
    going = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.exp(x - x.max(axis=1, keepdims=True))

    now = scaled(np.where(begins[a][:, None], _start()[None], field.moves[OUT][None]) + e[a])
    forward[first] = now
    for t in range(1, int(length[0])):
        m = int(going[t])
        now = (now[:m] @ weight) * scaled(e[a[:m] + t])
        now /= now.sum(axis=1, keepdims=True)
        forward[first[:m] + t] = now
    after = np.where(ends[b - 1][:, None], 1.0, weight[:, OUT][None])
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(going[t])
        at = a[:m] + t
        both = forward[first[:m] + t] * after[:m]
        chance[at] = both[np.arange(m), state[at]] / both.sum(axis=1)
        if t:
            back = (after[:m] * scaled(e[at])) @ weight.T
            after[:m] = back / back.sum(axis=1, keepdims=True)


def _walk(field, e, stretches, begins, ends, state) -> None:
    """Viterbi over the stretches between dead words; they are walked side by side, the longest first."""
    n, k = e.shape
    a, b = stretches
    if not len(a):
        return
    length = b - a
    start = np.where(begins[a][:, None], _start()[None], field.moves[OUT][None])
    final = np.where(ends[b - 1][:, None], 0.0, field.moves[:, OUT][None])
    back = np.zeros((n, k), dtype=np.int8)
    best = start + e[a]
    moves = np.ascontiguousarray(field.moves.T)[None]
    offset = np.arange(len(a) * k) * k
    going = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    for t in range(1, int(length[0])):
        m = int(going[t])
        options = best[:m, None, :] + moves
        here = options.argmax(axis=2)
        back[a[:m] + t] = here
        best[:m] = options.reshape(-1)[offset[: m * k] + here.reshape(-1)].reshape(m, k) + e[a[:m] + t]
    now = (best + final).argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(going[t])
        state[a[:m] + t] = now[:m]
        if t:
            now[:m] = back[a[:m] + t, now[:m]]
