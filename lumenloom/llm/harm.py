"""Abusive, hateful and sexual content: a subsequence-kernel SVM with Nystroem landmarks.

Two lines are similar if they share characters in the same order, adjacent or
with others between them. The kernel is the gap-weighted subsequence kernel:
every subsequence of LENGTH characters within a window of SPAN is a feature, and
each of its occurrences counts DECAY for every character left out, so inserted,
masked and spaced-out letters leave most features in place. An SVM is trained on
labelled lines in the space of landmark lines; as the kernel is a dot product,
its weights fold back into one table of feature weights, and scoring a corpus is
a vectorised look-up instead of a kernel value per landmark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import combinations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.seeds import HARMFUL, HARMLESS

#: Labelled documents of each class from which lines are learned (a bounded sample, by hash of the id); their whole texts are read.
MOST_LABELLED = 5_000
#: Landmark lines, the harmless lines among them that score highest, and passes over the labels.
LANDMARKS, HARD, ROUNDS = 640, 160, 4
#: Harmless forms that the SVM holds at a time: those that score highest of all, and as many others.
ACTIVE = 2_000
#: Cost of a violated margin, regularisation of the first fit, and the most documents of a form that count.
COST, RIDGE, MOST_COUNTED = 4.0, 0.3, 10.0
#: How many times more often than any document a harmful one is labelled harmful, as first assumed, in how many documents a form stands that tells, the fewest such forms, and the log odds below which a form is harmless.
EXCESS, OFTEN, LEAST_FORMS, CLEARLY = 40.0, 8, 20, -2.0
#: Length of a subsequence, the window it must lie in, and the weight of a gap of one character.
LENGTH, SPAN, DECAY = 4, 7, 0.6
#: Offsets of a feature's characters, and their weights.
OFFSETS = [((0, *rest), DECAY ** (rest[-1] - LENGTH + 1)) for rest in combinations(range(1, SPAN), LENGTH - 1)]
#: The weight by the offset of the last character.
WEIGHTS = {offsets[-1]: weight for offsets, weight in OFFSETS}
#: Positions below which a line's length isn't taken as less, so that a few letters prove nothing.
LEAST_POSITIONS = 20.0
#: Slots of the table of feature weights (a power of two), and positions that are looked up together.
SLOTS, CHUNK = 1 << 20, 1 << 13
#: Longest line that is scored as a whole; longer ones are cut into stretches that overlap by half.
LINE, STRETCH = 120, 72

_BREAK = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])|[\n\r\t\v\f  |]+|\s{2,}")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\n(?=[^\W\d_])")


def _character_table() -> np.ndarray:
    """Character code to the code used for features; 0 is dropped, 1 a blank, 2 a mark."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        low = ch.lower()
        if c < 33 or ch.isspace():
            table[c] = 1
        elif len(low) == 1 and low != ch:
            table[c] = ord(low)
        elif not ch.isalnum() and c < 0x2E80:
            table[c] = 2
    # Accents, look-alikes of other scripts.
    for plain, like in {"a": "àáâãåä", "e": "èéêë", "i": "ìíîï", "o": "òóôõö", "u": "ùúûü", "c": "ç", "n": "ñ"}.items():
        for ch in like + like.upper():
            table[ord(ch)] = ord(plain)
    for a, b in zip("аеорсхуіѕјк", "aeopcxyisjk"):
        table[ord(a)] = table[ord(a.upper())] = ord(b)
    for c in range(0xFF01, 0xFF5F):
        table[c] = table[c - 0xFEE0]
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370), *range(0xFE00, 0xFE10)):
        table[c] = 0
    return table


_CHARACTERS = _character_table()
# Signs that stand for letters inside a word.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "+": "t", "€": "e"}
_INSIDE = np.zeros(0x110000, dtype=np.uint32)
for _sign, _letter in _SIGNS.items():
    _INSIDE[ord(_sign)] = ord(_letter)


def lines_of(text: str) -> list[str]:
    """A text's sentences and lines, long ones cut into overlapping stretches; words hyphenated over a line end are joined."""
    if "-\n" in text:
        text = _HYPHEN.sub("", text)
    out = []
    for line in map(str.strip, _BREAK.split(text)):
        if len(line) <= LINE:
            if len(line) > 3:
                out.append(line)
        else:
            out.extend(line[i : i + STRETCH] for i in range(0, len(line) - STRETCH // 2, STRETCH // 2))
    return out


def characters(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All lines' feature characters in a row, and the offsets at which lines begin (one more than lines).

    Lower case, look-alikes and signs inside words as letters, digits as one
    digit, runs of three and more of a letter as one, runs of marks as one.
    """
    raw = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(lines), dtype=np.int32), np.fromiter(map(len, lines), np.int64, len(lines)))
    codes = _CHARACTERS[raw]
    digit = (raw >= 48) & (raw < 58)
    letter = (codes >= 97) & ~digit
    beside = np.zeros(len(raw), bool)
    beside[1:] |= letter[:-1]
    before = beside.copy()
    beside[:-1] |= letter[1:]
    after = np.zeros(len(raw), bool)
    after[:-1] = letter[1:]
    sign = _INSIDE[raw]
    inside = (sign > 0) & np.where(digit, beside, before | after)
    # A sign at a word's end ("danger!") is punctuation unless the letter follows.
    inside &= digit | after
    codes = np.where(inside, sign, np.where(digit, np.uint32(48), codes))
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    third = np.zeros(len(codes), bool)
    third[2:] = same[2:] & same[1:-1]
    run = third.copy()  # all of a run of three or more but its first
    run[:-1] |= third[1:]
    run &= same
    drop = (codes == 0) | run | (same & ((codes == 1) | (codes == 2) | (codes == 48)))
    keep = ~drop
    offsets = np.zeros(len(lines) + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=len(lines)), out=offsets[1:])
    return codes[keep], offsets


def _position_tables() -> list[np.ndarray]:
    """For every place in a feature, a pseudorandom slot number of every character; a feature's slot is their exclusive or."""
    tables = []
    with np.errstate(over="ignore"):
        for place in range(LENGTH):
            x = np.arange(0x110000, dtype=np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (place + 1)) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            tables.append(((x ^ (x >> np.uint64(31))) & np.uint64(SLOTS - 1)).astype(np.int32))
    return tables


_PLACES = _position_tables()


def _slots(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each kind of gaps: the offset of a feature's last character, and the slot of the feature at every position.

    Kinds that begin with the same offsets share the work for them.
    """
    places = [table[codes] for table in _PLACES]
    begun = {(0,): places[0]}
    for offsets, _ in OFFSETS:
        for k in range(1, LENGTH):
            key, n = offsets[: k + 1], max(0, len(codes) - offsets[k])
            if key not in begun or k == LENGTH - 1:
                slot = begun[key[:-1]][:n] ^ places[k][offsets[k] : offsets[k] + n]
                if k < LENGTH - 1:
                    begun[key] = slot
        yield offsets[-1], slot


def _lengths(offsets: np.ndarray) -> np.ndarray:
    """The root of the sum of squared weights of each line's features, by which kernel values are scaled."""
    length = np.diff(offsets)
    count = sum(w * w * np.maximum(length - o[-1], 0) for o, w in OFFSETS)
    return np.sqrt(np.maximum(count, LEAST_POSITIONS * sum(w * w for _, w in OFFSETS)))


def _remaining(offsets: np.ndarray) -> np.ndarray:
    """At every position, how many characters its line still has, the one there included; at most 255."""
    length = np.diff(offsets)
    return np.minimum(np.repeat(offsets[1:], length) - np.arange(offsets[-1]), 255).astype(np.uint8)


def line_scores(lines: Sequence[str], table: np.ndarray) -> np.ndarray:
    """Every line's scaled dot product with a table of feature weights, a chunk of positions at a time."""
    codes, offsets = characters(lines)
    remaining = _remaining(offsets)
    total = np.zeros(len(codes), np.float32)
    for at in range(0, len(codes), CHUNK):
        own = total[at : at + CHUNK]
        left = remaining[at : at + CHUNK]
        # Features of the same reach have the same weight, so they are added up before it is applied.
        reach = {last: np.zeros(len(own), np.float32) for last in WEIGHTS}
        for last, slot in _slots(codes[at : at + CHUNK + SPAN]):
            n = min(len(own), len(slot))
            reach[last][:n] += table[slot[:n]]
        for last, value in reach.items():
            value *= np.float32(WEIGHTS[last])
            value *= left > last
            own += value
    sums = np.zeros(len(codes) + 1)
    np.cumsum(total, dtype=np.float64, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / _lengths(offsets)


class Features:
    """The features of many lines: slots and scaled values, weighted by the features' rarity among the lines."""

    def __init__(self, lines: Sequence[str]) -> None:
        codes, offsets = characters(lines)
        remaining = _remaining(offsets)
        slots, values, at = [], [], []
        for last, slot in _slots(codes):
            where = np.flatnonzero(remaining[: len(slot)] > last)
            slots.append(slot[where])
            values.append(np.full(len(where), WEIGHTS[last], np.float32))
            at.append(where.astype(np.int32))
        position = np.concatenate(at)
        order = np.argsort(position, kind="stable")
        self.n = len(lines)
        self.slot = np.concatenate(slots)[order]
        self.begin = np.searchsorted(position[order], offsets)
        seen = np.maximum(1, np.bincount(self.slot, minlength=SLOTS))
        self.rarity = np.clip(np.log(self.n / seen) / np.log(max(2, self.n)), 0.1, 1.0).astype(np.float32)
        scale = np.repeat(_lengths(offsets), np.diff(self.begin)).astype(np.float32)
        self.value = np.concatenate(values)[order] * self.rarity[self.slot] / scale

    def kernel(self, marks: np.ndarray, block: int = 128) -> np.ndarray:
        """Kernel values of all lines with the marked ones, a block of marks at a time; features of no mark are passed over."""
        of = [slice(self.begin[i], self.begin[i + 1]) for i in range(self.n)]
        used = np.unique(np.concatenate([self.slot[of[i]] for i in marks]))
        number = np.zeros(SLOTS, np.int32)
        number[used] = np.arange(1, len(used) + 1)
        known = number[self.slot]
        rows = []
        for own in of:
            kept = known[own] > 0
            rows.append((known[own][kept], self.value[own][kept]))
        out = np.zeros((self.n, len(marks)), np.float32)
        for at in range(0, len(marks), block):
            basis = np.zeros((len(used) + 1, len(marks[at : at + block])), np.float32)
            for j, i in enumerate(marks[at : at + block]):
                np.add.at(basis[:, j], known[of[i]], self.value[of[i]])
            for i, (features, values) in enumerate(rows):
                out[i, at : at + block] = values @ basis[features]
        return out

    def fold(self, marks: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """The table of feature weights that stands for the marks with the weights `alpha`."""
        table = np.zeros(SLOTS)
        for i, a in zip(marks, alpha):
            own = slice(self.begin[i], self.begin[i + 1])
            np.add.at(table, self.slot[own], a * self.value[own])
        return (table * self.rarity).astype(np.float32)


class Model:
    """Feature weights and the bias; a line scores above 0 if it lies on the harmful side of the margin's middle."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table, bias

    def lines(self, lines: Sequence[str]) -> np.ndarray:
        """Every line's score."""
        return line_scores(lines, self.table) + self.bias if len(lines) else np.zeros(0)

    def score(self, texts: Iterable[str | None]) -> list[float]:
        """The highest score of a text's lines; the lowest possible, -9, for a text without any."""
        all_lines: list[str] = []
        ends = [0]
        for text in texts:
            all_lines.extend(lines_of(text) if text else ())
            ends.append(len(all_lines))
        scores = np.maximum(self.lines(all_lines), -9.0)
        return [float(scores[a:b].max()) if b > a else -9.0 for a, b in zip(ends, ends[1:])]


def _ridge(z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted least squares with a penalty on the weights."""
    return np.linalg.solve(np.eye(z.shape[1]) * RIDGE + (z * weight[:, None]).T @ z, z.T @ (weight * target))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps over the violated margins; z ends with a constant column, hardly penalised."""
    w = np.zeros(z.shape[1])
    penalty = np.eye(z.shape[1])
    penalty[-1, -1] = 1e-3
    violated = np.ones(len(y), bool)
    for _ in range(rounds):
        zv, c = z[violated], cost[violated]
        w = np.linalg.solve(penalty + 2 * (zv * c[:, None]).T @ zv, 2 * zv.T @ (c * y[violated]))
        now = y * (z @ w) < 1
        if (now == violated).all():
            break
        violated = now
    return w


_LEAD = re.compile(r"^[^,.!?\n]{2,28}, ", re.M)
_NUMBER, _NAME = re.compile(r"\d+"), re.compile(r"(?<!^)\b[A-Z]\w+(?: [A-Z]\w+)*", re.M)


def signature(line: str) -> str:
    """A line without its numbers, names and a short lead before a comma, by which lines of the same form are told."""
    return _NAME.sub("N", _NUMBER.sub("0", _LEAD.sub("", line))).strip().lower()


def literal(line: str) -> str:
    """The longest part of a line that all lines of its form share, in lower case; empty below six characters."""
    parts = _NAME.split(_NUMBER.sub("\0", _LEAD.sub("", line)).replace("\0", "\n"))
    longest = max((piece.strip().lower() for part in parts for piece in part.split("\n")), key=len, default="")
    return longest if len(longest) >= 6 else ""


class FormCounter:
    """Counts in how many texts given forms stand: an automaton finds their literal parts, and the forms of a text's lines decide."""

    def __init__(self, examples: Iterable[str]) -> None:
        self.examples = list(examples)
        self.pieces: dict[str, str] = {}
        for line in self.examples:
            if piece := literal(line):
                self.pieces[signature(line)] = piece
        self.finder = ahocorasick.Automaton()
        for piece in self.pieces.values():
            self.finder.add_word(piece, True)
        self.finder.make_automaton()

    def count(self, texts: Iterable[str | None]) -> Counter[str]:
        """Texts that hold each form; forms without a literal part aren't counted."""
        counts: Counter[str] = Counter()
        for text in texts if self.pieces else ():
            if text and next(self.finder.iter(text.lower()), None):
                counts.update({f for x in lines_of(text) if (f := signature(x)) in self.pieces})
        return counts


class _Lines:
    """Forms of lines with an example of each, and in how many harmful and harmless documents they stand."""

    def __init__(self, forms: Sequence[str], example: dict[str, str], bad: Counter[str], good: Counter[str], upweight: np.ndarray) -> None:
        self.lines = [example[f] for f in forms] + list(HARMFUL) + list(HARMLESS)
        self.n = len(forms)
        known = np.arange(len(self.lines))
        self.seed_bad = (known >= self.n) & (known < self.n + len(HARMFUL))
        self.seed_good = known >= self.n + len(HARMFUL)
        self.bad = np.concatenate([[bad[f] for f in forms], np.ones(len(HARMFUL)), np.zeros(len(HARMLESS))])
        self.good = np.concatenate([[good[f] for f in forms], np.zeros(len(HARMFUL)), np.ones(len(HARMLESS))])
        self.upweight = np.concatenate([upweight, np.ones(len(HARMFUL) + len(HARMLESS))])

    def project(self, marks: np.ndarray) -> tuple[Features, np.ndarray, np.ndarray]:
        """Features, the map from kernel values with the marks to landmark space, and all lines there with a constant."""
        features = Features(self.lines)
        kernel = features.kernel(marks)
        eigen, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
        kept = eigen > 1e-3
        root = vectors[:, kept] / np.sqrt(eigen[kept])
        return features, root, np.hstack([kernel @ root, np.ones((len(self.lines), 1))])

    def first_fit(self, z: np.ndarray, balance: float) -> np.ndarray:
        """Weights by which a form scores the nearer to 1 the larger the share of harmful documents among its documents."""
        bad, good = balance * np.minimum(self.bad, MOST_COUNTED), np.minimum(self.good, MOST_COUNTED)
        return _ridge(z, (bad - good) / (bad + good), (bad + good) * self.upweight)


def _chance_forms(bad: np.ndarray, everywhere: np.ndarray, n_bad: int, n_texts: int) -> np.ndarray:
    """Which forms stand in harmful documents by chance, by how often they stand in the whole corpus; forms that weren't counted don't.

    If a form is harmful, all documents with it are harmful ones, and as many of
    them were labelled so as of any others; if it is not, hardly more than of all
    documents. The two rates are estimated from the forms themselves, as those of
    two Poisson distributions in a mixture (expectation-maximisation), and a form
    that the lower one makes clearly likelier is told. Where few forms are frequent, or the rates lie close
    together, nothing is told.
    """
    none = np.zeros(len(bad), bool)
    seen = np.maximum(everywhere, bad)
    told = (everywhere > 0) & (seen >= OFTEN)
    if told.sum() < LEAST_FORMS:
        return none
    high = min(1.0, EXCESS * n_bad / max(1, n_texts))
    low = high / 8
    for _ in range(50):
        odds = bad * np.log(high / low) - seen * (high - low)
        share = 1 / (1 + np.exp(-np.clip(odds[told], -50, 50)))
        high, low = (float((own * bad[told]).sum() + 0.01 * rate) / float((own * seen[told]).sum() + 0.01) for own, rate in ((share, high), (1 - share, low)))
        if high < 3 * low:
            return none
    return (everywhere > 0) & (odds < CLEARLY)


def train(texts: Sequence[str], harmful: Sequence[bool], seed: int = 5, corpus: Callable[[FormCounter], tuple[Counter[str], int]] | None = None) -> Model:
    """Learns from documents labelled as a whole, and from the labelled lines of `seeds`, each of which weighs as one label.

    Which lines make a document harmful isn't known, so it is learned too. Lines
    are taken together by their form (`signature`), and each form has its number
    of harmful and of harmless documents. A first fit predicts their shares: what
    both kinds share scores low however many harmful documents have it, and what
    resembles lines of several harmful documents and of no harmless one scores
    high. Then, in rounds, an SVM is trained: forms that more harmful than
    harmless documents hold and that score above the middle are harmful, forms
    that at least as many harmless ones hold and forms that score clearly below
    are harmless, the rest and rare harmless forms that score as harmful (probable
    errors of labelling) are left out.

    With few labels of a form that says little: in a large corpus many harmless
    forms stand in two or three harmful documents. `corpus` counts the suspects
    in all texts (a FormCounter's counts and the number of texts), and those
    that are too frequent for their harmful labels (`_chance_forms`) are harmless.

    A margin's violations decide an SVM, so of the harmless forms those that
    score highest among all are trained on, and others, weighted up, at random.
    Landmarks are the lines of harmful documents that score highest, and the
    hardest harmless ones. The middle of the margin, score 0, is the threshold:
    labels are on a sample richer in harmful documents than the corpus, so no
    threshold is fitted to their rate. Without labels the seeds alone are learned.
    """
    random = np.random.default_rng(seed)
    bad: Counter[str] = Counter()
    good: Counter[str] = Counter()
    example: dict[str, str] = {}
    n_bad = n_good = 0
    for text, is_bad in zip(texts, harmful):
        forms = {signature(x): x for x in lines_of(text)}
        (bad if is_bad else good).update(forms.keys())
        n_bad, n_good = n_bad + bool(is_bad), n_good + (not is_bad)
        for form, line in forms.items():
            if is_bad or form not in example:
                example[form] = line
    balance = max(1.0, n_good / max(1, n_bad) / 3)
    told, others = list(bad), [f for f in good if f not in bad]

    def chosen(hardest: list[str], rest: list[str], most: int) -> tuple[list[str], np.ndarray]:
        some = [rest[k] for k in random.permutation(len(rest))[:most]]
        more = len(rest) / max(1, len(some))
        return told + hardest + some, np.concatenate([np.ones(len(told) + len(hardest)), np.full(len(some), more)])

    # First pass: common harmless forms and some others.
    others.sort(key=lambda f: -good[f])
    forms, upweight = chosen(others[:ACTIVE // 4], others[ACTIVE // 4 :], ACTIVE)
    lines = _Lines(forms, example, bad, good, upweight)
    n = len(told)
    likely = np.argsort(-(lines.bad[:n] - lines.good[:n] / 10 + random.random(n) / 2), kind="stable")
    rest = n + random.permutation(len(forms) - n)
    seeds = lines.n + random.permutation(len(lines.lines) - lines.n)
    marks = np.unique(np.concatenate([likely[: LANDMARKS // 2], rest[:HARD], seeds[:64]])).astype(np.int64)
    features, root, z = lines.project(marks)
    w = lines.first_fit(z, balance)
    model = Model(features.fold(marks, root @ w[:-1]), float(w[-1]))

    # Second pass: the hardest of all harmless forms, and landmarks that matter.
    order = np.argsort(-model.lines([example[f] for f in others]), kind="stable")
    ranked = [others[k] for k in order]
    forms, upweight = chosen(ranked[:ACTIVE], ranked[ACTIVE:], ACTIVE)
    lines = _Lines(forms, example, bad, good, upweight)
    likely = np.argsort(-model.lines(lines.lines[:n]), kind="stable")
    rest = n + ACTIVE + random.permutation(max(0, len(forms) - n - ACTIVE))
    seeds = lines.n + random.permutation(len(lines.lines) - lines.n)
    hardest = np.arange(n, min(n + HARD, len(forms)))
    marks = np.unique(np.concatenate([likely[: LANDMARKS * 2 // 3], hardest, rest[:64], seeds[:64]])).astype(np.int64)
    features, root, z = lines.project(marks)
    w = lines.first_fit(z, balance)
    chance = np.zeros(len(lines.lines), bool)
    if corpus:
        suspects = np.flatnonzero((lines.bad > lines.good) & (z @ w > -0.2) & ~lines.seed_bad)
        counts, n_texts = corpus(FormCounter(lines.lines[k] for k in suspects))
        everywhere = np.array([counts.get(signature(lines.lines[k]), 0) for k in suspects], float)
        chance[suspects] = _chance_forms(lines.bad[suspects], everywhere, n_bad, n_texts)
    for turn in range(ROUNDS):
        s = z @ w
        is_bad = (lines.bad > lines.good) & (s > (-0.1 if turn == 0 else 0.0)) & ~lines.seed_good & ~chance | lines.seed_bad
        is_good = (s < -0.2) | chance | (lines.good >= np.maximum(lines.bad, 1)) & ~((lines.good <= 2) & (s > 0.5))
        y = np.where(is_bad, 1.0, np.where(is_good | lines.seed_good, -1.0, 0.0))
        weight = np.where(is_bad, np.minimum(lines.bad, 4.0), np.sqrt(np.minimum(lines.good + lines.bad, MOST_COUNTED)))
        rows = np.flatnonzero(y)
        w = _svm(z[rows], y[rows], COST * weight[rows])
    return Model(features.fold(marks, root @ w[:-1]), float(w[-1]))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text, harmful of at most `most` documents of each class, picked by a hash of their id (two top-n, no sorted group).

    Null labels are left out, and so are documents whose labels disagree, and null and empty texts.
    """
    agreed = (
        labels.where("harmful is not null and doc_id is not null").groupBy("doc_id")
        .agg(F.min("harmful").alias("harmful"), F.max("harmful").alias("other")).where("harmful = other").drop("other")
    )
    few = [agreed.where(F.col("harmful") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for value in (0, 1)]
    picked = few[0].union(few[1])
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text <> ''").select("doc_id", "text", (F.col("harmful") == 1).alias("harmful"))


def form_counts(documents: DataFrame, counter: FormCounter) -> tuple[Counter[str], int]:
    """How many texts hold each of the counter's forms, and the number of texts; one pass over all of them, one row per form is collected."""
    shared = documents.sparkSession.sparkContext.broadcast(counter.examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, n_texts = FormCounter(shared.value), Counter(), 0
        for batch in batches:
            n_texts += batch.num_rows
            counts += own.count(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.string()), pa.array([n_texts, *counts.values()], pa.int64())], ["form", "n"])

    found = documents.where("text <> ''").select("text").mapInArrow(run, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n")).collect()
    return Counter({r.form: r.n for r in found if r.form is not None}), sum(r.n for r in found if r.form is None)


def fit(documents: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """A model trained on the driver from a bounded sample of labelled documents: at most MOST_LABELLED of each class, whole texts of them, and counts of forms in all texts."""
    rows = sorted(labelled_sample(documents, labels).collect(), key=lambda r: r.doc_id)
    return train([r.text for r in rows], [r.harmful for r in rows], seed, lambda counter: form_counts(documents, counter))


def score_corpus(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, score, harmful of every document.

    The score is that of the most harmful line; harmful is score > 0. Null,
    empty and blank texts score -9. Whole texts are scored; there is no shuffle,
    and the model (a table of fixed size) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = np.array(own.score(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array(scores > 0)], ["doc_id", "source", "score", "harmful"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, score double, harmful boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Per source, the null source included: n_documents, n_harmful, rate."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("harmful"), 1)).alias("n_harmful")).withColumn("rate", F.col("n_harmful") / F.col("n_documents"))
