"""Normal forms of questions and document ids, however they are written."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Mapping

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсхуіѕјкмтвнαοειρτυκν", "aeopcxyisjkmtbhaoeiptukv")

# Words that frame a question or instruct the answerer without saying what is asked.
FRAME_WORDS = frozenset(
    """
    a an and any are as at be by can could do does for from has have i if in is it its me my no not of off on one only
    or please so that the there this to us we what when where which who whose why will with would you your
    according answer answers asked based belongs below brief briefly choose correct document english entry exact exactly
    file find following form from give given images in letter listed look looking missing need needed option phrase
    q question read recorded reply report reported respond review say shown shows short show single stated state tell
    text thanks thank unit using value's well word words zoom nbsp page's pages image using s t
    """.split()
)

_TAG = re.compile(r"<[^<>]*>")
_OPTIONS = re.compile(r"[\s;(\[]*(?<![a-z0-9])\(?a\s*[).:\]]\s*\S.*?(?<![a-z0-9])\(?b\s*[).:\]]\s", re.S)
_NUMBERED = re.compile(r"^\W*(?:question|q)?\s*(?:no\.?\s*)?\d+\s*[).:]\s*")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_PLACES = ("page", "table")
_EXTENSION = re.compile(r"\.[a-z]{2,5}$")


def plain(text: str) -> str:
    """Lower case without markup, accents, look-alike letters and width variants."""
    text = _TAG.sub(" ", html.unescape(text))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        text = unicodedata.normalize("NFKC", text).lower().translate(_LOOKALIKES)
    return text.lower()


def document_key(document_id: str | None) -> str:
    """A document id without folders, file extension, case and kind of separator; '' for none."""
    if document_id is None:
        return ""
    name = plain(document_id).strip().replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
    return re.sub(r"[^\w]+|_+", "_", _EXTENSION.sub("", name)).strip("_")


def near_word(a: str, b: str) -> bool:
    """Whether one slip (a letter more, less or other, or two swapped) leads from one word to the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, least = 0, min(len(a), len(b))
    while i < least and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Vocabulary:
    """Frequent words of a corpus, against which slips are recognised.

    `counts` maps each word to its number of questions. Look-ups of rare words
    are remembered, at most `memory` of them.
    """

    def __init__(self, counts: Mapping[str, int], memory: int = 200_000) -> None:
        self.counts = dict(counts)
        self.memory = memory
        self._by_letters: dict[str, list[str]] = {}
        for word in {*self.counts, *FRAME_WORDS, *_PLACES}:
            if len(word) >= 3:
                for key in self._keys(word):
                    self._by_letters.setdefault(key, []).append(word)
        self._long: dict[str, list[str]] = {}
        for word in self.counts:
            if len(word) >= 8:
                for key in self._shorter(word):
                    self._long.setdefault(key, []).append(word)
        self._seen: dict[str, frozenset[str]] = {}
        self._loose: dict[str, frozenset[str]] = {}

    @staticmethod
    def _keys(word: str) -> set[str]:
        """Words one slip apart share a key: a letter dropped, or the word itself."""
        return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}

    @classmethod
    def _shorter(cls, word: str) -> set[str]:
        """Words two slips apart share a key: at most two letters dropped."""
        return {k for key in cls._keys(word) for k in cls._keys(key)}

    def loose(self, word: str) -> frozenset[str]:
        """The long known words that lie within two slips of an unknown one."""
        if len(word) < 8 or not word.isalpha() or self.knows(word):
            return frozenset()
        found = self._loose.get(word)
        if found is None:
            if len(self._loose) >= self.memory:
                self._loose.clear()
            found = self._loose[word] = frozenset(w for w in {w for key in self._shorter(word) for w in self._long.get(key, ())} if two_slips(word, w))
        return found

    def fixed(self, word: str) -> bool:
        """Whether only the very same word can match this one in another question: names, numbers and places, but no known word and nothing that may be a slip of one."""
        return not (self.knows(word) or self.meant(word) or self.loose(word))

    def knows(self, word: str) -> bool:
        """Whether the word is frequent, a frame word or a place word."""
        return word in self.counts or word in FRAME_WORDS or word in _PLACES

    def meant(self, word: str) -> frozenset[str]:
        """The known words that a rare one may be a slip of; empty for known and very short words."""
        if word in self._seen:
            return self._seen[word]
        found: frozenset[str] = frozenset()
        if len(word) >= 3 and word.isalpha() and not self.knows(word):
            found = frozenset(w for key in self._keys(word) for w in self._by_letters.get(key, ()) if near_word(word, w))
        if len(self._seen) >= self.memory:
            self._seen.clear()
        self._seen[word] = found
        return found


def content(question: str | None, words: Vocabulary) -> list[str]:
    """What a question asks: its words in order without frame, options and instructions, slips put right.

    A slip with a single possible meaning is replaced; one with several stays.
    `page 7` and `table 7` are one token each. Null, blank and n/a give [].
    """
    if question is None:
        return []
    text = plain(question).strip()
    if text.strip(".!? ") in ("", "n/a", "na", "none", "null"):
        return []
    options = _OPTIONS.search(text)
    if options and options.start() > 0:
        text = text[: options.start()]
    tokens = _TOKEN.findall(_NUMBERED.sub("", text))
    out: list[str] = []
    i = 0
    while i < len(tokens):
        word = tokens[i]
        follows = i + 1 < len(tokens) and tokens[i + 1].isdigit()
        meant = words.meant(word)
        if follows and (word in _PLACES or meant & {*_PLACES}):
            place = word if word in _PLACES else min(meant & {*_PLACES})
            out.append(place + str(int(tokens[i + 1])))
            i += 2
            continue
        if meant:
            likely = meant - {*_PLACES}
            if len(likely) == 1:
                word = next(iter(likely))
            elif likely and likely <= FRAME_WORDS:
                word = ""
        if word and word not in FRAME_WORDS:
            out.append(str(int(word)) if word.isdecimal() and word.isascii() else word)
        i += 1
    return out


def two_slips(a: str, b: str) -> bool:
    """Whether at most two letters more, less or other, or swapped neighbours, lead from one long word to the other."""
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 2:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1] <= 2


def same_content(a: Iterable[str], b: Iterable[str], words: Vocabulary) -> bool:
    """Whether two contents ask the same: equal words in any order, but for slips.

    A left-over rare word matches a known word, or a rare word, with which it
    shares a meaning, and a known word of eight letters or more from which two
    slips lead to it; one that can be a slip of a frame word may match nothing.
    Two names, numbers, pages or properties never match each other.
    """
    left, right = list(a), []
    for word in b:
        if word in left:
            left.remove(word)
        else:
            right.append(word)
    for word in list(left):
        meant = words.meant(word)
        for other in right:
            rare = words.knows(word) + words.knows(other) == 1 and two_slips(word, other)
            if other in meant or word in words.meant(other) or meant & words.meant(other) or rare:
                left.remove(word)
                right.remove(other)
                break
    return all(words.meant(w) & FRAME_WORDS for w in left + right)
