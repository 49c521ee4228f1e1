"""Noisy-channel restoration of disguised words.

The channel swaps letters for look-alikes, puts marks or spaces between letters and
repeats letters. A look-alike at an end of a word may be a letter or a mark, and two
letters alike may be one. A disguised word becomes a lattice of readings; the Viterbi path
under channel costs and the character language model is the restored word.
"""

from __future__ import annotations

import re

import numpy as np

from lotwise.llm import char_model
from lotwise.llm.char_model import CharModel

# What look-alikes may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}

SWAP = -2.5  # log-probabilities of the channel
DROP = -1.5
MASK = -3.5
SINGLE = -6.5  # of two letters as one: most doubled letters are meant, and the model likes short words

_ENDS = re.compile(r"^[^\w$@]+|[^\w$@]+$|([$@])\1{2,}$|_+$|^_+")
_LETTER = re.compile(r"[^\W\d_]")
_SUSPECT = re.compile(r"[\d@$!|+(€£*]|[^\w]|_|([^\W\d_])\1\1")
_RUNS = re.compile(r"(.)\1*", re.S)
_DOUBLE = re.compile(r"([^\W\d_])\1")
_END_MARKS = "!|+(€£*"  # look-alikes that ``core`` takes off


def core(word: str) -> str:
    """A lower-case word without the marks around it."""
    word = word.lower()
    if word.isalpha():
        return word
    before = None
    while before != word:
        before, word = word, _ENDS.sub("", word)
    return word


def is_disguised(word: str) -> bool:
    """Whether a word has letters together with look-alikes, inner marks or letters three times in a row."""
    return _SUSPECT.search(word) is not None and _LETTER.search(word) is not None


def with_end_marks(word: str) -> str:
    """The core of a word with the look-alikes right before and after it; empty without a core."""
    word, inner = word.lower(), core(word)
    if not inner or len(inner) == len(word):
        return inner
    at = word.find(inner)
    before, after = word[:at], word[at + len(inner) :]
    return before[len(before.rstrip(_END_MARKS)) :] + inner + after[: len(after) - len(after.lstrip(_END_MARKS))]


def is_doubtful(text: str) -> bool:
    """Whether a word that isn't disguised otherwise has look-alikes at its ends or two letters alike."""
    ends = text[:1] in _END_MARKS or text[-1:] in _END_MARKS
    return (ends or _DOUBLE.search(text) is not None) and _LETTER.search(text) is not None


def readings(text: str) -> list[list[tuple[str, float]]]:
    """Lattice: for each run of one character what it may stand for and the cost."""
    out = []
    for found in _RUNS.finditer(text):
        run, mark = found.group(0), found.group(1)
        if mark == " ":
            out.append([(" ", 0.0), ("", DROP)])
        elif _LETTER.match(mark):
            if len(run) == 2:
                out.append([(run, 0.0), (mark, SINGLE)])
            else:
                out.append([(run, 0.0)] if len(run) < 2 else [(mark, DROP), (mark * 2, DROP)])
        else:
            options = [(run, 0.0)]
            if not mark.isdigit():
                at_end = mark in _END_MARKS and (found.start() == 0 or found.end() == len(text))
                options.append(("", 0.0 if at_end else DROP))
            cost = MASK if mark == "*" else SWAP
            options += [(letter * min(len(run), 2), cost) for letter in LOOK_ALIKES.get(mark, "")]
            out.append(options)
    return out


class Restorer:
    """Viterbi decoding under one language model (counted with folded case)."""

    def __init__(self, model: CharModel):
        self.model = model
        self.kinds: dict[str, int] = {}
        self.costs: dict[int, float] = {}

    def _kind(self, letter: str) -> int:
        kind = self.kinds.get(letter)
        if kind is None:
            kind = int(char_model.classes(np.array([ord(letter)], np.uint32), True)[0])
            self.kinds[letter] = kind
        return kind

    def _cost(self, packed: int) -> float:
        cost = self.costs.get(packed)
        if cost is None:
            cost = float(self.model.log_prob(np.array([packed], np.uint32))[0])
            self.costs[packed] = cost
        return cost

    def _step(self, context: int, letter: str) -> tuple[int, float]:
        """Context after a letter, and the letter's cost; a space ends the word."""
        keep = char_model._MASK[char_model.ORDER - 1]
        if letter == " ":
            start = sum(char_model.BOUNDARY << (char_model.BITS * k) for k in range(char_model.ORDER - 1))
            return start, self._cost(context << char_model.BITS | char_model.BOUNDARY)
        packed = context << char_model.BITS | self._kind(letter)
        return packed & keep, self._cost(packed)

    def restore(self, text: str) -> str:
        """Most probable reading of a lower-case disguised word or spaced run of letters."""
        start = sum(char_model.BOUNDARY << (char_model.BITS * k) for k in range(char_model.ORDER - 1))
        # By context: log-probability and the path as linked pairs, so a step is constant work.
        paths: dict[int, tuple[float, tuple | None]] = {start: (0.0, None)}
        for options in readings(text):
            after: dict[int, tuple[float, tuple | None]] = {}
            for context, (score, path) in paths.items():
                for letters, cost in options:
                    at, total = context, score + cost
                    for letter in letters:
                        at, more = self._step(at, letter)
                        total += more
                    if at not in after or total > after[at][0]:
                        after[at] = (total, (path, letters) if letters else path)
            paths = after
        _, path = max(
            ((score + self._step(context, " ")[1], path) for context, (score, path) in paths.items()),
            key=lambda x: x[0],
        )
        letters = []
        while path is not None:
            path, last = path
            letters.append(last)
        return "".join(reversed(letters))
