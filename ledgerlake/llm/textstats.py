"""Statistics of one whole text, for the quality operators. Plain helpers of Arrow batch functions."""

from __future__ import annotations

from collections import Counter

import numpy as np

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def word_bounds(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by spaces, with the byte offsets at which each begins and ends."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.empty_like(ends)
    if len(words):
        begins[0], begins[1:] = 0, ends[:-1] + 1
    return joined, begins, ends


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first place included."""
    if len(words) <= window:
        return 0
    joined, begins, ends = word_bounds(words)
    windows = [joined[b:e] for b, e in zip(begins[:len(words) - window + 1].tolist(), ends[window - 1:].tolist())]
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if often[w] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def basic(text: str, words: list[bytes] | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split() if words is None else words  # bytes split at ASCII white space only
    chars = len(text) - sum(map(text.count, BLANK))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


FEATURES = ("log_words", "word_length", "symbols", "repeated_lines", "repeated_words", "upper", "digits",
            "punctuation", "marks_of_excitement", "distinct_words", "sentence_length", "line_length",
            "top_word", "letter_entropy", "long_words", "non_ascii")


def features(text: str) -> tuple[float, ...]:
    """A vector of shape statistics (``FEATURES``); an empty text has zeros only."""
    data = text.encode()
    words = data.split()
    n, chars, symbols, dup, repeat = basic(text, words)
    if not n:
        return (0.0,) * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    digits, high = int(count[48:58].sum()), int(count[128:].sum())
    stops = int(count[[33, 46, 63]].sum())
    letters = count[97:123] + count[65:91]
    share = letters[letters > 0] / max(1, letters.sum())
    often = Counter(words)
    lines = sum(1 for x in text.split("\n") if x.strip(BLANK))
    return (float(np.log1p(n)), chars / n, symbols / chars, dup / lines, repeat / n,
            upper / max(1, upper + lower), digits / chars, int(count[[44, 58, 59, 45, 39, 34]].sum()) / chars,
            int(count[33]) / chars, len(often) / n ** 0.8, float(np.log1p(n / max(1, stops))),
            float(np.log1p(n / lines)), max(often.values()) / n, float(-(share * np.log(share)).sum()),
            sum(1 for w in often if len(w) > 15) / len(often), high / len(data))
