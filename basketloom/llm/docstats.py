"""Per-document statistics, computed for whole blocks of texts at once."""

from __future__ import annotations

import numpy as np

from .textblocks import Block, gram_fits, gram_hashes, mix

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, np.int8)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int8)
_DIGIT[48:58] = 1
_ALPHA = np.zeros(256, np.int8)
_ALPHA[65:91] = _ALPHA[97:123] = 1
_ALPHA[0xC0:] = 1  # the first byte of a longer character stands for a letter
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,;:!?"]] = True
_HEAD = np.ones(256, np.int8)
_HEAD[0x80:0xC0] = 0

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_chars", "n_lines", "n_alpha", "n_upper", "n_digits", "n_exclaim", "n_pipe", "n_at", "n_closed_words", "n_distinct_words", "n_long_words", "n_one_char_words", "n_alpha_words", "n_same_next", "max_word_chars", "n_symbol_words")


def _repeats(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each entry whether its key occurs more than once in its document."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _distinct(doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each document."""
    _, first = np.unique(keys, return_index=True)
    return np.bincount(doc[first], minlength=n)


def base_stats(b: Block) -> dict[str, np.ndarray]:
    """The counts named in BASE, as int64 arrays with one entry for each text of the block."""
    doc = b.word_doc()
    salt = mix(np.arange(b.n, dtype=np.uint64))
    out = {"n_words": b.n_words.astype(np.int64), "word_chars": b.per_text(b.solid & _HEAD[b.data].astype(bool)), "n_symbols": b.per_text(_SYMBOL[b.data])}

    # Lines: they end at \n or with their text.
    ends = np.flatnonzero(b.data == 10)
    starts = np.unique(np.concatenate([b.offs[:-1], ends + 1]))
    starts = starts[starts < len(b.data)]
    stops = np.searchsorted(ends, starts)
    line_doc = np.searchsorted(b.offs, starts, side="right") - 1
    stop = np.minimum(np.append(ends, len(b.data))[stops], b.offs[line_doc + 1])
    full = np.searchsorted(b.ws, starts) < np.searchsorted(b.ws, stop)
    starts, stop, line_doc = starts[full], stop[full], line_doc[full]
    lines = np.bincount(line_doc, minlength=b.n)
    keys = b.span_hash(starts, stop) ^ salt[line_doc]
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - _distinct(line_doc, keys, b.n)

    words = b.word_hashes()
    out["_words"] = words
    covered = np.zeros(len(words), bool)
    fits = np.flatnonzero(gram_fits(b, 3))
    if len(fits):
        twice = fits[_repeats(doc[fits], gram_hashes(words, 3)[fits] ^ salt[doc[fits]])]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=b.n)
    return out


def all_stats(b: Block) -> dict[str, np.ndarray]:
    """BASE and EXTRA."""
    out, doc = base_stats(b), b.word_doc()
    words = out["_words"]
    salt = mix(np.arange(b.n, dtype=np.uint64))
    head = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(_HEAD[b.data], out=head[1:])
    length = head[b.we] - head[b.ws]
    alpha = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(_ALPHA[b.data], out=alpha[1:])
    symbols = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(_SYMBOL[b.data], out=symbols[1:])
    out |= {
        "n_chars": head[b.offs[1:]] - head[b.offs[:-1]],
        "n_alpha": alpha[b.offs[1:]] - alpha[b.offs[:-1]],
        "n_upper": b.per_text(_UPPER[b.data]),
        "n_digits": b.per_text(_DIGIT[b.data]),
        "n_exclaim": b.per_text(b.data == 33),
        "n_pipe": b.per_text(b.data == 124),
        "n_at": b.per_text(b.data == 64),
        "n_closed_words": np.bincount(doc[_CLOSING[b.data[b.we - 1]]], minlength=b.n),
        "n_distinct_words": _distinct(doc, words ^ salt[doc], b.n),
        "n_long_words": np.bincount(doc[length > 15], minlength=b.n),
        "n_one_char_words": np.bincount(doc[length == 1], minlength=b.n),
        "n_alpha_words": np.bincount(doc[alpha[b.we] > alpha[b.ws]], minlength=b.n),
        "n_same_next": np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=b.n),
        "n_symbol_words": np.bincount(doc[symbols[b.we] > symbols[b.ws]], minlength=b.n),
    }
    longest = np.zeros(b.n, np.int64)
    np.maximum.at(longest, doc, length)
    return out | {"max_word_chars": longest}
