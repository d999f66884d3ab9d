"""Statistics of a batch of documents as a numpy matrix, one row a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from prescient.llm.common import mix64, text_buffer, word_hashes, word_spans

#: Names of the statistics, in column order.
NAMES = (
    "bytes", "words", "lines", "mean_word", "max_word", "long_words", "one_byte_words",
    "distinct_words", "repeated_pairs", "mean_line", "max_line", "short_lines", "repeated_lines",
    "repeated_line_bytes", "closed_lines", "upper", "lower", "digit", "high", "space",
    "stop", "comma", "bang", "dash", "symbol", "bracket", "slash", "entropy", "top_byte",
    "capital_words", "shouted_words", "digit_words", "symbol_words", "run_bytes",
    "words_per_stop", "pipe",
)


def _set(*chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in "".join(chars)]] = 1
    return out


_UPPER, _LOWER, _DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), \
    _set("abcdefghijklmnopqrstuvwxyz"), _set("0123456789")
_HIGH = np.concatenate([np.zeros(128), np.ones(128)])
_SPACE, _STOP, _COMMA, _BANG = _set(" \t\n\r\x0b\x0c"), _set(".?"), _set(",;:"), _set("!")
_DASH, _SYMBOL = _set("-_"), _set("#$%&*+@^~=<>\\`")
_BRACKET, _SLASH, _PIPE = _set("()[]{}\"'"), _set("/"), _set("|")


def _per(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)


def _repeated(key: np.ndarray, row: np.ndarray, n: int, weight=None) -> np.ndarray:
    """For each document, how many (or how much weight) of its keys occurred before."""
    both = mix64(key + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    again = np.zeros(key.size)
    again[order[1:]] = both[order][1:] == both[order][:-1]
    return _per(again if weight is None else again * weight, row, n)


def statistics(text: pa.Array) -> np.ndarray:
    """float32 matrix (documents x NAMES); empty and null texts give zeros."""
    raw, offsets = text_buffer(text)
    n = len(text)
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    histogram = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
    share = histogram / np.maximum(size, 1)[:, None]
    out = {"bytes": np.log1p(size)}
    for name, chars in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("high", _HIGH),
                        ("space", _SPACE), ("stop", _STOP), ("comma", _COMMA), ("bang", _BANG),
                        ("dash", _DASH), ("symbol", _SYMBOL), ("bracket", _BRACKET),
                        ("slash", _SLASH), ("pipe", _PIPE)):
        out[name] = share @ chars
    out["entropy"] = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    out["top_byte"] = share.max(axis=1)
    same = np.zeros(raw.size)
    same[1:] = (raw[1:] == raw[:-1]) & (row[1:] == row[:-1])
    out["run_bytes"] = _per(same, row, n) / np.maximum(size, 1)

    start, end, _ = word_spans(raw, offsets)
    hashes, words = word_hashes(raw, offsets)
    at = np.repeat(np.arange(n), words)
    length = (end - start).astype(float)
    some = np.maximum(words, 1)
    kind = (_UPPER + 2 * _LOWER + 4 * _DIGIT + 8 * (1 - _UPPER - _LOWER - _DIGIT - _HIGH - _SPACE)
            ).astype(np.uint8)
    first = kind[raw[start]]
    counted = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    upper = counted[end] - counted[start]
    counted = np.concatenate([[0], np.cumsum(kind[raw] == 8)])
    marks = counted[end] - counted[start]
    out["words"] = np.log1p(words)
    out["mean_word"] = _per(length, at, n) / some
    longest = np.zeros(n)
    np.maximum.at(longest, at, length)
    out["max_word"] = np.log1p(longest)
    out["long_words"] = _per(length > 15, at, n) / some
    out["one_byte_words"] = _per(length == 1, at, n) / some
    out["distinct_words"] = 1 - _repeated(hashes, at, n) / some
    pair = mix64(hashes[:-1]) + hashes[1:]
    inside = at[1:] == at[:-1]
    out["repeated_pairs"] = _repeated(pair[inside], at[1:][inside], n) / some
    out["capital_words"] = _per(first == 1, at, n) / some
    out["shouted_words"] = _per((upper >= 2) & (upper * 2 >= length), at, n) / some
    out["digit_words"] = _per(first == 4, at, n) / some
    out["symbol_words"] = _per(marks >= 2, at, n) / some
    out["words_per_stop"] = np.log1p(words / (histogram @ _STOP + 1))

    # Lines: cut at line feeds and at document borders.
    border = np.zeros(raw.size + 1, dtype=bool)
    border[offsets] = True
    border[1:] |= np.append(raw, 0)[:-1] == 10 if raw.size else False
    cut = np.flatnonzero(border)
    lo, hi = cut[:-1], cut[1:]
    line_at = row[lo] if raw.size else np.zeros(0, dtype=np.int64)
    line = (hi - lo).astype(float)
    lines = np.bincount(line_at, minlength=n)
    some_lines = np.maximum(lines, 1)
    data = raw.tobytes()
    key = np.array([hash(data[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)],
                   dtype=np.int64).view(np.uint64)
    out["lines"] = np.log1p(lines)
    out["mean_line"] = np.log1p(_per(line, line_at, n) / some_lines)
    longest = np.zeros(n)
    np.maximum.at(longest, line_at, line)
    out["max_line"] = np.log1p(longest)
    out["short_lines"] = _per(line < 30, line_at, n) / some_lines
    out["repeated_lines"] = _repeated(key, line_at, n) / some_lines
    out["repeated_line_bytes"] = _repeated(key, line_at, n, line) / np.maximum(size, 1)
    back = np.maximum(hi - 1 - (raw[hi - 1] == 10), lo) if raw.size else hi
    closed = np.isin(raw[back], [ord(c) for c in ".!?:;"]) if raw.size else np.zeros(0)
    out["closed_lines"] = _per(closed, line_at, n) / some_lines
    return np.column_stack([out[k] for k in NAMES]).astype(np.float32)
