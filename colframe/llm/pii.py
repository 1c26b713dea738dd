"""Operator 6: personal data by patterns and a linear-chain conditional random field.

Method: a CRF over a text's words with word-shape features of the word and its
two neighbours, trained here from a small labelled table written by hand
(``pii_table``) by gradient ascent on the regularised likelihood, decoded by
Viterbi in numpy batches.  Labels: none, and first or further word of an e-mail
address, IP address, card number, phone number or secret (a key, token or
password).  A word has a label other than none only if it has a digit or ``@``,
or stands by a bracketed "at" or "dot"; so decoding falls into independent runs
of such words, and only these are looked at, with the same result as over whole
texts.  A decoded span is kept if it passes the check of its kind and overlaps no
span of the patterns; the spans of the patterns always stay.  What the field adds
beside them: national phone numbers, addresses of IP version 6 and with
bracketed points, e-mail addresses that are spelled out or have a bare host,
cards with other separators, and secrets.

The patterns are read in time linear in the text, with the result of leftmost
non-overlapping matching.

Defined cases: NULL text: no spans; texts, words and gaps of any length are read
whole; spans that begin at one place stand in the order of their kinds; repeated
rows are read each; an empty table gives an empty table; other columns are not
read, and their names don't matter.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colframe.llm.common import documents, map_columns
from colframe.llm.pii_table import sentences

#: Kinds of the patterns, and that which the field alone finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Scored words that a task keeps, and the longest of them.
SHAPES_KEPT, LONGEST_KEPT = 200_000, 64

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.IGNORECASE)
_SPELLED = re.compile(r"[\[({](?:at|dot)[\])}]", re.IGNORECASE)
_BLANK = " \t\n\x0b\x0c\r"
_WORD_END = re.compile(r"[^\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        end = m.end() if start < at and (m := _DOMAIN.match(text, at + 1)) else at + 1
        if end > at + 1:
            out.append((start, end))
        last = end  # no address begins in what was read and isn't one: its run ends at this sign
        at = text.find("@", end)
    return out


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 12 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and _is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


# The model


_PUNCTUATION = ".,;:!?()<>\"'"


def shape(word: str) -> str:
    """A word's form: runs of digits of at most four, letters and other characters of one."""
    out, last, n = [], "", 0
    for c in word:
        k = "d" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c if c in "@.+-()[]/:=,%$#<>\"'_" else "o"
        n = n + 1 if k == last else 1
        last = k
        if n <= (4 if k == "d" else 1):
            out.append(k)
    return "".join(out)


def _size(n: int) -> int:
    return next((k for k in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 40) if n <= k), 99)


def features(word: str) -> list[str]:
    """Of a word's shape; of one of letters alone (with marks around) the word too."""
    core = word.strip(_PUNCTUATION)
    digits = sum("0" <= c <= "9" for c in core)
    upper, lower = any(c.isupper() for c in core), any(c.islower() for c in core)
    out = [
        "shape=" + shape(core), "ends=" + word[-1:] if word[-1:] in _PUNCTUATION else "ends=", f"digits={_size(digits)}", f"length={_size(len(core))}", f"at={'@' in core}", f"dots={min(core.count('.'), 4)}", f"colons={min(core.count(':'), 3)}",
        f"plus={word[:1] == '+'}", f"open={word[:1] == '('}", f"hyphens={min(core.count('-'), 3)}", f"mixed={digits > 0}{upper}{lower}", f"hex={bool(re.fullmatch('[0-9a-f]{20,}', core))}", f"spelled={bool(_SPELLED.search(word))}", f"points={'[.]' in word}",
    ]
    if digits == 0 and len(core) <= 16:
        out.append("word=" + core.lower())
    return out


def possible(words: list[str]) -> list[bool]:
    """Which words can have another label than none."""
    spelled = [bool(_SPELLED.search(w)) for w in words]
    near = lambda i: any(0 <= j < len(words) and spelled[j] for j in (i - 1, i, i + 1))
    return [bool(_MARK.search(w)) or near(i) for i, w in enumerate(words)]


class CRF:
    """Weights of features (by neighbour position) and of transitions; from label 0 before the first word."""

    def __init__(self, columns: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.columns, self.weights, self.moves = columns, weights, moves
        self.scores: dict[tuple[int, str], np.ndarray] = {}

    def score(self, at: int, word: str) -> np.ndarray:
        """What a word at -1, 0 or 1 from the labelled one adds to the label scores; by shape classes, so cached."""
        key = (at, word)
        found = self.scores.get(key)
        if found is None:
            ids = [i for f in (features(word) if word else ["edge"]) if (i := self.columns.get(f"{at}{f}")) is not None]
            found = self.weights[ids].sum(0)
            if len(word) <= LONGEST_KEPT:
                if len(self.scores) > SHAPES_KEPT:
                    self.scores.clear()
                self.scores[key] = found
        return found

    @classmethod
    def trained(cls, table: list[tuple[list[str], list[str]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> CRF:
        index = {x: i for i, x in enumerate(LABELS)}
        columns: dict[str, int] = {}
        length, n, k = max(len(w) for w, _ in table), len(table), len(LABELS)
        sparse, gold = [], np.zeros((n, length), np.int64)
        real, free = np.zeros((n, length), bool), np.zeros((n, length), bool)
        for i, (words, labels) in enumerate(table):
            can = possible(words)
            for t, y in enumerate(labels):
                gold[i, t], real[i, t], free[i, t] = index[y], True, can[t]
                for at in (-1, 0, 1):
                    w = words[t + at] if 0 <= t + at < len(words) else ""
                    sparse += [(i * length + t, columns.setdefault(f"{at}{f}", len(columns))) for f in (features(w) if w else ["edge"])]
        rows, cols = np.array(sparse).T
        used, first_of_row = np.unique(rows, return_index=True)
        by_column = np.argsort(cols, kind="stable")
        first_of_column = np.unique(cols[by_column], return_index=True)[1]
        weights, moves = np.zeros((len(columns), k)), np.zeros((k, k))
        shut = np.where(free[:, :, None] | (np.arange(k) == 0), 0.0, -1e9)
        truth = np.eye(k)[gold] * real[:, :, None]
        before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], 1)
        true_moves = np.zeros((k, k))
        np.add.at(true_moves, (before[real], gold[real]), 1)
        squares = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
        for _ in range(steps):
            emit = np.zeros((n * length, k))
            emit[used] = np.add.reduceat(weights[cols], first_of_row)
            emit = emit.reshape(n, length, k) + shut
            up = np.empty((n, length, k))
            for t in range(length):
                into = moves[0][None] if t == 0 else _sum_exp(up[:, t - 1, :, None] + moves, 1)
                up[:, t] = np.where(real[:, t, None], into + emit[:, t], up[:, t - 1] if t else 0)
            down = np.zeros((n, length, k))
            for t in range(length - 2, -1, -1):
                back = _sum_exp(moves[None] + (emit[:, t + 1] + down[:, t + 1])[:, None, :], 2)
                down[:, t] = np.where(real[:, t + 1, None], back, 0)
            total = _sum_exp(up[:, -1], 1)[:, None]
            node = np.exp(up + down - total[:, None]) * real[:, :, None]
            pair = np.exp(up[:, :-1, :, None] + moves + (emit[:, 1:] + down[:, 1:])[:, :, None, :] - total[:, None, None]) * real[:, 1:, None, None]
            slope = np.add.reduceat((truth - node).reshape(-1, k)[rows[by_column]], first_of_column)
            slope_moves = true_moves - pair.sum((0, 1))
            slope_moves[0] -= node[:, 0].sum(0)
            for value, s, q in ((weights, slope - decay * n * weights, squares[0]), (moves, slope_moves - decay * n * moves, squares[1])):
                q += s * s
                value += rate * s / np.sqrt(q)
        return cls(columns, weights, moves)

    def decode(self, runs: list[tuple[str, list[str], str]]) -> list[np.ndarray]:
        """Labels of runs of words, each between the word before it and the one after, by Viterbi in batches of equal length."""
        out: list = [None] * len(runs)
        by_length: dict[int, list[int]] = {}
        for i, (_, words, _) in enumerate(runs):
            by_length.setdefault(len(words), []).append(i)
        for length, members in by_length.items():
            for lo in range(0, len(members), max(1, 65536 // length)):
                some = members[lo : lo + max(1, 65536 // length)]
                emit = np.array([[self.score(-1, w[t - 1] if t else a) + self.score(0, w[t]) + self.score(1, w[t + 1] if t + 1 < length else b) for t in range(length)] for a, w, b in (runs[i] for i in some)])
                best = self.moves[0] + emit[:, 0]
                came = np.zeros((length, len(some), len(LABELS)), np.int8)
                for t in range(1, length):
                    ways = best[:, :, None] + self.moves
                    came[t] = ways.argmax(1)
                    best = ways.max(1) + emit[:, t]
                label = (best + self.moves[:, 0]).argmax(1)
                path = np.empty((len(some), length), np.int8)
                for t in range(length - 1, -1, -1):
                    path[:, t] = label
                    label = came[t][np.arange(len(some)), label]
                for i, p in zip(some, path):
                    out[i] = p
        return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@lru_cache(maxsize=1)
def model() -> CRF:
    """The field trained from the labelled table."""
    return CRF.trained(sentences())


def _word_before(text: str, at: int) -> tuple[int, int]:
    while at and text[at - 1] in _BLANK:
        at -= 1
    end = at
    while at and text[at - 1] not in _BLANK:
        at -= 1
    return at, end


def _word_after(text: str, at: int) -> tuple[int, int]:
    n = len(text)
    while at < n and text[at] in _BLANK:
        at += 1
    return at, _WORD_END.match(text, at).end()


def runs_of(text: str) -> list[tuple[str, list[str], str, list[int]]]:
    """Maximal runs of possible words: the word before, the words, the word after, the words' positions."""
    found: list[tuple[int, int]] = []
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start and text[start - 1] not in _BLANK:
            start -= 1
        end = _WORD_END.match(text, m.start()).end()
        spelled = _SPELLED.search(text, start, end)
        before = _word_before(text, start) if spelled else (0, 0)
        if before[0] < before[1] and (not found or found[-1][0] < before[0]):
            found.append(before)
        if not found or found[-1][0] < start:
            found.append((start, end))
        if spelled and (after := _word_after(text, end))[0] < after[1]:
            found.append(after)
            # it may have marks too: the search goes on from its beginning, and passes it over as found
            end = after[0] if _SPELLED.search(text, *after) else after[1]
        m = _MARK.search(text, end)
    out: list[tuple[str, list[str], str, list[int]]] = []
    last = -1
    for start, end in found:
        if out and not text[last:start].strip(_BLANK):
            out[-1][1].append(text[start:end])
            out[-1][3].append(start)
        else:
            out.append((text[slice(*_word_before(text, start))], [text[start:end]], "", [start]))
        last = end
        out[-1] = (*out[-1][:2], text[slice(*_word_after(text, end))], out[-1][3])
    return out


def _spelled_out(s: str) -> str:
    return re.sub(r"\s*[\[({]dot[\])}]\s*", ".", re.sub(r"\s*[\[({]at[\])}]\s*", "@", s, flags=re.IGNORECASE), flags=re.IGNORECASE)


def _is_address(s: str) -> bool:
    try:
        ipaddress.ip_address(s.replace("[.]", "."))
        return True
    except ValueError:
        return False


def _passes(kind: int, s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        return bool(re.fullmatch(r"[^@\s]+@[A-Za-z0-9.-]*[A-Za-z0-9]", _spelled_out(s)))
    if kind == 1:
        return _is_address(s)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and len(s) <= 2 * len(digits)
    if kind == 3:
        return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", s))
    return len(s) >= 8 and bool(digits) and bool(re.search("[A-Za-z]", s)) and not re.search(r"\s", s)


#: What secrets are assigned with: it isn't part of them.
_ASSIGNED = re.compile(r"""^[A-Za-z_.-]*[:=]["']?""")


def added_spans(texts: list[str], crf: CRF, taken: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the field finds beside the spans taken, for each text."""
    runs = [(i, r) for i, t in enumerate(texts) for r in runs_of(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, (_, words, _, starts)), labels in zip(runs, crf.decode([r[:3] for _, r in runs])):
        t = 0
        while t < len(words):
            if not labels[t]:
                t += 1
                continue
            kind, first = (int(labels[t]) - 1) // 2, t
            t += 1
            while t < len(words) and labels[t] == 2 * kind + 2:
                t += 1
            start, end = starts[first], starts[t - 1] + len(words[t - 1])
            s = texts[i][start:end]
            left = len(s) - len(s.lstrip("<[\"'" + ("" if kind == 3 else "(")))
            if kind == 4:
                m = _ASSIGNED.match(s, left)
                left = m.end() if m else left
            s = s[left:].rstrip(".,;:?>])\"'" + ("" if kind == 4 else "!"))
            span = (start + left, kind, start + left + len(s))
            if _passes(kind, s) and all(span[2] <= a or b <= span[0] for a, _, b in taken[i]):
                out[i].append(span)
    return out


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans with how many are the field's, for every row."""
    crf = model()
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, crf, base)
            out: dict = {f"n_{k}": [sum(x[1] == i for x in b) for b in base] for i, k in enumerate(BASE_KINDS)}
            return out | {key: batch.column(0), "base_sha256": [hashlib.sha256(written_spans(b).encode()).hexdigest() for b in base], "spans": [written_spans(b + m) for b, m in zip(base, more)], "n_added": [len(m) for m in more], "n_spans": [len(b) + len(m) for b, m in zip(base, more)]}

        return step

    return map_columns(df.select(key, text), schema, make)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return spans(documents(spark, sf_dir))
