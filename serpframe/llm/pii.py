"""Personal data by candidate gradient boosting (operator 8).

Base spans are exact rules for e-mail, IP address, payment card and phone
number. High-recall generators propose further, overlapping spans: obfuscated
e-mail addresses, IPv6 (whole and compressed) and, in every run of digit groups
with separators, each stretch of whole groups that has 7 to 19 digits: as a
phone number up to 15, as a card from 12. Boosted trees score each candidate
from its format, from the groups beside it and from the words before it;
candidates above a threshold calibrated for precision become spans of their
kind unless they overlap a base span or a likelier one.

The trees are trained on examples made by rule: personal data in many writings
and look-alikes (dates, versions, prices, ids, decimals, hashes), in sentences
with and without cue words. No corpus row is needed to train them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.llm.boosting import Booster
from serpframe.llm.tables import appended, free_name, named

KINDS = ("email", "ip", "card", "phone")

# Base rules, written so that each runs in time linear in the text: a match
# that fails at the start of its first run fails within it too.
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Generators of candidates.
_AT_MARKS = ("at)", "at]", "at}", "AT)", "AT]", "AT}")
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}"
                 r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,5}", re.I)
_RUN = re.compile(r"(?<![0-9])\(?[0-9](?:[ ().\-/_:]{0,2}[0-9])++")
_V6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_V6_SHORT = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::"
                       r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])")
_DIGITS = re.compile("[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")
_SIGNS = " -.(/:_"
_SCORED = 50_000  # candidates scored at a time
_CUES = tuple(re.compile(p, re.I) for p in (
    r"\b(?:e-?mail|mail|write to)\b", r"\b(?:ip|host|server|address|login from)\b",
    r"\b(?:card|visa|mastercard|credit|payment|iban)\b", r"\b(?:phone|tel|telephone|call|mobile|fax|dial|contact)\b",
    r"\b(?:version|order|invoice|page|build|id|ref|isbn|price|total|date)\b"))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind and start; code points."""
    out: list[tuple[int, int, int]] = []
    last = 0
    if "@" in text:
        for m in _HOST.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the generators propose; spans may overlap and repeat."""
    out = []
    if any(mark in text for mark in _AT_MARKS):
        out += [(0, m.start(), m.end()) for m in _AT.finditer(text)]
    if ":" in text:
        out += [(1, m.start(), m.end()) for m in _V6.finditer(text)]
        out += [(1, m.start(), m.end()) for m in _V6_SHORT.finditer(text)
                if 1 <= len(re.findall("[0-9A-Fa-f]+", m.group())) <= 7]
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 7:
            out += _stretches(text, m.start(), m.end())
    return out


def _stretches(text: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """Stretches of whole digit groups of the run ``text[a:b]`` with 7 to 19 digits, as cards, phone numbers or both."""
    out = []
    groups = [m.span() for m in _DIGITS.finditer(text, a, b)]
    for i, (start, _) in enumerate(groups):
        # an opening bracket and a plus belong to the number
        start -= text[start - 1:start] == "("
        start -= text[start - 1:start] == "+"
        digits = 0
        for lo, hi in groups[i:i + 19]:
            digits += hi - lo
            if digits > 19:
                break
            if digits >= 12:
                out.append((2, start, hi))
            if 7 <= digits <= 15:
                out.append((3, start, hi))
    return out


def describe(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Format and context features of candidates."""
    kind, a, b = np.array(spans, np.int64).reshape(-1, 3).T
    shift = max(0, int(a.min(initial=0)) - 40)
    part = text[shift:int(b.max(initial=0)) + 40]
    a, b = a - shift, b - shift
    code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((code >= 48) & (code <= 57))  # places of the digits
    digit = code[at].astype(np.int64) - 48
    lo, hi = np.searchsorted(at, a), np.searchsorted(at, b)
    n = hi - lo
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = np.diff(at) > 1
    first = np.flatnonzero(new)  # first digit of each group, and the end
    group = np.searchsorted(first, lo, side="right") - 1
    n_groups = np.where(n > 0, np.searchsorted(first, hi, side="left") - group, 0)
    longest, shortest = np.zeros(len(n), np.int64), np.full(len(n), 99)
    head, tail = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for k in range(int(n_groups.max(initial=0))):
        mine = np.flatnonzero(n_groups > k)
        g = group[mine] + k
        size = np.minimum(first[g + 1], hi[mine]) - np.maximum(first[g], lo[mine])
        longest[mine], shortest[mine] = np.maximum(longest[mine], size), np.minimum(shortest[mine], size)
        tail[mine] = size
        if k == 0:
            head[mine] = size
    shortest[n_groups == 0] = 0
    # check sums from running sums: which digits count twice depends on where the number ends
    twice = np.where(digit > 4, digit * 2 - 9, digit * 2)
    odd = np.arange(len(digit)) % 2 == 1
    sums = np.zeros((2, len(digit) + 1), np.int64)
    sums[0, 1:], sums[1, 1:] = np.cumsum(np.where(odd, twice, digit)), np.cumsum(np.where(odd, digit, twice))
    plain = np.maximum(hi - 1, 0) % 2
    passes = (n >= 12) & ((sums[plain, hi] - sums[plain, lo]) % 10 == 0)
    kinds = np.zeros(len(n), np.int64)
    for v in range(10):
        where = np.flatnonzero(digit == v)
        kinds += np.searchsorted(where, hi) > np.searchsorted(where, lo)
    signs = [np.searchsorted(w, b) - np.searchsorted(w, a) for w in (np.flatnonzero(code == ord(c)) for c in _SIGNS)]
    letters = np.flatnonzero(((code >= 65) & (code <= 70)) | ((code >= 97) & (code <= 102)))
    # groups beside the span, as far as the same run goes on
    places = np.concatenate([[-99], at, [len(code) + 99]])
    left, right = np.minimum(a - places[lo], 4), np.minimum(places[hi + 1] - b + 1, 4)
    ends = np.concatenate([first, [first[-1]]])
    last_group = np.searchsorted(first, hi, side="left")  # the one after the span
    left_size = np.where(left < 4, np.minimum(lo - first[np.maximum(group - 1, 0)], 20), 0)
    right_size = np.where(right < 4, np.minimum(ends[np.minimum(last_group + 1, len(first))] - hi, 20), 0)
    fore, aft = [], []
    starts, which = np.unique(a, return_inverse=True)
    for x in starts.tolist():
        c, near = part[max(0, x - 1):x], part[max(0, x - 30):x]
        cues = [bool(p.search(near)) for p in _CUES] if _LETTER.search(near) else [False] * len(_CUES)
        fore.append([c.isalnum() or c != "" and c in "_-+.$#,", c == "+" or part[x] == "+", c != "" and c in "#vV$€",
                     c != "" and c in "-./:_", *cues])
    ends_at, to = np.unique(b, return_inverse=True)
    for x in ends_at.tolist():
        c = part[x:x + 1]
        aft.append([c.isalnum() or c != "" and c in "_-%", c != "" and c in "-./:_"])
    marks = [np.array(fore, float).reshape(len(fore), -1)[which], np.array(aft, float).reshape(len(aft), -1)[to]]
    zero = np.append(digit, 9)[lo] == 0
    return np.column_stack([kind, b - a, n, n_groups, longest, shortest, head, tail, *signs, passes, kinds, zero & (n > 0),
                            np.searchsorted(letters, b) - np.searchsorted(letters, a), left, left_size, right, right_size,
                            *marks]).astype(float)


def _sentences(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, marks and sentence of each candidate in sentences made by rule."""
    rng = np.random.default_rng(13)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("aeiounrstldmchgp"), rng.integers(2, 9)))

    def card(k):
        body = num(k - 1)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def grouped(d, sep, size=4):
        return sep.join(d[i:i + size] for i in range(0, len(d), size))

    def short_v6():
        part = [format(x >> rng.choice([0, 0, 8]), "x") for x in rng.integers(0, 65536, rng.integers(2, 7))]
        at = rng.integers(1, len(part))
        return rng.choice([":".join(part[:at]) + "::" + ":".join(part[at:]), f"2001:db8::{part[0]}", f"fe80::{part[0]}:{part[1]}"])

    # (kind, words before, writing)
    good = [
        lambda: (3, rng.choice(["phone ", "call ", "tel. ", "mobile: ", "contact "]),
                 rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(3)} {num(4)}",
                             f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(6)}"])),
        lambda: (3, "", f"({num(3)}) {num(3)}-{num(4)}"),
        lambda: (2, rng.choice(["card ", "visa ", "credit card no ", "payment "]),
                 rng.choice([card(15), grouped(card(15), " ", 5), grouped(card(16), "."), grouped(card(16), "_"), card(14)])),
        lambda: (0, "", f"{word()}.{word()} {rng.choice(['(at)', '[at]', '{at}'])} {word()} {rng.choice(['(dot)', '[dot]'])} com"),
        lambda: (0, "", f"{word()}{rng.choice(['(at)', '[at]'])}{word()}.{rng.choice(['com', 'org', 'net'])}"),
        lambda: (1, "", ":".join(format(x >> rng.choice([0, 8, 16]), "x") for x in rng.integers(0, 65536, 8))),
        lambda: (1, rng.choice(["", "host ", "ip "]), short_v6()),
    ]
    # writings that a base rule finds alone, but not beside another number
    beside = [
        lambda: (2, "", card(16)), lambda: (2, "", card(16)), lambda: (2, "", grouped(card(16), rng.choice([" ", "-"]))),
        lambda: (2, "", card(19)),
        lambda: (3, "", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"), lambda: (3, "", f"+{num(2)} {num(3)} {num(3)} {num(4)}"),
        lambda: (3, "", f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}"),
        lambda: (1, "", ".".join(str(x) for x in rng.integers(0, 256, 4))),
        lambda: (3, "", f"({num(3)}) {num(3)}-{num(4)}"), lambda: (None, "", num(16)), lambda: (None, "", num(16)),
    ]
    bad = [
        lambda: f"{rng.integers(1900, 2100)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", lambda: num(rng.integers(7, 20)),
        lambda: f"{num(1)}.{num(2)}.{num(4)}", lambda: f"${num(4)}.{num(2)}", lambda: f"0.{num(9)}",
        lambda: f"order {num(8)}", lambda: f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
        lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"a{num(12)}f",
        lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"id {num(4)}-{num(4)}-{num(4)}-{num(4)}",
        lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"+{num(16)}", lambda: f"{num(4)}-{num(4)}",
        lambda: f"{num(5)}-{num(4)}", lambda: f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", lambda: f"{num(6)} {num(6)}",
        lambda: f"({num(4)}) {num(4)}", lambda: f"total {num(9)}", lambda: f"{word()} {num(10)} {word()}",
    ]
    plain = lambda: (None, "", str(bad[rng.integers(len(bad))]()))
    other = [lambda: f"{word()}::{word()}", lambda: f"{rng.choice(['ab', 'c', 'fade', 'be'])}::{rng.choice(['add', 'f', 'ad', 'begin'])}",
             lambda: " ".join(num(rng.integers(1, 7)) for _ in range(rng.integers(2, 12))),
             lambda: ":".join(num(2) for _ in range(rng.integers(2, 6)))]
    bad += other
    xs, ys, of = [], [], []
    for i in range(n):
        lead = " ".join(word() for _ in range(rng.integers(1, 6)))
        if i % 2 == 0:
            pieces = [good[rng.integers(len(good))]() if i % 6 == 0 else plain()]
        else:  # numbers side by side
            pool = [lambda: good[rng.integers(len(good))](), plain, *[lambda: beside[rng.integers(len(beside))]()] * 4]
            pieces = [pool[rng.integers(len(pool))]() for _ in range(rng.choice([2, 2, 2, 3]))]
        text, truth = lead, set()
        for k, (want, cue, body) in enumerate(pieces):
            text += (" " if k == 0 else str(rng.choice([" ", " ", " ", "  ", ", ", " / ", "\n", " - "]))) + cue
            at = len(text)
            text += body
            # what a base rule finds in a writing alone is right beside others too
            truth |= {(q, at + a, at + b) for q, a, b in base_spans(body)} | ({(want, at, at + len(body))} if want is not None else set())
        text += " " + " ".join(word() for _ in range(3))
        base = base_spans(text)
        spans = [c for c in candidates(text) if not any(c[1] < b and a < c[2] for _, a, b in base)]
        if spans:
            xs.append(describe(text, spans))
            ys += [c in truth for c in spans]
            of += [i] * len(spans)
    return np.concatenate(xs), np.array(ys, float), np.array(of)


def examples(n: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Features and marks of candidates in sentences made by rule."""
    return _sentences(n)[:2]


def threshold(p: np.ndarray, truth: np.ndarray, precision: float, odds: float) -> float:
    """The lowest limit on ``p`` that keeps the precision, half way to the next candidate; 2 if there is none."""
    order = np.argsort(-p, kind="stable")
    ranked, right = p[order], truth[order]
    kept = np.cumsum(right)
    good = np.flatnonzero(kept >= precision * (kept + odds * np.cumsum(1 - right)))
    below = np.append(ranked, 0.0)
    return float(below[good[-1]] + below[good[-1] + 1]) / 2 if len(good) else 2.0


@lru_cache(maxsize=1)
def redactor() -> Redactor:
    """The redactor with its usual settings, trained once in a driver."""
    return Redactor()


class Redactor:
    """The trees and, for each kind, the threshold that a candidate must reach.

    Thresholds are calibrated on sentences that the trees have not seen: the
    lowest one at which ``precision`` of what it lets through is right, where
    a wrong candidate counts ``odds`` times, as texts hold that many more
    plain numbers than the sentences do.
    """

    def __init__(self, precision: float = 0.995, odds: float = 10.0):
        x, y, of = _sentences(6000)
        fold = of % 8 >= 6  # whole sentences, both kinds of them
        self.trees = Booster().fit(x[~fold], y[~fold])
        p, truth, kind = self.trees.probability(x[fold]), y[fold], x[fold][:, 0]
        self.least = [threshold(p[kind == k], truth[kind == k], precision, odds) for k in range(len(KINDS))]
        self.lowest = min(self.least)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        return self.added_all([text], [base])[0]

    def added_all(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """The added spans of each text; candidates of several texts are scored together."""
        likely: list[list[tuple[float, tuple[int, int, int]]]] = [[] for _ in texts]
        held: list[tuple[int, list[tuple[int, int, int]], np.ndarray]] = []
        n = 0

        def score() -> None:
            if held:
                p = iter(np.split(self.trees.probability(np.concatenate([x for _, _, x in held])),
                                  np.cumsum([len(c) for _, c, _ in held])[:-1]))
                for (i, found, _), q in zip(held, p):
                    likely[i] += [(-v, found[k]) for k in np.flatnonzero(q >= self.lowest) if (v := q[k]) >= self.least[found[k][0]]]
                held.clear()

        for i, (text, base) in enumerate(zip(texts, bases)):
            found = candidates(text)
            if found and base:
                starts = sorted((a, b) for _, a, b in base)
                lows = [a for a, _ in starts]
                far = np.maximum.accumulate([b for _, b in starts])
                found = [c for c in found if not (k := bisect_right(lows, c[2] - 1)) or far[k - 1] <= c[1]]
            for at in range(0, len(found), _SCORED):
                some = found[at:at + _SCORED]
                held.append((i, some, describe(text, some)))
                n += len(some)
                if n >= _SCORED:
                    score()
                    n = 0
        score()
        return [_chosen(sorted(c)) for c in likely]


def _chosen(ranked: list[tuple[float, tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """The spans in their order that overlap none chosen before."""
    out: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []  # in order of the text, none overlapping
    for _, c in ranked:
        k = bisect_right(taken, (c[1], c[2]))
        if (not k or taken[k - 1][1] <= c[1]) and (k == len(taken) or c[2] <= taken[k][0]):
            insort(taken, (c[1], c[2]))
            out.append(c)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _examine(model: Redactor, col: pa.Array, with_text: bool) -> list[pa.Array]:
    counts: list[list[int]] = []
    sha, spans, n_added, texts = [], [], [], []
    cells = [cell.as_py() or "" for cell in col]
    bases = [base_spans(text) for text in cells]
    for cell, text, base, more in zip(col, cells, bases, model.added_all(cells, bases)):
        counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
        sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
        spans.append(joined(base + more))
        n_added.append(len(more))
        if with_text:
            texts.append(redact(text, base + more) if cell.is_valid else None)
    if with_text:
        return [pa.array(texts, pa.string())]
    cols = np.array(counts, np.int64).reshape(-1, len(KINDS))
    return [*[pa.array(np.ascontiguousarray(cols[:, k])) for k in range(len(KINDS))], pa.array(sha, pa.string()),
            pa.array(spans, pa.string()), pa.array(n_added, pa.int64())]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added of every row.

    Offsets are code points, ends exclusive. A null text counts as empty.
    Repeated rows give equal rows; other columns are ignored; an empty table
    gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(redactor())
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return appended(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", fields,
                    lambda col: _examine(sent.value, col, False)).drop("text")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all spans of the text replaced and n_chars counted anew; null texts stay null.

    Empty texts stay empty, repeated rows give equal rows, an empty table no
    rows. All other columns pass through, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(redactor())
    clean = free_name("clean_text", docs.columns)
    out = appended(docs, "text", f"{clean} string", lambda col: _examine(sent.value, col, True))
    new = {"text": F.col(clean), "n_chars": F.char_length(clean).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else named(c) for c in docs.columns])
