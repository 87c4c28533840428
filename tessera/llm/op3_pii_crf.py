r"""Personal data by rules and a linear-chain conditional random field over word shapes.

The rules find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international telephone
numbers.  The field labels white-space words with BIO tags of the same four kinds from features of
their shapes and their neighbours' shapes; it is trained by maximum likelihood on a small labelled table
(`labelled_rows`, made from templates, or the caller's own) and decoded by Viterbi in numpy batches.
Its spans are added where they overlap no rule span and pass the kind's own checks; rule spans stay.

Every text is read whole.  Training forbids entity tags on words without a digit or @, so words farther than
`CONTEXT` words from such a word take part in no entity and are not decoded.  The runs of words that are left are
decoded in parts, cut at words without a digit or @ only: as these can only be O, the best path is the whole run's.

Defined results: null text is empty and has no spans; an empty table gives an empty one; extra columns pass
through, one called as `out` under the name `out`_input.  Equal texts get equal spans.  Offsets are code
points, ends exclusive, ordered by start, then kind in the order of KINDS.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import cleared

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CONTEXT = 3
PIECE, BATCH = 256, 512_000
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("rule", T.BooleanType()), T.StructField("field", T.BooleanType())]))

_ANCHOR = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four rules, each kind leftmost and non-overlapping, in time linear in the text."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    if _ANCHOR.search(text):
        for run in _DOTTED.finditer(text):
            if run[0].count(".") >= 3:
                parts = list(_PART.finditer(text, run.start(), run.end()))
                for k in range(0, len(parts) - 3, 4):
                    if all(len(p[0].lstrip("0")) <= 3 and int(p[0][-4:]) <= 255 for p in parts[k : k + 4]):
                        out.append(("ip", parts[k].start(), parts[k + 3].end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def shape(word: str) -> str:
    """Classes of characters, runs cut to four."""
    out: list[str] = []
    for c in word:
        s = "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if out[-4:] != [s] * 4:
            out.append(s)
    return "".join(out)


def trimmed(word: str) -> tuple[int, int]:
    """Bounds of a word without quotes, brackets and closing punctuation around it."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "+("):
        a += 1
    while b > a and not (word[b - 1].isalnum() or word[b - 1] == ")"):
        b -= 1
    return a, b


def features(words: list[str]) -> list[list[str]]:
    """Feature names of each word: its own and its neighbours' shapes, coarse shapes, lengths and cue words."""
    cores = [w[slice(*trimmed(w))] for w in words]
    shapes = [shape(w) for w in cores]
    coarse = [re.sub(r"(.)\1+", r"\1", s) for s in shapes]
    out = []
    for k, w in enumerate(cores):
        digits = sum("0" <= c <= "9" for c in w)
        f = ["bias", f"s={shapes[k]}", f"c={coarse[k]}", f"d={min(digits, 20)}", f"anchor={digits > 0 or '@' in w}"]
        for name, j in (("p", k - 1), ("n", k + 1)):
            f.append(f"{name}c={coarse[j]}" if 0 <= j < len(words) else f"{name}=none")
            if 0 <= j < len(words) and coarse[j] in ("x", "Xx", "X"):
                f.append(f"{name}w={cores[j].lower()[:10]}")
        out.append(f)
    return out


def labelled_rows(n: int = 300, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table from templates: words with their tags, entities in usual and unusual writing, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvwzäéñ") for _ in range(rng.randint(a, b)))

    def card() -> str:
        head = digits(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def entity(kind: str) -> str:
        if kind == "email":
            return f"{letters(2, 8)}{rng.choice(['', '.', '_'])}{rng.choice([digits(2), letters(2, 6)])}@{rng.choice([letters(3, 7), 'mail' + digits(1), 'mail' + digits(1) + '.' + letters(3, 6)])}.{rng.choice(['com', 'org', 'example.com', 'net', 'de'])}"
        if kind == "ip":
            return ".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice(["", "", ":" + digits(4)])
        if kind == "card":
            c = card()
            return rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4))])
        return rng.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"00{digits(2)}-{digits(3)}-{digits(6)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])

    def other() -> str:
        return rng.choice([str(rng.randint(1, 2100)), f"{rng.randint(1, 20)}.{rng.randint(0, 9)}.", f"{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}", f"${digits(2)}.{digits(2)}", digits(16), digits(11), f'"{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"ISBN {digits(3)}-{digits(10)}", f"{digits(1)},{digits(3)},{digits(3)}", f"@{letters(3, 8)}", f"{digits(3)}-{digits(2)}", f"{letters(1, 3)}{digits(4)}"])

    rows = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 5)):
                w = letters(1, 9)
                words.append(rng.choice([w, w, w.capitalize(), w + ".", w + ",", w.upper()]))
                tags.append("O")
            kind = rng.choice([*KINDS, *KINDS, "", "", ""])
            made = entity(kind) if kind else other()
            if rng.random() < 0.2 and kind:
                words.append({"email": "mail:", "ip": "host", "card": "card", "phone": rng.choice(["tel", "call", "phone:"])}[kind])
                tags.append("O")
            if not kind and rng.random() < 0.3:
                words.append(rng.choice(["version", "token", "year", "page", "order"]))
                tags.append("O")
            for j, w in enumerate(made.split(" ")):
                words.append(w)
                tags.append(f"{'I' if j else 'B'}-{kind}" if kind else "O")
            words[-1] += rng.choice(["", "", "", ".", ",", "!!", "###"])
        words.append(letters(2, 6))
        tags.append("O")
        rows.append((words, tags))
    return rows


@dataclass
class Field:
    """Feature numbers, feature weights (features x tags) and tag transitions, the last row for the start."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def tensor(self, sequences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores (sequences x words x tags) and lengths; words without digit or @ can only be O."""
        lens = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), int(lens.max(initial=0)), len(TAGS)))
        for i, s in enumerate(sequences):
            for j, f in enumerate(s):
                out[i, j] = self.emit[[self.names[x] for x in f if x in self.names]].sum(axis=0)
                if "anchor=False" in f:
                    out[i, j, 1:] = -1e9
        return out, lens

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """Best tag paths of a batch, all sequences a step at a time."""
        if not sequences:
            return []
        score, lens = self.tensor(sequences)
        best, back = score[:, 0] + self.move[-1], []
        for t in range(1, score.shape[1]):
            reach = best[:, :, None] + self.move[None, :-1]
            prev = reach.argmax(axis=1)
            new = np.take_along_axis(reach, prev[:, None], axis=1)[:, 0] + score[:, t]
            on = (t < lens)[:, None]
            best = np.where(on, new, best)
            back.append(np.where(on, prev, np.arange(len(TAGS))[None, :]))
        tag = best.argmax(axis=1)
        path = [tag]
        for prev in reversed(back):
            tag = prev[np.arange(len(tag)), tag]
            path.append(tag)
        paths = np.stack(path[::-1], axis=1)
        return [p[:n] for p, n in zip(paths, lens, strict=True)]


def train(rows: list[tuple[list[str], list[str]]] | None = None, rounds: int = 60, penalty: float = 0.01) -> Field:
    """Maximum likelihood with an L2 penalty by Adam; forward-backward over all sequences at once."""
    rows = rows or labelled_rows()
    feats = [features(w) for w, _ in rows]
    seen = Counter(x for s in feats for f in s for x in f)
    names = {x: k for k, x in enumerate(sorted(x for x, c in seen.items() if c > 1))}
    feats = [[[x for x in f if x in names] for f in s] for s in feats]
    k, n, longest = len(TAGS), len(rows), max(len(w) for w, _ in rows)
    lens = np.array([len(w) for w, _ in rows])
    width = max(len(f) for s in feats for f in s)
    ids = np.full((n, longest, width), len(names))
    gold = np.zeros((n, longest), int)
    closed = np.zeros((n, longest), bool)
    for i, (s, (_, tags)) in enumerate(zip(feats, rows, strict=True)):
        for j, f in enumerate(s):
            ids[i, j, : len(f)] = [names[x] for x in f]
            gold[i, j] = TAGS.index(tags[j])
            closed[i, j] = "anchor=False" in f
    valid = np.arange(longest)[None, :] < lens[:, None]
    emit, move = np.zeros((len(names) + 1, k)), np.zeros((k + 1, k))
    for a, tag in enumerate(("O", *TAGS[1:])):
        for b, nxt in enumerate(TAGS):
            if nxt.startswith("I") and tag[1:] != nxt[1:]:
                move[a, b] = -1e6
    move[k, [b for b, x in enumerate(TAGS) if x.startswith("I")]] = -1e6
    fixed = move < -1e5
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for r in range(1, rounds + 1):
        score = emit[ids].sum(axis=2)
        score[closed, 1:] = -1e9
        alpha = np.zeros((longest, n, k))
        alpha[0] = score[:, 0] + move[k]
        for t in range(1, longest):
            new = lse(alpha[t - 1][:, :, None] + move[None, :k], 1) + score[:, t]
            alpha[t] = np.where(valid[:, t, None], new, alpha[t - 1])
        log_z = lse(alpha[-1], 1)
        beta = np.zeros((longest, n, k))
        g_emit, g_move = np.zeros_like(emit), np.zeros_like(move)
        for t in range(longest - 1, -1, -1):
            if t < longest - 1:
                ahead = lse(move[None, :k] + (score[:, t + 1] + beta[t + 1])[:, None, :], 2)
                beta[t] = np.where(valid[:, t + 1, None], ahead, 0.0)
                pair = np.exp(np.minimum(alpha[t][:, :, None] + move[None, :k] + (score[:, t + 1] + beta[t + 1])[:, None, :] - log_z[:, None, None], 0))
                g_move[:k] -= pair[valid[:, t + 1]].sum(axis=0)
                ok = valid[:, t + 1]
                np.add.at(g_move, (gold[ok, t], gold[ok, t + 1]), 1)
            p = np.exp(np.minimum(alpha[t] + beta[t] - log_z[:, None], 0)) * valid[:, t, None]
            diff = -p
            diff[np.arange(n), gold[:, t]] += valid[:, t]
            np.add.at(g_emit, ids[:, t].reshape(-1), np.repeat(diff, width, axis=0))
            if t == 0:
                g_move[k] -= p.sum(axis=0)
                np.add.at(g_move[k], gold[:, 0], 1)
        g_emit, g_move = g_emit / n - penalty * emit / n, np.where(fixed, 0, g_move / n - penalty * np.where(fixed, 0, move) / n)
        g_emit[-1] = 0
        for w, g, (m, v) in ((emit, g_emit, moments[:2]), (move, g_move, moments[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(names, emit[:-1], move)


@cache
def default_field() -> Field:
    """The field of the built-in table, trained once in a process."""
    return train()


def _sound(kind: str, found: str) -> bool:
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "email":
        return bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s.]{2,}", found))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?", found)) and all(int(p) < 256 for p in found.split(":")[0].split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9 .-]+", found))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+0-9 ().-]+", found)) and bool(re.search(r"[0-9)][ .-]+[(0-9]", found))


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Runs of word bounds within CONTEXT words of a word that has a digit or @."""
    bounds = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    end = -1
    for k, (a, b) in enumerate(bounds):
        if _ANCHOR.search(text, a, b):
            lo, hi = max(end, k - CONTEXT, 0), min(len(bounds), k + CONTEXT + 1)
            if end >= k - CONTEXT and out:
                out[-1].extend(bounds[max(end, 0) : hi])
            else:
                out.append(bounds[lo:hi])
            end = hi
    return out


@dataclass
class Part:
    """The features of words lo to hi of a run, made a piece at a time as they are read; neighbours outside the part count."""

    text: str
    run: list[tuple[int, int]]
    lo: int
    hi: int

    def __len__(self) -> int:
        return self.hi - self.lo

    def __iter__(self) -> Iterator[list[str]]:
        for at in range(self.lo, self.hi, PIECE):
            first, end = max(at - 1, 0), min(at + PIECE, self.hi)
            yield from features([self.text[a:b] for a, b in self.run[first : end + 1]])[at - first : end - first]


def parts(text: str) -> list[Part]:
    """The runs of a text in parts of PIECE words or more, cut at a word that can only be O; it ends one part and begins the next."""
    out = []
    for run in sequences(text):
        lo = 0
        for k in range(PIECE, len(run) - 1):
            if k - lo >= PIECE and not _ANCHOR.search(text, *run[k]):
                out.append(Part(text, run, lo, k + 1))
                lo = k
        out.append(Part(text, run, lo, len(run)))
    return out


def batched(sizes: list[int]) -> list[tuple[int, int]]:
    """Bounds of batches of ascending sizes: at most 2000 parts, and BATCH words with padding unless one part alone is longer."""
    out, lo = [], 0
    for k, n in enumerate(sizes):
        if k > lo and (k - lo == 2000 or (k + 1 - lo) * n > BATCH):
            out.append((lo, k))
            lo = k
    return [*out, (lo, len(sizes))] if sizes else out


def find_batch(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool, bool]]]:
    """All spans of each text: (kind, start, end, found by a rule, found by the field); the field finds a rule's span if it decodes one of the kind that shares a character."""
    rules = [rule_spans(t) if t else [] for t in texts]
    jobs = [(i, p) for i, t in enumerate(texts) if t and _ANCHOR.search(t) for p in parts(t)]
    jobs.sort(key=lambda j: len(j[1]))
    out = [[(k, a, b, True, False) for k, a, b in r] for r in rules]
    for lo, hi in batched([len(p) for _, p in jobs]):
        part = jobs[lo:hi]
        for (i, p), path in zip(part, field.decode([p for _, p in part]), strict=True):
            s = p.run[p.lo : p.hi]
            k = 0
            while k < len(path):
                tag = TAGS[path[k]]
                j = k + 1
                if tag != "O":
                    kind = tag[2:]
                    while j < len(path) and TAGS[path[j]] == f"I-{kind}":
                        j += 1
                    text = texts[i]
                    a = s[k][0] + trimmed(text[s[k][0] : s[k][1]])[0]
                    b = s[j - 1][0] + trimmed(text[s[j - 1][0] : s[j - 1][1]])[1]
                    met = [n for n, (_, x, y, _, _) in enumerate(out[i]) if x < b and a < y] if a < b else []
                    for n in met:
                        if out[i][n][0] == kind:
                            out[i][n] = (*out[i][n][:4], True)
                    if a < b and not met and _sound(kind, text[a:b]):
                        out[i].append((kind, a, b, False, True))
                k = j
    return [sorted(o, key=lambda x: (x[1], KINDS.index(x[0]))) for o in out]


def find_personal(docs: DataFrame, text_col: str = "text", out: str = "pii", rows: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """docs with an array column `out` of spans (kind, s, e, rule, field)."""
    docs = cleared(docs, out)
    shipped = docs.sparkSession.sparkContext.broadcast(train(rows) if rows else default_field())

    def find(texts: pa.Array) -> pa.Array:
        spans = find_batch(texts.to_pylist(), shipped.value)
        flat = [x for s in spans for x in s]
        inner = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64()), pa.array([x[3] for x in flat], pa.bool_()), pa.array([x[4] for x in flat], pa.bool_())], names=["kind", "s", "e", "rule", "field"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)), inner)

    return docs.withColumn(out, F.arrow_udf(find, SPAN).asNondeterministic()(F.col(text_col)))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans merge under the first one's kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_personal(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """docs with text_col masked by spans_col."""

    def cover(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not s else masked(t, [(x["kind"], x["s"], x["e"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return docs.withColumn(text_col, F.arrow_udf(cover, T.StringType())(F.col(text_col), F.col(spans_col)))
