"""Personal data by patterns and a semi-Markov conditional random field.

Patterns find well-formed e-mail addresses, IPv4 addresses, card and phone numbers. The field then
reads every stretch of words around digits, at-signs and spelt-out addresses ('at', '[at]' or '(at)' before a host
with a dot or 'dot', '[dot]', '(dot)'), as a whole, however long it is: features of a whole candidate segment
(digits, marks, check sum, quad, the word before) score each type, and dynamic programming over
segments of at most ``LONGEST`` words chooses boundaries and types together. It is trained on the
corpus by what the patterns found, also in disguised forms (no plus sign, other separators,
spelt-out marks). Segments it is sure of and that touch no pattern's span are added.

The training sample holds at most ``SAMPLE`` stretches, those of least hash of all documents (runs are cut into 24 words for it; up to 400
characters); every whole text is scanned. Defined results: null texts are empty and have no spans; repeated rows are scanned each for
itself; other columns are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6
SAMPLE = 1500
EPOCHS = 4
SURE = 0.95
CONTEXT = 2
FEATURES = 1 << 12
#: Runs of more words are read in parts, each with this many words of the neighbouring parts, to bound the memory.
PART, SEAM = 4096, 8 * LONGEST

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_STRETCH = re.compile(r"[0-9@]\S*")
_WORD = re.compile(r"\S+")
_DOT = re.compile(r"(?i)\sdot\s|[\[(]dot[\])]")
_SPELT = re.compile(r"[aA][tT](?:(?<=\s[aA][tT])\s+|(?<=[\[(][aA][tT])[\])]\s*)[A-Za-z0-9-]+(?:(?:\.|\s*[\[(][dD][oO][tT][\])]\s*|\s+[dD][oO][tT]\s+)[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Well-formed matches by kind, then start; leftmost and non-overlapping within a kind."""
    if not _HINT.search(text):
        return []
    out = []
    if "@" in text:
        past = 0
        for m in _HOST.finditer(text):
            a = m.start()
            while a > past and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                past = m.end()
    out += [("ip", m.start(), m.end()) for m in _QUAD.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def spelt(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Spelt-out addresses in a part of the text, from the word before 'at' to the host's last, each with its form:
    a mark in brackets, a bare 'at' with a spelt dot, or a bare 'at' only."""
    out = []
    for m in _SPELT.finditer(text, start, end):
        bracket = text[m.start() - 1] in "[("
        a, b = m.start() - bracket, m.end()
        while a > start and text[a - 1].isspace():
            a -= 1
        while a > start and not text[a - 1].isspace():
            a -= 1
        while b < end and not text[b].isspace():
            b += 1
        out.append((a, b, "bracket" if bracket else "dot" if _DOT.search(m[0]) else "bare"))
    return out


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Whole runs of neighbouring words with a digit, an at-sign or part in a spelt-out address, each with ``CONTEXT`` words before and after."""
    found = [(m.start(), m.end()) for a, b, _ in spelt(text, 0, len(text)) for m in _WORD.finditer(text, a, b)]
    past = 0
    for m in _STRETCH.finditer(text):
        a = m.start()
        while a > past and not text[a - 1].isspace():
            a -= 1
        past = m.end()
        found.append((a, past))
    runs: list[list[tuple[int, int]]] = []
    for word in sorted(set(found)):
        if runs and not text[runs[-1][-1][1] : word[0]].strip():
            runs[-1].append(word)
        else:
            runs.append([word])
    out = []
    for run in runs:
        first, last = run[0][0], run[-1][1]
        left = [(m.start(), m.end()) for m in _WORD.finditer(text, max(0, first - 60), first)][-CONTEXT:]
        right = [(m.start(), m.end()) for m in _WORD.finditer(text, last, min(len(text), last + 60))][:CONTEXT]
        out.append([*left, *run, *right])
    return out


def features(kind: str, seg: str, before: str, form: str = "") -> list[int]:
    """Hashed features of a whole segment together with its type."""
    core = seg.strip(".,;:!?|'\"")
    d = _digits(core)
    letters = sum(c.isalpha() for c in core)
    marks = "".join(sorted({c for c in core if not c.isalnum()}))
    parts = re.split(r"\s*(?:\.|\[dot\]|\(dot\)| dot )\s*", core)
    quad = len(parts) == 4 and all(p.isdigit() and p.isascii() and _byte(p) for p in parts)
    at = "@" in core or bool(re.search(r"\s(?:at|\[at\]|\(at\))\s|\[at\]|\(at\)", core))
    named = [
        f"digits{min(len(d), 20)}",
        f"letters{min(letters, 4)}",
        f"marks{marks}",
        f"plus{core[:1] == '+'}",
        f"luhn{len(d) if 13 <= len(d) <= 19 and luhn(d) else 0}",
        f"quad{quad}",
        f"at{at}dot{'.' in core or 'dot' in core}l{letters > 3}",
        f"words{len(seg.split())}",
        f"groups{[len(g) for g in re.findall('[0-9]+', core)][:5]}",
        f"only{letters == 0}n{len(d) >= 7}p{'(' in core}",
        f"edge{core == seg}",
        f"spelt{form}",
        f"before{before.lower().strip('.,:;')[:8] if before.strip('.,:;').lower() in CUES else ''}",
        "bias",
    ]
    return [hash_of(f"{kind}|{f}") for f in named]


#: Words that often stand before personal data.
CUES = frozenset("email mail contact phone tel call fax mobile card visa pay ip host server address from to".split())


def hash_of(s: str) -> int:
    h = 2166136261
    for c in s.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % FEATURES


def hot_words(text: str, words: list[tuple[int, int]]) -> list[bool]:
    """Which words have a digit or at-sign or belong to a spelt-out address."""
    spans = spelt(text, words[0][0], words[-1][1])
    inside = {m.start() for a, b, _ in spans for m in _WORD.finditer(text, a, b)}
    return [a in inside or bool(_HINT.search(text, a, b)) for a, b in words]


def lattice(text: str, words: list[tuple[int, int]], w: np.ndarray | None = None) -> dict[tuple[int, int], list]:
    """Per (first word, word after the last) the types it may have with their features, or their scores under ``w``; single words may be nothing."""
    out: dict[tuple[int, int], list] = {}
    hot = hot_words(text, words)
    forms = {(a, b): form for a, b, form in spelt(text, words[0][0], words[-1][1])}
    for i in range(len(words)):
        out[i, i + 1] = [("none", [])]
        before = text[words[i - 1][0] : words[i - 1][1]] if i else ""
        for j in range(i + 1, min(len(words), i + LONGEST) + 1):
            seg = text[words[i][0] : words[j - 1][1]]
            if len(seg) > 64 or not any(hot[i:j]) or not (hot[i] or seg[0] == "(") and "at" not in seg or "\n" in seg:
                continue
            found = [(k, features(k, seg, before, forms.get((words[i][0], words[j - 1][1]), ""))) for k in KINDS]
            out.setdefault((i, j), []).extend(found if w is None else ((k, float(w[f].sum())) for k, f in found))
    return out


def _score(f: list[int] | float, w: np.ndarray) -> float:
    return f if isinstance(f, float) else float(w[f].sum()) if f else 0.0


def forward_backward(n: int, lat: dict, w: np.ndarray) -> tuple[dict[tuple[int, int, str], float], float]:
    """Posterior of each typed segment under the field."""
    score = {(i, j, k): _score(f, w) for (i, j), kinds in lat.items() for k, f in kinds}
    fore, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fore[0] = back[n] = 0.0
    by_end = sorted(score, key=lambda s: s[1])
    for i, j, k in by_end:
        fore[j] = np.logaddexp(fore[j], fore[i] + score[i, j, k])
    for i, j, k in sorted(score, key=lambda s: -s[0]):
        back[i] = np.logaddexp(back[i], back[j] + score[i, j, k])
    total = fore[n]
    return {s: float(np.exp(fore[s[0]] + v + back[s[1]] - total)) for s, v in score.items()}, total


def best(n: int, lat: dict, w: np.ndarray) -> list[tuple[int, int, str]]:
    """The best segmentation, by dynamic programming over segments of bounded length."""
    top: list[tuple[float, tuple[int, int, str] | None]] = [(0.0, None)] + [(-np.inf, None)] * n
    for i, j, k, f in sorted(((i, j, k, f) for (i, j), kinds in lat.items() for k, f in kinds), key=lambda s: s[1]):
        v = top[i][0] + _score(f, w)
        if v > top[j][0]:
            top[j] = (v, (i, j, k))
    out = []
    while n:
        seg = top[n][1]
        out.append(seg)
        n = seg[0]
    return out[::-1]


def gold(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The segmentation that the patterns imply: every match covers whole words, the rest is nothing."""
    out, at = [], 0
    spans = sorted((a, b, k) for k, a, b in base_spans(text))
    taken = 0
    for a, b, k in spans:
        i = next((x for x, (s, e) in enumerate(words) if s <= a < e), None)
        j = next((x + 1 for x, (s, e) in enumerate(words) if s < b <= e), None)
        if i is None or j is None or i < taken or j - i > LONGEST:
            continue
        out += [(x, x + 1, "none") for x in range(at, i)] + [(i, j, k)]
        at = taken = j
    return out + [(x, x + 1, "none") for x in range(at, len(words))]


def disguise(text: str, n: int) -> tuple[str, list[tuple[str, int, int]]] | None:
    """The same stretch with its first match in a form that the patterns miss."""
    spans = base_spans(text)
    if not spans:
        return None
    k, a, b = min(spans, key=lambda s: s[1])
    was = text[a:b]
    if k == "phone":
        new = re.sub(r"^\+[0-9]+\s*", "", was)
    elif k == "card":
        d = _digits(was)
        new = (". ", " . ", ".")[n % 3].strip().join(d[x : x + 4] for x in range(0, len(d), 4))
    elif k == "email":
        user, host = was.split("@", 1)
        new = f"{user} at {host.replace('.', ' dot ', 1)}" if n % 2 else f"{user} [at] {host}"
    else:
        new = was.replace(".", "[.]")
    return text[:a] + new + text[b:], [(k, a, a + len(new))]


def fit(samples: list[str]) -> np.ndarray:
    """Stochastic gradient on the field's likelihood; a stretch also stands in disguise, one with an address in both spelt-out forms."""
    rng = np.random.default_rng(5)
    cases = []
    for n, text in enumerate(samples):
        spelt_out = [disguise(text, 0), disguise(text, 1)] if min(base_spans(text), key=lambda s: s[1], default=("",))[0] == "email" else []
        for form in (None, *(spelt_out or [disguise(text, n // 2) if n % 2 else None])):
            t, spans = (text, None) if form is None else form
            for words in stretches(t)[:2]:
                want = gold(t, words)
                if spans is not None:
                    k, a, b = spans[0]
                    i = next((x for x, (s, e) in enumerate(words) if s <= a < e), None)
                    j = next((x + 1 for x, (s, e) in enumerate(words) if s < b <= e), None)
                    if i is None or j is None or j - i > LONGEST or any(s[2] != "none" and s[0] < j and i < s[1] for s in want):
                        continue
                    want = [s for s in want if s[1] <= i or s[0] >= j] + [(i, j, k)]
                lat = lattice(t, words)
                if all((s[0], s[1]) in lat for s in want):
                    cases.append((len(words), lat, set(want)))
    w = np.zeros(FEATURES)
    sums = np.full(FEATURES, 1.0)
    for _ in range(EPOCHS):
        for c in rng.permutation(len(cases)):
            n, lat, want = cases[c]
            post, _total = forward_backward(n, lat, w)
            grad = np.zeros(FEATURES)
            for (i, j), kinds in lat.items():
                for k, f in kinds:
                    if f:
                        d = ((i, j, k) in want) - post[i, j, k]
                        if abs(d) > 1e-4:
                            np.add.at(grad, f, d)
            sums += grad * grad
            w += 0.5 * grad / np.sqrt(sums)
        w *= 0.995
    return w


def added_spans(text: str, base: list[tuple[str, int, int]], w: np.ndarray) -> list[tuple[str, int, int]]:
    """Typed segments of the best path that the field is sure of and that no pattern's span touches."""
    out = []
    for run in stretches(text):
        done = 0
        for start in range(0, len(run), PART):
            first = max(0, start - SEAM)
            words = run[first : start + PART + SEAM]
            free = [not any(a < e and s < b for _, a, b in base) for s, e in words]
            if not any(ok and hot for ok, hot in zip(free, hot_words(text, words), strict=True)):
                continue
            lat = lattice(text, words, w)
            if len(lat) == len(words):
                continue
            path = [s for s in best(len(words), lat, w) if s[2] != "none" and all(free[s[0] : s[1]]) and start <= first + s[0] < start + PART and first + s[0] >= done]
            if path:
                post, _total = forward_backward(len(words), lat, w)
                for i, j, k in path:
                    if post[i, j, k] >= SURE:
                        seg = text[words[i][0] : words[j - 1][1]]
                        cut = len(seg) - len(seg.lstrip(".,;:!?|'\""))
                        core = seg.strip(".,;:!?|'\"")
                        if core and len(_digits(core)) + ("@" in core) + bool(_SPELT.search(core)) >= 1 and (k == "email" or len(_digits(core)) >= 7 or k == "ip"):
                            out.append((k, words[i][0] + cut, words[i][0] + cut + len(core)))
                            done = first + j
    return out


def _sample(most: int):
    """The ``most`` distinct stretches of least hash within a task; those of all tasks hold those of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: set[tuple[int, str]] = set()
        for batch in batches:
            for t in batch.column("text"):
                text = t.as_py() or ""
                if _HINT.search(text) or _SPELT.search(text):
                    for run in stretches(text):
                        for k in range(0, len(run), 24):
                            words = run[k : k + 24]
                            part = text[words[0][0] : words[-1][1]]
                            if len(words) > 1 and len(part) <= 400:
                                least.add((xxhash.xxh64_intdigest(part.encode(), 3) - (1 << 63), part))
            if len(least) > 4 * most:
                least = set(sorted(least)[:most])
        kept = sorted(least)[:most]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.string())], names=["hash", "text"])

    return run


def train(docs: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Weights learnt from the ``most`` distinct stretches of least hash of all documents."""
    rows = docs.select("text").mapInArrow(_sample(most), "hash long, text string").distinct().orderBy("hash", "text").limit(most).collect()
    return fit([r["text"] for r in rows])


def spans_of(text: str | None, w: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each by kind as listed and then start."""
    text = text or ""
    base = base_spans(text)
    if not base and not _HINT.search(text) and not _SPELT.search(text):
        return base, base
    more = added_spans(text, base, w)
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def scan(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """One row per document row: doc_id, counts of the base spans by kind, base spans and all spans as text."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            got = [spans_of(t.as_py(), w) for t in batch.column("text")]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *counts, pa.array([write(b) for b, _ in got], pa.string()), pa.array([write(a) for _, a in got], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span replaced by its kind in brackets; of overlapping spans the longest reach is replaced once."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        b = -b
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """The documents with personal data replaced in ``text``, and ``n_chars``, where there is one, to match."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact_text(t, spans_of(t, w)[1]) for t in batch.column("text").to_pylist()]
            cols = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            cols["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(lean(run), schema)
