"""Personal data: spans of fixed patterns, and what a semi-Markov conditional random field finds beside them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KINDS = ("email", "ip", "card", "phone")
#: Excerpts of each kind, and as many without personal data, that the field is fitted on; the fit is one task.
SAMPLE = 60
#: Tokens of an entity at most, words on both sides of a trigger that are searched, tokens of an excerpt.
ENTITY, AROUND, EXCERPT = 24, 2, 64
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(](?i:at|dot)[\])]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_WORD = re.compile(r"\S+")
#: Words that may stand before an entity of each kind.
CUES = (frozenset("email e-mail mail contact write".split()), frozenset("ip host server address addr from".split()), frozenset("card visa mastercard amex credit account".split()), frozenset("phone tel telephone call fax mobile cell whatsapp".split()))
_MARKS = {".": 2, "@": 3, "-": 4, "+": 5, "(": 6, ")": 7, "[": 8, "]": 9}


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if place % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Read from each @ to both sides, as the pattern's own search is quadratic in long words."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _HOST.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the fixed patterns: leftmost, non-overlapping per kind, matches that fail dropped."""
    if not _TRIGGER.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def zones(text: str, around: int = AROUND) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of words around those with a digit, an @, a bracketed at or dot; all else holds no entity."""
    if not _TRIGGER.search(text):
        return
    before: list[int] = []
    start = end = left = None
    for m in _WORD.finditer(text):
        if _TRIGGER.search(text, *m.span()):
            if start is None:
                start = before[0] if before else m.start()
            end, left = m.end(), around
        elif start is not None:
            if left:
                end, left = m.end(), left - 1
            else:
                yield start, end
                start = None
        before = [*before[1 - around :], m.start()] if around > 1 else [m.start()]
    if start is not None:
        yield start, end


class Tokens:
    """Tokens of a stretch of text with the running counts from which the features of any segment follow."""

    def __init__(self, text: str, start: int, end: int) -> None:
        found = [m for m in _TOKEN.finditer(text, start, end)]
        self.text, self.n = text, len(found)
        self.start = np.array([m.start() for m in found], dtype=np.int64)
        self.end = np.array([m.end() for m in found], dtype=np.int64)
        words = [m[0] for m in found]
        kind = np.array([1 if "0" <= w[0] <= "9" else 0 if w[0].isascii() and w[0].isalpha() else _MARKS.get(w, 10) for w in words], dtype=np.int64)
        self.kind = kind
        gap = np.zeros(self.n + 1, dtype=np.int64)
        if self.n:
            gap[1 : self.n] = self.start[1:] - self.end[:-1]
            gap[0] = start == 0 or text[start - 1].isspace()
            gap[self.n] = end == len(text) or text[end].isspace()
            broken = [k for k in range(1, self.n) if gap[k] == 1 and text[self.start[k] - 1] in "\n\r"]
            gap[broken] = 9
        self.gap = gap
        size = self.end - self.start
        bracketed = np.zeros((2, self.n), dtype=np.int64)
        for k, w in enumerate(words):
            if kind[k] == 0 and len(w) < 4 and 0 < k < self.n - 1 and words[k - 1] in "[(" and words[k + 1] in "])":
                bracketed[:, k] = w.lower() == "at", w.lower() == "dot"
        large = [kind[k] == 1 and (len(w.lstrip("0")) > 3 or int(w.lstrip("0") or 0) > 255) for k, w in enumerate(words)]
        counts = [*(kind == k for k in range(11)), *bracketed, large, np.where(kind == 1, size, 0), np.where(kind == 0, size, 0), (kind == 1) & (size == 4), gap[: self.n] > 0, gap[: self.n] > 1, (gap[: self.n] > 0) & (kind < 2) & (np.concatenate([[10], kind[:-1]]) < 2)]
        self.sums = np.concatenate([np.zeros((len(counts), 1), dtype=np.int64), np.cumsum(np.array(counts, dtype=np.int64), axis=1)], axis=1)
        cue = np.zeros((4, self.n + 1), dtype=bool)
        for k, w in enumerate(words):
            if kind[k] == 0:
                for c in range(4):
                    if w.lower() in CUES[c]:
                        cue[c, k + 1 : k + 4] = True
        self.cue = cue

    def segments(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """(first token, token after the last) of candidates that begin at the tokens low..high: no wide gap inside, a fit beginning and end."""
        first = np.arange(low, self.n if high is None else min(high, self.n))
        i, size = np.meshgrid(first, np.arange(1, ENTITY + 1), indexing="ij")
        i, j = i.ravel(), (i + size).ravel()
        fit = j <= self.n
        i, j = i[fit], j[fit]
        s = self.sums
        opens, closes = self.kind[i], self.kind[j - 1]
        fit = (s[18, j] - s[18, i + 1] == 0) & ((opens < 2) | (opens == 5) | (opens == 6)) & (closes < 2) & (s[1, j] - s[1, i] + s[3, j] - s[3, i] + s[11, j] - s[11, i] > 0)
        return np.stack([i[fit], j[fit]], axis=1)

    def features(self, pairs: np.ndarray) -> np.ndarray:
        """One row of features of the whole span for each candidate."""
        i, j = pairs[:, 0], pairs[:, 1]
        c = self.sums[:, j] - self.sums[:, i]
        digits, letters, inner = c[14], c[15], self.sums[17, j] - self.sums[17, i + 1]
        sign = np.zeros(len(i), dtype=bool)
        for k in np.flatnonzero((digits >= 13) & (digits <= 19) & (letters == 0)):
            sign[k] = luhn(re.sub("[^0-9]", "", self.text[self.start[i[k]] : self.end[j[k] - 1]]))
        at = c[3] + c[11]
        dots = c[2] + c[12]
        last = self.kind[j - 1]
        after = np.minimum(j + 1, self.n)
        runs_on = (j + 1 < self.n) & (np.append(self.kind, [10, 10])[j] == 2) & (np.append(self.kind, [10, 10])[j + 1] < 2) & (self.gap[j] == 0) & (self.gap[after] == 0)
        dot_next = self.sums[12, np.minimum(j + 2, self.n)] > self.sums[12, after]
        columns = [
            np.ones(len(i)), at == 1, at > 1, (at == 1) & (dots > 0), (at == 1) & (last == 0), (at == 1) & (letters > 3), c[11] > 0, c[12] > 0,
            letters == 0, digits == 0, (digits > 0) & (digits < 7), (digits > 6) & (digits < 9), (digits > 8) & (digits < 13), (digits > 12) & (digits < 16), digits == 16, digits > 16, sign, (digits > 12) & ~sign,
            (c[1] == 4) & (c[2] == 3) & (letters == 0) & (c[13] == 0) & (inner == 0), (c[1] == 4) & (c[2] == 3) & (letters == 0), c[13] > 0, (c[16] == 4) & (digits == 16), sign & (c[16] == 4), sign & (c[1] == 1),
            c[5] > 0, self.kind[i] == 5, self.kind[i] == 6, (c[6] == 1) & (c[7] == 1), c[6] != c[7], inner > 0, c[4] > 0, c[2] > 0, c[10] > 0, c[8] > 0,
            (self.gap[i] == 0) & (i > 0), (self.gap[j] == 0) & (j < self.n), (self.gap[i] == 0) & (i > 0) & (at > 0), (inner > 0) & (at > 0) & (c[11] == 0), (inner > 0) & (at > 0),
            *(self.cue[k, i] for k in range(4)), (j - i > 6), (j - i > 12), (digits > 8) & (digits < 13) & (letters == 0) & (c[1] > 2), (digits > 8) & (digits < 16) & (letters == 0) & (c[1] == 1),
            runs_on & (at > 0), runs_on & (at == 0), dot_next & (at > 0), (self.gap[j] > 0) | (j == self.n), (self.sums[19, j] > self.sums[19, i + 1]) & (at > 0),
        ]
        return np.stack(columns, axis=1).astype(np.float64)


FEATURES = Tokens("0", 0, 1).features(np.array([[0, 1]])).shape[1]


def _folded(kinds: int, sizes: list[int], pairs: list[np.ndarray], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log partition function of each stretch, and the probability of each candidate and kind: forward and backward sums."""
    z, n = len(sizes), max(sizes)
    which = np.repeat(np.arange(z), [len(p) for p in pairs])
    i, j = np.concatenate(pairs).T
    ends = np.full((z, n + 1, ENTITY, kinds), -np.inf)
    ends[which, j, j - i - 1] = scores
    grid = np.arange(n + 1)
    inside = grid[None, :] <= np.array(sizes)[:, None]
    ahead = np.full((z, n + 1), -np.inf)
    ahead[:, 0] = 0
    top = lambda x: np.where(np.isfinite(m := x.max(axis=-1)), m, 0)
    for t in range(1, n + 1):
        back = min(t, ENTITY)
        parts = (ahead[:, t - back : t][:, ::-1, None] + ends[:, t, :back]).reshape(z, -1)
        parts = np.concatenate([parts, ahead[:, t - 1 : t]], axis=1)
        m = top(parts)
        with np.errstate(divide="ignore"):
            value = m + np.log(np.exp(parts - m[:, None]).sum(axis=1))
        ahead[:, t] = np.where(inside[:, t], value, -np.inf)
    total = ahead[np.arange(z), sizes]
    behind = np.full((z, n + 1), -np.inf)
    behind[np.arange(z), sizes] = 0
    for t in range(n - 1, -1, -1):
        far = min(n - t, ENTITY)
        steps = np.arange(1, far + 1)
        parts = (behind[:, t + 1 : t + 1 + far][:, :, None] + ends[:, t + steps, steps - 1]).reshape(z, -1)
        parts = np.concatenate([parts, behind[:, t + 1 : t + 2]], axis=1)
        m = top(parts)
        with np.errstate(divide="ignore"):
            value = m + np.log(np.exp(parts - m[:, None]).sum(axis=1))
        behind[:, t] = np.where(grid[t] < np.array(sizes), value, behind[:, t])
    chance = np.exp(ahead[which, i][:, None] + scores + behind[which, j][:, None] - total[which][:, None])
    return total, chance


def disguised(kind: int, span: str, pick: int) -> str:
    """The same entity as people write it to escape, or in ignorance of, fixed patterns."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        at, dot = (("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."))[pick % 4]
        local, _, host = span.partition("@")
        return local + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", ("[.]", "(.)", " . ", "[.]")[pick % 4])
    if kind == 2:
        mark = (".", "/", ".", " - ")[pick % 4]
        return mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    area, middle, rest = digits[-10:-7], digits[-7:-4], digits[-4:]
    return (f"({area}) {middle}-{rest}", f"{area}-{middle}-{rest}", f"00 {digits[:-10] or 1} {area} {middle} {rest}", f"{area}.{middle}.{rest}")[pick % 4]


def examples(excerpts: list[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Excerpts with their spans: as they stand, and each with one of its spans disguised. Of overlapping spans the longest counts."""
    out = []
    for number, text in enumerate(sorted(excerpts)):
        spans: list[tuple[int, int, int]] = []
        for k, a, b in sorted(base_spans(text), key=lambda s: (s[1] - s[2], s)):
            if all(b <= x or a >= y for _, x, y in spans):
                spans.append((k, a, b))
        spans.sort(key=lambda s: s[1])
        out.append((text, spans))
        if spans:
            k, a, b = spans[number % len(spans)]
            new = disguised(k, text[a:b], number)
            moved = len(new) - (b - a)
            out.append((text[:a] + new + text[b:], [(k, a, a + len(new)) if s == (k, a, b) else (s[0], s[1] + moved * (s[1] > a), s[2] + moved * (s[1] > a)) for s in spans]))
    return out


def fit(marked: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 120, penalty: float = 0.02, rate: float = 0.2) -> np.ndarray | None:
    """Weights (kind, feature) that maximise the likelihood of the marked segmentations; None without a marked span."""
    sizes, pairs, rows, gold = [], [], [], []
    for text, spans in marked:
        tokens = Tokens(text, 0, len(text))
        found = tokens.segments()
        if not 0 < tokens.n <= 2 * EXCERPT or not len(found):
            continue
        truth = np.zeros((len(found), len(KINDS)))
        place = {(int(tokens.start[i]), int(tokens.end[j - 1])): at for at, (i, j) in enumerate(found)}
        hits = [(place[a, b], k) for k, a, b in spans if (a, b) in place]
        if len(hits) < len(spans):
            continue
        for at, k in hits:
            truth[at, k] = 1
        sizes.append(tokens.n)
        pairs.append(found)
        rows.append(tokens.features(found))
        gold.append(truth)
    if not any(g.any() for g in gold):
        return None
    order = sorted(range(len(sizes)), key=lambda k: sizes[k])
    packs = [order[k : k + 64] for k in range(0, len(order), 64)]  # stretches of like sizes are folded together
    sets = [([sizes[k] for k in pack], [pairs[k] for k in pack], np.concatenate([rows[k] for k in pack]), np.concatenate([gold[k] for k in pack])) for pack in packs]
    weights, first, second = (np.zeros((len(KINDS), FEATURES)) for _ in range(3))
    for step in range(1, rounds + 1):
        slope = -penalty * weights
        for some, spans, x, y in sets:
            slope += (y - _folded(len(KINDS), some, spans, x @ weights.T)[1]).T @ x
        slope /= len(sizes)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def best(candidates: list[tuple[int, int, float, int]], n: int) -> list[tuple[int, int, int]]:
    """(first, after, kind) of the non-overlapping candidates (first, after, score, kind) with the largest sum of scores over n tokens.

    Positions without an entity score nothing, so only candidates with a positive score are asked for, and stretches
    between them are skipped. Of equal sums the one that ends in fewer, earlier entities is taken.
    """
    by_end: dict[int, list[tuple[int, float, int]]] = {}
    for i, j, score, kind in candidates:
        by_end.setdefault(j, []).append((i, score, kind))
    ends = sorted(by_end)
    value, taken = [0.0], [None]
    for j in ends:
        top, how = value[-1], None
        for i, score, kind in sorted(by_end[j]):
            at = bisect_left(ends, i + 1)
            if value[at] + score > top:
                top, how = value[at] + score, (i, j, kind)
        value.append(top)
        taken.append(how)
    out, at = [], len(ends)
    while at:
        if taken[at] is None:
            at -= 1
        else:
            out.append(taken[at])
            at = bisect_left(ends, taken[at][0] + 1)
    return out[::-1]


def added_spans(text: str, weights: np.ndarray, fixed: list[tuple[int, int, int]], block: int = 2048) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) that the field finds in text beside the fixed spans, which no span may touch."""
    out = []
    covered = sorted((a, b) for _, a, b in fixed)
    for start, end in zones(text):
        tokens = Tokens(text, start, end)
        free = np.ones(tokens.n + 1, dtype=np.int64)
        free[0] = 0
        for a, b in covered[max(0, bisect_left(covered, (start, 0)) - 1) :]:
            if a >= end:
                break
            free[1:][(tokens.start < b) & (tokens.end > a)] = 0
        taken = np.cumsum(1 - free)
        chosen = []
        for low in range(0, tokens.n, block):
            pairs = tokens.segments(low, low + block)
            pairs = pairs[taken[pairs[:, 1]] == taken[pairs[:, 0]]]
            if len(pairs):
                scores = tokens.features(pairs) @ weights.T
                for at, kind in zip(*np.nonzero(scores > 0), strict=True):
                    chosen.append((*pairs[at].tolist(), float(scores[at, kind]), int(kind)))
        out += [(k, int(tokens.start[i]), int(tokens.end[j - 1])) for i, j, k in best(chosen, tokens.n)]
    return out


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with [kind] instead of each span; what spans of several kinds cover is named by the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind]}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def fitted(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights of the field, fitted in one task on `sample` excerpts of each kind of personal data and of none.

    Labels are those of the fixed patterns, and one disguised copy of each excerpt that has any. Excerpts are the zones of
    at most 64 tokens in texts with digits or an @; different ones are ranked by hash, so reruns and copies change nothing.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for value in batch.column(0):
                text = value.as_py()
                for start, end in zones(text, 3):
                    if end - start <= 8 * EXCERPT and len(_TOKEN.findall(text, start, end)) <= EXCERPT:
                        excerpt = text[start:end]
                        kinds = {k for k, _, _ in base_spans(excerpt)}
                        out.add((excerpt, min(kinds, default=len(KINDS))))
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in out], type=pa.string()), pa.array([k for _, k in out], type=pa.int64())], names=["excerpt", "kind"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = fit(examples([e for batch in batches for e in batch.column(0).to_pylist()]))
        rows = [] if weights is None else weights.ravel().tolist()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), type=pa.int64()), pa.array(rows, type=pa.float64())], names=["at", "weight"])

    pieces = docs.select("text").where(F.col("text").rlike("[0-9@]")).mapInArrow(cut, "excerpt string, kind long").distinct()
    ranked = pieces.withColumn("_rank", F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("excerpt"), "excerpt"))).where(F.col("_rank") <= sample)
    rows = ranked.select("excerpt").coalesce(1).mapInArrow(learn, "at long, weight double").collect()
    return np.array([r.weight for r in sorted(rows)]).reshape(len(KINDS), FEATURES) if rows else None


def personal_data(docs: DataFrame, weights: np.ndarray | None, with_text: bool = False) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, base) of each row of docs; with_text adds the redacted text.

    Spans of fixed patterns (base) are all kept. The field scores every segment of at most 24 tokens around words with a
    digit, an @, a bracketed at or dot by features of the whole span, and a dynamic program over such bounded segments chooses
    boundaries and kinds together; its spans never touch a base span. Spans are in the order of KINDS, then start. A null
    text is empty, null ids and repeated rows are rows as any other, other columns take no part; weights None: base only.
    Each text is judged whole and alone; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            all_spans, texts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, weights, base) if weights is not None else []
                marked = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                all_spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in marked])
                if with_text:
                    texts.append(redacted(text, [*base, *more]))
            arrays, names = [batch.column(0), pa.array(all_spans, type=pa.list_(one))], ["doc_id", "spans"]
            if with_text:
                arrays, names = [*arrays, pa.array(texts, type=pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}" + (", redacted string" if with_text else ""))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, digest of the base spans, all spans as one string, n_added."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(number(k) for k in KINDS), F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", line)).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
