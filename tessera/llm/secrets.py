"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens and adds spans.

Tokens are the text's words; tags are O (outside), B (begins a secret) and I (inside one). A token's score for a tag sums
weights of its own shape, of its neighbours' shapes and of features of the whole file; with tag-to-tag weights, the best
path is found by Viterbi. Weights maximise the conditional likelihood (forward-backward gradients) on windows of a
bounded sample of documents (`SAMPLE`, `WINDOWS`): windows around the patterns' finds are tagged by the patterns, and into
windows without finds go made strings, which no pattern covers: random keys (tagged as secrets) and long harmless strings
such as addresses, dates, paths and joined words (tagged as none). The features are shapes, so the field learns keys of
other make than the patterns' and than those made. Labels are the patterns' and the makers', never a column.

Where O leads both other tags by more than any two transitions could repay, the best path is in O; chains are cut there,
which is exact, and only the stretches between are decoded.

Edge cases: null and empty texts have no spans; a text is scanned whole; overlapping finds of different kinds are all
listed; added spans never overlap base ones: of a tagged stretch that meets base spans, the parts that they leave are
added; repeated rows are scanned each; an empty table gives an empty result and an
untrained field, which adds nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, settle, small_batches, spans_of, text_column

KINDS = ("assign", "access", "hex", "crf")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
#: kind -> (pattern, keeps a match, quick test)
PATTERNS = {
    "assign": (re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6, rf"({_KEYS})[\"']?\x20*[:=]"),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: m.end() - m.start() >= 24, r"[0-9a-f]{24}"),
}
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Documents that the field is trained on, at most; tokens to each side of a secret in a training window.
SAMPLE, AROUND = 2000, 8
#: Training windows, at most (the smallest hashes).
WINDOWS = 6000
#: What documents of the sample's first half contain.
CUES = ("AKIA", "password", "passwd", "secret", "token", "api_key", "apikey")
DIM = 1 << 12
#: What parts tokens.
SPACES = " \t\n\v\f\r"


def base_spans(text: str, kinds=("assign", "access", "hex")) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every match that holds, by start and then kind."""
    out = []
    for rank, kind in enumerate(("assign", "access", "hex")):
        if kind in kinds:
            pattern, holds, _ = PATTERNS[kind]
            # a run of hex digits is maximal, so looking for long runs only finds the same matches
            out += [(m.start(), m.end(), rank) for m in (_HEX if kind == "hex" else pattern).finditer(text) if holds(m)]
    return [(a, b, KINDS[r]) for a, b, r in sorted(out, key=lambda s: (s[0], s[2], s[1]))]


def flagged(text: pa.Array) -> dict[str, np.ndarray]:
    """Which texts can hold each kind, by one linear scan each."""
    return {k: pc.match_substring_regex(text, quick).to_numpy(zero_copy_only=False) for k, (_, _, quick) in PATTERNS.items()}


_LUT = np.zeros((256, 6), np.int32)
for _b in range(256):
    c = chr(_b)
    _LUT[_b] = (48 <= _b < 58, 65 <= _b < 91, 97 <= _b < 123, c in "0123456789abcdefABCDEF", c in "+/_=-:", c in "\"'")
_CLASSES = _LUT.T.copy()


def word_features(words: pa.Array) -> np.ndarray:
    """Indices of the shape features of each (distinct) word: one column for each feature."""
    w = words.cast(pa.large_binary())
    n = len(w)
    if not n:
        return np.zeros((0, 9), np.int64)
    offsets = np.frombuffer(w.buffers()[1], np.int64, n + 1, w.offset * 8)
    data = np.frombuffer(w.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.maximum(np.diff(offsets), 1)
    digit, upper, lower, hexa, sign, quote = (np.diff(np.concatenate([[0], np.cumsum(c[data])])[offsets]) for c in _CLASSES)
    length = np.minimum(np.log2(size) * 2, 15).astype(np.int64)
    share = lambda x: np.minimum(4, (x * 4 + size - 1) // size)
    mixed = (digit > 0).astype(np.int64) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (sign > 0)
    change = np.diff(_CLASSES[0][data], prepend=0) != 0
    change[offsets[:-1][np.diff(offsets) > 0]] = False  # the byte before a word is another word's
    changes = np.minimum(7, np.diff(np.concatenate([[0], np.cumsum(change)])[offsets]))
    key = pc.match_substring_regex(words, _KEYS).to_numpy(zero_copy_only=False).astype(np.int64)
    last = data[np.minimum(np.maximum(offsets[1:] - 1, 0), len(data) - 1)].astype(np.int64)
    first = data[np.minimum(offsets[:-1], len(data) - 1)].astype(np.int64)
    columns = [length, share(digit) * 5 + share(upper), share(hexa) * 16 + length, mixed * 16 + length, changes * 16 + length, key, last * 2 + key, first, (quote > 0) * 2 + key]
    return np.stack([(k * 997 + 31 * c.astype(np.int64)) % DIM for k, c in enumerate(columns)], 1)


class Field:
    """Weights of own, previous and next words' features, of files and of transitions; tags O, B, I."""

    def __init__(self):
        self.w = np.zeros((3, DIM, 3))
        self.file = np.zeros((8, 3))
        self.move = np.zeros((3, 3))
        self.move[0, 2] = -30.0  # I never follows O
        self.start = np.array([0.0, 0.0, -30.0])

    def scores(self, feats: np.ndarray, codes: np.ndarray, first: np.ndarray, last: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Score of each tag for each token; first and last mark the ends of documents."""
        own, before, after = (self.w[k][feats].sum(1) for k in range(3))
        out = own[codes] + self.file[file]
        prev, nxt = np.roll(before[codes], 1, 0), np.roll(after[codes], -1, 0)
        prev[first], nxt[last] = 0, 0
        return out + prev + nxt

    def fit(self, x: np.ndarray, file: np.ndarray, y: np.ndarray, valid: np.ndarray, rounds: int = 40, rate: float = 0.3) -> "Field":
        """x: sequences x positions x 3 x features; y: tags; valid: real positions, first in each sequence."""
        s, t, _, nf = x.shape
        if not s:
            return self
        grad2 = [np.full_like(a, 1e-6) for a in (self.w, self.file, self.move, self.start)]
        gold = np.eye(3)[y] * valid[..., None]
        onset = gold[:, 0].sum(0)
        pairs = valid[:, 1:] & valid[:, :-1]
        gold_move = np.zeros((3, 3))
        np.add.at(gold_move, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        for _ in range(rounds):
            e = sum(self.w[k][x[:, :, k]].sum(2) for k in range(3)) + self.file[file][:, None]
            alpha = np.empty((s, t, 3))
            alpha[:, 0] = e[:, 0] + self.start
            for i in range(1, t):
                step = np.logaddexp.reduce(alpha[:, i - 1, :, None] + self.move, axis=1) + e[:, i]
                alpha[:, i] = np.where(valid[:, i, None], step, alpha[:, i - 1])
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            beta = np.zeros((s, t, 3))
            expected = np.zeros((3, 3))
            for i in range(t - 2, -1, -1):
                step = self.move + (e[:, i + 1] + beta[:, i + 1])[:, None]
                beta[:, i] = np.where(valid[:, i + 1, None], np.logaddexp.reduce(step, axis=2), beta[:, i + 1])
                both = np.exp(alpha[:, i, :, None] + step - z[:, None, None]) * valid[:, i + 1, None, None]
                expected += both.sum(0)
            p = np.exp(alpha + beta - z[:, None, None]) * valid[..., None]
            d = (gold - p).reshape(-1, 3)
            g = [np.zeros_like(self.w), np.zeros_like(self.file), gold_move - expected, onset - p[:, 0].sum(0)]
            for k in range(3):
                for f in range(nf):
                    idx = x[:, :, k, f].ravel()
                    for c in range(3):
                        g[0][k, :, c] += np.bincount(idx, d[:, c], DIM)
            np.add.at(g[1], file, (gold - p).sum(1))
            for a, b, h in zip((self.w, self.file, self.move, self.start), g, grad2):
                b = b - 0.05 * a
                h += b * b
                a += rate * b / np.sqrt(h)
            self.move[0, 2] = min(self.move[0, 2], -10.0)
            self.start[2] = min(self.start[2], -10.0)
        return self

    def viterbi(self, e: np.ndarray, at_start: bool, before_outside: bool = False) -> list[int]:
        """Tags of the best path; `before_outside`: a token outside follows."""
        best = e[0] + (self.start if at_start else self.move[0])
        back = []
        for row in e[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(0))
            best = step.max(0) + row
        tag = int((best + self.move[:, 0] if before_outside else best).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]

    def slack(self) -> float:
        """More than a stretch in another tag can gain by its transitions, for each token of it."""
        into = max(self.move[0, 1], self.start[1]) - min(self.move[0, 0], self.start[0])
        inside = self.move[1:, 1:].max() - self.move[0, 0]
        return float(max(0.0, into + max(0.0, self.move[1:, 0].max() - self.move[0, 0]), inside + max(0.0, self.move[1:, 0].max() - self.move[0, 0])))

    def tags(self, e: np.ndarray, first: np.ndarray) -> list[tuple[int, list[int]]]:
        """(begin, tags) of the stretches where the best path may leave O."""
        lead = e[:, 0] - e[:, 1:].max(1)
        live = np.flatnonzero(lead < self.slack())
        if not len(live):
            return []
        starts = np.zeros(len(e), bool)
        starts[first] = True
        cut = np.flatnonzero((np.diff(live) > 1) | starts[live[1:]]) + 1
        goes_on = np.append(~starts[1:], False)  # the token has a next one in its text
        return [(int(r[0]), self.viterbi(e[r[0] : r[-1] + 1], bool(starts[r[0]]), bool(goes_on[r[-1]]))) for r in np.split(live, cut)]


class Tokens:
    """The words of a batch of texts with their places in code points."""

    def __init__(self, text: pa.Array):
        lists = pc.ascii_split_whitespace(text)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(text)), np.diff(offsets))
        # white space is one byte, so a piece begins one byte after the end of the one before it ... but runs of white
        # space collapse; places are therefore read off the bytes themselves
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.begin = at - at[0]
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.ones(len(data) + 1, bool)
        edge[1:] = np.concatenate([space])
        edge[self.begin] = True
        self.first_byte = np.flatnonzero(edge[:-1] & ~space) if len(data) else np.zeros(0, np.int64)
        full = size > 0
        self.words, self.size, self.owner = flat.filter(pa.array(full)), size[full], owner[full]
        self.point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        n = np.bincount(self.owner, minlength=len(text))
        self.offsets = spans_of(n)
        encoded = self.words.dictionary_encode()
        self.codes, self.feats = encoded.indices.to_numpy().astype(np.int64), word_features(encoded.dictionary)
        ends = self.offsets[1:][n > 0] - 1
        self.first, self.last = self.offsets[:-1][n > 0], ends
        digits = np.diff(np.concatenate([[0], np.cumsum(_CLASSES[0][data])])[self.begin])
        signs = np.diff(np.concatenate([[0], np.cumsum(data == 61)])[self.begin])
        total = np.maximum(np.diff(self.begin), 1)
        self.file = np.minimum(3, (digits * 200 // total)) + 4 * (signs > 0)

    def start(self, k) -> np.ndarray:
        return self.point[self.first_byte[k]] - self.point[self.begin[self.owner[k]]]

    def end(self, k) -> np.ndarray:
        return self.point[self.first_byte[k] + self.size[k]] - self.point[self.begin[self.owner[k]]]


def left_over(a: int, b: int, spans: list[tuple[int, int, str]], text: str) -> list[tuple[int, int]]:
    """The parts of a to b that no span covers (spans by start), without white space at their ends."""
    parts, at = [], a
    for x, y, _ in spans:
        if x < b and y > at:
            parts.append((at, x))
            at = y
    parts.append((at, b))
    out = []
    for x, y in parts:
        if x < y and (part := text[x:y].strip(SPACES)):
            x += len(text[x:y]) - len(text[x:y].lstrip(SPACES))
            out.append((x, x + len(part)))
    return out


#: Bytes of text scanned at a time.
SCANNED = 1 << 20


def scan(text: pa.Array, field: Field | None) -> tuple[list[list], list[list]]:
    """Base spans and added spans (start, end, kind) of each text, a megabyte at a time."""
    base: list[list] = []
    added: list[list] = []
    for lo, end in byte_slices(text, SCANNED):
        b, a = _scan(pa.concat_arrays([text.slice(lo, end - lo)]), field)
        base += b
        added += a
    return base, added


def _scan(text: pa.Array, field: Field | None) -> tuple[list[list], list[list]]:
    marks = flagged(text)
    base: list[list] = [[] for _ in range(len(text))]
    for k in np.flatnonzero(marks["assign"] | marks["access"] | marks["hex"]):
        base[k] = base_spans(text[int(k)].as_py(), [x for x in marks if marks[x][k]])
    added: list[list] = [[] for _ in range(len(text))]
    if field is not None and len(text):
        t = Tokens(text)
        if len(t.codes):
            e = field.scores(t.feats, t.codes, t.first, t.last, t.file[t.owner])
            whole = -1, ""  # the text looked at last
            for begin, tags in field.tags(e, t.first):
                k = 0
                while k < len(tags):
                    if tags[k]:
                        stop = k + 1
                        while stop < len(tags) and tags[stop] == 2:
                            stop += 1
                        d = int(t.owner[begin + k])
                        a, b = int(t.start(begin + k)), int(t.end(begin + stop - 1))
                        if any(a < y and x < b for x, y, _ in base[d]):
                            if whole[0] != d:
                                whole = d, text[d].as_py()
                            added[d] += [(x, y, "crf") for x, y in left_over(a, b, base[d], whole[1])]
                        else:
                            added[d].append((a, b, "crf"))
                        k = stop
                    else:
                        k += 1
    return base, added


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits the field on windows of at most `sample` documents with secrets and as many without; smallest hashes of the text."""
    has = F.col("text").contains(CUES[0])
    for cue in CUES[1:]:
        has = has | F.col("text").contains(cue)
    ranked = docs.select("text", F.xxhash64("text").alias("h"), has.alias("has")).where("text IS NOT NULL AND text <> ''")

    def windows(batches):
        for batch in batches:
            whole, hashes = text_column(batch), batch.column(1).to_numpy()
            for at, stop in byte_slices(whole):
                text, h = pa.concat_arrays([whole.slice(at, stop - at)]), hashes[at:stop]
                base, _ = scan(text, None)
                t = Tokens(text)
                every = np.arange(len(t.codes))
                a, b = (t.start(every), t.end(every)) if len(every) else (every, every)
                tag = np.zeros(len(every), np.int64)
                for d, spans in enumerate(base):
                    lo, hi = t.offsets[d], t.offsets[d + 1]
                    for x, y, _ in spans:
                        i, j = lo + np.searchsorted(b[lo:hi], x, side="right"), lo + np.searchsorted(a[lo:hi], y, side="left")
                        if i < j and not tag[i]:
                            tag[i] = 1
                            tag[i + 1 : j] = 2
                hit = np.flatnonzero(tag == 1)
                for d in range(len(text)):
                    lo, hi = int(t.offsets[d]), int(t.offsets[d + 1])
                    if lo == hi:
                        continue
                    for c in [*hit[np.searchsorted(hit, lo) : np.searchsorted(hit, hi)].tolist(), lo + int(h[d] % (hi - lo))]:
                        p, q = max(lo, c - AROUND), min(hi, c + AROUND + 1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t.feats[t.codes[p:q]].ravel().tolist()], pa.list_(pa.int32())), pa.array([tag[p:q].tolist()], pa.list_(pa.int32())), pa.array([int(t.file[d])], pa.int32())], ["feats", "tags", "file"]
                        )

    def least(x: bool) -> DataFrame:
        """The rows of the smallest hashes; a bound from the hashes alone comes first, so that few texts travel."""
        mine = ranked.where(F.col("has") == x)
        bound = mine.select("h").orderBy("h").limit(sample // 2).agg(F.max("h")).first()[0]
        return mine.where(F.col("h") <= F.lit(bound).cast("long")).orderBy("h").limit(sample // 2).select("text", "h")

    parts = [least(x) for x in (True, False)]
    found = parts[0].unionByName(parts[1]).mapInArrow(windows, "feats array<int>, tags array<int>, file int")
    got = found.orderBy(F.xxhash64("feats", "tags", "file")).limit(WINDOWS).toArrow().to_pylist()
    got.sort(key=lambda r: (r["feats"], r["tags"], r["file"]))
    got = [(np.array(r["feats"], np.int64).reshape(-1, 9), r["tags"], r["file"]) for r in got if r["tags"] and r["tags"][0] != 2]
    if not got:
        return Field()
    got += made_windows(got)
    width = 2 * AROUND + 1
    feats = np.full((len(got), width + 2, 9), DIM - 1)
    y, valid = np.zeros((len(got), width), np.int64), np.zeros((len(got), width), bool)
    for k, (f, tags, _) in enumerate(got):
        feats[k, 1 : len(f) + 1] = f
        y[k, : len(f)], valid[k, : len(f)] = tags, True
    x = np.stack([feats[:, 1:-1], feats[:, :-2], feats[:, 2:]], 2)
    return Field().fit(x, np.array([w[2] for w in got]), y, valid)


_LOWER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = (_LOWER + _LOWER.upper() + _DIGIT, _LOWER + _LOWER.upper() + _DIGIT + "+/", _LOWER + _LOWER.upper() + _DIGIT + "-_", _LOWER.upper() + _DIGIT, _LOWER + _DIGIT)


def made_key(rng) -> str:
    """A random string of a random alphabet, at times in dotted parts, behind a short prefix or ended like base64."""
    letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
    parts = 1 if rng.random() < 0.8 else int(rng.integers(2, 4))
    key = ".".join("".join(rng.choice(list(letters), int(rng.integers(16, 49)))) for _ in range(parts))
    if rng.random() < 0.5:
        key = "".join(rng.choice(list(_LOWER), int(rng.integers(2, 5)))) + "_-."[rng.integers(3)] + key
    return key + "=" * int(rng.integers(3)) if "+" in letters else key


def made_harmless(rng, words: list[str]) -> str:
    """A long string that is no secret: addresses, dates, paths, numbers, joined or shouted words."""
    w = [words[int(k)] for k in rng.integers(len(words), size=4)]
    n = [int(k) for k in rng.integers(1, 3000, size=4)]
    kinds = (
        f"https://www.{w[0]}.com/{w[1]}/{n[0]}?{w[2]}={n[1]}", f"{w[0]}.{w[1]}@{w[2]}.org", f"20{n[0] % 100:02}-{n[1] % 12 + 1:02}-{n[2] % 28 + 1:02}T{n[3] % 24:02}:{n[0] % 60:02}:{n[1] % 60:02}Z",
        f"/{w[0]}/{w[1]}/{w[2]}.html", "".join(w), "-".join(w), "_".join(w).upper() + "!!", "".join(x.title() for x in w), f"+{n[0]}-{n[1]}-{n[2]}", f"{n[0]},{n[1]:03}.{n[2] % 100:02}", f"{w[0]}{n[0]}", f"({w[0].upper()})", f"v{n[0] % 9}.{n[1] % 20}.{n[2] % 50}-{w[0]}",
    )
    return kinds[int(rng.integers(len(kinds)))]


def made_windows(windows: list) -> list:
    """Windows without finds again, once with a made key and twice with a harmless string in place of one word."""
    rng = np.random.default_rng(20240229)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = ["".join(rng.choice(syllables, int(rng.integers(2, 5)))) for _ in range(300)]
    out = []
    for feats, tags, file in windows:
        if any(tags):
            continue
        strings = [made_key(rng), made_harmless(rng, words), made_harmless(rng, words)]
        for k, new in enumerate(word_features(pa.array(strings, pa.large_string()))):
            f, at = feats.copy(), int(rng.integers(len(feats)))
            f[at] = new
            out.append((f, [int(i == at and k == 0) for i in range(len(feats))], file))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")])


def secret_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text; one map, no shuffle."""

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            base, added = scan(text_column(batch), field)
            counts = [[sum(s[2] == k for s in spans) for spans in base] for k in KINDS[:3]]
            digest = [hashlib.sha256(joined(s).encode()).hexdigest() for s in base]
            every = [joined(sorted(s + a, key=lambda x: (x[0], KINDS.index(x[2])))) for s, a in zip(base, added)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string())], SCHEMA.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame, field: Field, mark: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """docs with every span replaced by `mark`; a column named `length` gets the new number of characters."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            text = text_column(batch)
            base, added = scan(text, field)
            columns = list(batch.columns)
            change = [k for k in range(len(text)) if base[k] or added[k]]
            new = columns[names.index("text")].to_pylist()
            sizes = columns[names.index(length)].to_pylist() if length else []
            for k in change:
                out, at = [], 0
                for a, b, _ in sorted(base[k] + added[k]):
                    if a >= at:
                        out += [new[k][at:a], mark]
                    at = max(at, b)
                new[k] = "".join(out) + new[k][at:]
                if length:
                    sizes[k] = len(new[k])
            columns[names.index("text")] = pa.array(new, pa.string())
            if length:
                columns[names.index(length)] = pa.array(sizes, columns[names.index(length)].type)
            yield pa.RecordBatch.from_arrays(columns, names)
            del batch, text, base, added, columns, change, new, sizes
            settle()

    return docs.mapInArrow(run, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_spans(docs, train(docs))
