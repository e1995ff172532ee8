"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words are inserted into a trie and a depth-first walk gives every trie node its *last-token state*: the last
token of the encoding of the node's prefix. The state of a node follows from the state of one of its ancestors, so a
shared prefix is encoded once; a word's ids are read back from its node by hopping over the last tokens.

Texts are split before every space that precedes a non-space character (such a space always starts a pre-token); the
distinct pieces of a batch are encoded once and the ids of all texts gathered from them by array operations.

Edge cases: a null or empty text has no ids and decodes to the empty text; the special token's string inside a text is
that token, as in the library; any Unicode text round-trips; repeated rows are encoded alike; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import byte_slices, settle, small_batches, spans_of, text_column

#: The pre-tokenizer's pattern; a fixed value of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes: a byte that prints stands for itself, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bytes of chunks that a task keeps, longest chunk kept, and pairs of tokens; later ones are encoded for their batch only.
CACHE_BYTES, CACHE_CHUNK, CACHE_PAIRS = 24 << 20, 64, 400_000
#: What a kept chunk takes beside its letters and ids.
CACHE_ENTRY = 200


class Vocabulary:
    """A tokenizer file: token bytes, merges as (left, right) -> token, and each token's two halves."""

    def __init__(self, path: str, merging: bool = True):
        """Without `merging`, the token bytes only."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ()) if t.get("special")}
        self.bytes_of: dict[int, bytes] = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if t not in special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = special
        for content, i in special.items():
            self.bytes_of[i] = content.encode()
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        #: every suffix of a token: the token that it is itself, or -1
        self.suffix: dict[bytes, int] = {}
        self.known: dict[int, bool] = {}
        if not merging:
            return
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = (r, whole)
            if whole not in self.halves:
                self.halves[whole] = (left, right)
                self.rank[whole] = r
        for token in self.id_of:
            for k in range(len(token)):
                self.suffix.setdefault(token[k:], self.id_of.get(token[k:], -1))

    def merged(self, token_bytes: bytes) -> list[int]:
        """The encoding by plain merging, lowest rank first."""
        ids = [self.id_of[bytes((b,))] for b in token_bytes]
        while len(ids) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are when their bytes are encoded together."""
        if len(self.known) >= CACHE_PAIRS:
            self.known.clear()
        known = self.known[left << 20 | right] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        # Undo the merges that built both tokens, latest first: at every stage, a merge across the border must come
        # no earlier than the merge that was undone last.
        last, halves, rank, merge = 1 << 60, self.halves, self.rank, self.merge
        while True:
            across = merge.get((left, right))
            if across is not None and across[0] < last:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                last, left = a, halves[left][1]
            else:
                last, right = b + 1, halves[right][0]


class Trie:
    """Last-token states of all prefixes of the words given, in sorted order (a depth-first walk of their trie)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def encode(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of each distinct word; the path from the root to the last word is the walk's only state.

        The last token of a prefix is the one suffix token that stays whole and fits the last token before it.
        """
        v, out = self.v, {}
        suffix, known, fits, whole = v.suffix.get, v.known.get, v.fits, self._whole
        path: list[int] = []  # last token at depth 1, 2, ...
        sizes: list[int] = []
        before = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del path[shared:], sizes[shared:]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                while True:
                    token = suffix(word[start:end])
                    if token >= 0:
                        if not start:
                            if whole(token):
                                break
                        else:
                            left = path[start - 1]
                            ok = known(left << 20 | token)
                            if fits(left, token) if ok is None else ok:
                                break
                    start -= 1
                path.append(token)
                sizes.append(end - start)
            at = len(word)
            ids = []
            while at:
                ids.append(path[at - 1])
                at -= sizes[at - 1]
            ids.reverse()
            out[word] = tuple(ids)
            before = word
        return out

    @lru_cache(maxsize=100_000)  # noqa: B019
    def _whole(self, token: int) -> bool:
        """Whether the token's bytes, encoded alone, are that one token."""
        halves = self.v.halves.get(token)
        return halves is None or self._whole(halves[0]) and self._whole(halves[1]) and self._built(token)

    def _built(self, token: int) -> bool:
        return self.v.merged(self.v.bytes_of[token]) == [token]


def fast_encoder(path: str, ranks: str | None = None):
    """The same ids from the merge library, for callers that need ids and not the trie; the files hold one vocabulary."""
    import base64

    import tiktoken

    if ranks is None:
        ranks = path[: -len(".json")] + ".tiktoken"
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


class Encoder:
    """Encodes whole batches: every distinct piece of a batch is encoded once, ids are then gathered for all texts.

    `by` is "trie" (the traversal) or "merges" (the library's merge loop over the same vocabulary).
    """

    def __init__(self, path: str, by: str = "trie"):
        self.v = Vocabulary(path, by == "trie")
        self.trie = Trie(self.v)
        self.find = regex.compile(PATTERN).findall
        self.special = list(self.v.special)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.merges = fast_encoder(path) if by == "merges" else None
        top = max(self.v.bytes_of) + 1
        self.known: dict[str, tuple[int, ...]] = {}
        self.room = CACHE_BYTES
        self.decimal = pa.array([f"{i}," for i in range(top)], pa.large_string())
        self.raw = pa.array([self.v.bytes_of.get(i, b"") for i in range(top)], pa.large_binary())

    def _pretokens(self, chunk: str) -> list[str]:
        if chunk[1:].isalpha() and chunk[0] == " ":
            return [chunk]
        if chunk[1:-1].isalpha() and chunk[-1] in ".,;:!?" and chunk[0] == " ":
            return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def chunks_ids(self, chunks: list[str]) -> list:
        """Ids of texts that are free of special tokens; those not yet known by one walk over the trie of their pre-tokens."""
        known = self.known
        new = [c for c in chunks if c not in known]
        got = list(map(self.merges, new)) if self.merges else self._walked(new)
        late = {}
        for c, ids in zip(new, got):
            if self.room > 0 and len(c) <= CACHE_CHUNK:
                known[c] = ids
                self.room -= CACHE_ENTRY + len(c) + 8 * len(ids)
            else:
                late[c] = ids
        return [known[c] if c in known else late[c] for c in chunks] if late else list(map(known.__getitem__, chunks))

    def forget(self) -> None:
        """Drops what was kept; called when a task ends, since workers live on."""
        self.known.clear()
        self.v.known.clear()
        self.room = CACHE_BYTES
        settle()

    def _walked(self, chunks: list[str]) -> list:
        parts = list(map(self._pretokens, chunks))
        words = set(chain.from_iterable(parts))
        ids = self.trie.encode([w.encode() for w in words])
        words_ids = {w: ids[w.encode()] for w in words}
        return [words_ids[p[0]] if len(p) == 1 else tuple(chain.from_iterable([words_ids[w] for w in p])) for p in parts]

    def whole(self, text: str) -> list[int]:
        """Ids of any text; special tokens' strings are those tokens."""
        out: list[int] = []
        for k, part in enumerate(self.split_special(text) if self.split_special else [text]):
            out += (self.v.special[part],) if k % 2 else self.chunks_ids([part])[0] if part else ()
        return out

    def batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (one more at the end)."""
        n = len(text)
        lists = pc.split_pattern(text, " ")
        flat, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        pieces, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        odd = np.fromiter((not p or p[0].isspace() for p in pieces), bool, len(pieces))
        firsts = offsets[:-1]
        later = np.ones(len(codes), bool)
        later[firsts] = False
        used = np.zeros(len(pieces), bool)
        used[codes[later]] = True
        bad = np.zeros(n, bool)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        bad[owner[later & odd[codes]]] = True
        for s in self.special:
            bad |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
        wanted = np.flatnonzero(used & ~odd)
        heads, head_code = np.unique(codes[firsts], return_inverse=True)
        slow = np.flatnonzero(bad)
        chunks = [" " + pieces[k] for k in wanted] + [pieces[k] for k in heads]
        encoded = self.chunks_ids(chunks)
        encoded.append(())
        blank = len(chunks)
        encoded += [self.whole(text[int(k)].as_py()) for k in slow]
        place = np.full(len(pieces), blank, np.int64)
        place[wanted] = np.arange(len(wanted))
        entry = place[codes]
        entry[firsts] = len(wanted) + head_code
        entry[bad[owner]] = blank
        entry[firsts[slow]] = blank + 1 + np.arange(len(slow))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        starts = spans_of(sizes)[:-1]
        took = sizes[entry]
        ends = np.cumsum(took)
        out = ids[np.repeat(starts[entry] - (ends - took), took) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[offsets]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


_ENCODERS: dict = {}


@contextmanager
def encoder(path: str, by: str = "trie"):
    """The worker's encoder for the length of a task; what it kept of the texts goes with the task."""
    if (path, by) not in _ENCODERS:
        _ENCODERS.clear()  # one vocabulary at a time
        _ENCODERS[path, by] = Encoder(path, by)
    try:
        yield _ENCODERS[path, by]
    finally:
        if (path, by) in _ENCODERS:
            _ENCODERS[path, by].forget()


def sliced(table: pa.Array, ids: np.ndarray, offsets: np.ndarray):
    """The joined entries of the ids between each two offsets."""
    got = table.take(pa.array(ids))
    at = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)[offsets]
    data = memoryview(got.buffers()[2]) if got.buffers()[2] else memoryview(b"")
    return [data[a:b] for a, b in zip(at, at[1:])]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


#: Bytes of text encoded at a time.
STEP_BYTES = 8 << 20


def steps(batches, most: int = STEP_BYTES):
    """(doc_id, text) of the batches in a row, in parts of bounded bytes; a longer text is a part of its own."""
    ids, texts, room = [], [], most
    for batch in batches:
        text = text_column(batch)
        size = pc.binary_length(text).to_numpy(zero_copy_only=False)
        for at, end in byte_slices(text, max(most // 4, 1), 1 << 20):
            n = int(size[at:end].sum())
            if n > room and ids:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                settle()
                ids, texts, room = [], [], most
            ids.append(batch.column(0).slice(at, end - at))
            texts.append(text.slice(at, end - at))
            room -= n
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def _digests(path: str):
    def run(batches):
        with encoder(path) as enc:
            for doc_id, text in steps(batches):
                ids, offsets = enc.batch(text)
                a = [hashlib.sha256(x[:-1]).hexdigest() for x in sliced(enc.decimal, ids, offsets)]
                b = [hashlib.sha256(bytes(x).decode("utf-8", "replace").encode()).hexdigest() for x in sliced(enc.raw, ids, offsets)]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(offsets), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every row; no shuffle."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_digests(tokenizer or default_tokenizer()), SCHEMA)


def bpe_encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the ids of every row as an array."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        with encoder(path) as enc:
            for doc_id, text in steps(batches):
                ids, offsets = enc.batch(text)
                yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the text of every row's ids; bytes that are no UTF-8 become U+FFFD, a null list the empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        with encoder(path) as enc:
            for batch in batches:
                out = [enc.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
