"""BPE encoding and decoding (6): the distinct words of a batch, encoded along a trie.

The tokens of a byte string are fixed by its last token: take that away and what is left is encoded
by its own last token. So each prefix needs one state, its last token, and that follows from the
states of shorter prefixes: of the vocabulary's entries that end the prefix, exactly one meets the
state before it without a merge across their border. The sorted distinct words are the trie in
preorder; walking them depth-first keeps the states of one path, and a word starts from the states
of the prefix that it shares with the word before.

Defined results: a null or empty text has no tokens and decodes to the empty text. Special tokens
found in a text stand for themselves, as the vocabulary's library has it. Every row gives a row,
whatever repeats; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import chunks, documents, lean, texts, tune

# Fixed value: how a byte-level vocabulary splits text into words, as published. The library's white space is
# Unicode's White_Space, which `\s` of this regular expression module isn't; it is named in place of `\s`.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Words whose tokens a worker keeps between batches.
KEPT_WORDS = 150_000
#: Pairs of tokens that it knows to meet or not.
KEPT_PAIRS = 300_000
#: Bytes of text whose distinct words share a trie.
TRIE_BYTES = 3 << 20


def check_settings(made: dict) -> None:
    """Raises ValueError where a tokenizer file asks for what this encoder doesn't do."""
    model, split, decoder = made.get("model") or {}, made.get("pre_tokenizer") or {}, made.get("decoder") or {}
    wrong = [k for k in ("normalizer",) if made.get(k)]
    wrong += [f"model.{k}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["model.type"] * (model.get("type", "BPE") != "BPE")
    wrong += ["pre_tokenizer.type"] * (split.get("type") != "ByteLevel") + ["pre_tokenizer.add_prefix_space"] * bool(split.get("add_prefix_space")) + ["pre_tokenizer.use_regex"] * (split.get("use_regex") is False)
    wrong += ["decoder.type"] * (decoder.get("type") != "ByteLevel")
    wrong += [f"added token {t['content']!r}: {k}" for t in made.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if wrong:
        raise ValueError("tokenizer settings that aren't supported: " + ", ".join(wrong))


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizer.json."""

    def __init__(self, source: bytes):
        made = json.loads(source)
        check_settings(made)
        letters = byte_alphabet()
        model = made["model"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.id_of = {as_bytes[t]: i for t, i in model["vocab"].items() if t in as_bytes}
        self.pieces = piece_list(source)
        self.rank = dict.fromkeys((self.id_of[bytes([b])] for b in range(256) if bytes([b]) in self.id_of), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = (self.id_of[as_bytes[x]] for x in (a, b, a + b))
            self.merged[left, right] = whole
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = n, (left, right)
        self.longest = max(map(len, self.id_of))
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        #: the entries that encode to themselves; no other one is ever used
        self.usable = {piece: i for piece, i in self.id_of.items() if self.whole(i)}
        self._splitter = regex.compile(PATTERN)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._tokens: dict[str, bytes] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two when they stand side by side: undoing merges from the latest
        on, no merge across the border comes before the one that is undone."""
        known = self._apart.get((a, b))
        if known is None:
            x, y, before, known = a, b, float("inf"), True
            while True:
                across = self.merged.get((x, y))
                if across is not None and self.rank[across] < before:
                    known = False
                    break
                if self.rank[x] > self.rank[y]:
                    before, x = self.rank[x], self.parts[x][1]
                elif self.rank[y] >= 0:
                    before, y = self.rank[y] + 1, self.parts[y][0]  # of equal merges the left one comes first
                else:
                    break
            self._apart[a, b] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            if token not in self.parts:
                known = self.rank.get(token) == -1
            else:
                a, b = self.parts[token]
                # the two parts may only be merged by the token's own merge: until then they stand apart
                known = self.whole(a) and self.whole(b) and self._meets(a, b, self.rank[token])
            self._whole[token] = known
        return known

    def _meets(self, a: int, b: int, rank: int) -> bool:
        """apart(a, b), but for the merge of a and b itself."""
        x, y, before = a, b, rank
        first = True
        while True:
            across = None if first else self.merged.get((x, y))
            first = False
            if across is not None and self.rank[across] < before:
                return False
            if self.rank[x] > self.rank[y]:
                before, x = self.rank[x], self.parts[x][1]
            elif self.rank[y] >= 0:
                before, y = self.rank[y] + 1, self.parts[y][0]
            else:
                return True

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its tokens, in the trie's preorder."""
        usable, longest, apart, known = self.usable, self.longest, self.apart, self._apart
        path: list[int] = [-1]  # last token of each prefix of `before`
        starts: list[int] = [0]  # and where it begins
        before = b""
        for word in sorted(set(words)):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], starts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    token = usable.get(word[begin:end])
                    if token is not None:
                        if not begin:
                            break
                        at = path[begin]
                        if at >= 0:
                            fits = known.get((at, token))
                            if apart(at, token) if fits is None else fits:
                                break
                else:
                    token, begin = -1, end
                path.append(token)
                starts.append(begin)
            out, end = [], len(word)
            while end:
                if path[end] < 0:
                    raise ValueError(f"the vocabulary can't express {word!r}")
                out.append(path[end])
                end = starts[end]
            out.reverse()
            before = word
            yield word, out

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Each text's token ids as little-endian 32-bit integers."""
        split = []
        for text in batch:
            if self._specials is not None and self._specials.search(text):
                words: list[str | int] = []
                for k, part in enumerate(self._specials.split(text)):
                    words += [self.special[part]] if k % 2 else self._splitter.findall(part)
                split.append(words)
            else:
                split.append(self._splitter.findall(text))
        known = self._tokens
        if len(known) > KEPT_WORDS:
            known.clear()
        if len(self._apart) > KEPT_PAIRS:
            self._apart.clear()
        for i in self.special.values():
            known[i] = np.array([i], "<u4").tobytes()
        new = set().union(*split) - known.keys()
        by_bytes = {w.encode(): w for w in new}
        for word, ids in self.walk(by_bytes):
            known[by_bytes[word]] = np.array(ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        return joined(self.pieces, ids)


def joined(pieces: list[bytes], ids: bytes) -> str:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def piece_list(source: bytes) -> list[bytes]:
    """The bytes of each id: all that decoding needs."""
    made, letters = json.loads(source), byte_alphabet()
    check_settings(made)
    vocab, special = made["model"]["vocab"], {t["content"]: t["id"] for t in made["added_tokens"]}
    out = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for t, i in vocab.items():
        if all(c in letters for c in t):
            out[i] = bytes(letters[c] for c in t)
    for t, i in special.items():
        out[i] = t.encode()
    return out


_loaded: dict[bytes, Vocabulary] = {}


def loaded(source: bytes) -> Vocabulary:
    """One vocabulary for a worker's life."""
    key = hashlib.sha256(source).digest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


def _vocabulary(docs: DataFrame, path: str):
    """The vocabulary's file, which has a fixed size, sent to the executors."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the columns asked for."""
    tune(docs.sparkSession)
    source = _vocabulary(docs, path)
    rows = documents(docs, *more).drop("row_fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(source.value)
        for batch in chunks(batches, TRIE_BYTES):
            ids = vocabulary.encode_batch([t.decode("utf-8", "replace") for t in texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in more), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", *more, "n_tokens", "ids"])

    schema = rows.drop("text").schema.add("n_tokens", "long").add("ids", "binary")
    return rows.mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the decoded text in `decoded`, null where ids are null."""
    source = _vocabulary(encoded, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_list(source.value)
        for batch in batches:
            made = [None if x is None else joined(pieces, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "decoded"])

    names = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*names)
    return rows.mapInArrow(lean(run), rows.select(*names).schema.add("decoded", "string"))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decode(encode(docs, path), path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
