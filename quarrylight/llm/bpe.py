"""Exact BPE encoding and decoding (operator 5) and the word-level front end that packing and counts share.

A text is cut at special tokens, NFC-normalised, lower-cased and split into words at white space, then
into pieces by the tokenizer's pattern. Pieces are independent, so their ids are kept in a bounded
memo. A piece is encoded by dynamic programming over its prefixes: a suffix automaton of the
vocabulary walks over the piece and gives, at each position, every token that ends there; the one token
whose pair with the last token of the shorter prefix survives the merge order is that prefix's unique
last token. Following back-pointers from the end emits the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import col, keyed, slices

#: The piece pattern of the tokenizer file, for text without white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: The same for lower-case Latin text, where the standard library's classes say it with these exceptions.
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
#: White space as the tokenizer file's pattern has it; str.split() takes U+001C to U+001F besides.
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_BLANKS = re.compile("[\x1c-\x1f]")
#: Beyond these, case, letters and composition depend on the Unicode version the tokenizer was built with.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
MEMO_WORDS, LIBRARY_WORDS = 250_000, 250_000
END = 256


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """A word-end BPE vocabulary over 512 symbols: a byte, or a byte that ends a word (plus 256)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_symbols()
        self.suffix = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}

        def symbols(token: str) -> tuple[int, ...]:
            ends = token.endswith(self.suffix) and token != self.suffix
            out = [of[c] for c in (token[: -len(self.suffix)] if ends else token)]
            if ends:
                out[-1] += END
            return tuple(out)

        self.symbols = {i: symbols(t) for t, i in model["vocab"].items()}
        vocab = model["vocab"]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if (left, right) not in self.merged:
                self.merged[left, right] = (rank, whole)
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (left, right), rank
        self.pairs: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self._grow_automaton()

    # -- suffix automaton over all token strings

    def _grow_automaton(self) -> None:
        step: list[dict[int, int]] = [{}]
        link, depth = [-1], [0]

        def clone(p: int, c: int, q: int) -> int:
            new = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            depth.append(depth[p] + 1)
            link[q] = new
            while p != -1 and step[p].get(c) == q:
                step[p][c] = new
                p = link[p]
            return new

        for token in self.symbols.values():
            last = 0
            for c in token:
                q = step[last].get(c)
                if q is not None:
                    last = q if depth[q] == depth[last] + 1 else clone(last, c, q)
                    continue
                new, p = len(step), last
                step.append({})
                link.append(0)
                depth.append(depth[last] + 1)
                while p != -1 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p != -1:
                    q = step[p][c]
                    link[new] = q if depth[q] == depth[p] + 1 else clone(p, c, q)
                last = new
        found: list[list[tuple[int, int]] | None] = [None] * len(step)
        for i, token in self.symbols.items():
            if not self.reachable(i):
                continue
            s = 0
            for c in token:
                s = step[s][c]
            if found[s] is None:
                found[s] = []
            found[s].append((len(token), i))
        # the tokens of a state and of its suffixes, longest first: a chain of the states that have any
        chain = [0] * len(step)
        for s in sorted(range(1, len(step)), key=depth.__getitem__):
            chain[s] = link[s] if found[link[s]] else chain[link[s]]
            if found[s]:
                found[s].sort(reverse=True)
        self.step, self.link, self.depth, self.found, self.chain = step, link, array("i", depth), found, chain

    # -- pair compatibility

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of a and b comes up before rank ``before``.

        Both tokens are taken back in the order in which merges made them. While two border symbols
        stand side by side, a merge of them wins if it ranks before whatever made either of them
        grow; on equal rank the left one of two overlapping merges wins.
        """
        grow_a = grow_b = before
        while True:
            if (hit := self.merged.get((a, b))) is not None and hit[0] < grow_a and hit[0] <= grow_b and hit[0] < before:
                return False
            made_a, made_b = self.born.get(a, -1), self.born.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a >= made_b:
                grow_a, a = made_a, self.parts[a][1]
            else:
                grow_b, b = made_b, self.parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens, written side by side, encode to themselves."""
        if len(self.pairs) > 600_000:
            self.pairs.clear()
        known = self.pairs[a << 20 | b] = self._apart(a, b, 1 << 40)
        return known

    def reachable(self, token: int) -> bool:
        """Whether the token's own string encodes to it."""
        if (known := self.sound.get(token)) is None:
            if token not in self.parts:
                known = True
            else:
                a, b = self.parts[token]
                known = self.reachable(a) and self.reachable(b) and self._apart(a, b, self.born[token])
            self.sound[token] = known
        return known

    def encode_symbols(self, word: list[int]) -> list[int]:
        """Ids of one piece: the last token of every prefix, then back-pointers."""
        last: list[int] = [-1] * (len(word) + 1)
        size: list[int] = [0] * (len(word) + 1)
        step, link, depth, found, chain, pairs = self.step, self.link, self.depth, self.found, self.chain, self.pairs
        s = length = end = 0
        for c in word:
            end += 1
            while c not in step[s]:
                s = link[s]
                length = depth[s]
            s = step[s][c]
            length += 1
            at = s if found[s] else chain[s]
            while at:
                for n, token in found[at]:
                    if n > length:
                        continue
                    if n < end:
                        left = last[end - n]
                        if left < 0:
                            continue
                        fits = pairs.get(left << 20 | token)
                        if fits is None:
                            fits = self.compatible(left, token)
                        if not fits:
                            continue
                    last[end], size[end] = token, n
                    at = 0
                    break
                else:
                    at = chain[at]
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        word = list(piece)
        word[-1] += END
        return self.encode_symbols(word)


class FrontEnd:
    """Texts to words and words to pieces, as the tokenizer's normaliser and pattern cut them.

    Latin text takes a plain path. Anything beyond goes through the library's own normaliser and
    pre-tokenizer, whose Unicode tables may be older than Python's.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = specials
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if text.isascii():
            text = text.lower()
        elif BEYOND_LATIN.search(text):
            text = self.tokenizer.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        if ODD_BLANKS.search(text):
            return [w for w in BLANKS.split(text) if w]
        return text.split()

    def units(self, text: str) -> list[str]:
        """Pieces of a Latin text, words of any other: strings that can be encoded by themselves."""
        if text.isascii():
            text = text.lower()
        elif BEYOND_LATIN.search(text):
            return self.words(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        return self.words(text) if ODD_BLANKS.search(text) else LATIN_PIECES.findall(text)

    def split(self, text: str) -> list[tuple[bool, str]]:
        """Special tokens and the texts between them."""
        if "<|" not in text or not self.special.search(text):
            return [(False, text)]
        return [(k % 2 == 1, part) for k, part in enumerate(self.special.split(text)) if part]

    def pieces(self, word: str) -> list[bytes]:
        if not BEYOND_LATIN.search(word):
            return [p.encode("utf-8") for p in PIECES.findall(word)]
        return [bytes(map(self.symbols.__getitem__, p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]


class Memo(dict):
    """Values by word in two generations, so that memory is bounded and frequent words stay."""

    def __init__(self, make, limit: int = MEMO_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= 64:  # longer ones are rare and large
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class Encoder:
    """Texts to ids and back. An entry of the memo: ids as little-endian uint32, decoded tokens."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.front = FrontEnd(path)
        self.memo = Memo(self._unit)

    def _unit(self, unit: str) -> tuple[bytes, bytes]:
        ids = [i for p in self.front.pieces(unit) for i in self.vocabulary.encode_piece(p)]
        return array("I", ids).tobytes(), self._tokens(ids)

    def _tokens(self, ids: list[int]) -> bytes:
        return " ".join(self.vocabulary.text[i] for i in ids).encode("utf-8")

    def entries(self, text: str) -> list[tuple[bytes, bytes]]:
        out: list[tuple[bytes, bytes]] = []
        for special, part in self.front.split(text):
            if special:
                out.append((array("I", [self.front.specials[part]]).tobytes(), part.encode("utf-8")))
            else:
                out += map(self.memo.__getitem__, self.front.units(part))
        return out

    def encode(self, text: str | None) -> bytes:
        """Little-endian uint32 ids."""
        return b"".join([e[0] for e in self.entries(text or "")])

    def decode(self, ids: bytes) -> str:
        """Tokens joined by single spaces: the tokenizer file has no decoder."""
        return " ".join(self.vocabulary.text[i] for i in array("I", ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, *, digests: bool = True) -> DataFrame:
    """Encode every whole text (null: empty).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with ``digests=False`` doc_id, n_tokens, ids
    (little-endian uint32) and decoded. An empty text has no ids and decodes to the empty string.
    Repeated rows give repeated results. Rows are independent: no shuffle, state is a bounded memo.
    """
    kinds = ("string", "string") if digests else ("binary", "string")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), (names[0], pa.string() if digests else pa.binary()), (names[1], pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text"):
            counts, first, second = [], [], []
            for text in col(b, "text").to_pylist():
                found = enc.entries(text)
                ids, decoded = b"".join([e[0] for e in found]), b" ".join([e[1] for e in found])
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(counts, pa.int64()), pa.array(first, out.field(2).type), pa.array(second, pa.string())], schema=out)

    return keyed(docs).select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}")


class LibraryIds:
    """Ids by word from the tokenizers library itself, for operators that only need them fast.

    Pieces that aren't known yet are encoded together, joined by spaces: each ends in the only one of
    its ids that carries the word-end mark, so the ids fall apart again.
    """

    def __init__(self, path: str):
        self.front = FrontEnd(path)
        self.memo = Memo(self._word, LIBRARY_WORDS)
        vocabulary = self.front.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _word(self, word: str) -> bytes:
        return array("I", self.front.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Put pieces into the memo."""
        lines = [" ".join(pieces[i : i + 64]) for i in range(0, len(pieces), 64)]
        ids = np.array([i for e in self.front.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.uint32)
        raw, last = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        found = [raw[x:y] for x, y in zip([0, *last[:-1]], last, strict=True)]
        if len(self.memo) + len(pieces) > self.memo.limit:
            self.memo.old = dict(self.memo)
            self.memo.clear()
        self.memo.update(zip(pieces, found, strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [[(s, p if s else self.front.units(p)) for s, p in self.front.split(t)] for t in texts]
        units: set[str] = set()
        for parts in cut:
            for special, us in parts:
                if not special:
                    units.update(us)
        new = units.difference(self.memo).difference(self.memo.old)
        if pieces := [u for u in new if len(u) <= 64 and (u.isascii() or not BEYOND_LATIN.search(u)) and LATIN_PIECES.fullmatch(u)]:
            self._learn(pieces)
        get, out = self.memo.__getitem__, []
        for parts in cut:
            ids = [array("I", [self.front.specials[p]]).tobytes() if s else b"".join(map(get, p)) for s, p in parts]
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        return out


_LIBRARY: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    """One for each worker process and file; a single thread, since Spark deals out the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryIds(path)
    return _LIBRARY[path]
