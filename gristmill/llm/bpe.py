"""Byte-pair encoding by prefix-sharing trie traversal, and decoding.

The encoding of a prefix is fixed by its last token: it is the one vocabulary
entry that ends the prefix and is compatible with the last token of what stands
before it. A task takes the distinct pieces of its batch in sorted order, which
walks their trie depth first: the stack of last tokens of the common prefix is
kept from piece to piece, so every shared prefix is encoded once. Two tokens are
compatible when merging their symbols together would not join across them. Merges
come in order of rank, and a token's rank is above its parts', so what stands beside
the border at a time is on the right spine of the first token's merge tree and on the
left spine of the second's: one walk down both settles it.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm.storage import shared_value

#: Words whose encodings a Python worker keeps; beyond it those of the current texts stay.
KNOWN_WORDS = 400_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1 << 21
#: Above every rank.
NEVER = 1 << 60
SEPARATORS = regex.compile("[\x1c-\x1f\x85]")


@dataclass(frozen=True)
class Vocabulary:
    """What a word-end BPE tokenizer file defines, ready for a task."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    pattern: str
    special: dict[str, int]
    #: Characters that the library puts in another class than ``regex`` does: one of the right class.
    stand_ins: dict[str, str]
    #: Characters that the library lower-cases in another way than Python does.
    lowers: dict[str, str]


def read_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file of the lower-casing, white-space-dropping kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
        raise ValueError(f"{path} is another kind of tokenizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges_rank = {a + b: k for k, (a, b) in enumerate(merges)}
    if len(merges_rank) < len(merges) or any(merges_rank.get(p, -1) >= k for k, m in enumerate(merges) for p in m):
        raise ValueError(f"{path} has a token of two merges, or a merge before its parts")
    return Vocabulary(model["vocab"], merges, model["end_of_word_suffix"], split, special, *odd_characters(path))


@lru_cache
def odd_characters(path: str) -> tuple[dict[str, str], dict[str, str]]:
    """(stand-ins, lower cases) of the characters whose class or lower case differs between
    the tokenizers library and ``regex`` and Python, which follow other Unicode versions.
    Every character is shown to the library, between letters and between signs."""
    library = Tokenizer.from_file(path)
    assigned = regex.compile(r"[^\p{Cn}\p{Co}\p{Cs}]")
    shown = [c for c in map(chr, range(128, 0x110000)) if assigned.match(c)]
    text = " ".join(f"a{c}a !{c}!" for c in shown)
    whole = {span for _, span in library.pre_tokenizer.pre_tokenize_str(text)}
    classes = ((regex.compile(r"\p{L}"), "ª"), (regex.compile(r"\p{N}"), "²"), (regex.compile(r"\s"), " "), (regex.compile(r"."), "¶"))
    stand_ins, lowers = {}, {}
    for k, c in enumerate(shown):
        at = 8 * k
        if (at, at + 3) in whole:
            real = "ª"
        elif (at + 4, at + 7) in whole:
            real = "¶"
        else:
            real = "²" if (at + 1, at + 2) in whole else " "
        if real != next(mark for pattern, mark in classes if pattern.match(c)):
            stand_ins[c] = real
    folded = library.normalizer.normalize_str("\0".join(c for c in shown if c == unicodedata.normalize("NFC", c))).split("\0")
    for c, low in zip((c for c in shown if c == unicodedata.normalize("NFC", c)), folded, strict=True):
        if low != c.lower() and not c.isspace():
            lowers[c] = low
    return stand_ins, lowers


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes are themselves, the others follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class TrieEncoder:
    """Encodes pieces (strings of byte characters) given in sorted order."""

    def __init__(self, vocabulary: Vocabulary):
        self.ids = vocabulary.ids
        self.suffix = vocabulary.suffix
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(vocabulary.merges):
            pair = (self.ids[a], self.ids[b])
            whole = self.ids[a + b]
            self.rank.setdefault(pair, (rank, whole))
            self.parts.setdefault(whole, pair)
        # every ending of a vocabulary entry, with its id where it is an entry itself and -1 else
        self.open: dict[str, int] = {}
        self.closed: dict[str, int] = {}
        for token in self.ids:
            closing = token.endswith(self.suffix) and token != self.suffix
            body, table = (token.removesuffix(self.suffix), self.closed) if closing else (token, self.open)
            for k in range(len(body)):
                end = body[k:]
                if end in table:
                    break  # its own endings are there already
                table[end] = self.ids.get(end + self.suffix if closing else end, -1)
        self.fits: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        #: Per token, the tokens at its right (left) edge, itself first, each with the
        #: rank at which it was made and the one at which it was merged into the next.
        self.right: dict[int, list[tuple[int, int, int]]] = {}
        self.left: dict[int, list[tuple[int, int, int]]] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        out, gone = [], NEVER
        while token in self.parts:
            made = self.rank[self.parts[token]][0]
            out.append((token, made, gone))
            token, gone = self.parts[token][side], made
        out.append((token, -1, gone))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay so. Of the tokens at the border, the later
        made is undone first; a merge of two joins them if it comes before both are
        merged elsewhere, and at equal rank the pair further left goes first."""
        found = self.fits.get((a, b))
        if found is not None:
            return found
        rights = self.right.get(a)
        if rights is None:
            rights = self.right[a] = self.spine(a, 1)
        lefts = self.left.get(b)
        if lefts is None:
            lefts = self.left[b] = self.spine(b, 0)
        rank, i, j, found = self.rank, 0, 0, True
        while True:
            x, x_made, x_gone = rights[i]
            y, y_made, y_gone = lefts[j]
            merge = rank.get((x, y))
            if merge is not None and merge[0] < x_gone and merge[0] <= y_gone:
                found = False
                break
            if x_made > y_made:
                i += 1
            elif y_made >= 0:
                j += 1
            else:
                break
        if len(self.fits) > 4_000_000:
            self.fits.clear()
        self.fits[a, b] = found
        return found

    def stands(self, token: int) -> bool:
        """Whether the token's own characters merge to it."""
        known = self.alone.get(token)
        if known is None:
            known = token not in self.parts or self.merged(self.symbols(token)) == [token]
            self.alone[token] = known
        return known

    def merged(self, symbols: list[int]) -> list[int]:
        """Merge by rank, lowest first, leftmost first: the definition of the encoding."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min((self.rank.get(p, (NEVER, -1)) for p in zip(symbols, symbols[1:], strict=False)), default=(NEVER, -1))
            if best[1] < 0:
                break
            out, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and self.rank.get((symbols[k], symbols[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out
        return symbols

    def symbols(self, token: int) -> list[int]:
        """The single characters a token was merged from."""
        if token in self.parts:
            a, b = self.parts[token]
            return self.symbols(a) + self.symbols(b)
        return [token]

    def _last(self, piece: str, end: int, table: dict[str, int], last: list[int]) -> tuple[int, int]:
        """(token, its length) that ends the encoding of ``piece[:end]``."""
        endings, size = [], 1
        while size <= end and (token := table.get(piece[end - size : end])) is not None:
            if token >= 0:
                endings.append((token, size))
            size += 1
        fits = self.fits
        for token, size in reversed(endings):
            if size == end:
                if self.stands(token):
                    return token, size
            else:
                pair = (last[end - size - 1], token)
                if fits[pair] if pair in fits else self.compatible(*pair):
                    return token, size
        raise ValueError(f"no token ends {piece[:end]!r}")

    def encode_sorted(self, pieces: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(piece, token ids); ``pieces`` must be sorted and not empty strings.

        The last character of a piece is a symbol of its own, which closes it;
        the states of all shorter prefixes are shared with the next piece."""
        last: list[int] = []  # last token of the encoding of each prefix
        width: list[int] = []  # its length
        before = ""
        for piece in pieces:
            n = len(piece)
            common, most = 0, min(len(before), n - 1, len(last))
            while common < most and before[common] == piece[common]:
                common += 1
            del last[common:], width[common:]
            for end in range(common + 1, n):
                token, size = self._last(piece, end, self.open, last)
                last.append(token)
                width.append(size)
            token, size = self._last(piece, n, self.closed, last)
            out, end = [token], n - size
            while end:
                out.append(last[end - 1])
                end -= width[end - 1]
            before = piece
            yield piece, out[::-1]


class Codec:
    """Encoder and decoder of whole texts.

    Texts are cut at white space; the results of distinct words are kept in a
    table of bounded size, so a word's marks are told apart once.
    """

    def __init__(self, vocabulary: Vocabulary, known: int = KNOWN_WORDS):
        self.encoder = TrieEncoder(vocabulary)
        self.pattern = regex.compile(vocabulary.pattern)
        self.special = vocabulary.special
        self.stand_ins = str.maketrans(vocabulary.stand_ins)
        self.lowers = vocabulary.lowers
        self.at_odd_class, self.at_odd_case = any_of(vocabulary.stand_ins), any_of(vocabulary.lowers)
        longest = sorted(vocabulary.special, key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, longest)) or r"(?!)")
        self.shown = dict(enumerate(byte_characters()))
        self.names = {i: t for t, i in (vocabulary.ids | vocabulary.special).items()}
        self.limit = known
        self.raw: dict[str, bytes] = {}
        self.back: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """White-space-free parts of the normalised text, special tokens in their place."""
        if not self.at_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if not text.isascii() and self.at_odd_case.search(text):
            text = "".join(self.lowers.get(c) or c.lower() for c in text)
        else:
            text = lower_each(text)
        # the separators that str.split takes for white space and the pattern does not
        return self.split(text) if SEPARATORS.search(text) else text.split()

    def split(self, text: str) -> list[str]:
        """The pieces of a text or word, by the library's classes of characters."""
        if text.isascii() or not self.at_odd_class.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]

    def learn(self, texts: list[list[str]]) -> None:
        here = {w for t in texts for w in t}
        new = here - self.raw.keys()
        if len(self.raw) + len(new) > self.limit:
            for table in (self.raw, self.back):
                kept = {w: table[w] for w in here - new}
                table.clear()
                table.update(kept)
        odd = self.at_odd_class.search
        pieces = {w: [w] if w in self.special or (w.isalpha() and (w.isascii() or not odd(w))) else self.split(w) for w in new}
        single = {p for found in pieces.values() for p in found} - self.raw.keys()
        shown = {"".join([self.shown[b] for b in p.encode()]): p for p in single if p not in self.special}
        for word, ids in self.encoder.encode_sorted(sorted(shown)):
            self.raw[shown[word]] = struct.pack(f"<{len(ids)}I", *ids)
            self.back[shown[word]] = " ".join([self.names[i] for i in ids]).encode()
        for piece in single & self.special.keys():
            self.raw[piece] = np.array([self.special[piece]], "<u4").tobytes()
            self.back[piece] = piece.encode()
        for word, found in pieces.items():
            if found != [word]:
                self.raw[word] = b"".join([self.raw[p] for p in found])
                self.back[word] = b" ".join([self.back[p] for p in found])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8) of each text."""
        split = [self.words(t) for t in texts]
        self.learn(split)
        for words in split:
            yield (
                b"".join(map(self.raw.__getitem__, words)),
                b" ".join(filter(None, map(self.back.__getitem__, words))),
            )


def any_of(characters) -> re.Pattern:
    """Pattern of one of the characters, as ranges."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]" if runs else "(?!)")


def lower_each(text: str) -> str:
    """Lower case character by character, as tokenizers do it (a final sigma is not special)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


#: The codec of the Python worker, kept from task to task of one call.
_codecs: dict[str, Codec] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, keys: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """keys, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids`` with ``with_ids``).

    Null and empty texts have no token. Any further columns are left behind; give
    those to keep as ``keys``. Rows are handled one by one, so repeated rows give
    repeated results. Tables and memory of a task are bounded by
    ``KNOWN_WORDS`` and by the longest text.
    """
    frame = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)
    shared = shared_value(docs.sparkSession, vocabulary)
    mark = uuid.uuid4().hex
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def of(batches):
        if mark not in _codecs:
            _codecs.clear()
            _codecs[mark] = Codec(shared.value)
        codec = _codecs[mark]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            row = 0
            while row < len(texts):
                group, chars, first = [], 0, row
                while row < len(texts) and (not group or chars < GROUP_CHARS):
                    group.append(texts[row].as_py() or "")
                    chars += len(group[-1])
                    row += 1
                counts, hashes, decoded, ids = [], [], [], []
                for raw, back in codec.encode(group):
                    counts.append(len(raw) // 4)
                    hashes.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                made = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                made += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
                own = [batch.column(batch.schema.get_field_index(k)).slice(first, row - first) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *made], [*keys, *columns])

    kinds = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return frame.mapInArrow(of, f"{schema}, {kinds}")
