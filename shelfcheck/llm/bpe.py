"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the last token of its BPE encoding is unique. It is the vocabulary
string ``t`` ending the prefix such that the pair (last token of the prefix before ``t``, ``t``)
is compatible: merging the two tokens' bytes by rank leaves exactly this pair. A suffix
automaton over the vocabulary (trie with suffix links) lists the strings that end at each
position; the stored last tokens are followed back from
the end of the word to emit the ids.

Texts are cut as the tokenizer file says (special strings first, then NFC, white space,
lower case, word pattern, byte-level alphabet with a word-end mark). White space ends every
word, so a text is the concatenation of its white-space-separated chunks, and each distinct
chunk is encoded once per worker (bounded cache). Normalising and cutting a distinct chunk
into words uses the library's own normaliser and pre-tokenizer, whose Unicode tables the
result depends on; the ids of the words come from the dynamic programming alone.

Defined cases: a null or empty text has no ids and decodes to the empty string; repeated
rows give repeated results; special strings inside a text become their ids, as the library
does by default. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from os.path import commonprefix

from pyspark.sql import DataFrame

from shelfcheck.llm.util import map_text, worker_state

# Distinct chunks, words and token pairs remembered per worker (bounded memory).
CHUNKS, WORDS, PAIRS = 80_000, 80_000, 250_000

# Characters whose normal form, lower case and class no Unicode version changes: printable
# ASCII and the letters of Latin-1. Chunks of these skip the library's normaliser.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    table = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b != 173}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + sum(x < b for x in range(256) if not (33 <= x <= 126 or 161 <= x != 173)))
    return table


class WordBpe:
    """Exact BPE over words whose last symbol carries the word-end mark."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        import ahocorasick

        self.suffix = suffix
        self.mark = "\ue000"  # one private character stands for the mark inside words
        own = {self._inner(s): i for s, i in vocab.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, merged token)
        made: dict[int, tuple[int, int, int]] = {}              # token -> (left, right, rank)
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = own[self._inner(a)], own[self._inner(b)]
            z = own[self._inner(a) + self._inner(b)]
            self.rank.setdefault((x, y), (r, z))
            made.setdefault(z, (x, y, r))
        self.symbols = {s: i for s, i in own.items() if i not in made and self._symbol(s)}
        # What stands at a token's right (left) edge while it is being built: the nodes on
        # that spine of its merge tree, each with the rank at which it is absorbed.
        self.right_edge, self.left_edge = {}, {}
        for i in own.values():
            self.right_edge[i] = self._spine(made, i, 1)
            self.left_edge[i] = self._spine(made, i, 0)
        self.automaton = ahocorasick.Automaton()
        basic = set(self.symbols.values())
        for s, i in own.items():
            # A string that the merges never make is not a token of any encoding.
            if i in basic or i in made and self._merge(s) == [i]:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def _inner(self, s: str) -> str:
        return s[:-len(self.suffix)] + self.mark if s.endswith(self.suffix) else s

    def _symbol(self, s: str) -> bool:
        return len(s) == 1 or len(s) == 2 and s[1] == self.mark

    @staticmethod
    def _spine(made: dict, token: int, side: int) -> list[tuple[int, float]]:
        nodes = [(token, float("inf"))]
        while token in made:
            rank, token = made[token][2], made[token][side]
            nodes.append((token, rank))
        return nodes

    def _merge(self, s: str) -> list[int]:
        """Merging by rank, used on single vocabulary strings while building."""
        syms = list(s)
        if len(syms) > 1 and syms[-1] == self.mark:
            syms[-2:] = [syms[-2] + self.mark]
        if not all(x in self.symbols for x in syms):
            return []
        ids = [self.symbols[x] for x in syms]
        while len(ids) > 1:
            rank, token, i = min(self.rank.get(p, (1 << 30, -1)) + (i,) for i, p in enumerate(zip(ids, ids[1:])))
            if token < 0:
                break
            ids[i:i + 2] = [token]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """True if encoding the two tokens' joined strings gives just these two tokens.

        A merge across the border happens if some node of the left token's right edge and
        some node of the right token's left edge form a pair whose rank comes before both
        are absorbed (of equal ranks the leftmost merge goes first).
        """
        key = left << 20 | right
        ok = self.pairs.get(key)
        if ok is None:
            ok, rank = True, self.rank
            for x, x_gone in self.right_edge[left]:
                for y, y_gone in self.left_edge[right]:
                    q = rank.get((x, y))
                    if q is not None and q[0] < x_gone and q[0] <= y_gone:
                        ok = False
                        break
                if not ok:
                    break
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one non-empty word in the byte alphabet, without its end mark.

        The automaton names, longest first, the vocabulary strings that end at each
        position; the first compatible one is the prefix's last token.
        """
        n = len(word) + 1
        last = [-1] * (n + 1)   # last token of the prefix of each length
        size = [0] * (n + 1)
        compatible = self.compatible
        for at, (token, length) in self.automaton.iter(word + self.mark):
            end = at + 1
            # No prefix ends between the last character and its mark.
            if last[end] >= 0 or end == n - 1:
                continue
            start = end - length
            if start == 0 or last[start] >= 0 and compatible(last[start], token):
                last[end], size[end] = token, length
        ids, end = [], n
        while end > 0:
            ids.append(last[end])
            end -= size[end]
        ids.reverse()
        return ids


class Recent(dict):
    """Bounded memo of ``make``: when full, the current entries become the old generation
    and entries still in use move over from there."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder for one tokenizer file of the word-end BPE kind."""

    def __init__(self, path: str):
        import regex
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.bpe = WordBpe(model["vocab"], model["merges"], model["end_of_word_suffix"])
        library = tokenizers.Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        # White space as the tokenizer's pattern engine knows it (Unicode White_Space).
        self.space = regex.compile(r"[\p{White_Space}]+")
        self.odd = regex.compile("[\x1c-\x1f]")  # str.split() splits here, the tokenizer does not
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.mark = commonprefix(list(self.special))  # a cheap test that every text with one passes
        self.shown = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.spell = byte_alphabet()
        self.chunks = Recent(self._chunk, CHUNKS)
        self.words = Recent(self._word, WORDS)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            words = _PLAIN_WORD.findall(chunk.lower())
            if not chunk.isascii():
                words = [w.encode().decode("latin-1").translate(self.spell) for w in words]
        else:
            words = [w for w, _ in self.cut(self.normalize(chunk))]
        return b"".join(map(self.words.__getitem__, words))

    def _word(self, word: str) -> bytes:
        return array("I", self.bpe.encode_word(word)).tobytes()

    def _plain(self, text: str) -> bytes:
        parts = text.split() if not self.odd.search(text) else [p for p in self.space.split(text) if p]
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.special or self.mark not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._plain(text[at:m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        """The file names no decoder: token strings, joined by single spaces."""
        return " ".join(map(self.shown.__getitem__, array("I", packed)))


def codec(path: str) -> Codec:
    return worker_state(("bpe", path), lambda: Codec(path))


def encode_decode(docs: DataFrame, tokenizer_path: str, keep: list[str], text: str = "text",
                  full: bool = False) -> DataFrame:
    """``keep`` columns plus n_tokens, ids_sha256, decoded_sha256; with ``full`` also the
    packed ids and the decoded text. A map over the rows: no shuffle."""

    def make():
        c = codec(tokenizer_path)

        def fn(texts):
            out = []
            for t in texts:
                ids = c.encode(t)
                decoded = c.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                       hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                out.append((*row, ids, decoded) if full else row)
            return out
        return fn

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_text(docs, text, keep, fields + (", ids binary, decoded string" if full else ""), make)
