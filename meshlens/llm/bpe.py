"""BPE encoding and decoding with a contiguous rank array (operator 2).

A word's parts lie side by side in short arrays: ``bounds`` holds the part boundaries,
``ids`` the part's token and ``ranks`` the merge rank of each part with its right neighbour.
Merging scans ``ranks`` for the smallest entry, deletes one boundary and refreshes the two
neighbouring ranks. Words above ``LONG`` symbols use a heap over the same ranks, since the scan
is quadratic; both give the same tokens.

Vocabulary files are read by path, never copied. Texts are normalised and cut into words by the
rules in the tokenizer file. Defined results: a null text counts as empty; an empty text has no
tokens, and its decoded text is empty; strings of special tokens inside a text become those
tokens, as in the library; repeated rows each give their own row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, worker_cache

NONE = 1 << 60
LONG = 256
SHIFT = 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Codec:
    """Encoder and decoder of one tokenizer file. ``cache_words`` bounds each of two cache generations."""

    def __init__(self, path: str, cache_words: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.pair: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            merged = self.vocab[left + right]
            self.pair.setdefault(self.vocab[left] << SHIFT | self.vocab[right], rank << SHIFT | merged)
        self.tokens = [""] * (1 + max([*self.vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for s, i in self.vocab.items():
            self.tokens[i] = s
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for s, i in self.special.items():
            self.tokens[i] = s
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.words = library.pre_tokenizer.pre_tokenize_str
        self.cache_words, self.fresh, self.stale = cache_words, {}, {}
        self.symbols = byte_symbols()
        self.latin = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def merge(self, word: str) -> list[int]:
        """Token ids of one word, given in byte symbols."""
        n = len(word)
        if n == 0:
            return []
        vocab, get = self.vocab, self.pair.get
        ids = list(map(vocab.__getitem__, word))
        ids[-1] = vocab[word[-1] + self.suffix]
        if n > LONG:
            return self._merge_long(ids)
        bounds = list(range(n + 1))
        ranks = [get(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = low & ((1 << SHIFT) - 1)
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << SHIFT | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pair.get
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (r := get(ids[i] << SHIFT | ids[right[i]])) is not None:
                heapq.heappush(heap, (r >> SHIFT, i, ids[i], ids[right[i]], r & ((1 << SHIFT) - 1)))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = merged, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [ids[i] for i in range(n) if alive[i]]

    def chunk(self, text: str) -> str:
        """Decimal ids, joined by a blank, of a normalised run without blanks; cached."""
        hit = self.fresh.get(text)
        if hit is None:
            hit = self.stale.get(text)
            if hit is None:
                if text.isalpha():  # letters only are one word
                    hit = " ".join(map(str, self.merge(text if text.isascii() else "".join(map(self.symbols.__getitem__, text.encode())))))
                elif len(text) > 1 and text[-1] in ",.!?;:" and text[:-1].isalpha():  # and its mark another
                    hit = self.chunk(text[:-1]) + " " + self.chunk(text[-1])
                else:
                    ids: list[int] = []
                    for word, _ in self.words(text):
                        ids += self.merge(word)
                    hit = " ".join(map(str, ids))
            if len(text) <= 64:
                if len(self.fresh) >= self.cache_words:
                    self.stale, self.fresh = self.fresh, {}
                self.fresh[text] = hit
        return hit

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut at blanks. Latin-1 text is NFC already and lower-cases letter by letter."""
        if self.latin:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                if not any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks to split() alone
                    return text.lower().split()
        return self.normalise(text).split(" ")

    def encode_joined(self, text: str | None) -> tuple[int, str]:
        """(count, ids joined by a space) of a whole text."""
        out = []
        for part in self.split_special.split(text or "") if self.split_special else [text or ""]:
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                out += map(self.chunk, filter(None, self.chunks(part)))
        joined = " ".join(filter(None, out))
        return joined.count(" ") + 1 if joined else 0, joined

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_joined(text)[1]
        return [int(x) for x in joined.split(" ")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer file without a decoder says: the tokens joined by a space, special ones kept."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def decode_joined(self, joined: str) -> str:
        if not joined:
            return ""
        names = self.__dict__.get("names")
        if names is None:
            names = self.names = {str(i): t for i, t in enumerate(self.tokens)}
        return " ".join(map(names.__getitem__, joined.split(" ")))


def codec(path: str, cache_words: int = 300_000) -> Codec:
    """The worker's codec for a file, with its bounded cache of words."""
    return worker_cache(("bpe", path, cache_words), lambda: Codec(path, cache_words))


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("digests",), cache_words: int = 300_000) -> DataFrame:
    """Encode and decode every text.

    Rows: id, n_tokens, then for ``"ids"`` in ``outputs`` ids (array<int>), for ``"decoded"`` the
    decoded text, for ``"digests"`` ids_sha256 and decoded_sha256. One pass, no shuffle.
    """
    cols = ["n_tokens bigint"] + ["ids array<int>"] * ("ids" in outputs) + ["decoded string"] * ("decoded" in outputs)
    cols += ["ids_sha256 string", "decoded_sha256 string"] * ("digests" in outputs)

    def run(texts: list) -> list[list]:
        c = codec(tokenizer_path, cache_words)
        got = {k.split()[0]: [] for k in cols}
        for text in texts:
            n, joined = c.encode_joined(text)
            decoded = c.decode_joined(joined)
            got["n_tokens"].append(n)
            if "ids" in outputs:
                got["ids"].append(np.array(joined.split(" ") if joined else [], np.int32))
            if "decoded" in outputs:
                got["decoded"].append(decoded)
            if "digests" in outputs:
                got["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                got["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return list(got.values())

    return map_texts(docs, text_col, (id_col,), ", ".join(cols), run, rows=500)
