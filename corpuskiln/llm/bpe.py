"""Byte-level BPE of a public tokenizer in numpy.

A text is split into words as the tokenizer's pattern does (`split_words`: runs of equal character class in one flat
array of code points, no regular expression per word). Distinct words that were not seen before are encoded together in
merge rounds (`encode_words`): the symbols of all words lie in one flat array; each round looks the keys of all adjacent
pairs up by binary search in the sorted pair keys, takes the lowest rank of each word, and merges every occurrence of
that pair from the left. A round merges all occurrences at once because a pair that a merge creates always has a higher
rank than the merge itself. Words without a known pair leave the array. A word of very many bytes goes through the same
rounds in an array of its own, in which a round looks up only the pairs that the round before has changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Words of more bytes have an array of their own: their many rounds would each look up all pairs of the whole batch.
LONG_WORD = 2048
#: Words kept with their ids in a worker; beyond, the cache starts anew. It bounds memory and changes no result.
CACHE_WORDS = 1_000_000
#: Characters handled at once.
CHUNK_CHARS = 2_000_000


def byte_names() -> dict[str, int]:
    """The printable character by which the vocabulary file names each byte: itself where it prints, else the next free
    code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return names | {chr(256 + k): b for k, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other, of the Unicode version that the tokenizer's
    library splits by (another version would differ in newly assigned letters)."""
    from tokenizers import Regex, pre_tokenizers

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(every[k : k + 1024]) for k in range(0, len(every), 1024)]
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        found = "".join(piece for block in blocks for piece, _ in split.pre_tokenize_str(block))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


class ByteBpe:
    """A vocabulary, ready for numpy. Small (about 2 MB) and of fixed size: fit for a broadcast."""

    def __init__(self, path: str = DEFAULT_TOKENIZER):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, names = model["vocab"], byte_names()
        self.byte_ids = np.zeros(256, np.int32)
        for name, byte in names.items():
            self.byte_ids[byte] = vocab[name]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError(f"{path}: pair keys hold token ids of 16 bits")
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.classes = character_classes()
        self.size = len(vocab)
        self._start_cache()

    def _start_cache(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "ids", "offsets")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start_cache()

    def token_bytes(self) -> dict[int, bytes]:
        """The bytes of every token that single bytes and merges give."""
        known = {int(t): bytes([b]) for b, t in enumerate(self.byte_ids)}
        for at in np.argsort(self.ranks):
            left, right = int(self.keys[at]) >> 16, int(self.keys[at]) & 0xFFFF
            known[int(self.made[at])] = known[left] + known[right]
        return known

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted pair keys, -1 if it is none."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def boundaries(self, text: str, lengths: np.ndarray) -> np.ndarray:
        """Where words start in the concatenated texts of the given lengths."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cps)
        kind = self.classes[cps]
        first = np.zeros(n + 1, bool)
        first[np.concatenate([[0], np.cumsum(lengths)])] = True
        first[n] = True
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # the last of several white-space characters before a word: a space joins the word, another stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        start[last] = True
        start[last[cps[last] == 0x20] + 1] = False
        # an apostrophe that starts a word takes one of the short endings with it
        quote = np.flatnonzero(cps == 0x27)
        quote = quote[start[quote] & ~first[quote + 1]]
        if len(quote):
            a = cps[quote + 1]
            deep = quote + 2 < n
            b = np.where(deep & ~first[np.minimum(quote + 2, n)], cps[np.minimum(quote + 2, n - 1)], 0)
            one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
            two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for taken, length in ((quote[one], 2), (quote[two], 3)):
                start[taken + 1] = False
                start[taken + length] = True
        return np.flatnonzero(start)

    def split_words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all texts, and the number of words of each text. No text may be empty."""
        text, lengths = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        at = self.boundaries(text, lengths)
        ends = np.cumsum(lengths)
        counts = np.diff(np.concatenate([[0], np.searchsorted(at, ends)]))
        cut = at.tolist()
        return [text[a:b] for a, b in zip(cut, cut[1:])], counts

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the offsets of the words in it."""
        return self.encode_bytes([w.encode("utf-8", "surrogatepass") for w in words])

    def encode_bytes(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words given by their bytes."""
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        long = np.flatnonzero(lengths > LONG_WORD)
        done = [(np.full(len(ids), k, np.int64), ids) for k in long.tolist() for ids in [self._encode_long(raw[k])]]
        if len(long):
            raw = [b"" if len(r) > LONG_WORD else r for r in raw]
            lengths[long] = 0
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        while len(symbols):
            at = np.full(len(symbols), -1, np.int64)
            at[:-1] = self.lookup((symbols[:-1].astype(np.int64) << 16) | symbols[1:])
            at[:-1][owner[1:] != owner[:-1]] = -1
            rank = np.where(at >= 0, self.ranks[at], NONE)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            over = lowest == NONE
            if over.any():
                done.append((owner[over], symbols[over]))
                alive = ~over
                symbols, owner, rank, lowest, at = symbols[alive], owner[alive], rank[alive], lowest[alive], at[alive]
            here = np.flatnonzero(rank == lowest)
            if not len(here):
                break
            # of pairs that overlap (one symbol many times in a row) every other one is merged, from the left
            new_run = np.concatenate([[True], np.diff(here) != 1])
            in_run = np.arange(len(here)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            here = here[in_run % 2 == 0]
            symbols[here] = self.made[at[here]]
            keep = np.ones(len(symbols), bool)
            keep[here + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(raw) + 1, np.int64)
        owners, ids = np.concatenate([o for o, _ in done]), np.concatenate([i for _, i in done])
        counts = np.bincount(owners, minlength=len(raw))
        return ids[np.argsort(owners, kind="stable")].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, NONE if it is none, and its place among the pair keys."""
        at = self.lookup((left.astype(np.int64) << 16) | right)
        return np.where(at >= 0, self.ranks[at], NONE), at

    def _encode_long(self, raw: bytes) -> np.ndarray:
        """The merge rounds of one word. Symbols that a merge swallows stay as gaps, with `after` and `before` around them,
        until half of the array is gaps; only pairs next to a merge are looked up again."""
        symbols = self.byte_ids[np.frombuffer(raw, np.uint8)]
        while True:
            n = len(symbols)
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            rank, at = np.full(n, NONE), np.full(n, -1, np.int64)
            rank[: n - 1], at[: n - 1] = self._ranks(symbols[:-1], symbols[1:])
            gaps = np.zeros(n, bool)
            held = n
            while 2 * held > n or n < 64:
                lowest = rank.min()
                if lowest == NONE:
                    return symbols[~gaps].astype(np.int32)
                here = np.flatnonzero(rank == lowest)
                # of pairs that overlap every other one is merged, from the left
                new_run = np.concatenate([[True], after[here[:-1]] != here[1:]])
                in_run = np.arange(len(here)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                here = here[in_run % 2 == 0]
                gone = after[here]
                symbols[here] = self.made[at[here]]
                gaps[gone], rank[gone] = True, NONE
                after[here] = after[gone]
                follows = after[here]
                before[follows[follows < n]] = here[follows < n]
                held -= len(here)
                changed = np.concatenate([here, before[here]])
                changed = np.unique(changed[changed >= 0])
                rank[changed] = NONE
                changed = changed[after[changed] < n]
                rank[changed], at[changed] = self._ranks(symbols[changed], symbols[after[changed]])
            symbols = symbols[~gaps]

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in set(words) if w not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > CACHE_WORDS and self.index:
            self._start_cache()
            return self._learn(words)
        ids, offsets = self.encode_words(new)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def _chunks(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """Texts in groups of about CHUNK_CHARS characters, with the place of the first."""
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= CHUNK_CHARS:
                yield at, texts[at : k + 1]
                at, size = k + 1, 0
        if at < len(texts):
            yield at, texts[at:]

    def _words_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cache index of every word of all texts, and the number of words of each text."""
        filled = [k for k, t in enumerate(texts) if t]
        counts = np.zeros(len(texts), np.int64)
        if not filled:
            return np.zeros(0, np.int64), counts
        words, per_text = self.split_words([texts[k] for k in filled])
        counts[filled] = per_text
        self._learn(words)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the texts in it; null and empty texts have none."""
        parts, lengths = [], np.zeros(len(texts), np.int64)
        for first, chunk in self._chunks(texts):
            word, counts = self._words_of(chunk)
            size = self.offsets[word + 1] - self.offsets[word]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            parts.append(self.ids[np.repeat(self.offsets[word] - (ends - size), size) + np.arange(total)])
            upto = np.concatenate([[0], ends])
            cut = np.concatenate([[0], np.cumsum(counts)])
            lengths[first : first + len(chunk)] = upto[cut[1:]] - upto[cut[:-1]]
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum(lengths)])

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        found = np.zeros(len(texts), np.int64)
        for first, chunk in self._chunks(texts):
            word, counts = self._words_of(chunk)
            upto = np.concatenate([[0], np.cumsum(self.offsets[word + 1] - self.offsets[word])])
            cut = np.concatenate([[0], np.cumsum(counts)])
            found[first : first + len(chunk)] = upto[cut[1:]] - upto[cut[:-1]]
        return found
