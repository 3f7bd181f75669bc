"""Token ids of whole texts from a public tokenizer file.

The tokenizer drops blanks and treats the parts between them apart, so a text's ids are those of its
words one after another. Words repeat, so each is encoded once and looked up afterwards; the
table of known words is bounded and starts anew when it is full.
"""

from __future__ import annotations

import os

import numpy as np

from docaudit.llm.arrays import WordBlock, ranges, word_block

MAX_KNOWN = 400_000
_PART_BYTES = 1 << 20  # arrays over the bytes of one part stay in cache
_KIND = np.full(256, 3, np.uint8)  # other signs
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_KIND[[*range(ord("0"), ord("9") + 1)]] = 2
_KIND[0x80:] = 1
# A word with one of these is encoded as it stands: contractions, marked tokens, and what is not ASCII but for
# the letters from U+00C0 to U+00FF (whose first byte is 0xC3; 0x97 and 0xB7 end the two signs among them).
_WHOLE = np.zeros(256, bool)
_WHOLE[[ord("'"), ord("<"), 0x97, 0xB7, 0xC2, *range(0xC4, 0x100)]] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _special(word: bytes) -> bool:
    return not word.isascii() or b"'" in word or b"<" in word or any(0x30 <= b < 0x3A for b in word)


class WordTokenizer:
    """Ids of texts in blocks. ``path``: a file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)
        self._slot = np.zeros(0, np.int64)
        self._begin, self._length, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _runs(words: WordBlock) -> WordBlock:
        """Plain words cut where letters, digits and other signs meet."""
        if not len(words.start):
            return words
        whole = np.zeros(len(words.buf) + 1, np.int64)
        np.cumsum(_WHOLE[words.buf], out=whole[1:])
        keep = whole[words.end] > whole[words.start]
        kind = _KIND[words.buf]
        cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        at = np.searchsorted(words.start, cut, "right") - 1
        inner = (at >= 0) & (cut > words.start[at]) & (cut < words.end[at]) & ~keep[at]
        start = np.sort(np.concatenate([words.start, cut[inner]]))
        word = np.searchsorted(words.start, start, "right") - 1
        last = np.append(word[1:] != word[:-1], True)
        end = np.where(last, words.end[word], np.append(start[1:], 0))
        text_of = words.text_of[word]
        offsets = np.searchsorted(text_of, np.arange(len(words.offsets)))
        return WordBlock(words.buf, start, end, text_of, offsets)

    def _slots(self, block: WordBlock) -> np.ndarray:
        hashes, first, inverse = np.unique(block.hashes(), return_index=True, return_inverse=True)
        if len(self._known) + len(hashes) > MAX_KNOWN:
            self._forget()
        at = np.searchsorted(self._known, hashes)
        seen = np.zeros(len(hashes), bool)
        inside = at < len(self._known)
        seen[inside] = self._known[at[inside]] == hashes[inside]
        new = np.flatnonzero(~seen)
        if len(new):
            ids, begin, lengths = self._encode_new([block.word(i) for i in first[new]])
            slots = len(self._length) + np.arange(len(new))
            self._begin = np.append(self._begin, len(self._ids) + begin)
            self._length = np.append(self._length, lengths)
            self._ids = np.append(self._ids, ids)
            self._known = np.insert(self._known, at[new], hashes[new])
            self._slot = np.insert(self._slot, at[new], slots)
        return self._slot[np.searchsorted(self._known, hashes)][inverse]

    def _encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin and how many they are.

        Words of letters alone, or of other ASCII signs alone, are one part for the tokenizer, so many of
        them are encoded as one text and told apart by the part numbers of the ids.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.array([t.isalpha() or not _special(w) for w, t in zip(words, texts, strict=True)])
        parts, size = [np.zeros(0, np.int32)], 0
        begin, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        single, together = list(np.flatnonzero(~plain)), np.flatnonzero(plain)
        for at in range(0, len(together), 4096):
            part = together[at : at + 4096]
            found = self._tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False)
            numbers = np.array(found.word_ids, np.int64)
            n = np.bincount(numbers, minlength=len(part))
            if len(n) > len(part) or not n.all():  # some word is not one part after all
                single.extend(part)
                continue
            begin[part], length[part] = size + np.cumsum(n) - n, n
            parts.append(np.array(found.ids, np.int32))
            size += len(parts[-1])
        alone = self._tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False)
        n = np.fromiter((len(e.ids) for e in alone), np.int64, len(alone))
        begin[single], length[single] = size + np.cumsum(n) - n, n
        parts.append(np.array([i for e in alone for i in e.ids], np.int32))
        return np.concatenate(parts), begin, length

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offset of each text's first (one more at the end)."""
        ids, offsets, size, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
        while at < len(texts):
            end, some = at, 0
            while end < len(texts) and (end == at or some + len(texts[end]) <= _PART_BYTES):
                some += len(texts[end])
                end += 1
            found, where = self._encode_part(texts[at:end], end_id)
            ids.append(found)
            offsets.append(where[1:] + size)
            size, at = size + len(found), end
        return np.concatenate(ids), np.concatenate(offsets)

    def _encode_part(self, texts: list[bytes], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        # The tokenizer lower-cases. To do so before saves words; not where it would change what is composed or marked.
        raw = any(b"\xcc\x87" in t or b"<|" in t for t in texts)
        block = self._runs(word_block(texts, lower=not raw))
        slots = self._slots(block)
        lengths = self._length[slots]
        ids = self._ids[ranges(self._begin[slots], lengths)]
        total = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        offsets = total[block.offsets]
        if end_id is not None:
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
        return ids, offsets
