"""Subword ids of whole text columns by a public tokenizer.

For vocabularies that drop white space, a text's ids are those of its white-space
words one after another, so that each distinct word of a batch is encoded once.
Most words are lower-case Latin letters and perhaps closing punctuation; they need
none of the tokenizer's normalising and splitting, so a copy of it without these
encodes their two parts, many words in a call; where a part ends is told by the id.
All other words go through the whole tokenizer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewheel.llm import textkit

#: Words encoded in one call.
CALL_WORDS = 256
#: Letters and closing signs of words that need no normalising; the end of a word's last piece.
LETTERS, CLOSING, WORD_END = "a-zß-öø-ÿ", ".,!?;:|$%&*#-", "</w>"
PLAIN, SIGNED = f"^[{LETTERS}]+[{CLOSING}]*$", f"^([{LETTERS}]+)([{CLOSING}]+)$"

_coders: dict[str, WordCoder] = {}


def _calls(words: pa.Array) -> Iterator[tuple[int, int, str]]:
    """(first, end, text) of runs of CALL_WORDS words joined by blanks."""
    n = len(words)
    cuts = np.append(np.arange(0, n, CALL_WORDS), n)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar(" ", pa.large_string()))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), texts.to_pylist(), strict=True)


class WordCoder:
    """Encodes string columns."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.bare.encode_special_tokens = True
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.closes[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(WORD_END)]] = True

    def _plain(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids, and how many each word has, of words of letters and closing signs: one or two parts each."""
        spaced = pc.replace_substring_regex(words, SIGNED, r"\1 \2")
        parts = 1 + (pc.binary_length(spaced).to_numpy() > pc.binary_length(words).to_numpy())
        ids, sizes = [], []
        for a, b, text in _calls(spaced):
            ids.append(np.asarray(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32))
            part = np.cumsum(self.closes[ids[-1]]) - self.closes[ids[-1]]
            sizes.append(np.bincount(np.repeat(np.arange(b - a), parts[a:b])[part], minlength=b - a))
        return ids, sizes

    def _other(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        lengths, ids, sizes = pc.utf8_length(words).to_numpy(), [], []
        for a, b, text in _calls(words):
            found = self.tokenizer.encode(text, add_special_tokens=False)
            begins = np.concatenate([[0], np.cumsum(lengths[a:b] + 1)])
            at = np.fromiter((x for x, _ in found.offsets), dtype=np.int64, count=len(found.ids))
            ids.append(np.asarray(found.ids, dtype=np.uint32))
            sizes.append(np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=b - a)[: b - a])
        return ids, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offsets of the rows; null texts have none."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(textkit.plain(texts)))
        coded = lists.flatten().dictionary_encode()
        bounds = np.asarray(lists.offsets.to_numpy(), dtype=np.int64)
        if not len(coded):
            return np.zeros(0, dtype=np.uint32), bounds - bounds[0]
        words = coded.dictionary
        plain = pc.match_substring_regex(words, PLAIN)
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        one, two = self._plain(words.filter(plain)), self._other(words.filter(pc.invert(plain)))
        ids, own = np.concatenate(one[0] + two[0]), np.concatenate(one[1] + two[1])
        starts, sizes = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        starts[order], sizes[order] = np.cumsum(own) - own, own
        slot = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[slot]
        ends = np.concatenate([[0], np.cumsum(each)])
        take = np.arange(ends[-1]) + np.repeat(starts[slot] - ends[:-1], each)
        return ids[take], ends[bounds - bounds[0]]


def coder(path: str) -> WordCoder:
    """This worker's coder of a vocabulary file."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
