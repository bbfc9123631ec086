"""Token ids by a file of the tokenizers library, each stretch without white space merged once for many texts."""

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

#: Odd stretches remembered at most by one worker.
REMEMBERED = 100_000
#: UTF-8 bytes of texts that are split and merged at once; a longer text is alone.
AT_ONCE = 8 << 20
#: The word split and the normalization for which the short way below is exact.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: A blank as vocabularies write it.
BLANK = "Ġ"
#: Up to here no letter is changed by composition, and lower-casing looks at one letter at a time.
LAST_SIMPLE = "ɏ"
#: Stretches that are one word, or one and a mark after it; İ is not here, as it becomes two characters.
EASY = r"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,;:!?]?$"


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = value = self.make(chunk)
        return value


class TextTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    For tokenizers that drop white space and split words with `WORD_SPLIT`, no token
    spans white space, so that equal stretches have equal ids wherever they stand.
    Such a stretch of simple letters is merged by tiktoken over the file's own
    vocabulary, a blank marking the end of a word; all else goes to the tokenizer.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.split = spec["model"].get("end_of_word_suffix") == WORD_END and WORD_SPLIT in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        if self.split:
            self.marks = tuple(t["content"] for t in spec["added_tokens"])
            self.pieces = regex.compile(WORD_SPLIT)
            ranks = _ranks(spec, self.marks)
            self.words = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(max(ranks.values()) + 1, bool)
            self.ends[[i for token, i in ranks.items() if token.endswith(b" ")]] = True
            self.known = _Memory(self._stretch)

    def _slow(self, text: str) -> bytes:
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)

    def _stretch(self, chunk: str) -> bytes:
        if not (chunk.isascii() or max(chunk) <= LAST_SIMPLE) or any(m in chunk for m in self.marks):
            return self._slow(chunk)
        return _packed(self.words.encode_ordinary("".join(f"{p} " for p in self.pieces.findall(chunk.lower()))))

    def _easy(self, chunks: pa.Array) -> pa.Array:
        """Ids of stretches that match `EASY`, all merged in one call."""
        lower = pc.utf8_lower(chunks)
        marked = pc.binary_join_element_wise(pc.replace_substring_regex(lower, "([.,;:!?])$", r" \1"), "", " ")
        words = pc.subtract(pc.binary_length(marked), pc.binary_length(lower)).to_numpy()
        ids = self.words.encode_to_numpy("".join(marked.to_pylist()), disallowed_special=()).astype("<u4")
        word_ends = np.flatnonzero(self.ends[ids]) + 1
        return _binary(np.append(0, word_ends[np.cumsum(words) - 1]) * 4, ids)

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, memoryview]:
        """The ids of all texts in a row, and where each text's begin and end."""
        split = pc.utf8_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        chunks = found.dictionary
        easy = pc.match_substring_regex(chunks, EASY).to_numpy(zero_copy_only=False)
        odd = [self.known[chunk] for chunk in chunks.filter(pa.array(~easy)).to_pylist()]
        parts = [pa.array(odd, pa.large_binary())]
        if easy.any():
            parts.append(self._easy(chunks.filter(pa.array(easy))))
        place = np.where(easy, len(odd) + np.cumsum(easy) - 1, np.cumsum(~easy) - 1)
        ids = pa.concat_arrays(parts).take(pa.array(place[found.indices.to_numpy()]))
        counts = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
        starts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        return starts[counts], memoryview(ids.buffers()[2] or b"")

    def encode_all(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """The ids of each text in order; a null one is empty."""
        texts = texts.fill_null("")
        if not self.split:
            yield from (self._slow(text.as_py()) for text in texts)
            return
        # the split also cuts at these four, which the tokenizer keeps
        whole = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        group = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // AT_ONCE
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(texts) else ()
        for first, end in zip(cuts, cuts[1:]):
            part = texts.slice(first, end - first)
            slow = whole[first:end]
            at, ids = self._stretches(pc.if_else(pa.array(slow), "", part))
            for i in range(end - first):
                yield self._slow(part[i].as_py()) if slow[i] else ids[at[i] : at[i + 1]]

    def encode(self, text: str) -> bytes:
        return bytes(next(self.encode_all(pa.array([text], pa.string()))))


def _binary(offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _ranks(spec: dict, marks: tuple[str, ...]) -> dict[bytes, int]:
    """The vocabulary by bytes; a blank, which no word holds, marks the end of a word."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {
        bytes(byte[c] for c in token.removesuffix(WORD_END)) + b" " * token.endswith(WORD_END): i
        for token, i in spec["model"]["vocab"].items()
        if token not in marks and BLANK not in token
    }


@lru_cache(maxsize=2)
def tokenizer(path: str) -> TextTokenizer:
    """One per worker process."""
    return TextTokenizer(path)
