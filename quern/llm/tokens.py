"""Ids of public JSON vocabularies, equal to those of the tokenizers library.

The library's own speed on text with many rare words is about 2 MB/s a core. Two exact ways are faster, for two kinds of vocabulary:

* byte-level, where a token's id is its merge's place: tiktoken, fed with the same table;
* pre-tokens without white space and ends of words: chunks cut at white space, their pieces by the vocabulary's split pattern, merged by
  tiktoken with a table that holds the ends, with bounded caches.

Texts with characters outside PLAIN (where libraries' Unicode versions may differ), odd separators, or the string of an added token (which
has its own id), and all other vocabularies go through the tokenizers library itself, with its defaults.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np
import regex

from quern.llm.pairs import Memo

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks, and pieces, kept in a Python worker's cache; it is emptied when full.
CACHE_CHUNKS = 800_000

_SEPARATORS = r"\x1c-\x1f"
_ODD_SPACE = re.compile(rf"[{_SEPARATORS}\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]")
#: Latin letters, and general punctuation, in all Unicode versions.
_NOT_PLAIN = re.compile(rf"[{_SEPARATORS}]|[^\x00-\u024f\u2010-\u2027\u20ac]")
#: The split pattern of byte-level pre-tokenizers (a fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def plain_chunks(text: str) -> list[str] | None:
    """Chunks that no byte-level pre-token crosses, or None if white space isn't plain.

    Cut before a space or newline that stands alone between other characters, and after such a newline.
    """
    if _ODD_SPACE.search(text):
        return None
    return text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")


def is_plain(text: str) -> bool:
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _NOT_PLAIN.search(text)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies' letter for each byte: printable Latin-1 characters stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class JsonTokenizer:
    """encode(texts): little-endian ids of self.dtype; no special tokens are added, those whose strings a text holds are found."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.cache_chunks = cache_chunks
        spec = json.loads(self.library.to_str())
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None  # some are looked for in normalised text
        self.fast = self._byte_level(spec) or self._word_ends(spec)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """A few hundred texts at most in a call."""
        if self.fast is None:
            return [self.whole(t) for t in texts]
        plain = [is_plain(t) and not (self.added and self.added.search(t)) for t in texts]
        got = iter(self.fast([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(got) if p else self.whole(t) for t, p in zip(texts, plain, strict=True)]

    def _merges(self, spec: dict) -> list[tuple[str, str]] | None:
        model = spec["model"]
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk")):
            return None
        return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]

    def _byte_level(self, spec: dict):
        """For vocabularies of 256 bytes, then a token for each merge."""
        pre, merges = spec.get("pre_tokenizer") or {}, self._merges(spec)
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer") or merges is None or spec["model"].get("end_of_word_suffix"):
            return None
        vocab, back = spec["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        import tiktoken

        ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocab.items()}
        coder = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_to_numpy(t, disallowed_special=()).astype(self.dtype).tobytes() for t in texts]

    def _word_ends(self, spec: dict):
        """For vocabularies that drop white space and mark the ends of words."""
        pre, normal, merges, suffix = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, self._merges(spec), spec["model"].get("end_of_word_suffix")
        steps, normals = pre.get("pretokenizers") or [{}], [x.get("type") for x in normal.get("normalizers", [])]
        if merges is None or not suffix or normals != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in steps] != ["Split", "ByteLevel"]:
            return None
        split = steps[0]
        if split.get("behavior") != "Removed" or not split.get("invert") or steps[1].get("use_regex") or steps[1].get("add_prefix_space"):
            return None
        # Ids must be: 256 bytes, 256 bytes at a word's end, a token for each merge. As ranks, with a byte that UTF-8 never has for
        # the word's end, the ends are joined to their bytes first, then pairs merge in order.
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        if any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 512 + len(merges):
            return None
        ranks = {bytes(map(back.__getitem__, t.removesuffix(suffix))) + b"\xff" * t.endswith(suffix): i for t, i in vocab.items()}
        if len(ranks) != len(vocab) or any(not t.removesuffix(suffix) for t in vocab) or b"\xff" not in ranks or b"\xff\xff" not in ranks:
            return None
        single = [t for t in ranks if len(t) == 1 or len(t) == 2 and t[1] == 255]
        if len(single) < 512 or any(ranks[t] >= 512 for t in single):
            return None
        import tiktoken

        pattern, coder = regex.compile(split["pattern"]["Regex"]), tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        pack = self.dtype.type
        pieces = Memo(lambda new: [np.array(coder(p.encode() + b"\xff"), dtype=pack).tobytes() for p in new], self.cache_chunks)

        def cut(chunk: str) -> list[str]:
            if chunk.isalpha():
                return [chunk]
            return [chunk[:-1], chunk[-1]] if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?" else pattern.findall(chunk)

        chunks = Memo(lambda new: pieces.join(list(map(cut, new))), self.cache_chunks)
        # Plain texts are in NFC already, and lower-casing them does not look at context.
        return lambda texts: chunks.join([t.lower().split() for t in texts])


_loaded: dict[str, JsonTokenizer] = {}


def tokenizer(path: str) -> JsonTokenizer:
    """One tokenizer for each Python worker and path; its cache lasts over tasks."""
    if path not in _loaded:
        _loaded[path] = JsonTokenizer(path)
    return _loaded[path]


def groups(items: list[str], chars: int = 1 << 20) -> Iterable[list[str]]:
    """Runs of texts of about so many characters."""
    run: list[str] = []
    held = 0
    for x in items:
        run.append(x)
        held += len(x)
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run
