"""Ids of a byte-level BPE vocabulary, word by word, equal to those of the ``tokenizers`` library.

The vocabulary's pattern always begins a new token at a blank that follows a non-blank, so the ids
of a text are those of its *units* between such blanks, one after the other, and units seen before
are remembered. A unit of letters, digits and marks whose classes no Unicode version disputes is
cut into the pattern's tokens here, and its tokens are merged by the same ranks many at a call;
every other unit, and every text that holds a special token, goes through the library as it is.
"""

from __future__ import annotations

import json
import re

import numpy as np

# Letters, digits and marks (no apostrophe, which begins contractions) of a plain unit.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"(?:[{_LETTERS}]+|[0-9]+|[{_MARKS}]+)(?:[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n(?=[{_LETTERS}0-9{_MARKS}]))*")
_TOKENS = re.compile(rf"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n")
_UNITS = re.compile(r"(?<=\S) ")
#: White space other than blanks and line feeds.
_RARE = re.compile(r"[^\S \n]")
#: Units that a worker remembers (a long one counts for more); a full memory is emptied.
REMEMBERED = 1_000_000
_CODERS: dict[tuple[str, bool], ByteCoder] = {}


def byte_of_char() -> dict[str, int]:
    """The vocabulary's spelling of bytes: printable ones stand for themselves, the rest follow from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def units(text: str) -> list[str]:
    """A text cut at each blank that follows a non-blank; the blank goes."""
    if text[:1] != " " and "  " not in text and "\n " not in text and not _RARE.search(text):
        return text.split(" ")
    return _UNITS.split(text)


def _merger(path: str):
    """The vocabulary's merges by rank, if the file says that ranks are ids; else nothing."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    model, cut = read["model"], read.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not read.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    vocab, known = model["vocab"], byte_of_char()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(map(known.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=r"[^\x00\x01]+|\x00|\x01", mergeable_ranks=ranks, special_tokens={})


class ByteCoder:
    """Encodes texts unit by unit. ``plain`` takes the strings of special tokens as ordinary text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = plain
        added = self.coder.get_added_tokens_decoder()
        self.special = None if plain or not added else re.compile("|".join(re.escape(t.content) for t in added.values()))
        self.dtype = np.dtype("<u2" if self.coder.get_vocab_size() <= 1 << 16 else "<u4")
        self.merger = _merger(path)
        if self.merger:
            self.within, self.after = self.merger.encode_ordinary("\x00")[0], self.merger.encode_ordinary("\x01")[0]
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.weight = 0

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        known, out = byte_of_char(), [b""] * self.coder.get_vocab_size()
        for t, i in self.coder.get_vocab().items():
            out[i] = bytes(map(known.__getitem__, t)) if all(c in known for c in t) else t.encode()
        return out

    def ids(self, words: list[str], before: str) -> list[bytes]:
        """The ids of each unit with ``before`` (a blank or nothing) in front, little-endian."""
        quick = [bool(w and self.merger and _PLAIN.fullmatch(w)) for w in words]
        plain = [w for w, q in zip(words, quick, strict=True) if q]
        odd = iter(np.array(e.ids, dtype=self.dtype).tobytes() for e in self.coder.encode_batch([before + w for w, q in zip(words, quick, strict=True) if not q], add_special_tokens=False))
        done: list[bytes] = []
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            text = "\x01".join([before + (w if w.isalpha() else "\x00".join(_TOKENS.findall(w))) for w in part])
            found = np.array(self.merger.encode_ordinary(text + "\x01"), dtype=np.int64)
            found = found[found != self.within]
            ends = np.flatnonzero(found == self.after)
            raw, size = found.astype(self.dtype).tobytes(), self.dtype.itemsize
            starts = np.append(0, ends[:-1] + 1) * size
            done += [raw[x:y] for x, y in zip(starts.tolist(), (ends * size).tolist(), strict=True)]
        quickly = iter(done)
        return [next(quickly) if q else next(odd) for q in quick]

    def learn(self, first: set[str], rest: set[str]) -> None:
        """Remember units that begin texts, and units after a blank."""
        new = [(before, [w for w in words if w not in self.known[before]]) for before, words in (("", first), (" ", rest))]
        if self.weight + sum(len(x) for _, x in new) > REMEMBERED:
            self.known, self.weight = {"": {}, " ": {}}, 0
            new = [("", list(first)), (" ", list(rest))]
        for before, words in new:
            self.weight += len(words) + sum(map(len, words)) // 64
            self.known[before].update(zip(words, self.ids(words, before), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        out = []
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            odd = [bool(self.special and self.special.search(t)) for t in part]
            cut = [[] if o else units(t) for t, o in zip(part, odd, strict=True)]
            first = {c[0] for c in cut if c}
            rest = set().union(*(c[1:] for c in cut))
            self.learn(first, rest)
            begin, go_on = self.known[""], self.known[" "].__getitem__
            for t, o, c in zip(part, odd, cut, strict=True):
                if o:
                    out.append(np.array(self.coder.encode(t, add_special_tokens=False).ids, dtype=self.dtype))
                else:
                    out.append(np.frombuffer(begin[c[0]] + b"".join(map(go_on, c[1:])), dtype=self.dtype))
        return out


def coder(path: str, plain: bool = False) -> ByteCoder:
    """One coder for each worker."""
    if (path, plain) not in _CODERS:
        _CODERS[path, plain] = ByteCoder(path, plain)
    return _CODERS[path, plain]
