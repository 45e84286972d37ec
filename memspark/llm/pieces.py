"""SentencePiece encoding and decoding by a streaming Viterbi search.

For every prefix of a text the search keeps one surviving path: the piece that ends the prefix's
encoding. In a byte-pair vocabulary that last piece is unique: it is the one that follows from a
shorter prefix's encoding and whose join with that prefix's last piece is stable, which means that
merging the two pieces' characters afresh gives the same two pieces. Only the last
``longest piece`` positions can be extended, so the search holds that window of backpointers and
commits ids as soon as the paths of all positions in it meet at one boundary.

No piece goes over the end of a word (a non-blank before a blank), so paths always meet there;
words seen before are answered from a bounded memory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from memspark.session import ship_package

BLANK = "▁"
#: Words that a worker remembers (a long one counts for more); a full memory is emptied.
REMEMBERED = 400_000
#: In the search, characters without a piece are numbered from here.
_LACKING = 1 << 20
_NEVER = float("-inf")
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_CODERS: dict[str, PieceCoder] = {}


class PieceCoder(dict):
    """One model's pieces, with streaming encoding and decoding.

    As a dict it remembers words (without the blank before them) with their ids, as bytes.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.score = {p: model.get_score(i) for i, p in enumerate(self.pieces) if i not in special}
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b"" if model.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])
        self.longest = max(map(len, self.score))
        # Pieces that merging their own characters gives; others never appear.
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special and self.merge(p) == [p]}
        # Every ending of a piece, with the piece's id where it is a piece itself.
        self.tails = {p[i:]: -1 for p in self.id_of for i in range(len(p))} | self.id_of
        self.stable: dict[int, bool] = {}
        self.weight = 0

    def merge(self, text: str, apart: int = 0) -> list[str] | None:
        """Byte-pair merges of a short text, best score first, leftmost among equals.

        None as soon as a merge goes over the place ``apart``.
        """
        score = self.score.get
        part = list(text)
        gain = [score(a + b, _NEVER) for a, b in zip(part, part[1:], strict=False)]
        while gain and (best := max(gain)) > _NEVER:
            i = gain.index(best)
            if apart and sum(map(len, part[: i + 1])) == apart:
                return None
            part[i : i + 2] = [part[i] + part[i + 1]]
            del gain[i]
            if i < len(gain):
                gain[i] = score(part[i] + part[i + 1], _NEVER)
            if i:
                gain[i - 1] = score(part[i - 1] + part[i], _NEVER)
        return part

    def _stable(self, left: str, right: str) -> bool:
        """Whether merging the characters of two pieces afresh gives the same two."""
        return self.merge(left + right, len(left)) is not None

    def stream(self, text: str) -> Iterator[int]:
        """The ids of a text, in order, each as soon as it is certain.

        A character that the vocabulary lacks is a piece of its own, numbered beyond the
        vocabulary in the search and written as the ids of its bytes. No more than twice the
        longest piece is held: of each position after the last commit its piece and backpointer.
        """
        longest, n = self.longest, len(text)
        done, last, back = 0, [-1], [0]  # of position done + i: the surviving path's last piece, and how far back it starts
        for end in range(1, n + 1):
            piece, start = self._extend(text, end, max(done, end - longest), last, done)
            last.append(piece)
            back.append(start - done)
            if end == n or end - done >= 2 * longest:
                # Paths of the positions that can still be extended, traced to where they meet.
                width = end - done
                front = {width} if end == n else set(range(max(1, width - longest + 1), width + 1))
                while len(front) > 1:
                    p = max(front)
                    front.discard(p)
                    front.add(max(back[p], 0))
                meet = front.pop()
                out, p = [], meet
                while p > 0:
                    out.append(last[p])
                    p = back[p]
                for piece in reversed(out):
                    yield from self._ids(piece)
                done, last, back = done + meet, last[meet:], [x - meet for x in back[meet:]]

    def _ids(self, piece: int) -> tuple[int, ...]:
        if piece < _LACKING:
            return (piece,)
        return tuple(self.byte_id[b] for b in chr(piece - _LACKING).encode("utf-8", "surrogatepass"))

    def _extend(self, text: str, end: int, first: int, last: list[int], done: int = 0) -> tuple[int, int]:
        """The surviving path's last piece at ``end`` and where it starts, from those of the positions after ``done``."""
        tails, stable = self.tails.get, self.stable
        for start in range(end - 1, first - 1, -1):
            piece = tails(text[start:end])
            if piece is None:
                if start < end - 1:
                    break
                piece = _LACKING + ord(text[start])
            elif piece < 0:
                continue
            if not start:
                return piece, start
            left = last[start - done]
            pair = left << 22 | piece
            ok = stable.get(pair)
            if ok is None:
                if len(stable) > 400_000:
                    stable.clear()
                ok = stable[pair] = left >= _LACKING or piece >= _LACKING or self._stable(self.pieces[left], self.pieces[piece])
            if ok:
                return piece, start
        raise ValueError(f"no path reaches position {end}")

    def learn(self, words: list[str]) -> None:
        """Remember words; a word continues from the survivors of the prefix that it shares with the one before.

        A word shorter than the window is the streaming search with its commit at the word's end,
        where paths always meet; a longer one goes through the window.
        """
        if self.weight + len(words) > REMEMBERED:
            self.clear()
            self.weight = 0
        self.weight += len(words)
        text, last, back, longest = "", [-1], [0], self.longest
        for word in sorted(words):
            if len(word) + 1 > 2 * longest:
                self[word] = np.fromiter(self.stream(BLANK + word), dtype=np.int32).tobytes()
                self.weight += len(word) // (2 * longest)
                continue
            was, text = text, BLANK + word
            k, most = 0, min(len(was), len(text))
            while k < most and was[k] == text[k]:
                k += 1
            del last[k + 1 :], back[k + 1 :]
            for end in range(k + 1, len(text) + 1):
                piece, start = self._extend(text, end, max(0, end - longest), last)
                last.append(piece)
                back.append(start)
            out, p = [], len(text)
            while p:
                out.append(last[p])
                p = back[p]
            out.reverse()
            if max(out) >= _LACKING:
                out = [i for piece in out for i in self._ids(piece)]
            self[word] = np.array(out, dtype=np.int32).tobytes()

    def __missing__(self, word: str) -> bytes:
        self.learn([word])
        return self[word]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts; new words are learnt together."""
        out = []
        for i in range(0, len(texts), 512):
            part = texts[i : i + 512]
            new = set().union(*(t.split(" ") for t in part if BLANK not in t)).difference(self)
            self.learn(list(new))
            out += [self.encode(t) for t in part]
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.empty(0, dtype=np.int32)
        if BLANK in text:
            text = text.replace(BLANK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":  # runs of blanks have pieces of their own
            runs = _WORDS.findall(BLANK + text.replace(" ", BLANK))
            return np.frombuffer(b"".join(self[w[1:]] for w in runs), dtype=np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, text.split(" "))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; blanks come back as spaces and the leading one goes."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def coder(path: str) -> PieceCoder:
    """One coder for each worker."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every whole text; null and empty texts have none. Other columns pass through."""
    ship_package(docs.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(model)
        for column in texts:
            parts, sizes = [], [0]
            for i in range(0, len(column), 512):
                for ids in own.encode_all([t or "" for t in column.slice(i, 512).to_pylist()]):
                    parts.append(ids)
                    sizes.append(len(ids))
            flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))

    return docs.withColumn(out, encode(F.col(text_col)))


def decode_documents(docs: DataFrame, model: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of every row's ids; null ids give the empty text. Other columns pass through."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(model)
        for s in ids:
            yield pd.Series([own.decode(np.asarray(x if x is not None else [], dtype=np.int64)) for x in s], dtype="object")

    return docs.withColumn(out, decode(F.col(ids_col)))


def token_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_crc32, decoded_equal) of every row: encoded, decoded and compared.

    Ids are hashed as little-endian unsigned 32-bit integers. The vocabulary writes U+2581 as it
    writes a blank, so that character comes back as a blank; all else comes back as it was. Null
    counts as empty. Only the digest leaves the task.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_equal", T.BooleanType())]))
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(model)
        for s in texts:
            rows = []
            for i in range(0, len(s), 512):
                texts = [t or "" for t in s.iloc[i : i + 512]]
                for t, ids in zip(texts, own.encode_all(texts), strict=True):
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), own.decode(ids) == t.replace(BLANK, " ")))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", "decoded_equal"])

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("d")).select(id_col, "d.n_tokens", "d.ids_crc32", "d.decoded_equal")
