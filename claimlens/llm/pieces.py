"""SentencePiece encoding by a merge-type prefix table, and decoding.

The encoding of a text by merges has two properties: each prefix of the text has one
last token, and a list of tokens is the encoding of its text exactly when each pair of
neighbours is, taken alone, encoded as that pair. So a table with the last token of
every prefix is filled from left to right: an automaton gives the pieces that end at a
position, and the one that is compatible with the last token of the prefix before it is
stored. The ids are then read from the end backwards.

A piece holds the space mark only in front and joins no letter to a mark behind it, so
words are encoded alone; tables of frequent words are kept by each Python worker, in two
generations of bounded number and length of words. Nothing is shuffled.

Defined results: a null text is empty; an empty text has the end id only and decodes to
an empty text; repeated rows give repeated results; other input columns are not passed on.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A

SPACE = "▁"
# Words whose encoding a worker keeps: two generations of this many.
CACHED_WORDS = 100_000
# Longest word that is kept, in characters: a text with spaces in a row counts as one word.
KEPT_LENGTH = 64
# The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
# No piece reaches over a line break, from another character to a space mark, or from a
# Latin letter to an ASCII mark, so texts are cut there (checked for each model).
_LETTER, _MARK = "A-Za-z\u00c0-\u024f", r"!-/:-@\[-`{-~"
_CHUNK = re.compile(
    rf"\n++|{SPACE}*+(?:[^{SPACE}\n{_LETTER}]++|[{_LETTER}]++(?![{_MARK}]))*+[{_LETTER}]*+"
)
_REACHES_OVER = re.compile(rf"[^{SPACE}]{SPACE}|\n|[{_LETTER}][{_MARK}]")
_REPLACEMENT = "�"


class Kept:
    """Values of recent keys: a full generation replaces the older one."""

    def __init__(self):
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def get(self, key: str) -> tuple[int, ...] | None:
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value: tuple[int, ...]) -> tuple[int, ...]:
        if len(self.new) >= CACHED_WORDS:
            # The dictionary object stays, as loops hold its methods.
            self.old = dict(self.new)
            self.new.clear()
        self.new[key] = value
        return value


class Pieces:
    """Vocabulary of a merge-type model whose normalisation is the identity."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = norm.name == "identity" and norm.escape_whitespaces and norm.add_dummy_prefix
        if train.model_type != 2 or not train.byte_fallback or not plain:
            raise ValueError("a merge-type model with byte fallback and no normalisation is needed")
        if norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("spaces must be kept and marked in front")
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        if any(_REACHES_OVER.search(p) for p in self.ids):
            raise ValueError("a piece reaches over a place where texts are cut")
        self.score = [p.score for p in model.pieces]
        self.byte_ids = [0] * 256
        self.bytes = {}
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                value = int(self.pieces[i][3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, value
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.shown = [" \u2047 " if k == UNKNOWN else p for p, k in zip(self.pieces, kinds)]
        self.end = next(i for i in self.control if self.pieces[i] == "</s>")
        self.decimal = [str(i) for i in range(len(self.pieces))]
        # Of the pieces that end at a position the automaton gives the longest first.
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self._compatible: dict[int, bool] = {}
        self._words, self._chunks = Kept(), Kept()

    def merged(self, text: str) -> list[str]:
        """The encoding by definition: merge the neighbours with the best score, leftmost first."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or score[piece] > best):
                    best, at = score[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens, joined, are encoded as these two tokens."""
        a, b = self.pieces[left], self.pieces[right]
        answer = self.merged(a + b) == [a, b]
        if len(self._compatible) >= 4 * CACHED_WORDS:
            self._compatible.clear()
        self._compatible[left << 20 | right] = answer
        return answer

    def table(self, chunk: str) -> list[int]:
        """Ids of a chunk. A character outside the vocabulary becomes bytes and touches no merge."""
        known, test = self._compatible.get, self.compatible
        # last[i]: last token of the prefix of length i, its length; no length: not found so far.
        last, size = [-1] * (len(chunk) + 1), [0] * (len(chunk) + 1)
        size[0] = 1
        for at, (token, length) in self.automaton.iter(chunk):
            at += 1
            if size[at]:
                continue
            before = last[at - length]
            if before >= 0:
                fits = known(before << 20 | token)
                if not (test(before, token) if fits is None else fits):
                    continue
            last[at], size[at] = token, length
        out: list[int] = []
        at = len(chunk)
        while at:
            if last[at] >= 0:
                out.append(last[at])
                at -= size[at]
            else:
                out.extend(self.byte_ids[b] for b in reversed(chunk[at - 1].encode()))
                at -= 1
        out.reverse()
        return out

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a word with the space mark in front of it."""
        known = self._chunks.get
        out: list[int] = []
        for chunk in _CHUNK.findall(SPACE + text):
            if chunk:
                ids = known(chunk)
                if ids is None:
                    ids = tuple(self.table(chunk))
                    if len(chunk) <= KEPT_LENGTH:
                        self._chunks.keep(chunk, ids)
                out += ids
        return self._words.keep(text, tuple(out)) if len(text) <= KEPT_LENGTH else tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text with the end id."""
        out: list[int] = []
        if text:
            text = text.replace(SPACE, " ")
            apart = "  " not in text and text[0] != " " and text[-1] != " "
            known, make = self._words.new.get, self.word
            # Spaces in a row belong together: such a text is taken as one word.
            for w in text.split(" ") if apart else [text.replace(" ", SPACE)]:
                out += known(w) or self._words.get(w) or make(w)
        out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes that make up characters are joined, others are replaced."""
        out: list[str] = []
        run: list[int] = []
        for i in ids:
            value = self.bytes.get(i)
            if value is not None:
                run.append(value)
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            if i not in self.control:
                out.append(self.shown[i])
        if run:
            out.append(_characters(bytes(run)))
        text = "".join(out).replace(SPACE, " ")
        # The mark that encoding put in front.
        return text[1:] if text.startswith(" ") else text


def _characters(raw: bytes) -> str:
    """UTF-8 characters of raw bytes; each byte that is part of none becomes one mark."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(_REPLACEMENT)
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The vocabulary, read once by each Python worker."""
    return Pieces(path)


def encode_documents(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, ids, text decoded from the ids) for every row.

    `ids` is an array<int> that ends with the end id; `ids_text` has them in decimal.
    The model file must be at the same path on every machine.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fields = [
        T.StructField("id", rows.schema["id"].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        model = load(model_path)
        counts, ids_sha, text_sha = [], [], []
        for text in part.column("text").to_pylist():
            ids = model.encode(text or "")
            line = " ".join([model.decimal[i] for i in ids])
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
            text_sha.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
            names=[f.name for f in fields],
        )

    out = rows.mapInArrow(A.over_texts(kernel), T.StructType(fields))
    return out.withColumnRenamed("id", id_column)


def token_ids(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, ids array<int> ending with the end id) for every row."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fields = [
        T.StructField("id", rows.schema["id"].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        model = load(model_path)
        ids = [model.encode(text or "") for text in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"]
        )

    return rows.mapInArrow(A.over_texts(kernel), T.StructType(fields)).withColumnRenamed("id", id_column)


def decode_ids(
    tokens: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """(id, text) from the ids of each row; null ids are an empty text."""
    rows = tokens.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType())]

    def task(batches):
        model = load(model_path)
        for b in batches:
            texts = [model.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(task, T.StructType(fields)).withColumnRenamed("id", id_column)
