"""SentencePiece BPE: encoding by a table of each prefix's last token, and decoding.

Byte-pair merging joins the neighbours whose joint piece scores best, the leftmost
of equals, until no joint is a piece. Whether it ever joins across a boundary
between two tokens depends on these two alone: a sequence of pieces is the result
exactly if each neighbouring pair, merged by itself, comes back as that pair. So
every prefix of a text has one last token: the piece ending there that is
compatible with the last token of the prefix before it. An automaton over all
pieces lists the candidates at each place, pair tests (kept) choose among them,
and the ids follow from the end backwards. Texts of any length take time in
proportion to it, without a queue of merges.

No piece of the vocabulary holds a space mark behind another character, and none
holds a line feed; this is checked when the model is loaded. Nothing is ever
joined there, so a text is encoded as its words are, and a worker keeps the ids of
words it has met.

Defined results: a null or empty text has no ids and decodes to the empty text;
characters without a piece become byte pieces; a row is returned for each row,
repeated ones too; a null id stays null; an empty table gives an empty table;
texts are used whole; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import pick, text_rows, worker_cache

#: The mark that stands for a space (a fixed value of the format).
MARK = "▁"
#: Entries of a worker's word and pair tables after which they start afresh (memory only; no effect on results).
KEPT = 600_000
#: Words longer than this are not kept.
KEPT_CHARACTERS = 64
#: Stands for no piece: before the start, and for a character that has none.
NO_PIECE = 1 << 31


class PrefixEncoder:
    """Ids of texts, and texts of ids, for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte pieces is expected")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("texts are expected to be encoded as they are, with spaces as marks in front")
        self.front = MARK if spec.add_dummy_prefix else ""
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.piece_of = {i: piece for piece, i in self.id_of.items()}
        self.score = {piece: model.pieces[i].score for piece, i in self.id_of.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in self.id_of):
            raise ValueError("a piece joins words")
        self.words = re.compile(f"{MARK}*+[^{MARK}\n]+|{MARK}+|\n")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.size_of = {i: len(piece) for piece, i in self.id_of.items()}
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> PrefixEncoder:
        """The worker process's own, loaded once."""
        kept = worker_cache()
        if ("pieces", path) not in kept:
            kept["pieces", path] = cls(path)
        return kept["pieces", path]

    def stays(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives just these pieces; without a left one, just the right."""
        parts, score, inside = list(left + right), self.score, len(left)  # so many parts are the left one's
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return len(parts) == 1 + bool(left)
            if at == inside - 1:
                return False  # joined across the boundary
            inside -= at < inside
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, last: int, piece: int) -> bool:
        """Tests whether a piece can follow the last token of the prefix before it, and keeps the answer."""
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        # nothing is ever joined with a character that has no piece, so a piece after one stands as at the start
        known = self.pairs[last << 32 | piece] = self.stays(self.piece_of.get(last, ""), self.piece_of[piece])
        return known

    def word_ids(self, word: str) -> bytes:
        """Ids of a word: last tokens of all prefixes, then backwards."""
        last = [NO_PIECE] * (len(word) + 1)  # the last token of each prefix; of the empty one, none
        known, sizes, done = self.pairs.get, self.size_of, -1
        for end, (size, piece) in self.automaton.iter(word):
            if end == done:
                continue  # this prefix has its token
            before = last[end + 1 - size]
            fits = known(before << 32 | piece)
            if fits or (fits is None and self.compatible(before, piece)):
                last[end + 1], done = piece, end
        out, at = [], len(word)
        while at:
            if last[at] == NO_PIECE:
                at -= 1
                out += [self.byte_ids[b] for b in reversed(word[at].encode())]
            else:
                out.append(last[at])
                at -= sizes[last[at]]
        return array("i", reversed(out)).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """All ids of the text."""
        if not text:
            return np.zeros(0, np.int32)
        words = self.words.findall(self.front + text.replace(" ", MARK))
        kept = self.kept
        try:
            return np.frombuffer(b"".join(map(kept.__getitem__, words)), np.int32)
        except KeyError:
            pass
        new = set(words).difference(kept)
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = set(words)
        fresh = {w: self.word_ids(w) for w in new}
        joined = b"".join([fresh[w] if w in fresh else kept[w] for w in words])
        if len(new) <= KEPT:
            kept.update((w, ids) for w, ids in fresh.items() if len(w) <= KEPT_CHARACTERS)
        return np.frombuffer(joined, np.int32)

    def text(self, ids: np.ndarray) -> str:
        """The text that the library decodes the ids to."""
        return self.library.decode(ids.tolist()) if len(ids) else ""


def sentence_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: the ids of every whole text and the text they decode to. One pass, no shuffle."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    schema = StructType([texts.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PrefixEncoder.shared(model_path)
        for batch in batches:
            found = [model.ids(text.as_py() or "") for text in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([model.text(f) for f in found], pa.string())], names=schema.names)

    return text_rows(texts).mapInArrow(run, schema)
