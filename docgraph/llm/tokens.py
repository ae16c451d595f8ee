"""Token ids of whole texts by the tokenizers library, with equal text segments encoded once a worker.

A byte-level BPE never joins across a single space or line feed between two characters that are not white space: the space
opens a new piece there, the line feed is a piece of its own. So a text falls into segments at these places, each segment is
encoded by the library once, and the ids of a text are those of its segments in order. Where a segment is a Latin word,
perhaps with a run of marks behind it, its pieces are known and go to the library's model at once. A text that holds one of the
tokenizer's special strings is encoded whole, and so is every text if the tokenizer is not a plain byte-level BPE.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np

from docgraph.llm.common import worker_cache

_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: All of ASCII's but the apostrophe, which may begin a contraction. A run of them behind letters is one piece.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Runs of marks that are remembered.
MOST_MARKS = 10_000


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order
    from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Ids of segments; ``learn`` gives those of one that is not there."""

    def __init__(self, learn: Callable[[str], bytes | None]) -> None:
        self.learn = learn

    def __missing__(self, key: str) -> bytes | None:
        return self.learn(key)


class SegmentEncoder:
    """``encode(texts)`` gives an id array for each text.

    Segments are known by what stands before them: a space, or, for keys that begin with it, a line feed. They are remembered
    in two generations of about ``limit`` each: when the younger is full the older goes, and what is met again moves up, so
    that frequent segments stay.
    """

    def __init__(self, path: str, limit: int = 500_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._now: dict[str, bytes] = _Known(self._learn)
        self._old: dict[str, bytes] = {}
        self._limit = limit
        size = self._tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        config = json.loads(self._tok.to_str())
        before, model = config.get("pre_tokenizer") or {}, config["model"]
        self._plain = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and config.get("normalizer") is None
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        if self._plain:
            self._alphabet = byte_alphabet()
            self._space = self._alphabet[ord(" ")]
            self._marks: dict[str, bytes] = {}
            self._feed = self._piece("\n")

    def _piece(self, text: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        return array(self._code, [t.id for t in self._model.tokenize(text.encode().decode("latin-1").translate(self._alphabet))]).tobytes()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, key: str) -> bytes:
        if key[0] == "\n":
            return self._feed + self._piece(key[1:])
        return array(self._code, [t.id for t in self._model.tokenize(self._space + key)]).tobytes() if key.isascii() else self._piece(" " + key)

    def _learn(self, key: str) -> bytes | None:
        """Ids of a segment, which are remembered from then on; None if it is edged."""
        now, old, marks = self._now, self._old, self._marks
        ids = old.get(key)
        if ids is None:
            word = key[1:] if key[:1] == "\n" else key
            base = word.rstrip(MARKS)
            if base.isalpha() and (base.isascii() or max(base) < "ɐ"):  # letters here are letters to every version of the standard
                if base == word:
                    ids = self._word(key)
                else:
                    tail = word[len(base) :]
                    if tail not in marks:
                        if len(marks) >= MOST_MARKS:
                            marks.clear()
                        marks[tail] = self._piece(tail)
                    ids = now[key[: len(key) - len(tail)]] + marks[tail]
            elif self._edged(key):
                return None
            else:
                ids = self.whole([key if key[0] == "\n" else " " + key])[0].tobytes()
        now[key] = ids
        return ids

    @staticmethod
    def _edged(key: str) -> bool:
        """Whether a segment is empty or begins or ends with white space, which may belong with what stands beside it."""
        word = key[1:] if key[:1] == "\n" else key
        return not word or word[0].isspace() or word[-1].isspace()

    def _between_edges(self, text: str) -> list[bytes]:
        """The ids of a text's segments where some are edged: they are cut where nothing but a single space or line feed stands
        between other characters, and the first and last, if they are still edged, are encoded by themselves."""
        parts = _CUT.split(text)
        parts[0] = "\n" + parts[0]
        first, last = self._edged(parts[0]), len(parts) > 1 and self._edged(parts[-1])
        values = list(map(self._now.__getitem__, parts[first : len(parts) - last]))
        if first:
            values.insert(0, self._feed + self.whole([parts[0][1:]])[0].tobytes())
        if last:
            values.append(self.whole([parts[-1] if parts[-1][0] == "\n" else " " + parts[-1]])[0].tobytes())
        return values

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self._plain:
            return self.whole(texts)
        if len(self._now) > self._limit:
            self._old, self._now = self._now, _Known(self._learn)
        value, width = self._now.__getitem__, len(self._feed)  # of the line feed that is put before a text
        out = []
        for text in texts:
            if any(s in text for s in self._special):
                out.append(self.whole([text])[0])
                continue
            values = list(map(value, ("\n" + text.replace("\n", " \n")).split(" ")))
            if None in values:
                values = self._between_edges(text)
            out.append(np.frombuffer(b"".join(values), self.dtype)[width // self.dtype.itemsize :])
        return out


def encoder(path: str) -> SegmentEncoder:
    """One encoder a Python worker; what it has learnt serves the worker's later tasks of the stage too."""
    return worker_cache(("encoder", path), lambda: SegmentEncoder(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
