"""Exact, memoised use of a Hugging Face ``tokenizers`` file inside tasks.

A pre-tokenizer that never joins characters across white space lets a text be
encoded word by word, so every distinct lower-cased word goes through the
library once per worker process (all new words of a batch in one call) and its
ids are reused. Texts for which the shortcut is not provably the same
(special-token strings, characters whose lower case or normal form depends on
context, control characters that Python but not the library counts as white
space, code points unknown to Python) go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORDS_KEPT = 250_000     # words of the young memo; full, it becomes the old one, whose words in use move up again
WORDS_A_CALL = 20_000
CHARS_A_TIME = 8_000_000  # texts encoded in one step, one at least
# the word split of a lower-cased text: contractions, letter runs, single digits, runs of other marks
_SPLIT_LINES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SPLIT_FOR = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# texts with these go through the library whole: Python but not the library takes
# the first four as white space, and the others have a context-bound lower case
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "İ")
# the letters before this one (Latin-1, Latin Extended-A and B) are letters to every Unicode version
_AFTER_LATIN = "\u0250"
# the characters that the library's byte level takes for bytes that are not printable in Latin-1
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_ENCODERS: dict[str, "Encoder"] = {}


def _runs(flat: np.ndarray, first: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[first[c]:first[c] + size[c]] for c in code, joined, and their ends."""
    n = size[code]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[code] - ends[:-1], n)
    at += np.arange(ends[-1])
    return flat[at], ends


def _parts(at: list[int], texts: list[str]) -> Iterator[list[int]]:
    """Consecutive texts of at most ``CHARS_A_TIME`` characters together, or one."""
    part, size = [], 0
    for i in at:
        if part and size + len(texts[i]) > CHARS_A_TIME:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part


class Encoder:
    """Token ids of texts under one tokenizer file (``add_special_tokens`` off)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        # the shortcut is for files that lower-case, fold white space and split words as above
        self.by_word = ("Lowercase" in json.dumps(spec.get("normalizer")) and bool(steps[0].get("invert"))
                        and (steps[0].get("pattern") or {}).get("Regex") == _SPLIT_FOR)
        self.by_model = self.by_word and (spec.get("model") or {}).get("type") == "BPE" and all(
            s.get("type") in ("Split", "ByteLevel") and not s.get("add_prefix_space") for s in steps)
        code = "H" if self.dtype.itemsize == 2 else "I"
        self.pack = lambda ids: array(code, ids).tobytes()
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn_words(self, words: list[str]) -> None:
        # ASCII words pass the other steps of the library unchanged and Latin letters are one run
        # whose bytes it writes as characters, so its model alone is asked
        rest, learn = words, self.tok.model.tokenize
        if self.by_model:
            rest = []
            for w in words:
                if w.isascii():
                    self.words[w] = self.pack([t.id for t in learn(w)])
                elif w.isalpha() and max(w) < _AFTER_LATIN:
                    self.words[w] = self.pack([t.id for t in learn(w.encode().decode("latin-1").translate(_BYTE_LEVEL))])
                else:
                    rest.append(w)
        for k in range(0, len(rest), WORDS_A_CALL):
            part = rest[k:k + WORDS_A_CALL]
            enc = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(enc.ids, self.dtype)
            of = np.array(enc.word_ids, np.int64)
            cuts = np.flatnonzero(np.diff(of)) + 1
            if len(cuts) + 1 != len(part):    # rare: a run holds marks that the library splits off
                self.words.update((w, self._whole(w)) for w in part)
                continue
            raw, n = ids.tobytes(), ids.dtype.itemsize
            ends = [0, *(cuts * n).tolist(), len(raw)]
            self.words.update(zip(part, (raw[a:b] for a, b in zip(ends, ends[1:]))))

    def _plain(self, text: str) -> bool:
        return (self.by_word and (text.isascii() or unicodedata.is_normalized("NFC", text))
                and not any(s in text for s in _ODD) and not any(s in text for s in self.special))

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        if len(self.words) > WORDS_KEPT:
            self.old, self.words = self.words, {}
        ids = list(map(self.words.get, words))
        at = [i for i, x in enumerate(ids) if x is None]
        if at:
            missing = [words[i] for i in at]
            if self.old:
                known = [w for w in missing if w in self.old]
                self.words.update(zip(known, map(self.old.__getitem__, known)))
            self._learn_words([w for w in missing if w not in self.words] if self.old else missing)
            for i, w in zip(at, missing):
                ids[i] = self.words[w]
        return ids

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ends): piece i has ends[i]:ends[i + 1]."""
        # one call splits all pieces; the line feeds between them come out as words
        coded = pa.array(_SPLIT_LINES.findall("\n".join(pieces)), pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        line = words.index("\n") if len(pieces) > 1 else -1
        if line >= 0:
            del words[line]
        ids = self._ids_of_words(words)
        if line >= 0:
            ids.insert(line, b"")
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = self._gather(ids, code)
        return flat, ends[np.concatenate([[0], np.flatnonzero(code == line) + 1, [len(code)]])]

    def _gather(self, ids: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the coded entries one after another, and where each ends."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        return _runs(np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size, size, code)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (``dtype``) of every whole text; equal pieces of the texts between
        white space are split once per batch, equal words encoded once."""
        out: list[np.ndarray] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        for i in set(range(len(texts))).difference(plain):
            out[i] = np.frombuffer(self._whole(texts[i]), self.dtype)
        for part in _parts(plain, texts):
            split = pc.utf8_split_whitespace(pa.array([texts[i].lower() for i in part], pa.large_string()))
            coded = split.flatten().dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            flat, cuts = self._piece_ids(names)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            stream, ends = _runs(flat, cuts[:-1], np.diff(cuts), code)
            at = ends[split.offsets.to_numpy()]
            for j, i in enumerate(part):
                out[i] = stream[at[j]:at[j + 1]]
            # code points that this Python does not know may be letters to the library
            odd = [] if "".join(names).isprintable() else [c for c, p in enumerate(names) if not p.isprintable()]
            if odd:
                where = np.flatnonzero(np.isin(code, odd))
                for j in np.unique(np.searchsorted(split.offsets.to_numpy(), where, side="right") - 1).tolist():
                    out[part[j]] = np.frombuffer(self._whole(texts[part[j]]), self.dtype)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
