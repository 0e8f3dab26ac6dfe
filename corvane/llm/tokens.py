"""Token ids of many texts at once, by the tokenizers library, each distinct piece encoded once a worker.

Both public vocabularies split a text into pieces before they merge, and no piece spans a place where a
space stands before a non-space. So a plain text (printable ASCII, Latin-1 letters, single spaces and line
ends) is cut there, and the ids of each distinct cut come from a table that the library fills. Any other
text goes to the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np

#: Bytes of a plain text in Latin-1, all but control characters and the white space and format
#: characters U+0085, U+00A0 and U+00AD.
_PLAIN = bytes(b for b in range(256) if b == 10 or 32 <= b < 127 or b > 160 and b != 173)
_SPACES = (b"  ", b"\n\n", b" \n", b"\n ")
#: Distinct pieces that a worker keeps if its caller names no other number; more are encoded again when they come
#: again, so its memory is bounded.
MAX_PIECES = 300_000


def is_plain(text: str) -> bool:
    """Not so are texts with other characters, runs of white space, or white space at either end; and the empty one."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    if not raw or raw[0] in b" \n" or raw[-1] in b" \n" or raw.translate(None, _PLAIN):
        return False
    return not any(x in raw for x in _SPACES)


class PieceEncoder:
    """encode(texts) gives (ids uint32, offsets int64): the ids of text i are ids[offsets[i]:offsets[i + 1]].

    most is how many distinct pieces are kept; the ids don't depend on it.
    """

    def __init__(self, path: str, most: int | None = None):
        self.most = most
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.loads(self.library.to_str())
        # white space is dropped by one vocabulary and kept, before the piece, by the other
        self.drops_space = spec["normalizer"] is not None
        self.lead = 0 if self.drops_space else len(self.library.encode("\n", add_special_tokens=False).ids)
        self.known: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.marks = {m: self.library.encode(m, add_special_tokens=False).ids for m in ".,"}

    def _append(self, piece: str, size: int) -> None:
        k = len(self.known)
        if k + 2 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.known[piece] = k
        self.starts[k + 1] = self.starts[k] + size

    def _learn(self, pieces: list[str]) -> None:
        """Adds pieces. A comma or stop after a letter begins a piece of its own in either vocabulary, so a word's
        ids serve it with and without one."""
        split = [(p[:-1], p[-1]) if p[-1] in ".," and p[-2:-1].isalpha() else (p, "") for p in pieces]
        new = [w for w in dict.fromkeys(w for w, _ in split) if w not in self.known]
        texts = new if self.drops_space else [w if w[0] == "\n" else f" {w}" for w in new]
        ids = dict(zip(new, (e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)), strict=True))
        flat: list[int] = []
        at = int(self.starts[len(self.known)])
        for word, found in ids.items():
            self._append(word, len(found))
            flat += found
        for piece, (word, mark) in zip(pieces, split, strict=True):
            if mark and piece not in self.known:
                found = ids.get(word)
                if found is None:
                    k = self.known[word]
                    found = self.flat[self.starts[k] : self.starts[k + 1]].tolist()
                self._append(piece, len(found) + len(self.marks[mark]))
                flat += found
                flat += self.marks[mark]
        while at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : at + len(flat)] = flat

    def _forget(self, keep: int) -> None:
        while len(self.known) > keep:
            self.known.popitem()

    def _pieces(self, text: str) -> list[str]:
        if self.drops_space:
            return text.lower().split()
        return ("\n" + text.replace("\n", " \n")).split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [is_plain(t) for t in texts]
        whole = [t for t, p in zip(texts, plain, strict=True) if not p]
        whole_ids = [e.ids for e in self.library.encode_batch_fast(whole, add_special_tokens=False)] if whole else []
        cut = [self._pieces(t) for t, p in zip(texts, plain, strict=True) if p]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        pieces = list(chain.from_iterable(cut))
        keep = max(len(self.known), MAX_PIECES if self.most is None else self.most)
        index = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            self._learn(list(dict.fromkeys(pieces[i] for i in missing)))
            index[missing] = [self.known[pieces[i]] for i in missing]
        first = np.cumsum(counts) - counts
        starts, sizes = self.starts[index], self.starts[index + 1] - self.starts[index]
        if self.lead and len(index):  # the line end set before each text is not its own
            starts[first] += self.lead
            sizes[first] -= self.lead
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self._forget(keep)
        n = np.zeros(len(texts), np.int64)
        sums = np.concatenate([[0], ends])
        of_plain = np.array(plain, bool)
        n[of_plain] = sums[first + counts] - sums[first]
        if not whole:
            return ids, np.concatenate([[0], np.cumsum(n)])
        n[~of_plain] = [len(x) for x in whole_ids]
        offsets = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(offsets[-1], np.uint32)
        ids_plain = np.repeat(of_plain, n)
        out[ids_plain] = ids
        out[~ids_plain] = np.fromiter(chain.from_iterable(whole_ids), np.uint32, int(n[~of_plain].sum()))
        return out, offsets


_ENCODERS: dict[tuple[str, int | None], PieceEncoder] = {}


def encoder(path: str, most: int | None = None) -> PieceEncoder:
    """One for each vocabulary file, number of pieces kept and worker process."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = PieceEncoder(path, most)
    return _ENCODERS[path, most]


def text_slices(batches, columns: tuple[str, ...] = ("doc_id", "text"), size: int = 3_000_000):
    """Cuts Arrow batches into slices of about so many bytes of text, the last column, so that memory follows the slice."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(columns[-1])), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // size
        cuts = np.flatnonzero(np.diff(group)) + 1 if len(group) else []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in columns], list(columns))
