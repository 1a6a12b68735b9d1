"""Token ids by a tokenizer file, one batch at a time inside a task.

A text is cut at ASCII white space, and between letters and marks where the tokenizer's file says that it always
parts them; no pre-token crosses such a place. Each distinct chunk is encoded once and kept, so the tokenizer sees
a vocabulary and not the running text.
"""

from __future__ import annotations

import json
import os
from array import array
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from metricmart.llm import kernel

#: A pre-tokenizer that always parts letters from marks; fixed value, as tokenizer files state it.
LETTERS_APART = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # ASCII marks but the apostrophe
_LATIN = np.zeros(256, bool)  # second bytes, after 0xC3, of the letters from U+00C0 to U+00FF
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def letter_mark_cuts(data: np.ndarray) -> np.ndarray:
    """Places between an ASCII or Latin-1 letter and an ASCII mark that is no apostrophe."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    letter, mark = _LETTER[data], _MARK[data]
    ends, begins = letter.copy(), letter.copy()
    latin = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    ends[1:] |= latin
    begins[:-1] |= latin
    return np.flatnonzero((ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:])) + 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes string arrays. ``keep``: distinct chunks kept in memory; beyond it the store starts anew.

    ``special``: whether added tokens (as ``<|endoftext|>``) that stand in a text become their ids, as the tokenizer by
    itself has it. Texts that hold one are given to the tokenizer whole.
    """

    def __init__(self, path: str, keep: int = 250_000, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.whole = Tokenizer.from_file(path) if special else None
        self.added = [x["content"] for x in json.loads(Path(path).read_text()).get("added_tokens", []) if x["content"]] if special else []
        parts = json.dumps(json.loads(Path(path).read_text()).get("pre_tokenizer"))
        self.cuts = letter_mark_cuts if json.dumps(LETTERS_APART) in parts else lambda data: None
        self.values = kernel.FOLDED if '"Lowercase"' in json.dumps(json.loads(Path(path).read_text()).get("normalizer")) else kernel.RAW
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.row: dict[int, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _rows(self, hashes: np.ndarray, first: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.row) > self.keep:
            self._clear()
        get = self.row.get
        rows = np.fromiter((get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = data.tobytes()
            at = first[new]
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            base = len(self.ends) - 1
            for k in range(0, len(texts), 20_000):
                for x in self.encoder.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False):
                    self.ids.extend(x.ids)
                    self.ends.append(len(self.ids))
            rows[new] = np.arange(base, base + len(new))
            self.row.update(zip(hashes[new].tolist(), rows[new].tolist()))
        return rows

    def encode(self, texts: pa.Array, end_id: int | None = None):
        """(first row, ids, id offsets by row) for each block of rows; ``end_id`` is put after each text."""
        texts = texts.cast(pa.large_string())
        odd = np.zeros(len(texts), bool)
        for x in self.added:
            odd |= np.asarray(pc.fill_null(pc.match_substring(texts, x, ignore_case=True), False))
        for row, stop, data, offsets in kernel.blocks(texts, 2 << 20):
            starts, ends, h, by_row = kernel.words(data, offsets, self.values, cuts=self.cuts(data))
            inverse, unique = pd.factorize(h)
            first = np.zeros(len(unique), np.int64)
            first[inverse[::-1]] = np.arange(len(h))[::-1]
            rows = self._rows(unique, first, data, starts, ends)
            flat, bounds = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
            begin, size = bounds[rows][inverse], (bounds[rows + 1] - bounds[rows])[inverse]
            extra = end_id is not None
            if extra:  # an empty word of one id at each row's end
                begin = np.insert(begin, by_row[1:], 0)
                size = np.insert(size, by_row[1:], 1)
                by_row = by_row + np.arange(len(by_row))
            total = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.arange(total[-1]) - np.repeat(total[:-1] - begin, size)] if len(flat) else np.zeros(total[-1], np.uint32)
            del flat, bounds  # else the store can't grow
            out = total[by_row]
            if extra:
                ids[out[1:] - 1] = end_id
            if odd[row:stop].any():
                parts = [np.append(np.array(self.whole.encode(texts[row + k].as_py(), add_special_tokens=False).ids, np.uint32), np.array([end_id] * extra, np.uint32)) if odd[row + k] else ids[out[k] : out[k + 1]] for k in range(stop - row)]
                ids, out = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            yield row, ids, out
