"""Token ids from a public tokenizer file."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandwork.llm.common import kept, tidy

#: Marks a piece without a leading blank; texts that hold it are not cut into pieces.
BARE = "\x01"
#: White space beside a blank or line end, at the edges of a text, or beyond ASCII, and format characters that some engines count as such.
ODD = r"^ | $|\x01|[ \n][ \n\t\x0b\x0c\r\x1c-\x1f]|[\t\x0b\x0c\r\x1c-\x1f][ \n]|[\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Characters of a piece that the memo keeps, at most, and of a text that is encoded in one go.
LONG, PART = 64, 1 << 20

_GAP = re.compile("(?<=[!-~]) (?=[!-~])")
#: A letter and the marks behind it up to the next blank, line end or the text's end.
MARKED = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?]+)([ \n]|$)"


#: Pieces whose ids a worker keeps.
ENTRIES = 300_000


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, with a memo for each blank-delimited piece.

    A byte-level BPE of this family cuts the text before it merges. It always cuts before a blank that
    stands between two visible characters, on both sides of such a line end, and between a letter and a mark. So the ids of
    a text are those of its pieces, each with its leading blank, put together. Texts with other white space, or with one of
    the tokenizer's added tokens in them, are encoded by the library as they are; those of more than PART characters in parts that
    end before a blank between visible characters. The memo stops to grow at `entries`; ids are the same with or without it.
    """

    def __init__(self, path: str, entries: int = ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.blank[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *map(re.escape, added)])
        self.whole = any(" " in t for t in added)
        self.entries = entries
        self.memo: dict[str, bytes] = {BARE: b"", "\n": self._library(["\n"])[0]}
        # what the file and the vocabulary took to read
        tidy()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece. One call takes all that stand behind a blank; there a token that starts with a blank starts a piece."""
        bare = [p for p in pieces if p[0] == BARE]
        out = dict(zip(bare, self._library([p[1:] for p in bare]), strict=True)) if bare else {}
        if behind := [p for p in pieces if p[0] != BARE]:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(behind)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.blank[ids])
            if len(starts) != len(behind):
                return out | dict(zip(behind, self._library([f" {p}" for p in behind]), strict=True))
            raw, size = ids.tobytes(), self.dtype.itemsize
            cuts = [*(starts * size).tolist(), len(raw)]
            out |= {p: raw[a:b] for p, a, b in zip(behind, cuts, cuts[1:], strict=False)}
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of the distinct pieces, from the memo or the library."""
        out = list(map(self.memo.get, pieces))
        if gaps := [i for i, x in enumerate(out) if x is None]:
            new = self._new([pieces[i] for i in gaps])
            for i in gaps:
                out[i] = new[pieces[i]]
            if len(self.memo) < self.entries:
                self.memo.update((p, x) for p, x in new.items() if len(p) <= LONG)
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one text after the other, and their counts; each blank of a text starts a piece."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        ids = self._pieces(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        which = np.asarray(coded.indices)
        n = sizes[which]
        ends = np.cumsum(n)
        out = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends + n, n)]
        upto = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return out, np.diff(upto)

    def _parts(self, text: str) -> list[str]:
        """The text cut before blanks between visible characters, about every PART characters; all but the first without their blank."""
        at, out = 0, []
        while not self.whole and len(text) - at > PART and (gap := _GAP.search(text, at + PART)):
            out.append(text[at : gap.start()])
            at = gap.end()
        return [*out, text[at:]]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else pc.fill_null(texts.cast(pa.large_string()), "")
        if len(texts) and pc.max(pc.binary_length(texts)).as_py() > PART:
            flat, counts = [], []
            for text in texts.to_pylist():
                ids = []
                for k, part in enumerate(self._parts(text)):
                    ids.append(self._rows(pa.array([part], pa.large_string()), "" if k else BARE)[0])
                flat += ids
                counts.append(sum(map(len, ids)))
            return np.concatenate(flat), np.array(counts, np.int64)
        return self._rows(texts, BARE)

    def _rows(self, texts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """encode for texts of bounded size that stand behind a blank (lead '') or at the beginning (BARE)."""
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        cut = pc.replace_substring(pc.replace_substring_regex(plain, MARKED, rf"\1 {BARE}\2\3"), "\n", f" \n {BARE}")
        flat, n = self._plain(pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), cut, pa.scalar("", pa.large_string())))
        if not odd.any():
            return flat, n
        rest = self._library([("" if lead else " ") + t for t in texts.filter(pa.array(odd)).to_pylist()])
        mine, counts, rows = iter(np.split(flat, np.cumsum(n)[:-1]) if len(n) else ()), [], []
        others = (np.frombuffer(x, self.dtype) for x in rest)
        for is_odd in odd:
            rows.append(next(others if is_odd else mine))
            counts.append(len(rows[-1]))
        return np.concatenate(rows), np.array(counts, np.int64)


def encoder(path: str, entries: int = ENTRIES) -> PieceEncoder:
    """One encoder for each Python worker and file."""
    return kept(("encoder", path, entries), lambda: PieceEncoder(path, entries))
