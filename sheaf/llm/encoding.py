"""Token ids of whole texts, the tokenizer asked once for each distinct piece.

The word vocabulary cuts a lower-case text at white space and between letters,
digits and other characters before it merges. Arrow cuts a batch into these
pieces and numbers the distinct ones; a worker keeps the ids of those it has
met. The ids are those of encoding the whole text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker remembers; beyond, it forgets the half it has met least.
REMEMBERED = 300_000

#: How the word vocabulary cuts a lower-case text (a fixed value of its file).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What it sets apart from letters, for Arrow, whose white space lacks the vertical tab.
APART = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t-\r \p{L}\p{N}]+)"
#: Latin text: nothing to normalize, and lower case and classes as in every Unicode version.
PLAIN = r"^[\t-\r -~\x{A1}-\x{12F}\x{131}-\x{24F}]*$"

#: One piece of Latin text by PIECE, for Arrow.
ONE = r"^('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \p{L}\p{N}]+)$"

_loaded: dict[str, "Encoder"] = {}


def _strings(held: pa.Array) -> list[str]:
    # several times as fast as to_pylist
    return held.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """A tokenizer file with the pieces met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: what all special tokens begin with; a text without it holds none
        self.special = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        #: whether the file cuts texts as PIECE says; else a text is one piece
        self.by_piece = self._cuts_like_piece(path)
        self.known: dict[str, int] = {}
        #: ids of all pieces met, one after the other, where each begins, and how often each was met
        self.flat, self.at, self.met = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Most pieces are met once; those met often stay, their counts halved so that what comes up now can replace them."""
        sizes = np.diff(self.at)
        keep = np.sort(np.argsort(-self.met, kind="stable")[: REMEMBERED // 2])
        pieces = list(self.known)
        self.known = {pieces[old]: new for new, old in enumerate(keep.tolist())}
        ends = np.concatenate([[0], np.cumsum(sizes[keep])])
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.at[keep] - ends[:-1], sizes[keep])]
        self.at, self.met = ends, self.met[keep] // 2

    @staticmethod
    def _cuts_like_piece(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        normal = [(x["type"], x.get("pattern"), x.get("content")) for x in (shape["normalizer"] or {}).get("normalizers", [])]
        cut = (shape["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return (
            normal == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
            and cut[0].get("pattern") == {"Regex": PIECE}
            and cut[0].get("behavior") == "Removed"
            and cut[0].get("invert") is True
        )

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces, and where each text begins and ends among them."""
        if not self.by_piece:
            return texts, np.arange(len(texts) + 1)
        plain = pc.and_(
            pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, self.special or "\x00"))
        )
        # white space ends every piece, so the words of other texts are encoded by themselves
        pieces = pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \1 ")
        lists = pc.ascii_split_whitespace(pc.if_else(plain, pieces, texts))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        return lists.flatten(), bounds - bounds[0]

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 10_000):
            part = pieces[i : i + 10_000]
            part, flat, sizes = self._ids_of(part)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.met = np.concatenate([self.met, np.zeros(len(part), np.int64)])

    def _ids_of(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces in another order, the ids of all, and how many each has.

        What is one piece for the tokenizer too can be asked for side by side in one
        text, with a blank between; the ids' word numbers tell the pieces apart.
        """
        held = pa.array(pieces, pa.string())
        single = pc.match_substring_regex(held, ONE)
        single = pc.and_(single, pc.match_substring_regex(held, PLAIN))
        single = pc.and_(single, pc.invert(pc.match_substring(held, self.special or "\x00"))).to_numpy(zero_copy_only=False)
        together = _strings(held.filter(pa.array(single))) if self.by_piece else []
        apart = _strings(held.filter(pa.array(~single))) if self.by_piece else pieces
        ids, sizes = [], []
        if together:
            found = self.tokenizer.encode(" ".join(together), add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(together)))
        if apart:
            each = [x.ids for x in self.tokenizer.encode_batch_fast(apart, add_special_tokens=False)]
            ids.append(np.array([x for own in each for x in own], np.uint32))
            sizes.append(np.array([len(x) for x in each], np.int64))
        return together + apart, np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in one array, and where each text begins and ends in it."""
        if len(self.known) > REMEMBERED:
            self._forget()
        flat, bounds = self._cut(texts.cast(pa.large_string()).fill_null(""))
        coded = flat.dictionary_encode()
        distinct = _strings(coded.dictionary)
        self._learn([piece for piece in distinct if piece not in self.known])
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.met[place] += 1
        sizes = self.at[place + 1] - self.at[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        own = self.flat[np.arange(ends[-1]) + np.repeat(self.at[place] - ends[:-1], sizes)]
        # one list of ids for each distinct piece, taken in the order of the pieces
        taken = pa.LargeListArray.from_arrays(ends, own).take(coded.indices)
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[bounds]


def encoder(path: str) -> Encoder:
    """This worker's encoder for ``path``."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
