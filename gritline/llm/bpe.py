"""BPE encoding by a depth-first walk over the trie of distinct words, and decoding."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gritline.llm.batches import gather, list_array, map_text, offsets_of
from gritline.llm.pretokens import Known, pretokens, segments
from gritline.llm.vocabulary import NO_PARENT, Vocabulary, byte_letters, load, read

KNOWN_PAIRS = 300_000


def normal(text: str) -> str:
    """NFC and lower case, character by character (a sigma has one lower case)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class TrieEncoder:
    """Encodings of words through the last token of every prefix.

    The encoding of a prefix is the encoding of a shorter prefix and one more token, its last
    one. That token is the only suffix of the prefix that is its own encoding and that no merge
    joins to the token before it. So a trie of words needs one number per node, and words share
    the work of their common prefixes.

    The trie isn't stored: in sorted order, words are its leaves in depth-first order, and
    ``path`` holds the states from the root to where the last word left the next one.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.rank = {t: vocabulary.merged[p][0] for t, p in vocabulary.halves.items()}
        self.size: dict[int, int] = {}
        for words in (vocabulary.middle, vocabulary.final):
            self.size |= {t: len(w) for w, t in words.items()}
        # Tokens that are their own encoding; no other token is ever the last one.
        self.whole_middle = {w: t for w, t in vocabulary.middle.items() if vocabulary.merge(w, False) == (t,)}
        self.whole_final = (
            self.whole_middle
            if vocabulary.final is vocabulary.middle
            else {w: t for w, t in vocabulary.final.items() if vocabulary.merge(w) == (t,)}
        )
        self.opening = {w[:k] for w in (*vocabulary.middle, *vocabulary.final) for k in range(1, len(w) + 1)}
        self.apart: dict[tuple[int, int], bool] = {}
        self.known = Known({s.encode(): (t,) for s, t in vocabulary.specials.items()})

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its outer parts on one side, each with the rank of the merge it goes into."""
        out, parent = [], NO_PARENT
        while True:
            out.append((token, parent))
            if token not in self.v.halves:
                return out
            parent = self.rank[token]
            token = self.v.halves[token][side]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens as they are when one follows the other.

        They don't if two of their parts at the seam have a merge that comes before the merges
        that use up those parts; on a tie the left one of two equal merges comes first.
        """
        known = self.apart.get((left, right))
        if known is None:
            merged = self.v.merged
            rights = self._spine(right, 0)
            known = not any(
                (found := merged.get((x, y))) and found[0] < x_until and found[0] <= y_until
                for x, x_until in self._spine(left, 1)
                for y, y_until in rights
            )
            if len(self.apart) >= KNOWN_PAIRS:
                self.apart.clear()
            self.apart[left, right] = known
        return known

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Encode distinct words."""
        out: list[tuple[int, ...]] = [()] * len(words)
        size, apart, opening = self.size, self.apart, self.opening
        middle, final = self.whole_middle, self.whole_final
        path, reach, before = [-1], [0], b""  # reach: where the longest part that may become a token starts
        for place in sorted(range(len(words)), key=words.__getitem__):
            word = words[place]
            n = len(word)
            depth, shared = 0, min(len(path) - 1, n - 1)
            while depth < shared and before[depth] == word[depth]:
                depth += 1
            del path[depth + 1 :], reach[depth + 1 :]
            for end in range(depth + 1, n + 1):
                start = reach[-1]
                while word[start:end] not in opening:
                    start += 1
                tokens = final if end == n else middle
                at = start
                while True:
                    token = tokens.get(word[at:end])
                    if token is not None:
                        if not at:
                            break
                        pair = (path[at], token)
                        fits = apart.get(pair)
                        if fits or (fits is None and self._stay_apart(*pair)):
                            break
                    at += 1
                if end < n:
                    path.append(token)
                    reach.append(start)
            tokens, at = [token], n - size[token]
            while at:
                token = path[at]
                tokens.append(token)
                at -= size[token]
            tokens.reverse()
            out[place] = tuple(tokens)
            before = word
        return out

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins in them."""
        parts, owner, special = segments(texts, tuple(self.v.specials))
        if self.v.lowers:
            parts = [p if s else normal(p) for p, s in zip(parts, special)]
        pieces = pretokens(parts, special, self.v.glue_blank)
        places = self.known.index(pieces.words, self.encode_words)
        ids, ends = gather(places[pieces.codes], self.known.starts, self.known.flat)
        per_text = np.bincount(owner[pieces.segment], np.diff(ends), len(texts)) if len(ids) else np.zeros(len(texts))
        return ids, offsets_of(per_text.astype(np.int64))


@functools.lru_cache(maxsize=2)
def encoder(packed: bytes) -> TrieEncoder:
    """One encoder per worker process, so that words stay known from slice to slice."""
    return TrieEncoder(load(packed))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every row.

    A null or empty text has no ids. Rows are independent: repeated rows and ids stay, an empty
    table gives an empty one, and other columns are not read, whatever their names. Texts over
    a mebibyte are cut where no pre-token changes.
    """
    packed = read(vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = encoder(packed).encode(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), list_array(ends, ids)], names=[id_col, "ids"])

    return map_text(df, work, f"{id_col} bigint, ids array<int>", id_col, text_col)


@functools.lru_cache(maxsize=2)
def _spelling(packed: bytes) -> pa.Array:
    vocabulary = load(packed)
    if not vocabulary.joins_bytes:
        return pa.array(vocabulary.strings)
    letters = byte_letters()
    return pa.array(
        [
            s.encode() if s in vocabulary.specials else bytes(letters[c] for c in s)
            for s in vocabulary.strings
        ],
        pa.binary(),
    )


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded``: the ids' tokens as the library joins them.

    Tokens of word vocabularies are separated by a blank, those of byte vocabularies are joined
    and invalid UTF-8 is replaced. Null ids decode to an empty text.
    """
    packed = read(vocabulary)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists, spelling = part.column(1), _spelling(packed)
                ends = offsets_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                words = list_array(ends, spelling.take(lists.flatten()))
                if spelling.type == pa.binary():
                    joined = pc.binary_join(words, b"").to_pylist()
                    text = pa.array([t.decode(errors="replace") for t in joined], pa.string())
                else:
                    text = pc.binary_join(words, " ")
                yield pa.record_batch([part.column(0), lists, text], names=[id_col, "ids", "decoded"])

    lists = f"coalesce({ids_col}, array()) AS ids"
    return df.selectExpr(id_col, lists).mapInArrow(run, f"{id_col} bigint, ids array<int>, decoded string")
