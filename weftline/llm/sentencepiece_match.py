"""SentencePiece ids without the library: pieces located in a suffix array of the batch, then merged along their ranks."""

from __future__ import annotations

import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import computed, python_ready, whole_text

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Longest part that is merged without a heap, and the stride of places in edge keys, larger than any length looked up there.
SHORT, WIDE = 64, 128
_MODELS: dict[str, "Pieces"] = {}


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: ranks of prefixes of length 1, 2, 4, ... until all differ or 16, the longest piece, is reached."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, length = np.argsort(rank), 1
    while length < 16 and rank.max(initial=0) < len(rank) - 1:
        next_rank = np.zeros(len(rank), np.int64)
        next_rank[:-length or None] = rank[length:] + 1
        key = rank * (len(rank) + 2) + next_rank
        order = np.argsort(key)
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        length *= 2
    return order


class Pieces:
    """Vocabulary of a byte-fallback BPE model file whose normaliser leaves text as it is."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        tool = SentencePieceProcessor(model_file=path)
        size = tool.get_piece_size()
        self.text = [tool.id_to_piece(i) for i in range(size)]
        usable = [i for i in range(size) if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i) or tool.is_unused(i))]
        self.id = {self.text[i]: i for i in usable}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if tool.is_byte(i)}
        score = {i: tool.get_score(i) for i in usable}
        self.score = score
        self.longest = max(map(len, self.id))
        self.cut = not any(SPACE in p[1:] and p.strip(SPACE) for p in self.id)  # no piece holds a space after a letter
        back = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([back[i]]) if i in back else p.encode() for i, p in enumerate(self.text)]
        self.pairs = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        self.sorted = sorted((p for p in self.id if len(p) > 1), key=lambda p: [ord(c) for c in p])

    def edges(self, words: list[str]) -> tuple[dict[int, float], list[int]]:
        """All occurrences of all pieces of two characters or more, as ``place * WIDE + length -> score``, and where each word starts.

        The words are laid end to end, a character that no piece holds between them; each piece's occurrences are one range
        of the suffix array, found by binary search for all pieces at once, character by character.
        """
        text = np.frombuffer("\x00".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(w) + 1 for w in words])
        order = suffix_array(text)
        n = len(order)
        wide = np.concatenate([text, np.zeros(self.longest, np.int64)])
        pieces = self.sorted
        codes = np.zeros((len(pieces), self.longest), np.int64)
        for i, p in enumerate(pieces):
            codes[i, :len(p)] = [ord(c) for c in p]
        length = np.array([len(p) for p in pieces])

        def bound(right: bool) -> np.ndarray:
            low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                at = order[np.minimum(mid, n - 1)]
                sign, live = np.zeros(len(pieces), np.int64), np.ones(len(pieces), bool)
                for k in range(self.longest):
                    live &= (length > k) & (sign == 0)
                    if not live.any():
                        break
                    sign = np.where(live, np.sign(wide[at + k] - codes[:, k]), sign)
                below = (sign < 0) | (right & (sign == 0))
                low = np.where(open_ & below, mid + 1, low)
                high = np.where(open_ & ~below, mid, high)
            return low

        first, last = bound(False), bound(True)
        count = last - first
        piece = np.repeat(np.arange(len(pieces)), count)
        place = order[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        by_place = np.argsort(place * WIDE + length[piece])  # edges sorted by position
        key = (place * WIDE + length[piece])[by_place]
        score = np.array([self.score[self.id[p]] for p in pieces])[piece[by_place]]
        return dict(zip(key.tolist(), score.tolist())), [0, *ends[:-1].tolist()]

    def relax(self, word: str, edges: dict[int, float], at: int) -> list[int]:
        """Take edges that join two neighbouring parts, the best score first (then the leftmost), until none is left."""
        n, get, none = len(word), edges.get, float("-inf")
        if n <= SHORT:
            cuts, base = list(range(n + 1)), at * WIDE
            value = [get(i, none) for i in range(base + 2, base + 2 + (n - 1) * WIDE, WIDE)]
            while value and (best := max(value)) > none:
                i = value.index(best)
                del cuts[i + 1], value[i]
                if i < len(value):
                    value[i] = get(base + cuts[i] * WIDE + cuts[i + 2] - cuts[i], none)
                if i:
                    value[i - 1] = get(base + cuts[i - 1] * WIDE + cuts[i + 1] - cuts[i - 1], none)
        else:
            cuts = self.merged(n, lambda a, b: get((at + a) * WIDE + b - a, none) if b - a <= self.longest else none)
        out = []
        for a, b in zip(cuts, cuts[1:]):
            i = self.id.get(word[a:b])
            if i is not None:
                out.append(i)
            else:
                out += [self.byte[x] for x in word[a:b].encode("utf-8", "surrogatepass")]
        return out

    @staticmethod
    def merged(n: int, join) -> list[int]:
        """The cuts left of a long word, by the same rule with a heap."""
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(-v, i, i + 1, i + 2) for i in range(n - 1) if (v := join(i, i + 2)) > float("-inf")]
        heapify(heap)
        while heap:
            _, a, b, e = heappop(heap)
            if not alive[a] or b >= n or not alive[b] or after[a] != b or after[b] != e:
                continue
            alive[b], after[a] = False, e
            if e < n:
                before[e] = a
                if (v := join(a, after[e])) > float("-inf"):
                    heappush(heap, (-v, a, e, after[e]))
            if (p := before[a]) >= 0 and (v := join(p, e)) > float("-inf"):
                heappush(heap, (-v, p, a, e))
        return [i for i in range(n) if alive[i]] + [n]

    def words(self, text: str) -> list[str]:
        """Parts that no piece crosses: each run of spaces with the word after it; without that property, the whole text."""
        line = SPACE + text.replace(" ", SPACE) if text else ""
        if not self.cut or not line:
            return [line] if line else []
        return WORDS.findall(line)

    def parts(self, word: str) -> list[str]:
        """The word cut between neighbouring characters that no piece holds next to each other."""
        pairs, at, out = self.pairs, 0, []
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in pairs:
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, the space put before the first word taken off."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")[1:]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Cached:
    """Ids of words, kept up to a number of entries; new words of a batch are matched together."""

    def __init__(self, path: str, entries: int = 1 << 19, batch: int = 1 << 18):
        if path not in _MODELS:
            _MODELS[path] = Pieces(path)
        self.model, self.entries, self.batch, self.known, self.inner = _MODELS[path], entries, batch, {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.model.words(t) for t in texts]
        for cache in (self.known, self.inner):
            if len(cache) > self.entries:
                cache.clear()
        cut = {w: self.model.parts(w) for w in set().union(*split).difference(self.known)}
        new, size = [], 0
        for part in {p for parts in cut.values() for p in parts}.difference(self.inner):
            new.append(part)
            size += len(part)
            if size > self.batch:
                self.match(new)
                new, size = [], 0
        self.match(new)
        self.known.update({w: b"".join([self.inner[p] for p in parts]) for w, parts in cut.items()})
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in split]

    def match(self, parts: list[str]) -> None:
        if parts:
            edges, starts = self.model.edges(parts)
            for p, at in zip(parts, starts):
                self.inner[p] = pack(self.model.relax(p, edges, at))


def piece_ids(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded): piece ids of each whole text as packed little-endian 32-bit integers, and the text they give back.

    Null and empty texts have no ids and decode to the empty text; repeated rows agree; an empty table gives no rows; extra
    columns are ignored. Words are matched once in a worker for as long as they stay in its cache.
    """

    def encoder():
        tool = Cached(model)

        def encode(texts: list[str]) -> list:
            ids = tool.encode(texts)
            return [[x.tobytes() for x in ids], [tool.model.decode(x.tolist()) for x in ids]]

        return encode

    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return computed(rows, ["doc_id"], ["text"], encoder, "ids binary, decoded string")


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, their CRC-32, and the SHA-256 of the decoded text."""
    return piece_ids(docs, model).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))
