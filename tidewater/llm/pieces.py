"""SentencePiece BPE models: token counts by rank-synchronous array merging, and exact encoding by
backtracking.

Both work on pre-tokens: no piece of such a model holds a space after another character, so no
merge crosses the border before a run of spaces, and equal pre-tokens get equal tokens everywhere.
A pre-token is encoded once per Python worker and then looked up.

Null texts count as empty; an empty text has no tokens (but begin and end ids where asked for).
Repeated rows give repeated rows. Texts are handled whole, at any length.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tidewater.llm.common import id_and_text, map_arrow, slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Pre-tokens that a Python worker remembers.
CACHE = 300_000


class Pieces:
    """The vocabulary of a BPE model with byte fallback and without text normalisation."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model_pb2.ModelProto.FromString(self.processor.serialized_model_proto())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.ids = {p.piece: i for i, p in normal}
        self.score = {p.piece: p.score for _, p in normal}
        self.byte_ids = [self.ids_of_byte(b) for b in range(256)]
        self.compatible: dict[tuple[str, str], bool] = {}
        self.bos, self.eos = self.processor.bos_id(), self.processor.eos_id()
        long = [p for p in self.ids if len(p) > 1]
        inside = {c for p in long for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in long) or not inside <= self.ids.keys():
            raise ValueError("pieces that hold a space within, or a character that is no piece, are not supported")
        #: Of the characters that stand between words, those that are in no longer piece.
        alone = "".join(c for c in "\t\n\r0123456789" if c not in inside)
        self.split = re.compile(f" *[^ {alone}]+| +" + f"|[{alone}]" * bool(alone)).findall

    def ids_of_byte(self, b: int) -> int:
        return self.processor.piece_to_id(f"<0x{b:02X}>")

    def pretokens(self, text: str) -> list[str]:
        return self.split(" " + text.replace(SPACE, " ")) if text else []

    # rank-synchronous merging ---------------------------------------------------------------

    @functools.cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of all pairs that merge, their ranks and results; by result, whether all
        pairs with it rank later; symbols by code point (characters without a piece: below 0, as
        many tokens as bytes)."""
        rank_of = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        found, size = [], self.processor.get_piece_size()
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None:
                    found.append((a * size + b, rank_of[self.score[p]], i))
        keys, ranks, made = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True))  # made is unique by key
        earliest = np.full(size, np.iinfo(np.int64).max)
        for side in (keys // size, keys % size):
            np.minimum.at(earliest, side, ranks)
        own = np.full(size, -1, np.int64)
        own[made] = ranks
        symbols = np.full(0x110000, -4, np.int32)
        symbols[:0x10000], symbols[:0x800], symbols[:0x80] = -3, -2, -1
        for p, i in self.ids.items():
            if len(p) == 1:
                symbols[ord(p)] = i
        return keys, ranks, made, earliest > own, symbols

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """How many tokens each pre-token has. All are held as one ragged array of symbols; in each
        round every sequence applies its own lowest-ranking pair, all sequences at once: at all its
        places if no pair that it can bring about ranks before it, else at the first place."""
        keys, ranks, made, safe, symbols = self.merges
        size, none = len(safe), np.iinfo(np.int32).max
        joined = np.frombuffer("".join(pretokens).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        sym = symbols[joined].astype(np.int64)
        seq = np.repeat(np.arange(len(pretokens)), [len(p) for p in pretokens])
        out = np.zeros(len(pretokens), np.int64)
        rank = np.full(len(sym), none, np.int32)  # of the pair that starts here
        merge = np.zeros(len(sym), np.int32)  # and what it becomes
        changed = np.arange(len(sym) - 1)
        while len(sym):
            changed = changed[(seq[changed] == seq[changed + 1]) & (sym[changed] >= 0) & (sym[changed + 1] >= 0)]
            key = sym[changed] * size + sym[changed + 1]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            rank[changed[hit]], merge[changed[hit]] = ranks[at[hit]], made[at[hit]]
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lengths = np.diff(np.append(starts, len(sym)))
            lowest = np.minimum.reduceat(rank, starts)
            ended = lowest == none
            if ended.any():  # these sequences are final: count their symbols
                out[seq[starts[ended]]] = np.add.reduceat(np.where(sym < 0, -sym, 1), starts)[ended]
            here = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank < none))
            moved = np.zeros(len(sym), bool)
            keep = np.repeat(~ended, lengths)
            if len(here):
                # of places that overlap every second one applies, counted from the first
                gap = np.append(True, (np.diff(here) != 1) | (seq[here[1:]] != seq[here[:-1]]))
                nth = np.arange(len(here)) - np.flatnonzero(gap)[np.cumsum(gap) - 1]
                first = np.append(True, seq[here[1:]] != seq[here[:-1]])
                here = here[first | (safe[merge[here]] & (nth % 2 == 0))]
                sym[here] = merge[here]
                keep[here + 1] = False
                moved[here] = True
            sym, seq, rank, merge, moved = sym[keep], seq[keep], rank[keep], merge[keep], moved[keep]
            there = np.flatnonzero(moved)
            before = there[there > 0] - 1
            changed = np.unique(np.concatenate([before[seq[before] == seq[before + 1]], there]))
            rank[changed] = none
            changed = changed[changed < len(sym) - 1]
        return out

    # backtracking ---------------------------------------------------------------------------

    @functools.cached_property
    def matcher(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p in self.ids:
            a.add_word(p, p)
        a.make_automaton()
        return a

    def merged(self, s: str) -> list[str]:
        """s by merging: best score first, of equal scores the leftmost."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: str, token: str) -> bool:
        """Whether merging both tokens' text again gives just these two. Tokens of which all
        neighbours fit are the encoding: a merge that crossed a border first would also come first
        among the two tokens' own merges."""
        known = self.compatible
        if (found := known.get((before, token))) is None:
            if len(known) > CACHE:
                known.clear()
            found = known[before, token] = self.kept_apart(before, token) if before else self.merged(token) == [token]
        return found

    def kept_apart(self, before: str, token: str) -> bool:
        """merged(before + token) == [before, token], known as soon as a merge crosses the border."""
        parts, border, scores = list(before + token), len(before), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return border == 1 and len(parts) == 2
            if at == border - 1:
                return False
            border -= at < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @functools.cached_property
    def shorter(self) -> dict[str, str]:
        """Each piece's longest proper prefix that is a piece, too."""
        return {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), "") for p in self.ids}

    def longest(self, s: str, pos: int) -> str:
        """The longest piece that starts at pos, or a character without a piece."""
        end, p = next(self.matcher.iter_long(s, pos), (0, ""))
        return p if p and end - len(p) + 1 == pos else s[pos]

    def encode(self, pretoken: str) -> list[str]:
        """The pre-token's tokens: always the longest match that fits; where none does, the
        position is marked as failed, and the token before it gives way to a shorter one."""
        s = pretoken.replace(" ", SPACE)
        greedy = [p for _, p in self.matcher.iter_long(s)]
        known, fits, shorter = self.compatible, self.fits, self.shorter
        before, kept = "", 0
        if "".join(greedy) == s:
            for p in greedy:
                if (found := known.get((before, p))) is None:
                    found = fits(before, p)
                if not found:
                    break
                before, kept = p, kept + 1
            else:
                return greedy
        n = len(s)
        failed = bytearray(n // 8 + 1)  # a bit for each position
        tokens = greedy[:kept]
        pos = sum(map(len, tokens))
        token = greedy[kept] if kept else self.longest(s, 0)
        while pos < n:
            before = tokens[-1] if tokens else ""
            while token:
                end = pos + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if (found := known.get((before, token))) is None:
                        found = fits(before, token)
                    if found:
                        break
                token = shorter.get(token, "")
            if token:
                tokens.append(token)
                pos = end
                token = self.longest(s, pos) if pos < n else ""
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                token = tokens.pop()
                pos -= len(token)
                token = shorter.get(token, "")
        return tokens

    def id_bytes(self, pretoken: str) -> bytes:
        """Its ids as little-endian unsigned 32-bit integers."""
        known = self.bytes_of
        return b"".join([known[t] if t in known else b"".join([self.byte_ids[b].to_bytes(4, "little") for b in t.encode()]) for t in self.encode(pretoken)])

    @functools.cached_property
    def bytes_of(self) -> dict[str, bytes]:
        return {p: i.to_bytes(4, "little") for p, i in self.ids.items()}


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_counts: dict[str, dict[str, int]] = {}
#: What is known now, and what was before it grew too large: words that come again pass on from there.
_ids: dict[str, list[dict[str, bytes]]] = {}


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, without begin and end."""
    vocabulary, known = pieces(path), _counts.setdefault(path, {})
    if len(known) > CACHE:
        known.clear()
    split = [vocabulary.pretokens(t) for t in texts]
    new = list({p for s in split for p in s}.difference(known))
    for i in range(0, len(new), 50_000):
        known.update(zip(new[i : i + 50_000], vocabulary.counts(new[i : i + 50_000]).tolist(), strict=True))
    return [sum(map(known.__getitem__, s)) for s in split]


def encode_text(text: str, path: str) -> bytes:
    """The ids with begin and end, as little-endian unsigned 32-bit integers."""
    vocabulary, held = pieces(path), _ids.setdefault(path, [{}, {}])
    if len(held[0]) > CACHE:
        held[:] = {}, held[0]
    known, before = held
    split = vocabulary.pretokens(text)
    for p in set(split).difference(known):
        known[p] = before.get(p) or vocabulary.id_bytes(p)
    begin, end = (np.array([i], "<u4").tobytes() for i in (vocabulary.bos, vocabulary.eos))
    return b"".join([begin, *map(known.__getitem__, split), end])


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterable[pa.RecordBatch]:
    for b in slices(batches):
        texts = [t or "" for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count_texts(texts, path), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    path = model or public_tokenizers.path(MODEL)
    out = map_arrow(id_and_text(docs), _count, "doc_id long, n_bytes long, n_tokens long", path=path)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _encode(batches: Iterable[pa.RecordBatch], path: str) -> Iterable[pa.RecordBatch]:
    decode = pieces(path).processor.decode
    for b in slices(batches, 64):
        ids = [encode_text(t or "", path) for t in b.column(1).to_pylist()]
        texts = [decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, begin and end included) and decoded text
    of every document."""
    return map_arrow(id_and_text(docs), _encode, "doc_id long, ids binary, decoded string", path=model or public_tokenizers.path(MODEL))


def encoding_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def digest(batches: Iterable[pa.RecordBatch], path: str) -> Iterable[pa.RecordBatch]:
        for b in _encode(batches, path):
            ids, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(id_and_text(docs), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path=model or public_tokenizers.path(MODEL))
