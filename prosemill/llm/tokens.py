"""Whole-text token ids from a public byte-level BPE vocabulary.

The ids are those of ``tokenizers.Tokenizer.encode``.  A single space or line
feed between two visible characters always starts a new pre-token of a
byte-level BPE, so a text can be cut there and each distinct piece encoded
once; texts with any other white space, and those that spell an added token of
the vocabulary (such as its end mark), go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import cache, use_cache

#: Distinct pieces (about 170 bytes each) of each of the two generations that a
#: Python worker remembers; one that falls out is encoded again when it returns.
MEMO_PIECES = 550_000
#: Punctuation taken off the end of a missing piece, so that its word is looked up.
ENDINGS = ".,;:!?#*$%&|"
#: White space beside the space and the line feed: a text with any goes to the library whole.
OTHER_WHITE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Missing pieces joined into one call of the library.
PIECES_AT_ONCE = 200
#: Code points of the texts that are cut at once.
CHARS_AT_ONCE = 4 << 20


class TextEncoder:
    """Encodes batches of texts; ``ids`` come back as little-endian uint32 bytes."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        if hasattr(self._library.model, "_resize_cache"):
            self._library.model._resize_cache(0)  # pieces are remembered here
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._endings: dict[str, bytes] = {}
        self._room = memo_pieces
        self.vocab_size = self._library.get_vocab_size()
        line_feed = self._ids("\n")
        # Cutting is sound only if the line feed is one id that stands alone.
        self._can_cut = self._library.normalizer is None and len(line_feed) == 4
        self._can_cut &= self._ids("a\n b\nc") == self._ids("a") + line_feed + self._ids(" b") + line_feed + self._ids("c")
        self._feed = line_feed
        self._feed_id = int(np.frombuffer(line_feed, "<u4")[0]) if self._can_cut else -1

    def _ids(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _marked(self, text: str) -> str | None:
        """The text with a space before each piece, each standing for " piece" or, with a line feed first, for itself; None if it can't be cut."""
        if not text or not self._can_cut:
            return None
        if text[0] in " \n" or text[-1] in " \n":
            return None
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        if any(map(text.__contains__, OTHER_WHITE)) or any(map(text.__contains__, self._added)):
            return None
        # The first stands after a line feed here, whose id is taken off again.
        return ("\n" + text).replace("\n", " \n")[1:]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        groups = [missing[i : i + PIECES_AT_ONCE] for i in range(0, len(missing), PIECES_AT_ONCE)]
        joined = ["\n".join([p[1:] if p[0] == "\n" else " " + p for p in g]) for g in groups]
        learned: dict[str, bytes] = {}
        for group, got in zip(groups, self._library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            raw = array("I", got.ids).tobytes()
            cuts = (np.flatnonzero(np.frombuffer(raw, "<u4") == self._feed_id) * 4).tolist()
            starts = [0, *[c + 4 for c in cuts]]
            learned.update(zip(group, [raw[a:b] for a, b in zip(starts, [*cuts, len(raw)], strict=True)], strict=True))
        for p in missing:
            if p[0] == "\n":
                learned[p] = self._feed + learned[p]
        return learned

    def _ending(self, text: str) -> bytes:
        if text not in self._endings:
            if len(self._endings) > 10_000:
                self._endings.clear()
            self._endings[text] = self._ids(text)
        return self._endings[text]

    def _know(self, pieces: list[str]) -> None:
        """Puts pieces that are not among the young ones there."""
        young, old = self._young, self._old
        if old:
            known = list(map(old.get, pieces))
            young.update((p, v) for p, v in zip(pieces, known, strict=True) if v is not None)
            pieces = [p for p, v in zip(pieces, known, strict=True) if v is None]
        split = []
        missing = {}
        for p in pieces:
            # Letters or digits before punctuation end a pre-token there.
            if p and p[-1] in ENDINGS:
                core = p.rstrip(ENDINGS)
                if core and core[-1].isalnum():
                    split.append((p, core))
                    if core not in young:
                        v = old.get(core)
                        if v is None:
                            missing[core] = None
                        else:
                            young[core] = v
                    continue
            missing[p] = None
        if missing:
            young.update(self._learn(list(missing)))
        for p, core in split:
            young[p] = young[core] + self._ending(p[len(core) :])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian uint32 bytes."""
        return [ids for some in _slices(texts) for ids in self._encode(some)]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        marked = [self._marked(t) if t else None for t in texts]
        parts = iter(self._spread([m for m in marked if m is not None]))
        out = [next(parts) if m is not None else self._ids(t) if t else b"" for t, m in zip(texts, marked, strict=True)]
        if len(self._young) > self._room:
            self._old, self._young = self._young, {}
        return out

    def _spread(self, marked: list[str]) -> list[bytes]:
        """The ids of texts that can be cut: each distinct piece is looked up once, and its ids go wherever it stands."""
        if not marked:
            return []
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        pieces = lists.flatten().dictionary_encode()
        distinct, at = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        young = self._young
        known = list(map(young.get, distinct))
        open_ = [i for i, v in enumerate(known) if v is None]
        self._know([distinct[i] for i in open_])
        for i in open_:
            known[i] = young[distinct[i]]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        length = sizes[at]
        upto = np.concatenate([[0], np.cumsum(length)])
        raw = ids[np.repeat(first[at] - upto[:-1], length) + np.arange(upto[-1])].tobytes()
        # A text's first piece stands after a line feed, whose id is taken off again.
        ends = (upto[lists.offsets.to_numpy()] * 4).tolist()
        return [raw[a + 4 : b] for a, b in zip(ends, ends[1:], strict=False)]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t) if t else 0
        if held >= CHARS_AT_ONCE:
            yield some
            some, held = [], 0
    if some:
        yield some


_encoders: dict[str, TextEncoder] = {}


cache("tokens", _encoders.clear)


def encoder(path: str) -> TextEncoder:
    """The Python worker's encoder for a vocabulary file."""
    use_cache("tokens")
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
