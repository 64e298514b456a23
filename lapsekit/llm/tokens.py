"""Token ids of whole texts by a given tokenizer file, with the ids of frequent words kept.

The supported tokenizers split a text by a pattern whose matches never run from other characters into a space or
line feed. So the ids of a text are those of its words, each with the one space or line feed before it, or without,
where the tokenizer drops white space. Texts with other or repeated white space go to the tokenizer whole: there the
pattern looks over several characters of white space.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Words whose ids a worker keeps at most; others are encoded again. It changes speed alone.
KEPT = 600_000
#: The most frequent words of the first SAMPLED characters stand in a table small enough for a processor's cache.
FREQUENT, SAMPLED = 100_000, 4_000_000
#: White space to Python that tokenizers do not take for it.
_ODD = "\x1c\x1d\x1e\x1f"
#: White space to Python but space and line feed, and either of these twice in a row.
_OTHER = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]
_REPEATED = ("  ", " \n", "\n ", "\n\n")
#: Stands alone between words that are encoded together, where white space leaves no trace in the ids.
_BREAK = "\x02"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold one of these, in any case, go to the tokenizer whole
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.marks = sorted({t[:2] for t in self.added})
        self.kept: dict[str, bytes] = {}
        self.frequent: dict[str, bytes] = {}
        self.counts: Counter[str] = Counter()
        self.sampled = 0
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.drops_space = ids("a a") == 2 * ids("a")
        # ids of marks that end a word of letters and stand apart from it
        marks = {c: np.array(ids(c), "<u4").tobytes() for c in ",."}
        self.ends = marks if ids("ab,") + ids("ab.") == ids("ab") + ids(",") + ids("ab") + ids(".") else {}
        if self.drops_space:
            self.breaks = np.array(ids(_BREAK), np.int64)
        else:
            self.space_led = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.space_led[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        size, part = 0, []
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= 1_000_000:
                out += self._part(part)
                size, part = 0, []
        return out + self._part(part)

    def _holds_added(self, text: str) -> bool:
        folded = text if text.isascii() and not any(m in text for m in self.marks) else text.lower()
        return folded is not text and any(t in folded for t in self.added) or any(t in text for t in self.added)

    def _words(self, text: str) -> list[str] | None:
        """Keys of the words: as they stand after a space, or with what stands before them."""
        if self._holds_added(text):
            return None
        if self.drops_space:
            return None if any(c in text for c in _ODD) else text.split()
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _REPEATED) or any(c in text for c in _OTHER):
            return None  # other or repeated white space
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\r" + words[0]  # nothing before it; no text with this character comes here
        return words

    def _part(self, texts: list[str]) -> list[bytes]:
        words = [self._words(text) for text in texts]
        found = [None if w is None else list(map(self.frequent.get, w)) for w in words]
        # Per text, the words that are not frequent and their ids, which is one look into the large table for each.
        rare: list[tuple[list[str], list[bytes | None]]] = []
        unseen: set[str] = set()
        for w, ids in zip(words, found, strict=True):
            here: list[str] = [x for x, i in zip(w, ids, strict=True) if i is None] if ids is not None and None in ids else []
            known = list(map(self.kept.get, here))
            if None in known:
                unseen.update([x for x, i in zip(here, known, strict=True) if i is None])
            rare.append((here, known))
        new = self._unseen(unseen)
        for ids, (here, known) in zip(found, rare, strict=True):
            if here:
                if None in known:
                    known = [new[x] if i is None else i for x, i in zip(here, known, strict=True)]
                each = iter(known)
                ids[:] = [next(each) if i is None else i for i in ids]
        if self.sampled < SAMPLED:
            self._sample(words)
        whole = self._each([text for text, w in zip(texts, words, strict=True) if w is None])
        return [next(whole) if ids is None else b"".join(ids) for ids in found]

    def _unseen(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words; those of Latin letters and a mark come from the letters' ids, which alone are kept."""
        stems = {w: w[:-1] for w in words if w[-1:] in self.ends and w[:-1].isalpha() and (w.isascii() or max(w) < "\u0250")}
        bare = words.difference(stems)
        known = {x: ids for x in stems.values() if (ids := self.frequent.get(x, self.kept.get(x))) is not None}
        new = dict(self._new(list(bare.union([x for x in stems.values() if x not in known]))))
        for word in list(new)[: max(0, KEPT - len(self.kept))]:
            self.kept[word] = new[word]
        for w, stem in stems.items():
            new[w] = (known[stem] if stem in known else new[stem]) + self.ends[w[-1]]
        return new

    def _sample(self, words: list[list[str] | None]) -> None:
        for w in words:
            if w is not None:
                self.counts.update(w)
                self.sampled += sum(map(len, w))
        self.sampled += 1
        if self.sampled >= SAMPLED:
            common = [w for w, _ in self.counts.most_common(FREQUENT)]
            self.frequent = {w: self.kept[w] for w in common if w in self.kept} | self._unseen({w for w in common if w not in self.kept})
            self.counts.clear()

    def _each(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 5000):
            for found in self.tokenizer.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False):
                yield np.array(found.ids, dtype="<u4").tobytes()

    def _new(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words, most of them encoded some hundred at a time."""
        if self.drops_space:
            plain = [w for w in words if _BREAK not in w]
            together = lambda part: f" {_BREAK} ".join(part)
        else:
            plain = [w for w in words if w[0] not in "\r\n"] if "" not in words else []
            together = lambda part: " " + " ".join(part)
        groups = [plain[at : at + 300] for at in range(0, len(plain), 300)]
        done: set[str] = set()
        for part, found in zip(groups, self.tokenizer.encode_batch_fast([together(p) for p in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=np.int64)
            if self.drops_space:
                at = np.flatnonzero(ids == self.breaks[0]) if len(self.breaks) == 1 else ids[:0]
                starts, ends = np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]])
            else:
                starts = np.flatnonzero(self.space_led[ids])
                ends = np.concatenate([starts[1:], [len(ids)]])
            if len(starts) == len(part):
                data = ids.astype("<u4").tobytes()
                yield from zip(part, [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True)
                done.update(part)
        rest = [w for w in words if w not in done]
        text = rest if self.drops_space else [w[1:] if w[0] == "\r" else w if w[0] == "\n" else " " + w for w in rest]
        yield from zip(rest, self._each(text), strict=True)
